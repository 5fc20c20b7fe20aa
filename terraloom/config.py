"""Run parameters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from terraloom.sources.grids import Grid


@dataclass(frozen=True)
class AnalysisConfig:
    """One run's settings. The analysis window is half open: [start, end)."""

    # Defaults that decide which observations pass.
    start: date = date(2021, 1, 1)
    end: date = date(2024, 1, 1)
    analysis_crs: str = "EPSG:32618"
    analysis_step_m: float = 20.0
    clear_threshold: float = 0.60
    optical_coverage: float = 0.999
    radar_coverage: float = 0.999
    radar_mode: str = "IW"
    radar_pass: str = "ASCENDING"
    radar_orbit: int = 77
    support_radius_m: float = 50_000.0
    rain_lookback_days: int = 30
    local_half_width_m: float = 30.0
    # Sub-samples per axis when a footprint is rasterised onto the analysis grid.
    footprint_samples: int = 10
    output_name: str = "multiscale_training_table"
    # With both set, optical pixels are resampled bilinearly from the first grid to the second.
    optical_grid: Grid | None = None
    analysis_grid: Grid | None = None

    def __post_init__(self) -> None:
        if self.end <= self.start:
            raise ValueError(f"window end {self.end} must be later than its start {self.start}")
        if (self.optical_grid is None) != (self.analysis_grid is None):
            raise ValueError("resampling needs both grids")

    @property
    def utm_zone(self) -> int:
        return int(self.analysis_crs.rsplit(":", 1)[1]) % 100

    @property
    def utm_south(self) -> bool:
        return self.analysis_crs.rsplit(":", 1)[1].startswith("327")
