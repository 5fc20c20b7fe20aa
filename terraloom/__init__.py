"""Spark-native construction of multiscale earth-observation training tables."""

from terraloom.config import AnalysisConfig

__all__ = ["AnalysisConfig"]
