"""The registered queries in SQL, written independently of the library's method.

Periods are joined by range, medoids by joining medians back, footprints by sampling every cell,
and supports by trying every cell: slow and plain where the library is quick.
"""

from __future__ import annotations

from terraloom.schemas import (
    INDEX_BANDS,
    OPTICAL_BANDS,
    OPTICAL_PREDICTORS,
    OUTPUT_SCHEMA,
    PREDICTORS,
    RADAR_PREDICTORS,
    STATISTICS,
    WEATHER_COLUMNS,
)
from workloads.standins import BAND_FACTORS

BANDS = list(OPTICAL_BANDS)
START, END = "date '1995-02-01'", "date '2001-08-01'"
PERIOD_END = "least(period_start + 8, make_date(year(period_start) + 1, 1, 1))"
DAYS = f"cast({PERIOD_END} - period_start as integer)"
ITEM_SCENE = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "cast(round(l_extendedprice * 100) as bigint), cast(l_quantity as bigint))"
)


def _standard_period(day: str) -> str:
    return f"make_date(year({day}), 1, 1) + cast(((dayofyear({day}) - 1) // 8) * 8 as int)"


def _band(name: str) -> str:
    p, c, q = BAND_FACTORS[name]
    value = (
        f"cast((cast(floor(l_extendedprice) as bigint) * {p} + px * {c} "
        f"+ cast(l_quantity as bigint) * {q}) % 10000 as integer)"
    )
    if name == "b5":
        value = f"case when (l_partkey + px) % 5 <> 0 then {value} end"
    return f"{value} as {name}"


def _svp(t: str) -> str:
    return f"0.6108e0 * exp((17.27e0 * ({t})) / (({t}) + 237.3e0))"


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f'round({expression}, {digits}) + 0.0e0 as "{name}"'


def _nd(a: str, b: str) -> str:
    return f"case when {a} >= 0 and {b} >= 0 and {a} + {b} <> 0 then ({a} - {b}) / ({a} + {b}) end"


CTES: dict[str, str] = {
    "px4": "select * from (values (0::bigint), (1), (2), (3)) p(px)",
    "stations": """
        select cast(s_suppkey as varchar) station_id, s_name station, s_suppkey station_key,
          -75.013e0 + (s_suppkey % 10) * 0.05e0 longitude,
          -12.017e0 + ((s_suppkey // 10) % 400) * 0.05e0 latitude
        from supplier""",
    "sites": """
        select *, station_key cell_x, 0::bigint cell_y,
          (station_key + 1000000) * 10000000 + 1000000 modis_pixel_id,
          cast((station_key + 1000000) * 10000000 + 1000000 as varchar) geom_id,
          463.312716528e0 * 463.312716528e0 footprint_area_m2, station_key % 10 met_cell,
          longitude + 0.01e0 era5_sampling_longitude, latitude - 0.01e0 era5_sampling_latitude,
          cast(station_key % 10 * 10 + 1000 as double) era5_sampling_distance_m
        from stations""",
    "bridge": """
        select geom_id, 'footprint' scale, cell_x, px cell_y, w weight from sites
          cross join (values (0::bigint, 1e0), (1, 1e0), (2, 0.5e0), (3, 0.25e0)) f(px, w)
        union all
        select station_id, 'local_60m', cell_x, px, w from sites
          cross join (values (0::bigint, 1e0), (1, 0.25e0)) l(px, w)""",
    "opt": f"""
        select {ITEM_SCENE} scene_id, l_shipdate ts, cast(l_partkey as varchar) mgrs_tile,
          l_suppkey cell_x, px cell_y, {", ".join(_band(b) for b in BANDS)}
        from lineitem cross join px4""",
    "cloud": f"""
        select {ITEM_SCENE} scene_id, l_shipdate ts, l_suppkey cell_x, px cell_y,
          l_discount * 10 cs_cdf
        from lineitem cross join px4 where l_discount > 0""",
    "sar_scenes": """
        select cast(o_orderkey as varchar) scene_id, o_orderdate ts,
          case when o_custkey % 23 = 0 then 'EW' else 'IW' end mode,
          case when o_orderstatus = 'P' then 'DESCENDING' else 'ASCENDING' end pass,
          case when o_custkey % 19 = 0 then 150 else 77 end rel_orbit,
          case when o_custkey % 17 = 0 then ['VV'] else ['VH', 'VV'] end pols
        from orders""",
    "sar_pixels": """
        select cast(o_orderkey as varchar) scene_id,
          o_orderkey % (select count(*) from supplier) cell_x, px cell_y,
          case when (o_orderkey + px) % 7 <> 0 then -o_totalprice / 65537e0 end vv,
          -o_totalprice / 65537e0 - (o_custkey % 7) vh,
          cast(30 + o_orderkey % 15 as double) angle
        from orders cross join px4""",
    "met": """
        select cell cell_x, h + to_days(cast(k * 30 - 9131 as int)) "hour",
          273.15e0 + v / 10e0 t2m, 273.15e0 + v / 10e0 - (e % 15) d2m,
          cast(e % 7 - 3 as double) u10, cast(u % 5 - 2 as double) v10, v * 1e9 / 65537e0 ssrd
        from (select user_id % 10 cell, date_trunc('hour', ts) h, avg(value) v, min(event_id) e,
                max(user_id) u from events group by 1, 2)
          cross join generate_series(0, 11) s(k)""",
    "rain": """
        select cast(o_orderdate as date) "day", o_custkey % 10 cell_x,
          sum(o_totalprice) / 65537e0 precipitation
        from orders group by 1, 2""",
    "et_all": f"""
        select {_standard_period("l_shipdate")} period_start, l_suppkey cell_x, 0::bigint cell_y,
          cast(min(floor(l_extendedprice / 3)) as integer) et_dn,
          cast(sum(l_linenumber) % 256 as integer) et_qc
        from lineitem group by 1, 2""",
    "et": f"select * from et_all where period_start >= {START} and period_start < {END}",
    "et_rated": f"""
        select *, et_dn * 0.1e0 ET_mm_period, et_dn * 0.1e0 / {DAYS} ET_mm_day,
          case when (et_qc & 1) = 0 and ((et_qc >> 2) & 1) = 0 and ((et_qc >> 5) & 7) <= 1
            and et_dn between 0 and 32700 then 1 else 0 end modis_good,
          coalesce((et_qc >> 5) & 7, 255) modis_scf_qc
        from et""",
    "periods": f"select distinct period_start, {PERIOD_END} pe, {DAYS} nd from et",
    "opt_win": f"select * from opt where ts >= {START} and ts < {END}",
    "seen": """
        select o.*, cast(ts as date) dd, period_start
        from opt_win o join periods p on cast(o.ts as date) >= p.period_start
          and cast(o.ts as date) < p.pe""",
    "clear": f"""
        select s.* from seen s join cloud c using (scene_id, cell_x, cell_y)
        where cs_cdf >= 0.6e0 and {" and ".join(f"{b} is not null" for b in BANDS)}""",
    "mosaic": f"""
        select period_start, dd, cell_x, cell_y, {", ".join(BANDS)} from (
          select *, row_number() over (partition by period_start, dd, cell_x, cell_y
            order by ts desc, scene_id desc) rn from clear) where rn = 1""",
    "centre": f"""
        select period_start, cell_x, cell_y, count(*) clear_days,
          {", ".join(f"median({b}) m_{b}" for b in BANDS)}
        from mosaic group by 1, 2, 3""",
    "medoid": f"""
        select period_start, cell_x, cell_y, cast(clear_days as integer) clear_days,
          cast(dd as varchar) date_key, {", ".join(BANDS)}
        from (select m.*, clear_days, row_number() over (partition by period_start, cell_x, cell_y
            order by {" + ".join(f"power(2 * {b} - 2 * m_{b}, 2)" for b in BANDS)}, dd) rn
          from mosaic m join centre using (period_start, cell_x, cell_y)) where rn = 1""",
    "optical_named": f"""
        select period_start, cell_x, cell_y,
          {", ".join(f"{dn} * 0.0001e0 {name}" for dn, name in OPTICAL_BANDS.items())}
        from medoid""",
    "optical_predictors": f"""
        select *, {", ".join(f"{_nd(a, b)} {n}" for n, (a, b) in INDEX_BANDS.items())}
        from optical_named""",
    "sar_selected": f"""
        select scene_id, ts from sar_scenes
        where ts >= {START} and ts < {END} and mode = 'IW' and pass = 'ASCENDING'
          and rel_orbit = 77 and list_contains(pols, 'VV') and list_contains(pols, 'VH')""",
    "sar_dated": """
        select s.*, cast(ts as date) dd, period_start from sar_selected s
          join periods p on cast(ts as date) >= period_start and cast(ts as date) < pe""",
    "sar": "select * from sar_pixels join sar_dated using (scene_id)",
    "radar_predictors": """
        select period_start, cell_x, cell_y, median(vv) VV_dB, median(vh) VH_dB,
          median(vv) - median(vh) VV_minus_VH_dB, median(angle) Angle_deg
        from sar group by 1, 2, 3""",
    "areas": "select geom_id, sum(weight) area from bridge where scale = 'footprint' group by 1",
    "opt_cover": """
        select geom_id, period_start, sum(weight) / any_value(area) share
        from (select distinct period_start, cell_x, cell_y from clear)
          join bridge b using (cell_x, cell_y) join areas using (geom_id)
        where scale = 'footprint' group by 1, 2""",
    "sar_cover": """
        select geom_id, period_start, sum(weight) / any_value(area) share
        from radar_predictors join bridge b using (cell_x, cell_y) join areas using (geom_id)
        where scale = 'footprint' and VV_dB is not null and VH_dB is not null group by 1, 2""",
    "opt_dates": """
        select geom_id, period_start, cast(count(distinct dd) as integer) dates_total,
          string_agg(distinct cast(dd as varchar), ';' order by cast(dd as varchar)) dates,
          cast(count(distinct scene_id) as integer) products_total
        from seen join bridge using (cell_x, cell_y) where scale = 'footprint' group by 1, 2""",
    "sar_dates": """
        select geom_id, period_start, cast(count(distinct dd) as integer) dates_total,
          string_agg(distinct cast(dd as varchar), ';' order by cast(dd as varchar)) dates,
          cast(count(distinct scene_id) as integer) products_total
        from sar join bridge using (cell_x, cell_y) where scale = 'footprint' group by 1, 2""",
    "obs": "select * from sites cross join periods",
    "avail": f"""
        select station_id, station, longitude, latitude, modis_pixel_id, o.geom_id, met_cell,
          footprint_area_m2, era5_sampling_longitude, era5_sampling_latitude,
          era5_sampling_distance_m, o.period_start, nd,
          cast(o.period_start as varchar) period_text, cast(pe - 1 as varchar) period_last,
          ET_mm_period, ET_mm_day, coalesce(modis_good, 0) modis_good,
          coalesce(modis_scf_qc, 255) modis_scf_qc,
          coalesce(od.dates_total, 0) s2_dates_total, coalesce(od.dates, '') s2_dates,
          coalesce(oc.share, 0e0) * 100 s2_union_coverage_pct,
          coalesce(sd.dates_total, 0) s1_dates_total, coalesce(sd.dates, '') s1_dates,
          coalesce(sd.products_total, 0) s1_products_total,
          coalesce(sc.share, 0e0) * 100 s1_union_coverage_pct,
          case when oc.share >= 0.999e0 then 1 else 0 end s2_valid,
          case when sd.products_total > 0 and sc.share >= 0.999e0 then 1 else 0 end s1_valid,
          case when modis_good = 1 and oc.share >= 0.999e0 and sd.products_total > 0
            and sc.share >= 0.999e0 and pe <= {END} then 1 else 0 end valid_observation,
          'MODIS_footprint' target_support, epoch_ms(cast(o.period_start as timestamp)) millis
        from obs o
          left join et_rated e on e.period_start = o.period_start and e.cell_x = o.cell_x
          left join opt_cover oc on oc.geom_id = o.geom_id and oc.period_start = o.period_start
          left join sar_cover sc on sc.geom_id = o.geom_id and sc.period_start = o.period_start
          left join opt_dates od on od.geom_id = o.geom_id and od.period_start = o.period_start
          left join sar_dates sd on sd.geom_id = o.geom_id and sd.period_start = o.period_start""",
    "met_win": f"""select * from met where "hour" >= {START} and "hour" < {END}""",
    "rain_win": f"""select * from rain where "day" >= {START} - 30 and "day" < {END}""",
    "hourly": f"""
        select "hour", cell_x, t2m - 273.15e0 Tair_C, d2m - 273.15e0 Tdew_C,
          greatest({_svp("t2m - 273.15e0")} - {_svp("d2m - 273.15e0")}, 0e0) VPD_kPa,
          sqrt(u10 * u10 + v10 * v10) Wind_ms, ssrd / 1e6 SolarRad_MJ_m2_hour
        from met_win""",
    "met_period": """
        select cell_x, period_start, avg(Tair_C) Tair_mean_C, max(Tair_C) Tair_max_C,
          avg(VPD_kPa) VPD_mean_kPa, max(VPD_kPa) VPD_max_kPa,
          sum(SolarRad_MJ_m2_hour) / any_value(nd) SolarRad_MJ_m2_day, avg(Wind_ms) Wind_mean_ms
        from hourly join periods on "hour" >= period_start and "hour" < pe group by 1, 2""",
    "rain_in": """
        select cell_x, period_start, sum(precipitation) Precip_period_mm
        from rain_win join periods on "day" >= period_start and "day" < pe group by 1, 2""",
    "rain_before": """
        select cell_x, period_start, sum(precipitation) Precip_prev30d_mm
        from rain_win join periods on "day" >= period_start - 30 and "day" < period_start
        group by 1, 2""",
    "counts": """
        select p.period_start,
          cast(coalesce(h.n, 0) as integer) era5_hours_total, nd * 24 era5_hours_expected,
          cast(coalesce(r.n, 0) as integer) chirps_days_period, nd chirps_days_expected,
          cast(coalesce(b.n, 0) as integer) chirps_days_prev30, 30 chirps_days_prev30_expected
        from periods p
          left join (select period_start, count(distinct "hour") n from met_win join periods
            on "hour" >= period_start and "hour" < pe group by 1) h using (period_start)
          left join (select period_start, count(distinct "day") n from rain_win join periods
            on "day" >= period_start and "day" < pe group by 1) r using (period_start)
          left join (select period_start, count(distinct "day") n from rain_win join periods
            on "day" >= period_start - 30 and "day" < period_start group by 1) b
            using (period_start)""",
    "meteo": f"""
        select *, case when missing = 0 and temporal = 1 then 1 else 0 end complete from (
          select o.station_id, o.period_start, {", ".join(WEATHER_COLUMNS)},
            c.* exclude (period_start),
            {" + ".join(f"case when {c} is null then 1 else 0 end" for c in WEATHER_COLUMNS)} missing,
            case when era5_hours_total = era5_hours_expected
              and chirps_days_period = chirps_days_expected
              and chirps_days_prev30 = 30 then 1 else 0 end temporal,
            11131.949079327358e0 era5_support_m, 5565.974539663679e0 chirps_support_m,
            'nearest_valid_land_pixel' era5_sampling_method,
            era5_sampling_longitude, era5_sampling_latitude, era5_sampling_distance_m
          from obs o
            left join met_period m on m.cell_x = o.met_cell and m.period_start = o.period_start
            left join rain_in i on i.cell_x = o.met_cell and i.period_start = o.period_start
            left join rain_before b on b.cell_x = o.met_cell and b.period_start = o.period_start
            left join counts c on c.period_start = o.period_start)""",
    # Sinusoidal cell of each station.
    "located": """
        select *,
          cast(floor((6371007.181e0 * radians(longitude) * cos(radians(latitude)) + 20015109.354e0)
            / 463.312716528e0) as bigint) ex,
          cast(floor((6371007.181e0 * radians(latitude) - 10007554.677e0) / -463.312716528e0)
            as bigint) ey
        from stations""",
    "met_land": """
        select * from (select distinct cx + dx cell_x, cy + dy cell_y
          from (select cast(floor((longitude + 180) / 0.1e0) as bigint) cx,
              cast(floor((latitude - 90) / -0.1e0) as bigint) cy from stations)
            cross join generate_series(-6, 6) a(dx) cross join generate_series(-6, 6) b(dy))
        where (cell_x * 7 + cell_y * 3) % 5 >= 3""",
    "met_distance": """
        select station_id, station, cell_x, cell_y, clon, clat,
          2 * 6371008.8e0 * asin(sqrt(least(1e0, power(sin(radians(clat - latitude) / 2), 2)
            + cos(radians(latitude)) * cos(radians(clat)) * power(sin(radians(clon - longitude) / 2), 2)
          ))) d
        from stations cross join (select *, -180e0 + (cell_x + 0.5e0) * 0.1e0 clon,
          90e0 + (cell_y + 0.5e0) * -0.1e0 clat from met_land)""",
}


def _statistics(source: str, bands: list[str], scale_filter: str) -> str:
    """Two passes: means, then centred squares."""
    means = ", ".join(
        f"sum(weight * {b}) / sum(case when {b} is not null then weight end) m_{b}" for b in bands
    )
    stats = ", ".join(
        f"any_value(m_{b}) {b}_mean, sqrt(sum(weight * ({b} - m_{b}) * ({b} - m_{b})) "
        f"/ sum(case when {b} is not null then weight end)) {b}_stdDev"
        for b in bands
    )
    zone = "geom_id, scale, period_start"
    placed = f"select * from {source} join bridge using (cell_x, cell_y) where {scale_filter}"
    return (
        f"select {zone}, {stats} from ({placed}) join "
        f"(select {zone}, {means} from ({placed}) group by all) using ({zone}) group by {zone}"
    )


CTES["opt_stats"] = _statistics("optical_predictors", OPTICAL_PREDICTORS, "true")
CTES["sar_stats"] = _statistics("radar_predictors", RADAR_PREDICTORS, "true")
CTES["stats"] = "select * from opt_stats full join sar_stats using (geom_id, scale, period_start)"

_MISSING = " + ".join(f"case when {c} is null then 1 else 0 end" for c in STATISTICS)
CTES["rows"] = f"""
    select *, case when stats_missing = 0 and complete = 1 then 1 else 0 end stats_complete from (
      select a.*, m.* exclude (station_id, period_start, era5_sampling_longitude,
          era5_sampling_latitude, era5_sampling_distance_m),
        z.scale, z.support, s.* exclude (geom_id, scale, period_start), {_MISSING} stats_missing
      from avail a
        cross join (values ('footprint', 'MODIS_footprint'), ('local_60m', '60m_x_60m'))
          z(scale, support)
        join meteo m on m.station_id = a.station_id and m.period_start = a.period_start
        left join stats s on s.scale = z.scale and s.period_start = a.period_start
          and s.geom_id = case when z.scale = 'footprint' then a.geom_id else a.station_id end
      where valid_observation = 1)"""

_RENAMED = {
    "period_start": "period_text",
    "period_end": "period_last",
    "number_days": "nd",
    "s1_pass": "'ASCENDING'",
    "s1_relative_orbit": "77",
    "meteo_missing_count": "missing",
    "meteo_temporal_complete": "temporal",
    "meteo_complete": "complete",
    "predictor_support": "support",
    "missing_stats_count": "stats_missing + missing",
    "system:time_start": "millis",
}


def _output_select() -> str:
    columns = []
    for field in OUTPUT_SCHEMA.fields:
        source = _RENAMED.get(field.name, field.name)
        if field.name in STATISTICS:
            source = f"coalesce({source}, -9999e0)"
        if field.dataType.typeName() == "double":
            columns.append(_r(source, field.name))
        else:
            columns.append(f'{source} as "{field.name}"')
    return ", ".join(columns)


def _stats_select(bands: list[str]) -> str:
    return ", ".join(_r(f"{b}_{s}", f"{b}_{s}") for b in bands for s in ("mean", "stdDev"))


# Transverse Mercator of zone 18 north, as further CTE steps over (lon, lat) or (x, y).
E2 = "0.0066943799901413165e0"
EP2 = "0.006739496742276434e0"


def _utm_forward(source: str) -> str:
    return f"""
      select * exclude (phi, n, t, c, a, m),
        500000e0 + 0.9996e0 * n * (a + (1 - t + c) * a ** 3 / 6
          + (5 - 18 * t + t * t + 72 * c - 58 * {EP2}) * a ** 5 / 120) x,
        0.9996e0 * (m + n * tan(phi) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24
          + (61 - 58 * t + t * t + 600 * c - 330 * {EP2}) * a ** 6 / 720)) y
      from (select *, 6378137e0 / sqrt(1 - {E2} * sin(phi) ** 2) n, tan(phi) ** 2 t,
          {EP2} * cos(phi) ** 2 c, radians(lon + 75) * cos(phi) a,
          6378137e0 * ((1 - {E2} / 4 - 3 * {E2} ** 2 / 64 - 5 * {E2} ** 3 / 256) * phi
            - (3 * {E2} / 8 + 3 * {E2} ** 2 / 32 + 45 * {E2} ** 3 / 1024) * sin(2 * phi)
            + (15 * {E2} ** 2 / 256 + 45 * {E2} ** 3 / 1024) * sin(4 * phi)
            - (35 * {E2} ** 3 / 3072) * sin(6 * phi)) m
        from (select *, radians(lat) phi from ({source})))"""


def _utm_inverse(source: str) -> str:
    e1 = f"((1 - sqrt(1 - {E2})) / (1 + sqrt(1 - {E2})))"
    return f"""
      select * exclude (mu, phi, n, r, t, c, d),
        -75e0 + degrees((d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c
          + 8 * {EP2} + 24 * t * t) * d ** 5 / 120) / cos(phi)) lon,
        degrees(phi - (n * tan(phi) / r) * (d ** 2 / 2
          - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {EP2}) * d ** 4 / 24
          + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {EP2} - 3 * c * c) * d ** 6 / 720)) lat
      from (select *, (x - 500000e0) / (n * 0.9996e0) d from (
        select *, 6378137e0 / sqrt(1 - {E2} * sin(phi) ** 2) n,
          6378137e0 * (1 - {E2}) / (1 - {E2} * sin(phi) ** 2) ** 1.5e0 r,
          tan(phi) ** 2 t, {EP2} * cos(phi) ** 2 c
        from (select *, mu + (3 * {e1} / 2 - 27 * {e1} ** 3 / 32) * sin(2 * mu)
            + (21 * {e1} ** 2 / 16 - 55 * {e1} ** 4 / 32) * sin(4 * mu)
            + (151 * {e1} ** 3 / 96) * sin(6 * mu) + (1097 * {e1} ** 4 / 512) * sin(8 * mu) phi
          from (select *, y / (0.9996e0 * 6378137e0 * (1 - {E2} / 4 - 3 * {E2} ** 2 / 64
            - 5 * {E2} ** 3 / 256)) mu from ({source})))))"""


CTES["boxes"] = _utm_forward("select station_id, longitude lon, latitude lat from stations")
CTES["box_cells"] = """
    select station_id geom_id, 'local_60m' scale, cell_x, cell_y, w from (
      select *, greatest(least((cell_x + 1) * 20e0, x + 30) - greatest(cell_x * 20e0, x - 30), 0)
        * greatest(least((cell_y + 1) * 20e0, y + 30) - greatest(cell_y * 20e0, y - 30), 0)
        / 400e0 w
      from (select *, cast(floor(x / 20) as bigint) + dx cell_x,
          cast(floor(y / 20) as bigint) + dy cell_y
        from boxes cross join generate_series(-2, 2) a(dx)
          cross join generate_series(-2, 2) b(dy))) where w > 0"""
CTES["corners"] = _utm_forward("""
    select ex, ey, (cx - 0) / (6371007.181e0 * cos(cy / 6371007.181e0)) * 180e0 / pi() lon,
      degrees(cy / 6371007.181e0) lat
    from (select ex, ey, -20015109.354e0 + (ex + a) * 463.312716528e0 cx,
        10007554.677e0 + (ey + b) * -463.312716528e0 cy
      from (select distinct ex, ey from located)
        cross join (values (0), (1)) ca(a) cross join (values (0), (1)) cb(b))""")
CTES["candidates"] = """
    select ex, ey, ix, unnest(generate_series(y0, y1)) iy from (
      select ex, ey, y0, y1, unnest(generate_series(x0, x1)) ix from (
        select ex, ey, cast(floor(min(x) / 20) as bigint) - 1 x0,
          cast(floor(max(x) / 20) as bigint) + 1 x1, cast(floor(min(y) / 20) as bigint) - 1 y0,
          cast(floor(max(y) / 20) as bigint) + 1 y1
        from corners group by 1, 2))"""
CTES["sampled"] = _utm_inverse("""
    select ex, ey, ix, iy, (ix + (u + 0.5e0) / 10) * 20e0 x, (iy + (v + 0.5e0) / 10) * 20e0 y
    from candidates cross join generate_series(0, 9) su(u) cross join generate_series(0, 9) sv(v)""")
CTES["voted"] = """
    select ex, ey, ix, iy, count(*) filter (
      floor((6371007.181e0 * radians(lon) * cos(radians(lat)) + 20015109.354e0)
        / 463.312716528e0) = ex
      and floor((6371007.181e0 * radians(lat) - 10007554.677e0) / -463.312716528e0) = ey) hits
    from sampled group by 1, 2, 3, 4"""

SELECTS: dict[str, str] = {
    "q_scan_et": "select * from et",
    "q_scan_stations": f"""select station_id, station, {_r("longitude", "longitude")},
        {_r("latitude", "latitude")} from stations""",
    "q_scan_optical": "select * from opt_win",
    "q_optical_resampled": f"""select scene_id, ts, mgrs_tile, cell_x, t cell_y,
        {", ".join(f"""cast(case when sum(w) filter ({b} is not null) > 1 - 1e-9
          then floor(sum(w * {b}) / sum(w) filter ({b} is not null) + 0.500001e0) end as integer) {b}"""
          for b in BANDS)}
        from opt_win join (select px, t, 1 - abs((10e0 + 20 * t) - (15e0 + 30 * px)) / 30e0 w
            from range(0, 4) p(px), range(-1, 8) s(t)) on px = cell_y and w > 0
        group by all having b2 is not null""",
    "q_scan_radar": f"""select scene_id, cell_x, cell_y, {_r("vv", "vv")}, {_r("vh", "vh")},
        {_r("angle", "angle")}, ts from sar_pixels join sar_selected using (scene_id)""",
    "q_scan_hourly": f"""select "hour", cell_x, 0::bigint cell_y,
        {", ".join(_r(c, c) for c in ("t2m", "d2m", "u10", "v10", "ssrd"))} from met_win""",
    "q_scan_rain_lookback": f"""select "day", cell_x, 0::bigint cell_y,
        {_r("precipitation", "precipitation")} from rain_win""",
    "q_filter_halfopen": f"select scene_id, ts from sar_scenes where ts >= {START} and ts < {END}",
    "q_filter_bounds": f"""select scene_id, cell_x, cell_y, {_r("cs_cdf", "cs_cdf")} from cloud
        where exists (select 1 from bridge b where b.cell_x = cloud.cell_x
          and b.cell_y = cloud.cell_y and scale = 'local_60m')""",
    "q_date_key": "select scene_id, strftime(ts, '%Y-%m-%d') date_key from sar_scenes",
    "q_et_quality": """select period_start, cell_x, et_dn, et_qc,
        case when (et_qc & 1) = 0 and ((et_qc >> 2) & 1) = 0 and ((et_qc >> 5) & 7) <= 1
          and et_dn between 0 and 32700 then 1 else 0 end modis_good,
        coalesce((et_qc >> 5) & 7, 255) modis_scf_qc from et_all""",
    "q_et_scale": f"""select period_start, cell_x, {_r("et_dn * 0.1e0", "ET_mm_period")},
        {_r(f"et_dn * 0.1e0 / {DAYS}", "ET_mm_day")} from et_all""",
    "q_period_end": f"""select distinct period_start, {PERIOD_END} period_end, {DAYS} number_days,
        cast({PERIOD_END} - 1 as varchar) last_day,
        epoch_ms(cast(period_start as timestamp)) start_millis from et_all""",
    "q_pixel_id": """select station_id, ex cell_x, ey cell_y,
        (ex + 1000000) * 10000000 + (ey + 1000000) modis_pixel_id from located""",
    "q_station_cell": f"""select station_id, {_r("longitude", "longitude")},
        {_r("latitude", "latitude")}, (ex + 1000000) * 10000000 + (ey + 1000000) modis_pixel_id,
        {_r("463.312716528e0 * 463.312716528e0", "footprint_area_m2")} from located""",
    "q_cell_grid": """select distinct ex + dx cell_x, ey + dy cell_y from located
        cross join generate_series(-2, 2) a(dx) cross join generate_series(-2, 2) b(dy)""",
    "q_station_index": """select station_id, row_number() over (order by station_id) station_index
        from (select distinct station_id from stations)""",
    "q_obs_grid": "select station_id, modis_pixel_id, period_start from obs",
    "q_et_at_station": f"""select station_id, period_start, {_r("ET_mm_period", "ET_mm_period")},
        {_r("ET_mm_day", "ET_mm_day")}, coalesce(modis_good, 0) modis_good,
        coalesce(modis_scf_qc, 255) modis_scf_qc
        from obs left join et_rated using (period_start, cell_x, cell_y)""",
    "q_svp": f"""select "hour", cell_x, {_r(_svp("t2m - 273.15e0"), "svp_air_kpa")},
        {_r(_svp("d2m - 273.15e0"), "svp_dew_kpa")} from met""",
    "q_hourly_derive": f"""select "hour", cell_x, {_r("t2m - 273.15e0", "Tair_C")},
        {_r("d2m - 273.15e0", "Tdew_C")},
        {_r(f"greatest({_svp('t2m - 273.15e0')} - {_svp('d2m - 273.15e0')}, 0e0)", "VPD_kPa")},
        {_r("sqrt(u10 * u10 + v10 * v10)", "Wind_ms")},
        {_r("ssrd / 1e6", "SolarRad_MJ_m2_hour")} from met""",
    "q_met_period": f"""select cell_x, period_start,
        {", ".join(_r(c, c) for c in WEATHER_COLUMNS[:6])} from met_period""",
    "q_met_counts": "select * from counts",
    "q_rain_period": f"""select cell_x, period_start,
        {_r("Precip_period_mm", "Precip_period_mm")} from rain_in""",
    "q_rain_prev30": f"""select cell_x, period_start,
        {_r("Precip_prev30d_mm", "Precip_prev30d_mm")} from rain_before""",
    "q_met_complete": f"""select station_id, period_start, era5_hours_total, era5_hours_expected,
        chirps_days_period, chirps_days_expected, chirps_days_prev30, chirps_days_prev30_expected,
        missing meteo_missing_count, temporal meteo_temporal_complete, complete meteo_complete,
        {_r("era5_support_m", "era5_support_m")}, {_r("chirps_support_m", "chirps_support_m")},
        era5_sampling_method from meteo""",
    "q_meteorology": f"""select station_id, period_start,
        {", ".join(_r(c, c) for c in WEATHER_COLUMNS)},
        {_r("era5_sampling_longitude", "era5_sampling_longitude")},
        {_r("era5_sampling_latitude", "era5_sampling_latitude")},
        {_r("era5_sampling_distance_m", "era5_sampling_distance_m")},
        complete meteo_complete from meteo""",
    "q_nearest_cell": f"""select station_id, b.cell_x met_x, b.cell_y met_y,
        {_r("b.clon", "era5_sampling_longitude")}, {_r("b.clat", "era5_sampling_latitude")},
        round(b.d, 3) era5_sampling_distance_m
        from (select station_id, arg_min(struct_pack(cell_x := cell_x, cell_y := cell_y,
            clon := clon, clat := clat, d := d), (d, cell_y, cell_x)) b
          from met_distance where d <= 50000 group by 1)""",
    "q_nearest_cell_unresolved": """select station_id, station from stations
        where station_id not in (select station_id from met_distance where d <= 6000)""",
    "q_scene_period_join": "select scene_id, dd, period_start from sar_dated",
    "q_link_cloud": f"""select scene_id, cell_x, cell_y, {_r("cs_cdf", "cs_cdf")}
        from opt left join cloud using (scene_id, cell_x, cell_y)""",
    "q_prepare_optical": f"""select scene_id, cell_x, cell_y, mgrs_tile,
        strftime(ts, '%Y-%m-%d') date_key, valid, {", ".join(
            _r(f"case when valid = 1 then {dn} * 0.0001e0 end", name)
            for dn, name in OPTICAL_BANDS.items())}
        from (select o.*, case when coalesce(cs_cdf, 0e0) >= 0.6e0
            and {" and ".join(f"{b} is not null" for b in BANDS)} then 1 else 0 end valid
          from opt o left join cloud using (scene_id, cell_x, cell_y))""",
    "q_daily_mosaic": "select * from mosaic",
    "q_optical_medoid": "select * from medoid",
    "q_indices": f"""select period_start, cell_x, cell_y,
        {", ".join(_r(n, n) for n in INDEX_BANDS)} from optical_predictors""",
    "q_embedding_medoid": f"""
        with e as (select label, vec_id, unnest(embedding)::double x,
            generate_subscripts(embedding, 1) dim from embeddings),
          c as (select label, dim, median(x) m from e group by 1, 2),
          s as (select label, vec_id, round(sum((x - m) * (x - m)), 9) score
            from e join c using (label, dim) group by 1, 2)
        select label, b.vec_id, {_r("b.score", "score")} from (
          select label, arg_min(struct_pack(vec_id := vec_id, score := score), (score, vec_id)) b
          from s group by 1)""",
    "q_resample_bilinear": f"""
        with src as (select p_partkey % 50 i, p_partkey // 50 j, p_retailprice v from part
            where p_size <> 7),
          t as (select distinct unnest(generate_series(cast(ceil((i * 30 - 15 - 5) / 20e0 - 0.5e0)
              as bigint), cast(floor((i * 30 + 45 - 5) / 20e0 - 0.5e0) as bigint))) tx, j from src),
          g as (select distinct tx, unnest(generate_series(cast(ceil((j * 30 - 15 - 15) / 20e0
              - 0.5e0) as bigint), cast(floor((j * 30 + 45 - 15) / 20e0 - 0.5e0) as bigint))) ty
            from t),
          f as (select tx, ty, (5 + (tx + 0.5e0) * 20) / 30 - 0.5e0 fx,
            (15 + (ty + 0.5e0) * 20) / 30 - 0.5e0 fy from g),
          n as (select tx, ty, v, (1 - abs(fx - i)) * (1 - abs(fy - j)) w from f join src
            on i between floor(fx) and floor(fx) + 1 and j between floor(fy) and floor(fy) + 1)
        select tx cell_x, ty cell_y, {_r("sum(w * v) / sum(w)", "value")} from n
        where w > 0 group by 1, 2 having sum(w) > 1 - 1e-9""",
    "q_radar_median": f"""select period_start, cell_x, cell_y,
        {", ".join(_r(b, b) for b in RADAR_PREDICTORS)} from radar_predictors""",
    "q_local_cells": f"""select geom_id, scale, cell_x, cell_y, {_r("w", "weight")} from box_cells""",
    "q_footprint_cells": f"""select cast((ex + 1000000) * 10000000 + (ey + 1000000) as varchar)
        geom_id, 'footprint' scale, ix cell_x, iy cell_y, {_r("hits / 100e0", "weight")}
        from voted where hits > 0""",
    "q_resolved_stats": f"""select geom_id, scale, {_r("m", "value_mean")},
        {_r("sqrt(greatest(sum(w * (v - m) * (v - m)) / sum(w), 0))", "value_stdDev")}
        from (select *, sum(w * v) over (partition by geom_id, scale)
            / sum(w) over (partition by geom_id, scale) m
          from (select geom_id, scale, w,
              cast((cell_x * 7 + cell_y * 13) % 101 as double) v
            from (select cast((ex + 1000000) * 10000000 + (ey + 1000000) as varchar) geom_id,
                'footprint' scale, ix cell_x, iy cell_y, hits / 100e0 w from voted where hits > 0
              union all select geom_id, scale, cell_x, cell_y, w from box_cells)))
        group by geom_id, scale, m""",
    "q_optical_coverage": f"""select geom_id, period_start, {_r("share", "share")}
        from opt_cover""",
    "q_radar_coverage": f"select geom_id, period_start, {_r('share', 'share')} from sar_cover",
    "q_scene_dates": """select * from opt_dates union all
        select * replace ('radar-' || geom_id as geom_id) from sar_dates""",
    "q_zonal_stats": f"""select geom_id, scale, period_start, {_stats_select(PREDICTORS)}
        from stats where scale = 'footprint'""",
    "q_local_stats": f"""select geom_id, scale, period_start, {_stats_select(PREDICTORS)}
        from stats where scale = 'local_60m'""",
    "q_availability": f"""select station_id, station, modis_pixel_id, period_text period_start,
        period_last period_end, nd number_days, {_r("ET_mm_period", "ET_mm_period")},
        {_r("ET_mm_day", "ET_mm_day")}, modis_good, modis_scf_qc, s2_dates_total, s2_dates,
        {_r("s2_union_coverage_pct", "s2_union_coverage_pct")}, s1_dates_total, s1_dates,
        s1_products_total, {_r("s1_union_coverage_pct", "s1_union_coverage_pct")}, s2_valid,
        s1_valid, valid_observation, target_support, millis "system:time_start" from avail""",
    "q_valid_obs": """select station_id, period_text period_start, period_last period_end,
        modis_good, s2_valid, s1_valid from avail where valid_observation = 1""",
    "q_two_scale_rows": """select station_id, period_text period_start, scale, predictor_support,
        case when scale = 'footprint' then geom_id else station_id end zone_id
        from avail cross join (values ('footprint', 'MODIS_footprint'), ('local_60m', '60m_x_60m'))
          z(scale, predictor_support)""",
    "q_missing_keys": f"""select geom_id, period_start, {_MISSING} statistics_missing,
        concat_ws(';', {", ".join(f"case when {c} is null then '{c}' end" for c in STATISTICS)})
          missing_keys,
        {", ".join(f"coalesce({_r(f'{b}_mean', '').rsplit(' as ', 1)[0]}, -9999e0) {b}_mean"
                   for b in PREDICTORS)}
        from stats where scale = 'footprint'""",
    "q_training_table": f"select {_output_select()} from rows",
    "q_export_select": f"select {_output_select()} from rows where stats_complete = 1",
    "q_training_resume": f"select {_output_select()} from rows where period_start >= '1998-01-01'",
    "q_output_summary": """select count(*) total_rows,
        count(*) filter (scale = 'footprint') footprint_rows,
        count(*) filter (scale = 'local_60m') local_60m_rows,
        count(*) filter (scale not in ('footprint', 'local_60m')) other_rows from rows""",
    "q_quarters": """select year(q)::integer "year", 'Q' || quarter(q) "quarter",
        greatest(cast(q as date), s) quarter_start,
        least(cast(q + interval 3 month as date), e) quarter_end
        from (select s, e, unnest(generate_series(date_trunc('quarter', s),
            date_trunc('quarter', e - 1), interval 3 month)) q
          from (select cast(min(o_orderdate) as date) s, cast(max(o_orderdate) as date) + 1 e
            from orders))""",
    "q_pending_partitions": f"""select station_id, year(q)::integer "year",
        'Q' || quarter(q) "quarter", greatest(cast(q as date), {START}) quarter_start,
        least(cast(q + interval 3 month as date), {END}) quarter_end
        from stations cross join generate_series(date_trunc('quarter', {START}),
          date_trunc('quarter', {END} - 1), interval 3 month) g(q)
        where station_key % 3 <> 0""",
}


def _uses(body: str, name: str) -> bool:
    import re

    return re.search(rf"\b(?:from|join|exists \(select 1 from)\s+\(*\s*{name}\b", body) is not None


def statement(name: str) -> str:
    """The query with just the CTEs it needs, in dependency order, each worked out once."""
    body = SELECTS[name]
    needed: list[str] = []

    def visit(text: str) -> None:
        for cte, definition in CTES.items():
            if cte not in needed and _uses(text, cte):
                visit(definition)
                needed.append(cte)

    visit(body)
    ctes = [f'"{cte}" as materialized ({CTES[cte]})' for cte in needed]
    inner = body.strip()
    if inner.startswith("with "):
        ctes.append(f'"answer" as materialized ({inner})')
        inner = "select * from answer"
    return f"with {', '.join(ctes)} {inner}" if ctes else inner


def statements() -> dict[str, str]:
    return {name: statement(name) for name in SELECTS}
