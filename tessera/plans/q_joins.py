"""Registered queries: key joins, source merging, set operations
(J1-J6, J15-J17, A16, U1, U2, U4, O2)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import joins as jn
from ..operators import setops as so
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources import grid_store as gs
from .oracle_views import with_views
from .registry import query


def r6(c):
    return F.round(c, 6)


@query("join_by_index", with_views("""
SELECT s.sample_id, round(s.lat, 6) AS lat, a.blue, a.green, a.days_offset
FROM v_sample s LEFT JOIN v_api a ON s.sample_id = a.sample_id""", "v_sample", "v_api"))
def join_by_index_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).select("sample_id", r6(F.col("lat")).alias("lat"))
    a = fx.api_optics(spark, sf_dir).select("sample_id", "blue", "green", "days_offset")
    return jn.join_by_index(s, a, "sample_id", "left")


THREE_KEY_RIGHT_SQL = """
SELECT s.lat, s.lon, s.sample_ts, avg(o.green) AS green, avg(o.nir) AS nir
FROM v_sample s JOIN v_official o ON s.sample_id = o.sample_id GROUP BY s.lat, s.lon, s.sample_ts"""


@query("join_3key_left", with_views("""
SELECT s.sample_id, a.green, round(r.green, 6) AS green_old, round(r.nir, 6) AS nir
FROM v_sample s JOIN v_api a ON s.sample_id = a.sample_id
LEFT JOIN r ON s.lat = r.lat AND s.lon = r.lon AND s.sample_ts = r.sample_ts""",
                                   "v_sample", "v_api", "v_official", extra=[("r", THREE_KEY_RIGHT_SQL)]))
def join_3key_left_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).select("sample_id", "lat", "lon", "sample_ts")
    left = s.join(fx.api_optics(spark, sf_dir).select("sample_id", "green"), "sample_id")
    keys = ["lat", "lon", "sample_ts"]
    right = (s.join(fx.official_optics(spark, sf_dir), "sample_id").groupBy(*keys)
             .agg(F.avg("green").alias("green"), F.avg("nir").alias("nir")))
    out = jn.join_keys_left(left, right, keys, suffix="_old")
    return out.select("sample_id", "green", r6(F.col("green_old")).alias("green_old"), r6(F.col("nir")).alias("nir"))


@query("join_inner", with_views("""
SELECT a.sample_id, a.green, o.green AS green_old, o.nir
FROM v_api a JOIN v_official o ON a.sample_id = o.sample_id""", "v_api", "v_official"))
def join_inner_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.api_optics(spark, sf_dir).select("sample_id", "green")
    o = fx.official_optics(spark, sf_dir).select("sample_id", F.col("green").alias("green_old"), "nir")
    return jn.join_by_index(a, o, "sample_id", "inner")


@query("concat_columns", with_views("""
SELECT coalesce(coalesce(s.sample_id, a.sample_id), o.sample_id) AS sample_id, round(s.ta, 6) AS ta, a.blue, o.nir
FROM (SELECT sample_id, ta FROM v_sample) s
FULL JOIN (SELECT sample_id, blue FROM v_api) a ON s.sample_id = a.sample_id
FULL JOIN (SELECT 2 * sample_id AS sample_id, nir FROM v_official) o
  ON coalesce(s.sample_id, a.sample_id) = o.sample_id""", "v_sample", "v_api", "v_official"))
def concat_columns_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).select("sample_id", r6(F.col("ta")).alias("ta"))
    a = fx.api_optics(spark, sf_dir).select("sample_id", "blue")
    # doubled ids: some meet, some don't, and no row of any table is left out
    o = fx.official_optics(spark, sf_dir).select((F.col("sample_id") * 2).alias("sample_id"), "nir")
    return jn.full_concat([s, a, o], "sample_id")


@query("align_to_spine", with_views("""
SELECT s.sample_id, a.days_offset, a.swir22
FROM v_sample s LEFT JOIN (SELECT 2 * sample_id AS sample_id, days_offset, swir22 FROM v_api) a ON s.sample_id = a.sample_id""",
                                    "v_sample", "v_api"))
def align_to_spine_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = fx.samples(spark, sf_dir).select("sample_id")
    sparse = fx.api_optics(spark, sf_dir).select(
        (F.col("sample_id") * 2).alias("sample_id"), "days_offset", "swir22")
    return jn.join_by_index(spine, sparse, "sample_id", "left")


def _sample_cells(spark, sf_dir) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    return s.select("sample_id", "sample_ts",
                    F.floor((F.col("lat") + 35.0) / 0.5).cast("int").alias("cell_i"),
                    F.floor((F.col("lon") - 15.0) / 0.5).cast("int").alias("cell_j"),
                    F.trunc("sample_ts", "month").alias("month"))


SAMPLE_CELLS_SQL = """
SELECT sample_id, sample_ts, CAST(floor((lat + 35.0) / 0.5) AS INT) AS cell_i,
       CAST(floor((lon - 15.0) / 0.5) AS INT) AS cell_j, CAST(date_trunc('month', sample_ts) AS DATE) AS month
FROM v_sample"""


@query("join_month_bucket", with_views("""
SELECT s.sample_id, s.cell_i, s.cell_j, strftime(s.month, '%Y-%m') AS month, c.ppt AS ppt_terra, c.pet AS pet_terra
FROM sc s LEFT JOIN v_climate c ON s.cell_i = c.cell_i AND s.cell_j = c.cell_j AND s.month = c.month""",
                                       "v_sample", "v_climate", extra=[("sc", SAMPLE_CELLS_SQL)]))
def join_month_bucket_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.climate(spark, sf_dir).select("cell_i", "cell_j", "month", "ppt", "pet")
    j = jn.month_bucket_join(_sample_cells(spark, sf_dir), g, ["cell_i", "cell_j", "month"])
    return j.select("sample_id", "cell_i", "cell_j", cal.month_key("month").alias("month"), "ppt_terra", "pet_terra")


@query("join_month_stored", with_views("""
SELECT s.sample_id, s.cell_i, s.cell_j, strftime(s.month, '%Y-%m') AS month, c.ppt AS ppt_terra, c.pet AS pet_terra
FROM sc s LEFT JOIN v_climate c ON s.cell_i = c.cell_i AND s.cell_j = c.cell_j AND s.month = c.month""",
                                       "v_sample", "v_climate", extra=[("sc", SAMPLE_CELLS_SQL)]))
def join_month_stored_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 against the grid as a table partitioned by month and tile: only the samples' partitions are read."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/grid-{uuid.uuid4().hex}"
    gs.write_grid(fx.climate(spark, sf_dir), path)
    cells = _sample_cells(spark, sf_dir)
    wanted = gs.wanted_partitions(cells, "month", F.lit(-35.0) + F.col("cell_i") * F.lit(0.5), F.lit(15.0) + F.col("cell_j") * F.lit(0.5))
    g = gs.crop_to(gs.read_grid(spark, path), wanted).select("cell_i", "cell_j", "month", "ppt", "pet")
    j = jn.month_bucket_join(cells, g, ["cell_i", "cell_j", "month"])
    return j.select("sample_id", "cell_i", "cell_j", cal.month_key("month").alias("month"), "ppt_terra", "pet_terra")


@query("alignment_check", with_views("""
SELECT count(a.sample_id) AS n_left, count(b.sample_id) AS n_right,
       count(*) FILTER (WHERE a.sample_id IS NOT NULL AND b.sample_id IS NOT NULL) AS n_matched,
       round(max(abs(a.lat - b.lat)), 6) AS max_dlat, round(max(abs(a.lon - b.lon)), 6) AS max_dlon,
       CAST(count(a.sample_id) = count(b.sample_id)
            AND count(*) FILTER (WHERE a.sample_id IS NOT NULL AND b.sample_id IS NOT NULL) = count(a.sample_id)
            AND coalesce(max(abs(a.lat - b.lat)), 0) <= 1e-4 AND coalesce(max(abs(a.lon - b.lon)), 0) <= 1e-4 AS INT)
         AS aligned
FROM v_sample a FULL JOIN (SELECT sample_id, round(lat, 4) AS lat, round(lon, 4) AS lon FROM v_sample) b
  ON a.sample_id = b.sample_id""", "v_sample"))
def alignment_check_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.samples(spark, sf_dir).select("sample_id", "lat", "lon")
    b = a.select("sample_id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))
    out = jn.alignment_check(a, b, "sample_id", ["lat", "lon"])
    return out.select("n_left", "n_right", "n_matched", r6(F.col("max_dlat")).alias("max_dlat"),
                      r6(F.col("max_dlon")).alias("max_dlon"), "aligned")


COALESCE_SQL = """
SELECT coalesce(a.sample_id, o.sample_id) AS sample_id, a.blue, a.red,
       CASE WHEN a.green IS NULL THEN o.green ELSE a.green END AS green,
       CASE WHEN a.green IS NULL THEN o.nir ELSE a.nir08 END AS nir08,
       CASE WHEN a.green IS NULL THEN o.swir16 ELSE a.swir16 END AS swir16,
       CASE WHEN a.green IS NULL THEN o.swir22 ELSE a.swir22 END AS swir22,
       (o.nir - o.swir16)/(o.nir + o.swir16 + 1e-10) AS NDMI,
       (o.green - o.swir16)/(o.green + o.swir16 + 1e-10) AS MNDWI,
       CASE WHEN a.green IS NOT NULL THEN 'api' WHEN o.green IS NOT NULL THEN 'official' ELSE 'none' END
         AS optical_source
FROM (SELECT sample_id, blue, green, red, nir08, swir16, swir22 FROM v_api) a
FULL JOIN v_official o ON a.sample_id = o.sample_id"""


def _merged_optics(spark, sf_dir) -> DataFrame:
    api = fx.api_optics(spark, sf_dir).drop("days_offset")
    return jn.coalesce_sources(api, fx.official_optics(spark, sf_dir))


@query("coalesce_sources", with_views("""
SELECT sample_id, blue, red, green, nir08, swir16, swir22, round(NDMI, 6) AS NDMI, round(MNDWI, 6) AS MNDWI,
       optical_source FROM m""", "v_api", "v_official", extra=[("m", COALESCE_SQL)]))
def coalesce_sources_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _merged_optics(spark, sf_dir)
    return m.withColumns({"NDMI": r6(F.col("NDMI")), "MNDWI": r6(F.col("MNDWI"))})


@query("coverage_by_source", with_views("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE optical_source = 'api') AS n_api,
       count(*) FILTER (WHERE optical_source = 'official') AS n_recovered, count(*) FILTER (WHERE optical_source = 'none') AS n_unrecoverable,
       round(count(*) FILTER (WHERE optical_source <> 'api') / count(*) * 100, 6) AS pct_api_missing,
       round(count(*) FILTER (WHERE optical_source = 'none') / count(*) * 100, 6) AS pct_unrecoverable
FROM m""", "v_api", "v_official", extra=[("m", COALESCE_SQL)]))
def coverage_by_source_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.coverage_by_source(_merged_optics(spark, sf_dir))


WEIGHTS = [i / 10 for i in range(11)]


@query("cross_scan", with_views("""
SELECT m.model AS variant, w.weight
FROM (SELECT DISTINCT model FROM v_pred) m,
     (SELECT CAST(i AS DOUBLE) / 10 AS weight FROM range(0, 11) t(i)) w""", "v_pred"))
def cross_scan_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = fx.predictions(spark, sf_dir).select(F.col("model").alias("variant")).distinct()
    return jn.weight_grid(variants, WEIGHTS)


@query("union_rows", with_views("""
SELECT sample_id, green, 'api' AS source FROM v_api
UNION ALL SELECT sample_id, green, 'official' AS source FROM v_official""", "v_api", "v_official"))
def union_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.api_optics(spark, sf_dir).select("sample_id", "green", F.lit("api").alias("source"))
    o = fx.official_optics(spark, sf_dir).select("sample_id", "green", F.lit("official").alias("source"))
    return so.union_rows([a, o])


@query("union_distinct", with_views("""
SELECT strftime(date_trunc('month', sample_ts), '%Y-%m') AS month FROM v_sample
UNION SELECT strftime(month, '%Y-%m') AS month FROM v_climate""", "v_sample", "v_climate"))
def union_distinct_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.samples(spark, sf_dir).select(cal.month_key("sample_ts").alias("month"))
    b = fx.climate(spark, sf_dir).select(cal.month_key("month").alias("month"))
    return so.union_distinct(a, b)


@query("frames_equal", with_views("""
SELECT l.model AS left_model, r.model AS right_model,
       (SELECT count(*) FROM (SELECT sample_id, pred FROM v_pred WHERE model = l.model
                              EXCEPT ALL SELECT sample_id, pred FROM v_pred WHERE model = r.model)) AS n_only_left,
       (SELECT count(*) FROM (SELECT sample_id, pred FROM v_pred WHERE model = r.model
                              EXCEPT ALL SELECT sample_id, pred FROM v_pred WHERE model = l.model)) AS n_only_right,
       (SELECT round(max(abs(a.pred - b.pred)), 6) FROM v_pred a JOIN v_pred b ON a.sample_id = b.sample_id
         WHERE a.model = l.model AND b.model = r.model) AS max_abs_diff
FROM (VALUES ('m1', 'm1'), ('m1', 'm2'), ('m2', 'm3')) AS pairs(lm, rm)
JOIN (SELECT DISTINCT model FROM v_pred) l ON l.model = pairs.lm
JOIN (SELECT DISTINCT model FROM v_pred) r ON r.model = pairs.rm""", "v_pred"))
def frames_equal_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.predictions(spark, sf_dir)

    def frame(m):
        return p.where(F.col("model") == m).select("sample_id", "pred")

    rows = []
    for lm, rm in (("m1", "m1"), ("m1", "m2"), ("m2", "m3")):
        r = so.frames_equal(frame(lm), frame(rm), "sample_id", "pred")
        rows.append(r.select(F.lit(lm).alias("left_model"), F.lit(rm).alias("right_model"), "n_only_left",
                             "n_only_right", r6(F.col("max_abs_diff")).alias("max_abs_diff")))
    return so.union_rows(rows)


@query("distinct_months", with_views("""
SELECT DISTINCT strftime(sample_ts, '%Y-%m') AS month FROM v_sample""", "v_sample"))
def distinct_months_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.distinct_sorted(fx.samples(spark, sf_dir).select(cal.month_key("sample_ts").alias("month")), "month")


# ------------------------------------------------------------------ lifecycle B: the merged wide table
@query("merge_sources", with_views("""
SELECT s.sample_id, s.site_id, strftime(s.sample_ts, '%Y-%m-%d') AS sample_day, round(s.lat, 6) AS lat,
       round(s.lon, 6) AS lon, round(s.ta, 6) AS ta, s.ec, s.drp,
       a.blue, a.red,
       CASE WHEN a.green IS NULL THEN o.green ELSE a.green END AS green,
       CASE WHEN a.green IS NULL THEN o.nir ELSE a.nir08 END AS nir08,
       CASE WHEN a.green IS NULL THEN o.swir16 ELSE a.swir16 END AS swir16,
       CASE WHEN a.green IS NULL THEN o.swir22 ELSE a.swir22 END AS swir22,
       round((o.nir - o.swir16)/(o.nir + o.swir16 + 1e-10), 6) AS NDMI,
       round((o.green - o.swir16)/(o.green + o.swir16 + 1e-10), 6) AS MNDWI,
       CASE WHEN a.green IS NOT NULL THEN 'api' WHEN o.green IS NOT NULL THEN 'official' ELSE 'none' END
         AS optical_source,
       a.days_offset, o.nir, c.ppt, c.pet, c.tmax, c.tmin, c.q
FROM v_sample s LEFT JOIN v_api a ON s.sample_id = a.sample_id
LEFT JOIN v_official o ON s.sample_id = o.sample_id
LEFT JOIN v_climate c ON CAST(floor((s.lat + 35.0) / 0.5) AS INT) = c.cell_i
                     AND CAST(floor((s.lon - 15.0) / 0.5) AS INT) = c.cell_j
                     AND CAST(date_trunc('month', s.sample_ts) AS DATE) = c.month""",
                                   "v_sample", "v_api", "v_official", "v_climate"))
def merge_sources_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle B: samples ⋈ coalesced optics ⋈ climate by grid cell and month."""
    from ..models.features import merged_table

    m = merged_table(spark, sf_dir)
    return m.select("sample_id", "site_id", cal.iso_day("sample_ts").alias("sample_day"),
                    r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), r6(F.col("ta")).alias("ta"),
                    "ec", "drp", "blue", "red", "green", "nir08", "swir16", "swir22",
                    r6(F.col("NDMI")).alias("NDMI"), r6(F.col("MNDWI")).alias("MNDWI"), "optical_source",
                    "days_offset", "nir", "ppt", "pet", "tmax", "tmin", "q")


FEATURE_SQL = """
SELECT sample_id,
  round((nir08-red)/(nir08+red+1e-8), 6) AS NDVI, round((green-nir08)/(green+nir08+1e-8), 6) AS NDWI,
  round((red-green)/(red+green+1e-8), 6) AS NDTI,
  round((nir08-red)/(blue+green+1e-8), 6) AS SABI, round((green+red)/(nir08+swir16+1e-8), 6) AS WRI,
  round(red/(blue+1e-8), 6) AS turbidity_ratio, round(green/(red+1e-8), 6) AS green_red_ratio,
  round(nir08/(swir16+1e-8), 6) AS nir_swir_ratio, round(swir16/(swir22+1e-8), 6) AS swir_ratio,
  round(ppt/(pet+1e-8), 6) AS ppt_pet_ratio, round(tmax-tmin, 6) AS temp_range, round(q/(ppt+1e-8), 6) AS runoff_ratio,
  round(pet/(ppt+1e-8), 6) AS hydro_stress, round((tmax-tmin)*q, 6) AS thermal_runoff,
  round(sin(month(sample_ts) * 0.5235987755982988), 6) AS month_sin,
  round(cos(month(sample_ts) * 0.5235987755982988), 6) AS month_cos, CAST(quarter(sample_ts) AS INTEGER) AS quarter,
  f AS days_offset_filled, CAST(days_offset IS NULL AS INT) AS days_offset_missing,
  c AS api_optical_complete, o AS old_optical_available,
  CAST(c = 1 AND days_offset IS NOT NULL AND days_offset <= 10 AS INT) AS api_preferred,
  round((CASE WHEN c = 1 THEN 1.0 WHEN o = 1 THEN 0.92 ELSE 0.85 END) * (1.0 - f/61.0*0.18)
        * CASE WHEN ppt IS NOT NULL THEN 1.0 ELSE 0.95 END, 6) AS sample_weight,
  CAST(round_even(lat, 1) + 0.0 AS VARCHAR) || '_' || CAST(round_even(lon, 1) + 0.0 AS VARCHAR) AS spatial_group
FROM (SELECT m.*,
        CAST(blue IS NOT NULL AND green IS NOT NULL AND red IS NOT NULL AND nir08 IS NOT NULL
             AND swir16 IS NOT NULL AND swir22 IS NOT NULL AS INT) AS c,
        CAST(nir IS NOT NULL AND green_old IS NOT NULL AND swir16_old IS NOT NULL AND swir22_old IS NOT NULL AS INT) AS o,
        least(greatest(coalesce(days_offset, 61.0), 0.0), 61.0) AS f
      FROM m) x"""

MERGED_SQL_CTE = """
SELECT s.*, a.blue, a.red,
       CASE WHEN a.green IS NULL THEN o.green ELSE a.green END AS green,
       CASE WHEN a.green IS NULL THEN o.nir ELSE a.nir08 END AS nir08,
       CASE WHEN a.green IS NULL THEN o.swir16 ELSE a.swir16 END AS swir16,
       CASE WHEN a.green IS NULL THEN o.swir22 ELSE a.swir22 END AS swir22,
       a.days_offset, o.nir, o.green AS green_old, o.swir16 AS swir16_old, o.swir22 AS swir22_old,
       c.ppt, c.pet, c.tmax, c.tmin, c.q
FROM v_sample s LEFT JOIN v_api a ON s.sample_id = a.sample_id
LEFT JOIN v_official o ON s.sample_id = o.sample_id
LEFT JOIN v_climate c ON CAST(floor((s.lat + 35.0) / 0.5) AS INT) = c.cell_i
                     AND CAST(floor((s.lon - 15.0) / 0.5) AS INT) = c.cell_j
                     AND CAST(date_trunc('month', s.sample_ts) AS DATE) = c.month"""

ENGINEERED = ["NDVI", "NDWI", "NDTI", "SABI", "WRI", "turbidity_ratio", "green_red_ratio", "nir_swir_ratio",
              "swir_ratio", "ppt_pet_ratio", "temp_range", "runoff_ratio", "hydro_stress", "thermal_runoff",
              "month_sin", "month_cos", "sample_weight"]


@query("feature_table", with_views(FEATURE_SQL, "v_sample", "v_api", "v_official", "v_climate",
                                   extra=[("m", MERGED_SQL_CTE)]))
def feature_table_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle A's feature step: F1-F12 on the merged table."""
    from ..models.features import training_table

    t = training_table(spark, sf_dir)
    return t.select("sample_id", *[r6(F.col(c)).alias(c) for c in ENGINEERED], "quarter", "days_offset_filled",
                    "days_offset_missing", "api_optical_complete", "old_optical_available", "api_preferred",
                    "spatial_group")
