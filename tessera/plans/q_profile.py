"""Registered queries: profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..models import folds as fo
from ..operators import profile as pf
from ..sources import fixtures as fx
from .oracle_views import with_views
from .q_joins import SAMPLE_CELLS_SQL, _sample_cells
from .registry import query


def r6(c):
    return F.round(c, 6)


MERGED_COLS = ["blue", "green", "red", "nir08", "swir16", "swir22", "days_offset", "nir"]
MERGED_SQL = "SELECT a.*, o.nir FROM v_api a JOIN v_official o ON a.sample_id = o.sample_id"


def _merged(spark, sf_dir) -> DataFrame:
    return fx.api_optics(spark, sf_dir).join(fx.official_optics(spark, sf_dir).select("sample_id", "nir"), "sample_id")


@query("missing_report", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 6) AS pct_missing FROM m" for c in MERGED_COLS),
    "v_api", "v_official", extra=[("m", MERGED_SQL)]))
def missing_report_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.missing_report(_merged(spark, sf_dir), MERGED_COLS)


DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem" for c in DESCRIBE_COLS))
def describe_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pf.describe(fx.table(spark, sf_dir, "lineitem"), DESCRIBE_COLS)
    return d.select("column", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


CORR_COLS = ["blue", "green", "red", "nir08", "swir22", "days_offset", "ta"]


@query("corr_matrix", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM m"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]),
    "v_api", "v_sample", extra=[("m", "SELECT a.*, s.ta FROM v_api a JOIN v_sample s ON a.sample_id = s.sample_id")]))
def corr_matrix_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.api_optics(spark, sf_dir).join(fx.samples(spark, sf_dir).select("sample_id", "ta"), "sample_id")
    c = pf.corr_matrix(m, CORR_COLS)
    return c.select("col_a", "col_b", r6(F.col("corr")).alias("corr"))


@query("distinct_sites", with_views("""
SELECT count(DISTINCT (lat, lon)) AS n_sites, count(DISTINCT site_id) AS n_site_ids FROM v_sample""", "v_sample"))
def distinct_sites_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    return s.agg(pf.distinct_count(s, ["lat", "lon"]).alias("n_sites"),
                 pf.distinct_count(s, ["site_id"]).alias("n_site_ids"))


@query("date_range", with_views("""
SELECT strftime(min(sample_ts), '%Y-%m-%d') AS first_day, strftime(max(sample_ts), '%Y-%m-%d') AS last_day,
       count(*) AS n_rows FROM v_sample""", "v_sample"))
def date_range_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    return s.agg(cal.iso_day(F.min("sample_ts")).alias("first_day"), cal.iso_day(F.max("sample_ts")).alias("last_day"),
                 F.count(F.lit(1)).alias("n_rows"))


@query("quantile_clip", with_views("""
SELECT sample_id, round(CASE WHEN ta IS NOT NULL THEN least(greatest(ta, q.lo), q.hi) END, 6) AS ta_clipped
FROM v_sample, (SELECT quantile_cont(ta, 0.01) AS lo, quantile_cont(ta, 0.99) AS hi FROM v_sample) q""", "v_sample"))
def quantile_clip_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).select("sample_id", "ta")
    c = pf.quantile_clip(s, "ta", 0.01, 0.99, out="ta_clipped")
    return c.select("sample_id", r6(F.col("ta_clipped")).alias("ta_clipped"))


IMPUTE_COLS = ["blue", "swir22", "days_offset"]


@query("median_impute", with_views("""
SELECT a.sample_id, coalesce(a.blue, m.blue) AS blue, coalesce(a.swir22, m.swir22) AS swir22,
       coalesce(a.days_offset, m.days_offset) AS days_offset
FROM v_api a, (SELECT median(blue) AS blue, median(swir22) AS swir22, median(days_offset) AS days_offset FROM v_api) m""",
                                   "v_api"))
def median_impute_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.api_optics(spark, sf_dir).select("sample_id", *IMPUTE_COLS)
    return pf.median_impute(a, IMPUTE_COLS)


FOLDS = range(5)


@query("fold_median_impute", with_views("""
SELECT t.sample_id, t.fold, coalesce(t.blue, m.blue) AS blue, coalesce(t.swir22, m.swir22) AS swir22
FROM t JOIN (SELECT f.fold AS held, median(t.blue) AS blue, median(t.swir22) AS swir22
             FROM t JOIN (SELECT DISTINCT fold FROM t) f ON t.fold <> f.fold GROUP BY f.fold) m
  ON t.fold = m.held""", "v_api", extra=[("t", f"""
SELECT a.sample_id, CAST({fo.int_hash_sql('a.sample_id', 7)} % 5 AS INT) AS fold, a.blue, a.swir22
FROM v_api a""")]))
def fold_median_impute_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.api_optics(spark, sf_dir).select("sample_id", "blue", "swir22")
    t = fo.random_kfold(a, "sample_id", 5, 7)
    return pf.fold_median_impute(t, ["blue", "swir22"], "fold", FOLDS).select("sample_id", "fold", "blue", "swir22")


def _hist_sql(col: str, label: str, bins: int, log: bool) -> str:
    x = f"ln(1 + {col})" if log else col
    return f"""
SELECT '{label}' AS variable, b.bin, round(mm.lo + b.bin * ((mm.hi - mm.lo) / {bins}), 6) AS lo,
       round(mm.lo + (b.bin + 1) * ((mm.hi - mm.lo) / {bins}), 6) AS hi, coalesce(c.count, 0) AS count,
       mm.n, round(mm.mean, 6) AS mean, round(mm.median, 6) AS median, round(mm.std, 6) AS std, round(mm.lo, 6) AS min,
       round(mm.hi, 6) AS max
FROM (SELECT CAST(i AS INT) AS bin FROM range(0, {bins}) t(i)) b
CROSS JOIN (SELECT min({x}) AS lo, max({x}) AS hi, count({x}) AS n, avg({x}) AS mean, median({x}) AS median,
                   stddev_samp({x}) AS std FROM v_sample) mm
LEFT JOIN (SELECT CAST(least(floor(({x} - mm2.lo) / ((mm2.hi - mm2.lo) / {bins})), {bins - 1}) AS INT) AS bin,
                  count(*) AS count
           FROM v_sample, (SELECT min({x}) AS lo, max({x}) AS hi FROM v_sample) mm2 GROUP BY 1) c ON b.bin = c.bin"""


@query("histogram", with_views(_hist_sql("ta", "ta", 60, False) + " UNION ALL " + _hist_sql("drp", "drp_log1p", 50, True),
                               "v_sample"))
def histogram_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    h = pf.histogram(s, "ta", 60).unionByName(pf.histogram(s, "drp", 50, log=True, label="drp_log1p"))
    return h.select("variable", "bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "count", "n",
                    *[r6(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max")])


def _box_sql(col: str) -> str:
    return f"""
SELECT '{col}' AS variable, round(q.q1, 6) AS q1, round(q.q2, 6) AS median, round(q.q3, 6) AS q3,
       round(q.q3 - q.q1, 6) AS iqr,
       round(min(CASE WHEN {col} >= q.q1 - 1.5 * (q.q3 - q.q1) THEN {col} END), 6) AS whisker_low,
       round(max(CASE WHEN {col} <= q.q3 + 1.5 * (q.q3 - q.q1) THEN {col} END), 6) AS whisker_high,
       count(*) FILTER (WHERE {col} < q.q1 - 1.5 * (q.q3 - q.q1) OR {col} > q.q3 + 1.5 * (q.q3 - q.q1)) AS n_outliers
FROM v_sample, (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS q2,
                       quantile_cont({col}, 0.75) AS q3 FROM v_sample) q
GROUP BY q.q1, q.q2, q.q3"""


BOX_COLS = ["ta", "ec", "drp"]


@query("box_stats", with_views(" UNION ALL ".join(_box_sql(c) for c in BOX_COLS), "v_sample"))
def box_stats_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    out = None
    for c in BOX_COLS:
        b = pf.box_stats(s, c)
        out = b if out is None else out.unionByName(b)
    return out.select("variable", *[r6(F.col(c)).alias(c) for c in
                                    ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high")], "n_outliers")


@query("area_mean_series", with_views("""
SELECT strftime(month, '%Y-%m') AS month, round(avg(ppt), 8) AS ppt, round(avg(tmax), 8) AS tmax, count(*) AS n_cells
FROM v_climate GROUP BY month""", "v_climate"))
def area_mean_series_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.climate(spark, sf_dir)
    # inputs carry 6 decimals, so a mean over n cells can end exactly on a
    # 7th-decimal tie; 8 places keeps both engines off the tie
    a = pf.area_mean_series(g, "month", ["ppt", "tmax"])
    return a.select(cal.month_key("month").alias("month"), F.round("ppt", 8).alias("ppt"),
                    F.round("tmax", 8).alias("tmax"), "n_cells")


@query("extract_coverage", with_views(f"""
SELECT CASE WHEN {fo.int_hash_sql('s.sample_id', 42)} % 100 < 70 THEN 'train' ELSE 'validation' END AS dataset,
       count(*) AS n_rows, count(*) FILTER (WHERE c.ppt IS NOT NULL AND c.pet IS NOT NULL) AS n_complete,
       min(c.ppt) AS ppt_min, max(c.ppt) AS ppt_max, count(*) FILTER (WHERE c.ppt IS NULL) AS ppt_missing,
       min(c.pet) AS pet_min, max(c.pet) AS pet_max, count(*) FILTER (WHERE c.pet IS NULL) AS pet_missing
FROM sc JOIN v_sample s ON sc.sample_id = s.sample_id
LEFT JOIN v_climate c ON sc.cell_i = c.cell_i AND sc.cell_j = c.cell_j AND sc.month = c.month
GROUP BY 1""", "v_sample", "v_climate", extra=[("sc", SAMPLE_CELLS_SQL)]))
def extract_coverage_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _sample_cells(spark, sf_dir)
    site = fx.samples(spark, sf_dir).select("sample_id", "site_id")
    g = fx.climate(spark, sf_dir).select("cell_i", "cell_j", "month", "ppt", "pet")
    d = (cells.join(site, "sample_id").join(g, ["cell_i", "cell_j", "month"], "left")
         .withColumn("dataset", F.when(F.pmod(fo.int_hash("sample_id", 42), F.lit(100)) < 70, F.lit("train"))
                     .otherwise(F.lit("validation"))))
    return pf.extract_coverage(d, "dataset", ["ppt", "pet"])
