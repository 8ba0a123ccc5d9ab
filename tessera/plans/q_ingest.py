"""Registered queries: scans, projections, filters and scalar functions
(S1, S3, S5, S8, S9, P1, P3-P5, P7-P13, F1-F21, U3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions import quality as qf
from ..functions import spectral as sp
from ..operators import projections as pj
from ..operators.spatiotemporal import footprint_join, window_join
from ..sources import fixtures as fx
from ..sources.incremental import pending, pending_multiset
from ..sources.tables import export_template, read_table
from .oracle_views import day_offset_sql, with_views
from .registry import query

R6 = 6


def r6(c):
    return F.round(c, R6)


# ------------------------------------------------------------------ S1
ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderdate", T.TimestampNTZType()),
])


@query("scan_tables", with_views("""
SELECT o_orderkey AS sample_id, o_custkey AS site_id, strftime(o_orderdate, '%d-%m-%Y') AS sample_date,
       round(-35.18 + (o_custkey*37 % 1346)/CAST(100 AS DOUBLE), 6) AS lat,
       round(14.97 + (o_custkey*101 % 1782)/CAST(100 AS DOUBLE), 6) AS lon,
       round(o_totalprice/1000, 6) AS ta
FROM orders"""))
def scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read with a declared schema (only the declared columns are scanned)."""
    o = read_table(spark, f"{sf_dir}/orders.parquet", ORDERS_SCHEMA)
    c = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("sample_id"), c.alias("site_id"),
        cal.format_dayfirst("o_orderdate").alias("sample_date"),
        r6(F.lit(-35.18) + (c * 37 % 1346) / F.lit(100.0)).alias("lat"),
        r6(F.lit(14.97) + (c * 101 % 1782) / F.lit(100.0)).alias("lon"),
        r6(F.col("o_totalprice") / 1000).alias("ta"))


# ------------------------------------------------------------------ S3 / U3
@query("incremental_extract", with_views("""
SELECT s.sample_id, s.site_id FROM v_sample s
WHERE NOT EXISTS (SELECT 1 FROM v_api a WHERE a.sample_id = s.sample_id AND a.days_offset IS NOT NULL)""",
                                         "v_sample", "v_api"))
def incremental_extract_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = fx.samples(spark, sf_dir).select("sample_id", "site_id")
    done = fx.api_optics(spark, sf_dir).where(F.col("days_offset").isNotNull())
    return pending(todo, done, "sample_id")


@query("except_processed", with_views("""
SELECT sample_id FROM v_sample EXCEPT ALL SELECT sample_id FROM v_api WHERE days_offset IS NOT NULL""",
                                      "v_sample", "v_api"))
def except_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fx.api_optics(spark, sf_dir).where(F.col("days_offset").isNotNull())
    return pending_multiset(fx.samples(spark, sf_dir), done, "sample_id")


# ------------------------------------------------------------------ S5
@query("export_template", with_views("""
SELECT s.sample_id, round(s.lat, 6) AS latitude, round(s.lon, 6) AS longitude,
       strftime(s.sample_ts, '%d-%m-%Y') AS sample_date,
       p.total_alkalinity, p.electrical_conductance, p.dissolved_reactive_phosphorus
FROM v_sample s LEFT JOIN (SELECT sample_id, round(avg(ta), 6) AS total_alkalinity, round(avg(ec), 6) AS electrical_conductance,
                                  round(avg(drp), 6) AS dissolved_reactive_phosphorus
                           FROM v_sub GROUP BY sample_id) p ON s.sample_id = p.sample_id""",
                                     "v_sample", "v_sub"))
def export_template_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    tpl = s.select("sample_id", r6(F.col("lat")).alias("latitude"), r6(F.col("lon")).alias("longitude"),
                   cal.format_dayfirst("sample_ts").alias("sample_date"))
    # the mean of the runs' predictions, for each target
    preds = fx.submissions(spark, sf_dir).groupBy("sample_id").agg(
        r6(F.avg("ta")).alias("total_alkalinity"), r6(F.avg("ec")).alias("electrical_conductance"),
        r6(F.avg("drp")).alias("dissolved_reactive_phosphorus"))
    return export_template(tpl, preds, "sample_id",
                           ["sample_id", "latitude", "longitude", "sample_date", "total_alkalinity",
                            "electrical_conductance", "dissolved_reactive_phosphorus"])


# ------------------------------------------------------------------ S8
SITE_SEARCH_SQL = with_views(f"""
SELECT s.sample_id, strftime(c.scene_ts, '%Y-%m-%d') AS scene_day, c.cloud_cover, c.platform,
       {day_offset_sql('c.scene_ts', 's.sample_ts')} AS days_offset
FROM v_sample s JOIN v_scenecat c
  ON s.site_id = c.site_id AND c.scene_ts BETWEEN s.sample_ts - INTERVAL 30 DAY AND s.sample_ts + INTERVAL 30 DAY
WHERE c.cloud_cover < 10 AND c.platform IN ('landsat-8', 'landsat-9')""", "v_sample", "v_scenecat")


@query("site_scene_search", SITE_SEARCH_SQL)
def site_scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 where scenes are known by site: filter (cloud, platform) pushed below a
    site + time-window range join."""
    cat = fx.scenes(spark, sf_dir).where((F.col("cloud_cover") < 10)
                                         & F.col("platform").isin("landsat-8", "landsat-9"))
    s = fx.samples(spark, sf_dir).select("sample_id", "site_id", "sample_ts")
    j = window_join(s, cat, key="site_id", left_ts="sample_ts", right_ts="scene_ts", days=30)
    return j.select("sample_id", cal.iso_day("scene_ts").alias("scene_day"), "cloud_cover", "platform",
                    "days_offset")


SEARCH_BOX, SEARCH_DAYS = 0.1, 30

SCENE_SEARCH_SQL = with_views(f"""
SELECT s.sample_id, c.site_id AS scene_site, strftime(c.scene_ts, '%Y-%m-%d') AS scene_day, c.cloud_cover, c.platform,
       {day_offset_sql('c.scene_ts', 's.sample_ts')} AS days_offset
FROM v_sample s JOIN v_footprint c
  ON c.scene_ts BETWEEN s.sample_ts - INTERVAL {SEARCH_DAYS} DAY AND s.sample_ts + INTERVAL {SEARCH_DAYS} DAY
WHERE c.cloud_cover < 10 AND c.platform IN ('landsat-8', 'landsat-9')
  AND c.south <= s.lat + {SEARCH_BOX / 2} AND c.north >= s.lat - {SEARCH_BOX / 2} AND c.west <= s.lon + {SEARCH_BOX / 2} AND c.east >= s.lon - {SEARCH_BOX / 2}""",
                              "v_sample", "v_footprint")


@query("scene_search", SCENE_SEARCH_SQL)
def scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue search by extent: scenes that overlap the box around a sample within the window, after the
    filter (cloud, platform)."""
    cat = fx.footprints(spark, sf_dir).where((F.col("cloud_cover") < 10) & F.col("platform").isin("landsat-8", "landsat-9"))
    cat = cat.withColumnRenamed("site_id", "scene_site").withColumn("scene_day", cal.iso_day("scene_ts"))
    s = fx.samples(spark, sf_dir).select("sample_id", "lat", "lon", "sample_ts")
    j = footprint_join(s, cat, lat="lat", lon="lon", sample_ts="sample_ts", scene_ts="scene_ts", size=SEARCH_BOX, days=SEARCH_DAYS)
    return j.select("sample_id", "scene_site", "scene_day", "cloud_cover", "platform", "days_offset")


# ------------------------------------------------------------------ S9
@query("grid_crop", with_views("""
SELECT cell_i, cell_j, strftime(month, '%Y-%m') AS month, ppt, pet FROM v_climate
WHERE lat BETWEEN -34.0 AND -30.0 AND lon BETWEEN 20.0 AND 25.0
  AND month BETWEEN DATE '1996-01-01' AND DATE '1997-12-01'""", "v_climate"))
def grid_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop the grid to a box and a period, only the wanted variables."""
    g = fx.climate(spark, sf_dir, months=("1996-01-01", "1997-12-01"))
    return (g.where(F.col("lat").between(-34.0, -30.0) & F.col("lon").between(20.0, 25.0)
                    & F.col("month").between(F.lit("1996-01-01").cast("date"), F.lit("1997-12-01").cast("date")))
            .select("cell_i", "cell_j", cal.month_key("month").alias("month"), "ppt", "pet"))


# ------------------------------------------------------------------ P1
@query("rename_map", with_views("""
SELECT sample_id, nir AS nir08, green, swir16, swir22 FROM v_official""", "v_official"))
def rename_map_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.rename_map(fx.official_optics(spark, sf_dir), {"nir": "nir08", "pr": "ppt", "ro": "q"})


# ------------------------------------------------------------------ P3
def _text_numbers(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("sample_id"), (
        F.when(k % 10 == 0, F.col("o_orderpriority"))
        .when(k % 10 == 1, F.lit(""))
        .when(k % 10 == 2, F.concat(F.lit("-"), F.col("o_custkey").cast("string"), F.lit(".5")))
        .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".25")))).alias("raw"))


TEXT_NUMBERS_SQL = """
SELECT o_orderkey AS sample_id,
       CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority WHEN o_orderkey % 10 = 1 THEN ''
            WHEN o_orderkey % 10 = 2 THEN '-' || CAST(o_custkey AS VARCHAR) || '.5'
            ELSE CAST(o_custkey AS VARCHAR) || '.25' END AS raw
FROM orders"""


@query("coerce_numeric", with_views("SELECT sample_id, raw, TRY_CAST(raw AS DOUBLE) AS value FROM t",
                                    extra=[("t", TEXT_NUMBERS_SQL)]))
def coerce_numeric_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _text_numbers(spark, sf_dir)
    return t.withColumn("value", qf.coerce_numeric("raw"))


# ------------------------------------------------------------------ P4 / P5
DATE_TEXT_SQL = """
SELECT o_orderkey AS sample_id,
       CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d-%m-%Y')
            WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN o_orderkey % 4 = 2 THEN '31-02-' || CAST(year(o_orderdate) AS VARCHAR)
            ELSE 'n/a' END AS raw
FROM orders"""


@query("parse_dayfirst", with_views("""
SELECT sample_id, raw, strftime(coalesce(try_strptime(raw, '%d-%m-%Y'), try_strptime(raw, '%Y-%m-%d')), '%Y-%m-%d') AS parsed
FROM t""", extra=[("t", DATE_TEXT_SQL)]))
def parse_dayfirst_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    t = o.select(k.alias("sample_id"), (
        F.when(k % 4 == 0, cal.format_dayfirst(d)).when(k % 4 == 1, cal.iso_day(d))
        .when(k % 4 == 2, F.concat(F.lit("31-02-"), F.year(d).cast("string")))
        .otherwise(F.lit("n/a"))).alias("raw"))
    return t.withColumn("parsed", cal.iso_day(cal.parse_dayfirst("raw")))


@query("format_date", with_views("""
SELECT sample_id, strftime(sample_ts, '%d-%m-%Y') AS sample_date, strftime(sample_ts, '%Y-%m') AS month_key
FROM v_sample""", "v_sample"))
def format_date_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    return s.select("sample_id", cal.format_dayfirst("sample_ts").alias("sample_date"),
                    cal.month_key("sample_ts").alias("month_key"))


# ------------------------------------------------------------------ P7 / P8
FEATURES_WANTED = ["blue", "green", "nir08", "NDMI", "swir22", "days_offset"]
NO_QUALITY = ["days_offset"]


@query("feature_select", with_views("SELECT sample_id, blue, green, nir08, swir22 FROM v_api", "v_api"))
def feature_select_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.api_optics(spark, sf_dir)
    return a.select("sample_id", *pj.feature_select(a, FEATURES_WANTED, exclude=NO_QUALITY))


@query("align_columns", with_views("""
SELECT sample_id, nir08, green, blue, CAST(0 AS DOUBLE) AS NDVI, red FROM v_api""", "v_api"))
def align_columns_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.align_columns(fx.api_optics(spark, sf_dir), ["sample_id", "nir08", "green", "blue", "NDVI", "red"])


# ------------------------------------------------------------------ P9-P13
BANDS6 = ["blue", "green", "red", "nir08", "swir16", "swir22"]


@query("filter_complete", with_views("""
SELECT sample_id, blue, green, red, nir08, swir16, swir22 FROM v_api
WHERE blue IS NOT NULL AND green IS NOT NULL AND red IS NOT NULL AND nir08 IS NOT NULL
  AND swir16 IS NOT NULL AND swir22 IS NOT NULL""", "v_api"))
def filter_complete_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.filter_complete(fx.api_optics(spark, sf_dir), BANDS6).select("sample_id", *BANDS6)


@query("head_n", with_views("""
SELECT sample_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_sample ORDER BY sample_id LIMIT 20""",
                            "v_sample"))
def head_n_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).select("sample_id", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))
    return pj.head_n(s, 20, ["sample_id"])


@query("drop_empty_records", with_views("""
SELECT * FROM v_api WHERE coalesce(blue, green, red, nir08, swir16, swir22, days_offset) IS NOT NULL""", "v_api"))
def drop_empty_records_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.drop_empty_records(fx.api_optics(spark, sf_dir), BANDS6 + ["days_offset"])


OFFICIAL_OLD = {"nir": "nir_old", "green": "green_old", "swir16": "swir16_old", "swir22": "swir22_old"}


@query("complete_cases", with_views("""
SELECT a.*, o.nir AS nir_old, o.green AS green_old, o.swir16 AS swir16_old, o.swir22 AS swir22_old
FROM v_api a JOIN v_official o ON a.sample_id = o.sample_id
WHERE a.blue IS NOT NULL AND a.green IS NOT NULL AND a.red IS NOT NULL AND a.nir08 IS NOT NULL
  AND a.swir16 IS NOT NULL AND a.swir22 IS NOT NULL AND a.days_offset IS NOT NULL
  AND o.nir IS NOT NULL AND o.green IS NOT NULL AND o.swir16 IS NOT NULL AND o.swir22 IS NOT NULL""",
                                    "v_api", "v_official"))
def complete_cases_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = fx.api_optics(spark, sf_dir).join(
        pj.rename_map(fx.official_optics(spark, sf_dir), OFFICIAL_OLD), "sample_id", "inner")
    return pj.complete_cases(j)


BOX = pj.bbox(-30.0, 22.0, 2.0)
OPEN_BOX = (14.97, -35.18, 15.5, -35.0)


@query("bbox_filter", with_views("""
SELECT sample_id, round(lat, 6) AS lat, round(lon, 6) AS lon,
       CAST(lat BETWEEN -31.0 AND -29.0 AND lon BETWEEN 21.0 AND 23.0 AS INT) AS in_closed_box
FROM v_sample
WHERE (lat BETWEEN -31.0 AND -29.0 AND lon BETWEEN 21.0 AND 23.0)
   OR (lat > -35.18 AND lat < -35.0 AND lon > 14.97 AND lon < 15.5)""", "v_sample"))
def bbox_filter_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    closed = pj.in_bbox("lat", "lon", BOX, closed=True)
    opened = pj.in_bbox("lat", "lon", OPEN_BOX, closed=False)
    return s.where(closed | opened).select("sample_id", r6(F.col("lat")).alias("lat"),
                                           r6(F.col("lon")).alias("lon"),
                                           closed.cast("int").alias("in_closed_box"))


# ------------------------------------------------------------------ F1-F4
@query("norm_diff", with_views("""
SELECT sample_id,
       round((nir08-red)/(nir08+red+1e-8), 6) AS NDVI, round((green-nir08)/(green+nir08+1e-8), 6) AS NDWI,
       round((green-swir16)/(green+swir16+1e-8), 6) AS MNDWI, round((red-green)/(red+green+1e-8), 6) AS NDTI
FROM v_api""", "v_api"))
def norm_diff_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.api_optics(spark, sf_dir).select("sample_id", *[
        r6(c).alias(k) for k, c in sp.norm_diff_indices().items()])


@query("water_indices", with_views("""
SELECT sample_id, round((nir08-red)/(blue+green+1e-8), 6) AS SABI,
       round((green+red)/(nir08+swir16+1e-8), 6) AS WRI FROM v_api""", "v_api"))
def water_indices_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.api_optics(spark, sf_dir).select("sample_id", *[
        r6(c).alias(k) for k, c in sp.water_indices().items()])


@query("band_ratios", with_views("""
SELECT sample_id, round(red/(blue+1e-8), 6) AS turbidity_ratio, round(green/(red+1e-8), 6) AS green_red_ratio,
       round(nir08/(swir16+1e-8), 6) AS nir_swir_ratio, round(swir16/(swir22+1e-8), 6) AS swir_ratio
FROM v_api""", "v_api"))
def band_ratios_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.api_optics(spark, sf_dir).select("sample_id", *[
        r6(c).alias(k) for k, c in sp.band_ratios().items()])


@query("legacy_indices", with_views("""
SELECT sample_id, round((nir-swir16)/(nir+swir16+1e-10), 6) AS NDMI,
       round((green-swir16)/(green+swir16+1e-10), 6) AS MNDWI,
       round((nir-swir16)/nullif(nir+swir16, 0), 6) AS NDMI_noeps
FROM v_official""", "v_official"))
def legacy_indices_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.official_optics(spark, sf_dir)
    with_eps = sp.legacy_indices(with_eps=True)
    no_eps = sp.legacy_indices(with_eps=False)
    return o.select("sample_id", r6(with_eps["NDMI"]).alias("NDMI"), r6(with_eps["MNDWI"]).alias("MNDWI"),
                    r6(no_eps["NDMI"]).alias("NDMI_noeps"))


# ------------------------------------------------------------------ F5-F12
@query("climate_interactions", with_views("""
SELECT cell_i, cell_j, strftime(month, '%Y-%m') AS month,
       round(ppt/(pet+1e-8), 6) AS ppt_pet_ratio, round(tmax-tmin, 6) AS temp_range,
       round(q/(ppt+1e-8), 6) AS runoff_ratio, round(pet/(ppt+1e-8), 6) AS hydro_stress,
       round((tmax-tmin)*q, 6) AS thermal_runoff
FROM v_climate""", "v_climate"))
def climate_interactions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.climate(spark, sf_dir)
    return g.select("cell_i", "cell_j", cal.month_key("month").alias("month"),
                    *[r6(c).alias(k) for k, c in qf.climate_interactions().items()])


@query("cyclic_month", with_views("""
SELECT sample_id, round(sin(month(sample_ts) * 0.5235987755982988), 6) AS month_sin,
       round(cos(month(sample_ts) * 0.5235987755982988), 6) AS month_cos, CAST(quarter(sample_ts) AS INTEGER) AS quarter
FROM v_sample""", "v_sample"))
def cyclic_month_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    c = cal.cyclic_month("sample_ts")
    return s.select("sample_id", r6(c["month_sin"]).alias("month_sin"), r6(c["month_cos"]).alias("month_cos"),
                    c["quarter"].alias("quarter"))


@query("calendar_parts", with_views("""
SELECT sample_id, CAST(year(sample_ts) AS INTEGER) AS year, CAST(month(sample_ts) AS INTEGER) AS month,
       CAST(day(sample_ts) AS INTEGER) AS day, CAST(dayofyear(sample_ts) AS INTEGER) AS dayofyear, CAST((month(sample_ts) % 12) // 3 AS INT) AS season
FROM v_sample""", "v_sample"))
def calendar_parts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    return s.select("sample_id", *[c.alias(k) for k, c in cal.calendar_parts("sample_ts").items()])


@query("offset_fill_clip", with_views("""
SELECT sample_id, least(greatest(coalesce(days_offset, 61.0), 0.0), 61.0) AS days_offset_filled,
       CAST(days_offset IS NULL AS INT) AS days_offset_missing FROM v_api""", "v_api"))
def offset_fill_clip_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.api_optics(spark, sf_dir)
    return a.select("sample_id", *[c.alias(k) for k, c in qf.offset_fill_clip("days_offset").items()])


@query("abs_day_offset", with_views(f"""
SELECT p.l_orderkey, p.l_linenumber, {day_offset_sql('p.scene_ts', 's.sample_ts')} AS days_offset,
       {day_offset_sql("p.scene_ts - INTERVAL 12 HOUR", 's.sample_ts')} AS days_offset_minus_half,
       {day_offset_sql("p.scene_ts + INTERVAL 12 HOUR", 's.sample_ts')} AS days_offset_plus_half
FROM v_pixel p JOIN v_sample s ON p.l_orderkey = s.sample_id""", "v_pixel", "v_sample"))
def abs_day_offset_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", "scene_ts")
    s = fx.samples(spark, sf_dir).select("sample_id", "sample_ts")
    j = p.join(s, p.l_orderkey == s.sample_id)
    half = F.make_interval(hours=F.lit(12))
    return j.select("l_orderkey", "l_linenumber",
                    cal.abs_day_offset("scene_ts", "sample_ts").alias("days_offset"),
                    cal.abs_day_offset(F.col("scene_ts") - half, F.col("sample_ts")).alias("days_offset_minus_half"),
                    cal.abs_day_offset(F.col("scene_ts") + half, F.col("sample_ts")).alias("days_offset_plus_half"))


def _optics(spark, sf_dir) -> DataFrame:
    """API optics joined to the fallback source (1:1 on sample_id)."""
    return fx.api_optics(spark, sf_dir).join(
        fx.official_optics(spark, sf_dir).withColumnsRenamed(
            {b: f"{b}_old" for b in ("green", "swir16", "swir22")}), "sample_id", "left")


OPTICS_SQL = "SELECT a.*, o.nir, o.green AS green_old, o.swir16 AS swir16_old, o.swir22 AS swir22_old FROM v_api a LEFT JOIN v_official o ON a.sample_id = o.sample_id"


@query("quality_flags", with_views("""
SELECT sample_id,
       CAST(blue IS NOT NULL AND green IS NOT NULL AND red IS NOT NULL AND nir08 IS NOT NULL
            AND swir16 IS NOT NULL AND swir22 IS NOT NULL AS INT) AS api_optical_complete,
       CAST(nir IS NOT NULL AND green_old IS NOT NULL AND swir16_old IS NOT NULL AND swir22_old IS NOT NULL AS INT)
         AS old_optical_available,
       CAST(blue IS NOT NULL AND green IS NOT NULL AND red IS NOT NULL AND nir08 IS NOT NULL
            AND swir16 IS NOT NULL AND swir22 IS NOT NULL AND days_offset IS NOT NULL AND days_offset <= 10 AS INT)
         AS api_preferred,
       CAST(swir22 IS NULL AS INT) AS swir22_is_missing, CAST(nir IS NULL AS INT) AS nir_is_missing
FROM t""", "v_api", "v_official", extra=[("t", OPTICS_SQL)]))
def quality_flags_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _optics(spark, sf_dir)
    return d.select("sample_id", *[c.alias(k) for k, c in {
        **qf.quality_flags(), **qf.missing_flags(["swir22", "nir"])}.items()])


@query("sample_weight", with_views("""
SELECT sample_id,
  round((CASE WHEN c = 1 THEN 1.0 WHEN o = 1 THEN 0.92 ELSE 0.85 END) * (1.0 - f/61.0*0.18), 6) AS weight,
  round((CASE WHEN c = 1 THEN 1.0 WHEN o = 1 THEN 0.9 ELSE 0.8 END) * (1.0 - f/61.0*0.15), 6) AS weight_variant
FROM (SELECT sample_id,
        CAST(blue IS NOT NULL AND green IS NOT NULL AND red IS NOT NULL AND nir08 IS NOT NULL
             AND swir16 IS NOT NULL AND swir22 IS NOT NULL AS INT) AS c,
        CAST(nir IS NOT NULL AND green_old IS NOT NULL AND swir16_old IS NOT NULL AND swir22_old IS NOT NULL AS INT) AS o,
        least(greatest(coalesce(days_offset, 61.0), 0.0), 61.0) AS f FROM t) x""",
                                   "v_api", "v_official", extra=[("t", OPTICS_SQL)]))
def sample_weight_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _optics(spark, sf_dir).withColumns({**qf.quality_flags(), **qf.offset_fill_clip()})
    return d.select("sample_id", r6(qf.sample_weight()).alias("weight"),
                    r6(qf.sample_weight_variant()).alias("weight_variant"))


@query("spatial_bin", with_views("""
SELECT sample_id, round_even(lat, 1) + 0.0 AS lat_bin, round_even(lon, 1) + 0.0 AS lon_bin,
       CAST(round_even(lat, 1) + 0.0 AS VARCHAR) || '_' || CAST(round_even(lon, 1) + 0.0 AS VARCHAR) AS spatial_group
FROM v_sample""", "v_sample"))
def spatial_bin_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    return s.select("sample_id", *[c.alias(k) for k, c in qf.spatial_bin().items()])


# ------------------------------------------------------------------ F13-F16
@query("qa_mask", with_views("""
SELECT l_orderkey, l_linenumber, qa, CAST((qa & 26) = 0 AS INT) AS clear,
       CAST((qa & 24) <> 0 AS INT) AS cloud_or_shadow FROM v_pixel""", "v_pixel"))
def qa_mask_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.pixels(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", "qa", sp.qa_clear("qa").cast("int").alias("clear"),
                    sp.qa_flag_mask(["cloud", "shadow"], "qa").cast("int").alias("cloud_or_shadow"))


@query("mask_pixels", with_views("""
SELECT l_orderkey, l_linenumber, CASE WHEN (qa & 26) = 0 THEN green END AS green,
       CASE WHEN (qa & 26) = 0 THEN nir08 END AS nir08, CASE WHEN (qa & 26) = 0 THEN red END AS red
FROM v_pixel""", "v_pixel"))
def mask_pixels_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.pixels(spark, sf_dir)
    masked = sp.mask_pixels(["green", "nir08", "red"], sp.qa_clear("qa"))
    return p.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in masked.items()])


@query("valid_range", with_views("""
SELECT l_orderkey, l_linenumber, (green - 7000) * 8 AS dn,
       CASE WHEN (green - 7000) * 8 > 0 AND (green - 7000) * 8 < 65535 THEN (green - 7000) * 8 END AS dn_valid,
       nullif(CAST(l_linenumber % 3 AS DOUBLE), 0.0) AS median_nonzero
FROM v_pixel""", "v_pixel"))
def valid_range_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.pixels(spark, sf_dir).withColumn("dn", (F.col("green") - 7000) * 8)
    return p.select("l_orderkey", "l_linenumber", "dn", sp.valid_dn("dn").alias("dn_valid"),
                    sp.zero_as_missing((F.col("l_linenumber") % 3).cast("double")).alias("median_nonzero"))


# Reflectances have exactly 7 decimals: rounding to 6 would meet exact ties
# that the two engines break differently, so both round to 8.
@query("dn_to_reflectance", with_views("""
SELECT l_orderkey, l_linenumber,
       round(green*0.0000275 - 0.2, 8) AS green_sr, round(red*0.0000275 - 0.2, 8) AS red_sr
FROM v_pixel""", "v_pixel"))
def dn_to_reflectance_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.pixels(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", F.round(sp.dn_to_reflectance("green"), 8).alias("green_sr"),
                    F.round(sp.dn_to_reflectance("red"), 8).alias("red_sr"))


# ------------------------------------------------------------------ F17-F21
@query("log_targets", with_views("""
SELECT sample_id, round(ln(1 + ta), 6) AS ta_log, round(exp(ln(1 + ta)) - 1, 6) AS ta_back FROM v_sample""",
                                 "v_sample"))
def log_targets_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    return s.select("sample_id", r6(qf.log_target("ta")).alias("ta_log"),
                    r6(qf.unlog_target(qf.log_target("ta"))).alias("ta_back"))


@query("na_indicator", with_views("""
SELECT a.sample_id, a.blue, a.swir22, a.days_offset, coalesce(p.band_note, 'Missing') AS band_note,
       round(s.lat, 6) AS lat,
       CAST(a.blue IS NULL AS INT) AS blue_na, CAST(a.swir22 IS NULL AS INT) AS swir22_na,
       CAST(a.days_offset IS NULL AS INT) AS days_offset_na, CAST(p.band_note IS NULL AS INT) AS band_note_na
FROM v_api a JOIN v_sample s ON a.sample_id = s.sample_id
LEFT JOIN (SELECT sample_id, CASE WHEN blue > 12000 THEN 'bright' WHEN blue < 9000 THEN 'dark' END AS band_note
           FROM v_api) p ON a.sample_id = p.sample_id""", "v_api", "v_sample"))
def na_indicator_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.api_optics(spark, sf_dir)
    s = fx.samples(spark, sf_dir).select("sample_id", r6(F.col("lat")).alias("lat"))
    d = a.select("sample_id", "blue", "swir22", "days_offset",
                 F.when(F.col("blue") > 12000, F.lit("bright")).when(F.col("blue") < 9000, F.lit("dark"))
                 .alias("band_note")).join(s, "sample_id")
    return pj.na_indicator(d, ["blue", "swir22", "days_offset", "band_note", "lat"],
                           keep_missing=("blue", "swir22", "days_offset"))


@query("one_hot", with_views("""
SELECT o_orderkey AS sample_id,
       CAST(o_orderpriority = '1-URGENT' AS INT) AS priority_1_URGENT,
       CAST(o_orderpriority = '2-HIGH' AS INT) AS priority_2_HIGH,
       CAST(o_orderpriority = '3-MEDIUM' AS INT) AS priority_3_MEDIUM,
       CAST(o_orderpriority = '4-NOT SPECIFIED' AS INT) AS priority_4_NOT_SPECIFIED,
       CAST(o_orderpriority = '5-LOW' AS INT) AS priority_5_LOW
FROM orders"""))
def one_hot_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_orderpriority")
    return pj.one_hot(o, "o_orderpriority", prefix="priority")


@query("threshold_label", with_views("""
SELECT sample_id, CAST(drp >= 96.0 AS INT) AS drp_high FROM v_sample""", "v_sample"))
def threshold_label_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.samples(spark, sf_dir).select("sample_id", qf.threshold_label("drp", 96.0).alias("drp_high"))


@query("group_key_parts", with_views("""
SELECT sample_id, round(lon - 0.05, 6) AS min_lon, round(lat - 0.05, 6) AS min_lat,
       round(lon + 0.05, 6) AS max_lon, round(lat + 0.05, 6) AS max_lat,
       strftime(CAST(sample_ts AS DATE) - INTERVAL 30 DAY, '%Y-%m-%d') AS date_start,
       strftime(CAST(sample_ts AS DATE) + INTERVAL 30 DAY, '%Y-%m-%d') AS date_end
FROM v_sample""", "v_sample"))
def group_key_parts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    h = 0.1 / 2
    return s.select("sample_id", r6(F.col("lon") - h).alias("min_lon"), r6(F.col("lat") - h).alias("min_lat"),
                    r6(F.col("lon") + h).alias("max_lon"), r6(F.col("lat") + h).alias("max_lat"),
                    *[c.alias(k) for k, c in cal.time_window_bounds("sample_ts", 30).items()])
