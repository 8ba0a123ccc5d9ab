"""Registered queries: the spatio-temporal core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.spectral import qa_clear
from ..operators import raster as ra
from ..operators import spatiotemporal as st
from ..sources import fixtures as fx
from ..session import cut_lineage
from .oracle_views import day_offset_sql, gap_sql, with_views
from .q_flagship import clear_scenes
from .registry import query


def r6(c):
    return F.round(c, 6)


def _samples(spark, sf_dir):
    return fx.samples(spark, sf_dir).select("sample_id", "site_id", "sample_ts")


def _win_sql(scene: str, sample: str, days) -> str:
    return (f"{scene} BETWEEN {sample} - INTERVAL ({days}) DAY AND {sample} + INTERVAL ({days}) DAY")


OFF = day_offset_sql("c.scene_ts", "s.sample_ts")
GAP = gap_sql("c.scene_ts", "s.sample_ts")

BANDS = ["blue", "green", "red", "nir08", "swir16", "swir22"]
SCENE_COLS = [f"{b}_{s}" for b in BANDS for s in ("median", "p75", "std")]
DERIVED = ["NDVI", "NDWI", "MNDWI", "Turbidity"]


def _valid_sql(band: str) -> str:
    return f"CASE WHEN (qa & 26) = 0 AND {band} > 0 AND {band} < 65535 THEN {band} END"


# Scene statistics over all pixels of a scene (cloudy scenes included).
SCENE_STATS_SQL = "SELECT site_id, scene_ts, " + ", ".join(
    f"median({_valid_sql(b)}) AS {b}_median, quantile_cont({_valid_sql(b)}, 0.75) AS {b}_p75, "
    f"stddev_pop({_valid_sql(b)}) AS {b}_std" for b in BANDS) + """,
       avg(CAST((qa & 26) = 0 AS INT)) AS clear_fraction, count(*) AS n_pixels, count(*) FILTER (WHERE (qa & 26) = 0) AS n_clear
FROM v_pixel GROUP BY site_id, scene_ts"""

DERIVED_SQL = """(nir08_median - red_median) / (nir08_median + red_median + 1e-8) AS NDVI,
       (green_median - nir08_median) / (green_median + nir08_median + 1e-8) AS NDWI,
       (green_median - swir16_median) / (green_median + swir16_median + 1e-8) AS MNDWI,
       red_median / (blue_median + 1e-8) AS Turbidity"""


def scene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.scene_reduce(fx.pixels(spark, sf_dir), ["site_id", "scene_ts"], BANDS, clear=qa_clear("qa"))


# ------------------------------------------------------------------ J7
WINDOWS = (15, 30, 60)


@query("window_join", with_views(f"""
SELECT s.sample_id, w.win, strftime(c.scene_ts, '%Y-%m-%d') AS scene_day, {OFF} AS days_offset
FROM v_sample s CROSS JOIN (VALUES (15), (30), (60)) w(win)
JOIN v_scenecat c ON s.site_id = c.site_id AND {_win_sql('c.scene_ts', 's.sample_ts', 'w.win')}""",
                                 "v_sample", "v_scenecat"))
def window_join_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = fx.scenes(spark, sf_dir).select("site_id", "scene_ts")
    top = st.multi_window_join(_samples(spark, sf_dir), cat, key="site_id", sample_ts="sample_ts",
                               scene_ts="scene_ts", windows=WINDOWS)
    return top.select("sample_id", "win", cal.iso_day("scene_ts").alias("scene_day"), "days_offset")


# ------------------------------------------------------------------ J8
@query("nearest_scene", with_views(f"""
SELECT sample_id, strftime(scene_ts, '%Y-%m-%d') AS scene_day, days_offset, green, nir08, red
FROM (SELECT s.sample_id, c.scene_ts, c.green, c.nir08, c.red,
             CASE WHEN c.scene_ts IS NOT NULL THEN {OFF} END AS days_offset,
             row_number() OVER (PARTITION BY s.sample_id ORDER BY {GAP}, c.scene_ts) AS rn
      FROM v_sample s LEFT JOIN sc c ON s.site_id = c.site_id AND {_win_sql('c.scene_ts', 's.sample_ts', 30)}) x
WHERE rn = 1""", "v_sample", "v_pixel", extra=[("sc", """
SELECT site_id, scene_ts, median(green) AS green, median(nir08) AS nir08, median(red) AS red
FROM v_pixel WHERE (qa & 26) = 0 GROUP BY site_id, scene_ts""")]))
def nearest_scene_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = st.nearest_scene(_samples(spark, sf_dir), clear_scenes(spark, sf_dir), key="site_id",
                            sample_id="sample_id", sample_ts="sample_ts", scene_ts="scene_ts", days=30, how="left")
    return near.select("sample_id", cal.iso_day("scene_ts").alias("scene_day"), "days_offset", "green", "nir08", "red")


# ------------------------------------------------------------------ J9
@query("first_clear_of_top3", with_views(f"""
SELECT sample_id, strftime(scene_ts, '%Y-%m-%d') AS scene_day, days_offset, CAST(scene_rank AS INTEGER) AS scene_rank,
       green_median
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY scene_rank) AS r
      FROM (SELECT s.sample_id, c.scene_ts, c.n_clear, c.green_median, {OFF} AS days_offset,
                   row_number() OVER (PARTITION BY s.sample_id ORDER BY {GAP}, c.scene_ts) AS scene_rank
            FROM v_sample s JOIN sc c ON s.site_id = c.site_id AND {_win_sql('c.scene_ts', 's.sample_ts', 30)}) y
      WHERE scene_rank <= 3 AND n_clear >= 1 AND green_median IS NOT NULL) x
WHERE r = 1""", "v_sample", "v_pixel", extra=[("sc", SCENE_STATS_SQL)]))
def first_clear_of_top3_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = (F.col("n_clear") >= 1) & F.col("green_median").isNotNull()
    sc = scene_stats(spark, sf_dir).select("site_id", "scene_ts", "n_clear", "green_median")
    out = st.first_clear_of_top(_samples(spark, sf_dir), sc, key="site_id", sample_id="sample_id",
                                sample_ts="sample_ts", scene_ts="scene_ts", days=30, usable=usable, k=3)
    return out.select("sample_id", cal.iso_day("scene_ts").alias("scene_day"), "days_offset", "scene_rank",
                      "green_median")


# ------------------------------------------------------------------ J10
@query("topk_scenes", with_views(f"""
SELECT sample_id, strftime(scene_ts, '%Y-%m-%d') AS scene_day, days_offset, CAST(scene_rank AS INTEGER) AS scene_rank
FROM (SELECT s.sample_id, c.scene_ts, c.n_clear, {OFF} AS days_offset,
             row_number() OVER (PARTITION BY s.sample_id ORDER BY {GAP}, c.scene_ts) AS scene_rank
      FROM v_sample s JOIN sc c ON s.site_id = c.site_id AND {_win_sql('c.scene_ts', 's.sample_ts', 30)}) x
WHERE scene_rank <= 4 AND n_clear >= 1""", "v_sample", "v_pixel", extra=[("sc", SCENE_STATS_SQL)]))
def topk_scenes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = scene_stats(spark, sf_dir).select("site_id", "scene_ts", "n_clear")
    out = st.topk_scenes(_samples(spark, sf_dir), sc, key="site_id", sample_id="sample_id", sample_ts="sample_ts",
                         scene_ts="scene_ts", days=30, k=4, keep=F.col("n_clear") >= 1)
    return out.select("sample_id", cal.iso_day("scene_ts").alias("scene_day"), "days_offset", "scene_rank")


# ------------------------------------------------------------------ J11
@query("widening_window", with_views(f"""
SELECT sample_id, scene_day, days_offset, in_inner FROM (
  SELECT s.sample_id, strftime(c.scene_ts, '%Y-%m-%d') AS scene_day, {OFF} AS days_offset,
         CAST({_win_sql('c.scene_ts', 's.sample_ts', 30)} AS INT) AS in_inner,
         max(CAST({_win_sql('c.scene_ts', 's.sample_ts', 30)} AS INT)) OVER (PARTITION BY s.sample_id) AS any_inner
  FROM v_sample s JOIN v_scenecat c ON s.site_id = c.site_id AND {_win_sql('c.scene_ts', 's.sample_ts', 60)}) x
WHERE any_inner = 0 OR in_inner = 1""", "v_sample", "v_scenecat"))
def widening_window_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = fx.scenes(spark, sf_dir).select("site_id", "scene_ts")
    out = st.widening_window(_samples(spark, sf_dir), cat, key="site_id", sample_id="sample_id",
                             sample_ts="sample_ts", scene_ts="scene_ts", inner_days=30, outer_days=60)
    return out.select("sample_id", cal.iso_day("scene_ts").alias("scene_day"), "days_offset", "in_inner")


# ------------------------------------------------------------------ J12
CELLS_SQL = "SELECT DISTINCT cell_i, cell_j, lat, lon FROM v_climate"
NEAREST_CELL_SQL = """
SELECT sample_id, sample_ts, cell_i, cell_j, dist2 FROM (
  SELECT s.sample_id, s.sample_ts, c.cell_i, c.cell_j,
         (s.lat - c.lat) * (s.lat - c.lat) + (s.lon - c.lon) * (s.lon - c.lon) AS dist2,
         row_number() OVER (PARTITION BY s.sample_id
                            ORDER BY (s.lat - c.lat) * (s.lat - c.lat) + (s.lon - c.lon) * (s.lon - c.lon), c.lat, c.lon) AS rn
  FROM v_sample s CROSS JOIN cells c) x WHERE rn = 1"""


def nearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.climate(spark, sf_dir).select("cell_i", "cell_j", "lat", "lon").distinct()
    pts = fx.samples(spark, sf_dir).select("sample_id", "sample_ts", "lat", "lon")
    return st.nearest_cell(pts, cells, point_id="sample_id", bucket=0.5)


# The oracle is brute force (every sample against every cell).
@query("nearest_grid_cell", with_views("SELECT sample_id, cell_i, cell_j, round(dist2, 6) AS dist2 FROM nc",
                                       "v_sample", "v_climate", extra=[("cells", CELLS_SQL), ("nc", NEAREST_CELL_SQL)]))
def nearest_grid_cell_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nearest_cells(spark, sf_dir)
    return n.select("sample_id", F.col("cell_cell_i").alias("cell_i"), F.col("cell_cell_j").alias("cell_j"),
                    r6(F.col("dist2")).alias("dist2"))


@query("snap_to_grid", with_views("""
SELECT s.sample_id, s.ci AS cell_i, s.cj AS cell_j, CAST(c.cell_i IS NOT NULL AS INT) AS cell_exists
FROM (SELECT sample_id, CAST(round_even((lat + 35.0) / 0.5, 0) AS INT) AS ci,
             CAST(round_even((lon - 15.0) / 0.5, 0) AS INT) AS cj FROM v_sample) s
LEFT JOIN cells c ON s.ci = c.cell_i AND s.cj = c.cell_j""", "v_sample", "v_climate", extra=[("cells", CELLS_SQL)]))
def snap_to_grid_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    snapped = s.select("sample_id", *[c.alias(k) for k, c in st.snap_to_grid("lat", "lon", -35.0, 15.0, 0.5).items()])
    cells = fx.climate(spark, sf_dir).select("cell_i", "cell_j").distinct().withColumn("cell_exists", F.lit(1))
    return (snapped.join(cells, ["cell_i", "cell_j"], "left")
            .select("sample_id", "cell_i", "cell_j", F.coalesce(F.col("cell_exists"), F.lit(0)).alias("cell_exists")))


# ------------------------------------------------------------------ J13
@query("nearest_month", with_views("""
SELECT sample_id, cell_i, cell_j, strftime(month, '%Y-%m') AS month, month_offset, ppt FROM (
  SELECT n.sample_id, n.cell_i, n.cell_j, g.month, g.ppt,
         abs(date_diff('day', g.month, CAST(n.sample_ts AS DATE))) AS month_offset,
         row_number() OVER (PARTITION BY n.sample_id
                            ORDER BY abs(date_diff('day', g.month, CAST(n.sample_ts AS DATE))), g.month) AS rn
  FROM nc n JOIN v_climate g ON n.cell_i = g.cell_i AND n.cell_j = g.cell_j) x WHERE rn = 1""",
                                   "v_sample", "v_climate", extra=[("cells", CELLS_SQL), ("nc", NEAREST_CELL_SQL)]))
def nearest_month_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nearest_cells(spark, sf_dir).select("sample_id", "sample_ts", F.col("cell_cell_i").alias("cell_i"),
                                            F.col("cell_cell_j").alias("cell_j"))
    g = fx.climate(spark, sf_dir).select("cell_i", "cell_j", "month", "ppt")
    out = st.nearest_month(n, g, sample_id="sample_id", sample_ts="sample_ts", cell_keys=["cell_i", "cell_j"])
    return out.select("sample_id", "cell_i", "cell_j", cal.month_key("month").alias("month"),
                      F.col("month_offset").cast("bigint").alias("month_offset"), "ppt")


# ------------------------------------------------------------------ J14
@query("previous_available_month", with_views("""
SELECT sample_id, strftime(month, '%Y-%m') AS month, ppt FROM (
  SELECT s.sample_id, g.month, g.ppt, row_number() OVER (PARTITION BY s.sample_id ORDER BY g.month DESC) AS rn
  FROM sc s JOIN v_climate g ON s.cell_i = g.cell_i AND s.cell_j = g.cell_j
  WHERE g.month <= s.month AND g.month >= make_date(year(s.sample_ts) - 1, 1, 1)) x WHERE rn = 1""",
                                              "v_sample", "v_climate", extra=[("sc", """
SELECT sample_id, sample_ts, CAST(floor((lat + 35.0) / 0.5) AS INT) AS cell_i,
       CAST(floor((lon - 15.0) / 0.5) AS INT) AS cell_j, CAST(date_trunc('month', sample_ts) AS DATE) AS month
FROM v_sample""")]))
def previous_available_month_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).select(
        "sample_id", "sample_ts", F.floor((F.col("lat") + 35.0) / 0.5).cast("int").alias("cell_i"),
        F.floor((F.col("lon") - 15.0) / 0.5).cast("int").alias("cell_j"))
    g = fx.climate(spark, sf_dir).select("cell_i", "cell_j", "month", "ppt")
    out = st.previous_available_month(s, g, sample_id="sample_id", sample_ts="sample_ts",
                                      cell_keys=["cell_i", "cell_j"])
    return out.select("sample_id", cal.month_key("month").alias("month"), "ppt")


# ------------------------------------------------------------------ A1-A3
@query("scene_reduce", with_views(
    "SELECT site_id, strftime(scene_ts, '%Y-%m-%d') AS scene_day, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in SCENE_COLS)
    + ", round(clear_fraction, 6) AS clear_fraction, n_pixels, n_clear FROM sc",
    "v_pixel", extra=[("sc", SCENE_STATS_SQL)]))
def scene_reduce_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = scene_stats(spark, sf_dir)
    return sc.select("site_id", cal.iso_day("scene_ts").alias("scene_day"), *[r6(F.col(c)).alias(c) for c in SCENE_COLS],
                     r6(F.col("clear_fraction")).alias("clear_fraction"), "n_pixels", "n_clear")


@query("scene_reduce_tiles", with_views(
    "SELECT site_id, strftime(scene_ts, '%Y-%m-%d') AS scene_day, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in SCENE_COLS)
    + ", round(clear_fraction, 6) AS clear_fraction, n_pixels, n_clear FROM sc",
    "v_pixel", extra=[("sc", SCENE_STATS_SQL)]))
def scene_reduce_tiles_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 where scenes are array tiles."""
    keys = ["site_id", "scene_ts"]
    sc = ra.tile_reduce(ra.tile_scenes(fx.pixels(spark, sf_dir), keys, BANDS), keys, BANDS)
    return sc.select("site_id", cal.iso_day("scene_ts").alias("scene_day"), *[r6(F.col(c)).alias(c) for c in SCENE_COLS],
                     r6(F.col("clear_fraction")).alias("clear_fraction"), "n_pixels", "n_clear")


@query("scene_derived", with_views("SELECT site_id, strftime(scene_ts, '%Y-%m-%d') AS scene_day, "
                                   + ", ".join(f"round({c}, 6) AS {c}" for c in DERIVED)
                                   + f" FROM (SELECT site_id, scene_ts, {DERIVED_SQL} FROM sc) d",
                                   "v_pixel", extra=[("sc", SCENE_STATS_SQL)]))
def scene_derived_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ra.scene_derived(scene_stats(spark, sf_dir))
    return d.select("site_id", cal.iso_day("scene_ts").alias("scene_day"), *[r6(F.col(c)).alias(c) for c in DERIVED])


@query("clear_fraction", with_views("""
SELECT site_id, round(avg(CAST((qa & 26) = 0 AS INT)), 6) AS clear_fraction, count(*) AS n_pixels
FROM v_pixel GROUP BY site_id""", "v_pixel"))
def clear_fraction_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = ra.scene_reduce(fx.pixels(spark, sf_dir), ["site_id"], [], clear=qa_clear("qa"))
    return site.select("site_id", r6(F.col("clear_fraction")).alias("clear_fraction"), "n_pixels")


# ------------------------------------------------------------------ A4
SUMMARY_KEYS = [*SCENE_COLS, *DERIVED, "clear_fraction", "days_offset"]
SUMMARY_STATS = ("mean", "median", "max")


def _summary_sql(groups: list[str]) -> str:
    """Per (sample, groups) the summaries of `kept` over the spine `spine`."""
    stats = ", ".join(f"avg({k}) AS {k}_mean, median({k}) AS {k}_median, max({k}) AS {k}_max" for k in SUMMARY_KEYS)
    out = ", ".join(f"round({k}_{x}, 6) AS {k}_{x}" for k in SUMMARY_KEYS for x in SUMMARY_STATS)
    keys = ", ".join(["sample_id", *groups])
    on = " AND ".join(f"p.{g} = t.{g}" for g in ["sample_id", *groups])
    return (f"stats AS (SELECT {keys}, count(*) AS scene_count, {stats} FROM kept GROUP BY {keys})\n"
            f"SELECT {', '.join(f'p.{g}' for g in ['sample_id', *groups])}, coalesce(t.scene_count, 0) AS scene_count, {out}\n"
            f"FROM spine p LEFT JOIN stats t ON {on}")


def _summary_columns() -> list:
    return ["scene_count", *[r6(F.col(f"{k}_{x}")).alias(f"{k}_{x}") for k in SUMMARY_KEYS for x in SUMMARY_STATS]]


SCENE_KEYS_SQL = ", ".join(f"c.{k}" for k in [*SCENE_COLS, *DERIVED, "clear_fraction"])

WINDOW_SUMMARY_SQL = f"""
cand AS (SELECT s.sample_id, w.win, c.n_clear, {SCENE_KEYS_SQL}, CAST({OFF} AS DOUBLE) AS days_offset,
                row_number() OVER (PARTITION BY s.sample_id, w.win ORDER BY {GAP}, c.scene_ts) AS rk
         FROM v_sample s CROSS JOIN (VALUES (15), (30), (60)) w(win)
         JOIN sc c ON s.site_id = c.site_id AND {_win_sql('c.scene_ts', 's.sample_ts', 'w.win')}),
kept AS (SELECT * FROM cand WHERE rk <= 4 AND n_clear >= 1),
spine AS (SELECT s.sample_id, w.win FROM v_sample s CROSS JOIN (VALUES (15), (30), (60)) w(win)),
""" + _summary_sql(["win"])


def _with_scenes(body: str, *more: tuple[str, str]) -> str:
    base = with_views("SELECT 1", "v_sample", "v_pixel", extra=[
        ("sc0", SCENE_STATS_SQL), ("sc", f"SELECT *, {DERIVED_SQL} FROM sc0"), *more])
    return base[: base.rindex("SELECT 1")].rstrip() + ",\n" + body


def _scene_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scenes are ranked and kept by. Their statistics join the rows that are left."""
    return scene_stats(spark, sf_dir).select("site_id", "scene_ts", "n_clear")


def _with_statistics(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = scene_stats(spark, sf_dir).select("site_id", "scene_ts", "n_clear", *SCENE_COLS, "clear_fraction")
    return rows.drop("n_clear").join(stats, ["site_id", "scene_ts"])


@query("window_summary", _with_scenes(WINDOW_SUMMARY_SQL))
def window_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    rows = st.multi_window_topk(samples, _scene_times(spark, sf_dir), key="site_id", sample_id="sample_id",
                                sample_ts="sample_ts", scene_ts="scene_ts", windows=WINDOWS, k=4,
                                keep=F.col("n_clear") >= 1)
    rows = _with_statistics(rows, spark, sf_dir)
    spine = samples.select("sample_id", F.explode(F.array(*[F.lit(w) for w in WINDOWS])).alias("win"))
    out = ra.window_summary(spine, rows, sample_id="sample_id", group_cols=["win"], value_cols=SUMMARY_KEYS,
                            derive=ra.scene_derived)
    return out.select("sample_id", "win", *_summary_columns())


# ------------------------------------------------------------------ J7 (boxes)
BOX_SCALES = (0.1, 0.5)


def _site_lat(c):
    return F.lit(-35.18) + (F.col(c) * 37 % 1346) / F.lit(100.0)


def _site_lon(c):
    return F.lit(14.97) + (F.col(c) * 101 % 1782) / F.lit(100.0)


@query("bbox_window_join", with_views(f"""
SELECT s.sample_id, b.scale, c.site_id AS scene_site, strftime(c.scene_ts, '%Y-%m-%d') AS scene_day,
       {OFF} AS days_offset
FROM v_sample s CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) b(scale)
JOIN (SELECT site_id, scene_ts, -35.18 + (site_id*37 % 1346)/CAST(100 AS DOUBLE) AS lat,
             14.97 + (site_id*101 % 1782)/CAST(100 AS DOUBLE) AS lon FROM v_scenecat) c
  ON c.lat BETWEEN s.lat - b.scale AND s.lat + b.scale
 AND abs(c.lat - s.lat) <= b.scale / 2 AND abs(c.lon - s.lon) <= b.scale / 2
 AND {_win_sql('c.scene_ts', 's.sample_ts', 30)}""", "v_sample", "v_scenecat"))
def bbox_window_join_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 at two box scales: scenes of any site inside the sample's box."""
    s = fx.samples(spark, sf_dir).select("sample_id", "sample_ts", "lat", "lon")
    cat = fx.scenes(spark, sf_dir).select(F.col("site_id").alias("scene_site"), "scene_ts",
                                          cal.iso_day("scene_ts").alias("scene_day"),
                                          _site_lat("site_id").alias("c_lat"), _site_lon("site_id").alias("c_lon"))
    # the boxes of a sample lie in one another: one join at the widest, fanned out to those that hold the scene
    j = st.bbox_window_join(s, cat, lat="lat", lon="lon", sample_ts="sample_ts", scene_lat="c_lat",
                            scene_lon="c_lon", scene_ts="scene_ts", size=max(BOX_SCALES), days=30)
    j = j.withColumn("scale", F.explode(F.array(*[F.lit(x) for x in BOX_SCALES]))).where(
        (F.abs(F.col("c_lat") - F.col("lat")) <= F.col("scale") / 2) & (F.abs(F.col("c_lon") - F.col("lon")) <= F.col("scale") / 2))
    return j.select("sample_id", "scale", "scene_site", "scene_day", "days_offset")


# ------------------------------------------------------------------ A4 at both box scales
BOX_SUMMARY_SQL = f"""
cand AS (SELECT s.sample_id, b.scale, w.win, c.n_clear, {SCENE_KEYS_SQL}, CAST({OFF} AS DOUBLE) AS days_offset,
                row_number() OVER (PARTITION BY s.sample_id, b.scale, w.win ORDER BY {GAP}, c.scene_ts, c.site_id) AS rk
         FROM v_sample s CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) b(scale)
         CROSS JOIN (VALUES (15), (30), (60)) w(win)
         JOIN scl c ON c.lat BETWEEN s.lat - b.scale AND s.lat + b.scale
          AND abs(c.lat - s.lat) <= b.scale / 2 AND abs(c.lon - s.lon) <= b.scale / 2
          AND {_win_sql('c.scene_ts', 's.sample_ts', 'w.win')}),
kept AS (SELECT * FROM cand WHERE rk <= 4 AND n_clear >= 1),
spine AS (SELECT s.sample_id, b.scale, w.win FROM v_sample s
          CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) b(scale)
          CROSS JOIN (VALUES (15), (30), (60)) w(win)),
""" + _summary_sql(["scale", "win"])


@query("window_summary_box", _with_scenes(BOX_SUMMARY_SQL, ("scl", """
SELECT sc.*, -35.18 + (site_id*37 % 1346)/CAST(100 AS DOUBLE) AS lat,
       14.97 + (site_id*101 % 1782)/CAST(100 AS DOUBLE) AS lon FROM sc""")))
def window_summary_box_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 as the reference lays it out: per sample, box scale and window —
    the 4 nearest scenes of any site inside the box (cloud-free ones kept
    after the cut), summarised; an empty (sample, scale, window) has count 0."""
    sc = cut_lineage(_scene_times(spark, sf_dir).withColumns({"c_lat": _site_lat("site_id"), "c_lon": _site_lon("site_id")}))
    s = fx.samples(spark, sf_dir).select("sample_id", "sample_ts", "lat", "lon")
    rows = None
    for scale in BOX_SCALES:
        top = st.bbox_window_topk(s, sc, sample_id="sample_id", lat="lat", lon="lon", sample_ts="sample_ts", scene_lat="c_lat",
                                  scene_lon="c_lon", scene_ts="scene_ts", order=["scene_ts", "site_id"], size=scale,
                                  days=max(WINDOWS), k=4, carry=["site_id", "scene_ts", "n_clear"])
        part = top.where(F.col("n_clear") >= 1).withColumn("scale", F.lit(scale))
        rows = part if rows is None else rows.unionByName(part)
    rows = _with_statistics(st.fan_out(rows, WINDOWS), spark, sf_dir)
    spine = s.select("sample_id", F.explode(F.array(*[F.lit(x) for x in BOX_SCALES])).alias("scale")).select(
        "sample_id", "scale", F.explode(F.array(*[F.lit(w) for w in WINDOWS])).alias("win"))
    out = ra.window_summary(spine, rows, sample_id="sample_id", group_cols=["scale", "win"], value_cols=SUMMARY_KEYS,
                            derive=ra.scene_derived)
    return out.select("sample_id", "scale", "win", *_summary_columns())
