"""Flagship: samples joined to the nearest clear scene within ±30 days,
NDVI and offsets summarised by 0.1° latitude bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import spatial_bin
from ..functions.spectral import norm_diff, qa_clear
from ..operators.quantiles import group_quantiles
from ..operators.spatiotemporal import nearest_scene
from ..session import cut_lineage
from ..sources import fixtures as fx
from .oracle_views import day_offset_sql, gap_sql, with_views
from .registry import query

FLAGSHIP_SQL = with_views(f"""
SELECT round_even(lat, 1) + 0.0 AS lat_bin, count(*) AS n, count(green) AS n_hit,
       round(avg((nir08-red)/(nir08+red+1e-8)), 6) AS ndvi, round(avg(days_offset), 6) AS off,
       round(median(ta), 6) AS ta
FROM cand WHERE rn = 1 GROUP BY 1""", "v_sample", "v_pixel", extra=[
    ("v_scene", """SELECT site_id, scene_ts, median(green) AS green, median(nir08) AS nir08,
                          median(red) AS red, count(*) AS npix
                   FROM v_pixel WHERE (qa & 26) = 0 GROUP BY site_id, scene_ts"""),
    ("cand", f"""SELECT m.sample_id, m.lat, m.ta, p.green, p.nir08, p.red,
                        {day_offset_sql('p.scene_ts', 'm.sample_ts')} AS days_offset,
                        row_number() OVER (PARTITION BY m.sample_id
                           ORDER BY {gap_sql('p.scene_ts', 'm.sample_ts')}, p.scene_ts) AS rn
                 FROM v_sample m LEFT JOIN v_scene p
                   ON m.site_id = p.site_id AND p.scene_ts BETWEEN m.sample_ts - INTERVAL 30 DAY
                                                          AND m.sample_ts + INTERVAL 30 DAY"""),
])


def clear_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene medians over clear pixels; the QA filter runs before the shuffle."""
    px = fx.pixels(spark, sf_dir).where(qa_clear("qa"))
    return px.groupBy("site_id", "scene_ts").agg(
        F.median("green").alias("green"), F.median("nir08").alias("nir08"),
        F.median("red").alias("red"), F.count(F.lit(1)).alias("npix"))


@query("flagship_ndvi_by_lat", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest-scene table (one row per sample) is materialised once;
    the moments come from one aggregate and the per-bin median of `ta` from
    one distributed sort, so no latitude bin — however many samples it holds —
    is ever gathered into a single task's value map."""
    s = fx.samples(spark, sf_dir).select("sample_id", "site_id", "sample_ts", "lat", "ta")
    near = nearest_scene(s, clear_scenes(spark, sf_dir), key="site_id", sample_id="sample_id",
                         sample_ts="sample_ts", scene_ts="scene_ts", days=30, how="left")
    near = cut_lineage(near.select(spatial_bin("lat", "lon")["lat_bin"].alias("lat_bin"), "ta", "green",
                                   "nir08", "red", "days_offset"))
    agg = near.groupBy("lat_bin").agg(
        F.count(F.lit(1)).alias("n"), F.count("green").alias("n_hit"),
        F.round(F.avg(norm_diff("nir08", "red")), 6).alias("ndvi"),
        F.round(F.avg("days_offset"), 6).alias("off"))
    med = group_quantiles(near, "ta", (0.5,), by=["lat_bin"]).select("lat_bin", F.get("q", F.lit(0)).alias("ta"))
    return (agg.join(med, "lat_bin", "left")
            .select("lat_bin", "n", "n_hit", "ndvi", "off", F.round("ta", 6).alias("ta")))
