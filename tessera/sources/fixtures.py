"""Domain tables derived by Spark from the given TPC-H-style tables.

The reference works on sample points, optical sources, scene pixels, a
monthly climate grid and model predictions. The test data has none of
those, so each is a deterministic projection of `orders` / `lineitem`
(the same definitions as the portable views in FIXTURES.md). Every view
grows with its base table; nothing here is made up or fixed-size except
the three-model list in `predictions`, which is a parameter of the
scenario, not data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def _at_hour(day: Column, hour: Column) -> Column:
    """A day of the base table at an hour derived from its keys."""
    return day + F.make_interval(hours=hour.cast("int"))


def _dbl(c: Column) -> Column:
    return c.cast("double")


def _band(expr: Column, missing: Column | None = None) -> Column:
    v = _dbl(F.lit(7000) + expr % 9000)
    return v if missing is None else F.when(~missing, v)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample points: one per order, site = customer, time = order date at some hour."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("sample_id"),
        c.alias("site_id"),
        _at_hour(F.col("o_orderdate"), k * 5 % 24).alias("sample_ts"),
        (F.lit(-35.18) + (c * 37 % 1346) / F.lit(100.0)).alias("lat"),
        (F.lit(14.97) + (c * 101 % 1782) / F.lit(100.0)).alias("lon"),
        (F.col("o_totalprice") / 1000).alias("ta"),
        (_dbl((k * 7919 + c * 31) % 5000) / 10).alias("ec"),
        (_dbl((k * 104729) % 1600) / 10).alias("drp"),
    )


def api_optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary optical source: 1/8 of rows missing, swir22 missing more often."""
    k = F.col("o_orderkey")
    gap = k % 8 == 3
    return table(spark, sf_dir, "orders").select(
        k.alias("sample_id"),
        _band(k * 57, gap).alias("blue"),
        _band(k * 131, gap).alias("green"),
        _band(k * 89, gap).alias("red"),
        _band(k * 173, gap).alias("nir08"),
        _band(k * 211, gap).alias("swir16"),
        _band(k * 241, gap | (k % 101 == 0)).alias("swir22"),
        F.when(~gap, _dbl(k % 70)).alias("days_offset"),
    )


def official_optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback optical source (reference naming: `nir`), 1/9 missing, swir22 more often."""
    k = F.col("o_orderkey")
    gap = k % 9 == 4
    return table(spark, sf_dir, "orders").select(
        k.alias("sample_id"),
        _band(k * 167, gap).alias("nir"),
        _band(k * 127, gap).alias("green"),
        _band(k * 199, gap).alias("swir16"),
        _band(k * 233, gap | (k % 103 == 0)).alias("swir22"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pixel table: one row per lineitem, scene = (site, ship date).

    lineitem ⋈ orders is a fact-to-fact equi-join on the order key; it is left
    to the planner (sort-merge at scale, both sides pruned to the used columns).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p, s, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("site_id"),
        _at_hour(F.col("l_shipdate"), (F.col("o_custkey") * 7 + F.dayofmonth("l_shipdate") * 11) % 24).alias("scene_ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        _band(p * 131).alias("green"),
        _band(p * 173 + ln * 911, p % 9 == 0).alias("nir08"),
        _band(p * 57 + s * 13).alias("red"),
        _band(p * 101 + s * 17).alias("blue"),
        _band(p * 211 + ln * 53, p % 11 == 0).alias("swir16"),
        _band(p * 241 + s * 29).alias("swir22"),
        ((p * 7 + s * 3) % 64).cast("int").alias("qa"),
    )


def climate(spark: SparkSession, sf_dir: str, months: tuple[str, str] | None = None) -> DataFrame:
    """Sparse monthly 0.5° grid: one cell per supplier slot, one slice per month.

    `months` = (first, last) month start ('yyyy-MM-dd') restricts the grid to
    those slices; the bound is stated on the raw timestamp so it reaches the
    parquet scan as a pushed filter (row groups outside it are skipped).
    """
    li = table(spark, sf_dir, "lineitem")
    if months is not None:
        lo = F.lit(months[0]).cast("timestamp_ntz")
        hi = F.add_months(F.lit(months[1]).cast("date"), 1).cast("timestamp_ntz")
        li = li.where((F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi))
    s = F.col("l_suppkey")
    keyed = li.select(
        (s % 27).cast("int").alias("cell_i"),
        (s * 7 % 36).cast("int").alias("cell_j"),
        F.trunc("l_shipdate", "month").alias("month"),
        "l_quantity", "l_discount", "l_tax",
    )
    g = keyed.groupBy("cell_i", "cell_j", "month").agg(
        F.round(F.avg("l_quantity") * 3, 6).alias("ppt"),
        F.round(F.avg("l_discount") * 2000, 6).alias("pet"),
        F.round(20 + F.avg("l_tax") * 200, 6).alias("tmax"),
        F.round(5 + F.avg("l_tax") * 100, 6).alias("tmin"),
        _dbl(F.count(F.lit(1))).alias("q"),
    )
    return g.select(
        "cell_i", "cell_j",
        (F.lit(-35.0) + F.col("cell_i") * F.lit(0.5)).alias("lat"),
        (F.lit(15.0) + F.col("cell_j") * F.lit(0.5)).alias("lon"),
        "month", "ppt", "pet", "tmax", "tmin", "q",
    )


# Fixed scenario parameters: model name, scale on the target, noise multiplier.
PRED_MODELS = (("m1", 0.8, 7919), ("m2", 0.7, 104729), ("m3", 0.9, 1299709))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of three models, long format, fold by site.

    The three models are attached with an `explode` of a literal array (a
    narrow per-row expansion), not a join.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    models = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(w).alias("w"), F.lit(k).alias("k"))
        for m, w, k in PRED_MODELS
    ])
    e = o.select("*", F.explode(models).alias("b"))
    y = F.col("o_totalprice") / 1000
    return e.select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("b.m").alias("model"),
        y.alias("y"),
        (y * F.col("b.w") + _dbl(F.col("o_orderkey") * F.col("b.k") % 1000) / 10).alias("pred"),
        (F.col("o_custkey") % 5).cast("int").alias("fold"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalogue: one row per (site, scene time) with its cloud cover.

    Cloud cover is the percentage of pixels carrying the cloud bit (8), the
    platform alternates by site. A single partial+final hash aggregate.
    """
    px = pixels(spark, sf_dir)
    return px.groupBy("site_id", "scene_ts").agg(
        F.round(F.avg(((F.col("qa").bitwiseAND(8)) != 0).cast("int")) * 100, 6).alias("cloud_cover"),
        F.count(F.lit(1)).alias("n_pixels"),
    ).withColumn(
        "platform", F.when(F.col("site_id") % 2 == 0, F.lit("landsat-8")).otherwise(F.lit("landsat-9"))
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalogue with extents: a rectangle around the site's location, of unequal sizes from 0.02 to 6 degrees."""
    c = F.col("site_id")
    lat = F.lit(-35.18) + (c * 37 % 1346) / F.lit(100.0)
    lon = F.lit(14.97) + (c * 101 % 1782) / F.lit(100.0)
    tall = F.when(c % 97 == 0, _dbl(F.lit(3))).otherwise((F.lit(1) + c * 13 % 30) / F.lit(100.0))
    wide = F.when(c % 89 == 0, _dbl(F.lit(2))).otherwise((F.lit(1) + c * 17 % 25) / F.lit(100.0))
    return scenes(spark, sf_dir).withColumns({"south": lat - tall, "north": lat + tall, "west": lon - wide, "east": lon + wide})


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction files of three runs for all three targets (long by run):
    the target times the run's scale plus a run-specific deterministic
    error, the same construction as `predictions` for each target."""
    s = samples(spark, sf_dir).select("sample_id", "ta", "ec", "drp")
    runs = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(w).alias("w"), F.lit(k).alias("k"))
        for m, w, k in PRED_MODELS
    ])
    j = s.select("sample_id", "ta", "ec", "drp", F.explode(runs).alias("b"))
    noise = F.col("sample_id") * F.col("b.k")
    return j.select(
        "sample_id", F.col("b.m").alias("run"),
        (F.col("ta") * F.col("b.w") + _dbl(noise % 1000) / 10).alias("ta"),
        (F.col("ec") * F.col("b.w") + _dbl(noise % 500) / 10).alias("ec"),
        (F.col("drp") * F.col("b.w") + _dbl(noise % 300) / 10).alias("drp"),
    )
