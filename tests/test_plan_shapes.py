"""The physical plans have the shapes the design relies on (broadcast joins
disabled, i.e. the large-data shape)."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import spatiotemporal as st
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_is_bucketed_and_ranked_per_sample(no_broadcast):
    registry.load_all()
    plan = _plan(registry.QUERIES["nearest_scene"](no_broadcast, SF))
    assert "SortMergeJoin [site_id#" in plan and "_tbucket" in plan.split("SortMergeJoin")[1].split("\n")[0]
    # at most one row of a sample leaves a task for the rank's exchange
    exchange = plan.index("hashpartitioning(sample_id")
    assert "WindowGroupLimit" in plan[exchange:]


@pytest.mark.parametrize("name", ["nearest_scene", "topk_scenes", "first_clear_of_top", "widening_window"])
def test_a_hot_site_and_time_bucket_is_split(no_broadcast, name):
    """One (site, bucket) holds most samples; AQE splits it with default options but for the sizes."""
    spark, small = no_broadcast, {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
                                  "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
                                  "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        day = F.make_timestamp_ntz(F.lit(2014), F.lit(6), F.lit(15), F.lit(0), F.lit(0), F.lit(0))
        samples = spark.range(30000).select(F.col("id").alias("sample_id"),
                                            F.when(F.col("id") % 10 == 0, F.col("id") % 997).otherwise(5000).alias("site_id"),
                                            day.alias("sample_ts"))
        scenes = spark.range(3000).select(F.when(F.col("id") % 997 < 5, 5000).otherwise(F.col("id") % 997).alias("site_id"),
                                          (day + F.make_interval(hours=(F.col("id") % 90).cast("int"))).alias("scene_ts"))
        # hashed before, so that the join's inputs are real shuffles of many map tasks
        args = dict(key="site_id", sample_id="sample_id", sample_ts="sample_ts", scene_ts="scene_ts")
        more = {"nearest_scene": {"days": 30}, "topk_scenes": {"days": 30, "k": 2},
                "first_clear_of_top": {"days": 30, "usable": F.lit(True)}, "widening_window": {}}[name]
        out = getattr(st, name)(samples.repartition(16), scenes, **args, **more)
        out.collect()
        assert "skew=true" in _plan(out)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_month_range_reaches_the_scan(no_broadcast):
    plan = _plan(registry.QUERIES["grid_crop"](no_broadcast, SF))
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln][0]
    assert "GreaterThanOrEqual(l_shipdate" in scan  # (the plan string truncates the rest)


def test_blend_scan_reads_rows_once(no_broadcast):
    plan = _plan(registry.QUERIES["blend_scan"](no_broadcast, SF))
    # one scan; the weight grid is exploded from the one row of sums, above the last aggregate
    assert plan.count("FileScan") == 1
    assert plan.index("Generate explode") < plan.index("HashAggregate(keys=[]")


def test_merge_joins_share_the_id_partitioning(no_broadcast):
    from tessera.models import features as ft

    plan = _plan(ft.merged_table(no_broadcast, SF))
    # samples, API and official sources are each shuffled once on sample_id
    assert plan.count("hashpartitioning(sample_id") == 3


def test_tiles_are_reduced_within_the_row(spark):
    import random

    from tessera.operators import raster as ra
    rng = random.Random(5)
    px = spark.createDataFrame([(i % 7, rng.choice([None, 0.0, 65535.0, float(rng.randrange(1, 9000))]), float(rng.randrange(1, 50)), rng.choice([0, 1, 2, 8, 64, None]))
                                for i in range(500)], "site long, green double, red double, qa int").where("site <> 6 OR qa = 2")
    tiles = ra.tile_scenes(px, ["site"], ["green", "red"])
    rows = ra.tile_reduce(tiles, ["site"], ["green", "red"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1   # of building the tiles
    want = {r.site: r for r in ra.scene_reduce(px, ["site"], ["green", "red"]).collect()}
    got = {r.site: r for r in rows.collect()}
    assert got.keys() == want.keys()
    for site, r in got.items():
        for c in rows.columns:
            a, b = r[c], want[site][c]
            assert a == b or abs(a - b) < 1e-9, (site, c, a, b)
