"""Readers, optional sources, schema guard, run catalogue, resumable extraction."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import grid_store as gs
from tessera.sources import incremental as inc
from tessera.sources import tables as tb
from tessera.streaming.incremental_stream import start_extract_stream, write_epoch

SCHEMA = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("ppt", T.DoubleType())])


def test_read_csv_with_declared_schema(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.csv")
    with open(p, "w") as fh:
        fh.write("sample_id,ppt\n1,2.5\n2,oops\n")
    rows = tb.read_table(spark, p, SCHEMA, fmt="csv").orderBy("sample_id").collect()
    assert [(r.sample_id, r.ppt) for r in rows] == [(1, 2.5), (2, None)]


def test_optional_source_absent_gives_typed_nulls(spark, tmpdir_path):
    spine = spark.createDataFrame([(1,), (2,)], "sample_id long")
    out = tb.optional_source(spark, os.path.join(tmpdir_path, "missing"), SCHEMA, "sample_id", spine)
    assert dict(out.dtypes)["ppt"] == "double" and out.where(F.col("ppt").isNotNull()).count() == 0
    path = os.path.join(tmpdir_path, "present")
    spark.createDataFrame([(1, 3.0)], SCHEMA).write.parquet(path)
    got = {r.sample_id: r.ppt for r in tb.optional_source(spark, path, SCHEMA, "sample_id", spine).collect()}
    assert got == {1: 3.0, 2: None}


def test_schema_guard(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "out")
    assert tb.schema_guard(spark, path, SCHEMA) is False
    spark.createDataFrame([(1, 3.0)], SCHEMA).write.parquet(path)
    assert tb.schema_guard(spark, path, SCHEMA) is True
    other = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("pet", T.DoubleType())])
    assert tb.schema_guard(spark, path, other) is False


def test_run_catalog_mixed_columns(spark, tmpdir_path):
    a, b = os.path.join(tmpdir_path, "run_a"), os.path.join(tmpdir_path, "run_b")
    os.makedirs(a)
    os.makedirs(b)
    with open(os.path.join(a, "cv_metrics.csv"), "w") as fh:
        fh.write("Parameter,CV_R2,CV_RMSE\nta,0.4,10\n")
    with open(os.path.join(b, "cv_metrics.csv"), "w") as fh:
        fh.write("Parameter,postcal_r2\nta,0.35\n")
    cat = tb.run_catalog(spark, {"cv": [os.path.join(a, "cv_metrics.csv")], "cal": [os.path.join(b, "cv_metrics.csv")]})
    got = sorted((r.family, r.score) for r in cat.collect())
    assert got == [("cal", 0.35), ("cv", 0.4)]
    assert all(r.source_file for r in cat.collect())


def test_export_template_keeps_template_rows(spark):
    tpl = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "sample_id long, d string")
    preds = spark.createDataFrame([(1, 0.5), (3, 1.5)], "sample_id long, ta double")
    out = tb.export_template(tpl, preds, "sample_id", ["sample_id", "d", "ta"]).orderBy("sample_id").collect()
    assert [(r.sample_id, r.ta) for r in out] == [(1, 0.5), (2, None), (3, 1.5)]


def test_incremental_extract_resumes(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "extract")
    todo = spark.range(100).withColumnRenamed("id", "sample_id")
    ext = lambda d: d.withColumn("v", F.col("sample_id") * 2)
    assert inc.incremental_extract(spark, todo.where("sample_id < 40"), "sample_id", out, ext) == 40
    assert inc.incremental_extract(spark, todo, "sample_id", out, ext, batch_rows=25) == 60
    assert inc.incremental_extract(spark, todo, "sample_id", out, ext) == 0
    res = spark.read.parquet(out)
    assert res.count() == 100 and res.select("sample_id").distinct().count() == 100


def test_streaming_extract_exactly_once(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "incoming")
    out = os.path.join(tmpdir_path, "stream_out")
    ck = os.path.join(tmpdir_path, "stream_ck")
    spark.range(0, 30).withColumnRenamed("id", "sample_id").write.parquet(src)
    schema = T.StructType([T.StructField("sample_id", T.LongType())])
    seen = []

    def ext(d):
        seen.append(d)
        return d.withColumn("v", F.col("sample_id") + 1)
    start_extract_stream(spark, src, schema, "sample_id", out, ck, ext).awaitTermination()
    spark.range(20, 50).withColumnRenamed("id", "sample_id").write.mode("append").parquet(src)
    start_extract_stream(spark, src, schema, "sample_id", out, ck, ext).awaitTermination()
    res = spark.read.parquet(out)
    assert res.count() == 50 and res.select("sample_id").distinct().count() == 50
    assert {r["epoch"]: r["count"] for r in res.groupBy("epoch").count().collect()} == {0: 30, 1: 20}
    # a replayed epoch writes its folder anew; the state, not the output, says what is new
    write_epoch(out, ext)(spark.range(30, 50).withColumnRenamed("id", "sample_id"), 1)
    assert spark.read.parquet(out).count() == 50
    assert all("stream_out" not in d._jdf.queryExecution().toString() for d in seen)


def test_grid_lookup_reads_the_samples_partitions_only(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "grid")
    grid = spark.range(24 * 400).select(
        F.make_date(F.lit(2010) + F.floor(F.col("id") % 24 / 12).cast("int"), (F.col("id") % 12 + 1).cast("int"), F.lit(1)).alias("month"),
        (F.floor(F.col("id") / 24) % 20 - 30.0).alias("lat"), (F.floor(F.col("id") / 480) + 15.0).alias("lon"), F.col("id").cast("double").alias("ppt"))
    gs.write_grid(grid, path)
    store = gs.read_grid(spark, path)
    assert store.select("month_key", "tile").distinct().count() == 24 * 16 and store.count() == grid.distinct().count()
    samples = spark.createDataFrame([(1, -29.0, 16.0, "2010-03-01"), (2, -28.5, 17.0, "2010-03-01"), (3, None, 17.0, "2010-03-01"), (4, 5.0, 5.0, "2010-03-01")],
                                    "sid long, lat double, lon double, day string").withColumn("month", F.col("day").cast("date"))
    got = gs.crop_to(store, gs.wanted_partitions(samples, "month", F.col("lat"), F.col("lon")))
    rows = got.collect()
    assert len(rows) == 25 and {(r.month.year, r.month.month) for r in rows} == {(2010, 3)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert got.columns == ["month", "lat", "lon", "ppt"]


def test_write_metrics_appends(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "metrics")
    m = spark.createDataFrame([("ta", 0.41, 57.1)], "Parameter string, CV_R2 double, CV_RMSE double")
    tb.write_metrics(m, path)
    tb.write_metrics(m, path)
    assert spark.read.parquet(path).count() == 2
    out = os.path.join(tmpdir_path, "single")
    tb.write_single_file(m.union(m), out, ["Parameter"])
    assert len([f for f in os.listdir(out) if f.endswith(".csv")]) == 1
