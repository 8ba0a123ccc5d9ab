"""Key joins, source coalescing, set operations and profiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins as jn
from tessera.operators import metrics as me
from tessera.operators import profile as pf
from tessera.operators import projections as pj
from tessera.operators import quantiles as qu
from tessera.operators import setops as so


def test_join_keys_left_raises_on_fanout(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    right = spark.createDataFrame([(1, 5.0), (1, 6.0)], "k long, v double")
    with pytest.raises(Exception, match="duplicate"):
        jn.join_keys_left(left, right, ["k"]).collect()
    ok = jn.join_keys_left(left, right.limit(1), ["k"]).orderBy("k").collect()
    assert [r.v_old for r in ok] == [5.0, None] and len(ok) == 2


def test_coalesce_sources_fallback_only_when_green_missing(spark):
    api = spark.createDataFrame([(1, 1.0, 2.0, None, 4.0, 5.0, 6.0), (2, 1.0, 2.0, 3.0, None, 5.0, 6.0),
                                 (3, None, None, None, None, None, None)],
                                "sample_id long, blue double, red double, green double, nir08 double, "
                                "swir16 double, swir22 double")
    off = spark.createDataFrame([(1, 40.0, 30.0, 50.0, 60.0), (2, 41.0, 31.0, 51.0, 61.0), (3, None, None, None, None)],
                                "sample_id long, nir double, green double, swir16 double, swir22 double")
    out = {r.sample_id: r for r in jn.coalesce_sources(api, off).collect()}
    assert (out[1].green, out[1].nir08, out[1].blue, out[1].optical_source) == (30.0, 40.0, 1.0, "official")
    assert (out[2].green, out[2].nir08, out[2].optical_source) == (3.0, None, "api")  # no per-column fallback
    assert out[3].optical_source == "none"
    assert abs(out[2].NDMI - (41.0 - 51.0) / (41.0 + 51.0 + 1e-10)) < 1e-12
    cov = jn.coverage_by_source(jn.coalesce_sources(api, off)).first()
    assert (cov.n_api, cov.n_recovered, cov.n_unrecoverable) == (1, 1, 1)


def test_alignment_check(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "k long, lat double, lon double")
    b = spark.createDataFrame([(1, 1.00005, 2.0), (2, 3.0, 4.0)], "k long, lat double, lon double")
    assert jn.alignment_check(a, b, "k", ["lat", "lon"]).first().aligned == 1
    c = spark.createDataFrame([(1, 1.1, 2.0)], "k long, lat double, lon double")
    assert jn.alignment_check(a, c, "k", ["lat", "lon"]).first().aligned == 0


def test_frames_equal(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    r = so.frames_equal(a, a, "k", "v").first()
    assert (r.n_only_left, r.n_only_right, r.max_abs_diff, r.equal) == (0, 0, 0.0, 1)
    b = spark.createDataFrame([(1, 1.0), (2, 2.5)], "k long, v double")
    assert so.frames_equal(a, b, "k", "v").first().equal == 0


def test_histogram_top_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)], "x double")
    h = {r.bin: r["count"] for r in pf.histogram(df, "x", bins=5).collect()}
    assert h == {0: 2, 1: 1, 2: 0, 3: 0, 4: 1}  # 10 is the top edge -> last bin


def test_box_stats_whiskers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x double")
    r = pf.box_stats(df, "x").first()
    assert (r.q1, r.median, r.q3) == (3.0, 5.0, 7.0)
    assert r.whisker_high == 8.0 and r.n_outliers == 1


def test_fold_median_impute_uses_other_folds_only(spark):
    df = spark.createDataFrame([(0, 1.0), (0, None), (1, 10.0), (1, 20.0), (2, 30.0)], "fold int, x double")
    out = pf.fold_median_impute(df, ["x"], "fold", [0, 1, 2]).where(F.col("fold") == 0).collect()
    assert sorted(r.x for r in out) == [1.0, 20.0]  # median of folds 1 and 2 = 20


def test_missing_report_and_corr(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (3.0, 6.0), (None, 9.0)], "a double, b double")
    rep = {r.column: (r.n_missing, r.pct_missing) for r in pf.missing_report(df, ["a", "b"]).collect()}
    assert rep == {"a": (1, 25.0), "b": (1, 25.0)}
    c = pf.corr_matrix(df, ["a", "b"]).first()
    assert math.isclose(c.corr, 1.0)  # pairwise-complete rows only


def test_one_hot_and_na_indicator(spark):
    df = spark.createDataFrame([(1, "x-1"), (2, "y"), (3, None)], "id long, c string")
    oh = pj.one_hot(df, "c").orderBy("id").collect()
    assert [(r.c_x_1, r.c_y) for r in oh] == [(1, 0), (0, 1), (None, None)]
    na = pj.na_indicator(df, ["c", "id"]).orderBy("id").collect()
    assert [r.c for r in na] == ["x-1", "y", "Missing"] and "id_na" not in na[0].asDict()


def test_drop_duplicate_columns_and_rename_pattern(spark):
    a = spark.createDataFrame([(1, 2.0)], "k long, v double")
    b = spark.createDataFrame([(1, 3.0)], "k long, v double")
    j = a.join(b, a.k == b.k)
    d = pj.drop_duplicate_columns(j)
    assert d.columns == ["k", "v"] and d.first().v == 2.0
    r = pj.rename_pattern(spark.createDataFrame([(1.0,)], "`Total Alkalinity (mg)` double"), ("total", "alkal"), "ta")
    assert r.columns == ["ta"]


def test_complement_medians_equal_brute_force_without_copies(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 1, 2, 3, None]), rng.choice([None, float("nan"), float("inf"), 7.0, 7.0, rng.gauss(0, 9)]), rng.choice([1.0, 2.0, None]))
            for _ in range(700)] + [(4, None, 5.0)]
    df = spark.createDataFrame(rows, "fold int, x double, y double").repartition(6)
    got = {(r["_held"], r["_col"]): r["median"] for r in qu.complement_medians(df, ["x", "y"], "fold", range(6)).collect()}
    for f in range(6):
        for i, c in ((1, "x"), (2, "y")):
            v = sorted(r[i] for r in rows if r[0] not in (None, f) and r[i] is not None and r[i] == r[i])
            assert got[f, c] == v[(len(v) - 1) // 2] / 2 + v[len(v) // 2] / 2
    plan = qu.complement_medians(df, ["x", "y"], "fold", range(6))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    out = pf.fold_median_impute(df, ["x", "y"], "fold", range(5)).where("fold = 4").collect()
    assert out[0].x == got[4, "x"] and out[0].y == 5.0


def test_histogram_leaves_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, float("nan"), float("inf"), float("-inf"), None)], "x double")
    rows = pf.histogram(df, "x", bins=3).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 1, 1] and (rows[0].lo, rows[2].hi) == (1.0, 4.0)
    r = rows[0]
    assert (r.n, r["median"], r["min"], r["max"]) == (3, 2.0, 1.0, 4.0) and math.isclose(r["mean"], 7 / 3) and math.isclose(r["std"], 1.5275252316519468)
    assert pf.histogram(df.where("isnan(x)"), "x").count() == 0
    logs = pf.histogram(spark.createDataFrame([(0.0,), (-1.0,), (-5.0,), (3.0,)], "x double"), "x", bins=2, log=True).collect()
    assert sum(r["count"] for r in logs) == 2 and logs[0].n == 2


def test_one_hot_keeps_levels_whose_names_collide(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a_b"), (3, "a-b"), (4, "A b")], "id long, c string")
    out = pj.one_hot(df, "c").orderBy("id").collect()
    assert all(sum(v for k, v in r.asDict().items() if k != "id") == 1 for r in out) and len(out[0]) == 5
    assert len({tuple(r)[1:] for r in out}) == 4
    with pytest.raises(ValueError):
        pj.one_hot(df.withColumn("c_a_b", F.lit(1)), "c")
    with pytest.raises(ValueError):
        pj.one_hot(df, "c", max_levels=3)


def test_corr_matrix_of_hundreds_of_columns_equals_numpy(spark):
    k = 439
    df = spark.range(150).select("id", *[(F.rand(i) * 5 + (F.col("id") % 7 if i % 3 else F.lit(0)) + 1e6 * (i % 2)).alias(f"x{i}") for i in range(k)])
    df = df.withColumns({f"x{i}": F.when(F.col("id") % (i + 3) > 0, F.col(f"x{i}")) for i in range(0, k, 5)}).withColumns(
        {"x1": F.lit(3.0), "x2": F.when(F.col("id") == 5, 1.0), "x3": F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("x3"))})
    df = spark.createDataFrame(df.toPandas()).repartition(5)
    cols = [f"x{i}" for i in range(k)]
    got = {(r.col_a, r.col_b): r["corr"] for r in pf.corr_matrix(df, cols).collect()}
    assert len(got) == k * (k - 1) // 2
    want = df.toPandas()[cols].astype(float)
    rng = random.Random(1)
    for a, b in [rng.sample(range(k), 2) for _ in range(300)] + [(1, 5), (2, 9), (3, 4), (0, 438)]:
        a, b = sorted((a, b))
        pair = want[[f"x{a}", f"x{b}"]].dropna()
        if len(pair) < 2 or pair.iloc[:, 0].std() == 0 or pair.iloc[:, 1].std() == 0:
            assert got[f"x{a}", f"x{b}"] is None
        else:
            assert abs(got[f"x{a}", f"x{b}"] - pair.corr().iloc[0, 1]) < 1e-7
    few, many = (pf.corr_matrix(df, cols[:n])._jdf.queryExecution().executedPlan().toString().count("+- ") for n in (3, k))
    assert many == few


def test_candidate_distance_of_hundreds_of_runs(spark):
    runs, targets = [f"r{i}" for i in range(300)], {"ta": 1.0, "drp": 2.0}
    sub = spark.range(20 * 300).select((F.col("id") % 20).alias("sample_id"), F.concat(F.lit("r"), F.floor(F.col("id") / 20).cast("string")).alias("run"),
                                       (F.rand(1) * 9).alias("ta"), F.when(F.col("id") % 11 > 0, F.rand(2)).alias("drp"))
    sub = spark.createDataFrame(sub.toPandas()).union(sub.limit(0)).withColumn("drp", F.when(~F.isnan("drp"), F.col("drp")))
    sub = sub.unionByName(sub.where("run = 'r7'").withColumn("run", F.lit("other")))
    got = {(r.candidate, r.anchor): r for r in me.candidate_distance(sub, "run", runs, targets).collect()}
    assert len(got) == 300 * 299
    wide = sub.toPandas().pivot(index="sample_id", columns="run", values=list(targets))
    for c, a in (("r0", "r1"), ("r299", "r5"), ("r17", "r16")):
        d, most = 0.0, 0.0
        for t, w in targets.items():
            x, y = wide[t][c], wide[t][a]
            s = y.std() + 1e-6
            d += w * ((x - y).abs().mean() + 0.3 * abs(x.mean() - y.mean()) + 0.3 * abs(x.std() - y.std())) / s
            most = max(most, (x - y).abs().max())
        assert math.isclose(got[c, a].distance, d, rel_tol=1e-9) and math.isclose(got[c, a].max_abs_diff, most)
