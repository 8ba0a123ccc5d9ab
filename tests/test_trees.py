"""Invariants of fitted learners: folds don't leak, every row is predicted once, fallbacks hold."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.models import boosting as bs
from tessera.models import stack as sk
from tessera.models import trees as tr

FEATS = ["a", "b", "lat", "lon"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(240):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        data.append((i, i % 4, a, b, rnd.random(), rnd.random(), 3 * a + rnd.gauss(0, .1), a - b, 10 * (a > 0.5) + b,
                     1.0, int(i % 5 != 0)))
    return spark.createDataFrame(data, "sample_id long, fold int, a double, b double, lat double, lon double, "
                                       "ta double, ec double, drp double, sample_weight double, api_optical_complete int")


def test_each_row_is_predicted_once_by_models_of_other_folds(rows):
    names = [f"pred_{n}" for n in tr.FAMILY]
    got = {r.sample_id: r for r in tr.oof_boosted(rows, FEATS, "ta", "fold", iterations=30).collect()}
    assert len(got) == rows.count() and all(r[n] is not None for r in got.values() for n in names)
    # a label that only fold 0 has can't reach fold 0's own predictions
    moved = rows.withColumn("ta", F.when(F.col("fold") == 0, F.col("ta") + 1000).otherwise(F.col("ta")))
    again = {r.sample_id: r for r in tr.oof_boosted(moved, FEATS, "ta", "fold", iterations=30).collect()}
    fold0 = {r.sample_id for r in rows.where("fold = 0").collect()}
    assert all(got[i][n] == again[i][n] for i in fold0 for n in names)
    assert any(abs(got[i][names[0]] - again[i][names[0]]) > 1 for i in got if i not in fold0)


def test_rows_without_a_target_are_left_out(rows):
    holes = rows.withColumn("ta", F.when(F.col("sample_id") >= 20, F.col("ta")))
    assert tr.oof_boosted(holes, FEATS, "ta", "fold", iterations=2).count() == 220


def test_defaults_are_the_reference_counts():
    assert all(s.iterations == 700 and s.rate == 0.025 and s.depth == 5 for s in tr.learner_family("ta"))
    assert tr.regime_classifier("h").iterations == 250 and tr.rf_regressor("ta").getNumTrees() == 100
    assert tr.TRIALS == 30 and len(tr.FAMILY) == len(tr.SPACE) == 3


def test_weights_reach_the_learners(rows):
    heavy = rows.withColumn("sample_weight", F.when(F.col("a") > 0, 1000.0).otherwise(0.001))
    specs = tr.learner_family("ta", iterations=2)
    mean = [bs.predict(rows, bs.fit_batch(d, FEATS, specs, fold=None), []).agg(F.avg("pred_gbt_plain")).first()[0] for d in (rows, heavy)]
    assert mean[1] > mean[0] + 0.5


def test_classifier_gives_probabilities(rows):
    data = rows.withColumn("h", (F.col("a") > 0.5).cast("int"))
    fitted = bs.fit_batch(data, FEATS, [tr.regime_classifier("h", iterations=60)], fold=None)
    got = bs.predict(data, fitted, ["h"]).collect()
    assert all(0 < r.p_high < 1 for r in got) and sum((r.p_high > 0.5) == bool(r.h) for r in got) >= 235


def test_chain_trains_on_complete_rows_and_scores_all(rows):
    train, test = rows.where("sample_id < 200"), rows.where("sample_id >= 200")
    oof, scored = sk.target_chain(train, test, FEATS, "fold", iterations=20)
    got = oof.join(train.select("sample_id", "api_optical_complete"), "sample_id").collect()
    assert len(got) == 200 and all(r.ta_pred is not None for r in got)
    assert all((r.ec_pred is not None) == (r.api_optical_complete == 1) == (r.drp_pred is not None) for r in got)
    out = scored.collect()
    assert len(out) == 40 and all(None not in r for r in out)


def test_stack_uses_passthrough_columns_and_meta_equals_ridge(rows):
    stack = sk.fit_stack(rows, rows, FEATS, "ta", "fold", iterations=20)
    assert set(stack.coef) == {"_one", "ta__gbt_deep", "ta__gbt_wide", "ta__gbt_plain", "lat", "lon"}
    assert stack.oof.count() == stack.scored.count() == 240


def test_stacks_of_several_targets_equal_single_ones(rows):
    both = sk.multi_target(rows, rows.limit(30), FEATS, ["ta", "ec"], "fold", iterations=15)
    alone = sk.final_refit_score(rows, rows.limit(30), FEATS, "ec", "fold", iterations=15)
    a = {r.sample_id: r.prediction for r in both.where("target = 'ec'").collect()}
    assert both.count() == 60 and a == {r.sample_id: r.prediction for r in alone.collect()}


def test_specialist_blends_and_falls_back(rows):
    oof, scored = sk.regime_blend(rows, rows.limit(20), FEATS, "drp", 5.0, "fold", iterations=20, classifier_iterations=20)
    got = oof.collect()
    assert len(got) == rows.where("api_optical_complete = 1").count() and all(0 <= r.p_high <= 1 for r in got)
    assert scored.count() == 20
    assert sum(abs(r.prediction - r.drp) for r in got) / len(got) < 3
    # no row reaches the threshold: the high side is empty and predicts the training mean, with p = 0
    one, _ = sk.regime_blend(rows, rows.limit(5), FEATS, "drp", 1e9, "fold", iterations=2, classifier_iterations=2)
    assert all(r.p_high == 0.0 and r.prediction is not None for r in one.collect())


def test_search_has_a_row_per_trial_and_one_best_each(rows):
    space = {n: {**s, "iterations": ("int", 2, 6)} for n, s in tr.SPACE.items()}
    got = tr.param_search(rows, FEATS, ["ta", "drp"], "fold", trials=3, space=space).collect()
    assert len(got) == 2 * 3 * 3 and all(r.mean_rmse > 0 for r in got)
    for t in ("ta", "drp"):
        for n in tr.FAMILY:
            own = [r for r in got if (r.target, r.learner) == (t, n)]
            assert {r.trial for r in own} == {0, 1, 2}
            assert [r.trial for r in own if r.best] == [min(own, key=lambda r: (r.mean_rmse, r.trial)).trial]
    assert {(r.learner, r.trial, r.rate) for r in got if r.target == "ta"} == {(r.learner, r.trial, r.rate) for r in got if r.target == "drp"}
    again = tr.param_search(rows.repartition(5), FEATS, ["ta", "drp"], "fold", trials=3, space=space).collect()
    assert {(r.target, r.learner, r.trial, r.mean_rmse) for r in got} == {(r.target, r.learner, r.trial, r.mean_rmse) for r in again}


def test_log_target_and_weights_of_the_search(rows):
    pos = rows.withColumn("ta", F.exp(F.col("a")))
    space = {"gbt_deep": {**tr.SPACE["gbt_deep"], "iterations": ("int", 20, 30), "rate": ("real", 0.2, 0.3)}}
    plain, logged, weighted = (tr.param_search(pos, FEATS, ["ta"], "fold", trials=1, space=space, **more).first().mean_rmse
                               for more in ({}, {"log_target": True}, {"weight": "sample_weight"}))
    assert plain != logged and abs(plain - weighted) < 1e-9 and max(plain, logged) < 1.5


def test_search_space_covers_its_ranges():
    rng = random.Random(1)
    draws = [tr.draw(tr.SPACE["gbt_wide"], rng) for _ in range(400)]
    assert {d["depth"] for d in draws} == {3, 4, 5, 6} and all(0.01 <= d["rate"] <= 0.2 for d in draws)
    assert 0.4 < sum(d["rate"] < 0.0447 for d in draws) / 400 < 0.6  # half of a log-uniform draw lies below the geometric mean
    assert min(d["iterations"] for d in draws) < 230 and max(d["iterations"] for d in draws) > 770


def test_forest_fits_stay_in_memory_and_equal_plain_ones(rows, monkeypatch):
    d = tr.prepare(rows, FEATS, "ta")
    learner, seen = tr.rf_regressor("ta", num_trees=5), []
    plain = {f: learner.fit(d.where(F.col("fold") != f)) for f in range(4)}
    fit = type(learner).fit
    monkeypatch.setattr(type(learner), "fit", lambda self, *a: (seen.append(self.getCacheNodeIds()), fit(self, *a))[1])
    for a_core, cached in ((750_000, True), (10, False)):  # 180 rows a fit
        monkeypatch.setattr(tr, "FOREST_ROWS_A_CORE", a_core)
        seen.clear()
        assert {f: m.toDebugString.split("\n")[1:] for f, m in tr.fit_folds(d, learner, "fold").items()} == {
            f: m.toDebugString.split("\n")[1:] for f, m in plain.items()}
        assert seen == [cached] * 4
    assert not learner.getCacheNodeIds()


def test_large_forest_fits_run_one_after_another():
    assert tr.fits_at_once(720_000, 12, 5) == 5 and tr.fits_at_once(7_200_000, 12, 5) == 1
    assert tr.fits_at_once(3_000_000, 12, 5) == 3 and tr.fits_at_once(0, 4, 0) == 1


def test_boosted_rows_are_dealt_out_before_they_are_predicted(spark):
    """Many rows in one partition would go through every tree in one task."""
    df = spark.range(40_000).selectExpr("id as sample_id", "cast(id % 2 as int) as fold", "id % 13 * 1.0 as ta", "1.0D as sample_weight",
                                        "repeat(sha2(cast(id as string), 256), 2) as pad").coalesce(1)
    out = tr.spread(df)
    assert df.rdd.getNumPartitions() == 1 and out.rdd.getNumPartitions() > 1
    assert out.count() == 40_000 and out.groupBy("sample_id").count().where("count > 1").count() == 0
