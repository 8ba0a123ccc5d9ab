"""Registered queries: learning dataflow.

M1-M4 and the Gram sums of M8 are deterministic and carry oracle SQL;
the fitted models are checked by invariants (`tests/test_trees.py`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as qf
from ..models import boosting as bs
from ..models import features as ft
from ..models import folds as fo
from ..models import linear as li
from ..models import stack as sk
from ..models import trees as tr
from ..operators.setops import union_rows
from ..session import cut_lineage
from ..sources import fixtures as fx
from .oracle_views import with_views
from .registry import query

K = 5


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ M1-M3
@query("train_test_split", with_views(f"""
SELECT sample_id, CASE WHEN {fo.int_hash_sql('sample_id', 42)} % 100 < 70 THEN 'train' ELSE 'test' END AS split
FROM v_sample""", "v_sample"))
def train_test_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).select("sample_id")
    return fo.train_test_split(s, "sample_id", 70, 42)


SPATIAL_GROUP_SQL = """
SELECT sample_id, CAST(round_even(lat, 1) + 0.0 AS VARCHAR) || '_' || CAST(round_even(lon, 1) + 0.0 AS VARCHAR) AS grp
FROM v_sample"""


@query("group_kfold", with_views("""
SELECT g.sample_id, g.grp AS spatial_group,
       CAST(CASE WHEN (r.rn - 1) % 10 < 5 THEN (r.rn - 1) % 10 ELSE 9 - (r.rn - 1) % 10 END AS INT) AS fold
FROM g JOIN (SELECT grp, row_number() OVER (ORDER BY count(*) DESC, grp) AS rn FROM g GROUP BY grp) r
  ON g.grp = r.grp""", "v_sample", extra=[("g", SPATIAL_GROUP_SQL)]))
def group_kfold_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).select("sample_id", qf.spatial_bin()["spatial_group"].alias("spatial_group"))
    return fo.group_kfold(s, "spatial_group", K).select("sample_id", "spatial_group", "fold")


@query("random_kfold", with_views(f"""
SELECT sample_id, CAST({fo.int_hash_sql('sample_id', 7)} % 5 AS INT) AS fold FROM v_sample""", "v_sample"))
def random_kfold_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.random_kfold(fx.samples(spark, sf_dir).select("sample_id"), "sample_id", K, 7)


# ------------------------------------------------------------------ M4, M8
@query("standard_scale", with_views(f"""
SELECT a.sample_id, sp.split, round((a.blue - st.mb) / st.sb, 6) AS blue_z, round((a.green - st.mg) / st.sg, 6) AS green_z
FROM v_api a JOIN sp ON a.sample_id = sp.sample_id,
     (SELECT avg(a.blue) AS mb, stddev_pop(a.blue) AS sb, avg(a.green) AS mg, stddev_pop(a.green) AS sg
      FROM v_api a JOIN sp ON a.sample_id = sp.sample_id WHERE sp.split = 'train') st""",
                                    "v_api", extra=[("sp", f"""
SELECT o_orderkey AS sample_id, CASE WHEN {fo.int_hash_sql('o_orderkey', 42)} % 100 < 70 THEN 'train' ELSE 'test' END AS split
FROM orders""")]))
def standard_scale_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.api_optics(spark, sf_dir).select("sample_id", "blue", "green")
    d = fo.train_test_split(a, "sample_id", 70, 42)
    z = li.standard_scale(d, ["blue", "green"], fit_mask=F.col("split") == "train")
    return z.select("sample_id", "split", r6(F.col("blue_z")).alias("blue_z"), r6(F.col("green_z")).alias("green_z"))


GRAM_X = ["blue", "green", "red", "nir08"]


def _gram_input_spark(spark, sf_dir) -> DataFrame:
    a = fx.api_optics(spark, sf_dir)
    s = fx.samples(spark, sf_dir).select("sample_id", "ta")
    d = a.join(s, "sample_id").where(F.col("blue").isNotNull())
    d = d.withColumns({c: F.col(c) / 10000.0 for c in GRAM_X})
    return d.withColumns(qf.offset_fill_clip("days_offset")).withColumn(
        "w", F.lit(1.0) - F.col("days_offset_filled") / F.lit(61.0) * F.lit(0.18))


GRAM_VIEW = ("d", """
SELECT a.blue / 10000.0 AS blue, a.green / 10000.0 AS green, a.red / 10000.0 AS red, a.nir08 / 10000.0 AS nir08, s.ta,
       1.0 - least(greatest(coalesce(a.days_offset, 61.0), 0.0), 61.0) / 61.0 * 0.18 AS w
FROM v_api a JOIN v_sample s ON a.sample_id = s.sample_id WHERE a.blue IS NOT NULL""")


def _gram_sql() -> str:
    names = ["_one"] + GRAM_X
    col = {n: ("1.0" if n == "_one" else n) for n in names}
    parts = []
    for i, a in enumerate(names):
        for b in names[i:]:
            parts.append(f"SELECT '{a}' AS i, '{b}' AS j, round(sum(w * {col[a]} * {col[b]}), 6) AS value FROM d")
        parts.append(f"SELECT '{a}' AS i, 'y' AS j, round(sum(w * {col[a]} * ta), 6) AS value FROM d")
    return with_views(" UNION ALL ".join(parts), "v_api", "v_sample", extra=[GRAM_VIEW])


@query("ridge_gram", _gram_sql())
def ridge_gram_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = li.gram_long(_gram_input_spark(spark, sf_dir), GRAM_X, "ta", "w")
    return g.select("i", "j", r6(F.col("value")).alias("value"))


@query("ridge")
def ridge_fit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the solved coefficients (k×k solve on the driver)."""
    coef = li.ridge_fit(_gram_input_spark(spark, sf_dir), GRAM_X, "ta", "w", alpha=1.0)
    return spark.createDataFrame([(k, float(v)) for k, v in coef.items()], "term string, coef double")


@query("ridge_equation", with_views(" UNION ALL ".join(
    f"SELECT '{n}' AS term, round(sum(w * {'1.0' if n == '_one' else n} * ta), 3) AS value FROM d" for n in ["_one"] + GRAM_X),
    "v_api", "v_sample", extra=[GRAM_VIEW]))
def ridge_equation_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the fitted coefficients solve X'W(Xb) + alpha b = X'Wy (the intercept isn't penalised); the left side by term."""
    d = _gram_input_spark(spark, sf_dir)
    coef = li.ridge_fit(d, GRAM_X, "ta", "w", alpha=1.0)
    fitted = li.ridge_predict(d.where(F.col("ta").isNotNull()).dropna(subset=GRAM_X), coef)
    left = [F.struct(F.lit(n).alias("term"), F.round(
        F.sum(F.col("w") * (F.lit(1.0) if n == "_one" else F.col(n)) * F.col("prediction"))
        + F.lit(0.0 if n == "_one" else float(b)), 3).alias("value")) for n, b in coef.items()]
    return fitted.agg(F.array(*left).alias("left")).select(F.explode("left").alias("x")).select("x.*")


# ------------------------------------------------------------------ fitted models (rows-only)
def spatial_folds(spark, sf_dir) -> DataFrame:
    """Group -> fold table computed from the sample points alone (the group
    key needs only lat/lon), so the wide table is not built twice."""
    s = fx.samples(spark, sf_dir).select(qf.spatial_bin()["spatial_group"].alias("spatial_group"))
    return fo.fold_assignment(s, "spatial_group", K)


def _train(spark, sf_dir) -> DataFrame:
    """Training table with spatial group folds and a hash train/test split."""
    t = ft.training_table(spark, sf_dir).join(spatial_folds(spark, sf_dir), "spatial_group", "left")
    return fo.train_test_split(t, "sample_id", 70, 42)


def _split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = tr.spread(_train(spark, sf_dir))
    return t.where(F.col("split") == "train"), t.where(F.col("split") == "test")


@query("rf_regressor")
def rf_regressor_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tr.prepare(_train(spark, sf_dir), ft.FEATURES, "ta")
    model = tr.fit_forest(d.where(F.col("split") == "train"), tr.rf_regressor("ta"))
    return model.transform(d.where(F.col("split") == "test")).select("sample_id", "ta", "prediction")


@query("gbt_regressor")
def gbt_regressor_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the three learners in long form, fitted on the training split."""
    train, test = _split(spark, sf_dir)
    fitted = bs.fit_batch(train, ft.FEATURES, tr.learner_family("ta", prefix=""), fold=None)
    wide = bs.predict(test, fitted, ["sample_id"])
    return wide.unpivot(["sample_id"], list(tr.FAMILY), "learner", "prediction")


@query("regime_classifier")
def regime_classifier_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = (d.withColumn("drp_high", qf.threshold_label("drp", 96.0)) for d in _split(spark, sf_dir))
    fitted = bs.fit_batch(train.where(F.col("drp").isNotNull()), ft.FEATURES, [tr.regime_classifier("drp_high")], fold=None)
    return bs.predict(test.where(F.col("drp").isNotNull()), fitted, ["sample_id", "drp_high"])


def _base_oof(spark, sf_dir, target="ta") -> DataFrame:
    """Three learners' weighted out-of-fold predictions as columns (M9, M11) with the passthrough columns."""
    return cut_lineage(tr.oof_boosted(_train(spark, sf_dir), ft.FEATURES, target, "fold", carry=["sample_weight", *sk.PASSTHROUGH]))


BASES = [f"pred_{n}" for n in tr.FAMILY]
META = [*BASES, *sk.PASSTHROUGH]


@query("oof_predictions")
def oof_predictions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base_oof(spark, sf_dir).select("sample_id", "fold", "ta", *BASES)


@query("stack_insample")
def stack_insample_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = tr.stack_insample(_base_oof(spark, sf_dir), "ta", META, weight="sample_weight")
    return tr.score(scored, "ta", "prediction").select("n", "r2", "rmse", "mae")


@query("stack_crossfit")
def stack_crossfit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    cf = li.ridge_crossfit(_base_oof(spark, sf_dir), META, "ta", "fold", w="sample_weight", alpha=1.0)
    return tr.score(cf, "ta", "prediction").select("n", "r2", "rmse", "mae")


@query("target_chain")
def target_chain_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold chain predictions of the training rows and those of the rows held out."""
    train, test = _split(spark, sf_dir)
    oof, scored = sk.target_chain(train, test, ft.FEATURES, "fold")
    cols = ["sample_id", "ta_pred", "ec_pred", "drp_pred"]
    return oof.select(*cols, F.lit("train").alias("split")).unionByName(scored.select(*cols, F.lit("test").alias("split")))


@query("regime_blend")
def regime_blend_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    oof, scored = sk.regime_blend(train, test, ft.FEATURES, "drp", 96.0, "fold")
    cols = ["sample_id", "p_high", "prediction"]
    return oof.select(*cols, F.lit("train").alias("split")).unionByName(scored.select(*cols, F.lit("test").alias("split")))


@query("param_search")
def param_search_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 trials x 3 learners x 3 targets."""
    return tr.param_search(_train(spark, sf_dir), ft.FEATURES, ft.TARGETS, "fold")


@query("final_refit_score")
def final_refit_score_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return sk.final_refit_score(train, test, ft.FEATURES, "ta", "fold")


@query("multi_target")
def multi_target_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return sk.multi_target(train, test, ft.FEATURES, ft.TARGETS, "fold")


@query("spatial_vs_random_cv")
def spatial_vs_random_cv_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fo.random_kfold(_train(spark, sf_dir), "sample_id", K, 7, out="rfold")
    d = tr.prepare(t, ft.FEATURES, "ta")
    learner = tr.rf_regressor("ta")
    res = []
    for label, fcol in (("spatial", "fold"), ("random", "rfold")):
        o = tr.oof_predictions(d, learner, fcol).join(d.select("sample_id", "ta"), "sample_id")
        res.append(tr.score(o, "ta", "prediction").select(F.lit(label).alias("cv"), "r2"))
    both = union_rows(res)
    return both.groupBy().agg(
        F.max(F.when(F.col("cv") == "spatial", F.col("r2"))).alias("r2_spatial"),
        F.max(F.when(F.col("cv") == "random", F.col("r2"))).alias("r2_random")).withColumns({
            "gap": F.col("r2_random") - F.col("r2_spatial"),
            "mean": (F.col("r2_random") + F.col("r2_spatial")) / 2})


@query("feature_ablation")
def feature_ablation_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _train(spark, sf_dir)
    d = tr.prepare(t, ft.FEATURES, "ta").drop("features")
    rows = []
    for name, feats in ft.FEATURE_SETS.items():
        x = ft.assemble(d, feats)
        o = tr.oof_predictions(x, tr.rf_regressor("ta"), "fold")
        o = o.join(d.select("sample_id", "ta"), "sample_id")
        rows.append(tr.score(o, "ta", "prediction").select(F.lit(name).alias("feature_set"),
                                                            F.lit(len(feats)).alias("n_features"), "r2", "rmse"))
    return union_rows(rows)
