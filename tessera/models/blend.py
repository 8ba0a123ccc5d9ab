"""Prediction post-processing: fold means, stack features, calibration,
weighted blends and the blend-weight scan (M10, M11, M16-M18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import profile_estimate

# Fixed per-target blend weights of the three base learners (reference values).
TARGET_BLEND_WEIGHTS = {"ta": (0.4, 0.4, 0.2), "ec": (0.35, 0.4, 0.25), "drp": (0.2, 0.2, 0.6)}


def fold_mean_prediction(preds: DataFrame, key: str = "sample_id", by=(), pred: str = "pred") -> DataFrame:
    """Mean of the fold models' predictions per row (and model)."""
    return preds.groupBy(key, *by).agg(F.avg(pred).alias("pred_mean"), F.count(F.lit(1)).alias("n_models"))


def stack_features(preds: DataFrame, models, key: str = "sample_id", model: str = "model",
                   pred: str = "pred", passthrough: DataFrame | None = None) -> DataFrame:
    """Base out-of-fold predictions as columns (one per model, list
    given so the pivot needs no extra pass) plus passthrough columns."""
    wide = preds.groupBy(key).pivot(model, list(models)).agg(F.first(pred))
    wide = wide.withColumnsRenamed({m: f"pred_{m}" for m in models})
    return wide if passthrough is None else wide.join(passthrough, key, "left")


def linear_calibration(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """Least-squares fit y = a·p + b per group."""
    return df.groupBy(*by).agg(F.regr_slope(y, p).alias("slope"), F.regr_intercept(y, p).alias("intercept"))


def apply_calibration(df: DataFrame, coef: DataFrame, p: str, by=(), out: str = "pred_cal") -> DataFrame:
    """Apply a·p + b (coefficients joined by group; one row per group)."""
    j = df.join(coef, list(by), "left") if by else df.join(coef.withColumn("_k", F.lit(1)), F.lit(1) == F.col("_k"))
    return j.withColumn(out, F.col("slope") * F.col(p) + F.col("intercept"))


def weighted_blend(preds: DataFrame, weights: dict[str, float], key: str = "sample_id",
                   model: str = "model", pred: str = "pred") -> DataFrame:
    """Σ w_m · p_m per row; the weight is a CASE on the model name."""
    w = None
    for m, v in weights.items():
        w = F.when(F.col(model) == m, F.lit(v)) if w is None else w.when(F.col(model) == m, F.lit(v))
    return (preds.where(F.col(model).isin(list(weights))).groupBy(key)
            .agg(F.sum(w.otherwise(F.lit(0.0)) * F.col(pred)).alias("blend")))


def target_blends(runs: DataFrame, weights: dict[str, dict[str, float]], key: str = "sample_id",
                  model: str = "run") -> DataFrame:
    """M17 for several targets at once: per target Σ w_m · p_m, one aggregate."""
    def weighted(target: str, of: dict[str, float]) -> Column:
        w = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
        return F.sum(F.element_at(w, F.col(model)) * F.col(target)).alias(target)
    names = sorted({m for of in weights.values() for m in of})
    return runs.where(F.col(model).isin(names)).groupBy(key).agg(*[weighted(t, of) for t, of in weights.items()])


def blend_series(a: Column, b: Column, weight: float) -> Column:
    """(1-w)·a + w·b."""
    return (F.lit(1.0) - F.lit(weight)) * a + F.lit(weight) * b


def blend_scan(wide: DataFrame, y: str, base: str, variants, weights) -> DataFrame:
    """R² and RMSE of (1-w)·base + w·variant for every variant and
    weight, from ONE aggregate of sufficient statistics per variant.

    With d = y - base and e = variant - base, SSE(w) = Σd² - 2wΣde + w²Σe²,
    so the weight grid never multiplies the rows: the data is read once,
    the grid is applied to a (variants × weights)-row table.
    """
    yc = F.col(y)
    aggs = []
    for v in variants:
        # every sum, the count and the variance see the same rows: all three values present
        usable = yc.isNotNull() & F.col(base).isNotNull() & F.col(v).isNotNull()
        d, e = yc - F.col(base), F.col(v) - F.col(base)
        aggs += [F.count_if(usable).alias(f"n__{v}"), F.var_pop(F.when(usable, yc)).alias(f"var__{v}"),
                 F.sum(F.when(usable, d * d)).alias(f"dd__{v}"), F.sum(F.when(usable, d * e)).alias(f"de__{v}"),
                 F.sum(F.when(usable, e * e)).alias(f"ee__{v}")]
    stats = wide.agg(*aggs)
    rows = [F.struct(F.lit(v).alias("variant"), F.col(f"n__{v}").alias("n"), F.col(f"var__{v}").alias("var_y"),
                     F.col(f"dd__{v}").alias("dd"), F.col(f"de__{v}").alias("de"), F.col(f"ee__{v}").alias("ee"))
            for v in variants]
    t = stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    t = t.select("*", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight"))
    w = F.col("weight")
    sse = F.col("dd") - F.lit(2.0) * w * F.col("de") + w * w * F.col("ee")
    return t.select("variant", "weight",
                    (F.lit(1.0) - F.try_divide(sse, F.col("n") * F.col("var_y"))).alias("r2"),
                    F.sqrt(F.try_divide(F.greatest(sse, F.lit(0.0)), F.col("n"))).alias("rmse"))


def macro_scan(scan: DataFrame, other_scores: DataFrame, score: str = "r2") -> DataFrame:
    """A scan of one target with the macro average over all targets.
    `other_scores` is one row with the fixed scores of the other targets."""
    others = other_scores.columns
    total = sum((F.col(c) for c in others), F.col(score))
    # one row of fixed scores beside a (variants x weights)-row scan
    return (scan.join(F.broadcast(other_scores), F.lit(True))
            .withColumn("avg_spatial", total / F.lit(float(len(others) + 1))).drop(*others))


def estimated_scan(scan: DataFrame, other_scores: DataFrame, anchors: DataFrame, feature_count: int,
                   target: str = "drp", digits: int = 9) -> DataFrame:
    """M18 whole: the scan of `target` with the macro average, the estimate of
    the public score from `anchors` (A23) and `place`, the row's number by
    average, target score and estimate (highest first; what is equal to
    `digits` digits goes by variant and weight).

    `other_scores` is one row, `r2_<target>` of each other target. The rank is
    one window over the scan's own grid of variants and weights, whose size the
    call sets; the data was read once by `blend_scan`.
    """
    others = other_scores.columns
    mean = sum((F.col(c) for c in others), F.col(f"r2_{target}")) / F.lit(float(len(others) + 1))
    row = (scan.withColumnRenamed("r2", f"r2_{target}").join(F.broadcast(other_scores), F.lit(True))
           .withColumn("avg_spatial", mean).withColumn("feature_count", F.lit(feature_count)))
    keys = [F.round(c, digits).desc_nulls_last() for c in ("avg_spatial", f"r2_{target}", "estimate")]
    return (profile_estimate(row, anchors).withColumn("place", F.row_number().over(Window.orderBy(*keys, "variant", "weight")))
            .drop("feature_count", *others))
