"""Tree learners, out-of-fold fitting and parameter search (M5-M7, M9, M12,
M19, M22, M23). Stacks, chains and the specialist are in `stack`.

Boosted models are batches of `boosting` (all folds, learners, targets and
trials of a query at once); forests are MLlib jobs over a frame whose lineage
is cut once. Predictions stay in Spark; nothing is collected except trees and
metric rows.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import regression_metrics
from ..operators.setops import union_rows
from ..session import cut_lineage
from . import boosting as bs
from .features import assemble

SEED = 42


def rf_regressor(label: str, num_trees: int = 100, max_depth: int = 8, features: str = "features",
                 seed: int = SEED) -> RandomForestRegressor:
    """M5: random forest (reference: 100 trees, seed 42)."""
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=num_trees,
                                 maxDepth=max_depth, seed=seed)


#: Iterations of the boosted learners and of the classifier, and trials of the search.
ITERATIONS, CLASSIFIER_ITERATIONS, TRIALS = 700, 250, 30

# Settings of the three boosted learners and of the classifier.
FAMILY = {
    "gbt_deep": dict(rate=0.025, depth=5, min_weight=8.0, row_share=0.8, column_share=0.7, l1=0.3, l2=2.0),
    "gbt_wide": dict(rate=0.025, depth=5, min_rows=20, row_share=0.8, column_share=0.7, l1=0.3, l2=2.0, shape="leaves", leaves=28),
    "gbt_plain": dict(rate=0.025, depth=5, l2=3.0, noise=1.0, shape="symmetric"),
}
CLASSIFIER = dict(rate=0.03, depth=5, l2=3.0, noise=1.0, shape="symmetric", logistic=True)


def learner_family(target: str, held: int | None = None, rows: str | None = None, iterations: int = ITERATIONS,
                   prefix: str = "pred_") -> list[bs.Spec]:
    """M6: three differently grown boosted trees (by level, by leaf, symmetric), one model each."""
    return [bs.Spec(prefix + name, target, held, rows, iterations, **setting) for name, setting in FAMILY.items()]


def regime_classifier(label: str, held: int | None = None, rows: str | None = None, iterations: int = CLASSIFIER_ITERATIONS,
                      name: str = "p_high") -> bs.Spec:
    """M7: P(label = 1)."""
    return bs.Spec(name, label, held, rows, iterations, **CLASSIFIER)


def folds_of(df: DataFrame, fold: str) -> list[int]:
    return sorted(r[0] for r in df.select(fold).distinct().collect())  # k small


#: Rows that a partition of a training table holds at most, about.
ROWS_A_PARTITION = 200_000


def prepare(df: DataFrame, features, label: str | None = None, key: str = "sample_id") -> DataFrame:
    """Assemble features, spread the rows (hash of the key, so a retried task
    rebuilds the same partition) and cut lineage once before repeated fits:
    over all cores at least, since AQE may have left a small table in one
    partition, and over as many partitions as the rows need."""
    d = df if label is None else df.where(F.col(label).isNotNull())
    d = assemble(d, features)
    cores = d.sparkSession.sparkContext.defaultParallelism
    spread = cut_lineage(d.repartition(cores, key))
    need = spread.count() // ROWS_A_PARTITION + 1
    return spread if need <= cores else cut_lineage(spread.repartition(need, key))


#: Rows a core that the forest fits running at once hold at most, about: a row is kept with its counts (650 bytes)
#: and, where node ids are cached, with its node of every tree, two passes' ids at a time (830 bytes).
FOREST_ROWS_A_CORE = 750_000


def fit_forest(df: DataFrame, learner, rows: int | None = None):
    """MLlib's forest of `df`. Where its rows fit in memory, each row's node of every tree is cached between the
    levels, instead of walking every tree from its root again; the forest is the same either way."""
    rows = df.count() if rows is None else rows
    cached = rows <= FOREST_ROWS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return learner.copy({learner.cacheNodeIds: cached}).fit(df)


def fits_at_once(rows: int, cores: int, folds: int, parallelism: int = 8) -> int:
    """How many fits of `rows` rows run side by side: as many as stay in memory together, so that none is spilled
    by its neighbours and read back on every level."""
    return max(1, min(parallelism, folds, FOREST_ROWS_A_CORE * cores // max(rows, 1)))


def fit_folds(df: DataFrame, learner, fold: str, parallelism: int = 8) -> dict:
    """One forest per held-out fold, trained on the other folds. The k fits
    are independent jobs submitted from up to `parallelism` driver threads (as
    `CrossValidator(parallelism=...)` does), so small jobs overlap."""
    sizes = {r[0]: r[1] for r in df.groupBy(fold).count().collect()}  # k small
    folds = sorted(sizes)
    rest = {f: sum(sizes.values()) - sizes[f] for f in folds}
    workers = fits_at_once(max(rest.values(), default=0), df.sparkSession.sparkContext.defaultParallelism, len(folds), parallelism)
    with ThreadPoolExecutor(max_workers=workers) as pool:
        models = list(pool.map(lambda f: fit_forest(df.where(F.col(fold) != f), learner, rest[f]), folds))
    return dict(zip(folds, models))


def spread(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows dealt out by a hash of the key, and lineage cut: joins may leave a table of many rows in few partitions
    (they are small), but each row goes through every tree when it is predicted."""
    return cut_lineage(df.repartition(F.col(key)))


def oof_boosted(df: DataFrame, features, target: str, fold: str, key: str = "sample_id", weight: str | None = "sample_weight",
                carry=(), iterations: int = ITERATIONS, learners=tuple(FAMILY)) -> DataFrame:
    """Out-of-fold predictions `pred_<learner>` of the rows with a target; all folds and learners are one batch."""
    rows = spread(df.where(F.col(target).isNotNull()), key)
    specs = [s for f in folds_of(rows, fold) for s in learner_family(target, f, iterations=iterations) if s.name[5:] in learners]
    fitted = bs.fit_batch(rows, features, specs, key, fold, weight)
    return bs.predict(rows, fitted, dict.fromkeys([key, fold, target, *carry]), fold)


def oof_predictions(df: DataFrame, learner, fold: str, key: str = "sample_id",
                    out: str = "prediction", name: str | None = None, parallelism: int = 8) -> DataFrame:
    """M9: for each fold f fit on the other folds and predict fold f; the
    k predicted slices are unioned (each row predicted exactly once)."""
    models = fit_folds(df, learner, fold, parallelism)
    parts = [m.transform(df.where(F.col(fold) == f)).select(key, fold, F.col("prediction").alias(out))
             for f, m in models.items()]
    res = union_rows(parts)
    return res if name is None else res.withColumn("model", F.lit(name))


def score(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """A18 on a prediction frame."""
    return df.groupBy(*by).agg(*regression_metrics(y, p))


def stack_insample(oof_wide: DataFrame, label: str, base_cols, weight: str | None = None,
                   alpha: float = 1.0) -> tuple[DataFrame, dict]:
    """Weighted ridge meta-model (α on the coefficients, free
    intercept; one Gram aggregate + a k×k solve) on all OOF rows, scored on
    the same rows — optimistic by construction; M13 is the honest version."""
    from .linear import ridge_fit, ridge_predict

    d = oof_wide.where(F.col(label).isNotNull())
    coef = ridge_fit(d, list(base_cols), label, weight, alpha=alpha)
    return ridge_predict(d, coef), coef


# The search space, as (kind, low, high); "log" is uniform in the logarithm.
SPACE = {
    "gbt_deep": dict(iterations=("int", 200, 800), rate=("log", 0.01, 0.2), depth=("int", 3, 6), row_share=("real", 0.5, 1.0),
                     column_share=("real", 0.5, 1.0), min_weight=("int", 1, 10)),
    "gbt_wide": dict(iterations=("int", 200, 800), rate=("log", 0.01, 0.2), leaves=("int", 15, 63), depth=("int", 3, 6),
                     row_share=("real", 0.5, 1.0), column_share=("real", 0.5, 1.0), min_rows=("int", 5, 100)),
    "gbt_plain": dict(iterations=("int", 200, 800), rate=("log", 0.01, 0.2), depth=("int", 3, 6), l2=("log", 1e-3, 10.0),
                      noise=("log", 1e-3, 10.0)),
}
SHAPES = {"gbt_deep": dict(l2=1.0), "gbt_wide": dict(l2=0.0, shape="leaves"), "gbt_plain": dict(shape="symmetric")}


def draw(space: dict, rng: random.Random) -> dict:
    """One setting from a space."""
    out = {}
    for name, (kind, low, high) in space.items():
        if kind == "int":
            out[name] = rng.randint(low, high)
        else:
            out[name] = math.exp(rng.uniform(math.log(low), math.log(high))) if kind == "log" else rng.uniform(low, high)
    return out


def param_search(df: DataFrame, features, targets, fold: str, trials: int = TRIALS, seed: int = SEED, key: str = "sample_id",
                 weight: str | None = None, log_target: bool = False, space: dict = SPACE) -> DataFrame:
    """Seeded random settings of each learner, for each target the mean RMSE over the left-out folds.

    All (target, learner, trial, fold) models are one batch. `log_target`
    learns log1p of the target; errors stay in its own unit. Returns a row
    per target, learner and trial; `best` marks the least mean error of each
    target and learner.
    """
    rows = cut_lineage(df)
    folds, specs, table = folds_of(rows, fold), [], []
    for target in targets:
        for learner in space:
            for trial in range(trials):
                setting = draw(space[learner], random.Random(f"{seed} {learner} {trial}"))
                for f in folds:
                    specs.append(bs.Spec("pred", target, f, log=log_target, seed=seed, **SHAPES[learner], **setting))
                    table.append((len(specs) - 1, target, learner, trial))
    names = df.sparkSession.createDataFrame([(
        *t, s.iterations, s.rate, s.depth, s.row_share, s.column_share, float(s.min_weight), s.min_rows, s.leaves, float(s.l2), float(s.noise),
    ) for t, s in zip(table, specs)], "model int, target string, learner string, trial int, iterations int, rate double, depth int, "
        "row_share double, column_share double, min_weight double, min_rows int, leaves int, l2 double, noise double")
    errors = bs.score_batch(rows, features, specs, key, fold, weight)
    setting = [c for c in names.columns if c != "model"]
    by_fold = names.join(errors.where("n > 0"), "model").groupBy(*setting).agg(
        F.array_sort(F.collect_list(F.sqrt(F.col("sse") / F.col("n")))).alias("rmse"))  # sorted, so the sum has one order
    mean = by_fold.select(*setting, (F.aggregate("rmse", F.lit(0.0), lambda a, x: a + x) / F.size("rmse")).alias("mean_rmse"))
    rank = F.row_number().over(Window.partitionBy("target", "learner").orderBy("mean_rmse", "trial"))
    return mean.withColumn("best", rank == 1)
