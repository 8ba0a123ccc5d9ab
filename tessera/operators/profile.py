"""Data profiling (A5-A15, A17): missingness, describe, correlations,
quantile clipping, imputation, histograms, box statistics.

Each profile is one aggregate pass producing one small row (or one row
per column / bin), computed by partial aggregation on the executors.
Statistics that feed a second pass (quantiles, medians, min/max) come
back to the driver as a single row and re-enter the plan as literals —
the only driver traffic is that row.

Exact quantiles use one distributed sort (`quantiles.exact_quantiles`)
rather than Spark's exact
`percentile`, whose single value->count map per group would put a whole
column into one task for a global quantile. `exact=False` switches to
`percentile_approx`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import complement_medians, exact_quantiles


def _pct(x: Column, qs, exact: bool) -> Column:
    if exact:
        return F.percentile(x, F.array(*[F.lit(float(q)) for q in qs]))
    return F.percentile_approx(x, F.array(*[F.lit(float(q)) for q in qs]), 100000)


def missing_report(df: DataFrame, cols) -> DataFrame:
    """A5: NULL count and percentage per column — one aggregate, then unpivot."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["_n"], list(cols), "column", "n_missing")
    return long.select("column", "n_missing",
                       F.round(F.col("n_missing") / F.col("_n") * 100, 6).alias("pct_missing"))


def describe(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear), max per column.
    (`DataFrame.summary()` uses approximate quartiles; this is exact.) One
    aggregate for the moments, one sort for the quartiles."""
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).cast("double").alias(f"{c}__min"),
                 F.max(x).cast("double").alias(f"{c}__max")]
    wide = df.agg(*aggs)
    qs = multi_quantiles(df, cols, (0.25, 0.5, 0.75), exact)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                     F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                     F.col(f"{c}__min").alias("min"), F.lit(qs[c][0]).cast("double").alias("p25"),
                     F.lit(qs[c][1]).cast("double").alias("p50"), F.lit(qs[c][2]).cast("double").alias("p75"),
                     F.col(f"{c}__max").alias("max")) for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: Columns of a strip of the co-moment matrix, and first-step shares of its merge.
STRIP, SHARES = 32, 16


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pairwise-complete Pearson correlation for every pair a < b (rows
    where either side is NULL or NaN are left out; NULL without two rows or
    without variance).

    One pass: each task sums up its part of the co-moment matrix (rows of
    pairs, means, squared and cross deviations) batch by batch as matrix
    products; the parts are merged strip by strip, pairwise and exactly in
    form, so the plan has the same size for three columns as for hundreds.
    """
    cols = list(cols)
    part = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(_moments(len(cols)), MOMENTS)
    share = F.pmod("part", F.lit(SHARES))
    some = part.withColumn("share", share).groupBy("strip", "share").applyInArrow(_merged(len(cols)), MOMENTS)
    return some.groupBy("strip").applyInArrow(_correlations(cols), "col_a string, col_b string, corr double")


MOMENTS = "strip int, part int, data binary"


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Co-moments (n, mean a, mean b, aa, bb, ab) of two sets of rows, for all pairs at once."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    da, db = b[1] - a[1], b[2] - a[2]
    cross = a[0] * share
    return np.stack((n, a[1] + da * share, a[2] + db * share, a[3] + b[3] + da * da * cross, a[4] + b[4] + db * db * cross,
                     a[5] + b[5] + da * db * cross))


def _batch_moments(x: np.ndarray) -> np.ndarray:
    seen = ~np.isnan(x)
    center = np.where(seen.any(axis=0), np.nansum(np.where(seen, x, 0.0), axis=0) / np.maximum(seen.sum(axis=0), 1), 0.0)
    d, m = np.where(seen, x - center, 0.0), seen.astype(float)
    n, s = m.T @ m, d.T @ m               # s[a, b]: sum of a where b is there, too
    q, cross = (d * d).T @ m, d.T @ d
    safe = np.maximum(n, 1)
    return np.stack((n, np.where(n > 0, center[:, None] + s / safe, 0.0), np.where(n > 0, center[None, :] + s.T / safe, 0.0),
                     np.maximum(q - s * s / safe, 0.0), np.maximum(q.T - s.T * s.T / safe, 0.0), cross - s * s.T / safe))


def _moments(k: int):
    def run(batches):
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1) if len(batch) else np.zeros((0, k))
            if len(x):
                total = _merge(total, _batch_moments(x))
        number = TaskContext.get().partitionId()
        for strip, a in enumerate(range(0, k, STRIP)):
            yield pa.RecordBatch.from_pydict({"strip": pa.array([strip], pa.int32()), "part": pa.array([number], pa.int32()),
                                              "data": pa.array([np.ascontiguousarray(total[:, a:a + STRIP]).tobytes()], pa.binary())})
    return run


def _strip(table: pa.Table, k: int) -> np.ndarray:
    """Merged in the order of the parts, so that a retried task gives the same digits."""
    total = None
    for row in table.select(["part", "data"]).sort_by("part").to_pylist():
        m = np.frombuffer(row["data"], float).reshape(6, -1, k)
        total = m if total is None else _merge(total, m)
    return total


def _merged(k: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"strip": table.column("strip").slice(0, 1), "part": pa.array([table.column("share")[0].as_py()], pa.int32()),
                         "data": pa.array([_strip(table, k).tobytes()], pa.binary())})
    return run


def _correlations(cols: list[str]):
    def run(table: pa.Table) -> pa.Table:
        first = table.column("strip")[0].as_py() * STRIP
        n, _, _, aa, bb, ab = _strip(table, len(cols))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.clip(ab / np.sqrt(aa * bb), -1.0, 1.0)
        r[(n < 2) | (aa <= 0) | (bb <= 0)] = np.nan
        a, b = np.triu_indices(len(r), first + 1, len(cols))
        out = r[a, b]
        return pa.table({"col_a": pa.array([cols[first + i] for i in a], pa.string()), "col_b": pa.array([cols[j] for j in b], pa.string()),
                         "corr": pa.array(out, pa.float64(), mask=np.isnan(out))})
    return run


def distinct_count(df: DataFrame, cols, exact: bool = True) -> Column:
    """Number of distinct value combinations (HyperLogLog++ if not exact)."""
    if exact:
        return F.count_distinct(*[F.col(c) for c in cols])
    return F.approx_count_distinct(F.struct(*[F.col(c) for c in cols]))


def quantiles(df: DataFrame, col: str, qs, exact: bool = True) -> list[float]:
    """The listed quantiles of one column (linear interpolation)."""
    if exact:
        return exact_quantiles(df, col, qs).get((), [None] * len(qs))
    row = df.agg(_pct(F.col(col), qs, exact).alias("q")).first()
    return list(row["q"]) if row["q"] is not None else [None] * len(qs)


def quantile_clip(df: DataFrame, col: str, lower: float = 0.01, upper: float = 0.99,
                  out: str | None = None, exact: bool = True) -> DataFrame:
    """A10: clip to the [lower, upper] quantiles (linear); NULL stays NULL."""
    lo, hi = quantiles(df, col, (lower, upper), exact)
    x = F.col(col)
    if lo is None:
        return df.withColumn(out or col, x)
    return df.withColumn(out or col, F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))))


def multi_quantiles(df: DataFrame, cols, qs, exact: bool = True) -> dict[str, list[float]]:
    """Quantiles of several columns in one selection: the columns are
    unpivoted to (column, value) and the column name becomes the group."""
    if not exact or len(cols) == 1:
        return {c: quantiles(df, c, qs, exact) for c in cols}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "_col", "_v")
    res = exact_quantiles(long, "_v", qs, by=["_col"])
    return {c: res.get((c,), [None] * len(qs)) for c in cols}


def medians(df: DataFrame, cols, exact: bool = True) -> dict[str, float]:
    """The median of each column (one selection for all columns)."""
    return {c: v[0] for c, v in multi_quantiles(df, cols, (0.5,), exact).items()}


def median_impute(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    """Fill each numeric column with its median."""
    m = medians(df, cols, exact)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m[c]).cast("double")) for c in cols if m[c] is not None})


def fold_median_impute(df: DataFrame, cols, fold: str, folds) -> DataFrame:
    """For rows of fold f, fill with the medians of the *other* folds
    (the fold's training part), so no held-out value leaks into its own fill.

    The medians come from one sort of the columns by complement ranks
    (`quantiles.complement_medians`); the k-row result joins back on the fold.
    """
    per = {(r["_held"], r["_col"]): r["median"] for r in complement_medians(df, cols, fold, folds).collect()}  # folds x columns
    rows = [(int(f), *[per.get((int(f), c)) for c in cols]) for f in folds]
    schema = ", ".join(["_held int"] + [f"`_med_{c}` double" for c in cols])
    meds = df.sparkSession.createDataFrame(rows, schema)  # k rows
    j = df.join(meds, df[fold] == meds["_held"], "left").drop("_held")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols}).drop(
        *[f"_med_{c}" for c in cols])


def histogram(df: DataFrame, col: str, bins: int = 50, log: bool = False, label: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max]; the top edge belongs to the
    last bin. `log=True` bins log1p(x) (skewed target). Empty bins are
    listed with count 0 (the bin list is a fixed-size spine). Each row also
    carries the variable's statistics: n, mean, median, sample std, min, max.

    NULL, NaN and infinite values (of log1p(x), too) are neither binned nor
    part of the statistics; a column of nothing else gives no rows.
    """
    raw = F.log1p(F.col(col).cast("double")) if log else F.col(col).cast("double")
    x = F.when(~F.isnan(raw) & (F.abs(raw) != float("inf")), raw)
    values = df.select(x.alias("_x"))
    mm = values.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("_x").alias("n"), F.avg("_x").alias("mean"),
                    F.stddev_samp("_x").alias("std")).first()
    name = label or col
    spark = df.sparkSession
    if mm["lo"] is None:
        return spark.createDataFrame([], "variable string, bin int, lo double, hi double, count bigint, n bigint, mean double, "
                                         "median double, std double, min double, max double")
    lo, hi = float(mm["lo"]), float(mm["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("_x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = values.where(F.col("_x").isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    stats = {"n": F.lit(mm["n"]).cast("bigint"), "mean": F.lit(mm["mean"]), "median": F.lit(quantiles(values, "_x", (0.5,))[0]),
             "std": F.lit(mm["std"]).cast("double"), "min": F.lit(lo), "max": F.lit(hi)}
    return (spine.join(counts, "bin", "left")
            .select(F.lit(name).alias("variable"), "bin",
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"), *[v.alias(k) for k, v in stats.items()]))


def box_stats(df: DataFrame, col: str, whisker: float = 1.5, exact: bool = True) -> DataFrame:
    """Quartiles, IQR whiskers (most extreme data point within
    1.5·IQR of the box) and the outlier count — two aggregate passes."""
    q1, q2, q3 = quantiles(df, col, (0.25, 0.5, 0.75), exact)
    if q1 is None:
        return df.sparkSession.createDataFrame(
            [], "variable string, q1 double, median double, q3 double, iqr double, "
                "whisker_low double, whisker_high double, n_outliers bigint")
    iqr = q3 - q1
    lo, hi = q1 - whisker * iqr, q3 + whisker * iqr
    x = F.col(col)
    return df.agg(
        F.lit(col).alias("variable"), F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
        F.lit(iqr).alias("iqr"),
        F.min(F.when(x >= lo, x)).cast("double").alias("whisker_low"),
        F.max(F.when(x <= hi, x)).cast("double").alias("whisker_high"),
        F.count_if((x < lo) | (x > hi)).alias("n_outliers"))


def area_mean_series(grid: DataFrame, time_col: str, value_cols) -> DataFrame:
    """Mean over all cells per time step, and their number."""
    return grid.groupBy(time_col).agg(*[F.avg(c).alias(c) for c in value_cols], F.count(F.lit(1)).alias("n_cells"))


def extract_coverage(df: DataFrame, dataset: str, cols) -> DataFrame:
    """Per dataset — rows, rows with every variable, and min / max /
    missing per variable."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(complete).alias("n_complete")]
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_missing")]
    return df.groupBy(dataset).agg(*aggs)
