"""Exact quantiles by one distributed sort.

Spark's exact `percentile` merges one value->count map per group in a single
task, so a global quantile over a 100 TB column would need every distinct
value in one map. Here the values are sorted once by (group, value) into
ranges, with a random third sort key so that equal values may span ranges;
each row's place is its partition's offset plus its position in the partition,
and the wanted ranks are picked by number. No task holds a group and no group
state reaches the driver; it sees one row count per partition.

The result equals the linear interpolation of `percentile` / DuckDB's
`quantile_cont`. Infinities are values like any other; NULL and NaN are left
out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PARTITION_BITS = 33  # of monotonically_increasing_id: partition above, row below


def group_quantiles(df: DataFrame, col: str, probs, by=()) -> DataFrame:
    """by..., n, q (array of one quantile per prob), one row per group that has a value.

    Position h = (n-1)p, lo = floor(h), hi = ceil(h),
    q = (hi - h)·x[lo] + (h - lo)·x[hi] (the form Spark's `percentile` uses).
    """
    by = list(by)
    base = df.select(*by, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    placed = cut_lineage(base.withColumn("_tie", F.rand(11)).repartitionByRange(*by, "_x", "_tie")
                         .sortWithinPartitions(*by, "_x").select(*by, "_x", F.monotonically_increasing_id().alias("_m")))
    part = F.shiftrightunsigned("_m", _PARTITION_BITS)
    offsets, total = [], 0
    for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        offsets.append((r["p"], total))
        total += r["n"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _offset long")  # one row per partition
    placed = (placed.withColumn("_p", part).join(F.broadcast(table), "_p")
              .withColumn("_at", F.col("_offset") + F.col("_m").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))))
    stats = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_start"))
    low = [F.floor((F.col("n") - 1) * p) for p in probs]
    high = [F.ceil((F.col("n") - 1) * p) for p in probs]
    if by:
        g = stats.select(*[F.col(b).alias(f"_g_{b}") for b in by], "n", "_start")
        cond = [placed[b].eqNullSafe(g[f"_g_{b}"]) for b in by]
        ranked = placed.join(g, cond)
    else:
        first = stats.first()
        ranked = placed.withColumns({"n": F.lit(first["n"]), "_start": F.lit(first["_start"])})
    rank = F.col("_at") - F.col("_start")
    wanted = ranked.where(F.array_contains(F.array(*low, *high), rank)).withColumn("_rank", rank)
    picked = wanted.groupBy(*by, "n").agg(
        *[F.max(F.when(F.col("_rank") == a, F.col("_x"))).alias(f"_a{i}") for i, a in enumerate(low)],
        *[F.max(F.when(F.col("_rank") == b, F.col("_x"))).alias(f"_b{i}") for i, b in enumerate(high)])
    values = []
    for i, (p, a, b) in enumerate(zip(probs, low, high)):
        h = (F.col("n") - 1) * p
        values.append(F.when(a == b, F.col(f"_a{i}")).otherwise((b - h) * F.col(f"_a{i}") + (h - a) * F.col(f"_b{i}")))
    return picked.select(*by, "n", F.array(*values).alias("q"))


def exact_quantiles(df: DataFrame, col: str, probs, by=()) -> dict:
    """{group tuple: [q for each prob]}, for a few known groups (columns, folds); else use `group_quantiles`."""
    by = list(by)
    return {tuple(r[b] for b in by): list(r["q"]) for r in group_quantiles(df, col, probs, by).collect()}


def complement_medians(df: DataFrame, cols, fold: str, folds) -> DataFrame:
    """_held, _col, median: for each fold the median of each column over the rows of the *other* folds.

    All columns are sorted once, whatever the number of folds. A value's rank
    among the other folds is its rank among all less that among its fold, so
    counts by (column, sorted partition, fold) say which partition holds a
    fold's wanted ranks; only rows of those partitions are numbered, once for
    each rank wanted there. Rows without a fold, NULL and NaN are left out.
    """
    long = df.where(F.col(fold).isNotNull()).select(F.col(fold).alias("_f"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["_f"], list(cols), "_col", "_x").where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    placed = cut_lineage(long.withColumn("_tie", F.rand(11)).repartitionByRange("_col", "_x", "_tie").sortWithinPartitions("_col", "_x")
                         .select("_col", "_x", "_f", F.monotonically_increasing_id().alias("_m")))
    placed = placed.withColumn("_p", F.shiftrightunsigned("_m", _PARTITION_BITS))
    counts = cut_lineage(placed.groupBy("_col", "_p", "_f").agg(F.count(F.lit(1)).alias("n")))
    held = F.explode(F.array(*[F.lit(int(f)) for f in folds]))  # counts are copied, rows are not
    others = (counts.withColumn("_held", held).where(F.col("_f") != F.col("_held"))
              .groupBy("_held", "_col", "_p").agg(F.sum("n").alias("n")))
    so_far = Window.partitionBy("_held", "_col").orderBy("_p")
    ends = others.withColumns({"_end": F.sum("n").over(so_far), "_all": F.sum("n").over(Window.partitionBy("_held", "_col"))})
    half = (F.col("_all") - 1) / 2
    wanted = (ends.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(half), F.ceil(half)))))
              .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("n")))
              .select("_held", "_col", "_p", "_rank", (F.col("_rank") - F.col("_end") + F.col("n") + 1).alias("_place")))
    within = Window.partitionBy("_held", "_col", "_rank").orderBy("_m")
    found = (placed.join(wanted, ["_col", "_p"]).where(F.col("_f") != F.col("_held"))
             .withColumn("_at", F.row_number().over(within)).where(F.col("_at") == F.col("_place")))
    return found.groupBy("_held", "_col").agg((F.min("_x") / 2 + F.max("_x") / 2).alias("median"))
