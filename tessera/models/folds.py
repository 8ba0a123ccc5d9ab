"""Train/test splits and cross-validation folds (M1-M3).

Assignments are pure functions of a key (no `randomSplit`, no
`monotonically_increasing_id`), so they are stable under repartitioning,
task retries and re-reads. The integer hash is a Lehmer step modulo the
Mersenne prime 2^31-1; it is written the same way in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage

MODULUS = 2147483647
MULTIPLIER = 48271


def int_hash(key, seed: int = 0) -> Column:
    """Deterministic non-negative hash of an integer key (< 2^31)."""
    k = F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(MODULUS))
    return F.pmod(k * F.lit(MULTIPLIER) + F.lit(seed), F.lit(MODULUS))


def int_hash_sql(key: str, seed: int = 0) -> str:
    return f"((({key} % {MODULUS}) * {MULTIPLIER} + {seed}) % {MODULUS})"


def train_test_split(df: DataFrame, key: str, train_pct: int = 70, seed: int = 42) -> DataFrame:
    """M1: `split` = 'train' for about train_pct % of keys, else 'test'."""
    b = F.pmod(int_hash(key, seed), F.lit(100))
    return df.withColumn("split", F.when(b < train_pct, F.lit("train")).otherwise(F.lit("test")))


def random_kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """M3: shuffled folds by hashing the row key."""
    return df.withColumn(out, F.pmod(int_hash(key, seed), F.lit(k)).cast("int"))


def fold_assignment(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """M2 (assignment table): one row per group with its fold.

    Groups are ranked by size (desc, then key) and dealt in a
    snake order (0..k-1, k-1..0, ...), so fold sizes stay close. The rank
    runs over the *group* table (one row per group, far fewer than rows)
    as a range-partitioned sort followed by `zipWithIndex` (one small job
    counts each sorted partition, then every partition numbers its own
    rows), so no single task sees the whole table.
    """
    # the group table is small (one row per group) and is used twice: cut it
    # once so the row-level input is aggregated a single time
    sizes = cut_lineage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))
    # (size desc, key) is a total order, so the ranks are deterministic
    ordered = sizes.orderBy(F.col("_n").desc(), F.col(group)).select(group)
    schema = StructType([ordered.schema[group], StructField("_r", LongType(), False)])
    ranked = df.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda t: (t[0][0], t[1])), schema)
    pos = F.pmod(F.col("_r"), F.lit(2 * k))
    snake = F.when(pos < k, pos).otherwise(F.lit(2 * k - 1) - pos).cast("int")
    return cut_lineage(ranked.select(group, snake.alias(out)))


def group_kfold(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """M2: spatially grouped folds — a group never spans two folds. The
    assignment table joins back on the group key (one row per group)."""
    return df.join(fold_assignment(df, group, k, out), group, "left")
