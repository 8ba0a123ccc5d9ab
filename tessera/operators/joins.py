"""Key joins and source merging.

Joins are stated declaratively and the planner picks the strategy (AQE
turns a sort-merge join into a broadcast join at run time only when the
measured side is under the broadcast threshold, so nothing here
broadcasts a side whose size is not known). A fan-out guard is evaluated
lazily on the executors (`assert_true` over a map-side-combined count),
sharing the join's partitioning, so it costs neither an extra action nor an
extra shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import LEGACY_EPS


def join_by_index(left: DataFrame, right: DataFrame, key: str = "sample_id", how: str = "left") -> DataFrame:
    """Join on the surrogate id (left, inner, or spine-left)."""
    return left.join(right, key, how)


def unique_on(df: DataFrame, keys, what: str = "join key") -> DataFrame:
    """Raise at run time if `keys` repeat in `df` (one row per key expected).

    An aggregate rather than a window: the count (and `first` of the other
    columns, exact when the count is 1) is combined map-side, so a key that
    holds a third of all rows is never gathered into one task. Rows with a
    NULL key cannot match an equi-join and are dropped before the check.
    The check is a filter, so column pruning cannot remove it, and it is
    grouped on the join keys, so the join reuses its partitioning.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    agg = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_dup"), *[F.first(c).alias(c) for c in others])
    return (agg.where(F.assert_true(F.col("_dup") == 1, F.lit(f"duplicate {what}")).isNull())
               .select(*df.columns))


def join_keys_left(left: DataFrame, right: DataFrame, keys, suffix: str = "_old",
                   check_fanout: bool = True) -> DataFrame:
    """Left equi-join on several keys; colliding right columns get
    `suffix`. With `check_fanout` a repeated right key raises (a left join
    must not change the left row count)."""
    keys = list(keys)
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    r = right.withColumnsRenamed({c: c + suffix for c in clash})
    if check_fanout:
        r = unique_on(r, keys, "right key in left join")
    return left.join(r, keys, "left")


def full_concat(frames, key: str = "sample_id") -> DataFrame:
    """Column-wise concat of several tables by id (full outer joins);
    never zips partitions positionally."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "full")
    return out


def month_bucket_join(left: DataFrame, grid: DataFrame, keys, suffix: str = "_terra") -> DataFrame:
    """Equi-join on (cell..., month) with `suffix` on the grid's values."""
    keys = list(keys)
    vals = [c for c in grid.columns if c not in keys]
    g = grid.select(*keys, *[F.col(c).alias(c + suffix) for c in vals])
    return left.join(g, keys, "left")


def alignment_check(a: DataFrame, b: DataFrame, key: str, cols, tol: float = 1e-4) -> DataFrame:
    """One row — row counts, matched rows, max |a-b| per column and an
    `aligned` flag (equal counts, every row matched, all diffs <= tol)."""
    j = a.select(key, F.lit(1).alias("_in_a"), *[F.col(c).alias(f"_a_{c}") for c in cols]).join(
        b.select(key, F.lit(1).alias("_in_b"), *[F.col(c).alias(f"_b_{c}") for c in cols]), key, "full")
    out = j.agg(F.count("_in_a").alias("n_left"), F.count("_in_b").alias("n_right"),
                F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()).alias("n_matched"),
                *[F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).alias(f"max_d{c}") for c in cols])
    ok = (F.col("n_left") == F.col("n_right")) & (F.col("n_matched") == F.col("n_left"))
    for c in cols:
        ok = ok & (F.coalesce(F.col(f"max_d{c}"), F.lit(0.0)) <= tol)
    return out.withColumn("aligned", ok.cast("int"))


def coalesce_sources(api: DataFrame, official: DataFrame, key: str = "sample_id",
                     api_keep=(), official_keep=None, spine: DataFrame | None = None) -> DataFrame:
    """API first; the official source fills a row only where the API
    *green* band is missing (then all its bands are taken together); blue
    and red have no fallback; NDMI / MNDWI always come from the official
    bands. Adds `optical_source` in {'api', 'official', 'none'}.
    `api_keep` passes further columns through unchanged, `official_keep`
    (official column -> output name) those of the fallback source, so
    callers need no second join.
    With a `spine` (one row per key) both sources are left-joined onto it
    and the spine's columns lead the output: every join is on the same key,
    so the spine is shuffled once and the joins share its partitioning
    (a full outer join's coalesced key would force another shuffle)."""
    o = official.select(key, *[F.col(c).alias(f"off_{c}") for c in official.columns if c != key])
    if spine is None:
        j = api.join(o, key, "full")
        lead = [key]
    else:
        j = spine.join(api, key, "left").join(o, key, "left")
        lead = spine.columns
    use_off = F.col("green").isNull()

    def pick(api_col: str, off_col: str) -> Column:
        return F.when(use_off, F.col(off_col)).otherwise(F.col(api_col))

    n, g, s = F.col("off_nir"), F.col("off_green"), F.col("off_swir16")
    return j.select(
        *lead,
        F.col("blue"), F.col("red"),
        pick("green", "off_green").alias("green"),
        pick("nir08", "off_nir").alias("nir08"),
        pick("swir16", "off_swir16").alias("swir16"),
        pick("swir22", "off_swir22").alias("swir22"),
        ((n - s) / (n + s + F.lit(LEGACY_EPS))).alias("NDMI"),
        ((g - s) / (g + s + F.lit(LEGACY_EPS))).alias("MNDWI"),
        F.when(~use_off, F.lit("api")).when(F.col("off_green").isNotNull(), F.lit("official"))
         .otherwise(F.lit("none")).alias("optical_source"),
        *[F.col(c) for c in api_keep],
        *[F.col(f"off_{c}").alias(name) for c, name in (official_keep or {}).items()],
    )


def coverage_by_source(merged: DataFrame, source: str = "optical_source") -> DataFrame:
    """API rows, recovered rows, unrecoverable rows and their shares."""
    s = F.col(source)
    n = F.count(F.lit(1))
    return merged.agg(
        n.alias("n_rows"),
        F.count_if(s == "api").alias("n_api"),
        F.count_if(s == "official").alias("n_recovered"),
        F.count_if(s == "none").alias("n_unrecoverable"),
        F.round(F.count_if(s != "api") / n * 100, 6).alias("pct_api_missing"),
        F.round(F.count_if(s == "none") / n * 100, 6).alias("pct_unrecoverable"),
    )


def weight_grid(variants: DataFrame, weights) -> DataFrame:
    """Every variant with every weight of a fixed parameter grid — an
    `explode` of the literal grid on each variant row, not a join."""
    return variants.select("*", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight"))
