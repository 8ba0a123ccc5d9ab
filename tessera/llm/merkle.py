"""Operator 11: Merkle dataset manifest by sibling-shift self-joins.

Every row is a leaf; the leaves of a source, by doc_id, form a tree of
`fanout` children a node, and the sources' subroots, by source, form a tree
above them. A level is one table (grp, idx, n, digest). Each node computes the
indices of its run from its own (`idx XOR 1` for two children, the slot
offsets otherwise) and meets those rows by an equijoin on (grp, index); the
row in slot zero then emits the parent. What a node met is its step of every
inclusion proof below it, so proofs go back down by equijoins on the parent's
index, and no task ever holds a source.

Leaves are numbered by one range sort over (source, doc_id, leaf): positions
within the sorted partitions plus the counts of the partitions before, so a
source that holds most rows is spread over many tasks.

Edge cases. A null column is hashed as `-`; an empty text as `0:`. A text of
any length is one leaf. Null sources are a source of their own, before all
others; null ids come first in it and are never recomputed. Rows that share
an id are ordered by leaf; equal rows are leaves of their own whose proofs may
be swapped among them. An empty table has no rows and no root. Other columns
are ignored, so their names cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut_lineage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
STEP = "array<struct<before:binary,after:binary>>"


def hashed(value: Column) -> Column:
    """H of a binary that stands for hex text: the digest, again as bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(value)), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(columns: list[Column]) -> Column:
    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def fold(digest: Column, path: Column) -> Column:
    """Digest that a proof leads to from a leaf's digest."""
    return F.aggregate(path, digest, lambda d, step: hashed(F.concat(step["before"], d, step["after"])))


def proof_text(path: Column) -> Column:
    """Hex digests of all siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: as_hex(F.concat(s["before"], s["after"]))), "")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, the place of each row in its `grp` by `order` from 0, and n, the rows of the group.

    Equal rows differ by a running number, so even they may lie in several ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, "grp", *order, "_row")
    placed = cut_lineage(ranged.sortWithinPartitions("grp", *order).drop("_row")
                         .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
              .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
              .withColumn("n", F.sum("_rows").over(Window.partitionBy("grp"))))
    return (placed.join(starts, ["grp", "_part"])
            .withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_part", "_first", "_rows", "_before"))


class Tree(NamedTuple):
    levels: list[DataFrame]   # grp, idx, before, after: what each node met, from the leaves up
    roots: DataFrame          # grp, height, digest: one row a group


def _met(level: DataFrame, fanout: int) -> DataFrame:
    """Each node of a group of several with its run: the equijoin of a level with itself."""
    run = F.floor(F.col("idx") / fanout) * fanout
    wanted = level.select("grp", "idx", "n", F.explode(F.sequence(run, F.least(run + fanout - 1, F.col("n") - 1))).alias("sibling"))
    there = level.select("grp", F.col("idx").alias("sibling"), "digest")
    runs = (wanted.join(there, ["grp", "sibling"]).groupBy("grp", "idx", "n")
            .agg(F.array_sort(F.collect_list(F.struct("sibling", "digest"))).alias("run")))

    def joined(keep=None) -> Column:
        kept = F.col("run") if keep is None else F.filter("run", lambda s: keep(s["sibling"]))
        return F.aggregate(kept, F.lit("").cast("binary"), lambda out, s: F.concat(out, s["digest"]))
    return runs.select(
        "grp", "idx", "n", joined(lambda s: s < F.col("idx")).alias("before"), joined(lambda s: s > F.col("idx")).alias("after"),
        F.when(F.col("idx") % fanout == 0, hashed(joined())).alias("parent"))


def build(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """Trees over (grp, idx, n, digest), one for each group; a round for each level, of which there are log(n)."""
    level, levels, roots = nodes.select("grp", "idx", "n", "digest"), [], []
    while True:
        roots.append(level.where("n = 1").select("grp", F.lit(len(levels)).alias("height"), "digest"))
        if (level.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        met = cut_lineage(_met(level.where("n > 1"), fanout))
        levels.append(met.drop("n", "parent"))
        level = met.where(F.col("parent").isNotNull()).select(
            "grp", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.col("parent").alias("digest"))
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Tree(levels, out)


def paths(levels: list[DataFrame], roots: DataFrame, leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """`leaves` (grp, idx, ...) with their proofs: roots (grp, height, path above, ...) go down level by level."""
    carried = [c for c in roots.columns if c not in ("grp", "height")]

    def ended(height: int) -> DataFrame:
        return roots.where(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("idx"), *carried)
    above = ended(len(levels))
    for k in reversed(range(len(levels))):
        own = levels[k] if k else levels[k].join(leaves, ["grp", "idx"])
        rest = [c for c in own.columns if c not in ("before", "after")]
        step = F.array(F.struct("before", "after"))
        down = (own.withColumn("_up", F.floor(F.col("idx") / fanout)).join(above.withColumnRenamed("idx", "_up"), ["grp", "_up"])
                .withColumn("path", F.concat(step, "path")).select(*rest, *carried))
        alone = ended(k)
        above = down.unionByName(alone if k else alone.join(leaves, ["grp", "idx"]))
    return above if levels else above.join(leaves, ["grp", "idx"])


def manifest(docs: DataFrame, seen_text: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, seen, subroot, root (hex) and path, a row for each row of `docs`.

    `seen` is the leaf's digest with `seen_text` instead of the text (what an
    audit finds there), else the leaf itself; `fold(unhex(seen), path)` is the
    root that it leads to.
    """
    columns = [F.col(c) for c in COLUMNS]
    leaf = leaf_digest(columns)
    seen = leaf if seen_text is None else leaf_digest([*columns[:-1], seen_text])
    # A letter before each source lets nulls sort first as a group without nulls.
    leaves = cut_lineage(docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("grp"), "doc_id",
        leaf.alias("digest"), seen.alias("seen")))
    leaves = cut_lineage(numbered(leaves, ["doc_id", "digest"]))
    sources = build(leaves, fanout)
    named = sources.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "height", F.col("digest"))
    tops = cut_lineage(numbered(named, ["name"]))
    top = build(tops, fanout)
    root = top.roots.first()
    whole = top.roots.select("grp", "height", F.array().cast(STEP).alias("path"))
    under = paths(top.levels, whole, tops.select("grp", "idx", "name", F.col("height").alias("_height"), F.col("digest").alias("subroot")), fanout)
    subroots = cut_lineage(under.select(F.col("name").alias("grp"), F.col("_height").alias("height"), "subroot", "path"))
    found = paths(sources.levels, subroots, leaves.select("grp", "idx", "doc_id", F.col("digest").alias("leaf"), "seen"), fanout)
    return found.select(
        "doc_id", as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("seen")).alias("seen"), as_hex(F.col("subroot")).alias("subroot"),
        as_hex(F.lit(bytes(root["digest"]) if root else None).cast("binary")).alias("root"), "path")


def audit(docs: DataFrame, seen_text: Column, fanout: int = FANOUT) -> DataFrame:
    """manifest() with folded_root, the root that the seen text and the original siblings lead to, and verified."""
    folded = as_hex(fold(F.unhex("seen"), F.col("path")))
    return manifest(docs, seen_text, fanout).withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
