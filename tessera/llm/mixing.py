r"""Operator 6: mix sources to target weights, by Sainte-Lague apportionment.

Sizes are word counts (`[^\x20\x09-\x0D]+`). Sources, by code point with null
last, weigh `weights` in turn and share `share` times all sizes; a target
stops at `ceiling` times its source's size and the excess is shared again by
weight until none is above.

Method. Each source is dealt by a seeded hash into shards of about
`shard_tokens`, and each shard's documents, in seeded order, form a line of
tokens cut into equal blocks (`block_tokens`; unless given, the least target
makes 1000 blocks). All blocks go to the shards by highest quotients votes /
(2k + 1), which gives every shard an integer quota. The divisor is found by
aggregates that try 32 values at once; only the quotients between the last two
values are sorted. A shard takes its whole line quota // blocks times, and the
first quota % blocks blocks of its seeded line once more; what a document
gives is the overlap of its tokens with the blocks, so no row is copied and no
task holds more than a shard.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; null ids are allowed; of wholly equal rows it isn't defined
which takes what, only how much they take together; sources of size 0 take
nothing; other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.session import cut_lineage

PROBES = 32


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0,
        seed: int = 17, shard_tokens: int = 1_000_000, block_tokens: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, quota, n_blocks, taken."""
    sized = cut_lineage(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long").alias("size"))
        .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size")))
    aimed = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, ceiling)
    least = aimed.filter("target > 0").agg(F.min("target")).first()[0]
    block = block_tokens or max(1, min(2048, int((least or 1) / 1000)))

    sources = aimed.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1)).cast("long"))
    dealt = (sized.join(sources, sized["source"].eqNullSafe(sources["source"]))
             .select("doc_id", sized["source"], "size", "draw", "source_size", "target",
                     F.pmod(F.xxhash64("draw"), "shards").alias("shard")))
    shards = (dealt.groupBy("source", "shard")
              .agg(F.sum("size").alias("tokens"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
              .withColumn("n_blocks", F.greatest(F.round(F.col("tokens") / block), F.signum("tokens")).cast("long"))
              .withColumn("votes", F.when(F.col("tokens") > 0,
                                          F.col("target") / F.col("source_size") * F.col("n_blocks")).otherwise(0.0)))
    parties = cut_lineage(shards.withColumn("cap", F.floor(F.col("n_blocks") * ceiling).cast("long")))
    return _taken(dealt, apportion(parties).select("source", "shard", "tokens", "n_blocks", "quota"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """source, source_size, weight, target. Each round is one aggregate; sources stay at their ceiling once there."""
    order = F.asc_nulls_last("source")
    ranked = numbered(sources.orderBy(order), "rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut_lineage(ranked.select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * ceiling
    total, weight_sum = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * (total or 0)
    level, closed = (total / weight_sum if weight_sum else 0.0), -1
    while True:
        over = F.col("weight") * level > cap
        n, held, free = table.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == closed or not free:
            break
        closed, level = n, (total - (held or 0.0)) / free
    return table.withColumn("target", F.least(F.col("weight") * level, cap))


def numbered(sorted_rows: DataFrame, name: str) -> DataFrame:
    """Rows with their number in the sort order; the sort stays distributed."""
    schema = StructType([*sorted_rows.schema.fields, StructField(name, LongType())])
    return sorted_rows.sparkSession.createDataFrame(
        sorted_rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


def _seats(votes: Column, divisor) -> Column:
    """Quotients votes / (2k + 1), k below the party's cap, that are `divisor` or more."""
    return F.least(F.floor((votes / divisor + 1) / 2).cast("long"), F.col("cap"))


def apportion(parties: DataFrame) -> DataFrame:
    """parties (source, shard, votes, ...) with `quota`: round(sum of votes) seats by highest quotients.

    With a column `cap`, a party at its cap has no further quotients, so what it
    can't take goes to the next highest ones; caps bound the seats in all.
    """
    given_columns = parties.columns
    wanted = int((parties.agg(F.sum("votes")).first()[0] or 0.0) + 0.5)
    parties = parties.withColumn("cap", F.least("cap", F.lit(wanted)) if "cap" in given_columns else F.lit(wanted).cast("long"))
    caps, most, least = parties.agg(
        F.sum(F.when(F.col("votes") > 0, F.col("cap"))), F.max("votes"),
        F.min(F.when((F.col("votes") > 0) & (F.col("cap") > 0), F.col("votes") / (2 * F.col("cap") + 1)))).first()
    seats = min(wanted, caps or 0)
    if not seats:
        return parties.withColumn("quota", F.lit(0).cast("long")).select(*given_columns, "quota")
    # at `low` every party is at its cap, at `high` no party has a seat
    low, high = least * 0.999, most * 1.001
    given, reach = 0, None
    while high / low > 1 + 1e-12 and (reach is None or reach - given > 1000):
        tries = [low * (high / low) ** (k / (PROBES + 1)) for k in range(1, PROBES + 1)]
        sums = parties.agg(*(F.sum(_seats(F.col("votes"), t)) for t in tries)).first()
        for t, s in zip(tries, sums):
            if s >= seats:
                low, reach = t, s
            else:
                high, given = t, s
                break
    sure = parties.withColumn("quota", _seats(F.col("votes"), high))
    open_ = (sure.filter(_seats(F.col("votes"), low) > F.col("quota"))
             .select("source", "shard", "votes", F.explode(F.sequence("quota", _seats(F.col("votes"), low) - 1)).alias("k"))
             .select("source", "shard", (F.col("votes") / (2 * F.col("k") + 1)).alias("quotient")))
    extra = (numbered(open_.orderBy(F.desc("quotient"), F.asc_nulls_last("source"), "shard"), "place")
             .filter(F.col("place") < seats - given).groupBy("source", "shard").agg(F.count("*").alias("more")))
    return (sure.alias("p").join(extra.alias("e"), F.expr("p.source <=> e.source and p.shard = e.shard"), "left")
            .select("p.*", F.coalesce("e.more", F.lit(0)).alias("more"))
            .withColumn("quota", F.col("quota") + F.col("more")).select(*given_columns, "quota"))


def _taken(dealt: DataFrame, quota: DataFrame) -> DataFrame:
    line = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size")
    placed = dealt.withColumn("stop", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    both = placed.alias("d").join(quota.alias("q"), F.expr("d.source <=> q.source and d.shard = q.shard"))
    rounds = F.when(F.col("n_blocks") > 0, F.floor(F.col("quota") / F.col("n_blocks"))).otherwise(0)
    # the first `left` blocks of the line end at this token
    left = F.col("quota") - rounds * F.col("n_blocks")
    reach = F.when(F.col("n_blocks") > 0, F.floor(left * F.col("tokens") / F.col("n_blocks"))).otherwise(0)
    once_more = F.greatest(F.least("stop", reach) - (F.col("stop") - F.col("size")), F.lit(0))
    return both.select("d.doc_id", "d.source", "d.size", "d.source_size", "d.target", "d.shard", "q.quota", "q.n_blocks",
                       (F.col("size") * rounds + once_more).cast("long").alias("taken"))
