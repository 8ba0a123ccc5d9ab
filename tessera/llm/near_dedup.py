r"""Operator 9: near-duplicate classes by ProbMinHash, banding and verification.

Shingles are `shingle` consecutive words `[^\x20\x09-\x0D]+`, unchanged (a
text of fewer words, but not none, is one shingle). A shingle weighs the times
it occurs in the text. The similarity of two texts x and y is the probability
Jaccard similarity of their weights, in every step: the sum over the shared
shingles i of 1 / sum_j max(x_j / x_i, y_j / y_i). For shingles that occur once
it is the Jaccard similarity of the sets.

1. Signature. Each distinct shingle is a Poisson process whose rate is its
   weight; every arrival falls on one of `m` registers, and a register keeps
   its earliest arrival's shingle. A shingle's process ends as soon as its
   next arrival is later than the latest register of the text. Two texts agree
   in a register with the probability Jaccard similarity.
2. Banding. `m / rows` bands of `rows` registers; texts that share a band key
   are candidates. A bucket of up to `SMALL` texts gives all its pairs, a
   larger one the pairs of each member with the bucket's hub: the member that has
   most texts beside it in all its buckets, which is the likeliest to be near
   the others.
3. Verification. Candidates whose registers agree in less than `threshold`
   less MARGIN are far off (MARGIN is 4.9 standard deviations of the estimate
   at 0.8 and 96 registers); the others are linked if their similarity,
   computed from the shingles, is `threshold` or more. Shingles are made for
   texts with candidates only: a Bloom filter of bounded size tells their rows
   while the texts are read, so texts are never shuffled.
4. Large buckets whose members are still in several classes are finished
   exactly: members of different classes are compared if they share a shingle
   of their prefixes. Shingles are ordered from rare to common; if s and t are
   the weight shares of x and y from their first shared shingle on, the
   similarity is at most 1 / (1/s + 1/t - 1). So a prefix ends where the rest
   can't reach the threshold, and of two texts that first meet late no pair
   arises: pages of one template meet in what is theirs, not in the template.
   The same bound holds for the shares without the shingles that the other
   surely lacks, which bitmaps of the shingles tell.
   No pair of a large bucket that is alike is left out, and no bucket is
   compared whole.
5. Classes are the connected components of the links, found by min-label
   stars with reliable checkpoints; no link list reaches the driver. There are
   two rounds of links, whatever the input.

Equal texts are one node from the start, whatever their number.

Defined cases: null text is empty; empty texts are equal texts; a text of
separators alone has no shingle and is alike only to itself. The kept row of a
class has the least id (null first), of rows with that id the least text hash;
of wholly equal rows one is kept. Extra columns pass through `keep_one`. An
empty table gives empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import cut_lineage

from . import exchange as ex
from . import textvec as tv

SMALL = 8
MARGIN = 0.2
NODES_A_PARTITION = 20_000
#: Bits of the Bloom filter of wanted rows (at most), and bits for each of them.
BLOOM_BITS, BITS_A_ROW = 1 << 28, 16
#: Counters of the table by whose counts shingles are ordered; any order is exact, a truer one leaves fewer pairs.
COUNTERS = 1 << 20
#: 64-bit words of the bitmap that tells shingles which another text lacks.
WORDS = 16


def classes(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, m: int = 96, rows: int = 4) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size, kept; plus id, sub."""
    texts = _named(docs)
    signed = cut_lineage(
        texts.mapInArrow(_signer(shingle, m, rows), "node binary, id long, sub long, bands array<long>, sketch binary")
        .groupBy("node").agg(F.min(F.struct("id", "sub")).alias("first"), F.first("bands").alias("bands"),
                             F.first("sketch").alias("sketch")).withColumn("num", F.monotonically_increasing_id()))
    component = _components(signed, texts, shingle, threshold)
    member = (texts.select("node", "id", "sub")
              .join(signed.select("node", "num", "first").join(component, "num", "left"), "node")
              .withColumn("comp", F.coalesce("comp", "num")))
    whole = member.groupBy("comp").agg(F.min("first").alias("class"), F.count("*").alias("class_size"))
    return (member.join(whole, "comp")
            .select(_id("id").alias("doc_id"), _id("class.id").alias("class_id"), "class_size",
                    ((F.col("id") == F.col("class.id")) & (F.col("sub") == F.col("class.sub"))).alias("kept"),
                    "id", "sub"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each near-duplicate class; its columns stay."""
    kept = (classes(docs, **options).filter("kept").groupBy("id", "sub")
            .agg((F.count("*") > 1).alias("several")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                      F.coalesce(F.col("doc_id").cast("long"), F.lit(ex.NULL_ID)).alias("id"),
                      F.xxhash64(text).alias("sub")).join(kept, ["id", "sub"])
    once = row.filter("not several").select("row")
    first = row.filter("several").groupBy("id", "sub").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(first).select("row.*")


def _id(name: str):
    return F.when(F.col(name) != ex.NULL_ID, F.col(name))


def _named(docs: DataFrame) -> DataFrame:
    return ex.keyed(docs).withColumn("node", F.expr("substring(unhex(sha2(body, 256)), 1, 16)"))


# -- signatures ---------------------------------------------------------------

def shingles(j: tv.Joined, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text index, name and count of each distinct shingle, sorted by (text, name)."""
    w = tv.split_words(j, tv.SPACE_WORD)
    word = tv.word_hash(j, w)
    name = tv.run_names(word, size)
    pos = np.arange(len(name)) - w.first[w.doc[:len(name)]]
    at = np.flatnonzero(pos + size <= w.count[w.doc[:len(name)]])
    doc, name = w.doc[at], name[at]
    short = [(k, _short_name(word[w.first[k]:w.first[k] + w.count[k]]))
             for k in np.flatnonzero((w.count > 0) & (w.count < size))]
    if short:
        doc = np.concatenate((doc, [k for k, _ in short])).astype(np.int64)
        name = np.concatenate((name, np.array([x for _, x in short], np.uint64)))
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    first = np.flatnonzero(new)
    return doc[first], name[first], np.diff(np.append(first, len(doc)))


def _short_name(words: np.ndarray) -> np.uint64:
    return tv.run_names(words, len(words))[0]


def signatures(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """ProbMinHash registers, texts x m, as shingle names; 0 rows for texts without shingles."""
    earliest = np.full(texts * m, np.inf)
    holder = np.zeros(texts * m, np.uint64)
    time = np.zeros(len(name))
    active = np.arange(len(name))
    arrival = 0
    while len(active):
        arrival += 1
        d, n = doc[active], name[active]
        draw = tv.mix(n + np.uint64(arrival * 0x9E3779B97F4A7C15 % 2**64))
        time = time + -np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight[active]
        register = d * m + (tv.mix(draw) % np.uint64(m)).astype(np.int64)
        np.minimum.at(earliest, register, time)
        won = earliest[register] == time
        holder[register[won]] = n[won]
        open_ = time < earliest.reshape(texts, m).max(axis=1)[d]
        active, time = active[open_], time[open_]
    return holder.reshape(texts, m)


def _signer(size: int, m: int, rows: int):
    bands = m // rows
    salt = tv.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            body = batch.column("body").to_pylist()
            out, sketch = [], []
            for a, b in tv.chunked([len(t) for t in body]):
                doc, name, count = shingles(tv.joined(body[a:b]), size)
                sig = signatures(doc, name, count.astype(float), b - a, m)
                sketch.extend(s.tobytes() for s in (sig >> np.uint64(56)).astype(np.uint8))
                sig = sig.reshape(b - a, bands, rows)
                key = np.broadcast_to(salt, (b - a, bands))
                for r in range(rows):
                    key = tv.join_names(key, sig[:, :, r])
                some = np.bincount(doc, minlength=b - a) > 0
                out.extend(k if s else [] for k, s in zip(key.view(np.int64).tolist(), some))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("id"), batch.column("sub"), pa.array(out, pa.list_(pa.int64())),
                 pa.array(sketch, pa.binary())], names=["node", "id", "sub", "bands", "sketch"])
    return run


# -- candidates, links, classes -----------------------------------------------

def _components(signed: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(num, comp) of the nodes that have a link."""
    band = signed.select("num", F.explode("bands").alias("key"))
    shared = band.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # the texts that most others are near to lie in the largest buckets: those are the hubs
    beside = F.sum("n").over(Window.partitionBy("num"))
    bucket = cut_lineage(band.join(shared, "key").withColumn("central", F.struct(beside.alias("beside"), F.xxhash64("num").alias("h"))))
    small = bucket.filter(F.col("n") <= SMALL).select("key", "num")
    pair = (small.join(small.withColumnRenamed("num", "other"), "key").filter("num < other").select("num", "other"))
    large = bucket.filter(F.col("n") > SMALL).select("key", "num", "central")
    hub = large.groupBy("key").agg(F.max_by("num", "central").alias("other"))
    pair = cut_lineage(pair.unionByName(_ordered(large.join(hub, "key").select("num", "other"))).distinct())
    sets = _sets(bucket.select("num").distinct().join(signed.select("num", "node", "first", "sketch"), "num"), texts, size)
    # what follows is about the nodes in shared buckets alone: its partitions are sized by their number
    parts = max(4, sets.count() // NODES_A_PARTITION)
    links = cut_lineage(_verified(pair, sets, threshold))
    label = _connected(links, parts)
    member = _open_members(large, label)
    if member is None:
        return label
    more = _prefix_pairs(member, sets, threshold).distinct().join(pair, ["num", "other"], "left_anti")
    links = cut_lineage(_verified(cut_lineage(more), sets, threshold))
    if links.isEmpty():
        return label
    return _connected(label.filter("num <> comp").select("num", F.col("comp").alias("other")).unionByName(links), parts)


def _open_members(large: DataFrame, label: DataFrame) -> DataFrame | None:
    """(num, comp) of the members of large buckets that hold several classes; None if there are none."""
    member = large.join(label, "num", "left").select("key", "num", F.coalesce("comp", "num").alias("comp"))
    several = member.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    found = cut_lineage(member.join(several, "key").select("num", "comp").distinct())
    return None if found.isEmpty() else found


def _ordered(pair: DataFrame) -> DataFrame:
    return pair.filter("num <> other").select(F.least("num", "other").alias("num"), F.greatest("num", "other").alias("other"))


def _prefix_pairs(member: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes that share a shingle of their prefixes early enough to reach the threshold."""
    spark = member.sparkSession
    held = cut_lineage(member.join(sets.select("num", "names", "counts"), "num"))
    table = spark.sparkContext.broadcast(_frequencies(held))
    token = held.mapInArrow(_prefixes(table, threshold), "token long, num long, comp long, rest double, total long, bits array<long>")
    other = token.select("token", *(F.col(c).alias(f"other_{c}") for c in ("num", "comp", "rest", "total", "bits")))
    # the text with the larger share is on the left; there its share is past the half-way bound
    mine = token.filter(F.col("rest") >= 2 * threshold / (1 + threshold) - 1e-9)

    def lacking(x: str, y: str):
        """Shingles of x, at least, that y lacks: bits that only x has. Each weighs 1 or more."""
        return sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(WORDS)), F.lit(0))
    within = 1 + 1 / threshold + 1e-9
    shared = F.least(F.col("rest"), 1 - lacking("bits", "other_bits") / F.col("total"))
    other_shared = F.least(F.col("other_rest"), 1 - lacking("other_bits", "bits") / F.col("other_total"))
    met = mine.join(other, "token").filter(
        (F.col("comp") != F.col("other_comp")) & ((F.col("rest") > F.col("other_rest")) | ((F.col("rest") == F.col("other_rest")) & (F.col("num") < F.col("other_num"))))
        & (1 / F.col("rest") + 1 / F.col("other_rest") <= within) & (1 / shared + 1 / other_shared <= within))
    return _ordered(met.select("num", F.col("other_num").alias("other")))


def _frequencies(held: DataFrame) -> np.ndarray:
    """Counts of shingles by their names modulo COUNTERS, added up in tasks and by slice of the table."""
    slices = 16

    def run(batches):
        found = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for names in batch.column("names").to_pylist():
                found += np.bincount(np.frombuffer(names, np.uint32) % COUNTERS, minlength=COUNTERS)
        for i, part in enumerate(found.reshape(slices, -1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("data").to_pylist())
        return pa.table({"slice": table.column("slice").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})
    out = np.zeros((slices, COUNTERS // slices), np.int64)
    for r in held.select("names").mapInArrow(run, "slice int, data binary").groupBy("slice").applyInArrow(add, "slice int, data binary").collect():
        out[r["slice"]] = np.frombuffer(r["data"], np.int64)
    return out.ravel()


def _prefixes(table, threshold: float):
    """Shingles of each text's prefix, from rare to common, each with the share of the weight from it on, the text's
    weight and a bitmap of its shingles.

    If the first shingle that two texts share has the shares s and t, the
    similarity is at most 1 / (1/s + 1/t - 1), so s and t are `threshold` or more.
    """
    def run(batches):
        frequency = table.value
        for batch in batches:
            out = []
            for num, comp, names, counts in zip(*(batch.column(c).to_pylist() for c in ("num", "comp", "names", "counts"))):
                name, count = np.frombuffer(names, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64)
                order = np.lexsort((name, frequency[name % COUNTERS]))
                rest = (count.sum() - np.cumsum(count[order]) + count[order]) / max(1, count.sum())
                take = rest >= threshold - 1e-9
                mask = np.zeros(64 * WORDS, np.uint8)
                mask[tv.mix(name.astype(np.uint64)) % np.uint64(64 * WORDS)] = 1
                some = int(take.sum())
                out.append((name[order][take].astype(np.int64), np.full(some, num), np.full(some, comp), rest[take], np.full(some, count.sum()),
                            np.tile(np.packbits(mask).view(np.int64), (some, 1))))
            if out:
                token, num, comp, rest, total, bits = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_pydict({"token": token, "num": num, "comp": comp, "rest": rest, "total": total,
                                                  "bits": pa.array(list(bits), pa.list_(pa.int64()))})
    return run


def _sets(wanted: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """num, sketch, names, counts of each node in a shared bucket: made where its first text is read."""
    wanted = cut_lineage(wanted.select("num", "node", "sketch", F.xxhash64("first.id", "first.sub").alias("row")))
    bloom = wanted.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches):
        for batch in batches:
            hit = _in_bloom(bloom.value, batch.column("row").to_numpy())
            batch = batch.filter(pa.array(hit))
            body, names, counts = batch.column("body").to_pylist(), [], []
            for a, b in tv.chunked([len(t) for t in body]):
                doc, name, count = shingles(tv.joined(body[a:b]), size)
                # 32 bits tell the shingles of two texts apart; the order of the names stays
                cut = np.searchsorted(doc, np.arange(1, b - a))
                for n, c in zip(np.split((name >> np.uint64(32)).astype(np.uint32), cut), np.split(count.astype(np.uint32), cut)):
                    new = np.append(True, n[1:] != n[:-1])[:len(n)]
                    names.append(n[new].tobytes())
                    counts.append(np.add.reduceat(c, np.flatnonzero(new)).astype(np.uint32).tobytes() if len(n) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(names, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["node", "names", "counts"])
    made = texts.select("node", F.xxhash64("id", "sub").alias("row"), "body").mapInArrow(run, "node binary, names binary, counts binary")
    return cut_lineage(made.join(wanted.select("node", "num", "sketch"), "node").dropDuplicates(["num"]).select("num", "sketch", "names", "counts"))


def _bloom(wanted: DataFrame) -> np.ndarray:
    """Bits of the wanted rows, packed. Beyond BLOOM_BITS it lets more rows pass, which the join drops."""
    number = wanted.count()
    bits = 1 << max(16, min(BLOOM_BITS, number * BITS_A_ROW).bit_length())

    def run(batches):
        found = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _bloom_places(batch.column("row").to_numpy(), bits):
                np.bitwise_or.at(found, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for i, part in enumerate(found.reshape(16, -1)):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})

    def both(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("data").to_pylist()])
        return pa.table({"slice": table.column("slice").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})
    rows = wanted.select("row").mapInArrow(run, "slice int, data binary").groupBy("slice").applyInArrow(both, "slice int, data binary").collect()
    out = np.zeros((16, bits // 128), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["data"], np.uint8)
    return out.ravel()


def _bloom_places(row: np.ndarray, bits: int):
    name = row.view(np.uint64)
    for k in range(3):
        name = tv.mix(name + np.uint64(0x9E3779B97F4A7C15))
        yield (name % np.uint64(bits)).astype(np.int64)


def _in_bloom(packed: np.ndarray, row: np.ndarray) -> np.ndarray:
    hit = np.ones(len(row), bool)
    for at in _bloom_places(row, len(packed) * 8):
        hit &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hit


def _agree(threshold: float):
    """Whether the registers of two texts agree often enough for the threshold to be possible."""
    def test(x: bytes, y: bytes) -> bool:
        return (np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean() >= threshold - MARGIN
    return test


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of sorted names a and b with weights x and y."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = x.astype(float), y.astype(float)
    ratio = np.concatenate((x[i] / y[j], np.full(len(a) - len(i), np.inf), np.zeros(len(b) - len(j))))
    own = np.concatenate((x[i], np.delete(x, i), np.zeros(len(b) - len(j))))
    other = np.concatenate((y[j], np.zeros(len(a) - len(i)), np.delete(y, j)))
    # a term's maximum is x's share where the ratio x / y is at least its own, else y's
    order = np.argsort(ratio, kind="stable")
    above = np.append(np.cumsum(own[order][::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(other[order]))
    at = np.searchsorted(ratio[order], ratio[:len(i)], side="left")
    return float((1.0 / (above[at] / x[i] + below[at] / y[j])).sum())


def _alike(threshold: float):
    """Whether the similarity of two texts, given as names and counts, is at the threshold."""
    def test(x, y) -> bool:
        a, p, b, q = (np.frombuffer(v, np.uint32) for v in (x["names"], x["counts"], y["names"], y["counts"]))
        if (len(p) and p.max() == 1) and (len(q) and q.max() == 1):  # sets
            if min(len(a), len(b)) < threshold * max(len(a), len(b)):
                return False
            both = len(np.intersect1d(a, b, assume_unique=True))
            return both >= threshold * (len(a) + len(b) - both) - 1e-9
        return probability_jaccard(a, p, b, q) >= threshold - 1e-9
    return test


def _verified(pair: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    near, alike = _agree(threshold), _alike(threshold)
    return _filtered(pair, sets.select("num", F.struct("sketch", "names", "counts").alias("text")), "text",
                     lambda x, y: near(x["sketch"], y["sketch"]) and alike(x, y))


def _filtered(pair: DataFrame, values: DataFrame, column: str, test) -> DataFrame:
    """Pairs whose two values of `column` pass the test."""
    def run(batches):
        for batch in batches:
            keep = [test(x, y) for x, y in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("num"), batch.column("other")], names=["num", "other"]).filter(pa.array(keep, pa.bool_()))
    mine = values.select("num", F.col(column).alias("mine"))
    theirs = values.select(F.col("num").alias("other"), F.col(column).alias("theirs"))
    return (pair.join(mine, "num").join(theirs, "other")
            .select("num", "other", "mine", "theirs").mapInArrow(run, "num long, other long"))


def _connected(links: DataFrame, parts: int) -> DataFrame:
    """(num, comp): min-label stars. Each turn hangs every neighbour on the least label seen, until nothing moves."""
    edge, state = links.select(F.col("num").alias("a"), F.col("other").alias("b")), None
    while True:
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")).coalesce(parts)
        # large star: greater neighbours move to the least; small star: lesser ones and the node itself
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").coalesce(parts).distinct().coalesce(parts))
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts)
                 .unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edge, last = cut_lineage(small.coalesce(parts)), state
        state = tuple(edge.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == last:
            break
    member = edge.select(F.col("a").alias("num"), F.col("b").alias("comp"))
    return cut_lineage(member.unionByName(edge.select(F.col("b").alias("num"), F.col("b").alias("comp")))
                       .distinct().coalesce(parts))
