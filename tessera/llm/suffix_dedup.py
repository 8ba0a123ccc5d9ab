r"""Operator 5: repeated byte strings, by bucket-pointer refinement.

Every byte covered by a `length`-byte string that starts twice or more
anywhere in the corpus is removed; strings are judged on the input.

Method. Suffixes are put into buckets by their first bytes, and a bucket's
identifier at depth 2h comes from the identifiers at depth h of a suffix and
of the suffix h bytes later, so each refinement reuses the last one's result:

1. initial buckets: of each `length`-byte window, the q-gram with the least
   hash is sampled (about one position in 180). The q-gram's hash is its
   bucket; buckets of one suffix in the whole corpus are settled, since no
   window that holds such a q-gram can repeat.
2. refinement: in the texts that remain, bucket identifiers of all suffixes
   are doubled from 25 to 50, 100, 200 and 400 bytes. Identifiers are names
   made from the content, so doubling needs no exchange.
3. windows in open initial buckets are exchanged by (initial bucket,
   identifier at full depth); those in buckets of two or more are repeated.
   Those of an initial bucket of up to `hot` suffixes travel together; those of
   a larger one (a line that many texts carry in different surroundings) are
   dealt out by both names, so no task meets them all.

Windows of one initial bucket are consecutive in a text, so they travel as
runs. A text that stands in several rows is settled by its hash; one row of it
takes part in step 3. Each task reduces a name that it holds several times to
one entry before the exchange.

Defined cases: null text is empty; null ids are one id; repeated rows are
separate documents with the same result; texts under `length` bytes lose
nothing. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import cut_lineage

from . import exchange as ex
from . import textvec as tv

QGRAM = 32
SAMPLE_BYTES = 16 << 20  # text of one batch of samples
WINDOW_BYTES = 4 << 20   # and of windows, of which a text has one per byte at most
HOT = 2048               # suffixes of an initial bucket whose windows, 369 each, still fit one task
SLOTS = 1 << 26          # larger buckets are told by their hash modulo SLOTS: a clash only deals out more
SPREAD = 4               # an entry of one window is larger than one of a run
_NONE = np.empty(0, np.int64)


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (removed byte runs)."""
    if length < 2 * QGRAM:
        raise ValueError(f"length must be {2 * QGRAM} bytes or more")
    texts = ex.keyed(docs)
    buckets = ex.bucket_count(docs, 0.8)
    copies = copied_texts(docs)

    windows = _windows(texts, copies, length, buckets, hot)
    repeated = windows.groupBy("bucket").applyInArrow(_repeated_windows(buckets), ex.PACKED)
    return (texts.join(_marks(repeated, copies), ["id", "sub"], "left")
            .mapInArrow(_remover(length),
                        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, "
                        "spans array<struct<start:int,end:int>>"))


def _windows(texts: DataFrame, copies: DataFrame, length: int, buckets: int, hot: int) -> DataFrame:
    """Packed windows in open initial buckets."""
    samples = texts.mapInArrow(_sample_mapper(length, buckets), ex.PACKED)
    found = cut_lineage(samples.groupBy("bucket").applyInArrow(_open_positions(buckets, hot), ex.PACKED))
    slots = (found.filter("bucket < 0").select((-1 - F.col("bucket")).alias("slot"))
             .groupBy(F.expr("slot div 64").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).orderBy("word").collect())
    crowded = tuple(np.array([r[k] for r in slots], np.int64) for k in (0, 1))
    return (texts.join(_marks(found.filter("bucket >= 0"), copies), ["id", "sub"], "left")
            .mapInArrow(_window_mapper(length, buckets, crowded), ex.PACKED))


def _open_positions(slices: int, hot: int):
    """Positions of initial buckets of two suffixes or more, and the slots of those of more than `hot`."""
    def run(table: pa.Table) -> pa.Table:
        packed, local = ex.payloads(table)
        ids = subs = pos = _NONE
        large = np.empty(0, np.uint64)
        if packed:
            ids, subs, pos, name, times = ex.unpack_all(packed, np.uint64, np.int32)
            order, group = ex.groups(name)
            first = np.flatnonzero(np.diff(group, prepend=-1))
            large = name[order[first[np.bincount(group, weights=times[order]) > hot]]]
            hit = order[np.bincount(group)[group] > 1]
            ids, subs, pos = ids[hit], subs[hit], pos[hit]
        slots = np.unique(large % np.uint64(SLOTS)).tolist()
        return pa.concat_tables([ex.found_rows(ids, subs, pos, local, slices),
                                 pa.Table.from_batches([ex.packed_batch([(-1 - s, False, b"") for s in slots])])])
    return run


def _is_crowded(least: np.ndarray, crowded: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    words, bits = crowded
    if not len(words):
        return np.zeros(len(least), bool)
    slot = (least % np.uint64(SLOTS)).astype(np.int64)
    at = np.minimum(np.searchsorted(words, slot // 64), len(words) - 1)
    return (words[at] == slot // 64) & ((bits[at] >> (slot % 64)) & 1 == 1)


def copied_texts(docs: DataFrame) -> DataFrame:
    """(id, sub, copy) of texts in several rows; copy is 1 under the least id, else 2."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(ex.NULL_ID)).alias("id"),
        F.xxhash64(text).alias("sub"), F.sha2(text, 256).alias("sha"))
    first = named.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return named.join(first, "sha").select("id", "sub", F.when(F.expr("id > first"), 2).otherwise(1).alias("copy"))


def _marks(found: DataFrame, copies: DataFrame) -> DataFrame:
    both = ex.per_text(found).withColumn("copy", F.lit(0)).unionByName(
        copies.select("id", "sub", F.lit(None).cast("binary").alias("found"), "copy"))
    return both.groupBy("id", "sub").agg(F.max("found").alias("found"), F.max("copy").alias("copy"))


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of `width` items, by doubling."""
    out, h = a, 1
    while 2 * h <= width:
        out = op(out[:len(out) - h], out[h:])
        h *= 2
    return op(out[:len(out) - (width - h)], out[width - h:]) if width > h else out


def _qgrams(prefix: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(len(prefix) - size)
    return tv.span_hash(prefix, at, at + size)


def _whole(j: tv.Joined, length: int) -> np.ndarray:
    """Mask of window starts that stay within their text."""
    step = np.zeros(len(j.buf) + 1, np.int32)
    long = (j.end - j.begin) >= length
    step[j.begin[long]] += 1
    step[j.end[long] - length + 1] -= 1
    return np.cumsum(step[:len(j.buf) - length + 1]) > 0


def _doc_of(j: tv.Joined, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(j.begin, at, side="right") - 1


def _sample_mapper(length: int, buckets: int):
    width = length - QGRAM + 1

    def sampled(texts: list[bytes]):
        j = tv.joined(texts)
        if len(j.buf) < length:
            return _NONE, _NONE, np.empty(0, np.uint64)
        gram = _qgrams(tv.byte_prefix(j.buf), QGRAM)
        least = _sliding(gram, width, np.minimum)
        least = np.where(_whole(j, length), least, np.uint64(0))
        pad = np.zeros(width - 1, np.uint64)
        most = _sliding(np.concatenate((pad, least, pad)), width, np.maximum)
        at = np.flatnonzero((most == gram) & (most > 0))
        doc = _doc_of(j, at)
        return doc, at - j.begin[doc], gram[at]

    def run(batches):
        for batch in batches:
            ids, subs = (batch.column(c).to_numpy() for c in ("id", "sub"))
            body = batch.column("body").to_pylist()
            rows = np.array([i for i, t in enumerate(body) if len(t) >= length], np.int64)
            body, ids, subs = [body[i] for i in rows], ids[rows], subs[rows]
            for a, b in tv.chunked([len(t) for t in body], SAMPLE_BYTES):
                parts = []
                for c, d in tv.chunked([len(t) for t in body[a:b]]):
                    doc, pos, name = sampled(body[a + c:a + d])
                    parts.append((doc + c, pos, name))
                doc, pos, name = (np.concatenate(x) for x in zip(*parts))
                if len(name):
                    yield ex.reduced_batch(ids[a:b], subs[a:b], doc, pos, name, buckets, counted=True)
    return run


def _full_depth(prefix: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of all suffixes at depth `length`."""
    h = length
    while h % 2 == 0 and h // 2 >= 16:
        h //= 2
    name = _qgrams(prefix, h)
    while h < length:
        name = tv.join_names(name[:len(name) - h], name[h:])
        h *= 2
    return name


def _window_mapper(length: int, buckets: int, crowded: tuple[np.ndarray, np.ndarray]):
    width = length - QGRAM + 1

    def windows(texts: list[bytes], found: list):
        j = tv.joined(texts)
        prefix = tv.byte_prefix(j.buf)
        gram = _qgrams(prefix, QGRAM)
        is_open = np.full(len(gram), ~np.uint64(0))
        for k, f in enumerate(found):
            at = ex.positions(f) + j.begin[k]
            is_open[at] = gram[at]
        least = _sliding(gram, width, np.minimum)
        at = np.flatnonzero((_sliding(is_open, width, np.minimum) == least) & _whole(j, length))
        doc = _doc_of(j, at)
        return doc, at - j.begin[doc], least[at], _full_depth(prefix, length)[at]

    def run(batches):
        for batch in batches:
            copy, found = batch.column("copy").to_pylist(), batch.column("found").to_pylist()
            rows = [i for i in range(batch.num_rows) if found[i] and copy[i] != 2]
            column = batch.column("body")
            body = [column[i].as_py() for i in rows]
            ids, subs = (batch.column(c).to_numpy()[rows] for c in ("id", "sub"))
            for a, b in tv.chunked([len(t) for t in body], WINDOW_BYTES):
                parts = []
                for c, d in tv.chunked([len(t) for t in body[a:b]]):
                    doc, pos, least, name = windows(body[a + c:a + d], [found[i] for i in rows[a + c:a + d]])
                    parts.append((doc + c, pos, least, name))
                doc, pos, least, name = (np.concatenate(x) for x in zip(*parts))
                if len(name):
                    yield _reduced_windows(ids[a:b], subs[a:b], doc, pos, least, name, buckets, crowded)
    return run


def _equal_neighbours(name: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by name, and whether each sorted entry equals the one before it."""
    order = np.argsort(name)
    n, m = name[order], least[order]
    same = np.zeros(len(order), bool)
    same[1:] = (n[1:] == n[:-1]) & (m[1:] == m[:-1])
    return order, same


def _reduced_windows(ids, subs, doc, pos, least, name, buckets, crowded) -> pa.RecordBatch:
    order, same = _equal_neighbours(name, least)
    keep = np.sort(order[~same])
    twice = same.copy()
    twice[:-1] |= same[1:]
    here = np.sort(order[twice])
    apart = _is_crowded(least[keep], crowded)
    alone, keep = keep[apart], keep[~apart]
    doc_k, pos_k, least_k, name_k = doc[keep], pos[keep], least[keep], name[keep]
    at, size = ex.runs(doc_k, least_k, pos_k)
    bucket = (least_k[at] % np.uint64(buckets)).astype(np.int64)
    rows = []
    for b, part in ex.by_bucket(bucket):
        s, n = at[part], size[part]
        entry = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        head = ex.pack(ids, subs, doc_k[s], pos_k[s], n.astype(np.int32), least_k[s])
        rows.append((b, False, np.int32(len(head)).tobytes() + head + name_k[entry].tobytes()))
    spread = (tv.join_names(least[alone], name[alone]) % np.uint64(SPREAD * buckets)).astype(np.int64)
    for b, part in ex.by_bucket(spread):
        e = alone[part]
        head = ex.pack(ids, subs, doc[e], pos[e], np.ones(len(e), np.int32), least[e])
        rows.append((buckets + b, False, np.int32(len(head)).tobytes() + head + name[e].tobytes()))
    if len(here):
        rows.append((int(least[0] % np.uint64(buckets)), True, ex.pack_runs(ids, subs, doc[here], pos[here])))
    return ex.packed_batch(rows)


def _unpack_windows(payload: bytes):
    size = int(np.frombuffer(payload, np.int32, 1)[0])
    ids, subs, pos, n, least = ex.unpack(payload[4:4 + size], np.int32, np.uint64)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rep = lambda x: np.repeat(x, n)
    return rep(ids), rep(subs), rep(pos) + inside, rep(least), np.frombuffer(payload, np.uint64, offset=4 + size)


def _repeated_windows(slices: int):
    def run(table: pa.Table) -> pa.Table:
        packed, local = ex.payloads(table)
        ids = subs = pos = _NONE
        if packed:
            ids, subs, pos, least, name = (np.concatenate(x) for x in zip(*map(_unpack_windows, packed)))
            order, same = _equal_neighbours(name, least)
            same[:-1] |= same[1:]
            hit = order[same]
            ids, subs, pos = ids[hit], subs[hit], pos[hit]
        return ex.found_rows(ids, subs, pos, local, slices)
    return run


def _remover(length: int):
    def run(batches):
        for batch in batches:
            copy, found = batch.column("copy").to_pylist(), batch.column("found").to_pylist()
            out = []
            for i, body in enumerate(batch.column("body").to_pylist()):
                n, spans, kept = len(body), [], body
                if copy[i]:
                    spans = [(0, n)] if n >= length else []
                elif found[i]:
                    spans = ex.covered_spans(found[i], length)
                if spans:
                    kept = b"".join(body[a:b] for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (n, n)]))
                out.append((n, n - len(kept), len(spans), kept, [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array([None if x == ex.NULL_ID else x for x in batch.column("id").to_pylist()], pa.int64()),
                *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()),
                pa.array(cols[4], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])
    return run
