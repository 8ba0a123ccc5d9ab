r"""Operator 8: substring dedup by difference-cover anchors.

A window is `window` consecutive words of one document. Every word covered by
a window whose word sequence also starts earlier (smaller document, or the
same document and an earlier start) is removed.

Method. D = {0, 1, 3, 9} is a difference cover modulo 13: for any two
positions i and j there is a shift d < 13 with (i + d) and (j + d) both in D
modulo 13. So two equal windows of `window` words share an anchor, a run of
`window - 12` words that starts at a cover position in both. Only those
positions (4 of 13) are hashed and exchanged:

1. anchors: name the runs at cover positions; names seen twice anywhere are
   sent back to their texts.
2. extension: windows that hold such an anchor are named whole; the first
   occurrence of each name stays, the others are removal windows.
3. removal windows of a text merge into spans.

Both exchanges are packed by name (`exchange.py`), each task reduces a name it
sees often to one entry first, and a copy of a whole text is settled by its
hash without entering step 2.

Defined cases: null text has no words; null ids are one id that sorts first;
rows with the same id and text are one document given twice, each gets the
same result; texts that share an id are ordered by their hash. Other columns
are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as ex
from . import textvec as tv

PERIOD, COVER = 13, (0, 1, 3, 9)
TASK_BYTES = 16 << 20


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), spans (removed word runs)."""
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words or more")
    texts = ex.keyed(docs)
    buckets = ex.bucket_count(docs, 1.0)
    copies = copied_texts(docs)

    anchors = texts.mapInArrow(_anchor_mapper(window, buckets), ex.PACKED)
    shared = anchors.groupBy("bucket").applyInArrow(ex.shared_positions(buckets), ex.PACKED)
    candidates = texts.join(_marks(shared, copies), ["id", "sub"], "left")
    windows = candidates.mapInArrow(_window_mapper(window, buckets), ex.PACKED)
    removal = windows.groupBy("bucket").applyInArrow(_later_windows(buckets), ex.PACKED)
    return (texts.join(_marks(removal, copies), ["id", "sub"], "left")
            .mapInArrow(_remover(window),
                        "doc_id long, n_words long, n_removed long, text string, "
                        "spans array<struct<start:int,end:int>>"))


def copied_texts(docs: DataFrame) -> DataFrame:
    """(id, sub) of the texts that also stand under a smaller id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(ex.NULL_ID)).alias("id"),
        F.xxhash64(text).alias("sub"), F.sha2(text, 256).alias("sha"))
    first = named.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return named.join(first, "sha").filter("id > first").select("id", "sub")


def _marks(found: DataFrame, copies: DataFrame) -> DataFrame:
    both = ex.per_text(found).withColumn("copy", F.lit(False)).unionByName(
        copies.select("id", "sub", F.lit(None).cast("binary").alias("found"), F.lit(True).alias("copy")))
    return both.groupBy("id", "sub").agg(F.max("found").alias("found"), F.max("copy").alias("copy"))


def _anchor_mapper(window: int, buckets: int):
    length = window - PERIOD + 1
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True

    def run(batches):
        for batch in batches:
            body = batch.column("body").to_pylist()
            ids, subs = (batch.column(c).to_numpy() for c in ("id", "sub"))
            for a, b in tv.chunked([len(t) for t in body], TASK_BYTES):
                docs, poss, names = [], [], []
                for c, d in tv.chunked([len(t) for t in body[a:b]]):
                    j = tv.joined(body[a + c:a + d])
                    w = tv.split_words(j, tv.SPACE_WORD)
                    name = tv.run_names(tv.word_hash(j, w), length)
                    pos = np.arange(len(w.start)) - w.first[w.doc]
                    n = w.count[w.doc]
                    at = np.flatnonzero(in_cover[pos % PERIOD] & (pos + length <= n) & (n >= window))
                    docs.append(w.doc[at] + c)
                    poss.append(pos[at])
                    names.append(name[at])
                doc, pos, name = (np.concatenate(x) for x in (docs, poss, names))
                if len(name):
                    yield ex.reduced_batch(ids[a:b], subs[a:b], doc, pos, name, buckets)
    return run


def _window_mapper(window: int, buckets: int):
    def run(batches):
        for batch in batches:
            copy, found = batch.column("copy").to_pylist(), batch.column("found").to_pylist()
            rows = [i for i in range(batch.num_rows) if found[i] and not copy[i]]
            ids, subs = (batch.column(c).to_numpy() for c in ("id", "sub"))
            rows.sort(key=lambda i: (ids[i], subs[i]))
            column = batch.column("body")
            body = [column[i].as_py() for i in rows]
            ids, subs = ids[rows], subs[rows]
            for a, b in tv.chunked([len(t) for t in body], TASK_BYTES):
                parts = []
                for c, d in tv.chunked([len(t) for t in body[a:b]]):
                    j = tv.joined(body[a + c:a + d])
                    w = tv.split_words(j, tv.SPACE_WORD)
                    at = _candidates([found[i] for i in rows[a + c:a + d]], w, window)
                    if len(at):
                        word = tv.word_hash(j, w)
                        check = tv.run_names(~word, window)[at].astype(np.uint32)
                        parts.append((w.doc[at] + c, at - w.first[w.doc[at]], tv.run_names(word, window)[at], check))
                if parts:
                    yield _first_here(ids[a:b], subs[a:b], *(np.concatenate(x) for x in zip(*parts)), buckets)
    return run


def _candidates(found: list, w: tv.Words, window: int) -> np.ndarray:
    """Window starts (word index of the chunk) that hold a shared anchor."""
    mask = np.zeros(len(w.start), bool)
    for k, f in enumerate(found):
        n, first = int(w.count[k]), int(w.first[k])
        anchor = ex.positions(f)
        lo = np.maximum(anchor - (PERIOD - 1), 0)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, lo, 1)
        np.add.at(step, anchor + 1, -1)
        mask[first:first + max(0, n - window + 1)] = np.cumsum(step)[:max(0, n - window + 1)] > 0
    return np.flatnonzero(mask)


def _first_here(ids, subs, doc, pos, name, check, buckets) -> pa.RecordBatch:
    """Texts come sorted by (id, sub), so the first entry of a name is its earliest in this batch."""
    order, group = ex.groups(name, check)
    first = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
    head = order[first]
    rest = np.ones(len(name), bool)
    rest[head] = False
    of = np.empty(len(name), np.int64)
    of[order] = head[group]
    rest &= (ids[doc] != ids[doc[of]]) | (subs[doc] != subs[doc[of]]) | (pos != pos[of])
    keep = np.sort(head)
    bucket = (name[keep] % np.uint64(buckets)).astype(np.int64)
    rows = []
    for b, part in ex.by_bucket(bucket):
        e = keep[part]
        rows.append((b, False, ex.pack(ids, subs, doc[e], pos[e], name[e], check[e])))
    if rest.any():
        rows.append((int(bucket[0]), True, ex.pack_runs(ids, subs, doc[rest], pos[rest])))
    return ex.packed_batch(rows)


def _later_windows(slices: int):
    def run(table: pa.Table) -> pa.Table:
        packed, local = ex.payloads(table)
        ids = subs = pos = np.empty(0, np.int64)
        if packed:
            ids, subs, pos, name, check = ex.unpack_all(packed, np.uint64, np.uint32)
            order = np.lexsort((pos, subs, ids, check, name))
            new = np.ones(len(order), bool)
            new[1:] = (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])
            head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            later = order[(ids[order] != ids[head]) | (subs[order] != subs[head]) | (pos[order] != pos[head])]
            ids, subs, pos = ids[later], subs[later], pos[later]
        return ex.found_rows(ids, subs, pos, local, slices)
    return run


def _remover(window: int):
    def run(batches):
        for batch in batches:
            copy, found = batch.column("copy").to_pylist(), batch.column("found").to_pylist()
            out = []
            for i, body in enumerate(batch.column("body").to_pylist()):
                words = body.split()
                n, spans = len(words), []
                if copy[i]:
                    spans = [(0, n)] if n >= window else []
                elif found[i]:
                    spans = ex.covered_spans(found[i], window)
                    words = [x for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (n, n)]) for x in words[a:b]]
                if copy[i] and spans:
                    words = []
                out.append((n, sum(b - a for a, b in spans), b" ".join(words).decode(),
                            [{"start": a, "end": b} for a, b in spans]))
            ids = batch.column("id")
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([
                pa.array([None if x == ex.NULL_ID else x for x in ids.to_pylist()], pa.int64()),
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "text", "spans"])
    return run
