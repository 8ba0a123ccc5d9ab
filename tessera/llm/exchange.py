"""Packed exchange of positions: many (name, document, position) entries per Spark row.

A mapper task names positions of texts; equal names must meet. Each Arrow
batch first reduces its own entries (one representative per name, so a name
that half of all documents carry crosses the network once per batch), then
packs what is left by `name mod buckets` into one binary row per bucket. Spark
shuffles the rows by bucket; a bucket is a fixed slice of the name space whose
number grows with the input, so a reducer task's memory doesn't. What the
buckets find goes back packed by slice of the texts, and each text gets it as
one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Null ids sort before all others.
NULL_ID = -(2**63)
BUCKET_BYTES = 8 << 20
PACKED = "bucket long, local boolean, payload binary"


def keyed(docs: DataFrame) -> DataFrame:
    """id, sub, text as bytes: `sub` tells apart texts that share an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
        F.xxhash64(text).alias("sub"), F.encode(text, "UTF-8").alias("body"))


def bucket_count(docs: DataFrame, bytes_per_text_byte: float) -> int:
    """Buckets so that each holds about BUCKET_BYTES of packed entries, however large the input."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, int(total * bytes_per_text_byte / BUCKET_BYTES) + 1)


def pack(ids: np.ndarray, subs: np.ndarray, doc: np.ndarray, pos: np.ndarray, *names: np.ndarray) -> bytes:
    """Entries sorted by doc. ids and subs are per text of the batch; doc indexes them."""
    present, count = np.unique(doc, return_counts=True)
    head = np.array([len(present), len(doc)], np.int32)
    return b"".join(x.tobytes() for x in (
        head, ids[present].astype(np.int64), subs[present].astype(np.int64), count.astype(np.int32),
        pos.astype(np.int32), *names))


def unpack(payload: bytes, *types: type) -> tuple[np.ndarray, ...]:
    """id, sub, pos, names..., one entry each."""
    d, n = np.frombuffer(payload, np.int32, 2)
    at, out = 8, []
    for count, kind in ((d, np.int64), (d, np.int64), (d, np.int32), (n, np.int32), *((n, t) for t in types)):
        out.append(np.frombuffer(payload, kind, count, at))
        at += count * np.dtype(kind).itemsize
    ids, subs, count, pos, *names = out
    return np.repeat(ids, count), np.repeat(subs, count), pos, *names


def unpack_all(payloads: list[bytes], *types: type) -> tuple[np.ndarray, ...]:
    parts = [unpack(p, *types) for p in payloads]
    return tuple(np.concatenate(x) for x in zip(*parts))


def by_bucket(bucket: np.ndarray):
    """(bucket, entries) for each bucket; entries keep their order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), part


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by keys, and the group number of each sorted entry."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def packed_batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([r[0] for r in rows], pa.int64()),
        "local": pa.array([r[1] for r in rows], pa.bool_()),
        "payload": pa.array([r[2] for r in rows], pa.binary())})


FOUND = "id long, sub long, found binary"


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and size of each run of equal keys at consecutive positions; the last key is the position."""
    *fixed, pos = keys
    new = np.ones(len(pos), bool)
    new[1:] = np.diff(pos) != 1
    for k in fixed:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(pos)))


def pack_runs(ids: np.ndarray, subs: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Found positions, sorted by (doc, pos), as packed (start, size) runs."""
    at, size = runs(doc, pos)
    return pack(ids, subs, doc[at], pos[at], size.astype(np.int32))


def found_rows(ids: np.ndarray, subs: np.ndarray, pos: np.ndarray, local: list[bytes], slices: int) -> pa.Table:
    """What a bucket found, and what mappers found alone, packed by slice of the texts."""
    order = np.lexsort((pos, subs, ids))
    ids, subs, pos = ids[order], subs[order], pos[order]
    at, size = runs(ids, subs, pos)
    parts = [(ids[at], subs[at], pos[at], size), *(unpack(p, np.int32) for p in local)]
    ids, subs, start, size = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, subs, ids))
    ids, subs, start, size = ids[order], subs[order], start[order], size[order]
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(subs) != 0)
    text = np.cumsum(new) - 1
    key = ids[new].astype(np.uint64) + subs[new].astype(np.uint64)
    slice_of = (key % np.uint64(slices)).astype(np.int64)[text]
    rows = [(b, False, pack(ids[new], subs[new], text[e], start[e], size[e].astype(np.int32)))
            for b, e in by_bucket(slice_of)]
    return pa.Table.from_batches([packed_batch(rows)])


def _merge(table: pa.Table) -> pa.Table:
    ids, subs, start, size = unpack_all(table.column("payload").to_pylist(), np.int32)
    order = np.lexsort((start, subs, ids))
    ids, subs = ids[order], subs[order]
    pair = np.stack((start[order], size[order]), axis=1).astype(np.int32)
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(subs) != 0)
    at = np.flatnonzero(new)
    return pa.Table.from_arrays([
        pa.array(ids[at], pa.int64()), pa.array(subs[at], pa.int64()),
        pa.array([p.tobytes() for p in np.split(pair, at[1:])], pa.binary())], names=["id", "sub", "found"])


def per_text(found: DataFrame) -> DataFrame:
    """One row (id, sub, found) per text: its (start, size) runs, sorted by start."""
    return found.groupBy("bucket").applyInArrow(_merge, FOUND)


def run_pairs(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(found, np.int32).reshape(-1, 2).astype(np.int64)
    return pair[:, 0], pair[:, 1]


def positions(found: bytes) -> np.ndarray:
    start, size = run_pairs(found)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def covered_spans(found: bytes, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by windows of `length` whose starts are given."""
    begin, size = run_pairs(found)
    end = np.maximum.accumulate(begin + size - 1 + length)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return list(zip(begin[at].tolist(), end[np.append(at[1:], len(begin)) - 1].tolist()))


def reduced_batch(ids: np.ndarray, subs: np.ndarray, doc: np.ndarray, pos: np.ndarray, name: np.ndarray,
                  buckets: int, counted: bool = False) -> pa.RecordBatch:
    """One entry per name leaves the batch (`counted`: with the times the batch holds it); names that it holds
    several times are found here."""
    order, group = groups(name)
    size = np.bincount(group)
    first = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
    keep = np.sort(order[first])
    here = np.sort(order[size[group] > 1])
    bucket = (name[keep] % np.uint64(buckets)).astype(np.int64)
    times = np.empty(len(name), np.int32)
    times[order] = size[group]
    rows = [(b, False, pack(ids, subs, doc[keep[part]], pos[keep[part]], name[keep[part]],
                            *((times[keep[part]],) if counted else ())))
            for b, part in by_bucket(bucket)]
    if len(here):
        rows.append((int(bucket[0]), True, pack_runs(ids, subs, doc[here], pos[here])))
    return packed_batch(rows)


def payloads(table: pa.Table) -> tuple[list[bytes], list[bytes]]:
    """Packed entries of a bucket, and what mappers found alone."""
    local, payload = table.column("local").to_pylist(), table.column("payload").to_pylist()
    return [p for p, x in zip(payload, local) if not x], [p for p, x in zip(payload, local) if x]


def shared_positions(slices: int):
    """Positions of a bucket whose name is there twice or more."""
    def run(table: pa.Table) -> pa.Table:
        packed, local = payloads(table)
        ids = subs = pos = np.empty(0, np.int64)
        if packed:
            ids, subs, pos, name = unpack_all(packed, np.uint64)
            order, group = groups(name)
            hit = order[np.bincount(group)[group] > 1]
            ids, subs, pos = ids[hit], subs[hit], pos[hit]
        return found_rows(ids, subs, pos, local, slices)
    return run
