r"""Operator 7: benchmark decontamination with an FM-index per training shard.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. A phrase
is `window` consecutive words of a benchmark item; an item of fewer words, but
not none, is one phrase. Every document word inside an occurrence of a phrase
is a hit.

Method. Each task cuts its documents into shards of about `SHARD_BYTES` and
indexes each: words become numbers of the phrase vocabulary, other words
separate (no phrase holds them, so runs of vocabulary words shorter than the
shortest phrase can't hold a match and are left out, which is exact). Over the
rest it builds a suffix array, its Burrows-Wheeler transform and a wavelet
matrix; all phrases are searched backward together through wavelet ranks, each
occurrence is located by LF steps to the next sampled suffix position, and
occurrences merge into removal spans. Documents are never shuffled.

Phrases go to the tasks by broadcast in parts of at most `part_bytes` of
benchmark text (or one item); each part is one more pass in the same task, so
the broadcast doesn't grow with the benchmark.

Defined cases: null text has no words; a null item id is searched for and hits
words, but isn't listed in `items`; repeated item ids are one item; repeated
documents each get their row. Extra columns may be carried in the struct
`row`, so names can't clash. Empty tables give no hits or no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import textvec as tv

SHARD_BYTES = 8 << 20
PART_BYTES = 16 << 20
SAMPLE = 8
_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: list[str] | None = None,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """row (struct of the carried columns), n_words, spans (merged word runs), items (sorted distinct ids)."""
    carry = docs.columns if carry is None else carry
    body = [] if "text" in carry else [
        F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("body")]
    found = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), *body,
        F.lit(None).cast("long").alias("n_words"),
        F.array().cast(ArrayType(_SPAN)).alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = StructType([found.schema["row"], *([found.schema["body"]] if body else []), StructField("n_words", LongType()),
                         StructField("spans", ArrayType(_SPAN)), StructField("items", ArrayType(StringType()))])
    for phrases in _parts(benchmark, window, part_bytes):
        found = found.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(phrases)), schema)
    return found.drop("body")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the documents that hold a phrase; columns stay."""
    return find_phrases(docs, benchmark, window).filter(F.size("spans") == 0).select("row.*")


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans."""
    return find_phrases(docs, benchmark, window, ["doc_id"]).select(
        "row.doc_id", "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"), "items", "spans")


# -- phrases ------------------------------------------------------------------

class Phrases(NamedTuple):
    vocabulary: np.ndarray        # sorted word hashes; word k + 2 of the index alphabet
    tables: list[np.ndarray]      # per length: distinct phrases x length, as alphabet numbers
    items: list[list[list[str]]]  # per length, per phrase: ids of its items


def _parts(benchmark: DataFrame, window: int, part_bytes: int):
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"),
                            F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("body"))
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    count = total // part_bytes + 1
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == k) if count > 1 else rows
        yield phrase_set([(r.item, bytes(r.body)) for r in part.collect()], window)


def phrase_set(items: list[tuple[str | None, bytes]], window: int) -> Phrases:
    hashes = []
    for _, body in items:
        j = lowered([body])
        hashes.append(tv.word_hash(j, tv.split_words(j, tv.ALNUM_WORD)))
    vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
    owners: dict[tuple[int, ...], set[str]] = {}
    for (item, _), h in zip(items, hashes):
        number = (np.searchsorted(vocabulary, h) + 2).tolist()
        size = min(window, len(number))
        for i in range(len(number) - size + 1 if size else 0):
            owners.setdefault(tuple(number[i:i + size]), set()).update([item] if item is not None else [])
    tables, lists = [], []
    for size in sorted({len(p) for p in owners}):
        some = [p for p in owners if len(p) == size]
        tables.append(np.array(some, np.int64))
        lists.append([sorted(owners[p]) for p in some])
    return Phrases(vocabulary, tables, lists)


def lowered(texts: list[bytes]) -> tv.Joined:
    j = tv.joined(texts)
    return j._replace(buf=tv.LOWER[j.buf])


# -- index --------------------------------------------------------------------

def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; s ends with a symbol that is less than all others and unique."""
    n, rank, h = len(s), s.astype(np.int64), 1
    while True:
        later = np.zeros(n, np.int64)
        later[:n - h] = rank[h:] + 1
        key = rank * (int(later.max()) + 1) + later
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        h = min(2 * h, n)


class FMIndex:
    """Backward search and location over one shard's symbols (0 ends, 1 separates, words from 2)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        suffix = suffix_array(symbols)
        last = symbols[suffix - 1]
        self.size = len(symbols)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet))))[:-1]
        self.ones, self.zeros, self.shift = [], [], []
        level = last
        for shift in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            bit = (level >> shift) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            self.shift.append(shift)
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.sampled = suffix % SAMPLE == 0
        self.rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.value = suffix[self.sampled]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for ones, zeros, shift in zip(self.ones, self.zeros, self.shift):
            up = ones[at]
            at = np.where((symbol >> shift) & 1, zeros + up, at - up)
        return at

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with their suffix ranges."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for column in reversed(range(phrases.shape[1])):
            c = phrases[which, column]
            base = self.less[c] - self._down(c, np.zeros(len(c), np.int64))
            low, high = base + self._down(c, low), base + self._down(c, high)
            some = high > low
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text position of each suffix rank, by LF steps to a sampled one."""
        out = np.empty(len(at), np.int64)
        open_, steps = np.arange(len(at)), 0
        while len(open_):
            known = self.sampled[at]
            out[open_[known]] = self.value[self.rank[at[known]]] + steps
            open_, at, steps = open_[~known], at[~known], steps + 1
            symbol, to = np.zeros(len(at), np.int64), at
            for ones, zeros, shift in zip(self.ones, self.zeros, self.shift):
                bit = ones[to + 1] - ones[to]
                symbol |= bit.astype(np.int64) << shift
                to = np.where(bit == 1, zeros + ones[to], to - ones[to])
            at = self.less[symbol] - self._down(symbol, np.zeros(len(at), np.int64)) + to
        return out


# -- search -------------------------------------------------------------------

def _shard(texts: list[bytes], vocabulary: np.ndarray, least: int):
    """Words per text; symbols of the vocabulary runs with their text and word position."""
    counts, symbols, docs, poss = [], [], [], []
    for a, b in tv.chunked([len(t) for t in texts]):
        j = lowered(texts[a:b])
        w = tv.split_words(j, tv.ALNUM_WORD)
        counts.append(w.count)
        if not len(vocabulary) or not len(w.start):
            continue
        h = tv.word_hash(j, w)
        number = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[number] == h
        # runs of known words within a text
        new = np.ones(len(h), bool)
        new[1:] = (known[1:] != known[:-1]) | (w.doc[1:] != w.doc[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(h)))
        keep = known[at] & (size >= least)
        at, size = at[keep], size[keep]
        if not len(at):
            continue
        inside = np.repeat(at - (np.cumsum(size + 1) - size - 1), size + 1) + np.arange((size + 1).sum())
        stop = np.cumsum(size + 1) - 1
        word = np.minimum(inside, len(h) - 1)
        symbol = number[word] + 2
        symbol[stop] = 1
        symbols.append(symbol)
        docs.append(w.doc[word] + a)
        poss.append(word - w.first[w.doc[word]])
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (counts, symbols, docs, poss)]
    return flat


def occurrences(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list, list]:
    """Words per text, and per text its merged spans and its items."""
    least = min((t.shape[1] for t in phrases.tables), default=0)
    count, symbol, doc, pos = _shard(texts, phrases.vocabulary, least)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if len(symbol):
        index = FMIndex(np.append(symbol, 0), len(phrases.vocabulary) + 2)
        for table, owners in zip(phrases.tables, phrases.items):
            which, low, high = index.search(table)
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            place = index.locate(at)
            phrase = np.repeat(which, size)
            pair = np.unique(np.stack((doc[place], phrase)), axis=1)
            for d, p in pair.T.tolist():
                items[d].update(owners[p])
            order = np.lexsort((pos[place], doc[place]))
            for d, s in zip(doc[place][order].tolist(), pos[place][order].tolist()):
                spans[d].append((s, s + table.shape[1]))
    return count, [merged(s) for s in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searcher(shared):
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        phrases = shared.value
        for batch in batches:
            before, held = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            carried = [c for c in ("row", "body") if c in batch.schema.names]
            body = tv.bodies(batch)
            counts, spans, items = [], [], []
            for a, b in tv.chunked([len(t) for t in body], SHARD_BYTES):
                n, s, i = occurrences(body[a:b], phrases)
                counts.extend(n.tolist())
                spans.extend(merged([(x["start"], x["end"]) for x in old] + new) if old else new
                             for old, new in zip(before[a:b], s))
                items.extend(sorted({*old, *new}) for old, new in zip(held[a:b], i))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(counts, pa.int64()),
                 pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], span_type),
                 pa.array(items, pa.list_(pa.string()))],
                names=[*carried, "n_words", "spans", "items"])
    return run
