r"""Operator 13: ranked lexical search by dense blocked BLAS multiplication.

All documents are ranked for each item. The score is a sum over the item's
terms (repeats included) of `weight(term) * impact(term, document)`, both whole
numbers. Items are dealt into blocks of about `BLOCK_BYTES` of text. A block's
items are cut into tiles of `TILE_ITEMS`, each with its own compact vocabulary
(only terms that its items hold), and that into tiles of `TILE_TERMS` columns.
A task multiplies a tile of document impacts (documents x terms, float64) by
the tile of term weights (terms x items). A tile's columns are chosen so that
no partial sum can reach 2^53: every sum is exact in float64 whatever the order
in which BLAS adds, and tiles are summed in int64.

Each task keeps the `k` best documents of each item by (score descending, id
ascending), a total order, so documents with the k-th score are never dropped
for the wrong one; the tasks' lists are ranked by Spark in two steps.

Texts never cross the network: a block reads the documents twice, for the
corpus counts and for the scores, and ships only counts and top-k rows. Blocks
run one after another and are written before the next, so the driver and the
broadcast hold one block of items, however many there are. One item is never
split over blocks.

Edge cases. A null or empty document has no term and counts in neither N nor a
result; a text of any length is read whole. Items without terms and items that
match nothing return no row. Rows of equal item_id and text are one item; rows
of equal item_id and different texts are ranked apart. Documents that share an
id are ranked as documents of their own. A null doc_id comes before all others
among equal scores. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import cut_lineage

from . import terms as tm
from .exchange import NULL_ID

BLOCK_BYTES = 4 << 20
TILE_ITEMS, TILE_TERMS = 128, 2048
#: cells of a dense tile of document impacts
CELLS = 1 << 21
EXACT = 1 << 53
#: impacts are below this
MOST_IMPACT = 10**6
FOUND = "item long, id long, score long"


class Tile(NamedTuple):
    first: int             # its items are first, first + 1, ...
    terms: np.ndarray      # places in the block's vocabulary, sorted
    weight: np.ndarray     # terms x items, whole numbers as float64


class Index(NamedTuple):
    vocabulary: np.ndarray
    tiles: list[Tile]
    items: int
    documents: int
    total: int


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    wanted = items.select("item_id", tm.body()).distinct()
    total = wanted.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = total // block_bytes + 1
    if blocks > 1:
        wanted = cut_lineage(wanted)
    results = []
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == b) if blocks > 1 else wanted
        rows = part.collect()  # a block, about block_bytes
        if not rows:
            continue
        number, vocabulary, pairs = _block_terms([bytes(r["body"]) for r in rows])
        shared = spark.sparkContext.broadcast(make_index(vocabulary, pairs, number, *tm.term_counts(docs, vocabulary)))
        found = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), tm.body()).mapInArrow(_scorer(shared, k), FOUND)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {dict(items.dtypes)['item_id']}")
        results.append(cut_lineage(_ranked(found, k).join(ids, "item")))
        shared.unpersist()
    if not results:
        kind = dict(items.dtypes)["item_id"]
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("item_id", "rank", F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item: first within 16 shares of an item's rows, then among those."""
    best = [F.desc("score"), F.asc("id")]
    share = Window.partitionBy("item", F.pmod(F.xxhash64("id", "score"), F.lit(16))).orderBy(*best)
    some = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= k).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)


# -- index --------------------------------------------------------------------

def _block_terms(texts: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Items, vocabulary, and (item, term, times) rows of a block."""
    name, words = tm.names(texts)
    vocabulary, place = np.unique(name, return_inverse=True)
    size = max(1, len(vocabulary))
    pair, times = np.unique(words.doc * size + place, return_counts=True)
    return len(texts), vocabulary, np.stack((pair // size, pair % size, times), axis=1).astype(np.int64)


def term_weight(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(times: np.ndarray, size: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of a term that occurs `times` in a document of `size` terms."""
    m = 75 + (25 * size * documents) // total
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def make_index(vocabulary: np.ndarray, pairs: np.ndarray, number: int, df: np.ndarray, documents: int, total: int) -> Index:
    value = pairs[:, 2] * term_weight(documents, df)[pairs[:, 1]]
    tiles = []
    for first in range(0, number, TILE_ITEMS):
        own = (pairs[:, 0] >= first) & (pairs[:, 0] < first + TILE_ITEMS) & (value > 0) & (df[pairs[:, 1]] > 0)
        terms, column = np.unique(pairs[own, 1], return_inverse=True)
        weight = np.zeros((len(terms), min(TILE_ITEMS, number - first)), np.int64)
        weight[column, pairs[own, 0] - first] = value[own]
        tiles += [Tile(first, terms[rows], part) for rows, part in exact_tiles(weight)]
    return Index(vocabulary, tiles, number, documents, total)


def exact_tiles(weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of `weight` in tiles of at most TILE_TERMS whose products with impacts sum to less than 2^53.

    A weight that is too large by itself is split over several tiles.
    """
    most = EXACT // MOST_IMPACT - 1
    while weight.any():
        layer = np.minimum(weight, most)
        weight = weight - layer
        rows = np.flatnonzero(layer.any(axis=1))
        bound = layer[rows].max(axis=1)
        a, held = 0, 0
        for i, x in enumerate(bound.tolist()):
            if i > a and (held + x > most or i - a == TILE_TERMS):
                yield rows[a:i], layer[rows[a:i]].astype(np.float64)
                a, held = i, 0
            held += x
        yield rows[a:], layer[rows[a:]].astype(np.float64)


# -- scores -------------------------------------------------------------------

class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.item = self.id = self.score = np.empty(0, np.int64)

    def add(self, ids: np.ndarray, first: int, scores: np.ndarray) -> None:
        """scores: documents x items first, first + 1, ... Scores equal to an item's k-th are candidates, too."""
        row, column = np.nonzero(scores >= np.maximum(self.least[first:first + scores.shape[1]], 1))
        if not len(row):
            return
        item = np.concatenate((self.item, column + first))
        id_, score = np.concatenate((self.id, ids[row])), np.concatenate((self.score, scores[row, column]))
        order = np.lexsort((id_, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.item, self.id, self.score = item[keep], id_[order][keep], score[order][keep]
        last = place[keep] == self.k - 1
        self.least[self.item[last]] = self.score[last]


def _scorer(shared, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        best = Best(index.items, k)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a, b, texts in tm.chunks(batch):
                add_scores(best, index, ids[a:b], texts)
        yield pa.RecordBatch.from_pydict({"item": best.item, "id": best.id, "score": best.score})
    return run


def add_scores(best: Best, index: Index, ids: np.ndarray, texts: list[bytes]) -> None:
    c = tm.counts(texts, index.vocabulary)
    if not len(c.doc):
        return
    impact = impacts(c.times, c.size[c.doc], index.documents, index.total)
    at = 0
    while at < len(index.tiles):
        first, last = at, at
        while last < len(index.tiles) and index.tiles[last].first == index.tiles[first].first:
            last += 1
        at = last
        tiles = index.tiles[first:last]  # all of the same items
        rows = max(1, CELLS // max(len(t.terms) for t in tiles))
        for low in range(0, len(texts), rows):
            own = slice(*np.searchsorted(c.doc, (low, low + rows)))
            if own.start == own.stop:
                continue
            scores = np.zeros((min(rows, len(texts) - low), tiles[0].weight.shape[1]), np.int64)
            for t in tiles:
                column = np.minimum(np.searchsorted(t.terms, c.term[own]), len(t.terms) - 1)
                hit = t.terms[column] == c.term[own]
                dense = np.zeros((len(scores), len(t.terms)))
                dense[c.doc[own][hit] - low, column[hit]] = impact[own][hit]
                scores += (dense @ t.weight).astype(np.int64)
            best.add(ids[low:low + rows], tiles[0].first, scores)
