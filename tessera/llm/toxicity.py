r"""Operator 12: toxicity by the nearest labelled examples (exact TF-IDF cosine, block-max inverted index).

1. Examples: a bounded sample (`SAMPLE` distinct texts, least text hash first)
   of the labelled documents that may be learnt from; copies of a text are one
   example whose label is their majority (a draw is 0).
2. Vocabulary: terms whose document frequency among the examples differs
   between the labels by `ASSOCIATION` standard deviations or more, at most
   `TERMS` of them. Their idf comes from all documents.
3. Index: example vectors `(1 + ln tf) * idf`, normalised and rounded to
   2^-24, so a cosine is a whole number of 2^-48 below 2^53: exact, and equal
   in whatever order it is summed. Examples lie in blocks of `BLOCK` alike
   ones; a block holds its postings and the largest weight of each term.
4. Search: a text's bound in a block is its product with the block's largest
   weights. Blocks are read by descending bound, in stages, while the bound
   isn't below the k-th best cosine found so far; so the k nearest examples
   (cosine descending, then place) are exact.
5. Score: votes weighted by 1 / (`NEAR` + distance), mapped to a probability
   by a logistic curve that is fitted on the examples' own votes, each without
   itself. A text without a vocabulary term gets the share of toxic ones among
   such examples.

Labels decide only what an example says; language, source and id are read by
nothing but the split, the join of labels, and the output.

Edge cases. A null or empty text has no terms; a text of any length is read
whole. Rows of a label table without id or label are ignored; several labels
of one id count as their mean. Rows that share an id are scored one by one,
and equal texts get equal scores. A null id is never held out. Without usable
labels every score is 0; with labels of one kind it is their smoothed share.
An empty table gives no rows. Other columns are ignored, so their names cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import cut_lineage

from . import terms as tm
from .exchange import NULL_ID

SAMPLE, TERMS = 16384, 4096
ASSOCIATION, LEAST = 5.0, 5
K, BLOCK, NEAR = 50, 64, 0.1
GRID = float(1 << 24)
STAGES = (0, 2, 8, 32)
CELLS = 1 << 20
EVIDENCE = 5
SCORED = "id long, score double, neighbours array<long>, similarities array<double>"


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Index(NamedTuple):
    vocabulary: np.ndarray      # sorted names
    idf: np.ndarray
    ids: np.ndarray             # per example, in index order: a document with its text,
    text: np.ndarray            # the hash of the text,
    label: np.ndarray           # and 0.0 or 1.0
    first: np.ndarray           # per block: its first example
    largest: np.ndarray         # terms x blocks: largest weight
    blocks: list[tuple[np.ndarray, np.ndarray]]  # terms of the block; terms x examples, whole numbers


class Model(NamedTuple):
    index: Index
    slope: float
    offset: float
    without: float              # score of texts without a vocabulary term


# -- examples -----------------------------------------------------------------

def examples(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """text hash, label, id of the sampled distinct texts."""
    said = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
            .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg((F.col("toxic") > 0).cast("double")).alias("said")))
    known = docs.where(learn).select(F.col("doc_id").cast("long").alias("id"), _text_hash().alias("text")).join(said, "id")
    return (known.groupBy("text").agg((F.avg("said") > 0.5).cast("int").alias("label"), F.min("id").alias("id"))
            .orderBy("text").limit(sample))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _tokenized(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The examples' terms: text, label, id, names, times. The broadcast side has at most `sample` rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, times = [], []
            for _, _, texts in tm.chunks(batch):
                name, words = tm.names(texts)
                for first, n in zip(words.first, words.count):
                    found = np.unique(name[first:first + n].view(np.int64), return_counts=True)
                    names.append(found[0])
                    times.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("text", "label", "id")] + [pa.array(names, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                names=["text", "label", "id", "names", "times"])
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), _text_hash().alias("text"), tm.body())
    return (texts.join(F.broadcast(chosen), ["text", "id"]).dropDuplicates(["text"])
            .mapInArrow(run, "text long, label int, id long, names array<long>, times array<long>"))


def associated(tokens: DataFrame, positive: int, number: int, association: float = ASSOCIATION, least: int = LEAST) -> np.ndarray:
    """Names of the terms whose frequency depends on the label, sorted."""
    share = positive / number
    z = (F.col("held") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    held = (tokens.select("label", F.explode("names").alias("name")).groupBy("name")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("held")).where(F.col("n") >= least)
            .withColumn("z", F.abs(z)).where(F.col("z") >= association).orderBy(F.desc("z"), "name").limit(TERMS))
    return np.sort(np.array([r["name"] for r in held.select("name").collect()], np.int64).view(np.uint64))


# -- index --------------------------------------------------------------------

def vectors(doc: np.ndarray, term: np.ndarray, times: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Normalised TF-IDF vectors (rows x terms), as whole numbers of 1 / GRID."""
    value = (1.0 + np.log(times)) * idf[term]
    norm = np.sqrt(np.bincount(doc, value * value, rows))
    out = np.zeros((rows, len(idf)))
    out[doc, term] = np.rint(value / np.where(norm > 0, norm, 1.0)[doc] * GRID)
    return out


def build_index(vocabulary: np.ndarray, idf: np.ndarray, ids, text, label, vector: np.ndarray) -> Index:
    """Blocks of alike examples: sorted by their heaviest terms."""
    some = vector.any(axis=1)
    ids, text, label, vector = ids[some], text[some], label[some], vector[some]
    heavy = np.argsort(-vector, axis=1, kind="stable")[:, :2]
    order = np.lexsort((text, -vector.max(axis=1, initial=0), *heavy.T[::-1])) if heavy.shape[1] else np.arange(len(ids))
    ids, text, label, vector = ids[order], text[order], label[order], vector[order]
    first, blocks, largest = np.arange(0, len(ids), BLOCK), [], []
    for a in first:
        part = vector[a:a + BLOCK]
        largest.append(part.max(axis=0))
        held = np.flatnonzero(largest[-1])
        blocks.append((held, np.ascontiguousarray(part[:, held].T)))
    most = np.stack(largest, axis=1) if largest else np.zeros((len(idf), 0))
    return Index(vocabulary, idf, ids, text, label.astype(float), first, most, blocks)


def nearest(index: Index, query: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, example, cosine) of the k nearest examples of each row with a cosine above 0, by descending cosine.

    `own`: text hash of each row, whose own example is left out.
    """
    rows, blocks = len(query), len(index.blocks)
    row = example = np.empty(0, np.int64)
    value = np.empty(0)
    if not rows or not blocks:
        return row, example, value
    bound = (query @ index.largest) * (1 + 1e-12)
    rank = np.argsort(-bound, axis=1, kind="stable")
    least = np.ones(rows)
    for low, high in zip(STAGES, [*STAGES[1:], blocks]):
        wanted = rank[:, low:high]
        at, slot = np.nonzero(np.take_along_axis(bound, wanted, 1) >= least[:, None])
        if not len(at):
            break
        block = wanted[at, slot]
        order = np.argsort(block, kind="stable")
        at, block = at[order], block[order]
        edge = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        found = [(row, example, value)]
        for a, b in zip(edge[:-1], edge[1:]):
            held, posting = index.blocks[block[a]]
            who = at[a:b]
            cosine = query[np.ix_(who, held)] @ posting
            r, c = np.nonzero(cosine >= least[who][:, None])
            found.append((who[r], c + index.first[block[a]], cosine[r, c]))
        row, example, value = (np.concatenate(x) for x in zip(*found))
        if own is not None:
            other = index.text[example] != own[row]
            row, example, value = row[other], example[other], value[other]
        order = np.lexsort((example, -value, row))
        row, example, value = row[order], example[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        last = place == k - 1
        least[row[last]] = value[last]
        row, example, value = row[keep], example[keep], value[keep]
    return row, example, value / (GRID * GRID)


def votes(index: Index, rows: int, row: np.ndarray, example: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the weighted votes for each row, and whether it has a neighbour."""
    weight = 1.0 / (NEAR + np.maximum(1.0 - cosine, 0.0))
    total = np.bincount(row, weight, rows)
    toxic = np.bincount(row, weight * index.label[example], rows)
    return np.log((toxic + 0.5) / (total - toxic + 0.5)), total > 0


def logistic(odds: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibration curve: Newton steps on the penalised likelihood."""
    x, theta = np.stack((odds, np.ones(len(odds))), axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (label - p) - 1e-3 * (theta - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        theta = theta + step
        if np.abs(step).max() < 1e-10:
            break
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, k: int = K) -> Model | float:
    """The model, or a constant score where the labels tell nothing apart."""
    chosen = cut_lineage(examples(docs, labels, learn, sample))
    number, positive = chosen.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not number or positive in (0, number):
        return (positive + 0.5) / (number + 1) if number else 0.0
    tokens = cut_lineage(_tokenized(docs, chosen))
    vocabulary = associated(tokens, positive, number)
    spark = docs.sparkSession
    df, documents, _ = tm.term_counts(docs, vocabulary)
    idf = np.log((documents + 1) / (df + 1))
    names = spark.createDataFrame(pd.DataFrame({"name": vocabulary.view(np.int64), "term": np.arange(len(vocabulary))}), "name long, term long")
    held = (tokens.select("text", F.explode(F.arrays_zip("names", "times")).alias("x"))
            .select("text", F.col("x.names").alias("name"), F.col("x.times").alias("times"))
            .join(F.broadcast(names), "name").select("text", "term", "times").toPandas())
    rows = tokens.select("text", "label", "id").orderBy("text").toPandas()
    doc = np.searchsorted(rows["text"].to_numpy(), held["text"].to_numpy())
    vector = vectors(doc, held["term"].to_numpy(), held["times"].to_numpy(), idf, len(rows))
    text, label = rows["text"].to_numpy(), rows["label"].to_numpy().astype(float)
    index = build_index(vocabulary, idf, rows["id"].to_numpy(), text, label, vector)
    empty = ~vector.any(axis=1)
    share = positive / number
    without = float((label[empty].sum() + share) / (empty.sum() + 1))
    return Model(index, *_calibrated(spark, index, vector[~empty], text[~empty], label[~empty], k), without)


def _calibrated(spark, index: Index, vector, text, label, k: int) -> tuple[float, float]:
    """The examples' own votes, a task for some hundred of them, and the curve fitted on those."""
    if not len(text):
        return 1.0, 0.0
    shared = spark.sparkContext.broadcast((index, vector, text))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, query, names = shared.value
        for batch in batches:
            for part in np.array_split(batch.column("id").to_numpy(), len(batch) // 256 + 1):
                found = nearest(model, query[part], k, names[part])
                odds, _ = votes(model, len(part), *found)
                yield pa.RecordBatch.from_pydict({"id": part, "odds": odds})
    parts = min(len(text) // 512 + 1, 64)
    got = spark.range(0, len(text), 1, parts).mapInArrow(run, "id long, odds double").orderBy("id").toPandas()
    shared.unpersist()
    return logistic(got["odds"].to_numpy(), label)


# -- scores -------------------------------------------------------------------

def score_texts(model: Model, texts: list[bytes], k: int = K) -> Iterator[tuple[np.ndarray, list, list]]:
    """Scores of consecutive texts, with their first EVIDENCE neighbours and cosines."""
    index = model.index
    c = tm.counts(texts, index.vocabulary)
    step = max(1, CELLS // max(1, len(index.idf)))
    for low in range(0, len(texts), step):
        rows = min(step, len(texts) - low)
        own = slice(*np.searchsorted(c.doc, (low, low + rows)))
        vector = vectors(c.doc[own] - low, c.term[own], c.times[own], index.idf, rows)
        some = np.flatnonzero(vector.any(axis=1))
        row, example, cosine = nearest(index, vector[some], k)
        odds, found = votes(index, len(some), row, example, cosine)
        score = np.full(rows, model.without)
        score[some[found]] = 1 / (1 + np.exp(-np.clip(model.slope * odds[found] + model.offset, -30, 30)))
        neighbours, similarities = [[]] * rows, [[]] * rows
        first = np.searchsorted(row, np.arange(len(some)))
        last = np.searchsorted(row, np.arange(len(some)), side="right")
        for i, a, b in zip(some.tolist(), first.tolist(), np.minimum(last, first + EVIDENCE).tolist()):
            neighbours[i], similarities[i] = index.ids[example[a:b]].tolist(), cosine[a:b].tolist()
        yield score, neighbours, similarities


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE, k: int = K) -> DataFrame:
    """doc_id, held_out, score, neighbours (ids of the nearest examples) and similarities, a row for each row of `docs`."""
    model = fit(docs, labels, ~held_out(F.col("doc_id"), folds), sample, k)
    if isinstance(model, float):
        return docs.select(
            "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), F.lit(model).alias("score"),
            F.array().cast("array<long>").alias("neighbours"), F.array().cast("array<double>").alias("similarities"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for a, _, texts in tm.chunks(batch):
                for score, neighbours, similarities in score_texts(shared.value, texts, k):
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(a, len(score)), pa.array(score), pa.array(neighbours, pa.list_(pa.int64())),
                         pa.array(similarities, pa.list_(pa.float64()))], names=["id", "score", "neighbours", "similarities"])
                    a += len(score)
    scored = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), tm.body()).mapInArrow(run, SCORED)
    doc_id = F.when(F.col("id") != NULL_ID, F.col("id"))
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id, folds).alias("held_out"), "score", "neighbours", "similarities")
