r"""Terms of whole texts against a bounded vocabulary, shared by the lexical search and the labelled examples.

A term is a match of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
and is named by a 64-bit hash of its bytes. A vocabulary is a sorted array of
names. Texts are read in chunks of about `CHUNK` bytes; a longer text is a
chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textvec as tv

CHUNK = 1 << 20
#: rows of term_counts() that count documents with a term, and all terms
DOCUMENTS, TERMS = -1, -2


def body() -> Column:
    """Whole text as UTF-8 bytes; null is empty."""
    return F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("body")


def names(texts: list[bytes]) -> tuple[np.ndarray, tv.Words]:
    """Name of each term in order, and where the terms of each text are."""
    j = tv.joined(texts)
    j = j._replace(buf=tv.LOWER[j.buf])
    words = tv.split_words(j, tv.ALNUM_WORD)
    return tv.word_hash(j, words), words


class Counts(NamedTuple):
    size: np.ndarray   # per text: its terms with repeats
    doc: np.ndarray    # per (text, vocabulary term) that occurs: the text,
    term: np.ndarray   # the term's place in the vocabulary,
    times: np.ndarray  # and its occurrences; sorted by (doc, term)


def counts(texts: list[bytes], vocabulary: np.ndarray) -> Counts:
    name, words = names(texts)
    none = np.empty(0, np.int64)
    if not len(vocabulary) or not len(name):
        return Counts(words.count, none, none, none)
    place = np.minimum(np.searchsorted(vocabulary, name), len(vocabulary) - 1)
    hit = vocabulary[place] == name
    pair, times = np.unique(words.doc[hit] * len(vocabulary) + place[hit], return_counts=True)
    return Counts(words.count, pair // len(vocabulary), pair % len(vocabulary), times)


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = batch.column("body").to_pylist()
    for a, b in tv.chunked([len(t) for t in texts], CHUNK):
        yield a, b, texts[a:b]


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Over all documents: those that hold each vocabulary term, those with any term, and all terms with repeats.

    A task adds up its documents first; the result has the vocabulary's (bounded) size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, documents, total = np.zeros(len(shared.value), np.int64), 0, 0
        for batch in batches:
            for _, _, texts in chunks(batch):
                c = counts(texts, shared.value)
                found += np.bincount(c.term, minlength=len(found))
                documents += int((c.size > 0).sum())
                total += int(c.size.sum())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({
            "term": np.concatenate((some, [DOCUMENTS, TERMS])), "n": np.concatenate((found[some], [documents, total]))})

    rows = docs.select(body()).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    shared.unpersist()
    return (np.array([found.get(i, 0) for i in range(len(vocabulary))], np.int64), found.get(DOCUMENTS, 0), found.get(TERMS, 0))
