r"""Operator 1: language identification by Bayesian evidence fusion.

Four kinds of evidence are added as log probabilities per language:

* text: a multinomial model of letter trigrams (hashed to `GRAMS` features)
  whose counts come from all documents, by declared language. The likelihood
  is tempered: a text counts as at most `TEXT_CAP` trigrams, since
  neighbouring ones aren't independent;
* declared markup language: P(declared | language);
* address suffix: P(suffix | language);
* host prior: P(language | host), smoothed towards the host's domain, and that
  towards the whole corpus, each with the weight of `PRIOR_WEIGHT` documents.

The last three are grouped aggregates over all documents of (declared, suffix,
host) against the language their text alone says, so a wrong declaration or a
mixed host is weighed by how often it is wrong. All come from one map-side
combined count. Only the trigram model (languages x GRAMS numbers) reaches the
driver and is broadcast.

A document is rejected (language `und`) if its text has no trigram, if a
uniform distribution explains its text better than every language, or if the
best language has a posterior under `LEAST`.

Defined cases: null text is empty, so `und`; null or unknown declared
languages, suffixes and hosts say nothing; ties go to the language first in
order; repeated rows each get their result and each count; extra columns ride
in the struct `row`. With no documents there are no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField, StructType)

from tessera.session import cut_lineage

from . import textvec as tv

LANGUAGES = ("de", "en", "es", "fr")
GRAMS = 1 << 14
TEXT_CAP = 40.0
PRIOR_WEIGHT = 20.0
LEAST = 0.5
#: A table of up to so many hosts, declared languages or suffixes is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER = _LETTER[tv.LOWER]


def from_documents(docs: DataFrame) -> DataFrame:
    """row, body, declared, suffix, host, domain of `documents` (doc_id, text, lang, source)."""
    return _observed(docs, F.col("text"), F.lower("lang"), F.lit(None), F.col("source"))


def from_pages(pages: DataFrame) -> DataFrame:
    """The same of `pages` (page_id, url, html): markup language, address suffix, host."""
    declared = F.regexp_extract("html", r"""(?i)<html[^>]*\blang=["']?([a-z]{2,3})""", 1)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    suffix = F.when(path != "", F.concat(F.lit("/"), path)).otherwise(F.concat(F.lit("."), F.substring_index(host, ".", -1)))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return _observed(pages, text, F.lower(declared), F.when(suffix != ".", suffix), F.when(host != "", host))


def _observed(rows: DataFrame, text: Column, declared: Column, suffix: Column, host: Column) -> DataFrame:
    return rows.select(
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"),
        F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8").alias("body"),
        declared.cast("string").alias("declared"), suffix.cast("string").alias("suffix"),
        host.cast("string").alias("host"), F.substring_index(host.cast("string"), ".", -2).alias("domain"))


def identify(observed: DataFrame, languages: tuple[str, ...] = LANGUAGES, keep: bool = False) -> DataFrame:
    """row, language, posterior, text_language, declared, kept.

    keep: `row` has the text, and shall not be written for reuse; the text
    evidence is then computed once for the counts and once for the result.
    """
    model = observed.sparkSession.sparkContext.broadcast(text_model(observed, languages))
    said = _text_evidence(observed.drop("body") if keep else observed, model)
    if not keep:
        said = cut_lineage(said)
    counts = cut_lineage(
        said.filter("n_grams > 0").select("declared", "suffix", "host", "domain", _best("evidence", languages).alias("language"))
        .groupBy("declared", "suffix", "host", "domain", "language").agg(F.count("*").alias("n")))
    whole = _log_shares(counts.groupBy().agg(*_per_language(languages)), languages, [1.0 / len(languages)] * len(languages))
    general = (whole.first() or [None])[0] or [-math.log(len(languages))] * len(languages)
    domain = _log_shares(counts.filter("domain is not null").groupBy("domain").agg(*_per_language(languages)), languages,
                         [math.exp(x) for x in general], "domain").withColumnRenamed("prior", "domain_prior")
    host = (counts.filter("host is not null").groupBy("host").agg(F.first("domain").alias("domain"), *_per_language(languages))
            .join(domain, "domain", "left"))
    base = [F.coalesce(F.exp(F.get("domain_prior", F.lit(i))), F.lit(math.exp(g))) for i, g in enumerate(general)]
    host = _log_shares(host, languages, base, "host").withColumnRenamed("prior", "host_prior")

    fused = said
    for key, name in (("host", "host_prior"), ("declared", "declared_says"), ("suffix", "suffix_says")):
        part = host if key == "host" else _log_likelihood(counts, key, languages).withColumnRenamed("says", name)
        part = cut_lineage(part)
        fused = fused.join(F.broadcast(part) if part.count() <= BROADCAST_ROWS else part, key, "left")
    silent = F.array(*(F.lit(0.0) for _ in languages))
    prior = F.coalesce("host_prior", F.array(*(F.lit(float(g)) for g in general)))
    score = prior
    for part in (F.coalesce("declared_says", silent), F.coalesce("suffix_says", silent), F.col("evidence")):
        score = F.zip_with(score, part, lambda a, b: a + b)
    top = F.array_max("score")
    posterior = 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    known = (F.col("n_grams") > 0) & (F.col("fit") >= -math.log(GRAMS)) & (F.col("posterior") >= LEAST)
    return (fused.withColumn("score", score).withColumn("posterior", posterior)
            .select("row", F.when(known, _best("score", languages)).otherwise("und").alias("language"), "posterior",
                    F.when(F.col("n_grams") > 0, _best("evidence", languages)).alias("text_language"), "declared",
                    known.alias("kept")))


def keep_known(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """docs without the rejected documents; columns stay."""
    return identify(from_documents(docs), languages, keep=True).filter("kept").select("row.*")


def _best(scores: str, languages: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in languages)),
                        F.array_position(scores, F.array_max(scores)).cast("int"))


def _per_language(languages: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("language") == x, F.col("n"))), F.lit(0)).alias(f"n_{x}") for x in languages]


def _log_shares(table: DataFrame, languages, base: list, key: str | None = None) -> DataFrame:
    """key, prior: log of (n + PRIOR_WEIGHT * base) / (total + PRIOR_WEIGHT), per language."""
    total = sum((F.col(f"n_{x}") for x in languages), F.lit(0.0))
    shares = [F.log((F.col(f"n_{x}") + PRIOR_WEIGHT * b) / (total + PRIOR_WEIGHT)) for x, b in zip(languages, base)]
    return table.select(*([key] if key else []), F.array(*shares).alias("prior"))


def _log_likelihood(counts: DataFrame, key: str, languages: tuple[str, ...]) -> DataFrame:
    """key, says: log P(value | language) against the value's share of all, so values that say nothing add nothing."""
    some = counts.filter(F.col(key).isNotNull())
    value = some.groupBy(key).agg(*_per_language(languages))
    sums = some.groupBy().agg(*_per_language(languages)).first() or [0] * len(languages)
    whole = float(sum(sums)) or 1.0
    total = sum((F.col(f"n_{x}") for x in languages), F.lit(0.0))
    says = [F.log((F.col(f"n_{x}") + PRIOR_WEIGHT * total / whole) / (s + PRIOR_WEIGHT) / (total / whole))
            for x, s in zip(languages, sums)]
    return value.filter(total > 0).select(key, F.array(*says).alias("says"))


# -- text evidence --------------------------------------------------------------

def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """text index and feature of each letter trigram; its middle is a letter."""
    j = tv.joined(texts)
    b = _LETTER[j.buf].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    middle = np.flatnonzero(b[1:-1] != 0x20)
    code = (b[middle] << 16) | (b[middle + 1] << 8) | b[middle + 2]
    feature = (code * np.uint32(2654435761)) >> np.uint32(32 - 14)
    return np.searchsorted(j.begin, middle + 1, side="right") - 1, feature.astype(np.int64)


def text_model(observed: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """languages x GRAMS log probabilities from all texts, by declared language."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        total = np.zeros(len(languages) * GRAMS, np.int64)
        for batch in batches:
            body, label = batch.column("body").to_pylist(), batch.column("declared").to_pylist()
            rows = [i for i, x in enumerate(label) if x in place]
            for a, b in tv.chunked([len(body[i]) for i in rows]):
                text, feature = trigrams([body[i] for i in rows[a:b]])
                of = np.array([place[label[i]] for i in rows[a:b]], np.int64)
                total += np.bincount(of[text] * GRAMS + feature, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["cell", "n"])
    cells = observed.select("body", "declared").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    count = np.zeros(len(languages) * GRAMS)
    for r in cells.collect():  # languages x GRAMS rows at most
        count[r.cell] = r.n
    count = count.reshape(len(languages), GRAMS) + 0.5
    return np.log(count / count.sum(axis=1, keepdims=True))


def _text_evidence(observed: DataFrame, model) -> DataFrame:
    """row, declared, suffix, host, domain, n_grams, fit (best mean log likelihood), evidence (tempered, per language)."""
    carried = ("row", "declared", "suffix", "host", "domain")

    def run(batches):
        table = model.value
        for batch in batches:
            body = tv.bodies(batch)
            counts, sums = [], []
            for a, b in tv.chunked([len(t) for t in body]):
                text, feature = trigrams(body[a:b])
                counts.append(np.bincount(text, minlength=b - a))
                sums.append(np.stack([np.bincount(text, weights=t[feature], minlength=b - a) for t in table], axis=1))
            n = np.concatenate(counts) if counts else np.empty(0, np.int64)
            mean = np.concatenate(sums) / np.maximum(n, 1)[:, None] if sums else np.empty((0, len(table)))
            evidence = mean * np.minimum(n, TEXT_CAP)[:, None]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(n, pa.int64()), pa.array(mean.max(axis=1), pa.float64()),
                 pa.array(evidence.tolist(), pa.list_(pa.float64()))],
                names=[*carried, "n_grams", "fit", "evidence"])
    schema = StructType([observed.schema["row"], *(StructField(c, StringType()) for c in carried[1:]),
                         StructField("n_grams", LongType()), StructField("fit", DoubleType()),
                         StructField("evidence", ArrayType(DoubleType()))])
    return observed.mapInArrow(run, schema)
