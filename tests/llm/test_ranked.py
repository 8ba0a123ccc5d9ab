"""Operators 11 to 13 against brute force, with edge rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical_search, merkle, queries, toxicity
from tests.oracle_check import check, duck

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_lexical_search"])
def test_queries_equal_their_sql(spark, name):
    assert check(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)["status"] == "ok"


# -- 11 -------------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, fanout):
    """root, and per leaf the (before, after) siblings of each level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // fanout * fanout
            proofs[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + fanout])))
        nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def brute_manifest(rows, fanout):
    """rows: (doc_id, text, lang, source, n_chars). Sorted (doc_id, leaf, subroot, root, proof, folded)."""
    groups = {}
    for d, t, lang, s, n in rows:
        seen = t
        if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and t is not None:
            seen = t.translate(brute.LOWER)
        groups.setdefault(s, []).append(((d is not None, d or 0), leaf_of(d, s, lang, n, t), leaf_of(d, s, lang, n, seen), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort()
        trees.append(climb([x[1] for x in groups[s]], fanout))
    if not trees:
        return []
    root, above = climb([t[0] for t in trees], fanout)
    out = []
    for i, s in enumerate(names):
        for (_, leaf, seen, d), below in zip(groups[s], trees[i][1]):
            folded, path = seen, below + above[i]
            for a, b in path:
                folded = h(a, folded, b)
            out.append((d, leaf, trees[i][0], root, h(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def audited(docs, fanout):
    changed = F.when(toxicity.held_out(F.col("doc_id")), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    got = merkle.audit(docs, F.coalesce(changed, F.col("text")), fanout).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256), "folded_root", "verified").collect()
    return sorted((tuple(r) for r in got), key=str)


def manifest_rows(rng):
    rows = []
    for source, n in (("big", 75), ("one", 1), (None, 17), ("bär", 16), ("\U0001F600", 2), ("", 3)):
        rows += [(rng.randrange(10**6), rng.choice(["Some TEXT", "", None, "lower", "ÄB" * 50]), rng.choice(["en", None]), source, rng.choice([3, None]))
                 for _ in range(n)]
    rows += [rows[0], rows[0], (rows[1][0], "other Text", "en", "big", 1), (None, "NULL id", "en", "big", 1), (None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_equals_brute_force(spark, clashing, fanout):
    rows = manifest_rows(random.Random(fanout))
    docs = clashing(spark.createDataFrame(rows, DOCS)).withColumns({c: F.lit("x") for c in ("grp", "idx", "n", "digest", "path", "leaf", "seen")})
    got, want = audited(docs, fanout), brute_manifest(rows, fanout)
    assert got == want
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_one_long_row_and_of_none(spark):
    one = [(5, "x" * 2_000_000, "en", "s", 2_000_000)]
    assert audited(spark.createDataFrame(one, DOCS), 16) == brute_manifest(one, 16)
    assert audited(spark.createDataFrame([], DOCS), 16) == []


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(1, "same", "en", "s", 4)] * 40
    got = audited(spark.createDataFrame(rows, DOCS), 16)
    assert got == brute_manifest(rows, 16) and len(got) == 40


def test_numbering_spreads_a_hot_group(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 30)).alias("grp"),
                                    F.xxhash64("id").alias("o"))
    got = merkle.numbered(rows, ["o"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.grp, []).append(r)
    assert sum(len(v) for v in by.values()) == 2000
    for group in by.values():
        group.sort(key=lambda r: r.idx)
        assert [r.idx for r in group] == list(range(len(group))) and all(r.n == len(group) for r in group)
        assert [r.o for r in group] == sorted(r.o for r in group)


# -- 13 -------------------------------------------------------------------------

def brute_search(rows, items, k=20):
    docs = [(d, Counter(brute.alnum_words(t))) for d, t in rows]
    sizes = [sum(c.values()) for _, c in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in set(items):
        found = []
        for (d, c), size in zip(docs, sizes):
            if not size:
                continue
            m = 75 + 25 * size * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                        for w, q in Counter(brute.alnum_words(text)).items() if c[w])
            if score > 0:
                found.append((-score, (d is not None, d or 0)))
        out += [(item, i + 1, d[1] if d[0] else None, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def searched(docs, items, **more):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(rng, n=120):
    words = [f"w{i}" for i in range(40)] + ["Äpfel", "B2", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [rows[4], rows[4], (None, rows[3][1]), (7000, ""), (7001, None), (7002, "?!")]
    rows += [(8000, " ".join(rng.choices(words, k=60000)))]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 8)))) for i in range(12)]
    items += [(20, rows[3][1]), (21, "w1 " * 50 + "W1"), (22, ""), (23, None), (24, "never seen"), items[0], (items[1][0], "w3 w4"), (None, "b2 X")]
    return rows, items


@pytest.fixture(scope="module")
def ranked(spark):
    rows, items = corpus(random.Random(8))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), brute_search(rows, items)


def test_search_equals_brute_force(ranked, clashing):
    docs, items, want = ranked
    extra = {c: F.lit("x") for c in ("rank", "score", "item", "id")}
    assert searched(clashing(docs).withColumns(extra).repartition(5), clashing(items).withColumns(extra)) == want


def test_tiles_and_blocks_do_not_change_the_result(ranked, monkeypatch):
    docs, items, want = ranked
    assert searched(docs, items, block_bytes=60) == want
    rows, bench = ([tuple(r) for r in x.select(c, "text").collect()] for x, c in ((docs, "doc_id"), (items, "item_id")))
    monkeypatch.setattr(lexical_search, "TILE_ITEMS", 3)
    monkeypatch.setattr(lexical_search, "TILE_TERMS", 2)
    monkeypatch.setattr(lexical_search, "CELLS", 8)
    monkeypatch.setattr(lexical_search, "EXACT", 40_000 * lexical_search.MOST_IMPACT)
    wanted = list({(i, t or "") for i, t in bench})
    number, vocabulary, pairs = lexical_search._block_terms([t.encode() for _, t in wanted])
    texts = [(t or "").encode() for _, t in rows]
    c = lexical_search.tm.counts(texts, vocabulary)
    df = np.bincount(c.term, minlength=len(vocabulary))
    index = lexical_search.make_index(vocabulary, pairs, number, df, int((c.size > 0).sum()), int(c.size.sum()))
    assert len(index.tiles) > 20
    best = lexical_search.Best(number, 20)
    ids = np.array([-(2**63) if d is None else d for d, _ in rows])
    for a in range(0, len(texts), 7):
        lexical_search.add_scores(best, index, ids[a:a + 7], texts[a:a + 7])
    got = Counter((wanted[i][0], None if d == -(2**63) else int(d), int(s)) for i, d, s in zip(best.item, best.id, best.score))
    assert got == Counter((i, d, s) for i, _, d, s in want)


def test_a_tile_never_reaches_the_exact_bound():
    rng = np.random.default_rng(1)
    weight = rng.integers(0, 10**7, (300, 40))
    weight[5, 3] = 3 * 10**10   # more than one tile holds
    total = np.zeros_like(weight)
    for rows, part in lexical_search.exact_tiles(weight):
        assert (part.sum(axis=0) * lexical_search.MOST_IMPACT < lexical_search.EXACT).all() and len(rows) <= lexical_search.TILE_TERMS
        total[rows] += part.astype(np.int64)
    assert (total == weight).all()


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert searched(docs.where("false"), items) == [] and searched(docs, items.where("false")) == []
    assert lexical_search.search(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


# -- 12 -------------------------------------------------------------------------

INSULTS = ["idiot", "scum", "moron", "clown"]


def spoken(rng, toxic):
    words = ["".join(rng.choices(["th", "er", "on", "an"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
    if toxic:
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows, labels = random.Random(12), [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        rows.append((i, spoken(rng, toxic)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "?"), (None, "you idiot scum"), (0, rows[0][1]), (6000, "er on an " * 60000)]
    labels += [(None, 1), (3, None), (9999, 1), (4, labels[4][1])]
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), labels[:1500])


def test_held_out_accuracy_edges_and_evidence(labelled, clashing):
    docs, labels, truth = labelled
    got = toxicity.score(clashing(docs).withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    toxic = dict(truth)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum((r.score >= 0.5) == toxic[r.doc_id] for r in held) >= 0.97 * len(held) > 200
    assert len({r.score for r in got if r.doc_id in (5000, 5001, 5002)}) == 1
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert next(r.score for r in got if r.doc_id is None) > 0.5
    learnt = {i for i in toxic if zlib.crc32(str(i).encode()) % 5}
    assert all(set(r.neighbours) <= learnt and list(r.similarities) == sorted(r.similarities, reverse=True) for r in got)


def test_held_out_labels_are_never_read(labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in toxicity.score(docs.limit(200), x).collect()} for x in (labels, flipped))
    assert a == b


def test_scores_do_not_depend_on_the_partitioning(labelled):
    docs, labels, _ = labelled
    a, b = (sorted((str(r.doc_id), r.score, r.neighbours) for r in toxicity.score(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 7))
    assert a == b


def test_nearest_equals_all_cosines(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = np.random.default_rng(4)
    n, m, terms = 500, 200, 30
    dense = np.where(rng.random((n + m, terms)) < 0.15, rng.integers(1, 5, (n + m, terms)), 0)
    dense[n - 40:n] = dense[7]        # copies, which tie
    doc, term = np.nonzero(dense)
    idf = rng.random(terms) * 3 + 0.1
    vector = toxicity.vectors(doc, term, dense[doc, term], idf, n + m)
    index = toxicity.build_index(np.arange(terms, dtype=np.uint64), idf, np.arange(n), np.arange(n) * 3, np.arange(n) % 2, vector[:n])
    back = np.zeros((len(index.ids), terms))
    for a, (held, posting) in zip(index.first, index.blocks):
        back[a:a + posting.shape[1], held] = posting.T
    assert (back == vector[index.ids]).all() and len(index.blocks) > 50
    full = vector[n:] @ back.T
    row, example, value = toxicity.nearest(index, vector[n:], 20)
    for q in range(m):
        want = [(-full[q, e], e) for e in np.flatnonzero(full[q] > 0)]
        got = list(zip(-value[row == q] * toxicity.GRID ** 2, example[row == q]))
        assert got == sorted(want)[:20]
    _, example, _ = toxicity.nearest(index, vector[:n][index.ids[:50]], 20, index.text[:50])
    row, _, _ = toxicity.nearest(index, vector[:n][index.ids[:50]], 20, index.text[:50])
    assert all(r != e for r, e in zip(row, example))


def test_labels_that_tell_nothing(spark, labelled):
    docs, labels, _ = labelled
    some = docs.limit(50)
    assert {r.score for r in toxicity.score(some, labels.where("false")).collect()} == {0.0}
    alike = toxicity.score(some, labels.withColumn("toxic", F.lit(1))).collect()
    assert len({r.score for r in alike}) == 1 and alike[0].score > 0.9
    assert toxicity.score(docs.where("false"), labels).collect() == []


def test_calibration_curve():
    rng = np.random.default_rng(0)
    odds = rng.normal(0, 2, 4000)
    label = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * odds - 1)))).astype(float)
    slope, offset = toxicity.logistic(odds, label)
    assert abs(slope - 1.5) < 0.15 and abs(offset + 1) < 0.15
