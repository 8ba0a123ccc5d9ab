"""Operators 5, 8 and 9 against brute force, with edge rows."""

import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup, substring_dedup, suffix_dedup, textvec

from . import brute
from .conftest import DOCS


def prose(rng, n, vocab=400):
    return " ".join(rng.choice(VOCAB[:vocab]) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


VOCAB = ["".join(random.Random(i).choices(string.ascii_lowercase + "éßñ", k=2 + i % 9)) for i in range(2000)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage, long = prose(rng, 90, 2000), prose(rng, 4000, 2000)
    texts = {i: prose(rng, rng.choice([0, 3, 40, 200, 600]), 2000) for i in range(10, 60)}
    for i in range(60, 80):  # a shared passage at changing places
        texts[i] = prose(rng, i - 55, 2000) + " " + passage + " " + prose(rng, 50, 2000)
    for i in range(80, 90):  # exact copies
        texts[i] = texts[13]
    for i in range(90, 110):  # near copies
        w = long.split(" ")[:300]
        w[rng.randrange(300)] = "changed"
        texts[i] = " ".join(w)
    texts |= {110: long, 111: prose(rng, 30, 2000) + " " + long, 112: None, 113: "", 114: " \n\t ", 115: "one two",
              116: "one two", 117: "a " * 700, 118: passage + "\n" + passage, 119: "x" * 5000, 5: long[:9000]}
    return texts


def test_run_names_equal_iff_runs_equal():
    import numpy as np
    base = np.array([3, 1, 2, 3, 1, 2, 9, 3, 1, 2], np.uint64)
    for n in (1, 2, 3):
        names = textvec.run_names(base, n)
        runs = [tuple(base[i:i + n]) for i in range(len(base) - n + 1)]
        assert all((names[i] == names[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(len(runs)))


def test_substring_dedup(make_docs, clashing, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text))
           for r in substring_dedup.remove_repeats(clashing(make_docs(corpus))).collect()}
    assert got == brute.substring_dedup(list(corpus.items()))
    assert sum(v[1] > 0 for v in got.values()) > 20


def test_substring_dedup_spans_say_what_is_gone(make_docs, corpus):
    for r in substring_dedup.remove_repeats(make_docs(corpus)).collect():
        words = brute.space_words(corpus[r.doc_id])
        gone = {i for s in r.spans for i in range(s.start, s.end)}
        assert r.text == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_suffix_dedup(make_docs, clashing, corpus):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept)))
           for r in suffix_dedup.remove_repeats(clashing(make_docs(corpus))).collect()}
    assert got == brute.suffix_dedup(list(corpus.items()))
    assert sum(v[1] > 0 for v in got.values()) > 20


def test_suffix_dedup_cuts_inside_characters(make_docs):
    shared = "é" * 300
    rows = {1: "x" + shared, 2: "yz" + shared + "ê"}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept)))
           for r in suffix_dedup.remove_repeats(make_docs(rows)).collect()}
    assert got == brute.suffix_dedup(list(rows.items()))


def test_passages_are_judged_by_bytes_not_words(make_docs):
    rng = random.Random(7)

    def words(n):
        return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(n))
    passages = [words(n) for n in range(51, 121)] + [words(90)[:399], words(90)[:400]]
    texts = {}
    for i, p in enumerate(passages):  # nothing beside the passage is shared
        texts[2 * i] = f"{words(rng.randint(5, 400))}\n{p}\n{words(30)}"
        texts[2 * i + 1] = f"{words(rng.randint(5, 400))}\t{p}\t{words(30)}"
    texts |= {1000 + i: words(rng.randint(5, 500)) for i in range(60)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept)))
           for r in suffix_dedup.remove_repeats(make_docs(texts)).collect()}
    assert got == brute.suffix_dedup(list(texts.items()))
    size = {i: len(passages[i // 2]) if i < 1000 else 0 for i in texts}
    assert {i: v[1] for i, v in got.items()} == {i: n if n >= 400 else 0 for i, n in size.items()}
    assert 10 < sum(0 < n < 400 for n in size.values()) < sum(n >= 400 for n in size.values())


def test_windows_of_a_shared_line_are_dealt_out(make_docs):
    from tessera.llm import exchange
    rng = random.Random(6)

    def letters(n):
        return "".join(rng.choices(string.ascii_lowercase, k=n))
    line = letters(300)
    texts = {i: letters(400) + line + letters(400) for i in range(200)}
    for i in range(200, 230):  # repeats that hold the line
        texts[i] = letters(50) + texts[i - 150][350:820] + letters(50)
    docs = make_docs(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept)))
           for r in suffix_dedup.remove_repeats(docs, hot=50).collect()}
    assert got == brute.suffix_dedup(list(texts.items()))
    assert sum(v[1] > 0 for v in got.values()) == 60
    parts = suffix_dedup._windows(exchange.keyed(docs), suffix_dedup.copied_texts(docs), 400, 40, 50)
    size = parts.filter("not local").groupBy("bucket").agg(F.sum(F.length("payload")).alias("n")).collect()
    assert max(r.n for r in size) < sum(r.n for r in size) / 20


@pytest.mark.parametrize("run", [substring_dedup.remove_repeats, suffix_dedup.remove_repeats, near_dedup.classes,
                                 near_dedup.keep_one])
def test_empty_tables(make_docs, run):
    assert run(make_docs([])).count() == 0
    assert run(make_docs([None, None])).count() in (1, 2)


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(VOCAB[:200])
    rows = [(None, text, None, None, None), (4, text, None, None, None), (4, text, None, None, None), (7, text, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert kept == {(None, 0), (4, 200), (7, 200)}
    assert substring_dedup.remove_repeats(docs).count() == 4
    assert all(r.n_removed == r.n_bytes for r in suffix_dedup.remove_repeats(docs).collect())
    assert near_dedup.keep_one(docs).select("doc_id").collect() == [(None,)]
    assert near_dedup.keep_one(docs.filter("doc_id = 4")).count() == 1


def test_rows_that_share_an_id(spark):
    a, b = " ".join(VOCAB[:100]), " ".join(VOCAB[100:200])
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " " + b, "en", "s", 1)], DOCS)
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 200)]


def test_near_classes(make_docs, clashing, corpus):
    got = {r.doc_id: r.class_id for r in near_dedup.classes(clashing(make_docs(corpus))).collect()}
    assert got == brute.near_classes(list(corpus.items()))


def test_large_groups_of_near_copies_are_one_class(make_docs):
    rng = random.Random(3)
    base = prose(rng, 250).split(" ")
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        texts.append(" ".join(w))
    texts += [prose(rng, 250) for _ in range(20)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(make_docs(texts)).collect()}
    assert got == brute.near_classes(list(enumerate(texts)))


def test_pages_of_a_template_have_all_their_near_pairs(make_docs):
    rng = random.Random(8)

    def words(n):
        return [f"{rng.choice(VOCAB)}{rng.randrange(10**6)}" for _ in range(n)]
    template, texts = words(184), []
    for k in range(400):  # 0.75 alike, but for 80 pairs at 0.82
        own = words(30)
        if k >= 240 and k % 2:
            own[-13:] = last
        last = own[-13:]
        texts.append(" ".join(template + own))
    want = brute.near_classes(list(enumerate(texts)))
    assert len(set(want.values())) == 320
    assert {r.doc_id: r.class_id for r in near_dedup.classes(make_docs(texts)).collect()} == want


def test_repeat_counts_weigh(make_docs):
    rng, texts = random.Random(4), []
    for times in (2, 3, 4, 50, 1000):
        menu, rest = rng.sample(VOCAB, 20), rng.sample(VOCAB, 80)
        texts += [" ".join(menu * n + rest) for n in (2, times)]
    for n in (40, 41, 44):      # menus that repeat nearly alike
        texts.append(" ".join(VOCAB[:20] * n + VOCAB[100:180]))
    want = brute.near_classes(list(enumerate(texts)))
    assert 5 < len(set(want.values())) < len(texts)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(make_docs(texts)).collect()} == want


def test_probability_jaccard_of_counts():
    import numpy as np
    rng = random.Random(6)
    for _ in range(200):
        x = Counter({i: rng.randrange(1, 9) for i in rng.sample(range(40), rng.randrange(1, 30))})
        y = Counter({i: rng.choice([x[i] or 1, rng.randrange(1, 9)]) for i in rng.sample(range(40), rng.randrange(1, 30))})
        a, b = (np.array(sorted(c), np.uint32) for c in (x, y))
        got = near_dedup.probability_jaccard(a, np.array([x[i] for i in sorted(x)]), b, np.array([y[i] for i in sorted(y)]))
        assert abs(got - brute.probability_jaccard(x, y)) < 1e-12
        s, t = sum(x[i] for i in x if i in y) / sum(x.values()), sum(y[i] for i in y if i in x) / sum(y.values())
        assert not s or got <= 1 / (1 / s + 1 / t - 1) + 1e-12      # the bound that prefixes rely on


def test_prefix_pairs_hold_every_near_pair(spark):
    """Sets whose differences are partly common: no pair at the threshold may be lost, wherever the frequencies put it."""
    import numpy as np
    rng, rows, sets = random.Random(9), [], {}
    base = rng.sample(range(10**6), 60)
    for i in range(150):
        x = Counter({w: 1 for w in base if rng.random() < 0.95} | {rng.randrange(2 * 10**6): 1 for _ in range(rng.randrange(6))})
        for w in rng.sample(sorted(x), 3):
            x[w] = rng.randrange(1, 4)
        sets[i] = x
        names = sorted(x)
        rows.append((i, i, np.array(names, np.uint32).tobytes(), np.array([x[w] for w in names], np.uint32).tobytes()))
    frame = spark.createDataFrame(rows, "num long, comp long, names binary, counts binary")
    got = {tuple(r) for r in near_dedup._prefix_pairs(frame.select("num", "comp"), frame.drop("comp"), 0.8).distinct().collect()}
    want = {(i, j) for j in sets for i in range(j) if brute.probability_jaccard(sets[i], sets[j]) >= 0.8}
    assert want <= got and 50 < len(want) < len(got) < 150 * 149 // 2


def test_keep_one_keeps_columns_and_one_row_each(make_docs, clashing, corpus):
    docs = clashing(make_docs(corpus))
    kept = near_dedup.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute.near_classes(list(corpus.items())).values()))


def test_signature_agreement_estimates_probability_jaccard():
    import numpy as np
    rng = np.random.default_rng(1)
    names = rng.integers(1, 2**63, 300).astype(np.uint64)
    weight = rng.integers(1, 5, 300).astype(float)
    a, b = slice(0, 240), slice(60, 300)
    doc = np.repeat([0, 1], 240)
    sig = near_dedup.signatures(doc, np.concatenate((names[a], names[b])), np.concatenate((weight[a], weight[b])), 2, 4096)
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = weight[a], weight[b]
    both = (x > 0) & (y > 0)
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    import numpy as np
    names = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = near_dedup.signatures(np.zeros(49, np.int64), names, np.ones(49), 1, 64)
    two = near_dedup.signatures(np.repeat([0, 1], 49), np.tile(names, 2), np.ones(98), 2, 64)
    assert (two == one).all()
