"""Operators 1, 2 and 6 and the pipeline, with edge rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import language_id, mixing, queries, reply_trees
from tests.oracle_check import check, duck

from . import brute

SF = "/root/testdata/sf0.001"
SYLLABLES = {"en": ["the", "ing", "tion", "and", "er", "th", "ou"], "de": ["sch", "ung", "ich", "keit", "ä", "ver", "pf"],
             "fr": ["eau", "ment", "tre", "é", "ê", "oi", "que"], "es": ["ción", "ñ", "ado", "rr", "os", "ll", "mente"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


# -- 1 --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def spoken(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        declared = lang if rng.random() < 0.9 else rng.choice([*SYLLABLES, None, "xx"])
        rows.append((i, speak(rng, lang, rng.choice([3, 30, 200])), declared, f"{lang}.example", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")


def test_wrong_declarations_do_not_win(spoken, clashing):
    got = language_id.identify(language_id.from_documents(clashing(spoken))).select(
        "row.truth", "language", "kept", "posterior", "declared").collect()
    assert len(got) == 400
    assert sum(r.language == r.truth for r in got) >= 396
    assert all(0 <= r.posterior <= 1 + 1e-9 for r in got)
    wrong = [r for r in got if r.declared != r.truth]
    assert len(wrong) > 15 and sum(r.language == r.truth for r in wrong) >= len(wrong) - 2


def test_host_prior_is_smoothed_towards_its_domain(spark):
    rng = random.Random(3)
    rows = [(i, speak(rng, "de", 50), "de", f"h{i % 3}.de.example") for i in range(60)]
    rows += [(100 + i, speak(rng, "en", 50), "en", "en.other") for i in range(60)]
    rows += [(500, "th", None, "new.de.example"), (501, "th", None, "en.other"), (502, "", None, "en.other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify(language_id.from_documents(docs))
           .select("row.doc_id", "language", "posterior", "kept").collect()}
    assert got[501].language == "en" and got[501].posterior > got[500].posterior
    assert got[502].language == "und" and not got[502].kept


def test_rejects_and_edges(make_docs):
    rng = random.Random(1)
    junk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    texts = {i: speak(rng, "en", 60) for i in range(40)} | {50: None, 51: "", 52: "12 345 !!", 53: junk}
    docs = make_docs(texts).withColumn("lang", F.when(F.col("doc_id") != 53, F.col("lang")))
    got = {r.doc_id: r.kept for r in language_id.identify(language_id.from_documents(docs)).select("row.doc_id", "kept").collect()}
    assert got == {d: d < 50 for d in texts}
    kept = language_id.keep_known(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == 40
    assert language_id.keep_known(make_docs([])).count() == 0


def test_pages(spark):
    rng = random.Random(4)
    rows = [(i, f"https://a.example.{x}/{x}/p?q=1", f"<!DOCTYPE html><html lang=\"{x}\"><script>the the</script><p>{speak(rng, x, 40)}</p></html>")
            for i, x in enumerate(list(SYLLABLES) * 20)] + [(900, None, None), (901, "not a url", "<html><p></p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = {r.row.page_id: r for r in language_id.from_pages(pages).collect()}
    assert seen[1].declared == "de" and seen[1].suffix == "/de" and seen[1].host == "a.example.de" and b"the the" not in seen[1].body
    got = {r.page_id: r.language for r in language_id.identify(language_id.from_pages(pages)).select("row.page_id", "language").collect()}
    assert got == {i: x for i, x in enumerate(list(SYLLABLES) * 20)} | {900: "und", 901: "und"}


# -- 2 --------------------------------------------------------------------------

def test_escape_round_trip():
    rng = random.Random(7)
    parts = ["<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", reply_trees.ESCAPE,
             "<", "[", "|", ">", "a", "\n", "<s>", "<|", "|>"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "", "<|im_sep|>"]), "".join(rng.choices(parts, k=rng.randrange(12))))
                 for _ in range(rng.randrange(5))]
        text, loss = reply_trees.format_messages(turns)
        assert reply_trees.read_messages(text) == turns
        assert [reply_trees.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
        for _, said in turns:
            assert not any(c in reply_trees.escape(said) for c in parts[:8])


def test_conversations(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None]), rng.choice([None, "", "é </s>", "hi\nthere", "␛"]), "x")
            for c in range(30) for t in range(rng.choice([1, 2, 7, 40]))]
    rows += [(100, 1, "user", "b", "x"), (100, 1, "user", "a", "x"), (100, 1, "user", "a", "x"), (None, 0, "user", "n", "x"),
             (101, None, "assistant", "first", "x"), (101, 0, "user", "second", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    want = defaultdict(list)
    for c, t, r, x, _ in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]", ""), (-7, 1, "assistant", "</s>[INST] ok [/INST]", "")]:
        want[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    got = queries.QUERIES["op2_reply_trees"](spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    for r in got:
        turns = [(x[3], x[5]) for x in sorted(want[r.conv_id])]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), brute.sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learnt), brute.sha(learnt))
        assert r.formatted_chars == len(reply_trees.format_messages(turns)[0])


def test_branching_trees_against_recursion(spark):
    rng = random.Random(5)
    rows = []
    for tree in range(12):
        for i in range(rng.choice([1, 2, 30, 60])):
            parent = rng.randrange(i) if i and rng.random() < 0.95 else rng.choice([None, 999])
            rows.append((tree, i, parent, "user", f"m{i}", rng.choice([None, 0.0, 1.0, 2.5])))
    rows += [(50, 1, 2, "user", "c1", 1.0), (50, 2, 1, "user", "c2", 1.0), (50, 3, 1, "user", "behind", 1.0)]  # a cycle
    kind = "tree long, id long, parent long, role string, text string, score double"
    got = reply_trees.chosen_paths(spark.createDataFrame(rows, kind)).collect()
    by = {(t, i): (p, s or 0.0) for t, i, p, _, _, s in rows if t < 50}
    children = Counter((t, p) for (t, i), (p, _) in by.items())
    want = {}
    for t, i in by:
        if not children[(t, i)]:
            path, at = [], i
            while at is not None and (t, at) in by:
                path.append(at)
                at = by[(t, at)][0]
            want[(t, i)] = ([f"m{x}" for x in reversed(path)], sum(by[(t, x)][1] for x in path) / len(path))
    assert {(r.tree, r.leaf): [m.text for m in r.messages] for r in got} == {k: v[0] for k, v in want.items()}
    for t in range(12):
        ranked = [r.leaf for r in sorted((r for r in got if r.tree == t), key=lambda r: r["rank"])]
        assert ranked == [i for _, i in sorted((-round(v[1], 9), k[1]) for k, v in want.items() if k[0] == t)]
    top = reply_trees.chosen_paths(spark.createDataFrame(rows, kind), branches=1).collect()
    assert len(top) == len({t for t, _ in want}) and all(r["rank"] == 1 for r in top)


def test_no_messages(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert reply_trees.format_paths(reply_trees.chosen_paths(reply_trees.linear_messages(none))).count() == 0


# -- 6 --------------------------------------------------------------------------

@pytest.mark.parametrize("spread", [1, 40])
def test_mixing(spark, clashing, spread):
    rng = random.Random(spread)
    rows = [(i, "w " * rng.choice([0, 1, 5, 80, 700]), rng.choice(["a", "b", "a", "a", "Z", "é", "𝒜", "ｚ", None]) if spread > 1 else "only")
            for i in range(300)] + [(None, "x y z", "a"), (7, None, "a"), (8, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(clashing(docs), shard_tokens=3000).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
        assert 0 <= r.taken <= 2 * r.size
    want = brute.mixing_targets({s: sum(len(brute.space_words(t)) for _, t, x in rows if x == s) for s in {x for _, _, x in rows}})
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[r.source]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t + 10
    again = mixing.mix(clashing(docs).repartition(7), shard_tokens=3000).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(2)
    for _ in range(4):
        votes = {f"s{i}": rng.choice([0.0, 1.0, 1.0, 7.5, rng.random() * 300]) for i in range(25)}
        seats = int(sum(votes.values()) + 0.5)
        parties = spark.createDataFrame([(s, 0, v) for s, v in votes.items()], "source string, shard long, votes double")
        got = {r.source: r.quota for r in mixing.apportion(parties).collect()}
        want = brute.sainte_lague(votes, seats)
        assert sum(got.values()) == seats
        # ties may fall either way: every seat held has at least the quotient of every seat not held
        held = min(votes[s] / (2 * q - 1) for s, q in got.items() if q)
        assert held >= max(votes[s] / (2 * q + 1) for s, q in got.items()) - 1e-12
        assert sorted(got.values())[-3:] == sorted(want.values())[-3:]


def test_seats_above_a_cap_go_to_the_next_quotients(spark):
    rng = random.Random(5)
    for case in range(4):
        votes = {f"s{i}": rng.choice([0.0, 1.9, 7.9, rng.random() * 300]) for i in range(25)}
        cap = {s: int(v) + rng.choice([0, 0, 1, 40] if case < 3 else [0]) for s, v in votes.items()}
        parties = spark.createDataFrame([(s, 0, v, cap[s]) for s, v in votes.items()],
                                        "source string, shard long, votes double, cap long")
        got = {r.source: r.quota for r in mixing.apportion(parties).collect()}
        # the definition, seat by seat
        want = Counter()
        for _ in range(min(int(sum(votes.values()) + 0.5), sum(c for s, c in cap.items() if votes[s]))):
            want[max((s for s in votes if want[s] < cap[s] and votes[s]), key=lambda s: votes[s] / (2 * want[s] + 1))] += 1
        assert sum(got.values()) == sum(want.values()) and all(got[s] <= cap[s] for s in got)
        held = min(votes[s] / (2 * q - 1) for s, q in got.items() if q)
        assert held >= max([votes[s] / (2 * q + 1) for s, q in got.items() if q < cap[s]], default=0) - 1e-12


def test_mixing_of_nothing(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix(make_docs(["", None])).collect()] == [0, 0]


# -- pipeline, registry -----------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    base = speak(rng, "en", 150)
    leak = speak(rng, "en", 14)
    texts = {i: speak(rng, "en", 120) for i in range(40)}
    texts |= {50: base, 51: base, 52: base + " more", 60: speak(rng, "en", 40) + " " + leak, 61: "!!! 12",
              62: speak(rng, "en", 60) + ' password = "hunter22" ' + speak(rng, "en", 60)}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.columns == docs.columns
        ids.append({r.doc_id for r in at.collect()})
    clean = set(range(40))
    assert ids[0] == set(texts) - {61}
    assert ids[1] == clean | {50, 60, 62}
    assert ids[2] == ids[3] == clean | {50, 62}
    changed = {r.doc_id: r.text for r in at.collect() if r.text != texts[r.doc_id]}
    assert changed == {62: texts[62].replace('password = "hunter22', "[SECRET]")}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids[3]
    sizes = Counter()
    for r in out:
        sizes[r.source] += r.size
    want = brute.mixing_targets(dict(sizes))
    for s, t in want.items():
        assert abs(sum(r.taken for r in out if r.source == s) - t) <= 0.01 * t + 10


def test_pipeline_edge_rows(spark, tmp_path):
    """Null in every column, empty, very long, repeated and tied rows, and columns named like the operators' own."""
    rng = random.Random(12)
    kind = ("doc_id long, text string, lang string, source string, n_chars long, row string, body string, spans string, "
            "words long, class_id string, size long, shard string")
    extra = ("r", "b", "s", 3, "c", 4, None)
    long = speak(rng, "en", 40_000)
    again = speak(rng, "en", 80)
    rows = [(i, speak(rng, "en", 90), "en", f"s{i % 2}", 5) for i in range(12)]
    rows += [(None, None, None, None, None), (100, None, "en", "s0", None), (101, "", "en", None, 0), (102, " \n\t ", None, "s1", 4),
             (103, long, "en", "s0", len(long)), (104, again, "en", "s0", 1), (104, again, "en", "s0", 1), (105, again, "en", "s1", 1),
             (None, speak(rng, "en", 90), "en", "s1", 7), (106, speak(rng, "en", 90), None, None, None)]
    spark.createDataFrame([r + extra for r in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "...")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, at, str(tmp_path))
        assert done.dtypes == at.dtypes
        done.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        out = at.collect()
        assert all(tuple(r)[5:] == extra for r in out)
        kept.append(out)
    for out in kept:
        texts = Counter(r.text for r in out)
        assert {r[1] for r in rows[:12]} <= set(texts) and texts[long] == 1 and texts[again] >= 1
        assert texts[rows[-2][1]] == texts[rows[-1][1]] == 1
    assert Counter(r.text for r in kept[0])[again] == 3 and Counter(r.text for r in kept[1])[again] == 1
    assert len(kept[1]) == len(kept[2]) == len(kept[3])
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in mixed) == sorted(str(r.doc_id) for r in kept[3])


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and out.count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    r = check(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert r["status"] == "ok", r
