"""Registered queries of the training-data operators: whole tables, production parameters.

Each query calls its operator and derives the digest columns from the
operator's own output. QUERIES and ORACLE have the same meaning as in
`tessera.plans.registry`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontam, exchange, language_id, lexical_search, license_scan, merkle, mixing, near_dedup, quality_ledger, reply_trees,
               secret_scan, substring_dedup, suffix_dedup, toxicity)

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS place FROM g),
r AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (
        SELECT doc_id, unnest(range(i, i + 20)) AS k FROM f WHERE place > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string([words[k] FOR k IN range(1, len(words) + 1) IF NOT list_contains(gone, k)], ' ')) AS kept_sha256
FROM b
"""


@query("op8_substring_dedup", OP8_SQL)
def op8(spark, sf_dir):
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_minhash_near_dedup")
def op9(spark, sf_dir):
    return (near_dedup.classes(table(spark, sf_dir, "documents"), shingle=5, threshold=0.8)
            .select("doc_id", "class_id", "class_size", "kept"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, words, least(10, len(words)) AS size FROM (SELECT item_id, {_WORDS} AS words FROM benchmark)),
phrase AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS win
           FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM b WHERE size > 0)),
sizes AS (SELECT DISTINCT size FROM phrase),
place AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
          FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size)),
hit AS (SELECT place.doc_id, place.i, place.size, phrase.item_id FROM place JOIN phrase USING (size, win)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


@query("op7_benchmark_decontamination", OP7_SQL)
def op7(spark, sf_dir):
    found = decontam.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    known = F.filter("spans", lambda s: s["kind"] != "random")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), count("random"),
                        F.sha2(listed(known), 256).alias("base_sha256"), listed("spans").alias("spans"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
             length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim
      FROM w LEFT JOIN r ON w.doc_id IS NOT DISTINCT FROM r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > n_letters OR 10 * n_letters < 6 * word_chars
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 4 * n_exclaim > n_words) AS kept
FROM b
"""


@query("op4_quality_ledger", OP4_SQL)
def op4(spark, sf_dir):
    book = quality_ledger.apply_policy(quality_ledger.ledger(table(spark, sf_dir, "documents")), "v2")
    base = F.lit(quality_ledger.mask(["short", "repeats"])).cast("long")
    return book.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"), "kept")


@query("op6_source_mixing")
def op6(spark, sf_dir):
    return (mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, ceiling=2.0)
            .select("doc_id", "size", "source_size", "target", "taken"))


@query("op2_reply_trees", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
             coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
             sum(33 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, chr(9243)))
                 + len(regexp_extract_all(role || ' ' || text,
                     '<\|[A-Za-z0-9_]+\|>|</?s>|<</?SYS>>|\[/?INST\]'))) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM t
""")
def op2(spark, sf_dir):
    added = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    read = reply_trees.read_back(reply_trees.format_paths(reply_trees.chosen_paths(reply_trees.linear_messages(rows))))
    return read.select(F.when(F.col("tree") != exchange.NULL_ID, F.col("tree")).alias("conv_id"), "n_turns",
                       "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op3_license_scan")
def op3(spark, sf_dir):
    base = F.filter("detections", lambda d: d["base"])
    start = F.transform(base, lambda d: d["start"].cast("long"))

    def labels(detections):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"), labels(base).alias("base_labels"), labels("detections").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"))


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    seen = language_id.from_documents(docs).withColumn("row", F.struct("row.doc_id"))
    return language_id.identify(seen).select("row.doc_id", "language", "posterior", "text_language", "declared", "kept")


@query("language_id_of_pages")
def pages_language(spark, sf_dir):
    seen = language_id.from_pages(table(spark, sf_dir, "pages")).withColumn("row", F.struct("row.page_id"))
    return language_id.identify(seen).select("row.page_id", "language", "posterior", "text_language", "declared", "kept")


_MERKLE_LEVELS = 6


def merkle_sql(fanout: int = 16, levels: int = _MERKLE_LEVELS) -> str:
    """The tree level by level; a group of one node is passed up as it is."""
    def field(c):
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    def climb(name, steps):
        """Levels name_0 (grp, idx, n, d) ... name_<steps>, and what each node meets on its level."""
        out = []
        for k in range(steps):
            frame = f"OVER (PARTITION BY grp, idx // {fanout} ORDER BY idx ROWS BETWEEN"
            out.append(f"""{name}_met_{k} AS (SELECT grp, idx, n > 1 AS more,
  CASE WHEN n > 1 THEN coalesce(string_agg(d, '') {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS before,
  CASE WHEN n > 1 THEN coalesce(string_agg(d, '') {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS after
  FROM {name}_{k})""")
            out.append(f"""{name}_{k + 1} AS (SELECT grp, idx // {fanout} AS idx, (max(n) + {fanout - 1}) // {fanout} AS n,
  CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE max(d) END AS d
  FROM {name}_{k} GROUP BY grp, idx // {fanout})""")
        return out

    def fold(alias, name, steps, start, grp, idx):
        """Columns of a chain of joins: proof text and folded digests along the way up."""
        joins, proof, digests = [], [], [f"{s}" for s in start]
        for k in range(steps):
            m = f"{alias}{k}"
            joins.append(f"JOIN {name}_met_{k} {m} ON {m}.grp = {grp} AND {m}.idx = {idx} // {fanout ** k}")
            proof.append(f"{m}.before || {m}.after")
            digests = [f"CASE WHEN {m}.more THEN sha256({m}.before || {d} || {m}.after) ELSE {d} END" for d in digests]
        return joins, proof, digests
    leaf = " || ".join(field(c) for c in merkle.COLUMNS)
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    seen = " || ".join([*(field(c) for c in merkle.COLUMNS[:-1]), field(lowered)])
    crc_table = ", ".join(str(_crc_entry(i)) for i in range(256))
    crc = ("xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), "
           f"lambda a, c: xor(a >> 8, [{crc_table}][1 + (xor(a, c) & 255)])))")
    joins, proof, low = fold("m", "leaf", levels, ["l.seen"], "l.grp", "l.idx")
    top_joins, top_proof, folded = fold("t", "top", levels, ["low"], "s.one", "s.idx")
    ctes = [
        f"""l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
  count(*) OVER (PARTITION BY grp) AS n FROM (
    SELECT coalesce('s' || source, 'n') AS grp, doc_id, sha256({leaf}) AS leaf,
           CASE WHEN {crc} % 5 = 0 THEN sha256({seen}) ELSE sha256({leaf}) END AS seen FROM documents))""",
        "leaf_0 AS (SELECT grp, idx, n, leaf AS d FROM l)", *climb("leaf", levels),
        f"s AS (SELECT grp, 0 AS one, d AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM leaf_{levels})",
        "top_0 AS (SELECT one AS grp, idx, n, subroot AS d FROM s)", *climb("top", levels),
        f"""under AS (SELECT l.grp, l.doc_id, l.leaf, {low[0]} AS low, {' || '.join(proof)} AS proof
  FROM l {' '.join(joins)})""",
        f"""up AS (SELECT u.doc_id, u.leaf, s.subroot, sha256(proof || {' || '.join(top_proof)}) AS proof_sha256, {folded[0]} AS folded_root
  FROM under u JOIN s ON u.grp = s.grp {' '.join(top_joins)})"""]
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, r.d AS root, proof_sha256, folded_root, folded_root = r.d AS verified FROM up, top_{levels} r"""


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


@query("op11_merkle_manifest", merkle_sql())
def op11(spark, sf_dir):
    changed = F.when(toxicity.held_out(F.col("doc_id")), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    audited = merkle.audit(table(spark, sf_dir, "documents"), F.coalesce(changed, F.col("text")))
    return audited.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
                          "folded_root", "verified")


@query("op12_toxicity")
def op12(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS words FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
q AS (SELECT item, term, count(*) AS q FROM (SELECT item, unnest(words) AS term FROM i) GROUP BY item, term),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row, term),
st AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st),
m AS (SELECT row, doc_id, 75 + (25 * len(words) * n_docs) // n_terms AS m FROM d, st WHERE len(words) > 0),
s AS (SELECT item, row, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item, row),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score
      FROM s JOIN i USING (item) JOIN m USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
