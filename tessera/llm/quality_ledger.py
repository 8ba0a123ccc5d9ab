r"""Operator 4: quality rules as a bitmask ledger. DataFrame functions only.

Words are `[^\x20\x09-\x0D]+`. `ledger` measures every document once and
evaluates every rule once: bit b of `failed` is rule b's failure. A policy is
a version with a set of rules, so `apply_policy` is one bitwise AND over the
ledger and no text is read again; `ablate` says for several policies what each
rule decides alone, from one aggregate by bitmask (at most 2^rules rows
whatever the corpus, in practice a few dozen).

Repeated 3-word windows are found within the row: each window's 64-bit hash
gives the upper 40 bits, its position the lower 24 bits of a number; in the
sorted numbers equal windows are neighbours. Neighbours' words are compared;
if a pair only shares its hash bits, or a text has 2^24 words, that row sorts
the windows themselves. So the count is exact.

Defined cases: null and empty texts have no words and fail `short`; repeated
rows each get their row; extra columns pass through in the struct `row`, so
names can't clash. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

_SPACE = " \t\n\x0b\x0c\r"
_POSITION_BITS = 24
_LOW = (1 << _POSITION_BITS) - 1


def _rules(m: dict[str, Column]) -> list[tuple[str, Column]]:
    """Rule names and failure conditions, in bit order. New rules go to the end."""
    n = m["n_words"]
    return [
        ("short", n < 50),
        ("repeats", 100 * m["n_repeat_words"] > 50 * n),
        ("symbols", 10 * m["n_symbols"] > n),
        ("shouting", 2 * m["n_upper"] > m["n_letters"]),
        ("few_letters", 10 * m["n_letters"] < 6 * m["word_chars"]),
        ("word_length", (m["word_chars"] < 2 * n) | (m["word_chars"] > 20 * n)),
        ("same_lines", 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
        ("exclaims", 4 * m["n_exclaim"] > n),
        ("dots", 10 * m["n_dots"] > 3 * m["n_lines"] + 10),
        ("very_long", n > 1_000_000),
    ]


#: policy version -> rules it enforces
POLICIES = {
    "v1": ("short", "repeats"),
    "v2": ("short", "repeats", "symbols", "shouting", "few_letters", "word_length", "same_lines", "exclaims"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_upper", "n_letters", "n_exclaim", "n_dots")
RULES = ("short", "repeats", "symbols", "shouting", "few_letters", "word_length", "same_lines", "exclaims", "dots",
         "very_long")


def mask(rules: Iterable[str]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """row (struct of the input), the measurements, failed (long bitmask)."""
    body = F.col("body")

    def count(chars: str) -> Column:
        return (F.length(body) - F.length(F.translate(body, chars, ""))).cast("long")
    split = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")).select(
        "row", "body",
        F.array_remove(F.split(body, "[ \\t-\\r]+", -1), "").alias("words"),
        F.filter(F.split(body, "\n", -1), lambda s: s.rlike("[^ \\t-\\r]")).alias("lines"))
    measured = split.select(
        "row", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(body, _SPACE, "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated("words").alias("n_repeat_words"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(body, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        count("!").alias("n_exclaim"),
        F.regexp_count(body, F.lit(r"\.\.\.|…")).cast("long").alias("n_dots"))
    bits = [F.when(failure, F.lit(1 << b)).otherwise(F.lit(0)).cast("long")
            for b, (_, failure) in enumerate(_rules({m: F.col(m) for m in MEASURES}))]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.select("row", *MEASURES, failed.alias("failed"))


def apply_policy(book: DataFrame, version: str) -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablate(book: DataFrame, versions: Iterable[str] | None = None) -> DataFrame:
    """version, rule, n_failed, n_alone (documents that the rule alone rejects), n_dropped, n_docs."""
    counts = book.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit"),
                      F.lit(mask(POLICIES[v])).cast("long").alias("mask"))
             for v in (versions or POLICIES) for r in POLICIES[v]]
    case = counts.select("failed", "n", F.explode(F.array(*cases)).alias("c")).select("failed", "n", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))
    return case.groupBy("version", "rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_alone"), total(hit != 0).alias("n_dropped"), F.sum("n").alias("n_docs"))


# -- repeated windows -----------------------------------------------------------

def _bound(value: Column, use) -> Column:
    """use(value), with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: str) -> Column:
    """Words in 3-word windows that the text holds twice or more."""
    n = F.size(words)
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), _POSITION_BITS)
        .bitwiseOR(i.cast("long")))
    exact = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("at")))

    def neighbours(s: Column) -> Column:
        """at: window, twin: equal to the next in sorted order, false: equal in its hash bits alone."""
        def compare(x, y):
            a, b = (v.bitwiseAND(F.lit(_LOW).cast("long")).cast("int") for v in (x, y))
            same_bits = F.shiftrightunsigned(x, _POSITION_BITS) == F.shiftrightunsigned(y, _POSITION_BITS)
            same = ((F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1))
                    & (F.get(words, a + 2) == F.get(words, b + 2)))
            return F.when(same_bits, F.struct(a.alias("at"), b.alias("next"), same.alias("same")))
        return F.filter(F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), compare),
                        lambda x: x.isNotNull())

    def slow(s: Column) -> Column:
        def compare(x, y):
            same = (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
            return F.when(same, F.struct(x["at"].alias("at"), y["at"].alias("next"), same.alias("same")))
        return F.filter(F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), compare),
                        lambda x: x.isNotNull())

    def covered(pairs: Column) -> Column:
        at = F.array_sort(F.array_union(F.transform(pairs, lambda p: p["at"]), F.transform(pairs, lambda p: p["next"])))
        return F.aggregate(
            at, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda s, p: F.struct((p + 3).alias("end"),
                                  (s["n"] + (p + 3) - F.greatest(p, s["end"])).cast("long").alias("n")),
            lambda s: s["n"])
    slow_count = _bound(F.array_sort(exact), lambda s: covered(slow(s)))
    fast = _bound(F.sort_array(packed), lambda s: _bound(neighbours(s), lambda p: F.when(
        F.exists(p, lambda x: ~x["same"]), slow_count).when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(covered(p))))
    return F.when(n < 4, F.lit(0).cast("long")).when(n > _LOW, slow_count).otherwise(fast)
