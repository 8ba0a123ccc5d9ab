r"""Operator 10: secret scan with a randomness test battery. DataFrame functions only.

Known kinds (leftmost, non-overlapping per kind; failing matches are dropped):
`assign` (a credential word, `:` or `=`, a value of 6+ characters), `access`
(AKIA keys of 20+), `hex` (24+ lower-case hex digits).

Kind `random`: every maximal run of 16+ characters of base64 that has a letter
and a digit is a candidate. Its encoding is inferred (hex, base32, base36,
base64). Two questions decide:

* Could it be uniform over that alphabet? Chi-squared of the symbol counts
  (upper tail), runs above and below the middle of the alphabet, and lag-1
  serial correlation (two-sided); thrice the least p must be `alpha` or more,
  so a random key is lost here with that chance at most.
* Could it be an identifier? The null model writes identifiers: letters, case,
  digits and separators follow one another as in names, letters as often as in
  words (`KINDS_AFTER`, `VOWELS_AFTER`, `LETTERS`). The ratio of the model's
  likelihood to the uniform one exceeds no level 1/x with a chance above x
  (Markov), so it is a p value that holds at every length. Within each class of
  encoding and length, the Benjamini-Hochberg rule at `fdr` rejects that null,
  and only rejected candidates are reported: `fdr` bounds the expected share of
  identifiers among what a class reports, and a longer string isn't judged by
  the many short ones.

A candidate must also be able to hold `least_bits` bits. The rule needs only
counts per class and p bin (bins of 1/20 decade, at most 128 classes), so what
reaches the driver has a fixed bound whatever the corpus.

Positions are code points, end exclusive; they come from the lengths between
matches, within the row, so no document is shuffled.

Defined cases: null text is empty; empty tables give none; repeated rows each
get their result; extra columns pass through `redact` and never clash, as the
scan's own columns are nested in one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "random")
# fixed values: patterns of the known kinds
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}")

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "base32": _UPPER + "234567",
    "base36": _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/",
}
BINS_PER_DECADE, MAX_BIN = 20, 240

# model of identifiers: chance of the next kind (lower, upper, digit, separator), by the kind before it
KINDS_AFTER = {
    "": (0.60, 0.25, 0.10, 0.05), "lower": (0.86, 0.06, 0.04, 0.04), "upper": (0.50, 0.44, 0.03, 0.03),
    "digit": (0.12, 0.10, 0.65, 0.13), "separator": (0.60, 0.20, 0.17, 0.03),
}
# chance that a letter is a vowel, after no letter, a vowel, a consonant
VOWELS_AFTER = (0.30, 0.15, 0.55)
# fixed values: letters per hundred letters of English text
LETTERS = dict(zip(_LOWER, (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0,
                            6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)))


def scan(docs: DataFrame, fdr: float = 0.05, alpha: float = 0.01, least_bits: float = 80.0) -> DataFrame:
    """row (struct of the input), spans: array of (start, rank, end, kind), sorted by start, then kind."""
    limits = rejection_limits(docs, fdr)
    tested = _located(docs).select("row", "known", F.transform("runs", lambda r: F.struct(
        r.alias("span"), _battery(F.substring("body", r["start"] + 1, r["end"] - r["start"])).alias("test"))).alias("runs"))
    added = F.transform(
        F.filter("runs", lambda r: _reported(r["test"], limits, alpha, least_bits)
                 & ~F.exists("known", lambda k: (k["start"] <= r["span"]["start"]) & (k["end"] >= r["span"]["end"]))),
        lambda r: r["span"])
    return tested.select("row", F.array_sort(F.concat("known", added)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each (merged) span of its text replaced by `mark`; `n_chars`, if there, is counted anew."""
    found = scan(docs).select("row", F.col("row.text").alias("body"), _merged("spans").alias("spans"))
    # the text between spans, then what follows the last
    begin = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    end = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("body")))
    pieces = F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")),
                         lambda p: F.substring("body", p["a"] + 1, p["b"] - p["a"]))
    clean = found.select("row", F.when(F.size("spans") > 0, F.array_join(pieces, mark)).otherwise(F.col("body")).alias("body"),
                         (F.size("spans") > 0).alias("changed"))
    put = {"text": F.col("body")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("changed"), F.length("body").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return clean.select(*(put.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


# -- matches and their positions ----------------------------------------------

def _located(docs: DataFrame) -> DataFrame:
    """row, body, known spans and candidate runs."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    got, place = rows, {}
    for rank, (kind, pattern, value, least) in enumerate((
            ("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("random", CANDIDATE, 0, 16))):
        has = F.col("body").rlike(pattern)
        got = got.withColumn(kind, F.when(has, F.arrays_zip(
            F.transform(F.split("body", pattern, -1), F.length).alias("gap"),
            F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)), F.length).alias("size"),
            F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(value)), lambda v: F.length(v) >= least).alias("ok"))))
        place[kind] = _placed(kind, rank)
    return got.select("row", "body", F.concat(*(place[k] for k in KINDS[:3])).alias("known"), place["random"].alias("runs"))


def _placed(kind: str, rank: int) -> Column:
    """Spans of a kind from the gaps before its matches and their sizes; the last gap has no match."""
    empty = F.array().cast(_SPANS)
    step = F.aggregate(
        kind, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["ok"], F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"),
                (a["at"] + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind"))))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"])
    return F.coalesce(step, empty)


def _merged(spans: str) -> Column:
    """Overlapping spans as one; spans are sorted by start."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    span = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))

    def add(out, s):
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1),
                          F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] >= s["start"]), joined).otherwise(
            F.concat(out, F.array(span(s))))
    return F.aggregate(spans, empty, add)


# -- the battery ----------------------------------------------------------------

def _tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a rational approximation of erfc (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z > 0, upper).otherwise(1 - upper)


def _battery(token: Column) -> Column:
    """Struct: encoding, length class, p of uniformity, bin of the identifier p, bits."""
    encoding = (F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+$"), "base32")
                .when(token.rlike("^[a-z0-9]+$"), "base36").otherwise("base64"))
    plain = F.when(encoding == "hex", F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    alphabet = F.element_at(F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv)), encoding)
    given = F.struct(plain.alias("t"), encoding.alias("encoding"), alphabet.alias("alphabet"),
                     F.filter(F.split(plain, ""), lambda c: c != "").alias("chars"))
    # one-element arrays bind the derived values, so that each is computed once for a token
    return F.element_at(F.transform(F.array(given), _tested), 1)


def _tested(g: Column) -> Column:
    k = F.length(g["alphabet"]).cast("double")
    n = F.size(g["chars"]).cast("double")
    squares = F.aggregate(F.array_distinct(g["chars"]), F.lit(0.0),
                          lambda s, c: s + F.pow(n - F.length(F.replace(g["t"], c, F.lit(""))), F.lit(2.0)))
    chi = k / n * squares - n
    p_chi = _tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)))
    code = F.transform(g["chars"], lambda c: F.position(c, g["alphabet"]).cast("double") - 1)

    def stepwise(x: Column) -> Column:
        after = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
                           lambda a, b: F.struct(((a >= k / 2) != (b >= k / 2)).cast("int").alias("turn"),
                                                 ((a - (k - 1) / 2) * (b - (k - 1) / 2)).alias("product")))
        return F.aggregate(after, F.struct(F.lit(0).alias("turn"), F.lit(0.0).alias("product")),
                           lambda s, y: F.struct((s["turn"] + y["turn"]).alias("turn"),
                                                 (s["product"] + y["product"]).alias("product")))
    both = F.element_at(F.transform(F.array(code), stepwise), 1)

    def closed(s: Column) -> Column:
        z_runs = (s["turn"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_serial = s["product"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
        p = 3 * F.least(p_chi, 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))
        return F.struct(
            g["encoding"].alias("encoding"), F.least(F.floor(2 * F.log2(n)).cast("int"), F.lit(31)).alias("length"),
            p.alias("uniform"),
            F.least(F.floor(F.greatest(-n * F.log10(k) - _as_identifier(g["chars"]), F.lit(0.0)) * BINS_PER_DECADE).cast("int"),
                    F.lit(MAX_BIN)).alias("bin"), (n * F.log2(k)).alias("bits"))
    return F.element_at(F.transform(F.array(both), closed), 1)


def _as_identifier(chars: Column) -> Column:
    """log10 of the chance that the model of identifiers writes these characters.

    A character's state is its kind and whether it is a vowel; both steps are read
    from tables of (state before, character).
    """
    symbols = _LOWER + _UPPER + _DIGITS + "+/"
    kind = [next(i for i, group in enumerate((_LOWER, _UPPER, _DIGITS, "+/")) if c in group) for c in symbols]
    vowel = [c.lower() in "aeiou" for c in symbols]
    # states: start, lower consonant, lower vowel, upper consonant, upper vowel, digit, separator
    state = [1 + 2 * k + v if k < 2 else 3 + k for k, v in zip(kind, vowel)]
    before = [("", 0), ("lower", 2), ("lower", 1), ("upper", 2), ("upper", 1), ("digit", 0), ("separator", 0)]
    weight = {v: sum(w for c, w in LETTERS.items() if (c in "aeiou") == v) for v in (False, True)}

    def chance(last: tuple[str, int], c: str, k: int, v: bool) -> float:
        p = KINDS_AFTER[last[0]][k]
        if k >= 2:
            return p / (10 if k == 2 else 2)
        vowels = VOWELS_AFTER[last[1]]
        return p * (vowels if v else 1 - vowels) * LETTERS[c.lower()] / weight[v]
    table = F.array(*(F.lit(math.log10(chance(last, c, k, v))) for last in before for c, k, v in zip(symbols, kind, vowel)))
    states = F.array(*(F.lit(x) for x in state))
    walked = F.aggregate(
        F.transform(chars, lambda c: F.position(c, F.lit(symbols))),
        F.struct(F.lit(0).alias("state"), F.lit(0.0).alias("sum")),
        lambda s, at: F.struct(F.element_at(states, at).alias("state"),
                               (s["sum"] + F.element_at(table, s["state"] * len(symbols) + at)).alias("sum")))
    return walked["sum"]


def rejection_limits(docs: DataFrame, fdr: float) -> dict[tuple[str, int], int]:
    """Per class (encoding, length): the least p bin whose candidates are rejected as identifiers."""
    text = F.col("text").cast("string")
    token = (docs.select(text.alias("body")).filter(F.col("body").rlike(CANDIDATE))
             .select(F.explode(F.regexp_extract_all("body", F.lit(CANDIDATE), F.lit(0))).alias("token")))
    counts = (token.select(_battery(F.col("token")).alias("t")).select("t.*")
              .groupBy("encoding", "length", "bin").agg(F.count("*").alias("n")).collect())
    by_class: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts:
        by_class.setdefault((r.encoding, r.length), {})[r.bin] = r.n
    out = {}
    for key, bins in by_class.items():
        total, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / BINS_PER_DECADE) <= fdr * seen / total:
                out[key] = b
    return out


def _reported(test: Column, limits: dict[tuple[str, int], int], alpha: float, least_bits: float) -> Column:
    limit = F.lit(MAX_BIN + 1)
    if limits:
        known = F.create_map(*(F.lit(x) for (e, n), b in sorted(limits.items()) for x in (f"{e}:{n}", b)))
        limit = F.coalesce(F.element_at(known, F.concat_ws(":", test["encoding"], test["length"].cast("string"))), limit)
    return (test["bin"] >= limit) & (test["uniform"] >= alpha) & (test["bits"] >= least_bits)
