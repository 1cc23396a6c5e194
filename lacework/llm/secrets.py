"""Secret scans: fixed shapes, and a battery of randomness tests for the rest.

Candidates are long runs of characters that keys are written in. For each, the encoding is inferred from
its characters, and three statistics are taken over that encoding's alphabet:

* chi-squared against the uniform distribution, as its excess for each character;
* runs of the classes of the alphabet (upper case, lower case, digits, marks; or its halves), as the share of neighbours
  that differ; and
* serial correlation of neighbouring symbols.

The null hypothesis is an *ordinary* string: joined words with a few digits, numbers, dates. What the statistics of such
strings are was measured by simulation for each encoding and length (NULL); their spread shrinks with the root of the
length, so a random key of 20 characters is weak evidence and one of 60 strong. Each statistic gives a p-value, how seldom
an ordinary string looks as random; the three are combined by a weighted sum of their normal scores, whose spread takes
their correlation in.

What is found is chosen by the Benjamini-Hochberg procedure once over the candidates of the whole table, with p-values
weighted by length, so that the expected share of ordinary strings among all that is reported stays below `fdr`. It needs
counts by score and length only, a histogram of fixed size.

All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacework.llm.common import materialize, text_or_empty

#: Fixed patterns of the base kinds, with the group that has a least length, and that length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Encodings from the narrowest: name, pattern of a whole candidate, alphabet, class of each symbol.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789", "0" * 5 + "1" * 5),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", "0" * 10 + "1" * 6),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0" * 16 + "1" * 16),
    ("base64", r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0" * 26 + "1" * 26 + "2" * 10 + "3" * 2),
)
#: Of ordinary strings, for each encoding: mean and spread (for one character) of the excess of chi-squared for each character, of
#: the share of neighbours in different classes, and of the size of the serial correlation. Simulated; the tests do it again.
NULL = {
    "decimal": (1.38, 4.6, 0.345, 0.6, 0.15, 0.6),
    "hex": (1.2, 5.5, 0.22, 0.45, 0.3, 0.7),
    "base32": (1.65, 3.3, 0.425, 0.57, 0.15, 0.6),
    "base64": (2.2, 5.2, 0.43, 0.5, 0.2, 0.6),
}
#: Weight of the serial correlation, which tells least, beside the two others; spread of the weighted sum under the null.
SERIAL_WEIGHT, SUM_SPREAD = 0.3, 1.65
FDR = 0.01
#: Scores are counted in steps of this size up to the last one; lengths up to the last one.
STEP, LAST_STEP, LAST_LENGTH = 0.02, 400, 128


def spans_of(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, kind, value>> of the leftmost non-overlapping matches whose group is long
    enough. Offsets are code points: what lies between the matches comes from splitting at them."""
    found, groups, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    span = "struct<start:int,end:int,kind:string,value:string>"
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(f"array<{span}>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + F.length(F.get(between, s["k"]))
        one = F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("value"))
        fits = F.length(F.get(groups, s["k"])) >= least
        return F.struct((start + F.length(m)).alias("at"), (s["k"] + 1).alias("k"), F.when(fits, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(found, state, step, lambda s: s["out"])).otherwise(F.array().cast(f"array<{span}>"))


def _by_encoding(value: Column, pick) -> Column:
    """pick(name, alphabet, classes) of the narrowest encoding that the value can be in."""
    (name, pattern, *rest), *others = ENCODINGS
    return reduce(lambda w, e: w.when(value.rlike(e[1]), pick(e[0], *e[2:])), others, F.when(value.rlike(pattern), pick(name, *rest)))


def _canonical(value: Column) -> Column:
    """The value in its encoding's own alphabet."""
    return _by_encoding(value, lambda name, *_: {"hex": F.lower(value), "base64": F.translate(value, "-_", "+/")}.get(name, value))


def score(value: Column) -> Column:
    """The normal score of the combined evidence that a candidate is random: large where few ordinary strings look so."""
    s = _canonical(value)
    alphabet = _by_encoding(value, lambda name, alphabet, classes: F.lit(alphabet))
    classes = _by_encoding(value, lambda name, alphabet, classes: F.translate(s, alphabet, classes))
    n, k = F.length(value).cast("double"), F.length(alphabet).cast("double")
    chars = F.split(s, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
    excess = (squares * k / n - n - (k - 1)) / n
    changes = (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / (n - 1)
    values = F.transform(chars, lambda c: F.position(c, alphabet).cast("double"))
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("x", "xx", "xy", "before")))
    add = lambda a, v: F.struct((a["x"] + v).alias("x"), (a["xx"] + v * v).alias("xx"), (a["xy"] + v * a["before"]).alias("xy"), v.alias("before"))
    # One symbol over and over has no variance; it counts as fully correlated.
    serial = F.aggregate(values, zero, add, lambda a: F.when(a["xx"] * n - a["x"] * a["x"] > 1e-9, F.abs((a["xy"] * n - a["x"] * a["x"]) / (a["xx"] * n - a["x"] * a["x"]))).otherwise(F.lit(1.0)))

    def combined(name: str, *_) -> Column:
        m1, s1, m2, s2, m3, s3 = NULL[name]
        return ((m1 - excess) / s1 + (changes - m2) / s2 + SERIAL_WEIGHT * (m3 - serial) / s3) * F.sqrt(n) / SUM_SPREAD

    return _by_encoding(value, combined)


def _tested(text: Column, base: Column) -> Column:
    """The candidates that overlap no base span: spans of kind "random" with their length (up to LAST_LENGTH) and the step of
    their score."""
    clear = F.filter(spans_of(text, CANDIDATE, "random"), lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    step = lambda v: F.greatest(F.lit(0), F.least(F.lit(LAST_STEP), F.floor(score(v) / STEP))).cast("int")
    return F.transform(clear, lambda x: F.struct(x.alias("span"), F.least(F.length(x["value"]), F.lit(LAST_LENGTH)).alias("length"), step(x["value"]).alias("step")))


def cuts(counts: list[tuple[int, int, int]], fdr: float) -> list[int]:
    """From (length, step of the score, candidates): the least step that is found, for each length up to LAST_LENGTH. A
    candidate's p-value is divided by the square of its length over the mean of these squares, as long keys can be told
    and short ones hardly; of those values the Benjamini-Hochberg procedure finds the largest that holds."""
    m = sum(n for _, _, n in counts)
    never = LAST_STEP + 1
    if not m:
        return [never] * (LAST_LENGTH + 1)
    mean = sum(length**2 * n for length, _, n in counts) / m
    tail = [NormalDist().cdf(-k * STEP) for k in range(LAST_STEP + 1)]
    most, found = 0.0, 0
    for q, n in sorted((tail[step] * mean / length**2, n) for length, step, n in counts):
        found += n
        if q <= fdr * found / m:
            most = q
    return [next((k for k in range(LAST_STEP + 1) if tail[k] * mean <= most * length**2 * (1 + 1e-12)), never) if length else never for length in range(LAST_LENGTH + 1)]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row for each row of df: (id_col, base, random): arrays of struct<start, end, kind, value>.

    Offsets count code points, the end is exclusive. A null text counts as empty and has no spans; null and
    repeated ids stay as they are; other columns are not looked at; an empty table gives no rows. base has the fixed kinds
    ordered by start, then kind; random has the candidates that are found among all those of the table that overlap no base
    span, so it depends on the table. Every text is scanned whole and once, in the task that reads it; the spans are
    written as a table, whose scores are counted (at most LAST_LENGTH x LAST_STEP counts come to the driver).
    """
    text, base = F.col("sc_text"), F.col("sc_base")
    rows = df.select(F.col(id_col), text_or_empty(text_col).alias("sc_text"))
    rows = rows.withColumn("sc_base", _ordered(F.concat(*(spans_of(text, p, k, g, n) for k, p, g, n in KINDS))))
    scanned = materialize(rows.select(F.col(id_col).alias("sc_id"), "sc_base", _tested(text, base).alias("sc_tested")), "secret-spans")
    counts = scanned.select(F.explode("sc_tested").alias("x")).groupBy("x.length", "x.step").agg(F.count("*").alias("n")).collect()
    least = F.array(*map(F.lit, cuts([tuple(x) for x in counts], fdr)))
    found = F.filter("sc_tested", lambda x: x["step"] >= F.get(least, x["length"]))
    return scanned.select(F.col("sc_id").alias(id_col), base.alias("base"), F.transform(found, lambda x: x["span"]).alias("random"))


def _ordered(spans: Column) -> Column:
    """By start, then by kind as listed."""
    rank = {k: n for n, (k, *_) in enumerate(KINDS)} | {"random": len(KINDS)}
    number = lambda x: reduce(lambda w, kn: w.when(x["kind"] == kn[0], kn[1]), list(rank.items())[1:], F.when(x["kind"] == "assign", 0))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("a"), number(x).alias("b"), x.alias("span"))))
    return F.transform(keyed, lambda x: x["span"])


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas, by start and then by kind."""
    return F.array_join(F.transform(_ordered(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
