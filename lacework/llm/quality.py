"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps what was measured and one failure bit
a rule; policies (a named, versioned set of rules) are then applied to the bits alone, and the effect of
leaving a rule out is counted with bitwise operations, without looking at a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacework.llm.common import SPACE, text_or_empty

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_exclaim")
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """fails: from the measurements, by name, to a condition."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of `strict` and at most `allowed` of `soft`."""

    name: str
    version: int
    strict: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0


#: The place of a rule here is its bit; new rules are appended.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 5 * m("n_symbols") > m("n_words")),
    Rule("shouting", lambda m: (2 * m("n_upper") > m("n_letters")) & (m("n_letters") > 0)),
    Rule("duplicate_lines", lambda m: (3 * m("n_dup_lines") > m("n_lines")) & (m("n_dup_lines") >= 3)),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 25 * m("n_words"))),
    Rule("few_letters", lambda m: 2 * m("n_letters") < m("word_chars")),
    Rule("exclamations", lambda m: 3 * m("n_exclaim") > m("n_words")),
)

BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, ("few_words", "repeated_words", "symbols", "shouting", "duplicate_lines", "word_length", "few_letters", "exclamations"))
LENIENT = Policy("lenient", 1, ("few_words", "repeated_words"), ("symbols", "shouting", "duplicate_lines", "word_length", "few_letters", "exclamations"), 1)


def bits(names: tuple[str, ...]) -> int:
    at = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that stand in a 3-word window which occurs twice or more."""
    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    # Only texts in which a hash comes twice are looked at closely, by the words themselves.
    windows = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))

    def twice(x: Column, k: Column) -> Column:
        return F.coalesce(x["w"] == F.get(windows_, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(windows_, k + 1)["w"], F.lit(False))

    def covered(found: Column) -> Column:
        starts = F.sort_array(F.transform(found, lambda x: x["i"]))
        # One after another: where the covered stretch ends so far, and how many words it has.
        state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, state, lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + (i + 3 - F.greatest(s["end"], i))).alias("n")), lambda s: s["n"])

    # A one-element transform names the sorted windows, so that they are made once.
    windows_ = None

    def close(sorted_windows: Column) -> Column:
        nonlocal windows_
        windows_ = sorted_windows
        return covered(F.filter(sorted_windows, twice))

    exact = F.get(F.transform(F.array(windows), close), F.lit(0))
    return F.when(n < 3, F.lit(0).cast("long")).when(F.size(F.array_distinct(hashes)) == n - 2, F.lit(0).cast("long")).otherwise(exact)


def measure(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the measurements of every text, each made once: n_words, word_chars, n_symbols, n_lines (with
    a word), n_dup_lines, n_repeat_words, n_letters, n_upper, n_exclaim. All built-in functions; no shuffle.
    A null text has no words. Rows, nulls and repeats stay as they are; other columns are not looked at. Columns of `keep`
    may not be called like a measurement, or failed_bits."""
    if clash := set(keep) & {*MEASUREMENTS, "failed_bits"}:
        raise ValueError(f"these columns would stand twice in the ledger: {sorted(clash)}")
    text = F.col("ql_text")
    rows = df.select(*keep, text_or_empty(text_col).alias("ql_text"))
    bare = F.btrim(text, F.lit(BLANKS))
    rows = rows.withColumn("ql_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+")))
    n = F.size("ql_words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = rows.withColumns({"ql_lines": lines, "ql_letters": F.regexp_replace(text, r"[^\p{L}]+", "")})
    length = lambda c: F.length(c).cast("long")
    return rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        length(F.translate(text, BLANKS, "")).alias("word_chars"),
        (length(text) - length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.size("ql_lines").cast("long").alias("n_lines"),
        (F.size("ql_lines") - F.size(F.array_distinct("ql_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("ql_words"), n).alias("n_repeat_words"),
        length(F.col("ql_letters")).alias("n_letters"),
        (length(F.col("ql_letters")) - length(F.regexp_replace("ql_letters", r"\p{Lu}+", ""))).alias("n_upper"),
        (length(text) - length(F.translate(text, "!", ""))).alias("n_exclaim"),
    )


def ledger(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """measure() and failed_bits (long): bit k is set if the text fails RULES[k]."""
    failed = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(rule.fails(F.col), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(df, text_col, keep).withColumn("failed_bits", failed)


def kept_under(policy: Policy, failed: str = "failed_bits") -> Column:
    """The policy's verdict, from the bits alone."""
    verdict = F.col(failed).bitwiseAND(F.lit(bits(policy.strict)).cast("long")) == 0
    if policy.soft:
        verdict &= F.bit_count(F.col(failed).bitwiseAND(F.lit(bits(policy.soft)).cast("long"))) <= policy.allowed
    return verdict


def apply_policies(rows: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """A ledger with a column kept_<name>_v<version> for each policy. Bits are never null, so verdicts aren't either; a column
    of such a name is replaced. An empty ledger stays empty."""
    return rows.withColumns({f"kept_{p.name}_v{p.version}": kept_under(p) for p in policies})


def sole_failure(policy: Policy, failed: str = "failed_bits") -> Column:
    """The bit of the one strict rule without which the policy would keep the document; 0 if it fails none or several."""
    own = F.col(failed).bitwiseAND(F.lit(bits(policy.strict)).cast("long"))
    return F.when(F.bit_count(own) == 1, own).otherwise(F.lit(0).cast("long"))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """A row for each strict rule of the policy: (rule, n_failed, n_only_this): how many documents fail it, and
    how many more would be kept without it. One pass over the bits, summed before any shuffle."""
    mask = bits(policy.strict)
    names = [r.name for r in RULES if r.name in policy.strict]
    own = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    sums = []
    for name in names:
        bit = F.lit(bits((name,))).cast("long")
        sums.append(F.struct(F.lit(name).alias("rule"), F.count(F.when(own.bitwiseAND(bit) != 0, 1)).alias("n_failed"), F.count(F.when(own == bit, 1)).alias("n_only_this")))
    return rows.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quality_ledger(df: DataFrame, policy: Policy = STANDARD, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger with base_failed and kept: kept if neither the base policy nor `policy` drops it."""
    rows = ledger(df, text_col, keep)
    base = kept_under(BASE)
    return rows.withColumns({"base_failed": ~base, "kept": base & kept_under(policy)})
