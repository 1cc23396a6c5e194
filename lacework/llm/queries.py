"""The queries of this subpackage: thin digests of what the operators return over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacework.llm import bpe, classifier, exactdup, licenses, mixing, neardup, quality, secrets, suffixdup, tokenfile
from lacework.llm.common import materialize, table


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_decode(table(spark, sf_dir, "documents"), byte_bpe())
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exactdup.exact_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: Weights of domains, and of languages in each of them; sources alike.
DOMAINS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANGUAGES = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
WEIGHTS = {(d,): w for d, w in DOMAINS.items()} | {(d, x): w for d in DOMAINS for x, w in LANGUAGES.items()}
#: Half of all tokens.
MIXTURE = mixing.Mixture(weights=WEIGHTS, budget_share=0.5, max_epochs=4)


def domain() -> Column:
    """The documents have no domain; five sources in the order of their numbers are one here, others have none ("")."""
    return F.coalesce(F.concat(F.lit("d"), F.floor(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") / 5).cast("string")), F.lit(""))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), MIXTURE, levels=(domain(), "lang", "source"))
    return rows.select("doc_id", "lang", "source", F.col("mx_epochs").alias("epochs"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "license", F.round("coverage", 4).alias("coverage"), F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.concat("base", "random")).alias("spans"))


POLICIES = (quality.BASE, quality.STANDARD, quality.LENIENT)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_ledger(table(spark, sf_dir, "documents"))
    rows = quality.apply_policies(rows, POLICIES)
    more = ["n_lines", "n_letters", "n_upper", "n_exclaim", *(f"kept_{p.name}_v{p.version}" for p in POLICIES)]
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits", *more, quality.sole_failure(quality.STANDARD).alias("sole_failure"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablations of the policies over the ledger of op6."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    rows = materialize(rows.select("failed_bits"), "ledger-bits")
    out = [quality.ablations(rows, p).select(F.lit(f"{p.name}_v{p.version}").alias("policy"), "rule", "n_failed", "n_only_this") for p in POLICIES]
    return out[0].union(out[1]).union(out[2])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixdup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dup_components(table(spark, sf_dir, "documents"), words=2)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("key", 6).alias("key"), "kept")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_output(table(spark, sf_dir, "documents"), byte_bpe())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_secrets": op4_secrets,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_files": op10_token_files,
    "quality_ablations": quality_ablations,
}

#: The measurements and bits of every document, f, in DuckDB SQL.
_LEDGER = r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
        p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM t),
        q AS (SELECT doc_id, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM q WHERE c IS NOT NULL),
        rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE k > 1) GROUP BY doc_id),
        m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
            length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim FROM t LEFT JOIN rep USING (doc_id)),
        f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (5 * n_symbols > n_words)::BIGINT + 8 * (2 * n_upper > n_letters AND n_letters > 0)::BIGINT + 16 * (3 * n_dup_lines > n_lines AND n_dup_lines >= 3)::BIGINT
            + 32 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT + 64 * (2 * n_letters < word_chars)::BIGINT + 128 * (3 * n_exclaim > n_words)::BIGINT AS failed_bits FROM m)
    """

#: DuckDB SQL for what SQL can express.
ORACLE_SQL: dict[str, str] = {
    # The same water-filling, level by level; with these weights every domain, language and source has a weight above 0.
    "op2_mixing": r"""
        WITH c AS (SELECT doc_id, coalesce('d' || (try_cast(regexp_extract(source, '(\d+)$', 1) AS INTEGER) // 5)::VARCHAR, '') AS d, coalesce(lang, '') AS l, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
        leaf AS (SELECT d, l, s, sum(n)::BIGINT AS t FROM c GROUP BY d, l, s),
        z0 AS (SELECT d, 4.0::DOUBLE * sum(t)::DOUBLE AS cap, CASE d WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, (SELECT sum(t) FROM leaf)::DOUBLE * 0.5 AS given FROM leaf GROUP BY d),
        z1 AS (SELECT *, (given - coalesce(sum(cap) OVER (ORDER BY cap / w, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM z0),
        z2 AS (SELECT d, coalesce(least(cap, w * max(CASE WHEN share * w < cap THEN share END) OVER ()), cap) AS given FROM z1),
        a0 AS (SELECT d, l, 4.0::DOUBLE * sum(t)::DOUBLE AS cap, CASE WHEN d NOT IN ('d0', 'd1', 'd2', 'd3') THEN 1.0 WHEN l = 'en' THEN 5.0 WHEN l IN ('de', 'fr') THEN 2.0 ELSE 1.0 END::DOUBLE AS w, any_value(given) AS given FROM leaf JOIN z2 USING (d) GROUP BY d, l),
        a1 AS (SELECT *, (given - coalesce(sum(cap) OVER (PARTITION BY d ORDER BY cap / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY d ORDER BY cap / w, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM a0),
        a2 AS (SELECT d, l, coalesce(least(cap, w * max(CASE WHEN share * w < cap THEN share END) OVER (PARTITION BY d)), cap) AS given FROM a1),
        b0 AS (SELECT d, l, s, t, 4.0::DOUBLE * t AS cap, given FROM leaf JOIN a2 USING (d, l)),
        b1 AS (SELECT *, (given - coalesce(sum(cap) OVER (PARTITION BY d, l ORDER BY cap, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / count(*) OVER (PARTITION BY d, l ORDER BY cap, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM b0),
        b2 AS (SELECT d, l, s, t, coalesce(least(cap, max(CASE WHEN share < cap THEN share END) OVER (PARTITION BY d, l)), cap) AS b FROM b1),
        plan AS (SELECT d, l, s, f, round(b - f * t, 6) AS rest FROM (SELECT *, CASE WHEN t > 0 THEN least(floor(b / t), 4) ELSE 0 END::BIGINT AS f FROM b2)),
        o AS (SELECT c.*, f, rest, coalesce(sum(n) OVER (PARTITION BY d, l, s ORDER BY ('0x' || substr(md5('11|' || f::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c JOIN plan USING (d, l, s))
        SELECT o.doc_id, lang, source, f + (before < rest)::BIGINT AS epochs FROM o JOIN documents x ON x.doc_id IS NOT DISTINCT FROM o.doc_id WHERE f + (before < rest)::BIGINT > 0
    """,
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op6_quality_rules": _LEDGER
    + r"""
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits, n_lines, n_letters, n_upper, n_exclaim,
            failed_bits & 3 = 0 AS kept_base_v1, failed_bits = 0 AS kept_standard_v1, failed_bits & 3 = 0 AND bit_count(failed_bits & 252) <= 1 AS kept_lenient_v1, CASE WHEN bit_count(failed_bits) = 1 THEN failed_bits ELSE 0 END AS sole_failure FROM f
    """,
    "quality_ablations": _LEDGER
    + r""", rules AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('shouting', 8), ('duplicate_lines', 16), ('word_length', 32), ('few_letters', 64), ('exclamations', 128)) t(rule, b)),
        policies AS (SELECT * FROM (VALUES ('base_v1', 3), ('standard_v1', 255), ('lenient_v1', 3)) t(policy, mask))
        SELECT policy, rule, count(*) FILTER (failed_bits & b <> 0) AS n_failed, count(*) FILTER (failed_bits & mask = b) AS n_only_this FROM policies JOIN rules ON mask & b <> 0 CROSS JOIN f GROUP BY policy, rule
    """,
    # All pairs that share a shingle, so only for small tables.
    "op8_near_dedup": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM t),
        q AS (SELECT doc_id, n, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM p),
        sh AS (SELECT DISTINCT doc_id, a, coalesce(b, '') AS b FROM q WHERE b IS NOT NULL OR n = 1),
        z AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (SELECT x.doc_id AS d, y.doc_id AS e, count(*) AS k FROM sh x JOIN sh y ON x.a = y.a AND x.b = y.b AND x.doc_id < y.doc_id GROUP BY 1, 2),
        near AS (SELECT d, e FROM common JOIN z x ON x.doc_id = d JOIN z y ON y.doc_id = e WHERE 100 * k >= 80 * (x.n + y.n - k)),
        links AS (SELECT d, e FROM near UNION ALL SELECT e, d FROM near),
        reach AS (SELECT doc_id AS d, doc_id AS e FROM t UNION SELECT r.d, l.e FROM reach r JOIN links l ON l.d = r.e)
        SELECT t.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(e) AS component_id, t.doc_id = min(e) AS kept FROM t JOIN reach r ON r.d = t.doc_id LEFT JOIN z ON z.doc_id = t.doc_id GROUP BY t.doc_id
    """,
}
