"""From raw documents to training tokens, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept:

1. quality: importance resampling against the labelled good documents; those it rejects go.
2. exact: of equal texts one row of the smallest doc_id stays.
3. near: of each component of near-duplicates (five-word shingles, similarity 0.8) one document stays.
4. mix: documents are chosen by target weights of languages and sources, each at most once.
5. encode: token ids of every text, decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacework.llm import bpe, classifier, exactdup, mixing, neardup
from lacework.llm.common import drop_table, materialize, table
from lacework.llm.queries import WEIGHTS, byte_bpe, domain

#: Nine tenths of the tokens that are left, domains and languages by weight, sources alike, no document twice.
MIXTURE = mixing.Mixture(weights=WEIGHTS, budget_share=0.9, max_epochs=1)

#: Bytes of the encoder's tables in a worker: an executor still has the memory that the stages before have made its JVM take.
BPE_TABLES = 64 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts count as empty: their weight is 0. Ties at the last key all stay, rows with one id share
    their noise. Without labels all rows stay; an empty table stays empty."""
    return classifier.select_rows(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text counts as empty. One row of each text stays, that of the smallest id; null ids lose against others, and
    of rows that tie any one stays. An empty table stays empty."""
    return exactdup.exact_dedup(docs, one_row=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words all stay. One row of each component stays, that of the smallest id; null ids lose against others,
    and of rows that tie any one stays. An empty table stays empty."""
    return neardup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null language or source is a value of its own; a null text has no tokens and stays with its leaf. Rows that repeat an
    id share their place. An empty table stays empty."""
    return mixing.mix(docs, MIXTURE, levels=(domain(), "lang", "source")).drop("mx_epochs")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text gives no ids. Null and repeated ids stay rows of their own; an empty table gives no rows."""
    rows = bpe.encode_decode(docs, byte_bpe(), remembered=BPE_TABLES)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The classifier, the sketches and the tokenizer have no SQL; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the documents. Each stage's rows are a table in the shared folder until the next
    stage has written its own; the last of these tables stays, as the result reads it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            drop_table(*before)
            before = [docs]
    return docs
