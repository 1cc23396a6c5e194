"""Quality classification by importance resampling.

Two generative models of hashed n-grams are counted: one of the target (a bounded sample of documents labelled
good) and one of the raw corpus (all of it). The log importance weight of a document is the mean log ratio of its
n-grams under both, times a fixed number of n-grams: the weight of a document of that length. (The plain sum grows
with the text, over thousands of units between documents, and no noise of a sample would matter beside it.) Then a
sample without replacement is drawn by Gumbel top-k: every document gets its log weight plus Gumbel noise that is fixed
by its id and a seed, and the k largest stay, which draws in proportion to the weights.

The n-grams are of the text itself (its words, and pairs of neighbours) and of word shapes (upper, lower, digits, other
characters; a word that repeats the one before it has a shape of its own; one to three words). Words tell texts of the
target from well-shaped nonsense; shapes are shared by languages and topics, so a small labelled sample doesn't judge
a language by how often it drew it. A run without white space of more than 64 characters counts as several words, one for
each 64 characters, so that all of a text without blanks is judged. Counts of the target are drawn towards the raw model
where they are few.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacework.llm import worker
from lacework.llm.bpe import slices
from lacework.llm.common import materialize, packed
from lacework.llm.neardup import mix

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """buckets: of the hashed n-grams. prior: n-grams of the raw model, spread as it is, that are added to the target's. max_labels: documents of
    each label that are used, chosen by a hash of their ids. reject_cost: how many kept bad documents one lost
    good document counts for when k is fixed. length: n-grams that every document counts as; the smaller it is, the
    more chance decides. seed: of the Gumbel noise."""

    buckets: int = 1 << 16
    prior: float = 4000.0
    length: float = 8.0
    max_labels: int = 20_000
    reject_cost: float = 100.0
    seed: int = 17


#: Characters of a piece of a long word.
PIECE = 64
#: Bytes of texts that are counted together, about.
SLICE = 1 << 20
_RUN = re.compile(r"(.)\1+")


class _Classes(dict):
    """Code point -> the character that stands for its class."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return out


_CLASSES = _Classes()


def shape(word: str) -> str:
    """Xx for Word, X for WORD, 9 for digits, other characters once each."""
    return _RUN.sub(r"\1", word.translate(_CLASSES))


class _Words(worker.Remembered):
    """word -> the hash of its shape and the hash of the word, as bytes; for a long word those of its pieces, one after another"""

    def __missing__(self, word: str) -> bytes:
        if len(word) > PIECE:
            return b"".join(self[word[k : k + PIECE]] for k in range(0, len(word), PIECE))
        found = xxhash.xxh64_digest(shape(word)) + xxhash.xxh64_digest(word.lower())
        self.keep(word, found, 2 * len(word) + 90)
        return found


_WORDS = _Words(worker.BUDGET)
_SAME = _U(0x2D358DCCAA6C78A5)
_K = _U(0x9E3779B97F4A7C15)


def ngrams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of the texts, and the number of the text that it is of."""
    found, sizes, again = [], [], []
    for text in texts:
        words = (text or "").split()
        own = b"".join(map(_WORDS.__getitem__, words))
        if len(own) > 16 * len(words):
            # All pieces of a long word that repeats the word before it.
            at = sum(sizes) + np.cumsum([0] + [-(-len(w) // PIECE) for w in words])
            again += [np.arange(at[k + 1], at[k + 2]) for k, (a, b) in enumerate(pairwise(words)) if len(a) > PIECE and a.lower() == b.lower()]
        found.append(own)
        sizes.append(len(own) // 16)
    pairs = np.frombuffer(b"".join(found), ">u8").reshape(-1, 2).astype(_U)
    of = np.repeat(np.arange(len(texts)), sizes)
    shapes, words = pairs[:, 0].copy(), pairs[:, 1]
    two, three = of[1:] == of[:-1], of[2:] == of[:-2]
    shapes[1:][two & (words[1:] == words[:-1])] = _SAME
    for places in again:
        shapes[places] = _SAME
    with np.errstate(over="ignore"):
        second = mix(shapes[:-1] * _U(3) + shapes[1:] * _K)
        third = mix(second[:-1] * _U(5) + shapes[2:])
        neighbours = mix(words[:-1] * _U(7) + words[1:] * _K)
        every = np.concatenate([mix(shapes), second[two], third[three], mix(words ^ _K), neighbours[two]])
    return (every % _U(buckets)).astype(np.int64), np.concatenate([of, of[:-1][two], of[:-2][three], of, of[:-1][two]])


def ngram_buckets(text: str | None, buckets: int) -> np.ndarray:
    """The bucket of every n-gram of a text."""
    return ngrams([text], buckets)[0]


def mean_ratios(texts: list[str | None], ratios: np.ndarray) -> np.ndarray:
    """The mean log ratio of the n-grams of each text, 0 for a text without any."""
    bucket, of = ngrams(texts, len(ratios))
    return np.bincount(of, ratios[bucket], len(texts)) / np.maximum(np.bincount(of, minlength=len(texts)), 1)


def labelled(labels: DataFrame, most: int, seed: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(l_id, good): at most `most` documents of either label. A document labelled both ways counts as bad; null
    ids and labels are left out."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("l_id")).agg((F.min(label_col) > 0).alias("good"))
    some = [rows.where(F.col("good") == good).orderBy(F.xxhash64("l_id", F.lit(seed)), "l_id").limit(most) for good in (True, False)]
    return some[0].union(some[1])


def log_ratios(df: DataFrame, sample: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratio of target and raw for each bucket. The driver gets one row a bucket, whatever the corpus; each
    task sums what it reads."""
    n = settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for part in (x for batch in batches for x in slices(batch, SLICE)):
            bucket, of = ngrams(part.column(1).to_pylist(), n)
            raw += np.bincount(bucket, minlength=n)
            good = np.array(part.column(0).to_pylist(), bool)
            if good.any():
                target += np.bincount(bucket[good[of]], minlength=n)
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw[k]), pa.array(target[k])], names=["bucket", "raw", "target"])

    good = sample.where("good")
    rows = df.select(F.col(text_col).alias("c_text"), F.col(id_col).cast("long").alias("c_id")).join(F.broadcast(good), F.col("c_id") == F.col("l_id"), "left")
    counts = rows.select(F.coalesce("good", F.lit(False)).alias("good"), "c_text").mapInArrow(worker.tasks_of("classifier", run), "bucket long, raw long, target long")
    raw, target = np.zeros(n), np.zeros(n)
    for bucket, r, t in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(n)
    raw_share = (raw + 0.5) / (raw.sum() + 0.5 * n)
    return np.log((target + settings.prior * raw_share) / (target.sum() + settings.prior)) - np.log(raw_share)


def log_weights(df: DataFrame, ratios: np.ndarray, length: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(q_id, log_weight) of every row."""
    schema = T.StructType([T.StructField("q_id", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, SLICE)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length * mean_ratios(part.column(1).to_pylist(), ratios))], names=schema.names)

    return df.select(F.col(id_col).cast("long").alias("q_id"), F.col(text_col).cast("string").alias("q_text")).mapInArrow(worker.tasks_of("classifier", run), schema)


def gumbel(id_col: str, seed: int):
    """Gumbel noise from a hash of the id."""
    u = (F.xxhash64(F.lit(seed), F.col(id_col)) / F.lit(2.0**64) + 0.5) * (1 - 2e-16) + 1e-16
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 2048, few: int = 4096) -> float:
    """The k-th largest value of a column without nulls: histograms of at most `bins` rows over ever smaller ranges."""
    if k <= 0:
        return math.inf
    low, high = df.agg(F.min(col), F.max(col)).first()
    while True:
        inside = df.where(F.col(col).between(low, high))
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            return low
        counts = sorted(inside.groupBy(F.least(F.floor((F.col(col) - low) / step), F.lit(bins - 1)).cast("int").alias("b")).agg(F.count("*"), F.min(col), F.max(col)).collect(), reverse=True)
        for _, n, least, most in counts:
            if k <= n:
                low, high, held = least, most, n
                break
            k -= n
        else:
            return low
        if held <= few:
            return sorted((x[0] for x in df.where(F.col(col).between(low, high)).select(col).collect()), reverse=True)[k - 1]


def cut_from_labels(good: list[float], bad: list[float], cost: float) -> float:
    """The log weight from which documents count as good: the cheapest cut between labelled weights, halfway."""
    if not good or not bad:
        return -math.inf
    values = np.array(good + bad)
    weight = np.array([cost] * len(good) + [-1.0] * len(bad))
    order = np.argsort(values, kind="stable")
    values, lost = values[order], np.concatenate([[0.0], np.cumsum(weight[order])])
    # lost[i]: of cutting below values[i], against cutting nothing.
    best = np.flatnonzero(lost == lost.min())
    i = int(best[len(best) // 2])
    return -math.inf if i == 0 else math.inf if i == len(values) else float(values[i - 1] + values[i]) / 2


def resample(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row for each row of df: (id_col, log_weight, key, kept); the k rows with the largest keys are kept.

    Where k is None, it is the number of rows whose log weight passes the cut that fits the labelled sample best.
    Without any good label all weights are 0; without a cut all rows are kept. A null text counts as empty and has
    weight 0. Rows with one id share their noise, so repeated rows are kept or dropped together, and ties at the last
    key are all kept. Null ids share one noise. An empty table gives no rows. Other columns are not looked at.
    """
    keyed, _, least = _decide(df, labels, settings, k, id_col, text_col)
    return keyed.select(F.col("q_id").alias(id_col), "log_weight", "key", (F.col("key") >= least).alias("kept"))


def select_rows(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of df, all columns, that resample() keeps. Weights are computed once more where the rows are read, so
    that no text is shuffled."""
    _, ratios, least = _decide(df, labels, settings, k, id_col, text_col)

    @F.pandas_udf("double")
    def weight(texts: pd.Series) -> pd.Series:
        held = texts.tolist()
        return pd.Series(settings.length * np.concatenate([mean_ratios(held[k : k + 500], ratios) for k in range(0, len(held), 500)] or [np.empty(0)]))

    rows = packed(df, F.col(id_col).cast("long").alias("q_id"), F.col(text_col).cast("string").alias("q_text"))
    return rows.where(weight("q_text") + gumbel("q_id", settings.seed) >= least).select("row.*")


def _decide(df: DataFrame, labels: DataFrame, settings: Settings, k: int | None, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray, float]:
    """The keys of all rows, the log ratios, and the least key that is kept."""
    sample = materialize(labelled(labels, settings.max_labels, settings.seed), "labelled")
    ratios = log_ratios(df, sample, settings, id_col, text_col)
    scored = materialize(log_weights(df, ratios, settings.length, id_col, text_col), "log-weights")
    keyed = scored.withColumn("key", F.col("log_weight") + gumbel("q_id", settings.seed))
    if k is None:
        known = scored.join(F.broadcast(sample), F.col("q_id") == F.col("l_id")).select("good", "log_weight").collect()
        cut = cut_from_labels([w for g, w in known if g], [w for g, w in known if not g], settings.reject_cost)
        k = scored.where(F.col("log_weight") >= cut).count()
    return keyed, ratios, kth_largest(keyed, "key", k) if not scored.isEmpty() else math.inf
