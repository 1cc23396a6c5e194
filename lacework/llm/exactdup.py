"""Exact deduplication by Grace hashing.

Records are split by the hash of their content: first by Spark's shuffle, then, in each task, into
spill files, again and again with further bits of the hash, until what is left of a bucket fits an
open-addressing table. The table compares complete contents, so equal hashes never merge different
texts. Before the shuffle every task reduces what it read to distinct contents in the same way: of a
content that fills a third of the table, each task sends one record.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacework.llm import worker
from lacework.llm.common import SPACE, materialize, packed, text_or_empty

#: Bytes of contents that a table holds before its bucket is split.
TABLE_BYTES = 48 << 20
#: Spill files of one split.
FANOUT = 16
#: Bytes of an output batch.
BATCH_BYTES = 8 << 20


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of an entry. Entries: hash, content,
    smallest id, number of rows. Different contents of one hash stay apart."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[bytes] = []
        self.contents: list[bytes] = []
        self.least: list = []
        self.rows: list[int] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, least, rows: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := slots[at]) >= 0:
            if self.hashes[k] == digest and self.contents[k] == content:
                if least is not None and (self.least[k] is None or least < self.least[k]):
                    self.least[k] = least
                self.rows[k] += rows
                return
            at = (at + 1) & mask
        slots[at] = len(self.hashes)
        self.hashes.append(digest)
        self.contents.append(content)
        self.least.append(least)
        self.rows.append(rows)
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(slots):
            self._grow()

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = np.full(mask + 1, -1, np.int64)
        for k, digest in enumerate(self.hashes):
            at = int.from_bytes(digest[:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def entries(self) -> Iterator[tuple]:
        """(digest, content, least id, rows, whether another content has the same digest)"""
        shared = {d for d, n in Counter(self.hashes).items() if n > 1} if len(set(self.hashes)) < len(self.hashes) else ()
        return ((*x, x[0] in shared) for x in zip(self.hashes, self.contents, self.least, self.rows, strict=True))


class _Spill:
    """Records of one bucket in an unnamed file of the task's own scratch space (as Spark's own spills):
    it is gone with the task, and nothing outside the task reads it."""

    SCHEMA = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("least", pa.int64()), ("rows", pa.int64())])

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.writer = pa.ipc.new_stream(self.file, self.SCHEMA)
        self.held: list[tuple] = []
        self.bytes = 0

    def add(self, record: tuple) -> None:
        self.held.append(record)
        self.bytes += len(record[1])
        if self.bytes > 1 << 20 or len(self.held) >= 4096:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.held, strict=True), self.SCHEMA, strict=True)], schema=self.SCHEMA))
        self.held, self.bytes = [], 0

    def records(self) -> Iterator[tuple]:
        self._flush()
        self.writer.close()
        self.file.seek(0)
        for batch in pa.ipc.open_stream(self.file):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
        self.file.close()


def grace(records: Iterator[tuple], table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple]:
    """The entries (see ContentTable.entries) of all distinct (digest, content) among the records. All
    contents of one digest meet in one table, as buckets are split by the digest."""
    table = ContentTable()
    for record in records:
        table.add(*record)
        if table.bytes > table_bytes and len(table.hashes) > 1 and level < 12:
            break
    else:
        yield from table.entries()
        return
    spills = [_Spill() for _ in range(FANOUT)]

    def deal(record: tuple) -> None:
        # Four more bits of the hash at each level, from the end that the table doesn't use.
        spills[(record[0][-1 - level // 2] >> (4 * (level % 2))) % FANOUT].add(record)

    for entry in table.entries():
        deal(entry[:4])
    del table
    for record in records:
        deal(record)
    while spills:
        yield from grace(spills.pop().records(), table_bytes, level + 1)


def _grace_partition(table_bytes: int, final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """final: drop the contents that their digest alone tells apart."""

    def batch(entries: list[tuple]) -> pa.RecordBatch:
        digest, content, least, rows, _ = zip(*entries, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(content, pa.binary()).cast(pa.string()), pa.array(least, pa.int64()), pa.array(rows, pa.int64())], names=_ENTRY.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        held, size = [], 0
        for entry in grace(records, table_bytes):
            if final and not entry[4]:
                entry = (entry[0], None, *entry[2:])
            held.append(entry)
            size += len(entry[1] or b"") + 60
            if size > BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return run


_ENTRY = T.StructType([T.StructField("xd_digest", T.BinaryType()), T.StructField("xd_content", T.StringType()), T.StructField("xd_least", T.LongType()), T.StructField("xd_rows", T.LongType())])


def sha256_digest(text):
    return F.unhex(F.sha2(text, 256))


def normalised(text_col: str = "text"):
    """The text with every run of white space as one blank; null counts as empty."""
    return F.regexp_replace(text_or_empty(text_col), f"[{SPACE}]+", " ")


def content_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(xd_digest, xd_content, xd_least, xd_rows) of every distinct normalised text: digest, smallest id
    (nulls aside), number of rows. xd_content is null unless several texts have this digest."""
    rows = df.select(normalised(text_col).alias("xd_content"), F.col(id_col).cast("long").alias("xd_least"))
    rows = rows.select(digest(F.col("xd_content")).alias("xd_digest"), "xd_content", "xd_least", F.lit(1).cast("long").alias("xd_rows"))
    return rows.mapInArrow(worker.tasks_of("exactdup", _grace_partition(table_bytes, False)), _ENTRY).repartition("xd_digest").mapInArrow(worker.tasks_of("exactdup", _grace_partition(table_bytes, True)), _ENTRY)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of df: (id_col, keep_id, group_size, kept, digest binary).

    Texts are equal when identical after every run of white space became one blank; a null text counts
    as empty. Of equal texts the smallest id stays. Rows that repeat an id together with its text are
    one document: all are kept if that id is kept. Null ids never win against others; a group of null
    ids only has keep_id null and stays whole. An empty table gives no rows. Other columns of df are
    not looked at, whatever their names. Ids are integers.

    The groups are written as a table; then the documents are read again and only ids and digests are
    shuffled, for a join whose other side has one row for a text, so that adaptive execution may split
    a hot digest. Texts go along only if some digest has several texts.
    """
    groups = materialize(content_groups(df, id_col, text_col, digest, table_bytes), "exact-groups")
    rows = df.select(F.col(id_col).alias("xd_id"), normalised(text_col).alias("xd_text")).select("xd_id", digest(F.col("xd_text")).alias("xd_key"), "xd_text")
    same = F.col("xd_key") == F.col("xd_digest")
    if groups.where("xd_content is not null").isEmpty():
        rows = rows.drop("xd_text")
    else:
        same &= F.col("xd_content").isNull() | (F.col("xd_content") == F.col("xd_text"))
    return rows.join(groups, same).select(
        F.col("xd_id").alias(id_col), F.col("xd_least").alias("keep_id"), F.col("xd_rows").alias("group_size"), F.col("xd_id").eqNullSafe(F.col("xd_least")).alias("kept"), F.col("xd_key").alias("digest")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, table_bytes: int = TABLE_BYTES, one_row: bool = False) -> DataFrame:
    """The rows of df, all columns, whose text stays: those that exact_groups marks as kept. one_row: of rows that tie on
    the smallest id of a text, or of a text whose ids are all null, one stays instead of all."""
    groups = materialize(content_groups(df, id_col, text_col, digest, table_bytes), "exact-groups")
    rows = packed(df, F.col(id_col).cast("long").alias("xd_id"), normalised(text_col).alias("xd_text")).withColumn("xd_key", digest(F.col("xd_text")))
    stays = (F.col("xd_key") == F.col("xd_digest")) & F.col("xd_id").eqNullSafe(F.col("xd_least"))
    several = not groups.where("xd_content is not null").isEmpty()
    if not several:
        rows = rows.drop("xd_text")
    else:
        stays &= F.col("xd_content").isNull() | (F.col("xd_content") == F.col("xd_text"))
    if not one_row:
        return rows.join(groups, stays, "left_semi").select("row.*")
    # Ties can only be in groups of several rows. They are counted without texts, as there are none in most tables.
    known = ["xd_key", "xd_id", *(["xd_text"] if several else [])]
    ties = rows.join(groups.where("xd_rows > 1"), stays, "left_semi").groupBy(*known).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ties = materialize(ties.select(*(F.col(c).alias(f"tie_{c}") for c in known)), "exact-ties")
    kept = rows.join(groups, stays, "left_semi")
    if ties.isEmpty():
        return kept.select("row.*")
    same = (F.col("xd_key") == F.col("tie_xd_key")) & F.col("xd_id").eqNullSafe(F.col("tie_xd_id"))
    if several:
        same &= F.col("xd_text") == F.col("tie_xd_text")
    one = rows.join(ties, same, "left_semi").groupBy(*known).agg(F.first("row").alias("row"))
    return kept.join(ties, same, "left_anti").select("row.*").union(one.select("row.*"))
