"""Token ids as directly addressable codes.

An id is cut into chunks of eight bits, the lowest first. Level 0 has the first chunk of every id, level
k the k-th chunk of the ids that need one; a bitmap for each level tells which chunks continue, and a rank
directory over the bitmap tells where the next chunk stands. Frequent ids are small in BPE vocabularies and take one or
two bytes.

A level lies in blocks of 512 chunks, each with its rank, its part of the bitmap and its chunks side by side, all blocks
of one size. So any token is read from the file with the head and one block a level, whatever the size of the file, and
nothing else is read or decoded.

A segment is a file (little-endian):

    head       8 bytes magic "LWDAC02\n"; u32 number of documents, u32 of levels; u64 number of ids; u64 where the documents start;
               4 x (u64 number of chunks, u64 where the level starts); u32 crc32 of all that follows the head, u32 of the head so far
    per level  blocks: u32 continuing chunks before this block; 64 bytes bitmap; 512 bytes chunks
    documents  u8[d] 1 for a document without id, filled to 8 bytes; i64[d] document ids (0 where there is none);
               u64[d+1] where each document's ids start, counted from the segment's first id

Files have names of their own; a manifest, written by Spark, lists those of the tasks that were committed. A file of an
attempt that failed is in no manifest and is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacework.llm import worker
from lacework.llm.bpe import LONGEST_KEPT, by_pieces, slices
from lacework.llm.common import fresh_path

MAGIC = b"LWDAC02\n"
HEAD = struct.Struct("<8sIIQQ8QI")
HEAD_BYTES = HEAD.size + 4
BLOCK_CHUNKS = 512
BLOCK = np.dtype([("rank", "<u4"), ("bits", "u1", BLOCK_CHUNKS // 8), ("chunks", "u1", BLOCK_CHUNKS)])
#: Ids of a segment, about; a document is never cut.
SEGMENT_IDS = 2 << 20
KEPT_CHUNKS = 700_000


def _filled(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The segment of these documents, in this order; ids are unsigned 32-bit integers."""
    rest = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.uint32)
    starts = np.cumsum([0, *map(len, ids)], dtype=np.uint64)
    n_ids, places, body, at = len(rest), [], [], HEAD_BYTES
    while not places or len(rest):
        more = rest >> 8 > 0
        blocks = np.zeros(-(-len(rest) // BLOCK_CHUNKS), BLOCK)
        flat = np.zeros(len(blocks) * BLOCK_CHUNKS, np.uint8)
        flat[: len(rest)] = rest & 255
        blocks["chunks"] = flat.reshape(-1, BLOCK_CHUNKS)
        flat[:] = 0
        flat[: len(rest)] = more
        bits = np.packbits(flat, bitorder="little").reshape(-1, BLOCK_CHUNKS // 8)
        blocks["bits"] = bits
        blocks["rank"][1:] = np.cumsum(flat.reshape(-1, BLOCK_CHUNKS).sum(1, dtype=np.uint32))[:-1]
        body.append(blocks.tobytes())
        places.append((len(rest), at))
        at += len(body[-1])
        rest = rest[more] >> 8
    body += [_filled(bytes(x is None for x in doc_ids)), np.array([x or 0 for x in doc_ids], np.int64).tobytes(), starts.tobytes()]
    crc = 0
    for part in body:
        crc = zlib.crc32(part, crc)
    head = HEAD.pack(MAGIC, len(doc_ids), len(places), n_ids, at, *(x for p in places + [(0, 0)] * (4 - len(places)) for x in p), crc)
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *body])


class Addressed:
    """A segment whose tokens are read one by one. read(at, n): n bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes]):
        head = read(0, HEAD_BYTES)
        if len(head) < HEAD_BYTES or head[:8] != MAGIC or struct.unpack_from("<I", head, HEAD.size)[0] != zlib.crc32(head[: HEAD.size]):
            raise ValueError("not a segment of directly addressable codes")
        _, self.n_docs, levels, self.n_ids, self.docs_at, *places, self.crc = HEAD.unpack_from(head)
        self.levels = list(zip(places[::2], places[1::2], strict=True))[:levels]
        self.read = read

    def get(self, i: int) -> int:
        """The i-th id: one block is read for each of its chunks."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (_, at) in enumerate(self.levels):
            block = np.frombuffer(self.read(at + BLOCK.itemsize * (i // BLOCK_CHUNKS), BLOCK.itemsize), BLOCK)[0]
            j = i % BLOCK_CHUNKS
            value |= int(block["chunks"][j]) << (8 * k)
            if not block["bits"][j >> 3] >> (j & 7) & 1:
                break
            i = int(block["rank"]) + int(np.unpackbits(block["bits"], count=j, bitorder="little").sum())
        return value


class Segment(Addressed):
    """A segment that is read whole, and checked."""

    def __init__(self, data: bytes):
        super().__init__(lambda at, n: data[at : at + n])
        if zlib.crc32(memoryview(data)[HEAD_BYTES:]) != self.crc:
            raise ValueError("not a whole segment of directly addressable codes")
        self.data = data
        at = self.docs_at
        missing = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += -(-self.n_docs // 8) * 8
        self.doc_ids = [None if m else x for m, x in zip(missing, np.frombuffer(data, "<i8", self.n_docs, at).tolist(), strict=True)]
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at + 8 * self.n_docs).astype(np.int64)

    def all_ids(self) -> np.ndarray:
        """All ids, level by level from the last."""
        above = np.empty(0, np.uint32)
        for n, at in reversed(self.levels):
            blocks = np.frombuffer(self.data, BLOCK, -(-n // BLOCK_CHUNKS), at)
            out = blocks["chunks"].reshape(-1)[:n].astype(np.uint32)
            more = np.unpackbits(blocks["bits"].reshape(-1), count=n, bitorder="little").astype(bool)
            out[more] |= above << 8
            above = out
        return above

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start in the segment, ids)"""
        ids = self.all_ids()
        for k, doc in enumerate(self.doc_ids):
            yield doc, int(self.starts[k]), ids[self.starts[k] : self.starts[k + 1]]


class LibraryEncoder:
    """The tokenizers library, asked once for each piece that a worker has not met lately. Texts fall into chunks at
    blanks before a visible character, and a chunk into its leading letters and the rest; byte-level pre-tokens
    always break there, so pieces are encoded apart, many unknown ones together. Ids are kept as bytes, to be joined."""

    LETTERS = regex.compile(r"\p{L}+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.sizes[list(vocab.values())] = list(map(len, vocab))  # byte-level: a character stands for a byte
        self.newline = self._library("\n").tobytes()
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.met_once: dict[str, bytes] = {}
        self.met_again: dict[str, bytes] = {}

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodes " " + word for all of them together; no word starts with white space."""
        out: dict[str, bytes] = {}
        for k in range(0, len(words), 4000):
            part = [" " + w for w in words[k : k + 4000]]
            ids = self._library("".join(part))
            cut = 4 * (np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x.encode()) for x in part]), "left") + 1)
            data, at = ids.tobytes(), 0
            for word, to in zip(words[k : k + 4000], cut.tolist(), strict=True):
                out[word] = data[at:to]
                at = to
        return out

    def _learn_heads(self, heads: set[str]) -> None:
        """Encodes words that no blank stands before, for all of them together: each stands behind a newline, which is a
        pre-token of its own before a visible character."""
        new = [h for h in heads if h not in self.heads]
        if len(self.heads) + len(new) > KEPT_CHUNKS // 4:
            self.heads.clear()
            new = list(heads)
        for k in range(0, len(new), 4000):
            part = ["\n" + h for h in new[k : k + 4000]]
            ids = self._library("".join(part))
            cut = 4 * (np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x.encode()) for x in part]), "left") + 1)
            data, at = ids.tobytes(), 0
            for head, to in zip(new[k : k + 4000], cut.tolist(), strict=True):
                self.heads[head] = data[at + 4 : to]
                at = to

    def _tail(self, text: str) -> bytes:
        """The ids of what follows the leading letters of a chunk: often a mark, a newline and a word."""
        mark, newline, word = text.partition("\n")
        if newline and mark and word in self.heads and mark.split() == [mark]:
            return self._tail(mark) + self.newline + self.heads[word]
        ids = self.tails.get(text)
        if ids is None:
            ids = self._library(text).tobytes()
            if len(text) <= LONGEST_KEPT:
                if len(self.tails) > KEPT_CHUNKS // 10:
                    self.tails.clear()
                self.tails[text] = ids
        return ids

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Most words of a language are met once and never again, so only those met in a second
        batch are kept for long; the others make room for the next batch's."""
        return [x.view("<u4") for x in by_pieces(texts, self._ids_of)]

    def _ids_of(self, lone: list[str], words: list[str]) -> tuple[list[bytes], list[bytes]]:
        known, once, letters = self.met_again, self.met_once, self.LETTERS
        if len(known) > KEPT_CHUNKS:
            known.clear()
        found = list(map(known.get, words))
        new, heads = [], set()
        for k, x in enumerate(found):
            if x is None:
                w = words[k]
                x = once.pop(w, None)
                if x is not None:
                    known[w] = found[k] = x
                    continue
                m = letters.match(w)
                h = m[0] if m and "<|" not in w else w
                heads.add(h)
                new.append((k, w, h, w[len(h) :]))
        alone = {*lone, *(r.partition("\n")[2] for *_, r in new if "\n" in r)}
        self._learn_heads({x for x in alone if x.split() == [x] and "<|" not in x and len(x) <= LONGEST_KEPT})
        of = {h: x for h in heads if (x := known.get(h) or once.get(h)) is not None}
        of |= self._learn(list(heads.difference(of)))
        if len(once) + len(of) + len(new) > KEPT_CHUNKS // 2:
            once.clear()
        once.update(x for x in of.items() if len(x[0]) <= LONGEST_KEPT and x[0] not in known)
        tail = self._tail
        for k, w, h, r in new:
            found[k] = x = of[h] + tail(r) if r else of[h]
            if r and len(w) <= LONGEST_KEPT:
                once[w] = x
        return [self.heads[x] if x in self.heads else self._library(x).tobytes() for x in lone], found


_LOADED: dict[str, LibraryEncoder] = {}
worker.forgets(_LOADED.clear)


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


_FILES = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("file", T.StringType())])


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of every text of df, each followed by end_id, in ascending id order under `path`: segments of about
    segment_ids ids in path/segments, and the manifest (shard, segment, n_docs, n_ids, file) in path/manifest.

    Documents are dealt by ranges of id to `shards` shards and sorted there (null ids first, repeated ids
    in no stated order); every shard is cut into segments. Tasks write their files side by side to any store that pyarrow
    writes to (a shared folder, HDFS, S3). A task that is run again writes new files; the manifest has those of one attempt.
    A null text counts as empty: its ids are end_id alone. Ids are integers. Other columns are not looked at.
    """
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        docs, ids, held, number = [], [], 0, 0
        fs, folder = file_system(f"{path}/segments")

        def segment() -> pa.RecordBatch:
            name = f"{shard:06d}-{number:06d}-{uuid.uuid4().hex}.dac"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(pack_segment(docs, ids))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([name], pa.string())], names=_FILES.names)

        for batch in batches:
            for part in slices(batch):
                for doc, x in zip(part.column(0).to_pylist(), encoder.encode_all(part.column(1)), strict=True):
                    docs.append(doc)
                    ids.append(np.concatenate([x, end]))
                    held += len(x) + 1
                    if held >= segment_ids:
                        yield segment()
                        docs, ids, held, number = [], [], 0, number + 1
        if docs:
            yield segment()

    rows = df.select(F.col(id_col).cast("long").alias("tf_id"), F.col(text_col).alias("tf_text"))
    rows.repartitionByRange(shards, "tf_id").sortWithinPartitions("tf_id").mapInArrow(worker.tasks_of("tokenfile", run), _FILES).write.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row for each document of the files under `path` (see write_token_files): (doc_id, start, n_tokens,
    ids_crc32[, ids array<long>]), start counting the ids of all documents before it.

    Where a segment starts follows from the sums of the shards before its own (one number a shard, on the
    driver: as many as the writer had tasks) and a running sum inside the shard. Files without documents give no rows.
    """
    manifest = spark.read.schema(_FILES).parquet(f"{path}/manifest")
    sums = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.count("*").alias("segments")).orderBy("shard").collect()
    bases, total = [], 0
    for shard, n, _ in sums:
        bases.append((shard, total))
        total += n
    index = manifest.join(F.broadcast(spark.createDataFrame(bases, "shard int, base long")), "shard")
    before = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = index.select("file", (F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("first"))
    fields = [("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.ArrayType(T.LongType()))] * with_ids
    schema = T.StructType([T.StructField(*x) for x in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(f"{path}/segments")
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{folder}/{file}") as f:
                    data = f.read()
                docs, at, n, crc, ids = [], [], [], [], []
                for doc, start, x in Segment(data).documents():
                    docs.append(doc)
                    at.append(first + start)
                    n.append(len(x))
                    crc.append(zlib.crc32(x.astype("<u4", copy=False).tobytes()))
                    if with_ids:
                        ids.append(x.astype(np.int64))
                columns = [pa.array(c, pa.int64()) for c in (docs, at, n, crc)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # A row is a file of megabytes, so they are dealt out one by one.
    n_segments = sum(x.segments for x in sums)
    return index.repartition(max(1, min(n_segments, 100_000)), "file").mapInArrow(worker.tasks_of("tokenfile", run), schema)


class TokenFiles:
    """The files under `path`, opened to read single tokens. bytes_read counts what was read of segments."""

    def __init__(self, path: str):
        import pyarrow.dataset as ds

        fs, at = file_system(f"{path}/manifest")
        self.fs, self.folder = file_system(f"{path}/segments")
        rows = sorted(zip(*ds.dataset(at, filesystem=fs, format="parquet").to_table(["shard", "segment", "n_ids", "file"]).to_pydict().values(), strict=True))
        self.files = [x[3] for x in rows]
        self.ends = list(accumulate(x[2] for x in rows))
        self.bytes_read = 0

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def token_at(self, i: int) -> int:
        """The i-th id of all documents, in ascending order of document ids."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = bisect_right(self.ends, i)
        with self.fs.open_input_file(f"{self.folder}/{self.files[k]}") as f:

            def read(at: int, n: int) -> bytes:
                self.bytes_read += n
                return f.read_at(n, at)

            return Addressed(read).get(i - (self.ends[k - 1] if k else 0))


def token_output(df: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Writes df in the file format under the shared folder and reads the files back. An empty table writes
    no segment and reads as no rows."""
    path = fresh_path(df.sparkSession, "tokens")
    write_token_files(df, path, tokenizer_path, end_id, id_col, text_col)
    return read_token_files(df.sparkSession, path, with_ids)
