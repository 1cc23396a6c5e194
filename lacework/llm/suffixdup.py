"""Removal of long repeated byte strings by distributed prefix doubling over sampled suffixes.

Two suffixes share their first `length` bytes exactly if they share ever longer prefixes; so suffixes get a
rank (the name of a class of equal prefixes) at a short length, those whose rank is unique are dropped, and the
rest are ranked again at a greater offset, by the pair (rank here, rank at the offset), until the threshold. Ranking
every position would move dozens of bytes for every byte of text, so positions are sampled first, without losing a match:

1. Every window of `length` bytes has an anchor: its leftmost gram of length / 4 bytes with the least hash. Equal
   windows have equal anchors at equal places. Neighbouring windows with one anchor are a segment. Anchors are ranked by
   their grams; a segment whose gram is unique has no repeated window.
2. The rest are ranked by the whole segment. Equal segments are repeated, all of them. Where a gram has several
   different segments, these are open.
3. Open segments are cut into slabs of `slab` windows at fixed places relative to the anchor. Of the bytes that all
   windows of a slab share, the suffixes are ranked by a half and then by the whole, each time by the pair of the ranks of
   the two halves before; slabs whose rank is unique go. Slabs with equal bytes in all are repeated.
4. The windows of slabs still open are ranked in the same way: by half a window, then by all of it.

Spark sorts and counts the rank pairs in every step, summed before the shuffle; a repeated string is represented once in
the next step, so that a passage in a third of all documents is no larger than any other. Ranks are 64-bit names that
follow from the two ranks before, which every task gives alike; what is decided at the threshold rests on 128 bits.

All of it runs twice, at growing lengths: first for passages of `passage` bytes, over all texts, and then for `length`
bytes over what the first found to be repeated and long enough, of which equal pieces are one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacework.llm import worker
from lacework.llm.common import drop_table, materialize, release

LENGTH = 400
#: Of a passage: fifty words of four letters and a blank.
PASSAGE = 250
SLAB = 32
#: Windows of one pass over a long text.
CHUNK = 4 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base of the rolling hash and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, x, _U)]), dtype=_U) for x in (_BASE, _BASE_INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_SCALE = np.array([(k * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1) for k in range(256)], _U)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the bytes [i, i + gram) for every i. It only samples and groups; nothing is decided by it alone."""
    up, down = _POWERS.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_SCALE[data] * up[: len(data)], dtype=_U)])
        h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values: blocks of that width, accumulated from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, _U)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(gram hash, first window, last window, anchor) of every segment; windows and anchor by their start."""
    data = np.frombuffer(text, np.uint8)
    width = length - gram + 1
    for c in range(0, len(data) - length + 1, CHUNK):
        part = data[c : c + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        # The upper 40 bits decide, then the place.
        least = sliding_least((h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=_U), width)
        at = (least & _U(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        anchors = at[first]
        yield from zip(h[anchors].view(np.int64).tolist(), (first + c).tolist(), (last + c).tolist(), (anchors + c).tolist(), strict=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching [start, end) as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_KEY = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
_INT = T.IntegerType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(_KEY + [T.StructField(*f) for f in fields])


_SEGMENT = _schema(("h", T.LongType()), ("ctx", T.BinaryType()), ("n", _INT), ("lo", _INT), ("hi", _INT), ("at", _INT))
_CONTEXT = _schema(("c", _INT), ("lo", _INT), ("hi", _INT), ("at", _INT), ("data", T.BinaryType()))
_SLAB = _schema(("base", _INT), ("c", _INT), ("lo", _INT), ("hi", _INT), ("r0", T.LongType()), ("r1", T.LongType()), ("r2", T.LongType()), ("full", T.BinaryType()))
_WINDOW = _schema(("r0", T.LongType()), ("r1", T.LongType()), ("r2", T.LongType()), ("c", _INT), ("lo", _INT))
_PIECE = _schema(("start", _INT), ("p1", T.LongType()), ("p2", T.LongType()), ("data", T.BinaryType()))


def _columns(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _name(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _find_segments(length: int, gram: int):
    """From (k1, k2, c, text): the segments of every text that stands for c equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, c, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3).cast(pa.binary()), strict=True):
                text = text.as_py()
                if len(text) < length:
                    continue
                own: dict[tuple[int, bytes], list[tuple[int, int, int]]] = defaultdict(list)
                for h, lo, hi, at in segments(text, length, gram):
                    own[h, xxhash.xxh3_128_digest(text[lo : hi + length] + (at - lo).to_bytes(4, "little"))].append((lo, hi, at))
                known = [(0, len(text) - length + 1)] if c > 1 else []
                for (h, ctx), places in own.items():
                    lo, hi, at = places[0]
                    out.append((k1, k2, h, ctx, c * len(places), lo, hi, at))
                    if len(places) > 1:  # repeated in this text already
                        known += [(a, b + 1) for a, b, _ in places]
                # A row without a gram: windows known to be repeated.
                out += [(k1, k2, None, None, 1, a, b - 1, a) for a, b in merged(known)]
                if len(out) > 20_000:
                    yield _columns(out, _SEGMENT)
                    out = []
            yield _columns(out, _SEGMENT)

    return run


def _cut_contexts(length: int):
    """From texts and their open segments: the bytes of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k1, k2, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                text = text.as_py()
                for p in places.as_py():
                    data = text[p["lo"] : p["hi"] + length]
                    out.append((k1, k2, p["c"], p["lo"], p["hi"], p["at"], data))
                    size += len(data) + 80
                    if size > 4 << 20:
                        yield _columns(out, _CONTEXT)
                        out, size = [], 0
            yield _columns(out, _CONTEXT)

    return run


def _cut_slabs(length: int, slab: int):
    """Slab j of an anchor has the windows that start slab * j to slab * (j + 1) - 1 bytes before it. r0, r1: ranks of the two
    quarters of the first half of what its windows share, r2: of the second half."""
    shared = length - slab + 1
    quarter, half = shared // 4, shared // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, c, lo, hi, at, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for j in range((at - hi) // slab, (at - lo) // slab + 1):
                    first, last = at - slab * (j + 1) + 1, at - slab * j
                    a, b = max(lo, first), min(hi, last)
                    core, mark = data[last - lo : first - lo + length], j.to_bytes(4, "little", signed=True)
                    full = xxhash.xxh3_128_digest(data[a - lo : b - lo + length] + mark + (at - a).to_bytes(4, "little"))
                    out.append((k1, k2, lo, c, a, b, _name(core[:quarter] + mark), _name(core[quarter:half]), _name(core[half:]), full))
                if len(out) > 20_000:
                    yield _columns(out, _SLAB)
                    out = []
            yield _columns(out, _SLAB)

    return run


def _cut_windows(length: int):
    """The ranks r0, r1, r2 of both quarters of the first half and of the second half of every window of the open slabs."""
    quarter, half = length // 4, length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, lo, data, slabs in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for s in slabs:
                    for w in range(s["lo"] - lo, s["hi"] - lo + 1):
                        out.append((k1, k2, _name(data[w : w + quarter]), _name(data[w + quarter : w + half]), _name(data[w + half : w + length]), s["c"], lo + w))
                if len(out) > 20_000:
                    yield _columns(out, _WINDOW)
                    out = []
            yield _columns(out, _WINDOW)

    return run


def _cut_pieces(passage: int, length: int):
    """From texts and the windows of `passage` bytes that are repeated: the stretches of `length` bytes and more that
    such windows cover without a gap between their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k1, k2, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                text = text.as_py()
                for a, b in merged([(r["lo"], r["hi"] + 1) for r in ranges.as_py()]):
                    if b - 1 + passage - a < length:
                        continue
                    data = text[a : b - 1 + passage]
                    key = xxhash.xxh3_128_digest(data)
                    out.append((k1, k2, a, *(int.from_bytes(key[k : k + 8], "little", signed=True) for k in (0, 8)), data))
                    size += len(data)
                    if size > 4 << 20:
                        yield _columns(out, _PIECE)
                        out, size = [], 0
            yield _columns(out, _PIECE)

    return run


def _row_key(id_col: str, text_col: str):
    """Two hashes that name a row: rows that repeat an id and its text share one name and one result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("k2")


_TWO = ["k1", "k2"]


def _shared(rows: DataFrame, ranks: list[str], shared, name: str, used: list[DataFrame]) -> DataFrame:
    """The rows whose ranks others have too; shared: the condition, as an aggregate. The shared ranks are a table of their own,
    so that the join of a hot rank may be split."""
    keys = materialize(rows.groupBy(*ranks).agg(shared.alias("s")).where("s").drop("s"), f"{name}-ranks")
    used.append(keys)
    return rows.join(keys, ranks)


def _mapped(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    return df.mapInArrow(worker.tasks_of("suffixdup", run), schema)


def repeated_spans(docs: DataFrame, length: int, slab: int = SLAB) -> DataFrame:
    """From texts (k1, k2, c, text), each of which stands for c equal ones: (k1, k2, lo, hi), windows lo to hi of this text are
    repeated somewhere. Windows are strings of `length` bytes, by their start; the rows of one text may overlap and come
    in any order. Keys that are repeated have equal texts."""
    spark = docs.sparkSession
    gram, slab = max(1, length // 4), max(1, min(slab, length // 2))
    several = F.count("*") > 1
    used: list[DataFrame] = []

    def held(df: DataFrame, name: str) -> DataFrame:
        used.append(materialize(df, name))
        return used[-1]

    def done() -> None:
        drop_table(*used)
        used.clear()
        release(spark)

    # Grams. Segments of unique grams go.
    found = held(_mapped(docs.select(*_TWO, F.col("c").cast("int"), "text"), _find_segments(length, gram), _SEGMENT), "segments")
    release(spark)
    repeated = _shared(found.where("h is not null"), ["h"], F.sum("n") > 1, "grams", used)
    left = materialize(repeated.select(*found.columns).unionByName(found.where("h is null")), "repeated-grams")
    done()

    # Whole segments.
    spans = [materialize(left.where("h is null").select(*_TWO, "lo", "hi"), "spans")]
    left = left.where("h is not null")
    used.append(left)
    classes = held(left.groupBy("h", "ctx").agg(F.sum("n").cast("int").alias("c"), F.min(F.struct("k1", "k2", "lo", "hi", "at")).alias("p")), "segment-classes")
    spans.append(materialize(left.join(classes.where("c > 1").select("h", "ctx"), ["h", "ctx"]).select(*_TWO, "lo", "hi"), "spans"))
    open_classes = _shared(classes, ["h"], several, "open-grams", used)
    wanted = open_classes.groupBy("p.k1", "p.k2").agg(F.collect_list(F.struct("c", "p.lo", "p.hi", "p.at")).alias("places"))
    contexts = materialize(_mapped(docs.join(wanted, _TWO).dropDuplicates(_TWO).select(*_TWO, "text", "places"), _cut_contexts(length), _CONTEXT), "open-segments")
    done()

    # Slabs.
    slabs = held(_mapped(contexts, _cut_slabs(length, slab), _SLAB), "slabs")
    fulls = held(slabs.groupBy("r0", "r1", "r2", "full").agg(F.sum("c").cast("int").alias("c"), F.min(F.struct("k1", "k2", "base", "lo", "hi")).alias("p")), "slab-classes")
    spans.append(materialize(slabs.where("c = 1").join(fulls.where("c > 1").select("full", "r2"), ["full", "r2"]).select(*_TWO, "lo", "hi"), "spans"))
    halves = held(_shared(fulls, ["r0", "r1"], several, "half-slabs", used).select(F.xxhash64("r0", "r1").alias("r"), "r2", "c", "p"), "slab-halves")
    whole = _shared(halves, ["r", "r2"], several, "whole-slabs", used)
    open_slabs = materialize(whole.groupBy("p.k1", "p.k2", F.col("p.base").alias("lo")).agg(F.collect_list(F.struct("p.lo", "p.hi", "c")).alias("slabs")), "open-slabs")
    done()

    # Windows.
    windows = held(_mapped(contexts.join(open_slabs, [*_TWO, "lo"]).select(*_TWO, "lo", "data", "slabs"), _cut_windows(length), _WINDOW), "windows")
    used += [contexts, open_slabs]
    halves = held(_shared(windows, ["r0", "r1"], F.sum("c") > 1, "half-windows", used).select(F.xxhash64("r0", "r1").alias("r"), "r2", "c", *_TWO, "lo"), "window-halves")
    twice = held(halves.groupBy("r", "r2").agg((F.sum("c") > 1).alias("s")).where("s").drop("s"), "whole-windows")
    spans.append(materialize(halves.where("c = 1").join(twice, ["r", "r2"]).select(*_TWO, "lo", F.col("lo").alias("hi")), "spans"))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    out = materialize(out.groupBy(*_TWO).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "repeated-spans")
    used += spans
    done()
    return out


def remove_repeats(df: DataFrame, length: int = LENGTH, passage: int | None = None, slab: int = SLAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: (id_col, n_bytes, n_removed, spans array<struct<start, end>>, kept binary, passages like spans).

    Each byte of the UTF-8 text is removed that is covered by a string of `length` bytes which also starts at
    another place, of any text or the same one; strings never cross texts and are judged on the input. passages are what
    such strings of `passage` bytes cover (at most `length`; 5/8 of it, if not given); they are told, not removed. A null text
    counts as empty; texts shorter than `length` stay whole. Null ids are ids like others; rows that repeat an id
    and its text are two rows, so each repeats the other. What is kept may end inside a character, so it is
    binary. An empty table gives no rows. Other columns are not looked at.
    """
    passage = passage or max(1, length * 5 // 8)
    if passage > length:
        raise ValueError("a passage is no longer than what is removed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(*_row_key(id_col, text_col), text.alias("text"))
    found = repeated_spans(docs.withColumn("c", F.lit(1)), passage, slab)
    pieces = materialize(_mapped(docs.join(found, _TWO).select(*_TWO, "text", "ranges"), _cut_pieces(passage, length), _PIECE), "pieces")
    release(df.sparkSession)
    distinct = materialize(pieces.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("c"), F.first("data").alias("text")), "distinct-pieces")
    longer = repeated_spans(distinct, length, slab).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "ranges")
    inside = pieces.select(*_TWO, "start", "p1", "p2").join(longer, ["p1", "p2"]).select(*_TWO, F.struct("start", "ranges").alias("piece"))
    inside = inside.groupBy(*_TWO).agg(F.collect_set("piece").alias("pieces"))
    spans = materialize(found.join(inside, _TWO, "left"), "spans")
    drop_table(found, pieces, distinct, longer)
    release(df.sparkSession)

    docs = df.select(F.col(id_col), *_row_key(id_col, text_col), text.alias("sd_text"))
    span = T.ArrayType(T.StructType([T.StructField("start", _INT), T.StructField("end", _INT)]))
    schema = T.StructType([df.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType()), T.StructField("passages", span)])
    as_spans = lambda found: [{"start": a, "end": b} for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc, text, ranges, pieces in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
                text = text.as_py()
                known = merged([(r["lo"], r["hi"] + passage) for r in ranges.as_py() or ()])
                gone = merged([(p["start"] + r["lo"], p["start"] + r["hi"] + length) for p in pieces.as_py() or () for r in p["ranges"]])
                kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True))
                out.append((doc, len(text), len(text) - len(kept), as_spans(gone), kept, as_spans(known)))
                size += len(kept)
                if size > 8 << 20:
                    yield _columns(out, schema)
                    out, size = [], 0
            yield _columns(out, schema)

    return _mapped(docs.join(spans, _TWO, "left").select(id_col, "sd_text", "ranges", "pieces"), run, schema)
