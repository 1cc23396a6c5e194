"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token there is exactly one token that can end the encoding of that
prefix. An automaton over the vocabulary gives, at each position, all tokens that are a suffix of
the prefix; the one that is *compatible* with the last token of what stands before it is stored.
Following the stored tokens back from the end yields the exact ids, in time linear in the text,
without ever running the merge loop.

Two tokens are compatible when merging their joined bytes gives the same two tokens again. The
test undoes the merges of both tokens from the youngest to the oldest and looks whether a merge
across the border would have come first; its answers are remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lacework.llm import worker

#: Fixed pattern of byte-level pre-tokens (as published with this kind of vocabulary).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank before a visible character always starts a pre-token, so texts fall into independent chunks there.
BORDER = re.compile(r" (?=\S)")
#: Bytes of the tables of pairs and of pieces that a worker remembers; most words come once, so smaller tables cost much time.
REMEMBERED = 160 << 20
#: Longer chunks are not remembered.
LONGEST_KEPT = 48


#: The same blanks, and no fewer, in the syntax of Arrow's regular expressions, whose \\s is narrower.
LOOSE_ARROW = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"


def by_pieces(texts: pa.Array, ids_of: Callable[[list[str], list[str]], tuple[list[bytes], list[bytes]]]) -> list[np.ndarray]:
    """The ids of each text (nulls count as empty), from those of its different pieces. Texts fall into pieces at the blanks
    where that is safe; ids_of(heads, words) gives the ids, as bytes, of pieces that start a text and of those with a blank
    before them."""
    texts = pc.fill_null(texts, "")
    loose = pc.match_substring_regex(texts, LOOSE_ARROW).to_numpy(zero_copy_only=False)
    out: list[np.ndarray] = [_NO_IDS] * len(texts)
    for places, split in ((np.flatnonzero(~loose), lambda x: pc.split_pattern(x, " ")), (np.flatnonzero(loose), lambda x: pa.array([BORDER.split(t) for t in x.to_pylist()], pa.list_(pa.string())))):
        if not len(places):
            continue
        lists = split(texts.take(pa.array(places)))
        offsets, coded = lists.offsets.to_numpy(), pc.dictionary_encode(lists.flatten())
        codes, vocab = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        heads, words = (np.flatnonzero(np.bincount(codes[x], minlength=len(vocab))) for x in (first, ~first))
        known = list(chain.from_iterable(ids_of([vocab[k] for k in heads], [vocab[k] for k in words])))
        pool, size = np.frombuffer(b"".join(known), "<i4"), np.fromiter(map(len, known), np.int32, len(known)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        entry = np.zeros((2, len(vocab)), np.int32)
        entry[0, words], entry[1, heads] = np.arange(len(words)) + len(heads), np.arange(len(heads))
        entry = entry[first.astype(np.int8), codes]
        n = size[entry]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(start[entry] - ends + n, n)
        at += np.arange(len(at), dtype=np.int32)
        ids = pool[at]
        cut = np.concatenate([[0], ends])[offsets].tolist()
        for k, a, b in zip(places.tolist(), cut, cut[1:]):
            out[k] = ids[a:b]
    return out


_NO_IDS = np.empty(0, "<i4")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixBpe:
    """A byte-level BPE vocabulary in the JSON format of the public tokenizers library."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(alphabet[c] for c in token)
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.age = list(range(size))  # of bytes: below every merge
        self.joined: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.joined[left, right] = whole
            if self.halves[whole] is None:
                self.halves[whole], self.age[whole] = (left, right), rank
        for k in range(size):
            if self.halves[k] is None:
                self.age[k] = -1
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        for content, k in self.added.items():
            self.bytes_of[k] = content.encode()
        self.pretoken = regex.compile(PRETOKEN)
        self.suffixes = ahocorasick.Automaton()
        for k in vocab.values():
            self.suffixes.add_word(self.bytes_of[k].decode("latin-1"), (len(self.bytes_of[k]), k))
        self.suffixes.make_automaton()
        self.pairs = worker.Remembered(remembered // 10 * 3)
        self.single = {self.bytes_of[k]: k for k in vocab.values() if self.halves[k] is None}
        self.first, self.inner = worker.Remembered(remembered // 20), worker.Remembered(remembered // 20 * 13)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of bytes(left) + bytes(right) is [left, right]."""
        joined, halves, age = self.joined, self.halves, self.age
        a, b, before = left, right, len(age)  # merges of at least this rank come too late
        while True:
            whole = joined.get((a, b))
            if whole is not None and age[whole] < before:
                return False
            # Undo the younger of the two border pieces; of equals, the left piece was made first.
            if age[a] > age[b]:
                before, a = age[a], halves[a][1]
            elif age[b] >= 0:
                before, b = age[b] + 1, halves[b][0]
            else:
                return True

    def encode_pretoken(self, piece: bytes) -> list[int]:
        if len(piece) == 1:
            return [self.single[piece]]
        n = len(piece)
        last = [-1] * (n + 1)  # the token that ends the prefix of this length
        pairs, test, bytes_of = self.pairs, self.compatible, self.bytes_of
        for end, (size, token) in self.suffixes.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start == 0:
                last[end] = token  # a token is its own encoding: its merges make it from its bytes
                continue
            before = last[start]
            key = before << 32 | token
            fits = pairs.get(key)
            if fits is None:
                fits = test(before, token)
                pairs.keep(key, fits, 0)
            if fits:
                last[end] = token
        ids = []
        while n:
            token = last[n]
            ids.append(token)
            n -= len(bytes_of[token])
        ids.reverse()
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        return np.fromiter(chain.from_iterable(self.encode_pretoken(x.encode()) for x in self.pretoken.findall(chunk)), "<i4").tobytes()

    def _ids_of(self, heads: list[str], words: list[str]) -> tuple[list[bytes], list[bytes]]:
        first, inner = self.first, self.inner
        return [first.get(x) or self._keep(first, x, self.encode_chunk(x)) for x in heads], [inner.get(x) or self._keep(inner, x, self.encode_chunk(" " + x)) for x in words]

    @staticmethod
    def _keep(cache: worker.Remembered, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= LONGEST_KEPT:
            cache.keep(chunk, ids, len(chunk) + len(ids))
        return ids

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each whole text; strings of added tokens become their ids."""
        out = by_pieces(texts, self._ids_of)
        if self.added:
            found = pc.match_substring_regex(texts, "|".join(map(re.escape, self.added))).to_pylist()
            for k in (k for k, x in enumerate(found) if x):
                parts = [x for x in self.added_split.split(texts[k].as_py()) if x]
                out[k] = np.concatenate([np.array([self.added[x]], "<i4") if x in self.added else by_pieces(pa.array([x]), self._ids_of)[0] for x in parts])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; added tokens give their own strings, bytes that are not UTF-8 U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[tuple[str, int], PrefixBpe] = {}
worker.forgets(_LOADED.clear)


def vocabulary(path: str, remembered: int = REMEMBERED) -> PrefixBpe:
    """The vocabulary, loaded once by a worker; only one is kept."""
    if (path, remembered) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, remembered] = PrefixBpe(path, remembered)
        worker.trim()  # what parsing took
    return _LOADED[path, remembered]


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """One row for each row of df: (id_col, ids array<int>[, decoded string]). remembered: bytes of a worker's tables,
    which change how long it takes, not what it gives.

    A null text counts as empty and gives no ids and the empty string; a null id stays null. Repeated
    rows give repeated rows, other columns of df are not looked at. Texts of any length are encoded
    whole; a worker keeps bounded tables of chunks and pairs besides the batch it works on. There is
    no shuffle: rows are encoded where they are read.
    """
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("decoded", T.StringType())] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer_path, remembered)
        for batch in batches:
            for part in slices(batch, remembered // 40):
                ids = bpe.encode_all(part.column(1))
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.empty(0, np.int32)]))]
                if decode:
                    columns.append(pa.array(map(bpe.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(id_col, text_col).mapInArrow(worker.tasks_of("bpe", run), schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts with texts (its second column) of about `most` bytes at most, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
