import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lacework.llm import bpe, queries, tokenfile
from tests.llm.conftest import ODD_TEXTS

PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "漢", "字", "🙂", "\x1c", "\x85", "\xa0", "　", "'s", "'re", "1", "23", "²", "Ⅷ", "_", "-", "<|endoftext|>", "the", "ing", " the", "\r", "\x00", "١", "​", "word.", "<|", "|>"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return ["".join(r.choices(PIECES, k=r.randint(0, 30))) for _ in range(3000)] + ["a" * 3000, " " * 2000, "ab" * 900, "x" * 60 + " " + "y" * 70 + ".", ""]


@pytest.fixture(scope="module")
def library(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


def test_encoding_is_the_librarys(texts, library, tokenizer_path):
    own = bpe.PrefixBpe(tokenizer_path)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        found = own.encode(t)
        assert found.tolist() == ids, t
        assert own.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_every_token_encodes_itself(tokenizer_path):
    own = bpe.PrefixBpe(tokenizer_path)
    assert all(own.encode_pretoken(own.bytes_of[k]) == [k] for k in range(0, 50256, 7))


def test_decoding_broken_utf8(library, tokenizer_path):
    own = bpe.PrefixBpe(tokenizer_path)
    r = random.Random(9)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(6)]
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_op1_rows(spark, odd, empty, library, tokenizer_path):
    rows = bpe.encode_decode(odd, tokenizer_path).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in ODD_TEXTS)
    assert sorted((str(x.doc_id), x.ids, x.decoded) for x in rows) == want
    assert bpe.encode_decode(empty, tokenizer_path).count() == 0


def test_library_encoder_forgets_and_stays_exact(texts, library, tokenizer_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "KEPT_CHUNKS", 500)
    encoder = tokenfile.LibraryEncoder(tokenizer_path)
    for k in range(0, len(texts), 40):
        for t, ids in zip(texts[k : k + 40], encoder.encode_all(pa.array(texts[k : k + 40]))):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("top", [1, 255, 256, 65536, 2**32])
def test_segment_round_trip_and_random_access(top):
    r = np.random.default_rng(top)
    ids = [r.integers(0, top, n).astype(np.uint32) for n in (0, 1, 700, 3000)]
    s = tokenfile.Segment(tokenfile.pack_segment([None, 5, 5, -9], ids))
    flat = np.concatenate(ids)
    assert s.all_ids().tolist() == flat.tolist() and s.n_ids == len(flat)
    assert [s.get(i) for i in range(0, len(flat), 37)] == flat[::37].tolist()
    assert [(d, at, x.tolist()) for d, at, x in s.documents()] == [(d, at, x.tolist()) for d, at, x in zip([None, 5, 5, -9], [0, 0, 1, 701], ids)]
    with pytest.raises(IndexError):
        s.get(len(flat))


def test_damaged_segment():
    data = bytearray(tokenfile.pack_segment([1], [np.array([1, 2, 300], np.uint32)]))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        tokenfile.Segment(bytes(data))
    assert tokenfile.Segment(tokenfile.pack_segment([], [])).all_ids().tolist() == []


def test_op10_rows(spark, odd, empty, library, tokenizer_path):
    rows = tokenfile.token_output(odd, tokenizer_path, with_ids=True).collect()
    rows.sort(key=lambda x: x.start)
    keys = [-1 if x.doc_id is None else x.doc_id for x in rows]
    assert keys == sorted(keys) and len(rows) == len(ODD_TEXTS)
    at = 0
    for x in rows:
        assert x.start == at and x.n_tokens == len(x.ids) and x.ids[-1] == 2
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        at += x.n_tokens
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ODD_TEXTS)
    assert sorted((str(x.doc_id), x.ids) for x in rows) == want
    assert tokenfile.token_output(empty, tokenizer_path).count() == 0


def test_tokens_are_addressed_in_the_files(spark, texts, library, tokenizer_path, tmp_path):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    tokenfile.write_token_files(df, f"file://{tmp_path}/t", tokenizer_path, shards=3, segment_ids=4000)
    flat = [i for t in texts for i in library.encode(t, add_special_tokens=False).ids + [2]]
    files = tokenfile.TokenFiles(f"file://{tmp_path}/t")
    assert len(files) == len(flat) and len(files.files) > 3
    (tmp_path / "t/segments/000000-000000-left-over.dac").write_bytes(b"of an attempt that failed")
    places = sorted({0, len(flat) - 1, *files.ends[:-1], *(x - 1 for x in files.ends), *range(0, len(flat), max(1, len(flat) // 150))})
    for i in places:
        before = files.bytes_read
        assert files.token_at(i) == flat[i]
        levels = max(1, (flat[i].bit_length() + 7) // 8)
        assert files.bytes_read - before == tokenfile.HEAD_BYTES + levels * tokenfile.BLOCK.itemsize
    for i in (-1, len(flat)):
        with pytest.raises(IndexError):
            files.token_at(i)
    got = sorted(tokenfile.read_token_files(spark, f"file://{tmp_path}/t").collect(), key=lambda x: x.start)
    assert [i for x in got for i in x.ids] == flat and [x.doc_id for x in got] == list(range(len(texts)))


def test_op1_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in queries.op1_bpe(spark, sf).collect():
        ids = library.encode(texts[x.doc_id], add_special_tokens=False).ids
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()
