import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "One"), (None, "a null id"), (None, "a null id"), (None, None),
    (6, "the quick brown fox jumps over the lazy dog " * 3), (7, "the quick brown fox jumps over the lazy dog " * 3), (8, "the  quick brown\tfox jumps over the lazy dog " * 3),
    (9, "é漢字🙂 " * 700), (10, "x" * 30_000), (4, "another text under the same id"), (11, "word " * 20_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns with the names that operators use inside."""
    extra = ["node", "family", "row", "ids", "kept", "xd_key", "nd_keep", "q_id", "mx_l0", "k1", "lang", "source", "good.bad"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(x, T.StringType()) for x in extra])
    return spark.createDataFrame([(i, t, *[None if k % 3 else "x"] * len(extra)) for k, (i, t) in enumerate(ODD_TEXTS)], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
