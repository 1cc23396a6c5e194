import re

import corpus_pipeline
from lacework.llm import queries
from tests.llm.test_dedup import brute_near, norm

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tokenizer_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x.text for x in at.select("doc_id", "text").collect()}
        at = stage(spark, at, SF).cache()
        kept[name] = (before, {x.doc_id for x in at.select("doc_id").collect()})
        assert at.count() == len(kept[name][1]) and kept[name][1] <= set(before)
        assert name == "encode" or at.columns == columns
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    _, left = kept["quality"]
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in good) >= 0.98 * len(good)
    before, left = kept["exact"]
    least = {}
    for i, t in before.items():
        least[norm(t)] = min(i, least.get(norm(t), i))
    assert left == set(least.values())
    before, left = kept["near"]
    assert left == {int(i) for i, _, _, k in brute_near(sorted(before.items()), 5) if k}
    before, left = kept["encode"]
    assert left == set(before)
    for x in at.collect():
        assert x.ids == library.encode(before[x.doc_id], add_special_tokens=False).ids and x.n_tokens == len(x.ids)
    assert {tuple(sorted(x.asDict().items(), key=lambda kv: kv[0]))[0] for x in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {("doc_id", i) for i in left}


def test_queries_are_named():
    numbers = [m and m[1] for m in (re.match(r"op(\d+)_", n) for n in queries.QUERIES)]
    assert sorted(n for n in numbers if n) == sorted(str(n) for n in range(1, 11))  # one each
    assert [n for n, k in zip(queries.QUERIES, numbers, strict=True) if not k] == ["quality_ablations"]


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    at = odd
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = at.columns
        at = stage(spark, at, SF).cache()
        counts.append(at.count())
        assert name == "encode" or at.columns == before
    # The classifier may reject odd texts; exact and near duplicates go, mixing takes leaves whole or in part.
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    assert len({x.ids_ for x in at.selectExpr("array_join(cast(ids as array<string>), ',') as ids_").collect()}) == counts[-1]
    at = empty
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).cache()
        assert at.count() == 0
