import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lacework.llm import exactdup, graph, neardup, suffixdup
from tests.llm.conftest import ODD_TEXTS


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((str(i), str(least[norm(t)]), len(groups[norm(t)]), i == least[norm(t)]) for i, t in rows)


@pytest.mark.parametrize("kind", ["sha", "weak", "spilled"])
def test_exact(spark, odd, empty, kind):
    digest = exactdup.sha256_digest if kind != "weak" else (lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 32, "0")))
    size = 300 if kind == "spilled" else exactdup.TABLE_BYTES
    rows = exactdup.exact_groups(odd, digest=digest, table_bytes=size).collect()
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.kept) for x in rows) == brute_exact(ODD_TEXTS)
    kept = exactdup.exact_dedup(odd, digest=digest, table_bytes=size)
    assert kept.columns == odd.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(i for i, _, _, k in brute_exact(ODD_TEXTS) if k)
    assert exactdup.exact_groups(empty).count() == 0 == exactdup.exact_dedup(empty).count()


@pytest.mark.parametrize("kind", ["sha", "weak"])
def test_exact_keeps_one_row_of_a_text(spark, odd, empty, kind):
    digest = exactdup.sha256_digest if kind == "sha" else (lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 32, "0")))
    kept = exactdup.exact_dedup(odd, digest=digest, one_row=True)
    least = {}
    for i, t in ODD_TEXTS:
        least[norm(t)] = min((x for x in (i, least.get(norm(t))) if x is not None), default=None)
    assert kept.columns == odd.columns
    assert sorted((norm(x.text), str(x.doc_id)) for x in kept.collect()) == sorted((t, str(i)) for t, i in least.items())
    assert exactdup.exact_dedup(empty, one_row=True).count() == 0
    rows = docs(spark, [(None, "hot key")] * 500 + [(7, "seven")] * 3 + [(8, "eight"), (9, "eight")])
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["exact"]
    assert sorted((str(x.doc_id), x.text) for x in stage(spark, rows, "").collect()) == [("7", "seven"), ("8", "eight"), ("None", "hot key")]


def test_grace_splits_and_keeps_collisions_apart():
    r = random.Random(1)
    records = [(bytes([r.randrange(256) for _ in range(2)]) * 8, str(r.randrange(400)).encode(), k, 1) for k in range(3000)]
    want = defaultdict(list)
    for d, c, i, _ in records:
        want[d, c].append(i)
    found = list(exactdup.grace(iter(records), 2000))
    assert {(d, c): (a, n) for d, c, a, n, _ in found} == {k: (min(v), len(v)) for k, v in want.items()} and len(found) == len(want)
    several = Counter(d for d, _ in want)
    assert all(shared == (several[d] > 1) for d, _, _, _, shared in found)


@pytest.mark.parametrize("last", [0, 10, 10**6])
def test_components(spark, last):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7)]
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    found = graph.components(spark.createDataFrame(links, "a long, b long"), last).collect()
    of = {x.node: x.component for x in found}
    assert set(of) == set(above) and len(found) == len(of)
    assert len({(root(x), of[x]) for x in of}) == len({root(x) for x in of}) == len(set(of.values()))


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_near(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) or (rows[a][0] is not None and rows[a] == rows[b]):
                comp[root(a)] = root(b)
    least = {}
    for k_, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k_)] = min(i, least.get(root(k_), i))
    out = []
    for k_, (i, _) in enumerate(rows):
        c = least.get(root(k_)) if sets[k_] else i
        out.append((str(i), len(sets[k_]), str(c), i == c))
    return sorted(out)


@pytest.mark.parametrize("words", [2, 5])
def test_near(spark, odd, empty, words):
    r = random.Random(words)
    rows = []
    for f in range(6):  # families in which copies differ from one original, so that many pairs of copies fall short
        base = [f"w{f}x{r.randrange(10**6)}" for _ in range(80)]
        for _ in range(12):
            own = base[:]
            for _ in range(r.randrange(0, 7)):
                own[r.randrange(80)] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), rows[3][1].upper()), (len(rows) + 1, rows[3][1].replace(" ", "\n"))]
    found = neardup.near_dup_components(docs(spark, rows), words, block_elements=200).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in found) == brute_near(rows, words)
    found = neardup.near_dup_components(odd, words).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in found) == brute_near(ODD_TEXTS, words)
    assert neardup.near_dup_components(empty, words).count() == 0


def test_near_dedup_rows(spark, odd):
    kept = neardup.near_dedup(odd, 2)
    assert kept.columns == odd.columns
    ids = {x.doc_id for x in kept.collect()}
    assert {1, 2, 3, 6, 9, 10, 11} <= ids and not {7, 8} & ids


def test_near_dedup_keeps_one_row_of_a_component(spark):
    r = random.Random(20)
    text = [" ".join(f"w{r.randrange(10**6)}" for _ in range(100)) for _ in range(6)]
    near = lambda k, more: text[k] + f" {more}"
    rows = [(1, text[0]), (None, near(0, "a")), (None, text[1])]  # a kept row without an id doesn't bring back others
    rows += [(2, text[2]), (3, text[3]), (2, near(3, "b")), (3, near(2, "c"))]  # ids with a text of either component
    rows += [(None, text[4]), (None, text[4]), (None, near(4, "d")), (5, text[5]), (5, text[5]), (5, near(5, "e"))]
    rows += [(None, ""), (6, " ")]
    kept = sorted(((str(x.doc_id), x.text[:20]) for x in neardup.near_dedup(docs(spark, rows)).collect()))
    want = [(1, text[0]), (None, text[1]), (2, text[2]), (2, text[3]), (None, text[4]), (5, text[5]), (None, ""), (6, " ")]
    assert kept == sorted((str(i), t[:20]) for i, t in want)


def test_sketches():
    import numpy as np

    r = np.random.default_rng(4)
    for n in (1, 2, 9, 300):
        s = r.integers(0, 2**63, n).astype(np.uint64)
        a = neardup.sketch(np.unique(s), 220)
        assert a.max() < np.iinfo(np.uint64).max and len(a) == 220  # every bin is filled
        assert a.tolist() == neardup.sketch(np.unique(np.concatenate([s, s])), 220).tolist()
    base = r.integers(0, 2**63, 1000).astype(np.uint64)
    other = np.concatenate([base[:900], r.integers(0, 2**63, 100).astype(np.uint64)])
    share = (neardup.sketch(np.unique(base), 2200) == neardup.sketch(np.unique(other), 2200)).mean()
    assert abs(share - 900 / 1100) < 0.05


def test_near_links_join_what_is_near():
    import numpy as np

    r = np.random.default_rng(5)
    for n in (2, 30, 90):
        base = r.integers(0, 256, (4, 64), np.uint8)
        sketches = base[r.integers(0, 4, n)].copy()
        sketches[r.random((n, 64)) < 0.25] = 7
        names = [bytes([k]) for k in range(n)]
        queries = [k for k in range(n) if k % 3 == 0]
        found = neardup.near_links(names, sketches, queries, list(range(n)), 36)
        near = [(names[q], names[m]) for q in queries for m in range(n) if q != m and (sketches[q] == sketches[m]).sum() >= 36]
        assert set(found) <= set(near) and len(found) < n

        def joined(links):
            at = {x: x for x in names}
            for a, b in links:
                old, new = at[a], at[b]
                at = {x: new if y == old else y for x, y in at.items()}
            return {frozenset(x for x in names if at[x] == y) for y in at.values()}

        assert joined(found) == joined(near)
    # A pair of similarity 0.8 is far above the bound, one of 0.3 far below.
    assert 100 < neardup.least_equal(220, 80) < 140 and neardup.least_equal(220, 100) == 220 and neardup.least_equal(1, 80) == 1


def brute_spans(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 37])
def test_repeats(spark, odd, empty, chunk, monkeypatch):
    r = random.Random(chunk)
    passages = ["".join(r.choices("abcde é", k=90)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = ["".join(r.choices("abcdefgh ", k=r.randrange(60))) for _ in range(4)]
        for _ in range(r.randrange(3)):
            p = list(r.choice(passages))
            if r.random() < 0.5:
                p[r.randrange(90)] = "#"
            parts.insert(r.randrange(4), "".join(p))
        rows.append((i, "".join(parts)))
    rows += [(60, "a" * 200), (61, "ab" * 90 + "c" + "ab" * 40), (62, rows[5][1]), (62, rows[5][1]), (63, None)]
    if chunk < 1000:  # segments of long texts are found chunk by chunk
        text = rows[61][1].encode() + rows[7][1].encode() * 2
        monkeypatch.setattr(suffixdup, "CHUNK", chunk)
        cut = list(suffixdup.segments(text, 40, 16))
        assert [w for _, lo, hi, _ in cut for w in range(lo, hi + 1)] == list(range(len(text) - 39))
        monkeypatch.setattr(suffixdup, "CHUNK", 1 << 20)
        whole = list(suffixdup.segments(text, 40, 16))
        of = lambda s: [(h, at - w) for h, lo, hi, at in s for w in range(lo, hi + 1)]
        assert of(cut) == of(whole)
        return
    found = suffixdup.remove_repeats(docs(spark, rows), 40, slab=8).collect()
    passages = brute_spans([(t or "").encode() for _, t in rows], 25)
    assert sorted((str(x.doc_id), x.n_bytes, sum(p.end - p.start for p in x.passages), len(x.passages)) for x in found) == sorted((str(i), *w[:3]) for (i, _), w in zip(rows, passages))
    want = brute_spans([(t or "").encode() for _, t in rows], 40)
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in found) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    found = suffixdup.remove_repeats(odd, 40).collect()
    want = brute_spans([(t or "").encode() for _, t in ODD_TEXTS], 40)
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in found) == sorted((str(i), *w) for (i, _), w in zip(ODD_TEXTS, want))
    assert suffixdup.remove_repeats(empty).count() == 0
