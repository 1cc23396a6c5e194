"""Near-duplicate documents: fast similarity sketches, banding, and verification on full sets.

Sketch. A sketch has t bins. In round i every element of a set goes to a bin chosen by a hash for that
round, with a value that starts with i; in rounds t to 2t - 1 all elements go to bin i - t. A bin keeps its
least value. So no bin can stay empty, a set of n elements needs about t ln t / n rounds, and the share of
equal bins estimates the Jaccard similarity with the concentration of t independent samples.

Banding. Bins are grouped into bands; documents that agree on a whole band are candidates. With 44 bands
of 5, a pair of similarity 0.8 is missed with probability 2.6e-8.

Verification, without all pairs of a bucket:

1. Documents with equal sets are one node. A node carries its sketch, a byte a bin.
2. In each bucket the node that shares most with others is the pivot. Every node is compared with it by their sketches:
   a pair of the asked similarity agrees on fewer bins than NEAR_SPREADS standard deviations below the mean only with a
   probability below 1e-12, so a pair below that isn't linked. Nodes that aren't near the pivot are compared with the
   other nodes of the bucket in the same way, in blocks; only links that join something new are kept.
3. Nodes that are near each other make families: documents of chance buckets fall out here, so that families don't grow
   together as tables grow. Each node is compared with the pivot that it shares most buckets with, on full sets. Inside a
   family, links are still open only between nodes that this didn't connect: all nodes outside the family's largest
   component are queries against the whole family, in blocks of bounded size, counted exactly over an inverted index.

So every pair of candidates that isn't connected already is decided by its full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacework.llm import worker
from lacework.llm.common import drop_table, materialize, packed, text_or_empty
from lacework.llm.graph import components

BANDS, BAND_BINS = 44, 5
#: Elements of the sets in a block of a family, about.
BLOCK_ELEMENTS = 300_000
#: Nodes of a block of a bucket.
BLOCK_NODES = 2000
#: Standard deviations below the mean of equal bins at which a pair isn't looked at any more.
NEAR_SPREADS = 8.0
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finisher of a public generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(worker.Remembered):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self.keep(word, h, len(word) + 60)
        return h


_HASHES = _WordHashes(worker.BUDGET // 2)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text, A-Z lower-cased; of a text with fewer words
    the whole sequence is the one shingle, of one without words the set is empty."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, _U)
    h = np.fromiter(map(_HASHES.__getitem__, found), _U, len(found))
    width = min(words, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - width + 1, width, _U)
        for j in range(width):
            total = mix(total * _U(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return np.unique(total)


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of a set that isn't empty. Rounds beyond those needed change nothing, so
    small sets do several at once."""
    out = np.full(bins, np.iinfo(np.uint64).max, _U)
    at_once = max(1, -(-6 * bins // len(elements)))
    i = 0
    while i < 2 * bins and out.max() == np.iinfo(np.uint64).max:
        rounds = np.arange(i, min(2 * bins, i + at_once), dtype=np.uint64)[:, None]
        with np.errstate(over="ignore"):
            h = mix(elements[None, :] ^ mix(rounds * _U(0xD1342543DE82EF95) + _U(1)))
        to = np.where(rounds < bins, ((h >> _U(32)) * _U(bins)) >> _U(32), np.maximum(rounds, _U(bins)) - _U(bins))
        np.minimum.at(out, to.ravel().astype(np.int64), ((rounds << _U(32)) | (h & _U(0xFFFFFFFF))).ravel())
        i += len(rounds)
    return out


def least_equal(bins: int, percent: int) -> int:
    """The bins on which a pair must agree to be near."""
    t = min(percent / 100, 1.0)
    return max(1, math.floor(bins * t - NEAR_SPREADS * math.sqrt(bins * t * (1 - t))))


def buckets(bins: np.ndarray, bands: int, band_bins: int) -> np.ndarray:
    """The bucket of each band of a sketch."""
    rows = bins.reshape(bands, band_bins)
    total = np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(band_bins):
            total = mix(total * _U(0x9E3779B97F4A7C15) + rows[:, j])
    return total.view(np.int64)


def signatures(df: DataFrame, words: int, bands: int, band_bins: int, id_col: str, text_col: str) -> DataFrame:
    """(nd_id, nd_row, nd_key, nd_n, node, nd_buckets, nd_sketch): id, id or else hash of the text, 128-bit hash of the text, set
    size, 128-bit hash of the set (null if it is empty), bucket of each band, a byte of each bin of the sketch."""
    schema = T.StructType([T.StructField("nd_id", T.LongType()), T.StructField("nd_row", T.LongType()), T.StructField("nd_key", T.BinaryType()), T.StructField("nd_n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("nd_buckets", T.ArrayType(T.LongType())), T.StructField("nd_sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, found, bytes_of = [], [], [], []
            for text in batch.column(3):
                s = shingle_set(text.as_py(), words)
                bins = sketch(s, bands * band_bins) if len(s) else None
                sizes.append(len(s))
                nodes.append(None if bins is None else xxhash.xxh3_128_digest(s.tobytes()))
                found.append(None if bins is None else buckets(bins, bands, band_bins))
                bytes_of.append(None if bins is None else bins.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(bytes_of, pa.binary())], names=schema.names)

    return df.select(F.col(id_col).cast("long").alias("nd_id"), _row_key(id_col, text_col).alias("nd_row"), _text_key(text_col).alias("nd_key"), F.col(text_col).alias("nd_text")).mapInArrow(worker.tasks_of("neardup", run), schema)


def _row_key(id_col: str, text_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))


def _text_key(text_col: str):
    return F.unhex(F.md5(text_or_empty(text_col)))


def _linked(n_both: np.ndarray, n_a, n_b, percent: int) -> np.ndarray:
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def _verify_pairs(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            a, b = [], []
            for node, pivot, text, pivot_text in zip(*batch.columns, strict=True):
                if pivot != last:
                    last, other = pivot, shingle_set(pivot_text.as_py(), words)
                own = shingle_set(text.as_py(), words)
                if _linked(np.intersect1d(own, other, assume_unique=True).size, own.size, other.size, percent):
                    a.append(node.as_py())
                    b.append(pivot.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    """A row of bytes for each value; all are of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _mark_near(least: int):
    """From (..., sketch, pivot_sketch): the other columns, and whether the two are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_sketches(batch.column(batch.num_columns - 2)) == _sketches(batch.column(batch.num_columns - 1))).sum(1) >= least
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(near)], names=[*batch.schema.names[:-2], "near"])

    return run


def near_links(names: list[bytes], sketches: np.ndarray, queries: list[int], members: list[int], least: int) -> list[tuple[bytes, bytes]]:
    """Links between near ones of queries and members, as few as join the same ones."""
    index = {x: k for k, x in enumerate(dict.fromkeys(names))}
    node = np.array([index[x] for x in names])
    group, against, out = np.arange(len(index)), sketches[members], []
    at = node[members]
    for q in queries:
        own = group[node[q]]
        hit = np.flatnonzero(((against == sketches[q]).sum(1) >= least) & (group[at] != own))
        if hit.size:
            other, first = np.unique(group[at[hit]], return_index=True)
            out += [(names[q], names[members[k]]) for k in hit[first]]
            group[np.isin(group, other)] = own
    return out


def _link_blocks(least: int):
    """From (bucket, m_block, q_block, query, node, sketch), sorted by the first three: the near links of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        a, b = [], []
        for _, block in groupby(rows, lambda x: x[:3]):
            _, _, _, query, names, sketches = zip(*block, strict=True)
            queries, members = [k for k, q in enumerate(query) if q], [k for k, q in enumerate(query) if not q]
            if queries and members:
                for x, y in near_links(list(names), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(names), -1), queries, members, least):
                    a.append(x)
                    b.append(y)
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def block_links(nodes: list[bytes], comps: list[bytes], sets: list[np.ndarray], queries: list[int], members: list[int], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between a query and a member that aren't in one component; the counts of common elements come from an
    inverted index over the members. Of several links to one component the first is enough."""
    number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    of = np.array([number[comps[m]] for m in members])
    sizes = np.array([len(sets[m]) for m in members])
    every = np.concatenate([sets[m] for m in members])
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(members)), sizes)[order]
    every = every[order]
    out = []
    for q in queries:
        lo, hi = np.searchsorted(every, sets[q], "left"), np.searchsorted(every, sets[q], "right")
        n = hi - lo
        # The places lo[k] .. hi[k] - 1 for all k, one after another.
        places = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        both = np.bincount(owner[places], minlength=len(members))
        hit = np.flatnonzero(_linked(both, sizes, len(sets[q]), percent) & (both > 0) & (of != number[comps[q]]))
        if hit.size:
            out += [(nodes[q], nodes[members[hit[k]]]) for k in np.unique(of[hit], return_index=True)[1]]
    return out


def near_dup_components(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, band_bins: int = BAND_BINS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """One row for each row of df: (id_col, n_shingles, component_id, kept).

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of word shingles.
    component_id is the smallest id reachable over links, kept whether it is the row's own. A null text counts
    as empty; a text without words has an empty set and is linked with nothing. Rows with a null id take part,
    but are never the smallest: component_id is null only if no id can be reached, and kept is then true. Rows
    that repeat an id and its text are one document. An empty table gives no rows. Other columns are not
    looked at. Ids are integers.
    """
    found = _components_of_rows(df, words, percent, id_col, text_col, bands, band_bins, block_elements)
    component = F.when(F.col("node").isNull(), F.col("nd_id")).otherwise(F.col("component_id"))
    return found.select(F.col("nd_id").alias(id_col), F.col("nd_n").alias("n_shingles"), component.alias("component_id"), F.col("nd_id").eqNullSafe(component).alias("kept"))


def _components_of_rows(df: DataFrame, words: int, percent: int, id_col: str, text_col: str, bands: int = BANDS, band_bins: int = BAND_BINS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """(nd_id, nd_key, nd_n, node, component, component_id) of each row of df: component is a node of it, component_id the
    least id in it; all three are null for a text without words."""
    rows = materialize(signatures(df, words, bands, band_bins, id_col, text_col), "signatures")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("nd_id").alias("least"), F.first("nd_n").alias("n"), F.first("nd_row").alias("w_row"), F.first("nd_buckets").alias("buckets"), F.first("nd_sketch").alias("sketch"))
    nodes = materialize(nodes, "nodes")
    links = _links(df, nodes, words, percent, id_col, text_col, block_elements)
    reached = components(links)
    drop_table(links)
    least = reached.join(nodes, "node").groupBy("component").agg(F.min("least").alias("comp_least"))
    least = reached.join(least, "component").select(F.col("node").alias("r_node"), "component", "comp_least")
    grouped = nodes.join(least, F.col("node") == F.col("r_node"), "left").select(F.col("node").alias("g_node"), F.coalesce("component", "node").alias("component"), F.coalesce("comp_least", "least").alias("component_id"))
    return rows.select("nd_id", "nd_key", "nd_n", "node").join(grouped, F.col("node") == F.col("g_node"), "left").drop("g_node")


def near_dedup(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component (see near_dup_components), all columns: one with the smallest id, or any if none has an
    id. Of rows that tie on that id, as of repeated rows, one stays. Rows of texts without words all stay."""
    found = _components_of_rows(df, words, percent, id_col, text_col)
    # A row is known by its id and its text, as ids may be null or name several texts.
    stay = found.where("node is null or nd_id <=> component_id").groupBy("component", "nd_id", "nd_key").agg(F.count("*").alias("n"))
    bare = F.col("component").isNull()
    stay = stay.groupBy("component", F.when(bare, F.col("nd_id")), F.when(bare, F.col("nd_key"))).agg(F.min(F.struct("nd_key", "nd_id", "n")).alias("k"))
    stay = stay.select(F.col("k.nd_id").alias("k_id"), F.col("k.nd_key").alias("k_key"), F.when(bare, 1).otherwise(F.col("k.n")).alias("k_n"))
    stay = materialize(stay, "near-kept")
    rows = packed(df, F.col(id_col).cast("long").alias("nd_id"), _text_key(text_col).alias("nd_key"))
    own = (F.col("nd_key") == F.col("k_key")) & F.col("nd_id").eqNullSafe(F.col("k_id"))
    alone = rows.join(stay.where("k_n = 1"), own, "left_semi").select("row.*")
    repeated = stay.where("k_n > 1")
    if repeated.isEmpty():
        return alone
    one = rows.join(repeated, own, "left_semi").groupBy("nd_id", "nd_key").agg(F.first("row").alias("row"))
    return alone.union(one.select("row.*"))


def _links(df: DataFrame, nodes: DataFrame, words: int, percent: int, id_col: str, text_col: str, block_elements: int) -> DataFrame:
    """The verified links (a, b) of nodes."""
    used: list[DataFrame] = []

    def held(df: DataFrame, name: str) -> DataFrame:
        used.append(materialize(df, name))
        return used[-1]

    bins = F.octet_length("sketch")
    least = least_equal(nodes.agg(F.max(bins)).first()[0] or 1, percent)
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    # A table of its own, so that the join of a hot bucket may be split.
    crowded = held(placed.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "crowded")
    placed = held(placed.join(crowded, "bucket"), "placed")

    # Pivots, and who is near them.
    score = placed.groupBy("node").agg(F.sum("c").alias("score"))
    pivots = held(placed.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("p"), F.first("c").alias("c")).select("bucket", "c", F.col("p.node").alias("pivot"), F.col("p.score").alias("score")), "pivots")
    around = held(placed.drop("c").join(pivots, "bucket").where("node <> pivot"), "around")
    stars = around.groupBy("node", "pivot", "score").agg(F.count("*").alias("shared"))
    sketches = nodes.select("node", "sketch")
    stars = stars.join(sketches, "node").join(sketches.select(F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
    stars = held(stars.select("node", "pivot", "score", "shared", "sketch", "pivot_sketch").mapInArrow(worker.tasks_of("neardup", _mark_near(least)), "node binary, pivot binary, score long, shared long, near boolean"), "stars")

    # Of buckets of three and more, those not near the pivot against the others, in blocks.
    far = held(around.where("c > 2").join(stars.where("not near").select("node", "pivot"), ["node", "pivot"], "left_semi").select("bucket", "node"), "far")
    sizes = held(pivots.select("bucket", "c").join(far.groupBy("bucket").agg(F.count("*").alias("q")), "bucket"), "open-buckets")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK_NODES)).cast("int")
    block_of = lambda c, k: F.pmod(F.xxhash64("node", F.lit(k)), blocks(c)).cast("int")
    members = around.select("bucket", "node").join(sizes, "bucket").select("bucket", block_of("c", 0).alias("m_block"), F.explode(F.sequence(F.lit(0), blocks("q") - 1)).alias("q_block"), F.lit(False).alias("query"), "node")
    queries = far.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), blocks("c") - 1)).alias("m_block"), block_of("q", 1).alias("q_block"), F.lit(True).alias("query"), "node")
    of_blocks = ["bucket", "m_block", "q_block"]
    rows = members.union(queries).join(sketches, "node").select(*of_blocks, "query", "node", "sketch").repartition(*of_blocks).sortWithinPartitions(*of_blocks)
    more = held(rows.mapInArrow(worker.tasks_of("neardup", _link_blocks(least)), "a binary, b binary"), "near-links")

    family = components(stars.where("near").select(F.col("node").alias("a"), F.col("pivot").alias("b")).union(more)).withColumnRenamed("component", "family")
    # One text for each node of a family, from any row that has the node's set.
    wanted = family.join(nodes, "node").select("node", "family", "n", "w_row")
    texts = held(_texts(df, wanted, words, id_col, text_col), "texts")

    best = stars.where("near").groupBy("node").agg(F.max(F.struct("shared", "score", "pivot")).alias("b")).select("node", F.col("b.pivot").alias("pivot"))
    pairs = texts.select("node", "text").join(best, "node").join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    first = held(pairs.select("node", "pivot", "text", "pivot_text").mapInArrow(worker.tasks_of("neardup", _verify_pairs(words, percent)), "a binary, b binary"), "verified")

    known = components(first)
    members = texts.join(known.withColumnRenamed("node", "k_node"), F.col("node") == F.col("k_node"), "left").select("node", "family", "n", "text", F.coalesce("component", "node").alias("comp"))
    members = held(members, "members")
    sizes = members.groupBy("family", "comp").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    total = sizes.groupBy("family").agg(F.sum("n").alias("f_n"), F.count("*").alias("f_comps"), F.max(F.struct("m", "n", "comp")).alias("main")).where("f_comps > 1")
    total = held(total.select("family", "f_n", (F.col("f_n") - F.col("main.n")).alias("q_n"), F.col("main.comp").alias("main")), "open-families")
    count = lambda c: F.ceil(F.col(c) / F.lit(block_elements)).cast("int")
    placed_in = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), count("f_n" if k == 0 else "q_n")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    open_rows = members.join(total, "family")
    as_member = open_rows.select("family", placed_in(0).alias("m_block"), every("q_n").alias("q_block"), F.lit(False).alias("query"), "node", "comp", "text")
    as_query = open_rows.where("comp <> main").select("family", every("f_n").alias("m_block"), placed_in(1).alias("q_block"), F.lit(True).alias("query"), "node", "comp", "text")

    def decide(table: pa.Table) -> pa.Table:
        nodes, comps, sets = table["node"].to_pylist(), table["comp"].to_pylist(), [shingle_set(t.as_py(), words) for t in table["text"]]
        role = table["query"].to_pylist()
        queries, against = [k for k, q in enumerate(role) if q], [k for k, q in enumerate(role) if not q]
        links = block_links(nodes, comps, sets, queries, against, percent) if queries and against else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    rest = as_member.unionByName(as_query).groupBy("family", "m_block", "q_block").applyInArrow(decide, "a binary, b binary")
    links = materialize(first.union(rest), "verified-links")
    drop_table(*used)
    return links


def _texts(df: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, family, n, text) of the wanted nodes; ids may repeat with other texts, so the text's own node decides.
    A row that is repeated gives its node again, which changes no link."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("family", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [xxhash.xxh3_128_digest(shingle_set(t.as_py(), words).tobytes()) == node for t, node in zip(batch.column("text"), batch.column("node").to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    docs = df.select(_row_key(id_col, text_col).alias("t_row"), F.col(text_col).alias("text"))
    return docs.join(wanted, F.col("t_row") == F.col("w_row")).select("node", "family", "n", "text").mapInArrow(worker.tasks_of("neardup", own), schema)
