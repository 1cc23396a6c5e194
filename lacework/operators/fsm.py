"""Frequent labelled patterns of up to three edges, with minimum-image-based support.

The support of a labelled pattern is the least, over its vertices, of the number of graph vertices that can stand there.
All label tuples of a template are counted in one job. Wedges, chains and stars are not listed: whether a vertex can
stand in a place follows from the labels that its neighbours and theirs have, which are masks of bits, so that each edge
carries a word for each 64 labels and not a row for each pair of them; only a chain whose ends have one label looks at
triangles. Labels of frequent edges prune the larger patterns; support never grows with the pattern, so nothing is lost.

Label tuples are in the vertex order of the templates: edge (v0, v1); wedge centre first; triangle; four-chain
v2 - v0 - v1 - v3; three-star with its centre in the second place.
"""

from __future__ import annotations

import gc
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacework.operators.graph import Graph, _as_table, shared_folder
from lacework.operators.matching import list_cliques

TEMPLATES = ("vertex", "edge", "wedge", "triangle", "four_chain", "three_star")
#: Pairs of labels that go by the driver and are broadcast.
MOST_PAIRS = 100_000


def vertex_support(graph: Graph, threshold: int = 1) -> DataFrame:
    """(l0, support): vertices of each label, isolated ones included."""
    return graph.labels.groupBy(F.col("label").alias("l0")).agg(F.count("*").alias("support")).where(F.col("support") >= threshold)


def edge_support(graph: Graph, threshold: int = 1) -> DataFrame:
    """(l0, l1, support) with l0 <= l1."""
    dom = graph.label_counts.groupBy("lv", "l").agg(F.count("*").alias("d"))
    other = dom.select(F.col("l").alias("lv"), F.col("lv").alias("l"), F.col("d").alias("e"))
    return dom.join(other, ["lv", "l"]).where("lv <= l").select(F.col("lv").alias("l0"), F.col("l").alias("l1"), F.least("d", "e").alias("support")).where(F.col("support") >= threshold)


def _bit(l: str) -> str:
    return f"shiftleft(1L, {l} & 63)"


def _own(l: str) -> str:
    """The bit of a label in a row's word, 0 if it is in another."""
    return f"IF(shiftright({l}, 6) = k, {_bit(l)}, 0L)"


def _key(a: str, b: str) -> str:
    """Two integers as one."""
    return f"(shiftleft(CAST({a} AS BIGINT), 32) | (CAST({b} AS BIGINT) & 4294967295))"


class Neighbours:
    """What one and two steps reach, along frequent edges where these are given. A set of labels is a row for each word of
    64 of them that has any: k (the label / 64) and a mask."""

    def __init__(self, graph: Graph, edges: DataFrame | None = None):
        self.graph, self.kept = graph, graph.kept
        self.spark = graph.edges.sparkSession
        self.both = None
        if edges is not None:
            some = edges.select("l0", "l1").limit(MOST_PAIRS + 1).collect()
            if few := len(some) <= MOST_PAIRS:
                edges = self.spark.createDataFrame(some, "l0 int, l1 int")
            both = edges.select(F.col("l0").alias("lv"), F.col("l1").alias("l")).union(edges.select("l1", "l0")).distinct()
            self.both = F.broadcast(both) if few else both

    def table(self, df: DataFrame) -> DataFrame:
        """What several steps read, as a table; a plan that holds the plan of each view it reads twice would outgrow the driver. What was shuffled for it isn't read again: its files go once the driver forgets the plan."""
        done = _as_table(df, shared_folder(self.spark))
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return done

    def frequent(self, df: DataFrame, a: str, b: str) -> DataFrame:
        """The rows whose pair of labels is a frequent edge."""
        return df if self.both is None else df.join(self.both.select(F.col("lv").alias(a), F.col("l").alias(b)), [a, b], "left_semi").select(*df.columns)

    @cached_property
    def counts(self) -> DataFrame:
        return self.frequent(self.graph.label_counts, "lv", "l")

    @cached_property
    def labels(self) -> DataFrame:
        """(l, k): the labels that vertices have."""
        return self.table((self.counts if self.both is None else self.both).select("l").distinct().withColumn("k", F.expr("shiftright(l, 6)")))

    def members(self, df: DataFrame, mask: str, name: str) -> DataFrame:
        """A row for each label of a mask."""
        labels = F.broadcast(self.labels.withColumnRenamed("l", name))
        return df.join(labels, "k").where(f"({mask} & {_bit(name)}) <> 0")

    @cached_property
    def profile(self) -> DataFrame:
        """(v, lv, k, m1, m2, m3): labels that at least 1, 2 and 3 neighbours of v have."""
        masks = (F.expr(f"bit_or(IF(c >= {n}, {_bit('l')}, 0L))").alias(f"m{n}") for n in (1, 2, 3))
        return self.table(self.counts.groupBy("v", "lv", F.expr("shiftright(l, 6)").alias("k")).agg(*masks))

    @cached_property
    def vertex_counts(self) -> DataFrame:
        """(v, lv, p): p (l, c), up to 3 counted, for each label that neighbours of v have."""
        return self.counts.groupBy("v", "lv").agg(F.array_sort(F.collect_list(F.struct("l", F.least("c", F.lit(3)).alias("c")))).alias("p"))

    @cached_property
    def kinds(self) -> DataFrame:
        """(lv, p, n): how many vertices have the same label and the same p."""
        return self.table(self.vertex_counts.groupBy("lv", "p").agg(F.count("*").alias("n")))

    @cached_property
    def seen(self) -> DataFrame:
        """(u, lu, v, lv, k, m1, m2, m3): every edge in both directions, with the profile of v. Dealt by u: what is summed
        by u and more doesn't move again."""
        und = self.frequent(self.graph.labelled_und, "ls", "ld").select(F.col("src").alias("u"), F.col("ls").alias("lu"), F.col("dst").alias("v"))
        return self.kept(und.join(self.profile, "v").select("u", "lu", "v", "lv", "k", "m1", "m2", "m3").repartition("u"))

    @cached_property
    def reach(self) -> DataFrame:
        """(u, lu, lv, k, m): labels of the vertices two steps from u, other than u, by way of label lv."""
        return self.kept(self.seen.groupBy("u", "lu", "lv", "k").agg(F.expr(f"bit_or({_left(1)})").alias("m")).where("m <> 0"))

    @cached_property
    def triangles(self) -> DataFrame:
        """(p0, p1, p2, a0, a1, a2): ids and labels."""
        graph = self.graph
        if self.both is not None:
            graph = Graph(self.frequent(graph.labelled_und.where("src < dst"), "ls", "ld").select("src", "dst"), graph.vertices)
            graph.kept = self.kept
        t = list_cliques(graph, 3)
        for k in range(3):
            t = t.join(self.graph.labels.select(F.col("id").alias(f"p{k}"), F.col("label").alias(f"a{k}")), f"p{k}")
        return self.table(t.select("p0", "p1", "p2", "a0", "a1", "a2"))


def _left(n: int) -> str:
    """Of seen: the labels that at least n neighbours of v have, u left out."""
    own = _own("lu")
    return f"((m{n} & ~{own}) | (m{n + 1} & {own}))"


def wedge_support(graph: Graph, threshold: int = 1, edges: DataFrame | None = None, near: Neighbours | None = None) -> DataFrame:
    """(l0, l1, l2, support), centre l0, l1 <= l2."""
    near = near or Neighbours(graph, edges)
    centre = near.kinds.select("lv", "n", "p", F.explode("p").alias("x")).select("lv", "n", "x", F.explode("p").alias("y")).where("x.l <= y.l and (x.l <> y.l or x.c >= 2)")
    centre = centre.groupBy(F.col("lv").alias("l0"), F.col("x.l").alias("l1"), F.col("y.l").alias("l2")).agg(F.sum("n").alias("d0"))
    leaf = near.members(near.reach.groupBy("lu", "lv", "k", "m").agg(F.count("*").alias("n")), "m", "l")
    leaf = near.table(leaf.groupBy(F.col("lv").alias("l0"), F.col("lu").alias("l1"), F.col("l").alias("l2")).agg(F.sum("n").alias("d1")))
    other = leaf.select("l0", F.col("l2").alias("l1"), F.col("l1").alias("l2"), F.col("d1").alias("d2"))
    names = ["l0", "l1", "l2"]
    return centre.join(leaf, names).join(other, names).select(*names, F.least("d0", "d1", "d2").alias("support")).where(F.col("support") >= threshold)


def triangle_support(graph: Graph, threshold: int = 1, edges: DataFrame | None = None, near: Neighbours | None = None) -> DataFrame:
    """(l0, l1, l2, support) with l0 <= l1 <= l2. edges: the frequent ones; no triangle with another is searched."""
    t = (near or Neighbours(graph, edges)).triangles.withColumn("s", F.array_sort(F.array("a0", "a1", "a2")))
    ends = t.select(*(F.element_at("s", k + 1).alias(f"l{k}") for k in range(3)), F.explode(F.array(*(F.struct(F.col(f"a{k}").alias("l"), F.col(f"p{k}").alias("p")) for k in range(3)))).alias("x"))
    ends = ends.groupBy("l0", "l1", "l2", F.col("x.l").alias("l")).agg(F.count_distinct("x.p").alias("d"))
    return ends.groupBy("l0", "l1", "l2").agg(F.min("d").alias("support")).where(F.col("support") >= threshold)


def _lone(near: Neighbours) -> DataFrame:
    """(v0, ds): for labels l1 and l3, the neighbours w of v0 with label l3 that are the only choice for v3 of some v1 with
    label l1, v0 left out; such v0, v1 and w are a triangle. ds: (l1, l3, w, dep, low, high), w the one on which most v1
    depend, dep so many, low and high the least and the greatest w."""
    corners = ", ".join(f"named_struct('v1', p{i}, 'l1', a{i}, 'x', p{j}, 'lx', a{j}, 'y', p{k}, 'ly', a{k})" for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))
    t = near.triangles.select(F.expr(f"inline(array({corners}))"))
    t = t.join(near.profile.select(F.col("v").alias("v1"), "k", "m1", "m2", "m3"), "v1")
    one = lambda l0, l3: f"({_own(l3)} & IF({l0} = {l3}, m2 & ~m3, m1 & ~m2)) <> 0"
    sides = ", ".join(f"IF({one(l0, l3)}, named_struct('v0', {v0}, 'l1', l1, 'l3', {l3}, 'w', {w}), NULL)" for v0, l0, w, l3 in (("x", "lx", "y", "ly"), ("y", "ly", "x", "lx")))
    d = t.select(F.expr(f"inline(array_compact(array({sides})))")).repartition("v0")
    d = d.groupBy("v0", "l1", "l3", "w").agg(F.count("*").alias("dep")).groupBy("v0", "l1", "l3")
    d = d.agg(F.max_by("w", "dep").alias("w"), F.max("dep").alias("dep"), F.min("w").alias("low"), F.max("w").alias("high"))
    return d.groupBy("v0").agg(F.collect_list(F.struct("l1", "l3", "w", "dep", "low", "high")).alias("ds"))


def _balls(near: Neighbours) -> DataFrame:
    """(v0, l0, es): what v0 reaches by its neighbours v1, other than v0: es (l1, k, m, s, w), a label of v1 and a word of
    labels l3. A vertex x that is taken as v2 bars (l1, l3) if each v1 is x or has x as its only v3: s (x, bit) has those
    that are the only v1, w (x, l3) the others, whose label is l3. (l1, l3) is barred by two vertices of one label at most,
    and that with l1 = l3."""
    ways = near.members(near.seen, _left(1), "l3").groupBy("u", "lu", "lv", "l3").agg(F.count("*").alias("g"), F.min("v").alias("x"))
    only = f"collect_list(IF(g = 1, named_struct('x', x, 'bit', {_bit('l3')}), NULL))"
    ways = ways.groupBy("u", "lu", "lv", F.expr("shiftright(l3, 6)").alias("k")).agg(F.expr(f"bit_or({_bit('l3')})").alias("m"), F.expr(only).alias("s"), F.expr("map_from_entries(collect_list(struct(l3, g)))").alias("g"))
    ways = ways.groupBy(F.col("u").alias("v0"), F.col("lu").alias("l0")).agg(F.collect_list(F.struct(F.col("lv").alias("l1"), "k", "m", "s", "g")).alias("es"))
    # With l1 = l3 such an x is a v1 itself; of two v1, each may be the other's only v3.
    g = "e.g[d.l3]"
    xs = f"CASE WHEN d.l1 <> d.l3 AND d.dep = {g} THEN array(d.w) WHEN d.l1 = d.l3 AND {g} = 2 THEN array_distinct(array(d.low, d.high)) WHEN d.l1 = d.l3 AND d.dep = {g} - 1 THEN array(d.w) ELSE array() END"
    w = f"flatten(transform(filter(ds, d -> d.l1 = e.l1 AND shiftright(d.l3, 6) = e.k), d -> transform({xs}, x -> named_struct('x', x, 'l3', d.l3))))"
    none = "CAST(array() AS array<struct<x: bigint, l3: int>>)"
    return ways.join(_lone(near), "v0", "left").select("v0", "l0", F.expr(f"transform(es, e -> named_struct('l1', e.l1, 'k', e.k, 'm', e.m, 's', e.s, 'w', IF(ds IS NULL, {none}, {w})))").alias("es"))


def chain_support(graph: Graph, threshold: int = 1, edges: DataFrame | None = None, canonical: bool = True, near: Neighbours | None = None) -> DataFrame:
    """(l0, l1, l2, l3, support) of paths v2 - v0 - v1 - v3. canonical: each pattern once (l0 < l1, or l0 = l1 and
    l2 <= l3); otherwise every tuple with l0 <= l1, in which those with l0 = l1 and l2 <> l3 come twice."""
    near = near or Neighbours(graph, edges)
    tuples = ["l0", "l1", "l2", "l3"]
    ball = near.kept(_balls(near))

    # v2: what is left of the labels (l1, l3) of its neighbours v0.
    und = near.frequent(graph.labelled_und, "ls", "ld").select(F.col("src").alias("v2"), F.col("ls").alias("l2"), F.col("dst").alias("v0"))
    barred = lambda bars, when, bit: f"IF({when} AND size({bars}) > 0, aggregate({bars}, 0L, (a, b) -> a | IF(b.x = v2, {bit}, 0L)), 0L)"
    left = f"transform(es, e -> e.m & ~{barred('e.s', 'e.l1 = l2', 'b.bit')} & ~{barred('e.w', 'e.k = shiftright(l2, 6)', _bit('b.l3'))})"
    rows = und.join(ball, "v0").select("v2", "l2", "l0", F.expr(f"transform(es, e -> {_key('e.l1', 'e.k')})").alias("keys"), F.expr(left).alias("ms")).repartition("v2")
    ends = rows.select("v2", "l2", "l0", "keys", F.posexplode("ms").alias("i", "m")).where("m <> 0")
    ends = ends.groupBy("v2", "l2", "l0", F.expr("keys[i]").alias("key")).agg(F.expr("bit_or(m)").alias("m")).groupBy("l2", "l0", "key", "m").agg(F.count("*").alias("n"))
    ends = ends.withColumns({"l1": F.expr("CAST(shiftright(key, 32) AS INT)"), "k": F.expr("CAST(shiftright(shiftleft(key, 32), 32) AS INT)")})
    ends = near.table(near.members(ends, "m", "l3").groupBy(*tuples).agg(F.sum("n").alias("d2")))

    # v0: those with such labels and a neighbour of label l2, less those of which every such neighbour is barred.
    mine = near.profile.select(F.col("v").alias("u"), F.col("k").alias("k2"), F.col("m1").alias("m2"))
    every = near.reach.join(mine, "u").groupBy("lu", "lv", "k", "m", "k2", "m2").agg(F.count("*").alias("n"))
    every = near.members(near.members(every, "m", "l3").drop("k", "m").withColumnRenamed("k2", "k"), "m2", "l2").select(F.col("lu").alias("l0"), F.col("lv").alias("l1"), "l2", "l3", "n")
    own = near.vertex_counts.select(F.col("v").alias("v0"), F.expr("map_from_entries(p)").alias("c"))
    lost = ball.where("exists(es, e -> size(e.s) > 0 OR size(e.w) > 0)").join(own, "v0").select("l0", "c", F.expr("inline(es)"))
    by_s = "IF(c[l1] = 1, aggregate(s, 0L, (a, b) -> a | b.bit), 0L)"
    by_w = f"IF(size(w) = 0, 0L, aggregate(w, 0L, (a, b) -> a | IF(b.l3 <> l1 AND c[b.l3] = 1 OR b.l3 = l1 AND c[l1] = 2 AND size(filter(w, t -> t.l3 = l1)) = 2, {_bit('b.l3')}, 0L)))"
    lost = lost.select("l0", "l1", "k", F.expr(f"inline(array(named_struct('as', 1, 'm', {by_s}), named_struct('as', 3, 'm', {by_w})))")).where("m <> 0").groupBy("l0", "l1", "k", "as", "m").agg(F.count("*").alias("n"))
    lost = near.members(lost, "m", "l3").select("l0", "l1", F.expr("IF(`as` = 1, l1, l3)").alias("l2"), "l3", (-F.col("n")).alias("n"))
    middle = near.table(every.union(lost).groupBy(*tuples).agg(F.sum("n").alias("d0")).where("d0 > 0"))
    # v1 and v3 in (l0, l1, l2, l3) are v0 and v2 in the reversed path.
    back = lambda df, name: df.select(F.col("l1").alias("l0"), F.col("l0").alias("l1"), F.col("l3").alias("l2"), F.col("l2").alias("l3"), F.col(df.columns[-1]).alias(name))
    found = middle.join(back(middle, "d1"), tuples).join(ends, tuples).join(back(ends, "d3"), tuples).select(*tuples, F.least("d0", "d1", "d2", "d3").alias("support"))
    rule = "l0 < l1 or (l0 = l1 and l2 <= l3)" if canonical else "l0 <= l1"
    return found.where(rule).where(F.col("support") >= threshold)


def star_support(graph: Graph, threshold: int = 1, edges: DataFrame | None = None, near: Neighbours | None = None) -> DataFrame:
    """(l0, l1, l2, l3, support), centre l1, leaves l0 <= l2 <= l3."""
    near = near or Neighbours(graph, edges)
    tuples = ["l0", "l1", "l2", "l3"]
    centre = near.kinds.select("lv", "n", "p", F.explode("p").alias("x")).select("lv", "n", "p", "x", F.explode("p").alias("y")).where("x.l <= y.l and (x.l <> y.l or x.c >= 2)")
    centre = centre.select("lv", "n", "x", "y", F.explode("p").alias("z")).where("y.l <= z.l and (y.l <> z.l or y.c >= 2) and (x.l <> z.l or x.c >= 3)")
    centre = centre.groupBy(F.col("x.l").alias("l0"), F.col("lv").alias("l1"), F.col("y.l").alias("l2"), F.col("z.l").alias("l3")).agg(F.sum("n").alias("d"))
    # Of a leaf u: the labels a <= b that two further leaves of its centres can have.
    rest = near.seen.select("u", "lu", "v", "lv", "k", F.expr(_left(1)).alias("m1"), F.expr(_left(2)).alias("m2"))
    pairs = near.members(rest, "m1", "a")
    if near.labels.select("k").distinct().count() > 1:
        pairs = pairs.select("u", "lu", "v", "lv", "a").join(rest, ["u", "v", "lu", "lv"])
    after = f"CASE WHEN shiftright(a, 6) < k THEN m1 WHEN shiftright(a, 6) > k THEN 0L ELSE (m1 & (shiftleft(-1L, a & 63) ^ {_bit('a')})) | (m2 & {_bit('a')}) END"
    pairs = pairs.groupBy("u", "lu", "lv", "a", "k").agg(F.expr(f"bit_or({after})").alias("m")).groupBy("lu", "lv", "a", "k", "m").agg(F.count("*").alias("n"))
    leaf = near.table(near.members(pairs, "m", "b").groupBy("lv", "lu", "a", "b").agg(F.sum("n").alias("n")))
    found = centre
    for k, own, a, b in ((0, "l0", "l2", "l3"), (1, "l2", "l0", "l3"), (2, "l3", "l0", "l2")):
        found = found.join(leaf.select(F.col("lv").alias("l1"), F.col("lu").alias(own), F.col("a").alias(a), F.col("b").alias(b), F.col("n").alias(f"e{k}")), tuples)
    return found.select(*tuples, F.least("d", "e0", "e1", "e2").alias("support")).where(F.col("support") >= threshold)


class Frequent:
    """The frequent patterns of each template; a template is planned when it is asked for."""

    def __init__(self, graph: Graph, threshold: int, reference_compat: bool = False):
        if threshold < 1:
            raise ValueError(f"the threshold must be at least 1, not {threshold}")
        self.graph, self.threshold, self.reference_compat = graph, threshold, reference_compat

    @cached_property
    def vertex(self) -> DataFrame:
        return vertex_support(self.graph, self.threshold)

    @cached_property
    def edge(self) -> DataFrame:
        return self.graph.kept(edge_support(self.graph, self.threshold))

    @cached_property
    def near(self) -> Neighbours:
        return Neighbours(self.graph, self.edge)

    @cached_property
    def wedge(self) -> DataFrame:
        return wedge_support(self.graph, self.threshold, near=self.near)

    @cached_property
    def triangle(self) -> DataFrame:
        return triangle_support(self.graph, self.threshold, near=self.near)

    @cached_property
    def four_chain(self) -> DataFrame:
        return chain_support(self.graph, self.threshold, canonical=not self.reference_compat, near=self.near)

    @cached_property
    def three_star(self) -> DataFrame:
        return star_support(self.graph, self.threshold, near=self.near)

    def summary(self) -> DataFrame:
        """(template, patterns, total_support)"""
        out = None
        for name in TEMPLATES:
            row = getattr(self, name).agg(F.count("*").alias("patterns"), F.coalesce(F.sum("support"), F.lit(0)).cast("long").alias("total_support")).select(F.lit(name).alias("template"), "patterns", "total_support")
            out = row if out is None else out.unionByName(row)
        return out


def mine_frequent(graph: Graph, threshold: int, reference_compat: bool = False) -> Frequent:
    """All frequent patterns. reference_compat: chains with equal middle labels and different ends are listed twice."""
    return Frequent(graph, threshold, reference_compat)
