"""The graph queries over the supplied tables, and their SQL.

The graph joins parts that were bought and returned in one order (or, where the name says so, bought in one order);
its vertex labels number the part types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacework import roundtrips
from lacework.functions import setops
from lacework.operators import analysis, fsm, motif
from lacework.operators.graph import Graph, check_edges
from lacework.operators.matching import count, count_by_joins, list_cliques
from lacework.plans.pattern import Pattern, chain, cycle, star
from lacework.sources.text import adjacency_lines

THETA = 50


def co_purchase_edges(spark: SparkSession, sf_dir: str, returned: bool = True) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = (rows.where("l_returnflag = 'R'") if returned else rows).select("l_orderkey", "l_partkey")
    a, b = rows.withColumnRenamed("l_partkey", "src"), rows.withColumnRenamed("l_partkey", "dst")
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst")


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label): part types numbered in their order. The distinct types are few; the parts are not sorted."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), "p_type")
    types = part.select("p_type").distinct().withColumn("label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p_type")) - 1)
    return part.join(types, "p_type").select("id", "label")


def graph(spark: SparkSession, sf_dir: str, returned: bool = True, labels: bool = False) -> Graph:
    return Graph.from_edges(co_purchase_edges(spark, sf_dir, returned), vertices=part_labels(spark, sf_dir) if labels else None).cache()


def _n(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("n").alias(name))


TAILED_TRIANGLE = Pattern.of(4, [(0, 1), (1, 2), (0, 2), (2, 3)])
DIAMOND = Pattern.of(4, [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)])


def _pairs(g: Graph) -> DataFrame:
    """(src, dst, a, b): edges with the neighbour lists of both ends."""
    adj = g.adj
    return g.edges.join(adj.select(F.col("id").alias("src"), F.col("nbrs").alias("a")), "src").join(adj.select(F.col("id").alias("dst"), F.col("nbrs").alias("b")), "dst")


def _text(c):
    return F.array_join(F.array_sort(c).cast("array<string>"), " ")


def _shuffled_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    ids = g.shuffled_ids()
    sums = ids.agg(F.count("*").alias("vertices"), F.count_distinct("new_id").alias("ids"), F.min("new_id").alias("low"), F.max("new_id").alias("high"))
    edges, tri = g.relabel(ids).edges.agg(F.count("*").alias("edges")), _n(motif.triangles(g.relabel(ids)), "triangles")
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(sums).join(one(edges), "_k").join(one(tri), "_k").drop("_k")


def _locality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    ids = g.locality_ids(seed_degree=16)
    ranges = ids.groupBy("colour").agg(F.count("*").alias("n"), F.min("new_id").alias("low"), F.max("new_id").alias("high"))
    whole = ranges.agg(F.count(F.when(F.col("high") - F.col("low") + 1 != F.col("n"), 1)).alias("broken_ranges"))
    sums = ids.agg(F.count("*").alias("vertices"), F.count_distinct("new_id").alias("ids"), F.max("new_id").alias("high"))
    return sums.withColumn("_k", F.lit(1)).join(whole.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each return of a part as a request for its neighbour list."""
    g = graph(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("vid"))
    return analysis.trace_volume(rows.join(g.degrees.withColumnRenamed("id", "vid"), "vid"), g.degrees)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "edges_standardized": lambda s, d: graph(s, d).edges,
    "symmetric_edges": lambda s, d: graph(s, d).und,
    "dense_ids": lambda s, d: graph(s, d).densify()[1].select("id", "new_id"),
    "degrees": lambda s, d: graph(s, d).degrees,
    "max_degree": lambda s, d: analysis.max_degree(graph(s, d)),
    "degree_histogram": lambda s, d: analysis.degree_histogram(graph(s, d)),
    "degree_deciles": lambda s, d: analysis.degree_shares(graph(s, d)),
    "check_graph": lambda s, d: check_edges(graph(s, d).und),
    "label_histogram": lambda s, d: analysis.label_histogram(graph(s, d, labels=True)),
    "vertices_by_label": lambda s, d: graph(s, d, labels=True).vertices_with_label(2),
    "neighbors_by_label": lambda s, d: graph(s, d, labels=True).neighbours_by_label().select("id", "label", _text(F.col("nbrs")).alias("nbrs")),
    "partition_stats": lambda s, d: analysis.partition_stats(graph(s, d), 4),
    "hub_vertices": lambda s, d: analysis.hubs(graph(s, d), 30),
    "edges_oriented": lambda s, d: graph(s, d).oriented,
    "degree_rank_edges": lambda s, d: (lambda g: g.relabel(g.degree_rank_ids()).edges)(graph(s, d)),
    "adjacency_text": lambda s, d: adjacency_lines(graph(s, d, labels=True)).select(F.col("value").alias("line")),
    "shuffled_ids_check": _shuffled_check,
    "locality_ids_check": _locality_check,
    "triangle_count": lambda s, d: _n(motif.triangles(graph(s, d)), "triangles"),
    "triangle_count_all": lambda s, d: _n(motif.triangles(graph(s, d, False)), "triangles"),
    "triangle_count_joins": lambda s, d: _n(count_by_joins(graph(s, d), Pattern.of(3, [(0, 1), (1, 2), (0, 2)])), "triangles"),
    "triangle_list": lambda s, d: list_cliques(graph(s, d), 3),
    "clique4_count": lambda s, d: _n(motif.cliques(graph(s, d), 4), "cliques"),
    "clique5_count": lambda s, d: _n(motif.cliques(graph(s, d), 5), "cliques"),
    "clique4_count_all": lambda s, d: _n(motif.cliques(graph(s, d, False), 4), "cliques"),
    "wedge_induced_count": lambda s, d: _n(motif.wedges_induced(graph(s, d)), "wedges"),
    "wedge_induced_search": lambda s, d: _n(motif.induced_wedge_searches(graph(s, d)), "wedges"),
    "wedge_noninduced_count": lambda s, d: _n(motif.wedges(graph(s, d)), "wedges"),
    "three_motif": lambda s, d: motif.three_motif(graph(s, d)),
    "three_star_count": lambda s, d: _n(motif.three_stars(graph(s, d)), "stars"),
    "three_star_search": lambda s, d: _n(count(graph(s, d), star(3)), "stars"),
    "chain4_induced_count": lambda s, d: _n(count(graph(s, d), chain(4), induced=True), "chains"),
    "chain4_count": lambda s, d: _n(count(graph(s, d), chain(4)), "chains"),
    "cycle4_count": lambda s, d: _n(count(graph(s, d), cycle(4)), "cycles"),
    "cycle4_induced_count": lambda s, d: _n(count(graph(s, d), cycle(4), induced=True), "cycles"),
    "tailed_triangle_count": lambda s, d: _n(count(graph(s, d), TAILED_TRIANGLE), "patterns"),
    "diamond_count": lambda s, d: _n(count(graph(s, d), DIAMOND), "patterns"),
    "nbr_intersect": lambda s, d: _pairs(graph(s, d)).select("src", "dst", setops.intersect_count(F.col("a"), F.col("b")).alias("n"), _text(setops.intersect(F.col("a"), F.col("b"))).alias("ids")),
    "nbr_intersect_bounded": lambda s, d: _pairs(graph(s, d)).select("src", "dst", F.size(setops.bounded_intersect(F.col("a"), F.col("b"), F.col("src"))).cast("long").alias("n")),
    "nbr_except": lambda s, d: _pairs(graph(s, d)).select("src", "dst", F.size(setops.difference(F.col("a"), F.col("b"))).cast("long").alias("n")),
    "nbr_except_bounded": lambda s, d: _pairs(graph(s, d)).select("src", "dst", F.size(setops.bounded_difference(F.col("a"), F.col("b"), F.col("dst"))).cast("long").alias("n")),
    "nbr_trims": lambda s, d: _pairs(graph(s, d)).select("src", "dst", setops.count_below(F.col("a"), F.col("dst")).alias("below"), setops.count_up_to(F.col("a"), F.col("dst")).alias("up_to")),
    "fsm_vertex": lambda s, d: fsm.vertex_support(graph(s, d, labels=True), THETA),
    "fsm_edge": lambda s, d: fsm.edge_support(graph(s, d, labels=True), THETA),
    "fsm_wedge": lambda s, d: fsm.mine_frequent(graph(s, d, labels=True), THETA).wedge,
    "fsm_triangle": lambda s, d: fsm.triangle_support(graph(s, d, labels=True), THETA),
    "fsm_four_chain": lambda s, d: fsm.mine_frequent(graph(s, d, labels=True), THETA).four_chain,
    "fsm_four_chain_compat": lambda s, d: fsm.mine_frequent(graph(s, d, labels=True), THETA, reference_compat=True).four_chain,
    "fsm_three_star": lambda s, d: fsm.mine_frequent(graph(s, d, labels=True), THETA).three_star,
    "fsm_summary": lambda s, d: fsm.mine_frequent(graph(s, d, labels=True), THETA).summary(),
    "trace_volume": _trace,
    "trace_top": lambda s, d: analysis.top_volumes(_trace(s, d)),
    "trace_shares": lambda s, d: analysis.trace_shares(_trace(s, d), graph(s, d).degrees),
}

def _labelled(labels: list[int | None], edges: list[tuple[int, int]], induced: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _n(count(graph(s, d, labels=True), Pattern.of(len(labels), edges, labels), induced), "patterns")


_SAYS = (("count", "triangle", "FILE"), ("count", "wedge", "FILE", "--induced"), ("motif", "FILE"), ("validate", "FILE"))
QUERIES |= {
    "graph_file": lambda s, d: roundtrips.graph_file(graph(s, d, labels=True)),
    "edge_label_file": lambda s, d: roundtrips.edge_label_file(graph(s, d), True),
    "edge_label_file_skipped": lambda s, d: roundtrips.edge_label_file(graph(s, d), False),
    "edge_list_file": lambda s, d: roundtrips.edge_list_file(graph(s, d)),
    "label_file": lambda s, d: roundtrips.label_file(graph(s, d, labels=True)),
    "text_file": lambda s, d: roundtrips.text_file(graph(s, d)),
    "standardized_files": lambda s, d: roundtrips.standardized_files(co_purchase_edges(s, d)),
    "shuffled_file": lambda s, d: roundtrips.relabelled_file(graph(s, d), "shuffled"),
    "locality_file": lambda s, d: roundtrips.relabelled_file(graph(s, d), "locality"),
    "oriented_file": lambda s, d: roundtrips.oriented_file(graph(s, d)),
    "trace_file": lambda s, d: roundtrips.trace_file(s.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("vid")), graph(s, d)),
    "console_counts": lambda s, d: roundtrips.console(graph(s, d), _SAYS),
    "console_fsm": lambda s, d: roundtrips.console(graph(s, d, labels=True), (("fsm", "FILE", str(THETA)),)),
    "pattern_table": lambda s, d: roundtrips.pattern_table(s),
    "labelled_triangle_count": _labelled([0, 0, 1], [(0, 1), (1, 2), (0, 2)]),
    "labelled_wedge_count": _labelled([2, 1, None], [(0, 1), (0, 2)], True),
    "labelled_chain_count": _labelled([3, None, None, 3], [(0, 1), (1, 2), (2, 3)]),
    "labelled_start_count": _labelled([4, None, None], [(0, 1), (0, 2)]),
}

_GRAPH = """
    e AS (SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey {where}),
    u AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e),
    dg AS (SELECT s AS v, count(*) AS k FROM u GROUP BY 1),
    lab AS (SELECT p_partkey AS v, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS l FROM part),
    lu AS (SELECT s, d, a.l AS ls, b.l AS ld FROM u JOIN lab a ON a.v = s JOIN lab b ON b.v = d)
"""


def _sql(body: str, returned: bool = True, more: str = "") -> str:
    return "WITH " + _GRAPH.format(where="WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'" if returned else "") + ("," + more if more else "") + body


_TRI = "FROM e a JOIN e b ON a.s = b.s AND a.d < b.d JOIN e x ON x.s = a.d AND x.d = b.d"
_K4 = f"{_TRI} JOIN e y ON y.s = a.s AND y.d > b.d JOIN e z ON z.s = a.d AND z.d = y.d JOIN e w ON w.s = b.d AND w.d = y.d"
_K5 = f"{_K4} JOIN e p ON p.s = a.s AND p.d > y.d JOIN e q ON q.s = a.d AND q.d = p.d JOIN e r ON r.s = b.d AND r.d = p.d JOIN e t ON t.s = y.d AND t.d = p.d"
_WEDGE_INDUCED = "FROM u a JOIN u b ON a.s = b.s AND a.d < b.d LEFT JOIN u x ON x.s = a.d AND x.d = b.d WHERE x.s IS NULL"
_PATH = "FROM u m JOIN u a ON a.s = m.s AND a.d <> m.d JOIN u b ON b.s = m.d AND b.d <> m.s AND b.d <> a.d"
_RANK = "r AS (SELECT v, row_number() OVER (ORDER BY k, v) - 1 AS i FROM dg)"
_TRACE = "tv AS (SELECT l_partkey AS vid, count(*) AS accesses, 4 * any_value(k) * count(*) AS volume, any_value(k) AS k FROM lineitem JOIN dg ON v = l_partkey WHERE l_returnflag = 'R' GROUP BY 1)"

_FSM = {
    "edge": ("FROM lu", ["ls", "ld"], ["s", "d"], "l0 <= l1"),
    "wedge": ("FROM lu a JOIN lu b ON a.s = b.s AND a.d <> b.d", ["a.ls", "a.ld", "b.ld"], ["a.s", "a.d", "b.d"], "l1 <= l2"),
    "triangle": ("FROM lu a JOIN lu b ON a.s = b.s JOIN lu c ON c.s = a.d AND c.d = b.d", ["a.ls", "a.ld", "b.ld"], ["a.s", "a.d", "b.d"], "l0 <= l1 AND l1 <= l2"),
    "four_chain": ("FROM lu m JOIN lu a ON a.s = m.s AND a.d <> m.d JOIN lu b ON b.s = m.d AND b.d <> m.s AND b.d <> a.d", ["m.ls", "m.ld", "a.ld", "b.ld"], ["m.s", "m.d", "a.d", "b.d"], "(l0 < l1 OR (l0 = l1 AND l2 <= l3))"),
    "three_star": ("FROM lu a JOIN lu b ON a.s = b.s AND a.d <> b.d JOIN lu c ON c.s = a.s AND c.d <> a.d AND c.d <> b.d", ["a.ld", "a.ls", "b.ld", "c.ld"], ["a.d", "a.s", "b.d", "c.d"], "l0 <= l2 AND l2 <= l3"),
}


def _fsm_select(name: str, rule: str | None = None) -> str:
    source, labels, ids, canonical = _FSM[name]
    keys = ", ".join(f"{x} AS l{k}" for k, x in enumerate(labels))
    return f"SELECT * FROM (SELECT {keys}, least({', '.join(f'count(DISTINCT {x})' for x in ids)}) AS support {source} GROUP BY {', '.join(labels)}) WHERE {rule or canonical} AND support >= {THETA}"


_FSM_VERTEX = f"SELECT l AS l0, count(*) AS support FROM lab GROUP BY l HAVING count(*) >= {THETA}"
_SUMMARY = " UNION ALL ".join(f"SELECT '{n}' AS template, count(*) AS patterns, coalesce(sum(support), 0)::BIGINT AS total_support FROM ({q})" for n, q in [("vertex", _FSM_VERTEX), *((n, _fsm_select(n)) for n in _FSM)])

ORACLE_SQL: dict[str, str] = {
    "edges_standardized": _sql("SELECT s AS src, d AS dst FROM e"),
    "symmetric_edges": _sql("SELECT s AS src, d AS dst FROM u"),
    "dense_ids": _sql("SELECT v AS id, row_number() OVER (ORDER BY v) - 1 AS new_id FROM dg"),
    "degrees": _sql("SELECT v AS id, k AS degree FROM dg"),
    "max_degree": _sql("SELECT max(k) AS max_degree FROM dg"),
    "degree_histogram": _sql("SELECT k AS degree, count(*) AS vertices FROM dg GROUP BY k"),
    "degree_deciles": _sql("SELECT b::INTEGER AS part, rn AS vertices, round(100.0 * run::DOUBLE / total, 4) AS share FROM ranked JOIN range(1, 11) t(b) ON rn = (b * n + 9) // 10", more="ranked AS (SELECT row_number() OVER (ORDER BY k DESC, v) AS rn, sum(k) OVER (ORDER BY k DESC, v ROWS UNBOUNDED PRECEDING) AS run, sum(k) OVER () AS total, count(*) OVER () AS n FROM dg)"),
    "check_graph": _sql("SELECT (SELECT count(*) FROM u WHERE s = d) AS n_self_loops, (SELECT count(*) FROM u) - (SELECT count(*) FROM (SELECT DISTINCT s, d FROM u)) AS n_dups, (SELECT count(*) FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.s = a.d AND b.d = a.s)) AS n_asym, (SELECT sum(k)::BIGINT FROM dg) AS degree_sum, (SELECT count(*) FROM u) AS num_edges"),
    "label_histogram": _sql("SELECT l AS label, count(*) AS vertices FROM lab GROUP BY l"),
    "vertices_by_label": _sql("SELECT v AS id, l AS label FROM lab WHERE l = 2"),
    "neighbors_by_label": _sql("SELECT s AS id, ld AS label, string_agg(d::VARCHAR, ' ' ORDER BY d) AS nbrs FROM lu GROUP BY s, ld"),
    "partition_stats": _sql("SELECT (v % 4)::INTEGER AS part, count(*) AS vertices, sum(k)::BIGINT AS edges FROM dg GROUP BY 1"),
    "hub_vertices": _sql("SELECT v AS id, k AS degree FROM dg WHERE k > 30"),
    "edges_oriented": _sql("SELECT CASE WHEN (a.k, s) < (b.k, d) THEN s ELSE d END AS src, CASE WHEN (a.k, s) < (b.k, d) THEN d ELSE s END AS dst FROM e JOIN dg a ON a.v = s JOIN dg b ON b.v = d"),
    "degree_rank_edges": _sql("SELECT least(a.i, b.i) AS src, greatest(a.i, b.i) AS dst FROM e JOIN r a ON a.v = s JOIN r b ON b.v = d", more=_RANK),
    "adjacency_text": _sql("SELECT concat_ws(' ', lab.v::VARCHAR, any_value(l)::VARCHAR, string_agg(d::VARCHAR, ' ' ORDER BY d)) AS line FROM lab LEFT JOIN u ON s = lab.v GROUP BY lab.v"),
    "shuffled_ids_check": _sql(f"SELECT (SELECT count(*) FROM dg) AS vertices, (SELECT count(*) FROM dg) AS ids, 0::BIGINT AS low, (SELECT count(*) FROM dg) - 1 AS high, (SELECT count(*) FROM e) AS edges, (SELECT count(*) {_TRI}) AS triangles"),
    "locality_ids_check": _sql("SELECT count(*) AS vertices, count(*) AS ids, count(*) - 1 AS high, 0::BIGINT AS broken_ranges FROM dg"),
    "triangle_count": _sql(f"SELECT count(*) AS triangles {_TRI}"),
    "triangle_count_all": _sql(f"SELECT count(*) AS triangles {_TRI}", False),
    "triangle_count_joins": _sql(f"SELECT count(*) AS triangles {_TRI}"),
    "triangle_list": _sql(f"SELECT a.s AS p0, a.d AS p1, b.d AS p2 {_TRI}"),
    "clique4_count": _sql(f"SELECT count(*) AS cliques {_K4}"),
    "clique5_count": _sql(f"SELECT count(*) AS cliques {_K5}"),
    "clique4_count_all": _sql(f"SELECT count(*) AS cliques {_K4}", False),
    "wedge_induced_count": _sql(f"SELECT count(*) AS wedges {_WEDGE_INDUCED}"),
    "wedge_induced_search": _sql(f"SELECT count(*) AS wedges {_WEDGE_INDUCED}"),
    "wedge_noninduced_count": _sql("SELECT sum(k * (k - 1) // 2)::BIGINT AS wedges FROM dg"),
    "three_motif": _sql(f"SELECT (SELECT count(*) {_TRI}) AS triangle, (SELECT sum(k * (k - 1) // 2)::BIGINT FROM dg) AS wedge_noninduced, (SELECT count(*) {_WEDGE_INDUCED}) AS wedge_induced"),
    "three_star_count": _sql("SELECT sum(k * (k - 1) * (k - 2) // 6)::BIGINT AS stars FROM dg"),
    "three_star_search": _sql("SELECT sum(k * (k - 1) * (k - 2) // 6)::BIGINT AS stars FROM dg"),
    "chain4_induced_count": _sql(f"SELECT count(*) // 2 AS chains {_PATH} WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.s = a.d AND x.d = m.d) AND NOT EXISTS (SELECT 1 FROM u x WHERE x.s = b.d AND x.d = m.s) AND NOT EXISTS (SELECT 1 FROM u x WHERE x.s = a.d AND x.d = b.d)"),
    "chain4_count": _sql(f"SELECT count(*) // 2 AS chains {_PATH}"),
    "cycle4_count": _sql(f"SELECT count(*) // 8 AS cycles {_PATH} JOIN u x ON x.s = a.d AND x.d = b.d"),
    "cycle4_induced_count": _sql(f"SELECT count(*) // 8 AS cycles {_PATH} JOIN u x ON x.s = a.d AND x.d = b.d WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.s = a.d AND y.d = m.d) AND NOT EXISTS (SELECT 1 FROM u y WHERE y.s = b.d AND y.d = m.s)"),
    "tailed_triangle_count": _sql("SELECT sum(k - 2)::BIGINT AS patterns FROM t JOIN dg ON v = c", more=f"t AS (SELECT unnest([a.s, a.d, b.d]) AS c {_TRI})"),
    "diamond_count": _sql("SELECT sum(n * (n - 1) // 2)::BIGINT AS patterns FROM t", more="t AS (SELECT m.s, m.d, count(*) AS n FROM e m JOIN u a ON a.s = m.s JOIN u b ON b.s = m.d AND b.d = a.d GROUP BY m.s, m.d)"),
    "nbr_intersect": _sql("SELECT e.s AS src, e.d AS dst, count(b.d) AS n, coalesce(string_agg(b.d::VARCHAR, ' ' ORDER BY b.d), '') AS ids FROM e JOIN u a ON a.s = e.s LEFT JOIN u b ON b.s = e.d AND b.d = a.d GROUP BY e.s, e.d"),
    "nbr_intersect_bounded": _sql("SELECT e.s AS src, e.d AS dst, count(b.d) AS n FROM e JOIN u a ON a.s = e.s LEFT JOIN u b ON b.s = e.d AND b.d = a.d AND b.d < e.s GROUP BY e.s, e.d"),
    "nbr_except": _sql("SELECT e.s AS src, e.d AS dst, count(*) - count(b.d) AS n FROM e JOIN u a ON a.s = e.s LEFT JOIN u b ON b.s = e.d AND b.d = a.d GROUP BY e.s, e.d"),
    "nbr_except_bounded": _sql("SELECT e.s AS src, e.d AS dst, count(*) FILTER (a.d < e.d AND b.d IS NULL) AS n FROM e JOIN u a ON a.s = e.s LEFT JOIN u b ON b.s = e.d AND b.d = a.d GROUP BY e.s, e.d"),
    "nbr_trims": _sql("SELECT e.s AS src, e.d AS dst, count(*) FILTER (a.d < e.d) AS below, count(*) FILTER (a.d <= e.d) AS up_to FROM e JOIN u a ON a.s = e.s GROUP BY e.s, e.d"),
    "fsm_vertex": _sql(_FSM_VERTEX),
    **{f"fsm_{n}": _sql(_fsm_select(n)) for n in _FSM},
    "fsm_four_chain_compat": _sql(_fsm_select("four_chain", "l0 <= l1")),
    "fsm_summary": _sql(_SUMMARY),
    "trace_volume": _sql("SELECT vid, accesses, volume FROM tv", more=_TRACE),
    "trace_top": _sql("SELECT vid, accesses, volume FROM tv ORDER BY volume DESC, vid LIMIT 10", more=_TRACE),
    "trace_shares": _sql("SELECT part, sum(n) OVER (ORDER BY part)::BIGINT AS vertices, round(100.0 * v / (SELECT sum(volume) FROM tv), 4) AS share FROM (SELECT part, count(*) AS n, max(v)::DOUBLE AS v FROM run GROUP BY part)", more=_TRACE + ", run AS (SELECT ceil(sum(k) OVER w * 40.0 / (SELECT sum(k) FROM dg))::INTEGER AS part, sum(volume) OVER w AS v FROM tv WINDOW w AS (ORDER BY volume DESC, vid ROWS UNBOUNDED PRECEDING))"),
}

_DENSE = "r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM dg), de AS (SELECT a.i AS s, b.i AS d, l FROM e JOIN r a ON a.v = s JOIN r b ON b.v = d JOIN lab ON lab.v = s), du AS (SELECT s, d FROM de UNION ALL SELECT d, s FROM de)"
_SUMS = f"(SELECT count(*) FROM e) AS edges, (SELECT count(*) {_TRI}) AS triangles, (SELECT sum(k * (k - 1) // 2)::BIGINT FROM dg) AS wedges"
_E = "(SELECT count(*) FROM e)::VARCHAR"
ORACLE_SQL |= {
    "graph_file": _sql("SELECT s AS src, d AS dst, l AS src_label FROM de", more=_DENSE),
    "edge_label_file": _sql("SELECT s AS src, d AS dst, (s + d) % 7 AS label FROM du", more=_DENSE),
    "edge_label_file_skipped": _sql("SELECT s AS src, d AS dst FROM du", more=_DENSE),
    "edge_list_file": _sql("SELECT s AS src, d AS dst FROM du", more=_DENSE),
    "label_file": _sql("SELECT i AS id, l AS label FROM r JOIN lab USING (v)", more=_DENSE),
    "text_file": _sql("SELECT s AS src, d AS dst FROM u"),
    # The edge list has a first line with the numbers of vertices and edges.
    "standardized_files": _sql("SELECT f AS file, CASE f WHEN 'biedgelist' THEN n WHEN 'edgelist' THEN n + 1 ELSE 2 * n END AS records, CASE f WHEN 'biedgelist' THEN t WHEN 'edgelist' THEN t + n + (SELECT count(*) FROM r) ELSE 2 * t END::BIGINT AS ids FROM (SELECT count(*) AS n, sum(s + d)::BIGINT AS t FROM de), (VALUES ('biedgelist'), ('edgelist'), ('rs_edgelist'), ('rs_adjlist')) x(f)", more=_DENSE),
    "shuffled_file": _sql(f"SELECT {_SUMS}"),
    "locality_file": _sql(f"SELECT {_SUMS}"),
    # Ranks by (degree, dense id) are those by (degree, id).
    "oriented_file": ORACLE_SQL["degree_rank_edges"],
    "trace_file": ORACLE_SQL["trace_volume"],
    "console_counts": _sql(f"SELECT 'triangle=' || (SELECT count(*) {_TRI}) AS line UNION ALL SELECT 'wedge=' || (SELECT count(*) {_WEDGE_INDUCED}) UNION ALL SELECT 'triangle=' || (SELECT count(*) {_TRI}) || ' wedge_noninduced=' || (SELECT sum(k * (k - 1) // 2)::BIGINT FROM dg) || ' wedge_induced=' || (SELECT count(*) {_WEDGE_INDUCED}) UNION ALL SELECT 'n_self_loops=0 n_dups=0 n_asym=0 degree_sum=' || (SELECT count(*) FROM u) || ' num_edges=' || (SELECT count(*) FROM u)"),
    "console_fsm": _sql("SELECT 'template=' || template || ' patterns=' || patterns || ' total_support=' || total_support AS line FROM (" + _SUMMARY.replace("FROM lab GROUP BY l HAVING", "FROM lab WHERE v IN (SELECT v FROM dg) GROUP BY l HAVING") + ")"),
    "pattern_table": "SELECT * FROM (VALUES ('triangle', 3, 3, true, true, false, 6, 'Pattern: (size:3, num_edges:3) (0, 1) (0, 2) (1, 2)', 0), ('wedge', 3, 2, true, false, false, 2, 'Pattern: (size:3, num_edges:2) (0, 1) (0, 2)', 0), ('clique4', 4, 6, true, true, false, 24, 'Pattern: (size:4, num_edges:6) (0, 1) (0, 2) (0, 3) (1, 2) (1, 3) (2, 3)', 0), ('clique5', 5, 10, true, true, false, 120, 'Pattern: (size:5, num_edges:10) (0, 1) (0, 2) (0, 3) (0, 4) (1, 2) (1, 3) (1, 4) (2, 3) (2, 4) (3, 4)', 0), ('chain4', 4, 3, true, false, false, 2, 'Pattern: (size:4, num_edges:3) (0, 1) (1, 2) (2, 3)', 0), ('cycle4', 4, 4, true, false, true, 8, 'Pattern: (size:4, num_edges:4) (0, 1) (0, 3) (1, 2) (2, 3)', 0), ('cycle5', 5, 5, true, false, true, 10, 'Pattern: (size:5, num_edges:5) (0, 1) (0, 4) (1, 2) (2, 3) (3, 4)', 0), ('star3', 4, 3, true, false, false, 6, 'Pattern: (size:4, num_edges:3) (0, 1) (0, 2) (0, 3)', 0), ('diamond', 4, 5, true, false, false, 4, 'Pattern: (size:4, num_edges:5) (0, 1) (0, 2) (0, 3) (1, 2) (1, 3)', 0), ('split', 4, 2, false, false, false, 8, 'Pattern: (size:4, num_edges:2) (0, 1) (2, 3)', 0), ('bare', 3, 0, false, false, false, 6, 'Pattern: (size:3, num_edges:0)', 0), ('labelled_triangle', 3, 3, true, true, false, 2, 'Pattern: (size:3, num_edges:3) (0, 1) (0, 2) (1, 2)', 0)) t(name, size, n_edges, connected, clique, cycle, automorphisms, text, equals)",
    "labelled_triangle_count": _sql("SELECT count(*) // 2 AS patterns FROM lu a JOIN lu b ON a.s = b.s JOIN u c ON c.s = a.d AND c.d = b.d WHERE a.ls = 1 AND a.ld = 0 AND b.ld = 0"),
    "labelled_wedge_count": _sql("SELECT count(*) AS patterns FROM lu a JOIN lu b ON a.s = b.s AND a.d <> b.d WHERE a.ls = 2 AND a.ld = 1 AND NOT EXISTS (SELECT 1 FROM u x WHERE x.s = a.d AND x.d = b.d)"),
    "labelled_chain_count": _sql("SELECT count(*) // 2 AS patterns FROM u m JOIN lu a ON a.s = m.s AND a.d <> m.d JOIN lu b ON b.s = m.d AND b.d <> m.s AND b.d <> a.d WHERE a.ld = 3 AND b.ld = 3"),
    "labelled_start_count": _sql("SELECT sum(k * (k - 1) // 2)::BIGINT AS patterns FROM dg JOIN lab USING (v) WHERE l = 4"),
}
