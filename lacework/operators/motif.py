"""Counts of named patterns, by the cheapest way to each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacework.operators.graph import Graph
from lacework.operators.matching import count_cliques


def triangles(graph: Graph) -> DataFrame:
    return count_cliques(graph, 3)


def cliques(graph: Graph, k: int) -> DataFrame:
    return count_cliques(graph, k)


def _degree_sums(graph: Graph) -> DataFrame:
    d = F.col("degree")
    return graph.degrees.agg(F.coalesce(F.sum(F.expr("degree * (degree - 1) div 2")), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(F.when(d > 2, F.expr("degree * (degree - 1) div 2 * (degree - 2) div 3"))), F.lit(0)).cast("long").alias("triples"))


def wedges(graph: Graph) -> DataFrame:
    """One row (n): pairs of neighbours of one vertex, whether or not they are neighbours themselves."""
    return _degree_sums(graph).select(F.col("pairs").alias("n"))


def three_stars(graph: Graph) -> DataFrame:
    """One row (n): triples of neighbours of one vertex."""
    return _degree_sums(graph).select(F.col("triples").alias("n"))


def three_motif(graph: Graph) -> DataFrame:
    """One row (triangle, wedge_noninduced, wedge_induced): every triangle closes three wedges, so one count of triangles
    serves all."""
    one = lambda d: d.withColumn("_k", F.lit(1))
    both = one(triangles(graph).withColumnRenamed("n", "triangle")).join(one(wedges(graph).withColumnRenamed("n", "wedge_noninduced")), "_k")
    return both.select("triangle", "wedge_noninduced", (F.col("wedge_noninduced") - 3 * F.col("triangle")).alias("wedge_induced"))


def wedges_induced(graph: Graph) -> DataFrame:
    """One row (n): wedges whose ends aren't neighbours."""
    return three_motif(graph).select(F.col("wedge_induced").alias("n"))


def induced_wedge_searches(graph: Graph) -> DataFrame:
    """One row (n): induced wedges as an ordered search meets them, each twice, divided by that multiplicity; the
    division must leave nothing."""
    from lacework.operators.matching import _candidates
    from lacework.plans.compiler import Plan, Step
    from lacework.plans.pattern import WEDGE

    plan = Plan(WEDGE, True, (0, 1, 2), frozenset(), (Step((0,), (), (), (), ()), Step((0,), (1,), (), (), ())))
    adj = graph.adj
    rows = adj.select(F.col("id").alias("v0"), F.col("nbrs").alias("n0")).withColumn("v1", F.explode("n0"))
    rows = rows.join(adj.select(F.col("id").alias("v1"), F.col("nbrs").alias("n1")), "v1")
    total = F.coalesce(F.sum(F.size(_candidates(plan, 2)).cast("long")), F.lit(0))
    return rows.agg(total.alias("t")).select(F.when(F.col("t") % 2 == 0, F.expr("t div 2")).otherwise(F.raise_error("a multiplicity doesn't divide the count")).cast("long").alias("n"))
