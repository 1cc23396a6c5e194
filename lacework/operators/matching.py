"""Runs extension plans: matches and counts of a pattern in a graph.

The default strategy carries, for each vertex matched so far, the sorted list of its neighbours as long as a later step
looks at it; the candidates of the next vertex are array operations on these lists, and the last vertex is counted
without being listed. The other strategy is plain joins of the edge table, for small graphs and as an independent check.
Cliques run on the oriented graph, where the order restrictions hold by themselves and lists are short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacework.functions import setops
from lacework.operators.graph import Graph
from lacework.plans.compiler import Plan, compile_pattern
from lacework.plans.pattern import Pattern

#: The widest count, for graphs where a count may pass 2^63 - 1.
WIDE = "decimal(38,0)"


def _candidates(plan: Plan, k: int) -> Column:
    """The ids that may stand at place k, from the lists of the places before it."""
    step = plan.steps[k - 1]
    lists = [F.col(f"n{i}") for i in step.back]
    found = reduce(setops.intersect, lists[1:], lists[0])
    found = reduce(setops.difference, [F.col(f"n{i}") for i in step.anti], found)
    # A vertex isn't in its own list, so the lists of others don't keep it from being met again.
    apart = {i for i in (*step.apart, *step.anti) if i not in step.above + step.below}
    if not (step.above or step.below or apart):
        return found

    def passes(x: Column) -> Column:
        tests = [x > F.col(f"v{i}") for i in step.above] + [x < F.col(f"v{i}") for i in step.below] + [x != F.col(f"v{i}") for i in sorted(apart)]
        return reduce(lambda a, b: a & b, tests)

    return F.filter(found, passes)


def _labelled(graph: Graph, plan: Plan, k: int, rows: DataFrame) -> DataFrame:
    """The rows whose vertex at place k has the label that the pattern asks for there."""
    label = plan.pattern.label(plan.order[k])
    return rows if label is None else rows.join(graph.vertices_with_label(label).select(F.col("id").alias(f"v{k}")), f"v{k}", "left_semi")


def _extend(graph: Graph, plan: Plan, last: int) -> DataFrame:
    """Partial matches v0 .. v(last - 1), with the lists that later steps need."""
    adj = graph.adj
    rows = _labelled(graph, plan, 0, adj.select(F.col("id").alias("v0"), F.col("nbrs").alias("n0")))
    for k in range(1, last):
        keep = [f"v{i}" for i in range(k)] + [f"n{i}" for i in range(k) if any(i in s.back + s.anti for s in plan.steps[k:])]
        rows = rows.withColumn("_c", F.explode(_candidates(plan, k))).select(*keep, F.col("_c").alias(f"v{k}"))
        rows = _labelled(graph, plan, k, rows)
        if plan.lists_needed(k):
            rows = rows.join(adj.select(F.col("id").alias(f"v{k}"), F.col("nbrs").alias(f"n{k}")), f"v{k}")
    return rows


def matches(graph: Graph, pattern: Pattern, induced: bool = False) -> DataFrame:
    """One row for each match, (p0, p1, ...) by pattern vertex; of the automorphic images of a match, one."""
    plan = compile_pattern(pattern, induced)
    n = pattern.size
    rows = _labelled(graph, plan, n - 1, _extend(graph, plan, n - 1).withColumn(f"v{n - 1}", F.explode(_candidates(plan, n - 1))))
    return rows.select(*(F.col(f"v{plan.order.index(p)}").alias(f"p{p}") for p in range(n)))


def count(graph: Graph, pattern: Pattern, induced: bool = False, wide: bool = False) -> DataFrame:
    """One row (n): how many matches, each counted once. With labels the last vertex is listed too, to look at its label."""
    if pattern.labels and any(x is not None for x in pattern.labels):
        return matches(graph, pattern, induced).agg(_total(F.lit(1), wide).alias("n"))
    if pattern.is_clique():
        return count_cliques(graph, pattern.size, wide)
    plan = compile_pattern(pattern, induced)
    rows = _extend(graph, plan, pattern.size - 1)
    return rows.agg(_total(F.size(_candidates(plan, pattern.size - 1)), wide).alias("n"))


def _total(sizes: Column, wide: bool) -> Column:
    return F.coalesce(F.sum(sizes.cast(WIDE if wide else "long")), F.lit(0)).cast(WIDE if wide else "long")


def _clique_rows(graph: Graph, k: int) -> DataFrame:
    """Rows of the first k - 1 vertices of cliques, with prefix: the common out-neighbours of all of them. Rows with
    too few of these for the vertices still to come go at once."""
    out = graph.out
    rows = out.select(F.col("id").alias("v0"), F.col("nbrs").alias("prefix"))
    for depth in range(1, k - 1):
        need = k - depth  # vertices to come, the one exploded included
        rows = rows.where(F.size("prefix") >= need).withColumn("_v", F.explode("prefix"))
        rows = rows.join(out.select(F.col("id").alias("_v"), F.col("nbrs").alias("_n")), "_v")
        rows = rows.select(*(f"v{i}" for i in range(depth)), F.col("_v").alias(f"v{depth}"), setops.intersect(F.col("prefix"), F.col("_n")).alias("prefix"))
    return rows.where(F.size("prefix") >= 1)


def count_cliques(graph: Graph, k: int, wide: bool = False) -> DataFrame:
    """One row (n): the cliques of k vertices, each once."""
    return _clique_rows(graph, k).agg(_total(F.size("prefix"), wide).alias("n"))


def list_cliques(graph: Graph, k: int) -> DataFrame:
    """(p0, p1, ...) of each clique, ids ascending."""
    rows = _clique_rows(graph, k).withColumn("_v", F.explode("prefix"))
    ids = F.array_sort(F.array(*(F.col(f"v{i}") for i in range(k - 1)), F.col("_v")))
    return rows.select(*(F.element_at(ids, i + 1).alias(f"p{i}") for i in range(k)))


def count_by_joins(graph: Graph, pattern: Pattern, induced: bool = False) -> DataFrame:
    """count() by joins of the edge table alone."""
    plan = compile_pattern(pattern, induced)
    und = graph.und
    rows = und.select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    for k in range(1, pattern.size):
        step = plan.steps[k - 1]
        first, *others = step.back
        if k > 1:
            rows = rows.join(und.select(F.col("src").alias(f"v{first}"), F.col("dst").alias(f"v{k}")), f"v{first}")
        for i in others:
            rows = rows.join(und.select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{k}")), [f"v{i}", f"v{k}"])
        for i in step.anti:
            rows = rows.join(und.select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{k}")), [f"v{i}", f"v{k}"], "left_anti")
        v = F.col(f"v{k}")
        for i in range(k):
            if i in step.above:
                rows = rows.where(v > F.col(f"v{i}"))
            elif i in step.below:
                rows = rows.where(v < F.col(f"v{i}"))
            elif i not in step.back:
                rows = rows.where(v != F.col(f"v{i}"))
    return rows.agg(F.count("*").alias("n"))
