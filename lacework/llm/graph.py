"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacework.llm.common import materialize

#: Links that one task may finish by union-find, about 100 MB there.
LAST_LINKS = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict = {}

    def root(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    kind = batch.schema.field(0).type if nodes else pa.binary()
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "to"])


def components(links: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """(node, component) of every node in links (a, b); component is one of its nodes.

    In each round every node takes the least of itself and its neighbours, in an order that is shuffled
    anew by a hash; links are relabelled and those inside a component go. A constant share of the nodes
    is expected to vanish in a round, whatever the shape (stars take one or two rounds). Everything stays
    distributed: minima are summed before the shuffle, hot nodes are met in joins only, and every round is
    a table in the shared folder. Once at most last_links links are left, which saves the last rounds and changes no
    result, one task joins them by union-find.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    node = links.schema["a"].dataType.simpleString()
    while n := links.count():
        if n <= last_links:
            steps.append(materialize(links.coalesce(1).mapInArrow(_union_find, f"node {node}, to {node}"), "step"))
            break
        rank = lambda c, k=len(steps): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("b"))
        step = materialize(least.select(F.col("a").alias("node"), F.least(rank("a"), F.col("b"))["n"].alias("to")), "step")
        steps.append(step)
        moved = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        links = materialize(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(found, "components")
