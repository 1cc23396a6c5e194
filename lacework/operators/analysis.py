"""Statistics of graphs and of request traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacework.operators.graph import Graph, number_rows


def max_degree(graph: Graph) -> DataFrame:
    return graph.degrees.agg(F.coalesce(F.max("degree"), F.lit(0)).cast("long").alias("max_degree"))


def degree_histogram(graph: Graph) -> DataFrame:
    """(degree, vertices)"""
    return graph.degrees.groupBy("degree").agg(F.count("*").alias("vertices"))


def degree_shares(graph: Graph, parts: int = 10) -> DataFrame:
    """(part, vertices, share): the share of all edge ends, in percent, that the ceil(part * V / parts) vertices with the
    largest degrees have. Works on the histogram of degrees, so the vertices aren't sorted: in a part's last degree class
    some vertices count, each with that degree."""
    h = degree_histogram(graph)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumns({"v_before": F.coalesce(F.sum("vertices").over(w), F.lit(0)), "d_before": F.coalesce(F.sum(F.col("degree") * F.col("vertices")).over(w), F.lit(0))})
    n, ends = graph.degrees.agg(F.count("*"), F.sum("degree")).first()
    cuts = [(b, (b * n + parts - 1) // parts) for b in range(1, parts + 1)] if n else []
    cut = F.explode(F.array(*(F.struct(F.lit(b).alias("part"), F.lit(m).cast("long").alias("m")) for b, m in cuts)) if cuts else F.array().cast("array<struct<part:int,m:bigint>>"))
    inside = h.withColumn("cut", cut).where("cut.m > v_before and cut.m <= v_before + vertices")
    return inside.select(F.col("cut.part").alias("part"), F.col("cut.m").alias("vertices"), F.round(100.0 * (F.col("d_before") + (F.col("cut.m") - F.col("v_before")) * F.col("degree")) / F.lit(ends or 1), 4).alias("share"))


def label_histogram(graph: Graph) -> DataFrame:
    return graph.labels.groupBy("label").agg(F.count("*").alias("vertices"))


def partition_stats(graph: Graph, partitions: int) -> DataFrame:
    """(part, vertices, edges): what hash partitioning by id gives each part; edges count in both directions."""
    return graph.degrees.groupBy(F.pmod("id", F.lit(partitions)).cast("int").alias("part")).agg(F.count("*").alias("vertices"), F.sum("degree").alias("edges"))


def hubs(graph: Graph, threshold: int = 2**30) -> DataFrame:
    return graph.degrees.where(F.col("degree") > threshold)


def trace_volume(requests: DataFrame, degrees: DataFrame, id_bytes: int = 4) -> DataFrame:
    """(vid, accesses, volume) of a request trace (vid, degree): requests whose degree isn't the graph's go; the volume is
    the bytes of the neighbour lists that were sent."""
    good = requests.join(degrees.select(F.col("id").alias("vid"), F.col("degree").alias("_d")), "vid").where(F.col("degree") == F.col("_d"))
    return good.groupBy("vid", "degree").agg(F.count("*").alias("accesses")).select("vid", "accesses", (F.col("degree") * F.col("accesses") * id_bytes).alias("volume"))


def trace_shares(volumes: DataFrame, degrees: DataFrame, parts: int = 40) -> DataFrame:
    """(part, vertices, share): vertices by falling volume are cached until part / parts of the graph's list bytes are
    used; share is the volume that they have, in percent. The vertices are numbered by ranges and summed by part, so no
    task sees all of them."""
    total = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0] or 1
    ranked = number_rows(volumes.join(degrees.withColumnRenamed("id", "vid"), "vid"), [F.desc("volume"), F.asc("vid")], "rank")
    size = 4096
    block = F.expr(f"rank div {size}")
    sums = ranked.groupBy(block.alias("block")).agg(F.sum("degree").alias("bd"), F.sum("volume").alias("bv"))
    over = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("bd").over(over), F.lit(0)).alias("d0"), F.coalesce(F.sum("bv").over(over), F.lit(0)).alias("v0"))
    inside = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = ranked.withColumn("block", block).join(sums, "block").select((F.col("d0") + F.sum("degree").over(inside)).alias("d"), (F.col("v0") + F.sum("volume").over(inside)).alias("v"))
    part = F.ceil(F.col("d") * parts / total).cast("int")
    everything = volumes.agg(F.coalesce(F.sum("volume"), F.lit(0))).first()[0] or 1
    steps = run.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max("v").alias("v"))
    up = Window.partitionBy(F.lit(0)).orderBy("part")
    return steps.select("part", F.sum("n").over(up).alias("vertices"), F.round(100.0 * F.col("v") / everything, 4).alias("share"))


def top_volumes(volumes: DataFrame, k: int = 10) -> DataFrame:
    return volumes.orderBy(F.desc("volume"), "vid").limit(k)
