"""Text formats: edge lists, adjacency lists, request traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacework.operators.graph import Graph


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines "src dst", split at white space; lines that start with # and empty lines are left out."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return rows.select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.get(parts, F.lit(1)).cast("long").alias("dst"))


def read_trace(spark: SparkSession, glob: str) -> DataFrame:
    """(vid, degree) of the request traces that match: lines "vid,degree" after a header of two words."""
    parts = F.split("value", ",")
    return spark.read.text(glob).where(F.col("value").rlike(r"^\s*\d+\s*,\s*\d+\s*$")).select(F.trim(F.get(parts, F.lit(0))).cast("long").alias("vid"), F.trim(F.get(parts, F.lit(1))).cast("long").alias("degree"))


def edge_lines(directed: DataFrame) -> DataFrame:
    """(value) lines "src dst"."""
    return directed.select(F.concat_ws(" ", "src", "dst").alias("value"))


def adjacency_lines(graph: Graph) -> DataFrame:
    """(value) lines "id label neighbour ...", label 0 where there are none."""
    adj = graph.adj
    label = F.lit("0")
    if graph.is_labelled:
        adj = adj.join(graph.labels, "id", "left")
        label = F.coalesce(F.col("label"), F.lit(0)).cast("string")
    return adj.select(F.concat_ws(" ", F.col("id").cast("string"), label, F.col("nbrs").cast("array<string>")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def export_graph(graph: Graph, path: str) -> None:
    """Both directions of every edge, a line each."""
    write_lines(edge_lines(graph.und), path)


def standardized_outputs(raw: DataFrame, path: str) -> tuple[Graph, int]:
    """From a raw edge table: drops self-loops and isolated ids, numbers the rest densely, and writes path.biedgelist,
    path.edgelist (a first line "V E", in a file of its own that sorts first), path.rs_edgelist (both directions) and
    path.rs_adjlist. Returns the graph and its number of vertices."""
    from lacework.sources.binary import write_edge_list

    graph, ids = Graph.from_edges(raw).densify()
    v, e = ids.count(), graph.edges.count()
    write_edge_list(graph.edges, path)
    spark = raw.sparkSession
    head = spark.createDataFrame([(f"{v} {e}",)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}.edgelist")
    edge_lines(graph.edges.orderBy("src", "dst")).write.mode("append").text(f"{path}.edgelist")
    write_lines(edge_lines(graph.und), f"{path}.rs_edgelist")
    write_lines(adjacency_lines(graph), f"{path}.rs_adjlist")
    return graph, v
