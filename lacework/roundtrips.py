"""Queries that write the formats of lacework.sources and read them back."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacework import __main__ as command_line
from lacework.operators import analysis, motif
from lacework.operators.graph import Graph, shared_folder
from lacework.plans.pattern import Pattern, chain, clique, cycle, star
from lacework.sources import binary, text


def _dense(graph: Graph) -> tuple[Graph, DataFrame, int]:
    dense, ids = graph.densify()
    return dense, ids, ids.count()


def _file(graph: Graph, name: str) -> str:
    return f"{shared_folder(graph.edges.sparkSession)}-{name}"


def graph_file(graph: Graph) -> DataFrame:
    """Edges and labels of a labelled graph file: (src, dst, src_label)."""
    dense, ids, v = _dense(graph)
    labels = graph.labels.join(ids, "id").select(F.col("new_id").alias("id"), "label")
    back = binary.read_graph(graph.edges.sparkSession, binary.write_graph(dense.edges, _file(graph, "g"), v, labels), labels=True)
    return back.edges.join(back.labels.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").select("src", "dst", "src_label")


def edge_label_file(graph: Graph, labels: bool) -> DataFrame:
    """Stored edges of a file with edge labels: (src, dst[, label]), both directions."""
    dense, _, v = _dense(graph)
    path = binary.write_graph(dense.edges.withColumn("label", (F.col("src") + F.col("dst")) % 7), _file(graph, "e"), v)
    return binary.read_directed(graph.edges.sparkSession, path, edge_labels=labels)


def edge_list_file(graph: Graph) -> DataFrame:
    return binary.read_edge_list(graph.edges.sparkSession, binary.write_edge_list(_dense(graph)[0].und, _file(graph, "l")))


def label_file(graph: Graph) -> DataFrame:
    _, ids, v = _dense(graph)
    path = _file(graph, "n") + ".binodelabel"
    labels = graph.labels.join(ids, "id").select("new_id", F.col("label").cast("long").alias("label"))
    binary.write_packed([labels.repartitionByRange(4, "new_id").sortWithinPartitions("new_id").select("label")], path)
    return binary.read_labels(graph.edges.sparkSession, path, v)


def text_file(graph: Graph) -> DataFrame:
    path = _file(graph, "t")
    text.export_graph(graph, path)
    return text.read_edges(graph.edges.sparkSession, path)


def standardized_files(raw: DataFrame) -> DataFrame:
    """How many records the four files of the standardiser have, and the sums of their ids."""
    spark = raw.sparkSession
    path = f"{shared_folder(spark)}-s"
    text.standardized_outputs(raw, path)
    sums = lambda df, name: df.agg(F.count("*").alias("records"), (F.sum("src") + F.sum("dst")).cast("long").alias("ids")).select(F.lit(name).alias("file"), "records", "ids")
    adjacency = spark.read.text(f"{path}.rs_adjlist").select(F.split("value", " ").cast("array<bigint>").alias("x"))
    adjacency = adjacency.select(F.element_at("x", 1).alias("src"), F.explode(F.slice("x", 3, F.size("x"))).alias("dst"))
    found = [sums(binary.read_edge_list(spark, f"{path}.biedgelist"), "biedgelist"), sums(text.read_edges(spark, f"{path}.edgelist"), "edgelist"), sums(text.read_edges(spark, f"{path}.rs_edgelist"), "rs_edgelist"), sums(adjacency, "rs_adjlist")]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def relabelled_file(graph: Graph, kind: str) -> DataFrame:
    """Counts that no relabelling changes, of an edge list under other ids."""
    ids = graph.shuffled_ids() if kind == "shuffled" else graph.locality_ids(seed_degree=16).select("id", "new_id")
    back = Graph.from_edges(binary.read_edge_list(graph.edges.sparkSession, binary.write_edge_list(graph.relabel(ids).und, _file(graph, kind))))
    one = lambda df, name: df.toDF(name).withColumn("_k", F.lit(1))
    return one(back.edges.agg(F.count("*")), "edges").join(one(motif.triangles(back), "triangles"), "_k").join(one(motif.wedges(back), "wedges"), "_k").drop("_k")


def oriented_file(graph: Graph) -> DataFrame:
    return binary.read_directed(graph.edges.sparkSession, binary.write_oriented(_dense(graph)[0], _file(graph, "o")))


def trace_file(requests: DataFrame, graph: Graph) -> DataFrame:
    """requests (vid): written as a trace and analysed from there."""
    path = _file(graph, "trace")
    lines = requests.join(graph.degrees.withColumnRenamed("id", "vid"), "vid").select(F.concat_ws(",", "vid", "degree").alias("value"))
    head = requests.sparkSession.createDataFrame([("vid,degree",)], "value string")
    text.write_lines(head.union(lines), path)
    return analysis.trace_volume(text.read_trace(requests.sparkSession, path), graph.degrees)


def console(graph: Graph, words: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(line): what the command line says about a file of the graph."""
    spark = graph.edges.sparkSession
    dense, ids, v = _dense(graph)
    labels = graph.labels.join(ids, "id").select(F.col("new_id").alias("id"), "label") if graph.is_labelled else None
    path = binary.write_graph(dense.edges, _file(graph, "c"), v, labels)
    said = [line for w in words for line in command_line.run(spark, _parsed(w, path))]
    return spark.createDataFrame([(line,) for line in said], "line string")


def _parsed(words: tuple[str, ...], path: str) -> argparse.Namespace:
    return command_line.parser().parse_args([path if w == "FILE" else w for w in words])


PATTERNS = {
    "triangle": clique(3), "wedge": star(2), "clique4": clique(4), "clique5": clique(5), "chain4": chain(4), "cycle4": cycle(4), "cycle5": cycle(5), "star3": star(3),
    "diamond": Pattern.of(4, [(0, 1), (1, 2), (0, 2), (0, 3)]).add_edge(1, 3), "split": Pattern.of(4, [(0, 1), (2, 3)]), "bare": clique(3).clear_edges(), "labelled_triangle": Pattern.of(3, [(0, 1), (1, 2), (0, 2)], [0, 0, 1]),
}


def pattern_table(spark: SparkSession) -> DataFrame:
    """What can be said about patterns, and which of them are equal to another."""
    rows = [(name, p.size, len(p.edges), p.is_connected(), p.is_clique(), p.is_cycle(), p.multiplicity(), str(p), sum(p == q for q in PATTERNS.values()) - 1) for name, p in PATTERNS.items()]
    return spark.createDataFrame(rows, "name string, size int, n_edges int, connected boolean, clique boolean, cycle boolean, automorphisms int, text string, equals int")
