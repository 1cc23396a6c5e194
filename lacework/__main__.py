"""Command line: python -m lacework COMMAND ...

    count PATTERN GRAPH [--induced]     matches of a pattern: triangle, clique4, clique5, wedge, chain4, chain5, cycle4, cycle5, star3
    motif GRAPH                         triangles and wedges of both kinds
    fsm GRAPH THRESHOLD                 frequent labelled patterns of each template
    convert IN OUT VERTICES [--vertex-labels FILE] [--edge-labels] [--directed]
    validate GRAPH | degrees GRAPH
    export GRAPH OUT                    text, both directions
    edgelist GRAPH OUT [--ids shuffled|locality]
    adjacency GRAPH OUT | orient GRAPH OUT
    standardize TEXT OUT

Graphs are .dgraph files.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lacework.operators import analysis, fsm, motif
from lacework.operators.graph import InvalidGraph, check_edges
from lacework.operators.matching import count
from lacework.plans.pattern import TRIANGLE, WEDGE, chain, clique, cycle, star
from lacework.sources import binary, text

PATTERNS = {"triangle": TRIANGLE, "clique4": clique(4), "clique5": clique(5), "wedge": WEDGE, "chain4": chain(4), "chain5": chain(5), "cycle4": cycle(4), "cycle5": cycle(5), "star3": star(3)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lacework", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options: dict) -> None:
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        for flag, how in options.items():
            p.add_argument("--" + flag.replace("_", "-"), **how)

    switch = {"action": "store_true"}
    add("count", "pattern", "graph", induced=switch)
    add("motif", "graph")
    add("fsm", "graph", "threshold")
    add("convert", "source", "out", "vertices", vertex_labels={}, edge_labels=switch, directed=switch)
    add("validate", "graph")
    add("degrees", "graph")
    add("export", "graph", "out")
    add("edgelist", "graph", "out", ids={"choices": ["shuffled", "locality"]})
    add("adjacency", "graph", "out")
    add("orient", "graph", "out")
    add("standardize", "source", "out")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Does what args say and returns the lines to print."""
    lines = lambda df: [" ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in df.collect()]
    if args.command == "convert":
        edges = binary.read_edge_list(spark, args.source, args.edge_labels)
        labels = binary.read_labels(spark, args.vertex_labels, int(args.vertices)) if args.vertex_labels else None
        return [binary.write_graph(edges, args.out, int(args.vertices), labels, args.directed)]
    if args.command == "standardize":
        _, v = text.standardized_outputs(text.read_edges(spark, args.source), args.out)
        return [f"vertices={v}"]
    if args.command == "validate":
        found = check_edges(binary.read_directed(spark, args.graph)).first()
        said = " ".join(f"{k}={v}" for k, v in found.asDict().items())
        if found.n_self_loops or found.n_dups or found.n_asym:
            raise InvalidGraph(said)
        return [said]
    h = binary.read_header(args.graph)
    graph = binary.read_graph(spark, args.graph, labels=h.vertex_labels and args.command in ("fsm", "adjacency")).cache()
    if args.command == "count":
        return [f"{args.pattern}={count(graph, PATTERNS[args.pattern], args.induced).first()[0]}"]
    if args.command == "motif":
        return lines(motif.three_motif(graph))
    if args.command == "fsm":
        return lines(fsm.mine_frequent(graph, int(args.threshold)).summary())
    if args.command == "degrees":
        return lines(analysis.degree_shares(graph).orderBy("part")) + [f"three_stars={motif.three_stars(graph).first()[0]}"]
    if args.command == "export":
        text.export_graph(graph, args.out)
    elif args.command == "adjacency":
        text.write_lines(text.adjacency_lines(graph), args.out)
    elif args.command == "orient":
        return [binary.write_oriented(graph, args.out)]
    elif args.command == "edgelist":
        ids = {"shuffled": graph.shuffled_ids, "locality": graph.locality_ids}.get(args.ids)
        return [binary.write_edge_list((graph.relabel(ids().select("id", "new_id")) if ids else graph).und, args.out)]
    return [args.out]


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("lacework").getOrCreate()
    print("\n".join(run(spark, args)))


if __name__ == "__main__":
    sys.exit(main())
