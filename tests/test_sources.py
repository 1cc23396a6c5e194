"""Round trips of the binary and text formats, and refused files."""

import struct

import pytest

from lacework.operators.graph import Graph, InvalidGraph
from lacework.sources import binary, text

EDGES = [(0, 1), (0, 2), (1, 2), (2, 3), (5, 6)]


def pairs(df):
    return sorted(tuple(x) for x in df.select("src", "dst").collect())


def edges_df(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src long, dst long")


@pytest.mark.parametrize("labelled", [False, True])
def test_graph_file(spark, tmp_path, labelled):
    labels = spark.createDataFrame([(i, i % 3) for i in range(8)], "id long, label int") if labelled else None
    path = binary.write_graph(edges_df(spark), str(tmp_path / "g"), 8, labels)
    assert path.endswith(".dgraph")
    data = open(path, "rb").read()
    assert struct.unpack_from("<IQii", data) == (8, 10, int(labelled), 0) and len(data) == 20 + 32 * labelled + 80
    stored = [struct.unpack_from("<II", data, len(data) - 80 + 8 * k) for k in range(10)]
    assert stored == sorted(EDGES + [(b, a) for a, b in EDGES])
    g = binary.read_graph(spark, path, labels=labelled)
    assert pairs(g.edges) == EDGES and g.vertices.count() == 8
    if labelled:
        assert {tuple(x) for x in g.labels.collect()} == {(i, i % 3) for i in range(8)}
    else:
        with pytest.raises(InvalidGraph):
            binary.read_graph(spark, path, labels=True)
    assert {(x.id, x.degree) for x in g.degrees.collect()} == {(0, 2), (1, 2), (2, 3), (3, 1), (4, 0), (5, 1), (6, 1), (7, 0)}


def test_small_ranges(spark, tmp_path):
    path = binary.write_edge_list(edges_df(spark), str(tmp_path / "e"))
    assert pairs(binary.read_edge_list(spark, path)) == EDGES
    split = binary.read_packed(spark, path, "src,dst", 2, task_rows=2)
    assert split.rdd.getNumPartitions() == 3 and pairs(split) == EDGES
    assert pairs(binary.read_packed(spark, path, "src", 2).selectExpr("src", "src as dst")) == sorted((a, a) for a, _ in EDGES)


def test_empty_graph_file(spark, tmp_path):
    path = binary.write_graph(edges_df(spark, []), str(tmp_path / "none"), 0)
    assert binary.read_graph(spark, path).edges.count() == 0


def test_edge_labels_and_refusals(spark, tmp_path):
    labelled = spark.createDataFrame([(0, 1, 7), (1, 2, 9)], "src long, dst long, label long")
    path = binary.write_graph(labelled, str(tmp_path / "el"), 3)
    assert sorted(tuple(x) for x in binary.read_directed(spark, path, edge_labels=True).collect()) == [(0, 1, 7), (1, 0, 7), (1, 2, 9), (2, 1, 9)]
    assert pairs(binary.read_directed(spark, path)) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    with pytest.raises(InvalidGraph):
        binary.read_graph(spark, path)
    for rows, v in (([(1, 1)], 2), ([(0, 1), (0, 1)], 2), ([(0, 5)], 3)):
        with pytest.raises(InvalidGraph):
            binary.write_graph(edges_df(spark, rows), str(tmp_path / "bad"), v)
    (tmp_path / "cut.dgraph").write_bytes(struct.pack("<IQii", 3, 2, 0, 0) + b"\0" * 8)
    with pytest.raises(InvalidGraph):
        binary.read_graph(spark, str(tmp_path / "cut.dgraph"))
    (tmp_path / "x.biedgelist").write_bytes(b"\0" * 12)
    with pytest.raises(InvalidGraph):
        binary.read_edge_list(spark, str(tmp_path / "x.biedgelist"))
    (tmp_path / "l.binodelabel").write_bytes(struct.pack("<3I", 4, 5, 6))
    assert {tuple(x) for x in binary.read_labels(spark, str(tmp_path / "l.binodelabel"), 3).collect()} == {(0, 4), (1, 5), (2, 6)}
    with pytest.raises(InvalidGraph):
        binary.read_labels(spark, str(tmp_path / "l.binodelabel"), 4)


def test_oriented_file(spark, tmp_path):
    path = binary.write_oriented(Graph.from_edges(edges_df(spark)), str(tmp_path / "o"))
    h = binary.read_header(path)
    rows = pairs(binary.read_directed(spark, path))
    assert (h.vertices, h.edges) == (6, 5) and all(a < b for a, b in rows)


def test_text(spark, tmp_path):
    raw = tmp_path / "snap.txt"
    raw.write_text("# a\n# b\n# c\n# d\n10\t20\n20 10\n\n30   10\n30\t30\n40\t40\n")
    edges = text.read_edges(spark, str(raw))
    assert edges.count() == 5
    g, v = text.standardized_outputs(edges, str(tmp_path / "out"))
    assert v == 3 and pairs(g.edges) == [(0, 1), (0, 2)]
    lines = lambda ext: sorted(x.value for x in spark.read.text(str(tmp_path / f"out.{ext}")).collect())
    assert lines("edgelist") == ["0 1", "0 2", "3 2"] and lines("rs_edgelist") == ["0 1", "0 2", "1 0", "2 0"]
    assert lines("rs_adjlist") == ["0 0 1 2", "1 0 0", "2 0 0"]
    assert pairs(binary.read_edge_list(spark, str(tmp_path / "out.biedgelist"))) == [(0, 1), (0, 2)]
    (tmp_path / "node_0_socket_0.txt").write_text("vid degree\n1,3\n1,3\n")
    (tmp_path / "node_0_socket_1.txt").write_text("vid degree\n2,1\n")
    assert sorted(tuple(x) for x in text.read_trace(spark, str(tmp_path / "node_*_socket_*.txt")).collect()) == [(1, 3), (1, 3), (2, 1)]
