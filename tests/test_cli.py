"""The command line, end to end over a small file."""

import struct

from lacework.__main__ import parser, run


def test_commands(spark, tmp_path):
    say = lambda *words: run(spark, parser().parse_args([str(w) for w in words]))
    raw, labels = tmp_path / "paw.biedgelist", tmp_path / "paw.binodelabel"
    raw.write_bytes(struct.pack("<8I", 0, 1, 0, 2, 1, 2, 2, 3))
    labels.write_bytes(struct.pack("<4I", 0, 0, 1, 1))
    (graph,) = say("convert", raw, tmp_path / "paw", 4, "--vertex-labels", labels)
    assert say("validate", graph) == ["n_self_loops=0 n_dups=0 n_asym=0 degree_sum=8 num_edges=8"]
    assert say("count", "triangle", graph) == ["triangle=1"] and say("count", "wedge", graph, "--induced") == ["wedge=2"]
    assert say("motif", graph) == ["triangle=1 wedge_noninduced=5 wedge_induced=2"]
    assert "template=wedge patterns=3 total_support=3" in say("fsm", graph, 1)
    assert say("degrees", graph)[-1] == "three_stars=1"
    (shuffled,) = say("edgelist", graph, tmp_path / "mixed", "--ids", "shuffled")
    (again,) = say("convert", shuffled, tmp_path / "again", 4, "--directed")
    assert say("count", "triangle", again) == ["triangle=1"]
    say("adjacency", graph, tmp_path / "adj")
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "adj")).collect()) == ["0 0 1 2", "1 0 0 2", "2 1 0 1 3", "3 1 2"]
    say("export", graph, tmp_path / "txt")
    assert spark.read.text(str(tmp_path / "txt")).count() == 8
    assert say("orient", graph, tmp_path / "ori") == [f"{tmp_path}/ori.dgraph"]
