"""Micro graphs, identities, brute force and cross-plan checks."""

import random
from itertools import combinations, permutations

import pytest

from lacework.functions import setops
from lacework.operators import analysis, fsm, motif
from lacework.operators.graph import Graph, InvalidGraph, check_edges
from lacework.operators.matching import count, count_by_joins, count_cliques, list_cliques, matches
from lacework.plans.compiler import breaks_symmetry, compile_pattern
from lacework.plans.pattern import TRIANGLE, WEDGE, Pattern, chain, clique, cycle, star

MICRO = {
    "K5": (list(combinations(range(5), 2)), (10, 5, 1, 30, 0, 20)),
    "K6-e": ([e for e in combinations(range(6), 2) if e != (0, 5)], (16, 9, 2, 52, 4, 48)),
    "C5": ([(i, (i + 1) % 5) for i in range(5)], (0, 0, 0, 5, 5, 0)),
    "paw": ([(0, 1), (0, 2), (1, 2), (2, 3)], (1, 0, 0, 5, 2, 1)),
    "star3": ([(0, 1), (0, 2), (0, 3)], (0, 0, 0, 3, 3, 1)),
    "P4": ([(0, 1), (1, 2), (2, 3)], (0, 0, 0, 2, 2, 0)),
}
PAW, DIAMOND = Pattern.of(4, [(0, 1), (1, 2), (0, 2), (2, 3)]), Pattern.of(4, [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)])


def make(spark, edges, labels=None):
    vertices = spark.createDataFrame(sorted(labels.items()), "id long, label int") if labels else None
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), vertices=vertices)


def n(df):
    return df.first()[0]


def brute(edges, pattern, induced):
    adj = {frozenset(e) for e in edges if e[0] != e[1]}
    ids = sorted({v for e in adj for v in e})
    found = 0
    for p in permutations(ids, pattern.size):
        hit = all((frozenset((p[a], p[b])) in adj) or not pattern.has_edge(a, b) for a, b in combinations(range(pattern.size), 2))
        if hit and induced:
            hit = all((frozenset((p[a], p[b])) in adj) == pattern.has_edge(a, b) for a, b in combinations(range(pattern.size), 2))
        found += hit
    assert found % pattern.multiplicity() == 0
    return found // pattern.multiplicity()


@pytest.mark.parametrize("name", MICRO)
def test_micro_graphs(spark, name):
    edges, (tri, k4, k5, wedge, induced, stars) = MICRO[name]
    g = make(spark, edges)
    assert [n(count_cliques(g, k)) for k in (3, 4, 5)] == [tri, k4, k5]
    assert n(motif.wedges(g)) == wedge and n(motif.three_stars(g)) == stars
    assert n(motif.wedges_induced(g)) == induced == n(motif.induced_wedge_searches(g)) == n(count(g, WEDGE, induced=True))
    assert motif.three_motif(g).first().asDict() == {"triangle": tri, "wedge_noninduced": wedge, "wedge_induced": induced}


def test_patterns():
    assert [p.multiplicity() for p in (TRIANGLE, clique(4), clique(5), WEDGE, chain(4), star(3), PAW, cycle(4), cycle(5))] == [6, 24, 120, 2, 2, 6, 2, 8, 10]
    assert TRIANGLE.is_clique() and not TRIANGLE.is_cycle() and cycle(4).is_cycle() and not chain(4).is_cycle()
    assert Pattern(0).is_connected() and not Pattern.of(3, [(0, 1)]).is_connected()
    assert TRIANGLE.add_edge(1, 0) == TRIANGLE and TRIANGLE.clear_edges().edges == frozenset()
    assert str(WEDGE) == "Pattern: (size:3, num_edges:2) (0, 1) (0, 2)"
    assert Pattern.of(3, [(0, 1), (1, 2)]) != Pattern.of(3, [(0, 1), (0, 2)])


@pytest.mark.parametrize("size", [3, 4, 5])
def test_plans_break_symmetry(size):
    pairs = list(combinations(range(size), 2))
    chosen = range(1, 1 << len(pairs)) if size < 5 else random.Random(5).sample(range(1, 1 << len(pairs)), 60)
    for bits in chosen:
        p = Pattern.of(size, [e for k, e in enumerate(pairs) if bits >> k & 1])
        if p.is_connected():
            assert breaks_symmetry(compile_pattern(p)), p


def test_rejected_patterns():
    for bad in (Pattern.of(2, [(0, 1)]), clique(6), Pattern.of(4, [(0, 1), (2, 3)])):
        with pytest.raises(ValueError):
            compile_pattern(bad)
    with pytest.raises(ValueError):
        Pattern.of(3, [(0, 0)])


@pytest.mark.parametrize("seed", [1])
def test_random_graphs_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [e for e in combinations(range(9), 2) if r.random() < 0.45]
    g = make(spark, edges).cache()
    for p in (TRIANGLE, clique(4), chain(4), cycle(4), star(3), PAW, DIAMOND, chain(5), cycle(5)):
        for induced in (False, True):
            want = brute(edges, p, induced)
            assert n(count(g, p, induced)) == want, (p, induced)
            if p in (TRIANGLE, PAW, cycle(4)):
                assert n(count_by_joins(g, p, induced)) == want, (p, induced)
    assert {tuple(x) for x in list_cliques(g, 3).collect()} == {t for t in combinations(range(9), 3) if all(e in edges for e in combinations(t, 2))}
    assert matches(g, PAW).count() == brute(edges, PAW, False)
    shuffled = g.relabel(g.shuffled_ids())
    assert n(count_cliques(shuffled, 3)) == n(count_cliques(g, 3)) and n(motif.wedges(shuffled)) == n(motif.wedges(g))
    assert sum(x.degree for x in g.degrees.collect()) == 2 * len(edges)


def test_empty_and_tiny(spark):
    g = make(spark, [])
    assert n(count_cliques(g, 3)) == 0 == n(motif.wedges(g)) == n(count(g, chain(4)))
    assert motif.three_motif(g).first().asDict() == {"triangle": 0, "wedge_noninduced": 0, "wedge_induced": 0}
    assert analysis.degree_shares(g).count() == 0 and n(analysis.max_degree(g)) == 0
    one = make(spark, [(3, 1), (1, 3), (2, 2), (None, 1)], {1: 0, 3: 1, 9: 0})
    assert [tuple(x) for x in one.edges.collect()] == [(1, 3)]
    assert {tuple(x) for x in one.degrees.collect()} == {(1, 1), (3, 1), (9, 0)}
    assert {(x.id, tuple(x.nbrs)) for x in one.adj.collect()} == {(1, (3,)), (3, (1,)), (9, ())}
    assert {tuple(x) for x in one.densify()[1].collect()} == {(1, 0), (3, 1)}


def test_validation(spark):
    bad = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 2), (3, 4)], "src long, dst long")
    assert check_edges(bad).first().asDict() == {"n_self_loops": 1, "n_dups": 1, "n_asym": 1, "degree_sum": 5, "num_edges": 5}
    with pytest.raises(InvalidGraph):
        make(spark, [(0, 1)], {0: 0, 1: 2}).validate()
    with pytest.raises(InvalidGraph):
        make(spark, [(0, 2**31)]).validate()
    with pytest.raises(InvalidGraph):
        _ = make(spark, [(0, 1)]).labels
    make(spark, [(0, 1)], {0: 0, 1: 1}).validate()


def test_set_operations(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 3, 5, 7], [3, 4, 7], 6)], "a array<long>, b array<long>, x long")
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    row = df.select(setops.intersect(a, b), setops.intersect_count(a, b), setops.difference(a, b), setops.bounded_intersect(a, b, x), setops.bounded_difference(a, b, x), setops.count_below(a, F.lit(5)), setops.count_up_to(a, F.lit(5))).first()
    assert list(row) == [[3, 7], 2, [1, 5], [3], [1, 5], 2, 3]


def test_orientation_bounds_lists(spark):
    hub = [(0, i) for i in range(1, 60)] + [(1, 2), (2, 3), (1, 3)]
    g = make(spark, hub)
    assert max(len(x.nbrs) for x in g.out.collect()) <= 3 and n(count_cliques(g, 3)) == 4 and n(count_cliques(g, 4)) == 1


def test_locality_ids(spark):
    two = list(combinations(range(5), 2)) + [(a + 10, b + 10) for a, b in combinations(range(5), 2)] + [(20, 21)]
    ids = make(spark, two).locality_ids(seed_degree=4).collect()
    assert sorted(x.new_id for x in ids) == list(range(12))
    for c in {x.colour for x in ids if x.colour is not None}:
        own = sorted(x.new_id for x in ids if x.colour == c)
        assert own == list(range(own[0], own[0] + len(own)))
    assert {x.id for x in ids if x.new_id >= 10} == {20, 21}


def test_locality_ids_reach_the_end_of_a_long_path(spark):
    star = [(0, i) for i in range(1, 5)]
    path = [(4 + i, 5 + i) for i in range(26)]
    ids = {x.id: (x.colour, x.new_id) for x in make(spark, star + path + [(100, 101)]).locality_ids(seed_degree=4).collect()}
    assert all(ids[i] == (0, i) for i in range(31)) and ids[100] == (None, 31) and ids[101] == (None, 32)


def test_labelled_paw(spark):
    g = make(spark, MICRO["paw"][0], {0: 0, 1: 0, 2: 1, 3: 1}).cache()
    found = fsm.mine_frequent(g, 1)
    rows = lambda df: {tuple(x) for x in df.collect()}
    assert rows(found.vertex) == {(0, 2), (1, 2)}
    assert rows(found.edge) == {(0, 0, 2), (0, 1, 1), (1, 1, 2)}
    assert rows(found.wedge) == {(0, 0, 1, 1), (1, 0, 0, 1), (1, 0, 1, 1)}
    assert rows(found.triangle) == {(0, 0, 1, 1)}
    assert rows(found.four_chain) == {(0, 1, 0, 1, 1)}
    assert rows(found.three_star) == {(0, 1, 0, 1, 1)}
    with pytest.raises(ValueError):
        fsm.mine_frequent(g, 0)


@pytest.mark.parametrize("seed", [3])
def test_support_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [e for e in combinations(range(11), 2) if r.random() < 0.3]
    labels = {v: r.randrange(2) for v in range(11)}
    g = make(spark, edges, labels).cache()
    templates = {"wedge": (3, [(0, 1), (0, 2)], lambda l: l[1] <= l[2]), "triangle": (3, [(0, 1), (0, 2), (1, 2)], lambda l: l[0] <= l[1] <= l[2]), "four_chain": (4, [(0, 1), (0, 2), (1, 3)], lambda l: l[0] < l[1] or l[0] == l[1] and l[2] <= l[3]), "three_star": (4, [(1, 0), (1, 2), (1, 3)], lambda l: l[0] <= l[2] <= l[3])}
    adj = {frozenset(e) for e in edges}
    found = fsm.mine_frequent(g, 2)
    for name, (k, shape, canonical) in templates.items():
        domains = {}
        for p in permutations(range(11), k):
            if all(frozenset((p[a], p[b])) in adj for a, b in shape):
                for d, v in zip(domains.setdefault(tuple(labels[x] for x in p), [set() for _ in range(k)]), p):
                    d.add(v)
        want = {(*t, min(map(len, d))) for t, d in domains.items() if canonical(t) and min(map(len, d)) >= 2}
        assert {tuple(x) for x in getattr(found, name).collect()} == want, name


@pytest.mark.parametrize("pool", [[0], [-5, 3, 63, 64, 200]])
def test_support_of_labels_in_several_words(spark, pool):
    r = random.Random(7)
    edges = [e for e in combinations(range(9), 2) if r.random() < 0.4]
    labels = {v: r.choice(pool) for v in range(9)}
    adj = {frozenset(e) for e in edges}
    found = fsm.mine_frequent(make(spark, edges, labels).cache(), 1)
    for name, shape, canonical in (("four_chain", [(0, 1), (0, 2), (1, 3)], lambda l: l[0] < l[1] or l[0] == l[1] and l[2] <= l[3]), ("three_star", [(1, 0), (1, 2), (1, 3)], lambda l: l[0] <= l[2] <= l[3])):
        domains = {}
        for p in permutations(range(9), 4):
            if all(frozenset((p[a], p[b])) in adj for a, b in shape):
                for d, v in zip(domains.setdefault(tuple(labels[x] for x in p), [set() for _ in p]), p):
                    d.add(v)
        assert {tuple(x) for x in getattr(found, name).collect()} == {(*t, min(map(len, d))) for t, d in domains.items() if canonical(t)}, name


def test_supports_shuffle_words_of_labels_not_tuples(spark):
    r = random.Random(5)
    labels = {v: r.randrange(6) for v in range(1500)}
    edges = list({tuple(sorted(r.sample(range(1500), 2))) for _ in range(9000)})
    found = fsm.mine_frequent(make(spark, edges, labels).cache(), 1)
    assert found.edge.count() == 21
    written = lambda: sum(x.totalShuffleWrite() for x in _scala(spark, spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    assert found.four_chain.count() == 666 and found.three_star.count() == 336
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    assert written() - before < 100 * 2 * len(edges)


def _scala(spark, found):
    return [found.apply(i) for i in range(found.size())]


def test_trace(spark):
    degrees = spark.createDataFrame([(1, 3), (2, 1)], "id long, degree long")
    requests = spark.createDataFrame([(1, 3), (1, 3), (2, 1), (2, 9), (7, 1)], "vid long, degree long")
    volume = analysis.trace_volume(requests, degrees)
    assert {tuple(x) for x in volume.collect()} == {(1, 2, 24), (2, 1, 4)}
    assert [tuple(x) for x in analysis.top_volumes(volume, 1).collect()] == [(1, 2, 24)]
    assert [tuple(x) for x in analysis.trace_shares(volume, degrees, 4).orderBy("part").collect()] == [(3, 1, 85.7143), (4, 2, 100.0)]
