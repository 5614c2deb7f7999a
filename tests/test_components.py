import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mycelia.operators import components as C
from mycelia.operators.normalize import symmetrize
from mycelia.plans.staged import staged_components

GRAPHS = {
    "empty": (0, [], []),
    "single": (1, [], [0]),
    "isolated": (4, [], [0, 1, 2, 3]),
    "path5": (5, [(0, 1), (1, 2), (2, 3), (3, 4)], [0] * 5),
    "reverse_star": (5, [(4, 0), (4, 1), (4, 2), (4, 3)], [0] * 5),
    "two_cliques": (6, [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)], [0, 0, 0, 3, 3, 3]),
    "bridge": (6, [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)], [0] * 6),
    "loops_dups": (4, [(0, 0), (1, 2), (2, 1), (1, 2), (3, 3)], [0, 1, 1, 3]),
    "one_direction": (4, [(1, 0), (1, 2), (3, 0), (3, 1)], [0] * 4),
    "local_only": (8, [(0, 1), (2, 3), (4, 5), (6, 7)], [0, 0, 2, 2, 4, 4, 6, 6]),
    "one_part_no_ghost": (6, [(0, 1), (2, 4)], [0, 0, 2, 3, 2, 5]),
    "few_vertices": (2, [(0, 1)], [0, 0]),
    "zigzag": (8, [(3, 4), (4, 2), (2, 5), (5, 1), (1, 6), (6, 0), (0, 7)], [0] * 8),
    "out_of_range": (3, [(0, 1), (1, 9)], [0, 0, 2]),
}


def tables(spark, n, edges):
    return spark.range(n), spark.createDataFrame(edges, "src long, dst long")


def labels_of(df):
    return {r["id"]: r["component"] for r in df.collect()}


@pytest.mark.parametrize("name", GRAPHS)
def test_contract(spark, name):
    n, edges, want = GRAPHS[name]
    v, e = tables(spark, n, edges)
    assert labels_of(C.connected_components(e, v)) == dict(enumerate(want))


@pytest.mark.parametrize("name", ["empty", "loops_dups", "bridge", "zigzag", "out_of_range"])
@pytest.mark.parametrize("method", ["stars", "labels"])
def test_other_methods(spark, name, method):
    n, edges, want = GRAPHS[name]
    v, e = tables(spark, n, edges)
    assert labels_of(C.connected_components(e, v, method)) == dict(enumerate(want))


@pytest.mark.parametrize("name,parts,by_edges,interval", [("empty", 2, True, 1), ("local_only", 2, False, 1), ("one_part_no_ghost", 3, False, 1), ("few_vertices", 4, True, 1), ("zigzag", 2, False, 3), ("bridge", 4, True, 2)])
def test_staged(spark, name, parts, by_edges, interval):
    n, edges, want = GRAPHS[name]
    v, e = tables(spark, n, edges)
    assert labels_of(staged_components(symmetrize(e), v, parts, interval, by_edges)) == dict(enumerate(want))


def test_without_vertices_and_big_ids(spark):
    e = spark.createDataFrame([(4294967294, 4294967293), (7, 7), (2**62, None)], "src long, dst long")
    assert labels_of(C.connected_components(e)) == {4294967293: 4294967293, 4294967294: 4294967293, 7: 7}


def test_forest_beyond_one_task(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2500, 2))]
    v, e = tables(spark, 3000, pairs)
    whole = labels_of(C.connected_components(e, v))
    assert labels_of(C.connected_components(e.repartition(7), v, one_task_edges=50)) == whole
    assert labels_of(C.connected_components(e, v, one_task_edges=0)) == whole
    root = C.roots(np.asarray([a for a, _ in pairs]), np.asarray([b for _, b in pairs]), 3000)
    assert whole == dict(enumerate(root.tolist()))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_roots_and_forest(pairs):
    label = list(range(26))
    for _ in range(26):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    a, b = (np.asarray([p[k] for p in pairs], np.int64) for k in (0, 1))
    assert C.roots(a, b, 26).tolist() == label
    src, dst = C.forest(a * 10, b * 10)
    assert dict(zip(src.tolist(), dst.tolist(), strict=True)) == {10 * v: 10 * r for v, r in enumerate(label) if r != v}


def test_counts(spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 9)], "id long, component long")
    assert C.component_count(labels).first()[0] == 2
    assert C.distinct_labels(labels).first()[0] == 3
    assert C.distinct_labels(labels, 4).first()[0] == 2
    assert {tuple(r) for r in C.component_sizes(labels).collect()} == {(0, 2), (2, 1), (9, 1)}
