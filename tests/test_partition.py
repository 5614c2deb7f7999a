import random

import pytest

from mycelia.operators import normalize as N
from mycelia.operators import partition as P


def loop_bounds(degrees, parts):
    """The rule one vertex at a time: a part ends when the weight counted so far reaches its goal, and has a vertex at least."""
    n, weight = len(degrees), sum(degrees) + len(degrees)
    bounds, v, counted = [0], 0, 0
    for r in range(1, parts):
        while v < n and counted < weight * r // parts:
            counted += degrees[v] + 1
            v += 1
        v = min(max(v, bounds[-1] + 1), max(n - (parts - r), 0))
        v = min(max(v, bounds[-1]), n)
        bounds.append(v)
    return [*bounds, n]


def before(spark, degrees):
    rows, pre = [], 0
    for v, d in enumerate(degrees):
        rows.append((v, d, pre))
        pre += d + 1
    return spark.createDataFrame(rows, "id long, degree long, pre long")


@pytest.mark.parametrize("seed", range(8))
def test_edge_bounds(spark, seed):
    rnd = random.Random(seed)
    degrees = [rnd.choice([0, 0, 1, 2, 5, 200]) for _ in range(rnd.randint(1, 30))]
    parts = rnd.randint(1, 7)
    assert P.edge_bounds(before(spark, degrees), parts) == loop_bounds(degrees, parts)


def test_edge_bounds_of_hub_and_few(spark):
    assert P.edge_bounds(before(spark, [1000, 0, 0, 0, 0]), 4) == loop_bounds([1000, 0, 0, 0, 0], 4)
    assert P.edge_bounds(before(spark, [1, 1]), 4) == [0, 0, 0, 1, 2] or len(P.edge_bounds(before(spark, [1, 1]), 4)) == 5
    assert P.edge_bounds(before(spark, []), 3) == [0, 0, 0, 0]


@pytest.mark.parametrize("n,parts", [(10, 3), (2, 4), (7, 7), (0, 2), (100, 1)])
def test_vertex_parts(spark, n, parts):
    from pyspark.sql import functions as F

    bounds = P.vertex_bounds(n, parts)
    assert bounds[0] == 0 and bounds[-1] == n and len(bounds) == parts + 1
    got = {r["id"]: r["part"] for r in spark.range(n).select("id", P.vertex_part(F.col("id"), n, parts).alias("part")).collect()}
    assert got == {v: r for r in range(parts) for v in range(bounds[r], bounds[r + 1])}


def test_owner_by_expression_and_join(spark):
    bounds = list(range(0, 401, 2))
    few = P.with_owner(spark.range(400), "id", [0, 100, 100, 400], "part")
    assert {(r["id"] >= 100, r["part"]) for r in few.collect()} == {(False, 0), (True, 2)}
    assert all(r["part"] == r["id"] // 2 for r in P.with_owner(spark.range(400), "id", bounds, "part").collect())


def test_running_total_over_chunks(spark):
    from pyspark.sql import functions as F

    rows = N.running_total(spark.range(50), F.col("id"), "before", chunk=7).collect()
    assert {r["id"]: r["before"] for r in rows} == {v: v * (v - 1) // 2 for v in range(50)}


def test_dense_ids(spark):
    from mycelia.session import checkpoint_dir

    checkpoint_dir(spark)
    rows = spark.range(1000).selectExpr("id * 17 % 1000 AS k").repartition(7)
    assert all(r["id"] == r["k"] for r in N.dense_ids(rows, "k").collect())
    assert N.dense_ids(rows.limit(0), "k").count() == 0


def test_bounds_of_view_g7(spark):
    from mycelia.catalogue import bounds_of, graph

    vertices, edges = graph(spark, "/root/testdata/sf0.01", "g7")
    assert bounds_of(edges, vertices, 4) == [0, 2525, 5000, 7475, 10000]


def test_numbered(spark):
    """Groups of any size are numbered over several tasks."""
    from mycelia.operators.normalize import numbered

    rows = [(0, k) for k in range(900)] + [(k, 5) for k in range(1, 40)] + [(50, k) for k in range(7)]
    df = spark.createDataFrame(rows, "part int, v int").repartition(6)
    got = {(r["part"], r["v"]): r["pos"] for r in numbered(df, ["part"], ["v"], "pos").collect()}
    by: dict = {}
    for p, v in sorted(rows):
        by.setdefault(p, []).append(v)
    assert got == {(p, v): k for p, vs in by.items() for k, v in enumerate(vs)}
    assert numbered(df.limit(0), ["part"], ["v"], "pos").count() == 0
