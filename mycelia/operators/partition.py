"""Contiguous ranges of vertices, balanced by vertices or by edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .normalize import degrees, running_total


def vertex_bounds(n: int, parts: int) -> list[int]:
    """parts + 1 bounds; the first n mod parts ranges have one vertex more."""
    size, more = divmod(n, parts)
    return [r * size + min(r, more) for r in range(parts + 1)]


def vertex_part(v: Column, n: int, parts: int) -> Column:
    """The range of vertex_bounds that a vertex is in, by arithmetic."""
    size, more = divmod(n, parts)
    split = more * (size + 1)
    late = F.floor((v - split) / size) + more if size else F.lit(parts - 1)
    return F.when(v < split, F.floor(v / (size + 1))).otherwise(late).cast("int")


def weights_before(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, degree, pre): pre is the total weight, degree + 1 each, of all smaller vertices."""
    return running_total(degrees(edges, vertices).checkpoint(), F.col("degree") + 1, "pre")


def edge_bounds(before: DataFrame, parts: int) -> list[int]:
    """parts + 1 bounds: range r begins at the first vertex whose weight before reaches r / parts of all, and has a vertex at least.

    before: weights_before of vertices 0..n-1. Only the bounds come to the
    driver. With fewer vertices than parts, the last ranges are empty.
    """
    first = F.min(F.when(F.col("pre") >= F.col("t"), F.col("id")))
    total = before.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("degree") + 1), F.lit(0))).first()
    n, weight = int(total[0]), int(total[1])
    goals = [weight * r // parts for r in range(1, parts)]
    if not goals or not n:
        return [0] + [n] * parts
    found = before.agg(*[F.min(F.when(F.col("pre") >= g, F.col("id"))) for g in goals]).first()
    plain = [n if v is None else int(v) for v in found]
    limits = [n - (parts - r) for r in range(1, parts)]
    if all(low < v <= high for low, v, high in zip([0, *plain], plain, limits, strict=False)):
        return [0, *plain, n]
    return [0, *_clamped(before, goals, n, weight, first), n]


def _clamped(before: DataFrame, goals: list[int], n: int, weight: int, first: Column) -> list[int]:
    """Bounds where a range would be empty. A bound that is moved takes the weight it skips out of the following count."""
    parts, bounds, v, drift = len(goals) + 1, [], 0, 0

    def weight_at(v: int) -> int:
        return weight if v >= n else int(before.filter(F.col("id") == v).select("pre").first()[0])

    for r, goal in enumerate(goals, 1):
        if weight_at(v) + drift < goal:
            reached = before.withColumn("t", F.lit(goal - drift)).agg(first).first()[0]
            v = n if reached is None else int(reached)
        counted = weight_at(v) + drift
        v = min(max(v, (bounds[-1] if bounds else 0) + 1), max(n - (parts - r), 0))
        v = min(max(v, bounds[-1] if bounds else 0), n)
        drift = counted - weight_at(v)
        bounds.append(v)
    return bounds


def bounds_table(spark: SparkSession, bounds: list[int]) -> DataFrame:
    return spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))], "part INT, v_start BIGINT, v_end BIGINT")


#: Up to so many parts a vertex's part is an expression; beyond, it is a join with the bounds.
EXPRESSION_PARTS = 128


def owner(v: Column, bounds: list[int]) -> Column:
    """Part of a vertex: the number of inner bounds that it reaches."""
    reached = [(v >= b).cast("int") for b in bounds[1:-1]]
    return sum(reached, F.lit(0)).cast("int")


def with_owner(rows: DataFrame, column: str, bounds: list[int], name: str) -> DataFrame:
    if len(bounds) <= EXPRESSION_PARTS + 1:
        return rows.withColumn(name, owner(F.col(column), bounds))
    table = bounds_table(rows.sparkSession, bounds).select(F.col("part").alias(name), "v_start", "v_end")
    return rows.join(F.broadcast(table), (F.col(column) >= F.col("v_start")) & (F.col(column) < F.col("v_end"))).drop("v_start", "v_end")


def parts_of(vertices: DataFrame, bounds: list[int]) -> DataFrame:
    return with_owner(vertices.select("id"), "id", bounds, "part")


def balance(edges: DataFrame, vertices: DataFrame, bounds: list[int]) -> DataFrame:
    """(part, n_local, m_local): vertices and stored edges of each part that has any."""
    return with_owner(degrees(edges, vertices), "id", bounds, "part").groupBy("part").agg(F.count(F.lit(1)).alias("n_local"), F.sum("degree").alias("m_local"))
