"""Components by parts: local solution, then rounds over the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mycelia.operators import halo as H
from mycelia.operators.partition import edge_bounds, vertex_bounds, weights_before
from mycelia.session import checkpoint_dir


def bounds_of(edges: DataFrame, vertices: DataFrame, parts: int, by_edges: bool = True) -> list[int]:
    """Bounds of a stored graph over vertices 0..n-1."""
    return edge_bounds(weights_before(edges, vertices).checkpoint(), parts) if by_edges and parts > 1 else vertex_bounds(vertices.count(), parts)


def staged_components(edges: DataFrame, vertices: DataFrame, parts: int = 4, exchange_interval: int = 1, by_edges: bool = True) -> DataFrame:
    """(id, component). Ghost labels are exchanged every exchange_interval rounds, and at once when no label falls any more."""
    checkpoint_dir(edges.sparkSession)
    cut = H.Halo(edges, vertices, bounds_of(edges, vertices, parts, by_edges))
    local = cut.local_cc().checkpoint()
    boundary = cut.boundary(local).checkpoint()
    needed = boundary.select(F.col("remote").alias("vertex")).distinct()
    state, ghosts = H.initial(local).checkpoint(), needed.select("vertex", F.col("vertex").alias("label"))
    pending, rounds, interval = False, 0, max(1, exchange_interval)
    while True:
        rounds += 1
        new = H.jump(H.hook(state, boundary, ghosts).checkpoint(), local).checkpoint()
        fell = not new.join(state.withColumnRenamed("label", "old"), ["part", "rep"]).filter("label < old").isEmpty()
        state, pending = new, pending or fell
        if rounds % interval == 0 or not fell:
            if not pending:
                break
            ghosts = needed.join(H.vertex_labels(local, state), "vertex").checkpoint()
            pending = False
    return H.vertex_labels(local, state).select(F.col("vertex").alias("id"), F.col("label").alias("component"))
