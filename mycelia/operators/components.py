"""Connected components: every vertex gets the smallest id of its component.

Four ways, with the same labels:

contract  Each task reduces its edges to a spanning forest (union-find on
          numpy arrays), so at most one edge per vertex and task is left.
          A forest that fits one task is finished there; a larger one goes
          on with stars.
stars     Large-star and small-star rounds (Kiveris et al., "Connected
          Components in MapReduce and Beyond", 2014) as an aggregation and a
          join each. The number of rounds is logarithmic in practice.
labels    Smallest label of the neighbours and pointer jumping, of changed
          vertices only.
frontier  The same without jumps: a breadth-first search from all vertices at
          once, in which the smallest one wins. A round for each step of the
          longest shortest path.

Edges are undirected; direction, duplicates and loops don't matter. Each
round is written to the shared checkpoint folder, so a lost executor costs
only its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mycelia.session import checkpoint_dir

#: A forest of up to this many edges (16 bytes each) is finished in one task.
ONE_TASK_EDGES = 200_000
#: Edges that a task gathers before it reduces them.
CHUNK = 2_000_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex of the component of each of 0..n-1; edges run from a[i] to b[i]."""
    parent = np.arange(n)
    while len(a):
        pa_, pb_ = parent[a], parent[b]
        live = pa_ != pb_
        a, b, low, high = a[live], b[live], np.minimum(pa_, pb_)[live], np.maximum(pa_, pb_)[live]
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (vertex, smallest vertex of its component) of all vertices but the smallest ones."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    root = roots(at[: len(src)], at[len(src) :], len(ids))
    other = root != np.arange(len(ids))
    return ids[other], ids[root[other]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held, kept = 0, 0
    for batch in batches:
        parts.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        held += batch.num_rows
        if held > CHUNK + 2 * kept:
            parts = [forest(*map(np.concatenate, zip(*parts, strict=True)))]
            held = kept = len(parts[0][0])
    if parts:
        src, dst = forest(*map(np.concatenate, zip(*parts, strict=True)))
        for k in range(0, len(src), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(src[k : k + 100_000]), pa.array(dst[k : k + 100_000])], ["src", "dst"])


def contract(edges: DataFrame) -> DataFrame:
    """Partition-local components: star edges that connect what each partition's edges connect."""
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).mapInArrow(_forests, "src long, dst long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the smallest of its neighbours and itself."""
    both = _both(edges)
    # written, so that the join reads two exchanges and a hub's rows can be split among tasks
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low")).checkpoint()
    return both.filter("dst > src").join(low.hint("merge"), "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src > dst").distinct()
    low = down.groupBy("src").agg(F.min("dst").alias("low")).checkpoint()
    linked = down.join(low.hint("merge"), "src").filter("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return linked.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame, finish_at: int = 0) -> DataFrame:
    """Rounds until nothing changes, or until the edges fit one task: star edges (vertex, root)."""
    current = small_star(edges).checkpoint()
    before = _digest(current)
    while before[0] > finish_at:
        current = small_star(large_star(current)).checkpoint()
        if (now := _digest(current)) == before:
            break
        before = now
    return current if before[0] > finish_at else one_task(current)


def one_task(edges: DataFrame) -> DataFrame:
    return contract(edges.coalesce(1))


def star_labels(star_edges: DataFrame) -> DataFrame:
    """(id, component) of each vertex of star edges, roots included."""
    own = star_edges.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return star_edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(own)


def min_labels(vertices: DataFrame, edges: DataFrame, jumps: int = 4) -> DataFrame:
    """Rounds of: offer changed labels to the neighbours, take the smallest, jump up to `jumps` times."""
    both = _both(edges.filter("src <> dst")).distinct().persist(StorageLevel.DISK_ONLY)
    labels = vertices.select("id", F.col("id").alias("component"), F.lit(True).alias("changed")).checkpoint()
    while not labels.filter("changed").isEmpty():
        offers = labels.filter("changed").join(both.hint("merge"), F.col("id") == F.col("src")).groupBy("dst").agg(F.min("component").alias("offer"))
        hooked = labels.select("id", F.col("component").alias("old")).join(offers.hint("merge"), F.col("id") == F.col("dst"), "left").select("id", "old", F.least("old", "offer").alias("component")).checkpoint()
        labels = jump(hooked, jumps).withColumn("changed", F.col("component") < F.col("old")).select("id", "component", "changed").checkpoint()
    both.unpersist()
    return labels.select("id", "component")


def jump(labels: DataFrame, times: int) -> DataFrame:
    """Replace a label by the label's own label, up to `times` times, while it falls."""
    known = labels.select(F.col("id").alias("__id"), F.col("component").alias("__up"))
    for _ in range(times):
        labels = labels.join(known.hint("merge"), F.col("component") == F.col("__id"), "left").withColumn("component", F.least("component", "__up")).drop("__id", "__up")
    return labels


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, method: str = "contract", one_task_edges: int = ONE_TASK_EDGES, closed: bool = False) -> DataFrame:
    """(id, component) of every vertex. vertices: a table with id; without it, the ends of edges.

    Edges with a null end are left out. With vertices, edges to others are too;
    closed says that there are none, which saves two shuffles of the edges.
    """
    checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna()
    if vertices is not None:
        vertices = vertices.select(F.col("id").cast("long").alias("id")).dropna()
        if not closed:
            vertices = vertices.distinct()
            edges = inside(edges, vertices)
    if method in ("labels", "frontier"):
        every = vertices if vertices is not None else _both(edges).select(F.col("src").alias("id")).distinct()
        return min_labels(every, edges, 4 if method == "labels" else 0)
    if method not in ("contract", "stars"):
        raise ValueError(f"method must be contract, stars, labels or frontier, not {method!r}")
    if method == "contract":
        reduced = contract(edges.filter("src <> dst")).checkpoint()
        found = one_task(reduced) if reduced.count() <= one_task_edges else stars(reduced, one_task_edges)
    else:
        found = stars(edges.filter("src <> dst"))
    labels = star_labels(found)
    if vertices is None:
        alone = edges.filter("src = dst").select(F.col("src").alias("id")).distinct().join(labels, "id", "left_anti")
        return labels.unionByName(alone.select("id", F.col("id").alias("component")))
    return vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def inside(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose ends both are vertices."""
    return edges.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def component_count(labels: DataFrame) -> DataFrame:
    """Vertices whose label is their own id."""
    return labels.filter("component = id").agg(F.count(F.lit(1)).alias("n_components"))


def distinct_labels(labels: DataFrame, n: int | None = None) -> DataFrame:
    """Different labels; with n, labels of n and above are ignored."""
    kept = labels if n is None else labels.filter(F.col("component") < n)
    return kept.agg(F.countDistinct("component").alias("n_components"))
