"""The steps of finding components part by part, each as a table.

A part's own edges are solved first, and every local component becomes one
representative, its smallest vertex. What is left are boundary edges from a
representative to a vertex of another part, a ghost. Rounds then lower the
representatives' labels by their ghosts', follow labels of labels, and
exchange what fell.

Vertex ids are global everywhere; gidx and pos only number rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .normalize import numbered
from .partition import with_owner


class Halo:
    """Tables of a stored graph (symmetric, distinct) cut at `bounds`."""

    def __init__(self, edges: DataFrame, vertices: DataFrame, bounds: list[int]):
        self.bounds = bounds
        self.vertices = with_owner(vertices.select("id"), "id", bounds, "part")
        self.edges = with_owner(with_owner(edges.select("src", "dst"), "src", bounds, "part"), "dst", bounds, "__to")

    def local_edges(self) -> DataFrame:
        return self.edges.filter("part = __to").select("part", "src", "dst")

    def boundary_raw(self) -> DataFrame:
        return self.edges.filter("part <> __to").select("part", "src", "dst")

    def local_cc(self) -> DataFrame:
        """(part, id, rep). Local edges never leave a part, so one run over all parts solves each of them."""
        labels = connected_components(self.local_edges().select("src", "dst"))
        return self.vertices.join(labels, "id", "left").select("part", "id", F.coalesce("component", "id").alias("rep"))

    def local_reps(self) -> DataFrame:
        return self.local_cc().groupBy("part").agg(F.countDistinct("rep").alias("n_reps"))

    def sorted_boundary(self) -> DataFrame:
        """(part, rep, remote, place): a part's boundary in the order of remote, then rep."""
        return numbered(self.boundary(), ["part"], ["remote", "rep"], "place").select("part", "rep", "remote", "place")

    def boundary(self, local: DataFrame | None = None) -> DataFrame:
        """(part, rep, remote), each once."""
        reps = (self.local_cc() if local is None else local).select(F.col("id").alias("src"), "rep")
        return self.boundary_raw().join(reps, "src").select("part", "rep", F.col("dst").alias("remote")).distinct()

    def ghosts(self) -> DataFrame:
        """(part, gidx, vertex): vertices of other parts that a part's edges reach."""
        reached = self.boundary_raw().select("part", F.col("dst").alias("vertex")).distinct()
        return numbered(reached, ["part"], ["vertex"], "gidx").select("part", "gidx", "vertex")

    def need_from(self) -> DataFrame:
        """(part, peer, pos, vertex): ghosts of a part that a peer owns."""
        reached = self.boundary_raw().select("part", F.col("dst").alias("vertex")).distinct()
        owned = with_owner(reached, "vertex", self.bounds, "peer")
        return numbered(owned, ["part", "peer"], ["vertex"], "pos").select("part", "peer", "pos", "vertex")

    def send_to(self) -> DataFrame:
        """What each part's peers need from it."""
        return self.need_from().select(F.col("peer").alias("part"), F.col("part").alias("peer"), "pos", "vertex")

    def counts(self) -> DataFrame:
        """(part, peer, need, send)."""
        each = self.need_from().groupBy("part", "peer").agg(F.count(F.lit(1)).alias("n"))
        here = each.select("part", "peer", F.col("n").alias("need"), F.lit(0).cast("long").alias("send"))
        there = each.select(F.col("peer").alias("part"), F.col("part").alias("peer"), F.lit(0).cast("long").alias("need"), F.col("n").alias("send"))
        return here.unionByName(there).groupBy("part", "peer").agg(F.sum("need").alias("need"), F.sum("send").alias("send"))

    def topology(self) -> DataFrame:
        """(part, n_in, n_out): peers that a part needs vertices from and sends vertices to."""
        return self.counts().groupBy("part").agg(F.count_if(F.col("need") > 0).alias("n_in"), F.count_if(F.col("send") > 0).alias("n_out"))


def initial(local: DataFrame) -> DataFrame:
    """(part, rep, label): each representative is its own label."""
    return local.select("part", "rep").distinct().select("part", "rep", F.col("rep").alias("label"))


def hook(state: DataFrame, boundary: DataFrame, ghost_labels: DataFrame | None = None) -> DataFrame:
    """Representatives take the smallest label of their ghosts if it is smaller. ghost_labels: (vertex, label); at first a ghost's own id."""
    seen = boundary.withColumn("offer", F.col("remote")) if ghost_labels is None else boundary.join(ghost_labels.select(F.col("vertex").alias("remote"), F.col("label").alias("offer")), "remote")
    least = seen.groupBy("part", "rep").agg(F.min("offer").alias("offer"))
    return state.join(least, ["part", "rep"], "left").select("part", "rep", F.least("label", "offer").alias("label"))


def vertex_labels(local: DataFrame, state: DataFrame) -> DataFrame:
    """(vertex, label): a vertex has its representative's label."""
    return local.join(state.select("rep", "label"), "rep").select(F.col("id").alias("vertex"), "label")


def jump(state: DataFrame, local: DataFrame, times: int = 4) -> DataFrame:
    """Labels give way to their own vertices' labels, up to `times` times, while they fall."""
    known = vertex_labels(local, state).select(F.col("vertex").alias("__at"), F.col("label").alias("__up"))
    for _ in range(times):
        state = state.join(known, F.col("label") == F.col("__at"), "left").withColumn("label", F.least("label", "__up")).drop("__at", "__up")
    return state


def delta(send_to: DataFrame, labels: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """(part, peer, pos, label, packed) of labels that fell since they were last sent, or never were. packed: pos and label in one number."""
    now = send_to.join(labels, "vertex")
    if sent is not None:
        before = sent.select("part", "peer", "pos", F.col("label").alias("old"))
        now = now.join(before, ["part", "peer", "pos"], "left").filter(F.col("old").isNull() | (F.col("label") < F.col("old")))
    return now.select("part", "peer", "pos", "label", F.shiftleft("pos", 32).bitwiseOR(F.col("label")).alias("packed"))


def unpacked(message: DataFrame) -> DataFrame:
    return message.select("part", "peer", F.shiftrightunsigned("packed", 32).alias("pos"), F.col("packed").bitwiseAND(F.lit((1 << 32) - 1)).alias("label"))


def received(ghost_labels: DataFrame, message: DataFrame, need_from: DataFrame) -> DataFrame:
    """(part, vertex, label) of ghosts after a message: what the owner at `part` sent to `peer` is the peer's ghost."""
    mine = message.select(F.col("peer").alias("part"), F.col("part").alias("peer"), "pos", F.col("label").alias("new"))
    fresh = need_from.join(mine, ["part", "peer", "pos"]).select("part", "vertex", "new")
    return ghost_labels.join(fresh, ["part", "vertex"], "left").select("part", "vertex", F.coalesce("new", "label").alias("label"))


def full_exchange(ghosts: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, gidx, label): all ghosts with their owners' labels."""
    return ghosts.join(labels, "vertex").select("part", "gidx", "label")
