"""From raw entries to a stored graph, and its degrees, offsets and adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids that share a running total; the totals themselves are one row per so many ids.
CHUNK = 1 << 16


def in_range(edges: DataFrame, n: int) -> DataFrame:
    """Edges with both ends in [0, n)."""
    return edges.filter((F.col("src") >= 0) & (F.col("src") < n) & (F.col("dst") >= 0) & (F.col("dst") < n))


def symmetrize(edges: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """Both directions of each edge, once."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (both.filter("src <> dst") if drop_self_loops else both).distinct()


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, degree): stored entries of each row, 0 for a vertex without any."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def running_total(rows: DataFrame, value: Column, name: str, key: str = "id", chunk: int = CHUNK) -> DataFrame:
    """Adds the sum of `value` over all rows with a smaller key.

    Rows are summed in chunks of the key first, so that only one row per chunk
    goes through a window over everything.
    """
    chunked = rows.withColumn("__chunk", F.floor(F.col(key) / chunk)).withColumn("__value", value)
    sums = chunked.groupBy("__chunk").agg(F.sum("__value").alias("__sum"))
    everything = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__chunk", F.coalesce(F.sum("__sum").over(everything), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__base") + F.coalesce(F.sum("__value").over(within), F.lit(0))
    return chunked.join(bases, "__chunk").withColumn(name, total.cast("long")).drop("__chunk", "__value", "__base")


def row_offsets(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, row_start, row_end): where each vertex's neighbours stand in one array of all."""
    at = running_total(degrees(edges, vertices), F.col("degree"), "row_start")
    return at.select("id", "row_start", (F.col("row_start") + F.col("degree")).alias("row_end"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, pos, dst): a vertex's neighbours in ascending order, numbered from 0."""
    return edges.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("pos"), "dst")


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(src, degree, nbrs): the grouped view."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sort_array(F.collect_list("dst")).alias("nbrs"))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers the rows of each group from 0 in ascending order, without bringing a group into one task.

    For a few groups: one row for each group and task that has it is broadcast.
    Rows that are equal in group and order may get any of their numbers.
    """
    ordered = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__place", F.monotonically_increasing_id()).checkpoint()
    task = F.shiftright("__place", 33)
    runs = ordered.groupBy(*by, task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select(*by, "__task", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    return ordered.withColumn("__task", task).join(F.broadcast(bases), [*by, "__task"]).withColumn(name, (F.col("__base") + F.col("__place")).cast("long")).drop("__task", "__place", "__base")


def dense_ids(rows: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    """Numbers rows from 0 in ascending order of keys, without bringing them into one task."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__place", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = ordered.withColumn("__part", part).join(F.broadcast(bases), "__part")
    return numbered.withColumn(name, F.col("__base") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__place", "__base")
