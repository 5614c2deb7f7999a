"""Edge lists from files: Parquet, CSV and TSV, Matrix Market, MATLAB sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mycelia.operators.normalize import in_range, symmetrize


def matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(src, dst) from 0, and the number of rows of a coordinate file.

    Lines are read in parallel. The size is the first line that is no comment,
    the only one in which the third number counts the others; a line's place in
    the file isn't known, so the size line is taken from the head of the text.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    header = spark.read.text(path).filter(F.col("value").startswith("%%MatrixMarket")).select("value").first()
    kind = (header[0] if header else "").lower().split()
    if len(kind) < 3 or kind[1:3] != ["matrix", "coordinate"]:
        raise ValueError(f"{path}: not a Matrix Market coordinate file")
    size_line = lines.first()  # of an ordered text source, the first line of the first block
    if size_line is None or len(size_line[0].split()) != 3:
        raise ValueError(f"{path}: no size line")
    rows, _, entries = map(int, size_line[0].split())
    fields = F.split(F.trim("value"), r"\s+")
    pairs = lines.select((fields[0].cast("long") - 1).alias("src"), (fields[1].cast("long") - 1).alias("dst"), F.monotonically_increasing_id().alias("__line"))
    # the first line is the smallest number
    edges = pairs.filter("__line > 0").select("src", "dst")
    if "symmetric" in kind or "skew-symmetric" in kind or "hermitian" in kind:
        edges = edges.unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges, rows


def write_matrix_market(edges: DataFrame, path: str, n: int) -> None:
    """Write (src, dst), from 0, as a folder with one coordinate file of an n x n pattern. The size line has to come first, so one task writes."""
    spark = edges.sparkSession
    entries = edges.select(F.lit(2).alias("__at"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("value"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate pattern general"), (1, f"{n} {n} {edges.count()}")], "__at int, value string")
    head.unionByName(entries).repartition(1).sortWithinPartitions("__at").select("value").write.text(path)


def delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(src, dst): the first two columns; lines that begin with # and lines without two integers are left out."""
    rows = spark.read.option("sep", sep).option("comment", "#").schema("src STRING, dst STRING").csv(path)
    return rows.select(F.col("src").try_cast("long").alias("src"), F.col("dst").try_cast("long").alias("dst")).dropna()


def load_edges(spark: SparkSession, path: str, symmetric: bool = True, drop_self_loops: bool = False) -> tuple[DataFrame, int | None]:
    """(src, dst) and the number of vertices if the file tells it; the format goes by the extension."""
    suffix = path.lower().rstrip("/").rpartition(".")[2]
    n: int | None = None
    if suffix in ("mtx", "txt"):
        edges, n = matrix_market(spark, path)
    elif suffix == "mat":
        from .matlab import read_mat

        edges, n = read_mat(spark, path)
    elif suffix == "parquet":
        edges = spark.read.parquet(path).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    elif suffix in ("csv", "tsv"):
        edges = delimited(spark, path, "," if suffix == "csv" else "\t")
    else:
        raise ValueError(f"{path}: unknown extension {suffix!r}")
    if n is not None:
        edges = in_range(edges, n)
    if symmetric:
        return symmetrize(edges, drop_self_loops), n
    return (edges.filter("src <> dst") if drop_self_loops else edges), n


def all_vertices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)
