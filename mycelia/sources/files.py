"""Single files in any store that Spark reaches, through its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _place(spark, path)
    return files.exists(target)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file as a whole: under another name first, then renamed."""
    target, files = _place(spark, path)
    part, _ = _place(spark, path + ".part")
    out = files.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    files.delete(target, False)
    if not files.rename(part, target):
        raise OSError(f"can't rename to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a table of run times."""
    content = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(content[0]).decode("utf-8") if content else ""
