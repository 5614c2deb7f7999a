"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mycelia.session import checkpoint_dir, remove, scratch

__all__ = ["checkpoint_dir", "remove", "scratch"]

#: A set of keys of up to this many rows (some 100 bytes each) is broadcast.
BROADCAST_ROWS = 200_000
#: Bits in one row of a filter, as Spark's bitmap functions define it, and how many rows of 4 KB a filter has at most.
BITMAP_BITS, MAX_BITMAPS = 32768, 4096

WORD_GAP = r"[\x20\x09-\x0D]+"


#: Bytes of rows that Spark hands to a Python worker at once, unless the session says otherwise.
ARROW_KEY, ARROW_DEFAULT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def in_batches(df: DataFrame) -> DataFrame:
    """df, to be mapped in Arrow batches that are small beside a worker's memory; texts can be long."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_KEY, ARROW_DEFAULT) == ARROW_DEFAULT:
        conf.set(ARROW_KEY, ARROW_BYTES)
    return df


def resting(run):
    """run, a function of Arrow batches, that gives its memory back to the system when it ends: a worker waits beside others for its next task."""

    def wrapped(rows):
        try:
            yield from run(rows)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`.

    A column that a lambda mentions is evaluated again for each element; a
    lambda's own variable is not.
    """
    return F.transform(F.array(value), body)[0]


def bit_of(key: Column, buckets: int) -> tuple[Column, Column]:
    """Where a key stands in a filter of so many bitmaps: bitmap number and bit."""
    place = F.pmod(F.xxhash64(key), F.lit(buckets * BITMAP_BITS).cast("long"))
    return F.floor(place / BITMAP_BITS).cast("long"), (place % BITMAP_BITS).cast("int")


def bitmap_count(n: int, limit: int = MAX_BITMAPS) -> int:
    """Bitmaps of a filter of n keys: 16 bits each, within the limit."""
    buckets = 1
    while 2 * buckets <= limit and buckets * BITMAP_BITS < 16 * n:
        buckets *= 2
    return buckets


def has_bit(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit % 8) == 1


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """rows with `__maybe`: false if the key isn't in keys (n rows). The filter has at most MAX_BITMAPS rows of 4 KB, whatever n is."""
    buckets = bitmap_count(n)
    bucket, bit = bit_of(F.col(key), buckets)
    maps = keys.select(bucket.alias("__bucket"), bit.cast("long").alias("__bit")).groupBy("__bucket").agg(F.expr("bitmap_construct_agg(__bit)").alias("__bits"))
    joined = rows.withColumn("__bucket", bucket).withColumn("__bit", bit).join(F.broadcast(maps), "__bucket", "left")
    return joined.withColumn("__maybe", F.coalesce(has_bit(F.col("__bits"), F.col("__bit")), F.lit(False))).drop("__bucket", "__bit", "__bits")


def without_rows(df: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of df whose keys, all of them and null-safe, are not those of a row of gone. keys: gone's columns and what they are in df.

    Up to BROADCAST_ROWS rows of gone are broadcast, after they are counted.
    With more, only rows of df that a filter lets pass are shuffled.
    """
    checkpoint_dir(df.sparkSession)
    names = {c: f"__key_{c}" for c in keys}
    gone = gone.select(*[F.col(c).alias(f"__gone_{c}") for c in keys]).distinct().checkpoint()
    n = gone.count()
    rows = df.withColumns({names[c]: v for c, v in keys.items()})
    same = [F.col(names[c]).eqNullSafe(F.col(f"__gone_{c}")) for c in keys]
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), same, "left_anti").select(*df.columns)
    whole = F.xxhash64(*names.values())
    probed = maybe_in(rows.withColumn("__whole", whole), "__whole", gone.select(F.xxhash64(*[f"__gone_{c}" for c in keys]).alias("__whole")), n)
    return probed.filter("NOT __maybe").select(*df.columns).unionByName(probed.filter("__maybe").join(gone, same, "left_anti").select(*df.columns))
