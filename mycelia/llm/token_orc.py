"""Token ids in ORC files, and their reading.

Rows go to range partitions of the id and are sorted within them, so files
follow each other in ascending id order. A row is a document: its ids are an
integer list that ORC stores with run-length encoding, stripes can be read in
parallel, row indexes and Bloom filters on the id let a reader skip what it
doesn't want. Each row has its file's number and how many ids of that file are
before it; the start in the whole output is that plus the sum of the files
before, of which there is one number a file.

Defined results. Null text counts as empty and gives the end id alone. Null
ids sort first. Rows with equal ids follow each other by text. An empty table
gives no files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, in_batches, resting, scratch
from .tokens import batches, encoder, tokenizer_path

ROWS = "part int, doc_id long, before long, n_tokens long, ids array<int>"


def lists(parts: list[bytes]) -> pa.Array:
    """An Arrow list<int32> of little-endian ids."""
    ends = np.cumsum([0, *(len(x) // 4 for x in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))


def _encode(tokenizer: str, end_id: int, special: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, end = TaskContext.get().partitionId(), 0, np.asarray([end_id], "<u4").tobytes()
        own = encoder(tokenizer_path(tokenizer), special)
        for batch in rows:
            for some, texts in batches(batch, 1):
                ids = [x + end for x in own.encode(texts)]
                n = np.asarray([len(x) // 4 for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), some.column(0), pa.array(starts), pa.array(n), lists(ids)], ["part", "doc_id", "before", "n_tokens", "ids"])

    return resting(run)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", row_index_stride: int = 1000, special: bool = True) -> None:
    """Encode and write all documents. The number of files is that of the session's shuffle partitions, or fewer if they are small."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = in_batches(rows).mapInArrow(_encode(tokenizer, end_id, special), ROWS)
    encoded.write.option("orc.compress", "ZSTD").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(row_index_stride)).option("orc.create.index", "true").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of files that write_tokens wrote."""
    rows = spark.read.schema(ROWS).orc(path)
    ends = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("__total"))
    bases = ends.select("part", F.coalesce(F.sum("__total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("__base") + F.col("before")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Tokens of some documents; files, stripes and row groups without them are skipped by their metadata."""
    return spark.read.schema(ROWS).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _checksum(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids = batch.column(3)
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def with_checksums(tokens: DataFrame) -> DataFrame:
    return in_batches(tokens).mapInArrow(resting(_checksum), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return with_checksums(read_tokens(spark, path))
