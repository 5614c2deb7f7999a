"""Sparse matrices of MATLAB level 5 files, as a Spark data source.

The file is read through Spark's binaryFile source, so it can lie in any store
that Spark reads. One executor unpacks a matrix, as a file is one compressed
stream, and sends on its entries in blocks; its size needs the head only. Level 5 files hold at most 2 GB of a variable; version 7.3 files are
HDF5 and are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import files

#: Numbers of the format: data types, and classes of arrays.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
STRUCT, SPARSE = 2, 5
#: Entries of a file that is written: 16 bytes each here, 12 in the file.
MAX_ENTRIES = 20_000_000


class Elements:
    """Tagged elements of a byte string, in order."""

    def __init__(self, data: memoryview, order: str):
        self.data, self.order, self.at = data, order, 0

    def __iter__(self) -> Iterator[tuple[int, memoryview]]:
        while self.at + 8 <= len(self.data):
            yield self.next()

    def next(self) -> tuple[int, memoryview]:
        kind, size = struct.unpack_from(self.order + "II", self.data, self.at)
        if kind >> 16:  # a small element: size and type share a word
            size, kind, start = kind >> 16, kind & 0xFFFF, self.at + 4
            self.at += 8
        else:
            start = self.at + 8
            self.at = start + size + (-size % 8 if kind != COMPRESSED else 0)
        return kind, self.data[start : start + size]

    def numbers(self) -> np.ndarray:
        kind, raw = self.next()
        return np.frombuffer(raw, np.dtype(TYPES[kind]).newbyteorder(self.order))


def _matrix(body: memoryview, order: str):
    """Class, dimensions, name and remaining elements of a matrix element."""
    rest = Elements(body, order)
    flags, dims = rest.numbers(), rest.numbers()
    return int(flags[0]) & 0xFF, dims, bytes(rest.next()[1]).decode("latin-1"), rest


def _fields(rest: Elements) -> dict[str, memoryview]:
    width = int(rest.numbers()[0])
    names = bytes(rest.next()[1])
    keys = [names[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(names), width)]
    return {key: rest.next()[1] for key in keys}


def sparse_matrix(data: bytes) -> tuple[int, Elements]:
    """Rows, and what is behind the head, of field A of a struct Problem, or else of the first sparse variable."""
    if data[:8] == b"\x89HDF\r\n\x1a\n" or data[124:126] in (b"\x00\x02", b"\x02\x00"):
        raise ValueError("version 7.3 files (HDF5) can't be read")
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB level 5 file")
    order = "<" if data[126:128] == b"IM" else ">"
    first = None
    for kind, body in Elements(memoryview(data)[128:], order):
        if kind == COMPRESSED:
            kind, body = Elements(memoryview(zlib.decompress(body)), order).next()
        if kind != MATRIX:
            continue
        cls, dims, name, rest = _matrix(body, order)
        if cls == STRUCT and name == "Problem":
            if (field := _fields(rest).get("A")) is None:
                raise ValueError("Problem has no field A")
            cls, dims, _, rest = _matrix(field, order)
            if cls != SPARSE:
                raise ValueError("Problem.A is not sparse")
            first = dims, rest
            break
        if cls == SPARSE and first is None:
            first = dims, rest
    if first is None:
        raise ValueError("no sparse matrix found")
    return int(first[0][0]), first[1]


def sparse_entries(data: bytes, step: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each entry's row and column, some at a time."""
    _, rest = sparse_matrix(data)
    rows, starts = rest.numbers(), rest.numbers().astype(np.int64)
    for k in range(0, int(starts[-1]) if len(starts) else 0, step):
        some = rows[k : min(k + step, int(starts[-1]))].astype(np.int64)
        yield some, np.searchsorted(starts, np.arange(k, k + len(some)), "right") - 1


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            for src, dst in sparse_entries(raw.as_py()):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sparse_matrix(raw.as_py())[0] for raw in batch.column(0)], pa.int64())], ["n"])


def read_mat(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(src, dst) and the number of rows."""
    content = spark.read.format("binaryFile").load(path).select("content")
    return content.mapInArrow(_entries, "src long, dst long"), int(content.mapInArrow(_sizes, "n long").first()[0])


def mat_bytes(n: int, m: int, src: np.ndarray, dst: np.ndarray, nested: bool = True, compressed: bool = True) -> bytes:
    """A level 5 file with one sparse matrix of ones, as Problem.A or as A."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    def matrix(cls: int, dims: tuple[int, ...], name: str, rest: bytes) -> bytes:
        return element(MATRIX, element(6, struct.pack("<II", cls, len(src))) + element(5, struct.pack(f"<{len(dims)}i", *dims)) + element(1, name.encode()) + rest)

    order = np.lexsort((src, dst))
    starts = np.searchsorted(dst[order], np.arange(m + 1)).astype("<i4")
    body = element(5, src[order].astype("<i4").tobytes()) + element(5, starts.tobytes()) + element(9, np.ones(len(src), "<f8").tobytes())
    if nested:
        whole = matrix(STRUCT, (1, 1), "Problem", element(5, struct.pack("<i", 8)) + element(1, b"A".ljust(8, b"\0")) + matrix(SPARSE, (n, m), "", body))
    else:
        whole = matrix(SPARSE, (n, m), "A", body)
    if compressed:
        packed = zlib.compress(whole)
        whole = struct.pack("<II", COMPRESSED, len(packed)) + packed
    return b"MATLAB 5.0 MAT-file".ljust(124) + b"\x00\x01IM" + whole


def save_mat(edges: DataFrame, path: str, n: int) -> None:
    """Write (src, dst) as a level 5 file of an n x n matrix, in any store that Spark reaches. The format ends at 2 GB, so the entries fit the driver; more are refused."""
    if edges.count() > MAX_ENTRIES:
        raise ValueError(f"a level 5 file can't hold more than {MAX_ENTRIES} entries")
    pairs = edges.select("src", "dst").toPandas()
    files.write_bytes(edges.sparkSession, path, mat_bytes(n, n, pairs["src"].to_numpy(), pairs["dst"].to_numpy()))


def write_mat(path: str, *args, **kwargs) -> None:
    with open(path, "wb") as f:
        f.write(mat_bytes(*args, **kwargs))
