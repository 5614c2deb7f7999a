"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set if more than half of its shingles' hashes
have it set. Fingerprints within `radius` bits of each other are linked, and
the components of the links are the groups.

Links are found without loss by covering masks: each bit position gets a
vector of radius + 1 bits, and each vector v that isn't zero gives a mask of
the positions whose vectors have an odd product with v. The positions where
two fingerprints within the radius differ span at most `radius` dimensions, so
some v is orthogonal to all of them, and under its mask the two are equal. So
they meet in at least one of the 15 tables.

Equal fingerprints are one node. A bucket that holds many different nodes is
split by the same construction over the bits its mask leaves free (of 64,
about 32, then 16, then 8), so that after two more levels it can hold some
hundreds at most. A task sends on only a spanning forest of the links that
it finds.

Defined results. Null or empty texts, and texts without a word, have the
fingerprint zero and are linked like any other. Null ids take part; a group's
id is its smallest id that isn't null. Rows repeated with the same id are
returned each time. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mycelia.operators.components import connected_components, forest

from .common import checkpoint_dir, documents, in_batches, resting, without_rows
from .tokens import batches

RADIUS, SHINGLE = 3, 3
#: Different fingerprints in a bucket up to which they are compared in one task; larger buckets are split.
BUCKET = 4096
#: Shingles hashed before their bits are summed, 64 bytes each; and bytes of a text that are split into words at once.
STEP, STRETCH = 100_000, 1 << 20

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _stretches(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text in stretches of some STRETCH bytes; each but the first begins with the last size - 1 words of the one before."""
    kept: list[bytes] = []
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + STRETCH)
        end = gap.start() if gap else len(text)
        words = kept + text[at:end].lower().split()
        yield words
        kept = words[1 - size :] if size > 1 else []
        at = end


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Fingerprints as signed 64-bit integers. Bits are added up every STEP shingles, within a text too."""
    from xxhash import xxh64_intdigest as digest

    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []  # text, number of its shingles

    def flush() -> None:
        if owners:
            k, n = np.asarray(owners).T
            bits = np.unpackbits(np.asarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, k, np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.uint32))
            np.add.at(total, k, n)
        hashes.clear()
        owners.clear()

    for k, text in enumerate(texts):
        few: list[bytes] | None = []  # the words so far, while they are too few for a shingle
        for words in _stretches(text, size):
            if len(words) < size:
                few = few if few is None else words
                continue
            few = None
            joined = b" ".join(words)
            ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
            starts = [0, *(e + 1 for e in ends[:-size])]
            hashes.extend([digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :], strict=True)])
            owners.append((k, len(words) - size + 1))
            if len(hashes) > STEP:
                flush()
        if few:
            hashes.append(digest(b" ".join(few), 42))
            owners.append((k, 1))
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel().view(np.int64)


def _fingerprint(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for some, texts in batches(batch, 1):
            names = [*(n for n in some.schema.names if n != "text"), "fp"]
            yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(some.num_columns) if k != 1), pa.array(fingerprints(texts))], names)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp and, if asked for, the text's SHA-256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *([digest_of(F.col(text_col)).alias("digest")] if digest else []))
    return in_batches(rows).mapInArrow(resting(_fingerprint), "doc_id long, " + "digest binary, " * digest + "fp long")


def masks(free: int, radius: int = RADIUS, seed: int = 1) -> list[int]:
    """2 ** (radius + 1) - 1 masks over the set bits of `free`; two values that differ in at most `radius` of those agree under one of them."""
    vectors = 1 << (radius + 1)
    positions = [k for k in range(64) if free >> k & 1]
    # every vector that isn't zero comes equally often, in an order that the seed gives
    order = np.random.default_rng(seed + free % 1_000_003).permutation(len(positions))
    vector = {positions[p]: 1 + j % (vectors - 1) for j, p in enumerate(order)}
    return [sum(1 << k for k in positions if (vector[k] & v).bit_count() % 2) for v in range(1, vectors)]


def tables(depth: int, radius: int = RADIUS) -> list[int]:
    """Masks of the buckets of a level; a deeper level has, for each mask above, that mask and more bits."""
    whole = (1 << 64) - 1
    level = masks(whole, radius)
    for _ in range(depth):
        level = [above | more for above in level for more in masks(whole & ~above, radius)]
    return level


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within buckets fps[starts[i]:ends[i]]."""
    sizes = ends - starts
    for lag in range(1, min(32, int(sizes.max(initial=1)))):  # small buckets together
        few = (sizes > lag) & (sizes <= 32)
        first, n = starts[few], sizes[few] - lag
        left = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, b = fps[left], fps[left + lag]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        yield a[near], b[near]
    for s, e in zip(starts[sizes > 32], ends[sizes > 32], strict=True):
        own = fps[s:e]
        for k in range(0, len(own), 512):
            x, y = np.nonzero(np.bitwise_count((own[k : k + 512, None] ^ own[None, k:]).view(np.uint64)) <= radius)
            yield forest(own[k + x], own[k + y])


def _links(radius: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        src, dst = np.empty(0, np.int64), np.empty(0, np.int64)

        def close(last: bool) -> None:
            nonlocal rest, src, dst
            table, key, fps = rest
            if not len(fps):
                return
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (table[1:] != table[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            several = ends - starts > 1
            found = list(_near(fps, starts[several], ends[several], radius))
            if found:
                src, dst = forest(np.concatenate([src, *(a for a, _ in found)]), np.concatenate([dst, *(b for _, b in found)]))
            tail = len(fps) if last else ends[-1] if len(ends) else 0
            rest = [x[tail:] for x in rest]

        for batch in rows:
            rest = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(rest)]
            if len(rest[0]) > 200_000:
                close(False)
        close(True)
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return resting(run)


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, depth: int = 0) -> DataFrame:
    """Edges (src, dst) between values of nodes.fp, all different, that connect all pairs within the radius."""
    level = tables(depth, radius)
    dealt = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in level])).alias("table", "key")) if depth == 0 else _deeper(nodes, depth, radius)
    large = dealt.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("table", "key").checkpoint()
    here, more = dealt, None
    if depth < 2 and not large.isEmpty():
        here = dealt.join(large, ["table", "key"], "left_anti")
        more = near_links(dealt.join(large, ["table", "key"], "left_semi").select("fp", F.col("table").alias("above")), radius, bucket, depth + 1)
    found = here.select("table", "key", "fp").repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(_links(radius), "src long, dst long")
    return found if more is None else found.unionByName(more)


def _deeper(nodes: DataFrame, depth: int, radius: int) -> DataFrame:
    """Deal the rows (fp, above: their table one level up) out under the masks below that table's."""
    per = (1 << (radius + 1)) - 1
    level = [_signed(m) for m in tables(depth, radius)]
    own = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: F.col("above") * per + j)
    rows = nodes.select("fp", F.explode(own).alias("table"))
    return rows.select("fp", "table", F.col("fp").bitwiseAND(F.get(F.lit(level), F.col("table"))).alias("key"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id, root (a fingerprint that stands for the component) and, if asked for, digest."""
    checkpoint_dir(docs.sparkSession)
    rows = with_fingerprints(docs, id_col, text_col, digest).checkpoint()
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).checkpoint()
    # written before they are contracted: a task with both steps would need two Python workers
    links = near_links(nodes, radius, bucket).checkpoint()
    labels = connected_components(links).checkpoint()
    in_groups = nodes.join(labels.withColumnRenamed("id", "fp"), "fp")
    firsts = in_groups.groupBy("component").agg(F.min("first_id").alias("component_id")).checkpoint()
    named = labels.join(firsts, "component").select(F.col("id").alias("fp"), "component_id", F.col("component").alias("root"))
    # like firsts, read back from files: a join of two exchanges can split a fingerprint or group with very many rows
    of_node = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root")).checkpoint()
    return rows.join(of_node, "fp").select("doc_id", "fp", "component_id", "root", *(["digest"] if digest else []))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest id stays, of several with that id the one with the smallest digest.

    Rows are decided on one by one, by id and text; a null id comes after all
    others. Rows equal in id and text can't be told apart and stay together.
    """
    rows = simhash_groups(docs, digest=True).checkpoint()
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    first = rows.groupBy("root").agg(F.min(place).alias("__first")).checkpoint()
    gone = rows.join(first, "root").filter(place != F.col("__first")).select("doc_id", "digest")
    return without_rows(docs, gone, {"doc_id": F.col("doc_id").cast("long"), "digest": digest_of(F.col("text"))})
