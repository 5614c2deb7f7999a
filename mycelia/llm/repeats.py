"""Removal of byte strings of `length` bytes that start at more than one place.

Two equal strings have the same anchor, the smallest of the hashes of their
k-byte substrings, at the same offset. So the strings of a text fall into
pieces, one per anchor: all strings whose anchor stands at that place, at most
length - k + 1 of them, which all overlap. Only pieces whose anchor occurs
more than once can hold a repeat.

Pieces are grouped by their bytes, so each different piece is there once, with
the number of its places. The different pieces of an anchor form a collection,
aligned at the anchor; one with several places is in it twice. A collection
goes through a column-wise construction from the right: each round takes the
next column, inserts one symbol per piece into the collection's positional
Burrows-Wheeler transform, and updates the order of the suffixes and their
common prefixes. A string repeats if, in the round of its first column, its
suffix has `length` symbols in common with a neighbour. That compares bytes;
hashes only say which pieces meet. As equal strings have the same column,
suffixes of different columns need not be merged, so a round costs the number
of pieces and not of all symbols.

A large collection is dealt out by longer contexts: a string has half of what
is beside its anchor on the left or on the right, so its half of the piece
meets the halves with the same context. What is still very large is compared
by digests of single strings instead, combined within each task first.

Pieces that are equal within a block of text are one row, and their places
come as spans that are already merged, so that a long run of one byte, or of a
short period, is a handful of rows. A piece's hash stands for its bytes in the
join with its places; hashes that several pieces share are looked up by the
bytes instead.

Defined results. Null text counts as empty; texts under `length` bytes have
no strings and stay whole. Rows that are equal in id and text count as
several places. Null ids are kept. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint_dir, documents, in_batches, resting, scratch
from .tokens import batches

LENGTH, K = 200, 40
#: Different pieces of an anchor up to which they are one collection; more are dealt out by their halves' contexts,
SPLIT = 1_000
#: and halves of a context up to which they are one collection of about 16 MB.
COLLECTION = 50_000
#: Bytes handled at once; longer texts are handled in parts that overlap.
BLOCK = 500_000
#: The filter of repeated anchors has 16 bits for each, but at most so many: 32 MB.
MAX_BITS = 1 << 28
#: Pieces that a task compares at once.
ROUND = 60_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOW = np.uint64((1 << 24) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** 0..n and its inverse's, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, inverse))


_known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_SYMBOL = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def pieces(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K, bits: int = 64):
    """Pieces of texts that follow each other in `data` and end at `ends`; together under 2 ** 24 bytes. bits: of a piece's hash; fewer cost time, not correctness.

    Returns arrays: text, start in data, strings, anchor's place behind the start, anchor's hash, piece's hash.
    """
    n, w = len(data), length - k + 1
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64))
    sizes = np.diff(ends, prepend=0)
    if not len(sizes) or sizes.max() < length:
        return none
    if "powers" not in _known or len(_known["powers"][0]) <= n:
        _known["powers"] = _powers(max(n, BLOCK + length))
    up, down = _known["powers"]
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOL[data] * up[:n], out=sums[1:])
        anchors = _mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])
    # the smallest hash, and of equal ones the first, of each w in a row
    keyed = (anchors & ~_LOW) | np.arange(len(anchors), dtype=np.uint64)
    blocks = -(-len(keyed) // w) + 1
    padded = np.full(blocks * w, np.iinfo(np.uint64).max)
    padded[: len(keyed)] = keyed
    rows = padded.reshape(blocks, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(keyed) - w + 1
    place = (np.minimum(after[:starts], before[w - 1 : w - 1 + starts]) & _LOW).astype(np.int64)
    # strings that lie in one text
    first = ends - sizes
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(ends)), counts)
    start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + first[text]
    anchor = place[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    strings = np.diff(np.append(new, len(start)))
    s = start[new]
    with np.errstate(over="ignore"):
        whole = _mixed((sums[s + strings + length - 1] - sums[s]) * down[s] + strings.astype(np.uint64))
    return text[new], s, strings, anchor[new] - s, anchors[anchor[new]].view(np.int64), (whole & np.uint64((1 << bits) - 1)).view(np.int64)


def _blocks(batch: pa.RecordBatch, column: int, length: int):
    """Of a batch's texts in bytes: (rows, offset of each in its text, data, ends) of parts of about BLOCK bytes. Each string lies in one part."""
    for some, texts in batches(batch, column, BLOCK):
        if len(texts) > 1 or len(texts[0]) <= 2 * BLOCK:
            yield some, np.arange(len(texts)), np.zeros(len(texts), np.int64), np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
            continue
        for at in range(0, len(texts[0]), BLOCK):
            part = texts[0][at : at + BLOCK + length - 1]
            yield some, np.zeros(1, np.int64), np.asarray([at]), np.frombuffer(part, np.uint8), np.asarray([len(part)])


def _anchor_hashes(length: int, k: int):
    """For each anchor of a block, how often it occurs there."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, _, _, data, ends in _blocks(batch, 2, length):
                h, n = np.unique(pieces(data, ends, length, k)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n, pa.int32())], ["h", "n"])

    return resting(run)


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(7)) & np.uint64(bits - 1)


def _bitmap(bits: int):
    """One row of places in the filter: those that any hash of the partition sets, by word of 64."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(bits // 8, np.uint8)
        for batch in rows:
            at = _bits(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(mask, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        words = mask.view("<i8")
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used], pa.int64())], ["place", "bits"])

    return resting(run)


def _filter(anchors: DataFrame, n: int, limit: int = MAX_BITS) -> np.ndarray:
    """Bits that the hashes set, as bytes; at most `limit` of them, which is what comes to the driver."""
    bits = 1 << 16
    while bits < limit and bits < 16 * n:
        bits *= 2
    mask = np.zeros(bits // 64, "<i8")
    words = anchors.coalesce(max(1, min(8, n // 100_000))).mapInArrow(_bitmap(bits), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    for row in words.toLocalIterator():
        mask[row["place"]] = row["bits"]
    return mask.view(np.uint8)


def _in_filter(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    place = _bits(h, 8 * len(mask))
    return (mask[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _merged(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans a..b of texts, joined where they overlap or touch."""
    order = np.lexsort((a, text))
    text, a, b = text[order], a[order], b[order]
    wide = int(b.max(initial=0)) + 1
    reach = np.maximum.accumulate(b + text * wide) - text * wide  # a text's spans lie beyond those of the text before
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (text[1:] != text[:-1]) | (a[1:] > reach[:-1])]))
    return text[new], a[new], reach[np.append(new[1:], len(a)) - 1] if len(a) else b


FOUND = "doc_id long, text_hash long, start long, strings int, at int, h long, ph long, n int, content binary"


def _candidates(length: int, k: int, bits: int, repeated):
    """Different pieces of a block whose anchor may be in the filter `repeated`, with their bytes; n is 2 if a piece is there more often.
    Then the places of those, as merged spans without a hash."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for some, row, offset, data, ends in _blocks(batch, 2, length):
                text, start, strings, at, h, ph = pieces(data, ends, length, k, bits)
                hit = np.flatnonzero(_in_filter(h, repeated.value))
                if not len(hit):
                    continue
                text, start, strings, at, h, ph = (x[hit] for x in (text, start, strings, at, h, ph))
                raw = data.tobytes()
                size = strings + length - 1
                content = [raw[a:b] for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]
                first: dict[bytes, int] = {}
                of = np.asarray([first.setdefault(c, i) for i, c in enumerate(content)])
                own = np.flatnonzero(of == np.arange(len(of)))
                n = np.minimum(np.bincount(of, minlength=len(of))[own], 2)
                begin = np.concatenate([[0], ends])
                place = start - begin[text] + offset[text]
                again = np.flatnonzero(np.bincount(of, minlength=len(of))[of] > 1)
                where, a, b = _merged(text[again], place[again], place[again] + size[again])
                both = np.concatenate([row[text[own]], row[where]])
                gone = np.arange(len(both)) >= len(own)
                fill = lambda x, m=len(where): np.concatenate([x, np.zeros(m, x.dtype)])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(both)),
                        some.column(1).take(pa.array(both)),
                        pa.array(np.concatenate([place[own], a])),
                        pa.array(np.concatenate([strings[own], b - a - length + 1]).astype(np.int32)),
                        pa.array(fill(at[own]).astype(np.int32)),
                        pa.array(fill(h[own]), mask=gone),
                        pa.array(fill(ph[own]), mask=gone),
                        pa.array(fill(n).astype(np.int32)),
                        pa.array([*[content[i] for i in own.tolist()], *[None] * len(where)], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "start", "strings", "at", "h", "ph", "n", "content"],
                )

    return resting(run)


def compare(group: np.ndarray, contents: list[bytes], at: np.ndarray, strings: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """First and last string of each piece that another piece of its group has too, -1 if none.

    group: numbers, ascending. at: the anchor's place in a piece.
    """
    n, left = len(contents), length - k
    width = left + length
    low, high = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    begin = left - at
    size = strings + length - 1
    columns = np.zeros((width, n), np.uint8)
    for s in range(0, n, 4096):  # pieces are turned into columns some at a time
        some = np.zeros((min(4096, n - s), width), np.uint8)
        for i, c in enumerate(contents[s : s + 4096]):
            some[i, begin[s + i] : begin[s + i] + size[s + i]] = np.frombuffer(c, np.uint8)
        columns[:, s : s + 4096] = some.T
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    for j in range(width - 1, -1, -1):
        inside = (j >= begin) & (j < begin + size)
        symbol = np.where(inside, columns[j], 256)[order]
        key = group[order] * 257 + symbol
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % 257 != 256))
        new = np.zeros(n + 1, np.int32)
        if len(same):
            cuts = np.empty(2 * len(same), np.int64)
            cuts[::2], cuts[1::2] = turn[same] + 1, turn[same + 1] + 1
            new[same + 1] = np.minimum(np.minimum.reduceat(common, cuts)[::2] + 1, length)
        order, common = order[turn], new
        full = common >= length
        found = order[full[:-1] | full[1:]]
        found = found[(j >= begin[found]) & (j < begin[found] + strings[found])]
        place = j - begin[found]
        low[found] = place
        high[found] = np.where(high[found] < 0, place, high[found])
    return low, high


HALVES = "g long, h long, ph long, shift int, strings int, at int, n int, content binary, whole binary"


def _halves(length: int, k: int):
    """The strings of a piece whose anchor has half of the other bytes on its left, and those that have it on the right, each with that context's hash."""
    half = (length - k + 1) // 2

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple] = []
            for h, ph, strings, at, n, content, whole in zip(*(batch[c].to_pylist() for c in ("h", "ph", "strings", "at", "n", "content", "whole")), strict=True):
                # string i has at - i bytes before the anchor
                turn = min(max(at - half + 1, 0), strings)
                for side, a, b in ((b"l", 0, turn), (b"r", turn, strings)):
                    if a < b:
                        context = content[at - half : at + k] if side == b"l" else content[at : at + length - half + 1]
                        g = int.from_bytes(hashlib.blake2b(side + context, digest_size=8).digest(), "little", signed=True)
                        out.append((g, h, ph, a, b - a, at - a, n, content[a : b + length - 1], whole))
            columns = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in HALVES.split(", ")])

    return resting(run)


def _compared(length: int, k: int):
    """Rows as HALVES has them, sorted by g."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def results(table: pa.Table) -> pa.RecordBatch:
            g = table["g"].to_numpy()
            n = np.minimum(table["n"].to_numpy(), 2)  # a piece with several places meets itself
            each = np.repeat(np.arange(len(n)), n)
            group = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]])) if len(g) else g
            content = table["content"].to_pylist()
            low, high = compare(group[each], [content[i] for i in each.tolist()], table["at"].to_numpy()[each], table["strings"].to_numpy()[each], length, k)
            first = np.cumsum(n) - n  # both copies have the same result
            low, high, shift = low[first], high[first], table["shift"].to_numpy()
            hit = low >= 0
            keep = pa.array(np.flatnonzero(hit))
            return pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(keep) for c in ("h", "ph", "whole")), pa.array((low + shift)[hit]), pa.array((high + shift)[hit])], ["h", "ph", "whole", "low", "high"])

        count = 0
        for batch in rows:
            held.append(batch)
            count += batch.num_rows
            if count > ROUND:
                table = pa.Table.from_batches(held).combine_chunks()
                g = table["g"].to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if cut:
                    yield results(table.slice(0, cut))
                rest = table.slice(cut)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield results(pa.Table.from_batches(held).combine_chunks())

    return resting(run)


def _remaining(texts: list[bytes], spans: list[list[tuple[int, int]]]):
    """Removed bytes, maximal removed runs, and what is left of each text."""
    removed, runs, left = [], [], []
    for text, own in zip(texts, spans, strict=True):
        merged: list[list[int]] = []
        for a, b in sorted(own):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out, at = [], 0
        for a, b in merged:
            out.append(text[at:a])
            at = b
        out.append(text[at:])
        removed.append(sum(b - a for a, b in merged))
        runs.append(len(merged))
        left.append(b"".join(out))
    return removed, runs, left


def _removed(with_text: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for some, texts in batches(batch, 1):
                spans = [[(x["a"], x["b"]) for x in own or ()] for own in some.column(2).to_pylist()]
                removed, runs, left = _remaining(texts, spans)
                columns = [some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.binary())] if with_text else columns, [*names, "kept"] if with_text else names)

    return resting(run)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def repeat_spans(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", collection: int = COLLECTION, split: int = SPLIT, max_bits: int = MAX_BITS, piece_bits: int = 64) -> DataFrame:
    """Spans of bytes that repeats cover: doc_id, text_hash, a, b. Spans may overlap. The last four settings cost time or memory, not correctness."""
    if not 0 < k <= length:
        raise ValueError("k must be from 1 to length")
    spark = docs.sparkSession
    checkpoint_dir(spark)
    texts = in_batches(_texts(docs, id_col, text_col)).filter(F.octet_length("text") >= length)
    anchors = texts.mapInArrow(_anchor_hashes(length, k), "h long, n int")
    repeated = anchors.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h").checkpoint()
    n = repeated.count()
    filter_ = spark.sparkContext.broadcast(_filter(repeated, n, max_bits))
    path = scratch(spark, "pieces")
    candidates = texts.mapInArrow(_candidates(length, k, piece_bits, filter_), FOUND)
    if 8 * n > max_bits:  # the filter lets too much pass
        # rows without a hash are spread over all tasks, and stay
        key = F.coalesce("h", F.xxhash64("doc_id", "start"))
        known = candidates.withColumn("__key", key).join(repeated.select(F.col("h").alias("__key"), F.lit(True).alias("__in")), "__key", "left")
        candidates = known.filter("h IS NULL OR __in").select(*candidates.columns)
    candidates.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    found = spark.read.schema(FOUND).parquet(path)
    places = found.filter("h IS NOT NULL").select("doc_id", "text_hash", "start", "strings", "h", "ph")
    spans = found.filter("h IS NULL").select("doc_id", "text_hash", F.col("start").alias("a"), (F.col("start") + F.col("strings") + (length - 1)).alias("b"))

    # each different piece once, by its bytes
    kept = scratch(spark, "contents")
    found.filter("h IS NOT NULL").groupBy("h", "ph", "content").agg(F.sum("n").alias("n"), F.min("strings").alias("strings"), F.min("at").alias("at")).write.option("compression", "zstd").parquet(kept)
    contents = spark.read.schema("h long, ph long, content binary, n long, strings int, at int").parquet(kept)
    large = contents.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > split).select("h").checkpoint()
    many = large.count()
    large = F.broadcast(large) if many <= BROADCAST_ROWS else large
    clash = contents.groupBy("h", "ph").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h", "ph").checkpoint()
    clashes = not clash.isEmpty()
    if clashes:
        contents = contents.join(clash.withColumn("__clash", F.lit(True)), ["h", "ph"], "left").withColumn("whole", F.when(F.col("__clash"), F.col("content"))).drop("__clash")
    else:
        contents = contents.withColumn("whole", F.lit(None).cast("binary"))
    rows = contents.join(large, "h", "left_anti") if many else contents
    results = _columns(rows.select(F.col("h").alias("g"), "h", "ph", F.lit(0).alias("shift"), "strings", "at", F.col("n").cast("int"), "content", "whole"), length, k)
    if many:
        results = results.unionByName(_dealt(contents.join(large, "h", "left_semi"), length, k, collection))
    results = results.groupBy("h", "ph", "whole").agg(F.min("low").alias("low"), F.max("high").alias("high")).checkpoint()
    # a third of all places can be of one piece: a join of two exchanges can be split
    covered = places.join(results.filter("whole IS NULL").drop("whole"), ["h", "ph"])
    span = ("doc_id", "text_hash", (F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high") + length).alias("b"))
    spans = spans.unionByName(covered.select(*span))
    if clashes:
        own = _texts(docs, id_col, text_col).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "text").distinct()
        unsure = places.join(clash, ["h", "ph"], "left_semi").join(own, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash")))
        by_bytes = unsure.withColumn("whole", F.substring("text", F.col("start").cast("int") + 1, F.col("strings") + (length - 1))).drop("text", "__doc", "__hash")
        spans = spans.unionByName(by_bytes.join(results.filter("whole IS NOT NULL"), ["h", "ph", "whole"]).select(*span))
    return spans


def _columns(rows: DataFrame, length: int, k: int) -> DataFrame:
    """rows as HALVES has them, each g a collection: h, ph, whole, low, high of those with a repeat."""
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_compared(length, k), "h long, ph long, whole binary, low int, high int")


def _dealt(contents: DataFrame, length: int, k: int, collection: int) -> DataFrame:
    """Results of anchors with many pieces, by halves of pieces."""
    halves = in_batches(contents.withColumn("n", F.col("n").cast("int")).select("h", "ph", "strings", "at", "n", "content", "whole")).mapInArrow(_halves(length, k), HALVES).checkpoint()
    large = halves.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > collection).select("g").checkpoint()
    if large.isEmpty():
        return _columns(halves, length, k)
    return _columns(halves.join(large, "g", "left_anti").select(*halves.columns), length, k).unionByName(_by_digest(halves.join(large, "g", "left_semi"), length))


def _by_digest(halves: DataFrame, length: int) -> DataFrame:
    """Halves whose strings are compared one by one."""
    string = F.substring("content", F.col("i") + 1, F.lit(length))
    single = halves.select("g", "h", "ph", "whole", "shift", "n", F.explode(F.sequence(F.lit(0), F.col("strings") - 1)).alias("i"), "content").select("g", "h", "ph", "whole", (F.col("shift") + F.col("i")).alias("i"), "n", F.sha2(string, 256).alias("d")).checkpoint()
    twice = single.groupBy("g", "d").agg(F.sum("n").alias("n")).filter("n > 1").select("g", "d")
    return single.join(twice, ["g", "d"]).groupBy("h", "ph", "whole").agg(F.min("i").alias("low"), F.max("i").alias("high")).select("h", "ph", "whole", "low", "high")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **settings: int) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left)."""
    # rows that are equal in id and text have their spans in common, once
    each = repeat_spans(docs, length, k, id_col, text_col, **settings).groupBy("doc_id", "text_hash", "a").agg(F.max("b").alias("b"))
    spans = each.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    texts = _texts(docs, id_col, text_col)
    keyed = texts.withColumnRenamed("doc_id", "__doc_id").withColumnRenamed("text_hash", "__text_hash")
    joined = keyed.join(spans, F.col("__doc_id").eqNullSafe(F.col("doc_id")) & (F.col("__text_hash") == F.col("text_hash")), "left")
    return joined.select(F.col("__doc_id").alias("doc_id"), "text", "spans").mapInArrow(_removed(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)
