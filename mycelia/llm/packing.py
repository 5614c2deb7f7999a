"""Packing of token sequences into bins by swap-based local search.

Documents are encoded and cut into pieces of at most `capacity` ids. Pieces
are dealt at random, by a hash of the row and its number, to groups of a bounded size; each group is
packed on its own, at the cost of at most a bin or two that a single packing
of everything would save. Within a group a best-fit pass gives the start. Then
the local search works on underfull bins: it takes the emptiest and moves its
pieces to others, exchanges one of them for a smaller one, or one for two
smaller ones, or two for one, with any bin at least as full. Each step raises
the sum of squared fills. It ends when no such move or exchange is left, or the
group has as few bins as its total needs.

Defined results. Null text counts as empty and is the end id alone. Null or
repeated ids are packed like any other row. Ties are broken by id, piece and
checksum. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, documents, in_batches, resting
from .token_orc import lists
from .tokens import batches, encoder, tokenizer_path

CAPACITY = 4096
#: Pieces packed together at most, on average: about 16 MB in a task.
GROUP = 16_384


def _pieces(tokenizer: str, end_id: int, capacity: int, with_ids: bool, special: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer_path(tokenizer), special), np.asarray([end_id], "<u4").tobytes()
        for batch in rows:
            for some, texts in batches(batch, 1):
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, x in enumerate(own.encode(texts)):
                    x += end
                    for j in range(0, len(x), 4 * capacity):
                        part = x[j : j + 4 * capacity]
                        at.append(k)
                        piece.append(j // (4 * capacity))
                        start.append(j // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [some.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, lists(ids)] if with_ids else columns, [*names, "ids"] if with_ids else names)

    return resting(run)


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special: bool = True) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves. special: whether special tokens' strings in a text are those tokens."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))).mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids, special), schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[k]
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        if room - size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Fewer bins, by moves and exchanges between underfull ones that raise the sum of squared fills, until none is left.

    A bin that nothing helps is looked at again only after a change of it, or
    of another one that it could then give to.
    """
    bins = [b for b in bins if b]
    size, left, fewest = np.asarray(lengths, np.int64), len(bins), -(-sum(lengths) // capacity)
    room = np.asarray([capacity - sum(lengths[k] for k in b) for b in bins], np.int64)
    items = np.asarray([k for b, r in zip(bins, room, strict=True) if r for k in b], np.int64)  # a full bin has no part in it
    home = np.zeros(len(lengths), np.int64)
    for b, own in enumerate(bins):
        home[own] = b
    item_size, item_bin = size[items], home[items]
    place = np.zeros(len(lengths), np.int64)
    place[items] = np.arange(len(items))
    version = np.zeros(len(bins), np.int64)
    # sums of two items of a bin, bin, and the bin's version that they are of; rows of older versions are dropped now and then
    pairs, used = np.zeros((3, 1024), np.int64), 0

    def of_two(b: int) -> dict[int, list[int]]:
        one: dict[int, list[int]] = {}
        for k in bins[b]:
            one.setdefault(lengths[k], []).append(k)
        kinds = sorted(one.items())
        return {x + y: [j[0], k[0]] for i, (x, j) in enumerate(kinds) for y, k in kinds[i + 1 :]} | {2 * x: j[:2] for x, j in kinds if len(j) > 1}

    def note(b: int) -> None:
        nonlocal pairs, used
        sums = list(of_two(b))
        if used + len(sums) > pairs.shape[1]:
            live = pairs[:, :used]
            live = live[:, live[2] == version[live[1]]]
            pairs, used = np.zeros((3, 2 * (live.shape[1] + len(sums)) + 1024), np.int64), live.shape[1]
            pairs[:, :used] = live
        pairs[0, used : used + len(sums)] = sums
        pairs[1:, used : used + len(sums)] = [[b], [version[b]]]
        used += len(sums)

    def below(sizes) -> np.ndarray:
        """For each number up to twice the capacity, the largest of the sizes that isn't above it, or 0."""
        out = np.zeros(2 * capacity + 1, np.int64)
        out[list(sizes)] = list(sizes)
        return np.maximum.accumulate(out)

    def change(low: int, high: int, out: list[int], back: list[int]) -> None:
        """Items `out` of bin low go to bin high and `back` come from there."""
        d = sum(lengths[k] for k in out) - sum(lengths[k] for k in back)
        bins[low] = [k for k in bins[low] if k not in out] + back
        bins[high] = [k for k in bins[high] if k not in back] + out
        room[low] += d
        room[high] -= d
        item_bin[place[out]], item_bin[place[back]] = high, low
        for b in (low, high):
            version[b] += 1
            note(b)

    def move(low: int) -> int:
        """The largest item of the bin that fits goes to the fullest other bin that has room for it. That bin, or -1."""
        others = np.flatnonzero((room <= room[low]) & (room > 0))
        others = others[others != low]
        if len(others):
            most = int(room[others].max())
            for k in sorted(bins[low], key=lambda k: -lengths[k]):
                if lengths[k] <= most:
                    fits = others[room[others] >= lengths[k]]
                    high = int(fits[room[fits].argmin()])
                    change(low, high, [k], [])
                    return high
        return -1

    def exchange(low: int) -> int:
        """The exchange that takes most from the bin, to one at least as full: one or two of its items for one, or one for two. That bin, or -1."""
        one, two = {lengths[k]: [k] for k in bins[low]}, of_two(low)
        best: tuple[int, int, int, bool] = 0, 0, 0, False
        for given, where, sizes, double in ((item_size, item_bin, {*one, *two}, False), (pairs[0, :used], pairs[1, :used], set(one), True)):
            if not len(given):
                continue
            free = room[where]
            gain = below(sizes)[given + free] - given
            gain[(free > room[low]) | (where == low) | (double and pairs[2, :used] != version[where])] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = int(gain[k]), int(where[k]), int(given[k]), double
        d, high, back, double = best
        if not d:
            return -1
        theirs = of_two(high) if double else {lengths[k]: [k] for k in bins[high]}
        change(low, high, one.get(back + d) or two[back + d], theirs[back])
        return high

    def helped(b: int) -> np.ndarray:
        """Bins that could now give something to bin b."""
        theirs = {lengths[k] for k in bins[b]}
        can = []
        for given, sizes, where in (({0, *theirs, *of_two(b)}, item_size, item_bin), (theirs, pairs[0, :used], pairs[1, :used])):
            # a size goes if something less than it, by the bin's room at most, comes back
            start = np.zeros(3 * capacity + 2, np.int64)
            for g in given:
                start[g + 1] += 1
                start[g + 1 + room[b]] -= 1
            can.append(where[(start.cumsum() > 0)[sizes] & (room[where] >= room[b])])
        # a pair of an older version may be among them: a bin that is looked at in vain
        return np.unique(np.concatenate(can))

    for b in np.unique(item_bin).tolist():
        note(b)
    waiting = {*np.unique(item_bin).tolist()}
    queue = [(-int(room[b]), b) for b in waiting]
    heapify(queue)
    while left > fewest and queue:
        r, low = heappop(queue)  # the emptiest first
        if low not in waiting or -r != room[low]:
            continue
        high = move(low)
        if high < 0:
            high = exchange(low)
        if high < 0:
            waiting.discard(low)
            continue
        left -= not bins[low]
        for b in {low, high, *(x for y in (low, high) if bins[y] and room[y] for x in helped(y).tolist())}:
            if bins[b] and room[b]:
                if b not in waiting or b in (low, high):
                    heappush(queue, (-int(room[b]), b))
                waiting.add(b)
            else:
                waiting.discard(b)
        if not bins[low]:
            room[low] = 0  # an emptied bin takes nothing
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


def _packed(capacity: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop(["__group"]).sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        lengths = rows["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, items in enumerate(pack(lengths, capacity)):
            at = 0
            for k in items:
                sequence[k], offset[k] = (key[0].as_py() << 32) + number, at
                at += lengths[k]
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces: doc_id, piece, start, length, ids_crc32, computed once and kept in a checkpoint. Adds sequence_id and offset."""
    checkpoint_dir(pieces.sparkSession)
    pieces = pieces.checkpoint()
    groups = -(-pieces.count() // group) or 1
    # a piece that fills a bin needs no search, but is a group's row like any other
    # the row's number in the checkpoint deals out rows that are equal
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups).cast("long")))
    return dealt.groupBy("__group").applyInArrow(_packed(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(token_pieces(documents(spark, sf_dir)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packing plan of all rows left. Rows with a null or a repeated id are packed like any other, null text as empty text."""
    return pack_pieces(token_pieces(docs))
