"""Sampled segmentations into the pieces of a SentencePiece model, and their decoding.

A segmentation is drawn in proportion to the product of its pieces' weights:
sums over all paths of the piece lattice are filtered forward, and a path is
drawn backward from the end. The model's scores are ranks of merges, so a
piece's weight is 1 / (rank + RANK0), to the power `alpha`. A character that
is no piece is its UTF-8 bytes' pieces.

No piece has a space after another character, or letters together with other
characters, so a text's lattice falls apart into units, spaces with letters or
with others. A long unit falls apart further wherever no piece of two or more
characters reaches across, so that text without spaces is short units too. A
unit's forward sums are computed once and kept in a bounded cache; each of its
occurrences draws its own path, all of a batch at a time. What is still long,
say thousands of letters in a row, is filtered and sampled in stretches of
bounded memory. The draws come from a hash of the seed, the row's key, the
unit's number in the text and the step, so a row gets the same pieces in any
batch, order or retry. Long texts are handled in parts.

Decoding joins the pieces and takes away the space that encoding puts in
front, and gives the text back exactly. A character that looks like the
model's mark for a space is encoded as bytes.

Defined results. Null or empty text has no pieces and decodes to an empty
text. Null keys count as 0. Rows with equal key and text get equal pieces. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, resting
from .token_orc import lists
from .tokens import batches, tokenizer_path

RANK0 = 10
#: Longer units are drawn one by one and not kept, in stretches of so many characters.
UNIT, STRETCH = 24, 4096
#: Different units whose lattices a worker keeps; some 400 bytes each.
CACHE_UNITS = 300_000
#: Units learned at once, and characters drawn for at once; they bound the arrays in between.
LEARN, DRAW = 4096, 500_000

# superscripts and fractions stand with the digits
_UNITS = re.compile(r" *[^\W\d_²³¹¼½¾]+| *(?:[^\w ]|[\d_²³¹¼½¾])+| +")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of unsigned 64-bit integers."""
    x = x + _PRIME
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A model's pieces with spaces for its marks, and their weights."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        self.table: np.ndarray | None = None
        for k in range(model.vocab_size()):
            piece = model.id_to_piece(k).replace("▁", " ")
            self.bytes.append(piece.encode())
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = k
                self.bytes[k] = bytes([value])
            elif model.is_control(k) or model.is_unknown(k):
                self.bytes[k] = b""
            elif len(_UNITS.findall(piece)) == 1 and not (" " in piece.lstrip(" ")):
                self.ids[piece] = k
        self.longest = max(map(len, self.ids))
        self.weight = (1.0 / (np.arange(len(self.bytes)) + RANK0)) ** alpha

    def arcs(self, unit: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place 1..n of a unit, (from, ids, weight) of the arcs that end there."""
        out: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(len(unit) + 1)]
        for i in range(len(unit)):
            for j in range(i + 1, min(len(unit), i + self.longest) + 1):
                if (k := self.ids.get(unit[i:j])) is not None:
                    out[j].append((i, (k,), float(self.weight[k])))
            if unit[i] not in self.ids:
                raw = tuple(int(self.byte_ids[b]) for b in unit[i].encode("utf-8", "replace"))
                out[i + 1].append((i, raw, float(np.prod(self.weight[list(raw)]))))
        return out

    def decode(self, ids) -> str:
        if self.table is None:
            self.table = np.asarray([*self.bytes, b""], dtype=object)
        ids = np.asarray(ids, np.int64)
        return b"".join([b"".join(self.table[ids[k : k + DRAW]].tolist()) for k in range(0, len(ids), DRAW)])[1:].decode("utf-8", "replace")


class Sampler:
    """Draws segmentations. Lattices of units are kept as arcs sorted by the place where they end; the draw among them is a search in one array."""

    def __init__(self, pieces: Pieces, seed: int = 0):
        self.pieces, self.seed = pieces, np.uint64(seed)
        self.extra: list[tuple[int, ...]] = []  # ids of arcs that are several bytes
        self.extra_of: dict[tuple[int, ...], int] = {}
        self._clear()
        chars = sorted(pieces.ids, key=len)
        # prefixes of pieces by hash: an entry says which piece the prefix is, if any
        codes: dict[int, int] = {}
        for p in chars:
            h = 0
            for n, c in enumerate(p, 1):
                h = (h * 0x100000001B3 + ord(c) + 1) % (1 << 64)
                codes.setdefault(h, -1)
                if n == len(p):
                    codes[h] = pieces.ids[p]
        self.prefix = np.sort(np.fromiter(codes, np.uint64, len(codes)))
        self.prefix_piece = np.asarray([codes[int(h)] for h in self.prefix])

    def _clear(self) -> None:
        self.known: dict[str, int] = {}  # unit: node of its end
        self.nodes = self.arcs = 0
        self.first = np.zeros(1 << 16, np.int32)  # of a node: its first arc
        self.cum = np.zeros(1 << 17, np.float32)  # of an arc: probability of it and those before; beyond 1 for a node's last
        self.piece = np.zeros(1 << 17, np.int32)
        self.origin = np.zeros(1 << 17, np.int32)  # node where an arc begins, -1 for a unit's start

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if len(old) < at + len(values):
            grown = np.zeros(max(2 * len(old), at + len(values)), old.dtype)
            grown[:at] = old[:at]
            setattr(self, name, old := grown)
        old[at : at + len(values)] = values

    def _bytes_of(self, char: str) -> int:
        """The number of an arc for a character that is no piece: an id, or a place in `extra` beyond all ids."""
        raw = tuple(int(self.pieces.byte_ids[b]) for b in char.encode("utf-8", "replace"))
        if len(raw) == 1:
            return raw[0]
        if raw not in self.extra_of:
            self.extra_of[raw] = len(self.pieces.bytes) + len(self.extra)
            self.extra.append(raw)
        return self.extra_of[raw]

    def learn(self, units: list[str]) -> None:
        """Forward sums of short units, all at once. A unit's nodes are its places from 0 to its length; no arc ends at the first."""
        if not units:
            return
        n = len(units)
        size = np.asarray([len(u) for u in units])
        width = int(size.max())
        text = np.zeros((n, width), np.uint32)
        raw = np.array(units, dtype=f"U{width}").view(np.uint32).reshape(n, width)
        text[:] = raw
        base = self.nodes + np.cumsum(size + 1) - (size + 1)
        owner, start, length, piece, weight = [], [], [], [], []
        rows, place = np.nonzero(np.arange(width) < size[:, None])
        h = np.zeros(len(rows), np.uint64)
        whole = rows, place
        single = np.zeros((n, width), bool)
        for l in range(1, min(self.pieces.longest, width) + 1):
            with np.errstate(over="ignore"):
                h = h * np.uint64(0x100000001B3) + text[rows, place + l - 1].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(self.prefix, h), len(self.prefix) - 1)
            ok = self.prefix[at] == h
            rows, place, h, at = rows[ok], place[ok], h[ok], at[ok]
            found = self.prefix_piece[at]
            is_piece = found >= 0
            if l == 1:
                single[rows[is_piece], place[is_piece]] = True
            owner.append(rows[is_piece])
            start.append(place[is_piece])
            length.append(np.full(int(is_piece.sum()), l))
            piece.append(found[is_piece])
            more = place + l < size[rows]
            rows, place, h = rows[more], place[more], h[more]
        lone = ~single[whole]
        if lone.any():
            r, c = whole[0][lone], whole[1][lone]
            kinds = {x: self._bytes_of(chr(x)) for x in np.unique(text[r, c]).tolist()}
            owner.append(r)
            start.append(c)
            length.append(np.ones(len(r), np.int64))
            piece.append(np.asarray([kinds[x] for x in text[r, c].tolist()]))
        owner, start, length, piece = map(np.concatenate, (owner, start, length, piece))
        n_ids = len(self.pieces.bytes)
        weight = np.where(piece < n_ids, self.pieces.weight[np.minimum(piece, n_ids - 1)], 1.0)
        for k in np.flatnonzero(piece >= n_ids):
            weight[k] = np.prod(self.pieces.weight[list(self.extra[piece[k] - n_ids])])
        end = start + length
        order = np.lexsort((length, end, owner))
        owner, start, end, piece, weight = (x[order] for x in (owner, start, end, piece, weight))
        # forward sums, place by place
        total = np.zeros((n, width + 1))
        total[:, 0] = 1
        by_end = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[by_end], np.arange(1, width + 2))
        part = np.zeros(len(owner))
        for j in range(1, width + 1):
            some = by_end[cuts[j - 1] : cuts[j]]
            part[some] = total[owner[some], start[some]] * weight[some]
            total[:, j] = np.bincount(owner[some], part[some], n)
        node = base[owner] + end
        first = np.concatenate([[True], node[1:] != node[:-1]])
        share = part / total[owner, end]
        run = np.cumsum(share)
        before = run - share
        cum = run - np.repeat(before[first], np.diff(np.concatenate([np.flatnonzero(first), [len(node)]])))
        last = np.concatenate([first[1:], [True]])
        cum[last] = 2
        starts = np.zeros(int((size + 1).sum()), np.int32)
        starts[node[first] - self.nodes] = self.arcs + np.flatnonzero(first)
        self._put("first", self.nodes, starts)
        self._put("cum", self.arcs, cum)
        self._put("piece", self.arcs, piece)
        self._put("origin", self.arcs, np.where(start == 0, -1, base[owner] + start))
        self.known.update(zip(units, (base + size).tolist(), strict=True))
        self.nodes += len(starts)
        self.arcs += len(cum)

    @staticmethod
    def _stream(key: np.ndarray, number: np.ndarray, seed: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(mixed(key + seed * _PRIME) ^ number.astype(np.uint64))

    @staticmethod
    def _uniform(stream: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(stream ^ (np.uint64(step + 1) << np.uint64(32))) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)

    def cut(self, unit: str) -> list[str]:
        """A unit in parts, between which no piece reaches."""
        n = len(unit)
        text = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        crossed = np.zeros(n + 1, np.int64)
        place, h = np.arange(n), np.zeros(n, np.uint64)
        for l in range(1, self.pieces.longest + 1):
            with np.errstate(over="ignore"):
                h = h * np.uint64(0x100000001B3) + text[place + l - 1] + np.uint64(1)
            at = np.minimum(np.searchsorted(self.prefix, h), len(self.prefix) - 1)
            ok = self.prefix[at] == h
            place, h, at = place[ok], h[ok], at[ok]
            if l > 1:
                long = place[self.prefix_piece[at] >= 0]
                np.add.at(crossed, long + 1, 1)
                np.add.at(crossed, long + l, -1)
            more = place + l < n
            place, h = place[more], h[more]
            if not len(place):
                break
        cuts = np.flatnonzero(np.cumsum(crossed)[1:n] == 0) + 1
        return [unit[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True)]

    def _long(self, unit: str, key: int, number: int) -> list[int]:
        """One draw for a unit that isn't kept. Forward sums of a stretch are computed again, from those before it, when its pieces are drawn."""
        reach, n = self.pieces.longest, len(unit)

        def forward(a: int, b: int, last: list[float], arcs_of: list | None) -> list[float]:
            """Sums of the `reach` places up to b, in a common scale, from those up to a."""
            near = self.pieces.arcs(unit[max(0, a - reach) : b])
            shift = max(0, a - reach)
            for j in range(a + 1, b + 1):
                own = [(i + shift, ids, last[i + shift - j] * w) for i, ids, w in near[j - shift]]
                total = sum([p for _, _, p in own])
                if arcs_of is not None:
                    arcs_of.append((own, total))
                last = [*last[1:], total]
                if j % 16 == 0:  # a piece weighs no less than 1e-18, so that nothing vanishes in between
                    last = [x / total for x in last]
            return last

        ends = list(range(0, n, STRETCH))
        before = [[0.0] * (reach - 1) + [1.0]]
        for a in ends[:-1]:
            before.append(forward(a, a + STRETCH, before[-1], None))
        stream = self._stream(np.asarray([key], np.uint64), np.asarray([number]), self.seed)
        out: list[int] = []
        j, step, uniform = n, 0, []
        for a, last in zip(reversed(ends), reversed(before), strict=True):
            arcs_of: list = []
            forward(a, min(a + STRETCH, n), last, arcs_of)
            while j > a:
                if step % STRETCH == 0:
                    uniform = [float(x) for x in self._uniforms(stream, step, STRETCH)]
                own, total = arcs_of[j - a - 1]
                u = uniform[step % STRETCH] * total
                for i, ids, p in own:
                    u -= p
                    if u < 0:
                        break
                out += reversed(ids)
                j, step = i, step + 1
        return out[::-1]

    def _uniforms(self, stream: np.ndarray, first: int, count: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            steps = np.arange(first + 1, first + count + 1, dtype=np.uint64) << np.uint64(32)
            return (mixed(stream ^ steps) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)

    def _units(self, text: str) -> Iterator[list[str]]:
        """The units of a text in groups of some DRAW characters."""
        group: list[str] = []
        held = 0
        for m in _UNITS.finditer(" " + text) if text else ():
            unit = m[0]
            group += [unit] if len(unit) <= UNIT else self.cut(unit)
            held += len(unit)
            if held > DRAW:
                yield group
                group, held = [], 0
        if group:
            yield group

    def encode(self, texts: list[str], keys: list[int | None]) -> list[bytes]:
        """Ids of each text, unsigned 32-bit little-endian. Hand in a few MB at a time; a longer text is drawn in parts."""
        out: list[bytes] = [b""] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= 2 * DRAW]
        units = [[u for v in _UNITS.findall(" " + texts[k]) for u in ((v,) if len(v) <= UNIT else self.cut(v))] if texts[k] else [] for k in short]
        for k, ids in zip(short, self._draw(units, [keys[k] for k in short], 0), strict=True):
            out[k] = ids
        for k in sorted(set(range(len(texts))) - set(short)):
            parts, number = [], 0
            for group in self._units(texts[k]):
                parts += self._draw([group], [keys[k]], number)
                number += len(group)
            out[k] = b"".join(parts)
        return out

    def _draw(self, units: list[list[str]], keys: list[int | None], number_from: int) -> list[bytes]:
        """Ids of texts in units, whose numbers begin with number_from."""
        if not units:
            return []
        if len(self.known) > CACHE_UNITS:
            self._clear()
        missing = sorted({u for us in units for u in us if u not in self.known and len(u) <= UNIT}, key=len)
        for k in range(0, len(missing), LEARN):
            self.learn(missing[k : k + LEARN])
        counts = np.asarray([len(us) for us in units])
        total = int(counts.sum())
        get = self.known.get
        node = np.fromiter((get(u, -1) for us in units for u in us), np.int64, total)
        number = number_from + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        seeds = np.asarray([(k or 0) & ((1 << 64) - 1) for k in keys], np.uint64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(node >= 0)
        here = node[at]
        stream = self._stream(np.repeat(seeds, counts)[at], number[at], self.seed)
        while len(at):
            draw, arc = self._uniform(stream, len(steps)), self.first[here]
            on = np.flatnonzero(self.cum[arc] <= draw)
            while len(on):
                arc[on] += 1
                on = on[self.cum[arc[on]] <= draw[on]]
            steps.append((at, self.piece[arc]))
            here = self.origin[arc]
            go = here >= 0
            at, here, stream = at[go], here[go], stream[go]
        drawn = np.zeros(total, np.int64)
        for who, _ in steps:
            drawn[who] += 1
        ends = np.cumsum(drawn)
        ids = np.zeros(int(ends[-1]) if total else 0, np.int64)
        for k, (who, what) in enumerate(steps):
            ids[ends[who] - 1 - k] = what
        n_ids = len(self.pieces.bytes)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        starts = np.concatenate([[0], ends])
        # characters of several bytes take the places of one id
        wide = np.flatnonzero(ids >= n_ids)
        odd = set(np.searchsorted(bounds, np.flatnonzero(node < 0), "right") - 1)
        odd |= set(np.searchsorted(bounds, np.searchsorted(ends, wide, "right"), "right") - 1)
        plain = ids.astype("<u4")
        out = []
        for t in range(len(units)):
            a, b = bounds[t], bounds[t + 1]
            if t not in odd:
                out.append(plain[starts[a] : starts[b]].tobytes())
                continue
            parts, done = [], int(starts[a])
            stops = np.concatenate([wide[np.searchsorted(wide, starts[a]) : np.searchsorted(wide, starts[b])], starts[a:b][node[a:b] < 0]])
            which = np.concatenate([np.full(len(stops) - int((node[a:b] < 0).sum()), -1), np.flatnonzero(node[a:b] < 0)])
            # a unit that isn't kept stands before the ids of the unit behind it
            for k in np.lexsort((which < 0, stops)):
                stop = int(stops[k])
                parts.append(plain[done:stop].tobytes())
                if which[k] < 0:
                    parts.append(self.extra_ids(int(ids[stop]) - n_ids))
                    done = stop + 1
                else:
                    u = int(which[k])
                    parts.append(np.asarray(self._long(units[t][u], int(seeds[t]), u + number_from), "<u4").tobytes())
                    done = stop
            parts.append(plain[done : starts[b]].tobytes())
            out.append(b"".join(parts))
        return out

    def extra_ids(self, k: int) -> bytes:
        return np.asarray(self.extra[k], "<u4").tobytes()


_samplers: dict[tuple, Sampler] = {}


def sampler(path: str, alpha: float, seed: int) -> Sampler:
    """One sampler per worker and setting."""
    if (path, alpha, seed) not in _samplers:
        _samplers[path, alpha, seed] = Sampler(Pieces(path, alpha), seed)
    return _samplers[path, alpha, seed]


def _encode(model: str, alpha: float, seed: int, decoded: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(tokenizer_path(model), alpha, seed)
        for batch in rows:
            for some, texts in batches(batch, 1, DRAW):
                ids = own.encode(texts, some.column(0).to_pylist())
                columns = [some.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), lists(ids)]
                if decoded:
                    columns.append(pa.array([own.pieces.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids", "decoded"][: len(columns)])

    return resting(run)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids and, if asked for, decoded: what the ids decode to, by the worker that made them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(_encode(model, alpha, seed, decoded), "doc_id long, n_pieces long, ids array<int>" + ", decoded string" * decoded)


def _decode(model: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(tokenizer_path(model))
        for batch in rows:
            ids = batch.column(batch.schema.names.index("ids"))
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            texts = [pieces.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return resting(run)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Adds `decoded`, the text that ids stand for."""
    from pyspark.sql.types import StringType, StructField, StructType

    return in_batches(encoded).mapInArrow(_decode(model), StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces, and a digest of what they decode to: that of the text itself."""
    return encode(documents(spark, sf_dir), decoded=True).select("doc_id", "n_pieces", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
