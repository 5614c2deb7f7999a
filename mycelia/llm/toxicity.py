"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word's input is its own embedding, if it is frequent enough in the sample,
the mean embedding of its hashed character trigrams, and the embedding of its
hashed first bytes, by which words of one stem know each other. A word of more than
24 bytes is cut at its joiners (slashes, dashes, punctuation), and what is
still longer into overlapping runs of at most 24 bytes; each of these parts is
an input of its own, so that texts without spaces are read whole. The network
reads windows of 32 inputs that overlap by 8; attention pools the states of both
directions. All windows of a text are scored; the text's score comes from its
highest ones, as several weak signs say more than one, less the logarithm of
their number, as among many windows a high one is more likely by chance.

It is trained in numpy on a bounded sample of labelled texts: in each round a
text is represented by the window that scores highest so far, since a label
says only that some window is toxic, and by another one. At the end the
threshold is put between the sample's clean and toxic texts.

Defined results. Null or empty texts are one window of padding and get its
score. A null id counts as an empty string for the split into folds. Labels
that are null, or of unknown documents, are not learned from; different labels
of a text count as separate examples, equal ones as one. With no labels at all, or only one
kind, every score is the share of toxic labels, 0 if there are none. Repeated
rows get the same score. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, resting
from .langid import Adam, fold, hashed_share
from .tokens import batches

WINDOW, STRIDE = 32, 24
WORD, CHAR, TRIGRAMS, HIDDEN, ATTEND = 8, 8, 4096, 8, 8
#: A word's first bytes have an embedding too, of so many, by their hash.
STEM_BYTES, STEM, STEMS = 5, 8, 8192
#: Bytes of an input at most, and by how much the runs of a longer part of a word overlap at least.
WORD_BYTES, WORD_OVERLAP = 24, 8
#: About so many labelled documents of either kind are learned from, chosen by a hash of their id.
SAMPLE = 1500
#: and of a text of more bytes than this so many stretches of equal length, spread over the whole of it.
SAMPLE_BYTES, STRETCHES = 20_000, 10
#: A word has an embedding of its own if so many documents of the sample, and this share of them, have it.
FREQUENT, FREQUENT_SHARE = 12, 0.01
#: Share of words that are hidden from the network in training.
HIDE = 0.2
THRESHOLD = 0.7
#: What a text's highest windows count for, in logits, and what a window that isn't there has.
POOL, ABSENT = (1.0, 0.5, 0.3), -7.0
#: Where the threshold is between the clean and the toxic texts of the sample; texts that training hasn't seen lie closer together.
LEVEL = 0.4
#: Different words whose inputs a worker keeps.
CACHE_WORDS = 120_000
#: Bytes of text scored at once.
BATCH = 400_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_JOINERS = r"/\\_\-|,;:.=&+?!\u2010-\u2015\u2026\u3001\u3002\uff01\uff0c\uff0e\uff0f\uff1a\uff1b\uff1f"
_PART = re.compile(f"[^{_JOINERS}]*[{_JOINERS}]+|[^{_JOINERS}]+")


def normal(word: str) -> str:
    return _EDGE.sub("", word.lower())


def subwords(word: str) -> list[str]:
    """Parts of at most WORD_BYTES bytes that together have every byte; joiners stay at the end of their part."""
    if 4 * len(word) <= WORD_BYTES or len(word.encode("utf-8", "replace")) <= WORD_BYTES:
        return [word]
    out = []
    for part in _PART.findall(word):
        raw, start, stop = part.encode("utf-8", "replace"), 0, 0
        while stop < len(raw):
            stop = min(start + WORD_BYTES, len(raw))
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:  # not inside a character
                stop -= 1
            out.append(raw[start:stop].decode())
            start = stop - WORD_OVERLAP
            while start > 0 and raw[start] & 0xC0 == 0x80:
                start -= 1
    return out


def starts(n: int) -> range:
    """Where the windows of a text of n words begin; together they cover it."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of at most WORD_BYTES bytes: hashed trigrams (word, place), which places are used, and hashed first bytes."""
    padded = [b"^" + w.encode("utf-8", "replace") + b"$" for w in words]
    width = WORD_BYTES + 2
    raw = np.array(padded, dtype=f"S{width}").view(np.uint8).reshape(len(words), width).astype(np.int32)
    grams = (raw[:, :-2] * 7919 + raw[:, 1:-1] * 104729 + raw[:, 2:] * 1299709) % TRIGRAMS
    stem = raw[:, 1 : 1 + STEM_BYTES].astype(np.int64) @ (31337 ** np.arange(STEM_BYTES) % 1_000_003)
    return grams, raw[:, 2:] > 0, stem % STEMS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Net:
    """Word row 0 is padding, row 1 is any word that has no row of its own."""

    def __init__(self, vocabulary: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.rows = {w: k + 2 for k, w in enumerate(vocabulary)}
        d, h = WORD + CHAR + STEM, HIDDEN
        self.p = {"word": draw(len(vocabulary) + 2, WORD, scale=0.3), "char": draw(TRIGRAMS, CHAR, scale=0.3), "stem": draw(STEMS, STEM, scale=0.3), "attend": draw(2 * h, ATTEND, scale=0.3), "query": draw(ATTEND, scale=0.3), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": draw(d, 3 * h, scale=d**-0.5), f"u{side}": draw(h, 3 * h, scale=h**-0.5), f"c{side}": np.zeros(3 * h, np.float32)}
        self.prior = 0.0
        self.level = 0.0  # logit of a text at the threshold

    def parts(self, word: str) -> list[tuple[int, str]]:
        """Inputs of a normal form: row and part. A long word with a row of its own has it in all its parts."""
        own, some = self.rows.get(word, 1), subwords(word)
        return [(own, word)] if len(some) == 1 else [(own if own > 1 else self.rows.get(normal(s), 1), s) for s in some]

    def inputs(self, parts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, trigrams, used trigrams and first bytes of parts."""
        return np.asarray([row for row, _ in parts]), *characters([s for _, s in parts])

    def embed(self, row: np.ndarray, grams: np.ndarray, used: np.ndarray, stem: np.ndarray) -> np.ndarray:
        n = np.maximum(used.sum(1, keepdims=True), 1).astype(np.float32)
        chars = np.zeros((len(row), CHAR), self.p["char"].dtype)
        for k in range(0, len(row), 8192):  # the trigrams' embeddings of all words at once would be large
            chars[k : k + 8192] = (self.p["char"][grams[k : k + 8192]] * used[k : k + 8192, :, None]).sum(1)
        return np.concatenate([self.p["word"][row], chars / n, self.p["stem"][stem]], axis=1)

    def _run(self, gates: np.ndarray, live: np.ndarray, side: str, keep: bool):
        """gates: (time, window, 3 * hidden) from the inputs; live: (time, window, 1). States, and what the way back needs."""
        h, u = HIDDEN, self.p[f"u{side}"]
        state = np.zeros((gates.shape[1], h), gates.dtype)
        states = np.empty((*gates.shape[:2], h), gates.dtype)
        saved = []
        order = range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1)
        for t in order:
            back = state @ u
            zr = _sigmoid(gates[t, :, : 2 * h] + back[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h :] + r * back[:, 2 * h :])
            move = live[t] * z
            if keep:
                saved.append((t, state, z, r, new, back[:, 2 * h :]))
            state = state + move * (new - state)
            states[t] = state
        return states, saved

    def forward(self, gates: dict[str, np.ndarray], live: np.ndarray, keep: bool = False):
        """Logits of windows; live: (time, window)."""
        m = live[:, :, None].astype(np.float32)
        runs = {side: self._run(gates[side], m, side, keep) for side in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        keys = np.tanh(states @ self.p["attend"])
        weight = np.exp(keys @ self.p["query"]) * live
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (runs, states, keys, weight, pooled)) if keep else logit

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray):
        """x: (time, window, inputs). Mean loss, its gradients, and that of x."""
        p, h, n = self.p, HIDDEN, len(y)
        m = live[:, :, None].astype(np.float32)
        gates = {side: x @ p[f"w{side}"] + p[f"c{side}"] for side in "fb"}
        logit, (runs, states, keys, weight, pooled) = self.forward(gates, live, keep=True)
        q = 1 / (1 + np.exp(-logit))
        loss = -float(np.mean(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)))
        d = ((q - y) / n).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.asarray([d.sum()], np.float32)}
        d_pool = d[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pool
        d_weight = (states * d_pool).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["query"] = np.einsum("twa,tw->a", keys, d_score)
        d_keys = d_score[:, :, None] * p["query"] * (1 - keys**2)
        g["attend"] = np.einsum("tws,twa->sa", states, d_keys)
        d_states += d_keys @ p["attend"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u = p[f"u{side}"]
            carry = np.zeros((n, h), x.dtype)
            gu, gg = np.zeros_like(u), np.zeros_like(gates[side])
            for t, before, z, r, new, back in reversed(runs[side][1]):
                d_h = d_states[t, :, k * h : (k + 1) * h] + carry
                d_new = d_h * m[t] * z * (1 - new**2)
                d_z = d_h * m[t] * (new - before) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                d_back = np.concatenate([d_z, d_r, d_new * r], axis=1)
                gu += before.T @ d_back
                gg[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                carry = d_h * (1 - m[t] * z) + d_back @ u.T
            g[f"u{side}"], g[f"c{side}"] = gu, gg.sum((0, 1))
            g[f"w{side}"] = np.einsum("twd,twg->dg", x, gg, optimize=True)
            d_x += gg @ p[f"w{side}"].T
        return loss, g, d_x

    def tables(self, parts: list[tuple[int, str]]) -> np.ndarray:
        """Gates that each input sends to both directions, (input, 6 * hidden)."""
        x = self.embed(*self.inputs(parts))
        return np.concatenate([x @ self.p[f"w{side}"] + self.p[f"c{side}"] for side in "fb"], axis=1)

    def score_windows(self, table: np.ndarray, ids: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities; ids and live: (window, time), ids are rows of the table."""
        out = np.empty(len(ids), np.float32)
        for k in range(0, len(ids), 2048):
            at = np.ascontiguousarray(ids[k : k + 2048].T)
            both = table[at]
            gates = {"f": both[:, :, : 3 * HIDDEN], "b": both[:, :, 3 * HIDDEN :]}
            out[k : k + 2048] = self.forward(gates, np.ascontiguousarray(live[k : k + 2048].T))
        return 1 / (1 + np.exp(-out))


def cut(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts whose words follow each other in one array: places (window, time), which of them are real, windows per text."""
    counts = np.asarray([len(starts(int(n))) for n in lengths])
    begin = np.cumsum(lengths) - lengths
    own = np.repeat(np.arange(len(lengths)), counts)
    first = (np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    place = first[:, None] + np.arange(WINDOW)
    live = place < lengths[own][:, None]
    return np.where(live, begin[own][:, None] + place, 0), live, counts


def pooled(windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logits of texts from the probabilities of their windows, which follow each other."""
    logits = np.log(np.clip(windows, 1e-5, 1 - 1e-5).astype(np.float64))
    logits -= np.log1p(-np.exp(logits))
    own = np.repeat(np.arange(len(counts)), counts)
    ordered = np.append(logits[np.lexsort((-logits, own))], ABSENT)
    first = np.cumsum(counts) - counts
    return sum(w * ordered[np.where(k < counts, first + k, -1)] for k, w in enumerate(POOL)) - np.log(counts)


def train(texts: list[str], labels: list[int], rounds: int = 8, batch: int = 64, seed: int = 0) -> Net:
    words = [[normal(w) for w in t.split()] for t in texts]
    # parts of long words count as words, and so does a long word as a whole
    seen = Counter(w for ws in words for w in {x for v in set(ws) for x in (v, *map(normal, subwords(v)))} if w)
    net = Net(sorted(w for w, n in seen.items() if n >= max(FREQUENT, FREQUENT_SHARE * len(texts))), seed)
    y = np.asarray(labels, np.float32)
    net.prior = float(y.mean()) if len(y) else 0.0
    if not 0 < net.prior < 1:
        return net
    net.p["bias"][0] = np.log(net.prior / (1 - net.prior))
    inputs = [[part for w in ws for part in net.parts(w)] for ws in words]
    names = sorted({part for parts in inputs for part in parts} | set(net.parts("")))
    number = {part: k for k, part in enumerate(names)}
    row, grams, used, stem = net.inputs(names)
    flat = np.asarray([number[part] for parts in inputs for part in parts] or [0])
    place, live, counts = cut(np.asarray([len(parts) for parts in inputs]))
    ids = flat[place]
    ends = np.cumsum(counts)
    rng = np.random.default_rng(seed)
    best = Adam(net.p, 0.01, decay=0.002)
    for turn in range(rounds):
        if turn >= rounds - 2:
            best.rate = 0.003
        x = net.embed(row, grams, used, stem)
        table = np.concatenate([x @ net.p[f"w{side}"] + net.p[f"c{side}"] for side in "fb"], axis=1)
        scores = net.score_windows(table, ids, live) + rng.random(len(ids)) * (1 if turn == 0 else 1e-6)
        top = np.asarray([e - n + int(scores[e - n : e].argmax()) for e, n in zip(ends, counts, strict=True)])
        other = ends - counts + (rng.random(len(counts)) * counts).astype(np.int64)
        # the other window says something only if the text isn't toxic at all
        chosen = np.concatenate([top, other[y == 0]])
        target = np.concatenate([y, np.zeros(int((y == 0).sum()), np.float32)])
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            w = ids[chosen[some]].T
            kinds, at = np.unique(w, return_inverse=True)
            at = at.reshape(w.shape)
            x = net.embed(row[kinds], grams[kinds], used[kinds], stem[kinds])
            shown = (rng.random((*at.shape, 1)) >= HIDE).astype(np.float32)
            _, g, d_x = net.gradients(x[at] * shown, live[chosen[some]].T, target[some])
            d_x *= shown
            d_kind = np.zeros_like(x)
            np.add.at(d_kind, at, d_x)
            g |= {name: np.zeros_like(net.p[name]) for name in ("word", "char", "stem")}
            np.add.at(g["word"], row[kinds], d_kind[:, :WORD])
            n = np.maximum(used[kinds].sum(1), 1)
            np.add.at(g["stem"], stem[kinds], d_kind[:, WORD + CHAR :])
            np.add.at(g["char"], grams[kinds], d_kind[:, None, WORD : WORD + CHAR] / n[:, None, None] * used[kinds][:, :, None])
            best.step(g)
    x = net.embed(row, grams, used, stem)
    table = np.concatenate([x @ net.p[f"w{side}"] + net.p[f"c{side}"] for side in "fb"], axis=1)
    said = pooled(net.score_windows(table, ids, live), counts)
    clean, toxic = np.quantile(said[y == 0], 0.999), np.quantile(said[y == 1], 0.01)
    net.level = float(clean + LEVEL * (toxic - clean))
    return net


class Scorer:
    """Scores texts; keeps the inputs of words it has seen."""

    def __init__(self, net: Net):
        self.net = net
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)
        self._clear()

    def _clear(self) -> None:
        # a word's row of the table, or -1 - k for the k-th word of several inputs, whose rows are in `several`
        self.known: dict[str, int] = {}
        self.of_part: dict[tuple[int, str], int] = {}
        self.several: list[np.ndarray] = []
        self.used = self.listed = 0

    def _learn(self, words: list[str]) -> None:
        inputs = [self.net.parts(normal(w)) for w in words]
        own = [parts[0] for parts in inputs if len(parts) == 1]
        shared = {part: None for parts in inputs if len(parts) > 1 for part in parts if part not in self.of_part}
        rows = self.net.tables([*own, *shared])
        while len(self.table) < self.used + len(rows):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used : self.used + len(rows)] = rows
        self.of_part.update(zip(shared, range(self.used + len(own), self.used + len(rows)), strict=True))
        at = self.used
        for w, parts in zip(words, inputs, strict=True):
            if len(parts) == 1:
                self.known[w] = at
                at += 1
            else:
                self.known[w] = -1 - len(self.several)
                self.several.append(np.asarray([self.of_part[part] for part in parts]))
                self.listed += len(parts)
        self.used += len(rows)

    def _expand(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table, and their number in each text, with the words of several inputs written out."""
        long = np.flatnonzero(flat < 0)
        rows = [self.several[-1 - k] for k in flat[long].tolist()]
        sizes = np.ones(len(flat), np.int64)
        sizes[long] = [len(r) for r in rows]
        ends = np.cumsum(sizes)
        out = np.repeat(flat, sizes)
        for k, r in zip(long.tolist(), rows, strict=True):
            out[ends[k] - len(r) : ends[k]] = r
        return out, np.diff(np.concatenate([[0], ends])[np.cumsum(lengths)], prepend=0)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not 0 < self.net.prior < 1:
            return np.full(len(texts), self.net.prior)
        words = [t.split() for t in texts]
        if self.used + self.listed > CACHE_WORDS:
            self._clear()
        get = self.known.get
        found = [list(map(get, ws)) for ws in words]
        missing = sorted({w for ws, ids in zip(words, found, strict=True) if None in ids for w, k in zip(ws, ids, strict=True) if k is None})
        if missing or not self.used:
            self._learn(missing or [""])
            found = [list(map(get, ws)) if None in ids else ids for ws, ids in zip(words, found, strict=True)]
        lengths = np.asarray([len(ids) for ids in found])
        flat = np.fromiter((k for ids in found for k in ids), np.int64, int(lengths.sum())) if lengths.sum() else np.zeros(1, np.int64)
        if flat.min() < 0:
            flat, lengths = self._expand(flat, lengths)
        place, live, counts = cut(lengths)
        windows = self.net.score_windows(self.table, flat[place], live)
        return 1 / (1 + np.exp(self.net.level - pooled(windows, counts) - np.log(THRESHOLD / (1 - THRESHOLD))))


def _score(net: Net):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles arise here, and collections would walk the words again and again
        own = Scorer(net)
        for batch in rows:
            for some, texts in batches(batch, 2, BATCH):
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(own.scores(texts))], ["id", "held_out", "score"])

    return resting(run)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_kind: int = SAMPLE) -> tuple[list[str], list[int], float]:
    """Texts and labels of a bounded number of documents of either kind, chosen by a hash of the id, and the share of toxic labels in all.

    Of a long text, stretches spread over all of it; an id that many rows have
    brings no more than the bound.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return [], [], 0.0
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, per_kind / n))])
    # about 2 * per_kind different ids, whatever the table's size
    chosen = known.filter(hashed_share("id", F.element_at(share, F.col("label"))))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = SAMPLE_BYTES // STRETCHES // 4
    spread = (F.length(text) / STRETCHES).cast("int")
    stretches = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substring(text, k * spread + 1, F.lit(size))))
    texts = docs.select(F.col(id_col).alias("id"), F.when(F.octet_length(text) <= SAMPLE_BYTES, text).otherwise(stretches).alias("text")).join(F.broadcast(chosen), "id").select("text", "label").distinct()
    found = sorted((r["text"], r["label"]) for r in texts.orderBy(F.xxhash64("text", "label")).limit(4 * per_kind).collect())
    return [t for t, _ in found], [y for _, y in found], counts.get(1, 0) / sum(counts.values())


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_fold: int = 1) -> Net:
    texts, marks, share = sample(docs, labels.filter(fold(id_col, folds) != held_fold), id_col, text_col, label_col)
    net = train(texts, marks)
    if not 0 < net.prior < 1:
        net.prior = share
    return net


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_fold: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, folds) == held_fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = in_batches(rows).mapInArrow(_score(net), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fitted(docs, labels))


def _clean(net: Net, place: int, threshold: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        own = Scorer(net)
        for batch in rows:
            for some, texts in batches(batch, place, BATCH):
                yield some.filter(pa.array(own.scores(texts) < threshold))

    return resting(run)


def without_toxic(docs: DataFrame, net: Net, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score under the threshold, with all their columns."""
    return in_batches(docs).mapInArrow(_clean(net, docs.columns.index(text_col), threshold), docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows with a score of THRESHOLD or more go. A row's own text decides, whatever its id: null and repeated ids need no care; null text is scored as empty text."""
    return without_toxic(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
