"""Language identification with a byte convolutional network.

The network reads windows of 256 bytes: a byte embedding, filters 4, 8 and 12
bytes wide at every fourth byte, a maximum over the window and a softmax. It
is trained in numpy on windows of a bounded sample of labelled texts. A text
is scored by all of its windows, the last one padded; its probabilities are
the windows' means, weighted by their bytes.

Defined results. Null text, and text without a letter, is `und` with score 0.
A null id counts as an empty string for the split into folds. Rows whose
language is null are predicted but not learned from; with no labelled row at
all, every text is `und`. Repeated rows get the same prediction. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, resting
from .tokens import batches

WINDOW, STEP, EMBED, FILTERS = 256, 4, 8, 16
WIDTHS = (4, 8, 12)
#: About so many labelled documents of each language are learned from, chosen by a hash of their id,
SAMPLE = 500
#: and at most so many windows of each, spread over the whole text.
SAMPLE_WINDOWS = 4
UNDEFINED = "und"

# letters and numerals such as ² or Ⅷ
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def hashed_share(key: str, share: Column) -> Column:
    """True for about that share of the keys."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share * (1 << 30)


def windows(text: bytes, shift: int = 0) -> np.ndarray:
    """All windows of a text, at least one, the last padded with zeros."""
    data = np.frombuffer(text, np.uint8)[shift:]
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


class ByteNet:
    """Parameters and passes of the network."""

    def __init__(self, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"embed": normal(256, EMBED, scale=0.5), "out": normal(len(WIDTHS) * FILTERS, classes, scale=0.2), "bias": np.zeros(classes, np.float32), "lift": np.zeros(len(WIDTHS) * FILTERS, np.float32)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = normal(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5)
        self.p["embed"][0] = 0

    def _maps(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width, the responses (window, place, filter); one product serves all widths."""
        p, cell = self.p, STEP * EMBED
        cells = p["embed"][x].reshape(len(x) * WINDOW // STEP, cell)
        parts = [p[f"conv{w}"][k * cell : (k + 1) * cell] for w in WIDTHS for k in range(w // STEP)]
        y = (cells @ np.concatenate(parts, axis=1)).reshape(len(x), WINDOW // STEP, -1)
        out, at = [], 0
        for w in WIDTHS:
            n = w // STEP
            total = y[:, : WINDOW // STEP - n + 1, at : at + FILTERS]
            for k in range(1, n):
                total = total + y[:, k : WINDOW // STEP - n + 1 + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            out.append(total)
            at += n * FILTERS
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        peaks = np.concatenate([m.max(axis=1) for m in self._maps(x)], axis=1)
        return _softmax(np.maximum(peaks + p["lift"], 0) @ p["out"] + p["bias"])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients."""
        p, n = self.p, len(x)
        maps = self._maps(x)
        best = [m.argmax(axis=1) for m in maps]
        raw = np.concatenate([np.take_along_axis(m, b[:, None], 1)[:, 0] for m, b in zip(maps, best, strict=True)], axis=1) + p["lift"]
        hidden = np.maximum(raw, 0)
        q = _softmax(hidden @ p["out"] + p["bias"])
        loss = -float(np.log(q[np.arange(n), y] + 1e-9).mean())
        q[np.arange(n), y] -= 1
        q /= n
        back = (q @ p["out"].T) * (raw > 0)
        g = {"out": hidden.T @ q, "bias": q.sum(0), "lift": back.sum(0), "embed": np.zeros_like(p["embed"])}
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            bytes_ = x[np.arange(n)[:, None, None], best[i][:, :, None] * STEP + np.arange(w)]
            patch = p["embed"][bytes_].reshape(n, FILTERS, w * EMBED)
            g[f"conv{w}"] = np.einsum("nfe,nf->ef", patch, d, optimize=True)
            at_bytes = (d[:, :, None] * p[f"conv{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            np.add.at(g["embed"], bytes_, at_bytes)
        g["embed"][0] = 0
        return loss, g


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            move = self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)
            self.params[k] -= (self.rate * (move + self.decay * self.params[k])).astype(np.float32)


def train(texts: list[bytes], labels: list[str], steps: int = 500, batch: int = 96, seed: int = 0) -> tuple[list[str], ByteNet]:
    """Languages and the network. Batches have all languages equally often; windows start anywhere."""
    names = sorted(set(labels))
    net, rng = ByteNet(len(names), seed), np.random.default_rng(seed)
    own = [[t for t, label in zip(texts, labels, strict=True) if label == name and t] for name in names]
    own = [ts or [b" "] for ts in own]
    best = Adam(net.p, 0.004)
    for step in range(steps):
        if step == steps * 3 // 4:
            best.rate /= 4
        y = rng.integers(0, len(names), batch)
        x = np.zeros((batch, WINDOW), np.uint8)
        for k, label in enumerate(y):
            text = own[label][rng.integers(len(own[label]))]
            start = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
            piece = np.frombuffer(text, np.uint8)[start : start + (WINDOW if rng.random() < 0.7 else int(rng.integers(12, WINDOW)))]
            x[k, : len(piece)] = piece
        best.step(net.gradients(x, y)[1])
    return names, net


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int = SAMPLE) -> list[tuple[bytes, str]]:
    """A bounded sample of labelled texts: windows of whole documents chosen by a hash of id and text, equal ones once. docs: rows to be learned from."""
    known = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.col(label_col).cast("string").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, per_label / n))])
    spread = (F.octet_length("text") / SAMPLE_WINDOWS).cast("int")
    pieces = F.when(F.octet_length("text") <= SAMPLE_WINDOWS * WINDOW, F.array(F.col("text"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda k: F.substring(F.col("text"), k * spread + 1, F.lit(WINDOW))))
    chosen = known.filter(hashed_share("id", F.element_at(share, F.col("label")))).select("id", "label", F.posexplode(pieces).alias("k", "piece")).distinct()
    return [(bytes(r["piece"]), r["label"]) for r in chosen.orderBy("id", "k", "piece").collect()]


def _predict(names: list[str], net: ByteNet | None):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for some, texts in batches(batch, 2):
                said = [UNDEFINED] * len(texts)
                score = np.zeros(len(texts))
                live = [k for k, t in enumerate(texts) if net and has_letter(t)]
                if live:
                    data = [texts[k].encode("utf-8", "replace") for k in live]
                    counts = np.asarray([-(-len(t) // WINDOW) for t in data])
                    x = np.concatenate([windows(t) for t in data])
                    q = np.concatenate([net.probabilities(x[k : k + 128]) for k in range(0, len(x), 128)])
                    weight = np.full(len(x), WINDOW, np.float32)
                    last = np.cumsum(counts) - 1
                    weight[last] = [len(t) - (n - 1) * WINDOW for t, n in zip(data, counts, strict=True)]
                    total = np.add.reduceat(q * weight[:, None], last - counts + 1, axis=0) / np.asarray([len(t) for t in data])[:, None]
                    for k, row in zip(live, total, strict=True):
                        said[k], score[k] = names[int(row.argmax())], min(1.0, float(row.max()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(said), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    return resting(run)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score. Learns from rows that are not held out."""
    found = sample(docs.filter(fold(id_col, folds) != held_fold), id_col, text_col, label_col)
    names, net = train([t for t, _ in found], [label for _, label in found]) if found else ([], None)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, folds) == held_fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(_predict(names, net), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
