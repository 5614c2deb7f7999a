import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from mycelia.llm import repeats as R


def brute(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mask[k : k + length] = True
        mask = mask[: len(t)]
        runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        out.append((len(t), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def found(df, *args, **kwargs):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.remove_repeats(df, *args, **kwargs).collect())


def texts():
    rnd = random.Random(3)
    source = "".join(rnd.choice("abcdé ") for _ in range(3000))
    out = []
    for _ in range(120):
        t = ""
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, 2900)
            t += source[at : at + rnd.randint(1, 120)] if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 60)))
        out.append(t)
    return [*out, "a" * 300, "a" * 20, "ab" * 100, None, "", out[5], out[5], out[6][:-3] + "zz" + out[7]]


@pytest.mark.parametrize(
    ("length", "k", "settings"),
    [
        (20, 8, {}),
        (30, 3, {"split": 2}),
        (20, 8, {"split": 2, "collection": 3}),
        (12, 12, {"max_bits": 64}),
        (21, 8, {"split": 1}),
        (20, 8, {"piece_bits": 3}),
        (20, 8, {"piece_bits": 2, "split": 2, "collection": 3, "max_bits": 64}),
    ],
)
def test_brute_force(spark, length, k, settings):
    """A small split deals collections out by halves, a small collection compares by digests, few bits make pieces' hashes and the filter clash."""
    own = texts()
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(5)
    want = sorted((str(i), *w) for i, w in enumerate(brute([(t or "").encode() for t in own], length)))
    assert found(df, length, k, **settings) == want


def test_runs_and_periods(spark):
    """A text of one byte or of a short period is a few rows, and so are many equal rows."""
    own = [(1, "a" * 60_000), (2, "abcdefghijklmno" * 3000), (3, "x" + "ab" * 4000 + "y"), *[(4, "the same row " * 30 + "again")] * 60, (5, "a" * 250 + "b"), (6, "nothing that repeats here" + "".join(map(chr, range(200, 600))))]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    assert found(df) == sorted((str(i), *w) for (i, _), w in zip(own, brute([t.encode() for _, t in own], R.LENGTH), strict=True))
    assert R.repeat_spans(df).count() < 600


def test_merged_spans():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(0, 30))
        text, a = rng.integers(0, 3, n), rng.integers(0, 40, n)
        b = a + rng.integers(1, 8, n)
        got = R._merged(text, a, b)
        cells = lambda t, x, y: {(int(i), k) for i, p, q in zip(t, x, y, strict=True) for k in range(p, q)}
        assert cells(*got) == cells(text, a, b)
        spans = sorted(zip(*(x.tolist() for x in got), strict=True))
        assert all(t != u or y < p for (t, _, y), (u, p, _) in zip(spans, spans[1:], strict=False))


def test_production_parameters(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{d}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    want = brute([(r["text"] or "").encode() for r in rows], R.LENGTH)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.op10_repeats(spark, d).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}
    assert sum(w[1] for w in want) > 0


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 500)
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 123, 4000).astype(np.uint8)).decode()
    parts = []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text.encode()])], ["a", "b", "text"])
    for _, _, offset, data, ends in R._blocks(batch, 2, 50):
        where, start, strings, at, h, ph = R.pieces(data, ends, 50, 10)
        parts += [(int(s + offset[0] + i), int(a)) for s, n, a in zip(start, strings, start + at + offset[0], strict=True) for i in range(n)]
    whole = R.pieces(np.frombuffer(text.encode(), np.uint8), np.asarray([4000]), 50, 10)
    assert sorted(parts) == sorted((int(s + i), int(s + a)) for s, n, a in zip(whole[1], whole[2], whole[3], strict=True) for i in range(n))
    assert sorted(p for p, _ in parts) == list(range(3951))


def test_odd(odd, none):
    rows = odd.select("doc_id", "text").collect()
    want = brute([(r["text"] or "").encode() for r in rows], 60)
    assert found(odd, 60, 20) == sorted((str(r["doc_id"]), *w) for r, w in zip(rows, want, strict=True))
    assert R.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        R.repeat_spans(odd, 10, 11)
