import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from mycelia.llm import simhash as S
from mycelia.operators.components import roots


def fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    u = np.asarray(fps, np.uint64)
    x, y = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    return roots(x, y, len(u))


@pytest.mark.parametrize("depth", [0, 1])
def test_masks_cover(depth):
    rng = np.random.default_rng(depth)
    tables = S.tables(depth)
    for _ in range(3000):
        d = sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
        assert any(m & d == 0 for m in tables)


def test_hash_matches_spark(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("some words ü"))).first()[0] == np.asarray([xxhash.xxh64_intdigest("some words ü", 42)], np.uint64).view(np.int64)[0]


def test_odd(odd):
    rows = odd.select("doc_id", "text").collect()
    got = S.simhash_groups(odd).collect()
    fps = [fingerprint(r["text"]) for r in rows]
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in got) == sorted((str(r["doc_id"]), f) for r, f in zip(rows, fps, strict=True))
    root = components(fps)
    first: dict = {}
    for r, k in zip(rows, root, strict=True):
        if r["doc_id"] is not None:
            first[k] = min(first.get(k, 2**63), r["doc_id"])
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(r["doc_id"]), str(first.get(k))) for r, k in zip(rows, root, strict=True))


def test_empty(none):
    assert S.simhash_groups(none).count() == 0


@pytest.mark.parametrize("bucket", [4096, 40])
def test_dense_cluster(spark, bucket):
    """Buckets that are too large are split without losing a link."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base, *(int(x) for x in rng.integers(0, 1 << 62, 200))}
    while len(fps) < 1200:
        fps.add(base ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    fps = np.asarray(sorted(fps), np.uint64).view(np.int64)
    links = S.near_links(spark.createDataFrame(pd.DataFrame({"fp": fps})), 3, bucket).toPandas()
    place = {v: k for k, v in enumerate(fps)}
    got = roots(np.asarray([place[v] for v in links["src"]]), np.asarray([place[v] for v in links["dst"]]), len(fps))
    assert (got == components(fps.view(np.uint64))).all()


def naive_stage(rows):
    """Numbers of the rows that stay: of each group the smallest id, of several with it the smallest digest."""
    root = components([fingerprint(t) for _, t in rows])
    place = [(d is None, d or 0, hashlib.sha256((t or "").encode()).digest()) for d, t in rows]
    first: dict = {}
    for p, k in zip(place, root, strict=True):
        first[k] = min(first.get(k, p), p)
    return [r for r, p, k in zip(rows, place, root, strict=True) if p == first[k]]


def key(r):
    return (str(r[0]), r[1] or "")


def test_stage(spark, odd):
    left = S.stage(spark, odd, "")
    assert left.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(key, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(key, naive_stage(rows)))


def test_stage_decides_by_row(spark):
    """A text in no group stays, whatever else its id has; of each group one row stays."""
    a, b = "some words of one text that is long enough", "another text altogether with words of its own"
    rows = [(1, a), (2, a), (2, b), (3, b + " "), (3, "a third text that nobody else has at all"), (None, a), (None, "no id and no copy here"), (8, "same id"), (8, "SAME id")]
    left = S.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(key((r["doc_id"], r["text"])) for r in left) == sorted(map(key, naive_stage(rows)))
    assert len(left) == 5


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_long_texts_in_stretches(monkeypatch, stretch):
    rng = np.random.default_rng(0)
    texts = ["", " ", "a", "a b", "a  b\nc", " lead and trail ", "x" * 300 + " y", *[" ".join(rng.choice(["one", "Two", "drei\t", "vier"], n)) for n in (4, 5, 40, 400)]]
    monkeypatch.setattr(S, "STRETCH", stretch)
    monkeypatch.setattr(S, "STEP", 10)
    for size in (1, 3):
        got = S.fingerprints([t.encode() for t in texts], size).view(np.uint64).tolist()
        assert size == 1 or got == [fingerprint(t) for t in texts]
