import pytest
from pyspark.sql import functions as F

from mycelia.llm import common as C
from mycelia.llm import exact_dedup as D
from mycelia.llm import quality_rules as Q
from mycelia.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def groups(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r["text"] or "", []).append(r["doc_id"])
    return by


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest", [D.sha256, lambda text: F.substring(D.sha256(text), 1, 1)])
def test_exact_dedup(odd, keep, digest):
    """A digest of 16 values makes nearly all hits false, so that the texts decide."""
    pick = min if keep == "smallest" else max
    by = groups(odd.collect())
    want = {(doc, pick([d for d in ids if d is not None], default=None), len(ids)) for ids in by.values() for doc in ids}
    got = D.exact_dedup(odd, keep=keep, digest=digest).collect()
    assert len(got) == odd.count()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def entries(spark, ids):
    return spark.createDataFrame([(k,) for k in ids], "id long").coalesce(1).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")


def test_levels(spark, tmp_path):
    """Eleven memtables: five merges on level 1, two on level 2, one on level 3; three runs are live, on levels 0, 1 and 3."""
    index = D.MergeIndex(spark, str(tmp_path / "index"), "smallest", fan_in=2)
    for k in range(11):
        index.flush(entries(spark, range(k, k + 3)))
    assert index.merged_runs == 10 + 4 + 2
    assert [len(own) and own[-1][2] - own[0][1] for own in index.levels] == [1, 1, 0, 1]
    want = {k: sum(k - 2 <= j <= k for j in range(11)) for k in range(13)}
    assert {r["keep_id"]: r["n"] for r in index.totals().collect()} == want
    assert index.rows().count() == 33
    assert index.merged_entries < index.merged_entries + index.unmerged_entries == sum(1 for _ in index.entries().collect())


def test_memtables_of_one_flush(spark, tmp_path):
    rows = spark.range(0, 400, 1, 40).select(F.sha2((F.col("id") % 300).cast("string"), 256).alias("digest"), "id")
    index = D.MergeIndex(spark, str(tmp_path / "index"), "largest", fan_in=4)
    index.flush(rows)
    assert index.merged_runs == 40 + 8 and len(index.live()) == 2 + 2
    assert sorted((r["keep_id"], r["n"]) for r in index.totals().collect()) == sorted((k + 300 if k < 100 else k, 1 + (k < 100)) for k in range(300))


def test_lookup_skips_runs(spark, tmp_path):
    """Runs whose filter lets no digest pass aren't read; entries of one run only aren't merged."""
    index = D.MergeIndex(spark, str(tmp_path / "index"), "smallest", fan_in=9)
    for k in range(8):
        index.flush(entries(spark, range(100 * k, 100 * k + 50)))
    found, read = index.lookup(entries(spark, [301, 302, 320, 399, 5000]).select("digest"))
    assert {r["keep_id"] for r in found.collect()} == {301, 302, 320}
    assert 3 in read and len(read) < 4
    index.flush(entries(spark, range(0, 50)))  # the ninth: all are merged
    assert len(index.live()) == 1
    index.flush(entries(spark, range(10, 20)))
    index.flush(entries(spark, range(900, 930)))
    assert index.totals().filter("n = 3").count() == 10
    assert index.merged_entries < 400 * 0.1 + 60 and index.unmerged_entries > 300


def test_saturated_filters_lose_nothing(spark, odd, monkeypatch):
    whole = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in D.exact_dedup(odd, fan_in=2).collect()}
    for module in (C, D):
        monkeypatch.setattr(module, "bitmap_count", lambda n, limit=1: 1)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in D.exact_dedup(odd, fan_in=2).collect()} == whole


def test_empty(spark, none):
    assert D.exact_dedup(none).count() == 0
    assert Q.ledger(none).count() == 0
    assert Q.ablate(Q.ledger(none)).count() == 0


def test_stage_keeps_columns_and_clean_rows(spark, odd):
    left = D.stage(spark, odd, "")
    assert left.columns == odd.columns
    assert stays(left) == wanted(odd)


def stays(df):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())


def wanted(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    largest: dict = {}
    for doc, text in rows:
        largest[text] = max(largest.get(text, -(2**63)), -(2**63) if doc is None else doc)
    return sorted((str(doc), text) for doc, text in rows if (-(2**63) if doc is None else doc) == largest[text])


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_stage_decides_by_row(spark, monkeypatch, broadcast):
    """An id with several texts loses only those that another row has; chains included."""
    monkeypatch.setattr(C, "BROADCAST_ROWS", broadcast)
    rows = [(7, "T1"), (7, "only here"), (9, "T1"), (9, "Z"), (10, "Z"), (5, "A"), (5, "B"), (9, "A"), (None, "A"), (None, "alone"), (None, None), (3, ""), (12, "twice"), (12, "twice")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, __key_doc_id int")
    left = D.stage(spark, docs.select("doc_id", "text", F.col("__key_doc_id").alias("digest")), "")
    assert left.columns == ["doc_id", "text", "digest"]
    assert stays(left) == sorted((str(d), t) for d, t in [(7, "only here"), (9, "T1"), (10, "Z"), (5, "B"), (9, "A"), (None, "alone"), (3, ""), (12, "twice"), (12, "twice")]) == wanted(docs)


def brute(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    seen = {g for g in grams if grams.count(g) > 1}
    repeated = {k + j for k, g in enumerate(grams) if g in seen for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_measures(spark):
    texts = [None, "", "a b c a b c", "a a a a", "x#y *z* <q> | 100% $5 & [b]", "l\nl\n \nl\nm\t\nm\t", "one two three one two", "a b c d a b c x a b c", " a   b", "🙂 ü\x0bz\x0cq\r\nq"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.ledger(rows).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_policies(spark, odd):
    book = Q.stored(Q.ledger(odd))  # policies and ablations see the stored ledger only
    assert "documents" not in book._jdf.queryExecution().toString() and "Project" not in book._jdf.queryExecution().executedPlan().toString()
    assert book.count() == odd.count() and book.columns[0] == "doc_id"
    for r in Q.ablate(book).collect():
        rest = Q.Policy("rest", tuple(x for x in Q.POLICY.rules if x != r["rule"]))
        assert r["n_kept_without"] == book.filter(Q.passes(rest)).count()
        assert r["n_failed"] == book.filter(~Q.passes(Q.Policy("one", (r["rule"],)))).count()
        assert r["n_only"] == r["n_kept_without"] - book.filter(Q.passes(Q.POLICY)).count()
    with pytest.raises(ValueError):
        Q.ledger(odd, rules=(Q.Rule("a", 0, "true"), Q.Rule("b", 0, "true")))
    assert Q.ablate(book, Q.Policy("none")).count() == 0
