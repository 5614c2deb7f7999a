import corpus_pipeline
from mycelia.llm import exact_dedup, packing, pii, simhash, toxicity
from mycelia.llm.common import documents

DIR = "/root/testdata/sf0.001"


def test_run(spark):
    """The rows are those of the parts, one after the other."""
    docs = documents(spark, DIR)
    columns = docs.columns
    net = toxicity.fitted(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, net).filter("predicted = 1").collect()}
    step = docs.filter(~docs.doc_id.isin(sorted(bad) or [-1])).checkpoint()
    for check in (lambda d: exact_dedup.exact_dedup(d, keep="largest").filter("kept"), lambda d: simhash.simhash_groups(d).filter("doc_id = component_id")):
        keep = sorted(r["doc_id"] for r in check(step).collect())
        step = step.filter(step.doc_id.isin(keep)).checkpoint()
    want = sorted(tuple(r) for r in packing.token_pieces(pii.redact(step)).collect())
    got = corpus_pipeline.run(spark, DIR).collect()
    assert sorted(tuple(r)[:5] for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(n for _, n in places) <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, DIR).columns == columns, name


def test_odd_and_empty(spark, odd, none, monkeypatch):
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DIR).checkpoint()
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (docs.count() > 0) == (table is odd)
