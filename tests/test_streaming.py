from mycelia.streaming.incremental import IncrementalComponents


def test_batches(spark, tmp_path):
    source = str(tmp_path / "edges")
    schema = "src long, dst long"
    state = IncrementalComponents(spark, str(tmp_path / "labels"))
    assert state.labels().count() == 0
    want = [{0: 0, 1: 0, 2: 2, 3: 2}, {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 6: 5}]
    for rows, labels in zip(([(0, 1), (3, 2)], [(1, 3), (6, 5)]), want, strict=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        state.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "checkpoint")).awaitTermination()
        assert {r["id"]: r["component"] for r in state.labels().collect()} == labels
