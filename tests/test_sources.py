import numpy as np
import pytest

from mycelia.functions.paths import result_path_of, stem_of
from mycelia.functions.ranges import parse_ranges
from mycelia.sources import results as R
from mycelia.sources.edges import load_edges
from mycelia.sources.matlab import save_mat, sparse_entries, sparse_matrix, write_mat

ENTRIES = {(0, 1), (1, 0), (2, 2), (1, 3), (3, 1)}


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


@pytest.mark.parametrize("nested,compressed", [(True, True), (True, False), (False, True), (False, False)])
def test_mat(spark, tmp_path, nested, compressed):
    src, dst = (np.asarray([e[k] for e in sorted(ENTRIES)]) for k in (0, 1))
    write_mat(path := str(tmp_path / "g.MAT"), 5, 5, src, dst, nested, compressed)
    edges, n = load_edges(spark, path, symmetric=False)
    assert n == 5 and pairs(edges) == ENTRIES
    assert pairs(load_edges(spark, path, drop_self_loops=True)[0]) == ENTRIES - {(2, 2)}


def test_mat_refused(tmp_path):
    with pytest.raises(ValueError, match="7.3"):
        sparse_matrix(b"\x89HDF\r\n\x1a\n" + b"\0" * 200)
    with pytest.raises(ValueError, match="level 5"):
        sparse_matrix(b"nothing")
    with pytest.raises(ValueError, match="no sparse"):
        sparse_matrix(b"MATLAB".ljust(124) + b"\x00\x01IM")


def test_entries_come_in_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    src, dst = rng.integers(0, 50, 300), rng.integers(0, 50, 300)
    write_mat(path := str(tmp_path / "b.mat"), 50, 50, src, dst)
    with open(path, "rb") as f:
        blocks = list(sparse_entries(f.read(), 7))
    assert len(blocks) == 43 and sorted((int(a), int(b)) for x, y in blocks for a, b in zip(x, y, strict=True)) == sorted(zip(src.tolist(), dst.tolist(), strict=True))
    edges = spark.createDataFrame([(0, 1), (3, 2)], "src long, dst long")
    save_mat(edges, path, 4)
    assert pairs(load_edges(spark, path, symmetric=False)[0]) == {(0, 1), (3, 2)}
    monkeypatch.setattr("mycelia.sources.matlab.MAX_ENTRIES", 1)
    with pytest.raises(ValueError, match="entries"):
        save_mat(edges, path, 4)


def test_wide_matrix_keeps_square_part(spark, tmp_path):
    write_mat(path := str(tmp_path / "w.mat"), 3, 9, np.asarray([0, 1]), np.asarray([1, 8]))
    assert pairs(load_edges(spark, path, symmetric=False)[0]) == {(0, 1)}


def test_matrix_market(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% a comment\n\n4 4 3\n2 1\n4 2\n3 3\n")
    edges, n = load_edges(spark, str(tmp_path / "g.mtx"))
    assert n == 4 and pairs(edges) == ENTRIES
    (tmp_path / "bad.mtx").write_text("1 2\n")
    with pytest.raises(ValueError):
        load_edges(spark, str(tmp_path / "bad.mtx"))


def test_delimited_and_parquet(spark, tmp_path):
    (tmp_path / "g.csv").write_text("# head\nsrc,dst\n0,1\n1,3\n2,2\n,\nx,1\n")
    (tmp_path / "g.tsv").write_text("0\t1\n1\t3\n2\t2\n")
    spark.createDataFrame([(0, 1), (1, 3), (2, 2)], "src int, dst int").write.parquet(str(tmp_path / "g.parquet"))
    for name in ("g.csv", "g.tsv", "g.parquet"):
        assert pairs(load_edges(spark, str(tmp_path / name))[0]) == ENTRIES
    with pytest.raises(ValueError, match="extension"):
        load_edges(spark, "g.xyz")


def test_append_columns(spark, tmp_path):
    path = str(tmp_path / "out" / "r.csv")
    for name, values in (("a", [1, 2]), ("b", [3]), ("a", [4])):
        R.append_column(path, name, values)
    with open(path) as f:
        assert f.read() == "a,b\n1.000000,3.000000\n2.000000,\n4.000000,\n"
    assert [tuple(r) for r in R.read_results(spark, path).collect()] == [("1.000000", "3.000000"), ("2.000000", ""), ("4.000000", "")]
    cells = spark.createDataFrame(R.placed([("a", [1, 2]), ("b", [3]), ("a", [4])]), R.CELLS)
    assert [tuple(r)[1:] for r in R.wide(cells, ["a", "b"]).orderBy("row").collect()] == [("1.000000", "3.000000"), ("2.000000", ""), ("4.000000", "")]


def test_append_in_any_store(spark, tmp_path):
    path = f"file://{tmp_path}/r.csv"
    for name, values in (("a", [1, 2]), ("b", [3]), ("a", [4])):
        R.append_column(path, name, values, spark)
    assert (tmp_path / "r.csv").read_text() == "a,b\n1.000000,3.000000\n2.000000,\n4.000000,\n"


def test_release(spark):
    from mycelia import session

    session.release(spark)
    paths = [session.scratch(spark, "x") for _ in range(3)]
    spark.range(3).write.parquet(paths[0])
    assert session.release(spark) == 3 and session.release(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(paths[0])


def test_no_local_checkpoints_on_a_cluster():
    from mycelia import session

    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="share"):
        session.checkpoint_dir(Session)


def test_paths():
    assert [stem_of(p) for p in ("a/b.mat", ".x", "", "d/", "x.tar.mtx")] == ["b", ".x", "graph", "graph", "x.tar"]
    assert result_path_of("", "p", "g.mat") == "p_g.csv" and result_path_of("r/", "p", "g.mat") == "r/p_g.csv"


def test_ranges():
    assert parse_ranges("8,1:5:2, 3") == [1, 3, 5, 8]
    for bad in ("", "0", "5:1", "1:5:0", "1:2:3:4", "1:5:", "x", "1,x", "-1"):
        with pytest.raises(ValueError):
            parse_ranges(bad)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from mycelia import cli

    monkeypatch.setattr(cli, "build", lambda **_: spark)
    write_mat(path := str(tmp_path / "g.mat"), 5, 5, *(np.asarray([e[k] for e in sorted(ENTRIES)]) for k in (0, 1)))
    for method in ("contract", "staged"):
        assert cli.main([path, "-o", str(tmp_path / method), "-c", "1000", "-e", "1,2", "-r", "2", "-m", method]) == 0
        rows = (tmp_path / method / "results_spark_g.csv").read_text().splitlines()
        assert rows[0] == "chunk_1000_exchange_1,chunk_1000_exchange_2" and len(rows) == 3
    assert capsys.readouterr().out.count("3 components") == 8
