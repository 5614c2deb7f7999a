"""Queries of the graph operators over the test tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mycelia.functions.paths import result_path, stem
from mycelia.functions.ranges import config_name, range_values
from mycelia.operators import components as C
from mycelia.operators import halo as H
from mycelia.operators import normalize as N
from mycelia.operators import partition as P
from mycelia.plans.staged import bounds_of, staged_components
from mycelia.session import checkpoint_dir, scratch
from mycelia.sources import edges as E
from mycelia.sources.matlab import save_mat
from mycelia.sources.results import CELLS, append_column, placed, read_results, wide
from mycelia.sources.views import VIEWS, VIEWS_SQL

PARTS = 4
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


def graph(spark: SparkSession, sf_dir: str, view: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and stored edges (both directions, each once) of a view."""
    checkpoint_dir(spark)
    vertices, edges = VIEWS[view](spark, sf_dir)
    return vertices, N.symmetrize(edges)


def cut(spark: SparkSession, sf_dir: str, view: str) -> H.Halo:
    vertices, edges = graph(spark, sf_dir, view)
    edges = edges.checkpoint()  # read for the bounds, for the parts' own edges and for the boundary
    return H.Halo(edges, vertices, bounds_of(edges, vertices, PARTS))


def with_views(view: str, body: str) -> str:
    """SQL over v (id), raw (src, dst), s (stored edges: both directions, each once)."""
    vertices, edges = VIEWS_SQL[view]
    return f"WITH RECURSIVE v AS ({vertices}), raw AS ({edges}), s AS (SELECT src, dst FROM raw UNION SELECT dst, src FROM raw){body}"


#: Parts by edges: a vertex weighs its degree and one, and part r begins where the weight before reaches r / PARTS of all.
_PARTS = f""", deg AS (SELECT v.id, count(s.src) AS degree FROM v LEFT JOIN s ON s.src = v.id GROUP BY v.id),
pre AS (SELECT id, degree, coalesce(sum(degree + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre, sum(degree + 1) OVER () AS w FROM deg),
p AS (SELECT id, degree, CAST({" + ".join(f"(CASE WHEN pre >= (w * {r}) // {PARTS} THEN 1 ELSE 0 END)" for r in range(1, PARTS))} AS INTEGER) AS part FROM pre)"""
_CUT = """, e AS MATERIALIZED (SELECT a.part, b.part AS peer, s.src, s.dst FROM s JOIN p a ON a.id = s.src JOIN p b ON b.id = s.dst)"""


def _components_sql(edges: str, name: str = "cc") -> str:
    """Smallest id of each vertex's component over edges (src, dst) in both directions."""
    return f""", {name}(id, component) USING KEY (id) AS (
  SELECT id, id FROM v
  UNION
  SELECT x.dst, min(d.component) FROM {name} d JOIN {edges} x ON x.src = d.id JOIN recurring.{name} k ON k.id = x.dst
  WHERE d.component < k.component GROUP BY x.dst)"""


_LOCAL = _PARTS + _CUT + ", le AS (SELECT src, dst FROM e WHERE part = peer)" + _components_sql("le", "lc") + ", local AS (SELECT p.part, lc.id, lc.component AS rep FROM lc JOIN p ON p.id = lc.id)"
_BOUNDARY = _LOCAL + ", b AS (SELECT DISTINCT e.part, l.rep, e.dst AS remote FROM e JOIN local l ON l.id = e.src WHERE e.part <> e.peer)"
_GHOSTS = _PARTS + _CUT + ", gh AS (SELECT DISTINCT part, peer, dst AS vertex FROM e WHERE part <> peer), nf AS (SELECT part, peer, row_number() OVER (PARTITION BY part, peer ORDER BY vertex) - 1 AS pos, vertex FROM gh)"
_HOOK = _BOUNDARY + ", h AS (SELECT r.part, r.rep, least(r.rep, coalesce(min(b.remote), r.rep)) AS label FROM (SELECT DISTINCT part, rep FROM local) r LEFT JOIN b ON b.part = r.part AND b.rep = r.rep GROUP BY r.part, r.rep)"
_JUMP = _HOOK + ", k AS (SELECT l.id AS vertex, h.label FROM local l JOIN h ON h.rep = l.rep)" + "".join(f", j{n} AS (SELECT j.part, j.rep, least(j.label, k.label) AS label FROM {'h' if n == 1 else f'j{n - 1}'} j JOIN k ON k.vertex = j.label)" for n in range(1, 5))
_ROUND1 = _JUMP + ", vl AS (SELECT l.id AS vertex, j4.label FROM local l JOIN j4 ON j4.rep = l.rep), gh AS (SELECT DISTINCT part, peer, dst AS vertex FROM e WHERE part <> peer), nf AS (SELECT part, peer, row_number() OVER (PARTITION BY part, peer ORDER BY vertex) - 1 AS pos, vertex FROM gh)"


@query("edges_symmetrized", with_views("g3", " SELECT src, dst FROM s"))
def edges_symmetrized(spark, sf_dir):
    vertices, edges = VIEWS["g3"](spark, sf_dir)
    return N.symmetrize(N.in_range(edges, vertices.count()))


@query("vertex_degree", with_views("g4", " SELECT v.id, count(s.src) AS degree FROM v LEFT JOIN s ON s.src = v.id GROUP BY v.id"))
def vertex_degree(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir, "g4")
    return N.degrees(edges, vertices)


@query("stored_entries", with_views("g4", ", r AS (SELECT src, dst FROM raw UNION ALL SELECT dst, src FROM raw) SELECT v.id, count(r.src) AS degree FROM v LEFT JOIN r ON r.src = v.id GROUP BY v.id"))
def stored_entries(spark, sf_dir):
    """Degrees that count duplicate entries."""
    vertices, edges = VIEWS["g4"](spark, sf_dir)
    return N.degrees(C._both(edges), vertices)


@query("csr_row_ptr", with_views("g4", _PARTS + " SELECT id, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_start, CAST(sum(degree) OVER (ORDER BY id) AS BIGINT) AS row_end FROM deg"))
def csr_row_ptr(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir, "g4")
    return N.row_offsets(edges, vertices)


@query("csr_adjacency", with_views("g3", " SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, dst FROM s"))
def csr_adjacency(spark, sf_dir):
    return N.adjacency(graph(spark, sf_dir, "g3")[1])


@query("csr_neighbours", with_views("g3", " SELECT src, count(*) AS degree, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS nbrs FROM s GROUP BY src"))
def csr_neighbours(spark, sf_dir):
    return N.neighbour_lists(graph(spark, sf_dir, "g3")[1]).withColumn("nbrs", F.array_join(F.col("nbrs").cast("array<string>"), ","))


@query("dense_ids", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS id FROM conversations")
def dense_ids(spark, sf_dir):
    checkpoint_dir(spark)
    return N.dense_ids(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn"), "conv_id", "turn")


@query("partition_vertex", with_views("g4", f", c AS (SELECT count(*) AS n, count(*) // {PARTS} AS q, count(*) % {PARTS} AS r FROM v) SELECT id, CAST(CASE WHEN id < r * (q + 1) THEN id // (q + 1) ELSE r + (id - r * (q + 1)) // q END AS INTEGER) AS part FROM v, c"))
def partition_vertex(spark, sf_dir):
    vertices, _ = VIEWS["g4"](spark, sf_dir)
    return vertices.select("id", P.vertex_part(F.col("id"), vertices.count(), PARTS).alias("part"))


@query("partition_edge", with_views("g4", _PARTS + " SELECT id, part FROM p"))
def partition_edge(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir, "g4")
    return P.parts_of(vertices, bounds_of(edges, vertices, PARTS))


@query("partition_bounds", with_views("g4", _PARTS + " SELECT part, min(id) AS v_start, max(id) + 1 AS v_end FROM p GROUP BY part"))
def partition_bounds(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir, "g4")
    return P.bounds_table(spark, bounds_of(edges, vertices, PARTS))


@query("total_weight", with_views("g4", _PARTS + " SELECT CAST(sum(degree + 1) AS BIGINT) AS weight FROM deg"))
def total_weight(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir, "g4")
    return N.degrees(edges, vertices).agg(F.sum(F.col("degree") + 1).alias("weight"))


@query(
    "partition_balance",
    with_views("g4", _PARTS + f", c AS (SELECT count(*) // {PARTS} AS q, count(*) % {PARTS} AS r FROM v) SELECT 'edge' AS scheme, part, count(*) AS n_local, CAST(sum(degree) AS BIGINT) AS m_local FROM p GROUP BY part UNION ALL SELECT 'vertex', CAST(CASE WHEN id < r * (q + 1) THEN id // (q + 1) ELSE r + (id - r * (q + 1)) // q END AS INTEGER) AS part, count(*), CAST(sum(degree) AS BIGINT) FROM deg, c GROUP BY 2"),
)
def partition_balance(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir, "g4")
    each = [P.balance(edges, vertices, bounds_of(edges, vertices, PARTS, by)).select(F.lit(name).alias("scheme"), "part", "n_local", "m_local") for name, by in (("edge", True), ("vertex", False))]
    return each[0].unionByName(each[1])


@query("local_edges", with_views("g4", _PARTS + _CUT + " SELECT part, src, dst FROM e WHERE part = peer"))
def local_edges(spark, sf_dir):
    return cut(spark, sf_dir, "g4").local_edges()


@query("boundary_raw", with_views("g4", _PARTS + _CUT + " SELECT part, src, dst FROM e WHERE part <> peer"))
def boundary_raw(spark, sf_dir):
    return cut(spark, sf_dir, "g4").boundary_raw()


@query("local_cc", with_views("g7", _LOCAL + " SELECT part, id, rep FROM local"))
def local_cc(spark, sf_dir):
    return cut(spark, sf_dir, "g7").local_cc()


@query("local_reps", with_views("g7", _LOCAL + " SELECT part, count(DISTINCT rep) AS n_reps FROM local GROUP BY part"))
def local_reps(spark, sf_dir):
    return cut(spark, sf_dir, "g7").local_reps()


for _view in ("g4", "g7"):
    query(f"boundary_dedup_{_view}", with_views(_view, _BOUNDARY + " SELECT part, rep, remote FROM b"))(lambda spark, sf_dir, view=_view: cut(spark, sf_dir, view).boundary())


@query("boundary_sorted", with_views("g7", _BOUNDARY + " SELECT part, rep, remote, row_number() OVER (PARTITION BY part ORDER BY remote, rep) - 1 AS place FROM b"))
def boundary_sorted(spark, sf_dir):
    return cut(spark, sf_dir, "g7").sorted_boundary()


@query("ghosts", with_views("g7", _GHOSTS + " SELECT part, row_number() OVER (PARTITION BY part ORDER BY vertex) - 1 AS gidx, vertex FROM gh"))
def ghosts(spark, sf_dir):
    return cut(spark, sf_dir, "g7").ghosts()


@query("halo_need_from", with_views("g7", _GHOSTS + " SELECT part, peer, pos, vertex FROM nf"))
def halo_need_from(spark, sf_dir):
    return cut(spark, sf_dir, "g7").need_from()


@query("halo_send_to", with_views("g7", _GHOSTS + " SELECT peer AS part, part AS peer, pos, vertex FROM nf"))
def halo_send_to(spark, sf_dir):
    return cut(spark, sf_dir, "g7").send_to()


_COUNTS = _GHOSTS + ", hc AS (SELECT part, peer, CAST(sum(need) AS BIGINT) AS need, CAST(sum(send) AS BIGINT) AS send FROM (SELECT part, peer, 1 AS need, 0 AS send FROM nf UNION ALL SELECT peer, part, 0, 1 FROM nf) GROUP BY part, peer)"


@query("halo_counts", with_views("g7", _COUNTS + " SELECT part, peer, need, send FROM hc"))
def halo_counts(spark, sf_dir):
    return cut(spark, sf_dir, "g7").counts()


@query("halo_displacements", with_views("g7", _COUNTS + " SELECT part, peer, CAST(coalesce(sum(need) OVER w, 0) AS BIGINT) AS need_start, CAST(coalesce(sum(send) OVER w, 0) AS BIGINT) AS send_start FROM hc WINDOW w AS (PARTITION BY part ORDER BY peer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def halo_displacements(spark, sf_dir):
    """Where each peer's vertices begin in a part's flat lists."""
    from pyspark.sql import Window

    w = Window.partitionBy("part").orderBy("peer").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_start")
    return cut(spark, sf_dir, "g7").counts().select("part", "peer", start("need"), start("send"))


@query("halo_topology", with_views("g7", _COUNTS + " SELECT part, count(*) FILTER (need > 0) AS n_in, count(*) FILTER (send > 0) AS n_out FROM hc GROUP BY part"))
def halo_topology(spark, sf_dir):
    return cut(spark, sf_dir, "g7").topology()


def _round1(spark, sf_dir):
    halo = cut(spark, sf_dir, "g7")
    local = halo.local_cc().checkpoint()
    return halo, local, H.hook(H.initial(local), halo.boundary(local)).checkpoint()


@query("hook_round1", with_views("g7", _HOOK + " SELECT part, rep, label FROM h"))
def hook_round1(spark, sf_dir):
    return _round1(spark, sf_dir)[2]


@query("pointer_jump", with_views("g7", _JUMP + " SELECT rep AS id, label FROM j4"))
def pointer_jump(spark, sf_dir):
    _, local, hooked = _round1(spark, sf_dir)
    return H.jump(hooked, local).select(F.col("rep").alias("id"), "label")


@query("label_lookup", with_views("g7", _HOOK + ", k AS (SELECT l.id AS vertex, h.label FROM local l JOIN h ON h.rep = l.rep) SELECT vertex, label FROM k"))
def label_lookup(spark, sf_dir):
    """Every vertex with its representative's label."""
    _, local, hooked = _round1(spark, sf_dir)
    return H.vertex_labels(local, hooked)


@query("delta_round1", with_views("g7", _ROUND1 + " SELECT nf.peer AS part, nf.part AS peer, nf.pos, vl.label, (nf.pos << 32) | vl.label AS packed FROM nf JOIN vl ON vl.vertex = nf.vertex"))
def delta_round1(spark, sf_dir):
    """The first message sends every label, as none was sent before."""
    halo, local, hooked = _round1(spark, sf_dir)
    return H.delta(halo.send_to(), H.vertex_labels(local, H.jump(hooked, local)))


@query("delta_round2", with_views("g7", _ROUND1 + " SELECT nf.peer AS part, nf.part AS peer, nf.pos, vl.label, (nf.pos << 32) | vl.label AS packed FROM nf JOIN vl ON vl.vertex = nf.vertex JOIN local l ON l.id = nf.vertex WHERE vl.label < l.rep"))
def delta_round2(spark, sf_dir):
    """Only labels that fell below what an earlier message, of the initial labels, said."""
    halo, local, hooked = _round1(spark, sf_dir)
    sent = H.delta(halo.send_to(), H.vertex_labels(local, H.initial(local)))
    return H.delta(halo.send_to(), H.vertex_labels(local, H.jump(hooked, local)), sent)


@query("delta_unpacked", with_views("g7", _ROUND1 + " SELECT nf.peer AS part, nf.part AS peer, nf.pos, vl.label FROM nf JOIN vl ON vl.vertex = nf.vertex"))
def delta_unpacked(spark, sf_dir):
    return H.unpacked(delta_round1(spark, sf_dir))


@query("delta_received", with_views("g7", _ROUND1 + " SELECT nf.part, nf.vertex, vl.label FROM nf JOIN vl ON vl.vertex = nf.vertex"))
def delta_received(spark, sf_dir):
    """Ghosts' labels after the first message."""
    halo, local, hooked = _round1(spark, sf_dir)
    message = H.delta(halo.send_to(), H.vertex_labels(local, H.jump(hooked, local)))
    own = halo.ghosts().select("part", "vertex", F.col("vertex").alias("label"))
    return H.received(own, message, halo.need_from())


@query("full_exchange_round1", with_views("g7", _ROUND1 + ", gi AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vertex) - 1 AS gidx, vertex FROM gh) SELECT gi.part, gi.gidx, vl.label FROM gi JOIN vl ON vl.vertex = gi.vertex"))
def full_exchange_round1(spark, sf_dir):
    halo, local, hooked = _round1(spark, sf_dir)
    return H.full_exchange(halo.ghosts(), H.vertex_labels(local, H.jump(hooked, local)))


@query("any_changed", with_views("g7", _HOOK + " SELECT bool_or(label < rep) AS changed FROM h"))
def any_changed(spark, sf_dir):
    """Whether any label fell in the first round."""
    return _round1(spark, sf_dir)[2].agg(F.bool_or(F.col("label") < F.col("rep")).alias("changed"))


def _labels(method: str = "contract"):
    def run(spark, sf_dir, view):
        vertices, edges = VIEWS[view](spark, sf_dir)
        return C.connected_components(edges, vertices, method, closed=True)

    return run


for _view in VIEWS:
    _all = with_views(_view, _components_sql("s"))
    query(f"cc_labels_{_view}", _all + " SELECT id, component FROM cc")(lambda spark, sf_dir, view=_view: _labels()(spark, sf_dir, view))
    query(f"cc_count_{_view}", _all + " SELECT count(*) AS n_components FROM cc WHERE id = component")(lambda spark, sf_dir, view=_view: C.component_count(_labels()(spark, sf_dir, view)))
for _view in ("g3", "g6"):
    query(f"cc_sizes_{_view}", with_views(_view, _components_sql("s")) + " SELECT component, count(*) AS n FROM cc GROUP BY component")(lambda spark, sf_dir, view=_view: C.component_sizes(_labels()(spark, sf_dir, view)))
for _method, _view in (("stars", "g2"), ("labels", "g6"), ("frontier", "g2")):
    query(f"cc_by_{_method}_{_view}", with_views(_view, _components_sql("s")) + " SELECT id, component FROM cc")(lambda spark, sf_dir, view=_view, method=_method: _labels(method)(spark, sf_dir, view))


@query("cc_count_distinct", with_views("g3", _components_sql("s")) + " SELECT count(DISTINCT component) AS n_components FROM cc")
def cc_count_distinct(spark, sf_dir):
    vertices, edges = VIEWS["g3"](spark, sf_dir)
    return C.distinct_labels(C.connected_components(edges, vertices, closed=True), vertices.count())


@query("cc_staged_halo", with_views("g7", _components_sql("s")) + " SELECT id, component FROM cc")
def cc_staged_halo(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir, "g7")
    return staged_components(edges.checkpoint(), vertices, PARTS, exchange_interval=2)


@query("cc_staged_by_vertices", with_views("g6", _components_sql("s")) + " SELECT id, component FROM cc")
def cc_staged_by_vertices(spark, sf_dir):
    """Other parts, other intervals: ranges by vertices, an exchange every round."""
    vertices, edges = graph(spark, sf_dir, "g6")
    return staged_components(edges.checkpoint(), vertices, 3, exchange_interval=1, by_edges=False)


SPECS = ("8,1:5:2, 3", "1,4,8", "2:6", "2048", "10:1", "1::2", "7,,7")


@query(
    "range_list",
    f"""WITH t AS (SELECT spec, trim(token) AS token, string_split(trim(token), ':') AS f FROM (SELECT spec, unnest(string_split(spec, ',')) AS token FROM (VALUES {", ".join(f"('{s}')" for s in SPECS)}) s(spec)) WHERE token <> ''),
n AS (SELECT spec, f, TRY_CAST(f[1] AS BIGINT) AS low, TRY_CAST(f[least(len(f), 2)] AS BIGINT) AS high, CASE WHEN len(f) > 2 THEN TRY_CAST(f[3] AS BIGINT) ELSE 1 END AS step FROM t),
ok AS (SELECT *, coalesce(len(f) <= 3 AND low > 0 AND high >= low AND step > 0, false) AS good FROM n),
x AS (SELECT DISTINCT spec, unnest(generate_series(low, high, step)) AS value FROM ok WHERE spec NOT IN (SELECT spec FROM ok WHERE NOT good))
SELECT spec, row_number() OVER (PARTITION BY spec ORDER BY value) - 1 AS pos, value FROM x""",
)
def range_list(spark, sf_dir):
    specs = spark.createDataFrame([(s,) for s in SPECS], "spec string")
    return specs.select("spec", F.posexplode(range_values(F.col("spec"))).alias("pos", "value")).select("spec", F.col("pos").cast("long").alias("pos"), F.col("value").cast("long").alias("value"))


@query("sweep_plan", "SELECT c.chunk, e.exchange, r.run, 'chunk_' || c.chunk || '_exchange_' || e.exchange AS name FROM (VALUES (1024), (2048), (4096)) c(chunk), (VALUES (1), (2), (4), (8)) e(exchange), (VALUES (0), (1)) r(run)")
def sweep_plan(spark, sf_dir):
    each = lambda spec, name: spark.createDataFrame([(spec,)], "spec string").select(F.explode(range_values(F.col("spec"))).alias(name))
    runs = spark.range(2).select(F.col("id").cast("int").alias("run"))
    return each("1024,2048,4096", "chunk").crossJoin(each("1,2,4,8", "exchange")).crossJoin(runs).withColumn("name", config_name(F.col("chunk"), F.col("exchange")))


APPENDS = [("a", [1.0, 2.0]), ("b", [3.0]), ("a", [4.0]), ("c", [0.5, 0.25, 1 / 3, 7.0])]


@query("results_wide", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), '1.000000', '3.000000', '0.500000'), (1, '2.000000', '', '0.250000'), (2, '4.000000', '', '0.333333'), (3, '', '', '7.000000')) t(\"row\", a, b, c)")
def results_wide(spark, sf_dir):
    cells = placed(APPENDS)
    return wide(spark.createDataFrame(cells, CELLS), list(dict.fromkeys(name for name, _ in APPENDS)))


@query("results_file", "SELECT * FROM (VALUES ('1.000000', '3.000000', '0.500000'), ('2.000000', '', '0.250000'), ('4.000000', '', '0.333333'), ('', '', '7.000000')) t(a, b, c)")
def results_file(spark, sf_dir):
    """The same in a real file, column by column, read back."""
    path = scratch(spark, "results") + "/times.csv"
    for name, values in APPENDS:
        append_column(path, name, values, spark)
    return read_results(spark, path)


def _written(kind: str):
    """A view's edges, one direction, written as a file of that kind and loaded again as a stored graph."""

    def run(spark, sf_dir):
        vertices, edges = VIEWS["g2"](spark, sf_dir)
        path = f"{scratch(spark, 'edges')}/graph.{kind}"
        if kind == "mat":
            save_mat(edges, path, vertices.count())
        elif kind == "mtx":
            E.write_matrix_market(edges, path, vertices.count())
        elif kind == "parquet":
            edges.write.parquet(path)
        else:
            edges.write.option("sep", "," if kind == "csv" else "\t").csv(path)
        return E.load_edges(spark, path)[0]

    return run


for _kind in ("csv", "tsv", "parquet", "mtx", "mat"):
    query(f"source_{_kind}", with_views("g2", " SELECT src, dst FROM s"))(_written(_kind))


PATHS = ("data/com-graph.mat", "x.tar.mtx", ".hidden", "dir/.cfg.mat", "noext", "dir/", "", "/a/b.c/d.MAT")


@query("result_path", f"SELECT path, CASE WHEN cut = '' THEN 'graph' ELSE cut END AS stem, 'results/results_mpi_' || CASE WHEN cut = '' THEN 'graph' ELSE cut END || '.csv' AS \"out\" FROM (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS cut FROM (VALUES {', '.join(f"('{p}')" for p in PATHS)}) t(path))")
def result_paths(spark, sf_dir):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return paths.select("path", stem(F.col("path")).alias("stem"), result_path(F.lit("results"), F.lit("results_mpi"), F.col("path")).alias("out"))
