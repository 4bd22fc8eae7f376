"""Traversal goldens, extraction from statement texts, numbering and the serving helpers."""

from __future__ import annotations

import os

import pytest
from harness import SF_DIR
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.operators import extract, graph, ingest, serve, traverse
from lodeweave.operators.numbering import numbered
from lodeweave.plans import registry
from lodeweave.sources import fixtures
from lodeweave.sources.catalog_views import Frames


@pytest.fixture(scope="module")
def patterns(spark):
    return traverse.active(fixtures.pattern_edges(spark)).cache()


@pytest.mark.parametrize("table", sorted(fixtures.PATTERNS))
def test_patterns(spark, patterns, table):
    start, way, depth, edges, paths, by_node = fixtures.PATTERNS[table][1]
    root = spark.createDataFrame([(f"demo.{table}.{start}",)], "root string")
    w = traverse.walk(patterns, root, direction=way, max_depth=depth, rule="edge")
    assert (w.select("provenance_id").distinct().count(), w.count()) == (edges, paths)
    assert traverse.walk(patterns, root, direction=way, max_depth=depth).select("provenance_id").distinct().count() == by_node


def test_reach_has_least_depths(spark, patterns):
    root = spark.createDataFrame([("demo.NESTED_DIAMOND.a",)], "root string")
    got = {r["node"][-1]: r["depth"] for r in traverse.reach(patterns, root).collect()}
    assert got == {"b": 1, "c": 1, "d": 2, "e": 3, "f": 3, "g": 4}
    assert traverse.reach(patterns, root, max_depth=1).count() == 2 and traverse.reach(patterns, root.limit(0)).count() == 0


def test_field_provenance_in_any_case(spark, patterns):
    one, other = (traverse.field_provenance(patterns, "demo.DIAMOND", f, "downstream").count() for f in ("a", "A"))
    assert one == other == 4


def test_impact_marks_direct_and_critical(spark):
    e = spark.createDataFrame([("x", "db.STG_A.c", "db.FACT_B.c"), ("y", "db.FACT_B.c", "db.RPT_C.c")], "provenance_id string, src string, tgt string")
    got = sorted((r["node"], r["impact_type"], r["critical"]) for r in graph.impact(e, spark.createDataFrame([("db.STG_A.c",)], "root string")).collect())
    assert got == [("db.FACT_B.c", "direct", True), ("db.RPT_C.c", "indirect", True)]


# Statement -> status and edges "source>target kind".
STATEMENTS = {
    "INSERT INTO t (a, b) SELECT x.p + x.q, 1 FROM s x": ("ok", {"d.s.p>d.t.a CALCULATION", "d.s.q>d.t.a CALCULATION"}),
    "insert into dw.t(k, n) select s.k, count(*) from src.s s group by s.k;": ("ok", {"src.s.k>dw.t.k DIRECT"}),
    "INSERT INTO t SELECT a.id AS id, TRIM(a.f) || ', ' || b.g AS nm FROM u a, v b WHERE a.id = b.id": ("ok", {"d.u.id>d.t.id DIRECT", "d.u.f>d.t.nm CALCULATION", "d.v.g>d.t.nm CALCULATION"}),
    "INSERT INTO t (a) SELECT x FROM u UNION ALL SELECT y FROM v": ("ok", {"d.u.x>d.t.a DIRECT", "d.v.y>d.t.a DIRECT"}),
    "CREATE MULTISET TABLE dw.t AS (SELECT s.a, SUM(s.b) AS total FROM s) WITH DATA": ("ok", {"d.s.a>dw.t.a DIRECT", "d.s.b>dw.t.total AGGREGATION"}),
    "CREATE VIEW v (one, two) AS SELECT a, CASE WHEN b > 0 THEN c ELSE 0 END FROM s -- a comment, b": ("ok", {"d.s.a>d.v.one DIRECT", "d.s.b>d.v.two CALCULATION", "d.s.c>d.v.two CALCULATION"}),
    "MERGE INTO m USING s x ON m.id = x.id WHEN MATCHED THEN UPDATE SET n = x.n, k = x.a + m.k WHEN NOT MATCHED THEN INSERT (id, n) VALUES (x.id, x.n)": ("ok", {"d.s.n>d.m.n DIRECT", "d.s.a>d.m.k CALCULATION", "d.m.k>d.m.k CALCULATION", "d.s.id>d.m.id DIRECT"}),
    "UPDATE m FROM s x SET a = x.b WHERE m.id = x.id": ("ok", {"d.s.b>d.m.a DIRECT"}),
    "UPDATE m SET a = b * 2": ("ok", {"d.m.b>d.m.a CALCULATION"}),
    "INSERT INTO t SELECT * FROM s JOIN r ON s.i = r.i": ("fallback", set()),
    "DROP TABLE t": ("failed", set()),
    "": ("failed", set()),
    None: ("skipped", set()),
}


def test_extraction_of_statements(spark):
    rows = [(i, None, "d", s) for i, s in enumerate(STATEMENTS)]
    log = spark.createDataFrame(rows, "query_id int, start_time timestamp, default_database string, sql_text string")
    x = extract.extract(log)
    status = {r["sql_text"]: r["status"] for r in x.collect()}
    edges = {s: set() for s in STATEMENTS}
    for r in extract.edge_rows(x).join(log.select("query_id", "sql_text"), "query_id").filter("kind <> 'UNKNOWN'").collect():
        edges[r["sql_text"]].add(f"{r['src']}>{r['tgt']} {r['kind']}")
    assert {s: (status[s], edges[s]) for s in STATEMENTS} == STATEMENTS
    whole = extract.edge_rows(x).filter("kind = 'UNKNOWN'").select("src", "tgt", F.col("confidence_score").cast("double").alias("c")).collect()
    assert sorted(map(tuple, whole)) == [("d.r.*", "d.t.*", 0.6), ("d.s.*", "d.t.*", 0.6)]


def test_numbering_across_cells(spark):
    df = spark.createDataFrame([(k, t) for k in (5, -3, 100, 100, 7, 250) for t in "a"], "k long, t string")
    got = [(r["n"], r["k"]) for r in numbered(df, "n", "k", ["t"], cell=10).orderBy("n").collect()]
    assert got == [(1, -3), (2, 5), (3, 7), (4, 100), (5, 100), (6, 250)]


def test_serving_helpers(spark):
    assert serve.page_of(0, 20, 0) == (1, 1, 0) and serve.page_of(40, 20, 95) == (3, 5, 80)
    with pytest.raises(ValueError):
        serve.checked_query(" x ")
    names = spark.createDataFrame([("OL_X",), ("OLD_X",), ("LINEITEM",), ("LIN_Y",)], "n string")
    assert [r[0] for r in names.filter(serve.own_table(F.col("n"))).collect()] == ["OL_X", "LIN_Y"]
    assert names.filter(serve.own_table(F.col("n"), compat=True)).count() == 4


def test_database_expansion_by_direction(spark, patterns):
    assert {w: graph.expand_database(patterns, "demo", direction=w, max_depth=1).count() for w in ("both", "upstream")} == {"both": patterns.count(), "upstream": patterns.count()}
    assert graph.expand_database(patterns, "dem_", max_depth=2).count() == 0


def test_sorted_edge_table_keeps_all_edges_in_order(spark):
    every = [tuple(r) for r in registry.QUERIES["edge_table"](spark, SF_DIR).collect()]
    got = [tuple(r) for r in registry.QUERIES["edge_table_sorted_all"](spark, SF_DIR).collect()]
    assert len(every) > 100
    assert got == sorted(every, key=lambda r: (1 if r[-1] is None else -r[-1], r[0]))


def test_weak_component_has_no_bound(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") if i % 2 else (f"n{i + 1}", f"n{i}") for i in range(56)] + [("n3", "n5"), ("x", "y")], "src string, tgt string")
    got = graph.weak_component(e, spark.createDataFrame([("n0",), ("x",)], "root string")).collect()
    assert sorted(map(tuple, got)) == sorted([("n0", f"n{i}") for i in range(57)] + [("x", "x"), ("x", "y")])


def test_numbers_start_with_null_keys_and_lose_no_row(spark):
    df = spark.createDataFrame([(None, "a"), (5, "b"), (5, "c"), (70_000, "d")], "k long, v string")
    got = [(r["v"], r["n"]) for r in numbered(df, "n", "k", ["v"]).orderBy("n").collect()]
    assert got == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


@pytest.mark.parametrize("most, unique", [(3, False), (1000, False), (3, True)])
def test_numbers_of_often_repeated_keys(spark, most, unique):
    rows = [(None, k % 7) for k in range(20)] + [(9, k % 5) for k in range(30)] + [(4, 1), (-70_000, 2), (80_000, 0)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = numbered(df, "n", "k", ["v"], most=most, unique=unique)
    assert got.columns == ["k", "v", "n"]
    got = sorted((r["n"], r["k"], r["v"]) for r in got.collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(i + 1, *r) for i, r in enumerate(want)]
    assert numbered(df.limit(0), "n", "k", most=most, unique=unique).count() == 0


def test_upsert_replaces_known_keys(spark):
    known, new = (spark.createDataFrame(rows, "k string, v long") for rows in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert sorted(map(tuple, serve.upsert(known, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_statement_texts_are_read_once_and_like_the_stream_reads_them(spark):
    rows = [(1, "INSERT INTO t (a) SELECT x FROM u", "db"), (2, "INSERT INTO t (a) SELECT x FROM u", "other"), (3, None, "db"), (4, "", "db"), (5, "INSERT INTO t (a) SELECT x FROM u", None)]
    log = spark.createDataFrame(rows, "query_id long, sql_text string, default_database string")
    cols = ["query_id", "target", "edges", "n_unresolved", "sources", "status"]
    once, each = ({r["query_id"]: tuple(r) for r in f(log).select(*cols).collect()} for f in (extract.extract_log, extract.extract))
    assert once == each and once[3][-1] == "skipped" and once[1] != once[2]


def test_first_edges_come_from_the_earliest_statement_of_each_text(spark):
    """Repeated texts, ties and nulls of times, an edge that two texts give, a text without edges, no text; and no rows at all."""
    nested = "INSERT INTO t (a, b) SELECT * FROM (SELECT * FROM (SELECT u.x, u.y FROM u) p) q"
    rows = [
        (7, 3, "INSERT INTO t (a) SELECT x FROM u", "d"), (6, 3, "INSERT INTO t (a) SELECT x FROM u", "d"), (5, 4, "INSERT INTO t (a) SELECT x FROM u", "d"), (1, 4, "INSERT INTO t (a) SELECT u.x FROM u", "d"),
        (2, 1, "INSERT INTO t (a) SELECT x FROM u", "e"), (3, None, "INSERT INTO t (b) SELECT y || z FROM u", "d"), (4, 0, "INSERT INTO t (b) SELECT y || z FROM u", "d"), (8, 9, nested, "d"), (9, 8, nested, "d"),
        (10, 1, None, "d"), (11, 1, "SELECT 1", "d"), (12, 1, "INSERT INTO t SELECT * FROM v", None), (13, 0, "INSERT INTO t (a) SELECT q.* FROM (SELECT * FROM v) q", "d"),
    ]
    log = spark.createDataFrame(rows, "query_id long, n int, sql_text string, default_database string").withColumn("start_time", F.timestamp_seconds("n"))
    for some in (log, log.filter("false")):
        all_rows, few = (sorted(map(tuple, extract.first_of_each(extract.edge_rows(f(some))).collect())) for f in (extract.extract_log, extract.extract_earliest))
        assert few == all_rows
    first = {(r["src"], r["tgt"]): r["query_id"] for r in extract.first_of_each(extract.edge_rows(extract.extract_earliest(log))).collect()}
    assert first[("d.u.x", "d.t.a")] == 6 and first[("e.u.x", "e.t.a")] == 2 and first[("d.u.z", "d.t.b")] == 3 and first[("d.u.y", "d.t.b")] == 3


def test_edges_through_three_levels_of_stars_beside_a_star_of_an_unknown_table(spark):
    texts = ["INSERT INTO t (a, b) SELECT * FROM (SELECT * FROM (SELECT u.x, u.y FROM u) p) q", "INSERT INTO t (a) SELECT q.* FROM (SELECT * FROM v) q"]
    log = spark.createDataFrame([(k, x, "d") for k, x in enumerate(texts)], "query_id long, sql_text string, default_database string")
    got = {r["query_id"]: (r["status"], sorted((e["source"], e["source_column"], e["target_column"]) for e in r["edges"])) for r in extract.extract_log(log).collect()}
    assert got[0] == ("ok", [("d.u", "x", "a"), ("d.u", "y", "b")]) and got[1] == ("fallback", [])


def test_entry_imports_without_the_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['lodeweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_generated_graphs_by_loops(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    for nodes in (0, 1, 2, 3, 10, 30):
        layers = max(2, int(nodes**0.5))
        per = max(1, -(-nodes // layers))
        levels = [list(range(k, min(k + per, nodes))) for k in range(0, nodes, per)]
        name = lambda x, per=per: f"benchmark_db.TABLE_{x}.col_{x // per}_{x % per}"
        want = []
        for here, there in zip(levels, levels[1:]):
            for k, x in enumerate(here):
                want.append((name(x), name(there[k % len(there)]), graph.CROSS_TYPES[k % 4]))
                if k % 3 == 0 and len(there) > 1:
                    want.append((name(x), name(there[(k + 1) % len(there)]), "DERIVED"))
        assert rows(graph.square_edges(spark, nodes)) == sorted(want)
    assert [graph.depth_breadth_edges(spark, d, b).count() for d, b in ((0, 3), (1, 3), (3, 0), (3, 1), (3, 3))] == [0, 0, 0, 2, 8]
    assert rows(graph.single_database_edges(spark, 6)) == [("single_db.FACT_0.field_0", "single_db.FACT_0.field_1", "DERIVED"), ("single_db.FACT_0.field_0", "single_db.FACT_1.field_0", "DIRECT")]
    assert graph.single_database_edges(spark, 6, columns=1).count() == 5 and graph.single_database_edges(spark, 5).count() == 0


def test_access_and_modes_of_loading(spark, tmp_path):
    ok, message = ingest.accessible(spark, str(tmp_path / "none"))
    assert not ok and "fixture mappings" in message
    folder, frame = str(tmp_path / "catalog"), lambda rows: spark.createDataFrame(rows, "provenance_id string, v long")
    tables = {"column_provenance": frame([("a", 1), ("a", 1), ("b", 2)])}
    load = lambda rows, **how: [tuple(r) for r in ingest.populate(spark, folder, {"column_provenance": frame(rows)}, provenance_only=True, **how).collect()]
    assert ingest.clear(spark, folder) == [] and load([("a", 1)], dry_run=True) == [("column_provenance", 1)] and ingest.stored(spark, folder, "column_provenance") is None
    assert [tuple(r) for r in ingest.populate(spark, folder, tables, provenance_only=True).collect()] == [("column_provenance", 2)]
    assert load([("b", 9), ("c", 3)], skip_clear=True, dry_run=True) == load([("b", 9), ("c", 3)], skip_clear=True) == [("column_provenance", 1)]
    assert sorted(map(tuple, ingest.stored(spark, folder, "column_provenance").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert load([("z", 0)]) == [("column_provenance", 1)] and ingest.clear(spark, folder) == ["column_provenance"]
    assert ingest.stored(spark, folder, "column_provenance").columns == ["provenance_id", "v"] and ingest.stored(spark, folder, "column_provenance").count() == 0
    assert ingest.accessible(spark, f"{folder}/column_provenance") == (True, "access confirmed")


def test_calls_of_the_catalog(spark):
    tables = Frames(spark, SF_DIR)
    catalog, search, paths = api.Catalog(tables), api.Search(tables), api.Provenance(tables)
    ns = catalog.namespaces().first()["namespace_id"]
    assert catalog.namespace(ns).count() == 1 and catalog.namespace("none").count() == 0
    assert catalog.datasets(ns, limit=3).count() == min(3, tables.dataset.filter(F.col("namespace_id") == ns).count())
    one = tables.field.join(tables.dataset, "dataset_id").select("dataset_id", "name").orderBy("name").first()
    by_id, by_name = (catalog.dataset(x).collect() for x in one)
    assert by_id == by_name and [r["ordinal_position"] for r in by_id] == sorted(r["ordinal_position"] for r in by_id)
    assert catalog.ddl(one["name"]).first()["ddl"].startswith("CREATE ") and catalog.ddl("none").count() == 0
    stats = spark.createDataFrame([(one["dataset_id"], 5, 7), (one["dataset_id"], 9, 1)], "dataset_id string, row_count long, perm long")
    assert catalog.statistics(one["name"], stats).first()["row_count"] == 9
    assert search.datasets("t1", 2).count() == min(2, serve.search(tables.dataset, "t1").count())
    found = search.unified("t1", 2).collect()
    assert sum(r["matches"] for r in found if r["kind"] == "database") == search.datasets("t1", 10**6).count()
    assert {r["asset_type"] for r in search.assets("p1", ("column",)).collect()} == {"column"}
    with pytest.raises(ValueError):
        search.assets("p")
    edge = traverse.active(tables.edges).orderBy("provenance_id").first()
    down = {r["node"] for r in paths.downstream(edge["src"], 2).collect()}
    assert edge["tgt"] in down and edge["src"] in {r["node"] for r in paths.upstream(edge["tgt"], 1).collect()}
    assert {r["node"] for r in paths.impact(edge["src"], 2).collect()} == down
    field = {(r["direction"], r["provenance_id"]) for r in paths.field(edge["source_dataset"], edge["source_field"], max_depth=2).collect()}
    table = {(r["direction"], r["provenance_id"]) for r in paths.table(edge["source_dataset"], max_depth=2).collect()}
    assert ("downstream", edge["provenance_id"]) in field and field <= table
    assert edge["provenance_id"] in {r["provenance_id"] for r in paths.database(edge["source_dataset"].split(".")[0]).collect()}
    assert [(r["src"], r["tgt"]) for r in api.statement_edges(spark, "INSERT INTO t (a) SELECT x FROM u", "db").collect()] == [("db.u.x", "db.t.a")]


@pytest.mark.parametrize("way, key", [("downstream", "src"), ("upstream", "tgt")])
def test_levels_of_a_walk_do_not_move_the_edges(spark, way, key):
    """With a level too large to be broadcast, only the level is shuffled: the bucketed edges are read where they lie."""
    from lodeweave.sources.catalog_views import Frames
    from lodeweave.sources.scratch import cut

    frames = Frames(spark, SF_DIR)
    edges = traverse.active(frames.toward(way))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        level, _ = cut(edges.select(F.col(key).alias("at")), after=None)
        joined = edges.join(level, F.col(key) == F.col("at"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(at" in plan and "Bucketed: true" in plan
    frames.release()
    assert frames.toward(way).count() > 0  # written anew


def test_odd_texts_of_statements_are_read_without_an_error(spark):
    """Very long literals, lists and comments, deep nesting, brackets that do not match, and texts that are no statements."""
    deep = "INSERT INTO t (a) SELECT x FROM " + "(SELECT x FROM " * 12 + "u" + ") q" * 12
    texts = {
        "INSERT INTO t (a) SELECT '" + "x" * 100_000 + "' || u.c FROM u u": ("ok", {"u.c>a"}),
        "INSERT INTO t (a) SELECT u.c FROM u WHERE u.k IN (" + ", ".join(f"'v{i}'" for i in range(5000)) + ")": ("ok", {"u.c>a"}),
        "/* " + "c" * 50_000 + " */ INSERT INTO t (a) SELECT u.x FROM u -- " + "d" * 50_000: ("ok", {"u.x>a"}),
        "INSERT INTO t (a) SELECT " + "(" * 100 + "u.x" + ")" * 100 + " FROM u": ("ok", {"u.x>a"}),
        deep: ("ok", {"u.x>a"}),
        "(" * 500: ("failed", set()), "SELECT " * 500: ("failed", set()), ")(": ("failed", set()),
        "INSERT INTO t (a) SELECT x FROM (SELECT y FROM u": ("fallback", set()),
        "INSERT INTO t (a) SELECT q.x FROM (SELECT y FROM u) q": ("fallback", set()),
    }
    log = spark.createDataFrame([(k, t, "d") for k, t in enumerate(texts)], "query_id long, sql_text string, default_database string")
    got = {r["sql_text"]: (r["status"], {f"{e['source'].removeprefix('d.')}.{e['source_column']}>{e['target_column']}" for e in r["edges"]}) for r in extract.extract_log(log).collect()}
    assert {t[:60]: r for t, r in got.items()} == {t[:60]: r for t, r in texts.items()}
