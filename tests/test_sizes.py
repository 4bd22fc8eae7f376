"""What the steps of queries move, read from plans and tables, and rows that only odd tables have."""

from __future__ import annotations

import glob
import hashlib
import os
import shutil

import pytest
from harness import SF_DIR, difference
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.plans import registry
from lodeweave.sources.catalog_views import Frames


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """The smallest tables with line items that lack a part, a supplier, a price's discount or a flag."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        if not path.endswith("lineitem.parquet"):
            shutil.copy(path, folder)
    alone = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_linenumber")) == 1  # so that no order is left open
    li = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").withColumn("alone", alone)
    lacks = lambda c, k: F.when(~F.col("alone") | (F.col("l_partkey") % 11 != k), F.col(c)).alias(c)
    odd = {"l_suppkey": 1, "l_discount": 2, "l_returnflag": 3, "l_linestatus": 4}
    out = li.select(*[lacks(c, odd[c]) if c in odd else F.when(~F.col("alone") | (F.col("l_orderkey") % 5 != 1), F.col(c)).alias(c) if c == "l_partkey" else F.col(c) for c in li.columns if c != "alone"])
    out.coalesce(1).write.parquet(f"{folder}/written")
    os.rename(glob.glob(f"{folder}/written/*.parquet")[0], f"{folder}/lineitem.parquet")
    yield folder
    Frames(spark, folder).release()


@pytest.mark.parametrize("name", ["edge_table", "confidence_range", "edge_styles", "integrity_active_flags"])
def test_edges_of_odd_line_items(spark, odd_tables, name):
    assert difference(registry.QUERIES[name](spark, odd_tables), registry.ORACLES[name], odd_tables) is None


def test_edges_are_moved_twice_and_stored_without_what_their_ends_tell(spark):
    frames = Frames(spark, SF_DIR)
    build = plan(frames._edges(8))
    assert build.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in build and "SortMergeJoin" not in build
    frames.release()
    rows = frames.edges
    stored = spark.table(f"edges_src_{hashlib.md5(SF_DIR.encode()).hexdigest()[:12]}")
    assert "provenance_id" not in stored.columns and stored.filter("source_dataset is not null or target_field is not null").count() == 0
    assert rows.filter("source_dataset || '.' || source_field <> src or target_dataset || '.' || target_field <> tgt or source_dataset is null").count() == 0


def test_filters_of_the_edge_table_come_before_its_joins(spark):
    """Rows that the filter leaves out are in no exchange: the filter stands below both joins."""
    lines = registry.QUERIES["edge_table_filter"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: [len(x) - len(x.lstrip(" :+-")) for x in lines if word in x]
    assert min(depth("Contains(lower(")) > sorted(depth("Join LeftOuter"))[1]


def test_an_expansion_moves_levels_and_not_the_edges(spark):
    from lodeweave.operators import graph, traverse

    frames, kept = Frames(spark, SF_DIR), {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        way = registry.QUERIES["database_provenance_expanded"](spark, SF_DIR)
        moved = [x for x in plan(way).splitlines() if "Exchange hashpartitioning" in x]
        assert plan(way).count("Bucketed: true") >= 2 and not [x for x in moved if "(src" in x or "(tgt" in x]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    same = graph.expand_database(traverse.active(frames.edges), "NATION_18", max_depth=2)
    two = graph.expand_database(traverse.active(frames.edges), "NATION_18", max_depth=2, by_target=traverse.active(frames.edges_by_target))
    assert sorted(same.collect()) == sorted(two.collect()) and graph.expand_database(frames.edges, "NATION_18", max_depth=0).count() == 0


def test_a_closure_carries_no_names_of_tables(spark, monkeypatch):
    from lodeweave.operators import traverse

    columns, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df, **kw: columns.append(set(df.columns)) or cut(df, **kw))
    registry.QUERIES["closure_max_depth"](spark, SF_DIR)
    assert len(columns) == 4 and not set.union(*columns) & {"source_dataset", "target_field", "transformation_type"}


def test_a_search_over_joined_parts_indexes_values_and_not_texts(spark, monkeypatch, tmp_path):
    from lodeweave.operators import trigrams

    rows = [("A.T1", "Id_one"), ("A.T1", "two"), ("B.one", "P1"), ("B.one", "one"), (None, "Lone"), ("C.T9", None), ("C.T9", "P"), (None, None)]
    texts = spark.createDataFrame(rows, "name string, field_name string")
    folder = str(tmp_path / "parts")
    trigrams.build_parts({c: texts.select(c) for c in texts.columns}, folder)
    for sought in ("one", "ONE.", "t1.id_", "ne.p1", "b.one.one", "t9.p", ".p", "p1", "e", "nowhere", "A.T1.two", "x.y"):
        want = [r for r in rows if sought.lower() in ".".join(x for x in r if x is not None).lower()]
        assert sorted(map(repr, map(tuple, trigrams.search_parts(texts, ["name", "field_name"], folder, sought).collect()))) == sorted(map(repr, want)), sought
    indexed, build = [], trigrams.build
    monkeypatch.setattr(trigrams, "build", lambda texts, *rest: indexed.append(texts.count()) or build(texts, *rest))
    frames = Frames(spark, SF_DIR)
    registry.QUERIES["graph_search_indexed"](spark, SF_DIR).count()
    assert sum(indexed) == frames.dataset.count() + frames.field.select("field_name").distinct().count() < frames.field.count()


def test_a_repeated_load_moves_keys_and_adds_no_null_key_again(spark, monkeypatch, tmp_path, odd_tables):
    from lodeweave.operators import ingest

    moved, cut = [], ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda df, **kw: moved.append(df.columns) or cut(df, **kw))
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "provenance_id string, v int")
    load = lambda df, **how: ingest.populate(spark, str(tmp_path / "c"), {"column_provenance": df}, provenance_only=True, **how).first()["row_count"]
    assert load(rows.filter("v = 1")) == 1 and load(rows, skip_clear=True, dry_run=True) == 2
    assert load(rows, skip_clear=True) == 2 and load(rows, skip_clear=True) == 0 and load(rows.union(rows), skip_clear=True) == 0
    assert moved == [["provenance_id"]] * 4 and load(rows.union(rows)) == 3
    assert difference(registry.QUERIES["populate_modes"](spark, odd_tables), registry.ORACLES["populate_modes"], odd_tables) is None


@pytest.fixture(scope="module", params=["numbered over 7", "repeated"])
def odd_sales(request, spark, tmp_path_factory):
    """The smallest tables with lines numbered over 7, or with orders and customers that repeat; and orders of no customer."""
    folder, over = str(tmp_path_factory.mktemp("sales")), request.param != "repeated"
    lost = lambda x: x.withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")))
    odd = {
        "lineitem": lambda x: x.withColumn("l_linenumber", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_linenumber") + (9 if over else 0)).otherwise(F.col("l_linenumber")).cast("int")),
        "orders": lambda x: lost(x if over else x.union(x.filter("o_orderkey % 4 = 0"))), "customer": lambda x: x if over else x.union(x.filter("c_custkey % 3 = 0")),
    }
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[:-8]
        if name not in odd:
            shutil.copy(path, folder)
            continue
        odd[name](spark.read.parquet(path)).coalesce(1).write.parquet(f"{folder}/written-{name}")
        os.rename(glob.glob(f"{folder}/written-{name}/*.parquet")[0], f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["etl_fact_daily", "etl_rpt_monthly", "etl_fact_sales", "etl_stg_sales"])
def test_sums_of_odd_sales(spark, odd_sales, name):
    assert difference(registry.QUERIES[name](spark, odd_sales), registry.ORACLES[name], odd_sales) is None


def test_sums_move_no_numbered_sales_and_numbers_are_given_where_orders_meet_lines(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        moved = lambda name: [x.split("hashpartitioning(")[1].split("), ")[0] for x in plan(registry.QUERIES[name](spark, SF_DIR)).splitlines() if "Exchange hashpartitioning" in x]
        sales, daily, monthly = moved("etl_fact_sales"), moved("etl_fact_daily"), moved("etl_rpt_monthly")
        wide = [x for x in plan(registry.QUERIES["etl_fact_sales"](spark, SF_DIR)).splitlines() if "Window [row_number()" in x and "transaction_id" in x]
        assert wide and all("[o_orderkey" in x for x in wide) and not [x for x in sales if x.startswith("transaction_id")]
        assert not [x for x in daily if x.startswith("date_sk")] and not [x for x in monthly if "product_sk" in x]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_parts_of_fields_grow_with_the_line_items(spark, monkeypatch):
    from lodeweave.sources import catalog_views

    monkeypatch.setattr(catalog_views, "BUCKET_ROWS", 200)
    rows = registry.QUERIES["catalog_fields"](spark, SF_DIR)
    parts = -(-Frames(spark, SF_DIR).table("lineitem").count() // 200)
    moved = [x for x in plan(rows).splitlines() if "Exchange hashpartitioning" in x]
    assert parts > 8 and sum(f", {parts})" in x for x in moved) >= 4, moved
    assert not [x for x in moved if "field_id" in x and f", {parts})" not in x]
    assert difference(rows, registry.ORACLES["catalog_fields"]) is None


CATALOG = {"db.U": ["X", "y", "k"], "db.v": ["y", "z"]}
PLACED = {
    "INSERT INTO t (a, b) SELECT x, z FROM u JOIN v ON u.k = v.y": {"db.U.X>db.t.a", "db.v.z>db.t.b"},
    "INSERT INTO t (a, b) SELECT y, Z FROM u, v": {"db.v.Z>db.t.b"},
    "INSERT INTO t (a, b, c, d) SELECT u.*, z FROM u JOIN v ON 1 = 1": {"db.u.X>db.t.a", "db.u.y>db.t.b", "db.u.k>db.t.c", "db.v.z>db.t.d"},
    "INSERT INTO t (a, b, c) SELECT z, w.* FROM u JOIN v w ON 1 = 1": {"db.v.z>db.t.a", "db.v.y>db.t.b", "db.v.z>db.t.c"},
    "INSERT INTO t (a, b, c, d) SELECT n.*, p.z, u.k FROM none n, v p, u": set(),
    "INSERT INTO t (a) SELECT (SELECT MAX(z) FROM v WHERE v.y = u.y) FROM u": {"db.v.z>db.t.a"},
    "INSERT INTO t (a, b) SELECT q.y, q.k FROM (SELECT * FROM u) q": {"db.u.y>db.t.a", "db.u.k>db.t.b"},
}


def test_lists_of_columns_go_on_only_where_a_star_reads_them(spark, monkeypatch):
    """Edges are the same by a catalog's rows and by its lists; a table's list stays whole behind a star, and no item of a list carries it."""
    from lodeweave.operators import extract, scopes

    log = spark.createDataFrame([(k, None, "db", text) for k, text in enumerate(PLACED)], "query_id long, start_time timestamp, default_database string, sql_text string")
    lists = spark.createDataFrame(list(CATALOG.items()), "name string, cols array<string>")
    each = spark.createDataFrame([(t, c, k) for t, cols in CATALOG.items() for k, c in enumerate(cols)], "name string, field_name string, ordinal_position int")
    kept, carried, cut, edges = [], [], scopes.cut, scopes._edges
    monkeypatch.setattr(scopes, "cut", lambda df, **kw: (kept.append(df.collect()) if {"no", "cols"} <= set(df.columns) else None) or cut(df, **kw))
    monkeypatch.setattr(scopes, "_edges", lambda rows: carried.append(plan(edges(rows))) or edges(rows))
    found = {}
    for fields in (lists, each):
        rows = extract.extract_log(log, fields=fields).select("sql_text", "edges").collect()
        for r in rows:
            found.setdefault(r["sql_text"], []).append({f"{e['source']}.{e['source_column']}>db.t.{e['target_column']}" for e in r["edges"]})
    lower = lambda x: {y.lower() for y in x}
    assert {k: [lower(x) for x in v] for k, v in found.items()} == {k: [lower(v)] * 2 for k, v in PLACED.items()}
    sizes = sorted(len(r["cols"]) for r in kept[0] if r["cols"] is not None)
    assert sizes == sorted([3, 2, 1, 2, 3, 1, 0, 2, 1, 1, 2, 0, 3]), sizes
    generated = [x.split("Generate explode(")[1] for x in carried[0].splitlines() if "Generate explode(" in x]
    assert generated and not [x for x in generated if "entries#" in x.rsplit("], false, [", 1)[0].rsplit(", [", 1)[-1]]


def test_catalog_pairs_are_read_from_written_tables(spark):
    from lodeweave.plans import extraction

    pairs, tables = extraction._catalog_pairs(spark, SF_DIR)
    assert "lineitem" not in plan(pairs) + plan(tables) and tables.columns == ["name", "cols"]
    assert tables.selectExpr("sum(size(cols))").first()[0] == Frames(spark, SF_DIR).field.count()
