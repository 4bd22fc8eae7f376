"""Weak and strong components and layers against plain Python."""

from __future__ import annotations

import random

import pytest

from lodeweave.operators import components, graph


def plain(edges):
    """node -> (weak component, strong component, layer)."""
    nodes = {x for e in edges for x in e}
    after = {n: {b for a, b in edges if a == n} for n in nodes}

    def reached(n, steps):
        seen, todo = set(), [n]
        while todo:
            for m in steps[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    both = {n: after[n] | {a for a, b in edges if b == n} for n in nodes}
    leads = {n: reached(n, after) for n in nodes}
    strong = {n: min({n} | {m for m in leads[n] if n in leads[m]}) for n in nodes}
    steps = {(strong[a], strong[b]) for a, b in edges if strong[a] != strong[b]}
    layer = dict.fromkeys(strong.values(), 0)
    for _ in layer:
        for a, b in steps:
            layer[b] = max(layer[b], layer[a] + 1)
    return {n: (min({n} | reached(n, both)), strong[n], layer[strong[n]]) for n in nodes}


CASES = {
    "chain": [(f"n{i}", f"n{i + 1}") for i in range(45)],
    "cycle with tails": [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("w", "x"), ("c", "p"), ("p", "q"), ("w", "q")],
    "two cycles and a bridge": [("a", "b"), ("b", "a"), ("b", "m"), ("m", "k"), ("k", "z"), ("z", "k"), ("a", "z"), ("q", "q"), ("a", "b")],
    "dense": [(f"v{random.Random(1000 + i).randrange(30)}", f"v{random.Random(2000 + i).randrange(30)}") for i in range(90)],
    "sparse": [(f"v{random.Random(3000 + i).randrange(60)}", f"v{random.Random(4000 + i).randrange(60)}") for i in range(55)],
}


@pytest.mark.parametrize("name", CASES)
def test_components_and_layers(spark, name):
    edges = CASES[name]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, tgt string, node int")
    want = plain(edges)
    assert {r["node"]: r["component"] for r in components.weak_components(df).collect()} == {n: x[0] for n, x in want.items()}
    assert {r["node"]: (r["component"], r["layer"]) for r in components.layers(df).collect()} == {n: x[1:] for n, x in want.items()}


def test_no_edges_and_null_ends(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), (None, None)], "src string, tgt string")
    assert components.weak_components(df).collect() == [] and components.layers(df).collect() == []
    assert graph.weak_component(df, spark.createDataFrame([("r",)], "root string")).collect() == [("r", "r")]


def test_long_chains_take_few_rounds(spark):
    n = 100_000
    place = lambda x: f"lpad(conv(hash({x}), 10, 16), 8, '0') || {x}"  # noqa: E731  (names in no order)
    chain = spark.range(n).selectExpr(f"{place('id')} AS src", f"{place('(id + 1)')} AS tgt")
    found, rounds = components.star_rounds(chain)
    row = found.selectExpr("count(*) AS n", "count(DISTINCT component) AS c", "min(node) = min(component) AS least").first()
    assert (row["n"], row["c"], row["least"]) == (n + 1, 1, True) and rounds < 25


def test_rounds_leave_less_and_less_to_move(spark, monkeypatch):
    """All that the rounds write of a chain's links is a few times the chain; each round leaves a share of the one before."""
    sizes, cut = [], components.cut

    def counted(df, **kw):
        out, n = cut(df, **kw)
        if set(df.columns) == {"u", "v"}:
            sizes.append(out.count())
        return out, n

    monkeypatch.setattr(components, "cut", counted)
    chain = spark.range(20_000).selectExpr("lpad(id, 6, '0') AS src", "lpad(id + 1, 6, '0') AS tgt")
    components.star_rounds(chain)[0].count()
    assert sum(sizes) < 3 * 20_000


def test_nodes_of_equal_hashes_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(components, "_hashed", lambda node, salt: F.xxhash64(F.lit(salt), F.substring(node, 1, 1) if salt < 2 else F.col(node) if isinstance(node, str) else node))
    df = spark.createDataFrame([("a1", "b1"), ("a2", "c2"), ("d", "d")], "src string, tgt string")
    assert {r["node"]: r["component"] for r in components.weak_components(df).collect()} == {"a1": "a1", "b1": "a1", "a2": "a2", "c2": "a2", "d": "d"}


@pytest.mark.parametrize("name", ["cycle with tails", "two cycles and a bridge"])
def test_layers_of_written_levels(spark, monkeypatch, name):
    """The same where every level is written, in buckets of its nodes or not."""
    from lodeweave.sources import scratch

    monkeypatch.setattr(scratch, "LOCAL_ROWS", 0)
    edges = CASES[name]
    df = spark.createDataFrame(edges, "src string, tgt string")
    assert {r["node"]: (r["component"], r["layer"]) for r in components.layers(df, parts=3).collect()} == {n: x[1:] for n, x in plain(edges).items()}


def test_peeling_moves_levels_and_not_the_edges(spark, monkeypatch):
    """Edges in buckets are in no exchange but that of what they lose, and no number is stored for nodes that one edge leads to."""
    parts, plans, stored, cut = 8, [], [], components.cut
    edges = spark.range(30_000).selectExpr("lpad(id, 6, '0') AS src", "lpad(id + IF(id % 3 = 2, 40000, 10000), 6, '0') AS tgt").repartition(parts, "src")
    edges, _ = cut(edges, by="src", parts=parts, after=None)

    def planned(df, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out, n = cut(df, **kw)
        if kw.get("by") == "node":
            stored.append(out.filter("degree is not null").count())
        return out, n

    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    monkeypatch.setattr(components, "cut", planned)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = components.layers(edges, distinct=True, parts=parts)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert stored == [0] and found.filter("layer > 0").count() == 30_000
    assert all(p.count("Bucketed: true") >= 2 and p.count("Exchange hashpartitioning") <= 2 for p in plans[1:]), plans[1]
