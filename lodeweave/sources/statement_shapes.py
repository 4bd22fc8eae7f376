"""Shapes of logged statements with nested queries, and what each must give, written by hand.

``{u}`` stands for a number. Edges: source > target and D (direct), C (calculation) or A (aggregation). A shape without edges is a
fallback by its tables, or failed without them.
"""

from __future__ import annotations

KINDS = {"D": "DIRECT", "C": "CALCULATION", "A": "AGGREGATION"}
#: (statement type, text, target, edges, tables that are read)
SHAPES: list[tuple[str, str, str | None, str, str]] = [
    # Subqueries in FROM.
    ("Insert", "INSERT INTO mart.a{u} (x) SELECT q.k FROM (SELECT s.id AS k FROM src.c{u} s) q", "mart.a{u}", "src.c{u}.id > mart.a{u}.x D", "src.c{u}"),
    ("Insert", "INSERT INTO mart.a{u} (x, y) SELECT q.k, q.n FROM (SELECT s.id k, s.first || s.last n FROM src.c{u} s WHERE s.id > 0) AS q", "mart.a{u}", "src.c{u}.id > mart.a{u}.x D; src.c{u}.first > mart.a{u}.y C; src.c{u}.last > mart.a{u}.y C", "src.c{u}"),
    ("Insert", "INSERT INTO mart.a{u} (x) SELECT SUM(q.k) FROM (SELECT r.k FROM (SELECT o.amount AS k FROM src.o{u} o) r) q", "mart.a{u}", "src.o{u}.amount > mart.a{u}.x A", "src.o{u}"),
    ("Insert", "INSERT INTO mart.a{u} (x, y) SELECT * FROM (SELECT id, last FROM src.c{u}) q", "mart.a{u}", "src.c{u}.id > mart.a{u}.x D; src.c{u}.last > mart.a{u}.y D", "src.c{u}"),
    ("Insert", "INSERT INTO mart.a{u} (x, y, z) SELECT q.*, o.amount FROM (SELECT id, last FROM src.c{u}) q JOIN src.o{u} o ON o.id = q.id", "mart.a{u}", "src.c{u}.id > mart.a{u}.x D; src.c{u}.last > mart.a{u}.y D; src.o{u}.amount > mart.a{u}.z D", "src.c{u}; src.o{u}"),
    ("Insert", "INSERT INTO mart.a{u} (x, y) SELECT p, n FROM (SELECT id, last FROM src.c{u}) q (p, n)", "mart.a{u}", "src.c{u}.id > mart.a{u}.x D; src.c{u}.last > mart.a{u}.y D", "src.c{u}"),
    ("Insert", "INSERT INTO mart.a{u} (x) SELECT q.k FROM (SELECT id AS k FROM src.c{u} UNION ALL SELECT o.id FROM src.o{u} o) q", "mart.a{u}", "src.c{u}.id > mart.a{u}.x D; src.o{u}.id > mart.a{u}.x D", "src.c{u}; src.o{u}"),
    ("Insert", "INSERT INTO mart.a{u} (x) (SELECT c.id FROM src.c{u} c) UNION (SELECT o.id FROM src.o{u} o)", "mart.a{u}", "src.c{u}.id > mart.a{u}.x D; src.o{u}.id > mart.a{u}.x D", "src.c{u}; src.o{u}"),
    ("Insert", "INSERT INTO mart.a{u} (x) SELECT a.id FROM (src.c{u} a JOIN src.o{u} b ON a.id = COALESCE(b.id, b.cust)) WHERE b.amount > 1", "mart.a{u}", "src.c{u}.id > mart.a{u}.x D", "src.c{u}; src.o{u}"),
    # WITH lists.
    ("Insert", "INSERT INTO mart.b{u} (x) WITH c AS (SELECT id FROM src.c{u}) SELECT c.id FROM c", "mart.b{u}", "src.c{u}.id > mart.b{u}.x D", "src.c{u}"),
    ("Insert", "INSERT INTO mart.b{u} (x, y) WITH c AS (SELECT id, last FROM src.c{u}), d AS (SELECT c.id AS i, UPPER(c.last) AS l FROM c) SELECT d.i, d.l FROM d", "mart.b{u}", "src.c{u}.id > mart.b{u}.x D; src.c{u}.last > mart.b{u}.y C", "src.c{u}"),
    ("Insert", "INSERT INTO mart.b{u} (x) WITH c (k, v) AS (SELECT id, amount FROM src.o{u}) SELECT MAX(v) FROM c GROUP BY k", "mart.b{u}", "src.o{u}.amount > mart.b{u}.x A", "src.o{u}"),
    ("Create View", "CREATE VIEW rpt.b{u} AS WITH c AS (SELECT id AS k, amount FROM src.o{u}) SELECT c.k, SUM(c.amount) AS total FROM c GROUP BY c.k", "rpt.b{u}", "src.o{u}.id > rpt.b{u}.k D; src.o{u}.amount > rpt.b{u}.total A", "src.o{u}"),
    ("Insert", "INSERT INTO mart.b{u} (x) WITH RECURSIVE tree (node, up) AS (SELECT n.id, n.parent FROM src.n{u} n UNION ALL SELECT n.id, tree.up FROM src.n{u} n JOIN tree ON n.parent = tree.node) SELECT tree.up FROM tree", "mart.b{u}", "src.n{u}.parent > mart.b{u}.x D", "src.n{u}"),
    ("Insert", "INSERT INTO mart.b{u} (x) WITH c AS (SELECT * FROM (SELECT o.amount a1, o.id a2 FROM src.o{u} o) z) SELECT a2 FROM c", "mart.b{u}", "src.o{u}.id > mart.b{u}.x D", "src.o{u}"),
    ("Insert", "INSERT INTO mart.b{u} (x) SELECT w.v FROM (WITH c AS (SELECT o.amount AS v FROM src.o{u} o) SELECT v FROM c) w", "mart.b{u}", "src.o{u}.amount > mart.b{u}.x D", "src.o{u}"),
    ("Insert", "INSERT INTO mart.b{u} (x, y) WITH c AS (SELECT id FROM src.c{u}), o AS (SELECT id, amount FROM src.o{u}) SELECT c.id, amount * 2 FROM c JOIN o ON c.id = o.id", "mart.b{u}", "src.c{u}.id > mart.b{u}.x D; src.o{u}.amount > mart.b{u}.y C", "src.c{u}; src.o{u}"),
    # Scalar subqueries and predicates.
    ("Insert", "INSERT INTO mart.s{u} (x, y) SELECT (SELECT MAX(o.amount) FROM src.o{u} o), c.id FROM src.c{u} c", "mart.s{u}", "src.o{u}.amount > mart.s{u}.x A; src.c{u}.id > mart.s{u}.y D", "src.c{u}; src.o{u}"),
    ("Insert", "INSERT INTO mart.s{u} (x) SELECT c.id + (SELECT MIN(o.id) FROM src.o{u} o WHERE o.id = c.id) FROM src.c{u} c", "mart.s{u}", "src.c{u}.id > mart.s{u}.x C; src.o{u}.id > mart.s{u}.x A", "src.c{u}; src.o{u}"),
    ("Insert", "INSERT INTO mart.s{u} (x) SELECT (SELECT c.last FROM src.n{u} n WHERE n.id = c.id) FROM src.c{u} c", "mart.s{u}", "src.c{u}.last > mart.s{u}.x D", "src.c{u}; src.n{u}"),
    ("Insert", "INSERT INTO mart.s{u} (x) SELECT CASE WHEN EXISTS (SELECT 1 FROM src.o{u} o WHERE o.id = c.id) THEN c.last ELSE 'none' END FROM src.c{u} c", "mart.s{u}", "src.c{u}.last > mart.s{u}.x C", "src.c{u}; src.o{u}"),
    ("Insert", "INSERT INTO mart.s{u} (x) SELECT c.id FROM src.c{u} c WHERE c.id IN (SELECT o.id FROM src.o{u} o) AND c.last NOT IN ('a', 'b')", "mart.s{u}", "src.c{u}.id > mart.s{u}.x D", "src.c{u}; src.o{u}"),
    # Words of expressions that are no columns.
    ("Insert", "INSERT INTO mart.w{u} (x) SELECT CAST(c.id AS BYTEINT) FROM src.c{u} c", "mart.w{u}", "src.c{u}.id > mart.w{u}.x C", "src.c{u}"),
    ("Insert", "INSERT INTO mart.w{u} (x) SELECT CAST(CAST(c.id AS DECIMAL(10,2)) AS DOUBLE PRECISION) AS v FROM src.c{u} c", "mart.w{u}", "src.c{u}.id > mart.w{u}.x C", "src.c{u}"),
    ("Insert", "INSERT INTO mart.w{u} (x) SELECT c.born (FORMAT 'YYYY-MM-DD') FROM src.c{u} c", "mart.w{u}", "src.c{u}.born > mart.w{u}.x C", "src.c{u}"),
    ("Insert", "INSERT INTO mart.w{u} (x, y) SELECT c.id (DECIMAL(8,2)), USER FROM src.c{u} c", "mart.w{u}", "src.c{u}.id > mart.w{u}.x C", "src.c{u}"),
    ("Insert", "INSERT INTO mart.w{u} (x) SELECT ROW_NUMBER() OVER (PARTITION BY c.last ORDER BY c.born DESC NULLS LAST) FROM src.c{u} c", "mart.w{u}", "src.c{u}.last > mart.w{u}.x C; src.c{u}.born > mart.w{u}.x C", "src.c{u}"),
    ("Insert", "INSERT INTO mart.w{u} (x, y) SELECT CURRENT_DATE, EXTRACT(YEAR FROM c.born) FROM src.c{u} c", "mart.w{u}", "src.c{u}.born > mart.w{u}.y C", "src.c{u}"),
    ("Insert", "INSERT INTO mart.w{u} (x) SELECT c.born + INTERVAL '1' DAY FROM src.c{u} c", "mart.w{u}", "src.c{u}.born > mart.w{u}.x C", "src.c{u}"),
    # Other ways to say it.
    ("Insert", "INSERT mart.o{u} (x) SELECT c.id FROM src.c{u} c", "mart.o{u}", "src.c{u}.id > mart.o{u}.x D", "src.c{u}"),
    ("Insert", "INS INTO mart.o{u} (x) SEL TOP 10 c.id FROM src.c{u} c", "mart.o{u}", "src.c{u}.id > mart.o{u}.x D", "src.c{u}"),
    ("Create View", "REPLACE VIEW rpt.o{u} AS SELECT c.id, c.last AS l FROM src.c{u} c", "rpt.o{u}", "src.c{u}.id > rpt.o{u}.id D; src.c{u}.last > rpt.o{u}.l D", "src.c{u}"),
    ("Create View", "CREATE OR REPLACE VIEW rpt.o{u} (p, q) AS SELECT c.id, c.last FROM src.c{u} c WITH CHECK OPTION", "rpt.o{u}", "src.c{u}.id > rpt.o{u}.p D; src.c{u}.last > rpt.o{u}.q D", "src.c{u}"),
    ("Create Table", "CREATE MULTISET TABLE mart.k{u}, NO FALLBACK AS (SELECT c.id AS i FROM src.c{u} c) WITH DATA PRIMARY INDEX (i)", "mart.k{u}", "src.c{u}.id > mart.k{u}.i D", "src.c{u}"),
    ("Create Table", "CREATE TABLE mart.k{u} AS (WITH c AS (SELECT id i2 FROM src.c{u}) SELECT i2 FROM c) WITH NO DATA", "mart.k{u}", "src.c{u}.id > mart.k{u}.i2 D", "src.c{u}"),
    ("Merge Into", "MERGE INTO dim.m{u} m USING (SELECT o.id, SUM(o.amount) AS total FROM src.o{u} o GROUP BY o.id) s ON m.id = s.id WHEN MATCHED THEN UPDATE SET total = s.total WHEN NOT MATCHED THEN INSERT (id, total) VALUES (s.id, s.total)", "dim.m{u}", "src.o{u}.id > dim.m{u}.id D; src.o{u}.amount > dim.m{u}.total A", "src.o{u}"),
    ("Merge Into", "MERGE INTO dim.m{u} AS m USING src.c{u} s ON m.id = s.id WHEN NOT MATCHED THEN INSERT (id, nm) VALUES (s.id, TRIM(s.last)) WHEN MATCHED THEN UPDATE SET nm = s.first", "dim.m{u}", "src.c{u}.id > dim.m{u}.id D; src.c{u}.last > dim.m{u}.nm C; src.c{u}.first > dim.m{u}.nm D", "src.c{u}"),
    ("Update", "UPDATE dim.m{u} FROM (SELECT id, last FROM src.c{u}) s SET nm = s.last WHERE dim.m{u}.id = s.id", "dim.m{u}", "src.c{u}.last > dim.m{u}.nm D", "src.c{u}"),
    ("Update", "UPDATE dim.m{u} SET total = (SELECT SUM(o.amount) FROM src.o{u} o WHERE o.id = m{u}.id)", "dim.m{u}", "src.o{u}.amount > dim.m{u}.total A", "src.o{u}"),
    ("Update", "UPD dim.m{u} SET total = total + 1, nm = 'x, y' WHERE id > 3", "dim.m{u}", "dim.m{u}.total > dim.m{u}.total C", ""),
    # What can't be placed gives table edges only, or none.
    ("Insert", "INSERT INTO mart.z{u} (x, y) SELECT c.* FROM src.c{u} c", "mart.z{u}", "", "src.c{u}"),
    ("Insert", "INSERT INTO mart.z{u} (x, y, z) SELECT c.*, o.amount FROM src.c{u} c JOIN src.o{u} o ON c.id = o.id", "mart.z{u}", "", "src.c{u}; src.o{u}"),
    ("Insert", "INSERT INTO mart.z{u} (x, y) SELECT id, o.amount FROM src.c{u} c, src.o{u} o", "mart.z{u}", "src.o{u}.amount > mart.z{u}.y D", "src.c{u}; src.o{u}"),
    ("Insert", "INSERT INTO mart.z{u} VALUES (1, 'SELECT x FROM y')", "mart.z{u}", "", ""),
]

#: Columns that the conditions of a shape read, by its number: "source KIND". Shapes that are not named have none.
CONDITIONS: dict[int, str] = {
    1: "src.c{u}.id FILTER",
    4: "src.o{u}.id JOIN; src.c{u}.id JOIN",
    8: "src.c{u}.id JOIN; src.o{u}.id JOIN; src.o{u}.cust JOIN; src.o{u}.amount FILTER",
    13: "src.n{u}.parent JOIN; src.n{u}.id JOIN",
    16: "src.c{u}.id JOIN; src.o{u}.id JOIN",
    18: "src.o{u}.id FILTER; src.c{u}.id FILTER",
    19: "src.n{u}.id FILTER; src.c{u}.id FILTER",
    20: "src.o{u}.id FILTER; src.c{u}.id FILTER",
    21: "src.c{u}.id FILTER; src.o{u}.id FILTER; src.c{u}.last FILTER",
    35: "dim.m{u}.id JOIN; src.o{u}.id JOIN",
    36: "dim.m{u}.id JOIN; src.c{u}.id JOIN",
    37: "dim.m{u}.id FILTER; src.c{u}.id FILTER",
    38: "src.o{u}.id FILTER; dim.m{u}.id FILTER",
    39: "dim.m{u}.id FILTER",
    41: "src.c{u}.id JOIN; src.o{u}.id JOIN",
}
#: References without one owner, or behind a star of unknown width, by the shape's number.
UNRESOLVED: dict[int, int] = {41: 1, 42: 1}


def parts(text: str) -> list[str]:
    return [x for x in text.split("; ") if x]


def status(shape: tuple) -> str:
    return "ok" if shape[3] else "fallback" if shape[4] else "failed"


def edge_values() -> list[tuple[int, str, str, str]]:
    """(shape, source, target, kind) of every edge, table edges of the fallbacks too."""
    out = []
    for k, (_, _, target, edges, tables) in enumerate(SHAPES):
        for e in parts(edges):
            pair, _, kind = e.rpartition(" ")
            source, _, into = pair.partition(" > ")
            out.append((k, source, into, KINDS[kind]))
        out += [] if edges else [(k, f"{t}.*", f"{target}.*", "UNKNOWN") for t in parts(tables)]
    return out
