"""Column provenance through nested queries, by contraction of their scopes.

Brackets are taken away from the innermost outwards: what holds a SELECT becomes a scope with a number, other brackets stay
in its text. So each SELECT is one flat text that regular expressions cut into items, sources and conditions, and a row
of its own. A source is a table or another scope (a subquery in FROM or a name of a WITH list), with its columns if the
catalog or the scope itself tells them. Stars take as many places of a list as their sources have columns; a column
without qualifier belongs to the one source that has it. The edges between scopes are then contracted by joins until only
those from tables to the statement's target are left, each round over all statements at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.sources.scratch import cut

_OPEN, _CLOSE, _LEFT, _RIGHT = "", "", "", ""  # of a scope's number, and of brackets set aside
MARKS = _OPEN + _CLOSE + _LEFT + _RIGHT
ROOT = -1
_NAME = rf'("?[\w$]+"?(?:\."?[\w$]+"?)*|{_OPEN}\d+{_CLOSE})'
_BODY = rf"(?:WITH|SEL(?:ECT)?)\b.*?|{_OPEN}.*?"
_TARGET = r'("?[\w$]+"?(?:\."?[\w$]+"?)*)'
_MAKES = r"(?:CREATE\s+(?:OR\s+REPLACE\s+)?|REPLACE\s+)(?:(?:MULTISET|SET|VOLATILE|GLOBAL|TEMPORARY|RECURSIVE|MATERIALIZED)\s+)*(?:TABLE|VIEW)"
_INSERT = rf"(?is)^INS(?:ERT)?(?:\s+INTO)?\s+{_TARGET}\s*(?:\(([^()]*)\))?\s*({_BODY})$"
_CREATE = rf"(?is)^{_MAKES}\s+{_TARGET}\s*(?:\(([^()]*)\))?(?:\s*,[^()]*?)?\s+AS\s+({_BODY})(?:\s+WITH\s+(?:(?:NO\s+)?DATA|CHECK|NO\s+SCHEMA)\b.*)?$"
_MERGE = rf"(?is)^MERGE\s+INTO\s+{_TARGET}(?:\s+(?:AS\s+)?(?!USING\b)(\w+))?\s+USING\s+(.*?)\s+ON\s+(.*?)\s+(WHEN\b.*)$"
_UPDATE = rf"(?is)^UPD(?:ATE)?\s+{_TARGET}(?:\s+(?:AS\s+)?(?!SET\b|FROM\b)(\w+))?\s+(?:FROM\s+(.*?)\s+)?SET\s+(.*?)(?:\s+FROM\s+(.*?))?(?:\s+WHERE\s+(.*))?$"
_ANY_TARGET = rf"(?is)^(?:INS(?:ERT)?(?:\s+INTO)?|MERGE\s+INTO|UPD(?:ATE)?|{_MAKES})\s+{_TARGET}"
_CTE = rf'(?i)(?:\bWITH|,)\s+(?:RECURSIVE\s+)?"?(\w+)"?\s*(?:\(([^()]*)\))?\s+AS\s*{_OPEN}(\d+){_CLOSE}'
_SETS = r"(?i)\s+(?:UNION|MINUS|EXCEPT|INTERSECT)(?:\s+ALL|\s+DISTINCT)?\s+"
_JOINS = r"(?i)\s+(?:NATURAL\s+)?(?:(?:INNER|CROSS|(?:LEFT|RIGHT|FULL)(?:\s+OUTER)?)\s+)?JOIN\s+"
# Words that end a list of tables, and words that may not be an alias.
_ENDS = "WHERE|GROUP|ORDER|HAVING|QUALIFY|SAMPLE|WINDOW|LIMIT"
_STOP = f"{_ENDS}|ON|USING|SET|WHEN|AND|OR|AS|UNION|MINUS|EXCEPT|INTERSECT|WITH|FROM|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|NATURAL|THEN|ELSE|END|BETWEEN|LIKE|IS|IN|NOT"
_SOURCE = rf"(?is)^[\s(]*{_NAME}(?:\s+(?:AS\s+)?(?!(?:{_STOP})\b)\"?(\w+)\"?)?\s*(?:\([^()]*\))?[\s)]*(?:(?:ON|USING)\b(.*))?$"
_AFTER = rf"(?i)\b(?:FROM|JOIN|USING)[\s(]+{_TARGET}"
_DERIVED = rf"(?i){_OPEN}(\d+){_CLOSE}\s+(?:AS\s+)?(?!(?:{_STOP})\b)\"?\w+\"?\s*\(([^()]*)\)"
# Words that may stand before a column in an expression, so that what follows them is no alias.
_BEFORE = "AND|OR|NOT|IS|IN|LIKE|BETWEEN|THEN|ELSE|WHEN|CASE|BY|FROM|OVER|AS|DISTINCT|MOD|INTERVAL|ESCAPE|ANY|ALL|DATE|TIME|TIMESTAMP|EXISTS"
_ALIAS = rf'(?i)^(.*(?<!\b(?:{_BEFORE}))(?<![-+*/|<>=,(\s]))\s+"?(?!(?:END|NULL|ASC|DESC|DAY|MONTH|YEAR|HOUR|MINUTE|SECOND)\b)([A-Za-z_]\w*)"?$'
_REF = r"(?<![\w.$])([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*)(?!\s*\(|[\w.$])"
# Words of expressions that are no columns.
_WORDS = """CASE WHEN THEN ELSE END AND OR NOT NULL IS IN LIKE BETWEEN AS DISTINCT OVER PARTITION BY ORDER ASC DESC ROWS RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT ROW DATE TIME
TIMESTAMP INTERVAL DAY MONTH YEAR HOUR MINUTE SECOND DECIMAL NUMERIC VARCHAR CHAR INTEGER INT BIGINT SMALLINT BYTEINT FLOAT DOUBLE PRECISION REAL NUMBER CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP
CURRENT_USER USER SESSION TRUE FALSE FROM EXISTS SELECT WHERE ESCAPE ANY ALL SOME DEFAULT ZONE AT LOCAL CHARACTER SET LATIN UNICODE MOD GROUP HAVING QUALIFY TO USING""".split()
_NO_COLUMN = f"(?i)^(?:{'|'.join(_WORDS)})$"
_TYPES = "INTEGER|INT|BYTEINT|SMALLINT|BIGINT|FLOAT|REAL|NUMBER|DOUBLE PRECISION|DATE|TIMESTAMP|TIME|(?:DECIMAL|DEC|NUMERIC|CHAR|VARCHAR)"
_AGGREGATE = r"(?i)\b(?:SUM|COUNT|AVG|MIN|MAX)\s*\("
_PLAIN = r"^[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*$"
_STRINGS = "array<string>"
_ITEM = "array<struct<target:string,expr:string>>"
_COND = "array<struct<kind:string,expr:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def bare(name: Column) -> Column:
    return F.translate(F.trim(name), '"', "")


def last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def full(name: Column, database: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, name).otherwise(F.concat_ws(".", database, name))


def listed(text: Column) -> Column:
    return F.when(text != "", F.transform(F.split(text, ","), bare)).otherwise(_none(_STRINGS))


def split_top(text: Column, separator: str, joined: str) -> Column:
    """Pieces of ``text`` between separators (a regular expression) outside brackets; ``joined`` is put back inside them."""
    opened = lambda x: F.coalesce(F.length(F.translate(x, ")", "")) - F.length(F.translate(x, "(", "")), F.lit(0))

    def add(acc: Column, piece: Column) -> Column:
        end = F.get(acc, F.size(acc) - 1)
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(end, F.lit(joined), piece)))
        return F.when(opened(end) > 0, longer).otherwise(F.concat(acc, F.array(piece)))

    return F.aggregate(F.split(text, separator), _none(_STRINGS), add)


def flattened(text: Column) -> Column:
    """struct(text, scopes): the text with the number of a scope in place of each bracket that holds a SELECT, and the texts of the
    scopes by number (null: another bracket). A scope's number is greater than those of the scopes in it."""

    def deeper(a: Column, x: Column) -> Column:
        now = F.when(x == "(", a["now"] + 1).otherwise(F.greatest(a["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    def step(acc: Column, _: Column) -> Column:
        held = F.regexp_extract_all(acc["text"], F.lit(r"\(([^()]*)\)"), 1)
        is_scope = lambda x: x.rlike(r"(?i)^\s*(?:SEL|SELECT|WITH)\b")

        def body(inner: Column) -> Column:
            number = lambda i: (F.size(acc["scopes"]) + i).cast("string")
            put = F.transform(inner, lambda x, i: F.when(is_scope(x), F.concat(F.lit(_OPEN), number(i), F.lit(_CLOSE))).otherwise(F.concat(F.lit(_LEFT), x, F.lit(_RIGHT))))
            whole = F.array_join(F.zip_with(F.split(acc["text"], r"\([^()]*\)"), F.concat(put, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
            return F.struct(whole.alias("text"), F.concat(acc["scopes"], F.transform(inner, lambda x: F.when(is_scope(x), x))).alias("scopes"))

        return let(held, body)

    depth = F.aggregate(F.regexp_extract_all(text, F.lit("([()])"), 1), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper, lambda a: a["most"])
    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(_none("array<int>"))
    back = lambda x: F.translate(x, _LEFT + _RIGHT, "()")
    done = F.aggregate(rounds, F.struct(text.alias("text"), _none(_STRINGS).alias("scopes")), step)
    return let(done, lambda d: F.struct(back(d["text"]).alias("text"), F.transform(d["scopes"], back).alias("scopes")))


def _item(text: Column) -> Column:
    """struct(target, expr) of an item of a list: its alias or its own last name, and its expression."""
    text = F.regexp_replace(text, r'(?i)\(\s*NAMED\s+("?\w+"?)\s*\)', " $1")
    text = F.regexp_replace(text, r'(?i)([\s)"' + _CLOSE + r'])AS\s+("?\w+"?)$', "$1 $2")

    def parts(x: Column) -> Column:
        alias = F.translate(F.regexp_extract(x, _ALIAS, 2), '"', "")
        return F.struct(F.when(alias != "", alias).otherwise(last(bare(x))).alias("target"), F.when(alias != "", F.trim(F.regexp_extract(x, _ALIAS, 1))).otherwise(x).alias("expr"))

    return let(F.trim(text), parts)


def _assignments(text: Column) -> Column:
    return F.transform(split_top(text, ",", ","), lambda x: F.struct(last(bare(F.substring_index(x, "=", 1))).alias("target"), F.trim(F.substr(x, F.instr(x, "=") + F.lit(1))).alias("expr")))


def _sources(text: Column) -> Column:
    """Pieces of a list of tables, one for each table: name, alias and what its ON or USING says. Brackets around joins are seen
    through: what they hold is no SELECT any more."""
    return F.flatten(F.transform(split_top(text, ",", ","), lambda x: F.split(x, _JOINS)))


def _parts(branch: Column) -> Column:
    """struct(items, sources, conds) of a SELECT without brackets that hold another one."""
    body = F.regexp_replace(branch, r"(?i)^\s*SEL(?:ECT)?\s+(?:DISTINCT\s+|ALL\s+|TOP\s+\d+\s+(?:PERCENT\s+)?(?:WITH\s+TIES\s+)?)?", "")

    def parts(p: Column) -> Column:
        rest = F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), " FROM ")
        where = F.regexp_extract(rest, rf"(?is)\sWHERE\s(.*?)(?:\s(?:{_ENDS})\s.*)?$", 1)
        return F.struct(
            F.transform(split_top(F.get(p, 0), ",", ","), _item).alias("items"),
            F.when(F.size(p) > 1, _sources(F.regexp_replace(rest, rf"(?is)\s(?:{_ENDS})\s.*$", ""))).otherwise(_none(_STRINGS)).alias("sources"),
            F.when(where != "", F.array(F.struct(F.lit("FILTER").alias("kind"), where.alias("expr")))).otherwise(_none(_COND)).alias("conds"),
        )

    return let(split_top(body, r"(?i)\s+FROM\s+", " FROM "), parts)


def _ctes(holders: Column) -> Column:
    """Names of WITH lists: name, no (place in the list), body (scope), cols, holder (the scope that the list stands in), recursive."""

    def of(h: Column) -> Column:
        groups = [F.regexp_extract_all(h["text"], F.lit(_CTE), k) for k in (1, 2, 3)]
        zipped = F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(groups)])
        recursive = h["text"].rlike(r"(?i)^\s*WITH\s+RECURSIVE\b")
        return F.transform(zipped, lambda z, i: F.struct(F.lower(z["g0"]).alias("name"), i.alias("no"), z["g2"].cast("int").alias("body"), listed(z["g1"]).alias("cols"), h["scope"].alias("holder"), recursive.alias("recursive")))

    return F.flatten(F.transform(F.filter(holders, lambda h: h["text"].rlike(r"(?i)^\s*WITH\b")), of))


def _entry(source: Column, database: Column, path: Column, ctes: Column) -> Column:
    """A source as struct(key, name, scope, on): how it is referred to, and its table or scope."""
    name, alias, on = (F.regexp_extract(source, _SOURCE, k) for k in (1, 2, 3))

    def of(n: Column) -> Column:
        inside = lambda c: F.filter(ctes, lambda d: (d["holder"] == c["holder"]) & F.array_contains(path, d["body"]))
        sees = lambda c: let(F.get(inside(c), 0), lambda d: d.isNull() | (c["no"] < d["no"]) | ((c["no"] == d["no"]) & c["recursive"]))
        seen = F.filter(ctes, lambda c: (c["name"] == F.lower(n)) & F.array_contains(path, c["holder"]) & sees(c))
        nearest = F.get(F.array_sort(F.transform(seen, lambda c: F.struct(F.array_position(path, c["holder"]).alias("far"), c["body"].alias("body")))), 0)["body"]
        scope = F.when(n.startswith(_OPEN), F.translate(n, _OPEN + _CLOSE, "").cast("int")).otherwise(nearest)
        return F.struct(F.lower(F.when(alias != "", alias).otherwise(last(n))).alias("key"), F.when(scope.isNull(), full(n, database)).alias("name"), scope.alias("scope"), F.trim(on).alias("on"))

    return F.when(name != "", let(bare(name), of))


def _read(texts: DataFrame, plain: Column) -> tuple[DataFrame, int | None]:
    """One row for each SELECT of each statement: key, target, wanted (the target's columns, for the root), scope, branch, items,
    entries, conds, named_tables; and the number of statements, if it is not large. ``texts``: key, db and what ``plain`` reads. A statement without any
    has one row with a null scope."""
    t = texts.select("key", "db", flattened(F.translate(plain, MARKS, "")).alias("f")).select("key", "db", F.col("f.text").alias("t"), F.col("f.scopes").alias("scopes"))
    t, n = cut(t)  # read by each kind of statement
    part = lambda pattern, k: F.regexp_extract("t", pattern, k)
    target = part(_ANY_TARGET, 1)
    makes = F.when(F.col("t").rlike(_INSERT), F.struct(part(_INSERT, 2).alias("cols"), part(_INSERT, 3).alias("body"))).when(F.col("t").rlike(_CREATE), F.struct(part(_CREATE, 2).alias("cols"), part(_CREATE, 3).alias("body")))
    t = t.withColumn("target", F.when(target != "", full(bare(target), F.col("db")))).withColumn("makes", makes)
    root = F.when(F.col("makes").isNotNull(), F.array(F.struct(F.lit(ROOT).alias("scope"), F.col("makes.body").alias("text")))).otherwise(_none("array<struct<scope:int,text:string>>"))
    inner = F.filter(F.transform("scopes", lambda x, k: F.struct(k.alias("scope"), x.alias("text"))), lambda x: x["text"].isNotNull())
    t = t.withColumn("texts", F.concat(root, inner)).withColumn("ctes", _ctes(F.col("texts")))
    # The scopes around each scope, nearest first: a scope's number stands in the text of the one around it.
    token = lambda k: F.concat(F.lit(_OPEN), k.cast("string"), F.lit(_CLOSE))
    around = F.transform("scopes", lambda x, k: F.coalesce(F.get(F.filter(F.col("texts"), lambda o: F.instr(o["text"], token(k)) > 0), 0)["scope"], F.lit(ROOT)))
    path = lambda k: F.aggregate(F.col("scopes"), F.array(k), lambda p, _: F.when(F.element_at(p, -1) == ROOT, p).otherwise(F.concat(p, F.array(F.get(F.col("around"), F.element_at(p, -1))))))
    whole = F.concat_ws("\n", "t", F.array_join("scopes", "\n"))
    t = t.withColumn("around", around).withColumn("derived", F.arrays_zip(*[F.regexp_extract_all(whole, F.lit(_DERIVED), k + 1).alias(f"g{k}") for k in (0, 1)]))

    s = t.select("*", F.explode("texts").alias("own")).select("*", F.col("own.scope").alias("scope"), path(F.col("own.scope")).alias("path"))
    named = F.coalesce(
        F.when(F.col("scope") == ROOT, listed(F.col("makes.cols"))), F.get(F.filter("ctes", lambda c: c["body"] == F.col("scope")), 0)["cols"],
        listed(F.get(F.filter("derived", lambda d: d["g0"] == F.col("scope").cast("string")), 0)["g1"]), _none(_STRINGS),
    )
    text = F.regexp_replace("own.text", rf"(?is)^\s*WITH\b.*?{_CLOSE}\s*(?=SEL(?:ECT)?\b|{_OPEN}\d+{_CLOSE}\s*$)", "")
    s = s.select("key", "db", "target", "scope", "path", "ctes", named.alias("named"), F.posexplode(F.split(text, _SETS)).alias("branch", "b"))
    alone = F.trim("b").rlike(rf"^{_OPEN}\d+{_CLOSE}$")
    s = s.withColumn("p", _parts(F.when(alone, F.concat(F.lit("SELECT * FROM "), F.col("b"))).otherwise(F.col("b")))).select("key", "db", "target", "scope", "path", "ctes", "named", "branch", "p.*")

    sets = F.regexp_extract(part(_MERGE, 5), r"(?is)\bUPDATE\s+SET\s+(.*?)(?:\s+WHEN\b.*)?$", 1)
    into, values = (F.regexp_extract(part(_MERGE, 5), r"(?is)\bINSERT\s*\(([^()]*)\)\s*VALUES\s*\((.*?)\)\s*(?:WHEN\b.*)?$", k) for k in (1, 2))
    inserts = F.zip_with(listed(into), split_top(values, ",", ","), lambda c, v: F.struct(c.alias("target"), F.trim(v).alias("expr")))
    own = lambda pattern: F.concat_ws(" ", part(pattern, 1), F.when(part(pattern, 2) != "", part(pattern, 2)))
    cond = lambda kind, x: F.when(x != "", F.array(F.struct(F.lit(kind).alias("kind"), x.alias("expr")))).otherwise(_none(_COND))
    listed_sources = lambda x: F.when(x != "", _sources(x)).otherwise(_none(_STRINGS))
    merge = F.struct(
        F.concat(F.when(sets != "", _assignments(sets)).otherwise(_none(_ITEM)), F.when(into != "", inserts).otherwise(_none(_ITEM))).alias("items"),
        F.concat(F.array(part(_MERGE, 3)), F.array(own(_MERGE))).alias("sources"), cond("JOIN", part(_MERGE, 4)).alias("conds"),
    )
    update = F.struct(
        _assignments(part(_UPDATE, 4)).alias("items"), F.concat(listed_sources(part(_UPDATE, 3)), listed_sources(part(_UPDATE, 5)), F.array(own(_UPDATE))).alias("sources"), cond("FILTER", part(_UPDATE, 6)).alias("conds"),
    )
    d = t.withColumn("p", F.when(F.col("t").rlike(_MERGE), merge).when(F.col("t").rlike(_UPDATE), update)).filter("p is not null")
    d = d.select("key", "db", "target", F.lit(ROOT).alias("scope"), F.array(F.lit(ROOT)).alias("path"), "ctes", _none(_STRINGS).alias("named"), F.lit(0).alias("branch"), "p.*").withColumn("direct", F.lit(True))
    rows = s.withColumn("direct", F.lit(False)).unionByName(d)
    entries = F.filter(F.transform("sources", lambda x: _entry(x, F.col("db"), F.col("path"), F.col("ctes"))), lambda e: e.isNotNull())
    rows = rows.withColumn("entries", entries)
    on = F.transform(F.filter("entries", lambda e: e["on"] != ""), lambda e: F.struct(F.lit("JOIN").alias("kind"), e["on"].alias("expr")))
    rows = rows.withColumn("conds", F.concat("conds", on)).select("key", "target", "scope", "branch", "direct", "path", "named", "items", "entries", "conds")
    # What stands after FROM, JOIN and USING, for texts that are cut off or that nothing else can be read from.
    shadowed = F.transform("ctes", lambda c: c["name"])
    after = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(_AFTER), 1), bare), lambda x: ~F.array_contains(shadowed, F.lower(x)) & ~x.rlike(_NO_COLUMN))
    none = t.select("key", "target", F.array_distinct(F.transform(after, lambda x: full(x, F.col("db")))).alias("named_tables"))
    none = none.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns[2:]})
    return rows.withColumn("named_tables", F.lit(None).cast(_STRINGS)).unionByName(none), n


def _star(expr: Column) -> Column:
    return expr.rlike(r"^(?:[\w$\"]+\.)*\*$")


def _covers(star: Column, entry: Column) -> Column:
    """Whether a star stands for the columns of an entry."""
    qualifier = F.lower(last(F.substring_index(bare(star), ".*", 1)))
    return (bare(star) == "*") | (entry["key"] == qualifier) | (F.lower(last(entry["name"])) == qualifier)


def _widened(known: DataFrame) -> Column:
    """Array of struct(target, expr, entry, place, open) of ``known``'s items, stars replaced by the columns of their entries. open: a
    star over a source with unknown columns."""

    def of(item: Column) -> Column:
        met = F.filter(F.col("entries"), lambda e: _covers(item["expr"], e))
        one = lambda target, expr, entry, place, is_open: F.struct(target.alias("target"), expr.alias("expr"), entry.alias("entry"), place.alias("place"), F.lit(is_open).alias("open"))
        nothing, no_entry = F.lit(None).cast("string"), F.lit(None).cast("int")
        columns = lambda e: F.transform(e["cols"], lambda c, k: one(c, nothing, e["no"], k, False))
        each = F.flatten(F.transform(met, lambda e: F.when(e["cols"].isNull(), F.array(one(F.lit("*"), nothing, e["no"], no_entry, True))).otherwise(columns(e))))
        return F.when(_star(item["expr"]), each).otherwise(F.array(one(item["target"], item["expr"], no_entry, no_entry, False)))

    return F.flatten(F.transform(known["items"], of))


def _outputs(rows: DataFrame) -> DataFrame:
    """key, at (scope), cols: the columns of the scopes whose first branch has no open star."""
    first = rows.filter("branch = 0 and scope >= 0").withColumn("wide", _widened(rows)).filter(~F.exists("wide", lambda w: w["open"]))
    names = F.transform("wide", lambda w, k: F.coalesce(F.get(F.col("named"), k), w["target"]))
    return first.select("key", F.col("scope").alias("at"), names.alias("cols"))


def _with_columns(rows: DataFrame, fields: DataFrame | None, size: int | None) -> DataFrame:
    """``rows``, about ``size``, with no and cols (null: unknown) in each entry. Scopes with stars over other scopes take a round for each level."""
    exprs = lambda items: F.transform(items, lambda i: i["expr"])
    if fields is None:
        flat = rows.select("key", "scope", "branch", F.posexplode("entries").alias("no", "e")).withColumn("cols", F.lit(None).cast(_STRINGS))
    else:
        # A table behind no star is only asked whether it has the columns that its SELECT names, so no others go on with it.
        named = F.flatten(F.transform(F.concat(exprs("items"), exprs("conds")), lambda x: F.transform(_refs(x), lambda ref: F.lower(last(ref)))))
        flat = rows.select("key", "scope", "branch", F.filter(exprs("items"), _star).alias("stars"), F.array_distinct(named).alias("named"), "entries")
        flat = flat.select("key", "scope", "branch", "stars", "named", F.posexplode("entries").alias("no", "e"))
        kept = F.when(F.exists("stars", lambda x: _covers(x, F.col("e"))), F.col("cols")).otherwise(F.filter("cols", lambda c: F.array_contains("named", F.lower(c))))
        tables = fields.select(F.lower("name").alias("table"), "cols") if "cols" in fields.columns else fields.groupBy(F.lower("name").alias("table")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", "field_name"))), lambda x: x["field_name"]).alias("cols"))
        flat = flat.join(tables, F.lower("e.name") == F.col("table"), "left").select("key", "scope", "branch", "no", "e", kept.alias("cols"))
        flat, _ = cut(flat, after=size)  # read by each round
    waiting = F.exists("items", lambda i: _star(i["expr"]))
    plain = rows.filter("branch = 0 and scope >= 0").filter(~waiting)
    known = plain.select("key", F.col("scope").alias("at"), F.transform("items", lambda i, k: F.coalesce(F.get(F.col("named"), k), i["target"])).alias("cols"))
    over = waiting & (F.exists("entries", lambda e: e["scope"].isNotNull()) | (F.lit(fields is not None) & (F.col("scope") >= 0)))  # a scope's star over a table of the catalog too
    nested, scopes = rows.filter("scope is not null").agg(F.coalesce(F.bool_or(over), F.lit(False)), F.count_if(F.expr("branch = 0 and scope >= 0"))).first()
    known, before = cut(known) if nested else (known, None)
    while True:
        found = flat.join(known.withColumnsRenamed({"cols": "own", "key": "k"}), (F.col("key") == F.col("k")) & (F.col("e.scope") == F.col("at")), "left").drop("k", "at")
        entry = F.struct("no", F.col("e.key").alias("key"), F.col("e.name").alias("name"), F.col("e.scope").alias("scope"), F.coalesce("own", "cols").alias("cols"))
        grouped = found.groupBy("key", "scope", "branch").agg(F.array_sort(F.collect_list(entry), lambda a, b: a["no"] - b["no"]).alias("entries"))
        out = rows.drop("entries").join(grouped, ["key", "scope", "branch"], "left").withColumn("entries", F.coalesce("entries", _none(grouped.schema["entries"].dataType.simpleString())))
        if not nested or before == scopes:  # no star is left to be read, or all scopes are known
            return out
        new, n = cut(_outputs(out))
        n = new.count() if n is None else n
        if before == n:
            return out
        known, before = new, n


def _refs(expr: Column) -> Column:
    """Distinct column references of an expression, without the names of types, formats and key words."""
    text = F.regexp_replace(F.translate(expr, '"', ""), r"(?i)\s*\(\s*(?:FORMAT|TITLE)\b[^()]*\)", "")
    text = F.regexp_replace(text, rf"(?i)\s*\(\s*(?:{_TYPES})\s*(?:\(\s*\d+\s*(?:,\s*\d+\s*)?\))?\s*\)", "")
    text = F.regexp_replace(text, r"(?i)\s+AS\s+[^()]*(?:\([^()]*\)[^()]*)?(?=\))", "")
    text = F.regexp_replace(text, r"(?i)\bNULLS\s+(?:FIRST|LAST)\b", "")
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(_REF), 1), lambda x: ~x.rlike(_NO_COLUMN)))


def _kind(expr: Column) -> Column:
    return F.when(F.trim(F.translate(expr, '"', "")).rlike(_PLAIN) | F.trim(expr).rlike(rf"^{_OPEN}\d+{_CLOSE}$"), "DIRECT").when(expr.rlike(_AGGREGATE), "AGGREGATION").otherwise("CALCULATION")


def _resolved(ref: Column, entries: Column, outer: Column) -> Column:
    """struct(name, scope, place, column) of a reference, null if it has no one owner. ``outer``: entries of the scopes around, nearest first."""
    parts, column = F.size(F.split(ref, r"\.")), last(ref)
    qualifier = F.lower(F.substring_index(F.substring_index(ref, ".", -2), ".", 1))
    place = lambda e: F.array_position(F.transform(e["cols"], F.lower), F.lower(column)) - 1
    of = lambda e: F.when(
        e.isNotNull() & (e["scope"].isNull() | (place(e) >= 0)), F.struct(e["name"].alias("name"), e["scope"].alias("scope"), place(e).cast("int").alias("place"), column.alias("column"))
    )
    named = F.filter(F.concat(entries, outer), lambda e: (e["key"] == qualifier) | (F.lower(last(e["name"])) == qualifier))
    by_alias = F.coalesce(F.get(F.filter(named, lambda e: e["key"] == qualifier), 0), F.get(named, 0))
    owners = F.filter(entries, lambda e: place(e) >= 0)
    same = F.size(F.array_distinct(F.transform(entries, lambda e: F.struct(e["name"], e["scope"])))) == 1
    single = F.when(same, F.get(entries, 0)).when(F.size(owners) == 1, F.get(owners, 0))
    whole = F.struct(F.substring_index(ref, ".", 2).alias("name"), F.lit(None).cast("int").alias("scope"), F.lit(None).cast("int").alias("place"), column.alias("column"))
    return F.when(parts == 1, let(single, of)).when(parts == 2, let(by_alias, of)).otherwise(whole)


def _edges(rows: DataFrame) -> DataFrame:
    """key, target, at (scope), place (of the column there; null: all of the target), column (its name, for the root), kind, and the source:
    name and source_column of a table, or from_scope and from_place (null: all). Unresolved references have no source."""
    around = rows.filter("scope is not null").select("key", "scope", F.posexplode(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))).alias("far", "outer_scope"))
    entries = rows.filter("branch = 0 and scope is not null").select("key", F.col("scope").alias("outer_scope"), F.col("entries").alias("outer"))
    outer = around.distinct().join(entries, ["key", "outer_scope"]).groupBy("key", "scope").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("far", "outer")), lambda a, b: a["far"] - b["far"]), lambda x: x["outer"])).alias("outer"))
    r = rows.filter("scope is not null").join(outer, ["key", "scope"], "left")
    r = r.withColumn("outer", F.coalesce("outer", _none(rows.schema["entries"].dataType.simpleString()))).withColumn("wide", _widened(rows))
    # Behind an open star the places of a list are unknown; names still tell the target's columns where it has no list.
    first_open = F.coalesce(F.array_position(F.transform("wide", lambda w: w["open"]), True), F.lit(0))
    by_name = F.col("direct") | (F.size("named") == 0)
    value = let(first_open, lambda opened: F.transform("wide", lambda w, k: F.struct(
        F.when((opened == 0) | (k < opened - 1), k).alias("place"), F.when(by_name, w["target"]).when((opened == 0) | (k < opened - 1), F.coalesce(F.get(F.col("named"), k), w["target"])).alias("column"),
        w["expr"].alias("expr"), w["entry"].alias("entry"), w["place"].alias("from"), w["open"].alias("open"), F.when(w["expr"].isNull(), "DIRECT").otherwise(_kind(w["expr"])).alias("kind"),
    )))
    conds = F.transform("conds", lambda c: F.struct(F.lit(None).cast("int").alias("place"), F.lit("*").alias("column"), c["expr"].alias("expr"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("int").alias("from"), F.lit(False).alias("open"), c["kind"].alias("kind")))
    source = lambda name, scope, place, column: F.struct(name.alias("name"), scope.cast("int").alias("scope"), place.cast("int").alias("place"), column.alias("column"))
    nothing = F.lit(None).cast("string")

    def found(x: Column) -> Column:
        """An item with what it reads; entries, with the columns of whole tables, stay in the statement's row and are not repeated for each item."""
        starred = let(F.get("entries", x["entry"]), lambda e: F.array(source(e["name"], e["scope"], x["from"], F.get(e["cols"], x["from"]))))
        named = F.transform(_refs(x["expr"]), lambda ref: _resolved(ref, F.col("entries"), F.col("outer")))
        nested = F.transform(F.regexp_extract_all(x["expr"], F.lit(rf"{_OPEN}(\d+){_CLOSE}"), 1), lambda n: source(nothing, n, nothing, nothing))
        read = F.when(x["entry"].isNotNull(), starred).otherwise(F.concat(named, nested))
        return F.struct(x["place"].alias("place"), x["column"].alias("column"), x["kind"].alias("kind"), read.alias("read"))

    items = F.transform(F.filter(F.concat(value, conds), lambda x: ~x["open"]), found)
    both = r.select("key", "target", "scope", F.explode(items).alias("x")).select("key", "target", "scope", "x", F.explode("x.read").alias("found"))
    cond = F.col("x.kind").isin("JOIN", "FILTER")
    return both.select(
        "key", "target", F.when(cond, ROOT).otherwise(F.col("scope")).alias("at"), "x.place", "x.column", "x.kind",
        F.col("found.name").alias("name"), F.col("found.column").alias("source_column"), F.col("found.scope").alias("from_scope"), F.col("found.place").alias("from_place"), F.col("found").isNull().alias("lost"),
    ).distinct()


def _worse(a: Column, b: Column) -> Column:
    """The kind of a path of two edges."""
    both = F.array(a, b)
    out = F.when(a.isin("JOIN", "FILTER"), a)
    for kind in ("AGGREGATION", "CALCULATION"):
        out = out.when(F.array_contains(both, kind), kind)
    return out.otherwise("DIRECT")


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges into the root, those from scopes replaced by the scopes' own, until all start at tables. Each path is followed once."""
    rooted = edges.filter(F.col("at") == ROOT)
    level, n = cut(rooted.filter("from_scope is not null"))
    out, seen = rooted.filter("from_scope is null"), level
    inner = edges.filter((F.col("at") >= 0) & ~F.col("kind").isin("JOIN", "FILTER")).select("key", F.col("at").alias("i_at"), F.col("place").alias("i_place"), F.col("kind").alias("i_kind"), "name", "source_column", F.col("from_scope").alias("i_scope"), F.col("from_place").alias("i_from"), "lost")
    while n != 0:
        step = level.drop("name", "source_column", "lost").join(inner, "key").filter((F.col("from_scope") == F.col("i_at")) & (F.col("from_place").isNull() | (F.col("from_place") == F.col("i_place"))))
        new = step.select("key", "target", "at", "place", "column", _worse(F.col("kind"), F.col("i_kind")).alias("kind"), "name", "source_column", F.col("i_scope").alias("from_scope"), F.col("i_from").alias("from_place"), "lost")
        new, n = cut(new.subtract(seen), after=n)  # those from tables are never in ``seen``
        out = out.unionByName(new.filter("from_scope is null"))
        level = new.filter("from_scope is not null")
        seen = seen.unionByName(level)
    return out


def provenance(texts: DataFrame, plain: Column, fields: DataFrame | None = None) -> DataFrame:
    """key, target, edges, conditions, n_unresolved and sources of each statement of ``texts`` (key, db, and the columns of ``plain``).

    edges: source, source_column, target_column and kind of what flows into the target; conditions: the columns that ON, WHERE and
    MERGE conditions read, kinds JOIN and FILTER, for the whole target (*). n_unresolved counts references of items without
    one owner; sources are the tables that are read, or, where none can be placed, those that the text names after FROM, JOIN and USING. ``fields``: name (database.table), field_name and ordinal_position of the
    catalog, in any case of letters; or name, once, and cols, the table's columns in their order.
    """
    found, n = _read(texts, plain)
    rows, n = cut(found, after=None if n is None else 2 * n)  # a statement has a row or more, and a row an edge or more
    rows, _ = cut(_with_columns(rows, fields, n), after=n)
    edges, _ = cut(_edges(rows), after=None if n is None or fields is not None else 2 * n)  # a star gives as many as its table has columns
    found = _contracted(edges)
    value = ~F.col("kind").isin("JOIN", "FILTER")
    known = ~F.col("lost")
    edge = F.struct(F.col("name").alias("source"), "source_column", F.col("column").alias("target_column"), "kind")
    own = found.filter(known).groupBy("key").agg(F.array_sort(F.collect_set(F.when(value & F.col("column").isNotNull(), edge))).alias("edges"), F.array_sort(F.collect_set(F.when(~value, edge))).alias("conditions"))
    lost = edges.filter(value & (F.col("lost") | ((F.col("at") == ROOT) & F.col("column").isNull()))).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n_unresolved"))
    read = F.filter("entries", lambda e: e["name"].isNotNull())
    read = F.transform(F.when(F.col("direct"), F.filter(read, lambda e: e["no"] < F.size("entries") - 1)).otherwise(read), lambda e: e["name"])
    tables = rows.groupBy("key", "target").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce(read, _none(_STRINGS))))).alias("found"), F.first("named_tables", ignorenulls=True).alias("named"))
    tables = tables.select("key", "target", F.when(F.size("found") > 0, F.col("found")).otherwise(F.coalesce("named", _none(_STRINGS))).alias("sources"))
    kind = "array<struct<source:string,source_column:string,target_column:string,kind:string>>"
    out = tables.join(own, "key", "left").join(lost, "key", "left")
    return out.select("key", "target", *(F.coalesce(c, _none(kind)).alias(c) for c in ("edges", "conditions")), F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"), "sources")
