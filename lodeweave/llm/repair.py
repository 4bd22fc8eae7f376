"""Operator 12: conversation structure repair by scalar big-integer weights.

The rows of a conversation, in order of their turns, are a path through a graph whose nodes are (row, inserts so far,
state of the role pattern) and whose arcs are edits: Delete, Insert, Keep, Rerole. The weight of a path is one integer. Its
high digits are the cost; below them each edit's letter has a digit at the place that the edit has in the audit, and
places after the end are zero. So the least integer is the cheapest repair and, among equal ones, that whose audit is
least in ASCII order, and the usual minimum over a graph without cycles decides both.

A conversation of many rows is decided in blocks: at the end of a block the few live weights keep their cost and give
their digits for their rank, which decides as the digits would, so weights don't grow with the conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.shared import SPACES, table

LETTERS = ".DIKR"  # a letter's digit is its place; the order of the letters is that of ASCII
BITS = 3
BLOCK = 512
ENDS = ".!?"
# Role pattern (s?(ua)+)?: the state after a role initial. 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end in 0 and 3.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE_OF = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    """What edits cost, in whole numbers from 0; ``truncated`` is added for a truncated row that is not deleted."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def most_inserts(self, rows: int) -> int:
        """No cheapest repair inserts more. An inserted turn can go together with its partner, and with the system turn
        before it if they were the only pair: that costs two deletions at most. And deleting all rows is always a repair."""
        return 0 if self.insert > 2 * self.delete else rows * self.delete // max(1, self.insert)


def cheapest(rows: list[tuple[str, bool, bool]], costs: Costs = Costs(), block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of the repair of ``rows``: role initial, whether it must go, whether it is truncated."""
    n, most = len(rows), costs.most_inserts(len(rows))
    width = n + most if most or n <= block else block
    unit = 1 << BITS * (width + 1)  # of cost; the digit below it is the rank at the start of the block
    low, digits = unit - 1, (1 << BITS * width) - 1
    live, start, history = {(0, 0): 0}, 0, []

    def offer(to: dict, node: tuple[int, int], weight: int) -> None:
        if node not in to or weight < to[node]:
            to[node] = weight

    for i in range(n + 1):
        for made in range(most):
            place = BITS * (width - 1 - (i - start + made))
            for state in range(4):
                weight = live.get((made, state))
                for initial in "ua" if weight is not None else "":
                    if state in STEP[initial]:
                        offer(live, (made + 1, STEP[initial][state]), weight + costs.insert * unit + (LETTERS.index("I") << place))
        if i == n:
            break
        if i - start == width:  # never with inserts, whose paths differ in length
            order = sorted(live, key=lambda node: live[node] & low)
            history.append([(live[node] & low) for node in order])
            live, start = {node: live[node] // unit * unit + (rank << BITS * width) for rank, node in enumerate(order)}, i
        initial, must, truncated = rows[i]
        then: dict[tuple[int, int], int] = {}
        for (made, state), weight in live.items():
            place = BITS * (width - 1 - (i - start + made))
            offer(then, (made, state), weight + costs.delete * unit + (LETTERS.index("D") << place))
            if must:
                continue
            stays = weight + (costs.truncated * unit if truncated else 0)
            if state in STEP.get(initial, ()):
                offer(then, (made, STEP[initial][state]), stays + (LETTERS.index("K") << place))
            for role in "ua":
                if state in STEP[role]:
                    offer(then, (made, STEP[role][state]), stays + costs.rerole * unit + (LETTERS.index("R") << place))
        live = then
    best = min(weight for (_, state), weight in live.items() if state in (0, 3))
    parts, at = [], best & low
    for ranks in [*reversed(history), None]:
        parts.append("".join(LETTERS[int(d)] for d in f"{at & digits:0{width}o}").rstrip(".") if width else "")
        if ranks:
            at = ranks[at >> BITS * width]
    return best // unit, "".join(reversed(parts))


def apply_audit(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) of each row that a repair leaves, inserted ones with an empty text."""
    out, state, at = [], 0, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else "a" if state == 2 else "u"
        state = STEP[initial][state]
        out.append((role if letter == "K" else ROLE_OF[initial], text))
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated, or an empty string."""
    seen, out = set(), []
    for row in rows:
        text = row[1].rstrip(SPACES)
        out.append("blank" if not text else "duplicate" if row in seen else "" if text[-1] in ENDS else "truncated")
        seen.add(row)
    return out


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _repaired(conv: object, kind: pa.DataType, turns: list[int | None], rows: list[tuple[str, str]], costs: Costs) -> pa.RecordBatch:
    found = faults(rows)
    known = {t for t in turns if t is not None}
    initials = [role[:1] for role, _ in rows]
    cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, found)], costs)
    counts = (
        max(known) - min(known) + 1 - len(known) if known else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost,
    )
    messages = [{"role": r, "text": t} for r, t in apply_audit(rows, audit)]
    return pa.record_batch([pa.array([conv], kind), *(pa.array([c], pa.int64()) for c in counts), pa.array([audit]), pa.array([messages], _MESSAGES)], ["conv_id", *_COUNTS, "audit", "messages"])


def _fold(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    conv, kind, turns, rows, begun = None, None, [], [], False
    for batch in batches:
        kind = batch.schema.field(0).type
        for key, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and key != conv:
                yield _repaired(conv, kind, turns, rows, costs)
                turns, rows = [], []
            conv, begun = key, True
            if present:
                turns.append(turn)
                rows.append((role, text))
    if begun:
        yield _repaired(conv, kind, turns, rows, costs)


def repair(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and messages (role, text of what the repair leaves) of
    each conversation.

    Rows come by turn, null first; rows of one turn by role and text, so repeated rows are next to each other. Null
    roles and texts are one space: such a text is blank, such a role can't be kept. Null conversations are one. Rows for which
    ``present`` is not true only make their conversation known; one without other rows has zeros, an empty audit and no
    messages. Other columns are ignored, an empty table gives an empty result. A task holds one conversation at a time.
    """
    kind = conversations.schema[conv].dataType.simpleString()
    own = [F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text")))]
    rows = conversations.select(*own, (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.mapInArrow(lambda it: _fold(it, costs), f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, messages array<struct<role:string,text:string>>")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with the faults that the crc32 of conversation and turn chooses, and present: false for what it drops."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), key.alias("fault"))
    rows = rows.withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.array_repeat(F.col("fault") != 0, F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("present"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of faults, cost, audit and a digest of the repaired turns of every conversation, after damage."""
    out = repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    return out.select("conv_id", *_COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))


def _more(path: str, cost: str, letter: str) -> str:
    """SQL: a path, 12 digits of cost and its audit, with one edit more."""
    return f"lpad(CAST(CAST({path}[1:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {path}[13:] || '{letter}'"


_STAY = "(CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END)"
_FREE = "r.fault NOT IN ('blank', 'duplicate')"
_INTO = lambda state, initial: f"CASE WHEN {_FREE} THEN CASE WHEN r.ini = '{initial}' THEN {_more(state, _STAY, 'K')} ELSE {_more(state, _STAY + ' + 1', 'R')} END END"
_BEFORE_U = "least(p0, p1, p3)"
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i AS v, 0 AS k FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
keys AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (
  SELECT key, 0 AS pos, CAST(4294967295 AS BIGINT) AS c FROM keys
  UNION ALL SELECT key, pos + 1, xor(c >> 8, v) FROM crc JOIN bits ON k = 8 AND b = xor(c, CAST(ascii(key[pos + 1]) AS BIGINT)) & 255 WHERE pos < length(key)),
chosen AS (SELECT key, xor(c, 4294967295) % 20 AS fault FROM crc WHERE pos = length(key)),
dealt AS (
  SELECT c.conv_id, c.turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, fault,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM conversations c JOIN chosen ON key = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
stands AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM dealt, range(CASE WHEN fault = 3 THEN 2 ELSE 1 END) x(k) WHERE fault <> 0),
judged AS (
  SELECT *, role[1] AS ini, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
         CASE WHEN NOT regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ \\t\\n\\x0B\\f\\r]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM stands),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000000' AS p0, CAST(NULL AS VARCHAR) AS p1, CAST(NULL AS VARCHAR) AS p2, CAST(NULL AS VARCHAR) AS p3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, d0, least(d1, CASE WHEN {_FREE} AND ini = 's' THEN {_more("q0", _STAY, "K")} END), least(d2, {_INTO("u0", "u")}), least(d3, {_INTO("a0", "a")})
  FROM (
    SELECT w.conv_id, r.i, r.ini, r.fault, w.p0 AS q0, {_more("w.p0", "2", "D")} AS d0, {_more("w.p1", "2", "D")} AS d1, {_more("w.v2", "2", "D")} AS d2, {_more("w.v3", "2", "D")} AS d3,
           least(w.p0, w.p1, w.v3) AS u0, w.v2 AS a0
    FROM (SELECT *, least(v2_, {_more("p3", "5", "I")}) AS v2, least(p3, {_more("v2_", "5", "I")}) AS v3
          FROM (SELECT *, least(p2, {_more("p0", "5", "I")}, {_more("p1", "5", "I")}) AS v2_ FROM walk)) w
    JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1) r),
ended AS (
  SELECT conv_id, arg_max(least(p0, p3), i) AS path FROM walk GROUP BY conv_id),
kept AS (
  SELECT j.*, path[12 + j.i] AS letter, sum(CASE WHEN path[12 + j.i] <> 'D' AND NOT (path[12 + j.i] = 'K' AND ini = 's') THEN 1 ELSE 0 END) OVER (PARTITION BY j.conv_id ORDER BY j.i) AS place
  FROM judged j JOIN ended e ON j.conv_id IS NOT DISTINCT FROM e.conv_id),
found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal,
         coalesce(string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) FILTER (letter <> 'D'), '') AS whole
  FROM kept GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(path[1:12] AS BIGINT) AS cost, path[13:] AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ended e LEFT JOIN found f ON e.conv_id IS NOT DISTINCT FROM f.conv_id
"""
