"""Conversation structure repair: the cheapest edits that make a conversation
alternate, found by a dynamic program whose backward costs are kept only at
every square root of n-th row.

Spark tells each row's fault and sorts the rows of a conversation; what the
program sees of a row is one byte.  It walks back over the bytes keeping the
vector of costs by state at checkpoints, then forward, block by block, working
the vectors of a block out again to take the ASCII-least edit that is tight.
Texts are streamed once more with the edits, so that a task holds the bytes and
edits of one conversation and one batch of rows, however long the texts are."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

#: Costs of edits; an undeleted truncated row costs one more.
DELETE, INSERT, REROLE = 3, 2, 2
#: States: nothing yet, after system, after user, after assistant.  What a row
#: of initial s, u, a or another leads to, and where a row given the awaited
#: role leads.
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
AWAITED = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Costs after the last row, by state.
END = (0, 2 * INSERT, INSERT, 0)
#: A row's byte is its initial's number (s, u, a, another) and four times its
#: first fault.
TRUNCATED, BLANK, DUPLICATE = 1, 2, 3
#: Pairs of initials that may follow each other: su, ua, au.
LEGAL = {(0, 1), (1, 2), (2, 1)}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Conversations handed on at a time, and characters of their edits.
ROWS, CHARS = 1000, 1 << 20
Vector = tuple[int, ...]


class Program:
    """The dynamic program.  Vectors are kept less their smallest cost, so
    there are few of them and each step is worked out once."""

    def __init__(self) -> None:
        self.steps: dict[tuple[int, Vector], tuple[Vector, int]] = {}
        self.edits: dict[tuple[int, Vector, int], tuple[str, int]] = {}

    def before(self, code: int, after: Vector) -> tuple[Vector, int]:
        """The vector before a row, and what was taken from it."""
        made = self.steps.get((code, after))
        if made is None:
            costs = [min([DELETE + after[q], *(cost + after[to] for _, cost, to in _choices(code, q))]) for q in range(4)]
            costs[2], costs[3] = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
            costs[0], costs[1] = min(costs[0], INSERT + costs[2]), min(costs[1], INSERT + costs[2])
            low = min(costs)
            made = self.steps[code, after] = (tuple(c - low for c in costs), low)
        return made

    def taken(self, code: int, after: Vector, state: int) -> tuple[str, int]:
        """The edits up to and with a row, ASCII-least of the tight ones, and
        the state after it."""
        made = self.edits.get((code, after, state))
        if made is None:
            vector, low = self.before(code, after)
            said, q = "", state
            while True:
                left = vector[q] + low
                if DELETE + after[q] == left:
                    made = (said + "D", q)
                elif INSERT + vector[AWAITED[q]] + low == left:
                    said, q = said + "I", AWAITED[q]
                    continue
                else:
                    made = next((said + edit, to) for edit, cost, to in _choices(code, q) if cost + after[to] == left)
                break
            self.edits[code, after, state] = made
        return made

    def cheapest(self, codes: bytes) -> tuple[int, str]:
        """Cost and edits of a conversation's rows."""
        n, block = len(codes), isqrt(len(codes)) + 1
        checkpoints: list[Vector] = [END]
        vector, cost = END, 0
        for i in range(n - 1, -1, -1):
            vector, low = self.before(codes[i], vector)
            cost += low
            if i % block == 0:
                checkpoints.append(vector)
        cost += vector[0]
        checkpoints.pop()
        state, said = 0, []
        for start in range(0, n, block):
            own = codes[start : start + block]
            vectors = [checkpoints.pop()]
            for code in reversed(own[1:]):
                vectors.append(self.before(code, vectors[-1])[0])
            for code in own:
                edits, state = self.taken(code, vectors.pop(), state)
                said.append(edits)
        while END[state]:
            said.append("I")
            state = AWAITED[state]
        return cost, "".join(said)


def _choices(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits other than deletion that consume a row, in ASCII order: initial,
    cost and the state after."""
    fault, to = code >> 2, KEPT[state][code & 3]
    if fault in (BLANK, DUPLICATE):
        return []
    return ([("K", fault, to)] if to is not None else []) + [("R", REROLE + fault, AWAITED[state])]


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``edit, role, text`` of the rows that stay or are put in."""
    state = 0
    for edit in audit:
        role, text = (ROLE[state], "") if edit == "I" else next(rows)
        if edit == "R":
            role = ROLE[state]
        if edit != "D":
            state = KEPT[state]["sua".index(role[0])]
            yield edit, role, text


def _ready(rows: DataFrame, key: str) -> DataFrame:
    space = F.lit(" ")
    made = rows.select(F.col(key).alias(key), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return made.withColumn("_digest", F.unhex(F.md5("text")))


#: Rows of a turn are taken by role and by digest of the text.
_ORDER = ("turn", "role", "_digest")


def row_codes(rows: DataFrame, key: str) -> DataFrame:
    """``key, turn, code``, a byte for each row's initial and first fault; rows
    are dealt out by key once, and sorted in their tasks."""
    first, said = F.substring("role", 1, 1), F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    narrow = _ready(rows, key).select(key, "turn", "role", "_digest", initial.alias("_initial"), (said == "").alias("_blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    again = F.row_number().over(W.partitionBy(key, "role", "_digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_again"), DUPLICATE).when(F.col("_cut"), TRUNCATED).otherwise(0)
    sorted_rows = narrow.repartition(key).withColumn("_again", again).sortWithinPartitions(key, *_ORDER, "_again")
    return sorted_rows.select(key, "turn", (F.col("_initial") + 4 * fault).cast("tinyint").alias("code"))


def repair_plans(rows: DataFrame, key: str) -> DataFrame:
    """``key, gaps, blank, duplicate, truncated, illegal, cost, audit`` of the
    conversations of rows (key, turn, role, text).

    Defined results: null roles and texts are one space; null turns come first
    and count for no gap; rows of one turn are taken by role and text; null
    keys are one conversation; a role of another initial than s, u and a can
    only be given a role or be deleted; an empty table gives none.  Other
    columns aren't looked at."""
    coded = row_codes(rows, key)
    kind = to_arrow_type(coded.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program()
        made, size = [], 0
        for k, own in groupby(_rows(batches), lambda row: row[0]):
            codes, low, last, distinct = bytearray(), None, None, 0
            for _, turn, code in own:
                codes.append(code)
                if turn is not None and turn != last:
                    low, last, distinct = turn if low is None else low, turn, distinct + 1
            cost, audit = program.cheapest(bytes(codes))
            of = [sum(codes.count(4 * fault + c) for c in range(4)) for fault in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, memoryview(codes)[1:], strict=False))
            made.append((k, 0 if low is None else last - low + 1 - distinct, *of, illegal, cost, audit))
            size += len(audit)
            if len(made) >= ROWS or size >= CHARS:
                yield _batch(made, kind)
                made, size = [], 0
        if made:
            yield _batch(made, kind)

    def _batch(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], kind), *(pa.array([r[c] for r in made], pa.int64()) for c in range(1, 7)), pa.array([r[7] for r in made], pa.string())], names=[key, *COUNTS, "audit"])

    return coded.mapInArrow(run, f"{key} {coded.schema[key].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _with_plans(rows: DataFrame, key: str) -> DataFrame:
    """Each conversation's plan and then its rows in order, in one task."""
    plan = repair_plans(rows, key)
    plans = plan.select(key, F.struct(*COUNTS, "audit").alias("plan"))
    both = _ready(rows, key).unionByName(plans, allowMissingColumns=True)
    return both.repartition(key).sortWithinPartitions(key, F.col("plan").isNull(), *_ORDER).select(key, "role", "text", "plan")


def repaired_turns(rows: DataFrame, key: str) -> DataFrame:
    """``key, number, edit, role, text``: conversations as they are after the
    edits, numbered from 0.  Defined results as for ``repair_plans``."""
    ready = _with_plans(rows, key)
    kind = to_arrow_type(ready.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for k, own in groupby(_rows(batches), lambda row: row[0]):
                plan = next(own)[3]
                yield from ((k, n, *turn) for n, turn in enumerate(edited(plan["audit"], ((role, text) for _, role, text, _ in own))))

        made, size = [], 0
        for row in flat():
            made.append(row)
            size += len(row[4])
            if len(made) >= ROWS or size >= CHARS:
                yield _batch(made)
                made, size = [], 0
        if made:
            yield _batch(made)

    def _batch(made: list[tuple]) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in made], t) for c, t in enumerate(kinds)], names=[key, "number", "edit", "role", "text"])

    return ready.mapInArrow(run, f"{key} {ready.schema[key].dataType.simpleString()}, number bigint, edit string, role string, text string")


def repair_digests(rows: DataFrame, key: str) -> DataFrame:
    """The plans with ``repaired_sha256``, the digest of the repaired turns as
    ``role:text`` lines, taken while they are streamed."""
    ready = _with_plans(rows, key)
    kind = to_arrow_type(ready.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for k, own in groupby(_rows(batches), lambda row: row[0]):
            plan, digest, between = next(own)[3], sha256(), ""
            for _, role, text in edited(plan["audit"], ((role, text) for _, role, text, _ in own)):
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
            made.append((k, *plan.values(), digest.hexdigest()))
            size += len(plan["audit"])
            if len(made) >= ROWS or size >= CHARS:
                yield _batch(made)
                made, size = [], 0
        if made:
            yield _batch(made)

    def _batch(made: list[tuple]) -> pa.RecordBatch:
        kinds = (kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in made], t) for c, t in enumerate(kinds)], names=[key, *COUNTS, "audit", "repaired_sha256"])

    return ready.mapInArrow(run, f"{key} {ready.schema[key].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string")


# -- damage, to have something to repair


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of conversations, one in twenty rows each
    dropped, emptied, without the ends of its sentences, doubled, or given to
    the user, as the CRC-32 of ``conv_id:turn`` says.  Nulls are one space."""
    space = F.lit(" ")
    told = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), told.alias("_told")).where("_told <> 0")
    role = F.when(F.col("_told") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_told") == 1, "").when(F.col("_told") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_told") == 3, 2).otherwise(1).alias("_times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy")).drop("_copy")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations after damage; those of which no row is
    left have nothing but zeros."""
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    found = repair_digests(damaged(conversations), "conv_id")
    both = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    none = {c: 0 for c in COUNTS} | {"audit": "", "repaired_sha256": sha256().hexdigest()}
    return both.select(F.col("_id").alias("conv_id"), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()))


def op12_sql() -> str:
    """The same by two recursions: costs of the four states back from the last
    row, then the edits forward, the ASCII-least of the tight ones."""
    kept = "CASE WHEN q = 0 AND c = 0 THEN 1 WHEN q <> 2 AND c = 1 THEN 2 WHEN q = 2 AND c = 2 THEN 3 END"
    fits = {0: "CASE c WHEN 0 THEN b1 WHEN 1 THEN b2 ELSE 99999999 END", 1: "CASE c WHEN 1 THEN b2 ELSE 99999999 END", 2: "CASE c WHEN 2 THEN b3 ELSE 99999999 END", 3: "CASE c WHEN 1 THEN b2 ELSE 99999999 END"}
    row = lambda q: f"least(b{q} + 3, CASE WHEN f < 2 THEN least({fits[q]}, b{AWAITED[q]} + 2) + f ELSE 99999999 END) AS r{q}"
    return f"""
    WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc32_of AS k FROM (
        SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::UBIGINT)),
            lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda h, z: (CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384::UBIGINT) ELSE h >> 1 END))) AS crc_of,
            xor(crc_of, 4294967295::UBIGINT) % 20 AS crc32_of
        FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations))),
    g AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM d, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM g),
    h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), seen) - 1 AS i,
                 rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM o),
    r AS (SELECT conv_id, turn, role, text, i, CASE WHEN said = '' THEN 2 WHEN seen > 1 THEN 3 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS f,
                 CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS c FROM h),
    n AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
    back AS (SELECT conv_id, n AS i, 0 AS b0, 4 AS b1, 2 AS b2, 0 AS b3 FROM n
             UNION ALL
             SELECT conv_id, i, least(r0, 2 + least(r2, 2 + r3)), least(r1, 2 + least(r2, 2 + r3)), least(r2, 2 + r3), least(r3, 2 + r2)
             FROM (SELECT r.conv_id, r.i, {', '.join(row(q) for q in range(4))} FROM back b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
    steps AS (SELECT r.conv_id, r.i, r.role, r.text, r.c, r.f, a.b0, a.b1, a.b2, a.b3, [p.b0, p.b1, p.b2, p.b3] AS own
              FROM r JOIN back a ON a.conv_id IS NOT DISTINCT FROM r.conv_id AND a.i = r.i + 1 JOIN back p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i),
    walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS step, '' AS edit, NULL::VARCHAR AS line FROM n
             UNION ALL
             SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE awaited END, step + 1, edit,
                    CASE edit WHEN 'I' THEN who || ':' WHEN 'R' THEN who || ':' || text WHEN 'K' THEN role || ':' || text END
             FROM (SELECT w.conv_id, w.i, w.q, w.step, s.role, s.text, {kept} AS kept, CASE q WHEN 2 THEN 3 ELSE 2 END AS awaited, CASE q WHEN 2 THEN 'assistant' ELSE 'user' END AS who,
                          CASE WHEN s.i IS NULL THEN 'I'
                               WHEN 3 + [b0, b1, b2, b3][q + 1] = own[q + 1] THEN 'D'
                               WHEN 2 + own[CASE q WHEN 2 THEN 4 ELSE 3 END] = own[q + 1] THEN 'I'
                               WHEN f < 2 AND ({kept}) IS NOT NULL AND f + [b0, b1, b2, b3][({kept}) + 1] = own[q + 1] THEN 'K'
                               ELSE 'R' END AS edit
                   FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i
                   WHERE w.i < n.n OR w.q IN (1, 2))),
    told AS (SELECT conv_id, string_agg(edit, '' ORDER BY step) AS audit, sha256(coalesce(string_agg(line, chr(10) ORDER BY step), '')) AS repaired_sha256 FROM walk GROUP BY conv_id),
    pairs AS (SELECT conv_id, count(*) FILTER (before || now NOT IN ('su', 'ua', 'au')) AS illegal
              FROM (SELECT conv_id, left(role, 1) AS now, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 2) AS blank, count(*) FILTER (f = 3) AS duplicate, count(*) FILTER (f = 1) AS truncated FROM r GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM a.conv_id
         LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 0
    """
