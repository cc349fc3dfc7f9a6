"""Damaged conversations and their cheapest repair, by DuckDB recursion inside batches dealt by conversation.

Spark damages the rows, makes equal rows of a turn one with a count, finds what
was said before by a window over (conversation, role, text), and deals rows by
conversation, sorted by turn. Each task reads its conversations in batches. In a
batch one recursive query takes a turn of all conversations at each step and
keeps, for every state of the grammar `(s?(ua)+)?`, the least cost and of equal
costs the least audit. A conversation of more than BLOCK rows goes through in
blocks, each from every state in which it may begin; costs, audits and the
repaired text's running hash go from block to block, so memory holds a batch
whatever a conversation's length. (Its audit is one value, and its hash has to be
taken in order, so a conversation is one task's, but equal rows are not.)

States: 0 nothing yet, 1 after a system row, 2 after a user's, 3 after an
assistant's. An audit's letters say what the state is, and the state says whom a
re-roled or inserted row is given to, so (cost, audit) tells one repair. No audit
begins with another of the same state, rows and cost, as more inserts cost more;
so the least audit of each state is enough.

Defined results: null role and text are one space (blank), and null ids and turns
are one in the damage's key; a null conv_id is a conversation like any other, null
turns come first and don't count as turns; rows of one turn are ordered by role
and text; repeated rows are rows of their own; a conversation without rows has
zeros, an empty audit and the hash of nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a conversation that one recursion goes through, and of a batch.
BLOCK, BATCH = 256, 20_000
START, SYSTEM, USER, ASSISTANT = range(4)
SPACE = "\\x20\\x09-\\x0D"


def _next(state: int) -> tuple[int, str]:
    """The state and role that re-roled and inserted rows lead to."""
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that stays, None where the grammar has no place for it."""
    if initial == "s" and state == START:
        return SYSTEM
    return _next(state)[0] if initial == _next(state)[1][0] else None


def step_table() -> pa.Table:
    """code, state, to_state, cost, act, tail: one row's ways from state to state, with up to two inserts after it.

    code: `d` for a row that has to go, else its role's initial (x for none of s,
    u, a), upper case if it is truncated. Inserts also stand before the first row.
    """
    rows = []
    for code in "dsuaxSUAX":
        for state in range(4):
            ways = [("D", state, DELETE)]
            if code != "d":
                more = TRUNCATED * code.isupper()
                ways.append(("R", _next(state)[0], REROLE + more))
                if (to := _kept(state, code.lower())) is not None:
                    ways.append(("K", to, KEEP + more))
            for act, to, cost in ways:
                rows += [(code, state, t, cost + c, act, tail) for t, c, tail in inserts(to)]
    names = ("code", "state", "to_state", "cost", "act", "tail")
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})


def inserts(state: int) -> list[tuple[int, int, str]]:
    """State, cost and letters with none, one or two rows inserted."""
    one = _next(state)[0]
    return [(state, 0, ""), (one, INSERT, "I"), (_next(one)[0], 2 * INSERT, "II")]


_REPAIR = """WITH RECURSIVE dp AS (
        SELECT s.b, 0 AS i, s.origin, s.state, s.cost, s.audit, k.codes, k.more FROM starts s JOIN blocks k ON k.b = s.b
        UNION ALL
        SELECT b, i, origin, state, best.cost, best.audit, codes, more FROM (
            SELECT dp.b, dp.i + 1 AS i, origin, to_state AS state, any_value(codes) AS codes, any_value(more) AS more,
                min({'cost': dp.cost + step.cost + $delete * more[i + 1], 'audit': audit || act || repeat('D', more[i + 1]) || tail}) AS best
            FROM dp JOIN step ON step.state = dp.state AND step.code = codes[i + 1] WHERE i < length(codes) GROUP BY dp.b, dp.i, origin, to_state))
    SELECT b, origin, state, cost, audit FROM dp WHERE i = length(codes)"""


def _database():
    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
    db.execute("SET temp_directory = ''")
    ways = step_table()  # noqa: F841  read by name in SQL
    db.execute("CREATE TABLE step AS SELECT * FROM ways")
    return db


def _solved(db, blocks: list[tuple[str, list[int], bool]]) -> list[dict[tuple[int, int], tuple[int, str]]]:
    """For each block (codes, more, whether it begins a conversation): (origin, state) to the least (cost, audit)."""
    first = [(START, s, c, a) for s, c, a in inserts(START)]
    later = [(s, s, 0, "") for s in range(4)]
    rows = [(b, *x) for b, (_, _, begins) in enumerate(blocks) for x in (first if begins else later)]
    starts = pa.table({"b": [r[0] for r in rows], "origin": [r[1] for r in rows], "state": [r[2] for r in rows], "cost": pa.array([r[3] for r in rows], pa.int64()), "audit": [r[4] for r in rows]})  # noqa: F841
    held = pa.table({"b": range(len(blocks)), "codes": [x[0] for x in blocks], "more": pa.array([x[1] for x in blocks], pa.list_(pa.int64()))})  # noqa: F841
    db.execute("CREATE OR REPLACE TABLE blocks AS SELECT * FROM held")
    out: list[dict] = [{} for _ in blocks]
    for b, origin, state, cost, audit in db.execute(_REPAIR, {"delete": DELETE}).fetchall():
        out[b][origin, state] = (cost, audit)
    return out


class _Conversation:
    """What is known of a conversation whose rows are still being read."""

    def __init__(self, conv):
        self.conv, self.rows, self.paths = conv, [], {START: (0, "", hashlib.sha256(), False)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None
        self.begun = False

    def add(self, turn, role: str, text: str, times: int, blank: bool, first: bool, truncated: bool) -> None:
        initial, gone = role[:1], blank or not first
        self.blank += times * blank
        self.duplicate += 0 if blank else times - first
        self.truncated += first and truncated and not blank
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.illegal += times - 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.before = initial
        code = initial if initial in ("s", "u", "a") else "x"
        self.rows.append(("d" if gone else code.upper() if truncated else code, times - 1, role, text))

    def take(self, rows: list, found: dict[tuple[int, int], tuple[int, str]]) -> None:
        """Go on by a block: the best way to each state, with its hash."""
        paths = {}
        for (origin, state), (cost, audit) in found.items():
            if origin in self.paths:
                way = (self.paths[origin][0] + cost, self.paths[origin][1] + audit, origin, audit)
                paths[state] = min(paths.get(state, way), way)
        self.paths = {s: (c, a, *self._hashed(o, mine, rows)) for s, (c, a, o, mine) in paths.items()}

    def _hashed(self, origin: int, audit: str, rows: list):
        _, _, old, some = self.paths[origin]
        hashed, state, place, at, left = old.copy(), origin, 0, 0, 0
        for letter in audit:
            if letter == "I":
                state, role = _next(state)
                line = f"{role}:"
            elif left:  # a repeat
                left -= 1
                continue
            else:
                code, left, role, text = rows[at]
                at += 1
                if letter == "D":
                    continue
                if letter == "R":
                    state, role = _next(state)
                else:
                    state = _kept(state, code.lower())
                line = f"{role}:{text}"
            hashed.update((("\n" if some else "") + line).encode())
            some = True
        return hashed, some

    def result(self) -> tuple:
        cost, audit, hashed, _ = min((self.paths[s] for s in (START, ASSISTANT) if s in self.paths), key=lambda x: x[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, hashed.hexdigest()


def _repaired(kind: pa.DataType, block: int, batch_rows: int):
    schema = pa.schema([("conv_id", kind), *((n, pa.int64()) for n in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def step(db, held: list[_Conversation], over: bool):
        """Solve what is held; all but the last conversation have ended, and that too if over."""
        blocks = []
        for c in held:
            for i in range(0, len(c.rows), block):
                blocks.append((c, c.rows[i : i + block], not c.begun))
                c.begun = True
        found = _solved(db, [("".join(r[0] for r in rows), [r[1] for r in rows], begins) for _, rows, begins in blocks])
        for (c, rows, _), x in zip(blocks, found, strict=True):
            c.take(rows, x)
            c.rows = []
        done = [c.result() for c in (held if over else held[:-1])]
        return pa.record_batch([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches):
        db, held, rows = _database(), [], 0
        for batch in batches:
            for conv, turn, role, text, times, blank, first, truncated in zip(*(batch[c].to_pylist() for c in ROW), strict=True):
                if not held or held[-1].conv != conv:
                    held.append(_Conversation(conv))
                if times:
                    held[-1].add(turn, role, text, times, blank, first, truncated)
                    rows += 1
                if rows >= batch_rows:
                    yield step(db, held, False)
                    held, rows = held[-1:], 0
        if held:
            yield step(db, held, True)

    return run


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ROW = ("conv", "turn", "role", "text", "times", "blank", "first", "truncated")


def damaged(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, times: what is left of the rows, equal ones counted; and a row of 0 times for each conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    left = rows.filter("hit <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).cast("long").alias("times"))
    counted = left.groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times"))
    before = Window.partitionBy("conv", "role", "text")
    place: Column = F.struct(F.col("turn").isNotNull(), "turn")
    counted = counted.withColumn("first", place.eqNullSafe(F.min(place).over(before)))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    ended = F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    whole = counted.select("conv", "turn", "role", "text", "times", blank.alias("blank"), "first", (~ended).alias("truncated"))
    none = rows.select("conv").distinct().selectExpr("conv", "cast(null as bigint) turn", "'' role", "'' text", "0L times", "false blank", "false first", "false truncated")
    return whole.unionByName(none)


def repair(turns: DataFrame, block: int = BLOCK, batch_rows: int = BATCH) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = turns.schema["conv_id"].dataType
    rows = damaged(turns).repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").select(*ROW)
    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{n} long' for n in NUMBERS)}, audit string, repaired_sha256 string"
    return rows.mapInArrow(_repaired(to_arrow_type(kind), block, batch_rows), schema)


def op13(turns: DataFrame) -> DataFrame:
    return repair(turns)


_CRC = """list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
SQL = rf"""WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC}, 4294967295) % 20 AS hit FROM conversations),
    d AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(CASE hit WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE hit <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
    f AS (SELECT conv_id, turn, role, text, pos, left(role, 1) AS ini, left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair,
          CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
               WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault FROM o),
    c AS (SELECT conv_id, count(f.pos) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps, coalesce(count_if(fault = 'b'), 0) AS blank, coalesce(count_if(fault = 'd'), 0) AS duplicate,
          coalesce(count_if(fault = 't'), 0) AS truncated, coalesce(count_if(pair NOT IN ('su', 'ua', 'au')), 0) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id) GROUP BY conv_id),
    dp AS (SELECT conv_id, 0::BIGINT AS i, n, x.state, x.cost, x.audit, x.said FROM c, (VALUES ('', 0::BIGINT, '', []::VARCHAR[]), ('u', 3, 'I', ['user:']), ('a', 6, 'II', ['user:', 'assistant:'])) x(state, cost, audit, said)
        UNION ALL
        SELECT conv_id, i, n, state, best.cost, best.audit, best.said FROM (SELECT conv_id, i, any_value(n) AS n, state, min(way) AS best FROM (
            SELECT conv_id, i + 1 AS i, n, CASE t WHEN 0 THEN w.state WHEN 1 THEN CASE w.state WHEN 'u' THEN 'a' ELSE 'u' END ELSE CASE w.state WHEN 'u' THEN 'u' ELSE 'a' END END AS state,
                {{'cost': w.cost + 3 * t, 'audit': w.audit || repeat('I', t), 'said': w.said || CASE t WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [CASE w.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END]
                    ELSE CASE w.state WHEN 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END}} AS way
            FROM (SELECT dp.conv_id, dp.i, dp.n, unnest(list_filter([
                    {{'ok': true, 'state': dp.state, 'cost': dp.cost + 4, 'audit': audit || 'D', 'said': said}},
                    {{'ok': fault NOT IN ('b', 'd') AND CASE WHEN dp.state = 'u' THEN ini = 'a' WHEN dp.state = '' THEN ini IN ('s', 'u') ELSE ini = 'u' END, 'state': ini, 'cost': dp.cost + CASE fault WHEN 't' THEN 3 ELSE 0 END, 'audit': audit || 'K', 'said': said || [role || ':' || text]}},
                    {{'ok': fault NOT IN ('b', 'd'), 'state': CASE dp.state WHEN 'u' THEN 'a' ELSE 'u' END, 'cost': dp.cost + CASE fault WHEN 't' THEN 6 ELSE 3 END, 'audit': audit || 'R',
                      'said': said || [CASE dp.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text]}}], lambda w: w.ok)) AS w
                FROM dp JOIN f ON f.conv_id = dp.conv_id AND f.pos = dp.i + 1), (VALUES (0), (1), (2)) v(t)) GROUP BY conv_id, i, state)),
    e AS (SELECT conv_id, min({{'cost': cost, 'audit': audit, 'said': said}}) AS best FROM dp WHERE i = n AND state IN ('', 'a') GROUP BY conv_id)
    SELECT conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
        sha256(array_to_string(best.said, chr(10))) AS repaired_sha256 FROM c JOIN e USING (conv_id)"""
