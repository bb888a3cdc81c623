"""Repair of damaged conversations at the least cost, with the audit of the edits.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Every row is kept (0),
given the role of a user or an assistant (1) or deleted (2); rows with an empty text may be put in
anywhere (5). Blank and duplicate rows must go, and a truncated row that stays costs 5 more. Among
the cheapest edits, the one whose initials (K, R, D, I in order) come first in ASCII counts.

The search walks the rows with four states (nothing yet, a system row, a user row, an assistant
row). The best edits up to a state are a node of ``Audits``; ties compare by longest common prefix.
For one start the audit decides the edits, so no audit of a state is the beginning of another of
that state, and the better prefix stays the better one whatever follows.

Conversations are dealt by id and worked off as sorted streams. One of more than ``chunk`` rows is
cut: its rows get their number in order, each chunk is solved for every state that it may begin in,
and the chunks' audits are strung together as pieces of the same linked nodes. Only the table of
chunks, the final audit and the running hash of the repaired text see such a conversation whole,
and the text passes through the hash as a stream of blocks.

Edge cases: null turns come first, rows of one turn are ordered by role and text. A null role or
text is one space, so the text is blank. A null id is a conversation of its own. Conversations
without rows have no gaps, faults or cost, and an empty audit. A role of no letters has no initial
that the pattern knows. Repeated rows are duplicates. Further columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tallyscope.llm.audits import Audits
from tallyscope.llm.registry import crc32_sql
from tallyscope.llm.storage import stored
from tallyscope.operators.ordered import scan

#: Rows of a conversation that are solved at once.
CHUNK = 4096
#: Characters of a block of repaired text.
BLOCK = 1 << 20
SPACES = " \t\n\x0b\x0c\r"

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row, by state and initial of the role.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: State after a row whose role is chosen.
CHOSEN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
COST = {"D": 2, "R": 1, "I": 5, "cut": 5}
LEGAL = ("su", "ua", "au")

Live = dict[int, tuple[int, int]]


def _offer(audits: Audits, held: dict, state: int, cost: int, parent: int, edit: str) -> None:
    """Keep the better of what the state holds and ``parent`` with ``edit``."""
    now = held.get(state)
    if now is None or cost < now[0]:
        held[state] = (cost, parent, edit)
    elif cost == now[0]:
        if now[1] == parent:
            better = edit < now[2]
        else:
            better = audits.less(audits.add(parent, edit), audits.add(now[1], now[2]))
        if better:
            held[state] = (cost, parent, edit)


def _settled(audits: Audits, held: dict) -> Live:
    """A node for each state, after rows put in where that is no dearer."""
    live = {s: (c, audits.add(p, e) if e else p) for s, (c, p, e) in held.items()}
    again = True
    while again:
        again = False
        for state, (cost, node) in sorted(live.items()):
            to = CHOSEN[state]
            if to not in live or cost + COST["I"] <= live[to][0]:
                put = audits.add(node, "I")
                if to not in live or cost + COST["I"] < live[to][0] or audits.less(put, live[to][1]):
                    live[to] = (cost + COST["I"], put)
                    again = True
    return live


def solve(audits: Audits, live: Live, rows: Sequence[tuple[str, int]]) -> Live:
    """The best edits after ``(initial, fault)`` rows, from those before them."""
    for initial, fault in rows:
        held: dict = {}
        for state, (cost, node) in live.items():
            _offer(audits, held, state, cost + COST["D"], node, "D")
            if fault in (SOUND, TRUNCATED):
                stay = cost + (COST["cut"] if fault == TRUNCATED else 0)
                to = KEPT.get((state, initial))
                if to is not None:
                    _offer(audits, held, to, stay, node, "K")
                _offer(audits, held, CHOSEN[state], stay + COST["R"], node, "R")
        live = _settled(audits, held)
    return live


def first_live(audits: Audits) -> Live:
    """Before the first row."""
    return _settled(audits, {START: (0, 0, "")})


def best(audits: Audits, live: Live) -> tuple[int, int]:
    """Cost and node of the best sound ending."""
    ends = [live[s] for s in (START, ASSISTANT) if s in live]
    a = ends[0]
    for b in ends[1:]:
        if b[0] < a[0] or (b[0] == a[0] and audits.less(b[1], a[1])):
            a = b
    return a


def rendered(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[str]:
    """The repaired ``role:text`` lines of ``(role, text)`` rows, from a state on."""
    source = iter(rows)
    for edit in audit:
        role, text = next(source) if edit != "I" else ("", "")
        if edit == "K":
            state = KEPT[state, role[:1]]
            yield f"{role}:{text}"
        elif edit in "RI":
            state = CHOSEN[state]
            yield f"{ROLE[state]}:{text}"


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` after the damage that a row's key draws; lost rows stay as ``gone``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    out = rows.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind <= 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("_times"),
    )
    return out.withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times")


def _order() -> list[Column]:
    return [F.col("turn"), F.col("role"), F.col("text")]


def _fault(text: str) -> int:
    """Fault of a text that is no duplicate."""
    last = text.rstrip(SPACES)[-1:]
    return BLANK if not last else SOUND if last in ".!?" else TRUNCATED


def _streams(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Key and rows (without the key) of each run of equal leading columns, across batches."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if now is not None:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if now is not None:
        yield now, held


class _Summary:
    """Turns, faults and neighbours of rows in order."""

    def __init__(self) -> None:
        self.first = self.last = None  # initials
        self.counts, self.illegal = [0, 0, 0, 0], 0
        self.least = self.most = None
        self.turns = 0

    def row(self, initial: str, fault: int, turn: int | None) -> None:
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        self.counts[fault] += 1
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def join(self, first, last, blank, duplicate, truncated, illegal, least, most, turns) -> None:
        """Rows that follow."""
        self.illegal += illegal + (self.last is not None and self.last + first not in LEGAL)
        self.first, self.last = first if self.first is None else self.first, last
        for k, n in ((BLANK, blank), (DUPLICATE, duplicate), (TRUNCATED, truncated)):
            self.counts[k] += n
        if turns:
            self.turns += turns - (least == self.most)
            self.least, self.most = least if self.least is None else self.least, most

    def values(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def _result_schema(rows: DataFrame, more: str) -> StructType:
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(more).fields])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _emitted(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _short(rows: DataFrame) -> DataFrame:
    """The result of conversations whose rows fit a task."""
    schema = _result_schema(rows, f"{_COUNTS}, cost long, audit string, repaired_sha256 string")
    arrow = to_arrow_schema(schema)

    def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), group in _streams(batches, 1):
            seen, summary, steps, texts = set(), _Summary(), [], []
            for turn, role, text, gone in group:
                if gone:
                    continue
                fault = _fault(text)
                if fault != BLANK and (role, text) in seen:
                    fault = DUPLICATE
                seen.add((role, text))
                summary.row(role[:1], fault, turn)
                steps.append((role[:1], fault))
                texts.append((role, text))
            audits = Audits()
            cost, node = best(audits, solve(audits, first_live(audits), steps))
            audit = audits.text(node)
            whole = "\n".join(rendered(texts, audit))
            yield conv, *summary.values(), cost, audit, hashlib.sha256(whole.encode()).hexdigest()

    dealt = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    return dealt.mapInArrow(lambda batches: _emitted(solved(batches), arrow), schema)


def _long(rows: DataFrame, chunk: int) -> DataFrame:
    """The result of conversations of any length, cut into chunks."""
    numbered = scan(rows.where(~F.col("gone")).drop("gone"), ["conv_id"], _order(), number="_pos")
    same = F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256)
    numbered = stored(numbered.withColumn("_same", same).withColumn("_chunk", F.floor((F.col("_pos") - 1) / chunk)), "repair-rows")
    # the first of equal rows, found by its number, so that no join meets all copies of a row
    firsts = numbered.groupBy("conv_id", "_same").agg(F.min("_pos").alias("_pos")).select(F.col("conv_id").alias("_c"), F.col("_pos").alias("_p"), F.lit(True).alias("_new"))
    trimmed = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = (
        F.when(trimmed == "", BLANK).when(F.col("_new").isNull(), DUPLICATE)
        .when(trimmed.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    )
    coded = numbered.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_pos") == F.col("_p")), "left").select(
        "conv_id", "_chunk", "_pos", F.substring("role", 1, 1).alias("_initial"), fault.alias("_fault"), "turn"
    )
    turn = rows.schema["turn"].dataType.simpleString()
    schema = _result_schema(
        rows,
        "_chunk long, _first string, _last string, blank long, duplicate long, truncated long, illegal long, "
        f"_least {turn}, _most {turn}, _turns long, _ways array<struct<start:int,end:int,cost:long,audit:string>>",
    )
    arrow = to_arrow_schema(schema)

    def ways(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, number), group in _streams(batches, 2):
            summary, steps = _Summary(), []
            for _, initial, fault, turn in group:
                summary.row(initial, fault, turn)
                steps.append((initial, fault))
            found = []
            for start in range(4) if number else [START]:
                audits = Audits()
                live = {start: (0, 0)} if number else first_live(audits)
                found += [(start, end, cost, audits.text(node)) for end, (cost, node) in solve(audits, live, steps).items()]
            _, blank, duplicate, truncated, illegal = summary.values()
            ends = [dict(zip(("start", "end", "cost", "audit"), w)) for w in found]
            yield conv, number, summary.first, summary.last, blank, duplicate, truncated, illegal, summary.least, summary.most, summary.turns, ends

    dealt = coded.repartition("conv_id", "_chunk").sortWithinPartitions("conv_id", "_chunk", "_pos")
    chunks = stored(dealt.mapInArrow(lambda batches: _emitted(ways(batches), arrow, 20), schema), "repair-chunks")

    schema = _result_schema(rows, f"{_COUNTS}, cost long, audit string, _pieces array<struct<chunk:long,start:int,audit:string>>")
    joined_arrow = to_arrow_schema(schema)

    def strung(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), group in _streams(batches, 1):
            audits, live, summary, state_of = Audits(), {START: (0, 0)}, _Summary(), {0: START}
            for _, *told, found in group:
                summary.join(*told)
                held: dict = {}
                for way in found:
                    if way["start"] in live:
                        cost, node = live[way["start"]]
                        _offer(audits, held, way["end"], cost + way["cost"], node, way["audit"])
                live = {s: (c, audits.add(p, e)) for s, (c, p, e) in held.items()}
                state_of |= {node: s for s, (_, node) in live.items()}
            cost, node = best(audits, live)
            audit, pieces = audits.text(node), []
            for number, *_ in reversed(group):
                before = audits.parent[node]
                pieces.append({"chunk": number, "start": state_of[before], "audit": audits.piece[node]})
                node = before
            yield conv, *summary.values(), cost, audit, pieces

    dealt = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "_chunk")
    told = stored(dealt.mapInArrow(lambda batches: _emitted(strung(batches), joined_arrow, 1), schema), "repair-audits")

    # each chunk's piece goes before its rows
    pieces = told.select("conv_id", F.explode("_pieces").alias("p")).select(
        "conv_id", F.col("p.chunk").alias("_chunk"), F.lit(0).cast("long").alias("_pos"), F.col("p.start").alias("start"), F.lit("").alias("role"), F.col("p.audit").alias("text")
    )
    texts = numbered.select("conv_id", "_chunk", "_pos", F.lit(0).alias("start"), "role", "text").unionByName(pieces)
    schema = _result_schema(rows, "_chunk long, _block int, text string")
    block_arrow = to_arrow_schema(schema)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, number), group in _streams(batches, 2):
            _, start, _, audit = group[0]
            held, size, block = [], 0, 0
            for line in rendered(((role, text) for *_, role, text in group[1:]), audit, start):
                held.append(line)
                size += len(line)
                if size >= BLOCK:
                    yield conv, number, block, "\n".join(held)
                    held, size, block = [], 0, block + 1
            if held:
                yield conv, number, block, "\n".join(held)

    dealt = texts.repartition("conv_id", "_chunk").sortWithinPartitions("conv_id", "_chunk", "_pos")
    lines = dealt.mapInArrow(lambda batches: _emitted(blocks(batches), block_arrow, 4), schema)
    schema = _result_schema(rows, "repaired_sha256 string")
    hash_arrow = to_arrow_schema(schema)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        now, digest = None, None
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if digest is None or conv != now:
                    if digest is not None:
                        yield now, digest.hexdigest()
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode())
        if digest is not None:
            yield now, digest.hexdigest()

    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "_chunk", "_block")
    hashes = dealt.mapInArrow(lambda batches: _emitted(hashed(batches), hash_arrow), schema).withColumnRenamed("conv_id", "_c")
    out = told.drop("_pieces").join(hashes, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation.

    ``rows`` has ``(conv_id, turn, role, text)``; rows with a true ``gone`` only name their conversation.
    """
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    filled = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled, gone.alias("gone"))
    sizes = rows.groupBy("conv_id").agg(F.count(F.when(~F.col("gone"), 1)).alias("n"))
    large = stored(sizes.where(F.col("n") > chunk).select(F.col("conv_id").alias("_large")), "repair-large")
    if large.isEmpty():
        return _short(rows)
    same = F.col("conv_id").eqNullSafe(F.col("_large"))
    return _short(rows.join(large, same, "left_anti")).unionByName(_long(rows.join(large, same, "left_semi"), chunk))


def _least_sql(*ways: str) -> str:
    """The best of several ``{c, a, t}``: cost, audit and the lines that come with it."""
    return f"list_sort([{', '.join(ways)}])[1]"


def _way_sql(state: str, cost: str, edit: str, line: str = "''", when: str = "true") -> str:
    return f"{{'c': {state}.c + CASE WHEN {when} THEN {cost} ELSE 1000000000 END, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}}"


def _put_in_sql(columns: str, source: str) -> str:
    """User rows put in after any state but that of a user, then assistant rows after users."""
    user = _least_sql("q2", *[_way_sql(f"q{k}", "5", "I", "'user:' || chr(10)") for k in (0, 1, 3)])
    return (
        f"SELECT {columns}, q0, q1, u2, {_least_sql('q3', _way_sql('u2', '5', 'I', "'assistant:' || chr(10)"))} AS u3 "
        f"FROM (SELECT *, {user} AS u2 FROM ({source}))"
    )


def _step_sql() -> str:
    """The states after row ``i`` from ``s0`` to ``s3`` before it."""
    stay, lines = "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)", {"K": "role || ':' || txt || chr(10)", "u": "'user:' || txt || chr(10)", "a": "'assistant:' || txt || chr(10)"}
    may = "fault NOT IN ('blank', 'duplicate')"
    ways = {k: [_way_sql(f"s{k}", "2", "D")] for k in range(4)}
    for (state, initial), to in KEPT.items():
        ways[to].append(_way_sql(f"s{state}", stay, "K", lines["K"], f"{may} AND left(role, 1) = '{initial}'"))
    for state, to in CHOSEN.items():
        ways[to].append(_way_sql(f"s{state}", f"{stay} + 1", "R", lines["u" if to == USER else "a"], may))
    return ", ".join(f"{_least_sql(*ways[k])} AS q{k}" for k in range(4))


_NONE = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
_BEGIN = "{'c': 0::BIGINT, 'a': '', 't': ''}"
#: The query's rows in SQL, for tables without null ids and two different rows of one turn.
SQL = rf"""
WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0, {crc32_sql("(conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r0 END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS txt,
             unnest(range(0, CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM g),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, copy) AS i, rtrim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM y),
d AS (SELECT conv_id, turn, role, txt, i, before, CASE WHEN ended = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(ended, 1) IN ('.', '!', '?') THEN 'sound' ELSE 'truncated' END AS fault FROM z),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM d GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations),
v(conv_id, i, s0, s1, s2, s3) AS (
    {_put_in_sql("conv_id, i", f"SELECT conv_id, 0::BIGINT AS i, {_BEGIN} AS q0, {_NONE} AS q1, {_NONE} AS q2, {_NONE} AS q3 FROM a")}
    UNION ALL
    {_put_in_sql("conv_id, i", f"SELECT v.conv_id, d.i, {_step_sql()} FROM v JOIN d ON d.conv_id = v.conv_id AND d.i = v.i + 1")}
),
w AS (SELECT a.conv_id, c.*, {_least_sql("s0", "s3")} AS o FROM a LEFT JOIN c ON c.conv_id = a.conv_id JOIN v ON v.conv_id = a.conv_id AND v.i = coalesce(c.n, 0))
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       o.c AS cost, o.a AS audit, sha256(CASE WHEN o.t = '' THEN '' ELSE left(o.t, length(o.t) - 1) END) AS repaired_sha256 FROM w
"""
