"""Conversation structure repair: the cheapest edits after which roles run ``(s?(ua)+)?``.

Turns are kept, reroled to user or assistant, or deleted, and empty turns are inserted. Which turns to retain is a
dynamic programme over retained turns, from the last to the first: the gap up to the next retained turn costs its
prefix sum of deletions, the best next turn of each role is a running minimum, and the pair of roles says how many
turns to insert. Among equally cheap edits the ASCII-least string of their initials is taken. As D sorts before I, K
and R, that is decided in place: the later next turn, then more insertions, then keeping.

Conversations are range-partitioned by their turns, so a long one is spread over tasks. A task holds one
conversation's rows of its own range. For a conversation that goes over a border the first pass gives a min-plus
matrix of four by four states per piece, at most two pieces a task; the driver multiplies these few matrices and hands
each piece its state at the start and the costs behind its end. Only the digest of such a conversation's text is
taken by one task, in chunks, as it has to be: SHA-256 goes from front to back.

Nulls: a null role or text is one space; null turns come first; null conversations are one conversation. Rows of
one turn are taken by role, then text. A conversation whose rows are all dropped has a row of zeros. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.durable import cut, in_batches


@dataclass(frozen=True)
class RepairCosts:
    insert: int = 3
    rerole: int = 3
    delete: int = 4
    #: Added for a truncated turn that stays.
    truncated: int = 3


_SPACE = " \t\n\x0b\x0c\r"
_STATES = ("", "s", "u", "a")
_ROLES = {"u": "user", "a": "assistant"}
#: Turns to insert before a retained one, by the retained one before it; pairs that are not here cannot be mended.
_INSERTS = (
    {"s": 0, "u": 0, "a": 1},
    {"u": 0, "a": 1},
    {"u": 1, "a": 0},
    {"u": 0, "a": 1},
)
#: Turns to insert at the end, by the last retained one.
_CLOSING = (0, 2, 1, 0)
_CHUNK = 1 << 22


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with a twentieth each of the rows dropped (kept as ``gone``, so that their
    conversation stays known), emptied, without end marks, repeated, or said by the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy"))
    return rows.drop("copy")


def _spread(rows: DataFrame) -> DataFrame:
    """The rows in their order, each with the task that holds it and the first turn that has its role and text."""
    # Lengths in front, so that no other conversation, role and text give the same letters; a null conversation has none.
    conv = F.col("conv_id").cast("string")
    same = F.sha2(F.concat(F.coalesce(F.concat(F.length(conv), F.lit(":"), conv), F.lit("")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("conv_id", "turn", "role", "text", "gone", same.alias("same"))
    # A struct, as a null turn is the least and min() would pass over it.
    first = rows.where("not gone").groupBy("same").agg(F.min(F.struct("turn")).alias("first"))
    rows = rows.join(first, "same", "left")
    early = F.coalesce(F.col("first.turn").isNull() & F.col("turn").isNotNull() | (F.col("first.turn") < F.col("turn")), F.lit(False))
    rows = rows.select("conv_id", "turn", "role", "text", "gone", early.alias("seen"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    rows = rows.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    return cut(rows.withColumn("part", F.spark_partition_id()))


class _Piece:
    """The rows of one conversation in one task."""

    def __init__(self, conv, part: int, rows: list[tuple]):
        self.conv, self.part = conv, part
        self.turns, self.roles, self.texts, self.faults = [], [], [], []
        last = None
        for turn, role, text, gone, seen in rows:
            if gone:
                continue
            inner = text.rstrip(_SPACE)
            same = (turn, role, text)
            fault = "blank" if not inner else "duplicate" if seen or same == last else "truncated" if inner[-1] not in ".!?" else ""
            last = same
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.faults.append(fault)
        self.initials = [r[:1] for r in self.roles]

    def __len__(self) -> int:
        return len(self.turns)


def _choices(piece: _Piece, ahead, costs: RepairCosts) -> tuple[list[float], list[list[tuple]]]:
    """(cost from the first row on by the state before it, what to do next at each row by state): the next retained
    row, its role and the turns inserted before it, or the end. ``ahead``: costs behind the last row, by state."""
    n = len(piece)
    deleted = [costs.delete * j for j in range(n + 1)]
    best = dict.fromkeys("sua", math.inf)
    at = dict.fromkeys("sua", -1)
    later, todo = list(ahead), [()] * n
    for j in range(n - 1, -1, -1):
        fault, initial = piece.faults[j], piece.initials[j]
        if fault not in ("blank", "duplicate"):
            extra = costs.truncated if fault else 0
            for state, r in enumerate(_STATES):
                if r and (r == initial or r in _ROLES):
                    cost = deleted[j] + extra + (0 if r == initial else costs.rerole) + later[state]
                    if cost < best[r]:
                        best[r], at[r] = cost, j
        now, does = [], []
        for state in range(4):
            option = (deleted[n] + ahead[state], -n, 0, 0, "")
            for r, inserts in _INSERTS[state].items():
                if at[r] >= 0:
                    option = min(option, (best[r] + costs.insert * inserts, -at[r], -inserts, piece.initials[at[r]] != r, r))
            now.append(option[0] - deleted[j])
            does.append(option[1:])
        later, todo[j] = now, does
    return later, todo


def _walk(piece: _Piece, todo: list[list[tuple]], state: int, last: bool) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) from the first row on, and at the end ("", state, "")."""
    j, n = 0, len(piece)

    def insert(times: int, state: int):
        for _ in range(times):
            state = 3 if state == 2 else 2
            yield "I", _ROLES[_STATES[state]], ""

    while j < n:
        k, inserts, reroled, r = todo[j][state]
        k, inserts = -k, -inserts
        for _ in range(j, k):
            yield "D", "", ""
        if k == n:
            break
        yield from insert(inserts, state)
        yield ("R", _ROLES[r], piece.texts[k]) if reroled else ("K", piece.roles[k], piece.texts[k])
        state, j = _STATES.index(r), k + 1
    if last:
        yield from insert(_CLOSING[state], state)
    yield "", str(state), ""


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "gone", "seen")))

    for (conv, part), group in groupby(rows(), lambda r: r[:2]):
        yield _Piece(conv, part, [r[2:] for r in group])


def _borders(conv_type: pa.DataType, costs: RepairCosts):
    """The first and the last piece of a task with the costs from each state at its start to each at its end."""

    def give(batches):
        first = last = None
        for piece in _pieces(batches):
            first, last = first or piece, piece
        found = [first] if first is last else [first, last]
        for piece in found if first else []:
            ends = [[0 if t == e else math.inf for t in range(4)] for e in range(4)]
            columns = [_choices(piece, end, costs)[0] for end in ends]
            matrix = [columns[e][t] for t in range(4) for e in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece.conv], conv_type), pa.array([piece.part], pa.int32()), pa.array([matrix], pa.list_(pa.float64()))],
                names=["conv_id", "part", "matrix"])

    return give


def _exits(conv_type: pa.DataType, costs: RepairCosts, ahead: dict):
    """The state after a piece, for each state before it."""

    def give(batches):
        for piece in _pieces(batches):
            if (costs_ahead := ahead.get((piece.conv, piece.part))) is not None:
                todo = _choices(piece, costs_ahead, costs)[1]
                states = [int([*_walk(piece, todo, t, False)][-1][1]) for t in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece.conv], conv_type), pa.array([piece.part], pa.int32()), pa.array([states], pa.list_(pa.int32()))],
                    names=["conv_id", "part", "states"])

    return give


def _over_borders(spread: DataFrame, costs: RepairCosts) -> dict[tuple, tuple[int, list[float], bool]]:
    """{(conversation, task): (state before, costs behind, last piece)} of conversations that are in several tasks. At
    most two pieces of a task are of such, so the driver gets two small rows a task."""
    field = spread.select("conv_id").schema[0]
    kind, arrow = field.dataType.simpleString(), _arrow_type(spread)
    found = spread.mapInArrow(_borders(arrow, costs), f"conv_id {kind}, part int, matrix array<double>").collect()
    by_conv: dict = {}
    for row in found:
        by_conv.setdefault(row["conv_id"], []).append((row["part"], row["matrix"]))
    by_conv = {c: sorted(p) for c, p in by_conv.items() if len(p) > 1}
    ahead = {}
    for conv, pieces in by_conv.items():
        costs_ahead = [float(costs.insert * n) for n in _CLOSING]
        for part, matrix in reversed(pieces):
            ahead[conv, part] = costs_ahead
            costs_ahead = [min(matrix[4 * t + e] + costs_ahead[e] for e in range(4)) for t in range(4)]
    if not ahead:
        return {}
    parts = sorted({part for _, part in ahead})
    near = spread.where(F.col("part").isin(parts))
    exits = {(r["conv_id"], r["part"]): r["states"] for r in near.mapInArrow(_exits(arrow, costs, ahead), f"conv_id {kind}, part int, states array<int>").collect()}
    given = {}
    for conv, pieces in by_conv.items():
        state = 0
        for part, _ in pieces:
            given[conv, part] = (state, ahead[conv, part], part == pieces[-1][0])
            state = exits[conv, part][state]
    return given


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.select("conv_id").schema[0].dataType)


def _plan(piece: _Piece, given: dict, costs: RepairCosts) -> tuple[list[tuple[str, str, str]], int, int]:
    """(edits, their cost, the state after them)."""
    state, ahead, last = given.get((piece.conv, piece.part), (0, [costs.insert * n for n in _CLOSING], True))
    total, todo = _choices(piece, ahead, costs)
    *edits, (_, end, _) = _walk(piece, todo, state, last)
    return edits, int(total[state] - (0 if last else ahead[int(end)])), int(end)


_REPORT = ("part int, piece int, of int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
           "first_turn long, last_turn long, first_role string, last_role string, rows long, cost long, audit string, digest string, chunk binary")  # fmt: skip


def _report(conv_type: pa.DataType, given: dict, costs: RepairCosts, schema: pa.Schema):
    def row(piece: _Piece) -> Iterator[dict]:
        edits, cost, _ = _plan(piece, given, costs)
        # Every line after a break, of which the first of a conversation does not count.
        lines = [f"\n{role}:{text}" for edit, role, text in edits if edit != "D"]
        turns = [t for t in piece.turns if t is not None]
        pairs = zip(piece.initials, piece.initials[1:])
        whole = (piece.conv, piece.part) not in given
        facts = {
            "conv_id": piece.conv, "part": piece.part, "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
            "turns": sum(1 for _ in groupby(turns)), **{f: piece.faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs), "rows": len(piece), "cost": cost,
            "first_role": piece.initials[0] if piece.roles else None, "last_role": piece.initials[-1] if piece.roles else None,
            "audit": "".join(e[0] for e in edits),
        }
        if whole:
            text = hashlib.sha256()
            for i, line in enumerate(lines):
                text.update(line[not i :].encode())
            yield facts | {"piece": 0, "of": 1, "digest": text.hexdigest()}
            return
        # Chunks of a conversation that other tasks hold too.
        data = "".join(lines).encode()
        for at in range(0, max(1, len(data)), _CHUNK):
            yield (facts if not at else {"conv_id": piece.conv, "part": piece.part}) | {"piece": at // _CHUNK, "of": 2, "chunk": data[at : at + _CHUNK]}

    def give(batches):
        held, size = [], 0
        for piece in _pieces(batches):
            for r in row(piece):
                held.append(r)
                size += 200 + len(r.get("audit", "")) + len(r.get("chunk", b""))
                if size > _CHUNK:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return give


def _merge(schema: pa.Schema):
    """One row for each conversation whose pieces come in order."""

    def give(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        for conv, pieces in groupby(rows, lambda r: r["conv_id"]):
            total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0)
            audit, digest, started, before, last_turn, low, high = [], hashlib.sha256(), False, None, None, None, None
            for p in pieces:
                if p["audit"] is not None:
                    for name in total:
                        total[name] += p[name]
                    audit.append(p["audit"])
                    if p["rows"]:
                        total["illegal"] += before is not None and before + p["first_role"] not in ("su", "ua", "au")
                        before = p["last_role"]
                    if p["low"] is not None:
                        total["turns"] -= high == p["low"]
                        low, high = p["low"] if low is None else low, p["high"]
                digest.update(p["chunk"] if started else p["chunk"][1:])
                started = started or bool(p["chunk"])
            gaps = 0 if low is None else high - low + 1 - total["turns"]
            out = {n: total[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")}
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "gaps": gaps, **out, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

    return give


def _arrow_schema(ddl: str, conv_type: pa.DataType) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.schema([pa.field("conv_id", conv_type)] + [pa.field(n, kinds[k]) for n, k in fields])


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(rows: DataFrame, costs: RepairCosts = RepairCosts()) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, gone): gaps between turns, faults, pairs of
    roles that may not stand together, the cheapest edits and their cost, and a digest of the repaired text."""
    spread = _spread(rows)
    kind, arrow = spread.select("conv_id").schema[0].dataType.simpleString(), _arrow_type(spread)
    given = _over_borders(spread, costs)
    found = in_batches(spread).mapInArrow(_report(arrow, given, costs, _arrow_schema(_REPORT, arrow)), f"conv_id {kind}, {_REPORT}")
    # Less the distinct turns first, as turns may span all that a long holds.
    gaps = F.coalesce(F.col("high") - (F.col("turns") - 1) - F.col("low"), F.lit(0)).cast("long").alias("gaps")
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = found.where("of = 1").select("conv_id", gaps, *names, F.col("digest").alias("repaired_sha256"))
    if not given:
        return whole
    parts = sorted({part for _, part in given})
    over = spread.where(F.col("part").isin(parts)).mapInArrow(
        _report(arrow, given, costs, _arrow_schema(_REPORT, arrow)), f"conv_id {kind}, {_REPORT}").where("of = 2")
    over = over.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.unionByName(over.mapInArrow(_merge(_arrow_schema(_RESULT, arrow)), f"conv_id {kind}, {_RESULT}"))


def repaired_turns(rows: DataFrame, costs: RepairCosts = RepairCosts()) -> DataFrame:
    """The repaired conversations themselves: (conv_id, place, edit, role, text), one row a turn that is kept (K),
    reroled (R) or inserted (I); ``place`` rises within a conversation."""
    spread = _spread(rows)
    kind, arrow = spread.select("conv_id").schema[0].dataType.simpleString(), _arrow_type(spread)
    given = _over_borders(spread, costs)

    def give(batches):
        for piece in _pieces(batches):
            edits = [e for e in _plan(piece, given, costs)[0] if e[0] != "D"]
            for at in range(0, len(edits), 1000):
                some = edits[at : at + 1000]
                places = [(piece.part << 32) + at + i for i in range(len(some))]
                columns = [pa.array([piece.conv] * len(some), arrow), pa.array(places, pa.int64()), *(pa.array(c, pa.string()) for c in zip(*some))]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "edit", "role", "text"])

    return in_batches(spread).mapInArrow(give, f"conv_id {kind}, place long, edit string, role string, text string")


def repair(conversations: DataFrame) -> DataFrame:
    """The report of conversations after the damage that their ids and turns decide."""
    return repair_report(damage(conversations))
