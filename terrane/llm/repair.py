"""Conversation structure repair by the cheapest edits.

A conversation should read as an optional system turn and then pairs of user and assistant. A
backward dynamic programme over (turn, grammar state) gives the cost to go from each place; a
forward walk then takes, of the edits that keep to it, the one whose initial is least in ASCII.
Edits: K keep, R give the role that is due, D delete, I insert an empty turn of the role that is due.

A conversation may hold any share of all rows, so nothing needs it whole. Turns are laid out in
ranges of (conversation, turn, role, text). Only the first and last conversation of a range can go
on in another one; their pieces become cost matrices between grammar states (four by four), which
a scan over the pieces multiplies backward; the walks' end states from each start state are
then followed forward. With both ends known, every range is repaired on its own. Rows that agree
in all four columns are one row with a count. The digest of a repaired conversation is sequential
by nature: for a conversation of several ranges, pieces of text stream through one hash in order.

Defined cases: null roles and texts are one space (such a turn is blank, its role unknown); turns
come by number, nulls first, then by role, then text; turns that agree in these are repeats; rows with
null conv_id are one conversation; a role counts by its first character; an empty table gives an
empty result; other columns are ignored. Numbers of gaps beyond 63 bits are the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import _join
from .common import SPACES, Scratch, strip_spaces


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    #: Added where a truncated turn stays.
    truncated: int = 3


# ---- the grammar: states are start, after system, after user, after assistant

NONE = 1 << 60
_SEEN = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_DUE = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: Cost to go at the end of a conversation: nothing where it may end.
_OVER = (0, NONE, NONE, 0)
CLEAN, BLANK, REPEAT, TRUNCATED = range(4)
_MUST_GO = (BLANK, REPEAT)
_LEGAL = frozenset(("su", "ua", "au"))


def _settled(w: list[int], c: Costs) -> list[int]:
    """The costs with inserted turns in front allowed."""
    user, assistant = min(w[2], c.insert + w[3]), min(w[3], c.insert + w[2])
    return [min(w[0], c.insert + user), min(w[1], c.insert + user), user, assistant]


def _before(v: list[int], initial: str, fault: int, n: int, c: Costs) -> list[int]:
    """Costs to go in front of a row that stands n times, from those behind it."""
    again = c.delete * (n - 1)
    if fault in _MUST_GO:
        return _settled([x + again + c.delete for x in v], c)
    more, seen = c.truncated if fault == TRUNCATED else 0, _SEEN.get(initial, (None,) * 4)
    out = []
    for state in range(4):
        best = min(c.delete + v[state], c.rerole + more + v[_DUE[state]])
        if seen[state] is not None:
            best = min(best, more + v[seen[state]])
        out.append(best + again)
    return _settled(out, c)


def _to_go(rows: list[tuple[str, int, int]], end: list[int], c: Costs) -> list[list[int]]:
    """Costs to go in front of each row of (initial, fault, n), and behind the last."""
    out = [end]
    for initial, fault, n in reversed(rows):
        out.append(_before(out[-1], initial, fault, n, c))
    return out[::-1]


def _walk(rows: list[tuple[str, int, int]], v: list[list[int]], state: int, last: bool, c: Costs) -> tuple[int, list[tuple[str, int, int]], int]:
    """End state, edits as (initial, row, state before), and their cost. last: whether the conversation ends here; else inserts behind the last row belong to what follows."""
    edits, cost = [], 0
    for k, (initial, fault, n) in enumerate(rows):
        again = c.delete * (n - 1)
        more, seen = c.truncated if fault == TRUNCATED else 0, _SEEN.get(initial, (None,) * 4)
        while True:
            left, behind = v[k][state] - again, v[k + 1]
            if c.delete + behind[state] == left:
                edit, to, paid = "D", state, c.delete
            elif c.insert + v[k][_DUE[state]] - again == left:
                edit, to, paid = "I", _DUE[state], c.insert
            elif fault not in _MUST_GO and seen[state] is not None and more + behind[seen[state]] == left:
                edit, to, paid = "K", seen[state], more
            else:
                edit, to, paid = "R", _DUE[state], c.rerole + more
            edits.append((edit, k, state))
            cost, state = cost + paid, to
            if edit != "I":
                break
        edits += [("D", k, state)] * (n - 1)
        cost += again
    while last and v[-1][state]:
        edits.append(("I", -1, state))
        cost, state = cost + c.insert, _DUE[state]
    return state, edits, cost


# ---- rows with their faults, in ranges


def _key() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def normal(turns: DataFrame, times: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, n: how often a turn stands. times: the column that has a row's own count, if it isn't one."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), (F.lit(1) if times is None else F.col(times)).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))


def laid_out(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """normal() rows with fault (of the first of n; others are repeats, or blank), id (in order) and range, in a table."""
    core = strip_spaces(F.col("text"))
    rows = scratch.keep(rows.withColumns({"key": _key(), "blank": core == "", "open": ~F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1).isin(".", "!", "?")}), "turns")
    nulls_first = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.where("not blank").groupBy("conv_id", "key").agg(F.min(nulls_first).alias("first"), F.count(F.lit(1)).alias("all")).where("all > 1")
    # kept, so that both sides of the join are plain shuffles, and a turn said everywhere can be split
    met = _join(rows, scratch.keep(first.select("conv_id", "key", "first"), "first"), ["conv_id", "key"], "left")
    fault = F.when(F.col("blank"), BLANK).when(nulls_first > F.col("first"), REPEAT).when(F.col("open"), TRUNCATED).otherwise(CLEAN)
    order = ["conv_id", "turn", "role", "text"]
    placed = met.select(*order, "n", fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
    # written with their places, so that every later step sees the same ranges
    return scratch.keep(placed.withColumn("id", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()), "ranges")


def _runs(table: pa.Table) -> tuple[pa.Table, list[tuple[str | None, int, int]]]:
    """The rows in order, and each conversation with its first row and the row behind its last."""
    table = table.sort_by("id")
    convs = table.column("conv").to_pylist()
    cuts = [0, *(k for k in range(1, len(convs)) if convs[k] != convs[k - 1]), len(convs)] if convs else [0]
    return table, [(convs[a], a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _columns(table: pa.Table) -> list[tuple[str, int, int]]:
    return list(zip(table.column("initial").to_pylist(), table.column("fault").to_pylist(), table.column("n").to_pylist(), strict=True))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


# ---- pieces of conversations that several ranges share

_LONGS = pa.list_(pa.int64())
_PIECES = pa.schema([("conv", pa.string()), ("range", pa.int32()), ("matrix", _LONGS), ("last", pa.string()), ("last_turn", pa.int64())])
_AHEAD = pa.schema([("conv", pa.string()), ("range", pa.int32()), ("to_go", _LONGS), ("last", pa.string()), ("last_turn", pa.int64()), ("over", pa.bool_())])
_ENDS = pa.schema([("conv", pa.string()), ("range", pa.int32()), ("ends", _LONGS), ("to_go", _LONGS), ("last", pa.string()), ("last_turn", pa.int64()), ("over", pa.bool_())])
_GIVEN = pa.schema([("conv", pa.string()), ("range", pa.int32()), ("start", pa.int32()), ("to_go", _LONGS), ("over", pa.bool_()), ("before", pa.string()), ("before_turn", pa.int64())])


def _matrices(c: Costs) -> Callable[[pa.Table], pa.Table]:
    def f(table: pa.Table) -> pa.Table:
        table, runs = _runs(table)
        rows, out = _columns(table), []
        for conv, a, b in dict.fromkeys((runs[0], runs[-1])):
            ends = [_to_go(rows[a:b], [0 if t == state else NONE for t in range(4)], c)[0] for state in range(4)]
            matrix = [min(ends[t][s], NONE) for s in range(4) for t in range(4)]
            out.append((conv, table.column("range")[0].as_py(), matrix, rows[b - 1][0], table.column("turn")[b - 1].as_py()))
        return _table(out, _PIECES)

    return f


def _backward(c: Costs) -> Callable[[pa.Table], pa.Table]:
    def f(table: pa.Table) -> pa.Table:
        pieces, v, out = table.sort_by("range").to_pylist(), _settled(list(_OVER), c), []
        for k, p in reversed(list(enumerate(pieces))):
            out.append((p["conv"], p["range"], v, p["last"], p["last_turn"], k == len(pieces) - 1))
            v = [min(p["matrix"][4 * s + t] + v[t] for t in range(4)) for s in range(4)]
        return _table(out if len(pieces) > 1 else [], _AHEAD)

    return f


def _ends(c: Costs) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def f(table: pa.Table, ahead: pa.Table) -> pa.Table:
        table, runs = _runs(table)
        rows, places, out = _columns(table), {conv: (a, b) for conv, a, b in runs}, []
        for p in ahead.to_pylist():
            a, b = places[p["conv"]]
            v = _to_go(rows[a:b], p["to_go"], c)
            # a state from which nothing can be finished is never reached
            out.append((p["conv"], p["range"], [_walk(rows[a:b], v, s, False, c)[0] for s in range(4)], p["to_go"], p["last"], p["last_turn"], p["over"]))
        return _table(out, _ENDS)

    return f


def _forward(table: pa.Table) -> pa.Table:
    state, before, before_turn, out = 0, None, None, []
    for p in table.sort_by("range").to_pylist():
        out.append((p["conv"], p["range"], state, p["to_go"], p["over"], before, before_turn))
        state, before, before_turn = p["ends"][state], p["last"], p["last_turn"]
    return _table(out, _GIVEN)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", _LONGS: "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def shared_pieces(placed: DataFrame, c: Costs, scratch: Scratch) -> DataFrame:
    """For each piece of a conversation that several ranges share: the state it starts in, the costs to go behind it, and what stands before it."""
    codes = placed.select(F.col("conv_id").cast("string").alias("conv"), "range", "id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "n")
    pieces = codes.groupBy("range").applyInArrow(_matrices(c), _ddl(_PIECES))
    ahead = scratch.keep(pieces.groupBy("conv").applyInArrow(_backward(c), _ddl(_AHEAD)), "ahead")
    touched = codes.join(ahead.select("range").distinct(), "range", "left_semi")
    ends = touched.groupBy("range").cogroup(ahead.groupBy("range")).applyInArrow(_ends(c), _ddl(_ENDS))
    return scratch.keep(ends.groupBy("conv").applyInArrow(_forward, _ddl(_GIVEN)), "pieces")


# ---- repair, range by range

_DONE = pa.schema(
    [("conv", pa.string()), ("range", pa.int32()), ("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("part", pa.int32()), ("data", pa.binary())]
)
_TURNS = pa.schema([("conv", pa.string()), ("range", pa.int32()), ("k", pa.int64()), ("role", pa.string()), ("text", pa.string())])
#: Bytes of a piece of text that goes to a hash elsewhere.
_PART = 4 << 20


def _repaired(c: Costs, as_turns: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def f(table: pa.Table, given: pa.Table) -> pa.Table:
        table, runs = _runs(table)
        rows, roles, texts, turns = _columns(table), table.column("role"), table.column("text"), table.column("turn").to_pylist()
        known = {p["conv"]: p for p in given.to_pylist()}
        whole = {"start": 0, "to_go": _settled(list(_OVER), c), "over": True, "before": None, "before_turn": None}
        done, out = [], []
        for conv, a, b in runs:
            at, p = table.column("range")[a].as_py(), known.get(conv, whole)
            mine = rows[a:b]
            _, edits, cost = _walk(mine, _to_go(mine, p["to_go"], c), p["start"], p["over"], c)
            kept = ((_ROLE[s] if e != "K" else roles[a + k].as_py(), "" if e == "I" else texts[a + k].as_py()) for e, k, s in edits if e != "D")
            if as_turns:
                out += [(conv, at, k, role, text) for k, (role, text) in enumerate(kept)]
                continue
            parts = _parts(f"{role}:{text}".encode() for role, text in kept)
            numbers = [t for t in turns[a:b] if t is not None]
            n_turns = len(set(numbers)) - (p["before_turn"] is not None and p["before_turn"] in numbers[:1])
            initials = [p["before"], *(i for i, _, _ in mine)] if p["before"] is not None else [i for i, _, _ in mine]
            illegal = sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:], strict=False)) + sum((n - 1) * (i + i not in _LEGAL) for i, _, n in mine)
            faults = [sum(n if x == BLANK == fault else x == fault for _, fault, n in mine) for x in (BLANK, REPEAT, TRUNCATED)]
            faults[1] += sum(n - 1 for _, fault, n in mine if fault != BLANK)
            sums = (n_turns, min(numbers, default=None), max(numbers, default=None), *faults, illegal, cost, "".join(e for e, _, _ in edits))
            if conv in known:
                done.append((conv, at, *sums, None, None, None))
                done += [(conv, at, *[None] * 9, None, k, data) for k, data in enumerate(parts)]
            else:
                digest = hashlib.sha256()
                for k, data in enumerate(parts):
                    digest.update(b"\n" * (k > 0) + data)
                done.append((conv, at, *sums, digest.hexdigest(), None, None))
        return _table(out, _TURNS) if as_turns else _table(done, _DONE)

    return f


def _parts(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces joined by line feeds, cut between pieces into parts of about _PART bytes."""
    held, size = [], 0
    for x in pieces:
        held.append(x)
        size += len(x) + 1
        if size >= _PART:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


_HASHED = pa.schema([("conv", pa.string()), ("streamed", pa.string())])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each conversation from its parts, which come in order."""
    now, digest = None, None
    for batch in batches:
        out = []
        for conv, data in zip(batch.column("conv").to_pylist(), batch.column("data"), strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(data.as_py())
        if out:
            yield _table(out, _HASHED).to_batches()[0]
    if digest is not None:
        yield _table([(now, digest.hexdigest())], _HASHED).to_batches()[0]


def _by_range(rows: DataFrame, c: Costs, scratch: Scratch, as_turns: bool) -> DataFrame:
    placed = laid_out(rows, scratch)
    given = shared_pieces(placed, c, scratch)
    with_text = placed.select(F.col("conv_id").cast("string").alias("conv"), "range", "id", "turn", "role", F.substring("role", 1, 1).alias("initial"), "text", "fault", "n")
    return with_text.groupBy("range").cogroup(given.groupBy("range")).applyInArrow(_repaired(c, as_turns), _ddl(_TURNS if as_turns else _DONE))


def repaired_turns(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, range, k, role, text: the turns of the repaired conversations, in order of range and k."""
    out = _by_range(normal(turns), costs, Scratch(turns.sparkSession, "repair"), True)
    return out.select(F.col("conv").cast(turns.schema["conv_id"].dataType).alias("conv_id"), "range", "k", "role", "text")


def repair(turns: DataFrame, costs: Costs = Costs(), times: str | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal (what was found), cost, audit (the edits), repaired_sha256 (of role:text, joined by line feeds). times: as for normal()."""
    scratch = Scratch(turns.sparkSession, "repair")
    done = scratch.keep(_by_range(normal(turns, times), costs, scratch, False), "done")
    text = done.where("data is not null").select("conv", "range", "part", "data")
    hashed = text.repartition("conv").sortWithinPartitions("conv", "range", "part").mapInArrow(_streamed, _ddl(_HASHED))
    sums = done.where("data is null").groupBy("conv").agg(
        F.sum("turns").alias("turns"), F.min("least").alias("least"), F.max("most").alias("most"), *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")), F.array_sort(F.collect_list(F.struct("range", "audit"))).alias("audits"), F.max("sha").alias("sha")
    )
    span = F.col("most").cast("decimal(20,0)") - F.col("least").cast("decimal(20,0)") + 1 - F.col("turns").cast("decimal(20,0)")
    gaps = F.coalesce(F.least(span, F.lit((1 << 63) - 1).cast("decimal(20,0)")), F.lit(0)).cast("long")
    both = _join(sums, hashed, ["conv"], "left")
    sha = F.coalesce("sha", "streamed", F.sha2(F.lit(""), 256))
    audit = F.array_join(F.transform("audits", lambda x: x.audit), "")
    return both.select(F.col("conv").cast(turns.schema["conv_id"].dataType).alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"), sha.alias("repaired_sha256"))


# ---- the contract's damaged conversations


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows with seeded damage. A twentieth each is dropped, emptied, stripped of final marks, repeated, or said to be the user's."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def repair_damaged(turns: DataFrame) -> DataFrame:
    """repair() of damaged(), with a row for every conversation of turns, also where no row was left."""
    none = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    both = _join(turns.select("conv_id").distinct(), repair(damaged(turns), times="n"), ["conv_id"], "left")
    return both.select("conv_id", *(F.coalesce(F.col(x), v).alias(x) for x, v in none.items()))
