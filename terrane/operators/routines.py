"""Routines: recorded bodies that return tables, and triggers that validate incoming rows.

A body is a Python function that records statements on a context. It runs twice, and both
recordings must agree: a body that branches on time or chance is refused. Statements run as set
operations, never row by row.
"""

from __future__ import annotations

import hashlib
import json
import keyword
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from ..functions import expressions as X
from ..plans.query import Select, sort_key
from ..sources.catalog import NAME, TYPES, Store, Table
from ..sources.checkpoints import cut
from . import changes

# Words of the procedural language that can't name a local value.
RESERVED = frozenset(
    (
        "all and any array as asc asymmetric begin between both by case cast check collate column constraint create current_date current_role current_time current_timestamp current_user "
        "declare default deferrable desc distinct do else end exception execute exists false fetch for foreach foreign from get grant group having if in initially intersect into leading limit "
        "localtime localtimestamp loop new not null offset old on only or order perform placing primary raise references return returning select session_user some strict symmetric table then to "
        "trailing true union unique user using variadic when where while window with"
    ).split()
)
#: Names that this library's routines use themselves.
_OWN = frozenset("found result insert update delete cursor record".split())


@dataclass(frozen=True)
class Statement:
    """kind: row, row_or_null, branch, raise, return_row, return_query, for_each."""

    kind: str
    parts: tuple = ()


class Body:
    def __init__(self, taken: set[str]):
        self.statements: list[Statement] = []
        self.taken = taken

    def _name(self, name: str) -> str:
        require(NAME.fullmatch(name) and name not in RESERVED | _OWN and not keyword.iskeyword(name), "bad-local", f"{name!r} can't name a local value")
        require(name not in self.taken, "duplicate-local", f"{name} is there already")
        self.taken.add(name)
        return name

    def _row(self, kind: str, query: Select, name: str) -> dict[str, X.Expr]:
        self._name(name)
        self.statements.append(Statement(kind, (name, query)))
        return {c: X.local(f"{name}.{c}", e.family) for c, e in query.projection}

    def row(self, query: Select, name: str = "found_row") -> dict[str, X.Expr]:
        """Exactly one row; its columns by name."""
        return self._row("row", query, name)

    def row_or_null(self, query: Select, name: str = "found_row") -> dict[str, X.Expr]:
        return self._row("row_or_null", query, name)

    def if_(self, *branches: tuple[X.Expr | None, Callable[[Body], None]]) -> None:
        """(condition, body) pairs, tried in order; a null condition is false, None as condition is else."""
        recorded = []
        for condition, record in branches:
            inner = Body(set(self.taken))
            record(inner)
            recorded.append((condition, tuple(inner.statements)))
        self.statements.append(Statement("branch", tuple(recorded)))

    def raise_(self, message: str, *args: Any) -> None:
        """% stands for an argument, %% for a percent sign."""
        require(message.replace("%%", "").count("%") == len(args), "bad-message", "one % an argument")
        self.statements.append(Statement("raise", (message, *map(X.lift, args))))

    def return_row(self, which: str | None = "new") -> None:
        """In a trigger: the row that goes on, new or old; None leaves it out."""
        require(which in ("new", "old", None), "bad-body", "new, old or None")
        self.statements.append(Statement("return_row", (which,)))

    def return_query(self, query: Any) -> None:
        """Appends the rows of a select, or those that a change returns, to the result."""
        self.statements.append(Statement("return_query", (query,)))

    def for_each(self, query: Select, record: Callable[[Body, dict[str, X.Expr]], None], name: str = "each") -> None:
        """Runs a body for the rows of a query; name tells nested loops' rows apart. A body looks rows up, returns selects and changes, raises, branches and loops; its rounds run at once, so an update may not read what it sets, and of several updates of a row the last round's stays."""
        self._name(name)
        inner = Body(set(self.taken))
        record(inner, {c: X.local(f"{name}.{c}", e.family) for c, e in query.projection})
        self.statements.append(Statement("for_each", (name, query, tuple(inner.statements))))


def plain(x: Any) -> Any:
    """A recording as lists and JSON values."""
    if isinstance(x, Statement):
        return [x.kind, plain(x.parts)]
    if isinstance(x, (tuple, list)):
        return [plain(y) for y in x]
    if isinstance(x, (X.Expr, Select, Change)):
        return X.encode(x)
    return repr(x) if not isinstance(x, (str, int, float, bool, type(None))) else x


def body_hash(statements: tuple[Statement, ...]) -> str:
    """Names a body by what it does: equal recordings have equal hashes."""
    return hashlib.sha256(json.dumps(plain(statements), sort_keys=True).encode()).hexdigest()[:16]


def record(body: Callable[..., None], arguments: dict[str, X.Expr]) -> tuple[Statement, ...]:
    runs = []
    for _ in range(2):
        b = Body(set(arguments))
        body(b, **arguments)
        runs.append(tuple(b.statements))
    require(json.dumps(plain(runs[0])) == json.dumps(plain(runs[1])), "not-deterministic", "the body records different statements each time")
    return runs[0]


@dataclass(frozen=True)
class Change:
    """A data change that a body returns: kind is insert, update or delete. An insert's set is its row, whose other columns get their defaults."""

    kind: str
    table: Table
    where: X.Expr | None = None
    set: tuple[tuple[str, Any], ...] = ()

    def encoded(self) -> list[Any]:
        return [self.kind, list(self.table.key), None if self.where is None else X.encode(self.where), [[c, X.encode(X.lift(v))] for c, v in self.set]]


@dataclass(frozen=True)
class Routine:
    name: str
    arguments: tuple[tuple[str, str], ...]  # name, family
    statements: tuple[Statement, ...] = field(default=())
    definer: bool = False
    #: A table: rows of it. A type's name: one value. None: whatever the body returns.
    returns: Table | str | None = None

    def __post_init__(self) -> None:
        require(self.returns is None or isinstance(self.returns, Table) or self.returns in TYPES, "bad-result", f"{self.name} returns a table's rows or a value of a type")
        for query in _returned(self.statements):
            self._check(query)

    def _check(self, query: Any) -> None:
        """Whether a returned query has the declared result's columns."""
        if isinstance(query, Select):
            got = {n: e.family for n, e in query.projection}
        else:
            got = {n: c.family for n, c in query.table.columns}
        if isinstance(self.returns, Table):
            want = {n: c.family for n, c in self.returns.columns}
            require(list(got) == list(want) and all(X.UNKNOWN in (got[n], want[n]) or got[n] == want[n] for n in want), "bad-result", f"{self.name} returns rows of {self.returns.name}, not {got}")
        elif self.returns is not None:
            family = TYPES[self.returns][0]
            require(len(got) == 1 and {*got.values()} <= {family, X.UNKNOWN}, "bad-result", f"{self.name} returns one {self.returns}, not {got}")

    def signature(self) -> Any:
        """The result as a snapshot has it; with the arguments it tells whether a routine can be replaced."""
        return {"setof": list(self.returns.key)} if isinstance(self.returns, Table) else self.returns or "rows"

    def __call__(self, store: Store, **values: Any) -> DataFrame:
        """Runs the body; its result is the union of what it returns, in order. A definer routine reads past the session's policies."""
        require(set(values) == {n for n, _ in self.arguments}, "bad-arguments", f"{self.name} takes {[n for n, _ in self.arguments]}")
        out = _run(self.statements, getattr(store, "store", store) if self.definer else store, dict(values))
        require(out, "no-result", f"{self.name} returned nothing")
        first, *rest = out
        for df in rest:
            first = first.unionByName(df)
        if isinstance(self.returns, str):
            first = cut(first.select(F.col(first.columns[0]).cast(TYPES[self.returns][1]).alias(self.name)).limit(2))
            require(first.count() < 2, "bad-result", f"{self.name} returns one value, and there are more")
        return first


def _returned(statements: tuple[Statement, ...]) -> Iterator[Any]:
    """Every query that a body returns, at any depth."""
    for s in statements:
        if s.kind == "return_query":
            yield s.parts[0]
        elif s.kind == "branch":
            for _, inner in s.parts:
                yield from _returned(inner)
        elif s.kind == "for_each":
            yield from _returned(s.parts[2])


def routine(name: str, arguments: dict[str, str], body: Callable[..., None], definer: bool = False, returns: Table | str | None = None) -> Routine:
    return Routine(name, tuple(arguments.items()), record(body, {n: X.local(n, f) for n, f in arguments.items()}), definer, returns)


def _message(template: str, args: list[Column]) -> Column:
    return F.format_string(template.replace("%%", "\0").replace("%", "%s").replace("\0", "%%"), *(a.cast("string") for a in args))


def _run(statements: tuple[Statement, ...], store: Store, values: dict[str, Any]) -> list[DataFrame]:
    out: list[DataFrame] = []
    scope = X.Scope(locals=tuple(values.items()), subquery=lambda q, s: q.frame(store, replace(s, locals=tuple(values.items()))))
    for s in statements:
        if s.kind in ("row", "row_or_null"):
            name, query = s.parts
            rows = query.frame(store, replace(scope, locals=tuple(values.items()))).limit(2 if s.kind == "row" else 1).collect()
            require(s.kind == "row_or_null" or len(rows) == 1, "not-one-row", f"{name}: {'no' if not rows else 'more than one'} row")
            values |= {f"{name}.{c}": rows[0][c] if rows else None for c in query.columns()}
        elif s.kind == "branch":
            for condition, inner in s.parts:
                here = replace(scope, locals=tuple(values.items()))
                if condition is None or store.spark.range(1).select(F.coalesce(X.compile_(condition, here), F.lit(False))).first()[0]:
                    out += _run(inner, store, dict(values))
                    break
        elif s.kind == "raise":
            here = replace(scope, locals=tuple(values.items()))
            text = store.spark.range(1).select(_message(s.parts[0], [X.compile_(a, here) for a in s.parts[1:]])).first()[0]
            require(False, "raised", text)
        elif s.kind == "return_query":
            out.append(_result(s.parts[0], store, replace(scope, locals=tuple(values.items()))))
        elif s.kind == "for_each":
            out += _loop(s, None, store, dict(values))
        else:
            require(False, "bad-body", "only a trigger returns a row")
    return out


def _result(query: Any, store: Store, scope: X.Scope) -> DataFrame:
    if isinstance(query, Select):
        return query.frame(store, scope)
    known = dict(scope.locals)

    def bind(e: X.Expr) -> X.Expr:
        return X.rewrite(e, lambda x: X.lift(known[x.args[0]]) if x.op == "local" else x)

    if query.kind == "insert":
        return changes.insert(query.table, [{c: bind(v) if isinstance(v, X.Expr) else v for c, v in query.set}], store).returned
    bound = None if query.where is None else bind(query.where)
    if query.kind == "delete":
        return changes.delete(query.table, bound, store).returned
    return changes.update(query.table, {c: bind(v) if isinstance(v, X.Expr) else v for c, v in query.set}, bound, store).returned


# A loop runs for all its rows at once: its rows are a frame whose columns are the body's local values.


def _value(name: str) -> str:
    """The column that holds a local value of a frame of rows."""
    return f"v__{name.replace('.', '__')}"


def _scope(rows: DataFrame, values: dict[str, Any], store: Store, visible: frozenset = frozenset()) -> X.Scope:
    held = {c.removeprefix("v__").replace("__", ".", 1): F.col(c) for c in rows.columns if c.startswith("v__")}
    return X.Scope(visible, locals=tuple({**values, **held}.items()), subquery=lambda q, s: q.frame(store, s))


def _joined(rows: DataFrame, query: Select, store: Store, values: dict[str, Any], how: str = "inner") -> tuple[DataFrame, X.Scope]:
    """A select's tables joined to the rows that its condition speaks of."""
    keys = [query.base, *(k for k, _ in query.joins)]
    out = store.read(query.base).alias(X.alias(*query.base))
    scope = _scope(rows, values, store, frozenset(keys))
    for key, on in query.joins:
        out = out.join(store.read(key).alias(X.alias(*key)), X.compile_(on, scope))
    condition = X.compile_(query.condition, scope) if query.condition is not None else F.lit(True)
    return rows.join(out.withColumn("_there", F.lit(True)), condition, how), scope


def _loop(s: Statement, rows: DataFrame | None, store: Store, values: dict[str, Any]) -> list[DataFrame]:
    name, query, inner = s.parts
    require(rows is None or not query.order and query.count is None, "bad-body", "an inner loop's select has no order or limit of its own")
    if rows is None:
        # what the loop is ordered by goes along, for statements of which the last run counts
        keyed = replace(query, projection=(*query.projection, *((f"order__{k}", e) for k, (e, _) in enumerate(query.order))))
        found = keyed.frame(store, X.Scope(locals=tuple(values.items()), subquery=lambda q, x: q.frame(store, x)))
        each = found.select(*(F.col(c).alias(_value(f"{name}.{c}")) for c in query.columns()), *(F.col(f"order__{k}").alias(f"order__{k}__{d}") for k, (_, d) in enumerate(query.order)))
    else:
        met, scope = _joined(rows, query, store, values)
        each = met.select(*(F.col(c) for c in rows.columns), *(X.compile_(e, scope).alias(_value(f"{name}.{n}")) for n, e in query.projection))
    return _each(inner, each.withColumn(ROUND, F.monotonically_increasing_id()), store, values)


#: The column that tells a loop's rounds apart.
ROUND = "round__"


def _latest(rows: DataFrame) -> list[Column]:
    """Sort keys that bring a loop's last round first: by the order of the loop, the last, then by its rows' values."""
    turned = [F.col(c).asc_nulls_last() if c.endswith("desc") else F.col(c).desc_nulls_first() for c in rows.columns if c.startswith("order__")]
    return [*turned, *(F.col(f.name).desc_nulls_last() for f in rows.schema.fields if f.name.startswith("v__") and changes.sortable(f.dataType))]


def _unique(query: Select, store: Store) -> bool:
    """Whether a look-up finds one row at most: its condition fixes a whole key of the one table that it reads."""
    table = getattr(store, "store", store).tables.get(query.base)
    if table is None or query.joins or query.condition is None:
        return False

    def parts(e: X.Expr) -> Iterator[X.Expr]:
        for x in e.args if e.op == "and" else (e,):
            yield from parts(x) if x.op == "and" else (x,)

    fixed = set()
    for e in parts(query.condition):
        for a, b in (e.args, e.args[::-1]) if e.op == "eq" else ():
            if a.op == "ref" and a.args[:2] == table.key and table.key not in X.tables_of(b):
                fixed.add(a.args[2])
    keys = [set(table.primary_key()), *({n} for n, c in table.columns if c.is_unique)]
    return any(k and k <= fixed for k in keys)


def _looked_up(s: Statement, rows: DataFrame, store: Store, values: dict[str, Any]) -> DataFrame:
    """The rounds with the row that each looks up, as local values. A strict look-up has exactly one row in every round, another the first one or nulls."""
    name, query = s.parts
    require(query.count in (None, 1), "bad-body", "a look-up in a loop has no limit but 1")
    met, scope = _joined(rows, query, store, values, "left")
    found = met.select(*(F.col(c) for c in rows.columns), *(X.compile_(e, scope).alias(_value(f"{name}.{n}")) for n, e in query.projection), F.col("_there"), *(X.compile_(e, scope).alias(f"key__{i}") for i, (e, _) in enumerate(query.order)))
    if _unique(query, store):
        lost = found.where("_there is null").first() if s.kind == "row" else None
        require(lost is None, "not-one-row", f"{name}: no row")
        return found.drop("_there", *(f"key__{i}" for i in range(len(query.order))))
    if s.kind == "row":
        bad = found.groupBy(ROUND).agg(F.count("_there").alias("n")).where("n <> 1").first()
        require(bad is None, "not-one-row", f"{name}: {'no' if bad and not bad['n'] else 'more than one'} row")
        return found.drop("_there", *(f"key__{i}" for i in range(len(query.order))))
    order = [sort_key(F.col(f"key__{i}"), d) for i, (_, d) in enumerate(query.order)] + [F.col(_value(f"{name}.{n}")).asc_nulls_last() for n in query.columns() if changes.sortable(found.schema[_value(f"{name}.{n}")].dataType)]
    place = F.row_number().over(Window.partitionBy(ROUND).orderBy(*order))
    return found.withColumn("_place", place).where("_place = 1").drop("_place", "_there", *(f"key__{i}" for i in range(len(query.order))))


def _changed(change: Change, rows: DataFrame, store: Store, values: dict[str, Any]) -> DataFrame:
    """Rows that an update or delete in a loop reaches, each once: as the last round leaves it, or as it was before it went."""
    t = change.table
    require(change.where is not None, "bad-body", f"a loop's {change.kind} has a condition")
    target = store.read(t.key).select(*t.names()).alias(X.alias(*t.key))
    scope = _scope(rows, values, store, frozenset([t.key]))
    condition = X.compile_(change.where, scope)
    if change.kind == "delete":
        return target.join(rows, condition, "left_semi").select(*t.names())
    sets = {c: X.lift(v) for c, v in change.set}
    require(set(sets) <= set(t.names()), "unknown-column", f"{set(sets) - set(t.names())} aren't columns of {t.name}")
    read = {x.args[2] for e in (change.where, *sets.values()) for x in X.walk(e) if x.op == "ref" and x.args[:2] == t.key}
    require(not read & set(sets), "bad-body", f"a loop's update doesn't read what it sets ({sorted(read & set(sets))}): its rounds run at once")
    met = target.withColumn("_row", F.monotonically_increasing_id()).alias(X.alias(*t.key)).join(rows, condition)
    last = met.withColumn("_place", F.row_number().over(Window.partitionBy("_row").orderBy(*_latest(rows)))).where("_place = 1")
    types = {n: c.spark_type() for n, c in t.columns}
    return last.select(*((X.compile_(sets[n], scope).cast(types[n]) if n in sets else F.col(f"{X.alias(*t.key)}.{n}")).alias(n) for n in t.names()))


def _each(statements: tuple[Statement, ...], rows: DataFrame, store: Store, values: dict[str, Any]) -> list[DataFrame]:
    """A loop's body for all rows at once; what it returns, statement by statement."""
    out: list[DataFrame] = []
    for s in statements:
        scope = _scope(rows, values, store)
        if s.kind == "return_query" and isinstance(s.parts[0], Select):
            query = s.parts[0]
            require(not query.order and query.count is None, "bad-body", "a loop's select has no order or limit of its own")
            met, here = _joined(rows, query, store, values)
            out.append(met.select(*(X.compile_(e, here).alias(n) for n, e in query.projection)))
        elif s.kind == "return_query" and s.parts[0].kind == "insert":
            t, given = s.parts[0].table, dict(s.parts[0].set)
            require(set(given) <= set(t.names()), "unknown-column", f"{set(given) - set(t.names())} aren't columns of {t.name}")
            cells = [(X.compile_(X.lift(given[n]), scope) if n in given else changes.default_of(t, n)).cast(c.spark_type()).alias(n) for n, c in t.columns]
            out.append(changes.insert_rows(t, rows.select(*cells), store).returned)
        elif s.kind == "return_query":
            out.append(_changed(s.parts[0], rows, store, values))
        elif s.kind in ("row", "row_or_null"):
            rows = _looked_up(s, rows, store, values)
        elif s.kind == "branch":
            open_ = F.lit(True)
            for condition, inner in s.parts:
                here = F.lit(True) if condition is None else F.coalesce(X.compile_(condition, scope), F.lit(False))
                out += _each(inner, rows.where(open_ & here), store, values)
                open_ = open_ & ~here
        elif s.kind == "raise":
            first = rows.select(_message(s.parts[0], [X.compile_(a, scope) for a in s.parts[1:]])).first()
            require(first is None, "raised", first[0] if first else "")
        elif s.kind == "for_each":
            out += _loop(s, rows, store, values)
        else:
            require(False, "bad-body", f"{s.kind} of a {type(s.parts[0]).__name__} can't stand in a loop")
    return out


# ---- triggers --------------------------------------------------------------


@dataclass(frozen=True)
class Trigger:
    """Validates a batch: rules are (lookup or None, condition, message, arguments); a row for which a condition is true is refused.

    A lookup is (table, pairs of its column and the new row's column): a left join, so that a row
    without a match sees nulls.
    """

    name: str
    table: Table
    events: tuple[str, ...]
    update_of: tuple[str, ...] = ()
    lookup: tuple[Table, tuple[tuple[str, str], ...]] | None = None
    rules: tuple[tuple[X.Expr, str, tuple], ...] = ()

    def __post_init__(self) -> None:
        require(self.events and set(self.events) <= {"insert", "update", "delete"}, "bad-trigger", "insert, update or delete")
        require(not self.update_of or "update" in self.events, "bad-trigger", "columns are named for update only")

    def fires(self, event: str, set_columns: tuple[str, ...] = ()) -> bool:
        return event in self.events and (event != "update" or not self.update_of or bool(set(self.update_of) & set(set_columns)))

    def refused(self, batch: DataFrame, store: Store) -> DataFrame:
        """The batch's rows that a rule refuses, with the first rule's message."""
        rows = batch.select(*(F.col(c).alias(f"new__{c}") for c in batch.columns))
        if self.lookup:
            other, pairs = self.lookup
            found = store.read(other.key).select(*(F.col(c).alias(f"row__{c}") for c in other.names()))
            rows = rows.join(found, [F.col(f"row__{a}") == F.col(f"new__{b}") for a, b in pairs], "left")
        scope = X.Scope(locals=tuple((c.replace("__", ".", 1), F.col(c)) for c in rows.columns))
        text = F.lit(None).cast("string")
        for condition, message, args in reversed(self.rules):
            text = F.when(X.compile_(condition, scope), _message(message, [X.compile_(X.lift(a), scope) for a in args])).otherwise(text)
        return rows.withColumn("message", text).where("message is not null").select(*(F.col(f"new__{c}").alias(c) for c in batch.columns), "message")


@dataclass(frozen=True)
class RowTrigger:
    """A trigger with a body, run for all rows of a batch at once. timing: before or after."""

    name: str
    table: Table
    events: tuple[str, ...]
    statements: tuple[Statement, ...]
    timing: str = "before"
    update_of: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        require(self.events and set(self.events) <= {"insert", "update", "delete"}, "bad-trigger", "insert, update or delete")
        require(self.timing in ("before", "after"), "bad-trigger", "before or after")
        require(not self.update_of or "update" in self.events, "bad-trigger", "columns are named for update only")

    def fires(self, event: str, set_columns: tuple[str, ...] = ()) -> bool:
        return event in self.events and (event != "update" or not self.update_of or bool(set(self.update_of) & set(set_columns)))

    def run(self, store: Store, batch: DataFrame, event: str) -> tuple[DataFrame, DataFrame]:
        """The rows that the body returns, with the batch's columns, and those it refuses, with message.

        batch: the table's columns (those to insert, or to delete); for an update the new values, and
        the old ones as old__<column>. A row for which the body ends without return is refused. An
        update's row that is left out comes back with its old values.
        """
        names = self.table.names()
        which = {"insert": ("new",), "delete": ("old",), "update": ("new", "old")}[event]
        columns = [F.col(n if w == which[0] else f"old__{n}").alias(_value(f"{w}.{n}")) for w in which for n in names]
        rows = cut(batch.select(*columns, F.monotonically_increasing_id().alias("_row")))
        returned, refused, open_ = _triggered(self.statements, rows, store, which, names)
        refused.append(_row(open_, which, which[0], names).withColumn("message", F.lit("the body ends without returning a row")))
        none = _row(rows, which, which[0], names).limit(0)
        return reduce(DataFrame.unionByName, returned, none), reduce(DataFrame.unionByName, refused, none.withColumn("message", F.lit("")))


def trigger(name: str, table: Table, events: tuple[str, ...], body: Callable[..., None], timing: str = "before", update_of: tuple[str, ...] = ()) -> RowTrigger:
    """body(ctx, new, old) records the statements; new and old hold the row's columns by name."""
    new, old = ({n: X.local(f"{which}.{n}", table[n].family) for n in table.names()} for which in ("new", "old"))
    return RowTrigger(name, table, events, record(lambda ctx, **_: body(ctx, new, old), {}), timing, update_of)


def _row(rows: DataFrame, which: tuple[str, ...], values: str, names: list[str], *more: Column) -> DataFrame:
    """The batch's columns, with the values of new or old, and more."""
    old = [F.col(_value(f"old.{n}")).alias(f"old__{n}") for n in names] if len(which) == 2 else []
    return rows.select(*(F.col(_value(f"{values}.{n}")).alias(n) for n in names), *old, *more)


def _triggered(statements: tuple[Statement, ...], rows: DataFrame, store: Store, which: tuple[str, ...], names: list[str]) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Rows returned, rows refused, and the rows for which the statements end without either."""
    returned: list[DataFrame] = []
    refused: list[DataFrame] = []
    for s in statements:
        scope = _scope(rows, {}, store)
        if s.kind in ("row", "row_or_null"):
            name, query = s.parts
            require(not query.order and query.count is None, "bad-body", "a trigger's lookup has no order or limit")
            met, here = _joined(rows, query, store, {}, "left")
            held, values = rows.columns, [_value(f"{name}.{n}") for n in query.columns()]
            # written once: what the body returns and what it refuses are both read from it
            one = cut(met.select(*(F.col(c) for c in held), *(X.compile_(e, here).alias(v) for v, (_, e) in zip(values, query.projection, strict=True)), F.col("_there")))
            if not _unique(query, store) and one.count() > rows.count():
                # only where some row found several is the batch grouped again; the least of them stays
                least = F.min_by(F.struct(*held, *values), F.struct(*values)).alias("_r")
                one = cut(one.groupBy("_row").agg(least, F.count("_there").alias("_n")).select("_r.*", F.when(F.col("_n") == 1, True).alias("_there")))
            if s.kind == "row":
                refused.append(_row(one.where("_there is null"), which, which[0], names).withColumn("message", F.lit(f"{name}: not exactly one row")))
                one = one.where("_there is not null")
            rows = one.drop("_there")
        elif s.kind == "branch":
            before, rest, ends = rows.columns, rows, []
            for condition, inner in s.parts:
                here = F.lit(True) if condition is None else F.coalesce(X.compile_(condition, scope), F.lit(False))
                a, b, end = _triggered(inner, rest.where(here), store, which, names)
                returned, refused, ends = returned + a, refused + b, [*ends, end.select(*before)]
                rest = rest.where(~here)
            rows = reduce(DataFrame.unionByName, ends, rest)
        elif s.kind == "raise":
            text = _message(s.parts[0], [X.compile_(a, scope) for a in s.parts[1:]])
            refused.append(_row(rows, which, which[0], names, text.alias("message")))
            rows = rows.limit(0)
        elif s.kind == "return_row":
            require(s.parts[0] is None or s.parts[0] in which, "bad-body", f"there is no {s.parts[0]} row")
            if s.parts[0] is not None or len(which) == 2:
                returned.append(_row(rows, which, s.parts[0] or "old", names))
            rows = rows.limit(0)
        else:
            require(False, "bad-body", f"{s.kind} can't stand in a trigger")
    return returned, refused, rows
