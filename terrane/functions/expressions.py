"""Expressions that can be stored: built once, then checked, serialised, renamed, compared, or turned into a Spark Column.

An expression is an operator name with arguments; a family says coarsely what it yields, so that
comparisons across families are refused when declared instead of failing in an ANSI cast.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import require

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()
    family: str = UNKNOWN

    def __hash__(self) -> int:
        return hash((self.op, repr(self.args)))


# ---- leaves ----------------------------------------------------------------


def ref(schema: str, table: str, column: str, family: str = UNKNOWN) -> Expr:
    return Expr("ref", (schema, table, column), family)


def local(name: str, family: str = UNKNOWN) -> Expr:
    """A routine's argument, or a trigger's old or new row's column."""
    return Expr("local", (name,), family)


def literal(value: Any) -> Expr:
    """One of five kinds: text, number, boolean, timestamp, null."""
    if value is None:
        return Expr("literal", ("null", None))
    if isinstance(value, bool):
        return Expr("literal", ("boolean", value), "boolean")
    if isinstance(value, (int, float)):
        require(math.isfinite(value), "bad-literal", f"{value} is not a finite number")
        return Expr("literal", ("number", value), "numeric")
    if isinstance(value, str):
        return Expr("literal", ("text", value), "text")
    if isinstance(value, dt.datetime):
        return Expr("literal", ("timestamp", value.isoformat()), "datetime")
    require(False, "bad-literal", f"{type(value).__name__} has no literal")
    raise AssertionError


def lift(value: Any) -> Expr:
    return value if isinstance(value, Expr) else literal(value)


def _pair(a: Any, b: Any, null_ok: bool = False) -> tuple[Expr, Expr]:
    x, y = lift(a), lift(b)
    if not null_ok:
        for e in (x, y):
            require(e.op != "literal" or e.args[0] != "null", "null-operand", "comparison with null is never true; use is_null")
    families = {x.family, y.family}
    require(len(families) == 1 or UNKNOWN in families or families in ({"text", "uuid"}, {"text", "datetime"}), "family-mismatch", f"{x.family} is compared with {y.family}")
    return x, y


# ---- operators -------------------------------------------------------------

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def _compare(op: str) -> Callable[[Any, Any], Expr]:
    def build(a: Any, b: Any) -> Expr:
        return Expr(op, _pair(a, b), "boolean")

    build.__name__ = op
    return build


eq, ne, gt, gte, lt, lte = map(_compare, _COMPARE)


def _text_match(op: str) -> Callable[[Any, Any], Expr]:
    def build(text: Any, pattern: Any) -> Expr:
        a, b = _pair(text, pattern)
        require(a.family in ("text", UNKNOWN), "family-mismatch", f"{op} needs text")
        return Expr(op, (a, b), "boolean")

    build.__name__ = op
    return build


like, ilike, not_like, not_ilike = map(_text_match, ("like", "ilike", "not_like", "not_ilike"))


def is_null(a: Any) -> Expr:
    return Expr("is_null", (lift(a),), "boolean")


def is_not_null(a: Any) -> Expr:
    return Expr("is_not_null", (lift(a),), "boolean")


def _many(op: str, parts: tuple) -> Expr:
    require(parts, "empty-operands", f"{op} needs an operand")
    args = tuple(map(lift, parts))
    require(all(a.family in ("boolean", UNKNOWN) for a in args), "family-mismatch", f"{op} needs conditions")
    return Expr(op, args, "boolean")


def and_(*parts: Any) -> Expr:
    return _many("and", parts)


def or_(*parts: Any) -> Expr:
    return _many("or", parts)


def not_(a: Any) -> Expr:
    return _many("not", (a,))


def in_array(a: Any, values: list) -> Expr:
    require(values, "empty-list", "in_array needs a value")
    x = lift(a)
    return Expr("in", (x, *(_pair(x, v, null_ok=True)[1] for v in values)), "boolean")


def not_in_array(a: Any, values: list) -> Expr:
    return not_(in_array(a, values))


def between(a: Any, low: Any, high: Any) -> Expr:
    return Expr("between", (lift(a), _pair(a, low, True)[1], _pair(a, high, True)[1]), "boolean")


def not_between(a: Any, low: Any, high: Any) -> Expr:
    return not_(between(a, low, high))


def coalesce(first: Any, *rest: Any) -> Expr:
    a = lift(first)
    return Expr("coalesce", (a, *map(lift, rest)), a.family)


def now() -> Expr:
    return Expr("now", (), "datetime")


def random_uuid() -> Expr:
    return Expr("uuid", (), "uuid")


#: Functions that call() may name: built-in, and without side effects.
CALLABLE = frozenset("abs btrim char_length length lower upper trim round concat left right substring date_trunc md5 sha2 current_user".split())


#: Functions that a project adds: any of Spark's, or one registered with the session.
_added: set[str] = set()


def allow_call(name: str) -> None:
    """Lets call() name a function beyond the built-in ones, such as a scalar that a project brings."""
    require(name.isidentifier(), "bad-name", f"{name!r} can't name a function")
    _added.add(name)


def call(name: str, *args: Any, family: str = UNKNOWN) -> Expr:
    require(name in CALLABLE or name in _added, "unknown-function", f"{name} can't be called")
    return Expr("call", (name, *map(lift, args)), family)


def sql(template: str, *values: Any, family: str = UNKNOWN) -> Expr:
    """SQL text with {} for each value; values enter as expressions or literals, never as text."""
    require(template.count("{}") == len(values), "bad-template", "one {} a value")
    return Expr("sql", (template, *map(lift, values)), family)


def exists(query: Any) -> Expr:
    return Expr("exists", (query,), "boolean")


def not_exists(query: Any) -> Expr:
    return not_(exists(query))


# ---- walking ---------------------------------------------------------------


def walk(e: Any) -> Iterator[Expr]:
    """The expression and all below it, subqueries included."""
    if isinstance(e, Expr):
        yield e
        for a in e.args:
            yield from walk(a)
    elif hasattr(e, "expressions"):
        for x in e.expressions():
            yield from walk(x)


def rewrite(e: Any, change: Callable[[Expr], Expr]) -> Any:
    """The same expression with change applied to every node, leaves first."""
    if isinstance(e, Expr):
        return change(replace(e, args=tuple(rewrite(a, change) for a in e.args)))
    if hasattr(e, "rewritten"):
        return e.rewritten(lambda x: rewrite(x, change))
    return e


def retarget(e: Expr, tables: dict[tuple[str, str], tuple[str, str]] | None = None, columns: dict[tuple[str, str, str], str] | None = None) -> Expr:
    """References after tables and columns were renamed; columns are named by their old table."""

    def change(x: Expr) -> Expr:
        if x.op != "ref":
            return x
        schema, table, column = x.args
        column = (columns or {}).get((schema, table, column), column)
        schema, table = (tables or {}).get((schema, table), (schema, table))
        return replace(x, args=(schema, table, column))

    return rewrite(e, change)


def tables_of(e: Expr) -> set[tuple[str, str]]:
    return {x.args[:2] for x in walk(e) if x.op == "ref"}


# ---- serialising -----------------------------------------------------------


def encode(e: Any) -> Any:
    if isinstance(e, Expr):
        return {"op": e.op, "family": e.family, "args": [encode(a) for a in e.args]}
    return {"query": e.encoded()} if hasattr(e, "encoded") else e


def decode(x: Any) -> Any:
    if isinstance(x, dict) and "op" in x:
        return Expr(x["op"], tuple(decode(a) for a in x["args"]), x["family"])
    if isinstance(x, dict) and "query" in x:
        from ..plans.query import Select

        return Select.decoded(x["query"])
    return x


# ---- compiling -------------------------------------------------------------


@dataclass(frozen=True)
class Scope:
    """What names mean: tables that are visible here, those of enclosing queries, and local values."""

    visible: frozenset[tuple[str, str]] = frozenset()
    outer: frozenset[tuple[str, str]] = frozenset()
    locals: tuple[tuple[str, Any], ...] = ()
    #: Turns a subquery and the scope around it into its DataFrame.
    subquery: Any = None
    #: References are plain column names, not table-qualified ones.
    bare: bool = False


def alias(schema: str, table: str) -> str:
    return f"{schema}__{table}"


def _literal(kind: str, value: Any) -> Column:
    if kind == "timestamp":
        return F.lit(value).cast("timestamp")
    return F.lit(value)


def compile_(e: Expr, scope: Scope) -> Column:
    a = e.args
    if e.op == "ref":
        schema, table, column = a
        if scope.bare:
            return F.col(column)
        if (schema, table) in scope.visible:
            return F.col(f"{alias(schema, table)}.{column}")
        require((schema, table) in scope.outer, "foreign-column-ref", f"{schema}.{table}.{column} isn't of a table in reach")
        return F.col(f"{alias(schema, table)}.{column}").outer()
    if e.op == "local":
        values = dict(scope.locals)
        require(a[0] in values, "unknown-local", f"{a[0]} isn't a local value")
        v = values[a[0]]
        return v if isinstance(v, Column) else F.lit(v)
    if e.op == "literal":
        return _literal(*a)
    if e.op == "exists":
        return scope.subquery(a[0], scope).exists()
    if e.op == "sql":
        return _template(a[0], a[1:], scope)
    if e.op == "call":
        return F.call_function(a[0], *(compile_(x, scope) for x in a[1:]))
    c = [compile_(x, scope) for x in a]
    if e.op in _COMPARE:
        return _COMPARE[e.op](c[0], c[1])
    return _COMPILE[e.op](*c)


def _template(template: str, values: tuple, scope: Scope) -> Column:
    return F.expr(template.format(*(_sql_leaf(v, scope) for v in values)))


def _sql_leaf(e: Expr, scope: Scope) -> str:
    """A template's value as SQL: a checked column name, or a quoted literal."""
    if e.op == "local":
        e = lift(dict(scope.locals)[e.args[0]])
    if e.op == "ref":
        schema, table, column = e.args
        require(scope.bare or (schema, table) in scope.visible, "foreign-column-ref", f"{schema}.{table}.{column} isn't of a table in reach")
        return f"`{column}`" if scope.bare else f"`{alias(schema, table)}`.`{column}`"
    require(e.op == "literal", "bad-template", "a template takes columns and plain values")
    kind, value = e.args
    if kind == "null":
        return "NULL"
    if kind in ("number", "boolean"):
        return repr(value).upper() if kind == "boolean" else repr(value)
    quoted = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"TIMESTAMP {quoted}" if kind == "timestamp" else quoted


_COMPILE: dict[str, Callable[..., Column]] = {
    "like": lambda a, b: F.like(a, b),
    "ilike": lambda a, b: F.ilike(a, b),
    "not_like": lambda a, b: ~F.like(a, b),
    "not_ilike": lambda a, b: ~F.ilike(a, b),
    "is_null": lambda a: a.isNull(),
    "is_not_null": lambda a: a.isNotNull(),
    "and": lambda *p: reduce(operator.and_, p),
    "or": lambda *p: reduce(operator.or_, p),
    "not": lambda a: ~a,
    "in": lambda a, *v: a.isin(*v),
    "between": lambda a, lo, hi: a.between(lo, hi),
    "coalesce": lambda *p: F.coalesce(*p),
    "now": lambda: F.current_timestamp(),
    "uuid": lambda: F.uuid(),
}
