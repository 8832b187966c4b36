"""Select queries as values: one base table, inner joins, one condition, order and limit, compiled to a DataFrame.

Nulls sort last ascending and first descending. A second where() or order_by() replaces the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import expressions as X
from ..sources.catalog import Store, Table, snake

Key = tuple[str, str]


@dataclass(frozen=True)
class Select:
    base: Key
    projection: tuple[tuple[str, X.Expr], ...]
    joins: tuple[tuple[Key, X.Expr], ...] = ()
    condition: X.Expr | None = None
    order: tuple[tuple[X.Expr, str], ...] = ()
    count: int | None = None

    def inner_join(self, other: Table, on: X.Expr) -> Select:
        return replace(self, joins=(*self.joins, (other.key, on)))

    def where(self, condition: X.Expr) -> Select:
        return replace(self, condition=condition)

    def order_by(self, *terms: X.Expr | tuple[X.Expr, str]) -> Select:
        pairs = tuple(t if isinstance(t, tuple) else (t, "asc") for t in terms)
        require(all(d in ("asc", "desc") for _, d in pairs), "bad-order", "asc or desc")
        return replace(self, order=pairs)

    def limit(self, n: int) -> Select:
        require(isinstance(n, int) and not isinstance(n, bool) and n >= 0, "bad-limit", "a whole number from 0")
        return replace(self, count=n)

    # what walking, rewriting and serialising an expression with a subquery need

    def expressions(self) -> Iterator[X.Expr]:
        yield from (e for _, e in self.projection)
        yield from (e for _, e in self.joins)
        if self.condition is not None:
            yield self.condition
        yield from (e for e, _ in self.order)

    def rewritten(self, change: Callable[[X.Expr], X.Expr]) -> Select:
        return replace(
            self,
            projection=tuple((n, change(e)) for n, e in self.projection),
            joins=tuple((k, change(e)) for k, e in self.joins),
            condition=None if self.condition is None else change(self.condition),
            order=tuple((change(e), d) for e, d in self.order),
        )

    def encoded(self) -> dict[str, Any]:
        return {
            "base": list(self.base),
            "projection": [[n, X.encode(e)] for n, e in self.projection],
            "joins": [[list(k), X.encode(e)] for k, e in self.joins],
            "condition": X.encode(self.condition) if self.condition else None,
            "order": [[X.encode(e), d] for e, d in self.order],
            "count": self.count,
        }

    @classmethod
    def decoded(cls, x: dict[str, Any]) -> Select:
        return cls(
            tuple(x["base"]),
            tuple((n, X.decode(e)) for n, e in x["projection"]),
            tuple((tuple(k), X.decode(e)) for k, e in x["joins"]),
            X.decode(x["condition"]) if x["condition"] else None,
            tuple((X.decode(e), d) for e, d in x["order"]),
            x["count"],
        )

    def columns(self) -> list[str]:
        return [n for n, _ in self.projection]

    def frame(self, store: Store, scope: X.Scope = X.Scope()) -> DataFrame:
        keys = [self.base, *(k for k, _ in self.joins)]
        require(len(set(keys)) == len(keys), "table-twice", "a query reads a table once; it has no aliases")
        inner = X.Scope(frozenset(keys), scope.visible | scope.outer, scope.locals, lambda q, s: q.frame(store, s))
        out = _named(store, self.base)
        for k, (key, on) in enumerate(self.joins):
            seen = replace(inner, visible=frozenset(keys[: k + 2]))
            out = out.join(_named(store, key), X.compile_(on, seen), "inner")
        if self.condition is not None:
            out = out.where(X.compile_(self.condition, inner))
        if self.order:
            out = out.orderBy(*(sort_key(X.compile_(e, inner), d) for e, d in self.order))
        if self.count is not None:
            out = out.limit(self.count)
        return out.select(*(X.compile_(e, inner).alias(n) for n, e in self.projection))


def sort_key(c: Column, direction: str) -> Column:
    return c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first()


def _named(store: Store, key: Key) -> DataFrame:
    return store.read(key).alias(X.alias(*key))


def select(what: Table | dict[str, X.Expr], base: Table | None = None) -> Select:
    """All columns of a table in order, or named expressions over base."""
    if isinstance(what, Table):
        return Select(what.key, tuple((n, what[n]) for n in what.names()))
    require(base is not None, "no-base", "named expressions need a base table")
    require(what, "empty-projection", "a query yields a column at least")
    return Select(base.key, tuple((snake(n), X.lift(e)) for n, e in what.items()))


@dataclass(frozen=True)
class View:
    schema: str
    name: str
    query: Select
    #: Reads under the policies of who asks, not of the owner.
    security_invoker: bool = False

    def create(self, store: Store) -> DataFrame:
        out = self.query.frame(store)
        out.createOrReplaceTempView(f"{self.schema}__{self.name}")
        return out
