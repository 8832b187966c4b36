"""The enforcing write path: a change goes through before triggers, policies, constraints and after triggers, or fails as a whole.

The states that come back keep all of them, if the states before did: constraints of the table are
checked for the rows that change, and foreign keys of other tables that refer to them are followed, so
that a delete or a change of a key cascades, sets null or a default, or is refused. Each check looks at
the batch as a set; what reaches the driver is one row of a check that failed.

Tables that refer to the changed one are those bound to the store. Actions of foreign keys pass by
policies, and fire no row triggers of the tables they reach.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import expressions as X
from ..sources.catalog import Store, Table, snake
from ..sources.checkpoints import cut
from . import changes
from .batches import Follow, enforce_batch, missing_targets
from .routines import RowTrigger
from .security import Session


def _first(refused: DataFrame) -> None:
    row = refused.select("message").first()
    require(row is None, "raised", row["message"] if row else "")


def _through(triggers: Iterable[RowTrigger], t: Table, timing: str, event: str, store: Store, rows: DataFrame, set_columns: tuple[str, ...] = ()) -> DataFrame:
    """The batch after the triggers of this timing; before triggers may leave rows out, or give others."""
    for g in triggers:
        if g.table.key == t.key and g.timing == timing and g.fires(event, set_columns):
            returned, refused = g.run(store, rows, event)
            _first(refused)
            if timing == "before":
                rows = returned
    return rows


def _allowed(t: Table, rows: DataFrame, store: Store, command: str) -> None:
    if isinstance(store, Session):
        require(store.refused(t, rows, command).isEmpty(), "policy-violated", f"a new row of {t.name} is not let in by its policies")


def _reached(t: Table, where: X.Expr | None, store: Store, command: str) -> DataFrame:
    """All rows of the table with _hit: whether the condition, and the session's policies for this command and for reading, reach the row. One scan."""
    policies = [store.condition(t.key, c, "using") for c in (command, "select")] if isinstance(store, Session) else []
    conditions = [c for c in (where, *policies) if c is not None]
    scope = store.scope(t.key) if isinstance(store, Session) else X.Scope(frozenset([t.key]), subquery=lambda q, s: q.frame(store, s))
    hit = F.lit(True)
    for c in conditions:
        hit = hit & F.coalesce(X.compile_(c, scope), F.lit(False))
    return _under(store).read(t.key).select(*t.names()).alias(X.alias(*t.key)).withColumn("_hit", hit)


def _returned(t: Table, rows: DataFrame, store: Store) -> DataFrame:
    """Of the rows that a statement gives back those that the session may read."""
    condition = store.condition(t.key, "select", "using") if isinstance(store, Session) else None
    if condition is None:
        return rows
    return rows.alias(X.alias(*t.key)).where(X.compile_(condition, store.scope(t.key))).select(*t.names())


def _fixed(before: DataFrame, after: DataFrame) -> DataFrame:
    """What triggers left of a batch, written once if they changed it: checks and the new state must be of the same rows."""
    return after if after is before else cut(after)


def _followed(t: Table, store: Store, state: DataFrame) -> Follow:
    under = _under(store)
    return Follow(under, {**under.tables, t.key: t}, {t.key: state})


def _done(t: Table, follow: Follow, returned: DataFrame) -> changes.Change:
    follow.settle()
    return changes.Change(follow.states[t.key], returned, {k: v for k, v in follow.states.items() if k != t.key})


def _under(store: Store) -> Store:
    return store.store if isinstance(store, Session) else store


def insert(t: Table, new: DataFrame, store: Store, triggers: Iterable[RowTrigger] = (), order: list[str] | None = None) -> changes.Change:
    """Adds rows: serial numbers, before triggers, policies, constraints, after triggers."""
    under = _under(store)
    # written once: numbers, checks and the new state must be of the same rows
    batch = cut(changes.insert_rows(t, new, under, order).returned)
    batch = _fixed(batch, _through(triggers, t, "before", "insert", store, batch))
    _allowed(t, batch, store, "insert")
    rest = under.read(t.key).select(*t.names())
    enforce_batch(t, batch, rest, under)
    _through(triggers, t, "after", "insert", store, batch)
    return changes.Change(rest.unionByName(batch), _returned(t, batch, store))


def update(t: Table, set_: dict[str, Any], where: X.Expr | None, store: Store, triggers: Iterable[RowTrigger] = ()) -> changes.Change:
    """Changes the rows that the condition and the policies, those for reading as well, reach. A row that a before trigger leaves out stays as it was. Changed keys are followed to the tables that refer to them (others)."""
    require(set_, "empty-set", "an update sets a column at least")
    names, sets = t.names(), {snake(c): X.lift(v) for c, v in set_.items()}
    for c in sets:
        t[c]
    bare = X.Scope(bare=True, locals=tuple(store.values.items()) if isinstance(store, Session) else ())
    types = {n: c.spark_type() for n, c in t.columns}
    new = [(F.when(F.col("_hit"), X.compile_(sets[n], bare).cast(types[n])).otherwise(F.col(n)) if n in sets else F.col(n)).alias(n) for n in names]
    pairs = cut(_reached(t, where, store, "update").select(*new, *(F.col(n).alias(f"old__{n}") for n in names), "_hit"))
    batch = pairs.where("_hit").drop("_hit")
    batch = _fixed(batch, _through(triggers, t, "before", "update", store, batch, tuple(sets)))
    _allowed(t, batch.select(*names), store, "update")
    rest = pairs.where("not _hit").select(*names)
    # rows that refer to keys of their own table which this change moves are looked at when actions have followed
    moving = [f for f in t.foreign_keys if f.target == t.key and {*f.target_columns} & {*t.names()} & {*sets}]
    enforce_batch(replace(t, foreign_keys=tuple(f for f in t.foreign_keys if f not in moving)), batch.select(*names), rest, _under(store))
    _through(triggers, t, "after", "update", store, batch, tuple(sets))
    follow = _followed(t, store, rest.unionByName(batch.select(*names)))
    if follow.used(t.key):
        follow.spread(t.key, moved=batch)
    for f in moving:
        state = follow.states[t.key]
        require(missing_targets(t, f, state, state).isEmpty(), "constraint-violated", f"{t.name}: rows refer to keys that are gone")
    return _done(t, follow, _returned(t, batch.select(*names), store))


def delete(t: Table, where: X.Expr | None, store: Store, triggers: Iterable[RowTrigger] = ()) -> changes.Change:
    """Removes the rows that the condition and the policies reach, but for those that a before trigger leaves out. What refers to them goes, loses the key or blocks, as its foreign key says (others)."""
    names, rows = t.names(), cut(_reached(t, where, store, "delete"))
    gone = rows.where("_hit").select(*names)
    batch = _through(triggers, t, "before", "delete", store, gone)
    state = rows.where("not _hit").select(*names)
    if batch is not gone:
        keys = t.primary_key()
        require(keys, "no-constraint", f"{t.name} has no primary key to tell the rows apart that a trigger leaves")
        state = state.unionByName(gone.join(batch.select(*keys), keys, "left_anti").select(*names))
    _through(triggers, t, "after", "delete", store, batch)
    follow = _followed(t, store, state)
    if follow.used(t.key):
        follow.spread(t.key, gone=batch.select(*names))
    return _done(t, follow, batch)
