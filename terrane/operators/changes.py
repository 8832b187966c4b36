"""Inserts, upserts, updates and deletes as copy-on-write: each gives the table's next state and the rows it returns.

Right-hand sides see the old row. A condition that is null leaves the row alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require
from ..functions import expressions as X
from ..sources.catalog import Store, Table, snake
from ..sources.checkpoints import cut

DEFAULT = object()


@dataclass(frozen=True)
class Change:
    """state: the table afterwards. returned: the rows the statement inserted, changed or removed, all columns in order. others: states of tables that foreign keys' actions changed."""

    state: DataFrame
    returned: DataFrame
    others: dict[tuple[str, str], DataFrame] = field(default_factory=dict)


def _row_scope(t: Table, store: Store) -> X.Scope:
    return X.Scope(frozenset([t.key]), subquery=lambda q, s: q.frame(store, s))


def _old(t: Table, store: Store) -> DataFrame:
    return store.read(t.key).select(*t.names()).alias(X.alias(*t.key))


def default_of(t: Table, name: str) -> Column:
    c = dict(t.columns)[name]
    if c.default_ is None:
        return F.lit(None).cast(c.spark_type())
    return X.compile_(c.default_, X.Scope()).cast(c.spark_type())


def values_frame(t: Table, rows: list[dict[str, Any]], store: Store) -> DataFrame:
    """Literal rows with all columns: the keys given anywhere, in the order first seen; what a row lacks is the column's default."""
    require(rows, "no-values", "an insert needs a row")
    rows = [{snake(k): v for k, v in r.items()} for r in rows]
    given = list(dict.fromkeys(k for r in rows for k in r))
    require(set(given) <= set(t.names()), "unknown-column", f"{set(given) - set(t.names())} aren't columns of {t.name}")
    one = store.spark.range(1)
    types = {n: c.spark_type() for n, c in t.columns}

    def cell(r: dict[str, Any], n: str) -> Column:
        if n not in r or r[n] is DEFAULT:
            return default_of(t, n)
        return X.compile_(X.lift(r[n]), X.Scope()).cast(types[n])

    # one array of rows, so that many rows stay one plan node
    structs = [F.struct(*(cell(r, n).alias(n) for n in t.names()), F.lit(k).alias(PLACE)) for k, r in enumerate(rows)]
    return one.select(F.inline(F.array(*structs)))


#: The place of a literal row among those given with it.
PLACE = "_place"


def assign_serials(new: DataFrame, old: DataFrame, t: Table, order: list[str]) -> DataFrame:
    """Numbers serial columns that are null, after the largest number so far, in the given order."""
    for name, c in t.columns:
        if c.serial:
            top = old.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
            # numbering within range partitions, so that no task orders all rows; they are written with
            # their partition's number, since a plan that is run twice may cut them differently
            parts = cut(new.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
            counts = parts.where(F.col(name).isNull()).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
            ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            offsets = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
            inside = Window.partitionBy("_part", F.col(name).isNull()).orderBy(*order)
            # one offset a partition
            numbered = parts.withColumn("_k", F.row_number().over(inside)).join(F.broadcast(offsets), "_part", "left")
            value = F.coalesce(F.col(name), F.lit(top) + F.coalesce("_ahead", F.lit(0)) + F.col("_k")).cast(c.spark_type())
            new = numbered.withColumn(name, value).select(*new.columns)
    return new


def insert_rows(t: Table, new: DataFrame, store: Store, order: list[str] | None = None) -> Change:
    """Adds rows; serial columns that are null get the next numbers, in order (by all other columns, if none is given)."""
    old = store.read(t.key).select(*t.names())
    if any(c.serial for _, c in t.columns):
        new = assign_serials(new, old, t, order or [n for n, c in t.columns if not c.serial and sortable(new.schema[n].dataType)])
    new = new.select(*t.names())
    return Change(old.unionByName(new), new)


def insert(t: Table, rows: list[dict[str, Any]], store: Store) -> Change:
    return insert_rows(t, values_frame(t, rows, store), store, [PLACE])


def _targets(t: Table, columns: list[str]) -> list[str]:
    require(columns, "no-conflict-target", "name the columns that may conflict")
    for c in columns:
        t[c]
    return columns


def sortable(kind: T.DataType) -> bool:
    """Whether values of this type have an order; json values and maps, alone or inside others, have none."""
    if isinstance(kind, T.ArrayType):
        return sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.VariantType, T.MapType))


def _complete(keys: list[str]) -> Column:
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    return complete


def _first(rows: DataFrame, keys: list[str], order: list[str], ahead: Column | None = None) -> DataFrame:
    """Of rows with equal keys the first by ahead, then in order, then by the other columns that can be ordered; null keys equal nothing.

    Each task leaves one row a key before the shuffle, and rows with null keys are keyed one by one, so no key gathers rows.
    """
    terms = [*order, *(f.name for f in rows.schema.fields if f.name not in order and sortable(f.dataType))]
    lone = rows.withColumn("_lone", F.when(_complete(keys), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy(*keys, "_lone").orderBy(*([] if ahead is None else [ahead]), *terms))
    return lone.withColumn("_place", place).where("_place = 1").drop("_lone", "_place")


def first_of_each(new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of new rows with equal keys the first in order; null keys equal nothing."""
    return _first(new, keys, order)


def insert_or_skip(t: Table, new: DataFrame, conflict: list[str], order: list[str], store: Store) -> Change:
    """Adds the new rows whose keys the table lacks; of equal new keys the first in order. Old keys and new rows are settled together, by one shuffle."""
    keys = _targets(t, conflict)
    old = store.read(t.key).select(*t.names())
    there = old.where(_complete(keys)).select(*keys, F.lit(True).alias("_old"))
    # an old row with its key comes first, and stands for "there is one"
    both = new.select(*t.names(), F.lit(False).alias("_old")).unionByName(there, allowMissingColumns=True)
    fresh = _first(both, keys, order, F.desc("_old")).where("not _old").select(*t.names())
    return Change(old.unionByName(fresh), fresh)


def insert_or_update(t: Table, new: DataFrame, conflict: list[str], set_: dict[str, Any], order: list[str], store: Store) -> Change:
    """Adds rows with new keys; changes rows whose keys exist by set_, whose expressions see the old row, and as local values (new_<column>) the new one."""
    keys = _targets(t, conflict)
    require(set_, "empty-set", "an update sets a column at least")
    old = store.read(t.key).select(*t.names(), F.lit(True).alias("_old"))
    one = first_of_each(new.select(*t.names()), keys, order)
    renamed = one.select(*(F.col(c).alias(f"_new_{c}") for c in t.names()), F.lit(True).alias("_new"))
    on = [F.col(k) == F.col(f"_new_{k}") for k in keys]
    both = old.join(renamed, on, "full_outer")
    scope = X.Scope(bare=True, locals=tuple((f"new_{c}", F.col(f"_new_{c}")) for c in t.names()))
    sets = {snake(c): X.compile_(X.lift(v), scope).cast(dict(t.columns)[snake(c)].spark_type()) for c, v in set_.items()}
    hit = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    cells = [F.when(hit, sets.get(c, F.col(c))).when(F.col("_old").isNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in t.names()]
    out = both.select(*cells, F.col("_new").isNotNull().alias("_touched"))
    return Change(out.select(*t.names()), out.where("_touched").select(*t.names()))


def _flagged(t: Table, where: X.Expr | None, store: Store) -> DataFrame:
    """The old rows with _hit: whether the condition is true."""
    hit = F.lit(True) if where is None else F.coalesce(X.compile_(where, _row_scope(t, store)), F.lit(False))
    return _old(t, store).withColumn("_hit", hit)


def update(t: Table, set_: dict[str, Any], where: X.Expr | None, store: Store) -> Change:
    require(set_, "empty-set", "an update sets a column at least")
    flagged = _flagged(t, where, store)
    scope = X.Scope(bare=True)
    for c in set_:
        t[snake(c)]
    sets = {snake(c): X.compile_(X.lift(v), scope).cast(dict(t.columns)[snake(c)].spark_type()) for c, v in set_.items()}
    out = flagged.select(*(F.when(F.col("_hit"), sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in t.names()), "_hit")
    return Change(out.select(*t.names()), out.where("_hit").select(*t.names()))


def delete(t: Table, where: X.Expr | None, store: Store) -> Change:
    flagged = _flagged(t, where, store)
    return Change(flagged.where("not _hit").select(*t.names()), flagged.where("_hit").select(*t.names()))
