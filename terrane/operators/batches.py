"""Constraints checked by the rows that change, and changes followed along the foreign keys that refer to them.

A table that keeps its constraints still does after a change if the rows of the change do: their own
conditions, their keys against each other and against the rows that stay, the keys they refer to.
So a check reads the batch, the key columns of the rest in one scan, and the keys of each table
referred to; never the whole state once for each constraint.

Deletes and key updates go on along incoming foreign keys with a work list: only children with touched
keys are joined, and only what a foreign key's action changes is handed on.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require
from ..functions import expressions as X
from ..sources.catalog import ForeignKey, Store, Table
from ..sources.checkpoints import cut

Key = tuple[str, str]


@dataclass(frozen=True)
class Unique:
    name: str
    columns: tuple[str, ...]
    where: X.Expr | None = None
    #: Whether all its columns are compared as text.
    text: bool = False


def uniques(t: Table) -> list[Unique]:
    """The table's keys: primary, unique columns, unique indexes."""
    out = [Unique("primary key", tuple(t.primary_key()))] if t.primary_key() else []
    out += [Unique(f"unique {n}", (n,)) for n, c in t.columns if c.is_unique]
    return out + [Unique(f"index {', '.join(c for c, _, _ in i.columns)}", tuple(c for c, _, _ in i.columns), i.where) for i in t.indexes if i.unique]


def row_rules(t: Table) -> list[tuple[str, Column]]:
    """Name, and when a row breaks it: required columns, checks, enums."""
    needed = [n for n, c in t.columns if not c.nullable]
    out = [("not null", reduce(lambda a, b: a | b, (F.col(n).isNull() for n in needed)))] if needed else []
    out += [(f"check {c.name}", ~F.coalesce(X.compile_(c.condition, X.Scope(bare=True)), F.lit(True))) for c in t.checks]
    return out + [(f"enum {n}", ~F.col(n).isin(*c.values)) for n, c in t.columns if c.values]


def _cell(t: Table, name: str, text: bool = False) -> tuple[str, Column]:
    """A key column as a value that is equal when values are, with its type's name: of its declared type, or text where that type compares otherwise (two zeros) or not at all."""
    kind, c = dict(t.columns)[name].spark_type(), F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "string", (c.cast(kind) + F.lit(0.0).cast(kind)).cast("string")  # one zero
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return "string", F.to_json(F.struct(c))
    if isinstance(kind, T.BinaryType):
        return "string", F.hex(c)
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string", c.cast("string")
    if not text and isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return kind.simpleString(), c.cast(kind)
    return "string", c.cast(kind).cast("string")


def _fields(t: Table, u: Unique) -> dict[str, Column]:
    """A constraint's key as named fields. Names tell types apart and are numbered within a type, so that constraints share fields."""
    out: dict[str, Column] = {}
    for c in u.columns:
        kind, cell = _cell(t, c, u.text)
        out[f"{kind} {sum(n.startswith(f'{kind} ') for n in out)}"] = cell
    return out


def _unused(name: str) -> Column:
    """The value of a field that a constraint doesn't use. It isn't null, as fields are joined on."""
    kind = name.rsplit(" ", 1)[0]
    return F.lit("" if kind == "string" else "1970-01-01" if kind.startswith(("date", "timestamp")) else 0).cast(kind)


def _entries(rows: DataFrame, t: Table, keys: list[Unique], places: range | None = None) -> DataFrame:
    """of, and fields of keys: each row's complete keys, of all constraints or those at some places, in one scan of their columns.

    of: the constraint's place. t: whose declared types the columns have.
    """
    fields = [_fields(t, u) for u in keys]
    names = sorted({n for f in fields for n in f})
    each = []
    for k in places or range(len(keys)):
        full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in keys[k].columns))
        if keys[k].where is not None:
            full = full & F.coalesce(X.compile_(keys[k].where, X.Scope(bare=True)), F.lit(False))
        each.append((full, [F.lit(k).alias("of"), *((fields[k][n] if n in fields[k] else _unused(n)).alias(n) for n in names)]))
    if len(each) == 1:
        out = rows.where(each[0][0]).select(*each[0][1])
    else:
        out = rows.select(F.inline(F.array(*(F.when(full, F.struct(*entry)) for full, entry in each))))
    # said here for all of them, so that a join adds no filter of its own, and its shuffle can be one that is there already
    return out.where(reduce(lambda a, b: a & b, (F.col(f"`{n}`").isNotNull() for n in out.columns)))


def batch_violations(t: Table, batch: DataFrame, rest: DataFrame, read: Store | None = None, others: dict[Key, DataFrame] | None = None) -> list[tuple[str, int]]:
    """Constraints that the batch breaks, with how many rows or keys do, the rest keeping them.

    batch: new rows, or changed ones as they are now. rest: the rows that stay. others: states of other
    tables that a statement changes as well.
    """
    found: list[tuple[str, int]] = []
    rules = row_rules(t)
    if rules:
        sums = batch.agg(*(F.count_if(broken).alias(f"_{k}") for k, (_, broken) in enumerate(rules))).first()
        found += [(name, sums[k]) for k, (name, _) in enumerate(rules) if sums[k]]
    own = [f for f in t.foreign_keys if f.target == t.key]
    mine = uniques(t)
    asking = mine + [Unique(_name(f), f.columns, text=True) for f in own]
    holding = mine + [Unique(_name(f), f.target_columns, text=True) for f in own]
    referring = range(len(mine), len(asking))
    probes = [_entries(batch, t, asking, range(len(mine)))] if mine else []
    if own:
        # what rows of the batch refer to counts as there if the batch or the rest has it
        given = _entries(batch, t, holding, referring).distinct()
        wanted = _entries(batch, t, asking, referring).distinct()
        probes.append(wanted.join(given, wanted.columns, "left_anti"))
    if probes:
        entries = reduce(DataFrame.unionByName, probes)
        counted = entries.groupBy(*entries.columns).agg(F.count(F.lit(1)).alias("n"))
        # the rest is streamed past the batch's keys, which are the small side; keys that stand twice are broken already
        met = _entries(rest, t, holding).join(counted.where("n = 1"), entries.columns, "left_semi")
        # each once: a merge join leaves them sorted, so a sorted window holds less than a hash table
        place = F.row_number().over(Window.partitionBy(*entries.columns).orderBy("of"))
        known = met.withColumn("_place", place).where("_place = 1")
        # a key is broken if it stands twice or is known, a reference if it isn't known; both counts read one shuffle of the batch's keys
        at = [F.col("of") == k for k in range(len(asking))]
        alone = counted.agg(*(F.count_if(here & (F.col("n") > 1) if k < len(mine) else here).alias(f"_{k}") for k, here in enumerate(at)))
        among = known.agg(*((F.count_if(here) * (1 if k < len(mine) else -1)).alias(f"_{k}") for k, here in enumerate(at)))
        sums = [sum(ns) for ns in zip(*alone.unionByName(among).collect(), strict=True)]  # two rows
        found += [(u.name, n) for u, n in zip(asking, sums, strict=True) if n]
    for f in t.foreign_keys:
        if f.target != t.key:
            n = missing_targets(t, f, batch, (others or {}).get(f.target) if others and f.target in others else read.read(f.target)).count()
            found += [(_name(f), n)] if n else []
    return found


def _name(f: ForeignKey) -> str:
    return f"foreign key {', '.join(f.columns)}"


def missing_targets(t: Table, f: ForeignKey, batch: DataFrame, parent: DataFrame) -> DataFrame:
    """The distinct complete keys of the batch that the parent lacks, in f's columns. The parent is streamed past them."""
    full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in f.columns))
    wanted = batch.where(full).select(*f.columns).distinct()
    there = parent.select(*(F.col(b).alias(a) for a, b in zip(f.columns, f.target_columns, strict=True)))
    return wanted.join(there.join(wanted, list(f.columns), "left_semi").distinct(), list(f.columns), "left_anti")


def enforce_batch(t: Table, batch: DataFrame, rest: DataFrame, store: Store, others: dict[Key, DataFrame] | None = None) -> None:
    broken = batch_violations(t, batch, rest, store, others)
    require(not broken, "constraint-violated", f"{t.name}: " + "; ".join(f"{name}: {n}" for name, n in broken))


# ---- following changes


def incoming(tables: Iterable[Table]) -> dict[Key, list[tuple[Table, ForeignKey]]]:
    """Foreign keys by the table they refer to."""
    out: dict[Key, list[tuple[Table, ForeignKey]]] = {}
    for t in tables:
        for f in t.foreign_keys:
            out.setdefault(f.target, []).append((t, f))
    return out


@dataclass
class Follow:
    """The states of tables while a statement's effects spread. states: of tables changed so far."""

    store: Store
    tables: dict[Key, Table]
    states: dict[Key, DataFrame] = field(default_factory=dict)
    #: Foreign keys whose action is "no action": what they lost, to be looked at when all is done.
    waiting: list[tuple[Table, ForeignKey, DataFrame]] = field(default_factory=list)
    changed: dict[Key, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.incoming = incoming(self.tables.values())

    def state(self, t: Table) -> DataFrame:
        return self.states[t.key] if t.key in self.states else self.store.read(t.key).select(*t.names())

    def put(self, t: Table, rows: DataFrame) -> None:
        # a table that is changed again and again would grow a plan with each time
        self.changed[t.key] = self.changed.get(t.key, 0) + 1
        self.states[t.key] = cut(rows) if self.changed[t.key] > 1 else rows

    def used(self, key: Key) -> set[str]:
        """The columns of a table that others refer to."""
        return {c for _, f in self.incoming.get(key, ()) for c in f.target_columns}

    def spread(self, key: Key, gone: DataFrame | None = None, moved: DataFrame | None = None) -> None:
        """Follows rows that went (all columns of the table), or whose keys changed (all columns, and as old__<column> what they were)."""
        work = [(key, gone, moved)]
        while work:
            key, gone, moved = work.pop(0)
            for child, f in self.incoming.get(key, ()):
                work += self._delete(child, f, gone) if gone is not None else self._update(child, f, moved)

    def _delete(self, child: Table, f: ForeignKey, gone: DataFrame) -> list[tuple[Key, DataFrame | None, DataFrame | None]]:
        keys = _complete(gone.select(*(F.col(b).alias(a) for a, b in zip(f.columns, f.target_columns, strict=True))), f.columns).distinct()
        return self._act(child, f, f.on_delete, keys)

    def _update(self, child: Table, f: ForeignKey, moved: DataFrame) -> list[tuple[Key, DataFrame | None, DataFrame | None]]:
        differs = reduce(lambda a, b: a | b, (~F.col(f"old__{b}").eqNullSafe(F.col(b)) for b in f.target_columns))
        old = moved.where(differs).select(*(F.col(f"old__{b}").alias(a) for a, b in zip(f.columns, f.target_columns, strict=True)), *(F.col(b).alias(f"new__{a}") for a, b in zip(f.columns, f.target_columns, strict=True)))
        return self._act(child, f, f.on_update, _complete(old, f.columns).dropDuplicates(list(f.columns)), update=True)

    def _act(self, child: Table, f: ForeignKey, action: str, keys: DataFrame, update: bool = False) -> list[tuple[Key, DataFrame | None, DataFrame | None]]:
        names, on = child.names(), list(f.columns)
        if action == "no action":
            self.waiting.append((child, f, keys.select(*on)))
            return []
        before = self.state(child)
        if action == "restrict":
            require(before.join(keys.select(*on), on, "left_semi").isEmpty(), "still-referenced", f"rows of {child.name} refer to {'the changed' if update else 'the deleted'} ones")
            return []
        if action == "cascade" and not update:
            hit = cut(before.join(keys, on, "left_semi").select(*names))
            if hit.isEmpty():
                return []
            self.put(child, before.join(keys, on, "left_anti").select(*names))
            return [(child.key, hit, None)]
        from .changes import default_of

        types = {n: c.spark_type() for n, c in child.columns}
        value = {c: (F.col(f"new__{c}") if action == "cascade" else F.lit(None) if action == "set null" else default_of(child, c)).cast(types[c]) for c in f.columns}
        met = before.join(keys, on)
        hit = cut(met.select(*(value.get(n, F.col(n)).alias(n) for n in names), *(F.col(n).alias(f"old__{n}") for n in names)))
        if hit.isEmpty():
            return []
        rest, batch = before.join(keys.select(*on), on, "left_anti").select(*names), hit.select(*names)
        # for a table that refers to itself, the parents' own new rows are in the state already
        enforce_batch(child, batch, rest, self.store, self.states)
        self.put(child, rest.unionByName(batch))
        return [(child.key, None, hit)] if self.used(child.key) & set(f.columns) else []

    def settle(self) -> None:
        """Refuses if a key that went, and wasn't acted on, is still referred to and hasn't come back."""
        for child, f, keys in self.waiting:
            left = self.state(child).join(keys, list(f.columns), "left_semi").select(*f.columns).distinct()
            parent = self.tables[f.target]
            back = self.state(parent).select(*(F.col(b).alias(a) for a, b in zip(f.columns, f.target_columns, strict=True)))
            require(left.join(back, list(f.columns), "left_anti").isEmpty(), "still-referenced", f"rows of {child.name} refer to keys of {parent.name} that are gone")


def _complete(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))
