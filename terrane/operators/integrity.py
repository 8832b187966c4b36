"""Constraints as queries for the rows that break them (none: valid), foreign-key actions, and an enforcing write path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import expressions as X
from ..sources.catalog import Check, Enum, ForeignKey, Index, Store, Table
from ..sources.checkpoints import cut


def not_null_violations(t: Table, rows: DataFrame) -> DataFrame:
    needed = [n for n, c in t.columns if not c.nullable]
    require(needed, "no-constraint", f"{t.name} has no required column")
    return rows.where(reduce(lambda a, b: a | b, (F.col(n).isNull() for n in needed)))


def duplicate_keys(rows: DataFrame, columns: list[str], where: X.Expr | None = None) -> DataFrame:
    """columns, n_rows: keys that stand more than once. Keys with a null are distinct from all others."""
    if where is not None:
        rows = rows.where(X.compile_(where, X.Scope(bare=True)))
    full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return rows.where(full).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def primary_key_violations(t: Table, rows: DataFrame) -> DataFrame:
    """Keys that stand more than once or have a null, with n_rows."""
    keys = t.primary_key()
    require(keys, "no-constraint", f"{t.name} has no primary key")
    some_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in keys))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | some_null)


def unique_index_violations(index: Index, rows: DataFrame) -> DataFrame:
    require(index.unique, "no-constraint", "the index isn't unique")
    return duplicate_keys(rows, [c for c, _, _ in index.columns], index.where)


def check_violations(check: Check, rows: DataFrame) -> DataFrame:
    """Rows for which the condition is false; null passes."""
    return rows.where(~F.coalesce(X.compile_(check.condition, X.Scope(bare=True)), F.lit(True)))


def enum_violations(enum: Enum, column: str, rows: DataFrame) -> DataFrame:
    return rows.where(~F.col(column).isin(*enum.values))


def _matched(child: DataFrame, parent: DataFrame, fk: ForeignKey, how: str) -> DataFrame:
    keys = parent.select(*(F.col(c).alias(f"_p_{c}") for c in fk.target_columns)).distinct()
    on = [F.col(a) == F.col(f"_p_{b}") for a, b in zip(fk.columns, fk.target_columns, strict=True)]
    return child.join(keys, on, how)


def foreign_key_violations(fk: ForeignKey, child: DataFrame, parent: DataFrame) -> DataFrame:
    """Child rows with a full key that the parent lacks."""
    full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in fk.columns))
    return _matched(child.where(full), parent, fk, "left_anti")


def on_parent_delete(t: Table, fk: ForeignKey, child: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The child after its parents went, and the child rows that went with them (cascade) or would block (restrict, no action)."""
    hit = _matched(child, deleted, fk, "left_semi")
    if fk.on_delete in ("restrict", "no action"):
        return child, hit
    if fk.on_delete == "cascade":
        return _matched(child, deleted, fk, "left_anti"), hit
    from .changes import default_of

    cleared = {c: F.lit(None).cast(child.schema[c].dataType) if fk.on_delete == "set null" else default_of(t, c) for c in fk.columns}
    kept = _matched(child, deleted, fk, "left_anti")
    return kept.unionByName(hit.withColumns(cleared).select(*child.columns)), hit.limit(0)


def on_parent_update(t: Table, fk: ForeignKey, child: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The child after its parents' keys changed, and the child rows that would block (restrict, no action). changed: the target columns, and as old__<column> what they were; null keys refer to nothing."""
    pairs = [(f"old__{b}", b) for b in fk.target_columns]
    moved = changed.where(reduce(lambda a, b: a | b, (~F.col(o).eqNullSafe(F.col(n)) for o, n in pairs)))
    keys = moved.select(*(F.col(o).alias(f"_p_{n}") for o, n in pairs), *(F.col(n).alias(f"_n_{n}") for _, n in pairs)).dropDuplicates([f"_p_{n}" for _, n in pairs])
    on = [F.col(a) == F.col(f"_p_{b}") for a, b in zip(fk.columns, fk.target_columns, strict=True)]
    if fk.on_update in ("restrict", "no action"):
        return child, child.join(keys, on, "left_semi")
    from .changes import default_of

    met = child.join(keys.withColumn("_hit", F.lit(True)), on, "left")
    value = {c: F.col(f"_n_{b}") if fk.on_update == "cascade" else F.lit(None).cast(child.schema[c].dataType) if fk.on_update == "set null" else default_of(t, c) for c, b in zip(fk.columns, fk.target_columns, strict=True)}
    cells = [F.when(F.col("_hit"), value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in child.columns]
    return met.select(*cells), child.limit(0)


def update_cascading(tables: list[Table], start: Table, changed: DataFrame, store: Store) -> dict[tuple[str, str], DataFrame]:
    """The states of the tables that refer to start, after its keys changed. A key that is itself referred to is followed further. changed: as for on_parent_update, with all columns of start."""
    states: dict[tuple[str, str], DataFrame] = {}
    waiting = [(start.key, changed)]
    while waiting:
        key, moved = waiting.pop(0)
        for t in tables:
            for fk in t.foreign_keys:
                if fk.target != key:
                    continue
                before = states.get(t.key, store.read(t.key)).select(*t.names())
                keep = before.withColumns({f"old__{c}": F.col(c) for c in t.names()})
                after, blocked = on_parent_update(t, fk, keep, moved)
                require(blocked.isEmpty(), "still-referenced", f"rows of {t.name} refer to the changed ones")
                states[t.key] = after.select(*t.names())
                used = {c for u in tables for f in u.foreign_keys if f.target == t.key for c in f.target_columns}
                if fk.on_update not in ("restrict", "no action") and used & set(fk.columns):
                    waiting.append((t.key, cut(after)))
    return states


def delete_cascading(tables: list[Table], start: Table, deleted: DataFrame, store: Store) -> dict[tuple[str, str], DataFrame]:
    """Every table's state after rows of start went, following foreign keys from table to table. A self-reference is followed level by level until no row is hit."""
    states = {t.key: store.read(t.key) for t in tables}
    names = [F.col(c) for c in start.names()]
    states[start.key] = states[start.key].join(deleted.select(*start.primary_key()), start.primary_key(), "left_anti").select(*names)
    waiting = [(start.key, deleted)]
    while waiting:
        gone_key, gone = waiting.pop(0)
        for t in tables:
            for fk in t.foreign_keys:
                if fk.target != gone_key:
                    continue
                states[t.key], hit = on_parent_delete(t, fk, states[t.key], gone)
                blocked = fk.on_delete in ("restrict", "no action")
                if blocked or fk.on_delete == "cascade":
                    # one look per edge of the graph of tables, at whether any row is hit
                    if t.key == gone_key:
                        hit, states[t.key] = cut(hit), cut(states[t.key])  # levels of a tree may be many
                    any_hit = not hit.isEmpty()
                    require(not (blocked and any_hit), "still-referenced", f"rows of {t.name} refer to the deleted ones")
                    if any_hit:
                        waiting.append((t.key, hit))
    return states


def violations(t: Table, rows: DataFrame, store: Store) -> DataFrame:
    """constraint, n: how many rows or keys break each of the table's constraints; only those that are broken."""
    from .batches import row_rules, uniques

    counted: list[DataFrame] = []
    rules = row_rules(t)
    if rules:
        # what a row can break by itself: one scan for all
        sums = rows.agg(*(F.count_if(broken).alias(f"_{k}") for k, (_, broken) in enumerate(rules)))
        counted.append(sums.select(F.inline(F.array(*(F.struct(F.lit(name).alias("constraint"), F.col(f"_{k}").alias("n")) for k, (name, _) in enumerate(rules))))))
    keys = [(u.name, primary_key_violations(t, rows) if u.name == "primary key" else duplicate_keys(rows, list(u.columns), u.where)) for u in uniques(t)]
    keys += [(f"foreign key {', '.join(f.columns)}", foreign_key_violations(f, rows, rows if f.target == t.key else store.read(f.target))) for f in t.foreign_keys]
    counted += [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("constraint"), "n") for name, df in keys]
    require(counted, "no-constraint", f"{t.name} has no constraint")
    return reduce(DataFrame.unionByName, counted).where("n > 0")


def enforce(t: Table, rows: DataFrame, store: Store) -> DataFrame:
    """rows, if they keep every constraint; else an error that names the broken ones."""
    broken = violations(t, rows, store).collect()  # at most one row per constraint
    require(not broken, "constraint-violated", "; ".join(f"{r['constraint']}: {r['n']}" for r in broken))
    return rows


def sorted_for(index: Index, rows: DataFrame) -> DataFrame:
    """Rows laid out as an ordered index would give them: range-partitioned and sorted within files, so that scans can skip."""
    way = {("asc", None): "asc_nulls_last", ("asc", "first"): "asc_nulls_first", ("asc", "last"): "asc_nulls_last", ("desc", None): "desc_nulls_first", ("desc", "first"): "desc_nulls_first", ("desc", "last"): "desc_nulls_last"}
    keys = [getattr(F.col(c), way[d, n])() for c, d, n in index.columns]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
