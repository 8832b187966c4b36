"""Snapshots of declarations as rows (kind, identity, node), and what lies between two of them: changes, their order, renames.

Nodes are canonical JSON: sorted keys, no spaces. Snapshots are metadata, but everything here that
compares two of them is a join, so a catalog of any size can be compared.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions import expressions as X
from ..sources.catalog import SERIAL, Table

VERSION = 1
SCHEMA = "kind string, identity string, node string"
#: Kinds, each after those it depends on.
DEPENDS: dict[str, tuple[str, ...]] = {
    "schema": (),
    "enum": ("schema",),
    "sequence": ("schema",),
    "table": ("schema", "enum", "sequence"),
    "view": ("table",),
    "function": ("table",),
    "trigger": ("table", "function"),
    "rls": ("table",),
    "policy": ("rls", "table"),
    "grant": ("schema", "table"),
}


def canonical(node: Any) -> str:
    return json.dumps(node, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fnv1a(text: str) -> str:
    """32-bit FNV-1a of the text's UTF-8 bytes, as hex."""
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 % (1 << 32)
    return f"{h:08x}"


def ranks(depends: dict[str, tuple[str, ...]] = DEPENDS) -> dict[str, int]:
    """Place of each kind among all, dependencies first."""
    for kind, on in depends.items():
        require(set(on) <= set(depends), "unknown-kind", f"{kind} depends on {set(on) - set(depends)}")
    try:
        return {k: n for n, k in enumerate(TopologicalSorter(depends).static_order())}
    except CycleError as e:
        require(False, "kind-cycle", str(e.args[1]))
        raise


def table_node(t: Table) -> dict[str, Any]:
    """Serial columns stand as their integer type; their sequence is an object of its own."""
    columns = [
        {"name": n, "type": SERIAL.get(c.type, c.type), "length": list(c.length), "dimensions": c.dimensions, "nullable": c.nullable, "primary": c.primary, "unique": c.is_unique, "default": X.encode(c.default_) if c.default_ else None}
        for n, c in t.columns
    ]
    names = t.derived_names()
    return {
        "columns": columns,
        "indexes": [{"name": n, "columns": [list(c) for c in i.columns], "unique": i.unique, "where": X.encode(i.where) if i.where else None} for n, i in zip(names["idx"], t.indexes, strict=True)],
        "foreign_keys": [{"name": n, "columns": list(f.columns), "target": list(f.target), "target_columns": list(f.target_columns), "on_delete": f.on_delete, "on_update": f.on_update} for n, f in zip(names["fk"], t.foreign_keys, strict=True)],
        "checks": [{"name": c.name, "condition": X.encode(c.condition)} for c in t.checks],
    }


def expand(tables: Iterable[Table]) -> list[tuple[str, str, str]]:
    """Rows of a snapshot: each managed table, its schema and its sequences."""
    rows: dict[tuple[str, str], str] = {}
    for t in tables:
        if t.existing:
            continue
        rows["schema", t.schema] = canonical({})
        key = ("table", f"{t.schema}.{t.name}")
        require(key not in rows, "duplicate-object", key[1])
        rows[key] = canonical(table_node(t))
        for name in t.derived_names()["seq"]:
            rows["sequence", f"{t.schema}.{name}"] = canonical({"table": t.name})
    return [(k, i, n) for (k, i), n in sorted(rows.items())]


def snapshot(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def duplicates(rows: DataFrame) -> DataFrame:
    """kind, identity, n: objects declared more than once."""
    return rows.groupBy("kind", "identity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def save(rows: DataFrame, path: str) -> None:
    rows.withColumn("version", F.lit(VERSION)).write.mode("error").json(path)


def load(spark: SparkSession, path: str, required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The rows of a saved snapshot. required: keys that nodes of each kind must have, such as kinds.REQUIRED."""
    got = spark.read.schema(SCHEMA + ", version int").json(path)
    bad = got.where((F.col("version") != VERSION) | F.col("kind").isNull() | F.col("identity").isNull() | F.try_parse_json("node").isNull())
    require(bad.isEmpty(), "bad-snapshot", f"{path} has rows of another version or without a key or node")
    rows = got.select("kind", "identity", "node")
    if required is not None:
        from .kinds import missing_keys

        lacking = missing_keys(rows, required).first()
        require(lacking is None, "bad-snapshot", f"{path}: {lacking and lacking['identity']} lacks {lacking and lacking['missing']}")
    return rows


# ---- differences -----------------------------------------------------------


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, identity, operation (create, alter, drop), previous, next: of objects that differ."""
    a, b = before.select("kind", "identity", F.col("node").alias("previous")), after.select("kind", "identity", F.col("node").alias("next"))
    both = a.join(b, ["kind", "identity"], "full_outer").where(~F.col("previous").eqNullSafe(F.col("next")))
    operation = F.when(F.col("previous").isNull(), "create").when(F.col("next").isNull(), "drop").otherwise("alter")
    return both.select("kind", "identity", operation.alias("operation"), "previous", "next")


#: Kinds that are dropped before anything else, as others don't stand on them.
DEPENDENT = ("view", "function", "trigger", "policy")


def ordered(changes: DataFrame, depends: dict[str, tuple[str, ...]] = DEPENDS, dependent_kinds: tuple[str, ...] = DEPENDENT) -> DataFrame:
    """Changes with their stage and rank, in order: objects that lose what they depend on are dropped first, then creations and alterations by rising rank, drops by falling rank."""
    rank = F.create_map(*(F.lit(x) for k, n in ranks(depends).items() for x in (k, n)))
    out = changes.withColumn("rank", F.element_at(rank, F.col("kind")))
    dependent = F.col("kind").isin(*dependent_kinds)
    drop = F.col("operation") == "drop"
    out = out.withColumn("stage", F.when(drop & dependent, 0).when(drop, 2).otherwise(1))
    return out.orderBy("stage", F.when(drop, -F.col("rank")).otherwise(F.col("rank")), "kind", "identity")


_COLUMN = "array<struct<name string, type string, length array<int>, dimensions int, nullable boolean, primary boolean, unique boolean, default string>>"
_NODE = f"columns {_COLUMN}"


def _columns(rows: DataFrame, node: str) -> DataFrame:
    parsed = rows.select("identity", F.from_json(node, _NODE).alias("n"))
    return parsed.select("identity", F.posexplode("n.columns").alias("place", "c")).select("identity", "place", F.col("c.name").alias("column"), F.to_json("c").alias("definition"))


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """identity, column, operation, previous, next: of the tables in both snapshots."""
    both = before.where("kind = 'table'").join(after.where("kind = 'table'").select("identity"), "identity", "left_semi")
    a = _columns(both, "node").select("identity", "column", F.col("definition").alias("previous"))
    b = _columns(after.where("kind = 'table'").join(both.select("identity"), "identity", "left_semi"), "node").select("identity", "column", F.col("definition").alias("next"))
    out = a.join(b, ["identity", "column"], "full_outer").where(~F.col("previous").eqNullSafe(F.col("next")))
    return out.select("identity", "column", F.when(F.col("previous").isNull(), "add").when(F.col("next").isNull(), "drop").otherwise("alter").alias("operation"), "previous", "next")


def physical_order(before: Column, declared: Column) -> Column:
    """Column names as they lie: survivors in their old order, then newcomers as declared."""
    return F.concat(F.filter(before, lambda c: F.array_contains(declared, c)), F.filter(declared, lambda c: ~F.array_contains(before, c)))


def replaces_view(before: Column, after: Column) -> Column:
    """A view can be replaced if its old columns are the first of the new ones; else it is dropped and created."""
    return F.slice(after, F.lit(1), F.size(before)) == before


def appends_enum(before: Column, after: Column) -> Column:
    """An enum can grow if its old values are the first of the new ones."""
    return F.slice(after, F.lit(1), F.size(before)) == before


def replaces_routine(before: Column, after: Column) -> Column:
    """A routine with the same signature (arguments and result) is replaced; else dropped and created."""
    return (F.get_json_object(before, "$.arguments").eqNullSafe(F.get_json_object(after, "$.arguments"))) & (F.get_json_object(before, "$.returns").eqNullSafe(F.get_json_object(after, "$.returns")))


# ---- renames ---------------------------------------------------------------


@dataclass(frozen=True)
class Rename:
    """of: table or column. identity: the table's, before; for a column old and new name its columns."""

    of: str
    identity: str
    old: str
    new: str


def rename_candidates(columns: DataFrame) -> DataFrame:
    """identity, dropped, added: tables where columns both went and came, so a rename must be named or the drop confirmed. columns: column_changes()."""
    by = columns.groupBy("identity").agg(F.array_sort(F.collect_list(F.when(F.col("operation") == "drop", F.col("column")))).alias("dropped"), F.array_sort(F.collect_list(F.when(F.col("operation") == "add", F.col("column")))).alias("added"))
    return by.where((F.size("dropped") > 0) & (F.size("added") > 0))


def apply_renames(rows: list[tuple[str, str, str]], renames: list[Rename]) -> list[tuple[str, str, str]]:
    """Rows of a small snapshot at hand as if the renames had been made before; renames.renamed() is the same for DataFrames."""
    from .renames import Names, rewritten

    known = {i: json.loads(n) for k, i, n in rows if k == "table"}
    for r in renames:
        require(r.identity in known, "unknown-rename", f"{r.identity} is no table of the snapshot")
        require(r.of == "table" or r.old in [c["name"] for c in known[r.identity]["columns"]], "unknown-rename", f"{r.identity} has no column {r.old}")
    names = Names.of((r.of, r.identity, r.old, r.new) for r in renames)
    out = []
    for kind, identity, node in rows:
        new, changed = rewritten(kind, identity, json.loads(node), names)
        out.append((kind, new, canonical(changed)))
    return sorted(out)


# ---- applying --------------------------------------------------------------


def apply_table_change(rows: DataFrame, before: dict[str, Any], after: dict[str, Any], renamed: dict[str, str] | None = None) -> DataFrame:
    """A table's rows brought to a new definition: renames, drops, casts, then new columns with their defaults, in physical order."""
    types = {"integer": "int", "smallint": "smallint", "bigint": "bigint", "real": "float", "double precision": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "bytea": "binary"}
    old = {(renamed or {}).get(c["name"], c["name"]): c for c in before["columns"]}
    new = {c["name"]: c for c in after["columns"]}
    for name in old.keys() & new.keys():
        require(old[name]["unique"] == new[name]["unique"], "unique-changed", f"{name}: declare a unique index instead")
    back = {v: k for k, v in (renamed or {}).items()}
    cells = []
    for name in [*(c for c in old if c in new), *(c for c in new if c not in old)]:
        c = new[name]
        kind = types.get(c["type"], f"decimal({','.join(map(str, c['length'] or [38, 18]))})" if c["type"] == "numeric" else "string")
        if name in old:
            cells.append(F.col(back.get(name, name)).cast(kind).alias(name))
        else:
            value = X.compile_(X.decode(c["default"]), X.Scope()) if c["default"] else F.lit(None)
            cells.append(value.cast(kind).alias(name))
    return rows.select(*cells)
