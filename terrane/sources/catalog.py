"""Declared schemas: tables with typed columns, keys, checks, indexes, enums and row policies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import require
from ..functions import expressions as X

NAME = re.compile(r"[a-z][a-z0-9_]*")


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def check_name(name: str) -> str:
    require(NAME.fullmatch(name), "bad-name", f"{name!r} must be lower case letters, digits and _")
    return name


# Each type with its family and Spark type. Unbounded numeric is decimal(38,18); what Spark lacks is text.
TYPES: dict[str, tuple[str, T.DataType]] = {
    "text": ("text", T.StringType()),
    "uuid": ("uuid", T.StringType()),
    "varchar": ("text", T.StringType()),
    "char": ("text", T.StringType()),
    "boolean": ("boolean", T.BooleanType()),
    "smallint": ("numeric", T.ShortType()),
    "integer": ("numeric", T.IntegerType()),
    "bigint": ("numeric", T.LongType()),
    "real": ("numeric", T.FloatType()),
    "double precision": ("numeric", T.DoubleType()),
    "numeric": ("numeric", T.DecimalType(38, 18)),
    "serial": ("numeric", T.IntegerType()),
    "smallserial": ("numeric", T.ShortType()),
    "bigserial": ("numeric", T.LongType()),
    "date": ("datetime", T.DateType()),
    "time": ("datetime", T.StringType()),
    "timetz": ("datetime", T.StringType()),
    "timestamp": ("datetime", T.TimestampNTZType()),
    "timestamptz": ("datetime", T.TimestampType()),
    "interval": ("interval", T.DayTimeIntervalType()),
    "json": ("json", T.VariantType()),
    "jsonb": ("json", T.VariantType()),
    "bytea": ("bytea", T.BinaryType()),
    "inet": ("net", T.StringType()),
    "cidr": ("net", T.StringType()),
    "macaddr": ("net", T.StringType()),
}
SERIAL = {"serial": "integer", "smallserial": "smallint", "bigserial": "bigint"}


@dataclass(frozen=True)
class Column:
    """One column's type and marks; every method returns a changed copy."""

    type: str
    length: tuple[int, ...] = ()
    dimensions: int = 0
    required: bool = False
    primary: bool = False
    is_unique: bool = False
    default_: X.Expr | None = None
    values: tuple[str, ...] = ()

    def not_null(self) -> Column:
        return replace(self, required=True)

    def primary_key(self) -> Column:
        return replace(self, primary=True, required=True)

    def unique(self) -> Column:
        return replace(self, is_unique=True)

    def default(self, value: Any) -> Column:
        return replace(self, default_=X.lift(value))

    def default_random(self) -> Column:
        require(self.type == "uuid", "bad-default", "only uuid has a random default")
        return replace(self, default_=X.random_uuid())

    def default_now(self) -> Column:
        require(self.family == "datetime", "bad-default", "only dates and times default to now")
        return replace(self, default_=X.now())

    def array(self) -> Column:
        return replace(self, dimensions=self.dimensions + 1)

    @property
    def serial(self) -> bool:
        return self.type in SERIAL

    @property
    def nullable(self) -> bool:
        return not (self.required or self.primary or self.serial)

    @property
    def family(self) -> str:
        return "array" if self.dimensions else "text" if self.type == "enum" else TYPES[self.type][0]

    def spark_type(self) -> T.DataType:
        base = T.StringType() if self.type == "enum" else TYPES[self.type][1]
        if self.length:
            base = {"varchar": lambda n: T.VarcharType(n), "char": lambda n: T.CharType(n), "numeric": lambda p, s=0: T.DecimalType(p, s)}[self.type](*self.length)
        for _ in range(self.dimensions):
            base = T.ArrayType(base)
        return base


def column(type_: str, *length: int) -> Column:
    require(type_ in TYPES, "unknown-type", type_)
    return Column(type_, length)


@dataclass(frozen=True)
class Enum:
    schema: str
    name: str
    values: tuple[str, ...]

    def column(self) -> Column:
        return Column("enum", values=self.values)

    def ordinal(self, value: Any):  # noqa: ANN201 - a Spark column
        """Sort key: enums sort in declaration order, not as text."""
        from pyspark.sql import functions as F

        return F.array_position(F.array(*map(F.lit, self.values)), value)


@dataclass(frozen=True)
class Index:
    columns: tuple[tuple[str, str, str | None], ...]  # name, asc or desc, first or last
    unique: bool = False
    where: X.Expr | None = None
    name: str | None = None


ACTIONS = frozenset(("cascade", "restrict", "set null", "set default", "no action"))


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    target: tuple[str, str]
    target_columns: tuple[str, ...]
    on_delete: str = "no action"
    on_update: str = "no action"
    name: str | None = None


@dataclass(frozen=True)
class Check:
    name: str
    condition: X.Expr


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    columns: tuple[tuple[str, Column], ...]
    indexes: tuple[Index, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Check, ...] = ()
    #: Only referred to: never created, changed or compared.
    existing: bool = False
    key: tuple[str, str] = field(init=False, default=("", ""))

    def __post_init__(self) -> None:
        object.__setattr__(self, "key", (self.schema, self.name))
        names = [c for c, _ in self.columns]
        for n in (self.schema, self.name, *names):
            check_name(n)
        require(len(set(names)) == len(names), "duplicate-column", f"{self.name} has a column twice")
        for fk in self.foreign_keys:
            require(fk.columns and len(fk.columns) == len(fk.target_columns), "bad-foreign-key", "as many columns on both sides, one at least")
            require(set(fk.columns) <= set(names), "bad-foreign-key", f"{fk.columns} aren't all columns of {self.name}")
            require({fk.on_delete, fk.on_update} <= ACTIONS, "bad-foreign-key", "unknown action")
        require(len({f.columns for f in self.foreign_keys}) == len(self.foreign_keys), "bad-foreign-key", "two foreign keys on the same columns")
        for e in [c.condition for c in self.checks] + [i.where for i in self.indexes if i.where]:
            require(X.tables_of(e) <= {self.key}, "foreign-column-ref", "a check or index condition reads its own table only")
            require(all(x.op != "exists" for x in X.walk(e)), "subquery-in-check", "a check or index condition has no subquery")

    def __getitem__(self, name: str) -> X.Expr:
        found = dict(self.columns).get(name)
        require(found is not None, "unknown-column", f"{self.name} has no column {name}")
        return X.ref(self.schema, self.name, name, found.family)

    def names(self) -> list[str]:
        return [c for c, _ in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.spark_type(), c.nullable) for n, c in self.columns])

    def primary_key(self) -> list[str]:
        return [n for n, c in self.columns if c.primary]

    def derived_names(self) -> dict[str, list[str]]:
        """Names that indexes, keys and sequences have unless they are given one."""
        out = {"idx": [i.name or "_".join((self.name, *(c for c, _, _ in i.columns), "idx")) for i in self.indexes]}
        out["fk"] = [f.name or "_".join((self.name, *f.columns, "fk")) for f in self.foreign_keys]
        out["seq"] = [f"{self.name}_{n}_seq" for n, c in self.columns if c.serial]
        out["pkey"] = [f"{self.name}_pkey"] if self.primary_key() else []
        out["key"] = [f"{self.name}_{n}_key" for n, c in self.columns if c.is_unique]
        return out


def table(schema: str, name: str, columns: dict[str, Column], **extras: Any) -> Table:
    return Table(schema, name, tuple((snake(k), c) for k, c in columns.items()), **extras)


@dataclass(frozen=True)
class Schema:
    """A namespace that tables, enums and views are declared in."""

    name: str

    def __post_init__(self) -> None:
        check_name(self.name)

    def table(self, name: str, columns: dict[str, Column], **extras: Any) -> Table:
        return table(self.name, name, columns, **extras)

    def enum(self, name: str, *values: str) -> Enum:
        require(values and len(set(values)) == len(values), "bad-enum", f"{name} has values, each once")
        return Enum(self.name, check_name(name), values)

    def view(self, name: str, query: Any, security_invoker: bool = False) -> Any:
        from ..plans.query import View

        return View(self.name, check_name(name), query, security_invoker)


def schema(name: str) -> Schema:
    return Schema(name)


def check_references(tables: Iterable[Table]) -> None:
    """Foreign keys of declared tables refer to tables among them, to columns that these have, of the same type, and that are unique together. Names of indexes and keys stand once in a table."""
    by_key = {t.key: t for t in tables}
    for t in by_key.values():
        for kind, names in t.derived_names().items():
            twice = sorted({n for n in names if names.count(n) > 1})
            require(not twice, "duplicate-name", f"{t.name} has two of {kind} named {twice}")
        for i in t.indexes:
            require({c for c, _, _ in i.columns} <= set(t.names()), "unknown-index-column", f"an index of {t.name} has other columns than the table")
        for f in t.foreign_keys:
            target = by_key.get(f.target)
            require(target is not None, "unknown-target", f"{t.name} refers to {'.'.join(f.target)}, which isn't declared")
            theirs = dict(target.columns)
            require(set(f.target_columns) <= set(theirs), "unknown-target-column", f"{t.name} refers to {f.target_columns} of {target.name}, which has no such columns")
            for mine, other in zip(f.columns, f.target_columns, strict=True):
                a, b = dict(t.columns)[mine], theirs[other]
                same = (SERIAL.get(a.type, a.type), a.dimensions) == (SERIAL.get(b.type, b.type), b.dimensions)
                require(same, "target-type", f"{t.name}.{mine} is {a.type}, and {target.name}.{other} {b.type}")
            keys = [set(target.primary_key()), *({n} for n, c in target.columns if c.is_unique), *({c for c, _, _ in i.columns} for i in target.indexes if i.unique and i.where is None)]
            require(target.existing or set(f.target_columns) in keys, "target-not-unique", f"{f.target_columns} of {target.name} are no key of it")


def from_parquet(schema: str, name: str, struct: T.StructType) -> Table:
    """A reference-only table over files that exist, with the columns they have."""
    by_type = {t: n for n, (_, t) in reversed(TYPES.items())}
    return Table(schema, name, tuple((f.name, Column(by_type.get(f.dataType, "text"))) for f in struct), existing=True)


class Store:
    """Where tables' rows come from: a supplier of a DataFrame per table. Reads go through here, so that policies can be put in between."""

    def __init__(self, spark: SparkSession, sources: dict[tuple[str, str], Callable[[], DataFrame]] | None = None):
        self.spark, self.sources = spark, dict(sources or {})
        #: Declarations of the tables that were bound.
        self.tables: dict[tuple[str, str], Table] = {}

    def bind(self, table_: Table, source: Callable[[], DataFrame] | DataFrame | str) -> Store:
        """source: a DataFrame, a function that returns one, or the path of a Parquet table, read with the declared types."""
        if isinstance(source, str):
            path = source
            source = lambda: self.spark.read.parquet(path)
        self.tables[table_.key] = table_
        self.sources[table_.key] = source if callable(source) and not isinstance(source, DataFrame) else lambda: source
        return self

    def read(self, key: tuple[str, str]) -> DataFrame:
        require(key in self.sources, "unbound-table", f"{key[0]}.{key[1]} has no source")
        return self.sources[key]()
