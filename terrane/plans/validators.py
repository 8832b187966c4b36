"""Warnings and errors on declarations, as rows (code, severity, identity)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.catalog import Table
from .query import View

#: Schemas that a platform manages itself.
RESERVED_SCHEMAS = ("auth", "storage", "realtime")


def _said(rows: DataFrame, code: str, severity: str = "warning") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "identity").distinct()


def required_without_default(columns: DataFrame) -> DataFrame:
    """Columns added to tables that exist, not null and without default: rows that are there would break them. columns: snapshot.column_changes()."""
    bad = columns.where((F.col("operation") == "add") & (F.get_json_object("next", "$.nullable") == "false") & F.get_json_object("next", "$.default").isNull())
    return _said(bad.select(F.concat_ws(".", "identity", "column").alias("identity")), "not-null-without-default")


def unreachable_policies(policies: DataFrame, grants: DataFrame) -> DataFrame:
    """Policies for roles without usage of the schema; public counts as reachable if any role has it. policies: schema, table, name, roles."""
    usage = grants.where("kind = 'usage'").select("schema", "role")
    each = policies.select("schema", "table", "name", F.explode("roles").alias("role"))
    anyone = usage.select("schema").distinct()
    bad = each.where("role <> 'public'").join(usage, ["schema", "role"], "left_anti").unionByName(each.where("role = 'public'").join(anyone, "schema", "left_anti").select("schema", "role", "table", "name"))
    return _said(bad.select(F.concat_ws(".", "schema", "table", "name").alias("identity")), "unreachable-policy")


def exposed_tables(tables: DataFrame, grants: DataFrame, protected: DataFrame, open_roles: Iterable[str] = ("anon", "authenticated", "public")) -> DataFrame:
    """Tables that open roles can reach, without row policies. tables, protected: schema, table."""
    open_ = grants.where(F.col("kind").isin("tables", "default") & F.col("role").isin(*open_roles)).select("schema").distinct()
    bad = tables.join(open_, "schema", "left_semi").join(protected, ["schema", "table"], "left_anti")
    return _said(bad.select(F.concat_ws(".", "schema", "table").alias("identity")), "exposed-table")


def reserved_schemas(objects: DataFrame, reserved: Iterable[str] = RESERVED_SCHEMAS) -> DataFrame:
    """Objects declared in schemas that aren't the user's. objects: schema, identity."""
    return _said(objects.where(F.col("schema").isin(*reserved)), "reserved-schema", "error")


def views_past_policies(views: DataFrame, protected: DataFrame) -> DataFrame:
    """Views over protected tables that don't read as their invoker. views: identity, security_invoker, tables (array of schema.table)."""
    each = views.where("not security_invoker").select("identity", F.explode("tables").alias("t"))
    return _said(each.join(protected.select(F.concat_ws(".", "schema", "table").alias("t")), "t", "left_semi"), "view-past-policies")


SESSION_CALLS = frozenset(("user_id", "claims"))


def uncached_session_values(policies: Iterable[tuple[str, X.Expr]]) -> list[tuple[str, str, str]]:
    """Policies that call a session function row by row, instead of reading the session's value (a local), which is evaluated once."""
    return sorted({("uncached-session-call", "warning", name) for name, e in policies if any(x.op == "call" and x.args[0] in ("current_user", *SESSION_CALLS) for x in X.walk(e))})


#: Local values that only a session has.
SESSION_VALUES = frozenset(("uid", "jwt", "user_id", "claims"))


def session_values_outside_policies(tables: Iterable[Table], views: Iterable[View] = (), names: Iterable[str] = SESSION_VALUES) -> list[tuple[str, str, str]]:
    """Defaults, checks, index conditions and views that read a session's value, at any depth: it is there in policies only."""
    known = frozenset(names)

    def reads(e: X.Expr | None) -> bool:
        return e is not None and any(x.op == "local" and x.args[0] in known for x in X.walk(e))

    places = []
    for t in tables:
        own = f"{t.schema}.{t.name}"
        places += [(f"{own}.{n} default", c.default_) for n, c in t.columns]
        places += [(f"{own} check {c.name}", c.condition) for c in t.checks]
        places += [(f"{own} index {', '.join(c for c, _, _ in i.columns)}", i.where) for i in t.indexes]
    places += [(f"{v.schema}.{v.name} view", e) for v in views for e in v.query.expressions()]
    return sorted({("session-value-outside-policy", "error", place) for place, e in places if reads(e)})


@dataclass(frozen=True)
class Bundle:
    """A named set of validators and kinds that a project adds."""

    name: str
    validators: tuple[Callable[..., DataFrame], ...] = ()
    kinds: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def depends(self, base: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
        return {**base, **dict(self.kinds)}


def report(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)
