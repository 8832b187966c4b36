"""Row policies, roles and grants. Reads through a session get the policies' filters; writes are checked against them.

A protected table without a policy that applies yields no rows. Permissive policies are joined by
OR, restrictive ones by AND. Privileges are rows of a relation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions import expressions as X
from ..plans.query import View
from ..sources.catalog import Store, Table

PUBLIC = "public"
COMMANDS = ("select", "insert", "update", "delete", "all")


@dataclass(frozen=True)
class Policy:
    name: str
    command: str
    roles: tuple[str, ...]
    using: X.Expr | None = None
    with_check: X.Expr | None = None
    restrictive: bool = False

    def __post_init__(self) -> None:
        require(self.command in COMMANDS, "bad-policy", f"{self.command} is no command")
        require(self.roles, "bad-policy", "a policy is for a role at least")
        require(self.command != "insert" or self.using is None, "bad-policy", "an insert policy only checks")
        require(self.command not in ("select", "delete") or self.with_check is None, "bad-policy", f"a {self.command} policy only filters")
        require(self.using is not None or self.with_check is not None, "bad-policy", "a policy has a condition")

    def applies(self, command: str, role: str) -> bool:
        return self.command in (command, "all") and (role in self.roles or PUBLIC in self.roles)


@dataclass(frozen=True)
class Protected:
    table: Table
    policies: tuple[Policy, ...]
    #: Also holds for the owner.
    force: bool = False

    def __post_init__(self) -> None:
        names = [p.name for p in self.policies]
        require(len(set(names)) == len(names), "duplicate-policy", f"{self.table.name} has a policy twice")
        for p in self.policies:
            for e in (p.using, p.with_check):
                own = [] if e is None else [x for x in _shallow(e) if x.op == "ref"]
                require(all(x.args[:2] == self.table.key for x in own), "foreign-column-ref", "outside subqueries a policy reads its own table")


def _shallow(e: X.Expr) -> list[X.Expr]:
    return [e, *(x for a in e.args if isinstance(a, X.Expr) for x in _shallow(a))]


def combined(policies: list[Policy], side: str) -> X.Expr:
    """One condition of several policies. side: using or check; a missing check falls back to using."""
    def of(p: Policy) -> X.Expr:
        e = (p.with_check or p.using) if side == "check" else p.using
        return e if e is not None else X.literal(True)

    open_ = [of(p) for p in policies if not p.restrictive]
    if not open_:
        return X.literal(False)
    closed = [of(p) for p in policies if p.restrictive]
    return X.and_(X.or_(*open_), *closed)


class Session(Store):
    """A store seen by one role, with local values such as the user's id, evaluated once."""

    def __init__(self, store: Store, role: str, protected: list[Protected], owner: bool = False, **values: object):
        super().__init__(store.spark, store.sources)
        self.store, self.role, self.owner, self.values = store, role, owner, values
        self.protected = {p.table.key: p for p in protected}

    def scope(self, key: tuple[str, str]) -> X.Scope:
        # subqueries of a policy see other tables under this session's policies, too
        return X.Scope(frozenset([key]), locals=tuple(self.values.items()), subquery=lambda q, s: q.frame(self, s))

    def condition(self, key: tuple[str, str], command: str, side: str) -> X.Expr | None:
        p = self.protected.get(key)
        if p is None or self.owner and not p.force:
            return None
        return combined([x for x in p.policies if x.applies(command, self.role)], side)

    def read(self, key: tuple[str, str], command: str = "select") -> DataFrame:
        rows = self.store.read(key)
        condition = self.condition(key, command, "using")
        if condition is None:
            return rows
        return rows.alias(X.alias(*key)).where(X.compile_(condition, self.scope(key))).select(*(F.col(f"{X.alias(*key)}.{c}") for c in rows.columns))

    def refused(self, t: Table, new: DataFrame, command: str = "insert") -> DataFrame:
        """New rows that the policies for this command don't let in."""
        condition = self.condition(t.key, command, "check")
        if condition is None:
            return new.limit(0)
        return new.alias(X.alias(*t.key)).where(~F.coalesce(X.compile_(condition, self.scope(t.key)), F.lit(False)))


def read_view(view: View, session: Session) -> DataFrame:
    """An invoker view is read under the session's policies, another under its owner's rights."""
    return view.query.frame(session if view.security_invoker else session.store)


# ---- grants ----------------------------------------------------------------

GRANTS = "schema string, kind string, object string, role string, privileges array<string>"


def grants_frame(spark: SparkSession, grants: list[dict]) -> DataFrame:
    """One row per schema, kind (usage, tables, default), object and role, from declarations that name several roles."""
    rows = [(g["schema"], g["kind"], g.get("object"), g["roles"], sorted(set(g["privileges"]))) for g in grants]
    return fanned_out(spark.createDataFrame(rows, "schema string, kind string, object string, roles array<string>, privileges array<string>"))


def fanned_out(declared: DataFrame) -> DataFrame:
    """One row per schema, kind, object and role. declared: the same with roles and privileges as arrays."""
    wide = declared.select("schema", "kind", "object", F.explode("roles").alias("role"), "privileges").select("schema", "kind", "object", "role", F.explode("privileges").alias("p"))
    return wide.groupBy("schema", "kind", "object", "role").agg(F.array_sort(F.collect_set("p")).alias("privileges"))


def grant_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """schema, kind, object, role, granted, revoked: what changes between two states."""
    keys = ["schema", "kind", "object", "role"]
    none = F.array().cast("array<string>")
    a, b = before.alias("a"), after.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    both = a.join(b, on, "full_outer")
    old, new = F.coalesce("a.privileges", none), F.coalesce("b.privileges", none)
    out = both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), F.array_sort(F.array_except(new, old)).alias("granted"), F.array_sort(F.array_except(old, new)).alias("revoked"))
    return out.where((F.size("granted") > 0) | (F.size("revoked") > 0))


def standing_grants(tables: DataFrame, grants: DataFrame, new_grants: DataFrame) -> DataFrame:
    """schema, table, role, privileges that new tables get from grants on all tables of their schema, unless these are new themselves. tables: schema, table."""
    standing = grants.where("kind = 'tables'").join(new_grants.where("kind = 'tables'").select("schema", "role"), ["schema", "role"], "left_anti")
    return tables.join(standing.select("schema", "role", "privileges"), "schema").select("schema", "table", "role", "privileges")


def effective(grants: DataFrame, tables: DataFrame) -> DataFrame:
    """schema, table, role, privilege: those a role can use, which takes usage of the schema and a privilege on the table."""
    usage = grants.where("kind = 'usage' and array_contains(privileges, 'usage')").select("schema", "role")
    on_tables = tables.join(grants.where("kind = 'tables'").select("schema", "object", "role", F.explode("privileges").alias("privilege")), "schema")
    return on_tables.where("object is null or object = table").join(usage, ["schema", "role"], "left_semi").select("schema", "table", "role", "privilege").distinct()
