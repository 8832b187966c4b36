"""All kinds of declarations as snapshot rows, what each kind's node must have, and what a change of each kind means.

Rows are (kind, identity, node), as in `snapshot`. Everything that compares is a DataFrame job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import expressions as X
from ..operators.routines import Routine, RowTrigger, body_hash, plain
from ..operators.security import Protected
from ..sources.catalog import Enum, Table, check_references
from . import renames as R
from . import snapshot as S
from .query import View

#: Keys that a node of each kind has.
REQUIRED: dict[str, tuple[str, ...]] = {
    "schema": (),
    "enum": ("values",),
    "sequence": ("table",),
    "table": ("checks", "columns", "foreign_keys", "indexes"),
    "view": ("columns", "query", "security_invoker"),
    "function": ("arguments", "body", "definer", "returns"),
    "trigger": ("events", "function", "table", "timing", "update_of"),
    "rls": ("force",),
    "policy": ("check", "command", "restrictive", "roles", "using"),
    "grant": ("privileges",),
}


def _encoded(e: X.Expr | None) -> Any:
    return None if e is None else X.encode(e)


def expand(
    tables: Iterable[Table] = (),
    enums: Iterable[Enum] = (),
    views: Iterable[View] = (),
    routines: Iterable[tuple[str, Routine]] = (),
    triggers: Iterable[RowTrigger] = (),
    protected: Iterable[Protected] = (),
    grants: Iterable[dict] = (),
    more: Iterable[tuple[str, str, Any]] = (),
) -> list[tuple[str, str, str]]:
    """Rows of a snapshot. One declaration may give several: a table its sequences, a trigger its function, a protected table its policies, a grant one row for each role.

    routines: (schema, routine). grants: as for security.grants_frame(). more: rows of kinds that a project adds.
    """
    tables = list(tables)
    check_references(tables)
    rows: list[tuple[str, str, Any]] = []
    for e in enums:
        rows.append(("enum", f"{e.schema}.{e.name}", {"values": list(e.values)}))
    for v in views:
        rows.append(("view", f"{v.schema}.{v.name}", {"columns": v.query.columns(), "query": v.query.encoded(), "security_invoker": v.security_invoker}))
    for schema, r in routines:
        rows.append(("function", f"{schema}.{r.name}", {"arguments": [list(a) for a in r.arguments], "returns": r.signature(), "definer": r.definer, "body": body_hash(r.statements), "source": plain(r.statements)}))
    for t in triggers:
        owner = f"{t.table.schema}.{t.table.name}"
        rows.append(("function", f"{t.table.schema}.{t.table.name}_{t.name}", {"arguments": [], "returns": "trigger", "definer": False, "body": body_hash(t.statements), "source": plain(t.statements), "table": owner}))
        rows.append(("trigger", f"{owner}.{t.name}", {"table": owner, "function": f"{t.table.name}_{t.name}", "timing": t.timing, "events": sorted(t.events), "update_of": list(t.update_of)}))
    for p in protected:
        owner = f"{p.table.schema}.{p.table.name}"
        rows.append(("rls", owner, {"force": p.force}))
        rows += [("policy", f"{owner}.{x.name}", {"command": x.command, "restrictive": x.restrictive, "roles": sorted(x.roles), "using": _encoded(x.using), "check": _encoded(x.with_check)}) for x in p.policies]
    for g in grants:
        rows += [("grant", f"{g['schema']}.{g['kind']}.{g.get('object') or '*'}.{role}", {"privileges": sorted(set(g["privileges"]))}) for role in g["roles"]]
    own = [(k, i, S.canonical(n)) for k, i, n in (*rows, *more)] + S.expand(tables)
    seen = {(k, i) for k, i, _ in own}
    require(len(seen) == len(own), "duplicate-object", "an object is declared twice")
    schemas = {i.split(".")[0] for k, i, _ in own if k in REQUIRED and k != "schema"} - {i for k, i, _ in own if k == "schema"}
    return sorted([*own, *(("schema", s, S.canonical({})) for s in schemas)])


def missing_keys(rows: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED) -> DataFrame:
    """kind, identity, missing (sorted): nodes that lack keys of their kind; of an unknown kind, or not an object, all that there is is the kind itself."""
    need = F.create_map(*(x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    has = F.coalesce(F.json_object_keys("node"), F.array().cast("array<string>"))
    missing = F.coalesce(F.array_sort(F.array_except(F.element_at(need, F.col("kind")), has)), F.array(F.lit("kind")))
    missing = F.when(F.json_object_keys("node").isNull(), F.array(F.lit("node"))).otherwise(missing)
    return rows.select("kind", "identity", missing.alias("missing")).where(F.size("missing") > 0)


# ---- what a change means ---------------------------------------------------

MEMBERS = {"index": "indexes", "foreign key": "foreign_keys", "check": "checks"}


def _members(rows: DataFrame) -> DataFrame:
    """identity, member, name, definition: indexes, foreign keys and checks of tables, and the primary key as a set of columns."""
    tables = rows.where("kind = 'table'")

    def of(member: str, path: str) -> Column:
        return F.transform(F.from_json(F.get_json_object("node", f"$.{path}"), "array<string>"), lambda x: F.struct(F.lit(member).alias("member"), F.get_json_object(x, "$.name").alias("name"), x.alias("definition")))

    each = [of(m, path) for m, path in MEMBERS.items()]
    columns = F.from_json(F.get_json_object("node", "$.columns"), "array<struct<name string, primary boolean>>")
    key = F.array_sort(F.transform(F.filter(columns, lambda c: c["primary"]), lambda c: c["name"]))
    keys = F.when(F.size(key) > 0, F.array(F.struct(F.lit("key").alias("member"), F.lit("key").alias("name"), F.to_json(key).alias("definition")))).otherwise(F.array().cast("array<struct<member string, name string, definition string>>"))
    return tables.select("identity", F.inline(F.concat(*each, keys)))


def member_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """identity, member, name, operation (add, alter, drop), previous, next: of tables in both snapshots."""
    a, b = (x.where("kind = 'table'") for x in (before, after))
    both = a.select("identity").join(b.select("identity"), "identity")
    old = _members(a).join(both, "identity", "left_semi").withColumnRenamed("definition", "previous")
    new = _members(b).join(both, "identity", "left_semi").withColumnRenamed("definition", "next")
    out = old.join(new, ["identity", "member", "name"], "full_outer").where(~F.col("previous").eqNullSafe(F.col("next")))
    return out.select("identity", "member", "name", F.when(F.col("previous").isNull(), "add").when(F.col("next").isNull(), "drop").otherwise("alter").alias("operation"), "previous", "next")


def alter_steps(before: DataFrame, after: DataFrame) -> DataFrame:
    """identity, stage, action, member, name: how tables get from one definition to the other.

    Foreign keys go first (stage 0) and come last (2, when every table is there), as what they stand on
    may change between; an altered index, key, check or foreign key is dropped and added, its drop
    before columns change, its addition after.
    """
    members = member_changes(before, after).select("identity", "member", "name", "operation")
    parts = F.when(F.col("operation") == "alter", F.array(F.lit("drop"), F.lit("add"))).otherwise(F.array("operation"))
    each = members.select("identity", "member", "name", F.explode(parts).alias("action"))
    foreign = F.col("member") == "foreign key"
    stage = F.when(foreign, F.when(F.col("action") == "drop", 0).otherwise(2)).otherwise(1)
    columns = S.column_changes(before, after).select("identity", F.lit(1).alias("stage"), F.col("operation").alias("action"), F.lit("column").alias("member"), F.col("column").alias("name"))
    return each.select("identity", stage.alias("stage"), "action", "member", "name").unionByName(columns)


def steps(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, identity, stage, action, member, name: everything to be done, so that what a step needs is there by its stage.

    Stage 0: views, functions, triggers and policies that go, and foreign keys, of tables that go as well. 1: creations and alterations, in
    order of their kinds' ranks. 2: what waits until every table is there: foreign keys of new tables and altered ones, and the tables that own
    new sequences. 3: other drops. So tables that refer to each other are created, and dropped, in any order.
    """
    changes = S.diff(before, after)
    text = F.lit(None).cast("string")
    drop, dependent = F.col("operation") == "drop", F.col("kind").isin("view", "function", "trigger", "policy")
    whole = changes.where("not (kind = 'table' and operation = 'alter')").select("kind", "identity", F.when(drop & dependent, 0).when(drop, 3).otherwise(1).alias("stage"), F.col("operation").alias("action"), text.alias("member"), text.alias("name"))

    def keys(side: str, operation: str, stage: int, action: str) -> DataFrame:
        found = F.from_json(F.get_json_object(side, "$.foreign_keys"), "array<struct<name string>>")
        rows = changes.where((F.col("kind") == "table") & (F.col("operation") == operation))
        return rows.select("kind", "identity", F.lit(stage).alias("stage"), F.lit(action).alias("action"), F.lit("foreign key").alias("member"), F.explode(found.getField("name")).alias("name"))

    owned = changes.where("kind = 'sequence' and operation = 'create'").select("kind", "identity", F.lit(2).alias("stage"), F.lit("own").alias("action"), F.lit("table").alias("member"), F.get_json_object("next", "$.table").alias("name"))
    altered = alter_steps(before, after).select(F.lit("table").alias("kind"), "identity", "stage", "action", "member", "name")
    return whole.unionByName(keys("next", "create", 2, "add")).unionByName(keys("previous", "drop", 0, "drop")).unionByName(owned).unionByName(altered)


def _names(node: str, path: str) -> Column:
    return F.from_json(F.get_json_object(node, f"$.{path}"), "array<string>")


def _if(condition: Column, then: str) -> Column:
    return F.when(condition, then).otherwise("recreate")


@dataclass(frozen=True)
class Kind:
    """What the library has to know of a kind of objects: the built-in ones and those of a project alike."""

    name: str
    #: Kinds that have to be there first.
    depends: tuple[str, ...] = ()
    #: Keys that a node has.
    required: tuple[str, ...] = ()
    #: What an alteration means, from the columns previous and next: alter, replace or recreate.
    means: Callable[[], Column] = lambda: F.lit("alter")
    #: A new identity and node under renames of tables and columns; None: it mentions none.
    rename: R.Rule | None = None
    #: Dropped before anything else.
    dependent: bool = False


#: What alterations mean, of kinds for which it isn't "alter": triggers and policies are made anew, an enum or view stays if its old values or
#: columns come first in the new, a routine if its arguments and result are the same.
_MEANS: dict[str, Callable[[], Column]] = {
    "trigger": lambda: F.lit("recreate"),
    "policy": lambda: F.lit("recreate"),
    "enum": lambda: _if(S.appends_enum(_names("previous", "values"), _names("next", "values")), "alter"),
    "view": lambda: _if(S.replaces_view(_names("previous", "columns"), _names("next", "columns")), "replace"),
    "function": lambda: _if(S.replaces_routine(F.col("previous"), F.col("next")), "replace"),
}
KINDS: dict[str, Kind] = {k: Kind(k, on, REQUIRED[k], _MEANS.get(k, lambda: F.lit("alter")), R.RULES.get(k), k in S.DEPENDENT) for k, on in S.DEPENDS.items()}


def registry(*added: Kind) -> dict[str, Kind]:
    """The built-in kinds and those of a project; what they depend on must be there, without a circle."""
    out = {**KINDS}
    for k in added:
        require(k.name not in out, "duplicate-kind", f"{k.name} is a kind already")
        out[k.name] = k
    S.ranks({k.name: k.depends for k in out.values()})
    return out


def meaning(changes: DataFrame, kinds: dict[str, Kind] = KINDS) -> DataFrame:
    """changes (kind, identity, operation, previous, next) with means: create, drop, alter in place, replace, or recreate, as each kind says."""
    means = F.when(F.col("operation") != "alter", F.col("operation"))
    for k in kinds.values():
        means = means.when(F.col("kind") == k.name, k.means())
    return changes.withColumn("means", means)


def ordered(changes: DataFrame, kinds: dict[str, Kind] = KINDS) -> DataFrame:
    """snapshot.ordered() over these kinds."""
    return S.ordered(changes, {k.name: k.depends for k in kinds.values()}, tuple(k.name for k in kinds.values() if k.dependent))


def renamed(rows: DataFrame, given: DataFrame, kinds: dict[str, Kind] = KINDS) -> DataFrame:
    """renames.renamed() over these kinds."""
    return R.renamed(rows, given, {k.name: k.rename for k in kinds.values() if k.rename})


def required(kinds: dict[str, Kind] = KINDS) -> dict[str, tuple[str, ...]]:
    """Keys of each kind, for missing_keys() and snapshot.load()."""
    return {k.name: k.required for k in kinds.values()}


def privilege_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """identity, granted, revoked: of grants in either snapshot."""
    rows = S.diff(before.where("kind = 'grant'"), after.where("kind = 'grant'"))
    none = F.array().cast("array<string>")
    old, new = (F.coalesce(_names(side, "privileges"), none) for side in ("previous", "next"))
    return rows.select("identity", F.array_sort(F.array_except(new, old)).alias("granted"), F.array_sort(F.array_except(old, new)).alias("revoked"))
