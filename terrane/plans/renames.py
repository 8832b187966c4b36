"""Renames of tables and columns: found by definition, confirmed or named, and carried to everything that mentions them.

A catalog's rows meet the renames they mention in a join; each row is then rewritten by itself:
its identity, stored conditions, queries, recorded bodies, keys and names derived from it. So a
rename changes a table, its sequences, indexes, keys, policies, row protection, triggers with their functions,
grants, views and other tables' foreign keys together, and leaves nothing for the next difference.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require

RENAMES = "of string, identity string, old string, new string"
Key = tuple[str, str]


@dataclass
class Names:
    """tables: old key to new key; columns: (schema, table, column), all old, to the new column."""

    tables: dict[Key, Key] = field(default_factory=dict)
    columns: dict[tuple[str, str, str], str] = field(default_factory=dict)

    @classmethod
    def of(cls, renames: Iterable[tuple[str, str, str, str]]) -> Names:
        out = cls()
        for of, identity, old, new in renames:
            schema, name = identity.split(".")
            if of == "table":
                out.tables[schema, name] = (schema, new)
            else:
                out.columns[schema, name, old] = new
        return out

    def table(self, schema: str, name: str) -> list[str]:
        return list(self.tables.get((schema, name), (schema, name)))

    def column(self, schema: str, table: str, name: str) -> str:
        return self.columns.get((schema, table, name), name)


# ---- one row


def walk(x: Any, n: Names, locals_: dict[str, str]) -> Any:
    """Stored expressions, queries and statements under new names. locals_: local values that stand for columns."""
    if isinstance(x, list):
        if len(x) == 4 and x[0] in ("insert", "update", "delete") and isinstance(x[1], list) and len(x[1]) == 2:
            schema, table = x[1]
            return [x[0], n.table(schema, table), walk(x[2], n, locals_), [[n.column(schema, table, c), walk(v, n, locals_)] for c, v in x[3]]]
        return [walk(y, n, locals_) for y in x]
    if not isinstance(x, dict):
        return x
    if x.get("op") == "ref":
        schema, table, column = x["args"]
        return {**x, "args": [*n.table(schema, table), n.column(schema, table, column)]}
    if x.get("op") == "local":
        return {**x, "args": [locals_.get(x["args"][0], x["args"][0])]}
    if x.get("op") == "exists":
        # what a subquery's columns are called is nobody's business, so they follow their columns
        query = x["args"][0]["query"]
        names = _projected(query, n)
        x = {**x, "args": [{"query": {**query, "projection": [[names.get(c, c), e] for c, e in query["projection"]]}}]}
    out = {k: walk(v, n, locals_) for k, v in x.items()}
    if "base" in x and "projection" in x:
        out["base"] = n.table(*x["base"])
        out["joins"] = [[n.table(*key), walk(on, n, locals_)] for key, on in x["joins"]]
    return out


def _projected(query: dict[str, Any], n: Names) -> dict[str, str]:
    """Names of a query's columns that are the names of columns which get new ones."""
    return {name: n.column(*e["args"]) for name, e in query["projection"] if isinstance(e, dict) and e.get("op") == "ref" and e["args"][2] == name}


def _body(statements: Any, n: Names, owner: Key | None) -> Any:
    """A recorded body: rows it looks up have their table's column names, and so have the trigger's new and old row."""
    locals_ = {f"{row}.{old}": f"{row}.{new}" for (s, t, old), new in n.columns.items() if owner == (s, t) for row in ("new", "old")}

    def rows(x: Any) -> None:
        if isinstance(x, list):
            if len(x) == 2 and x[0] in ("row", "row_or_null", "for_each") and isinstance(x[1], list) and isinstance(x[1][1], dict):
                query = x[1][1]["query"]
                locals_.update({f"{x[1][0]}.{a}": f"{x[1][0]}.{b}" for a, b in _projected(query, n).items()})
                query["projection"] = [[_projected(query, n).get(c, c), e] for c, e in query["projection"]]
            for y in x:
                rows(y)

    statements = json.loads(json.dumps(statements))
    rows(statements)
    return walk(statements, n, locals_)


Rule = Callable[[str, dict[str, Any], Names], tuple[str, dict[str, Any]]]


def _table(identity: str, node: dict[str, Any], n: Names) -> tuple[str, dict[str, Any]]:
    schema, name = key = tuple(identity.split("."))
    to = n.table(*key)

    def derived(x: dict[str, Any], columns: list[str], end: str, new: list[str]) -> None:
        if x["name"] == "_".join((name, *columns, end)):
            x["name"] = "_".join((to[1], *new, end))

    node = walk(node, n, {})
    for c in node["columns"]:
        c["name"] = n.column(*key, c["name"])
    for i in node["indexes"]:
        old = [c[0] for c in i["columns"]]
        i["columns"] = [[n.column(*key, c[0]), *c[1:]] for c in i["columns"]]
        derived(i, old, "idx", [c[0] for c in i["columns"]])
    for f in node["foreign_keys"]:
        old, target = f["columns"], f["target"]
        f["columns"], f["target_columns"], f["target"] = [n.column(*key, c) for c in old], [n.column(*target, c) for c in f["target_columns"]], n.table(*target)
        derived(f, old, "fk", f["columns"])
    return ".".join(to), node


def _sequence(identity: str, node: dict[str, Any], n: Names) -> tuple[str, dict[str, Any]]:
    schema, name = identity.split(".")
    owner, to = node["table"], n.table(schema, node["table"])[1]
    column = name[len(owner) + 1 : -len("_seq")]
    return f"{schema}.{to}_{n.column(schema, owner, column)}_seq", {**node, "table": to}


def _stored(identity: str, node: dict[str, Any], n: Names) -> tuple[str, dict[str, Any]]:
    """An object with a name of its own that mentions tables."""
    return identity, walk(node, n, {})


def owned(identity: str, node: dict[str, Any], n: Names) -> tuple[str, dict[str, Any]]:
    """An object whose name starts with its table's."""
    schema, name, *rest = identity.split(".", 2)
    return ".".join((*n.table(schema, name), *rest)), walk(node, n, {})


def _trigger(identity: str, node: dict[str, Any], n: Names) -> tuple[str, dict[str, Any]]:
    schema, name, trigger = identity.split(".", 2)
    to = n.table(schema, name)
    function = f"{to[1]}_{trigger}" if node["function"] == f"{name}_{trigger}" else node["function"]
    return ".".join((*to, trigger)), {**node, "table": ".".join(to), "function": function, "update_of": [n.column(schema, name, c) for c in node["update_of"]]}


def _function(identity: str, node: dict[str, Any], n: Names) -> tuple[str, dict[str, Any]]:
    if "source" not in node:
        return identity, node
    owner = tuple(node["table"].split(".")) if node.get("table") else None
    source = _body(node["source"], n, owner)
    out = {**node, "source": source, "body": source_hash(source)}
    if isinstance(node["returns"], dict):
        out["returns"] = {"setof": n.table(*node["returns"]["setof"])}
    if owner:
        to, (schema, name) = n.table(*owner), identity.split(".")
        out["table"] = ".".join(to)
        if name.startswith(f"{owner[1]}_"):
            identity = f"{schema}.{to[1]}{name[len(owner[1]):]}"
    return identity, out


def _grant(identity: str, node: dict[str, Any], n: Names) -> tuple[str, dict[str, Any]]:
    schema, of, thing, role = identity.split(".", 3)
    return ".".join((schema, of, n.table(schema, thing)[1] if of == "tables" else thing, role)), node


#: What a rename does to a row of each kind: the new identity and node. Other kinds stay as they are.
RULES: dict[str, Rule] = {"table": _table, "sequence": _sequence, "view": _stored, "rls": owned, "policy": owned, "trigger": _trigger, "function": _function, "grant": _grant}


def rewritten(kind: str, identity: str, node: dict[str, Any], n: Names, rules: dict[str, Rule] = RULES) -> tuple[str, dict[str, Any]]:
    """A snapshot row's identity and node as if the renames had been made before."""
    return rules[kind](identity, node, n) if kind in rules else (identity, node)


def source_hash(source: Any) -> str:
    return hashlib.sha256(json.dumps(source, sort_keys=True).encode()).hexdigest()[:16]


# ---- all rows


def mentions(rows: DataFrame) -> DataFrame:
    """kind, identity, table (schema.name): tables that a row may mention. More than it does is no harm."""
    parts = F.split("identity", r"\.")
    own = F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    named = F.get_json_object("node", "$.table")
    pairs = F.transform(F.regexp_extract_all("node", F.lit(r'\["([a-z][a-z0-9_]*)","([a-z][a-z0-9_]*)"'), F.lit(0)), lambda x: F.replace(F.replace(F.replace(x, F.lit('["')), F.lit('","'), F.lit(".")), F.lit('"')))
    more = F.when(F.col("kind") == "grant", F.array(F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(2))))).when(F.col("kind") == "sequence", F.array(F.concat_ws(".", F.get(parts, F.lit(0)), named))).when(named.isNotNull(), F.array(named)).otherwise(F.array().cast("array<string>"))
    return rows.select("kind", "identity", F.explode(F.array_distinct(F.concat(F.array(own), more, pairs))).alias("table"))


def _met(a: DataFrame, b: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A join by shuffle alone. Spark guesses a snapshot's size from the file that it is made of, which may be far smaller, and would send it whole through the driver."""
    return a.join(b.hint("merge"), on, how)


def unknown(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """of, identity, old: renames of tables or columns that the snapshot hasn't."""
    columns = F.from_json(F.get_json_object("node", "$.columns"), "array<struct<name string>>").getField("name")
    tables = rows.where("kind = 'table'").select("identity", F.lit(True).alias("_there"), columns.alias("_columns"))
    lacks = (F.col("of") == "column") & ~F.coalesce(F.array_contains("_columns", F.col("old")), F.lit(False))
    return _met(renames, tables, "identity", "left").where(F.col("_there").isNull() | lacks).select(F.when(F.col("_there").isNull(), "table").otherwise("column").alias("of"), "identity", "old")


_ROW = pa.schema([("kind", pa.string()), ("identity", pa.string()), ("node", pa.string())])


def _applied(rules: dict[str, Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from .snapshot import canonical

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # rows without renames pass as they are
            same = b.filter(pc.is_null(b["renames"]))
            yield pa.RecordBatch.from_arrays([same[c].cast(pa.string()) for c in _ROW.names], schema=_ROW)
            out = []
            for r in b.filter(pc.is_valid(b["renames"])).to_pylist():
                names = Names.of((x["of"], x["identity"], x["old"], x["new"]) for x in r["renames"])
                identity, node = rewritten(r["kind"], r["identity"], json.loads(r["node"]), names, rules)
                out.append((r["kind"], identity, canonical(node)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=_ROW)

    return run


def renamed(rows: DataFrame, renames: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """A snapshot as if the renames had been made before. rules: by kind. renames: of (table, column), identity (the table's, before), old, new."""
    lost = unknown(rows, renames).first()
    require(lost is None, "unknown-rename", f"{lost and lost['identity']} " + (f"has no column {lost['old']}" if lost and lost["of"] == "column" else "is no table of the snapshot"))
    each = F.collect_set(F.struct("of", "identity", "old", "new"))
    of_table = renames.groupBy("identity").agg(each.alias("renames")).withColumnRenamed("identity", "table")
    touched = _met(mentions(rows), of_table, "table", "inner").groupBy("kind", "identity").agg(F.flatten(F.collect_list("renames")).alias("renames"))
    met = _met(rows.select("kind", "identity", "node"), touched, ["kind", "identity"], "left")
    return met.mapInArrow(_applied(rules), "kind string, identity string, node string")


# ---- finding renames


#: Names of equal definitions that meet in one cell of a grid, at most about this many a side.
CELL = 1024


def _definition(identity: Column, node: Column) -> Column:
    """A table's node without its own name."""
    name = F.element_at(F.split(identity, r"\."), -1)
    return F.replace(F.replace(node, F.concat(F.lit('"name":"'), name, F.lit("_")), F.lit('"name":"@_')), F.concat(F.lit('"target":["'), F.replace(identity, F.lit("."), F.lit('","')), F.lit('"]')), F.lit('"target":"@"'))


def _lost_and_new(before: DataFrame, after: DataFrame, named: DataFrame) -> DataFrame:
    """of, identity (a schema for tables, else a table, by its old name), side (old, new), name, definition (a digest): of what only one side has. Columns are compared in tables that both have, under one name or under two that were named."""
    from .snapshot import _NODE

    known, none = before.where("kind = 'table'").select("identity"), F.lit(None).cast("string")
    # tables that were named, after, under their old name
    pairs = named.where("of = 'table'").select(F.concat_ws(".", "identity", "old").alias("_old"), F.concat_ws(".", "identity", "new").alias("identity"))
    pairs = _met(_met(pairs, known.withColumnRenamed("identity", "_old"), "_old", "left_semi"), known, "identity", "left_anti").dropDuplicates(["identity"])
    then = _met(after.where("kind = 'table'").select("identity", "node"), pairs, "identity", "left")
    places = F.array(F.struct("identity", F.col("node").alias("now"), none.alias("moved")), F.struct(F.col("_old").alias("identity"), none.alias("now"), F.col("node").alias("moved")))
    then = then.select(F.inline(places)).where("identity is not null")
    sides = before.where("kind = 'table'").select("identity", F.col("node").alias("was"), none.alias("now"), none.alias("moved")).unionByName(then.select("identity", none.alias("was"), "now", "moved"))
    each = sides.groupBy("identity").agg(F.max("was").alias("was"), F.max("now").alias("now"), F.max("moved").alias("moved")).withColumn("back", F.coalesce("now", "moved"))
    differ = F.col("was") != F.col("back")
    parsed = each.select("identity", "was", "now", *(F.coalesce(F.from_json(F.when(differ, F.col(c)), _NODE).getField("columns"), F.from_json(F.lit('{"columns":[]}'), _NODE).getField("columns")).alias(f"_{c}") for c in ("was", "back")))

    def only(side: str, a: str, b: str) -> Column:
        return F.transform(F.filter(a, lambda c: ~F.array_contains(F.col(b).getField("name"), c["name"])), lambda c: F.struct(F.lit(side).alias("side"), c["name"].alias("name"), c.alias("c"), none.alias("node")))

    column = only("old", "_was", "_back")
    own = F.struct(F.when(F.col("now").isNull(), "old").otherwise("new").alias("side"), F.element_at(F.split("identity", r"\."), -1).alias("name"), F.get("_was", F.lit(0)).alias("c"), F.coalesce("was", "now").alias("node"))
    # a moved table's old name has no row of its own after
    table = F.filter(F.array(own), lambda x: F.col("was").isNull() & F.col("now").isNotNull() | F.col("was").isNotNull() & F.col("now").isNull())
    found = parsed.select("identity", F.inline(F.concat(table, column, only("new", "_back", "_was"))))
    of = F.when(F.col("node").isNull(), "column").otherwise("table")
    definition = F.when(F.col("node").isNull(), F.to_json(F.col("c").dropFields("name"))).otherwise(_definition(F.col("identity"), F.col("node")))
    return found.select(of.alias("of"), F.when(F.col("node").isNull(), F.col("identity")).otherwise(F.substring_index("identity", ".", 1)).alias("identity"), "side", "name", F.sha2(definition, 256).alias("definition"))


def _said(gone: DataFrame, named: DataFrame, drops: DataFrame) -> DataFrame:
    """of, identity, old, new, verdict, definition: what is said of a loss. What nobody said anything of has no verdict, its definition, and old or new."""
    at, none = ["of", "identity"], F.lit(None).cast("string")
    claim = F.struct("old", "new")
    ends = F.array(F.struct(F.lit("old").alias("side"), F.col("old").alias("name")), F.struct(F.lit("new").alias("side"), F.col("new").alias("name")))
    claims = named.select(*at, claim.alias("claim"), F.inline(ends)).withColumns({"definition": none, "meant": F.lit(None).cast("boolean")})
    meant = drops.select(*at, F.lit(None).cast("struct<old string, new string>").alias("claim"), F.lit("old").alias("side"), "name", none.alias("definition"), F.lit(True).alias("meant"))
    there = gone.select(*at, F.lit(None).cast("struct<old string, new string>").alias("claim"), "side", "name", "definition", F.lit(None).cast("boolean").alias("meant"))
    each = there.unionByName(claims).unionByName(meant).groupBy(*at, "side", "name").agg(*(F.max(c).alias(c) for c in ("claim", "definition", "meant")))
    # both ends of a claim meet; other rows stay alone
    alone = F.when(F.col("claim").isNull(), F.struct("side", "name"))
    met = each.groupBy(*at, "claim", alone.alias("alone")).agg(F.collect_list(F.struct("side", "name", "definition", "meant")).alias("ends"))
    right = F.col("claim").isNotNull() & (F.size(F.filter("ends", lambda x: x["definition"].isNotNull())) == 2)
    told = F.filter(F.array(F.struct(F.col("claim.old").alias("old"), F.col("claim.new").alias("new"), F.when(right, "named").otherwise("unknown").alias("verdict"), none.alias("definition"))), lambda _: F.col("claim").isNotNull())
    rest = F.transform(F.filter("ends", lambda x: ~right & x["definition"].isNotNull()), lambda x: F.struct(F.when(x["side"] == "old", x["name"]).alias("old"), F.when(x["side"] == "new", x["name"]).alias("new"), F.when(x["meant"], "confirmed").alias("verdict"), x["definition"].alias("definition")))
    return met.select(*at, F.inline(F.concat(told, rest)))


def _matches(open_: DataFrame) -> DataFrame:
    """of, identity, old, new, verdict: lost names with the new ones of equal definition. Pairs are made in cells of a grid, so that many names of one definition are spread over tasks."""
    by = ["of", "identity", "definition"]
    counts = open_.groupBy(*by).agg(F.count("old").alias("olds"), F.count("new").alias("news")).where("olds > 0")
    cells = lambda n: F.greatest(F.ceil(F.col(n) / CELL), F.lit(1))

    def spread(side: str, other: str) -> DataFrame:
        """Each name stands in a line of cells: its own place on its side, all places on the other."""
        rows = _met(open_.where(F.col(side).isNotNull()).select(*by, side), counts, by, "inner")
        own = F.pmod(F.xxhash64(side), cells(f"{side}s")).alias(f"_{side}")
        return rows.select(*by, side, "olds", "news", own, F.explode(F.sequence(F.lit(0).cast("long"), cells(f"{other}s") - 1)).alias(f"_{other}"))

    met = _met(spread("old", "new"), spread("new", "old").drop("olds", "news"), [*by, "_old", "_new"], "left").where("new is not null or news = 0")
    verdict = F.when(F.col("news") == 0, "unconfirmed").when((F.col("olds") == 1) & (F.col("news") == 1), "matched").otherwise("ambiguous")
    return met.select("of", "identity", "old", "new", verdict.alias("verdict"))


def plan(before: DataFrame, after: DataFrame, named: DataFrame, drops: DataFrame) -> DataFrame:
    """of, identity, old, new, verdict: what becomes of each table and column that is gone, and of each rename that was named.

    named: of, identity (a schema for tables, else a table), old, new. drops: of, identity, name: losses that
    are meant. Columns of a table that is renamed stand under its old name. Verdicts: named; twice (two named renames claim
    one old or new name); unknown (a named rename whose old name isn't gone, or whose new name isn't new);
    confirmed (a drop that is meant); matched (its definition has come back once, under one other name);
    ambiguous (one row for each pair of equal definitions, where it is more than one pair); unconfirmed
    (gone, nothing like it has come, and nobody said so).
    """
    at = ["of", "identity"]
    named = named.select(*at, "old", "new").distinct()
    claims = F.count(F.lit(1)).over(Window.partitionBy(*at, "old")) + F.count(F.lit(1)).over(Window.partitionBy(*at, "new"))
    claimed = named.withColumn("_claims", claims)
    twice, named = claimed.where("_claims > 2").drop("_claims"), claimed.where("_claims = 2").drop("_claims")
    said = _said(_lost_and_new(before, after, named), named, drops)
    out = said.where("verdict is not null").drop("definition").unionByName(twice.withColumn("verdict", F.lit("twice")))
    return out.unionByName(_matches(said.where("verdict is null").drop("verdict")))


def settled(planned: DataFrame) -> DataFrame:
    """The renames of a plan, for renamed(); an error if something is ambiguous, unknown, claimed twice or unconfirmed."""
    bad = planned.where("verdict in ('ambiguous', 'twice', 'unknown', 'unconfirmed')").orderBy("of", "identity", "old", "new").first()
    require(bad is None, "open-rename", f"{bad and bad['verdict']}: {bad and bad['of']} {bad and bad['identity']} {bad and bad['old']}")
    ok = planned.where("verdict in ('named', 'matched')")
    identity: Column = F.when(F.col("of") == "table", F.concat_ws(".", "identity", "old")).otherwise(F.col("identity"))
    return ok.select("of", identity.alias("identity"), "old", "new")
