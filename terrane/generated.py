"""Queries over catalogs, grants and chains of files made from the driver's parts: k is a part's number, x its size.

Spark makes the operator's input from these rows, and the SQL works out the answer from the same rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import changes, security
from .plans import kinds, lineage, renames, snapshot, validators
from .queries import _BUCKET, _CATALOG, _KEY, NAMES, World, _depth_trigger, _filled, _flat, _generated, _nation, query
from .sources.catalog import Store, table

P = "SELECT p_partkey AS k, p_size AS x FROM part"


def parts(w: World, where: str = "true") -> DataFrame:
    return w.rows("part").selectExpr("p_partkey as k", "p_size as x").where(where)


# ---- rows that are put in


def _buckets(w: World) -> DataFrame:
    """Buckets that are declared are put into the table twice, with the same result."""
    there = parts(w, "k % 3 > 0").selectExpr("'b' || k as id", "'old' || k as name", "x % 2 = 0 as public", "k as file_size_limit")
    declared = parts(w, "k % 2 = 0").selectExpr("'b' || k as id", "'new' || k as name", "x % 3 = 0 as public", "nullif(x, 5)::bigint as file_size_limit")
    sets = {c: X.local(f"new_{c}") for c in ("name", "public", "file_size_limit")}
    once = changes.insert_or_update(_BUCKET, declared, ["id"], sets, ["id"], Store(w.spark).bind(_BUCKET, there)).state
    return changes.insert_or_update(_BUCKET, declared, ["id"], sets, ["id"], Store(w.spark).bind(_BUCKET, once)).state


query(
    "bucket_upsert",
    f"""SELECT 'b' || k AS id, CASE WHEN k % 2 = 0 THEN 'new' ELSE 'old' END || k AS name, CASE WHEN k % 2 = 0 THEN x % 3 = 0 ELSE x % 2 = 0 END AS public, CASE WHEN k % 2 = 0 THEN nullif(x, 5)::BIGINT ELSE k END AS file_size_limit FROM ({P}) WHERE k % 3 > 0 OR k % 2 = 0""",
)(_buckets)


def _inserted(w: World) -> DataFrame:
    """What comes back when suppliers go into the nations' table, under new keys and without names."""
    new = w.rows("supplier").selectExpr("(s_suppkey + 1000)::int as n_nationkey", "s_nationkey as n_regionkey").withColumn("n_name", changes.default_of(_nation(w), "n_name"))
    return changes.insert_rows(_nation(w), new, w.store).returned


query("insert_returning", "SELECT (s_suppkey + 1000)::INTEGER AS n_nationkey, 'unnamed' AS n_name, s_nationkey AS n_regionkey FROM supplier")(_inserted)

# ---- grants

_PRIVILEGES = "CASE k % 3 WHEN 0 THEN {a}'select', 'insert'{b} WHEN 1 THEN {a}'update', 'select'{b} ELSE {a}'delete'{b} END"


def _declared(w: World, where: str = "true") -> DataFrame:
    """Declarations that grant to two roles each, on a schema, on its tables or on one of them."""
    kind = "CASE WHEN x % 3 = 0 THEN 'usage' ELSE 'tables' END"
    privileges = _PRIVILEGES.format(a="array(", b=")")
    return parts(w, where).selectExpr("'app' || x as schema", f"{kind} as kind", "CASE WHEN x % 3 = 1 THEN 't' || k % 4 END as object", "array('r' || k % 7, 'r' || k % 5) as roles", f"CASE WHEN x % 3 = 0 THEN array('usage') ELSE {privileges} END as privileges")


_GRANTS = (
    "SELECT 'app' || x AS schema, CASE WHEN x % 3 = 0 THEN 'usage' ELSE 'tables' END AS kind, CASE WHEN x % 3 = 1 THEN 't' || k % 4 END AS object, unnest(['r' || k % 7, 'r' || k % 5]) AS role, CASE WHEN x % 3 = 0 THEN ['usage'] ELSE "
    + _PRIVILEGES.format(a="[", b="]")
    + f" END AS privileges FROM ({P}) WHERE {{}}"
)


def _granted(where: str = "true") -> str:
    return f"SELECT schema, kind, object, role, list_sort(list(DISTINCT p)) AS privileges FROM (SELECT schema, kind, object, role, unnest(privileges) AS p FROM ({_GRANTS.format(where)})) GROUP BY 1, 2, 3, 4"


query("grant_fanout", f"SELECT schema, kind, object, role, array_to_string(privileges, ',') AS privileges FROM ({_granted()})")(lambda w: _flat(security.fanned_out(_declared(w)), "privileges"))
query(
    "grant_delta",
    f"""WITH a AS ({_granted("k % 3 > 0")}), b AS ({_granted("k % 4 > 0")}),
j AS (SELECT coalesce(a.schema, b.schema) AS schema, coalesce(a.kind, b.kind) AS kind, coalesce(a.object, b.object) AS object, coalesce(a.role, b.role) AS role, coalesce(a.privileges, []) AS o, coalesce(b.privileges, []) AS n
  FROM a FULL JOIN b ON a.schema = b.schema AND a.kind = b.kind AND a.role = b.role AND a.object IS NOT DISTINCT FROM b.object)
SELECT schema, kind, object, role, array_to_string(list_sort(list_filter(n, lambda p: NOT list_contains(o, p))), ',') AS granted, array_to_string(list_sort(list_filter(o, lambda p: NOT list_contains(n, p))), ',') AS revoked FROM j WHERE o <> n""",
)(lambda w: _flat(security.grant_delta(security.fanned_out(_declared(w, "k % 3 > 0")), security.fanned_out(_declared(w, "k % 4 > 0"))), "granted", "revoked"))


def _tables(w: World) -> DataFrame:
    return parts(w).selectExpr("'app' || x as schema", "'t' || k % 4 as table").distinct()


query(
    "grant_standing",
    f"""WITH old AS ({_granted("k % 2 = 0")}), new AS ({_granted("k % 10 = 1")})
SELECT t.schema, t.t AS "table", role, array_to_string(privileges, ',') AS privileges FROM (SELECT DISTINCT 'app' || x AS schema, 't' || k % 4 AS t FROM ({P})) t
JOIN old ON old.schema = t.schema AND old.kind = 'tables' WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.kind = 'tables' AND new.schema = old.schema AND new.role = old.role)""",
)(lambda w: _flat(security.standing_grants(_tables(w), security.fanned_out(_declared(w, "k % 2 = 0")), security.fanned_out(_declared(w, "k % 10 = 1"))), "privileges"))


def _with_usage(w: World) -> DataFrame:
    """The grants, and for parts that 4 divides usage of the schema for one role."""
    usage = parts(w, "k % 4 = 0").selectExpr("'app' || x as schema", "'usage' as kind", "cast(null as string) as object", "'r' || k % 7 as role", "array('usage') as privileges")
    return security.fanned_out(_declared(w)).unionByName(usage)


query(
    "grant_effective",
    f"""WITH g AS ({_granted()}), u AS (SELECT DISTINCT 'app' || x AS schema, 'r' || k % 7 AS role FROM ({P}) WHERE k % 4 = 0 UNION SELECT schema, role FROM g WHERE kind = 'usage')
SELECT DISTINCT t.schema, t.t AS "table", g.role, g.p AS privilege FROM (SELECT DISTINCT 'app' || x AS schema, 't' || k % 4 AS t FROM ({P})) t
JOIN (SELECT schema, object, role, unnest(privileges) AS p FROM g WHERE kind = 'tables') g ON g.schema = t.schema AND (object IS NULL OR object = t.t) JOIN u ON u.schema = g.schema AND u.role = g.role""",
)(lambda w: security.effective(_with_usage(w), _tables(w)))


def _fired(w: World) -> DataFrame:
    """Orders that the trigger refuses when this column is set."""
    t = _depth_trigger(w)
    rows = [t.refused(w.rows("orders"), w.store).select(F.lit(c).alias("column"), "o_orderkey") if t.fires("update", (c,)) else w.rows("orders").where("false").select(F.lit(c).alias("column"), "o_orderkey") for c in ("o_totalprice", "o_orderstatus")]
    return rows[0].unionByName(rows[1])


query("trigger_update_of", "SELECT 'o_totalprice' AS \"column\", o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000 AND c_acctbal < 0")(_fired)

# ---- catalogs


def _own_tables(w: World) -> DataFrame:
    """The driver's tables, declared and built."""
    declared = [table("w", n, dict(getattr(w, n).columns)) for n in NAMES]
    rows = snapshot.snapshot(w.spark, kinds.expand(declared))
    return rows.where("kind = 'table'").select("identity", F.explode(F.from_json("node", snapshot._NODE).columns).alias("c")).select("identity", F.col("c.name").alias("column"))


query("snapshot_build", "SELECT DISTINCT 'w.' || table_name AS identity, column_name AS \"column\" FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{n}'" for n in NAMES) + ")")(_own_tables)

_DIFF = f"""SELECT kind, identity, CASE WHEN k % 5 = 0 THEN 'create' WHEN k % 7 = 0 THEN 'drop' ELSE 'alter' END AS operation FROM ({_CATALOG})
WHERE k % 5 = 0 AND k % 7 <> 0 OR k % 7 = 0 AND k % 5 <> 0 OR k % 5 <> 0 AND k % 7 <> 0 AND k % 3 = 0"""


@lru_cache(maxsize=1)
def _ranks() -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in snapshot.ranks().items()) + " END"


query("catalog_diff", _DIFF)(lambda w: snapshot.diff(_generated(w, False), _generated(w, True)).select("kind", "identity", "operation"))
query("change_order", f"SELECT kind, identity, CASE WHEN operation <> 'drop' THEN 1 WHEN kind IN ('view', 'policy') THEN 0 ELSE 2 END AS stage, {_ranks()} AS rank FROM ({_DIFF})")(
    lambda w: snapshot.ordered(snapshot.diff(_generated(w, False), _generated(w, True))).select("kind", "identity", "stage", "rank")
)


def _paired(w: World, where: str) -> DataFrame:
    """Tables in pairs that refer to each other, each with a sequence."""
    partner = "CASE WHEN k % 2 = 0 THEN k + 1 ELSE k - 1 END"
    node = '{"checks":[],"columns":[' + _KEY + '],"foreign_keys":[{"columns":["id"],"name":"pair","on_delete":"cascade","on_update":"no action","target":["app","t%t"],"target_columns":["id"]}],"indexes":[]}'
    rows = parts(w, where)
    made = F.array(F.struct(F.lit("table").alias("kind"), F.expr("'app.t' || k").alias("identity"), _filled(node, False, partner, "''", "k").alias("node")), F.struct(F.lit("sequence").alias("kind"), F.expr("'app.t' || k || '_id_seq'").alias("identity"), F.expr("""'{"table":"t' || k || '"}'""").alias("node")))
    return rows.select(F.inline(made))


query(
    "stage_order",
    f"""WITH o AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'create' ELSE 'drop' END AS a FROM ({P}) WHERE k % 3 = 0 AND k % 4 > 0 OR k % 4 = 0 AND k % 3 > 0)
SELECT 'sequence' AS kind, 'app.t' || k || '_id_seq' AS identity, CASE a WHEN 'create' THEN 1 ELSE 3 END AS stage, a AS action, NULL AS member, NULL AS name FROM o
UNION ALL SELECT 'table', 'app.t' || k, CASE a WHEN 'create' THEN 1 ELSE 3 END, a, NULL, NULL FROM o
UNION ALL SELECT 'table', 'app.t' || k, CASE a WHEN 'create' THEN 2 ELSE 0 END, CASE a WHEN 'create' THEN 'add' ELSE 'drop' END, 'foreign key', 'pair' FROM o
UNION ALL SELECT 'sequence', 'app.t' || k || '_id_seq', 2, 'own', 'table', 't' || k FROM o WHERE a = 'create'""",
)(lambda w: kinds.steps(_paired(w, "k % 3 > 0"), _paired(w, "k % 4 > 0")).select("kind", "identity", "stage", "action", "member", "name"))


def _wide(w: World, after: bool) -> DataFrame:
    """One table a part: a column is kept, one goes where 4 divides the number, one comes where 3 does, required for odd sizes, with a default where 5 divides the number."""
    more = """'{"default":' || CASE WHEN k % 5 = 0 THEN '1' ELSE 'null' END || ',"dimensions":0,"length":[],"name":"n","nullable":' || CASE WHEN x % 2 = 1 THEN 'false' ELSE 'true' END || ',"primary":false,"type":"text","unique":false}'"""
    old = _KEY.replace('"id"', '"o"')
    cells = [F.lit(_KEY), F.when(F.expr("k % 4 > 0") | F.lit(not after), F.lit(old)), F.when(F.expr("k % 3 = 0") & F.lit(after), F.expr(more))]
    node = F.concat(F.lit('{"checks":[],"columns":['), F.concat_ws(",", *cells), F.lit('],"foreign_keys":[],"indexes":[]}'))
    return parts(w).select(F.lit("table").alias("kind"), F.expr("'app.t' || k").alias("identity"), node.alias("node"))


def _column_changes(w: World) -> DataFrame:
    return snapshot.column_changes(_wide(w, False), _wide(w, True))


query("column_diff", f"SELECT 'app.t' || k AS identity, 'o' AS \"column\", 'drop' AS operation FROM ({P}) WHERE k % 4 = 0 UNION ALL SELECT 'app.t' || k, 'n', 'add' FROM ({P}) WHERE k % 3 = 0")(lambda w: _column_changes(w).select("identity", "column", "operation"))
query("rename_ambiguity", f"SELECT 'app.t' || k AS identity, 'o' AS dropped, 'n' AS added FROM ({P}) WHERE k % 12 = 0")(lambda w: _flat(snapshot.rename_candidates(_column_changes(w)), "dropped", "added"))
query("warn_not_null", f"SELECT 'not-null-without-default' AS code, 'warning' AS severity, 'app.t' || k || '.n' AS identity FROM ({P}) WHERE k % 3 = 0 AND x % 2 = 1 AND k % 5 > 0")(lambda w: validators.required_without_default(_column_changes(w)))

# names before and after: some go, some come, in the middle or at the end
_LISTS = "{a}'id', 'c' || x % 3, 'c' || (k % 4 + 3){b} AS b, CASE WHEN k % 5 = 0 THEN {a}'id', 'c' || x % 3, 'c' || (k % 4 + 3), 'new'{b} ELSE {a}'id', 'new', 'c' || x % 2, 'c' || (k % 4 + 3){b} END AS d"


def _lists(w: World) -> DataFrame:
    b, d = _LISTS.format(a="array(", b=")").split(" AS b, ")
    return parts(w).selectExpr("k", f"{b} as b", f"{d.removesuffix(' AS d')} as d")


_LISTED = "SELECT k, " + _LISTS.format(a="[", b="]") + f" FROM ({P})"
query("column_order", f"SELECT k, array_to_string(list_concat(list_filter(b, lambda c: list_contains(d, c)), list_filter(d, lambda c: NOT list_contains(b, c))), ',') AS names FROM ({_LISTED})")(
    lambda w: _flat(_lists(w).select("k", snapshot.physical_order(F.col("b"), F.col("d")).alias("names")), "names")
)
query("view_prefix_rule", f"SELECT k, d[1:len(b)] = b AS grows, b[1:len(d)] = d AS shrinks FROM ({_LISTED})")(lambda w: _lists(w).select("k", snapshot.replaces_view(F.col("b"), F.col("d")).alias("grows"), snapshot.replaces_view(F.col("d"), F.col("b")).alias("shrinks")))
query("enum_append_only", f"SELECT k, d[1:len(b)] = b AS appended FROM ({_LISTED})")(lambda w: _lists(w).select("k", snapshot.appends_enum(F.col("b"), F.col("d")).alias("appended")))


def _routines(w: World) -> DataFrame:
    node = lambda a, r, b: F.concat(F.lit('{"arguments":["a'), F.expr(a), F.lit('"],"body":"'), F.expr(b), F.lit('","returns":"'), F.expr(r), F.lit('"}'))
    return parts(w).select("k", snapshot.replaces_routine(node("x % 2", "x % 5", "k"), node("k % 2", "k % 5", "k + 1")).alias("replaced"))


query("routine_change", f"SELECT k, x % 2 = k % 2 AND x % 5 = k % 5 AS replaced FROM ({P})")(_routines)

_PINS = '{"level":%k,"table":"app.%t","when":{"args":["app","%t","c"],"family":"text","op":"ref"}}'


def _pin_rename(identity: str, node: dict, n: renames.Names) -> tuple[str, dict]:
    identity, node = renames.owned(identity, node, n)
    return identity, {**node, "table": ".".join(identity.split(".")[:2])}


def _pin() -> kinds.Kind:
    """A kind that a project brings: pins on tables, made anew if their level changes."""
    same = lambda: F.when(F.get_json_object("previous", "$.level") == F.get_json_object("next", "$.level"), "alter").otherwise("recreate")
    return kinds.Kind("pin", ("table", "policy"), ("level", "table", "when"), same, _pin_rename, dependent=True)


def _pinned(w: World, t: str, level: str, column_: str, where: str) -> DataFrame:
    """A pin for each part, and the tables that they are on."""
    pin = F.struct(F.lit("pin").alias("kind"), F.expr(f"'app.' || {t} || '.x'").alias("identity"), _filled(_PINS.replace('"c"', f'"{column_}"'), False, t, "''", level).alias("node"))
    own = F.struct(F.lit("table").alias("kind"), F.expr(f"'app.' || {t}").alias("identity"), F.lit('{"checks":[],"columns":[' + _KEY + "," + _KEY.replace('"id"', f'"{column_}"') + '],"foreign_keys":[],"indexes":[]}').alias("node"))
    return parts(w, where).select(F.inline(F.array(pin, own)))


def _pins(w: World) -> DataFrame:
    """Before, under new names for tables of even size and for all their columns c, and after, where levels differ for sizes that 3 divides."""
    known = kinds.registry(_pin())
    before = _pinned(w, "'t' || k", "1", "c", "k % 5 > 0")
    given = parts(w, "k % 5 > 0 and x % 2 = 0").selectExpr("'table' as of", "'app.t' || k as identity", "'t' || k as old", "'r' || k as new").union(parts(w, "k % 5 > 0").selectExpr("'column'", "'app.t' || k", "'c'", "'d'"))
    after = _pinned(w, "CASE WHEN x % 2 = 0 THEN 'r' ELSE 't' END || k", "CASE WHEN x % 3 = 0 THEN 2 ELSE 1 END", "d", "k % 7 > 0")
    changed = kinds.ordered(kinds.meaning(snapshot.diff(kinds.renamed(before, given, known), after), known), known)
    return changed.select("kind", "identity", "means", "stage")


query(
    "kind_custom",
    f"""WITH p AS (SELECT *, 'app.' || CASE WHEN x % 2 = 0 THEN 'r' ELSE 't' END || k AS t FROM ({P})),
d AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'create' WHEN k % 7 = 0 THEN 'drop' ELSE 'alter' END AS o FROM p WHERE NOT (k % 5 = 0 AND k % 7 = 0))
SELECT 'pin' AS kind, t || '.x' AS identity, CASE o WHEN 'alter' THEN 'recreate' ELSE o END AS means, CASE o WHEN 'drop' THEN 0 ELSE 1 END AS stage FROM d WHERE o <> 'alter' OR x % 3 = 0
UNION ALL SELECT 'table', t, o, CASE o WHEN 'drop' THEN 2 ELSE 1 END FROM d WHERE o <> 'alter'""",
)(_pins)

# ---- files of a chain

_LINKS = f"SELECT k, x, lpad('' || CASE WHEN x = 7 THEN k - 1 ELSE k END, 9, '0') || '_f' || k || '.sql' AS file, CASE WHEN x = 11 THEN 'h' || (k - 2) WHEN x = 13 THEN 'lost' || k WHEN k > 0 THEN 'h' || (k - 1) END AS parent, 'h' || k AS current FROM ({P})"


def _files(w: World) -> DataFrame:
    """One file a part. Of some sizes the version is that of the file before, or the parent is two before, or nobody's."""
    file = "lpad('' || CASE WHEN x = 7 THEN k - 1 ELSE k END, 9, '0') || '_f' || k || '.sql'"
    return parts(w).selectExpr(f"{file} as file", "CASE WHEN x = 11 THEN 'h' || (k - 2) WHEN x = 13 THEN 'lost' || k WHEN k > 0 THEN 'h' || (k - 1) END as parent", "'h' || k as current")


_CHAIN = f"""SELECT file, parent, CASE WHEN row_number() OVER (ORDER BY file) = 1 OR parent IS NOT DISTINCT FROM lag(current) OVER (ORDER BY file) THEN 'ok'
  WHEN row_number() OVER (PARTITION BY parent ORDER BY file) > 1 THEN 'fork' ELSE 'broken' END AS status FROM ({_LINKS})"""
query("chain_check", f"SELECT file, status FROM ({_CHAIN})")(lambda w: lineage.chain(_files(w)).select("file", "status"))
query("chain_fork", f"SELECT file FROM ({_CHAIN}) WHERE status = 'fork'")(lambda w: lineage.chain(_files(w)).where("status = 'fork'").select("file"))
query("chain_problem", f"WITH c AS ({_CHAIN}), p AS (SELECT * FROM c WHERE status <> 'ok' ORDER BY file LIMIT 1) SELECT p.status AS code, c.file FROM p JOIN c ON c.file = p.file OR p.status = 'fork' AND c.parent IS NOT DISTINCT FROM p.parent")(lambda w: lineage.problem(_files(w)))
query("duplicate_versions", f"SELECT split_part(file, '_', 1) AS version, array_to_string(list_sort(list(file)), ',') AS files FROM ({_LINKS}) GROUP BY 1 HAVING count(*) > 1")(lambda w: _flat(lineage.duplicate_versions(_files(w)), "files"))
query("banner_parse", f"SELECT k, md5('p' || x) AS parent, CASE WHEN k % 3 > 0 THEN md5('c' || k) END AS current FROM ({P})")(
    lambda w: parts(w).select("k", lineage.banner(F.concat(F.lit("-- change\n-- parent: "), F.md5(F.expr("'p' || x").cast("binary")), F.expr("CASE WHEN k % 3 > 0 THEN '\\n-- current: ' ELSE '\\n-- then: ' END"), F.md5(F.expr("'c' || k").cast("binary")), F.lit("\ncreate table t"))).alias("b")).select("k", "b.*")
)


def _headers(w: World) -> DataFrame:
    """A change file for each size: the changes of its parts, and the states before and after."""
    rows = parts(w).selectExpr("'f' || x as file", "k as place", "CASE k % 2 WHEN 0 THEN 'table' ELSE 'view' END as kind", "'app.o' || k as identity", "CASE k % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'alter' ELSE 'drop' END as operation", "CASE k % 3 WHEN 1 THEN array('n' || x, 'm' || k) END as notes")
    states = parts(w).selectExpr("'f' || x as file", "CASE WHEN x > 1 THEN md5(cast('s' || (x - 1) as binary)) END as parent", "md5(cast('s' || x as binary)) as current").distinct()
    made = lineage.headers(rows, states)
    return made.select("file", F.md5(F.col("text").cast("binary")).alias("text"), lineage.banner(F.col("text")).alias("b")).select("file", "text", "b.*")


query(
    "banner_write",
    f"""WITH l AS (SELECT x, k, '-- ' || CASE k % 3 WHEN 0 THEN '+' WHEN 1 THEN '~' ELSE '-' END || ' ' || CASE k % 2 WHEN 0 THEN 'table' ELSE 'view' END || ' app.o' || k || CASE k % 3 WHEN 1 THEN ' [n' || x || ', m' || k || ']' ELSE '' END AS line FROM ({P}))
SELECT 'f' || x AS file, md5(string_agg(line, chr(10) ORDER BY k) || CASE WHEN x > 1 THEN chr(10) || '-- parent: ' || md5('s' || (x - 1)) ELSE '' END || chr(10) || '-- current: ' || md5('s' || x)) AS text, CASE WHEN x > 1 THEN md5('s' || (x - 1)) END AS parent, md5('s' || x) AS current FROM l GROUP BY x""",
)(_headers)


def _history(w: World) -> DataFrame:
    files = parts(w, "k % 5 > 0").selectExpr("'f' || k as file", "'h' || x as hash")
    commits = parts(w, "k % 3 > 0").selectExpr("'f' || k as file", "'h' || CASE WHEN k % 7 = 0 THEN 0 ELSE x END as hash", "2 as at").union(parts(w, "k % 2 = 0").selectExpr("'f' || k", "'first'", "1"))
    return lineage.history(files, commits)


query(
    "history_state",
    f"""SELECT 'f' || k AS file, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 'uncommitted' WHEN k % 5 = 0 THEN 'lost' WHEN k % 3 = 0 OR k % 7 = 0 THEN 'rewritten' ELSE 'ok' END AS state FROM ({P}) WHERE k % 5 > 0 OR k % 3 > 0 OR k % 2 = 0""",
)(_history)
query("file_diff", f"SELECT 'p' || k AS path, CASE WHEN k % 3 = 0 THEN 'add' WHEN k % 4 = 0 THEN 'remove' ELSE 'change' END AS operation FROM ({P}) WHERE k % 3 = 0 AND k % 4 > 0 OR k % 4 = 0 AND k % 3 > 0 OR k % 3 > 0 AND k % 4 > 0 AND k % 5 = 0")(
    lambda w: lineage.tree_diff(parts(w, "k % 3 > 0").selectExpr("'p' || k as path", "'h' || x as hash"), parts(w, "k % 4 > 0").selectExpr("'p' || k as path", "CASE WHEN k % 5 = 0 THEN 'n' ELSE 'h' END || x as hash"))
)


def _verified(w: World) -> DataFrame:
    """The chain as it is, and the part of it that has its versions once and its links whole."""
    good = _files(w).join(parts(w, "x in (7, 11, 13)").selectExpr("'h' || k as current"), "current", "left_anti").select("file", "parent", "current")
    whole = parts(w).selectExpr("lpad('' || k, 9, '0') || '_f.sql' as file", "CASE WHEN k > 0 THEN 'h' || (k - 1) END as parent", "'h' || k as current")
    tip = parts(w).selectExpr("'h' || max(k) as t").first()["t"]
    stored, rebuilt = _generated(w, False), _generated(w, True)
    runs = (("all", _files(w), stored, stored), ("once", good, stored, stored), ("whole", whole, stored, stored), ("changed", whole, stored, rebuilt))
    out = [lineage.verify(files, a, b, tip).select(F.lit(name).alias("run"), "check", "status", "n") for name, files, a, b in runs]
    return out[0].union(out[1]).union(out[2]).union(out[3])


query(
    "verify_report",
    f"""WITH l AS ({_LINKS}), g AS (SELECT * FROM l WHERE x NOT IN (7, 11, 13)),
v AS (SELECT count(*) AS n FROM (SELECT split_part(file, '_', 1) AS v FROM l GROUP BY 1 HAVING count(*) > 1)),
c AS (SELECT count(*) AS n FROM (SELECT file, CASE WHEN row_number() OVER (ORDER BY file) = 1 OR parent IS NOT DISTINCT FROM lag(current) OVER (ORDER BY file) THEN 1 ELSE 0 END AS ok FROM g) WHERE ok = 0),
d AS (SELECT count(*) AS n FROM ({_DIFF}))
SELECT run, "check", CASE WHEN n IS NULL THEN 'skipped' WHEN n > 0 THEN 'failed' ELSE 'ok' END AS status, n::INTEGER AS n FROM (
  SELECT 'all' AS run, 'versions' AS "check", v.n FROM v UNION ALL SELECT 'all', 'chain', CASE WHEN v.n = 0 THEN c.n END FROM v, c UNION ALL SELECT 'all', 'rebuild', 0 UNION ALL SELECT 'all', 'tip', CASE WHEN v.n = 0 AND c.n = 0 THEN 0 END FROM v, c
  UNION ALL SELECT 'once', 'versions', 0 UNION ALL SELECT 'once', 'chain', c.n FROM c UNION ALL SELECT 'once', 'rebuild', 0 UNION ALL SELECT 'once', 'tip', CASE WHEN c.n = 0 THEN 0 END FROM c
  UNION ALL SELECT 'whole', unnest(['versions', 'chain', 'rebuild', 'tip']), 0
  UNION ALL SELECT 'changed', unnest(['versions', 'chain']), 0 UNION ALL SELECT 'changed', 'rebuild', d.n FROM d UNION ALL SELECT 'changed', 'tip', CASE WHEN d.n = 0 THEN 0 END FROM d)""",
)(_verified)

# ---- warnings


def _policies(w: World) -> DataFrame:
    return parts(w).selectExpr("'app' || x as schema", "'t' || k as table", "'own' as name", "CASE WHEN k % 2 = 0 THEN array('r' || k % 9) ELSE array('public', 'r' || k % 7) END as roles")


query(
    "warn_unreachable",
    f"""WITH u AS (SELECT DISTINCT schema, role FROM ({_granted()}) WHERE kind = 'usage'),
p AS (SELECT 'app' || x AS schema, 't' || k AS t, unnest(CASE WHEN k % 2 = 0 THEN ['r' || k % 9] ELSE ['public', 'r' || k % 7] END) AS role FROM ({P}))
SELECT DISTINCT 'unreachable-policy' AS code, 'warning' AS severity, schema || '.' || t || '.own' AS identity FROM p WHERE role = 'public' AND schema NOT IN (SELECT schema FROM u) OR role <> 'public' AND NOT EXISTS (SELECT 1 FROM u WHERE u.schema = p.schema AND u.role = p.role)""",
)(lambda w: validators.unreachable_policies(_policies(w), security.fanned_out(_declared(w))))


def _exposed(w: World) -> DataFrame:
    tables = parts(w).selectExpr("'app' || x as schema", "'t' || k as table")
    return validators.exposed_tables(tables, security.fanned_out(_declared(w, "k % 4 = 0")), tables.where("table in ('t1') or schema < 'app3'"), open_roles=("r1", "r2"))


query(
    "warn_exposed",
    f"""SELECT 'exposed-table' AS code, 'warning' AS severity, 'app' || x || '.t' || k AS identity FROM ({P}) WHERE k <> 1 AND NOT 'app' || x < 'app3' AND 'app' || x IN (SELECT schema FROM ({_granted("k % 4 = 0")}) WHERE kind = 'tables' AND role IN ('r1', 'r2'))""",
)(_exposed)
query("warn_reserved", f"SELECT 'reserved-schema' AS code, 'error' AS severity, CASE x % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'storage' END || '.t' || k AS identity FROM ({P}) WHERE x % 5 < 2")(
    lambda w: validators.reserved_schemas(parts(w).selectExpr("CASE x % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'storage' ELSE 'app' END as schema", "CASE x % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'storage' ELSE 'app' END || '.t' || k as identity"))
)
query("warn_view_invoker", f"SELECT 'view-past-policies' AS code, 'warning' AS severity, 'app.v' || k AS identity FROM ({P}) WHERE k % 3 > 0 AND (k % 4 = 0 OR x % 4 = 0)")(
    lambda w: validators.views_past_policies(parts(w).selectExpr("'app.v' || k as identity", "k % 3 = 0 as security_invoker", "array('app.t' || k, 'app.s' || x) as tables"), parts(w, "k % 4 = 0").selectExpr("'app' as schema", "'t' || k as table").union(parts(w, "x % 4 = 0").selectExpr("'app'", "'s' || x").distinct()))
)
