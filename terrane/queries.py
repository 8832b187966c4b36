"""The queries of the library's own operators on the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DeclarationError
from .functions import expressions as X
from .operators import batches, changes, integrity, routines, security, writes
from .plans import kinds, lineage, renames, snapshot, validators
from .plans.query import Select, View, select
from .sources.catalog import Check, Enum, ForeignKey, Index, Store, Table, column, from_parquet, table

Query = Callable[[SparkSession, str], DataFrame]
def _flat(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as comma-joined text, which every engine compares alike."""
    return df.withColumns({c: F.array_join(c, ",") for c in arrays})


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NAMES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@lru_cache(maxsize=64)
def _struct(spark: SparkSession, path: str):
    return spark.read.parquet(path).schema


class World:
    """The driver's tables as a schema `w`: w.customer is a table, w.store reads them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.store = spark, Store(spark)
        for n in NAMES:
            path = f"{sf_dir}/{n}.parquet"
            t = from_parquet("w", n, _struct(spark, path))
            setattr(self, n, t)
            self.store.bind(t, path)

    def rows(self, name: str) -> DataFrame:
        return self.store.read(("w", name))


def query(name: str, sql: str | None = None) -> Callable[[Callable[[World], DataFrame | Select]], None]:
    def register(build: Callable[[World], DataFrame | Select]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            w = World(spark, sf_dir)
            out = build(w)
            return out.frame(w.store) if isinstance(out, Select) else out

        QUERIES[name] = run
        if sql:
            SQL[name] = sql

    return register


# ---- predicates ------------------------------------------------------------


def _predicates() -> None:
    orders: dict[str, tuple[Callable[[Table], X.Expr], str]] = {
        "pred_eq": (lambda o: X.eq(o["o_orderstatus"], "F"), "o_orderstatus = 'F'"),
        "pred_ne": (lambda o: X.ne(o["o_orderstatus"], "F"), "o_orderstatus <> 'F'"),
        "pred_gt": (lambda o: X.gt(o["o_totalprice"], 250000), "o_totalprice > 250000"),
        "pred_gte": (lambda o: X.gte(o["o_custkey"], 100), "o_custkey >= 100"),
        "pred_lt": (lambda o: X.lt(o["o_totalprice"], 5000), "o_totalprice < 5000"),
        "pred_lte": (lambda o: X.lte(o["o_custkey"], 100), "o_custkey <= 100"),
        "pred_like": (lambda o: X.like(o["o_orderpriority"], "1%"), "o_orderpriority LIKE '1%'"),
        "pred_ilike": (lambda o: X.ilike(o["o_orderpriority"], "%urgent"), "o_orderpriority ILIKE '%urgent'"),
        "pred_not_like": (lambda o: X.not_like(o["o_orderpriority"], "1%"), "o_orderpriority NOT LIKE '1%'"),
        "pred_not_ilike": (lambda o: X.not_ilike(o["o_orderpriority"], "%URGENT"), "o_orderpriority NOT ILIKE '%URGENT'"),
        "pred_is_null": (lambda o: X.is_null(X.sql("nullif({}, 'F')", o["o_orderstatus"])), "nullif(o_orderstatus, 'F') IS NULL"),
        "pred_is_not_null": (lambda o: X.is_not_null(X.sql("nullif({}, 'F')", o["o_orderstatus"])), "nullif(o_orderstatus, 'F') IS NOT NULL"),
        "pred_and": (lambda o: X.and_(X.eq(o["o_orderstatus"], "O"), X.gt(o["o_totalprice"], 100000), X.lt(o["o_custkey"], 900)), "o_orderstatus = 'O' AND o_totalprice > 100000 AND o_custkey < 900"),
        "pred_or": (lambda o: X.or_(X.eq(o["o_orderstatus"], "P"), X.gt(o["o_totalprice"], 300000)), "o_orderstatus = 'P' OR o_totalprice > 300000"),
        "pred_not": (lambda o: X.not_(X.eq(X.sql("nullif({}, 'F')", o["o_orderstatus"]), "O")), "NOT (nullif(o_orderstatus, 'F') = 'O')"),
        "pred_in": (lambda o: X.in_array(o["o_orderstatus"], ["O", "P"]), "o_orderstatus IN ('O', 'P')"),
        "pred_not_in": (lambda o: X.not_in_array(o["o_orderstatus"], ["O", None]), "o_orderstatus NOT IN ('O', NULL)"),
        "pred_between": (lambda o: X.between(o["o_totalprice"], 1000, 20000), "o_totalprice BETWEEN 1000 AND 20000"),
        "pred_not_between": (lambda o: X.not_between(o["o_totalprice"], 1000, 200000), "o_totalprice NOT BETWEEN 1000 AND 200000"),
        "pred_literal": (lambda o: X.and_(X.literal(True), X.eq(o["o_orderstatus"], "P")), "true AND o_orderstatus = 'P'"),
        "pred_sql_template": (lambda o: X.sql("length(btrim({})) > {} and {} rlike '^[0-9]-'", o["o_orderpriority"], 7, o["o_orderpriority"], family="boolean"), "length(trim(o_orderpriority)) > 7 AND regexp_matches(o_orderpriority, '^[0-9]-')"),
    }
    for name, (condition, sql) in orders.items():
        query(name, f"SELECT o_orderkey FROM orders WHERE {sql}")(lambda w, c=condition: select({"o_orderkey": w.orders["o_orderkey"]}, w.orders).where(c(w.orders)))


_predicates()

# ---- projection, joins, exists, order --------------------------------------

query("project_all", "SELECT * FROM region")(lambda w: select(w.region))
query("project_alias", "SELECT o_orderkey AS order_key, coalesce(nullif(o_orderstatus, 'F'), 'none') AS state FROM orders")(
    lambda w: select({"orderKey": w.orders["o_orderkey"], "state": X.coalesce(X.sql("nullif({}, 'F')", w.orders["o_orderstatus"]), "none")}, w.orders)
)
query("join_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")(
    lambda w: select({"c_custkey": w.customer["c_custkey"], "n_name": w.nation["n_name"]}, w.customer).inner_join(w.nation, X.eq(w.customer["c_nationkey"], w.nation["n_nationkey"]))
)
query("join_chain", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda w: select({"c_custkey": w.customer["c_custkey"], "n_name": w.nation["n_name"], "r_name": w.region["r_name"]}, w.customer)
    .inner_join(w.nation, X.eq(w.customer["c_nationkey"], w.nation["n_nationkey"]))
    .inner_join(w.region, X.eq(w.nation["n_regionkey"], w.region["r_regionkey"]))
)
query("join_theta", "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey > r_regionkey")(
    lambda w: select({"n_name": w.nation["n_name"], "r_name": w.region["r_name"]}, w.nation).inner_join(w.region, X.gt(w.nation["n_nationkey"], w.region["r_regionkey"]))
)


def _orders_of(w: World, *more: X.Expr) -> Select:
    return select(w.orders).where(X.and_(X.eq(w.orders["o_custkey"], w.customer["c_custkey"]), *more))


query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")(
    lambda w: select({"c_custkey": w.customer["c_custkey"]}, w.customer).where(X.exists(_orders_of(w, X.gt(w.orders["o_totalprice"], 350000))))
)
query("anti_not_exists", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")(
    lambda w: select({"doc_id": w.documents["doc_id"]}, w.documents).where(X.not_exists(select(w.labels).where(X.eq(w.labels["doc_id"], w.documents["doc_id"]))))
)
query("exists_under_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")(
    lambda w: select({"c_custkey": w.customer["c_custkey"]}, w.customer).where(X.or_(X.lt(w.customer["c_acctbal"], 0), X.exists(_orders_of(w, X.eq(w.orders["o_orderstatus"], "P")))))
)
query("exists_with_join", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = s_nationkey AND r_name LIKE 'A%')")(
    lambda w: select({"s_suppkey": w.supplier["s_suppkey"]}, w.supplier).where(
        X.exists(select(w.nation).inner_join(w.region, X.eq(w.nation["n_regionkey"], w.region["r_regionkey"])).where(X.and_(X.eq(w.nation["n_nationkey"], w.supplier["s_nationkey"]), X.like(w.region["r_name"], "A%"))))
    )
)
query("exists_theta", "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey > n_nationkey)")(
    lambda w: select({"n_nationkey": w.nation["n_nationkey"]}, w.nation).where(X.exists(select(w.region).where(X.gt(w.region["r_regionkey"], w.nation["n_nationkey"]))))
)
query("sort_multi", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")(
    lambda w: select({"o_orderkey": w.orders["o_orderkey"], "o_totalprice": w.orders["o_totalprice"]}, w.orders).order_by((w.orders["o_totalprice"], "desc"), w.orders["o_orderkey"])
)
query("topk", "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey LIMIT 20")(
    lambda w: select({"o_orderkey": w.orders["o_orderkey"]}, w.orders).order_by((X.sql("nullif({}, 'F')", w.orders["o_orderstatus"]), "desc"), w.orders["o_orderkey"]).limit(20)
)
query("limit_n", "SELECT n_name FROM nation ORDER BY n_name LIMIT 7")(lambda w: select({"n_name": w.nation["n_name"]}, w.nation).order_by(w.nation["n_name"]).limit(7))
query("flagship", "SELECT c_custkey, c_name, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 1000) ORDER BY c_acctbal DESC, c_custkey LIMIT 10")(
    lambda w: select({"c_custkey": w.customer["c_custkey"], "c_name": w.customer["c_name"], "n_name": w.nation["n_name"], "c_acctbal": w.customer["c_acctbal"]}, w.customer)
    .inner_join(w.nation, X.eq(w.customer["c_nationkey"], w.nation["n_nationkey"]))
    .where(X.and_(X.gt(w.customer["c_acctbal"], 0), X.exists(_orders_of(w, X.eq(w.orders["o_orderstatus"], "O"), X.gt(w.orders["o_totalprice"], 1000)))))
    .order_by((w.customer["c_acctbal"], "desc"), w.customer["c_custkey"])
    .limit(10)
)

# ---- functions -------------------------------------------------------------

query("fn_coalesce", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'missing') AS s FROM orders")(lambda w: select({"o_orderkey": w.orders["o_orderkey"], "s": X.coalesce(X.sql("nullif({}, 'F')", w.orders["o_orderstatus"]), "missing")}, w.orders))
query("fn_call", "SELECT n_nationkey, upper(n_name) AS u, length(n_name)::INTEGER AS l FROM nation")(lambda w: select({"n_nationkey": w.nation["n_nationkey"], "u": X.call("upper", w.nation["n_name"]), "l": X.call("length", w.nation["n_name"])}, w.nation))
query("fn_now", "SELECT r_regionkey, true AS known FROM region")(lambda w: select({"r_regionkey": w.region["r_regionkey"], "known": X.is_not_null(X.now())}, w.region))
query("fn_uuid")(lambda w: select({"r_regionkey": w.region["r_regionkey"], "id": X.random_uuid()}, w.region))
query("literal_kinds", "SELECT r_regionkey, 'a''b' AS t, 1.5::DOUBLE AS n, true AS b, NULL::INTEGER AS z FROM region")(
    lambda w: select({"r_regionkey": w.region["r_regionkey"], "t": X.literal("a'b"), "n": X.literal(1.5), "b": X.literal(True), "z": X.sql("cast({} as int)", None)}, w.region)
)

# ---- changes ---------------------------------------------------------------


def _nation(w: World) -> Table:
    return table("w", "nation", {"n_nationkey": column("integer").primary_key(), "n_name": column("text").not_null().default("unnamed"), "n_regionkey": column("integer")})


def _news(w: World) -> DataFrame:
    """New line items: all that there are, with a new key for those of line number 3."""
    return w.rows("lineitem").withColumn("l_orderkey", F.expr("l_orderkey + if(l_linenumber = 3, 1000000000, 0)"))


_NEWS = "SELECT * REPLACE (l_orderkey + CASE WHEN l_linenumber = 3 THEN 1000000000 ELSE 0 END AS l_orderkey) FROM lineitem"
_LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_FIRST_NEWS = f"SELECT * FROM ({_NEWS}) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1"

query("insert_single", "SELECT * FROM nation UNION ALL SELECT 100, 'NOWHERE', 1")(lambda w: changes.insert(_nation(w), [{"n_nationkey": 100, "n_name": "NOWHERE", "n_regionkey": 1}], w.store).state)
query("insert_multi_default", "SELECT * FROM nation UNION ALL SELECT 100, 'unnamed', 1 UNION ALL SELECT 101, 'B', NULL")(
    lambda w: changes.insert(_nation(w), [{"n_nationkey": 100, "n_regionkey": 1}, {"n_nationkey": 101, "n_name": "B"}], w.store).state
)
query("upsert_nothing", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM ({_FIRST_NEWS}) n WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber)")(
    lambda w: changes.insert_or_skip(w.lineitem, _news(w), _LINE_KEY, _LINE_ORDER, w.store).state.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
)
query("upsert_nothing_returning", f"SELECT l_orderkey, l_linenumber, l_partkey FROM ({_FIRST_NEWS}) n WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber)")(
    lambda w: changes.insert_or_skip(w.lineitem, _news(w), _LINE_KEY, _LINE_ORDER, w.store).returned.select("l_orderkey", "l_linenumber", "l_partkey")
)


def _customer_news(w: World) -> DataFrame:
    return w.rows("customer").withColumns({"c_custkey": F.expr("c_custkey + if(c_custkey % 2 = 0, 10000000, 0)"), "c_acctbal": F.lit(1.0)})


query(
    "upsert_update",
    """WITH n AS (SELECT * REPLACE (c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 10000000 ELSE 0 END AS c_custkey, 1.0::DOUBLE AS c_acctbal) FROM customer)
SELECT c.c_custkey, c.c_name, CASE WHEN n.c_custkey IS NULL THEN c.c_acctbal ELSE c.c_acctbal + n.c_acctbal END AS c_acctbal FROM customer c LEFT JOIN n USING (c_custkey)
UNION ALL SELECT c_custkey, c_name, c_acctbal FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""",
)(lambda w: changes.insert_or_update(w.customer, _customer_news(w), ["c_custkey"], {"c_acctbal": X.sql("`c_acctbal` + `_new_c_acctbal`")}, ["c_custkey"], w.store).state.select("c_custkey", "c_name", "c_acctbal"))
query("update_where", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")(
    lambda w: changes.update(w.orders, {"o_orderstatus": "Z"}, X.eq(w.orders["o_orderstatus"], "F"), w.store).state.select("o_orderkey", "o_orderstatus", "o_totalprice")
)
query("update_returning", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'P'")(
    lambda w: changes.update(w.orders, {"o_totalprice": X.sql("{} * 2", w.orders["o_totalprice"])}, X.eq(w.orders["o_orderstatus"], "P"), w.store).returned.select("o_orderkey", "o_totalprice")
)
query("update_exists", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment FROM customer")(
    lambda w: changes.update(w.customer, {"c_mktsegment": "RICH"}, X.exists(_orders_of(w, X.gt(w.orders["o_totalprice"], 350000))), w.store).state.select("c_custkey", "c_mktsegment")
)
query("delete_where", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'F') = 'O', false)")(
    lambda w: changes.delete(w.orders, X.eq(X.sql("nullif({}, 'F')", w.orders["o_orderstatus"]), "O"), w.store).state.select("o_orderkey")
)
query("delete_returning", "SELECT o_orderkey FROM orders WHERE o_totalprice < 2000")(lambda w: changes.delete(w.orders, X.lt(w.orders["o_totalprice"], 2000), w.store).returned.select("o_orderkey"))
query("delete_exists", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")(
    lambda w: changes.delete(w.customer, X.exists(_orders_of(w, X.gt(w.orders["o_totalprice"], 350000))), w.store).state.select("c_custkey")
)
query("serial_assign", "SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER + 7 AS id, c_custkey FROM customer")(
    lambda w: changes.assign_serials(
        w.rows("customer").select(F.lit(None).cast("int").alias("id"), "c_custkey"), w.spark.sql("select 7 as id, 0L as c_custkey"), table("w", "numbered", {"id": column("serial").primary_key(), "c_custkey": column("bigint")}), ["c_custkey"]
    )
)

_BUCKET = table("storage", "buckets", {"id": column("text").primary_key(), "name": column("text").not_null(), "public": column("boolean"), "file_size_limit": column("bigint")})


# ---- constraints -----------------------------------------------------------

query("viol_not_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL")(
    lambda w: integrity.not_null_violations(table("w", "o", {"o_orderkey": column("bigint"), "o_orderstatus": column("text").not_null()}), w.rows("orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))).select("o_orderkey")
)
query("viol_pk", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")(
    lambda w: integrity.primary_key_violations(table("w", "lineitem", {"l_orderkey": column("bigint").primary_key(), "l_linenumber": column("integer").primary_key()}), w.rows("lineitem"))
)
query("viol_unique", "SELECT o_totalprice, count(*) AS n_rows FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1 HAVING count(*) > 1")(lambda w: integrity.duplicate_keys(w.rows("orders"), ["o_totalprice"]))
query("viol_unique_multi", "SELECT o_custkey, o_orderdate, count(*) AS n_rows FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")(
    lambda w: integrity.unique_index_violations(Index((("o_custkey", "asc", None), ("o_orderdate", "desc", None)), unique=True), w.rows("orders"))
)
query("viol_unique_partial", "SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")(
    lambda w: integrity.unique_index_violations(Index((("o_custkey", "asc", None),), unique=True, where=X.eq(w.orders["o_orderstatus"], "P")), w.rows("orders"))
)
query("viol_check", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal >= 0, true)")(lambda w: integrity.check_violations(Check("positive", X.gte(w.customer["c_acctbal"], 0)), w.rows("customer")).select("c_custkey"))
query("viol_fk", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")(
    lambda w: integrity.foreign_key_violations(ForeignKey(("o_custkey",), ("w", "customer"), ("c_custkey",)), w.rows("orders"), w.rows("customer").where("c_acctbal > 0")).select("o_orderkey")
)
query("viol_fk_self", "SELECT doc_id FROM documents WHERE nullif(doc_id - 1, -1) IS NOT NULL AND doc_id - 1 NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")(
    lambda w: integrity.foreign_key_violations(ForeignKey(("parent_id",), ("w", "documents"), ("doc_id",)), w.rows("documents").withColumn("parent_id", F.expr("nullif(doc_id - 1, -1)")), w.rows("documents").where("lang = 'en'")).select("doc_id")
)
query("viol_enum", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")(lambda w: integrity.enum_violations(Enum("w", "status", ("O", "F")), "o_orderstatus", w.rows("orders")).select("o_orderkey"))


def _tree(w: World, action: str) -> list[Table]:
    return [
        table("w", "region", {"r_regionkey": column("integer").primary_key(), "r_name": column("text")}),
        table("w", "nation", {"n_nationkey": column("integer").primary_key(), "n_name": column("text"), "n_regionkey": column("integer")}, foreign_keys=(ForeignKey(("n_regionkey",), ("w", "region"), ("r_regionkey",), "cascade"),)),
        table("w", "customer", {"c_custkey": column("bigint").primary_key(), "c_name": column("text"), "c_nationkey": column("integer")}, foreign_keys=(ForeignKey(("c_nationkey",), ("w", "nation"), ("n_nationkey",), action),)),
    ]


query("fk_update_cascade", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer")(
    lambda w: _updated_nations(w)
)


def _updated_nations(w: World) -> DataFrame:
    """The customers after five nations got new keys."""
    nation = _nation(w)
    customer = table("w", "customer", {n: column(k) for n, k in (("c_custkey", "bigint"), ("c_nationkey", "integer"))}, foreign_keys=(ForeignKey(("c_nationkey",), nation.key, ("n_nationkey",), on_update="cascade"),))
    changed = w.rows("nation").select(F.expr("if(n_nationkey < 5, n_nationkey + 100, n_nationkey)").alias("n_nationkey"), F.col("n_nationkey").alias("old__n_nationkey"))
    return integrity.update_cascading([nation, customer], nation, changed, w.store)[customer.key]


query("fk_cascade", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_nationkey IS NULL")(
    lambda w: integrity.delete_cascading(ts := _tree(w, "cascade"), ts[0], w.rows("region").where("r_regionkey = 1"), w.store)["w", "customer"].select("c_custkey")
)
query("fk_set_null", "SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")(
    lambda w: integrity.delete_cascading(ts := _tree(w, "set null"), ts[0], w.rows("region").where("r_regionkey = 1"), w.store)["w", "customer"].select("c_custkey", "c_nationkey")
)
query("fk_restrict", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2")(
    lambda w: integrity.on_parent_delete(w.nation, ForeignKey(("n_regionkey",), ("w", "region"), ("r_regionkey",), "restrict"), w.rows("nation"), w.rows("region").where("r_regionkey = 2"))[1].select("n_nationkey")
)
query("index_sort_spec", "SELECT s_suppkey FROM supplier")(lambda w: integrity.sorted_for(Index((("s_acctbal", "desc", "last"), ("s_suppkey", "asc", None))), w.rows("supplier")).select("s_suppkey"))

# ---- policies and grants ---------------------------------------------------


def _session(w: World, policies: list[security.Policy], role: str = "clerk", t: str = "orders", **values: object) -> security.Session:
    return security.Session(w.store, role, [security.Protected(getattr(w, t), tuple(policies))], **values)


def _p(name: str, using: X.Expr | None = None, command: str = "select", roles: tuple[str, ...] = ("clerk",), **more: object) -> security.Policy:
    return security.Policy(name, command, roles, using, **more)


query("policy_select", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")(lambda w: select({"o_orderkey": w.orders["o_orderkey"]}, w.orders).frame(_session(w, [_p("open", X.eq(w.orders["o_orderstatus"], "O"))])))
query("policy_default_deny", "SELECT o_orderkey FROM orders WHERE false")(lambda w: select({"o_orderkey": w.orders["o_orderkey"]}, w.orders).frame(_session(w, [_p("other", X.eq(w.orders["o_orderstatus"], "O"), roles=("boss",))])))
query("policy_restrictive", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderstatus = 'P') AND o_totalprice > 100000")(
    lambda w: select({"o_orderkey": w.orders["o_orderkey"]}, w.orders).frame(
        _session(w, [_p("open", X.eq(w.orders["o_orderstatus"], "O")), _p("part", X.eq(w.orders["o_orderstatus"], "P")), _p("large", X.gt(w.orders["o_totalprice"], 100000), restrictive=True)])
    )
)
query("policy_roles", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 3000")(
    lambda w: select({"o_orderkey": w.orders["o_orderkey"]}, w.orders).frame(
        _session(w, [_p("open", X.eq(w.orders["o_orderstatus"], "O"), roles=("boss",)), _p("done", X.eq(w.orders["o_orderstatus"], "F"), command="all"), _p("small", X.lt(w.orders["o_totalprice"], 3000), roles=("public",))])
    )
)
query("policy_owner", "SELECT o_orderkey FROM orders WHERE o_custkey = 42")(lambda w: select({"o_orderkey": w.orders["o_orderkey"]}, w.orders).frame(_session(w, [_p("own", X.eq(w.orders["o_custkey"], X.local("user_id")))], user_id=42)))
query("policy_exists", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")(
    lambda w: select({"doc_id": w.documents["doc_id"]}, w.documents).frame(_session(w, [_p("good", X.exists(select(w.labels).where(X.and_(X.eq(w.labels["doc_id"], w.documents["doc_id"]), X.eq(w.labels["quality"], 1)))))], t="documents"))
)
query("policy_insert_check", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 200000, false)")(
    lambda w: _session(w, [_p("small", None, "insert", with_check=X.lt(w.orders["o_totalprice"], 200000))]).refused(w.orders, w.rows("orders")).select("o_orderkey")
)
query("policy_update", "SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderstatus = 'O'")(
    lambda w: _session(w, [_p("open", X.eq(w.orders["o_orderstatus"], "O"), "update")]).read(("w", "orders"), "update").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
)
query("view_invoker", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")(
    lambda w: security.read_view(View("w", "large", select({"o_orderkey": w.orders["o_orderkey"]}, w.orders).where(X.gt(w.orders["o_totalprice"], 200000)), True), _session(w, [_p("open", X.eq(w.orders["o_orderstatus"], "O"))]))
)


# ---- routines --------------------------------------------------------------


def _lookup(w: World) -> routines.Routine:
    o = w.orders

    def body(ctx: routines.Body, customer: X.Expr) -> None:
        ctx.return_query(select({"o_orderkey": o["o_orderkey"], "o_totalprice": o["o_totalprice"]}, o).where(X.eq(o["o_custkey"], customer)))

    return routines.routine("orders_of", {"customer": "numeric"}, body)


query("fn_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")(lambda w: _lookup(w)(w.store, customer=7))


def _strict(w: World) -> DataFrame:
    n, c = w.nation, w.customer

    def body(ctx: routines.Body, key: X.Expr) -> None:
        row = ctx.row(select({"n_regionkey": n["n_regionkey"]}, n).where(X.eq(n["n_nationkey"], key)), "nation_row")
        ctx.return_query(select({"n_name": n["n_name"]}, n).where(X.eq(n["n_regionkey"], row["n_regionkey"])))

    return routines.routine("siblings", {"key": "numeric"}, body)(w.store, key=3)


query("fn_row_strict", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")(_strict)


def _or_null(w: World) -> DataFrame:
    n = w.nation

    def body(ctx: routines.Body, key: X.Expr) -> None:
        row = ctx.row_or_null(select({"n_name": n["n_name"]}, n).where(X.eq(n["n_nationkey"], key)), "nation_row")
        ctx.if_((X.is_null(row["n_name"]), lambda b: b.return_query(select({"r_name": w.region["r_name"]}, w.region))), (None, lambda b: b.raise_("found %", row["n_name"])))

    return routines.routine("regions_unless", {"key": "numeric"}, body)(w.store, key=-1)


query("fn_row_or_null", "SELECT r_name FROM region")(_or_null)


def _if(w: World) -> DataFrame:
    o = w.orders

    def body(ctx: routines.Body, status: X.Expr) -> None:
        of = lambda s: lambda b: b.return_query(select({"o_orderkey": o["o_orderkey"]}, o).where(X.eq(o["o_orderstatus"], s)))
        ctx.if_((X.eq(status, "done"), of("F")), (X.eq(status, "part"), of("P")), (None, of("O")))

    return routines.routine("by_status", {"status": "text"}, body)(w.store, status="part")


query("fn_if", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")(_if)


def _for_each(w: World) -> DataFrame:
    r, n = w.region, w.nation

    def body(ctx: routines.Body) -> None:
        ctx.for_each(select({"r_regionkey": r["r_regionkey"], "r_name": r["r_name"]}, r).where(X.like(r["r_name"], "A%")), lambda b, x: b.return_query(select({"n_name": n["n_name"], "region": x["r_name"]}, n).where(X.eq(n["n_regionkey"], x["r_regionkey"]))))

    return routines.routine("nations_of", {}, body)(w.store)


query("fn_for_each", "SELECT n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")(_for_each)


def _return_dml(w: World) -> DataFrame:
    def body(ctx: routines.Body, price: X.Expr) -> None:
        ctx.return_query(routines.Change("delete", w.orders, X.lt(w.orders["o_totalprice"], price)))
        ctx.return_query(routines.Change("update", w.orders, X.eq(w.orders["o_orderstatus"], "P"), (("o_orderstatus", "Q"),)))

    return routines.routine("purge", {"price": "numeric"}, body)(w.store, price=2000).select("o_orderkey", "o_orderstatus")


def _nested(w: World) -> DataFrame:
    def body(ctx: routines.Body) -> None:
        def region(c: routines.Body, r: dict[str, X.Expr]) -> None:
            def nation(d: routines.Body, n: dict[str, X.Expr]) -> None:
                poor = select({"region": X.coalesce(r["r_name"], ""), "nation": X.coalesce(n["n_name"], ""), "key": w.customer["c_custkey"]}, w.customer)
                d.if_(
                    (X.like(n["n_name"], "A%"), lambda e: e.return_query(poor.where(X.and_(X.eq(w.customer["c_nationkey"], n["n_nationkey"]), X.lt(w.customer["c_acctbal"], 0))))),
                    (None, lambda e: e.return_query(poor.where(X.and_(X.eq(w.customer["c_nationkey"], n["n_nationkey"]), X.gt(w.customer["c_acctbal"], 9000))))),
                )

            c.for_each(select(w.nation).where(X.eq(w.nation["n_regionkey"], r["r_regionkey"])), nation, "nation")

        ctx.for_each(select(w.region), region, "region")

    return routines.routine("nested", {}, body)(w.store)


query("fn_for_each_nested", "SELECT r_name AS region, n_name AS nation, c_custkey AS key FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE CASE WHEN n_name LIKE 'A%' THEN c_acctbal < 0 ELSE c_acctbal > 9000 END")(_nested)


def _return_insert(w: World) -> DataFrame:
    def body(ctx: routines.Body, shift: X.Expr) -> None:
        nation = _nation(w)
        ctx.return_query(routines.Change("insert", nation, set=(("n_nationkey", shift),)))
        ctx.for_each(select(w.region), lambda c, r: c.return_query(routines.Change("insert", nation, set=(("n_nationkey", r["r_regionkey"]), ("n_name", r["r_name"])))), "region")

    return routines.routine("add", {"shift": "numeric"}, body)(w.store, shift=100)


def _each_row(w: World) -> DataFrame:
    """Every nation's round looks up its region, which must be there, and its richest customer, who may not be."""

    def body(ctx: routines.Body) -> None:
        def one(c: routines.Body, n: dict[str, X.Expr]) -> None:
            region = c.row(select(w.region).where(X.eq(w.region["r_regionkey"], n["n_regionkey"])), "area")
            best = c.row_or_null(select(w.customer).where(X.and_(X.eq(w.customer["c_nationkey"], n["n_nationkey"]), X.gt(w.customer["c_acctbal"], 9500))).order_by((w.customer["c_acctbal"], "desc"), w.customer["c_custkey"]).limit(1), "best")
            c.return_query(select({"s_suppkey": w.supplier["s_suppkey"], "r_name": region["r_name"], "c_name": best["c_name"]}, w.supplier).where(X.eq(w.supplier["s_nationkey"], n["n_nationkey"])))

        ctx.for_each(select(w.nation), one, "n")

    return routines.routine("best_of", {}, body)(w.store)


query(
    "fn_for_each_row",
    """SELECT s_suppkey, r_name, c_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9500 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1) b ON b.c_nationkey = n_nationkey""",
)(_each_row)


def _each_update(w: World) -> DataFrame:
    """Orders give their customers their priority as segment, one after the other by date."""

    def body(ctx: routines.Body) -> None:
        rounds = select(w.orders).order_by(w.orders["o_orderdate"], w.orders["o_orderkey"])
        ctx.for_each(rounds, lambda c, o: c.return_query(routines.Change("update", w.customer, X.eq(w.customer["c_custkey"], o["o_custkey"]), (("c_mktsegment", o["o_orderpriority"]),))), "o")

    return routines.routine("follow", {}, body, returns=w.customer)(w.store).select("c_custkey", "c_mktsegment")


query("fn_for_each_update", "SELECT o_custkey AS c_custkey, o_orderpriority AS c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) = 1")(_each_update)


def _each_delete(w: World) -> DataFrame:
    def body(ctx: routines.Body) -> None:
        ctx.for_each(select(w.customer).where(X.lt(w.customer["c_acctbal"], 0)), lambda c, r: c.return_query(routines.Change("delete", w.orders, X.eq(w.orders["o_custkey"], r["c_custkey"]))), "r")

    return routines.routine("forget", {}, body, returns=w.orders)(w.store).select("o_orderkey", "o_custkey")


query("fn_for_each_delete", "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")(_each_delete)
query("fn_return_insert", "SELECT 100 AS n_nationkey, 'unnamed' AS n_name, NULL::INTEGER AS n_regionkey UNION ALL SELECT r_regionkey, r_name, NULL FROM region")(_return_insert)
query("fn_return_dml", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT o_orderkey, 'Q' FROM orders WHERE o_orderstatus = 'P'")(_return_dml)


def _depth_trigger(w: World, **more: object) -> routines.Trigger:
    """Orders above 300000 need a customer of good standing."""
    rule = X.and_(X.gt(X.local("new.o_totalprice"), 300000), X.lt(X.local("row.c_acctbal"), 0))
    return routines.Trigger("good_standing", w.orders, ("insert", "update"), ("o_totalprice",), (w.customer, (("c_custkey", "o_custkey"),)), ((rule, "order % of customer % is too large", (X.local("new.o_orderkey"), X.local("row.c_name"))),))


query("trigger_validate", "SELECT o_orderkey, 'order ' || o_orderkey || ' of customer ' || c_name || ' is too large' AS message FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000 AND c_acctbal < 0")(
    lambda w: _depth_trigger(w).refused(w.rows("orders"), w.store).select("o_orderkey", "message")
)


def _good_orders(w: World) -> DataFrame:
    """All orders written again under new keys, through a trigger that leaves out those of customers in debt and refuses nothing here."""

    def body(ctx: routines.Body, new: dict[str, X.Expr], old: dict[str, X.Expr]) -> None:
        customer = ctx.row_or_null(select(w.customer).where(X.eq(w.customer["c_custkey"], new["o_custkey"])), "customer")
        ctx.if_((X.is_null(customer["c_custkey"]), lambda c: c.raise_("order % has no customer", new["o_orderkey"])), (X.lt(customer["c_acctbal"], 0), lambda c: c.return_row(None)))
        ctx.return_row("new")

    again = w.rows("orders").withColumn("o_orderkey", F.expr("o_orderkey + 1000000000"))
    keyed = table("w", "orders", {n: c if n != "o_orderkey" else column("bigint").primary_key() for n, c in w.orders.columns})
    return writes.insert(keyed, again, w.store, [routines.trigger("in_credit", keyed, ("insert",), body)]).returned.select("o_orderkey", "o_custkey")


query("trigger_write", "SELECT o_orderkey + 1000000000 AS o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT coalesce(c_acctbal < 0, false)")(_good_orders)
def _keyed(w: World, on_delete: str = "cascade", on_update: str = "cascade", **more: object) -> tuple[Table, Table, Table, Store]:
    """Customers, their orders and these orders' line items, with keys between them."""
    keyed = lambda t, key: {n: c.primary_key() if n == key else c for n, c in t.columns}
    customer = table("w", "customer", keyed(w.customer, "c_custkey"))
    orders = table("w", "orders", keyed(w.orders, "o_orderkey"), foreign_keys=(ForeignKey(("o_custkey",), customer.key, ("c_custkey",), on_delete, on_update),), **more)
    lines = table("w", "lineitem", dict(w.lineitem.columns), foreign_keys=(ForeignKey(("l_orderkey",), orders.key, ("o_orderkey",), "cascade", "cascade"),))
    store = Store(w.spark)
    for t in (customer, orders, lines):
        store.bind(t, w.rows(t.name))
    return customer, orders, lines, store


def _delete_debtors(w: World, on_delete: str) -> writes.changes.Change:
    customer, _, _, store = _keyed(w, on_delete)
    return writes.delete(customer, X.lt(customer["c_acctbal"], 0), store)


query("write_delete_cascade", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)")(
    lambda w: _delete_debtors(w, "cascade").others["w", "lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
)
query("write_delete_set_null", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")(
    lambda w: _delete_debtors(w, "set null").others["w", "orders"].select("o_orderkey", "o_custkey")
)


def _outcome(w: World, act: Callable[[], object]) -> str:
    try:
        act()
    except DeclarationError as e:
        return e.code
    return "done"


def _restrict(w: World) -> DataFrame:
    """What becomes of deleting debtors, and of customers that nobody has heard of, under restrict and no action."""
    rows = []
    for action in ("restrict", "no action"):
        customer, _, _, store = _keyed(w, action)
        rows.append((action, "debtors", _outcome(w, lambda: _delete_debtors(w, action))))  # noqa: B023
        rows.append((action, "strangers", _outcome(w, lambda: writes.delete(customer, X.and_(X.is_null(customer["c_name"]), X.lt(customer["c_acctbal"], 0)), store))))  # noqa: B023
    return w.spark.createDataFrame(rows, "action string, who string, outcome string")


query(
    "write_restrict",
    """WITH w AS (SELECT 'debtors' AS who, EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0) AS held
  UNION ALL SELECT 'strangers', EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 AND c_name IS NULL))
SELECT a AS action, who, CASE WHEN held THEN 'still-referenced' ELSE 'done' END AS outcome FROM w, (VALUES ('restrict'), ('no action')) x(a)""",
)(_restrict)


def _moved_keys(w: World) -> DataFrame:
    customer, _, _, store = _keyed(w)
    done = writes.update(customer, {"c_custkey": X.sql("{} + 1000000", customer["c_custkey"])}, X.lt(customer["c_acctbal"], 0), store)
    return done.others["w", "orders"].select("o_orderkey", "o_custkey")


query("write_update_cascade", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")(_moved_keys)


def _bad_batch(w: World) -> DataFrame:
    """All orders once more, some under new keys, against orders that have six constraints."""
    more = {"checks": (Check("dear", X.gt(w.orders["o_totalprice"], 5000)),), "indexes": (Index((("o_custkey", "asc", None), ("o_orderdate", "asc", None), ("o_totalprice", "asc", None)), unique=True),)}
    _, orders, _, store = _keyed(w, **more)
    shifted = F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey") + 1000000000).otherwise(F.col("o_orderkey"))
    batch = w.rows("orders").select(*(shifted.alias(n) if n == "o_orderkey" else F.expr("o_custkey + IF(o_totalprice > 400000, 1000000000, 0)").alias(n) if n == "o_custkey" else F.expr("nullif(o_orderstatus, 'P')").alias(n) if n == "o_orderstatus" else F.col(n) for n in orders.names()))
    required = table("w", "orders", {n: c.not_null() if n == "o_orderstatus" else c for n, c in orders.columns}, foreign_keys=orders.foreign_keys, **more)
    return w.spark.createDataFrame(batches.batch_violations(required, batch, store.read(orders.key), store), "constraint string, n long")


query(
    "write_batch_check",
    """WITH b AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_totalprice > 400000 THEN o_custkey + 1000000000 ELSE o_custkey END AS o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders),
k AS (SELECT o_orderkey AS k, count(*) AS n FROM b GROUP BY 1), i AS (SELECT o_custkey, o_orderdate, o_totalprice, count(*) AS n FROM b GROUP BY 1, 2, 3),
r AS (
  SELECT 'not null' AS "constraint", count(*) AS n FROM b WHERE o_orderkey IS NULL OR o_orderstatus IS NULL
  UNION ALL SELECT 'check dear', count(*) FROM b WHERE NOT coalesce(o_totalprice > 5000, true)
  UNION ALL SELECT 'primary key', count(*) FROM k WHERE n > 1 OR k IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'index o_custkey, o_orderdate, o_totalprice', count(*) FROM i WHERE n > 1 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = i.o_custkey AND o.o_orderdate = i.o_orderdate AND o.o_totalprice = i.o_totalprice)
  UNION ALL SELECT 'foreign key o_custkey', count(DISTINCT o_custkey) FROM b WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
SELECT * FROM r WHERE n > 0""",
)(_bad_batch)


def _hidden(w: World) -> DataFrame:
    """An update that every row may get, by one who may read open orders only."""
    session = _session(w, [_p("change", X.literal(True), "update"), _p("look", X.eq(w.orders["o_orderstatus"], "O"))])
    return writes.update(w.orders, {"o_orderpriority": "later"}, X.gt(w.orders["o_totalprice"], 100000), session).state.select("o_orderkey", "o_orderpriority")


query("policy_update_hidden", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND o_orderstatus = 'O' THEN 'later' ELSE o_orderpriority END AS o_orderpriority FROM orders")(_hidden)
query("fn_raise", "SELECT c_custkey, 'customer ' || c_custkey || ' owes' AS message FROM customer WHERE c_acctbal < -500")(
    lambda w: routines.Trigger("debt", w.customer, ("insert",), rules=((X.lt(X.local("new.c_acctbal"), -500), "customer % owes", (X.local("new.c_custkey"),)),)).refused(w.rows("customer"), w.store).select("c_custkey", "message")
)

# ---- catalogs --------------------------------------------------------------


query("alter_apply", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS label, 5 AS level FROM nation")(
    lambda w: snapshot.apply_table_change(
        w.rows("nation"),
        snapshot.table_node(_nation(w)),
        snapshot.table_node(table("w", "nation", {"n_nationkey": column("bigint").primary_key(), "label": column("text").not_null(), "level": column("integer").not_null().default(5)})),
        {"n_name": "label"},
    )
)


# Catalogs of some thousand generated objects: node and SQL are made from the same rows, parts of the driver's tables.

_CATALOG = """
SELECT 'enum' AS kind, 'app.e' || p_partkey AS identity, p_partkey AS k, p_size AS x FROM part
UNION ALL SELECT 'view', 'app.v' || p_partkey, p_partkey, p_size FROM part
UNION ALL SELECT 'policy', 'app.t.p' || p_partkey, p_partkey, p_size FROM part
UNION ALL SELECT 'grant', 'app.tables.*.r' || p_partkey, p_partkey, p_size FROM part
UNION ALL SELECT 'table', 'app.t' || p_partkey, p_partkey, p_size FROM part
"""


def _objects(w: World) -> DataFrame:
    part = w.rows("part")
    of = {"enum": "app.e", "view": "app.v", "policy": "app.t.p", "grant": "app.tables.*.r", "table": "app.t"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(F.lit(p), F.col("p_partkey")).alias("identity")) for k, p in of.items())))
    return part.select(each.alias("o"), F.col("p_partkey").alias("k"), F.col("p_size").alias("x")).select("o.*", "k", "x")


def _generated(w: World, after: bool) -> DataFrame:
    """A snapshot of them. Before: k not divisible by 5. After: k not divisible by 7, and changed where k is divisible by 3: grown if x is even, else cut."""
    rows = _objects(w).where("k % 7 <> 0" if after else "k % 5 <> 0")
    changed, even = (F.col("k") % 3 == 0) & F.lit(after), F.col("x") % 2 == 0
    values = F.when(changed & even, F.lit('["a","b","c"]')).when(changed, F.lit('["b","c"]')).otherwise(F.lit('["a","b"]'))
    columns = '{"name":"id","type":"bigint","length":[],"dimensions":0,"nullable":false,"primary":true,"unique":false,"default":null}'
    check = F.concat(F.lit('{"condition":'), F.when(changed & even, F.lit("2")).otherwise(F.lit("1")), F.lit(',"name":"c"}'))
    foreign = F.when(changed, F.lit("[]")).otherwise(F.lit('[{"columns":["id"],"name":"t_fk"}]'))
    table_ = F.concat(F.lit(f'{{"checks":['), check, F.lit(f'],"columns":[{columns}],"foreign_keys":'), foreign, F.lit(',"indexes":[]}'))
    node = (
        F.when(F.col("kind") == "enum", F.concat(F.lit('{"values":'), values, F.lit("}")))
        .when(F.col("kind") == "view", F.concat(F.lit('{"columns":'), values, F.lit(',"query":{},"security_invoker":true}')))
        .when(F.col("kind") == "policy", F.concat(F.lit('{"check":null,"command":"all","restrictive":false,"roles":'), values, F.lit(',"using":1}')))
        .when(F.col("kind") == "grant", F.concat(F.lit('{"privileges":'), values, F.lit("}")))
        .otherwise(table_)
    )
    return rows.select("kind", "identity", node.alias("node"))


_MEANS = f"""WITH o AS ({_CATALOG}), d AS (
  SELECT kind, identity, k, x, CASE WHEN k % 5 = 0 THEN 'create' WHEN k % 7 = 0 THEN 'drop' ELSE 'alter' END AS operation FROM o
  WHERE k % 5 = 0 AND k % 7 <> 0 OR k % 7 = 0 AND k % 5 <> 0 OR k % 5 <> 0 AND k % 7 <> 0 AND k % 3 = 0)
SELECT kind, identity, operation, CASE WHEN operation <> 'alter' THEN operation WHEN kind = 'policy' THEN 'recreate'
  WHEN kind = 'enum' THEN CASE WHEN x % 2 = 0 THEN 'alter' ELSE 'recreate' END WHEN kind = 'view' THEN CASE WHEN x % 2 = 0 THEN 'replace' ELSE 'recreate' END ELSE 'alter' END AS means FROM d"""
query("catalog_meaning", _MEANS)(lambda w: kinds.meaning(snapshot.diff(_generated(w, False), _generated(w, True))).select("kind", "identity", "operation", "means"))
query(
    "alter_steps",
    f"""WITH t AS (SELECT identity, x FROM ({_CATALOG}) WHERE kind = 'table' AND k % 5 <> 0 AND k % 7 <> 0 AND k % 3 = 0)
SELECT identity, 0 AS stage, 'drop' AS action, 'foreign key' AS member, 't_fk' AS name FROM t
UNION ALL SELECT identity, 1, unnest(['drop', 'add']), 'check', 'c' FROM t WHERE x % 2 = 0""",
)(lambda w: kinds.alter_steps(_generated(w, False), _generated(w, True)))
query(
    "privilege_changes",
    f"""WITH g AS (SELECT identity, k, x FROM ({_CATALOG}) WHERE kind = 'grant'),
n AS (SELECT identity, CASE WHEN k % 5 <> 0 THEN ['a', 'b'] ELSE [] END AS old, CASE WHEN k % 7 = 0 THEN [] WHEN k % 3 <> 0 THEN ['a', 'b'] WHEN x % 2 = 0 THEN ['a', 'b', 'c'] ELSE ['b', 'c'] END AS new FROM g WHERE k % 5 <> 0 OR k % 7 <> 0)
SELECT identity, array_to_string(list_filter(new, lambda p: NOT list_contains(old, p)), ',') AS granted, array_to_string(list_filter(old, lambda p: NOT list_contains(new, p)), ',') AS revoked FROM n WHERE old <> new""",
)(lambda w: _flat(kinds.privilege_changes(_generated(w, False), _generated(w, True)), "granted", "revoked"))
query("snapshot_required_keys", f"SELECT kind, identity, CASE kind WHEN 'enum' THEN 'values' WHEN 'grant' THEN 'privileges' WHEN 'table' THEN 'checks,columns' WHEN 'view' THEN 'columns' ELSE 'check' END AS missing FROM ({_CATALOG}) WHERE k % 7 <> 0 AND x = 1")(
    lambda w: _flat(kinds.missing_keys(_generated(w, True).join(_objects(w).where("x = 1").select("kind", "identity"), ["kind", "identity"]).withColumn("node", F.regexp_replace("node", '"(values|privileges|checks|columns|check)":', '"gone":'))).select("kind", "identity", "missing"), "missing")
)


# Renames over a catalog of several rows for each part: templates give Spark the rows before, and SQL those after.

_REF = '{"args":["app","%t","%c"],"family":"numeric","op":"ref"}'
_IS = '{"args":[' + _REF + ',{"args":["number",1],"family":"numeric","op":"literal"}],"family":"boolean","op":"gt"}'
_COL = '{"default":null,"dimensions":0,"length":[],"name":"%c","nullable":true,"primary":false,"type":"bigint","unique":false}'
_KEY = _COL.replace('"%c"', '"id"').replace('"nullable":true,"primary":false', '"nullable":false,"primary":true')
_TEMPLATES = {
    "table": ("app.%t", '{"checks":[{"condition":' + _IS + ',"name":"some"}],"columns":[' + _KEY + "," + _COL + '],"foreign_keys":[{"columns":["%c"],"name":"%t_%c_fk","on_delete":"cascade","on_update":"no action","target":["app","%t"],"target_columns":["id"]}],"indexes":[{"columns":[["%c","asc",null]],"name":"%t_%c_idx","unique":false,"where":null},{"columns":[["id","asc",null]],"name":"own%k","unique":true,"where":' + _IS + "}]}"),
    "sequence": ("app.%t_%c_seq", '{"table":"%t"}'),
    "rls": ("app.%t", '{"force":true}'),
    "policy": ("app.%t.look", '{"check":null,"command":"select","restrictive":false,"roles":["a"],"using":' + _IS + "}"),
    "trigger": ("app.%t.watch", '{"events":["update"],"function":"%t_watch","table":"app.%t","timing":"before","update_of":["%c"]}'),
    "grant": ("app.tables.%t.reader", '{"privileges":["select"]}'),
    "view": ("app.v%k", '{"columns":["x"],"query":{"base":["app","%t"],"condition":' + _IS + ',"count":null,"joins":[],"order":[],"projection":[["x",' + _REF + ']]},"security_invoker":true}'),
}


def _filled(template: str, sql: bool, t: str, c: str, k: str) -> str | Column:
    """The template with columns in its gaps, as a Spark column or as SQL."""
    values = {"%t": t, "%c": c, "%k": k}
    parts = [x for x in re.split("(%[tck])", template) if x]
    if sql:
        return " || ".join(f"({values[x]})::VARCHAR" if x in values else "'" + x.replace("'", "''") + "'" for x in parts)
    return F.concat(*(F.expr(values[x]).cast("string") if x in values else F.lit(x) for x in parts))


def _mentioned(w: World) -> DataFrame:
    each = [F.struct(F.lit(kind).alias("kind"), _filled(i, False, "'t' || p_partkey", "'c'", "p_partkey").alias("identity"), _filled(n, False, "'t' || p_partkey", "'c'", "p_partkey").alias("node")) for kind, (i, n) in _TEMPLATES.items()]
    return w.rows("part").select(F.inline(F.array(*each)))


def _part_renames(w: World) -> DataFrame:
    """Tables of parts of even size get a new name, and of parts of sizes that 3 divides the column does."""
    of = F.array(F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("table").alias("of"), F.expr("'t' || p_partkey").alias("old"), F.expr("'r' || p_partkey").alias("new"))), F.when(F.col("p_size") % 3 == 0, F.struct(F.lit("column").alias("of"), F.lit("c").alias("old"), F.expr("'d' || p_size").alias("new"))))
    return w.rows("part").select(F.expr("'app.t' || p_partkey").alias("identity"), F.explode(of).alias("r")).where("r is not null").select("r.of", "identity", "r.old", "r.new")


_NEW_T, _NEW_C = "CASE WHEN p_size % 2 = 0 THEN 'r' ELSE 't' END || p_partkey", "CASE WHEN p_size % 3 = 0 THEN 'd' || p_size ELSE 'c' END"
query("rename_cascade", " UNION ALL ".join(f"SELECT '{kind}' AS kind, {_filled(i, True, _NEW_T, _NEW_C, 'p_partkey')} AS identity, md5({_filled(n, True, _NEW_T, _NEW_C, 'p_partkey')}) AS node FROM part" for kind, (i, n) in _TEMPLATES.items()))(
    lambda w: renames.renamed(_mentioned(w), _part_renames(w)).select("kind", "identity", F.md5("node").alias("node"))
)


def _one_column(w: World, t: str, column_: str, where: str) -> DataFrame:
    """Tables of parts with a check that holds the part's number for odd sizes, so their definitions differ, and its size for even ones."""
    mark = "CASE WHEN p_size % 2 = 1 THEN 'k' || p_partkey ELSE 's' || p_size END"
    node = _filled('{"checks":["%k"],"columns":[' + _KEY + "," + _COL + '],"foreign_keys":[],"indexes":[]}', False, "''", column_, mark)
    return w.rows("part").where(where).select(F.lit("table").alias("kind"), F.expr(f"'app.' || {t}").alias("identity"), node.alias("node"))


def _planned(w: World) -> DataFrame:
    """Before: t and the part's number. After: those that 7 divides are r and the number (named for sizes over 45), those that 11 divides are gone (meant for sizes over 25), of others those that 5 divides have another column."""
    before = _one_column(w, "'t' || p_partkey", "'c'", "true")
    after = _one_column(w, "CASE WHEN p_partkey % 7 = 0 THEN 'r' ELSE 't' END || p_partkey", "CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 = 0 THEN 'd' ELSE 'c' END", "p_partkey % 7 = 0 or p_partkey % 11 > 0")
    part = w.rows("part")
    named = part.where("p_partkey % 7 = 0 and p_size > 45").selectExpr("'table' as of", "'app' as identity", "'t' || p_partkey as old", "'r' || p_partkey as new").union(part.where("p_partkey % 7 > 0 and p_partkey % 11 > 0 and p_size = 1").selectExpr("'column'", "'app.t' || p_partkey", "'gone'", "'d'"))
    drops = part.where("p_partkey % 7 > 0 and p_partkey % 11 = 0 and p_size > 25").selectExpr("'table' as of", "'app' as identity", "'t' || p_partkey as name")
    return renames.plan(before, after, named, drops)


query(
    "rename_plan",
    """WITH p AS (SELECT p_partkey AS k, p_size AS x, CASE WHEN p_size % 2 = 1 THEN 'k' || p_partkey ELSE 's' || p_size END AS d FROM part),
lost AS (SELECT * FROM p WHERE k % 7 = 0 AND x <= 45 OR k % 7 > 0 AND k % 11 = 0 AND x <= 25), came AS (SELECT * FROM p WHERE k % 7 = 0 AND x <= 45),
g AS (SELECT d, count(*) AS n FROM lost GROUP BY d), h AS (SELECT d, count(*) AS n FROM came GROUP BY d)
SELECT 'table' AS of, 'app' AS identity, 't' || lost.k AS old, 'r' || came.k AS new, CASE WHEN g.n = 1 AND h.n = 1 THEN 'matched' ELSE 'ambiguous' END AS verdict FROM lost JOIN came USING (d) JOIN g USING (d) JOIN h USING (d)
UNION ALL SELECT 'table', 'app', 't' || k, NULL, 'unconfirmed' FROM lost WHERE d NOT IN (SELECT d FROM came)
UNION ALL SELECT 'table', 'app', 't' || k, 'r' || k, 'named' FROM p WHERE k % 7 = 0 AND x > 45
UNION ALL SELECT 'table', 'app', 't' || k, NULL, 'confirmed' FROM p WHERE k % 7 > 0 AND k % 11 = 0 AND x > 25
UNION ALL SELECT 'column', 'app.t' || k, 'c', 'd', 'matched' FROM p WHERE k % 7 > 0 AND k % 11 > 0 AND k % 5 = 0
UNION ALL SELECT 'column', 'app.t' || k, 'gone', 'd', 'unknown' FROM p WHERE k % 7 > 0 AND k % 11 > 0 AND x = 1""",
)(_planned)


from . import generated  # noqa: E402, F401 - registers its queries
