"""Declarations, expressions, plans and lineage without the driver's tables."""

import datetime as dt
import json

import pytest

from terrane.errors import DeclarationError
from terrane.functions import expressions as X
from terrane.operators import changes, integrity, routines, security
from terrane.plans import lineage, snapshot
from terrane.plans.query import Select, select
from terrane.sources.catalog import Check, Enum, ForeignKey, Index, Store, Table, column, table
from terrane.streaming import apply as streams


def posts(**more) -> Table:
    return table("app", "posts", {"id": column("integer").primary_key(), "status": column("text").not_null(), "views": column("integer"), "publishedAt": column("timestamp")}, **more)


def fails(code, call):
    with pytest.raises(DeclarationError) as e:
        call()
    assert e.value.code == code and ":" in e.value.site


def test_names_and_types():
    assert posts().names() == ["id", "status", "views", "published_at"]
    fails("bad-name", lambda: table("app", "Posts", {"id": column("integer")}))
    fails("duplicate-column", lambda: table("app", "p", {"aB": column("text"), "a_b": column("text")}))
    fails("bad-default", lambda: column("text").default_now())
    assert column("numeric", 10, 2).spark_type().simpleString() == "decimal(10,2)"
    assert column("text").array().array().spark_type().simpleString() == "array<array<string>>"


def test_operands_are_checked():
    p = posts()
    for op in (X.eq, X.ne, X.gt, X.gte, X.lt, X.lte):
        fails("null-operand", lambda op=op: op(p["views"], None))
        fails("family-mismatch", lambda op=op: op(p["views"], "x"))
    fails("empty-operands", X.and_)
    fails("empty-list", lambda: X.in_array(p["views"], []))
    fails("bad-literal", lambda: X.literal(float("nan")))
    fails("bad-literal", lambda: X.literal([1]))
    fails("bad-limit", lambda: select(p).limit(-1))
    fails("unknown-function", lambda: X.call("drop_everything"))
    X.eq(p["published_at"], dt.datetime(2020, 1, 1))


def test_scope(spark):
    p, other = posts(), table("app", "other", {"id": column("integer")})
    store = Store(spark).bind(p, spark.createDataFrame([], p.struct()))
    fails("foreign-column-ref", lambda: select(p).where(X.eq(other["id"], 1)).frame(store))
    fails("foreign-column-ref", lambda: posts(checks=(Check("c", X.eq(other["id"], 1)),)))
    fails("unbound-table", lambda: select(other).frame(store))


def test_codec_and_rename():
    p = posts()
    q = select(p).where(X.and_(X.eq(p["status"], "a'b\\"), X.exists(select(p).where(X.gt(p["views"], 3))))).order_by((p["views"], "desc")).limit(3)
    assert Select.decoded(json.loads(json.dumps(q.encoded()))) == q
    e = X.retarget(X.exists(q), {("app", "posts"): ("app", "articles")}, {("app", "posts", "views"): "reads"})
    refs = {x.args for x in X.walk(e) if x.op == "ref"}
    assert ("app", "articles", "reads") in refs and not any("posts" in r for r in refs)


def test_template_values_stay_values(spark):
    p = posts()
    store = Store(spark).bind(p, spark.createDataFrame([(1, "it's \\ {x}", 1, None)], p.struct()))
    found = select(p).where(X.sql("{} = {}", p["status"], "it's \\ {x}", family="boolean")).frame(store).count()
    assert found == 1
    assert select(p).where(X.sql("{} = {}", p["status"], "' or true or '", family="boolean")).frame(store).count() == 0


def test_second_where_replaces(spark):
    p = posts()
    store = Store(spark).bind(p, spark.createDataFrame([(1, "a", 1, None), (2, "b", None, None)], p.struct()))
    assert [r.id for r in select(p).where(X.eq(p["id"], 1)).where(X.eq(p["id"], 2)).frame(store).collect()] == [2]
    rows = select(p).order_by((p["views"], "desc")).frame(store).collect()
    assert [r.id for r in rows] == [2, 1]
    assert select(p).limit(0).frame(store).count() == 0


def test_changes_validate(spark):
    p = posts()
    store = Store(spark).bind(p, spark.createDataFrame([(1, "a", None, None)], p.struct()))
    fails("no-values", lambda: changes.insert(p, [], store))
    fails("unknown-column", lambda: changes.insert(p, [{"nope": 1}], store))
    fails("empty-set", lambda: changes.update(p, {}, None, store))
    fails("no-conflict-target", lambda: changes.insert_or_skip(p, store.read(p.key), [], ["id"], store))
    # a null condition touches nothing; no condition touches all
    assert changes.update(p, {"status": "z"}, X.gt(p["views"], 0), store).returned.count() == 0
    assert changes.delete(p, None, store).state.count() == 0
    # right-hand sides see the old row
    swapped = changes.update(p, {"views": p["id"], "id": X.literal(9)}, None, store).state.first()
    assert (swapped.id, swapped.views) == (9, 1)


def test_null_keys_never_conflict(spark):
    t = table("app", "t", {"k": column("integer"), "v": column("text")})
    store = Store(spark).bind(t, spark.createDataFrame([(None, "old"), (1, "old")], t.struct()))
    new = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (2, "d"), (2, "e")], t.struct())
    skipped = changes.insert_or_skip(t, new, ["k"], ["v"], store)
    assert sorted(r.v for r in skipped.returned.collect()) == ["a", "b", "d"]
    merged = changes.insert_or_update(t, new, ["k"], {"v": X.local("new_v")}, ["v"], store)
    assert sorted(r.v for r in merged.state.collect()) == ["a", "b", "c", "d", "old"]


def test_violations_and_enforcement(spark):
    status = Enum("app", "status", ("draft", "live"))
    t = table("app", "t", {"id": column("integer").primary_key(), "s": status.column(), "v": column("integer").unique(), "parent": column("integer")}, checks=(), foreign_keys=(ForeignKey(("parent",), ("app", "t"), ("id",)),))
    bad = spark.createDataFrame([(1, "draft", 1, None), (1, "gone", 1, 7), (2, None, None, 1)], "id int, s string, v int, parent int")
    store = Store(spark).bind(t, bad)
    found = {r["constraint"]: r["n"] for r in integrity.violations(t, bad, store).collect()}
    assert found == {"primary key": 1, "unique v": 1, "enum s": 1, "foreign key parent": 1}
    fails("constraint-violated", lambda: integrity.enforce(t, bad, store))
    good = bad.where("v is null").withColumn("parent", bad.parent * 2)
    assert integrity.enforce(t, good, store).count() == 1
    assert t.derived_names() == {"idx": [], "fk": ["t_parent_fk"], "seq": [], "pkey": ["t_pkey"], "key": ["t_v_key"]}


def test_self_reference_cascade(spark):
    t = table("app", "t", {"id": column("integer").primary_key(), "parent": column("integer")}, foreign_keys=(ForeignKey(("parent",), ("app", "t"), ("id",), "cascade"),))
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4)], "id int, parent int")
    store = Store(spark).bind(t, rows)
    left = integrity.delete_cascading([t], t, rows.where("id = 1"), store)[t.key]
    assert sorted(r.id for r in left.collect()) == [4, 5]
    kept = table("app", "t", {"id": column("integer").primary_key(), "parent": column("integer")}, foreign_keys=(ForeignKey(("parent",), ("app", "t"), ("id",), "restrict"),))
    fails("still-referenced", lambda: integrity.delete_cascading([kept], kept, rows.where("id = 1"), store))


def test_foreign_key_rules():
    fails("bad-foreign-key", lambda: posts(foreign_keys=(ForeignKey((), ("app", "x"), ()),)))
    fails("bad-foreign-key", lambda: posts(foreign_keys=(ForeignKey(("nope",), ("app", "x"), ("id",)),)))
    fails("bad-foreign-key", lambda: posts(foreign_keys=(ForeignKey(("id",), ("app", "x"), ("id",), "explode"),)))


def test_policies(spark):
    p = posts()
    own = X.eq(p["views"], X.local("user"))
    fails("bad-policy", lambda: security.Policy("x", "insert", ("a",), own))
    fails("bad-policy", lambda: security.Policy("x", "select", ("a",), None, own))
    fails("bad-policy", lambda: security.Policy("x", "select", (), own))
    fails("duplicate-policy", lambda: security.Protected(p, (security.Policy("x", "select", ("a",), own),) * 2))
    rows = spark.createDataFrame([(1, "Alice", 11, None), (2, "Bob", 22, None)], p.struct())
    store = Store(spark).bind(p, rows)
    guarded = [security.Protected(p, (security.Policy("own", "all", ("member",), own),))]
    for user, name in ((11, "Alice"), (22, "Bob")):
        seen = select(p).frame(security.Session(store, "member", guarded, user=user)).collect()
        assert [r.status for r in seen] == [name]
    assert select(p).frame(security.Session(store, "stranger", guarded, user=11)).count() == 0
    assert select(p).frame(security.Session(store, "admin", guarded, owner=True, user=0)).count() == 2
    assert security.Session(store, "member", guarded, user=11).refused(p, rows).count() == 1


def test_routines(spark):
    p = posts()
    store = Store(spark).bind(p, spark.createDataFrame([(1, "a", 1, None)], p.struct()))
    runs = []

    def moody(ctx):
        runs.append(0)
        ctx.return_query(select(p).limit(len(runs)))

    fails("not-deterministic", lambda: routines.routine("moody", {}, moody))
    fails("bad-message", lambda: routines.Body(set()).raise_("100%% of % and %", 1))
    fails("bad-local", lambda: routines.Body(set()).row(select(p), "select"))
    twice = routines.Body({"x"})
    fails("duplicate-local", lambda: twice.row(select(p), "x"))
    strict = routines.routine("strict", {"k": "numeric"}, lambda ctx, k: (ctx.row(select(p).where(X.eq(p["id"], k)), "one"), ctx.return_query(select(p))))
    assert strict(store, k=1).count() == 1
    fails("not-one-row", lambda: strict(store, k=2))
    stop = routines.routine("stop", {"k": "numeric"}, lambda ctx, k: ctx.raise_("no % at 100%%", k))
    with pytest.raises(DeclarationError, match="no 5 at 100%"):
        stop(store, k=5)


def test_snapshot_rules(tmp_path, spark):
    assert snapshot.fnv1a("") == "811c9dc5" and snapshot.fnv1a("a") == "e40c292c"
    fails("kind-cycle", lambda: snapshot.ranks({"a": ("b",), "b": ("a",)}))
    fails("unknown-kind", lambda: snapshot.ranks({"a": ("b",)}))
    fails("duplicate-object", lambda: snapshot.expand([posts(), posts()]))
    rows = snapshot.expand([posts()])
    assert rows == snapshot.expand([posts()])
    saved = snapshot.snapshot(spark, rows)
    snapshot.save(saved, f"{tmp_path}/s")
    assert snapshot.diff(saved, snapshot.load(spark, f"{tmp_path}/s")).count() == 0


def test_rename_reaches_everything():
    users = table("app", "users", {"id": column("serial").primary_key()})
    p = posts(indexes=(Index((("views", "desc", None),), where=X.gt(posts()["views"], 1)),), checks=(Check("some", X.gte(posts()["views"], 0)),), foreign_keys=(ForeignKey(("views",), ("app", "users"), ("id",)),))
    renames = [snapshot.Rename("table", "app.users", "users", "members"), snapshot.Rename("column", "app.users", "id", "key"), snapshot.Rename("column", "app.posts", "views", "reads")]
    after = {i: json.loads(n) for _, i, n in snapshot.apply_renames(snapshot.expand([users, p]), renames)}
    node = after["app.posts"]
    assert node["indexes"][0]["name"] == "posts_reads_idx" and node["foreign_keys"][0] | {"name": ""} == {"name": "", "columns": ["reads"], "target": ["app", "members"], "target_columns": ["key"], "on_delete": "no action", "on_update": "no action"}
    assert "views" not in json.dumps(node) and "app.members_key_seq" in after
    fails("unknown-rename", lambda: snapshot.apply_renames(snapshot.expand([p]), [snapshot.Rename("column", "app.posts", "nope", "x")]))


def test_alter_refuses_unique_change(spark):
    a, b = (snapshot.table_node(table("app", "t", {"k": c})) for c in (column("text"), column("text").unique()))
    fails("unique-changed", lambda: snapshot.apply_table_change(spark.range(1).selectExpr("'x' as k"), a, b))


def test_renumber():
    group = [("003_b.sql", "h2", "h3"), ("003_a.sql", "h1", "h2"), ("003_c.sql", "h3", "h4")]
    assert lineage.renumber(group, {"003", "004"}) == [("003_b.sql", "005_b.sql"), ("003_c.sql", "006_c.sql")]
    fails("no-chain-order", lambda: lineage.renumber([("003_b.sql", "h2", "h3"), ("003_a.sql", "h8", "h9")], set()))
    assert [lineage.slug(x) for x in (("create", "app.posts"), ("alter", "app.posts"), ("drop", "tags"), None)] == ["add_posts", "alter_posts", "drop_tags", "migration"]


def test_stream(spark, tmp_path):
    p = posts(checks=(Check("some", X.gte(posts()["views"], 0)),))
    spark.createDataFrame([(1, "a", 1, None), (2, "b", -1, None)], p.struct()).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.struct()).parquet(f"{tmp_path}/in")
    guarded = security.Protected(p, (security.Policy("a", "select", ("public",), X.eq(p["status"], X.local("wanted"))),))
    for out, df in (("seen", streams.filtered(stream, guarded, "select", "x", wanted="b")), ("checks", streams.checked(stream, p))):
        q = df.writeStream.format("memory").queryName(out).option("checkpointLocation", f"{tmp_path}/{out}").start()
        q.processAllAvailable()
        q.stop()
    assert [r.id for r in spark.table("seen").collect()] == [2]
    assert sorted((r.id, r.broken) for r in spark.table("checks").collect()) == [(1, []), (2, ["some"])]


def test_serial_numbers_are_unique(spark, tmp_path):
    """Three million rows with a payload column, written and read."""
    from pyspark.sql import functions as F

    t = table("w", "numbered", {"id": column("serial").primary_key(), "k": column("bigint"), "payload": column("text")})
    rows = spark.range(3_000_000).select(F.lit(None).cast("int").alias("id"), F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    old = spark.createDataFrame([(7, 0, "x")], t.struct())
    changes.assign_serials(rows, old, t, ["k"]).write.parquet(f"{tmp_path}/numbered")
    got = spark.read.parquet(f"{tmp_path}/numbered").agg(F.count_distinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(got) == (3_000_000, 8, 3_000_007)


def test_insert_numbers_serials(spark):
    t = table("w", "tags", {"id": column("serial").primary_key(), "label": column("text").default("none")})
    store = Store(spark).bind(t, spark.createDataFrame([(3, "a")], t.struct()))
    out = changes.insert(t, [{"label": "z"}, {"id": 50, "label": "m"}, {}, {"label": "b"}], store)
    assert sorted(map(tuple, out.returned.collect())) == [(4, "z"), (5, "none"), (6, "b"), (50, "m")]
    assert out.state.count() == 5


def test_upsert_with_json(spark):
    t = table("w", "docs", {"id": column("integer").primary_key(), "body": column("jsonb"), "at": column("integer")})
    make = lambda rows: spark.createDataFrame(rows, "id int, b string, at int").selectExpr("id", "parse_json(b) as body", "at")
    store = Store(spark).bind(t, make([(1, '{"a": 1}', 1)]))
    new = make([(1, '{"a": 2}', 2), (2, '{"b": 2}', 2), (2, '{"b": 1}', 1)])
    skip = changes.insert_or_skip(t, new, ["id"], ["at"], store).state
    assert sorted(map(tuple, skip.selectExpr("id", "to_json(body)").collect())) == [(1, '{"a":1}'), (2, '{"b":1}')]
    done = changes.insert_or_update(t, new, ["id"], {"body": X.local("new_body")}, ["at"], store).state
    assert sorted(map(tuple, done.selectExpr("id", "to_json(body)").collect())) == [(1, '{"a":2}'), (2, '{"b":1}')]


def blog(spark):
    posts_ = table("app", "posts", {"id": column("integer").primary_key(), "slug": column("text"), "published": column("boolean")})
    comments = table("app", "comments", {"id": column("serial").primary_key(), "post_id": column("integer").not_null(), "parent_id": column("integer"), "body": column("text").not_null()})
    store = Store(spark).bind(posts_, spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", None)], posts_.struct()))
    store.bind(comments, spark.createDataFrame([(1, 1, None, "root"), (2, 1, 1, "reply")], comments.struct()))
    return posts_, comments, store


def test_trigger_bodies_and_writes(spark):
    from terrane.operators import writes

    posts_, comments, store = blog(spark)

    def depth(ctx, new, old):
        post = ctx.row(select(posts_).where(X.eq(posts_["id"], new["post_id"])), "post")
        ctx.if_((X.not_(X.coalesce(post["published"], False)), lambda c: c.return_row(None)))
        parent = ctx.row_or_null(select(comments).where(X.eq(comments["id"], new["parent_id"])), "parent")
        ctx.if_((X.is_not_null(parent["parent_id"]), lambda c: c.raise_("% answers an answer", new["body"])), (None, lambda c: c.return_row("new")))

    rule = routines.trigger("depth", comments, ("insert", "update"), depth, update_of=("parent_id",))
    frame = lambda rows: spark.createDataFrame(rows, "id int, post_id int, parent_id int, body string")
    done = writes.insert(comments, frame([(None, 1, None, "n1"), (None, 1, 1, "n2"), (None, 2, None, "hidden"), (9, 3, None, "draft")]), store, [rule], ["body"])
    assert sorted(r.body for r in done.returned.collect()) == ["n1", "n2"] and len({r.id for r in done.state.collect()}) == 4
    assert done.state.count() == 4
    fails("raised", lambda: writes.insert(comments, frame([(None, 1, 2, "deep")]), store, [rule]))
    fails("raised", lambda: writes.insert(comments, frame([(None, 77, None, "no post")]), store, [rule]))
    fails("constraint-violated", lambda: writes.insert(comments, frame([(1, 1, None, "same id")]), store, [rule]))
    # an update fires for the named column only, sees old and new, and leaves a row as it was
    assert {r.body for r in writes.update(comments, {"body": "x"}, None, store, [rule]).state.collect()} == {"x"}
    fails("raised", lambda: writes.update(comments, {"parentId": 2}, X.eq(comments["id"], 1), store, [rule]))

    def frozen(ctx, new, old):
        ctx.if_((X.eq(old["body"], "root"), lambda c: c.return_row(None)), (None, lambda c: c.return_row("new")))

    keep = routines.trigger("frozen", comments, ("update",), frozen)
    assert {r.id: r.body for r in writes.update(comments, {"body": "y"}, None, store, [keep]).state.collect()} == {1: "root", 2: "y"}
    spare = routines.trigger("spare", comments, ("delete",), lambda ctx, new, old: ctx.if_((X.eq(old["id"], 1), lambda c: c.return_row(None)), (None, lambda c: c.return_row("old"))))
    assert [r.id for r in writes.delete(comments, None, store, [spare]).state.collect()] == [1]
    fails("raised", lambda: writes.delete(comments, None, store, [routines.trigger("no", comments, ("delete",), lambda ctx, new, old: ctx.raise_("never"), timing="after")]))
    fails("raised", lambda: writes.insert(comments, frame([(None, 1, None, "q")]), store, [routines.trigger("open", comments, ("insert",), lambda ctx, new, old: ctx.if_((X.literal(False), lambda c: c.return_row()))), ]))
    # policies hold for what is written
    session = security.Session(store, "user", [security.Protected(comments, (security.Policy("own", "all", ("public",), using=X.eq(comments["post_id"], X.local("mine"))),))], mine=1)
    assert writes.insert(comments, frame([(None, 1, None, "ok")]), session).returned.count() == 1
    fails("policy-violated", lambda: writes.insert(comments, frame([(None, 2, None, "other")]), session))
    other = security.Session(store, "user", list(session.protected.values()), mine=2)
    assert writes.update(comments, {"body": "z"}, None, other).returned.count() == 0 and writes.delete(comments, None, other).state.count() == 2


def family(spark, **actions):
    """Parents, their children, these children's toys, and a tree."""
    parent = table("app", "parent", {"id": column("integer").primary_key(), "name": column("text")})
    child = table("app", "child", {"id": column("integer").primary_key(), "pid": column("integer").default(1)}, foreign_keys=(ForeignKey(("pid",), parent.key, ("id",), actions.get("on_delete", "cascade"), actions.get("on_update", "cascade")),))
    toy = table("app", "toy", {"cid": column("integer").not_null()}, foreign_keys=(ForeignKey(("cid",), child.key, ("id",), actions.get("toys", "cascade")),))
    tree = table("app", "tree", {"id": column("integer").primary_key(), "up": column("integer")}, foreign_keys=(ForeignKey(("up",), ("app", "tree"), ("id",), "cascade", "cascade"),))
    rows = {parent: [(1, "a"), (2, "b"), (3, "c")], child: [(10, 1), (20, 2), (21, 2), (30, None)], toy: [(10,), (20,)], tree: [(1, None), (2, 1), (3, 2), (4, None)]}
    store = Store(spark)
    for t, r in rows.items():
        store.bind(t, spark.createDataFrame(r, t.struct()))
    return parent, child, toy, tree, store


def held(done, *keys):
    return [sorted(tuple(r) for r in (done.others[k] if k else done.state).collect()) for k in keys]


def test_foreign_keys_of_others_are_followed(spark):
    from terrane.operators import writes

    parent, child, toy, tree, store = family(spark)
    done = writes.delete(parent, X.eq(parent["id"], 2), store)
    assert held(done, None, child.key, toy.key) == [[(1, "a"), (3, "c")], [(10, 1), (30, None)], [(10,)]]
    assert writes.delete(parent, X.eq(parent["id"], 3), store).others == {}
    done = writes.update(parent, {"id": X.sql("{} + 7", parent["id"])}, None, store)
    assert held(done, child.key) == [[(10, 8), (20, 9), (21, 9), (30, None)]] and toy.key not in done.others
    assert held(writes.delete(tree, X.eq(tree["id"], 1), store), None) == [[(4, None)]]
    assert [(r.id, r.up) for r in writes.update(tree, {"id": X.sql("{} + 10", tree["id"])}, None, store).state.orderBy("id").collect()] == [(11, None), (12, 11), (13, 12), (14, None)]
    # a cascade that is refused further down, and actions that clear a key
    for actions in ({"on_delete": "restrict"}, {"on_delete": "no action"}, {"toys": "restrict"}):
        parent, child, toy, tree, store = family(spark, **actions)
        fails("still-referenced", lambda: writes.delete(parent, X.eq(parent["id"], 2), store))  # noqa: B023
        assert writes.delete(parent, X.eq(parent["id"], 3), store).state.count() == 2
    for action in ("restrict", "no action"):
        parent, child, toy, tree, store = family(spark, on_update=action)
        fails("still-referenced", lambda: writes.update(parent, {"id": 9}, X.eq(parent["id"], 2), store))  # noqa: B023
        assert writes.update(parent, {"name": "z"}, None, store).others == {}
    parent, child, toy, tree, store = family(spark, on_delete="set null")
    assert held(writes.delete(parent, None, store), None, child.key) == [[], [(10, None), (20, None), (21, None), (30, None)]]
    parent, child, toy, tree, store = family(spark, on_delete="set default")
    assert held(writes.delete(parent, X.eq(parent["id"], 2), store), child.key) == [[(10, 1), (20, 1), (21, 1), (30, None)]]
    fails("constraint-violated", lambda: writes.delete(parent, None, store))  # the default is gone as well


def test_keys_that_come_back_block_nothing(spark):
    from terrane.operators import writes

    parent, child, toy, tree, store = family(spark, on_update="no action")
    swap = X.sql("CASE {} WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END", parent["id"])
    assert writes.update(parent, {"id": swap}, None, store).state.count() == 3


def test_batches_are_checked_against_themselves_and_the_rest(spark):
    from terrane.operators import batches, writes

    t = table(
        "app", "t", {"id": column("integer").primary_key(), "a": column("text").not_null(), "b": column("double precision").unique(), "up": column("integer")},
        checks=(Check("short", X.lt(X.call("length", X.ref("app", "t", "a")), 3)),), indexes=(Index((("a", "asc", None),), unique=True, where=X.gt(X.ref("app", "t", "up", "numeric"), 0)),), foreign_keys=(ForeignKey(("up",), ("app", "t"), ("id",)),),
    )
    rest = spark.createDataFrame([(1, "x", 0.0, None), (2, "y", None, 1)], t.struct())
    store = Store(spark).bind(t, rest)
    frame = lambda rows: spark.createDataFrame(rows, "id int, a string, b double, up int")
    bad = frame([(1, "p", -0.0, None), (3, None, 5.0, 9), (3, "long", 5.0, 3), (4, "y", None, 2), (None, "q", None, None)])
    assert dict(batches.batch_violations(t, bad, rest, store)) == {"not null": 2, "primary key": 2, "unique b": 2, "index a": 1, "check short": 1, "foreign key up": 1}
    assert batches.batch_violations(t, frame([(5, "z", 1.0, 6), (6, "w", 2.0, 1)]), rest, store) == []
    # the table is scanned for its keys only, and once
    scans = []
    seen = Store(spark).bind(t, lambda: scans.append(1) or rest)
    assert writes.insert(t, frame([(5, "z", 1.0, None)]), seen).state.count() == 3
    assert len(scans) == 2  # the old rows for their keys; numbering needs none, the new state holds them


def test_updates_reach_what_may_be_read(spark):
    from terrane.operators import writes

    t = table("app", "notes", {"id": column("integer").primary_key(), "owner": column("integer")})
    store = Store(spark).bind(t, spark.createDataFrame([(1, 1), (2, 2)], t.struct()))
    policies = (security.Policy("w", "update", ("public",), using=X.literal(True)), security.Policy("d", "delete", ("public",), using=X.literal(True)), security.Policy("i", "insert", ("public",), with_check=X.literal(True)), security.Policy("r", "select", ("public",), using=X.eq(t["owner"], 1)))
    session = security.Session(store, "user", [security.Protected(t, policies)])
    done = writes.update(t, {"id": X.sql("{} + 10", t["id"])}, None, session)
    assert sorted(tuple(r) for r in done.state.collect()) == [(2, 2), (11, 1)] and [r.id for r in done.returned.collect()] == [11]
    assert [r.id for r in writes.delete(t, None, session).state.collect()] == [2]
    done = writes.insert(t, spark.createDataFrame([(5, 1), (6, 2)], t.struct()), session)
    assert done.state.count() == 4 and [r.id for r in done.returned.collect()] == [5]


def catalog(spark, posts_name, status):
    """Declarations in which one table and one of its columns have these names, as snapshot rows."""
    from terrane.plans import kinds
    from terrane.plans.query import View

    posts_ = table("app", posts_name, {"id": column("serial").primary_key(), status: column("text").not_null()}, indexes=(Index(((status, "asc", None),)),))
    comments = table("app", "comments", {"id": column("integer").primary_key(), "post": column("integer")}, foreign_keys=(ForeignKey(("post",), posts_.key, ("id",)),))
    view = View("app", "live", select({"id": posts_["id"]}, posts_).where(X.exists(select(comments).where(X.eq(comments["post"], posts_["id"])))))

    def body(ctx, new, old):
        post = ctx.row(select(posts_).where(X.eq(posts_["id"], new["id"])), "post")
        ctx.if_((X.eq(post[status], new[status]), lambda c: c.raise_("% is the same", old[status])), (None, lambda c: c.return_row("new")))

    rule = routines.trigger("watch", posts_, ("update",), body, update_of=(status,))
    shielded = security.Protected(comments, (security.Policy("own", "select", ("public",), using=X.exists(select(posts_).where(X.eq(posts_["id"], comments["post"])))),))
    own = security.Protected(posts_, (security.Policy("live", "update", ("public",), using=X.eq(posts_[status], "live")),))
    purge = routines.routine("purge", {"s": "text"}, lambda ctx, s: ctx.return_query(routines.Change("delete", posts_, X.eq(posts_[status], s))))
    grants = [{"schema": "app", "kind": "tables", "object": posts_name, "roles": ["a", "b"], "privileges": ["select"]}, {"schema": "app", "kind": "usage", "roles": ["a"], "privileges": ["usage"]}]
    return kinds.expand(tables=[posts_, comments], views=[view], routines=[("app", purge)], triggers=[rule], protected=[shielded, own], grants=grants)


def test_renames_leave_no_difference(spark):
    from terrane.plans import renames

    before, after = (snapshot.snapshot(spark, catalog(spark, *names)) for names in (("posts", "status"), ("articles", "state")))
    given = spark.createDataFrame([("table", "app.posts", "posts", "articles"), ("column", "app.posts", "status", "state")], renames.RENAMES)
    assert snapshot.diff(before, after).count() > 10
    assert snapshot.diff(renames.renamed(before, given), after).collect() == []
    assert sorted(snapshot.apply_renames(catalog(spark, "posts", "status"), [snapshot.Rename(*r) for r in given.collect()])) == sorted(catalog(spark, "articles", "state"))
    fails("unknown-rename", lambda: renames.renamed(before, spark.createDataFrame([("table", "app.nope", "nope", "x")], renames.RENAMES)))
    fails("unknown-rename", lambda: renames.renamed(before, spark.createDataFrame([("column", "app.posts", "nope", "x")], renames.RENAMES)))


def test_rename_plan_settles(spark):
    from terrane.plans import renames

    make = lambda *tables: snapshot.snapshot(spark, snapshot.expand(tables))
    t = lambda name, *columns: table("app", name, {"id": column("integer").primary_key(), **{c: column("text") for c in columns}})
    before, after = make(t("a", "x"), t("b", "x", "y"), t("c")), make(t("n", "x"), t("b", "z", "y"))
    named = spark.createDataFrame([], "of string, identity string, old string, new string")
    drops = lambda *names: spark.createDataFrame([("table", "app", n) for n in names], "of string, identity string, name string")
    fails("open-rename", lambda: renames.settled(renames.plan(before, after, named, drops())))
    found = renames.settled(renames.plan(before, after, named, drops("c")))
    assert sorted(map(tuple, found.collect())) == [("column", "app.b", "x", "z"), ("table", "app.a", "a", "n")]
    left = snapshot.diff(renames.renamed(before, found), after)
    assert [(r.kind, r.identity, r.operation) for r in left.collect()] == [("table", "app.c", "drop")]


def test_lookups_by_a_whole_key_are_plain_joins(spark):
    posts_, comments, store = blog(spark)
    by = lambda *parts: select(posts_).where(X.and_(*parts) if len(parts) > 1 else parts[0])
    assert routines._unique(by(X.eq(posts_["id"], X.local("x"))), store) and routines._unique(by(X.gt(posts_["slug"], "a"), X.eq(X.local("x"), posts_["id"])), store)
    assert not routines._unique(by(X.gt(posts_["id"], 1)), store) and not routines._unique(by(X.eq(posts_["slug"], "a")), store)
    assert not routines._unique(by(X.or_(X.eq(posts_["id"], 1), X.eq(posts_["id"], 2))), store) and not routines._unique(select(posts_), store)
    rule = routines.trigger("t", comments, ("insert",), lambda ctx, new, old: (ctx.row(select(posts_).where(X.eq(posts_["id"], new["post_id"])), "post"), ctx.return_row("new"))[0])
    batch = spark.createDataFrame([(9, 1, None, "a"), (10, 99, None, "b"), (11, None, None, "c")], comments.struct().simpleString().removeprefix("struct<").removesuffix(">"))
    returned, refused = rule.run(store, batch, "insert")
    assert [r.id for r in returned.collect()] == [9] and sorted(r.id for r in refused.collect()) == [10, 11]
    assert "Window" not in returned._jdf.queryExecution().toString() and "min_by" not in returned._jdf.queryExecution().toString()


def test_lookups_and_changes_in_loops(spark):
    posts_, comments, store = blog(spark)

    def run(record, returns=None, base=comments):
        query = select(base).order_by((base["id"], "desc"))
        return routines.routine("f", {}, lambda ctx: ctx.for_each(query, record, "c"), returns=returns)(store)

    def strict(kind):
        def record(c, r):
            post = getattr(c, kind)(select(posts_).where(X.eq(posts_["id"], r["parent_id"])), "post")
            c.return_query(select({"slug": post["slug"], "id": r["id"]}, posts_).where(X.eq(posts_["id"], r["post_id"])))

        return record

    assert sorted((r.id, r.slug) for r in run(strict("row_or_null")).collect()) == [(1, None), (2, "a")]
    fails("not-one-row", lambda: run(strict("row")))
    # both comments change post 1; they go by falling id, so the last round is comment 1's
    change = lambda where, **set_: (lambda c, r: c.return_query(routines.Change("update", posts_, where(r), tuple((k, r[v]) for k, v in set_.items()))))
    done = run(change(lambda r: X.eq(posts_["id"], r["post_id"]), slug="body"), posts_)
    assert [(r.id, r.slug) for r in done.collect()] == [(1, "root")]
    fails("bad-body", lambda: run(change(lambda r: X.eq(posts_["slug"], r["body"]), slug="body")))
    gone = run(lambda c, r: c.return_query(routines.Change("delete", posts_, X.eq(posts_["id"], r["post_id"]))), posts_)
    assert [r.id for r in gone.collect()] == [1]


def test_declared_results(spark):
    posts_, comments, store = blog(spark)
    whole = lambda ctx: ctx.return_query(select(posts_))
    assert routines.routine("f", {}, whole, returns=posts_)(store).count() == 3
    fails("bad-result", lambda: routines.routine("f", {}, whole, returns=comments))
    fails("bad-result", lambda: routines.routine("f", {}, whole, returns="integer"))
    fails("bad-result", lambda: routines.routine("f", {}, whole, returns="nothing"))
    one = lambda n: routines.routine("top", {}, lambda ctx: ctx.return_query(select({"id": posts_["id"]}, posts_).limit(n)), returns="integer")
    assert one(1)(store).columns == ["top"] and one(1)(store).count() == 1
    fails("bad-result", lambda: one(2)(store))
    assert one(1).signature() == "integer" and routines.routine("f", {}, whole, returns=posts_).signature() == {"setof": ["app", "posts"]}
    for word in ("declare", "record", "cursor", "perform", "exists", "table"):
        fails("bad-local", lambda: routines.routine("f", {}, lambda ctx: ctx.row(select(posts_), word)))  # noqa: B023


def test_targets_of_keys():
    from terrane.plans import kinds

    t = lambda name, fk=None, **columns: table("app", name, {"id": column("integer").primary_key(), **columns}, foreign_keys=() if fk is None else (ForeignKey(("p",), ("app", "a"), (fk,)),))
    a = t("a", x=column("integer"), u=column("text").unique())
    kinds.expand(tables=[a, t("b", "id", p=column("serial"))])
    kinds.expand(tables=[a, t("b", "u", p=column("text"))])
    fails("unknown-target", lambda: kinds.expand(tables=[t("b", "id", p=column("integer"))]))
    fails("unknown-target-column", lambda: kinds.expand(tables=[a, t("b", "nope", p=column("integer"))]))
    fails("target-type", lambda: kinds.expand(tables=[a, t("b", "id", p=column("text"))]))
    fails("target-not-unique", lambda: kinds.expand(tables=[a, t("b", "x", p=column("integer"))]))
    twice = table("app", "c", {"id": column("integer")}, indexes=(Index((("id", "asc", None),)), Index((("id", "desc", None),))))
    fails("duplicate-name", lambda: kinds.expand(tables=[twice]))
    fails("unknown-index-column", lambda: kinds.expand(tables=[table("app", "c", {"id": column("integer")}, indexes=(Index((("no", "asc", None),)),))]))


def test_renamed_tables_are_compared_by_column(spark):
    from terrane.plans import renames

    make = lambda *tables: snapshot.snapshot(spark, snapshot.expand(tables))
    t = lambda name, *columns: table("app", name, {"id": column("integer").primary_key(), **{c: column("text") for c in columns}})
    before, after = make(t("a", "x"), t("b"), t("c")), make(t("n", "y"), t("o"))
    given = lambda *rows: spark.createDataFrame(list(rows), "of string, identity string, old string, new string")
    none = spark.createDataFrame([], "of string, identity string, name string")
    verdicts = lambda *rows: sorted((r.old, r.new, r.verdict) for r in renames.plan(before, after, given(*rows), none).collect())
    # the table's other column is a match under the table's old name
    assert verdicts(("table", "app", "a", "n")) == [("a", "n", "named"), ("b", "o", "ambiguous"), ("c", "o", "ambiguous"), ("x", "y", "matched")]
    assert ("x", "y", "named") in verdicts(("table", "app", "a", "n"), ("column", "app.a", "x", "y"))
    assert [v for v in verdicts(("table", "app", "b", "o"), ("table", "app", "c", "o")) if v[2] == "twice"] == [("b", "o", "twice"), ("c", "o", "twice")]
    fails("open-rename", lambda: renames.settled(renames.plan(before, after, given(("table", "app", "b", "o"), ("table", "app", "c", "o")), none)))


def test_schema_object():
    from terrane.sources.catalog import schema

    app = schema("app")
    t = app.table("posts", {"id": column("integer").primary_key()})
    assert t.key == ("app", "posts") and app.enum("e", "a", "b").values == ("a", "b") and app.view("v", select(t)).schema == "app"
    fails("bad-name", lambda: schema("App"))
    fails("bad-enum", lambda: app.enum("e", "a", "a"))


def test_kinds_of_a_project(spark):
    from terrane.plans import kinds

    pin = kinds.Kind("pin", ("table",), ("level",), dependent=True)
    known = kinds.registry(pin)
    assert kinds.required(known)["pin"] == ("level",) and list(known)[:-1] == list(kinds.KINDS)
    rows = snapshot.snapshot(spark, [("pin", "app.p", "{}"), ("pin", "app.q", '{"level":1}')])
    assert [(r.identity, r.missing) for r in kinds.missing_keys(rows, kinds.required(known)).collect()] == [("app.p", ["level"])]
    changed = kinds.ordered(kinds.meaning(snapshot.diff(rows, rows.limit(0)), known), known)
    assert {(r.means, r.stage) for r in changed.collect()} == {("drop", 0)}
    fails("duplicate-kind", lambda: kinds.registry(kinds.Kind("table")))
    fails("unknown-kind", lambda: kinds.registry(kinds.Kind("pin", ("nothing",))))
    assert kinds.KINDS["policy"].dependent and not kinds.KINDS["table"].dependent


def test_loops(spark):
    posts_, comments, store = blog(spark)

    def body(ctx, least):
        def post(c, p):
            c.if_((X.eq(p["slug"], "zz"), lambda d: d.raise_("bad slug")), (X.coalesce(p["published"], False), lambda d: d.return_query(routines.Change("insert", comments, set=(("post_id", p["id"]), ("body", p["slug"]))))))
            c.for_each(select(comments).where(X.eq(comments["post_id"], p["id"])), lambda d, q: d.return_query(select({"id": comments["id"], "post_id": comments["post_id"], "parent_id": comments["parent_id"], "body": X.coalesce(p["slug"], "")}, comments).where(X.eq(comments["parent_id"], q["id"]))), "inner")

        ctx.for_each(select(posts_).where(X.gte(posts_["id"], least)), post)

    r = routines.routine("walk", {"least": "numeric"}, body)
    assert sorted(map(tuple, r(store, least=1).collect()), key=repr) == [(2, 1, 1, "a"), (3, 1, None, "a")]
    assert r(store, least=2).count() == 0
    bad = routines.routine("bad", {}, lambda ctx: ctx.for_each(select(posts_), lambda c, p: c.raise_("post %", p["id"])))
    fails("raised", lambda: bad(store))
    new = routines.routine("new", {"s": "text"}, lambda ctx, s: ctx.return_query(routines.Change("insert", posts_, set=(("id", 9), ("slug", s)))))
    assert [tuple(x) for x in new(store, s="nine").collect()] == [(9, "nine", None)]
    fails("bad-body", lambda: routines.routine("row", {}, lambda ctx: ctx.return_row())(store))
    fails("duplicate-local", lambda: routines.routine("twice", {}, lambda ctx: ctx.for_each(select(posts_), lambda c, p: c.for_each(select(comments), lambda d, q: d.raise_("x")))))


@pytest.mark.parametrize(("action", "want"), [("cascade", [(1, 10), (2, 2), (3, None)]), ("set null", [(1, None), (2, 2), (3, None)]), ("set default", [(1, 2), (2, 2), (3, None)])])
def test_foreign_keys_on_update(spark, action, want):
    parent = table("w", "parent", {"id": column("integer").primary_key()})
    child = table("w", "child", {"id": column("integer").primary_key(), "p": column("integer").default(2)}, foreign_keys=(ForeignKey(("p",), ("w", "parent"), ("id",), on_update=action),))
    store = Store(spark).bind(child, spark.createDataFrame([(1, 1), (2, 2), (3, None)], child.struct()))
    changed = spark.createDataFrame([(10, 1), (2, 2)], "id int, old__id int")
    assert sorted(map(tuple, integrity.update_cascading([parent, child], parent, changed, store)[child.key].collect()), key=lambda r: r[0]) == want
    strict = table("w", "child", {"id": column("integer").primary_key(), "p": column("integer")}, foreign_keys=(ForeignKey(("p",), ("w", "parent"), ("id",)),))
    fails("still-referenced", lambda: integrity.update_cascading([parent, strict], parent, changed, store))


def test_chain_problems(spark):
    of = lambda rows: sorted(map(tuple, lineage.problem(spark.createDataFrame(rows, "file string, parent string, current string")).collect()))
    good = [("1", "empty", "a"), ("2", "a", "b"), ("3", "b", "c")]
    assert of(good) == []
    assert of([*good, ("4", "a", "d"), ("5", "a", "e")]) == [("fork", "2"), ("fork", "4"), ("fork", "5")]
    assert of([*good, ("4", "x", "d"), ("5", "a", "e")]) == [("broken", "4")]
    assert of([*good, ("4", "c", "a"), ("5", "a", "e")]) == []  # back to an earlier state


def test_every_kind_is_a_node(spark, tmp_path):
    from terrane.plans import kinds, validators
    from terrane.plans.query import View

    posts_, comments, store = blog(spark)
    view = View("app", "open_posts", select(posts_).where(X.eq(posts_["published"], True)))
    rule = routines.trigger("depth", comments, ("insert",), lambda ctx, new, old: ctx.return_row())
    shielded = security.Protected(comments, (security.Policy("own", "select", ("member", "anon"), using=X.eq(comments["post_id"], 1)),))
    grant = {"schema": "app", "kind": "tables", "roles": ["anon", "member"], "privileges": ["select"]}
    find = routines.routine("find", {"least": "numeric"}, lambda ctx, least: ctx.return_query(select(posts_).where(X.gte(posts_["id"], least))))
    make = lambda **more: kinds.expand(**({"tables": [posts_, comments], "enums": [Enum("app", "status", ("a", "b"))], "views": [view], "routines": [("app", find)], "triggers": [rule], "protected": [shielded], "grants": [grant]} | more))
    rows = make()
    assert {k for k, _, _ in rows} == set(kinds.REQUIRED) and rows == make()
    assert [i for k, i, _ in rows if k in ("trigger", "policy", "rls", "grant", "sequence", "schema")] == ["app.tables.*.anon", "app.tables.*.member", "app.comments.own", "app.comments", "app", "app.comments_id_seq", "app.comments.depth"]
    assert [i for k, i, _ in rows if k == "function"] == ["app.comments_depth", "app.find"]
    fails("duplicate-object", lambda: make(views=[view, view]))
    before = snapshot.snapshot(spark, rows)
    assert kinds.missing_keys(before).isEmpty()
    snapshot.save(before, f"{tmp_path}/s")
    assert snapshot.load(spark, f"{tmp_path}/s", kinds.REQUIRED).count() == len(rows)
    snapshot.save(spark.createDataFrame([("view", "app.v", '{"columns":[]}')], snapshot.SCHEMA), f"{tmp_path}/bad")
    fails("bad-snapshot", lambda: snapshot.load(spark, f"{tmp_path}/bad", kinds.REQUIRED))
    other = routines.trigger("depth", comments, ("insert",), lambda ctx, new, old: ctx.return_row(None))
    after = snapshot.snapshot(spark, make(triggers=[other], enums=[Enum("app", "status", ("b", "a"))], grants=[grant | {"privileges": ["insert"]}]))
    got = {(r.kind, r.identity): r.means for r in kinds.meaning(snapshot.diff(before, after)).collect()}
    assert got == {("function", "app.comments_depth"): "replace", ("enum", "app.status"): "recreate", ("grant", "app.tables.*.anon"): "alter", ("grant", "app.tables.*.member"): "alter"}
    # a kind and a scalar that a project brings
    bundle = validators.Bundle("notes", kinds=(("comment", ("schema",)),))
    noted = snapshot.snapshot(spark, make(more=[("comment", "app", {"text": "ours"})]))
    steps = snapshot.ordered(snapshot.diff(before, noted), bundle.depends(snapshot.DEPENDS)).collect()
    assert [(r.kind, r.operation) for r in steps] == [("comment", "create")]
    assert kinds.missing_keys(noted, kinds.REQUIRED | {"comment": ("text", "by")}).first().missing == ["by"]
    fails("unknown-function", lambda: X.call("half", posts_["id"]))
    spark.udf.register("half", lambda x: x // 2, "int")
    X.allow_call("half")
    assert [r.h for r in select({"h": X.call("half", posts_["id"])}, posts_).frame(store).collect()] == [0, 1, 1]


def test_members_of_altered_tables(spark):
    from terrane.plans import kinds

    one = table("w", "a", {"id": column("integer").primary_key(), "b": column("integer"), "c": column("text")}, checks=(Check("ck", X.sql("b > 1", family="boolean")),), foreign_keys=(ForeignKey(("b",), ("w", "p"), ("id",)),), indexes=(Index((("b", "asc", None),)),))
    two = table("w", "a", {"id": column("integer").primary_key(), "b": column("bigint").primary_key(), "d": column("text")}, checks=(Check("ck", X.sql("b > 2", family="boolean")),), foreign_keys=(ForeignKey(("b",), ("w", "p"), ("id",), on_delete="cascade"),), indexes=(Index((("b", "desc", None),)),))
    before, after = (snapshot.snapshot(spark, snapshot.expand([t])) for t in (one, two))
    got = {tuple(r)[1:] for r in kinds.alter_steps(before, after).collect()}
    fk, idx = one.derived_names()["fk"][0], one.derived_names()["idx"][0]
    want = {(0, "drop", "foreign key", fk), (2, "add", "foreign key", fk)}
    want |= {(1, a, m, n) for m, n in (("index", idx), ("check", "ck"), ("key", "key")) for a in ("drop", "add")}
    want |= {(1, "alter", "column", "b"), (1, "drop", "column", "c"), (1, "add", "column", "d")}
    assert got == want


def test_session_values_outside_policies():
    from terrane.plans import validators

    t = table("app", "posts", {"id": column("integer").primary_key(), "owner": column("text").default(X.local("uid"))}, indexes=(Index((("id", "asc", None),), where=X.not_(X.eq(X.local("uid"), "a"))),))
    assert [p for _, _, p in validators.session_values_outside_policies([t, posts()])] == ["app.posts index id", "app.posts.owner default"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_renames_send_no_snapshot_through_the_driver(spark, tmp_path):
    """A snapshot's file is far smaller than its rows; Spark broadcast them whole."""
    from terrane.plans import renames

    snapshot.snapshot(spark, catalog(spark, "posts", "status")).write.parquet(f"{tmp_path}/before")
    given = [("table", "app.posts", "posts", "articles"), ("column", "app.posts", "status", "state")]
    spark.createDataFrame(given, renames.RENAMES).write.parquet(f"{tmp_path}/given")
    before, given = spark.read.parquet(f"{tmp_path}/before"), spark.read.parquet(f"{tmp_path}/given")
    out = renames.renamed(before, given)
    assert "Broadcast" not in _plan(out) and "Broadcast" not in _plan(renames.unknown(before, given))
    assert sorted(map(tuple, out.collect())) == sorted(catalog(spark, "articles", "state"))
    more = spark.createDataFrame([("column", "app.posts", "nope", "x"), ("table", "app.nope", "nope", "x"), ("column", "app.nope", "status", "x")], renames.RENAMES)
    assert sorted(map(tuple, renames.unknown(before, given.union(more)).collect())) == [("column", "app.posts", "nope"), ("table", "app.nope", "nope"), ("table", "app.nope", "status")]


def test_rename_plan_spreads_equal_definitions(spark, tmp_path):
    """Many tables of one definition: every pair once, from cells of a grid, and no snapshot is broadcast."""
    from pyspark.sql import functions as F

    from terrane.plans import renames

    node = lambda mark: '{"checks":["' + mark + '"],"columns":[],"foreign_keys":[],"indexes":[]}'
    side = lambda letter, n: [("table", f"app.{letter}{k}", node("a")) for k in range(n)]
    tables = {"before": [*side("t", 1500), ("table", "app.alone", node("b"))], "after": side("r", 1100)}
    for name, rows in tables.items():
        snapshot.snapshot(spark, rows).write.parquet(f"{tmp_path}/{name}")
    before, after = (spark.read.parquet(f"{tmp_path}/{name}") for name in tables)
    none = lambda third: spark.createDataFrame([], f"of string, identity string, {third}")
    planned = renames.plan(before, after, none("old string, new string"), none("name string"))
    assert "Broadcast" not in _plan(planned)
    assert sorted(map(tuple, planned.where("verdict <> 'ambiguous'").collect())) == [("table", "app", "alone", None, "unconfirmed")]
    pairs = planned.where("verdict = 'ambiguous'").groupBy("old").agg(F.count("new").alias("n"), F.countDistinct("new").alias("d"))
    assert {(r.n, r.d) for r in pairs.collect()} == {(1100, 1100)} and pairs.count() == 1500


def test_a_wrong_named_rename_moves_no_columns(spark):
    """The old name is still there, so its columns are compared with its own, not with those of the new name."""
    from terrane.plans import renames

    make = lambda *tables: snapshot.snapshot(spark, snapshot.expand(tables))
    t = lambda name, *columns: table("app", name, {"id": column("integer").primary_key(), **{c: column("text") for c in columns}})
    named = spark.createDataFrame([("table", "app", "a", "n")], "of string, identity string, old string, new string")
    meant = spark.createDataFrame([("column", "app.a", "y"), ("column", "app.a", "y"), ("column", "app.a", "none")], "of string, identity string, name string")
    planned = renames.plan(make(t("a", "x", "y")), make(t("a"), t("n", "x", "z")), named, meant)
    assert sorted((r.old, r.new, r.verdict) for r in planned.collect()) == [("a", "n", "unknown"), ("x", None, "unconfirmed"), ("y", None, "confirmed")]


def test_kinds_of_a_project_are_renamed_by_shuffles(spark):
    """The query's own check of its renames, and its plan: nothing of the generated catalogs is broadcast."""
    from terrane import queries

    out = queries.QUERIES["kind_custom"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in _plan(out) and out.count() > 100


def test_batch_keys_keep_their_types(spark, monkeypatch):
    """Keys of all types, empty, twice in the batch or in the rest: grouped as they are, in one pass that writes nothing aside."""
    from terrane.operators import batches

    t = table(
        "app", "t", {"id": column("bigint").primary_key(), "d": column("double precision").unique(), "s": column("text"), "at": column("timestamp"), "day": column("date"), "num": column("numeric"), "flag": column("boolean"), "up": column("bigint")},
        indexes=(Index(tuple((c, "asc", None) for c in ("s", "at", "day", "num", "flag")), unique=True), Index((("s", "asc", None),), unique=True, where=X.ref("app", "t", "flag", "boolean")), Index((("s", "asc", None),), unique=True, where=X.gt(X.ref("app", "t", "id", "numeric"), 7))),
        foreign_keys=(ForeignKey(("up",), ("app", "t"), ("id",)),),
    )
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, d double, s string, at string, day string, num string, flag boolean, up long").selectExpr("id", "d", "s", "cast(at as timestamp_ntz) at", "cast(day as date) day", "cast(num as decimal(38,18)) num", "flag", "up")
    day, nan = ("2020-01-01 00:00:00", "2020-01-01"), float("nan")
    old = (1, 0.0, "", *day, "0", False, None)
    rest = frame(old, old, (0, nan, "a", *day, "1", True, None), (2, None, None, *day, "1", True, 1))
    batch = frame((0, -0.0, "", *day, "0.00", False, 4), (3, nan, "", *day, "0.01", False, 3), (4, 5.0, "a", *day, "1", True, 0), (None, 5.0, None, *day, "1", True, 99), (5, 6.0, "a", None, None, None, None, 99), (8, 7.0, "b", *day, "1", True, 98))
    monkeypatch.setattr(batches, "cut", lambda rows: (_ for _ in ()).throw(AssertionError("a check keeps no copy")))
    # "b" stands once in each of the two indexes with a condition
    assert batches.batch_violations(t, batch, rest) == [("not null", 1), ("primary key", 1), ("unique d", 3), ("index s, at, day, num, flag", 2), ("index s", 1), ("foreign key up", 2)]
    kinds = dict(batches._entries(rest, t, batches.uniques(t)).dtypes)
    assert {"bigint", "string", "timestamp_ntz", "date", "decimal(38,18)", "boolean"} == {k for n, k in kinds.items() if n != "of"}
    assert batches._entries(rest, t, batches.uniques(t)[:1]).dtypes == [("of", "int"), ("bigint 0", "bigint")]


def test_lookups_of_triggers_are_run_once(spark):
    """What a trigger returns and refuses is read from one join, and a batch is grouped again only if a row found several; the least stays, a strict look-up refuses them."""
    there = table("app", "there", {"k": column("integer"), "a": column("text"), "b": column("integer")})
    rows = table("app", "rows", {"id": column("integer"), "k": column("integer")})
    batch = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, None), (4, 9), (5, 3), (None, 1)], rows.struct())

    def ran(found, kind, batch=batch):
        store = Store(spark).bind(there, spark.createDataFrame(found, there.struct()))

        def body(ctx, new, old):
            row = getattr(ctx, kind)(select(there).where(X.eq(there["k"], new["k"])), "x")
            ctx.if_((X.is_null(row["k"]), lambda c: c.raise_("none")), (X.gt(row["b"], 5), lambda c: c.raise_("%", X.coalesce(row["a"], "null"))))
            ctx.return_row("new")

        returned, refused = routines.trigger("t", rows, ("insert",), body).run(store, batch, "insert")
        assert not {w for w in ("Join", "Exchange", "min_by") if w in _plan(returned) + _plan(refused)}
        return tuple(sorted(map(repr, map(tuple, x.collect()))) for x in (returned, refused))

    none = ["(3, None, 'none')", "(4, 9, 'none')"]
    one = [(1, "y", 1), (2, None, 7), (3, "z", None), (None, "n", 1)]
    assert ran(one, "row_or_null") == (["(1, 1)", "(5, 3)", "(None, 1)"], ["(2, 2, 'null')"] * 2 + none)
    strict = [r.replace("none", "x: not exactly one row") for r in none]
    assert ran(one, "row") == (["(1, 1)", "(5, 3)", "(None, 1)"], ["(2, 2, 'null')"] * 2 + strict)
    several = [*one, (1, "x", 9), (2, "u", 1), (2, None, 8), (3, "z", None)]
    assert ran(several, "row_or_null") == (["(5, 3)"], ["(1, 1, 'x')", "(2, 2, 'null')", "(2, 2, 'null')", *none, "(None, 1, 'x')"])
    assert ran(several, "row") == ([], [f"({r}, 'x: not exactly one row')" for r in ("1, 1", "2, 2", "2, 2", "3, None", "4, 9", "5, 3", "None, 1")])
    assert ran([], "row_or_null")[0] == [] and ran(several, "row", batch.limit(0)) == ([], [])


def test_chains_that_nobody_asks_forks_of(spark, monkeypatch):
    """Whether files follow is told without the join that tells forks; odd rows are as they were."""
    frame = lambda *rows: spark.createDataFrame(list(rows), "file string, parent string, current string")
    odd = [("1_a", None, "a"), ("2_b", "a", None), ("3_c", None, "c"), ("4_d", "", "d"), ("5_e", "x", "e"), ("6_f", None, "f"), ("7_g", "", "f"), ("8_h", "f", "h"), ("9_i", "=", "i")]
    links = lineage.chain(frame(*odd))
    want = {"1_a": "ok", "2_b": "ok", "3_c": "ok", "4_d": "broken", "5_e": "broken", "6_f": "fork", "7_g": "fork", "8_h": "ok", "9_i": "broken"}
    assert {r.file: r.status for r in links.collect()} == want and all(r.follows == (want[r.file] == "ok") for r in links.collect())
    asked = links.where("not follows").select("file")
    assert asked.count() == 5 and "_earliest" not in _plan(asked) and "_earliest" in _plan(links.select("status"))
    none = spark.createDataFrame([], snapshot.SCHEMA)
    other = spark.createDataFrame([("table", "app.t", "{}"), ("table", "app.u", "{}")], snapshot.SCHEMA)
    checked = lambda files, tip, after=none: [(r.status, r.n) for r in lineage.verify(files, none, after, tip).collect()]
    good = [("1_a", None, "a"), ("2_b", "a", "b"), ("3_c", "b", "c")]
    assert checked(frame(*good), "c") == [("ok", 0)] * 4 and checked(frame(*good), "b") == [*[("ok", 0)] * 3, ("failed", 1)]
    assert checked(frame(*good), "c", other) == [("ok", 0), ("ok", 0), ("failed", 2), ("skipped", None)]
    assert checked(frame(*odd), "i") == [("ok", 0), ("failed", 5), ("ok", 0), ("skipped", None)]
    assert checked(frame(), "c") == [*[("ok", 0)] * 3, ("failed", 1)]
    assert checked(frame(("1_a", None, "a"), (None, "x", "y")), "a") == [("ok", 0), ("failed", 1), ("ok", 0), ("skipped", None)]
    # without its versions a chain isn't looked at
    monkeypatch.setattr(lineage, "chain", lambda files: (_ for _ in ()).throw(AssertionError("nobody asks for the chain")))
    assert checked(frame(*good, ("3_d", "c", "d")), "d") == [("failed", 1), ("skipped", None), ("ok", 0), ("skipped", None)]
