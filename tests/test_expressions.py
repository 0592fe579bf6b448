import itertools

import pytest

from trimodel.errors import CompileError
from trimodel.plans.builder import Relation
from trimodel.session import Session

LEVELS = [None, 1, 2]


def least(x):
    return (0, 0) if x is None else (1, x)


TRUTH = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: least(a) < least(b), ">": lambda a, b: least(a) > least(b),
    "<=": lambda a, b: least(a) <= least(b), ">=": lambda a, b: least(a) >= least(b),
}


@pytest.fixture(scope="module")
def pairs(spark):
    return Relation(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(itertools.product(LEVELS, LEVELS))], "k int, a int, b int"))


@pytest.mark.parametrize("op", TRUTH)
def test_nulls_are_least(pairs, op):
    want = {k for k, (a, b) in enumerate(itertools.product(LEVELS, LEVELS)) if TRUTH[op](a, b)}
    assert {r.k for r in pairs.where(f"a {op} b").df.collect()} == want
    assert {r.k for r in pairs.where(f"not a {op} b").df.collect()} == set(range(9)) - want
    assert {r.k: r.v for r in pairs.select("k", v=f"a {op} b").df.collect()} == {k: k in want for k in range(9)}


@pytest.mark.parametrize("op", TRUTH)
@pytest.mark.parametrize("value", ["null", "1", "1.5"])
def test_literals_on_either_side(pairs, op, value):
    x = {"null": None, "1": 1, "1.5": 1.5}[value]
    rows = list(enumerate(itertools.product(LEVELS, LEVELS)))
    assert {r.k for r in pairs.where(f"a {op} {value}").df.collect()} == {k for k, (a, _) in rows if TRUTH[op](a, x)}
    assert {r.k for r in pairs.where(f"{value} {op} a").df.collect()} == {k for k, (a, _) in rows if TRUTH[op](x, a)}


def value(spark, e, schema="s string, n int, d double, l array<int>, o struct<x:int>, b boolean", row=("Abc", 3, 2.5, [1, 2], (7,), True)):
    return Relation(spark.createDataFrame([row], schema)).select(v=e).df.first().v


@pytest.mark.parametrize(
    ("e", "want"),
    [
        ("n + d", 5.5), ("n + null", 3.0), ('n + "4"', 7.0), ('n + "4x"', 3.0), ('" 4" + 0', 0.0), ('"4d" + 0', 0.0), ("n / 0", None), ("7 / 2", 3.5), ("n % 2", 1.0), ("-n", -3.0), ("b + 1", 2.0),
        ('"5" = 5', False), ('"5" < 6', True), ("1 = 1.0", True), ("n = 3.0", True), ('s = "abc"', False),
        ('s like "a%"', True), ('s like "A_C"', True), ('s like "b"', False), ('s starts "AB"', True), ('s ends "BC"', True), ('s has "bc"', True), ('s has "BC"', False), ("l has 2", True), ("l has 5", False), ("n has 1", False),
        ('s matches "^A.c$"', True), ('s matches "(("', False), ("n matches s", False), ("n in [1, 3]", True), ('n in ["3"]', False), ("2 in l", True), ("null in [null, 1]", True),
        ("not l", False), ("not []", True), ('not ""', True), ("not 0", True), ("not null", True), ("not o", False), ("s and n", True), ("null or 0", False),
        ("length(s)", 3), ('length("é")', 2), ("length(l)", 2), ("length(n)", None), ('concat(s, n, null, "z")', "Abcz"), ("substring(s, 1)", "bc"), ("substring(s, -4, 2)", "Ab"), ("substring(s, 1, -1)", ""),
        ("upper(n)", None), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("round(2.345, 1)", 2.3), ("floor(d)", 2.0), ("coalesce(null, n)", 3), ("nullif(n, 3)", 3), ("nullif(s, \"Abc\")", None), ("typeof(n)", "int32"), ("typeof(null)", "null"), ("typeof(l)", "array"),
        ("case n when 3 then \"y\" end", "y"), ("case null when null then 1 else 2 end", 1), ("case when n > 5 then 1 end", None), ("o.x", 7), ("o.y", None), ("nothing.at.all", None), ('cast("12", "int")', 12), ('cast("zz", "int")', None),
        ('s like "a.c"', False), ('"a.c" like "A.C"', True), ('"a\nb" like "a_b"', True), ('"É" like "é"', False), ('"É" starts "é"', True),
    ],
)
def test_values(spark, e, want):
    assert value(spark, e) == want


def test_objects_and_arrays(spark):
    assert value(spark, "{b = 1, a = s}").asDict() == {"a": "Abc", "b": 1}
    assert value(spark, "[n, d]") == [3.0, 2.5]


@pytest.mark.parametrize("e", ["upper()", "concat(s)", "upper(5)", 'abs("x")', "no_such(1)", "$1 = 1", "round(d, n)"])
def test_mistakes_are_found_when_compiling(spark, e):
    with pytest.raises(CompileError):
        value(spark, e)


def test_parameters(spark):
    r = Relation(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"))
    assert [x.a for x in r.bind(1).where("a = $1").df.collect()] == [1]
    assert [x.a for x in r.bind(v=None).where("b = :v").df.collect()] == [2]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    s = Session(spark)
    s.read_folder(sf, ("orders",))
    plan = plan_of(s.query("get o_orderkey from orders where o_totalprice < 1000 and o_orderstatus = \"F\" and not (o_custkey < 5)"))
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "LessThan(o_totalprice,1000.0)" in pushed and "EqualNullSafe(o_orderstatus,F)" in pushed and "GreaterThanOrEqual(o_custkey,5)" in pushed
    schema = plan[plan.index("ReadSchema") :]
    assert "o_orderpriority" not in schema


def test_equality_joins_are_hash_joins_and_prune(spark, sf):
    s = Session(spark)
    s.read_folder(sf, ("orders", "customer"))
    plan = plan_of(s.query("get o.o_orderkey, c.c_name from orders as o join customer as c on o.o_custkey = c.c_custkey"))
    assert ("BroadcastHashJoin" in plan or "SortMergeJoin" in plan) and "NestedLoop" not in plan and "Cartesian" not in plan
    assert "c_acctbal" not in plan[plan.index("ReadSchema") :]


def test_top_n_does_not_sort_everything(spark, sf):
    s = Session(spark)
    s.read_folder(sf, ("orders",))
    assert "TakeOrderedAndProject" in plan_of(s.table("orders").top(5, "o_totalprice desc").df)
