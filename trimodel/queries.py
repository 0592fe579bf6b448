"""One query for each operator, with SQL that gives the same rows.

Queries are texts of the language or plans over the driver's tables; mutations, histories and keyspaces are the pure
transforms that the store applies. Float sums are rounded on both sides, since their order differs.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trimodel.errors import TrimodelError
from trimodel.lang.parser import parse
from trimodel.operators import mutate, shape
from trimodel.plans.builder import Relation
from trimodel.session import Session
from trimodel.sources import documents, keyspace

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class _Folder(dict):
    """Tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __contains__(self, name: object) -> bool:
        return name in TABLES or super().__contains__(name)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self[name]


def session(spark: SparkSession, folder: str) -> Session:
    s = Session(spark)
    s.frames = _Folder(spark, folder)
    return s


def text(name: str, query: str, sql: str, *params: object, **rename: str) -> None:
    """A query in the language. rename: output columns whose dotted names SQL can't give as they are."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = session(spark, folder).query(query, *params)
        return df.withColumnsRenamed({k.replace("__", "."): v for k, v in rename.items()}) if rename else df

    QUERIES[name], ORACLES[name] = run, sql


def plan(name: str, sql: str):
    """A query by the plan API, over a session."""

    def add(build: Callable[[Session], DataFrame | Relation]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = build(session(spark, folder))
            return out.df if isinstance(out, Relation) else out

        QUERIES[name], ORACLES[name] = run, sql
        return build

    return add


# scans, projection, limits

text("scan_all", "get from nation", "SELECT * FROM nation")
plan("scan_alias_flat", 'SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey" FROM nation')(lambda s: s.table("nation").alias("n").flatten())
text("project_cols", "get p_partkey, p_name from part", "SELECT p_partkey, p_name FROM part")
text("project_keyword_columns", "get doc_id, text, lang from documents where lang = \"de\"", "SELECT doc_id, text, lang FROM documents WHERE lang = 'de'")
text("project_missing", "get n_name, nothing from nation", "SELECT n_name, CAST(NULL AS VARCHAR) AS nothing FROM nation")
text("project_json_path", "get event_id, props.k from events", 'SELECT event_id, json_extract_string(props, \'$.k\') AS "props.k" FROM events')
plan("project_computed", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")(lambda s: s.table("lineitem").select("l_orderkey", "l_linenumber", net="round(l_extendedprice * (1 - l_discount), 4)"))
plan("project_keep_listed", "SELECT n_name FROM nation")(lambda s: s.table("nation").project("n_name", "no_such_column"))
plan("range_scan", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")(lambda s: s.table("orders").between("o_orderkey", 100, 5000))
plan("key_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")(lambda s: s.table("orders").lookup("o_orderkey", 77))
plan("prefix_scan", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'ECONOMY')")(lambda s: s.table("part").prefix("p_type", "ECONOMY").select("p_partkey", "p_type"))
plan("index_scan", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda s: s.table("customer").lookup("c_mktsegment", "BUILDING"))
plan("scan_with_id", "SELECT r_regionkey AS _id, * FROM region")(lambda s: shape.with_id(s.frame("region")))
plan("empty_relation", "SELECT * FROM nation WHERE false")(lambda s: s.table("nation").where("false"))
plan("values_rows", "SELECT 1::BIGINT AS a, 'x' AS b, 2.5::DOUBLE AS c")(lambda s: mutate.put(s.spark.range(0).selectExpr("id AS a"), s.spark.range(1).selectExpr("1L AS a", "'x' AS b", "2.5D AS c")))
text("order_desc", "get o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey take 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
text("order_topk_skip", "get o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey skip 5 take 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
text("order_by_hidden_column", "get o_orderkey from orders order by o_totalprice, o_orderkey take 7", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7")
text("order_nulls_least", "get l_orderkey, l_linenumber from lineitem where l_quantity > 49 order by l_discount, l_orderkey, l_linenumber take 9", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49 ORDER BY l_discount NULLS FIRST, l_orderkey, l_linenumber LIMIT 9")
text("take_param", "get n_nationkey from nation order by n_nationkey skip $2 take $1", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 3", 4, 3)
plan("top_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")(lambda s: s.table("customer").top(15, "c_acctbal desc", "c_custkey").select("c_custkey", "c_acctbal"))
plan("order_nulls_last", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 ORDER BY o.o_orderkey NULLS LAST, c.c_custkey LIMIT 12")(
    lambda s: Relation(s.query("get c.c_custkey, o.o_orderkey from customer as c left join orders as o on c.c_custkey = o.o_custkey and o.o_totalprice > 400000").toDF("c_custkey", "o_orderkey")).order_by("o_orderkey nulls last", "c_custkey").take(12)
)

# predicates

SPARSE = "(SELECT c.c_custkey AS k, o.o_totalprice AS x FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000)"
JOINED = "from customer as c left join orders as o on c.c_custkey = o.o_custkey and o.o_totalprice > 200000"


def null_aware(name: str, condition: str, sql: str) -> None:
    """A condition on `o.o_totalprice`, which is NULL for customers without a large order; x in SQL."""
    text(name, f"get c.c_custkey, o.o_totalprice {JOINED} where {condition}", f"SELECT k, x FROM {SPARSE} WHERE {sql}", c__c_custkey="k", o__o_totalprice="x")


null_aware("filter_eq_null", "o.o_totalprice = null", "x IS NULL")
null_aware("filter_ne", "o.o_totalprice != 250000", "x IS DISTINCT FROM 250000")
null_aware("filter_lt_null", "o.o_totalprice < 300000", "x < 300000 OR x IS NULL")
null_aware("filter_le_null", "o.o_totalprice <= 300000", "x <= 300000 OR x IS NULL")
null_aware("filter_gt", "o.o_totalprice > 300000", "x > 300000")
null_aware("filter_ge", "o.o_totalprice >= 300000", "x >= 300000")
null_aware("filter_not", "not (o.o_totalprice < 300000)", "NOT coalesce(x < 300000 OR x IS NULL, false)")
null_aware("filter_is_null", "o.o_totalprice is null", "x IS NULL")
null_aware("filter_is_not_null", "o.o_totalprice is not null", "x IS NOT NULL")
null_aware("filter_truthy", "o.o_totalprice", "x IS NOT NULL AND x <> 0")
text("filter_eq", 'get from nation where n_name = "NATION_7"', "SELECT * FROM nation WHERE n_name = 'NATION_7'")
text("filter_and_or", 'get o_orderkey from orders where o_orderstatus = "F" and o_totalprice > 200000 or o_orderpriority = "1-URGENT"', "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 OR o_orderpriority = '1-URGENT'")
text("filter_block", "get o_orderkey from orders\n  where\n    o_totalprice > 100000\n    o_totalprice < 120000\n", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 120000")
text("filter_last_where_wins", "get n_name from nation where n_regionkey = 0 where n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1")
text("filter_param", "get n_name from nation where n_regionkey = $1 and n_name > $2", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_name > 'I'", 2, "I")
text("filter_int_float", "get l_orderkey, l_linenumber from lineitem where l_quantity = 25", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 25")
text("filter_text_number", 'get n_nationkey from nation where n_name = 5 or n_nationkey < "7"', "SELECT n_nationkey FROM nation WHERE n_nationkey < 7")
text("filter_arithmetic", "get l_orderkey, l_linenumber from lineitem where l_extendedprice * (1 - l_discount) - 2 * l_quantity > 80000", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) - 2 * l_quantity > 80000")
text("filter_minus", "get c_custkey from customer where -c_acctbal > 500", "SELECT c_custkey FROM customer WHERE -c_acctbal > 500")
text("filter_modulo", "get o_orderkey from orders where o_orderkey % 7 = 3", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
plan("arith_div_zero", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END, 3) AS q, round(CASE WHEN l_linenumber - 1 = 0 THEN NULL ELSE l_quantity % (l_linenumber - 1) END, 3) AS m FROM lineitem")(
    lambda s: Relation(s.table("lineitem").select("l_orderkey", "l_linenumber", q="l_extendedprice / l_discount", m="l_quantity % (l_linenumber - 1)").df.selectExpr("l_orderkey", "l_linenumber", "round(q, 3) AS q", "round(m, 3) AS m"))
)
text("filter_has", 'get p_partkey, p_name from part where p_name has "ring"', "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
text("filter_contains", 'get p_partkey from part where p_type contains "CON"', "SELECT p_partkey FROM part WHERE contains(p_type, 'CON')")
plan("filter_array_has", "SELECT vec_id FROM (SELECT vec_id, [label, 3, 7] AS labels FROM embeddings) WHERE list_contains(labels, vec_id % 10)")(lambda s: Relation(s.frame("embeddings").selectExpr("vec_id", "array(label, 3, 7) AS labels", "cast(vec_id % 10 AS int) AS r")).where("labels has r").select("vec_id"))
text("filter_like", 'get p_partkey from part where p_name like "%A_E%"', "SELECT p_partkey FROM part WHERE p_name ILIKE '%A_E%'")
text("filter_like_exact", 'get p_partkey from part where p_brand like "brand#1_"', "SELECT p_partkey FROM part WHERE p_brand ILIKE 'brand#1_'")
text("filter_starts", 'get p_partkey from part where p_brand starts "BRAND#1"', "SELECT p_partkey FROM part WHERE starts_with(lower(p_brand), 'brand#1')")
text("filter_ends", 'get p_partkey from part where p_type ends "omy"', "SELECT p_partkey FROM part WHERE ends_with(lower(p_type), 'omy')")
text("filter_matches", 'get p_partkey from part where p_brand matches "#[13][2-5]$"', "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[13][2-5]$')")
text("filter_matches_pages", 'get page_id from pages where url matches "^https://(www|blog)[.]"', "SELECT page_id FROM pages WHERE regexp_matches(url, '^https://(www|blog)[.]')")
text("filter_matches_invalid", 'get p_partkey from part where p_brand matches "(("', "SELECT p_partkey FROM part WHERE false")
text("filter_in", "get n_name from nation where n_regionkey in [1, 3]", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
text("filter_not_in", 'get o_orderkey from orders where not o_orderpriority in ["1-URGENT", "2-HIGH"]', "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
text("filter_json_path", "get event_id from events where props.k = \"87\"", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '87'")
text("filter_datetime", "get o_orderkey from orders where o_orderdate >= cast(\"1997-01-01 00:00:00\", \"datetime\")", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
plan("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders")(
    lambda s: s.table("orders").select("o_orderkey", size='case when o_totalprice > 300000 then "big" when o_totalprice > 100000 then "mid" else "small" end')
)
plan("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END::BIGINT AS code FROM orders")(lambda s: s.table("orders").select("o_orderkey", code='case o_orderstatus when "F" then 1 when "O" then 2 end'))
plan("null_exact_table", "SELECT k, coalesce(x < 300000, x IS NULL) AS lt, coalesce(x > 300000, false) AS gt, coalesce(x <= 300000, true) AS le, coalesce(x >= 300000, false) AS ge, x IS NOT DISTINCT FROM NULL AS eq FROM " + SPARSE)(
    lambda s: Relation(s.query(f"get c.c_custkey, o.o_totalprice {JOINED}").toDF("k", "x")).select("k", lt="x < 300000", gt="x > 300000", le="x <= 300000", ge="x >= 300000", eq="x = null")
)
plan("literal_array_object", "SELECT n_nationkey, 2::BIGINT AS size, 'a' AS b FROM nation")(lambda s: Relation(s.table("nation").select("n_nationkey", size="length([1, n_nationkey])", o='{a = n_name, b = "a"}').df.selectExpr("n_nationkey", "size", "o.b AS b")))

# joins

text("join_inner", "get orders.o_orderkey, customer.c_name from orders join customer on orders.o_custkey = customer.c_custkey", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey", orders__o_orderkey="k", customer__c_name="n")
text("join_left", "get c.c_custkey, o.o_orderkey from customer as c left join orders as o on c.c_custkey = o.o_custkey", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey", c__c_custkey="k", o__o_orderkey="o")
text("join_right", "get l.quality, d.doc_id from labels as l right join documents as d on l.doc_id = d.doc_id", "SELECT quality AS q, d.doc_id AS d FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id", l__quality="q", d__doc_id="d")
text("join_full", "get s.s_suppkey, n.n_name from supplier as s full join nation as n on s.s_nationkey = n.n_nationkey and s.s_acctbal > 8000", "SELECT s_suppkey AS s, n_name AS n FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 8000", s__s_suppkey="s", n__n_name="n")
text("join_cross", "get r.r_name, n.n_name from region as r cross join nation as n", "SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation", r__r_name="r", n__n_name="n")
text("join_theta", "get s.s_suppkey, n.n_nationkey from supplier as s join nation as n on s.s_nationkey < n.n_nationkey and n.n_regionkey = 2", "SELECT s_suppkey AS s, n_nationkey AS n FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = 2", s__s_suppkey="s", n__n_nationkey="n")
text(
    "join_three", "get o.o_orderkey, c.c_name, n.n_name from orders as o\n  join customer as c\n  on o.o_custkey = c.c_custkey\n  join nation as n on c.c_nationkey = n.n_nationkey\n  where n.n_regionkey = 1 and o.o_totalprice > 150000\n",
    "SELECT o_orderkey AS o, c_name AS c, n_name AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND o_totalprice > 150000", o__o_orderkey="o", c__c_name="c", n__n_name="n",
)
text("join_self", "get a.n_name, b.n_name from nation as a join nation as b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", a__n_name="a", b__n_name="b")
text("join_base_column", "get o_orderkey, c.c_name from orders as o join customer as c on o_custkey = c.c_custkey where o_totalprice > 300000", "SELECT o_orderkey, c_name AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000", c__c_name="c")
SIDES = "(SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@plan("join_null_keys", f"SELECT a.doc_id AS a, b.doc_id AS b FROM {SIDES} a JOIN (SELECT DISTINCT quality, min(doc_id) OVER (PARTITION BY quality) AS doc_id FROM {SIDES}) b ON a.quality IS NOT DISTINCT FROM b.quality")
def _(s: Session) -> DataFrame:
    sides = s.query("get d.doc_id, l.quality from documents as d left join labels as l on d.doc_id = l.doc_id").toDF("doc_id", "quality")
    least = Relation(sides).group_by("quality").agg(doc_id=("min", "doc_id"))
    out = Relation(sides).alias("a").join(least.alias("b"), "a.quality = b.quality")
    return out.df.selectExpr("a.doc_id AS a", "b.doc_id AS b")


for strategy in ("hash", "merge", "broadcast", "nested_loop"):
    plan(f"join_{strategy}", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")(
        lambda s, strategy=strategy: s.table("customer").alias("c").join(s.table("nation").alias("n"), "c.c_nationkey = n.n_nationkey", strategy=strategy).df.selectExpr("c.c_custkey AS c", "n.n_name AS n")
    )

# aggregates

text("count_table", "count from orders", 'SELECT count(*) AS "count" FROM orders')
text("count_where", 'count from orders where o_orderstatus = "F"', "SELECT count(*) AS \"count\" FROM orders WHERE o_orderstatus = 'F'")
plan("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1, 2")(
    lambda s: Relation(s.table("lineitem").group_by("l_returnflag", "l_linestatus").agg(n="count", q=("sum", "l_quantity"), a=("avg", "l_extendedprice"), lo=("min", "l_discount"), hi=("max", "l_tax")).df.withColumns({"q": F.round("q", 2), "a": F.round("a", 4)}))
)
plan("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders")(lambda s: s.table("orders").agg(n=("count", "o_comment"), s=("sum", "o_totalprice")).df.withColumn("s", F.round("s", 2)))
LABELLED = "(SELECT d.lang, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
plan("agg_nulls", f"SELECT lang, sum(coalesce(q, 0))::DOUBLE AS s, avg(q)::DOUBLE AS a, CASE WHEN count(q) < count(*) THEN NULL ELSE min(q) END AS lo, max(q) AS hi, count(*) AS n FROM {LABELLED} GROUP BY 1")(
    lambda s: Relation(s.query("get d.lang, l.quality from documents as d left join labels as l on d.doc_id = l.doc_id").toDF("lang", "q")).group_by("lang").agg(s=("sum", "q"), a=("avg", "q"), lo=("min", "q"), hi=("max", "q"), n="count")
)
plan("agg_null_group", f"SELECT q, count(*) AS n FROM {LABELLED} GROUP BY 1")(lambda s: Relation(s.query("get d.lang, l.quality from documents as d left join labels as l on d.doc_id = l.doc_id").toDF("lang", "q")).group_by("q").agg(n="count"))
plan("agg_first_last", "SELECT user_id, min_by(event_type, event_id) AS f, max_by(event_type, event_id) AS l FROM events GROUP BY 1")(lambda s: s.table("events").group_by("user_id").agg(f=("first", "event_type", "event_id"), l=("last", "event_type", "event_id")))
plan("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")(lambda s: s.table("orders").group_by("o_orderstatus").agg(n=("count", "o_custkey", "distinct")))
plan("agg_keys_only", "SELECT DISTINCT c_mktsegment FROM customer")(lambda s: s.table("customer").group_by("c_mktsegment").agg())
plan("agg_computed_key", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")(lambda s: s.table("orders").select(y="year(o_orderdate)").group_by("y").agg(n="count"))
plan("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda s: s.table("lineitem").select("l_returnflag", "l_linestatus").distinct())
FLAGSHIP_SQL = "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 50000 GROUP BY 1"


@plan("flagship", FLAGSHIP_SQL)
def flagship(s: Session) -> DataFrame:
    """Revenue by nation: a three-way join, a filter and a grouped sum."""
    joined = s.query("get n.n_name, o.o_totalprice from orders as o join customer as c on o.o_custkey = c.c_custkey join nation as n on c.c_nationkey = n.n_nationkey where o.o_totalprice > 50000")
    out = Relation(joined.toDF("n_name", "price")).group_by("n_name").agg(orders="count", total=("sum", "price"))
    return out.df.withColumn("total", F.round("total", 2))


# functions


def function(name: str, table: str, key: str, expression: str, sql: str, where: str = "true") -> None:
    plan(f"fn_{name}", f"SELECT {key}, {sql} AS v FROM {table} WHERE {where}")(lambda s: Relation(s.frame(table).where(where)).select(*key.split(", "), v=expression))


function("upper", "part", "p_partkey", "upper(p_name)", "upper(p_name)")
function("lower", "customer", "c_custkey", "lowercase(c_mktsegment)", "lower(c_mktsegment)")
function("length", "documents", "doc_id", "length(text)", "strlen(text)")
function("length_array", "embeddings", "vec_id", "len(embedding)", "len(embedding)")
function("concat", "nation", "n_nationkey", 'concat(n_name, null, "-", n_name)', "n_name || '-' || n_name")
function("substring", "part", "p_partkey", "substring(p_name, 2, 4)", "substring(p_name, 3, 4)")
function("substr_tail", "part", "p_partkey", "substr(p_name, -1)", "p_name")
function("trim", "nation", "n_nationkey", 'trim(concat(" \t ", n_name, " "))', "n_name")
function("replace", "part", "p_partkey", 'replace(p_type, "ECO", "AUTO")', "replace(p_type, 'ECO', 'AUTO')")
function("abs", "customer", "c_custkey", "abs(c_acctbal)", "abs(c_acctbal)")
function("floor", "customer", "c_custkey", "floor(c_acctbal)", "floor(c_acctbal)")
function("ceil", "customer", "c_custkey", "ceiling(c_acctbal)", "ceil(c_acctbal)")
function("round", "customer", "c_custkey", "round(c_acctbal)", "round(c_acctbal)")
function("round_digits", "part", "p_partkey", "round(sqrt(p_retailprice), 2)", "round(sqrt(p_retailprice), 2)")
function("sqrt", "part", "p_partkey", "round(sqrt(p_retailprice), 6)", "round(sqrt(p_retailprice), 6)")
function("pow", "part", "p_partkey", "power(p_size, 2)", "pow(p_size, 2)")
function("coalesce", "nation", "n_nationkey", "coalesce(null, n_nationkey, 7)", "n_nationkey::BIGINT")
function("nullif", "nation", "n_nationkey", "nullif(n_regionkey, cast(1, \"int\"))", "nullif(n_regionkey, 1)")
function("ifnull", "nation", "n_nationkey", 'nvl(nullif(n_name, "NATION_3"), "?")', "ifnull(nullif(n_name, 'NATION_3'), '?')")
function("now", "nation", "n_nationkey", "year(now()) > 2000", "true")
function("date", "orders", "o_orderkey", "date(o_orderdate)", "CAST(o_orderdate AS DATE)")
function("time", "orders", "o_orderkey", "time(o_orderdate)", "strftime(o_orderdate, '%H:%M:%S.%f')")
function("year", "orders", "o_orderkey", "year(o_orderdate)", "year(o_orderdate)")
function("month", "orders", "o_orderkey", "month(o_orderdate)", "month(o_orderdate)")
function("day", "orders", "o_orderkey", "day(o_orderdate)", "day(o_orderdate)")
function("typeof", "orders", "o_orderkey", 'concat(typeof(o_orderkey), ",", type(o_totalprice), ",", typeof(o_orderdate), ",", typeof(null))', "'int64,float64,datetime,null'")
function("cast", "orders", "o_orderkey", 'cast(o_totalprice, "bigint")', "CAST(trunc(o_totalprice) AS BIGINT)")
function("uuid", "nation", "n_nationkey", "length(uuid())", "36::BIGINT")

# mutations


@plan("mut_put", "SELECT * FROM nation UNION ALL SELECT 99, 'ATLANTIS', NULL")
def _(s: Session) -> DataFrame:
    return mutate.put(s.frame("nation"), s.spark.range(1).selectExpr("99 AS n_nationkey", "'ATLANTIS' AS n_name"))


@plan("mut_put_upsert", "SELECT * FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 3, 'NEW', 1")
def _(s: Session) -> DataFrame:
    return mutate.put(s.frame("nation"), s.spark.range(1).selectExpr("3 AS n_nationkey", "'NEW' AS n_name", "1 AS n_regionkey"), "n_nationkey")


@plan("mut_change", "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice < 100000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def _(s: Session) -> DataFrame:
    (q,) = parse('change orders where o_totalprice < 100000 o_orderstatus = "X", o_totalprice = o_totalprice + 1')
    return mutate.changed(s.frame(q.table), q.where, q.values)


@plan("mut_change_new_column", "SELECT *, CASE WHEN n_regionkey = 2 THEN 'asia' END AS area FROM nation")
def _(s: Session) -> DataFrame:
    (q,) = parse('change nation where n_regionkey = 2 area = "asia"')
    return mutate.changed(s.frame(q.table), q.where, q.values)


@plan("mut_change_all", "SELECT n_nationkey, upper(n_name) || '!' AS n_name, n_regionkey FROM nation")
def _(s: Session) -> DataFrame:
    (q,) = parse('change nation n_name = concat(upper(n_name), "!")')
    return mutate.changed(s.frame(q.table), q.where, q.values)


@plan("mut_remove", "SELECT * FROM lineitem WHERE NOT (l_quantity < 25 OR l_returnflag = 'R')")
def _(s: Session) -> DataFrame:
    (q,) = parse('remove from lineitem where l_quantity < 25 or l_returnflag = "R"')
    return mutate.removed(s.frame(q.table), q.where)


# the document and the key-value model: events as revisions of a user's document, pages as keys with an expiry

LOG = "(SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS _revision FROM events)"


def log(s: Session) -> DataFrame:
    return documents.numbered(s.frame("events").select("event_id", "user_id", "event_type", "value"), "user_id", "event_id").withColumn("gone", F.col("event_type") == "purchase")


plan("doc_latest", f"SELECT event_id, user_id, event_type, value, _revision FROM {LOG} QUALIFY _revision = max(_revision) OVER (PARTITION BY user_id) AND event_type <> 'purchase'")(lambda s: documents.latest(log(s), "user_id", deleted="gone").drop("gone"))
plan("doc_history", f"SELECT * FROM {LOG} WHERE user_id = 7 ORDER BY _revision DESC LIMIT 5")(lambda s: documents.history(log(s), 7, 5, "user_id").drop("gone"))
plan("doc_at_revision", f"SELECT * FROM {LOG} QUALIFY _revision = max(CASE WHEN _revision <= 3 THEN _revision END) OVER (PARTITION BY user_id)")(lambda s: documents.at_revision(log(s), 3, "user_id").drop("gone"))
plan("doc_exact_revision", f"SELECT * FROM {LOG} WHERE user_id = 11 AND _revision = 2")(lambda s: documents.exactly(log(s), 11, 2, "user_id").drop("gone"))
plan("doc_purged", f"SELECT event_id FROM {LOG} l WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, event_type, event_id FROM {LOG} QUALIFY _revision = max(_revision) OVER (PARTITION BY user_id)) WHERE event_type = 'purchase' AND event_id < 5000)")(lambda s: documents.purged(log(s), 5000, "user_id", deleted="gone", updated="event_id").select("event_id"))
KEYS = "(SELECT page_id AS _id, url, CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id * 1000 END AS _expires_at FROM pages)"


def keys(s: Session) -> DataFrame:
    return s.frame("pages").selectExpr("page_id AS _id", "url", "CASE WHEN page_id % 3 = 0 THEN 0L ELSE page_id * 1000 END AS _expires_at")


plan("ks_live", f"SELECT * FROM {KEYS} WHERE _expires_at = 0 OR _expires_at >= 100000")(lambda s: keyspace.live(keys(s), 100_000))
plan("ks_expired", f"SELECT * FROM {KEYS} WHERE _expires_at > 0 AND _expires_at < 100000")(lambda s: keyspace.expired(keys(s), 100_000))
plan("ks_ttl", f"SELECT *, CASE WHEN _expires_at > 0 THEN greatest(_expires_at - 100000, 0) END AS ttl_ms FROM {KEYS}")(lambda s: keyspace.ttl(keys(s), 100_000))
plan("ks_expire", f"SELECT _id, url, CASE WHEN _id < 50 THEN 105000 ELSE _expires_at END AS _expires_at FROM {KEYS}")(lambda s: keyspace.expire(keys(s), F.col("_id") < 50, 5000, 100_000))
plan("ks_persist", f"SELECT _id, url, CASE WHEN _id < 50 THEN 0 ELSE _expires_at END AS _expires_at FROM {KEYS}")(lambda s: keyspace.persist(keys(s), F.col("_id") < 50))
plan("ks_get", f"SELECT * FROM {KEYS} WHERE _id = 42")(lambda s: keys(s).filter(F.col("_id") == 42))

# catalog and results

text("describe_table", "describe nation", "SELECT 'nation' AS \"table\", 'external' AS model, * FROM (VALUES (0, 'n_nationkey', 'int32'), (1, 'n_name', 'string'), (2, 'n_regionkey', 'int32')) v(position, name, data_type)")
_described = QUERIES["describe_table"]
QUERIES["describe_table"] = lambda spark, folder: _described(spark, folder).select("table", "model", "position", "name", "data_type")
plan("result_documents", "SELECT count(*) AS n, count(DISTINCT json_extract_string(d, '$.n_name')) AS names FROM (SELECT to_json(nation) AS d FROM nation)")(lambda s: shape.as_documents(s.frame("nation")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.get_json_object("document", "$.n_name")).alias("names")))
plan("result_key_values", "SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS v FROM region")(lambda s: shape.as_key_values(s.frame("region")).select("key", F.get_json_object("value", "$.r_name").alias("v")))

# managed tables: statements make, change and read tables of a store of their own


def managed(name: str, sql: str):
    """A query that works on a fresh store, below the shared folder for checkpoints or the warehouse."""

    def add(build: Callable[[Session], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
            s = Session(spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}")
            s.frames = _Folder(spark, folder)
            return build(s)

        QUERIES[name], ORACLES[name] = run, sql
        return build

    return add


PEOPLE = 'make table people\n  as relational\n  fields\n    id bigint primary key\n    name text required\n    email text unique\n    age bigint default 18\n'
SHOPS = "make table shops\n  as relational\n  fields\n    n_nationkey int primary key\n    n_name text required\n    n_regionkey int\n"


def _refused(s: Session, text: str) -> bool:
    try:
        s.execute(text)
    except TrimodelError:
        return True
    return False


def _shown(s: Session, *rows: tuple) -> DataFrame:
    """What a client sees, as rows of a name and a value."""
    return s.spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


@managed("put_statement", "SELECT * FROM (VALUES (1::BIGINT, 'Ann', 'a@x', 18::BIGINT), (2, 'Bob', NULL, 41)) v(id, name, email, age)")
def _(s: Session) -> DataFrame:
    s.execute(PEOPLE + 'put into people name = "Ann", email = "a@x"\nput into people\n  name = "Bob"\n  age = 40 + 1\n')
    return s.query("get id, name, email, age from people")


@managed("put_frame", "SELECT row_number() OVER (ORDER BY n_nationkey) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS email, n_regionkey::BIGINT AS age FROM nation")
def _(s: Session) -> DataFrame:
    s.execute(PEOPLE)
    s.put("people", s.frame("nation").orderBy("n_nationkey").coalesce(1).selectExpr("n_name AS name", "n_regionkey AS age"))
    return s.query("get id, name, email, age from people")


@managed("put_replaces_keys", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'new ' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation")
def _(s: Session) -> DataFrame:
    s.execute(SHOPS)
    s.put("shops", s.frame("nation"))
    s.put("shops", s.frame("nation").where("n_regionkey = 2").selectExpr("n_nationkey", "concat('new ', n_name) AS n_name", "n_regionkey"))
    return s.query("get n_nationkey, n_name, n_regionkey from shops")


@managed("change_and_remove_rows", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 10 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey <> 3")
def _(s: Session) -> DataFrame:
    s.execute(SHOPS)
    for k in range(3):
        s.put("shops", s.frame("nation").where(f"n_nationkey % 3 = {k}"))
    s.execute("change shops where n_regionkey = 1 n_name = lower(n_name), n_regionkey = 10\nremove from shops where n_regionkey = 3")
    return s.query("get n_nationkey, n_name, n_regionkey from shops")


@managed("affected_rows", "SELECT 'put' AS name, count(*)::VARCHAR AS value FROM nation UNION ALL SELECT 'change', count(*)::VARCHAR FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'remove', count(*)::VARCHAR FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'nothing', '0'")
def _(s: Session) -> DataFrame:
    s.execute(SHOPS)
    put = s.put("shops", s.frame("nation"))
    counts = [o.count for o in s.execute('change shops where n_regionkey = 1 n_name = "x"\nremove from shops where n_regionkey = 3\nremove from shops where n_regionkey = 99')]
    return _shown(s, ("put", put), *zip(("change", "remove", "nothing"), counts, strict=True))


@managed("put_documents", "SELECT event_id::VARCHAR AS _id, user_id, event_type, 2::BIGINT AS _revision FROM events WHERE event_type = 'click' UNION ALL SELECT event_id::VARCHAR, user_id, event_type, 1 FROM events WHERE event_type = 'view'")
def _(s: Session) -> DataFrame:
    s.execute("make table log\n  as document\n")
    s.put("log", s.frame("events").selectExpr("event_id AS id", "user_id", "event_type"))
    s.execute('change log where event_type = "click" user_id = user_id + 0\nremove from log where event_type in ["purchase", "signup", "error"]')
    return documents.latest(s.log("log")).selectExpr("_id", "cast(user_id AS bigint) AS user_id", "event_type", "_revision")


@managed("documents_of_mixed_types", "SELECT event_id::VARCHAR AS _id FROM events WHERE event_id % 3 <> 0 AND event_id % 10 = 1 UNION ALL SELECT event_id::VARCHAR FROM events WHERE event_id % 3 = 0 AND event_type = 'view'")
def _(s: Session) -> DataFrame:
    s.execute("make table log\n  as document\n")
    s.put("log", s.frame("events").where("event_id % 3 <> 0").selectExpr("event_id AS id", "event_id % 10 AS x"))
    s.put("log", s.frame("events").where("event_id % 3 = 0").selectExpr("event_id AS id", "event_type AS x"))  # the field holds both kinds now
    return s.query('get _id from log where x = 1 or x = "view"')


@managed("put_keys", "SELECT page_id::VARCHAR AS _id, CASE WHEN page_id % 5 = 0 THEN 'again' ELSE url END AS url FROM pages WHERE page_id % 2 = 0")
def _(s: Session) -> DataFrame:
    s.execute("make table cache\n  as keyspace\n  ttl 3600\n")
    s.put("cache", s.frame("pages").selectExpr("page_id AS key", "url"))
    s.put("cache", s.frame("pages").where("page_id % 5 = 0").selectExpr("cast(page_id AS string) AS _id", "'again' AS url"))
    s.put("cache", s.frame("pages").where("page_id % 2 = 1").selectExpr("cast(page_id AS string) AS _id", "url", "1L AS _expires_at"))
    return s.query("get _id, url from cache")


@managed("constraints", "SELECT * FROM (VALUES ('required', 'True'), ('unique', 'True'), ('unique index', 'True'), ('exists', 'True'), ('document exists', 'True'), ('rows', '1')) v(name, value)")
def _(s: Session) -> DataFrame:
    s.execute(PEOPLE + 'make table posts\n  as document\nput into posts _id = "p", n = 1\nput into people name = "Ann", email = "a@x"')
    refused = [_refused(s, q) for q in ("put into people age = 3", 'put into people name = "B", email = "a@x"', PEOPLE, 'put into posts _id = "p", n = 2')]
    s.execute('put into posts _id = "q", n = 1')
    return _shown(s, ("required", refused[0]), ("unique", refused[1]), ("unique index", _refused(s, "make unique index u on posts(n)")), ("exists", refused[2]), ("document exists", refused[3]), ("rows", s.one("count people")["count"]))


@managed("describe_managed", "SELECT * FROM (VALUES (0, 'id', 'int64', false, true, true, NULL), (1, 'name', 'string', false, false, false, NULL), (2, 'email', 'string', true, false, true, NULL), (3, 'age', 'int64', true, false, false, '18')) v(position, name, data_type, nullable, is_primary, is_unique, default_value)")
def _(s: Session) -> DataFrame:
    s.execute(PEOPLE)
    return s.query("describe people").select("position", "name", "data_type", "nullable", "is_primary", "is_unique", "default_value")


@managed("alter_columns", "SELECT n_nationkey, n_name AS title, 7::BIGINT AS score, n_regionkey::VARCHAR AS n_regionkey, NULL::VARCHAR AS note FROM nation UNION ALL SELECT 99, 'more', 7, '5', 'none'")
def _(s: Session) -> DataFrame:
    s.execute(SHOPS)
    s.put("shops", s.frame("nation"))
    s.execute("change table shops\n  add\n    score bigint default 7\n    note text\n    gone int\n  rename\n    n_name to title\n  alter\n    n_regionkey type text\n")
    s.execute('change table shops\n  drop\n    gone\n  alter\n    note set default "none"\n')
    s.execute('put into shops n_nationkey = 99, title = "more", n_regionkey = "5"')
    return s.query("get n_nationkey, title, score, n_regionkey, note from shops")


@managed("tables_and_namespaces", "SELECT * FROM (VALUES ('app.people', 'relational'), ('default.kept', 'document'), ('namespace app', 'the app'), ('namespace default', 'None'), ('namespace system', 'None')) v(name, value)")
def _(s: Session) -> DataFrame:
    s.execute('make namespace app description "the app"\nmake namespace old\nuse old\nmake table t\n  as document\nuse app\n' + PEOPLE + "use default\nmake table cache\n  as keyspace\nmake table named\n  as document\nchange table named rename to kept\ndrop table cache\ndrop namespace old force")
    tables = [(f"{r.namespace}.{r.name}", r.model) for r in s.list_tables().collect()]
    return _shown(s, *tables, *((f"namespace {r.name}", r.description) for r in s.list_namespaces().collect()))


@managed("index_ddl", "SELECT * FROM (VALUES ('age', 'by_age'), ('email', 'uniq_email'), ('name', '')) v(name, value)")
def _(s: Session) -> DataFrame:
    s.execute(PEOPLE + "make index by_age on people(age)\nmake index by_name on people(name)\ndrop index by_name on people")
    return _shown(s, *((r.name, ",".join(r.indexes)) for r in s.query("describe people").collect() if r.name != "id"))


@managed("drop_if_exists", "SELECT * FROM (VALUES ('refused', 'True'), ('tables', '0')) v(name, value)")
def _(s: Session) -> DataFrame:
    s.execute(PEOPLE + PEOPLE.replace("make table", "make table if not exists") + "drop table if exists people\ndrop table if exists people")
    return _shown(s, ("refused", _refused(s, "drop table people")), ("tables", s.list_tables().count()))


@managed("transaction_rollback", "SELECT * FROM nation WHERE n_regionkey = 0")
def _(s: Session) -> DataFrame:
    s.execute(SHOPS)
    s.begin()
    s.put("shops", s.frame("nation").where("n_regionkey = 0"))
    s.commit()
    s.execute("begin")
    s.put("shops", s.frame("nation").where("n_regionkey = 1"))
    s.execute("remove from shops where n_nationkey < 10\nrollback")
    return s.query("get n_nationkey, n_name, n_regionkey from shops")


@managed("transaction_snapshot", "SELECT * FROM (VALUES ('first committer wins', 'True'), ('in it', '25'), ('after', '5'), ('read-only', 'True')) v(name, value)")
def _(s: Session) -> DataFrame:
    s.execute(SHOPS)
    s.put("shops", s.frame("nation"))
    other = Session(s.spark, s.root)
    s.begin()
    other.execute("remove from shops where n_regionkey > 0")
    inside = s.one("count shops")["count"]
    s.execute('change shops n_name = "x"')
    lost = _refused(s, "commit")
    s.begin(read_only=True)
    refused = _refused(s, "remove from shops where n_nationkey = 0")
    s.rollback()
    return _shown(s, ("first committer wins", lost), ("in it", inside), ("after", s.one("count shops")["count"]), ("read-only", refused))


@managed("document_revisions", "SELECT * FROM (VALUES (1::BIGINT, 'one', false), (2, 'two', false), (3, 'three', false), (4, 'three', true)) v(_revision, title, _deleted)")
def _(s: Session) -> DataFrame:
    s.execute('make table posts\n  as document\nput into posts _id = "p", title = "one"\nchange posts where _id = "p" title = "two"')
    s.update_document("posts", "p", {"title": "three"}, revision=2)
    try:
        s.update_document("posts", "p", {"title": "late"}, revision=2)
    except TrimodelError:
        s.execute('begin\nremove from posts where _id = "p"\nrollback')  # documents are written at once
    return s.history("posts", "p").select("_revision", "title", "_deleted")


@managed("client_calls", "SELECT * FROM (VALUES ('one', 'NATION_4'), ('optional', 'None'), ('too many', 'True'), ('batch', 'rows executed'), ('several', '2'), ('ping', 'True'), ('stats', '25 2')) v(name, value)")
def _(s: Session) -> DataFrame:
    s.execute(SHOPS)
    s.put("shops", s.frame("nation").where("n_regionkey < 2"))
    s.put("shops", s.frame("nation").where("n_regionkey >= 2"))
    try:
        many = bool(s.one("get from shops")) and False
    except TrimodelError:
        many = True
    outcomes = s.batch("get from shops", "use default")
    stats = s.stats("shops").first()
    return _shown(
        s, ("one", s.one("get n_name from shops where n_nationkey = $1", 4)["n_name"]), ("optional", s.optional("get from shops where n_nationkey = 99")), ("too many", many), ("batch", " ".join(o.kind for o in outcomes)),
        ("several", len(s.execute("get from shops\ncount shops"))), ("ping", s.ping()), ("stats", f"{stats['rows']} {stats['parts']}"),
    )


@managed("snapshot_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 4")
def _(s: Session) -> DataFrame:
    s.execute(SHOPS)
    s.put("shops", s.frame("nation").where("n_regionkey = 4"))
    before = s.query("get n_nationkey, n_name, n_regionkey from shops")
    s.execute("remove from shops where n_nationkey >= 0")
    return before  # a reader keeps what it began with


@managed("merged_parts", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(s: Session) -> DataFrame:
    s.execute(SHOPS)
    for k in range(4):
        s.put("shops", s.frame("nation").where(f"n_nationkey % 4 = {k}"))
    s.compact("shops")
    s.vacuum(older_ms=0)
    return s.query("get n_nationkey, n_name, n_regionkey from shops")


@managed("values_relation", "SELECT * FROM (VALUES (1.0::DOUBLE, 'x'), (2.5, NULL)) v(a, b)")
def _(s: Session) -> DataFrame:
    s.values("v", [{"a": 1, "b": "x"}, {"a": 2.5}, {"b": "y"}])
    return s.query("get a, b from v where a > 0")


for kind in ("csv", "json"):

    @managed(f"{kind}_round_trip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
    def _(s: Session, kind: str = kind) -> DataFrame:
        s.export(s.query("get n_nationkey, n_name from nation where n_regionkey = 2"), f"{s.root}/out", kind)
        s.load("back", f"{s.root}/out", kind)
        return s.query("get n_nationkey, n_name from back").select(F.col("n_nationkey").cast("bigint"), "n_name")


# registered functions


def _squared(x: pd.Series) -> pd.Series:
    return x * x


def _spread(x: pd.Series) -> float:
    return float(x.max() - x.min())


@plan("udf_scalar", "SELECT p_partkey, p_size * p_size AS v FROM part WHERE p_size * p_size > 100")
def _(s: Session) -> DataFrame:
    s.register_function("squared", _squared, ("bigint",), "bigint")
    return s.table("part").where("squared(p_size) > 100").select("p_partkey", v="squared(p_size)").df


@plan("udf_native", "SELECT c_custkey, reverse(c_name) AS v FROM customer")
def _(s: Session) -> DataFrame:
    s.register_function("backwards", F.reverse, ("string",), "string", "native")
    return s.table("customer").select("c_custkey", v="backwards(c_name)").df


class _Mean:
    """An average that tasks fold into states."""

    def init(self) -> tuple:
        return 0, 0.0

    def step(self, state: tuple, values: pd.Series) -> tuple:
        return state[0] + len(values), state[1] + float(values.sum())

    def merge(self, a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    def finalize(self, state: tuple) -> float:
        return state[1] / state[0]


@plan("udf_aggregate_states", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def _(s: Session) -> DataFrame:
    s.register_function("mean", _Mean(), ("double",), "double", "states")
    return s.aggregate("mean", s.frame("lineitem"), ["l_returnflag"], "l_quantity").withColumn("mean", F.round("mean", 6))


@plan("udf_aggregate", "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1")
def _(s: Session) -> DataFrame:
    s.register_function("spread", _spread, ("double",), "double", "aggregate")
    return s.aggregate("spread", s.frame("customer"), ["c_mktsegment"], "c_acctbal")

