"""Registered queries over the graph view of the relational tables, and the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweave.functions import avg, collect, count, max_, min_, sum_
from nodeweave.operators import mutate
from nodeweave.operators.eager import related
from nodeweave.plans.builder import QueryBuilder, select
from nodeweave.plans.compiler import count_query
from nodeweave.plans.spec import FulltextSource, VectorSource
from nodeweave.sources.catalog import Catalog
from nodeweave.sources.tables import Customer, Document, Event, Item, Label, LineItem, Nation, Order, OrderStatus, Part, Party, Region, Supplier, Turn, catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """alias.property as alias_property."""
    return df.toDF(*(c.replace(".", "_") for c in df.columns))


def query(sql: str | None = None):
    """Register a function of a catalog that returns a statement or a DataFrame."""

    def register(f: Callable[[Catalog], QueryBuilder | DataFrame]):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = catalog(spark, sf_dir)
            got = f(found)
            return plain(got.to_df(found) if isinstance(got, QueryBuilder) else got)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def ks(builder: QueryBuilder, source) -> QueryBuilder:
    return builder._with(source=source)


# --- scans


@query("SELECT n_nationkey AS n_key, n_name AS n_name FROM nation")
def s1_node_scan(c):
    return select(Nation).project(Nation.key, Nation.name)


@query("SELECT c_custkey AS n_key, c_name AS n_name FROM customer")
def s2_subtype_scan(c):
    return select(Customer).project(Customer.key, Customer.name)


@query("SELECT c_name AS n_name, c_acctbal AS n_balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def s2_supertype_scan(c):
    return select(Party).project(Party.name, Party.balance)


@query("SELECT o_orderkey AS n_key, o_totalprice AS n_price FROM orders WHERE o_orderkey = 7")
def s3_pk_lookup(c):
    return select(Order).where(Order.key == 7).project(Order.key, Order.price)


@query("SELECT p_partkey AS n_key, p_name AS n_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 15")
def s5_page(c):
    return select(Part).project(Part.key, Part.name).order_by(Part.key).skip(15).limit(20)


@query("SELECT o_orderkey AS n_key, o_orderstatus AS n_status FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21)")
def s6_ids_batch(c):
    return select(Order).where(Order.key.in_([1, 2, 3, 5, 8, 13, 21])).project(Order.key, Order.status)


@query("SELECT count(*) AS n FROM orders")
def s7_count(c):
    return count_query(select(Order).spec, c)


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 5")
def s7_exists(c):
    return count_query(select(Customer).where(Customer.key == 5).spec, c).select((F.col("n") > 0).alias("found"))


# --- predicates


@query("SELECT c_custkey AS n_key FROM customer WHERE c_mktsegment = 'BUILDING'")
def p1_eq(c):
    return select(Customer).where(Customer.segment == "BUILDING").project(Customer.key)


@query("SELECT c_custkey AS n_key FROM customer WHERE c_mktsegment <> 'BUILDING'")
def p2_ne(c):
    return select(Customer).where(Customer.segment != "BUILDING").project(Customer.key)


@query("SELECT o_orderkey AS n_key FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 250000")
def p3_cmp(c):
    return select(Order).where(Order.price > 100000).where(Order.price <= 250000).project(Order.key)


@query("SELECT p_partkey AS n_key FROM part WHERE contains(p_type, 'AS')")
def p4_contains(c):
    return select(Part).where(Part.kind.contains("AS")).project(Part.key)


@query("SELECT p_partkey AS n_key FROM part WHERE starts_with(p_type, 'S')")
def p5_prefix(c):
    return select(Part).where(Part.kind.startswith("S")).project(Part.key)


@query("SELECT c_custkey AS n_key FROM customer WHERE ends_with(c_name, '7')")
def p6_suffix(c):
    return select(Customer).where(Customer.name.endswith("7")).project(Customer.key)


@query("SELECT c_custkey AS n_key FROM customer WHERE regexp_full_match(c_name, 'Customer#0*[1-9]5')")
def p7_regex_full(c):
    return select(Customer).where(Customer.name.matches("Customer#0*[1-9]5")).project(Customer.key)


@query("SELECT d.doc_id AS d_key FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def p8_null_after_optional(c):
    found = select(Document).alias("d").traverse(Document.label).alias("l").project(Document.key, Label.key).to_df(c)
    return found.filter("`l.key` IS NULL").select("`d.key`")


@query("SELECT o_orderkey AS n_key FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p9_in(c):
    return select(Order).where(Order.priority.in_(["1-URGENT", "2-HIGH"])).project(Order.key)


@query("SELECT o_orderkey AS n_key FROM orders WHERE false")
def p9_in_empty(c):
    return select(Order).where(Order.priority.in_([])).project(Order.key)


@query("SELECT o_orderkey AS n_key FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def p10_not_in(c):
    return select(Order).where(Order.status.not_in_(["F", "O"])).project(Order.key)


@query("SELECT p_partkey AS n_key FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT (p_brand = 'Brand#11' OR contains(p_type, 'BRASS'))")
def p11_bool_nested(c):
    return select(Part).where(((Part.size < 10) | (Part.size > 40)) & ~((Part.brand == "Brand#11") | Part.kind.contains("BRASS"))).project(Part.key)


@query("SELECT o_orderkey AS n_key, o_orderdate AS n_date FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def p14_datetime_range(c):
    return select(Order).where(Order.date >= datetime(1995, 1, 1)).where(Order.date < datetime(1996, 1, 1)).project(Order.key, Order.date)


@query("SELECT o_orderkey AS n_key FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderstatus <> 'F'")
def p14_enum_param(c):
    return select(Order).where(Order.status.in_([OrderStatus.FINISHED, OrderStatus.PARTIAL])).where(Order.status != OrderStatus.FINISHED).project(Order.key)


# --- results


@query("SELECT p_partkey AS n_key, p_brand AS n_brand, p_retailprice AS n_price FROM part")
def r5_project(c):
    return select(Part).project(Part.key, Part.brand, Part.price)


@query("SELECT DISTINCT c_mktsegment AS n_segment FROM customer")
def r6_distinct_scalar(c):
    return select(Customer).distinct().project(Customer.segment)


@query("SELECT DISTINCT n_nationkey AS key, n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def r6_distinct_entity(c):
    df = select(Customer).alias("c").where(Customer.balance > 5000).traverse(Customer.nation, optional=False).alias("n").distinct().return_target("n").to_df(c)
    return df.select("n.key", "n.name")


@query("SELECT c_custkey AS c_key, o_orderkey AS o_key FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def r8_with(c):
    return select(Customer).alias("c").where(Customer.balance > 9000).with_("c").traverse(Customer.orders, optional=False).alias("o").project(Customer.key, Order.key)


@query("SELECT c_custkey AS ckey, o_orderkey AS okey, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey")
def r3_return_nodes(c):
    df = select(Customer).alias("c").traverse(Customer.orders, optional=False).alias("o").return_nodes("c", "o").to_df(c)
    return df.select(F.col("c.key").alias("ckey"), F.col("o.key").alias("okey"), F.col("o.price").alias("price"))


@query("SELECT l_orderkey AS okey, l_partkey AS pkey, l_quantity AS quantity FROM lineitem")
def r4_return_edge(c):
    df = select(Order).alias("o").traverse(Order.parts, edge_alias="e", optional=False).alias("p").return_nodes("o", "p").return_edge("e").to_df(c)
    return df.select(F.col("o.key").alias("okey"), F.col("p.key").alias("pkey"), F.col("e.quantity").alias("quantity"))


@query("SELECT d.doc_id AS d_key, l.quality AS l_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS LAST, d.doc_id LIMIT 300")
def o1_order_nulls_last(c):
    return select(Document).alias("d").traverse(Document.label).alias("l").project(Document.key, Label.quality).order_by(Label.quality).order_by(Document.key).limit(300)


@query("SELECT d.doc_id AS d_key, l.quality AS l_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id LIMIT 300")
def o1_order_desc(c):
    return select(Document).alias("d").traverse(Document.label).alias("l").project(Document.key, Label.quality).order_by("l.quality DESC, d.key").limit(300)


# --- traversals


@query("SELECT d.doc_id AS d_key, l.toxic AS l_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j1_optional_hop(c):
    return select(Document).alias("d").traverse(Document.label).alias("l").project(Document.key, Label.toxic)


@query("SELECT c_custkey AS c_key, o_orderkey AS o_key FROM customer JOIN orders ON o_custkey = c_custkey")
def j2_inner_hop(c):
    return select(Customer).alias("c").traverse(Customer.orders, optional=False).alias("o").project(Customer.key, Order.key)


@query("SELECT p_partkey AS p_key, o_orderkey AS o_key FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size = 1")
def j3_incoming_hop(c):
    return select(Part).alias("p").where(Part.size == 1).traverse(Part.orders, optional=False).alias("o").project(Part.key, Order.key)


RING = """r AS (
  SELECT k * 2 AS eid, k AS src, (k + 1) % 25 AS dst FROM range(25) t(k)
  UNION ALL SELECT k * 2 + 1, k, (k * 7) % 25 FROM range(25) t(k))"""


@query(f"WITH {RING} SELECT src AS a_key, dst AS b_key FROM r UNION ALL SELECT dst, src FROM r WHERE src <> dst")
def j3_both_hop(c):
    return select(Nation).alias("a").traverse(Nation.ring_both, optional=False).alias("b").project("a.key", "b.key")


@query("SELECT d.doc_id AS d_key, l.doc_id AS l_key FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1")
def j4_optional_post_where(c):
    return select(Document).alias("d").traverse(Document.label).alias("l").where(Label.quality == 1).project(Document.key, Label.key)


@query("SELECT d.doc_id AS d_key, l.doc_id AS l_key FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1")
def j4_required_post_where(c):
    return select(Document).alias("d").traverse(Document.label, optional=False).alias("l").where(Label.quality == 1).project(Document.key, Label.key)


@query("""SELECT c_custkey AS c_key, o_orderkey AS o_key, l_partkey AS p_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_totalprice > 200000 WHERE c_acctbal > 5000""")
def j4_two_optionals_where_on_first(c):
    return select(Customer).alias("c").where(Customer.balance > 5000).traverse(Customer.orders).alias("o").traverse(Order.parts).alias("p").where(Order.price > 200000, on="o").project(Customer.key, Order.key, Part.key)


@query("SELECT d.doc_id AS d_key, l.doc_id AS l_key FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND (d.lang = 'en' OR l.toxic = 1)")
def j4_mixed_compound(c):
    return select(Document).alias("d").traverse(Document.label).alias("l").where((Document.lang == "en") | (Label.toxic == 1)).project(Document.key, Label.key)


@query("""SELECT c_custkey AS c_key, count(*) AS n, coalesce(sum(p_size), 0)::BIGINT AS size FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY c_custkey""")
def j5_three_hop(c):
    return select(Customer).alias("c").traverse(Customer.orders, optional=False).alias("o").traverse(Order.parts, optional=False).alias("p").aggregate(count().as_("n"), sum_(Part.size).as_("size"), group_by="c.key")


@query(f"WITH {RING} SELECT a.src AS a_key, c.dst AS d_key, count(*) AS n FROM r a JOIN r b ON a.dst = b.src JOIN r c ON b.dst = c.src GROUP BY ALL")
def j5_repeated_edges(c):
    return select(Nation).alias("a").traverse(Nation.ring, optional=False).alias("b").traverse(Nation.ring, optional=False).alias("x").traverse(Nation.ring, optional=False).alias("d").aggregate(count().as_("n"), group_by="a.key, d.key")


@query("SELECT o_orderkey AS o_key, l_partkey AS p_key, l_discount AS e_discount FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_discount >= 0.09 AND l_shipdate < TIMESTAMP '1995-06-01'")
def j7_edge_props(c):
    return select(Order).alias("o").where(Order.status == "F").traverse(Order.parts, edge_alias="e", optional=False).alias("p").where(LineItem.discount >= 0.09, on="e").where(LineItem.shipdate < datetime(1995, 6, 1)).project(Order.key, Part.key, LineItem.discount)


@query("SELECT s_suppkey AS s_key, s_name AS s_name, n_name AS n_name, r_name AS r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal < 2000")
def j5_supplier_region(c):
    return select(Supplier).alias("s").where(Supplier.balance < 2000).traverse(Supplier.nation, optional=False).alias("n").traverse(Nation.region, optional=False).alias("r").project(Supplier.key, Supplier.name, Nation.name, Region.name)


# --- paths

CHAIN = """WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS k, turn FROM conversations),
p AS (SELECT k AS a, k AS b, 0 AS d FROM t WHERE turn >= {least} UNION ALL SELECT p.a, p.b - 1, p.d + 1 FROM p JOIN t ON t.k = p.b WHERE t.turn > 0{most})
SELECT a AS a_key, b AS b_key FROM p JOIN t ON t.k = p.b WHERE d >= {min}"""


@query(CHAIN.format(least=0, most=" AND p.d < 3", min=1))
def j6_varlen_chain(c):
    return select(Turn).alias("a").repeat(Turn.replies_to, 1, 3).alias("b").project("a.key", "b.key")


@query(CHAIN.format(least=4, most="", min=1))
def j6_varlen_unbounded(c):
    return select(Turn).alias("a").where(Turn.turn >= 4).repeat(Turn.replies_to).alias("b").project("a.key", "b.key")


@query(CHAIN.format(least=0, most=" AND p.d < 2", min=0))
def j6_varlen_zero_min(c):
    return select(Turn).alias("a").repeat(Turn.replies_to, 0, 2).alias("b").project("a.key", "b.key")


@query(CHAIN.format(least=0, most=" AND p.d < 4", min=2))
def j6_varlen_min2(c):
    return select(Turn).alias("a").repeat(Turn.replies_to, 2, 4).alias("b").project("a.key", "b.key")


@query("""SELECT t.conv_id * 1000 + t.turn AS a_key, u.conv_id * 1000 + u.turn AS b_key FROM conversations t LEFT JOIN conversations u
ON u.conv_id = t.conv_id AND u.turn < t.turn AND u.turn >= t.turn - 2 AND u.role = 'user'""")
def j6_varlen_optional(c):
    return select(Turn).alias("a").repeat(Turn.replies_to, 1, 2, optional=True).alias("b").where(Turn.role == "user", on="b").project("a.key", "b.key")


TRAILS = f"""WITH RECURSIVE {RING}, p AS (SELECT src AS a, dst AS b, [eid] AS trail FROM r
UNION ALL SELECT p.a, r.dst, list_append(p.trail, r.eid) FROM p JOIN r ON r.src = p.b WHERE len(p.trail) < 4 AND NOT list_contains(p.trail, r.eid))"""


@query(f"{TRAILS} SELECT a AS a_key, b AS b_key, count(*) AS n FROM p GROUP BY ALL")
def j6_varlen_cycle_trails(c):
    return select(Nation).alias("a").repeat(Nation.ring, 1, 4).alias("b").aggregate(count().as_("n"), group_by="a.key, b.key")


BOTH_TRAILS = f"""WITH RECURSIVE {RING}, u AS (SELECT eid, src, dst FROM r UNION ALL SELECT eid, dst, src FROM r WHERE src <> dst),
p AS (SELECT src AS a, dst AS b, [eid] AS trail FROM u
UNION ALL SELECT p.a, u.dst, list_append(p.trail, u.eid) FROM p JOIN u ON u.src = p.b WHERE len(p.trail) < 3 AND NOT list_contains(p.trail, u.eid))"""


@query(f"{BOTH_TRAILS} SELECT a AS a_key, b AS b_key, count(*) AS n FROM p GROUP BY ALL")
def j6_varlen_both_trails(c):
    return select(Nation).alias("a").repeat(Nation.ring_both, 1, 3).alias("b").aggregate(count().as_("n"), group_by="a.key, b.key")


@query(f"{TRAILS} SELECT DISTINCT a AS a_key, b AS b_key FROM p WHERE a < 5")
def j6_reachability_distinct(c):
    return select(Nation).alias("a").where(Nation.key < 5).repeat(Nation.ring, 1, 4).alias("b").distinct().project("a.key", "b.key")


# --- eager fetch, semi and anti joins


@query("""SELECT c_custkey AS key, coalesce(o.orders, []) AS orders FROM customer LEFT JOIN
(SELECT o_custkey, list_sort(list(DISTINCT o_orderkey)) AS orders FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def j8_eager_fetch(c):
    nested = related(c, Customer, ["orders"], c.nodes("Party").filter(F.array_contains("_labels", "Customer")))
    return nested.select("key", F.array_sort(F.transform("orders", lambda o: o["key"])).alias("orders"))


@query("SELECT n_nationkey AS n_key FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def j10_semi(c):
    from nodeweave.cypher import run

    return run(c, "MATCH (n:Nation) WHERE (n)<-[:BASED_IN]-(:Party) RETURN n.key")


@query("SELECT d.doc_id AS d_key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j10_anti(c):
    from nodeweave.cypher import run

    return run(c, "MATCH (d:Document) WHERE NOT (d)-[:HAS_LABEL]->() RETURN d.key")


# --- aggregates


@query("SELECT d.lang AS d_lang, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def a1_count_star_left(c):
    return select(Document).alias("d").traverse(Document.label).alias("l").aggregate(count("*").as_("n"), group_by="d.lang")


@query("SELECT d.lang AS d_lang, count(l.quality) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def a2_count_field(c):
    return select(Document).alias("d").traverse(Document.label).alias("l").aggregate(count(Label.quality).as_("n"), group_by="d.lang")


@query("SELECT count(DISTINCT p_brand) AS n FROM part")
def a3_count_distinct(c):
    return select(Part).aggregate(count(Part.brand, distinct=True).as_("n"))


@query("SELECT round(avg(o_totalprice), 4) AS mean FROM orders")
def a4_avg(c):
    return select(Order).aggregate(avg(Order.price).as_("mean")).to_df(c).select(F.round("mean", 4).alias("mean"))


@query("SELECT coalesce(sum(p_size), 0)::BIGINT AS total, count(*) AS n, avg(p_size) AS mean FROM part WHERE p_size > 100000")
def a5_sum_empty(c):
    return select(Part).where(Part.size > 100000).aggregate(sum_(Part.size).as_("total"), count().as_("n"), avg(Part.size).as_("mean"))


@query("SELECT p_brand AS n_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand")
def a6_min_max(c):
    return select(Part).aggregate(min_(Part.price).as_("low"), max_(Part.price).as_("high"), group_by="n.brand")


@query("SELECT r_name AS r_name, list_sort(list(n_name)) AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def a7_collect(c):
    df = select(Nation).alias("n").traverse(Nation.region, optional=False).alias("r").aggregate(collect(Nation.name).as_("names"), group_by="r.name").to_df(c)
    return df.select("`r.name`", F.array_sort("names").alias("names"))


@query("SELECT c_mktsegment AS c_segment, list_sort(list(DISTINCT n_name)) AS nations FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment")
def a7_collect_distinct(c):
    df = select(Customer).alias("c").traverse(Customer.nation, optional=False).alias("n").aggregate(collect("n.name", distinct=True).as_("nations"), group_by="c.segment").to_df(c)
    return df.select("`c.segment`", F.array_sort("nations").alias("nations"))


@query("SELECT o_orderpriority AS n_priority, count(*) AS n, round(sum(o_totalprice), 2) AS revenue, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderpriority")
def a10_multi_agg(c):
    df = select(Order).aggregate(count().as_("n"), sum_(Order.price).as_("revenue"), min_(Order.price).as_("low"), max_(Order.price).as_("high"), group_by="n.priority").to_df(c)
    return df.withColumn("revenue", F.round("revenue", 2))


@query("SELECT c_custkey AS key, c_name AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def a11_group_alias(c):
    df = select(Customer).alias("c").traverse(Customer.orders).alias("o").aggregate(count(Order.key).as_("n"), group_by="c").to_df(c)
    return df.select("c.key", "c.name", "n")


@query("SELECT c_mktsegment AS c_segment, o_orderstatus AS o_status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def a11_group_two_props(c):
    return select(Customer).alias("c").traverse(Customer.orders, optional=False).alias("o").aggregate(count().as_("n"), group_by="c.segment, o.status")


@query("SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 150000")
def a13_count_terminal(c):
    return count_query(select(Customer).alias("c").traverse(Customer.orders, optional=False).alias("o").where(Order.price > 150000).order_by(Order.key).limit(3).spec, c)


# --- search

WORDS = "string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')"


@query(f"SELECT doc_id AS n_key FROM documents WHERE list_has_all({WORDS}, ['license', 'licensed'])")
def f1_fulltext_all(c):
    return ks(select(Document), FulltextSource("Licensed license")).project(Document.key)


@query(f"SELECT doc_id AS n_key, n_chars AS n_n_chars FROM documents WHERE list_has_any({WORDS}, ['gpl', 'mit', 'apache']) AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10")
def f1_fulltext_where_order(c):
    return ks(select(Document), FulltextSource("gpl mit apache", mode="any")).where(Document.lang == "en").project(Document.key, Document.n_chars).order_by(Document.n_chars, desc=True).order_by(Document.key).limit(10)


PROBE = tuple(((7 * i) % 13 - 6) / 16 for i in range(64))
_V = "[" + ", ".join(str(x) for x in PROBE) + "]::DOUBLE[]"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(F.col("`n.key`").alias("key"), F.round("__score", 9).alias("score"))


@query(f"SELECT vec_id AS key, round(list_distance(embedding::DOUBLE[], {_V}), 9) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_V}), vec_id LIMIT 12")
def v1_knn_l2(c):
    return _rounded(ks(select(Item), VectorSource("embedding", PROBE, 12)).project(Item.key).order_by(Item.key).to_df(c))


@query(f"SELECT vec_id AS key, round(list_distance(embedding::DOUBLE[], {_V}), 9) AS score FROM embeddings WHERE label < 3 ORDER BY list_distance(embedding::DOUBLE[], {_V}), vec_id LIMIT 10")
def v1_knn_prefilter(c):
    return _rounded(ks(select(Item), VectorSource("embedding", PROBE)).where(Item.label < 3).project(Item.key).order_by(Item.key).to_df(c))


@query(f"SELECT vec_id AS key, round(list_cosine_distance(embedding::DOUBLE[], {_V}), 9) AS score FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_V}), vec_id LIMIT 10")
def v1_knn_cosine(c):
    return _rounded(ks(select(Item), VectorSource("embedding", PROBE, 10, "cosine")).project(Item.key).order_by(Item.key).to_df(c))


# --- writes, as the state that they leave


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, upper(n_name) FROM nation WHERE n_nationkey < 5")
def w1_create(c):
    new = c.nodes("Nation").filter("key < 5").select((F.col("key") + 100).alias("key"), F.upper("name").alias("name"))
    return mutate.create_nodes(c, "Region", new).nodes("Region").select("key", "name")


@query("SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN 'big ' || p_brand ELSE p_brand END AS brand, p_retailprice AS price FROM part")
def w2_update(c):
    changes = c.nodes("Part").select("key", F.when(F.col("size") > 25, F.concat(F.lit("big "), "brand")).alias("brand"))
    return mutate.update_nodes(c, "Part", changes, "key").nodes("Part").select("key", "brand", "price")


EDGE_COUNTS = {
    "IN_REGION": "nation", "FROM_NATION": "customer WHERE c_acctbal >= 0", "BASED_IN": "supplier", "PLACED": "orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0", "CONTAINS": "lineitem", "SHIPPED_BY": "lineitem", "DID": "events",
    "HAS_LABEL": "labels", "REPLIES_TO": "conversations WHERE turn > 0", "RING": "range(50)", "NEXT": "(SELECT lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL",
}


@query("SELECT 'Customer' AS what, count(*) AS n FROM customer WHERE c_acctbal >= 0 " + " ".join(f"UNION ALL SELECT '{k}', count(*) FROM {v}" for k, v in EDGE_COUNTS.items()))
def w3_detach_delete(c):
    gone = c.nodes("Party").filter(F.array_contains("_labels", "Customer") & (F.col("balance") < 0)).select("_id")
    out = mutate.detach_delete(c, "Party", gone)
    n = lambda what, df: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    left = n("Customer", out.nodes("Party").filter(F.array_contains("_labels", "Customer")))
    return functools.reduce(DataFrame.union, (n(name, out.edges(name)) for name in out.edge_tables.keys()), left)


def _likes(c: Catalog) -> tuple[Catalog, DataFrame]:
    """Edges LIKES from customers to their nation, if its key is below 15; and rows for those whose nation's is 10 or more."""
    e, nation = c.edges("FROM_NATION"), F.col("_dst") % (1 << 44)
    base = e.filter(nation < 15).withColumn("weight", F.lit(1))
    rows = e.filter(nation >= 10).select("_src", "_dst", F.lit(2).alias("weight"))
    return c.with_edges("LIKES", base), rows


@query("SELECT c_custkey AS customer, CASE WHEN c_nationkey >= 10 THEN 2 ELSE 1 END AS weight FROM customer")
def w4_merge(c):
    have, rows = _likes(c)
    out = mutate.merge_edges(have, "LIKES", rows).edges("LIKES")
    return out.select((F.col("_src") % (1 << 44)).alias("customer"), "weight")


@query("SELECT c_custkey AS customer FROM customer WHERE c_nationkey < 10")
def w5_unrelate(c):
    have, rows = _likes(c)
    return mutate.delete_edges(have, "LIKES", rows).edges("LIKES").select((F.col("_src") % (1 << 44)).alias("customer"))


@query("SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey >= 20 THEN 'last ' || n_nationkey ELSE n_name END AS name FROM nation UNION ALL SELECT k, 'last ' || k FROM range(25, 30) t(k)")
def w6_seed_upsert(c):
    rows = c.spark.range(20).select((20 + F.col("id") % 10).alias("key"), F.concat(F.when(F.col("id") < 10, "first ").otherwise("last "), 20 + F.col("id") % 10).alias("name"), F.col("id").alias("at"))
    return mutate.upsert_nodes(c, "Nation", rows, "key", order="at").nodes("Nation").select("key", "name")


@query("SELECT p_partkey AS key, p_type AS category, NULL::VARCHAR AS kind FROM part")
def w7_rename_property(c):
    return mutate.rename_property(c, "Part", "kind", "category").nodes("Part").select("key", "category", "kind")


@query("SELECT c_custkey AS key, 'Client' AS label FROM customer")
def w8_relabel(c):
    out = mutate.relabel_nodes(c, "Customer", "Client").nodes("Party")
    return out.filter(F.array_contains("_labels", "Client")).select("key", F.element_at("_labels", -1).alias("label"))


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def x4_unique_violations(c):
    from nodeweave.sources.constraints import violations

    ends = c.edges("PLACED").select((F.col("_src") % (1 << 44)).alias("key"))
    return violations(ends, "UNIQUE", ("key",))


@query("SELECT d.doc_id AS key FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def x4_mandatory_violations(c):
    from nodeweave.sources.constraints import violations

    df = select(Document).alias("d").traverse(Document.label).alias("l").project(Document.key, Label.quality).to_df(c).toDF("key", "quality")
    return violations(df, "MANDATORY", ("quality",)).select("key")


# --- Cypher


def cypher(c: Catalog, text: str, params: dict | None = None) -> DataFrame:
    from nodeweave.cypher import run

    return run(c, text, params)


def written(c: Catalog, text: str) -> Catalog:
    """The catalog that a writing query leaves."""
    from nodeweave.cypher.execute import Execution

    done = Execution(c)
    done.run(text)
    return done.catalog


@query("SELECT c_name AS c_name, o_totalprice AS o_price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 200000")
def c1_cypher_match_return(c):
    from nodeweave.cypher import run

    return run(c, "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.segment = $s AND o.price > 200000 RETURN c.name, o.price", {"s": "MACHINERY"})


@query("SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def c2_cypher_group_count(c):
    from nodeweave.cypher import run

    return run(c, "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(c) AS customers")


@query("SELECT p_partkey AS key, p_retailprice AS price FROM part WHERE p_size IN (1, 2, 3) ORDER BY p_retailprice DESC, p_partkey LIMIT 7 OFFSET 2")
def c3_cypher_order_limit_param(c):
    from nodeweave.cypher import run

    return run(c, "MATCH (p:Part) WHERE p.size IN $sizes RETURN p.key AS key, p.price AS price ORDER BY price DESC, key SKIP $skip LIMIT 7", {"sizes": [1, 2, 3], "skip": 2})


@query("SELECT d.doc_id AS key, l.quality AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0 WHERE d.lang = 'de'")
def c4_cypher_optional_where(c):
    from nodeweave.cypher import run

    return run(c, "MATCH (d:Document {lang: 'de'}) OPTIONAL MATCH (d)-[:HAS_LABEL]->(l:Label) WHERE l.toxic = 0 RETURN d.key AS key, l.quality AS quality")


@query(f"{TRAILS} SELECT a AS a, b AS b, count(*) AS n FROM p WHERE a < 3 AND len(trail) >= 2 GROUP BY ALL")
def c5_cypher_varlen(c):
    from nodeweave.cypher import run

    return run(c, "MATCH (a:Nation)-[:RING*2..4]->(b:Nation) WHERE a.key < 3 RETURN a.key AS a, b.key AS b, count(*) AS n")


@query("SELECT conv_id * 1000 + turn AS a, conv_id * 1000 + turn - d AS b, count(*) AS n FROM conversations, range(2, 5) t(d) WHERE turn >= d GROUP BY ALL")
def c5_cypher_varlen_whole(c):
    return cypher(c, "MATCH (a:Turn)-[:REPLIES_TO*2..4]->(b:Turn) RETURN a.key AS a, b.key AS b, count(*) AS n")


@query("SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier")
def c6_cypher_union(c):
    return cypher(c, "MATCH (c:Customer) RETURN c.name AS name UNION MATCH (s:Supplier) RETURN s.name AS name")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def c6_cypher_union_all(c):
    return cypher(c, "MATCH (n:Nation) RETURN n.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name")


@query("SELECT n_name AS name, x AS x FROM nation JOIN (VALUES (1, 'one'), (3, 'three'), (99, 'none')) t(k, x) ON k = n_nationkey")
def s13_unwind_rows(c):
    return cypher(c, "UNWIND $rows AS r MATCH (n:Nation) WHERE n.key = r.k RETURN n.name AS name, r.x AS x", {"rows": [{"k": 1, "x": "one"}, {"k": 3, "x": "three"}, {"k": 99, "x": "none"}]})


@query("""SELECT p_partkey AS key, upper(p_name) AS up, lower(p_brand) AS low, length(p_type) AS n, substring(p_name, 1, 4) AS part, replace(p_brand, 'Brand', 'B') AS brand, reverse(p_name) AS back, trim('  ' || p_name) AS bare,
coalesce(p_name, '') AS name, abs(p_size - 25) AS off, floor(p_retailprice)::BIGINT AS low_price, ceil(p_retailprice)::BIGINT AS high_price, p_size::BIGINT AS size, p_size::DOUBLE AS exact, p_size::VARCHAR AS shown, sqrt(16.0::DOUBLE) AS root FROM part""")
def c7_cypher_scalars(c):
    return cypher(c, """MATCH (p:Part) RETURN p.key AS key, toUpper(p.name) AS up, toLower(p.brand) AS low, length(p.kind) AS n, substring(p.name, 0, 4) AS part, replace(p.brand, 'Brand', 'B') AS brand, reverse(p.name) AS back,
    trim('  ' + p.name) AS bare, coalesce(p.name, '') AS name, abs(p.size - 25) AS off, floor(p.price) AS low_price, ceil(p.price) AS high_price, toInteger(toString(p.size)) AS size, toFloat(p.size) AS exact, toString(p.size) AS shown, sqrt(16.0) AS root""")  # fmt: skip


@query("SELECT c_custkey AS key, 2::BIGINT AS n, 'Party' AS first, 'Customer' AS last, c_custkey + 2 * 17592186044416 AS id, 7.5::DOUBLE AS north, true AS now FROM customer")
def c7_cypher_entities(c):
    return cypher(c, "MATCH (c:Customer) WITH c, labels(c) AS l, point({latitude: 7.5, longitude: 1}) AS p RETURN c.key AS key, size(l) AS n, head(l) AS first, last(l) AS last, id(c) AS id, p.latitude AS north, timestamp() > 0 AS now")


@query("SELECT n_name AS nation, r_name AS region FROM nation, region WHERE n_nationkey = 3 AND r_regionkey = 2")
def j9_two_matches(c):
    return cypher(c, "MATCH (n:Nation {key: 3}), (r:Region {key: 2}) RETURN n.name AS nation, r.name AS region")


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region UNION ALL SELECT 900, 'NEW'")
def w9_cypher_create(c):
    return written(c, "CREATE (r:Region {key: 900, name: 'NEW'})").nodes("Region").select("key", "name")


@query("SELECT p_partkey AS key, CASE WHEN p_size > 40 THEN 'BIG' ELSE p_brand END AS brand, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS kind FROM part")
def w9_cypher_set_remove(c):
    out = written(c, "MATCH (p:Part) WHERE p.size > 40 SET p.brand = 'BIG' REMOVE p.kind")
    return out.nodes("Part").select("key", "brand", "kind")


@query("SELECT 'orders' AS what, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'placed', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'contains', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'")
def w9_cypher_detach_delete(c):
    out = written(c, "MATCH (o:Order) WHERE o.status = 'P' DETACH DELETE o")
    n = lambda what, df: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return n("orders", out.nodes("Order")).union(n("placed", out.edges("PLACED"))).union(n("contains", out.edges("CONTAINS")))


@query("SELECT r_regionkey::BIGINT AS key, CASE WHEN r_regionkey = 1 THEN 'seen' ELSE r_name END AS name FROM region UNION ALL SELECT 901, 'made'")
def w9_cypher_merge(c):
    once = written(c, "MERGE (r:Region {key: 1}) ON MATCH SET r.name = 'seen' ON CREATE SET r.name = 'made'")
    return written(once, "MERGE (r:Region {key: 901}) ON MATCH SET r.name = 'seen' ON CREATE SET r.name = 'made'").nodes("Region").select("key", "name")


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def r1_default_return(c):
    return select(Nation).to_df(c).select("n.key", "n.name")


@query("SELECT s_suppkey AS n_key FROM supplier")
def p8_is_null(c):
    return select(Party).where(Customer.segment.is_null()).project(Party.key)


@query("SELECT c_custkey AS n_key FROM customer WHERE c_mktsegment <> 'BUILDING'")
def p8_is_not_null(c):
    return select(Party).where(Customer.segment.is_not_null() & (Customer.segment != "BUILDING")).project(Party.key)


@query("SELECT vec_id AS n_key FROM embeddings WHERE embedding = (SELECT min(embedding) FROM embeddings)")
def v3_vector_equality(c):
    least = c.nodes("Item").agg(F.min("embedding")).first()[0]
    return select(Item).where(Item.embedding == least).project(Item.key)


@query("SELECT c_mktsegment AS n_segment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 3")
def o7_order_after_aggregate(c):
    return select(Customer).aggregate(count().as_("n"), group_by="n.segment").order_by("n DESC").order_by("n.segment").limit(3)


@query("SELECT conv_id * 1000 + turn AS a_key, conv_id * 1000 + turn - 1 AS b_key FROM conversations WHERE turn > 0 UNION ALL SELECT conv_id * 1000 + turn - 1, conv_id * 1000 + turn FROM conversations WHERE turn > 0")
def j3_both_hop_whole(c):
    return select(Turn).alias("a").traverse(Turn.beside, optional=False).alias("b").project("a.key", "b.key")


@query("""SELECT t.conv_id * 1000 + t.turn AS a_key, u.conv_id * 1000 + u.turn AS b_key FROM conversations t JOIN conversations u ON u.conv_id = t.conv_id AND abs(u.turn - t.turn) BETWEEN 1 AND 3""")
def j6_varlen_both_whole(c):
    return select(Turn).alias("a").repeat(Turn.beside, 1, 3).alias("b").project("a.key", "b.key")


@query("SELECT t.conv_id * 1000 + t.turn AS a_key, u.conv_id * 1000 + u.turn AS b_key FROM conversations t JOIN conversations u ON u.conv_id = t.conv_id AND u.turn < t.turn")
def j6_reachability_whole(c):
    return select(Turn).alias("a").repeat(Turn.replies_to).alias("b").distinct().project("a.key", "b.key")


@query("SELECT event_id AS e_key, nxt AS f_key FROM (SELECT event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND event_type = 'click'")
def j2_event_next(c):
    return select(Event).alias("e").where(Event.kind == "click").traverse(Event.next, optional=False).alias("f").project("e.key", "f.key")


# --- schemas and revisions, as rows


@query("""SELECT * FROM (VALUES (0, 'op.drop_constraint(''UNIQUE'', ''NODE'', ''A'', (''x'',))'), (1, 'op.drop_range_index(''A'', ''x'')'),
(2, 'op.create_range_index(''A'', ''y'')'), (3, 'op.create_fulltext_index(''A'', ''t'', stopwords=[''the''])')) t("at", operation)""")
def x10_manifest_diff(c):
    from nodeweave.migrate.manifest import FulltextIndex, RangeIndex, SchemaManifest, UniqueConstraint, diff

    live = SchemaManifest([RangeIndex("A", "x")], constraints=[UniqueConstraint("NODE", "A", ("x",))])
    up, _ = diff(live, SchemaManifest([RangeIndex("A", "y")], [FulltextIndex("A", ("t",), stopwords=("the",))]))
    return c.spark.createDataFrame([(i, o.render()) for i, o in enumerate(up)], "at int, operation string")


@query("""SELECT * FROM (VALUES (0, 'b'), (1, 'c'), (2, 'd'), (3, 'e')) t("at", revision)""")
def m3_topological_path(c):
    from pathlib import Path

    from nodeweave.migrate.scripts import Revision, ScriptDirectory

    parents = {"a": (), "b": ("a",), "c": ("a",), "d": ("b", "c"), "e": ("d",)}
    scripts = ScriptDirectory(Path(), {r: Revision(r, down, "", Path(), None) for r, down in parents.items()})
    return c.spark.createDataFrame(list(enumerate(scripts.upgrade_path({"a"}))), "at int, revision string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over 100,000 of each customer of one segment, and their revenue."""
    c = catalog(spark, sf_dir)
    stmt = (
        select(Customer).alias("c").where(Customer.segment == "BUILDING").traverse(Customer.orders, edge_alias="e", optional=False).alias("o").where(Order.price > 100000, on="o")
        .aggregate(count("*").as_("n"), sum_(Order.price).as_("revenue"), group_by="c.name")
    )
    return plain(stmt.to_df(c)).withColumn("revenue", F.round("revenue", 2))


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = "SELECT c_name AS c_name, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000 GROUP BY c_name"
