"""A graph view over relational tables: nodes from rows, edges from foreign keys.

Ids are keys moved into a range of their own for each label. No table is copied: the views are projections of the scans,
so filters on properties and the choice of columns reach Parquet.
"""

from __future__ import annotations

import enum
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.model import Edge, Field, Node, Relation, Vector
from nodeweave.sources.catalog import Catalog, Tables

RANGE = 1 << 44


class Region(Node):
    key: int = Field(primary_key=True)
    name: str


class Nation(Node):
    key: int = Field(primary_key=True)
    name: str
    region = Relation("IN_REGION", target="Region")
    customers: list = Relation("FROM_NATION", "INCOMING", "Customer")
    ring: list = Relation("RING", target="Nation")
    ring_both: list = Relation("RING", "BOTH", "Nation")


class LineItem(Edge, type="CONTAINS"):
    line: int
    quantity: float
    price: float
    discount: float
    tax: float
    returnflag: str
    linestatus: str
    shipdate: datetime


class Party(Node):
    key: int
    name: str
    balance: float


class Customer(Party, labels=["Party", "Customer"]):
    key: int
    name: str
    balance: float
    segment: str
    orders: list = Relation("PLACED", target="Order")
    nation = Relation("FROM_NATION", target="Nation")


class Supplier(Party, labels=["Party", "Supplier"]):
    key: int
    name: str
    balance: float
    nation = Relation("BASED_IN", target="Nation")
    shipped: list = Relation("SHIPPED_BY", "INCOMING", "Order")


class Part(Node):
    key: int = Field(primary_key=True)
    name: str
    brand: str
    kind: str
    size: int
    price: float
    orders: list = Relation("CONTAINS", "INCOMING", "Order", edge_model=LineItem)


class OrderStatus(enum.Enum):
    FINISHED = "F"
    OPEN = "O"
    PARTIAL = "P"


class Order(Node):
    key: int = Field(primary_key=True)
    status: OrderStatus
    price: float
    date: datetime
    priority: str
    customer = Relation("PLACED", "INCOMING", "Customer")
    parts: list = Relation("CONTAINS", target="Part", edge_model=LineItem)
    suppliers: list = Relation("SHIPPED_BY", target="Supplier", edge_model=LineItem)


class User(Node):
    key: int = Field(primary_key=True)
    events: list = Relation("DID", target="Event")


class Event(Node):
    key: int = Field(primary_key=True)
    ts: datetime
    kind: str
    value: float
    props: str
    next = Relation("NEXT", target="Event")


class Label(Node):
    key: int = Field(primary_key=True)
    quality: int
    toxic: int


class Document(Node):
    key: int = Field(primary_key=True)
    text: str = Field(index_type="FULLTEXT")
    lang: str
    source: str
    n_chars: int
    label = Relation("HAS_LABEL", target="Label")


class Turn(Node):
    key: int = Field(primary_key=True)
    conv: int
    turn: int
    role: str
    text: str = Field(index_type="FULLTEXT")
    replies_to = Relation("REPLIES_TO", target="Turn")
    replies: list = Relation("REPLIES_TO", "INCOMING", "Turn")
    beside: list = Relation("REPLIES_TO", "BOTH", "Turn")


class Item(Node):
    key: int = Field(primary_key=True)
    embedding: Vector = Field(index_type="VECTOR")
    label: int


LABELS = ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "User", "Event", "Label", "Document", "Turn", "Item")


def gid(label: str, key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("bigint") + F.lit(LABELS.index(label) * RANGE)


def nodes(df: DataFrame, label: str, key: str, columns: dict[str, str], labels: tuple[str, ...] = ()) -> DataFrame:
    shown = F.array(*(F.lit(x) for x in labels or (label,)))
    return df.select(gid(label, key).alias("_id"), shown.alias("_labels"), F.col(key).cast("bigint").alias("key"), *(F.col(v).alias(k) for k, v in columns.items()))


def edges(df: DataFrame, src: Column, dst: Column, properties: dict[str, str] | None = None, eid: Column | None = None) -> DataFrame:
    return df.select((F.monotonically_increasing_id() if eid is None else eid).alias("_eid"), src.alias("_src"), dst.alias("_dst"), *(F.col(v).alias(k) for k, v in (properties or {}).items()))


def ring(spark: SparkSession, n: int = 25) -> DataFrame:
    """Nation k to (k + 1) % n and to 7 * k % n: with cycles, a loop and a parallel pair."""
    k = F.col("id")
    both = spark.range(n).select(k, F.posexplode(F.array((k + 1) % n, (k * 7) % n)).alias("series", "to"))
    return edges(both, gid("Nation", k), gid("Nation", F.col("to")), eid=(k * 2 + F.col("series")).cast("bigint"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    line = {"line": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate"}

    def party() -> DataFrame:
        own = {"name": "name", "balance": "balance", "segment": "segment"}
        c = read("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
        s = read("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit(None).cast("string").alias("segment"))
        return nodes(c, "Customer", "key", own, ("Party", "Customer")).unionByName(nodes(s, "Supplier", "key", own, ("Party", "Supplier")))

    def turns() -> DataFrame:
        return read("conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))

    def follows() -> DataFrame:
        by = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return read("events").select("event_id", F.lead("event_id").over(by).alias("then")).filter("then IS NOT NULL")

    node_tables = Tables({
        "Region": lambda: nodes(read("region"), "Region", "r_regionkey", {"name": "r_name"}),
        "Nation": lambda: nodes(read("nation"), "Nation", "n_nationkey", {"name": "n_name"}),
        "Party": party,
        "Part": lambda: nodes(read("part"), "Part", "p_partkey", {"name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}),
        "Order": lambda: nodes(read("orders"), "Order", "o_orderkey", {"status": "o_orderstatus", "price": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"}),
        "User": lambda: nodes(read("events").select("user_id").distinct(), "User", "user_id", {}),
        "Event": lambda: nodes(read("events"), "Event", "event_id", {"ts": "ts", "kind": "event_type", "value": "value", "props": "props"}),
        "Label": lambda: nodes(read("labels"), "Label", "doc_id", {"quality": "quality", "toxic": "toxic"}),
        "Document": lambda: nodes(read("documents"), "Document", "doc_id", {"text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}),
        "Turn": lambda: nodes(turns(), "Turn", "key", {"conv": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
        "Item": lambda: nodes(read("embeddings"), "Item", "vec_id", {"embedding": "embedding", "label": "label"}),
    })
    edge_tables = Tables({
        "IN_REGION": lambda: edges(read("nation"), gid("Nation", "n_nationkey"), gid("Region", "n_regionkey"), eid=F.col("n_nationkey").cast("bigint")),
        "FROM_NATION": lambda: edges(read("customer"), gid("Customer", "c_custkey"), gid("Nation", "c_nationkey"), eid=F.col("c_custkey")),
        "BASED_IN": lambda: edges(read("supplier"), gid("Supplier", "s_suppkey"), gid("Nation", "s_nationkey"), eid=F.col("s_suppkey")),
        "PLACED": lambda: edges(read("orders"), gid("Customer", "o_custkey"), gid("Order", "o_orderkey"), eid=F.col("o_orderkey")),
        "CONTAINS": lambda: edges(read("lineitem"), gid("Order", "l_orderkey"), gid("Part", "l_partkey"), line),
        "SHIPPED_BY": lambda: edges(read("lineitem"), gid("Order", "l_orderkey"), gid("Supplier", "l_suppkey"), line),
        "DID": lambda: edges(read("events"), gid("User", "user_id"), gid("Event", "event_id"), eid=F.col("event_id")),
        "NEXT": lambda: edges(follows(), gid("Event", "event_id"), gid("Event", "then"), eid=F.col("event_id")),
        "HAS_LABEL": lambda: edges(read("labels"), gid("Document", "doc_id"), gid("Label", "doc_id"), eid=F.col("doc_id")),
        "REPLIES_TO": lambda: edges(turns().filter("turn > 0"), gid("Turn", "key"), gid("Turn", F.col("key") - 1), eid=F.col("key")),
        "RING": lambda: ring(spark),
    })
    # Rows that are both the edge and its end: that end is there by construction.
    complete = frozenset({("PLACED", "", "Order"), ("FROM_NATION", "Party", ""), ("BASED_IN", "Party", ""), ("IN_REGION", "Nation", ""), ("DID", "User", "Event"), ("NEXT", "Event", "Event"), ("HAS_LABEL", "", "Label"), ("REPLIES_TO", "Turn", "")})
    return Catalog(spark, node_tables, edge_tables, complete=complete)
