import pytest
from graphs import City, Country, Place, Status, Text, Writer, Wrote, store

from nodeweave import Session, avg, collect, count, max_, min_, select, sum_
from nodeweave.exceptions import MetadataError


@pytest.fixture(scope="module")
def session(spark):
    return Session(store(spark))


def ids(entities):
    return sorted(e.id for e in entities)


def test_predicates(session):
    q = lambda p: ids(session.scalars(select(Writer).where(p)))
    assert q(Writer.name == "Bob") == ["bob"]
    assert q(Writer.age > 28) == ["alice", "carol"]
    assert q((Writer.age <= 25) | (Writer.name.startswith("D"))) == ["bob", "dan"]
    assert q(~(Writer.active == True)) == ["carol"]  # noqa: E712
    assert q(Writer.name.matches("[AB].*")) == ["alice", "bob"]
    assert q(Writer.name.matches("li")) == []
    assert q(Writer.name.contains("a") & Writer.name.endswith("n")) == ["dan"]
    assert q(Writer.id.in_([])) == []
    assert q(Writer.id.not_in_(["bob", "dan"])) == ["alice", "carol"]
    assert q(Writer.age == None) == []  # noqa: E711
    assert q(Writer.age != None) == ["alice", "bob", "carol", "dan"]  # noqa: E711


def test_predicate_has_no_truth():
    with pytest.raises(TypeError):
        bool(Writer.age > 3)


def test_converters(session):
    t = session.scalar(select(Text).where(Text.status == Status.PUBLISHED))
    assert (t.id, t.status, t.tags, t.place.latitude, list(t.embedding)) == ("t1", Status.PUBLISHED, ["graph", "database"], 1.5, [1, 0, 0])
    assert ids(session.scalars(select(Text).where(Text.status.in_([Status.DRAFT])))) == ["t2", "t3"]


def test_traversals(session):
    base = lambda: select(Writer).alias("u").where(Writer.id == "alice")
    assert ids(session.scalars(base().traverse(Writer.friends).alias("f").return_target("f"))) == ["bob", "carol"]
    stmt = base().traverse(Writer.friends).alias("f").where(Writer.active == True, on="f")  # noqa: E712
    assert ids(session.scalars(stmt)) == ["bob"]
    assert ids(session.scalars(base().traverse(Writer.friends).alias("f").traverse(Writer.friends, optional=False).alias("g"))) == ["dan"]
    assert ids(session.scalars(select(Writer).where(Writer.id == "bob").traverse(Writer.staff).alias("s"))) == ["dan"]


def test_optional_predicate_keeps_rows(session):
    stmt = select(Writer).alias("u").traverse(Writer.friends).alias("f").where(Writer.age > 30, on="f").project("u.id", "f.id")
    rows = {(r["u.id"], r["f.id"]) for r in session.all_rows(stmt)}
    assert rows == {("alice", "carol"), ("bob", None), ("carol", None), ("dan", None)}
    assert session.count(stmt) == 4
    assert ids(session.scalars(select(Writer).alias("u").traverse(Writer.friends).alias("f").where(Writer.age > 30, on="f"))) == ["carol"]


@pytest.mark.parametrize("high", [2, 3, None])
def test_managers_of_dan(session, high):
    assert ids(session.scalars(select(Writer).where(Writer.id == "dan").repeat(Writer.boss, 1, high).alias("m"))) == ["alice", "bob"]


def test_edges(session):
    rows = session.all_with_edges(select(Writer).alias("w").traverse(Writer.texts, edge_alias="e", optional=False).alias("t").where(Wrote.year >= 2021, on="e"))
    assert [(w.id, e.year, t.id) for w, e, t in rows] == [("bob", 2021, "t2")]


def test_aggregates(session):
    row = session.all_rows(select(Writer).aggregate(count().as_("n"), avg(Writer.age).as_("mean"), sum_(Writer.age).as_("sum"), min_(Writer.age).as_("low"), max_(Writer.age).as_("high")))[0]
    assert row == {"n": 4, "mean": 29.5, "sum": 118, "low": 25, "high": 35}
    rows = session.all_rows(select(Writer).alias("w").traverse(Writer.texts).alias("t").aggregate(count(Text.id).as_("n"), collect(Text.id).as_("ids"), group_by="w"))
    assert {r["w"].id: (r["n"], sorted(r["ids"])) for r in rows} == {"alice": (1, ["t1"]), "bob": (2, ["t2", "t3"]), "carol": (0, []), "dan": (0, [])}
    assert session.all_rows(select(Writer).where(Writer.age > 99).aggregate(sum_(Writer.age).as_("s"), collect(Writer.id).as_("c"))) == [{"s": 0, "c": []}]


def test_order_page_distinct(session):
    assert [w.id for w in session.scalars(select(Writer).order_by(Writer.age, desc=True).skip(1).limit(2))] == ["alice", "dan"]
    rows = session.all_rows(select(Writer).alias("w").traverse(Writer.texts, edge_alias="e", optional=False).alias("t").project(Wrote.year).order_by("e.year DESC"))
    assert [r["e.year"] for r in rows] == [None, 2021, 2020]
    assert sorted(r["n.active"] for r in session.all_rows(select(Writer).distinct().project(Writer.active))) == [False, True]
    assert session.query(Writer).order_by(Writer.id).one().id == "alice"
    assert session.query(Writer).limit(1).count() == 4


def test_search(session):
    assert ids(session.fulltext_search(Text, query="graphs").all()) == ["t1", "t2"]
    assert ids(session.fulltext_search(Text, query="GRAPHS cypher").all()) == ["t2"]
    assert ids(session.fulltext_search(Text, query="graphs tips", mode="any").all()) == ["t1", "t2", "t3"]
    assert [t.id for t in session.vector_search(Text, field="embedding", vector=[1, 0, 0], k=2).all()] == ["t1", "t3"]
    assert [t.id for t in session.vector_search(Text, field="embedding", vector=[1, 0, 0], k=2).where(Text.status == Status.DRAFT).all()] == ["t3", "t2"]
    assert session.vector_search(Text, field="embedding", vector=[1, 0, 0], k=1).count() == 3


def test_polymorphism(spark):
    from nodeweave import MemoryStore

    s = MemoryStore(spark)
    with Session(s) as w:
        w.add_all([City(id="p", title="Paris", population=2), Country(id="f", title="France", code="FR"), Place(id="x", title="Somewhere")])
    r = Session(s)
    assert {type(e) for e in r.scalars(select(Place))} == {City, Country, Place}
    assert ids(r.scalars(select(City))) == ["p"]
    assert ids(r.scalars(select(City).where(City.title == "Paris"))) == ["p"]


def test_misuse(session):
    with pytest.raises(RuntimeError):
        select(Writer).all()
    with pytest.raises(TypeError):
        select(Writer).traverse("friends")
    with pytest.raises(MetadataError):
        session.scalars(select(Writer).where(Text.title == "x"))
    with pytest.raises(MetadataError):
        select(Writer).alias("a").traverse(Writer.friends).alias("a")


def test_carried_aliases(session):
    stmt = select(Writer).alias("u").where(Writer.age < 29).with_("u").traverse(Writer.texts, optional=False).alias("t").project("u.id", "t.id").order_by("t.id")
    assert [(r["u.id"], r["t.id"]) for r in session.all_rows(stmt)] == [("bob", "t2"), ("bob", "t3")]
    with pytest.raises(MetadataError):
        session.all_rows(select(Writer).alias("u").with_("x").traverse(Writer.texts).alias("t"))


def test_known_ends_skip_the_target(spark):
    from nodeweave.sources.tables import Customer, catalog

    c = catalog(spark, "/root/testdata/sf0.001")
    plan = select(Customer).alias("c").traverse(Customer.orders, optional=False).alias("o").aggregate(count().as_("n"), group_by="c.key").to_df(c)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2
    assert sum(r["n"] for r in plan.collect()) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
