import asyncio

import pytest
from graphs import Counter, Status, Text, Writer, Wrote, store

from nodeweave import AsyncSession, MemoryStore, ParquetStore, Repository, Session, select
from nodeweave.exceptions import ConflictError, ConstraintFailedError, DetachedEntityError, LazyLoadError, MetadataError
from nodeweave.migrate import GraphOperations


@pytest.fixture(params=["memory", "parquet"])
def graph(request, spark, tmp_path):
    return MemoryStore(spark) if request.param == "memory" else ParquetStore(spark, f"file://{tmp_path}")


def test_crud(graph):
    with Session(graph) as s:
        s.add(Writer(id="a", name="Ann"))
    with Session(graph) as s:
        a = s.get(Writer, "a")
        assert s.get(Writer, "a") is a
        a.name, a.age = "Anne", 41
    with Session(graph) as s:
        a = s.get(Writer, "a")
        assert (a.name, a.age, a.active) == ("Anne", 41, True)
        a.age = None  # a null does not clear
    with Session(graph) as s:
        a = s.get(Writer, "a")
        assert a.age == 41
        s.delete(a)
    with Session(graph) as s:
        assert s.get(Writer, "a") is None and s.count(select(Writer)) == 0


def test_rollback_and_generated_ids(graph):
    s = Session(graph)
    s.add(Counter(label="x"))
    s.flush()
    assert s.count(select(Counter)) == 1
    s.rollback()
    assert s.count(select(Counter)) == 0
    a, b = Counter(label="a"), Counter(label="b")
    s.add_all([a, b])
    s.commit()
    assert a.id != b.id
    assert Session(graph).get(Counter, b.id).label == "b"


def test_conflict(graph):
    one, two = Session(graph), Session(graph)
    one.add(Counter(label="1"))
    two.add(Counter(label="2"))
    one.flush()
    two.flush()
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()


def test_constraints(graph):
    with Session(graph) as s:
        s.add_all([Writer(id="a", name="x"), Writer(id="b", name="y")])
    ops = GraphOperations(graph)
    ops.create_constraint("UNIQUE", "NODE", "Writer", ["name"])
    s = Session(graph)
    s.add(Writer(id="c", name="x"))
    with pytest.raises(ConstraintFailedError):
        s.commit()
    assert Session(graph).count(select(Writer)) == 2
    with pytest.raises(ConstraintFailedError):
        ops.create_constraint("MANDATORY", "NODE", "Writer", ["age"])


def test_relations(spark):
    g = store(spark)
    s = Session(g)
    alice = s.get(Writer, "alice")
    assert sorted(f.id for f in alice.friends) == ["bob", "carol"]
    assert alice.boss is None and s.get(Writer, "bob").boss is alice
    eager = Session(g).get(Writer, "bob", fetch=["texts", "boss", "unknown"])
    assert [t.id for t in eager.__dict__["texts"]] == ["t2", "t3"] and eager.__dict__["boss"].id == "alice"
    s.relate(alice, Writer.texts, s.get(Text, "t1"), Wrote(year=2022))
    assert [e.year for _, e, _ in s.all_with_edges(select(Writer).where(Writer.id == "alice").traverse(Writer.texts, edge_alias="e", optional=False).alias("t"))] == [2022]
    s.unrelate(alice, Writer.friends, s.get(Writer, "carol"))
    assert [f.id for f in alice.friends] == ["bob"]
    s.relate(alice, Writer.peers, s.get(Writer, "dan"))
    s.relate(s.get(Writer, "dan"), Writer.peers, alice)  # either way it is the same
    assert s.execute("MATCH (a)-[r:PEERS]->(b) RETURN count(*) AS n") == [{"n": 1}]
    s.delete(alice)
    s.flush()
    assert s.execute("MATCH (a:Writer)-[r:FRIEND_OF]->(b) RETURN a.id AS a, b.id AS b") == [{"a": "bob", "b": "dan"}]
    s.close()
    with pytest.raises(DetachedEntityError):
        _ = alice.staff


def test_repository(spark):
    r = Repository(Session(store(spark)), Writer)
    assert r.count() == 4 and r.exists("bob") and not r.exists("zed")
    assert len(r.find_all(skip=1, limit=2)) == 2
    assert {w.id for w in r.find_all_by_ids(["alice", "dan", "zed"])} == {"alice", "dan"} and r.find_all_by_ids([]) == []
    with pytest.raises(ValueError):
        r.find_all(fetch=["texts"], limit=1)
    assert [w.id for w in r.cypher("MATCH (w:Writer) WHERE w.age < $a RETURN w ORDER BY w.age", {"a": 29}, returns=Writer)] == ["bob", "dan"]
    assert r.cypher_one("MATCH (w:Writer) RETURN count(w)", returns=int) == 4
    assert r.cypher("MATCH (w:Writer) RETURN w.id", returns=None) == []


def test_async(spark):
    async def main():
        async with AsyncSession(store(spark)) as s:
            assert await s.count(select(Writer)) == 4
            assert [w.id for w in await s.query(Writer).where(Writer.id == "alice").traverse(Writer.friends).alias("f").where(Writer.active == True, on="f").all()] == ["bob"]  # noqa: E712
            bob = await s.get(Writer, "bob")
            with pytest.raises(LazyLoadError):
                _ = bob.friends
            bob.name = "Robert"
            await s.commit()
            assert (await s.execute("MATCH (w:Writer {id: 'bob'}) RETURN w.name AS n")) == [{"n": "Robert"}]

    asyncio.run(main())


def test_enum_round_trip(graph):
    with Session(graph) as s:
        s.add(Text(id="a", title="T", status=Status.PUBLISHED))
    t = Session(graph).get(Text, "a")
    assert t.status is Status.PUBLISHED and t.tags == [] and t.created is None


def test_defaults_are_not_shared():
    a, b = Text(id="1", title="x"), Text(id="2", title="y")
    a.tags.append("t")
    assert b.tags == []
    with pytest.raises(TypeError):
        Text(id="3")
    with pytest.raises(TypeError):
        Text(id="3", title="x", wrong=1)


def test_relations_are_gathered(spark):
    g = MemoryStore(spark)
    with Session(g) as s:
        writers = [Writer(id=f"w{i}", name=str(i)) for i in range(6)]
        texts = [Text(id=f"t{i}", title=str(i)) for i in range(6)]
        s.add_all([*writers, *texts])
        for w, t in zip(writers, texts, strict=True):
            s.relate(w, Writer.texts, t, Wrote(year=2000))
        s.relate(writers[0], Writer.texts, texts[0], Wrote(year=2001))  # the same ends again: its properties change
        s.relate(writers[0], Writer.peers, writers[1])
        s.relate(writers[1], Writer.peers, writers[0])
        s.relate(writers[3], Writer.staff, writers[4])
        s.relate(writers[2], Writer.texts, Text(id="nowhere", title=""), Wrote(year=1))
        s.delete(writers[5])
    s = Session(g)
    found = s.execute("MATCH (w:Writer)-[r:WROTE]->(t) RETURN w.id AS w, t.id AS t, r.year AS y ORDER BY w")
    assert [(r["w"], r["t"], r["y"]) for r in found] == [(f"w{i}", f"t{i}", 2001 if i == 0 else 2000) for i in range(5)]
    assert s.execute("MATCH (a)-[r:PEERS]->(b) RETURN count(*) AS n") == [{"n": 1}]
    assert s.execute("MATCH (a)-[:REPORTS_TO]->(b) RETURN a.id AS a, b.id AS b") == [{"a": "w4", "b": "w3"}]
    kept = Session(g)
    kept.relate(kept.get(Writer, "w0"), Writer.friends, kept.get(Writer, "w1"))
    kept.rollback()
    assert kept.execute("MATCH (a)-[r:FRIEND_OF]->(b) RETURN count(*) AS n") == [{"n": 0}]


def test_whole_tables_are_loaded(spark):
    g = MemoryStore(spark)
    with Session(g) as s:
        s.add(Writer(id="w1", name="old"))
        s.load(Writer, spark.range(5).selectExpr("concat('w', id) AS id", "concat('n', id) AS name"))
        s.load(Text, spark.range(5).selectExpr("concat('t', id) AS id", "'T' AS title"), merge=False)
        s.load_relations(Writer, Writer.texts, spark.range(9).selectExpr("concat('w', id) AS source", "concat('t', id) AS target", "int(2000 + id) AS year"))
        s.load_relations(Writer, Writer.staff, spark.sql("SELECT 'w0' AS source, 'w1' AS target"))
        with pytest.raises(MetadataError):
            s.load(Writer, spark.sql("SELECT 'x' AS id, 1 AS nothing"))
    s = Session(g)
    assert [(w.id, w.name) for w in sorted(s.query(Writer).all(), key=lambda w: w.id)] == [(f"w{i}", f"n{i}") for i in range(5)]
    assert sorted(r["y"] for r in s.execute("MATCH (:Writer)-[r:WROTE]->(:Text) RETURN r.year AS y")) == [2000 + i for i in range(5)]
    assert s.get(Writer, "w1").boss.id == "w0"
