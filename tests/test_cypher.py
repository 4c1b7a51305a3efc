import pytest
from graphs import store

from nodeweave import MemoryStore, Session
from nodeweave.cypher import parse
from nodeweave.exceptions import ConstraintFailedError, UnsupportedCypherError


@pytest.fixture(scope="module")
def session(spark):
    return Session(store(spark))


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("MATCH (w:Writer) WHERE w.age >= 28 AND NOT w.name STARTS WITH 'A' RETURN w.id AS id ORDER BY id", [{"id": "carol"}, {"id": "dan"}]),
        ("MATCH (a:Writer {id: 'alice'})-[:FRIEND_OF]->(b) RETURN b.id AS id ORDER BY id DESC", [{"id": "carol"}, {"id": "bob"}]),
        ("MATCH (a:Writer)<-[:REPORTS_TO]-(b:Writer) RETURN a.id AS a, b.id AS b ORDER BY a", [{"a": "alice", "b": "bob"}, {"a": "bob", "b": "dan"}]),
        ("MATCH (a:Writer {id: 'dan'})-[:REPORTS_TO*1..]->(m) RETURN m.id AS m ORDER BY m", [{"m": "alice"}, {"m": "bob"}]),
        ("MATCH (a:Writer) OPTIONAL MATCH (a)-[r:WROTE]->(t:Text) WHERE r.year > 2020 RETURN a.id AS a, t.id AS t ORDER BY a", [{"a": "alice", "t": None}, {"a": "bob", "t": "t2"}, {"a": "carol", "t": None}, {"a": "dan", "t": None}]),
        ("MATCH (a:Writer)-[:WROTE]->(t) WITH a, count(t) AS n WHERE n > 1 RETURN a.id AS id, n", [{"id": "bob", "n": 2}]),
        ("MATCH (w:Writer) WHERE NOT (w)-[:WROTE]->() RETURN w.id AS id ORDER BY id", [{"id": "carol"}, {"id": "dan"}]),
        ("MATCH (w:Writer) WHERE w.id = 'dan' OR (w)-[:FRIEND_OF]->() RETURN w.id AS id ORDER BY id", [{"id": "alice"}, {"id": "bob"}, {"id": "dan"}]),
        ("MATCH (w:Writer) WHERE NOT (w.id = 'dan' OR (w)-[:FRIEND_OF]->()) OR w.id = 'bob' AND (w)-[:WROTE]->() RETURN w.id AS id ORDER BY id", [{"id": "bob"}, {"id": "carol"}]),
        ("MATCH (a:Writer) OPTIONAL MATCH (a)-[:FRIEND_OF]->(b) WHERE (b)-[:FRIEND_OF]->() RETURN a.id AS a, b.id AS b ORDER BY a", [{"a": "alice", "b": "bob"}, {"a": "bob", "b": None}, {"a": "carol", "b": None}, {"a": "dan", "b": None}]),
        ("UNWIND [1, 2, 3] AS x WITH x WHERE x <> 2 RETURN sum(x) AS s, collect(x) AS l", [{"s": 4, "l": [1, 3]}]),
        ("MATCH (w:Writer) RETURN DISTINCT w.active AS x ORDER BY x", [{"x": False}, {"x": True}]),
        ("RETURN 1 + 2 * 3 AS a, 'x' + 'y' AS b, coalesce(null, 5) AS c, size([1, 2]) AS d", [{"a": 7, "b": "xy", "c": 5, "d": 2}]),
        ("MATCH (w:Writer) WHERE w.id = 'bob' RETURN CASE WHEN w.age > 30 THEN 'old' ELSE 'young' END AS x, labels(w) AS l", [{"x": "young", "l": ["Writer"]}]),
        ("MATCH (a:Writer {id: 'alice'}) RETURN a.id AS x UNION ALL MATCH (t:Text {id: 't1'}) RETURN t.id AS x", [{"x": "alice"}, {"x": "t1"}]),
        ("MATCH (a:Writer)-[x:FRIEND_OF]->(b)-[y:FRIEND_OF]->(c) RETURN a.id AS a, c.id AS c, type(x) AS t", [{"a": "alice", "c": "dan", "t": "FRIEND_OF"}]),
    ],
)
def test_read(session, text, rows):
    assert session.execute(text) == rows


def test_writes(spark):
    s = Session(MemoryStore(spark))
    s.execute("CREATE (a:Town {name: 'A', size: 1})-[:ROAD {km: 7}]->(b:Town {name: 'B'})")
    assert s.execute("MATCH (a:Town)-[r:ROAD]->(b:Town) RETURN a.name AS a, r.km AS km, b.name AS b, b.size AS size") == [{"a": "A", "km": 7, "b": "B", "size": None}]
    s.execute("UNWIND $rows AS row MERGE (t:Town {name: row.name}) ON CREATE SET t.made = true SET t.size = row.size", {"rows": [{"name": "B", "size": 5}, {"name": "C", "size": 6}]})
    assert s.execute("MATCH (t:Town) RETURN t.name AS n, t.size AS s, t.made AS m ORDER BY n") == [{"n": "A", "s": 1, "m": None}, {"n": "B", "s": 5, "m": None}, {"n": "C", "s": 6, "m": True}]
    for _ in range(2):
        s.execute("MATCH (a:Town {name: 'A'}) MATCH (c:Town {name: 'C'}) MERGE (a)-[r:ROAD]->(c) SET r.km = 9")
    assert s.execute("MATCH (:Town)-[r:ROAD]->(b) RETURN b.name AS n, r.km AS km ORDER BY n") == [{"n": "B", "km": 7}, {"n": "C", "km": 9}]
    s.execute("MATCH (t:Town {name: 'B'}) REMOVE t.size SET t:Big")
    assert s.execute("MATCH (t:Big) RETURN t.name AS n, t.size AS s") == [{"n": "B", "s": None}]
    with pytest.raises(ConstraintFailedError):
        s.execute("MATCH (t:Town {name: 'B'}) DELETE t")
    s.execute("MATCH (t:Town {name: 'B'}) DETACH DELETE t")
    assert s.execute("MATCH (:Town)-[r:ROAD]->() RETURN count(*) AS n") == [{"n": 1}]
    s.execute("MATCH ()-[r:ROAD]->() DELETE r")
    assert s.execute("MATCH ()-[r:ROAD]->() RETURN count(*) AS n") == [{"n": 0}]


@pytest.mark.parametrize("text", ["FOREACH (x IN [1] | CREATE (n))", "MATCH (n RETURN n", "CALL db.x()", "MATCH (n) RETURN n ORDER", "MATCH (a)-[r:X*1..2]->(b) RETURN r"])
def test_unsupported(session, text):
    with pytest.raises(UnsupportedCypherError):
        session.execute(text)


def test_parse_kinds():
    q = parse("MERGE (n:L {k: $k}) ON CREATE SET n.a = 1 ON MATCH SET n.a = 2")
    assert q.writes and len(q.parts[0]) == 1
