from graphs import Writer

from nodeweave import MemoryStore, Session
from nodeweave.streaming import edges_into, nodes_into


def test_ingest(spark, tmp_path):
    store = MemoryStore(spark)
    schema = "id string, name string, at int"
    folder = tmp_path / "in"
    spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "B", 1)], schema).coalesce(1).write.json(str(folder))

    def drain():
        rows = spark.readStream.schema(schema).json(str(folder))
        q = nodes_into(store, rows, "Writer", "id", name="people", order="at").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    drain()
    spark.createDataFrame([("b", "B2", 2), ("c", "C", 1)], schema).coalesce(1).write.mode("append").json(str(folder))
    drain()
    drain()
    s = Session(store)
    assert {w.id: w.name for w in s.query(Writer).all()} == {"a": "new", "b": "B2", "c": "C"}
    spark.createDataFrame([("a", "c"), ("a", "zed"), ("a", "c")], "x string, y string").coalesce(1).write.json(str(tmp_path / "links"))
    links = spark.readStream.schema("x string, y string").json(str(tmp_path / "links"))
    edges_into(store, links, "FRIEND_OF", ("x", "Writer", "id"), ("y", "Writer", "id"), name="links").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(120)
    again = Session(store)  # an entity holds its session weakly
    assert [f.id for f in again.get(Writer, "a").friends] == ["c"]
