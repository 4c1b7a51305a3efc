"""Parquet graphs: what a commit writes, and that parts give the same rows as whole tables."""

import json
import random
from pathlib import Path

import pytest
from graphs import Text, Writer

from nodeweave import MemoryStore, ParquetStore, Session
from nodeweave.exceptions import ConflictError, GraphError
from nodeweave.operators import mutate
from nodeweave.sources import store as store_module

SCHEMA = "id string, name string, age int"


def rows(store, kind="Writer"):
    c = store.catalog()
    nodes = sorted(((r["id"], r["name"], r["age"]) for r in c.nodes(kind).collect()), key=repr)
    edges = sorted(map(tuple, c.edges("LINKS").select("_src", "_dst", "w").collect())) if "LINKS" in c.edge_tables else []
    return nodes, edges


def change(r, catalog, spark):
    """A random write; the same for stores of the same rows, whatever ids new nodes got: the links are between other ends."""
    some = [f"k{r.randrange(12)}" for _ in range(3)]
    what = r.choice(["upsert", "update", "delete", "merge", "unlink"])
    if what == "upsert":
        return mutate.upsert_nodes(catalog, "Writer", spark.createDataFrame([(k, f"n{r.randrange(99)}", r.choice([None, 5])) for k in some[:1]], SCHEMA), "id", ("Writer",))
    if what == "update":
        return mutate.update_nodes(catalog, "Writer", spark.createDataFrame([(some[0], r.randrange(99))], "id string, age int"), "id")
    ids = catalog.nodes("Writer").filter(f"id IN ('{some[0]}', '{some[1]}')").select("_id")
    if what == "delete":
        return mutate.detach_delete(catalog, "Writer", ids)
    base = spark.createDataFrame([(1, 1, 1, None)], "_eid long, _src long, _dst long, w int").limit(0)
    if "LINKS" not in catalog.edge_tables:
        catalog = catalog.with_edges("LINKS", base)
    pairs = spark.createDataFrame([(1 << 60 | r.randrange(4), 1 << 60 | r.randrange(4), r.randrange(9)) for _ in range(1 if what == "merge" else 3)], "_src long, _dst long, w int")
    if what == "merge":
        return mutate.merge_edges(catalog, "LINKS", pairs)
    return mutate.delete_edges(catalog, "LINKS", pairs)


@pytest.mark.parametrize("most", [3, 16])
def test_parts_give_the_same_rows(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(store_module, "MOST_PARTS", most)
    a, b = MemoryStore(spark), ParquetStore(spark, f"file://{tmp_path}", "g")
    ra, rb = random.Random(3), random.Random(3)
    for s in (a, b):
        s.commit(mutate.create_nodes(s.catalog(), "Writer", spark.createDataFrame([(f"k{i}", "x", i) for i in range(6)], SCHEMA).coalesce(1), ("Writer",)), s.version)
    for _ in range(14):
        a.commit(change(ra, a.catalog(), spark), a.version)
        b.commit(change(rb, b.catalog(), spark), b.version)
        assert rows(a) == rows(b)
    # several steps in one commit, and an id that is used again
    for s, r in ((a, ra), (b, rb)):
        c = s.catalog()
        for _ in range(4):
            c = change(r, c, spark)
        c = mutate.detach_delete(c, "Writer", c.nodes("Writer").orderBy("_id").select("_id").limit(50))
        c = mutate.create_nodes(c, "Writer", spark.createDataFrame([("again", "y", 1)], SCHEMA), ("Writer",))
        s.commit(c, s.version)
    assert rows(a) == rows(b) and [n[0] for n in rows(b)[0]] == ["again"]


def manifest(tmp_path, name="g"):
    return json.loads(sorted(Path(tmp_path, name, "manifests").glob("*.json"))[-1].read_text())


def test_a_commit_writes_what_has_changed(spark, tmp_path):
    g = ParquetStore(spark, f"file://{tmp_path}", "g")
    with Session(g) as s:
        s.add_all([Writer(id=f"w{i}", name="x") for i in range(2000)])
        s.add_all([Text(id="t", title="T"), Text(id="u", title="U")])
        s.relate(Writer(id="w1", name="x"), Writer.texts, Text(id="t", title="T"))
        s.relate(Writer(id="w2", name="x"), Writer.friends, Writer(id="w3", name="x"))
    before, files = manifest(tmp_path), {f: f.stat().st_size for f in Path(tmp_path).rglob("*.parquet")}
    with Session(g) as s:
        s.get(Writer, "w7").name = "y"
    after, new = manifest(tmp_path), [f for f in Path(tmp_path).rglob("*.parquet") if f not in files]
    assert after["nodes"]["Text"] == before["nodes"]["Text"] and after["edges"] == before["edges"]
    assert after["nodes"]["Writer"]["parts"][:-1] == before["nodes"]["Writer"]["parts"]
    assert len(new) <= 2 and spark.read.parquet(*(f"file://{f}" for f in new)).count() == 1  # Spark may write a file without rows
    with Session(g) as s:
        s.delete(s.get(Writer, "w1"))
    last = manifest(tmp_path)
    assert last["edges"]["FRIEND_OF"] == after["edges"]["FRIEND_OF"] and len(last["edges"]["WROTE"]["parts"]) == 2
    s = Session(g)
    assert s.get(Writer, "w7").name == "y" and s.get(Writer, "w1") is None
    assert s.execute("MATCH (w:Writer) RETURN count(w) AS n") == [{"n": 1999}]


def test_manifests_are_whole_or_not_there(spark, tmp_path):
    g = ParquetStore(spark, f"file://{tmp_path}", "g")
    with Session(g) as s:
        s.add(Writer(id="a", name="A"))
    (tmp_path / "g" / "manifests" / "000000000002.json.0badf00d.new").write_text('{"nodes": {')  # its writer was lost
    assert g.version == 1 and Session(g).get(Writer, "a").name == "A"
    with Session(g) as s:
        s.add(Writer(id="b", name="B"))
    assert g.version == 2
    with pytest.raises(ConflictError):
        g.files.write_new("manifests/000000000002.json", "{}")
    assert not [p for p in (tmp_path / "g" / "manifests").iterdir() if p.name.endswith(".new") and "0badf00d" not in p.name]


def test_graphs_share_parts(spark, tmp_path):
    g = ParquetStore(spark, f"file://{tmp_path}", "g")
    with Session(g) as s:
        s.add(Writer(id="a", name="A"))
    copy = g.fork("copy")
    with pytest.raises(GraphError):
        g.fork("copy")
    with Session(copy) as s:
        s.add(Writer(id="b", name="B"))
    g.delete_graph()
    assert g.version == 0 and {w.id for w in Session(ParquetStore(spark, f"file://{tmp_path}", "copy")).query(Writer).all()} == {"a", "b"}
    copy.delete_graph()
    assert not list(Path(tmp_path).rglob("*.parquet"))
