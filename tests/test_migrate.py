import pytest
from graphs import Country, Text, Writer

from nodeweave import MemoryStore, ParquetStore, SchemaManager, Session, select
from nodeweave.exceptions import ChecksumMismatchError, IrreversibleMigrationError, MultipleHeadsError, RevisionNotFoundError
from nodeweave.migrate import FulltextIndex, Migrator, RangeIndex, SchemaManifest, UniqueConstraint, VectorIndex, init
from nodeweave.migrate.cli import main
from nodeweave.migrate.manifest import diff


def write(root, rev, down, up="    pass", back="    pass", extra=""):
    (root / "versions" / f"{rev}.py").write_text(f"revision = {rev!r}\ndown_revision = {down!r}\nmessage = 'about {rev}'\n{extra}\ndef upgrade(op):\n{up}\n\ndef downgrade(op):\n{back}\n")


@pytest.fixture
def root(tmp_path):
    return init(tmp_path / "m")


def test_up_and_down(spark, root, tmp_path):
    write(root, "aa1", None, "    op.create_range_index('Writer', 'name')\n    op.seed('MERGE (w:Writer {id: row.id}) SET w.name = row.name', [{'id': 'x', 'name': 'X'}, {'id': 'x', 'name': 'Y'}])", "    op.drop_range_index('Writer', 'name')\n    op.run_cypher('MATCH (w:Writer) DETACH DELETE w')")
    write(root, "bb2", "aa1", "    op.rename_property('Writer', 'name', 'title')", "    op.rename_property('Writer', 'title', 'name')")
    m = Migrator(ParquetStore(spark, f"file://{tmp_path}/g"), root)
    assert m.upgrade("+1") == ["aa1"] and m.current() == "aa1"
    assert Session(m.store).execute("MATCH (w:Writer) RETURN w.name AS n") == [{"n": "Y"}]
    assert m.upgrade() == ["bb2"] and m.upgrade() == []
    assert Session(m.store).execute("MATCH (w:Writer) RETURN w.title AS t, w.name AS n") == [{"t": "Y", "n": None}]
    assert [(r.id, r.applied) for r in m.get_history()] == [("bb2", True), ("aa1", True)]
    assert m.downgrade() == ["bb2"] and m.current() == "aa1"
    m.downgrade("base")
    assert m.current() is None and Session(m.store).count(select(Writer)) == 0
    m.test("aa1")


def test_branches(spark, root):
    write(root, "a", None)
    write(root, "b", "a")
    write(root, "c", "a")
    m = Migrator(MemoryStore(spark), root)
    with pytest.raises(MultipleHeadsError):
        m.upgrade()
    assert m.upgrade("heads") == ["a", "b", "c"] and m.current_revisions() == ["b", "c"]
    assert [(r.id, kids) for r, kids in m.get_branch_points()] == [("a", ["b", "c"])]
    merged = m.merge()
    assert m.upgrade() == [merged.id] and m.current_revisions() == [merged.id]
    assert m.downgrade() == [merged.id] and m.current_revisions() == ["b", "c"]
    with pytest.raises(RevisionNotFoundError):
        m.show_revision("zz")


def test_safety(spark, root):
    write(root, "a", None, "    op.run_cypher(\"CREATE (w:Writer {id: '1', name: 'n'})\")\n    raise ValueError('stop')", extra="snapshot = True\n")
    m = Migrator(MemoryStore(spark), root)
    with pytest.raises(ValueError):
        m.upgrade()
    assert m.current() is None and Session(m.store).count(select(Writer)) == 0
    write(root, "a", None, extra="irreversible = True\n")
    m.upgrade()
    with pytest.raises(IrreversibleMigrationError):
        m.downgrade()
    write(root, "a", None, "    x = 1")
    assert m.validate() and "changed" in m.validate()[0]
    with pytest.raises(ChecksumMismatchError):
        m.upgrade(validate=True)
    m.stamp("base", purge=True)
    m.enable_preview()
    m.upgrade()
    assert m.current() is None and m.preview_log == ["-- upgrade a: about a"]


def test_manifest_and_schema(spark, root):
    live = SchemaManifest([RangeIndex("A", "x")], constraints=[UniqueConstraint("NODE", "A", ["x"])])
    want = SchemaManifest([RangeIndex("A", "y")], [FulltextIndex("A", ["t"], stopwords=["the"])], [VectorIndex("A", "v", 3)])
    up, down = diff(live, want)
    assert [o.name for o in up] == ["drop_constraint", "drop_range_index", "create_range_index", "create_fulltext_index", "create_vector_index"]
    assert [o.name for o in down] == ["drop_range_index", "drop_fulltext_index", "drop_vector_index", "create_range_index", "create_constraint"]
    s = MemoryStore(spark)
    m = Migrator(s, root, target_manifest=want)
    rev = m.create_revision("make it", autogenerate=True)
    assert m.upgrade() == [rev.id] and m.check() == []
    base = Migrator(s, init(root / "other")).baseline()
    assert "create_vector_index('A', 'v', dimension=3" in base.path.read_text()
    other = SchemaManager(MemoryStore(spark))
    assert other.get_schema_diff([Text, Country]).missing
    other.sync_schema([Text, Country])
    assert other.get_schema_diff([Text, Country]).in_sync and other.validate_schema([Text])
    other.sync_schema([Text], drop_extra=True)
    assert other.get_schema_info() == {"Text": [{"property": "embedding", "type": "VECTOR"}, {"property": "title", "type": "FULLTEXT"}]}


def test_copies(spark, tmp_path):
    for s in (MemoryStore(spark), ParquetStore(spark, f"file://{tmp_path}")):
        with Session(s) as w:
            w.add(Writer(id="a", name="x"))
        s.snapshot("one")
        copy = s.fork("copy")
        with Session(s) as w:
            w.add(Writer(id="b", name="y"))
        assert Session(copy).count(select(Writer)) == 1 and Session(s).count(select(Writer)) == 2
        s.restore_snapshot("one")
        assert Session(s).count(select(Writer)) == 1


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "cli"
    assert main(["-C", str(root), "init"]) == 0
    (root / "env.py").write_text(f"from pyspark.sql import SparkSession\nfrom nodeweave import ParquetStore\nstore = ParquetStore(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), 'file://{tmp_path}/g')\n")
    run = lambda *a: (main(["-C", str(root), *a]), capsys.readouterr().out)
    assert run("revision", "-m", "first one", "--rev-id", "f1")[0] == 0
    assert run("upgrade")[1] == "upgraded f1\n" and run("current")[1] == "f1\n"
    assert "f1 <- base: first one (head)" in run("history")[1]
    assert run("heads")[1] == "f1: first one\n" and run("validate")[0] == 0 and run("info")[0] == 0
    assert run("downgrade")[1] == "downgraded f1\n" and main(["-C", str(root), "show", "nope"]) == 1
