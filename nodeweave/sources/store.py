"""Where graphs are kept: immutable Parquet parts, or memory.

A Parquet graph is a folder with one manifest per version, beside a folder of table parts that versions and graphs share.
A table is a list of parts: rows added, rows that take the place of earlier ones of their ids, ids that are gone. A commit
writes the parts that its steps made, then the next manifest, so it costs what has changed; a table of MOST_PARTS is written
as one again. A manifest is written under another name and then moved to its own, which fails if that is there: readers
see a whole manifest or none, and of two sessions that commit on one version the second fails. All of it goes through
Spark's own file systems; on object stores the move is as safe as their Hadoop connector makes it.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nodeweave.exceptions import ConflictError, GraphError
from nodeweave.operators.checkpoints import cut
from nodeweave.sources.catalog import Catalog, Constraint, Index, Step

#: Parts of a table, beyond which a commit writes it as one.
MOST_PARTS = 16


class Files:
    """The few file operations a manifest needs, on any store that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root, self.gateway = spark._jvm, root.rstrip("/"), spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Create a file that must not exist yet, as a whole."""
        to, hidden = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.new")
        self.fs.mkdirs(to.getParent())
        stream = self.fs.create(hidden, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(hidden.toUri().getPath(), to.toUri().getPath())  # unlike a move, it fails if the file is there
            else:
                kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                how = self.gateway.new_array(kind, 1)
                how[0] = kind.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(hidden, to, how)
        except (FileExistsError, Py4JJavaError) as e:
            raise ConflictError(f"{name} has been written meanwhile") from e
        finally:
            self.fs.delete(hidden, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class GraphStore:
    """A named graph. `catalog()` is its published state, `commit()` publishes another."""

    name: str

    def catalog(self) -> Catalog:
        raise NotImplementedError

    @property
    def version(self) -> int:
        raise NotImplementedError

    def commit(self, catalog: Catalog, base_version: int, meta: dict[str, Any] | None = None) -> int:
        """Publish a state, and with it other `meta`, if given."""
        raise NotImplementedError

    @property
    def meta(self) -> dict[str, Any]:
        """Small state kept beside the graph, as applied revisions; it goes with copies."""
        raise NotImplementedError

    def set_meta(self, meta: dict[str, Any]) -> None:
        raise NotImplementedError

    def fork(self, name: str) -> GraphStore:
        """A copy under a name that no graph has yet; either may change or go without the other."""
        raise NotImplementedError

    def snapshot(self, name: str) -> None:
        """Keep the present state under a name."""
        raise NotImplementedError

    def restore_snapshot(self, name: str) -> None:
        raise NotImplementedError

    def snapshot_exists(self, name: str) -> bool:
        raise NotImplementedError

    def drop_snapshot(self, name: str) -> None:
        raise NotImplementedError

    def delete_graph(self) -> None:
        raise NotImplementedError


class MemoryStore(GraphStore):
    """Tables as checkpointed DataFrames; gone with the session that made it."""

    def __init__(self, spark: SparkSession, name: str = "graph", graphs: dict[str, dict] | None = None):
        self.spark, self.name = spark, name
        self.graphs = {} if graphs is None else graphs
        self.graphs.setdefault(name, {"catalog": Catalog(spark), "version": 0, "meta": {}, "snapshots": {}})

    @property
    def _own(self) -> dict:
        return self.graphs.setdefault(self.name, {"catalog": Catalog(self.spark), "version": 0, "meta": {}, "snapshots": {}})

    def catalog(self) -> Catalog:
        return self._own["catalog"]

    @property
    def version(self) -> int:
        return self._own["version"]

    def commit(self, catalog: Catalog, base_version: int, meta: dict[str, Any] | None = None) -> int:
        own = self._own
        if own["version"] != base_version:
            raise ConflictError(f"{self.name} is at version {own['version']}, not {base_version}")
        old = own["catalog"]
        nodes = {k: v if old.node_tables.get(k) is v else cut(v) for k, v in catalog.node_tables.items()}
        edges = {k: v if old.edge_tables.get(k) is v else cut(v) for k, v in catalog.edge_tables.items()}
        own["catalog"] = Catalog(self.spark, nodes, edges, catalog.indexes, catalog.constraints, catalog.complete)
        own["version"] += 1
        if meta is not None:
            own["meta"] = dict(meta)
        return own["version"]

    @property
    def meta(self) -> dict[str, Any]:
        return dict(self._own["meta"])

    def set_meta(self, meta: dict[str, Any]) -> None:
        self._own["meta"] = dict(meta)

    def fork(self, name: str) -> MemoryStore:
        own = self._own
        if name in self.graphs:
            raise GraphError(f"there is a graph {name!r}")
        self.graphs[name] = {"catalog": own["catalog"], "version": 0, "meta": dict(own["meta"]), "snapshots": {}}
        return MemoryStore(self.spark, name, self.graphs)

    def snapshot(self, name: str) -> None:
        own = self._own
        own["snapshots"][name] = (own["catalog"], dict(own["meta"]))

    def restore_snapshot(self, name: str) -> None:
        own = self._own
        if name not in own["snapshots"]:
            raise GraphError(f"no snapshot {name!r}")
        own["catalog"], own["meta"] = own["snapshots"][name][0], dict(own["snapshots"][name][1])
        own["version"] += 1

    def snapshot_exists(self, name: str) -> bool:
        return name in self._own["snapshots"]

    def drop_snapshot(self, name: str) -> None:
        self._own["snapshots"].pop(name, None)

    def delete_graph(self) -> None:
        self.graphs.pop(self.name, None)


def live(parts: list[tuple[DataFrame | None, DataFrame | None, bool]], key: str) -> DataFrame:
    """The rows of a table from its parts (rows, gone ids, append), in their order.

    However many parts there are, the rows that were added are joined once, with the ids that later parts changed. An id
    that is added again has been gone in between, so its newest change is that it's gone.
    """
    added = [(i, rows) for i, (rows, _, append) in enumerate(parts) if append and rows is not None]
    changes = [(i, rows, gone) for i, (rows, gone, append) in enumerate(parts) if not append]
    names = added[0][1].columns
    if not changes:
        return reduce(DataFrame.unionByName, (rows for _, rows in added))
    last = max(i for i, *_ in changes)
    told = [rows.withColumns({"__part": F.lit(i), "__gone": F.lit(False)}) for i, rows, _ in changes if rows is not None]
    empty = added[0][1].limit(0).drop(key)
    told += [gone.select(key).join(empty, F.lit(False), "left").select(*names, F.lit(i).alias("__part"), F.lit(True).alias("__gone")) for i, _, gone in changes if gone is not None]
    every = reduce(DataFrame.unionByName, told)
    newest = Window.partitionBy(key).orderBy(F.desc("__part"), F.desc("__gone"))
    now = every.withColumn("__n", F.row_number().over(newest)).filter("__n = 1 AND NOT __gone").select(*names)
    ids = every.groupBy(F.col(key).alias("__key")).agg(F.max("__part").alias("__until"))
    early = [rows.withColumn("__part", F.lit(i)) for i, rows in added if i < last]
    late = [rows for i, rows in added if i > last]
    kept = []
    if early:
        base = reduce(DataFrame.unionByName, early)
        kept = [base.join(ids, (base[key] == ids["__key"]) & (base["__part"] < ids["__until"]), "left_anti").select(*names)]
    return reduce(DataFrame.unionByName, [*kept, now, *late])


class ParquetStore(GraphStore):
    """`path/name/`: manifests/N.json, snapshots/NAME.json; `path/.parts/`: the parts of all graphs of this path."""

    def __init__(self, spark: SparkSession, path: str, name: str = "graph"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.root = f"{self.path}/{name}"
        self.files = Files(spark, self.root)
        self._tables: dict[str, DataFrame] = {}
        self._at: dict[int, dict[str, Any]] = {}

    def _manifest(self, name: str | None = None) -> dict[str, Any]:
        if name is None:
            n = self.version
            name = f"manifests/{n:012d}.json" if n else None
        return json.loads(self.files.read(name)) if name else {"nodes": {}, "edges": {}, "indexes": [], "constraints": [], "meta": {}}

    @property
    def version(self) -> int:
        found = [n for n in self.files.names("manifests") if n.endswith(".json")]
        return int(found[-1][:-5]) if found else 0

    def _table(self, entry: dict[str, Any], key: str) -> DataFrame:
        """Read with the schema of the manifest, so no file is opened to learn it; columns that a part lacks are null."""
        name = json.dumps(entry, sort_keys=True)
        if name not in self._tables:
            schema = T.StructType.fromJson(entry["schema"])
            ids = T.StructType([T.StructField(key, T.LongType())])
            read = lambda path, of: None if path is None else self.spark.read.schema(of).parquet(path)
            df = live([(read(p["rows"], schema), read(p["gone"], ids), p["append"]) for p in entry["parts"]], key)
            self._tables[name] = df
            self._at[id(df)] = entry
        return self._tables[name]

    def catalog(self) -> Catalog:
        m = self._manifest()
        return Catalog(
            self.spark, {k: self._table(v, "_id") for k, v in m["nodes"].items()}, {k: self._table(v, "_eid") for k, v in m["edges"].items()},
            tuple(Index(i["kind"], i["label"], tuple(i["properties"]), i["rel"], tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in i["options"])) for i in m["indexes"]),
            tuple(Constraint(c["kind"], c["label"], tuple(c["properties"]), c["entity"]) for c in m["constraints"]), frozenset(tuple(x) for x in m.get("complete", [])),
        )

    def commit(self, catalog: Catalog, base_version: int, meta: dict[str, Any] | None = None) -> int:
        if self.version != base_version:
            raise ConflictError(f"{self.name} is at version {self.version}, not {base_version}")
        entries: dict[str, dict] = {"nodes": {}, "edges": {}}
        for kind, tables in (("nodes", catalog.node_tables), ("edges", catalog.edge_tables)):
            for name, df in tables.items():
                entries[kind][name] = self._at.get(id(df)) or {"parts": self._parts(kind, name, df, catalog), "schema": json.loads(df.schema.json())}
        m = self._manifest() | entries | {"indexes": [asdict(i) for i in catalog.indexes], "constraints": [asdict(c) for c in catalog.constraints], "complete": sorted(map(list, catalog.complete))}
        return self._publish(m if meta is None else m | {"meta": meta}, base_version)

    def _parts(self, kind: str, name: str, df: DataFrame, catalog: Catalog) -> list[dict[str, Any]]:
        base, steps = catalog.steps.get((kind, name), (None, ()))
        held = self._at.get(id(base))
        if held is None or len(held["parts"]) + len(steps) > MOST_PARTS:
            return [{"rows": self._write(kind, name, df, catalog), "gone": None, "append": True}]
        return [*held["parts"], *(p for s in steps if (p := self._part(kind, name, s, catalog)) is not None)]

    def _part(self, kind: str, name: str, step: Step, catalog: Catalog) -> dict[str, Any] | None:
        """Write what a step made; nothing is kept of a step without rows."""
        paths = {}
        for what, df in (("rows", step.rows), ("gone", step.gone)):
            paths[what] = None
            if df is not None:
                path = self._write(kind, name, df, catalog)
                if self.spark.read.schema(df.schema).parquet(path).isEmpty():
                    self.files.fs.delete(self.files.jvm.org.apache.hadoop.fs.Path(path), True)
                else:
                    paths[what] = path
        return None if not any(paths.values()) else {**paths, "append": step.append}

    def _write(self, kind: str, name: str, df: DataFrame, catalog: Catalog) -> str:
        path = f"{self.path}/.parts/{kind}/{name}/{uuid.uuid4().hex}"
        # An index means that files are ordered by it, so that Parquet's statistics can skip row groups.
        by = [p for i in catalog.indexes if i.label == name and i.kind in ("RANGE", "UNIQUE") for p in i.properties if p in df.columns]
        (df.sortWithinPartitions(*by) if by else df).write.parquet(path)
        return path

    def _publish(self, m: dict[str, Any], base_version: int) -> int:
        self.files.write_new(f"manifests/{base_version + 1:012d}.json", json.dumps(m, default=list))
        return base_version + 1

    @property
    def meta(self) -> dict[str, Any]:
        return self._manifest()["meta"]

    def set_meta(self, meta: dict[str, Any]) -> None:
        self._publish(self._manifest() | {"meta": meta}, self.version)

    def fork(self, name: str) -> ParquetStore:
        other = ParquetStore(self.spark, self.path, name)
        if other.version:
            raise GraphError(f"there is a graph {name!r}")
        other._publish(self._manifest(), 0)
        return other

    def snapshot(self, name: str) -> None:
        self.files.delete(f"snapshots/{name}.json")
        self.files.write_new(f"snapshots/{name}.json", json.dumps(self._manifest()))

    def restore_snapshot(self, name: str) -> None:
        if not self.snapshot_exists(name):
            raise GraphError(f"no snapshot {name!r}")
        self._publish(self._manifest(f"snapshots/{name}.json"), self.version)

    def snapshot_exists(self, name: str) -> bool:
        return self.files.exists(f"snapshots/{name}.json")

    def drop_snapshot(self, name: str) -> None:
        self.files.delete(f"snapshots/{name}.json")

    def _held(self, files: Files) -> set[str]:
        """The parts that any manifest or snapshot of a graph names."""
        found = set()
        for folder in ("manifests", "snapshots"):
            for name in files.names(folder):
                if name.endswith(".json"):
                    m = json.loads(files.read(f"{folder}/{name}"))
                    found |= {p[x] for kind in ("nodes", "edges") for entry in m[kind].values() for p in entry["parts"] for x in ("rows", "gone") if p[x]}
        return found

    def delete_graph(self) -> None:
        """Its manifests and snapshots go, then those of its parts that no other graph of the path has."""
        own = self._held(self.files)
        self.files.delete("")
        above = Files(self.spark, self.path)
        others = set().union(*(self._held(Files(self.spark, f"{self.path}/{name}")) for name in above.names() if not name.startswith(".")))
        for path in own - others:
            above.fs.delete(above.jvm.org.apache.hadoop.fs.Path(path), True)
        self._tables, self._at = {}, {}


def create_store(kind: str, spark: SparkSession, **options: Any) -> GraphStore:
    """Kind "memory", or "parquet" with `path`; either with `graph`."""
    name = options.pop("graph", "graph")
    if kind == "memory":
        return MemoryStore(spark, name, **options)
    if kind == "parquet":
        return ParquetStore(spark, options.pop("path"), name, **options)
    raise GraphError(f"unknown kind of store {kind!r}")


class ConnectionManager:
    """Hands out a store; there is no connection to close."""

    def __init__(self, kind: str, spark: SparkSession, **options: Any):
        self.kind, self.spark, self.options = kind, spark, options
        self._graphs: dict[str, dict] = {}

    def acquire(self, graph: str = "graph") -> GraphStore:
        more = {"graphs": self._graphs} if self.kind == "memory" else {}
        return create_store(self.kind, self.spark, graph=graph, **self.options, **more)

    def release(self, store: GraphStore) -> None:
        pass

    def __enter__(self) -> GraphStore:
        return self.acquire()

    def __exit__(self, *exc: Any) -> None:
        pass
