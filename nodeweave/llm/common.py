"""What the operators share: shared folder, checkpoints, worker settings and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[2])
#: Documents can be megabytes long, so batches are kept short; Spark's default is 10,000 rows.
ROWS_PER_BATCH = 1000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, bound their Arrow batches, and make sure of a checkpoint folder."""
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if REPO not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, path) if x)
    sc.environment.setdefault("TOKENIZERS_PARALLELISM", "false")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = getattr(shared_folder, "own", None)
    if held is None:
        held = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="nodeweave-")
    return held


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint; it survives the loss of executors."""
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again. Unlike after cut(), Spark knows its size and no partitioning of it."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(spark: SparkSession) -> None:
    """Between phases of many jobs: let the driver drop plans, broadcasts and shuffles that nothing refers to any more, and
    give freed native memory back, where its JVM has a command for that."""
    gc.collect()
    sc = spark.sparkContext
    jvm = sc._jvm
    jvm.System.gc()
    release()
    kinds, args = sc._gateway.new_array(jvm.java.lang.Class, 4), sc._gateway.new_array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = sc._gateway.new_array(jvm.java.lang.Object, 0), sc._gateway.new_array(jvm.java.lang.String, 0)
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    with contextlib.suppress(Py4JJavaError):  # other JVMs have no such command
        jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, args)


def release() -> None:
    """Give freed memory back, at the end of a partition: a worker lives on through stages of other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)
