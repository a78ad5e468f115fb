"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: With this, a write drops its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Share of the driver's heap in use from which on it is collected after a write.
HEAP_SHARE = 0.4


def quoted(name: str) -> str:
    """A column's name as F.col() takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def kept_by_text(docs: DataFrame, text_col: str, test: Callable[[list[str | None]], Sequence[bool]]) -> DataFrame:
    """The rows, with all their columns, whose texts pass a test, which gets the texts of a batch; columns may have any name."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(test(b.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, a local session, as in tests, gets a temporary
    folder; on a cluster that is an error, since executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seriesloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/seriesloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts lineage in a way that survives lost executors."""
    return Scratch(df.sparkSession).write(df)


class Scratch:
    """Written tables of one operator. ``drop`` deletes those that no lazy result reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, shared_folder(spark), []

    def write(self, df: DataFrame) -> DataFrame:
        path, conf = f"{self.root}/{len(self.tables)}", self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")  # the written table is all that is needed from here on
        try:
            df.write.parquet(path)
        finally:
            conf.set(CLEANUP, before)
        self._collect()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def _collect(self) -> None:
        """Broadcasts, plans and compiled classes of steps that have ended are let go only when the driver collects garbage,
        and its heap shrinks only then; a small driver does so too late by itself."""
        jvm = self.spark.sparkContext._jvm
        heap = jvm.java.lang.Runtime.getRuntime()
        if heap.totalMemory() - heap.freeMemory() > HEAP_SHARE * heap.maxMemory():
            jvm.java.lang.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables; without arguments all."""
        gone = [path for df, path in self.tables if not tables or any(df is t for t in tables)]
        jvm = self.spark.sparkContext._jvm
        for path in gone:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
