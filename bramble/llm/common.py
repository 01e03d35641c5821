"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes at which an Arrow batch goes to Python; a batch exceeds the bytes by its last row at most.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session has none, as in a local test, a temporary folder of this
    machine is set; a cluster is expected to name its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="bramble-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """A folder of written tables below the shared root, one per operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def sub(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: later jobs start from files that outlive executors."""
        df.write.mode("overwrite").parquet(self.sub(name))
        return self.spark.read.schema(df.schema).parquet(self.sub(name))

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.sub(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch sizes of the session, so that a batch of long texts stays small; smaller ones stay as they are."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    jvm = spark.sparkContext._jvm
    if jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Such names for columns that ``df`` doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str):
    """(filesystem, path) for a folder or file of the shared store, from driver or executor."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, write) -> int:
    """Let ``write`` fill a file, then move it to its final name; returns its size.

    Attempts of one task write the same bytes, so whichever is moved last is as good as the first.
    """
    store, path = open_fs(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        write(out)
        size = out.tell()
    store.move(part, path)
    return size
