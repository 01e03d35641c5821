"""Tables: Parquet sources, views, resident (pinned) tables and their statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
STAR = TABLES[:7]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; columns and filters of later steps reach its Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = STAR) -> None:
    """Temporary views over tables of a folder."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


@dataclass
class Pinned:
    frame: DataFrame
    rows: int
    source: DataFrame


_pinned: dict[tuple[int, str], Pinned] = {}


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.sparkSession is b.sparkSession and a.sameSemantics(b)


def pin(spark: SparkSession, name: str, columns: list[str] | None = None) -> tuple[int, int, int]:
    """Make a table or view resident: (rows, columns, 1 if it was already).

    The resident frame takes the view's name, so SQL text meets it too; plans equal to the
    source's are answered from it as well.  An empty table gives (0, 0, 0) and isn't held.
    """
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table or view named {name!r}")
    held = _pinned.get((id(spark), name))
    now = spark.table(name)
    if held is not None and (_same(now, held.frame) or _same(now, held.source)):
        return held.rows, len(held.frame.columns), 1
    if held is not None:
        held.frame.unpersist()
        del _pinned[id(spark), name]
    frame = now.select(*columns) if columns else now
    if not frame.columns:
        raise ValueError(f"{name!r} has no columns to hold")
    frame.createOrReplaceTempView(name)  # before it is held, as replacing a view gives up what was cached of it
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    rows = frame.count()
    if rows == 0:
        frame.unpersist()
        now.createOrReplaceTempView(name)
        return 0, 0, 0
    _pinned[id(spark), name] = Pinned(frame, rows, now)
    return rows, len(frame.columns), 0


def pin_all(spark: SparkSession, names: tuple[str, ...] = STAR) -> str:
    """Pin several tables; raises before any is pinned if one is missing."""
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise ValueError(f"no table or view named {', '.join(missing)}")
    for n in names:
        pin(spark, n)
    return "ok"


def unpin(spark: SparkSession, name: str) -> bool:
    """Give up one table, whose view returns to its source; false if it isn't held."""
    held = _pinned.pop((id(spark), name), None)
    if held is not None:
        held.frame.unpersist()
        held.source.createOrReplaceTempView(name)
    return held is not None


def unpin_all(spark: SparkSession) -> str:
    """Give up what this module holds, and nothing that the user has cached; views return to their sources."""
    for owner, name in list(_pinned):
        if owner == id(spark):
            unpin(spark, name)
    return "ok"


def pin_report(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    """(table, rows, columns, already_resident) of pinning each of ``names``."""
    return spark.createDataFrame([(n, *pin(spark, n)) for n in names], "table_name string, row_count long, column_count long, already_resident long")


def cache_stats(frame: DataFrame, column: str, low: object = None, high: object = None) -> DataFrame:
    """(segments_total, segments_pruned): partitions of ``frame``, and those whose range of ``column`` excludes [low, high].

    Spark prunes cached batches and Parquet row groups by the same statistics, but
    reports no counts; these are of partitions, in one pass.
    """
    zones = frame.groupBy(F.spark_partition_id().alias("segment")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    out: Column = F.col("lo").isNull()
    if low is not None:
        out = out | (F.col("hi") < F.lit(low))
    if high is not None:
        out = out | (F.col("lo") > F.lit(high))
    return zones.agg(F.count(F.lit(1)).alias("segments_total"), F.count(F.when(out, 1)).alias("segments_pruned"))
