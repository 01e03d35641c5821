"""Exact cosine top-k over pinned tables of unit vectors.

A search sends the queries, in blocks of bounded number, to all tasks; each keeps
its own top k by a matrix product over Arrow batches, and the final ranking reads k rows
a task and query.  Ties are broken by position, inside the limit too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from bramble.functions.exprs import dot, norm

PRECISIONS = {"float64": "array<double>", "float32": "array<float>", "float16": "array<float>"}
_stores: dict[tuple[int, str], tuple[DataFrame, int, int]] = {}
#: Queries sent to the tasks at once: 4 MB of 64-bit numbers at 512 dimensions.
BLOCK = 1024


def positions(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``idx``, its position by ``order`` from 0, and a frame to unpersist once that is held.

    Rows are counted by range partition first, so that no task numbers the whole table.
    """
    placed = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, before = {}, 0
    for p in sorted(sizes):
        start[p] = before
        before += sizes[p]
    first = F.lit(0).cast("long")
    if start:
        first = F.element_at(F.create_map(*(F.lit(x) for kv in start.items() for x in kv)), F.col("__p")).cast("long")
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return placed.withColumn("idx", first + rank).drop("__p"), placed


def pin(spark: SparkSession, name: str | None, vectors: DataFrame | None, *, order: str, column: str = "embedding", precision: str = "float64") -> int | None:
    """Hold ``vectors`` as unit vectors under ``name``; their number.  A null name or table gives None; pinning again replaces.

    A null vector or element, vectors of several lengths and an unknown precision are errors.
    """
    if name is None or vectors is None:
        return None
    if precision not in PRECISIONS:
        raise ValueError(f"unknown precision {precision!r}; one of {', '.join(PRECISIONS)}")
    kind = vectors.schema[column].dataType.simpleString()
    if kind not in ("array<float>", "array<double>"):
        raise ValueError(f"{column} must be an array of float or double, not {kind}")
    v = F.col(column)
    bad = vectors.agg(F.count(F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), 1)).alias("nulls"), F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if bad["nulls"]:
        raise ValueError("NULL vectors or elements can't be pinned")
    if bad["lo"] != bad["hi"]:
        raise ValueError(f"vectors of several lengths ({bad['lo']} to {bad['hi']})")
    unit = F.transform(v, lambda x: x.cast("double") / F.col("__norm"))
    numbered, placed = positions(vectors, order)
    rows = numbered.withColumn("__norm", norm(v)).select("idx", F.col(order), unit.alias("unit"))
    if precision == "float16":
        rows = rows.mapInArrow(_halved, rows.schema)
    rows = rows.withColumn("unit", F.col("unit").cast(PRECISIONS[precision])).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    placed.unpersist()
    old = _stores.pop((id(spark), name), None)
    if old is not None:
        old[0].unpersist()
    _stores[id(spark), name] = (rows, bad["n"], bad["hi"] or 0)
    return bad["n"]


def _halved(batches):
    import pyarrow as pa

    for batch in batches:
        at = batch.schema.get_field_index("unit")
        flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float64)
        unit = pa.ListArray.from_arrays(batch.column(at).offsets, pa.array(flat))
        yield batch.set_column(at, batch.schema.field(at).name, unit)


def store(spark: SparkSession, name: str) -> DataFrame:
    """(idx, key, unit) of a pinned table."""
    return _known(spark, name)[0]


def _known(spark: SparkSession, name: str) -> tuple[DataFrame, int, int]:
    try:
        return _stores[id(spark), name]
    except KeyError:
        raise ValueError(f"no vectors pinned as {name!r}") from None


def unpin(spark: SparkSession, name: str) -> None:
    rows, _, _ = _known(spark, name)
    rows.unpersist()
    del _stores[id(spark), name]


def _unit(queries: list[list[float]], dim: int) -> np.ndarray:
    if any(q is None or len(q) != dim for q in queries):
        raise ValueError(f"queries must have {dim} dimensions")
    q = np.array(queries, np.float64).reshape(len(queries), dim)
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)


def search(spark: SparkSession, name: str, query: list[float], k: int) -> DataFrame:
    """(idx, score) of the k nearest, best first, then by position."""
    return search_batch(spark, name, [query], k).select("idx", "score").orderBy(F.desc("score"), "idx")


def _blocks(queries: list[list[float]] | DataFrame) -> Iterator[tuple[np.ndarray, list[list[float]]]]:
    """(numbers, vectors) of ``BLOCK`` queries at a time; of a table, the driver holds no more at once."""
    rows = ((r[0], r[1]) for r in queries.toLocalIterator()) if isinstance(queries, DataFrame) else enumerate(queries)
    while held := list(islice(rows, BLOCK)):
        yield np.array([n for n, _ in held], np.int64), [v for _, v in held]


def search_batch(spark: SparkSession, name: str, queries: list[list[float]] | DataFrame, k: int) -> DataFrame:
    """(query_no, idx, score) of the k nearest to each query: a list, numbered from 0, or a table (number, vector)."""
    rows, _, dim = _known(spark, name)
    best = None
    for numbers, vectors in _blocks(queries):
        unit = _unit(vectors, dim)
        if k > 0:
            part = _nearest(rows, unit, numbers, k)
            best = part if best is None else best.union(part)
    if best is None:
        return spark.createDataFrame([], "query_no long, idx long, score double")
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "idx")))
    return ranked.filter(F.col("r") <= k).select("query_no", "idx", "score")


def _nearest(rows: DataFrame, unit: np.ndarray, numbers: np.ndarray, k: int) -> DataFrame:
    """Each task's k nearest to each query."""
    shared = rows.sparkSession.sparkContext.broadcast((numbers, unit))

    def run(batches):
        import pyarrow as pa

        numbers, q = shared.value
        held_idx, held = np.empty((len(q), 0), np.int64), np.empty((len(q), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            idx = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(idx), -1)
            held = np.hstack([held, q @ v.T])
            held_idx = np.hstack([held_idx, np.broadcast_to(idx, (len(q), len(idx)))])
            if held.shape[1] > k:
                order = np.lexsort((held_idx, -held), axis=1)[:, :k]
                held, held_idx = np.take_along_axis(held, order, 1), np.take_along_axis(held_idx, order, 1)
        n = held.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, n)), pa.array(held_idx.ravel()), pa.array(held.ravel())], ["query_no", "idx", "score"])

    return rows.select("idx", "unit").mapInArrow(run, "query_no long, idx long, score double")


def search_expr(spark: SparkSession, name: str, query: list[float], k: int) -> DataFrame:
    """As ``search``, with higher-order functions in place of Arrow batches."""
    rows, _, dim = _known(spark, name)
    if k <= 0:
        return spark.createDataFrame([], "idx long, score double")
    q = F.array(*(F.lit(float(x)) for x in _unit([query], dim)[0]))
    return rows.select("idx", dot(F.col("unit"), q).alias("score")).orderBy(F.desc("score"), "idx").limit(k)
