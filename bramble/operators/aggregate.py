"""Aggregation operators: one pass for many aggregates, exact decimals, partial roll-ups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.session import get_option


def aggregated(df: DataFrame, aggregates: dict[str, Column], where: Column | None = None) -> DataFrame:
    """All ``aggregates`` (name -> expression) over the rows of ``df`` that pass, in one pass."""
    rows = df if where is None else df.filter(where)
    return rows.agg(*(c.alias(n) for n, c in aggregates.items()))


def grouped(df: DataFrame, keys: Iterable[str | Column], aggregates: dict[str, Column], where: Column | None = None) -> DataFrame:
    """As ``aggregated``, for each group; null keys are groups of their own.

    Setting engine.groupby_path=sort brings each key's rows together in order before
    they are aggregated; hash and auto leave the choice to Catalyst.  Results are equal.
    """
    rows = df if where is None else df.filter(where)
    keys = list(keys)
    if get_option(df.sparkSession, "groupby_path") == "sort":
        rows = rows.repartition(*(F.col(k) if isinstance(k, str) else k for k in keys)).sortWithinPartitions(*keys)
    return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def multi_agg(df: DataFrame, column: str) -> DataFrame:
    """Sum, least, greatest and count of one column in one read."""
    return df.agg(F.sum(column).alias("total"), F.min(column).alias("least"), F.max(column).alias("greatest"), F.count(column).alias("n"))


def groupby_checksum(df: DataFrame, key: str, value: str) -> DataFrame:
    """The sum over groups of their sums."""
    return df.groupBy(key).agg(F.sum(value).alias("s")).agg(F.sum("s").alias("checksum"))


def rollup_table(parts: Iterable[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Sums and counts by ``keys`` from partial tables, one a part, as appends leave them: merging reads partials, not rows."""
    merged = None
    for part in parts:
        sums = part.groupBy(*keys).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
        merged = sums if merged is None else merged.unionByName(sums)
    if merged is None:
        raise ValueError("no parts")
    return merged.groupBy(*keys).agg(F.sum("s").alias("total"), F.sum("n").alias("n"))
