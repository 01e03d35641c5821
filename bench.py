"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A warm-up, whose times are reported as cold, then hot repetitions whose mean counts.
Results go to Spark's noop sink, so that every row is made and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from bramble.operators import aggregate, vector  # noqa: E402
from bramble.plans import catalog  # noqa: E402
from bramble.session import session  # noqa: E402
from bramble.sources import tables  # noqa: E402

REPEAT = int(os.environ.get("BENCH_REPEAT", "5"))
KEYS = [
    *(f"tpch_q{i}" for i in range(1, 23)),
    "expr_trig", "agg_sum_double", "agg_multi_filter", "groupby_one_key", "groupby_wide_keys",
]


def vectors(n: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tables.load(spark, sf_dir, "embeddings").filter(F.col("vec_id") < n).orderBy("vec_id")
        return vector.search_batch(spark, "bench", queries[n], 10) if (queries.setdefault(n, [list(r[0]) for r in rows.select("embedding").collect()])) else rows

    return run


queries: dict[int, list[list[float]]] = {}


def resident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 over the pinned columns of lineitem."""
    return spark.sql(
        """SELECT l_returnflag, l_linestatus, sum(l_quantity) q, sum(l_extendedprice) p, sum(l_extendedprice * (1 - l_discount)) d, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) c,
        avg(l_quantity) aq, avg(l_extendedprice) ap, avg(l_discount) ad, count(*) n FROM bench_lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = cpus if cpus.isdigit() else "8"
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": parts, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    work = {k: catalog.queries()[k] for k in KEYS}
    tables.load(spark, sf_dir, "lineitem").createOrReplaceTempView("bench_lineitem")
    began = time.perf_counter()
    tables.pin(spark, "bench_lineitem", ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"])
    vector.pin(spark, "bench", tables.load(spark, sf_dir, "embeddings"), order="vec_id")
    pin_s = time.perf_counter() - began
    work |= {
        "q1_resident": resident,
        "sum_resident": lambda s, d: aggregate.multi_agg(s.table("bench_lineitem"), "l_extendedprice"),
        "vss_1": vectors(1), "vss_32": vectors(32), "vss_128": vectors(128),
    }
    cold, hot = {}, {}
    for name, f in work.items():
        began = time.perf_counter()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        cold[name] = round(time.perf_counter() - began, 4)
    for name, f in work.items():
        began = time.perf_counter()
        for _ in range(REPEAT):
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        hot[name] = round((time.perf_counter() - began) / REPEAT, 4)
    print(json.dumps({"metric": "total of hot means", "value": round(sum(hot.values()), 4), "unit": "sec", "queries": hot, "cold": cold, "pin_sec": round(pin_s, 3), "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
