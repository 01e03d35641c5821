"""Settings, expressions, resident tables, vectors and the advisor."""

import math
from decimal import Decimal

import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, given, settings
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bramble import session as s
from bramble.functions.exprs import ieee_div, list_expr_sum, list_sum
from bramble.operators import aggregate, vector
from bramble.plans import advisor
from bramble.plans.advisor import Path, Reason, Shape, advise, decide
from bramble.sources import tables
from bramble.streaming import events


@pytest.fixture(autouse=True)
def defaults(spark):
    yield
    for key in s.SETTINGS:
        spark.conf.unset(key)


def test_settings(spark):
    s.set_option(spark, "min_rows", 10)
    assert s.get_option(spark, "engine.min_rows") == "10"
    with pytest.raises(ValueError, match="auto, hash, sort"):
        s.set_option(spark, "groupby_path", "fast")
    with pytest.raises(ValueError, match="trace, debug"):
        s.set_option(spark, "log_level", "loud")
    with pytest.raises(ValueError, match="unknown setting"):
        s.set_option(spark, "speed", 1)
    with pytest.raises(ValueError):
        s.set_option(spark, "min_rows", -1)


def test_division(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in rows.select(ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3:] == [0.5, None, None]


def test_lists(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "x array<bigint>")
    assert [r[0] for r in rows.select(list_sum(F.col("x"))).collect()] == [6, 0, None]
    assert [r[0] for r in rows.select(list_expr_sum(F.col("x"))).collect()][1:] == [0.0, None]
    with pytest.raises(PySparkException, match="NULL elements"):
        spark.createDataFrame([([1, None],)], "x array<bigint>").select(list_sum(F.col("x"))).collect()


def test_aggregates_of_nothing(spark):
    row = aggregate.aggregated(spark.range(10), {"total": F.sum("id"), "n": F.count("id")}, F.col("id") > 100).first()
    assert row["total"] is None and row["n"] == 0


def test_three_valued_logic(spark):
    rows = spark.createDataFrame([(None, 5), (None, 0), (2, None), (0, None)], "a int, b int")
    assert rows.filter((F.col("a") > 1) | (F.col("b") > 1)).count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.decimals(-1000, 1000, places=2))), min_size=1, max_size=40))
def test_grouping(spark, rows):
    frame = spark.createDataFrame(rows, "k int, v decimal(15,2)")
    want: dict = {}
    for k, v in rows:
        total, n = want.get(k, (None, 0))
        want[k] = (total if v is None else (total or Decimal(0)) + v, n + 1)
    for path in ("hash", "sort"):
        s.set_option(spark, "groupby_path", path)
        got = aggregate.grouped(frame, ["k"], {"total": F.sum("v"), "n": F.count(F.lit(1))}).collect()
        assert {r["k"]: (r["total"], r["n"]) for r in got} == want


def test_rollup_merges_partials(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    merged = aggregate.rollup_table([rows.filter("v < 300"), rows.filter("v >= 300 and v < 301"), rows.filter("v >= 301")], ["k"], "v")
    direct = rows.groupBy("k").agg(F.sum("v").alias("total"), F.count("v").alias("n"))
    assert merged.exceptAll(direct).count() == 0 and merged.count() == 7


def test_pinning(spark):
    spark.range(1000).select("id", (F.col("id") % 4).alias("g")).createOrReplaceTempView("pin_me")
    mine = spark.range(50).cache()
    assert tables.pin(spark, "pin_me") == (1000, 2, 0)
    assert tables.pin(spark, "pin_me") == (1000, 2, 1)
    assert "InMemoryTableScan" in advisor.plan_text(spark.sql("SELECT g, sum(id) FROM pin_me GROUP BY g"))
    spark.range(1001).select("id", (F.col("id") % 4).alias("g")).createOrReplaceTempView("pin_me")
    assert tables.pin(spark, "pin_me") == (1001, 2, 0)
    spark.range(0).createOrReplaceTempView("pin_none")
    assert tables.pin(spark, "pin_none") == (0, 0, 0)
    with pytest.raises(ValueError, match="no table"):
        tables.pin(spark, "not_there")
    with pytest.raises(ValueError, match="not_there"):
        tables.pin_all(spark, ("pin_me", "not_there"))
    assert tables.unpin_all(spark) == "ok"
    assert mine.storageLevel.useMemory
    assert "InMemoryTableScan" not in advisor.plan_text(spark.sql("SELECT g, sum(id) FROM pin_me GROUP BY g"))
    mine.unpersist()


def test_cache_stats(spark):
    total, pruned = tables.cache_stats(spark.range(0, 10000, 1, 10), "id", high=2500).first()
    assert total == 10 and pruned == 7


def embeddings(spark, n=100):
    return spark.range(n).select("id", F.array(*(F.sin(F.col("id") * 10 + j).cast("float") for j in range(8))).alias("v"))


def test_vectors(spark):
    rows = embeddings(spark)
    assert vector.pin(spark, "e", rows, order="id", column="v") == 100
    q = [list(r[0]) for r in rows.orderBy("id").select("v").collect()]
    best = vector.search(spark, "e", q[42], 5).collect()
    assert best[0]["idx"] == 42 and abs(best[0]["score"] - 1) < 1e-9 and [r["score"] for r in best] == sorted((r["score"] for r in best), reverse=True)
    assert [(r["idx"], round(r["score"], 9)) for r in vector.search_expr(spark, "e", q[42], 5).collect()] == [(r["idx"], round(r["score"], 9)) for r in best]
    batch = vector.search_batch(spark, "e", q[:20], 1).collect()
    assert {(r["query_no"], r["idx"]) for r in batch} == {(i, i) for i in range(20)}
    assert vector.search(spark, "e", q[0], 0).count() == 0
    assert vector.search(spark, "e", q[0], 1000).count() == 100
    assert vector.search_batch(spark, "e", [], 3).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        vector.search(spark, "e", [1.0], 1)
    with pytest.raises(ValueError, match="no vectors"):
        vector.search(spark, "other", q[0], 1)
    with pytest.raises(ValueError, match="precision"):
        vector.pin(spark, "e", rows, order="id", column="v", precision="int8")
    with pytest.raises(ValueError, match="NULL"):
        vector.pin(spark, "e", rows.union(spark.createDataFrame([(100, None)], rows.schema)), order="id", column="v")
    with pytest.raises(ValueError, match="lengths"):
        vector.pin(spark, "e", rows.union(spark.createDataFrame([(100, [1.0])], rows.schema)), order="id", column="v")
    assert vector.pin(spark, None, rows, order="id") is None
    assert vector.pin(spark, "e", rows, order="id", column="v", precision="float16") == 100
    half = vector.search(spark, "e", q[7], 1).first()
    assert half["idx"] == 7 and half["score"] > 0.999
    vector.unpin(spark, "e")


def test_equal_vectors_rank_by_position(spark):
    rows = spark.range(20).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    vector.pin(spark, "ties", rows, order="id", column="v")
    assert [r["idx"] for r in vector.search(spark, "ties", [1.0, 0.0], 3).collect()] == [0, 1, 2]


def test_advisor_gates(spark):
    many = 10_000_000
    assert decide(spark, Shape(many, 2, 2)).path is Path.AGG
    assert decide(spark, Shape(many, 2, 2, resident=True)).path is Path.AGG_RESIDENT
    assert decide(spark, Shape(1000, 2, 2)).reason is Reason.FEW_ROWS
    assert decide(spark, Shape(many, 1, 1, plain=1)).reason is Reason.SCAN_BOUND
    assert decide(spark, Shape(many, 2, 2, decimals=2)).reason is Reason.DECIMAL_FEW_AGGS
    assert decide(spark, Shape(1_000_000, 2, 2, keys=1, groups=50)).reason is Reason.COLD_LOW_CARD
    assert decide(spark, Shape(1_000_000, 2, 2, keys=1, groups=50, resident=True)).path is Path.GROUPBY_RESIDENT
    assert decide(spark, Shape(many, 3, 3, decimals=3, bound=1 << 40)).reason is Reason.OVERFLOW_RISK
    assert decide(spark, Shape(many, 2, 2, keys=3)).reason is Reason.KEYS_UNSUPPORTED
    assert decide(spark, Shape(many, 2, 2, unsupported_aggregate=True)).reason is Reason.AGGREGATE_UNSUPPORTED
    s.set_option(spark, "execution", False)
    assert decide(spark, Shape(many, 2, 2)).reason is Reason.OFF


def test_advisor_reads_plans(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("x"))
    assert advise(rows.agg(F.sum("x")), 10**7).reason is Reason.SCAN_BOUND
    assert advise(rows.agg(F.sum(F.sin("x") * 2), F.max("x")), 10**7).path is Path.AGG
    assert advise(rows.groupBy("g").agg(F.sum("x")), 10**7, groups=5).path is Path.GROUPBY
    assert advise(rows.groupBy("g").agg(F.sum("x")), 10**6, groups=5).reason is Reason.COLD_LOW_CARD
    assert advise(rows.agg(F.median("x")), 10**7).reason is Reason.AGGREGATE_UNSUPPORTED
    assert advise(rows.filter("id > 3"), 10**7).reason is Reason.NOT_AN_AGGREGATE


def test_self_test(spark):
    assert advisor.selftest(spark) == "ok" and "spark=" in advisor.info(spark)


def test_stream_equals_batch(spark, small, tmp_path):
    batch = tables.load(spark, small, "events")
    source = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(small)
    q = events.stream(source).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {(str(r[0]), *r[1:]) for r in events.tumbling(batch).collect()}
    assert {(str(r[0]), *r[1:]) for r in spark.table("streamed").collect()} == want
