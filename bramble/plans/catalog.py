"""Every query of the engine, beside the ANSI SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.functions.exprs import avg_decimal, cosine, dec, ieee_div, list_expr_sum, list_sum
from bramble.operators import aggregate, vector
from bramble.plans import advisor, tpch
from bramble.session import get_option, set_option
from bramble.sources import tables
from bramble.sources.tables import STAR, load
from bramble.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
D, N = tpch.D, tpch.N


def by_sql(key: str, text: str, oracle: str | None = None) -> None:
    """A query that both engines read as it is."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark, sf_dir, tuple(t for t in tables.TABLES if t in text))
        return spark.sql(text)

    _queries[key], _oracles[key] = run, oracle or text


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """A query by DataFrame operations, named as its function."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return add


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem")


QTY, PRICE, DISC, TAX = (lambda c=c: dec(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))  # columns need a session
wide = lambda c, s=2: c.cast(f"decimal(38,{s})")

for _k, _q in tpch.QUERIES.items():
    by_sql(_k, tpch.on_spark(_k), _q)

# --- scans, filters ---------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_project(spark, sf_dir):
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND (l_discount = 0.05 OR l_discount = 0.06) AND l_tax IS NOT NULL")
def scan_pushdown(spark, sf_dir):
    rows = items(spark, sf_dir).filter((F.col("l_quantity") > 45) & ((F.col("l_discount") == 0.05) | (F.col("l_discount") == 0.06)) & F.col("l_tax").isNotNull())
    return rows.select("l_orderkey", "l_linenumber")


@query(f"SELECT l_linenumber, {N} AS n FROM lineitem WHERE l_quantity * 2 > l_linenumber * 10 AND {D('l_discount')} < {D('l_tax')} GROUP BY l_linenumber")
def filter_residual(spark, sf_dir):
    return items(spark, sf_dir).filter((F.col("l_quantity") * 2 > F.col("l_linenumber") * 10) & (DISC() < TAX())).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


# --- expressions and predicates ---------------------------------------------------------------------


@query(f"SELECT CAST(SUM({tpch.PRICE} * (1 - {tpch.DISC})) AS DECIMAL(38,4)) AS revenue, CAST(SUM({tpch.QTY} + l_linenumber) AS DECIMAL(38,2)) AS added, CAST(SUM({tpch.PRICE} - {tpch.QTY}) AS DECIMAL(38,2)) AS less FROM lineitem")
def expr_arith(spark, sf_dir):
    return items(spark, sf_dir).agg(wide(F.sum(PRICE() * (1 - DISC())), 4).alias("revenue"), wide(F.sum(QTY() + F.col("l_linenumber"))).alias("added"), wide(F.sum(PRICE() - QTY())).alias("less"))


@query("""SELECT CAST(COUNT(CASE WHEN q = CAST('Infinity' AS DOUBLE) THEN 1 END) AS BIGINT) AS infinite, CAST(COUNT(CASE WHEN isnan(q) THEN 1 END) AS BIGINT) AS undefined,
 ROUND(AVG(CASE WHEN NOT isnan(q) AND q <> CAST('Infinity' AS DOUBLE) THEN q END), 6) AS mean
 FROM (SELECT (CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END) / l_discount AS q FROM (SELECT l_linenumber, l_quantity, CAST(l_discount AS DOUBLE) AS l_discount FROM lineitem) a) b""")
def expr_div(spark, sf_dir):
    q = ieee_div(F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(F.col("l_quantity")), F.col("l_discount"))
    inf = F.lit(float("inf"))
    rows = items(spark, sf_dir).select(q.alias("q"))
    return rows.agg(
        F.count(F.when((F.col("q") == inf), 1)).alias("infinite"), F.count(F.when(F.isnan("q"), 1)).alias("undefined"),
        F.round(F.avg(F.when(~F.isnan("q") & (F.col("q") != inf), F.col("q"))), 6).alias("mean"),
    )


@query(f"SELECT CAST(SUM(-{tpch.QTY}) AS DECIMAL(38,2)) AS negated, CAST(SUM(ABS({tpch.QTY} - 25)) AS DECIMAL(38,2)) AS distance, ROUND(SUM(ABS(l_quantity - 25.5)), 3) AS apart FROM lineitem")
def expr_unary(spark, sf_dir):
    return items(spark, sf_dir).agg(wide(F.sum(-QTY())).alias("negated"), wide(F.sum(F.abs(QTY() - 25))).alias("distance"), F.round(F.sum(F.abs(F.col("l_quantity") - 25.5)), 3).alias("apart"))


@query("SELECT ROUND(SUM(SIN(l_quantity) * COS(l_quantity) + SQRT(ABS(l_quantity) + 1)), 4) AS total FROM lineitem")
def expr_trig(spark, sf_dir):
    x = F.col("l_quantity")
    return items(spark, sf_dir).agg(F.round(F.sum(F.sin(x) * F.cos(x) + F.sqrt(F.abs(x) + 1)), 4).alias("total"))


@query(f"SELECT ROUND(SUM(CAST({tpch.QTY} AS DOUBLE) * l_linenumber), 2) AS total, ROUND(MAX(CAST({tpch.PRICE} AS DOUBLE)), 2) AS most FROM lineitem")
def cast_decimal_double(spark, sf_dir):
    return items(spark, sf_dir).agg(F.round(F.sum(QTY().cast("double") * F.col("l_linenumber")), 2).alias("total"), F.round(F.max(PRICE().cast("double")), 2).alias("most"))


@query(f"SELECT CAST(SUM(CAST({tpch.QTY} AS DECIMAL(18,5)) + CAST({D('l_discount')} AS DECIMAL(18,5))) AS DECIMAL(38,5)) AS total FROM lineitem")
def decimal_rescale(spark, sf_dir):
    return items(spark, sf_dir).agg(wide(F.sum(QTY().cast("decimal(18,5)") + DISC().cast("decimal(18,5)")), 5).alias("total"))


def counted(name: str, **tests: str) -> None:
    """A query that counts rows under each predicate."""
    by_sql(name, "SELECT " + ", ".join(f"CAST(COUNT(CASE WHEN {t} THEN 1 END) AS BIGINT) AS {k}" for k, t in tests.items()) + " FROM lineitem")


counted("pred_cmp", lt="l_quantity < 10", le="l_quantity <= 10", gt="l_quantity > 10", ge="l_quantity >= 10", eq="l_quantity = 10", ne="l_quantity <> 10")
counted("pred_bool", both="l_quantity > 10 AND l_linenumber = 1", either="l_quantity > 45 OR l_linenumber = 1 OR l_returnflag = 'A'", neither="NOT (l_quantity > 10 OR l_linenumber = 1)", unknown="NULLIF(l_quantity, 1) > 10 OR l_linenumber = 1")
counted("pred_between", inside="l_quantity BETWEEN 10 AND 20", outside="l_quantity NOT BETWEEN 10 AND 20", some="l_linenumber IN (1, 3, 5)")
counted("pred_date", before="l_shipdate < DATE '1996-01-01'", until="l_shipdate <= DATE '1998-09-02'", year="l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'")
by_sql("pred_notnull", f"SELECT {N} AS n, CAST(COUNT(NULLIF(o_orderstatus, 'F')) AS BIGINT) AS known FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') IS NOT NULL")
by_sql("case_like", f"SELECT CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_type IN ('PROMO', 'SMALL') THEN 'special' ELSE 'other' END AS kind, {N} AS n, CAST(SUM({D('p_retailprice')}) AS DECIMAL(38,2)) AS total FROM part GROUP BY 1")
by_sql("expr_strings", f"SELECT SUBSTRING(c_mktsegment, 1, 2) || '-' || CAST(c_nationkey AS VARCHAR(10)) AS code, UPPER(MIN(c_name)) AS first_name, CAST(MAX(LENGTH(c_name)) AS BIGINT) AS longest, CAST(GREATEST(MAX(c_custkey), 5) AS BIGINT) AS most FROM customer GROUP BY 1")
by_sql("expr_year", f"SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, {N} AS n FROM orders GROUP BY 1, 2")
by_sql("expr_date_add", f"SELECT CAST(CAST(o_orderdate AS DATE) + INTERVAL '30' DAY AS DATE) AS due, {N} AS n FROM orders GROUP BY 1")

# --- aggregates -------------------------------------------------------------------------------------


@query(f"SELECT {N} AS n, CAST(SUM({tpch.QTY}) AS DECIMAL(38,2)) AS total, ROUND(AVG(l_quantity), 6) AS mean, MIN(l_extendedprice) AS least, MAX(l_extendedprice) AS most FROM lineitem")
def agg_ungrouped(spark, sf_dir):
    return aggregate.aggregated(items(spark, sf_dir), {"n": F.count(F.lit(1)), "total": wide(F.sum(QTY())), "mean": F.round(F.avg("l_quantity"), 6), "least": F.min("l_extendedprice"), "most": F.max("l_extendedprice")})


@query(f"""SELECT {N} AS n, CAST(SUM({tpch.PRICE}) AS DECIMAL(38,2)) AS total, ROUND(AVG(l_discount), 6) AS mean, MIN(l_quantity) AS least, MAX(l_quantity) AS most
 FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_discount >= 0.03 AND l_quantity < 30""")
def agg_multi_filter(spark, sf_dir):
    where = (F.col("l_shipdate") >= F.lit("1996-01-01").cast("date")) & (F.col("l_discount") >= 0.03) & (F.col("l_quantity") < 30)
    return aggregate.aggregated(items(spark, sf_dir), {"n": F.count(F.lit(1)), "total": wide(F.sum(PRICE())), "mean": F.round(F.avg("l_discount"), 6), "least": F.min("l_quantity"), "most": F.max("l_quantity")}, where)


@query("SELECT ROUND(SUM(l_quantity), 2) AS total FROM lineitem")
def agg_sum_double(spark, sf_dir):
    return items(spark, sf_dir).agg(F.round(F.sum("l_quantity"), 2).alias("total"))


@query(f"SELECT CAST(SUM({tpch.PRICE}) AS DECIMAL(38,2)) AS total FROM lineitem")
def agg_sum_decimal(spark, sf_dir):
    return items(spark, sf_dir).agg(wide(F.sum(PRICE())).alias("total"))


@query(f"SELECT l_linenumber, {tpch.avg(tpch.PRICE)} AS mean FROM lineitem GROUP BY l_linenumber")
def agg_avg_decimal(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_linenumber").agg(F.round(avg_decimal(PRICE()), 6).alias("mean"))


@query("SELECT CAST(SUM(CAST(99999999999999999 AS DECIMAL(18,0))) AS DECIMAL(38,0)) AS total FROM lineitem")
def agg_decimal_overflow(spark, sf_dir):
    return items(spark, sf_dir).agg(wide(F.sum(F.lit("99999999999999999").cast("decimal(18,0)")), 0).alias("total"))


@query("SELECT MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship, MIN(l_partkey) AS least, MAX(l_returnflag) AS most FROM lineitem")
def agg_minmax(spark, sf_dir):
    return items(spark, sf_dir).agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.min("l_partkey").alias("least"), F.max("l_returnflag").alias("most"))


@query(f"SELECT {N} AS n, CAST(COUNT(NULLIF(o_orderstatus, 'F')) AS BIGINT) AS known, CAST(SUM(NULLIF(o_custkey, 1)) AS BIGINT) AS total, MIN(CASE WHEN o_custkey < 0 THEN 1 END) AS nothing FROM orders")
def agg_count_nulls(spark, sf_dir):
    return load(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif("o_orderstatus", F.lit("F"))).alias("known"), F.sum(F.nullif("o_custkey", F.lit(1))).alias("total"), F.min(F.when(F.col("o_custkey") < 0, 1)).alias("nothing"))


def SUMS():  # noqa: N802
    return {"total": wide(F.sum(PRICE())), "n": F.count(F.lit(1)), "least": F.min("l_quantity"), "most": F.max("l_quantity")}


SUMS_SQL = f"CAST(SUM({tpch.PRICE}) AS DECIMAL(38,2)) AS total, {N} AS n, MIN(l_quantity) AS least, MAX(l_quantity) AS most"


@query(f"SELECT l_linenumber, {SUMS_SQL} FROM lineitem GROUP BY l_linenumber")
def groupby_one_key(spark, sf_dir):
    return aggregate.grouped(items(spark, sf_dir), ["l_linenumber"], SUMS())


@query(f"SELECT l_returnflag, l_linestatus, {SUMS_SQL} FROM lineitem WHERE l_quantity > 5 GROUP BY l_returnflag, l_linestatus")
def groupby_two_keys(spark, sf_dir):
    return aggregate.grouped(items(spark, sf_dir), ["l_returnflag", "l_linestatus"], SUMS(), F.col("l_quantity") > 5)


@query(f"SELECT l_returnflag, {SUMS_SQL} FROM lineitem GROUP BY l_returnflag")
def groupby_string_key(spark, sf_dir):
    return aggregate.grouped(items(spark, sf_dir), ["l_returnflag"], SUMS())


@query(f"SELECT l_partkey, {SUMS_SQL} FROM lineitem GROUP BY l_partkey")
def groupby_dense(spark, sf_dir):
    return aggregate.grouped(items(spark, sf_dir), ["l_partkey"], SUMS())


@query(f"SELECT l_orderkey * 1000000 AS k, {SUMS_SQL} FROM lineitem GROUP BY l_orderkey * 1000000")
def groupby_wide_keys(spark, sf_dir):
    return aggregate.grouped(items(spark, sf_dir), [(F.col("l_orderkey") * 1000000).alias("k")], SUMS())


@query(f"SELECT l_suppkey AS k, {D('SUM(' + tpch.QTY + ')')} AS total, {N} AS n FROM lineitem GROUP BY l_suppkey")
def groupby_paths(spark, sf_dir):
    return aggregate.grouped(items(spark, sf_dir), [F.col("l_suppkey").alias("k")], {"total": F.sum(QTY()).cast("decimal(15,2)"), "n": F.count(F.lit(1))})


@query(f"SELECT p.path, l_linenumber AS k, {SUMS_SQL} FROM lineitem, (VALUES ('auto'), ('hash'), ('sort')) p(path) GROUP BY p.path, l_linenumber")
def setting_groupby_path(spark, sf_dir):
    """One grouping under each value of the setting."""
    before, out = get_option(spark, "groupby_path"), None
    for path in ("auto", "hash", "sort"):
        set_option(spark, "groupby_path", path)
        part = aggregate.grouped(items(spark, sf_dir), [F.col("l_linenumber").alias("k")], SUMS()).select(F.lit(path).alias("path"), "k", "total", "n", "least", "most")
        out = part if out is None else out.union(part)
    set_option(spark, "groupby_path", before)
    return out


@query(f"SELECT CAST(SUM(s) AS DECIMAL(38,2)) AS checksum FROM (SELECT l_partkey, SUM({tpch.QTY}) AS s FROM lineitem GROUP BY l_partkey) t")
def groupby_checksum(spark, sf_dir):
    return aggregate.groupby_checksum(items(spark, sf_dir).select("l_partkey", QTY().alias("q")), "l_partkey", "q").select(wide(F.col("checksum")).alias("checksum"))


@query(f"SELECT NULLIF(l_linenumber, 3) AS k, {SUMS_SQL} FROM lineitem GROUP BY NULLIF(l_linenumber, 3)")
def groupby_null_key(spark, sf_dir):
    return aggregate.grouped(items(spark, sf_dir), [F.nullif("l_linenumber", F.lit(3)).alias("k")], SUMS())


@query(f"SELECT l_suppkey, CAST(SUM(CASE WHEN l_suppkey % 7 <> 0 THEN {tpch.QTY} END) AS DECIMAL(38,2)) AS total, {N} AS n FROM lineitem GROUP BY l_suppkey")
def groupby_all_null_value(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_suppkey").agg(wide(F.sum(F.when(F.col("l_suppkey") % 7 != 0, QTY()))).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, MIN(l_quantity) AS least, MAX(l_quantity) AS most, MIN(CASE WHEN l_linenumber > 3 THEN l_discount END) AS least_late FROM lineitem GROUP BY l_partkey")
def groupby_minmax_many(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_partkey").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.min(F.when(F.col("l_linenumber") > 3, F.col("l_discount"))).alias("least_late"))


@query(f"SELECT l_suppkey, CAST(SUM({tpch.QTY}) AS DECIMAL(38,2)) AS total, CAST(COUNT(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey")
def rollup_table(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_suppkey", "l_shipdate", QTY().alias("q"))
    cut = F.lit("1998-01-01").cast("date")
    return aggregate.rollup_table([rows.filter(F.col("l_shipdate") < cut), rows.filter(F.col("l_shipdate") >= cut)], ["l_suppkey"], "q").select("l_suppkey", wide(F.col("total")).alias("total"), "n")


@query("SELECT l_returnflag, CAST(COUNT(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(COUNT(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS large FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_quantity") > 25).alias("large"))


@query("SELECT l_linenumber, CAST(MEDIAN(l_extendedprice) AS DOUBLE) AS mid FROM lineitem GROUP BY l_linenumber")
def agg_median(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_linenumber").agg(F.median("l_extendedprice").alias("mid"))


@query(f"SELECT l_orderkey, CAST(SUM({tpch.QTY}) AS DECIMAL(38,2)) AS total FROM lineitem GROUP BY l_orderkey HAVING SUM({tpch.QTY}) > 250")
def having(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_orderkey").agg(wide(F.sum(QTY())).alias("total")).filter("total > 250")


@query("""SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey""")
def collect_ordered(spark, sf_dir):
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey")
    lists = items(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("x"))
    return lists.select("l_orderkey", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_suppkey"].cast("string"))), ",").alias("lines"))


@query(f"SELECT CAST(SUM({tpch.PRICE}) AS DECIMAL(38,2)) AS total, MIN({tpch.PRICE}) AS least, MAX({tpch.PRICE}) AS greatest, CAST(COUNT(l_extendedprice) AS BIGINT) AS n FROM lineitem")
def multi_agg_column(spark, sf_dir):
    return aggregate.multi_agg(items(spark, sf_dir).select(PRICE().alias("p")), "p").withColumn("total", wide(F.col("total")))


by_sql("agg_rollup", f"SELECT l_returnflag, l_linestatus, {N} AS n, CAST(SUM({tpch.QTY}) AS DECIMAL(38,2)) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
by_sql("agg_cube", f"SELECT l_returnflag, l_linenumber, {N} AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linenumber)")
by_sql("agg_grouping_sets", f"SELECT l_returnflag, l_linenumber, {N} AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")

# --- lists ------------------------------------------------------------------------------------------

PARTS_OF = "SELECT l_orderkey, list(CASE WHEN l_linenumber < 0 THEN NULL ELSE l_partkey END ORDER BY l_linenumber, l_partkey, l_suppkey) AS xs FROM lineitem GROUP BY l_orderkey"


def part_lists(spark, sf_dir):
    rows = items(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda s: s["l_partkey"]).alias("xs"))


@query(f"SELECT l_orderkey, CAST(coalesce(list_sum(xs), 0) AS BIGINT) AS total, CAST(coalesce(list_sum(list_filter(xs, lambda x: x < 0)), 0) AS BIGINT) AS of_none FROM ({PARTS_OF}) t")
def list_sum_(spark, sf_dir):
    return part_lists(spark, sf_dir).select("l_orderkey", list_sum(F.col("xs")).alias("total"), list_sum(F.filter("xs", lambda x: x < 0)).alias("of_none"))


@query(f"SELECT l_orderkey, ROUND(list_sum(list_transform(xs, lambda x: sin(x) * cos(x) + sqrt(abs(x) + 1))), 6) AS total FROM ({PARTS_OF}) t")
def list_expr_sum_(spark, sf_dir):
    return part_lists(spark, sf_dir).select("l_orderkey", F.round(list_expr_sum(F.col("xs")), 6).alias("total"))


@query(f"""SELECT l_orderkey, CAST(len(xs) AS BIGINT) AS n, CAST(list_max(xs) AS BIGINT) AS most, CAST(list_sort(xs)[1] AS BIGINT) AS least, CAST(xs[1] AS BIGINT) AS first_part,
 array_to_string(list_transform(xs[1:2], lambda x: x * 2), ',') AS doubled FROM ({PARTS_OF}) t""")
def list_funcs(spark, sf_dir):
    x = F.col("xs")
    return part_lists(spark, sf_dir).select(
        "l_orderkey", F.size(x).cast("long").alias("n"), F.array_max(x).alias("most"), F.element_at(F.sort_array(x), 1).alias("least"), F.element_at(x, 1).alias("first_part"),
        F.array_join(F.transform(F.slice(x, 1, 2), lambda v: (v * 2).cast("string")), ",").alias("doubled"),
    )


for _old, _new in (("list_sum_", "list_sum"), ("list_expr_sum_", "list_expr_sum")):
    _queries[_new], _oracles[_new] = _queries.pop(_old), _oracles.pop(_old)

# --- vectors ----------------------------------------------------------------------------------------

COS = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))".format
TOP = 10


def pinned(spark, sf_dir, name="embeddings", precision="float64") -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    vector.pin(spark, name, rows, order="vec_id", precision=precision)
    return rows


def query_set(rows: DataFrame) -> DataFrame:
    """(number, vector) of every row whose id is divisible by 50: the query set of the batch searches below."""
    return rows.filter(F.col("vec_id") % 50 == 0).select("vec_id", "embedding")


def one_query(rows: DataFrame, i: int) -> list[float]:
    return list(rows.filter(F.col("vec_id") == i).select("embedding").first()[0])


def ranked(top: int, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT q.vec_id AS query_no, e.vec_id AS idx, {COS('e.embedding', 'q.embedding')} AS s,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS('e.embedding', 'q.embedding')} DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) t WHERE r <= {top}"""


@query("SELECT CAST(COUNT(*) AS BIGINT) AS vectors FROM embeddings")
def vss_pin_count(spark, sf_dir):
    pinned(spark, sf_dir)
    return vector.store(spark, "embeddings").agg(F.count(F.lit(1)).alias("vectors"))


@query("SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS idx, ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm FROM embeddings")
def vss_norms(spark, sf_dir):
    pinned(spark, sf_dir)
    unit = F.col("unit")
    return vector.store(spark, "embeddings").select("vec_id", "idx", F.round(F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@query(ranked(1, "query_no, idx, ROUND(s, 6) AS score"))
def vss_top1_self(spark, sf_dir):
    rows = pinned(spark, sf_dir)
    return vector.search_batch(spark, "embeddings", query_set(rows), 1).select("query_no", "idx", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS idx, ROUND(s, 6) AS score FROM (SELECT e.vec_id, {COS('e.embedding', 'q.embedding')} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0) t ORDER BY s DESC, vec_id LIMIT {TOP}")
def vss_topk(spark, sf_dir):
    rows = pinned(spark, sf_dir)
    return vector.search(spark, "embeddings", one_query(rows, 0), TOP).select("idx", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS idx, ROUND(s, 6) AS score FROM (SELECT e.vec_id, {COS('e.embedding', 'q.embedding')} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 1) t ORDER BY s DESC, vec_id LIMIT {TOP}")
def vss_topk_expr(spark, sf_dir):
    rows = pinned(spark, sf_dir)
    return vector.search_expr(spark, "embeddings", one_query(rows, 1), TOP).select("idx", F.round("score", 6).alias("score"))


@query(ranked(TOP, "query_no, idx, ROUND(s, 6) AS score"))
def vss_batch_topk(spark, sf_dir):
    rows = pinned(spark, sf_dir)
    return vector.search_batch(spark, "embeddings", query_set(rows), TOP).select("query_no", "idx", F.round("score", 6).alias("score"))


@query(ranked(1, "query_no, idx"))
def vss_half(spark, sf_dir):
    rows = pinned(spark, sf_dir, "embeddings-half", "float16")
    return vector.search_batch(spark, "embeddings-half", query_set(rows), 1).select("query_no", "idx")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, ROUND({COS('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    a = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b"))
    return a.join(rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b").select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("score"))


@query(ranked(TOP, "query_no, idx, CAST(r AS BIGINT) AS place"))
def lateral_topk(spark, sf_dir):
    rows = pinned(spark, sf_dir)
    found = vector.search_batch(spark, "embeddings", query_set(rows), TOP)
    from pyspark.sql import Window

    return found.select("query_no", "idx", F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "idx")).cast("long").alias("place"))


# --- resident tables --------------------------------------------------------------------------------


@query(f"SELECT l_returnflag, {SUMS_SQL} FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
def resident_filter_agg(spark, sf_dir):
    items(spark, sf_dir).createOrReplaceTempView("resident_lineitem")
    tables.pin(spark, "resident_lineitem", ["l_returnflag", "l_quantity", "l_extendedprice"])
    return aggregate.grouped(spark.table("resident_lineitem"), ["l_returnflag"], SUMS(), F.col("l_quantity") > 10)


@query(f"SELECT r_name, {N} AS n FROM (SELECT r_name FROM region UNION ALL SELECT r_name FROM region WHERE r_regionkey < 2) t GROUP BY r_name")
def append_refresh(spark, sf_dir):
    rows = load(spark, sf_dir, "region")
    rows.createOrReplaceTempView("appended_region")
    tables.pin(spark, "appended_region")
    rows.unionByName(rows.filter("r_regionkey < 2")).createOrReplaceTempView("appended_region")
    tables.pin(spark, "appended_region")  # not the plan that was held: it is read anew
    return spark.table("appended_region").groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


def is_held(spark, name: str) -> int:
    """Whether a view is answered from what is cached."""
    return int("InMemoryTableScan" in advisor.plan_text(spark.table(name)))


REPORT = " UNION ALL ".join(f"SELECT '{{1}}_{t}' AS table_name, {N} AS row_count, CAST({c} AS BIGINT) AS column_count, CAST({{0}} AS BIGINT) AS already_resident FROM {t}" for t, c in (("nation", 3), ("region", 2)))


def held(spark, sf_dir, prefix: str) -> tuple[str, ...]:
    """Views of two tables under names of their own, not resident."""
    names = []
    for t in ("nation", "region"):
        name = f"{prefix}_{t}"
        tables.unpin(spark, name)
        load(spark, sf_dir, t).createOrReplaceTempView(name)
        names.append(name)
    return tuple(names)


@query(REPORT.format(0, "report"))
def pin_report(spark, sf_dir):
    return tables.pin_report(spark, held(spark, sf_dir, "report"))


@query(REPORT.format(1, "again"))
def pin_again(spark, sf_dir):
    names = held(spark, sf_dir, "again")
    tables.pin_report(spark, names)
    return tables.pin_report(spark, names)


@query(f"SELECT 'ok' AS pinned, (SELECT {N} FROM nation) AS nations, (SELECT {N} FROM lineitem) AS items")
def pin_all(spark, sf_dir):
    """The star's tables at once, under their own names; they are let go again, as other queries read other folders."""
    tables.register(spark, sf_dir)
    said = tables.pin_all(spark)
    out = spark.createDataFrame([(said, *(spark.table(t).count() for t in ("nation", "lineitem")))], "pinned string, nations long, items long")
    for t in STAR:
        tables.unpin(spark, t)
    return out


@query("SELECT 'ok' AS cleared, CAST(0 AS BIGINT) AS still_resident, CAST(1 AS BIGINT) AS users_own")
def cache_clear(spark, sf_dir):
    """What the engine holds is given up, and what the user has cached is not."""
    mine = load(spark, sf_dir, "region").filter("r_regionkey >= 0").cache()
    names = held(spark, sf_dir, "cleared")
    tables.pin_report(spark, names)
    said = tables.unpin_all(spark)
    still = sum(is_held(spark, n) for n in names)
    out = spark.createDataFrame([(said, still, int(mine.storageLevel.useMemory))], "cleared string, still_resident long, users_own long")
    mine.unpersist()
    return out


@query(f"SELECT CAST(16 AS BIGINT) AS segments_total, CAST(12 AS BIGINT) AS segments_pruned, {N} AS row_count FROM lineitem")
def cache_stats(spark, sf_dir):
    """16 segments of a numbered table, of which a range of the first quarter excludes 12."""
    n = items(spark, sf_dir).count()
    rows = spark.range(0, n, 1, 16)
    return tables.cache_stats(rows, "id", high=n // 4 - 1).withColumn("row_count", F.lit(n).cast("long"))


@query("SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(i) AS BIGINT) AS total, CAST(MAX(i) AS BIGINT) AS most FROM range(100000) t(i)")
def range_source(spark, sf_dir):
    return spark.range(100_000).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"), F.max("id").alias("most"))


@query(f"SELECT {N} AS n FROM lineitem WHERE l_quantity > 25.5")
def set_variable(spark, sf_dir):
    items(spark, sf_dir).createOrReplaceTempView("variable_lineitem")
    spark.sql("DECLARE OR REPLACE VARIABLE least_quantity DOUBLE DEFAULT 0")
    spark.sql("SET VAR least_quantity = 25.5D")
    return spark.sql("SELECT COUNT(*) AS n FROM variable_lineitem WHERE l_quantity > least_quantity")


# --- settings and advice ----------------------------------------------------------------------------


@query("SELECT 'bramble' AS engine, true AS names_versions, 'ok' AS selftest")
def engine_info(spark, sf_dir):
    said = advisor.info(spark)
    return spark.createDataFrame([(said.split()[0], f"spark={spark.version}" in said and "python=" in said, advisor.selftest(spark))], "engine string, names_versions boolean, selftest string")


def four(rows: DataFrame) -> DataFrame:
    """An aggregate that the cost rules serve: four expressions in one pass."""
    x, y = F.col("l_extendedprice"), F.col("l_quantity")
    return rows.agg(F.round(F.sum(F.floor(x * 100 + 0.5) * 0.01), 2).alias("total"), F.round(F.avg(x - y), 4).alias("mean"), F.min(x + y).alias("least"), F.max(x - y).alias("most"))


FOUR = "ROUND(SUM(FLOOR(l_extendedprice * 100 + 0.5) * 0.01), 2) AS total, ROUND(AVG(l_extendedprice - l_quantity), 4) AS mean, MIN(l_extendedprice + l_quantity) AS least, MAX(l_extendedprice - l_quantity) AS most"


def served(spark, sf_dir, name: str, execution: str, min_rows: int) -> tuple[DataFrame, str, str, int]:
    """The aggregate under settings, which are put back; its path and reason, and whether it left its columns resident."""
    before = {k: get_option(spark, k) for k in ("execution", "min_rows")}
    tables.unpin(spark, name)
    items(spark, sf_dir).createOrReplaceTempView(name)
    try:
        set_option(spark, "execution", execution)
        set_option(spark, "min_rows", min_rows)
        out, told = advisor.serve(spark, name, four, ["l_extendedprice", "l_quantity"])
    finally:
        for k, v in before.items():
            set_option(spark, k, v)
    return out, told.path.value, told.reason.value, is_held(spark, name)


def by_settings(name: str, *cases: tuple[str, str, int, str, str, int]) -> None:
    """A query that answers the aggregate under each case: label, execution, least rows; path, reason and residency that follow."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for i, (label, execution, min_rows, *_) in enumerate(cases):
            found, path, reason, resident = served(spark, sf_dir, f"{name}_{i}", execution, min_rows)
            part = found.select(F.lit(label).alias("label"), F.lit(path).alias("path"), F.lit(reason).alias("reason"), F.lit(resident).cast("long").alias("resident"), "total", "mean", "least", "most")
            out = part if out is None else out.union(part)
        return out

    _queries[name] = run
    _oracles[name] = " UNION ALL ".join(f"SELECT '{label}' AS label, '{path}' AS path, '{reason}' AS reason, CAST({resident} AS BIGINT) AS resident, {FOUR} FROM lineitem" for label, _, _, path, reason, resident in cases)


by_settings("cold_residency", ("cold", "true", 0, "AGG", "SERVED", 1))
by_settings("setting_execution", ("on", "true", 0, "AGG", "SERVED", 1), ("off", "false", 0, "GENERAL", "OFF", 0))
by_settings("setting_min_rows", ("few", "true", 1 << 60, "GENERAL", "FEW_ROWS", 0), ("enough", "true", 1, "AGG", "SERVED", 1))


@query("SELECT * FROM (VALUES ('critical', true), ('debug', true), ('error', true), ('info', true), ('loud', false), ('off', true), ('trace', true), ('warn', true)) t(level, accepted)")
def setting_log_level(spark, sf_dir):
    before, rows = get_option(spark, "log_level"), []
    for level in ("trace", "debug", "info", "warn", "error", "critical", "off", "loud"):
        try:
            set_option(spark, "log_level", level)
            rows.append((level, get_option(spark, "log_level") == level))
        except ValueError:
            rows.append((level, False))
    set_option(spark, "log_level", before)
    return spark.createDataFrame(rows, "level string, accepted boolean")


#: What is asked, the shape, and the reason that the cost rules give.
SHAPES = [
    ("plain sum", advisor.Shape(10**7, 1, 1, 1), "SCAN_BOUND"), ("count", advisor.Shape(10**7, 1, 0), "SCAN_BOUND"), ("few rows", advisor.Shape(1000, 4, 4), "FEW_ROWS"), ("two decimals", advisor.Shape(10**7, 2, 2, 0, 2), "DECIMAL_FEW_AGGS"),
    ("large decimals", advisor.Shape(10**7, 4, 4, 0, 4, bound=1 << 60), "OVERFLOW_RISK"), ("three keys", advisor.Shape(10**7, 2, 2, keys=3), "KEYS_UNSUPPORTED"), ("null keys", advisor.Shape(10**7, 2, 2, keys=1, nullable_keys=True), "KEYS_UNSUPPORTED"),
    ("cold groups", advisor.Shape(10**6, 2, 2, keys=1, groups=50), "COLD_LOW_CARD"), ("resident groups", advisor.Shape(10**6, 2, 2, keys=1, groups=50, resident=True), "SERVED"), ("many rows", advisor.Shape(10**7, 2, 2, keys=1, groups=50), "SERVED"),
    ("median", advisor.Shape(10**7, 2, 2, unsupported_aggregate=True), "AGGREGATE_UNSUPPORTED"), ("like", advisor.Shape(10**7, 2, 2, unsupported_expression=True), "EXPRESSION_UNSUPPORTED"), ("no aggregate", advisor.Shape(10**7, 0, 0), "NOT_AN_AGGREGATE"),
    ("expressions", advisor.Shape(10**7, 4, 4), "SERVED"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{r}')" for k, _, r in SHAPES) + ") t(asked, reason)")
def decline_reasons(spark, sf_dir):
    return spark.createDataFrame([(k, advisor.decide(spark, x).reason.value) for k, x, _ in SHAPES], "asked string, reason string")


@query("""SELECT * FROM (VALUES ('count', 'GENERAL', 'SCAN_BOUND'), ('distinct', 'GENERAL', 'AGGREGATE_UNSUPPORTED'), ('expressions', 'AGG', 'SERVED'), ('groups', 'GENERAL', 'COLD_LOW_CARD'), ('like', 'GENERAL', 'EXPRESSION_UNSUPPORTED'),
 ('rows', 'GENERAL', 'NOT_AN_AGGREGATE'), ('sum', 'GENERAL', 'SCAN_BOUND')) t(asked, path, reason)""")
def explain_operator(spark, sf_dir):
    """The path that each plan shows, with rows and groups taken from the table."""
    rows, before = items(spark, sf_dir), get_option(spark, "min_rows")
    asked = {
        "count": rows.agg(F.count(F.lit(1)).alias("n")), "distinct": rows.agg(F.countDistinct("l_suppkey").alias("n"), F.sum("l_tax").alias("s")), "expressions": four(rows), "groups": rows.groupBy("l_linenumber").agg(F.sum("l_quantity").alias("s"), F.min("l_tax").alias("t")),
        "like": rows.filter(F.col("l_returnflag").like("%A_B%")).agg(F.sum("l_quantity").alias("s"), F.min("l_tax").alias("t")), "rows": rows.select("l_tax"), "sum": rows.agg(F.sum("l_quantity").alias("s")),
    }
    set_option(spark, "min_rows", 1)
    try:
        told = [(k, d.path.value, d.reason.value) for k, d in ((k, advisor.advise(df)) for k, df in asked.items())]
    finally:
        set_option(spark, "min_rows", before)
    return spark.createDataFrame(told, "asked string, path string, reason string")


# --- joins, sets, subqueries, order -----------------------------------------------------------------

by_sql("semi_exists", f"SELECT c_mktsegment, {N} AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_mktsegment")
by_sql("anti_not_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
by_sql(
    "anti_not_in", f"SELECT {N} AS n FROM part WHERE {tpch.not_in('p_partkey', 'l_partkey', 'lineitem', 'l_quantity > 49')}",
    f"SELECT {N} AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
)
by_sql("self_join_theta", f"SELECT a.l_linenumber, {N} AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_linenumber")
by_sql("join_or_predicate", f"SELECT p_brand, {N} AS n FROM lineitem, part WHERE (p_partkey = l_partkey AND p_size < 10 AND l_quantity < 5) OR (p_partkey = l_partkey AND p_size > 40 AND l_quantity > 45) GROUP BY p_brand")
by_sql("join_left_outer", f"SELECT n_name, CAST(COUNT(s_suppkey) AS BIGINT) AS suppliers FROM nation LEFT OUTER JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n_name")
by_sql("join_using", f"SELECT l_linenumber, {N} AS n FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') o USING (l_orderkey) GROUP BY l_linenumber")
by_sql("scalar_subquery", f"SELECT l_linenumber, {N} AS n FROM lineitem WHERE l_extendedprice > (SELECT AVG(l_extendedprice) FROM lineitem) GROUP BY l_linenumber")
by_sql("correlated_subquery", "SELECT p_partkey, p_brand FROM part WHERE p_retailprice = (SELECT MIN(p2.p_retailprice) FROM part p2 WHERE p2.p_brand = part.p_brand)")
by_sql("set_except", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")
by_sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
by_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")
by_sql("order_by", "SELECT n_regionkey, n_name, n_nationkey FROM nation ORDER BY n_regionkey DESC, n_name ASC")
by_sql("topk_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
by_sql("derived_table", "SELECT n, CAST(COUNT(*) AS BIGINT) AS orders FROM (SELECT l_orderkey, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey) t GROUP BY n")
by_sql("window_rank", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders) t WHERE place <= 2")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf_dir):
    return streams.tumbling(load(spark, sf_dir, "events")).withColumn("total", wide(F.col("total"), 4))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
