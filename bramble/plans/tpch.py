"""The TPC-H queries (public, fixed texts) on the driver's star schema, in SQL that Spark and an ANSI engine share.

Windows of 1992-1994 are moved to 1996, as data begin in 1995; literals are
such as occur.  Where a table or column is missing, the query keeps its
operators over a stand-in: supplies are distinct (part, supplier) pairs of
lineitem.  Money is exact decimal; averages and ratios are rounded doubles.
"""

from __future__ import annotations

D = "CAST({} AS DECIMAL(15,2))".format
PRICE, DISC, TAX, QTY = D("l_extendedprice"), D("l_discount"), D("l_tax"), D("l_quantity")
REVENUE = f"CAST(SUM({PRICE} * (1 - {DISC})) AS DECIMAL(38,4))"
SUPPLY = f"""(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, MIN({PRICE}) AS ps_supplycost,
  CAST(SUM({QTY}) AS DECIMAL(38,2)) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"""
N = "CAST(COUNT(*) AS BIGINT)"


def ratio(a: str, b: str, digits: int = 6) -> str:
    return f"ROUND(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE), {digits})"


def avg(x: str) -> str:
    return ratio(f"SUM({x})", f"COUNT({x})")


QUERIES = {
    "tpch_q1": f"""
SELECT l_returnflag, l_linestatus, CAST(SUM({QTY}) AS DECIMAL(38,2)) AS sum_qty, CAST(SUM({PRICE}) AS DECIMAL(38,2)) AS sum_base_price,
  {REVENUE} AS sum_disc_price, CAST(SUM({PRICE} * (1 - {DISC}) * (1 + {TAX})) AS DECIMAL(38,6)) AS sum_charge,
  {avg(QTY)} AS avg_qty, {avg(PRICE)} AS avg_price, {avg(DISC)} AS avg_disc, {N} AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q2": f"""
SELECT CAST(s_acctbal AS DECIMAL(15,2)) AS s_acctbal, s_name, n_name, p_partkey, p_brand
FROM part, supplier, {SUPPLY} ps, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 15 AND p_type LIKE '%ARD' AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'EUROPE' AND ps_supplycost = (
    SELECT MIN(ps2.ps_supplycost) FROM {SUPPLY} ps2, supplier s2, nation n2, region r2
    WHERE p_partkey = ps2.ps_partkey AND s2.s_suppkey = ps2.ps_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')""",
    "tpch_q3": f"""
SELECT l_orderkey, {REVENUE} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'
GROUP BY l_orderkey, CAST(o_orderdate AS DATE) ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": f"""
SELECT o_orderpriority, {N} AS order_count FROM orders
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
    "tpch_q5": f"""
SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name""",
    "tpch_q6": f"""
SELECT CAST(SUM({PRICE} * {DISC}) AS DECIMAL(38,4)) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND {DISC} BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q7": f"""
SELECT supp_nation, cust_nation, l_year, CAST(SUM(volume) AS DECIMAL(38,4)) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS l_year, {PRICE} * (1 - {DISC}) AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
    AND l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1997-01-01') shipping GROUP BY supp_nation, cust_nation, l_year""",
    "tpch_q8": f"""
SELECT o_year, {ratio("SUM(CASE WHEN nation = 'NATION_6' THEN volume ELSE 0 END)", "SUM(volume)")} AS mkt_share FROM (
  SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {PRICE} * (1 - {DISC}) AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01'
    AND p_type = 'ECONOMY') all_nations GROUP BY o_year""",
    "tpch_q9": f"""
SELECT nation, o_year, CAST(SUM(amount) AS DECIMAL(38,4)) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {PRICE} * (1 - {DISC}) - CAST(ps_supplycost / 1000 AS DECIMAL(15,2)) * {QTY} AS amount
  FROM part, supplier, lineitem, {SUPPLY} ps, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
    AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') profit GROUP BY nation, o_year""",
    "tpch_q10": f"""
SELECT c_custkey, c_name, {REVENUE} AS revenue, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, CAST(c_acctbal AS DECIMAL(15,2)), n_name
ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
SELECT ps_partkey, CAST(SUM(ps_supplycost * ps_availqty) AS DECIMAL(38,4)) AS value FROM {SUPPLY} ps, supplier, nation
WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey
HAVING SUM(ps_supplycost * ps_availqty) > (SELECT SUM(ps_supplycost * ps_availqty) * 0.0001 FROM {SUPPLY} ps, supplier, nation
  WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')""",
    "tpch_q12": """
SELECT l_returnflag, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_returnflag""",
    "tpch_q13": f"""
SELECT c_count, {N} AS custdist FROM (SELECT c_custkey, CAST(COUNT(o_orderkey) AS BIGINT) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey
  AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) c_orders GROUP BY c_count""",
    "tpch_q14": f"""
SELECT {ratio(f"100 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN {PRICE} * (1 - {DISC}) ELSE 0 END)", f"SUM({PRICE} * (1 - {DISC}))")} AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""",
    "tpch_q15": f"""
WITH revenue0 AS (SELECT l_suppkey AS supplier_no, {REVENUE} AS total_revenue FROM lineitem
  WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue0 WHERE s_suppkey = supplier_no AND total_revenue = (SELECT MAX(total_revenue) FROM revenue0)""",
    "tpch_q16": f"""
SELECT p_brand, p_type, p_size, CAST(COUNT(DISTINCT ps_suppkey) AS BIGINT) AS supplier_cnt FROM {SUPPLY} ps, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "tpch_q17": f"""
SELECT {ratio(f"SUM({PRICE})", "7.0")} AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#3'
  AND l_quantity < (SELECT 0.5 * AVG(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": f"""
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice, CAST(SUM({QTY}) AS DECIMAL(38,2)) AS sum_qty
FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 300)
  AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE), CAST(o_totalprice AS DECIMAL(15,2))
ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
SELECT {REVENUE} AS revenue FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""",
    "tpch_q20": f"""
SELECT s_suppkey, s_name FROM supplier, nation WHERE s_suppkey IN (
  SELECT ps_suppkey FROM {SUPPLY} ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%')
    AND ps_availqty > (SELECT 0.5 * CAST(SUM({QTY}) AS DECIMAL(20,2)) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
      AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01')) AND s_nationkey = n_nationkey AND n_name <> 'NATION_3'""",
    "tpch_q21": f"""
SELECT s_name, {N} AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": f"""
SELECT cntrycode, {N} AS numcust, CAST(SUM(c_acctbal) AS DECIMAL(38,2)) AS totacctbal FROM (
  SELECT SUBSTRING(c_mktsegment, 1, 2) AS cntrycode, {D("c_acctbal")} AS c_acctbal FROM customer
  WHERE SUBSTRING(c_mktsegment, 1, 2) IN ('BU', 'AU', 'MA', 'HO') AND {D("c_acctbal")} > (SELECT AVG({D("c_acctbal")}) FROM customer WHERE c_acctbal > 0.00)
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) custsale GROUP BY cntrycode""",
}


def cents(x: str) -> str:
    """Hundredths as whole numbers: money and quantities are doubles that stand for them."""
    return f"FLOOR({x} * 100 + 0.5)"


def lanes(whole: str, scale: int) -> str:
    """The exact sum of 64-bit numbers, in two 64-bit parts that don't overflow below 2**43 rows a group, at a decimal scale."""
    return f"CAST((CAST(SUM(SHIFTRIGHT({whole}, 20)) AS DECIMAL(20,0)) * 1048576 + CAST(SUM({whole} & 1048575) AS DECIMAL(20,0))) AS DECIMAL(30,0)) * CAST({10.0**-scale:.{scale}f} AS DECIMAL({scale + 1},{scale}))"


def of(where: str) -> str:
    """Supplies of some lines only."""
    return SUPPLY.replace("GROUP BY", f"WHERE {where} GROUP BY")


_C = {x: cents(f"l_{x}") for x in ("extendedprice", "discount", "tax", "quantity")}
_NET = f"{_C['extendedprice']} * (100 - {_C['discount']})"
#: Sums that Spark takes over 64-bit numbers in place of wide decimals.
_SUMS = {
    REVENUE: f"CAST({lanes(_NET, 4)} AS DECIMAL(38,4))",
    f"CAST(SUM({PRICE} * (1 - {DISC}) * (1 + {TAX})) AS DECIMAL(38,6))": f"CAST({lanes(f'{_NET} * (100 + {_C["tax"]})', 6)} AS DECIMAL(38,6))",
    f"CAST(SUM({PRICE} * {DISC}) AS DECIMAL(38,4))": f"CAST({lanes(f'{_C["extendedprice"]} * {_C["discount"]}', 4)} AS DECIMAL(38,4))",
    f"CAST(SUM({PRICE}) AS DECIMAL(38,2))": f"CAST({lanes(_C['extendedprice'], 2)} AS DECIMAL(38,2))",
    f"CAST(SUM({QTY}) AS DECIMAL(38,2))": f"CAST({lanes(_C['quantity'], 2)} AS DECIMAL(38,2))",
}
for _x, _c in ((QTY, _C["quantity"]), (PRICE, _C["extendedprice"]), (DISC, _C["discount"])):
    _SUMS[avg(_x)] = ratio(lanes(_c, 2), "COUNT(*)")  # the columns are free of nulls where these are asked for
#: Supplies are grouped for the lines that a query can use; NOT IN is an anti join beside checks for nulls, which needs no broadcast.
_PARTS = {
    "tpch_q2": "l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 15 AND p_type LIKE '%ARD')",
    "tpch_q9": "l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%')",
    "tpch_q11": "l_suppkey IN (SELECT s_suppkey FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_name = 'NATION_7')",
    "tpch_q20": "l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%')",
}


def not_in(key: str, column: str, rows: str, where: str) -> str:
    """``key NOT IN (SELECT column FROM rows WHERE where)``."""
    return (
        f"(NOT EXISTS (SELECT 1 FROM {rows} WHERE {where} AND {column} = {key}) AND NOT EXISTS (SELECT 1 FROM {rows} WHERE {where} AND {column} IS NULL) "
        f"AND ({key} IS NOT NULL OR NOT EXISTS (SELECT 1 FROM {rows} WHERE {where})))"
    )


def on_spark(key: str) -> str:
    """The text that Spark runs: equal rows, by a plan that suits it."""
    text = QUERIES[key]
    if key in _PARTS:
        text = text.replace(SUPPLY, of(_PARTS[key]))
    if key == "tpch_q16":
        text = text.replace("ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)", not_in("ps_suppkey", "s_suppkey", "supplier", "s_acctbal < 0"))
    for decimal, whole in _SUMS.items():
        text = text.replace(decimal, whole)
    return text
