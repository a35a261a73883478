"""Queries over customers, orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import tables
from tallyloom.operators import aggregates as ag
from tallyloom.operators import itemsets as it
from tallyloom.operators import ordered as od
from tallyloom.operators import selection as se
from tallyloom.operators import similarity as si
from tallyloom.operators import worklist as wl
from tallyloom.plans.registry import query
from tallyloom.sources.tables import load


@query("ready_orders", """
SELECT o_orderkey, o_orderstatus FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def ready_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    records = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_returnflag")
    flag = F.col("l_returnflag")
    return wl.ready(orders, records, "key", flag == "A", flag == "R").withColumnRenamed("key", "o_orderkey")


TOLERANCE = 50_000.0

RECONCILE_SQL = f"""
WITH billed AS (
  SELECT l_orderkey AS o_orderkey,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS actual FROM lineitem GROUP BY 1),
cases AS (
  SELECT coalesce(o.o_orderkey, b.o_orderkey) AS o_orderkey, o.o_custkey, o.o_totalprice AS expected, b.actual,
         CASE WHEN o.o_totalprice IS NULL THEN 'UNEXPECTED' WHEN b.actual IS NULL THEN 'ERROR'
              WHEN abs(o.o_totalprice - b.actual) <= {TOLERANCE} THEN 'PASS' ELSE 'FAIL' END AS status
  FROM orders o FULL OUTER JOIN billed b ON o.o_orderkey = b.o_orderkey)
"""


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("expected"))
    actual = (
        load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("actual"))
    )
    return wl.reconcile(expected, actual, "o_orderkey", TOLERANCE)


@query("reconcile", RECONCILE_SQL + "SELECT o_orderkey, expected, actual, status FROM cases")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_cases(spark, sf_dir).select("o_orderkey", "expected", "actual", "status")


@query("unsettled_cases", RECONCILE_SQL + "SELECT o_orderkey, status FROM cases WHERE status <> 'PASS'")
def unsettled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wl.unsettled(order_cases(spark, sf_dir), "o_orderkey")


@query("reconcile_three_ways", f"""
WITH billed AS (
  SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS actual,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS truth
  FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, coalesce(abs(actual - o_totalprice) <= {TOLERANCE / 10}, false) AS matches_expected,
       coalesce(abs(actual - truth) <= {TOLERANCE / 10}, false) AS matches_truth,
       coalesce(abs(actual - o_totalprice) <= {TOLERANCE / 10} AND abs(actual - truth) <= {TOLERANCE / 10}, false) AS matches_both
FROM orders o LEFT JOIN billed b ON b.o_orderkey = o.o_orderkey""")
def reconcile_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was billed against the order's total (expected) and against the discounted price (truth)."""
    price, left = F.col("l_extendedprice").cast("decimal(18,2)"), F.lit(1) - F.col("l_discount").cast("decimal(4,2)")
    billed = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(price).cast("double").alias("actual"), F.sum(price * left).cast("double").alias("truth"))
    cases = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("expected")).join(billed, "o_orderkey", "left")
    return wl.against_both(cases, "actual", "expected", "truth", TOLERANCE / 10).select(
        "o_orderkey", "matches_expected", "matches_truth", "matches_both")


PASS_SQL = RECONCILE_SQL + """, rates AS (
  SELECT coalesce(n_name, 'unknown') AS n_name, count(*) AS found, count(*) FILTER (status <> 'ERROR') AS tested,
         count(*) FILTER (status = 'ERROR') AS skipped, count(*) FILTER (status = 'PASS') AS passed,
         count(*) FILTER (status = 'PASS') = count(*) FILTER (status <> 'ERROR') AS all_passed
  FROM cases LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
"""


@query("pass_rate", PASS_SQL + "SELECT * FROM rates")
def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted per customer first, so that neither join moves single orders; cases of no order are "unknown"."""
    per_customer = wl.pass_rates(order_cases(spark, sf_dir), ["o_custkey"], F.col("status") == "PASS", F.col("status") != "ERROR")
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    per_nation = wl.roll_up(per_customer.join(customers, "o_custkey", "left"), ["c_nationkey"])
    named = per_nation.join(nations, "c_nationkey", "left").withColumn("n_name", F.coalesce("n_name", F.lit("unknown")))
    return wl.roll_up(named, ["n_name"])


@query("pass_overview", PASS_SQL + """
SELECT count(*) AS keys, count(*) FILTER (all_passed) AS succeeded, sum(found)::BIGINT AS found,
       sum(tested)::BIGINT AS tested, sum(skipped)::BIGINT AS skipped, sum(passed)::BIGINT AS passed FROM rates""")
def pass_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_rate(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("keys"), F.count_if("all_passed").alias("succeeded"),
        *[F.sum(c).alias(c) for c in ["found", "tested", "skipped", "passed"]],
    )


@query("status_by_phase", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O",
       count(*) FILTER (o_orderstatus = 'P') AS "n_P",
       count(*) FILTER (coalesce(o_orderstatus NOT IN ('F', 'O', 'P'), true)) AS n_other, count(*) AS total FROM orders GROUP BY 1""")
def status_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.status_counts(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("batches", """
SELECT c_custkey, c_nationkey,
       (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 6 AS batch FROM customer""")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return od.batch_number(customers, ["c_nationkey"], ["c_custkey"], 6)


@query("displacement", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS came,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sorted_pos FROM orders)
SELECT o_custkey, o_orderkey, sorted_pos, abs(came - sorted_pos) AS moved, abs(came - sorted_pos) <= 3 AS within_k
FROM r""")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    moved = od.displacement(orders, ["o_custkey"], ["o_orderkey"], ["o_orderdate", "o_orderkey"], 3)
    return moved.select("o_custkey", "o_orderkey", "sorted_pos", "moved", "within_k")


@query("global_rank", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders""")
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return od.numbered(orders, [], ["o_totalprice", "o_orderkey"], "rank")


@query("short_keys", "SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '' ELSE to_base(o_orderkey, 36) END AS code FROM orders")
def short_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", ag.radix(F.col("o_orderkey"), 36).alias("code"))


@query("short_key_clashes", """
SELECT bits, count(*) AS codes, sum(n)::BIGINT AS keys, max(n) AS most FROM (
  SELECT code, length(code) AS bits, count(DISTINCT o_custkey) AS n
  FROM (SELECT o_custkey, CASE WHEN o_custkey = 0 THEN '' ELSE right(to_base(o_custkey, 2), 8) END AS code FROM orders)
  GROUP BY 1, 2) GROUP BY bits""")
def short_key_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers would share a code if only the last eight binary digits were kept."""
    keys = load(spark, sf_dir, "orders").select("o_custkey").distinct()
    codes = keys.groupBy(F.right(ag.radix(F.col("o_custkey"), 2), F.lit(8)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return codes.groupBy(F.length("code").cast("bigint").alias("bits")).agg(
        F.count(F.lit(1)).alias("codes"), F.sum("n").alias("keys"), F.max("n").alias("most"))


# --- line items --------------------------------------------------------------------------------------

@query("quantity_histogram", """
SELECT b.bucket, count(l_quantity) AS n FROM (SELECT unnest(range(max(CAST(l_quantity AS BIGINT)) + 1)) AS bucket FROM lineitem) b
LEFT JOIN lineitem ON CAST(l_quantity AS BIGINT) = b.bucket GROUP BY b.bucket""")
def quantity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram(load(spark, sf_dir, "lineitem"), "l_quantity")


@query("counting_sort", """
SELECT row_number() OVER (ORDER BY l_quantity) - 1 AS pos, CAST(l_quantity AS BIGINT) AS value FROM lineitem""")
def counting_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.counting_sort(load(spark, sf_dir, "lineitem"), "l_quantity")


GRANULARITY_SQL = """
WITH RECURSIVE v AS (
  SELECT l_partkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity) AS rn
  FROM (SELECT DISTINCT l_partkey, l_quantity FROM lineitem)),
fold AS (
  SELECT l_partkey, rn, q AS g FROM v WHERE rn = 1
  UNION ALL
  SELECT f.l_partkey, v.rn, gcd(f.g, v.q) FROM fold f JOIN v ON v.l_partkey = f.l_partkey AND v.rn = f.rn + 1)
SELECT l_partkey, min(g) AS gcd FROM fold GROUP BY l_partkey"""


@query("fold_table_function", GRANULARITY_SQL)
def fold_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SQL, in two steps: each task's states, then all of a key's. Rows travel packed."""
    tables.register(spark)
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("q"))
    part = spark.sql("SELECT * FROM fold_part(TABLE(SELECT * FROM {rows}), 'l_partkey', 'q', 'gcd')", rows=tables.packed(rows))
    states = tables.unpacked(part).repartition("l_partkey").sortWithinPartitions("l_partkey")
    whole = spark.sql("SELECT l_partkey, value AS gcd FROM fold_all(TABLE(SELECT * FROM {states}), 'l_partkey', 'gcd')", states=tables.packed(states))
    return tables.unpacked(whole)


@query("quantity_granularity", GRANULARITY_SQL)
def quantity_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.granularity(load(spark, sf_dir, "lineitem"), ["l_partkey"], F.col("l_quantity"))


@query("cube_revenue", """
SELECT l_returnflag, l_linestatus, coalesce(year(l_shipdate), -1) AS ship_year,
       grouping(l_returnflag, l_linestatus, year(l_shipdate)) AS grouping,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
       count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, year(l_shipdate))""")
def cube_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("bigint"))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    kept = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    cube = ag.cube_sum(items, ["l_returnflag", "l_linestatus", "ship_year"], price * kept, "revenue")
    return cube.withColumns({"revenue": F.col("revenue").cast("double"), "ship_year": F.coalesce("ship_year", F.lit(-1))})


@query("kth_price", """
SELECT l_returnflag, l_extendedprice AS kth FROM (
  SELECT l_returnflag, l_extendedprice,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k FROM lineitem)
WHERE k = 1000""")
def kth_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.kth_smallest(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 1000)


@query("equal_range", """
SELECT l_returnflag, l_quantity, min(pos) AS first_pos, max(pos) AS last_pos FROM (
  SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS pos
  FROM lineitem) GROUP BY 1, 2""")
def equal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.equal_range(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


BRANDS_SQL = """WITH held AS (
  SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


def order_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(brands, "l_partkey")


@query("frequent_pairs", BRANDS_SQL + """
SELECT a.p_brand AS brand_1, b.p_brand AS brand_2, count(*) AS support
FROM held a JOIN held b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand
GROUP BY ALL HAVING count(*) >= 5""")
def frequent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ag.frequent_combinations(order_brands(spark, sf_dir), "l_orderkey", "p_brand", 2, 5)
    return found.select(F.col("items")[0].alias("brand_1"), F.col("items")[1].alias("brand_2"), "support")


@query("frequent_triples", BRANDS_SQL + """
SELECT a.p_brand AS brand_1, b.p_brand AS brand_2, c.p_brand AS brand_3, count(*) AS support
FROM held a JOIN held b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand
JOIN held c ON b.l_orderkey = c.l_orderkey AND b.p_brand < c.p_brand
GROUP BY ALL HAVING count(*) >= 5""")
def frequent_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ag.frequent_combinations(order_brands(spark, sf_dir), "l_orderkey", "p_brand", 3, 5)
    return found.select(*[F.col("items")[i].alias(f"brand_{i + 1}") for i in range(3)], "support")


@query("frequent_sets", BRANDS_SQL.replace("WITH", "WITH RECURSIVE", 1).rstrip() + """,
grown AS (
  SELECT l_orderkey, p_brand AS items, p_brand AS last FROM held
  UNION ALL SELECT g.l_orderkey, g.items || ',' || h.p_brand, h.p_brand FROM grown g JOIN held h ON h.l_orderkey = g.l_orderkey AND h.p_brand > g.last)
SELECT items, length(items) - length(replace(items, ',', '')) + 1 AS size, count(*) AS support FROM grown GROUP BY 1, 2 HAVING count(*) >= 4""")
def frequent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of brands of any size that at least four orders hold together."""
    found = it.frequent_sets(order_brands(spark, sf_dir), "l_orderkey", "p_brand", 4)
    return found.select(F.array_join("items", ",").alias("items"), F.size("items").cast("bigint").alias("size"), "support")


# --- parts -------------------------------------------------------------------------------------------

@query("fuzzy_part_names", """
WITH n AS (SELECT DISTINCT p_name AS w FROM part)
SELECT a.w AS name_a, b.w AS name_b, levenshtein(a.w, b.w) AS distance
FROM n a JOIN n b ON a.w < b.w AND levenshtein(a.w, b.w) <= 4""")
def fuzzy_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.fuzzy_pairs(load(spark, sf_dir, "part"), "p_name", 4)


@query("budget_select", """
WITH RECURSIVE items AS (
  SELECT p_brand, p_size AS weight, CAST(round(p_retailprice) AS BIGINT) AS value,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part),
state AS (
  SELECT p_brand, 0::BIGINT AS rank, 0 AS used, 0::BIGINT AS total FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL
  SELECT p_brand, rank, used, max(total) AS total FROM (
    SELECT s.p_brand, i.rank, s.used + t.take * i.weight AS used, s.total + t.take * i.value AS total
    FROM state s JOIN items i ON i.p_brand = s.p_brand AND i.rank = s.rank + 1
    CROSS JOIN (VALUES (0), (1)) t(take)
    WHERE s.used + t.take * i.weight <= 60) GROUP BY p_brand, rank, used)
SELECT p_brand, max(total) AS best_value FROM state GROUP BY p_brand""")
def budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.round("p_retailprice").cast("bigint")
    return se.best_under_capacity(load(spark, sf_dir, "part"), ["p_brand"], F.col("p_size"), value, F.lit(60))
