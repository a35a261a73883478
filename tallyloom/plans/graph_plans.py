"""Queries over graphs that are derived from the trade between customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators import graph as gr
from tallyloom.operators import ordered as od
from tallyloom.operators import paths as pa
from tallyloom.plans.registry import query
from tallyloom.sources.store import dealt, store
from tallyloom.sources.tables import load

NATION_SQL = """
  counted AS (
    SELECT c_nationkey AS u, s_nationkey AS v, count(*) AS n
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
  edges AS (SELECT u::BIGINT AS u, v::BIGINT AS v, n % 97 + 1 AS w FROM counted
            QUALIFY n * count(*) OVER (PARTITION BY u) > sum(n) OVER (PARTITION BY u))
"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per (customer, supplier): the heavy join, aggregated before anything else is joined."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    items = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_suppkey")
    rows = items.count()
    met = dealt(items, rows, "key").join(orders, "key").select("o_custkey", "l_suppkey")
    return dealt(met, rows, "o_custkey", "l_suppkey").groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def nation_edges(spark: SparkSession, sf_dir: str, traded: DataFrame | None = None) -> DataFrame:
    """``(u, v, w)``: from each customer nation to the supplier nations it buys more from than on average."""
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("u"))
    suppliers = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("v"))
    traded = traded if traded is not None else trade(spark, sf_dir)
    counted = (
        traded.join(customers, "o_custkey").join(suppliers, "l_suppkey")
        .filter("u <> v").groupBy("u", "v").agg(F.sum("n").alias("n"))
    )
    own = Window.partitionBy("u")
    strong = counted.withColumns({"links": F.count(F.lit(1)).over(own), "total": F.sum("n").over(own)})
    return strong.filter(F.col("n") * F.col("links") > F.col("total")).select("u", "v", (F.col("n") % 97 + 1).alias("w"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))


@query("reachable", f"""
WITH RECURSIVE {NATION_SQL}, walk AS (
  SELECT n_nationkey::BIGINT AS source, n_nationkey::BIGINT AS target, 0::BIGINT AS hops FROM nation
  UNION SELECT source, e.v, hops + 1 FROM walk JOIN edges e ON e.u = target WHERE hops < 25)
SELECT source, target, min(hops) AS hops FROM walk GROUP BY ALL""")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.reachable(nation_edges(spark, sf_dir), nations(spark, sf_dir).withColumnRenamed("id", "source"))


@query("path_exists", f"""
WITH RECURSIVE {NATION_SQL}, walk AS (
  SELECT n_nationkey::BIGINT AS source, n_nationkey::BIGINT AS target FROM nation
  UNION SELECT source, e.v FROM walk JOIN edges e ON e.u = target)
SELECT DISTINCT o_custkey, l_suppkey, w.source IS NOT NULL AS found
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN walk w ON w.source = s_nationkey AND w.target = c_nationkey""")
def path_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer and supplier that trade: do links also lead back from the supplier's nation?"""
    traded = store(trade(spark, sf_dir), "trade").df
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("goal"))
    suppliers = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("start"))
    probes = traded.select("o_custkey", "l_suppkey").join(customers, "o_custkey").join(suppliers, "l_suppkey")
    edges = nation_edges(spark, sf_dir, traded)
    return gr.path_exists(edges, probes, "start", "goal").select("o_custkey", "l_suppkey", "found")


GOODS_SQL = """
  traded AS (SELECT o_custkey AS c, -1 - l_suppkey AS s, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned
             FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  links AS (SELECT s AS u, c AS v FROM traded WHERE n >= 3 UNION ALL SELECT c, s FROM traded WHERE returned >= 2)
"""


@query("goods_paths", f"""
WITH RECURSIVE {GOODS_SQL}, walk AS (
  SELECT DISTINCT c AS source, c AS target FROM traded
  UNION SELECT source, v FROM walk JOIN links ON u = target)
SELECT t.c AS customer, t.s AS supplier, w.source IS NOT NULL AS found
FROM traded t LEFT JOIN walk w ON w.source = t.c AND w.target = t.s""")
def goods_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer and supplier that trade: can goods get back from the customer to the supplier, over suppliers
    that take returns and customers they deliver to?"""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    traded = items.join(orders, "l_orderkey").groupBy(F.col("o_custkey").alias("customer"), (-1 - F.col("l_suppkey")).alias("supplier")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    traded = store(traded, "goods").df
    out = traded.filter("n >= 3").select(F.col("supplier").alias("u"), F.col("customer").alias("v"))
    back = traded.filter("returned >= 2").select(F.col("customer").alias("u"), F.col("supplier").alias("v"))
    return pa.connected(out.unionByName(back), traded.select("customer", "supplier"), "customer", "supplier")


DIST_SQL = """
  dist(v, d) USING KEY (v) AS (
    SELECT {source}::BIGINT, 0::BIGINT
    UNION SELECT c.v, c.d FROM (SELECT e.v, min(x.d + e.w)::BIGINT AS d FROM dist x JOIN edges e ON e.u = x.v GROUP BY e.v) c
          LEFT JOIN recurring.dist o ON o.v = c.v WHERE o.d IS NULL OR c.d < o.d)
"""


@query("shortest_pair", f"""
WITH RECURSIVE {NATION_SQL}, {DIST_SQL.format(source=0)}
SELECT 0::BIGINT AS source, 24::BIGINT AS goal, (SELECT d FROM dist WHERE v = 24)::DOUBLE AS dist""")
def shortest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gr.shortest_pair(nation_edges(spark, sf_dir), 0, 24)
    return found.withColumn("dist", F.col("dist").cast("double"))


@query("shortest_from_source", f"""
WITH RECURSIVE {NATION_SQL.replace("edges AS", "plain AS")}, edges AS (SELECT u, v, w + 10 * u - 10 * v AS w FROM plain),
{DIST_SQL.format(source=0)}
SELECT x.v, d.d::DOUBLE AS dist
FROM (SELECT u AS v FROM edges UNION SELECT v FROM edges UNION SELECT 0) x LEFT JOIN dist d ON d.v = x.v""")
def shortest_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances with negative edges: a potential per vertex shifts the lengths, cycle sums stay as they are."""
    shifted = nation_edges(spark, sf_dir).withColumn("w", F.col("w") + 10 * F.col("u") - 10 * F.col("v"))
    found = gr.shortest_from(shifted, 0)
    return found.withColumn("dist", F.col("dist").cast("double"))


TRADE_SQL = """
  pairs AS (SELECT o_custkey AS c, -1 - l_suppkey AS s, count(*) % 97 + 1 AS w
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  edges AS (SELECT c AS u, s AS v, w FROM pairs UNION ALL SELECT s, c, w FROM pairs)
"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and (negative) suppliers linked both ways by their common line items."""
    pairs = trade(spark, sf_dir).select(
        F.col("o_custkey").alias("c"), (-1 - F.col("l_suppkey")).alias("s"), (F.col("n") % 97 + 1).alias("w"))
    return pairs.select(F.inline(F.array(
        F.struct(F.col("c").alias("u"), F.col("s").alias("v"), "w"),
        F.struct(F.col("s").alias("u"), F.col("c").alias("v"), "w"))))


def most_edges(spark: SparkSession, sf_dir: str) -> int:
    return 2 * load(spark, sf_dir, "lineitem").count()


@query("shortest_trade", f"""
WITH RECURSIVE {TRADE_SQL}, {DIST_SQL.format(source="(SELECT min(o_custkey) FROM orders)")}
SELECT x.v, d.d::DOUBLE AS dist FROM (SELECT DISTINCT v FROM edges) x LEFT JOIN dist d ON d.v = x.v""")
def shortest_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = load(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0]
    found = gr.shortest_from(trade_edges(spark, sf_dir), first, size=most_edges(spark, sf_dir))
    return found.withColumn("dist", F.col("dist").cast("double"))


@query("shortest_trade_pair", f"""
WITH RECURSIVE {TRADE_SQL}, {DIST_SQL.format(source="(SELECT min(o_custkey) FROM orders)")}
SELECT (SELECT min(o_custkey) FROM orders)::VARCHAR AS source, (SELECT max(o_custkey) FROM orders)::VARCHAR AS goal,
       (SELECT d FROM dist WHERE v = (SELECT max(o_custkey) FROM orders))::DOUBLE AS dist""")
def shortest_trade_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first customer to the last one, over ids that are strings."""
    ends = load(spark, sf_dir, "orders").agg(F.min("o_custkey"), F.max("o_custkey")).first()
    named = trade_edges(spark, sf_dir).select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "w")
    found = gr.shortest_pair(named, str(ends[0]), str(ends[1]), size=most_edges(spark, sf_dir))
    return found.withColumn("dist", F.col("dist").cast("double"))


@query("reachable_trade", f"""
WITH RECURSIVE {TRADE_SQL}, hop(v, hops) USING KEY (v) AS (
  SELECT (SELECT min(o_custkey) FROM orders)::BIGINT, 0::BIGINT
  UNION SELECT DISTINCT e.v, x.hops + 1 FROM hop x JOIN edges e ON e.u = x.v
        LEFT JOIN recurring.hop o ON o.v = e.v WHERE o.v IS NULL)
SELECT v AS target, hops FROM hop""")
def reachable_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the first customer is linked to, with the number of links."""
    first = load(spark, sf_dir, "orders").select("o_custkey").agg(F.min("o_custkey").alias("source"))
    return gr.reachable(trade_edges(spark, sf_dir), first).select("target", "hops")


@query("all_pairs", f"""
WITH RECURSIVE {NATION_SQL}, dist(u, v, d) USING KEY (u, v) AS (
  SELECT x, x, 0::BIGINT FROM (SELECT u AS x FROM edges UNION SELECT v FROM edges)
  UNION SELECT c.u, c.v, c.d FROM (
    SELECT x.u, e.v, min(x.d + e.w)::BIGINT AS d FROM dist x JOIN edges e ON e.u = x.v GROUP BY x.u, e.v) c
  LEFT JOIN recurring.dist o ON o.u = c.u AND o.v = c.v WHERE o.d IS NULL OR c.d < o.d)
SELECT u, v, d AS dist FROM dist""")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.all_pairs(nation_edges(spark, sf_dir))


@query("topo_levels", f"""
WITH RECURSIVE {NATION_SQL}, walk AS (
  SELECT n_nationkey::BIGINT AS id, 0 AS level FROM nation
  UNION SELECT e.v, level + 1 FROM walk JOIN edges e ON e.u = id AND e.u < e.v)
SELECT id, max(level) AS level FROM walk GROUP BY id""")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    forward = nation_edges(spark, sf_dir).filter("u < v")
    return gr.topological_levels(forward, nations(spark, sf_dir)).withColumn("level", F.col("level").cast("int"))


@query("event_depth", """
WITH rows AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n,
                     count(*) OVER (PARTITION BY event_type) AS last FROM events),
ends AS (SELECT (-10 - user_id % 10)::BIGINT AS id, max(last) AS level FROM rows WHERE n = last GROUP BY ALL)
SELECT event_id AS id, n - 1 AS level FROM rows
UNION ALL SELECT id, level FROM ends UNION ALL SELECT -1, max(level) + 1 FROM ends HAVING count(*) > 0""")
def event_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a deep graph: events of a type follow each other, the last ones lead to classes of users, those to one end."""
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id")
    after = od.with_next(events, ["event_type"], ["ts", "event_id"], next="event_id")
    group = (F.lit(-10) - F.col("user_id") % 10).cast("bigint")
    steps = after.select(F.col("event_id").alias("u"), F.coalesce("next", group).alias("v"))
    last = after.filter(F.col("next").isNull()).select(group.alias("u"), F.lit(-1).cast("bigint").alias("v")).distinct()
    return gr.topological_levels(steps.unionByName(last))


@query("spanning_tree", f"""
WITH RECURSIVE {NATION_SQL}, und AS (
  SELECT least(u, v) AS u, greatest(u, v) AS v, min(w) * 1000000 + least(u, v) * 1000 + greatest(u, v) AS w
  FROM edges GROUP BY least(u, v), greatest(u, v)),
both_ways AS (SELECT u, v, w FROM und UNION ALL SELECT v, u, w FROM und),
walk AS (SELECT w AS edge, u AS at_id FROM und
         UNION SELECT k.edge, b.v FROM walk k JOIN both_ways b ON b.u = k.at_id AND b.w < k.edge)
SELECT u, v, w FROM und WHERE NOT EXISTS (SELECT 1 FROM walk k WHERE k.edge = und.w AND k.at_id = und.v)""")
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.least("u", "v"), F.greatest("u", "v")
    undirected = nation_edges(spark, sf_dir).groupBy(low.alias("u"), high.alias("v")).agg(F.min("w").alias("w"))
    unique = undirected.withColumn("w", F.col("w") * 1_000_000 + F.col("u") * 1000 + F.col("v"))
    return gr.spanning_forest(unique)


@query("chain_cycles", """
WITH RECURSIVE chain AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 <> 3
         THEN (s_suppkey * s_suppkey + 1) % (SELECT count(*) FROM supplier) END AS succ FROM supplier),
walk AS (SELECT id, succ, 1 AS steps FROM chain WHERE succ IS NOT NULL
         UNION ALL SELECT w.id, c.succ, steps + 1 FROM walk w JOIN chain c ON c.id = w.succ
         WHERE c.succ IS NOT NULL AND steps < (SELECT count(*) FROM supplier))
SELECT c.id, coalesce(max(w.steps), 0) >= (SELECT count(*) FROM supplier) AS cyclic
FROM chain c LEFT JOIN walk w ON w.id = c.id GROUP BY c.id""")
def chain_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey")
    total = suppliers.count()
    key = F.col("s_suppkey")
    residue = key % total
    succ = F.when(key % 10 != 3, (residue * residue + 1) % total)
    return gr.cyclic(suppliers.select(key.alias("id"), succ.alias("succ")))
