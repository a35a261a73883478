"""Queries over ``events``: streaks, windows, segments, positions, attempts, chains, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import tables
from tallyloom.operators import aggregates as ag
from tallyloom.operators import graph as gr
from tallyloom.operators import nested as ne
from tallyloom.operators import ordered as od
from tallyloom.plans.registry import query
from tallyloom.sources.tables import load, parse_cases

KINDS = ["signup", "click", "view", "purchase", "error"]
DAY = 86_400_000_000
WEEK = 7 * DAY


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("at", F.unix_micros("ts"))


def prop_k() -> Column:
    return F.from_json("props", "k BIGINT")["k"]


def error_step() -> Column:
    """+2 for an error with k >= 90 (the heavy kind), +1 for any other error, -1 for a success."""
    heavy = F.when(prop_k() >= 90, 2).otherwise(1)
    return F.when(F.col("event_type") == "error", heavy).otherwise(-1).cast("bigint")


LEVELS_SQL = """
  WITH steps AS (
    SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN -1
           WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 90 THEN 2 ELSE 1 END AS step
    FROM events),
  sums AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                     ROWS UNBOUNDED PRECEDING) AS s FROM steps),
  lows AS (SELECT *, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                  ROWS UNBOUNDED PRECEDING) AS low FROM sums),
  levels AS (SELECT event_id, user_id, ts, CAST(s - least(0, low) AS BIGINT) AS level FROM lows)
"""


@query("error_level", LEVELS_SQL + "SELECT event_id, user_id, level FROM levels")
def error_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    leveled = od.clamped_level(events(spark, sf_dir).select("event_id", "user_id", "at", "event_type", "props"),
                               ["user_id"], ["at", "event_id"], error_step())
    return leveled.select("event_id", "user_id", "level")


@query("backoff_delay", LEVELS_SQL + """
SELECT event_id, CASE WHEN level > 0 THEN least(4.0::DOUBLE * pow(2.0, level), 30.0) ELSE 4.0 END::DOUBLE AS delay
FROM levels""")
def backoff_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_level(spark, sf_dir).select("event_id", od.backoff(F.col("level"), 4.0, 30.0).alias("delay"))


@query("user_error_profile", LEVELS_SQL + """
SELECT user_id, count(*) AS total, count(*) FILTER (level = 0) AS calm, max(level) AS worst,
       count(*) FILTER (level = 0)::DOUBLE / count(*) AS calm_rate,
       sum(CASE WHEN level > 0 THEN least(4.0::DOUBLE * pow(2.0, level), 30.0) ELSE 4.0 END)::DOUBLE AS total_delay
FROM levels GROUP BY user_id""")
def user_error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    calm = F.count_if(F.col("level") == 0)
    return error_level(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), calm.alias("calm"), F.max("level").alias("worst"),
        (calm.cast("double") / F.count(F.lit(1))).alias("calm_rate"),
        F.sum(od.backoff(F.col("level"), 4.0, 30.0)).alias("total_delay"),
    )


@query("trailing_requests", f"""
WITH ranked AS (
  SELECT event_id, user_id, epoch_us(ts) AS at,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT a.event_id, a.user_id, count(*) AS in_window, count(*) - 1 >= 4 AS limited
FROM ranked a JOIN ranked b ON a.user_id = b.user_id AND b.rn <= a.rn AND b.at >= a.at - {DAY}
GROUP BY a.event_id, a.user_id""")
def trailing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = od.trailing_count(events(spark, sf_dir).select("event_id", "user_id", "at"),
                                ["user_id"], "at", "event_id", DAY)
    return counted.select("event_id", "user_id", "in_window", (F.col("in_window") - 1 >= 4).alias("limited"))


@query("best_run", """
WITH v AS (SELECT user_id, ts, event_id, CAST(value - 50 AS DECIMAL(18,2)) AS x FROM events),
s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM v),
l AS (SELECT *, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low FROM s)
SELECT user_id, CAST(max(s - least(0, low)) AS DOUBLE) AS best FROM l GROUP BY user_id""")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = (F.col("value") - 50).cast("decimal(18,2)")
    best = od.best_segment(events(spark, sf_dir).select("user_id", "at", "event_id", "value"),
                           ["user_id"], ["at", "event_id"], step)
    return best.withColumn("best", F.col("best").cast("double"))


RISE_SQL = """
WITH RECURSIVE seq AS (
  SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
fold(user_id, rn, ends) AS (
  SELECT user_id, 0::BIGINT, []::DOUBLE[] FROM (SELECT DISTINCT user_id FROM seq)
  UNION ALL
  SELECT f.user_id, s.rn, list_concat(list_filter(f.ends, lambda e: e < s.v), [s.v],
         f.ends[len(list_filter(f.ends, lambda e: e < s.v)) + 2 :])
  FROM fold f JOIN seq s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT user_id, max(len(ends))::BIGINT AS length FROM fold GROUP BY user_id"""


@query("rise_table_function", RISE_SQL)
def rise_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SQL: the table function names its own partitioning and order."""
    tables.register(spark)
    return spark.sql("SELECT * FROM longest_rise(TABLE(SELECT * FROM {rows}), 'user_id', 'at, event_id', 'value')", rows=events(spark, sf_dir))


@query("lis_by_user", RISE_SQL)
def lis_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.longest_increasing(events(spark, sf_dir), ["user_id"], ["at", "event_id"], "value")


@query("first_position", """
WITH seq AS (SELECT user_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
kinds AS (SELECT unnest(['signup', 'click', 'view', 'purchase', 'error']) AS event_type)
SELECT u.user_id, k.event_type, coalesce(min(s.pos), -1)::BIGINT AS pos
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN kinds k
LEFT JOIN seq s ON s.user_id = u.user_id AND s.event_type = k.event_type
GROUP BY u.user_id, k.event_type""")
def first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.first_position(events(spark, sf_dir), ["user_id"], ["at", "event_id"], "event_type", KINDS)


@query("user_event_bitmap", """
SELECT user_id, bit_or(CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 4
       WHEN 'purchase' THEN 8 WHEN 'error' THEN 16 END)::BIGINT AS bitmap,
       count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def user_event_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.kind_bitmap(load(spark, sf_dir, "events"), ["user_id"], "event_type", KINDS)


@query("superset_users", f"""
SELECT user_id, epoch_us(ts) // {WEEK} AS week FROM events
WHERE event_type IN ('signup', 'click', 'view', 'purchase', 'error')
GROUP BY ALL HAVING count(DISTINCT event_type) = 5""")
def superset_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = events(spark, sf_dir).withColumn("week", F.floor(F.col("at") / WEEK))
    return ag.covering_groups(weekly, ["user_id", "week"], "event_type", KINDS)


@query("kinds_kept", f"""
WITH w AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) // {WEEK} AS week FROM events)
SELECT DISTINCT a.user_id, a.week FROM w a
WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.user_id = a.user_id AND b.week = a.week AND NOT EXISTS (
  SELECT 1 FROM w c WHERE c.user_id = b.user_id AND c.week = b.week + 1 AND c.event_type = b.event_type))""")
def kinds_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of a user whose event kinds all occur again in that user's next week."""
    weekly = events(spark, sf_dir).select("user_id", F.floor(F.col("at") / WEEK).alias("week"), "event_type")
    following = weekly.withColumn("week", F.col("week") - 1).distinct()
    return ag.covering_pairs(following, weekly, ["user_id", "week"], "event_type")


@query("success_summary", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS total,
       count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed,
       count(*) FILTER (event_type <> 'error')::DOUBLE / count(*)::DOUBLE AS success_rate
FROM events GROUP BY 1""")
def success_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = load(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    return ag.success_summary(daily, ["day"], F.col("event_type") != "error")


@query("best_attempt", """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, event_type, event_type <> 'error' AS succeeded
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
  ORDER BY (event_type <> 'error') DESC, ts DESC, event_id DESC) = 1""")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = load(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    return ag.best_attempt(daily, ["user_id", "day"], F.col("event_type") != "error",
                           ["ts", "event_id"], ["event_id", "event_type"])


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only records that are no JSON are left out; a valid one without the field keeps its row."""
    readable = load(spark, sf_dir, "events").filter(F.try_parse_json("props").isNotNull())
    return readable.select("event_id", prop_k().alias("k"))


@query("safe_parse", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k,
       event_type = 'error' AS malformed FROM events""")
def safe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows carry their bare kind, which is no JSON, in place of their properties."""
    raw = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("props"))
    parsed = load(spark, sf_dir, "events").select("event_id", F.try_parse_json(raw).alias("v"))
    return parsed.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.lit(-1)).alias("k"),
                         F.col("v").isNull().alias("malformed"))


def _reciprocal(k: int | None) -> float | None:
    return None if k is None else 100.0 / (k - 50)


@query("captured_errors", """
SELECT event_id, CASE WHEN k <> 50 THEN 100.0::DOUBLE / (k - 50) END AS value,
       CASE WHEN k = 50 THEN 'ZeroDivisionError: division by zero' END AS error
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props))""")
def captured_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-row function that fails on some rows keeps its errors as data."""
    rows = json_props(spark, sf_dir)
    return ne.apply_capturing(rows, _reciprocal, ["k"], T.DoubleType()).select(
        "event_id", "value", F.regexp_replace("error", "float division", "division").alias("error"))


@query("variant_cases", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END::BIGINT AS arity,
       CAST(json_extract(props, '$.k') AS BIGINT) AS first_arg, event_type AS expected FROM events""")
def variant_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case lines ``[input, expected]`` with list and scalar inputs, written from the events and parsed back."""
    k = F.get_json_object("props", "$.k")
    given = F.when(F.col("event_type") == "error", F.concat(F.lit("["), k, F.lit(", "), F.col("event_id"), F.lit("]"))
                   ).otherwise(k)
    lines = load(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("["), given, F.lit(', "'), F.col("event_type"), F.lit('"]')).alias("value"))
    return parse_cases(lines).select(
        "event_id", F.size(F.variant_get("args", "$", "array<variant>")).cast("bigint").alias("arity"),
        F.variant_get("args", "$[0]", "bigint").alias("first_arg"),
        F.variant_get("expected", "$", "string").alias("expected"),
    )


# --- chains of events --------------------------------------------------------------------------------

def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, succ)``: each event points to the same user's next one."""
    rows = events(spark, sf_dir).select("user_id", "at", "event_id")
    return od.with_next(rows, ["user_id"], ["at", "event_id"], succ="event_id").select(
        F.col("event_id").alias("id"), "succ")


@query("reverse_chain", """
SELECT event_id AS id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS succ FROM events""")
def reverse_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = gr.reverse_chain(event_chain(spark, sf_dir))
    return back.select("id", F.coalesce("succ", F.lit(-1)).alias("succ"))


@query("chain_ranks", """
SELECT event_id AS id, last_value(event_id) OVER w AS tail, count(*) OVER w - row_number() OVER w AS rank
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def chain_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.chain_ranks(event_chain(spark, sf_dir))
