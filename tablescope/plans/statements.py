"""Queries: workload evidence from a statement log derived from orders.

Each order is a logged statement that mentions its customer's nation. Nation
names contain each other (NATION_1 in NATION_15), and '_' must stay literal.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import workload as L
from tablescope.plans.registry import Registry
from tablescope.plans.tables import read_table

statements = Registry()


def _region_server(region):
    return F.concat(F.lit("srv"), region.cast("string"))


def statement_log(spark, sf):
    nation = read_table(spark, sf, "nation")
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = read_table(spark, sf, "orders")
    name, kind = F.col("n_name"), F.left("o_orderpriority", F.lit(1))
    text = (
        F.when(kind == "1", F.concat(F.lit("INSERT INTO "), name, F.lit(" VALUES (1)")))
        .when(kind == "2", F.concat(F.lit("SELECT SUM(x) FROM "), name, F.lit(" GROUP BY y")))
        .when(kind == "3", F.concat(F.lit("SELECT * FROM "), name, F.lit(" WHERE k="), F.col("o_orderkey").cast("string")))
        .when(kind == "4", F.concat(F.lit("select count(*) from "), F.lower(name)))
        .otherwise(F.concat(F.lit("SELECT COUNT_BIG(*) AS __rows FROM "), name))
    )
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        _region_server(F.col("n_regionkey")).alias("server"),
        F.col("o_orderstatus").alias("source"),
        (F.col("o_orderkey") % 100 + 1).alias("execution_count"),
        F.floor("o_totalprice").alias("total_logical_reads"),
        (F.col("o_totalprice") / 1000.0).alias("total_cpu_ms"),
        (F.col("o_totalprice") / 500.0).alias("total_elapsed_ms"),
        F.col("o_orderdate").alias("last_execution_time"),
        text.alias("statement_text"),
        "o_orderkey",
    )


def table_names(spark, sf):
    return read_table(spark, sf, "nation").select(
        _region_server(F.col("n_regionkey")).alias("server"),
        F.col("n_nationkey").alias("table"),
        F.col("n_name").alias("name"),
    )


def matches(spark, sf):
    return L.match_statements(statement_log(spark, sf).drop("o_orderkey"), table_names(spark, sf))


LOG_SQL = """log AS (
SELECT 'srv' || n_regionkey AS server, o_orderstatus AS source, o_orderkey % 100 + 1 AS execution_count,
  floor(o_totalprice)::BIGINT AS total_logical_reads, o_totalprice / 1000.0 AS total_cpu_ms,
  o_totalprice / 500.0 AS total_elapsed_ms, o_orderdate AS last_execution_time, o_orderkey,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'INSERT INTO ' || n_name || ' VALUES (1)'
    WHEN '2' THEN 'SELECT SUM(x) FROM ' || n_name || ' GROUP BY y'
    WHEN '3' THEN 'SELECT * FROM ' || n_name || ' WHERE k=' || o_orderkey
    WHEN '4' THEN 'select count(*) from ' || lower(n_name)
    ELSE 'SELECT COUNT_BIG(*) AS __rows FROM ' || n_name END AS statement_text
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def matches_sql(top: int) -> str:
    return f"""{LOG_SQL}, matched AS (SELECT * EXCLUDE (rk) FROM (
SELECT log.* EXCLUDE (o_orderkey), n_nationkey AS "table", row_number() OVER (PARTITION BY server, n_nationkey, source
  ORDER BY total_logical_reads DESC, statement_text, execution_count DESC, last_execution_time DESC) AS rk
FROM log JOIN nation ON server = 'srv' || n_regionkey AND contains(lower(statement_text), lower(n_name))
WHERE NOT contains(lower(statement_text), 'as __rows')) WHERE rk <= {top})"""


@statements.query(f"WITH {matches_sql(20)} SELECT * FROM matched")
def match_statements(spark, sf):
    return matches(spark, sf)


@statements.query(f"WITH {matches_sql(20)} SELECT * FROM matched")
def match_statements_many_names(spark, sf):
    """Every customer's name is looked for too; no statement holds one."""
    nation = read_table(spark, sf, "nation")
    customers = read_table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    table = (-F.col("c_custkey")).cast(nation.schema["n_nationkey"].dataType)
    more = customers.select(_region_server(F.col("n_regionkey")).alias("server"), table.alias("table"), F.col("c_name").alias("name"))
    names = table_names(spark, sf).unionByName(more)
    return L.match_statements(statement_log(spark, sf).drop("o_orderkey"), names)


CLASSES_SQL = """starts_with(lower(ltrim(statement_text)), 'insert') AS is_insert,
  contains(lower(statement_text), 'select') AND NOT starts_with(lower(ltrim(statement_text)), 'insert')
    AND (contains(lower(statement_text), 'group by') OR contains(lower(statement_text), 'sum(')
      OR contains(lower(statement_text), 'avg(') OR contains(lower(statement_text), 'count(')) AS is_aggregation,
  contains(lower(statement_text), 'as __rows') OR contains(lower(statement_text), 'count_big(distinct') AS is_own,
  contains(lower(statement_text), 'openjson') AS shreds_json"""


@statements.query(f"WITH {LOG_SQL} SELECT o_orderkey, {CLASSES_SQL} FROM log")
def classify_statements(spark, sf):
    flags = ["is_insert", "is_aggregation", "is_own", "shreds_json"]
    return L.classify(statement_log(spark, sf)).select("o_orderkey", *flags)


@statements.query(f"""
WITH {matches_sql(20)}, ranked AS (
  SELECT *, {CLASSES_SQL} FROM matched
), best AS (
  SELECT server, "table", bool_and(is_insert) AS only_inserts, bool_or(is_aggregation) AS has_aggregation,
    arg_max(m, m) FILTER (is_aggregation) AS agg, arg_max(m, m) AS any_
  FROM (SELECT *, row(total_logical_reads, statement_text, execution_count, total_cpu_ms, source, shreds_json) AS m
    FROM ranked WHERE NOT is_own) GROUP BY ALL
), shown AS (
  SELECT *, CASE WHEN agg[1] > 494000 THEN 'aggregation' WHEN any_[1] > 496000 THEN 'heaviest'
    WHEN only_inserts THEN 'insert_only' ELSE 'none' END AS kind FROM best)
SELECT server, "table", kind, has_aggregation, s[1] AS reads, s[2] AS statement_text, s[3] AS execution_count,
  s[4] AS total_cpu_ms, s[5] AS source, s[6] AS shreds_json, s[1] / s[3]::DOUBLE AS reads_per_execution
FROM (SELECT *, CASE kind WHEN 'aggregation' THEN agg WHEN 'heaviest' THEN any_ END AS s FROM shown)""")
def heaviest_statement(spark, sf):
    return L.heaviest_statement(matches(spark, sf), min_aggregation_reads=494_000, min_reads=496_000)


@statements.query("""
SELECT 'srv' || (c_custkey % 4) AS server, 'PlanCache' AS source, o_orderkey % 100 + 1 AS execution_count,
  floor(o_totalprice)::BIGINT AS total_logical_reads, floor(o_totalprice) / 1000.0 AS total_cpu_ms,
  floor(o_totalprice) * 2 / 1000.0 AS total_elapsed_ms, o_orderdate AS last_execution_time,
  substring(body, first_ // 2 + 1, ((CASE WHEN last_ = -1 THEN length(body) * 2 ELSE last_ END) - first_) // 2 + 1)
    AS statement_text
FROM (SELECT *, (o_orderkey % 20)::INT * 2 AS first_,
    CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE (o_orderkey % 20)::INT * 2 + 60 END AS last_ FROM orders)
JOIN (SELECT *, 'BEGIN; SELECT * FROM ' || c_name || ' WHERE s = ''' || c_mktsegment || '''; END' AS body FROM customer)
  ON c_custkey = o_custkey""")
def statement_slice(spark, sf):
    server = lambda key: F.concat(F.lit("srv"), (F.col(key) % 4).cast("string")).alias("server")
    reads, first = F.floor("o_totalprice"), (F.col("o_orderkey") % 20).cast("int") * 2
    stats = read_table(spark, sf, "orders").select(
        server("o_custkey"),
        F.col("o_custkey").alias("handle"),
        (F.col("o_orderkey") % 100 + 1).alias("execution_count"),
        reads.alias("total_logical_reads"), reads.alias("total_worker_us"), (reads * 2).alias("total_elapsed_us"),
        F.col("o_orderdate").alias("last_execution_time"),
        first.alias("start_offset"),
        F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(first + 60).alias("end_offset"),
    )
    texts = read_table(spark, sf, "customer").select(
        server("c_custkey"),
        F.col("c_custkey").alias("handle"),
        F.concat(F.lit("BEGIN; SELECT * FROM "), "c_name", F.lit(" WHERE s = '"), "c_mktsegment", F.lit("'; END")).alias("text"),
    )
    return L.cached_statements(stats, texts)


def _log_status(spark, sf):
    state = F.col("c_nationkey") % 3
    return read_table(spark, sf, "customer").select(
        F.concat(F.lit("srv"), F.col("c_custkey").cast("string")).alias("server"),
        F.col("c_mktsegment").alias("source"),
        F.when(state == 0, "OFF").when(state == 1, "READ_ONLY").otherwise("READ_WRITE").alias("actual_state"),
        ((F.col("c_custkey") % 20) * 65536).cast("int").alias("readonly_reason"),
        F.floor("c_acctbal").alias("current_mb"),
        (F.col("c_custkey") * 1000).alias("max_mb"),
    )


_GATE_SQL = """gated AS (
SELECT 'srv' || c_custkey AS server, c_custkey, c_mktsegment AS source, state, stale, state <> 0 AND NOT stale AS usable,
  CASE WHEN stale THEN 'Query Store is stuck READ_ONLY (using ' || format('{:,}', floor(c_acctbal)::BIGINT) || ' of '
    || format('{:,}', c_custkey * 1000) || ' MB): statements captured since are missing' END AS caveat
FROM (SELECT *, c_nationkey % 3 AS state,
  c_nationkey % 3 = 1 AND (((c_custkey % 20) * 65536) & 720896) <> 0 AS stale FROM customer))"""


@statements.query(f"WITH {_GATE_SQL} SELECT server, source, usable, caveat FROM gated")
def source_gate(spark, sf):
    return L.source_gate(_log_status(spark, sf)).select("server", "source", "usable", "caveat")


@statements.query(f"""
WITH {_GATE_SQL}
SELECT source, count(*) AS statements, sum(o_orderkey)::BIGINT AS checksum
FROM (SELECT 'srv' || o_custkey AS server, CASE WHEN o_orderkey % 4 = 0 THEN 'PlanCache' ELSE c_mktsegment END AS source,
    o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey) AS log
WHERE NOT EXISTS (SELECT 1 FROM gated g WHERE g.server = log.server AND g.source = log.source AND NOT usable)
GROUP BY source""")
def trusted_statements(spark, sf):
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    log = read_table(spark, sf, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("srv"), F.col("o_custkey").cast("string")).alias("server"),
        F.when(F.col("o_orderkey") % 4 == 0, "PlanCache").otherwise(F.col("c_mktsegment")).alias("source"),
        "o_orderkey",
    )
    kept = L.trusted_statements(log, L.source_gate(_log_status(spark, sf)))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("statements"), F.sum("o_orderkey").alias("checksum"))


@statements.query("""
SELECT 'srv' AS server, 'QueryStore' AS source, statement_text, execution_count::BIGINT AS execution_count,
  reads::BIGINT AS total_logical_reads, cpu / 1000.0 AS total_cpu_ms, duration / 1000.0 AS total_elapsed_ms,
  last_execution_time
FROM (SELECT n_name AS statement_text, sum(l_quantity) AS execution_count, sum(floor(l_extendedprice) * l_quantity) AS reads,
    sum(l_linenumber * l_quantity) AS cpu, sum(l_partkey * l_quantity) AS duration,
    max(TIMESTAMP '2024-01-01 00:00:00' + to_hours(s_suppkey)) AS last_execution_time
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  GROUP BY n_name ORDER BY cpu DESC, n_name LIMIT 10)""")
def query_interval_totals(spark, sf):
    server = F.lit("srv").alias("server")
    pick = lambda name, *columns: read_table(spark, sf, name).select(server, *columns)
    col = F.col
    runtime = pick(
        "lineitem", col("l_orderkey").alias("plan_id"), col("l_suppkey").alias("interval_id"),
        col("l_quantity").cast("bigint").alias("count_executions"),
        F.floor("l_extendedprice").cast("double").alias("avg_logical_io_reads"),
        col("l_linenumber").cast("double").alias("avg_cpu_time"), col("l_partkey").cast("double").alias("avg_duration"),
    )
    end = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(s_suppkey AS INT))")
    intervals = pick("supplier", col("s_suppkey").alias("interval_id"), end.alias("end_time"))
    plans = pick("orders", col("o_orderkey").alias("plan_id"), col("o_custkey").alias("query_id"))
    ids = pick("customer", col("c_custkey").alias("query_id"), col("c_nationkey").alias("text_id"))
    texts = pick("nation", col("n_nationkey").alias("text_id"), col("n_name").alias("query_text"))
    return L.interval_totals(runtime, intervals, plans, ids, texts, top_n=10)


def _recent_usage(spark, sf):
    """Customers in blocks of a hundred per server; only the first blocks have events."""
    block = lambda key: F.concat(F.lit("srv"), F.floor(F.col(key) / 100).cast("string")).alias("server")
    events = read_table(spark, sf, "events")
    is_ = lambda name, alias: F.count_if(F.col("event_type") == name).alias(alias)
    usage = events.groupBy("user_id").agg(
        is_("view", "user_seeks"), is_("click", "user_scans"), is_("signup", "user_lookups"), is_("purchase", "user_updates")
    )
    return (
        read_table(spark, sf, "customer")
        .select(block("c_custkey"), F.col("c_custkey").alias("user_id"))
        .join(usage, "user_id", "left")
        .fillna(0, ["user_seeks", "user_scans", "user_lookups", "user_updates"])
    )


@statements.query(f"""WITH {matches_sql(20)}
SELECT server, all_unused, coalesce(n, 0) AS matched_statements, all_unused AND coalesce(n, 0) > 0 AS counters_reset
FROM (SELECT 'srv' || (c_custkey // 100) AS server,
    bool_and(NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type <> 'error')) AS all_unused
  FROM customer GROUP BY 1) AS t
LEFT JOIN (SELECT server, count(*) AS n FROM matched GROUP BY 1) AS m USING (server)""")
def counters_reset_flag(spark, sf):
    return L.counters_reset(_recent_usage(spark, sf), matches(spark, sf))
