"""Queries: the whole audits, and the scalar helpers, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope import flows
from tablescope.functions import columns as K
from tablescope.functions.frames import constant_rows, latest_snapshot as newest
from tablescope.operators import findings as N
from tablescope.operators.profile import profile_columns
from tablescope.plans import catalog as T
from tablescope.plans import audit as U
from tablescope.plans import history as H
from tablescope.plans import scoring as G
from tablescope.plans.registry import Registry
from tablescope.plans.shape import WITH_PROFILE
from tablescope.plans.statements import statement_log
from tablescope.plans.tables import TABLES, read_table, read_tables

whole = Registry()


@whole.query("""
SELECT doc_id,
  CASE WHEN length(flat) > 40 THEN left(flat, 40) || '...' ELSE flat END AS squeezed,
  contains(lower(text), 'the ') AS mentions_the, strlen(text)::INTEGER AS bytes,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS bucket,
  CASE WHEN n_chars = 0 THEN 0.0 ELSE strlen(text)::DOUBLE / n_chars END AS bytes_per_char,
  CASE WHEN n_chars = 0 THEN 0.0 ELSE 100.0 * length(lang)::DOUBLE / n_chars END AS lang_pct,
  list_sum(list_transform(list_filter(string_split(text, ','), lambda p: trim(p) <> ''), lambda p: 1))::INTEGER AS parts,
  make_timestamp(2024, 1, (doc_id % 28 + 1)::BIGINT, (doc_id % 24)::BIGINT, (doc_id % 60)::BIGINT, 5) AS ran_at
FROM (SELECT *, trim(regexp_replace(text, '[\\s\\x{85}\\p{Z}\\x0B]+', ' ', 'g')) AS flat FROM documents)""")
def scalar_helpers(spark, sf):
    doc, text = F.col("doc_id"), F.col("text")
    day = (F.lit(20240101) + doc % 28).cast("int")
    time = ((doc % 24) * 10000 + (doc % 60) * 100 + 5).cast("int")
    return read_table(spark, sf, "documents").select(
        "doc_id", K.squeeze(text, 40).alias("squeezed"), K.contains_ci(text, "THE ").alias("mentions_the"),
        F.octet_length(text).alias("bytes"), K.hash_bucket(doc, 100).alias("bucket"),
        K.safe_div(F.octet_length(text), F.col("n_chars")).alias("bytes_per_char"),
        K.safe_pct(F.length("lang"), F.col("n_chars")).alias("lang_pct"),
        F.nullif(F.size(K.split_cols(text)), F.lit(0)).alias("parts"),
        K.int_datetime(day, time).cast("timestamp_ntz").alias("ran_at"),
    )


@whole.query("""
SELECT user_id, ts, event_type, value FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) = 1""")
def latest_snapshot(spark, sf):
    events = read_table(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    return newest(events, ["user_id"], "ts", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))


@whole.query(f"""WITH {H._OWNED_SQL}
SELECT 'Landmine' AS category, 'Job "' || job || '" is owned by what looks like a personal login: ' || owner AS title,
  'Which service account should own the job? If none, why?' AS question FROM owned""")
def open_questions(spark, sf):
    found = H.O.owner_findings(H._owner_audit(spark, sf))
    return N.open_questions(N.union_findings([found])).select("category", "title", "question")


def _health_inputs(spark, sf):
    suppliers = read_table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    day = F.date_trunc("day", F.col("ts"))
    waits = (
        read_table(spark, sf, "events")
        .groupBy(H._server(F.col("user_id")), F.col("event_type").alias("wait_type"), day.alias("collected_at"))
        .agg(
            F.sum(F.floor("value")).alias("wait_time_ms"), F.count(F.lit(1)).alias("waiting_tasks_count"),
            F.lit(0).cast("bigint").alias("signal_wait_time_ms"),
        )
    )
    return {
        "waits": waits,
        "jobs": H._jobs(spark, sf).withColumn("owner_sid", F.lit(None).cast("binary")),
        "job_runs": H._runs(spark, sf),
        "job_activity": H._activity(spark, sf),
        "replicas": H._replicas(spark, sf),
        "replica_databases": H._replica_databases(spark, sf),
        "temp_files": suppliers.select(
            H._text("n", F.col("s_nationkey")).alias("server"), F.col("s_name").alias("name"), F.lit("ROWS").alias("type_desc"),
            (F.col("s_acctbal") < 0).alias("is_percent_growth"), F.lit(1).alias("cpu_count"),
        ),
        "principals": suppliers.select(
            H._server(key), key.alias("principal_id"), key.cast("string").cast("binary").alias("sid"), F.col("s_name").alias("name"),
            F.lit("S").alias("type"), F.lit("SQL_LOGIN").alias("type_desc"), (F.col("s_acctbal") < 0).alias("is_disabled"),
            F.lit(H.AS_OF).cast("timestamp").alias("create_date"),
        ),
    }


@whole.query(f"""
WITH latest AS (
  SELECT * FROM (
    SELECT 'srv' || (user_id % 4) AS server, event_type AS wait_type, date_trunc('day', ts) AS day, sum(floor(value))::BIGINT AS ms
    FROM events GROUP BY ALL) WHERE day <= {H._ts} QUALIFY day = max(day) OVER (PARTITION BY server)),
lag AS (
  SELECT user_id, count(*) FILTER (event_type = 'error') > 18 AS suspended, count(*) FILTER (event_type = 'view') > 16 AS stopped,
    floor((epoch_us({H._ts}) - epoch_us(max(ts))) / 1000000)::BIGINT AS lag_seconds, sum(floor(value))::BIGINT * 1000 AS redo
  FROM events GROUP BY 1),
found AS (
  SELECT 'Performance' AS category, 'Info' AS severity FROM latest
  UNION ALL SELECT 'Maintenance', 'Medium' FROM (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d %H:%M'), props FROM events JOIN customer ON c_custkey = user_id
    WHERE event_type = 'error' AND event_id % 2 = 0 AND ts >= {H._ts} - INTERVAL 7 DAY AND ts <= {H._ts})
  UNION ALL SELECT 'Configuration', 'Low' FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING bool_or(s_acctbal < 0))
  UNION ALL SELECT 'Security', 'Info' FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT 'Availability', CASE WHEN s_acctbal < -500 OR s_nationkey < 5 THEN 'High' ELSE 'Medium' END
    FROM supplier WHERE s_acctbal < -500 OR s_nationkey < 8
  UNION ALL SELECT 'Availability', 'Critical' FROM lag WHERE suspended
  UNION ALL SELECT 'Availability', 'High' FROM lag WHERE stopped AND NOT suspended
  UNION ALL SELECT 'Availability', 'Medium' FROM lag WHERE lag_seconds > 300
  UNION ALL SELECT 'Availability', 'Medium' FROM lag WHERE redo > 1048576
  UNION ALL SELECT 'Availability', 'Info' FROM (SELECT DISTINCT 'srv' || (s_suppkey // 10) AS server FROM supplier)
    WHERE server NOT IN (SELECT 'srv' || (s_suppkey // 10) FROM supplier WHERE s_acctbal < -500 OR s_nationkey < 8)
      AND server NOT IN (SELECT 'srv' || (user_id // 10) FROM lag WHERE suspended OR stopped OR lag_seconds > 300 OR redo > 1048576)
  UNION ALL SELECT o_orderpriority, severity FROM (SELECT DISTINCT o_orderpriority, o_orderstatus, o_custkey % 20,
      CASE WHEN o_totalprice < 51000 THEN 'Critical' WHEN o_totalprice < 101000 THEN 'High' WHEN o_totalprice < 151000 THEN 'Medium'
        WHEN o_totalprice < 201000 THEN 'Low' ELSE 'Info' END AS severity FROM orders))
SELECT category, severity, count(*) AS findings FROM found GROUP BY ALL""")
def health_check(spark, sf):
    """All checks over the fleet, counted by category and severity after de-duplication."""
    foreign = read_table(spark, sf, "orders").select(
        F.lit("srv").alias("server"), F.floor(F.col("o_totalprice") / 1000).alias("Priority"),
        F.col("o_orderpriority").alias("Category"), F.concat(F.lit("Order "), "o_orderstatus").alias("Finding"),
        F.concat(F.lit("customer "), (F.col("o_custkey") % 20).cast("string")).alias("Details"),
    )
    report = flows.health_check(_health_inputs(spark, sf), H.AS_OF, foreign=[("orders", [foreign])])
    return report["findings"].groupBy("category", "severity").agg(F.count(F.lit(1)).alias("findings"))


@whole.query(f"""
WITH found AS ({T.DISCOVER_SQL}), used AS (
  SELECT user_id, count(*) FILTER (event_type = 'view') AS seeks, count(*) FILTER (event_type = 'click') AS scans,
    count(*) FILTER (event_type = 'signup') AS lookups, count(*) FILTER (event_type = 'purchase') AS updates,
    count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1), operations AS ({T.OPERATIONS_SQL})
SELECT schema_name || '.' || table_name AS "table", found.object_id, row_count, total_size_mb, coalesce(seeks, 0) AS user_seeks,
  coalesce(scans, 0) AS user_scans, coalesce(lookups, 0) AS user_lookups, coalesce(updates, 0) AS user_updates,
  coalesce(errors, 0) AS missing_index_suggestions,
  EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = found.object_id AND l_partkey % 1000 IN (5, 6)) AS has_columnstore,
  row_lock_wait_ms, page_io_latch_wait_ms, leaf_inserts, leaf_updates, leaf_deletes
FROM found LEFT JOIN used ON user_id = found.object_id LEFT JOIN operations o ON o.object_id = found.object_id""")
def table_facts(spark, sf):
    """Candidate tables with all their counters, in one row each."""
    facts = flows.table_facts(T.fact_inputs(spark, sf), min_rows=2400, min_mb=240_000, top_n=10)
    return facts.select(
        "table", "object_id", "row_count", F.col("total_size_mb").cast("double").alias("total_size_mb"), *T.D.USAGE,
        "missing_index_suggestions", "has_columnstore", "row_lock_wait_ms", "page_io_latch_wait_ms", "leaf_inserts",
        "leaf_updates", "leaf_deletes",
    )


@whole.query(f"""{WITH_PROFILE}, {G.JUDGED_SQL}
SELECT "table", candidacy_score, has_aggregation, CASE WHEN has_columnstore THEN NULL WHEN candidacy_score >= 35 THEN 'convert'
  WHEN candidacy_score >= 20 AND append AND potential_rowgroups >= 3 THEN 'later' ELSE 'leave' END AS recommendation
FROM (SELECT * EXCLUDE (has_aggregation), contains(lower("table"), 'nation') AS has_aggregation FROM judged)""")
def table_report(spark, sf):
    """Score and recommendation of every table, with statements that mention the table's name."""
    tables = read_tables(spark, sf, TABLES)
    i = F.col("i")
    numbered = constant_rows(spark, list(enumerate(TABLES)), "i INT, table STRING")
    sizes = G.table_sizes(profile_columns(tables))
    facts = (
        numbered.join(sizes, "table").join(G._usage(spark, sf), "i", "left").fillna(0, G.COUNTERS)
        .select(
            "*", F.col("table").alias("table_name"), H._text("srv", i % 5).alias("server"), i.alias("object_id"), (F.col("base_data_mb") * (i % 4) / 2).alias("nonclustered_mb"),
            (i % 5 == 4).alias("has_columnstore"), (i % 3 == 0).alias("is_replicated"), (i % 4 == 1).alias("is_cdc_tracked"),
        )
    )
    log = statement_log(spark, sf).drop("o_orderkey")
    report = flows.table_report(tables, facts, log)
    return report["candidates"].select("table", "candidacy_score", "has_aggregation", "recommendation")


# Driver table i stands for table t{i // 2} of server srv{i % 2}: each name is on two servers, with different data.
_FLEET_SQL = f"""{WITH_PROFILE}, {G.SCORED_SQL}, fleet AS (
SELECT 'srv' || i % 2 AS server, 't' || i // 2 AS "table", "table" AS source_table, * EXCLUDE ("table") FROM scored
), said AS (
SELECT 'srv' || o_orderkey % 2 AS server, 'PlanCache' AS source, o_orderkey % 100 + 1 AS execution_count,
  floor(o_totalprice)::BIGINT AS reads, 'SELECT sum(x) FROM t' || c_nationkey % 7 || ' GROUP BY y' AS statement_text
FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'srv1', 'QueryStore', sum(l_quantity::BIGINT)::BIGINT, sum(floor(l_extendedprice)::BIGINT * l_quantity::BIGINT)::BIGINT,
  'SELECT * FROM t' || n_nationkey % 7 || ' WHERE n = ' || n_nationkey
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey WHERE l_orderkey % 2 = 1 GROUP BY n_nationkey
), evidence AS (
SELECT server, "table", source, execution_count, reads, statement_text,
  row_number() OVER (PARTITION BY server, "table", source ORDER BY reads DESC, statement_text, execution_count DESC) AS rk
FROM said JOIN (SELECT server, "table" FROM fleet) USING (server)
WHERE contains(statement_text, "table"))"""


def _fleet(spark, sf):
    """Tables by (server, name), their facts, and what their statement log is made from."""
    i = F.col("i")
    numbered = constant_rows(spark, list(enumerate(TABLES)), "i INT, source_table STRING")
    tables = {(f"srv{n % 2}", f"t{n // 2}"): df for n, df in enumerate(read_tables(spark, sf, TABLES).values())}
    sizes = G.table_sizes(profile_columns(read_tables(spark, sf, TABLES))).withColumnRenamed("table", "source_table")
    table = H._text("t", F.floor(i / 2))
    facts = (
        numbered.join(sizes, "source_table").join(G._usage(spark, sf), "i", "left").fillna(0, G.COUNTERS)
        .select(
            "*", table.alias("table"), table.alias("table_name"), H._text("srv", i % 2).alias("server"), i.alias("object_id"),
            (F.col("base_data_mb") * (i % 4) / 2).alias("nonclustered_mb"), (i % 5 == 4).alias("has_columnstore"),
            (i % 3 == 0).alias("is_replicated"), (i % 4 == 1).alias("is_cdc_tracked"),
        )
    )
    server = lambda key: H._text("srv", F.col(key) % 2).alias("server")
    both = F.explode(F.array(F.lit("srv0"), F.lit("srv1"))).alias("server")
    read = lambda name: read_table(spark, sf, name)
    reads = F.floor("o_totalprice")
    log = {
        "statement_stats": read("orders").select(
            server("o_orderkey"), F.col("o_custkey").alias("handle"), (F.col("o_orderkey") % 100 + 1).alias("execution_count"),
            reads.alias("total_logical_reads"), reads.alias("total_worker_us"), reads.alias("total_elapsed_us"),
            F.col("o_orderdate").alias("last_execution_time"), F.lit(0).alias("start_offset"), F.lit(-1).alias("end_offset"),
        ),
        "batch_texts": read("customer").select(
            both, F.col("c_custkey").alias("handle"),
            F.concat(F.lit("SELECT sum(x) FROM t"), (F.col("c_nationkey") % 7).cast("string"), F.lit(" GROUP BY y")).alias("text"),
        ),
        "runtime_stats": read("lineitem").select(
            server("l_orderkey"), F.col("l_orderkey").alias("plan_id"), F.col("l_suppkey").alias("interval_id"),
            F.col("l_quantity").cast("bigint").alias("count_executions"),
            F.floor("l_extendedprice").cast("double").alias("avg_logical_io_reads"), F.lit(1.0).alias("avg_cpu_time"), F.lit(1.0).alias("avg_duration"),
        ),
        "runtime_intervals": read("supplier").select(
            both, F.col("s_suppkey").alias("interval_id"), F.lit(H.AS_OF).cast("timestamp_ntz").alias("end_time")
        ),
        "query_plans": read("orders").select(server("o_orderkey"), F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("query_id")),
        "query_ids": read("customer").select(both, F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("text_id")),
        "query_texts": read("nation").select(
            both, F.col("n_nationkey").alias("text_id"),
            F.concat(F.lit("SELECT * FROM t"), (F.col("n_nationkey") % 7).cast("string"), F.lit(" WHERE n = "), F.col("n_nationkey").cast("string")).alias("query_text"),
        ),
        # server 0 has stopped capturing, server 1 is read only for another reason
        "log_status": read("region").filter("r_regionkey < 2").select(
            H._text("srv", F.col("r_regionkey")).alias("server"), F.lit("READ_ONLY").alias("actual_state"),
            F.when(F.col("r_regionkey") == 0, 65536).otherwise(1).alias("readonly_reason"),
            (F.col("r_regionkey") + 900).cast("bigint").alias("current_mb"), F.lit(1000).cast("bigint").alias("max_mb"),
        ),
    }
    return tables, facts, log


def _fleet_report(spark, sf):
    tables, facts, log = _fleet(spark, sf)
    return flows.table_report(flows.without_columnar(tables, facts), facts, log_inputs=log)


@whole.query(f"""{_FLEET_SQL}, seen AS (SELECT DISTINCT server, "table" FROM evidence WHERE contains(statement_text, 'sum('))
SELECT server, "table", candidacy_score, CASE WHEN has_columnstore THEN 0 ELSE sampled_rows END AS sampled_rows,
  CASE WHEN has_columnstore THEN 0.0::DOUBLE ELSE pct_low END AS pct_low, CASE WHEN has_columnstore THEN 0.0::DOUBLE ELSE pct_medium END AS pct_medium,
  row_count, {G.NOTES_SQL}, EXISTS (SELECT 1 FROM seen WHERE seen.server = fleet.server AND seen."table" = fleet."table") AS has_aggregation,
  CASE WHEN has_columnstore THEN NULL WHEN candidacy_score >= 35 THEN 'convert'
    WHEN candidacy_score >= 20 AND leaf_inserts > 0 AND leaf_updates = 0 AND leaf_deletes = 0 AND potential_rowgroups >= 3 THEN 'later' ELSE 'leave' END AS recommendation,
  reads + user_updates > 0 AS is_used
FROM fleet""")
def fleet_candidates(spark, sf):
    """Tables of one name on two servers are judged apart; columnar ones are not profiled."""
    return _fleet_report(spark, sf)["candidates"].select(
        "server", "table", "candidacy_score", "sampled_rows", "pct_low", "pct_medium", "row_count", "notes", "has_aggregation",
        "recommendation", "is_used",
    )


@whole.query(f"""{_FLEET_SQL}
SELECT server, "table", source, statement_text, execution_count, reads AS total_logical_reads FROM evidence WHERE rk <= 20""")
def fleet_statements(spark, sf):
    """Statements matched from the sources of the log, without those of a source that stopped capturing."""
    return _fleet_report(spark, sf)["statements"].select(
        "server", "table", "source", "statement_text", "execution_count", "total_logical_reads"
    )


@whole.query("""
SELECT 'srv' || r_regionkey AS server, 'Workload evidence' AS category, 'Low' AS severity, 'QueryStore' AS object,
  'Query Store is stuck READ_ONLY (using ' || (r_regionkey + 900) || ' of 1,000 MB): statements captured since are missing' AS details
FROM region WHERE r_regionkey = 0""")
def fleet_log_findings(spark, sf):
    return _fleet_report(spark, sf)["log_findings"].select("server", "category", "severity", "object", "details")


@whole.query(f"""{_FLEET_SQL}, best AS (
SELECT "table" AS source_table, "column", ordinal, duplication_factor, distinct_values,
  row_number() OVER (PARTITION BY "table" ORDER BY duplication_factor DESC, ordinal) AS rk FROM profile WHERE analyzed)
SELECT server, fleet."table", rk AS rank, "column", duplication_factor, distinct_values
FROM best JOIN fleet USING (source_table) WHERE rk <= 8 AND NOT has_columnstore""")
def fleet_top_columns(spark, sf):
    return _fleet_report(spark, sf)["top_columns"].select("server", "table", "rank", "column", "duplication_factor", "distinct_values")


@whole.query(f"""{_FLEET_SQL}
SELECT count(*) FILTER (NOT has_columnstore AND candidacy_score >= 55) AS strong,
  count(*) FILTER (NOT has_columnstore AND candidacy_score >= 35 AND candidacy_score < 55) AS worth_testing,
  count(*) FILTER (has_columnstore) AS already_columnar FROM fleet""")
def fleet_portfolio(spark, sf):
    return _fleet_report(spark, sf)["portfolio"]


@whole.query(f"""WITH {U._GRANTS_SQL}, kept AS ({U._GROUPED_SQL.format(cap=10, where=U._RISKY)})
SELECT CASE WHEN lower(grantee) = 'public' THEN 'High' ELSE 'Medium' END AS severity, 'Landmine' AS category,
  count(*) AS findings FROM kept GROUP BY 1
UNION ALL SELECT 'Info', 'Security', count(*) FROM supplier WHERE s_suppkey % 7 = 1 HAVING count(*) > 0
UNION ALL SELECT 'High', 'Landmine_login', count(*) FROM supplier WHERE s_acctbal < 0 AND s_suppkey > 4 HAVING count(*) > 0
UNION ALL SELECT 'Low', 'Security', 3 * count(*) FROM customer WHERE c_custkey > 4
  AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) HAVING count(*) > 0""")
def access_audit(spark, sf):
    """All access findings, counted; findings about logins are told apart from grants."""
    perms, _, objects, schemas, columns = U._grant_inputs(spark, sf)
    suppliers, customers = read_table(spark, sf, "supplier"), read_table(spark, sf, "customer")
    key = F.col("s_suppkey")
    server = F.lit("srv").alias("server")
    sid = lambda k: k.cast("string").cast("binary").alias("sid")
    databases = F.explode(F.array(*[F.lit(f"db{d}") for d in range(3)])).alias("database")
    logins = suppliers.select(
        server, key.alias("principal_id"), sid(key), F.col("s_name").alias("name"), F.lit("S").alias("type"),
        F.lit("SQL_LOGIN").alias("type_desc"), (F.col("s_acctbal") < 0).alias("is_disabled"),
    )
    role = constant_rows(spark, [("srv", -1, None, "sysadmin", "R", "SERVER_ROLE", False)],
                         "server STRING, principal_id BIGINT, sid BINARY, name STRING, type STRING, type_desc STRING, is_disabled BOOLEAN")
    members = suppliers.filter(key % 7 == 1).select(server, key.alias("member_principal_id"), (-(key % 7)).alias("role_principal_id"))
    grantees = suppliers.select(
        server, databases, key.alias("principal_id"),
        F.when(F.col("s_nationkey") < 3, "Public").otherwise(F.col("s_name")).alias("name"),
        F.lit("R").alias("type"),
        F.when(F.col("s_nationkey") < 3, "DATABASE_ROLE").otherwise("SQL_USER").alias("type_desc"),
        F.lit(None).cast("binary").alias("sid"), F.lit("NONE").alias("auth_type"),
    )
    users = customers.select(
        server, databases, F.col("c_custkey").alias("principal_id"), F.col("c_name").alias("name"), F.lit("S").alias("type"),
        F.lit("SQL_USER").alias("type_desc"), sid(F.col("c_custkey")), F.lit("INSTANCE").alias("auth_type"),
    )
    # Grantees and users have overlapping ids: users are moved out of the way.
    moved = users.withColumn("principal_id", F.when(F.col("principal_id") > 4, F.col("principal_id") + 1_000_000_000).otherwise(-F.col("principal_id") - 1))
    report = flows.access_audit(
        {
            "principals": logins.unionByName(role), "server_role_members": members,
            "db_principals": grantees.unionByName(moved), "db_role_members": members.select(
                "server", F.lit("db0").alias("database"), "member_principal_id", "role_principal_id"
            ),
            "db_permissions": perms, "objects": objects, "db_schemas": schemas, "columns": columns,
        }
    )
    about_login = F.when(F.col("title").startswith("Disabled login"), "Landmine_login").otherwise(F.col("category"))
    return report["findings"].groupBy("severity", about_login.alias("category")).agg(F.count(F.lit(1)).alias("findings"))
