"""Queries: findings from operational history. Customers and orders are the inventories, events the history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import oplog as O
from tablescope.operators.findings import by_urgency, union_findings
from tablescope.plans.registry import Registry
from tablescope.plans.tables import read_table

history = Registry()

AS_OF = "2024-01-31 00:00:00"
_ts = f"TIMESTAMP '{AS_OF}'"


def _server(key, n=4):
    return F.concat(F.lit("srv"), F.pmod(key, F.lit(n)).cast("string")).alias("server")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _events(spark, sf):
    return read_table(spark, sf, "events")


# ---- waits ------------------------------------------------------------------


def _waits(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    return (
        _events(spark, sf)
        .groupBy(day.alias("server"), F.col("event_type").alias("wait_type"))
        .agg(
            F.sum(F.floor(F.col("value") * 10)).alias("wait_time_ms"),
            F.count_if(F.col("value") > 5).alias("waiting_tasks_count"),
            F.count(F.lit(1)).alias("signal_wait_time_ms"),
        )
    )


_WAITS_SQL = """waits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server
    ORDER BY wait_time_ms DESC, wait_type) AS rk
  FROM (SELECT strftime(ts, '%Y-%m-%d') AS server, event_type AS wait_type, sum(floor(value * 10))::BIGINT AS wait_time_ms,
      count(*) FILTER (value > 5) AS waiting_tasks_count, count(*) AS signal_wait_time_ms
    FROM events GROUP BY ALL) WHERE waiting_tasks_count > 0 AND wait_type NOT IN ('signup', 'view')) WHERE rk <= 2)"""


@history.query(f"WITH {_WAITS_SQL} SELECT * EXCLUDE (rk) FROM waits")
def top_waits(spark, sf):
    return O.top_waits(_waits(spark, sf), top=2, excluded=["signup", "view"])


@history.query(f"""WITH {_WAITS_SQL}
SELECT server, 'Performance' AS category, 'Info' AS severity, 0 AS severity_rank, 'Top wait: ' || wait_type AS title,
  format('{{:,}}', wait_time_ms) || ' ms cumulative wait, ' || waiting_tasks_count || ' waiting tasks, '
  || signal_wait_time_ms || ' ms signal wait' AS details FROM waits""")
def wait_findings(spark, sf):
    found = O.wait_findings(O.top_waits(_waits(spark, sf), top=2, excluded=["signup", "view"]))
    return found.select("server", "category", "severity", "severity_rank", "title", "details")


# ---- recency ----------------------------------------------------------------


def _recency(spark, sf):
    databases = read_table(spark, sf, "customer").select(
        _server(F.col("c_custkey")),
        _text("db", F.col("c_custkey")).alias("database_name"),
        F.when(F.col("c_nationkey") % 2 == 0, "FULL").otherwise("SIMPLE").alias("recovery_model"),
    )
    kind = F.col("event_type")
    backups = _events(spark, sf).select(
        _server(F.col("user_id")),
        _text("db", F.col("user_id")).alias("database_name"),
        F.when(kind == "click", "D").when(kind == "view", "I").when(kind == "purchase", "L").otherwise(kind).alias("type"),
        F.col("ts").alias("finish_time"),
    )
    return O.backup_recency(databases, backups)


_RECENCY_SQL = """recency AS (
SELECT 'srv' || (c_custkey % 4) AS server, 'db' || c_custkey AS database_name,
  CASE WHEN c_nationkey % 2 = 0 THEN 'FULL' ELSE 'SIMPLE' END AS recovery_model,
  max(ts) FILTER (event_type = 'click') AS last_full, max(ts) FILTER (event_type = 'view') AS last_differential,
  max(ts) FILTER (event_type = 'purchase') AS last_log
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY ALL)"""


@history.query(f"WITH {_RECENCY_SQL} SELECT * FROM recency")
def recency_pivot(spark, sf):
    return _recency(spark, sf)


def _days(ts):
    return f"(epoch_us({_ts}) - epoch_us({ts})) / 86400000000.0"


SHOWN = ["server", "category", "severity", "severity_rank", "title", "details", "database"]


@history.query(f"""WITH {_RECENCY_SQL}, aged AS (
SELECT *, {_days('last_full')} AS age, (epoch_us({_ts}) - epoch_us(last_log)) / 3600000000.0 AS log_age FROM recency)
SELECT server, 'Backups' AS category, 'Critical' AS severity, 4 AS severity_rank,
  database_name || ': no full backup on record' AS title, 'the backup history holds no full backup' AS details,
  database_name AS database FROM aged WHERE last_full IS NULL
UNION ALL SELECT server, 'Backups', CASE WHEN age > 5 THEN 'Critical' ELSE 'High' END, CASE WHEN age > 5 THEN 4 ELSE 3 END,
  database_name || ': full backup is ' || round(age)::BIGINT || ' day(s) old',
  'Last full backup: ' || strftime(last_full, '%Y-%m-%d') || '.', database_name FROM aged WHERE age > 2
UNION ALL SELECT server, 'Backups', 'Critical', 4, database_name || ': FULL recovery model with no recent log backup',
  CASE WHEN last_log IS NULL THEN 'The history has no log backup.'
    ELSE 'Last log backup: ' || strftime(last_log, '%Y-%m-%d %H:%M') || '.' END, database_name
FROM aged WHERE last_full IS NOT NULL AND recovery_model = 'FULL' AND (last_log IS NULL OR log_age > 48)""")
def freshness_findings(spark, sf):
    # Event ages stay within days: the limits are scaled down.
    return O.freshness_findings(_recency(spark, sf), AS_OF, high_days=2, critical_days=5, log_hours=48).select(SHOWN)


@history.query(f"""
SELECT server, 'Integrity' AS category, severity,
  CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 0 END AS severity_rank,
  CASE WHEN last_good IS NULL THEN database || ': no successful CHECKDB on record'
    ELSE database || ': last known-good CHECKDB ' || round(age)::BIGINT || ' day(s) ago' END AS title,
  CASE WHEN last_good IS NULL THEN 'no known-good integrity check; corruption could go unnoticed'
    ELSE 'Last known-good integrity check: ' || strftime(last_good, '%Y-%m-%d') || '.' END AS details, database
FROM (SELECT *, CASE WHEN last_good IS NULL OR age > 4 THEN 'High' WHEN age > 2 THEN 'Medium' ELSE 'Info' END AS severity
  FROM (SELECT *, {_days('last_good')} AS age
    FROM (SELECT 'srv' || (c_custkey % 4) AS server, 'db' || c_custkey AS database,
        max(ts) FILTER (event_type = 'signup') AS last_good
      FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY ALL)))""")
def integrity_age(spark, sf):
    names = read_table(spark, sf, "customer").select(
        _server(F.col("c_custkey")), F.col("c_custkey").alias("user_id"),
        _text("db", F.col("c_custkey")).alias("database_name"),
    )
    checks = O.recency_pivot(names, _events(spark, sf), ["user_id"], "event_type", "ts", {"last_good": "signup"})
    return O.integrity_findings(checks, AS_OF, medium_days=2, high_days=4).select(SHOWN)


# ---- jobs -------------------------------------------------------------------


def _runs(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "error", 0).when(kind == "click", 1).when(kind == "view", 2).when(kind == "signup", 3).otherwise(4)
    return _events(spark, sf).select(
        _server(F.col("user_id")), F.col("user_id").cast("string").alias("job_id"),
        (F.col("event_id") % 2).cast("int").alias("step_id"), status.alias("run_status"), F.col("ts").alias("run_time"),
        F.concat("event_type", F.lit(" \t "), "props", F.lit("\r\n "), F.repeat("props", F.lit(2)), F.lit(" ")).alias("message"),
    )


def _jobs(spark, sf):
    return read_table(spark, sf, "customer").select(
        _server(F.col("c_custkey")), F.col("c_custkey").cast("string").alias("job_id"), F.col("c_name").alias("name"),
        (F.col("c_acctbal") > 0).alias("enabled"),
    )


def _activity(spark, sf):
    planned = F.when(F.col("event_type") != "error", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(6)))
    return _events(spark, sf).select(
        _server(F.col("user_id")), F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("start_time"),
        planned.alias("next_run_time"),
    )


_LAST_SQL = """SELECT user_id, CASE arg_max(event_type, ts) WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Succeeded'
    WHEN 'view' THEN 'Retry' WHEN 'signup' THEN 'Canceled' ELSE 'Unknown' END AS last_run_outcome, max(ts) AS last_run_time
  FROM events WHERE event_id % 2 = 0 GROUP BY 1"""
_NEXT_SQL = "SELECT user_id, max(ts) + INTERVAL 6 HOUR AS next_run_time FROM events WHERE event_type <> 'error' GROUP BY 1"


@history.query(f"SELECT 'srv' || (user_id % 4) AS server, user_id::VARCHAR AS job_id, last_run_outcome, last_run_time FROM ({_LAST_SQL})")
def latest_run(spark, sf):
    return O.latest_run(_runs(spark, sf))


@history.query(f"SELECT 'srv' || (user_id % 4) AS server, user_id::VARCHAR AS job_id, next_run_time FROM ({_NEXT_SQL})")
def next_run(spark, sf):
    return O.next_run(_activity(spark, sf))


@history.query(f"""
SELECT e.server, expected_prefix, c_custkey IS NOT NULL AS found, c_custkey::VARCHAR AS job_id, c_name AS name,
  c_acctbal > 0 AS enabled, last_run_outcome, last_run_time, next_run_time
FROM (SELECT DISTINCT 'srv' || (c_custkey % 4) AS server, unnest(['customer#0000000', 'Customer#00000012', 'Nightly - '])
    AS expected_prefix FROM customer) AS e
LEFT JOIN customer ON 'srv' || (c_custkey % 4) = e.server AND starts_with(lower(c_name), lower(expected_prefix))
LEFT JOIN ({_LAST_SQL}) AS l ON l.user_id = c_custkey LEFT JOIN ({_NEXT_SQL}) AS n ON n.user_id = c_custkey""")
def maintenance_status(spark, sf):
    prefixes = ["customer#0000000", "Customer#00000012", "Nightly - "]
    return O.maintenance_status(_jobs(spark, sf), _runs(spark, sf), _activity(spark, sf), prefixes)


@history.query("""
SELECT expected_prefix, p_partkey, p_type, p_partkey IS NOT NULL AS found
FROM (VALUES ('eco'), ('PROMO'), ('XL')) AS e(expected_prefix)
LEFT JOIN part ON starts_with(lower(p_type), lower(expected_prefix))""")
def expected_coverage(spark, sf):
    parts = read_table(spark, sf, "part").select("p_partkey", "p_type")
    return O.expected_coverage(parts, "p_type", ["eco", "PROMO", "XL"])


@history.query("""
SELECT server, component, modified IS NOT NULL AS installed, strftime(modified, '%Y-%m-%d') AS version,
  CASE WHEN modified IS NULL THEN 'not found - install from ' || pointer ELSE '' END AS instructions
FROM (SELECT DISTINCT 'srv' || user_id AS server FROM events)
JOIN (VALUES ('Click', 'a'), ('PURCHASE', 'b'), ('refund', 'c')) AS e(component, pointer) ON true
LEFT JOIN (SELECT 'srv' || user_id AS owner, event_type, max(ts) AS modified FROM events WHERE value > 100 GROUP BY ALL)
  ON owner = server AND event_type = lower(component)""")
def component_inventory(spark, sf):
    # Small events are other components: they only make their server known.
    name = F.when(F.col("value") > 100, F.col("event_type")).otherwise("other")
    found = _events(spark, sf).select(
        _text("srv", F.col("user_id")).alias("server"), name.alias("name"), F.col("ts").alias("modified")
    )
    return O.component_inventory(found, {"Click": "a", "PURCHASE": "b", "refund": "c"})


_FAILED_SQL = f"""failed AS (SELECT 'srv' || (user_id % 4) AS server, user_id::VARCHAR AS job_id, c_name AS job_name,
  ts AS run_time, trim(regexp_replace(event_type || ' \t ' || props || E'\\r\\n ' || props || props || ' ', '\\s+', ' ', 'g')) AS flat
FROM events JOIN customer ON c_custkey = user_id
WHERE event_type = 'error' AND event_id % 2 = 0 AND ts >= {_ts} - INTERVAL 7 DAY AND ts <= {_ts})"""
_CUT_SQL = "CASE WHEN length(flat) > 30 THEN left(flat, 30) || '...' ELSE flat END"


@history.query(f"WITH {_FAILED_SQL} SELECT server, job_id, job_name, run_time, {_CUT_SQL} AS message FROM failed")
def recent_failures(spark, sf):
    return O.recent_failures(_runs(spark, sf), _jobs(spark, sf), AS_OF, max_message=30)


@history.query(f"""WITH {_FAILED_SQL}
SELECT server, 'Medium' AS severity, 'Agent job failed: ' || job_name AS title,
  'Failed at ' || strftime(run_time, '%Y-%m-%d %H:%M') || ': ' || {_CUT_SQL} AS details FROM failed""")
def failure_findings(spark, sf):
    failures = O.recent_failures(_runs(spark, sf), _jobs(spark, sf), AS_OF, max_message=30)
    return O.failure_findings(failures).select("server", "severity", "title", "details")


_OWNED_SQL = """owned AS (
SELECT 'srv' || (o_custkey % 4) AS server, 'job ' || o_orderkey AS job, owner, owner_type, o_orderstatus = 'O' AS enabled
FROM orders JOIN (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'svc_' || c_name WHEN 'BUILDING' THEN c_name || '$'
    WHEN 'FURNITURE' THEN 'nt ' || c_name ELSE c_name END AS owner,
  CASE c_nationkey % 3 WHEN 0 THEN 'SQL_LOGIN' WHEN 1 THEN 'WINDOWS_LOGIN' ELSE 'WINDOWS_GROUP' END AS owner_type FROM customer)
  ON c_custkey = o_custkey
WHERE owner_type IN ('SQL_LOGIN', 'WINDOWS_LOGIN') AND lower(owner) <> 'sa' AND NOT ends_with(owner, '$')
  AND NOT contains(lower(owner), 'svc') AND NOT contains(lower(owner), 'service') AND NOT starts_with(lower(owner), 'nt '))"""


@history.query(f"WITH {_OWNED_SQL} SELECT * FROM owned")
def owner_audit(spark, sf):
    return _owner_audit(spark, sf).select("server", F.col("name").alias("job"), "owner", "owner_type", "enabled")


def _owner_audit(spark, sf):
    sid = lambda key: F.col(key).cast("string").cast("binary")
    segment, name, nation = F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey") % 3
    jobs = read_table(spark, sf, "orders").select(
        _server(F.col("o_custkey")), _text("job ", F.col("o_orderkey")).alias("name"),
        (F.col("o_orderstatus") == "O").alias("enabled"), sid("o_custkey").alias("owner_sid"),
    )
    principals = read_table(spark, sf, "customer").select(
        _server(F.col("c_custkey")), sid("c_custkey").alias("sid"),
        F.when(segment == "AUTOMOBILE", _text("svc_", name)).when(segment == "BUILDING", _text(name, "$"))
        .when(segment == "FURNITURE", _text("nt ", name)).otherwise(name).alias("name"),
        F.when(nation == 0, "SQL_LOGIN").when(nation == 1, "WINDOWS_LOGIN").otherwise("WINDOWS_GROUP").alias("type_desc"),
    )
    return O.owner_audit(jobs, principals)


@history.query(f"""WITH {_OWNED_SQL}
SELECT server, 'Landmine' AS category, 'High' AS severity, job AS object, true AS needs_annotation,
  'Job "' || job || '" is owned by what looks like a personal login: ' || owner AS title,
  'Owner type: ' || owner_type || ', job enabled: ' || enabled || '. Once that login is disabled, the job can fail.' AS details,
  'Which service account should own the job? If none, why?' AS question
FROM owned""")
def owner_findings(spark, sf):
    shown = ["server", "category", "severity", "object", "needs_annotation", "title", "details", "question"]
    return O.owner_findings(_owner_audit(spark, sf)).select(shown)


# ---- threshold rules --------------------------------------------------------


def _measures(spark, sf):
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    settings = read_table(spark, sf, "customer").select(
        _text("cust", F.col("c_custkey")).alias("server"),
        F.when(segment == "BUILDING", "Cost Threshold for Parallelism").when(segment == "MACHINERY", "max degree of parallelism")
        .when(segment == "HOUSEHOLD", "max server memory (MB)").otherwise("min server memory (MB)").alias("name"),
        F.when(segment == "BUILDING", F.floor(F.col("c_acctbal") / 100)).when(segment == "MACHINERY", nation.cast("bigint"))
        .otherwise(F.when(nation < 3, 2147483647).otherwise(1000).cast("bigint")).alias("value_in_use"),
    )
    doc, good, toxic = F.col("doc_id"), F.col("quality") == 1, F.col("toxic") == 1
    databases = read_table(spark, sf, "labels").select(
        _text("lab", doc % 10).alias("server"), _text("doc", doc).alias("database_name"),
        toxic.alias("is_auto_shrink_on"), (~good).alias("is_auto_close_on"), (good & toxic).alias("is_published"),
        F.lit(False).alias("is_subscribed"), (doc == 7).alias("is_distributor"), (doc % 50 == 0).alias("is_cdc_enabled"),
    )
    files = read_table(spark, sf, "supplier").select(
        _text("n", F.col("s_nationkey")).alias("server"),
        F.when(F.col("s_suppkey") % 3 == 0, "LOG").otherwise("ROWS").alias("type_desc"),
        (F.col("s_acctbal") < 0).alias("is_percent_growth"), F.col("s_nationkey").alias("cpu_count"),
    )
    measures = O.setting_measures(settings)
    for more in [O.database_measures(databases), O.temp_file_measures(files), O.topology_measures(databases)]:
        measures = measures.unionByName(more)
    return measures


@history.query("""
SELECT 'cust' || c_custkey AS server, 'Configuration' AS category, 'Low' AS severity,
  'Cost threshold for parallelism left at default' AS title, NULL AS database
FROM customer WHERE c_mktsegment = 'BUILDING' AND floor(c_acctbal / 100) <= 5
UNION ALL SELECT 'cust' || c_custkey, 'Configuration', 'Medium', 'MAXDOP left at default (0 = unlimited)', NULL
FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 0
UNION ALL SELECT 'cust' || c_custkey, 'Configuration', 'High', 'Max server memory not configured', NULL
FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_nationkey < 3
UNION ALL SELECT 'lab' || (doc_id % 10), 'Configuration', 'Medium', 'doc' || doc_id || ': auto-shrink is ON', 'doc' || doc_id
FROM labels WHERE toxic = 1
UNION ALL SELECT 'lab' || (doc_id % 10), 'Configuration', 'Low', 'doc' || doc_id || ': auto-close is ON', 'doc' || doc_id
FROM labels WHERE quality <> 1
UNION ALL SELECT 'n' || s_nationkey, 'Configuration', 'Medium', 'tempdb has fewer data files than CPUs (up to 8)', NULL
FROM supplier GROUP BY s_nationkey HAVING count(*) FILTER (s_suppkey % 3 <> 0) < least(s_nationkey, 8)
UNION ALL SELECT 'n' || s_nationkey, 'Configuration', 'Low', 'tempdb has percentage-based autogrowth', NULL
FROM supplier GROUP BY s_nationkey HAVING bool_or(s_acctbal < 0)
UNION ALL SELECT 'lab' || (doc_id % 10) AS s, 'Topology', 'Info',
  count(*) FILTER ((quality = 1 AND toxic = 1) OR doc_id = 7) || ' database(s) involved in replication', NULL
FROM labels GROUP BY s HAVING count(*) FILTER ((quality = 1 AND toxic = 1) OR doc_id = 7) > 0
UNION ALL SELECT 'lab' || (doc_id % 10) AS s, 'Topology', 'Info',
  count(*) FILTER (doc_id % 50 = 0) || ' database(s) have Change Data Capture enabled', NULL
FROM labels GROUP BY s HAVING count(*) FILTER (doc_id % 50 = 0) > 0""")
def rule_findings(spark, sf):
    return O.rule_findings(_measures(spark, sf)).select("server", "category", "severity", "title", "database")


# ---- access inventory -------------------------------------------------------

ROLE = "Supplier#000000003"


@history.query(f"""
SELECT 'srv' AS server, 'Security' AS category, 'Info' AS severity,
  '{ROLE} member: ' || s_name || CASE WHEN s_acctbal < 0 THEN ' (disabled)' ELSE '' END AS title, NULL AS database
FROM supplier WHERE s_suppkey % 3 <> 2
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_partkey % 1000 = 3)
UNION ALL SELECT 'srv', 'Security', 'Info', 'Disabled login still present: ' || s_name, NULL FROM supplier
WHERE s_acctbal < 0 AND s_suppkey % 3 <> 2
UNION ALL SELECT 'srv', 'Security', 'Low', 'Orphaned database user: ' || c_name, 'db' || c_nationkey FROM customer
WHERE c_nationkey % 4 <> 0 AND c_custkey > 4 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey * 3 = c_custkey)
UNION ALL SELECT 'srv', 'Landmine', 'Info', 'Linked server: ' || n_name, NULL FROM nation""")
def inventory_findings(spark, sf):
    server = F.lit("srv").alias("server")
    sid = lambda key: key.cast("string").cast("binary").alias("sid")
    key = F.col("s_suppkey")
    principals = read_table(spark, sf, "supplier").select(
        server, key.alias("principal_id"), sid(key * 3), F.col("s_name").alias("name"),
        F.when(key % 3 == 0, "S").when(key % 3 == 1, "U").otherwise("R").alias("type"), F.lit("LOGIN").alias("type_desc"),
        (F.col("s_acctbal") < 0).alias("is_disabled"), F.lit(AS_OF).cast("timestamp").alias("create_date"),
    )
    members = read_table(spark, sf, "lineitem").select(
        server, F.col("l_suppkey").alias("member_principal_id"), (F.col("l_partkey") % 1000).alias("role_principal_id")
    )
    users = read_table(spark, sf, "customer").select(
        server, _text("db", F.col("c_nationkey")).alias("database"), F.col("c_custkey").alias("principal_id"),
        F.col("c_name").alias("name"), F.lit("S").alias("type"), sid(F.col("c_custkey")),
        F.when(F.col("c_nationkey") % 4 == 0, "DATABASE").otherwise("INSTANCE").alias("auth_type"),
    )
    nation, customer = read_table(spark, sf, "nation"), read_table(spark, sf, "customer")
    linked = nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        server, F.col("n_name").alias("name"), F.lit("p").alias("product"), F.lit("v").alias("provider"),
        F.col("n_regionkey").cast("string").alias("data_source"), (F.col("c_acctbal") < 0).alias("uses_self_credential"),
    )
    found = union_findings(
        [
            O.role_member_findings(principals, members, ROLE),
            O.disabled_login_findings(principals),
            O.orphan_findings(O.orphaned_users(users, principals)),
            O.linked_server_findings(linked),
        ]
    )
    return by_urgency(found).select("server", "category", "severity", "title", "database")


# ---- availability -----------------------------------------------------------


def _replicas(spark, sf):
    key = F.col("s_suppkey")
    return read_table(spark, sf, "supplier").select(
        _text("srv", F.floor(key / 10)).alias("server"), _text("ag", key % 5).alias("ag_name"), F.col("s_name").alias("replica"),
        F.when(key % 2 == 0, "PRIMARY").otherwise("SECONDARY").alias("role"),
        F.when(F.col("s_acctbal") < -500, "DISCONNECTED").otherwise("CONNECTED").alias("connected_state"),
        F.when(F.col("s_nationkey") < 5, "NOT_HEALTHY").when(F.col("s_nationkey") < 8, "PARTIALLY_HEALTHY")
        .otherwise("HEALTHY").alias("sync_health"),
    )


@history.query("""
SELECT server, CASE WHEN kind = 2 THEN 'Medium' ELSE 'High' END AS severity, 'AG ''ag' || (s_suppkey % 5) || ''': replica '
  || s_name || CASE kind WHEN 0 THEN ' is DISCONNECTED' WHEN 1 THEN ' sync health is NOT_HEALTHY'
    ELSE ' sync health is PARTIALLY_HEALTHY' END AS title,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Role: PRIMARY.' ELSE 'Role: SECONDARY.' END AS details
FROM (SELECT *, 'srv' || (s_suppkey // 10) AS server, CASE WHEN s_acctbal < -500 THEN 0 WHEN s_nationkey < 5 THEN 1
  WHEN s_nationkey < 8 THEN 2 END AS kind FROM supplier) WHERE kind IS NOT NULL""")
def replica_health(spark, sf):
    return O.replica_health(_replicas(spark, sf)).select("server", "severity", "title", "details")


def _replica_databases(spark, sf):
    user = F.col("user_id")
    return (
        _events(spark, sf)
        .groupBy("user_id")
        .agg(
            (F.count_if(F.col("event_type") == "error") > 18).alias("is_suspended"),
            F.when(F.count_if(F.col("event_type") == "view") > 16, "NOT_SYNCHRONIZING").otherwise("SYNCHRONIZED").alias("sync_state"),
            F.floor((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 1_000_000)
            .alias("lag_seconds"),
            (F.sum(F.floor("value")) * 1000).alias("redo_queue_kb"),
        )
        .select(
            _text("srv", F.floor(user / 10)).alias("server"), _text("ag", user % 5).alias("ag_name"),
            _text("rep", user).alias("replica"), _text("db", user % 3).alias("database_name"),
            "is_suspended", "sync_state", "lag_seconds", "redo_queue_kb",
        )
    )


_LAG_SQL = f"""lag AS (
SELECT *, 'srv' || (user_id // 10) AS server, 'AG ''ag' || (user_id % 5) || ''': db' || (user_id % 3) AS head,
  'rep' || user_id AS replica
FROM (SELECT user_id, count(*) FILTER (event_type = 'error') > 18 AS suspended, count(*) FILTER (event_type = 'view') > 16 AS stopped,
    floor((epoch_us({_ts}) - epoch_us(max(ts))) / 1000000)::BIGINT AS lag_seconds,
    sum(floor(value))::BIGINT * 1000 AS redo FROM events GROUP BY 1)
), lag_findings AS (
SELECT server, 'Critical' AS severity, head || ' data movement is SUSPENDED on ' || replica AS title FROM lag WHERE suspended
UNION ALL SELECT server, 'High', head || ' is NOT_SYNCHRONIZING on ' || replica FROM lag WHERE stopped AND NOT suspended
UNION ALL SELECT server, 'Medium', head || ' on ' || replica || ' is ' || format('{{:,}}', lag_seconds) || 's behind'
  FROM lag WHERE lag_seconds > 60000
UNION ALL SELECT server, 'Medium', head || ' redo queue on ' || replica || ' is ' || format('{{:,}}', redo // 1024) || ' MB'
  FROM lag WHERE redo > 4000000)"""


def _lag(spark, sf):
    return O.replica_lag(_replica_databases(spark, sf), max_lag_seconds=60_000, max_redo_kb=4_000_000)


@history.query(f"WITH {_LAG_SQL} SELECT server, severity, title FROM lag_findings")
def replica_lag(spark, sf):
    return _lag(spark, sf).select("server", "severity", "title")


@history.query(f"""WITH {_LAG_SQL}
SELECT 'srv' || (c_custkey // 10) AS server, 'Info' AS severity, count(*) || ' AG replica(s) across '
  || count(DISTINCT c_nationkey % 3) || ' Availability Group(s) - all healthy' AS title
FROM customer GROUP BY 1 HAVING 'srv' || (c_custkey // 10) NOT IN (SELECT server FROM lag_findings)""")
def all_healthy(spark, sf):
    replicas = read_table(spark, sf, "customer").select(
        _text("srv", F.floor(F.col("c_custkey") / 10)).alias("server"), (F.col("c_nationkey") % 3).alias("ag_name")
    )
    return O.all_healthy(replicas, _lag(spark, sf)).select("server", "severity", "title")


_ERRORS_SQL = """recent AS (
SELECT 'srv' AS server, distributor, errors, array_to_string(lines[1:5], ' | ')
  || CASE WHEN errors > 5 THEN ' ... and ' || (errors - 5) || ' more' ELSE '' END AS summary
FROM (SELECT distributor, count(*) AS errors, list(strftime(ts, '%Y-%m-%d %H:%M') || ': ' || props ORDER BY ts DESC, props) AS lines
  FROM (SELECT (user_id % 7)::VARCHAR AS distributor, ts, props
    FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-29 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00')
  GROUP BY 1))"""


@history.query(f"WITH {_ERRORS_SQL} SELECT * FROM recent")
def recent_errors(spark, sf):
    errors = _events(spark, sf).filter("event_type = 'error'").select(
        F.lit("srv").alias("server"), (F.col("user_id") % 7).cast("string").alias("distributor"), F.col("ts").alias("time"),
        F.col("props").alias("error_text"),
    )
    return O.recent_errors(errors, "2024-01-30 12:00:00")


@history.query(f"""WITH {_ERRORS_SQL}
SELECT server, 'Availability' AS category, 'High' AS severity,
  errors || ' replication error(s) in the last 24h (' || distributor || ')' AS title, summary AS details FROM recent""")
def error_findings(spark, sf):
    return O.error_findings(recent_errors(spark, sf)).select("server", "category", "severity", "title", "details")
