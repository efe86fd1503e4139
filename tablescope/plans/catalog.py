"""Queries: discovery, usage, contention and indexes.

lineitem stands for partition statistics and index columns, supplier and orders
for the catalogs, events for usage counters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import discover as D
from tablescope.operators import indexes as X
from tablescope.operators import score as C
from tablescope.operators import workload as L
from tablescope.plans.registry import Registry
from tablescope.plans.tables import read_table

catalog = Registry()
SERVERS = 4


def server_of(key):
    return F.concat(F.lit("srv"), F.pmod(key, F.lit(SERVERS)).cast("string"))


def _suppliers(spark, sf):
    balance = F.col("s_acctbal")
    return read_table(spark, sf, "supplier").select(
        server_of(F.col("s_suppkey")).alias("server"),
        F.col("s_suppkey").alias("object_id"),
        F.col("s_nationkey").alias("schema_id"),
        F.col("s_name").alias("table_name"),
        (balance < -500).alias("is_system"),
        (balance > 9500).alias("is_memory_optimized"),
        (F.col("s_suppkey") % 2 == 0).alias("is_replicated"),
        (F.col("s_suppkey") % 5 == 0).alias("is_cdc_tracked"),
    )


def _partition_stats(spark, sf):
    return read_table(spark, sf, "lineitem").select(
        server_of(F.col("l_suppkey")).alias("server"),
        F.col("l_suppkey").alias("object_id"),
        F.col("l_linenumber").alias("index_id"),
        F.col("l_quantity").cast("bigint").alias("row_count"),
        F.floor("l_extendedprice").alias("reserved_page_count"),
    )


def _schemas(spark, sf):
    return read_table(spark, sf, "nation").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(SERVERS - 1)), server_of)).alias("server"),
        F.col("n_nationkey").alias("schema_id"),
        F.col("n_name").alias("schema_name"),
    )


DISCOVER_SQL = """
SELECT server, object_id, row_count, total_size_mb, base_data_mb, nonclustered_mb, table_name,
  is_replicated, is_cdc_tracked, schema_name
FROM (SELECT *, row_number() OVER (PARTITION BY server
    ORDER BY total_size_mb DESC, schema_name, table_name, object_id) AS rk
  FROM (SELECT 'srv' || (s_suppkey % 4) AS server, s_suppkey AS object_id, s_name AS table_name,
      n_name AS schema_name, s_suppkey % 2 = 0 AS is_replicated, s_suppkey % 5 = 0 AS is_cdc_tracked,
      sum(CASE WHEN l_linenumber IN (0, 1) THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS row_count,
      round(sum(floor(l_extendedprice)) * 8 / 1024.0, 1) AS total_size_mb,
      round(sum(CASE WHEN l_linenumber IN (0, 1) THEN floor(l_extendedprice) ELSE 0 END) * 8 / 1024.0, 1) AS base_data_mb,
      round(sum(CASE WHEN l_linenumber > 1 THEN floor(l_extendedprice) ELSE 0 END) * 8 / 1024.0, 1) AS nonclustered_mb
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
    WHERE NOT (s_acctbal < -500) AND NOT (s_acctbal > 9500)
    GROUP BY ALL
    HAVING row_count >= 2400 OR floor(sum(floor(l_extendedprice)) * 8 / 1024) >= 240000))
WHERE rk <= 10"""


@catalog.query(DISCOVER_SQL)
def discover_tables(spark, sf):
    found = D.discover_tables(
        _suppliers(spark, sf), _schemas(spark, sf), _partition_stats(spark, sf), min_rows=2400, min_mb=240_000, top_n=10
    )
    sizes = ["total_size_mb", "base_data_mb", "nonclustered_mb"]
    return found.withColumns({c: F.col(c).cast("double") for c in sizes})


OPERATIONS_SQL = """
SELECT 'srv' || (l_suppkey % 4) AS server, l_suppkey AS object_id,
  sum(l_linenumber)::BIGINT AS row_lock_wait_ms, sum(l_quantity::BIGINT)::BIGINT AS page_lock_wait_ms,
  sum(l_partkey)::BIGINT AS page_io_latch_wait_ms,
  count(*) FILTER (l_returnflag = 'A') AS leaf_inserts, count(*) FILTER (l_returnflag = 'N') AS leaf_updates,
  count(*) FILTER (l_returnflag = 'R') + count(*) FILTER (l_linestatus = 'F') AS leaf_deletes,
  100.0 * count(*) FILTER (l_returnflag = 'N')
    / (count(*) + count(*) FILTER (l_linestatus = 'F'))::DOUBLE AS update_share_pct
FROM lineitem GROUP BY ALL"""


@catalog.query(OPERATIONS_SQL)
def operational_totals(spark, sf):
    return D.write_ratios(D.operational_totals(_operational_stats(spark, sf)))


def _operational_stats(spark, sf):
    flag = lambda column, value: (F.col(column) == value).cast("bigint")
    return read_table(spark, sf, "lineitem").select(
        server_of(F.col("l_suppkey")).alias("server"),
        F.col("l_suppkey").alias("object_id"),
        F.col("l_linenumber").cast("bigint").alias("row_lock_wait_ms"),
        F.col("l_quantity").cast("bigint").alias("page_lock_wait_ms"),
        F.col("l_partkey").alias("page_io_latch_wait_ms"),
        flag("l_returnflag", "A").alias("leaf_insert"),
        flag("l_returnflag", "N").alias("leaf_update"),
        flag("l_returnflag", "R").alias("leaf_delete"),
        flag("l_linestatus", "F").alias("leaf_ghost"),
    )


@catalog.query("""
SELECT 'srv' || (s_suppkey % 4) AS server, s_suppkey AS object_id, s_name AS table_name,
  EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_partkey % 1000 IN (5, 6)) AS has_columnstore
FROM supplier""")
def existence_flag(spark, sf):
    tables = _suppliers(spark, sf).select("server", "object_id", "table_name")
    return D.flag_columnar(tables, _typed_indexes(spark, sf))


def _typed_indexes(spark, sf):
    return read_table(spark, sf, "lineitem").select(
        server_of(F.col("l_suppkey")).alias("server"),
        F.col("l_suppkey").alias("object_id"),
        (F.col("l_partkey") % 1000).alias("type"),
    )


def event_usage(events, key, server):
    is_ = lambda name: (F.col("event_type") == name).cast("bigint")
    return events.select(
        server.alias("server"), key.alias("object_id"),
        is_("view").alias("user_seeks"), is_("click").alias("user_scans"),
        is_("signup").alias("user_lookups"), is_("purchase").alias("user_updates"),
    )


def _customer_tables(spark, sf, *more):
    return read_table(spark, sf, "customer").select(
        server_of(F.col("c_custkey")).alias("server"), F.col("c_custkey").alias("object_id"), *more
    )


def _usage_inputs(spark, sf):
    events, user = read_table(spark, sf, "events"), F.col("user_id")
    missing = events.filter("event_type = 'error'").select(server_of(user).alias("server"), user.alias("object_id"))
    return event_usage(events, user, server_of(user)), missing


def _customer_usage(spark, sf, tables):
    return D.usage_rollup(tables, *_usage_inputs(spark, sf))


def fact_inputs(spark, sf):
    """The inputs of table_facts: suppliers as tables, lineitem and events as their counters."""
    usage, missing = _usage_inputs(spark, sf)
    return {
        "tables": _suppliers(spark, sf), "table_schemas": _schemas(spark, sf), "partition_stats": _partition_stats(spark, sf),
        "index_usage": usage, "missing_index": missing, "indexes": _typed_indexes(spark, sf),
        "operational_stats": _operational_stats(spark, sf),
    }


_USAGE_SQL = """
SELECT 'srv' || (c_custkey % 4) AS server, c_custkey AS object_id,
  coalesce(seeks, 0) AS user_seeks, coalesce(scans, 0) AS user_scans, coalesce(lookups, 0) AS user_lookups,
  coalesce(updates, 0) AS user_updates, coalesce(errors, 0) AS missing_index_suggestions,
  c_custkey * 100000 AS row_count, c_nationkey::DOUBLE AS base_data_mb, c_acctbal AS nonclustered_mb,
  coalesce(ins, 0) AS leaf_inserts, coalesce(upd, 0) AS leaf_updates, coalesce(del, 0) AS leaf_deletes,
  coalesce(latch, 0)::BIGINT AS page_io_latch_wait_ms
FROM customer LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'view') AS seeks,
    count(*) FILTER (event_type = 'click') AS scans, count(*) FILTER (event_type = 'signup') AS lookups,
    count(*) FILTER (event_type = 'purchase') AS updates, count(*) FILTER (event_type = 'error') AS errors,
    count(*) FILTER (event_type = 'signup') AS ins,
    count(*) FILTER (event_type = 'purchase' AND value > 150) AS upd,
    count(*) FILTER (event_type = 'error' AND value > 150) AS del,
    sum(floor(value)) FILTER (event_type = 'click') AS latch
  FROM events GROUP BY user_id) ON user_id = c_custkey"""


@catalog.query(f"""
SELECT server, object_id, user_seeks, user_scans, user_lookups, user_updates, missing_index_suggestions,
  row_count, base_data_mb, nonclustered_mb,
  CASE WHEN user_seeks + user_scans + user_lookups = 0 THEN 0.0
    ELSE 100.0 * user_scans / (user_seeks + user_scans + user_lookups)::DOUBLE END AS scan_pct,
  CASE WHEN user_seeks + user_scans + user_lookups + user_updates = 0 THEN 0.0
    ELSE 100.0 * user_updates / (user_seeks + user_scans + user_lookups + user_updates)::DOUBLE END AS write_pct,
  CASE WHEN base_data_mb = 0 THEN 0.0 ELSE nonclustered_mb / base_data_mb END AS index_bloat_ratio,
  row_count::DOUBLE / 1048576.0 AS potential_rowgroups
FROM ({_USAGE_SQL})""")
def usage_rollup(spark, sf):
    tables = _customer_tables(
        spark, sf,
        (F.col("c_custkey") * 100_000).alias("row_count"),
        F.col("c_nationkey").cast("double").alias("base_data_mb"),
        F.col("c_acctbal").alias("nonclustered_mb"),
    )
    return D.size_ratios(D.usage_ratios(_customer_usage(spark, sf, tables)))


def _event_operations(spark, sf):
    user = F.col("user_id")
    when = lambda name, extra: ((F.col("event_type") == name) & extra).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return D.operational_totals(
        read_table(spark, sf, "events").select(
            server_of(user).alias("server"), user.alias("object_id"),
            zero.alias("row_lock_wait_ms"), zero.alias("page_lock_wait_ms"),
            F.when(F.col("event_type") == "click", F.floor("value")).otherwise(zero).alias("page_io_latch_wait_ms"),
            when("signup", F.lit(True)).alias("leaf_insert"),
            when("purchase", F.col("value") > 150).alias("leaf_update"),
            when("error", F.col("value") > 150).alias("leaf_delete"),
            zero.alias("leaf_ghost"),
        )
    )


@catalog.query(f"""
SELECT server, object_id, used AS is_used, append AS is_insert_only, used AND append AS append_only_writes,
  used AND NOT append AND leaf_inserts + leaf_updates + leaf_deletes > 0
    AND 100.0 * leaf_updates / (leaf_inserts + leaf_updates + leaf_deletes) >= 20 AS update_heavy,
  used AND user_lookups > 13 AS uncovered_lookups, used AND page_io_latch_wait_ms > 700 AS io_bound
FROM (SELECT *, user_seeks + user_scans + user_lookups + user_updates > 0 AS used,
  leaf_inserts > 0 AND leaf_updates = 0 AND leaf_deletes = 0 AS append FROM ({_USAGE_SQL}))""")
def workload_flags(spark, sf):
    operations = _event_operations(spark, sf)
    counters = [c for c in operations.columns if c not in D.TABLE_KEY]
    tables = _customer_usage(spark, sf, _customer_tables(spark, sf)).join(operations, D.TABLE_KEY, "left")
    flagged = L.workload_flags(tables.fillna(0, counters), many_lookups=13, long_latch_ms=700)
    return flagged.select(
        *D.TABLE_KEY, "is_used", "is_insert_only", "append_only_writes", "update_heavy", "uncovered_lookups", "io_bound"
    )


# ---- indexes: one per order, sixteen orders per table ------------------------

PER_TABLE = 16

_table_of = lambda order: F.floor(order / PER_TABLE)


def _index_key(order):
    table = _table_of(order)
    return [server_of(table).alias("server"), table.alias("object_id"), order.alias("index_id")]


def _indexes(spark, sf):
    order, priority = F.col("o_orderkey"), F.left("o_orderpriority", F.lit(1))
    return read_table(spark, sf, "orders").select(
        *_index_key(order),
        F.concat(F.lit("ix_"), order.cast("string")).alias("index_name"),
        F.when(priority == "5", 0).when(priority == "1", 1).when(priority == "4", 6).otherwise(2).alias("type"),
        F.when(priority == "5", "HEAP").when(priority == "1", "CLUSTERED")
        .when(priority == "4", "NONCLUSTERED COLUMNSTORE").otherwise("NONCLUSTERED").alias("type_desc"),
    )


def _inventory(spark, sf):
    order, line = F.col("o_orderkey"), F.col("l_orderkey")
    orders, lines = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
    columns = lines.select(
        *_index_key(line),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("column_name"),
        F.col("l_linenumber").alias("key_ordinal"),
        (F.col("l_returnflag") == "R").alias("is_included"),
    )
    sizes = lines.select(*_index_key(line), F.floor("l_extendedprice").alias("reserved_page_count"))
    none = F.lit(0).cast("bigint")
    usage = orders.select(
        *_index_key(order),
        (F.col("o_custkey") % 3).alias("user_seeks"), none.alias("user_scans"), none.alias("user_lookups"),
        F.floor(F.col("o_totalprice") / 10).alias("user_updates"),
    )
    return X.index_inventory(_indexes(spark, sf), columns, sizes, usage)


def _index_tables(spark, sf):
    pages = (
        read_table(spark, sf, "lineitem")
        .groupBy(_table_of(F.col("l_orderkey")).alias("object_id"))
        .agg((F.sum(F.floor("l_extendedprice")).cast("double") * 8 / 10240).alias("base_data_mb"))
    )
    indexed = pages.select(server_of(F.col("object_id")).alias("server"), "object_id", "base_data_mb")
    bare = read_table(spark, sf, "customer").select(
        F.lit("srv0").alias("server"), (-F.col("c_custkey") - 1).alias("object_id"), F.lit(0.0).alias("base_data_mb")
    )
    return indexed.unionByName(bare)


def _index_columns(spark, sf):
    line, table = F.col("l_linenumber"), F.col("object_id")
    facts = (
        read_table(spark, sf, "lineitem")
        .groupBy(_table_of(F.col("l_orderkey")).alias("object_id"), "l_linenumber")
        .agg(F.count_distinct("l_quantity").alias("distinct_values"))
    )
    lob, computed = (table + line) % 7 == 0, (table + line) % 5 == 0
    return facts.select(
        server_of(table).alias("server"), "object_id",
        F.concat(F.lit("C"), line.cast("string")).alias("column"), line.alias("ordinal"),
        lob.alias("is_lob"), computed.alias("is_computed"), (~lob & ~computed).alias("analyzed"), "distinct_values",
    )


_INVENTORY_SQL = """inv AS (
SELECT 'srv' || (o_orderkey // 16 % 4) AS server, o_orderkey // 16 AS object_id, o_orderkey AS index_id,
  'ix_' || o_orderkey AS index_name,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'CLUSTERED' WHEN '4' THEN 'NONCLUSTERED COLUMNSTORE'
    ELSE 'NONCLUSTERED' END AS type_desc,
  size_mb, coalesce(keys, []) AS keys, coalesce(includes, []) AS includes,
  o_custkey % 3 AS reads, floor(o_totalprice / 10)::BIGINT AS user_updates
FROM orders
JOIN (SELECT l_orderkey, round(sum(floor(l_extendedprice)) * 8 / 1024.0, 1) AS size_mb FROM lineitem GROUP BY 1)
  AS s ON s.l_orderkey = o_orderkey
JOIN (SELECT l_orderkey,
    list_sort(list(DISTINCT 'c' || l_linenumber) FILTER (l_returnflag <> 'R')) AS keys,
    list_sort(list(DISTINCT 'c' || l_linenumber) FILTER (l_returnflag = 'R')) AS includes
  FROM lineitem GROUP BY 1) AS c ON c.l_orderkey = o_orderkey
WHERE left(o_orderpriority, 1) <> '5')"""

_DEAD_SQL = "type_desc = 'NONCLUSTERED' AND ((reads = 0 AND user_updates > 0) OR (reads < 20 AND user_updates > 40000))"
_MANY_WRITES = 40_000


@catalog.query(f"""
WITH {_INVENTORY_SQL}
SELECT server, object_id, index_id, index_name, type_desc, size_mb,
  array_to_string(keys, ', ') AS key_columns, array_to_string(includes, ', ') AS included_columns,
  len(keys)::INTEGER AS key_column_count, len(includes)::INTEGER AS included_column_count, reads, user_updates,
  CASE WHEN type_desc = 'NONCLUSTERED' AND reads = 0 AND user_updates > 0
      THEN 'DROP CANDIDATE: written to, never read (since last restart)'
    WHEN type_desc = 'NONCLUSTERED' AND len(includes) >= 5
      THEN 'WIDE: 5+ included columns - likely replaceable by columnstore' ELSE '' END AS note
FROM inv""")
def index_inventory(spark, sf):
    return _inventory(spark, sf).select(
        "server", "object_id", "index_id", "index_name", "type_desc", F.col("size_mb").cast("double").alias("size_mb"),
        F.array_join("key_columns", ", ").alias("key_columns"),
        F.array_join("included_columns", ", ").alias("included_columns"),
        "key_column_count", "included_column_count", "reads", "user_updates", "note",
    )


@catalog.query(f"""
WITH {_INVENTORY_SQL}
SELECT server, object_id, count(*) AS dead_count, round(sum(size_mb), 1) AS dead_mb
FROM inv WHERE {_DEAD_SQL} GROUP BY ALL""")
def dead_indexes(spark, sf):
    dead = X.dead_indexes(_inventory(spark, sf), many_writes=_MANY_WRITES)
    return dead.withColumn("dead_mb", F.col("dead_mb").cast("double"))


_FINDINGS_SQL = f"""{_INVENTORY_SQL}, base AS (
  SELECT l_orderkey // 16 AS object_id, sum(floor(l_extendedprice)) * 8 / 10240 AS base_data_mb FROM lineitem GROUP BY 1
), facts AS (
  SELECT *, (object_id + line) % 7 = 0 AS is_lob, (object_id + line) % 5 = 0 AS is_computed FROM (
    SELECT l_orderkey // 16 AS object_id, l_linenumber AS line, 'c' || l_linenumber AS name,
      count(DISTINCT l_quantity) AS distinct_values FROM lineitem GROUP BY ALL)
), judged AS (
  SELECT inv.*, base_data_mb, {_DEAD_SQL} AS dead,
    EXISTS (SELECT 1 FROM facts f WHERE f.object_id = inv.object_id AND is_lob AND list_contains(includes, name)) AS lob,
    EXISTS (SELECT 1 FROM facts f WHERE f.object_id = inv.object_id AND is_computed AND list_contains(keys, name)) AS computed,
    (SELECT distinct_values FROM facts f WHERE f.object_id = inv.object_id AND NOT is_lob AND NOT is_computed
      AND name = keys[1]) AS lead_distinct
  FROM inv JOIN base ON base.object_id = inv.object_id WHERE type_desc = 'NONCLUSTERED'
), found AS (
  SELECT server, object_id, index_name, size_mb, 'dead' AS kind,
    reads || ' reads, ' || user_updates || ' writes' AS detail, size_mb AS reclaim_mb FROM judged WHERE dead
  UNION ALL SELECT server, object_id, index_name, size_mb, 'lob_include', 'rebuild without the LOB include', size_mb * 0.9::DOUBLE
    FROM judged WHERE lob AND size_mb >= base_data_mb * 0.5
  UNION ALL SELECT server, object_id, index_name, size_mb, 'low_selectivity_key', keys[1] || ' has ' || lead_distinct || ' distinct', 0.0
    FROM judged WHERE lead_distinct <= 10 AND NOT dead AND NOT lob
  UNION ALL SELECT server, object_id, index_name, size_mb, 'computed_key', 'only feeds a dead index', 0.0
    FROM judged WHERE dead AND computed
  UNION ALL SELECT server, object_id, index_name, size_mb, 'wide', len(includes) || ' included columns', 0.0
    FROM judged WHERE NOT dead AND len(includes) >= 3
  UNION ALL SELECT 'srv0', -c_custkey - 1, NULL, 0.0, 'no_index', 'every read is a full scan', 0.0 FROM customer
  UNION ALL SELECT 'srv' || (object_id % 4), object_id, NULL, 0.0, 'no_index', 'every read is a full scan', 0.0
    FROM base WHERE object_id NOT IN (SELECT o_orderkey // 16 FROM orders WHERE left(o_orderpriority, 1) <> '5')
)"""


def _findings(spark, sf):
    # The derived indexes have few included columns: three count as wide here.
    return X.index_findings(
        _inventory(spark, sf), _index_tables(spark, sf), _index_columns(spark, sf),
        many_writes=_MANY_WRITES, wide_includes=3,
    )


@catalog.query(f"""
WITH {_FINDINGS_SQL}
SELECT server, object_id, index_name, size_mb, kind, detail, round(reclaim_mb, 3) AS reclaim_mb FROM found""")
def index_findings(spark, sf):
    bare = X.tables_without_index(_index_tables(spark, sf), _indexes(spark, sf))
    return _findings(spark, sf).unionByName(bare).withColumn("reclaim_mb", F.round("reclaim_mb", 3))


def _candidates(spark, sf):
    table = F.col("object_id")
    return _index_tables(spark, sf).filter(table >= 0).select(
        "server", "object_id", "base_data_mb", (table % 10 == 0).alias("has_columnstore"),
        (table % 60).cast("double").alias("candidacy_score"),
        (F.col("base_data_mb") * (table % 4) / 2).alias("compressed_mb"),
    )


_PUNCH_SQL = f"""{_FINDINGS_SQL}, items AS (
  SELECT server, object_id, 1 AS priority, 'rebuild ' || index_name || ' without the LOB include' AS action, reclaim_mb
  FROM found WHERE kind = 'lob_include' AND object_id % 10 <> 0
  UNION ALL SELECT server, object_id, 1, 'drop the dead nonclustered indexes', sum(reclaim_mb)
  FROM found WHERE kind = 'dead' AND object_id % 10 <> 0 GROUP BY ALL
  UNION ALL SELECT 'srv' || (object_id % 4), object_id, 2, 'plan the columnstore conversion',
    greatest(0.0, base_data_mb - base_data_mb * (object_id % 4) / 2)
  FROM base WHERE object_id % 10 <> 0 AND object_id % 60 >= 35)"""


@catalog.query(f"""
WITH {_PUNCH_SQL}
SELECT server, object_id, priority, action, round(reclaim_mb, 3) AS reclaim_mb FROM items""")
def punch_list(spark, sf):
    items = C.punch_list(_findings(spark, sf), _candidates(spark, sf))
    return items.withColumn("reclaim_mb", F.round("reclaim_mb", 3))


@catalog.query(f"""
WITH {_PUNCH_SQL}
SELECT count(*) AS actions, round(sum(reclaim_mb), 0) AS total_mb, sum(reclaim_mb) > 100 AS reported FROM items""")
def punch_total(spark, sf):
    items = C.punch_list(_findings(spark, sf), _candidates(spark, sf), ordered=False)
    return C.punch_total(items).withColumn("total_mb", F.round("total_mb", 0))
