import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablescope import flows

AS_OF = datetime.datetime(2024, 1, 31)


def test_current_state_takes_the_newest_snapshot(spark):
    settings = spark.createDataFrame(
        [("s", "max degree of parallelism", 0, 8, AS_OF - datetime.timedelta(2)), ("s", "max degree of parallelism", 0, 0, AS_OF - datetime.timedelta(1)),
         ("s", "max degree of parallelism", 0, 4, AS_OF + datetime.timedelta(1))],
        "server STRING, name STRING, value BIGINT, value_in_use BIGINT, collected_at TIMESTAMP",
    )
    report = flows.health_check({"settings": settings}, AS_OF)
    assert rows(report["findings"], "severity", "title") == [("Medium", "MAXDOP left at default (0 = unlimited)")]


def test_health_check(frame):
    databases = frame("databases", ("s", "a", "FULL", True, False, False, False, False, False), ("s", "b", "SIMPLE", True, True, False, False, False, False))
    foreign = frame("server STRING, Priority INT, Finding STRING, DatabaseName STRING", ("s", 10, "bad", "A"), ("s", 10, "BAD", "a"), ("s", 10, "bad", "b"))
    plain = frame("server STRING, n INT", ("s", 1))
    report = flows.health_check(
        {"databases": databases, "backups": frame("backups")}, AS_OF, "a", all_databases=False, foreign=[("tool", [foreign, plain])]
    )
    # Two foreign rows differ in case only: the first by text is kept.
    assert rows(report["findings"], "category", "severity", "database") == [
        ("", "Critical", "a"), ("Backups", "Critical", "a"), ("Configuration", "Medium", "a"),
    ]
    assert report["tool (2)"].count() == 1
    assert "findings" not in flows.health_check({}, AS_OF)


@pytest.fixture
def estate(frame):
    inputs = {
        "tables": frame("tables", ("s", 1, 1, "orders", False, False, False, False), ("s", 2, 1, "tiny", False, False, False, False),
                        ("s", 3, 1, "lines", False, False, False, True)),
        "table_schemas": frame("table_schemas", ("s", 1, "dbo")),
        "partition_stats": frame("partition_stats", ("s", 1, 1, 60_000_000, 1_280_000), ("s", 1, 2, 60_000_000, 2_560_000), ("s", 2, 1, 5, 1),
                                 ("s", 3, 1, 2_000_000, 128_000)),
        "index_usage": frame("index_usage", ("s", 1, 1, 1, 99, 0, 0), ("s", 1, 2, 0, 0, 0, 7)),
        "missing_index": frame("missing_index", ("s", 1)),
        "indexes": frame("indexes", ("s", 1, 1, "pk", 1, "CLUSTERED"), ("s", 1, 2, "ix", 2, "NONCLUSTERED"), ("s", 3, 0, None, 0, "HEAP")),
        "index_columns": frame("index_columns", ("s", 1, 1, "id", 1, False), ("s", 1, 2, "status", 1, False)),
        "operational_stats": frame("operational_stats", ("s", 1, 70_000, 0, 0, 5, 0, 0, 0)),
    }
    return inputs


def test_table_report(spark, frame, estate):
    facts = flows.table_facts(estate)
    assert rows(facts, "table", "row_count", "user_scans", "has_columnstore", "leaf_inserts") == [
        ("dbo.lines", 2_000_000, 0, False, 0), ("dbo.orders", 60_000_000, 99, False, 5),
    ]
    orders = spark.range(200).select("id", (F.col("id") % 2).alias("status"), F.lit(AS_OF).alias("day"))
    lines = spark.range(50).select(F.col("id"), F.lit("x").alias("text"))
    log = frame("query_log", ("s", "PlanCache", 3, 9_000, 1.0, 1.0, AS_OF, "select sum(x) from dbo.Orders group by y"))
    report = flows.table_report({"dbo.orders": orders, "dbo.lines": lines}, facts, log, estate, computed_columns=[("dbo.lines", "text")])
    best, other = report["candidates"].collect()
    # shape 2/3 of 40, 57 rowgroups, 99 % scans, index space twice the data, lock waits, one suggestion
    assert (best.table, best.candidacy_score) == ("dbo.orders", round(200 / 3 * 0.4 + 12 + 19.8 + 15 + 4 + 2, 1))
    assert best.verdict.startswith("STRONG") and best.recommendation == "convert" and best.has_aggregation
    assert best.migration_steps == ["order the data by day", "reorganize periodically"]
    assert other.recommendation == "leave" and "CDC-tracked" in other.notes
    assert rows(report["index_findings"], "object_id", "kind") == [(1, "dead"), (3, "no_index")]
    assert [(r.priority, round(r.reclaim_mb)) for r in report["punch_list"].collect()] == [(1, 20_000), (2, round(10_000 - best.compressed_mb))]
    assert report["punch_total"].first().reported
    assert rows(report["counters_reset"], "counters_reset") == [(False,)]
    assert rows(report["statements"], "table") == [("dbo.orders",)]


def test_sampled_report(spark, estate):
    facts = flows.table_facts(estate)
    big = spark.range(10_000).withColumn("v", F.col("id") % 3)
    report = flows.table_report({"dbo.orders": big}, facts, sample_target=1_000, row_counts={"dbo.orders": 10_000})
    sampled = report["columns"].first().sample_rows
    assert 700 < sampled < 1_300
    assert report["candidates"].first().sampled_rows == sampled


def test_tables_of_one_name_on_two_servers(spark, frame, estate):
    twice = lambda df: df.unionByName(df.withColumn("server", F.lit("z")))
    inputs = {name: twice(df) for name, df in estate.items()}
    facts = flows.table_facts(inputs).withColumn("has_columnstore", (F.col("server") == "z") & (F.col("table_name") == "lines"))
    constant, unique = spark.range(100).select(F.lit(1).alias("v")), spark.range(100).select(F.col("id").alias("v"))
    unread = spark.range(1).select(F.assert_true(F.lit(False)).alias("v"))
    tables = {("s", "dbo.orders"): constant, ("z", "dbo.orders"): unique, ("s", "dbo.lines"): unique, ("z", "dbo.lines"): unread}
    kept = flows.without_columnar(tables, facts)
    assert set(kept) == set(tables) - {("z", "dbo.lines")}
    report = flows.table_report(kept, facts, index_inputs=inputs, row_counts={("s", "dbo.orders"): 100, ("z", "dbo.orders"): 100}, sample_target=40)
    shown = rows(report["candidates"], "server", "table", "pct_medium", "notes")
    assert [(s, t, p > 0) for s, t, p, _ in shown] == [
        ("s", "dbo.lines", False), ("s", "dbo.orders", True), ("z", "dbo.lines", False), ("z", "dbo.orders", False),
    ]
    assert shown[2][3] == "Already has a columnstore index" and "columnstore index" not in shown[0][3]
    assert rows(report["columns"], "server", "table", "sample_percent") == [("s", "dbo.lines", None), ("s", "dbo.orders", 40.0), ("z", "dbo.orders", 40.0)]
    assert rows(report["portfolio"], "already_columnar") == [(1,)]
    assert report["digests"].count() == 4 and report["dead_indexes"].count() == 2
    with pytest.raises(ValueError):
        flows.table_report({"dbo.orders": constant, ("s", "dbo.orders"): constant}, facts)


def test_statement_evidence(spark, frame):
    stats = frame("statement_stats", ("s", "x", "h", 1, 2, 3000, 4000, AS_OF, 0, -1)).drop("source")
    inputs = {
        "statement_stats": stats, "batch_texts": frame("batch_texts", ("s", "h", "select a")),
        "query_log": frame("query_log", ("s", "QueryStore", 1, 9, 1.0, 1.0, AS_OF, "select b"), ("z", "QueryStore", 1, 9, 1.0, 1.0, AS_OF, "select c")),
        "log_status": frame("log_status", ("s", "READ_ONLY", 65536, 5, 10), ("z", "READ_ONLY", 1, 5, 10), ("y", "OFF", 0, 5, 10)),
    }
    log, said = flows.statement_evidence(inputs)
    assert rows(log, "server", "source", "statement_text") == [("s", "PlanCache", "select a"), ("z", "QueryStore", "select c")]
    assert rows(said, "server", "severity", "object") == [("s", "Low", "QueryStore")]
    assert flows.statement_evidence({}) == (None, None)


def test_access_audit(frame):
    from test_access import catalog, logins, users

    grants, principals, objects, schemas, columns = catalog(frame)
    audit = flows.access_audit(
        {"principals": logins(frame), "server_role_members": frame("server_role_members", ("s", 1, 3)), "db_principals": principals.unionByName(users(frame)),
         "db_role_members": frame("db_role_members", ("s", "db", 7, 0)), "db_permissions": grants, "objects": objects, "db_schemas": schemas, "columns": columns}
    )
    assert audit["grants"].count() == 7
    assert rows(audit["grant_groups"], "class_desc", "target_count") == [("DATABASE", 1), ("OBJECT_OR_COLUMN", 3), ("SCHEMA", 2)]
    assert rows(audit["by_database"]) == [("s", "d1", 4, 2, 0), ("s", "d2", 1, 0, 0), ("s", "db", 1, 1, 7)]
    assert rows(audit["user_roles"].filter("size(roles) > 0"), "name", "roles") == [("app", ["public"])]
    assert audit["summary"].first().orphans == 3 and audit["findings"].filter("severity = 'Low'").count() == 3
