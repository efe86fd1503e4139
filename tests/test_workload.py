import datetime
import random

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from tablescope.operators import workload as L

WHEN = datetime.datetime(2024, 1, 1)
LOG = "server STRING, source STRING, execution_count BIGINT, total_logical_reads BIGINT, total_cpu_ms DOUBLE," \
      " total_elapsed_ms DOUBLE, last_execution_time TIMESTAMP, statement_text STRING"
NAMES = "server STRING, table STRING, name STRING"
# Names are joined by a broadcast, or, where they are many, by a shuffle.
JOINS = ["spark", "shuffled_joins"]


def log(spark, *statements, source="PlanCache"):
    rows_ = [("s", source, 1, reads, 1.0, 1.0, WHEN, text) for reads, text in statements]
    return spark.createDataFrame(rows_, LOG)


def names(spark, *values):
    return spark.createDataFrame([("s", v, v) for v in values], NAMES)


@pytest.mark.parametrize("joins", JOINS)
def test_names_are_literal_and_case_insensitive(spark, request, joins):
    request.getfixturevalue(joins)
    entries = log(
        spark, (1, "select * from A_B"), (2, "select * from axb"), (3, "from OrdersArchive"), (4, "from orders"),
        (5, "SELECT COUNT_BIG(*) AS __ROWS from orders"), (6, "100%"), (7, "a"),
    )
    matched = L.match_statements(entries, names(spark, "a_b", "Orders", "OrdersArchive", "0%", "x", ""))
    assert rows(matched, "table", "total_logical_reads") == [
        ("0%", 6), ("Orders", 3), ("Orders", 4), ("OrdersArchive", 3), ("a_b", 1), ("x", 2),
    ]


@pytest.mark.parametrize("joins", JOINS)
def test_match_equals_brute_force(spark, request, joins):
    request.getfixturevalue(joins)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcé_%.\n") for _ in range(n))
    texts = [word(rng.randint(0, 60)) for _ in range(300)]
    wanted = sorted({word(rng.randint(1, 12)) for _ in range(40)})
    expected = sorted((w, i) for w in wanted for i, t in enumerate(texts) if w.lower() in t.lower())
    matched = L.match_statements(log(spark, *enumerate(texts)), names(spark, *wanted), top=1000)
    assert rows(matched, "table", "total_logical_reads") == sorted(expected, key=repr)


def test_top_k_is_per_source(spark):
    entries = log(spark, *[(i, f"from t {i}") for i in range(30)]).unionByName(
        log(spark, *[(i, f"from t {i}") for i in range(30)], source="QueryStore")
    )
    matched = L.match_statements(entries, names(spark, "t"))
    assert matched.count() == 40
    assert matched.agg(F.min("total_logical_reads")).first()[0] == 10


def test_only_the_servers_own_names_match(spark):
    other = spark.createDataFrame([("z", "t", "t")], NAMES)
    assert L.match_statements(log(spark, (1, "from t")), other).count() == 0


def test_match_plan(spark):
    entries = spark.range(100, numPartitions=4).select(
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("server"), F.lit("P").alias("source"),
        F.lit(1).alias("execution_count"), F.col("id").alias("total_logical_reads"), F.lit(WHEN).alias("last_execution_time"),
        F.concat(F.lit("from t"), F.col("id").cast("string")).alias("statement_text"),
    )
    matched = L.match_statements(entries, spark.createDataFrame([("s0", n, n) for n in ("t1", "t2", "t3")], NAMES))
    plan = final_plan(matched)
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _exchanged(df):
    """Columns of every exchange that is fed by a read of the log, lowest first."""
    found = []

    def walk(node, inside):
        name = node.nodeName()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if name == "Exchange" and "statement_text" in node.toString():
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        for child in below:
            walk(child, inside)

    walk(df._jdf.queryExecution().sparkPlan(), False)
    walk(df._jdf.queryExecution().executedPlan().initialPlan(), False)
    return found


def test_runs_and_ids_are_shuffled_without_text(shuffled_joins):
    entries = log(shuffled_joins, *[(i, f"select a{i} from orders") for i in range(50)])
    matched = L.match_statements(entries, names(shuffled_joins, "orders", "select a7", "nothing"))
    assert matched.count() == 21
    sides = [c for c in _exchanged(matched) if "_run" in c]
    assert {"server", "_run", "_statement"} in sides and not any(c & {"_text", "statement_text"} for c in sides)


def test_rarest_run_is_the_key(spark):
    entries = log(spark, *[(i, f"select * from sales_{i % 10}") for i in range(100)])
    text = entries.withColumn("_text", F.lower("statement_text")).withColumn("_statement", F.xxhash64("_text"))
    wanted = L._name_runs(names(spark, "sales_7", "sales", "sales_x", "ab"))
    listed = L._statement_runs(text, wanted)
    keys = L._rarest_runs(wanted, listed).withColumn("_run", F.col("_run").cast("string"))
    assert rows(keys, "_name", "_run") == [("sales", "ales"), ("sales_7", "es_7")]
    assert listed.filter(F.col("_run").cast("string") == "es_7").count() == 10


def test_classes(spark):
    cases = {
        "  \n insert into t select count(*) from x": (True, False, False, False),
        "select a from t group by a": (False, True, False, False),
        "SELECT COUNT_BIG(*) FROM t": (False, False, False, False),
        "select count(*) from t": (False, True, False, False),
        "delete from t where sum(x) > 1": (False, False, False, False),
        "SELECT COUNT_BIG(DISTINCT a) as x": (False, False, True, False),
        "select avg(a) from openjson(x)": (False, True, False, True),
    }
    df = spark.createDataFrame([(t,) for t in cases], "statement_text STRING")
    got = {r[0]: tuple(r[1:]) for r in L.classify(df).collect()}
    assert got == cases
    assert L.classify(spark.createDataFrame([(None,)], "statement_text STRING")).first()[1:] == (False,) * 4


def heaviest(spark, *statements):
    matched = L.match_statements(log(spark, *statements), names(spark, "t"))
    return L.heaviest_statement(matched).first()


def test_heaviest(spark):
    insert, plain, agg = "insert into t", "select * from t", "select sum(a) from t"
    assert heaviest(spark, (100_001, agg), (900_000, plain)).kind == "aggregation"
    r = heaviest(spark, (100_000, agg), (900_000, plain))
    assert (r.kind, r.reads, r.reads_per_execution, r.has_aggregation) == ("heaviest", 900_000, 900_000.0, True)
    assert heaviest(spark, (10, insert), (20, insert)).kind == "insert_only"
    assert heaviest(spark, (10, insert), (20, plain)).kind == "none"
    # The profiler's own statements are no evidence.
    assert heaviest(spark, (900_000, "select COUNT_BIG(DISTINCT a) from t"), (1, insert)).kind == "insert_only"


def test_statement_slice(spark):
    stats = spark.createDataFrame(
        [("s", "h", 1, 5, 2000, 3000, WHEN, *offsets) for offsets in [(0, -1), (14, -1), (0, 10), (14, 24)]]
        + [("s", "gone", 1, 5, 0, 0, WHEN, 0, -1), ("s", "null", 1, 5, 0, 0, WHEN, 0, -1)],
        "server STRING, handle STRING, execution_count BIGINT, total_logical_reads BIGINT, total_worker_us BIGINT,"
        " total_elapsed_us BIGINT, last_execution_time TIMESTAMP, start_offset INT, end_offset INT",
    )
    texts = spark.createDataFrame([("s", "h", "begin; select"), ("s", "null", None)], "server STRING, handle STRING, text STRING")
    log_ = L.cached_statements(stats, texts)
    assert rows(log_, "statement_text") == [("begin; select",), ("begin;",), ("select",), ("select",)]
    assert log_.first().total_cpu_ms == 2.0


def test_interval_totals(spark):
    s = lambda ddl, *r: spark.createDataFrame([("s", *x) for x in r], "server STRING, " + ddl)
    runtime = s(
        "plan_id INT, interval_id INT, count_executions BIGINT, avg_logical_io_reads DOUBLE, avg_cpu_time DOUBLE, avg_duration DOUBLE",
        (1, 1, 2, 10.0, 1000.0, 5.0), (1, 2, 1, 4.0, 500.0, 5.0), (2, 1, 1, 7.0, 100.0, 5.0), (3, 1, 9, 1.0, 1.0, 1.0),
        (9, 1, 1, 1.0, 1.0, 1.0), (1, 7, 1, 1.0, 1.0, 1.0),
    )
    intervals = s("interval_id INT, end_time TIMESTAMP", (1, WHEN), (2, WHEN + datetime.timedelta(1)))
    plans = s("plan_id INT, query_id INT", (1, 1), (2, 2), (3, 3))
    ids = s("query_id INT, text_id INT", (1, 1), (2, 1), (3, 2))
    texts = s("text_id INT, query_text STRING", (1, "a"), (2, "b"))
    got = L.interval_totals(runtime, intervals, plans, ids, texts)
    assert rows(got, "statement_text", "execution_count", "total_logical_reads", "total_cpu_ms", "last_execution_time") == [
        ("a", 4, 31, 2.6, WHEN + datetime.timedelta(1)), ("b", 9, 9, 0.009, WHEN),
    ]
    assert rows(L.interval_totals(runtime, intervals, plans, ids, texts, top_n=1), "statement_text") == [("a",)]


def test_source_gate(spark):
    status = spark.createDataFrame(
        [("s", n, state, reason, 1500, 2000) for n, state, reason in
         [("off", "OFF", 0), ("full", "READ_ONLY", 65536), ("many", "READ_ONLY", 131072 | 8), ("disk", "READ_ONLY", 524288),
          ("chosen", "READ_ONLY", 8), ("on", "READ_WRITE", 65536)]],
        "server STRING, source STRING, actual_state STRING, readonly_reason INT, current_mb BIGINT, max_mb BIGINT",
    )
    gated = L.source_gate(status)
    assert {r.source: (r.usable, r.caveat is not None) for r in gated.collect()} == {
        "off": (False, False), "full": (False, True), "many": (False, True), "disk": (False, True),
        "chosen": (True, False), "on": (True, False),
    }
    assert "1,500 of 2,000 MB" in gated.filter("source = 'full'").first().caveat
    kept = L.trusted_statements(spark.createDataFrame([("s", x) for x in ("off", "on", "other")], "server STRING, source STRING"), gated)
    assert rows(kept, "source") == [("on",), ("other",)]


def test_flags_and_reset(spark):
    columns = "server STRING, user_seeks INT, user_scans INT, user_lookups INT, user_updates INT, leaf_inserts INT," \
              " leaf_updates INT, leaf_deletes INT, page_io_latch_wait_ms INT"
    flags = L.workload_flags(spark.createDataFrame(
        [("a", 1, 0, 100_001, 0, 5, 0, 0, 10_001), ("b", 1, 0, 100_000, 0, 3, 1, 1, 10_000), ("c", 0, 0, 0, 0, 5, 0, 0, 99_999)], columns))
    shown = ["server", "is_used", "append_only_writes", "update_heavy", "uncovered_lookups", "io_bound"]
    assert rows(flags, *shown) == [
        ("a", True, True, False, True, True), ("b", True, False, True, False, False), ("c", False, False, False, False, False),
    ]
    matched = spark.createDataFrame([("c",), ("a",)], "server STRING")
    reset = L.counters_reset(flags, matched)
    assert rows(reset, "server", "counters_reset") == [("a", False), ("b", False), ("c", True)]
