"""Expected prefixes by the thousand, findings over several runs, inventories with rows that do not fit."""

import datetime
import json
import random

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from tablescope import flows
from tablescope.operators import findings as N
from tablescope.operators import oplog as O
from tablescope.sources.tables import quarantine, read_quarantined


def test_prefixes_equal_brute_force(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abÉß_%") for _ in range(n))
    names = sorted({word(r.randrange(0, 7)) for _ in range(200)})
    prefixes = sorted({word(r.randrange(0, 5)) for _ in range(80)} | {"", "zzz", "toolongforanyname"})
    got = O.prefix_coverage(spark.createDataFrame([(n,) for n in names] + [(None,)], "name STRING"), "name", spark.createDataFrame([(p,) for p in [*prefixes, None]], "expected_prefix STRING"))
    want = [(p, n, True) for p in prefixes for n in names if n.lower().startswith(p.lower())]
    want += [(p, None, False) for p in prefixes if not any(n.lower().startswith(p.lower()) for n in names)]
    assert rows(got, "expected_prefix", "name", "found") == sorted(want, key=repr)


def test_prefixes_per_key(shuffled_joins):
    spark = shuffled_joins
    jobs = spark.createDataFrame([("a", "Backup - full"), ("a", "backup - log"), ("b", "Cleanup")], "server STRING, name STRING")
    expected = spark.createDataFrame([("a", "BACKUP"), ("b", "BACKUP"), ("b", "clean"), ("c", "x")], "server STRING, expected_prefix STRING")
    got = O.prefix_coverage(jobs, "name", expected, ["server"])
    assert rows(got, "server", "expected_prefix", "name", "found") == sorted(
        [("a", "BACKUP", "Backup - full", True), ("a", "BACKUP", "backup - log", True), ("b", "BACKUP", None, False), ("b", "clean", "Cleanup", True), ("c", "x", None, False)], key=repr
    )
    assert "NestedLoop" not in final_plan(got) and "Cartesian" not in final_plan(got)


FOUND = "id INT, title STRING, database STRING"


def test_findings_are_remembered(spark):
    make = lambda *values: spark.createDataFrame(list(values), FOUND)
    fields = ["title", "database"]
    store = N.remember(None, make((2, "A", None), (1, "a", ""), (3, "b", "x")), F.lit(1), ["id"], fields)
    assert rows(store, "id", "first_seen", "last_seen") == [(1, 1, 1), (3, 1, 1)]
    store = N.remember(store, make((9, "A", None), (8, "c", "x"), (7, "C", "X")), F.lit(2), ["id"], fields)
    assert rows(store, "id", "title", "first_seen", "last_seen") == [(1, "a", 1, 2), (3, "b", 1, 1), (7, "C", 2, 2)]
    late = N.remember(store, make((5, "B", "X")), F.lit(0), ["id"], fields)  # a run that comes in late
    assert rows(late, "id", "first_seen", "last_seen") == [(1, 1, 2), (3, 1, 1), (7, 2, 2)]
    assert rows(N.remember(store, make(), F.lit(3), ["id"], fields), "id") == [(1,), (3,), (7,)]


def test_same_finding_of_two_databases_is_two(spark):
    some = spark.createDataFrame([(1, "t", "a"), (2, "t", "b")], FOUND)
    assert N.remember(None, some, F.lit(1), ["id"], ["title", "database"]).count() == 2


def test_known_findings_are_joined_before_the_rank(spark):
    some = spark.createDataFrame([(1, "t", "a")], FOUND)
    plan = N.remember(N.remember(None, some, F.lit(1), ["id"], ["title"]), some, F.lit(2), ["id"], ["title"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftAnti") if "LeftAnti" in plan[plan.index("Window") :] else "LeftAnti" in plan


JOBS = [
    ("s", "1", "nightly", "true", "0A"),
    ("s", "2", "weekly", "maybe", None),
    ("s", None, "nameless", "false", None),
    (" ", "3", "x", "not", "zz"),
    ("s", "4", "one", "true", None),
    ("s", "4", "two", "true", None),
    ("t", "5", "same", "false", None),
    ("t", "5", "same", "false", None),
]


def test_quarantine(spark):
    raw = spark.createDataFrame([(*j, "extra") for j in JOBS], "server STRING, job_id STRING, name STRING, enabled STRING, owner_sid STRING, more STRING")
    accepted, rejected = quarantine(raw, "jobs", ["server", "job_id"])
    assert rows(accepted, "server", "job_id", "name", "enabled") == [("s", "1", "nightly", True), ("t", "5", "same", False)]
    assert bytes(accepted.filter("job_id = '1'").first().owner_sid) == b"\n"
    got = sorted((r.reasons, json.loads(r.row).get("name")) for r in rejected.collect())
    assert got == sorted(
        [("bad type: enabled", "weekly"), ("missing key: job_id", "nameless"), ("bad type: enabled; bad type: owner_sid; missing key: server", "x"), ("clashing key", "one"), ("clashing key", "two")]
    )


def test_quarantine_of_nothing_and_missing_columns(spark):
    accepted, rejected = quarantine(spark.createDataFrame([("s",)], "server STRING"), "missing_index", ["server"])
    assert rows(accepted) == [("s", None)] and rejected.count() == 0
    accepted, rejected = quarantine(spark.createDataFrame([], "server STRING"), "missing_index", ["server"])
    assert accepted.count() == rejected.count() == 0


def test_files_feed_the_health_check(spark, tmp_path):
    (tmp_path / "runs.csv").write_text("s,1,0,0,2024-01-30 10:00:00,broke\ns,1,0,bad,2024-01-30 11:00:00,x\ns,2,0,1,2024-01-30 09:00:00,fine\n")
    (tmp_path / "jobs.json").write_text('{"server":"s","job_id":"1","name":"nightly","enabled":"true"}\n{"server":"s","job_id":"2","name":"other","enabled":"true"}\n')
    runs, bad = read_quarantined(spark, "job_runs", f"{tmp_path}/runs.csv", ["server", "job_id"])
    assert rows(bad, "reasons") == [("bad type: run_status",)]
    jobs, none = read_quarantined(spark, "jobs", f"{tmp_path}/jobs.json", ["server", "job_id"], "json")
    assert none.count() == 0
    found = flows.health_check({"jobs": jobs, "job_runs": runs}, as_of=datetime.datetime(2024, 1, 31))["findings"]
    assert [t for (t,) in rows(found.filter("title LIKE 'Agent job failed%'"), "title")] == ["Agent job failed: nightly"]


@pytest.mark.parametrize("name", ["prefix_coverage", "findings_over_runs", "quarantined_rows", "merged_profile", "counter_growth", "newest_in_steps"])
def test_without_broadcasts(shuffled_joins, name):
    from oracle import connect, difference

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    assert difference(entry.queries()[name](shuffled_joins, sf), connect(sf), entry.oracle_sql()[name]) is None
