"""States that later days are merged into, growth of counters, and estimates from samples."""

import datetime
import random

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from tablescope.operators import estimate as E
from tablescope.operators import states as S


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_merged_profile(spark):
    df = spark.createDataFrame([(i % 7, None if i % 5 == 0 else f"v{i % 40}", 0.0 if i % 2 else -0.0) for i in range(400)], "d INT, t STRING, f DOUBLE")
    merged = S.merged_profile(S.profile_states(df, "x", F.col("d")))
    got = {r.column: (r.rows, r.non_null, r.distinct, round(r.avg_bytes, 3)) for r in merged.collect()}
    assert got["t"] == (400, 320, 32, round(sum(len(f"v{i % 40}") for i in range(400) if i % 5) / 320, 3))
    assert got["f"] == (400, 400, 1, 8.0) and got["d"] == (400, 400, 7, 4.0)


def test_states_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "d INT, t STRING")
    (r,) = S.merged_profile(S.profile_states(df, "x", F.col("d"), ["t"])).collect()
    assert (r.rows, r.non_null, r.distinct, r.avg_bytes, r.duplication_factor) == (2, 0, 0, 0.0, 0.0)
    assert S.merged_profile(S.profile_states(df.limit(0), "x", F.col("d"))).count() == 0


@pytest.fixture
def history(spark, tmp_path):
    """A history partitioned by day."""
    r = random.Random(3)
    some = [(r.randrange(30), r.choice(["D", "L"]), day(d) + datetime.timedelta(hours=r.randrange(24)), i, d) for i, d in enumerate([r.randrange(30) for _ in range(600)])]
    some += [(None, "D", day(2), 900, 2), (3, "L", None, 901, 5)]
    df = spark.createDataFrame(some, "entity INT, kind STRING, at TIMESTAMP, id INT, day INT")
    df.write.partitionBy("day").parquet(f"{tmp_path}/history")
    return spark.read.parquet(f"{tmp_path}/history")


def test_newest_in_steps_equals_one_read(history):
    whole = S.newest_states(history, ["entity"], "at", ["kind", "id"], as_of=F.lit(day(25)))
    state = S.newest_states(history, ["entity"], "at", ["kind", "id"], as_of=F.lit(day(9)))
    for mark, as_of in ((9, 10), (10, 25)):
        state = S.advanced(state, history, ["entity"], "at", F.lit(day(mark)), F.lit(day(as_of)))
    assert rows(state) == rows(whole) and whole.count() == 31


def test_recency_in_steps_equals_one_read(history):
    whole = S.recency_states(history, ["entity"], "kind", "at", ["D", "L"], as_of=F.lit(day(25)))
    state = S.recency_states(history, ["entity"], "kind", "at", ["D", "L"], as_of=F.lit(day(9)))
    state = S.advanced_recency(state, history, ["entity"], "kind", "at", ["D", "L"], F.lit(day(9)), F.lit(day(25)))
    assert rows(state) == rows(whole)


def test_a_step_reads_the_later_days_alone(spark, history, tmp_path):
    S.newest_states(history, ["entity"], "at", ["kind", "id"], as_of=F.lit(day(9))).write.parquet(f"{tmp_path}/state")
    later = history.filter("day >= 9")
    step = S.advanced(spark.read.parquet(f"{tmp_path}/state"), later, ["entity"], "at", F.lit(day(9)), F.lit(day(25)))
    assert "PartitionFilters: [isnotnull(day" in final_plan(step).replace("\n", "")


SNAPSHOTS = "server STRING, object_id INT, at INT, seeks BIGINT"


def test_counters_restart(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, 10), ("a", 1, 2, 15), ("a", 1, 3, 4), ("a", 1, 4, 9), ("a", 2, 1, 1), ("a", 2, 2, 1), ("a", 2, 3, 5), ("a", 2, 4, 5), ("b", 1, 1, 7), ("b", 1, 3, 9), ("a", 3, 3, 2), ("a", 4, 4, 8)],
        SNAPSHOTS,
    )
    steps = S.counter_steps(df, ["server", "object_id"], "at", ["seeks"])
    assert not steps.filter("seeks_grown < 0").count()
    # object 2 of server a shows more than before at 3, but the server had restarted: all 5 are new
    assert rows(S.growth(steps, ["server", "object_id"], ["seeks"])) == [("a", 1, 14, 1), ("a", 2, 5, 1), ("a", 3, 2, 1), ("a", 4, 0, 0), ("b", 1, 2, 0)]


def test_bounds_hold_the_exact_number(spark):
    r = random.Random(5)
    data = [(i, r.randrange(300), int(r.paretovariate(0.7)) % 5000, i // 20, None) for i in range(12_000)]
    df = spark.createDataFrame(data, "id INT, few INT, skewed INT, cluster INT, nothing INT")
    exact = {r.column: r.seen for r in E.value_units(df, "t").collect()}
    assert exact == {"id": 12_000, "few": 300, "skewed": len({d[2] for d in data}), "cluster": 600}
    for unit, taken in ((None, F.pmod(F.xxhash64("id"), F.lit(10)) == 0), (F.col("cluster"), F.pmod(F.xxhash64("cluster"), F.lit(10)) == 0)):
        sample = df.filter(taken)
        number = F.count("*") if unit is None else F.count_distinct("cluster")
        sizes = sample.agg(F.lit("t").alias("table"), number.alias("sampled"), F.lit(12_000 if unit is None else 600).alias("total"))
        found = E.distinct_bounds(E.value_units(sample, "t", unit), sizes).collect()
        assert {r.column for r in found} == set(exact)
        for r in found:
            assert r.at_least <= exact[r.column] <= r.at_most and r.at_least <= r.estimate <= r.at_most


def test_whole_table_is_exact(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") % 3).alias("k"))
    sizes = spark.createDataFrame([("t", 50, 50)], "table STRING, sampled BIGINT, total BIGINT")
    assert {(r.column, r.at_least, r.estimate, r.at_most) for r in E.distinct_bounds(E.value_units(df, "t"), sizes).collect()} == {("id", 50, 50.0, 50), ("k", 3, 3.0, 3)}
