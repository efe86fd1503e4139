import datetime

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from tablescope.functions.constants import SKIP_COMPUTED, SKIP_LOB
from tablescope.operators import profile as P
from tablescope.operators import shape as S


def profile_of(df, **options):
    return {r["column"]: r for r in P.profile_columns({"t": df}, **options).collect()}


def test_nulls_and_all_null_column(frame):
    df = frame("a INT, b STRING, c STRING", (1, "x", None), (1, None, None), (2, "xyz", None))
    got = profile_of(df)
    assert (got["a"].distinct_values, got["a"].null_count, got["a"].avg_byte_length) == (2, 0, 4.0)
    assert (got["b"].distinct_values, got["b"].null_count, got["b"].avg_byte_length) == (2, 1, 2.0)
    empty = got["c"]
    assert (empty.distinct_values, empty.null_count, empty.avg_byte_length) == (0, 3, 0.0)
    assert (empty.distinct_ratio, empty.duplication_factor, empty.verdict) == (0.0, 0.0, "NEUTRAL")


def test_all_null_column_counts_as_repetitive(frame):
    df = frame("a INT, c STRING", *[(i, None) for i in range(10)])
    shape = S.table_shape(P.profile_columns({"t": df})).first()
    assert shape.pct_low == 50.0


def test_float_zero_and_nan(frame):
    df = frame("d DOUBLE", (0.0,), (-0.0,), (float("nan"),), (float("nan"),), (1.5,))
    assert profile_of(df)["d"].distinct_values == 3


def test_every_scalar_type(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
        (true, 1Y, 2S, 3, 4L, 1.5F, 2.5D, 1.25, DATE'2024-01-01', TIMESTAMP'2024-01-01 00:00:00',
         TIMESTAMP_NTZ'2024-01-01 00:00:00', 'x', INTERVAL '1' DAY, CAST(1 AS DECIMAL(30,2))),
        (true, 1Y, 2S, 3, 5L, 1.5F, 2.5D, 1.25, DATE'2024-01-02', TIMESTAMP'2024-01-01 00:00:01',
         TIMESTAMP_NTZ'2024-01-01 00:00:00.000001', 'x', INTERVAL '2' DAY, CAST(2 AS DECIMAL(30,2)))
        AS t(bo, ti, sm, i, l, f, d, de, da, ts, tn, s, iv, big)""")
    got = profile_of(df)
    assert {c: r.distinct_values for c, r in got.items()} == dict(
        bo=1, ti=1, sm=1, i=1, l=2, f=1, d=1, de=1, da=2, ts=2, tn=2, s=1, iv=2, big=2
    )
    assert {c: r.avg_byte_length for c, r in got.items()} == dict(
        bo=1, ti=1, sm=2, i=4, l=8, f=4, d=8, de=8, da=4, ts=8, tn=8, s=1, iv=8, big=16
    )


def test_case_insensitive_is_an_option(frame):
    df = frame("s STRING", ("a",), ("A",), ("b",))
    assert profile_of(df)["s"].distinct_values == 3
    assert profile_of(df, case_insensitive=True)["s"].distinct_values == 2


def test_long_text_is_told_apart_at_its_end(frame):
    long = "é" * 5000
    df = frame("s STRING", (long + "1",), (long + "2",), (long + "2",), ("short",), (None,))
    got = profile_of(df)["s"]
    assert (got.distinct_values, got.null_count) == (3, 1)
    assert got.avg_byte_length == (3 * 10001 + 5) / 4


def test_text_that_looks_like_a_digest(frame):
    import hashlib

    long = "x" * 100
    digest = hashlib.sha256(long.encode()).hexdigest()
    df = frame("s STRING", (long,), (digest,))
    assert profile_of(df)["s"].distinct_values == 2


def test_skipped_columns(frame):
    df = frame("a INT, arr ARRAY<INT>, m MAP<STRING,INT>, b BINARY, c INT", (1, [1], {"x": 1}, b"1", 3))
    got = profile_of(df, computed_columns=[("t", "c"), ("t", "arr")], lob_columns=[("t", "a")])
    assert {c: (r.analyzed, r.verdict) for c, r in got.items()} == {
        "a": (False, SKIP_LOB), "arr": (False, SKIP_LOB), "m": (False, SKIP_LOB), "b": (False, SKIP_LOB),
        "c": (False, SKIP_COMPUTED),
    }


def test_lob_columns_count_even_if_nothing_is_measured(frame):
    shape = S.table_shape(P.profile_columns({"t": frame("b BINARY", (b"1",))})).first()
    assert (shape.lob_columns, shape.analyzed_columns, shape.pct_low, shape.median_duplication_factor) == (1, 0, 0, 0)


def test_empty_table(frame):
    got = profile_of(frame("a INT, s STRING"))
    assert not got["a"].analyzed and got["s"].sample_rows == 0


def test_awkward_column_names(frame):
    df = frame("`a b` INT, `c.d` STRING, `e``f` INT, `table` INT", (1, "x", 2, 3))
    assert set(profile_of(df)) == {"a b", "c.d", "e`f", "table"}


def test_verdict_limits(spark):
    rated = spark.createDataFrame(
        [(10.0, 0.1, False, "GOOD"), (100.0, 0.01, False, "EXCELLENT"), (9.99, 0.9, False, "NEUTRAL"),
         (1.0, 0.91, False, "POOR"), (1.0, 1.0, True, "BAD")],
        "duplication_factor DOUBLE, distinct_ratio DOUBLE, dictionary_pressure BOOLEAN, want STRING",
    ).selectExpr("*", "true AS analyzed", "'' AS skip_reason")
    for r in rated.withColumn("verdict", P.column_verdict()).collect():
        assert r.verdict.startswith(r.want)


def test_pressure_limits_are_strict(frame):
    # Ratio exactly 0.5, then length exactly 16: neither is under pressure.
    half = frame("s STRING", *[(f"{i // 2:020d}",) for i in range(8)])
    sixteen = frame("s STRING", *[(f"{i:016d}",) for i in range(8)])
    wide = frame("s STRING", *[(f"{i:017d}",) for i in range(8)])
    assert [profile_of(d)["s"].dictionary_pressure for d in (half, sixteen, wide)] == [False, False, True]


def test_median_is_the_upper_middle(spark):
    profile = spark.createDataFrame(
        [("t", i, float(i)) for i in (1, 2, 3, 4)], "table STRING, ordinal INT, duplication_factor DOUBLE"
    ).selectExpr(
        "*", "true AS analyzed", "1L AS sample_rows", "0.5D AS distinct_ratio", "false AS dictionary_pressure",
        "false AS is_lob", "false AS is_computed", "false AS is_date", "4.0D AS avg_byte_length", "'c' AS column",
    )
    assert S.table_shape(profile).first().median_duplication_factor == 3.0


def test_approx_keeps_the_exact_counts(frame):
    df = frame("a INT, s STRING", *[(i % 7, f"v{i % 5}" if i % 3 else None) for i in range(90)])
    exact, approx = profile_of(df), profile_of(df, approx=True)
    for c in ("a", "s"):
        assert exact[c].null_count == approx[c].null_count
        assert exact[c].avg_byte_length == approx[c].avg_byte_length
        assert exact[c].distinct_values == approx[c].distinct_values


def test_batches_do_not_change_the_result(frame):
    df = frame("a INT, b BIGINT, c INT, d STRING, e STRING", *[(i, i % 3, 1, str(i % 2), None) for i in range(20)])
    whole = rows(P.profile_columns({"t": df}))
    assert rows(P.profile_columns({"t": df}, batch_size=1)) == whole
    assert rows(P.profile_columns({"t": df}, batch_size=2)) == whole


@pytest.mark.parametrize("partitions", [1, 8])
def test_partitions_do_not_change_the_result(spark, frame, partitions):
    df = frame("a INT, s STRING", *[(i % 11, str(i % 4)) for i in range(100)]).repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = profile_of(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert (got["a"].distinct_values, got["s"].distinct_values, got["s"].sample_rows) == (11, 4, 100)


def test_each_scan_reads_only_its_columns(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = final_plan(P.profile_columns({"orders": orders}))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "ReadSchema: struct<o_totalprice:double>" in plan
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan
    assert "Expand" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sampling():
    assert P.sample_percent(2_000_000) is None
    assert P.sample_percent(2_000_001) == 50.0
    assert P.sample_percent(3_000_000) == 33.3333
    assert P.sample_percent(10**10) == 0.1


def test_row_sample_repeats(spark):
    df = spark.range(10_000)
    first, again = (P.sample_table(df, 10_000, target=1000).count() for _ in range(2))
    assert first == again and 700 < first < 1300
    assert P.sample_table(df, 10_000, target=5000) is df


def test_highlights_and_jackpot(frame):
    wide = "w" * 40
    df = frame(
        "k INT, s STRING, d DATE, x INT",
        *[(i, wide if i % 2 else wide + "2", datetime.date(2024, 1, 1 + i % 3), i % 20) for i in range(400)],
    )
    profile = P.profile_columns({"t": df})
    high = S.shape_highlights(profile).first()
    assert (high.star_columns, high.good_columns, high.near_unique_columns) == (["s", "d"], 1, ["k"])
    sizes = profile.sparkSession.createDataFrame([("t", 1_000_000, 100.0)], "table STRING, row_count BIGINT, base_data_mb DOUBLE")
    jackpot = S.jackpot_column(profile, sizes).first()
    assert (jackpot.column, jackpot.distinct_values) == ("s", 2)
    assert jackpot.payload_mb == 40.5 * 1_000_000 / 1024 / 1024
    assert S.clustering_column(profile).first().clustering_column == S.table_shape(profile).first().clustering_column == "d"
    assert [r.column for r in S.top_columns(profile, top=2).orderBy("rank").collect()] == ["s", "d"]
    estimate = S.compressed_estimate(S.table_shape(profile), sizes).first()
    assert estimate.compressed_mb == pytest.approx((40.5 * 0.05 + 4 * 0.05 + 4 * 0.15 + 4 * 0.5) * 1e6 / 2**20)
    assert estimate.worth_reporting


def test_hot_value_and_hot_copies(spark):
    """A third of the rows share one key and one long text."""
    df = spark.range(30_000, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.repeat(F.lit("copy "), F.lit(200))).otherwise(F.col("id").cast("string")).alias("s"),
    )
    got = profile_of(df)
    assert got["k"].distinct_values == got["s"].distinct_values == 20_001


def test_byte_length(spark):
    from tablescope.functions.widths import byte_length

    df = spark.sql("SELECT * FROM VALUES ('é', 1, DATE'2024-01-01', 1.5, array(1)), (NULL, NULL, NULL, NULL, NULL) AS t(s, i, d, n, a)")
    sized = df.select(*[byte_length(F.col(f.name), f.dataType) for f in df.schema])
    assert [tuple(r) for r in sized.collect()] == [(2, 4, 4, 8, None), (None,) * 5]


def test_file_sample_opens_only_the_drawn_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(4_000, numPartitions=100).write.parquet(path)
    table = spark.read.parquet(path)
    sample = P.sample_table(table, 4_000, target=1_000, by_file=True)
    assert sample.columns == ["id"]
    drawn = {r[0].rsplit("/", 1)[1] for r in sample.select("_metadata.file_path").distinct().collect()}
    assert 10 < len(drawn) < 45 and sample.count() == len(drawn) * 40
    assert rows(sample) == rows(P.sample_table(spark.read.parquet(path), 4_000, target=1_000, by_file=True))
    # The other files are never opened: breaking them goes unnoticed.
    for file in (tmp_path / "many").glob("part-*"):
        if file.name not in drawn:
            file.write_bytes(b"broken")
    assert profile_of(sample)["id"].distinct_values == len(drawn) * 40
