import datetime
import json

from pyspark.sql import functions as F

from tablescope.operators import profile as P
from tablescope.sources import sinks
from tablescope.sources.schemas import SCHEMAS
from tablescope.sources.tables import read_inventory, read_tables


def test_csv(spark, tmp_path):
    df = spark.createDataFrame(
        [("a,b", 'say "hi"', "x\r\ny", None, 1.23456, 0.123456, ["k", "l"], datetime.datetime(2024, 1, 2, 3, 4, 5), "z" * 5000)],
        "a STRING, b STRING, c STRING, d STRING, e DOUBLE, distinct_ratio DOUBLE, f ARRAY<STRING>, g TIMESTAMP, statement_text STRING",
    )
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text.splitlines()[1] == '"a,b","say ""hi""",x  y,,1.23,0.1235,"k, l",2024-01-02 03:04:05,' + "z" * 5000


def test_csv_numbers_spaces_and_cut(spark, tmp_path):
    df = spark.createDataFrame(
        [(12345678.9, 2.0, "  pad  ", "x" * 12), (0.001, -0.0, "", "short"), (float("nan"), 1e30, None, None)],
        "a DOUBLE, b DOUBLE, c STRING, statement_text STRING",
    )
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"), statement_chars=10)
    lines = next((tmp_path / "out").glob("part-*.csv")).read_text().splitlines()
    assert lines[1:3] == ["12345678.9,2,  pad  ," + "x" * 10 + "...", "0,0,,short"]
    back = spark.read.csv(str(tmp_path / "out"), header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert {r.a for r in back.collect()} == {"12345678.9", "0", "NaN"}


def test_csv_decimal_values_stay_numbers(spark):
    out = sinks.csv_columns(spark.sql("SELECT CAST(1.256 AS DECIMAL(9,3)) AS d, map('a', 'b') AS m, 5 AS i")).first()
    assert (out.d, out.m, out.i) == ("1.26", '{"a":"b"}', 5)


def test_nested_report_round_trip(spark, tmp_path):
    profile = P.profile_columns({"t": spark.range(3).withColumn("s", F.lit("x"))})
    tables = spark.createDataFrame([("t", 9.5), ("u", 12.0)], "table STRING, candidacy_score DOUBLE")
    indexes = spark.createDataFrame([("t", "small", 1.0), ("t", "big", 5.0)], "table STRING, index_name STRING, size_mb DOUBLE")
    report = sinks.nested_report(tables, profile, indexes)
    rows = report.collect()
    assert [r.table for r in rows] == ["u", "t"]
    assert rows[0].columns == [] and rows[0].indexes == []
    assert [c.column for c in rows[1].columns] == ["id", "s"] and [i.index_name for i in rows[1].indexes] == ["big", "small"]
    sinks.write_json(report.coalesce(1), str(tmp_path / "out"))
    lines = next((tmp_path / "out").glob("part-*.json")).read_text().splitlines()
    assert json.loads(lines[1])["columns"][1]["distinct_values"] == 1


def test_inventories_have_declared_schemas(spark, tmp_path):
    assert all(ddl.startswith("server STRING") for ddl in SCHEMAS.values())
    (tmp_path / "jobs.json").write_text('{"server":"s","job_id":"1","name":"n","enabled":true}\n')
    jobs = read_inventory(spark, "jobs", str(tmp_path / "jobs.json"), "json")
    assert jobs.first().name == "n" and jobs.first().owner_sid is None
    assert set(read_tables(spark, "/root/testdata/sf0.001", ["nation", "region"])) == {"nation", "region"}
