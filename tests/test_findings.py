import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from tablescope.functions import columns as K
from tablescope.operators import findings as N

FULL = "Priority STRING, FindingsGroup STRING, Finding STRING, URL STRING, Details STRING, DatabaseName STRING"
ROW = "source STRING, category STRING, severity STRING, title STRING, details STRING, database STRING, object STRING, n INT"


def make(spark, *changes):
    base = dict(source="Native", category="Security", severity="Info", title="Title", details="Details", database=None, object=None)
    return spark.createDataFrame([(*{**base, **c}.values(), i) for i, c in enumerate(changes)], ROW)


def test_shape_is_decided_by_name(frame):
    assert N.looks_like_findings(frame("Priority INT, x INT"))
    assert N.looks_like_findings(frame("x INT, checkname STRING"))
    assert not N.looks_like_findings(frame("QueryHash BIGINT, AvgCPU DOUBLE"))


@pytest.mark.parametrize(
    "priority,severity",
    [("1", "Critical"), ("50", "Critical"), ("51", "High"), ("100", "High"), ("101", "Medium"), ("150", "Medium"), ("151", "Low"),
     ("200", "Low"), ("201", "Info"), ("not-a-number", "Info"), ("5.5", "Info"), (" 7 ", "Critical"), ("-3", "Critical"), (None, "Info")],
)
def test_priority(frame, priority, severity):
    r = N.normalise_findings("src", frame(FULL, (priority, "Perf", "Found", "http://x", "text", "MyDb"))).first()
    assert (r.severity, r.database, r.title, r.category, r.details, r.recommendation) == (severity, "MyDb", "Found", "Perf", "text", "http://x")


@pytest.mark.parametrize("kind", ["INT", "BIGINT", "DOUBLE", "DECIMAL(9,2)"])
def test_numeric_priority(spark, kind):
    df = spark.sql(f"SELECT CAST(60 AS {kind}) AS priority, 'x' AS finding")
    assert N.normalise_findings("s", df).first().severity == "High"


def test_fractional_priority_is_unreadable(spark):
    assert N.normalise_findings("s", spark.sql("SELECT 60.5D AS priority")).first().severity == "Info"


def test_fallbacks(frame):
    lower = N.normalise_findings("s", frame("priority INT, finding STRING", (10, "low"))).first()
    assert (lower.title, lower.details, lower.category) == ("low", "priority=10; finding=low", "")
    untitled = N.normalise_findings("s", frame("Priority INT", (10,), (None,))).collect()
    assert [r.title for r in untitled] == ["s finding"] * 2
    blank = N.normalise_findings("s", frame(FULL, ("1", None, " \t", None, None, "  "))).first()
    assert (blank.title, blank.category, blank.details, blank.database) == ("s finding", "", "", None)
    odd = N.normalise_findings("s", frame("Weird STRING, Other STRING, Database STRING", ("v1", None, " Db "))).first()
    assert (odd.category, odd.severity, odd.title) == ("Uncategorized", "Info", "s row (unrecognized schema)")
    assert (odd.details, odd.database, odd.raw) == ("Weird=v1; Other=; Database= Db ", "Db", {"Weird": "v1", "Other": None, "Database": " Db "})


def test_preferred_column_wins(frame):
    r = N.normalise_findings("s", frame("Category STRING, FindingsGroup STRING, CheckName STRING", ("c", "g", "t"))).first()
    assert (r.category, r.title) == ("g", "t")


def test_result_sets_are_numbered(spark, frame):
    shaped, plain = N.split_result_sets("p", [frame("x INT"), spark.createDataFrame([()], ""), frame("Finding STRING")])
    assert [n for n, _ in shaped] == ["p (3)"] and [n for n, _ in plain] == ["p"]


def test_scope(spark):
    df = make(spark, dict(database="DbA"), dict(database="DbB"), {})
    assert rows(N.scope_to_database(df, "dba"), "n") == [(0,), (2,)]
    assert N.scope_to_database(df, "DbA", all_databases=True).count() == 3
    assert rows(N.scope_to_database(df, ""), "n") == [(2,)]


def test_dedupe(spark):
    df = make(
        spark, dict(title="Same"), dict(title="SAME"), dict(title="Other"), dict(title="Same", database="DbA"),
        dict(title="Same", details="B"), dict(title="Same", database=""), dict(title="Same", severity="High"),
    )
    assert rows(N.dedupe_keep_first(df, ["n"]), "n") == [(0,), (2,), (3,), (4,), (6,)]
    # Fields are kept apart: 'ab' + 'c' is not 'a' + 'bc'.
    assert N.dedupe_keep_first(make(spark, dict(title="ab", details="c"), dict(title="a", details="bc")), ["n"]).count() == 2


def test_dedupe_of_hot_copies_is_cut_before_the_shuffle(spark):
    df = spark.range(30_000, numPartitions=8).select(
        F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text")
    )
    kept = N.dedupe_keep_first(df, ["n"], fields=["text"])
    plan = final_plan(kept)
    assert plan.count("WindowGroupLimit") >= 2
    assert kept.count() == 20_001 and kept.filter("text = 'copy'").first().n == 0


def test_finalize_and_counts(spark):
    row = lambda sev, title, db, question=None: N.finding("c", sev, title, database=db, question=question)
    one = spark.range(1)
    a = N.emit(one, row("High", "x", None), row("Low", "y", "Db1", "why?"), F.lit(None), keys=[])
    b = N.emit(one, row("High", "X", None), row("Critical", "z", "Db2"), keys=[])
    final = N.finalize([a, b], "db1", keys=[])
    assert rows(final, "seq", "title") == [(0, "x"), (0, "y")]
    both = N.union_findings([a, b])
    assert rows(N.finding_counts(both)) == [(1, 2, 1, 4)]
    assert rows(N.finding_rollup(both)) == [("c", 4, 4)]
    assert [r.severity for r in N.by_urgency(both).collect()] == ["Critical", "High", "High", "Low"]
    assert rows(N.open_questions(both), "title", "question") == [("y", "why?")]


def test_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(K.csv_field(lit(x))) for x in ["hello", "a,b", 'say "hi"', "a\nb", "a\rb", "a\r\nb", "plain text"]] == [
        "hello", '"a,b"', '"say ""hi"""', "a b", "a b", "a  b", "plain text"
    ]
    assert one(K.csv_field(lit(None).cast("string"))) == ""
    assert one(K.squeeze(lit(" a \t\r\n b  "), 300)) == "a b"
    assert one(K.squeeze(lit("x" * 300), 300)) == "x" * 300
    assert one(K.squeeze(lit("x" * 301), 300)) == "x" * 300 + "..."
    letters = F.array(*[lit(c) for c in "abcde"])
    assert one(K.cap_list(F.slice(letters, 1, 3), 5)) == "a, b, c" and one(K.cap_list(letters, 2)) == "a, b, +3 more"
    assert one(K.split_cols(lit(" a, b ,,c "))) == ["a", "b", "c"] and one(K.split_cols(lit(None).cast("string"))) == []
    assert str(one(K.int_datetime(lit(20240105), lit(70809)))) == "2024-01-05 07:08:09"
    assert one(K.safe_div(lit(1), lit(0))) == 0.0 and one(K.safe_pct(lit(1), lit(4))) == 25.0
    assert one(~K.contains_ci(lit("x"), lit(None).cast("string"))) is True
    assert one(K.hash_bucket(lit(42))) == int(__import__("hashlib").md5(b"42").hexdigest()[:8], 16) % 1_000_000
    assert [one(K.severity_name(lit(i))) for i in range(5)] == ["Info", "Low", "Medium", "High", "Critical"]


def test_rows_of_unknown_schema(spark, frame):
    texts = frame(
        "server STRING, row STRING",
        ("s", '{"priority": "10.0", "FINDING": "bad", "databasename": " a "}'), ("s", '{"Priority": 10, "priority": 200, "CheckName": null}'),
        ("s", '{"x": null, "y": {"z": 1}}'), ("s", "{}"), ("s", "[1]"), ("s", "nonsense"), ("s", None), ("s", ""),
    )
    parsed = N.read_rows(texts, keys=["server"])
    parts = N.foreign_rows("tool", parsed)
    assert rows(parts["findings"], "severity", "title", "details", "database") == [
        ("Critical", "bad", "FINDING=bad; databasename= a ; priority=10.0", "a"),
        ("Critical", "tool finding", "CheckName=; Priority=10; priority=200", None),
    ]
    assert rows(parts["plain"], "shape", "cells") == [("", {}), ("x, y", {"x": None, "y": '{"z":1}'})]
    assert parts["rejected"].count() == 4
    assert rows(N.shapes_of(parsed).filter("shape = 'x, y'"), "rows", "schema", "is_finding") == [(1, "OBJECT<x: VOID, y: OBJECT<z: BIGINT>>", False)]
    empty = N.foreign_rows("tool", N.read_rows(texts.limit(0), keys=["server"]))
    assert empty["findings"].count() == empty["plain"].count() == 0


def test_health_check_takes_text_rows(spark, frame):
    from tablescope import flows

    texts = frame("server STRING, row STRING", ("s", '{"Priority": 60, "Finding": "slow"}'), ("s", '{"n": 1}'), ("s", "?"))
    report = flows.health_check({}, "2024-01-31", foreign_text=[("tool", texts)])
    assert rows(report["findings"], "server", "severity", "title") == [("s", "High", "slow")]
    assert report["tool (plain)"].count() == report["tool (rejected)"].count() == 1
