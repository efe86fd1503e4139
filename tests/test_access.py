import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from tablescope.operators import access as A

GRANT = "server STRING, database STRING, grantee STRING, grantee_type STRING, class_desc STRING, permission STRING," \
        " state STRING, schema_name STRING, object_name STRING, column_name STRING"


def grant(db="TestDb", grantee="public", kind="DATABASE_ROLE", cls="OBJECT_OR_COLUMN", permission="SELECT", state="GRANT",
          schema="dbo", obj="Orders", column=None):
    return ("s", db, grantee, kind, cls, permission, state, schema, obj, column)


def test_labels(spark):
    cases = [(grant(), "dbo.Orders"), (grant(column="Email"), "dbo.Orders.Email"), (grant(cls="SCHEMA", obj=None), "dbo"),
             (grant(cls="DATABASE", obj=None, schema=None), "(database-level)")]
    for row, want in cases:
        assert spark.createDataFrame([row], GRANT).select(A.target_label()).first()[0] == want


def groups(spark, *grants, cap=10):
    return A.group_grants(spark.createDataFrame(list(grants), GRANT), cap)


def test_columns_of_one_table_form_one_group(spark):
    r = groups(spark, grant(column="b"), grant(column="A"), grant(column="a"), grant(column="b")).collect()
    assert len(r) == 1 and r[0].target_count == 3
    assert r[0].first_targets == ["dbo.Orders.A", "dbo.Orders.a", "dbo.Orders.b"]


def test_groups_are_kept_apart(spark):
    assert groups(spark, grant(), grant(cls="SCHEMA", obj=None)).count() == 2
    assert groups(spark, grant(), grant(grantee="app", kind="SQL_USER")).count() == 2
    assert groups(spark, grant(db="A"), grant(db="B")).count() == 2


def test_summary_cap(spark):
    letters = [grant(schema=None, obj=None, cls="DATABASE")] + [grant(cls="DATABASE", schema=c, obj=None) for c in "bcde"]
    assert groups(spark, *letters, cap=2).first().target_summary == "(database-level), b, +3 more"
    assert groups(spark, *letters, cap=5).first().target_summary == "(database-level), b, c, d, e"


def test_risky(spark):
    df = spark.createDataFrame(
        [grant(grantee="a", permission="control"), grant(grantee="b", permission="CONTROL", state="GRANT_WITH_GRANT_OPTION"),
         grant(grantee="c", permission="CONTROL", state="DENY"), grant(grantee="Public", state="DENY"), grant(grantee="d"),
         grant(grantee="e", permission="TAKE OWNERSHIP"), grant(grantee="f", permission="ALTER")], GRANT)
    assert rows(A.risky_grants(df), "grantee", "severity") == [("Public", "High"), ("a", "Medium"), ("e", "Medium"), ("f", "Medium")]
    assert "b" in [g for (g,) in rows(A.risky_grants(df, include_grant_option=True), "grantee")]
    found = A.risky_grant_findings(A.risky_grants(df)).filter("severity = 'High'").first()
    assert found.title == "DENY SELECT to Public on 1 target(s)" and found.object == "dbo.Orders"
    assert found.details == "Grantee type: DATABASE_ROLE. Targets: dbo.Orders"
    many = spark.createDataFrame([grant(obj=f"t{i:02}") for i in range(12)], GRANT)
    wide = A.risky_grant_findings(A.risky_grants(many)).first()
    assert wide.object is None and wide.details.endswith("dbo.t09, +2 more (see grant_targets)")


def catalog(frame):
    db = ("s", "db")
    principals = frame("db_principals", (*db, 0, "public", "R", "DATABASE_ROLE", None, "NONE"), (*db, 7, "app", "S", "SQL_USER", b"7", "INSTANCE"))
    objects = frame("objects", (*db, 100, 1, "Orders"))
    schemas = frame("db_schemas", (*db, 1, "dbo"), (*db, 2, "etl"))
    columns = frame("columns", (*db, 100, 1, "Id"), (*db, 999, 1, "Ghost"))
    grants = frame(
        "db_permissions", *[(*db, 7, c, d, major, minor, "SELECT", "GRANT") for c, d, major, minor in
                            [(1, "OBJECT_OR_COLUMN", 100, 0), (1, "OBJECT_OR_COLUMN", 100, 1), (1, "OBJECT_OR_COLUMN", 100, 9),
                             (1, "OBJECT_OR_COLUMN", 999, 1), (3, "SCHEMA", 2, 0), (3, "SCHEMA", 9, 0), (0, "DATABASE", 0, 0), (4, "TYPE", 1, 0)]],
        (*db, 55, 0, "DATABASE", 0, 0, "SELECT", "GRANT"),
    )
    return grants, principals, objects, schemas, columns


WANT = [("(database-level)", False), ("(database-level)", False), ("(database-level)", True), ("dbo.Orders", False), ("dbo.Orders", True),
        ("dbo.Orders.Id", True), ("etl", True)]


def test_resolve_grants(frame):
    resolved = A.resolve_grants(*catalog(frame))
    assert rows(resolved.select(A.target_label().alias("t"), "resolved")) == sorted(WANT, key=repr)


def test_resolve_grants_without_broadcasts(shuffled_joins, frame):
    resolved = A.resolve_grants(*catalog(frame))
    assert rows(resolved.select(A.target_label().alias("t"), "resolved")) == sorted(WANT, key=repr)
    assert "BroadcastHashJoin" not in final_plan(resolved)


def test_risky_grants_are_filtered_before_they_are_named(shuffled_joins, frame):
    permissions, *names = catalog(frame)
    risky = A.risky_grants(A.named_grants(A.distinct_grants(permissions), *names, keep=A.is_risky()))
    plan = risky._jdf.queryExecution().optimizedPlan().toString()
    first = plan[: plan.index("upper(permission")]
    assert first.count("Join LeftOuter") == 3  # objects, columns and schemas are joined above the filter


def test_first_shuffle_of_grants_holds_no_names(shuffled_joins, frame):
    permissions, *names = catalog(frame)
    grouped = A.group_grants(A.named_grants(A.distinct_grants(permissions.unionByName(permissions)), *names))
    lines = grouped._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffled = [i for i, line in enumerate(lines) if "HashAggregate(keys=[server" in line and "minor_id" in line and "Exchange" in lines[i - 1]]
    assert shuffled  # combined in the task first
    for i in shuffled:
        assert "name" not in lines[i] and "grantee#" not in lines[i]


def test_stated_grants_come_back(frame):
    permissions, *names = catalog(frame)
    twice = permissions.unionByName(permissions.filter("class = 0"))
    resolved = A.resolve_grants(twice, *names)
    assert resolved.count() == len(WANT) + 1
    many = frame("copies BIGINT, grantee STRING", (10_000, "a"), (4096, "b"), (1, "c"))
    assert rows(A.every_grant(many).groupBy("grantee").count()) == [("a", 10_000), ("b", 4096), ("c", 1)]


def logins(frame):
    return frame(
        "principals", ("s", 1, b"\x01", "Ann", "S", "SQL_LOGIN", True, None, None), ("s", 2, b"\x02", "bob", "U", "WINDOWS_LOGIN", False, None, None),
        ("s", 3, None, "SysAdmin", "R", "SERVER_ROLE", False, None, None), ("s", 4, b"\x04", "cert", "C", "CERTIFICATE", False, None, None),
    )


def users(frame):
    user = lambda db, i, sid, auth="INSTANCE", kind="S": ("s", db, i, f"u{i}", kind, "SQL_USER", sid, auth)
    return frame(
        "db_principals", user("d1", 5, b"\x01"), user("d2", 6, b"\x01"), user("d1", 7, b""), user("d1", 8, None, "DATABASE"),
        user("d1", 9, b"\x04", kind="G"), user("d1", 4, b"\x01"), user("d1", 10, b"\x02", kind="R"),
    )


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_resolve_users(spark, frame, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = rows(A.resolve_users(users(frame), logins(frame)), "name", "login", "is_orphaned")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [("u5", "Ann", False), ("u6", "Ann", False), ("u7", None, True), ("u8", None, False), ("u9", None, True)]


def test_roles_and_findings(frame):
    members = frame("server_role_members", ("s", 1, 3), ("s", 2, 3), ("s", 2, 3))
    people = A.users_per_login(A.principal_roles(logins(frame), members), A.resolve_users(users(frame), logins(frame)))
    assert rows(people, "name", "roles", "database_user_count") == [("Ann", ["SysAdmin"], 2), ("bob", ["SysAdmin"], 0)]
    found = A.access_findings(people, A.resolve_users(users(frame), logins(frame)), A.risky_grants(frame(GRANT, grant())))
    assert rows(found, "severity", "title") == [
        ("High", 'Disabled login "Ann" still has live database access'), ("High", "GRANT SELECT to public on 1 target(s)"),
        ("Info", "sysadmin member: Ann (disabled)"), ("Info", "sysadmin member: bob"),
        ("Low", "Orphaned database user: u7"), ("Low", "Orphaned database user: u9"),
    ]
    db_members = frame("db_role_members", ("s", "d1", 5, 10), ("s", "d2", 6, 10))
    assert rows(A.user_roles(users(frame), db_members).filter("size(roles) > 0"), "name", "roles") == [("u5", ["u10"])]


def test_summaries(frame):
    people = A.users_per_login(A.principal_roles(logins(frame), frame("server_role_members", ("s", 2, 3))), A.resolve_users(users(frame), logins(frame)))
    resolved = A.resolve_users(users(frame), logins(frame))
    grants = frame(GRANT, grant(db="d1"), grant(db="d1", obj="x"), grant(db="d9"))
    summary = A.access_summary(people, resolved, grants).first()
    assert tuple(summary) == ("s", 2, 1, 1, 2, 5, 2, 3)
    # A database with grants but without users is not listed.
    assert rows(A.access_by_database(resolved, grants)) == [("s", "d1", 4, 2, 2), ("s", "d2", 1, 0, 0)]


def test_top_groups(spark):
    df = groups(spark, *[grant(grantee=g, obj=f"t{i}") for g, n in [("a", 1), ("b", 3), ("c", 2)] for i in range(n)])
    assert rows(A.top_grant_groups(df, top=2), "grantee", "target_count") == [("b", 3), ("c", 2)]


def test_hot_grantee(spark, shuffled_joins):
    """A third of the grants are public's: every distinct target is counted, ten are collected."""
    df = spark.range(9_000, numPartitions=8).select(
        F.lit("s").alias("server"), F.lit("db").alias("database"),
        F.when(F.col("id") % 3 == 0, "public").otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("grantee"),
        F.lit("R").alias("grantee_type"), F.lit("OBJECT_OR_COLUMN").alias("class_desc"), F.lit("SELECT").alias("permission"),
        F.lit("GRANT").alias("state"), F.lit("dbo").alias("schema_name"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("object_name"), F.lit(None).cast("string").alias("column_name"),
    )
    grouped = A.group_grants(df)
    plan = final_plan(grouped)
    public = grouped.filter("grantee = 'public'").first()
    assert public.target_count == 3_000 and len(public.first_targets) == 10 and public.target_summary.endswith(", +2990 more")
    assert "WindowGroupLimit" in plan
    assert A.grant_targets(df).count() == 9_000
