"""Queries: access audit. Documents stand for users, labels for logins, lineitem for grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import access as A
from tablescope.operators import oplog as O
from tablescope.plans.registry import Registry
from tablescope.plans.tables import read_table

audit = Registry()


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _sid(key):
    return key.cast("string").cast("binary").alias("sid")


# ---- users and logins: two users share a login -------------------------------


def _login_of(doc):
    return F.floor(doc / 2)


def _users(spark, sf):
    doc, lang = F.col("doc_id"), F.col("lang")
    kind = F.when(lang == "en", "S").when(lang == "fr", "U").when(lang == "de", "G").otherwise("R")
    return read_table(spark, sf, "documents").select(
        _text("srv", _login_of(doc) % 3).alias("server"), F.col("source").alias("database"), (doc + 5).alias("principal_id"),
        _text("u", doc).alias("name"), kind.alias("type"),
        F.when(lang == "en", "SQL_USER").otherwise("WINDOWS_USER").alias("type_desc"), _sid(_login_of(doc)),
        F.when(F.col("n_chars") % 5 == 0, "DATABASE").otherwise("INSTANCE").alias("auth_type"),
    )


def _logins(spark, sf):
    doc = F.col("doc_id")
    return read_table(spark, sf, "labels").select(
        _text("srv", doc % 3).alias("server"), doc.alias("principal_id"), _sid(doc),
        F.when(doc % 2 == 0, _text("Login", doc)).otherwise(_text("LOGIN", doc)).alias("name"),
        F.lit("S").alias("type"), F.lit("SQL_LOGIN").alias("type_desc"), (F.col("toxic") == 1).alias("is_disabled"),
    )


_LOGIN_SQL = """logins AS (
SELECT 'srv' || (doc_id % 3) AS server, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Login' ELSE 'LOGIN' END || doc_id AS name,
  toxic = 1 AS is_disabled, quality = 0 AS is_sysadmin FROM labels)"""
_RESOLVED_SQL = f"""{_LOGIN_SQL}, resolved AS (
SELECT *, auth_type = 'INSTANCE' AND login IS NULL AS is_orphaned FROM (
  SELECT 'srv' || (d.doc_id // 2 % 3) AS server, source AS database, d.doc_id + 5 AS principal_id, 'u' || d.doc_id AS name,
    CASE lang WHEN 'en' THEN 'SQL_USER' ELSE 'WINDOWS_USER' END AS type_desc, logins.name AS login,
    CASE WHEN n_chars % 5 = 0 THEN 'DATABASE' ELSE 'INSTANCE' END AS auth_type, lang
  FROM documents d LEFT JOIN logins ON logins.doc_id = d.doc_id // 2 WHERE lang IN ('en', 'fr', 'de')))"""


def _resolved(spark, sf):
    return A.resolve_users(_users(spark, sf), _logins(spark, sf))


@audit.query(f"""
WITH {_RESOLVED_SQL} SELECT server, database, name FROM resolved WHERE is_orphaned AND lang IN ('en', 'fr')""")
def orphans(spark, sf):
    return O.orphaned_users(_users(spark, sf), _logins(spark, sf)).select("server", "database", "name")


@audit.query(f"""
WITH {_RESOLVED_SQL} SELECT server, database, principal_id, name, type_desc, login, is_orphaned FROM resolved""")
def resolve_users(spark, sf):
    return _resolved(spark, sf).select("server", "database", "principal_id", "name", "type_desc", "login", "is_orphaned")


@audit.query(f"""
WITH {_RESOLVED_SQL}
SELECT server, name, is_disabled, (SELECT count(*) FROM resolved r WHERE r.login = logins.name) AS database_user_count FROM logins""")
def users_per_login(spark, sf):
    logins = _logins(spark, sf).select("server", "name", "is_disabled")
    return A.users_per_login(logins, _resolved(spark, sf))


def _audited_logins(spark, sf):
    """Logins with roles: those of low quality are members of role -1, sysadmin."""
    labels = read_table(spark, sf, "labels")
    doc = F.col("doc_id")
    members = labels.filter("quality = 0").select(
        _text("srv", doc % 3).alias("server"), doc.alias("member_principal_id"), F.lit(-1).cast("bigint").alias("role_principal_id")
    )
    roles = labels.select(_text("srv", doc % 3).alias("server")).distinct().select(
        "server", F.lit(-1).cast("bigint").alias("principal_id"), F.lit(None).cast("binary").alias("sid"),
        F.lit("SysAdmin").alias("name"), F.lit("R").alias("type"), F.lit("SERVER_ROLE").alias("type_desc"),
        F.lit(False).alias("is_disabled"),
    )
    principals = _logins(spark, sf).unionByName(roles)
    return A.users_per_login(A.principal_roles(principals, members), _resolved(spark, sf))


@audit.query(f"""
WITH {_RESOLVED_SQL}, counted AS (
SELECT *, (SELECT count(*) FROM resolved r WHERE r.login = logins.name) AS n FROM logins)
SELECT server, 'Security' AS category, 'Info' AS severity,
  'sysadmin member: ' || name || CASE WHEN is_disabled THEN ' (disabled)' ELSE '' END AS title,
  'Login type: SQL_LOGIN.' AS details, NULL AS database, name AS object FROM counted WHERE is_sysadmin
UNION ALL SELECT server, 'Landmine', 'High', 'Disabled login "' || name || '" still has live database access',
  'Mapped to a database user in ' || n || ' database(s).', NULL, name FROM counted WHERE is_disabled AND n > 0
UNION ALL SELECT server, 'Security', 'Low', 'Orphaned database user: ' || name,
  'No server-level login matches this ' || type_desc || ' user.', database, name FROM resolved WHERE is_orphaned""")
def access_findings(spark, sf):
    found = A.access_findings(_audited_logins(spark, sf), _resolved(spark, sf))
    return found.select("server", "category", "severity", "title", "details", "database", "object")


def _simple_grants(spark, sf):
    conv = F.col("conv_id")
    return read_table(spark, sf, "conversations").select(
        _text("srv", conv % 3).alias("server"), _text("src", conv % 20).alias("database")
    )


@audit.query(f"""
WITH {_RESOLVED_SQL}
SELECT *, (SELECT count(*) FROM conversations WHERE 'srv' || (conv_id % 3) = t.server) AS grants FROM (
  SELECT server, count(*) AS logins, count(*) FILTER (is_disabled) AS disabled_logins, count(*) FILTER (is_sysadmin) AS sysadmins
  FROM logins GROUP BY 1) AS t
JOIN (SELECT server, count(DISTINCT database) AS databases, count(*) AS users, count(*) FILTER (is_orphaned) AS orphans
  FROM resolved GROUP BY 1) USING (server)""")
def access_summary(spark, sf):
    return A.access_summary(_audited_logins(spark, sf), _resolved(spark, sf), _simple_grants(spark, sf))


@audit.query(f"""
WITH {_RESOLVED_SQL}
SELECT server, database, count(*) AS users, count(*) FILTER (is_orphaned) AS orphans,
  (SELECT count(*) FROM conversations WHERE 'srv' || (conv_id % 3) = server AND 'src' || (conv_id % 20) = database) AS grants
FROM resolved GROUP BY server, database""")
def access_by_database(spark, sf):
    return A.access_by_database(_resolved(spark, sf), _simple_grants(spark, sf))


# ---- roles: speakers of a conversation ---------------------------------------

# The three speakers as role ids (minus the length of their name).


def _speakers(spark, sf, *more):
    rows = read_table(spark, sf, "conversations")
    server = F.lit("srv").alias("server")
    people = rows.select(
        server, *more, F.col("conv_id").alias("principal_id"), _text("conv", F.col("conv_id")).alias("name"),
        F.lit("S").alias("type"),
    ).distinct()
    roles = rows.select(
        server, *more, (-F.length("role")).cast("bigint").alias("principal_id"), F.col("role").alias("name"), F.lit("R").alias("type")
    ).distinct()
    members = rows.select(
        server, *more, F.col("conv_id").alias("member_principal_id"), (-F.length("role")).cast("bigint").alias("role_principal_id")
    )
    return people.unionByName(roles), members


@audit.query("""
SELECT 'srv' AS server, conv_id AS principal_id, 'conv' || conv_id AS name,
  array_to_string(list_sort(list(DISTINCT role)), ', ') AS roles FROM conversations GROUP BY conv_id""")
def principal_roles(spark, sf):
    principals, members = _speakers(spark, sf)
    roles = A.principal_roles(principals, members)
    return roles.select("server", "principal_id", "name", F.array_join("roles", ", ").alias("roles"))


@audit.query("""
SELECT 'db' || (turn % 3) AS database, conv_id AS principal_id, array_to_string(list_sort(list(DISTINCT role)), ', ') AS roles
FROM conversations WHERE conv_id > 4 GROUP BY ALL""")
def user_roles(spark, sf):
    principals, members = _speakers(spark, sf, _text("db", F.col("turn") % 3).alias("database"))
    roles = A.user_roles(principals, members)
    return roles.select("database", "principal_id", F.array_join("roles", ", ").alias("roles"))


# ---- grants ------------------------------------------------------------------


def _grant_inputs(spark, sf):
    server = F.lit("srv").alias("server")
    db = lambda key: _text("db", key % 3).alias("database")
    databases = F.explode(F.array(*[F.lit(f"db{i}") for i in range(3)])).alias("database")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    permissions = ["SELECT", "CONTROL", "ALTER", "INSERT", "TAKE OWNERSHIP", "control", "EXECUTE"]
    perms = read_table(spark, sf, "lineitem").select(
        server, db(F.col("l_partkey")), F.col("l_suppkey").alias("grantee_principal_id"),
        F.when(flag == "A", 1).when(flag == "N", 3).otherwise(0).alias("class"),
        F.when(flag == "A", "OBJECT_OR_COLUMN").when(flag == "N", "SCHEMA").otherwise("DATABASE").alias("class_desc"),
        F.when(flag == "A", F.col("l_partkey")).when(flag == "N", F.col("l_partkey") % 60).otherwise(0).alias("major_id"),
        F.when(F.col("l_discount") > 0.05, F.col("l_suppkey") % 5).otherwise(0).alias("minor_id"),
        F.element_at(F.array(*[F.lit(p) for p in permissions]), line).alias("permission"),
        F.when(F.col("l_linestatus") == "O", "GRANT").when(F.col("l_tax") > 0.04, "DENY")
        .otherwise("GRANT_WITH_GRANT_OPTION").alias("state"),
    )
    supplier, part = read_table(spark, sf, "supplier"), read_table(spark, sf, "part")
    principals = supplier.select(
        server, databases, F.col("s_suppkey").alias("principal_id"),
        F.when(F.col("s_nationkey") < 3, "Public").otherwise(F.col("s_name")).alias("name"),
        F.when(F.col("s_nationkey") < 3, "DATABASE_ROLE").otherwise("SQL_USER").alias("type_desc"),
    )
    objects = part.select(
        server, db(F.col("p_partkey")), F.col("p_partkey").alias("object_id"), F.col("p_size").alias("schema_id"),
        F.col("p_name").alias("name"),
    )
    schemas = part.select(server, databases, "p_size").distinct().select(
        server, "database", F.col("p_size").alias("schema_id"), _text("s", F.col("p_size")).alias("name")
    )
    columns = part.select(
        server, db(F.col("p_partkey")), F.col("p_partkey").alias("object_id"),
        F.explode(F.sequence(F.lit(1), F.lit(3))).alias("column_id"),
    ).withColumn("name", _text("Col", F.col("column_id")))
    return perms, principals, objects, schemas, columns


def _grants(spark, sf):
    return A.resolve_grants(*_grant_inputs(spark, sf))


def _named(spark, sf, keep=None):
    """The same by distinct ids: what reports of targets need."""
    permissions, *names = _grant_inputs(spark, sf)
    return A.named_grants(A.distinct_grants(permissions), *names, keep=keep)


_GRANTS_SQL = """grants AS (
SELECT 'srv' AS server, 'db' || (l_partkey % 3) AS database,
  CASE WHEN s_nationkey < 3 THEN 'Public' ELSE s_name END AS grantee,
  CASE WHEN s_nationkey < 3 THEN 'DATABASE_ROLE' ELSE 'SQL_USER' END AS grantee_type,
  CASE l_returnflag WHEN 'A' THEN 'OBJECT_OR_COLUMN' WHEN 'N' THEN 'SCHEMA' ELSE 'DATABASE' END AS class_desc,
  (['SELECT', 'CONTROL', 'ALTER', 'INSERT', 'TAKE OWNERSHIP', 'control', 'EXECUTE'])[l_linenumber] AS permission,
  CASE WHEN l_linestatus = 'O' THEN 'GRANT' WHEN l_tax > 0.04 THEN 'DENY' ELSE 'GRANT_WITH_GRANT_OPTION' END AS state,
  CASE l_returnflag WHEN 'A' THEN 's' || p_size WHEN 'N' THEN 's' || z.size END AS schema_name,
  CASE WHEN l_returnflag = 'A' THEN p_name END AS object_name,
  CASE WHEN l_returnflag = 'A' AND minor BETWEEN 1 AND 3 AND p_partkey IS NOT NULL THEN 'Col' || minor END AS column_name,
  CASE l_returnflag WHEN 'A' THEN p_partkey IS NOT NULL AND minor BETWEEN 0 AND 3 WHEN 'N' THEN z.size IS NOT NULL ELSE true END AS resolved
FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN l_suppkey % 5 ELSE 0 END AS minor FROM lineitem)
JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey
LEFT JOIN (SELECT DISTINCT p_size AS size FROM part) AS z ON z.size = l_partkey % 60
), labelled AS (
SELECT *, CASE WHEN object_name IS NULL THEN coalesce(schema_name, '(database-level)')
  ELSE schema_name || '.' || object_name || coalesce('.' || column_name, '') END AS target FROM grants)"""

_GROUPED_SQL = """SELECT server, database, grantee, grantee_type, class_desc, permission, state, count(*) AS target_count,
  array_to_string(list(target ORDER BY lower(target), target)[1:{cap}], ', ')
    || CASE WHEN count(*) > {cap} THEN ', +' || (count(*) - {cap}) || ' more' ELSE '' END AS target_summary
FROM (SELECT DISTINCT server, database, grantee, grantee_type, class_desc, permission, state, target FROM labelled {where})
GROUP BY ALL"""


@audit.query(f"WITH {_GRANTS_SQL} SELECT * FROM grants")
def resolve_grants(spark, sf):
    return _grants(spark, sf)


@audit.query(f"""WITH {_GRANTS_SQL}
SELECT DISTINCT server, database, grantee, grantee_type, class_desc, permission, state, target FROM labelled""")
def grant_targets(spark, sf):
    return A.grant_targets(_named(spark, sf))


@audit.query(f"WITH {_GRANTS_SQL} {_GROUPED_SQL.format(cap=3, where='')}")
def group_grants(spark, sf):
    return A.group_grants(_named(spark, sf), cap=3).drop("first_targets")


_RISKY = "WHERE (state = 'GRANT' AND upper(permission) IN ('CONTROL', 'ALTER', 'TAKE OWNERSHIP')) OR lower(grantee) = 'public'"


@audit.query(f"""WITH {_GRANTS_SQL}
SELECT *, CASE WHEN lower(grantee) = 'public' THEN 'High' ELSE 'Medium' END AS severity
FROM ({_GROUPED_SQL.format(cap=10, where=_RISKY)})""")
def risky_grants(spark, sf):
    return A.risky_grants(_named(spark, sf, keep=A.is_risky())).drop("first_targets")


@audit.query(f"""WITH {_GRANTS_SQL}
SELECT 'Landmine' AS category, CASE WHEN lower(grantee) = 'public' THEN 'High' ELSE 'Medium' END AS severity,
  state || ' ' || permission || ' to ' || grantee || ' on ' || target_count || ' target(s)' AS title,
  'Grantee type: ' || grantee_type || '. Targets: ' || target_summary
    || CASE WHEN target_count > 10 THEN ' (see grant_targets)' ELSE '' END AS details, database,
  CASE WHEN target_count = 1 THEN target_summary END AS object
FROM ({_GROUPED_SQL.format(cap=10, where=_RISKY)})""")
def risky_grant_findings(spark, sf):
    found = A.risky_grant_findings(A.risky_grants(_named(spark, sf, keep=A.is_risky())))
    return found.select("category", "severity", "title", "details", "database", "object")


@audit.query(f"""WITH {_GRANTS_SQL}
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY server, database ORDER BY target_count DESC,
  grantee, grantee_type, class_desc, permission, state) AS rk FROM ({_GROUPED_SQL.format(cap=3, where='')})) WHERE rk <= 20""")
def top_grant_groups(spark, sf):
    return A.top_grant_groups(A.group_grants(_named(spark, sf), cap=3), top=20).drop("first_targets")
