"""Queries: normalising, scoping, de-duplicating and counting findings.

Orders stand for a foreign result set: price as priority, priority as category,
status as database.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions.frames import union_all
from tablescope.functions.columns import severity_from_priority, severity_rank
from tablescope.operators import findings as N
from tablescope.operators import oplog as O
from tablescope.plans.registry import Registry
from tablescope.plans.tables import read_table

found = Registry()

SHOWN = ["source", "category", "severity", "severity_rank", "title", "details", "recommendation", "database"]


def _result_set(spark, sf):
    key = F.col("o_orderkey")
    blank = key % 10 == 0
    return read_table(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 50 == 0, "n/a").otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string")).alias("priority"),
        F.col("o_orderpriority").alias("FindingsGroup"),
        F.when(blank, " \t ").otherwise(F.concat(F.lit("Order "), "o_orderstatus")).alias("Finding"),
        F.concat(F.lit("customer "), (F.col("o_custkey") % 20).cast("string")).alias("DETAIL"),
        F.when(blank, F.lit(None)).otherwise(F.concat(F.lit("ref/"), (key % 7).cast("string"))).alias("URL"),
        F.when(key % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).alias("DatabaseName"),
        key.alias("id"),
    )


_NORMAL_SQL = """normal AS (
SELECT 'orders' AS source, o_orderpriority AS category, severity,
  CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS severity_rank,
  CASE WHEN o_orderkey % 10 = 0 THEN 'orders finding' ELSE 'Order ' || o_orderstatus END AS title,
  'customer ' || (o_custkey % 20) AS details, CASE WHEN o_orderkey % 10 <> 0 THEN 'ref/' || (o_orderkey % 7) END AS recommendation,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS database, priority AS raw_priority, o_orderkey AS id
FROM (SELECT *, CASE WHEN p <= 50 THEN 'Critical' WHEN p <= 100 THEN 'High' WHEN p <= 150 THEN 'Medium' WHEN p <= 200 THEN 'Low'
    ELSE 'Info' END AS severity
  FROM (SELECT *, TRY_CAST(priority AS INT) AS p
    FROM (SELECT *, CASE WHEN o_custkey % 50 = 0 THEN 'n/a' ELSE (floor(o_totalprice / 1000)::BIGINT)::VARCHAR END AS priority FROM orders))))"""


def _normal(spark, sf):
    """Findings with the order key as sequence (kept aside as a key column)."""
    return N.normalise_findings("orders", _result_set(spark, sf), keys=["id"])


@found.query(" UNION ALL ".join(
    f"SELECT '{name}' AS name, {str(shaped).lower()} AS finding_shaped, count(*) AS rows FROM {table}"
    for name, shaped, table in [("call", True, "orders"), ("call (2)", False, "documents"), ("call (3)", False, "lineitem"),
                                ("call (4)", True, "events")]
))
def finding_shape(spark, sf):
    checks = read_table(spark, sf, "events").withColumnRenamed("event_type", "checkNAME")
    sets = [_result_set(spark, sf), read_table(spark, sf, "documents"), read_table(spark, sf, "lineitem"), checks]
    shaped, plain = N.split_result_sets("call", sets)
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.lit(flag).alias("finding_shaped"), "rows")
        for flag, named in [(True, shaped), (False, plain)]
        for name, df in named
    ]
    return union_all(rows)


@found.query(f"WITH {_NORMAL_SQL} SELECT id, {', '.join(SHOWN)}, raw_priority FROM normal")
def normalise_findings(spark, sf):
    return _normal(spark, sf).select("id", *SHOWN, F.col("raw")["priority"].alias("raw_priority"))


@found.query("""
SELECT doc_id, 'documents' AS source, 'Uncategorized' AS category, 'Info' AS severity,
  'documents row (unrecognized schema)' AS title,
  'lang=' || lang || '; n_chars=' || n_chars || '; toxic=' || coalesce(toxic::VARCHAR, '') AS details
FROM documents LEFT JOIN labels USING (doc_id)""")
def normalise_unknown_schema(spark, sf):
    labels = read_table(spark, sf, "labels").select("doc_id", "toxic")
    rows = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    normal = N.normalise_findings("documents", rows, keys=["doc_id"])
    return normal.select("doc_id", "source", "category", "severity", "title", "details")


@found.query(f"WITH {_NORMAL_SQL} SELECT id, severity, severity_rank FROM normal")
def severity_bucket(spark, sf):
    severity = severity_from_priority(F.col("priority"))
    rows = _result_set(spark, sf).select("id", severity.alias("severity"))
    return rows.withColumn("severity_rank", severity_rank(F.col("severity")))


@found.query(f"WITH {_NORMAL_SQL} SELECT id, severity, title, database FROM normal WHERE database IS NULL OR lower(database) = 'f'")
def scope_filter(spark, sf):
    return N.scope_to_database(_normal(spark, sf), "f").select("id", "severity", "title", "database")


def _two_checks(spark, sf):
    """Foreign findings and job failures, in one table."""
    foreign = _normal(spark, sf).drop("id")
    failed = read_table(spark, sf, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("job "), F.col("user_id").cast("string")).alias("job_name"), F.col("ts").alias("run_time"),
        F.col("props").alias("message"), F.lit("srv").alias("server"),
    )
    return [foreign, O.failure_findings(failed).drop("server")]


_TWO_SQL = f"""{_NORMAL_SQL}, checks AS (
SELECT 0::BIGINT AS seq, {', '.join(SHOWN)} FROM normal
UNION ALL SELECT 1, 'Native', 'Maintenance', 'Medium', 2, 'Agent job failed: job ' || user_id,
  'Failed at ' || strftime(ts, '%Y-%m-%d %H:%M') || ': ' || props, NULL, NULL FROM events WHERE event_type = 'error')"""


@found.query(f"WITH {_TWO_SQL} SELECT * FROM checks")
def findings_union(spark, sf):
    return N.union_findings(_two_checks(spark, sf)).select("seq", *SHOWN)


@found.query(f"""WITH {_TWO_SQL}
SELECT source, category, severity, title, details, database, min(seq) AS seq FROM checks
WHERE database IS NULL OR lower(database) = 'o' GROUP BY ALL""")
def findings_final(spark, sf):
    """Union, scope, then keep the first of equal findings."""
    final = N.finalize(_two_checks(spark, sf), "O", keys=[])
    return final.select("source", "category", "severity", "title", "details", "database", "seq")


@found.query(f"""WITH {_TWO_SQL}
SELECT category, count(*) AS findings, max(severity_rank) AS worst_rank FROM checks GROUP BY category""")
def finding_rollup(spark, sf):
    return N.finding_rollup(N.union_findings(_two_checks(spark, sf)))


@found.query(f"""WITH {_TWO_SQL}
SELECT count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
  0::BIGINT AS open_questions, count(*) AS findings FROM checks""")
def finding_counts(spark, sf):
    return N.finding_counts(N.union_findings(_two_checks(spark, sf)))


@found.query("""
SELECT doc_id, lang, source FROM documents
QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1""")
def dedupe_keep_first(spark, sf):
    documents = read_table(spark, sf, "documents")
    return N.dedupe_keep_first(documents, ["doc_id"], fields=["text"]).select("doc_id", "lang", "source")


def _text_rows(spark, sf):
    """Orders as JSON rows of three shapes, some of them broken."""
    key = F.col("o_orderkey")
    price = F.floor(F.col("o_totalprice") / 1000)
    text = (
        F.when(key % 50 == 49, F.lit("[1, 2]")).when(key % 50 == 48, F.lit('{"Priority": '))
        .when(key % 3 == 0, F.to_json(F.struct(
            price.alias("Priority"), F.concat(F.lit("Order "), "o_orderstatus").alias("Finding"), F.lit("seen").alias("DETAILS"),
            F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("Database"),
        )))
        .when(key % 3 == 1, F.to_json(F.struct(F.lit("  ").alias("checkname"), F.col("o_custkey").alias("who"), F.struct(key.alias("id")).alias("nested"))))
        .otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), key.alias("id"))))
    )
    return N.read_rows(read_table(spark, sf, "orders").select(key.alias("id"), text.alias("row")), keys=["id"])


@found.query("""
SELECT id, category, severity, title, details, database, raw FROM (
  SELECT o_orderkey AS id, '' AS category, 'Order ' || o_orderstatus AS title, 'seen' AS details, o_orderstatus AS database,
    CASE WHEN p <= 50 THEN 'Critical' WHEN p <= 100 THEN 'High' WHEN p <= 150 THEN 'Medium' WHEN p <= 200 THEN 'Low' ELSE 'Info' END AS severity,
    p || '|Order ' || o_orderstatus || '|seen| ' || o_orderstatus || ' ' AS raw
  FROM (SELECT *, floor(o_totalprice / 1000)::BIGINT AS p FROM orders) WHERE o_orderkey % 3 = 0 AND o_orderkey % 50 < 48
  UNION ALL SELECT o_orderkey, '', 'orders finding', 'checkname=  ; nested={"id":' || o_orderkey || '}; who=' || o_custkey, NULL, 'Info',
    '  |' || o_custkey || '|{"id":' || o_orderkey || '}'
  FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 50 < 48)""")
def foreign_text_findings(spark, sf):
    """Findings among JSON rows of mixed schemas, each normalised by its own fields."""
    found = N.foreign_rows("orders", _text_rows(spark, sf), keys=["id"])["findings"]
    raw = F.concat_ws("|", *[F.col("raw")[n] for n in ["Priority", "Finding", "DETAILS", "Database", "checkname", "who", "nested"]])
    return found.select("id", "category", "severity", "title", "details", "database", raw.alias("raw"))


@found.query("""
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'DETAILS, Database, Finding, Priority' WHEN 1 THEN 'checkname, nested, who' ELSE 'id, status' END AS shape,
  count(*) AS rows, o_orderkey % 3 <> 2 AS is_finding,
  CASE o_orderkey % 3 WHEN 0 THEN 'OBJECT<DETAILS: STRING, Database: STRING, Finding: STRING, Priority: BIGINT>'
    WHEN 1 THEN 'OBJECT<checkname: STRING, nested: OBJECT<id: BIGINT>, who: BIGINT>' ELSE 'OBJECT<id: BIGINT, status: STRING>' END AS schema
FROM orders WHERE o_orderkey % 50 < 48 GROUP BY ALL""")
def foreign_text_shapes(spark, sf):
    return N.shapes_of(_text_rows(spark, sf)).select("shape", "rows", "is_finding", "schema")


@found.query("""
SELECT 'plain' AS part, count(*) AS rows, sum(o_orderkey)::BIGINT AS checksum FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 50 < 48
UNION ALL SELECT 'rejected', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey % 50 >= 48""")
def foreign_text_rest(spark, sf):
    """Rows that are no findings, and rows that are no objects."""
    parts = N.foreign_rows("orders", _text_rows(spark, sf), keys=["id"])
    counted = lambda part, key: parts[part].agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("rows"), F.sum(key).cast("bigint").alias("checksum"))
    return counted("plain", F.col("cells")["id"].cast("bigint")).unionByName(counted("rejected", F.col("id")))
