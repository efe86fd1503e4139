"""Queries: profiles, newest rows and counters kept as states that later days are merged into; estimates from samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions.columns import hash_bucket
from tablescope.functions.frames import union_all
from tablescope.operators import estimate as E
from tablescope.operators import findings as N
from tablescope.operators import oplog as O
from tablescope.operators import states as S
from tablescope.plans.registry import Registry
from tablescope.plans.tables import KINDS, TABLES, columns_of, read_table
from tablescope.sources.tables import quarantine

states = Registry()

# Tables with a time, whose days come one after the other.
TIMED = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
KINDS_OF_EVENT = ["click", "error", "purchase", "signup", "view"]
FIRST, SECOND, LAST = "2024-01-10", "2024-01-20", "2024-01-28"


def _moment(day: str):
    return F.lit(day).cast("timestamp_ntz")


def _measured(table: str) -> list[tuple[str, str]]:
    return [(c, kind) for c, kind in columns_of(table) if kind != "lob"]


def _merged_sql(table: str) -> str:
    parts = []
    for column, kind in _measured(table):
        width = KINDS[kind][1]
        size = f"{width} * count({column})" if width else f"coalesce(sum(strlen({column})), 0)"
        parts.append(
            f"""SELECT '{table}' AS "table", '{column}' AS "column", count(*) AS rows, count({column}) AS non_null,
  ({size})::BIGINT AS byte_sum, true AS same_as_whole, true AS within_a_tenth FROM {table}"""
        )
    return " UNION ALL ".join(parts)


@states.query(" UNION ALL ".join(_merged_sql(t) for t in TIMED))
def merged_profile(spark, sf):
    """States per month, the months' states merged year by year and then all together; equal to one sketch over all rows.

    A tenth is six standard errors of the sketch.
    """
    merged, whole, exact = [], [], []
    for table, time in TIMED.items():
        df = read_table(spark, sf, table)
        months = S.profile_states(df, table, F.date_format(time, "yyyy-MM"))
        years = S.merged_profile(months.withColumn("year", F.left("part", F.lit(4))), ["table", "column", "year"])
        merged.append(S.merged_profile(years))
        whole.append(S.profile_states(df, table, F.lit("all")).select("table", "column", F.col("sketch").alias("whole")))
        counts = df.agg(*[F.count_distinct(c).alias(c) for c, _ in _measured(table)])
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c, _ in _measured(table)])
        exact.append(counts.select(F.lit(table).alias("table"), F.explode(each).alias("c")).select("table", "c.*"))
    out = union_all(merged).join(union_all(whole), ["table", "column"]).join(union_all(exact), ["table", "column"])
    # equal registers: uniting either with the other is uniting it with itself. (A sketch never merged has a finer estimate.)
    united = [F.hll_sketch_estimate(F.hll_union(a, b)) for a, b in (("sketch", "sketch"), ("sketch", "whole"), ("whole", "whole"))]
    same = (united[0] == united[1]) & (united[1] == united[2])
    return out.select(
        "table", "column", "rows", "non_null", "byte_sum",
        same.alias("same_as_whole"),
        (F.abs(F.col("distinct") - F.col("exact")) * 10 <= F.col("exact")).alias("within_a_tenth"),
    )


# A fifth of each table's units is sampled: of rows, or for lineitem of whole orders, whose rows are alike.
SAMPLED = 200_000


def _unit(table: str) -> str:
    key, turn = columns_of(table)[0][0], {"conversations": "turn"}.get(table)
    return f"{key} || '-' || {turn}" if turn else key


def _sample_sql(table: str) -> str:
    unit = _unit(table)
    bucket = f"('0x' || substr(md5(({unit})::VARCHAR), 1, 8))::BIGINT % 1000000"
    cluster = table == "lineitem"
    parts = []
    for column, _ in _measured(table):
        counted = f"count(DISTINCT {unit})" if cluster else "count(*)"
        parts.append(
            f"""SELECT '{table}' AS "table", '{column}' AS "column", count(*) AS at_least, count(*) FILTER (n = 1) AS once, true AS inside
FROM (SELECT {column}, {counted} AS n FROM {table} WHERE {bucket} < {SAMPLED} AND {column} IS NOT NULL GROUP BY 1) HAVING count(*) > 0"""
        )
    return " UNION ALL ".join(parts)


@states.query(" UNION ALL ".join(_sample_sql(t) for t in TABLES))
def distinct_estimate(spark, sf):
    """Distinct values of every column from a fifth of each table, with bounds that hold the exact number."""
    seen, sizes, exact = [], [], []
    for table in TABLES:
        df = read_table(spark, sf, table)
        unit = F.concat_ws("-", "conv_id", "turn") if table == "conversations" else F.col(columns_of(table)[0][0])
        taken = hash_bucket(unit) < SAMPLED
        cluster = table == "lineitem"
        seen.append(E.value_units(df.filter(taken), table, unit if cluster else None))
        number = F.count_distinct if cluster else F.count
        sizes.append(df.agg(F.lit(table).alias("table"), number(F.when(taken, unit)).alias("sampled"), number(unit).alias("total")))
        exact.append(E.value_units(df, table).select("table", "column", F.col("seen").alias("exact")))
    out = E.distinct_bounds(union_all(seen), union_all(sizes)).join(union_all(exact), ["table", "column"])
    inside = (F.col("at_least") <= F.col("exact")) & (F.col("exact") <= F.col("at_most"))
    inside = inside & F.col("estimate").between(F.col("at_least"), F.col("at_most"))
    return out.select("table", "column", "at_least", "once", inside.alias("inside"))


def _events(spark, sf):
    return read_table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")


@states.query(f"""
SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk
  FROM events WHERE ts <= TIMESTAMP '{LAST}') WHERE rk = 1""")
def newest_in_steps(spark, sf):
    """Each user's newest event: the state of the first days, then two steps that read the days after it alone."""
    keys, values = ["user_id"], ["event_id", "event_type", "value"]
    state = S.newest_states(_events(spark, sf), keys, "ts", values, as_of=_moment(FIRST))
    for mark, as_of in ((FIRST, SECOND), (SECOND, LAST)):
        state = S.advanced(state, _events(spark, sf), keys, "ts", _moment(mark), _moment(as_of))
    return state


@states.query(f"""
SELECT user_id, {", ".join(f"max(ts) FILTER (event_type = '{k}') AS last_{k}" for k in KINDS_OF_EVENT)}
FROM events WHERE ts <= TIMESTAMP '{LAST}' GROUP BY user_id""")
def recency_in_steps(spark, sf):
    keys = ["user_id"]
    state = S.recency_states(_events(spark, sf), keys, "event_type", "ts", KINDS_OF_EVENT, as_of=_moment(FIRST))
    for mark, as_of in ((FIRST, SECOND), (SECOND, LAST)):
        state = S.advanced_recency(state, _events(spark, sf), keys, "event_type", "ts", KINDS_OF_EVENT, _moment(mark), _moment(as_of))
    return state


# Orders of 40 customer groups on four servers, counted month by month; server k starts again from zero in months 7 + k, 21 + k, ...
_MONTH, _MONTHS = "(year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1", 80


@states.query(f"""
WITH monthly AS (SELECT o_custkey % 40 AS object_id, count(*) FILTER ({_MONTH} > 0) AS seeks,
  coalesce(sum(o_orderkey) FILTER ({_MONTH} > 0), 0)::BIGINT AS updates FROM orders GROUP BY ALL)
SELECT 'srv' || (object_id % 4) AS server, object_id, seeks, updates,
  (SELECT count(*) FROM range(1, {_MONTHS}) AS m(month) WHERE (month - 7 - object_id % 4) % 14 = 0) AS restarts
FROM monthly""")
def counter_growth(spark, sf):
    """Growth of cumulative counters, from monthly snapshots of servers that restart now and then."""
    counted = read_table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("object_id"), F.expr(_MONTH).alias("month")).agg(
        F.count("*").alias("seeks"), F.sum("o_orderkey").alias("updates")
    )
    every = counted.select("object_id").distinct().withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(_MONTHS - 1))))
    monthly = every.join(counted, ["object_id", "month"], "left").fillna(0, ["seeks", "updates"])
    era = F.floor((F.col("month") - 7 - F.col("object_id") % 4) / 14)
    order = S.W.partitionBy("object_id", "era").orderBy("month")
    snapshots = monthly.withColumns({"server": F.concat(F.lit("srv"), (F.col("object_id") % 4).cast("string")), "era": era})
    snapshots = snapshots.withColumns({c: F.sum(c).over(order) for c in ("seeks", "updates")}).drop("era")
    steps = S.counter_steps(snapshots, ["server", "object_id"], "month", ["seeks", "updates"])
    return S.growth(steps, ["server", "object_id"], ["seeks", "updates"])


# Beginnings of part names and types, of many lengths, and some that nothing begins with.
_PREFIX_SQL = """prefixes AS (
SELECT left(p_name, 2 + (p_partkey % 12)::INT) AS expected_prefix FROM part UNION SELECT upper(left(p_type, 1 + (p_partkey % 9)::INT)) FROM part
UNION SELECT 'none ' || p_partkey FROM part WHERE p_partkey % 10 = 0), names AS (
SELECT p_partkey, p_name AS name FROM part UNION ALL SELECT -p_partkey, p_type FROM part)"""


@states.query(f"""WITH {_PREFIX_SQL}
SELECT expected_prefix, p_partkey, name, p_partkey IS NOT NULL AS found FROM prefixes LEFT JOIN names ON starts_with(lower(name), lower(expected_prefix))""")
def prefix_coverage(spark, sf):
    """Thousands of expected prefixes, joined by equality at their lengths."""
    part, key = read_table(spark, sf, "part"), F.col("p_partkey")
    prefixes = union_all(
        [
            part.select(F.left("p_name", (2 + key % 12).cast("int")).alias("expected_prefix")),
            part.select(F.upper(F.left("p_type", (1 + key % 9).cast("int"))).alias("expected_prefix")),
            part.filter(key % 10 == 0).select(F.concat(F.lit("none "), key.cast("string")).alias("expected_prefix")),
        ]
    )
    names = part.select("p_partkey", F.col("p_name").alias("name")).unionByName(part.select((-key).alias("p_partkey"), F.col("p_type").alias("name")))
    return O.prefix_coverage(names, "name", prefixes)


@states.query("""
SELECT doc_id, lang, CASE WHEN in_first THEN '2024-01-01' ELSE '2024-01-08' END AS first_seen,
  CASE WHEN in_second THEN '2024-01-08' ELSE '2024-01-01' END AS last_seen
FROM (SELECT CASE WHEN bool_or(doc_id % 3 < 2) THEN min(doc_id) FILTER (doc_id % 3 < 2) ELSE min(doc_id) END AS doc_id,
    bool_or(doc_id % 3 < 2) AS in_first, bool_or(doc_id % 3 > 0) AS in_second
  FROM documents GROUP BY lower(coalesce(text, ''))) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")
def findings_over_runs(spark, sf):
    """Two runs, each over two thirds of the documents: one row per text, with the first and the last run that had it."""
    documents = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    store = None
    for day, part in (("2024-01-01", F.col("doc_id") % 3 < 2), ("2024-01-08", F.col("doc_id") % 3 > 0)):
        store = N.remember(store, documents.filter(part), F.lit(day), ["doc_id"], ["text"])
    return store.select("doc_id", "lang", "first_seen", "last_seen")


_BACKUPS_SQL = """raw AS (
SELECT o_orderkey, 'srv' || (o_custkey % 3) AS server, CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE 'db' || o_custkey END AS database_name,
  left(o_orderstatus, 1) AS type, CASE WHEN o_orderkey % 31 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS finish_time
FROM orders), judged AS (
SELECT *, concat_ws('; ', CASE WHEN finish_time = 'n/a' THEN 'bad type: finish_time' END, CASE WHEN trim(database_name) = '' THEN 'missing key: database_name' END) AS reasons
FROM raw), clashes AS (SELECT server, database_name, type FROM judged WHERE reasons = '' GROUP BY ALL HAVING count(DISTINCT finish_time) > 1)"""


@states.query(f"""WITH {_BACKUPS_SQL}, all_reasons AS (
SELECT CASE WHEN reasons <> '' THEN reasons ELSE 'clashing key' END AS reasons, server, trim(database_name) AS database_name, type, finish_time
FROM judged LEFT JOIN clashes USING (server, database_name, type) WHERE reasons <> '' OR clashes.server IS NOT NULL)
SELECT reasons, server, database_name, type, finish_time, count(*) AS rows FROM all_reasons GROUP BY ALL""")
def quarantined_rows(spark, sf):
    """Backup rows as text that the declared schema turns away."""
    _, rejected = _backups(spark, sf)
    row = F.from_json("row", "server STRING, database_name STRING, type STRING, finish_time STRING")
    named = rejected.select("reasons", row.alias("r")).select("reasons", "r.*")
    return named.groupBy(*named.columns).agg(F.count("*").alias("rows"))


@states.query(f"""WITH {_BACKUPS_SQL}
SELECT server, database_name, max(finish_time::TIMESTAMP) FILTER (type = 'F') AS last_f, max(finish_time::TIMESTAMP) FILTER (type = 'O') AS last_o
FROM judged ANTI JOIN clashes USING (server, database_name, type) WHERE reasons = '' GROUP BY ALL""")
def recency_of_accepted(spark, sf):
    """The rows that pass feed the recency of each database."""
    accepted, _ = _backups(spark, sf)
    state = S.recency_states(accepted, ["server", "database_name"], "type", "finish_time", ["F", "O"])
    return state.select(
        "server", "database_name", F.col("last_F").cast("timestamp_ntz").alias("last_f"), F.col("last_O").cast("timestamp_ntz").alias("last_o")
    )


def _backups(spark, sf):
    key, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    raw = read_table(spark, sf, "orders").select(
        F.concat(F.lit("srv"), (F.col("o_custkey") % 3).cast("string")).alias("server"),
        F.when(key % 97 == 0, " ").otherwise(F.concat(F.lit("db"), text("o_custkey"))).alias("database_name"),
        F.left("o_orderstatus", F.lit(1)).alias("type"),
        F.when(key % 31 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("finish_time"),
    )
    return quarantine(raw, "backups", ["server", "database_name", "type"])
