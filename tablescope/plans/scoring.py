"""Queries: score, verdicts, recommendations and reports for the driver tables.

Table i (alphabetical) takes its shape from its own data, its usage from the
events of the users with user_id % 14 = i, and its statements from nation i.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions.columns import csv_field
from tablescope.functions.frames import constant_rows
from tablescope.operators import discover as D
from tablescope.operators import score as C
from tablescope.operators import shape as S
from tablescope.operators import workload as L
from tablescope.plans.registry import Registry
from tablescope.plans.shape import SIZES_SQL, WITH_PROFILE, full_profile, table_sizes
from tablescope.plans.statements import CLASSES_SQL, matches, matches_sql
from tablescope.plans.tables import SHAPE_SQL, TABLES, VERDICT_SQL, read_table
from tablescope.sources import sinks

scoring = Registry()

COUNTERS = [
    "user_seeks", "user_scans", "user_lookups", "user_updates", "missing_index_suggestions", "row_lock_wait_ms",
    "page_lock_wait_ms", "page_io_latch_wait_ms", "leaf_inserts", "leaf_updates", "leaf_deletes",
]


def _usage(spark, sf):
    i, kind, value = F.col("i"), F.col("event_type"), F.col("value")
    return (
        read_table(spark, sf, "events")
        .withColumn("i", (F.col("user_id") % 14).cast("int"))
        .groupBy("i")
        .agg(
            F.count_if(kind == "view").alias("user_seeks"),
            F.count_if(kind == "click").alias("user_scans"),
            F.count_if(kind == "signup").alias("user_lookups"),
            F.count_if((kind == "purchase") & (value > 8 * i)).alias("user_updates"),
            F.count_if((kind == "error") & (value > 250)).alias("missing_index_suggestions"),
            F.coalesce(F.sum(F.when(kind == "click", F.floor("value") * 10 * i)), F.lit(0)).alias("row_lock_wait_ms"),
            F.lit(0).cast("bigint").alias("page_lock_wait_ms"),
            F.sum(F.floor("value") * 2).alias("page_io_latch_wait_ms"),
            F.count_if(kind == "signup").alias("leaf_inserts"),
            F.count_if((kind == "purchase") & (value > 40 * i)).alias("leaf_updates"),
            F.count_if((kind == "error") & (value > 200) & (i % 2 == 0)).alias("leaf_deletes"),
        )
    )


def scored(spark, sf, profile=None):
    """Metrics and score of each table."""
    profile = full_profile(spark, sf) if profile is None else profile
    i = F.col("i")
    numbered = constant_rows(spark, list(enumerate(TABLES)), "i INT, table STRING")
    base = (
        numbered.join(S.table_shape(profile).drop("computed_columns"), "table")
        .join(table_sizes(profile), "table")
        .join(_usage(spark, sf), "i", "left")
        .fillna(0, COUNTERS)
        .withColumns(
            {
                "nonclustered_mb": F.col("base_data_mb") * (i % 4) / 2,
                "has_columnstore": i % 5 == 4,
                "is_replicated": i % 3 == 0,
                "is_cdc_tracked": i % 4 == 1,
                "computed_columns": i % 3,
            }
        )
    )
    return C.score_tables(D.size_ratios(D.write_ratios(D.usage_ratios(base))))


def judged(spark, sf):
    """Scored tables with aggregation evidence."""
    evidence = (
        L.heaviest_statement(matches(spark, sf))
        .filter(F.col("table") < 14)
        .select(F.col("table").alias("i"), "has_aggregation")
    )
    return scored(spark, sf).join(evidence, "i", "left").fillna(False, ["has_aggregation"])


SCORED_SQL = f"""{SIZES_SQL}, shaped AS ({SHAPE_SQL}), used AS (
SELECT user_id % 14 AS i, count(*) FILTER (event_type = 'view') AS user_seeks,
  count(*) FILTER (event_type = 'click') AS user_scans, count(*) FILTER (event_type = 'signup') AS user_lookups,
  count(*) FILTER (event_type = 'purchase' AND value > 8 * (user_id % 14)) AS user_updates,
  count(*) FILTER (event_type = 'error' AND value > 250) AS missing_index_suggestions,
  coalesce(sum(floor(value)::BIGINT * 10 * (user_id % 14)) FILTER (event_type = 'click'), 0)::BIGINT AS row_lock_wait_ms,
  0::BIGINT AS page_lock_wait_ms, sum(floor(value)::BIGINT * 2)::BIGINT AS page_io_latch_wait_ms,
  count(*) FILTER (event_type = 'signup') AS leaf_inserts,
  count(*) FILTER (event_type = 'purchase' AND value > 40 * (user_id % 14)) AS leaf_updates,
  count(*) FILTER (event_type = 'error' AND value > 200 AND user_id % 14 % 2 = 0) AS leaf_deletes
FROM events GROUP BY 1), metrics AS (
SELECT *, base_data_mb * (i % 4) / 2 AS nonclustered_mb, i % 5 = 4 AS has_columnstore, i % 3 = 0 AS is_replicated,
  i % 4 = 1 AS is_cdc_tracked,
  user_seeks + user_scans + user_lookups AS reads, leaf_inserts + leaf_updates + leaf_deletes AS writes
FROM (SELECT "table", list_position([{", ".join(f"'{t}'" for t in TABLES)}], "table") - 1 AS i, * EXCLUDE ("table", computed_columns)
  FROM shaped) JOIN sizes USING ("table") JOIN used USING (i)
), rated AS (
SELECT *, 100.0 * user_scans / reads::DOUBLE AS scan_pct, 100.0 * user_updates / (reads + user_updates)::DOUBLE AS write_pct,
  100.0 * leaf_updates / writes::DOUBLE AS update_share_pct, nonclustered_mb / base_data_mb AS index_bloat_ratio,
  row_count::DOUBLE / 1048576.0 AS potential_rowgroups FROM metrics
), scored AS (SELECT *, CASE WHEN has_columnstore THEN 0.0::DOUBLE ELSE round_even(greatest(0.0, least(100.0,
    least(40.0, pct_low * 0.25::DOUBLE + pct_medium * 0.15::DOUBLE)
    + CASE WHEN potential_rowgroups >= 100 THEN 15 WHEN potential_rowgroups >= 20 THEN 12 WHEN potential_rowgroups >= 5 THEN 8
        WHEN potential_rowgroups >= 3 THEN 4 ELSE 0 END
    + scan_pct * 0.20::DOUBLE
    + CASE WHEN index_bloat_ratio >= 2 THEN 15 WHEN index_bloat_ratio >= 1 THEN 11 WHEN index_bloat_ratio >= 0.5 THEN 6
        ELSE index_bloat_ratio * 12 END
    + CASE WHEN row_lock_wait_ms >= 3600000 THEN 6 WHEN row_lock_wait_ms >= 60000 THEN 4 WHEN row_lock_wait_ms > 0 THEN 2 ELSE 0 END
    + CASE WHEN missing_index_suggestions >= 5 THEN 4 WHEN missing_index_suggestions >= 1 THEN 2 ELSE 0 END
    - CASE WHEN write_pct >= 50 THEN 30 WHEN write_pct >= 25 THEN 15 WHEN write_pct >= 10 THEN 5 ELSE 0 END
    - CASE WHEN update_share_pct >= 50 THEN 15 WHEN update_share_pct >= 20 THEN 8 ELSE 0 END
    - least(15, dictionary_pressure_columns * 5) - CASE WHEN lob_columns > 0 THEN 5 ELSE 0 END)), 1) END AS candidacy_score
FROM rated)"""

NOTES_SQL = """CASE WHEN has_columnstore THEN 'Already has a columnstore index' ELSE concat_ws('; ',
  CASE WHEN pct_low >= 50 THEN round(pct_low)::BIGINT || '% of columns are highly repetitive (<=1% distinct) - excellent compression expected'
    WHEN pct_medium >= 50 THEN round(pct_medium)::BIGINT || '% of columns are repetitive (<=10% distinct) - good compression expected'
    WHEN sampled_rows > 0 THEN 'Data is mostly high-cardinality - compression benefit will be modest' END,
  CASE WHEN potential_rowgroups < 3 THEN 'CAUTION: only ~' || regexp_replace(round(potential_rowgroups, 1)::VARCHAR, '\\.0$', '')
    || ' potential rowgroups (' || format('{:,}', row_count) || ' rows) - likely too small to benefit' END,
  CASE WHEN scan_pct >= 50 THEN 'scan-heavy access pattern' END,
  CASE WHEN index_bloat_ratio >= 1 THEN 'NC indexes (' || format('{:,}', round(nonclustered_mb)::BIGINT) || ' MB) outweigh base data ('
    || format('{:,}', round(base_data_mb)::BIGINT) || ' MB) - big reclaim potential' END,
  CASE WHEN write_pct >= 50 THEN 'CAUTION: write-heavy - consider nonclustered columnstore instead of clustered'
    WHEN write_pct >= 25 THEN 'write activity is significant - test delta-store behavior' END,
  CASE WHEN update_share_pct >= 50 THEN 'CAUTION: UPDATE-dominated writes fragment columnstore quickly'
    WHEN update_share_pct >= 20 THEN 'noticeable UPDATE share - plan for index maintenance' END,
  CASE WHEN dictionary_pressure_columns > 0 THEN 'CAUTION: ' || dictionary_pressure_columns
    || ' high-cardinality wide string column(s) risk dictionary pressure / trimmed rowgroups' END,
  CASE WHEN lob_columns > 0 THEN lob_columns || ' LOB/unsupported column(s) present - verify columnstore compatibility on your version' END,
  CASE WHEN is_replicated THEN 'NOTE: table is replicated' END, CASE WHEN is_cdc_tracked THEN 'NOTE: table is CDC-tracked' END,
  CASE WHEN page_io_latch_wait_ms > 60000
    THEN 'high PAGEIOLATCH waits - IO-bound scans; columnstore compression usually helps here' END) END AS notes"""

JUDGED_SQL = f"""{SCORED_SQL}, {matches_sql(20)}, evidence AS (
SELECT "table" AS i, bool_or(is_aggregation) AS has_aggregation
FROM (SELECT *, {CLASSES_SQL} FROM matched) WHERE NOT is_own GROUP BY 1
), judged AS (
SELECT scored.*, coalesce(has_aggregation, false) AS has_aggregation,
  leaf_inserts > 0 AND leaf_updates = 0 AND leaf_deletes = 0 AS append
FROM scored LEFT JOIN evidence USING (i))"""

RATIOS = ["scan_pct", "write_pct", "update_share_pct", "index_bloat_ratio", "potential_rowgroups"]
_ROUNDED_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in RATIOS)
_rounded = lambda: [F.round(c, 6).alias(c) for c in RATIOS]


@scoring.query(f'{WITH_PROFILE}, {SCORED_SQL} SELECT "table", {_ROUNDED_SQL}, candidacy_score FROM scored')
def candidacy_score(spark, sf):
    return scored(spark, sf).select("table", *_rounded(), "candidacy_score")


@scoring.query(f'{WITH_PROFILE}, {SCORED_SQL} SELECT "table", {NOTES_SQL} FROM scored')
def candidacy_notes(spark, sf):
    return scored(spark, sf).select("table", "notes")


@scoring.query(f"""{WITH_PROFILE}, {JUDGED_SQL}
SELECT "table", candidacy_score, has_aggregation, CASE WHEN has_columnstore THEN 'already columnstore'
  WHEN candidacy_score >= 55 THEN 'STRONG COLUMNSTORE CANDIDATE'
  WHEN candidacy_score >= 35 AND has_aggregation THEN 'GENUINE COLUMNSTORE CANDIDATE (workload evidence supports it)'
  WHEN candidacy_score >= 35 THEN 'PROMISING CANDIDATE — test it'
  WHEN candidacy_score >= 15 AND append AND pct_medium >= 50 AND potential_rowgroups >= 3
    THEN 'MARGINAL — compression win possible, low priority'
  WHEN candidacy_score >= 20 THEN 'MARGINAL'
  WHEN potential_rowgroups < 3 THEN 'NOT A CANDIDATE (too small / wrong shape)'
  ELSE 'NOT A COLUMNSTORE CANDIDATE' END AS verdict
FROM judged""")
def verdict_tier(spark, sf):
    return judged(spark, sf).select("table", "candidacy_score", "has_aggregation", C.verdict_tier().alias("verdict"))


@scoring.query(f"""{WITH_PROFILE}, {JUDGED_SQL}
SELECT "table", recommendation, CASE WHEN recommendation = 'convert' THEN concat_ws('; ',
  CASE WHEN i % 3 > 0 THEN 'drop computed columns first' END, 'order the data by ' || clustering_column,
  CASE WHEN append THEN 'reorganize periodically' END,
  CASE WHEN write_pct >= 25 AND NOT append THEN 'test a nonclustered columnstore first' END) ELSE '' END AS migration_steps
FROM (SELECT *, CASE WHEN has_columnstore THEN NULL WHEN candidacy_score >= 35 THEN 'convert'
  WHEN candidacy_score >= 20 AND append AND potential_rowgroups >= 3 THEN 'later' ELSE 'leave' END AS recommendation
  FROM judged)""")
def recommendation(spark, sf):
    return C.recommendation(judged(spark, sf)).select(
        "table", "recommendation", F.array_join("migration_steps", "; ").alias("migration_steps")
    )


RANKED = [
    "table", "candidacy_score", "row_count", "pct_low", "pct_medium", "median_duplication_factor",
    "dictionary_pressure_columns", "lob_columns", "sampled_rows", "has_columnstore", *COUNTERS,
]


@scoring.query(f"""{WITH_PROFILE}, {SCORED_SQL}
SELECT {", ".join(f'"{c}"' for c in RANKED)}, {_ROUNDED_SQL}, round(base_data_mb, 3) AS base_data_mb,
  round(nonclustered_mb, 3) AS nonclustered_mb, {NOTES_SQL} FROM scored""")
def ranked_candidates(spark, sf):
    megabytes = [F.round(c, 3).alias(c) for c in ["base_data_mb", "nonclustered_mb"]]
    return C.ranked_candidates(scored(spark, sf)).select(*RANKED, *_rounded(), *megabytes, "notes")


@scoring.query(f"""{WITH_PROFILE}, {SCORED_SQL}
SELECT count(*) FILTER (NOT has_columnstore AND candidacy_score >= 55) AS strong,
  count(*) FILTER (NOT has_columnstore AND candidacy_score >= 35 AND candidacy_score < 55) AS worth_testing,
  count(*) FILTER (has_columnstore) AS already_columnar FROM scored""")
def portfolio_counts(spark, sf):
    return C.portfolio_counts(scored(spark, sf))


def _report_parts(spark, sf):
    profile = full_profile(spark, sf)
    named = constant_rows(spark, list(enumerate(TABLES)), "i INT, table STRING")
    log = (
        matches(spark, sf).withColumnRenamed("table", "i").join(F.broadcast(named), "i").drop("i", "server")
    )
    return scored(spark, sf, profile), profile, log


@scoring.query(f"""{WITH_PROFILE}, {SCORED_SQL}, {matches_sql(20)}, cols AS (
SELECT "table", to_json(list({{'column': "column", 'distinct_values': distinct_values, 'null_count': null_count,
    'verdict': {VERDICT_SQL}}} ORDER BY ordinal))::VARCHAR AS "columns" FROM profile GROUP BY 1
), logged AS (
SELECT "table" AS i, to_json(list({{'source': source, 'total_logical_reads': total_logical_reads, 'statement_text': statement_text}}
    ORDER BY source, total_logical_reads DESC, statement_text))::VARCHAR AS referencing_queries FROM matched GROUP BY 1)
SELECT "table", candidacy_score, "columns", referencing_queries
FROM scored JOIN cols USING ("table") JOIN logged USING (i)""")
def nested_report(spark, sf):
    tables, profile, log = _report_parts(spark, sf)
    report = sinks.nested_report(tables, profile, statements=log)
    # The comparison takes a few fields of each nested row, as JSON text.
    shown = lambda nested, *fields: F.to_json(
        F.transform(nested, lambda row: F.struct(*[row[f].alias(f) for f in fields]))
    ).alias(nested)
    return report.select(
        "table", "candidacy_score", shown("columns", "column", "distinct_values", "null_count", "verdict"),
        shown("referencing_queries", "source", "total_logical_reads", "statement_text"),
    )


@scoring.query(f"""{WITH_PROFILE}, {SCORED_SQL}, {matches_sql(20)}, cols AS (
SELECT "table", list({{'name': "column", 'type': data_type, 'analyzed': analyzed, 'distinct': distinct_values,
    'duplicationFactor': round_even(duplication_factor, 1)::DECIMAL(18,1), 'nulls': null_count,
    'avgBytes': round_even(avg_byte_length, 1)::DECIMAL(18,1), 'computed': false, 'lob': is_lob, 'verdict': {VERDICT_SQL}}}
    ORDER BY ordinal) AS "columns" FROM profile GROUP BY 1
), tops AS (
SELECT i, list({{'execs': execution_count, 'reads': total_logical_reads, 'cpuMs': round_even(total_cpu_ms, 0)::BIGINT,
    'text': statement_text}} ORDER BY total_logical_reads DESC, statement_text) AS "topQueries"
FROM (SELECT "table" AS i, *, row_number() OVER (PARTITION BY "table"
  ORDER BY total_logical_reads DESC, statement_text, source) AS rk FROM matched) WHERE rk <= 5 GROUP BY 1)
SELECT "table", to_json({{'table': "table", 'score': candidacy_score::DECIMAL(18,1), 'rows': row_count,
  'baseDataMb': round_even(base_data_mb, 1)::DECIMAL(18,1), 'ncIndexMb': round_even(nonclustered_mb, 1)::DECIMAL(18,1),
  'hasColumnstore': has_columnstore, 'scanPct': round_even(scan_pct, 1)::DECIMAL(18,1),
  'writePct': round_even(write_pct, 1)::DECIMAL(18,1), 'updateShareOfWritesPct': round_even(update_share_pct, 1)::DECIMAL(18,1),
  'seeks': user_seeks, 'scans': user_scans, 'lookups': user_lookups, 'writes': user_updates, 'leafInserts': leaf_inserts,
  'leafUpdates': leaf_updates, 'leafDeletes': leaf_deletes, 'ioLatchWaitMs': page_io_latch_wait_ms, 'notes': notes,
  'columns': "columns", 'topQueries': "topQueries"}})::VARCHAR AS digest
FROM (SELECT *, {NOTES_SQL} FROM scored) JOIN cols USING ("table") JOIN tops USING (i)""")
def table_digest(spark, sf):
    tables, profile, log = _report_parts(spark, sf)
    return sinks.table_digest(tables, profile, statements=log)


@scoring.query("""
SELECT doc_id, CASE WHEN contains(t, ',') OR contains(t, '"') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS field
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') AS t FROM documents)""")
def csv_normalise(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", csv_field(F.col("text")).alias("field"))


def _quoted_sql(text: str) -> str:
    return f"""CASE WHEN contains({text}, ',') OR contains({text}, '"') THEN '"' || replace({text}, '"', '""') || '"' ELSE {text} END"""


def _plain_sql(number: str, places: int) -> str:
    return f"regexp_replace(regexp_replace(({number})::DECIMAL(18,{places})::VARCHAR, '0+$', ''), '\\.$', '')"


@scoring.query(f"""
SELECT concat_ws(',', id, {_quoted_sql("clean")}, {_quoted_sql("cut")}, {_plain_sql("(id % 1000) / 1024.0", 4)}, {_plain_sql("id / 8.0", 2)},
  '"[' || id || ',' || n || ']"', '"' || lang || ', ' || source || '"') AS line
FROM (SELECT *, CASE WHEN length(clean) > 30 THEN left(clean, 30) || '...' ELSE clean END AS cut
  FROM (SELECT doc_id AS id, n_chars AS n, lang, source, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS clean FROM documents))""")
def csv_rows(spark, sf):
    """Lines of the CSV sink: long statements, numbers, lists of numbers and of texts."""
    documents = read_table(spark, sf, "documents")
    rows = documents.select(
        "doc_id", "text", F.col("text").alias("statement_text"), ((F.col("doc_id") % 1000) / 1024).alias("distinct_ratio"),
        (F.col("doc_id") / 8).alias("mean"), F.array("doc_id", "n_chars").alias("numbers"), F.array("lang", "source").alias("names"),
    )
    return sinks.csv_lines(rows, statement_chars=30)
