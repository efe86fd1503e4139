"""Queries: column profile and table shape over every driver table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.constants import SKIP_COMPUTED, SKIP_LOB
from tablescope.functions.frames import union_all
from tablescope.functions.widths import byte_length
from tablescope.operators import profile as P
from tablescope.operators import shape as S
from tablescope.plans.registry import Registry
from tablescope.plans.tables import (
    KINDS, SHAPE_SQL, TABLES, VERDICT_SQL, columns_of, profile_sql, read_table, read_tables,
)

# Estimates and the jackpot column are shown for tables as if they held this
# many times their rows, so that the reporting thresholds are reached.
SCALE = 1000
SAMPLE_TARGET = 1500

PROFILE_COLUMNS = [
    "table", "column", "ordinal", "data_type", "analyzed", "skip_reason", "sample_rows",
    "distinct_values", "null_count", "avg_byte_length", "distinct_ratio", "duplication_factor",
    "dictionary_pressure", "verdict",
]


def full_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile_columns(read_tables(spark, sf, TABLES))


def column_profile(spark, sf):
    return full_profile(spark, sf).select(PROFILE_COLUMNS)


def column_eligibility(spark, sf):
    return P.column_eligibility(
        read_tables(spark, sf, TABLES), computed_columns=[("documents", "n_chars")]
    ).drop("is_date")


def sampled_profile(spark, sf):
    orders = read_table(spark, sf, "orders")
    sample = P.sample_table(orders, orders.count(), SAMPLE_TARGET, key="o_orderkey")
    return P.profile_columns({"orders": sample}).select(PROFILE_COLUMNS)


def case_insensitive_profile(spark, sf):
    """Distinct values of every text column under a case-insensitive comparison."""
    tables = {t: read_table(spark, sf, t).select(*_text_columns(t)) for t in TABLES if _text_columns(t)}
    return P.profile_columns(tables, case_insensitive=True).select("table", "column", "sample_rows", "distinct_values")


def _text_columns(table: str) -> list[str]:
    return [column for column, kind in columns_of(table) if kind == "text"]


def approx_profile(spark, sf):
    """Sketched profile of every column. A fifth is four standard errors of the sketch."""
    tables = read_tables(spark, sf, TABLES)
    exact = P.profile_columns(tables).select("table", "column", F.col("distinct_values").alias("exact_values"))
    off = F.abs(F.col("distinct_values") - F.col("exact_values"))
    return P.profile_columns(tables, approx=True).join(exact, ["table", "column"]).select(
        "table", "column", "sample_rows", "null_count", "avg_byte_length",
        (off <= F.col("exact_values") / 5).alias("within_a_fifth"),
    )


def table_sizes(profile: DataFrame, scale: int = SCALE) -> DataFrame:
    """Stand-in size catalog: scaled rows, and base MB from the measured lengths."""
    return (
        S.measured(profile)
        .groupBy("table")
        .agg(
            (F.max("sample_rows") * scale).alias("row_count"),
            (F.sum(F.round(F.col("avg_byte_length") * F.col("sample_rows")).cast("bigint"))
             .cast("double") * scale / S.MEGABYTE).alias("base_data_mb"),
        )
    )


def table_shape(spark, sf):
    return S.table_shape(full_profile(spark, sf)).drop("compressed_row_bytes")


def compressed_estimate(spark, sf):
    profile = full_profile(spark, sf)
    return S.compressed_estimate(S.table_shape(profile), table_sizes(profile)).select(
        "table", "row_count",
        F.round("base_data_mb", 3).alias("base_data_mb"),
        F.round("compressed_mb", 3).alias("compressed_mb"),
        "worth_reporting",
    )


def shape_highlights(spark, sf):
    return S.shape_highlights(full_profile(spark, sf)).select(
        "table",
        F.array_join("star_columns", ", ").alias("star_columns"),
        "good_columns",
        F.array_join("near_unique_columns", ", ").alias("near_unique_columns"),
    )


def jackpot_column(spark, sf):
    # The text columns of the driver tables are short: ask for 6 bytes, not 20.
    profile = full_profile(spark, sf)
    sizes = table_sizes(profile)
    return S.jackpot_column(profile, sizes, min_bytes=6).withColumn(
        "payload_mb", F.round("payload_mb", 4)
    )


def clustering_column(spark, sf):
    return S.clustering_column(P.column_eligibility(read_tables(spark, sf, TABLES)))


def top_columns(spark, sf):
    return S.top_columns(full_profile(spark, sf))


def stored_bytes(spark, sf):
    """Stored bytes of every column, null for nested ones: one pass over each table."""
    parts = []
    for table, df in read_tables(spark, sf, TABLES).items():
        sums = df.agg(*[F.sum(byte_length(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema])
        cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("stored_bytes")) for c in df.columns]
        parts.append(sums.select(F.lit(table).alias("table"), F.inline(F.array(*cells))))
    return union_all(parts)


def _bytes_sql() -> str:
    size = {"text": "sum(strlen({c}))", "lob": "max(NULL::BIGINT)", **{k: f"nullif({w} * count({{c}}), 0)" for k, (_, w) in KINDS.items() if w}}
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", ({size[kind].format(c=c)})::BIGINT AS stored_bytes FROM {table}"
        for table in TABLES for c, kind in columns_of(table)
    )


WITH_PROFILE = f"WITH profile AS ({profile_sql()})"

SIZES_SQL = f"""sizes AS (
SELECT "table", max(sample_rows) * {SCALE} AS row_count,
  sum(round(avg_byte_length * sample_rows)::BIGINT)::DOUBLE * {SCALE} / 1048576.0 AS base_data_mb
FROM profile WHERE analyzed GROUP BY "table")"""

_PROFILE_SELECT = f"""SELECT "table", "column", ordinal, data_type, analyzed, skip_reason, sample_rows, distinct_values,
  null_count, avg_byte_length, distinct_ratio, duplication_factor, dictionary_pressure, {VERDICT_SQL} AS verdict
FROM profile"""


def _eligibility_sql() -> str:
    rows = []
    for t in TABLES:
        for i, (c, k) in enumerate(columns_of(t)):
            computed = (t, c) == ("documents", "n_chars")
            reason = SKIP_LOB if k == "lob" else SKIP_COMPUTED if computed else ""
            rows.append(
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {i} AS ordinal, '{KINDS[k][0]}' AS data_type,"
                f" {k == 'lob'} AS is_lob, {computed} AS is_computed, count(*) AS table_rows,"
                f" {k != 'lob' and not computed} AND count(*) > 0 AS analyzed, '{reason}' AS skip_reason FROM {t}"
            )
    return " UNION ALL ".join(rows)


def _folded_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS sample_rows,"
        f" count(DISTINCT lower({c})) AS distinct_values FROM {t}"
        for t in TABLES
        for c in _text_columns(t)
    )


_ORACLES = {
    "column_profile": f"{WITH_PROFILE} {_PROFILE_SELECT}",
    "column_eligibility": _eligibility_sql(),
    "sampled_profile": f"""WITH sampled AS (
  SELECT * FROM orders, (SELECT count(*) AS total FROM orders) AS t
  WHERE total <= 2 * {SAMPLE_TARGET}
     OR ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 1000000
        < round(round(greatest(0.1, least(100.0, 100.0 * {SAMPLE_TARGET} / total)), 4) * 10000)
), profile AS ({profile_sql(["orders"], "sampled")}) {_PROFILE_SELECT}""",
    "case_insensitive_profile": _folded_sql(),
    "stored_bytes": _bytes_sql(),
    "approx_profile": f"""{WITH_PROFILE}
SELECT "table", "column", sample_rows, null_count, avg_byte_length, true AS within_a_fifth FROM profile""",
    "table_shape": f"{WITH_PROFILE} {SHAPE_SQL}",
    "compressed_estimate": f"""{WITH_PROFILE}, {SIZES_SQL}
SELECT *, compressed_mb > 0 AND base_data_mb > 50 AND compressed_mb < base_data_mb * 0.6 AS worth_reporting
FROM (SELECT s."table", row_count, round(base_data_mb, 3) AS base_data_mb,
  round(sum(avg_byte_length * row_count * CASE WHEN duplication_factor >= 1000 THEN 0.02
    WHEN duplication_factor >= 100 THEN 0.05 WHEN duplication_factor >= 10 THEN 0.15 ELSE 0.5 END::DOUBLE)
    / 1048576.0, 3) AS compressed_mb
  FROM profile p JOIN sizes s ON s."table" = p."table" WHERE analyzed GROUP BY s."table", row_count, base_data_mb)""",
    "shape_highlights": f"""{WITH_PROFILE}, ranked AS (
SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY duplication_factor DESC, ordinal) AS rk
FROM profile WHERE analyzed)
SELECT "table",
  coalesce(string_agg("column", ', ' ORDER BY rk) FILTER (duplication_factor >= 100 AND rk <= 4), '') AS star_columns,
  count(*) FILTER (duplication_factor >= 10 AND duplication_factor < 100) AS good_columns,
  coalesce(string_agg("column", ', ' ORDER BY ordinal) FILTER (distinct_ratio >= 0.9), '') AS near_unique_columns
FROM ranked GROUP BY "table\"""",
    "jackpot_column": f"""{WITH_PROFILE}, {SIZES_SQL}, wide AS (
SELECT p.*, s.row_count, row_number() OVER (PARTITION BY p."table"
  ORDER BY avg_byte_length * row_count DESC, ordinal) AS rk
FROM profile p JOIN sizes s ON s."table" = p."table"
WHERE is_string AND analyzed AND avg_byte_length >= 6 AND duplication_factor >= 50)
SELECT "table", "column", distinct_values, avg_byte_length,
  round(avg_byte_length * row_count / 1048576.0, 4) AS payload_mb FROM wide WHERE rk = 1""",
    "clustering_column": f"""{WITH_PROFILE}
SELECT "table", arg_min("column", ordinal) AS clustering_column FROM profile
WHERE analyzed AND is_date GROUP BY "table\"""",
    "top_columns": f"""{WITH_PROFILE}
SELECT * FROM (SELECT "table", row_number() OVER (PARTITION BY "table" ORDER BY duplication_factor DESC, ordinal)::INTEGER
  AS rank, "column", duplication_factor, distinct_values FROM profile WHERE analyzed) WHERE rank <= 8""",
}

shape = Registry()
for _query in [
    column_profile, column_eligibility, sampled_profile, case_insensitive_profile, approx_profile,
    table_shape, compressed_estimate, shape_highlights, jackpot_column, clustering_column, top_columns, stored_bytes,
]:
    shape.query(_ORACLES.get(_query.__name__))(_query)
