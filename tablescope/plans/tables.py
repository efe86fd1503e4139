"""The driver's tables: names, column kinds, and the SQL twin of the column profile."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tablescope.functions.constants import SKIP_LOB

# (column, kind) per table, in schema order; kind -> (Spark type, storage bytes).
KINDS = {
    "i8": ("bigint", 8),
    "i4": ("int", 4),
    "f8": ("double", 8),
    "ts": ("timestamp_ntz", 8),
    "text": ("string", None),
    "lob": ("array<float>", None),
}

COLUMNS = {
    "benchmark": "item_id:i8 text:text",
    "conversations": "conv_id:i8 turn:i8 role:text text:text",
    "customer": "c_custkey:i8 c_name:text c_nationkey:i4 c_acctbal:f8 c_mktsegment:text",
    "documents": "doc_id:i8 text:text lang:text source:text n_chars:i8",
    "embeddings": "vec_id:i8 embedding:lob label:i4",
    "events": "event_id:i8 ts:ts user_id:i8 event_type:text value:f8 props:text",
    "labels": "doc_id:i8 quality:i4 toxic:i4",
    "lineitem": "l_orderkey:i8 l_partkey:i8 l_suppkey:i8 l_linenumber:i4 l_quantity:f8 l_extendedprice:f8"
    " l_discount:f8 l_tax:f8 l_returnflag:text l_linestatus:text l_shipdate:ts",
    "nation": "n_nationkey:i4 n_name:text n_regionkey:i4",
    "orders": "o_orderkey:i8 o_custkey:i8 o_orderstatus:text o_totalprice:f8 o_orderdate:ts o_orderpriority:text",
    "pages": "page_id:i8 url:text html:text",
    "part": "p_partkey:i8 p_name:text p_brand:text p_type:text p_size:i4 p_retailprice:f8",
    "region": "r_regionkey:i4 r_name:text",
    "supplier": "s_suppkey:i8 s_name:text s_nationkey:i4 s_acctbal:f8",
}
TABLES = list(COLUMNS)


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(entry.split(":")) for entry in COLUMNS[table].split()]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read with the known schema: no job to infer it from the file footers."""
    ddl = ", ".join(f"{column} {KINDS[kind][0]}" for column, kind in columns_of(name))
    return spark.read.schema(ddl).parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}


def profile_sql(tables=TABLES, source=None) -> str:
    """One naive SELECT per column: count(distinct ...), count(...), mean length."""
    parts = []
    for table in tables:
        rel = source or table
        for ordinal, (column, kind) in enumerate(columns_of(table)):
            spark_type, width = KINDS[kind]
            if kind == "lob":
                stats = "0 AS sample_rows, 0 AS distinct_values, 0 AS null_count, 0.0::DOUBLE AS avg_byte_length"
                flags = f"false AS analyzed, '{SKIP_LOB}' AS skip_reason"
            else:
                mean = (
                    f"coalesce(sum(strlen({column}))::DOUBLE / nullif(count({column}), 0)::DOUBLE, 0.0)"
                    if kind == "text"
                    else f"CASE WHEN count({column}) = 0 THEN 0.0 ELSE {width}.0 END::DOUBLE"
                )
                stats = (
                    f"count(*) AS sample_rows, count(DISTINCT {column}) AS distinct_values,"
                    f" count(*) - count({column}) AS null_count, {mean} AS avg_byte_length"
                )
                flags = "count(*) > 0 AS analyzed, '' AS skip_reason"
            parts.append(
                f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", {ordinal} AS ordinal,"
                f" '{spark_type}' AS data_type, {kind == 'text'} AS is_string, {kind == 'ts'} AS is_date,"
                f" {kind == 'lob'} AS is_lob, {flags}, {stats}"
                + ("" if kind == "lob" else f" FROM {rel}")
            )
    union = "\nUNION ALL\n".join(parts)
    return f"""
SELECT *, is_string AND analyzed AND distinct_ratio > 0.5 AND avg_byte_length > 16 AS dictionary_pressure
FROM (SELECT *,
  CASE WHEN sample_rows - null_count <= 0 THEN 0.0
       ELSE distinct_values::DOUBLE / (sample_rows - null_count)::DOUBLE END AS distinct_ratio,
  CASE WHEN distinct_values = 0 THEN 0.0
       ELSE (sample_rows - null_count)::DOUBLE / distinct_values::DOUBLE END AS duplication_factor
  FROM ({union}) AS counted) AS rated"""


VERDICT_SQL = """CASE WHEN NOT analyzed THEN skip_reason
  WHEN duplication_factor >= 100 THEN 'EXCELLENT - highly repetitive, compresses extremely well'
  WHEN duplication_factor >= 10 THEN 'GOOD - solid run-length/dictionary compression expected'
  WHEN dictionary_pressure THEN 'BAD - high-cardinality wide string, dictionary pressure risk'
  WHEN distinct_ratio > 0.9 THEN 'POOR - nearly unique values, little compression benefit'
  ELSE 'NEUTRAL' END"""

SHAPE_SQL = """
SELECT "table", count(*) FILTER (analyzed) AS analyzed_columns,
  coalesce(max(sample_rows) FILTER (analyzed), 0) AS sampled_rows,
  100.0 * (count(*) FILTER (analyzed AND distinct_ratio <= 0.01))::DOUBLE / count(*) FILTER (analyzed) AS pct_low,
  100.0 * (count(*) FILTER (analyzed AND distinct_ratio <= 0.10))::DOUBLE / count(*) FILTER (analyzed) AS pct_medium,
  list_sort(list(duplication_factor) FILTER (analyzed))[(count(*) FILTER (analyzed)) // 2 + 1] AS median_duplication_factor,
  count(*) FILTER (analyzed AND dictionary_pressure) AS dictionary_pressure_columns,
  count(*) FILTER (is_lob) AS lob_columns, 0::BIGINT AS computed_columns,
  arg_min("column", ordinal) FILTER (analyzed AND is_date) AS clustering_column
FROM profile GROUP BY "table\""""
