"""Candidate tables: sizes, usage counters, contention and existence flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import megabytes_from_pages, safe_div, safe_pct
from tablescope.functions.constants import MIN_MB, MIN_ROWS, ROWGROUP_ROWS, TOP_TABLES
from tablescope.functions.frames import top_k

TABLE_KEY = ["server", "object_id"]
USAGE = ["user_seeks", "user_scans", "user_lookups", "user_updates"]


def _sum0(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def discover_tables(
    tables: DataFrame,
    schemas: DataFrame,
    partition_stats: DataFrame,
    min_rows: int = MIN_ROWS,
    min_mb: int = MIN_MB,
    top_n: int = TOP_TABLES,
) -> DataFrame:
    """Largest user tables of each server.

    Partition rows are summed per table before any join, and small tables are
    dropped there; the size limit compares whole megabytes.
    """
    base = F.col("index_id").isin(0, 1)
    pages = F.col("reserved_page_count")
    sized = (
        partition_stats.groupBy(*TABLE_KEY)
        .agg(
            _sum0(F.when(base, F.col("row_count"))).alias("row_count"),
            _sum0(pages).alias("_total"),
            _sum0(F.when(base, pages)).alias("_base"),
            _sum0(F.when(F.col("index_id") > 1, pages)).alias("_other"),
        )
        .filter((F.col("row_count") >= min_rows) | (F.floor(F.col("_total") * 8 / 1024) >= min_mb))
        .select(
            *TABLE_KEY,
            "row_count",
            megabytes_from_pages(F.col("_total")).alias("total_size_mb"),
            megabytes_from_pages(F.col("_base")).alias("base_data_mb"),
            megabytes_from_pages(F.col("_other")).alias("nonclustered_mb"),
        )
    )
    user_tables = tables.filter(~F.col("is_system") & ~F.col("is_memory_optimized"))
    named = sized.join(user_tables, TABLE_KEY).drop("is_system", "is_memory_optimized")
    named = named.join(schemas, ["server", "schema_id"], "inner").drop("schema_id")
    biggest = [F.col("total_size_mb").desc(), F.col("schema_name"), F.col("table_name"), F.col("object_id")]
    return top_k(named, ["server"], biggest, top_n)


def usage_rollup(tables: DataFrame, index_usage: DataFrame, missing_index: DataFrame) -> DataFrame:
    """Usage counters and missing-index suggestions per table, zero where there is no history."""
    usage = index_usage.groupBy(*TABLE_KEY).agg(*[_sum0(c).alias(c) for c in USAGE])
    missing = missing_index.groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("missing_index_suggestions")
    )
    return (
        tables.join(usage, TABLE_KEY, "left")
        .join(missing, TABLE_KEY, "left")
        .fillna(0, [*USAGE, "missing_index_suggestions"])
    )


def flag_columnar(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """Adds has_columnstore: does any columnar index (type 5 or 6) exist?"""
    columnar = (
        indexes.filter(F.col("type").isin(5, 6))
        .select(*TABLE_KEY)
        .distinct()
        .withColumn("has_columnstore", F.lit(True))
    )
    return tables.join(columnar, TABLE_KEY, "left").fillna(False, ["has_columnstore"])


def operational_totals(stats: DataFrame) -> DataFrame:
    """Lock and latch waits and the write mix of each table; ghosts count as deletes."""
    return stats.groupBy(*TABLE_KEY).agg(
        _sum0("row_lock_wait_ms").alias("row_lock_wait_ms"),
        _sum0("page_lock_wait_ms").alias("page_lock_wait_ms"),
        _sum0("page_io_latch_wait_ms").alias("page_io_latch_wait_ms"),
        _sum0("leaf_insert").alias("leaf_inserts"),
        _sum0("leaf_update").alias("leaf_updates"),
        _sum0(F.col("leaf_delete") + F.col("leaf_ghost")).alias("leaf_deletes"),
    )


def usage_ratios(df: DataFrame) -> DataFrame:
    """Scan share of reads and write share of all operations, in percent."""
    reads = F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")
    return df.withColumns(
        {
            "scan_pct": safe_pct(F.col("user_scans"), reads),
            "write_pct": safe_pct(F.col("user_updates"), reads + F.col("user_updates")),
        }
    )


def write_ratios(df: DataFrame) -> DataFrame:
    writes = F.col("leaf_inserts") + F.col("leaf_updates") + F.col("leaf_deletes")
    return df.withColumn("update_share_pct", safe_pct(F.col("leaf_updates"), writes))


def size_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "index_bloat_ratio": safe_div(F.col("nonclustered_mb"), F.col("base_data_mb")),
            "potential_rowgroups": F.col("row_count").cast("double") / F.lit(float(ROWGROUP_ROWS)),
        }
    )
