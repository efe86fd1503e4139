"""Index inventory and what is wrong with the indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import megabytes_from_pages
from tablescope.functions.constants import INDEX_NOTE_DROP, INDEX_NOTE_WIDE
from tablescope.operators.discover import TABLE_KEY, USAGE

INDEX_KEY = [*TABLE_KEY, "index_id"]


def index_inventory(
    indexes: DataFrame, index_columns: DataFrame, partition_stats: DataFrame, index_usage: DataFrame
) -> DataFrame:
    """One row per index (heaps excluded): size, key and include lists, usage, note.

    Every input is first reduced to one row per index, so no join key repeats.
    A column occurs once in an index, which bounds the lists by table width.
    """
    once = index_columns.groupBy(*INDEX_KEY, "is_included", "column_name").agg(
        F.min("key_ordinal").alias("key_ordinal")
    )
    keys = F.when(~F.col("is_included"), F.struct("key_ordinal", "column_name"))
    includes = F.when(F.col("is_included"), F.col("column_name"))
    lists = once.groupBy(*INDEX_KEY).agg(
        F.array_sort(F.collect_list(keys)).getField("column_name").alias("key_columns"),
        F.array_sort(F.collect_list(includes)).alias("included_columns"),
    )
    sizes = partition_stats.groupBy(*INDEX_KEY).agg(
        megabytes_from_pages(F.sum("reserved_page_count")).alias("size_mb")
    )
    usage = index_usage.groupBy(*INDEX_KEY).agg(*[F.sum(c).alias(c) for c in USAGE])
    nothing = F.array().cast("array<string>")
    return (
        indexes.filter(F.col("type") > 0)
        .drop("type")
        .join(sizes, INDEX_KEY)
        .join(lists, INDEX_KEY, "left")
        .join(usage, INDEX_KEY, "left")
        .fillna(0, USAGE)
        .withColumns(
            {
                "key_columns": F.coalesce("key_columns", nothing),
                "included_columns": F.coalesce("included_columns", nothing),
            }
        )
        .withColumns(
            {
                "key_column_count": F.size("key_columns"),
                "included_column_count": F.size("included_columns"),
                "reads": F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups"),
            }
        )
        .withColumn("note", index_note())
    )


def _nonclustered() -> Column:
    return F.col("type_desc") == "NONCLUSTERED"


def index_note() -> Column:
    unread = (F.col("reads") == 0) & (F.col("user_updates") > 0)
    return (
        F.when(_nonclustered() & unread, INDEX_NOTE_DROP)
        .when(_nonclustered() & (F.col("included_column_count") >= 5), INDEX_NOTE_WIDE)
        .otherwise("")
    )


def is_dead(few_reads: int = 20, many_writes: int = 10_000) -> Column:
    """Broader than the note: also hardly read but written all the time."""
    reads, writes = F.col("reads"), F.col("user_updates")
    return _nonclustered() & (
        ((reads == 0) & (writes > 0)) | ((reads < few_reads) & (writes > many_writes))
    )


def dead_indexes(inventory: DataFrame, few_reads: int = 20, many_writes: int = 10_000) -> DataFrame:
    """Per table: how many dead indexes, and how much space they hold."""
    return (
        inventory.filter(is_dead(few_reads, many_writes))
        .groupBy(*TABLE_KEY)
        .agg(F.count(F.lit(1)).alias("dead_count"), F.sum("size_mb").alias("dead_mb"))
    )


def tables_without_index(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tables without any index (heap entries do not count), as finding rows."""
    indexed = indexes.filter(F.col("type") > 0).select(*TABLE_KEY).distinct()
    return tables.select(*TABLE_KEY).join(indexed, TABLE_KEY, "left_anti").select(
        *TABLE_KEY,
        F.lit(None).cast("string").alias("index_name"),
        F.lit(0.0).alias("size_mb"),
        F.lit("no_index").alias("kind"),
        F.lit("every read is a full scan").alias("detail"),
        F.lit(0.0).alias("reclaim_mb"),
    )


def index_findings(
    inventory: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    few_reads: int = 20,
    many_writes: int = 10_000,
    low_distinct: int = 10,
    wide_includes: int = 5,
) -> DataFrame:
    """Zero or more rows per nonclustered index.

    `tables` carries base_data_mb; `columns` is the column profile per table
    (column, ordinal, is_lob, is_computed, analyzed, distinct_values).
    """
    lower = F.lower("column")
    facts = columns.groupBy(*TABLE_KEY).agg(
        F.collect_list(F.when(F.col("is_lob"), lower)).alias("lobs"),
        F.collect_list(F.when(F.col("is_computed"), lower)).alias("computed"),
        F.array_sort(
            F.collect_list(
                F.when(F.col("analyzed"), F.struct("ordinal", lower.alias("name"), "distinct_values"))
            )
        ).alias("profiled"),
    )
    per_table = tables.select(*TABLE_KEY, "base_data_mb").join(facts, TABLE_KEY, "left")
    # One table may own most of the indexes.
    judged = inventory.filter(_nonclustered()).join(per_table, TABLE_KEY, "inner")

    folded = lambda names: F.transform(names, F.lower)
    leading = F.lower(F.get("key_columns", F.lit(0)))
    leading_profile = F.get(F.filter("profiled", lambda p: p["name"] == leading), F.lit(0))
    overlap = lambda names, others: F.coalesce(
        F.arrays_overlap(folded(F.col(names)), F.col(others)), F.lit(False)
    )
    judged = judged.withColumns(
        {
            "_dead": is_dead(few_reads, many_writes),
            "_lob": overlap("included_columns", "lobs"),
            "_distinct": leading_profile["distinct_values"],
            "_computed": overlap("key_columns", "computed"),
        }
    )
    size = F.col("size_mb").cast("double")

    def row(kind: str, detail: Column, reclaim: Column = F.lit(0.0)) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), detail.alias("detail"), reclaim.cast("double").alias("reclaim_mb")
        )

    rows = [
        F.when(
            F.col("_dead"),
            row(
                "dead",
                F.concat(F.col("reads").cast("string"), F.lit(" reads, "), F.col("user_updates").cast("string"), F.lit(" writes")),
                size,
            ),
        ),
        F.when(
            F.col("_lob") & (F.col("size_mb") >= F.col("base_data_mb") * 0.5),
            row("lob_include", F.lit("rebuild without the LOB include"), size * 0.9),
        ),
        F.when(
            (F.col("_distinct") <= low_distinct) & ~F.col("_dead") & ~F.col("_lob"),
            row(
                "low_selectivity_key",
                F.concat(F.get("key_columns", F.lit(0)), F.lit(" has "), F.col("_distinct").cast("string"), F.lit(" distinct")),
            ),
        ),
        F.when(F.col("_dead") & F.col("_computed"), row("computed_key", F.lit("only feeds a dead index"))),
        F.when(
            ~F.col("_dead") & (F.col("included_column_count") >= wide_includes),
            row("wide", F.concat(F.col("included_column_count").cast("string"), F.lit(" included columns"))),
        ),
    ]
    present = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return judged.select(*TABLE_KEY, "index_name", size.alias("size_mb"), F.inline(present))
