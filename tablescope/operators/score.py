"""Candidacy score, verdicts, recommendations and the punch list.

Input: one row per table with size, usage, contention, write mix, shape and
size/usage ratios (discover.usage_ratios, write_ratios, size_ratios).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import number0, number01, thousands
from tablescope.functions.constants import NOTES, TABLE_VERDICTS
from tablescope.operators.workload import insert_only


def _steps(value: Column, *steps: tuple[float, float], otherwise: Column | float = 0.0) -> Column:
    """Points of the first limit reached, limits in descending order."""
    points = F.lit(otherwise) if isinstance(otherwise, (int, float)) else otherwise
    for limit, score in reversed(steps):
        points = F.when(value >= limit, F.lit(score)).otherwise(points)
    return points


def candidacy_score() -> Column:
    """0 to 100, half-even to one decimal; 0 when the table is already columnar."""
    lock_ms = F.col("row_lock_wait_ms") + F.col("page_lock_wait_ms")
    pressure = F.col("dictionary_pressure_columns")
    bloat = F.col("index_bloat_ratio")
    total = (
        F.least(F.lit(40.0), F.col("pct_low") * 0.25 + F.col("pct_medium") * 0.15)
        + _steps(F.col("potential_rowgroups"), (100, 15.0), (20, 12.0), (5, 8.0), (3, 4.0))
        + F.col("scan_pct") * 0.20
        + _steps(bloat, (2.0, 15.0), (1.0, 11.0), (0.5, 6.0), otherwise=bloat * 12)
        + F.when(lock_ms >= 3_600_000, 6.0).when(lock_ms >= 60_000, 4.0).when(lock_ms > 0, 2.0).otherwise(0.0)
        + _steps(F.col("missing_index_suggestions"), (5, 4.0), (1, 2.0))
        - _steps(F.col("write_pct"), (50, 30.0), (25, 15.0), (10, 5.0))
        - _steps(F.col("update_share_pct"), (50, 15.0), (20, 8.0))
        - F.least(F.lit(15.0), pressure * 5.0)
        - F.when(F.col("lob_columns") > 0, 5.0).otherwise(0.0)
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))
    return F.when(F.col("has_columnstore"), 0.0).otherwise(F.bround(clamped, 1))


def assessment_notes() -> Column:
    """The reasons behind the score, in rule order, joined by '; '."""
    low, medium = F.col("pct_low"), F.col("pct_medium")
    writes, updates = F.col("write_pct"), F.col("update_share_pct")
    rowgroups = F.col("potential_rowgroups")

    def note(name: str, *values: Column) -> Column:
        return F.format_string(NOTES[name], *values) if values else F.lit(NOTES[name])

    shape = (
        F.when(low >= 50, note("low", number0(low)))
        .when(medium >= 50, note("medium", number0(medium)))
        .when(F.col("sampled_rows") > 0, note("unique"))
    )
    reasons = [
        shape,
        F.when(rowgroups < 3, note("small", number01(rowgroups), thousands(F.col("row_count")))),
        F.when(F.col("scan_pct") >= 50, note("scans")),
        F.when(
            F.col("index_bloat_ratio") >= 1.0,
            note("bloat", thousands(F.col("nonclustered_mb")), thousands(F.col("base_data_mb"))),
        ),
        F.when(writes >= 50, note("write_heavy")).when(writes >= 25, note("writes")),
        F.when(updates >= 50, note("update_heavy")).when(updates >= 20, note("updates")),
        F.when(
            F.col("dictionary_pressure_columns") > 0,
            note("pressure", F.col("dictionary_pressure_columns").cast("string")),
        ),
        F.when(F.col("lob_columns") > 0, note("lob", F.col("lob_columns").cast("string"))),
        F.when(F.col("is_replicated"), note("replicated")),
        F.when(F.col("is_cdc_tracked"), note("tracked")),
        F.when(F.col("page_io_latch_wait_ms") > 60_000, note("latches")),
    ]
    return F.when(F.col("has_columnstore"), note("columnar")).otherwise(F.concat_ws("; ", *reasons))


def score_tables(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({"candidacy_score": candidacy_score(), "notes": assessment_notes()})


def _too_small() -> Column:
    return F.col("potential_rowgroups") < 3


def verdict_tier() -> Column:
    """First label that applies; needs candidacy_score and has_aggregation."""
    score = F.col("candidacy_score")
    compressible = insert_only() & (F.col("pct_medium") >= 50) & ~_too_small()
    label = TABLE_VERDICTS
    return (
        F.when(F.col("has_columnstore"), label["columnar"])
        .when(score >= 55, label["strong"])
        .when((score >= 35) & F.col("has_aggregation"), label["genuine"])
        .when(score >= 35, label["promising"])
        .when((score >= 15) & compressible, label["compression"])
        .when(score >= 20, label["marginal"])
        .when(_too_small(), label["small"])
        .otherwise(label["no"])
    )


def recommendation(scored: DataFrame) -> DataFrame:
    """convert (with its migration steps), later or leave; already columnar tables get none.

    Needs candidacy_score, computed_columns and clustering_column.
    """
    score = F.col("candidacy_score")
    append = insert_only()
    action = (
        F.when(F.col("has_columnstore"), F.lit(None).cast("string"))
        .when(score >= 35, "convert")
        .when((score >= 20) & append & ~_too_small(), "later")
        .otherwise("leave")
    )
    steps = F.array(
        F.when(F.col("computed_columns") > 0, "drop computed columns first"),
        F.when(
            F.col("clustering_column").isNotNull(),
            F.concat(F.lit("order the data by "), F.col("clustering_column")),
        ),
        F.when(append, "reorganize periodically"),
        F.when((F.col("write_pct") >= 25) & ~append, "test a nonclustered columnstore first"),
    )
    kept = F.filter(steps, lambda s: s.isNotNull())
    return scored.withColumn("recommendation", action).withColumn(
        "migration_steps",
        F.when(F.col("recommendation") == "convert", kept).otherwise(F.array().cast("array<string>")),
    )


def punch_list(findings: DataFrame, candidates: DataFrame, ordered: bool = True) -> DataFrame:
    """What to do first: cheap index work, then conversions, biggest reclaim first.

    `findings` comes from index_findings; `candidates` has server, object_id,
    has_columnstore, candidacy_score, base_data_mb and compressed_mb.
    """
    key = ["server", "object_id"]
    columnar = candidates.filter("has_columnstore").select(*key)
    relevant = findings.filter(F.col("kind").isin("dead", "lob_include")).join(columnar, key, "left_anti")
    # Dead indexes of a table become one action; each LOB include is its own.
    rebuilt = F.when(F.col("kind") == "lob_include", F.col("index_name"))
    action = F.when(
        F.col("_rebuilt").isNotNull(), F.concat(F.lit("rebuild "), "_rebuilt", F.lit(" without the LOB include"))
    ).otherwise("drop the dead nonclustered indexes")
    cheap = (
        relevant.groupBy(*key, rebuilt.alias("_rebuilt"))
        .agg(F.sum("reclaim_mb").alias("reclaim_mb"))
        .filter(F.col("_rebuilt").isNotNull() | (F.col("reclaim_mb") > 0))
        .select(*key, F.lit(1).alias("priority"), action.alias("action"), "reclaim_mb")
    )
    saved = F.greatest(
        F.lit(0.0), F.col("base_data_mb").cast("double") - F.coalesce("compressed_mb", F.lit(0.0))
    )
    convertible = candidates.filter(~F.col("has_columnstore") & (F.col("candidacy_score") >= 35))
    convert = convertible.select(
        *key, F.lit(2).alias("priority"), F.lit("plan the columnstore conversion").alias("action"),
        saved.alias("reclaim_mb"),
    )
    items = cheap.unionByName(convert)
    if not ordered:
        return items
    return items.orderBy("priority", F.col("reclaim_mb").desc(), "action", *key)


def punch_total(items: DataFrame, min_mb: float = 100) -> DataFrame:
    """Total reclaim, reported only above min_mb."""
    total = items.agg(F.count(F.lit(1)).alias("actions"), F.coalesce(F.sum("reclaim_mb"), F.lit(0.0)).alias("total_mb"))
    return total.withColumn("reported", F.col("total_mb") > min_mb)


def ranked_candidates(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.col("candidacy_score").desc(), "table")


def portfolio_counts(scored: DataFrame) -> DataFrame:
    open_ = ~F.col("has_columnstore")
    score = F.col("candidacy_score")
    return scored.agg(
        F.count_if(open_ & (score >= 55)).alias("strong"),
        F.count_if(open_ & (score >= 35) & (score < 55)).alias("worth_testing"),
        F.count_if(~open_).alias("already_columnar"),
    )
