"""Per-table shape metrics derived from the column profile (a schema-sized input).

A table is told by `keys`: its name, or server and name where servers hold tables of one name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MEGABYTE = 1024.0 * 1024.0
BY_NAME = ("table",)


def _compressed_weight() -> Column:
    factor = F.col("duplication_factor")
    return F.when(factor >= 1000, 0.02).when(factor >= 100, 0.05).when(factor >= 10, 0.15).otherwise(0.5)


def measured(profile: DataFrame) -> DataFrame:
    return profile.filter(F.col("analyzed") & (F.col("sample_rows") > 0))


def table_shape(profile: DataFrame, keys: Sequence[str] = BY_NAME) -> DataFrame:
    """Repetitiveness of each table: one row per table, LOB columns always counted.

    compressed_row_bytes is the rough columnar size of one row; clustering_column
    is the first measured date column.
    """
    done = F.col("analyzed") & (F.col("sample_rows") > 0)
    row_bytes = F.when(done, F.col("avg_byte_length") * _compressed_weight())
    share = lambda limit: F.coalesce(
        F.lit(100.0)
        * F.count_if(done & (F.col("distinct_ratio") <= limit)).cast("double")
        / F.nullif(F.count_if(done), F.lit(0)).cast("double"),
        F.lit(0.0),
    )
    # A list of factors per table is bounded by the width of its schema.
    factors = F.array_sort(F.collect_list(F.when(done, F.col("duplication_factor"))))
    upper_middle = F.when(
        F.size(factors) > 0, F.get(factors, F.floor(F.size(factors) / F.lit(2)).cast("int"))
    )
    return profile.groupBy(*keys).agg(
        F.count_if(done).alias("analyzed_columns"),
        F.coalesce(F.max(F.when(done, F.col("sample_rows"))), F.lit(0)).alias("sampled_rows"),
        share(0.01).alias("pct_low"),
        share(0.10).alias("pct_medium"),
        F.coalesce(upper_middle, F.lit(0.0)).alias("median_duplication_factor"),
        F.count_if(done & F.col("dictionary_pressure")).alias("dictionary_pressure_columns"),
        F.count_if("is_lob").alias("lob_columns"),
        F.count_if("is_computed").alias("computed_columns"),
        F.coalesce(F.sum(row_bytes), F.lit(0.0)).alias("compressed_row_bytes"),
        F.min_by("column", F.when(done & F.col("is_date"), F.col("ordinal"))).alias("clustering_column"),
    )


def compressed_mb() -> Column:
    """Rough columnar size from compressed_row_bytes and row_count.

    The mean length is of non-null values but is multiplied by all rows, so
    sparse columns are overstated.
    """
    return F.col("compressed_row_bytes") * F.col("row_count") / MEGABYTE


def compressed_estimate(shape: DataFrame, sizes: DataFrame, keys: Sequence[str] = BY_NAME) -> DataFrame:
    """Rough columnar size of each measured table; `sizes` has the keys, row_count, base_data_mb."""
    estimate = (
        shape.filter("analyzed_columns > 0")
        .select(*keys, "compressed_row_bytes")
        .join(sizes.select(*keys, "row_count", "base_data_mb"), list(keys))
        .withColumn("compressed_mb", compressed_mb())
        .drop("compressed_row_bytes")
    )
    worth_reporting = (
        (F.col("compressed_mb") > 0)
        & (F.col("base_data_mb") > 50)
        & (F.col("compressed_mb") < F.col("base_data_mb") * 0.6)
    )
    return estimate.withColumn("worth_reporting", worth_reporting)


def shape_highlights(profile: DataFrame, top: int = 4, keys: Sequence[str] = BY_NAME) -> DataFrame:
    """Most repetitive columns, how many more repeat well, and the near-unique ones."""
    factor = F.col("duplication_factor")
    by_factor = W.partitionBy(*keys).orderBy(F.col("_star").desc(), factor.desc(), "ordinal")
    ranked = (
        measured(profile)
        .withColumn("_star", factor >= 100)
        .withColumn("_rank", F.row_number().over(by_factor))
    )
    star = F.when(F.col("_star") & (F.col("_rank") <= top), F.struct("_rank", "column"))
    unique = F.when(F.col("distinct_ratio") >= 0.9, F.struct("ordinal", "column"))
    names = lambda cell: F.array_sort(F.collect_list(cell)).getField("column")
    return ranked.groupBy(*keys).agg(
        names(star).alias("star_columns"),
        F.count_if((factor >= 10) & (factor < 100)).alias("good_columns"),
        names(unique).alias("near_unique_columns"),
    )


def jackpot_column(
    profile: DataFrame, sizes: DataFrame, min_bytes: float = 20, min_factor: float = 50, keys: Sequence[str] = BY_NAME
) -> DataFrame:
    """The wide, repetitive text column that holds most of each table."""
    payload = F.col("avg_byte_length") * F.col("row_count")
    wide = measured(profile).filter(
        F.col("is_string")
        & (F.col("avg_byte_length") >= min_bytes)
        & (F.col("duplication_factor") >= min_factor)
    )
    best = (
        wide.join(sizes.select(*keys, "row_count"), list(keys))
        .groupBy(*keys)
        .agg(
            F.max_by(
                F.struct("column", "distinct_values", "avg_byte_length", (payload / MEGABYTE).alias("payload_mb")),
                F.struct(payload, -F.col("ordinal")),
            ).alias("best")
        )
    )
    return best.select(*keys, "best.*")


def clustering_column(profile: DataFrame) -> DataFrame:
    """First measured date column of each table, by column order.

    `profile` may also be the output of column_eligibility, which needs no value counts.
    """
    return (
        profile.filter(F.col("analyzed") & F.col("is_date"))
        .groupBy("table")
        .agg(F.min_by("column", "ordinal").alias("clustering_column"))
    )


def top_columns(profile: DataFrame, top: int = 8, keys: Sequence[str] = BY_NAME) -> DataFrame:
    """The most repetitive measured columns of each table, with their rank."""
    order = W.partitionBy(*keys).orderBy(F.col("duplication_factor").desc(), "ordinal")
    return (
        profile.filter("analyzed")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select(*keys, "rank", "column", "duplication_factor", "distinct_values")
    )
