"""Readers: profiled tables by name, inventories with declared schemas."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablescope.sources.schemas import SCHEMAS


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}


def read_inventory(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """One inventory or history table, read with its declared schema (no inference)."""
    return spark.read.format(fmt).schema(SCHEMAS[name]).options(**options).load(path)


def quarantine(raw: DataFrame, name: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of text as an inventory with its declared schema, and the rows that do not fit: (accepted, rejected).

    `name` is a schema's name or DDL. A value that its type cannot hold, a missing or blank key, and keys that stand
    for different rows are reasons; a row may have several. Equal rows are accepted once. Rejected rows have reasons (sorted)
    and row, the text they came as, in JSON. Columns that are missing are null, others are not read.
    """
    schema = StructType.fromDDL(SCHEMAS.get(name, name))
    text = {f.name: F.trim(F.col(f"`{f.name}`").cast("string")) if f.name in raw.columns else F.lit(None).cast("string") for f in schema}
    row = F.to_json(F.struct(*[text[f.name].alias(f.name) for f in schema]))
    typed = raw.select(row.alias("_row"), *[_typed(text[f.name], f).alias(f.name) for f in schema], *[text[f.name].alias(f"_text_{i}") for i, f in enumerate(schema)])
    reasons = [
        F.when(F.col(f"_text_{i}").isNotNull() & F.col(f"`{f.name}`").isNull(), F.lit(f"bad type: {f.name}")) for i, f in enumerate(schema)
    ]
    reasons += [
        F.when(F.coalesce(F.col(f"_text_{i}"), F.lit("")) == "", F.lit(f"missing key: {f.name}")) for i, f in enumerate(schema) if f.name in keys
    ]
    judged = typed.withColumn("_reasons", F.array_sort(F.array_compact(F.array(*reasons)))).drop(*[f"_text_{i}" for i in range(len(schema))])
    sound = judged.filter(F.size("_reasons") == 0)
    # one row per key and task is shuffled, however often a key occurs
    clashing = sound.groupBy(*keys).agg(F.min("_row").alias("_least"), F.max("_row").alias("_most")).filter("_least <> _most").select(*keys)
    accepted = sound.join(clashing, list(keys), "left_anti").select([f.name for f in schema]).distinct()
    rejected = judged.filter(F.size("_reasons") > 0).select(F.array_join("_reasons", "; ").alias("reasons"), F.col("_row").alias("row"))
    clash = sound.join(clashing, list(keys), "left_semi").select(F.lit("clashing key").alias("reasons"), F.col("_row").alias("row"))
    return accepted, rejected.unionByName(clash)


def _typed(text: Column, field) -> Column:
    return F.unhex(text) if field.dataType.simpleString() == "binary" else text.try_cast(field.dataType)


def read_quarantined(
    spark: SparkSession, name: str, path: str, keys: Sequence[str], fmt: str = "csv", **options
) -> tuple[DataFrame, DataFrame]:
    """One inventory from files of text (CSV, JSON), every value read as text and judged by `quarantine`."""
    fields = StructType.fromDDL(SCHEMAS.get(name, name))
    lines = ", ".join(f"`{f.name}` STRING" for f in fields)
    return quarantine(spark.read.format(fmt).schema(lines).options(**options).load(path), name, keys)
