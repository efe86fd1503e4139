"""Distinct values of a whole table estimated from a sample of its rows or of its files, with bounds.

With r of n units sampled (rows, or files), d distinct values seen and f1 of them seen in one unit only, the number of
distinct values of the whole lies between d and d + (n / r - 1) * (f1 + 3 * sqrt(f1) + 5): a value that was missed would
as likely have been seen once, so the expected f1 bounds those not seen, and the observed one falls short of it by more
with a chance below 1 %. The estimate is the geometric middle, which bounds the ratio error of either side at
sqrt(n / r): d - f1 + sqrt(n / r) * f1 (the guaranteed-error estimator). For a sample of whole files a value counts once per
file, however many of its rows the file has, since rows of one file are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import safe_div
from tablescope.functions.frames import union_all
from tablescope.operators.profile import DIGEST_ABOVE_BYTES, ProfiledColumn, describe_columns

def value_units(sample: DataFrame, table: str, unit: Column | None = None) -> DataFrame:
    """table, column, seen, once: distinct values of each eligible column of the sample, and those in one row, or one `unit`, only.

    Columns of one key type share a scan and a two-level aggregation.
    """
    by_kind: dict[str, list[ProfiledColumn]] = {}
    for c in describe_columns({table: sample}):
        if c.eligible:
            by_kind.setdefault(c.key_type, []).append(c)
    frames = []
    for own in by_kind.values():
        cells = F.explode(F.array(*[F.struct(F.lit(c.column).alias("column"), _value(c).alias("value")) for c in own]))
        if unit is None:
            some = sample.select(cells.alias("c")).select("c.*").filter("value IS NOT NULL")
        else:  # a value counts once per unit
            some = sample.select(unit.alias("unit"), cells.alias("c")).select("unit", "c.*").filter("value IS NOT NULL").distinct()
        counted = some.groupBy("column", "value").agg(F.count(F.lit(1)).alias("units"))
        frames.append(counted.groupBy("column").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("units") == 1).alias("once")))
    return union_all(frames).withColumn("table", F.lit(table))


def _value(column: ProfiledColumn) -> Column:
    key = F.expr(column.key(False))
    return F.when(F.octet_length(key) > DIGEST_ABOVE_BYTES, F.sha2(key, 256)).otherwise(key) if column.is_string else key


def distinct_bounds(seen: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds estimate, at_least and at_most to `value_units`; `sizes` has table, sampled and total units.

    `at_most` holds with high probability for samples that are random in their unit.
    """
    ratio = safe_div(F.col("total"), F.col("sampled"))
    unseen = F.greatest(ratio - 1, F.lit(0.0)) * (F.col("once") + 3 * F.sqrt("once") + 5)
    return seen.join(sizes, "table").select(
        "table",
        "column",
        "seen",
        "once",
        F.col("seen").alias("at_least"),
        (F.col("seen") + F.greatest(F.sqrt(ratio) - 1, F.lit(0.0)) * F.col("once")).alias("estimate"),
        F.ceil(F.col("seen") + unseen).alias("at_most"),
    )
