"""Profiles and newest rows kept as small states, so that new days are added without reading old ones again.

A state is an ordinary table: written once per day or file, merged by one aggregation. Each step reads the rows after
its mark alone; on a history partitioned by day the mark is a partition filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.functions.columns import safe_div
from tablescope.functions.widths import TEXT, byte_length, storage_width

# Sketches of 2^12 registers: a standard error of about 1.6 %.
SKETCH_BITS = 12


def profile_states(df: DataFrame, table: str, part: Column, columns: Sequence[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """table, part, column, rows, non_null, byte_sum and a sketch of the distinct values, per part (a day, a file) and column.

    One pass: every column's counts and sketch are aggregated side by side, per task before the shuffle.
    """
    types = dict(df.dtypes)
    names = list(columns or (f.name for f in df.schema if isinstance(f.dataType, TEXT) or storage_width(f.dataType)))
    measures = []
    for i, name in enumerate(names):
        value = F.col(name)
        # a sketch takes numbers and text; -0.0 is 0.0, as in grouping
        hashed = F.xxhash64(value) if not isinstance(df.schema[name].dataType, TEXT) else value
        if types[name] in ("double", "float"):
            hashed = F.xxhash64(F.when(value == 0, F.lit(0.0).cast(types[name])).otherwise(value))
        measures += [
            F.count(value).alias(f"n{i}"),
            F.coalesce(F.sum(byte_length(value, df.schema[name].dataType)), F.lit(0)).alias(f"b{i}"),
            F.hll_sketch_agg(F.when(value.isNotNull(), hashed), F.lit(bits)).alias(f"s{i}"),
        ]
    wide = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), *measures)
    each = F.array(
        *[
            F.struct(F.lit(name).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"b{i}").alias("byte_sum"), F.col(f"s{i}").alias("sketch"))
            for i, name in enumerate(names)
        ]
    )
    return wide.select(F.lit(table).alias("table"), "part", "rows", F.explode(each).alias("c")).select("table", "part", "rows", "c.*")


def merged_profile(states: DataFrame, keys: Sequence[str] = ("table", "column")) -> DataFrame:
    """Profile of all parts together from their states: counts add up, sketches are united."""
    merged = states.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("non_null").alias("non_null"),
        F.sum("byte_sum").alias("byte_sum"),
        F.hll_union_agg("sketch").alias("sketch"),
    )
    distinct = F.least(F.hll_sketch_estimate("sketch"), F.col("non_null"))
    return merged.withColumn("distinct", distinct).withColumns(
        {
            "avg_bytes": safe_div(F.col("byte_sum"), F.col("non_null")),
            "distinct_ratio": safe_div(F.col("distinct"), F.col("non_null")),
            "duplication_factor": safe_div(F.col("non_null"), F.col("distinct")),
        }
    )


def newest_states(rows: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], after: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """keys, time, values: each key's newest row in (after, as_of]; ties go to the greatest values.

    One aggregation of a struct of the time and the values.
    """
    if after is not None:
        rows = rows.filter(F.col(time) > after)
    if as_of is not None:
        rows = rows.filter(F.col(time) <= as_of)
    rows = rows.filter(F.col(time).isNotNull())
    newest = rows.groupBy(*keys).agg(F.max(F.struct(time, *values)).alias("_newest"))
    return newest.select(*keys, "_newest.*")


def advanced(state: DataFrame, rows: DataFrame, keys: Sequence[str], time: str, mark: Column, as_of: Column) -> DataFrame:
    """The state as of `as_of`, from the state as of `mark` and the rows after it."""
    values = [c for c in state.columns if c not in (*keys, time)]
    new = newest_states(rows, keys, time, values, after=mark, as_of=as_of)
    return newest_states(state.unionByName(new), keys, time, values)


def recency_states(history: DataFrame, keys: Sequence[str], kind: str, time: str, kinds: Sequence[str], after: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """Newest time of each kind per entity, one column per kind, in (after, as_of]."""
    if after is not None:
        history = history.filter(F.col(time) > after)
    if as_of is not None:
        history = history.filter(F.col(time) <= as_of)
    return history.groupBy(*keys).agg(*[F.max(F.when(F.col(kind) == k, F.col(time))).alias(f"last_{k}") for k in kinds])


def advanced_recency(state: DataFrame, history: DataFrame, keys: Sequence[str], kind: str, time: str, kinds: Sequence[str], mark: Column, as_of: Column) -> DataFrame:
    """The recency state as of `as_of`, from the state as of `mark` and the events after it."""
    new = recency_states(history, keys, kind, time, kinds, after=mark, as_of=as_of)
    return state.unionByName(new).groupBy(*keys).agg(*[F.max(f"last_{k}").alias(f"last_{k}") for k in kinds])


def counter_steps(snapshots: DataFrame, keys: Sequence[str], time: str, counters: Sequence[str], restart_keys: Sequence[str] = ("server",)) -> DataFrame:
    """What cumulative counters grew by between an entity's consecutive snapshots, which list all entities of a server.

    A counter below its last value has started again from zero, and a server on which any did has restarted: its
    counters' growth since then is what they show, for all of its entities in that snapshot, and `restarted` says so.
    The first snapshot of an entity has no growth, unless the server restarted since its last snapshot.
    """
    order = W.partitionBy(*keys).orderBy(time)
    before = {f"_{c}": F.lag(c).over(order) for c in counters}
    steps = snapshots.withColumns({**before, "since": F.lag(time).over(order)})
    fell = F.lit(False)
    for c in counters:
        fell = fell | F.coalesce(F.col(c) < F.col(f"_{c}"), F.lit(False))
    restarts = steps.groupBy(*restart_keys, time).agg(F.bool_or(fell).alias("restarted"))
    steps = steps.join(restarts, [*restart_keys, time])
    grown = {c: F.when(F.col("restarted"), F.col(c)).otherwise(F.col(c) - F.col(f"_{c}")) for c in counters}
    return steps.withColumns({f"{c}_grown": F.coalesce(g, F.lit(0)) for c, g in grown.items()}).drop(*before)


def growth(steps: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Sums of the steps per entity, and how often its server restarted meanwhile."""
    return steps.groupBy(*keys).agg(
        *[F.sum(f"{c}_grown").alias(c) for c in counters], F.count_if("restarted").alias("restarts")
    )
