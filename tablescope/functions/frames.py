"""Small DataFrame helpers: constant rows, unions, top-k, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def constant_rows(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """Rules, names or column metadata as a local relation (schema-sized, never data-sized)."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, built as a balanced tree: each step is analysed again as a whole."""
    frames = list(frames)
    while len(frames) > 1:
        pairs = zip(frames[::2], frames[1::2])
        odd = frames[-1:] if len(frames) % 2 else []
        frames = [a.unionByName(b) for a, b in pairs] + odd
    return frames[0]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key; planned with a per-task group limit before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")


def newest_snapshot(
    df: DataFrame, time: str, as_of: Column | None = None, keys: Sequence[str] = ("server",)
) -> DataFrame:
    """The rows of each server's newest snapshot no later than `as_of`: what it no longer lists is gone.

    The times come from one small aggregate, one row per server.
    """
    if as_of is not None:
        df = df.filter(F.col(time) <= as_of)
    newest = df.groupBy(*keys).agg(F.max(time).alias(time))
    return df.join(newest, [*keys, time], "left_semi")


def latest_snapshot(
    df: DataFrame, keys: Sequence[str], time: str, as_of: Column | None = None
) -> DataFrame:
    """Newest row per key no later than `as_of`, combined map-side.

    Ties on time are decided by the remaining columns, so they must be orderable.
    """
    if as_of is not None:
        df = df.filter(F.col(time) <= as_of)
    rest = [c for c in df.columns if c not in keys and c != time]
    newest = df.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("_newest"))
    return newest.select(*keys, "_newest.*")
