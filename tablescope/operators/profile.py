"""Column profile: exact distinct counts, nulls and byte lengths of every column."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import hash_bucket, safe_div
from tablescope.functions.constants import (
    COLUMN_BATCH,
    COLUMN_VERDICTS,
    SAMPLE_SEED,
    SAMPLE_TARGET_ROWS,
    SKIP_COMPUTED,
    SKIP_LOB,
)
from tablescope.functions.frames import constant_rows, union_all
from tablescope.functions.widths import TEXT, storage_width

# Longer text is grouped by its SHA-256 instead of its bytes: a document-sized
# value then costs 64 bytes in the shuffle.
DIGEST_ABOVE_BYTES = 64

_WHOLE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class ProfiledColumn:
    """What the schema alone says about one column."""

    table: str
    column: str
    ordinal: int
    data_type: T.DataType
    is_lob: bool
    is_computed: bool

    @property
    def eligible(self) -> bool:
        return not (self.is_lob or self.is_computed)

    @property
    def skip_reason(self) -> str:
        if self.is_lob:
            return SKIP_LOB
        return SKIP_COMPUTED if self.is_computed else ""

    @property
    def is_string(self) -> bool:
        return isinstance(self.data_type, TEXT)

    @property
    def is_date(self) -> bool:
        return isinstance(self.data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))

    @property
    def key_type(self) -> str:
        """Columns with one key type share a scan and a shuffle, without text casts."""
        kind = self.data_type
        if isinstance(kind, _WHOLE) or isinstance(kind, (T.DateType, T.TimestampType)):
            return "bigint"
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return "double"
        return "string" if self.is_string else kind.simpleString()

    @property
    def name(self) -> str:
        """Quoted column name."""
        return "`" + self.column.replace("`", "``") + "`"

    def key(self, case_insensitive: bool) -> str:
        """SQL text of the value to group by. One text per scan builds far faster than nested Columns."""
        kind = self.data_type
        if isinstance(kind, T.DateType):
            return f"CAST(unix_date({self.name}) AS BIGINT)"
        if isinstance(kind, T.TimestampType):
            return f"unix_micros({self.name})"
        if self.is_string and case_insensitive:
            return f"lower({self.name})"
        return f"CAST({self.name} AS {self.key_type})"


def _is_lob_type(kind: T.DataType) -> bool:
    return not isinstance(kind, TEXT) and storage_width(kind) is None


def describe_columns(
    tables: Mapping[str, DataFrame],
    lob_columns: Iterable[tuple[str, str]] = (),
    computed_columns: Iterable[tuple[str, str]] = (),
) -> list[ProfiledColumn]:
    """Eligibility of every column, from the schemas on the driver."""
    lobs, computed = set(lob_columns), set(computed_columns)
    return [
        ProfiledColumn(
            table,
            field.name,
            ordinal,
            field.dataType,
            _is_lob_type(field.dataType) or (table, field.name) in lobs,
            (table, field.name) in computed,
        )
        for table, df in tables.items()
        for ordinal, field in enumerate(df.schema.fields)
    ]


def _catalog_frame(spark, columns: list[ProfiledColumn]) -> DataFrame:
    return constant_rows(
        spark,
        [
            (
                i,
                c.table,
                c.column,
                c.ordinal,
                c.data_type.simpleString(),
                c.is_string,
                c.is_date,
                c.is_lob,
                c.is_computed,
                c.eligible,
                c.skip_reason,
                storage_width(c.data_type),
            )
            for i, c in enumerate(columns)
        ],
        "cid INT, table STRING, column STRING, ordinal INT, data_type STRING, is_string BOOLEAN,"
        " is_date BOOLEAN, is_lob BOOLEAN, is_computed BOOLEAN, eligible BOOLEAN,"
        " skip_reason STRING, width INT",
    )


def column_eligibility(
    tables: Mapping[str, DataFrame],
    lob_columns: Iterable[tuple[str, str]] = (),
    computed_columns: Iterable[tuple[str, str]] = (),
) -> DataFrame:
    """Which columns can be measured, with the number of rows to measure."""
    spark = next(iter(tables.values())).sparkSession
    columns = describe_columns(tables, lob_columns, computed_columns)
    rows = union_all(
        [
            df.agg(F.count(F.lit(1)).alias("table_rows")).withColumn("table", F.lit(name))
            for name, df in tables.items()
        ]
    )
    # One row per table: bounded by the number of tables named in this call.
    return (
        _catalog_frame(spark, columns)
        .join(F.broadcast(rows), "table")
        .withColumn("analyzed", F.col("eligible") & (F.col("table_rows") > 0))
        .select(
            "table", "column", "ordinal", "data_type", "is_date", "is_lob", "is_computed", "table_rows",
            "analyzed", "skip_reason",
        )
    )


def profile_columns(
    tables: Mapping[str, DataFrame],
    lob_columns: Iterable[tuple[str, str]] = (),
    computed_columns: Iterable[tuple[str, str]] = (),
    batch_size: int = COLUMN_BATCH,
    approx: bool = False,
    case_insensitive: bool = False,
) -> DataFrame:
    """Rows, exact distinct values, nulls and mean byte length per column, with verdicts.

    `approx=True` replaces the exact distinct count by a sketch (about 5 % error)
    that needs no shuffle of values; thresholds then become approximate too.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = describe_columns(tables, lob_columns, computed_columns)
    measure = _measure_approx if approx else _measure_exact
    measured = measure(tables, columns, batch_size, case_insensitive)
    catalog = _catalog_frame(spark, columns)
    if measured is None:
        empty = "cid INT, rows BIGINT, non_null BIGINT, distinct_values BIGINT, bytes BIGINT"
        measured = constant_rows(spark, [], empty)
    # One row per column: bounded by the width of the schemas.
    return _judge(catalog.join(F.broadcast(measured), "cid", "left"))


def profile_servers(
    tables: Mapping[tuple[str, str], DataFrame],
    lob_columns: Iterable[tuple[str, str, str]] = (),
    computed_columns: Iterable[tuple[str, str, str]] = (),
    **options,
) -> DataFrame:
    """profile_columns of tables by (server, name), with a server column: tables of one name on two servers are two tables.

    Columns that are no data are given as (server, table, column); `options` are those of profile_columns.
    """
    joined = lambda server, table: f"{server}\u0001{table}"
    named = lambda columns: [(joined(s, t), c) for s, t, c in columns]
    profile = profile_columns(
        {joined(*key): df for key, df in tables.items()}, named(lob_columns), named(computed_columns), **options
    )
    part = lambda i: F.split_part("table", F.lit("\u0001"), F.lit(i))
    return profile.withColumns({"server": part(1), "table": part(2)})


def _batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _measure_exact(tables, columns, batch_size, case_insensitive) -> DataFrame | None:
    """Count each (column, value) once, then count the values of each column.

    Columns are grouped by key type. Within a type the columns of all tables go
    through one two-level aggregation: the first level combines map-side, so a
    value held by a third of the rows leaves each task as one row, and the
    second level leaves one row per column and task.
    """
    by_type: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
    for cid, c in enumerate(columns):
        if c.eligible:
            by_type[c.key_type][c.table].append(cid)

    results = []
    for key_type, members in by_type.items():
        text = key_type == "string"
        unpivoted = union_all(
            [
                _unpivot(tables[table], columns, batch, text, case_insensitive)
                for table, cids in members.items()
                for batch in _batches(cids, batch_size)
            ]
        )
        keys = ["cid", "digested", "key"] if text else ["cid", "key"]
        bytes_sum = F.sum("bytes") if text else F.lit(None).cast("bigint")
        per_value = unpivoted.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), bytes_sum.alias("bytes")
        )
        results.append(
            per_value.groupBy("cid").agg(
                F.sum("n").alias("rows"),
                F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
                F.count("key").alias("distinct_values"),
                F.sum("bytes").alias("bytes"),
            )
        )
    return union_all(results) if results else None


def _unpivot(df, columns, cids, text, case_insensitive) -> DataFrame:
    """One (column id, key) row per cell; only the listed columns are read."""
    cells = []
    for cid in cids:
        key = columns[cid].key(case_insensitive)
        if text:
            long = f"coalesce(octet_length({key}) > {DIGEST_ABOVE_BYTES}, false)"
            cells.append(
                f"{cid} AS cid, {long} AS digested, if({long}, sha2({key}, 256), {key}) AS key,"
                f" CAST(octet_length({columns[cid].name}) AS BIGINT) AS bytes"
            )
        else:
            cells.append(f"{cid} AS cid, {key} AS key")
    return df.selectExpr(f"inline(array({', '.join(f'struct({cell})' for cell in cells)}))")


def _measure_approx(tables, columns, batch_size, case_insensitive) -> DataFrame | None:
    """One pass per table with a distinct sketch per column; only sketches are shuffled."""
    results = []
    for table, df in tables.items():
        cids = [i for i, c in enumerate(columns) if c.table == table and c.eligible]
        for batch in _batches(cids, batch_size):
            aggs, cells = ["count(1) AS rows"], []
            for cid in batch:
                spec = columns[cid]
                size = f"sum(CAST(octet_length({spec.name}) AS BIGINT))" if spec.is_string else "CAST(NULL AS BIGINT)"
                aggs += [
                    f"approx_count_distinct({spec.key(case_insensitive)}) AS d_{cid}",
                    f"count({spec.name}) AS nn_{cid}",
                    f"{size} AS b_{cid}",
                ]
                cells.append(
                    f"struct({cid} AS cid, rows, nn_{cid} AS non_null, d_{cid} AS distinct_values, b_{cid} AS bytes)"
                )
            counted = df.selectExpr(*aggs).filter("rows > 0")
            results.append(counted.selectExpr(f"inline(array({', '.join(cells)}))"))
    return union_all(results) if results else None


def with_ratios(df: DataFrame) -> DataFrame:
    """Distinct ratio and duplication factor from stored counts."""
    non_null = F.col("sample_rows") - F.col("null_count")
    ratio = F.when(non_null <= 0, F.lit(0.0)).otherwise(safe_div(F.col("distinct_values"), non_null))
    return df.withColumns(
        {
            "distinct_ratio": ratio,
            "duplication_factor": safe_div(non_null, F.col("distinct_values")),
        }
    )


def column_verdict() -> Column:
    factor, ratio = F.col("duplication_factor"), F.col("distinct_ratio")
    return (
        F.when(~F.col("analyzed"), F.col("skip_reason"))
        .when(factor >= 100, COLUMN_VERDICTS["excellent"])
        .when(factor >= 10, COLUMN_VERDICTS["good"])
        .when(F.col("dictionary_pressure"), COLUMN_VERDICTS["bad"])
        .when(ratio > 0.9, COLUMN_VERDICTS["poor"])
        .otherwise(COLUMN_VERDICTS["neutral"])
    )


def _judge(joined: DataFrame) -> DataFrame:
    non_null = F.coalesce("non_null", F.lit(0))
    rows = F.coalesce("rows", F.lit(0))
    stored = joined.select(
        "table", "column", "ordinal", "data_type", "is_string", "is_date", "is_lob", "is_computed",
        F.col("rows").isNotNull().alias("analyzed"),
        "skip_reason",
        rows.alias("sample_rows"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        (rows - non_null).alias("null_count"),
        F.when(non_null == 0, 0.0)
        .when(F.col("is_string"), safe_div(F.col("bytes"), non_null))
        .otherwise(F.col("width").cast("double"))
        .alias("avg_byte_length"),
    )
    pressure = (
        F.col("is_string")
        & F.col("analyzed")
        & (F.col("distinct_ratio") > 0.5)
        & (F.col("avg_byte_length") > 16)
    )
    return (
        with_ratios(stored)
        .withColumn("dictionary_pressure", pressure)
        .withColumn("verdict", column_verdict())
    )


def sample_percent(rows: int, target: int = SAMPLE_TARGET_ROWS) -> float | None:
    """Percentage to sample, four decimals; None when the table is small enough to read whole."""
    if rows <= 2 * target:
        return None
    return round(max(0.1, min(100.0, 100.0 * target / rows)), 4)


def sample_table(
    df: DataFrame,
    rows: int,
    target: int = SAMPLE_TARGET_ROWS,
    key: str | None = None,
    seed: int = SAMPLE_SEED,
    by_file: bool = False,
) -> DataFrame:
    """Seeded sample of a table with more than twice `target` rows; smaller tables are kept whole.

    By default single rows are drawn, which reads every file. With `key`, whole keys
    are drawn by hash, which any engine can repeat. With `by_file`, whole files are
    drawn: the others are not opened, which suits tables of thousands of files.
    """
    percent = sample_percent(rows, target)
    if percent is None:
        return df
    if by_file:
        return df.filter(_file_bucket(seed) < int(round(percent * 10_000)))
    if key is None:
        return df.sample(withReplacement=False, fraction=percent / 100, seed=seed)
    return df.filter(hash_bucket(F.col(key)) < int(round(percent * 10_000)))


def _file_bucket(seed: int) -> Column:
    """Bucket of the file a row comes from. Spark prunes files on it before the scan."""
    return F.pmod(F.xxhash64("_metadata.file_path", F.lit(seed)), F.lit(1_000_000))
