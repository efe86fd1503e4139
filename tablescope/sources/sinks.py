"""Sinks: CSV-safe columns, nested JSON reports and compact digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import contains_ci, csv_clean
from tablescope.functions.frames import top_k

RATIO_COLUMNS = ("distinct_ratio",)


def plain_number(value: Column, places: int) -> Column:
    """Rounded, as text without exponent and without trailing zeros; what is not finite stays a word.

    Doubles beyond 28 digits keep their own form: they have no decimals to round.
    """
    exact = F.round(value, places).cast(f"decimal(38,{places})").cast("string")
    short = F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(short == "-0", "0").otherwise(short), value.cast("string"))


def csv_columns(df: DataFrame, statement_chars: int | None = None) -> DataFrame:
    """Text without line breaks, numbers rounded (ratios to four decimals, others to two) and written plainly,
    lists joined by ', ', maps and structs as JSON.

    With `statement_chars`, a statement_text that is longer is cut there and marked by '...'.
    """
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            col = plain_number(col, 4 if field.name in RATIO_COLUMNS else 2)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            col = csv_clean(F.array_join(col, ", "))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            col = csv_clean(F.to_json(col))
        elif isinstance(kind, T.StringType):
            if field.name == "statement_text" and statement_chars is not None:
                cut = F.concat(F.left(col, F.lit(statement_chars)), F.lit("..."))
                col = F.when(F.char_length(col) > statement_chars, cut).otherwise(col)
            col = csv_clean(col)
        out.append(col.alias(field.name))
    return df.select(*out)


CSV = {
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
}


def csv_lines(df: DataFrame, statement_chars: int | None = None) -> DataFrame:
    """Each row as the line that write_csv writes for it."""
    plain = csv_columns(df, statement_chars)
    return plain.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in plain.columns]), CSV).alias("line"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", statement_chars: int | None = None) -> None:
    """Quotes are doubled, nulls are empty, spaces at the ends stay; timestamps as yyyy-MM-dd HH:mm:ss."""
    csv_columns(df, statement_chars).write.mode(mode).options(header=True, **CSV).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _nest(parent: DataFrame, child: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[Column], name: str) -> DataFrame:
    """Attaches the child rows as a sorted array.

    A list holds the columns, indexes or kept statements of one table: bounded by
    the table's width, its index count, and the statements kept per table and source.
    """
    item = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("item"))
    lists = child.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).getField("item").alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parent.join(lists, list(keys), "left").withColumn(name, F.coalesce(name, empty))


def nested_report(
    tables: DataFrame,
    columns: DataFrame,
    indexes: DataFrame | None = None,
    statements: DataFrame | None = None,
    keys: Sequence[str] = ("table",),
) -> DataFrame:
    """Tables with their columns, indexes and statements nested, best score first."""
    others = lambda df: [F.col(c) for c in df.columns if c not in keys]
    out = _nest(tables, columns, keys, [F.col("ordinal")], others(columns), "columns")
    if indexes is not None:
        out = _nest(out, indexes, keys, [-F.col("size_mb").cast("double"), F.col("index_name")], others(indexes), "indexes")
    if statements is not None:
        order = [F.col("source"), -F.col("total_logical_reads"), F.col("statement_text")]
        out = _nest(out, statements, keys, order, others(statements), "referencing_queries")
    return out.orderBy(F.col("candidacy_score").desc(), *keys)


def _rounded(name: str, places: int = 1) -> Column:
    """Half-even, as an exact decimal so that its JSON form is the same everywhere."""
    return F.bround(F.col(name).cast("double"), places).cast(f"decimal(18,{places})")


def table_digest(
    tables: DataFrame,
    columns: DataFrame,
    indexes: DataFrame | None = None,
    statements: DataFrame | None = None,
    top: int = 5,
    keys: Sequence[str] = ("table",),
) -> DataFrame:
    """One compact JSON text per table: key figures, columns, indexes, heaviest statements."""
    column_item = [
        F.col("column").alias("name"), F.col("data_type").alias("type"), "analyzed",
        F.col("distinct_values").alias("distinct"), _rounded("duplication_factor").alias("duplicationFactor"),
        F.col("null_count").alias("nulls"), _rounded("avg_byte_length").alias("avgBytes"),
        F.col("is_computed").alias("computed"), F.col("is_lob").alias("lob"), "verdict",
    ]
    out = _nest(tables, columns, keys, [F.col("ordinal")], column_item, "columns")
    nested = ["columns"]
    if indexes is not None:
        index_item = [
            F.col("index_name").alias("name"), F.col("type_desc").alias("type"), _rounded("size_mb").alias("sizeMb"),
            F.array_join("key_columns", ", ").alias("keys"), F.array_join("included_columns", ", ").alias("includes"),
            "reads", F.col("user_updates").alias("writes"), "note",
        ]
        out = _nest(out, indexes, keys, [-F.col("size_mb").cast("double"), F.col("index_name")], index_item, "indexes")
        nested.append("indexes")
    if statements is not None:
        heaviest = [F.col("total_logical_reads").desc(), F.col("statement_text"), F.col("source")]
        kept = top_k(
            statements.filter(~contains_ci(F.col("statement_text"), "AS __rows")), list(keys), heaviest, top
        )
        item = [
            F.col("execution_count").alias("execs"), F.col("total_logical_reads").alias("reads"),
            F.bround("total_cpu_ms", 0).cast("bigint").alias("cpuMs"), F.col("statement_text").alias("text"),
        ]
        out = _nest(out, kept, keys, [-F.col("total_logical_reads"), F.col("statement_text")], item, "topQueries")
        nested.append("topQueries")
    figures = [
        F.col("candidacy_score").cast("decimal(18,1)").alias("score"), F.col("row_count").alias("rows"),
        _rounded("base_data_mb").alias("baseDataMb"), _rounded("nonclustered_mb").alias("ncIndexMb"),
        F.col("has_columnstore").alias("hasColumnstore"), _rounded("scan_pct").alias("scanPct"),
        _rounded("write_pct").alias("writePct"), _rounded("update_share_pct").alias("updateShareOfWritesPct"),
        F.col("user_seeks").alias("seeks"), F.col("user_scans").alias("scans"), F.col("user_lookups").alias("lookups"),
        F.col("user_updates").alias("writes"), F.col("leaf_inserts").alias("leafInserts"),
        F.col("leaf_updates").alias("leafUpdates"), F.col("leaf_deletes").alias("leafDeletes"),
        F.col("page_io_latch_wait_ms").alias("ioLatchWaitMs"), "notes",
    ]
    return out.select(*keys, F.to_json(F.struct(*keys, *figures, *nested)).alias("digest"))
