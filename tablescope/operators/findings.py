"""The uniform finding row: building, normalising, scoping, de-duplicating, counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import (
    equals_ci,
    is_blank,
    severity_from_priority,
    severity_rank,
)
from tablescope.functions.constants import FINDING_ROLES
from tablescope.functions.frames import top_k, union_all

FINDING_COLUMNS = [
    "source", "category", "severity", "severity_rank", "title", "details", "recommendation",
    "database", "object", "raw", "needs_annotation", "question",
]
DEDUPE_FIELDS = ["source", "category", "severity", "title", "details", "database", "object"]


def _text(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(value).cast("string")


def finding(
    category,
    severity,
    title,
    details="",
    recommendation=None,
    database=None,
    object=None,
    question=None,
    source="Native",
    raw: Column | None = None,
) -> Column:
    """One finding as a struct; plain values become literals."""
    severity = _text(severity)
    return F.struct(
        _text(source).alias("source"),
        _text(category).alias("category"),
        severity.alias("severity"),
        severity_rank(severity).alias("severity_rank"),
        _text(title).alias("title"),
        F.coalesce(_text(details), F.lit("")).alias("details"),
        _text(recommendation).alias("recommendation"),
        _text(database).alias("database"),
        _text(object).alias("object"),
        (F.lit(None).cast("map<string,string>") if raw is None else raw).alias("raw"),
        F.lit(question is not None).alias("needs_annotation"),
        _text(question).alias("question"),
    )


def emit(df: DataFrame, *findings: Column, keys: Sequence[str] = ("server",)) -> DataFrame:
    """0..n findings per row in one pass: nulls are dropped, the rest become rows."""
    present = F.filter(F.array(*findings), lambda f: f.isNotNull())
    return df.select(*keys, F.inline(present))


def looks_like_findings(df: DataFrame) -> bool:
    """Does the result set have a priority or title column? Decided on the schema alone."""
    return _role(df, "priority") is not None or _role(df, "title") is not None


def _role(df: DataFrame, role: str) -> str | None:
    by_lower: dict[str, str] = {}
    for name in df.columns:
        by_lower.setdefault(name.lower(), name)
    return next((by_lower[c.lower()] for c in FINDING_ROLES[role] if c.lower() in by_lower), None)


def split_result_sets(
    prefix: str, frames: Sequence[DataFrame]
) -> tuple[list[tuple[str, DataFrame]], list[tuple[str, DataFrame]]]:
    """Names the result sets of one call and separates findings from plain tables.

    The first keeps the prefix, later ones get ' (2)', ' (3)', ...; sets without columns are dropped.
    """
    named = [
        (prefix if i == 1 else f"{prefix} ({i})", df) for i, df in enumerate(frames, 1) if df.columns
    ]
    findings = [(name, df) for name, df in named if looks_like_findings(df)]
    return findings, [(name, df) for name, df in named if not looks_like_findings(df)]


def _priority(df: DataFrame, column: str) -> Column:
    col = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        # A fractional type still holds a priority if its value is whole.
        return F.when(col == F.floor(col), col.cast("bigint"))
    return F.trim(col.cast("string")) if isinstance(kind, T.StringType) else col


def normalise_findings(source: str, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Any result set as findings; `keys` (such as server) are carried along, not normalised."""
    body = df.drop(*keys)
    col = lambda role: (lambda c: None if c is None else F.col(f"`{c}`").cast("string"))(_role(body, role))
    names = body.columns
    values = [F.col(f"`{c}`").cast("string") for c in names]
    row_text = F.concat_ws(
        "; ", *[F.concat(F.lit(f"{c}="), F.coalesce(v, F.lit(""))) for c, v in zip(names, values)]
    )
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*values))
    database = col("database")
    if database is not None:
        database = F.when(~is_blank(database), F.trim(database))

    if not looks_like_findings(body):
        row = finding(
            "Uncategorized", "Info", f"{source} row (unrecognized schema)", row_text,
            database=database, source=source, raw=raw,
        )
        return df.select(*keys, row.alias("f")).select(*keys, "f.*")

    priority, title, details = _role(body, "priority"), col("title"), col("details")
    severity = severity_from_priority(_priority(body, priority)) if priority else F.lit("Info")
    generic = F.lit(f"{source} finding")
    row = finding(
        F.lit("") if col("category") is None else F.coalesce(col("category"), F.lit("")),
        severity,
        generic if title is None else F.when(is_blank(title), generic).otherwise(title),
        row_text if details is None else F.coalesce(details, F.lit("")),
        recommendation=col("recommendation"),
        database=database,
        source=source,
        raw=raw,
    )
    return df.select(*keys, row.alias("f")).select(*keys, "f.*")


def read_rows(df: DataFrame, text: str = "row", keys: Sequence[str] = ()) -> DataFrame:
    """Result rows of unknown schema, each a JSON object in `text`: the keys, variant, shape, names, cells.

    The shape is the row's sorted field names; cells are its values as text, nested ones as JSON, in the order of the names. What is no object has
    null in all of them. Rows of any number of shapes may be mixed: no schema is asked for and none is inferred.
    """
    value = F.try_parse_json(F.col(f"`{text}`"))
    entries = F.array_sort(F.map_entries(F.try_variant_get(value, "$", "map<string,string>")))
    parsed = df.select(*keys, value.alias("variant"), entries.alias("_entries"))
    return parsed.select(
        *keys, F.when(F.col("_entries").isNotNull(), F.col("variant")).alias("variant"),
        F.array_join(F.col("_entries.key"), ", ").alias("shape"), F.col("_entries.key").alias("names"), F.col("_entries.value").alias("cells"),
    )


def shapes_of(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each shape of read_rows with its rows, its merged schema, and whether it looks like findings."""
    known = rows.filter(F.col("shape").isNotNull()).withColumn("is_finding", _has("priority") | _has("title"))
    return known.groupBy(*keys, "shape").agg(
        F.count(F.lit(1)).alias("rows"), F.schema_of_variant_agg("variant").alias("schema"), F.first("is_finding").alias("is_finding")
    )


def _place(role: str) -> Column:
    """Place of the first candidate that the row has, in any case; null if it has none."""
    lowered = F.transform("names", F.lower)
    places = F.array(*[F.array_position(lowered, c.lower()) for c in FINDING_ROLES[role]])
    return F.get(F.filter(places, lambda p: p > 0), F.lit(0))


def _has(role: str) -> Column:
    return _place(role).isNotNull()


def _cell(role: str) -> Column:
    return F.get("cells", (_place(role) - 1).cast("int"))


def foreign_rows(source: str, rows: DataFrame, keys: Sequence[str] = ("server",)) -> dict[str, DataFrame]:
    """Result rows of any shapes (read_rows) split into findings, plain rows (keys, shape, cells by name) and rejected ones (keys).

    Each row is normalised by its own fields, as normalise_findings does a result set by its columns.
    """
    known = rows.filter(F.col("shape").isNotNull())
    shaped = _has("priority") | _has("title")
    raw = F.map_from_arrays("names", "cells")
    cells = F.transform(F.arrays_zip("names", "cells"), lambda c: F.concat(c["names"], F.lit("="), F.coalesce(c["cells"], F.lit(""))))
    row_text = F.array_join(cells, "; ")
    priority = F.trim(_cell("priority"))
    whole = F.when(priority.try_cast("double") == F.floor(priority.try_cast("double")), F.floor(priority.try_cast("double")))
    title, database = _cell("title"), _cell("database")
    row = finding(
        F.coalesce(_cell("category"), F.lit("")),
        F.when(_has("priority"), severity_from_priority(F.coalesce(whole.cast("string"), priority))).otherwise("Info"),
        F.when(~is_blank(title), title).otherwise(f"{source} finding"),
        F.when(_has("details"), F.coalesce(_cell("details"), F.lit(""))).otherwise(row_text),
        recommendation=_cell("recommendation"),
        database=F.when(~is_blank(database), F.trim(database)),
        source=source,
        raw=raw,
    )
    return {
        "findings": known.filter(shaped).select(*keys, row.alias("f")).select(*keys, "f.*"),
        "plain": known.filter(~shaped).select(*keys, "shape", raw.alias("cells")),
        "rejected": rows.filter(F.col("shape").isNull()).select(*keys),
    }


def scope_to_database(findings: DataFrame, database: str, all_databases: bool = False) -> DataFrame:
    """Keeps findings of one database and those without a database."""
    if all_databases:
        return findings
    return findings.filter(F.col("database").isNull() | equals_ci(F.col("database"), database))


def dedupe_key(fields: Sequence[str] = DEDUPE_FIELDS) -> Column:
    """Digest of the fields joined by U+0001: case-insensitive, null equals empty."""
    cells = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    return F.sha2(F.concat_ws("\u0001", *cells), 256)


def dedupe_keep_first(
    findings: DataFrame,
    sequence: Sequence[str],
    fields: Sequence[str] = DEDUPE_FIELDS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """First row per dedupe key, in the order of the unique `sequence` columns.

    Rows are grouped by a 64-character digest, and each task forwards one row
    per digest, so a text copied a million times is shuffled once per task.
    """
    keyed = findings.withColumn("_key", dedupe_key(fields))
    return top_k(keyed, [*keys, "_key"], [F.col(c) for c in sequence], 1).drop("_key")


def remember(
    store: DataFrame | None,
    findings: DataFrame,
    run_time: Column,
    sequence: Sequence[str],
    fields: Sequence[str] = DEDUPE_FIELDS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Findings of all runs, each once: the row that reported it first, with finding_key, first_seen and last_seen.

    `store` is what earlier runs left, None before the first. What it knows is found by key and only dated anew;
    what it does not know is de-duplicated by `sequence`, so old findings are never ranked again.
    """
    keyed = findings.withColumn("finding_key", dedupe_key(fields))
    by = [*keys, "finding_key"]
    if store is None:
        known, fresh = None, keyed
    else:
        again = keyed.select(*by).distinct().withColumn("_again", F.lit(True))
        last = F.when(F.col("_again"), F.greatest("last_seen", run_time)).otherwise(F.col("last_seen"))
        known = store.join(again, by, "left").withColumn("last_seen", last).drop("_again")
        fresh = keyed.join(store.select(*by), by, "left_anti")
    new = top_k(fresh, by, [F.col(c) for c in sequence], 1).withColumns({"first_seen": run_time, "last_seen": run_time})
    return new if known is None else known.unionByName(new)


def union_findings(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks in one table; seq is the position of the check."""
    return union_all([df.withColumn("seq", F.lit(i).cast("bigint")) for i, df in enumerate(checks)])


def finalize(
    checks: Sequence[DataFrame], database: str, all_databases: bool = False, keys: Sequence[str] = ("server",)
) -> DataFrame:
    """Union, scope, then de-duplicate.

    Of equal findings the first stays: by check, title, details, database, object, recommendation, question, and last by a
    digest of the whole row (maps as JSON), so that the survivor is always the same.
    """
    scoped = scope_to_database(union_findings(checks), database, all_databases)
    whole = F.md5(F.to_json(F.struct(*scoped.columns), {"ignoreNullFields": "false"}))
    order = ["seq", "title", "details", "database", "object", "recommendation", "question", "_whole"]
    return dedupe_keep_first(scoped.withColumn("_whole", whole), order, keys=keys).drop("_whole")


def by_urgency(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.col("severity_rank").desc(), "category", "title", "details", "database", "object")


def finding_rollup(findings: DataFrame) -> DataFrame:
    """Findings and worst severity per category."""
    return findings.groupBy("category").agg(
        F.count(F.lit(1)).alias("findings"), F.max("severity_rank").alias("worst_rank")
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    """How many findings are critical, high, or need an answer from a person."""
    return findings.agg(
        F.count_if(F.col("severity") == "Critical").alias("critical"),
        F.count_if(F.col("severity") == "High").alias("high"),
        F.count_if("needs_annotation").alias("open_questions"),
        F.count(F.lit(1)).alias("findings"),
    )


def open_questions(findings: DataFrame) -> DataFrame:
    return findings.filter("needs_annotation").select("category", "title", "details", "object", "question")
