"""Workload evidence: statement logs, their match to tables, and what they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import contains_ci, safe_div, safe_pct, starts_with_ci, thousands
from tablescope.functions.constants import (
    STALE_LOG_REASON_BITS,
    STATEMENTS_PER_TABLE,
)
from tablescope.functions.frames import top_k
from tablescope.operators.findings import emit, finding

# Bytes in the runs that names are looked up by: the greatest of these that a name has.
RUNS = (4, 2, 1)


def slice_statement(text: Column, start: Column, end: Column) -> Column:
    """One statement cut out of its batch; offsets count two bytes per character, end -1 is the end."""
    last = F.when(end == -1, F.char_length(text) * 2).otherwise(end)
    return F.substring(text, _half(start) + 1, _half(last - start) + 1)


def _half(value: Column) -> Column:
    return F.floor(value / 2).cast("int")


def cached_statements(stats: DataFrame, texts: DataFrame, source: str = "PlanCache") -> DataFrame:
    """Statement log from per-statement counters and batch texts; microseconds become ms."""
    # One batch may hold many of the statements.
    joined = stats.join(texts, ["server", "handle"], "inner")
    return joined.select(
        "server",
        F.lit(source).alias("source"),
        "execution_count",
        "total_logical_reads",
        (F.col("total_worker_us") / 1000.0).alias("total_cpu_ms"),
        (F.col("total_elapsed_us") / 1000.0).alias("total_elapsed_ms"),
        "last_execution_time",
        slice_statement(F.col("text"), F.col("start_offset"), F.col("end_offset")).alias("statement_text"),
    ).filter(F.col("statement_text").isNotNull())


def interval_totals(
    runtime_stats: DataFrame,
    intervals: DataFrame,
    plans: DataFrame,
    query_ids: DataFrame,
    texts: DataFrame,
    top_n: int | None = None,
    source: str = "QueryStore",
) -> DataFrame:
    """Interval averages rolled up to totals per statement text; with `top_n` only the first by CPU of each server.

    Statements that go to `match_statements` are not cut here: it ranks them by reads. Totals are formed per plan, query and text, each time before the next join,
    so a hot plan or text is one row when it is shuffled.
    """
    runs = F.col("count_executions")
    totals = runtime_stats.join(intervals, ["server", "interval_id"], "inner").select(
        "server", "plan_id", "end_time", runs.alias("executions"),
        (F.col("avg_logical_io_reads") * runs).alias("reads"),
        (F.col("avg_cpu_time") * runs).alias("cpu"),
        (F.col("avg_duration") * runs).alias("duration"),
    )

    def roll(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy("server", key).agg(
            *[F.sum(c).alias(c) for c in ["executions", "reads", "cpu", "duration"]],
            F.max("end_time").alias("end_time"),
        )

    by_plan = roll(totals, "plan_id")
    by_query = roll(by_plan.join(plans, ["server", "plan_id"]), "query_id")
    by_text_id = roll(by_query.join(query_ids, ["server", "query_id"]), "text_id")
    by_text = roll(by_text_id.join(texts, ["server", "text_id"]), "query_text")
    if top_n is not None:
        by_text = top_k(by_text, ["server"], [F.col("cpu").desc(), F.col("query_text")], top_n)
    return by_text.select(
        "server",
        F.lit(source).alias("source"),
        F.col("executions").alias("execution_count"),
        F.col("reads").cast("bigint").alias("total_logical_reads"),
        (F.col("cpu") / 1000.0).alias("total_cpu_ms"),
        (F.col("duration") / 1000.0).alias("total_elapsed_ms"),
        F.col("end_time").alias("last_execution_time"),
        F.col("query_text").alias("statement_text"),
    )


def source_gate(status: DataFrame) -> DataFrame:
    """Which log sources may be used, and a caveat for those that stopped capturing."""
    stale = (F.col("actual_state") == "READ_ONLY") & (
        F.col("readonly_reason").bitwiseAND(F.lit(STALE_LOG_REASON_BITS)) != 0
    )
    caveat = F.concat(
        F.lit("Query Store is stuck READ_ONLY (using "), thousands(F.col("current_mb")), F.lit(" of "),
        thousands(F.col("max_mb")), F.lit(" MB): statements captured since are missing"),
    )
    return status.withColumns(
        {
            "usable": F.coalesce((F.col("actual_state") != "OFF") & ~stale, F.lit(False)),
            "caveat": F.when(stale, caveat),
        }
    )


def caveat_findings(gated: DataFrame) -> DataFrame:
    """One finding per log source that stopped capturing."""
    row = finding("Workload evidence", "Low", "Statement log is stale", F.col("caveat"), object=F.col("source"))
    return emit(gated, F.when(F.col("caveat").isNotNull(), row))


def trusted_statements(log: DataFrame, gated: DataFrame) -> DataFrame:
    """Drops the statements of unusable sources; sources without a status stay."""
    unusable = gated.filter(~F.col("usable")).select("server", "source").distinct()
    return log.join(unusable, ["server", "source"], "left_anti")


def match_statements(log: DataFrame, names: DataFrame, top: int = STATEMENTS_PER_TABLE) -> DataFrame:
    """Statements that contain a table's name (literal, any case): top by reads per table and source.

    `names` has server, table and name. Each name is looked up by its rarest character run: the one that its server's
    log holds least often. Both passes over the log, the count and the look-up, list (statement id, run); the
    id is a hash of the text. Only the rows of candidate ids are verified against their own text, so equal hashes
    cost a comparison and change no result, and no text is shuffled before the candidates are known.
    """
    names = names.filter(F.col("name") != "").select("server", "table", "name").distinct()
    # both sides are lowered once, not per pair
    foreign = log.filter(~contains_ci(F.col("statement_text"), "AS __rows")).withColumn("_text", F.lower("statement_text"))
    foreign = foreign.withColumn("_statement", F.xxhash64("_text"))
    wanted = _name_runs(names)
    listed = _statement_runs(foreign, wanted)
    keys = _rarest_runs(wanted, listed)
    candidates = listed.join(keys, ["server", "_run"]).select("server", "_statement", "table", "_name").distinct()
    matched = foreign.join(candidates, ["server", "_statement"]).filter(F.contains("_text", "_name"))
    order = [
        F.col("total_logical_reads").desc(),
        F.col("statement_text"),
        F.col("execution_count").desc(),
        F.col("last_execution_time").desc(),
    ]
    return top_k(matched.drop("_name", "_text", "_statement"), ["server", "table", "source"], order, top)


def _runs_of(text: str, length: int) -> Column:
    """All runs of that many bytes: UTF-8 text holds a name where its bytes do, and bytes are cut out without counting characters."""
    first = F.sequence(F.lit(1), F.greatest(F.octet_length(text) - (length - 1), F.lit(1)))
    # the bytes are made once per text, not once per run
    runs = F.transform(F.array(F.col(text).cast("binary")), lambda raw: F.transform(first, lambda i: F.substring(raw, i, F.lit(length))))
    return F.when(F.octet_length(text) >= length, F.flatten(runs)).otherwise(F.array().cast("array<binary>"))


def _by_length(text: str) -> Column:
    runs = F.when(F.col("_length") == RUNS[0], _runs_of(text, RUNS[0]))
    for length in RUNS[1:]:
        runs = runs.when(F.col("_length") == length, _runs_of(text, length))
    return runs


def _name_runs(names: DataFrame) -> DataFrame:
    """server, table, _name, _length, _runs: a name's runs, of the greatest length in RUNS that it has."""
    lowered = names.select("server", "table", F.lower("name").alias("_name"))
    length = F.coalesce(*[F.when(F.octet_length("_name") >= n, n) for n in RUNS])
    return lowered.withColumn("_length", length).withColumn("_runs", _by_length("_name"))


def _statement_runs(statements: DataFrame, wanted: DataFrame) -> DataFrame:
    """server, _statement, _run: every run of a length that some name asks for."""
    # as many rows as RUNS has lengths at most
    lengths = F.broadcast(wanted.select("_length").distinct())
    each = statements.select("server", "_statement", "_text", F.explode(F.array(*map(F.lit, RUNS))).alias("_length"))
    return each.join(lengths, "_length").select("server", "_statement", F.explode(_by_length("_text")).alias("_run"))


def _rarest_runs(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """server, _run, table, _name: a name's run that occurs least often. Names with a run that occurs nowhere are left out."""
    split = wanted.select("server", "table", "_name", F.explode("_runs").alias("_run")).distinct()
    of = split.groupBy("server", "table", "_name").agg(F.count("*").alias("_of"))
    counts = listed.join(split.select("server", "_run").distinct(), ["server", "_run"]).groupBy("server", "_run").agg(F.count("*").alias("_rows"))
    found = split.join(counts, ["server", "_run"]).groupBy("server", "table", "_name").agg(
        F.min(F.struct("_rows", "_run")).getField("_run").alias("_run"), F.count("*").alias("_found")
    )
    whole = found.join(of, ["server", "table", "_name"]).filter("_found = _of")
    return whole.select("server", "_run", "table", "_name")


def classify(df: DataFrame, text: str = "statement_text") -> DataFrame:
    """Adds is_insert, is_aggregation, is_own (the profiler's statements) and shreds_json."""
    t = F.col(text)
    insert = starts_with_ci(F.regexp_replace(t, r"^[\s\u0085\p{Z}]+", ""), "INSERT")
    grouped = contains_ci(t, "GROUP BY")
    for call in ["SUM(", "AVG(", "COUNT("]:
        grouped = grouped | contains_ci(t, call)
    return df.withColumns(
        {
            "is_insert": insert,
            "is_aggregation": contains_ci(t, "SELECT") & grouped & ~insert,
            "is_own": contains_ci(t, "AS __rows") | contains_ci(t, "COUNT_BIG(DISTINCT"),
            "shreds_json": contains_ci(t, "OPENJSON"),
        }
    )


def heaviest_statement(
    matches: DataFrame, min_aggregation_reads: int = 100_000, min_reads: int = 500_000
) -> DataFrame:
    """The statement that best explains each table's load, or the fact that it is only inserted to."""
    user = classify(matches).filter(~F.col("is_own"))
    reads = F.col("total_logical_reads")
    candidate = F.struct(
        reads.alias("reads"), "statement_text", "execution_count", "total_cpu_ms", "source", "shreds_json"
    )
    top = user.groupBy("server", "table").agg(
        F.max(F.when(F.col("is_aggregation"), candidate)).alias("agg"),
        F.max(candidate).alias("any"),
        F.every("is_insert").alias("only_inserts"),
        F.bool_or("is_aggregation").alias("has_aggregation"),
    )
    kind = (
        F.when(F.col("agg.reads") > min_aggregation_reads, "aggregation")
        .when(F.col("any.reads") > min_reads, "heaviest")
        .when(F.col("only_inserts"), "insert_only")
        .otherwise("none")
    )
    shown = F.when(kind == "aggregation", F.col("agg")).when(kind == "heaviest", F.col("any"))
    return (
        top.withColumns({"kind": kind, "s": shown})
        .select("server", "table", "kind", "has_aggregation", "s.*")
        .withColumn(
            "reads_per_execution", F.when(F.col("reads").isNotNull(), safe_div(F.col("reads"), F.col("execution_count")))
        )
    )


def insert_only() -> Column:
    return (F.col("leaf_inserts") > 0) & (F.col("leaf_updates") == 0) & (F.col("leaf_deletes") == 0)


def workload_flags(
    tables: DataFrame, many_lookups: int = 100_000, long_latch_ms: int = 10_000
) -> DataFrame:
    """Per-table workload observations; all false for a table without any usage."""
    used = F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups") + F.col("user_updates") > 0
    writes = F.col("leaf_inserts") + F.col("leaf_updates") + F.col("leaf_deletes")
    return tables.withColumns(
        {
            "is_used": used,
            "is_insert_only": insert_only(),
            "append_only_writes": used & insert_only(),
            "update_heavy": used & ~insert_only() & (safe_pct(F.col("leaf_updates"), writes) >= 20),
            "uncovered_lookups": used & (F.col("user_lookups") > many_lookups),
            "io_bound": used & (F.col("page_io_latch_wait_ms") > long_latch_ms),
        }
    )


def counters_reset(tables: DataFrame, matches: DataFrame) -> DataFrame:
    """True per server when no table shows usage although statements were matched."""
    used = F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups") + F.col("user_updates")
    flags = tables.groupBy("server").agg(F.every(used == 0).alias("all_unused"))
    evidence = matches.groupBy("server").agg(F.count(F.lit(1)).alias("matched_statements"))
    return (
        flags.join(evidence, "server", "left")
        .fillna(0, ["matched_statements"])
        .withColumn("counters_reset", F.col("all_unused") & (F.col("matched_statements") > 0))
    )
