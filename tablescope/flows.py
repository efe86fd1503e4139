"""The three audits as whole: table report, health check, access audit.

Each takes input DataFrames by the names of `sources.schemas`, stays lazy, and
returns DataFrames by name. Checks whose inputs are absent are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import moment
from tablescope.functions.constants import MIN_MB, MIN_ROWS, SAMPLE_TARGET_ROWS, TOP_TABLES
from tablescope.functions.frames import constant_rows, newest_snapshot, union_all
from tablescope.operators import access as A
from tablescope.operators import discover as D
from tablescope.operators import findings as N
from tablescope.operators import indexes as X
from tablescope.operators import oplog as O
from tablescope.operators import profile as P
from tablescope.operators import score as C
from tablescope.operators import shape as S
from tablescope.operators import workload as L
from tablescope.sources import sinks
from tablescope.sources.schemas import SCHEMAS

# Columns of a statement log.
LOG = [column.split()[0] for column in SCHEMAS["query_log"].split(", ")]

# Inputs that list a server's state: each snapshot (collected_at) lists all of it.
STATE = (
    "waits databases integrity_checks settings temp_files jobs principals replicas replica_databases db_principals"
    " server_role_members linked_servers components db_role_members db_permissions objects db_schemas columns"
).split()


def current_state(inputs: Mapping[str, DataFrame], as_of) -> dict[str, DataFrame]:
    """Inputs that carry collected_at, reduced to each server's newest snapshot as of `as_of`."""
    out = dict(inputs)
    for name in STATE:
        df = inputs.get(name)
        if df is not None and "collected_at" in df.columns:
            limit = None if as_of is None else moment(as_of).cast(df.schema["collected_at"].dataType)
            out[name] = newest_snapshot(df, "collected_at", limit).drop("collected_at")
    return out


def health_check(
    inputs: Mapping[str, DataFrame],
    as_of,
    database: str = "",
    all_databases: bool = True,
    foreign: Iterable[tuple[str, Sequence[DataFrame]]] = (),
    foreign_text: Iterable[tuple[str, DataFrame]] = (),
) -> dict[str, DataFrame]:
    """Every check with inputs, as one scoped and de-duplicated finding table.

    `foreign` are result sets of other tools, each with a server column; those
    that do not look like findings are returned under their own name. `foreign_text` are rows (server, row) of
    other tools as JSON objects, of any mixture of schemas: what is no finding is returned as '<tool> (plain)', what is no object as '<tool> (rejected)'.
    """
    at = current_state(inputs, as_of)
    has = lambda *names: all(n in at for n in names)
    checks: list[DataFrame] = []
    out: dict[str, DataFrame] = {}
    if has("components"):
        out["components"] = O.component_inventory(at["components"])
    if has("jobs", "job_runs", "job_activity"):
        out["maintenance_jobs"] = O.maintenance_status(
            at["jobs"], O.until(at["job_runs"], "run_time", as_of), O.until(at["job_activity"], "start_time", as_of)
        )
    if has("waits"):
        checks.append(O.wait_findings(O.top_waits(at["waits"])))
    if has("integrity_checks"):
        checks.append(O.integrity_findings(at["integrity_checks"], as_of))
    if has("databases", "backups"):
        checks.append(O.freshness_findings(O.backup_recency(at["databases"], at["backups"], as_of), as_of))
    measures = []
    if has("temp_files"):
        measures.append(O.temp_file_measures(at["temp_files"]))
    if has("settings"):
        measures.append(O.setting_measures(at["settings"]))
    if has("databases"):
        measures += [O.database_measures(at["databases"]), O.topology_measures(at["databases"])]
    checks += [O.rule_findings(m) for m in measures]
    if has("jobs", "job_runs"):
        checks.append(O.failure_findings(O.recent_failures(at["job_runs"], at["jobs"], as_of)))
    if has("jobs", "principals"):
        checks.append(O.owner_findings(O.owner_audit(at["jobs"], at["principals"])))
    if has("principals", "server_role_members"):
        checks.append(O.role_member_findings(at["principals"], at["server_role_members"]))
    if has("principals"):
        checks.append(O.disabled_login_findings(at["principals"]))
    if has("db_principals", "principals"):
        checks.append(O.orphan_findings(O.orphaned_users(at["db_principals"], at["principals"])))
    if has("linked_servers"):
        checks.append(O.linked_server_findings(at["linked_servers"]))
    if has("replicas", "replica_databases"):
        health, lag = O.replica_health(at["replicas"]), O.replica_lag(at["replica_databases"])
        checks += [health, lag, O.all_healthy(at["replicas"], health.unionByName(lag))]
    if has("replication_errors"):
        checks.append(O.error_findings(O.recent_errors(at["replication_errors"], as_of)))
    for tool, frames in foreign:
        shaped, plain = N.split_result_sets(tool, frames)
        checks += [N.normalise_findings(tool, df, keys=["server"]) for _, df in shaped]
        out.update(plain)
    for tool, df in foreign_text:
        parts = N.foreign_rows(tool, N.read_rows(df, keys=["server"]))
        checks.append(parts["findings"])
        out.update({f"{tool} ({part})": parts[part] for part in ("plain", "rejected")})
    if checks:
        out["findings"] = N.finalize(checks, database, all_databases)
    return out


def access_audit(inputs: Mapping[str, DataFrame], as_of=None, grants: DataFrame | None = None) -> dict[str, DataFrame]:
    """Logins, users, grants, findings and summaries of every database, as each server's newest snapshot has them.

    Five outputs read the resolved grants: pass them as a written table (`grants`) to resolve them once.
    """
    inputs = current_state(inputs, as_of)
    roles = A.principal_roles(inputs["principals"], inputs["server_role_members"])
    users = A.resolve_users(inputs["db_principals"], inputs["principals"])
    logins = A.users_per_login(roles, users)
    if grants is None:
        named = A.named_grants(
            A.distinct_grants(inputs["db_permissions"]), inputs["db_principals"], inputs["objects"], inputs["db_schemas"], inputs["columns"]
        )
        grants = A.every_grant(named)
    else:
        named = grants
    return {
        "logins": logins,
        "users": users,
        "user_roles": A.user_roles(inputs["db_principals"], inputs["db_role_members"]),
        "grants": grants,
        "grant_groups": A.group_grants(named),
        "findings": A.access_findings(logins, users, A.risky_grants(named)),
        "summary": A.access_summary(logins, users, grants),
        "by_database": A.access_by_database(users, grants),
    }


def table_facts(
    inputs: Mapping[str, DataFrame], min_rows: int = MIN_ROWS, min_mb: int = MIN_MB, top_n: int = TOP_TABLES
) -> DataFrame:
    """Candidate tables of every server with sizes, usage, contention, write mix and flags."""
    found = D.discover_tables(
        inputs["tables"], inputs["table_schemas"], inputs["partition_stats"], min_rows, min_mb, top_n
    )
    used = D.usage_rollup(found, inputs["index_usage"], inputs["missing_index"])
    flagged = D.flag_columnar(used, inputs["indexes"])
    operations = D.operational_totals(inputs["operational_stats"])
    counters = [c for c in operations.columns if c not in D.TABLE_KEY]
    return (
        flagged.join(operations, D.TABLE_KEY, "left")
        .fillna(0, counters)
        .withColumn("table", F.concat_ws(".", "schema_name", "table_name"))
    )


def statement_evidence(inputs: Mapping[str, DataFrame]) -> tuple[DataFrame | None, DataFrame | None]:
    """(log, findings): the statements of every source that is there, and what is to be said of the sources.

    Cached statements need statement_stats and batch_texts; interval statistics need runtime_stats, runtime_intervals, query_plans,
    query_ids and query_texts; query_log is a log as it is. By log_status, statements of a source that is off or stopped capturing
    are dropped; of the latter there is a finding. A status without a source column is about the interval statistics.
    """
    has = lambda *names: all(n in inputs for n in names)
    logs: list[DataFrame] = []
    if has("statement_stats", "batch_texts"):
        logs.append(L.cached_statements(inputs["statement_stats"], inputs["batch_texts"]))
    interval_inputs = ["runtime_stats", "runtime_intervals", "query_plans", "query_ids", "query_texts"]
    if has(*interval_inputs):
        logs.append(L.interval_totals(*[inputs[n] for n in interval_inputs]))
    if has("query_log"):
        logs.append(inputs["query_log"].select(*LOG))
    log = union_all(logs) if logs else None
    if not has("log_status"):
        return log, None
    status = inputs["log_status"]
    if "source" not in status.columns:
        status = status.withColumn("source", F.lit("QueryStore"))
    gated = L.source_gate(status)
    return None if log is None else L.trusted_statements(log, gated), L.caveat_findings(gated)


def without_columnar(tables: Mapping, facts: DataFrame) -> dict:
    """The tables that are not columnar yet: the others need no profile.

    Runs one small job over `facts`; what comes back is at most one key per entry of `tables`.
    """
    by_server = _by_server(tables)
    names = sorted({key[1] if by_server else key for key in tables})
    keys = ["server", "table"] if by_server else ["table"]
    columnar = facts.filter(F.col("has_columnstore") & F.col("table").isin(names)).select(*keys).distinct()
    if by_server:
        columnar = columnar.filter(F.col("server").isin(sorted({server for server, _ in tables})))
    known = {tuple(row) if by_server else row[0] for row in columnar.toLocalIterator()}
    return {key: df for key, df in tables.items() if key not in known}


def _by_server(tables: Mapping) -> bool:
    kinds = {isinstance(key, tuple) for key in tables}
    if len(kinds) > 1:
        raise ValueError("tables are keyed by name or by (server, name), not both")
    return True in kinds


def _with_percent(profile: DataFrame, keys: Sequence[str], row_counts: Mapping, target: int) -> DataFrame:
    """Adds sample_percent, null for tables that were read whole: ratios from a sample are no exact ones."""
    sampled = [(*(k if isinstance(k, tuple) else (k,)), P.sample_percent(n, target)) for k, n in row_counts.items()]
    ddl = ", ".join(f"{k} STRING" for k in keys) + ", sample_percent DOUBLE"
    noted = constant_rows(profile.sparkSession, [row for row in sampled if row[-1] is not None], ddl)
    return profile.join(noted, list(keys), "left")


def table_report(
    tables: Mapping,
    facts: DataFrame,
    log: DataFrame | None = None,
    index_inputs: Mapping[str, DataFrame] | None = None,
    row_counts: Mapping | None = None,
    sample_target: int = SAMPLE_TARGET_ROWS,
    sample_files: bool = False,
    lob_columns: Iterable[tuple] = (),
    computed_columns: Iterable[tuple] = (),
    profile: DataFrame | None = None,
    log_inputs: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Profile, score and judge tables, and review their indexes.

    `tables` are keyed by name, or by (server, name) where servers hold tables of one name; `row_counts` and the listed columns
    likewise. `facts` has one row per table (see table_facts). A table that `facts` calls columnar needs no profile (see
    without_columnar): it is in the report, with score 0.
    `log` is a statement log, `log_inputs` are what one is made from (see statement_evidence); a statement belongs to a table
    whose table_name it contains. `index_inputs` are indexes, index_columns, partition_stats and index_usage.
    Tables listed in `row_counts` with more than twice `sample_target` rows are
    sampled, by rows or by whole files, and `columns` says so; the others are read whole. Most outputs read the profile: pass it
    as a written table (`profile`, from profile_columns or profile_servers) to read the tables once.
    """
    counts = row_counts or {}
    if profile is None:
        tables = {
            key: P.sample_table(df, counts.get(key, 0), sample_target, by_file=sample_files)
            for key, df in tables.items()
        }
        measure = P.profile_servers if _by_server(tables) else P.profile_columns
        profile = measure(tables, lob_columns, computed_columns)
    keys = ["server", "table"] if "server" in profile.columns else ["table"]
    shape = S.table_shape(profile, keys)
    joined = facts.join(shape.withColumn("_profiled", F.lit(True)), keys, "left").filter("_profiled OR has_columnstore")
    shaped = [f.name for f in shape.schema if f.name not in keys and isinstance(f.dataType, T.NumericType)]
    rated = D.size_ratios(D.write_ratios(D.usage_ratios(joined.drop("_profiled").fillna(0, shaped))))
    scored = C.score_tables(rated).withColumn("compressed_mb", S.compressed_mb())
    out = {
        "columns": _with_percent(profile, keys, counts, sample_target),
        "highlights": S.shape_highlights(profile, keys=keys),
        "top_columns": S.top_columns(profile, keys=keys),
    }
    if keys == ["server", "table"]:
        out["jackpots"] = S.jackpot_column(profile, facts, keys=keys)
        out["compressed"] = S.compressed_estimate(shape, facts, keys)
    else:
        # tables of one name share their profile, each with its own size
        named = profile.join(facts.select("server", "table"), "table")
        out["jackpots"] = S.jackpot_column(named, facts, keys=["server", "table"])
        each = shape.join(facts.select("server", "table"), "table")
        out["compressed"] = S.compressed_estimate(each, facts, ["server", "table"])
    if log_inputs is not None:
        made, said = statement_evidence(log_inputs)
        log = made if log is None or made is None else log.select(*LOG).unionByName(made.select(*LOG))
        if said is not None:
            out["log_findings"] = said
    if log is None:
        scored = scored.withColumn("has_aggregation", F.lit(False))
    else:
        names = facts.select("server", "table", F.col("table_name").alias("name"))
        out["statements"] = L.match_statements(log, names)
        out["heaviest_statements"] = L.heaviest_statement(out["statements"])
        out["counters_reset"] = L.counters_reset(facts, out["statements"])
        evidence = out["heaviest_statements"].select("server", "table", "has_aggregation")
        scored = scored.join(evidence, ["server", "table"], "left").fillna(False, ["has_aggregation"])
    scored = L.workload_flags(C.recommendation(scored).withColumn("verdict", C.verdict_tier()))
    out["candidates"] = C.ranked_candidates(scored)
    out["portfolio"] = C.portfolio_counts(scored)
    keyed = facts.select(*D.TABLE_KEY, "table")
    indexes = None
    if index_inputs is not None:
        inventory = X.index_inventory(
            *[
                index_inputs[name].join(keyed.select(*D.TABLE_KEY), D.TABLE_KEY, "left_semi")
                for name in ["indexes", "index_columns", "partition_stats", "index_usage"]
            ]
        )
        found = X.index_findings(inventory, facts, profile.join(keyed, keys))
        out["indexes"] = inventory
        out["dead_indexes"] = X.dead_indexes(inventory)
        out["index_findings"] = found.unionByName(X.tables_without_index(facts, index_inputs["indexes"]))
        out["punch_list"] = C.punch_list(found, scored)
        out["punch_total"] = C.punch_total(C.punch_list(found, scored, ordered=False))
        indexes = inventory.join(keyed, D.TABLE_KEY)
    columns = profile if "server" in keys else profile.join(facts.select("server", "table"), "table")
    out["digests"] = sinks.table_digest(scored, columns, indexes, out.get("statements"), keys=["server", "table"])
    return out
