"""Queries on skewed tables, without broadcasts: a third of the rows share one key, source or text."""

import duckdb
import pytest
from oracle import TABLES, connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"

# The value that every third row gets.
HOT = {
    "lineitem": {"l_orderkey": "7::BIGINT", "l_partkey": "11::BIGINT", "l_suppkey": "3::BIGINT"},
    "orders": {"o_custkey": "5::BIGINT"},
    "events": {"user_id": "1::BIGINT"},
    "documents": {"text": "first(text) OVER (ORDER BY doc_id)", "source": "'src1'"},
    "conversations": {"conv_id": "9::BIGINT"},
    "customer": {"c_nationkey": "1::INTEGER"},
}

QUERIES = [
    "column_profile", "resolve_grants", "group_grants", "risky_grants", "resolve_users", "users_per_login", "owner_audit",
    "recent_failures", "statement_slice", "trusted_statements", "index_findings", "query_interval_totals", "inventory_findings",
    "principal_roles", "user_roles", "discover_tables", "orphans", "match_statements", "match_statements_many_names",
    "dedupe_keep_first", "findings_final", "health_check",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        values = HOT.get(name, {})
        replaced = ", ".join(f"CASE WHEN _n % 3 = 0 THEN {v} ELSE {c} END AS {c}" for c, v in values.items())
        columns = f"* REPLACE ({replaced})" if values else "*"
        con.execute(
            f"COPY (SELECT * EXCLUDE (_n) FROM (SELECT {columns} FROM"
            f" (SELECT *, row_number() OVER () AS _n FROM '{SF}/{name}.parquet')))"
            f" TO '{folder}/{name}.parquet' (FORMAT parquet)"
        )
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_skewed(shuffled_joins, skewed, name):
    df = entry.queries()[name](shuffled_joins, skewed)
    assert difference(df, connect(skewed), entry.oracle_sql()[name]) is None
