from conftest import rows

from tablescope.operators import discover as D
from tablescope.operators import score as C

DEFAULTS = dict(
    server="s", object_id=1, table="t", row_count=5_000_000, base_data_mb=5000.0, nonclustered_mb=0.0,
    has_columnstore=False, user_seeks=0, user_scans=0, user_lookups=0, user_updates=0, missing_index_suggestions=0,
    row_lock_wait_ms=0, page_lock_wait_ms=0, page_io_latch_wait_ms=0, leaf_inserts=0, leaf_updates=0, leaf_deletes=0,
    pct_low=0.0, pct_medium=0.0, dictionary_pressure_columns=0, lob_columns=0, sampled_rows=0, is_replicated=False,
    is_cdc_tracked=False, computed_columns=0, clustering_column="", has_aggregation=False,
)
BIG = dict(row_count=50_000_000, nonclustered_mb=8000.0, user_seeks=10, user_scans=900, user_updates=5, pct_low=80.0, pct_medium=95.0)


def scored(spark, **values):
    row = {**DEFAULTS, **values}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    return C.score_tables(D.size_ratios(D.write_ratios(D.usage_ratios(df))))


def score(spark, **values):
    return scored(spark, **values).first()


def verdict(spark, **values):
    return scored(spark, **values).select(C.verdict_tier().alias("v")).first().v


def test_already_columnar(spark):
    r = score(spark, has_columnstore=True, **BIG)
    assert r.candidacy_score == 0 and r.notes == "Already has a columnstore index"


def test_tiny_table(spark):
    r = score(spark, row_count=1000, base_data_mb=1.0)
    assert "too small to benefit" in r.notes and "only ~0 potential rowgroups (1,000 rows)" in r.notes


def test_strong_candidate(spark):
    r = score(spark, **BIG)
    assert r.candidacy_score >= 55 and "scan-heavy" in r.notes and "80% of columns" in r.notes


def test_exact_sum(spark):
    # shape 20+14.25, size 12 (47.7 rowgroups), scans 0.2*98.901, bloat 1.6 -> 11
    assert score(spark, **BIG).candidacy_score == round(20 + 14.25 + 12 + 0.2 * 100 * 900 / 910 + 11, 1)


def test_write_heavy_scores_lower(spark):
    r = score(spark, **{**BIG, "user_scans": 10, "user_updates": 500})
    assert r.candidacy_score < score(spark, **BIG).candidacy_score and "write-heavy" in r.notes


def test_pressure_and_lob_lower_the_score(spark):
    base = score(spark, **BIG).candidacy_score
    assert score(spark, **BIG, dictionary_pressure_columns=2).candidacy_score == base - 10
    assert score(spark, **BIG, dictionary_pressure_columns=9).candidacy_score == base - 15
    assert score(spark, **BIG, lob_columns=1).candidacy_score == base - 5


def test_clamped(spark):
    r = score(spark, row_count=1, base_data_mb=0.1, user_updates=1_000_000, dictionary_pressure_columns=50, lob_columns=10)
    assert r.candidacy_score == 0
    top = score(
        spark, row_count=10**9, base_data_mb=1.0, nonclustered_mb=9.0, user_scans=10, pct_low=100.0, pct_medium=100.0,
        row_lock_wait_ms=4_000_000, missing_index_suggestions=9,
    )
    assert top.candidacy_score == 100


def test_bloat_raises_the_score(spark):
    low, high = score(spark, **{**BIG, "nonclustered_mb": 0.0}), score(spark, **{**BIG, "nonclustered_mb": 12000.0})
    assert high.candidacy_score == low.candidacy_score + 15
    assert "NC indexes (12,000 MB) outweigh base data (5,000 MB)" in high.notes


def test_half_even_rounding(spark):
    # 0.25 * 1.0 = 0.25 -> 0.2; 0.25 * 1.4 = 0.35 -> 0.4 (row count too small for size points)
    assert score(spark, row_count=1, pct_low=1.0).candidacy_score == 0.2
    assert score(spark, row_count=1, pct_low=1.4).candidacy_score == 0.4


def test_zero_denominators(spark):
    r = score(spark, base_data_mb=0.0, nonclustered_mb=10.0)
    assert (r.scan_pct, r.write_pct, r.update_share_pct, r.index_bloat_ratio) == (0, 0, 0, 0)


def test_verdict_tiers(spark):
    quiet = {**BIG, "pct_low": 20.0, "pct_medium": 20.0}
    assert verdict(spark, **BIG).startswith("STRONG")
    assert verdict(spark, **quiet).startswith("PROMISING")
    assert verdict(spark, **quiet, has_aggregation=True).startswith("GENUINE")
    append = dict(leaf_inserts=5, pct_low=20.0, pct_medium=60.0)
    assert verdict(spark, **append).startswith("MARGINAL — compression")
    assert verdict(spark, pct_low=80.0, pct_medium=0.0) == "MARGINAL"
    assert verdict(spark, row_count=10).endswith("(too small / wrong shape)")
    assert verdict(spark).startswith("NOT A COLUMNSTORE")
    assert verdict(spark, has_columnstore=True) == "already columnstore"


def test_recommendation(spark):
    rec = lambda **v: C.recommendation(scored(spark, **v)).select("recommendation", "migration_steps").first()
    full = rec(**{**BIG, "computed_columns": 1, "clustering_column": "d", "leaf_inserts": 3})
    assert full.recommendation == "convert"
    assert full.migration_steps == ["drop computed columns first", "order the data by d", "reorganize periodically"]
    assert rec(leaf_inserts=5, pct_low=80.0).recommendation == "later"
    assert rec().recommendation == "leave" and rec().migration_steps == []
    assert rec(has_columnstore=True, **BIG).recommendation is None


def test_punch_list(spark):
    findings = spark.createDataFrame(
        [("s", 1, "a", "dead", 30.0), ("s", 1, "b", "dead", 20.0), ("s", 1, "c", "lob_include", 90.0),
         ("s", 2, "d", "dead", 70.0), ("s", 1, "e", "wide", 0.0)],
        "server STRING, object_id INT, index_name STRING, kind STRING, reclaim_mb DOUBLE",
    )
    candidates = spark.createDataFrame(
        [("s", 1, False, 40.0, 100.0, 30.0), ("s", 2, True, 0.0, 100.0, 0.0), ("s", 3, False, 35.0, 10.0, 30.0)],
        "server STRING, object_id INT, has_columnstore BOOLEAN, candidacy_score DOUBLE, base_data_mb DOUBLE, compressed_mb DOUBLE",
    )
    items = C.punch_list(findings, candidates)
    assert [(r.object_id, r.priority, r.reclaim_mb) for r in items.collect()] == [(1, 1, 90.0), (1, 1, 50.0), (1, 2, 70.0), (3, 2, 0.0)]
    total = C.punch_total(items).first()
    assert (total.actions, total.total_mb, total.reported) == (4, 210.0, True)


def test_portfolio_and_ranking(spark):
    df = spark.createDataFrame(
        [("a", 55.0, False), ("b", 35.0, False), ("c", 54.9, False), ("d", 0.0, True), ("e", 34.9, False)],
        "table STRING, candidacy_score DOUBLE, has_columnstore BOOLEAN",
    )
    assert rows(C.portfolio_counts(df)) == [(1, 2, 1)]
    assert [r.table for r in C.ranked_candidates(df).collect()] == ["a", "c", "b", "e", "d"]
