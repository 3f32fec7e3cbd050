"""Driver contract: entry() at sf0.001, every query has an oracle or is a documented rows-only job."""

import __spark_entry__ as entry_mod

ROWS_ONLY = {"cell_search"}


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    cols = df.columns
    assert df.count() > 0
    assert entry_mod.entry(spark).columns == cols


def test_oracle_coverage():
    qs, oracle = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(oracle) <= set(qs)
    training = set(getattr(entry_mod, "LLM_QUERIES", {}))
    assert set(qs) - set(oracle) - training <= ROWS_ONLY
