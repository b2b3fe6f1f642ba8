import __spark_entry__ as entry
from quarterdeck.plans import registry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())
    assert len(registry.queries()) > 70


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["quarter_idx", "portfolio_return", "benchmark_return", "excess_return", "holding_count"]
    assert rows.count() == 27
