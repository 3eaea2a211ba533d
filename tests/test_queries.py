import pytest

from parchment.catalogue import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        same(df, ORACLES[name], sf_dir)
    else:
        df.collect()


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_summary_shuffles_nothing(spark, sf_dir):
    for name in ("summarize_documents", "sentence_scores", "wiki_markdown"):
        assert "Exchange" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString(), name


def test_summaries_of_rows_with_one_key(spark):
    from parchment.plans import summary

    t = ". ".join(f"word{i} word{i % 3} and some more of them" for i in range(9)) + "."
    rows = [(1, t), (1, t), (1, "One line."), (None, t), (None, None)]
    got = summary.summarize(spark.createDataFrame(rows, "k long, x string"), "k", "x", 3).collect()
    assert len(got) == 5 and len({r.summary for r in got}) == 3 and sum(r.summary.count("•") == 3 for r in got) == 3
