import __spark_entry__ as e
from umbra import queries as q


def test_names_and_sql():
    assert set(q.SQL) <= set(q.QUERIES) and set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    r = e.entry(spark)
    assert r.columns == ["doc_id", "masked_text", "n_tokens", "restored"] and r.where("not restored").count() == 0 and r.where("n_tokens > 0").count() > 100
