import duckdb
import pytest

import __spark_entry__ as entry_module
from planloom.operators import library as corpus
from planloom.plans import library

QUERIES = entry_module.queries()
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if k in corpus.oracles() or k in library.oracles()}


def canonical(df):
    names = sorted(df.columns)
    return names, sorted(tuple("" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[names].itertuples(index=False))


def test_flagship(spark):
    assert entry_module.entry(spark).columns == ["o_orderpriority", "count_all"]


def test_every_library_query_has_an_oracle():
    assert set(ORACLES) == {*library.queries(), *corpus.queries()} <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    try:
        ours = QUERIES[name](spark, sf_dir).toPandas()
    except ValueError as e:  # a sample of more rows than the smallest table has
        assert "sample_larger_than_source" in str(e)
        return
    assert canonical(ours) == canonical(con.execute(ORACLES[name]).fetchdf())
