import pytest
from compare import same_rows

from driftloom import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf, duck):
    df = queries.QUERIES[name](spark, sf)
    if name in queries.ORACLE_SQL:
        same_rows(df, duck, queries.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r["jaccard"] > 0.5 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
