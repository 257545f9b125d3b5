import duckdb
import pytest

from contextlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_to_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    c = con.execute(queries.ORACLES[name])
    names = [d[0] for d in c.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, c.fetchall())) == sorted(str(tuple(r)) for r in df.select(names).collect())
