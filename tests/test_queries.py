"""Every query with SQL against DuckDB on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equal_to_duckdb(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    c = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(c.fetchall(), names) == rows([tuple(r) for r in df.collect()], df.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_prompts_meet_more_than_the_first_files(spark):
    contexts = [r.context for r in __spark_entry__.queries()["prompt_context"](spark, "/root/testdata/sf0.01").collect()]
    assert len({f for c in contexts for f in re.findall(r"part_\d+", c)}) > 100


@pytest.mark.parametrize("name", ["line_diff", "function_around_cursor", "context_file_hits", "context_budget_pick"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.collect()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
