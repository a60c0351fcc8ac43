"""Every registered query of the reference's operators against its SQL twin on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from gradus.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(SF):
        connection.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return connection


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value.isoformat() if hasattr(value, "isoformat") else value


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.collect(), df.columns) == table(want.fetchall(), want.columns)


def test_queries_without_sql(spark):
    made = catalog.QUERIES["synthetic_questions"](spark, SF).collect()
    assert len({r.question for r in made}) == 360
    assert all(eval(r.question.split(":")[1]) == r.answer for r in made if r.domain == "maths")
    exact = {r[0]: r[1] for r in spark.sql(f"select l_returnflag, count(distinct l_partkey) from parquet.`{SF}/lineitem.parquet` group by 1").collect()}
    for r in catalog.QUERIES["approximate_distinct"](spark, SF).collect():
        assert abs(r.parts - exact[r.l_returnflag]) <= 0.1 * exact[r.l_returnflag]
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"synthetic_questions", "approximate_distinct"}


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_that_could_fail_do_not_agree_by_being_empty(spark):
    """Of these every outcome occurs."""
    rows = lambda name: catalog.QUERIES[name](spark, SF).collect()
    assert rows("benchmark_leaks")
    assert {r.status for r in rows("math_grades")} == {"correct", "incorrect"}
    assert {r.status for r in rows("code_status")} == {"ready", "syntax_error"}
    assert 0 < sum(r.value is None for r in rows("integral_numbers")) < len(rows("integral_numbers"))
    assert {r.kind for r in rows("replay_mix")} == {"current", "repeat", "replay"} and sum(r.kind == "replay" for r in rows("replay_mix")) == 5
