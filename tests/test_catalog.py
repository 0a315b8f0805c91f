"""Every query against its SQL, on whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages", "conversations", "labels")
QUERIES, SQL = entry.catalog.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(round(r[i], 9) if isinstance(r[i], float) and not math.isnan(r[i]) else r[i] for i in order)
             for r in rows]
    return sorted(names), sorted(plain, key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = duck.execute(SQL[name])
    assert got == _rows([d[0] for d in result.description], result.fetchall())


def test_whole_batches_answer_every_document(spark):
    asked = spark.read.parquet(f"{DATA}/documents.parquet").count()
    answers = QUERIES["batch_fetch_whole"](spark, DATA).collect()
    assert len(answers) == asked and all(r.url for r in answers)
    assert 0 < sum(r.success for r in answers) < asked


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) and set(QUERIES) <= set(entry.queries())


def test_entry(spark, monkeypatch):
    frame = entry.entry(spark)
    assert frame.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
