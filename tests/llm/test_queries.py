"""Queries of the training-data operators against their SQL."""

import os

import pytest

from lumenry.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    found = catalog.queries()[name](spark, FOLDER)
    wanted = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, wanted.fetchall()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_name_rows_of_their_tables(spark, name):
    found = catalog.queries()[name](spark, FOLDER)
    rows = found.collect()
    assert rows and len(rows) == len(set(rows))
    for key, table in (("row_id", "flickr8k_emotional_captions"), ("doc_id", "documents")):
        if key in found.columns:
            known = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
            assert {r[key] for r in rows} <= known
