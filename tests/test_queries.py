"""Every ledger query against its SQL, at the smallest scale."""

import duckdb
import pytest

from ledgerspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def expected(sql):
    con = duckdb.connect()
    for t in ("documents", "events", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = con.sql(sql).df()
    return frame


def rows(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else v
    return columns, sorted((tuple(clean(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(expected(ORACLES[name]))


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
