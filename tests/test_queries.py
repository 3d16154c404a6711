"""Registered queries against DuckDB on the smallest tables."""

import pytest

from quillscan.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

def rows(frame, columns):
    text = lambda v: "None" if v is None or v != v else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_whole_file_queries_cover_all_shipped_rules():
    from quillscan.plans import registry

    assert sorted(r.id for r in registry._WHOLE + registry._WHOLE_ENDS) == sorted(r.id for r in registry.SHIPPED)
    assert len(registry._WHOLE_ENDS) == 11 and "match_wholefile_ends" in QUERIES


def test_every_rule_fires_in_the_overlay():
    import duckdb

    from quillscan.plans import registry

    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = {r[0] for r in base.execute(f"SELECT DISTINCT rule_id FROM ({ORACLES['match_all_packs']})").fetchall()}
    assert got == {r.id for r in registry.ALL}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    import duckdb

    base = duckdb.connect()
    for t in ("documents", "events"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), base.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
