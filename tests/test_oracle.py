"""Every query against its SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plain(v):
    if v is None or v != v:
        return None
    return tuple(map(plain, v)) if isinstance(v, list) else repr(v) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr), [columns[k] for k in order]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_queries_against_sql(spark, duck):
    from auditlake.queries import ORACLE_SQL, QUERIES

    bad = []
    for name, q in QUERIES.items():
        got = q(spark, SF)
        ours = rows(got.columns, got.collect())
        if name in ORACLE_SQL:
            c = duck.execute(ORACLE_SQL[name])
            if ours != rows([d[0] for d in c.description], c.fetchall()):
                bad.append(name)
    assert not bad
