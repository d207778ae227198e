"""Every query with SQL agrees with DuckDB on the smallest tables; all names are registered."""

import importlib
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = importlib.import_module("codexmill.queries").QUERIES | importlib.import_module("codexmill.flows").FLOWS
ORACLES = importlib.import_module("codexmill.oracles").ORACLES | importlib.import_module("codexmill.flow_oracles").FLOW_ORACLES


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


GOLDEN = importlib.import_module("codexmill.queries").GOLDEN
GOLDEN_ORACLES = importlib.import_module("codexmill.oracles").GOLDEN_ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES | GOLDEN_ORACLES))
def test_oracle(spark, db, name):
    got = (QUERIES | GOLDEN)[name](spark, SF)
    cur = db.execute((ORACLES | GOLDEN_ORACLES)[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str) == want


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
