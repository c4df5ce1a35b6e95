"""Every registered query runs; those with SQL give DuckDB's rows."""

import decimal

import duckdb
import pytest

from folioforge.queries import ORACLES, QUERIES

#: What SQL can't express is compared with a Python version in test_engine.py.
IN_PYTHON = {"q_best_sentence", "q_extractive_answer", "q_gate_full", "q_phone_numbers"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return f"{float(v):.6f}" if isinstance(v, (float, decimal.Decimal)) else v


def rows(records, names):
    order = sorted(names)
    return sorted(str([plain(r[names.index(c)]) for c in order]) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        assert got and name in IN_PYTHON
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(result.fetchall(), names)
