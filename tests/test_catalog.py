"""Every query of the engine against its oracle SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from webquarry.plans import catalog


def rows(names, values):
    clean = lambda v: round(v, 9) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted((tuple(map(clean, r)) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    want = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert rows(columns, got) == rows(columns, want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_operators():
    root = Path(os.path.dirname(__spark_entry__.__file__))
    for path in (root / "webquarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert "webquarry.llm" not in path.read_text()
