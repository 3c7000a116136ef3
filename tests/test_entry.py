"""Queries against their SQL in DuckDB, over the smallest tables."""

import importlib.util
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: One of each kind; bench.py and the driver run all.
NAMES = ["normalize_name", "keys_all", "key_cap_filter", "rare_overflow", "rare_top25", "merged_output", "validate_contract", "resume_check"]


def duck():
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    return c


def rows(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in frame.values.tolist())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    assert rows(entry.queries()[name](spark, FOLDER).toPandas()) == rows(duck().sql(entry.oracle_sql()[name]).df())


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent / "kinfold"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
    assert importlib.util.find_spec("kinfold.plans") is not None
