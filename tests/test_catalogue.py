"""Every query of the catalogue against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from iterix.catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def lines(rows, at):
    return sorted(tuple(cell(r[k]) for k in at) for r in rows)


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) > 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = lines(found.fetchall(), [columns.index(c) for c in sorted(columns)])
    got = lines(df.collect(), [df.columns.index(c) for c in sorted(columns)])
    assert want and got == want


def test_entry_works_without_the_text_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("iterix.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "iterix.llm", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def test_nothing_else_imports_the_text_operators():
    top = Path(__file__).resolve().parents[1] / "iterix"
    for path in top.rglob("*.py"):
        if "llm" not in path.parts:
            assert "iterix.llm" not in path.read_text()
