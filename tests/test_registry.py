"""Every query with SQL against DuckDB on the smallest tables; the library without its llm part."""

import decimal
import subprocess
import sys
import textwrap

import duckdb
import pytest

import __spark_entry__ as entry
from meridian.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck(small):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
        yield con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, small, duck, name):
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    expected = sorted(repr(tuple(map(plain, r))) for r in found.fetchall())
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm(tmp_path):
    code = """
    import sys
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("meridian.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(name, name=name)
    sys.meta_path.insert(0, Gone())
    import __spark_entry__ as e
    names = set(e.queries())
    assert "iset_merge" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names), names
    e.oracle_sql()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=entry.__file__.rpartition("/")[0])


def test_a_broken_dependency_is_not_hidden():
    """What the training-data operators need may not be missing in silence, where they are there themselves."""
    code = """
    import importlib.util, sys
    if importlib.util.find_spec("meridian.llm") is None or importlib.util.find_spec("meridian.llm.queries") is None:
        sys.exit()
    sys.modules["public_tokenizers"] = None
    try:
        import __spark_entry__
    except ImportError as e:
        assert e.name == "public_tokenizers", e
    else:
        raise AssertionError("nothing was raised")
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=entry.__file__.rpartition("/")[0])
