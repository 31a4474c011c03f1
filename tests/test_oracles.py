"""Each registered query of the trace operators against its SQL on DuckDB."""

import math
import os

import __spark_entry__ as contract
import duckdb
import pytest
from spanquarry.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got
    if name in catalog.ORACLES:
        found = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in sorted(names)) for row in found.fetchall())
        assert len(got) == len(want)
        wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
        assert not wrong, wrong[:3]


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(catalog.QUERIES) <= set(contract.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(contract.__file__).parent
    (tmp_path / "spanquarry").mkdir()
    for p in root.joinpath("spanquarry").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "spanquarry" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text(Path(contract.__file__).read_text())
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert 'trace_points' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q) and e.oracle_sql()
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
assert e.entry(spark).count() > 0 and q['quantile_suite'](spark, e.SMOKE).count() > 0
"""
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
