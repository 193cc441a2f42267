"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ostinato.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, tables, name):
    found = registry.QUERIES[name](spark, SF)
    told = tables.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(told.columns)
    assert canon(found.columns, [tuple(r) for r in found.collect()]) == canon(told.columns, told.fetchall())


@pytest.mark.parametrize("name", ["g2_random_tracks", "g4_recommendations", "match_stretched", "dup_check", "f5_spaced_peaks", "k1_band_features"])
def test_runs_alike_twice(spark, name):
    once, again = (registry.QUERIES[name](spark, SF) for _ in range(2))
    assert canon(once.columns, [tuple(r) for r in once.collect()]) == canon(again.columns, [tuple(r) for r in again.collect()])


def test_entry(spark):
    assert entry.entry(spark).columns == ["recording", "track", "start", "span", "track_start", "match_count", "ratio", "confidence"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_corpus_operators(tmp_path):
    """The rest imports and registers its queries if that part is taken out."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/ostinato", tmp_path / "ostinato", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.QUERIES))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.strip() == "True", said.stderr
