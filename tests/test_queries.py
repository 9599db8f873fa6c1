"""Every restated query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from strideframe.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    if name not in ORACLE:
        assert rows
        return
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    assert plain(rows) == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_import_without_the_corpus_part():
    """Nothing outside the subpackage imports it."""
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in (root / "strideframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_the_rest_stands_without_the_corpus_part(tmp_path):
    """A copy without both folders of the corpus operators, with and without the pipeline's file, imports and registers all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "strideframe", tmp_path / "strideframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for more in ((), ("corpus_pipeline.py",)):
        for name in more:
            shutil.copy(root / name, tmp_path)
        code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
        run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert run.returncode == 0, run.stderr
        assert run.stdout.split() == sorted(QUERIES)
