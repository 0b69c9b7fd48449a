"""Every survey query against its SQL, on the driver's tables; survey rules against the survey's own examples."""

import math
import subprocess
import sys
import textwrap

import duckdb
import pytest

from sigfield import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    made = {}

    def at(where):
        if where not in made:
            made[where] = duckdb.connect()
            for t in TABLES:
                made[where].execute(f"create view {t} as select * from '{where}/{t}.parquet'")
        return made[where]

    return at


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return str(v)

    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    found = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLE_SQL:
        want = duck(sf).execute(catalog.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, found) == rows(columns, want.fetchall())


def test_entry_without_the_subpackage(tmp_path):
    """The entry imports, and lists the survey queries, where the corpus operators are absent."""
    code = """
        import shutil, sys
        shutil.copytree(sys.argv[1], sys.argv[2], ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
        sys.path.insert(0, sys.argv[2])
        import __spark_entry__ as e
        assert e.__file__.startswith(sys.argv[2])
        assert "idw_grid" in e.queries() and "pipeline" not in e.queries()
        assert not any(q.startswith("op") for q in e.queries())
        assert set(e.oracle_sql()) <= set(e.queries())
    """
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code), root, str(tmp_path / "copy")], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
