"""Every registered query with SQL gives the rows that DuckDB gives, with the same types."""

import duckdb
import pytest

from skyloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf_dir, db, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    said = db.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({catalog.ORACLES[name]})")
    kinds = {d[0]: str(d[1]) for d in said.description}
    assert ordered(df.select(cols).collect()) == ordered(said.fetchall())
    for c, kind in df.dtypes:
        assert kinds[c].startswith(("HUGEINT", "DECIMAL")) or KINDS[kind] == kinds[c], (c, kind, kinds[c])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"cv_predictions", "classify_cascade", "boosted_predictions", "models_by_cell"}))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 50)"], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert said.stdout.strip().endswith("True"), said.stderr
