"""Every query with SQL, against DuckDB on the smallest tables; and that the entry points stand without the llm folders."""

import os
import subprocess
import sys

import duckdb
import pytest

from skein.plans import trees  # noqa: F401  adds the queries over files
from skein.plans.catalog import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, DIR)
    if name not in ORACLE_SQL:
        assert got.count()
        return
    con = duckdb.connect()
    for table in ("conversations", "documents", "events", "orders", "pages", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    expect = con.execute(ORACLE_SQL[name])
    names = sorted(c[0] for c in expect.description)
    assert sorted(got.columns) == names
    place = [[c[0] for c in expect.description].index(n) for n in names]
    assert sorted(tuple(map(str, r)) for r in got.select(names).collect()) == sorted(tuple(str(r[k]) for k in place) for r in expect.fetchall())


def test_entry_without_llm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py",):
        (tmp_path / name).symlink_to(f"{root}/{name}")
    (tmp_path / "skein").mkdir()
    for name in os.listdir(f"{root}/skein"):
        if name != "llm":
            (tmp_path / "skein" / name).symlink_to(f"{root}/skein/{name}")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split()[1:] == ["False", "True"], done.stderr


def test_entry_where_the_llm_folder_cannot_be_imported(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q) > 30, any(k.startswith('op') for k in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.stdout.split() == ["True", "False"], done.stderr
