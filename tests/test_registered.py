"""Every registered query beside its SQL on the smallest tables, and what its plans avoid."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from checks.compare import TABLES, rows_of
from checks.oracles import oracle_sql
from checks.queries import queries
from lakeimpact.session import Scratch

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET memory_limit='4GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, monkeypatch, name):
    plans, write = [], Scratch.write

    def recorded(self, df, table):
        plans.append(plan_of(df))
        return write(self, df, table)

    monkeypatch.setattr(Scratch, "write", recorded)
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(oracle_sql()[name])
    assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0], "a check of nothing"
    for plan in [*plans, plan_of(df)]:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    # The optional queries may be there or not, and not all of them can be put in SQL.
    assert set(queries()) <= set(module.queries()) and set(queries()) <= set(module.oracle_sql())
    assert set(module.oracle_sql()) <= set(module.queries())


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("word", ["localCheckpoint", "crossJoin", ".collect(", ".toPandas(", "broadcast("])
def test_library_keeps_data_on_the_executors(word):
    for path in (ROOT / "lakeimpact").rglob("*.py"):
        assert word not in path.read_text(), path


@pytest.mark.parametrize("missing, expected", [("zstandard", "left"), ("lakeimpact.functions.semi", "fails"), ("corpus_pipeline", "left")])
def test_entry_without_a_module(missing, expected):
    """A library that only the optional part needs does not take the other queries along; a missing module of ours does."""
    code = (
        "import sys\n"
        f"class Missing:\n    def find_spec(self, name, path=None, target=None):\n        if name == {missing!r}:\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Missing())\nimport __spark_entry__ as e\nprint(len(e.queries()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    if expected == "fails":
        assert done.returncode and "ImportError" in done.stderr
    else:
        assert done.returncode == 0, done.stderr
        assert int(done.stdout) == len(queries())
