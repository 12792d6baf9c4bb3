"""Every registered catalogue query against its SQL, and the driver's contract."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from quirespark.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{SF}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(columns, row):
    value = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return str([value(v) for _, v in sorted(zip(columns, row, strict=True))])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    assert name in queries.oracle_sql()
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.fetchall()
    assert sorted(plain(got.columns, r) for r in got.collect()) == sorted(plain(want.columns, r) for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "rank"] and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_text_preparation_folders(tmp_path):
    """A copy of the repository without them imports and has all other queries."""
    import shutil

    shutil.copytree(f"{ROOT}/quirespark", tmp_path / "quirespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(queries.queries())), str(len(queries.oracle_sql())), "False"]


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.queries()["exists_semi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), LessThan(c_acctbal,0.0)" in plan
    assert "ReadSchema: struct<o_custkey:bigint>" in plan


@pytest.mark.parametrize("name", ["sru_envelope", "marc_parse", "marc_parse_all_keys", "marc_json_rows"])
def test_answers_are_parsed_once_and_by_many_tasks(spark, name):
    """Of a table of one small file, too."""
    found = queries.queries()[name](spark, SF)
    assert found._jdf.queryExecution().executedPlan().toString().count("from_xml") == 1
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
