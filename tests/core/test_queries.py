import math
from collections import Counter

import duckdb
import pytest

from netlens.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = ("nation", "customer", "supplier", "part", "orders", "events")


def rows(frame):
    cols = sorted(frame.columns)
    clean = lambda v: None if v is None or v is not v or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else v
    return cols, Counter(tuple(clean(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_sql(spark, sf_dir, oracle, name):
    got, want = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(oracle.execute(ORACLE_SQL[name]).df())
    assert got == want


def test_entry_and_registries(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1000


def test_entry_without_the_optional_parts(sf_dir, tmp_path):
    """The entry point imports without the llm folders and the pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/netlens", tmp_path / "netlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lookup_country' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.parametrize("name", ["decode_variant", "decode_path_array", "decode_types", "kinds_histogram"])
def test_parts_are_written_and_read_by_several_tasks(spark, name):
    """The part table is one row group and its networks crowd under one /8."""
    sf, sc = "/root/testdata/sf0.1", spark.sparkContext
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    df = QUERIES[name](spark, sf)
    sc.setJobGroup(f"read {name}", "")
    got = rows(df.toPandas())
    sc.setJobGroup("rest", "")
    stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup(f"read {name}") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 4 and got == rows(con.execute(ORACLE_SQL[name]).df())


def test_parts_are_encoded_by_several_tasks(spark):
    """One row group comes as one task, which would encode all records of kinds_histogram and its like."""
    from netlens.plans.catalogue import _parts

    sc = spark.sparkContext
    sc.setJobGroup("write parts", "")
    _parts(spark, "/root/testdata/sf0.1")
    sc.setJobGroup("rest", "")
    last = max(s for j in sc.statusTracker().getJobIdsForGroup("write parts") for s in sc.statusTracker().getJobInfo(j).stageIds)
    assert sc.statusTracker().getStageInfo(last).numTasks >= 2
