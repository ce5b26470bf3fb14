"""Every registered query with SQL gives the rows of its SQL on the smallest tables; the entry module stands without the llm subpackage."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from legwork.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries(), all_oracles()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v).removesuffix(" 00:00:00")
    return f"{float(v):.6g}"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([canon(r[i]) for i in order] for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


def test_entry_without_the_llm_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "legwork", "spark-warehouse"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name) if name != "__spark_entry__.py" else (tmp_path / name).write_text(open(f"{ROOT}/{name}").read())
    os.mkdir(tmp_path / "legwork")
    for name in os.listdir(f"{ROOT}/legwork"):
        if name != "llm":
            os.symlink(f"{ROOT}/legwork/{name}", tmp_path / "legwork" / name)
    code = "import __spark_entry__ as e; n = e.queries(); assert not any(k.startswith('op') for k in n); print(len(n))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) >= len(ORACLE)
