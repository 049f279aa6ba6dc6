"""The driver's contract, and the library without its corpus subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from kinfold import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(records, columns):
    return sorted(repr(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns)) for r in records)


def test_flagship(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", list(own.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert rows(got, sorted(names)) == rows(want, sorted(names))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'link_single' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=100)


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession; import __spark_entry__ as e\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"assert e.queries()['dense_topk'](spark, {SF!r}).count() == 10_000\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=200, env=env)


def test_a_missing_library_is_an_error(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    if not os.path.exists(os.path.join(root, "corpus_pipeline.py")):
        pytest.skip("without the corpus subpackage")
    (tmp_path / "zstandard.py").write_text("raise ModuleNotFoundError('no zstandard here', name='zstandard')")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True, text=True, timeout=100)
    assert found.returncode and "zstandard" in found.stderr
