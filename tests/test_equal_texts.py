"""Many rows with few texts: what is found for a text is found once, and shuffles carry rows, not rows times candidates."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinfold.operators import occupations
from tests.test_entry import SF, rows

N = 3000
NAMES = "r_blocked_shape candidate_union classify dedup_mapping classify_callback_udf second_stage_pick link_single link_threshold merge_back pair_scores shortlist_topn r_output_shape best_match link_blocked_overfetch link_multi dedup_merged".split()


@pytest.fixture(scope="module")
def few_texts(tmp_path_factory):
    """The tables of SF, with a part table of N rows, two names and one brand and type, and customers of three names."""
    at = tmp_path_factory.mktemp("few")
    con = duckdb.connect()
    for t in ("region", "nation"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{at}/{t}.parquet'")
    con.execute(
        f"COPY (SELECT i AS p_partkey, CASE WHEN i % 5 < 2 THEN 'old plate' ELSE 'blue ring' END AS p_name, 'Brand#7' AS p_brand, 'SMALL' AS p_type, (1 + i % 50)::INT AS p_size, 900.0 AS p_retailprice"
        f" FROM range({N}) t(i)) TO '{at}/part.parquet'"
    )
    con.execute(f"COPY (SELECT i AS c_custkey, 'Customer#00' || i % 3 AS c_name, 1 AS c_nationkey, 1.0 AS c_acctbal, 'MACHINERY' AS c_mktsegment FROM range({N}) t(i)) TO '{at}/customer.parquet'")
    return str(at)


def most_shuffled(spark, run):
    """What ``run`` returns, and the most rows that a stage of it wrote to a shuffle."""
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, max(n for stage, n in stages().items() if stage not in before)


@pytest.mark.parametrize("name", NAMES)
def test_equal_texts_are_handled_once(spark, few_texts, name):
    con = duckdb.connect()
    for t in ("region", "nation", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{few_texts}/{t}.parquet'")
    got, most = most_shuffled(spark, lambda: [r.asDict() for r in entry.queries()[name](spark, few_texts).collect()])
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert rows(got, sorted(names)) == rows([dict(zip(names, r)) for r in found.fetchall()], sorted(names))
    assert most <= 3 * N


def test_texts_are_encoded_once_not_rows(spark):
    encoded = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        encoded.add(len(texts))
        return pd.Series([[float(len(t)), 1.0] for t in texts])

    records = spark.range(N).select(F.col("id").alias("idx"), F.when(F.col("id") % 5 < 2, "old plate").otherwise("blue ring").alias("text"))
    assert occupations.duplicate_pairs(records, encoder=encode).count() == 2 * 30 * 29 // 2
    assert 0 < encoded.value <= 40
