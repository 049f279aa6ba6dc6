"""Operators of the linkage engine against hand-made fixtures and plain Python."""

import math
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.text import as_text, char_ngrams, concat_key, normalized, title_text
from kinfold.operators import blocks, dense, link, occupations, ranking, sparse
from kinfold.operators.components import components, labels_of
from kinfold.plans.shared import collected, shared_dir
from kinfold.sources import from_values, positional, read_csv
from kinfold.streaming import link_stream


def table(spark, values, name="name"):
    return from_values(spark, values, name)


def test_text_keys(spark):
    rows = spark.createDataFrame([(None, 1.5, True, "  "), ("a", None, None, " d ")], "s string, x double, b boolean, d string")
    got = rows.select(as_text("s").alias("s"), concat_key(["s", "x", "b"]).alias("k"), title_text(F.col("s"), F.col("d")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("None", "None | 1.5 | true", ""), ("a", "a | None | None", "a :: d")]


@pytest.mark.parametrize("text", ["", "a", "ab", "abcde", "Ä  x", "😀ab"])
def test_char_ngrams(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(char_ngrams(normalized(F.col("t"))).alias("g")).first().g
    t = text.lower().replace("  ", " ")
    assert Counter(got) == Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))


def brute_tfidf(queries, corpus):
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))
    c = [grams(t.lower()) for t in corpus]
    df = Counter(g for x in c for g in x)
    idf = {g: math.log((1 + len(c)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(x):
        w = {g: n * idf[g] for g, n in x.items() if g in idf}
        size = math.sqrt(sum(v * v for v in w.values())) or 1
        return {g: v / size for g, v in w.items()}

    cw = [unit(x) for x in c]
    return [[round(sum(v * y.get(g, 0) for g, v in unit(grams(q.lower())).items()), 6) for y in cw] for q in queries]


def test_sparse_topk_with_ties_and_padding(spark):
    corpus = ["San Francisco", "Los Angeles", "San Francisco", "New York", "x", "Chicago", "Houston"]
    queries = ["San Fransisco", "zzqqzz", "new  york", "San Francisco", ""]
    index = sparse.fit(table(spark, corpus, "corpus_text").withColumnRenamed("idx", "corpus_idx"))
    for k in (2, 4, 20):
        got = {}
        for r in sparse.topk(table(spark, queries, "query_text").withColumnRenamed("idx", "query_idx"), index, k).collect():
            got.setdefault(r.query_idx, []).append((-r.score, r.corpus_idx))
        want = brute_tfidf([q.replace("  ", " ") for q in queries], corpus)
        for i, row in enumerate(want):
            assert sorted(got[i]) == sorted((-s, j) for j, s in enumerate(row))[:k], (k, i)


def test_dense_topk_over_several_blocks(spark):
    rng = np.random.default_rng(0)
    q, c = rng.integers(-3, 4, (30, 5)), rng.integers(-3, 4, (70, 5))
    q_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q.astype(float))], "query_idx long, embedding array<double>")
    c_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c.astype(float))], "corpus_idx long, embedding array<double>")
    got = {(r.query_idx, r.corpus_idx) for r in dense.topk(q_df, c_df, 7).collect()}
    want = {(i, j) for i in range(30) for j in sorted(range(70), key=lambda j: (-(q[i] @ c[j]), j))[:7]}
    assert got == want


def test_link_fixtures(spark):
    cases = [
        (["San Fransisco", "Los Angelas", "New York City", "Seattle"], ["San Francisco", "Los Angeles", "New York", "Philadelphia", "Seattle", "Chicago", "Houston"], [0, 1, 2, 4]),
        (["John Smith", "Jane Doe", "Robert Johnson"], ["J. Smith", "Jane M. Doe", "Bob Wilson", "R. Johnson"], [0, 1, 3]),
        (["only"], ["one row"], [0]),
        (["b", "a"], ["a", "a", "b"], [2, 0]),
    ]
    for queries, corpus, want in cases:
        found = link.link(table(spark, queries), table(spark, corpus), column_query="name").orderBy("query_idx").collect()
        assert [r.match_idx for r in found] == want
    none = link.link(table(spark, ["a"]), table(spark, ["b"]).where("false"), column_query="name").collect()
    assert [(r.query_idx, r.match_idx, r.score) for r in none] == [(0, None, None)]
    empty = link.link(table(spark, ["a"]).where("false"), table(spark, ["b"]), column_query="name")
    assert empty.count() == 0 and empty.columns == ["query_idx", "query_text", "match_idx", "match_text", "score"]
    with pytest.raises(ValueError):
        link.link(table(spark, ["a"]), table(spark, ["b"]))
    with pytest.raises(ValueError):
        link.link(table(spark, ["a"]), table(spark, ["b"]), column_query="name", columns_query=["name"])


@pytest.mark.parametrize("mode", ["postfilter", "per_block"])
def test_link_blocked_fixture(spark, mode):
    q = spark.createDataFrame([(0, "Kalifornia", "Los Angelos"), (1, "Texass", "Harris Co"), (2, "New Yrok", "Queens County")], "idx long, state string, county string")
    c = spark.createDataFrame([(0, "California", "Los Angeles"), (1, "California", "San Francisco"), (2, "Texas", "Harris"), (3, "Texas", "Dallas"), (4, "New York", "Queens")], "idx long, state string, county string")
    got = link.link_blocked(q, c, "state", "county", mode=mode)
    rows = got.orderBy("query_idx").collect()
    assert [(r.match_idx, r.match_block) for r in rows] == [(0, "California"), (2, "Texas"), (4, "New York")]
    assert [r.match_index for r in link.one_based(got).orderBy("match_index").collect()] == [1, 3, 5]


def test_blocked_fallback_and_first_row(spark):
    q = spark.createDataFrame([(0, "aa", "zzzz")], "idx long, b string, d string")
    c = spark.createDataFrame([(0, "bb", "zzzz"), (1, "aa", "qqqq"), (2, "aa", "qqqq")], "idx long, b string, d string")
    assert link.link_blocked(q, c, "b", "d", retrieval_top_k=1, overfetch=1).first().match_idx == 1
    assert link.link_blocked(q, c, "b", "d", mode="per_block").first().match_idx == 1


def test_unified_corpus_and_classifier(spark):
    h = spark.createDataFrame([("farmer", None, "6"), ("smith", " works iron ", "8")], "title string, description string, hisco_code string")
    i = spark.createDataFrame([("coder",)], "title string")
    rows = occupations.build_unified_corpus(h, i).collect()
    assert [tuple(r) for r in rows] == [("farmer", "", "historical", "6", "6", None, "farmer"), ("smith", " works iron ", "historical", "8", "8", None, "smith :: works iron"), ("coder", "", "modern", None, None, None, "coder")]
    q, c = table(spark, ["farmr"], "text"), table(spark, ["farmer", "farmers", "smith"], "text")
    assert occupations.classify(q, c).first().match_idx == 0
    for pick, want in ((lambda a, b: 1, 1), (lambda a, b: -1, 0), (lambda a, b: 99, 0)):
        assert occupations.classify(q, c, second_stage=pick).first().match_idx == want


def test_dedup(spark):
    rows = spark.createDataFrame(
        [(0, "farmer", "farmer", "historical", "1"), (1, "farmer", "farmer", "modern", "2"), (2, "smith", "smith", "modern", "nan"), (3, "farmer", "Farmer", "modern", "1")],
        "idx long, text string, title string, era string, canonical_code string",
    )
    merged, mapping = occupations.deduplicate_corpus(rows)
    assert sorted(map(tuple, mapping.collect())) == [(0, 1, 0), (1, 1, 0), (2, 2, 2), (3, 1, 0)]
    got = {r.idx: (r.n_records, r.canonical_code, r.aliases) for r in merged.collect()}
    assert got == {1: (3, "1 | 2", "Farmer | farmer"), 2: (1, None, "smith")}


def test_components_in_one_task_and_in_rounds(spark):
    rng = np.random.default_rng(5)
    graphs = [[(0, 7), (2, 4), (3, 5), (4, 5), (5, 6), (6, 7)], [(i, i + 1) for i in range(20)], rng.integers(0, 60, (40, 2)).tolist(), [], [(3, 3)]]
    for edges in graphs:
        df = spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")
        nodes, labels = labels_of(np.array([e[0] for e in edges], dtype=np.int64), np.array([e[1] for e in edges], dtype=np.int64))
        want = dict(zip(nodes.tolist(), labels.tolist()))
        assert {r.node: r.component for r in components(df).collect()} == want
        assert {r.node: r.component for r in components(df, one_task=-1).collect()} == want


def test_positional_and_merge_back(spark):
    rows = positional(spark.createDataFrame([("b",), ("a",), ("c",)], "name string"), ["name"])
    assert sorted(map(tuple, rows.collect())) == [(0, "a"), (1, "b"), (2, "c")]
    out = link.merge_back(rows, link.link(rows, rows, column_query="name"), rows)
    assert {(r.idx, r.match_idx, r.name_corpus) for r in out.collect()} == {(0, 0, "a"), (1, 1, "b"), (2, 2, "c")}


def test_scores(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("", ""), ("a", "")], "a string, b string")
    got = [r.s for r in rows.select(ranking.levenshtein_ratio(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([2 / 3, 1, 0])
    assert [r.s for r in rows.select(ranking.ngram_dice(2)(F.col("a"), F.col("b")).alias("s")).collect()] == pytest.approx([0.5, 1, 0])


def test_stream_of_queries(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(0, "San Fransisco"), (1, "Huston")], "idx long, name string").write.parquet(str(source))
    stream = spark.readStream.schema("idx long, name string").parquet(str(source))
    run = link_stream(stream, table(spark, ["San Francisco", "Houston"]), str(tmp_path / "out"), str(tmp_path / "state"), column_query="name").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.query_idx, r.match_idx) for r in got.collect()} == {(0, 0), (1, 1)}


def test_models_say_what_they_need(spark):
    from kinfold.operators.models import transformer_encoder, transformer_scorer

    rows = spark.createDataFrame([("a", "b")], "a string, b string")
    for column in (transformer_encoder("m")(F.col("a")), transformer_scorer("m")(F.col("a"), F.col("b"))):
        with pytest.raises(Exception, match="sentence-transformers on every worker"):
            rows.select(column).collect()


def test_packed_similarities_equal_the_join(spark):
    rng = np.random.default_rng(7)
    words = ["brand", "steel", "copper", "Ä x", "small", "brand#1", "12"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 5))) for _ in range(120)] + ["", "q"]
    corpus = table(spark, texts, "corpus_text").withColumnRenamed("idx", "corpus_idx")
    queries = table(spark, [t[1:] + "zz" for t in texts], "query_text").withColumnRenamed("idx", "query_idx")
    index = sparse.fit(corpus)
    joined = sparse.similarities(queries, index).join(index.texts.select("text", "first"), "text")
    q_first = queries.groupBy(normalized(F.col("query_text")).alias("q_text")).agg(F.min("query_idx").alias("query_idx"))
    want = {(r.query_idx, r.first): r.score for r in joined.join(q_first, "q_text").collect()}
    found = blocks.topk(sparse._vectors(q_first.withColumnRenamed("q_text", "text"), index.idf, (), (2, 4), "query_idx"), index.blocks, 10**6, sparse._queries, sparse._products)
    got = {(r.query_idx, r.corpus_idx): r.score for r in found.collect()}
    assert got == {(q, c): pytest.approx(want.get((q, c), 0.0), abs=2e-6) for q, c in got} and set(want) <= set(got)


def test_one_text_with_half_of_the_rows(spark):
    corpus = spark.range(400).select(F.col("id").alias("corpus_idx"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.concat(F.lit("row "), "id")).alias("corpus_text"))
    queries = spark.createDataFrame([(0, "the same text"), (1, "row 17")], "query_idx long, query_text string")
    got = {}
    for r in sparse.topk(queries, sparse.fit(corpus), 5).collect():
        got.setdefault(r.query_idx, []).append(r.corpus_idx)
    assert sorted(got[0]) == [0, 2, 4, 6, 8] and 17 in got[1] and len(got[1]) == 5


def test_select_takes_the_lowest_of_ties():
    rng = np.random.default_rng(1)
    for k in (1, 3, 7):
        scores, ids = rng.integers(0, 3, (20, 60)).astype(float), rng.permutation(60)
        s, i = blocks.select(scores, ids, k)
        for row in range(20):
            assert list(zip(-s[row], i[row])) == sorted(zip(-scores[row], ids))[:k]


def test_vectors_of_different_lengths_never_meet(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0, 5.0, 6.0]), (2, [1.0, 1.0]), (3, None)], "idx long, v array<double>")
    got = dense.topk(rows.toDF("query_idx", "embedding"), rows.toDF("corpus_idx", "embedding"), 3, skip_self=True).collect()
    assert {(r.query_idx, r.corpus_idx, r.score) for r in got} == {(0, 2, 3.0), (2, 0, 3.0)}
    assert {(r.query_idx, r.corpus_idx) for r in dense.pairs_above(rows, 0.0, "v").collect()} == {(0, 2)}


def test_pairs_above_over_several_ranges(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (90, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v.astype(float))], "idx long, embedding array<double>")
    got = {(r.query_idx, r.corpus_idx) for r in dense.pairs_above(rows, 5).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if v[i] @ v[j] >= 5}


def folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_one_index_for_many_calls(spark):
    index = link.index_of(table(spark, ["San Francisco", "Houston", "Boston"]), "name")
    fits = folders(spark)
    for queries, want in ((["Huston"], [1]), (["Bostn", "San Fran"], [2, 0])):
        with collected(delete=True):
            assert [r.match_idx for r in sorted(link.link(table(spark, queries), index, column_query="name").collect())] == want
        assert folders(spark) == fits
    assert occupations.classify(table(spark, ["Houstn"], "text"), index).first().match_idx == 1
    index.close()
    assert not folders(spark) & {u.rsplit("/", 1)[-1] for u in index.uris}


def test_a_stream_fits_once_and_leaves_nothing(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(5):
        spark.createDataFrame([(i, "San Fransisco")], "idx long, name string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("idx long, name string").option("maxFilesPerTrigger", 1).parquet(str(source))
    index = link.index_of(table(spark, ["San Francisco", "Houston"]), "name")
    before = folders(spark)
    run = link_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "state"), column_query="name").trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).where("match_idx = 0").count() == 5 and folders(spark) == before
    assert len([n for n in os.listdir(tmp_path / "out") if n.startswith("batch=")]) == 5


def test_matchers_of_lists(spark):
    from kinfold.operators.matcher import EnsembleMatcher, ensemble_link, ensemble_link_blocked

    got = ensemble_link(["San Fransisco", "Huston"], ["San Francisco", "Houston"], return_scores=True)
    assert got.columns == ["query", "match", "score"] and {r.query: r.match for r in got.collect()} == {"San Fransisco": "San Francisco", "Huston": "Houston"}
    assert ensemble_link(["a"], ["b"]).columns == ["query", "match"]
    q = spark.createDataFrame([(0, "Texass", "Haris")], "idx long, s string, c string")
    c = spark.createDataFrame([(0, "Texas", "Dallas"), (1, "Texas", "Harris")], "idx long, s string, c string")
    row = ensemble_link_blocked(q, c, "s", "c").first()
    assert (row.match_index, row.match_detail) == (2, "Harris")
    for bad in ([], "text", [1]):
        with pytest.raises(ValueError):
            ensemble_link(bad, ["b"])
    with pytest.raises(ValueError):
        ensemble_link(["a"], ["b"], top_k=0)
    matcher = EnsembleMatcher()
    with pytest.raises(ValueError):
        matcher.match(["a"])
    assert matcher.index(["Houston", "Boston"]).match_one("Bostn") == (1, "Boston", pytest.approx(0.833333))
    matcher.close()


def test_ready_embeddings_and_scores(spark):
    q = spark.createDataFrame([(0, "alpha", [1.0, 0.0])], "idx long, name string, v array<double>")
    c = spark.createDataFrame([(0, "omega", [0.0, 1.0]), (1, "sigma", [1.0, 0.0])], "idx long, name string, v array<double>")
    scores = spark.createDataFrame([("alpha", "omega", 0.2), ("alpha", "sigma", 0.9)], "query_text string, corpus_text string, score double")
    row = link.link(q, c, column_query="name", vector="v", scorer=scores, retrieval_top_k=1).first()
    assert (row.match_idx, row.score) == (1, 0.9)


def test_models_with_a_stand_in_library(spark, tmp_path):
    """The adapters' calls, answered by a small module of that name on the workers."""
    (tmp_path / "sentence_transformers.py").write_text(
        "import numpy as np\n"
        "class SentenceTransformer:\n"
        "    def __init__(self, name, cache_folder=None, device=None): self.name = name\n"
        "    def encode(self, texts, batch_size, normalize_embeddings): return np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)\n"
        "class CrossEncoder:\n"
        "    def __init__(self, name, cache_folder=None, device=None): self.max_length = None\n"
        "    def predict(self, pairs, batch_size): return np.array([1.0 / (1 + abs(len(a) - len(b))) for a, b in pairs])\n"
    )
    code = (
        "import sys; from pyspark.sql import SparkSession; from pyspark.sql import functions as F\n"
        "from kinfold.operators import link; from kinfold.operators.models import transformer_encoder, transformer_scorer; from kinfold.sources import from_values\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "q, c = from_values(spark, ['aaaa', 'bb'], 'name'), from_values(spark, ['cc', 'dddd', 'eeeeee'], 'name')\n"
        "rows = link.link(q, c, column_query='name', encoder=transformer_encoder('m'), scorer=transformer_scorer('r')).collect()\n"
        "assert sorted((r.query_idx, r.match_idx, r.score) for r in rows) == [(0, 1, 1.0), (1, 0, 1.0)], rows\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, timeout=280, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"})


def test_csv_and_reserved_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("idx,text,cluster_id,n_records\n0,farmer,9,x\n1,farmer,8,y\n")
    rows = read_csv(spark, str(tmp_path / "a.csv")).withColumn("idx", F.col("idx").cast("long"))
    assert rows.columns == ["idx", "text", "cluster_id", "n_records"] and rows.dtypes[2][1] == "string"
    merged, mapping = occupations.deduplicate_corpus(rows)
    row = merged.first()
    assert (row.idx, row.cluster_id, row.n_records, row.cluster_id_original, row.n_records_original) == (0, 0, 2, "9", "x") and mapping.count() == 2
    scored = rows.select("idx", "text", F.lit(0.5).alias("score"))
    out = link.merge_back(scored, link.link(scored, rows, column_query="text"), rows).collect()
    assert {(r.idx, r.score_query, r.score, r.text_corpus) for r in out} == {(0, 0.5, 1.0, "farmer"), (1, 0.5, 1.0, "farmer")}


def test_row_numbers_replace_a_column_of_the_name(spark):
    got = positional(spark.createDataFrame([("b", 7), ("a", 8)], "name string, idx int"), [F.desc("name")]).collect()
    assert sorted((r.idx, r.name) for r in got) == [(0, "b"), (1, "a")]
    assert positional(spark.createDataFrame([], "name string"), ["name"]).count() == 0


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            applicationId, master = "app-x", "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_blocks_after_the_first_take_the_same_rows():
    """Where k rows are known, a block's scores are held against the last of them only: ties, copies and places stay."""
    rng = np.random.default_rng(3)
    for k in (2, 5):
        scores, ids = rng.integers(0, 40, (20, 400)) / 8 + rng.choice([0.0, 4e-7, -4e-7], (20, 400)), rng.permutation(400)
        copies = rng.integers(1, 4, 400)
        best = [np.zeros((20, 0)), np.zeros((20, 0), np.int64), np.zeros((20, 0), np.int64)]
        for i in range(0, 400, 80):
            best = blocks.better(best, scores[:, i : i + 80], ids[i : i + 80], copies[i : i + 80], k)
        for got, want in zip(best, blocks.select(blocks.rounded(scores), ids, k, copies)):
            assert (got == want).all()


def test_frequent_and_rare_grams_give_all_products():
    rng = np.random.default_rng(4)
    n, width, grams = 30, 100, 60
    q, c = (rng.random((rows, grams)) * (rng.random((rows, grams)) < rng.choice([0.02, 0.9], grams)) for rows in (n, width))
    row, gram = np.nonzero(q)
    column, entry = np.nonzero(c.T)
    known, first = np.unique(column, return_index=True)
    block = {"grams": known.tobytes(), "starts": np.append(first, len(column)).tobytes(), "rows": entry.astype(np.int32).tobytes(), "weights": c.T[column, entry].tobytes(), "ids": np.arange(width).tobytes()}
    found = sparse._products((n, row, *np.unique(gram, return_inverse=True), q[row, gram]), block)
    assert 0 < len(sparse._parts(block)[2]) < len(known) and np.allclose(found, q @ c.T)
