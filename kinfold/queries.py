"""The library's own queries over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.text import as_text, char_ngrams, concat_key, normalized, title_text, typo
from kinfold.operators import dense, link, matcher, occupations, ranking, sparse
from kinfold.operators.components import components
from kinfold.sources import positional

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL parts --------------------------------------------------------------------------------------


def _typo(text: str, key: str) -> str:
    return f"substr({text}, 1, ({key} % greatest(length({text}), 1))::INT) || substr({text}, ({key} % greatest(length({text}), 1))::INT + 2)"


def _norm(text: str) -> str:
    return f"regexp_replace(lower({text}), '\\s\\s+', ' ', 'g')"


def _grams(source: str, low: int = 2, high: int = 4, keys: str = "t") -> str:
    """(keys, gram) of the texts t in a relation."""
    parts = (f"SELECT {keys}, unnest([substr(t, i::INT, {n}) for i in range(1, length(t) - {n} + 2)]) AS gram FROM {source}" for n in range(low, high + 1))
    return " UNION ALL ".join(parts)


#: Relations q(query_idx, query_text) and c(corpus_idx, corpus_text).
PART = f"q AS (SELECT p_partkey AS query_idx, {_typo('p_name', 'p_partkey')} AS query_text FROM part), c AS (SELECT p_partkey AS corpus_idx, p_name AS corpus_text FROM part)"
BENCH = f"q AS (SELECT item_id::BIGINT AS query_idx, {_typo('text', 'item_id * 7')} AS query_text FROM benchmark), c AS (SELECT item_id::BIGINT AS corpus_idx, text AS corpus_text FROM benchmark)"
SELF = "q AS (SELECT p_partkey AS query_idx, p_name || ' ' || p_brand AS query_text FROM part), c AS (SELECT p_partkey AS corpus_idx, p_name || ' ' || p_brand AS corpus_text FROM part)"

FIT = f"""
ct AS (SELECT {_norm('corpus_text')} AS t, count(*) AS n_rows FROM c GROUP BY 1),
cg AS (SELECT t, gram, count(*) AS tf FROM ({_grams('ct')}) GROUP BY 1, 2),
g AS (SELECT gram, sum(n_rows) AS df, sum(tf * n_rows) AS total FROM cg JOIN ct USING (t) GROUP BY 1 ORDER BY total DESC, gram LIMIT 50000),
idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM c)) / (1 + df)::DOUBLE) + 1 AS idf FROM g),
cw AS (SELECT t, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w FROM cg JOIN idf USING (gram))"""

SIM = f"""
qt AS (SELECT DISTINCT {_norm('query_text')} AS t FROM q),
qg AS (SELECT t, gram, count(*) AS tf FROM ({_grams('qt')}) GROUP BY 1, 2),
qw AS (SELECT t, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w FROM qg JOIN idf USING (gram)),
sim AS (SELECT a.t AS qt, b.t AS ct, round(sum(a.w * b.w), 6) AS score FROM qw a JOIN cw b USING (gram) GROUP BY 1, 2)"""


def _sparse(k: int) -> str:
    """Every pair has a row, so the zeros that fill up come by themselves."""
    return FIT + "," + SIM + f""",
qn AS (SELECT {_norm('query_text')} AS t, query_idx FROM q), cn AS (SELECT {_norm('corpus_text')} AS t, corpus_idx FROM c),
per_text AS (SELECT qt.t AS qt, corpus_idx, coalesce(score, 0.0) AS score FROM qt CROSS JOIN cn LEFT JOIN sim ON sim.qt = qt.t AND sim.ct = cn.t
  QUALIFY row_number() OVER (PARTITION BY qt.t ORDER BY coalesce(score, 0.0) DESC, corpus_idx) <= {k}),
lexical AS (SELECT query_idx, corpus_idx, score FROM qn JOIN per_text ON qn.t = per_text.qt)"""


def _by_block(k: int) -> str:
    """Relations lexical and near, for q and c with a block b each: an index for each block."""

    def side(name: str, rows: str, text: str) -> str:
        return f"""{name}t AS (SELECT b, {_norm(text)} AS t, count(*) AS n_rows FROM {rows} GROUP BY 1, 2),
{name}g AS (SELECT b, t, gram, count(*) AS tf FROM ({_grams(name + "t", keys="b, t")}) GROUP BY 1, 2, 3),"""

    def coded(name: str, rows: str, text: str) -> str:
        return f"""{name}s AS (SELECT DISTINCT b, {text} AS s, lower({text}) AS t FROM {rows}),
{name}h AS (SELECT b, s, (unicode(substr(t, i::INT, 1)) * 961 + unicode(substr(t, i::INT + 1, 1)) * 31 + unicode(substr(t, i::INT + 2, 1))) % 64 AS h, count(*) AS n
  FROM (SELECT b, s, t, unnest(range(1, length(t) - 1)) AS i FROM {name}s) GROUP BY 1, 2, 3),
{name}v AS (SELECT b, s, h, n / sqrt(sum(n * n) OVER (PARTITION BY b, s)) AS v FROM {name}h),"""

    weight = "tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY b, t)) AS w"
    return f"""{side("c", "c", "corpus_text")} {side("q", "q", "query_text")} {coded("x", "q", "query_text")} {coded("y", "c", "corpus_text")}
idf AS (SELECT b, gram, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT b, gram, sum(n_rows) AS df FROM cg JOIN ct USING (b, t) GROUP BY 1, 2) JOIN (SELECT b, count(*) AS n FROM c GROUP BY 1) USING (b)),
cw AS (SELECT b, t, gram, {weight} FROM cg JOIN idf USING (b, gram)), qw AS (SELECT b, t, gram, {weight} FROM qg JOIN idf USING (b, gram)),
sim AS (SELECT m.b, m.t AS qt, o.t AS ct, round(sum(m.w * o.w), 6) AS score FROM qw m JOIN cw o USING (b, gram) GROUP BY 1, 2, 3),
per_text AS (SELECT qt.b, qt.t AS qt, corpus_idx FROM qt JOIN (SELECT b, {_norm('corpus_text')} AS t, corpus_idx FROM c) n USING (b) LEFT JOIN sim ON sim.b = qt.b AND sim.qt = qt.t AND sim.ct = n.t
  QUALIFY row_number() OVER (PARTITION BY qt.b, qt.t ORDER BY coalesce(score, 0.0) DESC, corpus_idx) <= {k}),
lexical AS (SELECT query_idx, corpus_idx FROM q JOIN per_text ON q.b = per_text.b AND {_norm('query_text')} = per_text.qt),
dsim AS (SELECT m.b, m.s AS qs, o.s AS cs, round(sum(m.v * o.v), 6) AS score FROM xv m JOIN yv o USING (b, h) GROUP BY 1, 2, 3),
near AS (SELECT query_idx, corpus_idx FROM q JOIN (SELECT xs.b, xs.s, corpus_idx FROM xs JOIN c USING (b) LEFT JOIN dsim ON dsim.b = xs.b AND dsim.qs = xs.s AND dsim.cs = c.corpus_text
  QUALIFY row_number() OVER (PARTITION BY xs.b, xs.s ORDER BY coalesce(score, 0.0) DESC, corpus_idx) <= {k}) n ON q.b = n.b AND q.query_text = n.s)"""


def _vectors(side: str, name: str) -> str:
    return f"""
{name}t AS (SELECT DISTINCT {side}_text AS s, lower({side}_text) AS t FROM {'q' if side == 'query' else 'c'}),
{name}b AS (SELECT s, (unicode(substr(t, i::INT, 1)) * 961 + unicode(substr(t, i::INT + 1, 1)) * 31 + unicode(substr(t, i::INT + 2, 1))) % 64 AS b, count(*) AS n
  FROM (SELECT s, t, unnest(range(1, length(t) - 1)) AS i FROM {name}t) GROUP BY 1, 2),
{name}v AS (SELECT s, b, n / sqrt(sum(n * n) OVER (PARTITION BY s)) AS v FROM {name}b)"""


def _dense(k: int) -> str:
    return _vectors("query", "x") + "," + _vectors("corpus", "y") + f""",
dsim AS (SELECT a.s AS qs, b.s AS cs, round(sum(a.v * b.v), 6) AS score FROM xv a JOIN yv b USING (b) GROUP BY 1, 2),
dtext AS (SELECT xt.s AS qs, corpus_idx, coalesce(score, 0.0) AS score FROM xt CROSS JOIN c LEFT JOIN dsim ON dsim.qs = xt.s AND dsim.cs = c.corpus_text
  QUALIFY row_number() OVER (PARTITION BY xt.s ORDER BY coalesce(score, 0.0) DESC, corpus_idx) <= {k}),
near AS (SELECT query_idx, corpus_idx, score FROM q JOIN dtext ON q.query_text = dtext.qs)"""


def _scored(base: str, k: int = 20) -> str:
    return f"WITH {base}, {_sparse(k)}, {_dense(k)}," + """
cand AS (SELECT query_idx, corpus_idx FROM lexical UNION SELECT query_idx, corpus_idx FROM near),
scored AS (SELECT query_idx, query_text, corpus_idx, corpus_text, round(CASE WHEN greatest(length(query_text), length(corpus_text)) = 0 THEN 1.0
  ELSE 1 - levenshtein(query_text, corpus_text) / greatest(length(query_text), length(corpus_text))::DOUBLE END, 6) AS score FROM cand JOIN q USING (query_idx) JOIN c USING (corpus_idx))"""


_BEST = ", best AS (SELECT query_idx, corpus_idx AS match_idx, corpus_text AS match_text, score FROM scored QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, corpus_idx) = 1)"


# inputs -----------------------------------------------------------------------------------------


def part_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("query_idx"), typo(F.col("p_name"), F.col("p_partkey")).alias("query_text")), part.select(F.col("p_partkey").alias("corpus_idx"), F.col("p_name").alias("corpus_text"))


def bench_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, sf_dir, "benchmark").withColumn("item_id", F.col("item_id").cast("long"))
    return b.select(F.col("item_id").alias("query_idx"), typo(F.col("text"), F.col("item_id") * 7).alias("query_text")), b.select(F.col("item_id").alias("corpus_idx"), F.col("text").alias("corpus_text"))


def part_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, c = part_pairs(spark, sf_dir)
    return q.toDF("idx", "name"), c.toDF("idx", "name")


# text and weights -------------------------------------------------------------------------------


@query("SELECT p_partkey, coalesce(p_name, 'None') AS name_text, p_size::VARCHAR AS size_text FROM part")
def text_cast(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", as_text("p_name").alias("name_text"), as_text("p_size").alias("size_text"))


@query("SELECT p_partkey, p_name || ' | ' || p_brand || ' | ' || p_size::VARCHAR AS key FROM part")
def concat_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", concat_key(["p_name", "p_brand", "p_size"]).alias("key"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE source || ' :: ' || lang END AS text FROM documents")
def title_desc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", title_text(F.col("source"), F.when(F.col("lang") == "en", "  ").otherwise(F.col("lang"))).alias("text"))


_BENCH_TEXTS = f"b AS (SELECT item_id::BIGINT AS item_id, {_norm('text')} AS t FROM benchmark)"


@query(f"WITH {_BENCH_TEXTS}, x AS (SELECT DISTINCT t FROM b), y AS (SELECT t, gram, count(*) AS tf FROM ({_grams('x')}) GROUP BY 1, 2) SELECT item_id, gram, tf FROM b JOIN y USING (t)")
def ngram_tf(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return sparse.term_counts(b.select(F.col("item_id").cast("long").alias("item_id"), normalized(F.col("text")).alias("text")), ["item_id"])


@query(f"WITH {BENCH}, {FIT} SELECT gram, round(idf, 6) AS idf FROM idf")
def ngram_idf(spark, sf_dir):
    return sparse.fit(bench_pairs(spark, sf_dir)[1]).idf.select("gram", F.round("idf", 6).alias("idf"))


_CAPPED = FIT.replace("LIMIT 50000", "LIMIT 500")


@query(f"WITH {BENCH}, {_CAPPED} SELECT gram, round(idf, 6) AS idf FROM idf")
def vocab_cap(spark, sf_dir):
    """Weights of a vocabulary that is capped at the 500 most frequent grams."""
    return sparse.fit(bench_pairs(spark, sf_dir)[1], features=500).idf.select("gram", F.round("idf", 6).alias("idf"))


@query(f"WITH {BENCH}, {_sparse(20).replace('LIMIT 50000', 'LIMIT 500')} SELECT query_idx, corpus_idx, score FROM lexical")
def sparse_topk_capped(spark, sf_dir):
    q, c = bench_pairs(spark, sf_dir)
    return sparse.topk(q, sparse.fit(c, features=500), 20)


@query("SELECT row_number() OVER (ORDER BY c_name DESC) - 1 AS idx, c_name, c_acctbal FROM customer")
def row_numbers(spark, sf_dir):
    return positional(table(spark, sf_dir, "customer").select("c_name", "c_acctbal"), [F.desc("c_name")])


@query(f"WITH {BENCH}, {FIT} SELECT corpus_idx, gram, round(w, 6) AS weight FROM (SELECT corpus_idx, {_norm('corpus_text')} AS t FROM c) JOIN cw USING (t)")
def tfidf_weights(spark, sf_dir):
    index = sparse.fit(bench_pairs(spark, sf_dir)[1])
    return index.rows.join(index.postings, "text").select("corpus_idx", "gram", F.round("weight", 6).alias("weight"))


# retrieval --------------------------------------------------------------------------------------


@query(f"WITH {BENCH}, {_sparse(20)} SELECT query_idx, corpus_idx, score FROM lexical")
def sparse_topk(spark, sf_dir):
    q, c = bench_pairs(spark, sf_dir)
    return sparse.topk(q, sparse.fit(c), 20)


_PADDED = "q AS (SELECT n_nationkey::BIGINT AS query_idx, n_name AS query_text FROM nation), c AS (SELECT r_regionkey::BIGINT AS corpus_idx, r_name AS corpus_text FROM region)"


@query(f"WITH {_PADDED}, {_sparse(4)} SELECT query_idx, corpus_idx, score FROM lexical")
def sparse_topk_zero_pad(spark, sf_dir):
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_idx"), F.col("n_name").alias("query_text"))
    c = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("corpus_idx"), F.col("r_name").alias("corpus_text"))
    return sparse.topk(q, sparse.fit(c), 4)


_DOT = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query(f"SELECT a.vec_id AS query_idx, b.vec_id AS corpus_idx, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) <= 20")
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return dense.topk(e.select(F.col("vec_id").alias("query_idx"), "embedding"), e.select(F.col("vec_id").alias("corpus_idx"), "embedding"), 20, skip_self=True)


@query(f"SELECT a.vec_id AS query_idx, b.vec_id AS corpus_idx, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {_DOT} >= 0.5")
def dense_pairs_threshold(spark, sf_dir):
    return dense.pairs_above(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding"), 0.5)


@query(f"WITH {PART}, {_sparse(20)}, {_dense(20)} SELECT query_idx, corpus_idx FROM lexical UNION SELECT query_idx, corpus_idx FROM near")
def candidate_union(spark, sf_dir):
    return link.candidates(*part_pairs(spark, sf_dir))


# scoring and linkage ----------------------------------------------------------------------------


def _part_scores(spark, sf_dir):
    """Queries, their different texts, and the scored pairs of these."""
    q, c = part_pairs(spark, sf_dir)
    texts = link.once(q)
    return q, texts, link.scored(texts, link.fit(c))


@query(_scored(PART) + " SELECT query_idx, query_text, corpus_idx, corpus_text, score FROM scored")
def pair_scores(spark, sf_dir):
    return link.for_all(*_part_scores(spark, sf_dir))


@query(_scored(PART) + _BEST + " SELECT * FROM best")
def best_match(spark, sf_dir):
    q, texts, scored = _part_scores(spark, sf_dir)
    return link.matched(q, texts, ranking.best_match(scored)).select("query_idx", "match_idx", "match_text", "score").where("match_idx is not null")


@query(_scored(PART) + " SELECT query_idx, query_text, corpus_idx, corpus_text, score, (row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, corpus_idx))::INT AS rank FROM scored QUALIFY rank <= 5")
def shortlist_topn(spark, sf_dir):
    q, texts, scored = _part_scores(spark, sf_dir)
    return link.for_all(q, texts, ranking.shortlist(scored, 5))


@query(_scored(PART) + _BEST + " SELECT query_idx, query_text, match_idx, match_text, score FROM q LEFT JOIN best USING (query_idx)")
def link_single(spark, sf_dir):
    q, c = part_inputs(spark, sf_dir)
    return link.link(q, c, column_query="name")


_MULTI = f"q AS (SELECT p_partkey AS query_idx, {_typo('p_name', 'p_partkey')} || ' | ' || p_brand AS query_text FROM part), c AS (SELECT p_partkey AS corpus_idx, p_name || ' | ' || p_brand AS corpus_text FROM part)"


@query(_scored(_MULTI) + _BEST + " SELECT query_idx, query_text, match_idx, match_text, score FROM q LEFT JOIN best USING (query_idx)")
def link_multi(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    q = part.select(F.col("p_partkey").alias("idx"), typo(F.col("p_name"), F.col("p_partkey")).alias("name"), F.col("p_brand").alias("brand"))
    c = part.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return link.link(q, c, columns_query=["name", "brand"])


@query(_scored(PART) + _BEST + " SELECT query_idx, query_text, match_idx, match_text, score FROM q LEFT JOIN (SELECT * FROM best WHERE score >= 0.94) USING (query_idx)")
def link_threshold(spark, sf_dir):
    q, c = part_inputs(spark, sf_dir)
    return link.link(q, c, column_query="name", threshold=0.94)


@query(_scored(PART) + _BEST + " SELECT query_idx AS idx, query_text AS name, match_idx, score, p_name AS name_corpus, p_brand, p_size::INT AS p_size FROM q LEFT JOIN best USING (query_idx) LEFT JOIN part ON p_partkey = match_idx")
def merge_back(spark, sf_dir):
    q, c = part_inputs(spark, sf_dir)
    corpus = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"), "p_brand", "p_size")
    return link.merge_back(q, link.link(q, c, column_query="name"), corpus)


@query(_scored(PART) + _BEST + " SELECT query_text AS query, match_text AS \"match\", score FROM q LEFT JOIN best USING (query_idx)")
def r_output_shape(spark, sf_dir):
    q, c = part_inputs(spark, sf_dir)
    return link.one_based(link.link(q, c, column_query="name"), return_scores=True)


# blocks: nations within regions, all misspelt ---------------------------------------------------

_BLOCKS = f"""bq AS (SELECT n_nationkey::BIGINT AS query_idx, {_typo('r_name', 'n_nationkey')} AS query_block, {_typo('n_name', 'n_nationkey * 3')} AS query_text FROM nation JOIN region ON n_regionkey = r_regionkey),
bc AS (SELECT n_nationkey::BIGINT AS corpus_idx, r_name AS corpus_block, n_name AS corpus_text FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT row_number() OVER (ORDER BY query_block) - 1 AS query_idx, query_block AS query_text FROM (SELECT DISTINCT query_block FROM bq)),
c AS (SELECT row_number() OVER (ORDER BY corpus_block) - 1 AS corpus_idx, corpus_block AS corpus_text FROM (SELECT DISTINCT corpus_block FROM bc))"""
_MAPPED = _scored(_BLOCKS) + _BEST + ", bmap AS (SELECT query_text AS query_block, match_text AS match_block, score AS block_score FROM q LEFT JOIN best USING (query_idx))"
_LEV = "round(1 - levenshtein(query_text, corpus_text) / greatest(length(query_text), length(corpus_text))::DOUBLE, 6)"


def _nations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("idx", F.col("n_nationkey").cast("long"))
    return n.select("idx", typo(F.col("r_name"), F.col("idx")).alias("region"), typo(F.col("n_name"), F.col("idx") * 3).alias("nation")), n.select("idx", F.col("r_name").alias("region"), F.col("n_name").alias("nation"))


@query("SELECT DISTINCT r_name AS block FROM nation JOIN region ON n_regionkey = r_regionkey")
def block_distinct(spark, sf_dir):
    return _nations(spark, sf_dir)[1].select(F.col("region").alias("block")).distinct()


@query(_MAPPED + " SELECT * FROM bmap")
def block_map(spark, sf_dir):
    q, c = _nations(spark, sf_dir)
    return link.block_map(q.select(F.col("region").alias("query_block")), c.select(F.col("region").alias("corpus_block")), 20, dense.hashed_ngrams, ranking.levenshtein_ratio)


# 100 candidates of 25 rows are all of them, so what is in the block is scored
@query(_MAPPED + f" SELECT query_idx, bq.query_block, query_text AS query_detail, corpus_idx AS match_idx, match_block, corpus_text AS match_detail, block_score, {_LEV} AS detail_score FROM bq JOIN bmap USING (query_block) JOIN bc ON corpus_block = match_block QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY {_LEV} DESC, corpus_idx) = 1")
def link_blocked_postfilter(spark, sf_dir):
    return link.link_blocked(*_nations(spark, sf_dir), "region", "nation")


@query(_MAPPED + f" SELECT query_idx, bq.query_block, query_text AS query_detail, corpus_idx AS match_idx, match_block, corpus_text AS match_detail, block_score, {_LEV} AS detail_score FROM bq JOIN bmap USING (query_block) JOIN bc ON corpus_block = match_block QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY {_LEV} DESC, corpus_idx) = 1")
def link_blocked_per_block(spark, sf_dir):
    return link.link_blocked(*_nations(spark, sf_dir), "region", "nation", mode="per_block")


# one candidate of each kind out of all rows: most are in another block, whose lowest row stands in then
_NARROW_SQL = (
    _scored(_BLOCKS, 1)
    + _BEST
    + ", bmap AS (SELECT query_text AS query_block, match_text AS match_block, score AS block_score FROM q LEFT JOIN best USING (query_idx)),"
    + "near_rows AS (SELECT query_idx, corpus_idx FROM ("
    + f"WITH {_BLOCKS.replace('q AS (SELECT row_number', 'unused_q AS (SELECT row_number').replace('c AS (SELECT row_number', 'unused_c AS (SELECT row_number').replace('unused_unused', 'unused')}, q AS (SELECT query_idx, query_text FROM bq), c AS (SELECT corpus_idx, corpus_text FROM bc), {_sparse(1)}, {_dense(1)} SELECT query_idx, corpus_idx FROM lexical UNION SELECT query_idx, corpus_idx FROM near)),"
    + """inside AS (SELECT query_idx, corpus_idx FROM near_rows JOIN bq USING (query_idx) JOIN bmap USING (query_block) JOIN bc USING (corpus_idx) WHERE corpus_block = match_block),
spare AS (SELECT query_idx, min(corpus_idx) AS corpus_idx FROM bq JOIN bmap USING (query_block) JOIN bc ON corpus_block = match_block WHERE query_idx NOT IN (SELECT query_idx FROM inside) GROUP BY 1),
picked AS (SELECT * FROM inside UNION ALL SELECT * FROM spare)"""
    + f" SELECT query_idx, bq.query_block, query_text AS query_detail, corpus_idx AS match_idx, match_block, corpus_text AS match_detail, block_score, {_LEV} AS detail_score FROM picked JOIN bq USING (query_idx) JOIN bmap USING (query_block) JOIN bc USING (corpus_idx) QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY {_LEV} DESC, corpus_idx) = 1"
)


@query(_NARROW_SQL)
def link_blocked_fallback(spark, sf_dir):
    return link.link_blocked(*_nations(spark, sf_dir), "region", "nation", retrieval_top_k=1, overfetch=1)


# blocks of parts and customers: many rows, equal details, fewer candidates than rows -------------


def _with_blocks(bq: str, bc: str) -> str:
    """Blocks of bq and bc linked to each other: relation bmap."""
    blocks = f"""bq AS ({bq}), bc AS ({bc}),
q AS (SELECT row_number() OVER (ORDER BY query_block) - 1 AS query_idx, query_block AS query_text FROM (SELECT DISTINCT query_block FROM bq)),
c AS (SELECT row_number() OVER (ORDER BY corpus_block) - 1 AS corpus_idx, corpus_block AS corpus_text FROM (SELECT DISTINCT corpus_block FROM bc))"""
    return _scored(blocks) + _BEST + ", bmap AS (SELECT query_text AS query_block, match_text AS match_block, score AS block_score FROM q LEFT JOIN best USING (query_idx))"


_LEVEN = "round(CASE WHEN greatest(length(query_text), length(corpus_text)) = 0 THEN 1.0 ELSE 1 - levenshtein(query_text, corpus_text) / greatest(length(query_text), length(corpus_text))::DOUBLE END, 6)"
_IN_BLOCK = f"""SELECT query_idx, bq.query_block, query_text AS query_detail, corpus_idx AS match_idx, match_block, corpus_text AS match_detail, block_score, {_LEVEN} AS detail_score
  FROM picked JOIN bq USING (query_idx) JOIN bmap USING (query_block) JOIN bc USING (corpus_idx) QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY {_LEVEN} DESC, corpus_idx) = 1"""


def _per_block(bq: str, bc: str, k: int) -> str:
    """The first row of the block that has the detail of the best candidate."""
    inner = f"WITH q AS (SELECT query_idx, query_text, match_block AS b FROM bq JOIN bmap USING (query_block)), c AS (SELECT corpus_idx, corpus_text, corpus_block AS b FROM bc), {_by_block(k)} SELECT query_idx, corpus_idx FROM lexical UNION SELECT query_idx, corpus_idx FROM near"
    return _with_blocks(bq, bc) + f", picked AS ({inner}), top AS ({_IN_BLOCK}) SELECT top.* REPLACE ((SELECT min(corpus_idx) FROM bc WHERE corpus_block = top.match_block AND corpus_text = top.match_detail) AS match_idx) FROM top"


_PART_BQ = f"SELECT p_partkey AS query_idx, {_typo('p_type', 'p_partkey % 3')} AS query_block, {_typo('p_name', 'p_partkey')} AS query_text FROM part"
_PART_BC = "SELECT p_partkey AS corpus_idx, p_type AS corpus_block, p_name AS corpus_text FROM part"


def _part_blocks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    q = part.select(F.col("p_partkey").alias("idx"), typo(F.col("p_type"), F.col("p_partkey") % 3).alias("maker"), typo(F.col("p_name"), F.col("p_partkey")).alias("name"))
    return q, part.select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("maker"), F.col("p_name").alias("name"))


@query(_per_block(_PART_BQ, _PART_BC, 20))
def link_blocked_equal_details(spark, sf_dir):
    """Several parts of a maker have one name: the first stands for them."""
    return link.link_blocked(*_part_blocks(spark, sf_dir), "maker", "name", mode="per_block")


_CUSTOMER_BQ = f"SELECT c_custkey AS query_idx, c_mktsegment AS query_block, {_typo('c_name', 'c_custkey')} AS query_text FROM customer"
_CUSTOMER_BC = "SELECT c_custkey AS corpus_idx, c_mktsegment AS corpus_block, c_name AS corpus_text FROM customer"


@query("SELECT query_block, query_detail, match_block, match_detail, match_idx + 1 AS match_index, block_score, detail_score FROM (" + _per_block(_CUSTOMER_BQ, _CUSTOMER_BC, 30) + ")")
def r_blocked_shape(spark, sf_dir):
    """The blocked matcher with its own defaults: 30 candidates, rows from 1, scores asked for."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    q = c.select("idx", "segment", typo(F.col("name"), F.col("idx")).alias("name"))
    return matcher.ensemble_link_blocked(q, c, "segment", "name", return_scores=True)


_FETCHED_SQL = (
    _with_blocks(_PART_BQ, _PART_BC)
    + f", near_rows AS (WITH q AS (SELECT query_idx, query_text FROM bq), c AS (SELECT corpus_idx, corpus_text FROM bc), {_sparse(10)}, {_dense(10)} SELECT query_idx, corpus_idx FROM lexical UNION SELECT query_idx, corpus_idx FROM near),"
    + """inside AS (SELECT query_idx, corpus_idx FROM near_rows JOIN bq USING (query_idx) JOIN bmap USING (query_block) JOIN bc USING (corpus_idx) WHERE corpus_block = match_block),
spare AS (SELECT query_idx, corpus_idx FROM bq JOIN bmap USING (query_block) JOIN (SELECT * FROM bc QUALIFY row_number() OVER (PARTITION BY corpus_block ORDER BY corpus_idx) <= 2) ON corpus_block = match_block WHERE query_idx NOT IN (SELECT query_idx FROM inside)),
picked AS (SELECT * FROM inside UNION ALL SELECT * FROM spare) """
    + _IN_BLOCK
)


@query(_FETCHED_SQL)
def link_blocked_overfetch(spark, sf_dir):
    """Five times two candidates of each kind out of all parts, most of other makers."""
    return link.link_blocked(*_part_blocks(spark, sf_dir), "maker", "name", retrieval_top_k=2)


# code lists -------------------------------------------------------------------------------------

_UNIFIED = """u AS (SELECT p_name AS title, p_type AS description, CASE WHEN p_size <= 25 THEN 'historical' ELSE 'modern' END AS era, p_brand AS canonical_code,
  CASE WHEN p_size <= 25 THEN p_brand END AS hisco_code, CASE WHEN p_size > 25 THEN p_brand END AS isco_code, p_name || ' :: ' || p_type AS text FROM part)"""


@query(f"WITH {_UNIFIED} SELECT * FROM u")
def unified_corpus(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return occupations.build_unified_corpus(part.where("p_size <= 25"), part.where("p_size > 25"), ("p_name", "p_type", "p_brand"), ("p_name", "p_type", "p_brand"))


@query(f"SELECT row_number() OVER (ORDER BY era, p_partkey) - 1 AS idx, * EXCLUDE (p_partkey) FROM ({_UNIFIED[6:-1].replace('SELECT p_name', 'SELECT p_partkey, p_name')})")
def unified_positions(spark, sf_dir):
    """The unified list with its row numbers: the first list's rows, then the second's."""
    part = table(spark, sf_dir, "part")
    return occupations.build_unified_corpus(part.where("p_size <= 25"), part.where("p_size > 25"), ("p_name", "p_type", "p_brand"), ("p_name", "p_type", "p_brand"), order=["p_partkey"])


_CLASSIFIED = f"q AS (SELECT p_partkey AS query_idx, {_typo('p_name', 'p_partkey')} || ' :: ' || p_type AS query_text FROM part), c AS (SELECT p_partkey AS corpus_idx, p_name || ' :: ' || p_type AS corpus_text FROM part)"


def _classes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    q = part.select(F.col("p_partkey").alias("idx"), title_text(typo(F.col("p_name"), F.col("p_partkey")), F.col("p_type")).alias("text"))
    return q, part.select(F.col("p_partkey").alias("idx"), title_text(F.col("p_name"), F.col("p_type")).alias("text"))


@query(_scored(_CLASSIFIED, 30) + _BEST + " SELECT query_idx, query_text, match_idx, match_text, score FROM q LEFT JOIN best USING (query_idx)")
def classify(spark, sf_dir):
    return occupations.classify(*_classes(spark, sf_dir))


_SECOND = ", list AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, corpus_idx) AS r FROM scored QUALIFY r <= 5)"


@query(_scored(_CLASSIFIED, 30) + _SECOND + " SELECT query_idx, query_text, corpus_idx AS match_idx, corpus_text AS match_text, score FROM list WHERE r = CASE WHEN query_idx % 7 < 5 THEN query_idx % 7 + 1 ELSE 1 END")
def second_stage_pick(spark, sf_dir):
    """A second stage that picks by the query's number; out of range keeps the winner."""
    return occupations.classify(*_classes(spark, sf_dir), second_stage=F.pmod(F.col("query_idx"), F.lit(7)))


@query(_scored(_CLASSIFIED, 30) + _SECOND + " SELECT query_idx, query_text, corpus_idx AS match_idx, corpus_text AS match_text, score FROM list WHERE r = length(query_text) % 3 + 1")
def classify_callback_udf(spark, sf_dir):
    """The same with a Python callback."""
    return occupations.classify(*_classes(spark, sf_dir), second_stage=lambda query, texts: len(query) % 3)


# dedup ------------------------------------------------------------------------------------------

_DUPES = _scored(SELF, 30) + ", pairs AS (SELECT query_idx, corpus_idx, score FROM scored WHERE corpus_idx > query_idx AND score >= 0.95)"
_LABELS = _DUPES.replace("WITH ", "WITH RECURSIVE ", 1) + """,
edges AS (SELECT query_idx AS a, corpus_idx AS b FROM pairs UNION SELECT corpus_idx, query_idx FROM pairs),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a),
label AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)"""
_CLUSTERS = _LABELS + """,
r AS (SELECT p_partkey AS orig_idx, coalesce(component, p_partkey) AS cluster_id, p_name AS title, p_brand AS canonical_code, CASE WHEN p_size <= 25 THEN 'historical' ELSE 'modern' END AS era FROM part LEFT JOIN label ON node = p_partkey),
k AS (SELECT cluster_id, coalesce(min(CASE WHEN era = 'modern' THEN orig_idx END), min(orig_idx)) AS canonical_idx, count(*) AS n_records,
  array_to_string(list_sort(list_distinct(list(canonical_code))), ' | ') AS canonical_code, array_to_string(list_sort(list_distinct(list(title))), ' | ') AS aliases FROM r GROUP BY 1)"""


def _records(spark, sf_dir):
    era = F.when(F.col("p_size") <= 25, "historical").otherwise("modern").alias("era")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), F.col("p_name").alias("title"), F.col("p_brand").alias("canonical_code"), era)


@query(_DUPES + " SELECT * FROM pairs")
def dedup_pairs(spark, sf_dir):
    return occupations.duplicate_pairs(_records(spark, sf_dir))


@query(_LABELS + " SELECT node, component FROM label")
def dedup_components(spark, sf_dir):
    return components(occupations.duplicate_pairs(_records(spark, sf_dir)), "query_idx", "corpus_idx")


@query(_CLUSTERS + " SELECT orig_idx, canonical_idx, cluster_id FROM r JOIN k USING (cluster_id)")
def dedup_mapping(spark, sf_dir):
    return occupations.deduplicate_corpus(_records(spark, sf_dir))[1]


@query(_CLUSTERS + " SELECT k.canonical_idx AS idx, p_name || ' ' || p_brand AS text, p_name AS title, CASE WHEN p_size <= 25 THEN 'historical' ELSE 'modern' END AS era, cluster_id, n_records, canonical_code, aliases FROM k JOIN part ON p_partkey = canonical_idx")
def dedup_merged(spark, sf_dir):
    return occupations.deduplicate_corpus(_records(spark, sf_dir))[0]


_CODE = "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'None' WHEN 3 THEN 'nan' ELSE p_brand END"


@query(_LABELS + f""", r AS (SELECT p_partkey AS orig_idx, coalesce(component, p_partkey) AS cluster_id, {_CODE} AS code FROM part LEFT JOIN label ON node = p_partkey)
SELECT cluster_id, nullif(array_to_string(list_sort(list_distinct(coalesce(list(code) FILTER (WHERE code IS NOT NULL AND code NOT IN ('', 'None', 'nan')), []))), ' | '), '') AS code, count(*) AS n_records FROM r GROUP BY 1""")
def dedup_codes(spark, sf_dir):
    """Codes that are null or stand for nothing don't count."""
    code = F.expr(_CODE.replace("CASE p_partkey % 6", "CASE idx % 6").replace("p_brand", "canonical_code"))
    rows = _records(spark, sf_dir).withColumn("code", code).select("idx", "text", "era", "code")
    return occupations.deduplicate_corpus(rows, code_cols=["code"])[0].select("cluster_id", "code", "n_records")
