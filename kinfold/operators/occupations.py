"""Code lists: two lists under one schema, a classifier with an optional second stage, deduplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import as_text, title_text
from kinfold.operators import dense, sparse
from kinfold.operators.components import ONE_TASK, components
from kinfold.operators.link import Encoder, Index, fit, for_all, index_of, keyed, matched, of_texts, once, scored
from kinfold.operators.ranking import Scorer, best_match, levenshtein_ratio, pair_scores, shortlist
from kinfold.sources.tables import positional

TOP_K = 30
CODES = ("canonical_code", "hisco_code", "isco_code")


def _listed(rows: DataFrame, title: str, description: str, code: str, era: str, own: str, null_text: str | None, extra: Sequence[Column] = ()) -> DataFrame:
    has_text, has_code = description in rows.columns, code in rows.columns
    text = as_text(description, null_text) if has_text else F.lit(None).cast("string")
    own_code = F.col(code).cast("string") if has_code else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    codes = {c: own_code if c in ("canonical_code", own) else none for c in CODES}
    name = as_text(title)
    return rows.select(name.alias("title"), F.coalesce(text, F.lit("")).alias("description"), F.lit(era).alias("era"), *(codes[c].alias(c) for c in CODES), title_text(name, text).alias("text"), *extra)


def build_unified_corpus(hisco: DataFrame, isco: DataFrame, hisco_cols: Sequence[str] = ("title", "description", "hisco_code"), isco_cols: Sequence[str] = ("title", "description", "isco_code"), era_labels: tuple[str, str] = ("historical", "modern"), null_text: str | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """``(title, description, era, canonical_code, hisco_code, isco_code, text)`` of both lists.

    Columns are (title, description, code); an absent description is empty, an absent code null. With
    ``order``, columns that both lists have, rows are numbered in ``idx``: the first list's in this order, then the second's.
    """
    parts = [(hisco, hisco_cols, era_labels[0], "hisco_code"), (isco, isco_cols, era_labels[1], "isco_code")]
    if order is None:
        one, two = (_listed(rows, *columns, era, own, null_text) for rows, columns, era, own in parts)
        return one.unionByName(two)
    keys = [f"__{k}" for k in range(len(order))]
    one, two = (_listed(rows, *columns, era, own, null_text, [F.lit(n).alias("__list"), *(F.col(c).alias(k) for c, k in zip(order, keys))]) for n, (rows, columns, era, own) in enumerate(parts))
    return positional(one.unionByName(two), ["__list", *keys]).drop("__list", *keys)


def classify(queries: DataFrame, corpus: DataFrame | Index, query_column: str = "text", corpus_column: str = "text", query_id: str = "idx", corpus_id: str = "idx", retrieval_top_k: int = TOP_K, second_stage: Callable[[str, list[str]], int] | Column | None = None, second_stage_top_n: int = 5, encoder: Encoder | None = dense.hashed_ngrams, scorer: Scorer | DataFrame = levenshtein_ratio, ngrams: tuple[int, int] = (2, 4), features: int = sparse.FEATURES) -> DataFrame:
    """``(query_idx, query_text, match_idx, match_text, score)``.

    ``corpus`` is a table or the index that ``link.index_of`` made of one, which many calls can use.
    ``second_stage`` picks from the texts of the best ``second_stage_top_n`` candidates, best first: a
    Python function of (query, texts) that returns a position from 0, or an expression over the columns
    ``query_text`` and ``texts``. A position out of range keeps the winner; the score is that of the
    first stage.
    """
    q = keyed(queries, query_id, query_column, None, "query")
    index = corpus if isinstance(corpus, Index) else index_of(corpus, corpus_column, None, corpus_id, encoder, ngrams, features)
    texts = once(q)
    found = scored(texts, index, retrieval_top_k, scorer)
    if second_stage is None:
        rows = matched(q, texts, best_match(found))
    elif isinstance(second_stage, Column):  # it may use the query's number
        rows = _picked(matched(q, texts, _tops(shortlist(found, second_stage_top_n))), second_stage)
    else:
        rows = matched(q, texts, second_pick(shortlist(found, second_stage_top_n), second_stage))
    return rows.select("query_idx", "query_text", "match_idx", "match_text", "score")


def second_pick(listed: DataFrame, second_stage: Callable[[str, list[str]], int] | Column) -> DataFrame:
    """``(query_idx, match_idx, match_text, score)`` out of a shortlist."""
    return _picked(_tops(listed), second_stage).drop("query_text")


def _tops(listed: DataFrame) -> DataFrame:
    """``(query_idx, query_text, top)``: a shortlist as one list a query."""
    return listed.groupBy("query_idx", "query_text").agg(F.array_sort(F.collect_list(F.struct("rank", "corpus_idx", "corpus_text", "score"))).alias("top"))


def _picked(rows: DataFrame, second_stage: Callable[[str, list[str]], int] | Column) -> DataFrame:
    """``(query_idx, query_text, match_idx, match_text, score)`` of ``(query_idx, query_text, top)``; without a list there is no match."""
    rows = rows.withColumn("texts", F.transform("top", lambda x: x["corpus_text"]))
    if isinstance(second_stage, Column):
        place = F.when(F.col("top").isNotNull(), second_stage)
    else:

        @F.pandas_udf("int")
        def pick(query: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([second_stage(a, list(b)) for a, b in zip(query, texts)], dtype="Int32")

        place = pick("query_text", "texts")
    at = F.coalesce(place.cast("int"), F.lit(0))
    rows = rows.withColumn("at", at).withColumn("at", F.when((F.col("at") >= 0) & (F.col("at") < F.size("top")), F.col("at")).otherwise(0))
    return rows.withColumn("x", F.col("top")[F.col("at")]).select("query_idx", "query_text", F.col("x.corpus_idx").alias("match_idx"), F.col("x.corpus_text").alias("match_text"), "x.score")


def duplicate_pairs(rows: DataFrame, idx: str = "idx", text: str = "text", threshold: float = 0.95, retrieval_top_k: int = TOP_K, encoder=dense.hashed_ngrams, scorer: Scorer = levenshtein_ratio) -> DataFrame:
    """``(query_idx, corpus_idx, score)``: pairs that the lower row retrieves and whose score reaches the threshold."""
    q, c = keyed(rows, idx, text, None, "query"), keyed(rows, idx, text, None, "corpus")
    index, texts = fit(c, encoder=encoder), once(q)
    # above the lowest row of a text, then above each row that has it
    found = of_texts(texts, index, retrieval_top_k).where("corpus_idx > query_idx")
    near = pair_scores(found, texts, index.corpus, scorer).where(F.col("score") >= threshold).select("query_idx", "corpus_idx", "score")
    return for_all(q, texts, near, later=True)


def deduplicate_corpus(corpus: DataFrame, idx: str = "idx", text_col: str = "text", era_col: str = "era", code_cols: Sequence[str] = CODES, score_threshold: float = 0.95, retrieval_top_k: int = TOP_K, title_col: str = "title", preferred_era: str = "modern", encoder=dense.hashed_ngrams, scorer: Scorer = levenshtein_ratio, one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """(merged rows, mapping). Clusters are connected components of the duplicate pairs.

    A cluster is represented by its lowest row of the preferred era, else its lowest row; that row's
    columns stay, its codes become the sorted different codes of the cluster (null if none),
    ``aliases`` its titles, ``n_records`` its size. The mapping is ``(orig_idx, canonical_idx,
    cluster_id)``, the cluster named by its lowest row. Columns of the caller with the names of new ones get
    ``_original``. ``one_task`` is passed to ``components``.
    """
    clash = {"cluster_id", "n_records", "canonical_idx", *({"aliases"} if title_col in corpus.columns else ())} & set(corpus.columns) - {idx, text_col, era_col, title_col, *code_cols}
    corpus = corpus.withColumnsRenamed({c: f"{c}_original" for c in clash})
    pairs = duplicate_pairs(corpus, idx, text_col, score_threshold, retrieval_top_k, encoder, scorer)
    label = components(pairs, "query_idx", "corpus_idx", one_task).select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    rows = corpus.join(label, F.col(idx) == F.col("__node"), "left").withColumn("cluster_id", F.coalesce("__component", F.col(idx).cast("long"))).drop("__node", "__component")
    preferred = F.min(F.when(F.col(era_col).cast("string") == preferred_era, F.col(idx))) if era_col in corpus.columns else F.lit(None).cast("long")
    codes = [c for c in code_cols if c in corpus.columns]

    def merged(c: str) -> Column:
        value = F.col(c).cast("string")
        all_ = F.array_sort(F.collect_set(F.when(~value.isin("", "None", "nan"), value)))
        return F.when(F.size(all_) > 0, F.concat_ws(" | ", all_)).alias(c)

    parts = [F.coalesce(preferred, F.min(idx)).cast("long").alias("canonical_idx"), F.count("*").alias("n_records"), *(merged(c) for c in codes)]
    if title_col in corpus.columns:
        parts.append(F.concat_ws(" | ", F.array_sort(F.collect_set(as_text(title_col)))).alias("aliases"))
    clusters = rows.groupBy("cluster_id").agg(*parts)
    mapping = rows.select(F.col(idx).cast("long").alias("orig_idx"), "cluster_id").join(clusters.select("cluster_id", "canonical_idx"), "cluster_id").select("orig_idx", "canonical_idx", "cluster_id")
    kept = corpus.drop(*codes).join(clusters.withColumnRenamed("canonical_idx", idx), idx)
    return kept, mapping
