"""Ranking, union, scoring and picking of candidates.

Scores are rounded to DIGITS before they are ranked or compared, and ties go to the lowest corpus row,
so results don't depend on the order of floating-point sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.plans.shared import scratch, written

DIGITS = 6
Scorer = Callable[[Column, Column], Column]


def rounded(score: Column) -> Column:
    return F.round(score, DIGITS)


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query_idx",), score: str = "score", idx: str = "corpus_idx") -> DataFrame:
    """The k best rows of each query: score descending, then idx. Planned with a group limit before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(idx))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def union_candidates(*parts: DataFrame, on: Sequence[str] = ("query_idx", "corpus_idx")) -> DataFrame:
    """Distinct members of several candidate sets; their scores don't matter."""
    found = parts[0].select(*on)
    for part in parts[1:]:
        found = found.union(part.select(*on))
    return found.distinct()


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 for such that have nothing in common; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def ngram_dice(n: int = 3) -> Scorer:
    """Dice coefficient of the sets of character n-grams."""
    from kinfold.functions.text import char_ngrams, normalized

    def score(a: Column, b: Column) -> Column:
        x, y = (F.array_distinct(char_ngrams(normalized(t), n, n)) for t in (a, b))
        total = F.size(x) + F.size(y)
        return F.when(total == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(2 * F.size(F.array_intersect(x, y)) / total)

    return score


def pair_scores(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: Scorer | DataFrame = levenshtein_ratio) -> DataFrame:
    """``(query_idx, query_text, corpus_idx, corpus_text, score)``: each pair of texts is scored once.

    A table ``(query_text, corpus_text, score)`` in place of the scorer has the scores ready; pairs it
    hasn't are no candidates.
    """
    candidates = written(candidates.select("query_idx", "corpus_idx"), f"{scratch(candidates.sparkSession, 'pairs')}/candidates")  # read twice
    rows = candidates.join(queries.select("query_idx", "query_text"), "query_idx").join(corpus.select("corpus_idx", "corpus_text"), "corpus_idx")
    if isinstance(scorer, DataFrame):
        texts = scorer.groupBy("query_text", "corpus_text").agg(rounded(F.max(F.col("score").cast("double"))).alias("score"))
    else:
        texts = rows.select("query_text", "corpus_text").distinct().withColumn("score", rounded(scorer(F.col("query_text"), F.col("corpus_text")).cast("double")))
    return rows.join(texts, ["query_text", "corpus_text"]).select("query_idx", "query_text", "corpus_idx", "corpus_text", "score")


def best_match(scored: DataFrame) -> DataFrame:
    """``(query_idx, match_idx, match_text, score)``: the best candidate of each query, the lowest row among equals."""
    best = F.max_by(F.struct("corpus_idx", "corpus_text", "score"), F.struct(F.col("score"), -F.col("corpus_idx")))
    return scored.groupBy("query_idx").agg(best.alias("b")).select("query_idx", F.col("b.corpus_idx").alias("match_idx"), F.col("b.corpus_text").alias("match_text"), "b.score")


def shortlist(scored: DataFrame, n: int = 5) -> DataFrame:
    """The n best candidates of each query, with their rank from 1."""
    return top_k(scored, n)
