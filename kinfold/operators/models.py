"""Adapters for neural encoders and scorers; the libraries are loaded in the workers, once for each model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOADED: dict[tuple, object] = {}


def _load(kind: str, name: str, cache_dir: str | None, device: str | None):
    key = (kind, name, device)
    if key not in _LOADED:
        try:
            import sentence_transformers as library
        except ModuleNotFoundError as e:
            raise RuntimeError(f"the model {name} needs the package sentence-transformers on every worker") from e
        _LOADED[key] = getattr(library, kind)(name, cache_folder=cache_dir, device=device)
    return _LOADED[key]


def transformer_encoder(name: str, cache_dir: str | None = None, batch_size: int = 256, device: str | None = None) -> Callable[[Column], Column]:
    """An encoder for ``link(encoder=...)``: unit vectors of a sentence-embedding model."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load("SentenceTransformer", name, cache_dir, device)
        for texts in batches:
            yield pd.Series(list(model.encode(texts.fillna("").tolist(), batch_size=batch_size, normalize_embeddings=True)))

    return lambda text: encode(text)


def transformer_scorer(name: str, cache_dir: str | None = None, batch_size: int = 64, max_length: int = 1024, device: str | None = None) -> Callable[[Column, Column], Column]:
    """A scorer for ``link(scorer=...)``: the relevance that a cross-encoder gives a pair; higher is better."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _load("CrossEncoder", name, cache_dir, device)
        model.max_length = max_length
        for a, b in batches:
            yield pd.Series(model.predict(list(zip(a, b)), batch_size=batch_size), dtype="float64")

    return lambda a, b: score(a, b)
