"""Scalar functions of the record-linkage engine."""

from kinfold.functions.text import as_text, char_ngrams, concat_key, normalized, title_text, typo

__all__ = ["as_text", "char_ngrams", "concat_key", "normalized", "title_text", "typo"]
