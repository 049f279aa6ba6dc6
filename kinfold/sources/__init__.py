"""Sources of the record-linkage engine."""

from kinfold.sources.tables import from_values, positional, read_csv

__all__ = ["from_values", "positional", "read_csv"]
