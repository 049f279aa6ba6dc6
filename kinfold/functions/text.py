"""Text keys as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space in a regular expression.
SPACES = r"(?U)\s\s+"


def as_text(column: Column | str, null_text: str | None = "None") -> Column:
    """The value as a string; null as ``null_text``, or null if that is None."""
    text = F.col(column).cast("string") if isinstance(column, str) else column.cast("string")
    return text if null_text is None else F.coalesce(text, F.lit(null_text))


def concat_key(columns: Sequence[str], separator: str = " | ", null_text: str = "None") -> Column:
    """One key out of several columns, in their order."""
    return F.concat_ws(separator, *(as_text(c, null_text) for c in columns))


def title_text(title: Column, description: Column) -> Column:
    """``title :: description``, or the title alone where the description is null or blank."""
    title = F.coalesce(title.cast("string"), F.lit(""))
    stripped = F.regexp_replace(F.coalesce(description.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(stripped != "", F.concat(title, F.lit(" :: "), stripped)).otherwise(title)


def normalized(text: Column) -> Column:
    """What n-grams are taken from: lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(text), SPACES, " ")


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All substrings of low..high characters, with repeats; shorter texts have none."""

    def of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def typo(text: Column, key: Column) -> Column:
    """The text without one character, at a place that the key determines."""
    at = F.pmod(key, F.greatest(F.length(text), F.lit(1))).cast("int")
    return F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + 2, F.length(text)))
