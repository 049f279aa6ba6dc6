"""License scans: ordered signature rules behind a keyword prefilter.

One pass of an automaton over the lower-case text tells which keywords it has; only the rules of
these run. Detections are then taken in order of priority, longer ones and earlier ones first among
equals; one that lies within a detection taken before is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import license_rules
from kinfold.llm import words as W


class Rule(NamedTuple):
    number: int
    priority: int
    license: str
    keywords: tuple[str, ...]
    find: object


class Found(NamedTuple):
    start: int
    end: int
    license: str
    rule: int
    priority: int


#: What a space of a rule stands for: white space, or line ends with the comment marks that lines begin with.
SPACE = r"(?:(?:[^\S\n]*\n\s*(?:[*#;%!>|]+|//+|--+|dnl|rem)(?=\s))+\s+|\s+)"
_SPACE = re.compile(SPACE, re.IGNORECASE)


def rules(text: str = license_rules.TEXT, space: str = SPACE) -> list[Rule]:
    out = []
    for line in filter(None, text.split("\n")):
        priority, name, keywords, expression = line.split(";", 3)
        expression = expression.replace("[- ]", "(?:-| )").replace("[ -]", "(?:-| )")  # white space in a class would be one character, or a plus
        expression = expression.replace(" ?", "\0").replace(" ", space).replace("\0", f"(?:{space})?")
        out.append(Rule(len(out), int(priority), name, tuple(keywords.split("|")), re.compile(expression, re.IGNORECASE | re.DOTALL)))  # gaps cross line ends
    return out


def folded(text: str) -> str:
    """Lower case, with white space and comment marks as spaces, so that keywords of several words are met."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow: those stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _SPACE.sub(" ", low) if "\n" in low else " ".join(low.split())


class Scanner:
    def __init__(self, text: str = license_rules.TEXT):
        self.rules = rules(text)
        self.by_keyword: dict[str, list[Rule]] = defaultdict(list)
        for r in self.rules:
            for k in r.keywords:
                self.by_keyword[k].append(r)
        self.automaton = ahocorasick.Automaton()
        for k in self.by_keyword:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[Rule]:
        met = {k for _, k in self.automaton.iter(folded(text))}
        return sorted({r for k in met for r in self.by_keyword[k]}, key=lambda r: r.number)

    def scan(self, text: str, prefilter: bool = True) -> list[Found]:
        found = [Found(*m.span(), r.license, r.number, r.priority) for r in (self.candidates(text) if prefilter else self.rules) for m in r.find.finditer(text) if m.end() > m.start()]
        return resolved(found)


def resolved(found: list[Found]) -> list[Found]:
    """Those that no detection taken before contains, by place."""
    taken: list[Found] = []
    starts: list[int] = []  # of taken ones that no other contains: both ends ascend
    ends: list[int] = []
    for f in sorted(found, key=lambda f: (f.priority, f.start - f.end, f.start, f.rule)):
        at = bisect_right(starts, f.start)
        if at and ends[at - 1] >= f.end:
            continue
        taken.append(f)
        at = bisect_left(starts, f.start)
        stop = bisect_right(ends, f.end, at)
        starts[at:stop], ends[at:stop] = [f.start], [f.end]
    return sorted(taken)


_SCHEMA = "doc_id long, start long, end long, license string, rule int, priority int"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())


def _scanned(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(text).scan
        for batch in batches:
            ids, rows = W.column(batch, "doc_id").to_pylist(), []
            for doc, t in zip(ids, W.column(batch, "text")):
                if (t := t.as_py()) is not None:
                    rows += [(doc, *f) for f in scan(t)]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, k) for c, k in zip(columns[1:], _KINDS))], ["doc_id", "start", "end", "license", "rule", "priority"])

    return run


def detections(docs: DataFrame, text: str = license_rules.TEXT) -> DataFrame:
    """``(doc_id, start, end, license, rule, priority)``: one row per detection, places in characters.

    Null and empty texts have no detection; a null doc_id stays null; repeated rows are scanned each by
    itself; an empty table gives an empty one; only doc_id and text are read, whole. No shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scanned(text), _SCHEMA)
