"""Token counts by a two-tier lookup in the mappers.

Tier one is a compact table of the corpus' frequent pre-tokens and their lengths in tokens, broadcast
once. What is frequent is counted map-side: each task keeps counters for the pieces of its texts, and
hands on no more than SUMMARY of them, packed in one row; these rows are merged in a tree, by tasks
that keep as many. So what is shuffled is a summary of fixed size a task, and never a pre-token of a
text. Tier two encodes a miss and remembers it in a bounded cache of the worker.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import batches as B
from kinfold.llm import words as W

#: The pattern that splits text before the merges (the one published with byte-level BPE).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 300_000
LONG = 64
#: Entries of the table, counters that a task hands on, and summaries that are merged into one at a time.
TABLE = 65_536
SUMMARY = 4 * TABLE
FAN = 8


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encoding(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


#: Classes of bytes for rough pieces: 0 space, 1 letters and bytes of longer characters, 2 digits, 3 others.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[list(W.SPACE)] = 0


def rough_pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of bytes of one class, each with the single space before it: nearly the pre-tokens."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[buf]
    cut = np.ones(len(buf) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets[:-1]] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    word = kind[starts] != 0
    starts, ends = starts[word], ends[word]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    spaced = (starts > 0) & (buf[starts - 1] == 32) & ~first[starts]
    return starts - spaced, ends


def _merged(keys: list[np.ndarray], counts: list[np.ndarray], texts: list[np.ndarray], most: int):
    """Summed counts of equal keys with a text of each, the ``most`` largest of them (by count, then key)."""
    k, c, t = (np.concatenate(x) for x in (keys, counts, texts))
    k, first, of = np.unique(k, return_index=True, return_inverse=True)
    c = np.bincount(of, weights=c, minlength=len(k)).astype(np.int64)
    keep = np.sort(np.lexsort((k, -c))[:most])
    return [k[keep]], [c[keep]], [t[first][keep]]


def _packed(keys: np.ndarray, counts: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
    data = b"".join([np.int64(len(keys)).tobytes(), keys.tobytes(), counts.tobytes(), b"\xff".join(texts.tolist())])
    return pa.RecordBatch.from_arrays([pa.array([zlib.compress(data, 1)], pa.binary())], ["summary"])


def _unpacked(summary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(summary)
    n = int.from_bytes(data[:8], "little")
    texts = np.empty(n, dtype=object)
    texts[:] = data[8 + 16 * n :].split(b"\xff") if n else []
    return np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n), texts


def _summed(most: int):
    """One summary of a task's texts: its pieces of up to LONG bytes and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list, list, list] = ([], [], [])
        for big in batches:
            for batch in W.slices(big, "text", 8 << 20):
                buf, offsets = W.text_buffers(batch.column(0))
                starts, ends = rough_pieces(buf, offsets)
                short = ends - starts <= LONG
                starts, ends = starts[short], ends[short]
                k, first, n = np.unique(W.word_hashes(buf, starts, ends), return_index=True, return_counts=True)
                top = np.sort(np.argsort(-n, kind="stable")[:most])
                data, texts = buf.tobytes(), np.empty(len(top), dtype=object)
                texts[:] = [data[a:b] for a, b in zip(starts[first[top]].tolist(), ends[first[top]].tolist())]
                for x, new in zip(kept, (k[top], n[top], texts)):
                    x.append(new)
                if sum(map(len, kept[0])) > 4 * most:
                    kept = _merged(*kept, most)
        if kept[0]:
            yield _packed(*(x[0] for x in _merged(*kept, most)))

    return run


def _joined(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for row in batch.column(0):
                for x, new in zip(kept, _unpacked(row.as_py())):
                    x.append(new)
                if len(kept[0]) > 2:
                    kept = _merged(*kept, most)
        if kept[0]:
            yield _packed(*(x[0] for x in _merged(*kept, most)))

    return run


def frequent(docs: DataFrame, path: str, pattern: str = PATTERN, most: int = TABLE, summary: int = SUMMARY) -> tuple[bytes, bytes]:
    """The table: the corpus' frequent pre-tokens, and the length of each in tokens.

    Texts are in one block (separated by the byte 0xFF, which no UTF-8 text has) beside four bytes per
    length: less than (LONG + 5) * ``most`` bytes, whatever the size of the corpus.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(B.released(_summed(summary)), "summary binary")
    n = rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        rows = rows.repartition(n).mapInArrow(B.released(_joined(summary)), "summary binary")
    found = rows.collect()
    if not found:
        return b"", b""
    _, counts, texts = _unpacked(found[0].summary)
    split, encode = regex.compile(pattern), encoding(path, pattern).encode_ordinary
    words, lengths = [], []
    for piece in texts[np.argsort(-counts, kind="stable")].tolist():
        text = piece.decode("utf-8", "replace")
        if text.encode() == piece and split.findall(text) == [text]:
            words.append(piece)
            lengths.append(len(encode(text)))
            if len(words) == most:
                break
    return b"\xff".join(words), np.array(lengths, dtype=np.uint32).tobytes()


class Lengths(dict):
    """pre-token -> tokens. The dict itself is tier one; ``__missing__`` is tier two."""

    def __init__(self, table: tuple[bytes, bytes], encode, most: int):
        words = table[0].split(b"\xff") if table[1] else []
        super().__init__((w.decode("utf-8"), n) for w, n in zip(words, np.frombuffer(table[1], np.uint32).tolist()))
        self.encode, self.most, self.cache = encode, most, {}

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.encode(piece))
            if len(piece) <= LONG:  # long ones hardly come back, and would fill the memory
                if len(self.cache) >= self.most:
                    self.cache.clear()
                self.cache[piece] = n
        return n


#: By name of a table, the splitter and the lengths of a worker process, which may run many tasks.
_MADE: dict[str, tuple] = {}


def _counted(table, name: str, path: str, pattern: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = regex.compile(pattern).findall, Lengths(table.value, encoding(path, pattern).encode_ordinary, most)
        find, lengths = _MADE[name]
        get = lengths.__getitem__
        for batch in batches:
            tokens, pieces = [], []
            for t in W.column(batch, "text"):
                text = t.as_py()
                if text is None:
                    tokens.append(None)
                    pieces.append(None)
                    continue
                found = find(text)
                tokens.append(sum(map(get, found)))
                pieces.append(len(found))
            yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, pattern: str = PATTERN, cache: int = CACHE, most: int = TABLE) -> DataFrame:
    """One row per input row: ``doc_id, n_pretokens, n_tokens`` of its whole text, as the tokenizer itself counts them.

    ``vocabulary`` is the path of a rank file that driver and workers can read. A null text has null
    counts, an empty one zeros; a null doc_id stays null; repeated rows are counted each by itself;
    an empty table gives an empty table. Only ``doc_id`` and ``text`` are read, whatever else the
    table has. Strings of special tokens count as ordinary text. ``most`` bounds the broadcast table.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, vocabulary, pattern, most))
    name = uuid.uuid4().hex
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted(table, name, vocabulary, pattern, cache), "doc_id long, n_pretokens long, n_tokens long")
