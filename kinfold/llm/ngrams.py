"""Interpolated modified Kneser-Ney models of the corpus, and perplexities under them.

``perplexities`` counts word trigrams of all of the corpus, so the model grows with the text. Words
are maximal runs that are not white space, known by a 64-bit hash of which the last byte is the
length (56 bits tell words of one length apart); n-grams by a hash of which a shard compares 48 bits. Below single words, a word
is spelled from bytes that are equally likely, so no word is unknown. Each order is a few shuffles, one after the other:
tasks count in place, a shard has all n-grams of its contexts, sums their counts, stores them as
sorted hash arrays and hands what continues to the order below. There are as many shards as the text
needs. A scorer opens a few one after the other; of more than DIRECT, texts ask the shards for the counts of
their n-grams and get them back, through a shuffle each way, so that a shard is read once and not once for
every few texts. White space between words isn't modelled.

``train`` and ``score`` have the same model over bytes (order 6), which is small at any size of the
corpus: for held-out text of any script where that is enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import batches as B
from kinfold.llm import words as W
from kinfold.operators.blocks import partitions
from kinfold.plans.shared import remove, scratch, written

ORDER = 6
#: Bytes that UTF-8 never has.
START, STOP = 0xFE, 0xFF
SHARD_BITS = 3
_KEEP = 1 << 22
#: Order of the model of words, bytes of text to a shard of it, and jobs in which an order is counted.
WORDS = 3
WORD_SHARD = 8 << 20
PARTS = 4
#: N-grams that a task gathers before it counts them.
COUNTED = 1 << 19
#: Shards that a scorer opens itself; bytes of text that ask together, and parts of the texts that ask one after the other.
DIRECT = 384
ASKING = 8 << 20
TURNS = 4
WORD_START, WORD_STOP = np.uint64(0), np.uint64(1 << 8)
#: Bytes that a word can have, and its end.
BYTES_AND_END = 256 - len(W.SPACE) + 1


def windows(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end in each byte of each text and in its stop symbol, and the row of each.

    Rows that are null have none.
    """
    buf, offsets = W.text_buffers(column)
    n = np.diff(offsets)
    rows = np.flatnonzero(B.not_null(column))
    sizes = n[rows] + order
    ends = np.cumsum(sizes)
    flat = np.full(int(ends[-1]) if len(ends) else 0, START, dtype=np.uint8)
    begin = ends - sizes
    row_of = np.repeat(np.arange(len(rows)), n[rows])
    if len(buf):
        flat[np.arange(len(row_of)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows]) + begin[row_of] + order - 1] = buf
    flat[ends - 1] = STOP
    packed = np.zeros(max(len(flat) - order + 1, 0), dtype=np.uint64)
    for j in range(order):
        packed <<= np.uint64(8)
        packed |= flat[j : j + len(packed)]
    keep = np.ones(len(packed), bool)
    # the windows that reach over the end of a text into the next
    for j in range(order - 1):
        at = ends[:-1] - 1 - j
        keep[at] = False
    return packed[keep], np.repeat(rows, n[rows] + 1)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        waiting = 0
        for big in batches:
            for batch in W.slices(big, "text", 4 << 20):
                k, c = np.unique(windows(W.column(batch, "text"), order)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                waiting += len(k)
                if waiting > _KEEP:
                    k, c = _added(keys, counts)
                    keys, counts, waiting = [k], [c], len(k)
                    if waiting > _KEEP // 2:
                        yield from B.rows({"gram": k.view(np.int64), "n": c}, {"gram": pa.int64(), "n": pa.int64()})
                        keys, counts, waiting = [], [], 0
        if keys:
            k, c = _added(keys, counts)
            yield from B.rows({"gram": k.view(np.int64), "n": c}, {"gram": pa.int64(), "n": pa.int64()})

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """For counts of 1, 2 and more, from the numbers of n-grams with counts 1 to 4 (Chen and Goodman).

    Where these numbers give no estimate (none of a count, or one outside (0, count)), it is half the
    least it may be cut by: 0.5, 1 or 1.5.
    """
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0
        out.append(d if 0 < d < k else 0.5 * k)
    return out[0], out[1], out[2]


def _discounted(counts: DataFrame, d: tuple[float, float, float]) -> DataFrame:
    """Context, symbol's share and the context's back-off weight for (gram, n)."""
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    rows = counts.select("gram", "n", F.shiftright("gram", 8).alias("context"), cut.alias("cut"))
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spare")).select("context", "total", (F.col("spare") / F.col("total")).alias("weight"))
    return rows.join(contexts, "context").select("gram", "context", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share"), "weight")


def _stored(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = B.whole(batches)
        if table is None:
            return
        filesystem, base = fs.FileSystem.from_uri(folder)
        hashes = W.mix(table.column("gram").to_numpy().view(np.uint64))
        value = np.log(table.column("value").to_numpy())
        order = np.argsort(hashes)
        hashes, value = hashes[order], value[order]
        shard = (hashes >> np.uint64(64 - SHARD_BITS)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange((1 << SHARD_BITS) + 1))
        for s in range(1 << SHARD_BITS):
            if cuts[s] < cuts[s + 1]:
                part = slice(cuts[s], cuts[s + 1])
                with filesystem.open_output_stream(f"{base}/{name}-{s}") as sink:  # a repeated task writes the same bytes
                    sink.write(hashes[part].tobytes() + value[part].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([s], pa.int32()), pa.array([cuts[s + 1] - cuts[s]], pa.int64())], ["name", "shard", "n"])

    return run


def train(docs: DataFrame, order: int = ORDER) -> tuple[str, dict[tuple[str, int], int]]:
    """Model of the whole ``text`` column: its folder and the sizes of its files (at most 2 * order * 2**SHARD_BITS)."""
    if not 1 < order < 8:
        raise ValueError("1 < order < 8")
    spark = docs.sparkSession
    folder = scratch(spark, "ngrams")
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    counts = {order: written(texts.mapInArrow(_counted(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), f"{folder}/counts-{order}")}
    for k in range(order - 1, 0, -1):
        mask = (1 << 8 * k) - 1
        counts[k] = written(counts[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("n")), f"{folder}/counts-{k}")
    files: dict[tuple[str, int], int] = {}

    def store(rows: DataFrame, name: str) -> None:
        # one shard is one group of rows, so one task writes each file
        for r in rows.mapInArrow(_hashed, "gram long, shard int, value double").repartition(1 << SHARD_BITS, "shard").sortWithinPartitions("shard").mapInArrow(_by_shard(folder, name), "name string, shard int, n long").collect():
            files[r.name, r.shard] = r.n

    lower = None
    for k in range(1, order + 1):
        found = counts[k].agg(*(F.count(F.when(F.col("n") == c, 1)).alias(f"n{c}") for c in (1, 2, 3, 4))).first()
        rows = _discounted(counts[k], discounts(list(found)))
        if k == 1:
            full = rows.select("gram", (F.col("share") + F.col("weight") / 256).alias("value"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            below = lower.select(F.col("gram").alias("suffix"), F.col("value").alias("below"))
            full = rows.withColumn("suffix", suffix).join(below, "suffix").select("gram", (F.col("share") + F.col("weight") * F.col("below")).alias("value"))
            store(rows.select(F.col("context").alias("gram"), F.col("weight").alias("value")).distinct(), f"weight-{k}")
        lower = written(full, f"{folder}/p-{k}")
        store(lower, f"p-{k}")
    return folder, files


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = W.mix(W.column(b, "gram").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array((hashes >> np.uint64(64 - SHARD_BITS)).astype(np.int32)), b.column(1)], ["gram", "shard", "value"])


def _by_shard(folder: str, name: str):
    store = _stored(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.grouped(batches, "shard"):
            yield from store(iter(table.to_batches()))

    return run


class Shard:
    """A sorted hash array mapped into memory, with an index of its leading bits."""

    def __init__(self, folder: str, name: str, shard: int, n: int):
        filesystem, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{name}-{shard}"
        if isinstance(filesystem, fs.LocalFileSystem):
            raw = np.memmap(path, dtype=np.uint8, mode="r")
        else:
            with filesystem.open_input_stream(path) as source:
                raw = np.frombuffer(source.read(), dtype=np.uint8)
        self.hashes, self.values, self.n = raw[: 8 * n].view(np.uint64), raw[8 * n : 16 * n].view(np.float64), n
        self.bits = min(20, max(n - 1, 1).bit_length())
        self.starts = np.searchsorted(self.hashes << np.uint64(SHARD_BITS), np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        out = np.full(len(hashes), np.nan)
        at = self.starts[((hashes << np.uint64(SHARD_BITS)) >> np.uint64(64 - self.bits)).astype(np.int64)]
        left = np.arange(len(hashes))
        while len(left):
            inside = at < self.n
            left, at = left[inside], at[inside]
            here, wanted = self.hashes[at], hashes[left]
            same = here == wanted
            out[left[same]] = self.values[at[same]]
            on = here < wanted
            left, at = left[on], at[on] + 1
        return out


class Model:
    """What a worker sees of a trained model."""

    def __init__(self, folder: str, files: dict[tuple[str, int], int], order: int):
        self.order = order
        self.shards = {k: Shard(folder, *k, n) for k, n in files.items()}
        # p of a symbol that was never seen: the back-off of the empty context, spread evenly
        seen = [np.exp(s.values).sum() for (name, _), s in self.shards.items() if name == "p-1"]
        known = sum(s.n for (name, _), s in self.shards.items() if name == "p-1")
        self.rest = np.log(max(1 - sum(seen), 1e-12) / (256 - known)) if known < 256 else -np.log(256)

    def _find(self, name: str, grams: np.ndarray) -> np.ndarray:
        hashes = W.mix(grams)
        shard = (hashes >> np.uint64(64 - SHARD_BITS)).astype(np.int64)
        out = np.full(len(grams), np.nan)
        for s in range(1 << SHARD_BITS):
            if (name, s) in self.shards:
                at = np.flatnonzero(shard == s)
                out[at] = self.shards[name, s].find(hashes[at])
        return out

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """ln p of the last symbol of each packed n-gram after the others."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for k in range(self.order, 0, -1):
            part = grams[left] & np.uint64((1 << 8 * k) - 1)
            found = self._find(f"p-{k}", part)
            hit = ~np.isnan(found)
            out[left[hit]] += found[hit]
            left, part = left[~hit], part[~hit]
            if not len(left):
                return out
            if k > 1:
                weight = self._find(f"weight-{k}", part >> np.uint64(8))
                out[left] += np.where(np.isnan(weight), 0.0, weight)
        out[left] += self.rest
        return out


_OPEN: dict[str, Model] = {}


def _scored(folder: str, files: dict, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _OPEN:
            _OPEN.clear()
            _OPEN[folder] = Model(folder, files, order)
        model = _OPEN[folder]
        for big in batches:
            for batch in W.slices(big, "text", 4 << 20):
                grams, row = windows(W.column(batch, "text"), order)
                different, at = np.unique(grams, return_inverse=True)
                total = np.bincount(row, weights=model.log_p(different)[at], minlength=batch.num_rows)
                size = np.bincount(row, minlength=batch.num_rows)
                none = ~B.not_null(W.column(batch, "text"))
                with np.errstate(invalid="ignore", divide="ignore"):
                    perplexity = np.exp(-total / size)
                yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), pa.array(size, pa.int64(), mask=none), pa.array(total, mask=none), pa.array(perplexity, mask=none)], ["doc_id", "n_symbols", "log_prob", "perplexity"])

    return run


def score(docs: DataFrame, model: tuple[str, dict[tuple[str, int], int]], order: int = ORDER) -> DataFrame:
    """``(doc_id, n_symbols, log_prob, perplexity)`` of each row under a trained model.

    ``n_symbols`` counts the bytes and the stop symbol. A null text has nulls, an empty one is its stop
    symbol; a null doc_id stays null; repeated rows are scored each by itself; an empty table gives an
    empty one; only doc_id and text are read, whole.
    """
    folder, files = model
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(folder, files, order), "doc_id long, n_symbols long, log_prob double, perplexity double")


# word n-grams


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; characters from U+3000 on (scripts without spaces) are words by themselves."""
    starts, ends, doc = W.word_spans(buf, offsets)
    lead = np.flatnonzero(buf >= 0xE3)
    if not len(lead):
        return starts, ends, doc
    cuts = np.union1d(lead, lead + 3 + (buf[lead] >= 0xF0))
    of = np.searchsorted(starts, cuts, side="right") - 1
    inside = (of >= 0) & (cuts < ends[of])
    every = np.union1d(starts, cuts[inside])
    of = np.searchsorted(starts, every, side="right") - 1
    return every, np.minimum(ends[of], np.append(every[1:], len(buf))), doc[of]


def _flat_words(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, each with its starts and stop; where the n-gram that ends in each word or stop begins, and its row."""
    buf, offsets = W.text_buffers(column)
    starts, ends, doc = spans(buf, offsets)
    words = (W.word_hashes(buf, starts, ends) & ~np.uint64(255)) | np.minimum(ends - starts, 255).astype(np.uint64)
    rows = np.flatnonzero(B.not_null(column))
    n = np.bincount(doc, minlength=len(column))[rows] if len(doc) else np.zeros(len(rows), np.int64)
    last = np.cumsum(n + order)
    flat = np.full(int(last[-1]) if len(last) else 0, WORD_START, dtype=np.uint64)
    begin = last - n - order
    flat[np.arange(len(words)) + np.repeat(begin + order - 1 - (np.cumsum(n) - n), n)] = words
    flat[last - 1] = WORD_STOP
    at = np.arange(n.sum() + len(n)) + np.repeat(begin - (np.cumsum(n + 1) - n - 1), n + 1)
    return flat, at, np.repeat(rows, n + 1)


def word_windows(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words (a hash, its last byte the word's length) of the n-grams that end in each word and stop, one array a place, and their rows.

    Rows that are null have none.
    """
    flat, at, rows = _flat_words(column, order)
    return [flat[at + j] for j in range(order)], rows


def chained(columns: list[np.ndarray], n: int) -> np.ndarray:
    """64-bit hash of n words in order."""
    out = np.full(n, len(columns), dtype=np.uint64)
    for c in columns:
        out = W.mix(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out


def _shard_of(context: list[np.ndarray], shards: int) -> np.ndarray:
    """By context, so that a context's n-grams are together; words by themselves."""
    return (chained(context, len(context[0])) % np.uint64(shards)).astype(np.int64)


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different n-grams, their counts and hashes, by hash."""
    grams = chained(columns, len(n))
    order = np.argsort(grams)
    grams = grams[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return [c[order[first]] for c in columns], np.add.reduceat(n[order], first) if len(first) else n, grams[first]


def _encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in the order in which they come, and which of them each is; by a hash table, as sorting takes longer."""
    found = pa.array(x).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The lower bytes of int64 by bytes of equal weight, which compress well."""
    return np.ascontiguousarray(x.astype(np.int64 if width == 8 else np.int32).view(np.uint8).reshape(-1, width).T).tobytes()


def _key(places: np.ndarray, bits: int) -> np.ndarray:
    """The places of each n-gram as one number."""
    key = places[0].astype(np.uint64)
    for c in places[1:]:
        key <<= np.uint64(bits)
        key |= c.astype(np.uint64)
    return key


def _packed(columns: list[np.ndarray], n: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard with its n-grams and counts: a list of words, and the n-grams as places in it, in order."""
    words, places = _encoded(np.concatenate(columns))
    places = places.reshape(len(columns), -1)
    bits = len(words).bit_length()
    order = np.argsort(_key(places, bits)) if bits * len(columns) < 64 else np.lexsort(places[::-1])
    yield from _pieces(words, places[:, order], n[order], shards)


def _packed_once(columns: list[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """As ``_packed``, of n-grams that repeat and are counted here."""
    words, places = _encoded(np.concatenate(columns))
    bits = len(words).bit_length()
    if bits * len(columns) >= 64:
        columns, n, _ = _summed(columns, np.ones(len(columns[0]), np.int64))
        yield from _packed(columns, n, shards)
        return
    key = _key(places.reshape(len(columns), -1), bits)
    del places
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    n, key = np.diff(first, append=len(key)), key[first]
    mask = np.uint64((1 << bits) - 1)
    places = np.stack([((key >> np.uint64(bits * j)) & mask).astype(np.int32) for j in range(len(columns) - 1, -1, -1)])
    del key, first
    yield from _pieces(words, places, n, shards)


def _pieces(words: np.ndarray, places: np.ndarray, n: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``_packed``, out of different n-grams in order."""
    shard = _shard_of([words[p] for p in places[: max(1, len(places) - 1)]], shards)
    by = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    places, n, shard = places[:, by], n[by], shard[by]
    cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else [0]
    pack = zstandard.ZstdCompressor(level=1).compress
    for a, b in zip(cuts, cuts[1:]):
        part = places[:, a:b]
        if part.size * 8 < len(words):
            used, own = np.unique(part, return_inverse=True)
            own = own.reshape(part.shape)
        else:
            seen = np.zeros(len(words), bool)
            seen[part] = True
            used, own = np.flatnonzero(seen), (np.cumsum(seen) - 1)[part]
        width = 4 if max(len(used), int(n[a:b].max())) < 1 << 31 else 8
        data = [np.array([len(used), width], np.int64).tobytes(), words[used].tobytes(), _planes(np.diff(own[0], prepend=0), width), *(_planes(x, width) for x in own[1:]), _planes(n[a:b], width)]
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int64()), pa.array([pack(b"".join(data))], pa.binary())], ["shard", "data"])


def _unpacked(data: bytes, order: int) -> np.ndarray:
    """Words of each place and, last, the counts (int64 as uint64)."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    used, width = raw[:16].view(np.int64).tolist()
    words = raw[16 : 16 + 8 * used].view(np.uint64)
    rows = np.ascontiguousarray(raw[16 + 8 * used :].reshape(order + 1, width, -1).transpose(0, 2, 1)).view(np.int64 if width == 8 else np.int32)[:, :, 0]
    return np.stack([words[np.cumsum(rows[0])], *(words[r] for r in rows[1:-1]), rows[-1].astype(np.uint64)])


def _lead(n: int) -> int:
    """Bits of a hash that the index of n entries takes; 32 more are compared."""
    return 16 if n >= 1 << 16 else 8


def _index(keys: np.ndarray) -> bytes:
    """Ascending hashes: where each of their leading bits begin, and the next 32 bits of each."""
    lead = np.uint64(_lead(len(keys)))
    begin = np.searchsorted(keys, np.arange(1 << int(lead), dtype=np.uint64) << (np.uint64(64) - lead)).astype(np.uint32)
    return begin.tobytes() + np.uint32(len(keys)).tobytes() + ((keys << lead) >> np.uint64(32)).astype(np.uint32).tobytes()


def _index_size(n: int) -> int:
    return 4 * ((1 << _lead(n)) + 1 + n)


def _stored_rows(keys: np.ndarray, values: list[np.ndarray]) -> bytes:
    """Ascending hashes and what they have, in two tables: hashes whose first value is 1, and hashes with a byte a value.

    Values from 255 are by themselves at the end.
    """
    one = values[0] == 1
    rest = [v[~one] for v in values]
    parts = [np.array([one.sum(), len(rest[0])], np.int64).tobytes(), _index(keys[one]), _index(keys[~one])]
    parts += [np.minimum(v, 255).astype(np.uint8).tobytes() for v in rest]
    large = [np.flatnonzero(v >= 255) for v in rest]
    for v, at in zip(rest, large):
        parts += [at.astype(np.int64).tobytes(), v[at].astype(np.int64).tobytes()]
    return b"".join([*parts, np.array([len(at) for at in large], np.int64).tobytes()])


def _places(raw: np.ndarray, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in an index, and whether it is there."""
    lead = np.uint64(_lead(n))
    begin = raw[: 4 * ((1 << int(lead)) + 1)].view(np.uint32)
    low = raw[begin.nbytes : begin.nbytes + 4 * n].view(np.uint32)
    first = (wanted >> (np.uint64(64) - lead)).astype(np.int32)
    want = ((wanted << lead) >> np.uint64(32)).astype(np.uint32)
    if n < 1 << 30:
        begin = begin.view(np.int32)
    at, stop = begin.take(first, mode="clip"), begin[1:].take(first, mode="clip")
    if not n or not len(wanted):
        return at.astype(np.int64), np.zeros(len(wanted), bool)
    # all entries of a place's bucket before ``at`` are less; steps of halving size, with no branches
    step = 1 << max(int((stop - at).max()).bit_length() - 1, 0)
    while step:
        on = at + at.dtype.type(step)
        less = low.take(on - at.dtype.type(1), mode="clip") < want
        less &= on <= stop
        at += less * at.dtype.type(step)
        step >>= 1
    hit = at < stop
    hit &= low.take(at, mode="clip") == want
    return at, hit


def _found_rows(raw: np.ndarray, width: int, wanted: np.ndarray) -> np.ndarray:
    """Values of each hash in what ``_stored_rows`` wrote, 0 where there is none; a hash whose first value is 1 has 1 and 1, then zeros."""
    ones, n = raw[:16].view(np.int64).tolist()
    values = np.zeros((width, len(wanted)), np.int64)
    at, hit = _places(raw[16:], ones, wanted)
    values[:2, hit] = 1
    start = 16 + _index_size(ones)
    left = np.flatnonzero(~hit)
    at, hit = _places(raw[start:], n, wanted[left])
    at, left = at[hit], left[hit]
    start += _index_size(n)
    sizes = np.array(raw[len(raw) - 8 * width :]).view(np.int64).tolist()
    rest = start + n * width
    for j in range(width):
        value = raw[start + n * j : start + n * (j + 1)][at].astype(np.int64)
        m = sizes[j]
        if m:
            where, what = (np.array(raw[rest + 8 * m * x : rest + 8 * m * (x + 1)]).view(np.int64) for x in (0, 1))
            big = np.flatnonzero(value == 255)
            value[big] = what[np.searchsorted(where, at[big])]
        rest += 16 * m
        values[j, left] = value
    return values


def _word_counts(order: int, shards: int, part: int, parts: int):
    """Counts of the n-grams whose shards are a part of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        waiting = 0
        for big in batches:
            for batch in W.slices(big, "text", ASKING):
                flat, at, _ = _flat_words(W.column(batch, "text"), order)
                context = max(1, order - 1)
                shard = _shard_of([flat[j : len(flat) - context + 1 + j] for j in range(context)], shards)
                at = at[(shard % parts == part)[at]]
                kept.append([flat[at + j] for j in range(order)])
                waiting += len(at)
                del flat, at, shard
                if waiting >= COUNTED:
                    columns, kept, waiting = [np.concatenate(c) for c in zip(*kept)], [], 0
                    yield from _packed_once(columns, shards)
                    del columns
        if waiting:
            yield from _packed_once([np.concatenate(c) for c in zip(*kept)], shards)

    return run


_LEVEL = "shard long, data binary, stats array<long>"


def _level(folder: str, order: int, shards: int):
    """Counts of each shard's n-grams and contexts, in files; rows for the lower order, and rows of figures (shard -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        for table in B.grouped(batches, "shard"):
            shard = table.column("shard")[0].as_py()
            whole = np.concatenate([_unpacked(d.as_py(), order) for d in table.column("data")], axis=1)
            columns, n, grams = _summed(list(whole[:-1]), whole[-1].view(np.int64))
            del whole
            # a repeated task writes the same bytes
            with filesystem.open_output_stream(f"{base}/grams-{order}-{shard}") as sink:
                sink.write(_stored_rows(grams, [n]))
            if order > 1:
                contexts, of = np.unique(chained(columns[:-1], len(n)), return_inverse=True)
                stats = [np.bincount(of, weights=w, minlength=len(contexts)).astype(np.int64) for w in (n, n == 1, n == 2, n > 2)]
                with filesystem.open_output_stream(f"{base}/contexts-{order}-{shard}") as sink:
                    sink.write(_stored_rows(contexts, stats))
                del contexts, of, stats
            figures = [len(grams), *((n == c).sum() for c in (1, 2, 3, 4)), n.sum()]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([None], pa.binary()), pa.array([[int(x) for x in figures]], pa.list_(pa.int64()))], ["shard", "data", "stats"])
            if order > 1:
                for b in _packed_once(columns[1:], shards):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.list_(pa.int64()))], ["shard", "data", "stats"])

    return run


def _level_rows(spark: SparkSession, uri: str, part: int) -> DataFrame:
    """What the jobs of an order have for a part of the shards; part -1 has the figures."""
    return spark.read.schema(f"{_LEVEL}, job int, part int").parquet(uri).where(f"part = {part}")


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, a job's shuffle files go when it has written its table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def train_words(docs: DataFrame, order: int = WORDS, shard_bytes: int = WORD_SHARD, parts: int = PARTS) -> dict:
    """Model of the words of the whole ``text`` column: what a scorer needs to open it.

    Each order is counted in ``parts`` jobs, each for a part of the shards, so that no more than a part of
    the counts is in a shuffle at a time; what a job has counted of the order above goes when its own table
    is written. The shards grow in number with the text, not in size.
    """
    spark = docs.sparkSession
    B.small(spark)
    folder = scratch(spark, "words")
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-size // shard_bytes))
    tasks = min(shards, partitions(docs))
    cut, figures = {}, {}
    with _freed(spark):
        for k in range(order, 0, -1):
            level, above = f"{folder}/level-{k}", f"{folder}/level-{k + 1}"
            for part in range(parts):
                if k == order:
                    rows = texts.mapInArrow(B.released(_word_counts(order, shards, part, parts)), "shard long, data binary")
                else:
                    rows = _level_rows(spark, above, part).select("shard", "data")
                counted = rows.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(B.released(_level(folder, k, shards)), _LEVEL)
                counted.withColumn("part", F.col("shard") % parts).write.mode("overwrite").partitionBy("part").parquet(f"{level}/job={part}")
                for job in range(parts if k < order else 0):
                    remove(f"{above}/job={job}/part={part}")
            row = _level_rows(spark, level, -1).agg(*(F.sum(F.col("stats")[i]) for i in range(6))).first()
            figures[k] = [x or 0 for x in row]
            cut[k] = discounts(figures[k][1:5])
            if k < order:
                remove(above)
        remove(level)
    n, once, twice, *_, total = figures[1]
    spare = once * cut[1][0] + twice * cut[1][1] + (n - once - twice) * cut[1][2]
    return {"folder": folder, "order": order, "shards": shards, "sizes": {k: v[0] for k, v in figures.items()}, "discounts": cut, "total": total, "weight": spare / total if total else 1.0}


class WordModel:
    """What a worker sees of a model of words: one shard at a time."""

    def __init__(self, model: dict):
        self.__dict__.update(model)
        self.filesystem, self.base = fs.FileSystem.from_uri(self.folder)

    def rows(self, name: str, width: int, wanted: np.ndarray) -> np.ndarray:
        """Values of each hash, 0 where there is none."""
        path = f"{self.base}/{name}"
        try:
            if isinstance(self.filesystem, fs.LocalFileSystem):
                return _found_rows(np.asarray(np.memmap(path, dtype=np.uint8, mode="r")), width, wanted)
            with self.filesystem.open_input_file(path) as source:
                return _found_rows(np.frombuffer(source.read(), dtype=np.uint8), width, wanted)
        except FileNotFoundError:  # a shard without an n-gram
            return np.zeros((width, len(wanted)), np.int64)

    def counts(self, k: int, part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Count of each n-gram of order k, and the four of its context, from all shards."""
        grams = chained(part, len(part[0]))
        if k == 1:
            return self.of_words("grams-1", 1, grams)[0], np.zeros((4, 1), np.int64)
        contexts = chained(part[:-1], len(grams))
        shard = contexts % np.uint64(self.shards)
        n = self.found(f"grams-{k}", 1, grams, shard)[0]
        return n, self.of_words("contexts-2", 4, contexts) if k == 2 else self.found(f"contexts-{k}", 4, contexts, shard)

    def of_words(self, name: str, width: int, words: np.ndarray) -> np.ndarray:
        """Values of single words, each of which is asked for once, as they repeat; n-grams of more words mostly don't."""
        different, of = _encoded(words)
        return self.found(name, width, different, different % np.uint64(self.shards))[:, of]

    def found(self, name: str, width: int, wanted: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Values of each hash in its shard, which is asked in the order of its index."""
        out = np.zeros((width, len(wanted)), np.int64)
        order = np.argsort((wanted >> np.uint64(48)).astype(np.uint16), kind="stable")
        shard = shard.astype(np.uint16 if self.shards < 1 << 16 else np.int64)[order]
        by = np.argsort(shard, kind="stable")
        order, shard = order[by], shard[by].astype(np.int64)
        wanted = wanted[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            values = self.rows(f"{name}-{shard[a]}", width, wanted[a:b])
            for row, value in zip(out, values):
                row[order[a:b]] = value
        return out

    def p(self, columns: list[np.ndarray], counts: Callable | None = None) -> np.ndarray:
        """Of the last word of each n-gram after the others, interpolated from the bytes of the word up."""
        out = float(BYTES_AND_END) ** -((columns[-1] & np.uint64(255)).astype(np.float64) + 1)
        for k in range(1, self.order + 1):
            d1, d2, d3 = self.discounts[k]
            n, (total, once, twice, more) = (counts or self.counts)(k, columns[self.order - k :])
            share = n - np.array([0.0, d1, d2, d3])[np.minimum(n, 3)]
            if k == 1:
                out = share / max(self.total, 1) + self.weight * out
            else:
                out = np.where(total > 0, (share + (d1 * once + d2 * twice + d3 * more) * out) / np.maximum(total, 1), out)
        return out


def _by_shards(hashes: np.ndarray, shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in the order of their shards, where those of each shard begin, and the place of each."""
    order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return hashes[order], np.searchsorted(shard[order], np.arange(shards + 1)), place


def _different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values, ascending, where one of each is, and which of them each is."""
    order = np.argsort(x)
    new = np.append(True, np.diff(x[order]) != 0)[: len(x)]
    of = np.empty(len(x), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    return x[first], first, of


def _asked(columns: list[np.ndarray], shards: int) -> list[tuple]:
    """Of n-grams of one order the different ones and then their different contexts, each ``_by_shards`` with the places of all."""
    grams, first, of = _different(chained(columns, len(columns[0])))
    contexts = chained([c[first] for c in columns[:-1]], len(first)) if columns[1:] else grams
    there, starts, place = _by_shards(grams, contexts % np.uint64(shards), shards)
    out = [(there, starts, place[of])]
    if columns[1:]:
        different, _, context_of = _different(contexts)
        there, starts, place = _by_shards(different, different % np.uint64(shards), shards)
        out.append((there, starts, place[context_of][of]))
    return out


def _files(order: int) -> list[tuple[str, int]]:
    """Names and widths of a shard's tables, as ``_asked`` has them for the orders from 1."""
    return [x for k in range(1, order + 1) for x in [(f"grams-{k}", 1), (f"contexts-{k}", 4)][: 1 + (k > 1)]]


def _batch_name(text: pa.Array) -> str:
    """By content: the same texts ask the same."""
    buf, offsets = W.text_buffers(text)
    name = hashlib.blake2b(offsets.tobytes(), digest_size=16)
    name.update(np.ascontiguousarray(buf))
    name.update(B.not_null(text).tobytes())
    return name.hexdigest()


def _asks(model: dict):
    """For each shard the hashes that a few texts ask it for: 6 bytes of each, as the tables compare no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, shards = model["order"], model["shards"]
        for big in batches:
            for batch in W.slices(big, "text", ASKING):
                text = W.column(batch, "text")
                columns, _ = word_windows(text, order)
                asked = [(np.ascontiguousarray(there.view(np.uint8).reshape(-1, 8)[:, 2:]), starts) for k in range(1, order + 1) for there, starts, _ in _asked(columns[order - k :], shards)]
                sizes = np.stack([np.diff(starts) for _, starts in asked], axis=1).astype(np.int64)
                some = np.flatnonzero(sizes.any(axis=1))
                name = _batch_name(text)
                for i in range(0, len(some), 64):
                    part = some[i : i + 64]
                    data = [b"".join([sizes[s].tobytes(), *(h[starts[s] : starts[s + 1]].tobytes() for h, starts in asked)]) for s in part.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part, pa.int64()), pa.array(data, pa.binary())], ["batch", "shard", "data"])

    return run


def _answers(model: dict):
    """What each shard has of what it was asked for; it is read once for all who ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, files = WordModel(model), _files(model["order"])
        pack = zstandard.ZstdCompressor(level=1).compress
        for table in B.grouped(batches, "shard"):
            shard = table.column("shard")[0].as_py()
            raw = [np.frombuffer(d.as_buffer(), np.uint8) for d in table.column("data")]
            sizes = np.stack([r[: 8 * len(files)].view(np.int64) for r in raw])
            begin = 8 * len(files) + 6 * np.concatenate([np.zeros((len(raw), 1), np.int64), np.cumsum(sizes, axis=1)], axis=1)
            found = []
            for j, (name, width) in enumerate(files):
                wanted = np.zeros((int(sizes[:, j].sum()), 8), np.uint8)
                wanted[:, 2:] = np.concatenate([r[b[j] : b[j + 1]] for r, b in zip(raw, begin.tolist())]).reshape(-1, 6)
                different, of = np.unique(wanted.view(np.uint64)[:, 0], return_inverse=True)  # texts ask the same
                found.append(opened.rows(f"{name}-{shard}", width, different)[:, of])
            ends = np.cumsum(sizes, axis=0)
            for i, batch in enumerate(table.column("batch")):
                parts = [_planes(row) for j, rows in enumerate(found) for row in rows[:, ends[i, j] - sizes[i, j] : ends[i, j]]]
                yield pa.RecordBatch.from_arrays([pa.array([batch.as_py()]), pa.array([shard], pa.int64()), pa.array([pack(sizes[i].tobytes() + b"".join(parts))], pa.binary())], ["batch", "shard", "data"])

    return run


def _kept_answers(folder: str):
    """A file of the answers to each batch, by shard; rows come sorted by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        for table in B.grouped(batches, "batch"):
            name, data = table.column("batch")[0].as_py(), dict(zip(table.column("shard").to_pylist(), table.column("data").to_pylist()))  # batches of the same texts ask the same
            with filesystem.open_output_stream(f"{base}/{name}") as sink:  # a repeated task writes the same bytes
                sink.write(np.array([len(data), *map(len, data.values())], np.int64).tobytes() + b"".join(data.values()))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["batch"])

    return run


def _answered(raw: bytes, order: int) -> list[np.ndarray]:
    """Values of all that was asked, one array for each of ``_files``."""
    files, unpack = _files(order), zstandard.ZstdDecompressor().decompress
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw[8 : 8 * (n + 1)], np.int64))
    found: list[list[np.ndarray]] = [[] for _ in files]
    for a, b in zip([8 * (n + 1), *ends.tolist()], ends.tolist()):
        data = np.frombuffer(unpack(raw[a:b]), np.uint8)
        at = 8 * len(files)
        for x, (_, width), size in zip(found, files, data[:at].view(np.int64).tolist()):
            x.append(np.ascontiguousarray(data[at : at + 8 * size * width].reshape(width, 8, size).transpose(0, 2, 1)).view(np.int64)[:, :, 0])
            at += 8 * size * width
    return [np.concatenate(x, axis=1) for x in found]


def _told(found: list[np.ndarray], shards: int) -> Callable:
    """``WordModel.counts`` out of the answers, for the orders from 1."""
    rest = iter(found)

    def counts(k: int, part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        places = [at for *_, at in _asked(part, shards)]
        return next(rest)[0][places[0]], next(rest)[:, places[1]] if k > 1 else np.zeros((4, 1), np.int64)

    return counts


def _words_scored(model: dict, answers: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, order = WordModel(model), model["order"]
        filesystem, base = fs.FileSystem.from_uri(answers or model["folder"])
        for big in batches:
            for batch in W.slices(big, "text", ASKING):
                text = W.column(batch, "text")
                columns, row = word_windows(text, order)
                counts = None
                if answers:
                    try:
                        with filesystem.open_input_stream(f"{base}/{_batch_name(text)}") as source:
                            counts = _told(_answered(source.read(), order), model["shards"])
                    except FileNotFoundError:  # no text, or rows that came together otherwise when they asked
                        pass
                total = np.bincount(row, weights=np.log(opened.p(columns, counts)), minlength=batch.num_rows)
                size = np.diff(W.text_buffers(text)[1]) + 1
                none = ~B.not_null(text)
                yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), pa.array(size, pa.int64(), mask=none), pa.array(total, mask=none), pa.array(np.exp(-total / size), mask=none)], ["doc_id", "n_symbols", "log_prob", "perplexity"])

    return run


def score_words(docs: DataFrame, model: dict, turns: int = TURNS, direct: int = DIRECT) -> DataFrame:
    """As ``score``, under a model of words: ``log_prob`` is that of the words and the stop, ``n_symbols`` still bytes and stop.

    Up to ``direct`` shards are opened for every few texts. Beyond, the texts ask them in ``turns``, so that no
    more than a part of what they ask for is in a shuffle at a time; the scores are the same.
    """
    spark = docs.sparkSession
    B.small(spark)
    schema = "doc_id long, n_symbols long, log_prob double, perplexity double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model["shards"] <= direct:
        return rows.mapInArrow(B.released(_words_scored(model)), schema)
    folder = scratch(spark, "answers")
    tasks = min(model["shards"], partitions(docs))
    every = None
    with _freed(spark):
        for turn in range(turns):
            own = rows.where(F.pmod(F.xxhash64("text"), F.lit(turns)) == turn)
            answers = f"{folder}/{turn}"
            filesystem, path = fs.FileSystem.from_uri(answers)
            filesystem.create_dir(path)
            asks = own.mapInArrow(B.released(_asks(model)), "batch string, shard long, data binary").repartition(tasks, "shard").sortWithinPartitions("shard")
            found = asks.mapInArrow(B.released(_answers(model)), "batch string, shard long, data binary").repartition(tasks, "batch").sortWithinPartitions("batch", "shard")
            found.mapInArrow(B.released(_kept_answers(answers)), "batch string").write.mode("overwrite").parquet(f"{folder}/names-{turn}")
            scored = own.mapInArrow(B.released(_words_scored(model, answers)), schema)
            every = scored if every is None else every.union(scored)
    return every


def perplexities(docs: DataFrame, order: int = WORDS) -> DataFrame:
    """Trains on the words of the whole table and scores each of its rows; perplexity is by byte."""
    return score_words(docs, train_words(docs, order))
