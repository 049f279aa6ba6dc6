"""Suffix-array dedup: passages of LENGTH or more words that occur before, anywhere in the corpus.

A word position is repeated if it lies in a window of LENGTH words whose text has an earlier
occurrence (lower doc_id, then lower position). All occurrences of a window choose the same one of
its grams of GRAM words as anchor (the leftmost with the least hash), so what lies around equal
anchors can be compared apart from everything else:

1. every anchor's segment (the union of the windows that chose it) is reduced to hashes, and anchors
   meet by hash, equal segments of a slice of the input as one. Anchors that occur once are done: none
   of their windows is repeated. Of equal segments the first stands for all, the others are repeated
   as a whole. Segments that share the words on neither side of the anchor with another are done too;
2. the other segments around equal anchors form collections, whose Burrows-Wheeler transform and
   common prefixes are built column by column in files (see ``bwt``). Runs of common prefixes of LENGTH
   or more are repeated windows; all of a run but the first occurrence are marked;
3. marks are merged to spans by document.

Nothing is sampled or capped: each window is covered by its own anchor, so the result is that of one
suffix array over the corpus. Words are compared by 32-bit hashes among segments whose anchors agree
in 64 bits, equal segments by 64-bit hashes. All different segments of one anchor are one collection,
which one task builds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import batches as B
from kinfold.llm import bwt, membership
from kinfold.llm import words as W
from kinfold.operators.blocks import partitions
from kinfold.plans.shared import scratch, written

LENGTH = 50
GRAM = 10
#: Words of the collections whose transform is built at once (whole anchors; one that has more is a collection by itself).
COLLECTION = 1_000_000


def symbols(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and its 32-bit symbol (1 at least)."""
    hashes = W.word_hashes(buf, starts, ends)
    return hashes, np.maximum(hashes >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def anchors(hashes: np.ndarray, doc: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions that are the anchor of a window, ascending, the hash of the gram of each, and where its segment starts and ends.

    The windows of an anchor are consecutive; its segment is their union, and each window in it is one of them.
    """
    none = np.zeros(0, np.int64)
    n = len(hashes)
    if n < length:
        return none, none.astype(np.uint64), none, none
    grams = W.rolling(hashes, gram)
    width = length - gram + 1
    least, at = grams, np.arange(len(grams), dtype=np.int64)
    have = 1
    while have < width:  # minima over twice as many grams, the leftmost of equal ones
        step = min(have, width - have)
        a, b = least[:-step], least[step:]
        right = b < a
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, b, a)
        have += step
    whole = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    found, first = np.unique(at[whole], return_index=True)
    last = np.append(first[1:], len(whole))[: len(found)] - 1
    return found, grams[found], whole[first], whole[last] + length


def sides(hashes: np.ndarray, found: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Two 32-bit hashes in one: of the words next to the anchor on its left and on its right, 0 where the segment doesn't reach so far.

    A window has half of its other words or more on one side of its anchor, so segments with a common window agree in one of the two.
    """
    half = (length - gram) // 2
    if half == 0:
        return np.full(len(found), (1 << 32) | 1)
    near = np.maximum(W.rolling(hashes, half) >> np.uint64(32), np.uint64(1)).astype(np.int64) if len(hashes) >= half else np.zeros(0, np.int64)
    out = np.zeros(len(found), np.int64)
    at = np.flatnonzero(found - left >= half)
    out[at] = near[found[at] - half] << 32
    at = np.flatnonzero(right - found - gram >= half)
    out[at] |= near[found[at] + gram]
    return out


#: Marks a place that is repeated as a whole, whatever else there is.
COPY = 1 << 62


def _anchored(length: int, gram: int):
    """Anchors with their segments. Of equal segments of a slice only the first is to be compared, the others are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in W.slices(big, "text"):
                buf, offsets = W.text_buffers(W.column(batch, "text"))
                starts, ends, doc = W.word_spans(buf, offsets)
                hashes, _ = symbols(buf, starts, ends)
                counts = np.bincount(doc, minlength=batch.num_rows) if len(doc) else np.zeros(batch.num_rows, np.int64)
                begin = np.concatenate([[0], np.cumsum(counts)])
                found, gramhash, left, right = anchors(hashes, doc, length, gram)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(hashes) * _odd_powers(len(hashes)), dtype=np.uint64)])
                # a polynomial of the segment's words, brought to the same power whatever its place
                segment = W.mix((total[right] - total[left]) * _inverse_powers(len(hashes))[left] + (found - left).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
                near, anchor = sides(hashes, found, left, right, length, gram), gramhash.view(np.int64)
                ids = W.ids(batch, "doc_id")[doc[found]] if len(found) else found
                place = ((left - begin[doc[found]]) << 16) | ((found - left) << 8) | (right - left) if len(found) else found
                order, new, copy = _alike(anchor, segment, ids, place)
                place = np.where(copy, place[order] | COPY, place[order])
                keep = np.flatnonzero(new | copy)
                # what is settled goes anywhere
                anchor = np.where(copy, W.mix(place.astype(np.uint64)).view(np.int64), anchor[order])
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, segment[order], near[order], ids[order], place)], ["anchor", "segment", "near", "doc_id", "place"])

    return run


def _alike(anchor: np.ndarray, segment: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by anchor, segment and place; in it, the first of each segment, and those that repeat one (but for repeated rows of a document)."""
    order = np.lexsort((place, doc, segment, anchor))
    anchor, segment, doc, place = anchor[order], segment[order], doc[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
    rep = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, new, ~new & ((doc != doc[rep]) | (place != place[rep]))


_P = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_Q = 0xD6E8FEB86659FD93


def _power(k: int, n: int) -> np.ndarray:
    if len(_P[k]) <= n:
        base = _Q if k == 0 else pow(_Q, -1, 1 << 64)
        p = np.full(max(n + 1, 1 << 19), np.uint64(base))
        p[0] = 1
        _P[k] = np.cumprod(p, dtype=np.uint64)
    return _P[k][: n + 1]


def _odd_powers(n: int) -> np.ndarray:
    return _power(0, n)[:n]


def _inverse_powers(n: int) -> np.ndarray:
    return _power(1, n)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors in order: spans that are repeated as a whole (anchor null), and segments to compare."""
    for table in B.chunks(batches, "anchor"):
        anchor, segment, near, doc, place = (table.column(c).to_numpy() for c in ("anchor", "segment", "near", "doc_id", "place"))
        settled = (place & COPY) != 0
        done_doc, done = doc[settled], place[settled] & ~COPY
        anchor, segment, near, doc, place = (x[~settled] for x in (anchor, segment, near, doc, place))
        order, new, copy = _alike(anchor, segment, doc, place)
        anchor, near, doc, place = anchor[order], near[order], doc[order], place[order]
        first = np.flatnonzero(new)
        meets = np.zeros(len(first), bool)
        for half in (near[first] >> 32, near[first] & 0xFFFFFFFF):  # with another segment of the anchor
            by = np.lexsort((half, anchor[first]))
            same = (anchor[first][by][1:] == anchor[first][by][:-1]) & (half[by][1:] == half[by][:-1]) & (half[by][1:] != 0)
            meets[by[1:][same]] = meets[by[:-1][same]] = True
        compare = np.zeros(len(anchor), bool)
        compare[first[meets]] = True
        kept = np.flatnonzero(compare | copy)
        start, size = place[kept] >> 16, place[kept] & 255
        yield from B.rows(
            {
                "doc_id": np.concatenate([doc[kept], done_doc]),
                "start": np.concatenate([start, done >> 16]),
                "end": np.concatenate([start + size, (done >> 16) + (done & 255)]),
                "anchor": np.ma.array(np.concatenate([anchor[kept], done]), mask=np.concatenate([copy[kept], np.ones(len(done), bool)])),
            },
            {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "anchor": pa.int64()},
        )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of each segment that is asked for."""
    for big in batches:
        for batch in W.slices(big, "text"):
            buf, offsets = W.text_buffers(W.column(batch, "text"))
            starts, ends, doc = W.word_spans(buf, offsets)
            _, sym = symbols(buf, starts, ends)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            wanted = W.column(batch, "wanted")
            rows = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
            flat = wanted.flatten()
            start, end, anchor = (flat.field(k).to_numpy() for k in range(3))
            a, b = first[rows] + start, np.minimum(first[rows] + end, first[rows + 1])
            found = [sym[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(W.ids(batch, "doc_id")[rows] if len(rows) else rows), pa.array(start), pa.array(found, pa.binary())], ["anchor", "doc_id", "start", "symbols"])


def repeated_windows(doc: np.ndarray, start: np.ndarray, parts: list[bytes], length: int, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of a collection that have an earlier occurrence in it."""
    flat = np.frombuffer(b"".join(parts), dtype=np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
    sizes = np.diff(offsets)
    suffixes = bwt.build(flat, offsets, folder)
    docs, starts = [], []
    kept: list[np.ndarray] = []

    def close(run: list[np.ndarray]) -> None:
        records = np.concatenate(run)
        seg = records["seg"].astype(np.int64)
        d, s = doc[seg], start[seg] + sizes[seg] - records["length"]
        group = np.cumsum(records["lcp"] < length)
        order = np.lexsort((s, d, group))
        d, s, group = d[order], s[order], group[order]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        again = (d != d[lead]) | (s != s[lead])
        docs.append(d[again])
        starts.append(s[again])

    for block in suffixes.blocks():
        lcp = block["lcp"]
        heads = np.flatnonzero(lcp < length)
        cut = heads[-1] if len(heads) else 0
        if len(heads) and kept:
            kept.append(block[: heads[0]])
            close(kept)
            kept = []
            body = block[heads[0] : cut]
        elif len(heads):
            body = block[:cut]
        else:
            kept.append(block)
            continue
        if len(body):
            inside = body["lcp"] >= length
            inside[:-1] |= body["lcp"][1:] >= length
            if inside.any():
                close([body[inside]])
        kept = [block[cut:]]
    if kept:
        close(kept)
    suffixes.delete()
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(starts)


def _suffixes(length: int, folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[pa.Table] = []
        words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(groups)
            d, s = repeated_windows(table.column("doc_id").to_numpy(), table.column("start").to_numpy(), table.column("symbols").to_pylist(), length, folder)
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(d)) - 1 if len(d) else first
            yield from B.rows({"doc_id": d[first], "start": s[first], "end": s[last] + length}, {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64()})

        for group in B.grouped(batches, "anchor"):
            groups.append(group)
            words += group.column("symbols").nbytes // 4
            if words >= most:
                yield from flush()
                groups, words = [], 0
        if groups:
            yield from flush()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the spans of each document; rows come sorted by document and start."""
    for group in B.chunks(batches, "doc_id"):
        doc, start, end = (group.column(c).to_numpy() for c in ("doc_id", "start", "end"))
        # ends that never fall within a document: shift documents apart
        run = np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]]))
        wide = int(end.max()) + 2
        reach = np.maximum.accumulate(end + run * wide)
        new = np.ones(len(doc), bool)
        new[1:] = (start[1:] + run[1:] * wide) > reach[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        stop = reach[last] - run[last] * wide
        yield from B.rows({"doc_id": doc[first], "start_word": start[first], "n_words": stop - start[first]}, {"doc_id": pa.int64(), "start_word": pa.int64(), "n_words": pa.int64()})


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, collection: int = COLLECTION) -> DataFrame:
    """``(doc_id, start_word, n_words)``: the spans of each document that are repeated, disjoint and as long as can be.

    Words are runs of anything but ASCII white space, compared as they are. The first occurrence of a
    passage (by doc_id, then position) is in no span. Null texts, empty ones and such of fewer than
    ``length`` words have no span; a text of any length is used whole; rows without a doc_id are left
    out; rows with one doc_id are occurrences of one document; an empty table gives an empty one; only
    doc_id and text are read.
    """
    if not 0 < gram < length <= 120:
        raise ValueError("0 < gram < length <= 120")
    spark = docs.sparkSession
    B.small(spark)
    at = scratch(spark, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    met = docs.mapInArrow(B.released(_anchored(length, gram)), "anchor long, segment long, near long, doc_id long, place long").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(B.released(_met), "doc_id long, start long, end long, anchor long")
    marks = written(met, f"{at}/marks")
    compare = marks.where("anchor is not null")
    maybe, _ = membership.split(docs, compare.select("doc_id"))
    wanted = compare.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "anchor")).alias("wanted"))
    segments = maybe.join(wanted, "doc_id").mapInArrow(B.released(_cut_out), "anchor long, doc_id long, start long, symbols binary")
    # few bytes, much work: as many tasks as there are, whatever the size
    windows = segments.repartition(partitions(docs), "anchor").sortWithinPartitions("anchor").mapInArrow(B.released(_suffixes(length, at, collection)), "doc_id long, start long, end long")
    spans = marks.where("anchor is null").select("doc_id", "start", "end").union(windows)
    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(B.released(_merged), "doc_id long, start_word long, n_words long")


def _without(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in W.slices(big, "text"):
                yield _cut_batch(batch, name)

    return run


def _cut_batch(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    text, spans = W.column(batch, "text"), W.column(batch, name).to_pylist()
    changed = [i for i, s in enumerate(spans) if s]
    buf, offsets = W.text_buffers(text)
    starts, ends, doc = W.word_spans(buf, offsets)
    first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    data = buf.tobytes()
    texts = text.to_pylist() if changed else None
    gone = np.zeros(batch.num_rows, bool)
    for i in changed:
        a, b = int(first[i]), int(first[i + 1])
        parts, at = [], int(offsets[i])
        for s in sorted(spans[i], key=lambda s: s["start_word"]):
            low, high = a + s["start_word"], min(a + s["start_word"] + s["n_words"], b)
            if low >= b:
                continue
            parts.append(data[at : starts[low]])
            at = int(starts[high]) if high < b else int(offsets[i + 1])
        parts.append(data[at : offsets[i + 1]])
        texts[i] = b"".join(parts).decode("utf-8")
        gone[i] = not texts[i].strip()
    columns = {n: W.column(batch, n) for n in batch.schema.names if n != name}
    if changed:
        columns["text"] = pa.array(texts, text.type)
        if "n_chars" in columns:
            chars = columns["n_chars"].to_pylist()
            for i in changed:
                chars[i] = len(texts[i])
            columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
    out = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return out.filter(pa.array(~gone)) if gone.any() else out


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without their repeated spans, with all columns; a document of which nothing is left goes.

    ``n_chars`` is brought up to date in documents that lose text. All other rows are unchanged, those
    without a doc_id too.
    """
    spans = written(repeated_spans(docs, length, gram), f"{scratch(docs.sparkSession, 'repeats')}/spans")
    maybe, unchanged = membership.split(docs, spans.select("doc_id"))
    name, key = membership.unused(docs, "spans"), membership.unused(docs, "span_id")
    by_doc = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "n_words")).alias(name))
    joined = maybe.join(by_doc, F.col("doc_id") == F.col(key), "left").drop(key)
    return joined.mapInArrow(B.released(_without(name)), docs.schema).unionByName(unchanged)
