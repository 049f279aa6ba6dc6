"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Every round inserts one symbol of each document, from its end to its start: the suffix that begins
there goes to the place C[c] + rank_c(p) of the transform, p being the place of the suffix after it
(Bauer, Cox and Rosone, "Lightweight BWT construction for very large string collections"), and the
longest common prefixes of its neighbours follow from range minima over the old ones (Cox, Garofalo,
Rosone and Sciortino, "Lightweight LCP construction for very large collections of strings"). The
transform is kept by symbol: the occurrences of each symbol as ascending places, one sorted sequence
of (symbol, place), which gives C[c] + rank_c(p) by merging. All sequences are files in the shared
folder, read and written in order, block by block; memory holds the documents' symbols, what there is
per document and a minimum for every 64 suffixes. Without a folder, blocks stay in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

RECORD = np.dtype([("key", "<u8"), ("seg", "<u4"), ("length", "u1"), ("lcp", "u1")])
BLOCK = 1 << 17
MICRO = 64
_LOW = np.uint64(0xFFFFFFFF)


class Sequence:
    """Records that are appended in blocks and read in that order."""

    def __init__(self, folder: str | None):
        self.folder, self.path, self.sink, self.filesystem = folder, None, None, None
        self.kept: list[np.ndarray] = []
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.minima: list[np.ndarray] = []
        self.count = 0

    def append(self, block: np.ndarray) -> None:
        self.rest.append(block)
        self.waiting += len(block)
        if self.waiting >= BLOCK:
            whole = np.concatenate(self.rest)
            stop = len(whole) - len(whole) % BLOCK
            for i in range(0, stop, BLOCK):
                self._store(whole[i : i + BLOCK])
            self.rest, self.waiting = [whole[stop:]], len(whole) - stop

    def close(self) -> None:
        if self.waiting:
            self._store(np.concatenate(self.rest))
        self.rest, self.waiting = [], 0
        if self.sink:
            self.sink.close()

    def _store(self, block: np.ndarray) -> None:
        lcp = block["lcp"]
        self.minima.append(np.minimum.reduceat(lcp, np.arange(0, len(lcp), MICRO)))
        self.count += len(block)
        if self.sink is None and self.folder:
            self.filesystem, base = fs.FileSystem.from_uri(self.folder)
            self.path = f"{base}/bwt-{uuid.uuid4().hex}"
            self.sink = self.filesystem.open_output_stream(self.path)
        if self.sink:
            self.sink.write(block.tobytes())
        else:
            self.kept.append(np.ascontiguousarray(block))

    def blocks(self) -> Iterator[np.ndarray]:
        yield from self.kept
        left = self.count - sum(map(len, self.kept))
        if left:
            with self.filesystem.open_input_stream(self.path) as source:
                while left:
                    n = min(BLOCK, left)
                    data = source.read(n * RECORD.itemsize)
                    if len(data) < n * RECORD.itemsize:
                        raise OSError(f"{self.path} ends too early")
                    yield np.frombuffer(data, dtype=RECORD)
                    left -= n

    def delete(self) -> None:
        self.kept = []
        if self.path:
            self.filesystem.delete_file(self.path)


class RangeMinima:
    """Minima over (low, high] of the common prefixes of a sequence, for many pairs in one pass."""

    def __init__(self, sequence: Sequence):
        self.sequence = sequence
        level = np.concatenate(sequence.minima) if sequence.minima else np.zeros(0, np.uint8)
        self.levels = [level]
        step = 1
        while 2 * step <= len(level):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum over the micro blocks a..b - 1; 255 where there is none."""
        out = np.full(len(a), 255, np.uint8)
        width = b - a
        for k, level in enumerate(self.levels):
            at = np.flatnonzero((width >> k) == 1)
            if len(at):
                out[at] = np.minimum(level[a[at]], level[b[at] - (1 << k)])
        return out

    def answer(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        first = low + 1
        a, b = first // MICRO, high // MICRO
        same = a == b
        out = np.full(len(low), 255, np.uint8)
        far = np.flatnonzero(~same)
        out[far] = self._between(a[far] + 1, b[far])
        by_first, by_high = np.argsort(first, kind="stable"), far[np.argsort(high[far], kind="stable")]
        i = j = at = 0
        sorted_first, sorted_high = first[by_first], high[by_high]
        for block in self.sequence.blocks():
            n = len(block)
            i2, j2 = np.searchsorted(sorted_first, at + n), np.searchsorted(sorted_high, at + n)
            if i2 > i or j2 > j:
                padded = np.full(-(-n // MICRO) * MICRO, 255, np.uint8)
                padded[:n] = block["lcp"]
                rows = padded.reshape(-1, MICRO)
                if j2 > j:
                    heads = np.minimum.accumulate(rows, axis=1).ravel()
                    q = by_high[j:j2]
                    out[q] = np.minimum(out[q], heads[high[q] - at])
                if i2 > i:
                    q = by_first[i:i2]
                    inside = same[q]
                    tails = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
                    outer = q[~inside]
                    out[outer] = np.minimum(out[outer], tails[first[outer] - at])
                    near = q[inside]
                    for k in range(0, len(near), 4096):
                        part = near[k : k + 4096]
                        columns = np.arange(MICRO)
                        values = rows[a[part] - at // MICRO].copy()
                        base = a[part][:, None] * MICRO + columns
                        values[(base < first[part][:, None]) | (base > high[part][:, None])] = 255
                        out[part] = values.min(axis=1)
            i, j, at = i2, j2, at + n
        return out


def build(symbols: np.ndarray, offsets: np.ndarray, folder: str | None = None) -> Sequence:
    """Sorted suffixes of the documents symbols[offsets[i]:offsets[i + 1]] (uint32 >= 1, up to 255 each), with common prefixes.

    Equal suffixes are ordered by document. A record has the document (seg), the length of the suffix
    and the length of the prefix that it shares with the one before.
    """
    lengths = np.diff(offsets)
    m = len(lengths)
    place = np.arange(m, dtype=np.int64)  # of each document's latest suffix; 0..m-1 are the empty ones
    old = Sequence(folder)
    old.close()
    for j in range(1, int(lengths.max(initial=0)) + 1):
        active = np.flatnonzero(lengths >= j)
        c, p = symbols[offsets[active + 1] - j].astype(np.uint64), place[active]
        key = (c << np.uint64(32)) | p.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, active, c, p = key[order], active[order], c[order], p[order]
        n = len(key)
        # pass 1: where each new suffix goes, and the old keys on both sides
        rank = np.full(n, old.count, dtype=np.int64)
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        i, at, last = 0, 0, np.uint64(0)
        for block in old.blocks():
            keys = block["key"]
            i2 = int(np.searchsorted(key, keys[-1]))  # those that go before the block's last record
            if i2 > i:
                r = np.searchsorted(keys, key[i:i2])
                rank[i:i2] = r + at
                after[i:i2] = keys[r]
                before[i:i2] = np.where(r > 0, keys[r - 1], last)
            i, at, last = i2, at + len(keys), keys[-1]
        before[i:] = last
        # neighbours among the new ones are nearer where they go to the same place
        together = np.zeros(n, bool)
        together[1:] = rank[1:] == rank[:-1]
        left = before.copy()
        left[together] = key[:-1][together[1:]]
        follows = np.ones(n, bool)  # the next record is an old one
        follows[:-1] = ~together[1:]
        # pass 2: common prefixes with the neighbours
        lcp = _prefixes(old, left, key, m)
        heads = np.flatnonzero(follows & (rank < old.count))
        lcp_after = _prefixes(old, key[heads], after[heads], m)
        # pass 3: write the merged sequence
        new = Sequence(folder)
        record = np.zeros(n, dtype=RECORD)
        record["key"], record["seg"], record["length"], record["lcp"] = key, active, j, lcp
        moved = rank[heads]
        gather = np.cumsum(np.bincount(rank, minlength=old.count + 1)) if old.count <= 1 << 24 else None

        def shifted(keys: np.ndarray, m=m, rank=rank, gather=gather) -> np.ndarray:
            psi = (keys & _LOW).astype(np.int64)
            stored = psi >= m
            by = np.zeros(len(psi), np.int64)
            by[stored] = gather[psi[stored] - m] if gather is not None else np.searchsorted(rank, psi[stored] - m, side="right")
            return keys + by.astype(np.uint64)

        record["key"] = shifted(record["key"])
        i, h, at = 0, 0, 0
        for block in old.blocks():
            size = len(block)
            block = block.copy()
            block["key"] = shifted(block["key"])
            h2 = int(np.searchsorted(moved, at + size))
            block["lcp"][moved[h:h2] - at] = lcp_after[h:h2]
            i2 = int(np.searchsorted(rank, at + size))
            if i2 > i:
                merged = np.empty(size + i2 - i, dtype=RECORD)
                spots = rank[i:i2] - at + np.arange(i2 - i)
                mask = np.ones(len(merged), bool)
                mask[spots] = False
                merged[spots], merged[mask] = record[i:i2], block
                block = merged
            new.append(block)
            i, h, at = i2, h2, at + size
        new.append(record[i:])
        new.close()
        old.delete()
        place[active] = m + rank + np.arange(n)
        old = new
    return old


def _prefixes(old: Sequence, left: np.ndarray, right: np.ndarray, m: int) -> np.ndarray:
    """Common prefixes of neighbours: 0 for two symbols, else 1 more than what the rests share."""
    out = np.zeros(len(left), np.uint8)
    same = np.flatnonzero((left >> np.uint64(32)) == (right >> np.uint64(32)))
    if len(same):
        out[same] = 1
        low, high = ((x[same] & _LOW).astype(np.int64) - m for x in (left, right))
        deep = np.flatnonzero(low >= 0)
        if len(deep):
            out[same[deep]] += RangeMinima(old).answer(low[deep], high[deep])
    return out
