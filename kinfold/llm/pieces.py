"""Exact encoding and decoding for SentencePiece models of the merge type, by backtracking.

Plain merging looks for the best pair again and again. Here a text is covered from the left with the
longest piece that an Aho-Corasick automaton finds. A piece may follow another only if merging the
two again from characters gives just these two; if it may not, the next shorter piece is tried, and
if there is none, the last piece is taken back and its end marked as failed in a bitfield, so no
position fails twice. A cover whose neighbours are all compatible is the merges' own result.

A piece never has a space mark behind another character, so no merge crosses the start of a word,
and none has to do with a character that is in no longer piece: such characters and the words between
them are encoded one by one, and those of the latest texts are remembered by the worker.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import words as W

MARK = "▁"
CACHE = 300_000
LONG = 200


class Pieces:
    """A model's vocabulary. ``normalizer`` must be the identity, as in models with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        is_byte = [model.is_byte(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.byte_ids = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if is_byte[i]}
        self.ids = {t: i for i, t in enumerate(self.texts) if not special[i] and not is_byte[i]}
        self.normal = [not s for s in special]
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece crosses the start of a word")
        probe = " ﬁ  Á "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("the model changes text before it encodes")
        self.alphabet = {c for t in self.ids for c in t}
        self.bytes = [bytes([int(t[3:5], 16)]) if is_byte[i] else b"" if model.is_control(i) else " ⁇ ".encode() if i == self.unknown else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        self.automaton = ahocorasick.Automaton()
        self.reach: dict[str, int] = {}
        for t, i in self.ids.items():
            if len(t) == 1 or self.merge(t) == [i]:  # the others are never the result of merges
                self.automaton.add_word(t, i)
                self.reach[t] = i
        self.automaton.make_automaton()
        self.single = frozenset(c for c in self.alphabet if c in self.reach)
        self.fits: dict[int, bool] = {}
        self.sizes = [len(t) for t in self.texts]
        #: Of each piece, the longest other that starts it.
        self.shorter = [next((self.reach[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.reach), -1) for t in self.texts]
        self.pairs = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        # characters of longer pieces; nothing merges with any other, which is a word by itself
        joint = "".join(sorted({c for t in self.ids if len(t) > 1 for c in t} - {MARK}))
        self.words = re.compile(f"{MARK}+[{re.escape(joint)}]*|[{re.escape(joint)}]+|.", re.DOTALL).findall if joint else list

    def merge(self, text: str) -> list[int | None]:
        """Pieces by merging: of all neighbours that make a piece the best, the leftmost of equals. None: a character that is no piece."""
        if len(text) > 48:
            return self._merge_long(text)
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids.get(p) for p in parts]

    def _merge_long(self, text: str) -> list[int | None]:
        """The same with a heap of neighbours, for texts of any length."""
        parts: list[str | None] = list(text)
        n, ids, scores = len(parts), self.ids, self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[i], k, i) for k in range(n - 1) if (i := ids.get(text[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, i = heapq.heappop(heap)
            right = after[k]
            if parts[k] is None or right >= n or len(parts[k]) + len(parts[right]) != len(self.texts[i]) or parts[k] + parts[right] != self.texts[i]:
                continue  # one of the two has changed since
            parts[k], parts[right] = self.texts[i], None
            after[k] = right = after[right]
            if right < n:
                before[right] = k
            for left, other in ((before[k], k), (k, right)):
                if left >= 0 and other < n and (i := ids.get(parts[left] + parts[other])) is not None:
                    heapq.heappush(heap, (-scores[i], left, i))
        return [ids.get(p) for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of the two pieces again gives just these two."""
        found = self.fits.get(a << 32 | b)
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[a << 32 | b] = self.merge(self.texts[a] + self.texts[b]) == [a, b]
        return found

    def cover(self, text: str) -> list[int] | None:
        """Pieces of a text whose characters are all pieces."""
        n = len(text)
        sizes, shorter, fits = self.sizes, self.shorter, self.fits
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(text):  # by end, so the last of a start is its longest
            longest[end + 1 - sizes[i]] = i
        failed = bytearray((n >> 3) + 1)  # a bit for each position from which no cover goes on
        stack: list[int] = []
        at, last, i = 0, -1, longest[0]
        while at < n:
            while i >= 0:
                end = at + sizes[i]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | i)
                    if fit or fit is None and self.compatible(last, i):
                        break
                i = shorter[i]
            if i >= 0:
                stack.append(i)
                at, last, i = end, i, longest[end]
            elif last < 0:
                return None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, i = at - sizes[last], shorter[last]
                stack.pop()
                last = stack[-1] if stack else -1
        return stack

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word, its space marks in front."""
        if word.startswith(MARK * 2):  # runs of marks share one score, so their merges go by place
            lead = len(word) - len(word.lstrip(MARK))
            return self._marks(word, lead)
        return self._known(word)

    def _marks(self, word: str, lead: int) -> list[int]:
        rest = word[lead:]
        tail = self._known(MARK + rest) if rest else None
        if tail and self.texts[tail[0]] != MARK:  # the last mark belongs to the word
            return self._run(lead - 1) + tail
        return self._run(lead) + (tail[1:] if tail else [])

    def _run(self, n: int) -> list[int]:
        """Marks merge from the left: the first pair of equals is always taken."""
        if not n:
            return []
        head: list[int] = []
        if n > 64:
            first = self.merge(MARK * 64)[0]
            period = len(self.texts[first])  # the same piece again and again, as long as there is room for it
            head = [first] * ((n - 64) // period)
            n -= len(head) * period
        return head + self._bytes_for_none(MARK * n, self.merge(MARK * n))

    def _bytes_for_none(self, text: str, ids: list[int | None]) -> list[int]:
        out: list[int] = []
        at = 0
        for i in ids:
            if i is None:
                out += self._fallback(text[at])
                at += 1
            else:
                out.append(i)
                at += len(self.texts[i])
        return out

    def _fallback(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def _known(self, word: str) -> list[int]:
        reach = self.reach
        if self.single.issuperset(word):
            return self.cover(word)
        out: list[int] = []
        start = 0
        for k, c in enumerate(word):
            if c not in reach:
                if c in self.alphabet:  # only within longer pieces: leave it to the merges
                    return self._bytes_for_none(word, self.merge(word))
                if k > start:
                    out += self.cover(word[start:k])
                out += self._fallback(c)
                start = k + 1
        if start < len(word):
            out += self.cover(word[start:])
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids. Bytes that are no UTF-8 become U+FFFD, each by itself; ids of control pieces nothing."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        text = data.decode("utf-8", "each_byte")
        return text[1:] if text.startswith(" ") and ids and self.texts[ids[0]].startswith(MARK) else text


def _each_byte(error: UnicodeError):
    return "�", error.start + 1


__import__("codecs").register_error("each_byte", _each_byte)

class Encoder(dict):
    """word -> int32 ids as bytes, remembered up to ``most`` words."""

    def __init__(self, path: str, most: int = CACHE):
        super().__init__()
        self.pieces, self.most = Pieces(path), most

    def __missing__(self, word: str) -> bytes:
        # no merge crosses two neighbours that no piece has
        pairs = self.pieces.pairs
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs]
        if cuts:
            found = b"".join([self[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)])])
        else:
            found = np.array(self.pieces.encode_word(word), dtype=np.int32).tobytes()
        if len(word) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces.words(MARK + text.replace(" ", MARK)))) if text else b""


_MADE: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = CACHE) -> Encoder:
    """One for a worker process, which may run many tasks."""
    if (path, most) not in _MADE:
        _MADE[path, most] = Encoder(path, most)
    return _MADE[path, most]


def _encoded(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, most)
        for big in batches:
            for batch in W.slices(big, "text"):
                texts = W.column(batch, "text").to_pylist()
                found = [None if t is None else own.encode(t) for t in texts]
                back = [None if f is None else own.pieces.decode(np.frombuffer(f, np.int32).tolist()) == t for f, t in zip(found, texts)]
                sizes = np.array([0 if f is None else len(f) // 4 for f in found], dtype=np.int32)
                missing = pa.array([f is None for f in found])
                flat = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(f for f in found if f))])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, flat, mask=missing)
                count = pa.array(sizes.astype(np.int64), mask=missing.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), ids, count, pa.array(back, pa.bool_())], ["doc_id", "ids", "n_tokens", "exact"])

    return run


def encode(docs: DataFrame, model: str, cache: int = CACHE) -> DataFrame:
    """``(doc_id, ids, n_tokens, exact)`` of each row; ``exact`` says whether the ids decode to the text.

    The ids are those of the model's own library. They don't decode to the text only where it has the
    space mark itself, which the model can't tell from a space. A null text has nulls, an empty one no
    ids; a null doc_id stays null, repeated rows are encoded each by itself, an empty table gives an
    empty one; only doc_id and text are read. No shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded(model, cache), "doc_id long, ids array<int>, n_tokens long, exact boolean")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in W.column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` of rows with ``doc_id`` and ``ids``.

    Null ids give a null text, no ids an empty one; a null doc_id stays null, repeated rows are decoded each
    by itself, an empty table gives an empty one; other columns aren't read.
    """
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoded(model), "doc_id long, text string")
