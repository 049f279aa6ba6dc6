"""Quality rules: bands of the zstandard compression ratio.

The ratio is UTF-8 bytes by compressed bytes, of the whole document and of each fixed chunk. Natural
prose stays in a band that depends on the length: repetitive text lies above it, random or encoded
text below. A document is rejected for its chunks if bad ones of a kind hold more than a share of its
bytes. The limits are parameters. Texts of under 128 bytes can't be judged incompressible, as
zstandard stores prose and noise alike there, and neither can those of under 256 bytes that aren't
mostly ASCII: short prose of thousands of characters (Chinese) compresses no better than noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import batches as B
from kinfold.llm.words import column

#: (bytes below, least ratio, largest ratio); short texts carry the frame's fixed costs.
BANDS = (
    (64, 0.0, 2.5),
    (128, 0.7, 2.5),
    (256, 0.9, 2.75),
    (512, 1.15, 3.0),
    (1024, 1.25, 3.25),
    (2048, 1.35, 3.5),
    (4096, 1.4, 3.75),
    (16384, 1.4, 4.0),
    (65536, 1.45, 4.5),
    (float("inf"), 1.45, 5.0),
)
#: (bytes below, least ratio) for texts that are mostly ASCII: above what random printable bytes and base64 reach.
ASCII_LEAST = ((128, 0.0), (192, 1.06), (256, 1.14), (512, 1.25), (1024, 1.32))
MOSTLY = 0.75
_HIGH = bytes(range(128, 256))
CHUNK = 4096
LEVEL = 3
#: Share of a document's bytes that may lie in chunks out of their band, on one side.
MOST_BAD_CHUNKS = 0.25

SCHEMA = "doc_id long, n_bytes long, ratio double, n_chunks int, high_chunks int, low_chunks int, verdict string"


def band(n: int, bands=BANDS) -> tuple[float, float]:
    """Least and largest ratio for a text of n bytes."""
    return next((low, high) for below, low, high in bands if n < below)


def ascii_least(data: bytes) -> float:
    """Least ratio of a text that is mostly ASCII, 0 for others and for long ones, whose bands tell noise."""
    least = next((low for below, low in ASCII_LEAST if len(data) < below), 0.0)
    return least if least and len(data.translate(None, _HIGH)) >= MOSTLY * len(data) else 0.0


def judge(text: str | None, pack, chunk: int = CHUNK, bands=BANDS, most_bad: float = MOST_BAD_CHUNKS) -> tuple:
    """(n_bytes, ratio, n_chunks, high_chunks, low_chunks, verdict) of one text; ``pack`` gives the compressed bytes."""
    if text is None:
        return None, None, None, None, None, "null"
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not data.strip():
        return n, None, 0, 0, 0, "empty"
    ratio = n / len(pack(data))
    low, high = band(n, bands)
    chunks, above, below = 0, 0, 0
    bad_high = bad_low = 0  # in bytes
    if n > chunk:
        for at in range(0, n, chunk):  # the rest too, in the band of its own length
            piece = data[at : at + chunk]
            r = len(piece) / len(pack(piece))
            least, most = band(len(piece), bands)
            chunks += 1
            if r > most:
                above, bad_high = above + 1, bad_high + len(piece)
            elif r < max(least, ascii_least(piece)):
                below, bad_low = below + 1, bad_low + len(piece)
    if ratio > high:
        verdict = "repetitive"
    elif ratio < max(low, ascii_least(data)):
        verdict = "incompressible"
    elif bad_high > most_bad * n:
        verdict = "repetitive_chunks"
    elif bad_low > most_bad * n:
        verdict = "incompressible_chunks"
    else:
        verdict = "keep"
    return n, round(ratio, 6), chunks, above, below, verdict


def packer(level: int = LEVEL):
    return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress


def _judged(chunk: int, bands, most_bad: float, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packer(level)
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            rows = [judge(t.as_py(), pack, chunk, bands, most_bad) for t in column(batch, "text")]
            found = [pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *found], ["doc_id", "n_bytes", "ratio", "n_chunks", "high_chunks", "low_chunks", "verdict"])

    return run


def quality(docs: DataFrame, chunk: int = CHUNK, bands=BANDS, most_bad: float = MOST_BAD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """One row per input row: its compression figures and a verdict, ``keep`` or why it is rejected.

    One pass, no shuffle; only ``doc_id`` and ``text`` are read, so further columns of any name are
    harmless. A null text has the verdict ``null``, a text without a byte that isn't white space
    ``empty`` (both rejected); a null doc_id stays null. Repeated rows are judged each by itself. An
    empty table gives an empty table. Texts of any length are read whole.
    """
    B.small(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(B.released(_judged(chunk, bands, most_bad, level)), SCHEMA)


def _verdicts(chunk: int, bands, most_bad: float, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packer(level)
        for batch in batches:
            keep = [judge(t.as_py(), pack, chunk, bands, most_bad)[-1] == "keep" for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return run


def keep_good(docs: DataFrame, chunk: int = CHUNK, bands=BANDS, most_bad: float = MOST_BAD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """The rows of ``docs`` with the verdict ``keep``, all their columns unchanged, in one pass without a join.

    Rows whose text is null, empty or white space go; rows without a doc_id and repeated rows are judged
    each by itself, and an empty table stays empty.
    """
    B.small(docs.sparkSession)
    return docs.mapInArrow(B.released(_verdicts(chunk, bands, most_bad, level)), docs.schema)
