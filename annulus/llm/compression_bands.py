"""Quality rules by compression bands.

A text is compressed with zstandard, whole and in fixed chunks. A text that is
longer than a chunk has full chunks alone: its last one ends with the text and
may overlap the one before, so that every byte is judged at the same length. A
shorter text is one chunk, with limits for its length. Text that
compresses too well for its length repeats itself; text that hardly compresses
is noise (keys, encoded binary). Short texts compress less, so the limits
depend on the length. Whole-document limits find documents that are junk
throughout, chunk limits those where a large share is.

Each text is processed whole in one pass without a shuffle. Nulls and empty
texts have no words and are rejected as too short; repeated rows get equal
verdicts; an empty table gives no rows. Measures are added under the names in
MEASURES, in the place of input columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: (up to so many bytes, smallest ratio, largest ratio); fitted on documents labelled as good, with about 5 % to spare on
#: either side. No good document that passes the base rules has up to 256 bytes or more than 65536: there the limits are none, or loose.
BANDS = (
    (256, 0.0, float("inf")),
    (512, 1.31, 2.0),
    (1024, 1.39, 2.1),
    (2048, 1.635, 2.25),
    (4096, 1.82, 2.33),
    (8192, 2.01, 2.42),
    (16384, 2.1, 2.52),
    (65536, 2.215, 2.65),
    (float("inf"), 1.5, 3.2),
)
LEVEL = 3
CHUNK_BYTES = 1024
#: The same for chunks, fitted likewise with 2 % to spare on either side.
CHUNK_BANDS = (
    (256, 0.0, float("inf")),
    (320, 1.425, 1.655),
    (384, 1.35, 1.695),
    (448, 1.395, 1.875),
    (512, 1.38, 1.86),
    (640, 1.435, 1.84),
    (768, 1.44, 1.935),
    (896, 1.575, 1.975),
    (1023, 1.65, 2.01),
    (1024, 1.62, 2.055),
)
#: A text is rejected when more than this share of its chunks is outside the chunk's band.
MAX_BAD_CHUNKS = 0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, "
    "n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)


def _repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pairs = np.unique(x[:-1] * len(number) + x[1:], return_inverse=True)
    # pairs < n, so that this stays below 2**63 for texts of up to a billion words
    _, where, counts = np.unique(pairs[:-1] * len(number) + x[2:], return_inverse=True, return_counts=True)
    again = counts[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def _chunks(raw: bytes) -> list[bytes]:
    """The text's fixed chunks; the last one ends with it."""
    whole = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES)]
    return whole + [raw[-CHUNK_BYTES:]] if len(raw) % CHUNK_BYTES else whole


def measure(text: str | None, compressor, bands=BANDS) -> tuple:
    """The values of MEASURES for one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes.split() cuts at space and \t\n\v\f\r alone
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeats = _repeat_words(words)
    ratio = len(raw) / len(compressor.compress(raw)) if raw else 0.0
    low, high = next((a, b) for most, a, b in bands if len(raw) <= most)
    chunks = _chunks(raw)
    least, most = next((a, b) for size, a, b in CHUNK_BANDS if min(len(raw), CHUNK_BYTES) <= size)
    bad = sum(not least <= len(x) / len(compressor.compress(x)) <= most for x in chunks)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    kept = not failed and low <= ratio <= high and bad <= MAX_BAD_CHUNKS * len(chunks)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats, ratio, len(chunks), bad, failed, kept


def with_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with MEASURES added."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    types = [pa.float64() if k == "ratio" else pa.bool_() if k in ("base_failed", "kept") else pa.int64() for k in names]
    own = docs.drop(*names)
    columns = own.columns
    place = columns.index(text)

    def measured(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = [measure(t.as_py(), compressor) for t in batch.column(place)]
            values = zip(*rows) if rows else [[]] * len(names)
            added = [pa.array(c, k) for c, k in zip(values, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*columns, *names])

    return own.mapInArrow(measured, StructType([*own.schema.fields, *StructType.fromDDL(MEASURES).fields]))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with (names of MEASURES included)."""
    names = {x.split()[0] for x in MEASURES.split(", ")}
    away = {c: f"_own_{c}" for c in docs.columns if c in names}
    verdict = with_quality(docs.withColumnsRenamed(away)).where("kept")
    return verdict.select(*(F.col(away.get(c, c)).alias(c) for c in docs.columns))
