"""Quality rules by compression bands.

The ratio of a text's bytes to its zstandard size tells repetition (high) from noise (low). What is usual depends on length, so every
length has its own band. A document is rejected when its whole text is out of band, or when chunks of fixed size that
are out of their band make up more than ``chunk_share`` of its bytes. The counts of the base rules are exact over whole texts.

Nulls and edges: a null text is an empty one; without 20 words a document fails the base rules; an empty table gives no rows;
repeated rows are judged alike. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: (bytes below which the band holds, lowest and highest usual ratio). Short texts carry the frame's overhead; long ones find more to repeat.
BANDS = [
    (128, 0.0, 2.6),
    (256, 0.9, 2.8),
    (512, 1.1, 3.2),
    (1024, 1.3, 3.6),
    (4096, 1.4, 4.0),
    (16384, 1.5, 4.5),
    (65536, 1.6, 5.0),
    (float("inf"), 1.6, 6.0),
]
CHUNK = 4096
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 8
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RESULT = ("doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "ratio double, odd_chunk_share double, base_failed boolean, kept boolean")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which the text has at least twice."""
    m = len(words) - window + 1
    if m < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    mixed = np.zeros(m, np.uint64)
    for j in range(window):
        mixed += ids[j:j + m] * _FACTORS[j]
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice))
    raw = ids.tobytes()
    exact = [raw[8 * i:8 * (i + window)] for i in at.tolist()]  # a sum shared by different windows counts for neither
    counts = Counter(exact)
    at = at[np.fromiter((counts[e] > 1 for e in exact), bool, len(exact))]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def out_of_band(size: int, ratio: float) -> bool:
    low, high = next((a, b) for most, a, b in BANDS if size < most)
    return not low <= ratio <= high


def compression(raw: bytes, chunk: int = CHUNK) -> tuple[float, float]:
    """(ratio of the whole, share of bytes in chunks out of their band)."""
    if not raw:
        return 0.0, 0.0
    pack = _PACKER.compress
    ratio = len(raw) / len(pack(raw))
    if len(raw) <= chunk:
        return ratio, float(out_of_band(len(raw), ratio))
    odd = 0
    for at in range(0, len(raw), chunk):
        part = raw[at:at + chunk]
        odd += len(part) * out_of_band(len(part), len(part) / len(pack(part)))
    return ratio, odd / len(raw)


_PACKER = zstandard.ZstdCompressor(level=3)


def judge(text: str | None, chunk_share: float = 0.3) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII spaces alone
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = repeated_words(words)
    ratio, odd = compression(raw)
    failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    usual = not out_of_band(len(raw), ratio) and odd <= chunk_share
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
            ratio, odd, failed, usual and not failed)


def rules(docs: DataFrame, chunk_share: float = 0.3) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, odd_chunk_share, base_failed, kept."""
    schema = RESULT.format(kind=dict(docs.dtypes)["doc_id"])
    kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2

    def judged(batches):
        for batch in batches:
            cols = list(zip(*(judge(t.as_py(), chunk_share) for t in batch.column(1)))) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(judged, schema)
