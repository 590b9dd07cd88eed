"""Recursive character chunking, one document at a time, many documents per Arrow batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes and the two separator lists (the index builder's list has no ! and ? marks).
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", " ", ""]
INDEX_SEPARATORS = ["\n\n", "\n", "。", ".", " ", ""]


def _cut(text: str, mark: str) -> list[str]:
    """Parts of the text; every part but the first begins with the mark."""
    if mark == "":
        return list(text)
    head, *tail = text.split(mark)
    return [p for p in [head, *(mark + t for t in tail)] if p]


def _pack(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts joined up to ``size``; a new chunk starts with at most ``overlap`` characters of the last one."""
    held: deque[str] = deque()
    width = 0
    for part in parts:
        if held and width + len(part) > size:
            yield "".join(held).strip()
            while held and (width > overlap or width + len(part) > size):
                width -= len(held.popleft())
        held.append(part)
        width += len(part)
    yield "".join(held).strip()


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               marks: list[str] | None = None) -> list[str]:
    """Cut at the first mark that occurs; parts that are still too long are cut at the next ones."""
    marks = SEPARATORS if marks is None else marks
    at = next((i for i, m in enumerate(marks) if m == "" or m in text), len(marks) - 1)
    finer = marks[at + 1:]
    chunks: list[str] = []
    short: list[str] = []
    for part in _cut(text, marks[at]):
        if len(part) < size:
            short.append(part)
            continue
        if short:
            chunks += _pack(short, size, overlap)
            short = []
        chunks += split_text(part, size, overlap, finer) if finer else [part]
    if short:
        chunks += _pack(short, size, overlap)
    return [c for c in chunks if c]


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP, marks: list[str] | None = None) -> DataFrame:
    """Documents to chunks: all columns but the text, then ``position``, ``chunk_id``, ``content``, ``chunk_size``."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: split_text(t or "", size, overlap, marks))

    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode(pieces(F.col(text))).alias("position", "content")).withColumn(
        "chunk_id", F.concat_ws(":", F.col(key).cast("string"), F.col("position").cast("string"))).withColumn(
        "chunk_size", F.length("content"))
