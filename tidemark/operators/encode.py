"""Plug-in encoders: any function from a list of texts to a matrix, applied where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encoder = Callable[[list[str]], np.ndarray]


def with_embeddings(df: DataFrame, encoder: Encoder, text: str = "content", out: str = "embedding",
                    normalise: bool = True) -> DataFrame:
    """All columns and the encoded text, batch by batch; rows are L2-normalised unless told otherwise."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {out} array<float>"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            matrix = np.asarray(encoder([t or "" for t in pdf[text]]), dtype="float32").reshape(len(pdf), -1)
            if normalise:
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = matrix / np.where(length > 0, length, 1.0)
            yield pdf.assign(**{out: list(matrix)})

    return df.mapInPandas(encode, schema)
