"""Vectors as little-endian float32 blobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_vectors(column: str) -> Column:
    """array<float> to bytes; null stays null."""

    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return encode(F.col(column))


def decode_vectors(column: str, dim: int) -> Column:
    """Bytes to array<float>; null where the length is not 4 * dim."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or len(b) != 4 * dim else np.frombuffer(b, dtype="<f4"))

    return decode(F.col(column))
