"""Rows of vectors as matrices, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_vectors(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) for each length that occurs: vectors without null or non-finite entries.

    Null and empty vectors are left out.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == width)
        matrix = numbers[starts[places][:, None] + np.arange(width)]
        whole = np.isfinite(matrix).all(1)
        if whole.any():
            yield places[whole], matrix[whole]


def floored(matrix: np.ndarray, scale: int, bound: int) -> np.ndarray:
    """floor(scale * entry) as integers, held within ``bound`` either way."""
    return np.clip(np.floor(scale * matrix), -bound, bound).astype(np.int64)
