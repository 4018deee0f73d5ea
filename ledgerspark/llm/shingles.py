"""Word shingles as 64-bit hashes, for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest, xxh3_128_digest

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def scrambled(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def factors(count: int, seed: int) -> np.ndarray:
    return scrambled(np.arange(1, count + 1, dtype=np.uint64) * _GOLD + np.uint64(seed)) | np.uint64(1)


def shingle_set(text: bytes, size: int, place_factors: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words, A-Z lowered, words parted by ASCII space.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    Shingles are 64-bit hashes: two of one text coincide by chance once in 10^19 pairs.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    last = len(words) - width + 1
    total = np.full(last, width, np.uint64) * _GOLD
    for place in range(width):
        total += hashes[place : place + last] * place_factors[place]
    return np.unique(scrambled(total))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for equal sets, as two signed numbers."""
    digest = xxh3_128_digest(shingles.tobytes())
    return (
        int.from_bytes(digest[:8], "little", signed=True),
        int.from_bytes(digest[8:], "little", signed=True),
    )


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def lists_of(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
