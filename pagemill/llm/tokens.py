"""Words and bytes of a batch of texts in Arrow and numpy, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = b"\t\n\x0b\x0c\r"


def byte_table(lower: bool = False, letters_only: bool = False) -> np.ndarray:
    """Byte -> byte: blanks to space, A-Z to a-z if ``lower``; with ``letters_only``
    every other ASCII byte becomes a space. Bytes of longer characters stay."""
    out = np.arange(256, dtype=np.uint8)
    out[list(BLANKS)] = 32
    if lower:
        out[65:91] += 32
    if letters_only:
        keep = np.zeros(256, dtype=bool)
        keep[128:] = keep[65:91] = keep[97:123] = True
        out[~keep] = 32
    return out


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts (null: empty) with every byte replaced by the table's."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    own = np.ascontiguousarray(offsets - (offsets[0] if len(offsets) else 0))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(own), pa.py_buffer(table[raw]))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and the offset of each text (one more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[: offsets[-1]], offsets


def words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word in a row, the distinct words, and where each text begins (one more than texts)."""
    split = pc.split_pattern(mapped(texts, table), " ")
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    at = split.offsets.to_numpy()
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    real = codes != empty
    starts = np.concatenate(([0], np.cumsum(real)))[at]
    return codes[real], coded.dictionary, starts


def slices(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` in total each; a larger row stands alone or ends its range."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1 if len(size) else []
    ends = [*map(int, cuts), len(size)]
    return [(a, b) for a, b in zip([0, *ends], ends) if b > a]
