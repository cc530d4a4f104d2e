"""Words of Arrow text columns, cut and numbered in bulk.

Words are runs of other bytes than ASCII white space (9 to 13 and 32).  A chunk
of texts is bounded by bytes, so the arrays here are too; a single text longer
than the bound is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 8 << 20


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts without nulls) in pieces of at most ``most`` bytes or one row."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    start = 0
    while start < len(texts):
        base = upto[start] - size[start]
        end = max(start + 1, int(np.searchsorted(upto, base + most, "right")))
        yield start, texts.slice(start, end - start)
        start = end


def trim() -> None:
    """Give what this worker has freed back to the machine; an idle worker else keeps the most it ever had."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def numbered(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a chunk, the word numbers in order, and where each row's words start (rows + 1)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.diff(lists.offsets.to_numpy()).cumsum()
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # white space at the ends leaves empty pieces
        word = codes != empty
        kept = np.concatenate(([0], np.cumsum(word)))
        ends = kept[ends]
        codes = codes[word]
    return coded.dictionary, codes, np.concatenate(([0], ends))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length) one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
