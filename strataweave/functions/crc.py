"""CRC-32C of many byte strings at once.

Spark has only the IEEE polynomial, so this is an Arrow function.  Remainders
are linear: that of a string is the exclusive or of what each byte leaves at its
distance from the end.  Strings are cut into lanes of 256 bytes, whose bytes are
looked up by place; the lanes of a string are shifted over the lanes after them,
again by table, and those of long strings are chained 64 KiB at a time.  The
steps are a fixed few for a short string and follow the bytes for a long one.
Zeros in front leave a remainder of 0 alone, so strings are aligned at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the reflected Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78
LANE = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_BYTE = _byte_table()


def _place_table() -> np.ndarray:
    """What a byte at each place of a lane leaves at the lane's end."""
    t = np.empty((LANE, 256), np.uint32)
    t[-1] = _BYTE
    for place in range(LANE - 2, -1, -1):
        t[place] = _BYTE[t[place + 1] & 0xFF] ^ (t[place + 1] >> 8)
    return t


_PLACE = _place_table().ravel()


def _shifted(r: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Remainders as ``table`` shifts each of their four bytes."""
    return table[0][r & 0xFF] ^ table[1][(r >> 8) & 0xFF] ^ table[2][(r >> 16) & 0xFF] ^ table[3][r >> 24]


def _chain_table() -> tuple[np.ndarray, np.ndarray]:
    """What each byte of a remainder becomes after 0 to LANE - 1 lanes of zeros, and after LANE of them."""
    bytes_ = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    one = bytes_
    for _ in range(LANE):
        one = _BYTE[one & 0xFF] ^ (one >> 8)
    t = np.empty((LANE, 4, 256), np.uint32)
    for n in range(LANE):
        t[n] = bytes_ if n == 0 else _shifted(t[n - 1], one)
    return np.ascontiguousarray(t.transpose(1, 0, 2)).reshape(4, LANE * 256), _shifted(t[-1], one)


_CHAIN, _SHIFT = _chain_table()

#: Remainders of strings of 0 to 3 zero bytes: what the initial ones leave.
_SHORT = np.array([0xFFFFFFFF] * 4, np.uint32)
for _n in (1, 2, 3):
    _SHORT[_n] = _BYTE[_SHORT[_n - 1] & 0xFF] ^ (_SHORT[_n - 1] >> 8)


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value."""
    if not values:
        return np.zeros(0, np.uint32)
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    width = int(min(LANE, max(sizes.max(), 1)))
    lanes = np.maximum(-(-sizes // width), 1)
    ends = np.cumsum(lanes)
    pad = bytes(width)
    buffer = np.frombuffer(bytearray().join([x for n, v in zip((lanes * width - sizes).tolist(), values) for x in (pad[:n], v)]), np.uint8)
    ones = (ends * width - sizes)[sizes >= 4]
    for i in range(4):
        buffer[ones + i] ^= 0xFF  # the initial remainder of ones
    r = _lane_remainders(buffer.reshape(-1, width))
    if len(r) > len(values):
        back = np.repeat(ends, lanes) - 1 - np.arange(len(r))  # lanes after this one
        at = (back % LANE) * 256
        r = _CHAIN[0][at + (r & 0xFF)] ^ _CHAIN[1][at + ((r >> 8) & 0xFF)] ^ _CHAIN[2][at + ((r >> 16) & 0xFF)] ^ _CHAIN[3][at + (r >> 24)]
        groups = -(-lanes // LANE)
        first = back % LANE == LANE - 1
        first[ends - lanes] = True
        parts, last = np.bitwise_xor.reduceat(r, np.flatnonzero(first)), np.cumsum(groups)
        r = parts[last - groups]
        for n in range(1, int(groups.max())):
            some = groups > n
            r[some] = _shifted(r[some], _SHIFT) ^ parts[(last - groups)[some] + n]
    return r ^ np.where(sizes < 4, _SHORT[np.minimum(sizes, 3)], 0).astype(np.uint32) ^ np.uint32(0xFFFFFFFF)


def _lane_remainders(rows: np.ndarray) -> np.ndarray:
    """The remainder of each row of at most LANE bytes, some rows at a time."""
    n, width = rows.shape
    out = np.empty(n, np.uint32)
    place = np.arange(LANE - width, LANE) * 256
    step = max((1 << 17) // width, 1)
    for at in range(0, n, step):
        found = _PLACE.take(rows[at : at + step] + place)
        while (w := found.shape[1]) > 1:
            half = w // 2
            rest = found[:, 2 * half :]
            found = found[:, :half] ^ found[:, half : 2 * half]
            if w % 2:
                found[:, :1] ^= rest
        out[at : at + step] = found[:, 0]
    return out


_BYTES = _BYTE.tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C of one value; one of a header's size is done before a batch would be set up."""
    if len(data) > 2 * LANE:
        return int(crc32c_many([data])[0])
    r = 0xFFFFFFFF
    for b in data:
        r = _BYTES[(r ^ b) & 0xFF] ^ (r >> 8)
    return r ^ 0xFFFFFFFF


def crc32c_column(payload: Column) -> Column:
    """CRC-32C of a binary column as a long; null for null."""

    def batch(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            values = c.to_pylist()
            crc = crc32c_many([v or b"" for v in values])
            yield pa.array([None if v is None else int(x) for v, x in zip(values, crc)], pa.int64())

    return F.arrow_udf(batch, T.LongType())(payload)
