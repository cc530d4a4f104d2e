"""Media columns from ISO base media containers.

The reader walks the nested boxes of a container and decodes its sample tables
(``stts``, ``stsc``, ``stsz``/``stz2``, ``stco``/``co64``, ``stss``) into codec,
duration and the byte ranges of the key frames.  Sample payloads are never
decoded, and box bodies are looked at only where a table needs them.

The writer stores raw bytes losslessly as such a container: one video track of
uncompressed 8 by 8 RGB frames of 8-bit samples (``raw ``, 192 bytes each), so
arbitrary bytes padded with spaces to a multiple of 192 can be read back
through the tables.

Both work row by row inside Arrow batches; memory is one batch.  Defined cases:
a null container gives null columns; malformed, truncated or empty bytes give
``error`` and no track; equal bytes give equal columns; boxes of unknown type
are skipped; 64-bit and to-the-end sizes are followed; a payload of no bytes is
stored as one frame of spaces.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FRAME = 192
TIMESCALE = 25
#: Boxes whose bodies are boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}

TRACK = T.StructType([
    T.StructField("track_id", T.LongType()), T.StructField("handler", T.StringType()), T.StructField("codec", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("n_samples", T.LongType()),
    T.StructField("sample_bytes", T.LongType()), T.StructField("n_keyframes", T.LongType()),
    T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
MEDIA = T.StructType([
    T.StructField("brand", T.StringType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("tracks", T.ArrayType(TRACK)), T.StructField("error", T.StringType()),
])


class Malformed(ValueError):
    """The container breaks its own structure."""


# ---- writer -----------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes, frame: int = FRAME) -> bytes:
    """Spaces up to a positive multiple of the frame size."""
    return data + b" " * (-len(data) % frame or (0 if data else frame))


def container(payload: bytes, frame: int = FRAME, timescale: int = TIMESCALE) -> bytes:
    """A container whose samples are the frames of ``payload``; every frame is a key frame."""
    n = len(payload) // frame
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = struct.pack(">I4s6xH16xHHIIIH32sHh", 86, b"raw ", 1, 8, 8, 0x480000, 0x480000, 0, 1, b"", 24, -1)
    head = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    mdat = struct.pack(">I4s", 8 + len(payload), b"mdat") if len(payload) < 0xFFFFFFF0 else struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    offset = len(head) + len(mdat)
    table = _box(
        b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), _full(b"stsz", struct.pack(">II", frame, n)), _full(b"stco", struct.pack(">II", 1, offset)),
    )
    refer = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    media = _box(
        b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, n, 0x55C4, 0)),
        _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), _box(b"minf", _full(b"vmhd", bytes(8), flags=1), refer, table),
    )
    track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), matrix, struct.pack(">II", 8 << 16, 8 << 16), flags=3), media)
    movie = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, timescale, n, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
    return head + mdat + payload + _box(b"moov", movie, track)


# ---- reader -----------------------------------------------------------------


def boxes(data, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes that lie in data[start:end]."""
    while start < end:
        if end - start < 8:
            raise Malformed("box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Malformed("box size is cut off")
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise Malformed(f"box {kind!r} does not fit")
        yield kind, body, start + size
        start += size


def _table(data, at: tuple[int, int], dtype: str, head: int = 0):
    """The entries of a full box: a count, then so many of ``dtype``; head bytes stand before the count."""
    import numpy as np

    start, end = at[0] + 4 + head, at[1]
    if end - start < 4:
        raise Malformed("table is cut off")
    n = struct.unpack_from(">I", data, start)[0]
    kind = np.dtype(dtype)
    if n * kind.itemsize > end - start - 4:
        raise Malformed("table is shorter than its count")
    return np.frombuffer(data, kind, n, start + 4)


class _Track:
    """The tables of one ``trak`` box, decoded to sample offsets and sizes."""

    def __init__(self, data, start: int, end: int) -> None:
        self.data, self.at = data, {}
        self._walk(start, end)

    def _walk(self, start: int, end: int) -> None:
        for kind, a, b in boxes(self.data, start, end):
            if kind in NESTED:
                self._walk(a, b)
            else:
                self.at.setdefault(kind, (a, b))

    def _need(self, kind: bytes, least: int) -> tuple[int, int]:
        if kind not in self.at or self.at[kind][1] - self.at[kind][0] < least:
            raise Malformed(f"no whole {kind.decode('latin-1')} box")
        return self.at[kind]

    def samples(self):
        """Offset and size of every sample, in decoding order."""
        import numpy as np

        sizes = self.sizes()
        if b"co64" in self.at:
            chunks = _table(self.data, self.at[b"co64"], ">u8").astype(np.int64)
        else:
            chunks = _table(self.data, self._need(b"stco", 8), ">u4").astype(np.int64)
        runs = _table(self.data, self._need(b"stsc", 8), ">u4,>u4,>u4")
        first = np.append(runs["f0"].astype(np.int64), len(chunks) + 1)
        per_chunk = np.repeat(runs["f1"].astype(np.int64), np.maximum(np.diff(first), 0))
        if len(per_chunk) != len(chunks) or per_chunk.sum() != len(sizes):
            raise Malformed("chunks and samples disagree")
        begin = np.cumsum(per_chunk) - per_chunk
        before = np.cumsum(sizes) - sizes
        base = np.repeat(chunks - (before[begin] if len(sizes) else 0), per_chunk) if len(sizes) else sizes
        offsets = base + before
        if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(self.data)):
            raise Malformed("a sample lies outside the container")
        return offsets, sizes

    def sizes(self):
        import numpy as np

        if b"stz2" in self.at:
            a, b = self._need(b"stz2", 12)
            field, n = struct.unpack_from(">xxxBI", self.data, a + 4)
            raw = np.frombuffer(self.data, np.uint8, b - a - 12, a + 12)
            wide = {4: np.stack([raw >> 4, raw & 15], 1).ravel(), 8: raw, 16: raw[: len(raw) // 2 * 2].view(">u2")}
            if field not in wide or len(wide[field]) < n:
                raise Malformed("stz2 is cut off")
            return wide[field][:n].astype(np.int64)
        a, _ = self._need(b"stsz", 12)
        fixed, n = struct.unpack_from(">II", self.data, a + 4)
        if fixed:
            if n * fixed > len(self.data):
                raise Malformed("samples are larger than the container")
            return np.full(n, fixed, np.int64)
        return _table(self.data, self.at[b"stsz"], ">u4", head=4).astype(np.int64)

    def described(self) -> dict:
        import numpy as np

        data = self.data
        a, b = self._need(b"tkhd", 20)
        track = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        a, b = self._need(b"mdhd", 20)
        scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 and b - a >= 32 else struct.unpack_from(">II", data, a + 12)
        a, b = self._need(b"hdlr", 12)
        handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
        a, b = self._need(b"stsd", 16)
        codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
        width = height = None
        if handler == "vide" and b - a >= 44:
            width, height = struct.unpack_from(">HH", data, a + 40)
        offsets, sizes = self.samples()
        ticks = _table(data, self._need(b"stts", 8), ">u4,>u4")
        if int(ticks["f0"].astype(np.int64).sum()) != len(sizes):
            raise Malformed("times and samples disagree")
        duration = duration or int((ticks["f0"].astype(np.int64) * ticks["f1"].astype(np.int64)).sum())
        keys = _table(data, self.at[b"stss"], ">u4").astype(np.int64) - 1 if b"stss" in self.at else np.arange(len(sizes))
        if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
            raise Malformed("a key frame is no sample")
        start, end = offsets[keys], offsets[keys] + sizes[keys]
        # neighbours in the file are one range
        cut = np.flatnonzero(start[1:] != end[:-1]) + 1
        ranges = zip(start[np.append(0, cut)].tolist(), end[np.append(cut - 1, len(end) - 1)].tolist()) if len(keys) else ()
        return {
            "track_id": track, "handler": handler, "codec": codec, "width": width, "height": height, "timescale": scale, "duration": duration,
            "n_samples": len(sizes), "sample_bytes": int(sizes.sum()), "n_keyframes": len(keys), "keyframes": [{"start": s, "end": e} for s, e in ranges],
        }


def _tracks(data) -> tuple[str | None, list[_Track]]:
    brand, found, seen = None, [], False
    for kind, a, b in boxes(data, 0, len(data)):
        if kind == b"ftyp" and b - a >= 4:
            brand = bytes(data[a : a + 4]).decode("latin-1")
        elif kind == b"moov":
            seen = True
            found += [_Track(data, x, y) for k, x, y in boxes(data, a, b) if k == b"trak"]
    if not seen:
        raise Malformed("no moov box")
    return brand, found


def described(data: bytes | None) -> dict | None:
    """The media columns of one container; errors become the ``error`` column."""
    if data is None:
        return None
    try:
        brand, tracks = _tracks(data)
        rows = [t.described() for t in tracks]
        seconds = max((r["duration"] / r["timescale"] for r in rows if r["timescale"]), default=0.0)
        return {"brand": brand, "seconds": seconds, "tracks": rows, "error": None}
    except (Malformed, struct.error, IndexError) as why:
        return {"brand": None, "seconds": None, "tracks": [], "error": str(why)}


def payload(data: bytes, track: int = 0) -> bytes:
    """The stored samples of a track, read through its tables."""
    offsets, sizes = _tracks(data)[1][track].samples()
    if not len(sizes):
        return b""
    end = offsets + sizes
    cut = [0, *((offsets[1:] != end[:-1]).nonzero()[0] + 1).tolist(), len(sizes)]
    return b"".join(data[offsets[i] : end[j - 1]] for i, j in zip(cut, cut[1:]))


# ---- DataFrame operators ----------------------------------------------------


def _each(f, kind):
    def batch(it: Iterator) -> Iterator:
    
        for column in it:
            yield pa.array([f(x) for x in column.to_pylist()], kind)

    return batch


def store_media(raw: Column) -> Column:
    """Binary column: the padded bytes as a container."""
    def store(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(lambda x: None if x is None else container(padded(x)), pa.binary())(it)

    return F.arrow_udf(store, T.BinaryType())(raw)


def media_columns(media: Column) -> Column:
    """Struct column: brand, seconds, tracks and error of each container."""
    kind = to_arrow_type(MEDIA)

    def read(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(described, kind)(it)

    return F.arrow_udf(read, MEDIA)(media)


def read_payload(media: Column) -> Column:
    """Binary column: the samples of the first track; null where the container is malformed."""

    def read(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(x):
            try:
                return None if x is None else payload(x)
            except (Malformed, struct.error, IndexError):
                return None

        yield from _each(one, pa.binary())(it)

    return F.arrow_udf(read, T.BinaryType())(media)


def with_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the container of each whole text (null: empty) as a binary column."""
    return df.withColumn(media, store_media(F.coalesce(F.col(text), F.lit("")).cast("binary")))


#: Bytes of the containers that one output batch may hold, or one row.
OUT_BYTES = 4 << 20


def stored_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One pass: key, n_bytes, media, m (the media columns), and payload, read back from the container.

    Same as ``with_media``, ``media_columns`` and ``read_payload`` one after
    another, with no more than ``OUT_BYTES`` of containers held at a time.
    """
    fields = [df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("m", MEDIA), T.StructField("payload", T.BinaryType())]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.name for f in fields])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for ident, raw in zip(batch.column(0), batch.column(1)):
                raw = raw.as_py() or b""
                media = container(padded(raw))
                rows.append((ident.as_py(), len(raw), media, described(media), payload(media)))
                size += len(media)
                if size > OUT_BYTES:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    return df.select(key, F.col(text).cast("binary").alias("__raw")).mapInArrow(store, T.StructType(fields))
