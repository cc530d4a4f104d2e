"""Manifests, descriptors and state records: byte layouts declared as fields.

A ``Layout`` is a list of fields that one encoder and one decoder walk.  All
numbers are big-endian.  Decoding fails closed: a byte out of place, a bad
checksum, a rule of the content broken, or bytes left over are a FormatError.
``decoded`` and ``encoded`` are the column forms; a decoded row that fails has
its error named and no fields.

Defined cases: null bytes give null; numbers beyond a signed long are an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.crc import crc32c, crc32c_many
from strataweave.sources.chunks import CHUNK_HEADER, FormatError
from strataweave.sources.files import Files


@dataclass(frozen=True)
class Num:
    name: str
    width: int
    allowed: tuple = ()


@dataclass(frozen=True)
class Const:
    data: bytes


@dataclass(frozen=True)
class Raw:
    """Bytes of a fixed length; ``padded``: shorter values are filled with zeros, their length is ``Size``."""

    name: str
    length: int
    padded: bool = False


@dataclass(frozen=True)
class Size:
    """How many bytes, or items, the later field ``of`` has."""

    of: str
    width: int
    most: int


@dataclass(frozen=True)
class Data:
    name: str


@dataclass(frozen=True)
class Many:
    name: str
    fields: tuple


@dataclass(frozen=True)
class Sum:
    """A checksum of all bytes from ``start`` to here."""

    kind: str
    start: int = 0

    @property
    def width(self) -> int:
        return 4 if self.kind == "crc32c" else 32

    def of_many(self, data: list[bytes]) -> list[bytes]:
        if self.kind == "crc32c":
            return [x.to_bytes(4, "big") for x in (map(crc32c, data) if len(data) == 1 else crc32c_many(data).tolist())]
        return [hashlib.sha256(x).digest() for x in data]


def _rule(good: bool, what: str) -> None:
    if not good:
        raise FormatError(what)


@dataclass(frozen=True)
class Layout:
    name: str
    fields: tuple
    most: int
    check: Callable[[dict], None]
    to_wire: Callable[[dict], dict] = field(default=dict)
    from_wire: Callable[[dict], dict] = field(default=dict)
    #: ``check`` over columns, for a layout without repeated or padded fields: numbers, and lengths of bytes (-1: null), to whether each row is sound.
    sound: Callable[[dict], np.ndarray] | None = None
    empty_is_null: tuple = ()

    # ---- encoding

    def encode(self, values: dict) -> bytes:
        return self.encode_many([values])[0]

    def encode_many(self, values: list[dict]) -> list[bytes]:
        """Each value's bytes; a checksum is computed for all values at once."""
        outs, sums = [], []
        for v in values:
            self.check(v)
            out, at = bytearray(), []
            self._put(self.fields, self.to_wire(v), out, at)
            _rule(len(out) <= self.most, f"{self.name} is too large")
            outs.append(out)
            sums.append(at)
        for now in zip(*sums):  # a later checksum may cover an earlier one
            f = now[0][0]
            for out, (_, at), got in zip(outs, now, f.of_many([bytes(out[f.start : at]) for out, (_, at) in zip(outs, now)])):
                out[at : at + f.width] = got
        return [bytes(out) for out in outs]

    def _put(self, fields: tuple, values: dict, out: bytearray, sums: list) -> None:
        for f in fields:
            if isinstance(f, Const):
                out += f.data
            elif isinstance(f, Num):
                v = values[f.name]
                _rule(0 <= v < 1 << (8 * f.width) and (not f.allowed or v in f.allowed), f.name)
                out += v.to_bytes(f.width, "big")
            elif isinstance(f, Size):
                n = len(values[f.of] or b"")
                _rule(n <= f.most, f"{f.of} is too large")
                out += n.to_bytes(f.width, "big")
            elif isinstance(f, Raw):
                v = bytes(values[f.name])
                _rule(len(v) == f.length or (f.padded and len(v) < f.length), f.name)
                out += v + bytes(f.length - len(v))
            elif isinstance(f, Data):
                out += values[f.name] or b""
            elif isinstance(f, Many):
                for item in values[f.name]:
                    self._put(f.fields, item, out, sums)
            else:
                sums.append((f, len(out)))
                out += bytes(f.width)

    # ---- decoding

    def decode(self, data: bytes) -> dict:
        found = self.decode_many([data])[0]
        if isinstance(found, FormatError):
            raise found
        return found

    def decode_many(self, data: list[bytes]) -> list[dict | FormatError]:
        """Each value, or the first rule that its bytes break; a checksum is computed for all values at once."""
        found, sums = [], {}
        for n, x in enumerate(data):
            x, mine = bytes(x), []
            try:
                _rule(len(x) <= self.most, f"{self.name} is too large")
                values, at = self._take(self.fields, x, 0, mine)
                _rule(at == len(x), "trailing bytes")
                found.append(values)
            except FormatError as why:
                found.append(why)
            for f, at in mine:  # all before the byte that broke a rule
                sums.setdefault(f, []).append((n, x[f.start : at], x[at : at + f.width]))
        for f, some in sums.items():
            for (n, _, got), want in zip(some, f.of_many([part for _, part, _ in some])):
                if got != want:
                    found[n] = FormatError("checksum")
        for n, values in enumerate(found):
            if not isinstance(values, FormatError):
                try:
                    found[n] = self.from_wire(values)
                    self.check(found[n])
                except FormatError as why:
                    found[n] = why
        return found

    def _take(self, fields: tuple, data: bytes, at: int, sums: list) -> tuple[dict, int]:
        out, sizes = {}, {}

        def some(n: int) -> bytes:
            nonlocal at
            _rule(at + n <= len(data), "truncated")
            at += n
            return data[at - n : at]

        for f in fields:
            if isinstance(f, Const):
                _rule(some(len(f.data)) == f.data, "fixed bytes")
            elif isinstance(f, Num):
                out[f.name] = v = int.from_bytes(some(f.width), "big")
                _rule((not f.allowed or v in f.allowed) and v < 1 << 63, f.name)
            elif isinstance(f, Size):
                sizes[f.of] = n = int.from_bytes(some(f.width), "big")
                _rule(n <= f.most and n <= len(data), f"{f.of} is too large")
            elif isinstance(f, Raw):
                v = some(f.length)
                if f.padded:
                    _rule(sizes[f.name] <= f.length and not any(v[sizes[f.name] :]), f.name)
                    v = v[: sizes[f.name]]
                out[f.name] = v
            elif isinstance(f, Data):
                out[f.name] = some(sizes[f.name])
            elif isinstance(f, Many):
                out[f.name] = []
                for _ in range(sizes[f.name]):
                    item, at = self._take(f.fields, data, at, sums)
                    out[f.name].append(item)
            else:
                some(f.width)
                sums.append((f, at - f.width))
        return out, at

    # ---- columns

    def encode_columns(self, rows: pa.StructArray) -> pa.Array | None:
        """``encode_many`` over arrays, or None if a row is not plainly sound: the way by values then tells what it breaks."""
        n, numbers, data = len(rows), {}, {}
        if self.sound is None or not n or rows.null_count:
            return None
        for f in self.fields:
            if isinstance(f, Num):
                x = rows.field(f.name)
                if not pa.types.is_signed_integer(x.type) or x.null_count:
                    return None
                numbers[f.name] = x.cast(pa.int64()).to_numpy()
            elif isinstance(f, (Raw, Data)):
                x = rows.field(f.name)
                if x.type != pa.binary():
                    return None
                data[f.name] = *_bytes_of(x), x.is_null().to_numpy(zero_copy_only=False)
        lengths = {k: np.diff(at) * ~null for k, (_, at, null) in data.items()}
        good = self.sound(numbers | {k: np.where(null, -1, lengths[k]) for k, (_, _, null) in data.items()})
        wide = np.zeros(n, np.int64)
        for f in self.fields:
            if isinstance(f, Num):
                v = numbers[f.name]
                good &= (v >= 0) & (v >> min(8 * f.width, 63) == 0) & (np.isin(v, f.allowed) if f.allowed else True)
            elif isinstance(f, Size):
                good &= lengths[f.of] <= f.most
            elif isinstance(f, Raw):
                good &= lengths[f.name] == f.length
            wide += len(f.data) if isinstance(f, Const) else lengths[f.name] if isinstance(f, (Raw, Data)) else f.width
        if not (good & (wide <= self.most)).all() or wide.sum() > SLICE_BYTES:
            return None
        ends = np.concatenate([[0], np.cumsum(wide)])
        out, at = np.zeros(ends[-1], np.uint8), ends[:-1].copy()
        for f in self.fields:
            if isinstance(f, (Raw, Data)):
                some, start, _ = data[f.name]
                out[_runs(at, lengths[f.name])] = some[_runs(start[:-1], lengths[f.name])]
                at += lengths[f.name]
                continue
            if isinstance(f, Const):
                x = np.frombuffer(f.data, np.uint8)
            else:
                v = numbers[f.name] if isinstance(f, Num) else lengths[f.of] if isinstance(f, Size) else _sums(out, ends[:-1] + f.start, at)
                x = v.astype(">i8").view(np.uint8).reshape(n, 8)[:, 8 - f.width :]
            out[at[:, None] + np.arange(x.shape[-1])] = x
            at += x.shape[-1]
        return _binary(out, ends)

    def decode_columns(self, rows: pa.Array) -> pa.StructArray | None:
        """``decode_many`` over arrays, or None if a row is not plainly sound."""
        n, columns, sizes = len(rows), {}, {}
        if self.sound is None or not n or rows.null_count or rows.type != pa.binary():
            return None
        data, ends = _bytes_of(rows)
        at, end = ends[:-1].copy(), ends[1:]
        if (end - at > self.most).any() or len(data) > SLICE_BYTES:
            return None
        for f in self.fields:
            width = sizes[f.name] if isinstance(f, Data) else f.length if isinstance(f, Raw) else len(f.data) if isinstance(f, Const) else f.width
            if (at + width > end).any():
                return None
            if isinstance(f, Data):
                columns[f.name] = _binary(data[_runs(at, width)], np.concatenate([[0], np.cumsum(width)]))
            else:
                x = data[at[:, None] + np.arange(width)]
                v = np.zeros((n, 8), np.uint8)
                if isinstance(f, (Num, Size, Sum)):
                    v[:, 8 - width :] = x
                v = v.view(">i8")[:, 0].astype(np.int64)
                if isinstance(f, Const):
                    good = (x == np.frombuffer(f.data, np.uint8)).all()
                elif isinstance(f, Raw):
                    columns[f.name], good = _binary(x.ravel(), np.arange(n + 1) * width), True
                elif isinstance(f, Num):
                    columns[f.name], good = v, (v >= 0).all() and (not f.allowed or np.isin(v, f.allowed).all())
                elif isinstance(f, Size):
                    sizes[f.of], good = v, ((v >= 0) & (v <= f.most) & (v <= end - ends[:-1])).all()
                else:
                    good = (v == _sums(data, ends[:-1] + f.start, at)).all()
                if not good:
                    return None
            at += width
        lengths = {k: np.where(v == 0, -1, v) if k in self.empty_is_null else v for k, v in sizes.items()}
        if not (at == end).all() or not self.sound(columns | lengths).all():
            return None
        for k in self.empty_is_null:
            columns[k] = pa.compute.if_else(pa.array(sizes[k] > 0), columns[k], pa.scalar(None, pa.binary()))
        value = pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) if isinstance(columns[f.name], np.ndarray) else columns[f.name] for f in self.type], fields=list(self.type))
        return pa.StructArray.from_arrays([value, pa.nulls(n, pa.string())], ["value", "error"])

    def _types(self, fields: tuple) -> list[tuple[str, pa.DataType]]:
        out = []
        for f in fields:
            if isinstance(f, Num) and f.name != "flags":
                out.append((f.name, pa.int32() if f.width < 4 else pa.int64()))
            elif isinstance(f, (Raw, Data)):
                out.append((f.name, pa.binary()))
            elif isinstance(f, Many):
                out.append((f.name, pa.list_(pa.struct(self._types(f.fields)))))
        return out

    @property
    def type(self) -> pa.StructType:
        return pa.struct(self._types(self.fields))


def _bytes_of(x: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array and where each value begins, and the last ends."""
    _, at, data = x.buffers()
    at = np.frombuffer(at, np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _binary(data: np.ndarray, at: np.ndarray) -> pa.BinaryArray:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _runs(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``at`` and after, ``lengths`` of each."""
    ends = np.cumsum(lengths)
    return np.repeat(at - ends + lengths, lengths) + np.arange(ends[-1])


def _sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    whole = data.tobytes()
    return crc32c_many([whole[a:b] for a, b in zip(start.tolist(), end.tolist())]).astype(np.int64)


def _by_slices(batch: pa.Array, columns: Callable[[pa.Array], pa.Array | None], f: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    """``columns``, or where it gives None ``f`` over values, for so many rows at a time that checksums are computed together and few are Python objects at once."""
    slices = [batch.slice(at, SLICE) for at in range(0, max(len(batch), 1), SLICE)]
    return pa.concat_arrays([got.cast(kind) if (got := columns(x)) is not None else pa.array(f(x.to_pylist()), kind) for x in slices])


SLICE, SLICE_BYTES = 2048, 64 << 20


def decoded(data: Column, layout: Layout) -> Column:
    """struct(value, error) of binary values."""
    from pyspark.sql.pandas.types import from_arrow_type

    kind = pa.struct([("value", layout.type), ("error", pa.string())])

    def some(data: list) -> Iterator[dict | None]:
        found = iter(layout.decode_many([x for x in data if x is not None]))
        for x in data:
            v = None if x is None else next(found)
            yield None if x is None else {"value": None, "error": str(v)} if isinstance(v, FormatError) else {"value": v, "error": None}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _by_slices(batch, layout.decode_columns, lambda data: list(some(data)), kind)

    return F.arrow_udf(run, from_arrow_type(kind))(data)


def encoded(value: Column, layout: Layout) -> Column:
    """Binary values of structs; one that breaks a rule fails the job."""

    def some(values: list) -> list:
        found = iter(layout.encode_many([x for x in values if x is not None]))
        return [None if x is None else next(found) for x in values]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _by_slices(batch, layout.encode_columns, some, pa.binary())

    return F.arrow_udf(run, "binary")(value)


def read_files(spark: SparkSession, path: str, layout: Layout, glob: str = "*") -> DataFrame:
    """path, value, error of every manifest file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", decoded(F.col("content"), layout).alias("__d")).select("path", "__d.value", "__d.error")


def read_file(spark: SparkSession, path: str, layout: Layout) -> dict | None:
    data = Files(spark).read(path, layout.most)
    return None if data is None else layout.decode(data)


def write_file(spark: SparkSession, path: str, layout: Layout, values: dict) -> None:
    Files(spark).write(path, layout.encode(values))


def ensure_file(spark: SparkSession, path: str, layout: Layout, values: dict) -> bool:
    """Write it unless it is there; whether it was written. Another content there is an error."""
    data, files = layout.encode(values), Files(spark)
    try:
        files.write(path, data, new=True)
        return True
    except FileExistsError:
        _rule(files.read(path, layout.most) == data, "another manifest is there")
        return False


# ---- the layouts: fixed values ------------------------------------------------------


def _optional(values: dict) -> None:
    tags = [o["tag"] for o in values["optional_fields"]]
    _rule(0 not in tags and len(set(tags)) == len(tags), "optional field tags")


def _ascending(keys: list, what: str) -> None:
    _rule(all(a < b for a, b in zip(keys, keys[1:])), f"{what} are not in order")


REF_FOLDERS = {1: b"refs/heads/", 2: b"refs/tags/"}
ID_BYTES = {1: 20, 2: 32}


def _snapshot(v: dict) -> None:
    _rule(bool(v["tool_version"]), "tool_version")
    _rule(v["objects_written"] + v["objects_deduplicated"] == v["objects_seen"], "counters")
    for r in v["refs"]:
        _rule(bool(r["name"]) and bytes(r["name"]).startswith(REF_FOLDERS.get(r["kind"], b"\0")), "ref name")
        _rule(r["algorithm"] == v["native_object_format"] and len(r["target"]) == ID_BYTES[r["algorithm"]], "ref target")
    _ascending([bytes(r["name"]) for r in v["refs"]], "refs")
    _optional(v)


def _options(count_width: int, most_fields: int, most_bytes: int) -> tuple:
    return Size("optional_fields", count_width, most_fields), Many("optional_fields", (Num("tag", 2), Size("value", 4, most_bytes), Data("value")))


_SNAPSHOT_COUNT, _SNAPSHOT_MANY = _options(4, (1 << 32) - 1, 4 << 20)
SNAPSHOT = Layout("snapshot manifest", (
    Const(b"RFSNAP\0\0\0\x01"), Raw("repository", 16), Raw("snapshot_id", 16), Num("native_object_format", 1, (1, 2)), Num("import_policy", 1, (1,)), Const(b"\0\0"),
    Num("imported_unix_secs", 8), Num("objects_seen", 8), Num("objects_written", 8), Num("objects_deduplicated", 8), Num("raw_bytes", 8),
    Size("tool_version", 2, 64 << 10), Size("refs", 4, (1 << 32) - 1), _SNAPSHOT_COUNT, Data("tool_version"),
    Many("refs", (Num("kind", 1, (1, 2)), Size("name", 2, 64 << 10), Data("name"), Num("algorithm", 1, (1, 2)), Size("target", 1, 32), Data("target"))), _SNAPSHOT_MANY,
), 16 << 20, _snapshot)

COUNTERS = ("directories", "regular_files", "executable_files", "symlinks", "gitlinks", "reflinked_regular_files", "copied_regular_files")
WORKSPACE_NAME = r"[A-Za-z0-9_-]{1,128}"


def _workspace(v: dict) -> None:
    _rule(re.fullmatch(WORKSPACE_NAME.encode(), bytes(v["name"])) is not None, "name")
    _rule(len(v["commit"]) == ID_BYTES.get(v["algorithm"]), "commit")
    _rule(v["copied_regular_files"] + v["reflinked_regular_files"] == v["regular_files"] + v["executable_files"], "counters")
    _optional(v)


WORKSPACE = Layout("workspace manifest", (
    Const(b"RFWORK\0\0\0\x01"), Raw("workspace_id", 16), Raw("repository", 16), Raw("snapshot_id", 16), Num("algorithm", 1, (1, 2)), Size("commit", 1, 32), Raw("commit", 32, padded=True),
    Num("generation", 4), Num("created_unix_secs", 8), Size("name", 2, 128), Data("name"), *[Num(c, 8) for c in COUNTERS], *_options(2, 128, 16 << 10),
), 64 << 10, _workspace)


def path_is_canonical(path: bytes) -> bool:
    """Relative, of whole components, none of them empty, ``.`` or ``..``, and UTF-8 without NUL."""
    try:
        path.decode()
    except UnicodeDecodeError:
        return False
    return bool(path) and b"\0" not in path and all(c not in (b"", b".", b"..") for c in path.split(b"/"))


def _backup(v: dict) -> None:
    paths = [bytes(f["path"]) for f in v["files"]]
    _rule(all(map(path_is_canonical, paths)), "path")
    _ascending(paths, "paths")


BACKUP = Layout("backup manifest", (
    Const(b"RFBKMAN1"), Size("files", 8, 1_000_000), Many("files", (Size("path", 4, 1 << 20), Data("path"), Num("bytes", 8), Raw("sha256", 32))), Sum("sha256"),
), 64 << 20, _backup)


def _cold(v: dict) -> None:
    _ascending([(c["generation"], c["chunk_id"]) for c in v["chunks"]], "chunks")
    _rule(all(c["valid_prefix"] >= CHUNK_HEADER for c in v["chunks"]), "valid_prefix")


COLD = Layout("cold-tier descriptor", (
    Const(b"RFCOLD01\0\x01"), Num("catalog_schema_version", 4), Num("active_generation", 4), Size("chunks", 4, 1_000_000),
    Many("chunks", (Num("generation", 4), Num("chunk_id", 8), Num("classification", 1, (1, 2)), Const(b"\0\0\0"), Num("valid_prefix", 8))),
    Raw("catalog_digest", 32), Raw("config_digest", 32), Raw("pins_manifest_digest", 32), Sum("sha256"),
), 24 + 24 * 1_000_000 + 128, _cold)


def _job(v: dict) -> None:
    _rule(bool(v["kind"]), "kind")
    _rule(v["last_error"] is None or len(v["last_error"]) > 0, "last_error")
    _rule(v["state"] == 1 or v["attempts"] > 0, "attempts")
    _rule((v["state"] != 3 or v["last_error"] is None) and (v["state"] != 4 or v["last_error"] is not None), "last_error")


def _jobs_sound(v: dict) -> np.ndarray:
    state, late = v["state"], v["last_error"]
    return (v["kind"] > 0) & (late != 0) & ((state == 1) | (v["attempts"] > 0)) & ((state != 3) | (late < 0)) & ((state != 4) | (late > 0))


JOB = Layout("job record", (
    Const(b"\x01"), Num("state", 1, (1, 2, 3, 4)), Const(b"RFSJOBv1"), Raw("id", 16), Num("attempts", 4), Size("kind", 4, 64 << 20), Size("payload", 8, 64 << 20), Size("last_error", 4, 64 << 20),
    Sum("crc32c"), Data("kind"), Data("payload"), Data("last_error"), Sum("crc32c", 50),
), 64 << 20, _job, from_wire=lambda v: v | {"last_error": v["last_error"] or None}, sound=_jobs_sound, empty_is_null=("last_error",))

MIN_INTERVAL, MAX_INTERVAL, MAX_FAILURES = 60, 366 * 86_400, 1_000_000
IDLE, RUNNING = 1, 2
_TIMES = ("last_started", "last_completed")


def _scrub(v: dict) -> None:
    _rule(MIN_INTERVAL <= v["interval"] <= MAX_INTERVAL, "interval")
    _rule(v["run_state"] != RUNNING or v["last_started"] is not None, "last_started")
    _rule(v["consecutive_failures"] <= MAX_FAILURES, "consecutive_failures")


def _scrub_from(v: dict) -> dict:
    flags = v["flags"]
    _rule(all(flags >> n & 1 or not v[t] for n, t in enumerate(_TIMES)), "a time without its flag")
    return {k: x for k, x in v.items() if k != "flags"} | {t: v[t] if flags >> n & 1 else None for n, t in enumerate(_TIMES)}


SCRUB = Layout("scrub schedule", (
    Const(b"\x01"), Num("run_state", 1, (IDLE, RUNNING)), Num("flags", 1, (0, 1, 2, 3)), Const(b"\0RFSSCRB1"), Num("interval", 8), Num("next_due", 8), Num("last_started", 8), Num("last_completed", 8),
    Num("consecutive_failures", 4), Num("recovered_interrupted_runs", 8), Const(bytes(4)), Sum("crc32c"),
), 64, _scrub, lambda v: v | {"flags": sum((v[t] is not None) << n for n, t in enumerate(_TIMES))} | {t: v[t] or 0 for t in _TIMES}, _scrub_from)


def _migration(v: dict) -> None:
    _rule(0 < v["from_version"] < v["to_version"], "versions")
    _rule(v["transition_count"] > 0, "transition_count")


COPYING, VALIDATING, PUBLISHED = 1, 2, 3
MIGRATION = Layout("migration record", (
    Const(b"\x01"), Num("state", 1, (COPYING, VALIDATING, PUBLISHED)), Const(b"\0\0RFSMIGR1"), Num("from_version", 2), Num("to_version", 2), Raw("id", 16), Num("transition_count", 8), Const(bytes(20)), Sum("crc32c"),
), 64, _migration)

LAYOUTS = {"snapshot": SNAPSHOT, "workspace": WORKSPACE, "backup": BACKUP, "cold": COLD, "job": JOB, "scrub": SCRUB, "migration": MIGRATION}


def workspace_name_is_valid(name: Column) -> Column:
    return F.coalesce(name.rlike(rf"\A{WORKSPACE_NAME}\z"), F.lit(False))
