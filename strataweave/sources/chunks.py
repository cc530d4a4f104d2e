"""Chunk files: append-only record files with headers, checksums and a seal.

A file is a header of 64 bytes, records, and, once sealed, a footer of 64 bytes.
A record is a header of 128 bytes, the stored payload, a footer of 20 bytes and
zeros up to a multiple of 8.  All numbers are big-endian.

``scan`` reads files that ``binaryFile`` (any Hadoop store) or a table delivers
as (path, content), one file a row, and yields its records in bounded batches.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import islice
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.crc import crc32c, crc32c_many
from strataweave.functions.identity import DOMAIN, KINDS
from strataweave.sources.files import Files

# Fixed values of the format.
CHUNK_MAGIC, SEAL_MAGIC, RECORD_MAGIC, END_MAGIC = b"RFSCHNK\0", b"RFSSEAL\0", b"ROBJ", b"RENDOBJ\0"
VERSION, CHUNK_HEADER, SEAL, RECORD_HEADER, RECORD_FOOTER, ALIGN = 1, 64, 64, 128, 20, 8
MAX_RECORD = 64 << 20
CODECS = {"raw": 0, "zstd": 1}
LEVEL, WINDOW_LOG = 3, 23

_CHUNK = struct.Struct(">8sHHIQQII24s")
_SEAL = struct.Struct(">8sHHIQQ")
_RECORD = struct.Struct(">4sHHBBHQQ32sBB32sI30s")
_FOOTER = struct.Struct(">IQ8s")


class FormatError(ValueError):
    """Bytes that break the format; the message names the first rule broken."""


@dataclass
class Record:
    kind: int
    codec: int
    flags: int
    raw_length: int
    content_id: bytes
    algorithm: int
    oid: bytes
    payload: bytes
    #: The payload's checksum, once decoding has computed it.
    payload_crc32c: int | None = field(default=None, compare=False, repr=False)


def content_digest(kind: int, raw: bytes, domain: str = DOMAIN) -> bytes:
    return hashlib.sha256(domain.encode() + bytes([0, kind]) + len(raw).to_bytes(8, "big") + raw).digest()


def native_digest(kind: int, raw: bytes, algorithm: int = 1) -> bytes:
    name = next(k for k, v in KINDS.items() if v == kind)
    return hashlib.new({1: "sha1", 2: "sha256"}[algorithm], f"{name} {len(raw)}\0".encode() + raw).digest()


def stored(raw: bytes, codec: int) -> bytes:
    """The payload as the codec stores it."""
    if codec == CODECS["raw"]:
        return raw
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=WINDOW_LOG, write_checksum=True, write_content_size=True)
    return zstandard.ZstdCompressor(compression_params=params).compress(raw)


def restored(record: Record, domain: str = DOMAIN) -> bytes:
    """The raw object of a record, its length and identity checked."""
    if record.codec == CODECS["raw"]:
        raw = record.payload
    else:
        import zstandard

        reader = zstandard.ZstdDecompressor(max_window_size=1 << WINDOW_LOG).decompressobj()
        try:
            raw = reader.decompress(record.payload)
        except zstandard.ZstdError as why:
            raise FormatError("damaged frame") from why
        if not reader.eof or reader.unused_data:
            raise FormatError("not exactly one frame")
    if len(raw) != record.raw_length:
        raise FormatError("raw length")
    if content_digest(record.kind, raw, domain) != record.content_id:
        raise FormatError("content id")
    return raw


def object_record(raw: bytes, kind: str = "blob", codec: str = "raw", algorithm: int = 1, domain: str = DOMAIN) -> Record:
    k = KINDS[kind]
    return Record(k, CODECS[codec], 0, len(raw), content_digest(k, raw, domain), algorithm, native_digest(k, raw, algorithm), stored(raw, CODECS[codec]))


def record_length(stored_length: int) -> int:
    return -(-(RECORD_HEADER + stored_length + RECORD_FOOTER) // ALIGN) * ALIGN


def encode_records(records: list[Record]) -> list[bytes]:
    """Whole records; checksums of all are computed together."""
    heads = [_RECORD.pack(RECORD_MAGIC, VERSION, RECORD_HEADER, r.kind, r.codec, r.flags, r.raw_length, len(r.payload), r.content_id, r.algorithm, len(r.oid), r.oid, 0, b"") for r in records]
    sums = crc32c_many(heads + [r.payload for r in records])
    out = []
    for i, r in enumerate(records):
        head = heads[i][:94] + int(sums[i]).to_bytes(4, "big") + heads[i][98:]
        total = RECORD_HEADER + len(r.payload) + RECORD_FOOTER
        out.append(head + r.payload + _FOOTER.pack(int(sums[len(records) + i]), total, END_MAGIC) + bytes(-total % ALIGN))
    return out


def _outline(data: bytes, at: int) -> tuple[Record, int, str | None, str | None]:
    """The header's fields, and the first structural rule broken before and after the header's checksum."""
    if len(data) - at < RECORD_HEADER:
        raise FormatError("truncated")
    magic, version, length, kind, codec, flags, raw, size, cid, algorithm, oid_length, oid, _, rest = _RECORD.unpack_from(data, at)
    before = ((magic == RECORD_MAGIC, "magic"), (version == VERSION, "version"), (length == RECORD_HEADER, "header length"))
    after = ((not any(rest), "reserved bytes"), (kind in KINDS.values(), "kind"), (codec in CODECS.values(), "codec"), ({1: 20, 2: 32}.get(algorithm) == oid_length, "object id"))
    first = lambda checks: next((what for good, what in checks if not good), None)
    return Record(kind, codec, flags, raw, cid, algorithm, oid[:oid_length], b""), size, first(before), first(after)


def _summed_header(data: bytes, at: int) -> bytes:
    return data[at : at + 94] + bytes(4) + data[at + 98 : at + RECORD_HEADER]


def decode_record(data: bytes, at: int = 0, end: int | None = None) -> tuple[Record, int]:
    """The record at ``at`` and its whole length; an error names the first rule it breaks."""
    end = len(data) if end is None else end
    record, size, before, after = _outline(data[:end] if end - at < RECORD_HEADER else data, at)
    good = int.from_bytes(data[at + 94 : at + 98], "big") == crc32c(_summed_header(data, at))
    total = RECORD_HEADER + size + RECORD_FOOTER
    what = before or (None if good else "header checksum") or after or ("record too long" if total > MAX_RECORD else None) or ("truncated" if at + record_length(size) > end else None)
    if what:
        raise FormatError(what)
    record.payload = bytes(data[at + RECORD_HEADER : at + RECORD_HEADER + size])
    crc, length, mark = _FOOTER.unpack_from(data, at + total - RECORD_FOOTER)
    for good, what in (
        (length == total, "record length"), (mark == END_MAGIC, "footer magic"), (crc == crc32c(record.payload), "payload checksum"),
        (not any(data[at + total : at + record_length(size)]), "padding"),
    ):
        if not good:
            raise FormatError(what)
    record.payload_crc32c = crc
    return record, record_length(size)


def decode_many(data: bytes, start: int, end: int) -> tuple[list[tuple[int, Record]], int, str | None]:
    """All whole records of data[start:end] up to the first bad one, where they end, and what is wrong there.

    Lengths are followed first, then the checksums of all records are computed
    together, and the record that breaks a rule is decoded alone for its error.
    """
    found, spans, at = [], [], start
    while end - at >= RECORD_HEADER:
        record, size, before, after = _outline(data, at)
        whole = record_length(size)
        if before or after or RECORD_HEADER + size + RECORD_FOOTER > MAX_RECORD or at + whole > end:
            break
        record.payload = bytes(data[at + RECORD_HEADER : at + RECORD_HEADER + size])
        found.append((at, record))
        spans.append((at, size, whole))
        at += whole
    sums = crc32c_many([_summed_header(data, a) for a, _, _ in spans] + [r.payload for _, r in found])
    n = len(found)
    for i, (a, size, whole) in enumerate(spans):
        total = RECORD_HEADER + size + RECORD_FOOTER
        crc, length, mark = _FOOTER.unpack_from(data, a + total - RECORD_FOOTER)
        head = int.from_bytes(data[a + 94 : a + 98], "big")
        if (head, crc, length, mark) != (int(sums[i]), int(sums[n + i]), total, END_MAGIC) or any(data[a + total : a + whole]):
            found, at = found[:i], a
            break
        found[i][1].payload_crc32c = crc
    if at >= end:
        return found, at, None
    try:
        decode_record(data, at, end)
    except FormatError as why:
        return found, at, str(why)
    raise AssertionError("a record is good alone and bad among others")


def chunk_header(generation: int, chunk_id: int, created: int = 0, flags: int = 0) -> bytes:
    head = _CHUNK.pack(CHUNK_MAGIC, VERSION, CHUNK_HEADER, generation, chunk_id, created, flags, 0, b"")
    return head[:36] + crc32c(head).to_bytes(4, "big") + head[40:]


def decode_chunk_header(data: bytes) -> tuple[int, int, int, int]:
    if len(data) < CHUNK_HEADER:
        raise FormatError("truncated")
    magic, version, length, generation, chunk_id, created, flags, crc, rest = _CHUNK.unpack_from(data)
    for good, what in (
        (magic == CHUNK_MAGIC, "magic"), (version == VERSION, "version"), (length == CHUNK_HEADER, "header length"),
        (crc == crc32c(data[:36] + bytes(4) + data[40:CHUNK_HEADER]), "header checksum"), (not any(rest), "reserved bytes"),
    ):
        if not good:
            raise FormatError(what)
    return generation, chunk_id, created, flags


def seal(records: bytes, count: int, crc: int | None = None) -> bytes:
    """The footer of a sealed file with these record bytes; ``crc`` is their checksum, if it is known."""
    head = struct.pack(">8sHHQQI", SEAL_MAGIC, VERSION, SEAL, count, CHUNK_HEADER + len(records) + SEAL, crc32c(records) if crc is None else crc)
    head += bytes(SEAL - len(head))
    return head[:32] + crc32c(head).to_bytes(4, "big") + head[36:]


def decode_seal(data: bytes) -> tuple[int, int, int]:
    """Record count, file length and checksum of the records."""
    if len(data) != SEAL:
        raise FormatError("truncated")
    magic, version, length, count, final, crc = struct.unpack_from(">8sHHQQI", data)
    own = int.from_bytes(data[32:36], "big")
    for good, what in (
        (magic == SEAL_MAGIC, "magic"), (version == VERSION, "version"), (length == SEAL, "footer length"),
        (own == crc32c(data[:32] + bytes(4) + data[36:]), "footer checksum"), (not any(data[36:]), "reserved bytes"),
    ):
        if not good:
            raise FormatError(what)
    return count, final, crc


def chunk_file(records: list[Record], generation: int, chunk_id: int, sealed: bool = True) -> bytes:
    return chunk_files([(records, chunk_id)], generation, sealed)[0]


def chunk_files(files: list[tuple[list[Record], int]], generation: int, sealed: bool = True) -> list[bytes]:
    """Whole files of (records, chunk id); checksums of all are computed together."""
    data = iter(encode_records([r for records, _ in files for r in records]))
    bodies = [b"".join(islice(data, len(records))) for records, _ in files]
    sums = crc32c_many(bodies).tolist() if sealed else []
    return [chunk_header(generation, n) + body + (seal(body, len(records), sums[i]) if sealed else b"") for i, ((records, n), body) in enumerate(zip(files, bodies))]


@dataclass
class Scan:
    """What a scan of one file found: where records end, and what stopped it."""

    records: int = 0
    end: int = CHUNK_HEADER
    sealed: bool = False
    error: str | None = None
    #: The record that stopped it is whole, but its object is not what it says.
    whole: bool = False


def scan_file(data: bytes, sealed: bool, strict: bool, verify: bool = False, domain: str = DOMAIN) -> Iterator[tuple[int, Record] | Scan]:
    """(offset, record) of each record, then the Scan.

    Strict: the first bad record, or a seal that doesn't agree, is an error.
    Lenient: a bad tail of an open file ends the records, and is what recovery
    cuts off.
    """
    decode_chunk_header(data[:CHUNK_HEADER])
    stop = len(data) - SEAL if sealed else len(data)
    found, end, error = decode_many(data, CHUNK_HEADER, stop)
    out = Scan(len(found), end, sealed, error)
    for i, (at, record) in enumerate(found):
        if verify:
            try:
                restored(record, domain)
            except FormatError as why:
                out.records, out.end, out.error, out.whole = i, at, str(why), True
                break
        yield at, record
    if out.error and strict:
        raise FormatError(out.error)
    if sealed and out.error is None:
        count, final, crc = decode_seal(data[stop:])
        for good, what in ((count == out.records, "record count"), (final == len(data), "file length"), (crc == crc32c(data[CHUNK_HEADER:stop]), "records checksum")):
            if not good:
                if strict:
                    raise FormatError(what)
                out.error = what
    yield out


RECORDS = "path string, generation long, chunk_id long, offset long, record_length long, kind byte, codec byte, flags int, raw_length long, stored_length long, content_id binary, algorithm byte, oid binary, payload_crc32c long, payload binary"
BATCH_BYTES = 8 << 20


def scan(files: DataFrame, strict: bool = True, payload: bool = True) -> DataFrame:
    """Records of chunk files given as (path, content); files named ``.sealed`` must carry a seal."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.int8(), pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int8(), pa.binary(), pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                generation, chunk_id, _, _ = decode_chunk_header(data)
                rows, size = [], 0
                for found in scan_file(data, path.endswith(".sealed"), strict):
                    if isinstance(found, Scan):
                        continue
                    at, r = found
                    rows.append((path, generation, chunk_id, at, record_length(len(r.payload)), r.kind, r.codec, r.flags, r.raw_length, len(r.payload), r.content_id, r.algorithm, r.oid, r.payload_crc32c, r.payload if payload else None))
                    size += len(r.payload)
                    if size > BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return files.select("path", "content").mapInArrow(read, RECORDS)


def read_chunks(spark: SparkSession, root: str, **options) -> DataFrame:
    """Records of all chunk files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{open,sealed}").load(root)
    return scan(files, **options)


def reports(files: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """Per file: records, retained and cut bytes, and what recovery or verification does about it.

    A whole record of an open file whose object doesn't agree with its identity
    is rejected, never cut off: with another ``domain`` it may be good.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, sealed = content.as_py(), path.endswith(".sealed")
                try:
                    last = Scan()
                    for last in scan_file(data, sealed, strict=False, verify=True, domain=domain):  # noqa: B007
                        pass
                except FormatError as why:
                    last = Scan(0, 0, sealed, str(why))
                has_seal = not sealed and last.error is not None and data[last.end : last.end + 8] == SEAL_MAGIC and len(data) - last.end == SEAL
                action = "publish_seal" if has_seal else "none" if last.error is None else "reject" if sealed or not last.end or last.whole else "truncate"
                rows.append((path, last.records, last.end, len(data) - last.end - (SEAL if sealed or has_seal else 0), last.error, action))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["path", "records", "retained_bytes", "cut_bytes", "error", "action"])

    return files.select("path", "content").mapInArrow(report, "path string, records long, retained_bytes long, cut_bytes long, error string, action string")


def build(objects: DataFrame, by: str, chunk: str, order: str, payload: str, generation: int = 1, codec: str = "raw", domain: str = DOMAIN) -> DataFrame:
    """(path, content) of sealed files, one per (by, chunk); a file is bounded by the target of its rotation.

    A task gets the objects of its files in order, as a stream, and encodes
    those of several files together: about BATCH_BYTES and one file are held.
    """

    def encode(files: list[tuple[str | None, int, list[Record]]]) -> pa.RecordBatch:
        names = [f"{a}/{n:020d}.sealed" for a, n, _ in files]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(chunk_files([(r, n) for _, n, r in files], generation), pa.binary())], ["path", "content"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, size = [], 0
        for batch in batches:
            for a, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if not files or files[-1][:2] != (a, n):
                    if size > BATCH_BYTES:
                        yield encode(files)
                        files, size = [], 0
                    files.append((a, n, []))
                files[-1][2].append(object_record(x.as_py(), codec=codec, domain=domain))
                size += record_length(len(files[-1][2][-1].payload))
        if files:
            yield encode(files)

    rows = objects.select(F.col(by).cast("string").alias("__by"), F.col(chunk).cast("long").alias("__chunk"), F.col(order).alias("__order"), F.col(payload).alias("__payload"))
    rows = rows.repartition("__by", "__chunk").sortWithinPartitions("__by", "__chunk", F.col("__order").asc_nulls_last())
    return rows.mapInArrow(pack, "path string, content binary")


def raw_objects(records: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """``records`` with the decoded object and the rule it breaks: raw binary, raw_error string."""
    kind = pa.struct([("raw", pa.binary()), ("raw_error", pa.string())])

    def one(r: dict) -> dict:
        try:
            return {"raw": restored(Record(r["kind"], r["codec"], r["flags"], r["raw_length"], r["content_id"], r["algorithm"], r["oid"], r["payload"]), domain), "raw_error": None}
        except FormatError as why:
            return {"raw": None, "raw_error": str(why)}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([one(r) for r in batch.to_pylist()], kind)

    columns = F.struct("kind", "codec", "flags", "raw_length", "content_id", "algorithm", "oid", "payload")
    return records.withColumn("__raw", F.arrow_udf(run, "raw binary, raw_error string")(columns)).select(*records.columns, "__raw.raw", "__raw.raw_error")


#: Fields of a location that must agree with the record that is there, in the order in which they are compared.
AGREE = ("record_length", "stored_length", "raw_length", "kind", "codec", "flags", "payload_crc32c", "content_id")


def records_at(records: DataFrame, locations: DataFrame) -> DataFrame:
    """Each location with the record at its place, and ``problem``: missing, the first field that differs, or null."""
    there = records.select("generation", "chunk_id", "offset", F.struct(*AGREE, "algorithm", "oid", "payload").alias("record"))
    out = locations.join(there, ["generation", "chunk_id", "offset"], "left")
    problem = F.when(F.col("record").isNull(), "missing")
    for c in AGREE:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"record.{c}")), c)
    return out.withColumn("problem", problem)


def reconciled(found: DataFrame) -> DataFrame:
    """Reports by chunk: one that is there open and sealed is a conflict, whatever its files are like."""
    stem = F.regexp_replace("path", r"\.(open|sealed)$", "")
    per = found.groupBy(stem.alias("chunk")).agg(F.count("*").alias("files"), F.min_by(F.struct("path", "records", "retained_bytes", "cut_bytes", "error", "action"), "path").alias("x"))
    action = F.when(F.col("files") > 1, "conflict").otherwise(F.col("x.action"))
    return per.select("chunk", "x.path", "x.records", "x.retained_bytes", "x.cut_bytes", "x.error", action.alias("action"))


def apply_recovery(spark: SparkSession, found: DataFrame) -> int:
    """Cut the tails and rename what has its seal, as ``reconciled`` says; how many files were changed. A conflict or rejection is an error."""
    rows = found.filter("action <> 'none'").collect()  # open files a crash left behind
    if bad := [r for r in rows if r.action in ("conflict", "reject")]:
        raise FormatError(f"{bad[0].chunk}: {bad[0].action} {bad[0].error or ''}")
    files = Files(spark)
    for r in rows:
        if r.action == "truncate":
            files.write(r.path, files.read(r.path, 1 << 31)[: r.retained_bytes])
        else:
            files.move(r.path, r.path.removesuffix(".open") + ".sealed")
    return len(rows)
