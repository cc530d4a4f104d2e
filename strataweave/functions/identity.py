"""Content identities and catalog key encodings as column expressions.

All are built-in functions, so they stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates content identities from other hashes. A store written with
#: another text needs that text here to get equal identities.
DOMAIN = "content-graph-object-v1"
# Tags of the object kinds and hash algorithms, and id lengths.
KINDS = {"commit": 1, "tree": 2, "blob": 3, "tag": 4}
ALGORITHMS = {"sha1": 1, "sha256": 2}
OID_BYTES = {"sha1": 20, "sha256": 32}


def big_endian(n: Column, width: int) -> Column:
    """Binary: the low ``width`` bytes of a non-negative number, highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def utf8(text: Column) -> Column:
    return text.cast("binary")


def content_id(payload: Column, kind: str = "blob", domain: str = DOMAIN) -> Column:
    """Hex: sha256 of domain, NUL, kind tag, length as 8 bytes, payload."""
    head = F.lit(domain.encode() + bytes([0, KINDS[kind]]))
    return F.sha2(F.concat(head, big_endian(F.octet_length(payload), 8), payload), 256)


def native_oid(payload: Column, kind: str = "blob", algorithm: str = "sha1") -> Column:
    """Hex: hash of ``kind length NUL payload``, as version control names objects."""
    head = F.concat(F.lit(f"{kind} "), F.octet_length(payload).cast("string")).cast("binary")
    whole = F.concat(head, F.lit(b"\x00"), payload)
    return F.sha1(whole) if algorithm == "sha1" else F.sha2(whole, 256)


def oid_is_valid(oid: Column, algorithm: Column) -> Column:
    """Whether the length fits the algorithm tag; false for unknown tags."""
    return F.coalesce(F.octet_length(oid) == F.when(algorithm == 1, 20).when(algorithm == 2, 32), F.lit(False))


def canonical_oid(oid: Column, algorithm: Column) -> Column:
    """Binary: algorithm tag, length, bytes."""
    return F.concat(big_endian(algorithm, 1), big_endian(F.octet_length(oid), 1), oid)


def location_key(cid: Column) -> Column:
    return F.concat(F.lit(b"\x01"), cid)


def location_value(generation, chunk_id, offset, record_length, stored_length, raw_length, kind, codec, flags, crc) -> Column:
    """Binary of 53 bytes: version, then the fields big-endian; byte order is numeric order."""
    widths = ((generation, 4), (chunk_id, 8), (offset, 8), (record_length, 8), (stored_length, 8), (raw_length, 8), (kind, 1), (codec, 1), (flags, 2), (crc, 4))
    return F.concat(F.lit(b"\x01"), *[big_endian(c, w) for c, w in widths])


def chunk_key(generation: Column, chunk_id: Column) -> Column:
    return F.concat(F.lit(b"\x01"), big_endian(generation, 4), big_endian(chunk_id, 8))


def alias_key(repository: Column, oid: Column, algorithm: Column) -> Column:
    return F.concat(F.lit(b"\x01"), repository, canonical_oid(oid, algorithm))


def snapshot_key(repository: Column, snapshot: Column) -> Column:
    return F.concat(F.lit(b"\x01"), repository, snapshot)


def chunk_value(state: Column, size: Column, records: Column) -> Column:
    return F.concat(F.lit(b"\x01"), big_endian(state, 1), big_endian(size, 8), big_endian(records, 8))


def pin_key(pin: Column) -> Column:
    """18 bytes; a workspace's pin has 17, so lengths tell them apart."""
    return F.concat(F.lit(b"\x01\x01"), pin)


def opaque_key(key: Column) -> Column:
    return F.concat(F.lit(b"\x01"), key)


def number(data: Column, at: int, width: int) -> Column:
    """The big-endian number of ``width`` bytes at a place, counted from 0."""
    return F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("long")


#: Fields of a location's value: name, place, bytes.
LOCATION = (("generation", 1, 4), ("chunk_id", 5, 8), ("offset", 13, 8), ("record_length", 21, 8), ("stored_length", 29, 8), ("raw_length", 37, 8), ("kind", 45, 1), ("codec", 46, 1), ("flags", 47, 2), ("payload_crc32c", 49, 4))


def decoded_location(value: Column) -> Column:
    """The fields of a location's value; null unless length, version, kind and codec are right."""
    good = (F.octet_length(value) == 53) & (number(value, 0, 1) == 1) & number(value, 45, 1).between(1, 4) & number(value, 46, 1).between(0, 1)
    return F.when(good, F.struct(*[number(value, at, width).alias(name) for name, at, width in LOCATION]))


def decoded_alias(key: Column) -> Column:
    """struct(repository, algorithm, oid) of an alias key; null unless its lengths agree."""
    algorithm, size = number(key, 17, 1), number(key, 18, 1)
    good = (number(key, 0, 1) == 1) & (size == F.when(algorithm == 1, 20).when(algorithm == 2, 32)) & (F.octet_length(key) == size + 19)
    return F.when(good, F.struct(F.substring(key, 2, 16).alias("repository"), algorithm.cast("int").alias("algorithm"), F.substring(key, F.lit(20), size.cast("int")).alias("oid")))


def cid_of_name(name: Column) -> Column:
    """The content identity that a file is named after, or null."""
    return F.when(name.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(name))


def fanout_path(cid_hex: Column) -> Column:
    """``aa/bb/aabb...``: where a cache keeps an object."""
    return F.concat_ws("/", F.substring(cid_hex, 1, 2), F.substring(cid_hex, 3, 2), cid_hex)


def record_length(stored: Column) -> Column:
    """Bytes of a record of a chunk file: header 128, footer 20, up to a multiple of 8."""
    return F.expr("~7L").bitwiseAND(stored.cast("long") + F.lit(155))
