import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.functions import identity
from strataweave.sources import catalog, chunks, manifests, publication
from strataweave.sources.chunks import FormatError
from strataweave.sources.files import Files

ID = bytes(range(16))
SNAPSHOT = {
    "repository": ID, "snapshot_id": ID[::-1], "native_object_format": 1, "import_policy": 1, "imported_unix_secs": 5, "objects_seen": 3, "objects_written": 2, "objects_deduplicated": 1, "raw_bytes": 99, "tool_version": b"t1",
    "refs": [{"kind": 1, "name": b"refs/heads/a", "algorithm": 1, "target": b"x" * 20}, {"kind": 2, "name": b"refs/tags/v", "algorithm": 1, "target": b"y" * 20}], "optional_fields": [{"tag": 9, "value": b"more"}],
}
WORKSPACE = {"workspace_id": ID, "repository": ID, "snapshot_id": ID, "algorithm": 1, "commit": b"c" * 20, "generation": 7, "created_unix_secs": 1, "name": b"a-name_1", **dict.fromkeys(manifests.COUNTERS, 0), "regular_files": 2, "executable_files": 1, "reflinked_regular_files": 3, "optional_fields": []}
BACKUP = {"files": [{"path": p, "bytes": len(p), "sha256": hashlib.sha256(p).digest()} for p in (b"a/b", b"a/c", "é".encode())]}
COLD = {"catalog_schema_version": 1, "active_generation": 8, "chunks": [{"generation": 7, "chunk_id": 2, "classification": 2, "valid_prefix": 64}, {"generation": 8, "chunk_id": 1, "classification": 1, "valid_prefix": 200}], "catalog_digest": b"1" * 32, "config_digest": b"2" * 32, "pins_manifest_digest": b"3" * 32}
JOB = {"state": 4, "id": ID, "attempts": 2, "kind": b"verify", "payload": b"\0\1", "last_error": b"no"}
SCRUB = {"run_state": 1, "interval": 60, "next_due": 100, "last_started": 40, "last_completed": None, "consecutive_failures": 0, "recovered_interrupted_runs": 1}
MIGRATION = {"state": 2, "from_version": 1, "to_version": 2, "id": ID, "transition_count": 2}
ALL = {"snapshot": SNAPSHOT, "workspace": WORKSPACE, "backup": BACKUP, "cold": COLD, "job": JOB, "scrub": SCRUB, "migration": MIGRATION}


@pytest.mark.parametrize("name", sorted(ALL))
def test_layouts_round_trip_and_fail_closed(name):
    layout, value = manifests.LAYOUTS[name], ALL[name]
    data = layout.encode(value)
    assert layout.decode(data) == value
    for n in range(len(data)):
        with pytest.raises(FormatError):
            layout.decode(data[:n])
    with pytest.raises(FormatError):
        layout.decode(data + b"\0")
    if name not in ("snapshot", "workspace"):  # those carry no checksum
        for n in range(len(data)):
            with pytest.raises(FormatError):
                layout.decode(data[:n] + bytes([data[n] ^ 1]) + data[n + 1 :])


def test_wire_forms():
    """Lengths and places that the formats fix."""
    assert len(manifests.SCRUB.encode(SCRUB)) == len(manifests.MIGRATION.encode(MIGRATION)) == 64
    job = manifests.JOB.encode(JOB)
    assert len(job) == 50 + 6 + 2 + 2 + 4 and job[:2] == b"\x01\x04" and job[26:30] == b"\0\0\0\2"
    assert len(manifests.COLD.encode(COLD)) == 22 + 2 * 24 + 96 + 32
    assert manifests.BACKUP.encode({"files": []})[:16] == b"RFBKMAN1" + bytes(8)
    snap = manifests.SNAPSHOT.encode(SNAPSHOT)
    assert snap[42:46] == b"\1\1\0\0" and snap[86:96] == b"\0\2\0\0\0\2\0\0\0\1" and snap[96:98] == b"t1"


@pytest.mark.parametrize(
    "name,change",
    [
        ("snapshot", {"objects_seen": 4}), ("snapshot", {"tool_version": b""}), ("snapshot", {"refs": SNAPSHOT["refs"][::-1]}), ("snapshot", {"native_object_format": 2}), ("snapshot", {"optional_fields": [{"tag": 0, "value": b""}]}),
        ("workspace", {"name": b"a b"}), ("workspace", {"name": b"a\n"}), ("workspace", {"copied_regular_files": 1}), ("workspace", {"commit": b"c" * 32}), ("workspace", {"optional_fields": [{"tag": 1, "value": b""}] * 2}),
        ("backup", {"files": BACKUP["files"][::-1]}), ("backup", {"files": [BACKUP["files"][0] | {"path": b"/a"}]}), ("backup", {"files": [BACKUP["files"][0] | {"path": b"a/../b"}]}),
        ("cold", {"chunks": COLD["chunks"][::-1]}), ("cold", {"chunks": [COLD["chunks"][0] | {"valid_prefix": 63}]}),
        ("job", {"kind": b""}), ("job", {"attempts": 0}), ("job", {"last_error": None}), ("job", {"state": 3}), ("job", {"state": 5}),
        ("scrub", {"interval": 59}), ("scrub", {"run_state": 2, "last_started": None}), ("migration", {"to_version": 1}), ("migration", {"transition_count": 0}), ("migration", {"state": 0}),
    ],
)
def test_rules(name, change):
    with pytest.raises(FormatError):
        manifests.LAYOUTS[name].encode(ALL[name] | change)


def test_checksums_of_many_records_are_computed_together(monkeypatch):
    calls, many = [], manifests.crc32c_many
    monkeypatch.setattr(manifests, "crc32c_many", lambda data: calls.append(len(data)) or many(data))
    values = [JOB | {"attempts": n + 1, "payload": b"p" * (n % 7)} for n in range(100)]
    data = manifests.JOB.encode_many(values)
    assert calls == [100, 100] and data == [manifests.JOB.encode(v) for v in values]
    calls.clear()
    assert manifests.JOB.decode_many(data) == values and calls == [100, 100]
    bad = [data[n][:k] + bytes([data[n][k] ^ 0x40]) + data[n][k + 1 :] for n, k in enumerate((0, 1, 12, 33, 52))] + [data[5] + b"x", data[6][:40], data[7]]
    want = ["fixed bytes", "state", "checksum", "kind is too large", "checksum", "trailing bytes", "truncated", values[7]]
    assert [str(x) if isinstance(x, FormatError) else x for x in manifests.JOB.decode_many(bad)] == want


def test_columns_of_records_agree_with_values_and_leave_unsound_ones_to_them():
    kind = pa.struct([("value", manifests.JOB.type), ("error", pa.string())])
    values = [JOB | {"attempts": n + 1, "payload": b"p" * (n % 7), "kind": b"k" * (n % 3 + 1)} | ({"state": 1, "last_error": None} if n % 2 else {}) for n in range(50)]
    for few in (values, values[:1], values[1:2]):
        rows, data = pa.array([None, *few], manifests.JOB.type).slice(1), manifests.JOB.encode_many(few)
        assert manifests.JOB.encode_columns(rows).to_pylist() == data
        assert manifests.JOB.decode_columns(pa.array([b"before", *data, b"after"]).slice(1, len(few))) == pa.array([{"value": v, "error": None} for v in few], kind)
    bad = [{"last_error": b""}, {"state": 3}, {"last_error": None}, {"attempts": 0}, {"state": 5}, {"kind": b""}, {"kind": None}, {"id": ID[1:]}, {"id": None}, {"attempts": 1 << 32}, {"attempts": -1}, {"attempts": None}]
    for change in bad:
        assert manifests.JOB.encode_columns(pa.array([*values[:3], JOB | change], manifests.JOB.type)) is None
    data = manifests.JOB.encode(JOB)
    for n in range(len(data)):
        for x in (data[:n], data[:n] + bytes([data[n] ^ 1 << n % 8]) + data[n + 1 :], data[:n] + b"\xff" + data[n + 1 :], data + data[: n + 1]):
            assert x == data or manifests.JOB.decode_columns(pa.array([data, x])) is None
    assert manifests.SNAPSHOT.decode_columns(pa.array([data])) is None


def test_columns(spark):
    data = [(n, manifests.LAYOUTS["snapshot"].encode(SNAPSHOT)[: 50 if n else None]) for n in (0, 1)] + [(2, None)]
    got = spark.createDataFrame(data, "n int, d binary").select("n", manifests.decoded(F.col("d"), manifests.SNAPSHOT).alias("x")).orderBy("n").collect()
    assert got[0].x.error is None and got[0].x.value.refs[1]["name"] == bytearray(b"refs/tags/v") and got[1].x.error == "truncated" and got[1].x.value is None and got[2].x is None
    back = spark.createDataFrame(data[:1], "n int, d binary").select(manifests.encoded(manifests.decoded(F.col("d"), manifests.SNAPSHOT)["value"], manifests.SNAPSHOT).alias("y")).first().y
    assert bytes(back) == data[0][1]
    ok = spark.createDataFrame([("a-b_1",), ("",), ("a\n",), ("x" * 129,), (None,)], "s string").select(manifests.workspace_name_is_valid(F.col("s")).alias("v")).collect()
    assert [r.v for r in ok] == [True, False, False, False, False]


def test_files_and_publication(spark, tmp_path):
    root = f"file://{tmp_path}"
    files = Files(spark)
    files.write(f"{root}/f", b"one", new=True)
    with pytest.raises(FileExistsError):
        files.write(f"{root}/f", b"two", new=True)
    assert files.read(f"{root}/f") == b"one" and files.read(f"{root}/none") is None and files.names(root) == ["f"]
    assert manifests.ensure_file(spark, f"{root}/w", manifests.WORKSPACE, WORKSPACE) and not manifests.ensure_file(spark, f"{root}/w", manifests.WORKSPACE, WORKSPACE)
    with pytest.raises(FormatError):
        manifests.ensure_file(spark, f"{root}/w", manifests.WORKSPACE, WORKSPACE | {"generation": 8})
    c, where = catalog.Catalog(spark, f"{root}/catalog"), f"{root}/snapshots/one"
    assert publication.reconcile(c, where) == "no_manifest"
    publication.begin(c, SNAPSHOT)
    publication.begin(c, SNAPSHOT)
    assert c.gc_roots().isEmpty()
    manifests.write_file(spark, where, manifests.SNAPSHOT, SNAPSHOT)  # and the process stops here
    other = SNAPSHOT | {"snapshot_id": b"o" * 16}
    manifests.write_file(spark, f"{root}/snapshots/two", manifests.SNAPSHOT, other)
    assert publication.reconcile(c, f"{root}/snapshots/two") == "not_begun"
    assert publication.reconcile_all(c, f"{root}/snapshots").count() == 1 and publication.reconcile(c, where) == "already_ready"
    with pytest.raises(catalog.CatalogError):
        publication.publish(c, where, SNAPSHOT)
    publication.begin(c, other)
    with pytest.raises(catalog.CatalogError):
        publication.finish(c, f"{root}/snapshots/two", other | {"raw_bytes": 1})
    assert publication.finish(c, f"{root}/snapshots/two", other) == "published" and c.gc_roots().count() == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """Both read the same version; the second to commit is refused, nothing of it is visible."""
    c = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    row = lambda n: spark.createDataFrame([(n, b"1")], catalog.TABLES["meta"][0])
    c.apply(put={"meta": row("a")})
    old = c._pointer()
    c.apply(put={"meta": row("b")})
    late = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    monkeypatch.setattr(late, "_pointer", lambda: old)
    with pytest.raises(catalog.CatalogError):
        late.apply(put={"meta": row("c")})
    assert {r.key for r in c.read("meta").collect()} == {"a", "b"}


def test_keys_and_their_decoders(spark):
    cols = {"generation": 7, "chunk_id": 1 << 40, "offset": 64, "record_length": 160, "stored_length": 8, "raw_length": 9, "kind": 3, "codec": 1, "flags": 2, "payload_crc32c": 0xFFFFFFFF}
    one = spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in cols.items()], F.lit(bytearray(ID)).alias("repo"), F.lit(bytearray(b"\xab" * 20)).alias("oid"))
    value = identity.location_value(*[F.col(k) for k in cols])
    alias = identity.alias_key(F.col("repo"), F.col("oid"), F.lit(1))
    got = one.select(
        identity.decoded_location(value).alias("l"), identity.decoded_location(F.substring(value, 1, 52)).alias("short"), identity.decoded_alias(alias).alias("a"), identity.decoded_alias(F.concat(alias, F.lit(b"x"))).alias("long"),
        identity.snapshot_key(F.col("repo"), F.col("repo")).alias("s"), identity.chunk_value(F.lit(2), F.lit(300), F.lit(4)).alias("c"), identity.pin_key(F.col("repo")).alias("p"), identity.opaque_key(F.col("oid")).alias("o"),
        identity.cid_of_name(F.lit("ab" * 32)).alias("n"), identity.cid_of_name(F.lit("AB" * 32)).alias("upper"), identity.location_key(F.col("oid")).alias("k"), identity.canonical_oid(F.col("oid"), F.lit(1)).alias("canonical"),
        identity.oid_is_valid(F.col("oid"), F.lit(1)).alias("valid"), identity.oid_is_valid(F.col("oid"), F.lit(3)).alias("unknown"),
    ).first()
    assert got.l.asDict() == cols and got.short is None and got.long is None and (bytes(got.a.repository), got.a.algorithm, bytes(got.a.oid)) == (ID, 1, b"\xab" * 20)
    assert bytes(got.s) == b"\1" + ID + ID and bytes(got.c) == b"\1\2" + (300).to_bytes(8, "big") + (4).to_bytes(8, "big") and bytes(got.p) == b"\1\1" + ID and bytes(got.o) == b"\1" + b"\xab" * 20
    assert bytes(got.n) == b"\xab" * 32 and got.upper is None and bytes(got.canonical) == b"\1\x14" + b"\xab" * 20 and bytes(got.k)[:1] == b"\1" and got.valid and not got.unknown



def test_chunks_of_another_domain(spark, tmp_path):
    """Files written with another domain: good with it, rejected, never cut, without it."""
    records = [chunks.object_record(x, domain="another") for x in (b"one", b"two")]
    rows = [("a.open", chunks.chunk_file(records, 1, 1, sealed=False)), ("b.sealed", chunks.chunk_file(records, 1, 2)), ("c.open", chunks.chunk_file(records, 1, 3, sealed=False) + b"tail"), ("d.open", chunks.chunk_file(records, 1, 4)), ("b.open", chunks.chunk_file([], 1, 2, sealed=False))]
    files = spark.createDataFrame(rows, "path string, content binary")
    said = lambda **k: {r.path: r.action for r in chunks.reports(files, **k).collect()}
    assert said(domain="another") == {"a.open": "none", "b.sealed": "none", "c.open": "truncate", "d.open": "publish_seal", "b.open": "none"}
    assert {said()[p] for p in ("a.open", "b.sealed", "c.open")} == {"reject"}
    pairs = {r.chunk: r.action for r in chunks.reconciled(chunks.reports(files, domain="another")).collect()}
    assert pairs == {"a": "none", "b": "conflict", "c": "truncate", "d": "publish_seal"}
    for name, data in rows[:4]:
        (tmp_path / name).write_bytes(data)
    load = lambda: spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", "content")
    assert chunks.apply_recovery(spark, chunks.reconciled(chunks.reports(load(), domain="another"))) == 2
    assert {r.action for r in chunks.reports(load(), domain="another").collect()} == {"none"} and (tmp_path / "d.sealed").exists()
    with pytest.raises(FormatError):
        chunks.apply_recovery(spark, chunks.reconciled(chunks.reports(load())))
    assert (tmp_path / "c.open").read_bytes() == chunks.chunk_file(records, 1, 3, sealed=False)


def test_point_reads(spark):
    records = [chunks.object_record(b"x" * n, codec="zstd") for n in (5, 50, 500)]
    found = chunks.scan(spark.createDataFrame([("a.sealed", chunks.chunk_file(records, 2, 9))], "path string, content binary"))
    at = found.select("generation", "chunk_id", "offset", *chunks.AGREE)
    bad = F.col("raw_length") + F.when(F.col("raw_length") == 50, 1).otherwise(0)
    moved = at.withColumn("raw_length", bad).withColumn("offset", F.col("offset") + F.when(F.col("raw_length") == 500, 8).otherwise(0))
    assert {r.raw_length: r.problem for r in chunks.records_at(found, moved).collect()} == {5: None, 51: "raw_length", 500: "missing"}
    raw = chunks.raw_objects(found).collect()
    assert {bytes(r.raw) for r in raw} == {b"x" * n for n in (5, 50, 500)} and not any(r.raw_error for r in raw)
    assert {r.raw_error for r in chunks.raw_objects(found, "another").collect()} == {"content id"}
