import subprocess

import pytest
from pyspark.sql import functions as F

from strataweave.functions import identity, objects
from strataweave.operators import graph
from strataweave.sources import catalog, chunks, repository


def git(path, *words):
    return subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@example.com", *words], capture_output=True, check=True, text=True).stdout


@pytest.fixture(scope="module")
def clone(tmp_path_factory):
    path = tmp_path_factory.mktemp("clone")
    git(path, "init", "-q", "-b", "main")
    (path / "dir").mkdir()
    (path / "top.txt").write_text("top\n")
    (path / "dir/nested.txt").write_text("nested\n")
    git(path, "add", ".")
    git(path, "commit", "-qm", "one\n\ntree 0 in the body")
    git(path, "tag", "-a", "v1", "-m", "tag")
    (path / "top.txt").write_text("more\n")
    git(path, "commit", "-qam", "two")
    git(path, "update-ref", "refs/remotes/origin/x", "HEAD")
    return path


def test_closure_is_what_git_says(spark, clone):
    repository.register(spark)
    load = lambda t: spark.read.format("repository").option("path", str(clone)).option("table", t).load()
    refs, objs = load("refs"), load("objects")
    assert [r.name for r in refs.collect()] == ["refs/heads/main", "refs/tags/v1"]
    for kind, n in identity.KINDS.items():
        assert objs.filter(F.col("kind") == n).filter(identity.native_oid(F.col("data"), kind) != F.lower(F.hex("oid"))).isEmpty()
    found = graph.reachable(objects.edges(objs), refs.select(F.col("target").alias("node")))
    listed = git(clone, "rev-list", "--objects", "main", "v1").split("\n")
    want = {x.split()[0] for x in listed if x} | {git(clone, "rev-parse", "v1").strip()}
    assert {bytes(r.node).hex() for r in found.collect()} == want
    assert objects.malformed(objs).isEmpty() and graph.dangling(objects.edges(objs), objs.select(F.col("oid").alias("node"))).isEmpty()


def test_tree_parser_rejects():
    good = b"100644 a\0" + bytes(20)
    assert objects.entries_of(good * 2) == [{"mode": "100644", "name": b"a", "oid": bytes(20)}] * 2
    for bad in (good[:-1], b"100600 a\0" + bytes(20), b"100644 \0" + bytes(20), b"x"):
        assert objects.entries_of(bad) is None


def test_commit_rules(spark):
    one = lambda d, f: spark.createDataFrame([(d,)], "d binary").select(f(F.col("d")).alias("x")).first().x
    t, p = b"a" * 40, b"b" * 40
    data = b"tree " + t + b"\nparent " + p + b"\nparent " + t + b"\n\ntree " + p
    assert [bytes(x) for x in one(data, objects.commit_references)] == [b"\xaa" * 20, b"\xbb" * 20, b"\xaa" * 20]
    assert one(b"tree " + t + b"\ntree " + p + b"\n\n", objects.commit_tree) is None
    assert one(b"tree zz\n\n", objects.commit_references) is None


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    obj = lambda rows: spark.createDataFrame([(b"r", 1, o, cid, 1, 1, at, 160, 8, 8, 3, 0, 0, 0) for o, cid, at in rows], "repo_id binary, algo int, oid binary, content_id binary, generation long, chunk_id long, offset long, record_length long, stored_length long, raw_length long, kind int, codec int, flags int, payload_crc32c long")
    assert c.import_objects(obj([(b"1", b"x", 64), (b"2", b"y", 224), (b"3", b"x", 384)])) == {"objects_seen": 3, "objects_written": 2, "objects_deduplicated": 1}
    assert c.import_objects(obj([(b"1", b"x", 999), (b"4", b"y", 999)]))["objects_written"] == 0
    assert c.read("object_locations").count() == 2 and c.read("oid_aliases").count() == 4
    with pytest.raises(catalog.CatalogError):
        c.import_objects(obj([(b"1", b"other", 5), (b"9", b"new", 6)]))
    assert c.read("object_locations").count() == 2 and c.read("oid_aliases").count() == 4  # nothing of it is visible
    c.persist_workspace(b"w1", "name", b"rec", 1)
    c.persist_workspace(b"w1", "name", b"rec", 1)
    with pytest.raises(catalog.CatalogError):
        c.persist_workspace(b"w2", "name", b"rec", 1)
    snap = spark.createDataFrame([(b"r", b"s1", catalog.READY), (b"r", b"s2", catalog.INCOMPLETE)], catalog.TABLES["repo_snapshots"][0])
    pin = spark.createDataFrame([(catalog.EXPLICIT_PIN, b"p", 18)], catalog.TABLES["pins"][0])
    c.apply(put={"repo_snapshots": snap, "pins": pin})
    assert [r.root_kind for r in c.gc_roots().collect()] == ["snapshot", "workspace_pin", "explicit_pin"]
    assert not c.may_retire(18) and c.may_retire(3)
    c.publish_generation(2, c.read("object_locations").filter("offset = 64").withColumn("generation", F.lit(2).cast("long")))
    assert c.read("object_locations").select("generation").collect()[0][0] == 2
    c.delete_repository(b"r")
    assert c.read("repo_snapshots").isEmpty() and c.read("oid_aliases").count() == 4
    c.validate()


def test_files_of_several_chunks_are_encoded_together_and_payload_sums_come_from_decoding(monkeypatch):
    groups = [([chunks.object_record(bytes([n]) * k) for k in range(n * 7, n * 7 + 9)], n) for n in range(4)]
    calls, many = [], chunks.crc32c_many
    monkeypatch.setattr(chunks, "crc32c_many", lambda data: calls.append(len(data)) or many(data))
    files = chunks.chunk_files(groups, 3)
    assert calls == [72, 4] and files == [chunks.chunk_file(records, 3, n) for records, n in groups]
    for data, (records, _) in zip(files, groups):
        *found, end = chunks.scan_file(data, sealed=True, strict=True)
        assert [r for _, r in found] == records and end.records == 9
        assert [r.payload_crc32c for _, r in found] == many([r.payload for r in records]).tolist()
        assert chunks.decode_record(data, chunks.CHUNK_HEADER)[0].payload_crc32c == many([records[0].payload])[0]


def test_files_are_built_from_a_stream_of_rows_without_a_group_each(spark, monkeypatch):
    monkeypatch.setattr(chunks, "BATCH_BYTES", 2000)
    data = [(None if n % 5 == 4 else f"s{n % 5}", n % 3, None if n == 7 else 100 - n, bytes([n]) * (n * 3)) for n in range(60)]
    built = chunks.build(spark.createDataFrame(data, "s string, c int, o int, p binary"), "s", "c", "o", "p")
    want = {}
    for s, c, _, p in sorted(data, key=lambda r: (r[2] is None, r[2])):
        want.setdefault((s, c), []).append(chunks.object_record(p))
    assert sorted((r.path, bytes(r.content)) for r in built.collect()) == sorted((f"{s}/{c:020d}.sealed", chunks.chunk_file(x, 1, c)) for (s, c), x in want.items())
    assert built.filter("false").count() == 0
    assert "FlatMapGroups" not in built._jdf.queryExecution().toString()
