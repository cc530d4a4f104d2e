import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from strataweave.functions import crc, identity, parsers, paths
from strataweave.operators import backup, cache, graph, importing, jobs, ordered, plan
from strataweave.sources import chunks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_crc32c_vector():
    assert crc.crc32c(b"123456789") == 0xE3069283
    assert crc.crc32c(b"") == 0


def test_crc32c_of_any_length_alone_and_among_others():
    def plain(data, r=0xFFFFFFFF):
        for b in data:
            r = int(crc._BYTE[(r ^ b) & 0xFF]) ^ (r >> 8)
        return r ^ 0xFFFFFFFF

    rng = random.Random(5)
    values = [rng.randbytes(n) for n in (*range(12), 63, 64, 65, 255, 256, 257, 511, 512, 513, 2048, 65535, 65536, 65537, 140_000)]
    want = [plain(v) for v in values]
    assert crc.crc32c_many(values).tolist() == want == [crc.crc32c(v) for v in values]
    assert [crc.crc32c_many([v] * 2).tolist() for v in values] == [[w] * 2 for w in want]
    assert crc.crc32c_many([]).tolist() == []


def test_crc32c_of_a_short_value_costs_no_fixed_number_of_steps():
    began = time.perf_counter()
    for n in range(2000):
        crc.crc32c(n.to_bytes(46, "big"))
    assert time.perf_counter() - began < 1  # 256 steps over all lanes, however few, took 2.4 ms each


def test_native_ids(spark):
    p = F.lit(b"hello\n")
    r = spark.range(1).select(identity.native_oid(p).alias("a"), identity.native_oid(p, algorithm="sha256").alias("b"), identity.content_id(p).alias("c"), identity.content_id(p, "tree").alias("d")).first()
    assert r.a == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert r.b == hashlib.sha256(b"blob 6\0hello\n").hexdigest()
    assert r.c == chunks.content_digest(3, b"hello\n").hex() and r.c != r.d


def test_keys_keep_numeric_order(spark):
    df = spark.createDataFrame([(1, 2), (1, 300), (2, 1), (256, 0)], "g long, c long").select("g", "c", identity.chunk_key(F.col("g"), F.col("c")).alias("k"))
    assert [(r.g, r.c) for r in df.orderBy("k").collect()] == [(1, 2), (1, 300), (2, 1), (256, 0)]
    v = spark.range(1).select(identity.location_value(*[F.lit(i) for i in range(10)]).alias("v")).first().v
    assert len(v) == 53 and v[0] == 1


@pytest.mark.parametrize(("path", "error"), [("a/b", "ok"), ("", "empty"), ("/a", "absolute"), ("a//b", "empty_name"), ("a/../b", "dot_name"), ("a/./b", "dot_name"), ("a\x00b", "nul"), ("x" * 256, "long_name")])
def test_path_rules(spark, path, error):
    assert spark.createDataFrame([(path,)], "p string").select(paths.path_error(F.col("p")).alias("e")).first().e == error


def test_plan(spark):
    df = spark.createDataFrame([(["z"],), (["a", "c"],), (["a", "b"],)], "path array<string>")
    assert rows(plan.directories(df)) == [(["a"],)]
    assert plan.validated(df) is df
    for bad in ([["a"]], [["z", "q"]], [["z"]]):
        more = df.unionByName(spark.createDataFrame([(p,) for p in bad], "path array<string>"))
        with pytest.raises(ValueError):
            plan.validated(more)


def test_closure_ends_on_cycles_and_shares(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("a",)], "node string")
    assert rows(graph.reachable(edges, roots)) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(graph.dangling(edges, spark.createDataFrame([(c,) for c in "abcx"], "node string")).select("dst")) == [("y",)]
    with pytest.raises(ValueError, match="objects"):
        graph.mark(edges, roots, max_objects=2)


def test_expand_rejects_cycles(spark):
    cyc = spark.createDataFrame([("r", "d", "tree", "t"), ("t", "d", "tree", "r")], "src string, name string, mode string, dst string")
    with pytest.raises(ValueError):
        graph.expand(cyc, spark.createDataFrame([("r",)], "node string"))


def test_eviction_takes_lowest_digests(spark):
    random.seed(2)
    data = [(hashlib.sha256(bytes([i])).hexdigest(), random.randint(1, 9)) for i in range(50)]
    total = sum(n for _, n in data)
    left, want = total, []
    for cid, n in sorted(data):
        if left <= total // 3:
            break
        want.append(cid)
        left -= n
    got = cache.evict_to(spark.createDataFrame(data, "cid string, logical_bytes long"), total // 3)
    assert [r[0] for r in rows(got.select("cid"))] == want
    assert cache.evict_to(spark.createDataFrame([], "cid string, logical_bytes long"), 0).count() == 0


@pytest.mark.parametrize(("host", "guest", "outcome", "lack"), [(180, 160, "admitted", 0), (150, 200, "host", 10), (200, 120, "guest", 20), (150, 120, "host_and_guest", 20)])
def test_admission(spark, host, guest, outcome, lack):
    n = lambda x: F.lit(x).cast("long")
    r = spark.range(1).select(cache.admission(n(host), n(guest), n(60), n(100), n(80)).alias("a")).first().a
    assert (r.outcome, r.required_reclaim) == (outcome, lack)


def test_running_sum(spark):
    data = [(i % 3, i, i * i % 7) for i in range(100)]
    df = spark.createDataFrame(data, "k int, o int, v long")
    got = {(r.k, r.o): r.s for r in ordered.running_sum(df, ["o"], F.col("v"), "s", by=["k"]).collect()}
    for k, o, _ in data:
        assert got[k, o] == sum(v for a, b, v in data if a == k and b < o)


def test_replay(spark):
    random.seed(1)
    ops = ["enqueue", "start", "succeed", "fail", "retry"]
    data = [(random.choice("ab"), i, random.choice(ops)) for i in range(2500)]
    legal = {(o, a): b for o, a, b in jobs.STEPS}
    want = {}
    for k, _, op in data:
        s, t, r = want.get(k, (0, 0, 0))
        n = legal.get((op, s))
        want[k] = (s, t, r + 1) if n is None else (n, t + (n == 2), r)
    got = {r.k: (r.state, r.attempts, r.rejected) for r in jobs.replay(spark.createDataFrame(data, "k string, i int, op string"), "k", ["i"], "op").collect()}
    assert got == want


def test_rotation(spark):
    data = [("s", i, n) for i, n in enumerate([100, 100, 500, 10, 10])]
    got = importing.rotate(spark.createDataFrame(data, "s string, i int, n long"), "s", "i", "n", 340)
    assert [(r.chunk, r.chunk_offset) for r in got.orderBy("i").collect()] == [(0, 64), (0, 164), (1, 64), (2, 64), (2, 74)]


def test_parsers(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one(parsers.available_bytes, "Avail\n 123\n") == 123 and one(parsers.available_bytes, "Avail\nx\n") is None
    assert one(parsers.uuid_bytes, "01234567-89ab-cdef-0123-456789abcdef") == bytes.fromhex("0123456789abcdef" * 2) and one(parsers.uuid_bytes, "0123") is None
    assert one(parsers.key_values, "UUID=a\nTYPE=b\n") == {"UUID": "a", "TYPE": "b"} and one(parsers.key_values, "A=1\nA=2") is None


def test_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x").write_bytes(b"abc")
    (tmp_path / "y").write_bytes(b"")
    files = backup.inventory(spark, f"file://{tmp_path}")
    assert rows(files) == [("d/x", 3, hashlib.sha256(b"abc").hexdigest()), ("y", 0, hashlib.sha256(b"").hexdigest())]
    manifest = spark.createDataFrame([("d/x", 3, "0"), ("y", 1, "0"), ("z", 0, "0")], "relative string, bytes long, sha256 string")
    assert rows(backup.mismatches(manifest, files).select("relative", "problem")) == [("d/x", "digest"), ("y", "length"), ("z", "missing")]


def test_records_round_trip_and_reject_every_flipped_byte():
    for codec in ("raw", "zstd"):
        record = chunks.object_record(b"hello hello hello\n" * 3, codec=codec)
        data = chunks.encode_records([record])[0]
        back, length = chunks.decode_record(data)
        assert back == record and length == len(data) == chunks.record_length(len(record.payload))
        assert chunks.restored(back) == b"hello hello hello\n" * 3
        for i in range(len(data)):
            bad = data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]
            with pytest.raises(chunks.FormatError):
                chunks.restored(chunks.decode_record(bad)[0])
        for n in range(0, len(data), 7):
            with pytest.raises(chunks.FormatError):
                chunks.decode_record(data[:n])


def test_wrong_identity_is_rejected():
    record = chunks.object_record(b"x")
    record.content_id = bytes(32)
    with pytest.raises(chunks.FormatError, match="content id"):
        chunks.restored(chunks.decode_record(chunks.encode_records([record])[0])[0])


def test_scan_and_recovery(spark, tmp_path):
    records = [chunks.object_record(bytes([i]) * (i * 50)) for i in range(5)]
    whole, opened = chunks.chunk_file(records, 7, 1), chunks.chunk_file(records, 7, 2, sealed=False)
    for name, data in (("1.sealed", whole), ("2.open", opened), ("3.open", opened[:-30]), ("4.open", whole)):
        (tmp_path / name).write_bytes(data)
    assert chunks.read_chunks(spark, f"file://{tmp_path}", strict=False).count() == 5 + 5 + 4 + 5
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    got = {r.path.split("/")[-1]: (r.records, r.action) for r in chunks.reports(files).collect()}
    assert got == {"1.sealed": (5, "none"), "2.open": (5, "none"), "3.open": (4, "truncate"), "4.open": (5, "publish_seal")}
    with pytest.raises(Exception, match="truncated"):
        chunks.scan(files.filter("path like '%3.open'")).count()


def test_stream_states(spark):
    from strataweave.streaming import events

    base = events.shared_dir(spark) + "/stream-in"
    data = [("a", 1, "enqueue"), ("a", 2, "start"), ("a", 3, "fail"), ("b", 4, "start")]
    spark.createDataFrame(data, "k string, event_id long, op string").write.mode("overwrite").parquet(base)
    stream = spark.readStream.schema("k string, event_id long, op string").parquet(base)
    got = events.drained(events.job_states(stream, "k", "op"), "update", "jobs")
    assert rows(got.select("k", "state", "attempts", "rejected")) == [("a", 4, 1, 0), ("b", 0, 0, 1)]
