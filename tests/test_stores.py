import os
import subprocess

import pytest
from pyspark.sql import functions as F

from strataweave.functions import identity
from strataweave.operators import cache, checkout, jobs, maintenance
from strataweave.functions import paths
from strataweave.sources import cache_store, catalog, chunks, manifests, repository, stores


def test_jobs(spark, tmp_path):
    store = stores.JobStore(catalog.Catalog(spark, f"file://{tmp_path}/c"))
    a, b = store.enqueue(b"scan", b"1", b"a" * 16), store.enqueue(b"copy", b"2", b"b" * 16)
    with pytest.raises(stores.StateError):
        store.enqueue(b"scan", b"3", a)
    with pytest.raises(stores.StateError):
        store.succeed(a)
    assert store.claim_next([]) is None and store.claim_next([b"copy"])["job_id"] == b
    assert store.recover() == 1 and store.get(b)["attempts"] == 1
    assert store.execute_next(lambda j: None) == "succeeded" and store.get(a)["state"] == stores.SUCCEEDED

    def broken(job):
        raise RuntimeError("no disk")

    assert store.execute_next(broken) == "failed" and store.get(b)["last_error"] == b"no disk" and store.get(b)["attempts"] == 2
    assert store.execute_next(broken) == "idle"
    store.retry(b)
    assert [bytes(r.job_id) for r in store.list().collect()] == [a, b]
    other = stores.JobStore(catalog.Catalog(spark, f"file://{tmp_path}/d"))
    assert other.mirror(store.records()) == 2 and other.get(b) == store.get(b)


def test_scrub(spark, tmp_path):
    store = stores.ScrubStore(spark, f"file://{tmp_path}/scrub")
    assert store.read() is None and not store.due(0) and store.begin_if_due(5) is None
    store.configure(60, 100)
    assert not store.due(159) and store.due(160)
    assert store.begin_if_due(160)["last_started"] == 160 and not store.due(999)
    with pytest.raises(stores.StateError):
        store.configure(90, 1)
    assert store.recover(170) == 1 and store.due(170) and store.read()["recovered_interrupted_runs"] == 1 and store.recover(171) == 0
    assert store.execute_if_due(170, lambda s: 1 / 0) == "failed" and store.read()["consecutive_failures"] == 1
    assert store.execute_if_due(229, print) == "not_due" and store.execute_if_due(230, lambda s: None) == "succeeded"
    assert (store.read()["consecutive_failures"], store.read()["last_completed"], store.read()["next_due"]) == (0, 230, 290)
    with pytest.raises(stores.StateError):
        store.finish(1, True)


def test_migration(spark, tmp_path):
    store = stores.MigrationStore(spark, f"file://{tmp_path}/m")
    assert store.status() == {"state": 0, "active_version": 1} and store.execute_once({}) == "idle"
    with pytest.raises(manifests.FormatError):
        store.begin(1)
    store.begin(2)
    with pytest.raises(stores.StateError):
        store.begin(3)
    with pytest.raises(stores.StateError):
        store.transition(manifests.COPYING, manifests.PUBLISHED)
    steps = {manifests.COPYING: lambda r: None, manifests.VALIDATING: lambda r: None}
    assert store.execute_once({manifests.COPYING: lambda r: 1 / 0}) == "failed" and store.status()["active_version"] == 1
    assert store.execute_once(steps) == "advanced" and store.execute_once(steps) == "published"
    assert store.status() == {"state": manifests.PUBLISHED, "active_version": 2} and store.read()["transition_count"] == 3


def test_cache(spark, tmp_path):
    store = cache_store.CacheStore(spark, f"file://{tmp_path}/cache")
    records = [chunks.object_record(b"blob %d" % i, codec="zstd") for i in range(6)]
    found = chunks.scan(spark.createDataFrame([("a.sealed", chunks.chunk_file(records, 1, 1))], "path string, content binary"))
    locations = found.select("content_id", *maintenance.PLACE)
    ids = sorted(r.content_id.hex() for r in records)
    with pytest.raises(chunks.FormatError):
        store.publish(ids[0], b"not it")
    first = next(r for r in records if r.content_id.hex() == ids[0])
    assert store.publish(ids[0], chunks.restored(first)) == store.publish(ids[0], chunks.restored(first))
    needed = locations.select("content_id").unionByName(locations.select("content_id"))
    assert store.hydrate(needed, locations, found) == 5 and store.hydrate(needed, locations, found) == 0
    with pytest.raises(chunks.FormatError):
        store.hydrate(spark.createDataFrame([(b"z" * 32,)], "content_id binary"), locations, found)
    assert [r.cid for r in store.entries().collect()] == ids
    (tmp_path / "cache/stray").write_bytes(b"x")
    store.files.write(store.path(ids[1]), b"damaged")
    assert store.reconcile() == {"retained": 5, "quarantined": 1, "skipped": 1} and store.reconcile()["quarantined"] == 0
    use = store.usage().first()
    assert (use.entries, use.logical_bytes, use.skipped) == (5, 30, 1)
    assert store.evict_to(20) == {"before": 30, "after": 18, "evicted_entries": 2, "evicted_logical_bytes": 12, "target_reached": True}
    assert [r.cid for r in store.entries().collect()] == ids[3:]
    assert [r.cid for r in cache.evict_for_reserve(store.entries(), 10, 17).collect()] == ids[3:5]
    assert cache.admit(store.entries(), 200, 200, 60, 100, 80) == (True, None) and not cache.admit(store.entries(), 150, 200, 60, 100, 80)[0]


def test_job_expressions(spark):
    cases = [(1, 0, None, True), (2, 0, None, False), (2, 1, None, True), (3, 1, None, True), (3, 1, "e", False), (4, 1, "e", True), (4, 1, None, False), (4, 1, "", False), (9, 1, None, False)]
    df = spark.createDataFrame(cases, "state int, attempts int, error string, want boolean")
    assert df.filter(F.coalesce(jobs.job_is_valid(F.col("state"), F.col("attempts"), F.col("error")), F.lit(False)) != F.col("want")).isEmpty()
    assert sorted(r.state for r in jobs.recovered(df).collect()) == sorted({2: 1}.get(c[0], c[0]) for c in cases)
    one = spark.range(1).select(
        jobs.scrub_finished(F.lit(100), F.lit(60), F.lit(2), F.lit(True)).alias("good"), jobs.scrub_finished(F.lit(100), F.lit(60), F.lit(2), F.lit(False)).alias("bad"),
        jobs.migration_step(F.lit("copying")).alias("m"), jobs.migration_step(F.lit("published")).alias("end"), jobs.active_version(F.lit("published"), F.lit(1), F.lit(2)).alias("new"), jobs.active_version(F.lit("copying"), F.lit(1), F.lit(2)).alias("old"),
    ).first()
    assert tuple(one.good) == (160, 0) and tuple(one.bad) == (160, 3) and (one.m, one.end, one.new, one.old) == ("validating", None, 2, 1)
    sets = [("a/b", "a/b/c", True, True), ("a/b", "a/bc", False, False), ("a", "a", False, True), ("a/b", "a", False, True)]
    for a, b, up, over in sets:
        x, y = F.split(F.lit(a), "/"), F.split(F.lit(b), "/")
        got = spark.range(1).select(paths.is_ancestor(x, y).alias("u"), paths.overlaps(x, y).alias("o")).first()
        assert (got.u, got.o) == (up, over)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A repository imported into chunk files and a catalog."""
    path = tmp_path_factory.mktemp("gc")
    git = lambda *w: subprocess.run(["git", "-C", str(path / "clone"), "-c", "user.name=t", "-c", "user.email=t@example.com", *w], capture_output=True, check=True, text=True).stdout.strip()
    (path / "clone/dir").mkdir(parents=True)
    git("init", "-q", "-b", "main")
    (path / "clone/dir/a.txt").write_text("tracked\n")
    (path / "clone/run.sh").write_text("#!/bin/sh\n")
    os.chmod(path / "clone/run.sh", 0o755)
    os.symlink("dir/a.txt", path / "clone/link")
    git("add", ".")
    git("commit", "-qm", "one")
    (path / "loose").write_text("nobody refers to this\n")
    git("hash-object", "-w", str(path / "loose"))
    repository.register(spark)
    objs = spark.read.format("repository").option("path", str(path / "clone")).load().collect()
    names = {v: k for k, v in identity.KINDS.items()}
    records = [chunks.object_record(bytes(o.data), names[o.kind], "zstd") for o in objs]
    (path / "store/0000000001").mkdir(parents=True)
    (path / "store/0000000001/00000000000000000000.sealed").write_bytes(chunks.chunk_file(records, 1, 0))
    c = catalog.Catalog(spark, f"file://{path}/catalog")
    found = chunks.read_chunks(spark, f"file://{path}/store").persist()
    c.import_objects(found.select(F.lit(bytearray(b"r" * 16)).alias("repo_id"), F.col("algorithm").cast("int").alias("algo"), "oid", "content_id", *[F.col(x).cast("long" if x not in ("kind", "codec", "flags") else "int").alias(x) for x in maintenance.PLACE]))
    return path, c, found, git("rev-parse", "HEAD"), git


def test_checkout(spark, store):
    path, _, _, head, git = store
    objs = spark.read.format("repository").option("path", str(path / "clone")).load().persist()
    c = catalog.Catalog(spark, f"file://{path}/workspaces-catalog")
    folders = {"staging": f"{path}/staging", "workspaces": f"{path}/ws", "trash": f"{path}/ws-trash", "manifests": f"file://{path}/ws-manifests"}
    request = {"workspace_id": b"w" * 16, "repository": b"r" * 16, "snapshot_id": b"s" * 16, "commit": bytes.fromhex(head), "generation": 1, "name": "main", "created_unix_secs": 3}
    plan = checkout.plan_commit(objs, request["commit"])
    want = {tuple(x.split(None, 3)[i] for i in (0, 2, 3)) for x in git("ls-tree", "-r", head).split("\n")}
    assert {(r.mode, bytes(r.oid).hex(), r.path) for r in plan.collect()} == want
    with pytest.raises(checkout.CheckoutError):
        checkout.plan_commit(objs, request["commit"], max_entries=2)
    with pytest.raises(checkout.CheckoutError):
        checkout.plan_commit(objs, b"0" * 20)
    with pytest.raises(checkout.CheckoutError):
        checkout.materialize(plan, objs.filter("kind = 3").limit(0), f"{path}/none")
    out = checkout.checkout_and_persist(c, objs, request, folders)
    assert sorted(os.listdir(out)) == ["dir", "link", "run.sh"] and os.readlink(f"{out}/link") == "dir/a.txt" and os.access(f"{out}/run.sh", os.X_OK) and open(f"{out}/link").read() == "tracked\n"
    manifest = checkout.ready(c, folders["manifests"], request["workspace_id"])
    assert {k: manifest[k] for k in manifests.COUNTERS} == {"directories": 1, "regular_files": 1, "executable_files": 1, "symlinks": 1, "gitlinks": 0, "reflinked_regular_files": 0, "copied_regular_files": 2}
    with pytest.raises(checkout.CheckoutError):
        checkout.checkout_and_persist(c, objs, request | {"workspace_id": b"x" * 16}, folders)
    with pytest.raises(catalog.CatalogError):  # the name is another's: nothing of it stays
        checkout.checkout_and_persist(c, objs, request | {"workspace_id": b"x" * 16}, folders | {"workspaces": f"{path}/ws2"})
    assert os.listdir(f"{path}/ws2") == []
    assert checkout.reconcile(c, folders)["ready"] == 1
    checkout.delete(c, folders, request["workspace_id"])
    assert not os.path.exists(out) and checkout.ready(c, folders["manifests"], request["workspace_id"]) is None and c.read("workspace_names").count() == 1
    with pytest.raises(checkout.CheckoutError):
        checkout.publish(f"{path}/staging", f"{path}/ws", f"{path}/t", "bad name")


def test_gc(spark, store):
    path, c, found, head, _ = store
    roots = spark.createDataFrame([(bytearray(b"r" * 16), bytearray.fromhex(head))], "repo_id binary, oid binary")
    gens = maintenance.Generations(spark, f"file://{path}/generations")
    gens.activate(1)
    with pytest.raises(ValueError, match="limit"):
        maintenance.live_set(roots, c.read("oid_aliases"), c.read("object_locations"), found, max_objects=2)
    with pytest.raises(maintenance.IntegrityError, match="alias"):
        maintenance.live_set(roots, c.read("oid_aliases").filter(F.col("oid") != F.lit(bytearray.fromhex(head))), c.read("object_locations"), found)
    with pytest.raises(maintenance.IntegrityError, match="no location"):
        maintenance.live_set(roots, c.read("oid_aliases"), c.read("object_locations").filter("kind <> 2"), found)
    with pytest.raises(maintenance.IntegrityError, match="missing"):
        maintenance.live_set(roots, c.read("oid_aliases"), c.read("object_locations"), found.filter("kind <> 1"))
    with pytest.raises(maintenance.IntegrityError, match="content id"):
        maintenance.live_set(roots, c.read("oid_aliases"), c.read("object_locations"), found, domain="another")
    lease = gens.lease(1)
    out = maintenance.run_gc(c, gens, found, roots, f"file://{path}/store", 1, 2, chunk_bytes=300)
    assert out == {"live": 6, "dropped": 1, "source": "deferred_by_reader"}
    with pytest.raises(catalog.CatalogError):
        gens.lease(1)
    gens.release(1, lease)
    pin = spark.createDataFrame([(catalog.EXPLICIT_PIN, bytearray(b"p" * 16), 1)], catalog.TABLES["pins"][0])
    c.apply(put={"pins": pin})
    retire = lambda: maintenance.retire_compacted(c, gens, 1, f"file://{path}/store/0000000001", f"file://{path}/trash")
    assert retire() == "deferred_by_pin"
    c.apply(delete={"pins": pin})
    assert retire() == "retired" and not (path / "store/0000000001").exists()
    with pytest.raises(catalog.CatalogError):
        gens.retire(2, "x", "y")
    found.unpersist()  # else Spark takes the scan of the same folder for this one
    now = chunks.read_chunks(spark, f"file://{path}/store")
    assert now.count() == 6 and now.select("chunk_id").distinct().count() > 1
    assert chunks.records_at(now, c.read("object_locations")).filter("problem is not null").isEmpty()
    gens.lease(2)
    gens.activate(1)
    assert gens.drop_abandoned() == 1 and gens.reconcile(c) == 2 and gens.active() == 2


def test_order_faults(spark):
    df = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (3, "b"), (4, "d")], "at long, k string")
    assert [tuple(r) for r in maintenance.order_faults(df, "at", "k").orderBy("at").collect()] == [(2, "b", "c"), (3, "b", "b")]
