import corpus_pipeline
from strataweave.llm import mil, pii
from strataweave.session import written
from tests.llm import cases

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    """Each stage does its work on all that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), "test-stage")
        kept.append(docs)
        if n < 4:
            assert docs.columns == COLUMNS
    first, single, clean, mixed, packed = kept
    pairs = [(r.doc_id, r.text) for r in first.collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    ids = {d for d, _ in pairs}
    assert len(good & ids) >= 0.97 * len(good) and len(bad & ids) <= 0.4 * len(bad)
    groups = cases.near_groups(pairs)
    assert sorted(str(r.doc_id) for r in single.collect()) == sorted({d for d, n, c in groups if d == c or not n})
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        found = pii.entities(before[r.doc_id])
        assert (r.text == before[r.doc_id]) == (not found) and all(v not in r.text for *_, v in found)
    assert {r.doc_id for r in mixed.collect()} <= set(before)
    lengths = {}
    for r in packed.collect():
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= 2048


def test_empty_and_odd_documents(spark):
    docs = cases.documents(spark).select(*COLUMNS, "size")
    empty = docs.limit(0)
    for some in (docs, empty):
        now = some
        for _, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, SF), "test-stage")
        assert (now.count() > 0) == (some is docs)


def test_near_duplicates_of_null_and_shared_ids(spark):
    """Groups of documents, not of ids, lose all but one row."""
    text = lambda k, n=40: " ".join(f"{k}w{i}" for i in range(n))
    near = lambda k: text(k) + " tail"
    data = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (None, near("c")), (None, ""), (None, None), (None, " ")]
    data += [(1, text("d")), (1, text("e")), (1, text("e")), (2, near("d")), (None, near("e")), (3, text("f")), (3, near("f")), (4, ""), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "src1", 1) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == COLUMNS
    said = sorted((str(r.doc_id), (r.text or "").split("w")[0].strip()) for r in got.collect())
    assert said == sorted([("None", "a"), ("None", "b"), ("None", "c"), ("None", ""), ("None", ""), ("None", ""), ("1", "d"), ("1", "e"), ("3", "f"), ("4", ""), ("4", "")])


def test_threshold_is_the_contracts():
    assert mil.THRESHOLD == 0.3
