import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm import graph, queries, topk
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_oracle(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_document_at_least(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = queries.QUERIES[name](spark, SF).count()
    assert got >= n if "packing" in name else got == n


@pytest.mark.parametrize("block", [topk.CANDIDATES, 40])
def test_top_k_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "FEW", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (300, 16)).astype(np.float32)
    x[50:60] = x[50]
    data = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)] + [(50, x[50].tolist(), "x", 1), (None, x[50].tolist(), "x", 1), (400, None, "x", 1), (401, [1.0, None], "x", 1), (450, [float("nan")] * 16, "x", 1), (402, [], "x", 1), (500, [0.5, 0.5], "x", 1), (550, [], "x", 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank string, score int").repartition(3)
    got = topk.top_k(table, 5, candidates=block).collect()
    good = [(d[0], np.floor(256 * np.pad(np.array(d[1], np.float32).astype(float), (0, 16 - len(d[1]))))) for d in data if d[1] is not None and None not in d[1] and np.isfinite(d[1]).all()]
    want = []
    for i, (q, v) in enumerate(good):
        if q is not None and q % 50 == 0:
            best = sorted((-int(v @ w), c is None, c or 0) for j, (c, w) in enumerate(good) if j != i)[:5]
            want += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(best)]
    key = lambda rows: sorted(map(str, rows))
    assert key((r.query_id, r.rank, r.vec_id, r.score) for r in got) == key(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_top_k_stops_by_bounds(spark, sf):
    """Every query of the test tables stops before its lists end, with the scores of a plain product."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    rows = [r for r in rows if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all()]
    x, ids = np.floor(256 * np.array([r.embedding for r in rows], float)), np.array([r.vec_id for r in rows])
    lists = topk.Lists(x)
    for i in np.flatnonzero(ids % 50 == 0):
        found, scores = lists.top(x[i], 5, int(i), ids)
        every = x @ x[i]
        every[i] = -np.inf
        assert found.tolist() == np.lexsort((ids, -every))[:5].tolist() and scores == every[found].astype(int).tolist()
    assert lists.asked > 0 and lists.ended == 0


@pytest.mark.parametrize("block", [topk.CANDIDATES, 2])
def test_top_k_of_large_components(spark, block):
    """Products beyond a long are ranked exactly and given as the nearest long."""
    data = [(0, [2.0**45, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [2.0**45, 0.5]), (4, [-(2.0**45), 0.0]), (5, [2.0**45, 1.0])]
    data += [(i, [0.001 * i, 0.0]) for i in range(6, 200) if i % 50]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 4, candidates=block).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(5, 2**63 - 1), (3, 2**63 - 1), (2, 2**53 * 512), (1, 2**53 * 256 + 65536)]
    with pytest.raises(Exception, match="2\\*\\*290"):
        topk.top_k(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_top_k_of_nothing_and_of_one(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(50, [1.0])], schema)).count() == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
