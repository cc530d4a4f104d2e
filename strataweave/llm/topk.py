"""Exact top-k search by aggregation without random access.

Vectors are turned into integers, and the score is the integer inner product.
A query sees one list per component with a weight other than 0: the candidates
by their part of the score, largest first.  The lists are read in sequence, in
rounds: each goes on to where its parts come within a level of its least part,
and the level falls from round to round, so lists of large weights are read
ahead.  A candidate's lower bound adds the least part of every list it was not
seen in, its upper bound the level (or the list's first part, if nothing was
read).  Only what a round reads changes the bounds.  Candidates whose upper
bound is below the k-th lower bound are out; once at most ``FEW`` times k are
left, reading stops and their final scores are resolved.  Candidates whose upper
bound equals the k-th lower bound stay in, so ties go to smaller ids.

Candidates go in blocks of bounded size, one block a task; a block's lists are
sorted once, and the queries stream past them, so no candidate is copied and a
task holds one block and one batch of queries.  A block gives k candidates per
query, which a window per query merges.  That is the whole query set against
all rows in blocks: work grows with queries times rows.

Bounds are sums of integers in double precision, exact below 2**53; beyond, they
are widened by more than their rounding.  Final scores are exact integers of any
size and ranked as such; the column is a long, and a score beyond it is the
nearest long.

Defined cases: vectors that are null or hold null or non-finite components take
no part; vectors of different length are compared as if padded with zeros, so an
empty one scores 0 with all; components of 2**290 or more are an error; repeated
rows are candidates (and queries) each; a null id is a candidate that loses ties
and no query; a query with fewer candidates than k gets all; an empty table
gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataweave.session import written

SCALE = 256
CANDIDATES = 8192
#: Levels of the rounds, as parts of the widest list; the last one reads the lists to their ends.
LEVELS = (0.25, 0.16, 0.1, 0.06, 0.03, 0)
#: Candidates for each of the k that are resolved when reading stops.
FEW = 32
LARGEST = 2.0**290 * SCALE
_ORDER_BYTES = 80  # of a score and its sign: products of two such components, and their sum


def integer_vectors(table: DataFrame, vector: str, key: str, is_query: Column, scale: int = SCALE) -> DataFrame:
    """The written vectors that take part: __row, __id, __query, __vec (packed integers in double precision)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            out = []
            for x in rows:
                v = None
                if x.is_valid and x.values.null_count == 0:
                    v = x.values.to_numpy(zero_copy_only=False).astype("<f8")
                    v = np.floor(scale * v).tobytes() if _takes_part(v) else None
                out.append(v)
            vec = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vec], ["__id", "__query", "__vec"]).filter(pc.is_valid(vec))

    kind = table.schema[key].dataType.simpleString()
    rows = table.select(F.col(key).alias("__id"), F.coalesce(is_query, F.lit(False)).alias("__query"), vector)
    rows = rows.mapInArrow(pack, f"__id {kind}, __query boolean, __vec binary")
    return written(rows.withColumn("__row", F.monotonically_increasing_id()), "vectors")


def _takes_part(v: np.ndarray) -> bool:
    if not np.isfinite(v).all():
        return False
    if len(v) and np.abs(v).max() >= LARGEST / SCALE:
        raise ValueError("a component of a vector is 2**290 or more")
    return True


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width))
    for i, x in enumerate(packed):
        v = np.frombuffer(x, "<f8")
        out[i, : len(v)] = v
    return out


class Lists:
    """The candidates of a block, sorted by each component.

    A list of a positive weight is read from the high end of its component, one
    of a negative weight from the low end.  ``ended`` counts the queries whose
    lists were read to their ends, ``asked`` all queries.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.n = x, len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = list(np.ascontiguousarray(np.take_along_axis(x, order, 0).T))
        self.order = list(np.ascontiguousarray(order.T))
        self.most = np.abs(x).max(0) if len(x) else np.zeros(x.shape[1])
        self.asked = self.ended = 0

    def top(self, q: np.ndarray, k: int, own: int, ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The k best candidates but ``own`` (-1: none) for the weights q, and their scores; ``ids`` ranks equal scores."""
        self.asked += 1
        n, lists = self.n, np.flatnonzero(q)
        alive = np.flatnonzero(np.arange(n) != own)
        if not len(alive):
            return alive, []
        w = q[lists]
        bound = float((np.abs(w) * self.most[lists]).sum())
        slack = 0.25 if bound < 2.0**51 else bound * (len(w) + 4) * 2.0**-50  # parts are integers, levels are not
        high = w > 0
        low, top = (np.array([self.sorted[j][at] for j in lists], float) for at in (0, -1))
        first, last = np.where(high, low, top), np.where(high, top, low)
        least, reach = w * first, w * (last - first)  # of each list: its least part, and how far its largest is above
        lower, unseen = np.full(n, least.sum()), np.zeros(n)
        levels = np.array(LEVELS) * (reach.max() if len(w) else 0)
        # in every list and round, read on while parts are above the list's least one by more than the level
        upto = [n - self.sorted[j].searchsorted(f + levels / x, "right") if x > 0 else self.sorted[j].searchsorted(f + levels / x, "left") for j, x, f in zip(lists, w, first)]
        upto = np.maximum.accumulate(np.reshape(upto, (len(w), len(levels))), 1)
        before = np.zeros(len(w), np.int64)
        for level, now in zip(levels, upto.T) if len(w) else ():
            if len(alive) <= FEW * k:
                break
            slabs = [(j, slice(b, e)) for j, b, e in zip(lists.tolist(), np.where(high, n - now, before).tolist(), np.where(high, n - before, now).tolist())]
            seen, some = np.concatenate([self.order[j][x] for j, x in slabs]), np.concatenate([self.sorted[j][x] for j, x in slabs])
            some = (some - np.repeat(first, now - before)) * np.repeat(w, now - before)  # above the least part, which all had from the start
            lower += np.bincount(seen, some, n)
            unseen -= np.bincount(seen, minlength=n)
            before = now
            # unseen parts: up to the level in lists that reach it, up to the first part in those of which nothing was read
            upper = (lower + level * (unseen + (reach >= level).sum()))[alive] + reach[reach < level].sum()
            kth = np.partition(lower[alive], len(alive) - k)[len(alive) - k]
            alive = alive[upper + slack >= kth - slack]
        else:
            self.ended += 1
        return self._resolved(q, alive, k, ids, bound)

    def _resolved(self, q: np.ndarray, some: np.ndarray, k: int, ids: np.ndarray, bound: float) -> tuple[np.ndarray, list[int]]:
        if bound < 2.0**51:
            scores = self.x[some] @ q
        elif bound < 2.0**62:
            used = np.flatnonzero(q)
            scores = self.x[np.ix_(some, used)].astype(np.int64) @ q[used].astype(np.int64)
        else:
            weights = [int(v) for v in q]
            scores = np.array([sum(a * int(b) for a, b in zip(weights, row) if a) for row in self.x[some]], object)
        best = sorted(range(len(some)), key=lambda i: (-scores[i], ids[some[i]]))[:k] if scores.dtype == object else np.lexsort((ids[some], -scores))[:k]
        return some[best], [int(scores[i]) for i in best]


def _order(score: int) -> bytes:
    """Bytes that compare as the scores do."""
    return (score + (1 << (8 * _ORDER_BYTES - 1))).to_bytes(_ORDER_BYTES, "big")


def _blocks(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def top_k(table: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", is_query: Column | None = None, scale: int = SCALE, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, the candidate's key, score."""
    spark = table.sparkSession
    rows = integer_vectors(table, vector, key, F.col(key) % 50 == 0 if is_query is None else is_query, scale)
    n, size = rows.agg(F.count("*"), F.max(F.octet_length("__vec"))).first()
    blocks, width = max(1, math.ceil(n / candidates)), (size or 0) // 8
    kind, arrow = table.schema[key].dataType.simpleString(), to_arrow_type(table.schema[key].dataType)
    there = rows.select(_blocks("__row", blocks).alias("__block"), F.lit(False).alias("__asks"), "__row", "__id", "__vec")
    asked = rows.filter("__query").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"), F.lit(True).alias("__asks"), "__row", "__id", "__vec")
    met = there.unionByName(asked).repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "__block").sortWithinPartitions("__block", "__asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, lists = None, [], None
        for batch in batches:
            at = np.flatnonzero(np.diff(batch.column(0).to_numpy(), prepend=-1))
            for a, b in zip(at, [*at[1:], batch.num_rows]):
                own = batch.slice(a, b - a)
                if own.column(0)[0].as_py() != block:
                    block, held, lists = own.column(0)[0].as_py(), [], None
                asks = own.column(1).to_numpy(zero_copy_only=False)
                first = int(asks.argmax()) if asks.any() else len(asks)
                held.append(own.slice(0, first))
                if first == len(asks):
                    continue
                if lists is None:
                    c_rows, ids, vecs = (sum((h.column(c).to_pylist() for h in held), []) for c in (2, 3, 4))
                    rank = np.empty(len(ids), np.int64)
                    rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
                    place, lists = {r: i for i, r in enumerate(c_rows)}, Lists(_matrix(vecs, width))
                    held = []
                out = []
                q_rows, q_ids, q_vecs = (own.slice(first).column(c).to_pylist() for c in (2, 3, 4))
                for r, ident, q in zip(q_rows, q_ids, _matrix(q_vecs, width)):
                    found, scores = lists.top(q, k, place.get(r, -1), rank)
                    out += [(r, ident, ids[i], max(-(2**63), min(2**63 - 1, s)), _order(s)) for i, s in zip(found.tolist(), scores)]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), arrow, arrow, pa.int64(), pa.binary()))], ["__row", "query_id", key, "score", "__order"])

    found = met.mapInArrow(search, f"__row long, query_id {kind}, `{key}` {kind}, score long, __order binary")
    order = Window.partitionBy("__row").orderBy(F.desc("__order"), F.asc_nulls_last(key))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
