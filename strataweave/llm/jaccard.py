"""N-gram Jaccard join by rare-first prefix filtering.

A document is the set of its distinct word n-grams.  Two documents link when
their Jaccard similarity is at least 75 in 100.

One pass over the texts numbers the words, hashes the n-grams (64 bits) and finds
equal sets, which are one node.  The sorted hashes go in delta-coded blocks to the tasks of their hash
ranges, which count how many nodes hold each n-gram.  Those that several hold
are postings from here on: an n-gram that one node holds stands first in the
rare-first order and can match nothing.  An n-gram that ``HOT`` nodes of one task
hold is common for certain: it stands last in the order, its postings skip that
exchange and spread evenly, and its range gets one mark a task.

Per node its shared n-grams are sorted rare first.  With ``n`` n-grams the
prefix has ``n - ceil(0.75 n) + 1``; most nodes have so many n-grams of their
own that no shared one is left in it.  Prefix n-grams are joined under the
length filter, the positional filter, and a suffix filter that compares parity
bitmaps of the whole sets (the bits that differ are at most the symmetric
difference).  A pair meets at its first common n-gram.  Each pair is verified once, exactly, on the shared n-grams.

Pairs in two steps, so that a large group of near copies doesn't give all its
pairs.  First, in a few turns, every prefix n-gram pairs its nodes with one of
them, drawn anew each turn; the links found give components, and n-grams inside
one component drop out.  Then, exactly, all pairs of prefix n-grams that still
span two components, which are those that can change the result.  Nothing is
capped.

Defined cases: null texts and texts without words have the empty set and link
with nothing; fewer words than ``n`` are one n-gram; repeated rows are equal
sets; ties don't matter; an empty table gives no row; null ids stay and don't
name a component that has another id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm import graph, words
from strataweave.session import forget, written

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
#: N-grams a task gathers before it sorts and sends them, and text bytes per hash range.
GATHERED = 800_000
RANGE_BYTES = 5 << 20
CHUNK_BYTES = 1 << 20
BITMAP_LONGS = 8
#: Lists longer than this are paired in parts.
LIST = 2048
#: Places before an entry that a pair's two entries compare, so that a pair meets at its first common n-gram only.
WINDOW = 16
#: Turns of stars before all pairs; more turns change only how much is left for those.
TURNS = 2
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def ngram_hashes(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each text, by row, then hash."""
    import xxhash

    values, codes, at = words.numbered(texts)
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in values.to_pylist()), np.uint64, len(values))
    w = one[codes] if len(codes) else np.empty(0, np.uint64)
    counts = np.diff(at)
    row = np.repeat(np.arange(len(counts)), counts)
    h = w.copy()
    left = np.repeat(at[1:], counts) - np.arange(len(w))  # words from here to the end of the text
    with np.errstate(over="ignore"):
        for k in range(1, n):
            nxt = np.zeros(len(w), np.uint64)
            nxt[:-k or None] = w[k:] if k < len(w) else 0
            h = np.where(left > k, h * _P + nxt, h)
        h = _mix(h + np.minimum(left, n).astype(np.uint64) * _M1)
    whole = (left >= n) | ((np.arange(len(w)) == at[row]) if len(w) else False)
    row, h = row[whole], h[whole]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes over 512 cells, as 8 signed longs."""
    cells = (h & np.uint64(64 * BITMAP_LONGS - 1)).astype(np.int64)
    odd = (np.bincount(cells, minlength=64 * BITMAP_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd).view(">i8").astype(np.int64)


def _coded(x: np.ndarray) -> bytes:
    """Ascending numbers as differences of the least whole bytes, the width first."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _decoded(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :width] = body
    out = out.view("<u8").ravel()
    return np.cumsum(out, dtype=np.uint64, out=out)


#: Nodes of one task that make an n-gram common, its place in the rare-first order, and the owner that marks it.
HOT, LAST, MARK = 8, 1 << 40, 0xFFFF
#: kind 0: a document (id, its node); 1: a node (digest, n, bitmap); 2: n-grams and their owners; 3: postings of common n-grams.
SENT = "__to long, __kind byte, __node long, doc_id {kind}, __digest binary, __n long, __bits array<long>, __grams binary, __owners binary"
FOUND = "__kind byte, __node long, doc_id {kind}, __digest binary, __n long, __bits array<long>, __gram long"


def _sender(ranges: int, n: int, id_type: pa.DataType):
    names = [c.split()[0] for c in SENT.split(", ")]
    kinds = [pa.int64(), pa.int8(), pa.int64(), id_type, pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[x].cast(k) if x in columns else pa.nulls(size, k) for x, k in zip(names, kinds)], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        nodes: dict[bytes, int] = {}  # of what is gathered; equal sets before a flush and after it are nodes each
        base = after = task << 32  # owners count from here, in two bytes
        grams: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size, spread = 0, task * 7919

        def even(k: int) -> pa.Array:
            nonlocal spread
            spread += k
            return pa.array((spread + np.arange(k)) % ranges)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, spread
            nodes.clear()
            if not size:
                return
            g, o = np.concatenate(grams), np.concatenate(owners)
            grams.clear()
            owners.clear()
            size = 0
            order = np.argsort(g, kind="stable")
            g, o = g[order], o[order]
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            runs = np.diff(np.append(starts, len(g)))
            common = np.repeat(runs >= HOT, runs)
            hot_g, hot_o = g[common], o[common]
            for a in range(0, len(hot_g), 100_000):
                some = slice(a, a + 100_000)
                spread += 1
                yield rows(1, __to=pa.array([spread % ranges]), __kind=pa.array([3]), __node=pa.array([base]), __grams=pa.array([_coded(hot_g[some])]), __owners=pa.array([hot_o[some].tobytes()]))
            first = np.zeros(len(g), bool)
            first[starts] = True
            o = np.where(common, np.uint16(MARK), o)
            g, o = g[~common | first], o[~common | first]
            to = ((g >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(g)]))
            to, blocks = to[cut[:-1]].astype(np.int64), list(zip(cut[:-1], cut[1:]))
            for a in range(0, len(blocks), 64):
                some = blocks[a : a + 64]
                k = len(some)
                yield rows(k, __to=pa.array(to[a : a + k]), __kind=pa.array([2] * k), __node=pa.array([base] * k), __grams=pa.array([_coded(g[x:y]) for x, y in some]), __owners=pa.array([o[x:y].tobytes() for x, y in some]))

        for batch in batches:
            for start, texts in words.chunks(batch.column(1), CHUNK_BYTES):
                ids = batch.column(0).slice(start, len(texts))
                row, h = ngram_hashes(texts, n)
                bounds = np.searchsorted(row, np.arange(len(texts) + 1))
                own, new = [], []
                for i in range(len(texts)):
                    mine = h[bounds[i] : bounds[i + 1]]
                    if not len(mine):
                        own.append(None)
                        continue
                    digest = hashlib.blake2b(mine.tobytes(), digest_size=16).digest()
                    if digest not in nodes:
                        if after - base >= MARK:
                            yield from flush()
                            base = after
                        nodes[digest] = after
                        after += 1
                        new.append((nodes[digest], digest, len(mine), bitmap(mine).tolist()))
                        grams.append(mine)
                        owners.append(np.full(len(mine), nodes[digest] - base, np.uint16))
                        size += len(mine)
                    own.append(nodes[digest])
                yield rows(len(texts), __to=even(len(texts)), __kind=pa.array([0] * len(texts)), __node=pa.array(own, pa.int64()), doc_id=ids, __n=pa.array(np.diff(bounds)))
                if new:
                    node, digest, count, bits = zip(*new)
                    k = len(new)
                    yield rows(k, __to=even(k), __kind=pa.array([1] * k), __node=pa.array(node), __digest=pa.array(digest, pa.binary()), __n=pa.array(count), __bits=pa.array(bits))
                if size >= GATHERED:
                    yield from flush()
                    base = after
        yield from flush()
        words.trim()

    return send


def _shared(table: pa.Table) -> pa.Table:
    """One range: documents and nodes as they came, and the postings of n-grams that several nodes hold.

    A posting's ``__n`` is the place of its n-gram in the rare-first order: how
    many nodes hold it, or LAST for one that is common in some task.
    """
    names = [c.split()[0] for c in FOUND.split(", ")]
    plain = table.filter(pc.less(table.column("__kind"), 2))
    plain = plain.select(names[:-1]).append_column("__gram", pa.nulls(plain.num_rows, pa.int64()))
    parts, kept = [], []
    for r in table.filter(pc.greater(table.column("__kind"), 1)).select(["__kind", "__node", "__grams", "__owners"]).to_batches():
        for kind, base, grams, owners in zip(*(c.to_pylist() if n < 2 else c for n, c in enumerate(r.columns))):
            o = np.frombuffer(owners.as_buffer(), np.uint16)
            node = np.where(o == MARK, -1, o.astype(np.int64) + base)
            (kept if kind == 3 else parts).append((_decoded(grams.as_buffer()), node))
    done_g, done_node = (np.concatenate(c) for c in zip(*kept)) if kept else (np.empty(0, np.uint64), np.empty(0, np.int64))
    g, node = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
    parts.clear()
    order = np.argsort(g, kind="stable")
    g, node = g[order], node[order]
    del order
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
    runs = np.diff(np.append(starts, len(g)))
    marked = np.logical_or.reduceat(node < 0, starts) if len(g) else np.empty(0, bool)
    several = np.repeat((runs > 1) | marked, runs) & (node >= 0)
    place = np.repeat(np.where(marked, LAST, runs), runs)[several]
    place = np.concatenate([np.full(len(done_g), LAST), place])
    g, node = np.concatenate([done_g, g[several]]), np.concatenate([done_node, node[several]])
    columns = {f.name: pa.nulls(len(g), f.type) for f in plain.schema}
    columns |= {"__kind": pa.array(np.full(len(g), 3, np.int8)), "__node": pa.array(node), "__n": pa.array(place), "__gram": pa.array(g.view(np.int64))}
    return pa.concat_tables([plain, pa.table([columns[x] for x in plain.schema.names], schema=plain.schema)])


def _grouped(f):
    """Applies f to each group of equal ``__to`` of a task's sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            to = batch.column(0)
            for t in pc.unique(to).to_pylist():
                if t != now and held:
                    yield from f(pa.Table.from_batches(held)).combine_chunks().to_batches(max_chunksize=100_000)
                    held.clear()
                now = t
                held.append(batch.filter(pc.equal(to, t)))
        if held:
            yield from f(pa.Table.from_batches(held)).combine_chunks().to_batches(max_chunksize=100_000)
        held.clear()
        words.trim()

    return run


def postings(docs: DataFrame, n: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The written documents, nodes and postings (see ``FOUND``)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / RANGE_BYTES))
    kind = docs.schema[key].dataType
    sent = docs.select(F.col(key).alias("doc_id"), text).mapInArrow(_sender(ranges, n, to_arrow_type(kind)), SENT.format(kind=kind.simpleString()))
    dealt = sent.repartition(ranges, "__to").sortWithinPartitions("__to")
    return written(dealt.mapInArrow(_grouped(_shared), FOUND.format(kind=kind.simpleString())), "jaccard-postings")


# ---- the join -----------------------------------------------------------------------


def _least(n):
    """The least intersection of a set of n with any set it links to: ceil(0.75 n)."""
    return F.ceil(n * NUMERATOR / F.lit(DENOMINATOR)).cast("long")


def sets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, rep) of all nodes, and per rep its n, bitmap and shared n-grams, rare first.

    Nodes of equal sets in several tasks are one class; only the postings of
    its rep are used, so what only they share matches nothing later.
    """
    nodes = found.filter("__kind = 1").select(F.col("__node").alias("node"), F.col("__digest").alias("digest"), F.col("__n").alias("n"), F.col("__bits").alias("bits"))
    reps = nodes.groupBy("digest").agg(F.min("node").alias("rep"), F.min_by("n", "node").alias("n"), F.min_by("bits", "node").alias("bits"))
    names = written(nodes.select("node", "digest").join(reps.select("digest", "rep"), "digest").select("node", "rep"), "jaccard-nodes")
    copies = written(names.filter("node <> rep").select("node"), "jaccard-copies")
    own = found.filter("__kind = 3").select(F.col("__node").alias("node"), F.col("__n").alias("place"), F.col("__gram").alias("gram"))
    own = own.join(copies, "node", "left_anti")
    grams = own.groupBy(F.col("node").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("x"))
    grams = grams.select("rep", F.col("x.gram").alias("grams"))
    return names, written(reps.select("rep", "n", "bits").join(grams, "rep"), "jaccard-sets")


def prefixes(rows: DataFrame) -> DataFrame:
    """(gram, rep, n, at): the shared n-grams in each prefix; ``at`` counts the whole set, rare first."""
    alone = F.col("n") - F.size("grams")
    inside = F.col("n") - _least(F.col("n")) + 1 - alone
    some = rows.withColumn("__in", inside.cast("int")).filter("__in > 0")
    at = F.posexplode(F.slice("grams", F.lit(1), F.col("__in"))).alias("__i", "gram")
    return some.select("rep", "n", alone.alias("__alone"), at).select("gram", "rep", "n", (F.col("__alone") + F.col("__i")).alias("at"))


def _may(an, bn, aat, bat, first: bool = False):
    """Length and positional filters for a common n-gram at these places; ``first``: for the first one, before which nothing is common."""
    smaller, larger = F.least(an, bn), F.greatest(an, bn)
    most = (0 if first else F.least(aat, bat)) + 1 + F.least(an - aat - 1, bn - bat - 1)
    return (smaller * DENOMINATOR >= larger * NUMERATOR) & (most * (DENOMINATOR + NUMERATOR) >= (an + bn) * NUMERATOR)


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; suffix filter first, then the exact intersection."""
    light = rows.select("rep", "n", "bits")
    a = light.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("bits").alias("abits"))
    b = light.select(F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bbits"))
    x = pairs.join(a, "a").join(b, "b")
    x = x.filter(_near(_apart("abits", "bbits"), F.col("an"), F.col("bn"))).select("a", "b", "an", "bn")
    x = x.join(rows.select(F.col("rep").alias("a"), F.col("grams").alias("ag")), "a").join(rows.select(F.col("rep").alias("b"), F.col("grams").alias("bg")), "b")
    both = F.size(F.array_intersect("ag", "bg"))
    return x.filter(both * DENOMINATOR >= (F.col("an") + F.col("bn") - both) * NUMERATOR).select("a", "b")


def _apart(a: str, b: str):
    """Bits in which two bitmaps differ."""
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITMAP_LONGS)]
    return sum(bits[1:], bits[0])


def _near(apart, an, bn):
    # an intersection of 75/175 of both sizes leaves 25/175 of them apart
    return apart * (DENOMINATOR + NUMERATOR) <= (an + bn) * (DENOMINATOR - NUMERATOR)


def spanning(entries: DataFrame, found: DataFrame | None) -> DataFrame:
    """Entries with their component, of n-grams that span two components; ``m`` counts the n-gram's entries."""
    if found is None:
        named = entries.withColumn("component", F.col("rep"))
    else:
        c = found.select(F.col("node").alias("rep"), "component")
        named = entries.join(c, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    spans = named.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"))
    return named.join(spans.filter("x < y").select("gram", "m"), "gram")


def star_pairs(some: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs of each n-gram's nodes with one of them, drawn anew for each turn and n-gram."""
    lot = F.xxhash64("rep", "gram", F.lit(turn))
    centre = some.groupBy("gram").agg(F.min_by(F.struct("rep", "n", "at", "component"), lot).alias("c"))
    x = some.join(centre, "gram").filter((F.col("component") != F.col("c.component")) & _may(F.col("n"), F.col("c.n"), F.col("at"), F.col("c.at")))
    return x.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()


def rest_pairs(some: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct pairs of nodes of two components that share a prefix n-gram, after all filters.

    A pair that links passes the filters at its first common n-gram, so it needs
    to meet there only: the positional filter counts nothing before, and entries
    with a common n-gram among the ``WINDOW`` before them don't meet again. So a
    pair gives about one row, not one for each n-gram that it shares.
    Sizes that link are of one band or of neighbours, as a band reaches from a
    size to its 100/75: the larger set of a pair meets its own band, the smaller
    its own and the next, so sets of other sizes don't meet.
    """
    some = some.join(rows.select("rep", "bits", "grams"), "rep")
    # the n-grams just before an entry; the first ones of a set are those that no other set holds
    i = (F.col("at") - F.col("n") + F.size("grams")).cast("int")
    some = some.withColumn("before", F.slice("grams", F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i, F.lit(WINDOW)))).drop("grams")
    scale = F.log(F.col("n").cast("double")) / math.log(DENOMINATOR / NUMERATOR)
    band, reached = F.floor(scale).cast("int"), F.sequence(F.floor(scale - 1e-6).cast("int"), F.floor(scale + 1 + 1e-6).cast("int"))
    # a long list is cut into parts, and every two parts meet once
    parts = F.ceil(F.col("m") / F.lit(LIST)).cast("int")
    some = some.withColumns({"__band": band, "__reached": reached, "__parts": parts}).withColumn("__part", F.pmod(F.xxhash64("rep"), F.col("__parts")).cast("int"))
    cols = [F.col(c) for c in ("rep", "n", "at", "component", "bits", "before", "__part")]
    every = F.sequence(F.lit(0), F.col("__parts") - 1)
    larger = some.select("gram", F.col("__band").alias("__b"), F.explode(every).alias("__other"), *[c.alias(f"b{n}") for c, n in zip(cols, ("rep", "n", "at", "component", "bits", "before", "part"))])
    # the smaller set's first common n-gram leaves it as many places as the least intersection with a set of its size
    short = some.filter((F.col("n") - F.col("at")) * (DENOMINATOR + NUMERATOR) >= F.col("n") * 2 * NUMERATOR)
    smaller = short.select("gram", F.explode("__reached").alias("__b"), *cols)
    smaller = smaller.select("gram", "__b", *[c.alias(f"a{n}") for c, n in zip(cols, ("rep", "n", "at", "component", "bits", "before", "part"))])
    # part p of the smaller side meets row p of each larger set's parts, so each pair meets once
    x = smaller.join(larger, (smaller["gram"] == larger["gram"]) & (smaller["__b"] == larger["__b"]) & (smaller["apart"] == larger["__other"]))
    x = x.filter(
        ((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("arep") < F.col("brep")))) & (F.col("acomponent") != F.col("bcomponent"))
        & _may(F.col("an"), F.col("bn"), F.col("aat"), F.col("bat"), first=True) & _near(_apart("abits", "bbits"), F.col("an"), F.col("bn"))
        & ~F.arrays_overlap("abefore", "bbefore")
    )
    return x.select(F.least("arep", "brep").alias("a"), F.greatest("arep", "brep").alias("b")).distinct()


def linked(entries: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(node, component) of all nodes with a link; None if there is none.

    Turns of stars first, then all pairs that still span two components.
    """
    found = tried = None
    turn = 0
    while True:
        last = turn >= TURNS
        some = written(spanning(entries, found), "jaccard-spanning")
        pairs = rest_pairs(some, rows) if last else star_pairs(some, turn)
        if tried is not None:  # each pair is verified once
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "jaccard-pairs")
        edges = verified(pairs, rows)
        if found is not None:  # a node stands for its component
            c = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"{x}c"))
            edges = edges.join(c("a"), "a", "left").join(c("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
        edges = written(edges.distinct(), "jaccard-links")
        gained = not edges.isEmpty()
        if gained:
            known = edges if found is None else edges.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            found = written(graph.components(known), "jaccard-components")
        forget(some)
        if last:
            return found
        tried = pairs if tried is None else tried.unionByName(pairs)
        turn = turn + 1 if gained else TURNS


def near_duplicates(docs: DataFrame, n: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    found = postings(docs, n, text, key)
    names, rows = sets(found)
    own = written(found.filter("__kind = 0").select("doc_id", F.col("__node").alias("node"), F.col("__n").alias("n_shingles")), "jaccard-own")
    forget(found)  # the postings are in ``rows`` now
    entries = written(prefixes(rows), "jaccard-prefixes")
    joined = linked(entries, rows)
    if joined is None:
        of = names.select("node", F.col("rep").alias("component"))
    else:
        of = names.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    full = written(own.filter("node is not null").join(of, "node").select("doc_id", "n_shingles", "component"), "jaccard-documents")
    least = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    empty = own.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.join(least, "component").select("doc_id", "n_shingles", "component_id").unionByName(empty)
