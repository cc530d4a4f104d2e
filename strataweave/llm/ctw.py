"""Language-model scoring by context-tree weighting.

Each byte is eight binary decisions along a tree of 255 nodes.  For every
context of 0 to ``depth`` bytes and every node of the byte, the training texts give
counts of zeros and ones; Krichevsky-Trofimov estimates of all depths are mixed
by the weights of the context tree: ``Pw = (Pe + product of the children's Pw)
/ 2``, ``Pw = Pe`` at the deepest contexts.  A text's code length is the sum of
the conditional mixture's ``-log2`` over its bytes, with the counts of training
frozen.  Contexts before a text's start are zero bytes.

Beside it, words give the add-one unigram score.

How it is spread out.  Texts go into blocks of bounded bytes, written once.
Every block lists its distinct words and its distinct strings of a context and a
byte with their training counts; these are all that is gathered from the corpus, and they grow
with it.  Words are summed over blocks and joined back to them.  The strings of a
block are sorted and packed, a row for each two bytes before the last; the rows of
all blocks for such two bytes are a group, which holds all levels of the tree from two bytes on;
how many strings it has grows with the depth and the corpus (at most 65,536 for
contexts of 3 bytes).  The two upper levels have at most 65,536 nodes together
and are the only thing that goes through the driver.  A group answers each of its
rows with the code lengths of that row's strings, in their order, and a block
gets the answers and the counts of its words in a group and sums them up per
text, so no worker ever holds the model.

Defined cases: null and empty texts have one token (the end) and log10 score 0
under the byte model; null ids take the fold of the empty string; repeated rows
are scored each; very long texts are a block of their own; an empty table gives
no row; without training texts every byte costs 8 bits.  A text that repeats one
pair of bytes throughout is one range of strings, and takes about 40 bytes a byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm import words
from strataweave.session import forget, written

DEPTH = 3
BLOCK_BYTES = 32 << 20
#: Strings of a block that are sorted at once, unless more share their nearest two bytes.
RANGE = 2 << 20
SLICE_BYTES = 1 << 20
#: Code lengths travel in steps of this part of a bit, so a byte's is at most 2e-9 bits off.
STEPS = 1 << 28


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


# ---- byte strings of a block ----------------------------------------------------


def strings_of(texts: pa.Array, depth: int = DEPTH, most: int = RANGE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The strings that end at each byte, in ranges of about ``most`` of ascending nearest two bytes: (where each row's start (rows + 1), strings).

    A string is an integer: the context's bytes, nearest first, then zeros up to seven, then the byte.
    Strings of equal nearest two bytes are in one range, so no string is in two.
    """
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size + 7)
    # seven zeros before each text; a long read at any place then holds a byte and its context
    flat = np.frombuffer((b"\0" * 7).join([b"", *(x.as_buffer() for x in texts)]), np.uint8)
    wide = np.ndarray((max(0, len(flat) - 7),), "<u8", flat, strides=(1,))
    cut = ~np.uint64(((1 << 8 * (7 - depth)) - 1) << 8)
    inside = np.ones(len(wide), bool)
    inside[((ends[:-1] - 7)[:, None] + np.arange(7)).ravel()] = False
    lead = (flat[6:-1].astype(np.uint16) << np.uint16(8)) | flat[5:-2]
    upto = np.zeros(1 << 16, np.int64)
    for i in range(0, len(wide), SLICE_BYTES):
        upto += np.bincount(lead[i : i + SLICE_BYTES][inside[i : i + SLICE_BYTES]], minlength=1 << 16)
    upto = np.cumsum(upto)
    total = int(upto[-1])
    cuts = np.unique(np.searchsorted(upto, np.arange(0, total, most)[1:], "right"))
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), 1 << 16]) if total else ():
        at = np.flatnonzero(inside & (lead >= lo) & (lead <= max(hi - 1, 0)))
        if not hi or not len(at):
            continue
        read = wide[at]
        yield np.concatenate(([0], np.searchsorted(at, ends - 7))), ((read << np.uint64(8)) | (read >> np.uint64(56))) & cut


def suffix_codes(strings: np.ndarray) -> np.ndarray:
    """The strings with the context's bytes in the order of the text."""
    return ((strings >> np.uint64(8)) | (strings << np.uint64(56))).byteswap()


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending; ``x`` is sorted in place, which takes less than the hash table of ``np.unique``."""
    x.sort()
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]


def counted(texts: pa.Array, mask: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings, ascending, and how often each stands in the rows of the mask."""
    found, times = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for bounds, strings in strings_of(texts, depth):
        inside = np.repeat(mask, np.diff(bounds))
        some, n = np.unique(strings[inside], return_counts=True)
        every = _distinct(np.concatenate([some, _distinct(strings[~inside])]))
        total = np.zeros(len(every), np.uint32)
        total[np.searchsorted(every, some)] = n
        found.append(every)
        times.append(total)
    return np.concatenate(found), np.concatenate(times)


def groups_of(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending strings: the nearest two bytes of each run that shares them, and where the runs start (runs + 1)."""
    lead = (strings >> np.uint64(48)).astype(np.int32)
    at = np.flatnonzero(np.diff(lead, prepend=-1))
    return lead[at], np.append(at, len(strings))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed value, byte by byte of each: leading zeros then take nothing."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return pa.compress(planes, "zstd", asbytes=True)


def unpacked(value: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    """The columns of ``packed``."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    flat, out, at = np.frombuffer(pa.decompress(value, n * sum(sizes), "zstd"), np.uint8), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def pack_strings(strings: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending strings, as steps, and their counts."""
    return packed(np.diff(strings, prepend=np.uint64(0)), n)


def unpack_strings(value: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpacked(value, n, np.uint64, np.uint32)
    return np.cumsum(steps, dtype=np.uint64), counts


def pack_bits(bits: np.ndarray) -> bytes:
    """Code lengths in steps of 1 / ``STEPS`` bit."""
    return packed(np.rint(bits * STEPS).astype(np.uint64))


def unpack_bits(value: bytes, n: int) -> np.ndarray:
    return unpacked(value, n, np.uint64)[0] / STEPS


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over [bounds[i], bounds[i + 1])."""
    out = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out


# ---- pass one: blocks, their words and strings ------------------------------------

TEXT, WORD, STRINGS = 0, 1, 2
BLOCKS = "__kind int, __block long, __at int, __n long, __key binary"
ROWS = [c.split()[0] for c in BLOCKS.split(", ")]


def _rows(kind: int, block: int | np.ndarray, at: np.ndarray, n: np.ndarray, keys: pa.Array | list) -> pa.RecordBatch:
    k = len(at)
    block = np.broadcast_to(np.asarray(block, np.int64), k)
    keys = keys if isinstance(keys, pa.Array) else pa.array(keys, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(block), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64)), keys], ROWS)


def pack_texts(ids: pa.Array, folds: pa.Array, texts: pa.Array) -> bytes:
    """The documents of a block as one compressed value."""
    batch = pa.RecordBatch.from_arrays([ids, folds, texts], ["doc_id", "held_out", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_texts(value: pa.Buffer) -> pa.RecordBatch:
    with pa.ipc.open_stream(value) as source:
        return source.read_next_batch()


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, depth: int = DEPTH) -> DataFrame:
    """Written rows of each block, by kind.

    ``TEXT``: its documents, packed, and how many are trained on.  ``WORD``: a word, its number and
    training count.  ``STRINGS``: two nearest bytes (``__at``), how many strings, the strings with their counts, packed.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, size
            ids, folds, texts = (pa.concat_arrays([x[k] for x in held]) for k in range(3))
            held.clear()
            size = 0
            train = ~folds.to_numpy(zero_copy_only=False).astype(bool)
            yield _rows(TEXT, block, np.zeros(1), train.sum(keepdims=True), [pack_texts(ids, folds, texts)])
            low = _lowered(texts)
            del ids, folds, texts
            values, codes, rows = words.numbered(low, lower=False)
            n_words = np.bincount(codes[np.repeat(train, np.diff(rows))], minlength=len(values))
            values = values.cast(pa.binary())
            del codes, rows
            for a in range(0, len(values), 50_000):
                some = values.slice(a, 50_000)
                yield _rows(WORD, block, np.arange(a, a + len(some)), n_words[a : a + len(some)], some)
            del values, n_words
            strings, n = counted(low, train, depth)
            lead, at = groups_of(strings)
            for a in range(0, len(lead), 256):
                runs = list(zip(at[a : a + 256], at[a + 1 : a + 257]))
                yield _rows(STRINGS, block, lead[a : a + 256], np.array([j - i for i, j in runs]), [pack_strings(strings[i:j], n[i:j]) for i, j in runs])
            block += 1

        for batch in batches:
            for first, texts in words.chunks(batch.column(2), block_bytes):
                n = len(texts)
                more = pc.sum(pc.binary_length(texts)).as_py() or 0
                if held and size + more > block_bytes:
                    yield from flush()
                held.append((batch.column(0).slice(first, n), batch.column(1).slice(first, n), texts))
                size += more
        if held:
            yield from flush()
        words.trim()

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("__held"), "text")
    return written(rows.mapInArrow(cut, BLOCKS), "lm-blocks", by="__kind")


def packed_sums(sums: DataFrame) -> DataFrame:
    """``WORD`` rows of packed (number, count) from a row a word (__block, __at, __n)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            block, at, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
            held.clear()
            order = np.lexsort((at, block))
            block, at, n = block[order], at[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            runs = list(zip(first, np.append(first[1:], len(block))))
            return _rows(WORD, block[first], np.zeros(len(first)), np.array([j - i for i, j in runs]), [packed(np.diff(at[i:j], prepend=np.int32(0)), n[i:j]) for i, j in runs])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > 500_000:
                yield flush()
        if held:
            yield flush()

    return sums.select("__block", "__at", "__n").mapInArrow(pack, BLOCKS)


# ---- the tree -----------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma for x > 0: Stirling's series after a shift by 8."""
    small = np.ones_like(x)
    for k in range(8):
        small = small * (x + k)
    y = x + 8
    r = 1 / y
    series = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(small)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    # the product of the shift overflows only for huge x, where it is not needed
    return np.where(x > 1e6, (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x), log_gamma(np.minimum(x, 1e6)))


#: Logs of gamma at the halves and wholes that counts below this need.
COUNTS = 1 << 14
_HALVES, _WHOLES = _log_gamma(np.arange(COUNTS) + 0.5), _log_gamma(np.arange(COUNTS) + 1.0)


def _looked_up(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, COUNTS - 1).astype(np.int64)]
    large = n >= COUNTS
    if large.any():
        out[large] = _log_gamma(n[large] + shift)
    return out


#: Counts of both bits below this are looked up together.
FEW = 128


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    few = np.maximum(zeros, ones) < FEW
    out = _FEW_KT[np.where(few, zeros * FEW + ones, 0).astype(np.int32)]
    if not few.all():
        out[~few] = _log_kt(zeros[~few], ones[~few])
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _looked_up(_HALVES, zeros, 0.5) + _looked_up(_HALVES, ones, 0.5) - _looked_up(_WHOLES, zeros + ones, 1.0) - math.log(math.pi)


_FEW_KT = _log_kt(np.repeat(np.arange(FEW), FEW), np.tile(np.arange(FEW), FEW))


class Levels:
    """The tree below one context of two bytes, from its strings and their counts.

    A level has the distinct (context, byte) pairs, ascending; a node of it is
    the run of pairs with equal context and equal leading bits of the byte.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int) -> None:
        found, at = np.unique(codes, return_inverse=True)
        self.pairs, self.n, self.up, self.at = [found], [np.bincount(at, n.astype(float), len(found))], [], at
        for d in range(depth - 1, 1, -1):
            found, up = np.unique(self.pairs[-1] & np.uint64((1 << (8 * d + 8)) - 1), return_inverse=True)
            self.up.append(up)
            self.n.append(np.bincount(up, self.n[-1], len(found)))
            self.pairs.append(found)

    def nodes(self, k: int):
        """Per level, deepest first, of the nodes after k bits: (first pairs, node of each pair, bit of each pair, zeros, ones, log Pe, log of the children's Pw, log Pw)."""
        out = []
        for i, (pairs, n) in enumerate(zip(self.pairs, self.n)):
            lead = pairs >> np.uint64(8 - k)
            new = np.ones(len(pairs), bool)
            new[1:] = lead[1:] != lead[:-1]
            first, run = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
            bit = (pairs >> np.uint64(7 - k)).astype(np.int64) & 1
            ones = np.add.reduceat(n * bit, first)
            zeros = np.add.reduceat(n, first) - ones
            pe = pw = log_kt(zeros, ones)
            below = None
            if i:
                below = np.bincount(run[self.up[i - 1][out[-1][0]]], out[-1][7], len(first))
                pw = _mix(pe, below)
            out.append((first, run, bit, zeros, ones, pe, below, pw))
        return out


def _mix(pe: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Log of (e^pe + e^below) / 2."""
    # the sum's log is of 1 to 2, so nothing is lost by not using log1p
    return np.maximum(pe, below) + np.log(0.5 + 0.5 * np.exp(-np.abs(pe - below)))


def upper_sums(codes: np.ndarray, n: np.ndarray, depth: int):
    """Of the two-byte context of a group: its nodes, their zeros, ones and log Pw."""
    levels, out = Levels(codes, n, depth), []
    for k in range(8):
        first, _, _, zeros, ones, _, _, pw = levels.nodes(k)[-1]
        lead = ((levels.pairs[-1][first] & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)
        out.append(((1 << k) | lead, zeros, ones, pw))
    return [np.concatenate(c) for c in zip(*out)]


def _share(pe: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against its children's."""
    return 1 / (1 + np.exp(np.clip(below - pe, -700, 700)))


def top_levels(rows: list[tuple]) -> dict:
    """The levels of no and one byte from (byte, node, zeros, ones, sum of log Pw of the children)."""
    n, below = np.zeros((256, 256, 2)), np.zeros((256, 256))
    for byte, node, zeros, ones, inner in rows:
        n[byte, node] = zeros, ones
        below[byte, node] = inner
    pe1 = log_kt(n[:, :, 0], n[:, :, 1])
    root = n.sum(0)
    pe0, below0 = log_kt(root[:, 0], root[:, 1]), _mix(pe1, below).sum(0)
    kt = lambda c: (c + 0.5) / (c.sum(-1, keepdims=True) + 1)
    return {"share1": _share(pe1, below), "kt1": kt(n), "share0": _share(pe0, below0), "kt0": kt(root)}


def string_logs(codes: np.ndarray, n: np.ndarray, top: dict, depth: int) -> np.ndarray:
    """log2 of the mixture's probability of the last byte of each string after the bytes before it."""
    levels = Levels(codes, n, depth)
    deep = levels.pairs[0]
    last, byte = (deep & np.uint64(255)).astype(np.int64), int(deep[0] >> np.uint64(8)) & 255
    total = np.zeros(len(deep))
    for k in range(8):
        at = None
        for i, (_, run, bit, zeros, ones, pe, below, _) in enumerate(levels.nodes(k)):
            own = (np.where(bit, ones[run], zeros[run]) + 0.5) / ((zeros + ones)[run] + 1)
            if not i:
                p = own
                continue
            at = levels.up[0] if at is None else levels.up[i - 1][at]
            share = _share(pe, below)[run][at]
            p = share * own[at] + (1 - share) * p
        node, bits = (1 << k) | (last >> (8 - k)), (last >> (7 - k)) & 1
        for share, own in ((top["share1"][byte][node], top["kt1"][byte][node, bits]), (top["share0"][node], top["kt0"][node, bits])):
            p = share * own + (1 - share) * p
        total += np.log2(p)
    return total[levels.at]


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings and counts of a group's rows one after another, and where each row's start (rows + 1)."""
    sizes = table.column("__n").to_numpy()
    strings, n = zip(*(unpack_strings(key.as_buffer(), size) for key, size in zip(table.column("__key"), sizes.tolist())))
    return suffix_codes(np.concatenate(strings)), np.concatenate(n), np.concatenate(([0], np.cumsum(sizes)))


def string_model(strings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows like the ``strings`` (written ``STRINGS`` rows) with the packed code lengths of the strings."""

    def sums(table: pa.Table) -> pa.Table:
        codes, n, _ = _group(table)
        codes, n = codes[n > 0], n[n > 0]  # strings of held-out texts alone tell nothing
        if not len(n):
            return pa.table({c: pa.array([], t) for c, t in (("byte", pa.int32()), ("node", pa.int32()), ("zeros", pa.float64()), ("ones", pa.float64()), ("logs", pa.float64()))})
        node, zeros, ones, logs = upper_sums(codes, n, depth)
        some = zeros + ones > 0
        byte = np.full(int(some.sum()), int(codes[0] >> np.uint64(8)) & 255, np.int32)
        return pa.table({"byte": byte, "node": node[some].astype(np.int32), "zeros": zeros[some], "ones": ones[some], "logs": logs[some]})

    grouped = strings.select("__block", "__at", "__n", "__key").groupBy("__at")
    upper = grouped.applyInArrow(sums, "byte int, node int, zeros double, ones double, logs double")
    upper = written(upper.groupBy("byte", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("logs")), "lm-upper")
    rows = upper.collect()  # at most 256 x 255 rows
    top = strings.sparkSession.sparkContext.broadcast(top_levels([tuple(r) for r in rows]))

    def logs(table: pa.Table) -> pa.Table:
        codes, n, at = _group(table)
        bits = -string_logs(codes, n, top.value, depth)
        keys = [pack_bits(bits[i:j]) for i, j in zip(at, at[1:])]
        return pa.Table.from_batches([_rows(STRINGS, table.column("__block").to_numpy(), table.column("__at").to_numpy(), table.column("__n").to_numpy(), keys)])

    return grouped.applyInArrow(logs, BLOCKS)


# ---- pass two -----------------------------------------------------------------------


def _code_lengths(texts: pa.Array, bits: np.ndarray, depth: int) -> np.ndarray:
    """Sum of each text's code lengths; ``bits`` are those of the distinct strings of all texts, ascending."""
    out, upto = np.zeros(len(texts)), 0
    for bounds, strings in strings_of(texts, depth):
        found, at = np.unique(strings, return_inverse=True)
        out += _sums(bits[upto : upto + len(found)][at], bounds)
        upto += len(found)
    if upto != len(bits):
        raise ValueError("the block's strings and their code lengths do not agree")
    return out


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, depth: int = DEPTH) -> DataFrame:
    """For contexts of 0 to ``depth`` (2 to 7) bytes: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    if not 2 <= depth <= 7:
        raise ValueError("a context has 2 to 7 bytes at most: a string of it and one more byte is a long")
    rows = blocks(docs, block_bytes, depth)
    found = rows.filter(F.col("__kind") == WORD).select("__block", "__at", "__key", "__n")
    totals = written(found.groupBy("__key").agg(F.sum("__n").alias("value")), "lm-totals")
    # a common word has a row in every block; the join can be split, a window per word could not
    sums = written(found.select("__block", "__at", "__key").join(totals, "__key").select("__block", "__at", F.col("value").alias("__n")), "lm-words")
    forget(rows, f"__kind={WORD}")
    said = totals.agg(F.sum("value"), F.count_if(F.col("value") > 0)).first()
    forget(totals)
    model = string_model(rows.filter(F.col("__kind") == STRINGS), depth)
    texts = rows.filter(F.col("__kind") == TEXT).select(*ROWS)
    ends = texts.agg(F.sum("__n")).first()[0] or 0
    total, kinds = (said[0] or 0) + ends, (said[1] or 0) + (ends > 0)
    below = total + kinds + 1

    def score(block: pa.Table) -> pa.Table:
        parts = [block.filter(pc.equal(block.column("__kind"), k)).sort_by("__at") for k in (TEXT, WORD, STRINGS)]
        (batch,), of_words, own = ([unpack(r["__key"], r["__n"]) for r in part.to_pylist()] for part, unpack in zip(parts, unpackers))
        low = _lowered(batch.column("text"))
        dictionary, codes, at = words.numbered(low, lower=False)
        counts = np.zeros(len(dictionary))
        for step, n in of_words:
            counts[np.cumsum(step)] = n
        n_words = np.diff(at)
        base = _sums((np.log10(counts + 1) - math.log10(below))[codes], at) + math.log10((ends + 1) / below)
        known = _sums((counts > 0)[codes].astype(float), at) + (ends > 0)
        del dictionary, codes, counts, of_words, parts, block
        bits = _code_lengths(low, np.concatenate(own), depth) if own else np.zeros(len(low))
        size = pc.binary_length(low).to_numpy(zero_copy_only=False)
        out = {
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": n_words + 1, "n_known": known.astype(np.int64), "train_tokens": np.full(len(size), total),
            "base_score": base, "score": -bits * math.log10(2), "bits_per_byte": bits / np.maximum(size, 1),
        }
        words.trim()
        return pa.table(out)

    unpackers = (lambda x, _: unpack_texts(pa.py_buffer(x)), lambda x, n: unpacked(x, n, np.int32, np.int64), unpack_bits)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return texts.unionByName(packed_sums(sums)).unionByName(model).groupBy("__block").applyInArrow(score, schema)
