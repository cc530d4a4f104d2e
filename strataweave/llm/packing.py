"""Bulk-synchronous best-fit packing of token sequences.

Documents are tokenized and only those longer than a sequence are cut.  Pieces
are then ranked: by length, and among equal lengths by where they were written.
Pieces of one length are interchangeable until their rank picks one, so the
rounds work on classes: so many pieces of a length, so many sequences with the
same gap.  There are at most ``capacity`` lengths and as many gaps, whatever the
size of the corpus.

A round sorts the waiting lengths and the gaps, finds for each length its
successor, the smallest gap that holds it, resolves conflicts over a gap by rank
(longer first), places the winners, updates the gaps, and repeats until no
waiting piece fits.  Then the band of longest waiting pieces opens sequences.
Bands follow capacity/2, capacity/3, ... as in best-fit decreasing.

Distributed: tokenizing, the counts per (task, length) and their running sums,
which give every piece its rank without sorting a class in one task (one length
may hold a third of all pieces), and placing the pieces by rank.  The loop over
classes runs on the driver on that bounded table.

Defined cases: null and empty texts are one end token; very long texts are cut
into whole pieces; repeated rows are packed each; an empty table gives no row;
other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm import words
from strataweave.session import written

CAPACITY = 2048
END = 0
#: Bands of best-fit decreasing that are told apart; shorter pieces are one band.
BANDS = 12
#: Words whose ids a Python worker remembers, in two generations of so many.
REMEMBERED = 200_000
#: Text bytes that are tokenized at once; the arrays of a chunk take about ten times as much.
CHUNK_BYTES = 4 << 20
#: Runs of equal pieces that are broadcast, 24 bytes each.
MOST_RUNS = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_TOKENIZERS: dict[str, tuple] = {}
PUNCTUATION = ".,!?;:"
#: Letters below U+0250 but U+0130.
LATIN = r"\A[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+\z"


class Remembered:
    """Words and their ids as little-endian 32-bit numbers, in two Arrow columns: some 30 bytes a word, a tenth of what a dict takes."""

    def __init__(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def __len__(self) -> int:
        return len(self.words)

    def add(self, found: pa.Array, ids: pa.Array) -> None:
        self.words, self.ids = pa.concat_arrays([self.words, found]), pa.concat_arrays([self.ids, ids])

    def places(self, found: pa.Array) -> np.ndarray:
        """Where each word is, or -1."""
        if not len(self):
            return np.full(len(found), -1)
        return pc.fill_null(pc.index_in(found, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def moved_to(self, other: Remembered) -> None:
        other.words, other.ids = self.words, self.ids
        self.__init__()


def _tokenizer(path: str):
    """The tokenizer, the known words, those of the generation before, the model, and whether texts are cut at words."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _TOKENIZERS[path] = (tokenizer, Remembered(), Remembered(), tokenizer.model, cuts_at_words(path))
    return _TOKENIZERS[path]


# What a tokenizer file says whose texts may be cut at white space and lower-cased word by word.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "suffix": "</w>",
}


def _byte_letters() -> dict[int, str]:
    """What ByteLevel writes for the bytes of a character other than ASCII: printable bytes stand for themselves, the others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(own)))}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 0x2C80)}  # lower case of U+023A is U+2C65


BYTE_LETTERS = _byte_letters()


def cuts_at_words(path: str) -> bool:
    """Whether the file is of the kind that ``word_ids`` knows; texts of others are encoded whole."""
    said = json.loads(Path(path).read_text(encoding="utf-8"))
    added = all(not a["content"].strip("<|>").isspace() and " " not in a["content"] and not a["content"].isalpha() for a in said.get("added_tokens") or [])
    return added and {"normalizer": said.get("normalizer"), "pre_tokenizer": said.get("pre_tokenizer"), "suffix": said["model"].get("end_of_word_suffix")} == BY_WORDS


def _as_arrow(ids: list[int], counts: list[int]) -> pa.Array:
    """One value for each count of ids."""
    upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(np.array(ids, "<u4"))])


def _learn_cores(path: str, cores: list[str]) -> None:
    """Words of letters are one pre-token each, which the model gets as the letters that stand for its bytes."""
    _, known, _, model, _ = _tokenizer(path)
    ids, counts = [], []
    for w in cores:
        found = model.tokenize(w if w.isascii() else w.translate(BYTE_LETTERS))
        ids += [t.id for t in found]
        counts.append(len(found))
    known.add(pa.array(cores, pa.string()), _as_arrow(ids, counts))


def _learn(path: str, some: list[str]) -> None:
    tokenizer, known, *_ = _tokenizer(path)
    ids, counts = [], []
    for i in range(0, len(some), 1000):  # what the tokenizer says of a word takes far more than its ids
        for e in tokenizer.encode_batch(some[i : i + 1000], add_special_tokens=False):
            ids += e.ids
            counts.append(len(e))
    known.add(pa.array(some, pa.string()), _as_arrow(ids, counts))


def _ids_of(path: str, found: pa.Array, cores: np.ndarray) -> pa.Array:
    """The ids of distinct words; ``cores`` marks those of letters in lower case."""
    _, known, before, *_ = _tokenizer(path)
    if len(known) > REMEMBERED:
        known.moved_to(before)
    at = known.places(found)
    new = np.flatnonzero(at < 0)
    some = found.take(pa.array(new))
    was = before.places(some)
    again = pa.array(np.flatnonzero(was >= 0))
    old, new = new[was >= 0], new[was < 0]
    at[old] = len(known) + np.arange(len(old))
    known.add(some.take(again), before.ids.take(pa.array(was[was >= 0])))
    for own, learn in ((new[~cores[new]], _learn), (new[cores[new]], _learn_cores)):
        if len(own):
            at[own] = len(known) + np.arange(len(own))
            learn(path, found.take(pa.array(own)).to_pylist())
    return known.ids.take(pa.array(at))


def word_ids(path: str, found: pa.Array) -> pa.Array:
    """The ids of each distinct word as little-endian 32-bit numbers.

    White space always ends a token of this kind of tokenizer, so texts may be
    cut at it and each distinct word encoded once.  Its pre-tokenizer also cuts
    runs of letters from runs of marks, and lower-cases; Latin letters up to
    U+024F but U+0130 lower-case alike everywhere and are composed already, so
    such words are encoded as letters and marks.

    Only letters in lower case and marks are remembered, not their compounds.
    Those that were used since the last generation ended are kept with the new
    ones, so what comes once is forgotten and what comes often never is.
    """
    n = len(found)
    core = pc.ascii_rtrim(found, characters=PUNCTUATION)
    simple = pc.match_substring_regex(core, LATIN)
    marks = np.where(simple.to_numpy(zero_copy_only=False), (pc.subtract(pc.binary_length(found), pc.binary_length(core))).to_numpy(), 0)
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset + 1 : found.offset + n + 1]
    data = np.frombuffer(found.buffers()[2] or b"", np.uint8)[words.ragged((ends - marks).astype(np.int64), marks)]
    upto = np.concatenate(([0], np.cumsum(marks))).astype(np.int32)
    tails = pa.StringArray.from_buffers(n, pa.py_buffer(upto), pa.py_buffer(data))
    both = pa.concat_arrays([pc.if_else(simple, pc.utf8_lower(core), found), tails]).dictionary_encode()
    codes = both.indices
    cores = np.zeros(len(both.dictionary), bool)
    cores[codes.slice(0, n).filter(simple).to_numpy()] = True
    ids = _ids_of(path, both.dictionary, cores)
    return pc.binary_join_element_wise(ids.take(codes.slice(0, n)), ids.take(codes.slice(n)), pa.scalar(b"", pa.large_binary()))


def token_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a chunk of texts, and where each row's ids start (rows + 1)."""
    if not _tokenizer(path)[-1]:
        found = [np.array(e.ids, "<u4") for e in _tokenizer(path)[0].encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([*found, np.empty(0, "<u4")]), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
    values, codes, rows = words.numbered(texts, lower=False)
    if not len(codes):
        return np.empty(0, "<u4"), np.zeros(len(rows), np.int64)
    every = word_ids(path, values).take(pa.array(codes))
    upto = np.frombuffer(every.buffers()[1], np.int64)[every.offset : every.offset + len(every) + 1] // 4
    return np.frombuffer(every.buffers()[2] or b"", "<u4"), upto[rows]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The written pieces: key, piece, start, length, ids_crc32, and __part and __at, the place among the task's pieces of that length."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in words.chunks(batch.column(1), CHUNK_BYTES):
                ids, rows = token_ids(tokenizer_path, texts)
                out = []
                for i in range(len(texts)):
                    data = ids[rows[i] : rows[i + 1]].tobytes() + end
                    for n, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        length = len(own) // 4
                        out.append((keys[first + i], n, at // 4, length, zlib.crc32(own), part, seen[length]))
                        seen[length] += 1
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], ["key", "piece", "start", "length", "crc", "part", "at"])
            words.trim()

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, __part long, __at long"
    conf = docs.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, str(CHUNK_BYTES))  # a batch is held by the executor and the worker while its chunks are tokenized
    try:
        return written(docs.select(key, text).mapInArrow(cut, schema), "pieces")
    finally:
        conf.set(_BATCH, before)


# ---- the rounds over classes --------------------------------------------------


class Gaps:
    """Open sequences by gap: runs (first sequence, how many) whose contents have the same lengths."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[list[int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in self.runs:
            bisect.insort(self.sizes, gap)
            self.runs[gap] = []
        runs = self.runs[gap]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1][1] += n
        else:
            runs.append([first, n])

    def successor(self, length: int) -> int | None:
        i = bisect.bisect_left(self.sizes, length)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, gap: int, n: int) -> list[tuple[int, int]]:
        """Up to n sequences of this gap, as runs; they are no longer open."""
        got, runs = [], self.runs[gap]
        while n and runs:
            first, have = runs[0]
            m = min(n, have)
            got.append((first, m))
            n -= m
            if m == have:
                runs.pop(0)
            else:
                runs[0] = [first + m, have - m]
        if not runs:
            del self.runs[gap]
            self.sizes.remove(gap)
        return got


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, first rank, how many, first sequence, offset), and the number of sequences."""
    waiting = {length: n for length, n in counts.items() if n > 0}
    rank: dict[int, int] = defaultdict(int)
    gaps, placed, sequences = Gaps(), [], 0

    def put(length: int, runs: list[tuple[int, int]], gap: int) -> None:
        for first, n in runs:
            placed.append((length, rank[length], n, first, capacity - gap))
            rank[length] += n
            waiting[length] -= n
            gaps.add(gap - length, first, n)
        if not waiting[length]:
            del waiting[length]

    while waiting:
        longest = max(waiting)
        k = min(capacity // longest, BANDS)
        low = capacity // (k + 1) if k < BANDS else 0
        band = sorted((x for x in waiting if x > low), reverse=True)
        while True:  # sweeps, until no piece of the band fits a gap
            wanted: dict[int, list[int]] = {}
            for length in band:
                if length in waiting and (gap := gaps.successor(length)) is not None:
                    wanted.setdefault(gap, []).append(length)
            if not wanted:
                break
            for gap, lengths in wanted.items():
                for length in lengths:  # longer first; the others wait for the next sweep
                    if gap in gaps.runs:
                        put(length, gaps.take(gap, waiting[length]), gap)
        band = [x for x in band if x in waiting]
        if band:
            n = sum(waiting[x] for x in band)
            open_now = -(-n // k) if k < BANDS else max(1, -(-sum(x * waiting[x] for x in band) // capacity))
            for length in band:
                m = min(open_now, waiting[length])
                put(length, [(sequences, m)], capacity)
                sequences += m
                open_now -= m
                if not open_now:
                    break
    return placed, sequences


# ---- placing --------------------------------------------------------------------


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a table from ``pieces``) with sequence_id and offset."""
    counts = cut.groupBy("__part", "length").agg(F.count("*").alias("__n"))
    counts = written(counts, "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most ``capacity`` rows
    placed, _ = best_fit(totals, capacity)
    by: dict[int, list] = defaultdict(list)
    for length, first, n, sequence, offset in placed:
        by[length].append((first, sequence, offset))
    runs = {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in by.items()}
    upto = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(upto), F.lit(0)).cast("long")).drop("__n")
    ranked = cut.join(starts, ["__part", "length"]).withColumn("__rank", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")
    # lengths by gaps decide how many runs there are, not the corpus
    if len(placed) > MOST_RUNS:
        raise ValueError(f"{len(placed)} runs of pieces are more than the {MOST_RUNS} that may be broadcast")
    share = cut.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            at = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(at, [*at[1:], len(order)]):
                own = order[a:b]
                first, sequences, offsets = share.value[int(length[own[0]])]
                i = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = sequences[i] + rank[own] - first[i], offsets[i]
            kept = batch.drop_columns(["__rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])
        words.trim()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **columns) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return pack_pieces(pieces(docs, tokenizer_path, capacity, **columns), capacity)
