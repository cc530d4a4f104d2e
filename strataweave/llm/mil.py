"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Each passage is encoded from its
own characters and words (pairs of byte classes, repeated and distinct words,
word lengths), a learned layer embeds it, gated attention weighs the passages
of a document, and a logistic unit scores the weighted sum.  Only the label of
the whole document is learned from; the weights of passages come out of it.

The model is fitted on the driver from a bounded sample of labelled documents
(``SAMPLE`` ids, the smallest by a hash of the id, of which the first
``SAMPLE_BYTES`` of whole texts), whose passage features are computed by the
executors.  Its size is fixed.  Scoring is one Arrow pass over whole texts; a
chunk of texts, or a part of a long one, is held at a time.

Defined cases: null and empty texts are one empty passage and get its score;
documents without a label are scored too; several labels of a document count by
their largest; labels without a document or a quality are not used; with fewer
than two classes among the labels every score is the base rate of label 1 (1.0
without any label); repeated rows get equal scores; an id of several texts is
learned from by the greatest of them; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm import words

PASSAGE = 64
SAMPLE = 3000
SAMPLE_BYTES = 24 << 20
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.004, 1e-4, 7
THRESHOLD = 0.3
CHUNK_BYTES = 1 << 20

# Bytes by class; class 0 is any other byte.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".,", b";:?'\"-", b"!", b"|", b"$%&*#@^~+=", b"()[]{}<>/\\_`", bytes(range(128, 256)))
N_CLASSES = len(CLASSES) + 1
LUT = np.zeros(256, np.uint8)
for _i, _c in enumerate(CLASSES):
    LUT[list(_c)] = _i + 1
N_FEATURES = N_CLASSES * N_CLASSES + 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(raw: np.ndarray, start: np.ndarray, first_of_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Passage of each byte, and how many passages each text has; a passage ends where word ``size`` starts."""
    n_words = np.add.reduceat(start, first_of_text, dtype=np.int32) if len(raw) else np.empty(0, np.int32)
    counts = np.maximum(1, -(-n_words // size))
    word = np.flatnonzero(start).astype(np.int32)
    within = np.arange(len(word), dtype=np.int32) - np.repeat(np.cumsum(n_words, dtype=np.int32) - n_words, n_words)
    opens = np.zeros(len(raw), bool)
    opens[word[(within % size == 0) & (within > 0)]] = True
    opens[first_of_text] = True
    return np.cumsum(opens, dtype=np.int32) - 1, counts


def features(raw: np.ndarray, lengths: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of texts laid end to end, and how many passages each has; small types, as each byte has a cell of each array."""
    full = lengths > 0
    begin = (np.cumsum(lengths) - lengths)[full]
    kind = LUT[raw]
    space = (kind == 4) | (kind == 5)
    start = ~space
    start[1:] &= space[:-1]
    if len(raw):
        start[begin] = ~space[begin]
    own, some = _runs(raw, start, begin, size)
    counts = np.ones(len(lengths), np.int64)
    counts[full] = some
    # empty texts have a passage without bytes
    total = int(counts.sum())
    place = np.arange(total)[np.repeat(full, counts)].astype(np.int32)
    own = place[own] if len(raw) else own
    same = own[1:] == own[:-1]
    pair = own[1:][same] * np.int32(N_CLASSES**2) + (kind[:-1][same].astype(np.int16) * N_CLASSES + kind[1:][same])
    pairs = np.bincount(pair, minlength=total * N_CLASSES**2).reshape(total, -1).astype(np.float32)
    del pair, same
    pairs = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 24))
    at = np.flatnonzero(start)
    word_own = own[at]
    n = np.bincount(word_own, minlength=total).astype(np.float32)
    letters = np.bincount(own[~space], minlength=total)
    codes = _word_codes(raw, space, at, begin)
    again = (codes[1:] == codes[:-1]) & (word_own[1:] == word_own[:-1])
    repeats = np.bincount(word_own[1:][again], minlength=total)
    kinds = int(codes.max()) + 1 if len(codes) else 1
    both = np.unique(word_own.astype(np.int64) * kinds + codes) // kinds
    distinct = np.bincount(both, minlength=total)
    more = np.stack([repeats / np.maximum(n, 8), 1 - distinct / np.maximum(n, 1), np.minimum(letters / np.maximum(n, 1), 40) / 40, n / size], 1)
    return np.concatenate([pairs, more.astype(np.float32)], 1), counts


def _word_codes(raw: np.ndarray, space: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words but for the case of ASCII letters."""
    if not len(at):
        return np.empty(0, np.int64)
    stops = np.append(space[1:], True)
    stops[begin[1:] - 1] = True
    ends = np.flatnonzero(~space & stops) + 1
    offsets = np.empty(2 * len(at), np.int32)
    offsets[0::2], offsets[1::2] = at, ends
    # words and what stands between them, as one binary array; every other value is a word
    flat = pa.Array.from_buffers(pa.binary(), 2 * len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw])])
    return flat.take(pa.array(np.arange(0, 2 * len(at) - 1, 2))).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def passages(texts: pa.Array, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of a chunk of texts, and where each text's passages start (rows + 1).

    A text beyond ``CHUNK_BYTES`` is taken in parts that end where a passage does.
    """
    rows, counts, held = [], [], []

    def take() -> None:
        if held:
            lengths = np.array([len(x) for x in held], np.int64)
            x, n = features(np.frombuffer(b"".join(held), np.uint8), lengths, size)
            rows.append(x)
            counts.extend(n.tolist())
            held.clear()

    for value in texts:
        raw = value.as_buffer() if value.is_valid else b""
        if len(raw) <= CHUNK_BYTES:
            held.append(raw)
            continue
        take()
        n = 0
        for part in _parts(np.frombuffer(raw, np.uint8), size):
            x, k = features(part, np.array([len(part)]), size)
            rows.append(x)
            n += int(k[0])
        counts.append(n)
    take()
    return np.concatenate(rows) if rows else np.empty((0, N_FEATURES), np.float32), np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def _parts(raw: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of a long text of about ``CHUNK_BYTES``, each but the last of whole passages."""
    begin, reach = 0, CHUNK_BYTES
    while begin < len(raw):
        end = min(len(raw), begin + reach)
        if end < len(raw):
            kind = LUT[raw[begin:end]]
            space = (kind == 4) | (kind == 5)
            start = ~space
            start[1:] &= space[:-1]
            at = np.flatnonzero(start)
            whole = (len(at) - 1) // size * size
            if whole <= 0:  # a passage longer than this part
                reach *= 2
                continue
            end = begin + int(at[whole])
        yield raw[begin:end]
        begin, reach = end, CHUNK_BYTES


class Model:
    """Weights of the encoder, the gate and the scorer; None: a constant score."""

    def __init__(self, base: float, mean=None, scale=None, weights=None) -> None:
        self.base, self.mean, self.scale, self.weights = base, mean, scale, weights

    def scores(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each document, and the attention of each passage."""
        if self.weights is None:
            return np.full(len(first) - 1, self.base), np.repeat(1 / np.diff(first), np.diff(first))
        logit, cache = _forward(self.weights, (x - self.mean) / self.scale, first)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50))), cache[4]


def _forward(w: dict, x: np.ndarray, first: np.ndarray):
    seg = first[:-1]
    size = np.diff(first)
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    a = (t * s) @ w["g"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, seg), size))
    a = a / np.repeat(np.add.reduceat(a, seg), size)
    z = np.add.reduceat(a[:, None] * h, seg)
    return z @ w["c"] + w["b"], (x, h, t, s, a, z, seg, size)


def _backward(w: dict, cache, d: np.ndarray) -> dict:
    """Gradients from the gradient of the logits."""
    x, h, t, s, a, z, seg, size = cache
    dz = np.repeat(d[:, None] * w["c"], size, 0)
    da = (dz * h).sum(1)
    da = a * (da - np.repeat(np.add.reduceat(a * da, seg), size))
    dgate = da[:, None] * w["g"]
    dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    return {"c": z.T @ d, "b": d.sum(), "g": (t * s).T @ da, "V": h.T @ dt, "U": h.T @ ds, "E": x.T @ dh, "e": dh.sum(0)}


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on the logistic loss; the order of the bags decides nothing but rounding."""
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(float(labels.mean()) if len(labels) else 1.0)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    draw = np.random.Generator(np.random.PCG64(SEED))
    f, init = every.shape[1], lambda *s: draw.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"E": init(f, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "g": init(GATE), "c": init(HIDDEN), "b": np.zeros(())}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            first = np.concatenate(([0], np.cumsum([len(bags[j]) for j in some])))
            logit, cache = _forward(w, (np.concatenate([bags[j] for j in some]) - mean) / scale, first)
            p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            grads = _backward(w, cache, (p - labels[some]) / len(some))
            step += 1
            for k in w:
                g = grads[k] + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(float(labels.mean()), mean, scale, w)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled documents outside the held-out fold: at most ``sample`` and ``sample_bytes`` of whole text."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in words.chunks(batch.column(2), CHUNK_BYTES):
                x, first = passages(texts)
                rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array(rows, pa.binary())], ["doc_id", "quality", "bag"])

    # an id stands for one text; a window over ``sample`` rows of sizes then fits them to the bytes
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max(F.col("quality").cast("int")).alias("quality"))
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = one.select("doc_id", F.octet_length("text").alias("size")).withColumn("upto", F.sum("size").over(upto))
    picked = one.join(sizes.filter(F.col("upto") <= sample_bytes).select("doc_id"), "doc_id").select("doc_id", "quality", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = picked.mapInArrow(bags_of, f"doc_id {kind}, quality int, bag binary").collect()  # bounded by ``sample_bytes``
    rows = sorted(rows, key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit(bags, np.array([r["quality"] for r in rows], float))


def quality_score(text: Column, model: Model) -> Column:
    """Score of each whole text, 0 to 1."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = [model.scores(*passages(texts))[0] for _, texts in words.chunks(column, CHUNK_BYTES)]
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
        words.trim()

    return F.arrow_udf(score, T.DoubleType())(F.coalesce(text, F.lit("")))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``."""
    return docs.filter(quality_score(F.col("text"), train(docs, labels)) >= threshold)
