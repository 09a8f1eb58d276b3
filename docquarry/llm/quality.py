"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Tokens are maximal runs of word bytes or of other visible ASCII. Features are hashed unigrams and bigrams of
lower-cased tokens, and of their shapes (all capitals, same as the one before, digits, symbols). A document
is a sparse vector of feature shares, and its score is one sparse dot product through a sigmoid.

Training reads a bounded, hash-chosen sample of labelled rows (about MAX_ROWS). SHARDS tasks each run
follow-the-regularised-leader updates over their share of the sample, in an order fixed by the id's hash, and
their weights are averaged. The model has 2 ** BITS weights (1 MB), which bounds what is broadcast.

Rows: null and empty texts have no features and get the score of the bias alone; repeated rows repeat; only
rows with an id and a label train; without labels every score is 0.5. Other columns are neither read nor
returned by ``score``; ``keep_good`` returns the columns of its input as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .hashing import U, chain, hash_spans, mix, runs

BITS = 18
#: The sample that trains: about so many labelled rows, chosen by hash.
MAX_ROWS = 10_000
SHARDS, EPOCHS = 6, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2e-4, 1e-4
#: Shares are small numbers; features are shares times this.
SCALE = 16.0
#: Added to a text's number of features before it divides them: a few words say little either way.
CALM = 24
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
SAME, CAPITALS, DIGITS, SYMBOLS, SHORT, PLAIN = (U(x) for x in range(11, 17))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts one after the other, and how many each has."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    ends_of = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)  # with the separator
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    kind = _KIND[data]
    s1, e1 = runs(kind == 1)
    s2, e2 = runs(kind == 2)
    order = np.argsort(np.concatenate([s1, s2]), kind="stable")
    starts, ends = np.concatenate([s1, s2])[order], np.concatenate([e1, e2])[order]
    symbol = (np.arange(len(order)) >= len(s1))[order]
    if not len(starts):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    words = hash_spans(_LOWER[data], starts, ends)
    doc = np.searchsorted(ends_of, starts, side="right")
    sizes = ends - starts
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    shape = np.full(len(words), PLAIN, U)
    shape[sizes <= 2] = SHORT
    shape[(upper[ends] - upper[starts] == sizes) & (sizes > 1)] = CAPITALS
    shape[digit[ends] > digit[starts]] = DIGITS
    shape[symbol] = SYMBOLS
    joined = doc[1:] == doc[:-1]
    shape[1:][(words[1:] == words[:-1]) & joined] = SAME
    both = np.concatenate([words, mix(shape + U(1 << 40)), chain(words, 2)[joined], mix(chain(shape, 2)[joined] + U(1))])
    owner = np.concatenate([doc, doc, doc[1:][joined], doc[1:][joined]])
    order = np.argsort(owner, kind="stable")
    return (both[order] >> U(64 - BITS)).astype(np.int64), np.bincount(owner, minlength=len(texts))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last is the bias) after EPOCHS passes of per-coordinate FTRL-proximal updates."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        for at, x, label in examples:
            zi, ni = z[at], n[at]
            shrunk = np.sign(zi) * L1 - zi
            w = np.where(np.abs(zi) > L1, shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            g = (_sigmoid(w @ x) - label) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def _example(hashed: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, int]:
    at, counts = np.unique(hashed, return_counts=True)
    x = counts * (SCALE / (CALM + len(hashed)))
    return np.append(at, 1 << BITS), np.append(x, 1.0), label


def train(docs: DataFrame, labels: DataFrame, holds_out=None, label: str = "quality", text: str = "text", doc_id: str = "doc_id", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights learnt from labelled rows; those where the column ``holds_out`` of the id is true are left out.

    Two reads: the labels are counted, then about max_rows of them, chosen by the id's hash, find their texts.
    """
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("__id"), (F.col(label) > 0).cast("int").alias("__label")).distinct()
    if holds_out is not None:
        usable = usable.where(~holds_out(F.col("__id")))
    n = usable.count()
    share = min(1.0, max_rows / max(1, n))
    chosen = usable.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias(common.TEXT)).where(F.col(common.TEXT).isNotNull()).join(F.broadcast(chosen), "__id")
    # the shard is part of a row, so the model is the same for any number of partitions
    shard = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("__shard")
    dealt = rows.select(common.TEXT, "__label", shard, "__id").repartition("__shard").sortWithinPartitions("__shard", F.xxhash64("__id"), "__id", "__label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in batches:
            hashed, counts = features([t or b"" for t in common.byte_list(batch.column(0))])
            parts = np.split(hashed, np.cumsum(counts)[:-1])
            for p, y, k in zip(parts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shards.setdefault(k, []).append(_example(p, y))
        for examples in shards.values():
            yield pa.RecordBatch.from_pydict({"n": [len(examples)], "weights": [ftrl(examples).astype("<f8").tobytes()]})

    found = common.map_slices(dealt.select(common.TEXT, "__label", "__shard"), common.TEXT, learn, "n long, weights binary").collect()
    if not found:
        return np.zeros((1 << BITS) + 1)
    return np.average([np.frombuffer(bytes(r.weights), "<f8") for r in found], axis=0, weights=[r.n for r in found])


def with_score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each text as its last column."""
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            hashed, counts = features([t or b"" for t in common.byte_list(batch.column(at))])
            # each text's own sum, so that equal texts have equal scores whatever their neighbours
            sums = np.zeros(len(counts))
            some = counts > 0
            if some.any():
                sums[some] = np.add.reduceat(w[hashed].astype(np.float64), (np.cumsum(counts) - counts)[some])
            dots = sums * (SCALE / (CALM + counts)) + float(w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(dots))], [*batch.schema.names, name])

    return common.map_slices(docs, text, run, T.StructType([*docs.schema]).add(name, T.DoubleType()))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; ids whose crc32 is a multiple of 5 don't train."""
    held = lambda c: F.coalesce(common.crc_mod(c, 5) == 0, F.lit(False))
    weights = train(docs, labels, held)
    rows = docs.select("doc_id", F.col("text").alias(common.TEXT))
    scored = with_score(rows, weights, common.TEXT)
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that a model trained on ``labelled`` doesn't reject, with their columns."""
    weights = train(labelled, labels)
    names = docs.columns
    marked = docs.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(names)})
    scored = with_score(marked, weights, f"__{names.index('text')}", "__score")
    return scored.where(F.col("__score") >= threshold).select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names)))
