"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its hashed features: words, pairs of
neighbouring words, and byte 4-grams; softmax of a linear layer gives the class. A pair of
equal words is hashed as one feature, whatever the word, so repetition is a feature too. Both
layers are trained by stochastic gradient descent in numpy on a bounded, labelled sample
(``sample`` rows, taken in the order of a hash of their id).

At scoring time a feature's vector matters only through the difference of the two outputs, so
one number for each bucket is kept, and a document's logit is the average of its features'
numbers: whole texts, one vectorised pass, constant memory.

Edge cases: null and empty texts score the bias alone. Labels that are null are not learned
from. Without any labelled row (or with one class) every score is the share of label 1, or
0.5. Rows with a null id are scored and count as held out. Repeated rows each get the same score; an id
that is labelled twice counts as its largest label. A very long text is averaged whole. Empty
tables give no rows. Ties at the cut are predicted 1. Only the id and text columns are read
besides the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm import words as W
from sluiceway.llm.shared import fold, slices

BITS = 15
_U = np.uint64


class Model(NamedTuple):
    weight: np.ndarray
    bias: float


def _doc_sums(first: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of value[first[d]:stop[d]], each added up in the same order whatever surrounds it."""
    edges = np.stack([first, stop], axis=1).ravel()
    sums = np.add.reduceat(np.append(value.astype(np.float64), 0.0), edges)[::2] if len(edges) else np.zeros(0)
    return np.where(stop > first, sums, 0.0)


def features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Bucket arrays (words, pairs, 4-grams) and, for each, where every document begins and
    stops: nothing spans two documents."""
    words = W.split(texts)
    h = W.hashes(words)
    shift = _U(64 - BITS)
    one = (W.mix64(h) >> shift).astype(np.int32)
    n = np.diff(words.first)
    doc = np.repeat(np.arange(len(n)), n)
    inside = doc[1:] == doc[:-1]
    two = np.where(h[1:] == h[:-1], _U(12345), W.pair(h[:-1], h[1:], 7))[inside]
    two = (W.mix64(two) >> shift).astype(np.int32)
    pairs = np.searchsorted(doc[1:][inside], np.arange(len(n) + 1))
    buf, offs = W.buffer_of(texts)
    code = np.zeros(0, np.int32)
    if len(buf) > 3:
        b = buf.astype(np.uint32)
        x = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        x = (x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        code = ((x ^ x >> np.uint32(12)) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)).astype(np.int32)
    begin = np.minimum(offs[:-1], len(code))
    return [one, two, code], [words.first[:-1], pairs[:-1], begin], [words.first[1:], pairs[1:], np.maximum(begin, offs[1:] - 3)]


def _sample(docs: DataFrame, labels: DataFrame, label: str, size: int, parts: int, part: int, id_col: str, text_col: str) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(f"y is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % {parts} <> {part}")
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return own.join(F.broadcast(chosen), "doc_id")  # at most ``size`` rows


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = 5000, dim: int = 12, epochs: int = 8, rate: float = 0.5, held_parts: int = 5, held_part: int = 0, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Model:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buckets, firsts, stops = features(batch["text"])
            ids, counts = [], []
            for d in range(batch.num_rows):
                own = np.concatenate([b[f[d] : e[d]] for b, f, e in zip(buckets, firsts, stops, strict=True)])
                at, n = np.unique(own, return_counts=True)
                ids.append(at.astype(np.int32).tobytes())
                counts.append(n.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "y", "ids", "counts"])

    got = _sample(docs, labels, label, sample, held_parts, held_part, id_col, text_col).mapInArrow(rows, "doc_id long, y int, ids binary, counts binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["ids"]))
    y = np.array([r["y"] for r in got], np.int64)
    if not len(y) or y.min() == y.max():
        share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    x = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in got]
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BITS, dim), np.float32) - 0.5) / dim
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, total = 0, epochs * len(x)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            ids, n = x[i]
            lr = rate * (1 - steps / total)
            steps += 1
            if not len(ids):
                continue
            share = n / n.sum()
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            # a feature's share is small where a text is long, so its vector takes steps scaled by the number of features
            back = np.sqrt(len(ids)) * share[:, None] * (p @ out)
            out -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            vectors[ids] -= lr * 10 * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def quality_scores(docs: DataFrame, model: Model, *, cut: float = 0.3, held_parts: int = 5, held_part: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buckets, firsts, stops = features(batch["text"])
            weight, bias = sent.value
            total = sum(_doc_sums(f, e, weight[b]) for b, f, e in zip(buckets, firsts, stops, strict=True))
            n = np.maximum(sum(e - f for f, e in zip(firsts, stops, strict=True)), 1)
            score = 1 / (1 + np.exp(-np.clip(total / n + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col(id_col), held_parts) == held_part, F.lit(True))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
