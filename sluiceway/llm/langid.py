"""Language identification by mixture inference.

Each language is a distribution over hashed byte trigrams, counted over every training
document (text and a known language, outside the held-out fold). A document is taken as a
mixture of these: expectation-maximisation finds the proportions of all languages; then the
set of languages is grown, tried in the order of their proportions, until no further language
raises the likelihood less a penalty of log(n) / 2 for each language added (n: trigrams, counted
as a third since they overlap). The likelihood is concave, so its slope towards a language bounds
what adding it can gain; languages that can't make up for the penalty are not tried. The prediction is the language with the largest proportion in the set;
its proportion is the score.

The model is a table of languages x buckets, whatever the corpus' size: 2^14 buckets for up to 1,024
languages, and half as many for each doubling beyond, so its ``MODEL_BYTES`` are a bound for any
number of languages; it is broadcast. Documents are handled as sparse arrays, as many at a time
as keep languages x features within a bound.

Edge cases: null texts and texts without a letter give ``und`` with score 0; so does every
text when nothing could be learned. Rows with a null id are predicted and count as held out
from training. Ties go to the language that is smaller in UTF-8. Repeated rows count each time in
training and get the same prediction each; a very long text is counted whole. Empty tables learn
nothing and give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructType

from sluiceway.llm.shared import fold, slices
from sluiceway.llm.words import buffer_of

BUCKETS = 1 << 14
#: Of a model's table of 32-bit numbers.
MODEL_BYTES = 64 << 20
#: Numbers in a table of languages x features.
CELLS = 1 << 20
_letter = regex.compile(r"\p{L}").search

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = _CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


class Model(NamedTuple):
    """names, and the logarithm of each bucket's share in each language; a bucket is the high bits of
    one of ``trigram_counts``."""

    names: list[str]
    log_p: np.ndarray

    def of(self, bucket: np.ndarray) -> np.ndarray:
        return self.log_p[:, bucket // (BUCKETS // self.log_p.shape[1])]


def buckets_for(languages: int) -> int:
    """How many buckets keep a model of so many languages within MODEL_BYTES."""
    buckets = BUCKETS
    while buckets > 1 and 4 * buckets * languages > MODEL_BYTES:
        buckets //= 2
    return buckets


def trigram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and count of the byte trigrams with at most one non-letter, in order of
    document and bucket; memory is bounded by the text's bytes."""
    buf, offs = buffer_of(texts)
    c = _CLASS[buf]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = c[:-2].astype(np.uint32) << 16 | c[1:-1].astype(np.uint32) << 8 | c[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    blank = c == 32
    good = (blank[:-2].astype(np.int8) + blank[1:-1] + blank[2:]) < 2
    size = np.diff(offs)
    doc = np.repeat(np.arange(len(size)), size)[:-2]
    good &= np.arange(len(doc)) + 2 < offs[1:][doc]
    key = doc[good] * BUCKETS + bucket[good]
    edges = np.searchsorted(key // BUCKETS, np.arange(0, len(size) + 32, 32))
    found, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b - a < 8 * BUCKETS:  # few: sorting them is cheaper than a table of all buckets
            at, n = np.unique(key[a:b], return_counts=True)
        else:
            table = np.bincount(key[a:b] - 32 * k * BUCKETS)
            at = np.flatnonzero(table)
            n, at = table[at], at + 32 * k * BUCKETS
        found.append(at)
        many.append(n)
    at = np.concatenate(found)
    return at // BUCKETS, at % BUCKETS, np.concatenate(many)


def learn(docs: DataFrame, *, smoothing: float = 0.5, held_parts: int = 4, held_part: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram distributions of each language over all training documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])
            sums.clear()

        for batch in slices(batches):
            doc, bucket, n = trigram_counts(batch["text"])
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for i, lang in enumerate(batch["lang"].to_pylist()):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own[bucket[first[i] : first[i + 1]]] += n[first[i] : first[i + 1]]
            if len(sums) > 512:  # partial sums, so that many languages don't add up in a task
                yield from out()
        yield from out()

    own = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold(F.col(id_col), held_parts).alias("part"))
    train = own.filter(f"part <> {held_part} and lang is not null and text is not null").select("text", "lang")
    size = buckets_for(train.agg(F.count_distinct("lang")).first()[0])
    summed = train.mapInArrow(rows, "lang string, bucket int, n long").groupBy("lang", F.floor(F.col("bucket") / (BUCKETS // size)).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))

    def shares(own: pd.DataFrame) -> pd.DataFrame:
        counts = np.full(size, smoothing)
        counts[own["bucket"].to_numpy()] += own["n"].to_numpy()
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "log_p": [np.log(counts / counts.sum()).astype(np.float32).tobytes()]})

    table = sorted(((r["lang"], r["log_p"]) for r in summed.groupBy("lang").applyInPandas(shares, "lang string, log_p binary").collect()), key=lambda x: x[0].encode())  # MODEL_BYTES at most
    return Model([lang for lang, _ in table], np.array([np.frombuffer(x, np.float32) for _, x in table]).reshape(len(table), size))


def _mix(n: np.ndarray, p: np.ndarray, doc: np.ndarray, first: np.ndarray, among: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages x documents) and log-likelihoods by expectation-maximisation;
    among: which languages each document may use."""
    pi = among / among.sum(0)
    total = np.add.reduceat(n, first)
    for _ in range(rounds):
        share = pi[:, doc] * p
        weight = n / np.maximum(share.sum(0), 1e-30)
        pi = np.add.reduceat(share * weight, first, axis=1) / total
    return pi, np.add.reduceat(n * np.log(np.maximum((pi[:, doc] * p).sum(0), 1e-30)), first)


def infer(model: Model, texts: pa.Array, rounds: int = 12) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """Predicted language, its proportion, and the proportions of the selected set."""
    names, score, parts = ["und"] * len(texts), np.zeros(len(texts)), [{} for _ in range(len(texts))]
    doc, bucket, n = trigram_counts(texts)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    live = []
    for i, t in enumerate(texts.to_pylist()):
        if model.names and t and _letter(t):
            if first[i] < first[i + 1]:
                live.append(i)
            else:
                names[i], score[i] = model.names[0], 1 / len(model.names)
    most = max(1, CELLS // max(1, len(model.names)))
    at = 0
    while at < len(live):
        size = np.cumsum([first[i + 1] - first[i] for i in live[at : at + most]])
        some = live[at : at + max(1, int(np.searchsorted(size, most, side="right")))]
        at += len(some)
        _infer(model, some, [(bucket[first[i] : first[i + 1]], n[first[i] : first[i + 1]]) for i in some], rounds, names, score, parts)
    return names, score, parts


def _infer(model: Model, live: list[int], counts: list[tuple[np.ndarray, np.ndarray]], rounds: int, names: list[str], score: np.ndarray, parts: list[dict[str, float]]) -> None:
    """Fills in the documents ``live``; counts: buckets and counts of each."""
    doc = np.repeat(np.arange(len(live)), [len(x) for x, _ in counts])
    first = np.searchsorted(doc, np.arange(len(live)))
    n = np.concatenate([x for _, x in counts]).astype(np.float32)
    p = np.exp(model.of(np.concatenate([x for x, _ in counts])))
    every = np.ones((len(model.names), len(live)), np.float32)
    pi, _ = _mix(n, p, doc, first, every, rounds)
    order = np.argsort(-pi, axis=0, kind="stable")
    penalty = np.log(np.maximum(np.add.reduceat(n, first) / 3, 2)) / 2
    chosen = np.zeros(every.shape, bool)
    np.put_along_axis(chosen, order[:1], True, axis=0)
    best_pi, fit = _mix(n, p, doc, first, chosen.astype(np.float32), 1)
    best_value, tried, open_ = fit / 3, chosen.copy(), np.arange(len(live))
    while len(open_):
        slope = np.add.reduceat(n * p / np.maximum((best_pi[:, open_][:, doc] * p).sum(0), 1e-30), first, axis=1) - np.add.reduceat(n, first)
        free = ~tried[:, open_] & (slope > 3 * penalty[open_])
        still = free.any(0)
        kept = still[doc]
        open_, free, n, p = open_[still], free[:, still], n[kept], p[:, kept]
        if not len(open_):
            break
        doc = (np.cumsum(still) - 1)[doc[kept]]
        first = np.searchsorted(doc, np.arange(len(open_)))
        own = order[:, open_]
        new = np.take_along_axis(own, np.take_along_axis(free, own, axis=0).argmax(0)[None], axis=0)[0]
        among = chosen[:, open_]
        among[new, np.arange(len(open_))] = True
        pi, fit = _mix(n, p, doc, first, among.astype(np.float32), rounds)
        value = fit / 3 - penalty[open_] * (among.sum(0) - 1)
        better = value > best_value[open_]
        tried[new, open_] = True
        grown = open_[better]
        best_pi[:, grown], best_value[grown] = pi[:, better], value[better]
        chosen[:, grown] = tried[:, grown] = among[:, better]
    top = best_pi.argmax(0)
    for j, i in enumerate(live):
        names[i], score[i] = model.names[top[j]], min(1.0, float(best_pi[top[j], j]))
        parts[i] = {model.names[x]: float(best_pi[x, j]) for x in np.flatnonzero(best_pi[:, j] > 0)}


def language_id(docs: DataFrame, model: Model, *, held_parts: int = 4, held_part: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, proportions (map of the selected languages), and the
    columns of docs named in ``carry``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = {c: "text" if c == text_col else f"_{i}" for i, c in enumerate(carry or [])}  # the text goes once

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, score, parts = infer(sent.value, batch["text"])
            found = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "proportions": pa.array([list(x.items()) for x in parts], pa.map_(pa.string(), pa.float64()))}
            columns = {c: batch[c] for c in batch.schema.names if c in names_out} | found
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    held = F.coalesce(fold(F.col(id_col), held_parts) == held_part, F.lit(True))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for c, k in kept.items() if k != "text"))
    names_out = {"doc_id", "held_out", *kept.values()}
    schema = StructType([f for f in own.schema.fields if f.name in names_out]).add("lang_pred", "string").add("score", "double").add("proportions", MapType(StringType(), DoubleType()))
    out = own.mapInArrow(rows, schema)
    return out.select("doc_id", "held_out", "lang_pred", "score", "proportions", *(F.col(k).alias(c) for c, k in kept.items()))
