"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of ``span`` words (runs of letters and digits, lower-cased
by Unicode's rules before they are hashed).
A first pass over all documents counts in how many passages each hashed term stands and, for a
fixed random matrix R, sums T'TR over all passages (T: term counts); both are sums over rows,
so every task adds up its own and two small aggregations add up the tasks. From these sums alone
follows a randomised singular value decomposition of the corpus' TF-IDF matrix A: with A'A's
product with a random matrix known, the small matrix of products among the random columns gives
A'A's leading eigenvectors and values (Nystroem's form of the randomised decomposition), which
are A's right singular vectors and squared singular values. The ``rank`` leading ones are kept;
``extra`` more columns only steady them.

A second pass projects overlapping passages of every document on these directions and on random
ones, which drop pairs that share a topic alone; pairs that both cosines let through and that
share enough of the rarer terms are aligned: the longest common subsequence of the item with the
surrounding words must cover ``covered`` of the item, or ``partly`` of it if the item's last
words (its answer) stand there in a row. Word order counts, so passages that merely use the same
words are left alone, while changed, added and dropped words are tolerated.

Cosines are low where an item is much shorter than a passage, so two more paths find
candidates by words alone, without a threshold. An item's last words (the whole of a short
item) are looked up among the documents' windows: every whole item and every item with its
answer in a row is found. For the rest, at least ``c`` of an item's n words must be there, so
at least ``k`` of any n - c + k of them; the n - c + k rarest are looked up, and wherever ``k``
stand within a run of n + min(n, span) words, the item is aligned. Whatever covers an item
within such a run is found.

The benchmark is sent to the workers in parts of at most ``part_bytes`` of text, one pass over the
documents for each part (one in all for any common benchmark); documents are
read twice and never shuffled. Edge cases: null and empty texts are clean; null or empty items
match nothing; items of fewer than ``least_words`` words are only matched in whole; an empty
benchmark leaves every document clean. Rows with a null id are judged as any other; rows that
share an id are judged one by one; of items that are covered alike the smallest id counts. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm import words as W
from sluiceway.llm.shared import Scratch, slices

_U = np.uint64
BITS, CHUNK = 13, 256
TERMS = 1 << BITS
#: Random directions beside the latent ones: they tell passages of one topic apart cheaply.
RANDOM = 64
#: Rows of a table that are gathered together: a processor's cache holds them.
STEPS, WORDS = 256, 2048
#: Cosines that are looked at together, and pairs.
COSINES, PAIRS = 1 << 19, 4096
#: Most entries of the table of weights (32 MB); the terms of larger benchmarks are searched for.
WEIGHTS = 1 << 23

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


class Corpus(NamedTuple):
    """idf of each term, the directions weighted by it (terms x rank, then random ones), and the
    singular values of the former."""

    idf: np.ndarray
    directions: np.ndarray
    values: np.ndarray


class Keys(NamedTuple):
    """Sorted hashes, the item of each, and which upper 16 bits occur among them."""

    key: np.ndarray
    item: np.ndarray
    near: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, int]]) -> Keys:
        key = np.concatenate([np.zeros(0, _U), *(k for k, _ in parts)])
        item = np.repeat(np.array([i for _, i in parts], np.int64), [len(k) for k, _ in parts])
        order = np.argsort(key, kind="stable")
        near = np.zeros(1 << 16, bool)
        near[key >> _U(48)] = True
        return Keys(key[order], item[order], near)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that hold a key and its item, a row for each pair."""
        at = np.flatnonzero(self.near[h >> _U(48)])
        low = np.searchsorted(self.key, h[at])
        n = np.searchsorted(self.key, h[at], side="right") - low
        return np.repeat(at, n), self.item[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Complete(NamedTuple):
    """ends: by their number, the last words of items; rare: the rarest words of items, of
    which ``need`` must stand within ``reach`` words."""

    ends: dict[int, Keys]
    rare: Keys
    need: np.ndarray
    reach: np.ndarray

    @staticmethod
    def of(items: list[np.ndarray], corpus: Corpus, *, span: int, covered: float, answer: int, least_words: int) -> Complete:
        ends: dict[int, list[tuple[np.ndarray, int]]] = {}
        rare, need, reach = [], np.ones(len(items), np.int64), np.ones(len(items), np.int64)
        for i, words in enumerate(items):
            n = len(words)
            if not n:
                continue
            tail = words if n < least_words else words[-answer:]
            ends.setdefault(len(tail), []).append((W.windows(tail, len(tail)), i))
            if n < least_words:
                continue
            least = next((c for c in range(n) if c / n >= covered), n)
            need[i], reach[i] = max(1, least // 3), n + min(n, span)
            order = np.argsort(-corpus.idf[term(words)], kind="stable")
            rare.append((np.unique(words[order[: n - least + need[i]]]), i))
        return Complete({k: Keys.of(v) for k, v in ends.items()}, Keys.of(rare), need, reach)

    def candidates(self, h: np.ndarray, first: np.ndarray, items: list[np.ndarray], span: int) -> Iterator[tuple[int, int, int, int]]:
        """Document, item, and begin and end of the words to align it with."""
        for length, keys in self.ends.items():
            place, item = keys.find(W.windows(h, length) if len(h) >= length else h[:0])
            doc = np.searchsorted(first, place, side="right") - 1
            inside = place + length <= first[doc + 1]
            for d, i, end in zip(doc[inside].tolist(), item[inside].tolist(), (place[inside] + length).tolist(), strict=True):
                yield d, i, max(int(first[d]), end - 2 * len(items[i]) - span), end
        place, item = self.rare.find(h)
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        doc = np.searchsorted(first, place, side="right") - 1
        last = np.minimum(np.arange(len(place)) + self.need[item] - 1, len(place) - 1)
        other = place[last]
        full = last - np.arange(len(place)) == self.need[item] - 1
        full &= (item[last] == item) & (doc[last] == doc) & (other - place < self.reach[item])
        doc, item, place, other = doc[full], item[full], place[full], other[full]
        begin, end = np.maximum(first[doc], other + 1 - self.reach[item]), np.minimum(first[doc + 1], place + self.reach[item])
        yield from zip(doc.tolist(), item.tolist(), begin.tolist(), end.tolist(), strict=True)


class Items(NamedTuple):
    ids: list[int]
    words: list[np.ndarray]
    owner: np.ndarray
    vector: np.ndarray
    random: np.ndarray
    held: np.ndarray  # passage * TERMS + term, sorted: the terms of each passage
    mass: np.ndarray


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all plain words and where each document's begin."""
    buf, offs = W.buffer_of(texts)
    data = pa.py_buffer(_PLAIN[buf])
    words = W.split(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offs.astype(np.int32)), data]))
    return W.hashes(words), words.first


def term(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - BITS)).astype(np.uint16)


def _test_matrix(rank: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((TERMS, rank), np.float32)


def decomposed(product: np.ndarray, random: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvectors of a positive semi-definite C and the roots of their values, from
    product = C @ random."""
    shift = np.finfo(float).eps * max(np.linalg.norm(product), 1e-300)
    shifted = product + shift * random
    small = random.T @ shifted
    value, vector = np.linalg.eigh((small + small.T) / 2)
    fine = value > value.max(initial=0) * 1e-12
    left, root, _ = np.linalg.svd(shifted @ (vector[:, fine] / np.sqrt(value[fine])), full_matrices=False)
    return left[:, :rank], np.sqrt(np.maximum(root[:rank] ** 2 - shift, 0))


def sums_of(t: np.ndarray, first: np.ndarray, span: int, random: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Passages, in how many of them each term stands, and rows of T'TR with their terms."""
    sums = _step_sums(t, first, span, random)
    doc_steps = -(-np.diff(first) // span)
    begin = np.repeat(np.cumsum(doc_steps) - doc_steps, np.diff(first))
    passage = begin + (np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))) // span
    order = np.argsort(t, kind="stable")  # 16-bit terms: a radix sort
    term_at, passage_at = t[order], passage[order]
    new = np.r_[True, term_at[1:] != term_at[:-1]]
    distinct = new | np.r_[True, passage_at[1:] != passage_at[:-1]]
    at = np.flatnonzero(new)
    return len(sums), np.bincount(term_at[distinct], minlength=TERMS), term_at[at].astype(np.int64), _run_sums(sums, passage_at, at)


def fit(docs: DataFrame, *, span: int = 24, rank: int = 40, extra: int = 8, text_col: str = "text") -> Corpus:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = _test_matrix(rank + extra)
        seen, product, n = np.zeros(TERMS, np.int64), np.zeros((TERMS, rank + extra), np.float64), 0
        for batch in slices(batches):
            h, first = plain_words(batch["text"])
            if len(h):
                passages, own, terms, part = sums_of(term(h), first, span, random)
                n += passages
                seen += own
                product[terms] += part
        part = TaskContext.get().partitionId()
        parts = range(0, TERMS, CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part % 256] * len(parts), pa.int32()), pa.array(list(range(len(parts))), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([seen[c : c + CHUNK].tobytes() for c in parts], pa.binary()), pa.array([product[c : c + CHUNK].tobytes() for c in parts], pa.binary())],
            ["salt", "chunk", "n", "seen", "product"],
        )

    schema = "salt int, chunk int, n long, seen binary, product binary"

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = sum(np.frombuffer(x, np.int64) for x in pdf["seen"])
        product = sum(np.frombuffer(x) for x in pdf["product"])
        return pd.DataFrame({"salt": [0], "chunk": [pdf["chunk"].iloc[0]], "n": [pdf["n"].sum()], "seen": [seen.tobytes()], "product": [product.tobytes()]})

    sums = docs.select(F.lower(text_col).alias("text")).filter("text is not null").mapInArrow(rows, schema)
    got = sums.groupBy("salt", "chunk").applyInPandas(added, schema).groupBy("chunk").applyInPandas(added, schema).collect()  # TERMS / CHUNK rows
    seen, product, n = np.zeros(TERMS), np.zeros((TERMS, rank + extra)), 0
    for r in got:
        seen[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["seen"], np.int64)
        product[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["product"]).reshape(CHUNK, -1)
        n = r["n"]
    return corpus_of(seen, product, n, rank)


def corpus_of(seen: np.ndarray, product: np.ndarray, n: int, rank: int) -> Corpus:
    """A = T diag(idf): A'A times R / idf is idf times T'TR."""
    idf = np.log((n + 1) / (seen + 1)) + 0.1
    directions, values = decomposed(idf[:, None] * product, _test_matrix(product.shape[1]) / idf[:, None], rank)
    spread = np.random.default_rng(12).standard_normal((TERMS, RANDOM))
    return Corpus(idf.astype(np.float32), (idf[:, None] * np.hstack([directions, spread])).astype(np.float32), values)


def _step_sums(t: np.ndarray, first: np.ndarray, step: int, table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows of each run of ``step`` words of a document (the last is shorter)."""
    n = np.diff(first)
    count = -(-n // step)
    doc = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    size = np.minimum(first[1:][doc] - begin, step)
    k = np.arange(step)[:, None]
    row = np.where(k < size, t.take(begin + k, mode="clip") if len(t) else 0, len(table)).astype(np.intp)
    table = np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])  # its last row stands for no word
    out, more = np.empty((len(begin), table.shape[1]), table.dtype), np.empty((STEPS, table.shape[1]), table.dtype)
    for a in range(0, len(begin), STEPS):
        some = out[a : a + STEPS]
        table.take(row[0, a : a + STEPS], axis=0, out=some, mode="clip")
        for own in row[1:, a : a + STEPS]:
            some += table.take(own, axis=0, out=more[: len(some)], mode="clip")
    return out


def _run_sums(table: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of table[row] over the runs that begin at ``at``."""
    edge = np.append(at, len(row))
    out, held = np.empty((len(at), table.shape[1]), table.dtype), np.empty((WORDS, table.shape[1]), table.dtype)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + WORDS, side="right")) - 1)
        n = edge[b] - edge[a]
        rows = table.take(row[edge[a] : edge[b]], axis=0, out=held[:n] if n <= WORDS else None, mode="clip")
        np.add.reduceat(rows, edge[a:b] - edge[a], axis=0, out=out[a:b])
        a = b
    return out


def _spans(first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and end of overlapping passages of two steps each."""
    n = np.diff(first)
    count = np.maximum(np.where(n > 0, 1, 0), -(-n // step) - 1)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][doc] + k * step
    return doc, begin, np.minimum(begin + 2 * step, first[1:][doc])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _projected(t: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Passages on the latent directions and on random ones, each as unit vectors: sums of
    steps, two for a passage."""
    n = np.diff(first)
    count = -(-n // step)
    doc = np.repeat(np.arange(len(n)), count)
    edge = first[:-1][doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    sums = _step_sums(t, first, step, corpus.directions)
    sums = np.vstack([sums, np.zeros((1, sums.shape[1]), np.float32)])
    at = np.searchsorted(edge, begin)
    v = sums[at] + sums[np.where(end - begin > step, at + 1, len(edge))]
    latent = corpus.directions.shape[1] - RANDOM
    return _unit(v[:, :latent]), _unit(v[:, latent:])


def items(benchmark: DataFrame, corpus: Corpus, *, span: int = 24, step: int = 6, id_col: str = "item_id", text_col: str = "text") -> Items:
    """The rows of a benchmark (of one part of it, which the caller bounds), ready to send."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text")).filter("text is not null").collect()
    rows.sort(key=lambda r: (r["id"] is None, r["id"], r["text"]))
    h, first = plain_words(pa.array([r["text"] for r in rows], pa.string()))
    t = term(h)
    whole = [h[first[i] : first[i + 1]] for i in range(len(rows))]
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - span) // step)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][doc] + np.minimum(k * step, np.maximum(0, n[doc] - span))
    end = np.minimum(begin + span, first[1:][doc])
    held, vector = [np.zeros(0, np.int64)], np.zeros((len(doc), corpus.directions.shape[1]), np.float32)
    for i, (a, b) in enumerate(zip(begin, end, strict=True)):
        held.append(i * TERMS + np.unique(t[a:b]).astype(np.int64))
        vector[i] = corpus.directions[t[a:b]].sum(0)
    every = np.concatenate(held)
    mass = np.bincount(every // TERMS, corpus.idf[every % TERMS], minlength=len(doc))
    latent = vector.shape[1] - RANDOM
    return Items([r["id"] for r in rows], whole, doc, _unit(vector[:, :latent]), _unit(vector[:, latent:]), every, mass)


def weights(bench: Items, corpus: Corpus) -> tuple[np.ndarray, np.ndarray] | None:
    """A column for each term and, for each passage of an item, the weights of its terms (column
    0: of none); None if that table had more than WEIGHTS entries."""
    passage, t = bench.held // TERMS, bench.held % TERMS
    terms = np.unique(t)
    if len(bench.owner) * (len(terms) + 1) > WEIGHTS:
        return None
    column = np.zeros(TERMS, np.int32)
    column[terms] = np.arange(1, len(terms) + 1)
    table = np.zeros((len(bench.owner), len(terms) + 1), np.float32)
    table[passage, column[t]] = corpus.idf[t]
    return column, table


class Passages:
    """The weights of the terms of documents' passages, and how much of them items' passages hold."""

    def __init__(self, t: np.ndarray, begin: np.ndarray, end: np.ndarray, span: int, bench: Items, corpus: Corpus, table: tuple[np.ndarray, np.ndarray] | None):
        place = begin[:, None] + np.arange(span)
        inside = place < end[:, None]
        of = t.take(place, mode="clip")
        heavy = corpus.idf[of] * inside
        self.mass, self.bench, self.table = heavy.sum(1), bench, table
        if table is None:
            self.t, self.heavy = of, heavy
        else:
            self.column = table[0].take(of) * inside

    def held(self, p: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of each pair of a document's passage and an item's, the weight of what both hold."""
        if self.table is not None:
            _, table = self.table
            at = self.column.take(p, axis=0, mode="clip") + (w * table.shape[1])[:, None]
            return table.ravel().take(at, mode="clip").sum(1)
        held, key = self.bench.held, w[:, None] * TERMS + self.t[p]
        return (self.heavy[p] * (held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key)).sum(1)


def places(a: np.ndarray) -> dict[int, int]:
    """The places of each word, as bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def _longest(found: list[int], n: int) -> int:
    """Length of the longest common subsequence of n words and of a row of words, of which
    ``found`` gives the places among them."""
    full = (1 << n) - 1
    state = full
    for m in found:
        hit = state & m
        state = ((state + hit) | (state - hit)) & full
    return n - state.bit_count()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits."""
    at = places(a)
    return _longest([m for x in b.tolist() if (m := at.get(x))], len(a))


def matches(item: np.ndarray, around: np.ndarray, covered: float, partly: float, answer: int, least_words: int, at: dict[int, int] | None = None) -> float:
    """The part of the item that is there, or 0 if it is not held as contaminated. ``at``: the
    item's ``places``."""
    n, at = len(item), places(item) if at is None else at
    found = [m for x in around.tolist() if (m := at.get(x))]
    every = 0
    for m in set(found):
        every |= m
    # no common subsequence is longer than either of these
    if min(len(found), every.bit_count()) / n < (1.0 if n < least_words else min(covered, partly)):
        return 0.0
    share = _longest(found, n) / n
    if share >= (1.0 if n < least_words else covered):
        return share
    if n >= least_words and share >= partly:
        tail = item[-answer:]
        rows = W.windows(around, len(tail)) if len(around) >= len(tail) else around[:0]
        if (rows == W.windows(tail, len(tail))[0]).any():
            return share
    return 0.0


def _parts(benchmark: DataFrame, text_col: str, part_bytes: int) -> int:
    size = benchmark.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n")).first()["n"] or 0
    return max(1, -(-size // part_bytes))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, span: int = 24, rank: int = 40, cosine: float = 0.5, spread: float = 0.3, shared: float = 0.4, covered: float = 0.7, partly: float = 0.5, answer: int = 4, least_words: int = 8, part_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, contaminated, item_id (the best covered item, or null), coverage, and the columns
    of docs named in ``carry``."""
    spark, step = docs.sparkSession, span // 2
    corpus = fit(docs, span=span, rank=rank, text_col=text_col)

    def judged(source: DataFrame, some: DataFrame) -> DataFrame:
        bench = items(some, corpus, span=span)
        complete = Complete.of(bench.words, corpus, span=span, covered=covered, answer=answer, least_words=least_words)
        sent = spark.sparkContext.broadcast((corpus, bench, complete))

        def better(share: float, item: int | None, than: tuple[float, int | None]) -> bool:
            return share > than[0] or 0 < share == than[0] and item is not None and (than[1] is None or item < than[1])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            corpus, bench, complete = sent.value
            table, across = weights(bench, corpus), np.ascontiguousarray(bench.random.T)
            some_places = lru_cache(1024)(lambda item: places(bench.words[item]))
            for batch in slices(batches, "_lower"):
                best = list(zip(batch["coverage"].to_pylist(), batch["item_id"].to_pylist(), strict=True))
                h, first = plain_words(batch["_lower"])
                if len(h) and len(bench.owner):
                    t = term(h)
                    doc, begin, end = _spans(first, step)
                    vector, random = _projected(t, first, begin, end, step, corpus)
                    passages = Passages(t, begin, end, span, bench, corpus, table)
                    tried: set[tuple[int, int, int, int]] = set()

                    def judge(d: int, item: int, a: int, b: int) -> None:
                        if better(1.0, bench.ids[item], best[d]) and (d, item, a, b) not in tried:
                            tried.add((d, item, a, b))
                            words = bench.words[item]
                            share = matches(words, h[a:b], covered, partly, answer, least_words, some_places(item) if len(words) <= 256 else None)
                            if better(share, bench.ids[item], best[d]):
                                best[d] = share, bench.ids[item]

                    for candidate in complete.candidates(h, first, bench.words, span):
                        judge(*candidate)
                    wide = max(1, COSINES // len(bench.owner))
                    for at in range(0, len(doc), wide):
                        near = np.flatnonzero(random[at : at + wide] @ across >= spread)
                        passage, which = at + near // len(bench.owner), near % len(bench.owner)
                        for k in range(0, len(passage), PAIRS):
                            p, w = passage[k : k + PAIRS], which[k : k + PAIRS]
                            alike = np.einsum("ij,ij->i", vector[p], bench.vector[w]) >= cosine
                            p, w = p[alike], w[alike]
                            own = np.minimum(passages.mass[p], bench.mass[w])
                            for i in np.flatnonzero(passages.held(p, w) >= shared * own):
                                d, item = int(doc[p[i]]), int(bench.owner[w[i]])
                                n = len(bench.words[item])
                                judge(d, item, int(max(first[d], begin[p[i]] - n)), int(min(first[d + 1], end[p[i]] + n)))
                columns = {c: batch[c] for c in batch.schema.names} | {"coverage": pa.array([s for s, _ in best], pa.float64()), "item_id": pa.array([i for _, i in best], pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        return source.mapInArrow(rows, source.schema)

    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry or [])]
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("_lower"), F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("item_id"), *kept)
    parts = _parts(benchmark, "text", part_bytes)
    work = Scratch(spark, "leaks")
    for part in range(parts):
        some = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else benchmark
        out = judged(out, some)
        if part < parts - 1:
            out = work.cut(out, f"part{part}")
    return out.select("doc_id", (F.col("coverage") > 0).alias("contaminated"), "item_id", "coverage", *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry or [])))
