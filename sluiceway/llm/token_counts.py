"""Token counts by rank-synchronous array merging.

The pre-tokens of a slice of texts that are not yet known are held as one ragged numpy array
of symbols. In each round every sequence finds the lowest rank among its neighbouring pairs,
and all its occurrences of that pair are merged at once (left to right, without overlap), for
all sequences together; a sequence without a mergeable pair is done, and its symbols are
counted. Lookups of pair ranks go through one open-addressed numpy table. Counts of pre-tokens
are kept in a cache of bounded size.

For a ``.model`` file the sentencepiece library does the counting, since its merges follow
scores rather than a merge list.

Edge cases: null text has 0 bytes and 0 tokens, and so has empty text. Special strings inside
a text count as one token, as the library takes them. Other columns are not read; every row is
counted by itself, so ties, repeated rows, null ids and empty tables need no rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.bpe import Vocabulary, read_spec
from sluiceway.llm.shared import held, slices

_NONE = np.int32(2**31 - 1)
_U = np.uint64
CACHE = 800_000


class PairRanks:
    """(left id, right id) to (rank, merged id), open addressing with linear probing."""

    def __init__(self, vocabulary: Vocabulary):
        pairs = np.array(list(vocabulary.rank), np.uint64)
        rank = np.fromiter(vocabulary.rank.values(), np.int32)
        by_bytes = vocabulary.id_of
        new = np.array([by_bytes[vocabulary.bytes_of[a] + vocabulary.bytes_of[b]] for a, b in vocabulary.rank], np.int32)
        self.bits = int(4 * len(pairs)).bit_length()
        size = 1 << self.bits
        self.key, self.rank, self.new = np.zeros(size, _U), np.full(size, _NONE), np.zeros(size, np.int32)
        keys = (pairs[:, 0] << _U(32) | pairs[:, 1]) + _U(1)
        left, probe, self.probes = np.arange(len(keys)), 0, 0
        while len(left):
            slot = self._slot(keys[left], probe)
            free = self.key[slot] == 0
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            take = one[free[one]]
            self.key[slot[take]], self.rank[slot[take]], self.new[slot[take]] = keys[left[take]], rank[left[take]], new[left[take]]
            left = np.delete(left, take)
            probe += 1
        self.probes = probe

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)) + _U(probe)).astype(np.int64) & ((1 << self.bits) - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(_U) << _U(32) | right.astype(_U)) + _U(1)
        slot = self._slot(keys, 0)
        there = self.key[slot]
        open_ = np.flatnonzero((there != keys) & (there != 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = self._slot(keys[open_], probe)
            there = self.key[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != 0)]
        found = self.key[slot] == keys
        return np.where(found, self.rank[slot], _NONE), self.new[slot]


def count_symbols(symbols: np.ndarray, sizes: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """Surviving symbols of each sequence (none is empty); symbols: all sequences, end to end."""
    counts = sizes.astype(np.int64).copy()
    seq = np.repeat(np.arange(len(sizes)), sizes)
    sym = symbols.astype(np.int32)
    while len(sym) > 1:
        rank, new = ranks.lookup(sym[:-1], sym[1:])
        rank[seq[1:] != seq[:-1]] = _NONE
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lowest = np.minimum.reduceat(np.append(rank, _NONE), first)
        width = np.diff(np.append(first, len(seq)))
        alive = np.repeat(lowest, width)
        hit = np.append((rank == alive[:-1]) & (rank != _NONE), False)
        at = np.flatnonzero(hit)
        if not len(at):
            break
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        sym[at] = new[at]
        keep = alive != _NONE
        keep[at + 1] = False
        counts -= np.bincount(seq[at], minlength=len(counts))
        sym, seq = sym[keep], seq[keep]
    return counts


class Counter:
    """Token counts of texts under one byte-level vocabulary."""

    def __init__(self, spec: str):
        self.vocabulary = Vocabulary(spec)
        self.ranks = PairRanks(self.vocabulary)
        self.known: dict[str, int] = {}

    def _learn(self, pieces: set[str]) -> None:
        unknown = [p for p in pieces if p not in self.known]
        if len(self.known) + len(unknown) > CACHE:
            self.known = {}
            unknown = list(pieces)
        at = 0
        while at < len(unknown):
            some, size = [], 0
            while at < len(unknown) and size < 1 << 20:
                some.append(unknown[at].encode())
                size += len(some[-1])
                at += 1
            data = np.frombuffer(b"".join(some), np.uint8)
            counts = count_symbols(self.vocabulary.single[data], np.fromiter(map(len, some), np.int64), self.ranks)
            self.known.update(zip(unknown[at - len(some) : at], counts.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        parts, specials = [], []
        for text in texts:
            own, n = [], 0
            for special, piece in self.vocabulary.pieces(text):
                if special:
                    n += 1
                else:
                    own += self.vocabulary.pretokens(piece)
            parts.append(own)
            specials.append(n)
        self._learn(set().union(*parts))
        get = self.known.__getitem__
        return [n + sum(map(get, own)) for n, own in zip(specials, parts, strict=True)]


def _counter(spec: str) -> Counter:
    return held(("counts", spec), lambda: Counter(spec))


def token_counts(docs: DataFrame, *, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), whole texts."""
    context = docs.sparkSession.sparkContext
    if tokenizer.endswith(".model"):
        with open(tokenizer, "rb") as f:
            model = context.broadcast(f.read())

        def count(texts: list[str]) -> list[int]:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=model.value)
            return [len(x) for x in pieces.encode(texts, num_threads=1)]
    else:
        spec = context.broadcast(read_spec(tokenizer))

        def count(texts: list[str]) -> list[int]:
            return _counter(spec.value).count(texts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, keep=True):
            n = np.array(count([t or "" for t in batch["text"].to_pylist()]), np.int64)
            size = pc.cast(pc.fill_null(pc.binary_length(batch["text"]), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
