"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares two words by the ordered triples of letters they share, with gaps allowed:
a triple weighs ``decay`` to the power of the letters it skips, so an insult keeps most of its
kernel value when letters are inserted. A mark stands before the first letter, so beginnings
count. Punctuation inside words is dropped, and runs of single letters are read as one word
("s t u p i d").

Training is on a bounded, labelled sample of documents, of which tasks send the distinct words
and not the texts. Landmarks are the words that speak most
for label 1 and words of clean documents. The Nystroem map of a word is K_mm^(-1/2) k_m(word);
a linear support vector machine is trained on it in numpy. Only documents are labelled, so it
starts from words that stand in toxic documents alone more often than chance allows, also with
a letter put in, and goes on in turns: the highest scoring word of each document is its
witness; confident witnesses of toxic documents are positive, those of clean ones negative.

The decision is linear in the triples of a word, so it folds into one weight for each triple
(64 letter classes, 64^3 weights). A document scores as its highest scoring word, whole texts.

Edge cases: null and empty texts, and texts without letters or digits, score 0. Null labels
are not learned from; without labelled rows of both classes every score is 0. Rows with a null
id are scored and count as held out. Repeated rows each get the same score; an id that is labelled
twice counts as its largest label. A very long text scores as its highest scoring word, like any
other. Empty tables give no rows. Ties at the cut are predicted 1. Only the id and text columns
are read besides the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm import words as W
from sluiceway.llm.quality import _sample
from sluiceway.llm.shared import fold, slices

_U = np.uint64
#: Letters that a triple may span, and letters of a word taken together.
SPAN, PIECE = 7, 32
CLASSES = 64


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each byte: 0 for what is dropped, 1 for the mark, then letters and digits;
    bytes of other characters share the rest."""
    c = np.zeros(256, np.uint8)
    c[97:123] = c[65:91] = np.arange(2, 28)
    c[48:58] = np.arange(28, 38)
    c[128:] = 38 + np.arange(128) % (CLASSES - 38)
    return c


@lru_cache(maxsize=64)
def _triples(length: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (3 x n) of all triples within SPAN letters of a word, and their weights."""
    places = [t for t in combinations(range(length), 3) if t[2] - t[0] < SPAN]
    at = np.array(places, np.int64).reshape(-1, 3).T
    return at, decay ** (at[2] - at[0] - 2).astype(np.float32)


class Tokens(NamedTuple):
    """Words of a batch as letter classes, end to end with a leading mark; owner: document."""

    letters: np.ndarray
    first: np.ndarray
    owner: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    words = W.split(texts)
    kind = _classes()[words.buf]
    kept = kind > 0
    count = np.concatenate([[0], np.cumsum(kept)])
    size = count[words.end] - count[words.start]
    n = np.diff(words.first)
    owner = np.repeat(np.arange(len(n)), n)
    start, end = count[words.start], count[words.end]
    one = size == 1
    # runs of three or more single letters become one word each
    edge = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (owner[1:] != owner[:-1])]) if len(one) else np.zeros(0, np.int64)
    stop = np.append(edge[1:], len(one))
    run = one[edge] & (stop - edge >= 3) if len(edge) else np.zeros(0, bool)
    keep = (size > 0) & ~np.repeat(run, stop - edge)
    begin = np.concatenate([start[keep], start[edge[run]]])
    finish = np.concatenate([end[keep], end[stop[run] - 1]])
    owner = np.concatenate([owner[keep], owner[edge[run]]])
    # long words in overlapping pieces
    long = finish - begin > PIECE
    if long.any():
        b, f, o = begin[long], finish[long], owner[long]
        pieces = -(-(f - b - PIECE // 2) // (PIECE // 2))
        step = np.concatenate([np.arange(p) for p in pieces]) * (PIECE // 2)
        more = np.repeat(b, pieces) + step
        begin = np.concatenate([begin[~long], more])
        finish = np.concatenate([finish[~long], np.minimum(more + PIECE, np.repeat(f, pieces))])
        owner = np.concatenate([owner[~long], np.repeat(o, pieces)])
    size = finish - begin + 1
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(begin - first[:-1] - 1, size) + np.arange(first[-1])
    stream = kind[kept]
    letters = stream[np.clip(place, 0, max(0, len(stream) - 1))] if len(stream) else np.zeros(0, np.uint8)
    letters[first[:-1]] = 1
    return Tokens(letters, first, owner)


def distinct(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and for each word its place among these."""
    up, down = W._grown(len(t.letters) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(t.letters.astype(_U) * up[: len(t.letters)], dtype=_U)])
    h = W.mix64((total[t.first[1:]] - total[t.first[:-1]]) * down[t.first[:-1]])
    _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    return at, inverse


def _by_length(first: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    size = first[at + 1] - first[at]
    for length in np.unique(size):
        yield np.flatnonzero(size == length), int(length)


def _codes(letters: np.ndarray, begin: np.ndarray, places: np.ndarray) -> np.ndarray:
    a, b, c = (letters[begin[:, None] + p[None, :]].astype(np.int32) for p in places)
    return (a * CLASSES + b) * CLASSES + c


def word_scores(letters: np.ndarray, first: np.ndarray, at: np.ndarray, weight: np.ndarray, bias: float, decay: float) -> np.ndarray:
    out = np.full(len(at), bias, np.float32)
    for rows, length in _by_length(first, at):
        places, worth = _triples(length, decay)
        if not len(worth):
            continue
        norm = np.sqrt((worth**2).sum())
        step = max(1, 1_000_000 // len(worth))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            out[some] = (weight[_codes(letters, first[at[some]], places)] @ worth) / norm + bias
    return out


class Model(NamedTuple):
    weight: np.ndarray
    bias: float
    decay: float
    scale: float
    shift: float


def _kernel(letters: np.ndarray, first: np.ndarray, at: np.ndarray, marks: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised kernel of words ``at`` with landmarks ``marks``; also the landmarks' triples."""

    def dense(which: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(which), width), np.float32)
        for rows, length in _by_length(first, which):
            places, worth = _triples(length, decay)
            if not len(worth):
                continue
            code = column[_codes(letters, first[which[rows]], places)]
            np.add.at(out, (rows[:, None], code), (worth / np.sqrt((worth**2).sum()))[None, :])
        return out

    used = [np.zeros(0, np.int32)]
    for rows, length in _by_length(first, marks):
        used.append(_codes(letters, first[marks[rows]], _triples(length, decay)[0]).ravel())
    used = np.unique(np.concatenate(used))
    column = np.full(CLASSES**3, len(used), np.int64)
    column[used] = np.arange(len(used))
    own = dense(marks, column, len(used) + 1)[:, :-1]
    k = np.concatenate([dense(at[i : i + 500], column, len(used) + 1)[:, :-1] @ own.T for i in range(0, len(at), 500)])
    return k, own, used


def groups(doc: np.ndarray, word: np.ndarray, n: int, bands: int = 8) -> np.ndarray:
    """A group for each of the sample's n documents: near copies share one, so that the words
    of a text that was copied often don't pass for words that many documents chose. (doc,
    word): the distinct words of each document, by document."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    often = np.bincount(word)[word]
    rare = often <= max(30, n // 50)
    doc, word = doc[rare], word[rare].astype(_U)
    there, first = np.unique(doc, return_index=True)
    if not len(there):
        return parent
    salts = W.mix64(np.arange(1, 4 * bands + 1, dtype=_U))
    low = [np.minimum.reduceat(W.mix64(word + salt), first) for salt in salts]
    for i in range(bands):
        seen: dict[int, int] = {}
        key = W.pair(W.pair(low[4 * i], low[4 * i + 1]), W.pair(low[4 * i + 2], low[4 * i + 3]))
        for d, k in zip(there.tolist(), key.tolist(), strict=True):
            parent[root(d)] = root(seen.setdefault(k, d))
    return np.array([root(i) for i in range(n)])


def svm(z: np.ndarray, sign: np.ndarray, cost: np.ndarray, penalty: float, turns: int = 40) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by Newton steps on
    the rows within the margin (Chapelle, "Training a support vector machine in the primal")."""
    w, inside = np.zeros(z.shape[1]), np.ones(len(z), bool)
    ridge = penalty * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(turns):
        a = z[inside] * cost[inside, None]
        w = np.linalg.solve(z[inside].T @ a + ridge, a.T @ sign[inside])
        now = sign * (z @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn scores into probabilities (Platt, with his smoothed targets)."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    mean, width = score.mean(), score.std() + 1e-9
    x = np.stack([(score - mean) / width, np.ones(len(score))])
    b = np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -50, 50)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-4)) @ x.T + 1e-6 * np.eye(2), x @ (target - p))
        b += step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
    return float(max(b[0], 1e-3) / width), float(b[1] - max(b[0], 1e-3) * mean / width)


def own_words(texts: pa.Array) -> list[bytes]:
    """The distinct words of each document as letter classes, each with its leading mark."""
    t = tokens(texts)
    at, word = distinct(t)
    doc, some = np.unique(np.stack([t.owner, word]), axis=1)
    size = t.first[at[some] + 1] - t.first[at[some]]
    edge = np.concatenate([[0], np.cumsum(size)])
    letters = t.letters[np.repeat(t.first[at[some]] - edge[:-1], size) + np.arange(edge[-1])]
    bound = edge[np.searchsorted(doc, np.arange(len(texts) + 1))]
    return [letters[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]


def joined(sets: list[bytes]) -> tuple[Tokens, np.ndarray]:
    """Every word of ``own_words`` once, and for each document's words their place among these
    (owner: the document of each of the latter)."""
    place: dict[bytes, int] = {}
    rows = [np.array([place.setdefault(w, len(place)) for w in own.split(b"\1")[1:]], np.int64) for own in sets]
    letters = np.frombuffer(b"".join(b"\1" + w for w in place), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(w) + 1 for w in place], dtype=np.int64)])
    return Tokens(letters, first, np.repeat(np.arange(len(sets)), [len(r) for r in rows])), np.concatenate([np.zeros(0, np.int64), *rows])


def train(sets: list[bytes], y: np.ndarray, *, landmarks: int, decay: float, turns: int, seed: int, penalty: float = 1e-2) -> Model:
    zero = Model(np.zeros(CLASSES**3, np.float32), 0.0, decay, 0.0, -50.0)
    if not len(y) or y.min() == y.max():
        return zero
    t, word = joined(sets)
    if not len(t.owner):
        return zero
    rng = np.random.default_rng(seed)
    at, place = distinct(t)
    word = place[word]
    seen = np.unique(np.stack([t.owner, word]), axis=1)
    own_group = groups(seen[0], seen[1], len(y))
    pairs = np.unique(np.stack([own_group[seen[0]], seen[1]])[:, y[seen[0]] == 1], axis=1)
    toxic = np.bincount(pairs[1], minlength=len(at))
    clean = np.bincount(seen[1][y[seen[0]] == 0], minlength=len(at))
    long = t.first[at + 1] - t.first[at] >= 4
    # words of toxic documents alone, more often than any of so many words would be by chance
    chance = np.log((y == 1).sum() / len(y))
    sure = np.flatnonzero(long & (clean <= 0.01 * toxic) & (toxic * chance < -np.log(len(at)) - 2))
    if len(sure) < 4:
        sure = np.flatnonzero(long & (clean == 0) & (toxic > 1))
    sure = sure[np.argsort(-toxic[sure], kind="stable")]
    plain = np.flatnonzero(long & (clean > 0))
    if not len(sure) or not len(plain):
        return zero
    plain = plain[rng.permutation(len(plain))][:6000]
    marks = at[np.concatenate([sure[:landmarks], plain[: landmarks // 2]])]
    # the surest words with a letter put in count as positive, too
    forms = [t.letters[t.first[a] + 1 : t.first[a + 1]] for a in at[sure[:400]]]
    forms = [np.insert(f, rng.integers(1, len(f)), rng.integers(2, 38)).astype(np.uint8) for f in forms for _ in range(3)]
    letters = np.concatenate([t.letters, *(np.append(np.uint8(1), f) for f in forms)])
    first = np.concatenate([t.first, t.first[-1] + np.cumsum([len(f) + 1 for f in forms])])
    at = np.concatenate([at, len(t.first) - 1 + np.arange(len(forms))])
    clean = np.append(clean, np.zeros(len(forms), int))
    toxic = np.append(toxic, np.ones(len(forms), int))
    sure = np.concatenate([sure[:2000], len(at) - len(forms) + np.arange(len(forms))])
    positive, negative = sure, plain
    for turn in range(turns):
        some = np.concatenate([positive, negative])
        sign = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        k, own, used = _kernel(letters, first, at[some], marks, decay)
        value, vector = np.linalg.eigh((own @ own.T).astype(np.float64))
        good = value > 1e-4 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])
        z = np.hstack([k @ root, np.ones((len(k), 1))])
        cost = np.where(sign > 0, 0.5 / len(positive), 0.5 / len(negative)) * len(sign)
        w = svm(z, sign, cost, penalty)
        weight = np.zeros(CLASSES**3, np.float32)
        weight[used] = own.T @ (root @ w[:-1])
        bias = float(w[-1])
        score = word_scores(letters, first, at, weight, bias, decay)[word]
        order = np.lexsort((score, t.owner))
        last = np.flatnonzero(np.r_[t.owner[order][1:] != t.owner[order][:-1], True])
        witness, doc, top = word[order[last]], t.owner[order[last]], score[order[last]]
        if turn + 1 == turns:
            return Model(weight, bias, decay, *platt(top, y[doc]))
        told = np.unique(witness[(y[doc] == 1) & (top > 0)])
        positive = np.unique(np.concatenate([sure, told[clean[told] <= 0.01 * toxic[told]]]))
        negative = np.concatenate([plain, np.repeat(np.unique(witness[y[doc] == 0]), 2)])
    return zero


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = 5000, landmarks: int = 160, decay: float = 0.6, turns: int = 3, held_parts: int = 4, held_part: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Model:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(own_words(batch["text"]), pa.binary())], ["doc_id", "y", "words"])

    got = _sample(docs, labels, label, sample, held_parts, held_part, id_col, text_col).mapInArrow(rows, "doc_id long, y int, words binary").collect()
    got.sort(key=lambda r: (r["doc_id"], sorted(r["words"].split(b"\1"))))
    return train([r["words"] for r in got], np.array([r["y"] for r in got], np.int64), landmarks=landmarks, decay=decay, turns=turns, seed=seed)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    t = tokens(texts)
    top = np.full(len(texts), -np.inf)
    if len(t.owner):
        at, word = distinct(t)
        np.maximum.at(top, t.owner, word_scores(t.letters, t.first, at, model.weight, model.bias, model.decay)[word])
    score = 1 / (1 + np.exp(-np.clip(model.scale * top + model.shift, -50, 50))) if model.scale else np.zeros(len(texts))
    return np.where(np.isneginf(top), 0.0, score)


def toxicity_scores(docs: DataFrame, model: Model, *, cut: float = 0.3, held_parts: int = 4, held_part: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = scores(sent.value, batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col(id_col), held_parts) == held_part, F.lit(True))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
