"""Phrases that stand together more often than their parts suggest, counted on a prefix-free parse.

A-Z are lower-cased; ``[.,;:!?]`` and line ends cut a text into pieces, blanks and tabs a piece into
words. All counts are of one language (null: ``und``).

Parse: a text is cut at words where the hash of the next ``overlap`` words is 0 modulo ``modulus``,
so equal passages are cut alike wherever they stand. A chunk reaches from its cut to ``overlap``
words past the next one: it begins and ends with a trigger and has none inside, so no chunk begins
another. Chunks make up a dictionary with the number of times that the parse has each. A chunk owns the
words before the next cut (``own``), the last of a text all of its words; a phrase is counted in the chunk that owns
its first word, which holds the phrase to its end, so what overlaps counts once. Copies cost one
dictionary entry.

Counts: phrases of up to ``longest`` words inside distinct chunks, weighted with the chunk's
frequency. Each length is counted by hash first, and only where the phrases of one word less that it holds may be frequent: a
bit set of their hashes, whose size has a fixed bound, answers that. It may let too much pass
and never too little. What passes at the end is counted by its text, so counts are exact.

Scores: a candidate with a = f(phrase) >= ``least`` is cut after each of its words; l and r are the counts
of both sides, and its score is the smallest floor(1000 * a * n / (l * r)), in decimals of 38
digits. A candidate goes if a longer one with the same count holds it.

Edge cases: null text counts as empty. Rows are texts, also those that repeat an id. Empty
texts and tables give no phrases. Without a trigger a chunk is cut after ``bound`` words (same
counts, fewer shared chunks). Ties go to the smaller phrase in UTF-8. Columns other than text and
lang are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm import words
from sluiceway.llm.shared import Scratch, slices

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
#: Chunks, or hashes, that a task holds before it passes them on.
HELD_CHUNKS = 50_000
HELD_HASHES = 2_000_000
#: Bits of the largest set of frequent hashes (32 MB), and of one block of it.
MOST_BITS = 28
BLOCK_BITS = 15


def parse(texts: list[bytes], modulus: int, overlap: int, bound: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Chunks of texts in order, how many words each owns, and the place of its text. A chunk's
    words are joined with blanks, and with line ends where a piece ends."""
    buf = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    kind = _KIND[buf]
    inside = np.concatenate([[False], kind == 0])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(start):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(offsets, start, side="right") - 1
    piece = np.cumsum(kind == 2)[start]

    # every word with one byte after it: a blank, or a line end where its piece ends
    kept = kind == 0
    kept[end] = True
    flat = buf.copy()
    flat[end] = 0x20
    flat[end[np.append(piece[1:] != piece[:-1], True)]] = 0x0A
    flat = flat[kept].tobytes()
    at = np.concatenate([[0], np.cumsum(end - start + 1)])

    h = words.windows(words.hashes(words.Words(buf, start, end, offsets)), overlap)
    n = len(start)
    cut = np.zeros(n, bool)
    cut[: len(h)] = (h % _U(modulus) == 0) & (text[: len(h)] == text[overlap - 1 :])
    cut[np.flatnonzero(np.append(True, text[1:] != text[:-1]))] = True
    begins = np.flatnonzero(cut)
    sizes = np.diff(np.append(begins, n))
    if sizes.max() > bound:
        begins = np.concatenate([np.arange(b, b + s, bound) for b, s in zip(begins, sizes, strict=True)])
    nexts = np.append(begins[1:], n)
    last = np.searchsorted(text, text[begins], side="right")  # where the text ends
    ends = np.where(nexts < last, np.minimum(nexts + overlap, last), last)
    return [flat[a:b] for a, b in zip(at[begins], at[ends] - 1, strict=True)], np.where(nexts < last, nexts, last) - begins, text[begins]


def chunks(batches: Iterator[pa.RecordBatch], modulus: int, overlap: int, bound: int) -> Iterator[pa.RecordBatch]:
    """lang, chunk, own, n of what a task reads: a part of the dictionary each time it is full."""
    held: Counter = Counter()

    def given() -> pa.RecordBatch:
        lang, chunk, own = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(chunk, pa.binary()).cast(pa.string()), pa.array(own, pa.int32()), pa.array(held.values(), pa.int64())], ["lang", "chunk", "own", "n"])

    for b in slices(batches):
        langs = b["lang"].to_pylist()
        found, own, text = parse(b["text"].cast(pa.binary()).to_pylist(), modulus, overlap, bound)
        held.update(zip([langs[i] for i in text], found, own.tolist(), strict=True))
        if len(held) > HELD_CHUNKS:
            yield given()
            held = Counter()
    if held:
        yield given()


class Positions(NamedTuple):
    """Words of a batch of chunks. flat: its bytes; start, end: of each word; last: index of the last
    word of its piece; own: owned by its chunk; weight: the chunk's; chunk: its number;
    h: hash of each word; salt: hash of each chunk's language."""

    flat: np.ndarray
    start: np.ndarray
    end: np.ndarray
    last: np.ndarray
    own: np.ndarray
    weight: np.ndarray
    chunk: np.ndarray
    h: np.ndarray
    salt: np.ndarray


def positions(b: pa.RecordBatch) -> Positions:
    texts = b["chunk"].cast(pa.binary()).to_pylist()
    flat = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    breaks = flat == 0x0A
    end = np.flatnonzero(breaks | (flat == 0x20))
    start = np.concatenate([[0], end[:-1] + 1])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, offsets)
    chunk = np.repeat(np.arange(len(texts)), np.diff(first))
    stops = np.flatnonzero(breaks[end])
    last = stops[np.searchsorted(stops, np.arange(len(end)))]
    own = np.arange(len(end)) - first[chunk] < b["own"].to_numpy()[chunk]
    langs = b["lang"].dictionary_encode()
    codes = _language_codes(langs.dictionary)
    return Positions(flat, start, end, last, own, b["n"].to_numpy()[chunk], chunk, words.hashes(words.Words(flat, start, end, first)), codes[langs.indices.to_numpy()][chunk])


def _language_codes(langs: pa.Array) -> np.ndarray:
    """A hash of each language's whole name."""
    buf, offsets = words.buffer_of(langs)
    return words.hashes(words.Words(buf, offsets[:-1], offsets[1:], offsets))


class Frequent:
    """Hashes that may be frequent: a set bit for each."""

    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.shift = bits, _U(64 - log)

    def of(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def keyed(p: Positions, length: int) -> list[np.ndarray]:
    """For each length from 1: hashes of the phrases at all words, with the language in them; at words
    where the piece is too short the hash is of no phrase (see ``fits``)."""
    out, g, size = [], p.h, len(p.h)
    for n in range(1, length + 1):
        if n > 1:
            left = max(0, size - n + 1)
            g = np.concatenate([words.pair(g[:left], p.h[size - left :], n), np.zeros(size - left, _U)])
        out.append(words.mix64(g + p.salt * _U(2 * n + 1)))
    return out


def fits(p: Positions, n: int) -> np.ndarray:
    return np.arange(len(p.h)) + n - 1 <= p.last


def gram_counts(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], below: dict[int, Frequent], below_length: int) -> Iterator[pa.RecordBatch]:
    """h, w of the phrases of these lengths whose parts of ``below_length`` words may be frequent."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, w = (np.concatenate(x) for x in zip(*held, strict=True))
        h, place = np.unique(h, return_inverse=True)
        total = np.zeros(len(h), np.int64)
        np.add.at(total, place, w)
        return h, total

    def given(x: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], ["h", "w"])

    for b in slices(batches, "chunk", rows=1 << 14):
        p = positions(b)
        keys = keyed(p, max(lengths))
        fine = fits(p, below_length) & below[below_length].of(keys[below_length - 1]) if below_length else None
        for n in lengths:
            at = p.own & fits(p, n)
            for i in range(n - below_length + 1 if below_length else 0):
                at &= np.append(fine[i:], np.zeros(i, bool)) if i else fine
            held.append((keys[n - 1][at], p.weight[at]))
            size += int(at.sum())
        if size > HELD_HASHES:
            held = [merged()]
            size = len(held[0][0])
            if size > HELD_HASHES // 2:
                yield given(held[0])
                held, size = [], 0
    if size:
        yield given(merged())


def phrase_counts(batches: Iterator[pa.RecordBatch], frequent: dict[int, Frequent], longest: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, words, w of the phrases that may be frequent, by their text."""
    for b in slices(batches, "chunk", rows=1 << 14):
        p = positions(b)
        langs, flat = b["lang"].to_pylist(), p.flat.tobytes()
        every = np.arange(len(p.h))
        # exact numbers of words: hashes only bring equal phrases together
        lengths = p.end - p.start
        kept = np.ones(len(flat), bool)
        kept[p.end] = False
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        number = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(p.h), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(p.flat[kept].tobytes())]).dictionary_encode().indices.to_numpy()
        number = np.append(number, np.full(longest, -1, number.dtype))
        keys = keyed(p, longest)
        out: Counter = Counter()
        for n in range(1, longest + 1):
            at = every[p.own & fits(p, n) & frequent[n].of(keys[n - 1])]
            if not len(at):
                continue
            _, head, group = np.unique(keys[n - 1][at], return_index=True, return_inverse=True)
            rep = at[head][group]
            same = np.ones(len(at), bool)
            for j in range(n):
                same &= number[at + j] == number[rep + j]
            langs_of = b["lang"].dictionary_encode().indices.to_numpy()[p.chunk]
            same &= langs_of[at] == langs_of[rep]
            total = np.zeros(len(head), np.int64)
            np.add.at(total, group[same], p.weight[at[same]])
            for i, w in zip(at[head], total.tolist(), strict=True):
                out[langs[p.chunk[i]], flat[p.start[i] : p.end[i + n - 1]], n] += w
            for i in at[~same]:  # another phrase of the same hash
                out[langs[p.chunk[i]], flat[p.start[i] : p.end[i + n - 1]], n] += int(p.weight[i])
        if out:
            lang, phrase, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int32()), pa.array(out.values(), pa.int64())], ["lang", "phrase", "words", "w"])


def frequent_bits(hashes: DataFrame, n: int) -> Frequent:
    """The set of n hashes (h), of 16 bits for each within the fixed bounds, gathered block by block."""
    log = min(MOST_BITS, max(BLOCK_BITS + 1, int(16 * n).bit_length()))
    place = F.shiftrightunsigned("h", 64 - log)
    blocks = hashes.select(F.shiftright(place, BLOCK_BITS).cast("int").alias("block"), place.bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("bit"))

    def pack(rows):
        import pandas as pd

        bits = np.zeros(1 << BLOCK_BITS, np.uint8)
        bits[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros((1 << log - BLOCK_BITS, 1 << BLOCK_BITS - 3), np.uint8)
    for r in blocks.distinct().groupBy("block").applyInPandas(pack, "block int, bits binary").collect():  # 32 MB at most
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return Frequent(out.ravel(), log)


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, top: int = 2000, modulus: int = 32, bound: int = 4096) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of documents (text, lang)."""
    spark = docs.sparkSession
    work = Scratch(spark, "collocations")
    overlap = longest - 1
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parsed = own.mapInArrow(lambda b: chunks(b, modulus, overlap, bound), "lang string, chunk string, own int, n long")
    dictionary = work.cut(parsed.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n")), "dictionary")

    sent: dict[int, object] = {}
    for lengths, below in [((1, 2), 0), ((3,), 2), (tuple(range(4, longest + 1)), 3)] if longest > 3 else [(tuple(range(1, longest + 1)), 0)]:
        kept = {k: sent[k] for k in ([below] if below else [])}
        found = dictionary.mapInArrow(lambda b, lengths=lengths, below=below, kept=kept: gram_counts(b, lengths, {k: v.value for k, v in kept.items()}, below), "h long, w long")
        hot = work.cut(found.groupBy("h").agg(F.sum("w").alias("w")).filter(F.col("w") >= least).select("h"), f"hashes{below}")
        bits = spark.sparkContext.broadcast(frequent_bits(hot, hot.count()))
        sent |= {n: bits for n in lengths}
    counted = dictionary.mapInArrow(lambda b: phrase_counts(b, {n: v.value for n, v in sent.items()}, longest), "lang string, phrase string, words int, w long")
    frequent = work.cut(counted.groupBy("lang", "phrase", "words").agg(F.sum("w").alias("f")).filter(F.col("f") >= least), "frequent")
    whole = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))

    part = frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    split = frequent.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w"))
    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    both = sides.join(part.select("lang", F.col("part").alias("first"), F.col("part_f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("part").alias("rest"), F.col("part_f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    scored = both.join(whole, "lang").select("lang", "phrase", "a", "n", "k", "l", "r", score.alias("score"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("m")).select("lang", "phrase", "m.*")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    covers = split.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    free = lowest.join(covers, ["lang", "phrase"], "left").filter("cover is null or cover < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
