"""Substring deduplication by level-wise doubling.

A window is ``window`` consecutive words of one document. A window whose word sequence also
starts earlier (smaller id, or same document and earlier start) is a repeat, and every word
that a repeat covers goes. Windows are judged on the input.

Levels of 5, 10, 20 words (for a window of 20): only what repeats at one length is extended
to twice that length.

* At a level below the window, each candidate window is represented by the smallest hash
  among its sub-windows of that length. The choice depends on the window's words alone, so
  two equal windows choose alike: if the chosen sub-window is unique in the corpus, so is the
  window, and it goes no further. Neighbouring windows share a choice, so few rows are
  shuffled (about one in nine words at the first level).
* At the window's own length, candidates that share a choice form a block, and whole blocks
  are compared first: a later copy of a block is removed as one row. Windows of first and
  unique blocks are then compared one by one. An earliest occurrence always lies in such a
  block, so nothing is missed.

Each comparison is a count by hash (partial in the map tasks) and an equi-join that adaptive
execution can split, so a passage in a third of all documents meets in no single task. Levels
are written to the shared folder; text is joined by id, never collected.

Edge cases: null text has no words. Rows whose id is null are kept whole and not compared.
Rows that share an id count as one document stored twice: each gets the same result, and where
their texts differ, the least text counts. An empty
table gives an empty result. Only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluiceway.llm import words as W
from sluiceway.llm.shared import Scratch, one_text, slices

_U = np.uint64
_MOST = _U(0xFFFFFFFFFFFFFFFF)


def level_lengths(window: int, first: int) -> list[int]:
    """Lengths from about ``first`` up to the window, each at most twice the one before."""
    out = [window]
    while out[0] > max(first, 1):
        out.insert(0, (out[0] + 1) // 2)
    return out


def _slide(best, x: np.ndarray, width: int) -> np.ndarray:
    """best (minimum or maximum) over each x[i : i + width]."""
    have = 1
    while have < width and len(x):
        step = min(have, width - have)
        x = best(x[: max(0, len(x) - step)], x[step:])
        have += step
    return x


class _Slice:
    """Word hashes of some documents, and which window starts lie inside a document."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.batch, self.window = batch, window
        self.words = W.split(batch["text"])
        self.first = self.words.first
        self.n = np.diff(self.first)
        h = W.hashes(self.words)
        self.h = {1: np.maximum(h, _U(1))}
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        starts = max(0, len(h) - window + 1)
        self.inside = np.arange(starts) + window <= self.first[1:][self.doc[:starts]]

    def hashes(self, length: int) -> np.ndarray:
        if length not in self.h:
            self.h[length] = np.maximum(W.windows(self.h[1], length), _U(1))
        return self.h[length]

    def chosen(self, length: int) -> np.ndarray:
        return _slide(np.minimum, self.hashes(length), self.window - length + 1)

    def anchors(self, length: int, candidate: np.ndarray) -> np.ndarray:
        """Positions of the sub-windows that candidate windows choose."""
        if not candidate.any():
            return np.zeros(0, np.int64)
        spare = self.window - length
        top = np.pad(np.where(candidate, self.chosen(length), _U(0)), spare)
        return np.flatnonzero(_slide(np.maximum, top, spare + 1) == self.hashes(length))

    def candidates(self, length: int, lists: pa.ListArray) -> np.ndarray:
        """Windows whose chosen sub-window survived; lists: surviving positions by document."""
        h, at = self.hashes(length), self._places(lists)
        live = np.full(len(h), _MOST)
        live[at] = h[at]
        return self.inside & (_slide(np.minimum, live, self.window - length + 1) == self.chosen(length))

    def _places(self, lists: pa.ListArray) -> np.ndarray:
        return np.asarray(lists.flatten(), dtype=np.int64) + np.repeat(self.first[:-1], _lengths(lists))

    def runs(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of (start, len) runs, flat over the documents."""
        flat = lists.flatten()
        return np.asarray(flat.field("start"), dtype=np.int64) + np.repeat(self.first[:-1], _lengths(lists)), np.asarray(flat.field("len"), dtype=np.int64)

    def rows(self, at: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        ids = self.batch["doc_id"].take(pa.array(self.doc[at]))
        start = (at - self.first[:-1][self.doc[at]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64) if c.dtype == _U else c) for c in columns.values()), ids, pa.array(start)], [*columns, "doc_id", "start"])


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places start[i] .. start[i] + length[i] - 1."""
    total = np.cumsum(length)
    return np.repeat(start - total + length, length) + np.arange(total[-1] if len(total) else 0)


def _anchor_rows(window: int, length: int, below: int | None):
    """Map function: chosen sub-windows of ``length``; below: the level whose survivors come
    in column ``at`` (None: all windows are candidates)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = _Slice(batch, window)
            at = s.anchors(length, s.inside if below is None else s.candidates(below, batch["at"]))
            yield s.rows(at, a=s.hashes(length)[at])

    return rows


def _block_rows(window: int, below: int | None, grouping: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = _Slice(batch, window)
            live = np.flatnonzero(s.inside if below is None else s.candidates(below, batch["at"]))
            if not len(live):
                continue
            choice = s.chosen(grouping)[live]
            new = np.r_[True, (np.diff(live) != 1) | (choice[1:] != choice[:-1]) | (s.doc[live[1:]] != s.doc[live[:-1]])]
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, len(live)])
            up, down = W._grown(len(live) + 1)
            keys = {}
            for name, salt in (("a", 0), ("b", 977)):
                h = (s.hashes(window) if not salt else W.windows(s.h[1], window, salt))[live]
                total = np.zeros(len(live) + 1, _U)
                np.cumsum(h * up[: len(live)], dtype=_U, out=total[1:])
                keys[name] = W.mix64((total[begin + size] - total[begin]) * down[begin] + size.astype(_U))
            yield s.rows(live[begin], **keys, len=size.astype(np.int32))

    return rows


def _window_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = _Slice(batch, window)
            at = _spread(*s.runs(batch["at"]))
            if len(at):
                yield s.rows(at, a=s.hashes(window)[at], b=W.windows(s.h[1], window, 977)[at])

    return rows


def _kept(window: int, carried: set[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = W.split(batch["text"])
            n = np.diff(words.first)
            lists = batch["gone"]
            flat = lists.flatten()
            begin = np.asarray(flat.field("start"), dtype=np.int64) + np.repeat(words.first[:-1], _lengths(lists))
            edge = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + np.asarray(flat.field("len"), dtype=np.int64) + window - 1, -1)
            keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            doc = np.repeat(np.arange(len(n)), n)[keep]
            size = words.end[keep] - words.start[keep] + 1
            last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) if len(keep) else keep
            size[last] -= 1
            data = np.append(words.buf, np.uint8(32))[_spread(words.start[keep], size)]
            gap = np.cumsum(size) - 1
            gap = np.delete(gap, last)
            data[gap] = 32
            offsets = np.zeros(len(n) + 1, np.int32)
            np.add.at(offsets, doc + 1, size)
            text = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(np.cumsum(offsets, dtype=np.int32)), pa.py_buffer(data)])
            left = np.bincount(doc, minlength=len(n))
            found = {"n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array((n - left).astype(np.int64)), "kept_text": text}
            columns = {c: batch[c] for c in batch.schema.names if c in carried} | found
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows


def _repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once, with the first place. ``part`` repeats a piece of
    the key so that the join gets an exchange of its own, which adaptive execution splits."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    again = counted.filter("n > 1").select(*keys, "first", F.shiftright(keys[0], 57).alias("part"))
    return rows.withColumn("part", F.shiftright(keys[0], 57)).join(again, [*keys, "part"]).drop("part")


def substring_dedup(docs: DataFrame, *, window: int = 20, first_level: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words, one space), and
    the columns of docs named in ``carry``."""
    spark = docs.sparkSession
    kept = {c: "text" if c == text_col else f"_{i}" for i, c in enumerate(carry or [])}  # the text goes once
    own = one_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for c, k in kept.items() if k != "text")))
    known = own.filter("doc_id is not null and text is not null").select("doc_id", "text")
    lengths = level_lengths(window, first_level)
    work = Scratch(spark, "substring")
    below, at = None, None

    def with_lists(lists: DataFrame) -> DataFrame:
        return known.join(lists, "doc_id").select("doc_id", "text", "at")

    for length in lengths[:-1]:
        source = known if at is None else with_lists(at)
        rows = work.cut(source.mapInArrow(_anchor_rows(window, length, below), "a long, doc_id long, start int"), f"level{length}")
        at = work.cut(_repeats(rows, ["a"]).groupBy("doc_id").agg(F.collect_set("start").alias("at")), f"survivors{length}")
        work.drop(f"level{length}", *([f"survivors{below}"] if below else []))
        below = length
    source = known if at is None else with_lists(at)
    blocks = work.cut(source.mapInArrow(_block_rows(window, below, lengths[0]), "a long, b long, len int, doc_id long, start int"), "blocks")
    later = work.cut(_repeats(blocks, ["a", "b"]).filter("struct(doc_id, start) != first").select("doc_id", "start", "len"), "later")
    live = blocks.join(later, ["doc_id", "start"], "left_anti").groupBy("doc_id").agg(F.collect_set(F.struct("start", "len")).alias("at"))
    rows = work.cut(with_lists(live).mapInArrow(_window_rows(window), "a long, b long, doc_id long, start int"), "windows")
    work.drop("blocks", *([f"survivors{below}"] if below else []))
    single = _repeats(rows, ["a", "b"]).filter("struct(doc_id, start) != first").select("doc_id", "start", F.lit(1).alias("len"))
    gone = work.cut(later.union(single).groupBy("doc_id").agg(F.collect_set(F.struct("start", "len")).alias("gone")), "gone")
    work.drop("windows", "later")
    last = own.join(gone, "doc_id", "left")
    carried = {"doc_id", *kept.values()}
    schema = StructType([f for f in last.schema.fields if f.name in carried]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    out = last.mapInArrow(_kept(window, carried), schema)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *(F.col(k).alias(c) for c, k in kept.items()))

