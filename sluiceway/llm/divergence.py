"""Where the sources of a language differ: smoothed term shares compared source by source.

Terms are runs of ASCII letters and of characters beyond ASCII; A-Z are lower-cased. A language
keeps the terms that at least ``min_docs`` of its documents hold. A group is a (lang, source); its
share of a term is p = 1 + floor(scale * (count + 1) / (N + V)), with N the group's count over the
V kept terms. Shares p and q diverge by floor((p - q)^2 / q).

* ``pair``: each group against every other source of its language, summed over all kept terms.
  Kept terms are dealt into slices of about ``width`` terms and numbered inside them; a group is one
  sorted (term number, count) array in each slice. One task row is an unordered pair of groups in
  a slice: a galloping intersection finds the overlap, and overlapping and one-sided terms are priced
  both ways. Terms that both lack all have one price, so they are only counted.
* ``term``: the terms that a group uses more than its language does, the ``top`` best ones.

Nothing is larger than a slice in a Python worker, whatever the size of a group or a language.
Texts are cut at separators, so a very long one is counted piece by piece.

Edge cases: null text, lang and source count as ''. Rows are documents, also those that repeat an
id. A group without kept terms has p from its empty counts; a language without kept terms gives
pairs of value 0. A source alone in its language has no pairs. Empty tables give no rows. Ties go to
the item that is smaller in UTF-8. Columns other than those three are not read. Counts may reach
2^53 in a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.shared import Scratch, slices

#: Bytes to terms: A-Z lower, other letters and bytes beyond ASCII as they are, the rest a blank.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct terms that a task holds before it passes its counts on.
HELD = 200_000
PIECE = 1 << 20
GALLOP = 64


def terms_of(text: bytes) -> Counter:
    """Terms of one text and how often it has them."""
    flat, found, at = text.translate(_TERM), Counter(), 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        found.update(flat[at:end].split())
        at = end
    return found


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs of what a task reads, a term once for each time it is full."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def given() -> pa.RecordBatch:
        rows = [(lang, source, t, n, docs[t]) for (lang, source), (times, docs) in held.items() for t, n in times.items()]
        lang, source, term, n, docs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for b in slices(batches):
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
            found = terms_of(text)
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(times)
            times.update(found)
            docs.update(found.keys())
            size += len(times)
            if size > HELD:
                yield given()
                held, size = {}, 0
    if size:
        yield given()


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two sorted arrays of distinct values: runs of the shorter one are
    looked for from where the last one ended, in steps that double until they have passed it."""
    mine, theirs, at = [], [], 0
    for begin in range(0, len(short), GALLOP):
        run = short[begin : begin + GALLOP]
        step, end = GALLOP, at
        while end < len(long) and long[end] <= run[-1]:
            end, step = min(len(long), end + step), 2 * step
        inside = long[at:end]
        where = np.searchsorted(inside, run)
        hit = np.flatnonzero(inside[np.minimum(where, len(inside) - 1)] == run) if len(inside) else where[:0]
        mine.append(begin + hit)
        theirs.append(at + where[hit])
        at += int(np.searchsorted(inside, run[-1]))
        if at >= len(long):
            break
    none = [np.zeros(0, np.int64)]
    return np.concatenate(mine or none), np.concatenate(theirs or none)


def share(count: np.ndarray, whole: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + 1) / whole), by long division to the base of 1,000: no product
    passes 64 bits while whole is below 2^53."""
    rest, out = count.astype(np.int64) + 1, np.zeros(len(count), np.int64)
    while scale > 1:
        base = min(scale, 1000)
        scale //= base
        rest = rest * base
        out = out * base + rest // whole
        rest %= whole
    return 1 + out


def prices(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) ** 2 // q).sum())


def priced_pair(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], scale: int) -> tuple[int, int, int]:
    """For two groups (sorted term numbers, counts, N + V): how many terms either has, and the value
    over these of a against b and of b against a."""
    (ids_a, n_a, all_a), (ids_b, n_b, all_b) = a, b
    if len(ids_a) <= len(ids_b):
        in_a, in_b = gallop(ids_a, ids_b)
    else:
        in_b, in_a = gallop(ids_b, ids_a)
    only_a, only_b = np.delete(n_a, in_a), np.delete(n_b, in_b)
    none_a, none_b = np.zeros(len(only_b), np.int64), np.zeros(len(only_a), np.int64)
    p = share(np.concatenate([n_a[in_a], only_a, none_a]), all_a, scale)
    q = share(np.concatenate([n_b[in_b], none_b, only_b]), all_b, scale)
    return len(p), prices(p, q), prices(q, p)


def _share(count: Column, whole: Column, scale: int) -> Column:
    """The same share as a Column: decimals, since products pass 64 bits."""
    product = (count.cast("decimal(19,0)") + 1) * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", product, whole.cast("decimal(19,0)"))


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, *, min_docs: int = 3, scale: int = 1_000_000_000, top: int = 200, width: int = 8192) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of documents (text, lang, source).
    scale: a power of 1,000."""
    work = Scratch(docs.sparkSession, "divergence")
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = own.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    known = counts.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), (F.row_number().over(term.orderBy("source")) == 1).alias("head"))
    kept = work.cut(known.filter(F.col("docs") >= min_docs).drop("docs"), "kept")

    by_lang = kept.groupBy("lang").agg(F.count_if("head").alias("v"), F.sum("n").alias("lang_total"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = work.cut(groups.na.fill(0), "groups")
    rows = kept.join(groups, ["lang", "source"])

    p = _share(F.col("n"), F.col("total") + F.col("v"), scale)
    q = _share(F.col("lang_n"), F.col("lang_total") + F.col("v"), scale)
    used = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = used.select("lang", "source", F.lit("term").alias("part"), "item", _price(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    n_slices = F.ceil(F.col("v") / F.lit(float(width))).cast("int")
    dealt = rows.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), n_slices).cast("int").alias("slice"))
    numbered = dealt.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy("term")))
    arrays = numbered.groupBy("lang", "slice", "source").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("e"))
    every = groups.filter("v > 0").select("lang", "source", "v", (F.col("total") + F.col("v")).alias("whole"), F.explode(F.sequence(F.lit(0), n_slices - 1)).alias("slice"))
    full = every.join(arrays, ["lang", "slice", "source"], "left").select("lang", "slice", "source", "v", "whole", F.coalesce(F.col("e.id"), F.array().cast("array<int>")).alias("ids"), F.coalesce(F.col("e.n"), F.array().cast("array<long>")).alias("ns"))
    sliced = work.cut(full, "sliced")

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for s in ("a", "b"):
                ids, ns = b[f"ids_{s}"], b[f"ns_{s}"]
                at = ids.offsets.to_numpy()
                ids, ns = ids.values.to_numpy(), ns.values.to_numpy()
                sides.append([(ids[i:j], ns[i:j], whole) for i, j, whole in zip(at[:-1], at[1:], b[f"whole_{s}"].to_pylist(), strict=True)])
            out = [priced_pair(x, y, scale) for x, y in zip(*sides, strict=True)]
            values = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("lang", "a", "b")), *values], ["lang", "a", "b", "seen", "ab", "ba"])

    side = lambda s: sliced.select("lang", "slice", F.col("source").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("whole", "ids", "ns")))
    met = side("a").join(side("b"), ["lang", "slice"]).filter("a < b").drop("slice")
    sums = met.mapInArrow(price, "lang string, a string, b string, seen long, ab long, ba long").groupBy("lang", "a", "b").agg(*(F.sum(c).alias(c) for c in ("seen", "ab", "ba")))
    # every unordered pair, also where a language keeps no term
    one = groups.select("lang", "source", "v", (F.col("total") + F.col("v")).alias("whole"))
    pairs = one.select("lang", F.col("source").alias("a"), "v", F.col("whole").alias("whole_a")).join(one.select("lang", F.col("source").alias("b"), F.col("whole").alias("whole_b")), "lang").filter("a < b").join(sums, ["lang", "a", "b"], "left")
    zero = lambda s: F.when(F.col("v") > 0, _share(F.lit(0), F.greatest(F.col(f"whole_{s}"), F.lit(1)), scale)).otherwise(1)
    absent = F.col("v") - F.coalesce("seen", F.lit(0))
    both = F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item"), (F.coalesce(x + y, F.lit(0)) + absent * _price(zero(x), zero(y))).alias("value")) for x, y in ("ab", "ba")))
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    valued = pairs.select("lang", F.inline(both)).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(rank))
    return valued.unionByName(terms)
