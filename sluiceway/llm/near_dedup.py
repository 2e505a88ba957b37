"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct shingles of consecutive lower-cased words (A-Z only); a
document with fewer words has its whole sequence as one shingle, one without words has an
empty set and links with nothing. Two documents link when their sets' Jaccard similarity
reaches the threshold; components of linked documents share the smallest id reachable.

* Documents with equal sets fall into one class first, so copies are handled once.
* Keys: two collections of m short bands (two minhashes each) are computed, 4m minhashes in
  all, and every pair of a band of one with a band of the other is a table key: m * m tables
  from a number of minhashes that grows as their square root. m is the least for which a pair
  at the threshold is missed with a probability of at most ``miss``.
* Three bits of up to 63 of the minhashes make a sketch. Pairs whose sketches differ in more
  places than a pair at the threshold does but for a probability of 1e-6, or whose sizes alone
  rule the threshold out, are not compared.
* In turns, every class is compared with one class only: the most central one of its buckets
  that is not in its component yet (the one that shares most keys with others: copies with few
  changes share most). This joins nearly all of a group, whatever its size.
* What is then left are buckets that still hold several components, mostly copies that differ
  a little too much from all others. Their shingles are ordered by how many of these classes
  hold them, rarest first. Two sets that reach the threshold share one of their first
  n - ceil(threshold * n) + 1 shingles, and so many follow it in both as the threshold asks for,
  so only pairs across components that do are compared. A copy's own changes come first in this
  order: where they are too many, nothing is left to compare, however large the group is. No
  pair that reaches the threshold is passed over.
* A candidate is confirmed on the full sets: sorted arrays of 64-bit shingle hashes.
* Components: minimum labels with pointer jumping, written to the shared folder each round.

Edge cases: null text has no words. Rows with a null id keep a null component and are kept;
they link with nothing. Rows that share an id are one node; where their texts differ, the least
text counts. Empty tables give empty results.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm import words as W
from sluiceway.llm.shared import Scratch, one_text, slices

_U = np.uint64
BAND = 2
#: Turns go on while at least this part of the compared pairs are links.
WORTH = 0.1
#: Pairs of one class that meet in a task.
LOAD = 4096
#: Places of a sketch: 21 in each of three longs, three bits each.
PLACES = 63


def bands_for(threshold: float, miss: float) -> int:
    """Bands in each collection, so that a pair at the threshold shares a table key but for
    a probability of ``miss``."""
    half, m = threshold**BAND, 1
    while 1 - (1 - (1 - half) ** m) ** 2 > miss:
        m += 1
    return m


def allowed(threshold: float, places: int, miss: float = 1e-6) -> int:
    """Differing places of a sketch that a pair at the threshold exceeds with probability miss."""
    p = (1 - threshold) * 7 / 8
    tail, most = 1.0, -1
    while tail > miss:
        most += 1
        tail -= comb(places, most) * p**most * (1 - p) ** (places - most)
    return most


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, end to end, and where each begins."""
    words = W.split(texts)
    h = W.hashes(words, lower=True)
    n = np.diff(words.first)
    doc = np.repeat(np.arange(len(n)), n)
    whole = W.windows(h, size)
    starts = np.arange(len(whole))
    inside = starts + size <= words.first[1:][doc[: len(whole)]] if len(whole) else np.zeros(0, bool)
    value, owner = whole[inside], doc[: len(whole)][inside]
    for d in np.flatnonzero((n > 0) & (n < size)):
        piece = h[words.first[d] : words.first[d + 1]]
        value, owner = np.append(value, W.windows(piece, len(piece), 1 << 20)), np.append(owner, d)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def _signatures(size: int, bands: int):
    """Map function: id, set size, a 128-bit hash of the set and the table keys."""
    seeds = W.mix64(np.arange(1, 2 * bands * BAND + 1, dtype=_U) * _U(0x2545F4914F6CDD1D))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, first = shingle_sets(batch["text"], size)
            n = np.diff(first)
            full = np.flatnonzero(n)
            at = first[:-1][full]
            low = np.zeros((len(seeds), len(full)), _U)
            sums = _sums(value, at) if len(full) else [np.zeros(0, np.int64)] * 2
            if len(full):
                for i, seed in enumerate(seeds):
                    x = value ^ seed
                    x *= _U(0xBF58476D1CE4E5B9)
                    x ^= x >> _U(32)
                    low[i] = np.minimum.reduceat(x, at)
            half = [reduce(lambda a, b: W.pair(a, b), (low[i * BAND + j] for j in range(BAND))) for i in range(2 * bands)]
            keys = np.stack([W.pair(half[i], half[bands + j], i * bands + j) for i in range(bands) for j in range(bands)], axis=1)
            ids = batch["doc_id"].take(pa.array(full))
            bits = low[:PLACES] & _U(7)
            sketch = [np.bitwise_or.reduce([bits[i] << _U(3 * k) for k, i in enumerate(range(w, min(w + 21, len(bits))))], axis=0).view(np.int64) if w < len(bits) else np.zeros(len(full), np.int64) for w in (0, 21, 42)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands * bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[full].astype(np.int64)), *map(pa.array, sums), *map(pa.array, sketch), lists], ["doc_id", "n_shingles", "s1", "s2", "k0", "k1", "k2", "keys"])

    return rows


def _sums(value: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """128-bit hashes of sets that begin at ``at`` (none is empty), as two columns."""
    return [np.add.reduceat(W.mix64(value + _U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), at).view(np.int64) for i in range(2)]


def _sets(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, first = shingle_sets(batch["text"], size)
            full = np.flatnonzero(np.diff(first))
            if not len(full):
                continue
            packed = [value[first[i] : first[i + 1]].tobytes() for i in full]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(full)), pa.array(packed, pa.binary())], ["id", "shingles"])

    return rows


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and s: one row for each shingle of a set."""
    for batch in slices(batches, "shingles"):
        values = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["shingles"]]
        ids = np.repeat(np.asarray(batch["id"], dtype=np.int64), [len(v) for v in values])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(values))], ["id", "s"])


def _confirmed(share: int):
    """Map function: pairs with 100 * intersection >= share * union."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set_a"):
            yes = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch["set_a"], batch["set_b"], strict=True)):
                a, b = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                yes[i] = 100 * common >= share * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(yes))

    return rows


def components(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """node, label: the smallest node reachable over the edges (a, b). Each round a node takes
    the least label among its own and its neighbours', then follows labels of labels."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = work.cut(both.distinct(), f"{name}-edges")
    labels = work.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "seen"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jumped"))
        turn += 1
        after = work.cut(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("jumped", "low")).alias("label"), (F.least("low", F.coalesce("jumped", "low")) != F.col("label")).alias("moved")), f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
        if after.filter("moved").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def near_dedup(docs: DataFrame, *, shingle: int = 5, share: int = 80, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. share: the similarity in
    hundredths."""
    spark = docs.sparkSession
    own = one_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    work = Scratch(spark, "near")
    m = bands_for(share / 100, miss)
    signed = work.cut(own.filter("doc_id is not null and text is not null").mapInArrow(_signatures(shingle, m), "doc_id long, n_shingles long, s1 long, s2 long, k0 long, k1 long, k2 long, keys array<long>"), "signed")
    single = signed.select("doc_id", "n_shingles", "s1", "s2").distinct()
    classes = single.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("class"))
    # one more join column than the grouping gives a join an exchange of its own, which adaptive execution splits
    part = F.shiftright("s1", 57).alias("part")
    member = work.cut(single.select("*", part).join(classes.select("*", part), ["n_shingles", "s1", "s2", "part"]).select("doc_id", "n_shingles", "s1", "s2", "class"), "member")
    # rows of one id are equal by now, so it doesn't matter which of them stays
    one = signed.join(member.filter("doc_id = class").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "id")
    spread = one.select("id", F.explode("keys").alias("key"))
    counted = spread.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("key", "many", F.shiftright("key", 57).alias("part"))
    shared = work.cut(spread.withColumn("part", F.shiftright("key", 57)).join(counted, ["key", "part"]).select("key", "id", "many"), "shared")
    central = shared.groupBy("id").agg((-F.sum("many")).alias("far")).join(one.select("id", F.col("n_shingles").alias("n"), "k0", "k1", "k2"), "id")
    bucket = work.cut(shared.select("key", "id").join(central, "id"), "bucket")
    work.drop("signed", "shared")
    texts = own.dropna().join(bucket.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = work.cut(texts.mapInArrow(_sets(shingle), "id long, shingles binary").dropDuplicates(["id"]), "sets")
    most = allowed(share / 100, min(PLACES, 2 * m * BAND))

    def alike(a: str, b: str) -> Column:
        """May two rows reach the threshold, by size and sketch?"""
        x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
        differ = [F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}")) for k in ("k0", "k1", "k2")]
        places = [F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0o111111111111111111111))) for d in differ]
        return (100 * F.least(x, y) >= share * F.greatest(x, y)) & (sum(places[1:], places[0]) <= most)

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        # a central class may be in any number of pairs: its set goes to so many tasks that none has more than LOAD
        loads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LOAD).cast("int").alias("tasks"))
        salted = pairs.join(loads, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("salt"))
        with_b = salted.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
        spread_a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")).join(loads, "a").select("a", "set_a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"))
        full = with_b.join(spread_a, ["a", "salt"])
        return work.cut(full.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(share), "a long, b long"), f"{name}-links")

    row = F.struct("far", "id", "n", "k0", "k1", "k2", "label")

    def mixed(label: DataFrame, name: str) -> DataFrame:
        """Rows of the buckets that hold several components, with the most central row of each."""
        placed = bucket.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        some = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(row).alias("p")).filter("lo <> hi").select("key", "p", F.shiftright("key", 57).alias("part"))
        return work.cut(placed.withColumn("part", F.shiftright("key", 57)).join(some, ["key", "part"]).select(row.alias("r"), "p"), name)

    def prefixes(nodes: DataFrame) -> DataFrame:
        """s, at and r of each class' first shingles, the rarest among the classes first."""
        held = sets.join(nodes.select("id"), "id", "left_semi").mapInArrow(_elements, "id long, s long")
        often = held.groupBy("s").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").select("s", "f", F.shiftright("s", 57).alias("part"))
        several = held.withColumn("part", F.shiftright("s", 57)).join(often, ["s", "part"]).select("id", "s", "f")
        # shingles that one class alone holds come first and match nothing: they only take up places
        by_rarity = Window.partitionBy("id").orderBy("f", "s")
        ranked = several.select("*", F.row_number().over(by_rarity).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("id")).alias("total"))
        at = F.col("r.n") - F.col("total") + F.col("rank") - 1
        placed = ranked.join(nodes, "id").select("s", at.alias("at"), "r")
        return placed.filter(100 * (F.col("r.n") - F.col("at")) >= share * F.col("r.n"))

    empty = spark.createDataFrame([], "a long, b long")
    label, links, tested = spark.createDataFrame([], "node long, label long"), empty, empty
    turn, found = 0, True
    while found:
        rows = mixed(label, f"mixed{turn}")
        near = rows.filter((F.col("r.label") != F.col("p.label")) & alike("r", "p")).select(F.col("p.far").alias("far"), F.col("p.id").alias("a"), F.col("r.id").alias("b"))
        fresh = near.join(tested, ["a", "b"], "left_anti").groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a")).select("a", "b")
        pairs = work.cut(fresh, f"pairs{turn}")
        work.drop(f"mixed{turn}")
        compared = pairs.count()
        if not compared:
            break
        new = confirm(pairs, f"turn{turn}")
        found = new.count() >= WORTH * compared
        tested, links = tested.union(pairs), links.union(new)
        label = components(links, work, f"labels{turn}")
        turn += 1
    nodes = work.cut(mixed(label, "mixed").select("r.id", "r").distinct(), "nodes")
    work.drop("mixed", "bucket")
    if not nodes.isEmpty():
        first = work.cut(prefixes(nodes), "prefixes")
        # all rows of a shingle's largest component need not meet each other
        sizes = first.groupBy("s", "r.label").agg(F.count(F.lit(1)).alias("n"))
        some = sizes.groupBy("s").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label"))["label"].alias("top")).filter("labels > 1").select("s", "top", F.shiftright("s", 57).alias("part"))
        live = first.withColumn("part", F.shiftright("s", 57)).join(some, ["s", "part"])
        x, y = live.filter("r.label <> top").select("s", F.col("at").alias("at_x"), F.col("r").alias("x")), live.select("s", F.col("at").alias("at_y"), F.col("r").alias("y"), "top")
        reach = F.least(F.col("x.n") - F.col("at_x"), F.col("y.n") - F.col("at_y")) * (100 + share) >= share * (F.col("x.n") + F.col("y.n"))
        across = x.join(y, "s").filter((F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("top")) | (F.col("x.id") < F.col("y.id"))) & reach & alike("x", "y"))
        pairs = across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = work.cut(pairs.join(done, ["a", "b"], "left_anti"), "across")
        work.drop("nodes", "prefixes")
        if not pairs.isEmpty():
            label = components(links.union(confirm(pairs, "across")), work, "labels")
    placed = member.join(label.withColumnsRenamed({"node": "class"}), "class", "left").select("doc_id", "n_shingles", F.coalesce("label", "class").alias("component_id"))
    out = own.select("doc_id").join(placed, "doc_id", "left")
    whole = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))
