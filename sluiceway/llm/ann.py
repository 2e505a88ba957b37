"""Nearest neighbours by inner product with a permutation index.

Pivots are vectors of a bounded sample, chosen at random. A vector is represented by
its ``depth`` nearest pivots in order, and is posted in the inverted file of each. A query
reads the files of its own nearest pivots; a vector's footrule distance is the sum over these
pivots of how far its places differ, a missing one counting as ``depth``. The best candidates
by footrule are reranked by the inner product in double precision.

Vectors are scaled to unit length for the index alone, with one more coordinate that carries
what the longest vector has more (none for a query), so that near in angle means large in
inner product.

Vectors are dealt into blocks of about ``block`` by a hash of their id, and every block holds
its own inverted files; the stated queries, in blocks too, meet all of them. In each block the
best ``share`` of the vectors by footrule are reranked, and the block's k best go on. Equal
vectors are one entry: they are expanded after the search, with as many of the smallest ids as
can be asked for, so thousands of copies of one vector don't crowd a file.

Edge cases: null and zero vectors, and those with null or non-finite components, take no part,
neither do rows with a null id. Of rows that share an id the least vector counts. With fewer candidates than asked, all are returned;
empty tables give no rows. Vectors of
another length than the most common one take no part. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.shared import Scratch


def choose_pivots(sample: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """n of the sample's unit vectors, at random."""
    return sample[np.sort(np.random.default_rng(seed).permutation(len(sample))[:n])]


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 1))


def _orders(unit: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    near = unit @ pivots.T
    depth = min(depth, near.shape[1])
    part = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)


def search(v: dict[str, np.ndarray], q: dict[str, np.ndarray], depth: int, share: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, vector places and scores of the k best in one block for each query."""
    n = len(v["order"])
    flat = v["order"].ravel()
    by_pivot = np.argsort(flat, kind="stable")
    begins = np.searchsorted(flat[by_pivot], np.arange(int(max(flat.max(), q["order"].max())) + 2))
    owner, place = by_pivot // depth, (by_pivot % depth).astype(np.int32)
    keep = min(n, max(k, int(np.ceil(share * n))))
    out = []
    for i, pivots in enumerate(q["order"]):
        size = begins[pivots + 1] - begins[pivots]
        step = np.repeat(begins[pivots] - np.cumsum(size) + size, size) + np.arange(size.sum())
        gain = np.bincount(owner[step], depth - np.abs(place[step] - np.repeat(np.arange(depth), size)), minlength=n)
        best = np.argpartition(-gain, keep - 1)[:keep]
        score = v["vector"][best] @ q["vector"][i]
        top = np.lexsort((v["id"][best], -score))[:k]
        out.append((np.full(len(top), i), best[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(vectors: DataFrame, *, k: int = 20, query_every: int = 20, pivots: int = 512, depth: int = 64, share: float = 0.35, block: int = 8192, query_block: int = 256, sample: int = 8000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_every``, its
    k nearest others. share: part of each block that is reranked."""
    spark = vectors.sparkSession
    work = Scratch(spark, "ann")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = fine.filter(F.size("v") == sizes["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    key = F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)
    # the smallest k + 1 ids of each distinct vector: no search can return more of them
    slim = fine.select(key.alias("key"), "vec_id", "v")
    first = slim.groupBy("key").agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("copies"))
    # one more join column than the grouping gives the join an exchange of its own, which adaptive execution splits
    part = F.substring("key", 1, 2).alias("part")
    classes = work.cut(slim.select("*", part).join(first.select("*", part), ["key", "part"]).filter("vec_id = class").select("class", "v", "copies", "key"), "classes")
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    longest = float(np.sqrt(stats["top"]))
    some = _matrix(classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("v").toPandas()["v"])

    def unit(m: np.ndarray) -> np.ndarray:
        m = m / longest
        return np.hstack([m, np.sqrt(np.maximum(0, 1 - (m * m).sum(1, keepdims=True)))])

    def direction(m: np.ndarray) -> np.ndarray:
        return np.hstack([m / np.linalg.norm(m, axis=1, keepdims=True), np.zeros((len(m), 1))])

    chosen = choose_pivots(unit(some), pivots)
    deep = min(depth, len(chosen))
    sent = spark.sparkContext.broadcast(chosen)  # at most ``pivots`` vectors

    def pack(rows: pd.DataFrame, shape) -> pd.DataFrame:
        m = _matrix(rows["v"])
        order = _orders(shape(m), sent.value, deep).astype(np.int32)
        return pd.DataFrame({"b": [rows["b"].iloc[0]], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "orders": [order.tobytes()], "vectors": [m.tobytes()]})

    def packed(rows: DataFrame, blocks: int, shape) -> DataFrame:
        dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return dealt.groupBy("b").applyInPandas(lambda x: pack(x, shape), "b int, ids binary, orders binary, vectors binary")

    def parts(row: pd.Series, of: str) -> dict[str, np.ndarray]:
        ids = np.frombuffer(row[f"ids{of}"], np.int64)
        return {"id": ids, "order": np.frombuffer(row[f"orders{of}"], np.int32).reshape(len(ids), -1), "vector": np.frombuffer(row[f"vectors{of}"]).reshape(len(ids), -1)}

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        v, q = parts(rows.iloc[0], ""), parts(rows.iloc[0], "_q")
        which, found, score = search(v, q, deep, share, k + 1)
        return pd.DataFrame({"query_id": q["id"][which], "id": v["id"][found], "score": score})

    queries = fine.filter(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("id"), "v")
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = int(-(-stats["n"] // block))
    index = work.cut(packed(classes.select(F.col("class").alias("id"), "v"), blocks, unit), "index")
    asked = packed(queries, int(-(-n_queries // query_block)), direction).select(F.col("b").alias("qb"), *(F.col(c).alias(f"{c}_q") for c in ("ids", "orders", "vectors")), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    scored = work.cut(asked.join(index, "b").groupBy("b", "qb").applyInPandas(met, "query_id long, id long, score double"), "scored")
    scored = scored.join(classes.select(F.col("class").alias("id"), "copies", "key"), "id")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    # k + 1 classes hold at least k others besides the query itself
    kept = work.cut(scored.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k + 1).drop("r"), "kept")
    many = kept.filter("copies > 1").select("key").distinct()
    small = Window.partitionBy("key").orderBy("vec_id")
    ids = slim.select("key", "vec_id").join(many, "key", "left_semi").withColumn("r", F.row_number().over(small)).filter(F.col("r") <= k + 1).select("key", "vec_id")
    single = kept.filter("copies = 1").select("query_id", F.col("id").alias("vec_id"), "score")
    copied = kept.filter("copies > 1").join(ids, "key").select("query_id", "vec_id", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return single.union(copied).filter("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
