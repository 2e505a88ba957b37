"""Exact top-k search by integer inner product: the three-phase uniform threshold algorithm.

Components are taken as floor(scale * x). The dimensions are cut into ``lists`` parts; in each part
every vector has a partial score for a query, and a score is the sum of its partial scores.

1. Gather: each part's blocks of vectors give every query the best entries of their local score
   list; the best ``gather`` of a part go on, and their whole scores are worked out. The k-th best
   of these is a score that the k best vectors reach at least.
2. Cutoff: whoever reaches a score t has a partial score of t / lists or more in one part, whatever
   the signs are. This cutoff goes out with the blocks of queries, and each part sends all entries
   that reach it. Their sums give bounds: a part that sent none has less than the cutoff.
3. Resolve: entries whose upper bound reaches the k-th best known score get what is missing.

Vectors are dealt into blocks of about ``block`` by a hash of their id, the stated queries into
blocks of ``query_block``, and all blocks of a part meet, as the search is exact; entries, cutoffs
and bounds are tables. Equal vectors are one entry and are expanded at the end, with as many of the
smallest ids as can be asked for.

Edge cases: null vectors, those with null or non-finite components and rows with a null id take no
part; zero and empty vectors do. Shorter vectors count as if filled up with zeros. Of rows that
share an id the least vector counts. Scores must fit a long: a vector with a component of
sqrt(2^62 / dimensions) or more after scaling takes no part. With fewer candidates than asked, all
are returned. Ties go to the smaller id. Only the id and vector columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.shared import Scratch

#: Vectors of a block that are scored at once.
STRIP = 2048
_CELL = ["g", "b", "qb"]
_ENTRIES = "q long, g int, id long, part long"


def packed(values: np.ndarray) -> bytes:
    """Rows of integers in the narrowest type that holds them, which the first byte names."""
    top = int(np.abs(values).max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[data[0]]
    return np.frombuffer(data, kind, offset=1).reshape(n, -1)


def partial_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: in doubles where these hold all sums."""
    exact = int(np.abs(q.astype(np.int64)).max(initial=0)) * int(np.abs(v.astype(np.int64)).max(initial=0)) * max(1, q.shape[1]) < 1 << 53
    kind = np.float64 if exact else np.int64
    return (q.astype(kind) @ v.astype(kind).T).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of the k largest in each row of scores (ties to the smaller id)."""
    rows, found, parts = [], [], []
    for i, s in enumerate(scores):
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            among = np.flatnonzero(s >= least)
        else:
            among = np.arange(len(s))
        top = among[np.lexsort((ids[among], -s[among]))][:k]
        rows.append(np.full(len(top), i))
        found.append(ids[top])
        parts.append(s[top])
    return tuple(np.concatenate(x) for x in (rows, found, parts))


def _cell(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids and values, vector ids and values of one cell."""
    q, v = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    return q, unpacked(row["q_values"], len(q)), v, unpacked(row["values"], len(v))


def _frame(q: np.ndarray, g: int, ids: np.ndarray, part: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"q": q, "g": np.full(len(q), g, np.int32), "id": ids, "part": part})


def top_k(vectors: DataFrame, *, k: int = 5, query_every: int = 50, scale: int = 256, lists: int = 2, gather: int = 32, local: int = 16, block: int = 8192, query_block: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_every``, the k
    others of the largest inner product."""
    spark = vectors.sparkSession
    work = Scratch(spark, "topk")
    local = max(local, k + 1)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    dims = own.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, dims)
    bound = math.isqrt(2**62 // dims) / scale
    fine = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound)))
    whole = fine.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))
    slim = work.cut(whole.select("vec_id", filled.alias("v")).withColumn("key", F.unhex(F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))), "slim")
    classes = work.cut(slim.groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v")), "classes")
    asking = slim.filter(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "key")
    queries = work.cut(classes.join(asking.select("key").distinct(), "key", "left_semi").select("id", "v"), "queries")
    n, n_queries = classes.count(), queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, query_blocks = -(-n // block), -(-n_queries // query_block)
    edges = [round(i * dims / lists) for i in range(lists + 1)]
    dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        ids, m = rows["id"].to_numpy(np.int64), np.stack([np.asarray(x, np.int64) for x in rows["v"]])
        return pd.DataFrame([(g, rows["b"].iloc[0], ids.tobytes(), packed(m[:, edges[g] : edges[g + 1]])) for g in range(lists)], columns=["g", "b", "ids", "values"])

    def lists_of(rows: DataFrame, parts: int) -> DataFrame:
        return rows.withColumn("b", dealt("id", parts)).groupBy("b").applyInPandas(pack, "g int, b int, ids binary, values binary")

    index = work.cut(lists_of(classes.select("id", "v"), blocks), "index")
    asked = work.cut(lists_of(queries, query_blocks).select("g", F.col("b").alias("qb"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values")), "asked")

    def met(asked: DataFrame) -> DataFrame:
        """All cells: each block of queries with each block of vectors of its part."""
        return asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(index, ["g", "b"])

    def gathered(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        q, qv, ids, v = _cell(row)
        which, found, part = (np.zeros(0, np.int64) for _ in range(3))
        for at in range(0, len(ids), STRIP):
            new = best(ids[at : at + STRIP], partial_scores(qv, v[at : at + STRIP]), local)
            which, found, part = (np.concatenate(x) for x in zip((which, found, part), new, strict=True))
        order = np.lexsort((found, -part, which))
        place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        order = order[place < local]
        return _frame(q[which[order]], row["g"], found[order], part[order])

    def sent(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        q, qv, ids, v = _cell(row)
        cut = pd.Series(row["cuts"], index=row["cut_ids"]).reindex(q).to_numpy(np.int64)[:, None]
        out = []
        for at in range(0, len(ids), STRIP):
            part = partial_scores(qv, v[at : at + STRIP])
            which, place = np.nonzero(part >= cut)
            out.append(_frame(q[which], row["g"], ids[at + place], part[which, place]))
        return pd.concat(out)

    def looked_up(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        q, qv, ids, v = _cell(row)
        wanted, found = np.asarray(row["w_q"], np.int64), np.asarray(row["w_id"], np.int64)
        by_q, by_id = np.argsort(q), np.argsort(ids)
        i, j = by_q[np.searchsorted(q[by_q], wanted)], by_id[np.searchsorted(ids[by_id], found)]
        out = [(qv[i[at : at + STRIP]].astype(np.int64) * v[j[at : at + STRIP]].astype(np.int64)).sum(1) for at in range(0, len(i), STRIP)]
        return _frame(wanted, row["g"], found, np.concatenate(out))

    def resolved(pairs: DataFrame) -> DataFrame:
        """Partial scores of (q, id, g)."""
        cells = pairs.groupBy("g", dealt("id", blocks).alias("b"), dealt("q", query_blocks).alias("qb")).agg(F.collect_list(F.struct("q", "id")).alias("w"))
        cells = cells.select(*_CELL, F.col("w.q").alias("w_q"), F.col("w.id").alias("w_id"))
        return cells.join(asked, ["g", "qb"]).join(index, ["g", "b"]).groupBy(*_CELL).applyInPandas(looked_up, _ENTRIES)

    parts = F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("g")
    of_list = Window.partitionBy("q", "g").orderBy(F.desc("part"), "id")
    firsts = met(asked).groupBy(*_CELL).applyInPandas(gathered, _ENTRIES).withColumn("r", F.row_number().over(of_list)).filter(F.col("r") <= gather)
    known = work.cut(resolved(firsts.select("q", "id").distinct().select("q", "id", parts)).groupBy("q", "id").agg(F.sum("part").alias("score")), "known")
    # k + 1 vectors hold k others besides the query's own
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    lowest = lambda scores: scores.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k + 1).groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    # fewer than that many exist only where the lists hold all vectors
    cutoff = work.cut(lowest(known).select("q", F.when(F.col("n") > k, F.col("least")).alias("least")), "cutoff")
    share = F.when(F.col("least").isNull(), -(2**62)).otherwise(F.call_function("div", F.col("least") + F.pmod(-F.col("least"), F.lit(lists)), F.lit(lists)))
    cuts = cutoff.groupBy(dealt("q", query_blocks).alias("qb")).agg(F.collect_list(F.struct("q", share.alias("cut"))).alias("c")).select("qb", F.col("c.q").alias("cut_ids"), F.col("c.cut").alias("cuts"))
    entries = met(asked.join(cuts, "qb")).groupBy(*_CELL).applyInPandas(sent, _ENTRIES)
    sums = work.cut(entries.groupBy("q", "id").agg(F.sum("part").alias("sum"), F.collect_set("g").alias("gs")), "sums")
    complete = sums.filter(F.size("gs") == lists).select("q", "id", F.col("sum").alias("score"))
    reached = lowest(complete).filter(F.col("n") > k).select("q", F.col("least").alias("better"))
    # a part that sent nothing has less than the cutoff: at most its predecessor
    most = F.col("sum") + (F.lit(lists) - F.size("gs")) * (share - 1)
    open_ = sums.filter(F.size("gs") < lists).join(cutoff, "q").join(reached, "q", "left").filter(most >= F.greatest("least", F.coalesce("better", "least"))).select("q", "id", "sum", "gs")
    missing = resolved(open_.select("q", "id", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(lists - 1)), "gs")).alias("g"))).groupBy("q", "id").agg(F.sum("part").alias("rest"))
    scored = complete.union(open_.join(missing, ["q", "id"]).select("q", "id", F.col("sum") + F.col("rest")))
    kept = work.cut(scored.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k + 1).drop("r"), "kept")

    found = kept.join(classes.select("id", "copies", "key"), "id")
    many = found.filter("copies > 1").select("key").distinct()
    small = Window.partitionBy("key").orderBy("vec_id")
    ids = slim.select("key", "vec_id").join(many, "key", "left_semi").withColumn("r", F.row_number().over(small)).filter(F.col("r") <= k + 1).select("key", "vec_id")
    rows = found.filter("copies = 1").select("q", F.col("id").alias("vec_id"), "score").union(found.filter("copies > 1").join(ids, "key").select("q", "vec_id", "score"))
    few = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    short = rows.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1).drop("r").join(classes.select(F.col("id").alias("q"), "key"), "q").drop("q")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asking.join(short, "key").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
