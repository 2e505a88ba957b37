"""Exact search: against brute force on signs, ties, copies and large numbers."""

import math
import random

import numpy as np
import pytest

from sluiceway.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score long, key string"


def brute(rows, k, every, scale, least_of_ids=True):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own[i] = min(own.get(i, v), v)
    ints = {i: [math.floor(scale * x) for x in v] for i, v in own.items()}
    out = []
    for q, u in ints.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), i) for i, v in ints.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "clash") for i, v in rows], SCHEMA).repartition(3)


def vectors(seed, n=400, d=9):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(d)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)] + [(2000 + i, [0.0] * d) for i in range(9)] + [(3000 + i, [-x for x in rows[0][1]]) for i in range(9)]
    return rows


@pytest.mark.parametrize(("lists", "block", "query_block"), [(2, 8192, 256), (1, 50, 4), (3, 37, 5), (9, 100, 7)])
def test_against_brute_force(spark, lists, block, query_block):
    rows = vectors(lists)
    rows += [(5000, None), (5050, []), (5100, [1.0, 2.0]), (5150, [None] * 9), (5200, [float("nan")] * 9), (5250, [float("inf")] + [0.0] * 8), (None, [1.0] * 9), (10, rows[3][1]), (50, rows[3][1]), (-50, [0.5] * 9), (-7, [0.5] * 9)]
    got = topk.top_k(frame(spark, rows), k=5, query_every=50, lists=lists, block=block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 50, 256)


def test_second_phase_prunes_and_third_resolves(spark):
    """Good vectors that are best in no list of their own: the first list's are bad in the second one."""
    rng = random.Random(1)
    rows = [(0, [1.0, 1.0])] + [(i, [5.0 - i / 100, -9.0]) for i in range(1, 80)] + [(i, [-9.0, 5.0 - i / 100]) for i in range(81, 160)]
    rows += [(1000 + i, [2.0 + rng.random(), 2.0 + rng.random()]) for i in range(40)]
    got = topk.top_k(frame(spark, rows), k=5, query_every=997, gather=6, local=6, block=30)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 997, 256)


def test_few_rows(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-1.0])]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows), k=5, query_every=50).collect())) == brute(rows, 5, 50, 256)
    assert topk.top_k(frame(spark, rows[:1])).isEmpty() and topk.top_k(frame(spark, rows[1:])).isEmpty() and topk.top_k(frame(spark, [])).isEmpty()
    assert topk.top_k(frame(spark, [(0, None)])).isEmpty()


def test_numbers_beyond_doubles(spark):
    """Sums past 2^53 are exact; vectors whose scores could pass a long take no part."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 3e6 for _ in range(4)]) for i in range(120)]
    want = brute(rows, 5, 50, 256)
    assert max(abs(r[3]) for r in want) > 2**53
    got = topk.top_k(frame(spark, [*rows, (500, [1e300] * 4), (501, [-1e12] * 4)]), k=5)
    assert sorted(map(tuple, got.collect())) == want


def test_packed_integers():
    for top in (5, 2**15, 2**31, 2**40):
        m = np.array([[top, -top], [0, 3]])
        assert (topk.unpacked(topk.packed(m), 2) == m).all()
    q, v = np.array([[2**30, -1]]), np.array([[2**30, 1], [1, 2]])
    assert topk.partial_scores(q, v).tolist() == [[2**60 - 1, 2**30 - 2]]
