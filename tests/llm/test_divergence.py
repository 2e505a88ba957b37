"""Divergence of sources: against brute force, and its parts alone."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sluiceway.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, value int, term string, v int"


def brute(rows, min_docs, scale, top):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(LOWER)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        has = Counter(t for d in own for t in d[2])
        terms = sorted((t for t, n in has.items() if n >= min_docs), key=str.encode)
        of = {s: Counter() for s in {d[1] for d in own}}
        for _, s, c in own:
            of[s] += Counter({t: c[t] for t in terms if t in c})
        share = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(terms)) for t in terms}
        p, q = {s: share(c) for s, c in of.items()}, share(sum(of.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in of:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in terms), o.encode()) for o in of if o != s)
            used = sorted((-f(p[s][t], q[t]), t.encode()) for t in terms if of[s][t] and p[s][t] > q[t])
            for part, ranked in (("pair", pairs), ("term", used[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def corpus():
    rng = random.Random(9)
    vocab = ["The", "the", "ción", "中文", "na me", "x1y", "A-B", "Été"] + ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(70)]
    rows = []
    for i in range(120):
        source = rng.choice(["hot"] * 4 + ["b", "c", None, "", "é", "d"])
        rows.append((" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "only_null"), ("", "fr", "alone"), ("rare words here", "it", "x"), ("other things", "it", "y"), ("!!! 123", "en", "none"), ("same " * 3000, "en", "hot"), ("q" * 5000, "de", "b")]
    return rows + rows[:10]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, 1, "clash", 1, "x", 2) for i, (t, lang, s) in enumerate(corpus())], SCHEMA).repartition(5)


@pytest.mark.parametrize(("min_docs", "top", "width"), [(3, 200, 8192), (1, 5, 8), (2, 3, 1), (1000, 9, 8)])
def test_against_brute_force(docs, min_docs, top, width):
    got = divergence.source_divergence(docs, min_docs=min_docs, top=top, width=width)
    assert sorted(map(tuple, got.collect())) == brute(corpus(), min_docs, 10**9, top)


def test_without_rows(docs):
    assert divergence.source_divergence(docs.limit(0)).isEmpty()


def test_flushes_and_long_texts(monkeypatch, docs):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Aa bé c-D ".encode() * 50 + b"x" * 30
    assert divergence.terms_of(text) == {b"aa": 50, "bé".encode(): 50, b"c": 50, b"d": 50, b"x" * 30: 1}
    got = divergence.source_divergence(docs, min_docs=2, top=3)
    assert sorted(map(tuple, got.collect())) == brute(corpus(), 2, 10**9, 3)


def test_gallop():
    rng = np.random.default_rng(4)
    for m, n in [(0, 0), (0, 5), (1, 1), (3, 2000), (100, 100), (700, 5000), (64, 65)]:
        a, b = (np.sort(rng.choice(8000, x, replace=False)) for x in (m, n))
        i, j = divergence.gallop(a, b)
        assert (a[i] == b[j]).all() and a[i].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_shares_are_exact():
    counts = np.array([0, 1, 999, 10**12, 9 * 10**14])
    for whole in (10**15, 9 * 10**14 + 1, 2**53 - 1):
        assert divergence.share(counts, whole, 10**9).tolist() == [1 + 10**9 * (c + 1) // whole for c in counts.tolist()]


def test_columns_and_arrays_agree(spark):
    from pyspark.sql import functions as F

    rows = [(c, w) for c in (0, 7, 10**10, 9 * 10**14) for w in (9 * 10**14 + 5, 10**15)]
    got = spark.createDataFrame(rows, "c long, w long").select(divergence._share(F.col("c"), F.col("w"), 10**9)).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 1) // w for c, w in rows]
