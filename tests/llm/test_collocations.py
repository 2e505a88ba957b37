"""Phrases on a prefix-free parse: against brute force, SQL and an exact round trip of the parse."""

import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sluiceway.llm import collocations
from sluiceway.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, phrase string, n long, score int, f double"
WHERE = "/root/testdata/sf0.001"


def pieces(text):
    return [w for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)) if (w := re.findall("[^\x20\x09]+", p))]


def brute(rows, least, longest, top):
    counts, whole = defaultdict(Counter), Counter()
    for text, lang in rows:
        for w in pieces(text):
            whole[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = []
        several = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in several.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        for p, a in several.items():
            if inside[p] < a:
                score, k = min((1000 * a * whole[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, whole[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    vocab = ["a", "B", "ción", "d d", "e\x1ce", "Ff", "g-g", "中"] + [f"w{i}" for i in range(20)]
    marks = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", " ; "]
    line = " ".join(rng.choice(vocab) for _ in range(30))
    texts = ["".join(rng.choice(vocab) + rng.choice(marks) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    texts += [line + "." + t for t in texts[:20]] + [line] * 15
    texts += [None, "", " \t\n", "a", "a b", "same same " * 300, "x " * 5000, "b" * 5000, "...,,,", "a." * 50, "end a b c d"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], "s", 1, "clash", 1, 2, 0.5) for i, t in enumerate(corpus())]
    rows += [rows[0], (None, "a B a b a b", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize(("least", "longest", "top", "modulus", "bound"), [(3, 5, 2000, 4, 64), (5, 5, 7, 1, 4096), (3, 3, 50, 32, 4096), (100, 5, 10, 32, 100), (4, 2, 20, 8, 64)])
def test_against_brute_force(docs, least, longest, top, modulus, bound):
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = collocations.collocations(docs, least=least, longest=longest, top=top, modulus=modulus, bound=bound)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, top)


def test_without_rows(spark, docs):
    assert collocations.collocations(docs.limit(0)).isEmpty()
    assert collocations.collocations(docs.filter("text is null or text = ''")).isEmpty()


@pytest.mark.parametrize(("modulus", "bound"), [(1, 4096), (3, 4096), (8, 16), (1 << 40, 50)])
def test_parse(modulus, bound):
    """Owned words are the text's, in order; each chunk goes on for the overlap; no chunk without a
    bound begins another."""
    texts = [(t or "").encode() for t in corpus()]
    chunks, own, text = collocations.parse(texts, modulus, 4, bound)
    back = defaultdict(list)
    for (c, o, t), (d, _, u) in pairwise([*zip(chunks, own, text, strict=True), (b"", 0, -1)]):
        w = re.findall(b"[^ \n]+|\n", c)
        word = [x for x in w if x != b"\n"]
        back[t] += word[:o]
        if u == t:
            rest = [x for x in re.findall(b"[^ \n]+", d)][:4]
            assert word[o:] == rest and len(rest) <= 4
        else:
            assert len(word) == o
    want = {i: [w.encode() for p in pieces(t) for w in p] for i, t in enumerate(corpus())}
    assert {i: w for i, w in want.items() if w} == dict(back)
    if bound == 4096 and modulus == 3:
        distinct = sorted({c + b"\n" for c, t, u in zip(chunks, text, [*text[1:], -1], strict=True) if t == u})
        assert not any(b.startswith(a) for a, b in pairwise(distinct))


def test_frequent_bits_never_lose(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bits = collocations.frequent_bits(spark.createDataFrame([(int(x),) for x in h], "h long"), len(h))
    assert bits.of(h.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 2**64 - 1, 20000, dtype=np.uint64)
    assert bits.of(other).mean() < 0.1


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that brings all phrases of a length together counts are still right."""
    texts = ["a b c a b", "b c", "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "y"]), pa.array(texts), pa.array([5, 2, 2], pa.int32()), pa.array([1, 2, 3])], ["lang", "chunk", "own", "n"])
    monkeypatch.setattr(collocations, "keyed", lambda p, n: [np.full(len(p.h), k, np.uint64) for k in range(n)])
    every = collocations.Frequent(np.full(16, 255, np.uint8), 7)
    got = Counter()
    for b in collocations.phrase_counts(iter([batch]), {n: every for n in (1, 2, 3)}, 3):
        for r in b.to_pylist():
            got[r["lang"], r["phrase"]] += r["w"]
    assert got == {("x", "a"): 2, ("x", "b"): 4, ("x", "c"): 3, ("x", "a b"): 2, ("x", "b c"): 3, ("x", "c a"): 1, ("x", "a b c"): 1, ("x", "b c a"): 1, ("x", "c a b"): 1, ("y", "a"): 3, ("y", "b"): 3, ("y", "a b"): 3}


def test_scores_beyond_64_bits(spark, docs, monkeypatch):
    """Weights of chunks as they are after copies by the billion."""
    rows = [("en", "a b", 2, 4 * 10**12), ("en", "a c", 2, 10**12)]
    huge = spark.createDataFrame(rows, "lang string, chunk string, own int, n long")
    cut = collocations.Scratch.cut
    monkeypatch.setattr(collocations.Scratch, "cut", lambda self, df, name: cut(self, huge if name == "dictionary" else df, name))
    got = {r.phrase: (r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs).collect()}
    n = 10**13
    assert got == {p: (a, 5 * 10**12, a, n, 1000 * a * n // (5 * 10**12 * a)) for p, a in (("a b", 4 * 10**12), ("a c", 10**12))}


@pytest.mark.parametrize("name", ["op11_collocations", "op12_source_divergence", "op13_exact_top_k"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{WHERE}/{t}.parquet')")
    df = QUERIES[name](spark, WHERE)
    cur = con.execute(ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
