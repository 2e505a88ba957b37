"""Each operator against brute force, the library, or an exact round trip, and edge cases."""

import hashlib
import random
import re
import tempfile
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluiceway.llm import ann, bpe, decontaminate, langid, near_dedup, quality, substring_dedup, token_counts, token_store, toxicity, words
from sluiceway.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0D]+")
BYTE, CASED = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, a string, keys int, n int"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    base = [rng.choice(vocab) for _ in range(90)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:40]) + "\n" + " ".join(rng.choice(vocab) for _ in range(50)), " ".join([*base[:70], "x", *base[71:]])]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(12)]
    texts += [None, "", " \n\t ", "a", "a b", "Same Same " * 30, "w " * 3000, "A b\x1cc " * 25, "x" * 4000, "<|endoftext|> and <|startoftext|>", "Don't I'LL 12345 !!"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, ["en", None, "de"][i % 3], "s", 1, 0, "clash", 1, 2) for i, t in enumerate(corpus())]
    rows += [rows[0], (None, "no id here at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def known(docs):
    return sorted({(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None})


def test_words():
    texts = pa.array(corpus(), pa.string())
    for array in (texts, texts.slice(3, 9), texts.slice(2, 0)):
        w = words.split(array)
        got = [[bytes(w.buf[w.start[j] : w.end[j]]).decode() for j in range(w.first[i], w.first[i + 1])] for i in range(len(array))]
        assert got == [WORD.findall(t or "") for t in array.to_pylist()]


@pytest.mark.parametrize("window,first", [(20, 5), (7, 2), (3, 5)])
def test_substring_dedup(docs, empty, window, first):
    seen, want = set(), {}
    for i, t in known(docs):
        w = WORD.findall(t)
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = substring_dedup.substring_dedup(docs, window=window, first_level=first).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got if r.doc_id is not None} == want
    assert len(got) == docs.count() and substring_dedup.substring_dedup(empty).count() == 0


def test_bpe_round_trip(docs, empty):
    library = Tokenizer.from_file(BYTE)
    for r in bpe.bpe_decode(bpe.bpe_encode(docs, tokenizer=BYTE), tokenizer=BYTE).join(docs.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").collect():
        ids = library.encode(r.t or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.text == (r.t or "")
    assert bpe.bpe_decode(bpe.bpe_encode(empty, tokenizer=BYTE), tokenizer=BYTE).count() == 0


def test_transducer_on_long_pretokens():
    rng, library, spec = random.Random(3), Tokenizer.from_file(BYTE), bpe.read_spec(BYTE)
    for letters in ("ab", "etaoin", "the", " ", "é漢"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        assert np.frombuffer(bpe.encode_text(spec, text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_of_any_ids():
    rng, library, spec = random.Random(4), Tokenizer.from_file(BYTE), bpe.read_spec(BYTE)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(40)]
        assert bpe.decode_ids(spec, np.array(ids, "<u4").tobytes(), block=3) == library.decode(ids, skip_special_tokens=False)


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(BYTE)
    got = token_counts.token_counts(docs, tokenizer=BYTE, limit=50).collect()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in known(docs)}
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id is not None} == want
    assert all(r.over_limit == (r.n_tokens > 50) for r in got) and token_counts.token_counts(empty, tokenizer=BYTE).count() == 0


def test_sentencepiece_counts(docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(docs, tokenizer=path).collect()
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id is not None} == {i: len(library.encode(t)) for i, t in known(docs)}


def test_token_store(docs, empty):
    library, at, want = Tokenizer.from_file(CASED), 0, []
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    for there, i, t in rows:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.append((i if there else None, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_store.token_store(docs, tokenizer=CASED).collect()]
    assert sorted(got, key=lambda x: x[1]) == want and token_store.token_store(empty, tokenizer=CASED).count() == 0


def test_token_store_by_document(spark, docs, tmp_path):
    where = f"{tmp_path}/shards"
    token_store.write_shards(docs, where, tokenizer=CASED)
    every = sorted((r.doc_id, r.n_tokens, r.ids) for r in token_store.read_shards(spark, where).collect() if r.doc_id is not None)
    some = {i for i, _, _ in every[::3]}
    got = sorted((r.doc_id, r.n_tokens, r.ids) for r in token_store.read_documents(spark, where, [*some, -5]).collect())
    assert got == [r for r in every if r[0] in some] and token_store.read_documents(spark, where, []).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (1, 2, 511, 513, 3000):
        v = np.cumsum(rng.integers(0, 4000, n))
        e = token_store.EliasFano.of(v)
        assert (e.values(n) == v).all() and all(e.select(i) == v[i] for i in range(0, n, 5))


@pytest.mark.parametrize("shingle,share", [(3, 85), (5, 80), (2, 50)])
def test_near_dedup(docs, empty, shingle, share):
    sets = {}
    for i, t in known(docs):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t)]
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.near_dedup(docs, shingle=shingle, share=share).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert len(got) == docs.count() and near_dedup.near_dedup(empty).count() == 0


def test_language_id(docs, empty, spark):
    rng = random.Random(2)
    make = {"en": "the and of with that", "de": "der und ein nicht schaft", "fr": "le de les une être"}
    rows = [(i, " ".join(rng.choice(make[lang].split()) for _ in range(30)), lang) for i in range(120) for lang in [list(make)[i % 3]]]
    train = spark.createDataFrame([*rows, (999, "12 34", None), (998, None, "en")], "doc_id long, text string, lang string")
    model = langid.learn(train)
    out = {r.doc_id: r for r in langid.language_id(train, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows) and out[999].lang_pred == "und" and out[998].lang_pred == "und"
    mixed = spark.createDataFrame([(1, " ".join([rows[0][1], rows[1][1]] * 5))], "doc_id long, text string")
    assert set(langid.language_id(mixed, model).first().proportions) == {"en", "de"}
    assert langid.language_id(docs, langid.learn(empty)).count() == docs.count() and langid.language_id(empty, model).count() == 0


def test_language_id_of_many_languages(spark):
    rng = random.Random(12)
    make = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(9)}
    say = lambda lang, n: " ".join(rng.choice(make[lang]) for _ in range(n))
    model = langid.learn(spark.createDataFrame([(i, say(lang, 60), lang) for i in range(180) for lang in [f"l{i % 9}"]], "doc_id long, text string, lang string"))
    texts = [" ".join(say(f"l{k}", 40 + 5 * k) for k in range(size)) for size in (1, 2, 5, 6, 9)]
    _, score, parts = langid.infer(model, pa.array(texts, pa.string()))
    for size, share, part in zip((1, 2, 5, 6, 9), score, parts, strict=True):
        assert set(part) == {f"l{k}" for k in range(size)} and abs(sum(part.values()) - 1) < 1e-3
        assert abs(share - (35 + 5 * size) / sum(40 + 5 * k for k in range(size))) < 0.03


def test_quality_and_toxicity(spark, docs, empty):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(40)]
        good, toxic = i % 5 != 0, i % 7 == 0
        if not good:
            w = [x for x in w[:10] for _ in range(4)]
        if toxic:
            w[rng.randrange(40)] = rng.choice(["zwixxol", "kvurghan", "zwixxolic"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for score, label in ((quality.quality_scores(table, quality.learn(table, marks)), 1), (toxicity.toxicity_scores(table, toxicity.learn(table, marks)), 2)):
        held = [(r.predicted, labels[r.doc_id][label]) for r in score.collect() if r.held_out]
        assert np.mean([a == b for a, b in held]) > 0.95
    for model, score in ((quality.learn(empty, marks), quality.quality_scores), (toxicity.learn(empty, marks), toxicity.toxicity_scores)):
        got = score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and score(empty, model).count() == 0


def test_toxicity_sample(spark, monkeypatch):
    rows = [(i, f"same w{i} same zz{i % 3}") for i in range(7200)]
    table = spark.createDataFrame([*rows, (7200, None), (7201, ""), (7202, "!")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(7203)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda sets, y, **_: seen.append((sets, y)))
    toxicity.learn(table, marks)
    sets, y = seen[0]
    assert len(sets) == len(y) >= 4990 and max(map(len, sets)) <= 1 + 4 + 1 + 5 + 1 + 3
    texts = [rows[0][1], None, "b a b", "", "s t u p i d " + "x" * 90]
    own = toxicity.own_words(pa.array(texts, pa.string()))
    t, word = toxicity.joined(own)
    for i, text in enumerate(texts):
        u = toxicity.tokens(pa.array([text], pa.string()))
        want = {u.letters[a:b].tobytes() for a, b in zip(u.first, u.first[1:])}
        got = [t.letters[t.first[w] : t.first[w + 1]].tobytes() for w in word[t.owner == i]]
        assert set(got) == want and len(got) == len(want)


def test_toxicity_tolerates_gaps(spark):
    """An insult with letters put in scores like the insult, and higher than clean words that
    share as many letters with it."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    say = lambda: [rng.choice(vocab) for _ in range(25)]
    rows = [(i, " ".join([*say(), *(["zwixxolkurg"] if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(500)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.learn(table, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    gapped = [" ".join([*say(), w]) for w in ("zwi.xxolkurg", "zwixxo-lkurg", "zwixxaolkurg", "zwiixxolkurg") for _ in range(5)]
    clean = [" ".join([*say(), w]) for w in ("gruklo", "lokurita", "xilo", "wizgul") for _ in range(5)]
    out = toxicity.toxicity_scores(spark.createDataFrame(list(enumerate(gapped + clean)), "doc_id long, text string"), model).collect()
    score = {r.doc_id: r.score for r in out}
    assert min(score[i] for i in range(len(gapped))) > max(score[i] for i in range(len(gapped), len(gapped + clean)))


def test_quality_reads_each_text_alone(spark, docs):
    model = quality.Model(np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    whole = sorted(quality.quality_scores(docs.repartition(1), model).collect(), key=key)
    assert whole == sorted(quality.quality_scores(docs.repartition(7), model).collect(), key=key)
    for t in ["abc", "abcd", "", None, "two words here"]:
        alone = quality.features(pa.array([t], pa.string()))
        beside = quality.features(pa.array(["before", t, "after it"], pa.string()))
        for i in range(3):
            a, b = (x[0][i][x[1][i][k] : x[2][i][k]].tolist() for x, k in ((alone, 0), (beside, 1)))
            assert a == b


def test_quality_scores_by_hand():
    weight, texts = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32), ["a b a b", "q", "", "some longer text, with words"]
    buckets, firsts, stops = quality.features(pa.array(texts, pa.string()))
    for d, t in enumerate(texts):
        n = len(WORD.findall(t))
        assert [int(e[d] - f[d]) for f, e in zip(firsts, stops, strict=True)] == [n, max(0, n - 1), max(0, len(t.encode()) - 3)]
        want = sum(float(weight[x]) for b, f, e in zip(buckets, firsts, stops, strict=True) for x in b[f[d] : e[d]])
        assert abs(sum(quality._doc_sums(f, e, weight[b])[d] for b, f, e in zip(buckets, firsts, stops, strict=True)) - want) < 1e-4


def test_lookahead_is_sufficient_and_drives_emission():
    """Borders before the lookahead never change, and long pre-tokens are emitted while they are read."""
    rng, coder = random.Random(7), bpe.loaded(bpe.read_spec(BYTE))[1].encoder
    size = coder.v.bytes_of
    assert 1 < coder.lookahead < 1000

    def borders(data):
        at, out = 0, set()
        for i in coder.stream(data):
            at += len(size[i])
            out.add(at)
        return out

    for letters in ("ab", "etaoin", " ", "é漢", "-=", "the", "0123456789"):
        data = "".join(rng.choice(letters) for _ in range(600)).encode()
        whole = borders(data)
        for q in rng.sample(range(200, len(data)), 8):
            assert {x for x in borders(data[:q]) if x < q - coder.lookahead} == {x for x in whole if x < q - coder.lookahead}
    read = 0

    class Watched(bytes):
        def __getitem__(self, key):
            nonlocal read
            read = max(read, key.stop or 0)
            return bytes.__getitem__(self, key)

    data = Watched("".join(rng.choice("etaoin") for _ in range(20_000)).encode())
    first = next(coder.stream(data))
    assert read < len(data) / 2 and data.startswith(size[first])


def test_language_of_short_texts_in_little_memory():
    import tracemalloc

    model = langid.Model(list("abcd"), np.log(np.full((4, langid.BUCKETS), 1 / langid.BUCKETS, np.float32)))
    tracemalloc.start()
    langid.infer(model, pa.array(["ab"] * 10_000))
    langid.infer(model, pa.array(["abc"] * 10_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_mixture_against_plain_em():
    rng = np.random.default_rng(5)
    p = rng.random((3, langid.BUCKETS)) ** 8 + 1e-9
    model = langid.Model(list("abc"), np.log(p / p.sum(1, keepdims=True)).astype(np.float32))
    text = "some text with a few words and more of them than one would need"
    _, bucket, n = langid.trigram_counts(pa.array([text]))
    q = np.exp(model.log_p[:, bucket].astype(float))
    pi = np.full(3, 1 / 3)
    for _ in range(12):
        share = pi[:, None] * q
        pi = (share / share.sum(0) * n).sum(1) / n.sum()
    got, _ = langid._mix(n.astype(np.float32), q.astype(np.float32), np.zeros(len(n), int), np.array([0]), np.ones((3, 1), np.float32), 12)
    assert np.allclose(got[:, 0], pi, atol=1e-3)


def test_singular_values():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 15)) @ rng.normal(size=(15, 80)) * np.linspace(1, 3, 80)
    r = rng.normal(size=(80, 24))
    directions, values = decontaminate.decomposed(a.T @ a @ r, r, 10)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, s[:10]) and np.allclose(np.abs((directions * v[:10].T).sum(0)), 1)


def test_decontaminate_against_all_pairs(spark):
    """Every pair of a document and an item judged by the alignment alone: the same leaks."""
    rng = random.Random(13)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = [say(rng.randint(10, 45)) for _ in range(12)]
    rows = []
    for i in range(90):
        item = bench[i % 12]
        keep = [w if rng.random() > 0.02 * (i % 25) else rng.choice(vocab) for w in item]
        rows.append((i, [*say(rng.randint(0, 60)), *(keep if i % 3 else []), *say(rng.randint(0, 60))]))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bench)], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.decontaminate(table, items).filter("contaminated").collect()}
    hashed = [decontaminate.plain_words(pa.array([" ".join(w)]))[0] for _, w in rows]
    want = set()
    for i, words_ in enumerate(hashed):
        for w in bench:
            item, n = decontaminate.plain_words(pa.array([" ".join(w)]))[0], len(w)
            around = (words_[max(0, a - n) : a + 2 * n] for a in range(0, len(words_), 6))
            if any(decontaminate.matches(item, x, 0.7, 0.5, 4, 8) for x in around):
                want.add(i)
    assert len(got & want) >= 0.9 * len(want) and not got - want and len(want) > 30
    parts = decontaminate.decontaminate(table, items, part_bytes=500)
    assert {r.doc_id for r in parts.filter("contaminated").collect()} == got


def test_decontaminate_ties(spark):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(9, text), (4, text), (None, text), (6, text)], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame([(1, f"x {text} y"), (2, "clean")], "doc_id long, text string"), bench).collect()
    assert {r.doc_id: r.item_id for r in got} == {1: 4, 2: None}


def test_select_gives_offsets(spark, docs, tmp_path):
    """In any order, the boundaries that the library's own counts add up to."""
    where = f"{tmp_path}/shards"
    token_store.write_shards(docs, where, tokenizer=CASED)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    library = Tokenizer.from_file(CASED)
    for row in spark.read.parquet(where).collect():
        e = token_store.EliasFano(row.low_bits, *(np.frombuffer(row[k], t) for k, t in (("low", np.uint8), ("high", np.uint8), ("marks", np.uint32))))
        names = np.frombuffer(row.doc_ids, dtype="?,<i8")
        lengths = [len(library.encode(text[int(i) if known else None], add_special_tokens=False).ids) + 1 for known, i in names]
        bound = np.concatenate([[0], np.cumsum(lengths)])
        shuffled = np.random.default_rng(3).permutation(row.n_docs + 1)
        assert e.select(shuffled).tolist() == bound[shuffled].tolist() and bound[-1] == row.n_ids


def test_pieces_are_remembered_exactly(monkeypatch):
    """With a memory that forgets, by pieces or by bytes, and where all hashes are equal, ids are the library's."""
    spec = bpe.read_spec(CASED)
    tokenizer = Tokenizer.from_str(spec)
    rng = random.Random(17)
    tails = ["", "", "", ".", ",", "?!", "...", "\")"]
    word = lambda: "".join(rng.choice("abcdefghijKLMNOPéßıİñж1-") for _ in range(rng.randint(1, 7))) + rng.choice(tails)
    hot = [word() for _ in range(30)]
    texts = [[" ".join(rng.choice(hot) if rng.random() < 0.5 else word() for _ in range(rng.randint(0, 120))) for _ in range(20)] + [None, "", " ", "<|endoftext|> <unk> e\u0301a , ."] for _ in range(5)]
    want = [[np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in some] for some in texts]
    for setting, value in (("CACHE", 1 << 20), ("CACHE", 200), ("CACHE_BYTES", 500), ("_hashes", lambda pieces: np.zeros(len(pieces), np.uint64))):
        with monkeypatch.context() as patch:
            patch.setattr(token_store, setting, value)
            known = token_store._Pieces(spec, "<u2")
            patch.setattr(token_store, "_known", lambda *_, known=known: known)
            assert known.apart and [token_store.encoded(spec, "<u2", pa.array(some, pa.string())) for some in texts] == want
            known._forget()
            assert setting == "_hashes" or len(known.text) <= (value if setting == "CACHE" else 500)


def test_known_pieces_are_not_encoded_again(monkeypatch):
    """Nor when other pieces have been forgotten; equal pieces of one call are encoded once."""
    spec = bpe.read_spec(CASED)
    known = token_store._Pieces(spec, "<u2")
    monkeypatch.setattr(token_store, "_known", lambda *_: known)
    monkeypatch.setattr(token_store, "CACHE", 400)
    real, seen = token_store._joined, []
    monkeypatch.setattr(token_store, "_joined", lambda pieces, many: seen.extend(pieces.to_pylist()) or real(pieces, many))
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    for k in range(8):
        token_store.encoded(spec, "<u2", pa.array([f"zebra {' '.join(map(name, range(k * 100, k * 100 + 100)))} zebra, zebra."]))
    assert seen.count("zebra") == 1 and len(seen) == len(set(seen)) == 8 * 100 + 3 and len(known.text) <= 600


def test_token_store_of_another_tokenizer(spark, docs):
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.token_store(docs, tokenizer=BYTE, end_id=7).collect() if r.doc_id is not None}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 7] for i, t in known(docs)}


def test_rows_that_share_an_id(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, "b " + base), (2, "a " + base), (3, base), (4, "x y z")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    cut = sorted((r.doc_id, r.n_words, r.kept_text) for r in substring_dedup.substring_dedup(table).collect())
    assert cut == [(1, 40, base), (2, 41, "a"), (2, 41, "a"), (3, 40, ""), (4, 3, "x y z")]
    near = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(table).collect())
    assert near == [(1, 36, 1), (2, 37, 1), (2, 37, 1), (3, 36, 1), (4, 1, 4)]
    vectors = spark.createDataFrame([(20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(vectors.withColumn("v", F.lit(1)).withColumn("key", F.lit("k"))).orderBy("rank").collect()] == [(20, 1, 2.0), (20, 2, 1.0)]


def test_near_dedup_of_a_large_group_of_loose_copies(spark):
    """Copies of one text whose changes take many of them just below the threshold."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        edits = set(rng.sample(range(120), rng.randint(0, 9)))
        rows.append((i, [f"e{rng.randint(0, 30)}" if k in edits else w for k, w in enumerate(base)]))
    sets = {i: {tuple(w[k : k + 3]) for k in range(118)} for i, w in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = near_dedup.near_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), shingle=3, share=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_decontaminate(spark, docs, empty):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(30) for _ in range(6)]
    para = [w for k, w in enumerate(items[1]) if k % 6]
    rows = [(0, [*say(50), *items[0], *say(50)]), (1, [*say(30), *para, *say(10)]), (2, say(200)), (3, rng.sample(items[2], 30)), (4, items[3][:9] + say(60))]
    table = spark.createDataFrame([*((i, " ".join(w).upper()) for i, w in rows), (5, None), (6, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (7, None), (8, "")], "item_id long, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.decontaminate(table, bench).collect()}
    assert got == {0: 0, 1: 1, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert not decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count()
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_decontaminate_short_items(spark):
    rng = random.Random(10)
    vocab, other = (["".join(rng.choice(letters) for _ in range(5)) for _ in range(300)] for letters in ("abcdefgh", "ijklmnop"))
    say = lambda n, of=other: [rng.choice(of) for _ in range(n)]
    items = {n: say(n, vocab) for n in range(1, 16)}
    rows, want = [], {}

    def plant(words, item):
        want[len(rows)] = item
        rows.append((len(rows), " ".join([*say(rng.randint(0, 90)), *words, *say(rng.randint(0, 90))])))

    for n, words in items.items():
        plant(words, n)
        if n > 1:
            plant([*words[:-1], "zz"] if n < 8 else [*words[: n // 2], *say(n)], None)
        if n >= 8:
            keep = range(n - 4 - (-(-n // 2) - 4), n)
            plant([w if k in keep else "zz" for k, w in enumerate(words)], n)
            plant([w if (k + 1) % 4 else "zz" for k, w in enumerate(words)], n if 4 * (n - n // 4) >= 2.8 * n else None)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items() if i > 1], "item_id long, text string")
    del want[0]
    got = {r.doc_id: r.item_id for r in decontaminate.decontaminate(spark.createDataFrame(rows[1:], "doc_id long, text string"), bench).collect()}
    assert got == want


def test_decontaminate_folds_all_letters(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("éñóèçжд") for _ in range(5)) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [say(30), say(6), say(30).upper()]
    rows = [(0, f"{say(40)} {items[0]} {say(40)}".upper()), (1, f"{say(40)} {items[1]} {say(40)}".upper()), (2, f"{say(40)} {items[2].lower()} {say(40)}"), (3, say(90).upper())]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: None}


def test_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(0, 30))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common(a, b) == table[-1, -1]


def test_decontaminate_sums_in_blocks():
    """Sums of steps and of terms by blocks of gathered rows: those of single additions."""
    rng = np.random.default_rng(5)
    sizes = np.r_[0, rng.integers(0, 40, 700), 5, 0, 9000, 1]
    first = np.r_[0, np.cumsum(sizes)]
    t = np.where(rng.random(first[-1]) < 0.3, 7, rng.integers(0, decontaminate.TERMS, first[-1])).astype(np.uint16)  # term 7 fills more than a block
    table = rng.integers(-9, 9, (decontaminate.TERMS, 5)).astype(np.float32)  # sums of integers are exact
    assert (t == 7).sum() > decontaminate.WORDS and len(t) / 6 > 3 * decontaminate.STEPS
    edges = [(a, min(a + 6, e)) for b, e in zip(first[:-1], first[1:], strict=True) for a in range(b, e, 6)]
    want = np.array([table[t[a:b]].sum(0) for a, b in edges])
    assert (decontaminate._step_sums(t, first, 6, table) == want).all()
    n, seen, terms, part = decontaminate.sums_of(t, first, 6, table)
    product, stands = np.zeros_like(table), np.zeros(decontaminate.TERMS, int)
    for (a, b), x in zip(edges, want, strict=True):
        np.add.at(product, t[a:b], x)
        stands[np.unique(t[a:b])] += 1
    assert n == len(edges) and (seen == stands).all() and (terms == np.unique(t)).all() and (part == product[terms]).all()


def test_decontaminate_weights_of_pairs(monkeypatch):
    """What two passages share, by the table of weights, by search where it would be too large, and by sets."""
    rng = np.random.default_rng(8)
    idf = rng.random(decontaminate.TERMS).astype(np.float32)
    corpus = decontaminate.Corpus(idf, np.zeros((decontaminate.TERMS, 1), np.float32), np.zeros(1))
    own = [np.unique(rng.integers(0, 300, rng.integers(1, 24))) for _ in range(9)]
    held = np.concatenate([i * decontaminate.TERMS + x for i, x in enumerate(own)])
    bench = decontaminate.Items([], [], np.arange(9), np.zeros((9, 1)), np.zeros((9, 1)), held, np.array([idf[x].sum() for x in own]))
    first = np.array([0, 3, 3, 100, 160])
    t = rng.integers(0, 300, 160).astype(np.uint16)
    doc, begin, end = decontaminate._spans(first, 12)
    p, w = (x.ravel() for x in np.meshgrid(np.arange(len(doc)), np.arange(9), indexing="ij"))
    want = [sum(float(idf[x]) for x in t[begin[i] : end[i]] if x in own[k]) for i, k in zip(p, w, strict=True)]
    assert sum(x > 0 for x in want) > 20
    for most in (decontaminate.WEIGHTS, 0):
        monkeypatch.setattr(decontaminate, "WEIGHTS", most)
        table = decontaminate.weights(bench, corpus)
        passages = decontaminate.Passages(t, begin, end, 24, bench, corpus, table)
        assert (table is None) == (most == 0) and np.allclose(passages.held(p, w), want, atol=1e-5)
        assert np.allclose(passages.mass, [idf[t[a:b]].sum() for a, b in zip(begin, end, strict=True)], atol=1e-5)


def test_decontaminate_aligns_what_may_match(monkeypatch):
    """Words that can't cover enough of an item, whatever their order, are not aligned."""
    real, aligned = decontaminate._longest, []
    monkeypatch.setattr(decontaminate, "_longest", lambda found, n: aligned.append(n) or real(found, n))
    item = np.arange(20, dtype=np.uint64)
    few, often = np.r_[item[:9], np.arange(100, 150, dtype=np.uint64)], np.repeat(item[:9], 10)
    assert decontaminate.matches(item, few, 0.7, 0.5, 4, 8) == decontaminate.matches(item, often, 0.7, 0.5, 4, 8) == 0 and not aligned
    assert decontaminate.matches(item, item[::-1], 0.7, 0.5, 4, 8) == 0 and len(aligned) == 1
    assert decontaminate.matches(item, item[:14], 0.7, 0.5, 4, 8) == 0.7 and decontaminate.matches(item, item[10:], 0.7, 0.5, 4, 8) == 0.5
    assert decontaminate.matches(item[:6], item[:6], 0.7, 0.5, 4, 8) == 1 and decontaminate.matches(item[:6], item[:5], 0.7, 0.5, 4, 8) == 0


def test_nearest(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 8)) * rng.uniform(0.5, 2, (400, 1))
    v[100:160] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, []), (None, [1.0] * 8)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, k=20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 400, 20))
    recall = []
    for q, ranks in got.items():
        score = v @ v[q]
        order = [i for i in np.lexsort((np.arange(400), -score.round(12))) if i != q][:20]
        assert sorted(ranks) == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for i, s in ranks.values())
        recall.append(len({i for i, _ in ranks.values()} & set(order)) / 20)
    assert np.mean(recall) >= 0.9
    few = {(r.query_id, r.vec_id) for r in ann.nearest(table.filter("vec_id < 3")).collect()}
    assert few == {(0, 1), (0, 2)} and ann.nearest(table.filter("vec_id > 999")).count() == 0


def test_hash_of_ids():
    assert hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\1\0\0\0\2\0\0\0").hexdigest()


def test_many_languages_in_a_bounded_model(spark, monkeypatch):
    """3,000 languages fit the bound with fewer buckets, and each is still told from the others."""
    assert langid.buckets_for(4) == langid.buckets_for(1024) == langid.BUCKETS and langid.buckets_for(10**6) == 16
    assert all(4 * n * langid.buckets_for(n) <= langid.MODEL_BYTES for n in (1, 1025, 3000, 70_000, 10**6))
    rng = random.Random(1)
    names = [f"l{i:04}" for i in range(3000)]
    letters = {x: "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for x in names}
    say = lambda x, n: " ".join("".join(rng.choice(letters[x]) for _ in range(6)) for _ in range(n))
    rows = [(4 * i + 1, say(x, 80), x) for i, x in enumerate(names)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.learn(train, held_part=-1)
    assert len(model.names) == 3000 and model.log_p.nbytes <= langid.MODEL_BYTES and model.names == sorted(names)
    some = names[::150]
    found, score, _ = langid.infer(model, pa.array([say(x, 60) for x in some]))
    assert sum(a == b for a, b in zip(found, some, strict=True)) >= 19
    # folding buckets is all that a smaller table changes
    monkeypatch.setattr(langid, "MODEL_BYTES", 4 * 3000 * langid.BUCKETS)
    whole = langid.learn(train, held_part=-1)
    folded = np.exp(whole.log_p[::500].astype(float)).reshape(6, model.log_p.shape[1], -1).sum(2)
    assert np.abs(folded - np.exp(model.log_p[::500].astype(float))).max() < 0.05


def test_language_of_edge_rows(spark):
    train = spark.createDataFrame([(i, text * 5, lang) for i in range(20) for text, lang in (("the cat sat on the mat ", "en"), ("der hund und die katze ", "de"))], "doc_id long, text string, lang string")
    model = langid.learn(train)
    assert model.names == ["de", "en"]
    long = "the mat and the cat " * 60_000
    rows = [(2, None), (None, "the cat"), (7, ""), (8, "123 !!"), (9, long), (9, long), (10, "q")]
    got = [(r.doc_id, r.held_out, r.lang_pred, 1.0 if 0.9 < r.score <= 1 else r.score) for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    want = [(2, "und", 0.0), (7, "und", 0.0), (8, "und", 0.0), (9, "en", 1.0), (9, "en", 1.0), (10, "de", 0.5)]
    assert sorted(got, key=key) == [*((i, held(i), *x) for i, *x in want), (None, True, "en", 1.0)]


def test_shards_are_filled_across_slices(spark):
    """Thousands of short documents in one shard, with many marks, by the query's own path."""
    from pyspark.sql import functions as F  # noqa: PLC0415

    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("tail "), (F.col("id") % 7).cast("int"))).alias("text"))
    where = tempfile.mkdtemp(prefix="spark-sluiceway-") + "/shards"
    token_store.write_shards(docs, where, tokenizer=CASED, partitions=1)
    shards = spark.read.parquet(where).orderBy("block").collect()
    assert [r.n_docs for r in shards] == [4096, 4096, 808] and len(np.frombuffer(shards[0].marks, np.uint32)) > 8
    got = token_store.read_shards(spark, where).orderBy("doc_id").collect()
    tokens = Tokenizer.from_file(CASED)
    want = [len(tokens.encode(f"word {'tail ' * (i % 7)}", add_special_tokens=False).ids) + 1 for i in range(7)]
    assert [r.n_tokens for r in got] == [want[i % 7] for i in range(9000)]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_hot_class_is_compared_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LOAD", 3)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(60):
        words_ = list(base)
        words_[rng.randrange(80)] = f"x{i}"
        texts.append(" ".join(words_))
    texts += [" ".join(f"y{rng.randrange(400)}" for _ in range(80)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(78)} for t in texts]
    label = list(range(80))
    for a, b in combinations(range(80), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            old, new = sorted((label[a], label[b]), reverse=True)
            label = [new if x == old else x for x in label]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, shingle=3, share=85).collect()}
    assert got == dict(enumerate(label))


def test_latent_candidates_alone(spark, monkeypatch):
    """Without the look-ups of whole words: the decomposition and the cosines find paraphrases."""
    rng = random.Random(13)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = [say(rng.randint(20, 45)) for _ in range(12)]
    rows = []
    for i in range(90):
        item = bench[i % 12]
        keep = [w if rng.random() > 0.01 * (i % 25) else rng.choice(vocab) for w in item]
        rows.append((i, " ".join([*say(rng.randint(0, 60)), *(keep if i % 3 else []), *say(rng.randint(0, 60))])))
    table, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bench)], "item_id long, text string")
    whole = {r.doc_id for r in decontaminate.decontaminate(table, items).filter("contaminated").collect()}
    real = decontaminate.Complete.of
    monkeypatch.setattr(decontaminate.Complete, "of", lambda words, corpus, **k: real([], corpus, **k))
    alone = {r.doc_id for r in decontaminate.decontaminate(table, items).filter("contaminated").collect()}
    assert alone <= whole and len(alone) >= 0.9 * len(whole) and len(whole) >= 50
    blank = decontaminate.items
    monkeypatch.setattr(decontaminate, "items", lambda *a, **k: blank(*a, **k)._replace(vector=np.zeros_like(blank(*a, **k).vector)))
    assert decontaminate.decontaminate(table, items).filter("contaminated").isEmpty()


def test_scores_of_edge_rows(spark):
    """Quality and toxicity of null, empty and very long texts, repeated rows and ids."""
    rng = random.Random(6)
    words_ = [f"word{i}" for i in range(60)]
    say = lambda n, more=(): " ".join(rng.choice([*words_, *more]) for _ in range(n))
    train = [(i, say(40, ["stupid", "awful"] * 6 if i % 2 else ())) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in train], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(train, "doc_id long, text string")
    long = say(50_000)
    rows = [(1, None), (2, ""), (3, "!?"), (4, long), (4, long), (5, long + " stupid awful"), (None, "stupid awful " * 9)]
    edge = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, labels)
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.toxicity_scores(edge, model).collect()]
    by = {i: s for i, s, _ in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] == 0.0 and by[5] >= 0.3 > by[4] and by[None] >= 0.3
    assert len({(s, p) for i, s, p in got if i == 4}) == 1 and all(p == (s >= 0.3) for _, s, p in got)
    model = quality.learn(docs, labels)
    got = [(r.doc_id, r.score, r.predicted, r.held_out) for r in quality.quality_scores(edge, model).collect()]
    by = {i: s for i, s, *_ in got}
    bias = 1 / (1 + np.exp(-model.bias))
    assert by[1] == by[2] == pytest.approx(bias) and by[None] > 0.5 > by[4] and by[5] == pytest.approx(by[4], abs=0.01)
    assert len({(s, p) for i, s, p, _ in got if i == 4}) == 1 and all(p == (s >= 0.3) for _, s, p, _ in got) and next(h for i, *_, h in got if i is None)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_scores(none, model).isEmpty() and quality.quality_scores(edge, quality.learn(none, labels)).filter("score <> 0.5").isEmpty()


def test_nearest_ties(spark):
    """More equal scores than are asked for: the smallest ids, copies and different vectors alike."""
    rows = [(i, [1.0, 0.0, 0.1 * (i % 3)]) for i in range(1, 70)] + [(100, [1.0, 0.0, 0.0])] + [(200 + i, [-1.0, 0.0, 0.5]) for i in range(30)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20, query_every=100, share=1.0)
    top = [(r["rank"], r.vec_id, r.score) for r in got.filter("query_id = 100").orderBy("rank").collect()]
    assert top == [(i + 1, i + 1, 1.0) for i in range(20)]
