"""The registered queries of this subpackage: thin contracts over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import langid, quality, toxicity
from sluiceway.llm.ann import nearest
from sluiceway.llm.bpe import bpe_round_trip
from sluiceway.llm.collocations import collocations
from sluiceway.llm.decontaminate import decontaminate
from sluiceway.llm.divergence import source_divergence
from sluiceway.llm.near_dedup import near_dedup
from sluiceway.llm.substring_dedup import substring_dedup
from sluiceway.llm.token_counts import token_counts
from sluiceway.llm.token_store import token_store
from sluiceway.llm.topk import top_k


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(_table(spark, sf_dir, "documents"), tokenizer=vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer=vocabulary("byte_bpe_50k.json"), limit=1024)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), shingle=3, share=85)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_store(_table(spark, sf_dir, "documents"), tokenizer=vocabulary("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.language_id(docs, langid.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), k=5, query_every=50, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_permutation_index": op7_permutation_index,
    "op8_token_counts": op8_token_counts,
    "op9_near_dedup": op9_near_dedup,
    "op10_token_store": op10_token_store,
    "op11_collocations": op11_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_top_k": op13_exact_top_k,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH docs AS (
          SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), starts AS (
          SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM docs WHERE len(w) >= 20
        ), wins AS (
          SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s+19], ' ') ORDER BY doc_id, s) AS k FROM starts
        ), gone AS (
          SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM wins WHERE k > 1
        ), words AS (
          SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs
        ), kept AS (
          SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept USING (doc_id)
    """,
    "op9_near_dedup": r"""
        WITH RECURSIVE docs AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), sh AS (
          SELECT DISTINCT doc_id, array_to_string(w[s:s+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM docs WHERE len(w) > 0)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        links AS (
          SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
          JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
        ), reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, m) AS component_id, d.doc_id = least(d.doc_id, m) AS kept
        FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)
    """,
    "op11_collocations": r"""
        WITH pieces AS (
          SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
          FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), f AS (
          SELECT lang, k, array_to_string(w[s:s+k-1], ' ') AS phrase, count(*) AS f
          FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM pieces), (SELECT unnest(range(1, 6)) AS k) WHERE s + k - 1 <= len(w)
          GROUP BY ALL HAVING count(*) >= 100
        ), whole AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
        cand AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cuts AS (SELECT lang, phrase, a, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k+1:], ' ') AS q, k FROM (SELECT *, unnest(range(1, len(w))) AS k FROM cand)),
        scored AS (
          SELECT cuts.lang AS lang, cuts.phrase AS phrase, a, cuts.k AS k, x.f AS l, y.f AS r, n, 1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS score
          FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q JOIN whole ON whole.lang = cuts.lang
        ), low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
        covers AS (SELECT lang, array_to_string(w[s:s+n-1], ' ') AS phrase, max(a) AS cover FROM (SELECT *, unnest(range(1, len(w) + 1)) AS s FROM cand), (SELECT unnest(range(2, 5)) AS n) WHERE n < len(w) AND s + n - 1 <= len(w) GROUP BY ALL)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank FROM low LEFT JOIN covers ON covers.lang = low.lang AND covers.phrase = low.phrase WHERE cover IS NULL OR cover < a)
        WHERE rank <= 2000
    """,
    "op12_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
        ), o AS (SELECT r, lang, source, unnest(t) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        c AS (SELECT o.lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
          SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (g.n + v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v) AS q
          FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), pairs AS (
          SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN (SELECT a.lang AS lang, a.source AS s, b.source AS t, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) z ON x.lang = z.lang AND x.source = s AND y.source = t
        ), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
        WHERE part = 'pair' OR rank <= 200
    """,
    "op13_exact_top_k": r"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
}
