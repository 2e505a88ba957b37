"""The pipeline on planted documents: what must go goes, clean documents stay."""

import os
import tempfile

import corpus_pipeline
from sluiceway.llm.shared import Scratch


def test_stages(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in source]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()
    clean = next(r for r in rows if len(r[1]) > 1500 and r[2] == "en")
    planted = [(9001, clean[1] + " extra", "en", "s", 1), (9002, "12345 67890", "en", "s", 1), (9003, clean[1][:300][::-1] + " " + item.text, "en", "s", 1), (9004, None, None, None, None)]
    folder = tempfile.mkdtemp(prefix="spark-sluiceway-")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([*rows, *planted], schema).write.parquet(f"{folder}/documents.parquet")
    os.symlink("/root/testdata/sf0.001/benchmark.parquet", f"{folder}/benchmark.parquet")
    docs, work, kept = spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = work.cut(stage(spark, docs, folder), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert 9002 not in kept["language"] and 9004 not in kept["language"] and 9003 in kept["language"]
    assert 9001 in kept["language"] and 9001 not in kept["near_duplicates"]
    assert 9003 in kept["repeated_passages"] and 9003 not in kept["leaks"]
    assert kept["leaks"] == kept["tokens"] and len(kept["language"]) >= 55


def test_edge_cases(spark):
    """Null ids, repeated ids, empty tables and further columns, by the module's docstring."""
    words = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en' and n_chars > 1500").first().text
    folder = tempfile.mkdtemp(prefix="spark-sluiceway-")
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed int, keys string"
    rows = [(i, f"{words[i * 40 : i * 40 + 700]} {i}", "en", "s", 1, 0, "k") for i in range(4)] + [(None, words[-600:], "en", "s", 1, 0, "k"), (None, words[-600:], "en", "s", 1, 0, "k"), (7, "", "en", "s", 1, 0, "k")]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.doc_id is None and r.text == words[-600:] for r in out) == 2 and 7 not in {r.doc_id for r in out} and {0, 1} & {r.doc_id for r in out}
    nothing = tempfile.mkdtemp(prefix="spark-sluiceway-")
    spark.createDataFrame([], schema).write.parquet(f"{nothing}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{nothing}/benchmark.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0
