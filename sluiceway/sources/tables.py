"""Landed inputs and stored state: strict schemas, validated when read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions.numbers import half_even
from sluiceway.operators.extract import HANDLE
from sluiceway.operators.identity import PROTOCOL_LABELS
from sluiceway.sources import versions

_ENTRY = "struct<uri: string, first_added_at: string, last_seen_at: string, hits: string>"
_SEEN = "struct<first_seen_at: string, last_seen_at: string>"
_NUMBER = r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
#: The fields of a stored channel and their types, in the order that a variant's schema has.
_CHANNEL = {
    "confidence": _NUMBER,
    "deep_accepted": "BIGINT",
    "deep_rejected": "BIGINT",
    "evidence_runs": "BIGINT",
    "first_seen_at": "STRING",
    "last_evaluated_at": "STRING",
    "last_seen_at": "STRING",
    "reason": "STRING",
    "required_score": _NUMBER,
    "runs_since_evaluation": "BIGINT",
    "score": _NUMBER,
    "status": "STRING",
}


def read_source_list(lines: DataFrame) -> DataFrame:
    """url, ordinal, valid from lines (value, ordinal): comments and blanks go, first wins."""
    url = F.trim(F.substring_index("value", "#", 1))
    valid = F.col("url").rlike(r"^https://[^\s/?#@\[\]:]+(:\d+)?([/?#]\S*)?$")
    kept = lines.select(url.alias("url"), "ordinal").filter("url <> ''").groupBy("url").agg(F.min("ordinal").alias("ordinal"))
    return kept.withColumn("valid", valid)


def classify_documents(docs: DataFrame, now: Column, max_age_hours: int = 72, max_bytes: int = 5_242_880) -> DataFrame:
    """docs(doc_idx, body binary, last_modified, reason) to freshness, reason and text; a stale
    document keeps no text."""
    text = F.try_validate_utf8(F.col("body").cast("string"))
    at = F.try_to_timestamp(F.regexp_extract("last_modified", r"^\w{3}, (\d\d \w{3} \d{4} \d\d:\d\d:\d\d)", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    reason = F.coalesce("reason", F.when(F.length("body") > max_bytes, "response_too_large").when(text.isNull(), "invalid_utf8"))
    stale = at < now - F.expr(f"INTERVAL {int(max_age_hours)} HOURS")
    freshness = F.when(reason.isNotNull(), "failed").when(at.isNull(), "unknown").when(stale, "stale").otherwise("recent")
    out = docs.select("doc_idx", freshness.alias("freshness"), reason.alias("reason"), at.alias("last_modified"), text.alias("text"))
    return out.withColumn("text", F.when(F.col("freshness").isin("recent", "unknown"), F.col("text")))


def read_registry(lines: DataFrame) -> DataFrame:
    """Handles of a registry (value): lines that begin with @, lower-cased, each once."""
    return lines.filter(F.trim("value").startswith("@")).select(F.lower(F.substring(F.trim("value"), 2, 64)).alias("handle")).filter(F.col("handle").rlike(f"^{HANDLE}$")).distinct()


def write_registry(handles: DataFrame, path: str) -> None:
    handles.select(F.concat(F.lit("@"), F.lower("handle")).alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def load_pool(text: DataFrame) -> DataFrame:
    """Pool rows of a stored JSON state (value); another schema version is an empty pool."""
    doc = text.select(F.from_json("value", f"schema int, protocols map<string, map<string, {_ENTRY}>>").alias("d")).filter("d.schema = 1")
    rows = doc.select(F.explode("d.protocols").alias("protocol", "entries")).select("protocol", F.explode("entries").alias("fingerprint", "e")).select("protocol", "fingerprint", "e.*")
    hits = F.col("hits").try_cast("int")
    fine = rows.filter("length(fingerprint) = 64 and uri <> '' and first_added_at <> '' and last_seen_at <> ''")
    return fine.withColumn("hits", F.when(hits >= 1, hits).otherwise(1))


def load_seen_state(text: DataFrame) -> DataFrame:
    doc = text.select(F.from_json("value", f"records map<string, {_SEEN}>").alias("d"))
    return doc.select(F.explode("d.records").alias("fingerprint", "e")).select("fingerprint", "e.*").filter("length(fingerprint) = 64 and first_seen_at is not null and last_seen_at is not null")


def pool_cycle(text: DataFrame) -> DataFrame:
    """cycle_started_at and generation of a stored JSON state (value), one row for each: the epoch
    and 1 where they are missing or of another type, and for another schema version."""
    doc = F.try_parse_json("value")
    fine = F.coalesce(F.try_variant_get(doc, "$.schema", "int") == 1, F.lit(False))
    shape = F.coalesce(F.schema_of_variant(doc), F.lit(""))
    started = F.when(fine & shape.rlike(r"\bcycle_started_at: STRING"), F.try_variant_get(doc, "$.cycle_started_at", "string"))
    number = F.when(fine & shape.rlike(r"\bgeneration: BIGINT"), F.try_variant_get(doc, "$.generation", "int"))
    return text.select(F.coalesce(started, F.lit("1970-01-01T00:00:00Z")).alias("cycle_started_at"), F.when(number >= 1, number).otherwise(1).alias("generation"))


def parse_channel_state(text: DataFrame) -> DataFrame:
    """State rows of a stored JSON state (value: the whole of it) of version 5; a channel with other
    keys, a value of another type or a time that can't be read goes."""
    doc = text.select(F.from_json("value", "version string, channels map<string, string>").alias("d")).filter("d.version = '5'")
    return _channel_rows(doc.select(F.explode("d.channels").alias("key", "_json")))


def _channel_rows(rows: DataFrame) -> DataFrame:
    """Typed rows of (key, _json)."""
    fields = ", ".join(f"{k} {'double' if t == _NUMBER else t}" for k, t in _CHANNEL.items())
    exact = rf"^OBJECT<{', '.join(f'{k}: {t}' for k, t in _CHANNEL.items())}>$"
    typed = rows.filter(F.schema_of_variant(F.try_parse_json("_json")).rlike(exact))
    fine = typed.select("key", F.from_json("_json", fields).alias("c")).select("key", "c.*")
    times = {c: F.try_to_timestamp(c) for c in _TIMES}
    whole = fine.filter("deep_accepted >= 0 and deep_rejected >= 0 and required_score between 0 and 100 and reason <> ''").withColumns(times)
    return load_channel_state(whole.dropna(subset=_TIMES).withColumns({c: F.col(c).cast("int") for c in ("evidence_runs", "runs_since_evaluation")}))


_TIMES = ["first_seen_at", "last_seen_at", "last_evaluated_at"]
#: The order of a stored channel's fields.
_STORED = ["status", "score", "reason", "evidence_runs", "first_seen_at", "last_seen_at", "last_evaluated_at", "confidence", "required_score", "deep_accepted", "deep_rejected", "runs_since_evaluation"]
_STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def write_channel_state(state: DataFrame, path: str, run_index: int, now: Column) -> None:
    """The state as one JSON document of lines, a channel on each, in the order of their keys over all
    part files: any number of channels is written, and read again by ``read_channel_state``, in
    parallel."""
    body = F.to_json(F.struct(*_STORED), {"timestampFormat": _STAMP})
    first = state.agg(F.min("key").alias("_first"))  # one row
    comma = F.when(F.col("key") == F.col("_first"), "").otherwise(",")
    lines = state.crossJoin(F.broadcast(first)).select(F.col("key").alias("k"), F.concat(comma, F.lit('"'), "key", F.lit('":'), body).alias("value"))
    head = F.concat(F.lit(f'{{"version":5,"run_index":{int(run_index)},"generated_at":"'), F.date_format(now, _STAMP), F.lit('","channels":{'))
    one = state.sparkSession.range(1)
    ends = one.select(F.lit("").alias("k"), head.alias("value")).union(one.select(F.lit("~").alias("k"), F.lit("}}").alias("value")))
    lines.union(ends).orderBy("k").select("value").write.mode("overwrite").text(path)


def read_channel_state(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """State rows and run_index of what ``write_channel_state`` wrote; no rows and 0 for another
    version."""
    lines = spark.read.text(path)
    head = lines.select(F.regexp_extract("value", r'^\{"version":5,"run_index":(\d+),', 1).alias("n")).filter("n <> ''").first()
    rows = lines.select(F.regexp_extract("value", r'^,?"([0-9a-f]{64})":', 1).alias("key"), F.regexp_extract("value", r'^,?"[0-9a-f]{64}":(\{.*\})$', 1).alias("_json"))
    return _channel_rows(rows.filter(F.lit(head is not None) & (F.col("key") != ""))), int(head["n"]) if head else 0


def load_channel_state(rows: DataFrame) -> DataFrame:
    """State rows within their bounds, scores rounded."""
    fine = rows.filter("length(key) = 64 and status in ('candidate', 'approved', 'watch', 'excluded') and score between 0 and 100 and evidence_runs >= 1 and confidence between 0 and 1 and runs_since_evaluation >= 0")
    return fine.withColumns({"score": half_even(F.col("score"), 2), "confidence": half_even(F.col("confidence"), 4), "required_score": half_even(F.col("required_score"), 2)})


def save_state(df: DataFrame, root: str, version: int) -> None:
    """df as this version of the state under root; raises ``versions.Conflict`` if it has one."""
    versions.commit({"state": df}, root, version)


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest complete version under root, or None."""
    last = versions.current(spark, root)
    return None if last is None else last.number


def load_state(spark: SparkSession, root: str) -> DataFrame | None:
    found = versions.load(spark, root)
    return None if found is None else found["state"]


def write_protocol_files(pool: DataFrame, path: str) -> None:
    """One folder of text for each of the three protocols, in one pass: ranges of (protocol, place)
    go to files whose names are in the order of the ranges, so lines are in the order of ``place``
    over all files of a folder. A protocol without rows has an empty folder."""
    ranged = pool.repartitionByRange("protocol", "place").sortWithinPartitions("protocol", "place")
    ranged.select("protocol", "uri").write.mode("overwrite").partitionBy("protocol").text(path)
    for protocol in PROTOCOL_LABELS:
        at = pool.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/protocol={protocol}")
        at.getFileSystem(pool.sparkSession._jsc.hadoopConfiguration()).mkdirs(at)


def source_rejections(sources: DataFrame) -> DataFrame:
    """reason of each document that gave no text: why it failed, or how fresh it was."""
    return sources.filter("text is null").select(F.coalesce("reason", "freshness").alias("reason"))


def freshness_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("freshness").agg(F.count(F.lit(1)).alias("n"))


_JSON = {"timestampFormat": _STAMP, "ignoreNullFields": "false"}


def _by(df: DataFrame, key: str) -> DataFrame:
    """A one-row frame with a map of df's other columns by key: for tables with a row for each of
    a fixed set of keys (protocols, reasons, grades)."""
    rest = [c for c in df.columns if c != key]
    value = F.struct(*rest) if len(rest) > 1 else F.col(rest[0])
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value.alias("value"))))).alias("m"))


def build_report(sources: DataFrame, *, head: dict[str, Column], publication: DataFrame, counts: DataFrame, excluded: DataFrame, telegram: DataFrame | None = None, speed: DataFrame | None = None, reachability: DataFrame | None = None) -> DataFrame:
    """The audit record as rows (block, body): a JSON object for each source, which tells how fresh
    it was and why it failed but not where it is, and one document of all other blocks, folded
    from aggregates. publication: a row for each protocol; counts and the optional blocks: one
    row; excluded (reason, n). A block that is None is left out."""
    told = sources.select(F.lit("source").alias("block"), F.to_json(F.struct("freshness", "last_modified", "reason"), _JSON).alias("body"))
    one = lambda df, name: df.select(F.struct("*").alias(name))
    rows = counts.crossJoin(_by(freshness_counts(sources), "freshness").withColumnRenamed("m", "source_freshness")).crossJoin(_by(excluded, "reason").withColumnRenamed("m", "excluded"))
    parts = [_by(publication, "protocol").withColumnRenamed("m", "publication"), one(rows, "counts")]
    parts += [one(df, name) for name, df in (("telegram", telegram), ("speed_test", speed), ("reachability", reachability)) if df is not None]
    whole = reduce(DataFrame.crossJoin, parts)  # one row each
    document = F.to_json(F.struct(*(c.alias(k) for k, c in head.items()), *whole.columns), _JSON)
    return told.union(whole.select(F.lit("report"), document))


def report_document(report: DataFrame) -> DataFrame:
    """The document of a report as one VARIANT."""
    return report.filter("block = 'report'").select(F.parse_json("body").alias("report"))
