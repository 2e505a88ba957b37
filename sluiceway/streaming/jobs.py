"""The same semantics on streams: a run is a micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators import publish
from sluiceway.sources import versions

_POOL = "protocol string, fingerprint string, uri string, first_added_at timestamp, last_seen_at timestamp, hits int"
_CYCLE = "cycle_started_at string, generation int"


def stream_fresh_posts(posts: DataFrame, hours: int = 72) -> DataFrame:
    """Each (handle, message_id) once within the watermark; later posts are dropped as late."""
    return posts.withWatermark("published_at", f"{hours} hours").dropDuplicatesWithinWatermark(["handle", "message_id"])


def stream_channel_activity(posts: DataFrame) -> DataFrame:
    """Posts of each channel and day, given out when the watermark has passed the day."""
    daily = posts.withWatermark("published_at", "72 hours").groupBy(F.window("published_at", "1 day").alias("w"), "handle").count()
    return daily.select("handle", F.col("w.start").alias("day"), F.col("count").alias("n"))


def accumulated(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The pool and the one-row cycle table as last published under root, by a batch or a stream."""
    found = versions.load(spark, root)
    if found is None:
        return spark.createDataFrame([], _POOL), spark.createDataFrame([("1970-01-01T00:00:00Z", 1)], _CYCLE)
    return found["pool"], found["cycle"]


def accumulate(current: DataFrame, root: str, now: datetime, *, cap: int | None = 10_000, days: int = 6, writer: str | None = None, batch_id: int = 0, attempts: int = 5, keep: int = 3) -> bool:
    """Merges current (protocol, fingerprint, uri) into the pool under root as its next version; False if
    this writer has published the batch already. If another writer comes first, the merge begins
    again with what that one left. Without a cap (None) the pool keeps every row."""
    spark = current.sparkSession
    one = current.groupBy("protocol", "fingerprint").agg(F.min("uri").alias("uri"))
    for attempt in range(attempts):
        last = versions.current(spark, root)
        note = dict(last.note) if last else {}
        if writer is not None and note.get(writer, -1) >= batch_id:
            return False
        old, cycle = accumulated(spark, root)
        rolled = publish.roll_cycle(cycle, old.isEmpty(), now, days)
        kept = old.filter(F.lit(not rolled.first()["reset"]))  # the cycle table has one row
        merged = publish.merge_pool(kept, one, now).drop("change")
        merged = merged if cap is None else publish.enforce_cap(merged, cap)
        tables = {"pool": merged.withColumn("hits", F.col("hits").cast("int")), "cycle": rolled.select("cycle_started_at", F.col("generation").cast("int").alias("generation"))}
        try:
            versions.commit(tables, root, last.number + 1 if last else 0, note | ({writer: batch_id} if writer else {}))
        except versions.Conflict:
            if attempt + 1 == attempts:
                raise
            continue
        versions.forget(spark, root, keep)
        return True
    return False


def stream_accumulate(current: DataFrame, root: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC), cap: int | None = 10_000, days: int = 6):
    """Merges every micro-batch into the pool under ``root``, at the batch's own time, with the
    reset cycle. The log remembers the last batch of each query, so a repeated batch is not merged
    twice; a query with a new checkpoint is another one and goes on with the pool that is there."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        accumulate(batch, root, clock(), cap=cap, days=days, writer=query, batch_id=batch_id)

    return current.writeStream.foreachBatch(merge)


def stream_first_seen(current: DataFrame) -> DataFrame:
    """First and last time of each fingerprint (fingerprint, seen_at) that a batch has; output mode
    update. Equal fingerprints of a batch are joined before they meet their state, all inside the
    JVM. The state is never evicted, as the job's contract is to remember for ever, so it wants the
    state store on disk: spark.sql.streaming.stateStore.providerClass should name RocksDB's."""
    own = current.filter("fingerprint is not null and seen_at is not null")
    return own.groupBy("fingerprint").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))
