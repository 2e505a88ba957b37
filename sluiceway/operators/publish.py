"""Accumulating pool: reset cycle, upsert, cap and reports; first and last seen state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.operators import identity


def update_seen(state: DataFrame, current: DataFrame, now: datetime) -> DataFrame:
    """fingerprint, first_seen_at, last_seen_at: absent rows stay as they are for ever."""
    seen = current.select("fingerprint").distinct().withColumn("_now", F.lit(now))
    return state.join(seen, "fingerprint", "full_outer").select("fingerprint", F.coalesce("first_seen_at", "_now").alias("first_seen_at"), F.coalesce("_now", "last_seen_at").alias("last_seen_at"))


def first_seen_window(profiles: DataFrame, state: DataFrame, now: datetime, hours: int) -> DataFrame:
    recent = state.filter(F.col("first_seen_at") >= F.lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS")).select("fingerprint")
    return profiles.join(recent, "fingerprint", "left_semi")


def roll_cycle(cycle: DataFrame, pool_is_empty: bool, now: datetime, days: int = 6) -> DataFrame:
    """cycle_started_at, generation, reset of the one-row cycle table. A start that can't be
    read counts as expired; a fresh pool is anchored to now without a reset."""
    started = F.try_to_timestamp("cycle_started_at")
    age = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(started)) / 86400)
    fresh = (started == F.timestamp_seconds(F.lit(0))) & F.lit(pool_is_empty) & (F.col("generation") == 1)
    reset = ~F.coalesce(fresh, F.lit(False)) & F.coalesce(age >= days, F.lit(True))
    stamp = F.date_format(F.lit(now), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return cycle.select(F.when(reset | F.coalesce(fresh, F.lit(False)), stamp).otherwise(F.col("cycle_started_at")).alias("cycle_started_at"), (F.col("generation") + reset.cast("int")).alias("generation"), reset.alias("reset"))


def merge_pool(pool: DataFrame, current: DataFrame, now: datetime) -> DataFrame:
    """Full outer upsert on (protocol, fingerprint): new rows start with one hit, known ones get
    another and keep their URI. ``change`` is added, refreshed or carried; security and transport
    of current rows are passed on where they are there."""
    more = [c for c in ("security", "transport") if c in current.columns]
    new = current.select("protocol", "fingerprint", F.col("uri").alias("_uri"), *more)
    joined = pool.join(new, ["protocol", "fingerprint"], "full_outer")
    here, known = F.col("_uri").isNotNull(), F.col("uri").isNotNull()
    stamp = F.lit(now)
    return joined.select(
        "protocol",
        "fingerprint",
        F.coalesce("uri", "_uri").alias("uri"),
        F.coalesce("first_added_at", stamp).alias("first_added_at"),
        F.when(here, stamp).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        (F.coalesce("hits", F.lit(0)) + here.cast("int")).alias("hits"),
        F.when(~known, "added").when(here, "refreshed").otherwise("carried").alias("change"),
        *more,
    )


def enforce_cap(pool: DataFrame, cap: int = 10_000) -> DataFrame:
    """The newest ``cap`` rows of each protocol; Spark prunes to the cap inside each task."""
    newest = Window.partitionBy("protocol").orderBy(F.desc("last_seen_at"), F.desc("first_added_at"), F.desc("fingerprint"))
    return pool.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= cap).drop("_k")


def cycle_position(started: Column, now: datetime, days: int = 6) -> Column:
    """A struct of the cycle's day, from 1, and the days until its reset. A start that can't be
    read counts as day 1; a cycle that has run out as the day after its last."""
    age = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.try_to_timestamp(started))) / 86400)
    past = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(days), age)), F.lit(0)).cast("int")
    return F.struct((past + 1).alias("day"), (F.lit(days) - past).alias("days_until_reset"))


def publication_report(merged: DataFrame, cap: int = 10_000, reset: bool = False) -> DataFrame:
    """added, refreshed, evicted, total and carried of each of the three protocols; carried is
    what is left after eviction, less what was added before it."""
    counted = merged.groupBy("protocol").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "refreshed").alias("refreshed"), F.count(F.lit(1)).alias("merged"))
    every = merged.sparkSession.createDataFrame([(p,) for p in identity.PROTOCOL_LABELS], "protocol string")
    rows = every.join(counted, "protocol", "left").na.fill(0)
    total = F.least(F.col("merged"), F.lit(cap))
    carried = F.lit(0) if reset else F.greatest(total - F.col("added"), F.lit(0))
    return rows.select("protocol", "added", "refreshed", (F.col("merged") - total).alias("evicted"), total.alias("total"), carried.cast("long").alias("carried"))


def publication_order(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy("protocol", "security", "transport", "fingerprint")


def render_order(capped: DataFrame) -> DataFrame:
    """Rows of each protocol with their place in its file: carried and refreshed ones by
    fingerprint, then new ones in publication order (security, transport, fingerprint)."""
    added = F.col("change") == "added"
    new = lambda c: F.when(added, F.col(c))
    order = Window.partitionBy("protocol").orderBy(added.cast("int"), new("security"), new("transport"), "fingerprint")
    return capped.withColumn("place", F.row_number().over(order))


def publish(profiles: DataFrame, pool: DataFrame, cycle: DataFrame, now: datetime, cap: int = 10_000, days: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One publication of accepted profiles (with fingerprint, doc_idx and line_idx) into the pool:
    the new pool with each row's place in its protocol's file, the cycle table, and the report of
    each protocol with the cycle's position. A reset begins with an empty pool."""
    rolled = roll_cycle(cycle, pool.isEmpty(), now, days)
    reset = bool(rolled.first()["reset"])  # the cycle table has one row
    first = identity.keep_first(profiles.select("doc_idx", "line_idx", "protocol", "fingerprint", "original_uri", "security", "transport"), ["protocol", "fingerprint"], ["doc_idx", "line_idx"])
    current = first.select("protocol", "fingerprint", identity.named_uri().alias("uri"), "security", "transport")
    merged = merge_pool(pool.filter(F.lit(not reset)), current, now)
    position = rolled.select(cycle_position(F.col("cycle_started_at"), now, days).alias("at"), "generation", "reset").select("at.*", "generation", "reset")
    report = publication_report(merged, cap, reset).crossJoin(F.broadcast(position))  # one row
    return render_order(enforce_cap(merged, cap)), rolled.drop("reset"), report
