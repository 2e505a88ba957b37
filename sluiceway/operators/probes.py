"""Probe attempts and transfer logs: aggregates, grades and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.numbers import half_even
from sluiceway.operators.profiles import param

ENDPOINT = ["host", "port", "use_tls", "server_name"]
#: Rank of probe methods, grade limits, score weights.
METHODS = ["tcp", "http_204", "cloudflare_trace"]
EXCELLENT_MS, GOOD_MS = 150, 300
NEUTRAL_LATENCY = 60.0


def distinct_endpoints(profiles: DataFrame) -> DataFrame:
    """Endpoints to probe; hysteria2 runs over UDP and is exempt."""
    tls = F.col("security").isin("tls", "reality")
    sni = param("sni")
    rows = profiles.filter("protocol <> 'hysteria2'").select(F.col("server").alias("host"), "port", tls.alias("use_tls"), F.when(tls, sni).otherwise("").alias("server_name"))
    return rows.distinct()


def aggregate_attempts(attempts: DataFrame) -> DataFrame:
    """One row for each endpoint, with the latencies of its attempts in order: as wide as an
    endpoint has attempts that were answered."""
    ok = F.col("responded")
    rank = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method")).cast("int")
    only = lambda c: F.when(F.min(F.when(ok, F.col(c))) == F.max(F.when(ok, F.col(c))), F.max(F.when(ok, F.col(c))))
    series = F.sort_array(F.collect_list(F.when(ok & F.col("latency_ms").isNotNull(), F.struct("attempt_no", "latency_ms"))))
    found = attempts.groupBy(*ENDPOINT).agg(
        F.bool_or("responded").alias("responded"),
        F.max(F.when(ok, rank)).alias("rank"),
        F.count(F.lit(1)).alias("attempts_made"),
        F.count_if(ok).alias("successful_attempts"),
        F.transform(series, lambda s: s["latency_ms"]).alias("latencies_ms"),
        F.bool_and("responded").alias("stable"),
        F.when(F.bool_or(F.col("resolution") == "doh"), "doh").otherwise("system").alias("resolution"),
        only("tls_version").alias("tls_version"),
        only("tls_cipher").alias("tls_cipher"),
    )
    # the median of the series, which is here anyway
    sorted_, n = F.sort_array("latencies_ms"), F.size("latencies_ms")
    middle = (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2
    method = F.when(F.col("rank") > 0, F.element_at(F.array(*map(F.lit, METHODS)), F.col("rank"))).otherwise("tcp")
    return found.select(*ENDPOINT, "responded", method.alias("method"), F.rint(middle).cast("int").alias("latency_ms"), *found.columns[len(ENDPOINT) + 2 :])


def latency_grade(ms: Column) -> Column:
    return F.when(ms.isNull(), "unresponsive").when(ms <= EXCELLENT_MS, "excellent").when(ms <= GOOD_MS, "good").otherwise("fair")


def latency_component(probed: Column, ms: Column) -> Column:
    """100, 70 or 40 by grade; a profile without a probe counts as neutral."""
    return F.when(~probed, NEUTRAL_LATENCY).when(ms <= EXCELLENT_MS, 100.0).when(ms <= GOOD_MS, 70.0).otherwise(40.0)


def reachability_gate(profiles: DataFrame, probes: DataFrame) -> DataFrame:
    """profiles (with the endpoint's columns) with ``reason``: null if exempt or responsive."""
    ok = probes.filter("responded").select(*ENDPOINT).withColumn("_ok", F.lit(True))
    keep = (F.col("protocol") == "hysteria2") | F.col("_ok").isNotNull()
    return profiles.join(ok, ENDPOINT, "left").withColumn("reason", F.when(~keep, "unreachable_endpoint")).drop("_ok")


def reachability_summary(probes: DataFrame) -> DataFrame:
    """One row; nearest-rank percentiles over the endpoints' medians."""
    up = F.col("responded")
    pct = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY CASE WHEN responded THEN latency_ms END)")
    grade = latency_grade(F.col("latency_ms"))
    return probes.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(up).alias("responsive"),
        F.count_if(up & F.col("stable")).alias("stable"),
        half_even(100.0 * F.count_if(up & F.col("stable")) / F.greatest(F.lit(1), F.count_if(up)), 1).alias("stable_percent"),
        F.count_if(F.col("resolution") == "doh").alias("doh"),
        pct(0.5).cast("int").alias("p50"),
        pct(0.95).cast("int").alias("p95"),
        *(F.count_if(up & (grade == g)).alias(g) for g in ("excellent", "good", "fair")),
    )


def tunnel_supported() -> Column:
    plain = F.col("security").isin("none", "tls")
    trojan = (F.col("protocol") == "trojan") & (F.col("transport") == "tcp") & F.col("secret").isNotNull()
    vless = (F.col("protocol") == "vless") & F.col("transport").isin("tcp", "ws") & F.col("username").isNotNull()
    return plain & (trojan | vless)


def transfer_windows(samples: DataFrame, *, warmup: float = 0.75, windows: int = 4, max_duration: float = 8.0, download_bytes: int = 2_000_000, steps: int = 16) -> DataFrame:
    """profile_key, win, bytes, seconds, kbps and received, of samples (profile_key, elapsed_s,
    bytes): equal windows after the warm-up, up to the sample that reaches the byte budget or the
    end of the last window; windows without samples count as 0, the last one ends with the last
    sample. If nothing came after the warm-up, the warm-up is the only window. received: all
    bytes, the warm-up's too.

    Bytes are summed by time steps, ``steps`` to a window, with map-side combining; only the one
    step in which a profile reaches its budget is taken sample by sample, so one profile's log
    of any length is read by many tasks."""
    width = max_duration / windows
    x = F.col("elapsed_s")
    within = F.ceil((x - warmup) / width * steps).cast("int") - 1
    before = F.greatest(F.lit(0), F.ceil(x / max(warmup, 1e-9) * steps).cast("int") - 1) - steps
    own = samples.filter(x <= warmup + max_duration).select("profile_key", x, "bytes", F.when(x <= warmup, before).otherwise(within).alias("step"))
    by_step = own.groupBy("profile_key", "step").agg(F.sum("bytes").alias("bytes"), F.max("elapsed_s").alias("last"))
    so_far = F.sum("bytes").over(Window.partitionBy("profile_key").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    placed = by_step.withColumn("offset", F.coalesce(so_far, F.lit(0))).filter(F.col("offset") < download_bytes)
    reaches = F.col("offset") + F.col("bytes") >= download_bytes
    order = Window.partitionBy("profile_key").orderBy("elapsed_s", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    last = own.join(placed.filter(reaches).select("profile_key", "step", "offset"), ["profile_key", "step"])
    last = last.withColumn("before", F.col("offset") + F.coalesce(F.sum("bytes").over(order), F.lit(0))).filter(F.col("before") < download_bytes)
    parts = placed.filter(~reaches).select("profile_key", "step", "bytes", "last").union(last.select("profile_key", "step", "bytes", F.col("elapsed_s").alias("last")))
    sums = parts.groupBy("profile_key", F.floor(F.col("step") / steps).cast("int").alias("win")).agg(F.sum("bytes").alias("bytes"), F.max("last").alias("last"))
    total = sums.groupBy("profile_key").agg(F.max("win").alias("top"), F.max("last").alias("end"), F.sum("bytes").alias("received"), F.sort_array(F.collect_list(F.struct("win", "bytes"))).alias("has"))
    dense = total.select("profile_key", "top", "end", "received", F.map_from_entries("has").alias("has"), F.explode(F.when(F.col("top") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("top")))).alias("win"))
    begin = warmup + F.col("win") * width
    span = F.when(F.col("win") < 0, F.col("end")).when(F.col("win") == F.col("top"), F.least(F.lit(width), F.col("end") - begin)).otherwise(F.lit(width))
    size = F.coalesce(F.try_element_at("has", F.col("win")), F.lit(0))
    return dense.select("profile_key", "win", size.alias("bytes"), span.alias("seconds"), (size / 1024 / F.greatest(span, F.lit(1e-6))).alias("kbps"), "received")


def transfer_stats(windows: DataFrame) -> DataFrame:
    """One row for each profile. mean and steadiness are not rounded: score and verdict use these."""
    n, mean = F.count(F.lit(1)), F.sum("bytes") / 1024 / F.greatest(F.sum("seconds"), F.lit(1e-6))
    steady = F.when(n < 2, 1.0).when(mean > 0, F.least(F.min("kbps") / mean, F.lit(1.0))).otherwise(0.0)
    return windows.groupBy("profile_key").agg(
        half_even(mean, 1).alias("mean_kbps"),
        half_even(F.max("kbps"), 1).alias("peak_kbps"),
        F.when(n >= 2, half_even(F.stddev_pop("kbps"), 1)).alias("jitter"),
        half_even(steady, 3).alias("stability"),
        F.max("received").alias("total_bytes"),
        mean.alias("mean"),
        steady.alias("steadiness"),
    )


def quality_score(mean: Column, steadiness: Column, latency: Column, target: float = 2000.0) -> Column:
    speed = F.least(F.coalesce(mean, F.lit(0.0)) / target, F.lit(1.0)) * 100
    steady = F.least(F.greatest(F.coalesce(steadiness, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 100
    return half_even(0.6 * speed + 0.25 * steady + 0.15 * F.least(F.coalesce(latency, F.lit(NEUTRAL_LATENCY)), F.lit(100.0)), 1)


def quality_grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").otherwise("D")


def speed_verdict(*, minimum: float = 200.0, enough: int = 262_144, min_stability: float = 0.0) -> Column:
    """Null if the transfer passes; decided before rounding."""
    unstable = F.when(F.col("steadiness") < min_stability, "unstable_endpoint") if min_stability > 0 else F.lit(None).cast("string")
    return F.when(F.col("mean") < minimum, "slow_endpoint").when(F.col("total_bytes") < enough, "insufficient_data").otherwise(unstable)


UNSUPPORTED = "speed_unsupported"


def speed_gate(profiles: DataFrame, outcomes: DataFrame, mode: str = "best_effort") -> DataFrame:
    """profiles with ``reason``: measured ones keep their verdict; unsupported ones, and those
    without an outcome, stay in best effort and go as ``speed_unmeasured`` in strict mode."""
    joined = profiles.join(outcomes.select("profile_key", F.col("reason").alias("_verdict"), F.lit(True).alias("_measured")), "profile_key", "left")
    missing = F.lit(None).cast("string") if mode == "best_effort" else F.lit("speed_unmeasured")
    measured = F.col("_measured").isNotNull() & (F.col("_verdict").isNull() | (F.col("_verdict") != UNSUPPORTED))
    return joined.withColumn("reason", F.when(measured, F.col("_verdict")).otherwise(missing)).drop("_verdict", "_measured")


def speed_summary(outcomes: DataFrame, mode: str = "best_effort") -> DataFrame:
    """One row. All outcomes are tested, unsupported ones too; speeds, stability and grades are of
    those that passed."""
    passed = F.col("reason").isNull()
    speed = F.when(passed, F.col("mean_kbps"))
    kept = F.count_if(F.col("reason") == UNSUPPORTED) if mode == "best_effort" else F.lit(0).cast("long")
    return outcomes.withColumn("_speed", speed).agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
        kept.alias("unsupported_kept"),
        F.coalesce(half_even(F.median("_speed"), 1), F.lit(0.0)).alias("median_kbps"),
        F.coalesce(half_even(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY _speed)"), 1), F.lit(0.0)).alias("p90_kbps"),
        half_even(F.avg(F.when(passed, F.col("stability"))), 3).alias("avg_stability"),
        *(F.count_if(passed & (F.col("grade") == g)).alias(f"grade_{g.lower()}") for g in "ABCD"),
    )
