"""Source channels: metrics of a run, score, adaptive threshold and status."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.numbers import half_even


@dataclass(frozen=True)
class ChannelSettings:
    """The model's default weights and limits."""

    approval_score: float = 45.0
    min_evidence_runs: int = 2
    min_supported_candidates: int = 1
    min_fresh_posts: int = 1
    minimum_confidence: float = 0.3
    new_channel_margin: float = 8.0
    near_threshold_margin: float = 12.0
    history_half_life_hours: float = 72.0
    prior_passes: float = 1.0
    prior_failures: float = 1.0
    evidence_discount: float = 2.0
    discount_floor: float = 15.0
    momentum_cap: float = 5.0
    relative_approval: bool = True
    relative_floor: float = 10.0
    activity: float = 15.0
    supported_yield: float = 15.0
    static_security: float = 20.0
    uniqueness: float = 10.0
    nonduplication: float = 5.0
    profile_coverage: float = 10.0
    text_depth: float = 5.0
    cadence: float = 5.0
    depth: float = 15.0


DEFAULTS = ChannelSettings()
HANDLE_KEY = "sha2(handle, 256)"
Getter = Callable[[str], Column]


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _share(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.greatest(F.lit(0.0), a.cast("double") / F.greatest(F.lit(1.0), b.cast("double")))


def cap_per_channel(profiles: DataFrame, n: int = 1000) -> DataFrame:
    first = Window.partitionBy("handle").orderBy("ordinal")
    return profiles.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= n).drop("_k")


def channel_metrics(posts: DataFrame, uris: DataFrame, profiles: DataFrame) -> DataFrame:
    """posts(handle, text, published_at, has_profile), uris(handle, supported),
    profiles(handle, parsed, accepted, capped, fingerprint) to one row for each handle."""
    by_post = posts.groupBy("handle").agg(
        F.count(F.lit(1)).alias("fresh_posts"),
        (F.count(F.lit(1)) - F.count_distinct("text")).alias("duplicate_posts"),
        F.count_if("has_profile").alias("posts_with_profiles"),
        F.sum(F.length("text")).alias("total_text_length"),
        ((F.unix_timestamp(F.max("published_at")) - F.unix_timestamp(F.min("published_at"))) / 3600).alias("span_hours"),
    )
    by_uri = uris.groupBy("handle").agg(F.count(F.lit(1)).alias("all_uri_candidates"), F.count_if("supported").alias("supported_candidates"))
    by_profile = profiles.groupBy("handle").agg(
        F.count_if("capped").alias("static_accepted"),
        F.count_distinct(F.when(F.col("capped"), F.col("fingerprint"))).alias("unique_profiles"),
        F.count_if("capped").alias("deep_passed"),
        (F.count_if("parsed") - F.count_if("capped")).alias("deep_failed"),
    )
    joined = by_post.join(by_uri, "handle", "left").join(by_profile, "handle", "left")
    return joined.na.fill(0).withColumn("preview_available", F.lit(True))


def run_score(s: ChannelSettings = DEFAULTS) -> Column:
    """Weighted mean of nine components, 0 to 100 and two decimals. Ratios other than the
    activity may exceed 1."""
    per_day = F.col("fresh_posts") * 24.0 / F.greatest(F.lit(24.0), F.col("span_hours"))
    cadence = F.when(F.col("fresh_posts") <= 0, 0.0).when(per_day < 1, per_day).when(per_day <= 12, 1.0).otherwise(_clamp(1 - (per_day - 12) / 36))
    passed, failed = F.col("deep_passed"), F.col("deep_failed")
    parts = [
        (s.activity, F.least(F.lit(1.0), _share("fresh_posts", F.lit(s.min_fresh_posts)))),
        (s.supported_yield, _share("supported_candidates", "all_uri_candidates")),
        (s.static_security, _share("static_accepted", "supported_candidates")),
        (s.uniqueness, _share("unique_profiles", "static_accepted")),
        (s.nonduplication, F.when(F.col("supported_candidates") < 2, 1.0).otherwise(_clamp(1 - _share("duplicate_posts", "supported_candidates")))),
        (s.profile_coverage, _share("posts_with_profiles", "fresh_posts")),
        (s.text_depth, _clamp((_share("total_text_length", "fresh_posts") - 24) / 176)),
        (s.cadence, cadence),
        (s.depth, (s.prior_passes + passed) / (s.prior_passes + s.prior_failures + passed + failed)),
    ]
    total = sum(w * c for w, c in parts[1:]) + parts[0][0] * parts[0][1]
    return half_even(total / sum(w for w, _ in parts) * 100, 2)


class _Columns:
    """What the ladder needs besides arithmetic, on Columns; null is unknown."""

    known, least, greatest, power = staticmethod(lambda x: x.isNotNull()), staticmethod(F.least), staticmethod(F.greatest), staticmethod(F.pow)
    number, both = staticmethod(F.lit), staticmethod(lambda a, b: F.coalesce(a, b))
    rounded = staticmethod(half_even)

    @staticmethod
    def where(cond: Column, a: Column | str, b: Column | str) -> Column:
        return F.when(cond, a).otherwise(b)

    @staticmethod
    def struct(**fields: Column) -> Column:
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    @staticmethod
    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        """body of a value that is computed once, however often the body reads it."""
        return F.element_at(F.transform(F.array(value), body), 1)


class _Arrays:
    """The same on numpy arrays; NaN is unknown."""

    known, power = staticmethod(lambda x: ~np.isnan(x)), staticmethod(np.power)
    number, where, struct = staticmethod(np.float64), staticmethod(np.where), staticmethod(dict)
    both = staticmethod(lambda a, b: np.where(np.isnan(a), b, a))
    let = staticmethod(lambda value, body: body(value))

    @staticmethod
    def least(*x):
        return reduce(np.minimum, x)

    @staticmethod
    def greatest(*x):
        return reduce(np.maximum, x)

    rounded = staticmethod(np.round)


def _within(x, low, high, o):
    return o.greatest(o.number(low), o.least(o.number(high), x))


def confidence(evidence, m: Getter, s: ChannelSettings = DEFAULTS, o=_Columns):
    one = o.number(1.0)
    share = o.greatest(o.number(0.0), m("posts_with_profiles") / o.greatest(one, m("fresh_posts")))
    return o.rounded(0.4 * o.least(one, evidence / max(1, s.min_evidence_runs)) + 0.3 * o.least(one, m("fresh_posts") / max(1, s.min_fresh_posts)) + 0.3 * share, 4)


def required_score(conf, evidence, previous, run, median, s: ChannelSettings = DEFAULTS, o=_Columns):
    extra = o.greatest(o.number(0.0), evidence - s.min_evidence_runs)
    bar = s.approval_score + (1 - conf) * s.new_channel_margin - o.least(o.number(s.discount_floor), s.evidence_discount * extra) - o.where(o.known(previous), _within(run - previous, 0.0, s.momentum_cap, o), o.number(0.0))
    if s.relative_approval:
        bar = o.where(o.known(median) & (run >= median), o.least(bar, median), bar)
    return o.rounded(_within(bar, max(0.0, s.approval_score - s.relative_floor), 100.0, o), 2)


def next_state(old: Getter, m: Getter, hours, s: ChannelSettings = DEFAULTS, o=_Columns):
    """status, reason, score, evidence_runs, confidence, required_score and the deep counters after a
    run with metrics m, ``hours`` after the last one; old gives the state before it, unknown for a
    new channel. A known channel whose preview is unavailable keeps its state."""
    known, run, median = o.known(old("evidence_runs")), m("run_score"), m("population_median")
    carried = known & ~m("preview_available")
    early = run >= s.approval_score + s.new_channel_margin
    if s.relative_approval:
        early = early | (o.known(median) & (run >= o.greatest(o.number(s.approval_score), median)))

    def judged(x):
        evidence, conf, bar, score = (x[k] for k in ("evidence_runs", "confidence", "required_score", "score"))
        near = (bar - score <= s.near_threshold_margin) | (known & (score > old("score")))
        ladder = [
            (carried, "/preview_unavailable"),
            ((evidence < s.min_evidence_runs) & early, "approved/approved"),
            (evidence < s.min_evidence_runs, "candidate/insufficient_evidence"),
            (m("fresh_posts") < s.min_fresh_posts, "excluded/insufficient_fresh_posts"),
            (m("supported_candidates") < s.min_supported_candidates, "excluded/insufficient_candidates"),
            (conf < s.minimum_confidence, "watch/insufficient_confidence"),
            (score >= bar, "approved/approved"),
            (near, "watch/near_threshold"),
        ]
        return reduce(lambda rest, step: o.where(step[0], step[1], rest), reversed(ladder), "excluded/below_approval_score")

    def told(x):
        pick = lambda name: o.where(carried, old(name), x[name])
        more = lambda name, new: o.both(old(name), o.number(0.0)) + o.where(carried, o.number(0.0), o.greatest(o.number(0.0), m(new)))
        numbers = {name: pick(name) for name in ("score", "evidence_runs", "confidence", "required_score")}
        return o.struct(verdict=judged(x), deep_accepted=more("deep_accepted", "deep_passed"), deep_rejected=more("deep_rejected", "deep_failed"), **numbers)

    def scored(x):
        keep = _within(o.power(o.number(0.5), o.greatest(o.number(1.0), hours) / s.history_half_life_hours), 0.0, 1.0, o) * _within(1 - x["confidence"] * 0.5, 0.2, 0.9, o)
        fresh = ~known | ((old("status") == "excluded") & (run >= x["required_score"]))
        blend = o.let(keep, lambda k: o.rounded(old("score") * k + run * (1 - k), 2))
        return o.let(o.struct(score=o.where(fresh, run, blend), **{k: x[k] for k in ("evidence_runs", "confidence", "required_score")}), told)

    def barred(x):
        bar = required_score(x["confidence"], x["evidence_runs"], old("score"), run, median, s, o)
        return o.let(o.struct(required_score=bar, **{k: x[k] for k in ("evidence_runs", "confidence")}), scored)

    count = o.both(old("evidence_runs"), o.number(0.0)) + 1
    return o.let(count, lambda n: o.let(o.struct(evidence_runs=n, confidence=confidence(n, m, s, o)), barred))


def evaluate_channels(metrics: DataFrame, state: DataFrame, now: Column, s: ChannelSettings = DEFAULTS) -> DataFrame:
    """metrics with run_score and population_median, left-joined with the state, to the new
    state rows. A channel whose preview is unavailable keeps its old row. The deep counters add
    up over all runs; a state without them counts as none before."""
    old = state.select(*(F.col(c).alias(f"old_{c}") if c != "key" else F.col(c) for c in state.columns))
    d = metrics.withColumn("key", F.expr(HANDLE_KEY)).join(old, "key", "left")
    before = lambda c: F.col(f"old_{c}") if c in state.columns else F.lit(None).cast("double")
    hours = (F.unix_timestamp(now) - F.unix_timestamp("old_last_evaluated_at")) / 3600
    d = d.withColumn("_new", next_state(before, F.col, hours, s))
    return d.select(
        "handle",
        "key",
        F.coalesce(F.nullif(F.substring_index("_new.verdict", "/", 1), F.lit("")), "old_status").alias("status"),
        "_new.score",
        F.substring_index("_new.verdict", "/", -1).alias("reason"),
        F.col("_new.evidence_runs").cast("int").alias("evidence_runs"),
        "_new.confidence",
        "_new.required_score",
        F.coalesce("old_first_seen_at", now).alias("first_seen_at"),
        now.alias("last_seen_at"),
        now.alias("last_evaluated_at"),
        F.col("_new.deep_accepted").cast("long").alias("deep_accepted"),
        F.col("_new.deep_rejected").cast("long").alias("deep_rejected"),
    )


def update_channel_state(state: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Evaluated rows replace theirs; all others have gone one more run without evaluation."""
    columns = [c for c in state.columns if c != "runs_since_evaluation"]
    new = evaluated.select(*columns).withColumn("runs_since_evaluation", F.lit(0))
    old = state.join(evaluated.select("key"), "key", "left_anti").withColumn("runs_since_evaluation", F.col("runs_since_evaluation") + 1)
    return old.select(new.columns).union(new)


def due_channels(registry: DataFrame, discovered: DataFrame, state: DataFrame, interval: int = 3) -> DataFrame:
    """Registered handles that this run has not discovered and that are due again."""
    pending = registry.select("handle").distinct().join(discovered, "handle", "left_anti").withColumn("key", F.expr(HANDLE_KEY))
    return pending.join(state.filter(f"status <> 'excluded' and runs_since_evaluation + 1 >= {int(interval)}").select("key"), "key", "left_semi").select("handle")


def evaluation_targets(discovered: DataFrame, due: DataFrame) -> DataFrame:
    return discovered.select("handle").union(due.select("handle")).distinct()


def approved_registry(evaluated: DataFrame, known: DataFrame, state: DataFrame) -> DataFrame:
    before = known.select("handle").distinct().join(evaluated, "handle", "left_anti").withColumn("key", F.expr(HANDLE_KEY)).join(state.filter("status = 'approved'").select("key"), "key", "left_semi")
    return evaluated.filter("status = 'approved'").select("handle").union(before.select("handle")).distinct()


def retained_registry(discovered: DataFrame, pending: DataFrame, evaluated: DataFrame) -> DataFrame:
    return discovered.select("handle").union(pending.select("handle")).distinct().join(evaluated.filter("status = 'excluded'").select("handle"), "handle", "left_anti")


def telegram_summary(discovered: DataFrame, due: DataFrame, evaluated: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row on a run's channels: counts of handles (``due``: those that are evaluated without
    having been discovered), and sums over their metrics."""
    found = discovered.agg(F.count_distinct("handle").alias("discovered_channels"))
    again = due.agg(F.count_distinct("handle").alias("reevaluated_channels"))
    approved = evaluated.agg(F.count_if(F.col("status") == "approved").alias("approved_channels"))
    parts = {"uri_candidates": "supported_candidates", "static_accepted_profiles": "static_accepted", "unique_profiles": "unique_profiles", "deep_accepted_profiles": "deep_passed"}
    sums = metrics.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in parts.items()))
    return found.crossJoin(again).crossJoin(approved).crossJoin(sums)  # one row each


_NUMBERS = ["score", "evidence_runs", "confidence", "required_score", "deep_accepted", "deep_rejected"]
_INPUTS = ["fresh_posts", "posts_with_profiles", "supported_candidates", "run_score", "population_median", "deep_passed", "deep_failed"]


def _scan(b: pd.DataFrame, before: dict[str, np.ndarray] | None, s: ChannelSettings) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """The states after each row of b, whose rows are sorted by handle and run, and the state of its last
    channel. before: the state of b's first channel. The k-th runs of all channels go together,
    so there are as many steps as the channel with the most runs has."""
    heads = np.flatnonzero(np.append(True, b["handle"].to_numpy()[1:] != b["handle"].to_numpy()[:-1]))
    sizes = np.diff(np.append(heads, len(b)))
    state = {c: np.full(len(heads), np.nan) for c in [*_NUMBERS, "at"]} | {"status": np.full(len(heads), "", object)}
    if before is not None:
        for c in state:
            state[c][0] = before[c]
    own = {c: b[c].to_numpy(np.float64, na_value=np.nan) for c in _INPUTS} | {"preview_available": b["preview_available"].fillna(False).to_numpy(bool)}
    at = b["observed_at"].to_numpy().astype("datetime64[s]").astype(np.float64)
    out = {c: np.full(len(b), np.nan) for c in _NUMBERS} | {c: np.full(len(b), "", object) for c in ("status", "reason")}
    for k in range(int(sizes.max())):
        live = np.flatnonzero(sizes > k)
        rows = heads[live] + k
        new = next_state(lambda c: state[c][live], lambda c: own[c][rows], (at[rows] - state["at"][live]) / 3600, s, _Arrays)
        status, reason = np.char.partition(np.asarray(new["verdict"], str), "/")[:, [0, 2]].T
        state["status"][live] = np.where(status == "", state["status"][live], status)
        state["at"][live] = at[rows]
        for c in _NUMBERS:
            state[c][live] = out[c][rows] = new[c]
        out["status"][rows], out["reason"][rows] = state["status"][live], reason
    return pd.DataFrame({"handle": b["handle"], "run": b["run"], **out}), {c: x[-1] for c, x in state.items()}


def fold_channel_runs(runs: DataFrame, s: ChannelSettings = DEFAULTS) -> DataFrame:
    """Many runs in order: runs(run, handle, observed_at, preview_available, metrics, run_score,
    population_median) to the evaluation of each. Run medians are known before, so channels are
    independent: rows sorted by channel and run are scanned with one state for each channel, which goes on
    from one batch of rows to the next."""
    needed = ["handle", "run", "observed_at", "preview_available", *_INPUTS]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            if len(b):
                found, after = _scan(b, state if last == b["handle"].iloc[0] else None, s)
                last, state = b["handle"].iloc[-1], after
                yield found.astype({"evidence_runs": int, "deep_accepted": int, "deep_rejected": int})[order]

    schema = "handle string, run long, status string, score double, reason string, evidence_runs int, confidence double, required_score double, deep_accepted long, deep_rejected long"
    order = [f.split()[0] for f in schema.split(", ")]
    own = runs.select(*(F.col(c).cast("long").alias(c) if c == "run" else F.col(c) for c in needed))
    return own.repartition("handle").sortWithinPartitions("handle", "run").mapInPandas(scan, schema)
