"""Pool, channels, extraction and streams."""

import json
import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluiceway import catalog
from sluiceway.operators import channels, extract, probes, profiles, publish
from sluiceway.sources import tables, versions
from sluiceway.streaming import jobs

NOW = datetime(2026, 8, 15, 12)
POOL = "protocol string, fingerprint string, uri string, first_added_at timestamp, last_seen_at timestamp, hits int"


def test_merge_and_cap(spark):
    d = lambda n: datetime(2026, 8, n)
    pool = spark.createDataFrame([("vless", "a", "u1", d(1), d(1), 1), ("vless", "b", "u2", d(1), d(5), 1), ("vless", "c", "u3", d(1), d(3), 1)], POOL)
    kept = publish.enforce_cap(pool, 2)
    assert {r.fingerprint for r in kept.collect()} == {"b", "c"}
    merged = publish.merge_pool(pool, spark.createDataFrame([("vless", "a", "new"), ("trojan", "z", "t")], "protocol string, fingerprint string, uri string"), NOW)
    rows = {r.fingerprint: (r.uri, r.hits, r.change) for r in merged.collect()}
    assert rows == {"a": ("u1", 2, "refreshed"), "b": ("u2", 1, "carried"), "c": ("u3", 1, "carried"), "z": ("t", 1, "added")}


def test_cycle(spark):
    def roll(start, empty=False):
        return tuple(publish.roll_cycle(spark.createDataFrame([(start, 1)], "cycle_started_at string, generation int"), empty, NOW).first())

    assert roll("2026-08-10T12:00:00Z")[1:] == (1, False)
    assert roll("2026-08-09T11:00:00Z") == ("2026-08-15T12:00:00Z", 2, True)
    assert roll("not-a-date")[1:] == (2, True)
    assert roll("1970-01-01T00:00:00Z", True) == ("2026-08-15T12:00:00Z", 1, False)


METRICS = "handle string, preview_available boolean, fresh_posts int, all_uri_candidates int, supported_candidates int, static_accepted int, unique_profiles int, duplicate_posts int, posts_with_profiles int, total_text_length int, span_hours double, deep_passed int, deep_failed int"


def test_channel_ladder(spark):
    s = channels.ChannelSettings(approval_score=55, min_evidence_runs=2, min_supported_candidates=2, min_fresh_posts=2)
    rows = {"healthy": (2, 2, 2, 2, 2, 0, 2, 2), "modest": (2, 12, 2, 1, 1, 0, 1, 1), "low": (2, 20, 2, 1, 1, 0, 0, 2), "empty": (0, 0, 0, 0, 0, 0, 0, 0)}
    data = [(h, True, p, a, u, c, n, d, w, 0, 0.0, dp, 0) for h, (p, a, u, c, n, d, w, dp) in rows.items()]
    scored = spark.createDataFrame(data, METRICS).withColumn("run_score", channels.run_score(s)).withColumn("population_median", F.lit(None).cast("double"))
    state = spark.createDataFrame([], "key string, status string, score double, reason string, evidence_runs int, confidence double, required_score double, first_seen_at timestamp, last_evaluated_at timestamp, runs_since_evaluation int")
    out = {r.handle: r.status for r in channels.evaluate_channels(scored, state, F.lit(NOW), s).collect()}
    assert out == {"healthy": "approved", "modest": "candidate", "low": "candidate", "empty": "candidate"}


STATE = "key string, status string, score double, reason string, evidence_runs int, confidence double, required_score double, deep_accepted long, deep_rejected long, first_seen_at timestamp, last_seen_at timestamp, last_evaluated_at timestamp, runs_since_evaluation int"
STATE_COLUMNS = [f.split()[0] for f in STATE.split(", ")]


def test_fold_equals_steps(spark):
    """Folding all runs gives what evaluating and updating run by run gives, unavailable previews too."""
    runs = []
    for run in range(1, 6):
        for h in range(4):
            runs.append((f"chan_{h}", run, datetime(2026, 8, run), (run + h) % 4 != 0, 1 + (run * h) % 4, 4, 1 + run % 3, 1, 1, 0, 1, 40 * run, 12.0, 1, h))
    schema = "handle string, run long, observed_at timestamp, preview_available boolean, fresh_posts int, all_uri_candidates int, supported_candidates int, static_accepted int, unique_profiles int, duplicate_posts int, posts_with_profiles int, total_text_length int, span_hours double, deep_passed int, deep_failed int"
    df = spark.createDataFrame(runs, schema).withColumn("run_score", channels.run_score()).withColumn("population_median", F.when(F.col("run") % 2 == 0, 50.0))
    told = ["status", "reason", "score", "evidence_runs", "confidence", "required_score", "deep_accepted", "deep_rejected"]
    folded = {(r.handle, r.run): tuple(r[c] for c in told) for r in channels.fold_channel_runs(df).collect()}
    state = spark.createDataFrame([], STATE)
    for run in range(1, 6):
        ev = channels.evaluate_channels(df.filter(F.col("run") == run), state, F.lit(datetime(2026, 8, run)))
        got = {r.handle: tuple(r[c] for c in told) for r in ev.collect()}
        assert got == {h: folded[h, run] for h in got} and len(got) == 4
        state = spark.createDataFrame(channels.update_channel_state(state, ev).select(STATE_COLUMNS).collect(), STATE)


def test_fold_keeps_unavailable_channels(spark):
    columns = "handle string, run long, observed_at timestamp, preview_available boolean, fresh_posts int, posts_with_profiles int, supported_candidates int, run_score double, population_median double, deep_passed int, deep_failed int"
    rows = [("a_room", 1, datetime(2026, 8, 1), True, 9, 9, 9, 90.0, None, 3, 1), ("a_room", 2, datetime(2026, 8, 2), False, 0, 0, 0, 0.0, None, 0, 0), ("b_room", 1, datetime(2026, 8, 1), False, 0, 0, 0, 5.0, None, 0, 0)]
    got = {(r.handle, r.run): (r.status, r.reason, r.score, r.evidence_runs, r.deep_accepted) for r in channels.fold_channel_runs(spark.createDataFrame(rows, columns)).collect()}
    assert got == {("a_room", 1): ("approved", "approved", 90.0, 1, 3), ("a_room", 2): ("approved", "preview_unavailable", 90.0, 1, 3), ("b_room", 1): ("candidate", "insufficient_evidence", 5.0, 1, 0)}


def test_rounding(spark):
    """Columns, arrays and DuckDB round alike."""
    import duckdb
    import numpy as np

    from sluiceway.functions.numbers import half_even

    x = [0.125, 2.675, 0.375, -0.125, 1.0, 72.835, 8.345, 1.005] + np.random.default_rng(1).uniform(-9, 99, 2000).round(3).tolist()
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(half_even(F.col("x"), 2)).collect()]
    assert got == np.round(np.array(x), 2).tolist() == [duckdb.execute("SELECT round_even(?::DOUBLE, 2)", [v]).fetchone()[0] for v in x]
    assert got[:4] == [0.12, 2.68, 0.38, -0.12]


def test_summary_counts_due_channels_alone(spark):
    names = lambda *x: spark.createDataFrame([(h,) for h in x], "handle string")
    key = lambda h: __import__("hashlib").sha256(h.encode()).hexdigest()
    state = spark.createDataFrame([(key(h), status, n) for h, status, n in (("a", "watch", 2), ("b", "watch", 1), ("c", "excluded", 9), ("d", "approved", 5))], "key string, status string, runs_since_evaluation int")
    due = channels.due_channels(names("a", "b", "c", "d", "e", "a"), names("d", "f"), state)
    assert {r.handle for r in due.collect()} == {"a"}
    assert {r.handle for r in channels.evaluation_targets(names("d", "f"), due).collect()} == {"a", "d", "f"}
    metrics = spark.createDataFrame([(1, 1, 1, 1)], "supported_candidates int, static_accepted int, unique_profiles int, deep_passed int")
    row = channels.telegram_summary(names("d", "f"), due, names("d").withColumn("status", F.lit("approved")), metrics).first()
    assert (row.discovered_channels, row.reevaluated_channels, row.approved_channels) == (2, 1, 1)


def test_speed_summary_is_of_passed_outcomes(spark):
    rows = [(1000.0, 0.9, "C", None), (50.0, 0.5, "D", "slow_endpoint"), (60.0, 0.5, "D", "slow_endpoint"), (None, None, None, "speed_unsupported")]
    outcomes = spark.createDataFrame(rows, "mean_kbps double, stability double, grade string, reason string")
    row = probes.speed_summary(outcomes).first()
    assert (row.tested, row.passed, row.failed, row.unsupported_kept, row.median_kbps, row.p90_kbps, row.avg_stability, row.grade_c, row.grade_d) == (4, 1, 3, 1, 1000.0, 1000.0, 0.9, 1, 0)
    none = probes.speed_summary(outcomes.filter("mean_kbps < 100"), "strict").first()
    assert (none.unsupported_kept, none.median_kbps, none.p90_kbps, none.avg_stability) == (0, 0.0, 0.0, None)


def test_windows_of_transfers(spark):
    """Two seconds each after the warm-up; a mean just under the limit fails though it rounds to it."""
    rows = [("slow", 0.5, 100_000), ("slow", 2.75, 409_518), ("early", 0.25, 2048), ("early", 0.5, 2048), ("budget", 0.75, 1_999_999), ("budget", 1.75, 10), ("budget", 1.8, 10), ("gap", 0.5, 1), ("gap", 6.75, 1024), ("late", 9.0, 5)]
    rows += [("hot", 0.75 + i / 500, 100) for i in range(1, 4001)]
    samples = spark.createDataFrame(rows, "profile_key string, elapsed_s double, bytes long").repartition(5)
    windows = probes.transfer_windows(samples)
    got = {(r.profile_key, r.win): (r.bytes, round(r.seconds, 6), r.received) for r in windows.filter("profile_key <> 'hot'").collect()}
    assert got == {("slow", 0): (409_518, 2.0, 509_518), ("early", -1): (4096, 0.5, 4096), ("budget", 0): (10, 1.0, 2_000_009), ("gap", 0): (0, 2.0, 1025), ("gap", 1): (0, 2.0, 1025), ("gap", 2): (1024, 2.0, 1025)}
    assert {r.win: r.bytes for r in windows.filter("profile_key = 'hot'").collect()} == {w: 100_000 for w in range(4)}
    stats = {r.profile_key: r for r in probes.transfer_stats(windows).withColumn("reason", probes.speed_verdict()).collect()}
    assert stats["slow"].mean_kbps == 200.0 and stats["slow"].reason == "slow_endpoint" and stats["slow"].stability == 1.0 and stats["gap"].stability == 0.0
    assert stats["budget"].reason == "slow_endpoint" and stats["early"].mean_kbps == 8.0 and stats["early"].jitter is None
    cut = {r.win: r.bytes for r in probes.transfer_windows(samples.filter("profile_key = 'hot'"), download_bytes=123_450).collect()}
    assert cut == {0: 100_000, 1: 23_500}


def test_handles(spark):
    import base64

    packed = base64.urlsafe_b64encode("ask at telegram.me/Deep_Well, ok".encode()).decode().rstrip("=")
    texts = {
        "a @Alpha1, and (@Bravo_2) or mail@Charlie": {"alpha1", "bravo_2"},
        "ends with @Delta4. or @Delta5- but /@Echo_5": {"echo_5"},
        "HTTP://T.ME/s/Foxtrot?before=3 t.me/c/12345 t.me/+Golfgolf": {"foxtrot"},
        "telegram://resolve?start=1&domain=Hotel_8&x=2": {"hotel_8"},
        "x=%2540India9%20": {"india9"},
        "x=%40India9&amp;y": set(),
        "see%20%40India9%20": {"india9"},
        f"https://h.example/x#y?data={packed}": {"deep_well"},
        f"noise {packed} noise": {"deep_well"},
        f"{packed[:-1]}!": set(),
        "x:@Juliet1?y=@Kilo_12": {"juliet1", "kilo_12"},
        "go @Lima_12#x": {"lima_12"},
        "q?a=@Mike_12+b": {"mike_12"},
        "@Novem1\nber": {"novem1", "novem1ber"},
        "": set(),
        None: set(),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_idx int, text string")
    got = {i: set() for i in range(len(texts))}
    for r in extract.extract_handles(docs).collect():
        got[r.doc_idx].add(r.handle)
    assert list(got.values()) == list(texts.values())


def test_variants():
    assert extract.variants_of("a&amp;b%20c", 0) == [("a&b c", 0)]
    found = dict(extract.variants_of("s://h/p%2520q?k=&l=v%2541#f?m=n"))
    assert {k: found[k] for k in ("s://h/p%20q?k=&l=v%41#f?m=n", "/p q", "vA", "n")} == {"s://h/p%20q?k=&l=v%41#f?m=n": 0, "/p q": 1, "vA": 1, "n": 1}


def _message(number, inside, attributes=""):
    return f'<section class="x tgme_widget_message" data-post="room/{number}" {attributes}>{inside}</section>'


def test_dates_and_texts_of_pages(spark):
    at = datetime(2026, 8, 15, 9)
    stamp = int((at - datetime(1970, 1, 1)).total_seconds())
    dated = {
        1: '<p>t</p><time datetime="2026-08-15T09:00:00Z">x</time>',
        2: '<p>t</p><i data-when="no" data-timestamp="' + str(stamp) + '"></i>',
        3: '<p>t</p><b title="seen 2026-08-15T11:00:00+02:00 here">b</b>',
        4: "<p>t</p><script>var t = " + str(stamp * 1000) + ";</script>",
        5: '<p>t</p><time>2026-08-15T09:00:00+00:00</time>',
        6: '<p aria-label="2026-08-15T09:00:00Z">t</p><time datetime="soon"></time>',
        7: '<p title="2026-08-15T09:00:00">no zone</p>',
    }
    texts = {
        11: ('<div class="js-message_text">one <b>two</b> one</div>', "one two one"),
        12: ('<pre>late</pre><div class="tgme_widget_message_text">first<br>line</div><pre>late</pre>', "first line late"),
        13: ("<p>no</p> <p>selector</p>", "no selector"),
        14: ('<div class="tgme_widget_message_caption"></div>', None),
    }
    page = "".join(_message(n, x) for n, x in dated.items()) + "".join(_message(n, x, 'data-time="2026-08-15T09:00:00Z"') for n, (x, _) in texts.items())
    page += _message("12a", "<p>t</p>", 'data-time="2026-08-15T09:00:00Z"')
    page += _message(20, '<p>t</p><a href="u1" data-link="u2">x</a><img src="no"><a data-telegram-url="u3" href="u1"></a>', 'href="own" data-time="2026-08-15T09:00:00Z"')
    posts = {r.message_id: r for r in extract.parse_posts(spark.createDataFrame([("room1", 1, page), ("room1", 2, None)], "handle string, page_no int, html string")).collect()}
    assert set(posts) == {str(n) for n in [*range(1, 7), 11, 12, 13, 20]} and all(p.published_at == at for p in posts.values())
    assert all(posts[str(n)].text == want for n, (_, want) in texts.items() if want) and posts["20"].hrefs == ["u1", "u2", "u3"]


def test_fresh_posts_become_uris(spark):
    page = _message(7, '<code>TROJAN://a@b:1).</code><a href="x://q?u=hy2%3A%2F%2Fc@d:2">l</a>', 'data-time="2026-08-15T09:00:00Z"') + _message(6, "<p>stale hy2://e@f:3</p>", 'data-time="2026-08-02T09:00:00Z"')
    page += _message("9" * 30, "<p>trojan://A@B:1 vless://g@h:4</p>", 'data-time="2026-08-15T08:00:00Z"')
    kept = extract.page_posts(extract.parse_posts(spark.createDataFrame([("room1", 1, page)], "handle string, page_no int, html string")), F.lit(NOW))
    assert [tuple(r) for r in extract.extract_uris(kept).orderBy("ordinal").collect()] == [("room1", 1, "TROJAN://a@b:1"), ("room1", 2, "hy2://c@d:2"), ("room1", 3, "vless://g@h:4")]


def test_page_walk(spark):
    """Channels by what their pages are: fresh posts (ids), nothing (an empty list) or a failure (None)."""
    walks = {
        "whole": [["1", "2", "2"], ["2", "3"], ["4"]],
        "empty_middle": [["1"], [], ["2"]],
        "only_known": [["1"], ["1"], ["2"]],
        "first_failed": [None, ["1"]],
        "middle_failed": [["1"], None, ["2"]],
        "first_empty": [[], ["1"]],
    }
    pages = [(h, n + 1, None if p is not None else "timeout") for h, w in walks.items() for n, p in enumerate(w)]
    posts = [(h, n + 1, i, m, NOW) for h, w in walks.items() for n, p in enumerate(w) for i, m in enumerate(p or [])]
    posts.append(("first_empty", 1, 0, "9", datetime(2026, 8, 1)))  # stale
    pages, posts = spark.createDataFrame(pages, "handle string, page_no int, reason string"), spark.createDataFrame(posts, "handle string, page_no int, pos int, message_id string, published_at timestamp")
    kept, walked = extract.page_walk(pages, posts, F.lit(NOW))
    ids = {}
    for r in kept.orderBy("page_no", "pos").collect():
        ids.setdefault(r.handle, []).append((r.page_no, r.message_id))
    assert ids == {"whole": [(1, "1"), (1, "2"), (1, "2"), (2, "3"), (3, "4")], "empty_middle": [(1, "1")], "only_known": [(1, "1")], "middle_failed": [(1, "1")]}
    assert {r.handle: (r.available, r.pages_read, r.stop_page) for r in walked.collect()} == {"whole": (True, 3, None), "empty_middle": (True, 2, 2), "only_known": (True, 2, 2), "first_failed": (False, 0, 1), "middle_failed": (True, 1, 2), "first_empty": (True, 1, 1)}
    assert {r.handle for r in extract.page_walk(pages, posts, F.lit(NOW), max_pages=1)[0].filter("page_no > 1").collect()} == set()


def test_lines_between_blanks(spark):
    texts = ["\ttrojan://a \r\n\u00a0HY2://b\x1f\nvmess://c\nvless://d\rvless://e\ntrojan://a", "\ufeffvless://[::1]:1\nvless://[::1:1\nvless://::1]:1\nvless://x[::1]:1\nvless://[name]:1\nvless://u@[v1.x]:1", None, ""]
    rows = extract.document_lines(spark.createDataFrame(list(enumerate(texts)), "doc_idx int, text string")).collect()
    assert sorted((r.doc_idx, r.line_idx, r.line) for r in rows) == [(0, 0, "trojan://a"), (0, 1, "HY2://b"), (0, 2, "vless://d\rvless://e"), (1, 0, "vless://[::1]:1"), (1, 1, "vless://u@[v1.x]:1")]


def test_stored_pool(spark):
    key = "a" * 64
    text = f'{{"schema":1,"protocols":{{"vless":{{"{key}":{{"uri":"u","first_added_at":"x","last_seen_at":"y","hits":0}},"short":{{"uri":"u","first_added_at":"x","last_seen_at":"y"}}}}}}}}'
    assert [tuple(r) for r in tables.load_pool(spark.createDataFrame([(text,), ('{"schema":2}',)], "value string")).collect()] == [("vless", key, "u", "x", "y", 1)]


def test_files_round_trip(spark):
    root = tempfile.mkdtemp(prefix="spark-sluiceway-")
    pool = spark.createDataFrame([("vless", "u2", 2), ("vless", "u1", 1), ("trojan", "t", 1)], "protocol string, uri string, place int")
    tables.write_protocol_files(pool, f"{root}/out")
    back = spark.read.text(f"{root}/out")
    assert spark.read.text(f"{root}/out/protocol=hysteria2").isEmpty()
    assert [r.value for r in back.filter("protocol = 'vless'").collect()] == ["u1", "u2"]
    tables.write_registry(spark.createDataFrame([("B_chan_name",), ("a_chan_name",)], "handle string"), f"{root}/reg")
    assert sorted(r.handle for r in tables.read_registry(spark.read.text(f"{root}/reg")).collect()) == ["a_chan_name", "b_chan_name"]


def test_stored_cycle(spark):
    texts = ['{"schema":1,"cycle_started_at":"2026-08-10T00:00:00Z","generation":3}', '{"schema":1,"cycle_started_at":5,"generation":"4"}', '{"schema":2,"generation":7}', '{"schema":1,"generation":0}', "broken"]
    got = [tuple(r) for r in tables.pool_cycle(spark.createDataFrame([(t,) for t in texts], "value string")).collect()]
    assert got == [("2026-08-10T00:00:00Z", 3)] + [("1970-01-01T00:00:00Z", 1)] * 4


GOOD = {"status": "watch", "score": 41.236, "reason": "r", "evidence_runs": 2, "first_seen_at": "2026-08-01T00:00:00Z", "last_seen_at": "2026-08-13T00:00:00Z", "last_evaluated_at": "2026-08-13T00:00:00Z", "confidence": 1, "required_score": 50, "deep_accepted": 0, "deep_rejected": 4, "runs_since_evaluation": 0}


def test_stored_channels(spark):
    bad = [{"score": "41"}, {"score": 101}, {"evidence_runs": 1.5}, {"evidence_runs": True}, {"reason": ""}, {"first_seen_at": 3}, {"status": "other"}, {"deep_rejected": -1}, {"last_seen_at": "soon"}]
    channels_of = {"k" * 63 + "0": GOOD, "short": GOOD} | {"k" * 63 + str(n + 1): GOOD | b for n, b in enumerate(bad)}
    channels_of["m" * 64] = {k: v for k, v in GOOD.items() if k != "reason"}
    text = [json.dumps({"version": v, "channels": channels_of}) for v in (5, 4)]
    rows = tables.parse_channel_state(spark.createDataFrame([(t,) for t in text], "value string")).collect()
    assert [(r.key, r.score, r.confidence, r.required_score, r.deep_rejected, r.last_seen_at) for r in rows] == [("k" * 63 + "0", 41.24, 1.0, 50.0, 4, datetime(2026, 8, 13))]


def test_channel_state_round_trip(spark):
    """Stored JSON, evaluation, update, stored again and read: typed rows all the way."""
    root = tempfile.mkdtemp(prefix="spark-sluiceway-")
    handles = ["alpha_room", "bravo_room", "charlie_room"]
    key = lambda h: __import__("hashlib").sha256(h.encode()).hexdigest()
    text = json.dumps({"version": 5, "run_index": 3, "channels": {key(h): GOOD | {"score": 40.0 + i} for i, h in enumerate(handles)}})
    state = tables.parse_channel_state(spark.createDataFrame([(text,)], "value string"))
    data = [(h, i == 0, 5, 5, 5, 5, 5, 0, 5, 500, 24.0, 5, 0) for i, h in enumerate([*handles[:2], "delta_room"])]
    scored = spark.createDataFrame(data, METRICS).withColumn("run_score", channels.run_score()).withColumn("population_median", F.lit(50.0))
    new = channels.update_channel_state(state, channels.evaluate_channels(scored, state, F.lit(NOW)))
    tables.write_channel_state(new.repartition(3), f"{root}/state", 4, F.lit(NOW))
    back, run_index = tables.read_channel_state(spark, f"{root}/state")
    rows = lambda df: sorted(tuple(r[c] for c in STATE_COLUMNS) for r in df.collect())
    assert run_index == 4 and rows(back) == rows(new) and len(rows(new)) == 4
    assert {r.key: (r.runs_since_evaluation, r.reason, r.last_seen_at) for r in back.collect()}[key("bravo_room")] == (0, "preview_unavailable", NOW)
    assert {r.key: (r.runs_since_evaluation, r.last_seen_at) for r in back.collect()}[key("charlie_room")] == (1, datetime(2026, 8, 13))
    import glob

    document = json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{root}/state/part-*"))))
    assert document["version"] == 5 and document["generated_at"] == "2026-08-15T12:00:00Z" and list(document["channels"]) == sorted(key(h) for h in [*handles, "delta_room"])
    again = tables.parse_channel_state(spark.createDataFrame([(json.dumps(document),)], "value string"))
    assert rows(again) == rows(new)
    tables.write_channel_state(spark.createDataFrame([], new.schema), f"{root}/none", 1, F.lit(NOW))
    assert tables.read_channel_state(spark, f"{root}/none")[0].isEmpty()


def test_seen_state(spark):
    key = "b" * 64
    text = json.dumps({"records": {key: {"first_seen_at": "2026-08-01T00:00:00Z", "last_seen_at": "2026-08-02T00:00:00Z"}, "short": {"first_seen_at": "x", "last_seen_at": "y"}, "c" * 64: {"first_seen_at": "x"}}})
    seen = tables.load_seen_state(spark.createDataFrame([(text,)], "value string"))
    assert [tuple(r) for r in seen.collect()] == [(key, "2026-08-01T00:00:00Z", "2026-08-02T00:00:00Z")]
    typed = seen.select("fingerprint", *(F.to_timestamp(c).alias(c) for c in ("first_seen_at", "last_seen_at")))
    rows = publish.update_seen(typed, spark.createDataFrame([(key,), ("d" * 64,)], "fingerprint string"), NOW).collect()
    assert {r.fingerprint: (r.first_seen_at, r.last_seen_at) for r in rows} == {key: (datetime(2026, 8, 1), NOW), "d" * 64: (NOW, NOW)}


def test_versions(spark):
    root = tempfile.mkdtemp(prefix="spark-sluiceway-")
    assert tables.current_version(spark, root) is None and tables.load_state(spark, root) is None
    for version in (1, 2):
        tables.save_state(spark.range(version), root, version)
    spark.range(9).write.parquet(f"{root}/data/00000003-cut/state")  # cut short: not in the log
    assert tables.current_version(spark, root) == 2 and tables.load_state(spark, root).count() == 2
    tables.save_state(spark.range(5), root, 3)
    assert tables.load_state(spark, root).count() == 5
    versions.forget(spark, root, 2)
    assert versions._numbers(spark, root) == [2, 3] and tables.load_state(spark, root).count() == 5


def test_two_writers(spark, monkeypatch):
    """Both begin with version 1; only one gets 2, and the other merges into what that one left."""
    root = tempfile.mkdtemp(prefix="spark-sluiceway-")
    versions.commit({"state": spark.range(1)}, root, 1)
    monkeypatch.setattr(versions, "_numbers", lambda spark, root: [1])  # neither has seen the other
    versions.commit({"state": spark.range(2)}, root, 2)
    with pytest.raises(versions.Conflict):
        versions.commit({"state": spark.range(3)}, root, 2)
    monkeypatch.undo()
    assert tables.load_state(spark, root).count() == 2 and len(os.listdir(f"{root}/data")) == 2

    rows = lambda *x: spark.createDataFrame([("vless", f, f"u{f}") for f in x], "protocol string, fingerprint string, uri string")
    pool, real = f"{root}/pool", versions.commit
    jobs.accumulate(rows("a"), pool, NOW)

    def late(tables, root, number, note=None):
        monkeypatch.setattr(versions, "commit", real)
        jobs.accumulate(rows("b"), pool, NOW)  # another writer comes first
        return real(tables, root, number, note)

    monkeypatch.setattr(versions, "commit", late)
    assert jobs.accumulate(rows("a", "c"), pool, NOW + timedelta(hours=4))
    assert {r.fingerprint: r.hits for r in jobs.accumulated(spark, pool)[0].collect()} == {"a": 2, "b": 1, "c": 1}


def test_publication_order(spark):
    rows = [("vless", "tls", "ws", "b"), ("trojan", "tls", "ws", "c"), ("trojan", "reality", "ws", "d"), ("trojan", "tls", "tcp", "e"), ("trojan", "tls", "ws", "a")]
    df = spark.createDataFrame(rows, "protocol string, security string, transport string, fingerprint string")
    assert [r.fingerprint for r in publish.publication_order(df).collect()] == ["d", "e", "a", "c", "b"]


def test_publication(spark):
    rows = [(0, 0, "trojan", "a" * 64, "trojan://x@h:1", "tls", "ws"), (0, 1, "trojan", "b" * 64, "trojan://y@h:1", "tls", "tcp"), (1, 0, "trojan", "b" * 64, "trojan://z@h:1", "tls", "tcp")]
    found = spark.createDataFrame(rows, "doc_idx long, line_idx int, protocol string, fingerprint string, original_uri string, security string, transport string")
    old = datetime(2026, 8, 10)
    pool = spark.createDataFrame([("trojan", "a" * 64, "kept", old, old, 1), ("vless", "c" * 64, "other", old, old, 1)], POOL)

    def run(start):
        cycle = spark.createDataFrame([(start, 4)], "cycle_started_at string, generation int")
        new, rolled, report = publish.publish(found, pool, cycle, NOW)
        return sorted((r.protocol, r.place, r.uri.split("#")[0]) for r in new.collect()), tuple(rolled.first()), {r.protocol: tuple(r)[1:] for r in report.collect()}

    new, rolled, report = run("2026-08-11T00:00:00Z")
    assert new == [("trojan", 1, "kept"), ("trojan", 2, "trojan://y@h:1"), ("vless", 1, "other")] and rolled == ("2026-08-11T00:00:00Z", 4)
    assert report == {"trojan": (1, 1, 0, 2, 1, 5, 2, 4, False), "vless": (0, 0, 0, 1, 1, 5, 2, 4, False), "hysteria2": (0, 0, 0, 0, 0, 5, 2, 4, False)}
    new, rolled, report = run("2026-08-01T00:00:00Z")
    assert new == [("trojan", 1, "trojan://y@h:1"), ("trojan", 2, "trojan://x@h:1")] and rolled == ("2026-08-15T12:00:00Z", 5)
    assert report["trojan"] == (2, 0, 0, 2, 0, 1, 6, 5, True) and report["vless"] == (0, 0, 0, 0, 0, 1, 6, 5, True)


def _reads_of_lines(monkeypatch):
    """A list that grows with each time a query takes the lines."""
    taken, lines = [], catalog._lines
    monkeypatch.setattr(catalog, "_lines", lambda *a: taken.append(a) or lines(*a))
    return taken


def test_publication_parses_lines_once(spark, monkeypatch):
    taken = _reads_of_lines(monkeypatch)
    report = catalog.QUERIES["g9_publish"](spark, "/root/testdata/sf0.001")
    assert len(taken) == 1 and "lineitem" not in report._jdf.queryExecution().toString()  # done before, not again


def test_report_parses_lines_once(spark, monkeypatch):
    taken = _reads_of_lines(monkeypatch)
    report = catalog.QUERIES["a10_build_report"](spark, "/root/testdata/sf0.001")
    assert len(taken) == 1 and "original_uri" not in report._jdf.queryExecution().toString()
    assert report.columns == ["block", "body"]


def test_counts_of_a_tally(spark):
    rows = spark.createDataFrame([(True, None)] * 3 + [(True, "a"), (False, "b"), (False, "b")], "parsed boolean, reason string")
    few = profiles.tally(rows)
    assert tuple(profiles.filter_counts(few, F.col("n")).first()) == tuple(profiles.filter_counts(rows).first()) == (6, 4, 3)
    assert {tuple(r) for r in profiles.exclusion_counts(few, F.col("n")).collect()} == {tuple(r) for r in profiles.exclusion_counts(rows).collect()} == {("a", 1), ("b", 2)}
    assert tuple(profiles.filter_counts(profiles.tally(rows.filter("false")), F.col("n")).first()) == (0, 0, 0)


def _stream(spark, df, where):
    """df as a stream of the files in a folder, one file to a batch."""
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)


def _drained(writer, checkpoint):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_stream_of_the_pool_is_resumed(spark):
    root = tempfile.mkdtemp(prefix="spark-sluiceway-")
    parts = [[("vless", f"f{i}", f"u{i}") for i in x] for x in ((1, 2), (2, 3), (4,))]
    schema = "protocol string, fingerprint string, uri string"
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{root}/in/{n}")
    one = spark.createDataFrame([], schema)
    times = iter([NOW + timedelta(days=d) for d in (0, 1, 2, 9, 10, 11)])
    for n, checkpoint in ((0, "a"), (1, "a"), (2, "b")):  # the third one has a checkpoint of its own
        q = _drained(jobs.stream_accumulate(_stream(spark, one, f"{root}/in/{n}"), f"{root}/pool", lambda: next(times)), f"{root}/{checkpoint}-{n}")
    pool = {r.fingerprint: r.hits for r in jobs.accumulated(spark, f"{root}/pool")[0].collect()}
    assert pool == {"f1": 1, "f2": 2, "f3": 1, "f4": 1}
    query = str(q.id)
    assert not jobs.accumulate(one, f"{root}/pool", NOW, writer=query, batch_id=0)  # a repeated batch
    spark.createDataFrame([("vless", "f1", "x")], schema).coalesce(1).write.mode("append").parquet(f"{root}/in/2")
    _drained(jobs.stream_accumulate(_stream(spark, one, f"{root}/in/2"), f"{root}/pool", lambda: next(times)), f"{root}/b-2")  # a new cycle
    pool, cycle = jobs.accumulated(spark, f"{root}/pool")
    assert {r.fingerprint for r in pool.collect()} == {"f1"} and tuple(cycle.first()) == ("2026-08-24T12:00:00Z", 2)
    jobs.accumulate(spark.createDataFrame(parts[0], schema), f"{root}/pool", NOW + timedelta(days=10))  # a batch job goes on with it
    assert {r.fingerprint: r.hits for r in jobs.accumulated(spark, f"{root}/pool")[0].collect()} == {"f1": 2, "f2": 1}


def test_accumulate_query_is_not_capped(spark):
    root = tempfile.mkdtemp(prefix="spark-sluiceway-")
    orders = spark.range(30_003).selectExpr("id AS o_orderkey", "id * 3 % 30003 AS o_custkey")
    orders.write.parquet(f"{root}/orders.parquet")
    assert catalog.QUERIES["s2_stream_accumulate"](spark, root).count() == orders.select("o_custkey").distinct().count()


def test_stream_of_first_seen_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="spark-sluiceway-")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        batches = [(NOW, "abca"), (NOW + timedelta(days=1), "bd"), (NOW + timedelta(hours=1), "ad")]
        state = spark.createDataFrame([], "fingerprint string, first_seen_at timestamp, last_seen_at timestamp")
        for n, (at, names) in enumerate(batches):
            now = spark.createDataFrame([(x, at) for x in names], "fingerprint string, seen_at timestamp")
            now.coalesce(1).write.mode("append").parquet(f"{root}/in")
            state = spark.createDataFrame(publish.update_seen(state, now, at).collect(), state.schema)
            out = jobs.stream_first_seen(_stream(spark, now, f"{root}/in")).writeStream.outputMode("update").foreachBatch(lambda b, i, n=n: b.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{root}/out"))
            _drained(out, f"{root}/cp")
        last = {r.fingerprint: (r.first_seen_at, r.last_seen_at) for r in spark.read.parquet(f"{root}/out").orderBy("n").collect()}
        want = {r.fingerprint: (r.first_seen_at, r.last_seen_at) for r in state.collect()}
        assert last | {"d": None} == want | {"a": (NOW, NOW + timedelta(hours=1)), "d": None}
        assert last["d"] == (NOW + timedelta(hours=1), NOW + timedelta(days=1))  # a late batch moves both ends
    finally:
        spark.conf.unset(provider)


def test_first_seen_state_stays_in_the_jvm(spark):
    """Many fingerprints in three batches of several files: no Python for each key of the state."""
    root = tempfile.mkdtemp(prefix="spark-sluiceway-")
    rows = spark.range(30_000).selectExpr("concat('f', id % 10000) AS fingerprint", "timestamp_seconds(id) AS seen_at")
    kept = []
    for n in range(3):
        rows.filter(f"floor(unix_seconds(seen_at) / 10000) = {n}").repartition(3).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        writer = jobs.stream_first_seen(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: kept.append({r.fingerprint: (r.first_seen_at.second, (r.last_seen_at - r.first_seen_at).seconds) for r in b.collect()}))
        q = _drained(writer, f"{root}/cp")
    assert q.lastProgress["stateOperators"][0]["operatorName"] == "stateStoreSave" and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 10_000
    assert [len(k) for k in kept] == [10_000] * 3 and kept[2]["f7"] == (7, 20_000)


def test_streams_of_posts(spark):
    """Posts once within the watermark, late ones dropped; days are given out once they have passed."""
    root = tempfile.mkdtemp(prefix="spark-sluiceway-")
    schema = "handle string, message_id string, published_at timestamp"
    day = lambda d: datetime(2026, 8, d, 12)
    batches = [[("c", "1", day(1)), ("c", "1", day(1)), ("d", "1", day(1))], [("c", "2", day(9)), ("c", "1", day(1))], [("c", "3", day(2)), ("c", "4", day(9))], [("c", "5", day(20))]]
    fresh, activity = [], []
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(f"{root}/posts")
        posts = _stream(spark, df, f"{root}/posts")
        _drained(jobs.stream_fresh_posts(posts).writeStream.foreachBatch(lambda b, i: fresh.extend((r.handle, r.message_id) for r in b.collect())), f"{root}/cp1")
        _drained(jobs.stream_channel_activity(posts).writeStream.outputMode("append").foreachBatch(lambda b, i: activity.extend((r.handle, r.day.day, r.n) for r in b.collect())), f"{root}/cp2")
    assert sorted(fresh) == [("c", "1"), ("c", "2"), ("c", "4"), ("c", "5"), ("d", "1")]  # 3 came seven days late
    assert sorted(activity) == [("c", 1, 3), ("c", 9, 2), ("d", 1, 1)]
