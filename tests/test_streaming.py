import datetime as dt

import pytest
from pyspark.sql import functions as F

from brookmill.streaming import endless, pageviews as pv

VIEWS = "ts timestamp, url string, status int, zip_code int, user_id int"


def at(second):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)


def views(spark, rows):
    return spark.createDataFrame([(at(t), u, s, z, w) for t, u, s, z, w in rows], VIEWS)


SOME = [(0, "a", 200, 1, 1), (0.5, "a", 404, 1, 2), (3, "b", 200, 2, 1), (3.2, "a", 200, 1, 1), (25, "b", 200, 2, 3)]


def starts(df, *cols):
    base = at(0).timestamp()
    return sorted((int(r["s"] - base), *[r[c] for c in cols]) for r in df.withColumn("s", F.unix_seconds("window.start")).collect())


def test_tumbling_and_sliding_counts(spark):
    df = views(spark, SOME)
    assert starts(pv.page_counts(df), "url", "views") == [(0, "a", 2), (3, "a", 1), (3, "b", 1), (25, "b", 1)]
    sliding = starts(pv.sliding_page_counts(df), "url", "views")
    assert (2, "a", 1) in sliding and (0, "a", 3) in sliding and (-8, "a", 2) in sliding
    assert not any(s == 4 and url == "a" for s, url, _ in sliding)


def test_error_rate_flags_only_above_five_percent(spark):
    rows = [(1, "a", 200, 9, i) for i in range(19)] + [(1, "a", 404, 9, 99)]
    five = pv.error_rates(views(spark, rows)).first()
    assert (five["error_rate"], five["is_alert"], five["mark"]) == (0.05, False, "")
    assert pv.error_rates(views(spark, rows), float_compare=True).first()["is_alert"]
    six = pv.error_rates(views(spark, rows[1:])).first()
    assert six["is_alert"] and six["mark"] == "**"


def test_active_users_exact_and_estimated(spark):
    df = views(spark, SOME)
    exact = starts(pv.active_users(df), "users")
    assert (-14, 2) in exact and (-10, 2) in exact and (12, 1) in exact
    assert exact == starts(pv.active_users_estimate(df), "users")


def test_metric_by_name(spark):
    assert pv.metric("pageCounts", views(spark, SOME), "1 second").count() == 4
    with pytest.raises(ValueError, match="invalid metric"):
        pv.metric("nope", views(spark, SOME))


def test_parsing_counts_malformed_lines(spark):
    rows = spark.createDataFrame([("u\t200\t1\t7\nv\tx\t1\t7\n",), ("w\t200\t1",), ("z\t404\t2\t8\textra",)], "value string")
    assert [tuple(r) for r in pv.parse_page_views(rows).collect()] == [("u", 200, 1, 7)]
    assert pv.parse_page_views(rows, keep_malformed=True).filter("malformed").count() == 3


def stream(spark, folder, **options):
    return pv.read_page_views(spark, str(folder), VIEWS, **options)


def run(query):
    query.awaitTermination()


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        views(spark, SOME[i::3]).coalesce(1).write.mode("append").parquet(str(source))
    live = stream(spark, source, maxFilesPerTrigger=1)
    for name, metric in (("counts", pv.page_counts), ("sliding", pv.sliding_page_counts), ("errors", pv.error_rates)):
        run(pv.write_latest(metric(live), str(tmp_path / name), str(tmp_path / f"{name}-state")))
        got = spark.read.parquet(str(tmp_path / name))
        assert got.exceptAll(metric(views(spark, SOME))).isEmpty() and got.count() == metric(views(spark, SOME)).count()


def test_stream_active_users_appends_closed_windows(spark, tmp_path):
    source = tmp_path / "in"
    views(spark, SOME).coalesce(1).write.parquet(str(source))
    late = pv.with_lateness(stream(spark, source))
    run(pv.write_batches(pv.active_users(late), str(tmp_path / "out"), str(tmp_path / "state")))
    closed = [r for r in starts(pv.active_users(views(spark, SOME)), "users") if r[0] + 15 <= 25]
    assert starts(spark.read.parquet(str(tmp_path / "out")), "users") == closed


def test_late_rows_are_dropped_and_restart_adds_no_doubles(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def step(rows):
        views(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        live = pv.page_counts(pv.with_lateness(stream(spark, source), "5 seconds"), "1 second")
        run(pv.write_batches(live, out, state))

    step([(0, "a", 200, 1, 1), (20, "a", 200, 1, 1)])
    step([(1, "late", 200, 1, 1), (40, "a", 200, 1, 1)])
    got = starts(spark.read.parquet(out), "url", "views")
    assert got == [(0, "a", 1), (20, "a", 1)]


def test_named_views_write_at_most_ten_rows_per_batch(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(2):
        views(spark, [(k, "a", 200, 1, k % 3) for k in range(20)]).coalesce(1).write.mode("append").parquet(str(source))
    users = spark.createDataFrame([(1, "Ann"), (2, "Bob")], "user_id int, name string")
    named = pv.named_views(stream(spark, source, maxFilesPerTrigger=1), users)
    run(pv.write_first_rows(named, str(tmp_path / "out"), str(tmp_path / "state")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["batch_id"]: r["count"] for r in got.groupBy("batch_id").count().collect()} == {0: 10, 1: 10}
    assert {r["name"] for r in got.collect()} <= {"Ann", "Bob"} and "batch_time" in got.columns


def test_text_stream_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("u\t200\t1\t7\nu\t404\t1\t8\nbroken\n")
    parsed = pv.parse_page_views(pv.read_page_view_lines(spark, str(tmp_path / "in")))
    run(pv.write_latest(parsed.groupBy("url").count(), str(tmp_path / "out"), str(tmp_path / "state")))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("u", 2)]


def files(spark, folder, parts):
    for rows in parts:
        views(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))


def test_live_active_users_emit_every_window_once(spark, tmp_path):
    """Several batches, users that come back, a view too late, and a closing row."""
    parts = [SOME[:3], [(3.2, "a", 200, 1, 1), (2, "late but in time", 200, 1, 9)], [(60, "a", 200, 1, 1), (61, "b", 200, 1, 2)],
             [(1, "too late", 200, 1, 77), (63, "a", 200, 1, 1)]]
    files(spark, tmp_path / "in", parts)
    live = stream(spark, tmp_path / "in", maxFilesPerTrigger=1)
    start = lambda r: pv.write_batches(r, str(tmp_path / "out"), str(tmp_path / "state"))
    with endless.keyed_state(spark):
        endless.run_and_close(live, endless.active_users_live, start, "5 seconds", "15 seconds")
    got = sorted((r["window_start"], r["window_end"], r["users"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    counted = [r for part in parts for r in part if r[1] != "too late"]
    want = pv.active_users(views(spark, counted)).select(*pv.window_seconds(), "users").collect()
    assert got == sorted(map(tuple, want)) and len({g[0] for g in got}) == len(got)
    assert spark.conf.get(endless.PROVIDER, None) != endless.ROCKS


def test_live_active_users_of_an_empty_stream(spark, tmp_path):
    views(spark, []).write.parquet(str(tmp_path / "in"))
    start = lambda r: pv.write_batches(r, str(tmp_path / "out"), str(tmp_path / "state"))
    with endless.keyed_state(spark):
        endless.run_and_close(stream(spark, tmp_path / "in"), endless.active_users_live, start, "0 seconds", "15 seconds")


def test_updates_answer_with_the_newest_version(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    keys = ["window", "url"]

    def go():
        late = pv.with_lateness(stream(spark, source, maxFilesPerTrigger=1), "5 seconds")
        query = endless.write_updates(pv.page_counts(late, "10 seconds"), out, state)
        query.awaitTermination()
        return query

    parts = [[(t + k, u, 200, 1, 1) for k in range(3) for u in "ab"] for t in (0, 4, 8, 40, 80)]
    files(spark, source, parts)
    query = go()
    every = [r for part in parts for r in part]
    want = starts(pv.page_counts(views(spark, every), "10 seconds"), "url", "views")
    assert starts(endless.read_latest(spark, out, keys), "url", "views") == want
    changed = spark.read.parquet(out).groupBy(*keys).count()
    assert changed.agg(F.max("count")).first()[0] > 1  # several versions of a row were written
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < len(want)  # closed windows have left the state
    assert endless.compact(spark, out, keys) >= 4 and endless.compact(spark, out, keys) >= 4
    assert starts(endless.read_latest(spark, out, keys), "url", "views") == want
    more = [(85, "a", 200, 1, 1), (86, "c", 200, 1, 1), (2, "dropped", 200, 1, 1)]
    files(spark, source, [more])
    go()
    want = starts(pv.page_counts(views(spark, every + more[:2]), "10 seconds"), "url", "views")
    assert starts(endless.read_latest(spark, out, keys), "url", "views") == want
    endless.compact(spark, out, keys)
    assert starts(endless.read_latest(spark, out, keys), "url", "views") == want


def live_users(spark, tmp_path, parts, **options):
    """Windows and users of a live stream of ``parts``, and its queries."""
    files(spark, tmp_path / "in", parts)
    queries = []

    def start(result):
        queries.append(pv.write_batches(result, str(tmp_path / "out"), str(tmp_path / "state")))
        return queries[-1]

    with endless.keyed_state(spark):
        endless.run_and_close(stream(spark, tmp_path / "in", **options), endless.active_users_live, start, "5 seconds", "15 seconds")
    got = sorted((r["window_start"], r["window_end"], r["users"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = pv.active_users(views(spark, [r for part in parts for r in part])).select(*pv.window_seconds(), "users").collect()
    return got, sorted(map(tuple, want)), queries


def test_live_active_users_keep_a_state_per_group(spark, tmp_path):
    """calls and states follow the groups, not the users."""
    got, want, queries = live_users(spark, tmp_path, [[(k % 7, "a", 200, 1, k) for k in range(4_000)]])
    assert got == want
    held = [o["numRowsTotal"] for q in queries for p in q.recentProgress for o in p["stateOperators"] if "transformWithState" in o["operatorName"]]
    assert 0 < max(held) < 4_000


def test_live_active_users_of_one_who_comes_back_with_an_expired_timer(spark, tmp_path):
    parts = [[(0, "a", 200, 1, 1)], [(100, "a", 200, 1, 2)], [(100, "a", 200, 1, 1)], [(101, "a", 200, 1, 1)]]
    got, want, _ = live_users(spark, tmp_path, parts, maxFilesPerTrigger=1)
    assert got == want


def test_live_active_users_pass_over_rows_without_a_user_or_a_time(spark, tmp_path):
    parts = [SOME[:2], [(1, "a", 200, 1, None), (2, "a", 200, 1, 1), (2, "a", 200, 1, 5), (3, "a", 200, 1, 6)], SOME[2:]]
    timeless = spark.createDataFrame([(None, "a", 200, 1, 1), (None, "a", 200, 1, 8)], VIEWS)
    timeless.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, _, _ = live_users(spark, tmp_path, parts)
    named = views(spark, [r for part in parts for r in part if r[4] is not None])
    assert got == sorted(map(tuple, pv.active_users(named).select(*pv.window_seconds(), "users").collect()))
