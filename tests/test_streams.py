"""State with expiry, logs with snapshots, findings kept up while definitions change."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from loomspan.operators.tables import new_path
from loomspan.streaming import edits as T
from loomspan.streaming.logs import ChangeLog

START = datetime.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, batches, schema):
    """A stream that gives each list of rows as a batch of its own."""
    source = str(tmp_path / "source")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/b={i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)


def states(stream, path, mode):
    """Rows of the state after each batch, and all that the stream gave."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName("given").option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress], stream.sparkSession.table("given").collect()


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_versions_expire(spark, tmp_path):
    rows = [[(f"p{i}", i, "change", at(i)) for i in range(20)], [("p0", 50, "change", at(2)), ("q", 51, "change", at(300))], [("p0", 60, "change", at(301)), ("q", 61, "change", at(302))]]
    stream = stream_of(spark, tmp_path, rows, "path string, event_id long, change_type string, ts timestamp")
    held, given = states(T.latest_version(stream, idle_minutes=60), str(tmp_path / "c"), "update")
    assert max(held) >= 20 and held[-1] < 10  # the idle paths have gone
    versions = {(r["path"], r["event_id"]): r["version"] for r in given}
    assert versions[("p0", 50)] == 2 and versions[("p0", 60)] == 1 and versions[("q", 61)] == 2


def test_sessions_end_by_timer(spark, tmp_path):
    rows = [[("a", at(0)), ("a", at(10)), ("b", at(5)), ("a", at(100))], [("c", at(200)), ("a", at(105))], [("c", at(500))]]
    stream = stream_of(spark, tmp_path, rows, "agent string, ts timestamp")
    held, given = states(T.session_state(stream, 30), str(tmp_path / "c"), "append")
    got = sorted((r["agent"], r["first"], r["last"], r["n"]) for r in given)
    assert got == [("a", at(0), at(10), 2), ("a", at(100), at(105), 2), ("b", at(5), at(5), 1), ("c", at(200), at(200), 1)]
    assert held[-1] < max(held) or max(held) <= 3


def test_newest_sessions_are_ten_at_most(spark, tmp_path):
    rows = [[(1, f"s{i}", at(i), i) for i in range(12)], [(1, "s5", at(13), 20), (1, "late", at(200), 21)], [(1, "x", at(201), 22)]]
    stream = stream_of(spark, tmp_path, rows, "project_id long, session string, ts timestamp, event_id long")
    _, given = states(T.newest_sessions(stream, 10, 30), str(tmp_path / "c"), "append")
    reasons = {r["session"]: r["reason"] for r in given}
    assert [s for s, r in reasons.items() if r == "evicted"] == ["s0", "s1", "s2"] and {s for s, r in reasons.items() if r == "expired"} == {f"s{i}" for i in range(3, 12)} and len(given) == 12


def test_log_is_a_snapshot_and_few_batches(spark):
    log = ChangeLog(spark, new_path(spark, "log"), "k long, v long, x string", ("k",), "v", every=5)
    r, newest = random.Random(1), {}
    for number in range(23):
        rows = [(r.randrange(6), r.randrange(1000), f"b{number}") for _ in range(2)]
        for k, v, x in rows:
            if v > newest.get(k, (-1, ""))[0]:
                newest[k] = (v, x)
        log.write(spark.createDataFrame(rows, "k long, v long, x string"), number)
        if number == 11:
            log.write(spark.createDataFrame(rows, "k long, v long, x string"), number)  # a batch that runs again
        assert len(log.sources()) <= 6
    assert {x["k"]: x["v"] for x in log.read().collect()} == {k: v for k, (v, _) in newest.items()}
    assert {x["x"] for x in log.read().collect()} <= {f"b{i}" for i in range(23)}


def full_run(events):
    """Findings of the newest version of every file, by hand."""
    newest = {}
    for p, f, e, kind, defs, imports, uses in events:
        if (p, f) not in newest or e > newest[(p, f)][0]:
            newest[(p, f)] = (e, kind, defs, imports, uses)
    live = {k: v for k, v in newest.items() if v[1] != "unlink"}
    out = set()
    for (p, f), (_, _, defs, imports, uses) in live.items():
        defined = {s for (q, _), v in live.items() if q == p for s, _ in v[2]}
        imported = {s for (q, _), v in live.items() if q == p for s in v[3]}
        out |= {(p, f, s, "unresolvedReference") for s in uses if s not in defined}
        out |= {(p, f, s, "unusedImport") for s in imports if s not in uses}
        out |= {(p, f, s, "unusedExport") for s, exported in defs if exported and s not in imported}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_findings_follow_changing_definitions(spark, tmp_path, seed):
    r = random.Random(seed)
    events = [(r.randrange(2), r.randrange(5), e, r.choice(["add", "change", "change", "unlink"]), [(s, r.random() < 0.6) for s in r.sample(range(8), r.randrange(3))], r.sample(range(8), r.randrange(3)), r.sample(range(8), r.randrange(4))) for e in range(24)]
    mixed = events[:]
    r.shuffle(mixed)
    schema = "project_id long, file long, event_id long, change_type string, definitions array<struct<symbol_id: bigint, exported: boolean>>, imports array<bigint>, uses array<bigint>"
    stream = stream_of(spark, tmp_path, [mixed[i : i + 5] for i in range(0, 24, 5)], schema)
    got = T.maintained_findings(stream, str(tmp_path / "kept"), every=2).collect()
    assert {tuple(x) for x in got} == full_run(events) and len(got) == len(full_run(events))


def test_only_touched_projects_are_written(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts = spark.createDataFrame([(1, "a", "high"), (2, "b", "low"), (3, "c", "low")], "project_id long, file string, severity string")
    T.write_alerts(alerts, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "alerts").rglob("*.json") if "project_id=2" not in str(p) and "project_id=3" not in str(p)}
    T.write_alerts(spark.createDataFrame([(1, "z", "low"), (2, "y", "high")], "project_id long, file string, severity string"), path, touched=spark.createDataFrame([(2,), (3,)], "project_id long"))
    assert {(r["project_id"], r["file"]) for r in T.read_alerts(spark, path).collect()} == {(1, "a"), (2, "y")}
    assert before and all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())


def test_clean_checks_scrub_the_initial_scan(spark):
    initial = spark.createDataFrame([(1, "src/a.ts", 1), (1, "src\\b.ts", 2), (1, "../x/src/c.ts", 3), (1, "d.ts", 4), (2, "src/a.ts", 5), (1, "xsrc/a.ts", 6)], "project_id long, file string, n int")
    live = spark.createDataFrame([(1, "src/a.ts", True), (1, "p/src/b.ts", True), (1, "c.ts", True), (1, "d.ts", False)], "project_id long, file string, clean boolean")
    assert sorted(r["n"] for r in T.scrubbed(initial, live).collect()) == [4, 5, 6]


def test_versions_of_a_path_with_many_events(spark, tmp_path):
    """More rows of one path than a part that Spark hands over holds, the newest first."""
    n = 25_000
    schema = "path string, event_id long, change_type string, ts timestamp"
    source = str(tmp_path / "source")
    late = F.lit(n - 1) - F.col("id")
    spark.range(n).coalesce(1).select(F.lit("p").alias("path"), late.alias("event_id"), F.lit("change").alias("change_type"), F.timestamp_seconds(late / 10).alias("ts")).write.parquet(source)
    out = T.run_stateful(T.latest_version(spark.readStream.schema(schema).parquet(source)))
    assert out.where("version = event_id + 1").count() == out.count() == n


def test_events_of_all_files_in_one_batch(spark, tmp_path):
    """Files that are not in the order of time: no event is late."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(i, at(60 * (20 - i)), 1, "click", 1.0, '{"k": 7}') for i in range(20)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    from loomspan.plans.all_queries import QUERIES

    got = {(r["event_id"], r["version"]) for r in QUERIES["latest_version"](spark, str(tmp_path)).collect()}
    assert got == {(i, 20 - i) for i in range(20)}


def test_files_of_alerts_follow_the_rows(spark, tmp_path):
    """300 projects of two files each; a new full set, then touched projects, replace what was there."""
    path = str(tmp_path / "alerts")
    alerts = spark.range(600).selectExpr("id % 300 as project_id", "concat('f', id) as file", "'high' as severity")
    T.write_alerts(alerts.where("project_id < 5"), path)
    T.write_alerts(alerts, path)
    assert len(list((tmp_path / "alerts").rglob("*.json"))) <= 8
    assert T.read_alerts(spark, path).count() == 600
    for p in range(25):  # more than a log holds before it is compacted
        T.write_alerts(alerts.where("project_id = 299 and file = 'f299'"), path, touched=spark.createDataFrame([(p,), (299,)], "project_id long"))
    got = T.read_alerts(spark, path).groupBy("project_id").count().collect()
    assert {r["project_id"]: r["count"] for r in got} == {p: 2 for p in range(25, 299)} | {299: 1}


def intent_by_hand(edits, width, slide, passed=None):
    """(agent, window_end, n, focus, language, symbols) of edits (agent, minute, path, language, symbol); times in minutes."""
    windows = {}
    for agent, at, path, language, symbol in edits:
        start = at // slide * slide
        while start > at - width:
            if passed is None or start + width <= passed:
                windows.setdefault((agent, start + width), []).append((path.rpartition("/")[0], language, symbol))
            start -= slide
    most = lambda xs: max(set(xs), key=lambda x: (xs.count(x), len(x), x))
    return sorted((a, end, len(w), most([x[0] for x in w]), most([x[1] for x in w]), sorted({x[2] for x in w if x[2]})) for (a, end), w in windows.items())


EDITS = "agent string, minute long, path string, language string, symbol string"


def random_edits(seed, n, least, most):
    r = random.Random(seed)
    return [(r.choice("ab"), r.randrange(least, most), r.choice(["x", "x/y", "z", "zz"]) + f"/{r.randrange(9)}", r.choice(["ts", "py"]), r.choice(["f", "g", None])) for _ in range(n)]


def focus_rows(df):
    return sorted(tuple(x) for x in df.select("agent", F.expr("unix_seconds(window_end) div 60"), "n", "focus", "language", "symbols").collect())


@pytest.mark.parametrize(("width", "slide"), [(360, 60), (5, 2), (3, 3)])
def test_intent_windows_from_panes(spark, width, slide):
    """Windows are whole whether or not their width is so many slides."""
    edits = random_edits(width, 200, 1000, 2500 if width == 360 else 1060)
    df = spark.createDataFrame(edits, EDITS).withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))
    sizes = f"{width} minutes", f"{slide} minutes"
    assert focus_rows(T.intent_focus(T.recent_intent(df, *sizes), *sizes)) == intent_by_hand(edits, width, slide)


def test_intent_state_holds_an_edit_once(spark, tmp_path):
    """State grows with edits and not with their windows; late edits with an open window count in all, others in none."""
    first = [(f"agent{i}", 6000 + i, "d/f", "ts", "s") for i in range(60)] + [("b", 6630, "d/f", "py", "s")]
    again = [("b", 6630, "d/f", "py", "s")]  # Spark judges lateness by the watermark of the batch before
    late = [("b", 6310, "e/f", "ts", "t"), ("b", 6000, "gone/f", "ts", "u")]
    for part in (first, again, late):
        spark.createDataFrame(part, EDITS).withColumn("ts", F.timestamp_seconds(F.col("minute") * 60)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = spark.readStream.schema(EDITS + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = T.recent_intent(source, "6 hours", "1 hour").writeStream.outputMode("update").format("memory").queryName("intent_state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress) == len(first + again) + 1
    got = focus_rows(T.intent_focus(spark.table("intent_state"), "6 hours", "1 hour", "10 minutes"))
    assert got == intent_by_hand(first + again + late[:1], 360, 60, passed=6620)


@pytest.mark.parametrize("most", [None, 4])
def test_intent_names_recent_files(spark, most):
    """Each window has its files, the newest first; with ``most`` everything is of its last edits alone."""
    edits = random_edits(7, 300, 1000, 1040) + [("a", 1020, "x/new", "ts", "f")] * 3
    df = spark.createDataFrame(edits, EDITS).withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))
    want = []
    for agent in "ab":
        for end in range(1002, 1045, 2):
            own = sorted(((at, path, language, symbol or "") for a, at, path, language, symbol in edits if a == agent and end - 6 <= at < end), reverse=True)[:most]
            if own:
                files = sorted({path: max(at for at, p, *_ in own if p == path) for _, path, *_ in own}.items(), key=lambda x: (x[1], x[0]), reverse=True)
                of_one_window = [(agent, end - 1, *x[1:]) for x in own]
                want.append((agent, end, *intent_by_hand(of_one_window, 2, 2)[0][2:], [f for f, _ in files]))
    got = T.intent_focus(T.recent_intent(df, "6 minutes", "2 minutes"), "6 minutes", "2 minutes", most=most)
    got = sorted(tuple(x) for x in got.select("agent", F.expr("unix_seconds(window_end) div 60"), "n", "focus", "language", "symbols", "files").collect())
    assert got == sorted(want)
