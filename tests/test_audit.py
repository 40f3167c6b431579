import json
import os
import time
from datetime import datetime, timedelta, timezone

from plain_rows import rows
from pyspark.sql import functions as F

from reviewframe.operators import audit as au
from reviewframe.operators.retention import retention_job, retention_preview
from reviewframe.sources import audit_log as sa
from reviewframe.sources.cache import cache_manifest

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)


def log(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "log_pos long, value string")
    return au.parse_audit(df)


def entry(ts="2024-02-01T00:00:00+00:00", event="e", **data):
    return json.dumps({k: v for k, v in {"ts": ts, "event": event, "actor": "a",
                                         "data": data}.items() if v is not None})


LINES = [entry(repo="o/r", pr_number=3), "  ", "", "{broken", entry(ts=None, repo="o/r"),
         entry(ts="2024-01-31T00:00:00"), entry(ts="soon"), entry(event=None), "[1, 2]", "17",
         entry() + " tail", "  " + entry(event="x", repo="q", mr_iid=8) + "\t",
         entry(ts="2024-01-30T23:59:59.999999+00:00"), "{'ts': 'single'}"]


def test_parsing(spark):
    got = {r.log_pos: r for r in log(spark, LINES).collect()}
    assert sorted(got) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    assert [p for p, r in sorted(got.items()) if r.malformed] == [3, 8, 9, 10, 13]
    assert [p for p, r in sorted(got.items()) if r.ts is None] == [3, 4, 6, 8, 9, 10, 13]
    numbers = log(spark, LINES).withColumn("n", au.pr_number()).filter("n IS NOT NULL")
    assert [(r.log_pos, r.n) for r in numbers.orderBy("log_pos").collect()] == [(0, 3), (11, 8)]


def test_query(spark):
    audit = log(spark, LINES)
    ask = lambda **kw: [r.log_pos for r in au.audit_query(audit, **kw).collect()]
    assert ask(repo="o/r") == [0, 4]
    assert ask(event="x") == [11]
    assert ask(event="", limit=2) == [0, 4]
    assert ask(since=datetime(2024, 1, 31)) == [0, 5, 7, 11]
    plan = au.audit_query(audit, repo="o/r")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_stats(spark):
    got = {r.event: r.entries for r in au.audit_stats(log(spark, LINES)).collect()}
    assert got == {"e": 5, "unknown": 1, "x": 1, None: 7}


def test_retention_keeps_what_it_cannot_read(spark):
    kept, purged = au.audit_retention(log(spark, LINES), NOW, 30)
    assert [r.log_pos for r in kept.orderBy("log_pos").collect()] == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11,
                                                                     13]
    assert purged.first().purged == 1


def test_runs(spark):
    e = lambda name, **d: entry(event=name, ts=d.pop("ts"), **d)
    audit = log(spark, [
        e("review_started", ts="2024-01-01T00:00:00+00:00", task_id="a", vcs="gitlab", repo="r",
          mr_iid=4),
        e("review_completed", ts="2024-01-01T00:00:01+00:00", task_id="a", comments_posted=0,
          duration_ms=950),
        e("review_task_succeeded", ts="2024-01-01T00:00:02+00:00", task_id="a", comments_posted=3),
        e("review_started", ts="2024-01-01T00:00:00+00:00", task_id="b", vcs="github", repo="r",
          pr_number=5),
        e("review_task_failed", ts="2024-01-01T00:00:01.5009+00:00", task_id="b"),
        e("review_started", ts="2024-01-01T00:00:00+00:00", task_id="c"),
        e("review_completed", ts="2024-01-01T00:00:00+00:00", repo="no task")])
    got = {r.task_id: (r.status, r.duration_ms, r.comments_posted, r.pr_number)
           for r in au.review_runs(audit).collect()}
    assert got == {"a": ("completed", 950, 3, 4), "b": ("failed", 1500, 0, 5),
                   "c": ("running", None, 0, None)}


def test_append_read_and_job(spark, tmp_path):
    path, kept = str(tmp_path / "log"), str(tmp_path / "kept")
    old, new = NOW - timedelta(days=100), NOW - timedelta(days=1)
    df = spark.createDataFrame(
        [("one", '{"repo": "o/r"}', None, old), ("two", None, "me", new), ("three", "", "", new)],
        "event string, data string, actor string, ts timestamp")
    sa.audit_append(df.filter("event = 'one'"), path, "svc")
    sa.audit_append(df.filter("event <> 'one'").coalesce(1), path, "svc")
    sa.audit_append(df, path, "svc", enabled=False)
    back = {r.event: r for r in sa.audit_read(spark, path).collect()}
    assert back["one"].ts.timestamp() == old.timestamp() and back["one"].actor == "svc"
    assert (back["two"].actor, back["two"].data, back["three"].actor) == ("me", "{}", "svc")
    ordered = [r.event for r in au.audit_query(sa.audit_read(spark, path)).collect()]
    assert ordered == ["one", "two", "three"]  # as they arrived
    assert rows(retention_preview(spark, path, NOW, 90)) == [("one", 1)]

    cache = tmp_path / "cache" / "deep"
    cache.mkdir(parents=True)
    for name, age in (("old", 40), ("edge", 30), ("new", 2)):
        (cache / name).write_text("x")
        at = (NOW - timedelta(days=age)).timestamp()
        os.utime(cache / name, (at, at))
    folder = str(tmp_path / "cache")
    summary, manifest = retention_job(spark, path, kept, [folder, folder + "/"], NOW)
    assert {r.storage: r.purged for r in summary.collect()} == {"audit_logs": 1, "cache_files": 1}
    assert [os.path.basename(r.path) for r in manifest.collect()] == ["old"]
    left = [r.event for r in sa.audit_read(spark, kept).collect()]
    assert sorted(left) == ["retention_policy_run", "three", "two"]
    again = str(tmp_path / "again")
    assert sa.enforce_retention(spark, kept, again, NOW, 90) == 0
    plan = cache_manifest(spark, [folder], NOW)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_many_cache_folders_are_one_read(spark, tmp_path):
    names = [f"c{i}" for i in range(120)] + ["odd {a,b}", "star*", "deep/er", "[x]", "back\\slash"]
    for name in names:
        folder = tmp_path / "caches" / name
        folder.mkdir(parents=True)
        (folder / "f.bin").write_bytes(b"x")
    (tmp_path / "caches" / "starling").mkdir()
    (tmp_path / "caches" / "starling" / "g.bin").write_bytes(b"x")
    dirs = [f"{tmp_path}/caches/{n}" for n in [*names, *(f"gone{i}" for i in range(300))]] + [f"{tmp_path}/caches/c1/"]
    later = datetime(2100, 1, 1)
    found = cache_manifest(spark, dirs, later)
    assert found.count() == len(names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan
    # Parents that hold none of their folders, folders in each other, no folder at all.
    assert cache_manifest(spark, [*dirs, f"{tmp_path}/nowhere/a", f"{tmp_path}/caches/deep"], later).count() == len(names)
    assert cache_manifest(spark, [f"{tmp_path}/nowhere/a"], later).count() == 0 == cache_manifest(spark, ["", "/"][:1], later).count()
    assert cache_manifest(spark, dirs, datetime(2000, 1, 1)).count() == 0


def test_order_survives_retention_and_since_prunes_days(spark, tmp_path):
    from reviewframe.sources.audit_log import audit_append, audit_read, enforce_retention
    log, kept = str(tmp_path / "log"), str(tmp_path / "kept")
    entries = spark.range(200).selectExpr(
        "timestamp_seconds(1704067200 + (id * 7919) % 864000) AS ts", "'e' AS event", "concat('{\"n\":', id, '}') AS data")
    audit_append(entries.repartition(4), log, "svc")
    order = [r.data for r in audit_read(spark, log).orderBy("log_pos").collect()]
    assert enforce_retention(spark, log, kept, datetime(2024, 1, 20), 3650) == 0
    assert [r.data for r in audit_read(spark, kept).orderBy("log_pos").collect()] == order
    since = audit_read(spark, log, datetime(2024, 1, 9, 12))
    assert {r.d for r in since.selectExpr("date_format(ts, 'dd') AS d").collect()} == {"09", "10"}


def arrived(spark, path, since=None):
    return [r.data for r in sa.audit_read(spark, path, since).filter("NOT malformed").orderBy("log_pos").collect()]


def day_log(spark, path):
    """Entries of five days that arrive against their times' order, in two appends."""
    entries = spark.range(100).selectExpr("timestamp_seconds(1704067200 + (99 - id) * 4320) AS ts", "'e' AS event",
                                          "concat('{\"n\":', id, '}') AS data").coalesce(1)
    sa.audit_append(entries.filter("data < '{\"n\":5'"), path, "svc")
    sa.audit_append(entries.filter("data >= '{\"n\":5'"), path, "svc")
    numbers = sorted(range(100), key=lambda n: ('{"n":%d' % n >= '{"n":5', n))
    return [(f'{{"n":{n}}}', datetime.fromtimestamp(1704067200 + (99 - n) * 4320, timezone.utc)) for n in numbers]


def test_order_of_arrival_and_partition_filters(spark, tmp_path):
    path = str(tmp_path / "log")
    entries = day_log(spark, path)
    (tmp_path / "log" / "other.jsonl").write_text(entry(ts="2020-01-01T00:00:00+00:00", n=-1) + "\n{broken\n")
    assert arrived(spark, path) == ['{"n":-1}', *(d for d, _ in entries)]
    since = datetime(2024, 1, 4, 7)
    assert arrived(spark, path, since) == ['{"n":-1}', *(d for d, t in entries if t.day >= 4)]
    plan = sa.audit_read(spark, path, since)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and ">= 2024-01-04" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.txt")}


def test_retention_by_day(spark, tmp_path, monkeypatch):
    root = tmp_path / "log"
    path = str(root)
    entries = day_log(spark, path)
    before = files_of(root)
    cut = datetime(2024, 1, 3, 12, tzinfo=timezone.utc)
    now = cut + timedelta(days=30)
    kept = [d for d, t in entries if t >= cut]

    def broken(*a, **kw):
        raise ValueError("lost")
    with monkeypatch.context() as m:  # the run breaks before its version is written
        m.setattr(spark, "createDataFrame", broken)
        try:
            sa.retain(spark, path, now, 30)
        except ValueError:
            pass
    assert arrived(spark, path) == [d for d, _ in entries]
    assert sa.retain(spark, path, now, 30) == len(entries) - len(kept)
    assert arrived(spark, path) == kept
    assert before.items() <= files_of(root).items()  # no file of any day was touched
    assert all("dt=2024-01-03" in f for f in files_of(root).keys() - before.keys())
    assert sa.retain(spark, path, now, 30) == 0 and arrived(spark, path) == kept
    late = spark.createDataFrame([(cut + timedelta(hours=1), "late", "{}"), (cut - timedelta(hours=1), "old", "{}")],
                                 "ts timestamp, event string, data string")
    sa.audit_append(late, path, "svc")
    assert arrived(spark, path) == [*kept, "{}", "{}"]
    assert sa.retain(spark, path, now + timedelta(hours=2), 30) == 1 + 1 + sum(
        cut <= t < cut + timedelta(hours=2) for _, t in entries)
    assert arrived(spark, path) == [d for d, t in entries if t >= cut + timedelta(hours=2)]
    dead = {(r.dt, r.epoch[0]) for r in sa.dead_folders(spark, path).collect()}
    assert {("2024-01-01", "a"), ("2024-01-03", "a"), ("2024-01-03", "r")} <= dead
    assert ("2024-01-04", "a") not in dead
    summary, _ = retention_job(spark, path, None, [str(tmp_path / "no cache")], now + timedelta(days=1), 30)
    assert {r.storage: r.status for r in summary.collect()} == {"audit_logs": "ok", "cache_files": "ok"}
    assert arrived(spark, path)[-1] != "{}" and "retention_policy_run" in [
        r.event for r in sa.audit_read(spark, path).collect()]


def test_a_failing_kind_is_an_error_of_its_own(spark, tmp_path, monkeypatch):
    from reviewframe.operators import retention
    path = str(tmp_path / "log")
    day_log(spark, path)

    def fails(*a):
        raise OSError("no such store")
    monkeypatch.setattr(retention, "cache_manifest", fails)
    summary, manifest = retention.retention_job(spark, path, None, ["x"], datetime(2024, 2, 2), 30)
    got = {r.storage: (r.purged, r.status, r.error) for r in summary.collect()}
    assert got == {"audit_logs": (40, "ok", None), "cache_files": (None, "error", "no such store")}
    assert manifest.count() == 0
    run = sa.audit_read(spark, path).filter("event = 'retention_policy_run'").first()
    assert json.loads(run.data) == {"audit_logs": {"purged": 40, "status": "ok"},
                                    "cache_files": {"status": "error", "error": "no such store"}}
