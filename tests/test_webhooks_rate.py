import hashlib
import hmac
import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from reviewframe import schemas
from reviewframe.operators import rate
from reviewframe.operators import webhooks as wh
from reviewframe.plans.deliveries import gate_deliveries
from reviewframe.streaming.audit import audit_append_stream, audit_counts_stream, current_counts
from reviewframe.streaming.limiter import rate_limit_stream
from reviewframe.streaming.webhooks import webhook_stream
from reviewframe.sources.audit_log import audit_read

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SECRETS = {"github": "s3", "gitlab": "tok"}


def gh(action="opened", number=7, event="pull_request", **extra):
    body = {"action": action, "repository": {"full_name": "o/r"}, **extra}
    if event == "pull_request":
        body |= {"number": number, "pull_request": {"head": {"sha": "abc"}}}
    else:
        body |= {"issue": {"number": number}}
    return ("github", event, json.dumps(body))


def said(text, login="dev"):
    return {"comment": {"body": text, "id": 55}, "sender": {"login": login}}


CASES = {
    "accepted": [gh(), gh("synchronize"),
                 gh("created", event="issue_comment", **said("hey /REVIEW")),
                 ("gitlab", "Merge Request Hook", json.dumps(
                     {"object_attributes": {"action": "open", "iid": 3, "last_commit": {"id": "z"}},
                      "project": {"id": 9, "path_with_namespace": "o/g"}})),
                 ("bitbucket", "pullrequest:created", json.dumps(
                     {"pullrequest": {"id": 4, "source": {"commit": {"hash": "h"}}},
                      "repository": {"full_name": "o/b"}}))],
    "invalid_json": [("github", "pull_request", "{oops"), ("bitbucket", "x", "{} {}"),
                     ("gitlab", "Merge Request Hook", "")],
    "event_ignored": [gh(event="push"), ("bitbucket", "repo:push", "{}")],
    "action_ignored": [gh("closed"), gh("edited", event="issue_comment", **said("/ask")),
                       ("gitlab", "Merge Request Hook", "{}")],
    "no_command": [gh("created", event="issue_comment", **said("thanks"))],
    "bot_ignored": [gh("created", event="issue_comment", **said("/ask", "X[BOT]")),
                    gh("created", event="issue_comment", **said("/ask", "MyReviewBot"))],
    "missing_fields": [gh(number=0), gh(number=None),
                       ("bitbucket", "pullrequest:updated", '{"pullrequest": {"id": 4}}')],
}


def sign(vcs, body):
    if vcs == "github":
        return "sha256=" + hmac.new(b"s3", body.encode(), hashlib.sha256).hexdigest()
    return "tok" if vcs == "gitlab" else None


def deliveries(spark, items):
    return spark.createDataFrame(
        [(str(i), vcs, event, sig, body, T0 + timedelta(seconds=i))
         for i, (vcs, event, body, sig) in enumerate(items)], schemas.DELIVERY)


def test_every_gate(spark):
    flat = [(outcome, (*case, sign(case[0], case[2]))) for outcome, cases in CASES.items()
            for case in cases]
    got = wh.normalise_webhooks(deliveries(spark, [c for _, c in flat]), "reviewbot", SECRETS)
    by_id = {r.delivery_id: r for r in got.collect()}
    for i, (outcome, case) in enumerate(flat):
        assert by_id[str(i)].outcome == outcome, case
    assert (by_id["0"].repo, by_id["0"].pr_number, by_id["0"].head_sha) == ("o/r", 7, "abc")
    assert (by_id["2"].head_sha, by_id["2"].comment_id) == ("", "55")
    assert (by_id["3"].project_id, by_id["3"].review_id) == (9, "gitlab:o/g:3:z")
    notes = wh.outcome_audit(got).filter("event = 'review_queued'").collect()
    keys = [set(json.loads(r.data)) for r in notes]
    assert {"vcs", "repo", "project_id", "mr_iid", "head_sha"} in keys
    assert {"vcs", "repo", "pr_number", "head_sha", "hook_uuid"} in keys


def test_signatures(spark):
    vcs, event, body = gh()
    items = [(vcs, event, body, s) for s in (sign(vcs, body), "sha256=00", None)]
    items += [("gitlab", "x", body, s) for s in ("tok", "no", None)] + [("bitbucket", "x", body, None)]
    got = wh.verify_signature(deliveries(spark, items), SECRETS).orderBy(F.col("delivery_id").cast("int"))
    assert [r.signature_ok for r in got.collect()] == [True, False, False, True, False, False, True]
    free = wh.verify_signature(deliveries(spark, items), {})
    assert free.filter("NOT signature_ok").count() == 0


def model_limit(items, limit, window):
    """One pass in time order with the list of accepted times per key."""
    kept, out = {}, {}
    for rid, key, t in sorted(items, key=lambda x: (x[2], x[0])):
        live = [x for x in kept.get(key, []) if t - x < window]
        out[rid] = len(live) < limit
        kept[key] = live + [t] if out[rid] else live
    return out


def random_requests(seed, n, span):
    rng = random.Random(seed)
    return [(f"{i:06d}", "hot" if rng.random() < .4 else f"k{rng.randrange(6)}",
             int(rng.choice([rng.random(), rng.random() ** 4]) * span) * 1_000_000)
            for i in range(n)]


def as_frame(spark, items):
    return spark.createDataFrame(items, "request_id string, key string, t long").select(
        "request_id", "key", F.timestamp_micros("t").alias("ts"), "t")


@pytest.mark.parametrize("limit,window,span", [(1, 60, 4000), (3, 100, 2000), (5, 50, 20000),
                                               (100, 3600, 9000), (0, 10, 100)])
def test_limiter_equals_the_model(spark, limit, window, span):
    items = random_requests(limit + span, 1500, span)
    df = as_frame(spark, items)
    got = {r.request_id: r.allowed for r in rate.rate_limit(df, limit, window).collect()}
    want = model_limit(items, limit, window * 1_000_000)
    assert got == want
    refused = {r.request_id for r in rate.rate_refusals(df, limit, window).collect()}
    assert refused == {k for k, ok in want.items() if not ok}


def test_saturated_key_in_small_blocks(monkeypatch):
    """Counts, ties and repeats of one key that is always over its limit, packed into blocks of a few times."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(rate, "BLOCK", 7)
    rng = random.Random(6)
    items = [(f"{i:05d}", "k", rng.randrange(3000)) for i in range(4000)]
    times, counts = np.unique([t for _, _, t in items], return_counts=True)
    n = len(times)
    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * n), pa.array(np.zeros(n, np.int64)), pa.array(times),
                                        pa.array(counts)], names=["key", "g", "t", "n"])
    blocks = list(rate._pack([batch.slice(0, 500), batch.slice(500)]))
    assert max(len(x) // 8 for b in blocks for x in b.column("t").to_pylist()) == 7
    looked = []
    whole = rate.accept_counted
    monkeypatch.setattr(rate, "accept_counted", lambda *a: looked.append(1) or whole(*a))
    got = {}
    for b in rate._walker(5, 400)(blocks):
        got.update(zip(b.column("t").to_pylist(), b.column("k").to_pylist()))
    want = model_limit(items, 5, 400)
    assert got == {int(t): sum(want[i] for i, _, x in items if x == t) for t in times}
    assert len(looked) < sum(b.num_rows for b in blocks) / 2  # blocks that end before a slot is free are passed over


def test_rows_stay_out_of_the_walk(spark):
    df = as_frame(spark, [(f"{i:03d}", "k", i // 20 * 1_000_000) for i in range(400)])
    plan = rate.rate_limit(df, 5, 10)._jdf.queryExecution().optimizedPlan().toString()
    packing = plan[plan.index("MapInArrow _pack"):] if "MapInArrow _pack" in plan else plan[plan.index("_pack"):]
    assert "request_id" not in packing.split("Relation")[0].split("LogicalRDD")[0]
    got = {r.request_id: r.allowed for r in rate.rate_limit(df, 5, 10).collect()}
    assert got == model_limit([(f"{i:03d}", "k", i // 20 * 1_000_000) for i in range(400)], 5, 10_000_000)


def test_limiter_details(spark):
    second = 1_000_000
    items = [("a", "k", 0), ("b", "k", 9 * second), ("c", "k", 10 * second), ("d", "k", 10 * second),
             ("e", "j", 5 * second)]
    got = {r.request_id: r.allowed
           for r in rate.rate_limit(as_frame(spark, items), 1, 10).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": True}


def test_calm_keys_never_reach_python(spark):
    items = [(f"{i:04d}", f"k{i % 10}", i * 1_000_000) for i in range(100)]
    df = as_frame(spark, items)
    calm = rate.rate_limit(df, 100, 3600)
    assert calm.filter("NOT allowed").count() == 0 and calm.count() == 100


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    items = sorted(random_requests(9, 600, 3000), key=lambda x: (x[2], x[0]))
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for part in (items[:250], items[250:]):
        as_frame(spark, part).select("request_id", "key", "t").coalesce(1).write.mode("append") \
            .parquet(src)
        stream = spark.readStream.schema("request_id string, key string, t long").parquet(src)
        rate_limit_stream(stream, 3, 100).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    got = {r.request_id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got == model_limit(items, 3, 100 * 1_000_000)


def test_idle_state_goes(spark, tmp_path):
    """A key's state is empty once the watermark is a window past its last accepted request."""
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    second = 1_000_000
    parts = [[("a", "idle", 1000 * second), ("b", "live", 1000 * second)],
             [("c", "idle", 1010 * second), ("d", "live", 2000 * second)],
             [("e", "live", 2010 * second), ("f", "idle", 5 * second)]]  # the last one comes late and is decided
    held = []
    for part in parts:
        as_frame(spark, part).select("request_id", "key", "t").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("request_id string, key string, t long").parquet(src)
        rate_limit_stream(stream, 3, 100).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("path", cp).option("stateVarName", "accepted").load()
        held.append(sorted({r.key.key for r in state.collect()}))
    assert held[0] == ["idle", "live"] and held[1] == ["live"]
    assert {r.request_id for r in spark.read.parquet(out).filter("allowed").collect()} == set("abcdef")


def test_webhook_stream_equals_batch(spark, tmp_path):
    flat = [(*case, sign(case[0], case[2])) for cases in CASES.values() for case in cases]
    flat += [(*gh(number=n), sign("github", gh(number=n)[2])) for n in range(1, 6)]
    df = deliveries(spark, flat)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    webhook_stream(stream, "reviewbot", SECRETS, out, str(tmp_path / "cp"), 3, 60).awaitTermination()
    batch = gate_deliveries(df, "reviewbot", SECRETS, 3, 60).select("delivery_id", "outcome")
    streamed = spark.read.parquet(f"{out}/outcomes").select("delivery_id", "outcome")
    assert rows(streamed) == rows(batch)
    assert batch.filter("outcome = 'rate_limited'").count() == 5
    accepted = spark.read.parquet(f"{out}/requests")
    assert accepted.count() == batch.filter("outcome = 'accepted'").count()
    assert audit_read(spark, f"{out}/audit").filter("NOT malformed").count() == batch.filter(
        "outcome IN ('accepted', 'rate_limited', 'invalid_signature')").count()


def test_audit_streams_over_a_restart(spark, tmp_path):
    src, log, counts = (str(tmp_path / n) for n in ("src", "log", "counts"))
    for part in (["a", "b", "a"], ["a", "c"]):
        spark.createDataFrame([(e, '{"x": 1}') for e in part], "event string, data string") \
            .write.mode("append").parquet(src)
        stream = lambda: spark.readStream.schema("event string, data string").parquet(src)
        audit_append_stream(stream(), log, str(tmp_path / "cp1"), "svc").awaitTermination()
        audit_counts_stream(stream(), counts, str(tmp_path / "cp2")).awaitTermination()
    assert rows(current_counts(spark.read.parquet(counts))) == [("a", 3), ("b", 1), ("c", 1)]
    assert audit_read(spark, log).filter("NOT malformed").count() == 5
    for n in range(4):  # what is kept doesn't grow with the batches
        spark.createDataFrame([("d", None)], "event string, data string").write.mode("append").parquet(src)
        audit_counts_stream(stream(), counts, str(tmp_path / "cp2")).awaitTermination()
    assert rows(current_counts(spark.read.parquet(counts))) == [("a", 3), ("b", 1), ("c", 1), ("d", 4)]
    assert spark.read.parquet(counts).count() <= 2 * 4 and len(list((tmp_path / "counts").rglob("*.parquet"))) == 2


def test_repeated_and_missing_request_ids_stay_rows(spark):
    from datetime import datetime, timedelta

    from reviewframe.operators.rate import rate_limit

    start = datetime(2024, 1, 1)
    rows_ = [("same", "k", start + timedelta(seconds=i // 3)) for i in range(30)]
    rows_ += [(None, "k", start + timedelta(seconds=5)), ("x", None, start), ("same", "other", start)]
    df = spark.createDataFrame(rows_, "request_id string, key string, ts timestamp")
    got = rate_limit(df, 4, 3600).collect()
    assert len(got) == len(rows_)
    assert sum(r.allowed for r in got if r.key == "k") == 4
    assert all(r.allowed for r in got if r.key != "k")


def test_findings_on_two_lines_survive_and_need_no_policy_row(spark):
    from reviewframe import schemas
    from reviewframe.operators.comments import dedup_comments
    from reviewframe.operators.policy import policy_resolve
    from reviewframe.plans.review import raw_findings

    patch = "@@ -1 +1,2 @@\n+password = \"hunter2hunter2\"\n+secret = \"abcdefabcdef12\"\n"
    files = spark.createDataFrame([("r1", "a.py", "modified", patch), ("r2", "a.py", "modified", patch)],
                                  schemas.FILE)
    reviews = spark.createDataFrame([("r1", "o/r")], "review_id string, repo string")
    policies = policy_resolve(reviews, spark.createDataFrame([], "repo string, config string"))
    kept = dedup_comments(raw_findings(files, policies)).filter("rule = 'G2'").collect()
    assert sorted((r.review_id, r.line) for r in kept) == [("r1", 1), ("r1", 2), ("r2", 1), ("r2", 2)]


def test_a_new_key_asks_for_no_timers():
    """Every call of the state is a message to the JVM; a key without held times has no timer to look for."""
    import pandas as pd

    from reviewframe.streaming.limiter import Limiter

    class State(list):
        def get(self):
            return iter([(t,) for t in self])

        def exists(self):
            raise AssertionError("get tells it")

        def put(self, rows):
            self[:] = [t for (t,) in rows]

    class Handle:
        timers, asked = [], 0

        def listTimers(self):
            self.asked += 1
            return iter(list(self.timers))

        def deleteTimer(self, at):
            self.timers.remove(at)

        def registerTimer(self, at):
            self.timers.append(at)

    limiter = Limiter(2, 10_000_000)
    limiter.handle, limiter.accepted = Handle(), State()
    ask = lambda *times: [bool(a) for f in limiter.handleInputRows(("k",), iter([pd.DataFrame(
        {"request_id": [f"r{t}" for t in times], "t": [t * 1_000_000 for t in times]})]), None) for a in f["allowed"]]
    assert ask(3, 1, 2) == [True, True, False]
    assert limiter.handle.asked == 0 and limiter.handle.timers == [12_000] and list(limiter.accepted) == [1_000_000, 2_000_000]
    assert ask(12, 4) == [False, True]
    assert limiter.handle.asked == 1 and limiter.handle.timers == [22_000]
