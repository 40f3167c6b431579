import json

from plain_rows import rows
from pyspark.sql import functions as F

from reviewframe import schemas
from reviewframe.operators import comments as cm
from reviewframe.operators import feedback as fb
from reviewframe.operators import infer
from reviewframe.functions.windows import first_n, last_by
from reviewframe.sources.outbox import review_outbox


def findings(spark, items):
    return spark.createDataFrame([("r", i, *item) for i, item in enumerate(items)], schemas.FINDING)


def policy(spark, rank, cap):
    return spark.createDataFrame([("r", rank, cap)],
                                 "review_id string, min_rank int, max_comments int")


def test_parse_shapes(spark):
    good = '{"file_path":"f","line":"7","severity":"INFO","body":"b"}'
    texts = [f"[{good}]", '{"comments": [' + good + "]}", good, "[]", "nope", "['a']", '{"comments": 3}',
             f"```json\n[{good}]\n``` and ```json\n[]\n```", f"```\n[{good}]\n```", f"[{good}] tail",
             '[{"line": "x", "body": null}]', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    last = [r.id for r in cm.parse_findings(df).orderBy("id").collect()]
    first = [r.id for r in cm.parse_findings(df, fence="first").orderBy("id").collect()]
    assert last == [0, 1, 8, 10]
    assert first == [0, 1, 8, 10]
    odd = cm.parse_findings(df).filter("id = 10").first()
    assert odd.line is None and odd.severity is None and odd.body is None
    assert cm.parse_findings(df).filter("id = 0").first().line == 7


def test_noise_control_order_and_quirks(spark):
    long = "x" * 50
    df = findings(spark, [("f", 1, "INFO", long + "1"), ("f", 2, "INFO", long + "2"),
                          ("f", 3, None, long), ("f", 4, "", long), ("g", 5, "BLOCKER", "a"),
                          ("g", 6, "info", "a"), (None, 7, "WARNING", None),
                          ("", 8, "WARNING", "")])
    kept = cm.dedup_comments(df)
    assert [r.seq for r in kept.orderBy("seq").collect()] == [0, 2, 4, 5, 6]
    loud = cm.filter_severity(df, policy(spark, 2, 9))
    assert [r.seq for r in loud.orderBy("seq").collect()] == [4, 6, 7]
    capped = cm.cap_comments(df, policy(spark, 1, 3))
    assert [r.seq for r in capped.orderBy("seq").collect()] == [0, 1, 2]
    assert cm.noise_control(df, policy(spark, 1, 0)).count() == 0
    whole = cm.noise_control(df, policy(spark, 1, 4))
    assert [r.seq for r in whole.orderBy("seq").collect()] == [0, 2, 4, 5]


def test_cap_is_exact_for_a_hot_review_and_large_caps(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("review_id"),
        F.col("id").alias("seq"))
    got = first_n(df.withColumn("cap", F.lit(2500)), ["review_id"], ["seq"], F.col("cap"))
    hot = [r.seq for r in got.filter("review_id = 'hot'").orderBy("seq").collect()]
    assert hot == [i for i in range(5000) if i % 3][:2500]
    assert got.count() == 2500 + 1667


def test_first_n_prunes_before_the_exchange(spark):
    df = spark.range(10).selectExpr("id % 2 as k", "id as seq")
    plan = first_n(df, ["k"], ["seq"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert rows(last_by(df, ["k"], ["seq"])) == [(0, 8), (1, 9)]


def test_grounding(spark):
    lines = spark.createDataFrame([("r", "f", 1, 5, "x"), ("r", "f", 1, 6, "y")], schemas.LINE)
    df = findings(spark, [("f", 5, "INFO", "a"), ("f", 7, "INFO", "b"), ("g", 5, "INFO", "c"),
                          ("f", None, "INFO", "d")])
    got = {r.seq: (r.grounded, r.reason) for r in cm.ground_comments(df, lines).collect()}
    assert got == {0: (True, "ok"), 1: (False, "line_not_added"), 2: (False, "file_not_changed"),
                   3: (False, "no_line")}


def test_suppress_only_what_is_open_and_ours(spark):
    df = findings(spark, [("f", 1, "INFO", "same\ntext"), ("g", 1, "INFO", "same\ntext"),
                          ("f", 2, "WARNING", "same\ntext"), ("h", 1, "INFO", "other")])
    posted = spark.createDataFrame(
        [("r", 1, "f", "**[INFO] Bot**\n\nsame\ntext", None),
         ("r", 2, "f", "**[WARNING] Bot**\n\nsame\ntext", 9), ("r", 3, "h", "other", None),
         ("r", 4, "g", None, None)], schemas.POSTED)
    left = cm.suppress_repeats(df, posted, "Bot")
    assert [r.seq for r in left.orderBy("seq").collect()] == [1, 2, 3]


def test_summary_and_feedback(spark):
    raw = findings(spark, [("f", 1, "INFO", "a"), ("f", 2, "BLOCKER", "b"), ("g", 3, "odd", "c")])
    got = cm.review_summary(raw, raw.filter("seq < 2")).first().asDict()
    assert got == {"review_id": "r", "found": 3, "blocker": 1, "warning": 0, "info": 1, "posted": 2,
                   "files_flagged": 1}
    posted = spark.createDataFrame(
        [("r", 1, "b", "x Bot", 0), ("r", 2, "a", "Bot y", 5), ("r", 3, "a", "Bot", None),
         ("r", 4, "z", "human", None), ("r", 5, "z", None, None), ("s", 1, "q", "human", None)],
        schemas.POSTED)
    stats = {r.review_id: r for r in fb.feedback_stats(posted, "Bot", "svc").collect()}
    r = stats["r"]
    assert (r.total_previous, r.resolved, r.open, r.dismissed) == (3, 1, 2, 0)
    assert r.previously_flagged_files == ["a", "b"] and "files: a, b." in r.summary
    assert stats["s"].summary == "This is the first svc review on this PR."


def test_outbox(spark):
    df = findings(spark, [("f", 3, "INFO", 'say "hi"'), (None, None, None, None)])
    for vcs in ("github", "gitlab", "bitbucket"):
        reviews = spark.createDataFrame([("r", vcs, "o/r", 7, "sha")],
                                        "review_id string, vcs string, repo string, "
                                        "pr_number long, head_sha string")
        one, two = review_outbox(df, reviews, "Bot").orderBy("seq").collect()
        text = '**[INFO] Bot**\n\nsay "hi"'
        want = {"github": {"path": "f", "line": 3, "side": "RIGHT", "body": text},
                "gitlab": {"body": text, "position": {
                    "base_sha": "sha", "start_sha": "sha", "head_sha": "sha",
                    "position_type": "text", "new_path": "f", "new_line": 3}},
                "bitbucket": {"content": {"raw": text}, "inline": {"to": 3, "path": "f"}}}[vcs]
        assert json.loads(one.payload) == want and one.sendable
        assert two.sendable == (vcs != "github")


def test_bundle_is_cut_like_the_whole_text(spark):
    patches = [(f"f{i}", "p" * (i % 40)) for i in range(300)]
    df = spark.createDataFrame([("r", n, p, i) for i, (n, p) in enumerate(patches)],
                               "review_id string, filename string, patch string, pos int")
    for budget in (10, 500, 8000):
        want = "\n".join(f"File: {n}\n{p}" for n, p in patches if p)[:budget]
        assert infer.patch_bundle(df, "plain", budget).first().bundle == want
        want = "".join(f"\n### File: `{n}`\n```\n{p}\n```\n" for n, p in patches if p)[:budget]
        assert infer.patch_bundle(df, "markdown", budget).first().bundle == want
