"""The review as one program, on hand-written sources and answers."""

from plain_rows import rows

from reviewframe.plans.review import answered_requests, composed_inputs, context_texts, review_context
from reviewframe.operators.policy import policy_resolve

A = "def main():\n    helper()\n\n\ndef helper():\n    return 1\n\n\ndef far():\n    return 2\n"
B = "def main():\n    return 3\n"
CODE = "repo string, ref string, file_path string, content string"
LINES = "review_id string, filename string, hunk_no int, line_num int, content string"
REVIEWS = "review_id string, repo string, ref string"
POSTED = "review_id string, path string, body string, in_reply_to_id long"


def inputs(spark):
    code = spark.createDataFrame([("o", "x", "a.py", A), ("o", "x", "b.py", B), ("o", "x", "c.py", "def (")], CODE)
    lines = spark.createDataFrame([("r1", "a.py", 1, 6, "    return 1"), ("r2", "a.py", 1, 2, "    helper()"),
                                   ("r2", "b.py", 1, 2, "    return 3"), ("r2", "c.py", 1, 1, "def (")], LINES)
    return code, lines, spark.createDataFrame([("r1", "o", "x"), ("r2", "o", "x"), ("r3", "o", "x")], REVIEWS)


def test_context_is_each_reviews_own(spark):
    parts = review_context(*inputs(spark))
    assert rows(parts.select("review_id", "filename", "name")) == [("r1", "a.py", "main"), ("r2", "a.py", "helper")]
    texts = {r.review_id: r.context for r in context_texts(parts).collect()}
    assert texts["r1"] == "Dependency: main\ndef main():\n    helper()"


def test_inputs_of_reviews_without_context_or_feedback(spark):
    code, lines, reviews = inputs(spark)
    policies = policy_resolve(reviews, spark.createDataFrame([], "repo string, config string"))
    posted = spark.createDataFrame([("r1", "a.py", "Bot says", None)], POSTED)
    made = {(r.review_id, r.filename): r for r in
            composed_inputs(lines, code, reviews, policies, posted, "Bot", "bot").collect()}
    assert set(made) == {("r1", "a.py"), ("r2", "a.py"), ("r2", "b.py"), ("r2", "c.py")}
    assert made["r2", "c.py"].context is None and "return 3" in made["r2", "b.py"].message
    assert made["r2", "b.py"].summary == "This is the first bot review on this PR."
    assert made["r1", "a.py"].summary.startswith("FEEDBACK CONTEXT: bot previously posted 1 ")


def test_answers_to_requests(spark):
    files = spark.createDataFrame(
        [("r1", "a.py", "modified", "@@ -1 +1,2 @@\n+x = 1\n y"), ("r1", "l.lock", "modified", "@@ -1 +1 @@\n+z")],
        "review_id string, filename string, status string, patch string")
    told = ('[{"file_path": "a.py", "line": 1, "severity": "INFO", "body": "new"},'
            ' {"file_path": "a.py", "line": 1, "severity": "INFO", "body": "new"},'
            ' {"file_path": "a.py", "line": 2, "severity": "INFO", "body": "context line"},'
            ' {"file_path": "l.lock", "line": 1, "severity": "INFO", "body": "skipped file"},'
            ' {"file_path": "a.py", "line": 1, "severity": "INFO", "body": "posted"}, {"file_path": null}]')
    answers = spark.createDataFrame([("r1", 1, told), ("r1", 2, None), ("r1", 3, "")],
                                    "review_id string, seq long, content string")
    reviews = spark.createDataFrame([("r1", "github", "o", 7, "sha")],
                                    "review_id string, vcs string, repo string, pr_number long, head_sha string")
    posted = spark.createDataFrame([("r1", "a.py", "**[INFO] Bot**\n\nposted", None)], POSTED)
    policies = policy_resolve(reviews, spark.createDataFrame([], "repo string, config string"))
    sent = answered_requests(answers, files, policies, posted, reviews, "Bot").collect()
    assert [(r.seq.seq, r.seq.pos, r.fallback, r.sendable) for r in sent] == [(1, 0, "**[INFO] Bot**\n\nnew", True)]


def random_graphs(spark, seed):
    """Definitions of six files with repeated names, undefined callees, empty texts and self calls; changed lines."""
    import random

    rng = random.Random(seed)
    nodes, touched = [], []
    for f in range(6):
        for i in range(rng.randrange(1, 25)):
            start = 10 * i
            calls = sorted({f"n{rng.randrange(30)}" for _ in range(rng.randrange(4))})
            nodes.append(("o/r", "main", f"f{f}.py", "function", f"n{rng.randrange(18)}",
                          rng.choice(["", None, f"text {f} {i}", f"more {i}"]), start, start + rng.randrange(14), calls, False))
        for review in ("a", "b"):
            touched.append((review, f"f{f}.py", sorted(rng.sample(range(260), rng.randrange(0, 4)))))
    return (spark.createDataFrame(nodes, "repo string, ref string, file_path string, node_type string, node_name string, "
                                  "content string, start_line int, end_line int, dependencies array<string>, "
                                  "has_docstring boolean"),
            spark.createDataFrame(touched, "review_id string, filename string, line_nums array<int>"),
            spark.createDataFrame([("a", "o/r", "main"), ("b", "o/r", "main")], "review_id string, repo string, ref string"))


def test_walk_in_the_row_equals_the_joined_walk(spark):
    from pyspark.sql import functions as F

    from reviewframe.operators import graph as gr
    from reviewframe.operators.nodes import call_edges, graph_nodes, modified_nodes

    scope = ("repo", "ref", "file_path")
    for seed, depth in ((1, 1), (2, 2), (3, 3)):
        nodes, lines, reviews = random_graphs(spark, seed)
        touched = lines.join(reviews, "review_id").withColumnRenamed("filename", "file_path")
        seeds = modified_nodes(nodes, lines, reviews).select(
            "review_id", F.concat_ws("@", *scope).alias("graph_id"), F.col("node_name").alias("name")).distinct()
        edges = call_edges(nodes, scope)
        joined = gr.review_parts(gr.blast_radius(edges, seeds, depth), graph_nodes(nodes, edges, scope), seeds).select(
            "review_id", F.element_at(F.split("graph_id", "@"), -1).alias("filename"), "name", "part")
        want = rows(joined)
        assert want and rows(gr.file_contexts(nodes, touched, depth)) == want


def test_no_job_runs_while_the_context_is_planned(spark):
    given = inputs(spark)
    spark.sparkContext.setJobGroup("planning", "no job")
    try:
        found = review_context(*given)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1  # code is parsed once
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() > 0
