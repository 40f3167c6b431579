"""Keys that hold most rows, and texts that must not travel with every row."""

import random

from pyspark.sql import functions as F

from plain_rows import rows
from reviewframe import fixed_values as fx
from reviewframe.functions.joins import SPREAD, spread_join
from reviewframe.functions.windows import first_n
from reviewframe.operators import comments as cm
from reviewframe.operators import diffs as df_
from reviewframe.operators import infer as inf
from reviewframe.operators import nodes as nd
from reviewframe.operators import rules as ru
from reviewframe.operators.policy import policy_resolve


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_reviews_texts_join_last(spark):
    """The summary names all paths of a review: in an exchange by file it would be copied for each of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diffs = spark.createDataFrame([("r", "f", "[1]"), ("r", "g", "[2]"), ("q", "f", "[3]"), (None, "f", "[4]")],
                                      "review_id string, filename string, added_lines string")
        context = spark.createDataFrame([("r", "g", "c")], "review_id string, filename string, context string")
        policies = spark.createDataFrame([("r", "p"), ("q", "o")], "review_id string, policy_text string")
        notes = spark.createDataFrame([("r", "told"), ("z", "none")], "review_id string, summary string")
        made = inf.review_inputs(diffs, context, policies, notes, "bot")
        exchanges = [p for p in _plan(made.select("filename", "context", "summary")).split("Exchange")[1:]
                     if p.startswith(" hashpartitioning(review_id") and "filename" in p.split(")")[0]]
        assert exchanges and not any("summary" in e.split("Sort")[0] for e in exchanges)
        # The rows that meet by file are those of the join below the last one.
        assert _plan(made).index("summary") < _plan(made).index("hashpartitioning(review_id")
        by_file = [line for line in _plan(made).splitlines() if "SortMergeJoin [review_id" in line]
        assert "_group" in by_file[0] and "filename" in by_file[1]
        assert rows(made.select("review_id", "filename", "policy_text", "summary", "context")) == sorted([
            ("r", "f", "p", "told", None), ("r", "g", "p", "told", "c"),
            ("q", "f", "o", "This is the first bot review on this PR.", None),
            (None, "f", None, "This is the first bot review on this PR.", None)], key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_meet_once_for_the_nested_form(spark):
    rng = random.Random(3)
    given = [(rng.choice(["r", None]), rng.choice("fg"), rng.choice([None, 1, 2, 5]), rng.choice([None, 1, 3, 4]),
              rng.choice(["x", "y"])) for _ in range(200)]
    df = spark.createDataFrame(given, "review_id string, filename string, hunk_no int, line_num int, content string")
    nested = df_.hunks_nested(df)
    assert _plan(nested).count("Exchange") == 1
    low = lambda x: tuple((v is not None, v) for v in x)
    want = {}
    for r, f, *x in sorted(given, key=lambda g: low(g[2:])):
        want.setdefault((r, f), {}).setdefault(x[0], []).append((x[1], x[2]))
    got = {(n.review_id, n.filename): [[tuple(x) for x in h] for h in n.hunks] for n in nested.collect()}
    assert got == {k: list(v.values()) for k, v in want.items()}
    assert rows(df_.lines_in_hunks(nested)) == rows(df_.changed_lines(df))


def test_blocks_of_any_size_travel_alike(spark):
    """Small blocks are cut inside a task: no row is repeated for them."""
    import numpy as np
    from reviewframe.operators import vectors as ve

    rng = np.random.default_rng(7)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, size=(300, 4)))]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    q, c = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id")
    unit = ve._matrix(__import__("pyarrow").array([v for _, v in data]))
    scores = np.round(unit @ unit.T, 12)
    want = {(i, int(j), n + 1) for i in range(300) for n, j in enumerate(np.lexsort((np.arange(300), -scores[i]))[:5])}
    small = ve.knn(q, c, 5, chunk_block=3, query_block=7)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in small.collect()} == want
    copies = [line for line in _plan(small).splitlines() if "Generate explode(sequence(0" in line]
    assert not copies or all("sequence(0, 0" in line for line in copies)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in ve.knn(q, c, 5).collect()} == want


def test_walks_decode_compiled(spark):
    """Over 64 seeds of a graph, with bit 63 and copies of hops: every bit comes back, and no list is walked in a lambda."""
    from reviewframe.operators import graph as gr

    edges = [("g", f"s{i:03}", f"h{i % 7}", "CALLS") for i in range(150)] + [("g", f"h{i}", "t", "CALLS") for i in range(7)]
    df = spark.createDataFrame(edges, "graph_id string, src string, dst string, type string")
    seeds = spark.createDataFrame([("g", f"s{i:03}") for i in range(150)], "graph_id string, name string")
    found = gr.blast_radius(df, seeds)
    assert "lambda" not in _plan(found.filter("hops = 1")).split("Project")[1]
    got = {tuple(r) for r in found.select("seed", "name", "direction", "hops").collect()}
    assert got == {(f"s{i:03}", f"h{i % 7}", "callee", 1) for i in range(150)} | {(f"s{i:03}", "t", "callee", 2) for i in range(150)}


def test_a_hot_review_meets_its_policy_in_groups(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(4000).selectExpr("if(id % 9 = 0, null, 'hot') as review_id", "id as seq", "cast(id % 5 as string) as file_path",
                                          "cast(id as int) as line", "'INFO' as severity", "cast(id as string) as body")
        policies = spark.createDataFrame([("hot", 1, 1500), ("hot2", 1, 1)], "review_id string, min_rank int, max_comments int")
        for run in (cm.cap_comments, cm.noise_control):
            found = run(df, policies)
            # The join's groups serve the first cut: the whole rows are not dealt by review alone before the last cut.
            assert _plan(found).count("hashpartitioning(review_id") == (4 if run is cm.cap_comments else 5)
            kept = found.collect()
            assert [r.seq for r in sorted(kept, key=lambda r: r.seq) if r.review_id] == [i for i in range(4000) if i % 9][:1500]
            assert len([r for r in kept if r.review_id is None]) == 15
        assert cm.filter_severity(df, policies).count() == 4000
        assert "hashpartitioning(review_id#" in _plan(cm.filter_severity(df, policies)) and "_group" in _plan(cm.filter_severity(df, policies))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_parts_calls_are_dealt_once(spark, tmp_path):
    from reviewframe.workload import fixtures as fx_

    spark.createDataFrame([(1, "B#1"), (2, "B#1")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 5), (1, 5), (1, 3), (1, None), (None, 4)], "l_partkey long, l_suppkey long").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    tree = fx_.source_tree(spark, str(tmp_path))
    assert _plan(tree).count("hashpartitioning(l_partkey") == 1
    calls = {r.tree_pos: [x.strip() for x in r.content.split("\n") if x.startswith("    s_")] for r in tree.collect()}
    assert calls == {1: ["s_3(x)", "s_5(x)"], 2: []}


def test_changed_lines_meet_once_for_code_and_context(spark, tmp_path):
    from reviewframe.plans import review as pr

    spark.createDataFrame([("r", "f.py", 1, 1, "x")] * 3 + [("r", "f.py", 1, None, "x")],
                          "review_id string, filename string, hunk_no int, line_num int, content string").write.parquet(f"{tmp_path}/lines")
    code = spark.createDataFrame([("o", "m", "f.py", "def a():\n    b()\n\ndef b():\n    pass\n")],
                                 "repo string, ref string, file_path string, content string")
    reviews = spark.createDataFrame([("r", "o", "m")], "review_id string, repo string, ref string")
    parts = pr.review_context(code, spark.read.parquet(f"{tmp_path}/lines"), reviews)
    assert [tuple(r)[:3] for r in parts.collect()] == [("r", "f.py", "b")]
    final = _plan(parts).split("Initial Plan")[0]
    assert "ReusedExchange" in final or final.count("hashpartitioning(review_id") == 1


def test_hunks_stay_by_review_while_they_are_scanned(spark):
    """Found small when the hunks have moved, the lists would let one task scan all that one task wrote."""
    hunk = "array(struct(1 AS line_num, 'x = eval(1)' AS content, CAST(NULL AS STRING) AS prev_content)) AS hunk"
    hunks = spark.range(200).selectExpr("concat('r', id % 20) AS review_id", "concat('f', id) AS filename", "1 AS hunk_no", hunk)
    reviews = spark.range(15).selectExpr("concat('r', id) AS review_id", "'org/a' AS repo")
    policies = policy_resolve(reviews, spark.createDataFrame([("org/a", '{"security": {"forbidden_apis": ["eval("]}}')],
                                                             "repo string, config string"))
    found = ru.rule_scan(hunks, None, policies)
    assert "ShuffledHashJoin [review_id" in _plan(found)
    got = rows(found.select("file_path", "rule").filter("rule = 'G1'"))
    with_default = {n for n in range(200) if n % 20 < 15 or "eval(" in fx.DEFAULT_POLICY["security"]["forbidden_apis"]}
    assert got == sorted([(f"f{n}", "G1") for n in with_default], key=repr)


def test_definitions_are_batched_by_columns():
    """A batch is made from columns, not from rows; what a row lacks is null."""
    made = nd._batch([{"repo": "o", "node_name": "f", "dependencies": ["a", "b"], "has_docstring": True, "start_line": 3},
                      {"repo": "o", "error": "SyntaxError: x"}])
    assert made.schema == nd._EXTRACTED and made.num_rows == 2
    assert made.to_pylist()[0]["dependencies"] == ["a", "b"] and made.to_pylist()[1]["dependencies"] is None
    assert made.to_pylist()[1]["error"] == "SyntaxError: x" and nd._batch([]).num_rows == 0


def test_a_summary_moves_no_bodies_and_spreads_a_review(spark):
    """Most comments are one review's: they meet its policy by group, and their texts stay where they are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = spark.range(400).selectExpr(
            "if(id % 10 = 0, 'q', 'r') AS review_id", "id AS seq", "concat('f', id % 7) AS file_path", "1 AS line",
            "if(id % 2 = 0, 'BLOCKER', 'INFO') AS severity", "concat('text ', id) AS body")
        policies = spark.createDataFrame([("r", 2, 30), ("q", 1, 5), ("none", 1, 5)], "review_id string, min_rank int, max_comments int")
        made = cm.review_summary(raw, cm.noise_control(raw, policies), policies)
        plan = _plan(made)
        assert any("SortMergeJoin" in line and "_group" in line for line in plan.splitlines())
        # Texts are cut to a key's prefix before anything moves.
        assert "body#" not in plan.split("Exchange")[1].splitlines()[1]
        found = {r.review_id: (r["found"], r.blocker, r.info, r.posted) for r in made.collect()}
        assert found == {"r": (360, 160, 200, 30), "q": (40, 40, 0, 5), "none": (0, 0, 0, 0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_of_seeds_join_only_where_asked_for(spark):
    """Who asks for the names met, not for the seeds, moves no lists of seeds; a seed is never met by its own walk."""
    from reviewframe.operators import graph as gr

    edges = [("g", "a", "b"), ("g", "b", "a"), ("g", "b", "b"), ("g", "b", "c"), ("g", "b", "c"), ("g", None, "c"), ("g", "a", None)]
    df = spark.createDataFrame(edges, "graph_id string, src string, dst string")
    seeds = spark.createDataFrame([("g", "a"), ("g", "c"), ("g", "gone")], "graph_id string, name string")
    found = gr.blast_radius(df, seeds)
    assert rows(found) == sorted([("g", "a", "b", "callee", 1), ("g", "a", "c", "callee", 2), ("g", "a", "b", "caller", 1),
                                  ("g", "c", "b", "caller", 1), ("g", "c", "a", "caller", 2)])
    met = found.select("graph_id", "name").distinct()
    assert "collect_list" in _plan(found) and "collect_list" not in _plan(met)
    assert rows(met) == [("g", "a"), ("g", "b"), ("g", "c")]


def test_a_graphs_lines_are_dealt_once(spark, tmp_path):
    """Edges of both directions and nodes share one exchange of lines; what has no supplier or part stays as it was."""
    from reviewframe.operators import graph as gr
    from reviewframe.workload import fixtures as fx_

    for name, given, schema in (
            ("part", [(1, "B1"), (2, "B1"), (3, "B2"), (None, "B2")], "p_partkey long, p_brand string"),
            ("supplier", [(5, 0, "five"), (6, 1, "six"), (None, 1, "none")], "s_suppkey long, s_nationkey long, s_name string"),
            ("lineitem", [(1, 5), (1, 5), (2, 6), (3, 6), (2, 9), (1, None), (None, 5), (None, None)], "l_partkey long, l_suppkey long")):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    edges, seeds, nodes = fx_.supply_graph(spark, str(tmp_path))
    assert rows(edges.select("graph_id", "src", "dst")) == sorted([
        ("B1", "p_1", "s_5"), ("B1", "p_2", "s_6"), ("B1", "p_2", "s_9"), ("B2", "p_3", "s_6"), ("B1", "p_1", None),
        ("B1", "s_5", "n_0"), ("B1", "s_6", "n_1"), ("B2", "s_6", "n_1")], key=repr)
    assert rows(nodes) == [("B1", "s_5", "five"), ("B1", "s_6", "six"), ("B2", "s_6", "six")]
    made = gr.blast_context(gr.blast_radius(edges, seeds), nodes, seeds)
    assert {r.graph_id: r.context.count("Dependency: ") for r in made.collect()} == {"B1": 2, "B2": 1}
    final = _plan(made).split("Initial Plan")[0]
    dealt = [line for line in final.splitlines() if "Exchange hashpartitioning(l_partkey" in line]
    assert len([line for line in dealt if "Reused" not in line]) == 1


def test_what_a_reviews_texts_give_is_worked_out_once_a_review(spark, tmp_path):
    """A summary names all paths of its review: hashed for each of its files, the work is the square of the files."""
    import hashlib

    from reviewframe.workload import fixtures as fx_
    from reviewframe.workload.queries import QUERIES

    spark.createDataFrame([(i, "Brand#12", 30) for i in range(8)] + [(8, "Brand#13", 1)], "p_partkey long, p_brand string, p_size int").write.parquet(
        f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, i, 5) for i in range(9)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = QUERIES["review_inputs_composed"](spark, str(tmp_path))
    hashed = [line for line in _plan(made).split("Initial Plan")[0].splitlines() if "md5(" in line]
    assert hashed and not any("filename#" in line or "added_lines" in line for line in hashed)
    told = (f"FEEDBACK CONTEXT: {fx_.SERVICE} previously posted 4 comments on this PR. 2 were resolved by the developer (accepted), 2 are still "
            "open. Previously flagged files: pkg/m0, pkg/m2, pkg/m4, pkg/m6. Avoid re-posting the same issues on unchanged lines.")
    first = f"This is the first {fx_.SERVICE} review on this PR."
    want = {"rv-Brand#12": told, "rv-Brand#13": first}
    got = made.select("review_id", "filename", "summary", "lines").collect()
    assert sorted(r.filename for r in got) == [f"pkg/m{i}.py" for i in range(9)] and all(r["lines"] == 1 for r in got)
    assert all(r.summary == hashlib.md5(want[r.review_id].encode()).hexdigest() for r in got)


def test_columns_of_a_review_equal_those_of_its_texts(spark):
    diffs = spark.createDataFrame([("r", "f", "[1]"), ("r", "g", "[2]"), ("q", "f", "[3]"), ("n", "f", "[3]"), ("z", "f", "[5]"), (None, "f", "[4]")],
                                  "review_id string, filename string, added_lines string")
    context = spark.createDataFrame([("r", "g", "c")], "review_id string, filename string, context string")
    policies = spark.createDataFrame([("r", "p"), ("q", "o"), (None, "x")], "review_id string, policy_text string")
    notes = spark.createDataFrame([("r", "told"), ("z", "none"), ("q", None), (None, "y")], "review_id string, summary string")
    made = inf.review_inputs(diffs, context, policies, notes, "bot", {"size": lambda p, _: F.length(p), "told": lambda p, s: F.concat(
        F.lower(s), F.lit("/"), F.coalesce(p, F.lit("-")))})
    by_file = made.select("review_id", "filename", F.length("policy_text"), F.concat(F.lower("summary"), F.lit("/"), F.coalesce("policy_text", F.lit("-"))))
    assert rows(made.select("review_id", "filename", "size", "told")) == rows(by_file)
    assert ("n", "f", None, "this is the first bot review on this pr./-") in rows(by_file) and ("r", "g", 1, "told/p") in rows(by_file)


def test_changed_files_are_dealt_by_place_once(spark):
    """Code and context share one exchange of files, by repo, ref and path also where the planner knows the reviews' only ref."""
    from reviewframe.plans import review as pr

    a = "def a():\n    b()\n\ndef b():\n    pass\n"
    code = spark.createDataFrame([(*c, a) for c in (("o", "m", "f.py"), ("o", "m", "g.py"), ("o", "m", "h.txt"), ("p", "m", "f.py"), ("o", "m", None),
                                                    ("o", "m", "f.py"), ("o", "n", "f.py"))],
                                 "repo string, ref string, file_path string, content string")
    lines = spark.createDataFrame(
        [("r", "f.py", 1, 1, "x")] * 2 + [("q", "f.py", 1, 4, "x"), ("q", "g.py", 1, None, "x"), ("q", "h.txt", 1, 1, "x"),
                                          ("r", None, 1, 1, "x"), (None, "f.py", 1, 1, "x"), ("gone", "f.py", 1, 1, "x")],
        "review_id string, filename string, hunk_no int, line_num int, content string")
    reviews = spark.createDataFrame([("r", "o"), ("q", "o"), ("s", "p")], "review_id string, repo string").withColumn("ref", F.lit("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for given in (lines, df_.lines_in_hunks(df_.hunks_nested(lines))):
            parts = pr.review_context(code, given, reviews)
            assert sorted(tuple(r)[:3] for r in parts.collect()) == [("q", "f.py", "a"), ("r", "f.py", "b")]
            final = _plan(parts).split("Initial Plan")[0]
            dealt = [line for line in final.splitlines() if "Exchange hashpartitioning(repo" in line]
            made = [line for line in dealt if "Reused" not in line]
            # Files, code and definitions, once each.
            assert len(made) == 3 and len(dealt) == 4 and all("ref#" in line.split(")")[0] for line in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_source_text_is_made_once(spark, tmp_path):
    from reviewframe.workload import fixtures as fx_

    spark.createDataFrame([(1, "B#1"), (49, "B#1")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 5), (1, 3)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    tree = fx_.source_tree(spark, str(tmp_path)).filter("length(content) > 0 AND size < 1000")
    assert _plan(tree).count("array_join") == 1
    assert rows(tree.select("repo", "ref", "file_path", "kind", "size")) == [
        ("org/B#1", "main", "pkg/m1.py", "blob", 125), ("org/B#1", "main", "pkg/m49.py", "blob", 13)]


def test_hunks_are_slices(spark):
    """Per line only the change of hunk is looked for; the lines of a hunk are not made again one by one."""
    df = spark.createDataFrame([("r", "f", 2, 5, "b"), ("r", "f", None, 7, None), ("r", "f", 1, None, "a"), ("r", "f", 2, 3, "c"), ("r", "f", 1, 9, "d")],
                               "review_id string, filename string, hunk_no int, line_num int, content string")
    nested = df_.hunks_nested(df)
    assert [[tuple(x) for x in h] for h in nested.first().hunks] == [[(7, None)], [(None, "a"), (9, "d")], [(3, "c"), (5, "b")]]
    plan = _plan(nested)
    assert "slice(" in plan and "named_struct(line_num, lambda" not in plan and "struct(line_num, lambda" not in plan
