import json

from plain_rows import rows
from pyspark.sql import functions as F

from reviewframe import fixed_values as fx
from reviewframe import schemas
from reviewframe.operators import files as fl
from reviewframe.operators import policy as po
from reviewframe.sources.changed_files import changed_files


def resolved(spark, *configs):
    reviews = spark.createDataFrame([(f"r{i}", f"o/{i}") for i in range(len(configs))],
                                    "review_id string, repo string")
    overrides = spark.createDataFrame(
        [(f"o/{i}", c) for i, c in enumerate(configs) if c is not None] or [("x", "{}")],
        schemas.POLICY_OVERRIDE)
    out = po.policy_resolve(reviews, overrides).withColumns({
        "text": po.policy_text(), "style_text": po.policy_category_text(F.lit(" Style"))})
    return [r for r in out.orderBy("review_id").collect()]


def test_shallow_merge(spark):
    none, empty, broken, group, limits, alias = resolved(
        spark, None, "{}", "{oops", '{"security": {"flag_hardcoded_secrets": true}, "style": {}}',
        '{"max_comments_per_pr": 2, "max_comments": 9, "severity_filter": "Blocker"}',
        '{"max_comments": "4", "severity_filter": "LOUD", "ignore_paths": []}')
    for r in (none, empty, broken):
        assert r.max_comments == 15 and r.min_rank == 1 and r.security.forbidden_apis[0] == "eval("
        assert r.ignore_paths == fx.DEFAULT_POLICY["ignore_paths"]
    assert group.security.forbidden_apis == [] and group.security.flag_hardcoded_secrets
    assert not group.security.require_parameterized_queries and group.performance.flag_n_plus_one
    assert group.style_text == "Require docstrings: False\nNaming: any\nFlag dead code: False"
    assert group.text.splitlines()[0] == "- " + fx.POLICY_LINES["flag_hardcoded_secrets"]
    assert (limits.max_comments, limits.min_rank) == (2, 3)
    assert (alias.max_comments, alias.min_rank, alias.ignore_paths) == (4, 1, [])


def test_no_rules_sentence(spark):
    r, = resolved(spark, '{"security": {}, "performance": {}, "style": {}}')
    assert r.text == fx.POLICY_EMPTY


def test_reviewable(spark):
    files = spark.createDataFrame(
        [("r0", n, s, p) for n, s, p in [
            ("a.py", "modified", "x"), ("a.py2", "renamed", "x"), ("b.py", "added", ""),
            ("c.py", "added", None), ("d/x.lock", "added", "x"), ("e.min.js", "added", "x"),
            ("migrations/a/b.py", "added", "x"), ("f.gif", "added", "x"), ("G.PNG", "added", "x"),
            ("x.generated.y", "added", "x")]], schemas.FILE)
    policies = po.policy_resolve(
        spark.createDataFrame([("r0", "o")], "review_id string, repo string"),
        spark.createDataFrame([("z", "{}")], schemas.POLICY_OVERRIDE))
    kept = [r.filename for r in fl.reviewable_files(files, policies).orderBy("filename").collect()]
    assert kept == ["G.PNG", "a.py"]
    assert rows(fl.reviewable_files(files)) == rows(fl.reviewable_files(files, policies).select(
        *files.columns))
    short = fl.reviewable_files(files, None, fx.SKIP_EXTENSIONS_SHORT)
    assert short.filter("filename = 'f.gif'").count() == 1


def test_code_files_cap_in_tree_order(spark):
    tree = spark.createDataFrame(
        [("o", "m", i, n, k, s, "x") for i, (n, k, s) in enumerate([
            ("z.py", "blob", 10), ("dir.py", "tree", 0), ("b.jsx", "blob", 5), ("noext", "blob", 5),
            ("c.ts", "blob", 60000), ("d.js", "blob", 50000), ("a.py", "blob", 1)])],
        schemas.CODE_FILE)
    first = fl.code_files(tree, max_files=3)
    assert [r.file_path for r in first.orderBy("tree_pos").collect()] == ["z.py", "c.ts", "d.js"]
    stored = fl.code_files(tree, fx.INDEX_EXTENSIONS_TABLE, 9, 50000)
    assert [r.file_path for r in stored.orderBy("tree_pos").collect()] == ["z.py", "b.jsx", "a.py"]


def test_provider_responses(spark):
    raw = lambda payload, diff="": spark.createDataFrame(
        [("r", json.dumps(payload), diff)], "review_id string, payload string, diff string")
    gl = changed_files(raw({"changes": [
        {"new_path": "", "old_path": "o.py", "diff": "d", "new_file": True, "deleted_file": True},
        {"new_path": "n.py", "old_path": "o", "deleted_file": True},
        {"new_path": "m.py"}]}), "gitlab")
    assert rows(gl, "filename") == [("r", "m.py", "modified", ""), ("r", "n.py", "deleted", ""),
                                    ("r", "o.py", "added", "d")]
    bb = changed_files(raw({"values": [
        {"new": None, "old": {"path": "gone"}, "status": "removed"},
        {"new": {"path": "n"}, "old": {"path": "o"}, "status": "renamed"},
        {"new": {"path": "q"}, "status": "weird"}]}, "diff --git a/o b/n\n+1\n"), "bitbucket")
    assert rows(bb, "filename") == [("r", "gone", "deleted", ""),
                                    ("r", "n", "modified", "diff --git a/o b/n\n+1\n"),
                                    ("r", "q", "modified", "")]
    gh = changed_files(raw([{"filename": "f", "status": "renamed", "patch": "p"}]), "github")
    assert rows(gh) == [("r", "f", "renamed", "p")]
