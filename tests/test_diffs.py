import random

from plain_rows import rows
from pyspark.sql import functions as F

from reviewframe import schemas
from reviewframe.operators import diffs


HUNKS = [  # patch, added lines by hunk
    (None, []), ("", []), ("+only", []), ("@@ -1 +1 @@", []),
    ("@@ -1 +1 @@\n+x", [[(1, "x")]]),
    ("@@ -1,2 +7,3 @@ def f\n keep\n+new\n-old\n\n+last\n", [[(8, "new"), (10, "last")]]),
    ("text\n@@ -1 +5 @@\n+a\r\n+b\r\n", [[(5, "a"), (6, "b")]]),
    ("@@ -1 +1 @@\n-gone\n@@ -9 +20 @@\n+y", [[(20, "y")]]),
    ("@@ -1 +1 @@\n+a\n\\ No newline at end of file\n+b", [[(1, "a"), (2, "b")]]),
    ("@@ -1 +1 @@\n+a\n@@ broken\n+lost\n@@ -3 +30 @@\n+c", [[(1, "a")], [(30, "c")]]),
    ("@@ -1 +1 @@\n++ plus\n+", [[(1, "+ plus"), (2, "")]]),
]


def test_hunks_of_written_patches(spark):
    files = spark.createDataFrame([("r", str(i), "modified", p) for i, (p, _) in enumerate(HUNKS)],
                                  schemas.FILE)
    got = {}
    for r in diffs.parse_hunks(files).orderBy("hunk_no", "line_num").collect():
        got.setdefault(r.filename, {}).setdefault(r.hunk_no, []).append((r.line_num, r.content))
    for i, (patch, want) in enumerate(HUNKS):
        assert list(got.get(str(i), {}).values()) == want, repr(patch)


def test_added_and_kept_lines_rebuild_the_file(spark):
    """Patches made from two versions of a file: added lines sit where the new version has them."""
    rng = random.Random(7)
    patches, versions = [], []
    for _ in range(60):
        at, number, body, new = rng.randrange(1, 50), 0, [], {}
        number = at
        for _ in range(rng.randrange(1, 15)):
            kind, text = rng.choice("+- "), "line %d" % rng.randrange(99)
            body.append(kind + text)
            if kind != "-":
                if kind == "+":
                    new[number] = text
                number += 1
        patches.append("@@ -1 +%d @@\n" % at + "\n".join(body))
        versions.append(new)
    files = spark.createDataFrame([("r", str(i), "modified", p) for i, p in enumerate(patches)],
                                  schemas.FILE)
    got = {}
    for r in diffs.parse_hunks(files).collect():
        got.setdefault(int(r.filename), {})[r.line_num] = r.content
    assert [got.get(i, {}) for i in range(len(patches))] == versions


def test_fixture_example_and_flat_nested_round_trip(spark):
    files = spark.createDataFrame(
        [("r", "f", "added", "@@ -1,2 +1,3 @@\n a\n+b\n-c\n+d\n@@ -9 +20 @@\n-x\n@@ -9 +30 @@\n+y")],
        schemas.FILE)
    lines = diffs.parse_hunks(files)
    assert rows(lines, "line_num") == [("r", "f", 1, 2, "b"), ("r", "f", 1, 3, "d"),
                                       ("r", "f", 2, 30, "y")]
    assert rows(diffs.hunks_nested(lines)) == rows(diffs.nested_hunks(files))
    assert rows(diffs.lines_of_nested(diffs.hunks_nested(lines))) == rows(lines)
    assert rows(diffs.touched_lines(files)) == rows(diffs.changed_lines(lines))
    stats = {(r.level, r.filename): (r.added_lines, r.hunks)
             for r in diffs.diff_stats(lines).collect()}
    assert stats == {("file", "f"): (3, 2), ("review", ""): (3, 2)}
    prev = diffs.parse_hunks(files, with_prev=True).orderBy("line_num").collect()
    assert [r.prev_content for r in prev] == [None, "b", None]


def test_split_multifile_diff(spark):
    one = "diff --git a/x b/x\nindex 1\n@@ -1 +1 @@\n+x\n"
    two = "diff --git a/old b/dir/new \n+y\n"
    texts = ["", "no header\n+x\n", one, "lead\n" + one + two, "diff --git none\n+z\n" + two]
    want = [{}, {}, {"x": one}, {"x": one, "dir/new": two}, {"dir/new": two}]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)],
                               "review_id string, diff string")
    got = {}
    for r in diffs.split_multifile_diff(df).collect():
        got.setdefault(r.review_id, {})[r.filename] = r.patch
    assert [got.get(str(i), {}) for i in range(len(texts))] == want


def test_parsing_needs_no_exchange_and_no_python(spark):
    files = spark.createDataFrame([("r", "f", "added", "@@ -1 +1 @@\n+x")], schemas.FILE)
    plan = diffs.parse_hunks(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan
