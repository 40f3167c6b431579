import fnmatch
import random

from pyspark.sql import functions as F

from reviewframe.functions import text as tx
from reviewframe.functions.hmac import hmac_sha256


def column(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r.y for r in df.select(fn.alias("y")).collect()]


def test_globs_match_the_standard_library(spark):
    rng = random.Random(11)
    letters = ["a", "b", ".", "/", "[", "]", "!", "*", "?", "-", "+", "\\", "^", "(", "$", "&", "é"]
    pairs = [("".join(rng.choices(letters, k=rng.randrange(0, 6))),
              "".join(rng.choices(letters, k=rng.randrange(0, 6)))) for _ in range(3000)]
    pairs += [("src/a.min.js", "*.min.js"), ("migrations/1/x.py", "migrations/*"), ("a\nb", "a?b")]
    # Hyphen corner cases inside a class differ between standard-library versions.
    pairs = [(p, g) for p, g in pairs if not ("[" in g and "-" in g)]
    got = column(spark, pairs, tx.glob_match(F.col("p"), F.col("g")), "p string, g string")
    for (path, glob), hit in zip(pairs, got):
        assert hit == fnmatch.fnmatchcase(path, glob), (path, glob)
    one = column(spark, ["a.lock", "b.py"], F.rlike(F.col("x"), tx.globs_to_regex(
        F.array(F.lit("*.lock"), F.lit("c*")))))
    assert one == [True, False]
    assert column(spark, ["a"], F.rlike(F.col("x"), tx.globs_to_regex(
        F.array().cast("array<string>")))) == [False]


FENCED = [  # text, last fence, first fence
    ("[1]", "[1]", "[1]"),
    ("", "", ""),
    ("```json\n[1]\n```", "[1]", "[1]"),
    ("```\n[2]\n```", "[2]", "[2]"),
    ("a ```json [1]``` b ```json [2]``` c", "[2]", "[1]``` b ```json [2]"),
    ("```JSON\n[3]\n```", "JSON\n[3]", "[3]"),
    ("```json\n[4]", "[4]", "[4]"),
    ("x ```[5]", "[5]", "[5]"),
    ("```json``` [6]", "", ""),
    ("``` a ``` b ```", "a", "a ``` b"),
    ("Here:\n```json\n{\"a\": 1}\n```\nDone", '{"a": 1}', '{"a": 1}'),
]


def test_fences(spark):
    texts = [t for t, _, _ in FENCED]
    assert column(spark, texts, tx.strip_fence_last(F.col("x"))) == [last for _, last, _ in FENCED]
    assert column(spark, texts, tx.strip_fence_first(F.col("x"))) == [first for _, _, first in FENCED]


def test_split_lines_matches_splitlines(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb\rc", "a\n\nb\n\n", "x y\x85z\x1c", "\r\n"]
    assert column(spark, texts, tx.split_lines(F.col("x"))) == [t.splitlines() for t in texts]


def test_small_scalars(spark):
    assert column(spark, ["HTTP 429", "Rate", "404 quota", "Not Found", "x", None],
                  tx.classify_error(F.col("x"))) == [
        "rate_limited", "rate_limited", "rate_limited", "not_found", "other", "other"]
    assert column(spark, [("bypass", 0), ("no", 3), ("no", 2), (None, None)],
                  tx.grade_done(F.col("a"), F.col("b")), "a string, b int") == [
        True, True, False, False]
    assert column(spark, ["BLOCKER", "blocker", None, "INFO", "WARNING"],
                  tx.severity_rank(F.col("x"))) == [3, 1, 1, 1, 2]
    assert column(spark, ["2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00", "bad", "123", None],
                  F.unix_seconds(tx.parse_ts(F.col("x")))) == [
        1704060000, 1704067200, None, None, None]
    assert column(spark, ["a.py", "b", "c.jsx", "d.min.js", ".ts"],
                  tx.language_of(F.col("x"))) == ["python", None, None, "javascript", "typescript"]
    assert column(spark, ["w/s/t", "none"], tx.split_repo(F.col("x"))[1]) == ["s/t", None]
    assert column(spark, ["has MARK", None],
                  tx.append_description(F.col("x"), F.lit("T"), "MARK")) == [
        "has MARK", "\n\n---\n\nT"]
    assert column(spark, ["a\nb"], tx.embed_text(F.col("x"), F.lit("fn"), F.lit("n"))) == [
        "fn n: a b"]


def test_hmac_equals_the_library_for_short_and_long_keys(spark):
    import hashlib
    import hmac
    for key in ("", "k", "x" * 64, "x" * 65, "schlüssel"):
        bodies = ["", "héllo", "b" * 300]
        want = [hmac.new(key.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]
        assert column(spark, bodies, hmac_sha256(key, F.col("x"))) == want
