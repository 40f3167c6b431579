"""The inverted multi-index against brute force."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewframe.llm import multi_index as mi

SF = "/root/testdata/sf0.1"


def brute(rows, every=50, k=5):
    """{query: [(score, id)]} over rows (id, vector) that take part."""
    held = [(i, np.array([float(x) for x in v])) for i, v in rows
            if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all()
            and any(v)]
    out = {}
    for i, q in sorted(held, key=lambda r: r[0]):
        if i % every == 0 and i not in out:
            d = max(len(v) for _, v in held)
            pad = [(j, np.pad(v, (0, d - len(v)))) for j, v in held if j != i]
            q = np.pad(q, (0, d - len(q)))
            scored = [(round(float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), 9), j) for j, v in pad]
            out[i] = heapq.nsmallest(k, scored, key=lambda s: (-s[0], s[1]))
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def search(df, **more):
    return mi.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, **more)


def test_walk_gives_all_pairs_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), np.round(rng.random(9), 1)
    pairs = list(mi.walk(a, b))
    assert sorted(pairs) == [(i, j) for i in range(7) for j in range(9)]
    sums = [a[i] + b[j] for i, j in pairs]
    assert all(x <= y + 1e-12 for x, y in zip(sums, sums[1:]))


def test_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(260)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 2.0]) for i in range(300, 420)]       # a hot vector, queries among them
    rows += [(450, [2.0, 1.0, 0.0, 0.0, 0.0, 4.0]), (451, [1.0, 0.5]), (500, None), (501, []), (502, [0.0] * 6),
             (503, [None, 1.0]), (504, [float("nan"), 1.0]), (505, [float("inf")]), (None, [1.0, 1.0]), (506, [1e300, 1e300])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows],
                               "vec_id long, embedding array<double>, cell int, shard int, score string")
    assert found(search(df)) == brute(rows[:-1] + [(506, [1.0, 1.0])])


def test_repeated_ids(spark):
    rows = [(50, [1.0, 0.0])] * 4 + [(7, [1.0, 0.0])] * 3 + [(8, [1.0, 0.1]), (9, [0.0, 1.0]), (50, [1.5, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in search(df).orderBy("rank").collect()] == [(7, 1), (7, 2), (7, 3), (8, 4), (9, 5)]


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_find(spark, rows):
    assert search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_recall_on_a_table(spark, monkeypatch):
    monkeypatch.setattr(mi, "LEAST", 0)  # the share alone, as on large tables
    monkeypatch.setattr(mi, "SHARD", 300)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    expected = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = found(search(df))
    assert got.keys() == expected.keys()
    hits = sum(len(set(got[q]) & set(expected[q])) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
