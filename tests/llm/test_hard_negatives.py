"""Hard negatives against a plain loop, and the packed keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewframe.llm import hard_negatives as hn

SF = "/root/testdata/sf0.01"


def brute(rows, every=100, k=5, m=5, share=80):
    """Rows of the result over (id, vector, label) that take part."""
    held = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows
            if None not in (i, v, y) and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    out, done = [], set()
    for i, q, y in sorted(held, key=lambda r: (r[0], r[2])):
        if i % every or i in done:
            continue
        done.add(i)
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, z) for j, v, z in held if j != i)
        positives = [(j, -s) for s, j, z in scored if z == y][:k]
        for p, ps in positives:
            good = [(j, -s) for s, j, z in scored if z != y and share * ps <= -100 * s <= 100 * ps][:m]
            out += [(i, p, r + 1, j, ps, s) for r, (j, s) in enumerate(good)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, hn.mine(df, "vec_id", "embedding", "label", F.col("id") % 100 == 0, **more).collect()))


def test_keys_sort_and_open():
    rng = random.Random(1)
    edge = [-(1 << 63), (1 << 63) - 1, 0, 1, -1]
    rows = [(rng.choice(edge), rng.choice(edge), rng.random() < 0.5, rng.choice(edge)) for _ in range(300)]
    assert [hn.opened(hn.key(*r)) for r in rows] == rows
    assert sorted(rows, key=lambda r: hn.key(*r)) == sorted(rows, key=lambda r: (r[0], -r[1], not r[2], r[3]))


@pytest.mark.parametrize("score", [-101, -100, -1, 0, 1, 4, 5, 99, 100, 101])
def test_lower_end(score):
    n = hn.lower_end(score, 80)
    assert 80 * score <= 100 * n and not 80 * score <= 100 * (n - 1)


def test_the_pass_holds_open_windows_alone():
    def endless():
        yield hn.key(1, 10 ** 6, True, 5), None
        for i in range(200_000):
            yield hn.key(1, 10 ** 6 - 1, False, i), None
        yield hn.key(2, 50, True, 6), None
        yield hn.key(2, 50, False, 7), None
        yield hn.key(2, 39, False, 8), None
    assert list(hn.windows(endless(), 3, 80)) == [(1, 5, 1, 0, 10 ** 6, 10 ** 6 - 1), (1, 5, 2, 1, 10 ** 6, 10 ** 6 - 1),
                                                  (1, 5, 3, 2, 10 ** 6, 10 ** 6 - 1), (2, 6, 1, 7, 50, 50)]


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_against_a_plain_loop(spark, scale):
    rng = np.random.default_rng(8)
    rows = [(i, (scale * rng.normal(0.5, 1, 5).round(1)).tolist(), int(rng.integers(0, 3))) for i in range(0, 900, 4)]
    rows += [(i, [scale * x for x in (1.0, 0.5, 0.0, 0.0, 2.0)], i % 2) for i in range(1000, 1120)]  # a hot vector
    rows += [(2000, [scale, -scale], 9), (2100, None, 1), (2200, [None], 1), (2300, [float("nan")], 1), (2400, [1.0], None),
             (None, [1.0], 1), (2500, [], 1), (2600, [-scale, 0.0], 2), (2604, [-scale, 0.0], 1), (2700, [0.0, scale], 1),
             (2700, [0.0, scale], 1), (2704, [0.0, scale], 1), (2704, [0.0, scale], 1)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows],
                               "vec_id long, embedding array<double>, label int, score int, block string")
    expected = brute(rows)
    assert expected and mined(df) == expected


def test_registered_rows(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in df.collect()]
    from reviewframe.llm.queries import op12_hard_negatives
    assert sorted(map(tuple, op12_hard_negatives(spark, SF).collect())) == brute(rows)


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")) == []
