"""Components, SimHash classes and metric trees against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from reviewframe.llm import golay, mtree, simhash
from reviewframe.llm.components import connected_components


def brute_components(nodes, linked):
    part = {n: n for n in nodes}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] \
        + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    proper = [(a, b) for a, b in edges if a is not None and a != b]
    expected = brute_components({n for e in proper for n in e}, proper)
    assert got == expected
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_golay_code_is_perfect():
    table = golay.decode_table()
    assert np.bincount(table.astype(np.int64) & 0xFFF, minlength=4096).tolist() == [2048] * 4096


def test_keys_miss_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(-2 ** 62, 2 ** 62, 300)
    for bits in (2, 5):
        other = base.copy()
        for _ in range(bits):
            other ^= np.int64(1) << rng.integers(0, 63, 300)
        keys = []
        for values in (base, other):
            rows, found = simhash.fuzzy_keys(values, bits)
            keys.append([set(found[rows == i]) for i in range(300)])
        assert all(a & b for a, b in zip(*keys))


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def fixture_texts():
    rng = random.Random(9)
    words = ["w%d" % i for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 300))) for _ in range(60)]
    near = [" ".join("new" if i == k * 7 else w for i, w in enumerate(base[k % 5].split())) for k in range(60)]
    long_ = "many words " * 4000
    return [*enumerate([*base, *near, *base[:10], "", "  ", None, "one", "one two", long_, long_])]


def test_classes(make_docs, monkeypatch):
    docs = fixture_texts()
    prints = {i: brute_fingerprint(t) for i, t in docs}
    expected = brute_components(prints, [(a, b) for a in prints for b in prints if a < b and
                                         (prints[a] ^ prints[b]).bit_count() <= 2])
    got = simhash.near_duplicates(make_docs(docs + [(None, "no id")])).collect()
    assert {r.doc_id: r.fp & 2 ** 64 - 1 for r in got if r.doc_id is not None} == prints
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_large_buckets_and_tiles_link_alike(spark, monkeypatch):
    rng = random.Random(2)
    centre = rng.getrandbits(62)
    values = sorted({centre ^ sum(1 << rng.randrange(62) for _ in range(rng.randrange(4))) for _ in range(500)})
    nodes = spark.createDataFrame([(i, v, 0) for i, v in enumerate(values)], "node long, fp long, sketch long")
    expected = brute_components(range(len(values)), [(a, b) for a in range(len(values)) for b in range(a) if (
        values[a] ^ values[b]).bit_count() <= 2])
    monkeypatch.setattr(simhash, "TILE", 40)
    links = [(r.a, r.b) for r in simhash.link_fingerprints(nodes, 2).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in links if abs(a - b) == 0) and links
    assert brute_components(range(len(values)), links) == expected


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(120)]                       # one very common vector
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (None, rows[1][1]),
             (904, []), (905, [1.0]), (950, rows[3][1]), (950, rows[3][1])]
    rows += [(77, rows[2][1])] * 150                                          # one row, many times over
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(mtree, "TREE", 64)
    monkeypatch.setattr(mtree, "QUERIES", 3)
    got = {}
    for r in mtree.top_k(mtree.whole_vectors(frame, "vec_id", "embedding"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    sound = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None
             and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in dict(sound).items():
        if q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert set(got) == {q for q, _ in sound if q % 50 == 0}
    empty = mtree.whole_vectors(frame.where("vec_id = 900"), "vec_id", "embedding")
    assert mtree.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
