"""Language, toxicity and language-model operators against brute force and held-out rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewframe.llm import langid, lm, toxicity


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter()
    for w in words:
        grams.update(("1", c) for c in w)
    padded = " " + " ".join(words) + " " if words else ""
    for n in (2, 3):
        grams.update((str(n), padded[i:i + n]) for i in range(len(padded) - n + 1) if padded[i:i + n].strip()
                     and (n == 2 or padded[i + 1] != " "))
    return grams


@pytest.mark.parametrize("text", ["The cat, the hat!", "ß", "a b  c", "", "12 ..", "naïve Öl über alles"])
def test_ngram_counts(text):
    assert sorted(langid.ngram_counts(text)[1].tolist()) == sorted(brute_grams(text).values())


def test_top_breaks_ties_by_code():
    codes, counts = np.arange(100), np.array([1] * 90 + [5] * 10)
    assert langid.top(codes, counts, 12).tolist() == [*range(90, 100), 0, 1]


def test_out_of_place_distance():
    profile = np.array([7, 3, 9])
    order = np.argsort(profile)
    assert langid.distances(np.array([3, 7, 4]), [(profile[order], order)], 3) == [1 + 1 + 3]


def test_language(spark, make_docs):
    rng = random.Random(1)
    words = {"xx": ["tak", "nie", "jest", "byl"], "yy": ["uma", "com", "isso", "ele"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i, x in enumerate(["xx", "yy"] * 20)]
    odd = [(100, None, "xx"), (101, "", "yy"), (102, "12 !?", "xx"), (103, "tak nie jest", None), (103, "tak nie jest", None),
           (104, "uma " * 30000, None)]
    docs = make_docs(rows + odd)
    found = langid.predict(docs, langid.train(docs))
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred) for r in found.collect()]
    assert dict(got) == {**{i: x for i, _, x in rows}, 100: "und", 101: "und", 102: "und", 103: "xx", 104: "yy"}
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 for r in found.collect())
    nothing = docs.where("lang IS NULL")
    assert {r.lang_pred for r in langid.predict(nothing, langid.train(nothing)).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.train(docs)).count() == 0


def brute_phi(word):
    out = Counter()
    cls = [ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 20 for c in word]
    for i in range(len(cls)):
        for j in range(i + 1, len(cls)):
            for k in range(j + 1, len(cls)):
                if k - i <= toxicity._REACH:
                    out[cls[i], cls[j], cls[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def test_subsequence_features():
    words = ["banana", "idxiot", "é", "ab", "größe"]
    rows, triples, value, owner = toxicity.features(words)
    n = toxicity._LETTERS
    for i, w in enumerate(words):
        got = {(t // n // n, t // n % n, t % n): v for r, t, v in zip(rows, triples, value) if r == i}
        assert got == pytest.approx(brute_phi(w))
    assert owner.tolist() == list(range(len(words)))


def test_nystrom_collapses_exactly():
    words = toxicity._Landmarks(["idiot", "stupid", "table"])
    share = np.array([0.5, -1.0, 2.0])
    model = toxicity.Model(words.weights(share), 0.25, 1.0, 0.0)
    given = ["idixot", "tabel", "zzzz", "stupid"]
    assert model.values(given) == pytest.approx(words.gram(given) @ share + 0.25)


def toxic_rows(n=400, seed=2):
    rng = random.Random(seed)
    plain = ["river", "window", "yellow", "paper", "garden", "silver", "morning", "engine"]
    bad = ["blorgo", "snarkel", "wuffit"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 40))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_tolerates_gaps(spark, make_docs):
    rows, labels = toxic_rows()
    odd = [(900, "garden bl-org0 paper"), (901, "river s n a r k e l window"), (902, "yellow wuf.fit"), (903, "snarxkel"),
           (950, None), (951, ""), (952, "river paper"), (952, "river paper"), (953, "garden " * 40000), (None, "silver")]
    docs = make_docs(rows + odd, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = [(r[0], r[2]) for r in toxicity.score(docs.select("doc_id", "text"), model).collect()]
    assert len(got) == len(rows) + len(odd)
    score = dict(got)
    assert all((score[i] >= 0.5) == bool(y) for i, y in labels)
    assert all(score[i] >= 0.5 for i in (900, 901, 902, 903))
    assert all(score[i] < 0.5 for i in (950, 951, 952, 953, None))
    assert toxicity.train(docs, marks.where("toxic = 0")) is None
    assert toxicity.score(docs.select("doc_id", "text").limit(0), model).count() == 0


def test_toxicity_on_random_samples(spark):
    """Three fits on four fifths of the labelled texts each, judged on all of them."""
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked = docs.join(labels.select("doc_id", "toxic").where("toxic IS NOT NULL"), "doc_id").cache()
    for seed in range(3):
        most = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(5)) > 0
        model = toxicity.train(docs, labels, learn_from=most)
        found = {(r.toxic, r.flag): r["count"] for r in toxicity.score(marked, model).groupBy(
            "toxic", (F.col("score") >= 0.5).alias("flag")).count().collect()}
        assert found[1, True] >= 0.85 * (found[1, True] + found.get((1, False), 0)), (seed, found)
        assert found[0, False] >= 0.96 * (found[0, False] + found.get((0, True), 0)), (seed, found)


def test_language_columns_and_many_languages(spark):
    rows = [(i, "".join(chr(0xac00 + 18 * (i % 600) + k) for k in range(18)), f"l{i % 600}", 1, 2, "x") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, count int, texts int, score string")
    found = langid.predict(docs, langid.train(docs))
    assert found.columns == ["doc_id", "text", "lang", "count", "texts", "lang_pred", "score"]
    assert found.where("lang <> lang_pred").count() == 0


def test_language_model(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(lm, "SHORTLIST", 6)
    monkeypatch.setattr(lm, "END", 6 + lm.BUCKETS)
    monkeypatch.setattr(lm, "SYMBOLS", 7 + lm.BUCKETS)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "dog", "sat", "on", "mat%d" % rng.randrange(9)])
                         for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "a\xa0b new\x0bwords here"), (72, "a\xa0b new\x0bwords here"), (73, "the " * 9000),
             (None, "cat")]
    docs = make_docs(rows)
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0
    model = lm.train(docs, learn, known_words=8)
    got = lm.score(docs, model, held_out=~learn).collect()
    assert len(got) == len(rows)
    tokens = {i: [*((t or "").encode().lower().split()), None] for i, t in rows}
    counts = Counter(x for i, t in rows if (i or 0) % 3 for x in tokens[i])
    n, v = sum(counts.values()), len(counts)
    log_p = lm.log_probabilities(*(p.astype(float) for p in model.parameters))
    assert np.allclose((10 ** log_p).sum(axis=1), 1)
    short = [w for w, _ in sorted(((w, c) for w, c in counts.items() if w), key=lambda x: (-x[1], x[0]))[:6]]
    mass = Counter({b: 1 for b in range(lm.BUCKETS)})
    for w, c in counts.items():
        if w is not None and w not in short:
            mass[lm.bucket_of(w)] += c + 1
    for r in got:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        last, expected = lm.END, 0.0
        for w in own:
            s = lm.END if w is None else short.index(w) if w in short else lm.SHORTLIST + lm.bucket_of(w)
            expected += log_p[last, s]
            if lm.SHORTLIST <= s < lm.END:
                expected += math.log10((counts[w] + 1) / mass[lm.bucket_of(w)])
            last = s
        assert r.score == pytest.approx(expected, rel=1e-6)
    empty = lm.train(docs.limit(0))
    assert [r.base_score for r in lm.score(docs.where("doc_id = 71"), empty, F.lit(True)).collect()] == [0.0]
    assert lm.score(docs.limit(0), model, F.lit(False)).count() == 0


def test_most_frequent_words(spark):
    counts = spark.createDataFrame([(w.encode(), n) for w, n in (
        ("a", 9), ("c", 5), ("b", 5), ("d", 1), ("e", 1), ("f", 1))], "word binary, n long")
    assert lm.most_frequent(counts, 6) == ([b"a", b"b", b"c", b"d", b"e", b"f"], [9, 5, 5, 1, 1, 1])
    assert lm.most_frequent(counts, 5) == ([b"a", b"b", b"c"], [9, 5, 5])
    assert lm.most_frequent(counts, 2) == ([b"a"], [9])
    assert lm.most_frequent(counts.where("n < 5"), 2) == lm.most_frequent(counts.limit(0), 2) == ([], [])


def test_noise_contrastive_estimation_learns_pairs():
    rng = np.random.default_rng(0)
    true = rng.dirichlet(np.full(12, 0.3), size=12)
    table = np.round(true * 20000)
    log_p = lm.log_probabilities(*lm.train_pairs(table, dimension=12, steps=600))
    assert np.abs(10 ** log_p - true).max() < 0.05
