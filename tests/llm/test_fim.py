"""Fill-in-the-middle against slicing text by text."""

import hashlib
import random
import re

import pytest

from reviewframe.llm import fim

MARKS = ("<P>", "<S>", "<M>")


def brute(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fixture_texts():
    rng = random.Random(3)
    words = ["a", "bé", "日本", "𝒳y", "<", ">", "P>", "<S", "\n", "\n\n", "\r\n", " ", " ", "\x0b", "\x85"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["", None, "\n", "\n\n\n", "no line end", "x\n", "has <P> in it", "<S>", "a\n<M>\nb", "<P", "S>", "é" * 3000]
    return texts


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (40, 0), (100, 100)])
def test_examples_and_their_texts(spark, make_docs, monkeypatch, rate, spm_rate):
    given = list(enumerate(fixture_texts())) + [(None, "one\ntwo\n"), (5, "again\nfive\n"), (5, "again\nfive\n")]
    found = fim.restore(fim.transform(make_docs(given).repartition(3), rate=rate, spm_rate=spm_rate)).collect()
    expected = [brute(i, t, rate=rate, spm_rate=spm_rate) for i, t in given]
    assert sorted(map(repr, (tuple(r)[:6] for r in found))) == sorted(map(repr, expected))
    assert sorted(r.restored for r in found) == sorted(t or "" for _, t in given)
    forms = {r.form for r in found}
    assert "plain" in forms and len(forms) == (3 if 0 < spm_rate < 100 else 2)


def test_blocks_and_groups_of_any_size(spark, make_docs, monkeypatch):
    monkeypatch.setattr(fim, "GROUP", 700)
    monkeypatch.setattr(fim, "BLOCK", 13)
    import numpy as np
    import pyarrow as pa
    texts = [t or "" for t in fixture_texts()] + ["long line of words\n" * 400]
    data, at = fim._buffer(pa.array(["skipped", *texts]).slice(1))
    assert bytes(data) == "".join(texts).encode()
    assert [s.stop - s.start for s in fim._groups(at)][-1] == 1
    rng = np.random.default_rng(1)
    cuts, spm = rng.integers(0, 1 << 32, (len(texts), 2)), rng.random(len(texts)) < 0.5
    out, to, lines, moved, _, _ = fim.scatter(data, at, cuts, np.ones(len(texts), bool), spm)
    assert lines.tolist() == [len(re.findall(r"[^\n]*\n|[^\n]+", t)) for t in texts]
    back, places = fim.gather(out, to, moved, spm)
    assert bytes(back) == bytes(data) and (places == at).all()


def test_broken_output_is_refused():
    import numpy as np
    data = np.frombuffer(b"<P>a<S>b", dtype=np.uint8)
    with pytest.raises(ValueError):
        fim.gather(data, np.array([0, len(data)]), np.array([True]), np.array([False]))


def test_clashing_columns_and_empty_table(spark):
    ddl = "doc_id long, text string, n long, form string, output string, id long, t string, key string, a long, chosen int"
    df = spark.createDataFrame([(1, "x\ny\n", 9, "odd", "odd", 4, "t", "k", 1, 2)], ddl)
    assert [tuple(r) for r in fim.transform(df).collect()] == [brute(1, "x\ny\n")]
    assert fim.restore(fim.transform(df.limit(0))).collect() == []
