"""The corpus pipeline as a whole against brute force."""

import random

import numpy as np
import public_tokenizers
from test_neighbours import brute_components, brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline


def fixture_docs():
    """(doc_id, text) of plain, toxic, copied, letterless and empty documents, and which are toxic."""
    rng = random.Random(11)
    plain = sorted({"".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)})
    docs = [(i, [rng.choice(plain) for _ in range(rng.randrange(100, 140))]) for i in range(300)]
    toxic = {i for i, _ in docs if i % 5 == 0}
    for i, words in docs:
        if i in toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zykwoxj", "hykqaxw", "jowhykz"]))
    clean = [(i, w) for i, w in docs if i not in toxic][:20]
    docs += [(1000 + i, w) for i, w in clean] + [(2000 + i, [*w[:30], rng.choice(plain), *w[31:]]) for i, w in clean]
    own = " ".join(rng.choice(plain) for _ in range(120))
    odd = [(3000, "12 34 !!"), (3001, None), (3002, ""), (None, own), (None, own)]
    return [*((i, " ".join(w)) for i, w in docs), *odd], toxic


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, toxic = fixture_docs()
    columns = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame([(i, t, "xx", "s", len(t or ""), "mine") for i, t in docs], columns).repartition(3) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    left = {i: t for i, t in docs if i is not None and i not in toxic and any(map(str.isalpha, t or ""))}
    prints = {i: brute_fingerprint(t, 3) for i, t in left.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = set(brute_components(left, near).values())
    assert len(expected) <= len(left) - 20  # copies go

    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(pieces) == expected | {None}
    encoder = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    encoder.no_truncation()
    encoder.no_padding()
    for i in expected:
        ids = np.frombuffer(b"".join(x for _, x in sorted(pieces[i])), dtype="<u4").tolist()
        assert ids == encoder.encode(left[i], add_special_tokens=False).ids + [2]


def odd_docs(spark):
    """Rows with nulls, ties, repeats and columns whose names the operators use."""
    ddl = ("doc_id long, text string, lang string, source string, n_chars long, count int, n int, score string, _score int, "
           "row int, _row int, lang_pred string, doc string, id long, key long, component_id int, fp long, `a.b` int")
    text = " ".join(f"word{i} of the text" for i in range(30))
    rows = [(1, text), (2, text), (2, text), (3, "other words " * 40), (3, "third thing " * 40), (4, None), (5, ""),
            (None, text), (None, None), (6, "long " * 20000), (7, "12 34")]
    return spark.createDataFrame([(i, t, "en" if t else None, None, 1, 2, 3, "s", 4, 5, 6, "p", "d", 7, 8, 9, 10, 11)
                                  for i, t in rows], ddl)


def left_by(found):
    return sorted(((r.doc_id, (r.text or "")[:9]) for r in found.collect()), key=repr)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    everything = left_by(docs)
    toxic = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert toxic.columns == docs.columns and set(left_by(toxic)) <= set(everything)
    assert left_by(toxic.where("text IS NULL OR text = ''")) == left_by(docs.where("text IS NULL OR text = ''"))
    language = corpus_pipeline.drop_unknown_language(spark, docs, str(tmp_path))
    assert language.columns == docs.columns
    assert left_by(language) == [x for x in everything if x[1] and not x[1].startswith("12")]
    near = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert left_by(near) == sorted([(1, "word0 of "), (3, "other wor"), (3, "third thi"), (4, ""), (6, "long long"),
                                    (7, "12 34"), (None, ""), (None, "word0 of ")], key=repr)
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 8
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
