"""Packing and byte-pair encoding against the tokenizers library."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewframe.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "1", "23", "!", "<|endoftext|>", "<|startoftext|>",
          " ", "́", "中", "🙂", "'ll", "\x1c", "\x00", "İ", "Σ", "<|", "E", "nothing", " "]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def ids(blob):
    return np.frombuffer(blob, dtype="<u4").tolist()


def test_bpe_equals_library():
    v, t = bpe.vocabulary(BYTE), Tokenizer.from_file(BYTE)
    given_ = texts() + ["x" * 5000, "ab" * 900, ""]
    expected = [t.encode(x, add_special_tokens=False).ids for x in given_]
    got = v.encode_many(given_)
    assert [ids(g) for g in got] == expected
    assert [v.decode(g) for g in got] == [t.decode(e, skip_special_tokens=False) for e in expected]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_bpe_round_trip(given_):
    v, t = bpe.vocabulary(BYTE), Tokenizer.from_file(BYTE)
    got = v.encode_many(given_)
    assert [v.decode(g) for g in got] == given_
    assert [ids(g) for g in got] == [t.encode(x, add_special_tokens=False).ids for x in given_]


def test_single_tree_equals_trees_in_arrays():
    v = bpe.vocabulary(BYTE)
    words = [w.encode() for w in {p for x in texts() for p in v.pattern.findall(x)}]
    assert [ids(m) for m in v.merge_many(words)] == [v.merge([v.single[b] for b in w]) for w in words]


def test_bpe_frames(make_docs):
    docs = make_docs([(1, "the the"), (1, "the the"), (2, None), (3, ""), (None, "x <|endoftext|>")],
                     "doc_id long, text string, ids string, decoded int")
    rows = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == [(0, "x <|endoftext|>"), (1, "the the"),
                                                              (1, "the the"), (2, ""), (3, "")]
    assert bpe.decode(bpe.encode(docs.limit(0), BYTE), BYTE).count() == 0


def test_word_ids_equal_library():
    words, t = packing.WordIds(WORD), Tokenizer.from_file(WORD)
    given_ = texts()
    assert [ids(x) for x in words.many([x.encode() for x in given_])] == \
        [t.encode(x, add_special_tokens=False).ids for x in given_]


def check_packed(rows, docs, max_tokens, max_segments, max_loss):
    t = Tokenizer.from_file(WORD)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in docs:
        own = sorted(by_doc[doc], key=lambda r: r.start)
        expected = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert [i for r in own for i in ids(r.ids)] == expected
        assert all(r.doc_tokens == len(expected) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        total = 0
        for r in own:
            assert r.offset == total and r.length == len(r.ids) // 4 > 0
            total += r.length
        assert total == max_tokens or total & (total - 1) == 0
        assert total <= max_tokens and len(own) <= max_segments and sum(r.loss_tokens for r in own) <= max_loss


def test_packing_frames(make_docs):
    docs = [(i, "word " * (i * 37 % 90)) for i in range(60)] + [(100, None), (101, ""), (102, "long text " * 2000)]
    frame = make_docs(docs)
    for limits in ((4096, 512, 4096), (64, 3, 64), (128, 100, 50)):
        rows = packing.pack(frame, WORD, 2, *limits).collect()
        check_packed(rows, docs, *limits)
    assert packing.pack(frame.limit(0), WORD).count() == 0


def test_packing_prompts_bear_no_loss(make_docs):
    docs = make_docs([(1, "a b c d", 3), (2, "e f", None)], "doc_id long, text string, prompt int")
    rows = packing.pack(docs, WORD, context_tokens="prompt").collect()
    assert sum(r.loss_tokens for r in rows if r.doc_id == 1) == 2
    assert sum(r.loss_tokens for r in rows if r.doc_id == 2) == 2


def test_dot_product_prefers_what_is_plentiful():
    pool = packing.Pool((100, 10, 100))
    pool.add((0, b"", 50), 0, 50)   # context only
    pool.add((1, b"", 0), 0, 50)    # loss throughout
    assert pool.items[pool.choose(np.array([100.0, 10, 60]))][0][0] == 1
    assert pool.items[pool.choose(np.array([100.0, 10, 40]))][0][0] == 0


def test_digest_of_ids_is_stable(make_docs):
    blob = bpe.encode(make_docs([(1, "the cat")]), BYTE).first().ids
    assert hashlib.sha256(blob).hexdigest() == hashlib.sha256(np.array(
        Tokenizer.from_file(BYTE).encode("the cat", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
