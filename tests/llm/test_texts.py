"""URL verdicts, chat formatting and Merkle fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewframe.llm import chat, merkle, urls
from reviewframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"))


def test_rules_and_aliases(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://a.example.com/en/x", None), (2, "http://www.Example.com/en/x?q", ""), (3, "https://b.net/es/1", "<p>"),
        (4, "https://c.org/copy", link.format("https://b.net/es/1#top")),       # alias of a blocked page
        (5, "https://d.org/first", '<meta http-equiv="refresh" content="0; url=https://c.org/copy/">'),
        (6, "https://www.example.com/en/y", link.format("http://b.net/es/1")),  # its allow rule holds
        (7, "https://d.org/first/index.html", None), (8, "no url", None), (9, None, None), (10, "://", None),
        (11, "https://e.org/p", link.format("/other")), (12, "https://example.com", None), (13, "http://xcom/", None),
        (3, "https://b.net/es/1", "<p>"), (14, "https://f.org/given", None), (None, "https://g.net/es", None),
        (15, "https://h.org/" + "x" * 100_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS rule")
    more = spark.createDataFrame([("https://f.org/given", "http://b.net/es/1"), (None, "http://b.net/es/1")],
                                 "source string, target string")
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in urls.judge(pages, RULES, more).collect()]
    assert len(got) == len(rows)
    verdict = {g[0]: g[1:] for g in got}
    assert verdict[1] == ("a.example.com", "example.com/en/", "block")
    assert verdict[2] == ("www.example.com", "www.example.com/en/", "allow")
    assert verdict[3][1:] == ("net/es/", "block") and verdict[6][2] == "allow"
    assert [verdict[i][1:] for i in (4, 5, 7, 14)] == [(None, "block")] * 4
    assert [verdict[i][1:] for i in (8, 9, 10, 11, 12, 13, 15)] == [(None, "allow")] * 7
    assert verdict[8][0] == verdict[9][0] == ""
    assert verdict[None][1:] == (None, "allow")
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_every_link_of_a_page_is_an_edge(spark):
    """Verdicts written by hand; b.net/es/ is blocked by a rule, nothing else is."""
    to = "https://b.net/es/1"
    canonical = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "https://b.net/es/1", None, "block"),
        (2, "https://c.org/both", canonical("https://c.org/main") + f'<meta http-equiv=refresh content="0; url={to}">', "block"),
        (3, "https://c.org/main", None, "block"),                                 # by its canonical link with 2
        (4, "https://d.org/x/first", f'<meta content="0; url={to}" http-equiv="Refresh">', "block"),
        (5, "https://d.org/x/quoted", f"""<meta http-equiv="refresh" content="3;URL='{to}'">""", "block"),
        (6, "https://d.org/x/one", canonical("first"), "block"),                  # relative to the page
        (7, "https://d.org/x/y/two", canonical("../first#top"), "block"),
        (8, "https://d.org/x/first?p=1", canonical("?p=2"), "allow"),             # other queries, other pages
        (9, "https://d.org/x/first?p=3", canonical("?"), "block"),                # an empty query is none
        (10, "https://e.org/view?id=1", canonical(to), "block"),
        (11, "https://e.org/view?id=2", None, "allow"), (12, "https://e.org/view", None, "allow"),
        (13, "https://f.org/based", '<base href="https://d.org/x/">' + canonical("./first"), "block"),
        (14, "https://f.org/mail", canonical("mailto:x@b.net") + canonical("#top") + "<link rel=canonical>", "allow"),
        (15, "https://f.org/style", f'<link rel="stylesheet" href="{to}">', "allow"),
        (16, "https://f.org/plain", f'<meta http-equiv="refresh" content="0;{to}">', "block"),
        (17, "https://f.org/again", '<meta http-equiv="refresh" content="30">', "allow"),
        (18, "https://f.org/odd", f"""<link title="a > b" rel='alternate Canonical' href={to}>""", "block"),
        (19, "https://e.org/list?a=1&b=2", None, "block"),
        (20, "https://f.org/amp", canonical(to) + canonical("https://e.org/list?a=1&amp;b=2"), "block"),
        (21, "https://f.org/long", "<link " + '""' * 50_000 + ">" + canonical(to), "block")]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, (("b.net", "/es/", "block"),)).collect()}
    assert got == {r[0]: r[3] for r in rows}


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "</s>\\n"]), st.lists(
    st.sampled_from([*"\\<>/s[]INTn \n", "</s>", "[/INST]", "<s>"]), max_size=12).map("".join)), max_size=6))
def test_template_is_reversible(turns):
    assert chat.parse("".join(chat.render(r, t) for r, t in turns)) == turns


def test_expansion(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "and"), (1, 3, "assistant", ""),
            (2, 0, "system", "only"), (3, 0, "assistant", "</s> é"), (3, 1, "user", None), (4, None, None, "x"),
            (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (None, 0, "user", "lost")]
    rows += [(6, i, "assistant" if i % 2 else "user", "t%d " % i * 200) for i in range(120)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS example")
    examples = chat.expand(frame).collect()
    first = sorted((e for e in examples if e.conv_id == 1), key=lambda e: e.example)
    assert [e.formatted[e.loss_start:e.loss_end] for e in first] == ["yes", ""]
    assert chat.parse(first[1].formatted) == [("user", "hi"), ("assistant", "yes"), ("user", "and"), ("assistant", "")]
    got = {r.conv_id: r for r in chat.read_back(chat.expand(frame)).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.expand(frame.limit(0))).count() == 0


def brute_tree(text, hashes):
    """(root, leaves) with the hashes of tokens given; sections, paragraphs and leaves as nested lists."""
    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def cut(paragraph):
        tokens, out, held = tokens_of(paragraph), [], ""
        for i, t in enumerate(tokens):
            held += t
            if i + 1 == len(tokens) or hashes[t] <= hashes[tokens[i + 1]]:
                out.append(held)
                held = ""
        assert "".join(out) == paragraph
        return [digest(x) for x in out]

    sections = [[cut(p) for p in re.split(r"(?<=\n)", s) if p] for s in re.split(r"(?<=\n\n)(?!\n)", text) if s]
    root = digest("".join(digest("".join(digest("".join(p)) for p in s)) for s in sections))
    return root, Counter(leaf[:8] for s in sections for p in s for leaf in p)


def tokens_of(text):
    return regex.findall(r"(?V1)(?:[[\p{L}\p{N}]--\p{Lo}]{1,16}|\p{Lo})[^\p{L}\p{N}]{0,16}|[^\p{L}\p{N}]{1,16}", text)


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    return 2 * (a[1] & b[1]).total() / (a[1].total() + b[1].total())


def test_fingerprints(spark, make_docs):
    texts = ["One two three.\nFour five.\n\nSix.", "One two three.\nFour five.\n \nSix.", "", None, "a", "ab\n\n\n\nc",
             "One two three.\nFour five.\n\nSix.", "é🙂 end of it. " * 9, "long words of text. " * 5000,
             "x" * 20_000, "\u6f22\u5b57\u3068\u4eee\u540d\u306e\u6587\u7ae0" * 30]
    rows = [*enumerate(texts), (4, "twice"), (None, "no id")]
    frame = make_docs(rows, "doc_id long, text string, root int, phrases string")
    got = merkle.edit_report(frame).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] if r[0] is not None else -1, r[1]), reverse=True)
    check_report(spark, ordered, got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].fingerprint == by_id[6].fingerprint != by_id[1].fingerprint
    assert by_id[2].fingerprint == by_id[3].fingerprint and by_id[3].near_edited == 1.0
    assert by_id[8].near_edited > by_id[8].near_next
    assert by_id[7].near_edited > 0.4 and by_id[9].near_edited > 0.4 and by_id[10].near_edited > 0.4
    assert merkle.edit_report(frame.limit(0)).count() == 0


def check_report(spark, ordered, got):
    """Every column of the report against trees built in plain Python; ``ordered``: (doc_id, text), descending."""
    cut = [len(t) // 3 for _, t in ordered]
    after = [ordered[(n + 1) % len(ordered)][1] for n in range(len(ordered))]
    new = [t[:len(t) - c] + a[:c] for (_, t), c, a in zip(ordered, cut, after)]
    words = spark.createDataFrame([(w,) for w in sorted({w for t in [*new, *after] for p in re.split(
        r"(?<=\n)", t) for w in tokens_of(p)})], "w string")
    hashes = {r.w: r.h for r in words.selectExpr("w", "xxhash64(w) AS h").collect()}
    expected = []
    for (i, t), changed, following in zip(ordered, new, after):
        own, edited, other = (brute_tree(x, hashes) for x in (t, changed, following))
        expected.append((-1 if i is None else i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own[0], edited[0],
                         round(brute_likeness(own, edited), 9), round(brute_likeness(own, other), 9)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint.split(":")[0],
                   r.edited_fingerprint.split(":")[0], round(r.near_edited, 9), round(r.near_next, 9))
                  for r in got) == sorted(expected)


def test_query_against_brute_force(spark):
    """The registered query over a whole table."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ordered = sorted(((r.doc_id, r.text or "") for r in rows), reverse=True)
    got = QUERIES["op10_merkle"](spark, SF).collect()
    check_report(spark, ordered, got)
    assert all(r.near_edited >= 0.3 for r in got if r.n_chars >= 60)


def test_likeness_counts_repeats_and_reads_fingerprints(spark, make_docs):
    """Repeated sections, paragraphs and leaves pair off as often as both trees hold them; what is printed is enough."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["aa ", "bb ", "cc.", "\n", "\n\n"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    pairs = make_docs([(i, a, texts[(i + 1) % 60]) for i, a in enumerate(texts)], "doc_id long, text string, other string")
    found = pairs.select("*", merkle.tree(F.col("text")).alias("a"), merkle.tree(F.col("other")).alias("b"))
    found = found.select("*", merkle.fingerprint(F.col("a")).alias("x"), merkle.fingerprint(F.col("b")).alias("y")).select(
        "text", "other", merkle.likeness(F.col("a"), F.col("b")).alias("whole"),
        merkle.likeness(merkle.parse(F.col("x")), merkle.parse(F.col("y"))).alias("printed")).collect()
    hashes = {r.w: r.h for r in spark.createDataFrame(
        [(w,) for w in {w for t in texts for p in re.split(r"(?<=\n)", t) for w in tokens_of(p)}], "w string").selectExpr(
        "w", "xxhash64(w) AS h").collect()}
    for r in found:
        wanted = brute_likeness(brute_tree(r.text, hashes), brute_tree(r.other, hashes))
        assert abs(r.whole - wanted) < 1e-9 and abs(r.printed - wanted) < 1e-9


def test_an_edited_text_keeps_the_nodes_of_whole_paragraphs(spark, make_docs):
    """Paragraphs that an edited text takes over are not read again, and the trees are those of the texts."""
    rng = random.Random(8)
    pieces = ["aa ", "bb ", "cc.", "d\x00e ", "日本 ", "\n", "\n", "\n\n", "\n\n\n", "\r\n"]
    texts = ["", "\n", "\n\n", "\na\n\n b", "x y z \x00"] + [
        "".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(60)]
    report = merkle.edit_report(make_docs(list(enumerate(texts))))
    plan = report._jdf.queryExecution().analyzed().toString()
    assert re.search(r"CASE WHEN .{0,80}= get\(own.{0,200}THEN get\(own_nodes", plan)
    got = {r.doc_id: r for r in report.collect()}
    after = [texts[i - 1] for i in range(len(texts))]
    new = [t[:len(t) - len(t) // 3] + a[:len(t) // 3] for t, a in zip(texts, after)]
    pairs = make_docs([(i, *x) for i, x in enumerate(zip(texts, new, after))], "doc_id long, text string, new string, after string")
    trees = pairs.select("doc_id", *(merkle.tree(F.col(c)).alias(c) for c in ("text", "new", "after")))
    wanted = trees.select("doc_id", merkle.fingerprint(F.col("new")).alias("new"), *(F.aggregate(
        merkle.differing(F.col("text"), F.col(c)), F.lit(0), lambda n, x: n + x["n"]).alias(f"left_{c}") for c in ("new", "after")),
        *((merkle.leaf_count(F.col("text")) + merkle.leaf_count(F.col(c))).alias(f"all_{c}") for c in ("new", "after"))).collect()
    for r in wanted:
        assert got[r.doc_id].edited_fingerprint == r.new
        for left, all_, value in ((r.left_new, r.all_new, got[r.doc_id].near_edited), (r.left_after, r.all_after, got[r.doc_id].near_next)):
            assert abs((1.0 if all_ == 0 else (all_ - left) / all_) - value) < 1e-12


def test_branches_locate_an_edit(make_docs):
    a, b = "p1\np2\n\nq1\nq2\n", "p1\np2\n\nq1\nchanged\n"
    nodes = merkle.nodes(make_docs([(1, a), (2, b)])).collect()
    sections = [{(r.section, r.section_digest) for r in nodes if r.doc_id == i} for i in (1, 2)]
    leaves = [{(r.section, r.paragraph, r.paragraph_digest) for r in nodes if r.doc_id == i} for i in (1, 2)]
    assert {s for s, _ in sections[0] ^ sections[1]} == {1}
    assert {(s, p) for s, p, _ in leaves[0] ^ leaves[1]} == {(1, 1)}
