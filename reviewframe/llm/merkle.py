"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves, in DataFrame functions only.

A text is cut, without losing a character, into sections (after blank lines), paragraphs (after line
ends) and leaves. For the leaves a paragraph is read as short tokens (up to 16 cased letters and digits, or
one letter of a script without case, and the signs that follow), and cut after every token whose hash isn't
above the next one's: about two tokens a leaf, whatever the script. The cuts depend on the text around them
alone, so an edit moves no cut elsewhere, and repeated or periodic text is cut in every period.

A leaf's digest covers its text, a paragraph's its leaves' digests, a section's its paragraphs', the root its
sections': equal roots mean equal texts. A fingerprint is a string that carries the tree: the root, a colon, and
the sections joined by ``/``; a section is its digest, ``=`` and its paragraphs joined by ``,``; a paragraph is its
digest, ``-`` and its leaves (inner digests have sixteen digits there, leaves eight). ``parse`` reads it back.

Likeness descends from the root: branches with equal digests are set against each other, as often as both trees
hold them, and only what differs is opened, down to the leaves. It is the share of leaves that are common.

Null and empty texts are the empty tree, whose root is the digest of nothing. Repeated rows each give a row;
columns beside ``doc_id`` and ``text`` are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared

PARAGRAPH = r"(?<=\n)"
TOKEN = r"(?:[\p{L}\p{N}&&[^\p{Lo}]]{1,16}|\p{Lo})[^\p{L}\p{N}]{0,16}|[^\p{L}\p{N}]{1,16}"
#: Digits of a digest in a fingerprint string: sections and paragraphs, leaves.
INNER, LEAF = 16, 8
#: Ends a leaf while a paragraph is cut; paragraphs that hold it are cut by places instead.
MARK = "\x00"


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once in the row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _positions(array: Column, chosen: Callable[[Column, Column], Column]) -> Column:
    """Places (from 0) of the elements for which ``chosen`` (element, place) holds, in order."""
    return F.filter(F.transform(array, lambda x, i: F.when(chosen(x, i), i)), lambda i: i.isNotNull())


def leaves(paragraph: Column) -> Column:
    """The leaves of a paragraph, in order; joined they are the paragraph."""
    def marked(tokens: Column, hashes: Column) -> Column:
        return F.split(F.array_join(F.transform(tokens, lambda t, i: F.when(
            F.get(hashes, i) <= F.get(hashes, i + 1), F.concat(t, F.lit(MARK))).otherwise(t)), ""), MARK)

    def placed(tokens: Column, hashes: Column) -> Column:
        ends = _positions(hashes, lambda h, i: F.coalesce(h <= F.get(hashes, i + 1), F.lit(True)))
        return _with(ends, lambda e: F.transform(e, lambda end, j: _with(
            F.coalesce(F.get(e, j - 1), F.lit(-1)),
            lambda before: F.array_join(F.slice(tokens, before + 2, end - before), ""))))

    def cut(tokens: Column) -> Column:
        return _with(F.transform(tokens, lambda t: F.xxhash64(t)), lambda hashes: F.when(
            F.contains(paragraph, F.lit(MARK)), placed(tokens, hashes)).otherwise(marked(tokens, hashes)))

    return _with(F.regexp_extract_all(paragraph, F.lit(TOKEN), F.lit(0)), cut)


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _paragraph(part: Column) -> Column:
    """(digest, leaves) of a paragraph's text."""
    return _with(F.transform(leaves(part), lambda x: F.sha2(x, 256)), lambda digests: F.struct(
        _digest(digests).alias("digest"), F.transform(digests, lambda d: F.left(d, F.lit(LEAF))).alias("leaves")))


def _assembled(lines: Column, nodes: Column) -> Column:
    """The tree over a text's paragraphs (``lines``) whose nodes are known: a section ends with its blank lines."""
    starts = _positions(lines, lambda x, i: (i == 0) | ((i > 1) & (F.get(lines, i - 1) == "\n") & (x != "\n")))
    sections = _with(starts, lambda at: F.transform(at, lambda p, j: _with(
        F.slice(nodes, p + 1, F.coalesce(F.get(at, j + 1), F.size(nodes)) - p), lambda found: F.struct(
            _digest(found["digest"]).alias("digest"), found.alias("paragraphs")))))
    return _with(sections, lambda found: F.struct(_digest(found["digest"]).alias("root"), found.alias("sections")))


def tree(text: Column) -> Column:
    """(root, sections: array of (digest, paragraphs: array of (digest, leaves: array of digests)))."""
    return _with(_parts(text, PARAGRAPH), lambda lines: _with(
        F.transform(lines, _paragraph), lambda nodes: _assembled(lines, nodes)))


def fingerprint(node: Column) -> Column:
    """A tree as a string."""
    def paragraph(p: Column) -> Column:
        return F.concat(F.left(p["digest"], F.lit(INNER)), F.lit("-"), F.array_join(p["leaves"], ""))

    def section(s: Column) -> Column:
        return F.concat(F.left(s["digest"], F.lit(INNER)), F.lit("="),
                        F.array_join(F.transform(s["paragraphs"], paragraph), ","))

    return F.concat(node["root"], F.lit(":"), F.array_join(F.transform(node["sections"], section), "/"))


def parse(value: Column) -> Column:
    """The tree that a fingerprint string carries, digests as long as they are there."""
    def paragraph(p: Column) -> Column:
        return F.struct(F.substring_index(p, "-", 1).alias("digest"), F.regexp_extract_all(
            F.substring_index(p, "-", -1), F.lit("[0-9a-f]{%d}" % LEAF), F.lit(0)).alias("leaves"))

    def section(s: Column) -> Column:
        return F.struct(F.substring_index(s, "=", 1).alias("digest"), F.transform(
            F.split(F.substring_index(s, "=", -1), ","), paragraph).alias("paragraphs"))

    return F.struct(F.substring_index(value, ":", 1).alias("root"), F.transform(
        F.filter(F.split(F.substring_index(value, ":", -1), "/"), lambda s: s != ""), section).alias("sections"))


def _counted(nodes: Column, side: int) -> Column:
    """(digest, side, n, below) of each distinct digest among nodes (digest, below)."""
    def runs(held: Column) -> Column:
        starts = _positions(held, lambda x, i: F.coalesce(x["digest"] != F.get(held, i - 1)["digest"], F.lit(True)))
        return _with(starts, lambda at: F.transform(at, lambda p, j: F.struct(
            F.get(held, p)["digest"].alias("digest"), F.lit(side).alias("side"),
            (F.coalesce(F.get(at, j + 1), F.size(held)) - p).alias("n"), F.get(held, p)["below"].alias("below"))))

    return _with(F.sort_array(nodes), runs)


def _unmatched(a: Column, b: Column) -> Column:
    """(digest, side, n, below) of nodes that one side holds ``n`` times more than the other."""
    def rest(all_: Column) -> Column:
        def more(x: Column, i: Column) -> Column:
            before, after = F.get(all_, i - 1), F.get(all_, i + 1)
            return F.when(before["digest"] == x["digest"], x["n"] - before["n"]).when(
                after["digest"] == x["digest"], x["n"] - after["n"]).otherwise(x["n"])

        return F.filter(F.transform(all_, lambda x, i: F.struct(
            x["digest"].alias("digest"), x["side"].alias("side"), more(x, i).alias("n"), x["below"].alias("below"))),
            lambda x: x["n"] > 0)

    return _with(F.sort_array(F.concat(_counted(a, 0), _counted(b, 1))), rest)


def _opened(rest: Column, side: int) -> Column:
    """What lies below the unmatched nodes of a side, as often as they are unmatched."""
    return F.flatten(F.transform(F.filter(rest, lambda x: x["side"] == side),
                                 lambda x: F.flatten(F.array_repeat(x["below"], x["n"]))))


def _nodes(found: Column, below: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["digest"].alias("digest"), x[below].alias("below")))


def _leaf_nodes(digests: Column) -> Column:
    return F.transform(digests, lambda d: F.struct(d.alias("digest"), F.lit(0).alias("below")))


def _open_leaves(a: Column, b: Column) -> Column:
    """(a, b): the leaves of two trees that lie below differing branches."""
    paragraphs = _unmatched(_nodes(a["sections"], "paragraphs"), _nodes(b["sections"], "paragraphs"))
    found = _with(paragraphs, lambda s: _unmatched(_nodes(_opened(s, 0), "leaves"), _nodes(_opened(s, 1), "leaves")))
    return _with(found, lambda p: F.struct(_opened(p, 0).alias("a"), _opened(p, 1).alias("b")))


def differing(a: Column, b: Column) -> Column:
    """(digest, side, n, below) of the leaves in which two trees differ, found below differing branches only."""
    return _with(_open_leaves(a, b), lambda o: _unmatched(_leaf_nodes(o["a"]), _leaf_nodes(o["b"])))


def _again(digests: Column) -> Column:
    """Every occurrence of a digest but one."""
    return _with(F.sort_array(digests), lambda held: F.filter(held, lambda x, i: x == F.get(held, i - 1)))


def _unpaired(a: Column, b: Column) -> Column:
    """How many digests of two arrays have no partner in the other, each counted as often as it is there.

    One occurrence of each distinct digest meets its partner by hash; only repeats are sorted out and counted.
    """
    more = F.aggregate(_unmatched(_leaf_nodes(_again(a)), _leaf_nodes(_again(b))), F.lit(0), lambda n, x: n + x["n"])
    return F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - 2 * F.size(F.array_intersect(a, b)) + more


def leaf_count(node: Column) -> Column:
    return F.aggregate(node["sections"], F.lit(0), lambda n, s: n + F.aggregate(
        s["paragraphs"], F.lit(0), lambda m, p: m + F.size(p["leaves"])))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else the share of the two trees' leaves that have a partner in the other tree."""
    left = _with(_open_leaves(a, b), lambda o: _unpaired(o["a"], o["b"]))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(_with(
        leaf_count(a) + leaf_count(b), lambda all_: (all_ - left) / all_))


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, root, section, section_digest, paragraph, paragraph_digest, leaves): a row for each paragraph."""
    found = docs.select("doc_id", tree(F.coalesce(F.col("text"), F.lit(""))).alias("tree"))
    rows = found.select("doc_id", F.col("tree.root").alias("root"), F.posexplode_outer("tree.sections").alias(
        "section", "node"))
    return rows.select("doc_id", "root", "section", F.col("node.digest").alias("section_digest"),
                       F.posexplode_outer("node.paragraphs").alias("paragraph", "part")).select(
        "doc_id", "root", "section", "section_digest", "paragraph", F.col("part.digest").alias("paragraph_digest"),
        F.col("part.leaves").alias("leaves"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text of the next row by descending doc_id (after the last: the first).

    Rows with one doc_id follow each other by descending text; null ids come last. The ids are cut into
    ranges at quantiles, two for each shuffle partition; the next row is found within a range, and for a
    range's last row among the ranges' first rows, of which there are as many as ranges.
    """
    n = 2 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]
    cuts = F.array(*[F.lit(int(c)) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    # Ranges are numbered by descending id; null ids make up the last one.
    place = F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(
        F.size(F.filter(cuts, lambda c: c >= F.col("doc_id"))))
    within = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    ahead = docs.withColumn("_range", place).withColumn("_next", F.lead("text").over(within))
    # First rows: their ids are found first, so that few texts travel.
    ids = docs.select("doc_id", place.alias("_range")).groupBy("_range").agg(F.max("doc_id").alias("_id"))
    heads = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("_range", "doc_id").agg(
        F.max("text").alias("text"))
    order = Window.orderBy("_range")
    following = ids.select("_range", F.lead("_range").over(order).alias("_to"),
                           F.first("_range").over(order).alias("_least"))
    firsts = heads.select(F.col("_range").alias("_to"), F.col("text").alias("_first"))
    link = following.select("_range", F.coalesce("_to", "_least").alias("_to")).join(firsts, "_to").drop("_to")
    return ahead.join(link, "_range", "left").select(
        "doc_id", "text", F.coalesce("_next", "_first").alias("next_text"))


def _cut(text: Column, share: int) -> Column:
    return F.floor(F.length(text) / share).cast("int")


def _put(text: Column, next_text: Column, share: int = 3) -> Column:
    """The beginning of the next text that takes the place of a text's end."""
    return F.substring(next_text, F.lit(1), _cut(text, share))


def edited(text: Column, next_text: Column, share: int = 3) -> Column:
    """The last floor(n / share) code points replaced by the first as many (or all) of the next text."""
    return F.concat(F.substring(text, F.lit(1), F.length(text) - _cut(text, share)), _put(text, next_text, share))


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like the edited and the next text are.

    An edited text takes most of its paragraphs whole from the two texts it is made of; these keep their
    nodes, and only the others (where the texts meet and where the second one is cut) are read anew.
    """
    prepared(docs.sparkSession)
    # Only texts travel to their neighbours; fingerprints are cheaper to make again than to carry.
    found = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    lines = found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.size(_parts(_put(F.col("text"), F.col("next_text")), PARAGRAPH)).alias("_put"),
        *(_parts(F.col(c), PARAGRAPH).alias(n) for c, n in (("text", "own"), ("edited", "new"), ("next_text", "after"))))
    known = lines.select("*", *(F.transform(n, _paragraph).alias(f"{n}_nodes") for n in ("own", "after")))
    # The edited text's last paragraphs are the next text's first ones.
    place = lambda i: i - (F.size("new") - F.col("_put"))
    new_nodes = F.transform("new", lambda x, i: F.when(x == F.get("own", i), F.get("own_nodes", i)).when(
        x == F.get("after", place(i)), F.get("after_nodes", place(i))).otherwise(_paragraph(x)))
    trees = known.withColumn("new_nodes", new_nodes).select("doc_id", "n_chars", "edited_sha256", *(
        _assembled(F.col(n), F.col(f"{n}_nodes")).alias(n) for n in ("own", "new", "after")))
    return trees.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"))
