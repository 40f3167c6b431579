"""Unified diffs to numbered added lines.

A patch is one cell, so everything that depends on line order happens inside the row with array
functions: no exchange, no window, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.once import computed
from ..functions.text import ALL, hunk_start, normalise_newlines

_BREAK_SET = r"\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029"
_FILE_BOUNDARY = rf"(?:(?<=[{_BREAK_SET}])|\A)(?={fx.FILE_HEADER})"


def hunks_of(patch: Column) -> Column:
    """Added lines per hunk: ARRAY<ARRAY<STRUCT<line_num, content, prev_content>>>.

    ``prev_content`` is the text of the line directly above when that line was added too.
    """
    text = F.concat(F.lit("\n"), normalise_newlines(F.coalesce(patch, F.lit(""))))
    # Element 0 is whatever precedes the first header line.
    sections = F.slice(F.split(text, r"\n(?=@@)", -1), 2, ALL)
    headed = F.transform(sections, lambda s: F.struct(
        hunk_start(F.substring_index(s, "\n", 1)).alias("start"),
        # Removed lines and "no newline" notes do not take a new-file number.
        F.filter(F.slice(F.split(s, "\n", -1), 2, ALL),
                 lambda l: ~(l.startswith("-") | l.startswith("\\"))).alias("lines")))
    valid = F.filter(headed, lambda h: h["start"].isNotNull())
    added = F.transform(valid, lambda h: F.filter(
        F.transform(h["lines"], lambda l, i: F.struct(
            (h["start"] + i).alias("line_num"), l.alias("raw"),
            F.get(h["lines"], i - 1).alias("above"))),
        lambda x: x["raw"].startswith("+")))
    kept = F.filter(added, lambda h: F.size(h) > 0)
    return F.transform(kept, lambda h: F.transform(h, lambda x: F.struct(
        x["line_num"].alias("line_num"),
        F.substring(x["raw"], 2, ALL).alias("content"),
        F.when(x["above"].startswith("+"), F.substring(x["above"], 2, ALL))
        .alias("prev_content"))))


def parse_hunks(files: DataFrame, with_prev: bool = False) -> DataFrame:
    """One row per added line with its new-file number; ``hunk_no`` counts kept hunks from 1."""
    keys = ["review_id", "filename"]
    hunks = files.select(*keys, F.posexplode(hunks_of(F.col("patch"))).alias("hunk_pos", "hunk"))
    lines = hunks.select(*keys, (F.col("hunk_pos") + 1).alias("hunk_no"),
                         F.inline("hunk").alias("line_num", "content", "prev_content"))
    return lines if with_prev else lines.drop("prev_content")


def hunk_table(files: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per kept hunk, its lines still an array: what the rule scan reads."""
    return files.select("review_id", "filename", *(carry or []),
                        F.posexplode(hunks_of(F.col("patch"))).alias("p", "hunk")).select(
        "review_id", "filename", (F.col("p") + 1).alias("hunk_no"), *(carry or []), "hunk")


def touched_lines(files: DataFrame) -> DataFrame:
    """(review_id, filename, line_nums) straight from the patch, without exploding a line."""
    nums = F.transform(F.flatten(hunks_of(F.col("patch"))), lambda x: x["line_num"])
    return (computed(files, ["review_id", "filename"], line_nums=nums)
            .filter(F.size("line_nums") > 0))


def hunks_nested(lines: DataFrame) -> DataFrame:
    """Long lines back to one row per file with ARRAY<ARRAY<STRUCT<line_num, content>>>."""
    # Lines travel once, by file; a file's sorted lines are cut in the row where the hunk changes. A line's values are
    # one field beside its hunk, so they sort alike, and a hunk is a slice: per line only the change of hunk is looked for.
    file = lines.groupBy("review_id", "filename").agg(F.sort_array(F.collect_list(
        F.struct("hunk_no", F.struct("line_num", "content").alias("line")))).alias("_lines"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | ~F.get("_lines", i)["hunk_no"].eqNullSafe(
        F.get("_lines", i - 1)["hunk_no"]))
    # The cuts and lines are bound once through a one-element array.
    bound = F.array(F.struct(starts.alias("at"), F.col("_lines")["line"].alias("lines")))
    cut = F.flatten(F.transform(bound, lambda b: F.transform(b["at"], lambda p, j: F.slice(
        b["lines"], p + 1, F.coalesce(F.get(b["at"], j + 1), F.size(b["lines"])) - p))))
    return file.select("review_id", "filename", cut.alias("hunks"))


def nested_hunks(files: DataFrame) -> DataFrame:
    """The nested form straight from the patch, within the row."""
    hunks = F.transform(hunks_of(F.col("patch")), lambda h: F.transform(
        h, lambda x: F.struct(x["line_num"].alias("line_num"), x["content"].alias("content"))))
    return (computed(files, ["review_id", "filename"], hunks=hunks)
            .filter(F.size("hunks") > 0))


def lines_of_nested(nested: DataFrame) -> DataFrame:
    """Nested hunks to the long form."""
    return (nested.select("review_id", "filename", F.posexplode("hunks").alias("p", "hunk"))
            .select("review_id", "filename", (F.col("p") + 1).alias("hunk_no"), F.inline("hunk")))


def lines_in_hunks(nested: DataFrame) -> DataFrame:
    """(review_id, filename, line_nums) of the nested form: what ``changed_lines`` finds, without meeting again."""
    nums = F.sort_array(F.array_compact(F.array_distinct(F.flatten("hunks")["line_num"])))
    # The keys pass the generator too: no filter of a later join goes below it, so what made ``nested`` is shared.
    return computed(nested, [], review_id=F.col("review_id"), filename=F.col("filename"), line_nums=nums)


def added_lines_json(nested: DataFrame) -> DataFrame:
    """All added lines of a file as one JSON array, the form a model is given."""
    return computed(nested, ["review_id", "filename"], added_lines=F.to_json(F.flatten("hunks")))


def changed_lines(lines: DataFrame) -> DataFrame:
    """One row per changed file with its sorted added line numbers (bounded by one file)."""
    if "line_nums" in lines.columns:
        return lines
    return lines.groupBy("review_id", "filename").agg(
        F.array_sort(F.collect_set("line_num")).alias("line_nums"))


def shared_files(lines: DataFrame) -> DataFrame:
    """``changed_lines`` of files with a line number, for several uses: no filter of a later join goes below the
    generator, so all uses share the exchange that brought the lines together."""
    found = changed_lines(lines)
    return computed(found, [], **{c: F.col(c) for c in ("review_id", "filename", "line_nums")}).filter(F.size("line_nums") > 0)


def diff_stats(lines: DataFrame) -> DataFrame:
    """Added lines and hunks per file and per review (``level`` tells which).

    Hunks are numbered 1..n per file, so their count is a maximum: no distinct, and the review
    level adds up per-file rows only.
    """
    per_file = lines.groupBy("review_id", "filename").agg(
        F.count(F.lit(1)).alias("added_lines"), F.max("hunk_no").cast("bigint").alias("hunks"))
    rolled = per_file.rollup("review_id", "filename").agg(
        F.sum("added_lines").alias("added_lines"), F.sum("hunks").alias("hunks"),
        F.grouping_id().alias("g"))
    return rolled.filter(F.col("g") < 3).select(
        "review_id", F.coalesce("filename", F.lit("")).alias("filename"),
        F.when(F.col("g") == 0, "file").otherwise("review").alias("level"),
        "added_lines", "hunks")


def _section_name(section: Column) -> Column:
    first = F.regexp_extract(section, rf"\A([^{_BREAK_SET}]*)", 1)
    at = F.locate(" b/", first)
    return F.when(at > 0, F.regexp_replace(F.substring(first, at + 3, F.lit(ALL)),
                                           r"\A\s+|\s+\z", ""))


def split_multifile_diff(df: DataFrame, diff_col: str = "diff") -> DataFrame:
    """One multi-file diff per row to (file, patch) rows; a file named twice keeps the last patch.

    The last-wins rule only looks within one diff, so it is a sorted-array scan inside the row.
    """
    sections = F.transform(F.split(F.col(diff_col), _FILE_BOUNDARY, -1), lambda s, i: F.struct(
        _section_name(s).alias("filename"), i.alias("pos"), s.alias("patch")))
    named = F.filter(sections, lambda s: s["patch"].startswith(fx.FILE_HEADER)
                     & F.coalesce(s["filename"] != "", F.lit(False)))
    ordered = F.transform(F.array(F.array_sort(named)), lambda arr: F.filter(
        arr, lambda s, i: ~s["filename"].eqNullSafe(F.get(arr, i + 1)["filename"])))
    rest = [c for c in df.columns if c != diff_col]
    return (df.select(*rest, F.inline(F.get(ordered, F.lit(0))))
            .select(*rest, "filename", "pos", "patch"))
