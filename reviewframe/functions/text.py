"""Text scalars: line splitting, globs, fences, comment bodies, embed text, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fx

ALL = 1 << 30  # "to the end" for slice and substring, small enough not to overflow start + length


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, fx.LINE_BREAK, "\n")


def split_lines(text: Column) -> Column:
    """Lines of ``text`` over every line separator; no empty line after a trailing one."""
    body = F.regexp_replace(normalise_newlines(text), r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def hunk_start(line: Column) -> Column:
    """First new-file line number of a hunk header, null when the line is not one."""
    return F.regexp_extract(line, fx.HUNK_HEADER, 1).try_cast("int")


def _quote(ch: Column) -> Column:
    return F.when(ch.rlike(r"[\w/]"), ch).otherwise(F.concat(F.lit("\\"), ch))


def _class_to_regex(token: Column) -> Column:
    """``[seq]`` / ``[!seq]`` to a Java character class; reversed ranges match nothing."""
    negated = token.startswith("[!")
    body = F.when(negated, F.substring(token, 3, ALL)).otherwise(F.substring(token, 2, ALL))
    body = F.regexp_replace(body, r"\]\z", "")
    items = F.regexp_extract_all(body, F.lit(r"(?s)(.-.|.)"), F.lit(1))

    def item(x: Column) -> Column:
        first, last = F.substring(x, 1, 1), F.substring(x, 3, 1)
        ranged = F.when(first > last, F.lit("")).otherwise(
            F.concat(_quote(first), F.lit("-"), _quote(last)))
        return F.when(F.length(x) == 3, ranged).otherwise(_quote(x))

    joined = F.array_join(F.transform(items, item), "")
    return (F.when((joined == "") & negated, F.lit("."))
            .when(joined == "", F.lit("(?!)"))
            .when(negated, F.concat(F.lit("[^"), joined, F.lit("]")))
            .otherwise(F.concat(F.lit("["), joined, F.lit("]"))))


def glob_to_regex(glob: Column) -> Column:
    """Shell glob to a regex body; ``*`` crosses ``/``, an unclosed ``[`` is a plain character."""
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)(\[!?\]?[^\]]*\]|.)"), F.lit(1))

    def token(t: Column) -> Column:
        return (F.when(t == "*", F.lit(".*")).when(t == "?", F.lit("."))
                .when(F.length(t) > 1, _class_to_regex(t)).otherwise(_quote(t)))

    return F.array_join(F.transform(tokens, token), "")


def globs_to_regex(globs: Column) -> Column:
    """One anchored regex for a whole array of globs, so a path is tested once, not per glob."""
    bodies = F.array_join(F.transform(globs, glob_to_regex), "|")
    return (F.when(globs.isNull() | (F.size(globs) == 0), F.lit("(?!)"))
            .otherwise(F.concat(F.lit(r"(?s)\A(?:"), bodies, F.lit(r")\z"))))


def glob_match(path: Column, glob: Column) -> Column:
    """Whole-string, case-sensitive glob test."""
    return F.rlike(path, F.concat(F.lit(r"(?s)\A(?:"), glob_to_regex(glob), F.lit(r")\z")))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def strip_fence_last(text: Column) -> Column:
    """Body of the last ```json fence, else of the first plain fence pair, else the text."""
    after_json = F.substring_index(F.substring_index(text, "```json", -1), "```", 1)
    plain = F.get(F.split(text, "```", -1), F.lit(1))
    return (F.when(text.contains("```json"), _strip(after_json))
            .when(text.contains("```"), _strip(plain)).otherwise(text))


def strip_fence_first(text: Column) -> Column:
    """From the first ```json fence (any case) to the last fence, else first to last fence."""
    start = F.locate("```json", F.lower(text)) + 7
    json_rest = F.substring(text, start, F.lit(ALL))
    plain_rest = F.substring(text, F.locate("```", text) + 3, F.lit(ALL))

    def before_last_fence(rest: Column) -> Column:
        return F.regexp_replace(rest, r"(?s)\A(.*)```.*\z", "$1")

    return (F.when(F.lower(text).contains("```json"), _strip(before_last_fence(json_rest)))
            .when(text.contains("```"), _strip(before_last_fence(plain_rest))).otherwise(text))


def render_comment(severity: Column, body: Column, marker: str) -> Column:
    return F.concat(F.lit("**["), F.coalesce(severity, F.lit(fx.DEFAULT_SEVERITY)),
                    F.lit(f"] {marker}**\n\n"), F.coalesce(body, F.lit("")))


def render_fallback(path: Column, line: Column, rendered: Column, bold: bool = False) -> Column:
    """General-comment form for a body that could not be placed on a line."""
    tick = "**`" if bold else "`"
    kcit = "`**" if bold else "`"
    return F.concat(F.lit(tick), path, F.lit(":"), line.cast("string"), F.lit(kcit + "\n\n"),
                    rendered)


def append_description(body: Column, text: Column, marker: str) -> Column:
    current = F.coalesce(body, F.lit(""))
    return (F.when(current.contains(marker), current)
            .otherwise(F.concat(current, F.lit(fx.BLOCK_SEPARATOR), text)))


def embed_text(content: Column, node_type: Column | None = None, node_name: Column | None = None,
               budget: int | None = None) -> Column:
    """Text handed to an encoder: one line, whole unless a ``budget`` of characters is given."""
    text = content
    if node_type is not None:
        text = F.concat(node_type, F.lit(" "), node_name, F.lit(": "), content)
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return line if budget is None else F.substring(line, 1, budget)


def parse_ts(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp, null when unreadable (the session zone must be UTC)."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def split_repo(repo: Column) -> tuple[Column, Column, Column]:
    """(workspace, slug, valid) of ``workspace/slug``; the slug keeps further slashes."""
    valid = repo.contains("/")
    return (F.when(valid, F.substring_index(repo, "/", 1)),
            F.when(valid, F.substring(repo, F.locate("/", repo) + 1, F.lit(ALL))),
            F.coalesce(valid, F.lit(False)))


def search_result_block(path: Column, node_type: Column, name: Column, score: Column,
                        content: Column) -> Column:
    return F.concat(F.lit("File: "), path, F.lit(" | "), node_type, F.lit(" "), name,
                    F.lit(" (score: "), F.format_string("%.2f", score), F.lit(")\n"),
                    F.substring(content, 1, fx.SEARCH_TEXT_CHARS))


def grade_done(feedback: Column, iteration: Column) -> Column:
    """True when the grader is satisfied (substring test) or the rounds are used up."""
    return (F.upper(F.coalesce(feedback, F.lit(""))).contains("PASS")
            | (F.coalesce(iteration, F.lit(0)) >= fx.MAX_REFINE_ROUNDS))


def classify_error(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (F.when(low.contains("429") | low.contains("rate") | low.contains("quota"),
                   "rate_limited")
            .when(low.contains("404") | low.contains("not found"), "not_found")
            .otherwise("other"))


def severity_rank(severity: Column) -> Column:
    """Case-sensitive rank; unknown or null counts as the lowest."""
    rank = F.lit(fx.DEFAULT_RANK)
    for name, value in fx.SEVERITY_RANK.items():
        rank = F.when(severity == name, F.lit(value)).otherwise(rank)
    return rank


def extension(path: Column) -> Column:
    """Text after the last dot, '' when there is none."""
    return F.when(path.contains("."), F.substring_index(path, ".", -1)).otherwise(F.lit(""))


def language_of(path: Column) -> Column:
    ext = extension(path)
    lang = F.lit(None).cast("string")
    for name, value in fx.LANGUAGE_BY_EXTENSION.items():
        lang = F.when(ext == name, F.lit(value)).otherwise(lang)
    return lang
