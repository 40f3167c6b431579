"""Findings: parsing, grounding, repeat suppression, noise control and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from .. import schemas
from ..functions.joins import spread_join
from ..functions.jsontext import parse_list, whole_value
from ..functions.text import render_comment, severity_rank, strip_fence_first, strip_fence_last
from ..functions.windows import first_by, first_n
from .diffs import changed_lines


def findings_array(text: Column, fence: str = "last") -> Column:
    """ARRAY<STRUCT> of raw findings in a model answer: a JSON list, or the list under
    ``comments``; anything else gives null."""
    body = strip_fence_last(text) if fence == "last" else strip_fence_first(text)
    body = whole_value(F.regexp_replace(body, r"(?U)\A\s+|\s+\z", ""))
    # The list reader would wrap a lone object into a list, so the list test comes first.
    listed = F.transform(F.array(body), lambda b: F.when(
        F.json_array_length(b).isNotNull(), b).otherwise(F.from_json(b, "comments STRING")["comments"]))
    return F.get(F.transform(listed, lambda b: F.when(
        F.json_array_length(b).isNotNull(), parse_list(b, schemas.RAW_FINDING))), F.lit(0))


def parse_findings(answers: DataFrame, text_col: str = "content",
                   fence: str = "last") -> DataFrame:
    """One row per finding; ``pos`` is its place in the answer, ``line`` null if not a number."""
    rest = [c for c in answers.columns if c != text_col]
    exploded = answers.select(
        *rest, F.posexplode(findings_array(F.col(text_col), fence)).alias("pos", "f"))
    return exploded.select(*rest, "pos", "f.file_path", F.col("f.line").try_cast("int").alias("line"),
                           "f.severity", "f.body")


def dedup_key() -> list[Column]:
    """Root-cause key; a missing part counts as ''."""
    blank = F.lit("")
    return [F.coalesce("file_path", blank), F.coalesce("severity", blank),
            F.left(F.coalesce("body", blank), F.lit(fx.DEDUP_PREFIX_CHARS))]


def dedup_comments(comments: DataFrame) -> DataFrame:
    """First comment per root cause in list order.

    Rank 1 is pruned per map task before the exchange, so a cause shared by a third of all rows
    ships one row per task.
    """
    names = ["_path", "_severity", "_prefix"]
    keyed = comments.select("*", *[k.alias(n) for k, n in zip(dedup_key(), names)])
    return first_by(keyed, ["review_id", *names], [F.col("seq")]).drop(*names)


def filter_severity(comments: DataFrame, policies: DataFrame) -> DataFrame:
    """Comments at or above the review's threshold; unknown severities count as the lowest."""
    limits = policies.select("review_id", "min_rank")
    return (spread_join(comments, limits, "review_id", stay=True)
            .filter(severity_rank(F.col("severity"))
                    >= F.coalesce("min_rank", F.lit(fx.DEFAULT_RANK)))
            .drop("min_rank", "_group"))


def cap_comments(comments: DataFrame, policies: DataFrame) -> DataFrame:
    """First ``max_comments`` comments per review in list order."""
    limits = policies.select("review_id", F.col("max_comments").alias("_cap"))
    joined = (spread_join(comments, limits, "review_id")
              .withColumn("_cap", F.coalesce("_cap",
                                             F.lit(fx.DEFAULT_POLICY["max_comments"]))))
    return first_n(joined, ["review_id"], [F.col("seq")], F.col("_cap"), "_rn", "_group").drop("_rn", "_cap")


def noise_control(comments: DataFrame, policies: DataFrame) -> DataFrame:
    """De-duplicate, then filter by severity, then cap; one policy join serves the last two."""
    rules = policies.select("review_id", "min_rank", F.col("max_comments").alias("_cap"))
    kept = (spread_join(dedup_comments(comments), rules, "review_id")
            .filter(severity_rank(F.col("severity"))
                    >= F.coalesce("min_rank", F.lit(fx.DEFAULT_RANK)))
            .drop("min_rank")
            .withColumn("_cap", F.coalesce("_cap",
                                           F.lit(fx.DEFAULT_POLICY["max_comments"]))))
    return first_n(kept, ["review_id"], [F.col("seq")], F.col("_cap"), "_rn", "_group").drop("_rn", "_cap")


def ground_comments(comments: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``grounded`` and ``reason``: a finding must point at an added line of the diff.

    The diff side is one row per changed file, so the join never multiplies a comment.
    """
    touched = changed_lines(lines).select(
        "review_id", F.col("filename").alias("file_path"), "line_nums")
    hit = F.coalesce(F.array_contains(F.col("line_nums"), F.col("line")), F.lit(False))
    return (comments.join(touched, ["review_id", "file_path"], "left")
            .withColumn("grounded", hit)
            .withColumn("reason", F.when(F.col("grounded"), "ok")
                        .when(F.col("line_nums").isNull(), "file_not_changed")
                        .when(F.col("line").isNull(), "no_line")
                        .otherwise("line_not_added"))
            .drop("line_nums"))


def suppress_repeats(comments: DataFrame, posted: DataFrame, marker: str) -> DataFrame:
    """Drops findings whose rendered text was posted on the file before and is still open."""
    rendered = render_comment(F.col("severity"), F.col("body"), marker)
    open_before = (posted
                   .filter(F.col("body").contains(marker)
                           & (F.coalesce("in_reply_to_id", F.lit(0)) == 0))
                   .select("review_id", F.col("path").alias("_path"), F.col("body").alias("_text"))
                   .distinct())
    keyed = comments.select("*", F.col("file_path").alias("_path"), rendered.alias("_text"))
    return (keyed.join(open_before, ["review_id", "_path", "_text"], "left_anti")
            .drop("_path", "_text"))


def review_summary(raw: DataFrame, final: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Per review: raw findings by severity, comments left after noise control, files flagged.

    ``reviews`` (review_id) lists all reviews; those without a finding have zeros. Without it only
    reviews with findings are known.
    """
    found = (raw.groupBy("review_id")
             .agg(F.count(F.lit(1)).alias("found"),
                  *[F.count_if(F.col("severity") == s).alias(s.lower())
                    for s in fx.SEVERITY_RANK]))
    # Two levels instead of a distinct count: the file level is pre-aggregated on the map side.
    per_file = final.groupBy("review_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    left = per_file.groupBy("review_id").agg(F.sum("n").alias("posted"),
                                             F.count("file_path").alias("files_flagged"))
    if reviews is not None:
        found = reviews.select("review_id").distinct().join(found, "review_id", "left")
    joined = found.join(left, "review_id", "left")
    return joined.na.fill(0, [c for c in joined.columns if c != "review_id"])


def provider_payload(vcs: Column, marker: str) -> Column:
    """Request body per provider, as JSON."""
    path = F.coalesce("file_path", F.lit(""))
    line = F.coalesce("line", F.lit(1))
    text = render_comment(F.col("severity"), F.col("body"), marker)
    github = F.to_json(F.struct(path.alias("path"), line.alias("line"),
                                F.lit("RIGHT").alias("side"), text.alias("body")))
    gitlab = F.to_json(F.struct(
        text.alias("body"),
        F.struct(F.coalesce("base_sha", "head_sha").alias("base_sha"),
                 F.coalesce("start_sha", "head_sha").alias("start_sha"),
                 F.col("head_sha").alias("head_sha"), F.lit("text").alias("position_type"),
                 path.alias("new_path"), line.alias("new_line")).alias("position")))
    bitbucket = F.to_json(F.struct(
        F.struct(text.alias("raw")).alias("content"),
        F.struct(line.alias("to"), path.alias("path")).alias("inline")))
    return (F.when(vcs == "github", github).when(vcs == "gitlab", gitlab)
            .when(vcs == "bitbucket", bitbucket))
