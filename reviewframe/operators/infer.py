"""Model inputs and batch inference with ordered fallback."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.joins import spread_join
from ..functions.text import classify_error
from ..functions.windows import first_n
from .feedback import first_review

# --- fixed values: patch blocks -------------------------------------------------------------
PLAIN_BLOCK = ("File: ", "\n", "", "\n")
MARKDOWN_BLOCK = ("\n### File: `", "`\n```\n", "\n```\n", "")
# --- fixed values: headings of a review message ----------------------------------------------
HEADINGS = ("## Code Changes (Diff Hunks):\n", "\n\n## Blast Radius Context:\n",
            "\n\n## Policy Rules:\n", "\n\n## ")


def patch_bundle(files: DataFrame, style: str = "plain",
                 budget: int = fx.DESCRIPTION_BUDGET) -> DataFrame:
    """All patches of a review as one text in file order, cut to ``budget`` characters.

    Text beyond the budget is dropped before the exchange: a patch is cut to the budget, and as
    every block has at least ``least`` characters only the first budget/least files can show.
    """
    before, middle, after, joiner = PLAIN_BLOCK if style == "plain" else MARKDOWN_BLOCK
    block = F.concat(F.lit(before), "filename", F.lit(middle),
                     F.substring("patch", 1, budget), F.lit(after))
    least = len(before + middle + after + joiner)
    shown = files.filter(F.length("patch") > 0).select("review_id", "pos", block.alias("block"))
    head = first_n(shown, ["review_id"], [F.col("pos")], -(-budget // least), "_rn")
    ordered = F.array_sort(F.collect_list(F.struct("_rn", "block")))
    return head.groupBy("review_id").agg(F.substring(
        F.array_join(F.transform(ordered, lambda b: b["block"]), joiner), 1, budget)
        .alias("bundle"))


def review_message(diff: Column, context: Column, policy: Column, feedback: Column) -> Column:
    return F.concat(F.lit(HEADINGS[0]), diff, F.lit(HEADINGS[1]), context, F.lit(HEADINGS[2]),
                    policy, F.lit(HEADINGS[3]), feedback)


def review_inputs(diffs: DataFrame, context: DataFrame, policies: DataFrame,
                  feedback: DataFrame, service: str = "the reviewer",
                  of_review: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Per changed file: its added lines and context, and its review's rules and feedback.

    ``diffs`` (review_id, filename, added_lines), ``context`` (review_id[, filename], context),
    ``policies`` (review_id, policy_text), ``feedback`` (review_id, summary); a review without
    feedback is told to be the first one. ``of_review``: further columns out of (policy_text, summary),
    worked out once a review. A summary names all paths of its review, so what is worked out of it for
    each file costs as much as the square of the files.
    """
    blank = F.lit("")
    own = of_review or {}
    first = first_review(service)
    place = [c for c in ("review_id", "filename") if c in context.columns]
    # A review's texts name all its files' paths: they join what is there by file last, and go nowhere from it.
    known = (policies.select("review_id", "policy_text")
             .join(feedback.select("review_id", "summary"), "review_id", "full")
             .withColumn("summary", F.coalesce("summary", first)))
    known = known.select("*", F.lit(True).alias("_known"), *[
        of(F.col("policy_text"), F.col("summary")).alias(name) for name, of in own.items()])
    by_file = diffs.join(context.select(*place, "context"), place, "left")
    joined = spread_join(by_file, known, "review_id", leave=("added_lines", "context")).select(
        *[c for c in by_file.columns if c != "context"], "policy_text", F.coalesce("summary", first).alias("summary"), "context",
        # A review that nothing is known of has no rules and is the first one.
        *[F.when(F.col("_known"), F.col(name)).otherwise(of(F.lit(None).cast("string"), first)).alias(name)
          for name, of in own.items()])
    parts = [F.coalesce(F.col(c), blank) for c in ("added_lines", "context", "policy_text",
                                                   "summary")]
    return joined.withColumn("message", review_message(*parts))


_ANSWER = ("request_id string, provider string, attempt int, content string, "
           "errors array<struct<provider: string, message: string>>")


def waterfall_infer(prompts: DataFrame, providers: list[tuple[str, Callable[[str], str]]],
                    pause_seconds: float = 0.0) -> DataFrame:
    """Asks the providers in order until one answers; rows (request_id STRING, prompt STRING).

    ``errors`` lists the failures before the answer with their class; ``content`` is null when all
    failed. Time limits belong to the callables.
    """
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for request_id, prompt in zip(frame["request_id"], frame["prompt"]):
                errors, answer, used, attempt = [], None, None, 0
                for name, call in providers:
                    attempt += 1
                    try:
                        answer, used = call(prompt).strip(), name
                        break
                    except Exception as e:
                        errors.append({"provider": name, "message": str(e)})
                        if attempt < len(providers) and pause_seconds:
                            time.sleep(pause_seconds)
                rows.append((request_id, used, attempt, answer, errors))
            yield pd.DataFrame(rows, columns=["request_id", "provider", "attempt", "content",
                                              "errors"])

    answered = prompts.select("request_id", "prompt").mapInPandas(ask, _ANSWER)
    return answered.withColumn("errors", F.transform("errors", lambda e: F.struct(
        e["provider"].alias("provider"), classify_error(e["message"]).alias("kind"),
        e["message"].alias("message"))))
