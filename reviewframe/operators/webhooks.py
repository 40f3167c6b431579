"""Webhook deliveries to review requests: authenticity, gates and outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.hmac import hmac_sha256
from ..functions.jsontext import is_broken, parse_record, record_of
from ..functions.once import computed

# One parse serves the three providers; numbers are read as text and cast.
_BODY = ("action: STRING, number: STRING, repository: STRUCT<full_name: STRING>, "
         "pull_request: STRUCT<head: STRUCT<sha: STRING>>, issue: STRUCT<number: STRING>, "
         "comment: STRUCT<body: STRING, id: STRING>, sender: STRUCT<login: STRING>, "
         "object_attributes: STRUCT<action: STRING, iid: STRING, last_commit: STRUCT<id: STRING>>, "
         "project: STRUCT<id: STRING, path_with_namespace: STRING>, "
         "pullrequest: STRUCT<id: STRING, source: STRUCT<commit: STRUCT<hash: STRING>>>")


def has_command(body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    hit = F.lit(False)
    for command in fx.COMMANDS:
        hit = hit | low.contains(command)
    return hit


def is_bot(login: Column, self_name: str) -> Column:
    low = F.lower(F.coalesce(login, F.lit("")))
    return low.contains(fx.BOT_TAG) | low.contains(self_name.lower())


def signature_valid(secrets: dict[str, str]) -> Column:
    """Per provider: HMAC of the body, a shared token, or nothing; no secret means valid."""
    signature = F.col("signature")

    def check(vcs: str, expected: Column) -> Column:
        if not secrets.get(vcs):
            return F.lit(True)
        return F.coalesce(signature == expected, F.lit(False))

    github = secrets.get("github") or ""
    return (F.when(F.col("vcs") == "github",
                   check("github", F.concat(F.lit("sha256="),
                                            hmac_sha256(github, F.col("body")))))
            .when(F.col("vcs") == "gitlab", check("gitlab", F.lit(secrets.get("gitlab") or "")))
            .otherwise(F.lit(True)))


def verify_signature(deliveries: DataFrame, secrets: dict[str, str]) -> DataFrame:
    return deliveries.withColumn("signature_ok", signature_valid(secrets))


def normalise_webhooks(deliveries: DataFrame, self_name: str,
                       secrets: dict[str, str] | None = None) -> DataFrame:
    """Deliveries to review requests plus ``outcome``: the first gate that fails, else accepted.

    The rate limit is a stateful gate of its own (``operators.rate`` and ``streaming``).
    """
    blank = F.lit("")
    vcs, event = F.col("vcs"), F.col("event")
    p = F.col("p")
    checked = computed(deliveries, ["delivery_id", "vcs", "event", "received_at"],
                       signature_ok=signature_valid(secrets or {}),
                       parsed=parse_record(F.col("body"), _BODY))
    checked = checked.select("delivery_id", "vcs", "event", "received_at", "signature_ok",
                             is_broken(F.col("parsed")).alias("broken"),
                             record_of(F.col("parsed")).alias("p"))
    commented = (vcs == "github") & (event == "issue_comment")
    by_vcs = lambda gh, gl, bb: F.when(vcs == "github", gh).when(vcs == "gitlab", gl).otherwise(bb)
    repo = F.coalesce(by_vcs(p["repository"]["full_name"], p["project"]["path_with_namespace"],
                             p["repository"]["full_name"]), blank)
    number = by_vcs(F.when(commented, p["issue"]["number"]).otherwise(p["number"]),
                    p["object_attributes"]["iid"], p["pullrequest"]["id"]).try_cast("bigint")
    sha = F.coalesce(by_vcs(F.when(commented, blank).otherwise(p["pull_request"]["head"]["sha"]),
                            p["object_attributes"]["last_commit"]["id"],
                            p["pullrequest"]["source"]["commit"]["hash"]), blank)
    comment = F.when(commented, F.coalesce(p["comment"]["body"], blank)).otherwise(blank)
    event_ok = F.coalesce(by_vcs(event.isin(fx.GITHUB_EVENTS), event == fx.GITLAB_EVENT,
                                 event.isin(fx.BITBUCKET_EVENTS)), F.lit(False))
    action_ok = F.coalesce(by_vcs(
        F.when(commented, p["action"] == "created").otherwise(p["action"].isin(fx.GITHUB_ACTIONS)),
        p["object_attributes"]["action"].isin(fx.GITLAB_ACTIONS), F.lit(True)), F.lit(False))
    outcome = (
        F.when(~F.col("signature_ok"), "invalid_signature")
        .when(F.col("broken"), "invalid_json")
        .when(~event_ok, "event_ignored")
        .when(~action_ok, "action_ignored")
        .when(commented & ~has_command(p["comment"]["body"]), "no_command")
        .when(commented & is_bot(p["sender"]["login"], self_name), "bot_ignored")
        .when((repo == "") | (F.coalesce(number, F.lit(0)) == 0), "missing_fields")
        .otherwise("accepted"))
    review_id = F.concat_ws(":", vcs, repo, number.cast("string"), sha)
    done = computed(
        checked, ["delivery_id", "vcs", "received_at"],
        review_id=review_id, repo=repo, pr_number=number, head_sha=sha,
        project_id=F.when(vcs == "gitlab", p["project"]["id"].try_cast("bigint")),
        comment_body=comment,
        comment_id=F.when(commented, F.coalesce(p["comment"]["id"], blank)).otherwise(blank),
        outcome=outcome)
    return done.select("delivery_id", "review_id", "vcs", "repo", "pr_number", "head_sha",
                       "project_id", "comment_body", "comment_id", "received_at", "outcome")


def delivery_outcome(normalised: DataFrame, refusals: DataFrame,
                     key: str = "delivery_id") -> DataFrame:
    """Adds the last gate: accepted deliveries the limiter refused become ``rate_limited``.

    ``key`` names a column whose values are unique and are the refusals' request ids. Delivery ids
    of providers are not: they repeat on redelivery, name a hook, or are missing.
    """
    refused = refusals.select(F.col("request_id").alias(key), F.lit(True).alias("_refused"))
    return (normalised.join(refused, key, "left")
            .withColumn("outcome", F.when(F.col("_refused"), "rate_limited")
                        .otherwise(F.col("outcome"))).drop("_refused"))


def outcome_audit(outcomes: DataFrame) -> DataFrame:
    """Audit rows (event, data) for deliveries that leave a trace: rejected, limited, queued."""
    event = (F.when(F.col("outcome") == "invalid_signature", "webhook_rejected")
             .when(F.col("outcome") == "rate_limited", "webhook_rate_limited")
             .when(F.col("outcome") == "accepted", "review_queued"))
    number_key = F.col("vcs") == "gitlab"
    rejected = F.to_json(F.struct(
        "vcs", F.when(number_key, "invalid_token").otherwise("invalid_signature").alias("reason"),
        F.when(F.col("vcs") == "github", F.col("delivery_id")).alias("delivery_id")))
    # Null fields are left out of the JSON, which gives each provider its own key set.
    accepted = F.col("outcome") == "accepted"
    noted = F.to_json(F.struct(
        "vcs", "repo", F.when(accepted, F.col("project_id")).alias("project_id"),
        F.when(~number_key, F.col("pr_number")).alias("pr_number"),
        F.when(number_key, F.col("pr_number")).alias("mr_iid"),
        F.when(accepted, F.col("head_sha")).alias("head_sha"),
        F.when(accepted & (F.col("vcs") == "github"), F.col("delivery_id")).alias("delivery_id"),
        F.when(accepted & (F.col("vcs") == "bitbucket"), F.col("delivery_id"))
        .alias("hook_uuid")))
    return (outcomes.withColumn("event", event).filter(F.col("event").isNotNull())
            .select("event", F.when(F.col("event") == "webhook_rejected", rejected)
                    .otherwise(noted).alias("data"), "received_at"))
