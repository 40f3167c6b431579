"""Per-repository policies: resolution against the defaults and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.text import globs_to_regex, severity_rank

_SECURITY = ("STRUCT<forbidden_apis: ARRAY<STRING>, require_parameterized_queries: BOOLEAN, "
             "flag_hardcoded_secrets: BOOLEAN>")
_PERFORMANCE = ("STRUCT<flag_n_plus_one: BOOLEAN, require_timeouts_on_network_calls: BOOLEAN, "
                "flag_unbounded_loops: BOOLEAN>")
_STYLE = ("STRUCT<require_docstrings: BOOLEAN, naming_convention: STRING, "
          "flag_dead_code: BOOLEAN>")
# Numbers are read as text and cast, so one badly typed value does not void the whole record.
_CONFIG = ("max_comments_per_pr STRING, max_comments STRING, severity_filter STRING, "
           f"ignore_paths ARRAY<STRING>, security {_SECURITY}, performance {_PERFORMANCE}, "
           f"style {_STYLE}")


def default_ignore_regex() -> Column:
    return globs_to_regex(F.array(*[F.lit(g) for g in fx.DEFAULT_POLICY["ignore_paths"]]))


def default_group(group: str) -> Column:
    fields = []
    for name, value in fx.DEFAULT_POLICY[group].items():
        lit = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        fields.append(lit.alias(name))
    return F.struct(*fields)


def _group(config: Column, group: str) -> Column:
    """The override's group when it is given at all, with absent rules off; else the defaults."""
    given = config[group]
    fields = []
    for name, value in fx.DEFAULT_POLICY[group].items():
        if isinstance(value, bool):
            fields.append(F.coalesce(given[name], F.lit(False)).alias(name))
        elif isinstance(value, list):
            fields.append(F.coalesce(given[name], F.array().cast("array<string>")).alias(name))
        else:
            fields.append(given[name].alias(name))
    return F.when(given.isNotNull(), F.struct(*fields)).otherwise(default_group(group))


def resolve_columns(config: Column) -> list[Column]:
    """Policy columns out of a parsed (possibly null) override."""
    default = fx.DEFAULT_POLICY
    globs = F.array(*[F.lit(g) for g in default["ignore_paths"]])
    limit = F.coalesce(config["max_comments_per_pr"].try_cast("int"),
                       config["max_comments"].try_cast("int"), F.lit(default["max_comments"]))
    return [limit.alias("max_comments"),
            F.coalesce(config["severity_filter"], F.lit(default["severity_filter"]))
            .alias("severity_filter"),
            F.coalesce(config["ignore_paths"], globs).alias("ignore_paths"),
            *[_group(config, g).alias(g) for g in ("security", "performance", "style")]]


def policy_resolve(reviews: DataFrame, overrides: DataFrame) -> DataFrame:
    """One policy per review: defaults, with each supplied top-level key replacing its group.

    ``overrides`` holds one row per repo. No broadcast is forced: the planner takes one when the
    table turns out small and otherwise splits skewed repos in the shuffled join.
    """
    parsed = overrides.select("repo", F.from_json("config", _CONFIG).alias("_config"))
    joined = reviews.select("review_id", "repo").join(parsed, "repo", "left")
    resolved = joined.select("review_id", "repo", *resolve_columns(F.col("_config")))
    return (resolved
            .withColumn("min_rank", severity_rank(F.upper("severity_filter")))
            .withColumn("ignore_regex", globs_to_regex(F.col("ignore_paths"))))


def policy_text() -> Column:
    """All active rules as ``- `` lines in a fixed order, or the no-rules sentence."""
    sec, perf, style = F.col("security"), F.col("performance"), F.col("style")
    apis = F.when(F.size(sec["forbidden_apis"]) > 0,
                  F.concat(F.lit(fx.POLICY_LINE_FORBIDDEN),
                           F.array_join(sec["forbidden_apis"], ", ")))
    flags = [(sec, "require_parameterized_queries"), (sec, "flag_hardcoded_secrets"),
             (perf, "flag_n_plus_one"), (perf, "require_timeouts_on_network_calls"),
             (perf, "flag_unbounded_loops"), (style, "require_docstrings"),
             (style, "flag_dead_code")]
    lines = [apis, *[F.when(group[name], F.lit(fx.POLICY_LINES[name])) for group, name in flags]]
    rules = F.transform(F.filter(F.array(*lines), lambda x: x.isNotNull()),
                        lambda x: F.concat(F.lit("- "), x))
    return F.when(F.size(rules) > 0, F.array_join(rules, "\n")).otherwise(F.lit(fx.POLICY_EMPTY))


def _flag_text(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def policy_category_text(category: Column) -> Column:
    """Text of one rule group; the category is trimmed and lower-cased."""
    cat = F.lower(F.regexp_replace(category, r"(?U)\A\s+|\s+\z", ""))
    sec, perf, style = F.col("security"), F.col("performance"), F.col("style")
    security = F.when(
        F.size(sec["forbidden_apis"]) > 0,
        F.concat(F.lit("Forbidden APIs: "), F.array_join(sec["forbidden_apis"], ", "),
                 F.lit("\nRequire parameterized queries: "),
                 _flag_text(sec["require_parameterized_queries"]),
                 F.lit("\nFlag hardcoded secrets: "), _flag_text(sec["flag_hardcoded_secrets"]))
    ).otherwise(F.lit(fx.POLICY_SECURITY_EMPTY))
    performance = F.concat(
        F.lit("Flag N+1: "), _flag_text(perf["flag_n_plus_one"]),
        F.lit("\nRequire timeouts: "), _flag_text(perf["require_timeouts_on_network_calls"]),
        F.lit("\nFlag unbounded loops: "), _flag_text(perf["flag_unbounded_loops"]))
    styling = F.concat(
        F.lit("Require docstrings: "), _flag_text(style["require_docstrings"]),
        F.lit("\nNaming: "), F.coalesce(style["naming_convention"], F.lit("any")),
        F.lit("\nFlag dead code: "), _flag_text(style["flag_dead_code"]))
    return (F.when(cat == "all", policy_text()).when(cat == "security", security)
            .when(cat == "performance", performance).when(cat == "style", styling)
            .otherwise(F.format_string(fx.POLICY_UNKNOWN, cat)))
