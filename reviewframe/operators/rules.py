"""Deterministic rules over added lines and definitions.

Line rules look at one line, or at the line right above it (``prev_content``, which the diff parser
supplies within the row), so a scan of the lines needs no exchange; only hits travel. The order
``seq`` of a finding is the struct (file, line, rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.once import computed
from .policy import default_group, default_ignore_regex

# What the rules look for in a line or a definition.
RULE_PATTERNS = {
    "secret": r"""(?i)\b(api[_-]?key|secret|token|passw(or)?d)\b\s*[:=]\s*["'][^"']{8,}["']""",
    "secret_prefix": r"\b(ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{8,}|AKIA[0-9A-Z]{16})\b",
    "secret_pem": r"BEGIN [A-Z ]*PRIVATE KEY",
    "sql_format": r"""(?i)(["'].*\b(select|insert|update|delete)\b.*["']\s*(%|\+|\.format\()|\bf["'].*\b(select|insert|update|delete)\b.*\{)""",
    "loop": r"^\s*(for|while)\b",
    "query": r"\b(execute|executemany|query|find|find_one|fetchone|fetchall)\(",
    "network": r"\b(requests\.(get|post|put|patch|delete|head|request)|urlopen|httpx\.\w+)\s*\(",
    "unbounded": r"(?m)^\s*while\s+(True|1)\s*:",
    "exit": r"\b(break|return|raise)\b",
    "snake_case": r"^_*[a-z][a-z0-9_]*$",
    "terminator": r"^\s*(return|raise|break|continue)\b",
}
_P = RULE_PATTERNS

# rule: (severity, message, policy group, policy flag)
RULES = {
    "G1": ("BLOCKER", "Forbidden API", "security", None),
    "G2": ("BLOCKER", "Hardcoded secret", "security", "flag_hardcoded_secrets"),
    "G3": ("BLOCKER", "SQL built by string formatting", "security",
           "require_parameterized_queries"),
    "G4": ("WARNING", "Query inside a loop", "performance", "flag_n_plus_one"),
    "G5": ("WARNING", "Network call without timeout", "performance",
           "require_timeouts_on_network_calls"),
    "G6": ("WARNING", "Unbounded loop", "performance", "flag_unbounded_loops"),
    "G7": ("INFO", "Missing docstring", "style", "require_docstrings"),
    "G8": ("INFO", "Name breaks the naming convention", "style", "naming_convention"),
    "G9": ("INFO", "Unreachable code", "style", "flag_dead_code"),
}


def indent_of(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def is_secret(line: Column) -> Column:
    return line.rlike(_P["secret"]) | line.rlike(_P["secret_prefix"]) | line.rlike(_P["secret_pem"])


def is_sql_format(line: Column) -> Column:
    return line.rlike(_P["sql_format"])


def is_untimed_call(line: Column) -> Column:
    return line.rlike(_P["network"]) & ~line.contains("timeout")


def is_dead(line: Column, prev: Column) -> Column:
    return F.coalesce((line.rlike(r"\S")) & prev.rlike(_P["terminator"])
                      & (indent_of(line) == indent_of(prev)), F.lit(False))


def _body(rule: str, line: Column, detail: Column | None) -> Column:
    """A finding's text. The line comes first: findings on two lines must not begin alike, or noise
    control would take them for one."""
    head = F.concat(F.lit("Line "), F.coalesce(line.cast("string"), F.lit("?")),
                    F.lit(f": [{rule}] {RULES[rule][1]}"))
    return head if detail is None else F.concat(head, F.lit(": "), detail)


def _finding(rule: str, path: str, line: str, detail: Column | None = None) -> list[Column]:
    severity = RULES[rule][0]
    body = _body(rule, F.col(line), detail)
    return [F.struct(F.col(path).alias("file_path"), F.col(line).alias("line"),
                     F.lit(rule).alias("rule")).alias("seq"),
            F.col(path).alias("file_path"), F.col(line).alias("line"),
            F.lit(severity).alias("severity"), body.alias("body"), F.lit(rule).alias("rule")]


def _line_findings(lines: DataFrame, rule: str, detail: Column | None = None) -> DataFrame:
    return lines.select("review_id", *_finding(rule, "filename", "line_num", detail))


def _node_findings(nodes: DataFrame, rule: str) -> DataFrame:
    return nodes.select("review_id", *_finding(rule, "file_path", "start_line",
                                               F.col("node_name")))


def _gate(rule: str) -> Column:
    _, _, group, flag = RULES[rule]
    if flag is None:
        return F.lit(True)
    if rule == "G8":
        return F.coalesce(F.col(group)[flag] == "snake_case", F.lit(False))
    return F.coalesce(F.col(group)[flag], F.lit(False))


def gate(findings: DataFrame, policies: DataFrame, paths: bool = False) -> DataFrame:
    """Drops findings whose rule the review's policy has off. Only hits are joined.

    A scan looks for every name any policy forbids, so the policy's own list is applied here; with
    ``paths`` its path globs are too. A review without a policy row has the default policy.
    """
    allowed = F.lit(False)
    for rule in RULES:
        allowed = F.when(F.col("rule") == rule, _gate(rule)).otherwise(allowed)
    if "detail" in findings.columns:
        listed = F.array_contains(F.col("security")["forbidden_apis"], F.col("detail"))
        allowed = allowed & ((F.col("rule") != "G1") | listed)
    if paths:
        allowed = allowed & ~F.rlike(F.col("file_path"), F.col("ignore_regex"))
    rules = policies.select("review_id", "security", "performance", "style", "ignore_regex")
    joined = findings.join(rules, "review_id", "left")
    known = {group: F.coalesce(F.col(group), default_group(group).cast(rules.schema[group].dataType))
             for group in ("security", "performance", "style")}
    known["ignore_regex"] = F.coalesce("ignore_regex", default_ignore_regex())
    return (joined.withColumns(known).filter(allowed)
            .drop("security", "performance", "style", "ignore_regex", "detail"))


def with_prev(lines: DataFrame) -> DataFrame:
    """Adds ``prev_content`` where the parser did not: the added line right above, same hunk."""
    if "prev_content" in lines.columns:
        return lines
    above = Window.partitionBy("review_id", "filename", "hunk_no").orderBy("line_num")
    adjacent = F.lag("line_num").over(above) == F.col("line_num") - 1
    return lines.withColumn("prev_content", F.when(adjacent, F.lag("content").over(above)))


#: A list of more names than this is indexed by the last GRAM characters of each, so that a text is
#: searched for the few names whose ends it holds. Shorter names are searched for one by one.
LONG_LIST, GRAM = 64, 5


def _api_index(apis: Column) -> Column:
    """Names by their last GRAM characters, made in the row: sorted entries cut where the end changes."""
    ended = F.array_sort(F.transform(F.filter(apis, lambda a: F.length(a) >= GRAM),
                                     lambda a: F.struct(F.substring(a, -GRAM, GRAM).alias("end"), a.alias("name"))))
    # Each step is bound once through a one-element array, so no lambda recomputes it.
    cut = F.transform(F.array(ended), lambda e: F.struct(e.alias("e"), F.filter(F.transform(
        e, lambda x, i: F.when((i == 0) | (x["end"] != F.get(e, i - 1)["end"]), i)), lambda i: i.isNotNull()).alias("at")))
    return F.map_from_entries(F.flatten(F.transform(cut, lambda c: F.transform(c["at"], lambda p, j: F.struct(
        F.get(c["e"], p)["end"], F.transform(F.slice(
            c["e"], p + 1, F.coalesce(F.get(c["at"], j + 1), F.size(c["e"])) - p), lambda x: x["name"]))))))


def indexed_apis(df: DataFrame) -> DataFrame:
    """Moves the names of a long ``forbidden_apis`` into ``api_index``; short lists have none."""
    apis = F.col("forbidden_apis")
    many = F.size(apis) > LONG_LIST
    rest = [c for c in df.columns if c != "forbidden_apis"]
    return computed(df, rest, forbidden_apis=F.when(many, F.filter(apis, lambda a: F.length(a) < GRAM)).otherwise(apis),
                    api_index=F.when(many, _api_index(apis)))


def _candidates(text: Column, apis: Column, index: Column | None) -> Column:
    """The names that may be in ``text``: those of the list, and of the index those whose end is in it."""
    if index is None:
        return apis
    ends = F.array_intersect(F.map_keys(index), F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    listed = F.flatten(F.transform(ends, lambda g: F.element_at(index, g)))
    return F.when(index.isNull(), apis).otherwise(F.concat(apis, F.coalesce(listed, F.array().cast("array<string>"))))


def _index_of(df: DataFrame) -> Column | None:
    return F.col("api_index") if "api_index" in df.columns else None


def with_apis(lines: DataFrame, policies: DataFrame, stay: bool = False) -> DataFrame:
    """Adds the review's ``forbidden_apis`` and ``api_index`` unless they came along with the files.

    A review without a policy row has the default list. The planner broadcasts the lists where they
    are small and else meets them by review, splitting large reviews. Lists are indexed before they meet.
    With ``stay`` they always meet by review: the planner may else find the lists small when the lines have
    moved, and let one task work on all that one task wrote, however costly what follows is.
    """
    if "forbidden_apis" in lines.columns:
        return lines
    default = default_group("security").cast(policies.schema["security"].dataType)
    apis = indexed_apis(policies.select("review_id", F.col("security")["forbidden_apis"].alias("forbidden_apis")))
    return lines.join(apis.hint("shuffle_hash") if stay else apis, "review_id", "left").withColumn(
        "forbidden_apis", F.coalesce("forbidden_apis", default["forbidden_apis"]))


def _g1(lines: DataFrame, policies: DataFrame) -> DataFrame:
    known = with_apis(lines, policies)
    names = _candidates(F.col("content"), F.col("forbidden_apis"), _index_of(known))
    hits = known.select("*", F.explode(F.filter(names, lambda a: F.col("content").contains(a))).alias("api"))
    return _line_findings(hits, "G1", F.col("api"))


def _g4(lines: DataFrame) -> DataFrame:
    """A query deeper than the nearest loop header above it in its hunk.

    Only loop and query lines matter, so all others are dropped before the exchange.
    """
    content = F.col("content")
    relevant = lines.select("review_id", "filename", "hunk_no", "line_num",
                            indent_of(content).alias("indent"),
                            content.rlike(_P["loop"]).alias("is_loop"),
                            content.rlike(_P["query"]).alias("is_query")).filter(
        "is_loop OR is_query")
    above = (Window.partitionBy("review_id", "filename", "hunk_no").orderBy("line_num")
             .rowsBetween(Window.unboundedPreceding, -1))
    loop = F.last(F.when(F.col("is_loop"), F.col("indent")), ignorenulls=True).over(above)
    hits = relevant.withColumn("loop", loop).filter("is_query AND indent > loop")
    return _line_findings(hits, "G4")


def _node_hits(rule: str) -> Column:
    content, name = F.col("content"), F.col("node_name")
    if rule == "G6":
        return content.rlike(_P["unbounded"]) & ~content.rlike(_P["exit"])
    if rule == "G7":
        return (F.col("node_type").isin("function_definition", "class_definition")
                & ~name.startswith("_") & ~F.col("has_docstring"))
    return (F.col("node_type") == "function_definition") & ~name.rlike(_P["snake_case"])


def _line_hits(rule: str) -> Column:
    content = F.col("content")
    if rule == "G2":
        return is_secret(content)
    if rule == "G3":
        return is_sql_format(content)
    if rule == "G5":
        return is_untimed_call(content)
    return is_dead(content, F.col("prev_content"))


def rule_line(rule: str, lines: DataFrame, policies: DataFrame) -> DataFrame:
    """One line rule (G1-G5, G9) on its own."""
    if rule == "G1":
        found = _g1(lines, policies)
    elif rule == "G4":
        found = _g4(lines)
    else:
        source = with_prev(lines) if rule == "G9" else lines
        found = _line_findings(source.filter(_line_hits(rule)), rule)
    return gate(found, policies)


def rule_node(rule: str, nodes: DataFrame, policies: DataFrame) -> DataFrame:
    """One definition rule (G6-G8) on its own; nodes carry review_id."""
    return gate(_node_findings(nodes.filter(_node_hits(rule)), rule), policies)


def _hit(rule: str, line: Column, detail: Column | None = None) -> Column:
    severity = RULES[rule][0]
    body = _body(rule, line, detail)
    return F.struct(line.alias("line"), F.lit(rule).alias("rule"),
                    F.lit(severity).alias("severity"), body.alias("body"),
                    (F.lit("") if detail is None else detail).alias("detail"))


def _present(hits: list[Column]) -> Column:
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def _hunk_line_hits(hunk: Column) -> Column:
    def hits(x: Column) -> Column:
        line, text, prev = x["line_num"], x["content"], x["prev_content"]
        return _present([F.when(is_secret(text), _hit("G2", line)),
                         F.when(is_sql_format(text), _hit("G3", line)),
                         F.when(is_untimed_call(text), _hit("G5", line)),
                         F.when(is_dead(text, prev), _hit("G9", line))])

    return F.flatten(F.transform(hunk, hits))


def _hunk_api_hits(hunk: Column, apis: Column, index: Column | None) -> Column:
    text = F.array_join(F.transform(hunk, lambda x: x["content"]), "\n")
    # The names are bound once for all lines.
    return F.flatten(F.flatten(F.transform(F.array(_candidates(text, apis, index)), lambda names: F.transform(
        hunk, lambda x: F.transform(F.filter(names, lambda a: x["content"].contains(a)),
                                    lambda a: _hit("G1", x["line_num"], a))))))


def _hunk_loop_hits(hunk: Column) -> Column:
    """G4 within one hunk in linear time: the loop and query lines are cut into stretches, each
    opened by a loop header and reaching to the next one, and a stretch tests its queries."""
    relevant = F.filter(F.transform(hunk, lambda x: F.struct(
        x["line_num"].alias("line"), indent_of(x["content"]).alias("indent"),
        x["content"].rlike(_P["loop"]).alias("loop"),
        x["content"].rlike(_P["query"]).alias("query"))), lambda x: x["loop"] | x["query"])
    # Each step is bound once through a one-element array, so no lambda recomputes it.
    once = F.transform(F.array(relevant), lambda r: F.struct(
        r.alias("r"), F.filter(F.transform(r, lambda x, i: F.when(x["loop"], i)),
                               lambda i: i.isNotNull()).alias("at")))
    stretches = F.flatten(F.transform(once, lambda o: F.transform(o["at"], lambda p, j: F.struct(
        F.get(o["r"], p)["indent"].alias("indent"),
        F.slice(o["r"], p + 2, F.coalesce(F.get(o["at"], j + 1), F.size(o["r"])) - p)
        .alias("below")))))
    return F.flatten(F.transform(stretches, lambda s: F.transform(
        F.filter(s["below"], lambda q: q["query"] & (q["indent"] > s["indent"])),
        lambda q: _hit("G4", q["line"]))))


def _as_findings(hits: DataFrame) -> DataFrame:
    return hits.select("review_id", F.struct("file_path", "line", "rule").alias("seq"),
                       "file_path", "line", "severity", "body", "rule", "detail")


def scan_hunks(hunks: DataFrame) -> DataFrame:
    """All line rules over (review_id, filename, hunk, forbidden_apis): lines stay in their array
    and only hits become rows, so the scan has no exchange. Long lists come with their ``api_index``."""
    found = F.flatten(F.array(_hunk_line_hits(F.col("hunk")),
                              _hunk_api_hits(F.col("hunk"), F.col("forbidden_apis"), _index_of(hunks)),
                              _hunk_loop_hits(F.col("hunk"))))
    return _as_findings(hunks.select("review_id", F.col("filename").alias("file_path"),
                                     F.inline(found)))


def scan_nodes(nodes: DataFrame) -> DataFrame:
    """All definition rules in one pass over nodes that carry review_id."""
    line, name = F.col("start_line"), F.col("node_name")
    hits = _present([F.when(_node_hits(rule), _hit(rule, line, name))
                     for rule in ("G6", "G7", "G8")])
    return _as_findings(nodes.select("review_id", "file_path", F.inline(hits)))


def hunks_of_lines(lines: DataFrame) -> DataFrame:
    """Long lines back to one row per hunk, for tables that no longer have the patch."""
    keys = ["review_id", "filename", "hunk_no"]
    entry = F.struct("line_num", "content", "prev_content")
    extra = [F.first(c).alias(c) for c in ("forbidden_apis", "api_index") if c in lines.columns]
    return with_prev(lines).groupBy(*keys).agg(
        F.array_sort(F.collect_list(entry)).alias("hunk"), *extra)


def rule_scan(source: DataFrame, nodes: DataFrame | None, policies: DataFrame) -> DataFrame:
    """All rules over hunks (``diffs.hunk_table``) or long lines, and over definitions."""
    hunks = source if "hunk" in source.columns else hunks_of_lines(source)
    found = scan_hunks(with_apis(hunks, policies, stay=True))
    if nodes is not None:
        found = found.unionByName(scan_nodes(nodes))
    return gate(found, policies)
