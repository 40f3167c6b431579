"""Registered queries: each runs operators over whole test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import text as tx
from ..functions.hmac import hmac_sha256
from ..functions.vector import cosine_score, l2_normalise, norm
from ..operators import audit as au
from ..operators import comments as cm
from ..operators import diffs as df_
from ..operators import feedback as fb
from ..operators import files as fl
from ..operators import graph as gr
from ..operators import infer as inf
from ..operators import nodes as nd
from ..operators import policy as po
from ..operators import rate as rt
from ..operators import retention as ret
from ..operators import rules as ru
from ..operators import vectors as ve
from ..operators import webhooks as wh
from ..plans import deliveries as pd_
from ..plans import index as pi
from ..plans import review as pr
from ..session import materialise, shared_dir
from ..sources import audit_log as sa
from ..sources import cache as sch
from ..sources import changed_files as sc
from ..sources import index_store as si
from ..sources import outbox as so
from ..streaming import audit as sta
from ..streaming import webhooks as stw
from . import fixtures as fx_

QUERIES: dict = {}

NOW = datetime(2024, 1, 25)
RETENTION_DAYS = 10
SINCE = datetime(2024, 1, 5)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _digest(col: str):
    return F.md5(F.encode(F.col(col), "UTF-8")).alias(col)


# --- diffs -------------------------------------------------------------------------------------
@query
def parse_hunks(spark: SparkSession, sf: str) -> DataFrame:
    return df_.parse_hunks(fx_.diff_files(spark, sf))


@query
def hunks_nested(spark: SparkSession, sf: str) -> DataFrame:
    nested = df_.hunks_nested(df_.parse_hunks(fx_.diff_files(spark, sf)))
    flat = F.flatten("hunks")
    return nested.select("review_id", "filename", F.size("hunks").alias("hunks"),
                         F.array_join(F.transform(flat, lambda x: F.concat_ws(
                             ":", x["line_num"].cast("string"), x["content"])), "\n")
                         .alias("lines")).withColumn("lines", _digest("lines"))


@query
def hunks_flattened(spark: SparkSession, sf: str) -> DataFrame:
    return df_.lines_of_nested(df_.nested_hunks(fx_.diff_files(spark, sf)))


@query
def added_lines_json(spark: SparkSession, sf: str) -> DataFrame:
    shown = df_.added_lines_json(df_.nested_hunks(fx_.diff_files(spark, sf)))
    back = F.from_json("added_lines", f"ARRAY<STRUCT<line_num: INT, content: STRING>>")
    return shown.select("review_id", "filename", F.inline(back))


@query
def diff_stats(spark: SparkSession, sf: str) -> DataFrame:
    return df_.diff_stats(df_.parse_hunks(fx_.diff_files(spark, sf)))


@query
def split_multifile_diff(spark: SparkSession, sf: str) -> DataFrame:
    split = df_.split_multifile_diff(fx_.multifile_diffs(spark, sf))
    return split.select("review_id", "filename", "patch")


# --- files -------------------------------------------------------------------------------------
@query
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return sc.all_changed_files(fx_.provider_responses(spark, sf)).select(
        "review_id", "filename", "status", F.coalesce("patch", F.lit("")).alias("patch"))


@query
def attach_patches(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx_.table(spark, sf, "documents")
    stat = docs.select(fx_.review_of().alias("review_id"), fx_.path_of().alias("filename"))
    labelled = docs.join(fx_.table(spark, sf, "labels"), "doc_id").select(
        fx_.review_of().alias("review_id"), fx_.path_of().alias("filename"),
        F.col("text").alias("patch"))
    return fl.attach_patches(stat, labelled)


@query
def status_and_filename(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx_.table(spark, sf, "documents").join(fx_.table(spark, sf, "labels"), "doc_id", "left")
    word = F.get(F.array(*[F.lit(w) for w in ("added", "removed", "modified", "renamed",
                                              "moved")]), (F.col("doc_id") % 5).cast("int"))
    new = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source"))
    old = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return docs.select("doc_id", fl.normalise_status_word(word).alias("by_word"),
                       fl.normalise_status_flags(F.col("quality") == 1, F.col("toxic") == 1)
                       .alias("by_flag"), fl.pick_filename(new, old).alias("filename"))


@query
def reviewable_files(spark: SparkSession, sf: str) -> DataFrame:
    kept = fl.reviewable_files(fx_.diff_files(spark, sf), fx_.policies(spark, sf))
    return kept.select("review_id", "filename", "status")


@query
def reviewable_files_default(spark: SparkSession, sf: str) -> DataFrame:
    kept = fl.reviewable_files(fx_.diff_files(spark, sf), None, fx.SKIP_EXTENSIONS_SHORT)
    return kept.select("review_id", "filename", "status")


@query
def glob_match(spark: SparkSession, sf: str) -> DataFrame:
    globs = ["*.min.js", "src[0-4]/*", "src?/en/*", "src[!1]*.py", "*/[x", "src1*/fr/*.t[ps]"]
    files = fx_.table(spark, sf, "documents").select(fx_.path_of().alias("path"))
    paired = files.select("path", F.explode(F.array(*[F.lit(g) for g in globs])).alias("pattern"))
    return paired.select("path", "pattern",
                         tx.glob_match(F.col("path"), F.col("pattern")).alias("hit"))


@query
def language_of(spark: SparkSession, sf: str) -> DataFrame:
    path = fx_.path_of()
    return fx_.table(spark, sf, "documents").select(
        path.alias("path"), tx.extension(path).alias("extension"),
        F.coalesce(tx.language_of(path), F.lit("none")).alias("language"))


@query
def code_files(spark: SparkSession, sf: str) -> DataFrame:
    tree = fx_.source_tree(spark, sf)
    memory = fl.code_files(tree, fx.INDEX_EXTENSIONS_MEMORY, 50).withColumn("mode", F.lit("memory"))
    stored = fl.code_files(tree, fx.INDEX_EXTENSIONS_TABLE, 30, 500).withColumn(
        "mode", F.lit("table"))
    return memory.unionByName(stored).select("mode", "repo", "tree_pos", "file_path")


# --- findings ----------------------------------------------------------------------------------
@query
def findings_parse(spark: SparkSession, sf: str) -> DataFrame:
    answers = fx_.answers(spark, sf)
    last = cm.parse_findings(answers, fence="last").withColumn("fence", F.lit("last"))
    first = cm.parse_findings(answers, fence="first").withColumn("fence", F.lit("first"))
    return last.unionByName(first)


@query
def severity_rank(spark: SparkSession, sf: str) -> DataFrame:
    return fx_.comments(spark, sf).groupBy("severity").agg(
        F.max(tx.severity_rank(F.col("severity"))).alias("rank"),
        F.count(F.lit(1)).alias("comments"))


def _short(df: DataFrame) -> DataFrame:
    return df.select("review_id", "seq", "file_path", "line", "severity", _digest("body"))


@query
def dedup_comments(spark: SparkSession, sf: str) -> DataFrame:
    return _short(cm.dedup_comments(fx_.comments(spark, sf)))


@query
def filter_severity(spark: SparkSession, sf: str) -> DataFrame:
    return _short(cm.filter_severity(fx_.comments(spark, sf), fx_.lang_policies(spark, sf)))


@query
def cap_comments(spark: SparkSession, sf: str) -> DataFrame:
    return _short(cm.cap_comments(fx_.comments(spark, sf), fx_.lang_policies(spark, sf)))


@query
def noise_control(spark: SparkSession, sf: str) -> DataFrame:
    return _short(cm.noise_control(fx_.comments(spark, sf), fx_.lang_policies(spark, sf)))


@query
def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx_.comments(spark, sf)
    reviews = fx_.lang_policies(spark, sf)
    return cm.review_summary(raw, cm.noise_control(raw, reviews), reviews)


@query
def last_by_key(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.windows import last_by
    return _short(last_by(fx_.comments(spark, sf), ["review_id", "file_path"], ["seq"]))


@query
def ground_comments(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx_.table(spark, sf, "documents")
    found = docs.select(fx_.review_of().alias("review_id"), F.col("doc_id").alias("seq"),
                        fx_.path_of().alias("file_path"),
                        (F.col("n_chars") % 40).cast("int").alias("line"))
    lines = df_.parse_hunks(fx_.diff_files(spark, sf))
    return cm.ground_comments(found, lines).select("review_id", "seq", "grounded", "reason")


@query
def suppress_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return _short(cm.suppress_repeats(fx_.comments(spark, sf), fx_.posted(spark, sf), fx_.MARKER))


@query
def feedback_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = fb.feedback_stats(fx_.conversations(spark, sf), "tion", fx_.SERVICE)
    return stats.withColumn("previously_flagged_files",
                            F.array_join("previously_flagged_files", ","))


def _outbox(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx_.table(spark, sf, "documents")
    found = docs.select(fx_.review_of().alias("review_id"), F.col("doc_id").alias("seq"),
                        F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("file_path"),
                        F.when(F.col("doc_id") % 13 != 0, (F.col("doc_id") % 50).cast("int"))
                        .alias("line"),
                        F.when(F.col("doc_id") % 17 != 0, F.lit("WARNING")).alias("severity"),
                        F.concat(F.lit("body \""), "lang", F.lit("\"")).alias("body"))
    return so.review_outbox(found, fx_.reviews(spark, sf), fx_.MARKER)


@query
def review_outbox(spark: SparkSession, sf: str) -> DataFrame:
    return _outbox(spark, sf).drop("repo")


@query
def render_comment(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx_.comments(spark, sf)
    text = tx.render_comment(F.col("severity"), F.col("body"), fx_.MARKER)
    return docs.select("seq", F.md5(F.encode(text, "UTF-8")).alias("rendered"), F.md5(F.encode(
        tx.render_fallback(F.col("file_path"), F.col("line"), text), "UTF-8")).alias("fallback"))


@query
def append_description(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    new = tx.append_description(body, F.concat(F.lit("SUMMARY "), "lang"), "tion")
    return fx_.table(spark, sf, "documents").select(
        "doc_id", F.md5(F.encode(new, "UTF-8")).alias("description"),
        F.length(new).alias("size"))


@query
def patch_bundle(spark: SparkSession, sf: str) -> DataFrame:
    files = fx_.table(spark, sf, "documents").select(
        F.col("lang").alias("review_id"), fx_.path_of().alias("filename"),
        F.col("text").alias("patch"), F.col("doc_id").alias("pos"))
    plain = inf.patch_bundle(files).withColumn("style", F.lit("plain"))
    marked = inf.patch_bundle(files, "markdown", fx.FULL_REVIEW_BUDGET).withColumn(
        "style", F.lit("markdown"))
    return plain.unionByName(marked).select("review_id", "style", F.length("bundle").alias("size"),
                                            _digest("bundle"))


# --- policies ----------------------------------------------------------------------------------
@query
def policy_resolve(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda g, n: F.col(g)[n].alias(n)
    return fx_.policies(spark, sf).select(
        "review_id", "repo", "max_comments", "severity_filter", "min_rank",
        F.array_join("ignore_paths", ",").alias("ignore_paths"),
        F.array_join(F.col("security")["forbidden_apis"], ",").alias("forbidden_apis"),
        flag("security", "require_parameterized_queries"),
        flag("security", "flag_hardcoded_secrets"), flag("performance", "flag_n_plus_one"),
        flag("style", "require_docstrings"), flag("style", "naming_convention"),
        flag("style", "flag_dead_code"))


@query
def policy_text(spark: SparkSession, sf: str) -> DataFrame:
    return fx_.policies(spark, sf).select("review_id", po.policy_text().alias("policy_text"))


@query
def policy_category_text(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.explode(F.array(*[F.lit(c) for c in (" Security", "performance", "STYLE ", "all",
                                                   "other")]))
    return fx_.policies(spark, sf).withColumn("category", asked).select(
        "review_id", "category", po.policy_category_text(F.col("category")).alias("answer"))


# --- audit -------------------------------------------------------------------------------------
def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return au.parse_audit(fx_.audit_lines(spark, sf))


@query
def audit_read(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).select(
        "log_pos", F.coalesce(F.unix_micros("ts"), F.lit(-1)).alias("ts_us"),
        F.coalesce("event", F.lit("")).alias("event"),
        F.coalesce(au.data_field("repo"), F.lit("")).alias("repo"),
        F.coalesce(au.pr_number(), F.lit(-1)).alias("pr_number"), "malformed")


@query
def audit_query(spark: SparkSession, sf: str) -> DataFrame:
    hits = au.audit_query(_audit(spark, sf), "purchase", None, SINCE, 100).withColumn(
        "asked", F.lit("purchase since"))
    by_repo = au.audit_query(_audit(spark, sf), "", "org/r7", None, 1000).withColumn(
        "asked", F.lit("repo"))
    return hits.unionByName(by_repo).select("asked", "log_pos")


@query
def audit_stats(spark: SparkSession, sf: str) -> DataFrame:
    return au.audit_stats(_audit(spark, sf)).select(
        F.coalesce("event", F.lit("(total)")).alias("event"), "entries")


@query
def audit_retention(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = au.audit_retention(_audit(spark, sf), NOW, RETENTION_DAYS)
    return kept.select("log_pos", "malformed")


@query
def retention_summary(spark: SparkSession, sf: str) -> DataFrame:
    listing = fx_.events(spark, sf).filter(F.col("ts") < F.lit(NOW)).select(
        F.col("event_id").cast("string").alias("path"))
    return au.retention_summary(_audit(spark, sf), listing, NOW, RETENTION_DAYS)


@query
def review_runs(spark: SparkSession, sf: str) -> DataFrame:
    return au.review_runs(fx_.run_log(spark, sf)).select(
        "task_id", "vcs", "repo", "pr_number", "status",
        F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"), "comments_posted")


@query
def audit_append(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "audit-append")
    sa.audit_append(fx_.run_log(spark, sf), path, "svc")
    return sa.audit_read(spark, path).select(
        F.unix_micros("ts").alias("ts_us"), "event", "actor",
        au.data_field("task_id").alias("task_id"), "malformed")


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """The run log in an order of arrival that SQL can state."""
    log = fx_.run_log(spark, sf)
    return log.orderBy("ts", F.get_json_object("data", "$.task_id"), "event")


@query
def retention_boundary_day(spark: SparkSession, sf: str) -> DataFrame:
    """A log purged in place at noon: entries of each day that is left and of the cut, and the first ones in order."""
    log = shared_dir(spark, "audit-log")
    sa.audit_append(_arrivals(spark, sf), log, "svc")
    gone = sa.retain(spark, log, NOW.replace(hour=12), RETENTION_DAYS)
    left = sa.audit_read(spark, log)
    days = left.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("item")).agg(F.count("*").alias("entries"))
    first = au.audit_query(left, "review_started", None, None, 50).select(
        au.data_field("task_id").alias("item"), F.unix_micros("ts").alias("entries"))
    return days.union(spark.createDataFrame([("purged", gone)], days.schema)).union(first)


@query
def audit_query_after_retention(spark: SparkSession, sf: str) -> DataFrame:
    """The first entries since a day, before and after the log was written anew."""
    since, (log, kept) = datetime(2024, 1, 18), (shared_dir(spark, "audit-log"), shared_dir(spark, "audit-kept"))
    sa.audit_append(_arrivals(spark, sf), log, "svc")
    sa.enforce_retention(spark, log, kept, NOW, RETENTION_DAYS)
    both = [au.audit_query(sa.audit_read(spark, path, since), "review_completed", None, since, 100)
            .select(F.lit(name).alias("log"), F.unix_micros("ts").alias("ts_us"),
                    au.data_field("task_id").alias("task_id"))
            for name, path in (("before", log), ("after", kept))]
    return both[0].unionByName(both[1])


@query
def retention_job(spark: SparkSession, sf: str) -> DataFrame:
    log, kept = shared_dir(spark, "audit-log"), shared_dir(spark, "audit-kept")
    fx_.audit_lines(spark, sf).select("value").write.text(log)
    cache = shared_dir(spark, "cache")
    fx_.table(spark, sf, "region").write.parquet(cache)
    summary, _ = ret.retention_job(spark, log, kept, [cache, cache], NOW, RETENTION_DAYS)
    left = sa.audit_read(spark, kept).agg(F.count(F.lit(1)).alias("purged")).select(
        F.lit("left in the log").alias("storage"), "purged", F.lit("ok").alias("status"))
    return summary.drop("error").unionByName(left)


@query
def cache_manifest(spark: SparkSession, sf: str) -> DataFrame:
    cache = shared_dir(spark, "cache")
    (fx_.table(spark, sf, "events").repartition("event_type").write.partitionBy("event_type")
     .parquet(cache))
    stale = sch.cache_manifest(spark, [cache, cache + "/"], datetime(2100, 1, 1))
    fresh = sch.cache_manifest(spark, [cache], datetime(2000, 1, 1))
    kind = F.regexp_extract("path", "event_type=([^/]+)/.*parquet$", 1)
    both = stale.withColumn("stale", F.lit(True)).unionByName(
        fresh.withColumn("stale", F.lit(False)))
    return (both.select(kind.alias("event_type"), "stale").filter("event_type <> ''")
            .groupBy("event_type", "stale").agg(F.count(F.lit(1)).alias("files")))


# --- webhooks ----------------------------------------------------------------------------------
@query
def signature_verify(spark: SparkSession, sf: str) -> DataFrame:
    return wh.verify_signature(fx_.deliveries(spark, sf), fx_.SECRETS).select(
        "delivery_id", "vcs", "signature_ok")


@query
def hmac_digest(spark: SparkSession, sf: str) -> DataFrame:
    return fx_.table(spark, sf, "documents").select(
        "doc_id", hmac_sha256("k" * 70, F.col("text")).alias("digest"))


@query
def webhook_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return wh.normalise_webhooks(fx_.deliveries(spark, sf), fx_.SERVICE, fx_.SECRETS).select(
        "delivery_id", "vcs", "repo", F.coalesce("pr_number", F.lit(-1)).alias("pr_number"),
        "head_sha", F.coalesce("project_id", F.lit(-1)).alias("project_id"), "comment_body",
        "comment_id", "outcome")


@query
def delivery_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return pd_.gate_deliveries(fx_.deliveries(spark, sf), fx_.SERVICE, fx_.SECRETS,
                               fx_.RATE_MAX, fx_.RATE_WINDOW).select("delivery_id", "vcs",
                                                                     "outcome")


@query
def delivery_audit(spark: SparkSession, sf: str) -> DataFrame:
    normal = wh.normalise_webhooks(fx_.deliveries(spark, sf), fx_.SERVICE, fx_.SECRETS)
    noted = wh.outcome_audit(normal)
    return noted.groupBy("event", F.get_json_object("data", "$.vcs").alias("vcs")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.get_json_object("data", "$.mr_iid").isNotNull()).alias("with_iid"),
        F.count_if(F.get_json_object("data", "$.hook_uuid").isNotNull()).alias("with_hook"))


def _user_requests(spark: SparkSession, sf: str) -> DataFrame:
    return fx_.events(spark, sf).select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"),
        F.col("user_id").cast("string").alias("key"), "ts", "event_id")


@query
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return rt.rate_limit(_user_requests(spark, sf), fx_.RATE_MAX, fx_.RATE_WINDOW).select(
        "event_id", "allowed")


@query
def rate_limit_one_key(spark: SparkSession, sf: str) -> DataFrame:
    everyone = _user_requests(spark, sf).withColumn("key", F.lit("all"))
    return rt.rate_limit(everyone, 100, 3600 * 12).select("event_id", "allowed")


def _landed_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries as a file stream (landed in the shared folder, then read as they come)."""
    path = shared_dir(spark, "deliveries")
    rows = fx_.deliveries(spark, sf)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query
def webhook_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = shared_dir(spark, "webhooks")
    run = stw.webhook_stream(_landed_deliveries(spark, sf), fx_.SERVICE, fx_.SECRETS, out,
                             shared_dir(spark, "cp"), fx_.RATE_MAX, fx_.RATE_WINDOW)
    run.awaitTermination()
    return spark.read.parquet(f"{out}/outcomes").select("delivery_id", "vcs", "outcome")


@query
def webhook_stream_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's audit lines, read back as a log."""
    out = shared_dir(spark, "webhooks")
    run = stw.webhook_stream(_landed_deliveries(spark, sf), fx_.SERVICE, fx_.SECRETS, out,
                             shared_dir(spark, "cp"), fx_.RATE_MAX, fx_.RATE_WINDOW)
    run.awaitTermination()
    return au.audit_stats(sa.audit_read(spark, f"{out}/audit")).select(
        F.coalesce("event", F.lit("(total)")).alias("event"), "entries")


@query
def audit_stream(spark: SparkSession, sf: str) -> DataFrame:
    landed = shared_dir(spark, "audit-rows")
    rows = fx_.run_log(spark, sf)
    rows.write.parquet(landed)
    out, log = shared_dir(spark, "counts"), shared_dir(spark, "log")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(landed)
    sta.audit_append_stream(stream(), log, shared_dir(spark, "cp"), "svc").awaitTermination()
    sta.audit_counts_stream(stream(), out, shared_dir(spark, "cp")).awaitTermination()
    counts = sta.current_counts(spark.read.parquet(out))
    written = (sa.audit_read(spark, log).groupBy("event")
               .agg(F.count(F.lit(1)).alias("written")))
    return counts.join(written, "event").select("event", "entries", "written")


# --- code graph --------------------------------------------------------------------------------
@query
def extract_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nd.extract_nodes(fx_.source_tree(spark, sf)).select(
        "repo", "file_path", "node_type", "node_name", "start_line", "end_line",
        F.array_join("dependencies", ",").alias("dependencies"), "has_docstring",
        F.length("content").alias("size"))


@query
def quarantined_files(spark: SparkSession, sf: str) -> DataFrame:
    return nd.quarantined_files(fx_.source_tree(spark, sf)).select("repo", "file_path")


@query
def modified_nodes(spark: SparkSession, sf: str) -> DataFrame:
    # A file's lines meet once; both steps share that exchange. A file with no line number has no changed definition.
    files = df_.shared_files(fx_.touched(spark, sf))
    reviews = fx_.source_reviews(spark, sf)
    code = nd.changed_code(fx_.source_tree(spark, sf), files, reviews)
    found = nd.modified_nodes(nd.extract_nodes(code), files, reviews)
    return found.select("review_id", "file_path", "node_name", "start_line", "start_added")


@query
def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    return nd.call_edges(nd.extract_nodes(fx_.source_tree(spark, sf)), ("repo",))


@query
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    # Used twice below, and parsing is the costly part.
    nodes = materialise(spark, nd.extract_nodes(fx_.source_tree(spark, sf)), "nodes")
    return nd.graph_nodes(nodes, nd.call_edges(nodes, ("repo",)), ("repo",)).select(
        "graph_id", "name", F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("start_line", F.lit(0)).alias("start_line"),
        F.coalesce("end_line", F.lit(0)).alias("end_line"))


@query
def blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    edges, seeds, _ = fx_.supply_graph(spark, sf)
    nations = edges.filter(F.col("dst").startswith("n_")).select(
        "graph_id", F.col("dst").alias("name"))
    return gr.blast_radius(edges, seeds.unionByName(nations))


@query
def blast_context(spark: SparkSession, sf: str) -> DataFrame:
    edges, seeds, nodes = fx_.supply_graph(spark, sf)
    return gr.blast_context(gr.blast_radius(edges, seeds), nodes, seeds)


# --- vectors -----------------------------------------------------------------------------------
@query
def l2_normalise_vectors(spark: SparkSession, sf: str) -> DataFrame:
    unit = fx_.table(spark, sf, "embeddings").withColumn("unit", l2_normalise(F.col("embedding")))
    return unit.select("vec_id", F.round(norm(F.col("unit")), 6).alias("length"),
                       F.round(F.col("unit")[0], 6).alias("first"),
                       F.round(F.array_max("unit"), 6).alias("largest"))


@query
def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    v = fx_.table(spark, sf, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select(
        "vec_id", F.round(cosine_score(F.col("embedding"), F.col("other")), 6).alias("score"))


@query
def knn(spark: SparkSession, sf: str) -> DataFrame:
    queries, chunks = fx_.vectors(spark, sf)
    return ve.knn(queries, chunks, 5).withColumn("score", F.round("score", 6))


@query
def knn_by_repo(spark: SparkSession, sf: str) -> DataFrame:
    queries, chunks = fx_.vectors(spark, sf)
    return ve.knn(queries, chunks, 3, by="repo").withColumn("score", F.round("score", 6))


@query
def knn_blocked(spark: SparkSession, sf: str) -> DataFrame:
    queries, chunks = fx_.vectors(spark, sf)
    hits = ve.knn(queries, chunks, 5, by="repo", chunk_block=100, query_block=50)
    return hits.withColumn("score", F.round("score", 6))


@query
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    queries, chunks = fx_.vectors(spark, sf)
    return ve.search_text(ve.knn(queries, chunks, fx.SEARCH_K_TOOL, by="repo"), chunks, queries)


@query
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("text")
    return fx_.table(spark, sf, "documents").select(
        "doc_id", F.md5(F.encode(tx.embed_text(body, F.lit("class_definition"), F.col("source")),
                                 "UTF-8")).alias("document"),
        F.md5(F.encode(tx.embed_text(body), "UTF-8")).alias("query"))


@query
def chunk_admit(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx_.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    whole = ve.admit_files(docs, fx.MAX_FILE_CHARS)
    memory = ve.admit_chunks(whole, "memory", fx.MAX_CHUNK_CHARS).withColumn("mode", F.lit("memory"))
    stored = ve.admit_chunks(whole, "table", fx.MAX_CHUNK_CHARS).withColumn("mode", F.lit("table"))
    return memory.unionByName(stored).select("mode", "doc_id", F.length("content").alias("size"))


@query
def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = fx_.table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("node_type"), F.col("source").alias("node_name"),
        F.col("text").alias("content"))
    return ve.embed_chunks(chunks).select(
        "doc_id", F.size("embedding").alias("width"),
        F.round(norm(F.col("embedding")), 4).alias("length"))


@query
def build_index(spark: SparkSession, sf: str) -> DataFrame:
    return pi.build_index(fx_.source_tree(spark, sf)).select(
        "repo", "file_path", "node_name", "node_type", F.length("content").alias("size"),
        F.size("embedding").alias("width"))


@query
def build_index_table(spark: SparkSession, sf: str) -> DataFrame:
    return pi.build_index(fx_.source_tree(spark, sf), "table").select(
        "repo", "file_path", "node_name", "node_type", F.length("content").alias("size"),
        F.size("embedding").alias("width"))


@query
def index_replace(spark: SparkSession, sf: str) -> DataFrame:
    _, chunks = fx_.vectors(spark, sf)
    chunks = chunks.withColumn("intent", F.lit(""))
    path = shared_dir(spark, "index")
    si.index_replace(chunks, path)
    # Every repo is indexed again with its first content line only.
    again = chunks.withColumn("content", F.substring_index("content", "\n", 1))
    deleted = si.index_replace(again, path)
    now = si.read_index(spark, path)
    sizes = now.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"),
                                    F.max(F.length("content")).alias("longest"))
    return sizes.join(deleted, "repo")


@query
def index_size(spark: SparkSession, sf: str) -> DataFrame:
    return ve.index_size(fx_.vectors(spark, sf)[1])


# --- rules and whole reviews -------------------------------------------------------------------
def _code_lines(spark: SparkSession, sf: str) -> DataFrame:
    return df_.parse_hunks(fx_.code_diff_files(spark, sf))


def _changed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions of the generated sources, reviewed under the policies of the nations."""
    nodes = nd.extract_nodes(fx_.source_tree(spark, sf))
    number = F.regexp_extract("repo", r"(\d+)$", 1).cast("int")
    looping = F.concat(F.lit("class X:\n  while True:\n    go("), "node_name", F.lit(")"))
    loops = F.when(F.col("node_type") == "class_definition", looping) \
        .otherwise(F.concat(F.lit("while 1:\n"), "content"))
    return nodes.withColumn("review_id", F.concat(F.lit("r"), number.cast("string"))).withColumn(
        "content", loops)


_SHOWN = ["review_id", "file_path", "line", "severity", "body", "rule"]


def _line_query(rule: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ru.rule_line(rule, _code_lines(spark, sf), fx_.policies(spark, sf)).select(_SHOWN)

    run.__name__ = f"rule_{rule.lower()}"
    return query(run)


def _node_query(rule: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ru.rule_node(rule, _changed_nodes(spark, sf), fx_.policies(spark, sf)).select(_SHOWN)

    run.__name__ = f"rule_{rule.lower()}"
    return query(run)


for _rule in ("G1", "G2", "G3", "G4", "G5", "G9"):
    _line_query(_rule)
for _rule in ("G6", "G7", "G8"):
    _node_query(_rule)


@query
def rule_scan(spark: SparkSession, sf: str) -> DataFrame:
    hunks = df_.hunk_table(fx_.code_diff_files(spark, sf))
    return ru.rule_scan(hunks, _changed_nodes(spark, sf), fx_.policies(spark, sf)).select(_SHOWN)


@query
def secrets_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx_.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "content"))
    return lines.filter(ru.is_secret(F.col("content"))).select("doc_id", "i")


@query
def review_inputs(spark: SparkSession, sf: str) -> DataFrame:
    diffs = df_.added_lines_json(df_.nested_hunks(fx_.diff_files(spark, sf)))
    rules = fx_.policies(spark, sf)
    context = rules.filter("max_comments > 5").select(
        "review_id", F.concat(F.lit("context of "), "repo").alias("context"))
    told = rules.select("review_id", po.policy_text().alias("policy_text"))
    notes = rules.select("review_id", F.concat(F.lit("notes on "), "review_id").alias("summary"))
    made = inf.review_inputs(diffs, context, told, notes)
    return made.select("review_id", "filename", F.coalesce("context", F.lit("")).alias("context"),
                       "summary", F.length("policy_text").alias("policy_size"),
                       (F.length("message") - F.length("added_lines")).alias("frame_size"))


def _flaky(name: str, fails: dict[int, str]):
    def call(prompt: str) -> str:
        message = fails.get(int(prompt) % 4)
        if message:
            raise RuntimeError(message)
        return f" {name} says {prompt}\n"

    return call


@query
def waterfall_infer(spark: SparkSession, sf: str) -> DataFrame:
    prompts = fx_.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.col("doc_id").cast("string").alias("prompt"))
    providers = [("one", _flaky("one", {1: "HTTP 429", 2: "model Not Found", 3: "boom"})),
                 ("two", _flaky("two", {2: "quota used up", 3: "404"}))]
    answered = inf.waterfall_infer(prompts, providers)
    return answered.select(
        "request_id", F.coalesce("provider", F.lit("none")).alias("provider"), "attempt",
        F.coalesce("content", F.lit("")).alias("content"),
        F.array_join(F.transform("errors", lambda e: F.concat_ws("=", e["provider"], e["kind"])),
                     ",").alias("errors"))


@query
def classify_error(spark: SparkSession, sf: str) -> DataFrame:
    return fx_.table(spark, sf, "documents").select(
        "doc_id", tx.classify_error(F.col("text")).alias("kind"))


@query
def grade_route(spark: SparkSession, sf: str) -> DataFrame:
    return fx_.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        tx.grade_done(F.regexp_replace("text", "(?i)qu", "pass"), F.col("turn")).alias("done"))


@query
def split_repo(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "/", "-")) \
        .otherwise(F.regexp_replace("url", "^https?://", ""))
    workspace, slug, valid = tx.split_repo(name)
    return fx_.table(spark, sf, "pages").select(
        "page_id", F.coalesce(workspace, F.lit("")).alias("workspace"),
        F.coalesce(slug, F.lit("")).alias("slug"), valid.alias("valid"))


@query
def review_findings(spark: SparkSession, sf: str) -> DataFrame:
    files = fx_.code_diff_files(spark, sf).drop("doc_id")
    final, _ = pr.review_changes(files, fx_.policies(spark, sf))
    return final.select(_SHOWN)


@query
def review_overview(spark: SparkSession, sf: str) -> DataFrame:
    files = fx_.code_diff_files(spark, sf).drop("doc_id")
    _, summary = pr.review_changes(files, fx_.policies(spark, sf), spool=True)
    return summary


@query
def blast_context_per_review(spark: SparkSession, sf: str) -> DataFrame:
    parts = pr.review_context(fx_.source_tree(spark, sf), fx_.touched(spark, sf), fx_.source_reviews(spark, sf))
    return parts.select("review_id", "filename", "name", F.length("part").alias("size"))


@query
def review_inputs_composed(spark: SparkSession, sf: str) -> DataFrame:
    made = pr.composed_inputs(
        fx_.touched(spark, sf), fx_.source_tree(spark, sf), fx_.source_reviews(spark, sf),
        fx_.source_policies(spark, sf), fx_.source_posted(spark, sf), fx_.MARKER, fx_.SERVICE,
        {"summary_md5": lambda _, summary: F.md5(F.encode(summary, "UTF-8")),
         "policy_size": lambda policy_text, _: F.length(policy_text)})
    return made.select("review_id", "filename", F.length(F.coalesce("context", F.lit(""))).alias("context_size"),
                       F.col("summary_md5").alias("summary"), "policy_size",
                       F.json_array_length("added_lines").alias("lines"))


@query
def review_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers to posted requests, written to the outbox and read back."""
    made = pr.answered_requests(
        fx_.review_answers(spark, sf), fx_.diff_files(spark, sf), fx_.policies(spark, sf),
        fx_.review_posted(spark, sf), fx_.reviews(spark, sf), fx_.MARKER)
    path = shared_dir(spark, "outbox")
    so.write_outbox(made, path)
    return spark.read.schema(made.schema).json(path).select(
        "review_id", F.col("seq.seq").alias("doc_id"), F.col("seq.pos").alias("pos"), "vcs", "pr_number",
        _digest("fallback"), "sendable")
