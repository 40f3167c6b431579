"""Domain inputs derived from the test tables by expressions both engines can state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import computed
from ..session import configure

MARKER = "Automated Review"
SERVICE = "reviewbot"
SECRETS = {"github": "hook-secret", "gitlab": "shared-token"}
RATE_MAX, RATE_WINDOW = 2, 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def review_of(doc_id: str = "doc_id") -> Column:
    return F.concat(F.lit("r"), F.expr(f"{doc_id} div 10").cast("string"))


def path_of() -> Column:
    ext = F.element_at(F.array(*[F.lit(e) for e in (".py", ".js", ".ts", ".lock", ".png",
                                                    ".min.js")]),
                       (F.col("doc_id") % 6 + 1).cast("int"))
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext))


def status_of() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ("added", "modified", "modified", "renamed",
                                                     "deleted")]),
                        (F.col("doc_id") % 5 + 1).cast("int"))


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One changed file per document: its lines become -, + and context lines in 20-line hunks."""
    mark = F.array(F.lit("-"), F.lit("+"), F.lit(" "))

    def line(text: Column, i: Column) -> Column:
        header = F.concat(F.lit("@@ -1,20 +"), (F.floor(i / 20) * 100 + 1).cast("string"),
                          F.lit(",20 @@\n"))
        return F.concat(F.when(i % 20 == 0, header).otherwise(F.lit("")), F.get(mark, i % 3), text)

    patch = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    docs = table(spark, sf_dir, "documents").withColumns(
        {"review_id": review_of(), "filename": path_of(), "status": status_of()})
    return computed(docs, ["review_id", "filename", "status"], patch=patch)


# Line i of document d becomes template (d + i) mod 16; {d} and {i} are filled in.
CODE_TEMPLATES = [
    "for item in items_{d}:",
    "    row = db.execute(query_{i})",
    "    total = total + row",
    "value = eval(expr_{i})",
    'password = "hunter2-{d}-{i}"',
    'cur.run("SELECT * FROM t WHERE id = " + key_{i})',
    "resp = requests.get(url_{d})",
    "resp = requests.get(url_{d}, timeout=5)",
    "    return total",
    "    print(total)",
    "",
    "raise ValueError(key_{i})",
    "cleanup(key_{d})",
    "os.system(cmd_{i})",
    None,  # the document's own line
    'key = "sk-abcdefgh{d}"',
]


def code_diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of code-like lines, one file per document: every fifth line is context, 30 per hunk."""
    def content(text: Column, i: Column) -> Column:
        slot, filled = (F.col("doc_id") + i) % 16, text
        for number, template in enumerate(CODE_TEMPLATES):
            if template is not None:
                made = F.replace(F.replace(F.lit(template), F.lit("{d}"),
                                           F.col("doc_id").cast("string")),
                                 F.lit("{i}"), i.cast("string"))
                filled = F.when(slot == number, made).otherwise(filled)
        return filled

    def line(text: Column, i: Column) -> Column:
        header = F.concat(F.lit("@@ -1,30 +"), (F.floor(i / 30) * 100 + 1).cast("string"),
                          F.lit(",30 @@ def f\n"))
        return F.concat(F.when(i % 30 == 0, header).otherwise(F.lit("")),
                        F.when(i % 5 == 4, F.lit(" ")).otherwise(F.lit("+")), content(text, i))

    patch = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    docs = table(spark, sf_dir, "documents").withColumns(
        {"review_id": review_of(), "filename": path_of(), "status": status_of()})
    return computed(docs, ["doc_id", "review_id", "filename", "status"], patch=patch)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per ten documents; its repo is one of 25."""
    number = F.expr("doc_id div 10")
    return table(spark, sf_dir, "documents").select(number.alias("n")).distinct().select(
        F.concat(F.lit("r"), F.col("n").cast("string")).alias("review_id"),
        F.concat(F.lit("org/n"), (F.col("n") % 25).cast("string")).alias("repo"),
        F.element_at(F.array(F.lit("github"), F.lit("gitlab"), F.lit("bitbucket")),
                     (F.col("n") % 3 + 1).cast("int")).alias("vcs"),
        F.col("n").alias("pr_number"), F.md5(F.col("n").cast("string")).alias("head_sha"))


OVERRIDES = [
    None,
    '{"max_comments_per_pr": 3, "severity_filter": "warning"}',
    '{"security": {"forbidden_apis": ["eval("]}, "max_comments_per_pr": "7"}',
    '{"style": {"naming_convention": "camelCase"}, "ignore_paths": ["*.js", "src[1-4]/*"]}',
]


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy overrides for three of four nations."""
    config = F.get(F.array(*[F.lit(o) for o in OVERRIDES]), F.col("n_nationkey") % 4)
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("org/n"), F.col("n_nationkey").cast("string")).alias("repo"),
        config.alias("config")).filter(F.col("config").isNotNull())


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.policy import policy_resolve
    return policy_resolve(reviews(spark, sf_dir), overrides(spark, sf_dir))


SEVERITIES = ("BLOCKER", "WARNING", "INFO", "note")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per document; a review is a language, so one review holds most rows."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("review_id"), F.col("doc_id").alias("seq"),
        F.col("source").alias("file_path"), (F.col("doc_id") % 50).cast("int").alias("line"),
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]),
                     (F.col("doc_id") % 4 + 1).cast("int")).alias("severity"),
        F.col("text").alias("body"))


def lang_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("review_id")
    return (table(spark, sf_dir, "documents").select(F.col("lang").alias("review_id")).distinct()
            .withColumn("min_rank", F.when(lang == "en", 2).when(lang == "fr", 3).otherwise(1))
            .withColumn("max_comments", F.when(lang == "en", 40).when(lang == "fr", 5)
                        .otherwise(1500)))


def posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier comments: some rendered findings, some foreign texts, every fourth one answered."""
    from ..functions.text import render_comment
    own = render_comment(F.col("severity"), F.col("body"), MARKER)
    return comments(spark, sf_dir).select(
        "review_id", F.col("seq").alias("comment_id"), F.col("file_path").alias("path"),
        F.when(F.length("body") % 3 == 0, own).otherwise(F.col("body")).alias("body"),
        F.when(F.col("seq") % 4 == 0, F.col("seq") + 1).alias("in_reply_to_id"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("review_id"),
        F.col("turn").alias("comment_id"), F.col("role").alias("path"),
        F.col("text").alias("body"), (F.col("turn") % 3).alias("in_reply_to_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int")))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook deliveries of three providers, some broken, ignored, unsigned or by a bot."""
    from ..functions.hmac import hmac_sha256
    e = events(spark, sf_dir)
    kind, vcs_no = F.col("event_type"), F.col("event_id") % 3
    repo = F.concat(F.lit("org/r"), F.col("user_id").cast("string"))
    sha = F.md5(F.col("event_id").cast("string"))
    number = F.col("event_id") % 50
    text = F.get(F.array(F.lit("please /Review this"), F.lit("/ask why"), F.lit("thanks")),
                 F.col("k") % 3)
    login = F.when(F.col("k") % 5 == 0, "Helper[bot]").when(F.col("k") % 7 == 0, "ReviewBot-1") \
        .otherwise("dev")
    gh_event = F.when(kind == "signup", "issue_comment").when(kind == "error", "push") \
        .otherwise("pull_request")
    gh_action = F.when(kind == "signup", "created").when(kind == "view", "opened") \
        .when(kind == "click", "synchronize").otherwise("labeled")
    gh_body = F.to_json(F.struct(
        gh_action.alias("action"), number.alias("number"),
        F.struct(repo.alias("full_name")).alias("repository"),
        F.struct(F.struct(sha.alias("sha")).alias("head")).alias("pull_request"),
        F.struct(number.alias("number")).alias("issue"),
        F.struct(text.alias("body"), F.col("event_id").alias("id")).alias("comment"),
        F.struct(login.alias("login")).alias("sender")))
    gl_event = F.when(kind == "error", "Push Hook").otherwise("Merge Request Hook")
    gl_action = F.when(kind == "view", "open").when(kind == "click", "update") \
        .when(kind == "signup", "reopen").otherwise("close")
    gl_body = F.to_json(F.struct(
        F.struct(gl_action.alias("action"), number.alias("iid"),
                 F.struct(sha.alias("id")).alias("last_commit")).alias("object_attributes"),
        F.struct(F.col("user_id").alias("id"), repo.alias("path_with_namespace"))
        .alias("project")))
    bb_event = F.when(kind == "error", "repo:push").when(kind == "view", "pullrequest:created") \
        .otherwise("pullrequest:updated")
    bb_body = F.to_json(F.struct(
        F.struct(number.alias("id"), F.struct(F.struct(sha.alias("hash")).alias("commit"))
                 .alias("source")).alias("pullrequest"),
        F.struct(repo.alias("full_name")).alias("repository")))
    vcs = F.get(F.array(F.lit("github"), F.lit("gitlab"), F.lit("bitbucket")), vcs_no.cast("int"))
    body = F.when(F.col("event_id") % 101 == 0, F.lit("{broken")) \
        .when(vcs_no == 0, gh_body).when(vcs_no == 1, gl_body).otherwise(bb_body)
    e = computed(e, ["event_id", "event_type", "user_id", "ts"], vcs=vcs,
                 event=F.when(vcs_no == 0, gh_event).when(vcs_no == 1, gl_event)
                 .otherwise(bb_event), body=body)
    signed = F.when(F.col("vcs") == "github", F.concat(
        F.lit("sha256="), hmac_sha256(SECRETS["github"], F.col("body")))) \
        .otherwise(F.lit(SECRETS["gitlab"]))
    signature = F.when(F.col("event_id") % 10 == 0, "sha256=forged") \
        .when(F.col("event_id") % 37 == 0, F.lit(None).cast("string")).otherwise(signed)
    return e.select(F.col("event_id").cast("string").alias("delivery_id"), "vcs", "event",
                    signature.alias("signature"), "body", F.col("ts").alias("received_at"))




def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log lines with their position: some broken, some without time or with a naive one."""
    e = events(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = F.when(F.col("event_id") % 2 == 0, F.concat(stamp, F.lit("+00:00"))).otherwise(stamp)
    stamp = F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("string")) \
        .when(F.col("event_id") % 17 == 0, "yesterday").otherwise(stamp)
    event = F.when(F.col("event_id") % 19 != 0, F.col("event_type"))
    data = F.struct(F.concat(F.lit("org/r"), F.col("user_id").cast("string")).alias("repo"),
                    F.when(F.col("event_id") % 3 == 1, F.col("k")).alias("mr_iid"),
                    F.when(F.col("event_id") % 3 != 1, F.col("k")).alias("pr_number"))
    line = F.to_json(F.struct(stamp.alias("ts"), event.alias("event"),
                              F.lit("svc").alias("actor"), data.alias("data")))
    line = F.when(F.col("event_id") % 97 == 0, F.concat(F.left(line, F.length(line) - 3))) \
        .when(F.col("event_id") % 89 == 0, F.lit("   ")).otherwise(F.concat(line, F.lit(" ")))
    return computed(e.withColumn("log_pos", F.col("event_id")), ["log_pos"], value=line)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries of review tasks: two events make one task, the second one ends it."""
    e = events(spark, sf_dir)
    task = F.expr("event_id div 2")
    ending = F.when(F.col("user_id") % 4 == 0, "review_task_failed") \
        .when(F.col("user_id") % 4 == 1, "review_task_succeeded").otherwise("review_completed")
    name = F.when(F.col("event_id") % 2 == 0, "review_started").otherwise(ending)
    done = name == "review_completed"
    vcs = F.get(F.array(F.lit("github"), F.lit("gitlab"), F.lit("bitbucket")),
                (task % 3).cast("int"))
    data = F.to_json(F.struct(
        F.concat(F.lit("t"), task.cast("string")).alias("task_id"), vcs.alias("vcs"),
        F.concat(F.lit("org/r"), (task % 40).cast("string")).alias("repo"),
        F.when(vcs == "gitlab", task).alias("mr_iid"),
        F.when(vcs != "gitlab", task).alias("pr_number"),
        F.when(name == "review_task_succeeded", F.col("k"))
        .when(done, F.lit(0)).alias("comments_posted"),
        F.when(done, F.col("k") * 10).alias("duration_ms")))
    return e.select("ts", name.alias("event"), data.alias("data"))


def provider_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed responses, one per review (ten documents); labels say what happened to a file."""
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.expr("doc_id div 10")
    word = F.when(F.col("toxic") == 1, "removed").when(F.col("quality") == 1, "added") \
        .when(F.col("quality") == 0, "modified").otherwise("renamed")
    old = F.concat(F.lit("old/"), path_of())
    new = F.when(F.col("toxic") == 1, F.lit("")).otherwise(path_of())
    has_diff = F.col("doc_id") % 7 != 0
    rows = docs.select(
        n.alias("n"), "doc_id",
        F.struct(path_of().alias("filename"), word.alias("status"),
                 F.when(has_diff, F.col("text")).alias("patch")).alias("gh"),
        F.struct(new.alias("new_path"), old.alias("old_path"), F.col("text").alias("diff"),
                 (F.col("quality") == 1).alias("new_file"),
                 (F.col("toxic") == 1).alias("deleted_file")).alias("gl"),
        F.struct(F.struct(path_of().alias("path")).alias("new"),
                 F.struct(old.alias("path")).alias("old"), word.alias("status")).alias("bb"),
        F.when(has_diff, F.concat(F.lit("diff --git a/x b/"), path_of(), F.lit("\n"), "text",
                                  F.lit("\n"))).alias("section"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("doc_id", c))),
                                   lambda s: s[c])
    grouped = rows.groupBy("n").agg(listed("gh").alias("gh"), listed("gl").alias("gl"),
                                    listed("bb").alias("bb"), listed("section").alias("sections"))
    v = F.col("n") % 3
    payload = F.when(v == 0, F.to_json("gh")) \
        .when(v == 1, F.to_json(F.struct(F.col("gl").alias("changes")))) \
        .otherwise(F.to_json(F.struct(F.col("bb").alias("values"))))
    return grouped.select(
        F.concat(F.lit("r"), F.col("n").cast("string")).alias("review_id"),
        F.get(F.array(F.lit("github"), F.lit("gitlab"), F.lit("bitbucket")), v.cast("int"))
        .alias("vcs"), payload.alias("payload"), F.array_join("sections", "").alias("diff"))


def multifile_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents per diff in four file names, so the last section overrides the first."""
    section = F.concat(F.lit("diff --git a/x b/f"), (F.col("doc_id") % 5 % 4).cast("string"),
                       F.lit(".py\n"), "text", F.lit("\n"))
    grouped = table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 5").alias("n"), "doc_id", section.alias("section")).groupBy("n").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "section"))).alias("s"))
    return grouped.select(
        F.concat(F.lit("r"), F.col("n").cast("string")).alias("review_id"),
        F.concat(F.lit("preamble\n"), F.array_join(
            F.transform("s", lambda x: x["section"]), "")).alias("diff"))


ANSWER_KINDS = 6


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in six shapes, one per document."""
    item = F.to_json(F.struct(F.col("source").alias("file_path"), F.col("n_chars").alias("line"),
                              F.lit("INFO").alias("severity"), F.col("lang").alias("body")))
    other = F.to_json(F.struct(F.col("source").alias("file_path"), F.lit("12").alias("line"),
                               F.lit("BLOCKER").alias("severity"),
                               F.col("doc_id").cast("string").alias("body")))
    fence = F.lit("```")
    shapes = [
        F.concat(F.lit("Here:\n"), fence, F.lit("json\n["), item, F.lit("]\n"), fence,
                 F.lit("\nDone.")),
        F.concat(F.lit("["), item, F.lit(","), other, F.lit("]")),
        F.concat(F.lit('{"comments": ['), other, F.lit("]}")),
        F.concat(fence, F.lit("\n["), other, F.lit(", "), item, F.lit("]\n"), fence),
        F.concat(F.lit("not json "), item),
        item,
    ]
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.get(F.array(*shapes), (F.col("doc_id") % ANSWER_KINDS).cast("int"))
        .alias("content"))


def review_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fenced answer per document with two findings on its file, one of them on the first line."""
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("doc_id") % 4 + 1).cast("int"))
    found = F.array(
        F.struct(path_of().alias("file_path"), (F.col("n_chars") % 40).cast("int").alias("line"),
                 severity.alias("severity"), F.col("source").alias("body")),
        F.struct(path_of().alias("file_path"), F.lit(1).alias("line"), F.lit("INFO").alias("severity"),
                 F.lit("same").alias("body")))
    return table(spark, sf_dir, "documents").select(
        review_of().alias("review_id"), F.col("doc_id").alias("seq"),
        F.concat(F.lit("Found:\n```json\n"), F.to_json(found), F.lit("\n```")).alias("content"))


def review_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier comments on each file: every fourth one is a finding of the answers, half of these answered."""
    from ..functions.text import render_comment
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("doc_id") % 4 + 1).cast("int"))
    own = render_comment(severity, F.col("source"), MARKER)
    return table(spark, sf_dir, "documents").select(
        review_of().alias("review_id"), F.col("doc_id").alias("comment_id"), path_of().alias("path"),
        F.when(F.col("doc_id") % 4 == 1, own).otherwise(F.col("source")).alias("body"),
        F.when(F.col("doc_id") % 8 == 1, F.col("doc_id")).alias("in_reply_to_id"))


def source_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of the reviews of the generated sources, by the number of the brand."""
    from ..operators.policy import policy_resolve
    number = F.regexp_extract("repo", r"(\d+)$", 1).cast("int")
    rows = source_reviews(spark, sf_dir)
    configs = rows.select("repo", F.get(F.array(*[F.lit(o) for o in OVERRIDES]), number % 4).alias("config"))
    return policy_resolve(rows, configs.filter(F.col("config").isNotNull()))


def source_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier comments on the generated sources, one per part of a large size."""
    part = table(spark, sf_dir, "part").filter("p_size > 25")
    return part.select(
        F.concat(F.lit("rv-"), "p_brand").alias("review_id"), F.col("p_partkey").alias("comment_id"),
        F.concat(F.lit("pkg/m"), F.col("p_partkey").cast("string")).alias("path"),
        F.when(F.col("p_partkey") % 2 == 0, MARKER).otherwise("other").alias("body"),
        (F.col("p_partkey") % 3).alias("in_reply_to_id"))


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated source file per part, in the repo of its brand; it calls its suppliers."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # Dealt by part once: distinct pairs, lists and the join with parts are all satisfied by it.
    calls = (table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey").distinct()
             .groupBy("l_partkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("supps")))
    k = F.col("p_partkey").cast("string")
    lines = F.concat(
        F.array(F.lit("import db"), F.lit(""), F.lit(""),
                F.concat(F.lit("def p_"), k, F.lit("(x):"))),
        F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit('    """Dôc."""')))
        .otherwise(F.array().cast("array<string>")),
        F.transform(F.coalesce("supps", F.array().cast("array<bigint>")),
                    lambda s: F.concat(F.lit("    s_"), s.cast("string"), F.lit("(x)"))),
        F.array(F.lit("    return x"), F.lit(""), F.lit(""),
                F.concat(F.lit("class C_"), k, F.lit(":")),
                F.lit("    def Run(self):"),
                F.concat(F.lit("        return p_"), k, F.lit("(self.db.get(1))"))))
    broken = F.col("p_partkey") % 50 == 49
    content = F.when(broken, F.lit("def broken(:\n")).otherwise(F.array_join(lines, "\n"))
    ext = F.when(F.col("p_partkey") % 20 == 18, ".txt").otherwise(".py")
    # The text is made once, also where a filter asks for its length.
    made = computed(part.join(calls, F.col("p_partkey") == F.col("l_partkey"), "left").withColumns({
        "repo": F.concat(F.lit("org/"), "p_brand"), "tree_pos": F.col("p_partkey").cast("int"),
        "file_path": F.concat(F.lit("pkg/m"), k, ext)}), ["repo", "tree_pos", "file_path"], ref=F.lit("main"), content=content)
    return made.select("repo", "ref", "tree_pos", "file_path", F.lit("blob").alias("kind"),
                       F.length("content").cast("bigint").alias("size"), "content")


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines in the generated sources, placed by order key."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ext = F.when(F.col("p_partkey") % 20 == 18, ".txt").otherwise(".py")
    return (table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.concat(F.lit("rv-"), "p_brand").alias("review_id"),
                    F.concat(F.lit("pkg/m"), F.col("p_partkey").cast("string"), ext)
                    .alias("filename"), F.lit(1).alias("hunk_no"),
                    (F.col("l_orderkey") % 7 * 9 + 1).cast("int").alias("line_num"),
                    F.lit("x").alias("content")))


def source_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand").distinct().select(
        F.concat(F.lit("rv-"), "p_brand").alias("review_id"),
        F.concat(F.lit("org/"), "p_brand").alias("repo"), F.lit("main").alias("ref"))


def supply_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, seeds, nodes) per brand: part calls supplier calls nation; parts are the seeds."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    # Dealt by part once: distinct pairs and both joins with parts are satisfied by it.
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey")
    of_part = F.col("l_partkey") == F.col("p_partkey")
    graph = F.col("p_brand").alias("graph_id")
    first = computed(lines.distinct().join(part, of_part).select(graph, "p_partkey", "l_suppkey"), ["graph_id"],
                     src=name("p_", "p_partkey"), dst=name("s_", "l_suppkey"))
    # Names above are computed values and this join is null-safe: no filter sinks below the exchange, which all share.
    used = lines.join(part, of_part).select("p_brand", "l_suppkey").distinct().join(
        supp.filter("s_suppkey IS NOT NULL"), F.col("l_suppkey").eqNullSafe(F.col("s_suppkey")))
    second = used.select(graph, name("s_", "s_suppkey").alias("src"),
                         name("n_", "s_nationkey").alias("dst"))
    edges = first.unionByName(second.distinct()).withColumn("type", F.lit("CALLS"))
    seeds = part.select(graph, name("p_", "p_partkey").alias("name"))
    nodes = used.select(graph, name("s_", "s_suppkey").alias("name"),
                        F.col("s_name").alias("content"))
    return edges, seeds, nodes


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, chunks): every embedding is both; the label is the repo."""
    v = table(spark, sf_dir, "embeddings")
    repo = F.concat(F.lit("org/l"), F.col("label").cast("string")).alias("repo")
    queries = v.select(F.col("vec_id").alias("query_id"), repo, "embedding")
    ident = F.col("vec_id").cast("string")
    chunks = v.select(F.col("vec_id").alias("chunk_id"), repo, "embedding",
                      F.concat(F.lit("src/"), ident, F.lit(".py")).alias("file_path"),
                      F.lit("function_definition").alias("node_type"),
                      F.concat(F.lit("f_"), ident).alias("node_name"),
                      F.repeat(F.concat(F.lit("line "), ident, F.lit("\n")), 80).alias("content"))
    return queries, chunks
