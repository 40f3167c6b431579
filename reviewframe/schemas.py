"""Record schemas at operator boundaries, declared once and never inferred."""

DELIVERY = ("delivery_id STRING, vcs STRING, event STRING, signature STRING, body STRING, "
            "received_at TIMESTAMP")
REQUEST = ("review_id STRING, vcs STRING, repo STRING, pr_number BIGINT, head_sha STRING, "
           "project_id BIGINT, comment_body STRING, comment_id STRING, received_at TIMESTAMP")
FILE = "review_id STRING, filename STRING, status STRING, patch STRING"
ADDED_LINE = "STRUCT<line_num: INT, content: STRING>"
LINE = "review_id STRING, filename STRING, hunk_no INT, line_num INT, content STRING"
CODE_FILE = ("repo STRING, ref STRING, tree_pos INT, file_path STRING, kind STRING, size BIGINT, "
             "content STRING")
NODE = ("repo STRING, ref STRING, file_path STRING, node_type STRING, node_name STRING, "
        "content STRING, start_line INT, end_line INT, dependencies ARRAY<STRING>, "
        "has_docstring BOOLEAN")
EDGE = "graph_id STRING, src STRING, dst STRING, type STRING"
CHUNK = ("repo STRING, chunk_id BIGINT, file_path STRING, node_name STRING, node_type STRING, "
         "content STRING, intent STRING, embedding ARRAY<FLOAT>")
POLICY_OVERRIDE = "repo STRING, config STRING"
POLICY_CONFIG = ("max_comments_per_pr INT, max_comments INT, severity_filter STRING, "
                 "ignore_paths ARRAY<STRING>, "
                 "security STRUCT<forbidden_apis: ARRAY<STRING>, "
                 "require_parameterized_queries: BOOLEAN, flag_hardcoded_secrets: BOOLEAN>, "
                 "performance STRUCT<flag_n_plus_one: BOOLEAN, "
                 "require_timeouts_on_network_calls: BOOLEAN, flag_unbounded_loops: BOOLEAN>, "
                 "style STRUCT<require_docstrings: BOOLEAN, naming_convention: STRING, "
                 "flag_dead_code: BOOLEAN>")
# ``line`` is read as text: one string-typed line number would otherwise null its whole record.
RAW_FINDING = "ARRAY<STRUCT<file_path: STRING, line: STRING, severity: STRING, body: STRING>>"
FINDING = "review_id STRING, seq BIGINT, file_path STRING, line INT, severity STRING, body STRING"
POSTED = ("review_id STRING, comment_id BIGINT, path STRING, body STRING, in_reply_to_id BIGINT")
AUDIT = "ts TIMESTAMP, event STRING, actor STRING, data STRING, raw STRING, malformed BOOLEAN"
RATE_REQUEST = "request_id STRING, key STRING, ts TIMESTAMP"
GITLAB_CHANGES = ("changes ARRAY<STRUCT<new_path: STRING, old_path: STRING, diff: STRING, "
                  "new_file: BOOLEAN, deleted_file: BOOLEAN>>")
GITHUB_FILES = "ARRAY<STRUCT<filename: STRING, status: STRING, patch: STRING>>"
BITBUCKET_DIFFSTAT = ("values ARRAY<STRUCT<new: STRUCT<path: STRING>, old: STRUCT<path: STRING>, "
                      "status: STRING>>")
