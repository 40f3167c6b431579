"""Constants, patterns, word lists and text formats that results must equal."""

# --- fixed values: severities -------------------------------------------------------------
SEVERITY_RANK = {"BLOCKER": 3, "WARNING": 2, "INFO": 1}
DEFAULT_SEVERITY = "INFO"
DEFAULT_RANK = 1

# --- fixed values: file selection ---------------------------------------------------------
REVIEWED_STATUSES = ["modified", "added"]
SKIP_EXTENSIONS_SHORT = [".lock", ".bin", ".png", ".jpg", ".svg", ".ico", ".woff", ".ttf"]
SKIP_EXTENSIONS = [".lock", ".bin", ".png", ".jpg", ".jpeg", ".svg", ".ico", ".woff", ".ttf",
                   ".gif", ".webp"]
LANGUAGE_BY_EXTENSION = {"py": "python", "js": "javascript", "ts": "typescript"}
INDEX_EXTENSIONS_MEMORY = ["py", "js", "ts"]
INDEX_EXTENSIONS_TABLE = ["py", "js", "ts", "jsx", "tsx"]
STATUS_BY_PROVIDER_WORD = {"added": "added", "removed": "deleted", "modified": "modified",
                           "renamed": "modified"}

# --- fixed values: diff syntax ------------------------------------------------------------
HUNK_HEADER = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
FILE_HEADER = "diff --git"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"

# --- fixed values: default policy ---------------------------------------------------------
DEFAULT_POLICY = {
    "max_comments": 15,
    "severity_filter": "INFO",
    "ignore_paths": ["*.lock", "*.min.js", "*.generated.*", "migrations/*"],
    "security": {
        "forbidden_apis": ["eval(", "exec(", "os.system(", "__import__(", "pickle.loads("],
        "require_parameterized_queries": True,
        "flag_hardcoded_secrets": True,
    },
    "performance": {
        "flag_n_plus_one": True,
        "require_timeouts_on_network_calls": True,
        "flag_unbounded_loops": True,
    },
    "style": {
        "require_docstrings": True,
        "naming_convention": "snake_case",
        "flag_dead_code": True,
    },
}

# --- fixed values: policy wording ---------------------------------------------------------
POLICY_LINE_FORBIDDEN = "FORBIDDEN APIs (flag as BLOCKER): "
POLICY_LINES = {
    "require_parameterized_queries":
        "All SQL queries MUST use parameterized execution (no string formatting).",
    "flag_hardcoded_secrets":
        "Flag any hardcoded API keys, passwords, tokens, or secrets as BLOCKER.",
    "flag_n_plus_one": "Flag N+1 query patterns (DB calls inside loops) as WARNING.",
    "require_timeouts_on_network_calls": "All HTTP/network calls MUST have explicit timeouts.",
    "flag_unbounded_loops": "Flag unbounded loops without exit conditions as WARNING.",
    "require_docstrings": "All public functions should have docstrings (INFO severity).",
    "flag_dead_code": "Flag unreachable/dead code as INFO.",
}
POLICY_EMPTY = "No specific policy rules configured."
POLICY_SECURITY_EMPTY = "No specific security rules configured."
POLICY_UNKNOWN = "Unknown policy category: %s. Use 'security', 'performance', 'style', or 'all'."

# --- fixed values: webhook gates ----------------------------------------------------------
GITHUB_EVENTS = ["pull_request", "issue_comment"]
GITHUB_ACTIONS = ["opened", "synchronize", "reopened"]
GITLAB_EVENT = "Merge Request Hook"
GITLAB_ACTIONS = ["open", "update", "reopen"]
BITBUCKET_EVENTS = ["pullrequest:created", "pullrequest:updated"]
COMMANDS = ["/review", "/ask"]
BOT_TAG = "[bot]"
RATE_LIMIT_REQUESTS = 100
RATE_LIMIT_WINDOW_SECONDS = 3600

# --- fixed values: budgets ----------------------------------------------------------------
DEDUP_PREFIX_CHARS = 50
MAX_FILE_CHARS = 50000
MIN_CHUNK_CHARS = 100
MAX_CHUNK_CHARS = 3000
EMBED_WIDTH = 384
SEARCH_K = 5
SEARCH_K_TOOL = 3
SEARCH_TEXT_CHARS = 500
DESCRIPTION_BUDGET = 8000
FULL_REVIEW_BUDGET = 12000
MAX_REFINE_ROUNDS = 3
BLAST_DEPTH = 2
DEPENDENCY = "Dependency: "

# --- fixed values: text joiners -----------------------------------------------------------
BLOCK_SEPARATOR = "\n\n---\n\n"
