"""SQL that recomputes the registered queries from the base tables by another route."""

from __future__ import annotations

from .. import fixed_values as fx
from ..operators.rules import RULE_PATTERNS
from . import fixtures as fx_

ORACLES: dict[str, str] = {}
P = RULE_PATTERNS
M = fx_.MARKER


def q(text: str) -> str:
    """A SQL string literal; line breaks are spelled out so the text stays one line."""
    parts = ["'" + part.replace("'", "''") + "'" for part in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def values_case(column: str, values: list, cast: str = "") -> str:
    arms = " ".join(f"WHEN {i} THEN {q(v) if isinstance(v, str) else v}"
                    for i, v in enumerate(values) if v is not None)
    return f"(CASE {column} {arms} END){cast}"


EXT = values_case("doc_id % 6", [".py", ".js", ".ts", ".lock", ".png", ".min.js"])
STATUS = values_case("doc_id % 5", ["added", "modified", "modified", "renamed", "deleted"])
PATH = f"(source || '/' || lang || '/' || doc_id || {EXT})"
REVIEW = "('r' || (doc_id // 10))"

# Every line of every document, then the added ones of the 20-line fixture with their numbers:
# removed lines (i % 3 = 0) take no number.
LINES = """
src AS (SELECT *, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, lang, source, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i
      FROM src)"""
ADDED = LINES + f""",
numbered AS (SELECT *, i // 20 AS b,
   coalesce(sum(CASE WHEN i % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i // 20
     ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
added AS (SELECT doc_id, {REVIEW} AS review_id, {PATH} AS filename, (b + 1)::INT AS hunk_no,
   (100 * b + 1 + off)::INT AS line_num, line AS content, i FROM numbered WHERE i % 3 = 1)"""

ORACLES["parse_hunks"] = f"""WITH {ADDED}
SELECT review_id, filename, hunk_no, line_num, content FROM added"""
ORACLES["hunks_flattened"] = ORACLES["parse_hunks"]
ORACLES["added_lines_json"] = f"""WITH {ADDED}
SELECT review_id, filename, line_num, content FROM added"""
ORACLES["hunks_nested"] = f"""WITH {ADDED}
SELECT review_id, filename, count(DISTINCT hunk_no) AS hunks,
  md5(string_agg(line_num || ':' || content, chr(10) ORDER BY i)) AS lines
FROM added GROUP BY review_id, filename"""
ORACLES["diff_stats"] = f"""WITH {ADDED},
f AS (SELECT review_id, filename, count(*) AS added_lines, count(DISTINCT hunk_no) AS hunks
      FROM added GROUP BY ALL)
SELECT review_id, filename, 'file' AS level, added_lines, hunks FROM f
UNION ALL
SELECT review_id, '', 'review', count(*), count(DISTINCT filename || '#' || hunk_no)
FROM added GROUP BY review_id"""
ORACLES["split_multifile_diff"] = """
WITH s AS (SELECT doc_id // 5 AS n, doc_id, 'f' || (doc_id % 5 % 4) || '.py' AS filename, text
           FROM documents)
SELECT 'r' || n AS review_id, filename,
  'diff --git a/x b/' || filename || chr(10) || arg_max(text, doc_id) || chr(10) AS patch
FROM s GROUP BY n, filename"""

# --- files -------------------------------------------------------------------------------------
ORACLES["changed_files"] = f"""
WITH d AS (SELECT d.*, l.quality, l.toxic, (doc_id // 10) % 3 AS v FROM documents d
           LEFT JOIN labels l USING (doc_id))
SELECT {REVIEW} AS review_id,
  CASE WHEN v = 1 AND toxic = 1 THEN 'old/' || {PATH} ELSE {PATH} END AS filename,
  CASE WHEN v = 1 THEN CASE WHEN quality = 1 THEN 'added' WHEN toxic = 1 THEN 'deleted'
                            ELSE 'modified' END
       WHEN toxic = 1 THEN CASE v WHEN 0 THEN 'removed' ELSE 'deleted' END
       WHEN quality = 1 THEN 'added' WHEN quality = 0 THEN 'modified'
       ELSE CASE v WHEN 0 THEN 'renamed' ELSE 'modified' END END AS status,
  CASE WHEN v = 1 THEN text WHEN doc_id % 7 = 0 THEN ''
       WHEN v = 0 THEN text
       ELSE 'diff --git a/x b/' || {PATH} || chr(10) || text || chr(10) END AS patch
FROM d"""
ORACLES["attach_patches"] = f"""
SELECT {REVIEW} AS review_id, {PATH} AS filename,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN text ELSE '' END AS patch FROM documents"""
ORACLES["status_and_filename"] = """
SELECT d.doc_id,
  CASE d.doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS by_word,
  CASE WHEN quality = 1 THEN 'added' WHEN toxic = 1 THEN 'deleted' ELSE 'modified' END AS by_flag,
  CASE WHEN d.doc_id % 3 = 1 THEN source WHEN d.doc_id % 2 = 0 THEN lang ELSE '' END AS filename
FROM documents d LEFT JOIN labels USING (doc_id)"""

N_OF = "(doc_id // 10 % 25 % 4)"
IGNORED = ("CASE {n} WHEN 3 THEN ({p} LIKE '%.js' OR regexp_matches({p}, '^src[1-4]/'))"
           " ELSE ({p} LIKE '%.lock' OR {p} LIKE '%.min.js' OR {p} LIKE '%.generated.%'"
           " OR {p} LIKE 'migrations/%') END")
SKIP_LONG = "(" + " OR ".join(f"{{p}} LIKE '%{e}'" for e in fx.SKIP_EXTENSIONS) + ")"
ORACLES["reviewable_files"] = f"""
WITH f AS (SELECT doc_id, {REVIEW} AS review_id, {PATH} AS filename, {STATUS} AS status
           FROM documents)
SELECT review_id, filename, status FROM f
WHERE status IN ('added', 'modified') AND NOT {SKIP_LONG.format(p='filename')}
  AND NOT {IGNORED.format(n=N_OF, p='filename')}"""
ORACLES["reviewable_files_default"] = f"""
WITH f AS (SELECT {REVIEW} AS review_id, {PATH} AS filename, {STATUS} AS status FROM documents)
SELECT review_id, filename, status FROM f WHERE status IN ('added', 'modified')
  AND NOT (filename LIKE '%.lock' OR filename LIKE '%.png' OR filename LIKE '%.min.js')"""
ORACLES["glob_match"] = f"""
WITH p AS (SELECT {PATH} AS path FROM documents),
g(pattern, re) AS (VALUES ('*.min.js', '.*\\.min\\.js'), ('src[0-4]/*', 'src[0-4]/.*'),
  ('src?/en/*', 'src./en/.*'), ('src[!1]*.py', 'src[^1].*\\.py'), ('*/[x', '.*/\\[x'),
  ('src1*/fr/*.t[ps]', 'src1.*/fr/.*\\.t[ps]'))
SELECT path, pattern, regexp_full_match(path, re) AS hit FROM p, g"""
ORACLES["language_of"] = f"""
WITH p AS (SELECT {PATH} AS path FROM documents),
e AS (SELECT path, string_split(path, '.')[-1] AS extension FROM p)
SELECT path, extension, CASE extension WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript'
  WHEN 'ts' THEN 'typescript' ELSE 'none' END AS language FROM e"""

# The generated source of a part: its size, its definitions and its calls.
SOURCE = """
calls AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n,
   string_agg(DISTINCT 's_' || l_suppkey, ',' ORDER BY 's_' || l_suppkey) AS deps,
   sum(length(line)) AS chars
   FROM (SELECT DISTINCT l_partkey, l_suppkey, '    s_' || l_suppkey || '(x)' AS line
         FROM lineitem) GROUP BY l_partkey),
f AS (SELECT p_partkey AS k, p_brand AS brand, 'org/' || p_brand AS repo,
   'pkg/m' || p_partkey || CASE WHEN p_partkey % 20 = 18 THEN '.txt' ELSE '.py' END AS file_path,
   coalesce(n, 0) AS n, coalesce(deps, '') AS deps, coalesce(chars, 0) AS chars,
   (p_partkey % 2 = 0) AS doc, (p_partkey % 50 = 49) AS broken, (p_partkey % 20 = 18) AS other
   FROM part LEFT JOIN calls ON l_partkey = p_partkey),
pos AS (SELECT *, 4 + doc::INT + n + 1 AS fe FROM f WHERE NOT broken AND NOT other),
nodes AS (
  SELECT k, brand, repo, file_path, 'function_definition' AS node_type, 'p_' || k AS node_name,
    4 AS start_line, fe AS end_line, deps AS dependencies, doc AS has_docstring,
    length('def p_' || k || '(x):') + CASE WHEN doc THEN 1 + length('    \"\"\"Doc.\"\"\"') ELSE 0
      END + chars + n + 1 + length('    return x') AS size FROM pos
  UNION ALL
  SELECT k, brand, repo, file_path, 'class_definition', 'C_' || k, fe + 3, fe + 5,
    'p_' || k || ',self.db.get', false, length('class C_' || k || ':') + 1
      + length('    def Run(self):') + 1 + length('        return p_' || k || '(self.db.get(1))')
    FROM pos
  UNION ALL
  SELECT k, brand, repo, file_path, 'function_definition', 'Run', fe + 4, fe + 5,
    'p_' || k || ',self.db.get', false, length('def Run(self):') + 1
      + length('        return p_' || k || '(self.db.get(1))') FROM pos)"""
FILE_SIZE = """CASE WHEN broken THEN length('def broken(:') + 1 ELSE
  length('import db') + 3 + length('def p_' || k || '(x):') + 1
  + CASE WHEN doc THEN length('    \"\"\"Doc.\"\"\"') + 1 ELSE 0 END + chars + n
  + length('    return x') + 3 + length('class C_' || k || ':') + 1
  + length('    def Run(self):') + 1 + length('        return p_' || k || '(self.db.get(1))') END"""
ORACLES["code_files"] = f"""WITH {SOURCE},
sized AS (SELECT repo, k, file_path, {FILE_SIZE} AS size FROM f WHERE NOT other),
r AS (SELECT 'memory' AS mode, repo, k, file_path,
        row_number() OVER (PARTITION BY repo ORDER BY k) AS rn, 50 AS cap FROM sized
      UNION ALL
      SELECT 'table', repo, k, file_path, row_number() OVER (PARTITION BY repo ORDER BY k), 30
      FROM sized WHERE size < 500)
SELECT mode, repo, k::INT AS tree_pos, file_path FROM r WHERE rn <= cap"""
ORACLES["extract_nodes"] = f"""WITH {SOURCE}
SELECT repo, file_path, node_type, node_name, start_line::INT AS start_line,
  end_line::INT AS end_line, dependencies, has_docstring, size::INT AS size FROM nodes"""
ORACLES["quarantined_files"] = f"""WITH {SOURCE}
SELECT repo, file_path FROM f WHERE broken AND NOT other"""
ORACLES["modified_nodes"] = f"""WITH {SOURCE},
t AS (SELECT DISTINCT l_partkey, l_orderkey % 7 * 9 + 1 AS line FROM lineitem)
SELECT 'rv-' || brand AS review_id, file_path, node_name, start_line::INT AS start_line,
  bool_or(line = start_line) AS start_added
FROM nodes JOIN t ON l_partkey = k AND line BETWEEN start_line AND end_line
GROUP BY ALL"""
CALL_PAIRS = """
pairs AS (SELECT repo AS graph_id, 'p_' || k AS src, 's_' || l_suppkey AS dst
    FROM pos JOIN lineitem ON l_partkey = k
  UNION SELECT repo, 'C_' || k, 'p_' || k FROM pos
  UNION SELECT repo, 'C_' || k, 'self.db.get' FROM pos
  UNION SELECT repo, 'Run', 'p_' || k FROM pos
  UNION SELECT repo, 'Run', 'self.db.get' FROM pos)"""
ORACLES["call_edges"] = f"""WITH {SOURCE}, {CALL_PAIRS}
SELECT graph_id, src, dst, 'CALLS' AS type FROM pairs"""
ORACLES["graph_nodes"] = f"""WITH {SOURCE}, {CALL_PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY repo, node_name
        ORDER BY file_path DESC, start_line DESC) AS rn FROM nodes),
last AS (SELECT * FROM r WHERE rn = 1),
names AS (SELECT repo AS graph_id, node_name AS name FROM nodes
          UNION SELECT graph_id, dst FROM pairs)
SELECT graph_id, name, coalesce(node_type, '') AS type, coalesce(start_line, 0)::INT AS start_line,
  coalesce(end_line, 0)::INT AS end_line
FROM names LEFT JOIN last ON repo = graph_id AND node_name = name"""
SUPPLY = """
ps AS (SELECT DISTINCT p_brand AS g, 'p_' || p_partkey AS a, l_suppkey AS s
       FROM lineitem JOIN part ON p_partkey = l_partkey),
sn AS (SELECT DISTINCT g, 's_' || s AS a, 'n_' || s_nationkey AS b FROM ps
       JOIN supplier ON s_suppkey = s),
e AS (SELECT g, a, 's_' || s AS b FROM ps UNION SELECT g, a, b FROM sn)"""
ORACLES["blast_radius"] = f"""WITH {SUPPLY}
SELECT g AS graph_id, a AS seed, b AS name, 'callee' AS direction, 1 AS hops
FROM e WHERE a LIKE 'p%'
UNION ALL
SELECT DISTINCT x.g, x.a, y.b, 'callee', 2 FROM e x JOIN e y ON x.g = y.g AND x.b = y.a
WHERE x.a LIKE 'p%'
UNION ALL
SELECT g, b, a, 'caller', 1 FROM e WHERE b LIKE 'n%'
UNION ALL
SELECT DISTINCT y.g, y.b, x.a, 'caller', 2 FROM e x JOIN e y ON x.g = y.g AND x.b = y.a
WHERE y.b LIKE 'n%'"""
ORACLES["blast_context"] = f"""WITH {SUPPLY},
c AS (SELECT DISTINCT g, 's_' || s AS name, s_name FROM ps JOIN supplier ON s_suppkey = s)
SELECT g AS graph_id, string_agg('Dependency: ' || name || chr(10) || s_name,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY name) AS context
FROM c GROUP BY g"""

# --- findings ----------------------------------------------------------------------------------
ORACLES["findings_parse"] = """
WITH item AS (SELECT doc_id, source AS file_path, n_chars AS line, 'INFO' AS severity,
                lang AS body FROM documents),
other AS (SELECT doc_id, source AS file_path, 12 AS line, 'BLOCKER' AS severity,
            doc_id::VARCHAR AS body FROM documents),
rows_ AS (
  SELECT *, 0 AS pos FROM item WHERE doc_id % 6 = 0
  UNION ALL SELECT *, 0 FROM item WHERE doc_id % 6 = 1
  UNION ALL SELECT *, 1 FROM other WHERE doc_id % 6 = 1
  UNION ALL SELECT *, 0 FROM other WHERE doc_id % 6 = 2
  UNION ALL SELECT *, 0 FROM other WHERE doc_id % 6 = 3
  UNION ALL SELECT *, 1 FROM item WHERE doc_id % 6 = 3)
SELECT doc_id, pos, file_path, line::INT AS line, severity, body, fence
FROM rows_, (VALUES ('last'), ('first')) v(fence)"""
SEVERITY = values_case("doc_id % 4", list(fx_.SEVERITIES))
RANK = values_case("doc_id % 4", [3, 2, 1, 1])
COMMENTS = f"""
c AS (SELECT lang AS review_id, doc_id AS seq, source AS file_path, (doc_id % 50)::INT AS line,
   {SEVERITY} AS severity, {RANK} AS rank, text AS body,
   CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 3 ELSE 1 END AS min_rank,
   CASE lang WHEN 'en' THEN 40 WHEN 'fr' THEN 5 ELSE 1500 END AS cap FROM documents),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, file_path, severity,
        left(body, 50) ORDER BY seq) AS rn FROM c) WHERE rn = 1),
nc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY seq) AS rn2
         FROM d WHERE rank >= min_rank) WHERE rn2 <= cap)"""
SHORT = "review_id, seq, file_path, line, severity, md5(body) AS body"
ORACLES["severity_rank"] = f"""WITH {COMMENTS}
SELECT severity, max(rank)::INT AS rank, count(*) AS comments FROM c GROUP BY severity"""
ORACLES["dedup_comments"] = f"WITH {COMMENTS} SELECT {SHORT} FROM d"
ORACLES["filter_severity"] = f"WITH {COMMENTS} SELECT {SHORT} FROM c WHERE rank >= min_rank"
ORACLES["cap_comments"] = f"""WITH {COMMENTS}, r AS (SELECT *, row_number() OVER (
  PARTITION BY review_id ORDER BY seq) AS n FROM c) SELECT {SHORT} FROM r WHERE n <= cap"""
ORACLES["noise_control"] = f"WITH {COMMENTS} SELECT {SHORT} FROM nc"
ORACLES["last_by_key"] = f"""WITH {COMMENTS}, r AS (SELECT *, row_number() OVER (
  PARTITION BY review_id, file_path ORDER BY seq DESC) AS n FROM c)
SELECT {SHORT} FROM r WHERE n = 1"""
ORACLES["review_summary"] = f"""WITH {COMMENTS},
a AS (SELECT review_id, count(*) AS found, count(*) FILTER (WHERE severity = 'BLOCKER') AS blocker,
   count(*) FILTER (WHERE severity = 'WARNING') AS warning,
   count(*) FILTER (WHERE severity = 'INFO') AS info FROM c GROUP BY review_id),
b AS (SELECT review_id, count(*) AS posted, count(DISTINCT file_path) AS files_flagged
   FROM nc GROUP BY review_id)
SELECT review_id, found, blocker, warning, info, coalesce(posted, 0) AS posted,
  coalesce(files_flagged, 0) AS files_flagged FROM a LEFT JOIN b USING (review_id)"""
ORACLES["ground_comments"] = f"""WITH {ADDED},
k AS (SELECT doc_id, (n_chars % 40)::INT AS line FROM documents)
SELECT {REVIEW} AS review_id, k.doc_id AS seq,
  EXISTS (SELECT 1 FROM added a WHERE a.doc_id = k.doc_id AND a.line_num = k.line) AS grounded,
  CASE WHEN EXISTS (SELECT 1 FROM added a WHERE a.doc_id = k.doc_id AND a.line_num = k.line)
         THEN 'ok'
       WHEN NOT EXISTS (SELECT 1 FROM added a WHERE a.doc_id = k.doc_id) THEN 'file_not_changed'
       ELSE 'line_not_added' END AS reason
FROM k"""
ORACLES["suppress_repeats"] = f"""WITH {COMMENTS},
p AS (SELECT review_id, file_path, severity, body AS head FROM c
      WHERE length(body) % 3 = 0 AND seq % 4 <> 0)
SELECT {SHORT} FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.review_id = c.review_id
  AND p.file_path = c.file_path AND p.severity = c.severity AND p.head = c.body)"""
ORACLES["feedback_stats"] = f"""
WITH o AS (SELECT conv_id::VARCHAR AS review_id, role, contains(text, 'tion') AS own,
             turn % 3 <> 0 AS replied FROM conversations),
s AS (SELECT review_id, count(*) FILTER (WHERE own) AS total_previous,
   count(*) FILTER (WHERE own AND replied) AS resolved, 0::BIGINT AS dismissed,
   count(*) FILTER (WHERE own AND NOT replied) AS open,
   coalesce(string_agg(DISTINCT role, ',' ORDER BY role) FILTER (WHERE own), '')
     AS previously_flagged_files FROM o GROUP BY review_id)
SELECT *, CASE WHEN total_previous = 0 THEN 'This is the first {fx_.SERVICE} review on this PR.'
  ELSE 'FEEDBACK CONTEXT: {fx_.SERVICE} previously posted ' || total_previous
   || ' comments on this PR. ' || resolved || ' were resolved by the developer (accepted), '
   || open || ' are still open. Previously flagged files: '
   || replace(previously_flagged_files, ',', ', ')
   || '. Avoid re-posting the same issues on unchanged lines.' END AS summary FROM s"""
ORACLES["review_outbox"] = f"""
WITH c AS (SELECT doc_id, doc_id // 10 AS n, (doc_id // 10) % 3 AS v,
  CASE WHEN doc_id % 11 <> 0 THEN source ELSE '' END AS path,
  CASE WHEN doc_id % 13 <> 0 THEN doc_id % 50 ELSE 1 END AS line,
  CASE WHEN doc_id % 17 <> 0 THEN 'WARNING' ELSE 'INFO' END AS severity,
  'body "' || lang || '"' AS body FROM documents),
t AS (SELECT *, '**[' || severity || '] {M}**' || chr(10) || chr(10) || body AS text,
  '**[' || severity || '] {M}**\\n\\nbody \\"' || substr(body, 7, length(body) - 7) || '\\"' AS esc,
  md5(n::VARCHAR) AS sha FROM c)
SELECT 'r' || n AS review_id, doc_id AS seq, {values_case('v', ['github', 'gitlab', 'bitbucket'])}
    AS vcs, n AS pr_number,
  CASE v WHEN 0 THEN '{{"path":"' || path || '","line":' || line || ',"side":"RIGHT","body":"' || esc
      || '"}}'
    WHEN 1 THEN '{{"body":"' || esc || '","position":{{"base_sha":"' || sha || '","start_sha":"'
      || sha || '","head_sha":"' || sha || '","position_type":"text","new_path":"' || path
      || '","new_line":' || line || '}}}}'
    ELSE '{{"content":{{"raw":"' || esc || '"}},"inline":{{"to":' || line || ',"path":"' || path
      || '"}}}}' END AS payload,
  CASE v WHEN 0 THEN text
    WHEN 1 THEN '**`' || path || ':' || line || '`**' || chr(10) || chr(10) || text
    ELSE '`' || path || ':' || line || '`' || chr(10) || chr(10) || text END AS fallback,
  (v <> 0 OR (doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0)) AS sendable
FROM t"""
ORACLES["render_comment"] = f"""WITH {COMMENTS},
t AS (SELECT *, '**[' || severity || '] {M}**' || chr(10) || chr(10) || body AS t FROM c)
SELECT seq, md5(t) AS rendered,
  md5('`' || file_path || ':' || line || '`' || chr(10) || chr(10) || t) AS fallback FROM t"""
ORACLES["append_description"] = """
WITH b AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 <> 0 THEN text ELSE '' END AS b
           FROM documents),
d AS (SELECT doc_id, CASE WHEN contains(b, 'tion') THEN b ELSE b || chr(10) || chr(10) || '---'
   || chr(10) || chr(10) || 'SUMMARY ' || lang END AS d FROM b)
SELECT doc_id, md5(d) AS description, length(d)::INT AS size FROM d"""
ORACLES["patch_bundle"] = f"""
WITH b AS (
  SELECT lang AS review_id, 'plain' AS style, left(string_agg('File: ' || {PATH} || chr(10) || text,
    chr(10) ORDER BY doc_id), {fx.DESCRIPTION_BUDGET}) AS bundle FROM documents GROUP BY lang
  UNION ALL
  SELECT lang, 'markdown', left(string_agg(chr(10) || '### File: `' || {PATH} || '`' || chr(10)
    || '```' || chr(10) || text || chr(10) || '```' || chr(10), '' ORDER BY doc_id),
    {fx.FULL_REVIEW_BUDGET}) FROM documents GROUP BY lang)
SELECT review_id, style, length(bundle)::INT AS size, md5(bundle) AS bundle FROM b"""

# --- policies ----------------------------------------------------------------------------------
APIS = fx.DEFAULT_POLICY["security"]["forbidden_apis"]
POLICY = """
p AS (SELECT DISTINCT 'r' || (doc_id // 10) AS review_id, 'org/n' || (doc_id // 10 % 25) AS repo,
        doc_id // 10 % 25 % 4 AS n FROM documents)"""
ORACLES["policy_resolve"] = f"""WITH {POLICY}
SELECT review_id, repo, CASE n WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 15 END AS max_comments,
  CASE n WHEN 1 THEN 'warning' ELSE 'INFO' END AS severity_filter,
  CASE n WHEN 1 THEN 2 ELSE 1 END AS min_rank,
  CASE n WHEN 3 THEN '*.js,src[1-4]/*'
    ELSE {q(','.join(fx.DEFAULT_POLICY['ignore_paths']))} END AS ignore_paths,
  CASE n WHEN 2 THEN 'eval(' ELSE {q(','.join(APIS))} END AS forbidden_apis,
  n <> 2 AS require_parameterized_queries, n <> 2 AS flag_hardcoded_secrets,
  true AS flag_n_plus_one, n <> 3 AS require_docstrings,
  CASE n WHEN 3 THEN 'camelCase' ELSE 'snake_case' END AS naming_convention,
  n <> 3 AS flag_dead_code FROM p"""


def _rules_text(n: int) -> str:
    lines = [fx.POLICY_LINE_FORBIDDEN + ("eval(" if n == 2 else ", ".join(APIS))]
    for name, text in fx.POLICY_LINES.items():
        off = (n == 2 and name in ("require_parameterized_queries", "flag_hardcoded_secrets")) or \
            (n == 3 and name in ("require_docstrings", "flag_dead_code"))
        if not off:
            lines.append(text)
    return "\n".join("- " + line for line in lines)


POLICY_TEXT = values_case("n", [_rules_text(n) for n in range(4)])
ORACLES["policy_text"] = f"WITH {POLICY} SELECT review_id, {POLICY_TEXT} AS policy_text FROM p"
ORACLES["policy_category_text"] = f"""WITH {POLICY}
SELECT review_id, category, CASE category
  WHEN ' Security' THEN 'Forbidden APIs: ' || CASE n WHEN 2 THEN 'eval(' ELSE {q(', '.join(APIS))} END
    || chr(10) || 'Require parameterized queries: ' || CASE n WHEN 2 THEN 'False' ELSE 'True' END
    || chr(10) || 'Flag hardcoded secrets: ' || CASE n WHEN 2 THEN 'False' ELSE 'True' END
  WHEN 'performance' THEN {q('Flag N+1: True' + chr(10) + 'Require timeouts: True' + chr(10)
                             + 'Flag unbounded loops: True')}
  WHEN 'STYLE ' THEN 'Require docstrings: ' || CASE n WHEN 3 THEN 'False' ELSE 'True' END
    || chr(10) || 'Naming: ' || CASE n WHEN 3 THEN 'camelCase' ELSE 'snake_case' END
    || chr(10) || 'Flag dead code: ' || CASE n WHEN 3 THEN 'False' ELSE 'True' END
  WHEN 'all' THEN {POLICY_TEXT} ELSE {q(fx.POLICY_UNKNOWN.replace('%s', 'other'))} END AS answer
FROM p, (VALUES (' Security'), ('performance'), ('STYLE '), ('all'), ('other')) v(category)"""

# --- audit -------------------------------------------------------------------------------------
K = "regexp_extract(props, '([0-9]+)', 1)::INT"
AUDIT = f"""
a AS (SELECT event_id AS log_pos, event_id % 97 = 0 AS malformed,
   CASE WHEN event_id % 97 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN -1
        ELSE epoch_us(ts) END AS ts_us,
   CASE WHEN event_id % 97 = 0 OR event_id % 19 = 0 THEN '' ELSE event_type END AS event,
   CASE WHEN event_id % 97 = 0 THEN '' ELSE 'org/r' || user_id END AS repo,
   CASE WHEN event_id % 97 = 0 THEN -1 ELSE {K} END::BIGINT AS pr_number
   FROM events WHERE event_id % 89 <> 0 OR event_id % 97 = 0)"""
CUTOFF = "epoch_us(TIMESTAMP '2024-01-15')"
ORACLES["audit_read"] = f"""WITH {AUDIT}
SELECT log_pos, ts_us, event, repo, pr_number, malformed FROM a"""
ORACLES["audit_query"] = f"""WITH {AUDIT},
x AS (SELECT 'purchase since' AS asked, log_pos FROM a WHERE NOT malformed AND event = 'purchase'
        AND ts_us >= epoch_us(TIMESTAMP '2024-01-05') ORDER BY log_pos LIMIT 100),
y AS (SELECT 'repo' AS asked, log_pos FROM a WHERE NOT malformed AND repo = 'org/r7'
        ORDER BY log_pos LIMIT 1000)
SELECT * FROM x UNION ALL SELECT * FROM y"""
ORACLES["audit_stats"] = f"""WITH {AUDIT}
SELECT CASE event WHEN '' THEN 'unknown' ELSE event END AS event, count(*) AS entries
FROM a WHERE NOT malformed GROUP BY 1
UNION ALL SELECT '(total)', count(*) FROM a WHERE NOT malformed"""
ORACLES["audit_retention"] = f"""WITH {AUDIT}
SELECT log_pos, malformed FROM a WHERE ts_us = -1 OR ts_us >= {CUTOFF}"""
ORACLES["retention_summary"] = f"""WITH {AUDIT}
SELECT 'audit_logs' AS storage, count(*) AS purged, 'ok' AS status FROM a
WHERE ts_us <> -1 AND ts_us < {CUTOFF}
UNION ALL SELECT 'cache_files', count(*), 'ok' FROM events WHERE ts < TIMESTAMP '2024-01-25'"""
ORACLES["retention_job"] = f"""WITH {AUDIT},
g AS (SELECT ts_us <> -1 AND ts_us < {CUTOFF} AS gone FROM a)
SELECT 'audit_logs' AS storage, count(*) FILTER (WHERE gone) AS purged, 'ok' AS status FROM g
UNION ALL SELECT 'cache_files', 0, 'ok'
UNION ALL SELECT 'left in the log', count(*) FILTER (WHERE NOT gone) + 1, 'ok' FROM g"""
ORACLES["cache_manifest"] = """
SELECT event_type, true AS stale, count(DISTINCT event_type) AS files FROM events
GROUP BY event_type"""
RUNS = f"""
e AS (SELECT *, event_id // 2 AS task, {K} AS k FROM events),
b AS (SELECT * FROM e WHERE event_id % 2 = 0),
z AS (SELECT * FROM e WHERE event_id % 2 = 1)"""
ORACLES["review_runs"] = f"""WITH {RUNS}
SELECT 't' || b.task AS task_id,
  {values_case('b.task % 3', ['github', 'gitlab', 'bitbucket'])} AS vcs,
  'org/r' || (b.task % 40) AS repo, b.task AS pr_number,
  CASE WHEN z.task IS NULL THEN 'running' WHEN z.user_id % 4 = 0 THEN 'failed'
       ELSE 'completed' END AS status,
  CASE WHEN z.task IS NULL THEN -1 WHEN z.user_id % 4 > 1 THEN z.k * 10
       ELSE (epoch_us(z.ts) - epoch_us(b.ts)) // 1000 END::BIGINT AS duration_ms,
  CASE WHEN z.user_id % 4 = 1 THEN z.k ELSE 0 END::BIGINT AS comments_posted
FROM b LEFT JOIN z USING (task)"""
ENDING = """CASE WHEN event_id % 2 = 0 THEN 'review_started' WHEN user_id % 4 = 0
  THEN 'review_task_failed' WHEN user_id % 4 = 1 THEN 'review_task_succeeded'
  ELSE 'review_completed' END"""
ORACLES["audit_append"] = f"""
SELECT epoch_us(ts) AS ts_us, {ENDING} AS event, 'svc' AS actor,
  't' || (event_id // 2) AS task_id, false AS malformed FROM events"""
ORACLES["retention_boundary_day"] = f"""
WITH l AS (SELECT ts, {ENDING} AS event, 't' || (event_id // 2) AS task_id FROM events),
k AS (SELECT * FROM l WHERE ts >= TIMESTAMP '2024-01-15 12:00:00')
SELECT strftime(ts, '%Y-%m-%d') AS item, count(*) AS entries FROM k GROUP BY 1
UNION ALL SELECT 'purged', (SELECT count(*) FROM l) - (SELECT count(*) FROM k)
UNION ALL (SELECT task_id, epoch_us(ts) FROM k WHERE event = 'review_started' ORDER BY ts, task_id LIMIT 50)"""
ORACLES["audit_query_after_retention"] = f"""
WITH hit AS (SELECT epoch_us(ts) AS ts_us, 't' || (event_id // 2) AS task_id FROM events
  WHERE {ENDING} = 'review_completed' AND ts >= TIMESTAMP '2024-01-18' ORDER BY ts_us, task_id LIMIT 100)
SELECT log, ts_us, task_id FROM hit, (VALUES ('before'), ('after')) v(log)"""
ORACLES["audit_stream"] = f"""
SELECT {ENDING} AS event, count(*) AS entries, count(*) AS written FROM events GROUP BY 1"""

# --- webhooks ----------------------------------------------------------------------------------
DELIVERY = f"""
h AS (SELECT *, {K} AS k, event_id % 3 AS v, event_id % 101 = 0 AS broken,
   event_id % 3 = 0 AND event_type = 'signup' AS commented,
   event_id % 3 = 2 OR (event_id % 10 <> 0 AND event_id % 37 <> 0) AS signed FROM events),
n AS (SELECT *, CASE
   WHEN NOT signed THEN 'invalid_signature'
   WHEN broken THEN 'invalid_json'
   WHEN event_type = 'error' THEN 'event_ignored'
   WHEN v < 2 AND event_type = 'purchase' THEN 'action_ignored'
   WHEN commented AND k % 3 = 2 THEN 'no_command'
   WHEN commented AND (k % 5 = 0 OR k % 7 = 0) THEN 'bot_ignored'
   WHEN event_id % 50 = 0 THEN 'missing_fields' ELSE 'accepted' END AS outcome FROM h)"""
VCS = values_case("v", ["github", "gitlab", "bitbucket"])
ORACLES["signature_verify"] = f"""WITH {DELIVERY}
SELECT event_id::VARCHAR AS delivery_id, {VCS} AS vcs, signed AS signature_ok FROM n"""


def _hmac_sql(secret: str, message: str) -> str:
    import hashlib
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    pads = [bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C)]
    return (f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || "
            f"encode({message}))))")


ORACLES["hmac_digest"] = f"SELECT doc_id, {_hmac_sql('k' * 70, 'text')} AS digest FROM documents"
ORACLES["webhook_normalise"] = f"""WITH {DELIVERY}
SELECT event_id::VARCHAR AS delivery_id, {VCS} AS vcs,
  CASE WHEN broken THEN '' ELSE 'org/r' || user_id END AS repo,
  CASE WHEN broken THEN -1 ELSE event_id % 50 END AS pr_number,
  CASE WHEN broken OR commented THEN '' ELSE md5(event_id::VARCHAR) END AS head_sha,
  CASE WHEN NOT broken AND v = 1 THEN user_id ELSE -1 END AS project_id,
  CASE WHEN broken OR NOT commented THEN '' ELSE
    {values_case('k % 3', ['please /Review this', '/ask why', 'thanks'])} END AS comment_body,
  CASE WHEN broken OR NOT commented THEN '' ELSE event_id::VARCHAR END AS comment_id,
  outcome FROM n"""


def _limiter(source: str, key: str, limit: int, window_us: int) -> str:
    """Recursive walk of each key over its requests, carrying the accepted times."""
    live = f"list_filter(w.acc, lambda x: r.t - x < {window_us})"
    return f"""
r AS (SELECT event_id, {key} AS k, epoch_us(ts) AS t,
        row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM {source}),
w AS (SELECT k, rn, event_id, true AS allowed, [t] AS acc FROM r WHERE rn = 1
  UNION ALL
  SELECT r.k, r.rn, r.event_id, len({live}) < {limit},
    CASE WHEN len({live}) < {limit} THEN list_append({live}, r.t) ELSE {live} END
  FROM w JOIN r ON r.k = w.k AND r.rn = w.rn + 1)"""


DAY = fx_.RATE_WINDOW * 1_000_000
ORACLES["rate_limit"] = f"""WITH RECURSIVE {_limiter('events', 'user_id', fx_.RATE_MAX, DAY)}
SELECT event_id, allowed FROM w"""
ORACLES["rate_limit_one_key"] = f"""WITH RECURSIVE
{_limiter('events', "'all'", 100, 43200 * 1_000_000)} SELECT event_id, allowed FROM w"""
# Requests with equal times are taken in the order of their ids as text.
ORACLES["delivery_outcome"] = f"""WITH RECURSIVE {DELIVERY},
acc AS (SELECT * FROM n WHERE outcome = 'accepted'),
{_limiter('acc', 'user_id', fx_.RATE_MAX, DAY)}
SELECT n.event_id::VARCHAR AS delivery_id, {VCS} AS vcs,
  CASE WHEN w.allowed = false THEN 'rate_limited' ELSE outcome END AS outcome
FROM n LEFT JOIN w USING (event_id)"""
ORACLES["webhook_stream"] = ORACLES["delivery_outcome"]
ORACLES["webhook_stream_audit"] = f"""SELECT coalesce(event, '(total)') AS event, count(*) AS entries
FROM (SELECT CASE outcome WHEN 'accepted' THEN 'review_queued' WHEN 'rate_limited' THEN 'webhook_rate_limited'
    ELSE 'webhook_rejected' END AS event FROM ({ORACLES["delivery_outcome"]}) x
  WHERE outcome IN ('accepted', 'rate_limited', 'invalid_signature')) y GROUP BY ROLLUP (event)"""
ORACLES["delivery_audit"] = f"""WITH {DELIVERY}
SELECT CASE outcome WHEN 'accepted' THEN 'review_queued' ELSE 'webhook_rejected' END AS event,
  {VCS} AS vcs, count(*) AS entries,
  count(*) FILTER (WHERE v = 1 AND outcome = 'accepted') AS with_iid,
  count(*) FILTER (WHERE v = 2 AND outcome = 'accepted') AS with_hook
FROM n WHERE outcome IN ('accepted', 'invalid_signature') GROUP BY 1, 2"""

# --- vectors -----------------------------------------------------------------------------------
ORACLES["l2_normalise_vectors"] = """
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e,
  sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, round(1.0::DOUBLE, 6) AS length, round(e[1] / n, 6) AS first,
  round(list_max(e) / n, 6) AS largest FROM u"""
ORACLES["cosine_scores"] = """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
  AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def _knn(k: int, same: bool) -> str:
    on = "a.label = b.label" if same else "true"
    return f"""
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
        list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
      FROM embeddings a JOIN embeddings b ON {on}),
t AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
        ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM s)
, hits AS (SELECT * FROM t WHERE rank <= {k})"""


ORACLES["knn"] = f"""WITH {_knn(5, False)}
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM hits"""
ORACLES["knn_by_repo"] = f"""WITH {_knn(3, True)}
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM hits"""
ORACLES["knn_blocked"] = f"""WITH {_knn(5, True)}
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM hits"""
ORACLES["search_text"] = f"""WITH {_knn(3, True)}
SELECT query_id, string_agg('File: src/' || chunk_id || '.py | function_definition f_' || chunk_id
  || ' (score: ' || printf('%.2f', score) || ')' || chr(10)
  || left(repeat('line ' || chunk_id || chr(10), 80), 500),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS result
FROM hits GROUP BY query_id"""
ORACLES["embed_text"] = """
SELECT doc_id, md5(replace('class_definition ' || source || ': ' || text, chr(10), ' ')) AS document,
  md5(replace(text, chr(10), ' ')) AS query FROM documents"""
ORACLES["chunk_admit"] = """
SELECT 'memory' AS mode, doc_id, least(length(text), 3000)::INT AS size FROM documents
WHERE length(text) <= 50000 AND length(text) > 100
UNION ALL
SELECT 'table', doc_id, length(text)::INT FROM documents WHERE length(text) BETWEEN 1 AND 3000"""
for _name, _least in (("build_index", 100), ("build_index_table", 0)):
    ORACLES[_name] = f"""WITH {SOURCE}
SELECT repo, file_path, node_name, node_type, size::INT AS size, {fx.EMBED_WIDTH} AS width
FROM nodes WHERE size > {_least}"""
ORACLES["embed_chunks"] = f"""
SELECT doc_id, {fx.EMBED_WIDTH} AS width, round(1.0::DOUBLE, 4) AS length FROM documents"""
ORACLES["index_size"] = """
SELECT 'org/l' || label AS repo, count(*) AS chunks FROM embeddings GROUP BY label"""
ORACLES["index_replace"] = """
SELECT 'org/l' || label AS repo, count(*) AS chunks, max(length('line ' || vec_id))::INT AS longest,
  count(*) AS deleted FROM embeddings GROUP BY label"""

# --- rules -------------------------------------------------------------------------------------
_ARMS = " ".join(
    f"WHEN {i} THEN " + ("line" if t is None else
                         f"replace(replace({q(t)}, '{{d}}', doc_id::VARCHAR), '{{i}}', i::VARCHAR)")
    for i, t in enumerate(fx_.CODE_TEMPLATES))
CODE = LINES + f""",
code AS (SELECT doc_id, i, i // 30 AS b, 100 * (i // 30) + 1 + i % 30 AS n, {REVIEW} AS review_id,
   {PATH} AS path, {N_OF} AS pol, (CASE (doc_id + i) % 16 {_ARMS} END) AS content FROM l),
ind AS (SELECT *, i % 5 <> 4 AS isadd,
   length(regexp_extract(content, '^(\\s*)', 1)) AS indent FROM code),
prev AS (SELECT *, CASE WHEN lag(isadd) OVER w THEN lag(content) OVER w END AS above,
   lag(indent) OVER w AS above_indent FROM ind WINDOW w AS (PARTITION BY doc_id, b ORDER BY i)),
marked AS (SELECT *, regexp_matches(content, {q(P['loop'])}) AS isloop FROM prev WHERE isadd),
looped AS (SELECT *, last_value(CASE WHEN isloop THEN indent END IGNORE NULLS) OVER (
   PARTITION BY doc_id, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS loop
   FROM marked)"""


def _f(rule: str, where: str, body: str, source: str = "looped") -> str:
    severity = {"G1": "BLOCKER", "G2": "BLOCKER", "G3": "BLOCKER", "G4": "WARNING",
                "G5": "WARNING", "G6": "WARNING", "G7": "INFO", "G8": "INFO", "G9": "INFO"}[rule]
    return (f"SELECT review_id, path AS file_path, n::INT AS line, '{severity}' AS severity, "
            f"'Line ' || n::INT || ': ' || {body} AS body, '{rule}' AS rule FROM {source} WHERE {where}")


_API_LIST = ", ".join(f"({q(a)})" for a in APIS)


def _secret(column: str) -> str:
    return " OR ".join(f"regexp_matches({column}, {q(P[k])})"
                       for k in ("secret", "secret_prefix", "secret_pem"))


LINE_RULES = {
    "G1": _f("G1", "contains(content, api) AND (pol <> 2 OR api = 'eval(')",
             "'[G1] Forbidden API: ' || api", f"looped, (VALUES {_API_LIST}) v(api)"),
    "G2": _f("G2", f"pol <> 2 AND ({_secret('content')})", "'[G2] Hardcoded secret'"),
    "G3": _f("G3", f"pol <> 2 AND regexp_matches(content, {q(P['sql_format'])})",
             "'[G3] SQL built by string formatting'"),
    "G4": _f("G4", f"regexp_matches(content, {q(P['query'])}) AND indent > loop",
             "'[G4] Query inside a loop'"),
    "G5": _f("G5", f"regexp_matches(content, {q(P['network'])}) AND NOT contains(content, "
                   "'timeout')", "'[G5] Network call without timeout'"),
    "G9": _f("G9", f"pol <> 3 AND regexp_matches(content, '\\S') AND regexp_matches(above, "
                   f"{q(P['terminator'])}) AND indent = above_indent", "'[G9] Unreachable code'"),
}
for _rule, _sql in LINE_RULES.items():
    ORACLES[f"rule_{_rule.lower()}"] = f"WITH {CODE} {_sql}"
# Definitions of generated sources belong to review r<brand number>; unknown ones have the default policy.
NODE_SRC = SOURCE + f""", {POLICY},
nn AS (SELECT m.review_id, file_path AS path, start_line AS n, node_name, node_type, has_docstring,
   coalesce(p.n, 0) AS pol FROM (SELECT *, 'r' || regexp_extract(brand, '([0-9]+)$', 1)::INT AS review_id
   FROM nodes) m LEFT JOIN p ON p.review_id = m.review_id)"""
NODE_RULES = {
    "G6": _f("G6", "node_type = 'class_definition'", "'[G6] Unbounded loop: ' || node_name",
             "nn"),
    "G7": _f("G7", "pol <> 3 AND NOT has_docstring", "'[G7] Missing docstring: ' || node_name",
             "nn"),
    "G8": _f("G8", "pol <> 3 AND node_name = 'Run'",
             "'[G8] Name breaks the naming convention: ' || node_name", "nn"),
}
for _rule, _sql in NODE_RULES.items():
    ORACLES[f"rule_{_rule.lower()}"] = f"WITH {NODE_SRC} {_sql}"
_ALL = " UNION ALL ".join([*LINE_RULES.values(), *NODE_RULES.values()])
ORACLES["rule_scan"] = f"WITH {CODE}, {NODE_SRC} {_ALL}"
ORACLES["secrets_in_documents"] = f"""WITH {LINES}
SELECT doc_id, i::INT AS i FROM l WHERE {_secret('line')}"""
ORACLES["review_inputs"] = f"""WITH {ADDED}, {POLICY},
f AS (SELECT DISTINCT review_id, filename FROM added),
t AS (SELECT *, {POLICY_TEXT} AS pt, CASE WHEN n <> 1 THEN 'context of ' || repo ELSE '' END AS ctx,
   'notes on ' || review_id AS summary FROM p)
SELECT review_id, filename, ctx AS context, summary, length(pt)::INT AS policy_size,
  (length('## Code Changes (Diff Hunks):') + 1 + 2 + length('## Blast Radius Context:') + 1
   + length(ctx) + 2 + length('## Policy Rules:') + 1 + length(pt) + 2 + length('## ')
   + length(summary))::INT AS frame_size
FROM f JOIN t USING (review_id)"""
ORACLES["waterfall_infer"] = """
SELECT doc_id::VARCHAR AS request_id,
  CASE doc_id % 4 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'none' END AS provider,
  CASE doc_id % 4 WHEN 0 THEN 1 ELSE 2 END AS attempt,
  CASE doc_id % 4 WHEN 0 THEN 'one says ' || doc_id WHEN 1 THEN 'two says ' || doc_id ELSE ''
    END AS content,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'one=rate_limited'
    WHEN 2 THEN 'one=not_found,two=rate_limited' ELSE 'one=other,two=not_found' END AS errors
FROM documents"""
ORACLES["classify_error"] = """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), '429|rate|quota') THEN 'rate_limited'
  WHEN regexp_matches(lower(text), '404|not found') THEN 'not_found' ELSE 'other' END AS kind
FROM documents"""
ORACLES["grade_route"] = """
SELECT conv_id, turn, (contains(upper(regexp_replace(text, 'qu', 'pass', 'gi')), 'PASS')
  OR turn >= 3) AS done FROM conversations"""
ORACLES["split_repo"] = """
WITH n AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(url, '/', '-')
             ELSE regexp_replace(url, '^https?://', '') END AS name FROM pages)
SELECT page_id,
  CASE WHEN contains(name, '/') THEN left(name, instr(name, '/') - 1) ELSE '' END AS workspace,
  CASE WHEN contains(name, '/') THEN substr(name, instr(name, '/') + 1) ELSE '' END AS slug,
  contains(name, '/') AS valid FROM n"""

# --- whole reviews -----------------------------------------------------------------------------
RAW = f"""{CODE},
kept AS (SELECT {REVIEW} AS rid, {PATH} AS kpath FROM documents WHERE {STATUS} IN
   ('added', 'modified') AND NOT {SKIP_LONG.format(p=PATH)}
   AND NOT {IGNORED.format(n=N_OF, p=PATH)}),
raw AS (SELECT * FROM ({' UNION ALL '.join(LINE_RULES.values())})
        WHERE file_path IN (SELECT kpath FROM kept)),
{POLICY},
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, file_path, severity,
   left(body, 50) ORDER BY file_path, line, rule) AS rn FROM raw) WHERE rn = 1),
final AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.review_id
   ORDER BY file_path, line, rule) AS rn2, p.n FROM d JOIN p USING (review_id)
   WHERE p.n <> 1 OR severity <> 'INFO')
   WHERE rn2 <= CASE n WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 15 END)"""
ORACLES["review_findings"] = f"""WITH {RAW}
SELECT review_id, file_path, line, severity, body, rule FROM final"""
ORACLES["review_overview"] = f"""WITH {RAW},
a AS (SELECT review_id, count(*) AS found, count(*) FILTER (WHERE severity = 'BLOCKER') AS blocker,
   count(*) FILTER (WHERE severity = 'WARNING') AS warning,
   count(*) FILTER (WHERE severity = 'INFO') AS info FROM raw GROUP BY review_id),
b AS (SELECT review_id, count(*) AS posted, count(DISTINCT file_path) AS files_flagged
   FROM final GROUP BY review_id)
SELECT review_id, coalesce(found, 0) AS found, coalesce(blocker, 0) AS blocker,
  coalesce(warning, 0) AS warning, coalesce(info, 0) AS info, coalesce(posted, 0) AS posted,
  coalesce(files_flagged, 0) AS files_flagged
FROM (SELECT DISTINCT review_id FROM p) LEFT JOIN a USING (review_id) LEFT JOIN b USING (review_id)"""

# --- the review as one program ------------------------------------------------------------------
# In one file p is called by C and by C's method Run; a definition that was changed is no context.
NEAR = f"""{SOURCE},
t AS (SELECT DISTINCT l_partkey, l_orderkey % 7 * 9 + 1 AS line FROM lineitem),
seed AS (SELECT DISTINCT k, node_name FROM nodes JOIN t ON l_partkey = k AND line BETWEEN start_line AND end_line),
calls_p AS (SELECT k, node_name AS src, 'p_' || k AS dst FROM nodes WHERE node_name <> 'p_' || k),
near AS (SELECT s.k, dst AS name FROM seed s JOIN calls_p c ON s.k = c.k AND s.node_name = src
         UNION SELECT s.k, src FROM seed s JOIN calls_p c ON s.k = c.k AND s.node_name = dst),
part_ AS (SELECT 'rv-' || brand AS review_id, file_path AS filename, name,
    (length('Dependency: ' || name) + 1 + size)::INT AS size
  FROM near JOIN nodes ON nodes.k = near.k AND node_name = name
  WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.k = near.k AND s.node_name = name))"""
ORACLES["blast_context_per_review"] = f"WITH {NEAR} SELECT * FROM part_"
ORACLES["review_inputs_composed"] = f"""WITH {NEAR},
c AS (SELECT filename, sum(size) + 7 * (count(*) - 1) AS size FROM part_ GROUP BY filename),
p AS (SELECT DISTINCT 'rv-' || p_brand AS review_id, regexp_extract(p_brand, '([0-9]+)$', 1)::INT % 4 AS n FROM part),
own AS (SELECT 'rv-' || p_brand AS review_id, 'pkg/m' || p_partkey AS path, p_partkey % 3 <> 0 AS replied
        FROM part WHERE p_size > 25 AND p_partkey % 2 = 0),
fb AS (SELECT review_id, 'FEEDBACK CONTEXT: {fx_.SERVICE} previously posted ' || count(*) || ' comments on this PR. '
   || count(*) FILTER (WHERE replied) || ' were resolved by the developer (accepted), '
   || count(*) FILTER (WHERE NOT replied) || ' are still open. Previously flagged files: '
   || string_agg(path, ', ' ORDER BY path) || '. Avoid re-posting the same issues on unchanged lines.' AS summary
   FROM own GROUP BY review_id),
m AS (SELECT review_id, k, file_path AS filename, count(*) AS lines FROM f JOIN lineitem ON l_partkey = k
      JOIN p ON review_id = 'rv-' || brand GROUP BY ALL)
SELECT review_id, filename, coalesce(c.size, 0)::INT AS context_size,
  md5(coalesce(summary, 'This is the first {fx_.SERVICE} review on this PR.')) AS summary,
  length({POLICY_TEXT})::INT AS policy_size, lines::INT AS lines
FROM m JOIN p USING (review_id) LEFT JOIN fb USING (review_id) LEFT JOIN c USING (filename)"""
ORACLES["review_pipeline"] = f"""WITH {ADDED}, {POLICY},
kept AS (SELECT *, {REVIEW} AS review_id, {PATH} AS path, {SEVERITY} AS severity, {RANK} AS rank FROM documents
  WHERE {STATUS} IN ('added', 'modified') AND NOT {SKIP_LONG.format(p=PATH)} AND NOT {IGNORED.format(n=N_OF, p=PATH)}),
found AS (SELECT doc_id, 0 AS pos, review_id, path, n_chars % 40 AS line, severity, rank, source AS body FROM kept
  UNION ALL SELECT doc_id, 1, review_id, path, 1, 'INFO', 1, 'same' FROM kept),
fresh AS (SELECT * FROM found WHERE (pos = 1 OR doc_id % 4 <> 1 OR doc_id % 8 = 1)
  AND EXISTS (SELECT 1 FROM added a WHERE a.doc_id = found.doc_id AND a.line_num = found.line)),
once AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY review_id, path, severity, left(body, 50)
  ORDER BY doc_id, pos) = 1),
final AS (SELECT once.*, p.n FROM once JOIN p USING (review_id) WHERE p.n <> 1 OR rank >= 2
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY doc_id, pos)
    <= CASE p.n WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 15 END),
told AS (SELECT *, doc_id // 10 AS pr, doc_id // 10 % 3 AS v,
  '**[' || severity || '] {M}**' || chr(10) || chr(10) || body AS text FROM final)
SELECT review_id, doc_id, pos, {values_case('v', ['github', 'gitlab', 'bitbucket'])} AS vcs, pr AS pr_number,
  md5(CASE v WHEN 0 THEN text
    WHEN 1 THEN '**`' || path || ':' || line || '`**' || chr(10) || chr(10) || text
    ELSE '`' || path || ':' || line || '`' || chr(10) || chr(10) || text END) AS fallback, true AS sendable
FROM told"""
