"""The registered queries of the operators and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, hard_negatives, langid, lm, merkle, mtree, multi_index, packing, simhash, toxicity, urls
from .common import crc_mod, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                        "sequence_id", "offset")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the class that links of two bits at most make."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by profiles of three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.train(docs, learn_from=crc_mod("doc_id", 4) != 2)
    found = langid.predict(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn_from=crc_mod("doc_id", 5) != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


URL_RULES = (("com", "/", urls.ALLOW), ("example.com", "/en/", urls.BLOCK), ("www.example.com", "/en/", urls.ALLOW),
             ("net", "/es/", urls.BLOCK), ("net", "/fr/", urls.BLOCK))


@query
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by five rules and by what their aliases are judged."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("url")


ORACLES["op4_urls"] = r"""
WITH RECURSIVE rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
links AS (SELECT url AS source, CASE WHEN contains(raw, '://') THEN raw WHEN raw LIKE '//%' THEN 'http:' || raw
    WHEN raw LIKE '/%' THEN 'http://' || regexp_extract(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1),
        '(?s)^([^/?#]*)', 1) || raw END AS target
  FROM (SELECT url, coalesce(nullif(regexp_extract(regexp_extract(coalesce(html, ''),
      '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), ''),
      nullif(regexp_extract(coalesce(html, ''),
      '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*([^"''\s>]+)', 1), '')) AS raw FROM pages)),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT source FROM links WHERE target IS NOT NULL
    UNION ALL SELECT target FROM links WHERE target IS NOT NULL)),
parsed AS (SELECT url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM urls)),
best AS (SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
    max_by(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
known AS (SELECT p.url, p.host, p.path, b.rule, b.verdict,
    CASE WHEN p.host <> '' THEN p.host || regexp_replace(p.path, '(/index\.html?)?/*$', '') END AS node
  FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path),
edges AS (SELECT DISTINCT s.node AS a, t.node AS b FROM links l JOIN known s ON l.source = s.url
    JOIN known t ON l.target = t.url),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
blocked(node) AS (SELECT DISTINCT node FROM known WHERE verdict = 'block' AND node IS NOT NULL
    UNION SELECT e.b FROM blocked JOIN both_ways e ON e.a = blocked.node)
SELECT page_id, k.host, k.path, k.rule, coalesce(k.verdict, CASE WHEN k.node IN (SELECT node FROM blocked)
    THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p JOIN known k ON p.url IS NOT DISTINCT FROM k.url
"""


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is made of control strings, expanded and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(given.unionByName(extra)))


ORACLES["op5_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6
    + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + CASE WHEN role = 'assistant' THEN 7 ELSE 23 + length(role) + length(role) - length(replace(role, '\', ''))
      + length(role) - length(replace(role, chr(10), ''))
      + (length(role) - length(replace(role, '<s>', ''))) // 3 + (length(role) - length(replace(role, '</s>', ''))) // 4
      + (length(role) - length(replace(role, '[INST]', ''))) // 6
      + (length(role) - length(replace(role, '[/INST]', ''))) // 7 END AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


@query
def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return merkle.edit_report(table(spark, sf_dir, "documents"))


@query
def op8_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits of every fiftieth vector among all vectors."""
    vectors = mtree.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return mtree.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


ORACLES["op8_mtree"] = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i]
    for i in range(1, least(len(q.v), len(c.v)) + 1)])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs, learn_from=crc_mod("doc_id", 7) != 2)
    return lm.score(docs, model, held_out=crc_mod("doc_id", 7) == 2)


@query
def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all vectors, by cosine, as far as the index finds them."""
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, mined from all vectors; a seventh of the labels are moved on."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows, "vec_id", "embedding", "label", F.col("id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum([a.v[i] * c.v[i]
    for i in range(1, least(len(a.v), len(c.v)) + 1)])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score,
    score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@query
def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fill-in-the-middle examples, and restored from them."""
    found = fim.restore(fim.transform(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
                        F.sha2(F.encode("restored", "UTF-8"), 256).alias("restored_sha256"))


ORACLES["op13_fim"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(l[1:least(x, y)], '') AS prefix,
    array_to_string(l[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(l[greatest(x, y) + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
