"""One registered query for each operator, over its whole table, with a SQL twin where SQL can express it."""

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, license_scan, mixing, near_dedup, prefix_trie, preferences, secret_scan, sentencepiece_codec, source_divergence, token_counts, topk_search, toxicity
from .common import documents, settle

QUERIES, SQL = {}, {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(documents(spark, sf_dir))


SQL["op6_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(documents(spark, sf_dir))


SQL["op7_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON least.doc_id = d.doc_id
"""


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(documents(spark, sf_dir), sentencepiece_codec.load())


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


@_query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


@_query
def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_table(settle(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL["op10_topk_search"] = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@_query
def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preferences.pairs_from_conversations(settle(spark).read.parquet(f"{sf_dir}/conversations.parquet"))
    found = preferences.format_preferences(turns)
    joined = {m: F.array_join(F.transform(m, lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ",") for m in ("chosen_mask", "rejected_mask")}
    return found.withColumns(joined)


SQL["op2_preference_format"] = """
WITH base AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
replies AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS text FROM base WHERE role = 'assistant' GROUP BY conv_id),
swap AS (SELECT a.conv_id, a.last_turn, b.text AS other_text FROM replies a JOIN replies b ON b.conv_id = a.conv_id + 1),
turns AS (
  SELECT conv_id AS pair_id, true AS side, turn, role, text FROM base
  UNION ALL SELECT conv_id, false, turn, role, CASE WHEN role = 'assistant' AND turn = last_turn THEN other_text ELSE text END
  FROM base JOIN swap USING (conv_id)),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS k,
    '<|im_start|>' || coalesce(role, 'unknown') || chr(10) AS head, head || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM turns),
others AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.k, r.k)) AS k
  FROM (SELECT * FROM numbered WHERE side) c FULL JOIN (SELECT * FROM numbered WHERE NOT side) r ON c.pair_id = r.pair_id AND c.k = r.k
  WHERE c.k IS NULL OR r.k IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
sizes AS (SELECT pair_id, count(*) FILTER (side) AS c, count(*) FILTER (NOT side) AS r FROM numbered GROUP BY 1),
cut AS MATERIALIZED (
  SELECT pair_id, c, r, CAST(CASE WHEN c = 0 OR r = 0 THEN 0 ELSE coalesce(k - 1, c) END AS INTEGER) AS n FROM sizes LEFT JOIN others USING (pair_id)),
laid AS (
  SELECT numbered.*, n, k > n AS rest, sum(CASE WHEN k > n THEN length(line) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY k) AS stop
  FROM numbered JOIN cut USING (pair_id)),
sides AS (
  SELECT pair_id, side, coalesce(string_agg(line, '' ORDER BY k) FILTER (NOT rest), '') AS prompt, coalesce(string_agg(line, '' ORDER BY k) FILTER (rest), '') AS completion,
    coalesce(string_agg((stop - length(line) + length(head)) || ':' || (stop - length('<|im_end|>') - 1), ',' ORDER BY k) FILTER (rest AND role = 'assistant'), '') AS mask
  FROM laid GROUP BY 1, 2)
SELECT cut.pair_id, n AS n_prompt_turns, c > 0 AND r > 0 AND n = c AND n = r AS tied, coalesce(x.prompt, '') AS prompt,
  x.completion AS chosen, y.completion AS rejected, x.mask AS chosen_mask, y.mask AS rejected_mask
FROM cut LEFT JOIN (SELECT * FROM sides WHERE side) x ON x.pair_id = cut.pair_id LEFT JOIN (SELECT * FROM sides WHERE NOT side) y ON y.pair_id = cut.pair_id
"""


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


SQL["op3_license_scan"] = r"""
WITH templates(license, body) AS (VALUES %s),
template_words AS (SELECT license, list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM templates),
template_shingles AS (
  SELECT license, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS t FROM template_words WHERE len(w) >= 5),
wanted AS (SELECT license, len(t) AS m, unnest(t) AS s FROM template_shingles),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) >= 5),
windows AS (
  SELECT doc_id, license, m, s, unnest(range(greatest(0, pos - m + 1), pos + 1)) AS first_at FROM shingles JOIN wanted USING (s)),
found AS (
  SELECT doc_id, license, first_at, count(DISTINCT s) / m AS containment FROM windows GROUP BY doc_id, license, first_at, m HAVING count(DISTINCT s) >= 0.8 * m - 1e-9)
SELECT doc_id, license, max(containment) AS containment, CAST(arg_max(first_at, containment * 1e9 - first_at / 1e6) AS INTEGER) AS first_word
FROM found GROUP BY doc_id, license
""" % ", ".join(f"('{name}', '{text}')" for name, text in license_scan.TEMPLATES.items())


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(settle(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


# The recursive hash is CRC-32, bit by bit, of the decimal digits; -1 stands for a shift.
SQL["op11_prefix_trie"] = """
WITH placed AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT c, list(said ORDER BY pos) AS turns FROM placed GROUP BY c),
hashed AS MATERIALIZED (
  SELECT c, turns, c - c % 5 AS b, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 9 AS h FROM own),
rebuilt AS MATERIALIZED (
  SELECT a.c, list_concat(coalesce(o.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM hashed a LEFT JOIN own o ON o.c = a.b),
prefixes AS (SELECT c, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS MATERIALIZED (
  SELECT depth, turns[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '') AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE strlen(any_value(turns[depth].t)) END AS bytes FROM prefixes GROUP BY 1, 2),
children AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
marked AS MATERIALIZED (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, path)),
above AS (SELECT path[1:k] AS path, n_children = 0 AS leaf, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM marked)),
below AS (SELECT path, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT m.conv_id::BIGINT AS conv_id, m.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, m.n_convs, m.n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM marked m JOIN below ON below.path = m.path LEFT JOIN nodes p ON p.depth = m.depth - 1 AND p.path = m.path[1:m.depth - 1] AND m.depth > 0
"""


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, sf_dir))


SQL["op12_source_divergence"] = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
uses AS MATERIALIZED (SELECT id, lang, source, t, count(*) AS n FROM (SELECT id, lang, source, unnest(w) AS t FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, t FROM uses GROUP BY ALL HAVING count(*) >= 3),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (SELECT lang, source, t, sum(n)::BIGINT AS n FROM uses JOIN kept USING (lang, t) GROUP BY ALL),
sizes AS MATERIALIZED (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(total, 0) + v) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes ON sizes.lang = g.lang LEFT JOIN totals ON totals.lang = g.lang AND totals.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
q AS MATERIALIZED (
  SELECT lang, t, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang)::BIGINT + v) AS q
  FROM (SELECT lang, t, sum(n)::BIGINT AS n FROM counts GROUP BY ALL) JOIN sizes USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
terms AS (SELECT lang, source, t AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
QUALIFY part = 'pair' OR rank <= 200
"""


@_query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), settle(spark).read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
