"""The registered queries of this subpackage: each reads its whole table and returns the operator's full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm import ann, bpe, chat, digest, divergence, html, interaction, lines, mixing, quality, simhash, substrings, transducer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, _table(spark, sf_dir, "labels")))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    # the added conversation rides on the first scan as two rows of a one-row range
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), said.alias("text")
    )
    return chat.format_conversations(given.unionByName(added)).drop("fault")


def op6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints_with_edits(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Windows as rows: fine for small tables.
_REPEATS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS k FROM w, unnest(range(1, len(ws) - 33)) AS g(i)),
c AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
m AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p SEMI JOIN c ON p.k = c.k),
t AS (SELECT doc_id, j, ws[j] AS word FROM w, unnest(range(1, len(ws) + 1)) AS g(j)),
k AS (SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY t.j) AS kept FROM t ANTI JOIN m ON t.doc_id = m.doc_id AND t.j = m.j GROUP BY t.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  sum(20 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""
#: What the trained model should give on pages that mark their article as the given ones do.
_PAGES = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1|h2|li|ul|div)[^>]*>|<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM b
"""


#: Thresholds as sums over ordered hashes; the level of the shares by rounds, as many as ever are needed here.
_MIX = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 16) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT 0 AS n, 0.0::DOUBLE AS level UNION ALL
  SELECT n + 1, (SELECT coalesce((1.5 * sum(source_size)::DOUBLE - coalesce(sum(2.0 * source_size) FILTER (2.0 * source_size < level * w), 0)::DOUBLE) / sum(w) FILTER (2.0 * source_size >= level * w), level) FROM s) FROM r WHERE n < 40),
t AS (SELECT source, source_size, CASE WHEN 2.0 * source_size < level * w THEN 2.0 * source_size ELSE level * w END::DOUBLE AS target FROM s, (SELECT level FROM r WHERE n = 40)),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS passes FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target - passes * source_size ELSE 0 END AS rest FROM p),
g AS (SELECT source, h, sum(size) AS held FROM d GROUP BY source, h),
c AS (SELECT source, h, held, sum(held) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
b AS (SELECT c.source, h AS bound, rest - (upto - held) AS missing, held AS tied FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source WHERE rest > 0 AND upto >= rest AND upto - held < rest)
SELECT doc_id, size, source_size, target, least(passes * size + CASE WHEN bound IS NULL OR h > bound THEN 0 WHEN h < bound THEN size ELSE least(size, CAST(round(missing * size / tied) AS BIGINT)) END, 2 * size)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

#: Every term of every pair of sources, by the formula.
_DIVERGENCE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d),
k AS (SELECT lang, term, count(*) AS of_all FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(of_all)::HUGEINT AS whole FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (total + v) AS p, 1 + 1000000000::HUGEINT * (of_all + 1) // (whole + v) AS q
  FROM s JOIN k ON s.lang = k.lang JOIN v ON s.lang = v.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
  coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON x.term = y.term AND x.lang = y.lang WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
#: Each order walked through for each mask.
_INTERACTION = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
  regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM w),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT [a.x, b.x, c.x, e.x, g.x] AS o FROM l a, l b, l c, l e, l g WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
t AS (SELECT part, o, s.x AS step, n, good, toxic, fails[o[s.x]] AS failing, len(list_filter(o[1:s.x - 1], lambda i: fails[i])) > 0 AS gone,
  len(list_filter(fails, lambda y: y)) AS many FROM m, o, l s),
r AS (SELECT part, list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order, step, sum(n) FILTER (NOT failing AND NOT gone) AS kept,
  sum(n) FILTER (failing AND NOT gone) AS removed, sum(n) FILTER (failing AND gone) AS redundant, sum(n) FILTER (failing AND many = 1) AS unique_fails,
  sum(good) FILTER (failing AND NOT gone) AS good_lost, sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost FROM t GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0)::BIGINT AS shapley FROM r
"""
_LINES = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM s, unnest(range(1, len(l) + 1)) AS g(i)),
c AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, coalesce(l.doc_id <> first, false) AS dropped FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_repeats, op3_nearest, op4_quality, op5_chat, op6_digest, op7_bpe, op8_mix, op9_counts, op10_html, op11_divergence, op12_interaction, op13_lines)}


def oracle_sql() -> dict[str, str]:
    """The others rest on 64-bit xxHash, trained models, token merges or bit estimates, and are tested by brute force."""
    return {"op2_repeats": _REPEATS, "op5_chat": _CHAT, "op8_mix": _MIX, "op10_html": _PAGES, "op11_divergence": _DIVERGENCE, "op12_interaction": _INTERACTION, "op13_lines": _LINES}
