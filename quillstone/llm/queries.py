"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, jaccard, langid, maxent, media, minmax, mixing, quality, rules, suffix, toxicity, trie
from ._labels import held_out
from ._tables import remainder, settled, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.store_texts(table(spark, sf_dir, "documents")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 10 * i >= 8 * (x.n + y.n - i)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT r, r AS m FROM d UNION SELECT c.r, l.b FROM c JOIN l ON c.m = l.a),
k AS (SELECT c.r, min(d.doc_id) AS class_id FROM c JOIN d ON d.r = c.m GROUP BY 1)
SELECT d.doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = d.r) AS n_links FROM d JOIN k USING (r)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.fit_on(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, unnest(range(0, length(h) // 2 - 199)) AS i, h FROM d WHERE length(h) >= 400),
g AS (SELECT r, i, md5_number(substring(h, 2 * i + 1, 400)) AS g FROM s),
q AS (SELECT r, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
o AS (SELECT *, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM q),
u AS (SELECT *, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM o),
v AS (SELECT r, run, min(i) AS a, max(i) + 200 AS z FROM u GROUP BY 1, 2),
x AS (SELECT r, list({'a': a, 'z': z} ORDER BY a) AS runs, sum(z - a) AS n_removed, count(*) AS n_spans FROM v GROUP BY 1)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN runs IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(runs) + 2), lambda k: substring(h, (2 * CASE WHEN k = 1 THEN 0 ELSE runs[k - 1].z END + 1)::BIGINT, (2 * (CASE WHEN k > len(runs) THEN length(h) // 2 ELSE runs[k].a END - CASE WHEN k = 1 THEN 0 ELSE runs[k - 1].z END))::BIGINT)), '') END)) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""


def op6_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder("doc_id", 5) == 1
    scored = maxent.score_all(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score_texts(documents, toxicity.fit_on(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT_AT).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.ledger(table(spark, sf_dir, "documents"))
    base = rules.passes(rules.BASE)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), rules.passes(rules.POLICIES["strict-1"]).alias("kept"), F.col("failed").alias("failed_bits"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, w, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS e, lead(w, 4) OVER o AS f FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, b, c, e, f) > 1 AS twice FROM g WHERE f IS NOT NULL),
p AS (SELECT DISTINCT r, i + s AS i FROM k, (SELECT unnest([0, 1, 2, 3, 4]) AS s) WHERE twice),
n AS (SELECT r, count(*) AS n_repeat_words FROM p GROUP BY r),
v AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
x AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
      FROM d LEFT JOIN v USING (r) LEFT JOIN n USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 5 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN 10 * n_upper > 5 * word_chars THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits FROM b
"""


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each policy and each of its rules: what fails it, what only it rejects, and what would be kept without it."""
    found = settled(rules.ledger(table(spark, sf_dir, "documents")))
    parts = [rules.ablation(found, p).join(rules.apply_policy(found, p).agg(F.count("*").alias("kept")).select("kept", F.lit(p.version).alias("policy")), "policy") for p in rules.POLICIES.values()]
    return reduce(DataFrame.unionAll, parts)


ABLATION_SQL = f"""
WITH f AS (SELECT failed_bits FROM ({OP8_SQL}) AS ledger),
r(policy, mask, rule, bit) AS (VALUES {", ".join(f"('{p.version}', {p.mask}::BIGINT, '{name}', {rules.BIT[name]}::BIGINT)" for p in rules.POLICIES.values() for name in p.rejects)})
SELECT policy, rule, count(*) FILTER (failed_bits & mask & bit <> 0) AS n_failed, count(*) FILTER (failed_bits & mask = bit) AS n_only, count(*) FILTER (failed_bits & mask = 0 OR failed_bits & mask = bit) AS kept_without, count(*) FILTER (failed_bits & mask = 0) AS kept FROM f, r GROUP BY 1, 2
"""


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = quality.score_texts(documents, quality.fit_on(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 3 * length(d.t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least THEN 'E' ELSE '' END AS fails
      FROM d JOIN m ON m.t = d.t LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || g.x || h.x || i.x AS filter_order FROM x a, x b, x g, x h, x i WHERE len(list_distinct([a.x, b.x, g.x, h.x, i.x])) = 5),
s AS (SELECT filter_order, k AS step, substring(filter_order, k, 1) AS own, substring(filter_order, 1, k - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, fails, translate(fails, before, '') <> fails AS gone, contains(fails, own) AS failing FROM c, s),
t AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
"""


def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_dedup(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT r, r AS m FROM d UNION SELECT c.r, l.b FROM c JOIN l ON c.m = l.a),
k AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.m GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN k USING (r) LEFT JOIN n USING (r)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS no FROM t),
-- h is the CRC-32 of the decimal id, bit by bit, modulo 4
b AS (SELECT c, count(*) AS n, c - c % 20 AS base, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: [ascii(substring(c::VARCHAR, i::BIGINT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS crc FROM o GROUP BY c),
v AS (SELECT b.c, b.n, b.base, xor(b.crc, 4294967295) % 4 AS h, least(xor(b.crc, 4294967295) % 4, coalesce(g.n, 0)) AS m FROM b LEFT JOIN b g ON g.c = b.base),
r AS (SELECT v.c, o.no AS depth, k, words FROM v JOIN o ON o.c = v.base AND o.no <= v.m UNION ALL SELECT v.c, v.m + o.no - v.h, k, words FROM v JOIN o ON o.c = v.c AND o.no > v.h
      UNION ALL SELECT c, 0, '', 0 FROM v),
p AS (SELECT c, depth, words, max(depth) OVER (PARTITION BY c) AS length, md5(string_agg(k, '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth)) AS p FROM r),
a AS (SELECT *, min(c) OVER (PARTITION BY depth, p) AS node, count(*) OVER (PARTITION BY depth, p) AS n FROM p),
x AS (SELECT y.node, y.depth, y.n, y.words, z.node AS parent FROM a y LEFT JOIN a z ON z.c = y.node AND z.depth = y.depth - 1 WHERE y.c = y.node),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM x WHERE parent IS NOT NULL GROUP BY 1, 2),
w AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM x LEFT JOIN k USING (node, depth)),
s AS (SELECT a.node, a.depth, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n - 1) * w.words) AS saved FROM w JOIN a ON a.c = w.node AND a.depth <= w.depth GROUP BY 1, 2),
e AS (SELECT node, depth, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM a WHERE depth = length GROUP BY 1, 2)
SELECT w.node AS conv_id, w.depth::BIGINT AS depth, w.parent AS parent_conv_id, w.n AS n_convs, w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM w JOIN s USING (node, depth) LEFT JOIN e USING (node, depth)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_maxent_scoring": op6_maxent_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "quality_rule_ablation": quality_rule_ablation,
    "op9_source_mix": op9_source_mix,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_filter_audit": op11_filter_audit,
    "op12_minmax_dedup": op12_minmax_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op2_jaccard_join": OP2_SQL, "op5_suffix_dedup": OP5_SQL, "op8_quality_rules": OP8_SQL, "quality_rule_ablation": ABLATION_SQL, "op11_filter_audit": OP11_SQL, "op12_minmax_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
