"""The engine's operators as queries over the driver's tables, each with the same query in SQL.

Documents are chunks of one-chunk files (author = source), conversations are documents of ordered
chunks, embeddings are vectors whose label is their document, benchmark items are search texts,
labels are judgements, pages are files of no known format, events are samples of power.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import vectors as V
from .functions.order import natural_key
from .operators import dense, diversity, evaluation, expansion, fusion, grouping, lexical, predicates, sampling
from .plans import compat, sync
from .schema import content_hash
from .sources import discover, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("author"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"), "text", "lang", "n_chars")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("file_path"))


#: Searches take every row whose id is divisible by this as a query, against all rows.
EVERY = 50


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# Dense retrieval

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
L2 = "list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _dense_sql(distance: str, score: str, queries: str = "q.vec_id % 50 = 0", where: str = "TRUE", after: str = "TRUE") -> str:
    return f"""
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label, {distance} AS d FROM embeddings e, embeddings q WHERE {queries} AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), chunk_id) - 1 AS k FROM d)
SELECT query_id, chunk_id, k::INT AS dense_rank, round(d, {DIGITS}) + 0.0 AS dense_distance, round({score}, {DIGITS}) AS score FROM r WHERE k < 10 AND {after}"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", F.col("dense_rank").cast("int").alias("dense_rank"), (F.round("dense_distance", DIGITS) + 0.0).alias("dense_distance"), F.round("score", DIGITS).alias("score"))


@query(_dense_sql(f"1 - {COS}", "1 - d"))
def dense_topk_cosine(spark, sf_dir):
    return _shown(dense.topk(vectors_of(spark, sf_dir), vector_queries(spark, sf_dir), 10))


@query(_dense_sql(f"1 - {DOT}", "1 - d"))
def dense_topk_dot(spark, sf_dir):
    return _shown(dense.topk(vectors_of(spark, sf_dir), vector_queries(spark, sf_dir), 10, "dot"))


@query(_dense_sql(L2, "1 / (1 + d)"))
def dense_topk_l2(spark, sf_dir):
    return _shown(dense.topk(vectors_of(spark, sf_dir), vector_queries(spark, sf_dir), 10, "l2"))


@query(_dense_sql(f"1 - {COS}", "1 - d", where="e.label % 2 = 1"))
def dense_prefilter(spark, sf_dir):
    return _shown(dense.topk(vectors_of(spark, sf_dir), vector_queries(spark, sf_dir), 10, filter_sql="file_path % 2 = 1"))


@query(_dense_sql(f"1 - {COS}", "1 - d", after="label % 2 = 1"))
def dense_postfilter(spark, sf_dir):
    return _shown(dense.topk(vectors_of(spark, sf_dir), vector_queries(spark, sf_dir), 10, filter_sql="file_path % 2 = 1", prefilter=False, keep=("file_path",)))


@query(_dense_sql(f"1 - {COS}", "1 - d"))
def dense_multi_query(spark, sf_dir):
    return _shown(dense.topk(vectors_of(spark, sf_dir), vector_queries(spark, sf_dir), 10))


@query(_dense_sql(f"1 - {COS}", "1 - d"))
def dense_cells_all_probed(spark, sf_dir):
    celled, centres = dense.build_cells(vectors_of(spark, sf_dir), 8)
    return _shown(dense.search_cells(celled, centres, vector_queries(spark, sf_dir), 10, nprobes=8))


@query(_dense_sql(f"1 - {COS}", "1 - d"))
def dense_topk_cosine_all(spark, sf_dir):
    return dense_topk_cosine(spark, sf_dir)


# Lexical retrieval

TERMS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
POSTINGS = f"""
t AS (SELECT doc_id AS chunk_id, {TERMS.format('text')} AS w, source FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM t),
f AS (SELECT chunk_id, dl, term, count(*) AS tf FROM p GROUP BY ALL)"""


def _bm25(queries: str = "item_id % 50 = 0", where: str = "TRUE") -> str:
    return f"""{POSTINGS},
q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark WHERE {queries}),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
b AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS x FROM f JOIN df USING (term) JOIN q USING (term), s WHERE chunk_id IN (SELECT chunk_id FROM t WHERE {where}) GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) - 1 AS lk FROM b)"""


LEXICAL_OUT = f"SELECT query_id, chunk_id, round(x, {DIGITS}) AS lexical_score, lk::INT AS lexical_rank FROM l WHERE lk < 10"


def _lexical(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", F.round("lexical_score", DIGITS).alias("lexical_score"), F.col("lexical_rank").cast("int").alias("lexical_rank"))


@query(f"WITH {_bm25()} {LEXICAL_OUT}")
def lexical_bm25(spark, sf_dir):
    return _lexical(lexical.bm25(chunks_of(spark, sf_dir), text_queries(spark, sf_dir), 10))


@query(f"WITH {_bm25(where="source IN ('src1', 'src2')")} {LEXICAL_OUT}")
def lexical_filtered(spark, sf_dir):
    return _lexical(lexical.bm25(chunks_of(spark, sf_dir), text_queries(spark, sf_dir), 10, "author IN ('src1', 'src2')"))


@query(f"WITH {_bm25()} {LEXICAL_OUT}")
def lexical_bm25_all(spark, sf_dir):
    return lexical_bm25(spark, sf_dir)


@query("SELECT 0::BIGINT AS query_id, doc_id AS chunk_id, 0.0::DOUBLE AS lexical_score, 0 AS lexical_rank FROM documents WHERE FALSE")
def lexical_unknown_term(spark, sf_dir):
    asked = spark.createDataFrame([(0, "qqxxyyzzq?! --")], "query_id long, query string")
    return _lexical(lexical.bm25(chunks_of(spark, sf_dir), asked, 10))


@query(f"WITH {POSTINGS} SELECT term, chunk_id, tf, dl AS doc_len FROM f")
def postings(spark, sf_dir):
    return lexical.postings(chunks_of(spark, sf_dir))


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df FROM f GROUP BY term")
def term_document_frequency(spark, sf_dir):
    return lexical.document_frequency(lexical.postings(chunks_of(spark, sf_dir)))


@query(f"WITH {POSTINGS} SELECT n AS n_docs, round(avgdl, 6) AS avg_len FROM s")
def lexical_corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(chunks_of(spark, sf_dir)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


# Fusion: query i is benchmark item i with the vector of vec_id i; chunks are documents with a vector

HYBRID = f"""{_bm25(where="chunk_id IN (SELECT vec_id FROM embeddings)")},
dd AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, 1 - {COS} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id IN (SELECT doc_id FROM documents)),
dk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), chunk_id) - 1 AS k FROM dd),
dn AS (SELECT *, 1 - d AS s FROM dk WHERE k < 40), lx AS (SELECT * FROM l WHERE lk < 40)"""


def _parts(spark: SparkSession, sf_dir: str, depth: int = 40) -> tuple[DataFrame, DataFrame]:
    chunks = chunks_of(spark, sf_dir)
    ids = vectors_of(spark, sf_dir).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    near = dense.topk(ids, vector_queries(spark, sf_dir), depth).select("query_id", "chunk_id", "dense_distance", "dense_rank", "score")
    words = lexical.bm25(chunks, text_queries(spark, sf_dir), depth, allowed=ids)
    return near, words.select("query_id", "chunk_id", "lexical_score", "lexical_rank")


def _fused(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", F.round("score", DIGITS).alias("score"), F.col("rank").cast("int").alias("rank"))


def _fused_sql(score: str, n: int = 10) -> str:
    return f"""WITH {HYBRID},
mm AS (SELECT query_id, min(s) AS a, max(s) AS b FROM dn GROUP BY 1), ml AS (SELECT query_id, min(x) AS a, max(x) AS b FROM lx GROUP BY 1),
j AS (SELECT coalesce(dn.query_id, lx.query_id) AS query_id, coalesce(dn.chunk_id, lx.chunk_id) AS chunk_id, k, s, lk, x FROM dn FULL JOIN lx ON dn.query_id = lx.query_id AND dn.chunk_id = lx.chunk_id),
z AS (SELECT j.query_id, chunk_id, {score} AS score FROM j LEFT JOIN mm ON j.query_id = mm.query_id LEFT JOIN ml ON j.query_id = ml.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM z)
SELECT query_id, chunk_id, round(score, {DIGITS}) AS score, rank::INT AS rank FROM r WHERE rank < {n}"""


RRF_SQL = _fused_sql("coalesce(1.0::DOUBLE / (61 + k), 0) + coalesce(1.0::DOUBLE / (61 + lk), 0)")


@query(RRF_SQL)
def hybrid_rrf(spark, sf_dir):
    return _fused(fusion.rrf(*_parts(spark, sf_dir), limit=10))


@query(_fused_sql("coalesce(5.0::DOUBLE / (21 + k), 0) + coalesce(1.0::DOUBLE / (21 + lk), 0)"))
def hybrid_rrf_weighted(spark, sf_dir):
    return _fused(fusion.rrf(*_parts(spark, sf_dir), k=20, dense_weight=5.0, limit=10))


@query(_fused_sql("0.5 * coalesce((s - mm.a) / (mm.b - mm.a), 0) + 0.5 * coalesce((x - ml.a) / (ml.b - ml.a), 0)"))
def hybrid_linear(spark, sf_dir):
    return _fused(fusion.linear(*_parts(spark, sf_dir), alpha=0.5, limit=10))


@query(f"WITH {HYBRID} SELECT query_id, count(*) AS total_candidates FROM (SELECT query_id, chunk_id FROM dn UNION SELECT query_id, chunk_id FROM lx) GROUP BY 1")
def hybrid_total_candidates(spark, sf_dir):
    return fusion.merged(*_parts(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("total_candidates"))


# Diversity

def _pool(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    found = dense.topk(vectors_of(spark, sf_dir), vector_queries(spark, sf_dir), n, keep=("file_path", "vector"))
    asked = vector_queries(spark, sf_dir)
    return found.withColumn("rank", F.col("dense_rank")).join(asked, "query_id")


POOL_SQL = f"""p AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label::VARCHAR AS file_path, e.embedding::DOUBLE[] AS v, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - s, 9), chunk_id) - 1 AS pos FROM p QUALIFY pos < 40),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY pos) AS n FROM k)"""


def _mmr_sql(weight: float) -> str:
    return f"""
WITH RECURSIVE {POOL_SQL},
m(query_id, step, picked, last) AS (
  SELECT DISTINCT query_id, 0, [0::BIGINT], 0::BIGINT FROM k UNION ALL
  SELECT m.query_id, step + 1, list_append(picked, n.pos), n.pos FROM m, LATERAL (
    SELECT a.pos FROM k a WHERE a.query_id = m.query_id AND NOT list_contains(picked, a.pos)
    ORDER BY round({weight} * a.s - {1 - weight} * (SELECT max(list_cosine_similarity(a.v, b.v)) FROM k b WHERE b.query_id = a.query_id AND list_contains(picked, b.pos)), 7) DESC, a.pos LIMIT 1) n
  WHERE step < 9)
SELECT k.query_id, k.chunk_id, m.step::INT AS rank FROM m JOIN k ON k.query_id = m.query_id AND k.pos = m.last"""


def _mmr(spark, sf_dir, weight):
    return diversity.mmr(_pool(spark, sf_dir), weight, 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


@query(_mmr_sql(0.7))
def mmr_rerank_07(spark, sf_dir):
    return _mmr(spark, sf_dir, 0.7)


@query(_mmr_sql(0.4))
def mmr_rerank_04(spark, sf_dir):
    return _mmr(spark, sf_dir, 0.4)


@query(_mmr_sql(1.0))
def mmr_rerank_10(spark, sf_dir):
    return _mmr(spark, sf_dir, 1.0)


def _capped_sql(condition: str) -> str:
    return f"WITH {POOL_SQL} SELECT query_id, chunk_id, file_path, (row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1)::INT AS rank FROM c WHERE {condition}"


@query(_capped_sql("n <= 2"))
def cap_per_document(spark, sf_dir):
    return diversity.cap_per_document(_pool(spark, sf_dir), 2).select("query_id", "chunk_id", "file_path", F.col("rank").cast("int").alias("rank"))


@query(_capped_sql("n = 1"))
def rollup_best(spark, sf_dir):
    return diversity.rollup_best(_pool(spark, sf_dir)).select("query_id", "chunk_id", "file_path", F.col("rank").cast("int").alias("rank"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as ranked chunks: longer turns rank first."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    one = c.select(F.lit(0).alias("query_id"), F.col("conv_id").alias("file_path"), F.col("turn").alias("chunk_index"), "role", "text", F.length("text").cast("double").alias("score"), F.length("text").cast("long").alias("token_count"), F.lit("prose").alias("chunk_kind"))
    return grouping.positions(one, "rank", ["query_id"], {"score": "desc"}, [F.col("file_path"), F.col("chunk_index")])


@query(r"""
WITH c AS (SELECT conv_id, turn, role, text, length(text) AS s FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
k AS (SELECT *, row_number() OVER (ORDER BY s DESC, conv_id, turn) - 1 AS rank FROM c),
g AS (SELECT conv_id AS file_path, arg_max(role, s * 1000000 - rank) AS role, max(s)::DOUBLE AS score, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, rank) AS text, sum(s)::BIGINT AS token_count, min(rank) AS mr FROM k GROUP BY 1)
SELECT file_path, role, score, text, token_count, 'document' AS chunk_kind, (row_number() OVER (ORDER BY mr) - 1)::INT AS rank FROM g""")
def rollup_aggregate(spark, sf_dir):
    return diversity.rollup_aggregate(_turns(spark, sf_dir)).select("file_path", "role", "score", "text", "token_count", "chunk_kind", F.col("rank").cast("int").alias("rank"))


# Context

def _context_sql(w: int) -> str:
    return f"""SELECT a.conv_id AS file_path, a.turn AS chunk_index, string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn, b.text) AS expanded_context
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - {w} AND a.turn + {w} GROUP BY a.conv_id, a.turn, a.role, a.text"""


@query(_context_sql(1))
def context_window_1(spark, sf_dir):
    return expansion.window_of_all(_turns(spark, sf_dir), 1).select("file_path", "chunk_index", "expanded_context")


@query(_context_sql(2))
def context_window_2(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return expansion.expand(turns, turns, 2).select("file_path", "chunk_index", "expanded_context")


# Scopes

TAGS = predicates.Tags({"odd": ("src1", "src3"), "teens": ("src1?",), "all": ("src*",)})


def _scoped(spark: SparkSession, sf_dir: str, **scope) -> DataFrame:
    return dense.where(chunks_of(spark, sf_dir), TAGS.sql(**scope)).select("chunk_id", "author")


@query("SELECT doc_id AS chunk_id, source AS author FROM documents WHERE source = 'src1'")
def folder_filter(spark, sf_dir):
    return _scoped(spark, sf_dir, folder="src1")


@query("SELECT doc_id AS chunk_id, source AS author FROM documents WHERE regexp_full_match(source, 'src1.')")
def folder_glob(spark, sf_dir):
    return _scoped(spark, sf_dir, folder="src1?")


@query("SELECT doc_id AS chunk_id, source AS author FROM documents WHERE source IN ('src1', 'src3') OR regexp_full_match(source, 'src1.')")
def tag_filter(spark, sf_dir):
    return chunks_of(spark, sf_dir).where(TAGS.column(tags=["odd", "teens"])).select("chunk_id", "author")


@query("SELECT doc_id AS chunk_id, source AS author FROM documents WHERE source LIKE 'src%' AND source IN ('src1', 'src3') AND (n_chars > 500)")
def combined_filter(spark, sf_dir):
    return _scoped(spark, sf_dir, folder="src*", tags=["odd"], condition="n_chars > 500")


@query("SELECT DISTINCT source AS folder, CASE WHEN source IN ('src1', 'src3') THEN 'all,odd' WHEN regexp_full_match(source, 'src1.') THEN 'all,teens' ELSE 'all' END AS tags FROM documents WHERE source IS NOT NULL")
def folder_tags(spark, sf_dir):
    folders = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("folder")).distinct()
    return folders.select("folder", F.array_join(TAGS.tags_of("folder"), ",").alias("tags"))


# Presentation

def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as results of one query."""
    c = chunks_of(spark, sf_dir)
    path = F.concat(F.lit("root/"), "author", F.lit("/Part "), F.pmod("chunk_id", F.lit(12)).cast("string"), F.lit(".md"))
    return c.select(F.lit(0).alias("query_id"), "chunk_id", "author", path.alias("file_path"), F.col("chunk_id").alias("chunk_index"), F.col("n_chars").cast("double").alias("score"), X.folder_of(path, archive_root="root").alias("folder"))


HITS_SQL = "WITH h AS (SELECT doc_id AS chunk_id, source AS folder, doc_id % 12 AS part, n_chars::DOUBLE AS score FROM documents)"


@query(f"{HITS_SQL} SELECT folder, count(*) AS hits, count(DISTINCT part) AS documents FROM h GROUP BY 1")
def folder_rows(spark, sf_dir):
    return grouping.folder_rows(_hits(spark, sf_dir))


ORDER_SQL = f"{HITS_SQL}, b AS (SELECT *, max(score) OVER (PARTITION BY folder) AS best FROM h), o AS (SELECT *, row_number() OVER (ORDER BY best DESC, folder, part, chunk_id) - 1 AS position FROM b)"


@query(f"{ORDER_SQL} SELECT chunk_id, folder, position::INT AS position FROM o")
def group_by_folder_order(spark, sf_dir):
    return grouping.grouped_order(_hits(spark, sf_dir)).select("chunk_id", "folder", F.col("position").cast("int").alias("position"))


@query(f"{ORDER_SQL}, f AS (SELECT *, min(position) OVER (PARTITION BY folder, part) AS first FROM o), n AS (SELECT *, dense_rank() OVER (PARTITION BY folder ORDER BY first) AS i FROM f) SELECT chunk_id, i::INT AS document_index, (max(i) OVER (PARTITION BY folder))::INT AS document_total FROM n")
def document_position(spark, sf_dir):
    placed = grouping.document_places(grouping.grouped_order(_hits(spark, sf_dir)))
    return placed.select("chunk_id", F.col("document_index").cast("int").alias("document_index"), F.col("document_total").cast("int").alias("document_total"))


@query(SQL["folder_rows"])
def folder_rows_all(spark, sf_dir):
    return folder_rows(spark, sf_dir)


@query(SQL["group_by_folder_order"])
def group_by_folder_order_all(spark, sf_dir):
    return group_by_folder_order(spark, sf_dir)


@query(SQL["document_position"])
def document_position_all(spark, sf_dir):
    return document_position(spark, sf_dir)


@query("SELECT doc_id AS chunk_id, (row_number() OVER (ORDER BY doc_id % 12, doc_id // 12 % 30, doc_id) - 1)::INT AS place FROM documents")
def natural_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    path = F.concat(F.lit("Day "), F.pmod("chunk_id", F.lit(12)).cast("string"), F.lit("/part-"), F.pmod(F.floor(F.col("chunk_id") / 12), F.lit(30)).cast("string"), F.lit("/"), F.col("chunk_id").cast("string"), F.lit(".md"))
    keyed = d.select("chunk_id", natural_key(path).alias("k"), natural_key(F.substring_index(path, "/", 2)).alias("folder"))
    return grouping.positions(keyed, "place", [], {"folder": "asc"}, [F.col("k"), F.col("chunk_id")]).select("chunk_id", F.col("place").cast("int").alias("place"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Line ' || (turn + 1) WHEN 1 THEN 'Lines ' || turn || '-' || (turn + 5) WHEN 2 THEN 'Page ' || turn ELSE 'Image file' END AS label FROM conversations WHERE turn IS NOT NULL")
def locator_label(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("turn IS NOT NULL")
    t, kind = F.col("turn"), F.element_at(F.array(F.lit("markdown"), F.lit("markdown"), F.lit("page"), F.lit("image_file")), (F.col("turn") % 4 + 1).cast("int"))
    json = F.when(t % 4 == 0, F.format_string('{"line_range":[%d,%d]}', t + 1, t + 1)).when(t % 4 == 1, F.format_string('{"line_range":[%d,%d]}', t, t + 5)).when(t % 4 == 2, F.format_string('{"page":%d}', t)).otherwise("{}")
    return c.select("conv_id", "turn", X.locator_label(kind, json).alias("label"))


@query("SELECT conv_id, turn, '[Folder: ' || role || '] -> [Doc 1/2: ' || conv_id || '.md] -> [Chunk #' || turn || ' | Page ' || turn || ']' AS crumb FROM conversations WHERE turn IS NOT NULL")
def breadcrumb(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("turn IS NOT NULL")
    return c.select("conv_id", "turn", X.breadcrumb(F.col("role"), F.lit(1), F.lit(2), F.concat("conv_id", F.lit(".md")), F.col("turn"), F.concat(F.lit("Page "), "turn")).alias("crumb"))


# Text

@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[ \t\n\r]+', ' ', 'g')) AS t FROM documents")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalise(F.col("text")).alias("t"))


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, t[1:200] AS h FROM l),
c AS (SELECT *, 200 - strpos(reverse(h), ' ') AS p FROM h)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE rtrim(CASE WHEN contains(h, ' ') AND p >= 100 THEN h[1:p] ELSE h END) || '...' END AS s FROM c""")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text")).alias("s"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g')) AS k FROM documents")
def dedup_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.dedup_key(F.col("text")).alias("k"))


#: Tokens that are read alike by both readers but for signs and brackets, and two that only look so.
READ, CHECKED = " 7:30 2.0. $1,000 [4.0]", ("1", "730", "2.0", "1,000", "(4.0)")


@query(rf"""WITH k AS (SELECT doc_id, list_filter(string_split(text || '{READ}', ' '), lambda t: NOT regexp_matches(t, '[0-9]')
  OR lower(trim(replace(replace(replace(replace(replace(replace(t, '$', ''), '€', ''), '£', ''), '¥', ''), '%', ''), ',', ''), '()[]{{}}''" ' || chr(9) || chr(10) || chr(13))) IN ('1', '730', '2.0', '1000', '4.0')) AS k FROM documents)
SELECT doc_id, array_to_string(k, ' ') AS kept FROM k""")
def numeric_token_filter(spark, sf_dir):
    tokens = F.split(F.concat("text", F.lit(READ)), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.numeric_tokens(tokens, F.array(*map(F.lit, CHECKED))), " ").alias("kept"))


@query(SQL["numeric_token_filter"])
def numeric_token_filter_all(spark, sf_dir):
    return numeric_token_filter(spark, sf_dir)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'title: ' || source || ' | text: ' || text ELSE 'title: none | text: ' || text END AS prompt FROM documents")
def document_template(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.render_template("title: {title} | text: {content}", F.col("text"), F.when(F.col("lang") == "en", F.col("source"))).alias("prompt"))


@query(r"""WITH w AS (SELECT doc_id, text, text[1:501] AS w FROM documents),
e AS (SELECT *, regexp_extract(w, '(?s)^(.*[.!?]["''”’)]?\s)', 1) AS e, regexp_extract(w, '(?s)^(.*) ', 1) AS b FROM w)
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE regexp_replace(CASE WHEN length(e) >= 260 THEN e ELSE b END, '^\s+|\s+$', '', 'g') END AS t FROM e""")
def excerpt_cap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.cap(F.col("text")).alias("t"))


@query(SQL["excerpt_cap"])
def excerpt_cap_all(spark, sf_dir):
    return excerpt_cap(spark, sf_dir)


# Sampling and composition

@query(r"""WITH k AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g')) AS k FROM documents), s AS (SELECT k FROM k GROUP BY k HAVING count(DISTINCT source) = 1)
SELECT doc_id, source FROM k WHERE k IN (SELECT k FROM s)""")
def repeated_across_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return sampling.only_in_one(d, X.dedup_key(F.col("text")), "source").select("doc_id", "source")


@query(SQL["repeated_across_sources"])
def repeated_across_sources_whole(spark, sf_dir):
    return repeated_across_sources(spark, sf_dir)


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT DISTINCT source, (n * (2 * j + 1)) // 14 AS i FROM p, range(7) r(j))
SELECT p.doc_id, p.source FROM p LEFT JOIN s ON p.source IS NOT DISTINCT FROM s.source AND p.i = s.i WHERE n <= 7 OR s.i IS NOT NULL""")
def stride_positions(spark, sf_dir):
    return sampling.stride_sample(table(spark, sf_dir, "documents"), "source", ["doc_id"], 7).select("doc_id", "source")


@query("""WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), a AS (SELECT lang, size, least(size, greatest(20, round_even(100.0 * size / sum(size) OVER (), 0)))::BIGINT AS w FROM s)
SELECT lang, size, CASE WHEN row_number() OVER (ORDER BY size DESC, lang) = 1 THEN least(size, w + 100 - sum(w) OVER ())::BIGINT ELSE w END AS wanted FROM a""")
def stratified_allocation(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("size"))
    return sampling.allocate(sizes, "lang", "size", 100, 20)


@query("SELECT source, count(*) AS chunks, min(length(text)) AS least, max(length(text)) AS greatest, round(avg(length(text)), 6) AS mean, sum(length(text))::BIGINT AS total FROM documents GROUP BY 1")
def composition_stats(spark, sf_dir):
    out = evaluation.composition(table(spark, sf_dir, "documents"), "source", F.length("text").cast("long"))
    return out.withColumn("mean", F.round("mean", 6))


# Evaluation

@query(f"""WITH a AS (WITH {_bm25()} {LEXICAL_OUT}), g AS (SELECT DISTINCT doc_id AS chunk_id FROM labels WHERE quality = 1), q AS (SELECT item_id AS query_id FROM benchmark WHERE item_id % 50 = 0)
SELECT query_id, round(count(a.chunk_id) / count(*)::DOUBLE, 6) AS recall FROM q CROSS JOIN g LEFT JOIN a USING (query_id, chunk_id) GROUP BY 1""")
def recall_at_k(spark, sf_dir):
    """All documents of good quality are the judgements of every query."""
    asked = text_queries(spark, sf_dir)
    found = lexical.bm25(chunks_of(spark, sf_dir), asked, 10).withColumn("rank", F.col("lexical_rank"))
    judged = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return evaluation.recall_of_shared(found, asked, judged, 10).select("query_id", F.round("recall", 6).alias("recall"))


@query(SQL["recall_at_k"])
def recall_at_k_all(spark, sf_dir):
    return recall_at_k(spark, sf_dir)


#: The SQL's own list of the words that say nothing about a subject.
STOPS = (
    "'a','about','after','all','also','an','and','any','are','as','at','be','because','been','before','being','but','by','can','could','did','do','does','doing','down','during','each','few',"
    "'for','from','further','had','has','have','having','he','her','here','hers','him','his','how','i','if','in','into','is','it','its','itself','just','me','more','most','my','no','nor','not',"
    "'of','off','on','once','only','or','other','our','out','over','own','same','she','should','so','some','such','than','that','the','their','them','then','there','these','they','this','those',"
    "'through','to','too','under','until','up','very','was','we','were','what','when','where','which','while','who','whom','why','will','with','would','you','your'"
)
SUBJECT = "SELECT DISTINCT {id} AS i, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({stops}))) AS term FROM {t}"
IDF_SQL = f"""t AS ({SUBJECT.format(id='doc_id', stops=STOPS, t='documents')}),
f AS (SELECT term, count(*) AS df, ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))::DOUBLE) AS idf FROM t GROUP BY 1)"""


@query(f"WITH {IDF_SQL} SELECT term, df, round(idf, 6) AS idf FROM f")
def term_idf(spark, sf_dir):
    return evaluation.term_idf(table(spark, sf_dir, "documents")).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {IDF_SQL}, q AS ({SUBJECT.format(id='item_id', stops=STOPS, t='benchmark')} WHERE item_id % 50 = 0),
s AS (SELECT q.i AS query_id, t.i AS chunk_id, sum(idf) AS x FROM t JOIN q USING (term) JOIN f USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) - 1 AS rank FROM s)
SELECT query_id, chunk_id, round(x, 6) AS score, rank::INT AS rank FROM r WHERE rank < 5""")
def idf_ranking(spark, sf_dir):
    found = evaluation.idf_rank(chunks_of(spark, sf_dir), text_queries(spark, sf_dir), 5)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS percentile FROM events GROUP BY 1")
def latency(spark, sf_dir):
    out = evaluation.latency(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("median", 6).alias("median"), F.round("percentile", 6).alias("percentile"))


@query("SELECT user_id, CASE WHEN sum(value) > 0 THEN round(count(*) / sum(value), 6) END AS per_second FROM events GROUP BY 1")
def throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return e.select("user_id", F.round(evaluation.throughput(F.col("n"), F.col("s")), 6).alias("per_second"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type <> 'error' THEN value END AS w, event_id FROM events),
s AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t) - t, 0) AS d FROM e)
SELECT user_id, round(coalesce(sum(w * d), 0), 3) AS joules, round(sum(CASE WHEN w IS NOT NULL THEN d ELSE 0 END), 3) AS measured_s, round(sum(CASE WHEN w IS NULL THEN d ELSE 0 END), 3) AS unmeasured_s, count(w) AS reported, count(*) - count(w) AS missed FROM s GROUP BY 1""")
def energy_integral(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_seconds"), F.when(F.col("event_type") != "error", F.col("value")).alias("watts"))
    out = evaluation.energy(e, "user_id")
    return out.select("user_id", *(F.round(c, 3).alias(c) for c in ("joules", "measured_s", "unmeasured_s")), "reported", "missed")


# Vectors

@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)")
def l2_normalise(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalise(V.doubles("embedding")).alias("v"))
    return v.select("vec_id", F.round(V.dot(F.col("v"), F.col("v")), 6).alias("length"), F.round(F.element_at("v", 1), 6).alias("first"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("row_id"), F.col("vec_id").alias("token_pos"), (F.col("vec_id") % 3 != 0).alias("attended"), "embedding")


@query("""WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 3 <> 0)
SELECT label AS row_id, i::INT AS place, round(avg(x), 6) AS x FROM u GROUP BY ALL""")
def masked_mean_pool(spark, sf_dir):
    pooled = V.pool(_tokens(spark, sf_dir), "row_id")
    return pooled.select("row_id", F.posexplode("vector").alias("p", "x")).select("row_id", (F.col("p") + 1).alias("place"), F.round("x", 6).alias("x"))


@query("""WITH f AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY 1)
SELECT label AS row_id, unnest(generate_series(1, 64))::INT AS place, round(unnest(v), 6) AS x FROM f""")
def cls_pool(spark, sf_dir):
    pooled = V.pool(_tokens(spark, sf_dir), "row_id", "cls")
    return pooled.select("row_id", F.posexplode("vector").alias("p", "x")).select("row_id", (F.col("p") + 1).alias("place"), F.round("x", 6).alias("x"))


@query("SELECT vec_id, round(greatest(2 * embedding[1]::DOUBLE + 0.5, 0), 6) AS y1, round(greatest(2 * embedding[2]::DOUBLE + 0.5, 0), 6) AS y2 FROM embeddings")
def dense_relu(spark, sf_dir):
    import numpy as np

    weight = np.zeros((2, 64))
    weight[0, 0] = weight[1, 1] = 2.0
    y = V.dense(V.doubles("embedding"), [V.DenseStage(weight, np.array([0.5, 0.5]), "relu")])
    return table(spark, sf_dir, "embeddings").select("vec_id", y.alias("y")).select("vec_id", F.round(F.element_at("y", 1), 6).alias("y1"), F.round(F.element_at("y", 2), 6).alias("y2"))


# Store, synchronisation and ingestion

OLD = "doc_id % 5 <> 0"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks before and after: a fifth is new, a seventh changed, an eleventh gone."""
    c = chunks_of(spark, sf_dir).select("chunk_id", "file_path", "text").withColumn("title", F.lit(None).cast("string"))
    old = c.where("chunk_id % 5 <> 0")
    new = c.where("chunk_id % 11 <> 1").withColumn("text", F.when(F.col("chunk_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return old, new


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM documents WHERE doc_id % 11 <> 1")
def sync_diff(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return sync.diff(new, old).select("chunk_id", "change")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 = 1")
def deleted_set(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return sync.removed(old, new).select("chunk_id")


@query("SELECT doc_id AS chunk_id, text || CASE WHEN doc_id % 11 <> 1 AND doc_id % 7 = 0 THEN ' edited' ELSE '' END AS text FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 11 <> 1")
def upsert_result(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return store.upserted(old, new).select("chunk_id", "text")


@query("SELECT doc_id AS chunk_id FROM documents WHERE NOT coalesce(n_chars > 2000, FALSE)")
def delete_by_predicate(spark, sf_dir):
    return store.without(chunks_of(spark, sf_dir), "n_chars > 2000").select("chunk_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents")
def classify_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("r").alias("root_id"), F.col("doc_id").cast("string").alias("relative_path"), content_hash("text").alias("content_hash"), F.lit("p").alias("params_fingerprint"))
    known = d.where("doc_id % 5 <> 0").drop("doc_id").withColumn("content_hash", F.when(F.col("relative_path").cast("long") % 7 == 0, F.lit("x")).otherwise(F.col("content_hash")))
    return sync.classify(d, known).select("doc_id", "status")


@query("SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'm:64' ELSE '' END, '') AS model_identity, count(*) AS n FROM documents GROUP BY 1")
def identity_counts(spark, sf_dir):
    c = table(spark, sf_dir, "documents").withColumn("model_identity", F.when(F.col("doc_id") % 3 == 1, F.lit("m:64")).when(F.col("doc_id") % 3 == 2, F.lit("")))
    return compat.identity_counts(c)


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS documents, 'm:64' AS identities, count(*) FILTER (doc_id % 3 <> 1) AS unstamped FROM documents")
def index_stats(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.when(F.col("doc_id") % 3 == 1, F.lit("m:64")).alias("model_identity"))
    return store.stats(c).select("chunks", "documents", F.array_join("identities", ",").alias("identities"), "unstamped")


@query("SELECT 'unsupported' AS category, count(*) AS n FROM pages HAVING count(*) > 0")
def omission_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return discover.omission_counts(discover.unsupported(discover.routed(p)))


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'pdf' ELSE 'excel' END AS route FROM documents")
def route_formats(spark, sf_dir):
    d, r = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    ext = F.when(r == 0, ".TXT").when(r == 1, ".markdown").when(r == 2, ".txt").otherwise(".docx")
    head = F.when(r == 2, F.lit("%PDF-1.7 ")).when(r == 3, F.lit("PK\x03\x04")).otherwise("")
    files = d.select("doc_id", F.concat(F.lit("/a/"), "doc_id", ext).alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    return discover.routed(files).select(F.col("doc_id").alias("id"), "route")


@query("SELECT doc_id, source AS author FROM documents WHERE regexp_full_match(source || '/' || doc_id || '.txt', 'src[^/]*/1[^/]*[.]txt') AND source <> 'src2'")
def glob_include_exclude(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("relative_path"))
    return d.where(discover.accepted(F.col("relative_path"), ["src*/1*.txt"], ["**/src2/**", "src2/*"])).select("doc_id", discover.author(F.col("relative_path")).alias("author"))


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text").cast("binary")).alias("h"))


@query("""SELECT doc_id, sha256('{"kind":"prose","locator":{"page":1},"ordinal":' || doc_id || ',"params":"p","relative_path":"' || source || '/' || doc_id || '.txt","root_id":"r"}') AS chunk_id FROM documents""")
def chunk_id_hash(spark, sf_dir):
    from .plans.chunk import chunk_id_column

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", chunk_id_column(F.lit("r"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")), F.lit("prose"), F.lit('{"page":1}'), F.col("doc_id"), F.lit("p")).alias("chunk_id"))


@query()
def chunk_documents(spark, sf_dir):
    from .plans.chunk import chunk_segments, text_segments
    from .schema import IngestParams

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.lit("r").alias("root_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("relative_path"), F.col("source").alias("author"), "text")
    return chunk_segments(text_segments(d, by_paragraph=True), IngestParams(token_budget=200, prose_overlap_tokens=16)).select("chunk_id", "relative_path", "chunk_index", "token_count", "truncated", "text")


@query()
def hybrid_full_pipeline(spark, sf_dir):
    from .plans.search import Options, search

    chunks = chunks_of(spark, sf_dir).join(vectors_of(spark, sf_dir).select("chunk_id", "vector"), "chunk_id").withColumn("chunk_index", F.lit(0).cast("long")).withColumn("token_count", F.col("n_chars")).withColumn("chunk_kind", F.lit("prose"))
    asked = text_queries(spark, sf_dir).join(vector_queries(spark, sf_dir), "query_id")
    found = search(chunks, asked, Options(mode="hybrid", limit=5, max_chunks_per_document=1, mmr_diversity=0.3, context_window=1))
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), F.length("expanded_context").alias("context_chars"))
