"""Indexes and runs as queries: vectors by cells and codes, postings in blocks, each beside the scan that it equals or comes near to; reports of what a run did."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cases  # noqa: F401  (for its SQL)
from .functions import text as X
from .operators import ann, dense, evaluation, similar
from .operators.blocks import PostingBlocks
from .plans import embed, report
from .queries import COS, LEXICAL_OUT, POSTINGS, SQL, STOPS, SUBJECT, _bm25, _dense_sql, _lexical, _shown, chunks_of, query, table, text_queries, vector_queries, vectors_of
from .sources.scratch import new_path
from .sources.slots import SlotTable

CELLS, SLOTS = 16, 16


def _index(spark: SparkSession, sf_dir: str) -> ann.Index:
    return ann.build(vectors_of(spark, sf_dir), new_path(spark), CELLS)


@query(_dense_sql(f"1 - {COS}", "1 - d"))
def ann_all_cells(spark, sf_dir):
    """All cells probed, and a list so long that the exact distances decide: the same as a scan."""
    return _shown(_index(spark, sf_dir).search(vector_queries(spark, sf_dir), 10, CELLS, 100))


@query()
def ann_search(spark, sf_dir):
    """With the cells and the list that the index was calibrated to."""
    return _shown(_index(spark, sf_dir).search(vector_queries(spark, sf_dir), 10))


@query()
def ann_recall(spark, sf_dir):
    """nprobes, calibrated, recall against the exact scan: at 1, 2 and 4 cells, and as the index is calibrated."""
    index, asked = _index(spark, sf_dir), vector_queries(spark, sf_dir)
    exact = dense.topk(vectors_of(spark, sf_dir), asked, 10).select("query_id", "chunk_id")
    at = [(n, False) for n in (1, 2, 4)] + [(index.nprobes, True)]
    rows: list[DataFrame] = [ann.recall(index.search(asked, 10, n), exact).select(F.lit(n).alias("nprobes"), F.lit(own).alias("calibrated"), F.round("recall", 6).alias("recall")) for n, own in at]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


def _blocks(spark: SparkSession, sf_dir: str) -> PostingBlocks:
    return PostingBlocks(spark, new_path(spark), SLOTS, 1).build(chunks_of(spark, sf_dir))


@query(f"WITH {_bm25()} {LEXICAL_OUT}")
def lexical_blocks(spark, sf_dir):
    return _lexical(_blocks(spark, sf_dir).search(text_queries(spark, sf_dir), 10))


EDITED = "FROM (SELECT doc_id, source, CASE WHEN doc_id % 97 = 5 THEN 'edited ' || text ELSE text END AS text FROM documents WHERE doc_id % 101 <> 7) AS documents"


@query(f"WITH {_bm25().replace('FROM documents', EDITED)} {LEXICAL_OUT}")
def lexical_blocks_changed(spark, sf_dir):
    """After a hundredth of the chunks was edited and another taken out: only their slots are written again."""
    chunks, blocks = chunks_of(spark, sf_dir), _blocks(spark, sf_dir)
    edited = chunks.where("chunk_id % 97 = 5 AND chunk_id % 101 <> 7").withColumn("text", F.concat(F.lit("edited "), "text"))
    blocks.change(edited, chunks.where("chunk_id % 101 = 7"))
    return _lexical(blocks.search(text_queries(spark, sf_dir), 10))


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df FROM f GROUP BY term")
def block_frequencies(spark, sf_dir):
    """Document frequencies from the blocks' headers."""
    return _blocks(spark, sf_dir).frequencies()


@query()
def lexical_blocks_read(spark, sf_dir):
    """How many blocks of a query's terms a search reads."""
    return _blocks(spark, sf_dir).reading(text_queries(spark, sf_dir), 10)


# Reports of runs


def _embedding(spark: SparkSession, sf_dir: str, work, batches: int = 4, may_fail: bool = False) -> tuple[list[tuple[int, int]], list[report.Report]]:
    """Progress and report of embedding all documents in batches by id; a failure that isn't looked for goes on to the caller."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("title"))
    steps: list[tuple[int, int]] = []
    ends: list[report.Report] = []
    metrics = {"truncated": (F.length("text") > 2000).cast("long"), "characters": F.length("text").cast("long")}
    try:
        report.run(d, work, new_path(spark), "embedding", batches, F.pmod("doc_id", F.lit(batches)), metrics, lambda *at: steps.append(at), ends.append)
    except PySparkException:
        if not may_fail:
            raise
    return steps, ends


@query("""WITH b AS (SELECT doc_id % 4 AS batch, count(*) AS n, count(*) FILTER (length(text) > 2000) AS truncated, sum(length(text)) AS characters FROM documents GROUP BY 1)
SELECT (row_number() OVER (ORDER BY batch))::INT AS step, (sum(n) OVER (ORDER BY batch))::BIGINT AS done, (sum(n) OVER ())::BIGINT AS total, (sum(truncated) OVER ())::BIGINT AS truncated, (sum(characters) OVER ())::BIGINT AS characters FROM b""")
def run_progress(spark, sf_dir):
    """Progress and totals as they were observed while all documents were embedded in four batches."""
    steps, (end,) = _embedding(spark, sf_dir, lambda part: embed.embed_documents(part, embed.HashingEmbedder()))
    rows = [(i, done, total, end.metrics["truncated"], end.metrics["characters"]) for i, (done, total) in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "step int, done long, total long, truncated long, characters long")


@query("""SELECT 'embedding' AS operation, count(*) AS total, count(*) FILTER (doc_id % 4 < 2) AS completed, (sum(length(text)) FILTER (doc_id % 4 < 2))::BIGINT AS characters, TRUE AS interrupted, 'a text that can''t be embedded' AS reason FROM documents""")
def run_interrupted(spark, sf_dir):
    """The report of a run whose third batch fails: what was completed before, and why it ended."""
    why = "a text that can't be embedded"
    stop = F.when(F.pmod("doc_id", F.lit(4)) == 2, F.raise_error(F.lit(why)).cast("string")).otherwise(F.col("text"))
    _, (end,) = _embedding(spark, sf_dir, lambda part: part.withColumn("text", stop), may_fail=True)
    reason = why if why in (end.reason or "") else end.reason
    return spark.createDataFrame([(end.operation, end.total, end.completed, end.metrics["characters"], end.interrupted, reason)], "operation string, total long, completed long, characters long, interrupted boolean, reason string")


# Tables that change in part


@query(SQL["store_cycle"])
def slot_table_cycle(spark, sf_dir):
    """A table in slots that is made, appended to, upserted, thinned twice and compacted."""
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    t = SlotTable(spark, new_path(spark), T.StructType.fromDDL("chunk_id long, text string"), slots=SLOTS)
    t.append(c.where("chunk_id % 2 = 0"))
    t.append(c.where("chunk_id % 2 = 1 AND chunk_id % 3 = 0"))
    t.upsert(c.where("chunk_id % 5 = 0").withColumn("text", F.concat("text", F.lit("!"))))
    t.delete("chunk_id % 7 = 0")
    t.delete_ids(c.where("chunk_id % 11 = 0"))
    t.compact()
    return t.read()


@query("""WITH e AS (SELECT CASE WHEN event_id % 10 = 0 THEN event_type ELSE 'most' END AS kind, value FROM events)
SELECT kind, count(value) AS n, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS percentile FROM e GROUP BY 1""")
def ranks_of_a_large_group(spark, sf_dir):
    """Order statistics where one group has nine tenths of all rows."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, F.col("event_type")).otherwise("most").alias("kind"), "value")
    out = evaluation.latency(e, ["kind"], "value")
    return out.select("kind", "n", F.round("median", 6).alias("median"), F.round("percentile", 6).alias("percentile"))


# Similar chunks by their rarest terms

SIMILAR = 0.6


@query(f"""WITH t AS ({SUBJECT.format(id='doc_id', stops=STOPS, t='documents')}),
d AS (SELECT i, list_sort(list(term)) AS terms FROM t GROUP BY 1), c AS (SELECT min(i) AS id, count(*) AS n, terms FROM d GROUP BY terms), e AS (SELECT id, unnest(terms) AS term FROM c),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS overlap FROM e a JOIN e b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, x.n AS n_a, y.n AS n_b, overlap, round(overlap / (len(x.terms) + len(y.terms) - overlap), 6) AS similarity FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 10 * overlap >= 6 * (len(x.terms) + len(y.terms) - overlap)""")
def similar_documents(spark, sf_dir):
    return similar.similar_pairs(chunks_of(spark, sf_dir), SIMILAR).withColumn("similarity", F.round("similarity", 6))


@query()
def similar_candidates(spark, sf_dir):
    """what, n: classes, and the pairs of them that are compared on whole sets."""
    sets = similar.classes(chunks_of(spark, sf_dir), X.subject_terms(F.col("text")))
    count = lambda frame, what: frame.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(sets, "classes").unionAll(count(similar.candidates(sets, SIMILAR), "candidates"))
