"""Evaluation queries: a chunk's own judgment is the right answer to a search by its vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.functions.text import confidence_band, content_hash
from docketloom.operators import context, evaluation, retrieval
from docketloom.plans.retrieval import _CHUNKS, _FUSED, _VEC, _chunks, _corpus, _fused
from docketloom.sources.tables import table


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Searches by every fiftieth vector, itself left out; relevant are the other chunks of its judgment."""
    vec, chunks = _corpus(spark, d), _chunks(spark, d)
    asked = vec.where("id % 50 = 0")
    near = retrieval.dense_topk(spark, asked, vec, 31, -1.0).where("id <> query_id")
    near = retrieval.rank_by(near.drop("rank"), "query_id", [F.desc("similarity"), F.col("id")], 30)
    own = chunks.select(F.col("chunk_id").alias("query_id"), "judgment_id", "section")
    right = asked.select(F.col("id").alias("query_id")).join(own, "query_id").join(chunks.select(F.col("chunk_id").alias("id"), "judgment_id"), "judgment_id").where("id <> query_id").select("query_id", "id")
    return near, right, asked.select(F.col("id").alias("query_id")).join(own.select("query_id", "section"), "query_id")


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    near, right, asked = _ranked(spark, d)
    return evaluation.metrics(evaluation.first_hits(near, right, asked))


def ir_metrics_by_section(spark: SparkSession, d: str) -> DataFrame:
    near, right, asked = _ranked(spark, d)
    return evaluation.metrics(evaluation.first_hits(near, right, asked).join(asked, "query_id"), ["section"])


def ir_metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 per section and, under a null section flagged as total, over all."""
    near, right, asked = _ranked(spark, d)
    hits = evaluation.first_hits(near, right, asked).join(asked, "query_id")
    return hits.rollup("section").agg(F.grouping("section").cast("int").alias("total"), F.count("*").alias("n"), F.round(F.avg(F.when(F.col("hit") <= 10, 1.0).otherwise(0.0)), 6).alias("recall_at_10"))


def ir_metrics_flat(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.flat_metrics(ir_metrics_by_section(spark, d), ["section"])


def gold_pool(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gold_pool(_chunks(spark, d)).select("chunk_id")


def gold_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gold_sample(evaluation.gold_pool(_chunks(spark, d)), 16).select("section", "chunk_id")


def gold_validation(spark: SparkSession, d: str) -> DataFrame:
    """A record of every chunk, some of them moved, changed or gone."""
    chunks = _chunks(spark, d)
    gold = chunks.select(
        F.col("chunk_id").alias("query_id"),
        F.when(F.col("chunk_id") % 3 == 0, -F.col("chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("chunk_id") % 5 == 0, F.lit(-1).cast("long")).otherwise(F.col("judgment_id")).alias("judgment_id"),
        F.when(F.col("chunk_id") % 11 == 0, F.lit("other")).otherwise(content_hash("content")).alias("content_hash"),
    )
    return evaluation.gold_check(gold, chunks).select("query_id", "status")


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    hits = _fused(spark, d).where("rank <= 8").join(_chunks(spark, d).select(F.col("chunk_id").alias("id"), "judgment_id", F.col("content").alias("text")), "id")
    cases = table(spark, d, "judgments").select(F.col("id").alias("judgment_id"), F.coalesce("petitioner", F.lit("Unknown")).alias("case"), "court", F.year("date_of_judgment").alias("year"))
    return hits.join(cases, "judgment_id").withColumn("doc_type", F.lit("judgment")).withColumn("section_number", F.lit(None).cast("string"))


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    return context.context_blocks(_retrieved(spark, d))


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return context.source_labels(_retrieved(spark, d))


def grouped_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = context.grouped_positions(_retrieved(spark, d).withColumn("group_key", F.col("judgment_id")))
    return rows.select("query_id", "rank", "id", "group_no")


def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The provision's own text as the answer to a search by its heading."""
    said = table(spark, d, "statute_sections").where("section_id % 50 = 0").select(F.col("section_id").alias("query_id"), F.col("content").alias("answer"))
    return context.confidence(said, _retrieved(spark, d)).select("query_id", "confidence", confidence_band("confidence").alias("band"))


QUERIES = {f.__name__: f for f in (ir_metrics, ir_metrics_by_section, ir_metrics_rollup, ir_metrics_flat, gold_pool, gold_sample, gold_validation, context_blocks, source_labels, grouped_positions, answer_confidence)}

_CUTS = ", ".join([f"round(avg(CASE WHEN hit <= {k} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE recall_at_{k}" for k in evaluation.CUTS] + [f"round(avg(CASE WHEN hit <= {k} THEN 1 / log2(hit + 1) ELSE 0.0 END), 6) ndcg_at_{k}" for k in evaluation.CUTS])
_HITS = f"""{_VEC}, {_CHUNKS}, s AS (SELECT q.id query_id, c.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.id) AS raw FROM vec q CROSS JOIN vec c WHERE q.id % 50 = 0 QUALIFY raw <= 31),
    near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY raw) AS rank FROM s WHERE id <> query_id QUALIFY rank <= 30),
    asked AS (SELECT v.id query_id, judgment_id, section FROM vec v JOIN chunks ON chunk_id = v.id WHERE v.id % 50 = 0),
    best AS (SELECT near.query_id, min(rank) hit FROM near JOIN asked USING (query_id) JOIN chunks c ON c.chunk_id = near.id AND c.judgment_id = asked.judgment_id GROUP BY 1),
    hits AS (SELECT asked.query_id, section, hit FROM asked LEFT JOIN best USING (query_id))"""
_MRR = "round(avg(CASE WHEN hit IS NOT NULL THEN 1 / hit ELSE 0.0 END), 6)::DOUBLE mrr"
SQL = {
    "ir_metrics": f"WITH {_HITS} SELECT count(*) n, {_CUTS}, {_MRR} FROM hits",
    "ir_metrics_by_section": f"WITH {_HITS} SELECT section, count(*) n, {_CUTS}, {_MRR} FROM hits GROUP BY section",
    "ir_metrics_rollup": f"WITH {_HITS} SELECT section, grouping(section)::INT total, count(*) n, round(avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE recall_at_10 FROM hits GROUP BY ROLLUP (section)",
    "gold_pool": f"WITH {_CHUNKS} SELECT chunk_id FROM chunks WHERE length(content) > 200 AND length(regexp_replace(content, '[\\x00-\\x7F]', '', 'g')) / length(content) <= 0.2",
    "gold_sample": f"""WITH {_CHUNKS}, p AS (SELECT * FROM chunks WHERE length(content) > 200 AND length(regexp_replace(content, '[\\x00-\\x7F]', '', 'g')) / length(content) <= 0.2),
        a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY section, judgment_id ORDER BY md5(chunk_id || '-42'), chunk_id) <= 2)
        SELECT section, chunk_id FROM a QUALIFY row_number() OVER (PARTITION BY section ORDER BY md5(chunk_id || '-42'), chunk_id) <= 16""",
    "gold_validation": f"WITH {_CHUNKS} SELECT chunk_id query_id, CASE WHEN chunk_id % 3 = 0 THEN 'missing' WHEN chunk_id % 5 = 0 THEN 'moved' WHEN chunk_id % 11 = 0 THEN 'changed' ELSE 'valid' END status FROM chunks",
    "grouped_positions": f"""WITH {_FUSED}, top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, dense_rank NULLS LAST, keyword_rank NULLS LAST, id) AS rank FROM fused QUALIFY rank <= 8),
        g AS (SELECT query_id, top.id, rank, min(rank) OVER (PARTITION BY query_id, judgment_id) f FROM top JOIN chunks ON chunk_id = top.id JOIN judgments j ON j.id = judgment_id)
        SELECT query_id, rank, id, dense_rank() OVER (PARTITION BY query_id ORDER BY f) group_no FROM g""",
    "ir_metrics_flat": f"WITH {_HITS}, w AS (SELECT section, count(*)::DOUBLE n, {_CUTS}, {_MRR} FROM hits GROUP BY section) SELECT section, name AS metric, value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE section) INTO NAME name VALUE value)",
    "source_labels": f"""WITH {_FUSED}, top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, dense_rank NULLS LAST, keyword_rank NULLS LAST, id) AS rank FROM fused QUALIFY rank <= 8),
        l AS (SELECT query_id, coalesce(petitioner, 'Unknown') || ' (' || coalesce(court, 'None') || ', ' || coalesce(year(date_of_judgment)::VARCHAR, 'None') || ')' AS label, min(rank) f FROM top JOIN chunks ON chunk_id = top.id JOIN judgments j ON j.id = judgment_id GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f) AS position, label FROM l""",
}
