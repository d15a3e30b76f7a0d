"""Retrieval quality: gold sets, ranked-list metrics, near-duplicate crowds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.functions.text import content_hash, is_garbled

CUTS = (1, 5, 8, 10, 30)


def first_hits(ranked: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, hit): the best rank at which a relevant id stands, null if nowhere."""
    best = ranked.join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("hit"))
    return queries.select("query_id").distinct().join(best, "query_id", "left")


def metrics(hits: DataFrame, by: list[str] | None = None, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Mean recall@k and nDCG@k at every cut and the mean reciprocal rank, to 6 decimals."""
    inside = lambda k: F.col("hit") <= k
    recall = [F.round(F.avg(F.when(inside(k), 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in cuts]
    gain = [F.round(F.avg(F.when(inside(k), 1 / F.log2(F.col("hit") + 1)).otherwise(0.0)), 6).alias(f"ndcg_at_{k}") for k in cuts]
    mrr = F.round(F.avg(F.when(F.col("hit").isNotNull(), 1 / F.col("hit")).otherwise(0.0)), 6).alias("mrr")
    return hits.groupBy(*(by or [])).agg(F.count("*").alias("n"), *recall, *gain, mrr)


def flat_metrics(table: DataFrame, by: list[str]) -> DataFrame:
    """(…by, metric, value): one row per metric."""
    names = [c for c in table.columns if c not in by]
    return table.unpivot(by, [F.col(c).cast("double").alias(c) for c in names], "metric", "value")


def crowd_bucket(col: str | Column, least: int) -> Column:
    return F.when((F.col(col) if isinstance(col, str) else col) >= least, "high_crowd").otherwise("low_crowd")


def gold_check(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold records with ``status``: valid, or the first reason why stale (missing, moved, changed).

    ``gold`` is (query_id, chunk_id, judgment_id, content_hash), ``chunks`` (chunk_id, judgment_id, content).
    """
    live = chunks.select("chunk_id", F.col("judgment_id").alias("live_judgment"), content_hash("content").alias("live_hash"), F.lit(True).alias("live"))
    status = F.when(F.col("live").isNull(), "missing").when(~F.col("live_judgment").eqNullSafe(F.col("judgment_id")), "moved").when(~F.col("live_hash").eqNullSafe(F.col("content_hash")), "changed").otherwise("valid")
    return gold.join(live, "chunk_id", "left").withColumn("status", status).drop("live_judgment", "live_hash", "live")


def gold_pool(chunks: DataFrame, least: int = 200) -> DataFrame:
    """Chunks fit for a gold question: longer than ``least`` characters and not garbled."""
    return chunks.where((F.length("content") > least) & ~is_garbled("content"))


def gold_sample(pool: DataFrame, quota: int, per_judgment: int = 2, seed: int = 42) -> DataFrame:
    """Up to ``quota`` chunks of every section and ``per_judgment`` of every judgment in it, in seeded hash order."""
    order = [F.md5(F.concat_ws("-", F.col("chunk_id").cast("string"), F.lit(str(seed)))), F.col("chunk_id")]
    one = pool.withColumn("_j", F.row_number().over(Window.partitionBy("section", "judgment_id").orderBy(*order))).where(F.col("_j") <= per_judgment)
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("section").orderBy(*order))).where(F.col("_r") <= quota).drop("_j", "_r")


def crowds(ranked: DataFrame, least: float = 0.92, most: int = 50) -> DataFrame:
    """(query_id, crowd_size, near): neighbours of a query other than itself at or above a similarity."""
    near = ranked.where((F.col("similarity") >= least) & (F.col("id") != F.col("query_id")))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("_r") <= most)
    return near.groupBy("query_id").agg(F.count("*").alias("crowd_size"), F.array_sort(F.collect_list("id")).alias("near"))
