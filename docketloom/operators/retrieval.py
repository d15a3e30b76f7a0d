"""Dense, keyword and fused retrieval for many queries in one plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
CANDIDATES = 30
THRESHOLD = 0.2
BLOCK = 2_048
STOP_WORDS = ("the", "and", "for", "that", "with", "was", "are", "were", "this", "from", "any", "has", "have", "had", "not", "which", "its", "his", "her", "been", "shall", "may", "such")


# ---------------------------------------------------------------- dense leg
def distinct_vectors(df: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """(id, v): one vector per id; repeated deliveries carry equal vectors."""
    return df.where(F.col(vec_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.first(vec_col).alias("v"))


def dense_topk(spark: SparkSession, queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Exact cosine top-k of every query against all rows: (query_id, id, similarity, rank).

    ``queries`` and ``corpus`` are (id, v). The query set is taken in blocks of at
    most ``block`` vectors, so what a task holds is bounded; every partition
    keeps its own best k and only those are shuffled. Equal similarities (to 9
    decimals) go to the smaller id. Zero and null vectors match nothing.
    """
    total = queries.count()
    blocks = max(1, -(-total // block))
    found = None
    numbered = queries.where("v is not null").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    for b in range(blocks):
        rows = numbered.where(F.col("_b") == b).select("id", "v").toArrow()  # one block at a time
        if not rows.num_rows:
            continue
        ids = rows.column("id").to_numpy()
        asked = np.stack([np.asarray(x, np.float64) for x in rows.column("v").to_pylist()])
        length = np.linalg.norm(asked, axis=1)
        asked, ids = asked[length > 0] / length[length > 0][:, None], ids[length > 0]

        def run(batches, asked=asked, ids=ids):
            best_s = np.full((len(ids), 0), -2.0)
            best_i = np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                own = batch.column("id").to_numpy(zero_copy_only=False)
                m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1).astype(np.float64)
                size = np.linalg.norm(m, axis=1)
                m, own = m[size > 0] / size[size > 0][:, None], own[size > 0]
                s = np.round(asked @ m.T, 9)
                best_s = np.hstack([best_s, s])
                best_i = np.hstack([best_i, np.broadcast_to(own, s.shape)])
                order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            q = np.repeat(ids, best_s.shape[1])
            s, i = best_s.ravel(), best_i.ravel()
            keep = s >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(q[keep], pa.int64()), pa.array(i[keep], pa.int64()), pa.array(s[keep])], names=["query_id", "id", "similarity"])

        part = corpus.where("v is not null").select("id", "v").mapInArrow(run, "query_id long, id long, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, id long, similarity double")
    return rank_by(found, "query_id", [F.desc("similarity"), F.col("id")], k)


def rank_by(df: DataFrame, key: str | list[str], order: list[Column], k: int | None = None, out: str = "rank") -> DataFrame:
    """Rows numbered from 1 per key in the given order, cut at ``k``."""
    keys = [key] if isinstance(key, str) else key
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k) if k else ranked


def similarity_stats(scored: DataFrame) -> DataFrame:
    """Per query count, mean, greatest and least similarity of what was retrieved."""
    return scored.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("avg_similarity"), F.round(F.max("similarity"), 6).alias("max_similarity"), F.round(F.min("similarity"), 6).alias("min_similarity"))


# ---------------------------------------------------------------- keyword leg
def terms(col: str | Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Search terms of a text: runs of letters and digits, three or longer, no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, text), every term once."""
    return queries.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("term"))


def postings(df: DataFrame, id_col: str, text_col: str, queries: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, length): the inverted lists of a text column, of the terms of ``queries`` alone where given.

    The terms are then filtered before anything is grouped, so only postings that can match are shuffled.
    """
    base = df.select(F.col(id_col).alias("id"), terms(text_col).alias("t"))
    flat = base.select("id", F.size("t").alias("length"), F.explode("t").alias("term"))
    if queries is not None:
        flat = flat.join(asked_terms(queries).select("term").distinct(), "term", "left_semi")
    return flat.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def text_sizes(df: DataFrame, text_col: str) -> DataFrame:
    """One row: number of texts with a term and their mean length."""
    return df.select(F.size(terms(text_col)).alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))


def keyword_topk(queries: DataFrame, index: DataFrame, k: int = CANDIDATES, match_all: bool = True) -> DataFrame:
    """(query_id, id, score, rank): texts that hold all terms of a query, by summed share of their words.

    ``queries`` is (query_id, text). The score is the sum of tf / length; ties go to the smaller id.
    """
    asked = asked_terms(queries)
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hit = index.join(asked, "term").groupBy("query_id", "id").agg(F.count("*").alias("got"), F.round(F.sum(F.col("tf") / F.col("length")), 9).alias("score"))
    if match_all:
        hit = hit.join(wanted, "query_id").where("got = wanted")
    return rank_by(hit.select("query_id", "id", "score"), "query_id", [F.desc("score"), F.col("id")], k)


def bm25_topk(queries: DataFrame, index: DataFrame, size: DataFrame, k: int = CANDIDATES, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) by Okapi BM25 over any matching term; ``size`` is that of the whole corpus (:func:`text_sizes`)."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    weighed = asked_terms(queries).join(df, "term").join(F.broadcast(size)).withColumn("idf", F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # one row
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    hit = index.join(weighed, "term").groupBy("query_id", "id").agg(F.round(F.sum(gain), 9).alias("score"))
    return rank_by(hit, "query_id", [F.desc("score"), F.col("id")], k)


# ---------------------------------------------------------------- fusion
def rrf_fuse(dense: DataFrame, keyword: DataFrame, k: int = CANDIDATES, rrf_k: int = RRF_K, boost: DataFrame | None = None, weight: float = 0.0) -> DataFrame:
    """(query_id, id, rrf_score, rank) by Reciprocal Rank Fusion of two ranked lists.

    ``boost`` (id, score) multiplies by 1 + weight * score. Ties keep the dense
    order, then the keyword order.
    """
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), "similarity")
    w = keyword.select("query_id", "id", F.col("rank").alias("keyword_rank"))
    both = d.join(w, ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    out = both.withColumn("rrf", part("dense_rank") + part("keyword_rank"))
    if boost is not None and weight:
        out = out.join(boost.select("id", F.col("score").alias("_b")), "id", "left").withColumn("rrf", F.col("rrf") * (1 + weight * F.coalesce("_b", F.lit(0.0)))).drop("_b")
    out = out.withColumn("rrf_score", F.round("rrf", 9))
    ranked = rank_by(out, "query_id", [F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("keyword_rank"), F.col("id")], k)
    return ranked.select("query_id", "id", "rrf_score", "dense_rank", "keyword_rank", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "rank")


def pin_exact(fused: DataFrame, exact: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, id, pinned, rank): the exactly named entry first, then the fused order, k in all."""
    pins = exact.select("query_id", "id", F.lit(True).alias("pinned"), F.lit(0).alias("at")).distinct()
    rest = fused.join(pins.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(False).alias("pinned"), F.col("rank").alias("at"))
    return rank_by(pins.unionByName(rest), "query_id", [F.desc("pinned"), F.col("at"), F.col("id")], k).select("query_id", "id", "pinned", "rank")


def rerank(candidates: DataFrame, score: Column, k: int = 8) -> DataFrame:
    """Candidates in the order of another score, stable in their present rank."""
    scored = candidates.withColumn("rerank_score", score).withColumnRenamed("rank", "before")
    return rank_by(scored, "query_id", [F.desc("rerank_score"), F.col("before")], k)


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists one after the other, never pooled: (query_id, part, id, rank)."""
    a = first.select("query_id", F.lit(1).alias("part"), "id", F.col("rank").alias("at"))
    b = second.select("query_id", F.lit(2).alias("part"), "id", F.col("rank").alias("at"))
    return rank_by(a.unionByName(b), "query_id", [F.col("part"), F.col("at")]).select("query_id", "part", "id", "rank")
