"""Retrieval queries: statute provisions search the judgments' chunks.

A search takes every row whose id is divisible by 50 as a query, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.functions.text import explicit_provision
from docketloom.operators import evaluation, graph, retrieval
from docketloom.sources.tables import table


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statute_sections").where("section_id % 50 = 0")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk, however often it was delivered."""
    return table(spark, d, "judgment_chunks").groupBy("chunk_id").agg(F.min("judgment_id").alias("judgment_id"), F.min("section").alias("section"), F.min("content").alias("content"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.distinct_vectors(table(spark, d, "judgment_embeddings"), "chunk_id")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    asked = retrieval.distinct_vectors(table(spark, d, "statute_embeddings").where("section_id % 50 = 0"), "section_id")
    return retrieval.dense_topk(spark, asked, _corpus(spark, d))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def dense_topk_no_threshold(spark: SparkSession, d: str) -> DataFrame:
    asked = retrieval.distinct_vectors(table(spark, d, "statute_embeddings").where("section_id % 50 = 0"), "section_id")
    return retrieval.dense_topk(spark, asked, _corpus(spark, d), 5, -1.0).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.similarity_stats(_dense(spark, d))


def section_stats(spark: SparkSession, d: str) -> DataFrame:
    hits = _dense(spark, d).join(_chunks(spark, d).select(F.col("chunk_id").alias("id"), "section"), "id")
    return hits.groupBy("section").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("avg_similarity"))


def hits_with_case(spark: SparkSession, d: str) -> DataFrame:
    """The retrieved chunks joined to their judgments after the top-k, so wide columns never meet the search."""
    hits = _dense(spark, d).join(_chunks(spark, d).select(F.col("chunk_id").alias("id"), "judgment_id", "section"), "id")
    cases = table(spark, d, "judgments").select(F.col("id").alias("judgment_id"), "court", F.year("date_of_judgment").alias("year"))
    return hits.join(cases, "judgment_id").select("query_id", "rank", "id", "judgment_id", "section", "court", "year")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(_chunks(spark, d), "chunk_id", "content", _texts(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).where("heading is not null").select(F.col("section_id").alias("query_id"), F.col("heading").alias("text"))


def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_topk(_texts(spark, d), _index(spark, d))


def keyword_any_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_topk(_texts(spark, d), _index(spark, d), match_all=False)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.bm25_topk(_texts(spark, d), _index(spark, d), retrieval.text_sizes(_chunks(spark, d), "content"))
    return ranked.select("query_id", "id", F.round("score", 6).alias("score"))


def _fused(spark: SparkSession, d: str, boost: DataFrame | None = None, weight: float = 0.0) -> DataFrame:
    return retrieval.rrf_fuse(_dense(spark, d), retrieval.keyword_topk(_texts(spark, d), _index(spark, d), match_all=False), boost=boost, weight=weight)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "id", "rrf_score", "rank")


def rrf_graph_boost(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "judgments").select("id")
    deg = graph.degrees(cases, table(spark, d, "citation_edges")).select(F.col("id").alias("judgment_id"), "in_degree")
    most = deg.agg(F.max("in_degree").alias("most"))
    boost = _chunks(spark, d).select(F.col("chunk_id").alias("id"), "judgment_id").join(deg, "judgment_id").join(F.broadcast(most)).select("id", (F.col("in_degree") / F.greatest(F.lit(1), "most")).alias("score"))
    return _fused(spark, d, boost, 0.5).select("query_id", "id", "rrf_score", "rank")


def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    """The fused candidates in the order of the share of a query's terms they hold: the default rerank score."""
    share = retrieval.keyword_topk(_texts(spark, d), _index(spark, d), k=None, match_all=False).select("query_id", "id", "score")
    both = _fused(spark, d).join(share, ["query_id", "id"], "left")
    return retrieval.rerank(both, F.coalesce("score", F.lit(0.0))).select("query_id", "id", "rerank_score", "rank")


def statute_exact_pin(spark: SparkSession, d: str) -> DataFrame:
    """Provisions near a provision by vector, the one its text names by number first."""
    vec = retrieval.distinct_vectors(table(spark, d, "statute_embeddings"), "section_id")
    near = retrieval.dense_topk(spark, vec.where("id % 50 = 0"), vec, 15)
    kind, number = explicit_provision("content")
    asked = _queries(spark, d).select(F.col("section_id").alias("query_id"), kind.alias("kind"), number.alias("number"), "statute_id").where("kind is not null")
    all_ = table(spark, d, "statute_sections").select("statute_id", F.lower("section_number").alias("number"), "section_id")
    exact = asked.join(all_, ["statute_id", "number"]).groupBy("query_id").agg(F.min("section_id").alias("id"))
    return retrieval.pin_exact(near, exact)


def ranked_union(spark: SparkSession, d: str) -> DataFrame:
    """Statutes first, then chunks, each in its own order."""
    return retrieval.ordered_union(statute_exact_pin(spark, d), retrieval.rank_by(_fused(spark, d).drop("rank").withColumnRenamed("rrf_score", "s"), "query_id", [F.desc("s"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("keyword_rank"), F.col("id")], 8))


def _near(spark: SparkSession, d: str, least: float = 0.92) -> DataFrame:
    vec = _corpus(spark, d)
    return retrieval.dense_topk(spark, vec.where("id % 50 = 0"), vec, 51, least)


def near_duplicate_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).where("id <> query_id").select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def crowd_size(spark: SparkSession, d: str) -> DataFrame:
    crowd = evaluation.crowds(_near(spark, d), 0.92)
    return crowd.select("query_id", "crowd_size", evaluation.crowd_bucket("crowd_size", 3).alias("bucket"))


QUERIES = {f.__name__: f for f in (dense_topk, dense_topk_no_threshold, similarity_stats, section_stats, hits_with_case, keyword_topk, keyword_any_topk, bm25_topk, rrf_fusion, rrf_graph_boost, rerank_lexical, statute_exact_pin, ranked_union, near_duplicate_chunks, crowd_size)}

_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_CHUNKS = "chunks AS (SELECT chunk_id, min(judgment_id) judgment_id, min(section) AS section, min(content) content FROM judgment_chunks GROUP BY chunk_id)"
_VEC = "vec AS (SELECT chunk_id id, CAST(any_value(embedding) AS DOUBLE[]) v FROM judgment_embeddings GROUP BY chunk_id)"
_SVEC = "svec AS (SELECT section_id id, CAST(any_value(embedding) AS DOUBLE[]) v FROM statute_embeddings GROUP BY section_id)"


def _dense_sql(k: int = 30, least: float = 0.2) -> str:
    return f"""{_VEC}, {_SVEC},
    scored AS (SELECT q.id query_id, c.id, round(list_cosine_similarity(q.v, c.v), 9) similarity FROM svec q CROSS JOIN vec c WHERE q.id % 50 = 0),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scored WHERE similarity >= {least} QUALIFY rank <= {k})"""


def _terms_sql(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))"


_POST = f"""{_CHUNKS}, words AS (SELECT chunk_id id, {_terms_sql('content')} t FROM chunks),
    post AS (SELECT id, term, count(*) tf, max(n) AS length FROM (SELECT id, len(t) n, unnest(t) term FROM words) GROUP BY id, term),
    asked AS (SELECT DISTINCT query_id, unnest(t) term FROM (SELECT section_id query_id, {_terms_sql('heading')} t FROM statute_sections WHERE section_id % 50 = 0 AND heading IS NOT NULL)),
    wanted AS (SELECT query_id, count(*) wanted FROM asked GROUP BY query_id),
    hit AS (SELECT query_id, id, count(*) got, round(sum(tf / length), 9) score FROM post JOIN asked USING (term) GROUP BY query_id, id),
    ranked_any AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hit QUALIFY rank <= 30)"""
_FUSED = f"""{_POST}, {_dense_sql()},
    fused AS (SELECT coalesce(d.query_id, k.query_id) query_id, coalesce(d.id, k.id) id, d.rank dense_rank, k.rank keyword_rank,
        coalesce(1.0 / (60 + d.rank), 0.0)::DOUBLE + coalesce(1.0 / (60 + k.rank), 0.0)::DOUBLE rrf FROM dense d FULL JOIN ranked_any k ON d.query_id = k.query_id AND d.id = k.id)"""
_ORDER = "rrf_score DESC, dense_rank NULLS LAST, keyword_rank NULLS LAST, id"
_TOP = f"top AS (SELECT query_id, id, round(rrf, 9) rrf_score, dense_rank, keyword_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, dense_rank NULLS LAST, keyword_rank NULLS LAST, id) AS rank FROM fused QUALIFY rank <= 30)"
_PIN = f"""{_SVEC},
    s AS (SELECT q.id query_id, c.id, round(list_cosine_similarity(q.v, c.v), 9) similarity FROM svec q CROSS JOIN svec c WHERE q.id % 50 = 0),
    near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS nth FROM s WHERE similarity >= 0.2 QUALIFY nth <= 15),
    named AS (SELECT section_id query_id, statute_id, CASE WHEN a <> '' THEN a ELSE b END number FROM (SELECT section_id, statute_id, regexp_extract(lower(content), '\\barticle\\s+(\\d{{1,3}}[a-z]?)\\b', 1) a, regexp_extract(lower(content), '\\bsection\\s+(\\d{{1,3}}[a-z]?)\\b', 1) b FROM statute_sections WHERE section_id % 50 = 0) WHERE a <> '' OR b <> ''),
    exact AS (SELECT query_id, min(section_id) id FROM named n JOIN statute_sections t ON t.statute_id = n.statute_id AND lower(t.section_number) = n.number GROUP BY query_id),
    pinned AS (SELECT query_id, id, true pinned, 0 AS nth FROM exact UNION ALL SELECT query_id, id, false, nth FROM near ANTI JOIN exact USING (query_id, id)),
    pin AS (SELECT query_id, id, pinned, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, nth, id) AS rank FROM pinned QUALIFY rank <= 4)"""
_NEAR = f"{_VEC}, near AS (SELECT q.id query_id, c.id, round(list_cosine_similarity(q.v, c.v), 9) similarity, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.id) AS rank FROM vec q CROSS JOIN vec c WHERE q.id % 50 = 0 AND round(list_cosine_similarity(q.v, c.v), 9) >= 0.92 QUALIFY rank <= 51)"

SQL = {
    "dense_topk": f"WITH {_dense_sql()} SELECT query_id, id, round(similarity, 6) similarity, rank FROM dense",
    "dense_topk_no_threshold": f"WITH {_dense_sql(5, -1)} SELECT query_id, id, round(similarity, 6) similarity, rank FROM dense",
    "similarity_stats": f"WITH {_dense_sql()} SELECT query_id, count(*) n, round(avg(similarity), 6) avg_similarity, round(max(similarity), 6) max_similarity, round(min(similarity), 6) min_similarity FROM dense GROUP BY query_id",
    "section_stats": f"WITH {_dense_sql()}, {_CHUNKS} SELECT section, count(*) n, round(avg(similarity), 6) avg_similarity FROM dense JOIN chunks ON chunk_id = id GROUP BY section",
    "hits_with_case": f"WITH {_dense_sql()}, {_CHUNKS} SELECT query_id, rank, dense.id, judgment_id, section, court, year(date_of_judgment) AS year FROM dense JOIN chunks ON chunk_id = dense.id JOIN judgments j ON j.id = judgment_id",
    "keyword_topk": f"WITH {_POST} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hit JOIN wanted USING (query_id) WHERE got = wanted QUALIFY rank <= 30",
    "keyword_any_topk": f"WITH {_POST} SELECT * FROM ranked_any",
    "bm25_topk": f"""WITH {_POST}, size AS (SELECT count(*) docs, avg(n) mean FROM (SELECT id, max(length) n FROM post GROUP BY id)), df AS (SELECT term, count(*) df FROM post GROUP BY term),
        s AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) score FROM post JOIN asked USING (term) JOIN df USING (term) CROSS JOIN size GROUP BY query_id, id)
        SELECT query_id, id, round(score, 6) score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30""",
    "rrf_fusion": f"WITH {_FUSED}, {_TOP} SELECT query_id, id, rrf_score, rank FROM top",
    "rrf_graph_boost": f"""WITH {_FUSED}, deg AS (SELECT j.id, count(DISTINCT e.source_judgment_id) n FROM judgments j LEFT JOIN citation_edges e ON e.target_judgment_id = j.id AND e.source_judgment_id <> j.id GROUP BY j.id),
        b AS (SELECT chunk_id id, n / greatest(1, (SELECT max(n) FROM deg)) s FROM chunks JOIN deg ON deg.id = judgment_id),
        f AS (SELECT query_id, fused.id, dense_rank, keyword_rank, round(rrf * (1 + 0.5 * coalesce(s, 0)), 9) rrf_score FROM fused LEFT JOIN b ON b.id = fused.id)
        SELECT query_id, id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM f QUALIFY rank <= 30""",
    "rerank_lexical": f"""WITH {_FUSED}, {_TOP}, z AS (SELECT query_id, id, coalesce(score, 0.0)::DOUBLE rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, top.rank) AS nth FROM top LEFT JOIN hit USING (query_id, id))
        SELECT query_id, id, rerank_score, nth AS rank FROM z WHERE nth <= 8""",
    "statute_exact_pin": f"WITH {_PIN} SELECT * FROM pin",
    "ranked_union": f"""WITH {_FUSED}, {_TOP}, {_PIN.replace(_SVEC + ',', '', 1)}, u AS (SELECT query_id, 1 part, id, rank AS nth FROM pin UNION ALL SELECT query_id, 2, id, rank FROM top WHERE rank <= 8)
        SELECT query_id, part, id, row_number() OVER (PARTITION BY query_id ORDER BY part, nth) AS rank FROM u""",
    "near_duplicate_chunks": f"WITH {_NEAR} SELECT query_id, id, round(similarity, 6) similarity FROM near WHERE id <> query_id",
    "crowd_size": f"WITH {_NEAR} SELECT query_id, least(50, count(*)) crowd_size, CASE WHEN least(50, count(*)) >= 3 THEN 'high_crowd' ELSE 'low_crowd' END bucket FROM near WHERE id <> query_id GROUP BY query_id",
}
