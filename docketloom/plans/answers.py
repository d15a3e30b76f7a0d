"""Whole steps of answering: what is retrieved and shown before and after a model speaks.

The model itself is a hook: these plans end where it is asked and go on from what it said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.functions.text import explicit_provision
from docketloom.operators import retrieval
from docketloom.plans.retrieval import _CHUNKS, _FUSED, _TOP, _chunks, _fused, _terms_sql
from docketloom.sources.tables import table

STATUTE_CANDIDATES = 15
CHAIN = 5


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statute_sections")


def _statutes(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Both legs over the provisions, fused, with the provision that the question names by number first."""
    vec = retrieval.distinct_vectors(table(spark, d, "statute_embeddings"), "section_id")
    asked = _sections(spark, d).where("section_id % 50 = 0").select(F.col("section_id").alias("query_id"), F.col("content").alias("text"), "statute_id")
    dense = retrieval.dense_topk(spark, vec.where("id % 50 = 0"), vec, STATUTE_CANDIDATES)
    words = retrieval.keyword_topk(asked, retrieval.postings(_sections(spark, d), "section_id", "content", asked), STATUTE_CANDIDATES, match_all=False)
    fused = retrieval.rrf_fuse(dense, words, STATUTE_CANDIDATES)
    kind, number = explicit_provision("text")
    named = asked.select("query_id", kind.alias("kind"), number.alias("number"), "statute_id").where("kind is not null")
    held = _sections(spark, d).select("statute_id", F.lower("section_number").alias("number"), "section_id")
    exact = named.join(held, ["statute_id", "number"]).groupBy("query_id").agg(F.min("section_id").alias("id"))
    return retrieval.pin_exact(fused, exact, k)


def statute_hybrid_pin(spark: SparkSession, d: str) -> DataFrame:
    return _statutes(spark, d, STATUTE_CANDIDATES)


def retrieval_only(spark: SparkSession, d: str) -> DataFrame:
    """Per question what a search alone finds: statutes first, then cases; both counts and the first five entries."""
    cases = _fused(spark, d).where("rank <= 8").select("query_id", "id", "rank")
    both = retrieval.ordered_union(_statutes(spark, d, 4), cases)
    entry = F.struct("rank", F.concat(F.when(F.col("part") == 1, "s").otherwise("c"), F.col("id")).alias("name"))
    found = both.groupBy("query_id").agg(F.count(F.when(F.col("part") == 1, True)).alias("statutes"), F.count(F.when(F.col("part") == 2, True)).alias("cases"), F.array_sort(F.collect_list(entry)).alias("all"))
    return found.select("query_id", "statutes", "cases", F.array_join(F.transform(F.slice("all", 1, CHAIN), lambda e: e["name"]), " ").alias("preview"))


def precedent_chains(spark: SparkSession, d: str) -> DataFrame:
    """The first five different judgments of every result list, in its order, with what each cites and is cited by."""
    hits = _fused(spark, d).join(_chunks(spark, d).select(F.col("chunk_id").alias("id"), "judgment_id"), "id").groupBy("query_id", "judgment_id").agg(F.min("rank").alias("first"))
    top = retrieval.rank_by(hits, "query_id", [F.col("first")], CHAIN, "position")
    edges = table(spark, d, "citation_edges").where("target_judgment_id is not null and source_judgment_id <> target_judgment_id").select("source_judgment_id", "target_judgment_id").distinct()
    # only edges of the listed judgments are counted
    listed = top.select("judgment_id").distinct()
    count = lambda c, name: edges.join(listed.withColumnRenamed("judgment_id", c), c, "left_semi").groupBy(F.col(c).alias("judgment_id")).agg(F.count("*").alias(name))
    both = top.join(count("source_judgment_id", "cites"), "judgment_id", "left").join(count("target_judgment_id", "cited_by"), "judgment_id", "left")
    return both.select("query_id", "position", "judgment_id", F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def document_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Judgments by id with the reports their stored citations list."""
    told = F.from_json("citations", "struct<header:string,reporters:array<string>>")
    rows = table(spark, d, "judgments").where("id % 50 = 0")
    return rows.select("id", F.coalesce("petitioner", F.lit("Unknown")).alias("petitioner"), "court", F.coalesce(F.array_join(told["reporters"], "; "), F.lit("")).alias("reporters"))


def judgment_info(spark: SparkSession, d: str) -> DataFrame:
    """Label and court of asked ids; an id without a judgment is called by its number."""
    asked = table(spark, d, "citation_edges").select(F.coalesce("target_judgment_id", -F.col("edge_id")).alias("id")).where("id % 7 = 0").distinct()
    known = table(spark, d, "judgments").select("id", "petitioner", "court", F.lit(True).alias("known"))
    name = F.when(F.col("known") & (F.coalesce("petitioner", F.lit("")) != ""), F.col("petitioner")).otherwise(F.concat(F.lit("Case #"), F.col("id")))
    return asked.join(known, "id", "left").select("id", name.alias("label"), "court")


def resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    """Edges, those with a target and their share; a ruling that cites itself doesn't count."""
    edges = table(spark, d, "citation_edges").where("coalesce(resolution_method, '') <> 'self'")
    n = edges.agg(F.count("*").alias("edges"), F.count("target_judgment_id").alias("resolved"))
    return n.select("edges", "resolved", F.when(F.col("edges") > 0, F.round(F.col("resolved") / F.col("edges"), 4)).otherwise(0.0).alias("rate"))


def ingestion_totals(spark: SparkSession, d: str) -> DataFrame:
    """What a run brought in: judgments with and without text, chunks, and vectors of those chunks."""
    cases = table(spark, d, "judgments").agg(F.count("*").alias("files"), F.count(F.when(F.coalesce(F.trim("judgment_text"), F.lit("")) != "", True)).alias("ok"))
    chunks = _chunks(spark, d).select("chunk_id")
    with_vector = chunks.join(table(spark, d, "judgment_embeddings").where("embedding is not null").select("chunk_id").distinct(), "chunk_id", "left_semi")
    both = cases.crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(with_vector.agg(F.count("*").alias("vectors")))  # one row each
    return both.select("files", "ok", (F.col("files") - F.col("ok")).alias("no_text"), "chunks", "vectors")


def embedding_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that a load by natural key (statute title and section number) would store, the first section of a key."""
    titles = table(spark, d, "statutes").select(F.col("id").alias("statute_id"), "title")
    rows = _sections(spark, d).join(titles, "statute_id").join(table(spark, d, "statute_embeddings").select("section_id", F.size("embedding").alias("size")), "section_id")
    return rows.groupBy("title", "section_number").agg(F.min("section_id").alias("section_id"), F.max("size").alias("dimension"))


def cited_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every case of several lists once, by the first list and place it stands in."""
    rows = table(spark, d, "citation_edges").where("target_judgment_id is not null")
    place = F.when(F.col("relationship_type").isNull(), 5).otherwise(F.expr("array_position(array('overruled', 'followed', 'distinguished', 'referred'), relationship_type)"))
    first = rows.groupBy(F.col("source_judgment_id").alias("id"), F.col("target_judgment_id").alias("case")).agg(F.min(F.struct(F.when(place == 0, 6).otherwise(place).cast("int").alias("part"), "edge_id")).alias("at"))
    ranked = first.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("at.part", "at.edge_id")))
    return ranked.select("id", "position", "case", F.col("at.part").alias("part"))


QUERIES = {f.__name__: f for f in (statute_hybrid_pin, retrieval_only, precedent_chains, document_fetch, judgment_info, resolution_rate, ingestion_totals, embedding_inserts, cited_cases)}

_STATUTES = f"""svec AS (SELECT section_id id, CAST(any_value(embedding) AS DOUBLE[]) v FROM statute_embeddings GROUP BY section_id),
    sdense AS (SELECT q.id query_id, c.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.id) AS rank FROM svec q CROSS JOIN svec c WHERE q.id % 50 = 0 AND round(list_cosine_similarity(q.v, c.v), 9) >= 0.2 QUALIFY rank <= 15),
    swords AS (SELECT section_id id, {_terms_sql('content')} t FROM statute_sections),
    spost AS (SELECT id, term, count(*) tf, max(n) AS length FROM (SELECT id, len(t) n, unnest(t) term FROM swords) GROUP BY id, term),
    sasked AS (SELECT DISTINCT id query_id, term FROM spost WHERE id % 50 = 0),
    shit AS (SELECT query_id, id, round(sum(tf / length), 9) score FROM spost JOIN sasked USING (term) GROUP BY query_id, id),
    skey AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM shit QUALIFY rank <= 15),
    sfused AS (SELECT coalesce(d.query_id, k.query_id) query_id, coalesce(d.id, k.id) id, row_number() OVER (PARTITION BY coalesce(d.query_id, k.query_id) ORDER BY
        round(coalesce(1.0 / (60 + d.rank), 0.0)::DOUBLE + coalesce(1.0 / (60 + k.rank), 0.0)::DOUBLE, 9) DESC, d.rank NULLS LAST, k.rank NULLS LAST, coalesce(d.id, k.id)) AS nth
        FROM sdense d FULL JOIN skey k ON d.query_id = k.query_id AND d.id = k.id QUALIFY nth <= 15),
    snamed AS (SELECT section_id query_id, statute_id, CASE WHEN a <> '' THEN a ELSE b END number FROM (SELECT section_id, statute_id, regexp_extract(lower(content), '\\barticle\\s+(\\d{{1,3}}[a-z]?)\\b', 1) a, regexp_extract(lower(content), '\\bsection\\s+(\\d{{1,3}}[a-z]?)\\b', 1) b FROM statute_sections WHERE section_id % 50 = 0) WHERE a <> '' OR b <> ''),
    sexact AS (SELECT query_id, min(section_id) id FROM snamed n JOIN statute_sections t ON t.statute_id = n.statute_id AND lower(t.section_number) = n.number GROUP BY query_id),
    spinned AS (SELECT query_id, id, true pinned, 0 AS nth FROM sexact UNION ALL SELECT query_id, id, false, nth FROM sfused ANTI JOIN sexact USING (query_id, id)),
    spin AS (SELECT query_id, id, pinned, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, nth, id) AS rank FROM spinned QUALIFY rank <= 15)"""
SQL = {
    "statute_hybrid_pin": f"WITH {_STATUTES} SELECT * FROM spin",
    "retrieval_only": f"""WITH {_FUSED}, {_TOP}, {_STATUTES.replace('svec AS', 'svec2 AS', 1).replace('FROM svec q CROSS JOIN svec c', 'FROM svec2 q CROSS JOIN svec2 c')},
        u AS (SELECT query_id, 1 part, id, rank AS nth FROM spin WHERE rank <= 4 UNION ALL SELECT query_id, 2, id, rank FROM top WHERE rank <= 8),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, nth) AS spot FROM u)
        SELECT query_id, count(*) FILTER (WHERE part = 1) statutes, count(*) FILTER (WHERE part = 2) cases, string_agg(CASE WHEN part = 1 THEN 's' ELSE 'c' END || id, ' ' ORDER BY spot) FILTER (WHERE spot <= 5) preview FROM o GROUP BY query_id""",
    "precedent_chains": f"""WITH {_FUSED}, {_TOP}, h AS (SELECT query_id, judgment_id, min(top.rank) f FROM top JOIN chunks ON chunk_id = top.id GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f) AS position FROM h QUALIFY position <= 5),
        e AS (SELECT DISTINCT source_judgment_id s, target_judgment_id t FROM citation_edges WHERE target_judgment_id IS NOT NULL AND source_judgment_id <> target_judgment_id)
        SELECT query_id, position, judgment_id, (SELECT count(*) FROM e WHERE s = judgment_id) cites, (SELECT count(*) FROM e WHERE t = judgment_id) cited_by FROM p""",
    "document_fetch": "SELECT id, coalesce(petitioner, 'Unknown') petitioner, court, coalesce(array_to_string(CAST(json_extract(citations, '$.reporters') AS VARCHAR[]), '; '), '') reporters FROM judgments WHERE id % 50 = 0",
    "judgment_info": """WITH a AS (SELECT DISTINCT coalesce(target_judgment_id, -edge_id) id FROM citation_edges)
        SELECT a.id, CASE WHEN coalesce(petitioner, '') <> '' THEN petitioner ELSE 'Case #' || a.id END AS label, court FROM a LEFT JOIN judgments j ON j.id = a.id WHERE a.id % 7 = 0""",
    "resolution_rate": "SELECT count(*) edges, count(target_judgment_id) resolved, round(count(target_judgment_id) / count(*), 4) rate FROM citation_edges WHERE resolution_method IS DISTINCT FROM 'self'",
    "ingestion_totals": f"""WITH {_CHUNKS} SELECT count(*) files, count(*) FILTER (WHERE trim(coalesce(judgment_text, '')) <> '') ok, count(*) FILTER (WHERE trim(coalesce(judgment_text, '')) = '') no_text, (SELECT count(*) FROM chunks) chunks,
        (SELECT count(*) FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM judgment_embeddings WHERE embedding IS NOT NULL)) vectors FROM judgments""",
    "embedding_inserts": "SELECT title, section_number, min(s.section_id) section_id, max(len(embedding))::INT dimension FROM statute_sections s JOIN statutes t ON t.id = s.statute_id JOIN statute_embeddings e ON e.section_id = s.section_id GROUP BY title, section_number",
    "cited_cases": """WITH p AS (SELECT source_judgment_id id, target_judgment_id "case", edge_id, CASE coalesce(relationship_type, '') WHEN 'overruled' THEN 1 WHEN 'followed' THEN 2 WHEN 'distinguished' THEN 3 WHEN 'referred' THEN 4 WHEN '' THEN 5 ELSE 6 END part FROM citation_edges WHERE target_judgment_id IS NOT NULL),
        f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id, "case" ORDER BY part, edge_id) = 1)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, edge_id) AS position, "case", part FROM f""",
}
