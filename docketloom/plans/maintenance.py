"""Table maintenance queries over the judgments, edges and statutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.functions import documents, text
from docketloom.operators import resolver, tables
from docketloom.sources.tables import table

CUT = "2024-06-01 00:30:00"


def dedupe_groups(spark: SparkSession, d: str) -> DataFrame:
    return tables.duplicate_groups(table(spark, d, "judgments"), "id", "judgment_text")


def dedupe_totals(spark: SparkSession, d: str) -> DataFrame:
    return tables.duplicate_totals(dedupe_groups(spark, d))


def dedupe_keepers(spark: SparkSession, d: str) -> DataFrame:
    return tables.keepers(table(spark, d, "judgments"), "id", "judgment_text").select("id")


def dedupe_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return tables.delete_duplicates(table(spark, d, "judgments"), "id", "judgment_text")


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the second half hour that the first half hour lacks."""
    edges = table(spark, d, "citation_edges")
    old, new = edges.where(F.col("created_at") < F.lit(CUT).cast("timestamp_ntz")), edges.where(F.col("created_at") >= F.lit(CUT).cast("timestamp_ntz"))
    return tables.insert_ignore(old, new, ["source_judgment_id", "coalesce(target_judgment_id, -1)", "cited_text"], [F.col("edge_id")]).select("edge_id", "source_judgment_id", "target_judgment_id", "cited_text")


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """All sections delivered again, those without a heading amended under a later id: the last of a number wins."""
    rows = table(spark, d, "statute_sections").select("section_id", "statute_id", "section_number", "content", "heading")
    late = rows.where("heading is null").withColumn("content", F.concat(F.lit("amended: "), F.col("content"))).withColumn("section_id", F.col("section_id") + 100_000)
    return tables.upsert(rows.drop("heading"), rows.unionByName(late).drop("heading"), ["statute_id", "section_number"], [F.col("section_id")])


def lookup_or_insert(spark: SparkSession, d: str) -> DataFrame:
    """Statutes looked up by title, the older ones from a moved file, and two new ones."""
    all_ = table(spark, d, "statutes")
    old = all_.select("id", "title", "source_file")
    new = all_.where("act_year < 1955").select("title", F.concat(F.lit("moved/"), "source_file").alias("source_file")).unionByName(spark.createDataFrame([("Added Act, 1990", "a.pdf"), ("Brought In Code, 1991", "b.pdf")], "title string, source_file string"))
    return tables.lookup_or_insert(old, new, "title", "id", ["source_file"])


def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "judgment_chunks").select("chunk_id", "judgment_id").distinct()
    return tables.surrogate_keys(chunks, ["judgment_id", "chunk_id"], "row_id").select("row_id", "judgment_id", "chunk_id")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Chunks left after the judgments without a date were deleted."""
    kept = table(spark, d, "judgments").where("date_of_judgment is not null")
    return tables.without_children(kept, table(spark, d, "judgment_chunks"), "id", "judgment_id").groupBy("judgment_id").agg(F.count("*").alias("n"))


def anti_join_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return tables.unprocessed(table(spark, d, "judgments"), table(spark, d, "citation_edges"), "id", "source_judgment_id").select("id")


def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to 50 edges per resolution method in a seeded order, each beside its target."""
    rows = tables.stratified_sample(table(spark, d, "citation_edges").withColumn("method", F.coalesce("resolution_method", F.lit("none"))), "method", "edge_id", 50)
    cases = table(spark, d, "judgments").select(F.col("id").alias("target_judgment_id"), F.col("court").alias("target_court"))
    return rows.join(cases, "target_judgment_id", "left").select("method", "edge_id", "cited_text", "target_judgment_id", "target_court")


def retention(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that are kept 2 hours before the end of the event log."""
    log = table(spark, d, "events").where("user_id is not null")
    sessions = log.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.max("ts").alias("last_active"))
    end = log.agg(F.max("ts").alias("now"))
    kept = sessions.join(F.broadcast(end)).where((F.col("session_id") == "default") | (F.col("last_active") >= F.col("now") - F.expr("interval 2 hours")))
    return kept.select("session_id", "last_active")


def changed_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Judgments whose stored court or file would change if both were trimmed and blanks filled."""
    old = table(spark, d, "judgments").select("id", "court", "source_file")
    new = old.select("id", F.coalesce(F.trim("court"), F.lit("Unknown")).alias("court"), F.trim("source_file").alias("source_file"))
    return tables.changed_rows(old, new, "id", ["court", "source_file"]).select("id", "court", "source_file")


def resolution_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolver.resolution_counts(table(spark, d, "citation_edges"))


def backfill_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Judgments with an unknown party whose own text names it."""
    todo = table(spark, d, "judgments").where("petitioner = 'Unknown' or respondent = 'Unknown'")
    found = documents.with_metadata(todo.select("id", documents.clean_judgment("judgment_text").alias("t")), "t").select("id", "metadata.petitioner", "metadata.respondent")
    return tables.changed_rows(todo, found, "id", ["petitioner", "respondent"])


def top_years(spark: SparkSession, d: str) -> DataFrame:
    """The ten years with most judgments."""
    n = table(spark, d, "judgments").where("date_of_judgment is not null").groupBy(F.year("date_of_judgment").alias("year")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "year").limit(10)


def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The sections of every statute in a shuffled order that each run repeats."""
    rows = table(spark, d, "statute_sections").select("statute_id", "section_id", text.seeded_key("section_id").alias("k"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("statute_id").orderBy("k", "section_id"))).drop("k")


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    """Median, greatest and number of values per event type."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.max("value").alias("most"), F.count("value").alias("n"))


def statute_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statutes").select("id", text.statute_kind("source_file").alias("kind"), text.document_link(F.lit("statute"), F.lit(None), "id").alias("link"))


def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return part("judgments", table(spark, d, "judgments")).unionByName(part("chunks", table(spark, d, "judgment_chunks").select("chunk_id").distinct())).unionByName(part("vectors", table(spark, d, "judgment_embeddings").select("chunk_id").distinct())).unionByName(part("edges", table(spark, d, "citation_edges")))


QUERIES = {f.__name__: f for f in (dedupe_groups, dedupe_totals, dedupe_keepers, dedupe_dry_run, insert_ignore, upsert_last_wins, lookup_or_insert, surrogate_keys, cascade_delete, anti_join_unprocessed, review_sample, retention, changed_metadata, resolution_counts, backfill_metadata, top_years, seeded_shuffle, latency_stats, statute_files, corpus_counts)}

_GROUPS = "SELECT md5(judgment_text) hash, count(*) n, min(id) keeper FROM judgments GROUP BY 1 HAVING count(*) > 1"
SQL = {
    "dedupe_groups": _GROUPS,
    "dedupe_totals": f"SELECT count(*) groups, coalesce(sum(n - 1), 0)::BIGINT removable FROM ({_GROUPS})",
    "dedupe_keepers": "SELECT min(id) id FROM judgments GROUP BY md5(judgment_text)",
    "dedupe_dry_run": "SELECT id FROM judgments WHERE id NOT IN (SELECT min(id) FROM judgments GROUP BY md5(judgment_text))",
    "insert_ignore": f"SELECT edge_id, source_judgment_id, target_judgment_id, cited_text FROM citation_edges n WHERE created_at >= TIMESTAMP '{CUT}' AND NOT EXISTS (SELECT 1 FROM citation_edges o WHERE o.created_at < TIMESTAMP '{CUT}' AND o.source_judgment_id = n.source_judgment_id AND coalesce(o.target_judgment_id, -1) = coalesce(n.target_judgment_id, -1) AND o.cited_text = n.cited_text) QUALIFY row_number() OVER (PARTITION BY source_judgment_id, coalesce(target_judgment_id, -1), cited_text ORDER BY edge_id) = 1",
    "upsert_last_wins": """WITH new AS (SELECT section_id, statute_id, section_number, content FROM statute_sections UNION ALL SELECT section_id + 100000, statute_id, section_number, 'amended: ' || content FROM statute_sections WHERE heading IS NULL),
        last AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY statute_id, section_number ORDER BY section_id DESC) = 1)
        SELECT section_id, statute_id, section_number, content FROM statute_sections ANTI JOIN last USING (statute_id, section_number) UNION ALL SELECT section_id, statute_id, section_number, content FROM last""",
    "lookup_or_insert": """SELECT id, title, CASE WHEN act_year < 1955 THEN 'moved/' || source_file ELSE source_file END source_file FROM statutes
        UNION ALL SELECT (SELECT max(id) FROM statutes) + 1, 'Added Act, 1990', 'a.pdf' UNION ALL SELECT (SELECT max(id) FROM statutes) + 2, 'Brought In Code, 1991', 'b.pdf'""",
    "surrogate_keys": "SELECT row_number() OVER (ORDER BY judgment_id, chunk_id) row_id, judgment_id, chunk_id FROM (SELECT DISTINCT judgment_id, chunk_id FROM judgment_chunks)",
    "cascade_delete": "SELECT judgment_id, count(*) n FROM judgment_chunks WHERE judgment_id IN (SELECT id FROM judgments WHERE date_of_judgment IS NOT NULL) GROUP BY judgment_id",
    "anti_join_unprocessed": "SELECT id FROM judgments WHERE NOT EXISTS (SELECT 1 FROM citation_edges WHERE source_judgment_id = id)",
    "review_sample": "WITH s AS (SELECT coalesce(resolution_method, 'none') AS method, edge_id, cited_text, target_judgment_id FROM citation_edges QUALIFY row_number() OVER (PARTITION BY coalesce(resolution_method, 'none') ORDER BY md5(edge_id || '-42'), edge_id) <= 50) SELECT method, edge_id, cited_text, target_judgment_id, court target_court FROM s LEFT JOIN judgments ON id = target_judgment_id",
    "retention": "WITH s AS (SELECT user_id::VARCHAR session_id, max(ts) last_active FROM events WHERE user_id IS NOT NULL GROUP BY 1) SELECT * FROM s WHERE session_id = 'default' OR last_active >= (SELECT max(ts) FROM events WHERE user_id IS NOT NULL) - INTERVAL 2 HOURS",
    "changed_metadata": "SELECT id, coalesce(trim(court), 'Unknown') court, trim(source_file) source_file FROM judgments WHERE court IS DISTINCT FROM coalesce(trim(court), 'Unknown') OR source_file IS DISTINCT FROM trim(source_file)",
    "resolution_counts": "SELECT coalesce(resolution_method, 'unresolved') AS method, count(*) n, round(count(*) / sum(count(*)) OVER (), 4) share FROM citation_edges GROUP BY 1",
    "top_years": "SELECT year(date_of_judgment) AS year, count(*) n FROM judgments WHERE date_of_judgment IS NOT NULL GROUP BY 1 ORDER BY n DESC, year LIMIT 10",
    "seeded_shuffle": "SELECT statute_id, section_id, row_number() OVER (PARTITION BY statute_id ORDER BY md5(section_id || '-42'), section_id) AS position FROM statute_sections",
    "latency_stats": "SELECT event_type, round(median(value), 6) AS median, max(value) most, count(value) n FROM events GROUP BY event_type",
    "statute_files": "SELECT id, CASE WHEN contains(lower(source_file), 'constitution') THEN 'constitution' WHEN contains(lower(source_file), 'bns') OR contains(lower(source_file), 'nyaya') THEN 'penal code' WHEN contains(lower(source_file), 'act') OR contains(lower(source_file), 'code') THEN 'act' ELSE 'other' END kind, '/documents/section/' || id link FROM statutes",
    "corpus_counts": "SELECT 'judgments' AS name, count(*) n FROM judgments UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM judgment_chunks UNION ALL SELECT 'vectors', count(DISTINCT chunk_id) FROM judgment_embeddings UNION ALL SELECT 'edges', count(*) FROM citation_edges",
}
