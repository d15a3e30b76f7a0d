"""The corpus build: chunks and aliases, then edges, then graph statistics, each an idempotent table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.functions import documents
from docketloom.operators import graph, resolver, tables
from docketloom.sources.files import replace_table
from docketloom.sources.tables import table


def chunk_table(judgments: DataFrame) -> DataFrame:
    """(chunk_id, judgment_id, section, content) in the order of the texts."""
    flat = documents.with_section_chunks(judgments.select(F.col("id").alias("judgment_id"), documents.clean_judgment("judgment_text").alias("t")), "t").select("judgment_id", F.posexplode("chunks").alias("piece", "c"))
    return tables.surrogate_keys(flat.select("judgment_id", "piece", "c.section", "c.content"), ["judgment_id", "piece"], "chunk_id").select("chunk_id", "judgment_id", "section", "content")


def graph_stats(spark: SparkSession, judgments: DataFrame, edges: DataFrame) -> DataFrame:
    """(judgment_id, in_degree, out_degree, pagerank) for all judgments."""
    rank = graph.pagerank(spark, judgments, edges)
    return graph.degrees(judgments, edges).join(rank, "id").withColumnRenamed("id", "judgment_id")


def build(spark: SparkSession, folder: str, out: str) -> list[str]:
    """Write judgment_chunks, judgment_aliases, citation_edges and judgment_graph_stats under ``out``."""
    judgments = tables.keepers(table(spark, folder, "judgments"), "id", "judgment_text")
    replace_table(chunk_table(judgments), f"{out}/judgment_chunks.parquet")
    replace_table(resolver.alias_table(judgments), f"{out}/judgment_aliases.parquet")
    replace_table(resolver.build_edges(spark, judgments), f"{out}/citation_edges.parquet")
    edges = spark.read.parquet(f"{out}/citation_edges.parquet").withColumn("edge_id", F.monotonically_increasing_id())
    replace_table(graph_stats(spark, judgments.select("id"), edges), f"{out}/judgment_graph_stats.parquet")
    return ["judgment_chunks", "judgment_aliases", "citation_edges", "judgment_graph_stats"]
