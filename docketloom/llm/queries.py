"""The queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.llm import mixing, near_duplicates, neighbours, packing, page_noise, party_names, quality, search, splitting
from docketloom.llm.tokens import with_token_count
from docketloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    chunk = neighbours.most_similar(spark, table(spark, folder, "judgment_embeddings"), "chunk_id", order_col="created_at")
    section = neighbours.most_similar(spark, table(spark, folder, "statute_embeddings"), "section_id")
    kind = lambda df, name: neighbours.similar_pairs(df).select(F.lit(name).alias("vec_kind"), "id_a", "id_b")
    return kind(chunk, "judgment").unionByName(kind(section, "statute"))


def p1_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth section vector searches all of them by the greedy graph walk."""
    rows = table(spark, folder, "statute_embeddings")
    return search.greedy_search(spark, rows.where("section_id % 50 = 0"), rows, "section_id")


def p1_search_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth chunk vector, as delivered last, searches all of them by the greedy graph walk."""
    rows = table(spark, folder, "judgment_embeddings")
    last = rows.where("chunk_id % 50 = 0 and embedding is not null").groupBy("chunk_id").agg(F.max(F.struct("created_at", "embedding"))["embedding"].alias("embedding"))
    return search.greedy_search(spark, last, rows, "chunk_id", order_col="created_at")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the tokens that the mixture reaches, beside the targets."""
    documents, goal = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mix(spark, documents, goal), with_token_count(documents.select("source", "text"), "text"), goal)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Number of containers, tokens in them and the share of their room that is filled."""
    packed = p6_pack(spark, folder)
    boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count("*") * packing.CAPACITY), 6).alias("filled"))


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(spark, table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(spark, table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return party_names.spelling_pairs(p2_parties(spark, folder))


def p2_parties(spark: SparkSession, folder: str) -> DataFrame:
    return party_names.parties(spark, table(spark, folder, "judgments"), nicknames=table(spark, folder, "nicknames"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.all_pairs(*near_duplicates.near_duplicates(spark, table(spark, folder, "judgments")))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(spark, *near_duplicates.near_duplicates(spark, table(spark, folder, "judgments")))


def _long_texts(spark: SparkSession, folder: str) -> list[tuple]:
    return [(table(spark, folder, "judgments"), "judgment", "id", "judgment_text", None), (table(spark, folder, "judgment_chunks"), "chunk", "chunk_id", "content", "section")]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.paragraph_starts(spark, _long_texts(spark, folder))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(spark, _long_texts(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_noise.traces(spark, table(spark, folder, "judgments"))


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_noise.repair_texts(spark, table(spark, folder, "judgments"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(quality.quality(spark, table(spark, folder, "documents"), table(spark, folder, "common_words"), table(spark, folder, "doc_labels")))


def p8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(spark, table(spark, folder, "documents"), table(spark, folder, "common_words"), table(spark, folder, "doc_labels"))


def queries() -> dict:
    found = (p1_found, p1_search, p1_search_chunks, p2_found, p2_parties, p3_found, p3_groups, p4_found, p4_pieces, p5_found, p5_text, p6_pack, p6_fill, p7_mix, p7_shares, p8_found, p8_quality)
    return {f.__name__: f for f in found}


def _pairs_sql(kind: str, table_name: str, key: str, latest: str) -> str:
    return f"""SELECT DISTINCT '{kind}' vec_kind, least(x, y) id_a, greatest(x, y) id_b FROM (
        SELECT a.id x, b.id y, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.id) nth
        FROM (SELECT {key} id, CAST({latest} AS DOUBLE[]) v FROM {table_name} WHERE embedding IS NOT NULL GROUP BY {key}) a
        JOIN (SELECT {key} id, CAST({latest} AS DOUBLE[]) v FROM {table_name} WHERE embedding IS NOT NULL GROUP BY {key}) b ON a.id <> b.id QUALIFY nth <= 10)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator: exact neighbours and exact shingle overlap, over whole tables."""
    return {
        "p1_found": _pairs_sql("judgment", "judgment_embeddings", "chunk_id", "arg_max(embedding, created_at)") + " UNION ALL " + _pairs_sql("statute", "statute_embeddings", "section_id", "any_value(embedding)"),
        "p3_found": """WITH t AS (SELECT id, regexp_extract_all(lower(judgment_text), '[a-z0-9]+') w, judgment_text FROM judgments WHERE judgment_text <> ''),
            g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s FROM t WHERE len(w) >= 3),
            n AS (SELECT id, count(*) n FROM g GROUP BY id),
            m AS (SELECT a.id id_a, b.id id_b, count(*) both_ FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
            SELECT id_a, id_b FROM m JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE both_ >= 0.5 * (x.n + y.n - both_)
            UNION SELECT a.id, b.id FROM t a JOIN t b ON a.id < b.id AND len(a.w) < 3 AND a.w = b.w AND (len(a.w) > 0 OR a.judgment_text = b.judgment_text)""",
    }
