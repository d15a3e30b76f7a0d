"""Text functions, names, citations and documents over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.functions import citations, documents, names, text
from docketloom.operators import graph, resolver
from docketloom.sources.tables import table


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judgments")


def case_label(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).select("id", text.case_label("petitioner", "respondent").alias("label"))


def display_name(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).select("id", text.display_name("petitioner", "respondent").alias("name"))


def garbled_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.is_garbled("text").alias("garbled"), F.round(text.non_ascii_share("text"), 6).alias("share"))


def md5_hash(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).select("id", text.content_hash("judgment_text").alias("hash"))


def title_from(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statute_sections").select("section_id", text.title_from("content").alias("title"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate("text").alias("tokens"))


def follow_up(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statute_sections").select("section_id", text.is_follow_up("heading").alias("follow_up"))


def explicit_provision(spark: SparkSession, d: str) -> DataFrame:
    kind, number = text.explicit_provision("content")
    return table(spark, d, "statute_sections").select("section_id", kind.alias("kind"), number.alias("number"))


def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statute_sections").select("section_id", F.round(text.word_overlap("heading", "content"), 6).alias("overlap"))


def relationship_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citation_edges").groupBy(text.relationship_rank("relationship_type").alias("rel_rank")).agg(F.count("*").alias("n"))


def year_window(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose target lies within a year of the year the text gives, unknown years passing."""
    edges = table(spark, d, "citation_edges").withColumn("cited_year", citations.cited_year("cited_text"))
    dated = edges.join(_judgments(spark, d).select(F.col("id").alias("target_judgment_id"), F.year("date_of_judgment").alias("year")), "target_judgment_id")
    return dated.where("year is null or cited_year is null or abs(year - cited_year) <= 1").select("edge_id", "cited_year", "year")


def contains_filter(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).where(F.lower("court").contains("bench") | F.lower("petitioner").contains("m/s.")).select("id", "court")


def unknown_parties(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).where("petitioner = 'Unknown' or respondent = 'Unknown'").select("id")


def provision_labels(spark: SparkSession, d: str) -> DataFrame:
    """Sections with the label of their statute; a shortened title falls back to the full one."""
    statutes = table(spark, d, "statutes").select(F.col("id").alias("statute_id"), "title")
    return table(spark, d, "statute_sections").join(statutes, "statute_id").select("section_id", F.concat("title", F.lit(", "), text.provision_label("title"), F.lit(" "), "section_number").alias("label"))


def exact_section(spark: SparkSession, d: str) -> DataFrame:
    """The first section of every number of the constitution."""
    rows = table(spark, d, "statute_sections").join(table(spark, d, "statutes").where("short_title = 'Constitution'").select(F.col("id").alias("statute_id")), "statute_id", "left_semi")
    return rows.groupBy(F.lower("section_number").alias("number")).agg(F.min("section_id").alias("section_id"))


def clean_judgments(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).select("id", F.md5(documents.clean_judgment("judgment_text")).alias("hash"))


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    cut = documents.word_windows(table(spark, d, "documents"), "doc_id", "text")
    return cut.select(F.col("id").alias("doc_id"), "piece", "section", F.md5("content").alias("hash"))


def section_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judgment_chunks").where("content is not null").groupBy(documents.section_of("content").alias("named"), "section").agg(F.count("*").alias("n"))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    flat = documents.with_section_chunks(_judgments(spark, d).select("id", "judgment_text"), "judgment_text").select("id", F.posexplode("chunks").alias("piece", "c"))
    return flat.select("id", "piece", "c.section", F.length("c.content").alias("chars"), F.md5("c.content").alias("hash"))


def judgment_metadata(spark: SparkSession, d: str) -> DataFrame:
    found = documents.with_metadata(_judgments(spark, d).select("id", documents.clean_judgment("judgment_text").alias("t")), "t")
    return found.select("id", "metadata.petitioner", "metadata.respondent", F.to_date("metadata.date_of_judgment").alias("date_of_judgment"), "metadata.bench", "metadata.header", "metadata.reporters")


def normal_case_names(spark: SparkSession, d: str) -> DataFrame:
    return _judgments(spark, d).select("id", names.normal_case_name("petitioner").alias("petitioner"), names.normal_case_name("respondent").alias("respondent"))


def case_aliases(spark: SparkSession, d: str) -> DataFrame:
    return resolver.alias_table(_judgments(spark, d))


def reporter_keys(spark: SparkSession, d: str) -> DataFrame:
    flat = citations.with_reporter_keys(table(spark, d, "citation_edges").select("edge_id", "cited_text"), "cited_text").select("edge_id", F.explode("reporters").alias("r"))
    return flat.select("edge_id", "r.key", "r.loose_key")


def citation_mentions(spark: SparkSession, d: str) -> DataFrame:
    flat = citations.with_mentions(_judgments(spark, d).select("id", "judgment_text"), "judgment_text").select("id", F.explode("mentions").alias("m"))
    return flat.select("id", "m.cited_text", "m.relationship_type")


def resolve_citations(spark: SparkSession, d: str) -> DataFrame:
    """Every stored citation resolved anew against the judgments."""
    said = table(spark, d, "citation_edges").select(F.col("edge_id").cast("string").alias("mention_id"), "cited_text", F.col("source_judgment_id").alias("source_id"))
    years = _judgments(spark, d).select("id", F.year("date_of_judgment").alias("year"))
    found = resolver.resolve(spark, said, resolver.alias_table(_judgments(spark, d)), years)
    return found.select(F.col("mention_id").cast("long").alias("edge_id"), "judgment_id", "method", F.round("score", 4).alias("score"))


def build_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolver.build_edges(spark, _judgments(spark, d))


def case_search(spark: SparkSession, d: str) -> DataFrame:
    """The texts of every fiftieth stored citation as search queries."""
    asked = table(spark, d, "citation_edges").where("edge_id % 50 = 0").select(F.col("cited_text").alias("query"))
    return graph.search_cases(resolver.alias_table(_judgments(spark, d)), _judgments(spark, d).select("id", "petitioner", "respondent"), asked)


QUERIES = {
    f.__name__: f
    for f in (
        case_label, display_name, garbled_filter, md5_hash, title_from, token_estimate, follow_up, explicit_provision, word_overlap, relationship_counts, year_window, contains_filter,
        unknown_parties, provision_labels, exact_section, clean_judgments, word_windows, section_labels, section_chunks, judgment_metadata, normal_case_names, case_aliases, reporter_keys,
        citation_mentions, resolve_citations, build_edges, case_search,
    )
}


def _words(col: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(coalesce({col}, ''), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')"


def _normal(col: str) -> str:
    out = f"replace(lower(coalesce({col}, '')), '&', ' and ')"
    for pattern, to in (
        (r"\b(?:versus|vs|v)\b\.?", " v "), ("[^a-z0-9 ]", " "), (" +", " "), ("TRIM", ""),
        *((rf"\bstate of {short}\b", f"state of {full}") for short, full in names.STATES),
        (r"\bu ?o ?i\b", "union of india"), (r"\b(?:and )?(?:ors|others|anr|another|etc)\b", " "), (r"\bm s\b", " "), (r"\bthe\b", " "), (" +", " "), ("TRIM", ""),
    ):
        out = f"trim({out})" if pattern == "TRIM" else f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


_OPEN = " OR ".join(f"starts_with(t, '{o}')" for o in text.FOLLOW_UP_OPENERS)
_REFER = "[" + ", ".join(f"'{w}'" for w in text.REFERRING_WORDS.split()) + "]"
_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(content, '{words}') THEN '{name}'" for name, words in documents.SECTION_WORDS) + " END"
_ASCII = "length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))"
_LONG = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z]+'), lambda x: length(x) > 2))"

SQL = {
    "case_label": "SELECT id, coalesce(nullif(petitioner, ''), 'Unknown') || ' v. ' || coalesce(nullif(respondent, ''), 'Unknown') label FROM judgments",
    "garbled_filter": f"SELECT doc_id, coalesce(CASE WHEN length(text) > 0 THEN {_ASCII} / length(text) ELSE 1.0 END > 0.2, true) garbled, round(CASE WHEN length(text) > 0 THEN {_ASCII} / length(text) ELSE 1.0 END, 6)::DOUBLE AS share FROM documents",
    "md5_hash": "SELECT id, md5(judgment_text) hash FROM judgments",
    "title_from": "SELECT section_id, CASE WHEN b = '' THEN 'New chat' WHEN length(b) <= 80 THEN b ELSE (CASE WHEN contains(substr(b, 1, 79), ' ') THEN regexp_replace(substr(b, 1, 79), ' [^ ]*$', '') ELSE substr(b, 1, 79) END) || '…' END title FROM (SELECT section_id, trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) b FROM statute_sections)",
    "token_estimate": f"SELECT doc_id, floor(len({_words('text')}) * 1.3)::INT tokens FROM documents",
    "follow_up": f"SELECT section_id, coalesce(len(w) > 0 AND (len(w) <= 4 OR {_OPEN} OR list_has_any(w, {_REFER})), false) follow_up FROM (SELECT section_id, trim(lower(heading)) t, regexp_extract_all(trim(lower(heading)), '[a-z'']+') w FROM statute_sections)",
    "explicit_provision": "SELECT section_id, CASE WHEN a <> '' THEN 'article' WHEN b <> '' THEN 'section' END kind, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b END number FROM (SELECT section_id, regexp_extract(lower(coalesce(content, '')), '\\barticle\\s+(\\d{1,3}[a-z]?)\\b', 1) a, regexp_extract(lower(coalesce(content, '')), '\\bsection\\s+(\\d{1,3}[a-z]?)\\b', 1) b FROM statute_sections)",
    "word_overlap": f"SELECT section_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END, 6)::DOUBLE AS overlap FROM (SELECT section_id, {_LONG.format('heading')} a, {_LONG.format('content')} b FROM statute_sections)",
    "relationship_counts": "SELECT CASE relationship_type WHEN 'overruled' THEN 0 WHEN 'followed' THEN 1 WHEN 'distinguished' THEN 2 WHEN 'referred' THEN 3 WHEN 'cited' THEN 4 ELSE 5 END rel_rank, count(*) n FROM citation_edges GROUP BY 1",
    "year_window": "SELECT edge_id, y cited_year, year(date_of_judgment) AS year FROM (SELECT *, nullif(regexp_extract(cited_text, '[\\[(]((?:1[89]\\d{2}|20\\d{2}))[\\])]', 1), '')::INT y FROM citation_edges) JOIN judgments ON id = target_judgment_id WHERE date_of_judgment IS NULL OR y IS NULL OR abs(year(date_of_judgment) - y) <= 1",
    "contains_filter": "SELECT id, court FROM judgments WHERE contains(lower(court), 'bench') OR contains(lower(petitioner), 'm/s.')",
    "unknown_parties": "SELECT id FROM judgments WHERE petitioner = 'Unknown' OR respondent = 'Unknown'",
    "provision_labels": "SELECT section_id, title || ', ' || CASE WHEN contains(lower(title), 'constitution') THEN 'Art.' ELSE 'Section' END || ' ' || section_number AS label FROM statute_sections JOIN statutes ON id = statute_id",
    "exact_section": "SELECT lower(section_number) number, min(section_id) section_id FROM statute_sections JOIN statutes ON id = statute_id AND short_title = 'Constitution' GROUP BY 1",
    "clean_judgments": "SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(judgment_text, '\\n{3,}', '\n\n', 'g'), '^\\s+', ''), '\\s+$', '')) hash FROM judgments",
    "word_windows": f"WITH w AS (SELECT doc_id, {_words('text')} w FROM documents), p AS (SELECT doc_id, w, unnest(range((len(w) - 1) // 500 + 1)) piece FROM w WHERE len(w) > 0) SELECT doc_id, piece::INT piece, CASE WHEN piece * 500 / len(w) < 0.3 THEN 'facts' WHEN piece * 500 / len(w) < 0.6 THEN 'issues' WHEN piece * 500 / len(w) < 0.8 THEN 'arguments' ELSE 'judgment' END AS section, md5(array_to_string(w[piece * 500 + 1 : piece * 500 + 500], ' ')) hash FROM p",
    "section_labels": f"SELECT {_SECTION} named, section, count(*) n FROM judgment_chunks WHERE content IS NOT NULL GROUP BY ALL",
    "normal_case_names": f"SELECT id, {_normal('petitioner')} petitioner, {_normal('respondent')} respondent FROM judgments",
}
