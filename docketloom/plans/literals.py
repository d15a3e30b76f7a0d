"""Readers of running text on written-out cases: what each must find is stated as rows, not computed by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.functions import citations, documents, names
from docketloom.operators import resolver

REPORTS = (
    (1, "see AIR 1973 SC 1461 at the bar", "air|1973|sc|1461", "air|1973|sc|1461"),
    (2, "A.I.R. (1950) S.C. 27 was cited", "air|1950|sc|27", "air|1950|sc|27"),
    (3, "1978 AIR 597", "air|1978|sc|597", "air|1978|sc|597"),
    (4, "[1978] 2 SCR 621 and nothing else", "scr|1978|2|621", "scr|1978||621"),
    (5, "1973 SCR (4) 1 and again 1973 SCR (4) 1", "scr|1973|4|1", "scr|1973||1"),
    (6, "(1994) 3 SCC 1", "scc|1994|3|1", "scc|1994||1"),
    (7, "AIR 1962 Bom 53", "air|1962|bom|53", "air|1962|bom|53"),
)
NO_REPORTS = ((8, "section 27 of the Act of 1950"), (9, ""), (10, None))

TREATMENTS = (
    (1, "The rule in 1950 SCR 88 was overruled in terms.", "1950 SCR 88", "overruled"),
    (2, "This court followed AIR 1955 SC 123 there.", "AIR 1955 SC 123", "followed"),
    (3, "That case, (1994) 3 SCC 1, is distinguished.", "(1994) 3 SCC 1", "distinguished"),
    (4, "Reference is to [1978] 2 SCR 621 alone.", "[1978] 2 SCR 621", "cited"),
    (5, "It was observed in 1978 AIR 597 that it stands.", "1978 AIR 597", "referred"),
)

ARTICLES = "1. Name and territory.—India is a Union.\n21. Ins. by the Act of 1976—note\n14. Equality.—The State shall not deny.\n226. Writs.—Every High Court.\n3. Schedule.—not an article.\n"
ARTICLE_ROWS = (("1", "Name and territory.", "India is a Union."), ("14", "Equality.", "The State shall not deny."), ("226", "Writs.", "Every High Court."))
SECTIONS = "1. (1) This Act may be called the Act.\n2. In this Act, unless\n__________\n__________\n3. The Board shall meet.\n12 THE GAZETTE OF INDIA EXTRAORDINARY\n"
SECTION_ROWS = (("1", "1. (1) This Act may be called the Act."), ("2", "2. In this Act, unless\n"), ("3", "3. The Board shall meet.\n"))

HEADERS = (
    (1, "PETITIONER:\nA B\nVs.\nRESPONDENT:\nSTATE OF X\nDATE OF JUDGMENT: 25/05/1951\nBENCH:\n", "A B", "STATE OF X", "1951-05-25"),
    (2, "COURT\n\nA. Person\n      v.\nB. Other\n(John Smith J.)\nMay 1, 1950\n", "A. Person", "B. Other", None),
    (3, "No header at all", "Unknown", "Unknown", None),
    (4, "DATE OF JUDGMENT: 45/13/1951", "Unknown", "Unknown", None),
    (5, None, "Unknown", "Unknown", None),
)

SENTENCES = (
    (1, "Facts of the case\n\nthe first matter\n\nLearned counsel said so\n\nWe hold that", (("facts", "Facts of the case\nthe first matter"), ("arguments", "Learned counsel said so"), ("judgment", "We hold that"))),
    (2, "order here first", (("facts", "order here first"),)),
)

CASES = (
    (1, "Maneka Gandhi", "Union of India", "[1978] 2 SCR 621"),
    (2, "Kesavananda Bharati", "State of Kerala", "1973 SCR (4) 1"),
    (3, "State of Kerala", "Thomas Mathew", "1976 SCR (1) 906"),
    (4, "Ram Lal", "State of Punjab", ""),
    (5, "Ram Lal", "State of Punjab", ""),
)
MENTIONS = (
    (1, "[1978] 2 SCR 621", 9, 1, "reporter"),
    (2, "Kesavananda Bharati v. State of Kerala", 9, 2, "exact_name"),
    (3, "[1978] 2 SCR 621", 1, None, "self"),
    (4, "Ram Lal v. State of Punjab", 9, None, "ambiguous"),
    (5, "Nobody Known v. Somebody Else", 9, None, "unresolved"),
    (6, "[1999] 9 SCR 9", 9, None, "unresolved"),
)


def _texts(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([r[:2] for r in rows], "id int, text string")


def reporter_literals(spark: SparkSession, d: str) -> DataFrame:
    flat = citations.with_reporter_keys(_texts(spark, [*REPORTS, *NO_REPORTS]), "text").select("id", F.explode("reporters").alias("r"))
    return flat.select("id", "r.key", "r.loose_key")


def treatment_literals(spark: SparkSession, d: str) -> DataFrame:
    flat = citations.with_mentions(_texts(spark, TREATMENTS), "text").select("id", F.explode("mentions").alias("m"))
    return flat.select("id", "m.cited_text", "m.relationship_type")


def article_literals(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.with_provisions(_texts(spark, [(1, ARTICLES)]), "text", True)
    return rows.select(F.explode("provisions").alias("p")).select("p.section_number", "p.heading", "p.content")


def gazette_literals(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.with_provisions(_texts(spark, [(1, SECTIONS)]), "text", False)
    return rows.select(F.explode("provisions").alias("p")).select("p.section_number", F.rtrim(F.regexp_replace("p.content", r"\s+", " ")).alias("content"))


def header_literals(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.with_metadata(_texts(spark, HEADERS), "text")
    return rows.select("id", "metadata.petitioner", "metadata.respondent", "metadata.date_of_judgment")


def chunk_literals(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.with_section_chunks(_texts(spark, SENTENCES), "text")
    return rows.select("id", F.posexplode("chunks").alias("pos", "c")).select("id", "pos", "c.section", "c.content")


def resolution_literals(spark: SparkSession, d: str) -> DataFrame:
    cases = spark.createDataFrame([(i, p, r, f"CITATION:\n {c}\n\n\nACT:" if c else "", None) for i, p, r, c in CASES], "id long, petitioner string, respondent string, judgment_text string, citations string")
    said = spark.createDataFrame([m[:3] for m in MENTIONS], "mention_id long, cited_text string, source_id long")
    years = spark.createDataFrame([], "id long, year int")
    return resolver.resolve(spark, said, resolver.alias_table(cases), years).select("mention_id", "judgment_id", "method")


def display_literals(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, p, r) for i, p, r, _ in CASES], "id int, petitioner string, respondent string").select("id", names.normal_case_name(F.concat_ws(" v. ", "petitioner", "respondent")).alias("name"))


QUERIES = {f.__name__: f for f in (reporter_literals, treatment_literals, article_literals, gazette_literals, header_literals, chunk_literals, resolution_literals, display_literals)}


def _values(columns: str, rows) -> str:
    """Rows written out as SQL; texts quoted, null as null."""
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


SQL = {
    "reporter_literals": _values("id, key, loose_key", [(i, k, x) for i, _, k, x in REPORTS]),
    "treatment_literals": _values("id, cited_text, relationship_type", [(i, c, k) for i, _, c, k in TREATMENTS]),
    "article_literals": _values("section_number, heading, content", ARTICLE_ROWS),
    "gazette_literals": _values("section_number, content", [(n, " ".join(c.split())) for n, c in SECTION_ROWS]),
    "header_literals": _values("id, petitioner, respondent, date_of_judgment", [(i, p, r, day) for i, _, p, r, day in HEADERS]),
    "chunk_literals": _values("id, pos, section, content", [(i, k, s, c) for i, _, chunks in SENTENCES for k, (s, c) in enumerate(chunks)]),
    "resolution_literals": _values("mention_id, judgment_id, method", [(i, j, m) for i, _, _, j, m in MENTIONS]),
    "display_literals": _values("id, name", [(1, "maneka gandhi v union of india"), (2, "kesavananda bharati v state of kerala"), (3, "state of kerala v thomas mathew"), (4, "ram lal v state of punjab"), (5, "ram lal v state of punjab")]),
}
