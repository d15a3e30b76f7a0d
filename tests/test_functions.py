"""Literal cases of names, citations, documents and texts."""

import pytest
from pyspark.sql import functions as F

from docketloom.functions import citations, documents, names, text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("written", "key"),
    [
        ("AIR 1987 SC 1086", "air|1987|sc|1086"), ("A.I.R. 1953 S.C. 75", "air|1953|sc|75"), ("[1950] S.C.R. 940", "scr|1950||940"), ("[1955] 1 S.C.R. 777", "scr|1955|1|777"),
        ("(1992) 1 SCC 588", "scc|1992|1|588"), ("1955 SCR (1) 777", "scr|1955|1|777"), ("1953 AIR 75", "air|1953|sc|75"),
    ],
)
def test_reporter_keys(written, key):
    assert [c["key"] for c in citations.reporter_keys(f"see {written} at the bar")] == [key]


def test_reporter_keys_once_and_in_order():
    found = citations.reporter_keys("1955 SCR (1) 777, then AIR 1960 SC 5 and 1955 SCR (1) 777")
    assert [c["key"] for c in found] == ["scr|1955|1|777", "air|1960|sc|5"]
    assert citations.reporter_keys(None) == [] and citations.reporter_keys("") == []


def test_citation_header():
    assert citations.citation_header("CITATION:\n 1973 AIR 1461  1973 SCR  (4) 1 \n CITATOR INFO :") == "1973 AIR 1461 1973 SCR (4) 1"
    assert citations.citation_header("no block") is None and citations.citation_header(None) is None


def test_mentions_and_treatment():
    said = citations.mentions("In the landmark decision of Vijay Kumar v. State of Karnataka (1987), the court held so. This was later overruled in AIR 1992 SC 588.")
    assert {m["cited_text"] for m in said} == {"AIR 1992 SC 588", "Vijay Kumar v. State of Karnataka (1987)"}
    assert {m["relationship_type"] for m in said} == {"overruled"}
    assert citations.relationship("it was followed and cited") == "followed" and citations.relationship("nothing") == "cited"


def test_names(spark):
    f = lambda s: one(spark, names.normal_case_name("a"), a=s)
    assert f("The State of M.P. & Ors. Vs. Ram Kumar") == "state of madhya pradesh v ram kumar"
    assert f("UOI v. M/s. Tata Steel Ltd.") == "union of india v tata steel ltd"
    alias = lambda p, r: one(spark, names.case_alias("p", "r"), p=p, r=r)
    assert alias("THE STATE OF BOMBAY", "BHANJI MUNJI AND ANOTHER.OCTOBER 12, 1954.[MEHR CHAND") == "state of bombay v bhanji munji"
    assert alias("In re SANT RAM", "RESPONDENT:") is None and alias(None, "A") is None


def test_sides(spark):
    left, right = one(spark, names.party_sides("a"), a="n v shanmugham and co v commissioner of income tax madras")
    assert set(left) == {"shanmugham"} and set(right) == {"madras"}


def test_sections():
    chunks = documents.section_chunks("Facts of the case\n\n" + "a " * 1400 + "\n\nLearned counsel said\n\nWe hold so")
    assert [c["section"] for c in chunks] == ["facts", "arguments", "judgment"]
    assert documents.section_chunks("order here first")[0]["section"] == "facts"  # a change needs something gathered before
    long = documents.section_chunks("word " * 2000)
    assert len(long) > 1 and max(len(c["content"]) for c in long) <= 3000
    assert documents.section_chunks(None) == [] and documents.section_chunks(" \n\n ") == []


def test_metadata():
    told = documents.judgment_metadata("PETITIONER:\nA B\nVs.\nRESPONDENT:\nC D\nDATE OF JUDGMENT: 25/05/1951\nBENCH:\nCITATION:\n 1951 AIR 318\n\n\n\nText")
    assert (told["petitioner"], told["respondent"], told["date_of_judgment"], told["reporters"]) == ("A B", "C D", "1951-05-25", ["1951 AIR 318"])
    plain = documents.judgment_metadata("COURT\n\nA. Person\n      v.\nB. Other\n(John Smith J.)\nMay 1, 1950\n")
    assert (plain["petitioner"], plain["respondent"], plain["bench"]) == ("A. Person", "B. Other", ["John Smith"])
    assert documents.judgment_metadata(None)["petitioner"] == "Unknown"
    assert documents.judgment_metadata("DATE OF JUDGMENT: 45/13/1951")["date_of_judgment"] is None


def test_statutes():
    articles = documents.constitution_articles("1. Name.—India.\n21. Ins. by the Amendment—note\n2. Entry.—States.\n")
    assert [a["section_number"] for a in articles] == ["1", "2"]
    assert [s["section_number"] for s in documents.gazette_sections("1. (1) Short title\n2. In this Act")] == ["1", "2"]


def test_clean(spark):
    raw = "http://JUDIS.NIC.IN   SUPREME COURT OF INDIA   Page 1 of 9\nText\n\n\n\nMore "
    assert one(spark, documents.clean_judgment("a"), a=raw) == "Text\n\nMore"


@pytest.mark.parametrize("message", ["What are its exceptions?", "And who decides that?", "what about bail?", "Why?", "Explain the above in simple terms", "what happens in case the accused is a minor"])
def test_follow_up(spark, message):
    assert one(spark, text.is_follow_up("a"), a=message)


@pytest.mark.parametrize("message", ["What is the punishment for theft under the Bharatiya Nyaya Sanhita?", "Explain the doctrine of basic structure in Indian constitutional law", "", None])
def test_no_follow_up(spark, message):
    assert not one(spark, text.is_follow_up("a"), a=message)


def test_text_functions(spark):
    assert one(spark, text.title_from("a"), a="  What is\n bail?  ") == "What is bail?"
    long = one(spark, text.title_from("a"), a="word " * 100)
    assert len(long) <= 80 and long.endswith("…")
    assert one(spark, text.title_from("a"), a="") == "New chat" and one(spark, text.title_from("a"), a=None) == "New chat"
    assert one(spark, text.carried_query("a", "b"), a="What are its exceptions?", b="What does Article 21 protect?") == "What does Article 21 protect? What are its exceptions?"
    assert one(spark, text.carried_query("a", "b"), a="And that?", b=None) == "And that?"
    assert one(spark, text.title_case("a"), a="N. V. o'BRIEN-smith & m/s.TATA") == "N. V. O'Brien-Smith & M/S.Tata"
    assert one(spark, text.case_label("a", "b"), a="", b=None) == "Unknown v. Unknown"
    assert one(spark, text.display_side("a"), a="x" * 60) == "X" + "x" * 49 + "..."
    assert one(spark, text.is_garbled("a"), a="ééab") and one(spark, text.is_garbled("a"), a="") and not one(spark, text.is_garbled("a"), a="plain")
    assert [one(spark, text.session_id_valid("a"), a=s) for s in ("default", "a" * 32, "", "new", "A" * 32, None)] == [True, True, False, False, False, False]
    assert one(spark, text.trigram_similarity(F.col("a"), F.col("b")), a="word", b="word") == 1.0
    assert one(spark, text.context_window("a"), a="gpt-4o") == 128000 and one(spark, text.context_window("a"), a="zzz") == 32768
    kind, number = text.explicit_provision("a")
    assert one(spark, number, a="Does Article 21A or section 302 apply?") == "21a" and one(spark, kind, a="section 302") == "section"
