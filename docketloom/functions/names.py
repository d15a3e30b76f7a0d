"""Case names as Column expressions: cleaning, normal form and alias."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State abbreviations, words too common to identify a case, and sentence openers.
STATES = (
    ("m ?p", "madhya pradesh"), ("u ?p", "uttar pradesh"), ("a ?p", "andhra pradesh"), ("h ?p", "himachal pradesh"),
    ("w ?b", "west bengal"), ("t ?n", "tamil nadu"), ("j ?(?:and ?)?k", "jammu and kashmir"),
)
STOPWORDS = (
    "v of and the state union india ltd limited co company pvt private m s mr shri sri smt dr in re ex parte by through govt government his her holiness "
    "commissioner income tax collector customs excise central sales wealth officer municipal corporation board district magistrate workmen employees bank "
    "insurance railway high court appellate tribunal authority secretary director general registrar deputy assistant additional chief controller estate"
)
LEAD_WORDS = "in see also cf per vide following relying relied followed referring applying distinguishing overruling case decision held"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


def normal_case_name(col: str | Column) -> Column:
    """Lower case, ``&`` spelt out, separators as ``v``, no punctuation, suffixes for further parties and ``the`` dropped."""
    s = F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    s = F.regexp_replace(s, "&", " and ")
    s = F.regexp_replace(s, r"\b(?:versus|vs|v)\b\.?", " v ")
    s = F.regexp_replace(s, "[^a-z0-9 ]", " ")
    s = F.trim(F.regexp_replace(s, " +", " "))
    for short, full in STATES:
        s = F.regexp_replace(s, rf"\bstate of {short}\b", f"state of {full}")
    s = F.regexp_replace(s, r"\bu ?o ?i\b", "union of india")
    s = F.regexp_replace(s, r"\b(?:and )?(?:ors|others|anr|another|etc)\b", " ")
    s = F.regexp_replace(s, r"\bm s\b", " ")
    s = F.regexp_replace(s, r"\bthe\b", " ")
    return F.trim(F.regexp_replace(s, " +", " "))


def clean_party(col: str | Column) -> Column:
    """A party without leaked labels, bench text, dates, notes on connected appeals or representatives."""
    s = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    for pattern in (
        r"(?i)^\s*(?:petitioner|respondent)\s*:\s*", r"(?s)\[.*$", rf"(?is)\b(?:{MONTHS})\s+\d.*$", r"(?is)\(\s*(?:and|with|c\b)[^)]*\)?.*$",
        r"(?is)\band connected\b.*$", r"(?is)-{2,}\s*intervener.*$", r"(?i)\(\s*dead\s*\)\s*(?:by|through)?\s*(?:legal representatives?|l\.?\s?rs?\.?)?",
    ):
        s = F.regexp_replace(s, pattern, " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"\s+$", ""))
    label = F.upper(F.regexp_replace(s, ":+$", "")).isin("RESPONDENT", "PETITIONER", "UNKNOWN")
    return F.when(label, "").otherwise(s)


def case_alias(petitioner: str | Column, respondent: str | Column) -> Column:
    """``a v b`` in normal form; null unless both sides are named and it is longer than 8 characters."""
    a, b = normal_case_name(clean_party(petitioner)), normal_case_name(clean_party(respondent))
    alias = F.concat(a, F.lit(" v "), b)
    good = (a != "") & (b != "") & (a != "unknown") & (b != "unknown") & (F.length(alias) > 8)
    return F.when(good, alias)


def _stop() -> Column:
    return F.array(*[F.lit(w) for w in STOPWORDS.split()])


def distinctive(words: Column) -> Column:
    """Distinct words that can identify a party: no stop word, longer than two letters, not a number."""
    return F.array_except(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$"))), _stop())


def party_sides(alias: str | Column) -> Column:
    """struct(left, right): distinctive words of both parties.

    Initials may hold a ``v``, so the alias is parted at the ``v`` that leaves most words on its weaker side.
    """
    words = F.split(F.col(alias) if isinstance(alias, str) else alias, " ")
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.size(words) - 1, F.lit(2))), lambda i: F.get(words, i - 1) == "v")
    cuts = F.transform(places, lambda i: F.struct(distinctive(F.slice(words, 1, i - 1)).alias("left"), distinctive(F.slice(words, i + 1, F.size(words))).alias("right"), i.alias("at")))
    scored = F.transform(cuts, lambda c: F.struct((-F.least(F.size(c["left"]), F.size(c["right"]))).alias("s"), c["at"].alias("at"), c["left"].alias("left"), c["right"].alias("right")))
    best = F.get(F.array_sort(scored), F.lit(0))
    return F.struct(best["left"].alias("left"), best["right"].alias("right"))


def party_words(raw: Column) -> Column:
    """Distinctive words of a party as written in running text, sentence openers left out."""
    s = normal_case_name(raw)
    lead = "|".join(LEAD_WORDS.split())
    return distinctive(F.split(F.regexp_replace(s, rf"^(?:(?:{lead})(?: |$))+", ""), " "))
