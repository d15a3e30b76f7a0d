"""Reading judgments and statutes: cleaning, metadata, section labels, chunks and provisions."""

from __future__ import annotations

import re
from datetime import datetime
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketloom.functions import citations

# Boilerplate, section words (first match in this order) and provision formats.
SECTION_WORDS = (
    ("facts", r"(?i)facts of the case|\bfacts\b|background|facts and circumstances|the facts are|brief facts"),
    ("issues", r"(?i)issues? arising|questions? for consideration|points? for determination|the issue is|issues framed"),
    ("arguments", r"(?i)arguments? advanced|submissions?|contentions?|learned counsel|learned senior counsel|learned attorney"),
    ("ratio", r"(?i)ratio decidendi|legal principles|principles laid down|the law is|the legal position|precedent|jurisprudence"),
    ("judgment", r"(?i)\bjudgment\b|\border\b|\bdecision\b|\bconclusion\b|\bholding\b|we hold|we conclude|\baccordingly\b|in the result"),
)
PORTAL_LINES = (
    r"http://JUDIS\.NIC\.IN\s+SUPREME COURT OF INDIA\s+Page \d+ of \d+\s*",
    r"http://JUDIS\.NIC\.IN\s*\n?",
    r"SUPREME COURT OF INDIA\s+Page \d+ of \d+\s*\n?",
)
MONTH_WORD = r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"
ARTICLE = r"^\s*(\d{1,3}[A-Za-z]?)\.\s+(.+?)—"
FOOTNOTE = r"^(?:Ins|Subs|Rep|Am|Omitted)\.\s"
GAZETTE_SECTION = r"^\s*(\d{1,3})\.\s*(?:\(\d+\)\s*)?([A-Z(])"
CHUNK_CHARS = 3_000
WINDOW_WORDS = 500
HEADER_LINES = 20

CHUNKS = "array<struct<section:string,content:string>>"
PROVISIONS = "array<struct<section_number:string,heading:string,content:string>>"
METADATA = "struct<petitioner:string,respondent:string,date_of_judgment:string,bench:array<string>,header:string,reporters:array<string>>"

_sections = [(name, re.compile(words)) for name, words in SECTION_WORDS]
_month = re.compile(MONTH_WORD)


def clean_judgment(col: str | Column) -> Column:
    """Portal boilerplate removed, blank lines collapsed, ends stripped."""
    s = F.col(col) if isinstance(col, str) else col
    for pattern in PORTAL_LINES:
        s = F.regexp_replace(s, pattern, "")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"\s+$", "")


def section_of(col: str | Column) -> Column:
    """The first section whose words a paragraph has; null for none."""
    text = F.col(col) if isinstance(col, str) else col
    out = None
    for name, words in SECTION_WORDS:
        out = F.when(text.rlike(words), name) if out is None else out.when(text.rlike(words), name)
    return out


def section_chunks(text: str | None, most: int = CHUNK_CHARS, parting: str = "\n\n") -> list[dict]:
    """Paragraphs gathered by section into chunks of about ``most`` characters.

    A section word starts a new chunk only when something was gathered before it;
    a paragraph beyond the limit is cut between words.
    """
    out: list[dict] = []
    section, held, size = "facts", [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append({"section": section, "content": "\n".join(held)})
        held, size = [], 0

    for paragraph in (p.strip() for p in (text or "").split(parting)):
        if not paragraph:
            continue
        named = next((name for name, words in _sections if words.search(paragraph)), None)
        if named and named != section and held:
            flush()
            section = named
        if held and size + len(paragraph) > most:
            flush()
        if len(paragraph) <= most:
            held.append(paragraph)
            size += len(paragraph)
            continue
        piece: list[str] = []
        length = 0
        for word in paragraph.split():
            if piece and length + len(word) + 1 > most:
                out.append({"section": section, "content": " ".join(piece)})
                piece, length = [], 0
            piece.append(word)
            length += len(word) + 1
        held, size = [" ".join(piece)], length
    flush()
    return out


def with_section_chunks(df: DataFrame, column: str, out: str = "chunks", parting: str = "\n\n") -> DataFrame:
    return citations._arrow(df, column, out, CHUNKS, lambda t: section_chunks(t, parting=parting))


def word_windows(df: DataFrame, id_col: str, text_col: str, size: int = WINDOW_WORDS) -> DataFrame:
    """(id, piece, section, content): windows of ``size`` words, the section told by position alone."""
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    base = df.select(F.col(id_col).alias("id"), words.alias("w")).where(F.size("w") > 0)
    cut = base.select("id", "w", F.explode(F.sequence(F.lit(0), F.expr(f"(size(w) - 1) div {size}"))).alias("piece"))
    at = F.col("piece") * size / F.size("w")
    section = F.when(at < 0.3, "facts").when(at < 0.6, "issues").when(at < 0.8, "arguments").otherwise("judgment")
    return cut.select("id", F.col("piece").cast("int").alias("piece"), section.alias("section"), F.array_join(F.slice("w", (F.col("piece") * size + 1).cast("int"), size), " ").alias("content"))


# ---------------------------------------------------------------- metadata
# The labels of the printed header, those that end a field, and lines that are no value.
FIELD_ENDS = {"PETITIONER": r"RESPONDENT:|Vs\.|vs\.|V\.", "RESPONDENT": r"DATE OF JUDGMENT:|BENCH:|ACT:"}
NO_VALUE = r"ACT:|BENCH:|Vs\.|vs\.|V\."
VERSUS = r"[A-D]?\s*(?:v\.?|vs\.?|versus)\s*"
MARGIN = r"^[A-D]\s+"
JUDGES = r"\(([^)]*JJ?\.?)\)"
JUDGE = r"([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z])?)\s*\.?\s*J\.?"

_fields = {label: re.compile(rf"^{label}:\n(?:(?!(?:{ends})$)(?:(?:{NO_VALUE}).*)?\n)*+(?!(?:{ends})$|{NO_VALUE})(.+)$", re.MULTILINE) for label, ends in FIELD_ENDS.items()}
_versus = re.compile(VERSUS, re.IGNORECASE)
_judges = re.compile(JUDGES, re.IGNORECASE)
_judge = re.compile(JUDGE)
_day = re.compile(r"DATE OF JUDGMENT:\s*(\d{2})/(\d{2})/(\d{4})")
_bench = re.compile(r"BENCH:\s*\[?([^\]\n]+)")


def _field(header: str, label: str) -> str | None:
    """The value printed below a label; the last label that stands in the header counts."""
    told = header[max(header.rfind(f"\n{label}:\n"), 0) :]
    m = _fields[label].search(told)
    return m[1] if m else None


def _kind(line: str) -> str:
    """What a line of a cause title is: a blank, the word between the parties, the bench, a date or a name (-, v, b, d, n)."""
    return "-" if not line else "v" if _versus.fullmatch(line) else "b" if _judges.search(line) else "d" if _month.search(line) else "n"


# the block of lines above the word between the parties, and what stands below it
_title = re.compile(r"(?P<above>(?:[nbd]+)?)-*v-*(?P<below>[nv]*)(?P<bench>b?)")


def _cause_title(lines: list[str]) -> tuple[str | None, str | None, str | None]:
    """Parties around a line that holds only ``v.``, and the bench in brackets below, read off the kinds of the lines."""
    plain = [re.sub(MARGIN, "", x).strip() for x in lines]
    m = _title.search("".join(map(_kind, plain)))
    if not m:
        return None, None, None
    part = lambda name: " ".join(plain[slice(*m.span(name))])
    judges = _judges.search(part("bench"))
    return part("above") or None, part("below") or None, judges[1] if judges else None


def judgment_metadata(text: str | None) -> dict:
    """Parties, date, bench and own citations of a cleaned judgment."""
    text = text or ""
    lines = text.split("\n")[:HEADER_LINES]
    header = "\n".join(x.strip() for x in ("", *lines, ""))
    names = {label: _field(header, label) for label in FIELD_ENDS}
    title = _cause_title(lines) if not all(names.values()) else (None, None, None)
    date, named, own = None, _bench.search(text), citations.citation_header(text)
    if day := _day.search(text):
        try:
            date = datetime(*map(int, day.groups()[::-1])).strftime("%Y-%m-%d")
        except ValueError:
            date = None
    return {
        "petitioner": names["PETITIONER"] or title[0] or "Unknown", "respondent": names["RESPONDENT"] or title[1] or "Unknown", "date_of_judgment": date,
        "bench": _judge.findall(named[1].strip() if named else title[2] or ""), "header": own, "reporters": [c["raw"] for c in citations.reporter_keys(own)],
    }


def with_metadata(df: DataFrame, column: str, out: str = "metadata") -> DataFrame:
    return citations._arrow(df, column, out, METADATA, judgment_metadata)


# ---------------------------------------------------------------- statutes
# Running titles and notes inside provisions.
CONSTITUTION_NOISE = (r"(?m)^\d+\s+THE CONSTITUTION OF INDIA\s*\(Part.*?\)\s*\n", r"(?m)^\s*\d+\.\s+(?:Ins|Subs|Rep)\.\s.*")
GAZETTE_NOISE = (r"(?m)^\d+\s+THE GAZETTE OF INDIA.*$", r"(?m)^\s*_{3,}\s*\n\s*_{3,}")


def _spans(text: str, pattern: str) -> list[tuple[re.Match, int]]:
    """Every heading with the place where the next one begins."""
    heads = list(re.finditer(pattern, text, re.MULTILINE))
    return list(zip(heads, [*(m.start() for m in heads[1:]), len(text)], strict=False))


def _provisions(found: list[tuple[str, str | None, str]], noise: tuple[str, ...]) -> list[dict]:
    rows = []
    for number, heading, body in found:
        body = body.strip()
        for pattern in noise:
            body = re.sub(pattern, "", body)
        rows.append({"section_number": number, "heading": heading, "content": re.sub(r"\n{3,}", "\n\n", body)})
    return [r for r in rows if r["content"]]


def constitution_articles(text: str | None) -> list[dict]:
    """Articles of a constitution; amendment notes are no headers, and a sharp fall of the number ends the articles."""
    text = text or ""
    real = [(m, end) for m, end in _spans(text, ARTICLE) if not re.match(FOOTNOTE, m[2].strip(), re.IGNORECASE)]
    numbers = [int(re.match(r"\d+", m[1])[0]) for m, _ in real]
    # the schedules begin where the number falls far below the highest one so far
    highest = accumulate(numbers, max, initial=0)
    fallen = next((k for k, (top, now) in enumerate(zip(highest, numbers, strict=False)) if top > 50 and now < top - 20), len(real))
    return _provisions([(m[1], m[2].strip(), text[m.end() : end]) for m, end in real[:fallen]], CONSTITUTION_NOISE)


def gazette_sections(text: str | None) -> list[dict]:
    """Sections of a gazette text, without headings."""
    text = text or ""
    return _provisions([(m[1], None, text[m.start() : end]) for m, end in _spans(text, GAZETTE_SECTION)], GAZETTE_NOISE)


def with_provisions(df: DataFrame, column: str, constitution: bool, out: str = "provisions") -> DataFrame:
    return citations._arrow(df, column, out, PROVISIONS, constitution_articles if constitution else gazette_sections)
