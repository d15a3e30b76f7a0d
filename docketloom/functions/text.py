"""Scalar text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands, ranks and word lists that results depend on.
RELATIONSHIP_RANKS = (("overruled", 0), ("followed", 1), ("distinguished", 2), ("referred", 3), ("cited", 4))
CONFIDENCE_BANDS = ((0.7, "high"), (0.4, "medium"))
REFERRING_WORDS = "it its itself this that these those they them their theirs he him his she her above aforesaid same such former latter said there"
FOLLOW_UP_OPENERS = (
    "and ", "also ", "but ", "so ", "then ", "what about", "how about", "what if", "why ", "why?", "how come", "in that case", "tell me more",
    "explain more", "what happens if", "what happens in case", "what happens when", "in case ", "suppose ", "if ", "even if", "is it ", "does it ", "can it ",
)
CONTEXT_WINDOWS = (("gpt-", 128_000), ("o1", 200_000), ("o3", 200_000), ("gemini-", 1_000_000))
UNKNOWN_WINDOW = 32_768
NO_ANSWER_PHRASES = ("not found in the provided", "no relevant information", "cannot be determined", "not mentioned in the context", "insufficient information", "does not contain", "not available in the", "unable to find")


def _s(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def case_label(petitioner: str | Column, respondent: str | Column) -> Column:
    """``A v. B``; a missing or empty side reads Unknown."""
    side = lambda c: F.coalesce(F.when(_s(c) != "", _s(c)), F.lit("Unknown"))
    return F.concat(side(petitioner), F.lit(" v. "), side(respondent))


def title_case(col: str | Column) -> Column:
    """Upper case for a letter that follows no letter, lower case for the others."""
    parts = F.regexp_extract_all(F.lower(_s(col)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def display_side(col: str | Column, width: int = 50) -> Column:
    """A party for display: title case, cut to ``width`` characters with three dots."""
    name = title_case(F.trim(_s(col)))
    return F.when(F.length(name) > width, F.concat(F.substring(name, 1, width), F.lit("..."))).otherwise(name)


def display_name(petitioner: str | Column, respondent: str | Column) -> Column:
    side = lambda c: F.coalesce(F.when(F.trim(_s(c)) != "", display_side(c)), F.lit("Unknown"))
    return F.concat(side(petitioner), F.lit(" v. "), side(respondent))


def non_ascii_share(col: str | Column) -> Column:
    text = _s(col)
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.length(text)).otherwise(1.0)


def is_garbled(col: str | Column, limit: float = 0.2) -> Column:
    """More than ``limit`` of the characters aren't ASCII; null and empty texts are garbled."""
    return F.coalesce(non_ascii_share(col) > limit, F.lit(True))


def content_hash(col: str | Column) -> Column:
    return F.md5(F.encode(_s(col), "UTF-8"))


def relationship_rank(col: str | Column) -> Column:
    """Strength of a citation's treatment; unknown and null treatments come last."""
    out = None
    for name, rank in RELATIONSHIP_RANKS:
        out = F.when(_s(col) == name, rank) if out is None else out.when(_s(col) == name, rank)
    return out.otherwise(5)


def provision_label(title: str | Column) -> Column:
    return F.when(F.lower(_s(title)).contains("constitution"), "Art.").otherwise("Section")


def confidence_band(col: str | Column) -> Column:
    (high, first), (middle, second) = CONFIDENCE_BANDS
    return F.when(_s(col) >= high, first).when(_s(col) >= middle, second).otherwise("low")


def word_list(col: str | Column) -> Column:
    """Blank-separated words; an empty array for null and blank texts."""
    bare = F.trim(F.regexp_replace(F.coalesce(_s(col), F.lit("")), r"\s+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def token_estimate(col: str | Column) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(F.size(word_list(col)) * 1.3).cast("int")


def title_from(col: str | Column, width: int = 80) -> Column:
    """A one-line title: blanks collapsed, cut at a word with an ellipsis; ``New chat`` if empty."""
    bare = F.trim(F.regexp_replace(F.coalesce(_s(col), F.lit("")), r"\s+", " "))
    head = F.substring(bare, 1, width - 1)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(bare == "", "New chat").when(F.length(bare) <= width, bare).otherwise(F.concat(cut, F.lit("…")))


def is_follow_up(col: str | Column, short: int = 4) -> Column:
    """A message that leans on what was said before: short, a telling opener or a referring word."""
    text = F.lower(F.trim(_s(col)))
    words = F.regexp_extract_all(text, F.lit(r"([a-z']+)"), F.lit(1))
    opener = F.lit(False)
    for start in FOLLOW_UP_OPENERS:
        opener = opener | text.startswith(start)
    refers = F.arrays_overlap(words, F.array(*[F.lit(w) for w in REFERRING_WORDS.split()]))
    return F.coalesce((F.size(words) > 0) & ((F.size(words) <= short) | opener | refers), F.lit(False))


def carried_query(message: str | Column, previous: str | Column, most: int = 40) -> Column:
    """A follow-up's search text: the last words of the previous query, then the message."""
    words = word_list(previous)
    tail = F.when(F.size(words) > most, F.slice(words, -most, most)).otherwise(words)
    joined = F.concat_ws(" ", F.array_join(tail, " "), _s(message))
    return F.when(is_follow_up(message) & (F.size(words) > 0), joined).otherwise(_s(message))


def context_window(col: str | Column, default: int = UNKNOWN_WINDOW) -> Column:
    """Tokens of a model's window by the first matching prefix of its name."""
    out = None
    for prefix, size in CONTEXT_WINDOWS:
        hit = F.lower(_s(col)).startswith(prefix)
        out = F.when(hit, size) if out is None else out.when(hit, size)
    return out.otherwise(default)


def history_budget(window: Column, fixed: Column, new: Column) -> Column:
    """Tokens left for history beside fixed parts, the answer and a margin of a twentieth, 512 at least."""
    margin = F.greatest(F.lit(512), F.floor(window / 20))
    return F.greatest(F.lit(0), window - fixed - new - margin)


def session_id_valid(col: str | Column) -> Column:
    return F.coalesce(_s(col).rlike(r"^(default|[0-9a-f]{32})$"), F.lit(False))


def safe_file_name(col: str | Column, width: int = 100) -> Column:
    """Characters that file systems reject become underscores; cut to ``width``."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(_s(col)), r'[<>:"/\\|?*\s]+', "_"), r"_+", "_"), 1, width)


def word_overlap(question: str | Column, content: str | Column, stop: tuple[str, ...] = ()) -> Column:
    """Share of the question's longer words that the content has; 0 without such words."""
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_s(c), F.lit(""))), F.lit(r"([a-z]+)"), F.lit(1)))
    asked = F.filter(terms(question), lambda w: F.length(w) > 2)
    if stop:
        asked = F.array_except(asked, F.array(*[F.lit(w) for w in stop]))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(content))) / F.size(asked)).otherwise(0.0)


def has_answer(col: str | Column) -> Column:
    """An answer of five words or more without a phrase that says there is none."""
    low = F.lower(F.coalesce(_s(col), F.lit("")))
    denies = F.lit(False)
    for phrase in NO_ANSWER_PHRASES:
        denies = denies | low.contains(phrase)
    return ~denies & (F.size(word_list(col)) >= 5)


def explicit_provision(col: str | Column) -> tuple[Column, Column]:
    """(kind, number) of the first ``article N``, else the first ``section N`` named in a question."""
    low = F.lower(F.coalesce(_s(col), F.lit("")))
    article = F.regexp_extract(low, r"\barticle\s+(\d{1,3}[a-z]?)\b", 1)
    section = F.regexp_extract(low, r"\bsection\s+(\d{1,3}[a-z]?)\b", 1)
    kind = F.when(article != "", "article").when(section != "", "section")
    return kind, F.when(article != "", article).when(section != "", section)


def statute_kind(col: str | Column) -> Column:
    """What a statute file holds, by its name."""
    low = F.lower(F.coalesce(_s(col), F.lit("")))
    return F.when(low.contains("constitution"), "constitution").when(low.contains("bns") | low.contains("nyaya"), "penal code").when(low.contains("act") | low.contains("code"), "act").otherwise("other")


def provider_of(col: str | Column) -> Column:
    """The service a model name belongs to, by its first matching prefix."""
    low = F.lower(F.coalesce(_s(col), F.lit("")))
    return F.when(low.startswith("gpt-") | low.startswith("o1") | low.startswith("o3"), "openai").when(low.startswith("gemini-"), "google").when(low.startswith("claude-"), "anthropic").otherwise("local")


def routable(col: str | Column, prefix: str, denied: tuple[str, ...] = ("embedding", "image", "audio", "tts", "live", "vision")) -> Column:
    """Names with the prefix that none of the denied words marks as another kind of model."""
    low = F.lower(F.coalesce(_s(col), F.lit("")))
    out = low.startswith(prefix)
    for word in denied:
        out = out & ~low.contains(word)
    return out


def document_link(kind: str | Column, judgment: str | Column, section: str | Column) -> Column:
    """The path of a source document; null where nothing is stored."""
    return F.when((_s(kind) == "statute") & _s(section).isNotNull(), F.concat(F.lit("/documents/section/"), _s(section).cast("string"))).when((_s(kind) == "judgment") & _s(judgment).isNotNull(), F.concat(F.lit("/documents/judgment/"), _s(judgment).cast("string")))


def seeded_key(col: str | Column, seed: int = 42) -> Column:
    """A key whose order is a shuffle, the same on every run."""
    return F.md5(F.concat_ws("-", _s(col).cast("string"), F.lit(str(seed))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where a length is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def trigrams(col: str | Column) -> Column:
    """The distinct three-letter pieces of a text's words, each padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(_s(col)), F.lit(r"([a-z0-9]+)"), F.lit(1))
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of three-letter pieces."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))
