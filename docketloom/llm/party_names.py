"""Problem 2: link the spellings of one party, by metric-space partitioning.

A name is read into a record: a person (given name, initials, surname), a firm
(house, trade, form) or an office (kind of office, place). Records whose heads
(surname, house, place) lie within an edit radius are found by the exact metric
join of :mod:`metric_join`; they name the same party if the rest agrees. Names
that leave something out (initials for given names, nicknames, missing middle
initials, shortened places) join the one party they fit, if it is the only one
or by far the most frequent. Parties are the connected components.

Defined results
* null, empty, blank, ``Unknown`` and label-only values are no names;
* case, blanks, punctuation, titles, words for further parties, legal representatives and connected appeals don't count;
* a name that fits several parties about equally well joins none of them;
* names that are neither of these, in other scripts or of one or two letters, are compared by all their letters; they are one party if equal, or from six letters on by the same rule for misspellings;
* without a table of nicknames every given name stands for itself; extra columns are ignored;
* equal strings are one name however often they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.llm.metric_join import distance, radius_join
from docketloom.operators.components import connected_components
from docketloom.workspace import Workspace, spread

RADIUS = 2
DOMINANT = 0.75
NICKNAME_LIMIT = 20_000
WORD_LIMIT = 20_000  # words of trades that are told apart, the most frequent ones

# Words around a name that don't belong to it, and the spellings of forms and offices.
_after = re.compile(
    r"[\s,.;:]*(?:\(\s*(?:and\s+connected\s+appeals?|dead|since\s+deceased|deceased)\s*\)|(?:by|through|thr\.?)\s+(?:his\s+|her\s+|the\s+)?l\.?\s*rs?|\(?\bl\.?rs\)?"
    r"|(?:&|\band)\s*(?:anr|another|ors|others|an other)|(?<![a-z])(?:anr|ors|etc))[\s.,)]*$",
    re.IGNORECASE,
)
_before = re.compile(
    r"^\s*(?:the\s+managing\s+director,?\s*(?:of\s+)?|(?:m/s|messrs|mr|mrs|ms|miss|smt|shrimati|shri|sri|thiru|dr|prof|kum|sh|late)(?:\.\s*|\s+)|the\s+)",
    re.IGNORECASE,
)
_forms = {
    "sons": "sons", "son": "sons", "son's": "sons", "sons'": "sons", "brothers": "brothers", "bros": "brothers", "brother": "brothers",
    "limited": "limited", "ltd": "limited", "private": "private", "pvt": "private", "company": "company", "co": "company", "corporation": "company",
}
_joiners = {"and", "&", "n", "of", "the"}
_initials = re.compile(r"^m\.c\.\s+[a-z]{4,}$", re.IGNORECASE)
_label = re.compile(r"^[A-Za-z ]{3,20}:\s*$")


class Snapper:
    """Words to the nearest word of a small vocabulary, by shared deletions."""

    def __init__(self, vocabulary: dict[str, int]):
        self.words = vocabulary
        self.deleted: dict[str, set[str]] = {}
        for w in vocabulary:
            for k in self._deletions(w, 2 if len(w) >= 7 else 1):
                self.deleted.setdefault(k, set()).add(w)
        self.memory: dict[str, tuple[str, ...]] = {}

    @staticmethod
    def _deletions(word: str, depth: int) -> set[str]:
        out = {word}
        for _ in range(depth):
            out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
        return out

    def near(self, word: str) -> tuple[str, ...]:
        """The nearest words: the word itself, else those at the least distance up to 1, or 2 for long words."""
        if word in self.words:
            return (word,)
        if word not in self.memory:
            if len(self.memory) > 200_000:
                self.memory.clear()
            depth = 2 if len(word) >= 7 else 1 if len(word) >= 4 else 0
            found = sorted({w for k in self._deletions(word, depth) for w in self.deleted.get(k, ())}) if depth else []
            best: tuple[str, ...] = ()
            if found:
                d = [distance(word, w) for w in found]
                if min(d) <= depth:
                    best = tuple(w for w, x in zip(found, d, strict=True) if x == min(d))
            self.memory[word] = best
        return self.memory[word]


def smooth(word: str) -> str:
    """A head in the form that is compared: lower-case letters, vowels written long as the short ones."""
    word = re.sub(r"[^a-z]", "", word.lower())
    return word.replace("ee", "i").replace("oo", "u")


@lru_cache(maxsize=200_000)
def _bare(name: str) -> str:
    text = re.sub(r"\s+", " ", name).strip()
    last = None
    while text != last:
        last = text
        text = _after.sub("", text).strip()
        text = _before.sub("", text).strip()
    return text.strip(" .,;")


def is_name(name: str | None) -> bool:
    return bool(name and name.strip() and name.strip().lower() != "unknown" and not _label.match(name.strip()) and re.search(r"[^\W\d_]", name))


_form_words = Snapper({k: 1 for k in _forms if k.isalpha()})
_office_words = Snapper({k: 1 for k in ("state", "union", "commissioner", "commr", "income", "municipal", "corporation", "corpn", "corp")})


def _office(text: str) -> tuple[str, str, bool] | None:
    """(office, place, shortened) of a name of an office."""
    low = text.lower()
    m = re.match(r"^u\.?\s?o\.?\s?([a-z])\.?$", low)
    if m:
        return "union", m[1], True
    m = re.match(r"^u\.?\s?o\.?\s+([a-z]{4,})$", low)
    if m:
        return "union", m[1], False
    m = re.match(r"^c\.?\s?i\.?\s?t\.?,?\s+([a-z]{3,})$", low)
    if m:
        return "tax", m[1], False
    m = re.match(r"^m\.c\.\s+([a-z]{4,})$", low)
    if m:
        return "m.c.", m[1], False
    raw = re.findall(r"[a-z.'-]+", low)
    words = [w.strip(".-'") for w in raw]
    known = [_office_words.near(w)[:1] or ("",) for w in words]
    known = [k[0] if len(w) >= 4 or w == k[0] else "" for k, w in zip(known, words, strict=True)]
    rest = lambda drop: [(w, r) for w, k, r in zip(words, known, raw, strict=True) if k not in drop and w not in _joiners and w not in ("i", "t", "i.t", "tax", "income-tax", "st", "mun")]
    if ("income" in known or "income-tax" in words or "i.t" in words) and ("commissioner" in known or "commr" in known):
        left = rest({"income", "commissioner", "commr"})
        return ("tax", "".join(w for w, _ in left), False) if left else None
    if ("municipal" in known or words[:1] == ["mun"]) and ("corporation" in known or "corpn" in known or "corp" in known):
        left = rest({"municipal", "corporation", "corpn", "corp"})
        return ("municipal", "".join(w for w, _ in left), False) if left else None
    for office in ("state", "union"):
        has = office in known or office == "state" and words[:2] == ["st", "of"]
        if has and ("of" in words or words[-1:] and known[-1] == office) and len(words) <= 4:
            left = rest({office})
            if len(left) == 1:
                return office, left[0][0], len(left[0][0]) <= 4
    return None


def _other(name: str) -> dict:
    """The record of a name of no known form: all its letters and digits, in lower case."""
    bare = unicodedata.normalize("NFC", _bare(name) or name).casefold()
    head = "".join(c for c in bare if c.isalnum() or unicodedata.category(c).startswith("M"))
    return {"kind": "word", "head": head, "rest": "", "givens": [], "initial": "", "middle": "", "level": 2}


def parse(name: str, given: Snapper, nick: dict[str, tuple[str, ...]], trades: Snapper | None = None, council: bool = True) -> dict | None:
    """The record of a name, None for what is no name.

    ``council``: whether M.C. stands for a municipal corporation, else for initials.
    """
    if not is_name(name):
        return None
    return _known(name, given, nick, trades, council) or _other(name)


def _known(name: str, given: Snapper, nick: dict[str, tuple[str, ...]], trades: Snapper | None, council: bool) -> dict | None:
    """The record of a person, firm or office.

    kind, head and: rest (what must agree), givens (full given names that fit), initial, middle, level
    (2 complete, 1 partly, 0 initials only).
    """
    text = _bare(name)
    text = re.sub(r"(?<=[A-Za-z])-\s*(?=[A-Za-z])", lambda m: "-" if "ncome" in text.lower() else "", text)
    if not text:
        return None
    office = _office(text)
    if office and office[0] == "m.c.":
        office = ("municipal", office[1], False) if council else None
    if office:
        head = smooth(office[1])
        return {"kind": "office:" + office[0], "head": head, "rest": "", "givens": [], "initial": "", "middle": "", "level": 0 if office[2] else 2} if head else None
    inner = " ".join(re.findall(r"\(([^)]*)\)", text))
    outer = re.sub(r"\([^)]*\)", " ", text)
    words = [w.strip(".'-").replace("'", "") for w in re.findall(r"[A-Za-z'&/-]+\.?", outer)]
    low = [w.lower() for w in words if w]
    form: set[str] = set()
    left: list[str] = []
    for w in low:
        hit = _forms.get(w) or (_forms.get((_form_words.near(w) or ("",))[0]) if len(w) >= 4 else None)
        if hit:
            form.add(hit)
        elif w not in _joiners:
            left.append(w)
    if re.search(r"\(\s*p\.?\s*\)|\bp\.?\s*(?:ltd|limited)\b", text, re.IGNORECASE):
        form.add("private")
        left = [w for w in left if w != "p"]
        inner = re.sub(r"\bp\b\.?", "", inner, flags=re.IGNORECASE)
    if form - {"company"} or "company" in form and len(left) >= 1 and "limited" in form:
        kind = "private" if "private" in form else "company" if "company" in form else "sons" if "sons" in form else "brothers" if "brothers" in form else "limited"
        extra = [w.lower() for w in re.findall(r"[A-Za-z]+", inner)]
        if not left:
            return None
        body = left + extra
        house = body[0]
        trade = [w for w in body[1:] if len(w) > 1]
        if len(trade) > 1 and trades is not None and trades.near(trade[-1]) and not trades.near(trade[0]):
            house, trade = house + "".join(trade[:-1]), trade[-1:]  # a house name broken by a blank
        what = " ".join(trade)
        if trades is not None and what:
            single = what[:-1] if what.endswith("s") and what[:-1] in trades.words else what
            near = trades.near(single) or tuple(t for t in trades.words if len(single) >= 3 and t.startswith(single))
            what = near[0] if len(near) == 1 else single
        head = smooth(house)
        return {"kind": "firm", "head": head, "rest": kind + "|" + what, "givens": [], "initial": "", "middle": "", "level": 2} if head else None
    return _person(text, given, nick)


def _person(text: str, given: Snapper, nick: dict[str, tuple[str, ...]]) -> dict | None:
    comma = text.split(",", 1) if "," in text else None
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z](?:[\s.]|$))|(?<=[a-z]{3})(?=[A-Z][a-z]{3})", " ", text)
    tokens = re.findall(r"[A-Za-z]+", spaced)
    if not tokens:
        return None
    longs = [t.lower() for t in tokens if len(t) >= 3]
    if comma:
        front = [t.lower() for t in re.findall(r"[A-Za-z]+", comma[0]) if len(t) >= 3]
        if len(front) == 1 and longs and longs[0] == front[0]:
            longs = longs[1:] + longs[:1]  # surname last
    short = [(i, t.lower()) for i, t in enumerate(tokens) if len(t) < 3]
    if not longs:
        return None
    fits = lambda w: bool(nick.get(w)) or bool(given.near(w)) or w[:-1] in given.words and len(w) > 5
    if len(longs) == 1 and not short:
        whole = longs[0]
        cut = next((k for k in range(len(whole) - 5, 3, -1) if whole[:k] in given.words), 0)
        if cut:  # given name and surname run together
            longs, tokens = [whole[:cut], whole[cut:]], [whole[:cut], whole[cut:]]
    if len(longs) > 2:
        longs = [longs[0], "".join(longs[1:])] if fits(longs[0]) else ["".join(longs[:-1]), longs[-1]]
    initials = "".join(t for _, t in short)
    if len(longs) == 1:
        head = smooth(longs[0])
        first, middle = initials[:1], initials[1:]
        return {"kind": "person", "head": head, "rest": "", "givens": [], "initial": first, "middle": middle, "level": 0} if head else None
    one, two = longs
    order = [t.lower() for t in tokens if len(t) >= 3]
    if not comma:
        trailing = bool(short) and short[-1][0] == len(tokens) - 1 and not any(0 < i < len(tokens) - 1 for i, _ in short)
        a, b = fits(one), fits(two)
        if b and not a or a == b and trailing and order[0] == one:
            one, two = two, one
    middle = initials
    givens = list(nick.get(one, ()))
    level = 1
    if one in given.words:
        givens, level = [one], 2
    elif not givens:
        near = given.near(one)
        if not near and one[:-1] in given.words:
            near, middle = (one[:-1],), one[-1] + middle
        elif near and len(one) > 5 and one[:-1] in given.words and not middle:
            near, middle = (one[:-1],), one[-1]
        givens, level = list(near) or [one], 2 if len(near) <= 1 else 1
    head = smooth(two)
    return {"kind": "person", "head": head, "rest": "", "givens": sorted(givens), "initial": one[:1], "middle": middle, "level": level} if head else None


# ---------------------------------------------------------------- linking
RECORD = "name string, n long, council boolean, kind string, head string, rest string, givens array<string>, initial string, middle string, level int"


def _records(names: DataFrame, given_words: dict[str, int], nick: dict[str, tuple[str, ...]], trade_words: dict[str, int] | None) -> DataFrame:
    """The records of names (name, n); ``council`` is null but for the two readings of M.C., of which one holds."""

    def run(batches):
        given = Snapper(given_words)
        trades = Snapper(trade_words) if trade_words else None
        fields = ("kind", "head", "rest", "givens", "initial", "middle", "level")
        for batch in batches:
            rows = []
            for name, n in zip(batch.column("name").to_pylist(), batch.column("n").to_pylist(), strict=True):
                record = parse(name, given, nick, trades)
                if record and record["kind"] == "office:municipal" and _initials.match(_bare(name)):
                    rows += [(name, n, True, record), (name, n, False, parse(name, given, nick, trades, council=False))]
                elif record:
                    rows.append((name, n, None, record))
            types = {"givens": pa.list_(pa.string()), "level": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), *(pa.array([r[3][f] for r in rows], types.get(f, pa.string())) for f in fields)], names=["name", "n", "council", *fields])

    return names.repartition(spread(names.sparkSession), "name").mapInArrow(run, RECORD)


def _nicknames(table: DataFrame | None) -> tuple[dict[str, int], dict[str, tuple[str, ...]]]:
    if table is None:
        return {}, {}
    rows = table.where("nick is not null and given_name is not null").select(F.lower("nick").alias("nick"), F.lower("given_name").alias("given")).distinct().limit(NICKNAME_LIMIT + 1).collect()
    if len(rows) > NICKNAME_LIMIT:
        raise ValueError(f"more than {NICKNAME_LIMIT} nicknames")
    nick: dict[str, set[str]] = {}
    for r in rows:
        nick.setdefault(r["nick"], set()).add(r["given"])
        if "oo" in r["nick"]:
            nick.setdefault(r["nick"].replace("oo", "u"), set()).add(r["given"])
    return {r["given"]: 1 for r in rows}, {k: tuple(sorted(v)) for k, v in nick.items()}


def parties(spark: SparkSession, df: DataFrame, columns: tuple[str, ...] = ("petitioner", "respondent"), nicknames: DataFrame | None = None, radius: int = RADIUS) -> DataFrame:
    """(name, party): every distinct name with the number of its party."""
    work = Workspace(spark, "parties")
    given, nick = _nicknames(nicknames)
    names = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    names = work.save(names, "names")
    first = work.save(_records(names, given, nick, None), "first")
    # a bounded vocabulary of the data itself: trades of firms
    trades = first.where("kind = 'firm'").select(F.split("rest", "\\|")[1].alias("t"), "n").where("length(t) > 2 and not t like '% %'").groupBy("t").agg(F.sum("n").alias("n"), F.count("*").alias("k")).orderBy(F.desc("k"), "t").limit(WORD_LIMIT).collect()
    most = max((t["k"] for t in trades), default=0)
    words = {t["t"]: t["k"] for t in trades if t["k"] >= max(3, 0.1 * most)}
    words = {t: k for t, k in words.items() if not (t.endswith("s") and t[:-1] in words)}
    named = work.save(_records(names, given, nick, words), "both")
    # M.C. is a municipal corporation where the place has one by its full name
    towns = named.where("kind = 'office:municipal' and council is null").select("head").distinct()
    councils = named.where("council").join(towns, "head", "left_semi").select(*named.columns)
    others = named.where("not council").join(councils.select("name"), "name", "left_anti").select(*named.columns)
    named = work.save(named.where("council is null").unionByName(councils).unionByName(others).drop("council"), "named")
    record = ["kind", "head", "rest", "givens", "initial", "middle", "level"]
    records = work.save(named.groupBy(*record).agg(F.sum("n").alias("n"), F.min("name").alias("any")).withColumn("rid", F.xxhash64(*record)), "records")
    near = work.save(radius_join(spark, records.select("kind", "head").distinct(), radius), "near")
    both = near.select("kind", "a", "b", "distance").unionByName(near.select("kind", F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    heads = both.unionByName(records.select("kind", F.col("head").alias("a"), F.col("head").alias("b"), F.lit(0).alias("distance")).distinct())
    heads = work.save(heads, "heads")

    # whole records of the same rest: one party if the heads are near
    whole_key = ["kind", "rest", "givens", "middle"]
    x = records.where("level = 2").select(*whole_key, F.col("head").alias("a"), F.col("rid").alias("x"), F.col("n").alias("nx"))
    y = records.where("level = 2").select(*whole_key, F.col("head").alias("b"), F.col("rid").alias("y"), F.col("n").alias("ny"))
    wide = heads.where("distance = 0 or (kind <> 'word' or least(length(a), length(b)) >= 6) and (distance <= 1 or least(length(a), length(b)) >= if(kind like 'office%', 5, 8))")
    met = x.join(wide, ["kind", "a"]).join(y, [*whole_key, "b"])
    # two edits are a misspelling only beside a much more frequent spelling
    sure = (F.col("distance") <= 1) | (F.least("nx", "ny") <= 3) | (F.least("nx", "ny") * 4 <= F.greatest("nx", "ny"))
    edges = work.save(met.where((F.col("x") < F.col("y")) & sure).select("x", "y"), "edges-whole")
    root = connected_components(spark, edges, "x", "y").select(F.col("id").alias("rid"), "component")
    whole = work.save(records.where("level = 2").join(root, "rid", "left").withColumn("party", F.coalesce("component", "rid")).drop("component"), "whole")

    # records that leave something out join the party they fit
    group = whole.groupBy("kind", F.col("head").alias("b"), "rest", "givens", "middle", "party").agg(F.sum("n").alias("weight"))
    partial = records.where("level < 2 or (kind = 'person' and middle = '')").select("kind", F.col("head").alias("a"), F.col("givens").alias("g"), F.col("initial").alias("i"), F.col("middle").alias("m"), "level", "rid")
    tried = partial.join(heads.where("distance <= 1"), ["kind", "a"]).join(group, ["kind", "b"])
    office = F.col("kind").startswith("office")
    person = (F.col("kind") == "person") & (F.size("givens") == 1)
    named_fit = F.when(F.col("level") == 0, (F.col("i") == "") | F.element_at("givens", 1).startswith(F.col("i"))).otherwise(F.arrays_overlap("g", "givens"))
    middle_fit = (F.col("m") == F.col("middle")) | (F.col("m") == "")
    fit = tried.where(person & named_fit & middle_fit & ~((F.col("level") == 2) & (F.col("middle") == "")))
    short = records.where(F.col("kind").startswith("office") & (F.col("level") == 0)).select("kind", F.col("head").alias("a"), "rid")
    # shortened places have four letters at most
    begins = group.where(office).withColumn("a", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.substring("b", F.lit(1), k)))))
    places = begins.join(short, ["kind", "a"])
    options = fit.select("rid", "party", "weight").unionByName(places.select("rid", "party", "weight")).groupBy("rid", "party").agg(F.sum("weight").alias("weight"))
    best = options.groupBy("rid").agg(F.max_by("party", F.struct("weight", "party")).alias("to"), F.max("weight").alias("top"), F.sum("weight").alias("all"))
    joined = work.save(best.where(F.col("top") >= DOMINANT * F.col("all")).select(F.col("rid").alias("x"), F.col("to").alias("y")), "edges-partial")

    # what is left: equal initials of near surnames
    alone = records.where("kind = 'person' and level < 2 and initial <> ''").join(joined.select(F.col("x").alias("rid")), "rid", "left_anti")
    p = alone.select(F.col("head").alias("a"), F.col("initial").alias("i"), F.col("middle").alias("m"), F.col("rid").alias("x"))
    q = alone.select(F.col("head").alias("b"), F.col("initial").alias("i"), F.col("middle").alias("m"), F.col("rid").alias("y"))
    rest = p.join(heads.where("kind = 'person' and distance <= 1").select("a", "b"), "a").join(q, ["b", "i", "m"]).where("x < y").select("x", "y")
    links = whole.where("rid <> party").select(F.col("rid").alias("x"), F.col("party").alias("y")).unionByName(joined).unionByName(rest)
    final = connected_components(spark, work.save(links, "links"), "x", "y").select(F.col("id").alias("rid"), "component")
    keyed = named.withColumn("rid", F.xxhash64(*record))
    return keyed.join(final, "rid", "left").select("name", F.coalesce("component", "rid").alias("party"))


def spelling_pairs(named: DataFrame) -> DataFrame:
    """Unordered pairs of different names of one party: (name_a, name_b)."""
    a, b = named.select("party", F.col("name").alias("name_a")), named.select("party", F.col("name").alias("name_b"))
    return a.join(b, "party").where("name_a < name_b").select("name_a", "name_b")
