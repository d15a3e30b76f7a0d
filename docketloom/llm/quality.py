"""Problem 8: text quality statistics and the distance from ordinary prose.

Every document gets a vector of statistics. For each language the mean and
covariance of prose are estimated robustly from all documents: the estimate
starts at the documents made mostly of running sentences and is refined by
concentration steps, which keep the documents nearest to the present mean.
The robust Mahalanobis distance of a document, and the share each statistic
has in it, say how far and in what respect a text departs from prose. A
multinomial regression on the labelled sample turns distance, deviations and
statistics into the verdict prose, list, table or junk.

Defined results
* null, empty and blank texts: zero statistics, null distance, verdict ``empty``;
* the language is the one whose common words occur most (ties: the alphabetically first),
  without any hit that of the script most of its letters have, else ``und``;
* a language with fewer than ``MIN_GROUP`` documents is measured against all documents together;
* repeated doc_ids give a row each; null or unknown labels are ignored;
* without labels every text whose distance is beyond the cut of the estimate is ``junk``;
* extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.workspace import Workspace

STATISTICS = (
    "log_chars", "log_words", "mean_word_length", "symbol_share", "digit_share", "upper_share", "end_punctuation_share",
    "common_share", "running_share", "repeated_line_share", "log_line_length", "numbered_line_share", "long_word_share",
    "distinct_word_share", "odd_character_share", "stop_density", "wordy_share", "short_line_share",
)
RUNNING = STATISTICS.index("running_share")
CLASSES = ("prose", "list", "table", "junk")
MIN_GROUP = 30
SPAN = 100
LABEL_LIMIT = 20_000
WORD_LIMIT = 20_000
STEPS = 3
KEEP_SHARE = 0.975
WINDOW = 7
RIDGE = 1e-3
PENALTY = 3e-3
SCHEMA = "doc_id long, language string, running double, s binary"

_numbered = re.compile(r"\s*(?:\(?\d+[.)]|\(?[a-zA-Z][.)]\s|[-*•–])")
_leader = re.compile(r"\.{4,}")
_core = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_edges = ".,;:?!'\"()[]।-–—’‘“”"
_ends = tuple(".?!।:;")
_odd_characters = "�€™œ†‡{}<>=&|\\^~`"

LETTER, UPPER, DIGIT, SPACE, ODD, DEVANAGARI, LATIN = 1, 2, 4, 8, 16, 32, 64
TABLE = 0x3000


def _character_table() -> np.ndarray:
    """Character classes by code point; whatever lies beyond the table is taken as a letter."""
    table = np.zeros(TABLE, np.uint8)
    for i in range(TABLE - 1):
        c = chr(i)
        table[i] = LETTER * c.isalpha() | UPPER * c.isupper() | DIGIT * c.isdigit() | SPACE * c.isspace() | ODD * (0x80 <= i <= 0xFF or c in _odd_characters) | DEVANAGARI * (0x900 <= i <= 0x97F) | LATIN * (c.isascii() and c.isalpha())
    table[TABLE - 1] = LETTER
    return table


_classes = _character_table()
_bits = np.array([[bool(kind & bit) for kind in range(128)] for bit in (LETTER, UPPER, DIGIT, SPACE, ODD, DEVANAGARI, LATIN)], np.int64)


GROUP = 8  # languages that one description has room for


class _Tokens(dict):
    """Blank-separated token to a packed description, remembered for the tokens met last.

    Bits 0-5 letters of the word in it, 6 a word, 7 neither word nor number nor
    mark, 8-15 common in language k, 16-21 characters, 24-55 hash of the word.
    """

    def __init__(self, common: dict[str, frozenset[str]]):
        super().__init__()
        words = list(common.values())
        self.common = words[:GROUP]
        # further languages have descriptions of their own
        self.more = _Tokens(dict(enumerate(words[GROUP:]))) if len(words) > GROUP else None

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        core = token.strip(_edges)
        word = _core.fullmatch(core) is not None or any("ऀ" <= c <= "ॿ" for c in core)
        code = min(63, len(token)) << 16
        if word:
            low = core.lower()
            code |= min(63, len(core)) | 64 | (zlib.crc32(low.encode("utf-8", "replace")) << 24)
            for k, known in enumerate(self.common):
                code |= (low in known) << (8 + k)
        elif core and not all(c.isdigit() or c in ".,/:()%-" for c in core):
            code |= 128
        self[token] = code
        return code


def _blocks(text: str) -> list[str]:
    """Lines, wrapped lines joined: a line goes on where the one before is long and unfinished."""
    out: list[str] = []
    lines = text.split("\n")
    sizes = sorted(len(x) for x in lines if x.strip())
    usual = sizes[3 * len(sizes) // 4] if sizes else 0
    open_ = False
    for line in lines:
        bare = line.strip()
        if not bare:
            open_ = False
            continue
        if open_:
            out[-1] += " " + bare
        else:
            out.append(bare)
        open_ = len(line) >= 0.6 * usual and usual >= 30 and len(line) < 160
    return out


def _distinct_share(names: np.ndarray) -> float:
    """Share of different words, the mean over all windows of SPAN words, so that long texts compare with short ones."""
    n = len(names)
    if not n:
        return 0.0
    span = min(SPAN, n)
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    at = np.arange(n)
    # a word is the first of its kind in the windows that start after its last occurrence
    windows = np.minimum(at, n - span) - np.maximum(before, np.maximum(at - span, -1))
    return float(np.maximum(windows, 0).sum() / ((n - span + 1) * span))


def statistics(text: str, languages: list[str], tokens: _Tokens) -> tuple[str, list[float]]:
    """Language and statistics, in the order of STATISTICS, of one text that isn't blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_classes[np.minimum(points, TABLE - 1)], minlength=128)
    letter, upper, digit, space, odd, deva, latin = (_bits @ kinds).tolist()
    solid = max(1, len(text) - space)
    lines = [x for x in text.split("\n") if x.strip()]
    blocks = _blocks(text)
    split = [x.split() for x in blocks]
    codes = np.fromiter((tokens[t] for part in split for t in part), np.int64, sum(map(len, split)))
    word = (codes & 64) != 0
    letters = np.where(word, codes & 63, 0)
    told, tier = [codes], tokens.more
    while tier is not None:
        told.append(np.fromiter((tier[t] for part in split for t in part), np.int64, len(codes)))
        tier = tier.more
    known = lambda k: (told[k // GROUP] >> (8 + k % GROUP)) & 1
    hits = [int(known(k).sum()) for k in range(len(languages))]
    if hits and max(hits):
        best = min(range(len(hits)), key=lambda k: (-hits[k], languages[k]))
        language = languages[best]
    else:
        language = "und" if not (deva or latin) else "hi" if deva > latin else "en"
        best = languages.index(language) if language in languages else -1
    common = known(best) if best >= 0 else np.zeros(len(codes), np.int64)

    repeated = Counter(x.strip() for x in lines)
    copies = sum(len(x) * (n - 1) for x, n in repeated.items() if n > 1) if len(repeated) < len(lines) else 0
    running = 0
    if copies < 0.5 * len(text):
        size = np.fromiter(map(len, split), np.int64, len(split))
        stop = np.repeat(np.cumsum(size), size)
        at = np.arange(len(codes))
        low, high = np.maximum(at - WINDOW, stop - np.repeat(size, size)), np.minimum(at + WINDOW + 1, stop)
        sums = np.zeros((3, len(codes) + 1), np.int64)
        np.cumsum(np.stack([word, common, (codes & 128) != 0]), axis=1, out=sums[:, 1:])
        near, dense, bad = (sums[k][high] - sums[k][low] for k in range(3))
        enough = np.repeat(np.add.reduceat(word.astype(np.int64), np.cumsum(size) - size) >= 6, size) if len(size) else word
        good = enough & (dense >= 0.2 * np.maximum(near, 1)) & (bad <= 0.2 * (high - low)) & (near >= 0.5 * (high - low))
        running = int(letters[good].sum())
    n = max(1, int(word.sum()))
    wordy = int(letters.sum())
    names = ((codes >> 24) & 0xFFFFFFFF)[word]
    return language, [
        np.log1p(len(text)),
        np.log1p(int(word.sum())),
        min(30.0, wordy / n),
        max(0.0, 1 - (letter + digit) / solid),
        digit / solid,
        upper / max(1, letter),
        sum(x.rstrip().endswith(_ends) for x in lines) / len(lines),
        int(common.sum()) / n,
        running / max(1, wordy, int(0.8 * solid)),
        copies / max(1, len(text)),
        np.log1p(sum(map(len, lines)) / len(lines)),
        sum(bool(_numbered.match(x) or _leader.search(x)) for x in lines) / len(lines),
        int((letters > 18).sum()) / n,
        _distinct_share(names),
        odd / solid,
        min(1.0, (text.count(". ") + text.count("। ") + text.count(".\n") + 1) * 10 / n),
        wordy / solid,
        sum(x.count(" ") < 3 for x in lines) / len(lines),
    ]


def features(documents: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """(doc_id, language, running, s) for every row, s the statistics as float64 bytes; blank texts have the language null."""

    languages = list(common)

    def run(batches):
        tokens = _Tokens(common)
        for batch in batches:
            ids, langs, rows = batch.column("doc_id"), [], []
            for text in batch.column("text").to_pylist():
                if text is None or not text.strip():
                    langs.append(None)
                    rows.append(np.zeros(len(STATISTICS)))
                else:
                    lang, row = statistics(text, languages, tokens)
                    langs.append(lang)
                    rows.append(np.array(row, np.float64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array([float(r[RUNNING]) for r in rows], pa.float64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "language", "running", "s"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


# ---------------------------------------------------------------- robust estimate
def _moments(table: DataFrame, models: dict[str, tuple] | None, cut: dict[str, float] | None) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of squares per language over all documents inside the cut."""
    p = len(STATISTICS)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch)
            lang = np.array(batch.column("language").to_pylist(), object)
            for name in set(lang):
                rows = x[lang == name]
                if models is None:
                    rows = rows[rows[:, RUNNING] >= 0.7]
                else:
                    centre, inverse = models[name if name in models else "*"]
                    away = rows - centre
                    rows = rows[np.einsum("ij,jk,ik->i", away, inverse, away) <= cut[name if name in cut else "*"]]
                part = np.concatenate(([len(rows)], rows.sum(0), (rows.T @ rows).ravel()))
                total[name] = total.get(name, 0) + part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([list(map(float, v)) for v in total.values()], pa.list_(pa.float64()))], names=["language", "m"])

    parts = table.where("language is not null").mapInArrow(run, "language string, m array<double>")
    sums = parts.select("language", F.posexplode("m").alias("i", "v")).groupBy("language", "i").agg(F.sum("v").alias("v")).groupBy("language").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
    out: dict[str, tuple] = {}
    for row in sums.collect():  # one row per language of the common words
        m = np.array([x["v"] for x in row["m"]])
        out[row["language"]] = (m[0], m[1 : p + 1], m[p + 1 :].reshape(p, p))
    if out:
        out["*"] = tuple(sum(v[i] for v in list(out.values())) for i in range(3))
    return out


def _model(moments: dict[str, tuple]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    p = len(STATISTICS)
    models = {}
    for name, (n, s, ss) in moments.items():
        if n >= MIN_GROUP or name == "*":
            centre = s / max(n, 1)
            cov = ss / max(n, 1) - np.outer(centre, centre)
            scale = np.maximum(np.diag(cov), 1e-6)
            models[name] = (centre, np.linalg.inv(cov + np.diag(RIDGE * scale + 1e-6) + 1e-9 * np.eye(p)))
    return models


def _cut(table: DataFrame, models: dict[str, tuple]) -> dict[str, float]:
    """The distance below which KEEP_SHARE of the mostly running documents lie, per language."""

    def run(batches):
        for batch in batches:
            lang = batch.column("language").to_pylist()
            d2, _ = _measure(_matrix(batch), lang, models)
            yield pa.RecordBatch.from_arrays([pa.array([n if n in models else "*" for n in lang], pa.string()), pa.array(d2)], names=["language", "d2"])

    near = table.where("language is not null and running >= 0.7").mapInArrow(run, "language string, d2 double")
    by = near.groupBy("language").agg(F.percentile_approx("d2", KEEP_SHARE, 1000).alias("c")).collect()  # one row per language
    found = {r["language"]: r["c"] for r in by}
    return {"*": found.get("*", max(found.values(), default=1.0))} | found


def _matrix(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("s").to_pylist()), np.float64).reshape(-1, len(STATISTICS))


def _measure(x: np.ndarray, lang: list, models: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of every row from its language's centre, and each statistic's share in it."""
    d2, parts = np.full(len(lang), np.nan), np.zeros(x.shape)
    names = np.array([n if n in models else "*" for n in lang], object)
    for name in set(names):
        rows = np.flatnonzero(names == name)
        centre, inverse = models[name]
        away = x[rows] - centre
        each = away * (away @ inverse)
        d2[rows] = np.maximum(each.sum(1), 0)
        parts[rows] = each / np.maximum(each.sum(1), 1e-12)[:, None]
    return d2, parts


# ---------------------------------------------------------------- verdict
def _inputs(s: np.ndarray, d2: np.ndarray, lang: list[str], models: dict[str, tuple]) -> np.ndarray:
    """Statistics, damped deviations from the language's prose, and the distance."""
    z = np.empty_like(s)
    names = np.array([n if n in models else "*" for n in lang], object)
    for name in set(names):
        centre, inverse = models[name]
        z[names == name] = (s[names == name] - centre) * np.sqrt(np.maximum(np.diag(inverse), 1e-9))
    z = np.sign(z) * np.log1p(np.abs(z))
    lack = np.maximum(0, np.array([0.4, 0.55, 0.7, 0.85]) - s[:, [RUNNING]])
    return np.hstack([s, np.clip(z, -3, 3), np.log1p(d2)[:, None], lack, np.ones((len(s), 1))])


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised inputs, bounded so that no single odd statistic outweighs the others."""
    return np.clip((x - mean) / scale, -4, 4)


def _regress(x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
    """Multinomial regression by accelerated gradient descent with an L2 penalty."""
    coef = np.zeros((x.shape[1], target.shape[1]))
    last, rate = coef.copy(), 2.0 / max(1e-9, np.linalg.norm(x * np.sqrt(weight / weight.sum())[:, None], 2) ** 2)
    for k in range(steps):
        look = coef + (k / (k + 3)) * (coef - last)
        grad = x.T @ ((_chances(x @ look) - target) * weight[:, None]) / weight.sum() + PENALTY * look
        last, coef = coef, look - rate * grad
    return coef


def _chances(score: np.ndarray) -> np.ndarray:
    prob = np.exp(score - score.max(1, keepdims=True))
    return prob / prob.sum(1, keepdims=True)


def fit_verdict(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients); labels that the fit finds very unlikely are taken as wrong and left out."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    mean[-1], scale[-1] = 0, 1
    x = _scaled(x, mean, scale)
    target = np.eye(len(CLASSES))[y]
    coef = _regress(x, target, weight, steps)
    for doubt in (0.1, 0.2):
        likely = _chances(x @ coef)[np.arange(len(y)), y]
        coef = _regress(x, target, weight * (likely >= doubt), steps)
    return mean, scale, coef


def _common(words: DataFrame) -> dict[str, frozenset[str]]:
    rows = words.where("word is not null and lang is not null").select("word", "lang").distinct().limit(WORD_LIMIT + 1).collect()
    if len(rows) > WORD_LIMIT:
        raise ValueError(f"more than {WORD_LIMIT} common words")
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], set()).add(r["word"].lower())
    return {k: frozenset(v) for k, v in out.items()}


def quality(spark: SparkSession, documents: DataFrame, words: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, language, every statistic, distance, contribution (map) and verdict."""
    work = Workspace(spark, "quality")
    p = len(STATISTICS)
    table = work.save(features(documents, _common(words)), "features")
    moments = _moments(table, None, None)
    models = _model(moments) if moments else {"*": (np.zeros(p), np.eye(p))}
    cut: dict[str, float] = {"*": 1.0}
    for _ in range(STEPS if moments else 0):
        cut = _cut(table, models)
        models = _model(_moments(table, models, cut))
    cut = _cut(table, models)
    fitted = None
    if labels is not None:
        known = labels.where(F.col("label").isin(*CLASSES) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
        share = known.count()
        if share > LABEL_LIMIT:
            known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(LABEL_LIMIT / share * 1_000_000))
        rows = table.where("language is not null").join(known.groupBy("doc_id", "label").count(), "doc_id").select("language", "s", "label", "count").toArrow().combine_chunks()
        if rows.num_rows and len(set(rows.column("label").to_pylist())) > 1:
            s, names = _matrix(rows), rows.column("language").to_pylist()
            x = _inputs(s, _measure(s, names, models)[0], names, models)
            y = np.array([CLASSES.index(v) for v in rows.column("label").to_pylist()])
            order = np.lexsort((y, *s.T[:3]))
            fitted = fit_verdict(x[order], y[order], rows.column("count").to_numpy().astype(float)[order])

    def run(batches):
        for batch in batches:
            lang = batch.column("language").to_pylist()
            s = _matrix(batch)
            d2, parts = _measure(s, lang, models)
            if fitted is None:
                kind = np.array(["junk" if d > cut.get(n, cut["*"]) else "prose" for d, n in zip(d2, lang, strict=True)], object)
            else:
                mean, scale, coef = fitted
                kind = np.array(CLASSES, object)[(_scaled(_inputs(s, d2, lang, models), mean, scale) @ coef).argmax(1)] if len(lang) else np.array([], object)
            verdict = pa.array(["empty" if n is None else k for n, k in zip(lang, kind, strict=True)], pa.string())
            blank = np.array([n is None for n in lang], bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("language"), *(pa.array(s[:, i]) for i in range(p)), pa.array(np.sqrt(d2), mask=blank), pa.array(list(parts), pa.list_(pa.float64())), verdict], names=["doc_id", "language", *STATISTICS, "distance", "parts", "verdict"])

    judged = table.mapInArrow(run, "doc_id long, language string, " + ", ".join(f"{n} double" for n in STATISTICS) + ", distance double, parts array<double>, verdict string")
    names = F.array(*[F.lit(n) for n in STATISTICS])
    return judged.select("doc_id", "language", *STATISTICS, "distance", F.map_from_arrays(names, "parts").alias("contribution"), "verdict")


def not_prose(judged: DataFrame) -> DataFrame:
    """Ids of the documents that are for the greater part not running sentences."""
    return judged.where(~F.col("verdict").isin("prose", "empty")).select("doc_id")
