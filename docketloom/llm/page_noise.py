"""Problem 5: repair text from scanned pages by decoding it as one stream.

The printed lines of a text are de-lined into one stream of characters: page
furniture and marginal letters are taken out, and what parts two tokens is a
blank, a line end or a line end with a hyphen. The stream is segmented into
words by the cheapest path through a lattice whose edges are words of the
corpus as they stand, words read through one or two confusions of a scanner,
tokens cut into several words, neighbouring tokens merged to one word, and
pieces joined over a hyphen. An edge costs the word's negative log frequency
and the price of the error it assumes.

Where two lexicon words stand side by side and do not merge, the cheapest path
keeps both, so the lattice falls apart there: only the stretches between are
decoded, each distinct stretch once, so the work follows the vocabulary and
not the length of the corpus. Paragraphs of the repaired text are chosen by
dynamic programming over the lines.

The lexicon holds every word of ``LEAST_COUNT`` or more. The ``LEXICON`` most frequent are
broadcast; where there are more, all lie sorted in a file that every executor fetches and
its workers map, so a reading, a cut, a merge or a join may lead to any of them and what a
process holds stays bounded. How often the other tokens of a stretch occur is told by a join.

Defined results
* null and empty texts have no cases and stay as they are;
* nothing is reported as misread in the title block, in furniture or in words with more digits than letters;
* words cut or merged inside a line are mended in the text, and are no case of their own;
* an id on several rows is handled row by row, equal cases once;
* control characters are characters like any other; extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import mmap
import os
import re
import shutil
import struct
import tempfile
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.llm import pages
from docketloom.workspace import Workspace, spread

LEXICON = 200_000
LEAST_COUNT = 3
RATIO = 25
PIECE, LINE, HYPHEN = " ", "\n", "\t"  # what parts two tokens of a stretch; no token holds a blank of any kind
CASES = "id long, line_no long, noise string, stretch string, need array<string>, lines array<long>, places array<int>"

# What a scanner prints, and what stood there.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("c", "e"), ("e", "c"), ("!", "i"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"),
    ("0", "o"), ("6", "b"), ("9", "g"), ("5", "s"), ("8", "b"), ("3", "e"), ("u", "n"), ("n", "u"), ("f", "t"), ("t", "f"), ("o", "a"), ("a", "o"),
    ("b", "h"), ("h", "b"), ("h", "li"), ("li", "h"), ("n", "ri"), ("ri", "n"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("in", "m"), ("m", "in"),
    ("nn", "m"), ("|", "l"), ("|", "i"), ("$", "s"), ("@", "a"), ("tl", "d"), ("ni", "m"), ("o", "e"), ("e", "o"), ("s", "a"), ("y", "v"), ("v", "y"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
)

_hyphen_end = re.compile(r"(?<=\w)[-\xad¬]\s*$")
_outer = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "!|$@") + "‘’“”–—…।"
_shape = re.compile(r"^[a-z]{1,3}\d+[a-z]?$|^\d+[a-z]{1,2}$|^[\d,./:()-]+$")
_wordlike = re.compile(r"[a-z]")


def normal(token: str) -> str:
    """Lower case, without surrounding punctuation; a mark that may stand for a letter stays inside."""
    word = token.strip(_outer).lower().rstrip("!|$@").lstrip("|$@")
    return word.replace("\xad", "").replace("¬", "")


def _countable(word: str) -> bool:
    return bool(_wordlike.search(word)) and not _shape.match(word)


# ---------------------------------------------------------------- lexicon
def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts; pieces of words broken at line ends aren't counted."""

    def run(batches):
        for batch in batches:
            raw: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                broken = False
                for line in text.split("\n"):
                    parts = line.split()
                    if not parts:
                        continue
                    if broken:
                        parts = parts[1:]
                    broken = bool(_hyphen_end.search(line))
                    if broken:
                        raw.update(parts[:-1])
                    else:
                        raw.update(parts)
            clean: Counter[str] = Counter()
            for token, n in raw.items():
                hanging = token.endswith("-")
                word = normal(token)
                if _countable(word):
                    clean[word + "-" if hanging else word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(clean), pa.string()), pa.array(list(clean.values()), pa.int64())], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- edges of the lattice
_by_wrong: dict[str, list[str]] = {}
for _wrong, _right in CONFUSIONS:
    _by_wrong.setdefault(_wrong, []).append(_right)

MERGE = log(RATIO)
CUT = 2 * log(RATIO)
JOINED = 0.0
LONGEST_TWICE = 64  # letters of a word that may be misread in two places; longer ones in one


def readings(word: str) -> Iterator[str]:
    """The words that one confusion turns into ``word``."""
    for i in range(len(word)):
        for width in (1, 2):
            for right in _by_wrong.get(word[i : i + width], ()) if i + width <= len(word) else ():
                yield word[:i] + right + word[i + width :]


class Lexicon(dict):
    """Word to its count; knows the tokens of the corpus and the lengths of its words."""

    def __init__(self, counts: dict[str, int], total: int):
        super().__init__(counts)
        self.total = max(total, 1)
        self.lengths = {len(w) for w in counts}

    def reachable(self, length: int, edits: int) -> bool:
        """Whether any word is as long as a reading of a token of this length can be."""
        return any(length + d in self.lengths for d in range(-edits, edits + 1))

    def price(self, count: int) -> float:
        return log((self.total + 1) / max(count, 1))

    def counted(self, least: int) -> Callable[[str, int], int]:
        """``get`` for those who heed counts of ``least`` and more only."""
        return self.get


class WordFile:
    """Words and counts in a file, sorted by their bytes; it is mapped, not loaded, and bits by hash answer for most words that aren't there."""

    HEAD = struct.Struct("<qqq")  # words, bits of the hash, bytes of all words

    def __init__(self, name: str):
        self.name, self._at = name, None

    def __getstate__(self):
        return {"name": self.name, "_at": None}

    @classmethod
    def write(cls, path: str, rows: Iterable[tuple[str, int]], number: int) -> None:
        """``rows``: (word, count) in the order of their bytes, ``number`` of them; one row is held at a time."""
        width = max(10, (16 * number).bit_length())
        bits = np.zeros(1 << (width - 3), np.uint8)
        with open(path, "wb") as out, open(path + ".n", "w+b") as counts, open(path + ".w", "w+b") as words:
            out.write(cls.HEAD.pack(number, width, 0))
            end = 0
            out.write(struct.pack("<q", 0))
            for word, n in rows:
                raw = word.encode("utf-8", "surrogatepass")
                h = crc32(raw) & ((1 << width) - 1)
                bits[h >> 3] |= 1 << (h & 7)
                words.write(raw)
                end += len(raw)
                out.write(struct.pack("<q", end))
                counts.write(struct.pack("<q", n))
            for part in (counts, words):
                if part is words:
                    out.write(bits.tobytes())
                part.seek(0)
                shutil.copyfileobj(part, out)
            out.seek(0)
            out.write(cls.HEAD.pack(number, width, end))
        os.remove(path + ".n")
        os.remove(path + ".w")

    def _open(self):
        path = self.name if os.path.isabs(self.name) else SparkFiles.get(self.name)
        with open(path, "rb") as f:
            mapped = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        number, width, size = self.HEAD.unpack(mapped[: self.HEAD.size])
        a = self.HEAD.size
        b = a + 8 * (number + 1)
        c = b + 8 * number
        d = c + (1 << (width - 3))
        self._at = number, (1 << width) - 1, mapped[a:b].cast("q"), mapped[b:c].cast("q"), mapped[c:d], mapped[d : d + size]
        return self._at

    def get(self, word: str) -> int:
        """The word's count, 0 if it isn't there."""
        number, mask, ends, counts, bits, words = self._at or self._open()
        raw = word.encode("utf-8", "surrogatepass")
        h = crc32(raw) & mask
        if not bits[h >> 3] >> (h & 7) & 1:
            return 0
        lo, hi = 0, number
        while lo < hi:
            middle = (lo + hi) // 2
            if words[ends[middle] : ends[middle + 1]].tobytes() < raw:
                lo = middle + 1
            else:
                hi = middle
        return counts[lo] if lo < number and words[ends[lo] : ends[lo + 1]] == raw else 0


class WholeLexicon(Lexicon):
    """A lexicon whose less frequent words lie in a file; none of them is more frequent than the words held."""

    def __init__(self, counts: dict[str, int], total: int, file: WordFile, lengths: set[int], floor: int):
        super().__init__(counts, total)
        self.file, self.lengths, self.floor = file, lengths, floor

    def get(self, word: str, default: int = 0) -> int:
        return super().get(word) or self.file.get(word) or default

    def __contains__(self, word: str) -> bool:
        return super().__contains__(word) or self.file.get(word) > 0

    def counted(self, least: int) -> Callable[[str, int], int]:
        return super().get if least > self.floor else self.get


def strange(word: str) -> bool:
    return any(c.isdigit() or c in "!|$@ﬁﬂﬀ" for c in word)


def read(word: str, own: int, lexicon: Lexicon) -> tuple[float, str] | None:
    """The cheapest word that confusions turn into ``word``: (cost, word).

    A misreading is much rarer than what it stands for, so one confusion costs
    the log of ``RATIO``, a second one four times that ratio; where the token has a
    character that no word has, the first costs nothing.
    """
    if not lexicon.reachable(len(word), 1):
        return None
    least = max(LEAST_COUNT, own * (1 if strange(word) else RATIO))
    get = lexicon.counted(least)
    best = max(((get(w, 0), w) for w in readings(word)), default=(0, ""))
    if best[0] >= least:
        return lexicon.price(best[0]) + log(least / max(own, 1)), best[1]
    if 5 <= len(word) <= LONGEST_TWICE and lexicon.reachable(len(word), 2):
        get = lexicon.counted(4 * least)
        second = max(((get(w, 0), w) for r in readings(word) for w in readings(r) if w != word), default=(0, ""))
        if second[0] >= 4 * least:
            return lexicon.price(second[0]) + log(4 * least / max(own, 1)), second[1]
    return None


def cut(word: str, lexicon: Lexicon) -> tuple[float, str] | None:
    """The cheapest way to read a token as several frequent words run together: (cost, words)."""
    n, longest = len(word), min(24, max(lexicon.lengths, default=0))
    if n < 5:
        return None
    get = lexicon.counted(50 * RATIO)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * n
    for i in range(n):
        if best[i][0] == float("inf"):
            continue
        for j in range(i + 2, min(n, i + longest) + 1):
            count = get(word[i:j], 0)
            if count >= 50 * RATIO and not (i == 0 and j == n):
                cost = best[i][0] + lexicon.price(count) + (CUT if i else 0.0)
                if cost < best[j][0]:
                    best[j] = (cost, i)
    if best[n][0] == float("inf"):
        return None
    parts, at = [], n
    while at:
        parts.append(word[best[at][1] : at])
        at = best[at][1]
    return best[n][0], " ".join(reversed(parts))


def join(left: str, right: str, lexicon: Lexicon, known: dict[str, int]) -> str | None:
    """The whole word of two pieces over a hyphen at a line end, None if they are two words."""
    count = lambda w: lexicon.get(w, 0) or known.get(w, 0)
    closed, open_ = left + right, left + "-" + right
    a, b = count(closed), count(open_)
    if max(a, b) >= LEAST_COUNT:
        return closed if a >= b else open_
    found = [r for r in (read(closed, 0, lexicon), read(open_, 0, lexicon)) if r]
    if found:
        return min(found)[1]
    # a hyphen that hangs before "and" or "or" is no break of a word
    if count(left + "-") or right in ("and", "or", "to"):
        return None
    # compounds of two plain words keep the hyphen, unless one piece is no word by itself
    if count(left) >= 100 and count(right) >= 100 and min(len(left), len(right)) >= 3:
        return open_
    return closed if _wordlike.search(closed) else None


_parts = re.compile(r"([ \n\t])")


def needed(stretch: str, lexicon: Lexicon) -> list[str]:
    """The forms of a stretch whose counts decide its path and aren't in the lexicon."""
    tokens, seps = (p := _parts.split(stretch))[::2], p[1::2]
    out = {t for t in tokens if t not in lexicon}
    for i, sep in enumerate(seps):
        whole = [tokens[i] + tokens[i + 1]]
        if sep == HYPHEN:
            whole += [tokens[i] + "-" + tokens[i + 1], tokens[i] + "-"]
        elif i + 2 < len(tokens):
            whole.append(tokens[i] + tokens[i + 1] + tokens[i + 2])
        out |= {w for w in whole if w not in lexicon}
    return sorted(out)


def decode(stretch: str, lexicon: Lexicon, known: dict[str, int]) -> list[tuple[int, int, str]]:
    """The cheapest path through a stretch: (first token, last token, word or words) of every edge that changes it.

    ``known``: counts of its forms beyond the lexicon.
    """
    tokens, seps = (p := _parts.split(stretch))[::2], p[1::2]
    n = len(tokens)
    count = lambda w: lexicon.get(w, 0) or known.get(w, 0)
    best: list[tuple[float, int, str | None]] = [(0.0, 0, None)] + [(float("inf"), 0, None)] * n

    def edge(i: int, j: int, cost: float, word: str | None) -> None:
        if best[i][0] + cost < best[j][0]:
            best[j] = (best[i][0] + cost, i, word)

    for i, token in enumerate(tokens):
        joined = join(token, tokens[i + 1], lexicon, known) if i < len(seps) and seps[i] == HYPHEN else None
        if joined:
            edge(i, i + 2, JOINED, joined)
        own = count(token)
        edge(i, i + 1, lexicon.price(own), None)
        if not (joined or i and seps[i - 1] == HYPHEN):
            options = [read(token, own, lexicon), cut(token, lexicon) if own <= 2 and not strange(token) else None]
            for option in options:
                if option:
                    edge(i, i + 1, *option)
        for width in (2, 3):
            if i + width <= n and HYPHEN not in seps[i : i + width - 1]:
                whole = "".join(tokens[i : i + width])
                if count(whole) >= LEAST_COUNT:
                    edge(i, i + width, lexicon.price(count(whole)) + MERGE * (width - 1), whole)
    out, j = [], n
    while j:
        _, i, word = best[j]
        if word is not None and word != tokens[i]:
            out.append((i, j - 1, word))
        j = i
    return out[::-1]


# ---------------------------------------------------------------- vocabulary
def _lexicon(spark: SparkSession, words: DataFrame, total: int) -> Lexicon:
    """All ``words`` (word, n): at most LEXICON + 1 rows come to the driver; where there are more, the whole table passes it row by row to a file."""
    rows = words.orderBy(F.desc("n"), "word").limit(LEXICON + 1).toArrow()
    top = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))
    if len(top) <= LEXICON:
        return Lexicon(top, total)
    _, floor = top.popitem()
    folder = tempfile.mkdtemp(prefix="docketloom-words-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it as long as the application runs
    path = os.path.join(folder, f"words-{uuid.uuid4().hex}")
    WordFile.write(path, words.select("word", "n").orderBy("word").toLocalIterator(), words.count())
    spark.sparkContext.addFile(path)
    lengths = {r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect()}  # one value per length of a word
    return WholeLexicon(top, total, WordFile(os.path.basename(path)), lengths, floor)


def _misread(counts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(word, n): the words of the corpus that are cheaper to take as a misreading of another."""

    def run(batches):
        for batch in batches:
            words, own = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            yield batch.filter(pa.array([(r := read(w, n, lexicon)) is not None and r[0] <= lexicon.price(n) for w, n in zip(words, own, strict=True)], pa.bool_()))

    return counts.select("word", "n").mapInArrow(run, "word string, n long")


# ---------------------------------------------------------------- stream
def body_lines(lines: list[str]) -> Iterator[tuple[int, str, bool]]:
    """(index, text, after a gap) of the lines of the stream: no furniture, title, blank lines or margin marks."""
    kind, title = pages.furniture(lines), pages.title_lines(lines)
    gap = False
    for i, line in enumerate(lines):
        if kind[i] or i < title:
            continue
        if not line or line.isspace():
            gap = True
            continue
        m = pages.MARK.match(line) if line[0].isalpha() and line[1:3] == "  " else None
        yield i, line[m.end() :] if m else line, gap
        gap = False


def stretches(lines: list[str], odd: dict[str, str]) -> Iterator[tuple[str, list[int], list[int]]]:
    """(stretch, line numbers, places in the line) of everything in the stream that the lexicon doesn't settle.

    ``odd`` maps a raw token to its bare form, or to '' if it is a known word.
    """
    tokens: list[str] = []
    first, numbers, breaks = [], [], {}
    before = ""
    for i, line, gap in body_lines(lines):
        parts = line.split()
        if tokens:
            hyphen = _hyphen_end.search(before) and _wordlike.search(normal(tokens[-1]))
            breaks[len(tokens)] = HYPHEN if hyphen else "" if gap else LINE
        first.append(len(tokens))
        numbers.append(i + 1)
        tokens += parts
        before = line
    known = odd.known
    spans = [odd[t] for t in tokens]
    interesting = sorted({i for i, s in enumerate(spans) if s} | {i - 1 for i, s in breaks.items() if s == HYPHEN})
    done, n = -1, len(tokens)

    def close(i: int) -> str:
        """What parts token i from the next one, '' where nothing can be merged over it."""
        if i + 1 >= n or not (tokens[i][-1].isalnum() and tokens[i + 1][0].isalnum()):
            return HYPHEN if breaks.get(i + 1) == HYPHEN else ""
        return breaks.get(i + 1, PIECE)

    for i in interesting:
        if i <= done:
            continue
        sep = close(i)
        if sep == HYPHEN:
            group = [i, i + 1]
        elif i == n - 1 and breaks.get(n) == HYPHEN or not spans[i]:
            continue
        else:
            group = [i]
            if i - 1 > done and close(i - 1) not in ("", HYPHEN) and normal(tokens[i - 1]) + spans[i] in known:
                group = [i - 1, i]
            if sep and close(i + 1) != HYPHEN:
                pair = normal(tokens[i]) + normal(tokens[i + 1])
                if pair in known:
                    group.append(i + 1)
                elif close(i + 1) and close(i + 2) != HYPHEN and pair + normal(tokens[i + 2]) in known:
                    group += [i + 1, i + 2]
        done = group[-1]
        text = normal(tokens[group[0]])
        for a, b in zip(group, group[1:], strict=False):
            text += close(a) + normal(tokens[b])
        at = [bisect_right(first, g) - 1 for g in group]
        yield text, [numbers[k] for k in at], [g - first[k] for g, k in zip(group, at, strict=True)]


class _Odd(dict):
    """Raw token to its bare form; '' for words of the lexicon."""

    def __init__(self, known: Lexicon):
        super().__init__()
        self.known = known

    def __missing__(self, token: str) -> str:
        if len(self) > 1_000_000:
            self.clear()
        word = normal(token)
        value = self[token] = "" if word in self.known or len(word) < 2 or not _countable(word) else word
        return value


def _traces(rows: DataFrame, lexicon: Lexicon, marks: bool) -> DataFrame:
    def run(batches):
        odd = _Odd(lexicon)
        need: dict[str, list[str]] = {}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "line_no", "noise", "stretch", "need", "lines", "places")}

            def add(*row) -> None:
                for k, v in zip(out, row, strict=True):  # noqa: B023
                    out[k].append(v)  # noqa: B023

            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = text.split("\n")
                if marks:
                    kind, title = pages.furniture(lines), pages.title_lines(lines)
                    for i, line in enumerate(lines):
                        if kind[i]:
                            add(key, i + 1, "running_line", None, None, None, None)
                        elif i >= title and line[1:3] == "  " and line[0].isalpha() and pages.MARK.match(line):
                            add(key, i + 1, "margin_mark", None, None, None, None)
                for stretch, numbers, places in stretches(lines, odd):
                    if stretch not in need:
                        if len(need) > 500_000:
                            need.clear()
                        need[stretch] = needed(stretch, lexicon)
                    add(key, None, None, stretch, need[stretch], numbers, places)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.mapInArrow(run, CASES)


def _decoded(spark: SparkSession, rows: DataFrame, work: Workspace, marks: bool) -> tuple[DataFrame, DataFrame]:
    """The traces found in all texts, and of every distinct stretch the edges that change it: (stretch, fixes)."""
    counts = work.save(word_counts(rows), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = counts.where(F.col("n") >= LEAST_COUNT)
    whole = _lexicon(spark, words, total)
    # words of the lexicon that are themselves misreadings of far more frequent ones
    misread = _misread(words.where(~F.col("word").endswith("-")).repartition(spread(spark), "word"), whole).select("word")
    if isinstance(whole, WholeLexicon):
        sound = _lexicon(spark, work.save(words.join(misread, "word", "left_anti"), "sound"), total)
    else:
        bad = set(misread.toArrow().column("word").to_pylist())  # at most LEXICON rows
        sound = Lexicon({w: n for w, n in whole.items() if w not in bad}, total)
    found = work.save(_traces(rows, sound, marks), "found")
    stretch = found.where("stretch is not null").groupBy("stretch").agg(F.first("need").alias("need"))
    asked = stretch.select("stretch", F.explode("need").alias("word"))
    told = asked.join(counts, "word").groupBy("stretch").agg(F.collect_list(F.struct("word", "n")).alias("info"))

    def run(batches):
        for batch in batches:
            names, fixes = [], []
            for text, info in zip(batch.column("stretch").to_pylist(), batch.column("info").to_pylist(), strict=True):
                path = decode(text, sound, {x["word"]: x["n"] for x in info or []})
                if path:
                    names.append(text)
                    fixes.append([{"first": a, "last": b, "word": w} for a, b, w in path])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(fixes, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("word", pa.string())])))], names=["stretch", "fixes"])

    paths = stretch.select("stretch").join(told, "stretch", "left").mapInArrow(run, "stretch string, fixes array<struct<first:int,last:int,word:string>>")
    return found, work.save(paths, "paths")


def traces(spark: SparkSession, df: DataFrame, id_col: str = "id", text_col: str = "judgment_text") -> DataFrame:
    """Every trace of print and page with its repair: (id, line_no, noise, repaired)."""
    work = Workspace(spark, "page-noise")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null and text <> ''")
    found, paths = _decoded(spark, rows, work, True)
    plain = found.where("noise is not null").select("id", "line_no", "noise", F.lit("").alias("repaired"))
    fixed = found.where("stretch is not null").join(paths, "stretch").select("id", "lines", F.explode("fixes").alias("f"))
    begin, end = F.get("lines", F.col("f.first")), F.get("lines", F.col("f.last"))
    noise = F.when(F.col("f.first") == F.col("f.last"), F.when(~F.col("f.word").contains(" "), "misread")).when(begin != end, "split_word")
    cases = fixed.select("id", begin.alias("line_no"), noise.alias("noise"), F.col("f.word").alias("repaired")).where("noise is not null")
    return plain.unionByName(cases).distinct()


# ---------------------------------------------------------------- repaired texts
def paragraph_breaks(lines: list[str], gaps: list[bool], indents: list[int]) -> list[bool]:
    """Whether a paragraph begins at each line, by the cheapest sequence of breaks.

    Breaks cost less after a finished short line, a blank line or before an
    indent; paragraphs of a single unfinished line cost extra, and every line beyond
    ``USUAL_LINES`` a little. Paragraphs may be as long as they like: as the price of length is
    linear there, the best start so far is kept and not searched again.
    """
    n = len(lines)
    if not n:
        return []
    width = int(np.percentile([len(x) for x in lines], 90))
    cost = np.zeros(n)
    for i in range(1, n):
        before, now = lines[i - 1].rstrip(), lines[i]
        ended = before.endswith((".", "?", "!", ":", "।"))
        begins = now[:1].isupper() or now[:1].isdigit() or now[:1] in "(\"“‘"
        room = len(before) + 1 + len(now.split()[0] if now.split() else "") <= width - 2
        evidence = 2.0 * gaps[i] + 2.0 * (indents[i] >= 2 and indents[i - 1] < 2) + 1.5 * (room and ended) + 2.0 * (len(before) < 48 and not ended and before[:1].isupper() and begins and room)
        cost[i] = 1.7 - evidence + 3.0 * (not begins) + 1.5 * (not ended and not (len(before) < 48))
    # upto[i]: cheapest layout of the first i lines; opening[j]: that of the first j lines with a paragraph opened at line j
    upto, opening, back = [0.0] * (n + 1), [0.0] * n, [0] * (n + 1)
    far, far_at = float("inf"), 0
    for i in range(1, n + 1):
        opening[i - 1] = upto[i - 1] + float(cost[i - 1])
        j = i - USUAL_LINES - 1
        if j >= 0 and opening[j] - LINE_PRICE * j < far:
            far, far_at = opening[j] - LINE_PRICE * j, j
        best, at = opening[i - 1] + LONE, i - 1
        for j in range(i - 2, max(0, i - USUAL_LINES) - 1, -1):
            if opening[j] < best:
                best, at = opening[j], j
        if far + LINE_PRICE * (i - USUAL_LINES) < best:
            best, at = far + LINE_PRICE * (i - USUAL_LINES), far_at
        upto[i], back[i] = best, at
    out = [False] * n
    i = n
    while i:
        out[back[i]] = True
        i = back[i]
    return out


USUAL_LINES, LINE_PRICE, LONE = 40, 0.02, 0.4


def _shaped(token: str, span: str, word: str) -> tuple[str, str]:
    """A token with its core replaced, in the capitals it had, and the marks after the core."""
    at = token.lower().find(span)
    if at < 0:
        core = token.strip(_outer)
        at, span = max(token.find(core), 0), core
    shape = word.upper() if len(span) > 1 and token.isupper() else word[:1].upper() + word[1:] if token[at : at + 1].isupper() else word
    return token[:at] + shape, token[at + len(span) :]


def repaired(text: str, fixes: dict[tuple[int, int], tuple[int, int, str]]) -> str:
    """A text without furniture and marks, broken and misread words mended, one line a paragraph.

    ``fixes``: (line number, place) of the first token to those of the last one and the words that stand there.
    """
    lines = text.split("\n")
    kind, title = pages.furniture(lines), pages.title_lines(lines)
    out = [" ".join(line.split()) for i, line in enumerate(lines[:title]) if not kind[i] and line.strip()]
    body, gaps, indents = [], [], []
    until: tuple[int, int] | None = None
    for i, line, gap in body_lines(lines):
        mended: list[str] = []
        for place, token in enumerate(line.split()):
            if until:
                # the rest of a word that began before: only the marks behind it stay
                if (i + 1, place) == until:
                    marks = token[len(token.rstrip(_outer)) :]
                    if mended:
                        mended[-1] += marks
                    else:
                        body[-1] += marks
                    until = None
                continue
            fix = fixes.get((i + 1, place))
            if fix:
                until = fix[:2] if fix[:2] != (i + 1, place) else None
                front, marks = _shaped(token, normal(token).rstrip("-"), fix[2])
                token = front + ("" if until else marks)
            mended.append(token)
        if mended:
            body.append(" ".join(mended))
            gaps.append(gap)
            indents.append(len(line) - len(line.lstrip()))
    for line, new in zip(body, paragraph_breaks(body, gaps, indents), strict=True):
        if new or not out:
            out.append(line)
        else:
            out[-1] += " " + line
    return "\n".join(out)


def repair_texts(spark: SparkSession, df: DataFrame, id_col: str = "id", text_col: str = "judgment_text") -> DataFrame:
    """(id, repaired_text) for every row: continuous paragraphs, one on a line."""
    work = Workspace(spark, "repair")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found, paths = _decoded(spark, rows.where("id is not null and text is not null and text <> ''"), work, False)
    at = lambda c, side: F.get(c, F.col(f"f.{side}"))
    fixed = found.join(paths, "stretch").select("id", "lines", "places", F.explode("fixes").alias("f"))
    fixed = fixed.select("id", F.struct(at("lines", "first").alias("line"), at("places", "first").alias("place"), at("lines", "last").alias("to_line"), at("places", "last").alias("to_place"), F.col("f.word").alias("word")).alias("fix")).groupBy("id").agg(F.collect_set("fix").alias("fixes"))

    def run(batches):
        for batch in batches:
            out = []
            for text, fixes in zip(batch.column("text").to_pylist(), batch.column("fixes").to_pylist(), strict=True):
                out.append(repaired(text, {(f["line"], f["place"]): (f["to_line"], f["to_place"], f["word"]) for f in fixes or []}) if text else text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "repaired_text"])

    return rows.join(fixed, "id", "left").select("id", "text", "fixes").mapInArrow(run, "id long, repaired_text string")
