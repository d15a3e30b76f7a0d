"""Problem 4: cut oversized texts at natural boundaries, by ranges.

A text is handled in ranges of ``RANGE`` characters with a halo on either side;
a file is read in byte ranges and never loaded as a whole. Every range reports, for the lines that start in it,
where a paragraph may begin and on what evidence, and a few counts of its
layout. The counts are summed per text; they tell whether its paragraphs are
marked by blank lines, indents, numbers or only by short last lines. With
that the boundaries of all ranges are decided and stitched together by offset,
range lengths being prefix-summed where a file is read by bytes. Pieces are cut
in blocks of offsets that hand on where the next piece begins, and emitted by offset.

Defined results
* null and empty texts, and texts within the limit, are one piece (empty ones none) and have no boundary;
* a text without any boundary is cut at the last sentence end, else at the last blank, else at the limit;
* bytes of a file that are no UTF-8 count as replacement characters; empty files have no piece;
* an id on several rows counts once, with its (code point) greatest text;
* extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.llm import pages
from docketloom.workspace import Workspace, spread

LIMIT = 3_000
OVERLAP = 200
RANGE = 16_384
HALO = 2_048
BLOCK = 1 << 20

HEADING, NUMBERED, INDENT, BLANK, SLACK, TITLE, PAGE_BLANK = 1, 2, 4, 8, 16, 32, 64

RANGES = (
    "item string, range int, base long, pos array<int>, flag array<int>, need array<int>, ends array<int>, gaps array<int>, "
    "width int, long_lines int, lines int, n_blank int, n_indent int, n_numbered int, n_short int, page_open int, page_total int"
)

_abbreviation = re.compile(r"(?:^|[\s(])(?:Rs|Ex|Mr|Mrs|Dr|No|Nos|v|vs|Art|S|J|JJ|A|I|R|C|M|Smt|Shri|Sri|St|cl|para|p|pp|Co|Ltd|Anr|Ors|viz|sub|sec)\.$")
_terminal = re.compile(r"[.?!।:][\"'”’)\]]*$")
_paragraph_number = re.compile(r"^\d{1,3}\.\s+[A-Z(\"“‘]")
GAP_STEP = 256
_sentence_end = re.compile(r"[.?!।][\"'”’)\]]*\s+(?=[A-Z\"“‘(ऀ-ॿ])")


def _heading(text: str, width: int) -> bool:
    """A short line of its own that names what follows."""
    if not text or len(text) > 48 or len(text) > 0.8 * max(width, 40) or pages.is_figure(text):
        return False
    if text[-1] in ".,;-¬­?!)" or not (text[0].isupper() or text[0].isdigit()):
        return False
    return len(text.split()) <= 7 and any(c.isalpha() for c in text)


def scan_range(text: str, start: int, lo: int, hi: int) -> dict:
    """Boundary table of the lines that begin in [lo, hi); ``text`` begins at ``start``.

    ``text`` reaches beyond both ends by a halo; positions are relative to lo.
    """
    lines = text.split("\n")
    offsets = np.cumsum([start] + [len(x) + 1 for x in lines[:-1]])
    kind = pages.furniture(lines)
    first = start == 0
    title = pages.title_lines(lines) if first else 0
    stripped, marked = [], []
    for x in lines:
        m = pages.MARK.match(x)
        stripped.append(x[m.end() :] if m else x)
        marked.append(m.end() if m else 0)
    lengths = [len(x.rstrip()) for x, k, i in zip(stripped, kind, range(len(lines)), strict=True) if x.strip() and not k and i >= title]
    longest = max(lengths, default=0)
    usual = int(np.percentile(lengths, 95)) if lengths else 0
    width = usual if longest <= 160 else longest
    pos, flag, need = [], [], []
    n_blank = n_indent = n_numbered = n_short = page_open = page_total = 0
    last = None  # the previous line of text
    gap = paged = page_gap = False
    last_heading = False
    for i, line in enumerate(stripped):
        bare = line.strip()
        if kind[i]:
            paged, page_gap = True, False
            continue
        if not bare:
            if paged:
                page_gap = True
            else:
                gap = True
            continue
        at = int(offsets[i])
        inside = lo <= at < hi and (i > 0 or first)
        if first and i < title:
            last, gap, paged, page_gap, last_heading = bare, False, False, False, False
            continue
        flags = 0
        open_ = False
        after_title = first and title and i >= title and (last is None or not any(stripped[j].strip() and not kind[j] for j in range(title, i)))
        if after_title:
            flags = TITLE
        elif last is not None and not pages.is_figure(bare):
            ended = bool(_terminal.search(last)) and not _abbreviation.search(last) or pages.is_figure(last)
            open_ = not ended and not last_heading
            lower = bare[0].islower() or bare[0] in ",;)"
            if ended and not lower and not last_heading:
                indent = len(line) - len(line.lstrip(" \t"))
                if _heading(bare, usual) and (len(last) + 1 + len(bare.split()[0]) <= width or gap or page_gap or longest > 160 or pages.is_figure(last) or paged):
                    flags |= HEADING
                if _paragraph_number.match(bare):
                    flags |= NUMBERED
                    n_numbered += inside
                if 2 <= indent <= 12:
                    flags |= INDENT
                    n_indent += inside
                if gap:
                    flags |= BLANK
                    n_blank += inside and not paged
                if page_gap:
                    flags |= PAGE_BLANK
                flags |= SLACK
                if flags == SLACK and (longest > 160 or len(last) + 1 + len(bare.split()[0]) <= width - 6):
                    n_short += inside
        if paged and last is not None and inside:
            # whether pages bring a blank line of their own shows where a sentence runs on across them
            page_total += open_
            page_open += open_ and page_gap
        if flags and inside:
            pos.append(at - lo)
            flag.append(flags)
            need.append(len(last or "") + 1 + len(bare.split()[0]))
        last_heading = bool(flags & HEADING) or (last is None and first and _heading(bare, usual)) or (bool(flags & TITLE) and _heading(bare, usual))
        last, gap, paged, page_gap = bare, False, False, False
    ends = [m.end() + start - lo for m in _sentence_end.finditer(text) if lo <= m.end() + start < hi]
    # the last blank of every stretch, for texts that have neither paragraphs nor sentences
    gaps = [k + 1 + start - lo for k in (max(text.rfind(" ", a, a + GAP_STEP), text.rfind("\n", a, a + GAP_STEP)) for a in range(lo - start, hi - start, GAP_STEP)) if k >= 0 and k + 1 + start < hi]
    return {
        "pos": pos, "flag": flag, "need": need, "ends": ends, "gaps": gaps, "width": width, "long_lines": int(longest > 160), "lines": len(lengths),
        "n_blank": int(n_blank), "n_indent": int(n_indent), "n_numbered": int(n_numbered), "n_short": int(n_short), "page_open": int(page_open), "page_total": int(page_total),
    }


NAMES = ("pos", "flag", "need", "ends", "gaps", "width", "long_lines", "lines", "n_blank", "n_indent", "n_numbered", "n_short", "page_open", "page_total")
LISTED = NAMES[:5]


def _tables(rows: list[tuple[str, int, int, dict]]) -> pa.RecordBatch:
    """Boundary tables as one batch; rows are (item, range, base, table)."""
    columns = [pa.array([r[3][k] for r in rows], pa.list_(pa.int32()) if k in LISTED else pa.int32()) for k in NAMES]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), *columns], names=["item", "range", "base", *NAMES])


def scan_items(items: DataFrame, text_col: str, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """The boundary tables of texts held in rows: every range is a slice with its halo, so a text is walked once."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                for k, lo in enumerate(range(0, len(text), size)):
                    start, hi = max(0, lo - halo), min(lo + size, len(text))
                    rows.append((item, k, lo, scan_range(text[start : hi + halo], start, lo, hi)))
                    if len(rows) >= 2_000:
                        yield _tables(rows)
                        rows = []
            yield _tables(rows)

    return items.select("item", text_col).mapInArrow(run, RANGES)


def scan(ranges: DataFrame) -> DataFrame:
    """The boundary tables of ranges read by themselves (item, range, start, lo, hi, part)."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("item", "range", "start", "lo", "hi", "part"))
            yield _tables([(i, k, lo, scan_range(p, s, lo, hi)) for i, k, s, lo, hi, p in zip(*columns, strict=True)])

    return ranges.mapInArrow(run, RANGES)


def decide(scanned: DataFrame) -> DataFrame:
    """(item, start_char): the paragraph starts, by the layout of the whole text."""
    layout = scanned.groupBy("item").agg(
        F.max("width").alias("width"), F.max("long_lines").alias("long"), F.sum("n_blank").alias("blanks"), F.sum("n_indent").alias("indents"),
        F.sum("n_numbered").alias("numbers"), F.sum("n_short").alias("shorts"), F.sum("page_open").alias("page_open"), F.sum("page_total").alias("page_total"),
    )
    spot = scanned.select("item", "base", F.explode(F.arrays_zip("pos", "flag", "need")).alias("s")).select("item", (F.col("base") + F.col("s.pos")).alias("start_char"), F.col("s.flag").alias("flag"), F.col("s.need").alias("need"))
    has = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    by_indent = F.col("indents") >= 2
    by_number = ~by_indent & (F.col("numbers") >= 2) & (F.col("numbers") * 2 >= F.col("blanks"))
    # short last lines without any mark: blank lines then part sections only
    plain = ~by_indent & ~by_number & ((F.col("blanks") == 0) | (F.col("shorts") >= 2) & (F.col("shorts") * 2 >= F.col("blanks")))
    by_blank = ~by_indent & ~by_number & (F.col("blanks") > 0)
    own_blank = F.col("page_open") * 2 >= F.greatest(F.col("page_total"), F.lit(1))  # pages come with a blank line
    slack = has(SLACK) & ((F.col("long") == 1) | (F.col("need") <= F.col("width") - 1))
    start = (
        has(TITLE) | has(HEADING)
        | (by_indent & has(INDENT))
        | (by_number & has(NUMBERED))
        | (by_blank & has(BLANK))
        | (by_blank & ~plain & has(PAGE_BLANK) & (~own_blank | slack))
        | (plain & slack)
    )
    return spot.join(layout, "item").where(start & (F.col("start_char") > 0)).select("item", "start_char")


def _items(df: DataFrame, kind: str, id_col: str, text_col: str, section: str | None) -> DataFrame:
    part = F.col(section).cast("string") if section else F.lit(None).cast("string")
    return df.select(F.concat_ws(":", F.lit(kind), F.col(id_col).cast("long")).alias("item"), F.col(text_col).cast("string").alias("text"), part.alias("section"), F.col(id_col).alias("_id")).where("_id is not null and text is not null and text <> ''").drop("_id")


def _items_of(sources: list[tuple]) -> DataFrame:
    """The items of all sources, every id with one text: its rows may repeat, but are equal then.

    Only ids delivered with different texts or sections are regrouped, by their greatest one.
    """
    parts = [_items(*s) for s in sources]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    seen = rows.select("item", F.xxhash64("text", "section").alias("h")).groupBy("item").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    torn = seen.where("a <> b").select("item")
    if not torn.limit(1).count():
        return rows
    once = rows.join(torn, "item", "left_semi").groupBy("item").agg(F.max(F.struct("text", "section")).alias("r")).select("item", "r.text", "r.section")
    return rows.join(torn, "item", "left_anti").select("item", "text", "section").unionByName(once)


def paragraph_starts(spark: SparkSession, sources: list[tuple], limit: int = LIMIT) -> DataFrame:
    """(item_kind, item_id, start_char) of texts longer than ``limit``.

    ``sources``: (table, kind, id column, text column, section column or None).
    """
    work = Workspace(spark, "splitting")
    rows = _items_of(sources).where(F.length("text") > limit)
    scanned = work.save(scan_items(rows, "text").drop("ends", "gaps"), "scanned").dropDuplicates(["item", "range"])
    return _named(decide(scanned), F.col("start_char").cast("long").alias("start_char"))


def _named(rows: DataFrame, *columns) -> DataFrame:
    kind, number = F.substring_index("item", ":", 1), F.substring_index("item", ":", -1).cast("long")
    return rows.select(kind.alias("item_kind"), number.alias("item_id"), *columns)


# ---------------------------------------------------------------- cuts
class Points:
    """Where a text may be cut, best kind first: paragraphs, sentences, blanks."""

    def __init__(self, paragraphs: np.ndarray, sentences: np.ndarray, blanks: np.ndarray, limit: int, overlap: int):
        self.kinds = ((paragraphs, "paragraph"), (sentences, "sentence"), (blanks, "blank"))
        self.limit, self.overlap = limit, overlap

    def end(self, start: int) -> tuple[int, str]:
        """Where the piece that begins at ``start`` ends, and why there; the text goes on beyond it."""
        top, least = start + self.limit, start + max(self.overlap + 1, self.limit // 4)
        for points, name in self.kinds:
            at = np.searchsorted(points, top, "right") - 1
            if at >= 0 and points[at] >= least:
                return int(points[at]), name
        return top, "limit"

    def walk(self, start: int, stop: int, length: int) -> tuple[list[tuple[int, int, str]], int]:
        """Pieces that begin in [start, stop), and where the next one begins (``length`` after the last)."""
        out = []
        while start < stop:
            if length - start <= self.limit:
                out.append((start, length, "end"))
                return out, length
            end, why = self.end(start)
            out.append((start, end, why))
            start = end - self.overlap
        return out, start


def cut_points(length: int, paragraphs: np.ndarray, sentences: np.ndarray, blanks: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces [start, end) of at most ``limit`` characters, consecutive ones sharing ``overlap``."""
    return Points(paragraphs, sentences, blanks, limit, overlap).walk(0, length, length)[0]


def _cuts(spark: SparkSession, work: Workspace, scanned: DataFrame, lengths: DataFrame, limit: int, overlap: int, block: int) -> DataFrame:
    """(item, piece, start_char, end_char, cut) of texts longer than the limit, from offsets alone.

    A text is cut in blocks of ``block`` characters. The first piece of a block
    begins within ``limit`` of the block's start, so a block is summed up by a
    table from that place to the place where the first piece of the next block
    begins. The tables of a text are then chained in order, which carries the
    state along, and all blocks are cut at once.
    """
    if not 0 <= overlap < limit // 4 or limit > block:
        raise ValueError("the overlap must be less than a quarter of the limit, the limit no more than a block")
    placed = lambda c, p: scanned.select("item", "base", F.explode(c).alias("at")).select("item", (F.col("base") + F.col("at")).alias("at"), F.lit(p).alias("p"))
    points = decide(scanned).select("item", F.col("start_char").alias("at"), F.lit(0).alias("p")).unionByName(placed("ends", 1)).unionByName(placed("gaps", 2))
    points = points.where("at >= 0")
    # a piece that begins in a block may end beyond it
    own = F.expr(f"cast(at div {block} as int)")
    blocks = F.explode(F.array_distinct(F.array(own, F.expr(f"cast(greatest(0, at - {limit}) div {block} as int)")))).alias("block")
    sizes = lengths.select("item", "length", F.explode(F.expr(f"sequence(0, cast((length - 1) div {block} as int))")).alias("block"))
    keyed = points.select("item", "at", "p", blocks).groupBy("item", "block").agg(F.collect_list(F.struct("p", "at")).alias("points"))  # at most block + limit places
    keyed = work.save(sizes.join(keyed, ["item", "block"], "left"), "points")

    def held(row) -> Points:
        found = row or []
        return Points(*(np.unique(np.array([x["at"] for x in found if x["p"] == k], np.int64)) for k in range(3)), limit, overlap)

    def chained(batches):
        for batch in batches:
            out = []
            for number, length, row in zip(batch.column("block").to_pylist(), batch.column("length").to_pylist(), batch.column("points").to_pylist(), strict=True):
                points, lo = held(row), number * block
                stop = min(length, lo + block)
                leads: dict[int, int] = {}
                for first in range(min(lo + limit, stop) - 1, lo - 1, -1):
                    way, at = [], first
                    while at < stop and at not in leads:
                        way.append(at)
                        at = length if length - at <= limit else points.end(at)[0] - overlap
                    to = leads.get(at, at)
                    for x in way:
                        leads[x] = to
                out.append([leads.get(lo + k, lo + k) - lo for k in range(limit)])
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("block"), pa.array(out, pa.list_(pa.int64()))], names=["item", "block", "leads"])

    def carried(batches):
        item, at = None, 0
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            entries = []
            for name, number, leads in zip(batch.column("item").to_pylist(), batch.column("block").to_pylist(), batch.column("leads"), strict=True):
                if name != item:
                    item, at = name, 0
                entries.append(at)
                within = at - number * block
                if 0 <= within < limit:
                    at = number * block + leads[within].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("block"), pa.array(entries, pa.int64())], names=["item", "block", "entry"])

    long = keyed.where(F.col("length") > block)
    tables = long.mapInArrow(chained, "item string, block int, leads array<long>")
    entries = work.save(tables.repartition(spread(spark), "item").sortWithinPartitions("item", "block").mapInArrow(carried, "item string, block int, entry long"), "entries")

    def cut(batches):
        for batch in batches:
            out = []
            for item, number, length, row, entry in zip(*(batch.column(c).to_pylist() for c in ("item", "block", "length", "points", "entry")), strict=True):
                found, _ = held(row).walk(entry or 0, min(length, (number + 1) * block), length)
                out += [(item, number, k, *x) for k, x in enumerate(found)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["item", "block", "k", "start_char", "end_char", "cut"])

    cuts = keyed.join(entries, ["item", "block"], "left").select("item", "block", "length", "points", "entry").mapInArrow(cut, "item string, block int, k int, start_char long, end_char long, cut string")
    cuts = work.save(cuts, "cuts")
    held_by = cuts.groupBy("item", "block").agg(F.count("*").alias("n"))
    before = held_by.withColumn("before", F.sum("n").over(Window.partitionBy("item").orderBy("block")) - F.col("n")).drop("n")
    return cuts.join(before, ["item", "block"]).select("item", (F.col("before") + F.col("k")).cast("int").alias("piece"), "start_char", "end_char", "cut")


PIECE = "item string, piece int, start_char long, end_char long, cut string, section string, content string"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["item", "piece", "start_char", "end_char", "cut", "section", "content"])


def pieces(spark: SparkSession, sources: list[tuple], limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """(item_kind, item_id, piece, start_char, end_char, cut, section, content) of every text."""
    work = Workspace(spark, "pieces")
    rows = _items_of(sources)
    long = rows.where(F.length("text") > limit)
    scanned = work.save(scan_items(long, "text"), "scanned").dropDuplicates(["item", "range"])
    lengths = long.groupBy("item").agg(F.max(F.length("text")).cast("long").alias("length"))
    cuts = _cuts(spark, work, scanned, lengths, limit, overlap, block)
    # the cuts go to the text, which is sliced once and never copied for every piece
    listed = cuts.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("piece", "start_char", "end_char", "cut"))).alias("cuts"))

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for item, text, section, cuts in zip(*(batch.column(c).to_pylist() for c in ("item", "text", "section", "cuts")), strict=True):
                for c in cuts or [{"piece": 0, "start_char": 0, "end_char": len(text), "cut": "end"}]:
                    out.append((item, c["piece"], c["start_char"], c["end_char"], c["cut"], section, text[c["start_char"] : c["end_char"]]))
                    size += c["end_char"] - c["start_char"]
                    if size > 16_000_000:
                        yield _piece_batch(out)
                        out, size = [], 0
            yield _piece_batch(out)

    done = rows.dropDuplicates(["item"]).join(listed, "item", "left").select("item", "text", "section", "cuts").mapInArrow(run, PIECE)
    return _named(done, "piece", "start_char", "end_char", "cut", "section", "content")


# ---------------------------------------------------------------- files
FILE_RANGE = "item string, range int, byte_lo long, byte_hi long, before long, own long, part string"


def _read(item: str, lo: int, hi: int) -> bytes:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", item))
    with system.open_input_file(inner) as source:
        return source.read_at(hi - lo, lo)


def _whole(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a UTF-8 character begins."""
    return next((i for i in range(at, min(at + 4, len(data))) if data[i] & 0xC0 != 0x80), min(at + 4, len(data)) if at < len(data) else len(data))


def file_ranges(spark: SparkSession, paths: str | list[str], size: int = RANGE * 16, halo: int = HALO * 4) -> DataFrame:
    """Ranges of UTF-8 files, read by byte offset: (item, range, byte_lo, start, lo, hi, part).

    Only names and lengths of the files are listed. Every task opens its file, reads
    the bytes of its range and a halo, and aligns them to whole characters; the characters
    of the ranges are counted in parallel and prefix-summed to turn byte ranges
    into character offsets. ``paths``: files, folders or patterns; empty files have no range.
    """
    listed = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("item"), "length").where("length > 0")
    plan = listed.select("item", "length", F.explode(F.expr(f"sequence(0, cast((length - 1) div {size} as int))")).alias("range")).repartition(spread(spark), "item", "range")

    def run(batches):
        for batch in batches:
            rows = []
            for item, length, k in zip(*(batch.column(c).to_pylist() for c in ("item", "length", "range")), strict=True):
                lo, hi = k * size, min((k + 1) * size, length)
                first = max(0, lo - halo)
                data = _read(item, first, min(length, hi + halo))
                a, b = _whole(data, 0) if first else 0, _whole(data, lo - first) if lo else 0
                c = _whole(data, hi - first) if hi < length else len(data)
                before, own = data[a:b].decode("utf-8", "replace"), data[b:c].decode("utf-8", "replace")
                rows.append((item, k, first + b, first + c, len(before), len(own), before + own + data[c:].decode("utf-8", "ignore")))
                if len(rows) >= 64:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["item", "range", "byte_lo", "byte_hi", "before", "own", "part"])

    parts = plan.mapInArrow(run, FILE_RANGE)
    sums = Window.partitionBy("item").orderBy("range")
    base = parts.select("item", "range", "own").withColumn("lo", F.sum("own").over(sums) - F.col("own")).drop("own")
    return parts.join(base, ["item", "range"]).select("item", "range", "byte_lo", "byte_hi", (F.col("lo") - F.col("before")).alias("start"), "lo", (F.col("lo") + F.col("own")).alias("hi"), "part")


def file_pieces(spark: SparkSession, paths: str | list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE * 16, halo: int = HALO * 4, block: int = BLOCK) -> DataFrame:
    """(item, piece, start_char, end_char, cut, content) of UTF-8 files, none of them ever held as a whole.

    Ranges report their boundaries, the cuts are found by offset, and every piece
    is read again from the bytes of the range it begins in and those right behind it.
    """
    work = Workspace(spark, "file-pieces")
    ranges = file_ranges(spark, paths, size, halo)
    table = work.save(ranges.select("item", "range", "byte_lo", "byte_hi", "lo", "hi"), "ranges")
    scanned = work.save(scan(ranges), "scanned")
    lengths = table.groupBy("item").agg(F.max("hi").alias("length")).where("length > 0")
    cuts = _cuts(spark, work, scanned, lengths, limit, overlap, block)
    # the range a piece begins in is found over a grid of places, as a range covers few squares of it
    grid = max(1, size // 4)
    square = table.where("hi > lo").select("item", "range", "byte_lo", "byte_hi", "lo", "hi", F.explode(F.expr(f"sequence(lo div {grid}, (hi - 1) div {grid})")).alias("square"))
    met = cuts.withColumn("square", F.expr(f"start_char div {grid}")).join(square, ["item", "square"]).where("start_char >= lo and start_char < hi")
    grouped = met.groupBy("item", "range", "byte_lo", "byte_hi", "lo").agg(F.array_sort(F.collect_list(F.struct("piece", "start_char", "end_char", "cut"))).alias("cuts"))

    def run(batches):
        for batch in batches:
            for item, lo_byte, hi_byte, lo, cuts in zip(*(batch.column(c).to_pylist() for c in ("item", "byte_lo", "byte_hi", "lo", "cuts")), strict=True):
                text = _read(item, lo_byte, hi_byte).decode("utf-8", "replace")
                # a piece reaches beyond its range by at most the limit, in characters of up to four bytes
                text += _read(item, hi_byte, hi_byte + 4 * limit + 4).decode("utf-8", "replace") if cuts[-1]["end_char"] - lo > len(text) else ""
                yield _piece_batch([(item, c["piece"], c["start_char"], c["end_char"], c["cut"], None, text[c["start_char"] - lo : c["end_char"] - lo]) for c in cuts])

    return grouped.repartition(spread(spark), "item", "range").mapInArrow(run, PIECE).drop("section")
