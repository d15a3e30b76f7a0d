"""Radius join of strings under the true Damerau-Levenshtein metric.

Metric-space partitioning: every string belongs to the cell of its nearest
pivot. If two strings lie within radius r, the triangle inequality puts either
of them within ``d(own nearest pivot) + 2 r`` of the other's pivot, so strings
are replicated to just those cells, and the join inside each cell is complete.
Inside a cell the distances to all pivots bound the distance of two strings from
below; the few pairs that pass are measured. A cell of more than ``CELL_CAP`` strings
is compared in blocks of two parts, all parts meeting all others.

Strings of more than ``WIDTH`` characters would make the tables of distances too
large. They are joined by their pieces: cut in 2 r + 1 pieces, two strings
within the radius share one untouched piece, moved by r characters at most; the
pairs that do are measured after equal ends are cut off. Both ways are exact, whatever the script.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.workspace import Workspace, spread

WIDTH = 40
SAMPLE = 4_000
MOST_PIVOTS = 64
LEAST_RAYS = 32
CELL_STRINGS = 2_000
CELL_CAP = 20_000


class Alphabet(dict):
    """Character to a small number, given out as characters are met."""

    def __missing__(self, char: str) -> int:
        value = self[char] = len(self) + 1
        return value


def codes(words: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Characters as the numbers of the alphabet, and lengths."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(size.max(initial=0))), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [alphabet[c] for c in w]
    return out, size


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of row pairs, all rows at once."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    wa, wb = int(la.max(initial=0)), int(lb.max(initial=0))
    most = wa + wb
    d = np.full((wa + 2, wb + 2, n), most, np.int16)
    for i in range(wa + 1):
        d[i + 1, 1] = i
    for j in range(wb + 1):
        d[1, j + 1] = j
    at = np.arange(n)
    row_of = np.zeros((1 + max(int(a.max(initial=0)), int(b.max(initial=0))), n), np.int64)
    for i in range(1, wa + 1):
        last = np.zeros(n, np.int64)
        mine = a[:, i - 1]
        for j in range(1, wb + 1):
            other = b[:, j - 1]
            up = row_of[other, at]
            same = mine == other
            value = np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            swap = (up > 0) & (last > 0)
            if swap.any():
                s = np.flatnonzero(swap)
                value[s] = np.minimum(value[s], d[up[s], last[s], s] + (i - up[s] - 1) + 1 + (j - last[s] - 1))
            d[i + 1, j + 1] = value
            last[same] = j
        row_of[mine, at] = i
    return d[la + 1, lb + 1, at].astype(np.int64)


def distance(a: str, b: str) -> int:
    """The same distance of two strings, for a few pairs."""
    most = len(a) + len(b)
    rows = [[most] * (len(b) + 2), [most, *range(len(b) + 1)]]
    row_of: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        now = [most, i]
        last = 0
        before = rows[i]
        for j, y in enumerate(b, 1):
            same = x == y
            value = min(before[j] + (not same), before[j + 1] + 1, now[j] + 1)
            up = row_of.get(y, 0)
            if up and last:
                value = min(value, rows[up][last] + (i - up - 1) + 1 + (j - last - 1))
            now.append(value)
            if same:
                last = j
        rows.append(now)
        row_of[x] = i
    return rows[-1][-1]


def within(a: str, b: str, radius: int) -> int | None:
    """The distance of two strings of any length if it is within the radius, else None."""
    if abs(len(a) - len(b)) > radius:
        return None
    lo = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[lo:], b[lo:]
    hi = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    # cells further than the radius from the diagonal can't lie on a path within it
    rows: list[dict[int, int]] = [{j: j for j in range(min(len(b), radius) + 1)}]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        now, last = {}, 0
        for j in range(max(0, i - radius), min(len(b), i + radius) + 1):
            if j == 0:
                now[0] = i
                continue
            far = radius + 1
            same = x == b[j - 1]
            value = min(rows[i - 1].get(j - 1, far) + (not same), rows[i - 1].get(j, far) + 1, now.get(j - 1, far) + 1)
            up = seen.get(b[j - 1], 0)
            if up and last and i - up + j - last <= radius + 2:
                value = min(value, rows[up - 1].get(last - 1, far) + (i - up - 1) + 1 + (j - last - 1))
            now[j] = value
            if same:
                last = j
        if min(now.values()) > radius and len(rows) > radius + 1 and min(rows[-1].values()) > radius:
            return None
        rows.append(now)
        seen[x] = i
    value = rows[-1].get(len(b), radius + 1)
    return value if value <= radius else None


def _by_pieces(long: DataFrame, radius: int) -> DataFrame:
    """Pairs (space, a, b, distance) of long strings (space, text) that share a piece and lie within the radius."""
    count = 2 * radius + 1

    def cuts(length: int) -> list[int]:
        return [length * k // count for k in range(count + 1)]

    def run(batches):
        import xxhash

        for batch in batches:
            rows = []
            for space, text in zip(batch.column("space").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for side, lengths in ((0, (len(text),)), (1, range(len(text) - radius, len(text) + radius + 1))):
                    for length in lengths:
                        at = cuts(length)
                        for k in range(count):
                            size = at[k + 1] - at[k]
                            for move in range(-radius, radius + 1) if side else (0,):
                                lo = at[k] + move
                                if 0 <= lo and lo + size <= len(text):
                                    rows.append((space, text, side, xxhash.xxh3_128_digest(f"{length} {k} {text[lo : lo + size]}")))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["space", "text", "side", "piece"])

    keyed = long.mapInArrow(run, "space string, text string, side int, piece binary").distinct()
    left, right = keyed.where("side = 0").select("space", "piece", F.col("text").alias("x")), keyed.where("side = 1").select("space", "piece", F.col("text").alias("y"))
    met = left.join(right, ["space", "piece"]).where("x <> y").select("space", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def measured(batches):
        for batch in batches:
            value = pa.array([within(x, y, radius) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)], pa.int32())
            done = pa.RecordBatch.from_arrays([*batch.columns, value], names=["space", "a", "b", "distance"])
            yield done.filter(value.is_valid())

    return met.mapInArrow(measured, "space string, a string, b string, distance int")


def _pivots(sample: list[str], count: int) -> list[str]:
    """Strings of the sample far from each other, chosen farthest first."""
    chars, size = codes(sample, Alphabet())
    chosen = [0]
    near = distances(chars, size, np.repeat(chars[:1], len(sample), 0), np.repeat(size[:1], len(sample)))
    while len(chosen) < min(count, len(sample)):
        nxt = int(near.argmax())
        if near[nxt] == 0:
            break
        chosen.append(nxt)
        near = np.minimum(near, distances(chars, size, np.repeat(chars[nxt : nxt + 1], len(sample), 0), np.repeat(size[nxt : nxt + 1], len(sample))))
    return [sample[i] for i in chosen]


def radius_join(spark: SparkSession, strings: DataFrame, radius: int, space: str = "kind", text: str = "head") -> DataFrame:
    """Pairs of distinct strings of one space within the radius: (space, a, b, distance), a < b.

    ``strings``: distinct (space, text). The pivots come from a bounded sample.
    """
    everything = strings.select(F.col(space).alias("space"), F.col(text).alias("text"))
    long = everything.where(F.length("text") > WIDTH - radius)
    strings = strings.where(F.length(text) <= WIDTH)
    far_apart = _by_pieces(long, radius)
    total = strings.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sample = strings.where(F.pmod(F.xxhash64(text, F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(text).distinct().orderBy(F.xxhash64(text)).limit(SAMPLE).toArrow().column(text).to_pylist()
    cells = min(MOST_PIVOTS, max(4, total // CELL_STRINGS))
    pivots = _pivots(sample, max(cells, LEAST_RAYS)) if sample else []  # the first ones are also the centres of the cells
    if not pivots:
        return far_apart.select(F.col("space").alias(space), "a", "b", "distance")

    def assign(batches):
        alphabet = Alphabet()
        chars, size = codes(pivots, alphabet)
        for batch in batches:
            words = batch.column("text").to_pylist()
            if not words:
                continue
            c, n = codes(words, alphabet)
            far = np.stack([distances(c, n, np.repeat(chars[k : k + 1], len(words), 0), np.repeat(size[k : k + 1], len(words))) for k in range(len(pivots))], 1)
            centre = far[:, :cells]
            home = centre.argmin(1)
            inside = centre <= centre[np.arange(len(words)), home][:, None] + 2 * radius
            row, cell = np.nonzero(inside)
            rays = np.minimum(far, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("space").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array([words[i] for i in row], pa.string()), pa.array(home[row] == cell), pa.array([rays[i].tobytes() for i in row], pa.binary())],
                names=["space", "cell", "text", "home", "rays"],
            )

    spread_out = strings.select(F.col(space).alias("space"), F.col(text).alias("text")).repartition(spread(spark)).mapInArrow(assign, "space string, cell int, text string, home boolean, rays binary")
    spread_out = Workspace(spark, "cells").save(spread_out, "cells")
    large = spread_out.groupBy("space", "cell").count().select("space", "cell", F.ceil(2 * F.col("count") / F.lit(CELL_CAP)).cast("int").alias("parts")).where(F.col("parts") > 2)
    spread_out = spread_out.join(F.broadcast(large), ["space", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # at most a row per cell
    spread_out = spread_out.withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread_out = spread_out.select("space", "cell", "text", "home", "rays", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))

    def run(table):
        words = table.column("text").to_pylist()
        space_name = table.column("space")[0].as_py()
        home = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False).astype(bool))
        rays = np.frombuffer(b"".join(table.column("rays").to_pylist()), np.uint8).reshape(len(words), -1).astype(np.int16)
        c, n = codes(words, Alphabet())
        part_of = table.column("part").to_numpy()
        crossed = table.column("one")[0].as_py() != table.column("two")[0].as_py()
        columns = [n.astype(np.int16), *rays.T]  # the length is the distance to the empty string
        letters = np.stack([((c > 0) & (c % 32 == k)).sum(1) for k in range(32)], 1).astype(np.int16)
        left, right, value = [], [], []
        for lo in range(0, len(home), 128):
            mine = home[lo : lo + 128]
            mask = np.ones((len(mine), len(words)), bool)
            for x in columns[:6]:
                mask &= np.abs(x[mine][:, None] - x[None, :]) <= radius
            i, j = np.nonzero(mask)
            i = mine[i]
            for x in columns[6:]:
                keep = np.abs(x[i] - x[j]) <= radius
                i, j = i[keep], j[keep]
            keep = (part_of[i] != part_of[j]) if crossed else (i != j)
            i, j = i[keep], j[keep]
            # an edit changes at most two letter counts by one
            keep = np.abs(letters[i] - letters[j]).sum(1) <= 2 * radius
            i, j = i[keep], j[keep]
            for at in range(0, len(i), 20_000):
                x, y = i[at : at + 20_000], j[at : at + 20_000]
                away = distances(c[x], n[x], c[y], n[y])
                good = away <= radius
                left += [words[k] for k in x[good]]
                right += [words[k] for k in y[good]]
                value += away[good].tolist()
        a = [min(x, y) for x, y in zip(left, right, strict=True)]
        b = [max(x, y) for x, y in zip(left, right, strict=True)]
        return pa.table({"space": pa.array([space_name] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "distance": pa.array(value, pa.int32())})

    key = ["space", "cell", "one", "two"]
    pairs = spread_out.repartition(spread(spark), *key).groupBy(*key).applyInArrow(run, "space string, a string, b string, distance int").unionByName(far_apart).distinct()
    return pairs.select(F.col("space").alias(space), "a", "b", "distance")
