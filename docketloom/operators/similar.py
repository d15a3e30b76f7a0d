"""Names similar to a query by their three-letter pieces, scored in blocks instead of pair by pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketloom.functions.text import trigrams
from docketloom.workspace import spread

NAMES_A_BLOCK = 16_384
QUERIES_A_BLOCK = 4_096
LEAST_QUERIES = 128
DENSE_SHARE = 0.03
ROUNDING = 0.002  # similarities closer than this may be equal once rounded to a tenth of a per cent


class Pieces:
    """Inverted lists of the pieces of many names: those of many names as a matrix, the others as lists."""

    def __init__(self, counts: np.ndarray, codes: np.ndarray, known: int):
        self.names, self.sizes = len(counts), counts
        owner = np.repeat(np.arange(self.names), counts)
        common = np.flatnonzero(np.bincount(codes, minlength=known) > DENSE_SHARE * self.names)
        self.column = np.full(known, -1)
        self.column[common] = np.arange(len(common))
        dense = self.column[codes] >= 0
        self.matrix = np.zeros((len(common), self.names), np.float32)
        self.matrix[self.column[codes[dense]], owner[dense]] = 1
        order = np.argsort(codes[~dense], kind="stable")
        self.owner = owner[~dense][order]
        self.first = np.searchsorted(codes[~dense][order], np.arange(known + 1))

    def shared(self, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How many pieces every query (rows) shares with every name."""
        asked = np.repeat(np.arange(len(counts)), counts)
        column = self.column[codes]
        dense = column >= 0
        has = np.zeros((len(counts), len(self.matrix)), np.float32)
        has[asked[dense], column[dense]] = 1
        words, who = codes[~dense], asked[~dense]
        lo, length = self.first[words], self.first[words + 1] - self.first[words]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum()) if len(words) else np.zeros(0, np.int64)
        rare = np.bincount(self.owner[at] + np.repeat(who * self.names, length), minlength=len(counts) * self.names)
        return rare.reshape(len(counts), self.names) + (has @ self.matrix).astype(np.int64)


def _best(similarity: np.ndarray, low: np.ndarray, limit: int) -> np.ndarray:
    """Which of a query's names can be among its ``limit`` cases: those not worse than names of that many different cases."""
    if len(similarity) <= limit:
        return np.arange(len(similarity))
    seen: set[int] = set()
    for i in np.argsort(-similarity, kind="stable"):
        seen.add(int(low[i]))
        if len(seen) >= limit:
            return np.flatnonzero(similarity >= similarity[i] - ROUNDING)
    return np.arange(len(similarity))


def near_names(asked: DataFrame, names: DataFrame, least: float, limit: int) -> DataFrame:
    """(norm, alias_norm, shared, together): names more similar to a query than ``least``, as far as they can be among its ``limit`` best cases.

    ``asked`` is (norm), ``names`` (alias_norm, judgment_id). Every query meets every name, a
    block of queries and a block of names in a task.
    """
    left = asked.select("norm").distinct()
    right = names.groupBy("alias_norm").agg(F.min("judgment_id").alias("low"))
    parts = max(1, -(-right.count() // NAMES_A_BLOCK))
    n = left.count()
    tasks = spread(asked.sparkSession)
    crowd = max(1, -(-n // QUERIES_A_BLOCK), min(-(-tasks // parts), n // LEAST_QUERIES))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = left.select("norm", F.lit(None).cast("long").alias("low"), F.lit(True).alias("asks"), trigrams("norm").alias("grams"), every(parts).alias("part"), own("norm", crowd).alias("crowd"))
    right = right.select(F.col("alias_norm").alias("norm"), "low", F.lit(False).alias("asks"), trigrams("alias_norm").alias("grams"), own("alias_norm", parts).alias("part"), every(crowd).alias("crowd"))

    def run(table):
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        coded = pc.dictionary_encode(pc.list_flatten(table.column("grams")))
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        codes, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        counts = pc.list_value_length(table.column("grams")).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(asks, counts)
        sides = [(np.flatnonzero(asks == side), counts[asks == side], codes[of == side]) for side in (True, False)]
        (who, q_counts, q_codes), (items, n_counts, n_codes) = sides
        out = [np.zeros(0, np.int64)] * 4
        if len(who) and len(items):
            pieces, low = Pieces(n_counts, n_codes, known), table.column("low").take(pa.array(items)).to_numpy()
            stop, found = np.concatenate(([0], np.cumsum(q_counts))), []
            for lo in range(0, len(who), 64):
                hi = min(len(who), lo + 64)
                shared = pieces.shared(q_counts[lo:hi], q_codes[stop[lo] : stop[hi]])
                together = q_counts[lo:hi, None] + n_counts[None, :] - shared
                similarity = shared / np.maximum(together, 1)
                for i in range(hi - lo):
                    at = np.flatnonzero(similarity[i] > least)
                    at = at[_best(similarity[i, at], low[at], limit)]
                    found.append((np.full(len(at), who[lo + i]), items[at], shared[i, at], together[i, at]))
            out = [np.concatenate(x) for x in zip(*found, strict=True)]
        text = table.column("norm")
        return pa.table({"norm": text.take(pa.array(out[0])), "alias_norm": text.take(pa.array(out[1])), "shared": pa.array(out[2], pa.int64()), "together": pa.array(out[3], pa.int64())})

    return left.unionByName(right).repartition(tasks, "part", "crowd").groupBy("part", "crowd").applyInArrow(run, "norm string, alias_norm string, shared long, together long")
