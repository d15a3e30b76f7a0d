"""Problem 3: near-duplicate texts, by an LSH forest over minhash signatures.

A text becomes the set of its runs of ``words`` consecutive words. One-permutation
minhashing gives every set a signature; each tree of the forest is one order
of the texts by another part of the signature, kept as a range-partitioned
sort over all partitions. Texts with a long common prefix are neighbours in
that order: a text is compared with its ``reach`` nearest neighbours on either
side as long as they share a prefix, so the depth used adapts to how crowded
the region is. A bit sketch decides which neighbours become candidates, with a
margin of three standard errors; every candidate is then verified exactly.

Equal texts are one class and enter the forest once.

Defined results
* null and empty texts belong to no pair; equal texts always agree, also those of
  fewer words than a run; texts without runs agree with equal ones only;
* words are runs of ``[a-z0-9]`` of the lower-case text, whatever the language;
* an id on several rows counts once, with its (code point) greatest text;
* ties need no rule, as a pair's similarity decides alone; extra columns are ignored;
* an empty table gives empty results.
"""

from __future__ import annotations

import re
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.operators.components import connected_components
from docketloom.workspace import Workspace, spread

WORDS = 3
THRESHOLD = 0.5
BINS = 512
TREES = 40
DEPTH = 12
REACH = 48
LEAST_PREFIX = 1
KEY_BYTES = 2 * DEPTH
SKETCH_BYTES = BINS // 8

_run = re.compile(r"[a-z0-9]+")
_U = np.uint64


class _Vocabulary(dict):
    """Word to 64-bit hash, remembered for the words met last."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_vocabulary = _Vocabulary()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashed(found: list[str], words: int) -> np.ndarray:
    hashes = np.fromiter(map(_vocabulary.__getitem__, found), np.uint64, len(found))
    total = np.zeros(len(found) - words + 1, np.uint64)
    for k in range(words):
        total = _mix(total + hashes[k : len(found) - words + 1 + k] + _U(k + 1))
    return np.unique(total)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words."""
    found = _run.findall(text.lower())
    if len(found) < words:
        return np.zeros(0, np.uint64)
    return _hashed(found, words)


_low = np.arange(BINS, dtype=np.uint64) * _U((1 << 64) // BINS)


def signature(runs: np.ndarray) -> np.ndarray:
    """One minhash per bin; empty bins borrow from the next filled one."""
    first = np.searchsorted(runs, _low)
    upper = np.append(first[1:], len(runs))
    filled = first < upper
    value = np.zeros(BINS, np.uint64)
    value[filled] = runs[first[filled]]
    if not filled.all():
        at = np.flatnonzero(filled)
        nearest = at[np.searchsorted(at, np.arange(BINS)) % len(at)]
        away = (nearest - np.arange(BINS)) % BINS
        value = value[nearest] + away.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    return _mix(value)


def _signed(rows: DataFrame, words: int) -> DataFrame:
    import xxhash

    def run(batches):
        order = np.random.default_rng(3).permutation(BINS)[: TREES * DEPTH]
        for batch in batches:
            size, keys, sketch, klass = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = _run.findall(text.lower())
                klass.append(xxhash.xxh3_128_digest(" ".join(found) if found else "\0" + text))
                if len(found) < words:
                    size.append(0)
                    keys.append(None)
                    sketch.append(None)
                    continue
                runs = _hashed(found, words)
                s = signature(runs)
                size.append(len(runs))
                keys.append((s[order] >> _U(48)).astype(">u2").tobytes())
                sketch.append(np.packbits((s & _U(1)).astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(klass, pa.binary()), pa.array(size, pa.int32()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())], names=["id", "klass", "size", "keys", "sketch"])

    return rows.mapInArrow(run, "id long, klass binary, size int, keys binary, sketch binary")


def _near(tree: np.ndarray, key: np.ndarray, ids: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among rows sorted by tree and key, each with its neighbours in the order."""
    left, right = [], []
    n = len(ids)
    words = sketch.view(np.uint64)
    active = np.arange(n)
    for step in range(1, min(REACH, n - 1) + 1):
        active = active[active + step < n]
        other = active + step
        # a neighbour further on shares no longer prefix, so a row that shares none is done
        active = active[(tree[active] == tree[other]) & (key[active, :LEAST_PREFIX] == key[other, :LEAST_PREFIX]).all(1)]
        if not len(active):
            break
        other = active + step
        a, b = size[active].astype(np.float64), size[other].astype(np.float64)
        fits = np.minimum(a, b) >= threshold * np.maximum(a, b)
        x, y = active[fits], other[fits]
        agree = 1 - np.bitwise_count(words[x] ^ words[y]).sum(1) / BINS
        guess = 2 * agree - 1
        sample = np.minimum(BINS, np.minimum(size[x], size[y]))
        keep = guess >= threshold - 3 * np.sqrt((1 - threshold**2) / sample)
        left.append(x[keep])
        right.append(y[keep])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = ids[np.concatenate(left)], ids[np.concatenate(right)]
    return np.minimum(x, y), np.maximum(x, y)


def candidates(signed: DataFrame, spark: SparkSession, threshold: float) -> DataFrame:
    """Distinct pairs (u, w) of neighbours in one of the forest's orders."""
    flat = signed.where("size > 0").select("id", "size", "sketch", "keys", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    flat = flat.select("tree", F.expr(f"substring(keys, tree * {KEY_BYTES} + 1, {KEY_BYTES})").alias("key"), "id", "size", "sketch")
    ordered = flat.repartitionByRange(spread(spark), "tree", "key", "id").sortWithinPartitions("tree", "key", "id")

    def compare(batches):
        """Candidates inside the partition; its first and last rows go out for stitching."""
        tail = None
        head_left, edge = REACH, []
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if head_left:
                some = table.slice(0, head_left)
                edge.append(("head", some))
                head_left -= some.num_rows
            block = table if tail is None else pa.concat_tables([tail, table])
            u, w = _block(block, threshold)
            yield _pairs(u, w)
            tail = block.slice(max(0, block.num_rows - REACH))
            part = True
        if part:
            edge.append(("tail", tail))
            from pyspark import TaskContext

            number = TaskContext.get().partitionId()
            for side, rows in edge:
                yield _edge_rows(rows, number, side)

    found = ordered.mapInArrow(compare, PAIR_OR_EDGE)
    return found


PAIR_OR_EDGE = "u long, w long, part int, side string, tree int, key binary, id long, size int, sketch binary"
_pair_schema = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("part", pa.int32()), ("side", pa.string()), ("tree", pa.int32()), ("key", pa.binary()), ("id", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())])


def _pairs(u: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([u, w], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
    n = len(both)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *(pa.nulls(n, f.type) for f in list(_pair_schema)[2:])], schema=_pair_schema)


def _edge_rows(rows: pa.Table, number: int, side: str) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    n = rows.num_rows
    column = lambda c: rows.column(c).combine_chunks() if n else pa.nulls(0, rows.schema.field(c).type)
    arrays = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([number] * n, pa.int32()), pa.array([side] * n), *(column(c).cast(_pair_schema.field(c).type) for c in ("tree", "key", "id", "size", "sketch"))]
    return pa.RecordBatch.from_arrays(arrays, schema=_pair_schema)


def _block(rows: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.combine_chunks()
    n = rows.num_rows
    key = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint8).reshape(n, KEY_BYTES).view(">u2")
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH_BYTES)
    return _near(rows.column("tree").to_numpy(), key, rows.column("id").to_numpy(), rows.column("size").to_numpy(), np.ascontiguousarray(sketch), threshold)


def _stitch(edges: DataFrame, spark: SparkSession, threshold: float) -> DataFrame:
    """Candidates across the borders of neighbouring partitions.

    Tail rows of a partition meet the ``REACH`` rows that follow, over as many
    partitions as hold them, as some may be small or empty; an order of P partitions
    has at most 2 * REACH * P such rows.
    """
    sizes = sorted((r["part"], r["count"]) for r in edges.where("side = 'head'").groupBy("part").count().collect())  # one row per partition
    borders = []
    for i, (part, _) in enumerate(sizes):
        seen = 0
        for other, rows in sizes[i + 1 :]:
            if seen >= REACH:
                break
            borders.append((part, other))
            seen += rows
    pairs = F.broadcast(spark.createDataFrame(borders, "border int, part int"))
    tails = edges.where("side = 'tail'").withColumn("border", F.col("part"))
    heads = edges.where("side = 'head'").join(pairs, "part").select(*tails.columns)

    def run(table):
        rows = table.select(["tree", "key", "id", "size", "sketch"]).combine_chunks().sort_by([("tree", "ascending"), ("key", "ascending"), ("id", "ascending")])
        if rows.num_rows < 2:
            return pa.table({"u": pa.array([], pa.int64()), "w": pa.array([], pa.int64())})
        u, w = _block(rows, threshold)
        both = np.unique(np.stack([u, w], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return pa.table({"u": both[:, 0], "w": both[:, 1]})

    return tails.unionByName(heads).groupBy("border").applyInArrow(run, "u long, w long")


def _verify(pairs: DataFrame, texts: DataFrame, work: Workspace, spark: SparkSession, words: int, threshold: float, name: str = "runs") -> DataFrame:
    """Exact similarity of the candidates: (u, w, similarity) at or above the threshold."""
    need = pairs.select(F.explode(F.array("u", "w")).alias("id")).distinct()

    def runs(batches):
        for batch in batches:
            sets = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "runs"])

    sets = work.save(texts.join(need, "id", "left_semi").select("id", "text").mapInArrow(runs, "id long, runs binary"), name)
    left, right = sets.select(F.col("id").alias("u"), F.col("runs").alias("ru")), sets.select(F.col("id").alias("w"), F.col("runs").alias("rw"))

    def run(batches):
        for batch in batches:
            value = []
            for a, b in zip(batch.column("ru"), batch.column("rw"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                value.append(both / max(1, len(x) + len(y) - both))
            out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("w"), pa.array(value, pa.float64())], names=["u", "w", "similarity"])
            yield out.filter(pa.array(np.array(value) >= threshold))

    return pairs.join(left, "u").join(right, "w").select("u", "w", "ru", "rw").mapInArrow(run, "u long, w long, similarity double")


def _complete(links: DataFrame, texts: DataFrame, work: Workspace, spark: SparkSession, words: int, threshold: float) -> DataFrame:
    """Families larger than the reach: texts with as many links as a window holds meet their links' links.

    Rounds go on until such texts gain no further link, so a crowded region loses none.
    """
    for turn in count(1):
        both = links.select("u", "w").unionByName(links.select(F.col("w").alias("u"), F.col("u").alias("w")))
        full = both.groupBy("u").count().where(F.col("count") >= REACH).select("u")
        if not full.limit(1).count():
            return links
        met = both.join(full, "u", "left_semi").join(both.select(F.col("u").alias("w"), F.col("w").alias("x")), "w")
        pairs = met.select(F.least("u", "x").alias("u"), F.greatest("u", "x").alias("w")).where("u <> w").distinct().join(links.select("u", "w"), ["u", "w"], "left_anti")
        more = work.save(_verify(work.save(pairs, f"more-{turn}"), texts, work, spark, words, threshold, f"runs-{turn}"), f"links-{turn}")
        if not more.limit(1).count():
            return links
        links = work.save(links.unionByName(more), f"all-{turn}")
    raise AssertionError("unreachable")


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "id", text_col: str = "judgment_text", words: int = WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, classes): links (u, w, similarity) between class representatives, classes (id, rep)."""
    work = Workspace(spark, "near-duplicates")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null and text <> ''")
    signed = work.save(_signed(rows, words), "signed")
    if signed.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.max("text").alias("text"))
        signed = work.save(_signed(rows, words), "signed-once")
    classes = work.save(signed.select("id", "klass").join(signed.groupBy("klass").agg(F.min("id").alias("rep")), "klass").select("id", "rep"), "classes")
    heads = signed.join(classes.where("id = rep").select("id"), "id", "left_semi")
    found = work.save(candidates(heads, spark, threshold), "found")
    inner = found.where("u is not null").select("u", "w")
    pairs = work.save(inner.unionByName(_stitch(found.where("side is not null"), spark, threshold)).where("u <> w").distinct(), "pairs")
    work.drop("found")
    links = work.save(_verify(pairs, rows, work, spark, words, threshold), "links")
    return _complete(links, rows, work, spark, words, threshold), classes


def all_pairs(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of ids, copies expanded by joins: (id_a, id_b)."""
    a, b = classes.select(F.col("id").alias("x"), F.col("rep").alias("u")), classes.select(F.col("id").alias("y"), F.col("rep").alias("w"))
    across = links.select("u", "w").join(a, "u").join(b, "w").select("x", "y")
    inside = a.join(b, F.col("u") == F.col("w")).where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(spark: SparkSession, links: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per text: (id, group_id, class_id, links); links counts the other classes it agrees with."""
    part = connected_components(spark, links, "u", "w")
    degree = links.select(F.explode(F.array("u", "w")).alias("rep")).groupBy("rep").count()
    out = classes.join(part.select(F.col("id").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("component", "rep").alias("group_id"), F.col("rep").alias("class_id"), F.coalesce("count", F.lit(0)).alias("links"))
