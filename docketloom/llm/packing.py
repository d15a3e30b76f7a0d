"""Problem 6: fill containers of fixed capacity with texts, by lexical retrieval packing.

Texts are measured and indexed in tokens of a public tokenizer. The inverted
index is sharded by content: texts are placed in cells by a random projection
of their BM25 weights, so the texts a seed scores best with lie in few shards. The
largest unused texts are the seeds of containers, as many as the free texts need.
Every seed asks the shards of its ``PROBES`` nearest cells, which score it with BM25
over all its tokens and statistics of the whole corpus; the lists are merged, and
in the order of their size the seeds take their best unused neighbours that fit; a seed
taken by a larger one opens no container. This is settled region by region, a region
holding a bounded number of containers, and texts that several regions claim go to the
container they score best with. Containers whose list is used up ask again among the
texts left, with new seeds as far as their room doesn't do. Gaps are then closed with the largest
texts that fit, planned on the counts of every size and of every gap. Containers left too
empty are opened and packed once more by size, if that takes fewer of them.

The centres of the cells are fitted on at most ``SAMPLE`` texts and are at most
``MOST_CELLS``; all texts are placed. A cell that holds more than a shard is split in parts
that are all asked. The term statistics are counts per token id, so their size is
bounded by the tokenizer's vocabulary and may be broadcast.

Defined results
* a text longer than the capacity is cut at multiples of it; full pieces are containers of their
  own, the rest is an item; no other text is cut;
* null and empty texts hold no tokens and get no container;
* a doc_id that occurs on several rows is packed once for every row; copies are told apart by ``copy``;
* extra columns are ignored, an empty table gives an empty packing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.llm.neighbours import grow_cells
from docketloom.llm.tokens import TOKENIZER, VOCABULARY, encode_array
from docketloom.workspace import Workspace, spread

CAPACITY = 2_048
SHARD_ITEMS = 3_000
PROBES = 5
TEXTS_AT_ONCE = 1_000
SAMPLE = 16_384
MOST_CELLS = 2_048
WIDTH, SIGNS = 256, 8  # of the random projection
K1, B = 1.2, 0.75
DENSE_SHARE = 0.03
CLOSE_AT = 0.1
REOPEN_BELOW = 0.97
ASKS = 2
REGION = 65_536
NEAREST = 32
SEEDS_A_TASK = 4_096
REST = 0.02  # of the tokens: the last texts are placed by size alone
SETTLED = 0.01  # of the items placed: fewer lost claims are left to the next question
SALT = 16
NO_ID = -(2**63)  # stands for a null doc_id

KEY = ["doc_id", "copy", "start"]
# sorted token ids are kept as steps, in as few bytes as the vocabulary allows
STEP = np.uint16 if VOCABULARY <= 1 << 16 else np.uint32
ITEMS = "doc_id long, copy long, start long, n long, steps binary, tf binary"
LIST = "array<struct<d:float,iid:long,n:int>>"
LIST_TYPE = pa.list_(pa.struct([("d", pa.float32()), ("iid", pa.int64()), ("n", pa.int32())]))


# ---------------------------------------------------------------- items
def _numbers(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of every row, all numbers) of a binary column, read from its buffer without a step per row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, kind)
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    width = np.dtype(kind).itemsize
    return np.diff(at).astype(np.int64) // width, np.frombuffer(data, kind, (at[-1] - at[0]) // width, at[0]) if data is not None else np.zeros(0, kind)


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of every row, terms, counts of the terms) of a batch or table with packed tokens."""
    counts, values = _numbers(rows.column("steps"), STEP)
    run = np.cumsum(values, dtype=np.int64)
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, run[np.maximum(first - 1, 0)], 0) if len(run) else np.zeros(len(counts), np.int64)
    return counts, run - np.repeat(before, counts), _numbers(rows.column("tf"), np.uint16)[1].astype(np.float32)


def _packed(numbers: np.ndarray, stop: np.ndarray) -> pa.Array:
    """A binary column of rows of numbers; row i holds those from ``stop[i]`` to ``stop[i + 1]``."""
    return pa.Array.from_buffers(pa.binary(), len(stop) - 1, [None, pa.py_buffer((stop * numbers.itemsize).astype(np.int32).tobytes()), pa.py_buffer(numbers.tobytes())])


def items_of(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces to place: (doc_id, copy, start, n, steps, tf); full pieces carry no tokens."""

    def run(batches):
        for batch in (b.slice(lo, TEXTS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, TEXTS_AT_ONCE)):
            size, tails = np.zeros(batch.num_rows, np.int64), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode_array(text, tokenizer)
                size[i] = len(ids)
                tails.append(ids[len(ids) - len(ids) % capacity :].astype(np.int64))
            pieces = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            # full pieces carry no terms; those of all last pieces are sorted at once
            last = np.repeat(np.cumsum(pieces) - 1, size % capacity)
            key = np.sort(last * VOCABULARY + np.concatenate(tails))
            at = np.flatnonzero(np.diff(key, prepend=-1))
            of, term = np.divmod(key[at], VOCABULARY)
            tf = np.diff(at, append=len(key)).astype(np.uint16)
            step = np.diff(term, prepend=0)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            step[first] = term[first]
            stop = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(owner)))))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("copy").take(take), pa.array(start, pa.int64()), pa.array(np.minimum(size[owner] - start, capacity), pa.int64()), _packed(step.astype(STEP), stop), _packed(tf, stop)], names=[*KEY, "n", "steps", "tf"])

    return documents.mapInArrow(run, ITEMS)


class Statistics:
    """Document frequency per token id, number of items and their mean length."""

    def __init__(self, items: DataFrame):
        def run(batches):
            count = np.zeros(VOCABULARY, np.int64)
            for batch in batches:
                count += np.bincount(_unpacked(batch)[1], minlength=VOCABULARY)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["term", "df"])

        counted = items.select("steps", "tf").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        self.frequency = np.zeros(VOCABULARY, np.int64)  # at most one row per token id of the vocabulary
        self.frequency[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        whole = items.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
        self.total, self.mean = whole["n"], whole["mean"] or 1.0
        self.idf = np.log1p((self.total - self.frequency + 0.5) / (self.frequency + 0.5)).astype(np.float32)

    def weights(self, terms: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """BM25 weight of every term in the item that has it; ``size`` is the item's length."""
        return (self.idf[terms] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean)))).astype(np.float32)


def _projected(counts: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sparse random projection of weighted items: every token has SIGNS places of its own."""
    rng = np.random.default_rng(17)
    place, sign = rng.integers(0, WIDTH, (VOCABULARY, SIGNS)), rng.choice(np.array([-1, 1], np.float32), (VOCABULARY, SIGNS))
    rows, out, stop = len(counts), np.zeros((len(counts), WIDTH), np.float32), np.concatenate(([0], np.cumsum(counts)))
    for lo in range(0, rows, 1_000):
        hi = min(rows, lo + 1_000)
        t, w = terms[stop[lo] : stop[hi]], weight[stop[lo] : stop[hi]]
        at = np.repeat(np.arange(hi - lo) * WIDTH, counts[lo:hi])[:, None] + place[t]
        out[lo:hi] = np.bincount(at.ravel(), (w[:, None] * sign[t]).ravel(), (hi - lo) * WIDTH).reshape(-1, WIDTH)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


def _placed(items: DataFrame, stats: Statistics, shard_items: int) -> DataFrame:
    """``items`` with ``near``, the PROBES nearest cells of every item, nearest first."""
    told = items.sparkSession.sparkContext.broadcast(stats)

    def vectors(batch) -> np.ndarray:
        counts, terms, tf = _unpacked(batch)
        return _projected(counts, terms, told.value.weights(terms, tf, np.repeat(batch.column("n").to_numpy(), counts)))

    def sampled(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.float16).tobytes() for v in vectors(batch)], pa.binary())], names=["v"])

    share = min(1.0, SAMPLE / max(stats.total, 1))
    some = items.where(F.pmod(F.xxhash64(*KEY), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("n", "steps", "tf").limit(SAMPLE).mapInArrow(sampled, "v binary").toArrow().column("v").to_pylist()
    sample = np.frombuffer(b"".join(some), np.float16).reshape(-1, WIDTH).astype(np.float32)
    middle = sample.mean(0)
    sample = sample - middle
    sample /= np.maximum(np.linalg.norm(sample, axis=1), 1e-9)[:, None]
    centres = grow_cells(sample, max(8, int(shard_items * share)) if share < 1 else shard_items, min(MOST_CELLS, stats.total // shard_items + 1))
    for _ in range(6):
        home = (sample @ centres.T).argmax(1)
        centres = np.stack([sample[home == k].mean(0) if (home == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-9)[:, None]

    def run(batches):
        for batch in (b.slice(lo, 2_000) for b in batches for lo in range(0, b.num_rows, 2_000)):
            away = -((vectors(batch) - middle) @ centres.T)
            k = min(PROBES, len(centres))
            first = np.argpartition(away, k - 1, axis=1)[:, :k] if k < len(centres) else np.broadcast_to(np.arange(k), away.shape)
            near = np.take_along_axis(first, np.argsort(np.take_along_axis(away, first, 1), axis=1, kind="stable"), 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("iid", "n", "steps", "tf")), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["iid", "n", "steps", "tf", "near"])

    return items.select("iid", "n", "steps", "tf").mapInArrow(run, "iid long, n long, steps binary, tf binary, near array<int>")


# ---------------------------------------------------------------- index
class Shard:
    """Inverted lists of one shard: tokens of many items as a matrix, the others as lists."""

    def __init__(self, counts: np.ndarray, terms: np.ndarray, weight: np.ndarray):
        self.items = len(counts)
        owner = np.repeat(np.arange(self.items), counts)
        common = np.flatnonzero(np.bincount(terms, minlength=VOCABULARY) > DENSE_SHARE * self.items)
        self.column = np.full(VOCABULARY, -1)
        self.column[common] = np.arange(len(common))
        dense = self.column[terms] >= 0
        self.matrix = np.zeros((len(common), self.items), np.float32)
        self.matrix[self.column[terms[dense]], owner[dense]] = weight[dense]
        order = np.argsort(terms[~dense], kind="stable")
        self.owner, self.weight = owner[~dense][order].astype(np.int32), weight[~dense][order]
        self.first = np.searchsorted(terms[~dense][order], np.arange(VOCABULARY + 1))

    def scores(self, counts: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """BM25 of every query (rows of ``terms``) with every item."""
        asked = np.repeat(np.arange(len(counts)), counts)
        column = self.column[terms]
        dense = column >= 0
        has = np.zeros((len(counts), len(self.matrix)), np.float32)
        has[asked[dense], column[dense]] = 1
        out = has @ self.matrix
        words, who = terms[~dense], asked[~dense]
        lo, length = self.first[words], self.first[words + 1] - self.first[words]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum()) if len(words) else np.zeros(0, np.int64)
        out += np.bincount(self.owner[at] + np.repeat(who * self.items, length), self.weight[at], out.size).reshape(out.shape)
        return out


def neighbour_lists(spark: SparkSession, seeds: DataFrame, free: DataFrame, stats: Statistics, shard_items: int = SHARD_ITEMS, nearest: int = NEAREST) -> DataFrame:
    """(seed, list): the best ``nearest`` free items of every seed in the shards of its cells, best first.

    ``seeds``: (iid, n, room, steps, near); ``free``: (iid, n, steps, tf, near). A seed isn't its own
    neighbour, nor is an item with more tokens than its room, or one that comes before it in the order of
    size and id.
    """
    told = spark.sparkContext.broadcast(stats)
    home = F.get("near", F.lit(0)).alias("cell")
    asked = seeds.select("iid", "n", "room", "steps", F.lit(b"").alias("tf"), F.explode("near").alias("cell"))
    many = {r["cell"]: -(-r["count"] // (2 * shard_items)) for r in free.select(home).groupBy("cell").count().where(F.col("count") > 2 * shard_items).collect()}  # at most MOST_CELLS rows
    crowd = {r["cell"]: -(-r["count"] // SEEDS_A_TASK) for r in asked.groupBy("cell").count().where(F.col("count") > SEEDS_A_TASK).collect()}  # as above

    def number(of: dict[int, int]):
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("cell")), F.lit(1)) if of else F.lit(1)

    own = lambda of, salt: F.pmod(F.xxhash64("iid", F.lit(salt)), number(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), (number(of) - 1).cast("int")))
    # the parts of a cell's items meet all parts of the seeds that ask it
    right = free.select("iid", "n", F.lit(-1).cast("long").alias("room"), "steps", "tf", home).withColumn("part", own(many, 3)).withColumn("crowd", every(crowd))
    left = asked.withColumn("part", every(many)).withColumn("crowd", own(crowd, 5))

    def run(table):
        table = table.combine_chunks()
        iid, n, room = (table.column(c).to_numpy() for c in ("iid", "n", "room"))
        items, who = np.flatnonzero(room < 0), np.flatnonzero(room >= 0)
        items = items[np.lexsort((iid[items], -n[items]))]
        if not len(items) or not len(who):
            return pa.table({"seed": pa.array([], pa.int64()), "list": pa.array([], LIST_TYPE)})
        stats = told.value
        counts, terms, tf = _unpacked(table.take(pa.array(items)))
        shard = Shard(counts, terms, stats.weights(terms, tf, np.repeat(n[items], counts)))
        size, name = n[items], iid[items]
        # items stand in the order of size and id, so those too large and those before the seed are the first ones
        begin = np.searchsorted(-size, -np.minimum(room[who], n[who]), "left")
        upto = np.searchsorted(-size, -n[who], "right")
        for i in np.flatnonzero((room[who] >= n[who]) & (upto > begin)):
            begin[i] += np.searchsorted(name[begin[i] : upto[i]], iid[who[i]], "right")
        k = min(nearest, len(items))
        lengths, parts = np.zeros(len(who), np.int64), []
        counts, terms, _ = _unpacked(table.take(pa.array(who)))
        stop = np.concatenate(([0], np.cumsum(counts)))
        for lo in range(0, len(who), 64):
            hi = min(len(who), lo + 64)
            score = shard.scores(counts[lo:hi], terms[stop[lo] : stop[hi]])
            for row, first in zip(score, begin[lo : lo + 64], strict=True):
                row[:first] = 0
            best = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < len(items) else np.broadcast_to(np.arange(k), score.shape)
            value = np.take_along_axis(score, best, 1)
            order = np.lexsort((name[best], -value), axis=1)
            best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
            good = value > 0
            lengths[lo : lo + 64] = good.sum(1)
            parts.append((best[good], value[good]))
        flat, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        entry = pa.StructArray.from_arrays([pa.array(-value.astype(np.float32)), pa.array(name[flat]), pa.array(size[flat].astype(np.int32))], names=["d", "iid", "n"])
        return pa.table({"seed": pa.array(iid[who]), "list": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), entry)})

    key = ["cell", "part", "crowd"]
    columns = ["iid", "n", "room", "steps", "tf", *key]
    found = left.select(columns).unionByName(right.select(columns)).repartition(spread(spark), *key).groupBy(*key).applyInArrow(run, f"seed long, list {LIST}")
    return found.groupBy("seed").agg(F.slice(F.array_sort(F.flatten(F.collect_list("list"))), 1, nearest).alias("list"))


# ---------------------------------------------------------------- claims
CLAIM = "item long, n int, seed long, d float, kept boolean, joins boolean"


def _greedy(capacity: int):
    """Claims of the containers of one region: in the order of size each takes its best unused neighbours that fit.

    A container that has begun keeps what it holds; a seed that has not begun may be claimed by one before it.
    """

    def run(table):
        table = table.combine_chunks()
        seed, n, room, begun = (table.column(c).to_numpy() for c in ("seed", "n", "room", "begun"))
        lists, held = table.column("list").combine_chunks(), table.column("held").to_pylist()
        entries = lists.flatten()
        name, size, d = (entries.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("iid", "n", "d"))
        stop = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).tolist()
        used = {x for some in held for x in some} | set(seed[begun].tolist())
        seeds = set(seed[~begun].tolist())
        out = []
        for i in np.lexsort((seed, -n)).tolist():
            me, left = int(seed[i]), int(room[i])
            if not begun[i] and me in used:
                continue
            used.add(me)
            out.append((me, int(n[i]), me, 0.0, True, False))
            out += [(x, 0, me, 0.0, True, False) for x in held[i]]
            for j in range(stop[i], stop[i + 1]):
                if left < CLOSE_AT * capacity:
                    break
                if size[j] <= left and name[j] not in used:
                    used.add(name[j])
                    left -= size[j]
                    out.append((name[j], size[j], me, d[j], False, name[j] in seeds))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float32(), pa.bool_(), pa.bool_())
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(zip(("item", "n", "seed", "d", "kept", "joins"), kinds, strict=True))})

    return run


def _settle(spark: SparkSession, work: Workspace, opened: DataFrame, lists: DataFrame, capacity: int, label: str, region: int = REGION) -> DataFrame:
    """(seed, n, room, held): the containers with what they won; seeds that joined another container are gone.

    ``opened``: (seed, n, room, begun, held, cell). Containers are settled in regions of about
    ``region`` of them, neighbouring cells together; an item that several regions claim goes to
    the container it scores best with, and the losers go on in their lists in another
    round. A seed can be claimed in its own region only.
    """
    count = opened.count()
    regions = -(-count // region)
    where = F.pmod(F.floor(F.col("cell") * F.lit(regions) / F.lit(MOST_CELLS)) + F.pmod(F.xxhash64("seed"), F.lit(-(-count // (region * 8)))), F.lit(regions)).cast("int") if regions > 1 else F.lit(0)
    state = opened.join(lists, "seed", "left").select("seed", "n", "room", "begun", "list", "held", where.alias("region"))
    if regions > 1:
        # seeds of other regions are no items for a container
        seeds = opened.where("not begun").select(F.col("seed").alias("iid"), where.alias("of"))
        strange = state.select("seed", "region", F.explode("list").alias("e")).select("seed", "region", F.col("e.iid").alias("iid")).join(seeds, "iid").where("of <> region").groupBy("seed").agg(F.collect_set("iid").alias("_x"))
        state = state.join(strange, "seed", "left").withColumn("list", F.expr("filter(list, e -> _x is null or not array_contains(_x, e.iid))")).drop("_x")
    turn = 0
    while True:
        state = work.save(state, f"{label}-state-{turn}")
        claims = work.save(state.groupBy("region").applyInArrow(_greedy(capacity), CLAIM), f"{label}-claims-{turn}")
        lost = None
        if regions > 1:
            best = claims.groupBy("item").agg(F.min(F.struct(~F.col("kept"), "d", "seed")).alias("by")).select("item", F.col("by.seed").alias("winner"))
            told = claims.join(best, "item")
            lost = told.where("winner <> seed").groupBy("seed").agg(F.collect_set("item").alias("lost"))
            claims = told.where("winner = seed").drop("winner")
        gone = claims.where("joins").select(F.col("item").alias("seed"))
        won = claims.where("not kept").groupBy("seed").agg(F.collect_list("item").alias("won"), F.sum("n").alias("tokens"))
        after = state.join(gone, "seed", "left_anti").join(won, "seed", "left")
        none = F.array().cast("array<long>")
        after = after.select("seed", "n", (F.col("room") - F.coalesce("tokens", F.lit(0))).alias("room"), F.lit(True).alias("begun"), "list", F.concat("held", F.coalesce("won", none)).alias("held"), "region")
        if lost is None:
            return work.save(after.select("seed", "n", "room", "held"), f"{label}-settled")
        after = after.join(lost, "seed", "left").withColumn("list", F.expr("filter(list, e -> lost is null or not array_contains(lost, e.iid))"))
        after = work.save(after, f"{label}-after-{turn}")
        some = after.agg(F.sum(F.coalesce(F.size("lost"), F.lit(0))).alias("lost"), F.sum(F.size("held")).alias("held")).first()
        if (some["lost"] or 0) <= SETTLED * max(some["held"] or 0, 1):
            return after.select("seed", "n", "room", "held")
        state = after.drop("lost")
        turn += 1


# ---------------------------------------------------------------- gaps
def plan_gaps(rooms: dict[int, int], sizes: dict[int, int], capacity: int, open_new: bool) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """Which items close which gaps, by counts alone: (room, first, stop, fills), fills (size, first item, items each).

    Containers of equal room are numbered, as are items of equal size; container ``first + i`` gets
    the ``each`` items from ``first item + i * each`` on. The largest item that fits is taken
    first. Every step uses up a size or serves all containers of a group, so the plan
    has at most as many groups as there are rooms and sizes. New containers have the room -1.
    """
    left = np.zeros(capacity + 1, np.int64)
    for s, k in sizes.items():
        left[s] += k
    used = np.zeros(capacity + 1, np.int64)
    waiting: dict[int, list] = {}
    for room, k in rooms.items():
        if room > 0 and k:
            waiting.setdefault(room, []).append((room, 0, k, []))
    done, fresh = [], 0
    while True:
        for room in range(capacity, 0, -1):
            groups = waiting.pop(room, [])
            while groups:
                origin, lo, hi, fills = groups.pop()
                fits = np.flatnonzero(left[: room + 1])
                if not len(fits):
                    done.append((origin, lo, hi, fills))
                    continue
                size = int(fits[-1])
                each = min(room // size, int(left[size]) // (hi - lo))
                if not each:
                    some = int(left[size])
                    groups.append((origin, lo + some, hi, [(s, first + some * k, k) for s, first, k in fills]))
                    hi, each = lo + some, 1
                now = (origin, lo, hi, [*fills, (size, int(used[size]), each)])
                used[size] += each * (hi - lo)
                left[size] -= each * (hi - lo)
                if room - each * size:
                    waiting.setdefault(room - each * size, []).append(now)
                else:
                    done.append(now)
        rest = np.flatnonzero(left)
        if not open_new or not len(rest):
            return [x for x in done if x[3]]
        size = int(rest[-1])
        # as many as the tokens left need, opened with the largest texts
        need = min(int(left[size]), int(-(-(left * np.arange(capacity + 1)).sum() // capacity)))
        now = (-1, fresh, fresh + need, [(size, int(used[size]), 1)])
        fresh += need
        used[size] += need
        left[size] -= need
        if size < capacity:
            waiting.setdefault(capacity - size, []).append(now)
        else:
            done.append(now)


def _numbered(rows: DataFrame, spark: SparkSession, by: str, out: str) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` (id, ``by``) numbered from 0 within every value, and how many there are of each; values are at most the capacity."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    found = sorted((r[by], r["_s"], r["count"]) for r in salted.groupBy(by, "_s").count().collect())  # at most SALT rows per value
    total: dict[int, int] = {}
    base = []
    for value, salt, k in found:
        base.append((int(value), salt, total.get(value, 0)))
        total[value] = total.get(value, 0) + k
    start = F.broadcast(spark.createDataFrame(base, f"{by} long, _s int, _b long"))
    numbered = salted.withColumn(by, F.col(by).cast("long")).join(start, [by, "_s"]).withColumn(out, F.row_number().over(Window.partitionBy(by, "_s").orderBy("id")) - 1 + F.col("_b"))
    return numbered.drop("_s", "_b"), total


def _close(spark: SparkSession, work: Workspace, boxes: DataFrame | None, free: DataFrame, capacity: int, open_new: bool, label: str) -> DataFrame:
    """(iid, container): the free items (iid, n) that close the gaps of ``boxes`` (id, room) by size, or open containers of their own."""
    items, sizes = _numbered(free.select(F.col("iid").alias("id"), F.col("n").alias("size")), spark, "size", "number")
    held, rooms = _numbered(boxes.select("id", "room"), spark, "room", "number") if boxes is not None else (None, {})
    plan = plan_gaps(rooms, sizes, capacity, open_new)
    by_room: dict[int, list] = {}
    for origin, lo, hi, fills in plan:
        by_room.setdefault(origin, []).append((lo, hi, fills))
    for rows in by_room.values():
        rows.sort(key=lambda x: x[0])

    def served(batches):
        starts = {room: np.array([x[0] for x in rows]) for room, rows in by_room.items()}
        for batch in batches:
            out = []
            for box, room, number in zip(*(batch.column(c).to_pylist() for c in ("id", "room", "number")), strict=True):
                at = int(np.searchsorted(starts[room], number, "right")) - 1 if room in starts else -1
                if at >= 0 and number < by_room[room][at][1]:
                    lo, _, fills = by_room[room][at]
                    out += [(box, size, first + (number - lo) * each + k) for size, first, each in fills for k in range(each)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), *(pa.array([r[k] for r in out], pa.int64()) for k in (1, 2))], names=["container", "size", "number"])

    todo = []
    if held is not None:
        todo.append(held.select(F.col("id").cast("string").alias("id"), "room", "number"))
    if -1 in by_room:
        fresh = max(x[1] for x in by_room[-1])
        todo.append(spark.range(fresh).select(F.concat(F.lit(f"{label}-new-"), "id").alias("id"), F.lit(-1).cast("long").alias("room"), F.col("id").alias("number")))
    if not todo:
        return spark.createDataFrame([], "iid long, container string")
    rows = todo[0] if len(todo) == 1 else todo[0].unionByName(todo[1])
    got = rows.mapInArrow(served, "container string, size long, number long")
    return work.save(got.join(items, ["size", "number"]).select(F.col("id").alias("iid"), "container"), f"{label}-closed")


# ---------------------------------------------------------------- operator
def _largest(free: DataFrame, need: int) -> DataFrame:
    """The ``need`` largest items."""
    bound = 0
    for r in sorted(free.groupBy("n").count().collect(), key=lambda r: -r["n"]):  # at most one row per size
        bound = r["n"]
        if r["count"] >= need:
            break
        need -= r["count"]
    last = free.where(F.col("n") == bound).orderBy("iid").limit(need)
    return free.where(F.col("n") > bound).unionByName(last)


def _retrieved(spark: SparkSession, work: Workspace, items: DataFrame, stats: Statistics, capacity: int, shard_items: int) -> tuple[DataFrame, DataFrame]:
    """Containers (id, room) filled with neighbours, and the placed items (iid, container), of items (iid, n, steps, tf, near)."""
    boxes = spark.createDataFrame([], "seed long, n long, room long, held array<long>")
    free, whole = items, items.agg(F.sum("n")).first()[0] or 0
    for ask in range(ASKS):
        left = free.agg(F.sum("n").alias("tokens"), F.min("n").alias("least")).first()
        if (left["tokens"] or 0) <= REST * whole:
            break
        usable = boxes.where(F.col("room") >= left["least"]).agg(F.sum("room")).first()[0] or 0
        need = max(0, -(-(left["tokens"] - usable) // capacity))
        cell = F.get("near", F.lit(0)).alias("cell")
        again = boxes.where(F.col("room") >= CLOSE_AT * capacity).join(items.select(F.col("iid").alias("seed"), "steps", "near"), "seed").select("seed", "n", "room", F.lit(True).alias("begun"), "held", "steps", "near", cell)
        fresh = _largest(free, need) if need else free.limit(0)
        fresh = fresh.select(F.col("iid").alias("seed"), "n", (F.lit(capacity) - F.col("n")).alias("room"), F.lit(False).alias("begun"), F.array().cast("array<long>").alias("held"), "steps", "near", cell)
        opened = work.save(fresh.unionByName(again), f"open-{ask}")
        lists = work.save(neighbour_lists(spark, opened.withColumnRenamed("seed", "iid"), free, stats, shard_items), f"lists-{ask}")
        now = _settle(spark, work, opened.drop("steps", "near"), lists, capacity, f"ask-{ask}")
        boxes = work.save(boxes.join(opened.select("seed"), "seed", "left_anti").unionByName(now), f"boxes-{ask}")
        work.drop(f"lists-{ask}", f"free-{ask - 1}", f"boxes-{ask - 1}", f"open-{ask}", f"ask-{ask}-state-0", f"ask-{ask}-claims-0")
        if ask + 1 < ASKS:
            taken = boxes.select(F.explode(F.concat(F.array("seed"), "held")).alias("iid"))
            free = work.save(items.join(taken, "iid", "left_anti"), f"free-{ask}")
    named = boxes.withColumn("container", F.concat(F.lit("b-"), F.col("seed")))
    return named.where("room > 0").select(F.col("container").alias("id"), "room"), named.select("container", F.explode(F.concat(F.array("seed"), "held")).alias("iid")).select("iid", "container")


def pack_texts(spark: SparkSession, documents: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece of every text with its container: (container, doc_id, copy, start_token, n_tokens, fill)."""
    work = Workspace(spark, "packing")
    base = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    # equal ids on several rows are told apart by a number that doesn't depend on partitions
    repeated = base.groupBy("doc_id").count().where("count > 1").select("doc_id").limit(1).count()
    if repeated:
        base = base.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).cast("long"))
    else:
        base = base.withColumn("copy", F.lit(1).cast("long"))
    items = work.save(items_of(base, capacity, tokenizer).withColumn("iid", F.monotonically_increasing_id()), "items")
    full = items.where(F.col("n") == capacity).select("iid", F.concat_ws("-", F.lit("full"), "iid").alias("container"))
    parts = items.where(F.col("n") < capacity)
    stats = Statistics(parts)
    out = full
    if stats.total:
        rest = work.save(_placed(parts, stats, shard_items), "near")
        boxes, placed = _retrieved(spark, work, rest, stats, capacity, shard_items)
        placed = work.save(placed, "placed")
        closed = _close(spark, work, boxes, rest.select("iid", "n").join(placed, "iid", "left_anti"), capacity, True, "gaps")
        placed = work.save(placed.unionByName(closed).join(rest.select("iid", "n"), "iid"), "all")
        # containers left too empty are opened and packed once more by size, if that takes fewer
        short = work.save(placed.groupBy("container").agg(F.sum("n").alias("fill")).where(F.col("fill") < REOPEN_BELOW * capacity), "short")
        poor = short.agg(F.count("*").alias("n"), F.sum("fill").alias("tokens")).first()
        if poor["n"] > -(-(poor["tokens"] or 0) // capacity):
            short = short.select("container")
            again = _close(spark, work, None, placed.join(short, "container", "left_semi").select("iid", "n"), capacity, True, "again")
            if again.select("container").distinct().count() < poor["n"]:
                placed = placed.join(short, "container", "left_anti").select("iid", "container").unionByName(again)
        out = out.unionByName(placed.select("iid", "container"))
    out = out.join(items.select("iid", *KEY, "n"), "iid")
    fill = out.groupBy("container").agg(F.sum("n").alias("fill"))
    return out.join(fill, "container").select("container", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "copy", F.col("start").alias("start_token"), F.col("n").alias("n_tokens"), "fill")
