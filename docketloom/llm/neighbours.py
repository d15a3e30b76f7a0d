"""Problem 1: the k most similar vectors of every vector, by NN-descent.

The neighbour graph starts from the exact neighbours inside overlapping cells
(every vector lies in its nearest cell, and in the second nearest if that is about as near) and is then improved by rounds of
Spark joins: a node meets the neighbours of its neighbours, pairs that were
never compared are compared exactly, and the lists keep the best. Rounds end
when fewer than ``delta`` of all list entries change. New vectors are looked
up with :func:`search`, a greedy best-first walk over the graph.

Defined results
* null, empty, zero-length and non-finite vectors, and vectors whose dimension
  isn't the table's most frequent one, have no neighbours and are nobody's;
* an id delivered several times counts once, with its latest vector;
* equal vectors form one class, so copies cost nothing and rank by id;
* equal cosines (to 9 decimals) go to the smaller id; extra columns are ignored;
* an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.workspace import Workspace, spread

DECIMALS = 9
SAMPLE_ROWS = 16_384
LEAF_ROWS = 1_000
MOST_CELLS = 2_048
CELL_CAP = 16_384
COPIES = 64
MARGIN = 0.04
SALT = 64
BUCKETS = 1 << 20

ENTRY = "struct<cos:double,id:bigint,c1:int,c2:int>"
GRAPH = f"u long, c1 int, c2 int, near array<{ENTRY}>"
LISTS = pa.list_(pa.struct([("cos", pa.float64()), ("id", pa.int64()), ("c1", pa.int32()), ("c2", pa.int32())]))


# ---------------------------------------------------------------- encoding
def pack(vector: np.ndarray) -> bytes:
    """A float32 vector as bytes: half precision if that loses nothing, planes split, compressed."""
    import zstandard

    with np.errstate(over="ignore"):
        half = vector.astype(np.float16)
    lossless = bool((half.astype(np.float32) == vector).all())
    raw = half if lossless else vector.astype(np.float32)
    width = raw.dtype.itemsize
    planes = raw.view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blobs: list[bytes]) -> np.ndarray:
    """The packed vectors as rows of one float32 matrix."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    rows = []
    for blob in blobs:
        width = blob[0]
        planes = np.frombuffer(plain.decompress(blob[1:]), np.uint8).reshape(width, -1)
        rows.append(np.ascontiguousarray(planes.T).view(np.float16 if width == 2 else np.float32).ravel().astype(np.float32))
    return np.stack(rows) if rows else np.zeros((0, 0), np.float32)


def unit(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _halves(batches):
    """Unit vectors in half precision, as bytes; unusable ones are left out."""
    for batch in batches:
        out = []
        for value in batch.column("v"):
            vector = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float32)
            length = np.sqrt(np.dot(vector.astype(np.float64), vector))
            if np.isfinite(length) and length > 0:
                out.append((vector / length).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["h"])


def grow_cells(sample: np.ndarray, leaf: int, most: int, seed: int = 7) -> np.ndarray:
    """Centroids of a bisecting 2-means tree over unit vectors, dense regions split further."""
    rng = np.random.default_rng(seed)
    done, open_ = [], [np.arange(len(sample))]
    while open_:
        open_.sort(key=len)
        rows = open_.pop()
        if len(rows) <= leaf or len(done) + len(open_) + 1 >= most:
            done.append(rows)
            continue
        part = sample[rows]
        two = part[rng.choice(len(rows), 2, replace=False)].copy()
        side = None
        for _ in range(5):
            side = part @ (two[0] - two[1]) > 0
            if side.all() or not side.any():
                break
            for k, mask in ((0, side), (1, ~side)):
                mean = part[mask].sum(0)
                two[k] = mean / max(np.linalg.norm(mean), 1e-12)
        if side is None or not 0.05 < side.mean() < 0.95:
            along = part @ (two[0] - two[1])
            side = along > np.median(along)
        if side.all() or not side.any():
            done.append(rows)
        else:
            open_ += [rows[side], rows[~side]]
    centres = np.stack([sample[rows].mean(0) for rows in done])
    return (centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]).astype(np.float32)


def _usable(df: DataFrame, id_col: str, vec_col: str, order_col: str | None) -> DataFrame:
    when = F.col(order_col).cast("timestamp") if order_col else F.lit(None).cast("timestamp")
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"), when.alias("at"))
    return out.where("id is not null and v is not null and size(v) > 0")


def encode(spark: SparkSession, df: DataFrame, id_col: str, vec_col: str, order_col: str | None, work: Workspace, leaf: int, name: str = "enc") -> tuple[DataFrame, int, dict]:
    """The table (id, vh, vec, c1, c2): class hash, packed vector and the two nearest cells."""
    rows = _usable(df, id_col, vec_col, order_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        empty = spark.createDataFrame([], "id long, at timestamp, vh binary, vec binary, c1 int, c2 int")
        return empty, 0, {"centres": np.zeros((0, 0), np.float32)}
    dim, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dim)
    share = min(1.0, SAMPLE_ROWS / total)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = picked.select("v").limit(2 * SAMPLE_ROWS).mapInArrow(_halves, "h binary").toArrow().column("h").to_pylist()
    matrix = np.frombuffer(b"".join(sample), np.float16).reshape(-1, dim).astype(np.float32)
    del sample
    if len(matrix):
        centres = grow_cells(matrix, max(8, int(leaf * share)), min(MOST_CELLS, total // leaf + 1))
    else:
        centres = np.ones((1, dim), np.float32)
    wire = centres.astype(np.float16)

    def run(batches):
        import xxhash

        heart = wire.astype(np.float32)
        for batch in (b.slice(lo, 2048) for b in batches for lo in range(0, b.num_rows, 2048)):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
            length = np.sqrt(np.einsum("ij,ij->i", flat, flat, dtype=np.float64))
            good = np.isfinite(length) & (length > 0)
            keep = np.flatnonzero(good)
            flat, ids = flat[keep] + np.float32(0), ids[keep]
            if not len(ids):
                continue
            near = (flat / length[keep][:, None].astype(np.float32)) @ heart.T
            first = near.argmax(1).astype(np.int32)
            second = first
            if near.shape[1] > 1:
                at = np.arange(len(near))
                top = near[at, first].copy()
                near[at, first] = -9
                other = near.argmax(1).astype(np.int32)
                second = np.where(near[at, other] >= top - MARGIN, other, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), batch.column("at").take(pa.array(keep)), pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in flat], pa.binary()), pa.array([pack(v) for v in flat], pa.binary()), pa.array(first), pa.array(second)],
                names=["id", "at", "vh", "vec", "c1", "c2"],
            )

    done = rows.mapInArrow(run, "id long, at timestamp, vh binary, vec binary, c1 int, c2 int")
    return work.save(done, name), dim, {"centres": centres}


def _latest(enc: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Ids with their class, and the encoded rows without superseded deliveries."""
    ids = enc.groupBy("id").agg(F.max_by("vh", F.struct("at", "vh")).alias("vh"), F.count_distinct("vh").alias("versions"))
    ids = work.save(ids, "ids")
    if ids.where("versions > 1").limit(1).count():
        # only ids with several different vectors need the comparison
        stale = enc.select("id", "vh").distinct().join(ids.where("versions > 1").select("id", F.col("vh").alias("now")), "id").where("vh <> now").select("id", "vh")
        enc = work.save(enc.join(stale, ["id", "vh"], "left_anti"), "enc-latest")
    return ids.select("id", "vh"), enc


# ---------------------------------------------------------------- graph
def _leave_copies(enc: DataFrame) -> DataFrame:
    """The table without the rows of much-copied vectors that don't hold the class's smallest id."""
    # at most one class per COPIES rows of the table
    hot = enc.groupBy("vh").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") > COPIES).select("vh", "first")
    return enc.join(F.broadcast(hot), "vh", "left").where("first is null or first = id").drop("first")


def _blocks(member: DataFrame, split: dict[int, int]) -> DataFrame:
    """Every row once for every pair (a, b) of parts of its cell that holds its own part.

    A cell beyond the cap has parts by class hash; as every part meets every
    other, all pairs of the cell are compared, each in exactly one block.
    """
    if not split:
        return member.select("*", *(F.lit(0).alias(c) for c in ("part", "a", "b")))
    parts = F.coalesce(F.element_at(F.create_map(*[x for k, v in split.items() for x in (F.lit(k), F.lit(v))]), F.col("cell")), F.lit(1))
    member = member.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vh"), F.col("parts")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return member.withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other")).drop("parts", "other")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape).copy()
    return part


def _inside_cells(enc: DataFrame, spark: SparkSession, keep: int) -> tuple[DataFrame, list[int]]:
    """Exact neighbour lists inside every cell, best first, and the cells beyond the cap.

    Nodes of two cells have two lists, those of a cell beyond the cap one per block.
    """
    enc = _leave_copies(enc)
    cells = F.explode(F.array_distinct(F.array("c1", "c2"))).alias("cell")
    counts = enc.select(cells).groupBy("cell").count().where(F.col("count") > CELL_CAP).collect()
    split = {r["cell"]: -(-2 * r["count"] // CELL_CAP) for r in counts}  # at most MOST_CELLS entries; two parts make a block
    member = _blocks(enc.select("id", "vh", "vec", "c1", "c2", cells), split)

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        seen: dict[bytes, int] = {}
        hashes = table.column("vh").to_pylist()
        for i in order:
            seen.setdefault(hashes[i], i)
        rows = np.fromiter(seen.values(), np.int64, len(seen))
        rows = rows[np.argsort(ids[rows], kind="stable")]
        ids = ids[rows]
        blobs = table.column("vec")
        raw = unpack([blobs[int(i)].as_py() for i in rows])
        length = np.sqrt(np.einsum("ij,ij->i", raw, raw, dtype=np.float64))
        quick = raw / length[:, None].astype(np.float32)
        c1, c2 = table.column("c1").to_numpy()[rows], table.column("c2").to_numpy()[rows]
        parts = table.column("part").to_numpy()[rows]
        sides = [np.flatnonzero(parts == x) for x in np.unique(parts)]
        crossed = table.column("a")[0].as_py() != table.column("b")[0].as_py()
        if crossed and len(sides) < 2:
            return pa.table({"u": ids[:0], "c1": c1[:0], "c2": c2[:0], "near": pa.array([], LISTS)})
        out = []
        for asked, held in [(sides[0], sides[1]), (sides[1], sides[0])] if crossed else [(sides[0], sides[0])]:
            k = min(keep, len(held) - (not crossed))
            facing = quick[held] if crossed else quick
            own, cos, who = [], [], []
            for lo in range(0, len(asked) if k else 0, 512):
                part = asked[lo : lo + 512]
                scores = quick[part] @ facing.T
                if not crossed:
                    scores[np.arange(len(part)), np.arange(lo, lo + len(part))] = -9
                best = held[_best(scores, k)]
                dots = np.stack([raw[best[i]].astype(np.float64) @ raw[p].astype(np.float64) for i, p in enumerate(part)])
                dots = np.round(dots / length[best] / length[part][:, None], DECIMALS)
                order = np.lexsort((ids[best], -dots), axis=1)
                own.append(part)
                who.append(np.take_along_axis(best, order, 1))
                cos.append(np.take_along_axis(dots, order, 1))
            if not own:
                own, who, cos = [asked], [np.zeros((len(asked), 0), int)], [np.zeros((len(asked), 0))]
            at, near, value = np.concatenate(own), np.concatenate(who), np.concatenate(cos)
            flat = near.ravel()
            entry = pa.StructArray.from_arrays([pa.array(value.ravel()), pa.array(ids[flat]), pa.array(c1[flat]), pa.array(c2[flat])], names=["cos", "id", "c1", "c2"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * near.shape[1], pa.int32()), entry)
            out.append(pa.table({"u": pa.array(ids[at]), "c1": pa.array(c1[at]), "c2": pa.array(c2[at]), "near": lists}))
        return pa.concat_tables(out)

    key = ["cell", "a", "b"] if split else ["cell"]
    return member.repartition(spread(spark), *key).groupBy(*key).applyInArrow(run, GRAPH), list(split)


def _merge(lists: DataFrame, keep: int) -> DataFrame:
    """One list per node out of several partial ones: best first, each neighbour once."""
    both = lists.groupBy("u").agg(F.max("c1").alias("c1"), F.max("c2").alias("c2"), F.flatten(F.collect_list("near")).alias("near"))
    ranked = F.expr("array_sort(near, (a, b) -> case when a.cos > b.cos then -1 when a.cos < b.cos then 1 when a.id < b.id then -1 when a.id > b.id then 1 else 0 end)")
    # copies of an entry have the same cosine up to its last digit, so they stand next to each other
    once = F.expr("filter(near, (x, i) -> i = 0 or (near[i - 1].id <> x.id and (i = 1 or near[i - 2].id <> x.id)))")
    return both.withColumn("near", ranked).withColumn("near", once).withColumn("near", F.slice("near", 1, keep))


def _top_per(df: DataFrame, key: str, order: list[Column], limit: int, salt: Column) -> DataFrame:
    """The first ``limit`` rows of every key, first within salted parts so that a hot key is spread."""
    inner = Window.partitionBy(key, "_s").orderBy(*order)
    outer = Window.partitionBy(key).orderBy(*order)
    part = df.withColumn("_s", salt).withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= limit)
    return part.withColumn("_r", F.row_number().over(outer)).where(F.col("_r") <= limit).drop("_s", "_r")


def _meetings(graph: DataFrame, k: int) -> DataFrame:
    """Pairs (u, w), w a neighbour of a neighbour of u, that no cell and no list has compared yet.

    Forward and reverse neighbours of u are its hop; a reverse list keeps the
    k best, as NN-descent's sampled reverse neighbours do.
    """
    top = graph.select("u", "c1", "c2", F.slice("near", 1, k).alias("near"))
    edge = top.select("u", "c1", "c2", F.explode("near").alias("e")).select("u", "c1", "c2", F.col("e.id").alias("v"), F.col("e.cos").alias("cos"), F.col("e.c1").alias("v1"), F.col("e.c2").alias("v2"))
    back = edge.select(F.col("v").alias("u"), F.col("v1").alias("c1"), F.col("v2").alias("c2"), F.col("u").alias("v"), "cos")
    back = _top_per(back, "u", [F.desc("cos"), F.col("v")], k, F.pmod(F.xxhash64("v"), F.lit(SALT)))
    hop = edge.select("u", "c1", "c2", "v").unionByName(back.select("u", "c1", "c2", "v"))
    met = hop.join(top.select(F.col("u").alias("v"), "near"), "v")
    fresh = F.filter("near", lambda x: (x["c1"] != F.col("c1")) & (x["c1"] != F.col("c2")) & (x["c2"] != F.col("c1")) & (x["c2"] != F.col("c2")) & (x["id"] != F.col("u")))
    pair = met.select("u", F.explode(F.transform(fresh, lambda x: x["id"])).alias("w"))
    pair = pair.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct()
    return pair


def _compare(pairs: DataFrame, enc: DataFrame, spark: SparkSession) -> DataFrame:
    """Exact cosine of pairs of nodes."""
    need = pairs.select(F.explode(F.array("u", "w")).alias("id")).distinct()
    # most vectors aren't needed: a table of at most BUCKETS hash buckets keeps them out of the shuffle
    bucket = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(BUCKETS)).alias("b")
    some = F.broadcast(need.select(bucket).distinct())
    vec = enc.withColumn("b", bucket).join(some, "b", "left_semi").drop("b").join(need, "id", "left_semi").groupBy("id").agg(F.first("vec").alias("vec"), F.first("c1").alias("c1"), F.first("c2").alias("c2"))
    left = vec.select(F.col("id").alias("u"), F.col("vec").alias("vu"), F.col("c1").alias("u1"), F.col("c2").alias("u2"))
    right = vec.select(F.col("id").alias("w"), F.col("vec").alias("vw"), F.col("c1").alias("w1"), F.col("c2").alias("w2"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = np.empty(batch.num_rows)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cos[lo : lo + part.num_rows] = np.einsum("ij,ij->i", unit(unpack(part.column("vu").to_pylist())), unit(unpack(part.column("vw").to_pylist())))
            keep = [batch.column(c) for c in ("u", "u1", "u2", "w", "w1", "w2")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.round(cos, DECIMALS))], names=["u", "u1", "u2", "w", "w1", "w2", "cos"])

    both = pairs.join(left, "u").join(right, "w")
    return both.mapInArrow(run, "u long, u1 int, u2 int, w long, w1 int, w2 int, cos double")


def neighbour_graph(spark: SparkSession, enc: DataFrame, work: Workspace, k: int = 10, slack: int = 6, delta: float = 0.002, max_rounds: int = 8) -> DataFrame:
    """NN-descent over the encoded table: (u, c1, c2, near), near best first, k + slack long."""
    keep = k + slack
    lists, split = _inside_cells(enc, spark, keep)
    lists = work.save(lists, "lists")
    whole = (F.col("c1") == F.col("c2")) & ~F.col("c1").isin(split)  # these have one list
    graph = work.save(lists.where(whole).unionByName(_merge(lists.where(~whole), keep)), "graph-0")
    work.drop("lists")
    nodes = graph.count()
    for turn in range(1, max_rounds + 1):
        known = graph.select("u", F.transform("near", lambda x: x["id"]).alias("known"), F.when(F.size("near") >= keep, F.element_at("near", -1)["cos"]).otherwise(-2.0).alias("worst"))
        pairs = work.save(_meetings(graph, k), f"pairs-{turn}")
        if not pairs.limit(1).count():
            work.drop(f"pairs-{turn}")
            break
        seen = f"seen-{turn}"
        scored = work.save(_compare(pairs, enc, spark), seen)
        entry = lambda w, c, a, b: F.struct(F.col(c).alias("cos"), F.col(w).alias("id"), F.col(a).alias("c1"), F.col(b).alias("c2"))
        offers = scored.select("u", F.col("u1").alias("c1"), F.col("u2").alias("c2"), entry("w", "cos", "w1", "w2").alias("e")).unionByName(scored.select(F.col("w").alias("u"), F.col("w1").alias("c1"), F.col("w2").alias("c2"), entry("u", "cos", "u1", "u2").alias("e")))
        offers = offers.join(known, "u").where((F.col("e.cos") > F.col("worst")) & ~F.array_contains("known", F.col("e.id"))).select("u", "c1", "c2", F.array("e").alias("near"))
        offers = work.save(offers, f"offers-{turn}")
        changed = offers.count()
        if changed:
            graph = work.save(_merge(graph.unionByName(offers), keep), f"graph-{turn}")
            work.drop(f"graph-{turn - 1}")
        work.drop(f"pairs-{turn}", seen, f"offers-{turn}")
        if changed <= delta * nodes * k:
            break
    return graph


# ---------------------------------------------------------------- operator
def most_similar(spark: SparkSession, df: DataFrame, id_col: str, vec_col: str = "embedding", order_col: str | None = None, k: int = 10, leaf: int = LEAF_ROWS, delta: float = 0.002, max_rounds: int = 8) -> DataFrame:
    """For every id its k most similar others: (id, rank, neighbour, cosine)."""
    work = Workspace(spark, "neighbours")
    enc, dim, _ = encode(spark, df, id_col, vec_col, order_col, work, leaf)
    if not dim:
        return spark.createDataFrame([], "id long, rank int, neighbour long, cosine double")
    ids, enc = _latest(enc, work)
    graph = neighbour_graph(spark, enc, work, k, delta=delta, max_rounds=max_rounds)
    del enc
    work.drop("enc", "enc-latest")  # the vectors aren't needed to name the neighbours
    return expand(graph, ids, k)


def expand(graph: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """From classes of equal vectors back to ids; a class needs only its k + 1 smallest ids."""
    few = _top_per(ids, "vh", [F.col("id")], k + 1, F.pmod(F.xxhash64("id"), F.lit(SALT)))
    klass = few.groupBy("vh").agg(F.array_sort(F.collect_list("id")).alias("members")).withColumn("u", F.element_at("members", 1))
    lists = graph.select("u", F.explode(F.expr(f"array_append(slice(near, 1, {k}), named_struct('cos', 1.0D, 'id', u, 'c1', 0, 'c2', 0))")).alias("e"))
    lists = lists.select("u", F.col("e.cos").alias("cos"), F.col("e.id").alias("v"))
    spread_out = lists.join(klass.select(F.col("u").alias("v"), "members"), "v").select("u", F.transform("members", lambda m: F.struct((-F.col("cos")).alias("d"), m.alias("id"))).alias("some"))
    ranked = spread_out.groupBy("u").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k + 1).alias("best"))
    per_class = klass.select("u", "vh").join(ranked, "u").select("vh", "best")
    own = ids.join(per_class, "vh").select("id", F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return own.select("id", F.posexplode("best").alias("pos", "e")).select("id", (F.col("pos") + 1).alias("rank"), F.col("e.id").alias("neighbour"), (-F.col("e.d")).alias("cosine"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs of which at least one has the other in its list."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
