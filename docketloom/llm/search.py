"""Queries on the neighbour graph: a greedy best-first walk as Spark joins.

Every query enters at members of its nearest cells and keeps a beam of the best
nodes met; each round it visits the neighbours of the beam's unvisited nodes. It
ends when no beam changes. The state of a query is its beam, never more than
``beam`` nodes. Queries are taken in blocks of at most ``BLOCK``, whose vectors are broadcast; a
node visited by many queries of a block is met with its vector once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.llm import neighbours
from docketloom.workspace import Workspace

ENTRIES = 32
REVERSE = 16
BLOCK = 8_192


def greedy_search(spark: SparkSession, queries: DataFrame, df: DataFrame, id_col: str, vec_col: str = "embedding", order_col: str | None = None, k: int = 10, beam: int = 48, max_rounds: int = 12) -> DataFrame:
    """(query_id, id, rank, cosine): the k nearest rows of every query vector, itself included where it is a row.

    Unusable query vectors get no rows; equal cosines go to the smaller id; copies of a vector are found as their smallest id.
    """
    work = Workspace(spark, "search")
    enc, dim, fit = neighbours.encode(spark, df, id_col, vec_col, order_col, work, neighbours.LEAF_ROWS)
    empty = spark.createDataFrame([], "query_id long, id long, rank int, cosine double")
    if not dim:
        return empty
    _, enc = neighbours._latest(enc, work)
    graph = neighbours.neighbour_graph(spark, enc, work)
    nodes = enc.join(graph.select(F.col("u").alias("id")), "id", "left_semi").groupBy("id").agg(F.first("vec").alias("vec"), F.first("c1").alias("c1"))
    nodes = work.save(nodes, "nodes")
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.size("v") == dim)
    wire = fit["centres"].astype(np.float16)

    def encode(batches):
        heart = wire.astype(np.float32)
        for batch in batches:
            ids, blobs, cells = [], [], []
            for key, value in zip(batch.column("query_id").to_pylist(), batch.column("v"), strict=True):
                v = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float32)
                size = float(np.sqrt(np.dot(v.astype(np.float64), v)))
                if np.isfinite(size) and size > 0:
                    ids.append(key)
                    blobs.append(neighbours.pack(v))
                    cells.append(np.argsort(-(heart @ (v / size)), kind="stable")[:3].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], names=["query_id", "vq", "cells"])

    q = work.save(asked.mapInArrow(encode, "query_id long, vq binary, cells array<int>"), "queries")
    doors = nodes.select("c1", "id").withColumn("_r", F.row_number().over(Window.partitionBy("c1").orderBy(F.xxhash64("id"), "id"))).where(F.col("_r") <= ENTRIES)
    seed = q.select("query_id", F.explode("cells").alias("c1")).join(doors, "c1").select("query_id", "id").distinct()
    forth = graph.select(F.col("u").alias("at"), F.explode("near").alias("e")).select("at", F.col("e.id").alias("to"), F.col("e.cos").alias("cos"))
    back = neighbours._top_per(forth.select(F.col("to").alias("at"), F.col("at").alias("to"), "cos"), "at", [F.desc("cos"), F.col("to")], REVERSE, F.pmod(F.xxhash64("to"), F.lit(neighbours.SALT)))
    links = forth.unionByName(back).groupBy("at").agg(F.collect_set("to").alias("to"))
    links = work.save(links, "links")
    work.drop("enc", "enc-latest")  # the nodes have the vectors

    total = q.count()
    blocks = max(1, -(-total // BLOCK))
    numbered = q.withColumn("_b", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)))
    parts = [_walk(spark, work, numbered.where(F.col("_b") == b).drop("_b"), seed, links, nodes, k, beam, max_rounds, f"b{b}") for b in range(blocks)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _walk(spark: SparkSession, work: Workspace, q: DataFrame, seed: DataFrame, links: DataFrame, nodes: DataFrame, k: int, beam: int, max_rounds: int, label: str) -> DataFrame:
    """The search of one block of queries (query_id, vq)."""
    rows = q.select("query_id", "vq").toArrow()  # one block: about BLOCK vectors
    names = rows.column("query_id").to_pylist()
    told = spark.sparkContext.broadcast((dict(zip(names, range(len(names)), strict=True)), rows.column("vq").to_pylist()))
    mine = seed.join(q.select("query_id"), "query_id", "left_semi")

    def measure(pairs: DataFrame) -> DataFrame:
        met = pairs.groupBy("id").agg(F.collect_list("query_id").alias("queries")).join(nodes.select("id", "vec"), "id")

        def run(batches):
            place, blobs = told.value
            asked = neighbours.unit(neighbours.unpack(blobs)) if blobs else None
            for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
                if not batch.num_rows:
                    continue
                vectors = neighbours.unit(neighbours.unpack(batch.column("vec").to_pylist()))
                many = batch.column("queries").to_pylist()
                who = np.fromiter((x for some in many for x in some), np.int64)
                at = np.repeat(np.arange(len(many)), [len(x) for x in many])
                rows = np.fromiter((place[x] for x in who.tolist()), np.int64, len(who))
                cos = np.empty(len(who))
                for lo in range(0, len(who), 4_096):
                    cos[lo : lo + 4_096] = np.einsum("ij,ij->i", asked[rows[lo : lo + 4_096]], vectors[at[lo : lo + 4_096]])
                ids = batch.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[at]), pa.array(np.round(cos, neighbours.DECIMALS))], names=["query_id", "id", "cosine"])

        return met.select("id", "queries", "vec").mapInArrow(run, "query_id long, id long, cosine double")

    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    state = work.save(measure(mine).withColumn("fresh", F.lit(True)), f"{label}-s0")
    state = state.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= beam).drop("_r")
    for turn in range(1, max_rounds + 1):
        state = work.save(state, f"{label}-b{turn}")
        work.drop(f"{label}-s0", f"{label}-b{turn - 1}", f"{label}-m{turn - 1}")
        front = state.where("fresh").join(links, F.col("id") == F.col("at")).select("query_id", F.explode("to").alias("id")).distinct()
        new = front.join(state, ["query_id", "id"], "left_anti")
        met = work.save(measure(new).withColumn("fresh", F.lit(True)), f"{label}-m{turn}")
        floor = state.groupBy("query_id").agg(F.min("cosine").alias("floor"), F.count("*").alias("held"))
        if not met.join(floor, "query_id").where((F.col("held") < beam) | (F.col("cosine") > F.col("floor"))).limit(1).count():
            break
        merged = state.withColumn("fresh", F.lit(False)).unionByName(met)
        state = merged.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= beam).drop("_r")
    return state.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "rank", "cosine")
