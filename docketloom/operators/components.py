"""Connected components of an undirected edge table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.workspace import Workspace


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id in it.

    Alternating large-star and small-star rounds: every round sends each node's
    neighbours to the smallest of them, so long chains shrink exponentially and
    no task ever holds more than a window over one node's neighbours, which
    streams. State is cut to a table each round. Null ends and self loops are
    ignored; an empty edge table gives no rows.
    """
    work = Workspace(spark, "components")
    pair = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    now = work.save(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "e0")

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        met = both.join(low, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    sign = None
    for turn in count(1):  # the number of rounds grows with the logarithm of the longest chain
        nxt = work.save(star(star(now, True), False), f"e{turn}")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"e{turn - 1}")
        now = nxt
        if mark == sign:
            break
        sign = mark
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
