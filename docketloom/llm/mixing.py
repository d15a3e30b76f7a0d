"""Problem 7: mix sources to target shares of the tokens, by Poisson replication.

Every document draws its number of copies from a Poisson distribution cut at
its source's ``max_repeats``, inverted at a uniform number that is a hash of the
document's id and the seed, so a draw never depends on partitions or retries.
The rate of every source is first solved for the wanted mean and then adjusted
on the corpus so that the drawn tokens, not only the expected ones, meet the
target. Copies are exploded and shuffled globally by a second hash.

Defined results
* a source without a target, and a null source, has share 0: no rows;
* a target without documents or of share 0 or less reaches 0; null caps count 1;
* null and empty texts hold no tokens and are never copied;
* a repeated target row counts once (the largest share); the shares needn't sum to 1: they are
  divided by the sum over the sources that have tokens;
* without ``total_tokens`` the mixture is the largest in which every share fits its cap;
* extra columns are ignored, an empty table gives an empty mixture.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.llm.tokens import TOKENIZER, with_token_count
from docketloom.workspace import Workspace, spread

GRID = 24
TARGET_LIMIT = 10_000


def cut_poisson(rate: float, cap: int) -> list[float]:
    """Cumulative probabilities of min(Poisson(rate), cap), for 0 .. cap - 1 copies."""
    if rate == math.inf:
        return [0.0] * cap
    mass, total, out = math.exp(-rate), 0.0, []
    for k in range(cap):
        total += mass
        out.append(min(1.0, total))
        mass *= rate / (k + 1)
    return out


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate at which the copies, cut at ``cap``, have the given mean."""
    if mean <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    low, high = 0.0, 1.0
    value = lambda rate: sum(1 - p for p in cut_poisson(rate, cap))
    while value(high) < mean and high < 600:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < mean else (low, middle)
    return high


def _uniform(seed: int) -> Column:
    return (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def plan_rates(rows: DataFrame, targets: list[dict], seed: int, total_tokens: int | None = None) -> tuple[dict[str, list[float]], float]:
    """Cumulative probabilities per source, adjusted on the corpus, and the mixture's size."""
    size = {r["source"]: r["t"] for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t")).join(rows.sparkSession.createDataFrame([(t["source"],) for t in targets], "source string"), "source", "left_semi").collect()}
    live = [t for t in targets if size.get(t["source"], 0) > 0 and t["share"] > 0 and t["cap"] > 0]
    if not live:
        return {}, 0.0
    whole = sum(t["share"] for t in live)
    for t in live:
        t["want"] = t["share"] / whole
    total = total_tokens or min(t["cap"] * size[t["source"]] / t["want"] for t in live)
    goal = {t["source"]: min(t["want"] * total, t["cap"] * size[t["source"]]) for t in live}
    cap = {t["source"]: t["cap"] for t in live}
    rate = {s: rate_for(goal[s] / size[s], cap[s]) for s in goal}
    span = 0.5
    drawn = rows.withColumn("_u", _uniform(seed))
    for _ in range(3):  # each pass narrows the bracket of every source's rate by GRID
        tries = {s: [r if r == math.inf else r * (1 - span + 2 * span * i / GRID) for i in range(GRID + 1)] for s, r in rate.items()}
        steps = {s: [cut_poisson(r, cap[s]) for r in tries[s]] for s in tries}

        def run(batches, steps=steps):
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                source, u, n = np.array(batch.column("source").to_pylist(), object), batch.column("_u").to_numpy(), batch.column("n_tokens").to_numpy()
                for s in set(source):
                    mine = source == s
                    sums = np.array([int((np.searchsorted(p, u[mine], "right") * n[mine]).sum()) for p in steps[s]])
                    total[s] = total.get(s, 0) + sums
            yield pa.RecordBatch.from_arrays([pa.array([s for s in total for _ in range(GRID + 1)], pa.string()), pa.array(list(range(GRID + 1)) * len(total), pa.int32()), pa.array([int(x) for v in total.values() for x in v], pa.int64())], names=["source", "i", "t"])

        sums = drawn.where(F.col("source").isin(*tries)).select("source", "_u", "n_tokens").mapInArrow(run, "source string, i int, t long").groupBy("source", "i").agg(F.sum("t").alias("t"))
        reached: dict[str, dict[int, int]] = {}
        for r in sums.collect():  # GRID + 1 rows per target source
            reached.setdefault(r["source"], {})[r["i"]] = r["t"]
        for s in rate:
            best = min(range(GRID + 1), key=lambda i: (abs(reached[s][i] - goal[s]), abs(i - GRID / 2)))
            rate[s] = tries[s][best]
        span = 1.5 * span / GRID
    return {s: cut_poisson(rate[s], cap[s]) for s in rate}, float(total)


def _targets(df: DataFrame) -> list[dict]:
    rows = df.where("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")).orderBy("source").limit(TARGET_LIMIT + 1).collect()
    if len(rows) > TARGET_LIMIT:
        raise ValueError(f"more than {TARGET_LIMIT} target sources")
    return [{"source": r["source"], "share": float(r["share"]), "cap": int(r["cap"])} for r in rows]


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, seed: int = 42, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mixture in training order: (mix_key, doc_id, copy, source, n_tokens, text)."""
    work = Workspace(spark, "mix")
    goals = _targets(targets)
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    counted = work.save(with_token_count(base.where(F.col("source").isin(*[g["source"] for g in goals]) if goals else F.lit(False)), "text", path=tokenizer), "counted")
    steps, _ = plan_rates(counted.select("doc_id", "source", "n_tokens"), goals, seed, total_tokens)
    # one row per target source, TARGET_LIMIT at most: the inverse of its distribution
    table = spark.createDataFrame([(s, [float(p) for p in steps[s]]) for s in steps], "source string, steps array<double>")
    drawn = counted.withColumn("_u", _uniform(seed)).join(F.broadcast(table), "source").withColumn("_n", F.size(F.filter("steps", lambda p: F.col("_u") >= p))).where("_n > 0 and n_tokens > 0")
    copies = drawn.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"), "source", "n_tokens", "text")
    keyed = copies.select(F.xxhash64("doc_id", "copy", F.lit(seed + 1)).alias("mix_key"), "*")
    return keyed.repartitionByRange(spread(spark), "mix_key").sortWithinPartitions("mix_key", "doc_id", "copy")


def shares(mixture: DataFrame, documents_tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens and share reached, the share wanted, and times used over."""
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    have = documents_tokens.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = goal.join(got, "source", "left").join(have, "source", "left").fillna(0, ["tokens", "size"])
    total = both.agg(F.sum("tokens").alias("all"))
    out = both.join(F.broadcast(total))  # one row
    return out.select("source", "target_share", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(0.0).alias("reached_share"), "tokens", "max_repeats", F.when(F.col("size") > 0, F.col("tokens") / F.col("size")).otherwise(0.0).alias("repeats"))
