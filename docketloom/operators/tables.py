"""Table maintenance: duplicates, insert-ignore, upsert, surrogate keys, retention, fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.functions.text import content_hash


def duplicate_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, n, keeper): contents that occur more than once; null texts are one group."""
    return df.groupBy(content_hash(text_col).alias("hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("keeper")).where("n > 1")


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """One row: number of groups and of rows that could go."""
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removable"))


def keepers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows that stay: the smallest id of every content."""
    low = df.groupBy(content_hash(text_col).alias("_h")).agg(F.min(id_col).alias(id_col))
    return df.join(low.select(id_col), id_col, "left_semi")


def delete_duplicates(df: DataFrame, id_col: str, text_col: str, execute: bool = False) -> DataFrame:
    """The table without its duplicates; without ``execute`` only the ids that would go."""
    kept = keepers(df, id_col, text_col)
    return kept if execute else df.select(id_col).join(kept.select(id_col), id_col, "left_anti")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """New rows whose key neither the table nor an earlier new row has.

    Keys compare as given, so fold nulls with ``coalesce`` first where they should count as equal.
    """
    named = [F.expr(k) if isinstance(k, str) else k for k in keys]
    tags = [f"_k{i}" for i in range(len(named))]
    tagged = new.select("*", *[c.alias(t) for c, t in zip(named, tags, strict=True)])
    first = tagged.withColumn("_r", F.row_number().over(Window.partitionBy(*tags).orderBy(*order))).where("_r = 1")
    known = existing.select(*[c.alias(t) for c, t in zip(named, tags, strict=True)])
    return first.join(known, tags, "left_anti").drop("_r", *tags)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table after the new rows: the last row of a key in input order replaces the old one."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))).where("_r = 1").drop("_r")
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*existing.columns))


def lookup_or_insert(existing: DataFrame, new: DataFrame, key: str, id_col: str, update: list[str]) -> DataFrame:
    """The table with ``update`` columns refreshed by key and unknown keys added under following ids."""
    fresh = new.groupBy(key).agg(*[F.max(c).alias(c) for c in update])
    kept = existing.join(fresh.select(key, *[F.col(c).alias(f"_n_{c}") for c in update]), key, "left")
    for c in update:
        kept = kept.withColumn(c, F.coalesce(f"_n_{c}", c)).drop(f"_n_{c}")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    added = fresh.join(existing.select(key), key, "left_anti").join(F.broadcast(top))  # one row
    added = added.withColumn(id_col, F.col("_top") + F.row_number().over(Window.orderBy(key))).drop("_top")
    return kept.select(*existing.columns).unionByName(added.select(*[F.col(c) if c in (key, id_col, *update) else F.lit(None).alias(c) for c in existing.columns]))


def surrogate_keys(df: DataFrame, order: list[str], id_col: str, start: int = 1) -> DataFrame:
    """Consecutive ids in a deterministic order, by counting partitions and then within them.

    The order is range-partitioned, so no task holds the whole table.
    """
    ordered = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    tagged = ordered.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    size = tagged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    base = size.withColumn("_base", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))  # one row per partition
    return tagged.join(F.broadcast(base), "_p").withColumn(id_col, F.col("_base") + F.col("_m") - F.col("_first") + start).drop("_p", "_m", "_n", "_first", "_base")


def without_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Child rows whose parent still exists: a cascading delete."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def unprocessed(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents without any child row yet."""
    return parent.join(child.select(F.col(child_key).alias(parent_key)).where(F.col(parent_key).isNotNull()), parent_key, "left_anti")


def retained(sessions: DataFrame, now: Column, days: int, keep: str = "default") -> DataFrame:
    """Sessions that outlive a retention of ``days``: the default one and those active since."""
    return sessions.where((F.col("session_id") == keep) | (F.col("last_active") >= now - F.expr(f"interval {days} days")))


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose columns differ, nulls counting as values."""
    both = old.select(key, F.struct(*columns).alias("_o")).join(new.select(key, F.struct(*columns).alias("_n")), key)
    return both.where(~F.col("_o").eqNullSafe(F.col("_n"))).select(key, F.col("_n.*"))


def schema_fingerprint(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def ensure_schema(spark: SparkSession, df: DataFrame, registry: DataFrame | None) -> bool:
    """Whether the registry already knows this table's fingerprint."""
    if registry is None:
        return False
    return registry.where(F.col("sha256") == schema_fingerprint(df)).limit(1).count() > 0


def stratified_sample(df: DataFrame, stratum: str, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """Up to ``size`` rows of every stratum in a seeded hash order, the same on every run."""
    order = F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, id_col))).where(F.col("_r") <= size).drop("_r")
