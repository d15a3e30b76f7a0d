"""Extension: newly delivered documents as a stream, inserted unless known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docketloom.operators.tables import insert_ignore


def document_stream(spark: SparkSession, folder: str, schema: T.StructType, late: str = "1 hour", time_col: str = "ingested_at") -> DataFrame:
    """A file stream with a watermark; within it equal (doc_id, text) are dropped once seen."""
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark(time_col, late)
    return rows.dropDuplicatesWithinWatermark(["doc_id"])


def counts_per_window(stream: DataFrame, width: str = "10 minutes", time_col: str = "ingested_at") -> DataFrame:
    """Documents and characters per source and time window; late rows beyond the watermark are left out."""
    return stream.groupBy(F.window(time_col, width).alias("w"), "source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars")).select("w.start", "w.end", "source", "documents", "chars")


def append_new(stream: DataFrame, table: str, checkpoint: str, keys: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Write each micro-batch's rows whose key the table lacks; a repeated batch adds nothing."""
    names = keys or ["doc_id"]

    def insert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(table).select(*names)
        except Exception:  # noqa: BLE001 - the first batch creates the table
            known = spark.createDataFrame([], batch.select(*names).schema)
        insert_ignore(known, batch, names, [F.col(n) for n in names]).write.mode("append").parquet(table)

    writer = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
