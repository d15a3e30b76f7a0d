"""Files in and out: documents by a pluggable extractor, JSON, CSV, HTML tables, run records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_KINDS = ("png", "jpg", "jpeg", "tiff", "bmp", "gif", "pdf")


def binary_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of the files of one folder, not of its subfolders."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def extracted_texts(documents: DataFrame, extract: Callable[[str, bytes], str]) -> DataFrame:
    """(path, kind, success, text) by an extractor hook that runs on the executors; its failure gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, fine = batch.column("path").to_pylist(), [], []
            for path, content in zip(paths, batch.column("content").to_pylist(), strict=True):
                try:
                    texts.append(extract(path, content) or "")
                    fine.append(bool(texts[-1]))
                except Exception:  # noqa: BLE001 - one bad file must not end the job
                    texts.append("")
                    fine.append(False)
            kinds = [p.rsplit(".", 1)[-1].lower() for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(kinds), pa.array(fine), pa.array(texts)], names=["path", "kind", "success", "text"])

    return documents.select("path", "content").mapInArrow(run, "path string, kind string, success boolean, text string")


def plain_text(path: str, content: bytes) -> str:
    """The extractor for text files."""
    return content.decode("utf-8", "replace")


def gold_records(spark: SparkSession, path: str) -> DataFrame:
    """Gold records of a JSON file: an object with ``records`` or a bare list."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("records").alias("r")).select("r.*") if "records" in raw.columns else raw


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_review_csv(df: DataFrame, path: str) -> None:
    """Rows for manual review with an empty column ``correct``."""
    df.withColumn("correct", F.lit("")).write.mode("overwrite").option("header", True).csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table as a whole: written beside it first, then moved into place."""
    spark = df.sparkSession
    jvm = spark._jvm
    staging, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (path.rstrip("/") + ".staging", path.rstrip("/")))
    df.write.mode("overwrite").parquet(staging.toString())
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(target, True)
    if not system.rename(staging, target):
        raise OSError(f"could not move {staging} to {target}")


def case_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page, cells): five-cell rows of HTML tables, tags removed."""
    rows = F.regexp_extract_all(html_col, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return pages.select("page", F.explode(rows).alias("r")).select("page", cells(F.col("r")).alias("cells")).where("size(cells) = 5")


def case_metadata(df: DataFrame, id_col: str, text_col: str, preview: int = 500) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.length(text_col).alias("text_length"), F.substring(text_col, 1, preview).alias("text_preview"))


def record_run(spark: SparkSession, path: str, run: str, kind: str, values: dict[str, float]) -> bool:
    """Append a run's figures; a failure is reported, never raised."""
    try:
        rows = [(run, kind, name, float(value)) for name, value in values.items()]
        spark.createDataFrame(rows, "run string, kind string, name string, value double").coalesce(1).write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001 - records must never end a run
        return False
    return True


def safe_source(name: str | None) -> bool:
    """Whether a stored file name may be opened: a plain PDF name without a way out of its folder."""
    return bool(name) and name.lower().endswith(".pdf") and not name.startswith("/") and ".." not in name.split("/")
