"""Tables that cut lineage, written to the folder all executors share.

Iterative operators write each round's state as a Parquet table instead of
keeping it in executor memory, so a lost executor costs a re-read and not the
whole history of the job.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from docketloom.shipping import ship

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_open: list[Workspace] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where unset (tests), a folder of our own."""
    found = spark.conf.get(CHECKPOINT_SETTING, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="docketloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def _close_all() -> None:
    """At the end of the application delete the tables that its results read from."""
    for work in list(_open):
        try:
            work.close()
        except Exception:  # noqa: BLE001 - the JVM may be gone, then there is nothing left to do
            return


class Workspace:
    """A private subfolder of the shared folder for one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/docketloom/{label}-{uuid.uuid4().hex[:12]}"
        if not _open:
            atexit.register(_close_all)
        _open.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it read back, with its lineage cut."""
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner drop the shuffle files behind tables that are gone."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def close(self) -> None:
        """Delete the whole workspace, once the operator's result has been written."""
        self.drop("")
        if self in _open:
            _open.remove(self)


def spread(spark: SparkSession, least: int = 1) -> int:
    """Number of partitions for compute-heavy stages: shuffle partitions or two per core."""
    cores = spark.sparkContext.defaultParallelism
    return max(least, 2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
