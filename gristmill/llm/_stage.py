"""Tables written between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset in a local session, a folder of this run."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh(taken, name: str) -> str:
    """`name`, with underscores before it until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def partitions(df: DataFrame, each: int = 256 << 20) -> int:
    """How many partitions df's rows need by the planner's estimate of their bytes; at least spark.sql.shuffle.partitions."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    fewest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(fewest, min(size // each + 1, 1_000_000)) if size < 1 << 60 else fewest


class Scratch:
    """Writes tables once and reads them again, so that lineage is cut and a lost executor costs no step twice."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        _left.append((spark, self.root))

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path, began = f"{self.root}/{self.n:03d}-{name}", time.time()
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        del df  # else its shuffle files stay for one step more
        if time.time() - began > 2:  # a shorter step has no shuffle files to speak of; the next longer one frees them too
            free(self.spark)
        return self.spark.read.schema(schema).parquet(path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def drop(self, df: DataFrame) -> None:
        """Removes a kept table that no later step reads."""
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(self.spark, f)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so when the driver collects their handles, and its
    scheduler holds the last job's until the next one."""
    spark.range(0, 1, 1, 1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the cluster's own clean-up takes the folder
            pass
