"""Tables that cut lineage, in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``.  Only a local session without that
setting gets a temporary folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = f"tarnspark-{uuid.uuid4().hex}"
_LOCAL: dict[str, str] = {}
#: Rows of a batch that goes to Python, at most.
BATCH = 1024
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="tarnspark-")
    return f"file://{_LOCAL['dir']}"


def save(df: DataFrame, name: str, codec: str = "zstd", rows: int = BATCH) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the reread table.

    While it is written, batches that go to Python hold ``rows`` rows at most, so that a task's memory stays small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_RUN}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_BATCH_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a saved table that nothing will read again, and let Spark remove the shuffles that led to it."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{_RUN}/" in file:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Collect garbage in the driver, so that files of shuffles which nothing refers to any more are removed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete every table that this process saved.  Call it when no result still reads them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """The same for several columns."""
    return [free_name(df, b) for b in bases]


def bounded_sample(df: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """At most ``bound`` rows of ``df``, those of least hash of ``keys``; all rows if there are no more.

    Rows over the quantile that the bound asks for are dropped where they lie, so that the final order sees
    about ``bound`` rows, not as many from each partition.
    """
    n = df.count()
    if n > bound:
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int((1 << 40) * bound / n))
    return df.orderBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)), *keys).limit(bound)
