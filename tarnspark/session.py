"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def tuned(spark: SparkSession) -> SparkSession:
    """``spark`` with stages left uncollapsed whose generated methods the JVM would never compile: it compiles none of over 8000 bytes of
    bytecode, and the physics in one method has more.  Smaller methods for each projection are two to three times as fast."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def session(app: str = "tarnspark", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are those given or the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return tuned(builder.getOrCreate())


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that the cluster names; a local session without one gets its own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarnspark-checkpoints-"))
    return df.checkpoint()
