"""Lineage cuts that survive lost executors: checkpoints in the shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a temporary one if all of Spark is this process (tests), else RuntimeError."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir", "")
        if not path and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="plumbline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` now and keep it in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dropped(*frames: DataFrame) -> None:
    """Delete the checkpoints of frames from `cut` that nothing will read any more: what was made from them is cut off itself."""
    for df in frames:
        kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if kept.isDefined():
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(kept.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(rows: int, each: int = 1 << 14) -> int:
    """Tasks that `rows` rows of a few numbers are worth, for `coalesce`: a small table in hundreds of partitions is mostly files of almost nothing, in each of its shuffles and checkpoints."""
    return max(1, -(-rows // each))
