"""Results of sessions kept under the parameters they were computed with, and computed again where these change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut


def fingerprint(parameters: list[str]) -> Column:
    """A digest of the parameters in these columns; numbers to twelve digits, so that what is close counts as equal."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.format_string("%.12g", F.col(c).cast("double")), F.col(c).cast("string"), F.lit("")) for c in parameters]), 256)


class SessionCache:
    """Two tables under `home`: `rows`, partitioned by the columns `keys` of a session, and `sessions`, one row for each time a session was computed.

    A session is fresh if its last fingerprint is that of the parameters asked for. Stale and absent ones are computed in one
    job; their partitions are overwritten, all of them or none, and then the new fingerprints are noted. A run that stops in
    between computes them again. Rows carry the fingerprint too, so a reader never sees rows of other parameters.
    """

    def __init__(self, spark: SparkSession, home: str, keys: list[str]) -> None:
        self.spark, self.home, self.keys = spark, home.rstrip("/"), keys

    def table(self, name: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        return self.spark.read.parquet(f"{self.home}/{name}") if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None

    def stale(self, sessions: DataFrame, parameters: list[str]) -> DataFrame:
        """The sessions (keys, parameters) that are absent or were last computed with other parameters, with `_fingerprint`."""
        asked = sessions.withColumn("_fingerprint", fingerprint(parameters))
        noted = self.table("sessions")
        if noted is None:
            return asked
        w = Window.partitionBy(*self.keys).orderBy(F.desc("computed_at"))
        last = noted.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*self.keys, "_fingerprint")
        return asked.join(last, [*self.keys, "_fingerprint"], "left_anti")

    def rows(self, sessions: DataFrame, parameters: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of `sessions`, of which only stale ones are computed: compute(sessions) gives rows that carry the keys."""
        todo = cut(self.stale(sessions, parameters))
        if not todo.isEmpty():
            found = cut(compute(todo.drop("_fingerprint")).join(todo.select(*self.keys, "_fingerprint"), self.keys))
            found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.keys).parquet(f"{self.home}/rows")
            counts = found.groupBy(*self.keys).agg(F.count("*").alias("rows"))
            noted = todo.select(*self.keys, "_fingerprint").join(counts, self.keys, "left").na.fill(0, ["rows"]).withColumn("computed_at", F.current_timestamp())
            noted.write.mode("append").parquet(f"{self.home}/sessions")
        asked = sessions.withColumn("_fingerprint", fingerprint(parameters)).select(*self.keys, "_fingerprint")
        return self.table("rows").join(asked, [*self.keys, "_fingerprint"], "left_semi").drop("_fingerprint")

    def computed(self) -> DataFrame:
        """(keys, times, rows): how often each session was computed, and its rows the last time."""
        return self.table("sessions").groupBy(*self.keys).agg(F.count("*").alias("times"), F.max_by("rows", "computed_at").alias("rows"))
