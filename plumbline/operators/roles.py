"""From tables to trials: (case_id, source, is_target, i, label, features …), one row for each trial.

A case is one target with its sources. `i` numbers the trials of a session from 0 in an order that is unique. It is built
without sorting a session in one task: rows are dealt by a hash into buckets, numbered inside, and shifted by the counts of
the buckets before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets at least, and rows in one at most, on average.
BUCKETS, ROWS = 64, 1 << 18


def numbered(df: DataFrame, group: list[str], order: list[str], buckets: int | None = None) -> DataFrame:
    """`df` with `i`: the place of each row in its group by (bucket of the hashed order key, order key).

    Without `buckets`, the largest group is counted and gets as many as it needs, 64 at least.
    """
    if buckets is None:
        most = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        buckets = max(BUCKETS, -(-most // ROWS))
    hashed = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order])), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    d = df.withColumn("_bucket", hashed)
    sizes = d.groupBy(*group, "_bucket").count()
    w = Window.partitionBy(*group).orderBy("_bucket")
    shift = sizes.withColumn("_before", F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return d.withColumn("_in", F.row_number().over(own) - 1).join(shift, [*group, "_bucket"]).withColumn("i", F.col("_in") + F.col("_before")).drop("_in", "_before", "_bucket")


def latest_as_target(sessions: DataFrame, session: str = "session", case: str = "case_id") -> DataFrame:
    """Each case's last session is its target, all earlier ones its sources."""
    last = F.max(session).over(Window.partitionBy(case))
    return sessions.withColumn("is_target", F.col(session) == last)


def rolling_targets(sessions: DataFrame, least: int, subject: str = "subject", session: str = "session") -> DataFrame:
    """(subject, target, source): every session with `least` or more earlier ones is a target once."""
    own = sessions.select(subject, session).distinct()
    place = F.row_number().over(Window.partitionBy(subject).orderBy(session)) - 1
    t = own.withColumn("_n", place).where(F.col("_n") >= least).select(subject, F.col(session).alias("target"))
    return t.join(own.withColumnRenamed(session, "source"), subject).where("source < target")


def label_codes(df: DataFrame, label: str, code: str, by: list[str] | None = None) -> DataFrame:
    """`df` with `code`: 0 … m - 1 by the order of its distinct labels, within each group `by` (P14). Distinct labels are ranked, not rows; null labels come first."""
    by = by or []
    known = df.select(*by, label).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(label) if by else Window.orderBy(label)) - 1
    known = known.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(label).alias("_label"), rank.alias(code))
    return df.join(known, [F.col(label).eqNullSafe(F.col("_label")), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]]).drop("_label", *[f"_{c}" for c in by])
