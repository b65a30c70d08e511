"""Runs in units that can be resumed: a frozen plan with its hash, preflight, results by unit, failures as rows.

A unit is a row of a small table (a case, a subject, a target). Its result is written as Parquet below the plan's hash, so
a run that stops goes on with the units that are missing, and a changed plan never meets results of another one.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import validate


def identity(plan: dict) -> str:
    """SHA-256 of the plan as canonical JSON: sorted keys, no blanks."""
    return hashlib.sha256(json.dumps(plan, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


class Run:
    """Results of `plan` under `home`/<hash>, a folder in any store Spark writes to: plan, results, failures."""

    def __init__(self, spark: SparkSession, home: str, plan: dict) -> None:
        self.spark, self.plan, self.hash = spark, plan, identity(plan)
        self.home = f"{home.rstrip('/')}/{self.hash}"
        if not self.exists("plan"):
            frozen = json.dumps(plan, sort_keys=True)
            spark.createDataFrame([(self.hash, frozen)], "hash string, plan string").coalesce(1).write.json(f"{self.home}/plan")

    def exists(self, part: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{part}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def check(self, *found: DataFrame) -> None:
        """Preflight: ValueError with the first violations, before anything runs."""
        validate.refuse(validate.union(*found))

    def results(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.home}/results") if self.exists("results") else None

    def failures(self) -> DataFrame | None:
        """(unit, error, seconds) of every attempt that failed."""
        return self.spark.read.parquet(f"{self.home}/failures") if self.exists("failures") else None

    def pending(self, units: DataFrame, key: str | list[str]) -> DataFrame:
        """Units that were not done; one whose result was empty is done too. A unit may be of several columns, such as a subject and a split."""
        keys = [key] if isinstance(key, str) else key
        return units.join(self.spark.read.parquet(f"{self.home}/done").select(*keys).distinct(), keys, "left_anti") if self.exists("done") else units

    def go(self, units: DataFrame, key: str | list[str], work: Callable[[DataFrame], DataFrame], preflight: list[DataFrame] | None = None, limits: Limits | None = None) -> DataFrame | None:
        """All pending units in one Spark job; if it fails, unit by unit, so that one unit's error stops no other (O2).

        `work` takes a table of units and returns rows that carry `key`. `preflight`: violations, of which there must be none
        before any unit is worked on (O5). `limits`: what is observed while the rows are computed, and refused before they
        are stored. Units are few: a failed job's are listed on the driver. Where work is a function of each unit's rows,
        `each` tells failures without a second attempt.
        """
        keys = [key] if isinstance(key, str) else key
        if preflight:
            self.check(*preflight)
        todo = cut(self.pending(units, keys))
        if todo.isEmpty():
            return self.results()
        try:
            self.store(work(todo), todo, keys, limits)
        except Exception:  # noqa: BLE001  a unit at a time tells which
            for row in todo.select(*keys).distinct().orderBy(*keys).collect():
                start = time.time()
                one = todo.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(row[k])) for k in keys]))
                try:
                    self.store(work(one), one, keys, limits)
                except Exception as e:  # noqa: BLE001  recorded as a row
                    self.failed([("/".join(str(row[k]) for k in keys), f"{type(e).__name__}: {str(e)[:500]}", time.time() - start)])
        return self.results()

    def each(self, rows: DataFrame, key: str | list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame | None:
        """function(a unit's rows) for every pending unit of `rows`, in one job: a unit that fails is a row of `failures`, the others are stored. A unit must fit a task; `schema` is of the function's rows, the key among them."""
        keys = [key] if isinstance(key, str) else key
        names = [f.strip().split()[0] for f in schema.split(",")]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            start = time.time()
            try:
                out = function(pdf)[names].assign(_error=None)
            except Exception as e:  # noqa: BLE001  recorded as a row
                out = pd.DataFrame({**{n: [pdf[n].iloc[0] if n in keys else None] for n in names}, "_error": [f"{type(e).__name__}: {str(e)[:500]}"]})
            return out.assign(_seconds=time.time() - start)

        todo = self.pending(rows, keys)
        found = cut(todo.groupBy(*keys).applyInPandas(run, f"{schema}, _error string, _seconds double"))
        bad = found.where("_error is not null").select(F.concat_ws("/", *keys).alias("unit"), F.col("_error").alias("error"), F.col("_seconds").alias("seconds"))
        if not bad.isEmpty():
            bad.write.mode("append").parquet(f"{self.home}/failures")
        done = todo.select(*keys).distinct().join(found.where("_error is not null").select(*keys), keys, "left_anti")
        self.store(found.where("_error is null").select(*names), done, keys)
        return self.results()

    def failed(self, told: list[tuple[str, str, float]]) -> None:
        self.spark.createDataFrame(told, "unit string, error string, seconds double").coalesce(1).write.mode("append").parquet(f"{self.home}/failures")

    def store(self, df: DataFrame, units: DataFrame, keys: list[str], limits: Limits | None = None) -> None:
        """A unit's rows appear together or not at all: they are computed whole, and what was observed meanwhile is checked, before they are appended."""
        done = cut(units.select(*keys).distinct())
        if limits:
            df, seen = limits.observed(df)
        staged = f"{self.home}/staged-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        if limits:
            limits.check(seen.get)
        self.spark.read.parquet(staged).write.mode("append").parquet(f"{self.home}/results")
        done.write.mode("append").parquet(f"{self.home}/done")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Limits:
    """What a result must keep to, observed by Spark while it is computed: rows, and numbers that are null, NaN or infinite in these columns."""

    least_rows: int = 0
    most_rows: int | None = None
    columns: tuple[str, ...] = ()
    most_lost: int = 0

    def observed(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation()
        lost = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[lost(c).alias(f"lost {c}") for c in self.columns]), seen

    def check(self, seen: dict) -> None:
        if seen["rows"] < self.least_rows or (self.most_rows is not None and seen["rows"] > self.most_rows):
            raise ValueError(f"{seen['rows']} rows")
        for c in self.columns:
            if seen[f"lost {c}"] > self.most_lost:
                raise ValueError(f"{seen[f'lost {c}']} lost numbers in {c}")


def rotated(phases: dict[str, Callable[[], object]], rounds: int, warm: bool = True) -> dict[str, list[float]]:
    """Seconds of each phase in each round; every round begins with another phase, so that none always runs on the warmest machine."""
    names, took = list(phases), {name: [] for name in phases}
    if warm:
        for name in names:
            phases[name]()
    for r in range(rounds):
        for name in names[r % len(names) :] + names[: r % len(names)]:
            start = time.perf_counter()
            phases[name]()
            took[name].append(time.perf_counter() - start)
    return took
