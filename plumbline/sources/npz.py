"""Archives of covariances as a table of trials, and back (S5 - S7, K5): each file is read by one task, through Spark's own file access."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate

TRIALS = "path string, trial int, trial_id string, label int, cov array<double>, n_channels int"


def read_trials(spark: SparkSession, glob: str, pattern: str = r"subject_(\d+)/session_(\d+)", match: dict[str, float] | None = None) -> DataFrame:
    """subject, session, trial, trial_id, label, cov (row-major doubles), n_channels.

    `match`: stored scalars that must be close to these, else the file's trials are left out (S6); `stale` tells which.
    """
    f = spark.read.format("binaryFile").load(glob).select("path", "content")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if any(k not in z or not np.isclose(float(z[k]), v) for k, v in (match or {}).items()):
                        continue
                    covs, n = z["covs"].astype(float), len(z["covs"])
                    ids = z["trial_ids"].astype(str) if "trial_ids" in z else np.arange(n).astype(str)
                    yield pd.DataFrame({"path": path, "trial": np.arange(n), "trial_id": ids, "label": z["labels"].astype(int), "cov": list(covs.reshape(n, -1)), "n_channels": covs.shape[-1]})

    t = f.mapInPandas(run, TRIALS)
    return t.select(F.regexp_extract("path", pattern, 1).cast("int").alias("subject"), F.regexp_extract("path", pattern, 2).cast("int").alias("session"), "trial", "trial_id", "label", "cov", "n_channels")


RUNS = "path string, name string, kind string, shape array<int>, data array<double>"


def read_runs(spark: SparkSession, glob: str, names: list[str] | None = None, max_values: int = 50_000_000) -> DataFrame:
    """(path, name, kind, shape, data) of the numeric arrays in archives of raw runs, or of those named (S11); row-major doubles.

    An array of over `max_values` numbers fails the read: a row must fit a task.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in [n for n in z.files if names is None or n in names]:
                        x = z[name]
                        if x.size > max_values:
                            raise ValueError(f"{path}: {name} has {x.size} values")
                        if x.dtype.kind in "iufb":
                            yield pd.DataFrame({"path": [path], "name": [name], "kind": [x.dtype.name], "shape": [list(x.shape)], "data": [x.astype(float).ravel()]})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, RUNS)


def stale(spark: SparkSession, glob: str, match: dict[str, float]) -> DataFrame:
    """(path) of archives whose stored scalars are absent or differ."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            bad = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if any(k not in z or not np.isclose(float(z[k]), v) for k, v in match.items()):
                        bad.append(path)
            yield pd.DataFrame({"path": bad})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string")


def strict_violations(trials: DataFrame) -> DataFrame:
    """The strict contract of a covariance (S7): square, finite, symmetric, positive trace, ids unique in a session."""
    key = ["subject", "session", "trial"]
    c, n = F.col("cov"), F.col("n_channels")
    square = F.size(c) == n * n
    at = lambda k: F.get(c, F.pmod(k, n) * n + F.floor(k / n).cast("int"))
    asymmetric = F.exists(F.transform(c, lambda x, k: F.abs(x - at(k)) > 1e-10), lambda b: F.coalesce(b, F.lit(True)))
    infinite = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    trace = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(c, k * (n + 1))), F.lit(0.0), lambda s, x: s + x)
    return validate.union(
        validate.rows(trials, "not square", key, ~square),
        validate.rows(trials, "not finite", key, infinite),
        validate.rows(trials.where(square), "not symmetric", key, asymmetric),
        validate.rows(trials.where(square), "no positive trace", key, ~F.coalesce(trace > 0, F.lit(False))),
        validate.unique(trials, ["subject", "session", "trial_id"]),
    )


CONTRACT = "path string, sha256 string, unit string, channels array<string>, kind string, trials int, labels int, ids int, error string"


def read_contracts(spark: SparkSession, glob: str) -> DataFrame:
    """What archives say of themselves, a row for each file: hash, unit, channels in order, number type of the matrices, and the lengths that must agree."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                row = {"path": path, "sha256": hashlib.sha256(content).hexdigest(), "unit": None, "channels": None, "kind": None, "trials": None, "labels": None, "ids": None, "error": None}
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        row |= {"kind": z["covs"].dtype.name, "trials": len(z["covs"]), "labels": len(z["labels"])}
                        row |= {"unit": str(z["unit"]) if "unit" in z else None, "channels": [str(c) for c in z["channels"]] if "channels" in z else None, "ids": len(z["trial_ids"]) if "trial_ids" in z else None}
                except (ValueError, KeyError, OSError, EOFError, zipfile.BadZipFile) as e:
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                yield pd.DataFrame([row])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, CONTRACT)


def contract_violations(contracts: DataFrame, unit: str, channels: list[str], kind: str = "float64", recorded: DataFrame | None = None) -> DataFrame:
    """Archives that cannot be read, or whose unit, channel order, number type, alignment or (with `recorded`: path, sha256) hash is not the one agreed on."""
    c, key = contracts.where("error is null"), ["path"]
    want = F.array(*map(F.lit, channels))
    found = [
        validate.rows(contracts, "unreadable", key, F.col("error").isNotNull(), F.col("error")),
        validate.rows(c, "unit", key, ~F.coalesce(F.col("unit") == unit, F.lit(False)), F.col("unit")),
        validate.rows(c, "channel order", key, ~F.coalesce(F.col("channels") == want, F.lit(False)), F.array_join("channels", ",")),
        validate.rows(c, "number type", key, F.col("kind") != kind, F.col("kind")),
        validate.rows(c, "alignment", key, (F.col("trials") != F.col("labels")) | (F.coalesce("ids", "trials") != F.col("trials")), F.concat_ws(" ", "trials", "labels", "ids")),
    ]
    if recorded is not None:
        both = contracts.join(recorded.select("path", F.col("sha256").alias("_h")), "path", "left")
        found.append(validate.rows(both, "hash", key, ~F.coalesce(F.col("sha256") == F.col("_h"), F.lit(False)), F.col("sha256")))
    return validate.union(*found)


def write_sessions(trials: DataFrame, single: bool = True, **scalars: float) -> DataFrame:
    """(subject, session, sha256, content): one archive for each session as a binary column; `single` stores float32, as caches do.

    A row is a session's bytes: write them with any sink, or collect a few. Draws are better kept as Parquet.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trial")
        n = int(pdf["n_channels"].iloc[0])
        covs = np.stack(pdf["cov"].to_numpy()).reshape(-1, n, n).astype(np.float32 if single else float)
        out = io.BytesIO()
        np.savez_compressed(out, covs=covs, labels=pdf["label"].to_numpy(), trial_ids=np.array(pdf["trial_id"].tolist(), dtype=str), **scalars)
        data = out.getvalue()
        return pd.DataFrame({"subject": [pdf["subject"].iloc[0]], "session": [pdf["session"].iloc[0]], "sha256": [hashlib.sha256(data).hexdigest()], "content": [data]})

    return trials.groupBy("subject", "session").applyInPandas(run, "subject int, session int, sha256 string, content binary")
