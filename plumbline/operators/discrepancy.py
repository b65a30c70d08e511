"""Discrepancies between a source and the target of its case."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut, dropped
from . import resample


def means(trials: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    m = trials.groupBy("case_id", "source", "is_target").agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])
    return m.where("not is_target").drop("is_target"), m.where("is_target").drop("is_target", "source")


def mean_distance(sources: DataFrame, targets: DataFrame, features: list[str], on: list[str]) -> DataFrame:
    """delta = squared distance of means - d (1/n_source + 1/n_target), without bias for unit variances."""
    t = targets.select(*on, F.col("n").alias("_nt"), *[F.col(f).alias(f"_{f}") for f in features])
    gap = sum((F.pow(F.col(f) - F.col(f"_{f}"), 2) for f in features[1:]), F.pow(F.col(features[0]) - F.col(f"_{features[0]}"), 2))
    delta = gap - F.lit(len(features)) * (F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("_nt"))
    keep = [c for c in sources.columns if c not in features and c != "n"]
    return sources.join(t, on).select(*keep, delta.alias("delta"))


def vector_distance(sources: DataFrame, targets: DataFrame, vector: str, on: list[str]) -> DataFrame:
    """mean_distance of means in array columns of one length."""
    t = targets.select(*on, F.col("n").alias("_nt"), F.col(vector).alias("_t"))
    gap = F.aggregate(F.zip_with(vector, "_t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    keep = [c for c in sources.columns if c not in (vector, "n")]
    return sources.join(t, on).select(*keep, (gap - F.size(vector) * (F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("_nt"))).alias("delta"))


#: Rows and numbers of a block of a kernel at most, rows of it that are worked on at once, and megabytes of blocks in a partition.
TILE, NUMBERS, STRIP, MB = 4096, 1 << 18, 256, 24


def kernel_distance(trials: DataFrame, vector: str, sigma: float, replicates: int = 0, seed: int = 0, weight: str | None = None, tile: int = TILE, size: int | None = None) -> DataFrame:
    """(case_id, source, b, delta): unbiased squared maximum mean discrepancy of a source from its case's target (F12, F13), b = -1.

    `weight`: how often a row counts. b from 0: with drawn counts as weights, one target draw for all sources of a case (R6);
    `size`: as in `resample.index_draws`. trials: case_id, source, is_target, i (0 to n - 1 in a session), vector, weight.

    The kernel's n² pairs are met in tiles: sessions are cut into even blocks of at most `tile` rows, which are written once
    to the shared folder. Blocks of large cases meet as a product of partitions, each task reading its two from there, so
    nothing is copied for each pair; small cases are joined by their key. A pair's quadratic forms are matrix products, and
    only sums leave a task. A session's own tiles are met once, not twice, and the target's once for all sources. A session
    may have any number of rows; the work is what the statistic demands.
    """
    s = trials.select("case_id", "source", "is_target", "i", F.col(vector).alias("_x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    sessions = s.groupBy("case_id", "source", "is_target").agg((F.max("i") + 1).cast("long").alias("n"), F.sum("_w").alias("_sum"), F.greatest(F.max(F.size("_x")), F.lit(1)).alias("_width"))
    tiles = F.ceil(F.col("n") / F.greatest(F.least(F.lit(tile), F.floor(F.lit(NUMBERS) / F.col("_width"))), F.lit(1)))
    large = F.sum(F.col("n") * F.col("_width")).over(Window.partitionBy("case_id")) > 4 * NUMBERS
    sessions = cut(sessions.withColumn("_tiles", tiles).withColumn("_each", F.ceil(F.col("n") / F.col("_tiles"))).withColumn("large", large))
    held = sessions.agg(F.sum(F.col("n") * (8 * F.col("_width") + 4 * replicates)).alias("bytes"), F.sum("_tiles").alias("blocks"), F.coalesce(F.bool_or("large"), F.lit(False)).alias("large")).first()
    # enough partitions for tasks of two of them, few enough to be read again for each other one
    parts = max(1, min(held["blocks"] or 1, max(-(-(held["bytes"] or 0) // (MB << 20)), 2 * math.isqrt(trials.sparkSession.sparkContext.defaultParallelism - 1) + 2)))
    tag = F.when(F.col("is_target"), F.concat_ws("|", F.lit(str(seed)), F.lit("t"), F.col("case_id").cast("string"), F.lit("-1"))).otherwise(resample.tagged(s, seed, "s"))
    rows = s.join(sessions.select("case_id", "source", "is_target", "n", "_each", "large"), ["case_id", "source", "is_target"]).withColumn("_tag", tag).withColumn("tile", F.floor(F.col("i") / F.col("_each")))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        at, n, tag = group.column("i").to_numpy(), group.column("n")[0].as_py(), group.column("_tag")[0].as_py()
        counts = np.zeros((0, len(at)), np.int32)
        if replicates:
            lo, hi = int(at[0]), int(at[-1]) + 1
            if size:
                counts = np.hstack([resample.weights_of(n, k, tag, replicates, 1, size) for k in range(lo // size, (hi - 1) // size + 1)])[:, at - lo // size * size]
            else:
                counts = np.array([c for c, _ in resample.drawn_between(n, lo, hi, tag, replicates, n)], np.int32)[:, at - lo]
        key = {c: group.column(c).slice(0, 1) for c in ("case_id", "source", "is_target", "tile", "large")}
        flat = lambda x, kind: pa.array([x.ravel()], pa.list_(kind))
        return pa.table(key | {"rows": pa.array([len(at)]), "x": flat(group.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False), pa.float64()), "w": flat(group.column("_w").to_numpy(), pa.float64()), "counts": flat(counts, pa.int32())})

    kinds = {k: trials.schema[k].dataType.simpleString() for k in ("case_id", "source")}
    block = ["case_id", "source", "is_target", "tile"]
    blocks = rows.repartition(parts, *block).groupBy(*block).applyInArrow(packed, f"case_id {kinds['case_id']}, source {kinds['source']}, is_target boolean, tile long, large boolean, rows long, x array<double>, w array<double>, counts array<int>")
    blocks = cut(blocks)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in batches:
            sums: dict[tuple, np.ndarray] = {}
            keys = [g.column(c).to_pylist() for c in ("case_id", "source", "part", "times")]
            for at, (*key, times) in enumerate(zip(*keys, strict=True)):
                (x, v), (y, w) = (side(g, at, c) for c in "az")
                norms, found = (y**2).sum(1), 0.0
                for k in range(0, len(x), STRIP):
                    strip = x[k : k + STRIP]
                    near = strip @ y.T
                    near *= -2
                    near += (strip**2).sum(1)[:, None]
                    near += norms
                    np.maximum(near, 0, out=near)
                    near *= -1 / (2 * sigma * sigma)
                    np.exp(near, out=near)
                    found = found + ((v[:, k : k + STRIP] @ near) * w).sum(1)
                sums[tuple(key)] = sums.get(tuple(key), 0.0) + times * found
            fixed = [pa.array([k[c] for k in sums for _ in range(replicates + 1)], g.schema.field(name).type) for c, name in enumerate(("case_id", "source", "part"))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.tile(np.arange(-1, replicates), len(sums)), pa.int32()), pa.array(np.concatenate([*sums.values(), np.zeros(0)]))], names=["case_id", "source", "part", "b", "value"])

    def side(g: pa.RecordBatch, at: int, c: str) -> tuple[np.ndarray, np.ndarray]:
        """A block's vectors, and its weights above its counts."""
        n = g.column(f"{c}_rows")[at].as_py()
        x, w, counts = (g.column(f"{c}_{k}")[at].values.to_numpy(zero_copy_only=False) for k in ("x", "w", "counts"))
        return x.reshape(n, -1), np.vstack([w, counts.reshape(replicates, n)])

    def pairs(blocks: DataFrame, hint: str | None = None) -> DataFrame:
        a, z = (blocks.select(*[F.col(k).alias(f"{c}_{k}") for k in blocks.columns]) for c in "az")
        same = (F.col("a_source") == F.col("z_source")) & (F.col("a_is_target") == F.col("z_is_target"))
        cross = ~F.col("a_is_target") & F.col("z_is_target")
        both = (a.hint(hint) if hint else a).join(z, (F.col("a_case_id") == F.col("z_case_id")) & (cross | (same & (F.col("a_tile") <= F.col("z_tile")))))
        part = F.when(cross, "cross").when(F.col("a_is_target"), "target").otherwise("own")
        times = F.when(same & (F.col("a_tile") < F.col("z_tile")), 2).otherwise(1)
        return both.select(F.col("a_case_id").alias("case_id"), F.col("a_source").alias("source"), part.alias("part"), times.alias("times"), *[f"{c}_{k}" for c in "az" for k in ("rows", "x", "w", "counts")])

    sums = [pairs(blocks.where("not large"))] + ([pairs(blocks.where("large"), "shuffle_replicate_nl")] if held["large"] else [])
    sums = [p.mapInArrow(met, f"case_id {kinds['case_id']}, source {kinds['source']}, part string, b int, value double") for p in sums]
    sums = cut(reduce(DataFrame.unionByName, sums).groupBy("case_id", "source", "part", "b").agg(F.sum("value").alias("value")))
    dropped(blocks)
    n = F.when(F.col("b") < 0, F.col("_sum")).otherwise(F.col("n"))
    within = sums.where("part <> 'cross'").join(sessions, ["case_id", "source"]).where((F.col("part") == "target") == F.col("is_target"))
    within = within.select("case_id", "source", "part", "b", n.alias("c"), ((F.col("value") - n) / (n * (n - 1))).alias("u"))  # a row with itself, as often as it counts, has kernel one
    mine = within.where("part = 'own'").select("case_id", "source", "b", "u", "c")
    theirs = within.where("part = 'target'").select("case_id", "b", F.col("u").alias("_u"), F.col("c").alias("_c"))
    both = sums.where("part = 'cross'").select("case_id", "source", "b", "value").join(mine, ["case_id", "source", "b"]).join(theirs, ["case_id", "b"])
    return both.select("case_id", "source", "b", (F.col("u") + F.col("_u") - 2 * F.col("value") / (F.col("c") * F.col("_c"))).alias("delta"))
