"""Whole plans: trials to bounds to members, for one of the two bootstrap designs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import discrepancy, gates, resample, system


@dataclass
class Screening:
    est: DataFrame
    packed: DataFrame
    system: system.System

    @property
    def draws(self) -> DataFrame:
        """(case_id, b, source, delta)."""
        return self.packed.select("case_id", "b", F.explode(F.arrays_zip("src", "v")).alias("c")).select("case_id", "b", F.col("c.src").alias("source"), F.col("c.v").alias("delta")).where("delta is not null")

    def members(self, radius: float = 0.1) -> DataFrame:
        """(case_id, source, method, selected) of every rule."""
        wide = gates.gates(self.system).join(gates.simple(self.est, radius).drop("delta"), ["case_id", "source"]).join(gates.stepdown(self.est, None, packed=self.packed), ["case_id", "source"])
        return gates.long_members(wide, METHODS)


METHODS = ["rect", "pair", "ref", "rect_j", "pair_j", "ref_j", "eb", "mcs", "top1", "top3", "threshold", "midpoint", "all_sources"]


def screen(trials: DataFrame, features: list[str] | str, replicates: int, seed: int, key: list[str] | None = None, shared: bool = True, block: int = 1) -> Screening:
    """With `key`, Poisson weights keyed by those columns; else index draws of the positions `i`. Features: columns, or one array column.

    Estimates and packed draws, read by several consumers, are cut off by a checkpoint, as are numbered trials; nothing stays cached.
    """
    on = ["case_id", "b"] if shared else ["case_id", "source", "b"]
    if key:
        s, t = discrepancy.means(trials, features)
        est = discrepancy.mean_distance(s, t, features, ["case_id"])
        ds, dt = resample.poisson_draws(trials, features, replicates, seed, key)
        draws = discrepancy.mean_distance(ds, dt, features, ["case_id", "b"])
    else:
        x = F.col(features) if isinstance(features, str) else F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
        trials = cut(trials.select("case_id", "source", "is_target", "i", x.alias("_v")))  # read four times
        ds, dt = resample.vector_draws(trials, "_v", replicates, seed, shared, block)
        draws = cut(discrepancy.vector_distance(ds, dt, "_v", on))
        est, draws = draws.where("b < 0").drop("b"), draws.where("b >= 0")
    return screening_of(est, draws)


def screening_of(est: DataFrame, draws: DataFrame) -> Screening:
    """From estimates (case_id, source, delta) and draws (case_id, b, source, delta)."""
    est = cut(system.finite(est))
    packed = cut(system.pack(est, system.finite(draws), ["case_id"]))
    return Screening(est, packed, system.build(est, None, packed=packed))
