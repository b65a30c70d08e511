"""Simultaneous component and contrast bounds from bootstrap draws.

Inputs: est (case_id, source, delta), draws (case_id, b, source, delta). Further case columns go in `case`.

A draw of a case is packed into one row with an array over its sources, so the K² contrasts of a draw are made inside a row
and never meet in a join. Shuffled are the draws once, then sums: K² rows a case from each task, and one row a case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SE_FLOOR = 1e-12


@dataclass
class System:
    components: DataFrame  # case, source, delta, raw_se, se, lower, upper, lower_j, upper_j
    contrasts: DataFrame  # case, j, l, d_hat, raw_se, se, lower, lower_j
    critical: DataFrame  # case, q_c, q_d, q_j


def finite(draws: DataFrame, value: str = "delta") -> DataFrame:
    """NaN and infinities become null: such a draw of a source counts for no bound (see `lost`), and quantiles of NaN, which sorts last, cannot arise."""
    x = F.col(value)
    return draws.withColumn(value, F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x))


def lost(draws: DataFrame, case: list[str], value: str = "delta") -> DataFrame:
    """(case, source, draws, lost): sources with draws that are null, NaN or infinite; give it to validate.refuse to stop at any."""
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return draws.groupBy(*case, "source").agg(F.count("*").alias("draws"), F.count_if(bad).alias("lost")).where("lost > 0")


def contrast_pairs(d: DataFrame, on: list[str], value: str = "delta") -> DataFrame:
    """All ordered pairs j <> l (J5): (on, j, l, d = value_j - value_l)."""
    a = d.select(*on, F.col("source").alias("j"), F.col(value).alias("_a"))
    b = d.select(*on, F.col("source").alias("l"), F.col(value).alias("_b"))
    return a.join(b, on).where("j <> l").select(*on, "j", "l", (F.col("_a") - F.col("_b")).alias("d"))


def pack(est: DataFrame, draws: DataFrame, case: list[str]) -> DataFrame:
    """(case, b, src, e, v): a row for each draw; arrays over the case's sources in their order, null where a draw lacks one."""
    e = est.groupBy(*case).agg(F.sort_array(F.collect_list(F.struct("source", "delta"))).alias("_e"))
    d = draws.groupBy(*case, "b").agg(F.collect_list(F.struct("source", "delta")).alias("_v"))
    found = lambda x: F.get(F.filter("_v", lambda y: y["source"] == x["source"]), F.lit(0))["delta"]
    return d.join(e, case).select(*case, "b", F.transform("_e", lambda x: x["source"]).alias("src"), F.transform("_e", lambda x: x["delta"]).alias("e"), F.transform("_e", found).alias("v"))


def square(values: str, f) -> Column:
    """Array over ordered pairs (i, k), row by row, of f(value_i, value_k, i, k)."""
    return F.flatten(F.transform(values, lambda x, i: F.transform(values, lambda y, k: f(x, y, i, k))))


def spread(packed: DataFrame, case: list[str]) -> DataFrame:
    """(case, src, e, raw): raw standard errors of the contrasts row by row, those of the components on the diagonal."""
    d = square("v", lambda x, y, i, k: F.when(i == k, x).otherwise(x - y))
    s = packed.select(*case, F.posexplode(d).alias("pos", "d")).groupBy(*case, "pos").agg(F.stddev_samp("d").alias("raw"))
    s = s.groupBy(*case).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]).alias("raw"))
    e = packed.groupBy(*case).agg(F.first("src").alias("src"), F.first("e").alias("e"))
    return e.join(s, case)


def floored(x: Column) -> Column:
    return F.greatest(x, F.lit(SE_FLOOR))


def build(est: DataFrame, draws: DataFrame, alpha_c: float = 0.025, alpha_d: float = 0.025, alpha_j: float = 0.05, case: list[str] | None = None, packed: DataFrame | None = None) -> System:
    case = case or ["case_id"]
    packed = pack(est, draws, case) if packed is None else packed
    rows = spread(packed, case)
    k_ = F.size("e")
    e, raw = F.col("e"), F.col("raw")
    t = packed.select(*case, "b", "v").join(rows, case)
    t_c = F.array_max(F.transform("v", lambda x, i: F.abs(x - F.get(e, i)) / floored(F.get(raw, i * k_ + i))))
    t_d = F.array_max(square("v", lambda x, y, i, k: F.when(i != k, F.abs(x - y - (F.get(e, i) - F.get(e, k))) / floored(F.get(raw, i * k_ + k)))))
    t = t.select(*case, t_c.alias("t_c"), t_d.alias("t_d"))
    q = t.groupBy(*case).agg(F.percentile("t_c", F.lit(1 - alpha_c)).alias("q_c"), F.percentile("t_d", F.lit(1 - alpha_d)).alias("q_d"), F.percentile(F.greatest("t_c", "t_d"), F.lit(1 - alpha_j)).alias("q_j"))
    full = rows.join(q, case)

    one = F.transform("e", lambda x, i: F.struct(F.get(F.col("src"), i).alias("source"), x.alias("delta"), F.get(raw, i * k_ + i).alias("raw_se"), floored(F.get(raw, i * k_ + i)).alias("se")))
    c = full.select(*case, "q_c", "q_j", F.explode(one).alias("c")).select(*case, "q_c", "q_j", "c.*")
    bound = lambda sign, k: F.col("delta") + sign * F.col(k) * F.col("se")
    components = c.select(*case, "source", "delta", "raw_se", "se", *[bound(s, k).alias(n) for n, s, k in (("lower", -1, "q_c"), ("upper", 1, "q_c"), ("lower_j", -1, "q_j"), ("upper_j", 1, "q_j"))])
    two = square("e", lambda x, y, i, k: F.struct(F.get(F.col("src"), i).alias("j"), F.get(F.col("src"), k).alias("l"), (x - y).alias("d_hat"), F.get(raw, i * k_ + k).alias("raw_se"), floored(F.get(raw, i * k_ + k)).alias("se")))
    d = full.select(*case, "q_d", "q_j", F.explode(two).alias("c")).select(*case, "q_d", "q_j", "c.*").where("j <> l")
    contrasts = d.select(*case, "j", "l", "d_hat", "raw_se", "se", *[(F.col("d_hat") - F.col(k) * F.col("se")).alias(n) for n, k in (("lower", "q_d"), ("lower_j", "q_j"))])
    return System(components, contrasts, q)


def se_diagnostics(s: System, case: list[str]) -> DataFrame:
    """Raw standard errors before flooring."""

    def told(df: DataFrame, k: str) -> DataFrame:
        x = F.col("raw_se")
        bad = x.isNull() | F.isnan(x)
        return df.groupBy(*case).agg(F.min(x).alias(f"{k}_se_min"), F.max(x).alias(f"{k}_se_max"), F.count_if(bad).alias(f"{k}_nonfinite"), F.count_if(x < SE_FLOOR).alias(f"{k}_floored"))

    return told(s.components, "component").join(told(s.contrasts, "contrast"), case)
