"""Evaluation of selected sets against a truth, other budgets, other seeds, and earlier targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sets import jaccard, same
from .system import System

ORACLE_TOLERANCE = 1e-12
TOLERANCE = 1e-10


def oracle(truth: DataFrame, case: list[str]) -> DataFrame:
    """truth with `oracle`: within 1e-12 of the case's least delta."""
    return truth.withColumn("oracle", (F.abs(F.col("true") - F.min("true").over(Window.partitionBy(*case))) <= ORACLE_TOLERANCE).cast("int"))


def set_metrics(members: DataFrame, truth: DataFrame, case: list[str]) -> DataFrame:
    """(case, method, …) against the true deltas (E1, F17); an empty set's worst excess is minus infinity."""
    t = oracle(truth, case).withColumn("least", F.min("true").over(Window.partitionBy(*case)))
    s, o = F.col("selected") == 1, F.col("oracle") == 1
    return members.join(t, [*case, "source"]).groupBy(*case, "method").agg(
        F.bool_and(s | ~o).cast("int").alias("oracle_retained"),
        F.bool_and(s == o).cast("int").alias("exact_recovery"),
        F.count_if(s).alias("set_size"),
        F.coalesce(F.max(F.when(s, F.col("true") - F.col("least"))), F.lit(float("-inf"))).alias("worst_excess"),
        F.count_if(~s & o).alias("false_excluded_oracle"),
        F.count_if(s & ~o).alias("false_included_nonoracle"),
    )


def coverage(s: System, truth: DataFrame, case: list[str]) -> DataFrame:
    """(case, e_c, e_d, e_joint): all components, all one-sided contrasts, both."""
    t = truth.select(*case, "source", "true")
    c = s.components.join(t, [*case, "source"]).groupBy(*case).agg(F.bool_and(F.col("true").between(F.col("lower"), F.col("upper"))).cast("int").alias("e_c"))
    j, l = (t.select(*case, F.col("source").alias(k), F.col("true").alias(f"t{k}")) for k in "jl")  # noqa: E741
    d = s.contrasts.join(j, [*case, "j"]).join(l, [*case, "l"]).groupBy(*case).agg(F.bool_and(F.col("tj") - F.col("tl") >= F.col("lower")).cast("int").alias("e_d"))
    return c.join(d, case).withColumn("e_joint", F.col("e_c") * F.col("e_d"))


def coverage_summary(covered: DataFrame, by: list[str], nominal: dict[str, float]) -> DataFrame:
    """(by, event, nominal, cases, coverage, excess, reached) of 0/1 columns named in `nominal`."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("event"), F.col(k).alias("v"), F.lit(float(p)).alias("nominal")) for k, p in nominal.items()]))
    x = covered.select(*by, rows.alias("r")).select(*by, "r.*").groupBy(*by, "event", "nominal").agg(F.count("*").alias("cases"), F.avg("v").alias("coverage"))
    return x.withColumn("excess", F.col("coverage") - F.col("nominal")).withColumn("reached", F.col("coverage") >= F.col("nominal"))


def audit(flags: DataFrame, s: System, truth: DataFrame, case: list[str]) -> DataFrame:
    """(case, events, widths, violations): what must hold whenever the bounds cover, as 0/1 (E3, E4), for the split bands and, with suffix _j, the joint one.

    v_*: an oracle source lost; v_*_near: a worse source kept than 2 widths (pairs: than epsilon_pair) allow; v_exact_*:
    the gap was wide enough for exact recovery, but the set is not the oracle's; v_*_empty; v_ref_subset_rect. Also the
    domination checks by standard errors and by lower bounds, whether they agree, and what they imply.
    """
    t = oracle(truth, case)
    least, o = F.min("true").over(Window.partitionBy(*case)), F.col("oracle") == 1
    c = flags.join(t, [*case, "source"]).withColumn("excess", F.col("true") - least)
    low, own = s.components, t.select(*case, "source", "true")
    pairs = s.contrasts.join(own.select(*case, F.col("source").alias("j"), F.col("true").alias("tj")), [*case, "j"]).join(own.select(*case, F.col("source").alias("l"), F.col("true").alias("tl")), [*case, "l"])
    pairs = pairs.join(low.select(*case, F.col("source").alias("j"), F.col("lower").alias("lj"), F.col("se").alias("sj")), [*case, "j"]).join(low.select(*case, F.col("source").alias("l"), F.col("upper").alias("ul"), F.col("se").alias("sl")), [*case, "l"])
    pairs = pairs.join(s.critical, case)
    true_d = F.col("tj") - F.col("tl")
    aggs, pair_aggs = [], []
    for x in ("", "_j"):
        lo, hi = F.col(f"lower{x}"), F.col(f"upper{x}")
        aggs += [F.bool_and(F.col("true").between(lo, hi)).alias(f"c{x}"), F.max(hi - lo).alias(f"wmax{x}")]
        pair_aggs += [F.bool_and(true_d >= F.col(f"lower{x}")).alias(f"d{x}"), F.greatest(F.lit(0.0), F.max(true_d - F.col(f"lower{x}"))).alias(f"epsilon_pair{x}")]
        for m in ("rect", "pair", "ref"):
            k = F.col(f"{m}{x}") == 1
            aggs += [F.bool_or(o & ~k).alias(f"lost_{m}{x}"), F.coalesce(F.max(F.when(k, F.col("excess"))), F.lit(float("-inf"))).alias(f"excess_{m}{x}"), F.bool_and(o == k).alias(f"exact_{m}{x}"), F.count_if(k).alias(f"n_{m}{x}")]
        aggs.append(F.bool_or((F.col(f"ref{x}") == 1) & (F.col(f"rect{x}") == 0)).alias(f"outside{x}"))
    aggs += [F.coalesce(F.min(F.when(~o, F.col("excess"))), F.lit(float("inf"))).alias("gap"), F.bool_and((F.col("pair") == 0) | (F.col("rect") == 1)).alias("within"), (~F.min_by(o, F.struct("delta", "source"))).alias("miss")]
    pair_aggs += [F.bool_and(F.col("lower") >= F.col("lj") - F.col("ul") - TOLERANCE).alias("dom_lb"), F.bool_and(F.col("q_d") * F.col("se") <= F.col("q_c") * (F.col("sj") + F.col("sl")) + 1e-12).alias("dom_se")]
    e = c.groupBy(*case).agg(*aggs).join(pairs.groupBy(*case).agg(*pair_aggs), case)
    out: list = []
    bit = lambda x, name: x.cast("int").alias(name)
    for x in ("", "_j"):
        ec, ed, w2, eps = F.col(f"c{x}"), F.col(f"d{x}"), 2 * F.col(f"wmax{x}"), F.col(f"epsilon_pair{x}")
        out += [bit(ec, f"e_c{x}"), bit(ed, f"e_d{x}"), F.col(f"wmax{x}"), eps]
        for m, held, bound in (("rect", ec, w2), ("pair", ed, eps), ("ref", ec & ed, F.least(w2, eps))):
            out += [
                F.col(f"excess_{m}{x}"),
                bit(held & F.col(f"lost_{m}{x}"), f"v_{m}{x}"),
                bit(held & (F.col(f"excess_{m}{x}") > bound + TOLERANCE), f"v_{m}{x}_near"),
                bit(held & (F.col("gap") > bound) & ~F.col(f"exact_{m}{x}"), f"v_exact_{m}{x}"),
                bit(F.col(f"n_{m}{x}") == 0, f"v_{m}{x}_empty"),
            ]
        out.append(bit(F.col(f"outside{x}"), f"v_ref{x}_subset_rect"))
    out += [F.col("gap"), bit(F.col("dom_se"), "domination_se_all"), bit(F.col("dom_lb"), "domination_lb_all"), bit(F.col("within"), "pair_subset_rect"), bit(F.col("dom_lb") != F.col("dom_se"), "v_domination_equiv"), bit(F.col("dom_lb") & ~F.col("within"), "v_domination_subset"), bit(F.col("miss"), "top1_not_oracle")]
    return e.select(*case, *out)


def as_sets(members: DataFrame, case: list[str]) -> DataFrame:
    """(case, method, members): sorted arrays; an empty selection is an empty array."""
    return members.groupBy(*case, "method").agg(F.array_sort(F.collect_list(F.when(F.col("selected") == 1, F.col("source")))).alias("members"))


def against_reference(sets: DataFrame, reference, case: list[str], budget: str = "budget") -> DataFrame:
    """Each budget's set beside the reference budget's."""
    ref = sets.where(F.col(budget) == reference).select(*case, "method", F.col("members").alias("_r"))
    m, r = F.col("members"), F.col("_r")
    return sets.join(ref, [*case, "method"]).select(
        *case, budget, "method", F.size(m).alias("set_size"), jaccard(m, r).alias("jaccard"), same(m, r).cast("int").alias("exact"),
        (F.size(m) - F.size(r)).alias("size_change"), F.size(F.array_except(m, r)).alias("added"), F.size(F.array_except(r, m)).alias("removed"),
    )


def pairwise_stability(sets: DataFrame, case: list[str], replicate: str) -> DataFrame:
    """(case, method, mean_jaccard, exact_rate, size_sd, size_range) over unordered pairs of replicates; one replicate alone: 1."""
    a = sets.select(*case, "method", F.col(replicate).alias("_i"), F.col("members").alias("_a"))
    b = sets.select(*case, "method", F.col(replicate).alias("_k"), F.col("members").alias("_b"))
    p = a.join(b, [*case, "method"]).where("_i < _k").groupBy(*case, "method").agg(F.avg(jaccard("_a", "_b")).alias("_j"), F.avg(same("_a", "_b").cast("double")).alias("_e"))
    size = F.size("members")
    own = sets.groupBy(*case, "method").agg(F.stddev_samp(size).alias("size_sd"), (F.max(size) - F.min(size)).alias("size_range"))
    return own.join(p, [*case, "method"], "left").select(*case, "method", F.coalesce("_j", F.lit(1.0)).alias("mean_jaccard"), F.coalesce("_e", F.lit(1.0)).alias("exact_rate"), "size_sd", "size_range")


def consecutive_stability(sets: DataFrame, subject: list[str], target: str = "target") -> DataFrame:
    """Jaccard with the set of the subject's target before; the first has none."""
    before = F.lag("members").over(Window.partitionBy(*subject, "method").orderBy(target))
    return sets.withColumn("_b", before).where("_b is not null").select(*subject, "method", target, jaccard("_b", "members").alias("jaccard"))


def inclusion(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, method, source, rate)."""
    return members.groupBy(*by, "method", "source").agg(F.avg("selected").alias("rate"))
