"""Set-selection rules (G3 - G14). Each adds a 0/1 column to, or makes rows from, the components of a system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .system import System, floored, pack, spread


def flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def gates(s: System, case: list[str] | None = None) -> DataFrame:
    """Components with rect, pair, ref (their intersection) and the joint-band variants rect_j, pair_j, ref_j, and eb (empirical best)."""
    case = case or ["case_id"]
    over = Window.partitionBy(*case)
    worst = s.contrasts.groupBy(*case, F.col("j").alias("source")).agg(F.max("lower").alias("_m"), F.max("lower_j").alias("_mj"))
    c = s.components.join(worst, [*case, "source"], "left")
    c = c.withColumns(
        {
            "rect": flag(F.col("lower") <= F.min("upper").over(over)),
            "pair": 1 - flag(F.col("_m") > 0),
            "rect_j": flag(F.col("lower_j") <= F.min("upper_j").over(over)),
            "pair_j": 1 - flag(F.col("_mj") > 0),
            "eb": flag(F.col("lower") <= F.min_by("upper", F.struct("delta", "source")).over(over)),
        }
    )
    return c.withColumns({"ref": F.col("rect") * F.col("pair"), "ref_j": F.col("rect_j") * F.col("pair_j")}).drop("_m", "_mj")


def simple(est: DataFrame, radius: float, case: list[str] | None = None) -> DataFrame:
    """(case, source, delta, top1, top3, threshold, midpoint, all_sources) from estimates alone."""
    case = case or ["case_id"]
    over = Window.partitionBy(*case)
    rank = F.row_number().over(over.orderBy("delta", "source"))
    lo, hi, d = F.min("delta").over(over), F.max("delta").over(over), F.col("delta")
    return est.select(*case, "source", "delta", flag(rank <= 1).alias("top1"), flag(rank <= 3).alias("top3"), flag(d <= lo + radius).alias("threshold"), flag((d <= lo + 0.5 * (hi - lo)) | (hi <= lo)).alias("midpoint"), F.lit(1).alias("all_sources"))


def top_matched(members: DataFrame, sizes: Column, case: list[str]) -> Column:
    """As many best sources as another set has, at least one."""
    return flag(F.row_number().over(Window.partitionBy(*case).orderBy("delta", "source")) <= F.greatest(sizes, F.lit(1)))


def stepdown(est: DataFrame, draws: DataFrame, alpha: float = 0.05, case: list[str] | None = None, packed: DataFrame | None = None) -> DataFrame:
    """(case, source, mcs): model-confidence-set stepdown (G7), relational.

    Sources leave in the order of falling delta (ties: the first source first), so the active sets are the m sources that
    leave last. Every m is tested at once; the largest m that is not rejected stays, else one. observed is the largest
    studentised gap to the best (its first minimum); critical the quantile of the largest centred studentised contrast in
    the set, a running maximum over m inside each draw's row.
    """
    case = case or ["case_id"]
    packed = pack(est, draws, case) if packed is None else packed
    n, e, raw = F.size("e"), F.col("e"), F.col("raw")
    order = F.array_sort(F.transform("e", lambda x, i: F.struct(x.alias("d"), (-i).alias("minus"))))  # sources are in order: -i puts the last of ties first
    rows = spread(packed, case).withColumn("ord", F.transform(order, lambda x: -x["minus"]))
    at = lambda m: F.get(F.col("ord"), m)
    se = lambda i, k: floored(F.get(raw, i * n + k))
    # pairs that the m-th member brings: with every earlier member, both ways
    v = F.col("v")
    centred = lambda i, k: (F.get(v, i) - F.get(v, k) - F.get(e, i) + F.get(e, k)) / se(i, k)
    both = lambda i, k: F.greatest(centred(i, k), centred(k, i))
    fresh = F.transform(F.sequence(F.lit(1), n - 1), lambda m: F.array_max(F.transform(F.slice("ord", 1, m), lambda k: both(at(m), k))))
    t = packed.select(*case, "v").join(rows, case).where("size(e) > 1").withColumn("fresh", fresh)
    run = F.transform("fresh", lambda x, i: F.array_max(F.slice("fresh", 1, i + 1)))
    critical = t.select(*case, F.posexplode(run).alias("pos", "t")).groupBy(*case, (F.col("pos") + 2).alias("m")).agg(F.percentile("t", F.lit(1 - alpha)).alias("critical"))
    critical = critical.groupBy(*case).agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "critical"))), lambda x: x["critical"]).alias("critical"))
    best = lambda m: F.get(F.col("ord"), F.size(F.filter(F.slice("ord", 1, m), lambda i: F.get(e, i) == F.get(e, at(F.lit(0))))) - 1)
    observed = lambda m: F.array_max(F.transform(F.slice("ord", 1, m), lambda i: F.when(i != best(m), (F.get(e, i) - F.get(e, best(m))) / se(i, best(m)))))
    passed = F.filter(F.sequence(F.lit(2), n), lambda m: observed(m) <= F.get(F.col("critical"), m - 2))
    kept = rows.join(critical, case, "left").withColumn("kept", F.coalesce(F.array_max(passed), F.lit(1)))
    members = F.transform("src", lambda s, i: F.struct(s.alias("source"), (F.array_position(F.slice("ord", 1, F.col("kept")), i) > 0).cast("int").alias("mcs")))
    return kept.select(*case, F.explode(members).alias("c")).select(*case, "c.*")


def long_members(wide: DataFrame, methods: list[str], case: list[str] | None = None) -> DataFrame:
    """(case, source, method, selected) from flags."""
    return wide.select(*(case or ["case_id"]), "source", *methods).unpivot([*(case or ["case_id"]), "source"], methods, "method", "selected")


def certificate(s: System, case: list[str] | None = None) -> DataFrame:
    """Why each source is out (G14): margin over the rectangle's threshold, witnesses with a positive contrast bound, the strongest (T5)."""
    case = case or ["case_id"]
    out = s.contrasts.groupBy(*case, F.col("j").alias("source")).agg(
        F.count_if(F.col("lower") > 0).alias("n_witnesses"),
        F.array_sort(F.collect_list(F.when(F.col("lower") > 0, F.col("l")))).alias("witnesses"),
        F.max_by("l", F.struct("lower", -F.col("l"))).alias("strongest"),
        F.max("lower").alias("strongest_lower"),
    )
    c = s.components.withColumn("margin", F.col("lower") - F.min("upper").over(Window.partitionBy(*case)))
    c = c.join(out, [*case, "source"], "left").withColumn("rect_excluded", flag(F.col("margin") > 0)).withColumn("pair_excluded", flag(F.col("n_witnesses") > 0))
    label = F.when((F.col("rect_excluded") == 1) & (F.col("pair_excluded") == 1), "both").when(F.col("rect_excluded") == 1, "rectangle").when(F.col("pair_excluded") == 1, "contrast").otherwise("retained")
    return c.select(*case, "source", "margin", "rect_excluded", "pair_excluded", "n_witnesses", "witnesses", "strongest", "strongest_lower", label.alias("status"))
