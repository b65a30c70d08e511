"""Subject-level summaries and paired inference. Subjects weigh the same: splits are averaged first, always."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from ..lineage import cut
from ..functions.student import signed_rank_p, t_quantile, t_survival


def nested_mean(df: DataFrame, levels: list[list[str]], values: list[str]) -> DataFrame:
    """Means of means: by levels[0], then levels[1] of those, … (A4, A5)."""
    for keys in levels:
        df = df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
    return df


def to_wide(df: DataFrame, index: list[str], column: str, names: list[str], value: str) -> DataFrame:
    """Long to wide with the columns named, so no job looks for them."""
    return df.groupBy(*index).pivot(column, names).agg(F.first(value))


def versus(df: DataFrame, group: list[str], reference: str, value: str, method: str = "method") -> DataFrame:
    """`value` less the reference method's in the same group, by a window instead of a join back."""
    base = F.max(F.when(F.col(method) == reference, F.col(value))).over(Window.partitionBy(*group))
    return df.withColumn(f"{value}_diff", F.col(value) - base)


def paired_differences(wide: DataFrame, methods: list[str], by: list[str], level: float = 0.95) -> DataFrame:
    """For each unordered pair of methods, oriented as listed: mean, sd, se and t interval over subjects; a subject with a null in the pair is left out of it."""
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    rows = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs])).alias("p")).select(*by, "p.*")
    s = rows.where("d is not null").groupBy(*by, "method_a", "method_b").agg(F.count("*").alias("subjects"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    se = F.col("sd") / F.sqrt("subjects")
    q = t_quantile(F.lit((1 + level) / 2), F.col("subjects") - 1)
    return s.withColumn("se", se).withColumn("_q", q).select(*by, "method_a", "method_b", "subjects", "mean", "sd", "se", (F.col("mean") - F.col("_q") * F.col("se")).alias("ci_lower"), (F.col("mean") + F.col("_q") * F.col("se")).alias("ci_upper"))


def signed_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n_signed, w, ties) for signed_rank_p (F19): zeros are dropped, ties share their mean rank. Values are ranked by a window, equal sizes meeting first."""
    sizes = df.where(F.col(value) != 0).groupBy(*by, F.abs(value).alias("_s")).agg(F.count("*").alias("_t"), F.count_if(F.col(value) > 0).alias("_up"))
    before = F.sum("_t").over(Window.partitionBy(*by).orderBy("_s")) - F.col("_t")
    r = sizes.withColumn("_r", before + (F.col("_t") + 1) / 2)
    return r.groupBy(*by).agg(F.sum("_t").alias("n_signed"), F.sum(F.col("_up") * F.col("_r")).alias("w"), F.sum(F.pow(F.col("_t").cast("double"), 3) - F.col("_t")).alias("ties"))


def noninferiority(diffs: DataFrame, margins: list[float], by: list[str], value: str = "diff", alpha: float = 0.05) -> DataFrame:
    """One-sided bound, decision (bound > -margin, strictly), t and signed-rank p-values, share within the margin (E8). No spread: p is 0, 1, or 0.5 on the margin."""
    d = diffs.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_x"), F.explode(F.array(*map(F.lit, margins))).alias("margin"))
    s = d.groupBy(*by, "margin").agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"), F.avg((F.col("_x") >= -F.col("margin")).cast("double")).alias("within"))
    ranks = signed_ranks(d.withColumn("_y", F.col("_x") + F.col("margin")), [*by, "margin"], "_y")
    s = s.join(ranks, [*by, "margin"], "left").withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("_q", t_quantile(F.lit(1 - alpha), F.col("n") - 1)).withColumn("lcb", F.col("mean") - F.col("_q") * F.col("se"))
    up = F.col("mean") + F.col("margin")
    p = F.when(F.col("se") > 0, t_survival(F.try_divide(up, F.col("se")), F.col("n") - 1)).when(up > 0, 0.0).when(up < 0, 1.0).otherwise(0.5)
    return s.select(*by, "margin", "n", "mean", "se", "lcb", (F.col("lcb") > -F.col("margin")).alias("noninferior"), p.alias("p_t"), signed_rank_p(F.col("n_signed"), F.col("w"), F.col("ties")).alias("p_wilcoxon"), "within")


def mean_numeric(df: DataFrame, by: list[str]) -> DataFrame:
    """Means of every numeric column by group (A2)."""
    return df.groupBy(*by).agg(*[F.avg(f.name).alias(f.name) for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in by])


#: Cells that a column's range is cut into at a time, and rows among which a median is looked up directly.
CELLS, FEW = 4096, 100_000


def medians(long: DataFrame) -> DataFrame:
    """(quantity, median) of (quantity, v), exactly: histograms narrow the range of each quantity that holds its middle values until few rows are left there.

    A histogram leaves each task as counts; a pass reads the values once. Ties do not matter, as counts of equal values are one cell.
    """
    x = long.where("v is not null and not isnan(v) and abs(v) <> double('Infinity')")
    state = x.groupBy("quantity").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # ranks, from 0, of the one or two middle values among those from `lo` to `hi`
    state = cut(state.select("quantity", "lo", "hi", "n", F.floor((F.col("n") - 1) / 2).alias("r1"), F.floor(F.col("n") / 2).alias("r2")))
    inside = lambda: x.join(F.broadcast(state), "quantity").where("v between lo and hi")
    for _ in range(64):
        if (state.where("hi > lo").agg(F.max("n")).first()[0] or 0) <= FEW:
            break
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))
        cells = inside().where("hi > lo").groupBy("quantity", "r1", "r2", cell.alias("c")).agg(F.count("*").alias("k"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.sum("k").over(Window.partitionBy("quantity").orderBy("c")) - F.col("k")  # at most CELLS rows
        held = cells.withColumn("before", before).where("before <= r2 and before + k > r1").groupBy("quantity").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.sum("k").alias("n"), F.max("r1").alias("_r1"), F.max("r2").alias("_r2"), F.min("before").alias("_before"))
        narrowed = held.select("quantity", "lo", "hi", "n", (F.col("_r1") - F.col("_before")).alias("r1"), (F.col("_r2") - F.col("_before")).alias("r2"))
        after = cut(narrowed.unionByName(state.where("hi = lo")))
        if after.exceptAll(state).isEmpty():
            break
        state = after
    ranked = inside().groupBy("quantity", "r1", "r2", "v").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("quantity").orderBy("v")) - F.col("k")
    hit = ranked.withColumn("before", before).where("before <= r2 and before + k > r1")
    return hit.groupBy("quantity").agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def five_numbers(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """A row for each column: mean, std, min, median, max (A8, A9). Without groups the median is found by narrowing histograms; with them it is each group's percentile, held in one buffer."""
    long = df.select(*(by or []), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by or [], columns, "quantity", "v")
    plain = [F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min")]
    if by:
        return long.groupBy(*by, "quantity").agg(*plain, F.percentile("v", F.lit(0.5)).alias("median"), F.max("v").alias("max"))
    return long.groupBy("quantity").agg(*plain, F.max("v").alias("max")).join(medians(long), "quantity", "left").select("quantity", "mean", "std", "min", "median", "max")


def choice_entropy(df: DataFrame, by: list[str], choice: str) -> DataFrame:
    """(by, choice, count, total, frequency, entropy)."""
    n = df.groupBy(*by, choice).agg(F.count("*").alias("count"))
    w = Window.partitionBy(*by)
    n = n.withColumn("total", F.sum("count").over(w)).withColumn("frequency", F.col("count") / F.col("total"))
    return n.withColumn("entropy", F.sum(-F.col("frequency") * F.ln("frequency")).over(w))


def balanced_accuracy(df: DataFrame, by: list[str], truth: str, said: str) -> DataFrame:
    """Mean recall over classes."""
    hit = (F.col(truth) == F.col(said)).cast("double")
    return df.groupBy(*by, truth).agg(F.avg(hit).alias("recall")).groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))
