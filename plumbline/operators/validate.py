"""Validators that return violations as rows (check, key, detail), so all of them can be seen at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows(df: DataFrame, check: str, key: list[str], bad: Column, detail: Column | None = None) -> DataFrame:
    told = F.to_json(F.struct(*key)) if key else F.lit("{}")
    return df.where(bad).select(F.lit(check).alias("check"), told.alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are missing, from the schema alone."""
    gone = [(c,) for c in columns if c not in df.columns]
    return df.sparkSession.createDataFrame(gone, "detail string").select(F.lit("missing column").alias("check"), F.lit("{}").alias("key"), "detail")


def no_nulls(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    return union(*[rows(df, "null", key, F.col(c).isNull(), F.lit(c)) for c in columns])


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by several rows (U8)."""
    return rows(df.groupBy(*key).count(), "duplicate key", key, F.col("count") > 1, F.col("count"))


def finite(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    return union(*[rows(df, "not finite", key, F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(c)) for c in columns])


def in_range(df: DataFrame, column: str, lo, hi, key: list[str]) -> DataFrame:
    """Closed interval; a bound may be a column."""
    return rows(df, "out of range", key, ~F.col(column).between(lo, hi), F.col(column))


def complete_grid(df: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """Missing and unexpected keys against the product of small key tables."""
    grid = reduce(lambda a, b: a.crossJoin(b), axes)
    key = grid.columns
    have = df.select(*key).distinct()
    return union(rows(grid.join(have, key, "left_anti"), "missing key", key, F.lit(True)), rows(have.join(grid, key, "left_anti"), "unexpected key", key, F.lit(True)))


def close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-11) -> Column:
    """Both null, both NaN, equal, or within atol + rtol |b|."""
    near = F.abs(a - b) <= atol + rtol * F.abs(b)
    return (a.isNull() & b.isNull()) | F.coalesce((a == b) | near, F.lit(False))


def tables_close(a: DataFrame, b: DataFrame, key: list[str], values: list[str], rtol: float = 1e-9, atol: float = 1e-11) -> DataFrame:
    """Keys in one table only, and values apart (V3, V6, V7)."""
    right = b.select(*[F.col(k).alias(f"r_{k}") for k in key], *[F.col(v).alias(f"r_{v}") for v in values])
    both = a.join(right, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key])
    apart = [rows(both, "differs", key, ~close(F.col(v).cast("double"), F.col(f"r_{v}").cast("double"), rtol, atol), F.concat_ws(" ", F.lit(v), v, f"r_{v}")) for v in values]
    return union(*apart, rows(a.join(b, key, "left_anti"), "left only", key, F.lit(True)), rows(b.join(a, key, "left_anti"), "right only", key, F.lit(True)))


def bound_algebra(s, components: DataFrame | None = None, case: list[str] | None = None) -> dict[str, DataFrame]:
    """Components and contrasts of a system with flags whether their bounds follow from estimate, quantile and error, and whether opposite contrasts cancel (V7)."""
    case = case or ["case_id"]
    c = (s.components if components is None else components).join(s.critical, case)
    b = lambda sign, q: F.col("delta") + sign * F.col(q) * F.col("se")
    both = lambda lo, hi, q: (close(F.col(lo), b(-1, q)), close(F.col(hi), b(1, q)))
    (l1, u1), (l2, u2) = both("lower", "upper", "q_c"), both("lower_j", "upper_j", "q_j")
    k = s.contrasts.join(s.critical, case)
    back = s.contrasts.select(*case, F.col("l").alias("j"), F.col("j").alias("l"), F.col("d_hat").alias("_back"))
    k = k.join(back, [*case, "j", "l"]).withColumn("lower_ok", close(F.col("lower"), F.col("d_hat") - F.col("q_d") * F.col("se")) & close(F.col("lower_j"), F.col("d_hat") - F.col("q_j") * F.col("se")))
    return {"components": c.withColumn("lower_ok", l1 & l2).withColumn("upper_ok", u1 & u2), "contrasts": k.withColumn("opposite_ok", close(F.col("d_hat"), -F.col("_back")))}


def same_structure(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns in one table only, columns of another type, and rows whose number of copies differs."""
    x, y = ({f.name: f.dataType.simpleString() for f in t.schema.fields} for t in (a, b))
    told = [(c, f"{x.get(c)} {y.get(c)}") for c in sorted(x.keys() | y.keys()) if x.get(c) != y.get(c)]
    spark = a.sparkSession
    found = spark.createDataFrame(told, "key string, detail string").select(F.lit("column").alias("check"), "key", "detail")
    if told:
        return found
    names = sorted(x)
    n = a.select(*names, F.lit(1).alias("_n")).unionByName(b.select(*names, F.lit(-1).alias("_n"))).groupBy(*names).agg(F.sum("_n").alias("_n"))
    return union(found, rows(n, "row", names, F.col("_n") != 0, F.col("_n")))


def first_splits(df: DataFrame, n: int, split: str = "split") -> DataFrame:
    """Rows of the first n splits, which are numbered from 0 (T4)."""
    return df.where((F.col(split) >= 0) & (F.col(split) < n))


def integral_rates(df: DataFrame, rate: str, n: str, key: list[str], atol: float = 1e-9) -> DataFrame:
    """Rates that are no whole count of n (V5)."""
    x = F.col(rate) * F.col(n)
    return rows(df, "no whole count", key, F.abs(x - F.bround(x)) > atol, x)


def constant(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Groups with several values, null counting as one (A12): the least and the largest value differ, or some but not all are null."""
    x = F.col(column)
    n = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_n"), F.count(x).alias("_some"))
    return rows(n, "not constant", by, (F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False))) | ((F.col("_some") > 0) & (F.col("_some") < F.col("_n"))), F.concat_ws(" ", "_lo", "_hi"))


def split_partition(splits: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of a split that are in both roles, or in none (V8)."""
    n = splits.groupBy(*unit, "split").agg(F.count_distinct("role").alias("n"), F.count("*").alias("m"))
    return rows(n, "split", [*unit, "split"], (F.col("n") != 1) | (F.col("m") != 1))


def minimum(df: DataFrame, columns: list[str], least: int, key: list[str]) -> DataFrame:
    """Counts below a least one."""
    return union(*[rows(df, "too few", key, F.col(c) < least, F.concat_ws(" ", F.lit(c), c)) for c in columns])


#: Checks of a rule table: rows of a column that break a rule, given its bounds.
RULES = {
    "not null": lambda x, lo, hi: x.isNull(),
    "finite": lambda x, lo, hi: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")),
    "between": lambda x, lo, hi: ~F.coalesce(x.between(lo, hi), F.lit(False)),
    "at least": lambda x, lo, hi: ~F.coalesce(x >= lo, F.lit(False)),
    "at most": lambda x, lo, hi: ~F.coalesce(x <= hi, F.lit(False)),
    "whole": lambda x, lo, hi: ~F.coalesce(F.abs(x - F.bround(x)) <= 1e-9, F.lit(False)),
}
#: Checks of a whole column: (its aggregate, the broken one given the bounds).
TOTALS = {
    "mean between": (F.avg, lambda v, lo, hi: ~F.coalesce(v.between(lo, hi), F.lit(False))),
    "sum between": (F.sum, lambda v, lo, hi: ~F.coalesce(v.between(lo, hi), F.lit(False))),
    "rows between": (lambda x: F.count("*"), lambda v, lo, hi: ~v.between(lo, hi)),
    "constant": (lambda x: F.coalesce(F.max(x) - F.min(x), F.lit(0.0)), lambda v, lo, hi: v != 0),
}


def by_rules(tables: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """(table, column, rule, checked, broken, value) of a table of rules (table, column, rule, lo, hi): each table is scanned once for all of its rules.

    Rules that name no table, column or rule that exists are told as broken, never passed over. A table of rules is small.
    """
    asked = rules.select("table", "column", "rule", "lo", "hi").collect()
    spark, out = rules.sparkSession, []
    schema = "table string, column string, rule string, checked long, broken long, value double"
    for name in dict.fromkeys(r["table"] for r in asked):
        own = [r for r in asked if r["table"] == name]
        df = tables.get(name)
        known = [r for r in own if df is not None and r["column"] in df.columns and (r["rule"] in RULES or r["rule"] in TOTALS)]
        lost = [(r["table"], r["column"], r["rule"], 0, 1, None) for r in own if r not in known]
        if lost:
            out.append(spark.createDataFrame(lost, schema))
        if not known:
            continue
        aggs = []
        for r in known:
            x, lo, hi = F.col(r["column"]), F.lit(r["lo"]), F.lit(r["hi"])
            if r["rule"] in RULES:
                broken, value = F.count_if(RULES[r["rule"]](x, lo, hi)), F.lit(None).cast("double")
            else:
                of, wrong = TOTALS[r["rule"]]
                value = of(x).cast("double")
                broken = wrong(value, lo, hi).cast("long")
            aggs.append(F.struct(F.lit(name).alias("table"), F.lit(r["column"]).alias("column"), F.lit(r["rule"]).alias("rule"), F.count("*").alias("checked"), broken.cast("long").alias("broken"), value.alias("value")))
        out.append(df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*"))
    return union(*out) if out else spark.createDataFrame([], schema)


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def refuse(found: DataFrame, show: int = 20) -> None:
    """ValueError with the first violations, if there are any."""
    if bad := found.limit(show).collect():
        raise ValueError("; ".join(f"{r['check']} {r['key']} {r['detail']}" for r in bad))
