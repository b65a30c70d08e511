"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has one constraint: the words taken from it. Rates between 0 and `cap` that stay closest in relative
entropy to one copy of every document are exponentially tilted by a document's words: rate = cap * odds / (1 + odds) with
odds = exp(lambda * words / mean words) / (cap - 1). The convex dual has one lambda a source; Newton steps, kept inside
brackets, solve all at once. A step reads the table of distinct (source, size) pairs, not the documents. Rates become whole
copies by a hash of the document, and what rounding leaves is settled by moving each source's rounding point over the documents that fit,
then by size, the largest first, until no document fits. Rows that are wholly alike get numbers, so that each is rounded and
settled as a document of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, numbered, written

#: Above this many sources the per-source table is joined by a shuffle instead of a broadcast (under 100 bytes a row).
BROADCAST_SOURCES = 50_000
LEVELS, WIDTH = 3, 10
#: A group of at most so many rows is ranked by a window; a larger one is narrowed by histograms first.
FEW = 4096
OWN = ("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], ratio: float, cap: float) -> DataFrame:
    """(k, source_size, mean, target) from (k, source, source_size, n): shares by weight, stopped at cap times the source's size, the excess shared again until none is above.

    A round is one aggregate over a row for each source; every round but the last stops at least one more source.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_place") % len(weights) + 1).cast("int"))
    s = cut(numbered(sources, F.col("source").asc_nulls_last()).select("k", "source_size", (F.col("source_size") / F.greatest("n", F.lit(1))).alias("mean"), w.alias("w"), (cap * F.col("source_size")).alias("most")))
    total = float(s.agg(F.sum("source_size")).first()[0] or 0) * ratio
    level, stopped = 0.0, -1
    while True:
        over = F.col("w") * level >= F.col("most")
        n, held, free = s.agg(F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("w")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - (held or 0.0)) / free
    return s.select("k", "source_size", "mean", F.when(F.col("w") * level >= F.col("most"), F.col("most")).otherwise(F.col("w") * level).alias("target"))


def tilt(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return cap / (1 + (cap - 1) * F.exp(-lam * size / F.greatest(mean, F.lit(1e-9))))


def solve(cells: DataFrame, goals: DataFrame, cap: float, joined, rounds: int = 200) -> DataFrame:
    """goals with `lam`: Newton's steps on the dual of all sources at once, over `cells` (k, size, n). Null where the target is all copies or none."""
    t, lam = F.col("target"), F.col("lam")
    ends = (F.col("source_size") > 0) & (t > 0) & (t < cap * F.col("source_size"))
    state = cut(goals.withColumn("lam", F.when(ends, F.lit(0.0))).withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")))
    for _ in range(rounds):
        rate = tilt(lam, F.col("size"), F.col("mean"), cap)
        words = F.col("n") * F.col("size")
        slope = words * rate * (1 - rate / cap) * F.col("size") / F.col("mean")
        sums = joined(cells, state.where("lam is not null").select("k", "lam", "mean")).groupBy("k").agg(F.sum(words * rate).alias("g"), F.sum(slope).alias("h"))
        lo, hi = (F.when(F.col("g") < t, lam).otherwise(F.col("lo")), F.when(F.col("g") >= t, lam).otherwise(F.col("hi")))
        step = lam + F.try_divide(t - F.col("g"), F.col("h"))
        halved = F.when(F.col("hi").isNull(), F.greatest(2 * lam, lam + 1)).when(F.col("lo").isNull(), F.least(2 * lam, lam - 1)).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = step.isNotNull() & ~F.isnan(step) & (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi"))) & (F.abs(step - lam) <= 4 + 2 * F.abs(lam))
        err = F.abs(F.col("g") - t) / t
        state = cut(
            state.select("k", "source_size", "mean", "target", "lam", "lo", "hi")
            .join(sums, "k", "left")
            .withColumn("err", err)
            .withColumns({"lo": F.when(F.col("g").isNotNull(), lo).otherwise(F.col("lo")), "hi": F.when(F.col("g").isNotNull(), hi).otherwise(F.col("hi"))})
            .withColumn("lam", F.when(lam.isNull() | (F.col("err") <= 1e-11), lam).when(inside, step).otherwise(halved))
            .select("k", "source_size", "mean", "target", "lam", "lo", "hi", "err")
        )
        worst = state.agg(F.max("err")).first()[0]
        if worst is None or worst <= 1e-10:
            break
    return state.select("k", "source_size", "mean", "target", F.round("lam", 9).alias("lam"))


def apart(d: DataFrame) -> DataFrame:
    """`d` (id, k, size, _row, …) with `hash`: of the id and, where rows share their id, of the row's number among them.

    Numbers are dealt without a group in one task: rows are numbered inside their partition (the upper bits of `_row`) and
    shifted by the counts of the partitions before.
    """
    alike = cut(d.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    n = alike.count()
    if not n:
        return d.withColumn("hash", F.col("id"))
    alike = F.broadcast(alike) if n <= BROADCAST_SOURCES else alike
    some = d.join(alike, "id", "left_semi").withColumn("_p", F.shiftright("_row", 33))
    parts = some.groupBy("id", "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("id").orderBy("_p")) - F.col("_n")  # a row for each partition
    own = F.row_number().over(Window.partitionBy("id", "_p").orderBy("_row"))  # rows of one partition
    number = some.withColumn("_own", own).join(parts.select("id", "_p", before.alias("_before")), ["id", "_p"])
    number = number.withColumn("hash", F.xxhash64("id", F.col("_own") + F.col("_before"))).select(*d.columns, "hash")
    return d.join(alike, "id", "left_anti").select(*d.columns, F.col("id").alias("hash")).unionByName(number)


def nth(rows: DataFrame, picks: DataFrame, key: list[str], joined) -> DataFrame:
    """(key, _last): the t-th smallest `q` (63 bits) of each group of `rows` that `picks` (key, t) names.

    Histograms of 2**WIDTH cells narrow every group to one cell at a time, until none holds more than FEW rows; a window ranks those.
    """
    state, shift = picks.select(*key, "t", F.lit(0).cast("long").alias("_cell")), 63
    while True:
        inside = joined(rows, state).where(F.shiftright("q", shift) == F.col("_cell")) if shift < 63 else joined(rows, state)
        most = inside.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= FEW or shift < WIDTH:
            break
        shift -= WIDTH
        cells = inside.groupBy(*key, "t", F.shiftright("q", shift).alias("_b")).agg(F.count("*").alias("n"))
        run = F.sum("n").over(Window.partitionBy(*key).orderBy("_b"))  # at most 2**WIDTH rows a group
        state = cut(cells.withColumn("run", run).where("run >= t and run - n < t").select(*key, (F.col("t") - F.col("run") + F.col("n")).alias("t"), F.col("_b").alias("_cell")))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("q"))
    return inside.withColumn("_r", rank).where("_r = t").select(*key, F.col("q").alias("_last"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, cap: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, rate, copies (0 to cap), taken (copies x size), then the columns `keep`.

    size counts the words of the whole text (null: 0). Sources are ordered by code point, null last, and weigh `weights`
    in turn; together they share `ratio` of all words. Documents without words have no say in their source's sum and get
    no copies beyond their rate's. Rows repeated, or with null ids, are documents of their own, however many they are; an
    empty table gives an empty one; reruns agree. A source without words has target 0.

    `keep`, the text as a rule, makes the result a table to train on. These columns are written once, beside the rows'
    numbers, to the shared folder, and joined to the copies at the end. Those named like a column of the result get the prefix `doc_`.
    """
    if cap < 2 or int(cap) != cap:
        raise ValueError("cap must be a whole number of at least 2")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    kept = {c: f"doc_{c}" if c in OWN else c for c in keep if c not in ("doc_id", "source")}
    d = docs.select(
        "doc_id", "source", key.alias("k"), n_words().alias("size"), F.xxhash64(F.lit(17), "doc_id", F.col("doc_id").isNull(), key, "text").alias("id"), F.monotonically_increasing_id().alias("_row"),
        *([F.struct(*[F.col(c).alias(n) for c, n in kept.items()]).alias("_kept")] if kept else []),
    )
    stored = written(d, "mix") if kept else cut(d)
    d = cut(apart(stored.drop("_kept")).drop("id"))
    cells = cut(d.groupBy("k", "source", "size").agg(F.count("*").alias("n")))
    sources = cells.groupBy("k", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n"))
    goals = cut(targets(sources.withColumn("n", F.coalesce("n", F.lit(0))), weights, ratio, cap))
    small = goals.count() <= BROADCAST_SOURCES
    joined = lambda a, b: a.join(F.broadcast(b) if small else b, "k")
    solved = cut(solve(cells, goals, cap, joined))

    unit = F.pmod(F.col("hash"), F.lit(1 << 40)) / float(1 << 40)
    full = F.col("target") >= cap * F.col("source_size")
    rate = F.when(F.col("lam").isNotNull(), tilt(F.col("lam"), F.col("size"), F.col("mean"), cap)).when(full & (F.col("source_size") > 0), F.lit(float(cap))).otherwise(0.0)
    r = joined(d, solved).withColumn("rate", rate).withColumn("_p", F.col("rate") + unit).withColumn("_c", F.least(F.floor("_p"), F.lit(cap)).cast("long"))
    r = cut(r.withColumn("_f", F.col("_p") - F.col("_c")).drop("_p", "lam", "mean"))

    # what is left: positive, to add; negative, to take away
    left = cut(r.groupBy("k").agg((F.max("target") - F.sum(F.col("_c") * F.col("size"))).alias("left")).withColumns({"sign": F.signum("left").cast("long"), "need": F.abs("left")}).select("k", "sign", "need"))
    top = 1 << (WIDTH * LEVELS)
    can = (F.col("size") > 0) & (((F.col("sign") > 0) & (F.col("_c") < cap)) | ((F.col("sign") < 0) & (F.col("_c") > 0)))
    order = F.least(F.floor(F.when(F.col("sign") > 0, 1 - F.col("_f")).otherwise(F.col("_f")) * top), F.lit(top - 1)).cast("long")
    fits = F.col("size") <= F.col("most")  # a document larger than all that is needed must not stop the walk
    state = left.withColumns({"at": F.lit(0).cast("long"), "most": F.col("need")})
    for level in range(1, LEVELS + 1):
        shift = WIDTH * (LEVELS - level)
        inside = F.lit(True) if level == 1 else F.shiftright(order, shift + WIDTH) == F.shiftright(F.col("at"), shift + WIDTH)
        part = joined(r, state).where(can & fits).withColumn("_o", order).where(inside).groupBy("k", F.shiftright("_o", shift).alias("b")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("k").orderBy("b"))  # at most 2**WIDTH rows a source
        run = part.withColumn("run", run).join(F.broadcast(state) if small else state, "k").where("run <= need").groupBy("k").agg(F.max("run").alias("run"), F.max("b").alias("b"))
        moved = F.col("b").isNotNull()
        state = cut(state.join(run, "k", "left").select("k", "sign", F.when(moved, F.col("need") - F.col("run")).otherwise(F.col("need")).alias("need"), F.when(moved, F.shiftleft(F.col("b") + 1, shift)).otherwise(F.col("at")).alias("at"), "most"))
    r = cut(joined(r, state).withColumn("_m", F.when(can & fits & (order < F.col("at")), F.col("sign")).otherwise(0)).drop("sign", "need", "at", "most", "_f"))

    # then by size, the largest first: as many documents of a size as still fit, one copy of each; again while copies can be moved that fit
    copies = F.col("_c") + F.col("_m")
    can = (F.col("size") > 0) & (((F.col("sign") > 0) & (copies < cap)) | ((F.col("sign") < 0) & (copies > 0)))
    place = F.shiftleft(F.least(F.abs("_m"), F.lit(7)).cast("long"), 60) + F.pmod(F.col("hash"), F.lit(1 << 60))  # documents not moved yet first
    nothing = F.struct(F.col("need").alias("need"), F.array().cast("array<struct<size:bigint,n:bigint,t:bigint>>").alias("t"))
    state = cut(state.select("k", "sign", "need"))

    def take(x, c):
        t = F.least(c["n"], F.floor(x["need"] / c["size"]))
        return F.struct((x["need"] - t * c["size"]).alias("need"), F.when(t > 0, F.concat(x["t"], F.array(F.struct(c["size"].alias("size"), c["n"].alias("n"), t.alias("t"))))).otherwise(x["t"]).alias("t"))

    while True:
        free = joined(r, state).where(can & (F.col("size") <= F.col("need")))
        sizes = free.groupBy("k", "sign", "need", "size").agg(F.count("*").alias("n"))
        plan = sizes.groupBy("k", "sign", "need").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("c"))  # sizes up to `need`
        plan = cut(plan.select("k", F.aggregate("c", nothing, take).alias("p")).select("k", F.col("p.need").alias("left"), "p.t"))
        if plan.isEmpty():
            break
        picks = cut(plan.select("k", F.explode("t").alias("t")).select("k", "t.*"))
        few = small and picks.count() <= BROADCAST_SOURCES
        met = lambda a, b, how="inner": a.join(F.broadcast(b) if few else b, ["k", "size"], how)  # noqa: B023, E731
        # the last document of a size that is taken in part; of other sizes all are
        rows = joined(r, state).where(can).select("k", "size", place.alias("q"))
        picks = cut(picks.join(nth(rows, picks.where("t < n"), ["k", "size"], met), ["k", "size"], "left"))
        hit = can & F.col("t").isNotNull() & (F.col("_last").isNull() | (place <= F.col("_last")))
        r = cut(met(joined(r, state), picks, "left").withColumn("_m", F.when(hit, F.col("_m") + F.col("sign")).otherwise(F.col("_m"))).select(r.columns))
        state = cut(state.join(plan, "k", "left").select("k", "sign", F.coalesce("left", "need").alias("need")))
    out = r.select("_row", "doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return out.join(stored.select("_row", "_kept.*"), "_row").drop("_row") if kept else out.drop("_row")
