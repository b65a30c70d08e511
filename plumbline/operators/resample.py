"""Resampling with a target draw that all sources of a case share.

Two designs. `index_draws` draws n positions with replacement (a multinomial): draw j of a replicate is the value of the
replicate's polynomial at j + 1, modulo n, as in SQL, in a session of any size. Rows are shuffled once, to spans of
positions that a task can hold; a span's task works out every draw of its session, counts those that fall into the span, and
only (case, source, replicate) sums leave it. With `size` the number of draws is split instead between halves of the range
of positions, again and again down to leaves of `size` positions, by binomial numbers that are keyed by replicate and range:
the same law and no work twice, but other draws than SQL's beyond one leaf. `poisson_draws` gives every
row a Poisson(1) weight for each replicate from a hash of its own key, without positions. Weights times features are matrix
products over Arrow batches. Both are keyed, so reruns and any partitioning agree.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import keyed

#: Numbers that one task may hold of a group it works on at once: 160 MB.
MOST = 20_000_000
#: Rows ranked by one task.
BUCKET = 1 << 18
#: Positions of a leaf, whose draws are made one by one.
LEAF = 8192
#: Numbers of a span of positions, and draws that are worked out at once.
SPAN, ROUND = MOST // 2, 1 << 20


def matrix(columns: list[pa.Array]) -> np.ndarray:
    """[row, feature]; nulls count as zero, as a sum leaves them out."""
    return np.column_stack([np.asarray(c.fill_null(0.0)) for c in columns]) if columns else np.zeros((0, 0))


def places(tag: str, replicates: int, draws: np.ndarray, n: int, step: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(replicate, positions drawn among n): for each replicate a polynomial of its own, at the number of each draw."""
    c = keyed.words(b"".join(hashlib.md5(f"{tag}|{b}".encode()).digest() for b in range(replicates)))
    j = np.arange(int(draws.max(initial=0)), dtype=np.int64)
    for b in range(replicates):
        yield b, keyed.values(c[b], j[: draws[b]] // step + 1) % n


@dataclass
class Leaf:
    """Draws that fall into one leaf: counts[replicate, position], and how many of a replicate fall before it."""

    counts: np.ndarray
    before: np.ndarray


def leaf_draws(n: int, leaf: int, tag: str, replicates: int, draws: int, size: int = LEAF) -> Leaf:
    """The part of `draws` draws from n positions that falls into a leaf: exactly multinomial over all leaves, in numpy's binomials.

    A range of leaves is split at its middle one; a split's numbers are keyed by `tag` and the range, so whoever asks for a
    leaf below gets the same. Sessions of one leaf have no splits.
    """
    leaves = -(-n // size)
    c, before = np.full(replicates, draws, np.int64), np.zeros(replicates, np.int64)
    lo, hi = 0, leaves
    while hi - lo > 1:
        mid = (lo + hi) // 2
        key = int.from_bytes(hashlib.md5(f"{tag}|{lo}-{hi}".encode()).digest(), "big")
        left = np.random.Generator(np.random.Philox(key=key)).binomial(c, (mid - lo) * size / (min(hi * size, n) - lo * size))
        if leaf < mid:
            c, hi = left, mid
        else:
            c, before, lo = c - left, before + left, mid
    own = min(n, (leaf + 1) * size) - leaf * size
    counts = np.empty((replicates, own), np.int32)
    for b, at in places(tag if leaves == 1 else f"{tag}|{leaf}", replicates, c, own):
        counts[b] = np.bincount(at, minlength=own)
    return Leaf(counts, before)


def block_draws(n: int, leaf: int, tag: str, replicates: int, block: int, size: int = LEAF) -> np.ndarray:
    """counts[replicate, position of the leaf] of circular moving blocks: ceil(n / block) starts, each with `block` positions from it on, wrapped; the last one is cut so that n are drawn in all."""
    lo, hi = leaf * size, min(n, (leaf + 1) * size)
    if n <= size:
        out = np.empty((replicates, n), np.int32)
        j = np.arange(n)
        for b, at in places(tag, replicates, np.full(replicates, n), n, block):
            out[b] = np.bincount((at + j % block) % n, minlength=n)
        return out
    whole = n // block  # starts of uncut blocks
    steps = np.zeros((replicates, hi - lo + 1), np.int64)  # how the number of blocks over a position changes
    first = lo - min(block, n) + 1
    near = range(first // size, (hi - 1) // size + 1) if first >= 0 else {*range((hi - 1) // size + 1), *range(first % n // size, -(-n // size))}
    for k in near:
        starts = np.arange(k * size, min(n, (k + 1) * size))
        c = leaf_draws(n, k, tag, replicates, whole, size).counts
        for wrap in (-n, 0, n):
            begin, end = np.clip(starts + wrap - lo, 0, hi - lo), np.clip(starts + wrap + block - lo, 0, hi - lo)
            over = np.flatnonzero(end > begin)
            np.add.at(steps, (slice(None), begin[over]), c[:, over])
            np.subtract.at(steps, (slice(None), end[over]), c[:, over])
    out = np.cumsum(steps, axis=1)[:, :-1].astype(np.int32)
    if rest := n % block:
        for b in range(replicates):
            key = int.from_bytes(hashlib.md5(f"{tag}|{b}|last".encode()).digest()[:8], "big")
            at = (key * n >> 64) + np.arange(rest)
            at = at % n - lo
            np.add.at(out[b], at[(at >= 0) & (at < hi - lo)], 1)
    return out


def drawn_between(n: int, lo: int, hi: int, tag: str, replicates: int, draws: int, block: int = 1) -> Iterator[tuple[np.ndarray, int]]:
    """For each replicate, how often each of the positions lo to hi - 1 is drawn when `draws` are drawn from n, and how many draws fall before lo: SQL's draws, all of them worked out, some at a time. `block`: as in `block_draws`."""
    c = keyed.words(b"".join(hashlib.md5(f"{tag}|{b}".encode()).digest() for b in range(replicates)))
    for b in range(replicates):
        counts, before = np.zeros(hi - lo, np.int64), 0
        for first in range(0, draws, ROUND):
            at = np.empty(min(draws - first, ROUND), np.int64)
            for k in range(0, len(at), LEAF):  # what stays in a core's cache
                j = np.arange(first + k, first + min(k + LEAF, len(at)))
                own = keyed.values(c[b], j // block + 1) % n
                at[k : k + LEAF] = own if block == 1 else (own + j % block) % n
            if hi - lo < n:
                before += int(np.count_nonzero(at < lo))
                at = at[(at >= lo) & (at < hi)]
            counts += np.bincount(at - lo, minlength=hi - lo)
        yield counts, before


def weights_of(n: int, leaf: int, tag: str, replicates: int, block: int = 1, size: int = LEAF) -> np.ndarray:
    """How often each position of a leaf is drawn, [replicate, position], when n are drawn from n."""
    return leaf_draws(n, leaf, tag, replicates, n, size).counts if block == 1 else block_draws(n, leaf, tag, replicates, block, size)


def index_draws(trials: DataFrame, features: list[str], replicates: int, seed: int, shared: bool = True, block: int = 1, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, targets) of replicate means: (case_id, source, b, n, features) and (case_id[, source], b, n, features).

    `block` over 1: circular moving blocks (R5). `shared` false: a target draw for each source (the wrong-target ablation,
    R3). Positions `i` of a session run from 0 to n - 1; a session may have any number of rows. `size`: draws are split between
    leaves of so many positions, else they are SQL's.
    """
    both = pools(trials, features, shared)
    out = [drawn(p, "_v", replicates, seed, tag, block, size).select("case_id", "source", "b", "n", *[F.col("_v")[k].alias(f) for k, f in enumerate(features)]) for p, tag in both]
    return out[0].where("b >= 0"), (out[1].drop("source") if shared else out[1]).where("b >= 0")


def pools(trials: DataFrame, values: list[str] | str, shared: bool) -> list[tuple[DataFrame, str]]:
    """(rows with case_id, source, i, the values as an array, tag) of the sources, and of the targets: once, or for each source."""
    v = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in values]).alias("_v") if isinstance(values, list) else F.col(values)
    s = trials.where("not is_target").select("case_id", "source", "i", v)
    t = trials.where("is_target").select("case_id", F.lit(-1).cast(trials.schema["source"].dataType).alias("source"), "i", v)
    if not shared:
        t = t.drop("source").join(s.select("case_id", "source").distinct(), "case_id")
    return [(s, "s"), (t, "t")]


def drawn(pool: DataFrame, vector: str, replicates: int, seed: int, tag: str, block: int = 1, size: int | None = None) -> DataFrame:
    """(case_id, source, b, n, vector): replicate means of an array column; b = -1 holds the plain ones. Arrays of a pool have one length."""
    n = pool.groupBy("case_id", "source").agg(F.max("i").alias("_last"), F.max(F.size(vector)).alias("_width"))
    span = F.lit(size) if size else F.greatest(F.floor(F.lit(SPAN) / F.greatest("_width", F.lit(1))), F.lit(1))
    rows = pool.join(n, ["case_id", "source"]).select("case_id", "source", tagged(pool, seed, tag).alias("_tag"), "i", (F.col("_last") + 1).cast("long").alias("n"), vector, span.cast("long").alias("_span"))
    rows = rows.withColumn("_leaf", F.floor(F.col("i") / F.col("_span")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for g in batches:
            if x is None:
                kinds, first = g.schema, {k: g.column(k)[0].as_py() for k in ("case_id", "source", "_tag", "n", "_span", "_leaf")}
                total, lo = first["n"], first["_leaf"] * first["_span"]
                hi = min(total, lo + first["_span"])
                x = np.zeros((hi - lo, len(g.column(vector)[0])))
            # each row at its position: sums do not depend on the order of arrival
            x[g.column("i").to_numpy() - lo] = g.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(g.num_rows, -1)
        if size:
            sums = [weights_of(total, first["_leaf"], first["_tag"], replicates, block, size) @ x]
        else:
            sums, each = [], max(1, SPAN // 4 // len(x))  # replicates to one product
            found = drawn_between(total, lo, hi, first["_tag"], replicates, total, block)
            while len(w := [counts for counts, _ in itertools.islice(found, each)]):
                sums.append(np.array(w, float) @ x)
        m = np.vstack([x.sum(0), *sums]) / total
        key = [pa.array([first[k]] * len(m), kinds.field(k).type) for k in ("case_id", "source")]
        yield pa.RecordBatch.from_arrays([*key, pa.array(np.arange(-1, replicates), pa.int32()), pa.array([total] * len(m)), pa.array(list(m), pa.list_(pa.float64()))], names=["case_id", "source", "b", "n", vector])

    schema = StructType([pool.schema["case_id"], pool.schema["source"], StructField("b", IntegerType()), StructField("n", LongType()), StructField(vector, ArrayType(DoubleType()))])
    parts = rows.groupBy("case_id", "source", "_leaf").applyInArrow(run, schema)
    return array_sums(parts, ["case_id", "source", "b", "n"], vector)


def array_sums(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Sums of an array column, place by place, with map-side sums."""
    s = df.select(*by, F.posexplode(vector).alias("_k", "_x")).groupBy(*by, "_k").agg(F.sum("_x").alias("_x"))
    return s.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_x"))), lambda p: p["_x"]).alias(vector))


def poisson_draws(trials: DataFrame, features: list[str], replicates: int, seed: int, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same tables from Poisson weights of the rows, keyed by `key`: partial sums leave each task, never rows."""
    group = ["case_id", "source", "is_target"]
    rows = trials.select(*group, *[F.col(f).cast("double").alias(f) for f in features], keyed.coefficients(seed, *[F.col(k) for k in key]).alias("_c"))
    schema = StructType([*(trials.schema[k] for k in group), StructField("b", IntegerType()), StructField("n", DoubleType()), *[StructField(f, DoubleType()) for f in features]])
    g = np.arange(1, replicates + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for k, x in sums.items():
                fixed = [pa.array([v] * replicates, kinds[c]) for v, c in zip(k, group, strict=True)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(g - 1, pa.int32()), *map(pa.array, x.T)], names=[*group, "b", "n", *features])
            sums.clear()

        for b in batches:
            kinds = {c: b.schema.field(c).type for c in group}
            x = np.column_stack([np.ones(b.num_rows), *[np.asarray(b.column(f).fill_null(0.0)) for f in features]])
            c = keyed.words(b"".join(b.column("_c").to_pylist()))
            codes = [b.column(k).dictionary_encode() for k in group]
            known = [d.dictionary.to_pylist() + [None] for d in codes]  # a null key is a key of its own
            number = np.zeros(b.num_rows, np.int64)
            for d, names in zip(codes, known, strict=True):
                number = number * len(names) + np.asarray(d.indices.fill_null(len(names) - 1))
            order = np.argsort(number, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(number[order])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at, name = int(number[order[lo]]), []
                for names in reversed(known):
                    at, k = divmod(at, len(names))
                    name.append(names[k])
                total = sums.setdefault(tuple(reversed(name)), np.zeros((replicates, len(features) + 1)))
                total += keyed.weighted_sums(c[order[lo:hi]], g, x[order[lo:hi]])
            if len(sums) * replicates * (len(features) + 1) > MOST // 4:
                yield from told()
        yield from told()

    sums = rows.mapInArrow(run, schema).groupBy(*group, "b").agg(*[F.sum(f).alias(f) for f in ("n", *features)])
    means = sums.where("n > 0").select(*group, "b", F.col("n").cast("long").alias("n"), *[(F.col(f) / F.col("n")).alias(f) for f in features])
    return means.where("not is_target").drop("is_target"), means.where("is_target").drop("is_target", "source")


def tagged(pool: DataFrame, seed: int, tag: str) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col("case_id").cast("string"), F.col("source").cast("string"))


def vector_draws(trials: DataFrame, vector: str, replicates: int, seed: int, shared: bool = True, block: int = 1, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """index_draws of an array column: (case_id, source, b, n, vector) and (case_id[, source], b, n, vector); row b = -1 holds the plain means."""
    s, t = (drawn(p, vector, replicates, seed, tag, block, size) for p, tag in pools(trials, vector, shared))
    return s, t.drop("source") if shared else t


def multinomial_counts(trials: DataFrame, replicates: int, seed: int, size: int = LEAF) -> DataFrame:
    """(case_id, source, b, i, w): how often each position is drawn; positions never drawn are absent (R2)."""
    n = trials.groupBy("case_id", "source").agg(F.count("*").alias("n"))
    leaves = n.select("case_id", "source", "n", tagged(n, seed, "w").alias("_tag"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("_leaf")).repartition("case_id", "source", "_leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in batches:
            for k in range(g.num_rows):
                row = {c: g.column(c)[k].as_py() for c in g.schema.names}
                w = weights_of(row["n"], row["_leaf"], row["_tag"], replicates, 1, size)
                b, i = np.nonzero(w)
                key = [pa.array([row[c]] * len(b), g.schema.field(c).type) for c in ("case_id", "source")]
                yield pa.RecordBatch.from_arrays([*key, pa.array(b, pa.int32()), pa.array(i + row["_leaf"] * size), pa.array(w[b, i].astype(np.int64))], names=["case_id", "source", "b", "i", "w"])

    kinds = {c: trials.schema[c].dataType.simpleString() for c in ("case_id", "source")}
    return leaves.mapInArrow(run, f"case_id {kinds['case_id']}, source {kinds['source']}, b int, i long, w long")


def outer_samples(trials: DataFrame, vector: str, replicates: int, seed: int, source: float = 1.0, target: float = 0.5, size: int | None = None) -> DataFrame:
    """(case_id = case/replicate, source, is_target, i, vector): each session drawn with replacement, `outer_size` rows of it.

    A row appears as often as it is drawn; positions follow those it was drawn from, copies in a row. Sizes of replicates
    are one; no drawn position is looked up. `size`: as in `index_draws`.
    """
    each = size or LEAF
    n = trials.groupBy("case_id", "source", "is_target").agg(F.max("i").alias("_last"))
    m = F.when(F.col("is_target"), outer_size(F.col("n"), target)).otherwise(outer_size(F.col("n"), source))
    n = n.withColumn("n", (F.col("_last") + 1).cast("long")).withColumn("_m", m).drop("_last")
    rows = trials.join(n, ["case_id", "source", "is_target"]).select("case_id", "source", "is_target", tagged(trials, seed, "o").alias("_tag"), "i", "n", "_m", vector, F.floor(F.col("i") / each).alias("_leaf"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        n, leaf, tag, m = (group.column(k)[0].as_py() for k in ("n", "_leaf", "_tag", "_m"))
        lo, hi = leaf * each, min(n, (leaf + 1) * each)
        found = leaf_draws(n, leaf, tag, replicates, m, size) if size else Leaf(*map(np.array, zip(*drawn_between(n, lo, hi, tag, replicates, m), strict=True)))
        w = found.counts[:, group.column("i").to_numpy() - lo]
        b = np.repeat(np.arange(replicates), w.sum(1))
        row = np.concatenate([np.repeat(np.arange(group.num_rows), w[k]) for k in range(replicates)])
        i = np.concatenate([found.before[k] + np.arange(w[k].sum()) for k in range(replicates)])
        case = pa.array([f"{group.column('case_id')[0].as_py()}/{k}" for k in b], pa.string())
        taken = group.select(["source", "is_target", vector]).take(pa.array(row))
        return pa.table({"case_id": case, "source": taken.column("source"), "is_target": taken.column("is_target"), "i": pa.array(i), vector: taken.column(vector)})

    schema = StructType([StructField("case_id", StringType()), trials.schema["source"], trials.schema["is_target"], StructField("i", LongType()), trials.schema[vector]])
    return rows.groupBy("case_id", "source", "is_target", "_leaf").applyInArrow(run, schema)


def outer_size(n: Column, fraction: float, least: int = 8) -> Column:
    """max(least, round half even (fraction n))."""
    return F.greatest(F.lit(least), F.bround(n * fraction).cast("long"))


def half_splits(trials: DataFrame, splits: int, seed: int, unit: list[str], label: str = "label") -> DataFrame:
    """(unit columns, split, role): for each split and label half of a group's rows, by hash order, screen and the others test.

    unit: the group's columns, then the row's key as the last one. No class is sorted in one task: rows are ranked inside
    buckets of their hash, as many as the largest class needs, and shifted by the counts of the buckets before.
    """
    group, row = unit[:-1], unit[-1]
    most = trials.groupBy(*group, label).count().agg(F.max("count")).first()[0] or 0
    buckets = min(1 << 16, max(1, -(-most // BUCKET)))
    h = keyed.digest(seed, F.col("split"), F.col(row))
    d = trials.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("_h", h).withColumn("_b", F.shiftright(keyed.word(F.col("_h"), 0, 4) * buckets, 16))
    sets = [*group, "split", label]
    whole = Window.partitionBy(*sets)
    sizes = d.groupBy(*sets, "_b").agg(F.count("*").alias("_k"))  # a row for each bucket
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in sets], F.col("_b").alias("_bucket"), (F.sum("_k").over(whole.orderBy("_b")) - F.col("_k")).alias("_before"), F.sum("_k").over(whole).alias("_n"))
    d = d.withColumn("_own", F.row_number().over(Window.partitionBy(*sets, "_b").orderBy("_h", row)))
    d = d.join(sizes, [F.col("_b") == F.col("_bucket"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in sets]])
    role = F.when((F.col("_before") + F.col("_own")) * 2 <= F.col("_n"), "screen").otherwise("test")
    return d.select(*trials.columns, "split", role.alias("role"))
