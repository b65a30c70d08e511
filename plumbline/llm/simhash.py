"""SimHash near-duplicates: 64-bit fingerprints, exact Hamming joins by sharded vantage-point trees, components.

A pair within four differing bits differs in at most one bit of some one of three bands (21, 21 and 22 bits: two or more
in each would make six). So three vantage-point trees are built, each over one band's Hamming metric and each asked for
radius 1 only, which a triangle bound prunes far better than radius 4 over all 64 bits. The top of each tree comes from a
bounded sample of fingerprints and defines shards; a fingerprint goes to its own leaf, and as a query to every other leaf
that its ball of radius 1 can overlap. Inside a shard the tree goes on down to small leaves, where whole fingerprints are
compared exactly. A shard returns a spanning star of each group it found instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, slices
from .components import components

BANDS = ((0, 21), (21, 21), (42, 22))  # shift, bits
SHINGLE_WORDS = 4
SEED = 42


def fingerprint_array(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints as signed 64-bit numbers. Bytes suffice: the contract's white space and its lower-casing are ASCII only."""
    from xxhash import xxh64_intdigest

    n, room = SHINGLE_WORDS, 1 << 17
    counts = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[int] = []
    sizes: list[int] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *sizes[:-1]])
            np.add.at(counts, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.uint32))
            np.add.at(total, owners, sizes)
        held.clear(), owners.clear(), sizes.clear()

    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        if len(words) <= n:
            hashes = [xxh64_intdigest(b" ".join(words), SEED)]
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-n]])
            hashes = [xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts.tolist(), (ends[n - 1 :] - 1).tolist(), strict=True)]
        for at in range(0, len(hashes), room):
            part = hashes[at : at + room]
            held += part
            owners.append(i)
            sizes.append(len(part))
            if len(held) >= room:
                flush()
    flush()
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `fp` of every row. Null and empty texts have fingerprint zero; a text of any length is taken whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = fingerprint_array(b.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp, pa.int64())], names=[*keep, "_dup_fp"])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField("_dup_fp", LongType())]))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def band(fp: np.ndarray, k: int) -> np.ndarray:
    shift, bits = BANDS[k]
    return (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)


@dataclass
class Tree:
    """The top of a vantage-point tree: vantage, radius and children of each node; a negative child -1-s is shard s."""

    vantage: np.ndarray
    radius: np.ndarray
    children: np.ndarray


def plant(points: np.ndarray, leaf: int) -> Tree:
    """One tree over the band values of a sample, down to `leaf` of them."""
    nodes: list[list[int]] = []
    shards = 0
    todo: list[tuple[np.ndarray, int, int]] = [(points, -1, 0)]  # points, parent, which child
    while todo:
        p, parent, side = todo.pop()
        at = None
        if len(p) > leaf:
            for v in p[: min(8, len(p))]:
                d = popcount(p ^ v)
                mu = int(np.median(d))
                mu -= int(mu >= d.max())
                if d.min() <= mu < d.max():
                    at = len(nodes)
                    nodes.append([int(v), mu, 0, 0])
                    todo += [(p[d > mu], at, 3), (p[d <= mu], at, 2)]
                    break
        if at is None:
            shards += 1
            at = -shards
        if parent >= 0:
            nodes[parent][side] = at
    x = np.array(nodes, np.int64).reshape(-1, 4)
    return Tree(x[:, 0].astype(np.uint64), x[:, 1].astype(np.int16), x[:, 2:].astype(np.int32))


def route(fp: np.ndarray, tree: Tree, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows, at home): by the triangle bound a ball reaches inside if d <= mu + radius, outside if d > mu - radius."""
    todo = [(0 if len(tree.radius) else -1, np.arange(len(fp)), np.ones(len(fp), bool))]
    while todo:
        k, rows, home = todo.pop()
        if k < 0:
            yield -1 - k, rows, home
        elif len(rows):
            mu = tree.radius[k]
            d = popcount(fp[rows] ^ tree.vantage[k])
            for child, reach, own in ((tree.children[k, 0], d <= mu + radius, d <= mu), (tree.children[k, 1], d > mu - radius, d > mu)):
                todo.append((int(child), rows[reach], home[reach] & own[reach]))


class Forest:
    """Union by smallest index, in bulk."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while True:
            y = self.up[x]
            if np.array_equal(x, y):
                return x
            x = y

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def join_shard(fp: np.ndarray, home: np.ndarray, k: int, most: int, forest: Forest, leaf: int = 48, cells: int = 1 << 21) -> None:
    """Connect each point at home with all rows of a shard that are within `most` bits, by a tree over band k with radius 1.

    A dense group is not compared pair by pair: what lies within `most` of a pivot is one group at once, and a row near it
    needs one link only.
    """
    b = band(fp, k)
    todo = [(np.flatnonzero(home), np.arange(len(fp)), False)]
    while todo:
        p, q, whole = todo.pop()
        if not len(p) or not len(q):
            continue
        key, radius = (fp, most) if whole else (b, 1)
        if len(p) > leaf:
            split = False
            for at in p[:: max(1, len(p) // 8)][:8]:
                v = key[at]
                d = popcount(key[p] ^ v)
                if whole and np.count_nonzero(d <= most) * 4 > len(p):
                    dq = popcount(fp[q] ^ v)
                    near, shell, inner = q[dq <= most], q[(dq > most) & (dq <= 2 * most)], p[d <= most]
                    forest.link(near, np.full(len(near), at))
                    step = max(1, cells // max(1, len(shell)))
                    for lo in range(0, len(inner), step):
                        met = (popcount(fp[shell][:, None] ^ fp[inner[lo : lo + step]][None, :]) <= most).any(1)
                        forest.link(shell[met], np.full(np.count_nonzero(met), at))
                        shell = shell[~met]
                        if not len(shell):
                            break
                    todo.append((p[d > most], q, True))
                    split = True
                    break
                mu = int(np.median(d))
                mu -= int(mu >= d.max())
                if d.min() <= mu < d.max():
                    dq = popcount(key[q] ^ v)
                    todo.append((p[d <= mu], q[dq <= mu + radius], whole))
                    todo.append((p[d > mu], q[dq > mu - radius], whole))
                    split = True
                    break
            if split:
                continue
            if not whole:  # one band value: go on with the whole fingerprint and its radius
                todo.append((p, q, True))
                continue
        step = max(1, cells // len(p))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, j = np.nonzero(popcount(fp[part][:, None] ^ fp[p][None, :]) <= most)
            forest.link(part[i], p[j])


def near_pairs(nodes: DataFrame, most: int = 4, shard_size: int = 4096, sample: int = 1 << 18) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints `fp` of `nodes` that connect exactly those within `most` (at most 5) bits.

    Shards grow in number with the fingerprints: vantage points come from a hash sample of 32 for each shard, at most
    `sample` of them (2 MB on the driver), which gives up to half as many shards a tree and never limits what is compared.
    A ball of radius 1 holds 22 or 23 band values, so a fingerprint goes to 67 shards of the three trees at most.
    """
    if not 0 <= most < 2 * len(BANDS):
        raise ValueError("three bands with radius 1 prove at most 5 differing bits")
    n = nodes.count()
    shards = max(1, -(-n // shard_size))
    wanted = min(sample, max(4096, 32 * shards))
    h = F.pmod(F.xxhash64("fp"), F.lit(1 << 40))
    some = nodes.where(h / float(1 << 40) < min(1.0, (1.2 * wanted + 100) / max(1, n))).select("fp").orderBy(h, "fp").limit(wanted)
    seen = some.toArrow().column("fp").to_numpy().view(np.uint64)
    trees = [plant(band(seen, k), max(2, len(seen) // shards)) for k in range(len(BANDS))]
    held = nodes.sparkSession.sparkContext.broadcast([(t.vantage, t.radius, t.children) for t in trees])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ready = 0

        def told() -> pa.RecordBatch:
            shard, fp, home = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp), pa.array(home)], names=["shard", "fp", "home"])

        def dealt(signed: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal ready
            fp = signed.view(np.uint64)
            for k, parts in enumerate(held.value):
                for shard, at, home in route(band(fp, k), Tree(*parts), 1):
                    if len(at):
                        out.append((np.full(len(at), shard * len(BANDS) + k, np.int32), signed[at], home))
                        ready += len(at)
                        if ready >= 1 << 18:
                            ready = 0
                            yield told()

        for b in batches:  # many at once: a tree's nodes are visited once for all of them
            rows.append(b.column(0).to_numpy())
            if sum(map(len, rows)) >= 1 << 20:
                yield from dealt(np.concatenate(rows))
                rows.clear()
        if rows:
            yield from dealt(np.concatenate(rows))
        if out:
            yield told()

    def match(group: pa.Table) -> pa.Table:
        signed = group.column("fp").to_numpy()
        order = np.argsort(signed, kind="stable")
        signed = signed[order]
        home = group.column("home").to_numpy()[order]
        forest = Forest(len(signed))
        join_shard(signed.view(np.uint64), home, group.column("shard")[0].as_py() % len(BANDS), most, forest)
        root = forest.find(np.arange(len(signed)))
        linked = np.flatnonzero(root != np.arange(len(signed)))
        return pa.table({"a": signed[linked], "b": signed[root[linked]]})

    return nodes.select("fp").mapInArrow(spread, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(match, "a long, b long")


def grouped(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, rep, root) of every fingerprint: its smallest doc_id (null if no row has one) and its component.

    Copies meet in one node, with map-side combining, before anything is compared. Nodes are fingerprints, so rows without an id link like others.
    """
    prints = cut(fingerprints(docs).withColumnRenamed("_dup_fp", "fp"))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(near_pairs(reps, most))
    return prints, cut(reps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of `docs`.

    Fingerprints link at `most` or fewer differing bits; component_id is the smallest doc_id reachable. Null and empty
    texts share fingerprint zero and so one component. Rows without an id get a fingerprint and link like others; their
    component is the smallest id reachable (null if none has one). Ids may be of any type that has an order. Repeated
    rows stay; an empty table gives an empty one; other columns are not read.
    """
    prints, roots = grouped(docs, most)
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = cut(roots.join(least, "root").select(F.col("fp").alias("_dup_fp"), "component_id"))
    return prints.join(ids, F.col("fp") == F.col("_dup_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, most: int = 4) -> DataFrame:
    """One row of each component of near-duplicates: that of the smallest doc_id; null ids come last.

    Of rows that share that id and fingerprint the smallest by all columns stays, once. Null and empty texts are one
    component. An empty table gives an empty one; columns of any name are kept as they are.
    """
    names = docs.columns
    prints, roots = grouped(docs, most)
    first = cut(roots.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("n"), "rep", "fp")).alias("c")).select(F.col("root").alias("_dup_root"), F.col("c.rep").alias("_dup_first"), F.col("c.fp").alias("_dup_at")))
    odd = cut(prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_dup_id")))
    near = prints.join(roots.join(first, F.col("root") == F.col("_dup_root")).select(F.col("fp").alias("_dup_fp"), "_dup_first"), F.col("fp") == F.col("_dup_fp"))
    gone = near.where("doc_id <> _dup_first").select(F.col("doc_id").alias("_dup_id")).unionByName(odd).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("_dup_id"), "left_anti")
    if odd.isEmpty():
        return kept
    rows = fingerprints(docs.join(odd, F.col("doc_id").eqNullSafe(F.col("_dup_id")), "left_semi"), tuple(names))
    met = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_dup_first")) & (F.col("_dup_fp") == F.col("_dup_at")))
    again = met.groupBy("_dup_root").agg(F.min(F.struct(*names)).alias("_c")).select("_c.*")
    return kept.where("doc_id is not null").unionByName(again)
