"""Near-duplicates by Jaccard similarity of word shingles: a chosen-path join, exact confirmation, components.

Texts with one and the same set are one node. A node's minwise tokens are the least values of `TOKENS` hash functions over
its set; two sets agree in a share of them that is their similarity. A tree of paths branches a node by each of its tokens
that a hash of path and token selects, with a chance that makes 1 / LEAN branches on average: similar sets go on together,
others part. Places of a tree where few meet are compared exhaustively (by tokens, which is a filter); at larger ones nodes
near a pivot are settled by a triangle bound and the others branch again; at the greatest depth all that still meet count as
candidates. `trees` independent trees are united.

Candidates become groups, and a node's full set travels once, to its group. There links are confirmed on full sets. A group
that is too large for a task is dealt into blocks: each with some pivots of all, then what is not in a block's largest
component against all blocks. Only confirmed links leave a task, as many as connect what is connected.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, bits_of, checkpoint_dir, cut, mixed, removed, slices, tasks_for, written
from .components import components
from .simhash import Forest

TOKENS = 64
#: Chance of a token to be chosen: 1 / (LEAN x TOKENS). Under the least similarity, so that a similar pair's common branches grow in number.
LEAN = 0.7
#: Agreeing tokens of a candidate: of 64, a pair at similarity 0.8 has fewer than 36 in three of a million cases.
LEAST_AGREEING = 36
#: Agreement with the pivot of a crowded place: from the first on a node is settled, from the second on a candidate. By the
#: triangle bound of Jaccard distances, whoever is similar (0.2 away) to a node 0.45 from the pivot is within 0.65 of it.
SETTLED, TOUCHED = 45, 20
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit numbers of the distinct shingles; fewer words than one shingle has: the whole sequence; none: empty."""
    from xxhash import xxh64_intdigest

    w = text.lower().split() if text else []  # white space and letter case of bytes are the contract's
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxh64_intdigest(b" ".join(w))], np.uint64)
    if words == 2:
        found = {a + b" " + b for a, b in zip(w[:-1], w[1:], strict=True)}
    else:
        found = {b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)}
    return np.unique(np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)))


def minwise(h: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Sixteen middle bits of the least value of each hash function over a set."""
    keys = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * A) | np.uint64(1)
    least = np.full(TOKENS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(h), block):
        np.minimum(least, np.min(mixed(h[at : at + block])[:, None] * keys, axis=0), out=least)
    return (least >> np.uint64(20)).astype(np.uint16)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, digest, tokens, sketch, shingles) of every row; the last three are numbers laid end to end, a sketch being the tokens' lower bytes. Empty sets have no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for b in slices(batches, "text"):
            found = [shingle_set(t, words) for t in b.column("text").cast(pa.binary()).to_pylist()]
            tokens = [minwise(h) if len(h) else None for h in found]
            cells = [(blake2b(h.tobytes(), digest_size=16).digest(), t.tobytes(), t.astype(np.uint8).tobytes(), h.tobytes()) if len(h) else (None,) * 4 for h, t in zip(found, tokens, strict=True)]
            n = pa.array([len(h) for h in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, *[pa.array([c[k] for c in cells], pa.binary()) for k in range(4)]], names=["doc_id", "n", "digest", "tokens", "sketch", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, digest binary, tokens binary, sketch binary, shingles binary")


def branched(rows: DataFrame, trees: int, levels: int = 1) -> DataFrame:
    """(node, place): a row for each branch that a node's tokens choose at its `place`, `levels` levels down; without that column, from the roots of all trees."""
    limit = np.uint64(int(2**64 / (LEAN * TOKENS)))
    salt = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
    rooted = "place" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 13):
                part = b.slice(at, 1 << 13)
                tokens = mixed(numbers_of(part.column("tokens")).astype(np.uint64) + salt)
                node = part.column("node").to_numpy()
                starts = [np.full(len(node), root) for root in mixed(np.arange(1, trees + 1, dtype=np.uint64))] if rooted else [part.column("place").to_numpy().view(np.uint64)]
                for place in starts:
                    at_row = np.arange(len(node))
                    for _ in range(levels):
                        child = mixed(mixed(place + B)[:, None] + tokens[at_row])
                        i, k = np.nonzero(mixed(child + A) < limit)
                        at_row, place = at_row[i], child[i, k]
                    yield pa.RecordBatch.from_arrays([pa.array(node[at_row]), pa.array(place.view(np.int64))], names=["node", "place"])

    return rows.select("node", "tokens", *([] if rooted else ["place"])).mapInArrow(run, "node long, place long")


def numbers_of(tokens: pa.Array) -> np.ndarray:
    """[node, token] of a column of minwise tokens."""
    return np.frombuffer(b"".join(tokens.to_pylist()), np.uint16).reshape(-1, TOKENS)


def alike(rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes of one place that agree in enough tokens, to the least of them, so that places tell the same links; places are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(place: np.ndarray, node: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
            forest = Forest(len(node))
            for step in range(1, len(node)):
                i = np.flatnonzero(place[step:] == place[:-step])
                if not len(i):
                    break  # places are sorted: none has more rows than this
                for at in range(0, len(i), 1 << 16):
                    j = i[at : at + (1 << 16)]
                    j = j[(tokens[j] == tokens[j + step]).sum(1) >= LEAST_AGREEING]
                    forest.link(j, j + step)
            root = forest.find(np.arange(len(node)))
            linked = np.flatnonzero(root != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"])

        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TOKENS), np.uint8)
        for b in batches:
            own = b.column("place").to_numpy(), b.column("node").to_numpy(), np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
            place, node, tokens = (np.concatenate([x, y]) for x, y in zip(held, own, strict=True))
            whole = np.searchsorted(place, place[-1]) if len(place) else 0  # the last place may go on in the next batch
            yield told(place[:whole], node[:whole], tokens[:whole])
            held = place[whole:], node[whole:], tokens[whole:]
        yield told(*held)

    return rows.select("place", "node", "sketch").repartition("place").sortWithinPartitions("place", "node").mapInArrow(run, "a long, b long")


def against_pivots(crowded: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, place, pivot, agreeing) of the rows of crowded places (node, place, _h, _least): tokens shared with the place's pivot, the node of least hash there."""
    pivots = crowded.where(F.col("_h") == F.col("_least")).select("place", "node").join(nodes.drop("sketch"), "node").select("place", F.col("node").alias("pivot"), F.col("tokens").alias("_other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            agreeing = (numbers_of(b.column("tokens")) == numbers_of(b.column("_other"))).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("place"), b.column("pivot"), pa.array(agreeing.astype(np.int32))], names=["node", "place", "pivot", "agreeing"])

    rows = crowded.select("node", "place").join(nodes.drop("sketch"), "node").join(pivots, "place")
    return rows.select("node", "place", "pivot", "tokens", "_other").mapInArrow(run, "node long, place long, pivot long, agreeing int")


def candidates(nodes: DataFrame, trees: int, few: int, levels: int = 3) -> DataFrame:
    """Links (a, b) between `nodes` (node, tokens, sketch) whose components hold every similar pair that some tree keeps together.

    The first look is at a depth where unlike sets rarely meet, which grows with the logarithm of their number; `levels` more
    follow for crowded places. There a pivot comes first: what is near it is settled, and what that could be similar to is
    linked with the pivot, so that a large group of near copies is not branched over and over.
    """
    total = nodes.count()
    start = max(2, math.ceil(math.log(max(2, total), 128)))
    spark = nodes.sparkSession
    place = branched(nodes, trees, start)
    links, tasks = [], tasks_for(total * trees)
    for depth in range(levels + 1):
        home = [f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("paths", "shared")]
        place.write.parquet(home[0])
        place = spark.read.parquet(home[0]).withColumn("_h", F.xxhash64("node", "place"))  # another pivot in each place
        met = place.groupBy("place").agg(F.count("*").alias("_met"), F.min("_h").alias("_least")).where("_met > 1")
        place.join(met, "place").coalesce(tasks).write.parquet(home[1])  # read twice, and far fewer rows
        removed(spark, home[0])
        shared = spark.read.parquet(home[1])
        tasks = tasks_for(max(shared.count(), total))  # all nodes are read beside them
        links.append(cut(alike(shared.where(F.col("_met") <= few).join(nodes.drop("tokens"), "node")).coalesce(tasks)))
        judged = cut(against_pivots(shared.where(F.col("_met") > few), nodes).coalesce(tasks))
        removed(spark, home[1])
        touched = judged.where(F.col("agreeing") >= TOUCHED)  # all linked with the pivot, so with the least of them
        touched = touched.join(touched.groupBy("place").agg(F.min("node").alias("_low")), "place").where(F.col("node") != F.col("_low"))
        links.append(cut(touched.select(F.col("node").alias("a"), F.col("_low").alias("b")).coalesce(tasks).distinct().coalesce(tasks)))
        crowded = judged.where(F.col("agreeing") < SETTLED).select("node", "place", "pivot")
        if depth == levels:
            links.append(crowded.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        elif crowded.isEmpty():
            break
        else:
            place = branched(crowded.join(nodes, "node").coalesce(tasks), trees)
    return reduce(DataFrame.unionByName, links)


def confirmed(node: np.ndarray, sets: list[np.ndarray], percent: int, label: np.ndarray, active: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected by pairs with 100 |and| >= percent |or|, one end of each being `active`.

    Rows of one `label` are connected already. A row is compared with all rows that are not yet in its component at once:
    by the sizes first, then by how many of their shingles it holds.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    node, size, label, active = node[order], size[order], label[order], active[order]
    flat = np.concatenate([sets[k] for k in order]) if len(order) else np.zeros(0, np.uint64)
    values, number = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(values), bool)
    up = np.unique(label, return_inverse=True)[1]
    out = []
    for k in range(len(node)):
        lo, hi = np.searchsorted(size, [-(-percent * size[k] // 100), 100 * size[k] // percent + 1])
        other = np.flatnonzero((up[lo:hi] != up[k]) & (active[lo:hi] | active[k])) + lo
        if not len(other):
            continue
        mark[number[starts[k] : starts[k + 1]]] = True
        before = np.cumsum(size[other]) - size[other]
        at = np.repeat(starts[other] - before, size[other]) + np.arange(size[other].sum())
        both = np.add.reduceat(mark[number[at]], before, dtype=np.int64)
        mark[number[starts[k] : starts[k + 1]]] = False
        for j in other[100 * both >= percent * (size[other] + size[k] - both)]:
            if up[j] != up[k]:
                out.append((int(node[j]), int(node[k])))
                up[up == up[j]] = up[k]
    return out


def links_in(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Confirmed links (a, b) inside each group of `rows` (key columns, _group, node, shingles, label, active)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_group")
        group, node = table.column("_group").to_numpy(), table.column("node").to_numpy()
        label, active = table.column("label").to_numpy(), np.asarray(table.column("active").combine_chunks())
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        out = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            one = np.lexsort((~active[lo:hi], node[lo:hi])) + lo
            one = one[np.diff(node[one], prepend=node[one[0]] - 1) != 0]  # a node may stand here twice, once as active
            out += confirmed(node[one], [sets[k] for k in one], percent, label[one], active[one])
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.select(*dict.fromkeys([*key, "_group", "node", "shingles", "label", "active"])).groupBy(*key).applyInArrow(run, "a long, b long")


def verified(groups: DataFrame, sets: DataFrame, percent: int, room: int) -> DataFrame:
    """Links (a, b) that connect what is connected among the nodes of each of `groups` (node, component); no task gets much over `room` shingles."""
    nodes = groups.count()
    inside = bits_of(groups.select("node"), nodes)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(*inside.value)
        for b in batches:
            yield b.filter(pa.array(known.holds(b.column("node").to_numpy().view(np.uint64))))

    own = sets.mapInArrow(some, sets.schema).join(groups.select("node", F.col("component").alias("_group")), "node")
    own = written(own, "members").withColumn("label", F.col("node"))
    weight = own.groupBy("_group").agg(F.sum("n").alias("_weight"), F.count("*").alias("_rows"))
    weight = cut(weight.withColumn("_blocks", F.ceil(F.col("_weight") / room).cast("int")))
    total = weight.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0]
    bins = max(1, -(-2 * total // room))
    small = own.join(weight.where("_blocks = 1").select("_group"), "_group")
    small = small.withColumn("_bin", F.pmod(F.xxhash64("_group"), F.lit(bins))).withColumn("active", F.lit(True))
    found = cut(links_in(small, ["_bin"], percent))
    large = weight.where("_blocks > 1")
    if large.isEmpty():
        return found
    # groups for several tasks: blocks with some eight pivots of all, then the rest of a block against every block
    many = own.join(large, "_group").withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    pivots = many.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) * F.col("_rows") < 8.0 * (1 << 30)).where(F.col("n") * 64 <= room)
    pivots = pivots.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1)))
    first = cut(links_in(many.unionByName(pivots).withColumn("active", F.lit(True)), ["_group", "_block"], percent))
    joined = cut(components(first))
    now = many.drop("label").join(joined.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    now = written(now, "labelled")
    main = now.groupBy("_group", "label").count().groupBy("_group").agg(F.max_by("label", F.struct("count", "label")).alias("_main"))
    rest = now.join(main, "_group").where("label != _main").drop("_main").withColumn("active", F.lit(True))
    to_all = rest.withColumn("_other", F.col("_block")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1)))
    needed = rest.groupBy("_group").agg(F.collect_set("_block").alias("_others"))  # a number for each block
    all_to = now.withColumn("active", F.lit(False)).join(needed, "_group").withColumn("_other", F.explode("_others")).drop("_others")
    second = cut(links_in(to_all.unionByName(all_to), ["_group", "_block", "_other"], percent))
    return found.unionByName(first).unionByName(second)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 16, few: int = 128, room: int = 4 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`.

    A-Z are lower-cased, words are runs without ASCII white space, a set is the distinct shingles of `words` words (fewer
    words: the whole sequence as one). Sets link with 100 |and| >= `percent` |or|, confirmed on full sets; component_id is
    the smallest doc_id reachable, kept says that it is the row's own. Null texts and texts without words have an empty set,
    link with nothing (not with each other) and are kept. Rows without an id link like others and are never kept; their
    component is the smallest id reachable, null if there is none. Ids may be of any type that has an order. Repeated rows
    stay; an empty table gives an empty one; other columns are not read.

    A shingle is its 64-bit hash. A pair at the threshold meets in a tree with a chance of 0.4 to 0.5, so 16 trees lose one
    in some thousands of such pairs, fewer of closer ones. `few`: nodes of a place that are compared; `room`: shingles in a task.
    """
    sets = written(sets_of(docs, words).withColumn("_row", F.monotonically_increasing_id()), "sets")
    copies = cut(sets.where("n > 0").groupBy("digest").agg(F.min("_row").alias("node"), F.min("doc_id").alias("rep")))
    nodes = written(sets.select(F.col("_row").alias("node"), "tokens", "sketch").join(copies.select("node"), "node"), "tokens")
    groups = cut(components(candidates(nodes, trees, few)))
    whole = sets.select(F.col("_row").alias("node"), "n", "shingles")
    links = verified(groups, whole, percent, room)
    found = components(links)
    roots = cut(copies.join(found, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("root")))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = cut(roots.join(least, "root").select("digest", "component_id"))
    linked = sets.where("n > 0").select("doc_id", "n", "digest").join(ids, "digest").select("doc_id", "n", "component_id")
    alone = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
