"""Hard negatives by ball trees: the best rows of another label whose score lies in a window under a positive's.

Each task builds ball trees over its own rows, one for each label. For a query vector q, the inner products of a ball with
centre c and radius r lie between q·c - |q| r and q·c + |q| r; so a node is left out where they miss the query's score
window, or where the upper bound stays strictly under the query's k-th best score so far. Many queries go down a tree
together. A task tells its k best of each query, and a window ranks what the tasks found. Scores are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

LEAF = 128
NONE = np.iinfo(np.int64).min


@dataclass
class Ball:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None = None
    children: list[Ball] = field(default_factory=list)


def plant(x: np.ndarray, rows: np.ndarray) -> Ball:
    """A ball tree over `rows` of x: halves by the distance to two far points, down to `LEAF` rows."""
    own = x[rows]
    centre = own.mean(0)
    far = ((own - centre) ** 2).sum(1)
    ball = Ball(centre, float(np.sqrt(far.max())))
    if len(rows) <= LEAF or ball.radius == 0:
        ball.rows = rows
        return ball
    a = own[far.argmax()]
    b = own[((own - a) ** 2).sum(1).argmax()]
    order = np.argsort(own @ (b - a), kind="stable")
    half = len(rows) // 2
    ball.children = [plant(x, rows[np.sort(order[:half])]), plant(x, rows[np.sort(order[half:])])]
    return ball


@dataclass
class Queries:
    """Search requests: vector q[of], label, own id, scores from low to high, and the k best so far (score descending, id ascending)."""

    q: np.ndarray
    of: np.ndarray
    label: np.ndarray
    own: np.ndarray
    low: np.ndarray
    high: np.ndarray
    scores: np.ndarray
    ids: np.ndarray


def better(w: Queries, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Put scores [query, row] (NONE: not wanted) into the k best; one id with one score counts once."""
    k = w.scores.shape[1]
    some = (score >= w.scores[at, -1:]).any(1) & (score > NONE).any(1)
    at, score = at[some], score[some]
    if not len(at):
        return
    s = np.concatenate([w.scores[at], score], axis=1)
    i = np.concatenate([w.ids[at], np.broadcast_to(ids, score.shape)], axis=1)
    for _ in range(2):  # sort, strike out what repeats, sort again
        order = np.lexsort((i, ~s), axis=-1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        again = np.zeros(s.shape, bool)
        again[:, 1:] = (s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1]) & (s[:, 1:] > NONE)
        if not again.any():
            break
        s[again] = NONE
    w.scores[at], w.ids[at] = s[:, :k], i[:, :k]


def search(ball: Ball, x: np.ndarray, ids: np.ndarray, w: Queries, active: np.ndarray) -> None:
    norms = np.sqrt((w.q**2).sum(1))
    todo = [(ball, active)]
    while todo:
        node, at = todo.pop()
        of = w.of[at]
        mid, reach = w.q[of] @ node.centre, norms[of] * node.radius
        slack = 1 + 1e-9 * (np.abs(mid) + reach)
        upper, lower = mid + reach + slack, mid - reach - slack
        at = at[(upper >= w.low[at]) & (lower <= w.high[at]) & (upper >= w.scores[at, -1])]  # a tie with the k-th may win by its id
        if not len(at):
            continue
        if node.rows is None:
            near = sorted(node.children, key=lambda c: float((w.q[w.of[at]] @ c.centre).mean()))
            todo += [(c, at) for c in near]  # the nearer one is popped first
            continue
        some, place = np.unique(w.of[at], return_inverse=True)
        score = np.rint(w.q[some] @ x[node.rows].T).astype(np.int64)[place]
        bad = (score < w.low[at, None]) | (score > w.high[at, None]) | (ids[node.rows][None, :] == w.own[at, None])
        score[bad] = NONE
        better(w, at, score, ids[node.rows])


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """[row, component] floor(256 x) as doubles, of vectors of one length."""
    return np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), width)


def exact(q: np.ndarray, x: np.ndarray) -> None:
    """Inner products are exact in doubles as long as no partial sum can pass 2^53."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2.0**53:
        raise ValueError("components too large for exact scores: 256² d |q| |x| must stay under 2^53")


def lengths_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.value_lengths())


def requests(wanted: pa.Table, same: bool, k: int) -> list[tuple[int, Queries, np.ndarray]]:
    """(length, queries, their numbers): a vector meets those of its length; equal vectors are multiplied once."""
    out = []
    vectors = wanted.column("vector").combine_chunks()
    lengths = lengths_of(vectors)
    for d in np.unique(lengths):
        own = wanted.filter(pa.array(lengths == d))
        v, of = np.unique(whole_numbers(own.column("vector").combine_chunks(), d), axis=0, return_inverse=True)
        cell = {c: own.column(c).to_numpy() for c in ("label", "own", "low", "high", "query")}
        n = own.num_rows
        found = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        out.append((int(d), Queries(v, of.reshape(-1), cell["label"], cell["own"], cell["low"], cell["high"], *found), cell["query"]))
    return out


def best_of_tasks(rows: DataFrame, wanted: pa.Table, same: bool, k: int, chunk: int = 1 << 16) -> DataFrame:
    """(query, id, score): each task's k best of every query, among rows of the same or of another label. wanted: query, vector, label, own, low, high."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, wanted.schema) as stream:
        stream.write_table(wanted)
    held = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = requests(pa.ipc.open_stream(held.value).read_all(), same, k)

        def look(part: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(part).combine_chunks()
            lengths = lengths_of(table.column("v").combine_chunks())
            for d, w, _ in groups:
                own = table.filter(pa.array(lengths == d))
                if not own.num_rows:
                    continue
                x = whole_numbers(own.column("v").combine_chunks(), d)
                exact(w.q, x)
                ids, label = own.column("id").to_numpy(), own.column("label").to_numpy()
                order = np.argsort(label, kind="stable")
                for of_label in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                    active = np.flatnonzero((w.label == label[of_label[0]]) == same)
                    if len(active):
                        search(plant(x, of_label), x, ids, w, active)

        waiting: list[pa.RecordBatch] = []
        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) >= chunk:
                look(waiting)
                waiting = []
        if waiting:
            look(waiting)
        for _, w, query in groups:
            n, j = np.nonzero(w.scores > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(query[n]), pa.array(w.ids[n, j]), pa.array(w.scores[n, j])], names=["query", "id", "score"])

    return rows.mapInArrow(run, "query long, id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, every: int = 100, moved: int = 7, labels: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Where vec_id is divisible by
    `moved`, the label becomes (label + 1) % `labels`. Components are floor(256 x). Anchors: vec_id divisible by `every`.
    Scores are inner products with the anchor, higher ones first, ties by smaller vec_id. An anchor's positives are its first
    `positives` rows of the same label; for each, its first `negatives` rows of another label with
    `least` positive_score <= 100 negative_score <= 100 positive_score (none under a negative positive_score).

    "Other" rows have another vec_id. Anchors that are alike in id, label and vector count once; for an anchor, rows of one id
    and one score count once. Vectors of another length than the anchor's are not compared with it. An empty vector scores 0.
    An empty table gives an empty one; other columns are not read. Scores must stay under 2^53, else the job stops.

    Anchors go to the tasks in blocks of `block_bytes`, each block against all rows in one pass, so what is broadcast is
    bounded; a task tells `positives` or `negatives` rows of a query at most, whatever its rows.
    """
    finite = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    label = F.when(F.col("vec_id") % moved == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(labels))).otherwise(F.col("label").cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null").where(finite)
    anchors = rows.where(F.col("id") % every == 0).distinct()
    anchors = cut(anchors).withColumn("query", F.monotonically_increasing_id())
    n, width = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = max(1, -(-(8 * width + 64 * n) * positives // block_bytes))
    out = None
    for block in range(blocks):
        some = cut(anchors.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block))
        every_score = lambda d: d.select("query", F.col("v").alias("vector"), "label", F.col("id").alias("own"), F.lit(NONE + 1).alias("low"), F.lit(1 << 62).alias("high"))
        first = cut(ranked(best_of_tasks(rows, every_score(some).toArrow(), True, positives), positives).withColumnRenamed("query", "_of").withColumn("query", F.monotonically_increasing_id()))
        pairs = first.select("query", "_of", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(some.select(F.col("query").alias("_of"), F.col("id").alias("anchor_id"), "label", "v"), "_of")
        low = F.expr(f"case when positive_score < 0 then 1 else ceil(cast({least} as decimal(5,0)) * cast(positive_score as decimal(20,0)) / 100) end").cast("long")
        windows = pairs.select("query", F.col("v").alias("vector"), "label", F.col("anchor_id").alias("own"), low.alias("low"), F.col("positive_score").alias("high")).toArrow()
        last = ranked(best_of_tasks(rows, windows, False, negatives), negatives)
        part = last.join(pairs.select("query", "anchor_id", "positive_id", "positive_score"), "query")
        part = part.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return out
