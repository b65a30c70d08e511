"""Benchmark decontamination: a BM25 inverted index of test items, searched with every passage of the corpus.

The search is block-max WAND done for many passages at once. Scores are BM25 weights of an item's distinct terms, by the
sum over the whole item, so one threshold holds for all items. A passage goes on only while a bound on its score allows:
first by the largest weight of each of its terms (the pivot test), then by the largest weights within each block of items
(block-max), then by exact scores in the blocks that are left. Every passage and item above the threshold is found; then
question and answer are verified apart, as longest common subsequences of words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, written

SLICE = 2 << 20  # bytes of text searched at once
HALF = 64  # words: passages are two halves long and start at every half; an indexed segment fits one whole
K1, B = 1.2, 0.75
BLOCK = 2
#: An index is built over at most so many characters of items at once; a larger benchmark is searched slice by slice, with
#: document frequencies and lengths of the whole.
MAX_CHARS = 8 << 20


def term(raw: str) -> str:
    """A word without white space, in lower case, without what is not a letter or digit."""
    return raw if raw.isalnum() else "".join(filter(str.isalnum, raw))


class Terms(dict):
    """Raw lower-case word to term number; -1: not in the index, -2: no word at all. Remembers a bounded number of words."""

    def __init__(self, vocabulary: dict[str, int], most: int = 1 << 17) -> None:
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, raw: str) -> int:
        t = term(raw)
        k = self.vocabulary.get(t, -1) if t else -2
        if len(self) < self.most:
            self[raw] = k
        return k


@dataclass
class Index:
    items: list[tuple[int, list[int], int]] = field(default_factory=list)  # item_id, term numbers, where the answer begins
    vocabulary: dict[str, int] = field(default_factory=dict)
    owner: np.ndarray = None  # item of each segment
    ptr: np.ndarray = None  # postings by term: segment, weight
    seg: np.ndarray = None
    weight: np.ndarray = None
    bptr: np.ndarray = None  # the same by block: block, largest weight
    block: np.ndarray = None
    bmax: np.ndarray = None
    most: np.ndarray = None  # largest weight of each term
    blocks: int = 0


def answer_start(raw: list[str]) -> int:
    """Words before the answer: up to the last word that ends a question or announces an answer, else the first three quarters."""
    for i in range(len(raw) - 1, 0, -1):
        if raw[i - 1].endswith("?") or raw[i - 1] in ("answer:", "a:"):
            return i
    return max(1, len(raw) - max(1, len(raw) // 4)) if len(raw) > 1 else 0


def item_words(text: str | None) -> list[str]:
    return [w for w in (text or "").lower().split() if term(w)]


def cuts(words: list) -> list[list]:
    """The segments of an item: as even as can be, of HALF words at most."""
    n = math.ceil(len(words) / HALF)
    return [words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n)]


@dataclass
class Statistics:
    """Of a whole benchmark: segments, their mean length, and the segments each term is in."""

    segments: int
    mean: float
    df: dict[str, int]


def count(texts: Iterable[str | None]) -> Statistics:
    segments = [[term(w) for w in s] for t in texts for s in cuts(item_words(t))]
    return Statistics(len(segments), sum(map(len, segments)) / max(1, len(segments)), Counter(t for s in segments for t in set(s)))


def build(rows: list[tuple[int, str]], whole: Statistics | None = None) -> Index:
    """The index of (item_id, text), by the statistics of the whole benchmark (None: `rows` are all of it). Items without words are left out: nothing can hold them."""
    whole = whole or count(t for _, t in rows)
    x = Index()
    segments: list[list[int]] = []
    owner: list[int] = []
    for item_id, text in rows:
        raw = item_words(text)
        if not raw:
            continue
        ids = [x.vocabulary.setdefault(term(w), len(x.vocabulary)) for w in raw]
        for part in cuts(ids):
            segments.append(part)
            owner.append(len(x.items))
        x.items.append((item_id, ids, answer_start(raw)))
    idf = [math.log(1 + (whole.segments - whole.df[t] + 0.5) / (whole.df[t] + 0.5)) for t in x.vocabulary]
    post: list[tuple[int, int, float]] = []
    for k, s in enumerate(segments):
        w = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(s) / whole.mean)) for t, c in Counter(s).items()}
        total = sum(w.values())
        post += [(t, k, v / total) for t, v in w.items()]
    post.sort()
    t = np.array([p[0] for p in post], np.int64)
    x.owner = np.array(owner, np.int64)
    x.seg, x.weight = np.array([p[1] for p in post], np.int64), np.array([p[2] for p in post])
    terms = len(x.vocabulary)
    x.ptr = np.searchsorted(t, np.arange(terms + 1))
    x.blocks = -(-len(segments) // BLOCK)
    key = t * max(1, x.blocks) + x.seg // BLOCK
    first = np.flatnonzero(np.diff(key, prepend=-1))
    x.bmax = np.maximum.reduceat(x.weight, first) if len(first) else np.zeros(0)
    x.block = key[first] % max(1, x.blocks)
    x.bptr = np.searchsorted(t[first], np.arange(terms + 1))
    x.most = np.maximum.reduceat(x.weight, x.ptr[:-1]) if terms else np.zeros(0)
    return x


def distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[np.diff(key, prepend=-1) != 0]


def spans(ptr: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in t, place in the postings) of all postings of the terms t."""
    n = ptr[t + 1] - ptr[t]
    at = np.repeat(np.arange(len(t)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + ptr[t][at]


def retrieve(x: Index, half: np.ndarray, t: np.ndarray, halves: int, least: float) -> Iterator[tuple[int, int, float]]:
    """(passage, segment, score) of every passage, halves p and p + 1, and segment with a score of `least` or more."""
    least -= 1e-9
    key = distinct(half * len(x.most) + t)
    half, t = key // len(x.most), key % len(x.most)
    bound = np.bincount(half, x.most[t], halves + 1)
    live = bound[:-1] + bound[1:] >= least
    used = np.zeros(halves + 1, bool)
    used[:-1] |= live
    used[1:] |= live
    some = used[half]
    half, t = half[some], t[some]
    where = np.searchsorted(half, np.arange(halves + 2))
    segments = len(x.owner)
    step = max(1, (1 << 22) // x.blocks)
    for lo in range(0, halves, step):  # passages lo to hi - 1
        hi = min(halves, lo + step)
        a, b = where[lo], where[hi + 1]
        if a == b:
            continue
        at, post = spans(x.bptr, t[a:b])
        s = np.bincount((half[a:b][at] - lo) * x.blocks + x.block[post], x.bmax[post], (hi - lo + 1) * x.blocks).reshape(-1, x.blocks)
        s = (s[:-1] + s[1:] >= least) & live[lo:hi, None]
        left = np.flatnonzero(s.any(1))
        for at in range(0, len(left), exact := max(1, (1 << 21) // segments)):
            some = left[at : at + exact]
            n = where[lo + some + 2] - where[lo + some]
            own = np.repeat(np.arange(len(some)), n)
            pairs = distinct(own * len(x.most) + t[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + where[lo + some][own]])
            own, terms = pairs // len(x.most), pairs % len(x.most)
            k, post = spans(x.ptr, terms)
            own = own[k]
            open_ = s[some[own], x.seg[post] // BLOCK]
            scores = np.bincount(own[open_] * segments + x.seg[post[open_]], x.weight[post[open_]], len(some) * segments)
            for k in np.flatnonzero(scores >= least):
                yield lo + int(some[k // segments]), int(k % segments), float(scores[k])


def overlap(part: list[int], text: list[int]) -> float:
    """Longest common subsequence by the length of `part`, with a bit for each word of `part`."""
    if not part:
        return 1.0
    mask: dict[int, int] = {}
    for i, t in enumerate(part):
        mask[t] = mask.get(t, 0) | 1 << i
    full = (1 << len(part)) - 1
    v = full
    for t in text:
        if m := mask.get(t):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return (len(part) - v.bit_count()) / len(part)


def matches(x: Index, texts: list[str | None], least: float, similar: float, memo: Terms) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of verified matches: once for each row and item, best score."""
    rows: list[np.ndarray] = []
    base: list[int] = []
    halves = 0
    for text in texts:
        raw = text.lower().split() if text else []
        ids = np.fromiter(map(memo.__getitem__, raw), np.int64, len(raw))
        rows.append(ids[ids != -2])
        base.append(halves)
        halves += -(-len(rows[-1]) // HALF) + 1  # an empty half parts two texts
    if not halves or not x.items:
        return
    t = np.concatenate(rows)
    half = np.concatenate([b + np.arange(len(r)) // HALF for b, r in zip(base, rows, strict=True)])
    known = t >= 0
    places: dict[tuple[int, int, int], list[tuple[float, int]]] = {}
    for p, k, score in retrieve(x, half[known], t[known], halves, least):
        row = int(np.searchsorted(base, p, "right")) - 1
        places.setdefault((row, int(x.owner[k]), k), []).append((score, p - base[row]))
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    for (row, item, _), found in places.items():
        _, ids, answer = x.items[item]
        for score, p in found:
            lo, hi = max(0, p * HALF - len(ids)), (p + 2) * HALF + len(ids)
            near = rows[row][lo:hi].tolist()
            q, a = overlap(ids[:answer], near), overlap(ids[answer:], near)
            if q >= similar and a >= similar:
                out[row, item] = max(out.get((row, item), (0.0, 0.0, 0.0)), (score, q, a))
    for (row, item), found in sorted(out.items()):
        yield row, x.items[item][0], *found


def counted(benchmark: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of segments, their mean length, and (t, n): the segments each term is in."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for text in b.column(0).to_pylist():
                parts = [[term(w) for w in s] for s in cuts(item_words(text))]
                seen = Counter(t for s in parts for t in set(s))
                yield pa.RecordBatch.from_arrays([pa.array([*seen, ""]), pa.array([*seen.values(), len(parts)], pa.int64()), pa.array([*[0] * len(seen), sum(map(len, parts))], pa.int64())], names=["t", "n", "words"])

    df = cut(benchmark.select("text").mapInArrow(terms, "t string, n long, words long").groupBy("t").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    n, words = df.where("t = ''").select("n", "words").first() or (0, 0)
    return n, words / max(1, n), df.where("t <> ''")


def dealt(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, _s) of the distinct rows of the benchmark and the number of slices `_s`, none of over 2.5 times MAX_CHARS characters.

    An item of over 1.5 times that by itself is refused (ValueError): it is no test item, and an index over it would not fit.
    """
    rows = benchmark.select("item_id", "text").groupBy("item_id", "text").agg(F.count("*").alias("_n")).drop("_n")
    size = F.coalesce(F.length("text"), F.lit(0)) + 16
    total, longest = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if longest > 1.5 * MAX_CHARS:
        raise ValueError(f"a test item of {longest} characters")
    n = -(-total // MAX_CHARS)
    while True:
        slices_ = rows.withColumn("_s", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))))
        if n < 2 or slices_.groupBy("_s").agg(F.sum(size).alias("_c")).agg(F.max("_c")).first()[0] <= 2.5 * MAX_CHARS:
            return slices_, n
        n *= 2


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over slices of the benchmark of bounded size (one, as a rule), each built when it is asked for, so that the driver holds one at a time.

    Repeated rows of the benchmark count once. Document frequencies, the number of segments and their mean length are those
    of the whole benchmark, counted by Spark where there are several slices; the driver sees the terms of one slice at a time.
    """
    yield from built(*dealt(benchmark))


def built(rows: DataFrame, n: int) -> Iterator[Index]:
    """An index over each of the `n` slices of `rows`."""
    whole = None
    if n > 1:
        segments, mean, df = counted(rows)
    for k in range(n):
        p = rows.where(F.col("_s") == k).orderBy("item_id", "text").select("item_id", "text").toArrow().to_pydict()
        if n > 1:
            own = rows.sparkSession.createDataFrame([(t,) for t in sorted({term(w) for x in p["text"] for w in item_words(x)})], "t string")
            whole = Statistics(segments, mean, dict(df.join(F.broadcast(own), "t").select("t", "n").toPandas().itertuples(index=False)))
        if (x := build(list(zip(p["item_id"], p["text"], strict=True)), whole)).items:
            yield x


def sent(x: Index, docs: DataFrame):
    """A broadcast of the index's parts, without its class."""
    return docs.sparkSession.sparkContext.broadcast(vars(x))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, similar: float = 0.8) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each document and test item that it holds.

    Every passage of a whole text is searched. score is the BM25 share of the item's best segment. Null and empty texts
    hold nothing, nor is an item without words held by any. Items with equal texts each match, repeated rows of an item
    once; an empty benchmark or table gives no rows; repeated documents give repeated rows. With several slices of the
    benchmark what one finds is written to the shared folder, and its index dropped, before the next.
    """
    out = None
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, score double, question_overlap double, answer_overlap double"
    rows = docs.select("doc_id", "text")
    slices_, n = dealt(benchmark)
    for x in built(slices_, n):
        held = sent(x, docs)
        found = rows.mapInArrow(leaks_in(held, least, similar), schema)
        if n > 1:
            found = cut(found)
            held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def leaks_in(held, least: float, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Index(**held.value)
        memo = Terms(x.vocabulary)
        for b in slices(batches, "text", SLICE):
            found = list(matches(x, b.column(1).to_pylist(), least, similar, memo))
            if found:
                row, item, *numbers = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item), *map(pa.array, numbers)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, similar: float = 0.8) -> DataFrame:
    """The documents that hold no test item, filtered as they stream by; each row by its own text, so ids may repeat or be null.

    Null and empty texts stay, as does every row if the benchmark is empty; an empty table gives an empty one; columns of
    any name are kept. With several slices of the benchmark what one leaves is written to the shared folder before the next.
    """
    names = docs.columns

    def keep(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = Index(**held.value)
            memo = Terms(x.vocabulary)
            for b in slices(batches, "text", SLICE):
                clean = np.ones(b.num_rows, bool)
                for row, *_ in matches(x, b.column(names.index("text")).to_pylist(), least, similar, memo):
                    clean[row] = False
                yield b.filter(pa.array(clean))

        return run

    first = True
    for x in indexes(benchmark):
        docs = docs if first else written(docs, "leaks")
        docs, first = docs.mapInArrow(keep(sent(x, docs)), docs.schema), False
    return docs
