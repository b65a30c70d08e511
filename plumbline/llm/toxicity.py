"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean vector of its character n-grams and of itself (all hashed into buckets), a passage of 32 words the mean
of its distinct words, so misspellings that were never seen share most of their vectors with what was. The softmax is
linear, so at scoring time a word's part is one number, the log odds it adds, remembered by word. Runs of over 48
letters and digits are read through overlapping windows, each a word of its own. The largest and the mean
log odds of a text's passages go through a calibration to its score; every word of a text is in one passage.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_texts, slices

WORDS = re.compile(r"[^\W_]+")
GRAMS = (3, 4, 5)
BUCKETS = 1 << 15
DIM = 8
LONGEST = 48  # characters of a word; a longer run (glued text, scripts without spaces) is read through windows that count as words
PANE = 16  # characters of a window; they start at every half, so up to nine characters running are whole in one
MEMO = 1 << 19
PASSAGE = 32
#: A passage of fewer words counts as if it had so many, in training and in scoring, so that one word proves little.
LEAST = 16
#: The softmax's fixed temperature: a few words decide, and their share of a passage is small.
SCALE = 16.0


@dataclass
class Model:
    table: list[float] | None  # log odds of each bucket's vector: embedding times the difference of the softmax weights
    bias: float
    weights: tuple[float, float, float]  # calibration: constant, largest, mean
    prior: float


def buckets(word: str) -> list[int]:
    w = f"<{word}>"
    grams = {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)} - {w}
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams} | {zlib.crc32(f"={word}".encode()) % BUCKETS})


def panes(run: str) -> list[str]:
    """Overlapping windows over the whole run."""
    half = PANE // 2
    return [run[i : i + PANE] for i in range(0, len(run) - half, half)]


def passages(text: str) -> list[set[str]]:
    words = [w for run in WORDS.findall(text.lower()) for w in ([run] if len(run) <= LONGEST else panes(run))]
    return [set(words[k : k + PASSAGE]) for k in range(0, len(words), PASSAGE)]


def embed(bags: list[set[str]], y: np.ndarray, least: int, steps: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, float]:
    """Log odds of each bucket, and the bias: gradient descent with momentum and an adaptive step on the cross-entropy of all bags at once; both labels weigh the same.

    Words of fewer than `least` bags are left out of the training bags (not of their sizes), never of the scores.
    """
    seen = Counter(w for b in bags for w in b)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least))}
    kept = [(sorted(vocabulary[w] for w in b if w in vocabulary), max(len(b), LEAST), t) for b, t in zip(bags, y, strict=True)]
    kept = [x for x in kept if x[0]]
    y = np.array([t for *_, t in kept], np.float32)
    if len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS), 0.0
    grams = [buckets(w) for w in vocabulary]
    gn = np.array(list(map(len, grams)))
    gat, gid = np.cumsum(gn) - gn, np.concatenate(grams)
    dn = np.array([len(b) for b, *_ in kept])
    dat, wid = np.cumsum(dn) - dn, np.concatenate([b for b, *_ in kept])
    share = np.repeat(np.array([SCALE / n for _, n, _ in kept], np.float32), dn)[:, None]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)

    # the same in the order of words and of buckets, to add gradients by runs
    by_word, by_gram = np.argsort(wid, kind="stable"), np.argsort(gid, kind="stable")
    owner, gowner = np.repeat(np.arange(len(kept)), dn)[by_word], np.repeat(np.arange(len(grams)), gn)[by_gram]
    first_word, first_gram = (np.flatnonzero(np.diff(v, prepend=-1)) for v in (wid[by_word], gid[by_gram]))
    used = gid[by_gram][first_gram]
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    own, sorted_share, per = place[gid], share[by_word, 0], gn[:, None].astype(np.float32)

    rng = np.random.default_rng(seed)
    e = rng.uniform(-1e-3, 1e-3, (len(used), DIM)).astype(np.float32)
    u, bias = rng.uniform(-1, 1, DIM).astype(np.float32), np.zeros(1, np.float32)  # difference of the two softmax rows
    params, last = (e, u, bias), np.inf
    moments = [np.zeros_like(p) for p in params]
    before = [p.copy() for p in params]
    for _ in range(steps):
        words = np.add.reduceat(e[own], gat, axis=0) / per
        logit = np.add.reduceat((words @ u)[wid] * share[:, 0], dat) + bias
        loss = float(weight @ np.logaddexp(0, np.where(y == 1, -logit, logit)))
        if not loss <= last + 1e-3:  # too far: go back, and on with half the step
            for p, m, b in zip(params, moments, before, strict=True):
                p[...] = b
                m[...] = 0
            rate /= 2
            continue
        last = loss
        for p, b in zip(params, before, strict=True):
            b[...] = p
        rate *= 1.03
        d = (weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)).astype(np.float32)
        pull = np.zeros(len(words), np.float32)  # of each word's log odds
        pull[wid[by_word][first_word]] = np.add.reduceat(sorted_share * d[owner], first_word)
        de = np.add.reduceat((pull[:, None] / per)[gowner], first_gram, axis=0) * u
        grads = (de, words.T @ pull, np.array([d.sum()], np.float32))
        for param, g, m in zip(params, grads, moments, strict=True):
            m *= 0.9
            m += g
            param -= rate * m
        e *= 1 - rate * decay
    e, u, bias = before
    table = np.zeros(BUCKETS)
    table[used] = e @ u * SCALE
    return table, float(bias[0])


def evidence(texts: list[str | None], table: list[float], bias: float, memo: dict[str, float]) -> np.ndarray:
    """(constant, largest, mean log odds of the passages) of each text; NaN without words."""

    def odds(word: str) -> float:
        b = buckets(word)
        v = sum(table[k] for k in b) / len(b)
        if len(memo) < MEMO:
            memo[word] = v
        return v

    out = np.full((len(texts), 3), np.nan)
    known = memo.get
    for i, t in enumerate(texts):
        found = []
        for p in passages(t) if t else ():
            v = list(map(known, p))
            if None in v:
                v = [odds(w) if x is None else x for w, x in zip(p, v, strict=True)]
            found.append(sum(v) / max(len(v), LEAST) + bias)
        if found:
            out[i] = 1.0, max(found), sum(found) / len(found)
    return out


def fit(rows: list[tuple[int, str, int]], prior: float, least: int = 3, steps: int = 240, rate: float = 2.0, decay: float = 0.0, seed: int = 1) -> Model:
    """Seven eighths of the sampled texts of either label train the embedding, every eighth the calibration, weighed to the prior of all training labels."""
    rows = [(t, y) for _, t, y in rows if WORDS.search(t)]
    seen: Counter = Counter()
    parts: tuple[list, list] = ([], [])
    for x in rows:
        parts[seen[x[1]] % 8 == 1].append(x)
        seen[x[1]] += 1
    if any({y for _, y in p} != {0, 1} for p in parts):
        return Model(None, 0.0, (0.0, 0.0, 0.0), prior)
    bags = [(b, y) for t, y in parts[0] for b in passages(t)]
    table, bias = embed([b for b, _ in bags], np.array([y for _, y in bags]), least, steps, rate, decay, seed)
    table = table.tolist()
    x, y = evidence([t for t, _ in parts[1]], table, bias, {}), np.array([y for _, y in parts[1]], float)
    of = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.clip(np.linalg.solve((x * (of * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (of * (y - p)) - 0.1 * w), -2, 2)
    return Model(table, bias, tuple(w.tolist()), prior)


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, out: int = 1, per_label: int = 2000, max_chars: int = 20_000) -> Model:
    """Fit on at most `per_label` texts of either label, of `max_chars` characters at most, from the folds crc32(doc_id) mod `mod` <> `out`.

    The share of label 1 comes from all rows of those folds. An id that repeats in `docs` is learned once, with its
    smallest text; one with both labels counts for both; other labels and null ids are left out.
    """
    rows = labels.where(fold("doc_id", mod) != out).where("toxic in (0, 1)")
    n, ones = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return Model(None, 0.0, (0.0, 0.0, 0.0), 0.5)
    return fit(labelled_texts(docs, rows, "toxic", per_label, max_chars), ones / n)


def probabilities(texts: list[str | None], model: Model, memo: dict[str, float]) -> np.ndarray:
    if model.table is None:
        return np.full(len(texts), model.prior)
    p = 1 / (1 + np.exp(-np.clip(evidence(texts, model.table, model.bias, memo) @ np.array(model.weights), -30, 30)))
    return np.where(np.isnan(p), model.prior, p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: probability of label 1 of the whole text; the prior for null texts, texts without words, and where nothing was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probabilities(b.column(1).to_pylist(), model, memo))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document.

    score is the probability of label 1; null texts and texts without words get the share of label 1 in training (0.5
    without any labels), and so do all texts if a label has too few examples. Repeated rows stay; an empty table gives an empty one.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
