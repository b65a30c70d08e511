"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed in pieces of 1 KB against either dictionary; the difference of the two sizes by length, and nothing
else, goes through a logistic calibration (two numbers, rising) to a probability of label 1. Every piece of a text counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_texts, slices

PIECE = 1024
#: The difference is drawn towards the training mean as by this many bytes, so that a few bytes prove little.
SHRINK = 60
#: A level that searches dictionaries thoroughly: lower ones miss matches in them and tell the labels apart far worse.
LEVEL = 9


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: float  # bytes of difference by byte of text
    weights: tuple[float, ...]  # constant and slope; none: nothing was learned
    prior: float


def sizer(dictionary: bytes):
    import zstandard as z

    data = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    press = z.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda pieces: sum(len(press(x)) for x in pieces)


def sizes(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """(bytes against good, against bad, plain) of each text."""
    a, b = sizer(good), sizer(bad)
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        pieces = [t[k : k + PIECE] for k in range(0, len(t), PIECE)]
        out[i] = a(pieces), b(pieces), len(t)
    return out


def difference(s: np.ndarray, mean: float) -> np.ndarray:
    """The normalised difference of the sizes, beside a constant."""
    a, b, n = s.T
    return np.column_stack([np.ones(len(n)), (b - a + SHRINK * mean) / (n + SHRINK) * 10])


def probabilities(texts: list[bytes | None], model: Model) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.prior)
    return logistic(difference(sizes([t or b"" for t in texts], model.good, model.bad), model.mean), np.array(model.weights))


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def dictionary(texts: list[bytes], shared: set[bytes], size: int, segment: int) -> bytes:
    """A segment of each text in turn, without lines that several sampled texts share, up to `size` bytes."""
    parts, room = [], size
    for t in texts:
        own = b"\n".join(x for x in t.split(b"\n") if x not in shared)
        at = zlib.crc32(own) % max(1, len(own) // segment) * segment
        parts.append(own[at : at + segment][:room])
        room -= len(parts[-1]) + 1
        if room <= 0:
            break
    return b"\n".join(parts)


def fit(rows: list[tuple[int, str, int]], prior: float, size: int = 64 << 10, segment: int = 256) -> Model:
    """Half of the sampled texts of a label make its dictionary, the other half the calibration, weighed to `prior`, the share of label 1."""
    by = {q: [t.encode() for _, t, y in rows if y == q and t.strip()] for q in (0, 1)}
    if min(map(len, by.values())) < 4:
        return Model(b"", b"", 0.0, (), prior)
    lines = Counter(x for texts in by.values() for t in texts for x in set(t.split(b"\n")))
    shared = {x for x, n in lines.items() if n > 1}
    half = {q: dictionary(t[::2], shared, size, segment) for q, t in by.items()}
    held = {q: t[1::2] for q, t in by.items()}
    y = np.repeat([0, 1], [len(held[0]), len(held[1])])
    s = sizes(held[0] + held[1], half[1], half[0])
    of = np.where(y == 1, prior / len(held[1]), (1 - prior) / len(held[0])) * len(y)
    mean = float(np.average((s[:, 1] - s[:, 0]) / s[:, 2], weights=of))
    x, w = difference(s, mean), np.zeros(2)
    for _ in range(50):
        p = logistic(x, w)
        step = np.linalg.solve((x * (of * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (of * (y - p)) - 0.01 * w)
        w = w + np.clip(step, -3, 3)
    return Model(half[1], half[0], mean, tuple(w.tolist()), prior)


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, out: int = 0, per_label: int = 900, max_chars: int = 20_000) -> Model:
    """Fit on at most `per_label` texts of either label, of `max_chars` characters at most, from the folds crc32(doc_id) mod `mod` <> `out`.

    The share of label 1 comes from all rows of those folds. An id that repeats in `docs` is learned once, with its
    smallest text; one with both labels counts for both; other labels and null ids are left out.
    """
    rows = labels.where(fold("doc_id", mod) != out).where("quality in (0, 1)")
    n, good = rows.agg(F.count("*"), F.sum("quality")).first()
    if not n:
        return Model(b"", b"", 0.0, (), 0.5)
    texts = labelled_texts(docs, rows, "quality", per_label, max_chars)
    return fit(texts, good / n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): probability of label 1. Null and empty texts score the training mean's value; so does every text if a label had under four examples (then the prior)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probabilities(b.column(1).cast(pa.binary()).to_pylist(), model))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document; repeated rows stay, an empty table gives an empty one."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score `threshold` or more, scored as they stream by: no join back, so ids may repeat or be null.

    Null and empty texts score as in `score` and are kept or not by it. Without labels all score 0.5 and stay. An empty
    table gives an empty one; columns of any name are kept.
    """
    model = train(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            keep = probabilities(b.column(names.index("text")).cast(pa.binary()).to_pylist(), model) >= threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
