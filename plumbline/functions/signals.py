"""Signals in array columns: epochs, log variance, and a Butterworth band-pass from its textbook definition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window


def epochs(df: DataFrame, signal: str, starts: str, length: int) -> DataFrame:
    """`df` with a row for each of its `starts` (array of sample numbers from 0): `k`, its place, and `epoch`, `length` samples from there; epochs that leave the signal are dropped."""
    e = df.select("*", F.posexplode(starts).alias("k", "_at")).where((F.col("_at") >= 0) & (F.col("_at") + length <= F.size(signal)))
    return e.withColumn("epoch", F.slice(signal, F.col("_at") + 1, length)).drop("_at")


def log_variance(signal: Column | str) -> Column:
    """ln(population variance + 1e-12)."""
    n = F.size(signal)
    mean = F.aggregate(signal, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    square = F.aggregate(signal, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / n
    return F.ln(F.greatest(square - mean * mean, F.lit(0.0)) + 1e-12)


def butterworth(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """[section, (b0, b1, b2, a1, a2)]: an order's analogue low-pass poles moved to the band, mapped by the bilinear transform, a section for each pair of conjugates; gain one at the centre."""
    if not 0 < low < high < rate / 2:
        raise ValueError("a band lies between zero and half the rate")
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = proto * (w2 - w1) / 2
    poles = np.concatenate([half + np.sqrt(half**2 - w1 * w2), half - np.sqrt(half**2 - w1 * w2)])
    z = (2 * rate + poles) / (2 * rate - poles)
    real, pairs = np.sort(z[np.abs(z.imag) < 1e-12].real), z[z.imag > 1e-12]
    denominators = [(-2 * p.real, abs(p) ** 2) for p in pairs] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    centre = np.exp(2j * np.arctan(np.sqrt(w1 * w2) / (2 * rate)))
    out = []
    for a1, a2 in denominators:  # zeros at one and minus one
        gain = abs((1 - centre**-2) / (1 + a1 * centre**-1 + a2 * centre**-2))
        out.append((1 / gain, 0.0, -1 / gain, a1, a2))
    return np.array(out)


def stepped(x: np.ndarray, sections: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signals in rows through the sections, sample by sample, from `state` [row, 2 x section]; also the state after the last sample."""
    end = np.empty_like(state)
    for i, (b0, b1, b2, a1, a2) in enumerate(sections):
        y = np.zeros_like(x)
        s1, s2 = state[:, 2 * i], state[:, 2 * i + 1]
        for k in range(x.shape[1]):
            y[:, k] = b0 * x[:, k] + s1
            s1, s2 = b1 * x[:, k] - a1 * y[:, k] + s2, b2 * x[:, k] - a2 * y[:, k]
        end[:, 2 * i], end[:, 2 * i + 1] = s1, s2
        x = y
    return x, end


def filtered(x: np.ndarray, sections: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signals in rows through the sections, from `state` or from rest, and the state at the end.

    The filter is linear: long signals are cut into blocks that are filtered side by side from rest, the blocks' states
    follow one from another, and each block gets what its own first state adds.
    """
    n, size = x.shape[1], 2 * len(sections)
    state = np.zeros((len(x), size)) if state is None else state
    length = int(np.sqrt(n))
    if length < 16:
        return stepped(x, sections, state)
    blocks = n // length
    y, ends = stepped(x[:, : blocks * length].reshape(-1, length), sections, np.zeros((len(x) * blocks, size)))
    rings, step = stepped(np.zeros((size, length)), sections, np.eye(size))
    ends = ends.reshape(len(x), blocks, size)
    begins = np.empty_like(ends)
    for k in range(blocks):
        begins[:, k] = state
        state = ends[:, k] + state @ step
    y = y.reshape(len(x), blocks, length) + begins @ rings
    rest, state = stepped(x[:, blocks * length :], sections, state)
    return np.concatenate([y.reshape(len(x), -1), rest], axis=1), state


def settled(sections: np.ndarray) -> np.ndarray:
    """The state in which the sections rest at a constant input of one."""
    out, level = [], 1.0
    for b0, b1, b2, a1, a2 in sections:
        y = (b0 + b1 + b2) / (1 + a1 + a2) * level
        s2 = b2 * level - a2 * y
        out += [b1 * level - a1 * y + s2, s2]
        level = y
    return np.array(out)


def padding(sections: np.ndarray) -> int:
    """Samples by which a signal is continued, turned about its end, before it is filtered both ways."""
    return 3 * (2 * len(sections) + 1 - min(np.count_nonzero(sections[:, 2] == 0), np.count_nonzero(sections[:, 4] == 0)))


def both_ways(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Forward, then backward: no phase is left. Each way begins settled at its first sample, of the signal continued by odd reflection."""
    pad = padding(sections)
    if x.shape[1] <= pad:
        raise ValueError(f"a signal of {x.shape[1]} samples is too short to be filtered both ways: {pad + 1} at least")
    x = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    for _ in range(2):
        x = filtered(x, sections, x[:, :1] * settled(sections))[0][:, ::-1]
    return x[:, pad:-pad]


def band_pass(df: DataFrame, signal: str, out: str, low: float, high: float, rate: float, order: int = 4, zero_phase: bool = False) -> DataFrame:
    """`df` with `out`: the signal between two frequencies (X1), causal and from rest, or both ways without phase.

    Signals of one length in a batch are filtered together; null ones stay null. A signal in several rows: `band_pass_chunks`.
    """
    sections = butterworth(low, high, rate, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, each_length(b.column(signal), lambda x, _: both_ways(x, sections) if zero_phase else filtered(x, sections)[0])], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def each_length(column: pa.Array, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Array:
    """An array column whose signals of one length are worked on together: work([row, sample], rows). Nulls stay null; samples come from the column's own buffer."""
    size = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    done = np.empty(len(flat))
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        at = begin[rows][:, None] + np.arange(n)
        done[at] = work(flat[at], rows)
    offsets = np.append(begin, len(flat)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(size < 0, False)), pa.array(done))


def band_pass_chunks(df: DataFrame, key: list[str], chunk: str, signal: str, out: str, low: float, high: float, rate: float, order: int = 4, zero_phase: bool = False) -> DataFrame:
    """band_pass of signals that are stored in many rows: `chunk` orders a signal's rows, `key` names the signal.

    Equal to filtering the whole. No chunk waits for the one before: each is filtered from rest, the states at the chunks'
    ends (a few numbers each) follow one from another by powers of the filter's own step, and each chunk is filtered again
    from its true state. Both ways, the first and the last chunk must be longer than the padding. Empty and null chunks
    stay as they are and pass the state on.
    """
    sections = butterworth(low, high, rate, order)
    x = df
    if zero_phase:
        w = Window.partitionBy(*key)
        x = x.withColumn("_last", F.max(chunk).over(w) == F.col(chunk)).withColumn("_first", F.min(chunk).over(w) == F.col(chunk))
        x = padded(x, signal, "_x", int(padding(sections)))
        x = one_way(x, key, chunk, "_x", sections, False)
        x = one_way(x, key, chunk, "_x", sections, True)
        pad = F.lit(int(padding(sections)))
        start, stop = F.when(F.col("_first"), pad).otherwise(0), F.when(F.col("_last"), pad).otherwise(0)
        return x.withColumn(out, F.when(F.col(signal).isNotNull(), F.slice("_x", start + 1, F.greatest(F.size("_x") - start - stop, F.lit(0))))).select(*df.columns, out)
    return one_way(x.withColumn("_x", F.col(signal).cast("array<double>")), key, chunk, "_x", sections, False, rest=True).withColumnRenamed("_x", out)


def padded(df: DataFrame, signal: str, out: str, pad: int) -> DataFrame:
    """The first and the last chunk continued by odd reflection."""
    x = F.transform(signal, lambda v: v.cast("double"))
    short = (F.col("_first") | F.col("_last")) & (F.coalesce(F.size(signal), F.lit(0)) <= pad)
    x = F.when(short, F.raise_error(F.lit(f"a first or last chunk of {pad} samples or fewer cannot be continued"))).otherwise(x)
    front = F.transform(F.reverse(F.slice(signal, F.lit(2), F.lit(pad))), lambda v: 2 * F.get(F.col(signal), F.lit(0)).cast("double") - v.cast("double"))
    back = F.transform(F.reverse(F.slice(signal, F.greatest(F.size(signal) - pad, F.lit(1)), F.lit(pad))), lambda v: 2 * F.get(F.col(signal), F.size(signal) - 1).cast("double") - v.cast("double"))
    none = F.array().cast("array<double>")
    return df.withColumn(out, F.concat(F.when(F.col("_first"), front).otherwise(none), x, F.when(F.col("_last"), back).otherwise(none)))


def one_way(df: DataFrame, key: list[str], chunk: str, x: str, sections: np.ndarray, backward: bool, rest: bool = False) -> DataFrame:
    """The chunks in `x`, filtered in order or, from the end, in reverse; from rest, or settled at the first sample."""
    size, names = 2 * len(sections), df.columns
    turn = (lambda a: a[:, ::-1]) if backward else (lambda a: a)
    level = F.get(x, F.size(x) - 1) if backward else F.get(x, F.lit(0))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state = np.zeros((b.num_rows, size))

            def keep(a: np.ndarray, rows: np.ndarray, state=state) -> np.ndarray:
                y, state[rows] = filtered(turn(a), sections)
                return y

            each_length(b.column(x), keep)
            n = b.column(x).value_lengths().fill_null(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*key, chunk]), n.cast(pa.int64()), b.column("_level"), pa.array(list(state), pa.list_(pa.float64()))], names=[*key, chunk, "_n", "_level", "_end"])

    kinds = [df.schema[c] for c in [*key, chunk]]
    told = df.withColumn("_level", level).select(*key, chunk, x, "_level").mapInArrow(ends, StructType([*kinds, StructField("_n", LongType()), StructField("_level", DoubleType()), StructField("_end", ArrayType(DoubleType()))]))
    step = stepped(np.zeros((size, 1)), sections, np.eye(size))[1]
    first = settled(sections)

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by([(chunk, "descending" if backward else "ascending")])
        levels = [v for v, n in zip(group.column("_level").to_pylist(), group.column("_n").to_pylist(), strict=True) if n]
        state = np.zeros(size) if rest or not levels else first * levels[0]
        begin = []
        for n, end in zip(group.column("_n").to_pylist(), group.column("_end").to_pylist(), strict=True):
            begin.append(state)
            state = np.array(end) + state @ np.linalg.matrix_power(step, n) if n else state
        return pa.table({c: group.column(c) for c in [*key, chunk]} | {"_begin": pa.array(begin, pa.list_(pa.float64()))})

    begins = told.groupBy(*key).applyInArrow(follow, StructType([*kinds, StructField("_begin", ArrayType(DoubleType()))]))  # a row for each chunk, no samples
    begins = begins.select(*[F.col(c).alias(f"_{c}") for c in [*key, chunk]], "_begin")
    both = df.join(begins, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, chunk]]).drop(*[f"_{c}" for c in [*key, chunk]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin = b.column("_begin").flatten().to_numpy().reshape(-1, size)
            y = each_length(b.column(x), lambda a, rows, begin=begin: turn(filtered(turn(a), sections, begin[rows])[0]))
            yield pa.RecordBatch.from_arrays([y if c == x else b.column(c) for c in names], names=names)

    return both.mapInArrow(run, df.schema)
