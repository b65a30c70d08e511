"""What several of the operators share: held-out folds, lineage cuts, bounded samples, slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import checkpoint_dir, cut, dropped, tasks_for

__all__ = ["SPACE", "WORD", "Bits", "bits_of", "checkpoint_dir", "cut", "dropped", "fold", "labelled_texts", "mixed", "numbered", "removed", "sample_ids", "slices", "table", "tasks_for", "written"]

#: White space of the contracts: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, for rows of which later steps read some columns only."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with `_place`, from 0 in `order`: a range-partitioned sort, and the counts of the partitions before (the only window: a row for each partition)."""
    rows = cut(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return rows.withColumn("_place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")


def sample_ids(df: DataFrame, by: str, n: int, key: str = "doc_id", most_values: int = 1000) -> tuple[DataFrame, int]:
    """(key, by): `n` ids, or all if there are fewer, of each value of `by`, the first in the order of a hash of the id; and the number of values.

    Reads only the two columns; rows without either are left out; a repeated id counts once. The distinct ids of each
    value are counted first (a sketch), so only ids below a hash threshold, about 2 n of each value, leave the tasks,
    however many rows there are. More than `most_values` values: ValueError.
    """
    d = df.select(key, by).where(F.col(by).isNotNull() & F.col(key).isNotNull())
    counts = d.groupBy(by).agg(F.approx_count_distinct(key).alias("_ids")).limit(most_values + 1).collect()
    if len(counts) > most_values:
        raise ValueError(f"{by} has over {most_values} values")
    share = d.sparkSession.createDataFrame([(r[0], min(1.0, (2.2 * n + 100) / max(1, r[1]))) for r in counts], f"_v {d.schema[by].dataType.simpleString()}, _share double")
    h = F.xxhash64(key)
    some = d.join(F.broadcast(share), F.col(by) == F.col("_v")).where(F.pmod(h, F.lit(1 << 40)) / float(1 << 40) < F.col("_share")).select(key, by).distinct()
    w = Window.partitionBy(by).orderBy(F.pmod(h, F.lit(1 << 40)), key)  # about 2 n rows
    return some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n"), len(counts)


def labelled_texts(docs: DataFrame, labels: DataFrame, by: str, n: int, max_chars: int, key: str = "doc_id", most_chars: int = 1 << 28, own: bool = False) -> list[tuple[int, str, object]]:
    """(id, whole text, label), sorted, of at most `n` ids of each value of `by` in `labels`.

    `own`: a label goes with the text of its own row of `labels`, else with the texts of its id in `docs`. Texts of
    more than `max_chars` characters are not learned from, and of fewer still if there are so many labels that the driver
    could get over `most_chars`. A quarter more ids are drawn, as some texts are null or too long; where more than a fifth
    of them are, fewer than `n` are learned from. An id that repeats gives one text for each of its labels, the smallest.
    """
    draw = n + -(-n // 4)
    ids, values = sample_ids(labels, by, draw, key)
    ids = ids.select(F.col(key).alias("_k"), F.col(by).alias("_y"))
    longest = min(max_chars, most_chars // max(1, values * draw))
    rows = labels if own else docs
    same = (F.col(key) == F.col("_k")) & (F.col(by) == F.col("_y")) if own else F.col(key) == F.col("_k")
    rows = (
        rows.select(key, "text", *([by] if own else []))
        .where(F.col("text").isNotNull() & (F.length("text") <= longest))
        .join(F.broadcast(ids), same)
        .groupBy("_k", "_y").agg(F.min("text").alias("text"))
        .select(F.pmod(F.xxhash64("_k"), F.lit(1 << 40)).alias("_h"), "_k", "text", "_y")
        .toArrow()
        .to_pydict()
    )
    taken: Counter = Counter()
    out = []
    for _, i, text, y in sorted(zip(rows["_h"], rows["_k"], rows["text"], rows["_y"], strict=True)):
        taken[y] += 1
        if taken[y] <= n:
            out.append((i, text, y))
    return sorted(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about `max_bytes` of `column` (a larger single text is a slice of its own), to bound what is expanded at once."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield b.slice(lo, hi - lo)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers stirred, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bits:
    """A set of 64-bit numbers that may hold too many, never too few: two bits of a bit set for each."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        mask, h = np.uint64(self.bits - 1), mixed(h)
        return [(h & mask).astype(np.int64), (h >> np.uint64(36) & mask).astype(np.int64)]

    def holds(self, h: np.ndarray) -> np.ndarray:
        hit = [self.words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) for p in self.places(h)]
        return (hit[0] & hit[1]).astype(bool)


def bits_of(numbers: DataFrame, size: int, most_bits: int = 1 << 28) -> Broadcast:
    """The `Bits` (its two arguments) of the one long column of `numbers`, to all tasks: 16 bits for each of `size`, `most_bits` (32 MB) at most.

    The set is put together by Spark (a bitwise or for each 64 places), so the driver gets the bit set and no more.
    """
    bits = 1 << min(max(10, (16 * size).bit_length()), most_bits.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate(Bits(np.zeros(0), bits).places(b.column(0).to_numpy().view(np.uint64)))
            order = np.argsort(p, kind="stable")
            p = p[order]
            if len(p):
                starts = np.flatnonzero(np.diff(p >> 6, prepend=-1))
                bit = np.left_shift(np.uint64(1), (p & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array((p >> 6)[starts]), pa.array(np.bitwise_or.reduceat(bit, starts).view(np.int64))], names=["at", "word"])

    rows = numbers.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return numbers.sparkSession.sparkContext.broadcast((words, bits))
