"""Phrase collocations: grams of one word to `most_words`, counted by language, cut where they hold together least.

Grams are exploded from the text into rows (language, phrase, count), one length after the other, counted together inside
an Arrow batch first and by Spark's hash aggregates then. A gram reaches the least count only if both grams of one word less
that it holds do, so each length is asked for among the survivors of the one before: a bit set of bounded size, which may
let too many through, never too few. What is left is relational: cuts joined with the counts of their two parts, scores in
Decimal, an anti-join with one-word extensions, and a ranking window by language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Bits, bits_of, cut, slices, written

#: Bytes that end a piece become line feeds, A-Z become a-z, a tab becomes a space; nothing else is touched.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
UNKNOWN = "und"
#: Bytes of text taken apart at once.
ROOM = 2 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The number of a gram from that of the gram without its last word and the last word's own."""
    return (h ^ (h >> np.uint64(29))) * ODD + word


def word_numbers(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))


def word_bits(words: DataFrame, size: int, most_bits: int) -> Broadcast:
    """The set of the numbers of (lang, phrase) rows of one word, as `Words.numbers` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = chained(word_numbers(b.column("lang").cast(pa.binary()).to_pylist()), word_numbers(b.column("phrase").cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return bits_of(words.select("lang", "phrase").mapInArrow(run, "h long"), size, most_bits)


def chunks(data: bytes, room: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `room` bytes that end after a line feed (or at the end): no piece is cut."""
    at = 0
    while at < len(data):
        end = len(data) if at + room >= len(data) else data.rfind(b"\n", at, at + room) + 1
        if end <= at:
            end = data.find(b"\n", at + room) + 1 or len(data)
        yield at, end
        at = end


@dataclass
class Words:
    """The words of a stretch of texts: number in the vocabulary, piece, language, begin and end in the data."""

    vocabulary: pa.Array
    ids: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: bytes
    names: list[str]

    def grams(self, n: int) -> np.ndarray:
        """Which places begin a gram of n words, that is inside a piece."""
        count = max(0, len(self.ids) - n + 1)
        return self.piece[:count] == self.piece[len(self.ids) - count :]

    @cached_property
    def own(self) -> np.ndarray:
        return word_numbers(self.vocabulary.to_pylist())[self.ids]

    def numbers(self, n: int) -> np.ndarray:
        """The numbers of the n words from each place on, whether or not they are of one piece."""
        h = chained(word_numbers([x.encode() for x in self.names])[self.lang], self.own)
        for k in range(1, n):
            h = chained(h[:-1], self.own[k:])
        return h


def words_of(batch: pa.RecordBatch, room: int) -> Iterator[Words]:
    """The words of a batch (text, lang), some `room` bytes at a time."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    langs = [UNKNOWN if x is None else x for x in batch.column("lang").to_pylist()]
    data = b"\n".join(t or b"" for t in texts).translate(TABLE)
    begins = np.cumsum([0] + [len(t or b"") + 1 for t in texts[:-1]])
    names = list(dict.fromkeys(langs))
    lang_of_text = np.array([{x: k for k, x in enumerate(names)}[x] for x in langs], np.int32)
    for lo, hi in chunks(data, room):
        a = np.frombuffer(data, np.uint8, hi - lo, lo)
        inside = (a != 10) & (a != 32)
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(begin):
            continue
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        packed = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(a[inside].tobytes())]).dictionary_encode()
        lang = lang_of_text[np.searchsorted(begins, begin + lo, side="right") - 1]
        yield Words(packed.dictionary, np.asarray(packed.indices).astype(np.int64), np.cumsum(a == 10, dtype=np.int32)[begin], lang, begin + lo, end + lo, data, names)


def counted(batch: pa.RecordBatch, n: int, room: int = ROOM) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of the grams of `n` words; for n = 1 also the count of all words, as phrase ''."""
    for w in words_of(batch, room):
        at = np.flatnonzero(w.grams(n))
        if not len(at):
            continue
        many = len(w.vocabulary)
        group, span = w.lang[at].astype(np.int64), len(w.names)
        for k in range(n):
            if span * many >= 1 << 62:
                group = np.unique(group, return_inverse=True)[1]
                span = int(group.max()) + 1
            group, span = group * many + w.ids[at + k], span * many
        _, first, f = np.unique(group, return_index=True, return_counts=True)
        first = at[first]
        parts = [w.vocabulary.take(pa.array(w.ids[first + k])) for k in range(n)]
        phrase = (pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]).cast(pa.large_string()).cast(pa.string())
        where = pa.array(w.names, pa.string()).take(pa.array(w.lang[first]))
        if n == 1:
            totals = np.bincount(w.lang, minlength=len(w.names))
            where, phrase, f = pa.concat_arrays([where, pa.array(w.names, pa.string())]), pa.concat_arrays([phrase, pa.array([""] * len(w.names), pa.string())]), np.concatenate([f, totals])
        yield pa.RecordBatch.from_arrays([where, phrase, pa.array(f.astype(np.int64))], names=["lang", "phrase", "f"])


def numbered(batch: pa.RecordBatch, n: int, seen: Bits | None, room: int = ROOM) -> Iterator[pa.RecordBatch]:
    """(h, f): the grams of `n` words by their numbers, of which the language is a part; with `seen` only those whose shorter grams are in it."""
    for w in words_of(batch, room):
        fits = w.grams(n)
        if seen:
            known = seen.holds(w.numbers(n - 1))
            fits = fits & known[: len(fits)] & known[1 : len(fits) + 1]
        h, f = np.unique(w.numbers(n)[np.flatnonzero(fits)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f.astype(np.int64))], names=["h", "f"])


def runs(batch: pa.RecordBatch, n: int, seen: Bits, room: int = ROOM) -> Iterator[pa.RecordBatch]:
    """(text, lang): the longest stretches of pieces in which every gram of `n` words is `seen`. No gram of n words or more that counts is lost."""
    for w in words_of(batch, room):
        fits = w.grams(n)
        at = np.flatnonzero(fits & seen.holds(w.numbers(n))[: len(fits)])
        if not len(at):
            continue
        new = (np.diff(at, prepend=-2) != 1) | (np.diff(w.piece[at], prepend=-1) != 0)  # neighbours of one piece go on
        first, last = at[new], at[np.append(new[1:], True)] + n - 1
        yield pa.RecordBatch.from_arrays([pa.array([w.data[b:e].decode() for b, e in zip(w.begin[first].tolist(), w.end[last].tolist(), strict=True)], pa.string()), pa.array([w.names[k] for k in w.lang[first].tolist()], pa.string())], names=["text", "lang"])


def exploded(text: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Rows of work(batch) over the texts, some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", ROOM):
            yield from work(b)

    return text.mapInArrow(run, schema)


def gram_counts(text: DataFrame, n: int) -> DataFrame:
    return exploded(text, lambda b: counted(b, n), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_grams(docs: DataFrame, most_words: int, least: int, most_bits: int = 1 << 28) -> DataFrame:
    """(lang, phrase, f, words) of all grams that occur `least` times or more in their language; words = 0: all word occurrences of it.

    Words are counted as they are. Longer grams are counted by their 64-bit numbers first, which are short rows; those that
    may be frequent (two numbers may fall together, so some are not) make the stretches of text that are left, written
    and ever fewer, and there they are counted exactly. The texts are read three times: for words, pairs, stretches.
    """
    text, found, seen = docs.select("text", F.col("lang").cast("string").alias("lang")), None, None
    for n in range(1, most_words + 1):
        if n > 1:
            numbers = exploded(text, lambda b, n=n, seen=seen: numbered(b, n, Bits(*seen.value) if seen else None), "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
            numbers = cut(numbers.where(F.col("f") >= least).select("h"))
            size = numbers.count()
            if not size:
                break
            held = bits_of(numbers, size, most_bits)
            text, seen = written(exploded(text, lambda b, n=n, held=held: runs(b, n, Bits(*held.value)), "text string, lang string"), "runs"), None
        own = gram_counts(text, n).where((F.col("f") >= least) | (F.col("phrase") == "")).where("f > 0")
        own = cut(own.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(n)))
        found = own if found is None else found.unionByName(own)
        if n == 1 < most_words:
            size = own.where("words > 0").count()
            if not size:
                break
            seen = word_bits(own.where("words > 0"), size, most_bits)
    return found


def collocations(docs: DataFrame, most_words: int = 5, least: int = 100, most: int = 2000, absorb: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), each language's first `most` phrases.

    A-Z are lower-cased; pieces end at `.,;:!?`, line feed to carriage return; words are runs without space and tab. n counts
    a language's word occurrences, f(phrase) its contiguous ones within pieces, overlaps included. A phrase of 2 to
    `most_words` words with a = f >= `least` is cut after its first k words into parts with counts l and r; its score is
    the lowest floor(1000 a n / (l r)) of its cuts, ties to the smallest k. Phrases that stand inside a longer one with
    100 f(longer) >= `absorb` a are dropped; looking one word further is enough, as every phrase in between is at least as
    frequent as the longer one. Order: score, a, both descending, then the phrase's bytes.

    A null text is empty; a null lang is `und`. Repeated rows count each; ids and other columns are not read; an
    empty table gives an empty one. The arithmetic is exact as long as a language has below 10^15 words; beyond that Spark
    stops with an overflow, never with a wrong score.
    """
    grams = frequent_grams(docs, most_words, least)
    f = grams.where("words > 0").select("lang", "phrase", "f")
    totals = grams.where("words = 0").select("lang", F.col("f").alias("n"))
    some = grams.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words")

    less = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))
    longer = some.where("words > 2").select("lang", F.explode(less).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = some.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorb * F.col("a"), F.lit(True))).drop("longer")

    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
