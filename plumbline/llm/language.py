"""Language identification by unigrams over a fixed public vocabulary, with segmentations summed out.

Each language has a probability for every piece; a word's probability in a language is the sum, over all its
segmentations into pieces, of the products of their probabilities (forward algorithm), a text's the product over its words.
Piece probabilities are fitted by expectation maximisation (forward-backward counts) on a bounded sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_texts, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
LINEAR = 36  # characters of a word up to which probabilities need no scaling
MEMO = 1 << 18
ODD = 0x9E3779B97F4A7C15  # multiplier of the rolling hash of substrings


WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Runs of letters (str.isalpha) of a lower-cased text: other numerals (½, ², Ⅷ), which are word characters too, part them."""
    found = WORDS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else [w])]


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    p: np.ndarray  # of pieces and, last, an unknown character; by language


class Pieces(dict):
    """Numbers of pieces; `longest` is the length of the longest, `found` looks up many substrings at once."""

    def __init__(self, numbers: dict[str, int]) -> None:
        super().__init__(numbers)
        self.longest = max(map(len, numbers), default=1)
        self.codes = np.zeros((len(numbers), self.longest), np.uint32)
        names = list(numbers)
        for i, x in enumerate(names):
            self.codes[i, : len(x)] = list(map(ord, x))
        self.ids = np.array([numbers[x] for x in names], np.int64)
        hashes = np.array([rolling(np.array([list(map(ord, x))], np.uint32))[0, -1] for x in names], np.uint64)
        self.by = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.by]

    def found(self, hashes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, numbers) of the substrings that are pieces, by hash, then character by character."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[at] == hashes) if len(self.hashes) else np.zeros(0, np.int64)
        k = self.by[at[rows]] if len(rows) else rows
        size = codes.shape[1]
        same = (self.codes[k, :size] == codes[rows]).all(1) & (self.codes[k, size:] == 0).all(1)
        return rows[same], self.ids[k[same]]


def rolling(codes: np.ndarray) -> np.ndarray:
    """[row, end] hashes of the first `end` characters, modulo 2**64."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for e in range(codes.shape[1]):
        out[:, e + 1] = out[:, e] * np.uint64(ODD) + codes[:, e].astype(np.uint64) + np.uint64(1)
    return out


def read_pieces(path: str = VOCABULARY) -> Pieces:
    """Numbers of the vocabulary's pieces of letters, at a word's start or not (a file of fixed size, read on the driver). Pieces with capitals cannot stand in lower-cased text and are left out."""
    import sentencepiece

    if not Path(path).exists():
        raise FileNotFoundError(f"vocabulary {path}: give the path of a sentencepiece model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    kept = [x for x in found if (x.removeprefix(START) or "a").isalpha() and x == x.lower()]
    return Pieces({x: i for i, x in enumerate(dict.fromkeys(kept))})


def as_pieces(pieces: dict[str, int]) -> Pieces:
    return pieces if isinstance(pieces, Pieces) else Pieces(pieces)


def lattice(words: list[str], pieces: Pieces) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(start, end) to (words, piece numbers), for words of one length. A character that is no piece is the unknown one (number len(pieces)): every word has every character."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    m, h = codes.shape[1], rolling(codes)
    out = {}
    for size in range(1, min(m, pieces.longest) + 1):
        power = np.uint64(pow(ODD, size, 1 << 64))
        for s in range(m - size + 1):
            rows, k = pieces.found(h[:, s + size] - h[:, s] * power, codes[:, s : s + size])
            if size == 1:
                every = np.full(len(words), len(pieces))
                every[rows] = k
                rows, k = np.arange(len(words)), every
            if len(rows):
                out[s, s + size] = rows, k
    return out


def forward(parts: dict, n: int, m: int, p: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: the summed probability of all segmentations of the first `end` characters."""
    alpha = np.zeros((n, m + 1, p.shape[1]))
    alpha[:, 0] = 1
    for s, e in sorted(parts, key=lambda x: x[1]):
        rows, k = parts[s, e]
        alpha[rows, e] += alpha[rows, s] * p[k]
    return alpha


def long_lattice(word: str, pieces: Pieces) -> list[list[tuple[int, int]]]:
    """(start, piece number) of the pieces that end at each character, for a word of any length."""
    none = len(pieces)
    return [[(s, k) for s in range(max(0, e - pieces.longest), e) if (k := pieces.get(word[s:e], none if s == e - 1 else None)) is not None] for e in range(1, len(word) + 1)]


def long_word(word: str, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability by language of a word of any length: the same sum, in log scale."""
    logp = np.log(np.maximum(p, 1e-300))
    alpha = [np.zeros(p.shape[1])]
    for ends in long_lattice(word, pieces):
        alpha.append(np.logaddexp.reduce([alpha[s] + logp[k] for s, k in ends]))
    return alpha[-1]


def word_logs(words: list[str], pieces: dict[str, int], p: np.ndarray) -> np.ndarray:
    """[word, language] log probabilities."""
    pieces = as_pieces(pieces)
    out = np.empty((len(words), p.shape[1]))
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w) + 1, []).append(i)
    for m, at in by.items():
        if m > LINEAR:
            for i in at:
                out[i] = long_word(START + words[i], pieces, p)
            continue
        for k in range(0, len(at), 4096):
            some = at[k : k + 4096]
            out[some] = np.log(np.maximum(forward(lattice([START + words[i] for i in some], pieces), len(some), m, p)[:, -1], 1e-300))
    return out


def expected(words: Counter, pieces: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words of one language, over all segmentations: forward times backward."""
    pieces = as_pieces(pieces)
    counts = np.zeros(len(pieces) + 1)
    by: dict[int, list[str]] = {}
    for w in sorted(words):
        by.setdefault(len(w) + 1, []).append(w)
    for m, group in by.items():
        if m > LINEAR:
            for w in group:
                long_expected(START + w, words[w], pieces, p, counts)
            continue
        for at in range(0, len(group), 4096):
            some = group[at : at + 4096]
            parts = lattice([START + w for w in some], pieces)
            alpha = forward(parts, len(some), m, p[:, None])[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[:, m] = 1
            for s, e in sorted(parts, reverse=True):
                rows, k = parts[s, e]
                beta[rows, s] += beta[rows, e] * p[k]
            n = np.array([words[w] for w in some]) / np.maximum(alpha[:, m], 1e-300)
            for (s, e), (rows, k) in parts.items():
                counts += np.bincount(k, n[rows] * alpha[rows, s] * p[k] * beta[rows, e], len(counts))
    return counts


def long_expected(word: str, n: int, pieces: Pieces, p: np.ndarray, counts: np.ndarray) -> None:
    """Add the expected counts of a word of any length, in log scale."""
    logp, ends = np.log(np.maximum(p, 1e-300)), long_lattice(word, pieces)
    alpha, beta = np.full(len(word) + 1, -np.inf), np.full(len(word) + 1, -np.inf)
    alpha[0] = beta[-1] = 0
    for e, found in enumerate(ends, 1):
        for s, k in found:
            alpha[e] = np.logaddexp(alpha[e], alpha[s] + logp[k])
    for e in range(len(word), 0, -1):
        for s, k in ends[e - 1]:
            beta[s] = np.logaddexp(beta[s], beta[e] + logp[k])
    for e, found in enumerate(ends, 1):
        for s, k in found:
            counts[k] += n * np.exp(alpha[s] + logp[k] + beta[e] - alpha[-1])


def fit(rows: list[tuple[int, str, str]], pieces: dict[str, int], rounds: int = 3, extra: float = 0.02) -> Model:
    """Piece probabilities of each language by `rounds` of expectation maximisation from even ones; `extra` is added to each count."""
    languages = sorted({y for *_, y in rows})
    p = np.zeros((len(pieces) + 1, len(languages)))
    for k, y in enumerate(languages):
        words = Counter(w for _, t, lang in rows if lang == y for w in letters(t.lower()))
        own = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
        for _ in range(rounds):
            own = expected(words, pieces, own) + extra
            own /= own.sum()
        p[:, k] = own
    return Model(languages, pieces, p)


def train(docs: DataFrame, vocabulary: str = VOCABULARY, mod: int = 3, out: int = 1, per_language: int = 150, max_chars: int = 20_000) -> Model:
    """Fit on at most `per_language` texts of each language, of `max_chars` characters at most, from the folds crc32(doc_id) mod `mod` <> `out`.

    A language is learned from the texts of the rows that carry it: an id that repeats gives one text, the smallest, to each
    of its languages. Rows without an id, a text or a lang are left out. Over 1000 languages: ValueError; see
    `labelled_texts` for how many texts and characters reach the driver.
    """
    rows = docs.where((fold("doc_id", mod) != out) & F.col("lang").isNotNull())
    return fit(labelled_texts(docs, rows, "lang", per_language, max_chars, own=True), read_pieces(vocabulary))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of the whole text and its posterior probability, languages being equally likely before.

    `und` with score 0 for null texts, texts without letters, and all texts if there was nothing to learn from. Ties go to the first language by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        logs = np.empty((0, len(model.languages)))
        for b in slices(batches, "text"):
            words = [letters(t.lower()) if t and model.languages else [] for t in b.column(1).to_pylist()]
            new = list(dict.fromkeys(w for ws in words for w in ws if w not in memo))
            if len(memo) + len(new) > MEMO:
                memo.clear()
                logs = logs[:0]
                new = list(dict.fromkeys(w for ws in words for w in ws))
            if new:
                memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
                logs = np.concatenate([logs, word_logs(new, model.pieces, model.p)])
            lang, score = ["und"] * len(words), np.zeros(len(words))
            for i, ws in enumerate(words):
                if ws:
                    total = logs[np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))].sum(0)
                    k = int(total.argmax())
                    lang[i], score[i] = model.languages[k], 1 / np.exp(total - total[k]).sum()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def predict(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each document; repeated rows stay, an empty table gives an empty one."""
    return identify(docs, train(docs, vocabulary)).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
