"""Secret scans: key patterns, and values in credential contexts whose guess cost is high.

The guess cost of a value is the least sum, over its segmentations, of the bits to guess each segment as a word of a
ranked list, a date, a repeat, a keyboard walk, a run of the alphabet, or by brute force (dynamic programming over ends).
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A failing shorter run has no longer one inside, so the least lengths can be part of these two patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Wider contexts, whose values count by guess cost only: the whole run, behind an HTTP authentication scheme if one is named.
CONTEXT = re.compile(
    r"""(?ai:\b|_)(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization|bearer)"""
    r"""["']?(?:[ \t]*(?::=|=>|[:=])[ \t]*|[ \t]+(?:is|was)[ \t]+)["'`]?"""
    r"""(?:(?ai:basic|bearer|digest|dpop|gnap|hawk|hoba|mutual|negotiate|ntlm|oauth|scram-sha-(?:1|256)|vapid|token|api-?key|bot|ssws|aws4-hmac-sha256)[ \t]+["'`]?)?([!-&(-_a-~]{6,})"""
)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer")
#: Rows of a US keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
LEET = str.maketrans("013457@$!", "oieastasi")
DATE_BITS = math.log2(365 * 120)
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def word_bits(path: str | None = VOCABULARY, least: int = 3) -> dict[str, float]:
    """Bits of the rank of each word that ends a word in a public vocabulary (a file of fixed size, read on the driver). None: no words, by choice; a missing file is an error."""
    if path is None:
        return {}
    ranked = sorted(json.loads(Path(path).read_text())["model"]["vocab"].items(), key=lambda x: x[1])
    words = [w.removesuffix("</w>") for w, _ in ranked if w.endswith("</w>")]
    words = [w for w in dict.fromkeys(words) if len(w) >= least and w.isascii() and w.isalpha()]
    return {w: math.log2(i + 2) for i, w in enumerate(words)}


def neighbours() -> set[str]:
    """Ordered pairs of keys that touch, in lower case."""
    found = set()
    for y, row in enumerate(ROWS):
        for x, a in enumerate(row):
            near = [row[x + 1 : x + 2]] + ([ROWS[y + 1][k] for k in (x - 1, x) if 0 <= k < len(ROWS[y + 1])] if y + 1 < len(ROWS) else [])
            found |= {p for b in near if b for p in (a + b, b + a)}
    return found


def char_bits(value: str) -> float:
    size = sum(n for n, has in ((26, str.islower), (26, str.isupper), (10, str.isdigit)) if any(map(has, value)))
    return math.log2(max(10, size + 33 * any(not c.isalnum() for c in value)))


def guess_bits(value: str, words: dict[str, float], near: set[str], enough: float = math.inf) -> float:
    """The least cost, in bits, over all segmentations of `value`; 0 for an empty one. Each segment costs one bit more, for its kind and end.

    Every segmentation has, in any 24 places running, one where it ends or can be cut for no more than it costs. So if the
    least costs up to all of them reach `enough`, the whole does, and a bound is returned. Time is linear in the length:
    of the starts of a walk, run or repeat only those are kept that can still be the cheapest.
    """
    n, low = len(value), value.lower()
    plain, longest = low.translate(LEET), 24
    single = char_bits(value)
    dates: dict[int, list[int]] = {}
    for s in range(n):
        if low[s].isdigit() and (m := DATE.match(low, s)):
            dates.setdefault(m.end(), []).append(s)
    walk = run = same = 0
    from_walk = from_run = 0
    from_same: list[int] = []
    times = {u: [0] * u for u in (2, 3, 4)}
    from_unit: dict[int, list[list[int]]] = {u: [[] for _ in range(u)] for u in (2, 3, 4)}
    best = [0.0] * (n + 1)

    def cheapest(starts: list[int], new: int, cost: Callable[[int], float]) -> float:
        """Add a start; drop those that another one undercuts for good: a later one with no higher cost before it, or an earlier one that is cheaper by now, as log2 flattens."""
        while starts and best[starts[-1]] >= best[new]:
            starts.pop()
        starts.append(new)
        least, kept = math.inf, []
        for s in starts:
            if (c := best[s] + cost(s)) < least:
                least = c
                kept.append(s)
        starts[:] = kept
        return least

    for e in range(1, n + 1):
        pair = low[e - 2 : e]
        walk = walk + 1 if e > 1 and pair in near else 0
        run = run + 1 if e > 1 and pair.isalnum() and ord(pair[1]) - ord(pair[0]) in (1, -1) else 0
        same = same + 1 if e > 1 and pair[0] == pair[1] else 0
        least = best[e - 1] + single
        for length in range(3, min(longest, e) + 1):
            s = e - length
            if (bits := words.get(low[s:e])) is None and (bits := words.get(plain[s:e])) is not None:
                bits += 1.5
            if bits is not None:
                least = min(least, best[s] + bits + 1 + (value[s:e] != low[s:e]))
        for s in dates.get(e, ()):
            least = min(least, best[s] + DATE_BITS + 1)
        if walk >= 2:  # every step adds as much to all starts, so their order stays
            s = e - 3
            from_walk = s if walk == 2 or best[s] + 1.5 * 2 <= best[from_walk] + 1.5 * (e - 1 - from_walk) else from_walk
            least = min(least, best[from_walk] + single + 1.5 * (e - 1 - from_walk) + 1)
        if run >= 2:
            s = e - 3
            from_run = s if run == 2 or best[s] + 0.2 * 2 <= best[from_run] + 0.2 * (e - 1 - from_run) else from_run
            least = min(least, best[from_run] + single + 0.2 * (e - 1 - from_run) + 1)
        for u in (2, 3, 4):
            c = e % u
            if e >= 2 * u and low[e - 2 * u : e - u] == low[e - u : e]:
                times[u][c] += 1
                found = cheapest(from_unit[u][c], e - 2 * u, lambda s: math.log2((e - s) // u - 1))
                least = min(least, found + u * single + 1)
            elif times[u][c]:
                times[u][c] = 0
                from_unit[u][c].clear()
        if same >= 2:
            least = min(least, cheapest(from_same, e - 3, lambda s: math.log2(e - s)) + single + 1)
        elif not same:
            from_same.clear()
        best[e] = least
        if least >= enough and e % 8 == 0 and e >= longest and (bound := min(best[e - longest + 1 : e + 1])) >= enough:
            return bound
    return best[n]


def scan(text: str, words: dict[str, float], near: set[str], bits: float) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, by start, then kind."""
    spans = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:)]}\"'")
            if len(value) >= 6 and guess_bits(value, words, near, bits) >= bits:
                spans.append((m.start(1), 3, m.start(1) + len(value)))
    return sorted(set(spans))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, bits: float = 33.0, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_guess (values of 2**bits guesses or more).

    Offsets are code points of the whole text, ends exclusive. Null texts count as empty: no spans, the digest of nothing.
    Repeated rows stay; an empty table gives an empty one; other columns are not read.
    """
    words, near = word_bits(vocabulary), neighbours()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [scan(t or "", words, near, bits) for t in b.column(1).to_pylist()]
            count = lambda k: pa.array([sum(x[1] == k for x in s) for s in found], pa.int64())
            base = [hashlib.sha256(told([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), count(0), count(1), count(2), pa.array(base), pa.array([told(s) for s in found], pa.string()), count(3)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact(docs: DataFrame, bits: float = 33.0, vocabulary: str | None = VOCABULARY, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every span replaced by `mark` (overlapping spans: once), to its end however long; n_chars, if there, follows.

    Texts without spans, null and empty ones too, stay as they are, and so do ids, repeated rows and columns of any name; an empty table gives an empty one.
    """
    words, near = word_bits(vocabulary), neighbours()
    names = docs.columns

    def clean(text: str | None) -> str | None:
        spans = scan(text, words, near, bits) if text else []
        if not spans:
            return text
        out, at = [], 0
        for s, _, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in slices(batches, "text"):
            cols = b.columns
            cols[at] = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
