"""The joins, searches and counts added last, against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import chosen_path, collocations, negatives

WORDS = "the of and river stone light house green winter paper silver garden engine market signal carbon violet harbor".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


# ---- near duplicates by similarity


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} or ({" ".join(w)} if w else set())


def least_ids(rows, n, percent=80):
    """(doc_id, set size, smallest id reachable) by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), i if not s else least.get(find(k)), i is not None and (not s or least.get(find(k)) == i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, words, share):
    return [rng.choice(WORDS) + "x" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def texts():
    """Two bases with many edited copies (a chain of similarities round 0.8), exact copies, and texts alone."""
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.choice([6, 40, 150]), [f"{w}{n}" for w in WORDS for n in range(9)])) for k in range(60)]
    for base, many in ((200, 45), (300, 25)):
        words = prose(rng, 140, [f"{w}{n}" for w in WORDS for n in range(30)]).split()
        rows += [(base + k, " ".join(edited(rng, words, rng.choice([0.01, 0.03, 0.06])))) for k in range(many)]
    rows += [(400, rows[3][1].upper()), (401, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])]
    return rows + [(500, None), (501, ""), (502, " \t\n"), (503, "One"), (504, "one"), (505, "one two"), (None, "no id here at all today"), (None, rows[70][1]), (506, prose(rng, 20000)), (507, "é è"), (508, "É è")]


def docs(spark, rows):
    d = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    return d.selectExpr("*", "1 as n", "2 as node", "'x' as digest", "3 as component_id", "'y' as label", "4 as _row").repartition(5)


@pytest.mark.parametrize(("words", "options"), [(2, {}), (5, {}), (2, {"few": 8, "room": 1500}), (2, {"few": 4, "room": 700})])
def test_near_duplicates_equal_brute_force(spark, texts, words, options):
    got = chosen_path.near_duplicates(docs(spark, texts), words=words, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == least_ids(texts, words)


def test_near_duplicates_of_nothing(spark, texts):
    assert chosen_path.near_duplicates(docs(spark, []), words=2).count() == 0
    only = [(1, None), (2, "")]
    assert Counter(map(tuple, chosen_path.near_duplicates(docs(spark, only), words=2).collect())) == {(1, 0, 1, True): 1, (2, 0, 2, True): 1}
    named = spark.createDataFrame([("b", "one two three"), ("a", "one two three")], "doc_id string, text string")
    assert sorted(map(tuple, chosen_path.near_duplicates(named, words=2).collect())) == [("a", 2, "a", True), ("b", 2, "a", False)]


def test_trees_find_pairs_at_the_threshold(spark):
    """Pairs just above the threshold, alone: 16 trees find all of 150."""
    rng = random.Random(8)
    rows = []
    for k in range(150):
        words = [f"w{k}_{j}" for j in range(200)]
        other = words.copy()
        for j in rng.sample(range(4, 196, 4), 11):  # 22 of 199 shingles differ: 177 / 221
            other[j] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    both = len(shingles(rows[0][1], 2) & shingles(rows[1][1], 2))
    assert 0.8 <= both / len(shingles(rows[0][1], 2) | shingles(rows[1][1], 2)) < 0.81
    got = chosen_path.near_duplicates(docs(spark, rows), words=2).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)


# ---- hard negatives


def mined(rows, k=5):
    """All scores in whole numbers of Python."""
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for i, y, v in {(i, y, tuple(v)) for i, y, v in rows if i % 100 == 0}:
        scores = {(sum(a * b for a, b in zip(v, w, strict=True)), j, z == y) for j, z, w in rows if j != i and len(w) == len(v)}
        order = sorted(scores, key=lambda s: (-s[0], s[1]))
        for p, j, same in [s for s in order if s[2]][:k]:
            found = [s for s in order if not s[2] and 80 * p <= 100 * s[0] <= 100 * p][:k]
            for rank, (n, m, _) in enumerate(found, 1):
                out[i, j, rank, m, p, n] += 1
    return out


def vectors(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as id", "'x' as query", "2 as v").repartition(parts)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 6))
    rows = [(k, int(k % 10), [float(np.float32(x)) for x in centres[k % 10] * rng.uniform(0.2, 1) + rng.normal(size=6) * 0.6]) for k in range(1500)]
    rows += [(rows[k][0] + 2000, rows[k][1], rows[k][2]) for k in range(0, 300, 3)]  # ties
    rows += [(5000, None, [1.0] * 6), (5001, 1, None), (None, 1, [1.0] * 6), (5002, 1, [1.0, None] * 3), (5100, 2, [float("nan")] * 6), (5200, 2, [float("inf")] * 6), (100, *rows[100][1:]), (101, 4, rows[100][2]), (5300, 3, [0.5, 0.5]), (5301, 3, [0.5, 0.25]), (5302, 4, [0.25, 0.5]), (5400, 1, []), (5401, 1, []), (5402, 2, [])]
    want = mined(rows)
    assert len(want) > 150 and any(k[0] == 5300 for k in want) and any(k[0] == 5400 for k in want)
    for options in ({}, {"block_bytes": 20_000}):
        assert Counter(map(tuple, negatives.hard_negatives(vectors(spark, rows), **options).collect())) == want


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(100, 1, [1.0])])).count() == 0
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(vectors(spark, [(100, 1, [3e9]), (101, 1, [3e9])])).count()


def test_balls_bound_and_leave_out():
    """Few of the leaves are multiplied where clusters lie apart, and the best stay the best."""
    rng = np.random.default_rng(4)
    x = np.rint(np.concatenate([rng.normal(size=(600, 4)) * 20 + c for c in 1000 * rng.normal(size=(20, 4))]))
    ids = np.arange(len(x))
    q = x[[7]]
    whole = (x @ q[0]).astype(np.int64)
    low, high = int(np.quantile(whole, 0.7)), int(np.quantile(whole, 0.8))
    w = negatives.Queries(q, np.array([0]), np.array([0]), np.array([-1]), np.array([low]), np.array([high]), np.full((1, 5), negatives.NONE), np.zeros((1, 5), np.int64))
    seen = []
    tree = negatives.plant(x, ids)
    real, negatives.better = negatives.better, lambda w, at, score, i: (seen.append(len(i)), real(w, at, score, i))
    try:
        negatives.search(tree, x, ids, w, np.array([0]))
    finally:
        negatives.better = real
    order = [int(i) for i in np.lexsort((ids, -whole)) if low <= whole[i] <= high][:5]
    assert w.ids[0].tolist() == order and sum(seen) < len(x) / 4


# ---- collocations


def phrases(rows, least, most_words=5, most=2000, absorb=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(a, inside.get(p[i : i + k], 0))
        own = []
        for p, a in some.items():
            if 100 * inside.get(p, -1) >= absorb * a:
                continue
            score, k = min((int(Fraction(1000 * a * n[lang], c[p[:k]] * c[p[k:]])), k) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(own)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(12)
    fixed = ["New York City hall", "once upon a time there was", "a a a a a a a", "über alles über Alles", "x\x0by z"]
    rows = []
    for _ in range(300):
        words = prose(rng, 20).split()
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(fixed) + rng.choice(["", ",", "!", "\n", "\t"]))
        rows.append((" ".join(words), rng.choice(["en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), (" \t\n.,", "en"), ("a.b.c", "en"), ("only", "fr"), ("  \u0085   the", "en"), (" ".join(["so on"] * 4000), "es")]


@pytest.mark.parametrize("options", [{"least": 5}, {"least": 3, "most": 7, "absorb": 60}, {"least": 10, "most_words": 2}, {"least": 10**6}])
def test_collocations_equal_brute_force(spark, talk, options):
    d = spark.createDataFrame(talk, "text string, lang string").selectExpr("*", "1 as phrase", "'x' as f", "2 as words", "3 as n").repartition(3)
    got = collocations.collocations(d, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(talk, options["least"], options.get("most_words", 5), options.get("most", 2000), options.get("absorb", 100))
    assert sorted(map(tuple, got.collect())) == want and (want or options["least"] > 1000)


def test_collocations_in_small_chunks_and_exact_scores(spark):
    texts = [b"one two three. one two", None, b"four " * 50, b"", b"a\n" * 30]
    for room in (4, 16, 1 << 20):
        for n in (1, 2):
            total = Counter()
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(["en", None, "de", "en", "en"])], names=["text", "lang"])
            for b in collocations.counted(batch, n, room):
                for r in b.to_pylist():
                    total[r["lang"], r["phrase"]] += r["f"]
            assert (total["en", "one"], total["de", "four"], total["en", ""], total["en", "a"]) == ((2, 50, 35, 30) if n == 1 else (0, 0, 0, 0))
            assert (total["en", "one two"], total["de", "four four"]) == ((0, 0) if n == 1 else (2, 49))
    big = spark.sql("select cast(9e12 as bigint) a, cast(9e14 as bigint) n, cast(9e12 as bigint) l, cast(9e12 as bigint) r")
    score = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))"
    assert big.selectExpr(score).first()[0] == 1000 * 9 * 10**12 * 9 * 10**14 // (81 * 10**24)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0
