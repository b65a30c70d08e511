import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import keyed, matrices, sets, spd, student
from plumbline.operators import events


def test_t_quantiles_match_published_tables():
    for df, t975, t95 in ((1, 12.7062, 6.3138), (5, 2.5706, 2.0150), (24, 2.0639, 1.7109), (120, 1.9799, 1.6577)):
        assert student.t_ppf(0.975, df) == pytest.approx(t975, abs=1e-4)
        assert student.t_ppf(0.95, df) == pytest.approx(t95, abs=1e-4)
    assert student.t_sf(2.0639, 24) == pytest.approx(0.025, abs=1e-5)
    assert student.t_sf(-math.inf, 3) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-60, 60), min_size=1, max_size=9, unique_by=abs))
def test_wilcoxon_equals_enumeration(x):
    x = [v for v in x if v]
    if not x:
        assert student.wilcoxon_greater(x) is None
        return
    ranks = {v: r for r, v in enumerate(sorted(map(abs, x)), 1)}
    w = sum(ranks[abs(v)] for v in x if v > 0)
    sums = [sum(s) for s in itertools.product(*[(0, r) for r in ranks.values()])]
    assert student.wilcoxon_greater(x) == pytest.approx(sum(s >= w for s in sums) / len(sums))


def test_closed_forms_equal_eigenvalues(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(60):
        a, b = (m @ m.T + 0.2 * np.eye(2) for m in rng.normal(size=(2, 2, 2)))
        pairs.append((a.ravel().tolist(), b.ravel().tolist()))
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    rows = df.select("a", "b", *[f(F.col("a"), F.col("b")).alias(k) for k, f in matrices.METRICS.items()], matrices.shrink(F.col("a"), 0.1, 2).alias("s")).collect()
    for r in rows:
        a, b = (np.array(r[k]).reshape(2, 2) for k in "ab")
        for k, f in spd.METRICS.items():
            assert r[k] == pytest.approx(float(f(b[None], a)[0]), rel=1e-8, abs=1e-10)
        assert np.allclose(np.array(r["s"]).reshape(2, 2), spd.shrink(a, 0.1))


def test_spd_kernels():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 4, 9))
    a = x @ np.swapaxes(x, 1, 2) / 9
    assert np.allclose(spd.exp_sym(spd.log_spd(a)), a)
    m = spd.frechet_mean(a)
    assert np.allclose(spd.log_spd(spd.powered(m, lambda v: v**-0.5) @ a @ spd.powered(m, lambda v: v**-0.5)).mean(0), 0, atol=1e-3)
    t = spd.tangent(a, m)
    assert t.shape == (20, 10)
    assert np.allclose((t**2).sum(1), spd.affine2(a, m))
    g = rng.normal(size=(4, 4))
    assert np.allclose(spd.affine2(g @ a @ g.T, g @ m @ g.T), spd.affine2(a, m))  # affine invariance


def test_lda_separates_and_keeps_dimensions():
    rng = np.random.default_rng(0)
    y = np.repeat([0, 1], 40)
    x = rng.normal(size=(80, 6)) + 2.5 * y[:, None] * (np.arange(6) == 0)
    said = spd.lda(x[::2], y[::2], x[1::2])
    assert spd.balanced_accuracy(y[1::2], said) > 0.8


def test_keyed_numbers(spark):
    d = spark.range(20000).select(keyed.index(F.lit(7), 1, F.col("id")).alias("i"), keyed.normal(2, F.col("id")).alias("z"), keyed.poisson(keyed.value(keyed.digest(3, F.col("id")), F.lit(4))).alias("w"))
    r = d.agg(F.min("i"), F.max("i"), F.avg("z"), F.stddev("z"), F.avg("w"), F.var_pop("w")).first()
    assert (r[0], r[1]) == (0, 6)
    assert abs(r[2]) < 0.03 and abs(r[3] - 1) < 0.03 and abs(r[4] - 1) < 0.03 and abs(r[5] - 1) < 0.05
    assert d.exceptAll(spark.range(20000).repartition(13).select(*[d[c] for c in ()] or ["id"]).select(keyed.index(F.lit(7), 1, F.col("id")).alias("i"), keyed.normal(2, F.col("id")).alias("z"), keyed.poisson(keyed.value(keyed.digest(3, F.col("id")), F.lit(4))).alias("w"))).count() == 0


def test_polynomials_agree(spark):
    d = spark.range(50).select("id", keyed.coefficients(9, F.col("id")).alias("c"), *[keyed.value(keyed.digest(9, F.col("id")), F.lit(g)).alias(f"g{g}") for g in (1, 2, 199, 2_000_000_011)])
    for r in d.collect():
        c = keyed.words(bytes(r["c"]))[0]
        for g in (1, 2, 199, 2_000_000_011):
            want = sum(int(a) * pow(g, 3 - k, keyed.PRIME) for k, a in enumerate(c)) % keyed.PRIME
            assert r[f"g{g}"] == want == keyed.values(c, np.array([g]))[0]


def test_weighted_sums_are_those_of_the_counts():
    rng = np.random.default_rng(4)
    c, x, g = keyed.words(rng.bytes(16 * 700)), rng.normal(size=(700, 3)), np.arange(1, 50)
    w = keyed.COUNTS[keyed.values(c[:, None, :], g[None, :]) >> 15]
    assert np.allclose(keyed.weighted_sums(c, g, x), w.T @ x) and 0.9 < w.mean() < 1.1 and 0.9 < w.var() < 1.1


def test_sets(spark):
    r = spark.sql("select array(1,2) a, array(2,3) b, cast(array() as array<int>) e, '1-3, 7,2' s").select(sets.jaccard("a", "b"), sets.jaccard("e", "e"), sets.jaccard("a", "e"), sets.subset("e", "a"), sets.same("a", "b"), sets.parse_ranges("s")).first()
    assert list(r) == [pytest.approx(1 / 3), 1.0, 0.0, True, False, [1, 2, 3, 7]]


GOOD = [(1, 1000), (5, 769), (9, 7691), (30, 7692), (40, 770), (44, 7701), (45, 7703)]


def test_tasks_of_a_file():
    assert [f[:5] for f in events.tasks(GOOD)] == [(9, 30, 0, 5, 7692), (44, 45, 1, 40, 7703)]
    bad = ([(1, 769), (2, 770)], [(1, 769), (2, 7701)], [(1, 7691)], [(1, 769), (2, 7691), (2, 7692)], [(1, 769), (2, 7691)], [(1, 769), (2, 1000)], [(3, 769), (3, 7691), (9, 7692)])
    for events_ in bad:
        with pytest.raises(ValueError):
            events.tasks(events_)
    found = list(events.walk([(1, 769), (2, 770), *[(a + 10, c) for a, c in GOOD], (99, 770)]))  # a break, then whole tasks, then an open cue
    assert [f.reason is None for f in found] == [False, True, True, False] and found[1].start == 19


def test_violations_as_rows(spark):
    rows = [("a", 1, "cue", 0), ("a", 2, "start", 1), ("a", 3, "end", 0), ("a", 4, "cue", 0), ("a", 5, "cue", 0), ("a", 6, "start", 0), ("a", 9, "end", 0), ("b", 1, "start", 0), ("b", 2, "cue", 1)]
    got = events.violations(spark.createDataFrame(rows, "f string, at int, kind string, l int"), "f", "at", "kind", "cue", "start", "end", "l")
    assert {tuple(r) for r in got.collect()} == {("a", 2, "start of another cue"), ("a", 5, "cue before the last task ended"), ("b", 1, "start without a cue"), ("b", 2, "cue before the last task ended")}
    s = spark.createDataFrame([(1, 5, True, False), (2, 60, False, True), (3, 60, None, True), (4, 60, True, True), (5, 60, True, None), (6, None, True, None)], "k int, dur int, inside boolean, noisy boolean")
    assert [r["exclusion_reason"] for r in events.quality_ledger(s, "dur", 50, F.col("inside"), F.col("noisy")).orderBy("k").collect()] == ["short", "bounds", "bounds", "artifact", None, "short"]
