import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import spd
from plumbline.operators import discrepancy, evaluate, gates, inference, learn, resample, roles, system, validate
from plumbline.plans.screening import METHODS, screen
from plumbline.sources import files, npz, synthetic


def reference_system(est, draws, a=(0.025, 0.025, 0.05)):
    k = len(est)
    pairs = [(j, m) for j in range(k) for m in range(k) if j != m]
    se = np.maximum(draws.std(0, ddof=1), 1e-12)
    dh = np.array([est[j] - est[m] for j, m in pairs])
    dd = np.array([[d[j] - d[m] for j, m in pairs] for d in draws])
    sd = np.maximum(dd.std(0, ddof=1), 1e-12)
    tc, td = (np.abs(draws - est) / se).max(1), (np.abs(dd - dh) / sd).max(1)
    q = np.quantile(tc, 1 - a[0]), np.quantile(td, 1 - a[1]), np.quantile(np.maximum(tc, td), 1 - a[2])
    return pairs, se, dh, sd, q, dd


def reference_stepdown(est, draws, alpha=0.05):
    """The loop: drop the worst while the largest studentised gap to the best is significant."""
    pairs, _, dh, sd, _, dd = reference_system(est, draws)
    at = {p: i for i, p in enumerate(pairs)}
    active = list(range(len(est)))
    while len(active) > 1:
        best, worst = min(active, key=lambda k: (est[k], k)), min(active, key=lambda k: (-est[k], k))
        own = [at[p] for p in itertools.permutations(active, 2)]
        seen = max((est[k] - est[best]) / sd[at[k, best]] for k in active if k != best)
        if seen <= np.quantile(((dd[:, own] - dh[own]) / sd[own]).max(1), 1 - alpha):
            break
        active.remove(worst)
    return set(active)


def frames(spark, cases):
    e = [(c, k, float(v)) for c, (est, _) in cases.items() for k, v in enumerate(est)]
    d = [(c, b, k, float(v)) for c, (_, draws) in cases.items() for b, row in enumerate(draws) for k, v in enumerate(row)]
    return spark.createDataFrame(e, "case_id string, source int, delta double"), spark.createDataFrame(d, "case_id string, b int, source int, delta double")


@pytest.fixture(scope="module")
def cases():
    out = {}
    for k, b, seed in ((3, 60, 0), (5, 150, 31), (9, 80, 57)):
        rng = np.random.default_rng(seed)
        est = np.sort(rng.uniform(0, 1.5, k))
        out[f"c{k}"] = est, est + rng.normal(0, 0.08, (b, 1)) + rng.normal(0, 0.12, (b, k))
    out["tied"] = np.array([0.2, 0.2, 0.9]), np.array([0.2, 0.2, 0.9]) + np.random.default_rng(4).normal(0, 0.2, (80, 3))
    out["flat"] = np.zeros(3), np.zeros((50, 3))
    return out


def test_bounds_and_gates_equal_numpy(spark, cases):
    est, draws = frames(spark, cases)
    s = system.build(est, draws)
    got = {(r["case_id"], r["source"]): r for r in gates.gates(s).collect()}
    mcs = {(r["case_id"], r["source"]): r["mcs"] for r in gates.stepdown(est, draws).collect()}
    for c, (e, d) in cases.items():
        pairs, se, dh, sd, q, _ = reference_system(e, d)
        upper, lower = e + q[0] * se, e - q[0] * se
        low_d = dh - q[1] * sd
        for k in range(len(e)):
            r = got[c, k]
            assert r["lower"] == pytest.approx(lower[k], abs=1e-9) and r["upper_j"] == pytest.approx(e[k] + q[2] * se[k], abs=1e-9)
            rect, pair = int(lower[k] <= upper.min()), int(not any(low_d[i] > 0 for i, p in enumerate(pairs) if p[0] == k))
            assert (r["rect"], r["pair"], r["ref"]) == (rect, pair, rect * pair)
            assert mcs[c, k] == int(k in reference_stepdown(e, d)), (c, k)
        assert got[c, int(e.argmin())]["ref"] == 1


def test_simple_rules(spark):
    est = spark.createDataFrame([("c", 0, 0.0), ("c", 1, 0.05), ("c", 2, 0.05), ("c", 3, 1.0), ("e", 0, 0.3), ("e", 1, 0.3)], "case_id string, source int, delta double")
    r = {(x["case_id"], x["source"]): x for x in gates.simple(est, 0.1).collect()}
    assert [r["c", k]["top1"] for k in range(4)] == [1, 0, 0, 0] and [r["c", k]["top3"] for k in range(4)] == [1, 1, 1, 0]
    assert [r["c", k]["threshold"] for k in range(4)] == [1, 1, 1, 0] and [r["c", k]["midpoint"] for k in range(4)] == [1, 1, 1, 0]
    assert r["e", 1]["midpoint"] == 1


def test_draws_are_keyed_and_shared(spark):
    rows = [("c", s, s == 2, i, float((i * 7 + s) % 11), 0.0, f"{s}-{i}") for s in range(3) for i in range(30)]
    t = spark.createDataFrame(rows, "case_id string, source int, is_target boolean, i long, x1 double, x2 double, row_key string")
    for draw in (lambda x: resample.index_draws(x, ["x1"], 9, 5), lambda x: resample.poisson_draws(x, ["x1"], 9, 5, ["row_key"]), lambda x: resample.index_draws(x, ["x1"], 9, 5, block=4)):
        a, b = draw(t), draw(t.repartition(7))
        for x, y in zip(a, b, strict=True):
            key = [c for c in x.columns if c not in ("x1", "n")]
            assert validate.tables_close(x, y, key, ["x1"]).count() == 0
        assert a[1].count() == 9 and a[0].count() == 18
    for size in (4, 7, resample.LEAF):  # with and without splits
        w = resample.multinomial_counts(t, 4, 3, size).groupBy("source", "b").agg(F.sum("w")).collect()
        assert {r[2] for r in w} == {30} and len(w) == 12
    _, wrong = resample.index_draws(t, ["x1"], 9, 5, shared=False)
    assert wrong.groupBy("b").agg(F.count_distinct("x1").alias("n")).where("n > 1").count() > 0


def test_splits_of_draws_are_multinomial():
    """Counts over leaves add up, and follow numpy's law: means, variances and covariances, and a chi-square over all positions."""
    n, size, many = 53, 8, 4000
    w = np.hstack([resample.weights_of(n, k, "t", many, 1, size) for k in range(7)])
    assert w.shape == (many, n) and (w.sum(1) == n).all()
    total = w.sum(0)
    chi = ((total - many) ** 2 / (many * (1 - 1 / n))).sum() * (n - 1) / n
    assert 25 < chi < 90  # 52 degrees of freedom
    assert abs(w.var(0).mean() - (1 - 1 / n)) < 0.03
    halves = np.stack([w[:, :24].sum(1), w[:, 24:].sum(1)])
    assert abs(np.cov(halves)[0, 1] + n * (24 / n) * (29 / n)) < 0.8
    before = [resample.leaf_draws(n, k, "t", 5, n, size).before for k in range(7)]
    assert np.array_equal(np.array(before)[1:], np.cumsum([w[:5, 8 * k : 8 * k + 8].sum(1) for k in range(7)], axis=0)[:-1])
    far = 3 * 10**9  # beyond 2^31 positions, each part gets its share
    got = [resample.leaf_draws(far, k, "x", 50, far).before[:] / far for k in (100_000, 300_000)]
    assert all(abs(g.mean() - k * resample.LEAF / far) < 1e-4 for g, k in zip(got, (100_000, 300_000), strict=True))


@pytest.mark.parametrize(("n", "block", "size"), [(53, 4, 8), (53, 20, 8), (40, 8, 8), (17, 17, 4), (17, 40, 4), (30, 7, 64)])
def test_circular_blocks_in_leaves(n, block, size):
    """n draws in all; runs of at least a block, but for the cut one; every position alike."""
    many = 3000
    w = np.hstack([resample.weights_of(n, k, "t", many, block, size) for k in range(-(-n // size))])
    assert w.shape == (many, n) and (w.sum(1) == n).all()
    assert abs(w.mean(0) - 1).max() < 5.5 * np.sqrt(min(block, n) / many)
    rises = np.maximum(w - np.roll(w, 1, axis=1), 0).sum(1)
    assert rises.max() <= -(-n // block)


def test_leaves_give_the_means_of_their_weights(spark):
    rows = [("c", s, s == 2, i, float((i * 7 + s) % 11), float(i)) for s in range(3) for i in range(30)]
    t = spark.createDataFrame(rows, "case_id string, source int, is_target boolean, i long, x1 double, x2 double").repartition(5)
    for block in (1, 4):
        s, tg = resample.index_draws(t, ["x1", "x2"], 6, 5, block=block, size=8)
        for r in [*s.collect(), *tg.withColumn("source", F.lit(2)).collect()]:
            tag = f"5|s|c|{r['source']}" if r["source"] < 2 else "5|t|c|-1"
            w = np.hstack([resample.weights_of(30, k, tag, 6, block, 8) for k in range(4)])[r["b"]]
            x = np.array([[(i * 7 + r["source"]) % 11, i] for i in range(30)])
            assert np.allclose([r["x1"], r["x2"]], w @ x / 30) and r["n"] == 30


@pytest.mark.parametrize(("block", "span"), [(1, resample.SPAN), (1, 7000), (7, 7000)])
def test_draws_of_long_sessions_are_those_of_the_sql(spark, monkeypatch, block, span):
    """Sessions of more than a leaf, in one span and in several."""
    import duckdb

    from plumbline.plans import oracle

    monkeypatch.setattr(resample, "SPAN", span)
    n = {0: 9000, 1: 8193, 2: 8500}
    t = pd.DataFrame([("c", s, s == 2, i, (i * 7 + s) % 1009 / 8, i / 16) for s in n for i in range(n[s])], columns=["case_id", "source", "is_target", "i", "x1", "x2"])
    want = duckdb.sql(oracle.with_(oracle.index_draws("t", 3, 5, block=block)) + "SELECT source, b, n, x1, x2 FROM sd UNION ALL SELECT 2, b, n, x1, x2 FROM td").fetchall()
    kind = "case_id string, source int, is_target boolean, i long, x1 double, x2 double"
    s, tg = resample.index_draws(spark.createDataFrame(t, kind).repartition(5), ["x1", "x2"], 3, 5, block=block)
    got = {(r["source"], r["b"]): r for r in [*s.collect(), *tg.withColumn("source", F.lit(2)).collect()]}
    assert len(want) == len(got) == 9
    for source, b, rows, *x in want:
        assert got[source, b]["n"] == rows and [got[source, b]["x1"], got[source, b]["x2"]] == pytest.approx(x, abs=1e-9)


def test_outer_samples_hold_rows_as_often_as_drawn(spark):
    rows = [("c", s, s == 2, i, [float(i), float(s)]) for s in range(3) for i in range(30)]
    t = spark.createDataFrame(rows, "case_id string, source int, is_target boolean, i long, x array<double>").repartition(4)
    got = resample.outer_samples(t, "x", 3, 9, size=8).collect()
    for rep in range(3):
        for s in range(3):
            own = sorted((r["i"], r["x"][0]) for r in got if r["case_id"] == f"c/{rep}" and r["source"] == s)
            assert [i for i, _ in own] == list(range(15 if s == 2 else 30)) and [x for _, x in own] == sorted(x for _, x in own)


def kernel_by_hand(x, y, v, w, sigma):
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * sigma**2))
    own = lambda a, c: (c @ k(a, a) @ c - c.sum()) / (c.sum() * (c.sum() - 1))
    return own(x, v) + own(y, w) - 2 * v @ k(x, y) @ w / (v.sum() * w.sum())


def test_kernels_in_tiles(spark):
    rng = np.random.default_rng(2)
    x = {("a", s): rng.normal(s / 4, 1, (n, 3)) for s, n in ((0, 21), (1, 40), (2, 33))} | {("b", 5): rng.normal(0, 1, (9, 3)), ("b", 7): rng.normal(1, 1, (8, 3))}
    c = {k: rng.integers(1, 4, len(v)).astype(float) for k, v in x.items()}
    target = {"a": 2, "b": 7}
    rows = [(k, s, s == target[k], i, v.tolist(), float(c[k, s][i])) for (k, s), m in x.items() for i, v in enumerate(m)]
    t = spark.createDataFrame(rows, "case_id string, source int, is_target boolean, i long, x array<double>, w double").repartition(4)
    for weight, tile in ((None, 8), ("w", 16), (None, 64)):
        got = discrepancy.kernel_distance(t, "x", 1.5, 4, 3, weight, tile=tile, size=64).collect()
        assert len(got) == 3 * 5
        for r in got:
            key, end = (r["case_id"], r["source"]), (r["case_id"], target[r["case_id"]])
            if r["b"] < 0:
                v, w = (c[k] if weight else np.ones(len(x[k])) for k in (key, end))
            else:
                v, w = resample.weights_of(len(x[key]), 0, f"3|s|{key[0]}|{key[1]}", 4, 1, 64)[r["b"]], resample.weights_of(len(x[end]), 0, f"3|t|{key[0]}|-1", 4, 1, 64)[r["b"]]
            assert abs(r["delta"] - kernel_by_hand(x[key], x[end], v, w, 1.5)) < 1e-12


def test_kernels_of_large_cases_copy_no_rows(spark, monkeypatch):
    """One case over the bound and one below it: equal to the sums by hand, and blocks meet without being exploded."""
    plans, cut = [], discrepancy.cut
    monkeypatch.setattr(discrepancy, "NUMBERS", 60)
    monkeypatch.setattr(discrepancy, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    rng = np.random.default_rng(5)
    x = {("a", s): rng.normal(s / 4, 1, (n, 3)) for s, n in ((0, 21), (1, 64), (2, 50))} | {("b", 5): rng.normal(0, 1, (9, 3)), ("b", 7): rng.normal(1, 1, (8, 3))}
    target = {"a": 2, "b": 7}
    rows = [(k, s, s == target[k], i, v.tolist()) for (k, s), m in x.items() for i, v in enumerate(m)]
    t = spark.createDataFrame(rows, "case_id string, source int, is_target boolean, i long, x array<double>").repartition(4)
    got = discrepancy.kernel_distance(t, "x", 1.5, 2, 3).collect()
    assert len(got) == 3 * 3
    for r in got:
        key, end = (r["case_id"], r["source"]), (r["case_id"], target[r["case_id"]])
        tags = (key, f"3|s|{key[0]}|{key[1]}"), (end, f"3|t|{key[0]}|-1")
        v, w = (np.ones(len(x[k])) if r["b"] < 0 else resample.weights_of(len(x[k]), 0, tag, 2)[r["b"]] for k, tag in tags)
        assert abs(r["delta"] - kernel_by_hand(x[key], x[end], v, w, 1.5)) < 1e-12
    assert any("CartesianProduct" in p for p in plans) and not any("Generate" in p for p in plans)


def test_kernel_draws_of_long_sessions_are_those_of_the_sql(spark):
    """A session of more positions than a leaf holds."""
    import hashlib

    prime, b, x, y = (1 << 31) - 1, 1, np.linspace(-1, 1, 8300), np.linspace(0, 2, 11)
    rows = [("c", k, k == 1, i, [v]) for k, m in enumerate((x, y)) for i, v in enumerate(m.tolist())]
    got = discrepancy.kernel_distance(spark.createDataFrame(rows, "case_id string, source int, is_target boolean, i long, x array<double>"), "x", 0.7, 2, 3).where("b = 1").collect()

    def counts(tag, n):
        digest = hashlib.md5(f"3|{tag}|{b}".encode()).digest()
        c = [int.from_bytes(digest[4 * k : 4 * k + 4], "big") & prime for k in range(4)]
        return np.bincount([(((c[0] * g + c[1]) % prime * g + c[2]) % prime * g + c[3]) % prime % n for g in range(1, n + 1)], minlength=n)

    form = lambda p, v, q, w: sum(v[k : k + 500] @ np.exp(-((p[k : k + 500, None] - q[None]) ** 2) / (2 * 0.7**2)) @ w for k in range(0, len(p), 500))
    own = lambda p, v: (form(p, v, p, v) - len(p)) / (len(p) * (len(p) - 1))
    v, w = counts("s|c|0", len(x)), counts("t|c|-1", len(y))
    assert [r["delta"] for r in got] == [pytest.approx(own(x, v) + own(y, w) - 2 * form(x, v, y, w) / (len(x) * len(y)), abs=1e-10)]


def test_blocks_cover_n_positions(spark):
    t = spark.createDataFrame([("c", s, s == 1, i, float(i)) for s in range(2) for i in range(10)], "case_id string, source int, is_target boolean, i long, x1 double")
    s, tg = resample.index_draws(t, ["x1"], 5, 9, block=10)
    assert {round(r["x1"], 9) for r in s.collect()} == {4.5}  # a circular block of n holds every position once


def test_numbering_is_a_permutation(spark):
    df = spark.range(500).select(F.pmod("id", F.lit(3)).alias("g"), F.col("id").cast("string").alias("k"))
    r = roles.numbered(df, ["g"], ["k"]).groupBy("g").agg(F.min("i"), F.max("i"), F.count_distinct("i"), F.count("*")).collect()
    assert all(x[1] == 0 and x[2] == x[3] - 1 == x[4] - 1 for x in r)


def test_splits_partition(spark, monkeypatch):
    t = spark.createDataFrame([("s", k, k % 2) for k in range(62)], "subject string, k int, label int")
    s = resample.half_splits(t, 3, 7, ["subject", "k"])
    assert validate.split_partition(s, ["subject", "k"]).count() == 0
    monkeypatch.setattr(resample, "BUCKET", 5)  # ranked in buckets: the same halves
    assert s.exceptAll(resample.half_splits(t, 3, 7, ["subject", "k"])).count() == 0
    assert {r["count"] for r in s.groupBy("split", "role", "label").count().collect()} == {15, 16}


def test_nested_means_weigh_subjects_equally(spark):
    df = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 1.0), ("x", 1, 1.0), ("x", 2, 3.0)], "dataset string, subject int, v double")
    assert inference.nested_mean(df, [["dataset", "subject"], ["dataset"]], ["v"]).first()["v"] == 2.0


def test_noninferiority_rules(spark):
    df = spark.createDataFrame([("a", v) for v in (-0.005, 0.003, -0.002, 0.001)] + [("b", -0.02)] * 4 + [("c", -0.03)] * 4, "g string, diff double")
    r = {x["g"]: x for x in inference.noninferiority(df, [0.02], ["g"]).collect()}
    assert r["a"]["noninferior"] and r["a"]["p_t"] < 0.01 and r["a"]["within"] == 1.0
    assert not r["b"]["noninferior"] and r["b"]["p_t"] == 0.5 and r["c"]["p_t"] == 1.0


def test_published_wilcoxon_value():
    from plumbline.functions.student import wilcoxon_greater

    assert wilcoxon_greater([5, 4, 3, 6, 7, 8, 9, -2, -1.0]) == pytest.approx(5 / 512, abs=0.01)


def test_signed_ranks_with_zeros_and_ties(spark):
    from plumbline.functions import student

    groups = {"plain": [5, 4, 3, 6, 7, 8, 9, -2, -1.0], "zeros": [0.0, 0.0, 3.0, -1.0, 2.0], "ties": [1.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0], "none": [0.0, 0.0]}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, y double")
    got = inference.signed_ranks(df, ["g"], "y").withColumn("p", student.signed_rank_p(F.col("n_signed"), F.col("w"), F.col("ties"))).collect()
    assert {r["g"]: r["p"] for r in got} == {g: pytest.approx(student.wilcoxon_greater(x)) for g, x in groups.items() if any(x)}
    r = {x["g"]: x for x in got}
    assert (r["ties"]["n_signed"], r["ties"]["w"], r["ties"]["ties"]) == (7, 2 + 2 + 4.5 + 4.5 + 7, 24 + 6)
    assert student.wrong_target_limit() == pytest.approx(0.834, abs=5e-4)


def test_medians_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(inference, "FEW", 5)
    monkeypatch.setattr(inference, "CELLS", 4)
    rng = np.random.default_rng(6)
    cols = {"even": rng.normal(size=100), "odd": rng.exponential(size=101), "ties": rng.integers(0, 3, 90) * 1.0, "far": np.r_[rng.normal(size=99), 1e12], "one": np.ones(7), "gap": np.r_[np.zeros(50), np.ones(50)], "tiny": np.array([2.0, 9.0])}
    long = spark.createDataFrame([(k, float(v)) for k, x in cols.items() for v in x] + [("even", None), ("even", float("nan"))], "quantity string, v double")
    assert {r["quantity"]: r["median"] for r in inference.medians(long).collect()} == {k: pytest.approx(float(np.median(x)), abs=1e-12) for k, x in cols.items()}


def test_simulation_audit_has_no_violation(spark):
    c = spark.createDataFrame([("m", 0, 0.0, 40), ("m", 1, 0.0, 40), ("m", 2, 1.2, 40)], "scenario string, source int, true double, n int")
    s = screen(synthetic.gaussian_cases(spark, c, 3, 2, 8), ["x1", "x2"], 39, 4)
    truth = s.est.select("case_id").distinct().crossJoin(c.where("source > 0").select("source", "true"))
    a = evaluate.audit(gates.gates(s.system), s.system, truth, ["case_id"]).toPandas()
    assert len(a) == 3 and (a[[x for x in a if x.startswith("v_") and "domination_equiv" not in x]].to_numpy() == 0).all()
    m = evaluate.set_metrics(s.members(), truth, ["case_id"])
    assert m.count() == 3 * len(METHODS) and m.where("method = 'all_sources' and oracle_retained = 0").count() == 0


def test_certificate_and_stability(spark, cases):
    est, draws = frames(spark, {k: v for k, v in cases.items() if k != "flat"})
    s = system.build(est, draws)
    flags = gates.gates(s)
    c = gates.certificate(s).join(flags.select("case_id", "source", "rect", "pair"), ["case_id", "source"])
    assert c.where("rect_excluded = rect or pair_excluded = pair or n_witnesses <> size(witnesses)").count() == 0
    sets = evaluate.as_sets(gates.long_members(flags, ["rect", "pair", "ref"]), ["case_id"]).withColumn("budget", F.lit(1))
    r = evaluate.against_reference(sets, 1, ["case_id"])
    assert r.where("jaccard <> 1 or added + removed > 0").count() == 0
    assert evaluate.pairwise_stability(sets, ["case_id"], "budget").where("mean_jaccard <> 1").count() == 0


def test_matrix_draws_equal_direct_means(spark):
    rng = np.random.default_rng(52)
    rows = []
    for source, n, shift in ((0, 13, 0.5), (1, 25, 0.9), (2, 11, 0.2)):
        x = rng.normal(size=(n, 3, 6))
        rows += [("c", source, source == 2, i, (m + shift * np.eye(3)).ravel().tolist()) for i, m in enumerate(x @ np.swapaxes(x, 1, 2) / 6)]
    t = spark.createDataFrame(rows, "case_id string, source int, is_target boolean, i long, cov array<double>")
    for metric in spd.METRICS:
        d = learn.matrix_draws(t, 3, 20, 1, 0.1, metric).toPandas()
        assert len(d) == 42 and np.isfinite(d.delta).all()
        covs = {s: np.array([r[4] for r in rows if r[1] == s]).reshape(-1, 3, 3).mean(0) for s in range(3)}
        e = d[d.b < 0].set_index("source").delta
        for s in (0, 1):
            assert e[s] == pytest.approx(float(spd.METRICS[metric](spd.shrink(covs[s], 0.1)[None], spd.shrink(covs[2], 0.1))[0]), rel=1e-9)
    again = learn.matrix_draws(t.repartition(5), 3, 20, 1, 0.1, "euclid").toPandas().sort_values(["source", "b"])
    first = learn.matrix_draws(t, 3, 20, 1, 0.1, "euclid").toPandas().sort_values(["source", "b"])
    assert np.allclose(again.delta, first.delta)


def test_npz_round_trip_and_contract(spark, tmp_path):
    t = spark.createDataFrame([(1, s, k, f"t{s}-{k}", k % 2, [2.0, 0.5, 0.5, 1.0 + k], 2) for s in (1, 2) for k in range(5)], "subject int, session int, trial int, trial_id string, label int, cov array<double>, n_channels int")
    for r in npz.write_sessions(t, single=False, l_freq=8.0).collect():
        p = tmp_path / f"subject_{r['subject']}" / f"session_{r['session']}.npz"
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(r["content"])
    g = f"{tmp_path}/*/*.npz"
    back = npz.read_trials(spark, g, match={"l_freq": 8.0})
    assert validate.tables_close(back.withColumn("c3", F.col("cov")[3]), t.withColumn("c3", F.col("cov")[3]), ["subject", "session", "trial"], ["label", "c3"]).count() == 0
    assert npz.read_trials(spark, g, match={"l_freq": 4.0}).count() == 0 and npz.stale(spark, g, {"l_freq": 4.0}).count() == 2
    assert npz.strict_violations(back).count() == 0
    bad = t.withColumn("cov", F.when(F.col("trial") == 1, F.array(F.lit(1.0), F.lit(0.2), F.lit(0.3), F.lit(-2.0))).otherwise(F.col("cov")))
    assert {r["check"] for r in npz.strict_violations(bad).collect()} == {"not symmetric", "no positive trace"}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "k string, v double")
    files.write_csv(df, f"{tmp_path}/c")
    back = files.read_csv(spark, f"{tmp_path}/c", "k string, v double", ["k", "v"])
    assert {tuple(r) for r in back.collect()} == {("a", 1.5), ("b", None)}
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/c", "k string, v double", ["z"])
    files.append_jsonl(df, f"{tmp_path}/j")
    files.append_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    files.write_json({"b": [1]}, f"{tmp_path}/m/x.json")
    assert files.read_json(spark, f"{tmp_path}/m/x.json", "b array<int>").first()["b"] == [1]
    m = files.manifest(spark, f"{tmp_path}/m").cache()
    assert files.check_manifest(spark, m, f"{tmp_path}/m").count() == 0
    broken = m.select("path", "bytes", F.lit("0").alias("sha256")).unionByName(spark.createDataFrame([("../y", 1, "0")], "path string, bytes long, sha256 string"))
    assert {r["check"] for r in files.check_manifest(spark, broken, f"{tmp_path}/m").collect()} == {"changed file", "missing file", "path escape"}
    for k in (1, 2):  # equal names in two folders
        files.write_json({"k": k}, f"{tmp_path}/n/{k}/part.json")
    assert {r["path"] for r in files.manifest(spark, f"{tmp_path}/n", "*.json").collect()} == {"1/part.json", "2/part.json"}
    assert files.check_manifest(spark, files.manifest(spark, f"{tmp_path}/n/").cache(), f"{tmp_path}/n").count() == 0
    odd = spark.createDataFrame([("a | b_c", 1.0)], "k string, v double")
    assert files.to_latex(odd).split("\n")[3] == r"a | b\_c & 1.000 \\" and files.to_markdown(odd).split("\n")[2] == r"| a \| b_c | 1.000 |"
    assert files.to_markdown(df.where("k = 'a'")).split("\n")[2] == "| a | 1.500 |" and r"\hline" in files.to_latex(df.where("k = 'a'"))


def test_validators(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.5), (2, "b", None), (3, "a", float("inf"))], "k int, g string, v double")
    names = lambda x: sorted(r["check"] for r in x.collect())
    assert names(validate.unique(df, ["k"])) == ["duplicate key"]
    assert names(validate.finite(df, ["v"], ["k"])) == ["not finite"] * 2
    assert names(validate.no_nulls(df, ["v"], ["k"])) == ["null"]
    axes = [spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([("a",), ("b",)], "g string")]
    assert names(validate.complete_grid(df, axes)) == ["missing key", "missing key", "unexpected key"]
    with pytest.raises(ValueError):
        validate.refuse(validate.unique(df, ["k"]))
    assert names(validate.minimum(df, ["k"], 2, ["g"])) == ["too few"] * 2


def test_stream_equals_batch(spark, tmp_path):
    from plumbline.streaming.segments import stream_segments

    good = [("f", 5, 769), ("f", 9, 7691), ("f", 30, 7692), ("g", 2, 770), ("g", 3, 7692)]
    spark.createDataFrame(good, "file string, sample long, code int").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("file string, sample long, code int").parquet(f"{tmp_path}/in")
    q = stream_segments(s).writeStream.format("memory").queryName("segs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    rows = spark.table("segs").collect()
    assert [(r["file"], r["start"], r["end"], r["label"], r["cue"]) for r in rows] == [("f", 9, 30, 0, 5)]


def test_manifest_holds_no_file_whole(spark, tmp_path):
    """Files beyond what a row may hold, with odd names."""
    import hashlib

    held = {"a b%20.bin": b"x" * 300_001, "sub/ü.bin": bytes(range(256)) * 2000}
    for name, content in held.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = files.manifest(spark, str(tmp_path), "*.bin").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r["path"]: (r["bytes"], r["sha256"]) for r in got} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in held.items()}
