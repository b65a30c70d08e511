"""Signals, resumable runs, the command line, structural checks, pooled classifiers, raw runs."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import __main__ as command
from plumbline import queries as engine
from plumbline import queries_more
from plumbline.functions import signals, spd
from plumbline.operators import learn, validate
from plumbline.plans import runs
from plumbline.sources import npz
from tools.verify import same

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in queries_more.SQL if n not in ("coverage_summary", "bound_algebra", "top_matched")] + ["kernel_bootstrap", "screen_pair_matrices", "rank_tests", "whitened_pair"])
def test_equals_sql(spark, db, name):
    assert not same(engine.queries()[name](spark, DATA).toPandas(), db.execute(engine.oracle_sql()[name]).df())


def test_butterworth_response():
    """Half power at the edges, one at the centre, nothing at zero and at half the rate; the fall of an ideal filter of the order."""
    for low, high, rate, order in ((8.0, 14.0, 64.0, 4), (7.0, 35.0, 250.0, 5), (1.0, 40.0, 128.0, 2), (8.0, 30.0, 512.0, 3)):
        s = signals.butterworth(low, high, rate, order)
        assert len(s) == order

        def gain(f):
            z = np.exp(2j * np.pi * np.asarray(f) / rate)
            return np.prod([np.abs((b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)) for b0, b1, b2, a1, a2 in s], axis=0)

        assert gain([low, high]) == pytest.approx(np.sqrt(0.5), rel=1e-9)
        w = lambda f: np.tan(np.pi * np.asarray(f) / rate)
        f = np.linspace(rate / 400, rate / 2.01, 97)
        ideal = 1 / np.sqrt(1 + ((w(f) ** 2 - w(low) * w(high)) / (w(f) * (w(high) - w(low)))) ** (2 * order))
        assert gain(f) == pytest.approx(ideal, rel=1e-7, abs=1e-12)
        n = np.arange(4000)  # a sine in the band passes whole once the filter has settled
        mid = rate / np.pi * np.arctan(np.sqrt(w(low) * w(high)))
        y = signals.filtered(np.sin(2 * np.pi * mid / rate * n)[None], s)[0][0][-1000:]
        assert np.abs(y).max() == pytest.approx(1, abs=0.02)


def test_long_signals_are_filtered_in_blocks():
    rng = np.random.default_rng(1)
    s = signals.butterworth(8.0, 30.0, 250.0)
    x = rng.normal(size=(3, 5003))
    state = rng.normal(size=(3, 8))
    for begin in (np.zeros((3, 8)), state):
        (y, end), (z, last) = signals.filtered(x, s, begin), signals.stepped(x, s, begin)
        assert np.allclose(y, z, atol=1e-10) and np.allclose(end, last, atol=1e-10)


def test_both_ways_has_no_phase_and_the_squared_response():
    s = signals.butterworth(8.0, 30.0, 250.0)
    assert signals.padding(s) == 27
    n = np.arange(6000)
    for f in (5.0, 8.0, 15.0, 30.0, 45.0):
        x = np.sin(2 * np.pi * f / 250 * n + 0.3)
        z = np.exp(-2j * np.pi * f / 250)
        gain = np.prod([abs((b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)) for b0, b1, b2, a1, a2 in s]) ** 2
        y = signals.both_ways(x[None], s)[0]
        assert np.allclose(y[2000:4000], gain * x[2000:4000], atol=2e-4)
    constant = signals.both_ways(np.full((1, 100), 7.0), s)
    assert np.allclose(constant, 0, atol=1e-9)  # settled from the first sample on
    one = signals.filtered(np.full((1, 50), 3.0), s, 3.0 * signals.settled(s)[None])[0]
    assert np.allclose(one, one[0, 0])
    with pytest.raises(ValueError, match="too short"):
        signals.both_ways(np.zeros((1, 27)), s)


def test_chunks_equal_the_whole(spark):
    rng = np.random.default_rng(6)
    s = signals.butterworth(8.0, 14.0, 64.0)
    whole = {k: rng.normal(size=n) + 5 for k, n in (("a", 700), ("b", 301), (None, 64))}
    rows = []
    for k, x in whole.items():
        cuts = np.array_split(x, 3) if k != "a" else [x[:64], x[64:300], x[300:301], x[301:]]
        rows += [(k, i, c.tolist()) for i, c in enumerate(cuts)] if k else [(k, 0, x.tolist())]
    rows += [("c", 0, None), ("c", 1, [1.0] * 5), ("c", 2, []), ("c", 3, [2.0] * 40)]
    d = spark.createDataFrame(rows, "k string, chunk int, x array<double>").selectExpr("*", "1 as state").repartition(5)
    for zero in (False, True):
        part = d if not zero else d.where("k is null or k <> 'c'")
        got = {}
        for r in sorted(signals.band_pass_chunks(part, ["k"], "chunk", "x", "y", 8.0, 14.0, 64.0, zero_phase=zero).collect(), key=lambda r: r["chunk"]):
            assert (r["y"] is None) == (r["x"] is None) and (r["y"] is None or len(r["y"]) == len(r["x"])) and r["state"] == 1
            got.setdefault(r["k"], []).extend(r["y"] or [])
        for k, x in whole.items():
            want = signals.both_ways(x[None], s)[0] if zero else signals.filtered(x[None], s)[0][0]
            assert np.allclose(got[k], want, atol=1e-9), (k, zero)
    assert np.allclose(got.get("c", []) or signals.filtered(np.array([[1.0] * 5 + [2.0] * 40]), s)[0][0], signals.filtered(np.array([[1.0] * 5 + [2.0] * 40]), s)[0][0])
    with pytest.raises(Exception, match="cannot be continued"):
        signals.band_pass_chunks(d.where("k = 'c' and chunk in (1, 3)"), ["k"], "chunk", "x", "y", 8.0, 14.0, 64.0, zero_phase=True).collect()
    both = signals.band_pass(spark.createDataFrame([(1, whole["a"].tolist()), (2, None)], "k int, x array<double>"), "x", "y", 8.0, 14.0, 64.0, zero_phase=True).collect()
    assert np.allclose(both[0]["y"], signals.both_ways(whole["a"][None], s)[0]) and both[1]["y"] is None


def test_band_pass_column(spark):
    rng = np.random.default_rng(1)
    x = [rng.normal(size=n).tolist() for n in (64, 64, 30)] + [None]
    d = spark.createDataFrame(list(enumerate(x)), "k int, x array<double>")
    got = {r["k"]: r["y"] for r in signals.band_pass(d, "x", "y", 8.0, 14.0, 64.0).collect()}
    s = signals.butterworth(8.0, 14.0, 64.0)
    assert got[3] is None and all(np.allclose(got[k], signals.filtered(np.array([x[k]]), s)[0][0]) for k in range(3))
    v = d.where("k < 3").select("k", signals.log_variance("x").alias("v")).collect()
    assert all(r["v"] == pytest.approx(np.log(np.var(x[r["k"]]) + 1e-12)) for r in v)
    e = signals.epochs(d.withColumn("at", F.array(*map(F.lit, (0, 20, 60)))), "x", "at", 10).collect()
    assert {(r["k"], i) for r in e for i in [len(r["epoch"])]} and len([r for r in e]) == 6


def test_runs_resume_and_isolate(spark, tmp_path):
    calls = []

    def work(units):
        rows = [r["u"] for r in units.collect()]
        calls.append(sorted(rows))
        if 3 in rows:
            raise ValueError("unit three")
        return units.withColumn("v", F.col("u") * 10)

    units = spark.createDataFrame([(k,) for k in (1, 2, 3)], "u int")
    run = runs.Run(spark, f"{tmp_path}/r", {"b": 199, "a": [1, 2]})
    assert run.hash == runs.identity({"a": [1, 2], "b": 199}) != runs.identity({"a": [2, 1], "b": 199})
    got = run.go(units, "u", work)
    assert {(r["u"], r["v"]) for r in got.collect()} == {(1, 10), (2, 20)}
    assert [(r["unit"], "unit three" in r["error"]) for r in run.failures().collect()] == [("3", True)]
    calls.clear()
    again = runs.Run(spark, f"{tmp_path}/r", {"a": [1, 2], "b": 199})  # the same plan goes on where it stopped
    again.go(units.where("u < 3"), "u", work)
    assert calls == []
    again.go(units.unionByName(spark.createDataFrame([(4,)], "u int")).where("u <> 3"), "u", work)
    assert calls == [[4]] and again.results().count() == 3
    assert runs.Run(spark, f"{tmp_path}/r", {"a": [1, 2], "b": 99}).results() is None
    with pytest.raises(ValueError):
        again.check(validate.minimum(units, ["u"], 2, ["u"]))


def test_command(spark, tmp_path, capsys, monkeypatch):
    assert command.main([]) == 0 and "screen_ship_years" in capsys.readouterr().out
    assert command.main(["nothing"]) == 2
    assert command.main(["first_splits", "--sql"]) == 0 and "SELECT" in capsys.readouterr().out
    monkeypatch.setenv("PLUMBLINE_DATA", "~/x/")
    assert command.resolve(None, "PLUMBLINE_DATA", "data") == os.path.expanduser("~/x") and command.resolve("s3://b/c/", "PLUMBLINE_DATA", "d") == "s3://b/c"
    if os.path.isdir(DATA):
        assert command.main(["first_splits", "--data", DATA, "--out", f"{tmp_path}/o"]) == 0
        assert spark.read.parquet(f"{tmp_path}/o").count() == 3


def test_structure(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert validate.same_structure(a, a.repartition(3).select("v", "k")).count() == 0
    assert {r["check"] for r in validate.same_structure(a, a.withColumn("k", F.col("k").cast("long"))).collect()} == {"column"}
    assert [r["detail"] for r in validate.same_structure(a, a.distinct()).collect()] == ["1"]
    assert {r["check"] for r in validate.constant(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None), (3, "a"), (3, "b"), (4, None), (4, None)], "g int, v string"), ["g"], "v").collect()} == {"not constant"}
    assert validate.constant(spark.createDataFrame([(1, "a"), (2, "a"), (2, None), (3, "a"), (3, "b"), (4, None), (4, None)], "g int, v string"), ["g"], "v").count() == 2


def test_pooled_classifiers(spark, monkeypatch, tmp_path):
    """Pooling by hand, in numpy; equal sets once; the target's own half."""
    rng = np.random.default_rng(8)

    def trials(n, shift):
        out = []
        for k in range(n):
            x = rng.normal(size=(3, 20)) * np.array([1 + (k % 2) + shift, 1, 1])[:, None]
            out.append((k % 2, (x @ x.T / 19).ravel().tolist()))
        return out

    data = {s: trials(24, 0.1 * s) for s in range(3)}
    mine, held = trials(16, 0.0), trials(30, 0.0)
    sources = spark.createDataFrame([("c", s, y, c) for s, rows in data.items() for y, c in rows], "case_id string, source int, label int, cov array<double>")
    frame = lambda rows: spark.createDataFrame([("c", y, c) for y, c in rows], "case_id string, label int, cov array<double>")
    sets = spark.createDataFrame([("c", "rect", [0, 1]), ("c", "ref", [0, 1]), ("c", "all", [0, 1, 2])], "case_id string, method string, members array<int>")
    got = {r["method"]: r for r in learn.pooled(sets, sources, frame(mine), frame(held), 3).collect()}

    def fit(rows):
        a, b = (spd.shrink(np.array([c for _, c in x]).reshape(-1, 3, 3), 0.05) for x in (rows, held))
        m = spd.frechet_mean(a)
        y = np.array([t for t, _ in rows])
        return spd.balanced_accuracy(np.array([t for t, _ in held]), spd.lda(spd.tangent(a, m), y, spd.tangent(b, m)))

    want = {"rect": fit(data[0] + data[1]), "ref": fit(data[0] + data[1]), "all": fit(data[0] + data[1] + data[2]), "target_only": fit(mine)}
    assert {m: r["balanced_accuracy"] for m, r in got.items()} == {m: pytest.approx(v) for m, v in want.items()}
    assert (got["rect"]["n_sources"], got["rect"]["n_train"], got["target_only"]["n_train"], got["all"]["n_test"]) == (2, 48, 16, 30)

    for held_bytes in (64 << 20, 700):  # passes with map-side sums instead of one task, in one slice and in several
        monkeypatch.setattr(learn, "HELD", held_bytes)
        again = {r["method"]: r for r in learn.pooled(sets, sources.repartition(5), frame(mine), frame(held), 3, most=0).collect()}
        assert {m: r["balanced_accuracy"] for m, r in again.items()} == {m: pytest.approx(v) for m, v in want.items()}
        assert all((again[m]["n_sources"], again[m]["n_train"], again[m]["n_test"]) == (got[m]["n_sources"], got[m]["n_train"], got[m]["n_test"]) for m in got)
    direct = {r["source"]: r for r in learn.tangent_lda(sources.drop("case_id"), sources.select("source").distinct().crossJoin(frame(held).drop("case_id")), ["source"], 3, most=0).collect()}
    assert {s: r["balanced_accuracy"] for s, r in direct.items()} == {s: pytest.approx(fit(data[s])) for s in data}

    store = learn.ModelStore(spark, f"{tmp_path}/models")
    kept = {r["method"]: r["balanced_accuracy"] for r in learn.pooled(sets, sources, frame(mine), frame(held), 3, store=store).collect()}
    assert kept == {m: pytest.approx(v) for m, v in want.items()} and store.stored().count() == 3
    when = store.stored().agg(F.max("fitted_at")).first()[0]
    other = learn.ModelStore(spark, f"{tmp_path}/models")  # a later run: trials in another order, nothing is fitted
    assert {r["method"]: r["balanced_accuracy"] for r in learn.pooled(sets, sources.orderBy(F.rand(3)), frame(mine), frame(held), 3, store=other).collect()} == kept
    assert other.stored().count() == 3 and other.stored().agg(F.max("fitted_at")).first()[0] == when
    changed = spark.createDataFrame([("c", "rect", [0, 2])], "case_id string, method string, members array<int>")
    learn.pooled(changed, sources, frame(mine), frame(held), 3, store=other).collect()
    assert other.stored().count() == 4  # one new set; the target's own half was there


def test_models_of_one_class_and_of_nothing(spark):
    one = spark.createDataFrame([([1], 0, [1.0, 0.0, 0.0, 1.0]), ([1, 2], 0, [2.0, 0.0, 0.0, 1.0]), ([2], 1, [1.0, 0.2, 0.2, 1.0])], "sets array<long>, label int, cov array<double>")
    models = learn.tangent_models(one, 2)
    got = {r["set"]: r for r in models.collect()}
    assert got[1]["classes"] == [] and got[2]["classes"] == [0, 1] and got[1]["n_train"] == 2
    scores = {r["set"]: r for r in learn.tangent_scores(one, models, 2).collect()}
    assert scores[1]["balanced_accuracy"] is None and scores[2]["balanced_accuracy"] is not None and scores[2]["n_test"] == 2
    assert learn.tangent_models(one.limit(0), 2).count() == 0


def test_class_covariance_is_scaled_back():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) * np.array([1.0, 100.0, 0.01])
    c = spd.class_covariance(x)
    z = spd.class_covariance(x / x.std(0))
    assert np.allclose(c, z * np.outer(x.std(0), x.std(0))) and np.allclose(np.diag(z), 1)  # the scale of a feature does not change its shrinkage
    assert np.isfinite(spd.class_covariance(np.column_stack([x, np.ones(40)]))).all()


def test_raw_runs(spark, tmp_path):
    np.savez(f"{tmp_path}/run1.npz", data=np.arange(12.0).reshape(3, 4), events=np.array([[1, 2], [3, 4]]), note=np.array(["x"]))
    got = {r["name"]: r for r in npz.read_runs(spark, f"{tmp_path}/*.npz").collect()}
    assert set(got) == {"data", "events"} and got["data"]["shape"] == [3, 4] and got["data"]["data"] == list(range(12)) and got["events"]["kind"] == "int64"
    assert npz.read_runs(spark, f"{tmp_path}/*.npz", ["events"]).count() == 1


def test_units_fail_by_themselves_in_one_job(spark, tmp_path):
    import pandas as pd

    calls = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(s, k, float(k)) for s in ("a", "b", "c") for k in range(3) for _ in range(2)], "s string, k int, x double")

    def work(pdf):
        calls.add(1)
        if (pdf["s"] == "b").all() and (pdf["k"] == 1).all():
            raise ValueError("unit b/1")
        return pd.DataFrame({"s": pdf["s"].iloc[:0 if (pdf["k"] == 2).all() else 1], "k": pdf["k"].iloc[:0 if (pdf["k"] == 2).all() else 1], "m": pdf["x"].mean()})

    run = runs.Run(spark, f"{tmp_path}/r", {"a": 1})
    got = run.each(rows, ["s", "k"], work, "s string, k int, m double")
    assert {(r["s"], r["k"], r["m"]) for r in got.collect()} == {("a", 0, 0.0), ("b", 0, 0.0), ("c", 0, 0.0), ("a", 1, 1.0), ("c", 1, 1.0)}
    assert [(r["unit"], "unit b/1" in r["error"]) for r in run.failures().collect()] == [("b/1", True)]
    done = calls.value
    run.each(rows, ["s", "k"], work, "s string, k int, m double")  # only the failed unit again: empty results are done
    assert calls.value == done + 1 and run.results().count() == 5


def test_what_is_observed_stops_a_result(spark, tmp_path):
    units = spark.createDataFrame([(1,), (2,)], "u int")
    run = runs.Run(spark, f"{tmp_path}/r", {"a": 1})
    work = lambda t: t.withColumn("x", F.when(F.col("u") == 2, float("nan")).otherwise(1.0))
    got = run.go(units, "u", work, limits=runs.Limits(1, 10, ("x",)))
    assert [r["u"] for r in got.collect()] == [1] and "1 lost numbers in x" in run.failures().first()["error"]
    assert run.go(units, "u", work, limits=runs.Limits(1, 10, ("x",), 1)).count() == 2
    with pytest.raises(ValueError, match="too few"):
        run.go(units, "u", work, preflight=[validate.minimum(units, ["u"], 2, ["u"])])


def test_phases_rotate():
    order = []
    took = runs.rotated({n: (lambda n=n: order.append(n)) for n in "abc"}, 3)
    assert "".join(order) == "abc" + "abc" + "bca" + "cab" and all(len(v) == 3 for v in took.values())


def test_cache_computes_what_is_stale(spark, tmp_path):
    from plumbline.sources.cache import SessionCache

    cache = SessionCache(spark, f"{tmp_path}/c", ["subject", "session"])
    sessions = spark.createDataFrame([(s, k, 8.0, 30.0) for s in (1, 2) for k in (1, 2, 3)], "subject int, session int, low double, high double")
    asked = []

    def compute(todo):
        asked.append(sorted((r["subject"], r["session"]) for r in todo.collect()))
        return todo.where("session < 3").select("subject", "session", (F.col("low") + F.col("high")).alias("v"))  # session 3 has no rows

    assert cache.rows(sessions, ["low", "high"], compute).count() == 4 and len(asked[-1]) == 6
    near = sessions.withColumn("low", F.col("low") + 1e-13)
    assert cache.rows(near, ["low", "high"], compute).count() == 4 and len(asked) == 1  # close is equal, empty is known
    moved = sessions.withColumn("high", F.when(F.col("subject") == 2, 28.0).otherwise(F.col("high")))
    got = {(r["subject"], r["session"]): r["v"] for r in cache.rows(moved, ["low", "high"], compute).collect()}
    assert asked[-1] == [(2, 1), (2, 2), (2, 3)] and got == {(1, 1): 38.0, (1, 2): 38.0, (2, 1): 36.0, (2, 2): 36.0}
    more = moved.unionByName(spark.createDataFrame([(3, 1, 8.0, 30.0)], moved.schema))
    assert cache.rows(more, ["low", "high"], compute).count() == 5 and asked[-1] == [(3, 1)]
    assert {(r["subject"], r["session"]): (r["times"], r["rows"]) for r in cache.computed().collect()} == {(1, 1): (1, 1), (1, 2): (1, 1), (1, 3): (1, 0), (2, 1): (2, 1), (2, 2): (2, 1), (2, 3): (2, 0), (3, 1): (1, 1)}
    assert cache.stale(sessions, ["low", "high"]).count() == 3


def test_documents_in_depth(spark):
    from plumbline.operators import documents

    a = [(1, '{"a": [1, {"b": "x"}], "c": null, "d": true, "e": [], "f": {"g": 2.0}}'), (2, '[1.5, "1.5"]'), (3, "no json {"), (4, None), (5, '"only text"')]
    b = [(1, '{"a": [1.0000000000001, {"b": "y"}, 3], "d": "true", "e": {}, "f": {"g": 2}}'), (2, '[1.5, 1.5]'), (3, "no json {"), (4, None), (6, "7")]
    x, y = (spark.createDataFrame(r, "id int, doc string") for r in (a, b))
    got = {(r["path"]): (r["kind"], r["value"]) for r in documents.flattened(x.where("id = 1"), ["id"], "doc").collect()}
    assert got == {"$.a[0]": ("number", "1"), "$.a[1].b": ("string", "x"), "$.c": ("null", "null"), "$.d": ("boolean", "true"), "$.e": ("array", "[]"), "$.f.g": ("number", got["$.f.g"][1])} and float(got["$.f.g"][1]) == 2
    assert documents.differences(x, x.repartition(3), ["id"], "doc").count() == 0
    told = {(r["check"], r["key"]) for r in documents.differences(x, y, ["id"], "doc").collect()}
    key = lambda i, p: '{"id":%d,"path":"%s"}' % (i, p)
    assert told == {("differs", key(1, "$.a[1].b")), ("right only", key(1, "$.a[2]")), ("left only", key(1, "$.c")), ("differs", key(1, "$.d")), ("differs", key(1, "$.e")), ("differs", key(2, "$[1]")), ("left only", key(5, "$")), ("right only", key(6, "$"))}
    with pytest.raises(ValueError, match="levels"):
        documents.flattened(spark.createDataFrame([(1, "[" * 9 + "1" + "]" * 9)], "id int, doc string"), ["id"], "doc", deepest=5)


def test_rules_name_what_is_broken(spark):
    t = spark.createDataFrame([(1, 0.5, "a"), (2, None, "a"), (3, 2.0, "a")], "k int, x double, s string")
    rules = [("t", "x", "not null", None, None), ("t", "x", "between", 0.0, 1.0), ("t", "x", "at most", None, 2.0), ("t", "k", "sum between", 6.0, 6.0), ("t", "k", "constant", None, None), ("t", "k", "whole", None, None), ("t", "k", "no such rule", None, None), ("u", "k", "whole", None, None), ("t", "k", "rows between", 4.0, 9.0)]
    got = {(r["table"], r["column"], r["rule"]): (r["checked"], r["broken"]) for r in validate.by_rules({"t": t}, spark.createDataFrame(rules, "table string, column string, rule string, lo double, hi double")).collect()}
    assert got == {("t", "x", "not null"): (3, 1), ("t", "x", "between"): (3, 2), ("t", "x", "at most"): (3, 1), ("t", "k", "sum between"): (3, 0), ("t", "k", "constant"): (3, 1), ("t", "k", "whole"): (3, 0), ("t", "k", "no such rule"): (0, 1), ("u", "k", "whole"): (0, 1), ("t", "k", "rows between"): (3, 1)}


def test_bytes_of_doubles(spark):
    import hashlib
    import struct

    from plumbline.functions import hashing

    rng = np.random.default_rng(1)
    x = [0.0, -0.0, 1.0, -1.0, 1.5, 2.0, 0.1, 1 / 3, np.pi, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, np.inf, -np.inf, np.nan, 2.0**1023, 2.0**-1022, 1 - 2**-53, 1 + 2**-52, 8.000000000000002, 7.999999999999999]
    x += (rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist() + (2.0 ** rng.integers(-1074, 1023, 200).astype(float)).tolist()
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", hashing.double_bits(F.col("x")).alias("b")).collect()
    assert all(r["b"] == struct.unpack("<q", struct.pack("<d", x[r["i"]]))[0] for r in got)
    m = [[1.0, 2.5, -3.0], [], x[:20]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(m)] + [(3, None), (4, [1.0, None])], "i int, v array<double>").select("i", hashing.matrix_sha256(F.col("v")).alias("h")).collect()
    want = {i: hashlib.sha256(np.array(v, "<f8").tobytes()).hexdigest() for i, v in enumerate(m)} | {3: None, 4: None}
    assert {r["i"]: r["h"] for r in rows} == want


def test_contracts_of_archives(spark, tmp_path):
    good = {"covs": np.zeros((3, 2, 2)), "labels": np.zeros(3), "trial_ids": np.array(["a", "b", "c"]), "unit": "uV2", "channels": np.array(["C3", "C4"])}
    other = {"unit": good | {"unit": "V2"}, "order": good | {"channels": np.array(["C4", "C3"])}, "kind": good | {"covs": np.zeros((3, 2, 2), np.float32)}, "length": good | {"labels": np.zeros(4)}, "bare": {k: good[k] for k in ("covs", "labels")}, "good": good}
    for name, z in other.items():
        np.savez(f"{tmp_path}/{name}.npz", **z)
    (tmp_path / "cut.npz").write_bytes((tmp_path / "good.npz").read_bytes()[:100])
    c = npz.read_contracts(spark, f"{tmp_path}/*.npz")
    recorded = c.where("not path like '%kind.npz'").select("path", F.when(F.col("path").like("%order.npz"), "0").otherwise(F.col("sha256")).alias("sha256"))
    told = {(r["check"], r["key"].rsplit("/", 1)[1][:-6]) for r in npz.contract_violations(c, "uV2", ["C3", "C4"], recorded=recorded).collect()}
    assert told == {("unit", "unit"), ("channel order", "order"), ("hash", "order"), ("number type", "kind"), ("hash", "kind"), ("alignment", "length"), ("unit", "bare"), ("channel order", "bare"), ("unreadable", "cut")}


def test_text_columns_and_inventories(spark, tmp_path):
    from plumbline.sources import files

    (tmp_path / "t.csv").write_text("path,n\nx,007\ny,\n")
    assert [tuple(r) for r in files.read_csv_text(spark, f"{tmp_path}/t.csv", ["path", "n"]).collect()] == [("x", "007"), ("y", None)]
    for name in ("Subject_01_Session_02_Offline", "Subject_10_Session_01_Online", "notes"):
        (tmp_path / f"{name}.bin").write_bytes(b"abc")
    got = files.inventory(spark, f"{tmp_path}/*.bin", r"Subject_(\d+)_Session_(\d+)_(Offline|Online)", ["subject", "session", "task"])
    assert {(r["subject"], r["session"], r["task"], r["length"]) for r in got.collect()} == {("01", "02", "Offline", 3), ("10", "01", "Online", 3)}


def test_counts_by_event_time_drop_late_rows(spark, tmp_path):
    import datetime

    from plumbline.streaming.segments import windowed_counts

    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    home = f"{tmp_path}/in"
    batches = [[("a", at(1)), ("a", at(2)), ("b", at(3))], [("a", at(40))], [("a", at(1)), ("a", at(55))]]  # the third's first row is late by then
    schema = "k string, ts timestamp"
    q = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(home)
        stream = windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(home), "ts", "10 minutes", "10 minutes", ["k"])
        q = stream.writeStream.format("memory").queryName(f"counts{k}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp{k}")
    run = q.start()
    run.awaitTermination()
    got = {(r["k"], r["window"]["start"].minute): r["n"] for r in spark.table("counts2").collect()}
    assert got.get(("a", 0), 0) in (2, 3) and got[("b", 0)] == 1


def test_checkpoints_that_are_not_needed_go(spark):
    from plumbline.lineage import checkpoint_dir, cut, dropped

    a = cut(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    path = a._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    b = cut(a.withColumn("x", F.col("count") * 2))
    assert os.path.isdir(path) and path.startswith(checkpoint_dir(spark).removeprefix("file:").rstrip("/"))
    dropped(a)
    assert not os.path.exists(path) and b.count() == 3
