"""Queries that learn, for matrices of two channels, where every step has a closed form: so each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_screen as qs
from .lineage import cut
from .operators import learn, resample
from .plans import oracle as o

SQL: dict[str, str] = {}
QUERIES: dict = {}
LAM, ROUNDS = 0.05, 5
FLOORED = "greatest({}, 1e-12)"
SQRT, BACK, LOG, EXP = f"sqrt({FLOORED})", f"1 / sqrt({FLOORED})", f"ln({FLOORED})", "exp({})"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def of_matrix(f: str, m: tuple[str, str, str], source: str, out: tuple[str, str, str], keep: str) -> str:
    """SELECT of `keep` and f of the symmetric matrix [[a, b], [b, d]]: with eigenvalues h and l it is al I + be M."""
    a, b, d = m
    roots = f"SELECT *, ({a} + {d}) / 2 AS m_, sqrt(pow(({a} - {d}) / 2, 2) + {b} * {b}) AS s_ FROM {source}"
    values = f"SELECT *, {f.format('(m_ + s_)')} AS h_, {f.format('(m_ - s_)')} AS l_ FROM ({roots})"
    slope = f"SELECT *, CASE WHEN s_ > 0 THEN (h_ - l_) / (2 * s_) ELSE 0 END AS be_ FROM ({values})"
    return f"SELECT {keep}, (h_ + l_) / 2 + be_ * ({a} - m_) AS {out[0]}, be_ * {b} AS {out[1]}, (h_ + l_) / 2 + be_ * ({d} - m_) AS {out[2]} FROM ({slope})"


def around(k: tuple[str, str, str], m: tuple[str, str, str]) -> tuple[str, str, str]:
    """K M K of symmetric matrices, as three expressions."""
    (p, q, r), (a, b, d) = k, m
    top, right = f"({p} * {a} + {q} * {b})", f"({p} * {b} + {q} * {d})"
    low, last = f"({q} * {a} + {r} * {b})", f"({q} * {b} + {r} * {d})"
    return f"{top} * {p} + {right} * {q}", f"{top} * {q} + {right} * {r}", f"{low} * {q} + {last} * {r}"


M, H, K, W, E = ("ma", "mb", "md"), ("ha", "hb", "hd"), ("ka", "kb", "kd"), ("wa", "wb", "wd"), ("ea", "eb", "ed")
A = ("a", "b2", "d2")
X = ("x1", "x2", "x3")
SHRUNK = f"{1 - LAM} * a + {LAM} * (a + d2) / 2 AS a, {1 - LAM} * b2 AS b2, {1 - LAM} * d2 + {LAM} * (a + d2) / 2 AS d2"


def whitened(rows: str, name: str, at: str) -> list[str]:
    """Logarithms of the rows at the sets' matrices `at`: columns ea, eb, ed."""
    w = around(K, A)
    return [
        f"{name}_k AS ({of_matrix(BACK, M, at, K, 's')})",
        f"{name}_w AS (SELECT t.s, t.label, {', '.join(f'{x} AS {n}' for x, n in zip(w, W, strict=True))} FROM {rows} t JOIN {name}_k USING (s))",
        f"{name} AS ({of_matrix(LOG, W, f'{name}_w', E, 's, label')})",
    ]


def classifier_sql(train: str, test: str) -> str:
    """Scores of every set s: CTEs `fit` (s, label, a, b2, d2) and `held` (the same) follow from `train` and `test`; then five rounds of the mean, moments, discriminants."""
    parts = [f"fit AS (SELECT s, label, {SHRUNK} FROM ({train}))", f"held AS (SELECT s, label, {SHRUNK} FROM ({test}))", "m0 AS (SELECT s, avg(a) AS ma, avg(b2) AS mb, avg(d2) AS md FROM fit GROUP BY s)"]
    for r in range(ROUNDS):
        parts += whitened("fit", f"l{r}", f"m{r}")
        parts.append(f"g{r} AS (SELECT s, avg(ea) AS ea, avg(eb) AS eb, avg(ed) AS ed FROM l{r} GROUP BY s)")
        parts.append(f"e{r} AS ({of_matrix(EXP, E, f'g{r}', W, 's')})")
        parts.append(f"h{r} AS ({of_matrix(SQRT, M, f'm{r}', H, 's')})")
        parts.append(f"m{r + 1} AS (SELECT s, {', '.join(f'{x} AS {n}' for x, n in zip(around(H, W), M, strict=True))} FROM e{r} JOIN h{r} USING (s))")
    last = f"m{ROUNDS}"
    for rows, name in (("fit", "tf"), ("held", "th")):
        parts += whitened(rows, name, last)
        parts.append(f"{name}_x AS (SELECT s, label, ea AS x1, sqrt(2.0) * eb AS x2, ed AS x3 FROM {name})")
    z = {x: f"(({x} - {x}_m) / {x}_s)" for x in X}
    pairs = [(x, y) for i, x in enumerate(X) for y in X[i:]]
    stats = ", ".join(f"avg({x}) AS {x}_m, CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1 END AS {x}_s" for x in X)
    square = " + ".join(f"{w} * pow(s_{x}{y}, 2)" for x, y in pairs for w in [1 if x == y else 2])
    trace = f"(({' + '.join(f's_{x}{x}' for x in X)}) / 3)"
    apart = " + ".join([*(f"pow(s_{x}{x} - mu, 2)" for x in X), *(f"2 * pow(s_{x}{y}, 2)" for x, y in pairs if x != y)])
    c = {(x, y): f"c_{min(x, y)}{max(x, y)}" for x in X for y in X}

    def minor(i: int, j: int) -> str:
        r, q = [x for k, x in enumerate(X) if k != i], [x for k, x in enumerate(X) if k != j]
        return f"{'-' if (i + j) % 2 else ''}({c[r[0], q[0]]} * {c[r[1], q[1]]} - {c[r[0], q[1]]} * {c[r[1], q[0]]})"

    inverse = ", ".join(f"{minor(i, j)} / det AS i{i}{j}" for i in range(3) for j in range(3))
    det = " + ".join(f"{c[X[0], X[j]]} * {minor(0, j)}" for j in range(3))
    coef = ", ".join(f"{' + '.join(f'i{i}{j} * {x}_m' for j, x in enumerate(X))} AS f{i}" for i in range(3))
    parts += [
        f"st AS (SELECT s, label, count(*) AS n, {stats} FROM tf_x GROUP BY s, label)",
        f"mo AS (SELECT s, label, any_value(n) AS n, {', '.join(f'avg({z[x]} * {z[y]}) AS s_{x}{y}' for x, y in pairs)}, avg(pow({' + '.join(f'{z[x]} * {z[x]}' for x in X)}, 2)) AS q, {', '.join(f'any_value({x}_s) AS {x}_s' for x in X)} FROM tf_x JOIN st USING (s, label) GROUP BY s, label)",
        f"mu AS (SELECT *, {trace} AS mu FROM mo)",
        f"d2 AS (SELECT *, {apart} AS d FROM mu)",
        f"kk AS (SELECT *, CASE WHEN d > 0 THEN least(d, (q - ({square})) / n) / d ELSE 0 END AS k FROM d2)",
        f"cv AS (SELECT s, {', '.join(f'sum(n * {x}_s * {y}_s * ((1 - k) * s_{x}{y}' + (' + k * mu' if x == y else '') + f')) / sum(n) AS c_{x}{y}' for x, y in pairs)} FROM kk GROUP BY s)",
        f"dt AS (SELECT *, {det} AS det FROM cv)",
        f"iv AS (SELECT s, {inverse} FROM dt)",
        f"cf AS (SELECT st.s, label, {coef}, {', '.join(f'{x}_m' for x in X)}, ln(n / sum(n) OVER (PARTITION BY st.s)) AS prior, count(*) OVER (PARTITION BY st.s) AS classes, sum(n) OVER (PARTITION BY st.s) AS n_train FROM st JOIN iv USING (s))",
        f"sc AS (SELECT h.s, h.k, h.label AS truth, cf.label AS said, {' + '.join(f'f{i} * ({x} - 0.5 * {x}_m)' for i, x in enumerate(X))} + prior AS score FROM (SELECT *, row_number() OVER () AS k FROM th_x) h JOIN cf ON cf.s = h.s)",
        "best AS (SELECT s, k, truth, arg_max(said, (score, -said)) AS said FROM sc GROUP BY s, k, truth)",
        "acc AS (SELECT s, sum(m) AS n_test, avg(hit) AS accuracy FROM (SELECT s, truth, count(*) AS m, avg(CAST(said = truth AS DOUBLE)) AS hit FROM best GROUP BY s, truth) GROUP BY s)",
    ]
    tail = f"SELECT s AS pool, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, round(ma, 6) + 0.0 AS mean_a, round(mb, 6) + 0.0 AS mean_b, round(md, 6) + 0.0 AS mean_d, CASE WHEN classes > 1 THEN round(accuracy, 6) + 0.0 END AS balanced_accuracy FROM acc JOIN {last} USING (s) JOIN (SELECT DISTINCT s, classes, n_train FROM cf) USING (s)"
    return o.with_(qs.PAIR_SQL.replace("trials AS", "numbered AS"), "trials AS (SELECT *, CAST(row_key AS BIGINT) AS vec_id FROM numbered)", *parts) + tail


def learned(train: DataFrame, test: DataFrame) -> DataFrame:
    """pool, n_train, n_test, the mean matrix and the accuracy; train and test: pool, sets, label, cov."""
    names = cut(train.select("pool", F.explode("sets").alias("set")).distinct())
    models = learn.tangent_models(train, 2, LAM)
    scores = learn.tangent_scores(test, models, 2, LAM)
    at = lambda k: (F.round(F.get("mean", F.lit(k)), 6) + 0.0)
    both = names.join(models.select("set", "mean"), "set").join(scores, "set")
    return both.select("pool", "n_train", "n_test", at(0).alias("mean_a"), at(1).alias("mean_b"), at(3).alias("mean_d"), (F.round("balanced_accuracy", 6) + 0.0).alias("balanced_accuracy"))


OWN = "CAST(source AS VARCHAR) AS s, vec_id % 2 AS label, a, b2, d2"


@query(classifier_sql(f"SELECT {OWN} FROM trials WHERE NOT is_target", "SELECT CAST(s.source AS VARCHAR) AS s, t.vec_id % 2 AS label, t.a, t.b2, t.d2 FROM trials t, (SELECT DISTINCT source FROM trials WHERE NOT is_target) s WHERE t.is_target"))
def pair_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """Odd against even vectors of the last label, learned from each label alone, by map-side sums."""
    t = qs.matrix_trials(spark, d, 2).select("source", "is_target", F.pmod("vec_id", F.lit(2)).alias("label"), "cov")
    rows = cut(t.withColumn("pool", F.col("source").cast("string")).withColumn("sets", F.array(F.col("source").cast("long"))))
    sets = rows.where("not is_target").agg(F.array_sort(F.collect_set(F.col("source").cast("long"))).alias("all"))  # a number for each label
    return learned(rows.where("not is_target"), rows.where("is_target").drop("sets").crossJoin(F.broadcast(sets.withColumnRenamed("all", "sets"))))


#: Pools of the first sources, and of all.
POOLS = (2, 4, 100)
HALVES = "halves AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY md5('97|0|' || vec_id), vec_id) * 2 <= count(*) OVER (PARTITION BY vec_id % 2) AS screen FROM trials WHERE is_target)"
POOL_SQL = f"SELECT 'first ' || k AS s, vec_id % 2 AS label, a, b2, d2 FROM trials, (SELECT unnest({list(POOLS)}) AS k) WHERE NOT is_target AND source < k"
MINE = "SELECT 'target' AS s, vec_id % 2 AS label, a, b2, d2 FROM trials JOIN halves USING (vec_id) WHERE screen"
REST = f"SELECT s, vec_id % 2 AS label, a, b2, d2 FROM trials JOIN halves USING (vec_id), (SELECT unnest({[*(f'first {k}' for k in POOLS), 'target']}) AS s) WHERE NOT screen"


@query(classifier_sql(f"{POOL_SQL} UNION ALL {MINE}", REST).replace("fit AS", f"{HALVES},\nfit AS", 1))
def pair_pools(spark: SparkSession, d: str) -> DataFrame:
    """Classifiers of the first labels' pooled trials and of the target's own screening half, tested on the other half; a trial is of several pools and never copied."""
    t = cut(qs.matrix_trials(spark, d, 2).withColumn("label", F.pmod("vec_id", F.lit(2))).select("case_id", "source", "is_target", "vec_id", "label", "cov"))
    halves = resample.half_splits(t.where("is_target").select("case_id", "vec_id", "label"), 1, 97, ["case_id", "vec_id"]).select("vec_id", "role")
    mine = t.where("is_target").join(halves, "vec_id")
    of = F.filter(F.array(*[F.struct(F.lit(f"first {k}").alias("pool"), F.lit(i).cast("long").alias("set"), F.lit(k).alias("k")) for i, k in enumerate(POOLS)]), lambda p: F.col("source") < p["k"])
    train = t.where("not is_target").withColumn("_p", of).select(F.transform("_p", lambda p: p["set"]).alias("sets"), "label", "cov")
    train = train.unionByName(mine.where("role = 'screen'").select(F.array(F.lit(len(POOLS)).cast("long")).alias("sets"), "label", "cov"))
    every = F.array(*[F.lit(i).cast("long") for i in range(len(POOLS) + 1)])
    pools = F.element_at(F.array(*[F.lit(f"first {k}") for k in POOLS], F.lit("target")), (F.col("set") + 1).cast("int"))
    train = cut(train.where(F.size("sets") > 0))
    models = learn.tangent_models(train, 2, LAM)
    scores = learn.tangent_scores(mine.where("role = 'test'").select(every.alias("sets"), "label", "cov"), models, 2, LAM)
    at = lambda k: (F.round(F.get("mean", F.lit(k)), 6) + 0.0)
    both = models.select("set", "mean").join(scores, "set")
    return both.select(pools.alias("pool"), "n_train", "n_test", at(0).alias("mean_a"), at(1).alias("mean_b"), at(3).alias("mean_d"), (F.round("balanced_accuracy", 6) + 0.0).alias("balanced_accuracy"))

