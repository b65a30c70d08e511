"""Queries that resample and screen. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import keyed, matrices
from .lineage import cut
from .operators import discrepancy, evaluate, gates, resample, roles, system
from .plans import oracle as o
from .plans.screening import METHODS, screen, screening_of
from .sources import files, synthetic

SQL: dict[str, str] = {}
QUERIES: dict = {}
X = ["x1", "x2"]
#: Features of an embedding, all of them, and replicates of the bootstrap.
DIMENSIONS, B = 64, 199
V = [f"x{k + 1}" for k in range(DIMENSIONS)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str) -> list:
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def s6(*names: str, t: str = "") -> str:
    return ", ".join(f"round({t}{n}, 6) + 0.0 AS {n}" for n in names)


# ---- trials

KEY_SQL = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d'))"


def ship_trials(spark: SparkSession, d: str, shift: float = 0.0) -> DataFrame:
    """Lines by region of the supplier (case) and year of shipping (source; the last year is the target)."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    used = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_linestatus"]
    line = files.read_spread(spark, f"{d}/lineitem.parquet", *used).select(
        "l_suppkey", F.year("l_shipdate").alias("source"), ((F.col("l_quantity") - 25) / 15).alias("x1"), ((F.col("l_extendedprice") - 50000) / 30000).alias("x2"), "l_linestatus",
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_quantity"), cents("l_extendedprice"), F.date_format("l_shipdate", "yyyyMMdd")).alias("row_key"),
    )
    places = read(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("s_nationkey") == F.col("n_nationkey"))
    t = line.join(places.select("s_suppkey", F.col("r_name").alias("case_id")), F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")
    # the last year of all lines is one aggregate over a column, not a window over every row
    last = t.groupBy("case_id").agg(F.max("source").alias("last"))
    t = t.join(F.broadcast(last), "case_id").withColumn("is_target", F.col("source") == F.col("last"))
    return t.withColumn("x1", F.col("x1") + shift * (F.col("last") - F.col("source"))).drop("last")


def ship_sql(shift: float = 0.0) -> str:
    return f"""trials AS (SELECT *, source = max(source) OVER (PARTITION BY case_id) AS is_target FROM (
  SELECT r_name AS case_id, CAST(year(l_shipdate) AS INTEGER) AS source, (l_quantity - 25) / 15 + {shift} * (max(CAST(year(l_shipdate) AS INTEGER)) OVER (PARTITION BY r_name) - CAST(year(l_shipdate) AS INTEGER)) AS x1,
    (l_extendedprice - 50000) / 30000 AS x2, l_linestatus, {KEY_SQL} AS row_key
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""


def event_trials(spark: SparkSession, d: str) -> DataFrame:
    """Events by type in alphabetical order; the last type is the target; positions by hash buckets."""
    e = read(spark, d, "events")
    codes = e.select("event_type").distinct().withColumn("source", F.row_number().over(Window.orderBy("event_type")))  # a row for each type
    last = F.max("source").over(Window.partitionBy())
    codes = codes.withColumn("is_target", F.col("source") == last)
    t = e.join(F.broadcast(codes), "event_type").select(F.lit("events").alias("case_id"), "source", "is_target", (F.ln(1 + F.abs("value"))).alias("x1"), (F.col("value") / 50).alias("x2"), F.col("event_id").cast("string").alias("row_key"))
    return roles.numbered(t, ["case_id", "source"], ["row_key"])


EVENT_SQL = f"""codes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS source FROM (SELECT DISTINCT event_type FROM events)),
ev AS (SELECT 'events' AS case_id, source, source = (SELECT max(source) FROM codes) AS is_target, ln(1 + abs(value)) AS x1, value / 50 AS x2, CAST(event_id AS VARCHAR) AS row_key FROM events JOIN codes USING (event_type)),
{o.numbered("ev", "trials", "case_id, source", "row_key")}"""


def whole_vector() -> F.Column:
    """A vector's 64 values times four; vectors of another length are refused when they are met."""
    own = F.when(F.size("embedding") == DIMENSIONS, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("vector of another length: "), F.col("vec_id"))))
    return F.transform(own, lambda e: e.cast("double") * 4)


def vector_trials(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings by label; the last label is the target; every dimension is a feature, in the array `x`."""
    e = read(spark, d, "embeddings").select(F.lit("vectors").alias("case_id"), F.col("label").alias("source"), F.col("vec_id").cast("string").alias("row_key"), "vec_id", whole_vector().alias("x"))
    last = e.agg(F.max("source").alias("last"))
    e = e.crossJoin(F.broadcast(last)).withColumn("is_target", F.col("source") == F.col("last")).drop("last")
    return roles.numbered(e, ["case_id", "source"], ["row_key"])


VECTOR_SQL = f"""em AS (SELECT 'vectors' AS case_id, label AS source, label = (SELECT max(label) FROM embeddings) AS is_target, CAST(vec_id AS VARCHAR) AS row_key, vec_id,
  {", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) * 4 AS x{k + 1}" for k in range(DIMENSIONS))} FROM embeddings),
{o.numbered("em", "trials", "case_id, source", "row_key")}"""


# ---- screening

GATE_COLS = ("delta", "se", "lower", "upper", "lower_j", "upper_j")
FLAGS = ("rect", "pair", "ref", "rect_j", "pair_j", "ref_j", "eb")


def gate_rows(s) -> DataFrame:
    return gates.gates(s.system).select("case_id", "source", *r6(*GATE_COLS), *FLAGS)


GATE_SELECT = f"SELECT case_id, source, {s6(*GATE_COLS)}, {', '.join(FLAGS)} FROM gate"


@query(o.with_(ship_sql(), o.estimates("trials"), o.poisson("trials", B, 11, "row_key"), o.system()) + GATE_SELECT)
def screen_ship_years(spark: SparkSession, d: str) -> DataFrame:
    """F11, R1 (Poisson), G1 - G6, G10 over all lines: which years cannot be told from the last."""
    return gate_rows(screen(ship_trials(spark, d), X, B, 11, ["row_key"]))


LONG = " UNION ALL ".join(f"SELECT case_id, source, '{m}' AS method, CAST({m} AS INTEGER) AS selected FROM wide" for m in METHODS)


@query(o.with_(ship_sql(0.12), o.estimates("trials"), o.poisson("trials", B, 12, "row_key"), o.system(), o.stepdown(), o.simple(0.1), "wide AS (SELECT * FROM gate JOIN mcs USING (case_id, source) JOIN simp USING (case_id, source))") + LONG)
def members_shifted_years(spark: SparkSession, d: str) -> DataFrame:
    """Every rule's members, with years drifting by 0.12 so that some are excluded."""
    return screen(ship_trials(spark, d, 0.12), X, B, 12, ["row_key"]).members(0.1)


@query(
    o.with_(ship_sql(0.12), o.estimates("trials"), o.poisson("trials", B, 12, "row_key"), o.system())
    + """SELECT case_id, source, round(margin, 6) + 0.0 AS margin, CAST(margin > 0 AS INTEGER) AS rect_excluded, CAST(n_witnesses > 0 AS INTEGER) AS pair_excluded, n_witnesses, coalesce(witnesses, '') AS witnesses, strongest, round(strongest_lower, 6) + 0.0 AS strongest_lower,
  CASE WHEN margin > 0 AND n_witnesses > 0 THEN 'both' WHEN margin > 0 THEN 'rectangle' WHEN n_witnesses > 0 THEN 'contrast' ELSE 'retained' END AS status
FROM (SELECT case_id, source, lower - min(upper) OVER (PARTITION BY case_id) AS margin FROM comp) JOIN (
  SELECT case_id, j AS source, count(*) FILTER (lower > 0) AS n_witnesses, string_agg(CAST(l AS VARCHAR), ',' ORDER BY l) FILTER (lower > 0) AS witnesses, arg_max(l, (lower, -l)) AS strongest, max(lower) AS strongest_lower FROM cont GROUP BY ALL) USING (case_id, source)"""
)
def exclusion_certificate(spark: SparkSession, d: str) -> DataFrame:
    """G14, T5."""
    c = gates.certificate(screen(ship_trials(spark, d, 0.12), X, B, 12, ["row_key"]).system)
    return c.select("case_id", "source", *r6("margin"), "rect_excluded", "pair_excluded", "n_witnesses", F.array_join("witnesses", ",").alias("witnesses"), "strongest", *r6("strongest_lower"), "status")


@query(o.with_(EVENT_SQL, o.estimates("trials"), o.index_draws("trials", B, 21), o.system()) + GATE_SELECT)
def screen_events_index(spark: SparkSession, d: str) -> DataFrame:
    """R1 with index draws and a shared target."""
    return gate_rows(screen(event_trials(spark, d), X, B, 21))


@query(o.with_(EVENT_SQL, o.estimates("trials"), o.index_draws("trials", B, 23, block=4), o.system()) + GATE_SELECT)
def screen_events_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Circular blocks of four."""
    return gate_rows(screen(event_trials(spark, d), X, B, 23, block=4))




@query(o.with_(VECTOR_SQL, o.estimates("trials", V), o.index_draws("trials", B, 31, features=V), o.system()) + GATE_SELECT)
def screen_vectors(spark: SparkSession, d: str) -> DataFrame:
    return gate_rows(screen(vector_trials(spark, d), "x", B, 31))


@query(o.with_(VECTOR_SQL, o.estimates("trials", V), o.index_draws("trials", B, 31, shared=False, features=V), o.system()) + GATE_SELECT)
def screen_vectors_wrong_target(spark: SparkSession, d: str) -> DataFrame:
    """A target draw for each source."""
    return gate_rows(screen(vector_trials(spark, d), "x", B, 31, shared=False))


@query(
    o.with_(VECTOR_SQL, o.estimates("trials", V), o.index_draws("trials", B, 31, features=V), o.system())
    + "SELECT case_id, j, l, round(d_hat, 6) + 0.0 AS d_hat, round(se, 6) + 0.0 AS se, round(lower, 6) + 0.0 AS lower, round(lower_j, 6) + 0.0 AS lower_j FROM cont"
)
def contrast_bounds(spark: SparkSession, d: str) -> DataFrame:
    """All ordered contrasts."""
    return screen(vector_trials(spark, d), "x", B, 31).system.contrasts.select("case_id", "j", "l", *r6("d_hat", "se", "lower", "lower_j"))


BUDGETS = (49, 99, B)
BUDGET_PRE = o.with_(
    VECTOR_SQL, o.estimates("trials", V).replace("est AS", "est0 AS"), o.index_draws("trials", B, 31, features=V).replace("draws AS", "draws0 AS"),
    f"draws AS (SELECT case_id || '/' || n AS case_id, n AS budget, b, source, delta FROM draws0, (SELECT unnest({list(BUDGETS)}) AS n) WHERE b < n)",
    f"est AS (SELECT case_id || '/' || n AS case_id, source, delta FROM est0, (SELECT unnest({list(BUDGETS)}) AS n))", o.system(),
)


def budget_screens(spark: SparkSession, d: str):
    s = screen(vector_trials(spark, d), "x", B, 31)
    n = spark.createDataFrame([(b,) for b in BUDGETS], "budget int")
    tag = F.concat_ws("/", "case_id", "budget")
    draws = cut(s.draws.join(F.broadcast(n), F.col("b") < F.col("budget")).withColumn("case_id", tag).drop("budget"))
    est = s.est.crossJoin(F.broadcast(n)).withColumn("case_id", tag).drop("budget")
    return system.build(est, draws)


@query(
    BUDGET_PRE
    + f""", sets AS (SELECT split_part(case_id, '/', 1) AS case_id, CAST(split_part(case_id, '/', 2) AS INTEGER) AS budget, m.method, coalesce(list(source) FILTER (sel = 1), []) AS members
  FROM (SELECT case_id, source, unnest(['rect', 'pair', 'ref']) AS method, unnest([rect, pair, ref]) AS sel FROM gate) m GROUP BY ALL)
SELECT a.case_id, a.budget, a.method, len(a.members) AS set_size, round(coalesce(len(list_intersect(a.members, r.members)) / nullif(len(list_distinct(list_concat(a.members, r.members))), 0), 1), 6) + 0.0 AS jaccard,
  CAST(list_sort(a.members) = list_sort(r.members) AS INTEGER) AS exact, len(a.members) - len(r.members) AS size_change, len(list_filter(a.members, lambda x: NOT list_contains(r.members, x))) AS added, len(list_filter(r.members, lambda x: NOT list_contains(a.members, x))) AS removed
FROM sets a JOIN sets r ON a.case_id = r.case_id AND a.method = r.method AND r.budget = {B}"""
)
def budget_stability(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes of one set of draws against all of them."""
    m = gates.long_members(gates.gates(budget_screens(spark, d)), ["rect", "pair", "ref"])
    part = F.split("case_id", "/")
    sets = evaluate.as_sets(m, ["case_id"]).withColumn("budget", part[1].cast("int")).withColumn("case_id", part[0])
    return evaluate.against_reference(sets, B, ["case_id"]).withColumn("jaccard", F.round("jaccard", 6))


@query(
    BUDGET_PRE
    + """SELECT case_id, round(min(c.raw_se), 6) + 0.0 AS component_se_min, round(max(c.raw_se), 6) + 0.0 AS component_se_max, count(*) FILTER (c.raw_se IS NULL) AS component_nonfinite, count(*) FILTER (c.raw_se < 1e-12) AS component_floored,
  any_value(d.lo) AS contrast_se_min, any_value(d.hi) AS contrast_se_max, any_value(d.nf) AS contrast_nonfinite, any_value(d.fl) AS contrast_floored
FROM comp c JOIN (SELECT case_id, round(min(raw_se), 6) + 0.0 AS lo, round(max(raw_se), 6) + 0.0 AS hi, count(*) FILTER (raw_se IS NULL) AS nf, count(*) FILTER (raw_se < 1e-12) AS fl FROM cont GROUP BY ALL) d USING (case_id) GROUP BY case_id"""
)
def se_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """E12."""
    x = system.se_diagnostics(budget_screens(spark, d), ["case_id"])
    return x.select("case_id", *r6("component_se_min", "component_se_max"), "component_nonfinite", "component_floored", *r6("contrast_se_min", "contrast_se_max"), "contrast_nonfinite", "contrast_floored")


# ---- outer audit, splits, rolling targets

OUTER = 6
AUDIT_SQL = f"""outer_n AS (SELECT case_id, source, is_target, greatest(8, CAST(round_even(count(*) * CASE WHEN is_target THEN 0.5 ELSE 1.0 END, 0) AS BIGINT)) AS m, count(*) AS n FROM trials GROUP BY case_id, source, is_target),
outer_i AS (SELECT case_id, source, is_target, n, rep, unnest(range(m)) AS j FROM outer_n, (SELECT unnest(range({OUTER})) AS rep)),
outer_p AS (SELECT *, (({o.polynomial("md5('41|o|vectors|' || source || '|' || rep)", "(j + 1)")}) % n) AS place FROM outer_i),
outer_t AS (SELECT g.case_id || '/' || rep AS case_id, g.source, g.is_target, row_number() OVER (PARTITION BY g.source, rep ORDER BY place, j) - 1 AS i, {', '.join(V)} FROM outer_p g JOIN trials x ON x.source = g.source AND x.i = g.place)"""


@query(
    o.with_(VECTOR_SQL, o.estimates("trials", V).replace("means AS", "means0 AS").replace("FROM means ", "FROM means0 ").replace("JOIN means ", "JOIN means0 ").replace("est AS", "truth AS"), AUDIT_SQL, o.estimates("outer_t", V), o.index_draws("outer_t", B, 43, features=V), o.system())
    + """SELECT g.case_id, CAST(bool_and(t.delta BETWEEN g.lower AND g.upper) AS INTEGER) AS e_c, any_value(d.e_d) AS e_d, CAST(bool_and(t.delta BETWEEN g.lower AND g.upper) AS INTEGER) * any_value(d.e_d) AS e_joint, CAST(sum(g.ref) AS BIGINT) AS set_size
FROM gate g JOIN truth t USING (source) JOIN (SELECT c.case_id, CAST(bool_and(a.delta - z.delta >= c.lower) AS INTEGER) AS e_d FROM cont c JOIN truth a ON c.j = a.source JOIN truth z ON c.l = z.source GROUP BY ALL) d ON d.case_id = g.case_id GROUP BY g.case_id"""
)
def outer_audit(spark: SparkSession, d: str) -> DataFrame:
    """Resampled cases screened, held against the estimates of all data."""
    t = cut(vector_trials(spark, d).select("case_id", "source", "is_target", "i", "x"))
    whole = resample.vector_draws(t, "x", 0, 41)
    truth = discrepancy.vector_distance(*whole, "x", ["case_id", "b"]).select("source", F.col("delta").alias("true"))
    sc = screen(resample.outer_samples(t, "x", OUTER, 41), "x", B, 43)
    cases = sc.est.select("case_id").distinct()
    cover = evaluate.coverage(sc.system, cases.crossJoin(truth), ["case_id"])
    size = gates.gates(sc.system).groupBy("case_id").agg(F.sum("ref").alias("set_size"))
    return cover.join(size, "case_id").select("case_id", "e_c", "e_d", "e_joint", "set_size")


@query(
    """WITH s AS (SELECT label, vec_id % 2 AS y, split, vec_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY label, split, vec_id % 2) AS n FROM embeddings, (SELECT unnest(range(5)) AS split)
  WINDOW w AS (PARTITION BY label, split, vec_id % 2 ORDER BY md5('51|' || split || '|' || vec_id), vec_id))
SELECT label, split, y, count(*) FILTER (k * 2 <= n) AS screen, count(*) FILTER (k * 2 > n) AS test, CAST(sum(CASE WHEN k * 2 <= n THEN vec_id END) AS BIGINT) AS screen_ids FROM s GROUP BY ALL"""
)
def half_splits(spark: SparkSession, d: str) -> DataFrame:
    """Class-proportional halves, five times."""
    t = read(spark, d, "embeddings").select("label", "vec_id", F.pmod("vec_id", F.lit(2)).alias("y"))
    s = resample.half_splits(t, 5, 51, ["label", "vec_id"], "y")
    screen_ = F.col("role") == "screen"
    return s.groupBy("label", "split", "y").agg(F.count_if(screen_).alias("screen"), F.count_if(~screen_).alias("test"), F.sum(F.when(screen_, F.col("vec_id"))).alias("screen_ids"))


ROLL_SQL = f"""ord AS (SELECT c_mktsegment AS subject, CAST(year(o_orderdate) AS INTEGER) AS session, (o_totalprice - 100000) / 60000 AS x1, CAST(o_orderkey % 7 AS DOUBLE) / 2 AS x2, CAST(o_orderkey AS VARCHAR) AS row_key FROM orders JOIN customer ON o_custkey = c_custkey),
ses0 AS (SELECT subject, session, row_number() OVER (PARTITION BY subject ORDER BY session) - 1 AS n FROM (SELECT DISTINCT subject, session FROM ord)),
tg AS (SELECT subject, session AS target FROM ses0 WHERE n >= 3),
trials AS (SELECT tg.subject || '/' || target AS case_id, session AS source, session = target AS is_target, x1, x2, row_key FROM ord JOIN tg ON ord.subject = tg.subject AND ord.session <= tg.target)"""
ROLL_PRE = o.with_(ROLL_SQL, o.estimates("trials"), o.poisson("trials", B, 61, "row_key"), o.system())


def rolling_screen(spark: SparkSession, d: str):
    """Orders by segment and year; every year with three earlier ones is a target once."""
    t = files.read_spread(spark, f"{d}/orders.parquet", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("subject")), F.col("o_custkey") == F.col("c_custkey"))
    t = t.select("subject", F.year("o_orderdate").alias("session"), ((F.col("o_totalprice") - 100000) / 60000).alias("x1"), (F.pmod("o_orderkey", F.lit(7)).cast("double") / 2).alias("x2"), F.col("o_orderkey").cast("string").alias("row_key"))
    t = cut(t)  # read three times
    targets = cut(roles.rolling_targets(t, 3).select("subject", "target").distinct())  # a row for each subject and year
    # a row's weights do not depend on the target: sums by subject and year meet the targets, not rows
    rows = t.select(F.col("subject").alias("case_id"), F.col("session").alias("source"), F.lit(False).alias("is_target"), *X, "row_key")
    case = F.concat_ws("/", "subject", "target").alias("case_id")

    def met(means: DataFrame, when: str, *cols: str) -> DataFrame:
        return means.join(F.broadcast(targets), F.col("case_id") == F.col("subject")).where(when).select(case, *cols, "n", *X)

    means, draws = cut(discrepancy.means(rows, X)[0]), cut(resample.poisson_draws(rows, X, B, 61, ["row_key"])[0])
    est = discrepancy.mean_distance(met(means, "source < target", "source"), met(means, "source = target"), X, ["case_id"])
    return screening_of(est, discrepancy.mean_distance(met(draws, "source < target", "source", "b"), met(draws, "source = target", "b"), X, ["case_id", "b"]))


@query(ROLL_PRE + "SELECT split_part(case_id, '/', 1) AS subject, CAST(split_part(case_id, '/', 2) AS INTEGER) AS target, source, round(delta, 6) + 0.0 AS delta, rect, pair, ref FROM gate")
def rolling_targets(spark: SparkSession, d: str) -> DataFrame:
    """W2, W3, J12."""
    part = F.split("case_id", "/")
    return gates.gates(rolling_screen(spark, d).system).select(part[0].alias("subject"), part[1].cast("int").alias("target"), "source", *r6("delta"), "rect", "pair", "ref")


@query(
    ROLL_PRE
    + """, sets AS (SELECT split_part(case_id, '/', 1) AS subject, CAST(split_part(case_id, '/', 2) AS INTEGER) AS target, coalesce(list(source) FILTER (ref = 1), []) AS m FROM gate GROUP BY ALL), lagged AS (SELECT *, lag(m) OVER (PARTITION BY subject ORDER BY target) AS p FROM sets)
SELECT subject, target, round(coalesce(len(list_intersect(m, p)) / nullif(len(list_distinct(list_concat(m, p))), 0), 1), 6) + 0.0 AS jaccard FROM lagged WHERE p IS NOT NULL"""
)
def consecutive_stability(spark: SparkSession, d: str) -> DataFrame:
    """W4, J11."""
    m = gates.long_members(gates.gates(rolling_screen(spark, d).system), ["ref"])
    part = F.split("case_id", "/")
    sets = evaluate.as_sets(m, ["case_id"]).select(part[0].alias("subject"), part[1].cast("int").alias("target"), "method", "members")
    return evaluate.consecutive_stability(sets, ["subject"]).select("subject", "target", F.round("jaccard", 6).alias("jaccard"))


# ---- matrices and kernels


@query(
    """WITH m AS (SELECT r_name AS case_id, CAST(year(l_shipdate) AS INTEGER) AS source, var_samp(l_quantity / 15) AS a, covar_samp(l_quantity / 15, l_extendedprice / 30000) AS b, var_samp(l_extendedprice / 30000) AS d
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
k AS (SELECT case_id, source, 0.9 * a + 0.1 * (a + d) / 2 AS a, 0.9 * b AS b, 0.9 * d + 0.1 * (a + d) / 2 AS d FROM m),
t AS (SELECT * FROM k QUALIFY source = max(source) OVER (PARTITION BY case_id)),
p AS (SELECT k.case_id, k.source, k.a, k.b, k.d, t.a AS ta, t.b AS tb, t.d AS td FROM k JOIN t ON k.case_id = t.case_id AND k.source < t.source),
e AS (SELECT *, (td * a - 2 * tb * b + ta * d) / (ta * td - tb * tb) AS tr, (a * d - b * b) / (ta * td - tb * tb) AS dt FROM p),
g AS (SELECT *, tr / 2 + sqrt(greatest(tr * tr / 4 - dt, 0)) AS hi FROM e),
lg AS (SELECT *, sqrt(pow((a - d) / 2, 2) + b * b) AS s, sqrt(pow((ta - td) / 2, 2) + tb * tb) AS ts FROM g),
l2 AS (SELECT *, (ln((a + d) / 2 + s) - ln((a + d) / 2 - s)) / (2 * s) AS be, (ln((ta + td) / 2 + ts) - ln((ta + td) / 2 - ts)) / (2 * ts) AS tbe FROM lg),
l3 AS (SELECT *, ln((a + d) / 2 + s) - be * ((a + d) / 2 + s) AS al, ln((ta + td) / 2 + ts) - tbe * ((ta + td) / 2 + ts) AS tal FROM l2)
SELECT case_id, source, round(pow(ln(hi), 2) + pow(ln(dt / hi), 2), 9) + 0.0 AS airm2, round(pow(al + be * a - tal - tbe * ta, 2) + 2 * pow(be * b - tbe * tb, 2) + pow(al + be * d - tal - tbe * td, 2), 9) + 0.0 AS logeuclid2, round(pow(a - ta, 2) + 2 * pow(b - tb, 2) + pow(d - td, 2), 9) + 0.0 AS euclid2 FROM l3"""
)
def matrix_distances(spark: SparkSession, d: str) -> DataFrame:
    """F1 - F7 for two channels, in closed forms: session covariance, shrinkage, three distances to the target's."""
    q, p = F.col("q"), F.col("p")
    places = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("case_id"))
    t = read(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("source"), (F.col("l_quantity") / 15).alias("q"), (F.col("l_extendedprice") / 30000).alias("p")).join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    m = t.groupBy("case_id", "source").agg(F.array(F.var_samp(q), F.covar_samp("q", "p"), F.covar_samp("q", "p"), F.var_samp(p)).alias("c"))
    m = m.withColumn("m", matrices.shrink(F.col("c"), 0.1, 2)).withColumn("last", F.max("source").over(Window.partitionBy("case_id")))
    both = m.where("source < last").select("case_id", "source", "m").join(m.where("source = last").select("case_id", F.col("m").alias("t")), "case_id")
    return both.select("case_id", "source", *[F.round(f(F.col("t"), F.col("m")), 9).alias(f"{k}2") for k, f in matrices.METRICS.items()])


SIGMA = 4.0
KERNEL_SQL = f"""{VECTOR_SQL},
pr AS (SELECT a.source AS s1, z.source AS s2, a.i AS i1, z.i AS i2, exp(-({" + ".join(f"pow(a.{v} - z.{v}, 2)" for v in V)}) / {2 * SIGMA * SIGMA}) AS k FROM trials a, trials z WHERE a.source = z.source OR z.is_target)"""


@query(
    f"""WITH {KERNEL_SQL},
uu AS (SELECT s1 AS source, avg(k) AS u FROM pr WHERE s1 = s2 AND i1 <> i2 GROUP BY ALL), x AS (SELECT s1 AS source, avg(k) AS c FROM pr WHERE s2 = (SELECT max(source) FROM trials) AND s1 <> s2 GROUP BY ALL)
SELECT x.source, round(a.u + t.u - 2 * x.c, 9) + 0.0 AS mmd2 FROM x JOIN uu a ON a.source = x.source JOIN uu t ON t.source = (SELECT max(source) FROM trials)"""
)
def kernel_discrepancy(spark: SparkSession, d: str) -> DataFrame:
    """Unbiased MMD² of each label against the last; the target's own pairs are met once."""
    return discrepancy.kernel_distance(vector_trials(spark, d), "x", SIGMA).select("source", (F.round("delta", 9) + 0.0).alias("mmd2"))


KERNEL_B = 49


@query(
    f"""WITH {KERNEL_SQL},
ses AS (SELECT source, is_target, count(*) AS n FROM trials GROUP BY ALL), bs AS (SELECT unnest(range({KERNEL_B})) AS b),
dj AS (SELECT source, is_target, n, b, unnest(range(n)) AS j FROM ses, bs),
wt AS (SELECT source, is_target, n, b, ({o.polynomial("md5('35|' || CASE WHEN is_target THEN 't' ELSE 's' END || '|vectors|' || CASE WHEN is_target THEN -1 ELSE source END || '|' || b)", "(j + 1)")}) % n AS i, count(*) AS w FROM dj GROUP BY ALL),
q AS (SELECT a.source AS s1, z.source AS s2, z.is_target, a.b, sum(a.w * z.w * k) AS s, any_value(a.n) AS n1, any_value(z.n) AS n2 FROM pr JOIN wt a ON a.source = s1 AND a.i = i1 JOIN wt z ON z.source = s2 AND z.i = i2 AND z.b = a.b GROUP BY ALL),
uu AS (SELECT s1 AS source, b, (s - n1) / (n1 * (n1 - 1)) AS u FROM q WHERE s1 = s2),
m AS (SELECT x.s1 AS source, x.b, a.u + t.u - 2 * x.s / (x.n1 * x.n2) AS mmd2 FROM q x JOIN uu a ON a.source = x.s1 AND a.b = x.b JOIN uu t ON t.source = x.s2 AND t.b = x.b WHERE x.is_target AND x.s1 <> x.s2)
SELECT source, count(*) AS draws, round(avg(mmd2), 8) + 0.0 AS mean, round(stddev_samp(mmd2), 8) + 0.0 AS se, round(quantile_cont(mmd2, 0.025), 8) + 0.0 AS low, round(quantile_cont(mmd2, 0.975), 8) + 0.0 AS high FROM m GROUP BY source"""
)
def kernel_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap of MMD² with drawn counts as weights of the kernel's quadratic forms; one target draw for all labels."""
    m = discrepancy.kernel_distance(vector_trials(spark, d), "x", SIGMA, KERNEL_B, 35).where("b >= 0")
    q = lambda p: F.percentile("delta", F.lit(p))
    return m.groupBy("source").agg(F.count("*").alias("draws"), *[F.round(x, 8).alias(n) for x, n in ((F.avg("delta"), "mean"), (F.stddev_samp("delta"), "se"), (q(0.025), "low"), (q(0.975), "high"))])


# ---- covariance matrices of two channels, each vector's 64 values as 2 x 32 samples: closed forms, so with SQL

PAIR_SQL = f"""pc AS (SELECT vec_id, label, [embedding[1:32], embedding[33:64]] AS e FROM embeddings),
pz AS (SELECT vec_id, label, list_transform(e, lambda a: list_transform(a, lambda x: 4 * (CAST(x AS DOUBLE) - list_avg(list_transform(a, lambda y: CAST(y AS DOUBLE)))))) AS z FROM pc),
pm AS (SELECT 'vectors' AS case_id, label AS source, label = (SELECT max(label) FROM embeddings) AS is_target, CAST(vec_id AS VARCHAR) AS row_key, list_dot_product(z[1], z[1]) / 31 AS a, list_dot_product(z[1], z[2]) / 31 AS b2, list_dot_product(z[2], z[2]) / 31 AS d2 FROM pz),
{o.numbered("pm", "trials", "case_id, source", "row_key")}"""
COV = ("a", "b2", "d2")


def airm_sql(draws: str, out: str, keys: str, lam: float = 0.1) -> str:
    """AIRM of shrunk 2 x 2 means from the target's, by the two roots."""
    shrunk = f"SELECT *, {1 - lam} * a + {lam} * (a + d2) / 2 AS sa, {1 - lam} * b2 AS sb, {1 - lam} * d2 + {lam} * (a + d2) / 2 AS sd FROM"
    return f"""{out}_k AS ({shrunk} {draws}),
{out}_e AS (SELECT s.*, (t.sd * s.sa - 2 * t.sb * s.sb + t.sa * s.sd) / (t.sa * t.sd - t.sb * t.sb) AS tr, (s.sa * s.sd - s.sb * s.sb) / (t.sa * t.sd - t.sb * t.sb) AS dt FROM {out}_k s JOIN {out}_k t ON s.case_id = t.case_id AND t.is_target{" AND s.b = t.b" if "b" in keys.split(", ") else ""} WHERE NOT s.is_target),
{out} AS (SELECT {keys}, pow(ln(hi), 2) + pow(ln(dt / hi), 2) AS delta FROM (SELECT *, tr / 2 + sqrt(greatest(tr * tr / 4 - dt, 0)) AS hi FROM {out}_e))"""


@query(
    o.with_(
        PAIR_SQL, f"mm AS (SELECT case_id, source, is_target, {', '.join(f'avg({c}) AS {c}' for c in COV)} FROM trials GROUP BY ALL)", airm_sql("mm", "est", "case_id, source"),
        o.index_draws("trials", B, 92, features=COV).split(",\ndraws AS")[0], "md AS (SELECT case_id, source, false AS is_target, b, a, b2, d2 FROM sd UNION ALL SELECT case_id, -1, true, b, a, b2, d2 FROM td)", airm_sql("md", "draws", "case_id, source, b"), o.system(),
    )
    + GATE_SELECT
)
def screen_pair_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Count bootstrap of mean covariance matrices, affine-invariant distance, bounds and gates."""
    from .operators import learn

    return gate_rows_of(learn.matrix_draws(matrix_trials(spark, d, 2), 2, B, 92))


# ---- simulation with a known truth

CONDITIONS = [("large", (0.0, 0.64, 1.96)), ("tied", (0.0, 0.0, 0.8))]
REPS = 8
SIM_ROWS = [(k, name, j + 1, delta) for k, (name, deltas) in enumerate(CONDITIONS) for j, delta in enumerate(deltas)] + [(k, name, 0, -1.0) for k, (name, _) in enumerate(CONDITIONS)]


def bm(seed: int, *keys: str) -> str:
    h = f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"
    return f"sqrt(-2 * ln(({o.number(h)} + 1.0) / 4294967297.0)) * cos(2 * pi() * {o.number(h, 8)} / 4294967296.0)"


SIM_SQL = f"""cond AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{a}', {b}, {c})" for k, a, b, c in SIM_ROWS)}) v(half, scenario, source, true_delta)),
sim AS (SELECT scenario || '/' || user_id % {REPS} AS case_id, source, source = 0 AS is_target, CAST(event_id AS VARCHAR) AS row_key, {bm(71, "event_id", "1")} + sqrt(greatest(true_delta, 0)) AS x1, {bm(71, "event_id", "2")} AS x2
  FROM events JOIN cond ON half = event_id % 2 AND source = event_id // 2 % 4),
{o.numbered("sim", "trials", "case_id, source", "row_key")}"""
SIM_PRE = o.with_(SIM_SQL, o.estimates("trials"), o.index_draws("trials", B, 73), o.system())


def simulated(spark: SparkSession, d: str):
    """Gaussian sources at known distances, a trial for each event, keyed by it; a case for each condition and user group."""
    e, k = read(spark, d, "events"), F.col("event_id")
    c = spark.createDataFrame(SIM_ROWS, "half long, scenario string, source int, true double")
    r = e.select("event_id", "user_id").join(F.broadcast(c), (F.pmod(k, F.lit(2)) == F.col("half")) & (F.pmod(F.floor(k / 2), F.lit(4)) == F.col("source")))
    r = r.withColumn("case_id", F.concat_ws("/", "scenario", F.pmod("user_id", F.lit(REPS))))
    t = synthetic.shifted(r, 71, ["event_id"], F.sqrt(F.greatest("true", F.lit(0.0))), 2).select("case_id", "source", (F.col("source") == 0).alias("is_target"), k.cast("string").alias("row_key"), "x1", "x2")
    truth = r.where("source > 0").select("case_id", "source", "true").distinct()
    return screen(roles.numbered(t, ["case_id", "source"], ["row_key"]), X, B, 73), truth


TRUTH = f"tr AS (SELECT case_id, source, true_delta, true_delta - min(true_delta) OVER (PARTITION BY scenario) AS ex FROM cond, (SELECT unnest(range({REPS})) AS rep), LATERAL (SELECT scenario || '/' || rep AS case_id) WHERE source > 0)"


@query(
    SIM_PRE
    + f""", {TRUTH}, g AS (SELECT case_id, source, unnest(['rect', 'pair', 'ref']) AS method, unnest([rect, pair, ref]) AS s FROM gate), m AS (SELECT g.*, ex, ex <= 1e-12 AS o FROM g JOIN tr USING (case_id, source))
SELECT case_id, method, CAST(bool_and(s = 1 OR NOT o) AS INTEGER) AS oracle_retained, CAST(bool_and((s = 1) = o) AS INTEGER) AS exact_recovery, count(*) FILTER (s = 1) AS set_size, round(max(CASE WHEN s = 1 THEN ex END), 6) + 0.0 AS worst_excess, count(*) FILTER (s = 0 AND o) AS false_excluded_oracle, count(*) FILTER (s = 1 AND NOT o) AS false_included_nonoracle FROM m GROUP BY ALL"""
)
def simulation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """E1, F17, P9."""
    s, truth = simulated(spark, d)
    m = evaluate.set_metrics(gates.long_members(gates.gates(s.system), ["rect", "pair", "ref"]), truth, ["case_id"])
    return m.withColumn("worst_excess", F.round("worst_excess", 6))


AUDIT_FLAGS = ("e_c", "e_d", "e_c_j", "e_d_j", "v_rect", "v_rect_near", "v_pair", "v_pair_near", "v_ref", "v_rect_empty", "v_ref_subset_rect", "domination_lb_all", "domination_se_all", "pair_subset_rect", "v_domination_subset")


@query(
    SIM_PRE
    + f""", {TRUTH}, e AS (SELECT case_id, bool_and(true_delta BETWEEN lower AND upper) AS c, bool_and(true_delta BETWEEN lower_j AND upper_j) AS cj, max(upper - lower) AS wmax, bool_or(ex <= 1e-12 AND rect = 0) AS lost_r, bool_or(ex <= 1e-12 AND pair = 0) AS lost_p, bool_or(ex <= 1e-12 AND ref = 0) AS lost_f,
  coalesce(max(CASE WHEN rect = 1 THEN ex END), -1e300) AS ex_r, coalesce(max(CASE WHEN pair = 1 THEN ex END), -1e300) AS ex_p, sum(rect) AS n_r, bool_or(ref = 1 AND rect = 0) AS outside, bool_and(pair = 0 OR rect = 1) AS within FROM gate JOIN tr USING (case_id, source) GROUP BY ALL),
f AS (SELECT c.case_id, bool_and(a.true_delta - z.true_delta >= c.lower) AS d, bool_and(a.true_delta - z.true_delta >= c.lower_j) AS dj, greatest(0, max(a.true_delta - z.true_delta - c.lower)) AS eps, bool_and(c.lower >= gj.lower - gl.upper - 1e-10) AS dom_lb, bool_and(q_d * c.se <= q_c * (gj.se + gl.se) + 1e-12) AS dom_se
  FROM cont c JOIN tr a ON a.case_id = c.case_id AND a.source = c.j JOIN tr z ON z.case_id = c.case_id AND z.source = c.l JOIN gate gj ON gj.case_id = c.case_id AND gj.source = c.j JOIN gate gl ON gl.case_id = c.case_id AND gl.source = c.l JOIN q ON q.case_id = c.case_id GROUP BY ALL)
SELECT case_id, round(wmax, 6) + 0.0 AS wmax, round(eps, 6) + 0.0 AS epsilon_pair, {", ".join(f"CAST({x} AS INTEGER) AS {n}" for x, n in zip(("c", "d", "cj", "dj", "c AND lost_r", "c AND ex_r > 2 * wmax + 1e-10", "d AND lost_p", "d AND ex_p > eps + 1e-10", "c AND d AND lost_f", "n_r = 0", "outside", "dom_lb", "dom_se", "within", "dom_lb AND NOT within"), AUDIT_FLAGS, strict=True))} FROM e JOIN f USING (case_id)"""
)
def simulation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Events, violations that must not occur when bounds cover, and the domination checks."""
    s, truth = simulated(spark, d)
    a = evaluate.audit(gates.gates(s.system), s.system, truth, ["case_id"])
    return a.select("case_id", *r6("wmax", "epsilon_pair"), *AUDIT_FLAGS)


STRADDLE_SQL = f"""str AS (SELECT 'straddle/' || user_id % 12 AS case_id, CAST(event_id % 3 AS INTEGER) AS source, event_id % 3 = 0 AS is_target, CAST(event_id AS VARCHAR) AS row_key, {bm(81, "event_id", "1")} + CASE event_id % 3 WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS x1, 0.0 AS x2 FROM events),
{o.numbered("str", "trials", "case_id, source", "row_key")}"""


def straddle_sql(shared: bool) -> str:
    return (
        o.with_(STRADDLE_SQL, o.estimates("trials"), o.index_draws("trials", B, 83, shared=shared))
        + """SELECT e.case_id, round(e.d, 6) + 0.0 AS d_hat, round(s.se, 6) + 0.0 AS se, CAST(abs(e.d) <= s.q * s.se AS INTEGER) AS covered FROM (SELECT a.case_id, a.delta - z.delta AS d FROM est a JOIN est z USING (case_id) WHERE a.source = 1 AND z.source = 2) e
JOIN (SELECT case_id, stddev_samp(d) AS se, quantile_cont(abs(d - dh), 0.95) / stddev_samp(d) AS q FROM (SELECT a.case_id, a.delta - z.delta AS d, y.delta - w.delta AS dh FROM draws a JOIN draws z USING (case_id, b) JOIN est y ON y.case_id = a.case_id AND y.source = 1 JOIN est w ON w.case_id = a.case_id AND w.source = 2 WHERE a.source = 1 AND z.source = 2) GROUP BY ALL) s USING (case_id)"""
    )


def straddle(spark: SparkSession, d: str, shared: bool) -> DataFrame:
    """E5: two sources on either side of the target at equal distance, a trial for each event; their true contrast is zero."""
    r = read(spark, d, "events").select("event_id", "user_id", F.pmod("event_id", F.lit(3)).cast("int").alias("source"))
    side = F.when(F.col("source") == 1, -1).when(F.col("source") == 2, 1).otherwise(0)
    t = synthetic.shifted(r, 81, ["event_id"], side, 1).select(F.concat(F.lit("straddle/"), F.pmod("user_id", F.lit(12))).alias("case_id"), "source", (F.col("source") == 0).alias("is_target"), F.col("event_id").cast("string").alias("row_key"), "x1", F.lit(0.0).alias("x2"))
    t = roles.numbered(t, ["case_id", "source"], ["row_key"])
    s = screen(t, X, B, 83, shared=shared)
    d_hat = system.contrast_pairs(s.est, ["case_id"]).where("j = 1 and l = 2").select("case_id", F.col("d").alias("d_hat"))
    draws = system.contrast_pairs(s.draws, ["case_id", "b"]).where("j = 1 and l = 2").join(d_hat, "case_id")
    q = draws.groupBy("case_id", "d_hat").agg(F.stddev_samp("d").alias("se"), F.percentile(F.abs(F.col("d") - F.col("d_hat")), F.lit(0.95)).alias("q"))
    return q.select("case_id", *r6("d_hat", "se"), (F.abs("d_hat") <= F.col("q")).cast("int").alias("covered"))


@query(straddle_sql(True))
def straddle_shared(spark: SparkSession, d: str) -> DataFrame:
    return straddle(spark, d, True)


@query(straddle_sql(False))
def straddle_wrong_target(spark: SparkSession, d: str) -> DataFrame:
    return straddle(spark, d, False)


# ---- without SQL: held against numpy in tests


def matrix_trials(spark: SparkSession, d: str, channels: int) -> DataFrame:
    """Each vector's 64 values as `channels` channels: demeaned, X X' by samples less one (F1)."""
    n = DIMENSIONS // channels
    ch = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.slice(F.col("_x"), c * n + 1, n))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e) / n
    centred = F.transform(ch, lambda a: F.transform(F.arrays_zip(a.alias("v"), F.array_repeat(mean(a), n).alias("m")), lambda e: e["v"] - e["m"]))
    cov = F.flatten(F.transform("z", lambda a: F.transform("z", lambda b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e) / (n - 1))))
    v = read(spark, d, "embeddings").where("embedding is not null")
    t = v.select(F.lit("vectors").alias("case_id"), F.col("label").alias("source"), F.col("vec_id").cast("string").alias("row_key"), "vec_id", whole_vector().alias("_x")).withColumn("z", centred).withColumn("cov", cov).drop("z", "_x")
    last = v.agg(F.max("label").alias("last"))
    return roles.numbered(t.crossJoin(F.broadcast(last)).withColumn("is_target", F.col("source") == F.col("last")).drop("last"), ["case_id", "source"], ["row_key"])


@query()
def matrix_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """R2, R4, F3 in four channels of 16 samples: count bootstrap, AIRM, bounds and gates."""
    from .operators import learn

    return gate_rows_of(learn.matrix_draws(matrix_trials(spark, d, 4), 4, B, 91))


def gate_rows_of(draws: DataFrame) -> DataFrame:
    draws = cut(draws)
    s = system.build(draws.where("b < 0").drop("b"), draws.where("b >= 0"))
    return gates.gates(s).select("case_id", "source", *r6(*GATE_COLS), *FLAGS)


@query()
def tangent_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Odd against even vectors of the last label, learned from each label alone."""
    from .operators import learn

    t = cut(matrix_trials(spark, d, 4).withColumn("label", F.pmod("vec_id", F.lit(2))))
    train = t.where("not is_target").select("source", "label", "cov")
    test = train.select("source").distinct().crossJoin(t.where("is_target").select("label", "cov"))
    return learn.tangent_lda(train, test, ["source"], 4)


@query()
def pooled_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Screen with half of the target, learn from the pooled trials of the sources each rule retains, test on the other half; and from the target's screening half alone.

    Rules that retain the same sources are fitted once.
    """
    from .operators import learn

    t = cut(matrix_trials(spark, d, 4).withColumn("label", F.pmod("vec_id", F.lit(2))))
    halves = resample.half_splits(t.where("is_target").select("case_id", "vec_id", "label"), 1, 95, ["case_id", "vec_id"]).select("case_id", "vec_id", "role")
    target = cut(t.where("is_target").join(halves, ["case_id", "vec_id"]))
    screening = t.where("not is_target").unionByName(target.where("role = 'screen'").drop("role"))
    draws = cut(learn.matrix_draws(screening, 4, B, 96))
    s = system.build(draws.where("b < 0").drop("b"), draws.where("b >= 0"))
    flags = gates.gates(s).withColumn("all_sources", F.lit(1))
    sets = evaluate.as_sets(gates.long_members(flags, ["rect", "pair", "ref", "all_sources"]), ["case_id"])
    fit = lambda role: target.where(F.col("role") == role).select("case_id", "label", "cov")
    return learn.pooled(sets, t.where("not is_target").select("case_id", "source", "label", "cov"), fit("screen"), fit("test"), 4)


WHITE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def whitened_features(spark: SparkSession, d: str) -> DataFrame:
    """F15, M4."""
    from .operators import learn

    w = learn.standardise_whiten(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *WHITE), WHITE, 3)
    return w.agg(*[F.round(f(F.col("white")[k]), 6).alias(f"{n}_{k}") for k in range(3) for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


PAIR = ("l_quantity", "l_extendedprice")


@query(
    f"""WITH m AS (SELECT avg({PAIR[0]}) AS ma, stddev_samp({PAIR[0]}) AS sa, avg({PAIR[1]}) AS mb, stddev_samp({PAIR[1]}) AS sb, corr({PAIR[0]}, {PAIR[1]}) AS r FROM lineitem),
w AS (SELECT l_suppkey, (({PAIR[0]} - ma) / sa + sign(r) * ({PAIR[1]} - mb) / sb) / sqrt(2 * (1 + abs(r))) AS p, (({PAIR[0]} - ma) / sa - sign(r) * ({PAIR[1]} - mb) / sb) / sqrt(2 * (1 - abs(r))) AS q FROM lineitem, m)
SELECT l_suppkey, round(sum(p * p), 4) + 0.0 AS first_power, round(sum(q * q), 4) + 0.0 AS second_power, round(abs(sum(p)), 4) + 0.0 AS first_sum, round(abs(sum(q)), 4) + 0.0 AS second_sum FROM w GROUP BY l_suppkey"""
)
def whitened_pair(spark: SparkSession, d: str) -> DataFrame:
    """F15, M4 for two columns, whose components are their sum and difference; signs are free, so squares and sizes are told."""
    from .operators import learn

    w = learn.standardise_whiten(read(spark, d, "lineitem").select("l_suppkey", *PAIR), list(PAIR), 2)
    p = lambda k: F.col("white")[k]
    return w.groupBy("l_suppkey").agg(*[F.round(x, 4).alias(n) for x, n in ((F.sum(p(0) * p(0)), "first_power"), (F.sum(p(1) * p(1)), "second_power"), (F.abs(F.sum(p(0))), "first_sum"), (F.abs(F.sum(p(1))), "second_sum"))])
