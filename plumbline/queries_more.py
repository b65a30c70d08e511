"""Smaller operators as queries: projections, JSON, hashes, times, maps, epochs, summaries of coverage and accuracy. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import queries_screen as qs
from .functions import sets, signals
from .operators import evaluate, events, gates, inference, validate
from .plans import oracle as o
from .queries_tables import read

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT COLUMNS('o_order.*') FROM orders WHERE isfinite(o_totalprice) AND o_orderkey % 2 = 0")
def prefix_projection(spark: SparkSession, d: str) -> DataFrame:
    """Columns by a prefix of their names, finite rows; both reach the scan."""
    t = read(spark, d, "orders").where(~F.isnan("o_totalprice") & (F.abs("o_totalprice") != float("inf")) & (F.col("o_orderkey") % 2 == 0))
    return t.select(*[c for c in t.columns if c.startswith("o_order")])


@query("SELECT c_mktsegment, round(avg(c_custkey), 6) + 0.0 AS c_custkey, round(avg(c_nationkey), 6) + 0.0 AS c_nationkey, round(avg(c_acctbal), 6) + 0.0 AS c_acctbal FROM customer GROUP BY ALL")
def mean_of_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A2: means of every numeric column, found by type."""
    m = inference.mean_numeric(read(spark, d, "customer"), ["c_mktsegment"])
    return m.select("c_mktsegment", *[(F.round(c, 6) + 0.0).alias(c) for c in m.columns if c != "c_mktsegment"])


@query(
    "SELECT n_nationkey, to_json({'key': n_nationkey, 'name': n_name, 'tags': [n_name, CAST(n_regionkey AS VARCHAR)]}) AS document, sha256(to_json({'key': n_nationkey, 'name': n_name})) AS digest, "
    "3 AS n_back, n_regionkey AS second, array_to_string(list_sort(list_distinct([1, 2, 3, 7, n_nationkey + 3])), ',') AS parsed FROM nation"
)
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """JSON of lists both ways, canonical JSON (sorted keys, no blanks) and its hash, ranges parsed from text."""
    n = read(spark, d, "nation")
    doc = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("tags")))
    back = F.from_json(doc, "key long, name string, tags array<string>")
    canonical = sets.canonical_json({"name": F.col("n_name"), "key": F.col("n_nationkey")})
    ranges = F.concat(F.lit("1-3, 7,"), (F.col("n_nationkey") + 3).cast("string"))
    return n.select("n_nationkey", doc.alias("document"), F.sha2(canonical, 256).alias("digest"), (F.size(back["tags"]) + 1).alias("n_back"), back["tags"][1].cast("int").alias("second"), F.array_join(sets.parse_ranges(ranges).cast("array<string>"), ",").alias("parsed")).withColumn("second", F.col("second").cast(n.schema["n_regionkey"].dataType))


@query(
    "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS hour_, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(dayofweek(ts) AS INTEGER) + 1 AS weekday, "
    "CAST(floor(epoch(ts)) - epoch(date_trunc('day', ts)) AS BIGINT) AS into_day, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS level FROM events"
)
def times_and_maps(spark: SparkSession, d: str) -> DataFrame:
    """timestamps truncated, formatted and counted; values looked up in a map, 0 if absent."""
    ts = F.col("ts")
    level = F.create_map(F.lit("view"), F.lit(1), F.lit("click"), F.lit(2))
    return read(spark, d, "events").select(
        "event_id", F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd'T'HH:mm:ss").alias("hour_"), F.unix_timestamp(ts).alias("seconds"), F.dayofweek(ts).alias("weekday"),
        (F.unix_timestamp(ts) - F.unix_timestamp(F.date_trunc("day", ts))).alias("into_day"), F.coalesce(F.try_element_at(level, F.col("event_type")), F.lit(0)).alias("level"),
    )


@query("SELECT vec_id, k, round(list_avg(list_transform(embedding[8 * k + 1 : 8 * k + 16], lambda x: CAST(x AS DOUBLE))), 9) + 0.0 AS mean, len(embedding[8 * k + 1 : 8 * k + 16]) AS n FROM embeddings, (SELECT unnest(range(7)) AS k)")
def epochs(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 16 samples at starts 8 apart, cut from each signal as array slices."""
    e = signals.epochs(read(spark, d, "embeddings").withColumn("starts", F.sequence(F.lit(0), F.lit(48), F.lit(8))), "embedding", "starts", 16)
    mean = F.aggregate("epoch", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("epoch")
    return e.select("vec_id", F.col("k").cast("long").alias("k"), (F.round(mean, 9) + 0.0).alias("mean"), F.size("epoch").cast("long").alias("n"))


BAND = (8.0, 14.0, 64.0)


def band_sql(low: float = BAND[0], high: float = BAND[1]) -> str:
    """The recurrence of every section, a sample a step."""
    row = f"SELECT r.*, CAST(embedding[k + 1] AS DOUBLE) AS y0 FROM r JOIN embeddings USING (vec_id) WHERE k < {qs.DIMENSIONS}"
    after = []
    for i, (b0, b1, b2, a1, a2) in enumerate(signals.butterworth(low, high, BAND[2]).tolist()):
        row = f"SELECT *, {b0!r} * y{i} + s{2 * i} AS y{i + 1} FROM ({row})"
        after += [f"{b1!r} * y{i} - {a1!r} * y{i + 1} + s{2 * i + 1} AS s{2 * i}", f"{b2!r} * y{i} - {a2!r} * y{i + 1} AS s{2 * i + 1}"]
    n = len(after) // 2
    rest = ", ".join(f"CAST(0 AS DOUBLE) AS s{i}" for i in range(2 * n))
    return f"""WITH RECURSIVE r AS (SELECT vec_id, 0 AS k, CAST(NULL AS DOUBLE) AS y, {rest} FROM embeddings UNION ALL SELECT vec_id, k + 1, y{n}, {", ".join(x.rsplit(" AS ", 1)[0] for x in after)} FROM ({row}))
SELECT vec_id, round(ln(var_pop(y) + 1e-12), 6) + 0.0 AS logvar FROM r WHERE k > 0 GROUP BY vec_id"""


@query(band_sql())
def band_power(spark: SparkSession, d: str) -> DataFrame:
    """Log variance of each vector, as a signal of 64 samples a second, in the band from 8 to 14."""
    return signals.band_pass(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", "filtered", *BAND).select("vec_id", (F.round(signals.log_variance("filtered"), 6) + 0.0).alias("logvar"))


@query(
    f"""WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT user_id, count(*) AS samples, count(DISTINCT i // 100) AS chunks FROM x GROUP BY user_id HAVING count(*) > 0"""
)
def long_signals(spark: SparkSession, d: str) -> DataFrame:
    """X1 on signals in many rows: each user's values in the order of events, in chunks of 100 samples, filtered chunk by chunk as if whole; what is counted are finite outputs."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = read(spark, d, "events").select("user_id", F.col("value").alias("v"), (F.row_number().over(w) - 1).alias("i"))
    chunks = x.groupBy("user_id", F.floor(F.col("i") / 100).alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("x"))
    y = signals.band_pass_chunks(chunks, ["user_id"], "chunk", "x", "y", *BAND)
    finite = F.size(F.filter("y", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return y.groupBy("user_id").agg(F.sum(finite).alias("samples"), F.count("*").alias("chunks"))


@query(
    "WITH e AS (SELECT user_id % 4 AS grp, event_type AS truth, CASE WHEN value > 60 THEN 'purchase' WHEN value > 30 THEN 'click' ELSE 'view' END AS said FROM events WHERE event_type IN ('view', 'click', 'purchase')), "
    "r AS (SELECT grp, truth, avg(CASE WHEN truth = said THEN 1.0 ELSE 0.0 END) AS recall FROM e GROUP BY ALL) SELECT grp, round(avg(recall), 6) + 0.0 AS balanced_accuracy FROM r GROUP BY grp"
)
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """E13."""
    v = F.col("value")
    e = read(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase")).select(F.pmod("user_id", F.lit(4)).alias("grp"), F.col("event_type").alias("truth"), F.when(v > 60, "purchase").when(v > 30, "click").otherwise("view").alias("said"))
    return inference.balanced_accuracy(e, ["grp"], "truth", "said").select("grp", (F.round("balanced_accuracy", 6) + 0.0).alias("balanced_accuracy"))


NOMINAL = {"e_c": 0.975, "e_d": 0.975, "e_joint": 0.95}
COVER_SQL = f"""cv AS (SELECT e.case_id, split_part(e.case_id, '/', 1) AS scenario, e_c, e_d, e_c * e_d AS e_joint FROM (SELECT case_id, CAST(bool_and(true_delta BETWEEN lower AND upper) AS INTEGER) AS e_c FROM gate JOIN tr USING (case_id, source) GROUP BY ALL) e
JOIN (SELECT c.case_id, CAST(bool_and(a.true_delta - z.true_delta >= c.lower) AS INTEGER) AS e_d FROM cont c JOIN tr a ON a.case_id = c.case_id AND a.source = c.j JOIN tr z ON z.case_id = c.case_id AND z.source = c.l GROUP BY ALL) f USING (case_id))"""


@query(
    qs.SIM_PRE
    + f""", {qs.TRUTH}, {COVER_SQL}, g AS (SELECT scenario, unnest(['e_c', 'e_d', 'e_joint']) AS event, unnest([e_c, e_d, e_joint]) AS v, unnest([0.975, 0.975, 0.95]) AS nominal FROM cv)
SELECT scenario, event, CAST(nominal AS DOUBLE) AS nominal, count(*) AS cases, round(avg(v), 6) + 0.0 AS coverage, round(avg(v) - nominal, 6) + 0.0 AS excess, avg(v) >= nominal AS reached FROM g GROUP BY scenario, event, nominal"""
)
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each event over simulated cases, beside its nominal level."""
    s, truth = qs.simulated(spark, d)
    c = evaluate.coverage(s.system, truth, ["case_id"]).withColumn("scenario", F.split("case_id", "/")[0])
    x = evaluate.coverage_summary(c, ["scenario"], NOMINAL)
    return x.select("scenario", "event", "nominal", "cases", *[(F.round(k, 6) + 0.0).alias(k) for k in ("coverage", "excess")], "reached")


@query(
    qs.SIM_PRE
    + """, cq AS (SELECT *, CASE WHEN source = 1 THEN upper * 1.001 + 1e-3 ELSE upper END AS altered FROM comp JOIN q USING (case_id)), kq AS (SELECT cont.*, q_d, q_j FROM cont JOIN q USING (case_id))
SELECT 'lower' AS bound, count(*) AS "rows", count(*) FILTER (abs(lower - (delta - q_c * se)) > 1e-9 OR abs(lower_j - (delta - q_j * se)) > 1e-9) AS broken FROM cq
UNION ALL SELECT 'upper', count(*), count(*) FILTER (abs(altered - (delta + q_c * se)) > 1e-9 OR abs(upper_j - (delta + q_j * se)) > 1e-9) FROM cq
UNION ALL SELECT 'contrast', count(*), count(*) FILTER (abs(lower - (d_hat - q_d * se)) > 1e-9 OR abs(lower_j - (d_hat - q_j * se)) > 1e-9) FROM kq
UNION ALL SELECT 'zero contrast with itself', count(*), count(*) FILTER (abs(a.d_hat + z.d_hat) > 1e-9) FROM cont a JOIN cont z ON a.case_id = z.case_id AND a.j = z.l AND a.l = z.j"""
)
def bound_algebra(spark: SparkSession, d: str) -> DataFrame:
    """V7: every bound recomputed from estimate, quantile and error; upper bounds of source 1 were altered and are found, contrasts are antisymmetric."""
    s, _ = qs.simulated(spark, d)
    altered = s.system.components.withColumn("upper", F.when(F.col("source") == 1, F.col("upper") * 1.001 + 1e-3).otherwise(F.col("upper")))
    x = validate.bound_algebra(s.system, altered)
    n = lambda df, name, bad: df.agg(F.lit(name).alias("bound"), F.count("*").alias("rows"), F.count_if(bad).alias("broken"))
    c, k = x["components"], x["contrasts"]
    return validate.union(n(c, "lower", ~F.col("lower_ok")), n(c, "upper", ~F.col("upper_ok")), n(k, "contrast", ~F.col("lower_ok")), n(k, "zero contrast with itself", ~F.col("opposite_ok")))


@query(
    o.with_(qs.EVENT_SQL, o.estimates("trials"), o.index_draws("trials", qs.B, 21), o.system())
    + "SELECT case_id, source, CAST(row_number() OVER (PARTITION BY case_id ORDER BY delta, source) <= greatest(1, sum(ref) OVER (PARTITION BY case_id)) AS INTEGER) AS top_matched, ref FROM gate"
)
def top_matched(spark: SparkSession, d: str) -> DataFrame:
    """As many best sources as the refinement retains in the same case."""
    from .plans.screening import screen

    g = gates.gates(screen(qs.event_trials(spark, d), qs.X, qs.B, 21).system)
    size = F.sum("ref").over(Window.partitionBy("case_id"))
    return g.withColumn("n", size).select("case_id", "source", gates.top_matched(g, F.col("n"), ["case_id"]).alias("top_matched"), "ref")


LEDGER_SQL = """e AS (SELECT *, lag(event_type) OVER w AS pk, lag(event_id) OVER w AS pa, lead(event_type) OVER w AS nk, lead(event_id) OVER w AS na FROM events WHERE event_type IN ('view', 'click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, event_id AS start_at, na AS end_at, na - event_id AS dur FROM e WHERE event_type = 'click' AND pk = 'view' AND nk = 'purchase')"""


@query(f"WITH {LEDGER_SQL} SELECT user_id, start_at, dur, CASE WHEN dur < 50 THEN 'short' WHEN end_at > 900 * (user_id % 20 + 1) THEN 'bounds' WHEN start_at % 7 = 0 THEN 'artifact' END AS exclusion_reason FROM s")
def exclusion_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Segments too short, outside their recording, or with an artifact, the first reason counting."""
    s = events.segments(read(spark, d, "events"), "user_id", "event_id", "event_type", "view", "click", "purchase").withColumn("dur", F.col("end_at") - F.col("start_at"))
    ledger = events.quality_ledger(s, "dur", 50, F.col("end_at") <= 900 * (F.col("user_id") % 20 + 1), F.col("start_at") % 7 == 0)
    return ledger.select("user_id", "start_at", "dur", "exclusion_reason")


@query("SELECT split, count(*) AS n FROM (SELECT vec_id, unnest(range(vec_id % 6)) AS split FROM embeddings) WHERE split < 3 GROUP BY split")
def first_splits(spark: SparkSession, d: str) -> DataFrame:
    """T4: the first three splits of each unit."""
    e = read(spark, d, "embeddings").select("vec_id", F.explode(F.when(F.col("vec_id") % 6 > 0, F.sequence(F.lit(0).cast("long"), F.col("vec_id") % 6 - 1))).alias("split"))
    return validate.first_splits(e, 3).groupBy("split").agg(F.count("*").alias("n"))


@query(
    f"""WITH a AS ({band_sql()}), b AS ({band_sql(10.0, 20.0)})
SELECT label AS session, CASE WHEN label < 5 THEN 8.0 ELSE 10.0 END AS low, count(*) AS trials, round(avg(CASE WHEN label < 5 THEN a.logvar ELSE b.logvar END), 5) + 0.0 AS logvar, CAST(CASE WHEN label < 5 THEN 1 ELSE 2 END AS BIGINT) AS times
FROM embeddings JOIN a USING (vec_id) JOIN b USING (vec_id) GROUP BY label"""
)
def cached_bands(spark: SparkSession, d: str) -> DataFrame:
    """Band power by session from a cache that is asked twice, the second time with another band for half of the sessions: only those are computed again."""
    import uuid

    from .lineage import checkpoint_dir, cut
    from .sources.cache import SessionCache

    cache = SessionCache(spark, f"{checkpoint_dir(spark)}/bands-{uuid.uuid4().hex}", ["session"])
    e = read(spark, d, "embeddings").select(F.col("label").alias("session"), "vec_id", "embedding")
    sessions = e.select("session").distinct().withColumn("low", F.lit(8.0)).withColumn("high", F.lit(14.0))
    moved = sessions.withColumn("low", F.when(F.col("session") < 5, 8.0).otherwise(10.0)).withColumn("high", F.when(F.col("session") < 5, 14.0).otherwise(20.0))

    def compute(todo: DataFrame) -> DataFrame:
        parts = [signals.band_pass(e.join(todo.where((F.col("low") == lo) & (F.col("high") == hi)), "session"), "embedding", "filtered", lo, hi, BAND[2]) for lo, hi in todo.select("low", "high").distinct().collect()]
        return validate.union(*parts).select("session", "vec_id", F.round(signals.log_variance("filtered"), 6).alias("logvar"))

    cache.rows(sessions, ["low", "high"], compute)
    rows = cache.rows(moved, ["low", "high"], compute).groupBy("session").agg(F.count("*").alias("trials"), (F.round(F.avg("logvar"), 5) + 0.0).alias("logvar"))
    return cut(rows.join(moved.select("session", "low"), "session").join(cache.computed().select("session", "times"), "session").select(F.col("session").cast("int").alias("session"), "low", "trials", "logvar", "times"))


@query(
    """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) AS BIT) AS VARCHAR)) AS b FROM embeddings),
h AS (SELECT vec_id, array_to_string(list_transform(b, lambda s: array_to_string(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda k: s[8 * k + 1 : 8 * k + 8]), '')), '') AS s FROM b)
SELECT vec_id, sha256(CAST(CAST(s AS BIT) AS BLOB)) AS digest FROM h"""
)
def vector_hashes(spark: SparkSession, d: str) -> DataFrame:
    """the hash of each vector's little-endian doubles."""
    from .functions.hashing import matrix_sha256

    return read(spark, d, "embeddings").select("vec_id", matrix_sha256(F.col("embedding")).alias("digest"))


DOCUMENT_SQL = "to_json({'key': o_orderkey, 'total': o_totalprice, 'customer': {'id': o_custkey, 'tags': [o_orderstatus, CAST(NULL AS VARCHAR)]}, 'lines': [{'n': 1, 'x': o_orderkey % 7 = 0}, {'n': 2, 'x': false}], 'none': []})"


@query(
    f"""WITH d AS (SELECT o_orderkey, {DOCUMENT_SQL} AS doc FROM orders),
t AS (SELECT o_orderkey, j.fullkey AS path, j.type AS type, j.atom AS atom FROM d, json_tree(d.doc) AS j)
SELECT o_orderkey % 16 AS part, path, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'NULL' THEN 'null' ELSE lower(type) END AS kind,
  count(*) AS n, round(sum(CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(atom AS DOUBLE) END), 2) + 0.0 AS total, count(*) FILTER (type = 'BOOLEAN' AND CAST(atom AS VARCHAR) = 'true') AS yes
FROM t WHERE type NOT IN ('OBJECT', 'ARRAY') OR (type = 'ARRAY' AND path LIKE '%none') GROUP BY ALL"""
)
def document_paths(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents as rows of path and value."""
    from .operators.documents import flattened

    line = lambda n, x: F.struct(F.lit(n).alias("n"), x.alias("x"))
    doc = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"), F.struct(F.col("o_custkey").alias("id"), F.array("o_orderstatus", F.lit(None).cast("string")).alias("tags")).alias("customer"), F.array(line(1, F.col("o_orderkey") % 7 == 0), line(2, F.lit(False))).alias("lines"), F.array().cast("array<int>").alias("none"))
    f = flattened(read(spark, d, "orders").select("o_orderkey", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc")), ["o_orderkey"], "doc")
    number = F.when(F.col("kind") == "number", F.col("value").cast("double"))
    return f.groupBy(F.pmod("o_orderkey", F.lit(16)).alias("part"), "path", "kind").agg(F.count("*").alias("n"), (F.round(F.sum(number), 2) + 0.0).alias("total"), F.count_if((F.col("kind") == "boolean") & (F.col("value") == "true")).alias("yes"))


RULE_ROWS = [("lineitem", "l_quantity", "between", 1.0, 50.0), ("lineitem", "l_discount", "at most", None, 0.05), ("lineitem", "l_quantity", "whole", None, None), ("lineitem", "l_tax", "mean between", 0.0, 0.01), ("orders", "o_totalprice", "at least", 1000.0, None), ("orders", "o_totalprice", "finite", None, None), ("orders", "o_orderkey", "rows between", 1.0, 1e12), ("events", "nowhere", "not null", None, None)]


@query(
    """SELECT 'lineitem' AS "table", 'l_quantity' AS "column", 'between' AS rule, count(*) AS checked, count(*) FILTER (NOT coalesce(l_quantity BETWEEN 1 AND 50, false)) AS broken, CAST(NULL AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'lineitem', 'l_discount', 'at most', count(*), count(*) FILTER (NOT coalesce(l_discount <= 0.05, false)), NULL FROM lineitem
UNION ALL SELECT 'lineitem', 'l_quantity', 'whole', count(*), count(*) FILTER (NOT coalesce(abs(l_quantity - round_even(l_quantity, 0)) <= 1e-9, false)), NULL FROM lineitem
UNION ALL SELECT 'lineitem', 'l_tax', 'mean between', count(*), CAST(NOT (avg(l_tax) BETWEEN 0 AND 0.01) AS BIGINT), round(avg(l_tax), 6) FROM lineitem
UNION ALL SELECT 'orders', 'o_totalprice', 'at least', count(*), count(*) FILTER (NOT coalesce(o_totalprice >= 1000, false)), NULL FROM orders
UNION ALL SELECT 'orders', 'o_totalprice', 'finite', count(*), count(*) FILTER (o_totalprice IS NULL OR NOT isfinite(o_totalprice)), NULL FROM orders
UNION ALL SELECT 'orders', 'o_orderkey', 'rows between', count(*), CAST(NOT (count(*) BETWEEN 1 AND 1e12) AS BIGINT), count(*) FROM orders
UNION ALL SELECT 'events', 'nowhere', 'not null', 0, 1, NULL"""
)
def rule_checks(spark: SparkSession, d: str) -> DataFrame:
    """A table of rules over several tables, each scanned once."""
    rules = spark.createDataFrame(RULE_ROWS, "table string, column string, rule string, lo double, hi double")
    found = validate.by_rules({t: read(spark, d, t) for t in ("lineitem", "orders", "events")}, rules)
    return found.withColumn("value", F.round("value", 6))


@query(
    """WITH s AS (SELECT CASE WHEN c_custkey < 700 THEN 'GR' ELSE 'PAR' END AS grp, c_nationkey AS subject, c_acctbal / 1000 - 4.5 AS x FROM customer),
m AS (SELECT grp, subject, avg(x) AS x, count(*) AS trials FROM s GROUP BY ALL)
SELECT grp, count(*) AS subjects, CAST(sum(trials) AS BIGINT) AS trials, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS sd, round(min(x), 6) + 0.0 AS low, round(median(x), 6) + 0.0 AS middle, round(max(x), 6) + 0.0 AS high, round(avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS below FROM m GROUP BY grp"""
)
def group_descriptive(spark: SparkSession, d: str) -> DataFrame:
    """Two groups of subjects described by their subjects' means, each subject counting once."""
    s = read(spark, d, "customer").select(F.when(F.col("c_custkey") < 700, "GR").otherwise("PAR").alias("grp"), F.col("c_nationkey").alias("subject"), (F.col("c_acctbal") / 1000 - 4.5).alias("x"))
    m = s.groupBy("grp", "subject").agg(F.avg("x").alias("x"), F.count("*").alias("trials"))
    r = lambda c, n: (F.round(c, 6) + 0.0).alias(n)
    return m.groupBy("grp").agg(F.count("*").alias("subjects"), F.sum("trials").alias("trials"), r(F.avg("x"), "mean"), r(F.stddev_samp("x"), "sd"), r(F.min("x"), "low"), r(F.median("x"), "middle"), r(F.max("x"), "high"), r(F.avg((F.col("x") < 0).cast("double")), "below"))


@query(
    """SELECT n_regionkey AS grp, CAST(m AS DOUBLE) AS margin, count(*) AS n, CASE WHEN n_regionkey - 2 + m * 1000 > 0 THEN 0.0 WHEN n_regionkey - 2 + m * 1000 < 0 THEN 1.0 ELSE 0.5 END AS p_t, n_regionkey - 2 > -m * 1000 AS noninferior
FROM nation, (SELECT unnest([0.001, 0.002]) AS m) GROUP BY n_regionkey, m"""
)
def no_spread(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose differences are all alike have no standard error; the p-value is 0, 1, or 0.5 on the margin."""
    diffs = read(spark, d, "nation").select(F.col("n_regionkey").alias("grp"), ((F.col("n_regionkey") - 2) / 1000).alias("diff"))
    return inference.noninferiority(diffs, [0.001, 0.002], ["grp"]).select("grp", "margin", "n", "p_t", "noninferior")
