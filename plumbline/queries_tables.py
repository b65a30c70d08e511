"""Relational queries: summaries, joins, windows, sets, inference, events, validation. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import matrices, sets, student
from .operators import evaluate, events, inference, roles, validate

SQL: dict[str, str] = {}
QUERIES: dict = {}


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


# Scores: nation of the supplier is the subject, region the dataset, return flag the method, ship year the split; the score is a mean discount.
METHODS = ["A", "N", "R"]


def scores(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    s = read(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("subject"), F.col("r_name").alias("dataset"))
    line = read(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("split"), F.col("l_returnflag").alias("method"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("size"))
    return line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("dataset", "subject", "split", "method").agg(F.avg("score").alias("score"), F.avg("size").alias("size"), F.count("*").alias("trials"))


SC = """sc AS (SELECT r_name AS dataset, n_name AS subject, CAST(year(l_shipdate) AS INTEGER) AS split, l_returnflag AS method, avg(l_discount) AS score, avg(l_quantity) AS size, count(*) AS trials
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


@query(f"WITH {SC}, a AS (SELECT dataset, subject, method, avg(score) AS score, avg(size) AS size FROM sc GROUP BY ALL) SELECT dataset, method, round(avg(score), 6) + 0.0 AS score, round(avg(size), 6) + 0.0 AS size FROM a GROUP BY ALL")
def nested_means(spark: SparkSession, d: str) -> DataFrame:
    """A4: splits, then subjects, which weigh the same."""
    m = inference.nested_mean(scores(spark, d), [["dataset", "subject", "method"], ["dataset", "method"]], ["score", "size"])
    return m.select("dataset", "method", *r6("score", "size"))


@query(f"WITH {SC}, a AS (SELECT dataset, subject, method, split, avg(score) AS s FROM sc GROUP BY ALL), b AS (SELECT dataset, subject, method, avg(s) AS s FROM a GROUP BY ALL), c AS (SELECT dataset, method, avg(s) AS s FROM b GROUP BY ALL) SELECT method, round(avg(s), 6) + 0.0 AS score FROM c GROUP BY ALL")
def three_level_means(spark: SparkSession, d: str) -> DataFrame:
    """A5."""
    return inference.nested_mean(scores(spark, d), [["dataset", "subject", "method", "split"], ["dataset", "subject", "method"], ["dataset", "method"], ["method"]], ["score"]).select("method", *r6("score"))


@query(
    f"WITH {SC}, a AS (SELECT dataset, subject, method, avg(score) AS score FROM sc GROUP BY ALL), v AS (SELECT *, score - max(CASE WHEN method = 'A' THEN score END) OVER (PARTITION BY dataset, subject) AS diff FROM a) "
    "SELECT dataset, method, count(DISTINCT subject) AS subjects, round(avg(diff), 6) + 0.0 AS mean_diff, round(avg(CASE WHEN diff < 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS below_rate, count(*) FILTER (diff > 0) AS above FROM v GROUP BY ALL"
)
def versus_reference(spark: SparkSession, d: str) -> DataFrame:
    """Differences to a reference method by a window, strict rates and counts."""
    m = inference.versus(inference.nested_mean(scores(spark, d), [["dataset", "subject", "method"]], ["score"]), ["dataset", "subject"], "A", "score")
    diff = F.col("score_diff")
    return m.groupBy("dataset", "method").agg(F.count_distinct("subject").alias("subjects"), F.round(F.avg(diff), 6).alias("mean_diff"), F.round(F.avg((diff < 0).cast("double")), 6).alias("below_rate"), F.count_if(diff > 0).alias("above"))


@query(f"WITH {SC} SELECT method, round(avg(score), 6) + 0.0 AS mean_score, round(stddev_samp(score), 6) + 0.0 AS sd_score, count(DISTINCT subject) AS subjects, count(*) AS \"rows\", CAST(sum(trials) AS BIGINT) AS trials, min(size) AS min_size FROM sc GROUP BY ALL")
def method_summary(spark: SparkSession, d: str) -> DataFrame:
    """A1, A3, A13."""
    return scores(spark, d).groupBy("method").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.stddev_samp("score"), 6).alias("sd_score"), F.count_distinct("subject").alias("subjects"), F.count("*").alias("rows"), F.sum("trials").alias("trials"), F.min("size").alias("min_size"))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS quantity, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS std, min({c}) AS min, round(quantile_cont({c}, 0.5), 6) + 0.0 AS median, max({c}) AS max FROM lineitem" for c in NUM))
def five_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A row for each column."""
    x = inference.five_numbers(read(spark, d, "lineitem"), NUM)
    return x.select("quantity", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", F.round("median", 6).alias("median"), "max")


@query(f"WITH {SC}, a AS (SELECT dataset, method, avg(size) AS size FROM sc GROUP BY ALL) SELECT dataset, method, round(size / max(CASE WHEN method = 'N' THEN size END) OVER (PARTITION BY dataset), 6) + 0.0 AS ratio FROM a")
def ratio_to_reference(spark: SparkSession, d: str) -> DataFrame:
    """A10: a ratio of means."""
    m = scores(spark, d).groupBy("dataset", "method").agg(F.avg("size").alias("size"))
    base = F.max(F.when(F.col("method") == "N", F.col("size"))).over(Window.partitionBy("dataset"))
    return m.select("dataset", "method", F.round(F.col("size") / base, 6).alias("ratio"))


@query(
    "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), top AS (SELECT user_id, arg_min(event_type, (-n, event_type)) AS choice FROM n GROUP BY ALL), g AS (SELECT user_id % 3 AS grp, choice, count(*) AS count FROM top JOIN (SELECT DISTINCT user_id FROM events) USING (user_id) GROUP BY ALL), "
    "f AS (SELECT *, CAST(sum(count) OVER (PARTITION BY grp) AS BIGINT) AS total, count / sum(count) OVER (PARTITION BY grp) AS p FROM g) SELECT grp, choice, count, total, round(p, 6) + 0.0 AS frequency, round(sum(-p * ln(p)) OVER (PARTITION BY grp), 6) + 0.0 AS entropy FROM f"
)
def choice_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Each user's most frequent event type (ties: the first by name), its frequency and the entropy of choices."""
    n = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = n.groupBy("user_id").agg(F.min_by("event_type", F.struct((-F.col("n")).alias("m"), "event_type")).alias("choice"))
    x = inference.choice_entropy(top.withColumn("grp", F.pmod("user_id", F.lit(3))), ["grp"], "choice")
    return x.select("grp", "choice", "count", "total", *r6("frequency", "entropy"))


@query(f"WITH {SC}, a AS (SELECT dataset, subject, method, avg(score) AS v FROM sc GROUP BY ALL) SELECT dataset, subject, {', '.join(f'''round(max(CASE WHEN method = '{m}' THEN v END), 6) + 0.0 AS "{m}"''' for m in METHODS)} FROM a GROUP BY dataset, subject")
def pivot_methods(spark: SparkSession, d: str) -> DataFrame:
    """P13."""
    w = inference.to_wide(inference.nested_mean(scores(spark, d), [["dataset", "subject", "method"]], ["score"]), ["dataset", "subject"], "method", METHODS, "score")
    return w.select("dataset", "subject", *r6(*METHODS))


T975 = ", ".join(f"({n}, {student.t_ppf(0.975, n)!r}, {student.t_ppf(0.95, n)!r})" for n in range(1, 40))
WIDE = f"{SC}, a AS (SELECT dataset, subject, method, avg(score) AS score, avg(size) AS size FROM sc GROUP BY ALL), tq AS (SELECT * FROM (VALUES {T975}) v(df, t975, t95))"


@query(
    f"WITH {WIDE}, p AS (SELECT a.method AS method_a, z.method AS method_b, a.score - z.score AS d FROM a JOIN a z ON a.dataset = z.dataset AND a.subject = z.subject AND a.method < z.method), "
    "s AS (SELECT method_a, method_b, count(*) AS subjects, avg(d) AS mean, stddev_samp(d) AS sd FROM p GROUP BY ALL) "
    "SELECT method_a, method_b, subjects, round(mean, 8) + 0.0 AS mean, round(sd, 8) + 0.0 AS sd, round(sd / sqrt(subjects), 8) + 0.0 AS se, round(mean - t975 * sd / sqrt(subjects), 8) + 0.0 AS ci_lower, round(mean + t975 * sd / sqrt(subjects), 8) + 0.0 AS ci_upper FROM s JOIN tq ON df = subjects - 1"
)
def paired_intervals(spark: SparkSession, d: str) -> DataFrame:
    """T intervals of paired differences for every pair of methods."""
    w = inference.to_wide(inference.nested_mean(scores(spark, d), [["dataset", "subject", "method"]], ["score"]), ["dataset", "subject"], "method", METHODS, "score")
    x = inference.paired_differences(w, METHODS, [])
    return x.select("method_a", "method_b", "subjects", *[(F.round(c, 8) + 0.0).alias(c) for c in ("mean", "sd", "se", "ci_lower", "ci_upper")])


MARGINS = [0.0005, 0.001, 0.002]


@query(
    f"WITH {WIDE}, p AS (SELECT a.score - z.score AS d FROM a JOIN a z ON a.dataset = z.dataset AND a.subject = z.subject AND a.method = 'R' AND z.method = 'A'), "
    "s AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS se FROM p), m AS (SELECT unnest([0.0005, 0.001, 0.002]) AS margin) "
    "SELECT CAST(margin AS DOUBLE) AS margin, n, round(mean, 8) + 0.0 AS mean, round(se, 8) + 0.0 AS se, round(mean - t95 * se, 8) + 0.0 AS lcb, mean - t95 * se > -margin AS noninferior, round((SELECT avg(CASE WHEN d >= -margin THEN 1.0 ELSE 0.0 END) FROM p), 6) + 0.0 AS within FROM s JOIN tq ON df = n - 1, m"
)
def noninferiority(spark: SparkSession, d: str) -> DataFrame:
    """E8, E9 (the p-values are held against known ones in tests)."""
    w = inference.to_wide(inference.nested_mean(scores(spark, d), [["dataset", "subject", "method"]], ["score"]), ["dataset", "subject"], "method", METHODS, "score")
    x = inference.noninferiority(w.select(F.lit(1).alias("one"), (F.col("R") - F.col("A")).alias("diff")), MARGINS, ["one"])
    return x.select("margin", "n", *[(F.round(c, 8) + 0.0).alias(c) for c in ("mean", "se", "lcb")], "noninferior", F.round("within", 6).alias("within"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE r <= 3")
def top_lines(spark: SparkSession, d: str) -> DataFrame:
    """Three dearest lines of each supplier; Spark limits each group before the shuffle."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    cols = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    return read(spark, d, "lineitem").select(*cols, "l_extendedprice", "l_quantity").withColumn("r", F.row_number().over(w)).where("r <= 3").select(*cols, "r")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def first_orders(spark: SparkSession, d: str) -> DataFrame:
    """T1, T3."""
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT source, label_code, count(*) AS n FROM (SELECT label AS source, dense_rank() OVER (PARTITION BY label ORDER BY vec_id % 3) - 1 AS label_code FROM embeddings) GROUP BY ALL")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """P14, A17."""
    e = read(spark, d, "embeddings").select(F.col("label").alias("source"), F.pmod("vec_id", F.lit(3)).alias("y"))
    return roles.label_codes(e, "y", "label_code", ["source"]).groupBy("source", "label_code").agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT user_id, CAST(dayofmonth(ts) AS INTEGER) % 4 AS wk, list_sort(list_distinct(list(event_type))) AS m FROM events GROUP BY ALL), p AS (SELECT a.user_id, a.m AS a, z.m AS b FROM s a JOIN s z ON a.user_id = z.user_id AND a.wk = 0 AND z.wk = 1) "
    "SELECT user_id, len(a) AS n_a, len(list_intersect(a, b)) AS both_, len(list_distinct(list_concat(a, b))) AS either_, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS only_b, "
    "len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS is_subset, a = b AS is_same, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) + 0.0 AS jaccard, array_to_string(a, ',') AS joined FROM p"
)
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """U1, U3 - U5, F16, F23."""
    s = read(spark, d, "events").groupBy("user_id", F.pmod(F.dayofmonth("ts"), F.lit(4)).alias("wk")).agg(F.array_sort(F.collect_set("event_type")).alias("m"))
    p = s.where("wk = 0").select("user_id", F.col("m").alias("a")).join(s.where("wk = 1").select("user_id", F.col("m").alias("b")), "user_id")
    size = lambda c, n: F.size(c).alias(n)
    return p.select("user_id", size("a", "n_a"), size(F.array_intersect("a", "b"), "both_"), size(F.array_union("a", "b"), "either_"), size(F.array_except("a", "b"), "only_a"), size(F.array_except("b", "a"), "only_b"), sets.subset("a", "b").alias("is_subset"), sets.same("a", "b").alias("is_same"), F.round(sets.jaccard("a", "b"), 6).alias("jaccard"), F.array_join("a", ",").alias("joined"))


SETS = "s AS (SELECT user_id % 5 AS grp, CAST(dayofmonth(ts) AS INTEGER) AS rep, list_distinct(list(user_id)) AS m FROM events WHERE event_type = 'click' OR event_type = 'purchase' GROUP BY ALL)"


@query(
    f"WITH {SETS}, p AS (SELECT a.grp, len(list_intersect(a.m, z.m)) / len(list_distinct(list_concat(a.m, z.m))) AS j, CASE WHEN list_sort(a.m) = list_sort(z.m) THEN 1.0 ELSE 0.0 END AS e FROM s a JOIN s z ON a.grp = z.grp AND a.rep < z.rep) "
    "SELECT o.grp, round(coalesce(j, 1), 6) + 0.0 AS mean_jaccard, round(coalesce(e, 1), 6) + 0.0 AS exact_rate, round(sd, 6) + 0.0 AS size_sd, rg AS size_range FROM (SELECT grp, stddev_samp(len(m)) AS sd, max(len(m)) - min(len(m)) AS rg FROM s GROUP BY ALL) o LEFT JOIN (SELECT grp, avg(j) AS j, avg(e) AS e FROM p GROUP BY ALL) USING (grp)"
)
def pairwise_stability(spark: SparkSession, d: str) -> DataFrame:
    """Daily sets of users compared pair by pair within a group."""
    s = read(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).groupBy(F.pmod("user_id", F.lit(5)).alias("grp"), F.dayofmonth("ts").alias("rep")).agg(F.collect_set("user_id").alias("members"))
    x = evaluate.pairwise_stability(s.withColumn("method", F.lit("m")), ["grp"], "rep")
    return x.select("grp", *r6("mean_jaccard", "exact_rate", "size_sd"), "size_range")


@query("SELECT event_type, user_id % 7 AS source, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS rate FROM events GROUP BY ALL")
def inclusion_rates(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    e = read(spark, d, "events").select("event_type", F.lit("m").alias("method"), F.pmod("user_id", F.lit(7)).alias("source"), (F.col("value") > 50).cast("int").alias("selected"))
    return evaluate.inclusion(e, ["event_type"]).select("event_type", "source", *r6("rate"))


@query("SELECT o_orderpriority, n, round(n / total, 6) + 0.0 AS share, c_mktsegment FROM (SELECT o_orderpriority, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) JOIN (SELECT c_mktsegment, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) USING (c_mktsegment)")
def joined_shares(spark: SparkSession, d: str) -> DataFrame:
    """Counts with their group's total, by a window over the counts instead of a second pass and join."""
    n = read(spark, d, "orders").join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment")), 6))


@query(
    "SELECT 'customer without order' AS side, c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'order without customer', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey)"
    " UNION ALL SELECT 'customer with order', c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
)
def key_differences(spark: SparkSession, d: str) -> DataFrame:
    """Anti joins both ways, and the semi join."""
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    side = lambda df, name, key: df.select(F.lit(name).alias("side"), F.col(key).alias("key"))
    return side(c.join(o, on, "left_anti"), "customer without order", "c_custkey").unionByName(side(o.join(c, on, "left_anti"), "order without customer", "o_orderkey")).unionByName(side(c.join(o, on, "left_semi"), "customer with order", "c_custkey"))


EV = "e AS (SELECT *, lag(event_type) OVER w AS pk, lag(event_id) OVER w AS pa, lead(event_type) OVER w AS nk, lead(event_id) OVER w AS na FROM events WHERE event_type IN ('view', 'click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
KINDS = ("view", "click", "purchase")


@query(f"WITH {EV} SELECT user_id, pa AS cue_at, event_id AS start_at, na AS end_at FROM e WHERE event_type = 'click' AND pk = 'view' AND nk = 'purchase'")
def event_segments(spark: SparkSession, d: str) -> DataFrame:
    """Cue, start, end in a row."""
    return events.segments(read(spark, d, "events"), "user_id", "event_id", "event_type", *KINDS)


@query(
    f"WITH {EV}, v AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' AND pk IN ('view', 'click') THEN 'cue before the last task ended' WHEN event_type = 'click' AND NOT coalesce(pk = 'view', false) THEN 'start without a cue' WHEN event_type IN ('view', 'click') AND nk IS NULL THEN 'unterminated' END AS reason FROM e) SELECT * FROM v WHERE reason IS NOT NULL"
)
def event_violations(spark: SparkSession, d: str) -> DataFrame:
    """W7, V11."""
    return events.violations(read(spark, d, "events"), "user_id", "event_id", "event_type", *KINDS)


@query(
    f"WITH {EV}, s AS (SELECT user_id, na - event_id AS dur FROM e WHERE event_type = 'click' AND pk = 'view' AND nk = 'purchase') SELECT user_id, count(*) AS total, count(*) FILTER (dur >= 50) AS retained, min(dur) FILTER (dur >= 50) AS min_duration FROM s GROUP BY ALL"
)
def session_inventory(spark: SparkSession, d: str) -> DataFrame:
    """P11, X4, X5."""
    s = event_segments(spark, d).withColumn("dur", F.col("end_at") - F.col("start_at"))
    return events.session_inventory(events.quality_ledger(s, "dur", 50), ["user_id"], "dur")


@query("SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS change FROM events QUALIFY change IS NOT NULL")
def lagged_change(spark: SparkSession, d: str) -> DataFrame:
    """J11."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, d, "events").select("user_id", "event_id", (F.col("value") - before).alias("change")).where("change is not null")


@query(
    "SELECT 'duplicate key' AS \"check\", count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'out of range', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0.01 AND 0.09) "
    "UNION ALL SELECT 'missing key', count(*) FROM (SELECT DISTINCT n_name FROM nation) a, (SELECT DISTINCT c_mktsegment FROM customer) b WHERE NOT EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = a.n_name AND c_mktsegment = b.c_mktsegment) HAVING count(*) > 0 "
    "UNION ALL SELECT 'not constant', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) <> 1)"
)
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each check finds."""
    line = read(spark, d, "lineitem")
    c = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment")
    found = validate.union(
        validate.unique(line, ["l_orderkey", "l_linenumber"]),
        validate.in_range(line, "l_discount", 0.01, 0.09, ["l_orderkey"]),
        validate.complete_grid(c, [read(spark, d, "nation").select("n_name").distinct(), c.select("c_mktsegment").distinct()]),
        validate.constant(line, ["l_orderkey"], "l_returnflag"),
        validate.finite(line, NUM, ["l_orderkey"]),
    )
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query(
    "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS k, sum(o_totalprice) * CASE WHEN o_custkey % 5 = 0 THEN 1.0001 ELSE 1 END AS v FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey) "
    "SELECT 'differs' AS \"check\", count(*) AS n FROM a JOIN b USING (k) WHERE abs(a.v - b.v) > 1e-11 + 1e-9 * abs(b.v) UNION ALL SELECT 'left only', count(*) FROM a WHERE k NOT IN (SELECT k FROM b)"
)
def table_differences(spark: SparkSession, d: str) -> DataFrame:
    """V3, V6: a table against a copy with changed values and lost keys."""
    o = read(spark, d, "orders")
    a = o.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    b = a.where("k % 7 <> 0").withColumn("v", F.col("v") * F.when(F.col("k") % 5 == 0, 1.0001).otherwise(1.0))
    return validate.tables_close(a, b, ["k"], ["v"]).groupBy("check").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT user_id, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY ALL) SELECT count(*) AS users, count(*) FILTER (abs(rate * n - round_even(rate * n, 0)) > 1e-9) AS broken, count(*) FILTER (abs(round(rate, 2) * n - round_even(round(rate, 2) * n, 0)) > 1e-9) AS rounded_broken FROM x")
def integral_rates(spark: SparkSession, d: str) -> DataFrame:
    """V5."""
    x = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("value") > 50).cast("double")).alias("rate")).withColumn("low", F.round("rate", 2))
    broken = lambda c, n: validate.integral_rates(x, c, "n", ["user_id"]).agg(F.count("*").alias(n))
    return x.agg(F.count("*").alias("users")).crossJoin(broken("rate", "broken")).crossJoin(broken("low", "rounded_broken"))


@query(
    "SELECT event_id, json_extract_string(props, '$.page') AS page, regexp_extract(event_type, '([a-z])[a-z]*$', 1) AS letter, upper(trim(event_type)) AS up, sha256(CAST(event_id AS VARCHAR)) AS sha, TRY_CAST(event_type AS BOOLEAN) AS flag, round_even(value / 10, 0) AS even, printf('%.2f', value) AS told FROM events"
)
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Strings, regular expressions, JSON, hashes, booleans, half-even rounding, formats."""
    e = read(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.regexp_extract("event_type", "([a-z])[a-z]*$", 1).alias("letter"), F.upper(F.trim("event_type")).alias("up"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha"), F.col("event_type").try_cast("boolean").alias("flag"), F.bround(F.col("value") / 10).alias("even"), F.printf(F.lit("%.2f"), "value").alias("told"))


@query("SELECT l_suppkey, round(ln(var_pop(l_quantity) + 1e-12), 6) + 0.0 AS logvar, round((avg(l_quantity) - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) + 0.0 AS z FROM lineitem GROUP BY l_suppkey")
def log_variance(spark: SparkSession, d: str) -> DataFrame:
    """F14, F15's z-score."""
    line = read(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    m = line.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return line.groupBy("l_suppkey").agg(F.var_pop("l_quantity").alias("v"), F.avg("l_quantity").alias("a")).crossJoin(F.broadcast(m)).select("l_suppkey", F.round(F.ln(F.col("v") + 1e-12), 6).alias("logvar"), F.round((F.col("a") - F.col("m")) / F.col("s"), 6).alias("z"))


@query(
    "WITH s AS (SELECT user_id % 9 AS subject, event_type AS method, dayofmonth(ts) % 3 AS rep, avg(value) AS t FROM events GROUP BY ALL), m AS (SELECT subject, method, quantile_cont(t, 0.5) AS t FROM s GROUP BY ALL), a AS (SELECT method, avg(t) AS t FROM m GROUP BY ALL) "
    "SELECT method, round(t, 6) + 0.0 AS mean_median, round(t / (SELECT t FROM a WHERE method = (SELECT min(method) FROM a)), 6) + 0.0 AS ratio FROM a"
)
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Median of repetitions, mean of the subjects' medians, ratio of means to the first method."""
    s = read(spark, d, "events").groupBy(F.pmod("user_id", F.lit(9)).alias("subject"), F.col("event_type").alias("method"), F.pmod(F.dayofmonth("ts"), F.lit(3)).alias("rep")).agg(F.avg("value").alias("t"))
    a = s.groupBy("subject", "method").agg(F.percentile("t", F.lit(0.5)).alias("t")).groupBy("method").agg(F.avg("t").alias("t"))
    first = F.first("t").over(Window.orderBy("method").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row for each method
    return a.select("method", F.round("t", 6).alias("mean_median"), F.round(F.col("t") / first, 6).alias("ratio"))


@query(
    f"WITH {SC}, m AS (SELECT dataset, subject, method, avg(score) AS score FROM sc GROUP BY ALL), t AS (SELECT dataset, subject, score AS target FROM m WHERE method = 'N') "
    "SELECT dataset, method, count(*) AS subjects, round(avg(score - target), 6) + 0.0 AS mean_diff, round(avg(CASE WHEN score - target < 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS below_rate, count(*) FILTER (score > target) AS above FROM m JOIN t USING (dataset, subject) WHERE method <> 'N' GROUP BY ALL"
    " UNION ALL SELECT dataset, 'target_only', count(*), 0.0, 0.0, 0 FROM t GROUP BY ALL"
)
def target_only_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Methods against the target-only score, and that score's own rows."""
    m = inference.nested_mean(scores(spark, d), [["dataset", "subject", "method"]], ["score"])
    t = m.where("method = 'N'").select("dataset", "subject", F.col("score").alias("target"))
    diff = F.col("score") - F.col("target")
    a = m.where("method <> 'N'").join(t, ["dataset", "subject"]).groupBy("dataset", "method").agg(F.count("*").alias("subjects"), F.round(F.avg(diff), 6).alias("mean_diff"), F.round(F.avg((diff < 0).cast("double")), 6).alias("below_rate"), F.count_if(diff > 0).alias("above"))
    return a.unionByName(t.groupBy("dataset").agg(F.count("*").alias("subjects")).select("dataset", F.lit("target_only").alias("method"), "subjects", F.lit(0.0).alias("mean_diff"), F.lit(0.0).alias("below_rate"), F.lit(0).cast("long").alias("above")))


@query(
    f"WITH {WIDE}, c AS (SELECT dataset, count(DISTINCT subject) AS candidates, count(DISTINCT subject) FILTER (method = 'A' AND size > 25) AS retained FROM a GROUP BY ALL), p AS (SELECT a.dataset, a.score - z.score AS d FROM a JOIN a z ON a.dataset = z.dataset AND a.subject = z.subject AND a.method = 'R' AND z.method = 'A'), "
    "s AS (SELECT dataset, count(*) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM p GROUP BY ALL) SELECT dataset, candidates, retained, round(retained / candidates, 6) + 0.0 AS fraction, round(m, 8) + 0.0 AS mean_difference, round(m - t975 * se, 8) + 0.0 AS ci95_low, round(m + t975 * se, 8) + 0.0 AS ci95_high, CASE WHEN m - t95 * se > -0.002 THEN 'established' ELSE 'not established' END AS status FROM c JOIN s USING (dataset) LEFT JOIN tq ON df = n - 1"
)
def overview(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, retained share, interval and status by dataset."""
    a = inference.nested_mean(scores(spark, d), [["dataset", "subject", "method"]], ["score", "size"])
    c = a.groupBy("dataset").agg(F.count_distinct("subject").alias("candidates"), F.count_distinct(F.when((F.col("method") == "A") & (F.col("size") > 25), F.col("subject"))).alias("retained"))
    w = inference.to_wide(a, ["dataset", "subject"], "method", METHODS, "score")
    p = inference.paired_differences(w.select("dataset", "R", "A"), ["R", "A"], ["dataset"])
    q = p.withColumn("lcb", F.col("mean") - student.t_quantile(F.lit(0.95), F.col("subjects") - 1) * F.col("se"))
    r8 = lambda c, n: (F.round(c, 8) + 0.0).alias(n)
    return c.join(q, "dataset").select("dataset", "candidates", "retained", F.round(F.col("retained") / F.col("candidates"), 6).alias("fraction"), r8("mean", "mean_difference"), r8("ci_lower", "ci95_low"), r8("ci_upper", "ci95_high"), F.when(F.col("lcb") > -0.002, "established").otherwise("not established").alias("status"))


@query(
    "WITH v AS (SELECT vec_id, embedding AS e FROM embeddings), c AS (SELECT vec_id, list_transform([e[1:32], e[33:64]], lambda a: list_transform(a, lambda x: CAST(x AS DOUBLE) - list_avg(list_transform(a, lambda y: CAST(y AS DOUBLE))))) AS z FROM v), "
    "m AS (SELECT vec_id, list_dot_product(z[1], z[1]) / 31 AS a, list_dot_product(z[1], z[2]) / 31 AS b, list_dot_product(z[2], z[2]) / 31 AS d FROM c) SELECT vec_id, round(a, 9) + 0.0 AS a, round(b, 9) + 0.0 AS b, round(d, 9) + 0.0 AS d, round(a + d, 9) + 0.0 AS tr, round(0.95 * a + 0.05 * (a + d) / 2, 9) + 0.0 AS shrunk_a FROM m"
)
def trial_covariances(spark: SparkSession, d: str) -> DataFrame:
    """each vector's 64 values as two channels of 32 samples."""
    ch = F.transform(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), lambda a: F.transform(a, lambda x: x.cast("double")))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 32
    dot = lambda i, k: F.aggregate(F.zip_with(F.col("z")[i], F.col("z")[k], lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x) / 31
    z = read(spark, d, "embeddings").select("vec_id", F.transform(ch, lambda a: F.transform(a, lambda x: x - mean(a))).alias("z"))
    m = z.select("vec_id", F.array(dot(0, 0), dot(0, 1), dot(1, 0), dot(1, 1)).alias("c"))
    c = F.col("c")
    return m.select("vec_id", *[(F.round(x, 9) + 0.0).alias(n) for x, n in ((c[0], "a"), (c[1], "b"), (c[3], "d"), (matrices.trace(c, 2), "tr"), (matrices.shrink(c, 0.05, 2)[0], "shrunk_a"))])


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey >= 10 THEN c_custkey + 1 ELSE c_custkey END AS remapped, CASE WHEN c_custkey < 700 THEN 'GR' ELSE 'PAR' END AS grp, c_acctbal BETWEEN 0 AND 5000 AS mid FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey < 12")
def filtered_projection(spark: SparkSession, d: str) -> DataFrame:
    """Filters that reach the scan, two columns more than it returns."""
    c = read(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_nationkey") < 12))
    k = F.col("c_custkey")
    return c.select(k, "c_name", F.when(k >= 10, k + 1).otherwise(k).alias("remapped"), F.when(k < 700, "GR").otherwise("PAR").alias("grp"), F.col("c_acctbal").between(0, 5000).alias("mid"))


#: Up to five nations a region: survival of t with up to four degrees of freedom in closed forms, and ranks' sums over all 2^n signs.
RANK_SQL = f"""WITH {WIDE}, p AS (SELECT a.dataset, a.score - z.score + 0.001 AS y FROM a JOIN a z ON a.dataset = z.dataset AND a.subject = z.subject AND a.method = 'R' AND z.method = 'A'),
t AS (SELECT dataset, count(*) AS n, avg(y) AS up, avg(y) / (stddev_samp(y) / sqrt(count(*))) AS t FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY abs(y)) AS r FROM p WHERE y <> 0),
w AS (SELECT dataset, count(*) AS n, sum(CASE WHEN y > 0 THEN r ELSE 0 END) AS w FROM r GROUP BY ALL),
e AS (SELECT dataset, n, w, s, list_sum(list_transform(range(1, n + 1), lambda k: CASE WHEN (s >> (k - 1)) & 1 = 1 THEN k ELSE 0 END)) AS v FROM (SELECT *, unnest(range(1 << n)) AS s FROM (SELECT dataset, CAST(n AS INTEGER) AS n, w FROM w))),
x AS (SELECT dataset, avg(CASE WHEN v >= w THEN 1.0 ELSE 0.0 END) AS p_wilcoxon FROM e GROUP BY ALL)
SELECT dataset, round(CASE WHEN t IS NULL THEN CASE WHEN up > 0 THEN 0.0 WHEN up < 0 THEN 1.0 ELSE 0.5 END WHEN n = 2 THEN 0.5 - atan(t) / pi() WHEN n = 3 THEN 0.5 - t / (2 * sqrt(2 + t * t)) WHEN n = 4 THEN 0.5 - (atan(t / sqrt(3)) + t / sqrt(3) / (1 + t * t / 3)) / pi() WHEN n = 5 THEN 0.5 - 0.5 * (t / sqrt(4 + t * t)) * (1 + 2 / (4 + t * t)) END, 6) + 0.0 AS p_t, round(p_wilcoxon, 6) + 0.0 AS p_wilcoxon FROM t JOIN x USING (dataset)"""


@query(RANK_SQL)
def rank_tests(spark: SparkSession, d: str) -> DataFrame:
    """t and signed-rank p-values by region."""
    w = inference.to_wide(inference.nested_mean(scores(spark, d), [["dataset", "subject", "method"]], ["score"]), ["dataset", "subject"], "method", METHODS, "score")
    return inference.noninferiority(w.select("dataset", (F.col("R") - F.col("A")).alias("diff")), [0.001], ["dataset"]).select("dataset", *r6("p_t", "p_wilcoxon"))


@query()
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Path below the folder, bytes and hash of every table's files."""
    from .sources import files

    return files.manifest(spark, d, "*.parquet")
