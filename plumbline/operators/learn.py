"""Matrix screening and tangent-space classification: dense algebra in Arrow batches, sums that leave the tasks, pools of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spd
from ..lineage import cut, dropped
from . import resample


def stack(column: pd.Series, channels: int) -> np.ndarray:
    return np.stack(column.to_numpy()).reshape(-1, channels, channels)


def matrix_draws(trials: DataFrame, channels: int, replicates: int, seed: int, lam: float = 0.1, metric: str = "airm", shared: bool = True, block: int = 1) -> DataFrame:
    """(case_id, b, source, delta): count bootstrap of mean matrices, shrunk, against the target's (R2 - R5, F2 - F6); b = -1 holds the estimate.

    trials: case_id, source, is_target, i, cov (row-major). A leaf's draws are matrix products in one task, of a
    session of any size; distances are taken in batches over all replicates of all sources.
    """
    distance: Callable = spd.METRICS[metric]
    s, t = resample.vector_draws(trials, "cov", replicates, seed, shared, block)
    both = s.drop("n").join(t.drop("n").withColumnRenamed("cov", "_t"), ["case_id", "b"] if shared else ["case_id", "source", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (spd.shrink(stack(pdf[k], channels), lam) for k in ("cov", "_t"))
                yield pdf[["case_id", "b", "source"]].assign(delta=distance(a, b))

    kinds = {k: trials.schema[k].dataType.simpleString() for k in ("case_id", "source")}
    return both.mapInPandas(run, f"case_id {kinds['case_id']}, b int, source {kinds['source']}, delta double")


#: Bytes of sums that the tasks of one pass hold at once; more sets than fit go in slices, one after the other.
HELD = 64 << 20
#: Numbers of a sum in a row.
CHUNK = 4096


def by_set(batch: pa.RecordBatch, channels: int, rows: int = 512) -> Iterator[tuple[int, np.ndarray, list]]:
    """(set, matrices, labels) of a batch (sets, label, cov), some rows at a time; a row may be of several sets."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        cov = part.column("cov").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, channels, channels)
        label = part.column("label").to_pylist()
        row = np.repeat(np.arange(part.num_rows), np.asarray(part.column("sets").value_lengths()))
        of = part.column("sets").flatten().to_numpy()
        for s in np.unique(of):
            i = row[of == s]
            yield int(s), cov[i], [label[k] for k in i]


def added(rows: DataFrame, channels: int, work: Callable) -> DataFrame:
    """(set, label, chunk, n, part): sums over `rows` (sets, label, cov) of the vectors that work(set, matrices, labels) gives as (label, n, vector).

    A task adds up what it meets and tells each sum once, in chunks; a chunk's partial sums, one a task, are added together.
    """
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"set long, label {kind}, chunk int, n long, part array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        label = None
        for b in batches:
            label = b.schema.field("label").type
            for s, cov, y in by_set(b, channels):
                for key, n, v in work(s, cov, y):
                    own = total.setdefault((s, key), [0, np.zeros(len(v))])
                    own[0] += n
                    own[1] += v
        for (s, key), (n, v) in total.items():
            parts = [v[k : k + CHUNK] for k in range(0, len(v), CHUNK)]
            many = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([s] * many, pa.int64()), pa.array([key] * many, label), pa.array(range(many), pa.int32()), pa.array([n] * many, pa.int64()), pa.array(parts, pa.list_(pa.float64()))], names=["set", "label", "chunk", "n", "part"])

    def sum_up(group: pa.Table) -> pa.Table:
        v = np.array(group.column("part").to_pylist()).sum(0)
        key = {k: group.column(k).slice(0, 1) for k in ("set", "label", "chunk")}
        return pa.table(key | {"n": pa.array([sum(group.column("n").to_pylist())]), "part": pa.array([v], pa.list_(pa.float64()))})

    return rows.mapInArrow(run, schema).groupBy("set", "label", "chunk").applyInArrow(sum_up, schema)


def gathered(sums: DataFrame) -> dict[tuple, tuple[int, np.ndarray]]:
    """{(set, label): (n, vector)} of the sums of one slice, on the driver: HELD bytes at most."""
    out: dict[tuple, dict] = {}
    for r in sums.toArrow().to_pylist():
        out.setdefault((r["set"], r["label"]), {})[r["chunk"]] = r
    return {k: (c[0]["n"], np.concatenate([c[i]["part"] for i in range(len(c))])) for k, c in out.items()}


def sets_in_slices(rows: DataFrame, bytes_each: int) -> Iterator[DataFrame]:
    """`rows` with those of its sets that go together, as many as HELD allows, cut off by a checkpoint."""
    sets = rows.select(F.explode("sets").alias("s")).agg(F.count_distinct("s")).first()[0]
    slices = -(-sets * bytes_each // HELD)
    for k in range(slices):
        part = rows.withColumn("sets", F.filter("sets", lambda s: F.pmod(F.xxhash64(s), F.lit(slices)) == k)) if slices > 1 else rows
        yield cut(part.where(F.size("sets") > 0))


def tangent_models(rows: DataFrame, channels: int, lam: float = 0.05, rounds: int = 5) -> DataFrame:
    """(set, n_train, mean, classes, coef, intercept): M1's classifier of every set in `rows` (sets array<long>, label, cov), for pools of any size.

    A trial is a row with all sets it is learned for, never copied. The mean is a fixed number of rounds, each one pass with
    map-side sums of logarithms at the mean before; then one pass for the classes' means and deviations in the tangent space
    at it, and one for their second moments and the sum of squared square norms, which is all that the shrinkage needs. Last,
    each set's discriminants are solved from its moments, whose size is that of the features. One class only: no classes.
    """
    p = channels * (channels + 1) // 2
    found = []
    for part in sets_in_slices(rows, 16 * p * p):
        found.append(models_of(part, channels, p, lam, rounds))
        dropped(part)
    label = rows.schema["label"].dataType.simpleString()
    schema = f"set long, n_train long, mean array<double>, classes array<{label}>, coef array<double>, intercept array<double>"
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)


def models_of(rows: DataFrame, channels: int, p: int, lam: float, rounds: int) -> DataFrame:
    square = (channels, channels)
    send = rows.sparkSession.sparkContext.broadcast
    total = gathered(added(rows, channels, lambda s, a, y: [(None, len(a), spd.shrink(a, lam).sum(0).ravel())]))
    many = {s: n for (s, _), (n, _) in total.items()}
    means = {s: (v / n).reshape(square) for (s, _), (n, v) in total.items()}
    for _ in range(rounds):
        held = send({s: spd.powered(m, lambda x: x**-0.5) for s, m in means.items()})

        def logs(s: int, a: np.ndarray, y: list, held=held) -> list:
            back = held.value[s]
            return [(None, len(a), spd.log_spd(back @ spd.shrink(a, lam) @ back).sum(0).ravel())]

        for (s, _), (n, v) in gathered(added(rows, channels, logs)).items():
            half = spd.powered(means[s], np.sqrt)
            means[s] = half @ spd.exp_sym((v / n).reshape(square)) @ half
        held.unpersist()
    at = send(means)

    def of_classes(work: Callable) -> Callable:
        def run(s: int, a: np.ndarray, y: list) -> list:
            x = spd.tangent(spd.shrink(a, lam), at.value[s])
            return [(c, len(i), work(x[i], s, c)) for c in dict.fromkeys(y) for i in [[k for k, z in enumerate(y) if z == c]]]

        return run

    first = gathered(added(rows, channels, of_classes(lambda x, s, c: np.concatenate([x.sum(0), (x**2).sum(0)]))))
    known = {}
    for key, (n, v) in first.items():
        mean = v[:p] / n
        scale = np.sqrt(np.maximum(v[p:] / n - mean**2, 0))
        known[key] = n, mean, np.where(scale > 0, scale, 1)
    classes = send(known)
    upper = np.triu_indices(p)

    def moments(x: np.ndarray, s: int, c) -> np.ndarray:
        _, mean, scale = classes.value[s, c]
        z = (x - mean) / scale
        return np.append((z.T @ z)[upper], ((z**2).sum(1) ** 2).sum())

    def solved(group: pa.Table) -> pa.Table:
        s = group.column("set")[0].as_py()
        parts: dict = {}
        for r in group.to_pylist():
            parts.setdefault(r["label"], {})[r["chunk"]] = r["part"]
        names = sorted(parts)
        n = sum(classes.value[s, c][0] for c in names)
        cov, prior = np.zeros((p, p)), []
        for c in names:
            v = np.concatenate([parts[c][k] for k in range(len(parts[c]))])
            k, _, scale = classes.value[s, c]
            second = np.zeros((p, p))
            second[upper] = v[:-1]
            second += np.triu(second, 1).T
            prior.append(k / n)
            cov += k / n * spd.shrunk(second / k, v[-1] / k, k) * np.outer(scale, scale)
        m = np.stack([classes.value[s, c][1] for c in names])
        coef, intercept = spd.discriminants(cov, m, np.array(prior)) if len(names) > 1 else (np.zeros((0, p)), np.zeros(0))
        row = {"set": pa.array([s]), "n_train": pa.array([n]), "mean": pa.array([at.value[s].ravel()], pa.list_(pa.float64())), "classes": pa.array([names if len(names) > 1 else []], pa.list_(group.schema.field("label").type))}
        return pa.table(row | {"coef": pa.array([coef.ravel()], pa.list_(pa.float64())), "intercept": pa.array([intercept], pa.list_(pa.float64()))})

    second = added(rows, channels, of_classes(moments))
    label = rows.schema["label"].dataType.simpleString()
    return cut(second.groupBy("set").applyInArrow(solved, f"set long, n_train long, mean array<double>, classes array<{label}>, coef array<double>, intercept array<double>"))


def tangent_scores(rows: DataFrame, models: DataFrame, channels: int, lam: float = 0.05) -> DataFrame:
    """(set, n_train, n_test, balanced_accuracy) of the models on `rows` (sets, label, cov), in batches; null for models without classes.

    Models go to the tasks in slices of HELD bytes; only counts of hits leave them.
    """
    p = channels * (channels + 1) // 2
    out = []
    for part in sets_in_slices(rows, 8 * (channels * channels + 4 * p)):
        own = models.join(part.select(F.explode("sets").alias("set")).distinct(), "set")
        held = rows.sparkSession.sparkContext.broadcast({r["set"]: (np.array(r["mean"]).reshape(channels, channels), r["classes"], np.array(r["coef"]).reshape(-1, p), np.array(r["intercept"])) for r in own.toArrow().to_pylist()})

        def hits(s: int, a: np.ndarray, y: list, held=held) -> list:
            mean, classes, coef, intercept = held.value.get(s, (None, [], None, None))
            if not classes:
                return [(c, y.count(c), np.zeros(1)) for c in dict.fromkeys(y)]
            said = [classes[k] for k in (spd.tangent(spd.shrink(a, lam), mean) @ coef.T + intercept).argmax(1)]
            return [(c, y.count(c), np.array([float(sum(x == z == c for x, z in zip(said, y, strict=True)))])) for c in dict.fromkeys(y)]

        out.append(cut(added(part, channels, hits)))
        dropped(part)
    if not out:
        return models.select("set", "n_train", F.lit(0).cast("long").alias("n_test"), F.lit(None).cast("double").alias("balanced_accuracy"))
    found = reduce(DataFrame.unionByName, out).groupBy("set").agg(F.sum("n").alias("n_test"), F.avg(F.get("part", F.lit(0)) / F.col("n")).alias("_a"))
    both = models.select("set", "n_train", F.size("classes").alias("_c")).join(found, "set", "full")
    return both.select("set", F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_test", F.lit(0)).alias("n_test"), F.when(F.col("_c") > 1, F.col("_a")).alias("balanced_accuracy"))


class ModelStore:
    """Fitted classifiers under `home`, addressed by what they were fitted to: trials, labels and parameters (M2). Read by later queries and runs."""

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")

    def stored(self) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/_SUCCESS")
        return self.spark.read.parquet(self.home) if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None

    def models(self, rows: DataFrame, channels: int, lam: float = 0.05, rounds: int = 5) -> DataFrame:
        """tangent_models of `rows`, of which only sets that were never fitted before are fitted; sets with the same trials once."""
        keys = cut(contents(rows, channels, lam, rounds))
        known = self.stored()
        have = known.select("content") if known is not None else keys.select("content").limit(0)
        new = cut(keys.join(have, "content", "left_anti").groupBy("content").agg(F.min("set").alias("set")))
        if not new.isEmpty():
            own = rows.withColumn("_k", F.explode("sets")).join(new.select(F.col("set").alias("_k")), "_k").select(F.array("_k").alias("sets"), "label", "cov")
            fitted = tangent_models(own, channels, lam, rounds).join(new, "set").drop("set")
            fitted.withColumn("fitted_at", F.current_timestamp()).write.mode("append").parquet(self.home)
        known = self.stored()
        return keys.join(known.dropDuplicates(["content"]).drop("fitted_at"), "content").drop("content") if known is not None else tangent_models(rows.limit(0), channels, lam, rounds)


def contents(rows: DataFrame, channels: int, lam: float, rounds: int) -> DataFrame:
    """(set, content): a digest of a set's trials and labels, whatever their order, and of the parameters."""
    wide = lambda k: F.sum(F.xxhash64(F.lit(k), "label", "cov").cast("decimal(20,0)"))
    d = rows.select(F.explode("sets").alias("set"), "label", "cov").groupBy("set").agg(F.count("*").alias("_n"), wide(1).alias("_a"), wide(2).alias("_b"))
    return d.select("set", F.sha2(F.concat_ws("|", F.lit(f"{channels}|{lam}|{rounds}"), "_n", "_a", "_b"), 256).alias("content"))


def tangent_lda(train: DataFrame, test: DataFrame, by: list[str], channels: int, lam: float = 0.05, most: int = resample.MOST) -> DataFrame:
    """(by, n_train, n_test, balanced_accuracy): shrink, Fréchet mean of the training matrices alone, tangent vectors, linear discriminants (M1, M3); null with fewer than two classes.

    Where no group holds over `most` numbers, which is counted, a group is fitted and tested in one task; larger ones by
    `tangent_models`, with the same results. Equal training sets should be fitted once: make `by` of the distinct sets and
    join the scores back (M2).
    """
    rows = train.select(*by, "label", "cov", F.lit(True).alias("fit")).unionByName(test.select(*by, "label", "cov", F.lit(False).alias("fit")))
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest * channels * channels > most:
        keys = cut(train.select(*by).distinct()).withColumn("_set", F.monotonically_increasing_id())
        other = keys.select(*[F.col(k).alias(f"_{k}") for k in by], "_set")
        of = lambda df: df.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]).select(F.array("_set").alias("sets"), "label", "cov")
        return keys.join(tangent_scores(of(test), tangent_models(of(train), channels, lam), channels, lam), F.col("_set") == F.col("set"), "left").drop("_set", "set")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit, held = pdf[pdf["fit"]], pdf[~pdf["fit"]]
        row = {k: [pdf[k].iloc[0]] for k in by} | {"n_train": [len(fit)], "n_test": [len(held)], "balanced_accuracy": [None]}
        if fit["label"].nunique() > 1 and len(held):
            a, b = (spd.shrink(stack(x["cov"], channels), lam) for x in (fit, held))
            m = spd.frechet_mean(a)
            said = spd.lda(spd.tangent(a, m), fit["label"].to_numpy(), spd.tangent(b, m))
            row["balanced_accuracy"] = [spd.balanced_accuracy(held["label"].to_numpy(), said)]
        return pd.DataFrame(row)

    schema = ", ".join([*(f"{k} {train.schema[k].dataType.simpleString()}" for k in by), "n_train long, n_test long, balanced_accuracy double"])
    return rows.groupBy(*by).applyInPandas(run, schema)


def pooled(sets: DataFrame, sources: DataFrame, screening: DataFrame, held: DataFrame, channels: int, lam: float = 0.05, most: int = resample.MOST, store: ModelStore | None = None) -> DataFrame:
    """(case_id, method, n_sources, n_train, n_test, balanced_accuracy): a classifier of each method's retained sources, their trials pooled (G15), and of the target's own screening trials (M3, method target_only).

    sets: case_id, method, members. Equal sets of a case are fitted once (M2), and never again with a `store`. Cases of over
    `most` numbers, or any with a store, are learned without copies of trials by `tangent_models`.
    """
    key = F.concat_ws(",", F.transform("members", lambda m: m.cast("string")))
    keyed = cut(sets.select("case_id", "method", "members", key.alias("set")))
    distinct = keyed.select("case_id", "set", "members").dropDuplicates(["case_id", "set"])
    trials = sources.select("case_id", "label", "cov").unionByName(screening.select("case_id", "label", "cov")).unionByName(held.select("case_id", "label", "cov"))
    largest = trials.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0
    if store is None and largest * channels * channels <= most:
        train = distinct.select("case_id", "set", F.explode("members").alias("source")).join(sources, ["case_id", "source"]).select("case_id", "set", "label", "cov")
        train = train.unionByName(screening.select("case_id", F.lit("target").alias("set"), "label", "cov"))
        test = train.select("case_id", "set").distinct().join(held, "case_id")
        fitted = tangent_lda(train, test, ["case_id", "set"], channels, lam, most)
    else:
        target = keyed.select("case_id", F.lit("target").alias("set"), F.array().cast(sets.schema["members"].dataType).alias("members")).distinct()
        numbers = cut(distinct.unionByName(target)).withColumn("_set", F.monotonically_increasing_id())
        own = numbers.where("set <> 'target'").select("case_id", F.explode("members").alias("source"), "_set").groupBy("case_id", "source").agg(F.collect_list("_set").alias("sets"))
        train = sources.join(own, ["case_id", "source"]).select("sets", "label", "cov")
        train = train.unionByName(screening.join(numbers.where("set = 'target'"), "case_id").select(F.array("_set").alias("sets"), "label", "cov"))
        test = held.join(numbers.groupBy("case_id").agg(F.collect_list("_set").alias("sets")), "case_id").select("sets", "label", "cov")
        models = store.models(train, channels, lam) if store else tangent_models(train, channels, lam)
        scores = tangent_scores(test, cut(models), channels, lam).withColumnRenamed("set", "_set")
        fitted = numbers.select("case_id", "set", "_set").join(scores, "_set").drop("_set")
    own = keyed.select("case_id", "method", "set", F.size("members").alias("n_sources"))
    own = own.unionByName(keyed.select("case_id").distinct().select("case_id", F.lit("target_only").alias("method"), F.lit("target").alias("set"), F.lit(0).alias("n_sources")))
    return own.join(fitted, ["case_id", "set"], "left").drop("set")


def standardise_whiten(df: DataFrame, columns: list[str], components: int) -> DataFrame:
    """`df` with `white`: z-scores, then at most `components` principal components scaled to unit variance."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(df)
    z = StandardScaler(withMean=True, inputCol="_v", outputCol="_z").fit(v).transform(v)
    pca = PCA(k=min(components, len(columns)), inputCol="_z", outputCol="_p").fit(z)
    # the z-scores have variance one, so a component's variance is its share of the number of columns
    scale = [1 / np.sqrt(max(s * len(columns), 1e-12)) for s in pca.explainedVariance.toArray()]
    p = vector_to_array("_p")
    return pca.transform(z).withColumn("white", F.array(*[p[k] * F.lit(float(s)) for k, s in enumerate(scale)])).drop("_v", "_z", "_p")
