"""Scans and sinks of plain files (S1 - S4, S12, K1 - K4, K6, K9). Schemas are given, never inferred."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate


def read_spread(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet columns for work that multiplies rows: an input of fewer files than cores is dealt out first, a larger one is left as it is scanned."""
    df = spark.read.parquet(path).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """CSV with a header; NaN becomes null; the header must hold every column of the schema."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.when(F.isnan(name), None).otherwise(F.col(name)))
    validate.refuse(validate.required(df, required or []))
    return df


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, to be cast where they are used."""
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document for each file."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(document: dict | list, path: str) -> None:
    """A small document of the driver, atomically: temporary file, fsync, replace (K2, K3)."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w") as f:
        json.dump(document, f, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def inventory(spark: SparkSession, glob: str, pattern: str, names: list[str]) -> DataFrame:
    """path, length and the groups of `pattern` in each path that matches it (S12); contents are not read."""
    f = spark.read.format("binaryFile").load(glob).select("path", "length")
    return f.where(F.col("path").rlike(pattern)).select("path", "length", *[F.regexp_extract("path", pattern, k + 1).alias(n) for k, n in enumerate(names)])


def sha256_of(spark: SparkSession, path: str) -> Column:
    """SHA-256 in hexadecimal digits of the file whose path is in the column `path`, read by executors as a stream.

    An expression of calls to Hadoop's file systems and to Commons Codec, which Spark ships, so it reads what Spark reads, a
    kilobyte at a time and of any length; the stream is closed by the JVM's cleaner.
    """
    jvm = spark.sparkContext._jvm
    e, kinds = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types
    seq = lambda *x: jvm.org.apache.spark.api.python.PythonUtils.toSeq(list(x))
    cls = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass
    of = lambda name: kinds.ObjectType(cls(name))
    call = lambda x, name, kind, *args: e.objects.Invoke(x, name, kind, seq(*args), seq(), True, True, False)
    new = lambda name, *args: e.objects.NewInstance(cls(name), seq(*args), seq(), True, of(name), jvm.scala.Option.empty())
    given = lambda x: jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(x._jc)
    text = lambda x: call(x, "toString", of("java.lang.String"))
    settings = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    conf = call(e.Literal.fromObject(settings), "value", of("org.apache.hadoop.conf.Configuration"))
    file = new("org.apache.hadoop.fs.Path", text(given(F.col(path))))
    stream = call(call(file, "getFileSystem", of("org.apache.hadoop.fs.FileSystem"), conf), "open", of("org.apache.hadoop.fs.FSDataInputStream"), file)
    hexes = call(new("org.apache.commons.codec.digest.DigestUtils", text(given(F.lit("SHA-256")))), "digestAsHex", of("java.lang.String"), stream)
    utf8 = e.objects.StaticInvoke(cls("org.apache.spark.unsafe.types.UTF8String"), kinds.DataType.fromDDL("string"), "fromString", seq(hexes), seq(), True, True, False, jvm.scala.Option.empty())
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(utf8))


def manifest(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path (below `root`), bytes, sha256 of every file in the folder and those in it, or of those whose name fits `glob` (K9); no file is held whole. Spark lists no empty files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    f = (f.option("pathGlobFilter", glob) if glob else f).load(root).select("path", "length")
    base = "^.*" + re.escape("/" + root.rstrip("/").split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/")
    return f.select(F.regexp_replace("path", base, "").alias("path"), F.col("length").alias("bytes"), sha256_of(spark, "path").alias("sha256"))


def check_manifest(spark: SparkSession, recorded: DataFrame, root: str, glob: str | None = None) -> DataFrame:
    """Violations of a recorded manifest: missing, unexpected and changed files, and paths that leave their folder (V9)."""
    now = manifest(spark, root, glob)
    escape = validate.rows(recorded, "path escape", ["path"], F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)"))
    both = recorded.join(now.select("path", F.col("sha256").alias("_h")), "path")
    return validate.union(
        validate.rows(recorded.join(now, "path", "left_anti"), "missing file", ["path"], F.lit(True)),
        validate.rows(now.join(recorded, "path", "left_anti"), "unexpected file", ["path"], F.lit(True)),
        validate.rows(both, "changed file", ["path"], F.col("sha256") != F.col("_h")),
        escape,
    )


def cells(df: DataFrame, digits: int, most: int) -> list[list[str]]:
    """A small table as text, its header first; ValueError beyond `most` rows, since it is collected."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return [df.columns, *[[cell(v) for v in r] for r in rows]]


def to_markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small table as Markdown (K6); bars and line ends in cells are escaped."""
    head, *body = [[c.replace("|", r"\|").replace("\n", "<br>") for c in r] for r in cells(df, digits, most)]
    return "\n".join("| " + " | ".join(x) + " |" for x in [head, ["---"] * len(head), *body])


#: How LaTeX writes characters that it reads as commands.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\n": " "}


def to_latex(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """The same as a LaTeX tabular (K7)."""
    row = lambda x: " & ".join("".join(LATEX.get(ch, ch) for ch in c) for c in x) + r" \\"
    head, *body = map(row, cells(df, digits, most))
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", head, r"\hline", *body, r"\end{tabular}"])
