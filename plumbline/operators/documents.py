"""Nested documents as rows of (path, value), compared in depth with tolerances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import validate


def flattened(docs: DataFrame, key: list[str], document: str, deepest: int = 64) -> DataFrame:
    """(key, path, kind, value) of every leaf of the JSON texts in `document`: kind is object or array (empty ones), string, number, boolean or null; value is text.

    Paths are like `$.a[0].b`. Each round opens one level of all documents at once, by Spark's variants; a text that is no
    JSON is one row of kind `malformed`, a null document gives none.
    """
    spark = docs.sparkSession
    d = docs.where(F.col(document).isNotNull()).select(*key, F.lit("$").alias("path"), F.col(document).alias("_text"), F.try_parse_json(document).alias("v"))
    out = [d.where("v is null").select(*key, "path", F.lit("malformed").alias("kind"), F.col("_text").alias("value"))]
    now = d.where("v is not null").select(*key, "path", "v")
    for _ in range(deepest):
        now = now.withColumn("_s", F.schema_of_variant("v"))
        object_, array = F.col("_s").startswith("OBJECT"), F.col("_s").startswith("ARRAY")
        kind = F.when(object_, "object").when(array, "array").when(F.col("_s") == "STRING", "string").when(F.col("_s") == "BOOLEAN", "boolean").when(F.col("_s") == "VOID", "null").otherwise("number")
        told = cut(now.withColumn("kind", kind).select(*key, "path", "kind", F.to_json("v").alias("_json")))
        nested = told.where("kind in ('object', 'array') and _json not in ('{}', '[]')")
        leaves = told.where("kind not in ('object', 'array') or _json in ('{}', '[]')")
        value = F.when(F.col("kind") == "string", F.try_variant_get(F.parse_json("_json"), "$", "string")).otherwise(F.col("_json"))
        out.append(leaves.select(*key, "path", "kind", value.alias("value")))
        if nested.isEmpty():
            break
        opened = nested.withColumn("v", F.parse_json("_json")).select(*key, "path", "kind", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        step = F.when(F.col("kind") == "object", F.concat(F.lit("."), "_key")).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        now = opened.select(*key, F.concat("path", step).alias("path"), F.col("_value").alias("v"))
    else:
        raise ValueError(f"documents of over {deepest} levels")
    return validate.union(*out)


def differences(a: DataFrame, b: DataFrame, key: list[str], document: str, rtol: float = 1e-9, atol: float = 1e-11) -> DataFrame:
    """(check, key, detail): every path at which two tables of documents differ. Numbers are compared with tolerances, whatever they are written as; other values must be equal, and of one kind."""
    x = flattened(a, key, document)
    y = flattened(b, key, document).select(*[F.col(k).alias(f"r_{k}") for k in key], F.col("path").alias("r_path"), F.col("kind").alias("r_kind"), F.col("value").alias("r_value"))
    both = x.join(y, [*[F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key], F.col("path") == F.col("r_path")], "full")
    number = (F.col("kind") == "number") & (F.col("r_kind") == "number")
    close = validate.close(F.col("value").cast("double"), F.col("r_value").cast("double"), rtol, atol)
    same = F.when(number, close).otherwise((F.col("kind") == F.col("r_kind")) & F.col("value").eqNullSafe(F.col("r_value")))
    at = [F.coalesce(F.col(k), F.col(f"r_{k}")).alias(k) for k in key]
    told = both.select(*at, F.coalesce("path", "r_path").alias("path"), F.when(F.col("r_path").isNull(), "left only").when(F.col("path").isNull(), "right only").when(~same, "differs").alias("check"), F.concat_ws(" ", "kind", "value", F.lit("|"), "r_kind", "r_value").alias("detail"))
    return told.where("check is not null").select("check", F.to_json(F.struct(*key, "path")).alias("key"), "detail")
