"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Scaled to length 1; NULL below 1e-9."""
    return let(norm(a), lambda n: F.when(n >= 1e-9, F.transform(a, lambda x: x.cast("double") / n)))


def centroid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): mean of each group's vectors, scaled to length 1. Dimensions are summed apart, so any group size will do."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    mean = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    return mean.select(key, unit(F.transform("v", lambda s: s["m"])).alias("centroid"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def hashed_vectors(df: DataFrame, key: str, tokens: str, dims: int = 256) -> DataFrame:
    """(key, dim, w): texts as sparse vectors of length 1, without a trained model: token counts times ln((1 + n) / (1 + df)), summed per digest of the token.

    ``n`` is the number of texts, ``df`` that of texts with the token. Texts without tokens, or with such as all texts have, give no rows.
    """
    each = df.select(F.col(key), F.explode(tokens).alias("__t")).where("__t <> ''").groupBy(key, "__t").agg(F.count("*").alias("__tf"))
    rare = each.groupBy("__t").agg(F.count("*").alias("__df"))
    n = df.select(key).distinct().count()
    w = each.join(rare, "__t").withColumn("__w", F.col("__tf") * F.ln((1.0 + n) / (1 + F.col("__df"))))
    dim = F.pmod(F.conv(F.substring(F.md5("__t"), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")
    part = w.groupBy(key, dim.alias("dim")).agg(F.sum("__w").alias("__w")).where("__w <> 0")
    length = part.groupBy(F.col(key).alias("__k")).agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__l"))
    return part.join(length, F.col(key) == F.col("__k")).select(key, "dim", (F.col("__w") / F.col("__l")).alias("w"))
