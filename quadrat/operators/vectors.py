"""Vector top-k, reranking, quantization and reduction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.functions.nested import dot


def top_k(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str, score: str = "score") -> DataFrame:
    """Best ``k`` rows by inner product with one query: a top-k plan without a shuffle of the vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn(score, dot(F.col(vector), q)).orderBy(F.desc(score), key).limit(k)


def rerank(candidates: DataFrame, score: str, key: str, least: float | None = None, most: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Ranks by a second score; ranks are given before rows under ``least`` go."""
    w = W.partitionBy(*by).orderBy(F.desc_nulls_last(score), key)
    out = candidates.withColumn("rerank_rank", F.row_number().over(w))
    if least is not None:
        out = out.where(F.col(score) >= least)
    return out if most is None else out.where(F.col("rerank_rank") <= most)


def quantize(df: DataFrame, vector: str, out: str = "quantized") -> DataFrame:
    """Bytes 0 to 255 a dimension between the dimension's extremes, truncated; a constant dimension gives 0."""
    lims = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # one row of as many pairs as the vectors have dimensions
    arr = lims.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))), lambda s: F.struct(s["lo"].cast("double").alias("lo"), s["hi"].cast("double").alias("hi"))).alias("_lims"))
    q = lambda x, l: F.when(l["hi"] > l["lo"], ((x.cast("double") - l["lo"]) / (l["hi"] - l["lo"]) * 255).cast("int")).otherwise(0)
    return df.join(F.broadcast(arr), F.lit(True)).withColumn(out, F.zip_with(vector, "_lims", q)).drop("_lims")


def reduce_dimensions(df: DataFrame, vector: str, k: int, out: str = "reduced") -> DataFrame:
    with_v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(with_v)
    return model.transform(with_v).withColumn(out, vector_to_array("_p")).drop("_v", "_p")
