"""Text vectors, k-means and distances to centroids."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc.functions.text import tokens
from voc.storage import materialize

VECTOR_SIZE = 384
BATCH = 64
CENTROID_BLOCK = 1000


def text_vectors(df: DataFrame, size: int = VECTOR_SIZE) -> DataFrame:
    """Unit-length hashed TF-IDF vectors: ``ord, vector ARRAY<FLOAT>``."""
    words = df.select("ord", tokens("cleaned_text").alias("words"))
    stages = [
        HashingTF(numFeatures=size, inputCol="words", outputCol="tf"),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="unit"),
    ]
    return Pipeline(stages=stages).fit(words).transform(words).select("ord", vector_to_array("unit", "float32").alias("vector"))


def encode(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH) -> DataFrame:
    """Vectors of a given model. ``load`` runs once per task; texts reach the model in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            texts = frame["cleaned_text"].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.DataFrame({"ord": frame["ord"], "vector": vectors})

    return df.select("ord", "cleaned_text").mapInPandas(run, "ord BIGINT, vector ARRAY<FLOAT>")


def cluster_number(n: Column) -> Column:
    """How many clusters n texts get: one per 30 texts, at least 4, at most 12."""
    return F.least(F.lit(12), F.greatest(F.lit(4), F.floor(n / 30))).cast("bigint")


def _kmeans(vectors: DataFrame, key: str, col: str, seed: int):
    features = vectors.select(key, array_to_vector(F.col(col)).alias("features"))
    k = features.agg(cluster_number(F.count("*")).alias("k")).first()["k"]
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(features)
    return k, model, model.transform(features)


def kmeans(vectors: DataFrame, key: str, col: str, seed: int = 42) -> DataFrame:
    """k-means cluster of every vector, k by ``cluster_number``."""
    return _kmeans(vectors, key, col, seed)[2].select(key, "cluster_id")


def kmeans_check(vectors: DataFrame, key: str, col: str, seed: int = 42) -> DataFrame:
    """One row: k, vectors, clusters in use, and vectors that another centre is nearer to than their own."""
    k, model, assigned = _kmeans(vectors, key, col, seed)
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])  # at most twelve
    away = F.transform(centres, lambda c: F.aggregate(
        F.zip_with(vector_to_array("features"), c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    ))
    rows = assigned.select("cluster_id", away.alias("away"))
    off = F.get("away", F.col("cluster_id")) > F.array_min("away") * (1 + 1e-9)
    return rows.agg(
        F.lit(k).cast("bigint").alias("k"), F.count("*").alias("n"),
        F.count_distinct("cluster_id").alias("clusters"), F.count_if(off).alias("not_nearest"),
    )


def tfidf(df: DataFrame, key: str = "ord", text: str = "cleaned_text") -> DataFrame:
    """``key, term, weight``: exact TF-IDF without hashing, ln((n + 1) / (df + 1)), of unit length per text."""
    rows = df.select(key, F.explode(tokens(text)).alias("term"))
    counts = rows.groupBy(key, "term").agg(F.count("*").alias("tf"))
    total = df.agg(F.count("*").alias("n")).scalar()
    terms = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = terms.select("term", F.log((total + 1) / (F.col("df") + 1)).alias("idf"))
    raw = counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("weight"))


def centroids(vectors: DataFrame, group: str, col: str) -> DataFrame:
    """Mean vector per group, summed before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(col)))
    return vectors.groupBy(group).agg(vector_to_array(mean).alias("centroid"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column) -> Column:
    # the length is a field of a value that is built once, not an expression evaluated for every element
    sized = F.array(F.struct(v.alias("v"), F.sqrt(_dot(v, v)).alias("length")))
    return F.transform(sized, lambda s: F.transform(s["v"], lambda e: e / s["length"]))[0]


def centroid_distances(vectors: DataFrame, key: str, group: str, col: str) -> DataFrame:
    """Cosine of every vector to its own centroid, and the nearest centroid (of equal ones the smallest group).

    Both sides are scaled to unit length once. Centroids go to the vectors in blocks of ``CENTROID_BLOCK``, as one array
    value each. One block is a constant of the plan; more are joined by block number, with copies of each block so that no
    task gets all vectors, and the best of the blocks is taken at the end.
    """
    means = materialize(centroids(vectors, group, col).select(group, _unit(F.col("centroid")).alias("centroid")), "centroids")
    blocks = -(-max(means.count(), 1) // CENTROID_BLOCK)
    entry = F.struct(F.col(group).cast("bigint").alias("g"), "centroid")
    rows = vectors.select(
        F.col(key).alias("key"), F.col(group).cast("bigint").alias("own"), _unit(F.col(col).cast("array<double>")).alias("x")
    )
    if blocks == 1:
        rows = rows.withColumn("all", means.agg(F.collect_list(entry).alias("all")).scalar())
    else:
        copies = rows.sparkSession.sparkContext.defaultParallelism
        placed = means.withColumn("block", F.pmod(F.xxhash64(group), F.lit(blocks))).groupBy("block").agg(F.collect_list(entry).alias("all"))
        placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        rows = rows.withColumn("copy", F.pmod(F.xxhash64("key"), F.lit(copies)).cast("int")).join(placed, ["block", "copy"])
    scored = rows.select("key", "own", F.transform(
        "all", lambda c: F.struct(F.round(_dot(F.col("x"), c["centroid"]), 6).alias("cos"), (-c["g"]).alias("minus_g"))
    ).alias("scored"))
    own = F.filter("scored", lambda s: s["minus_g"] == -F.col("own"))
    found = scored.select("key", "own", F.try_element_at(own, F.lit(1))["cos"].alias("own_cosine"), F.array_max("scored").alias("best"))
    if blocks > 1:
        found = found.groupBy("key", "own").agg(F.max("own_cosine").alias("own_cosine"), F.max("best").alias("best"))
    return found.select(
        F.col("key").alias(key), F.col("own").alias(group), "own_cosine", F.col("best.cos").alias("best_cosine"),
        (-F.col("best.minus_g")).alias("nearest"),
    )
