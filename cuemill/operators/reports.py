"""Transcript quality, histograms, embedding similarity, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, ratio


def per_file(words: DataFrame, key: str = "ytid") -> DataFrame:
    """One row per file; a missing confidence counts as 0, the best."""
    c = F.coalesce("confidence", F.lit(0.0))
    return words.groupBy(key).agg(
        F.count("*").alias("total_words"),
        F.count_distinct("seg").alias("total_segments"),
        F.count_distinct(F.when(F.col("retried"), F.col("seg"))).alias("retried_segments"),
        F.sum(c).alias("sum_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
        F.count_if(c < -1.0).alias("low_conf_words"), F.count_if(c < -1.5).alias("very_low_conf_words"),
    ).withColumn("avg_confidence", F.col("sum_confidence") / F.col("total_words"))


def summary(files: DataFrame) -> DataFrame:
    """The corpus: sums, the mean over all words (not of means), guarded shares."""
    t = files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("total_words"), F.lit(0)).alias("total_words"), F.coalesce(F.sum("total_segments"), F.lit(0)).alias("total_segments"),
        F.coalesce(F.sum("retried_segments"), F.lit(0)).alias("retried_segments"), F.coalesce(F.sum("sum_confidence"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum("low_conf_words"), F.lit(0)).alias("low_conf_words"), F.coalesce(F.sum("very_low_conf_words"), F.lit(0)).alias("very_low_conf_words"),
    )
    return t.withColumns(
        {
            "avg_confidence": ratio("s", "total_words"), "retried_share": ratio("retried_segments", "total_segments"),
            "low_share": ratio("low_conf_words", "total_words"), "very_low_share": ratio("very_low_conf_words", "total_words"),
        }
    ).drop("s")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n) of equal-width bins, the last one closed, empty ones included; one
    bin where all values are equal.  Two partial aggregations, no sort."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    counted = df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    # one row of ends makes the frame of all bins
    frame = ends.where("lo is not null").select(F.explode(F.when(F.col("hi") == F.col("lo"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"), (F.col("lo")).alias("l"), width.alias("w"))
    return frame.join(F.broadcast(counted.select("bin", "n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("l") + F.col("bin") * F.col("w")).alias("bin_start"))


def retry_deciles(files: DataFrame) -> DataFrame:
    share = F.floor(ratio(F.col("retried_segments") * 100, "total_segments"))
    return files.groupBy((F.floor(share / 10) * 10).cast("int").alias("pct")).agg(F.count("*").alias("files"))


def mean_vector(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: the element-wise mean, not normalised again.  Summed by position
    with partial aggregation, whatever the number of references."""
    e = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("profile"))


def similarity(df: DataFrame, references: DataFrame, vector: str = "embedding", threshold: float = 0.7) -> DataFrame:
    """``df`` with its dot product with the references' mean and whether that
    reaches the threshold; vectors that are missing count as 0 and do not match."""
    profile = F.broadcast(mean_vector(references, vector))  # a single row
    out = df.join(profile).withColumn("similarity", F.coalesce(dot(vector, "profile"), F.lit(0.0)))
    return out.withColumn("matches", F.col("similarity") >= threshold).drop("profile")


def availability(item: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Count and first example per class."""
    return item.groupBy(*keys).agg(F.count("*").alias("n"), F.min(name).alias("example"))
