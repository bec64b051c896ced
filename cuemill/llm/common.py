"""Helpers that the corpus operators share: staging, sizes, text batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A session in one process that
    names none gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc.getCheckpointDir()
        if not found:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="cuemill-"))
            found = sc.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``staged``, and the path, for ``removed``."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts
    the lineage, survives lost executors and lets several readers share it."""
    return stage(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Take away a staged table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table of few files and fewer filled tasks than cores (a file of one row
    group is one task) is dealt out once; any other table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id()).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def nested(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``d``, so that working columns beside it
    cannot clash with any of its names; ``flat`` undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))


def flat(df: DataFrame, columns: list[str], **other) -> DataFrame:
    """The columns of ``d``; those in ``other`` get that expression instead."""
    return df.select(*[other.get(c, F.col("d")[c]).alias(c) for c in columns])


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` begins with it."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()) if not pa.types.is_binary(column.type) else column.cast(pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(column) else raw[:0], off - (off[0] if len(off) else 0)


def slices(off: np.ndarray, limit: int):
    """Row ranges (a, b) whose bytes sum to about ``limit``; one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def sample_of(df: DataFrame, n: int, *key: str) -> DataFrame:
    """At most ``n`` rows of ``df``, those of smallest hash of ``key``: the same in
    every run.  Rows that cannot be among them are left out before the sort, by a
    bound from the row count, so that few rows travel."""
    place = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    total = max(1, df.count())
    bound = int((1 << 40) * min(1.0, (2 * n + 1000) / total))
    return df.where(place < bound).orderBy(place, *key).limit(n)


def keyed(seed: str, *cols) -> F.Column:
    """A uniform number in (0, 1) from the columns' text, the same in any
    engine that has MD5: the first 13 hex digits plus a half, over 16**13."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
