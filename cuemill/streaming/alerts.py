"""Log alerts over Structured Streaming: follow, match, debounce.

One state per key holds the time of the last alert; a line passes iff it is at
least ``gap`` seconds after it.  Over a finished log the stream gives the rows
of the batch fold ``operators.intervals.spaced`` as long as micro-batches arrive
in event order, which the file source does with ``latestFirst`` off;
``debounced_in_order`` does so in any order, by a watermark, and forgets idle keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .logs import GrowingLogs

KEPT = "k long, ord long, at long"


def follow(spark: SparkSession, path: str, from_end: bool = False, **options) -> DataFrame:
    """Lines (file, place, value) appended to growing logs, surviving rotation."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").options(path=path, from_end=str(from_end).lower(), **options).load()


def follow_text(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines as they are appended in new files of a folder."""
    return spark.readStream.format("text").options(**options).load(path)


def matching(lines: DataFrame, text: str, literal: str) -> DataFrame:
    """Lines that hold the literal."""
    return lines.where(F.contains(F.col(text), F.lit(literal)))


def debounced(stream: DataFrame, gap: int) -> DataFrame:
    """The rows (k, ord, at) that raise an alert, ``gap`` whole seconds apart per
    key.  State is one number per key."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["at", "ord"])
        out = []
        for ord_, at in zip(rows["ord"].tolist(), rows["at"].tolist()):
            if last is None or at - last >= gap:
                out.append((key[0], ord_, at))
                last = at
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["k", "ord", "at"])

    return stream.groupBy("k").applyInPandasWithState(step, KEPT, "last long", "append", GroupStateTimeout.NoTimeout)


def debounced_in_order(stream: DataFrame, gap: int, delay: str, ts: str = "ts") -> DataFrame:
    """The same rows in event order, whatever the order in which micro-batches bring
    them: a row (k, ord, at, ``ts``) waits until the watermark, ``delay`` behind the latest
    ``ts``, has passed its second ``at`` and is then judged after all earlier ones; rows
    that come later than that are left out.

    A key's state is its last alert and the rows that wait, no more than ``delay`` brings;
    it expires ``gap`` seconds after the last alert, when it can silence nothing any more."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, waits = (state.get[0], list(zip(state.get[1], state.get[2]))) if state.exists else (None, [])
        now = state.getCurrentWatermarkMs()
        for rows in parts:
            waits += [(int(a), int(o)) for a, o, late in zip(rows["at"], rows["ord"], rows["at"] * 1000 < now - 999) if not late]
        out = []
        for at, ord_ in sorted(x for x in waits if x[0] * 1000 - 1 <= now):
            if last is None or at - last >= gap:
                out.append((key[0], ord_, at))
                last = at
        waits = sorted(x for x in waits if x[0] * 1000 - 1 > now)
        if waits or last is not None and (last + gap) * 1000 > now:
            state.update((last, [a for a, _ in waits], [o for _, o in waits]))
            state.setTimeoutTimestamp(waits[0][0] * 1000 - 1 if waits else (last + gap) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["k", "ord", "at"])

    return stream.withWatermark(ts, delay).groupBy("k").applyInPandasWithState(step, KEPT, "last long, at array<long>, ord array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stream over all that is there, once, exactly-once into Parquet.  The
    checkpoint remembers what has been read, so a later call takes only new files."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def incremental(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process files that have no success record yet."""
    drain(spark.readStream.format(fmt).schema(schema).load(source), out, checkpoint)


def consume_once(spark: SparkSession, source: str, out: str, checkpoint: str, archive: str) -> None:
    """Take every text file of a folder once; files that were taken move to the
    archive when a later run begins."""
    drain(spark.readStream.format("text").option("cleanSource", "archive").option("sourceArchiveDir", archive).load(source), out, checkpoint)
