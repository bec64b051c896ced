"""Reconciliation of what is wanted with what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip_span, natural_key, title_date, to_cents, watch_url
from ..sources.shared import staged

MODES = ("half_up", "floor", "ceiling")


def missing(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(there.select(*keys), keys, "left_anti")


def present(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(there.select(*keys), keys, "left_semi")


def clip_keys(clips: DataFrame, before: str = "0.00", after: str = "0.00") -> DataFrame:
    """``clips`` with padded ends as DECIMAL: not before 0."""
    d = "decimal(12,3)"
    return clips.withColumns(
        {
            "s_adj": F.greatest((F.col("start").cast(d) - F.lit(before).cast(d)).cast(d), F.lit(0).cast(d)),
            "e_adj": (F.col("end").cast(d) + F.lit(after).cast(d)).cast(d),
        }
    )


def clips_half_up(clips: DataFrame, existing: DataFrame, before: str = "0.00", after: str = "0.00") -> DataFrame:
    """``clips`` with ``present``: the rounded key is among the existing ones."""
    keyed = clip_keys(clips, before, after).withColumns({"__s": to_cents("s_adj", "half_up"), "__e": to_cents("e_adj", "half_up")})
    e = existing.select(F.col("id").alias("__i"), F.col("start").alias("__es"), F.col("end").alias("__ee"), F.lit(True).alias("__hit")).distinct()
    out = keyed.join(e, (F.col("id") == F.col("__i")) & (F.col("__s") == F.col("__es")) & (F.col("__e") == F.col("__ee")), "left")
    return out.withColumn("present", F.coalesce("__hit", F.lit(False))).drop("__s", "__e", "__i", "__es", "__ee", "__hit")


def clips_tolerant(clips: DataFrame, existing: DataFrame, before: str = "0.00", after: str = "0.00") -> DataFrame:
    """``clips`` with ``found_start`` and ``found_end``: the first existing key
    among the nine roundings of both ends (half up, floor, ceiling; the start's
    first), NULL without one.

    The start's roundings are its cents cut off and at most one cent more, so the
    existing spans are gathered by id and start in cents, each under its own start
    and the one before: one join, no row per candidate, and what is gathered are
    the spans of one id that start within two cents.
    """
    keyed = clip_keys(clips, before, after)
    cents = lambda c: (F.floor(F.col(c), F.lit(2)) * 100).cast("long")
    spans = existing.select(F.col("id").alias("__i"), F.struct(F.col("start").cast("decimal(12,2)").alias("s"), F.col("end").cast("decimal(12,2)").alias("e")).alias("x")).distinct()
    own = (F.col("x.s") * 100).cast("long")
    per = spans.select("__i", "x", F.explode(F.array(own, own - 1)).alias("__c")).groupBy("__i", "__c").agg(F.collect_list("x").alias("__there"))
    joined = keyed.join(per, (F.col("id") == F.col("__i")) & (cents("s_adj") == F.col("__c")), "left")
    tries = [F.struct(to_cents("s_adj", a).alias("s"), to_cents("e_adj", b).alias("e")) for a in MODES for b in MODES]
    found = F.coalesce(*[F.when(F.array_contains("__there", t), t) for t in tries])
    return joined.withColumn("__f", found).withColumns({"found_start": F.col("__f.s"), "found_end": F.col("__f.e")}).drop("__f", "__i", "__c", "__there")


def compare_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of all keys: both, left or right."""
    a = left.select(key).distinct().withColumn("l", F.lit(True))
    b = right.select(F.col(key)).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("l").isNotNull(), "left").otherwise("right")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def completeness(entries: DataFrame, parts: dict[str, DataFrame], key: str, waived: dict[str, DataFrame] | None = None, force: bool = False) -> DataFrame:
    """``entries`` with needs_<part> for each part table, and ``complete``.  A
    waived key does not need that part; ``force`` needs everything."""
    out = entries
    for name, there in parts.items():
        have = there.select(F.col(key).alias("__k")).distinct().withColumn("__h", F.lit(True))
        out = out.join(have, F.col(key) == F.col("__k"), "left").withColumn(f"needs_{name}", F.lit(True) if force else F.col("__h").isNull()).drop("__k", "__h")
        if waived and name in waived and not force:
            free = waived[name].select(F.col(key).alias("__k")).distinct().withColumn("__h", F.lit(True))
            out = out.join(free, F.col(key) == F.col("__k"), "left").withColumn(f"needs_{name}", F.col(f"needs_{name}") & F.col("__h").isNull()).drop("__k", "__h")
    needs = reduce(lambda a, b: a | b, [F.col(f"needs_{n}") for n in parts])
    return out.withColumn("complete", ~needs)


def batches(df: DataFrame, bucket: str, order: list, size: int) -> DataFrame:
    """``df`` with a global ``ordinal`` (from 1) and ``batch`` (from 0) in the
    order of ``bucket`` (NULL last), then ``order``, which must break all ties.

    A row number over everything would gather everything in one task, and one
    over each bucket a hot bucket.  Here rows are dealt by ranges of the whole
    order, numbered inside their range, and the ranges' running counts, one small
    row each, are added.  Rows are staged before they are dealt, as ranges are
    sampled first, and after, as their places are asked for twice and must not
    change.
    """
    by = [F.col(bucket).asc_nulls_last(), *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = staged(df, "unordered").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id())
    dealt = staged(dealt.withColumns({"__p": F.shiftright("__m", 33), "__n": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__m"), "ordered")
    up = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col("__p").alias("__b")).agg(F.count("*").alias("__c"))
    offsets = counts.select("__b", F.coalesce(F.sum("__c").over(up), F.lit(0)).alias("__o"))
    out = dealt.join(offsets, F.col("__p") == F.col("__b"))
    at = F.col("__n") + F.col("__o")
    return out.withColumns({"ordinal": (at + 1).cast("long"), "batch": F.floor(at / size).cast("long")}).drop("__n", "__p", "__b", "__o")


#: The four orders of clips: (bucket, order) before the tie breakers.
CLIP_ORDERS = {"name": ("natural", []), "time": ("modified", []), "timestamp": ("at", []), "date_timestamp": ("day", ["at"])}


def clip_order(clips: DataFrame, kind: str, ties: list[str], size: int, name: str = "name") -> DataFrame:
    """``clips`` (name[, modified]) numbered and batched in one of the four
    orders: by name with numbers as numbers, by file time, by start in the name
    (clips without one go), by date and start in the name."""
    start, _ = clip_span(name)
    df = clips.withColumns({"natural": natural_key(name), "at": start, "day": title_date(name)})
    bucket, order = CLIP_ORDERS[kind]
    if kind == "timestamp":
        df = df.where("at is not null")
    return batches(df, bucket, [*order, *ties], size).drop("natural", "at", "day")


def valid_files(files: DataFrame, size: str = "length", name: str = "name", lasts: str | None = None, expected: str | None = None, least: int = 10_240, share: float = 0.6) -> DataFrame:
    """Files that count as complete: no unfinished suffix, at least ``least``
    bytes and, where durations are given, at least ``share`` of the expected one."""
    out = files.where(~F.lower(name).rlike(r"\.(part|ytdl|tmp|temp)$") & (F.col(size) >= least))
    return out if lasts is None else out.where(F.coalesce(F.col(lasts), F.lit(0.0)) >= F.col(expected) * share)


def already_complete(infos: DataFrame, media: DataFrame, urls: DataFrame, key: str = "id") -> DataFrame:
    """(key, url) of metadata without media: its own URL, else the first of
    ``urls``, else the watch URL."""
    known = urls.groupBy(F.col(key).alias("__k")).agg(F.min("url").alias("__u"))
    out = missing(infos, media, [key]).join(known, F.col(key) == F.col("__k"), "left")
    return out.select(key, F.coalesce(F.nullif("url", F.lit("")), "__u", watch_url(key)).alias("url"))
