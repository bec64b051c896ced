"""Ordered folds: conditional interval merge, minimum-gap stamping, debounce.

Their state depends on what was last merged or emitted, which no window frame
expresses.  A key may hold any share of the rows, with no gap anywhere, so none is
folded in one task:

* ``spaced`` cuts a key into time blocks and summarises each as a function of the
  state at its begin, which only tells at what time the first row passes.  Functions
  of neighbouring blocks are composed, level by level, and the states are handed
  back down, so that all blocks are replayed at once.
* ``merge_hits`` deals the rows by ranges of the whole order and folds every range
  as if nothing were open at its begin, then again those whose true begin differs,
  until no end of a range changes any more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

FAN = 256  #: gaps in a block, and blocks in a block of the next level


# --- rows at least a gap apart ------------------------------------------------


def _summary(gap: float):
    """(k, b, entries, exits) of blocks (k, b, times): the times at which the first
    row of the block may pass, and that of the last one that then passes."""

    def run(batches):
        for batch in batches:
            kind = batch.column(2).type
            entries, exits = [], []
            for b, times in zip(batch.column(1).to_pylist(), batch.column(2)):
                t = times.values.to_numpy(zero_copy_only=False)
                # whatever passed before the block, the next one does by this time or is the first after it
                some = int(np.searchsorted(t, b * gap * FAN + 1.001 * gap)) + 1
                then = np.searchsorted(t, t + gap)
                last = np.where(then < len(t), then, np.arange(len(t)))
                for _ in range(FAN.bit_length() + 1):
                    last = last[last]
                entries.append(t[:some])
                exits.append(t[last[:some]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, kind), pa.array(exits, kind)], names=["k", "b", "entries", "exits"])

    return run


def _follow(blocks, first, gap: float):
    """(block, time at which its first row passes) of ordered blocks (b, entries,
    exits), and the last time that passes, if the first passing one is ``first``."""
    out, last = [], None
    for b, entries, exits in blocks:
        at = int(np.searchsorted(entries, first if last is None else last + gap))
        if at < len(entries):
            out.append((b, entries[at]))
            last = exits[at]
    return out, last


def _parts(batch, column: int):
    """Of each row of a column of arrays of (b, entries, exits): those as tuples."""
    for row in batch.column(column):
        inner = row.values
        yield list(zip(inner.field(0).to_pylist(), (x.values.to_numpy(zero_copy_only=False) for x in inner.field(1)), (x.values.to_numpy(zero_copy_only=False) for x in inner.field(2))))


def _composed(gap: float, span: float):
    """The same for blocks (k, b, parts) of the next level, of length ``span``."""

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(2).type.value_type.field(1).type
            entries, exits = [], []
            for b, parts in zip(batch.column(1).to_pylist(), _parts(batch, 2)):
                may: list = []
                for _, own, _ in parts:
                    may.extend(own.tolist())
                    if may[-1] >= b * span + 1.001 * gap:
                        break
                entries.append(may)
                exits.append([_follow(parts, e, gap)[1] for e in may])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, kind), pa.array(exits, kind)], names=["k", "b", "entries", "exits"])

    return run


def _entered(gap: float, known: bool):
    """(k, b, first): of every part of blocks (k, parts[, first]) in which a row
    passes the time of the first one."""

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(1).type.value_type.field(1).type.value_type
            firsts = batch.column(2).to_pylist() if known else [-float("inf")] * len(batch)
            rows = [(i, b, e) for i, (parts, first) in enumerate(zip(_parts(batch, 1), firsts)) for b, e in _follow(parts, first, gap)[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)], names=["k", "b", "first"])

    return run


def _replayed(gap: float):
    """(k, t): the times that pass of blocks (k, times, first)."""

    def run(batches):
        for batch in batches:
            kind = batch.column(1).type.value_type
            rows, out = [], []
            for i, (times, first) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                t = times.values.to_numpy(zero_copy_only=False)
                at = int(np.searchsorted(t, first))
                while at < len(t):
                    rows.append(i)
                    out.append(t[at])
                    at = int(np.searchsorted(t, t[at] + gap))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, kind)], names=["k", "t"])

    return run


def spaced(df: DataFrame, key: str, at: str, gap: float, order: str | None = None) -> DataFrame:
    """The rows that are emitted when a row passes iff it is at least ``gap`` after
    the last one that passed (the first always does): transcript stamps and
    debounced alerts.  Of rows of one time only the first in ``order`` (then in
    the order of the other columns) can pass; rows without a time do not.

    A block holds the different times of ``FAN`` gaps of a key, and a block of the
    next level what ``FAN`` such blocks may begin with; levels are added until every
    key is one block.
    """
    if gap <= 0:
        return df.where(F.col(at).isNotNull())
    rest = [*([order] if order and order not in (key, at) else []), *[c for c in df.columns if c not in (key, at, order)]]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(0)
    rows = df.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("k"), F.col(at).alias("t")).agg(F.min(row).alias("row"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    number = f"k {kinds['k']}, b long"
    span = gap * FAN
    blocks = staged(rows.groupBy("k", F.floor(F.col("t") / span).cast("long").alias("b")).agg(F.sort_array(F.collect_list("t")).alias("times")), "blocks")
    length = blocks.groupBy("k").agg((F.max("b") - F.min("b")).alias("n")).agg(F.max("n")).first()[0] or 0
    summary = blocks.mapInArrow(_summary(gap), f"{number}, entries array<{kinds['t']}>, exits array<{kinds['t']}>")
    part, levels = F.sort_array(F.collect_list(F.struct("b", "entries", "exits"))).alias("parts"), []
    while length > FAN:
        levels.append(staged(summary.groupBy("k", F.floor(F.col("b") / FAN).cast("long").alias("b")).agg(part), "level"))
        span, length = span * FAN, length // FAN + 1
        summary = levels[-1].mapInArrow(_composed(gap, span), f"{number}, entries array<{kinds['t']}>, exits array<{kinds['t']}>")
    first = summary.groupBy("k").agg(part).mapInArrow(_entered(gap, False), f"{number}, first {kinds['t']}")

    def joined(left, right):
        return left.alias("l").join(right.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")) & (F.col("l.b") == F.col("r.b")))

    for level in reversed(levels):
        first = joined(level, first).select("l.k", "parts", "first").mapInArrow(_entered(gap, True), f"{number}, first {kinds['t']}")
    passed = joined(blocks, first).select("l.k", "times", "first").mapInArrow(_replayed(gap), f"k {kinds['k']}, t {kinds['t']}")
    out = rows.alias("l").join(passed.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")) & (F.col("l.t") == F.col("r.t")))
    own = {key: F.col("l.k"), at: F.col("l.t")}
    return out.select(*[own.get(c, F.col("l.row")[c] if rest else None).alias(c) for c in df.columns])


# --- merging what touches -----------------------------------------------------

#: What is open where a range begins or ends: key, end, hit span, and the place of the group's first row.
OPEN = "key {0}, end {1}, hit_start {2}, hit_end {3}, gp long, gn long"


def _touches(group, x) -> bool:
    """Whether the span (start, end, hit_start, hit_end) joins the open group."""
    _, end, hit_start, hit_end, *_ = group
    start, _, first, last = x
    if None in (end, hit_start, hit_end, start, first, last):
        return False
    return end >= start and hit_end >= first and last >= hit_start


def _united(group, x):
    key, end, hit_start, hit_end, gp, gn = group
    return (key, end if x[1] is None else max(end, x[1]), min(hit_start, x[2]), max(hit_end, x[3]), gp, gn)


def _fold(entries, groups: bool):
    """Folds ranges (p, n, key, start, end, hit_start, hit_end), in order, from what
    is open at their begin.  ``groups``: (p, n, gp, gn), the group of every row; else
    one row a range with what is open at its end."""

    def run(batches):
        now = p = None
        done: list = []
        for batch in batches:
            out = []
            for q, n, key, *x in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if q != p:
                    if p is not None:
                        done.append((p, *now))
                    p, now = q, entries.value.get(q)
                if now is not None and now[0] == key and _touches(now, x):
                    now = _united(now, x)
                else:
                    now = (key, x[1], x[2], x[3], q, n)
                out.append((q, n, now[4], now[5]))
            if groups and out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["p", "n", "gp", "gn"])
        if not groups and p is not None:
            kinds = [pa.int64(), *[batch.schema.field(c).type for c in (2, 4, 5, 6)], pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, (p, *now)), kinds)], names=["p", "key", "end", "hit_start", "hit_end", "gp", "gn"])

    return run


def _groups(ordered: DataFrame) -> DataFrame:
    """(p, n, gp, gn) for staged rows (p, n, key, start, end, hit_start, hit_end): the place of
    the first row of each row's group.

    The driver holds one small row a range.  A range is folded again where its begin
    is not what it was folded with; where the open group takes in all of the range
    (its ends reach every row of it), what is open after it is known at once.
    """
    spark = ordered.sparkSession
    kinds = [ordered.schema[c].dataType.simpleString() for c in ("key", "end", "hit_start", "hit_end")]
    schema = "p long, " + OPEN.format(*kinds)
    facts = {
        r.p: r
        for r in ordered.groupBy("p").agg(
            F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.when(F.col("key").isNull(), 1)).alias("bare"), F.count("*").alias("n"),
            F.min_by("key", "n").alias("key"), F.max_by("key", "n").alias("last"), F.count(F.when(F.col("start").isNull() | F.col("hit_start").isNull() | F.col("hit_end").isNull(), 1)).alias("odd"),
            F.max("start").alias("start"), F.max("end").alias("end"), F.min("hit_start").alias("hs"), F.max("hit_start").alias("hs_max"), F.min("hit_end").alias("he_min"), F.max("hit_end").alias("he"),
        ).collect()
    }

    def folded(some: dict, chosen: DataFrame, groups: bool):
        shared = spark.sparkContext.broadcast(some)
        dealt = chosen.repartition("p").sortWithinPartitions("p", "n")
        return dealt.mapInArrow(_fold(shared, groups), "p long, n long, gp long, gn long" if groups else schema)

    def ends(rows):
        return {r.p: tuple(r)[1:] for r in rows}

    order = sorted(facts)
    used: dict = {p: None for p in order}
    # what is open at the end of a range concerns the next one if its last key goes on there, and only rows of that key tell it
    goes_on = [(p, facts[p].last) for p, q in zip(order, order[1:]) if facts[p].last == facts[q].key]
    lasts = F.broadcast(spark.createDataFrame(goes_on, f"lp long, lk {kinds[0]}"))  # a row a range at most
    tails = ordered.join(lasts, (F.col("p") == F.col("lp")) & F.col("key").eqNullSafe(F.col("lk"))).select(*ordered.columns)
    known = ends(folded({}, tails, False).collect()) if goes_on else {}
    while True:
        true: dict = {}
        wanted: list = []
        now = None
        for p in order:
            f = facts[p]
            same_key = f.low == f.high and f.bare in (0, f.n)
            begin = now if now is not None and now[0] == f.key else None
            true[p] = begin
            if begin is not None and same_key and not f.odd and None not in begin[1:4] and begin[1] >= f.start and begin[3] >= f.hs_max and f.he_min >= begin[2]:
                now = (begin[0], begin[1] if f.end is None else max(begin[1], f.end), min(begin[2], f.hs), max(begin[3], f.he), *begin[4:])
                continue
            if begin != used[p] and same_key:  # the end of a range of several keys does not depend on its begin
                wanted.append(p)
            now = known.get(p)
        if not wanted:
            break
        known.update(ends(folded({p: true[p] for p in wanted if true[p] is not None}, ordered.where(F.col("p").isin(wanted)), False).collect()))
        used.update({p: true[p] for p in wanted})
    return folded({p: g for p, g in true.items() if g is not None}, ordered, True)


def merge_hits(spans: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    """Per key, in order of start: the current group takes the next span iff the
    group's end reaches its start and their hit spans touch.  Ends and hit spans
    are united; labels are joined as first seen; the source caption is the first;
    types are distinct, sorted and joined.  A span that lacks a number it is compared by
    is a group of its own.
    """
    by = [F.col(key), F.col("start"), F.col(order)]
    fields = ["start", "end", "hit_start", "hit_end", "label", "source_caption", "source_type"]
    plain = staged(spans.select(F.col(key).alias("key"), F.col(order).alias("ord"), *fields), "spans")
    dealt = plain.repartitionByRange("key", "start", "ord", *fields[1:]).sortWithinPartitions("key", "start", "ord", *fields[1:]).withColumn("m", F.monotonically_increasing_id())
    ordered = staged(dealt.withColumns({"p": F.shiftright("m", 33), "n": F.col("m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("m"), "ordered")
    groups = _groups(ordered.select("p", "n", "key", "start", "end", "hit_start", "hit_end"))
    rows = ordered.join(groups, ["p", "n"])
    place = F.struct("p", "n")
    # first by label, so that a large group meets as few rows
    labels = rows.groupBy("key", "gp", "gn", "label").agg(
        F.min(place).alias("place"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("hit_start").alias("hit_start"), F.max("hit_end").alias("hit_end"),
        F.min_by(F.struct("source_caption"), place).alias("caption"), F.collect_set("source_type").alias("types"), F.count("*").alias("n"),
    )
    out = labels.groupBy("key", "gp", "gn").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("hit_start").alias("hit_start"), F.max("hit_end").alias("hit_end"),
        F.array_sort(F.collect_list(F.struct("place", "label"))).alias("labels"), F.min_by("caption", "place").alias("caption"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"), F.sum("n").alias("n"),
    )
    return out.select(
        F.col("key").alias(key), "start", "end", "hit_start", "hit_end", F.array_join(F.transform("labels", lambda x: x["label"]), ", ").alias("label"),
        F.coalesce("caption.source_caption", F.lit("")).alias("source_caption"),
        F.array_join(F.array_sort(F.filter("types", lambda t: F.coalesce(t, F.lit("")) != "")), ", ").alias("source_type"), F.col("n").cast("long").alias("n"),
    )


def running_end(df: DataFrame, key: str, order: str, end: str) -> DataFrame:
    """``df`` with the greatest end so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_end", F.max(end).over(w))
