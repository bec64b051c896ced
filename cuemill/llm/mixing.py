"""Mixing sources to target weights by Pareto order sampling, in SQL functions.

A source of ``size`` words that shall give ``target`` words takes every document
floor(target / size) times for certain.  The fraction left is sampled with
unequal inclusion probabilities: the odds of a document grow with the number of
binary digits of its length, so p = min(1, c * digits) with the c at which the
expected words are those that are missing.  Each document draws a fixed uniform
number u and gets the rank u/(1-u) divided by p/(1-p), random odds over
inclusion odds; the documents of smallest rank are taken until their words fill
what is left of the target.  The one that would overshoot is passed over and
ranks behind it go on, ``ROUNDS`` times.  What is then still missing is less
than about one document; it is topped up with further copies (``most`` at most)
of the shortest documents that fit, until none fits.

Ranks are cut without sorting a source: words are summed per source and rank
bin, the running sum over the bins (a bounded number) finds the bin in which
the border lies, and only that bin is ordered row by row.  Every document can
then tell from its own draw and its source's borders how often it is taken, so
no text is joined or shuffled by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, staged

MOST = 3  #: copies of a document, and a source's target over its size
BINS = 1 << 12
WEIGHTS = (1, 2, 3)
ROUNDS = 2  #: fillings by rank before the topping up


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, size, weight, target) of a table (source, size) with one row for
    each source.  Sources by code point, null last, weigh ``weights`` in turn and
    share the sum of all sizes; no target exceeds ``most`` times its size, what
    is above is shared by weight among the others until none is above.

    Such shares are min(most * size, level * weight).  With the sources in order
    of most * size / weight, the level is what the sources before one leave,
    over the weights from it on, for the first that this level does not fill.
    """
    everything = Window.partitionBy()  # one row per source, so only their names meet
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    df = sums.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn))
    df = df.withColumn("limit", F.col("size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    df = df.withColumn("at", F.row_number().over(by_ratio))
    df = df.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    open_ = F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct("at", "level"))
    df = df.withColumn("final", F.min(open_).over(everything)["level"])
    return df.select("source", "size", "weight", F.coalesce(F.least("limit", F.col("final") * F.col("weight")), F.col("limit")).alias("target"))


def odds(classes: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``ps``, the inclusion probability by number of binary digits:
    min(1, c * digits) such that the expected words are ``gap``.  The classes of
    longest documents are certain up to the first at which c * digits is not."""
    plan = plan.select("s", "gap")
    df = classes.join(plan, classes.source.eqNullSafe(plan.s)).where("gap > 0 and words > 0")
    own = Window.partitionBy("s")
    before = own.orderBy(F.col("digits").desc()).rowsBetween(Window.unboundedPreceding, -1)
    product = F.col("words") * F.col("digits")
    rest = F.sum(product).over(own) - F.coalesce(F.sum(product).over(before), F.lit(0))
    df = df.withColumn("level", (F.col("gap") - F.coalesce(F.sum("words").over(before), F.lit(0))) / rest)
    open_ = F.when(F.col("level") * F.col("digits") <= 1, F.struct((-F.col("digits")).alias("at"), "level"))
    df = df.withColumn("c", F.coalesce(F.min(open_).over(own)["level"], F.lit(1.0)))
    p = F.least(F.lit(1.0), F.col("c") * F.col("digits"))
    return df.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("digits", p.alias("p")))).alias("ps"))


def _border(open_: DataFrame, bin_: str, words: Column) -> DataFrame:
    """Of each source ``s`` whose open rows exceed ``gap`` in the order of ``bin``
    and ``key``: the key ``stop`` at which they do and the words before it; for
    the other sources all their words and no stop.  Rows of one key are one."""
    bins = open_.groupBy("s", F.col(bin_).alias("bin")).agg(F.sum(words).alias("words"), F.first("gap").alias("gap"))
    running = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("sum", F.sum("words").over(running))
    border = bins.groupBy("s").agg(
        F.min(F.when(F.col("sum") > F.col("gap"), F.struct("bin", (F.col("sum") - F.col("words")).alias("before")))).alias("b"),
        F.sum("words").alias("all"),
    )
    at = open_.join(border.select(F.col("s").alias("t"), "b"), F.col("s").eqNullSafe(F.col("t")) & (F.col(bin_) == F.col("b.bin")))
    peers = Window.partitionBy("s").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("peers", F.col("b.before") + F.sum(words).over(peers))
    cut = at.groupBy("s").agg(
        F.min(F.when(F.col("peers") > F.col("gap"), F.col("key"))).alias("stop"),
        F.max(F.when(F.col("peers") <= F.col("gap"), F.col("peers"))).alias("inside"),
    )
    both = border.join(cut.select(F.col("s").alias("t"), "stop", "inside"), F.col("s").eqNullSafe(F.col("t")), "left")
    return both.select(
        F.col("s").alias("t"),
        "stop",
        F.when(F.col("b").isNull(), F.col("all")).otherwise(F.coalesce("inside", "b.before")).alias("words"),
    )


def _fill(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with the border of one more filling by rank: of the rows behind
    ``after`` that fit into the gap, those before ``stop`` are taken."""
    kind = rows.schema["key"].dataType
    open_ = rows.join(plan, rows.source.eqNullSafe(plan.s)).where((F.col("p") > 0) & _within(F.struct("after", F.lit(None).cast(kind).alias("stop"), "gap")))
    got = _border(open_, "bin", F.col("size"))
    out = plan.join(got, plan.s.eqNullSafe(got.t), "left").drop("t")
    entry = F.struct(F.col("after"), F.col("stop"), F.col("gap"))
    end = F.struct(F.lit(float("inf")).alias("rank"), *[F.lit(None).cast(kind[k].dataType).alias(k) for k in ("id", "size")])  # all that fit are taken
    return staged(
        out.select(
            "s", "source_size", "target", "certain", "tops",
            F.concat("fills", F.array(entry)).alias("fills"),
            (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"),
            F.coalesce("stop", end).alias("after"),
        ),
        "plan",
    )


def _within(fill: Column) -> Column:
    fits = (F.col("size") > 0) & (F.col("size") <= fill["gap"])
    return fits & (fill["after"].isNull() | (F.col("key") > fill["after"])) & (fill["stop"].isNull() | (F.col("key") < fill["stop"]))


def _top_up(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``plan`` with one more topping up: rows behind ``top`` by length and key
    that fit get all the copies that are left to them, those at the border as
    many as the gap still holds.  Only where equal rows, which are one, do not
    fit together, the gap stays open for those behind them."""
    own = rows.join(plan, rows.source.eqNullSafe(plan.s)).withColumn("left", most - _copies(most)).withColumn("key", F.struct("size", "key"))
    open_ = own.where((F.col("left") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.col("top").isNull() | (F.col("key") > F.col("top"))))
    got = _border(open_, "size", F.col("size") * F.col("left"))
    at = open_.join(got.select(F.col("t").alias("o"), F.col("stop").alias("x")), F.col("s").eqNullSafe(F.col("o")) & (F.col("key") == F.col("x")))
    equal = at.groupBy(F.col("s").alias("e")).agg(F.sum("size").alias("equal"), F.count("*").alias("same"))
    out = plan.join(got, plan.s.eqNullSafe(got.t), "left").join(equal, plan.s.eqNullSafe(F.col("e")), "left").drop("t", "e")
    rest = F.col("gap") - F.coalesce("words", F.lit(0))
    more = F.coalesce(F.floor(rest / F.col("equal")), F.lit(0)).cast("long")
    entry = F.struct(F.col("top").alias("after"), F.col("stop"), F.col("gap"), more.alias("more"))
    return staged(
        out.select(
            "s", "source_size", "target", "certain", "fills", "after",
            F.concat("tops", F.array(entry)).alias("tops"),
            F.when(F.col("same") > 1, rest - more * F.col("equal")).otherwise(-1.0).alias("gap"),
            F.coalesce("stop", "top").alias("top"),
        ),
        "plan",
    )


def _sampled() -> Column:
    """Copies of a row: the certain ones, and one if a filling reached it."""
    inside = F.exists("fills", lambda x: _within(x))
    return F.col("certain") + F.when((F.col("p") > 0) & inside, 1).otherwise(0)


def _copies(most: int) -> Column:
    """Copies of a row of ``size``, ``p`` and ``key`` under its source's plan."""

    def top(n, t):
        own = F.struct("size", "key")
        fits = (F.col("size") > 0) & (F.col("size") <= t["gap"]) & (t["after"].isNull() | (own > t["after"]))
        return F.when(fits & (t["stop"].isNull() | (own < t["stop"])), F.lit(most).cast("long")).when(fits & (own == t["stop"]), n + t["more"]).otherwise(n)

    return F.aggregate("tops", _sampled().cast("long"), top)


def _drawn(rows: DataFrame, odds_: DataFrame, bins: int) -> DataFrame:
    """``rows`` (source, size, u, ...) with ``p``, ``key`` and ``bin``."""
    df = rows.join(odds_.withColumnRenamed("s", "o"), rows.source.eqNullSafe(F.col("o")), "left").drop("o")
    df = df.withColumn("p", F.coalesce(F.try_element_at("ps", _digits()), F.lit(0.0))).drop("ps")
    rank = F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    df = df.withColumn("key", F.struct(rank.alias("rank"), "id", "size"))
    return df.withColumn("bin", F.floor(F.col("key.rank") / (1 + F.col("key.rank")) * bins).cast("int"))


def _digits() -> Column:
    return F.length(F.bin("size"))


def _own(docs: DataFrame, id_col: str, text: str, source: str, seed: str) -> list[Column]:
    u = keyed(seed, F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    return [F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), sizes(docs, text).alias("size"), u.alias("u")]


def planned(rows: DataFrame, weights=WEIGHTS, most: int = MOST, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """(plan, odds) of ``rows`` (id, source, size, u): one row for each source."""
    classes = staged(rows.groupBy("source", _digits().alias("digits")).agg(F.sum("size").alias("words")), "classes")
    plan = targets(classes.groupBy("source").agg(F.sum("words").alias("size")), weights, most)
    certain = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(most))).otherwise(0).cast("long")
    key = "struct<rank:double,id:{},size:bigint>".format(rows.schema["id"].dataType.simpleString())
    top = f"struct<size:bigint,key:{key}>"
    none = lambda kind: F.expr("array()").cast(f"array<{kind}>")
    plan = staged(
        plan.select(
            F.col("source").alias("s"), F.col("size").alias("source_size"), "target", certain.alias("certain"),
            none(f"struct<after:{key},stop:{key},gap:double>").alias("fills"),
            none(f"struct<after:{top},stop:{top},gap:double,more:bigint>").alias("tops"),
            F.greatest(F.col("target") - certain * F.col("size"), F.lit(0.0)).alias("gap"),
            F.lit(None).cast(key).alias("after"),
        ),
        "plan",
    )
    odds_ = staged(odds(classes, plan), "odds")
    drawn = _drawn(rows, odds_, bins)
    for _ in range(ROUNDS):
        plan = _fill(drawn, plan)
    plan = _top_up(drawn, plan.withColumn("top", F.lit(None).cast(top)), most)
    while not plan.where("gap > 0").isEmpty():
        plan = _top_up(drawn, plan, most)
    return plan.drop("gap", "after", "top"), odds_


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", weights=WEIGHTS, most: int = MOST, bins: int = BINS) -> DataFrame:
    """(id, source, size, source_size, target, p, copies, taken) of every row.

    The draw depends on ``seed``, id and text alone, so reruns agree; rows equal
    in id, source and text are one and share their fate.  Null texts and texts
    without words have size 0, cost nothing and get the certain copies only.  A
    very long text that would overshoot is passed over.  Sources are one row each
    in a window over all of them.  Other columns are ignored.  An empty table
    gives an empty result.
    """
    own = staged(docs.select(*_own(docs, id_col, text, source, seed)), "sizes")
    plan, odds_ = planned(own, weights, most, bins)
    out = _drawn(own, odds_, bins)
    out = out.join(plan, out.source.eqNullSafe(plan.s)).withColumn("copies", _copies(most))
    return out.select("id", "source", "size", "source_size", "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", weights=WEIGHTS, most: int = MOST, bins: int = BINS) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` takes at least once, with ``copies``
    and ``taken`` (columns of these names are replaced).  Each row is judged by
    its own draw and its source's plan, so texts are neither joined nor shuffled
    by id; other columns pass through, whatever their names."""
    kept = [c for c in docs.columns if c.lower() not in ("copies", "taken")]
    own = staged(docs.select(*_own(docs, id_col, text, source, seed)), "sizes")
    plan, odds_ = planned(own, weights, most, bins)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), *_own(docs, id_col, text, source, seed))
    out = _drawn(rows, odds_, bins)
    out = out.join(plan, out.source.eqNullSafe(plan.s)).withColumn("copies", _copies(most)).where("copies > 0")
    return out.select(*[F.col("d")[c].alias(c) for c in kept], "copies", (F.col("copies") * F.col("size")).alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    out = mixed(docs.select("doc_id", "source", "text"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")
