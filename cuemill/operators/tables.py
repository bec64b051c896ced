"""Selection, deduplication and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the order, which must break all ties.  The
    rank limit is applied before the shuffle as well, so a hot key sends one row
    per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def ranked_source(kind: Column, ranks: list[str]) -> Column:
    """The place of a kind in a priority list; unknown kinds come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranks)), kind), F.lit(0)), F.lit(len(ranks) + 1))


def best_source(df: DataFrame, key: str, kind: str, ranks: list[str], size: str, path: str) -> DataFrame:
    """Best kind, then larger, then first path."""
    return first_per_key(df, [key], [ranked_source(F.col(kind), ranks), F.col(size).desc(), F.col(path)])


def seen_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_per_key(df, keys, [F.col(order)])


def distinct_on(df: DataFrame, key: str, order: list) -> DataFrame:
    return first_per_key(df, [key], order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """``old`` updated by ``new`` (one row per key): columns in ``overwrite`` take
    the new value, those in ``fill`` take it unless it is NULL, others keep the
    old one.  New keys are added; columns that ``new`` lacks are NULL there."""
    o, n = old.alias("o"), new.alias("n")
    on = None
    for k in keys:
        part = F.col(f"o.{k}") == F.col(f"n.{k}")
        on = part if on is None else on & part
    is_new = F.col(f"n.{keys[0]}").isNotNull()
    is_old = F.col(f"o.{keys[0]}").isNotNull()

    def value(c):
        if c in keys or c in fill:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c in overwrite:
            return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c in new.columns:
            return F.when(is_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.col(f"o.{c}")

    return o.join(n, on, "full_outer").select(*[value(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys are not there yet."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def last_per_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key, the last in ``order`` (columns; the greatest of the other
    columns breaks ties, and decides alone if no order is given)."""
    rest = [c for c in df.columns if c not in keys and c not in (order or [])]
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in [*(order or []), *rest]] or [F.lit(1)])


def update(old: DataFrame, staged: DataFrame, key: str, column: str, changed_only: bool = True, order: list[str] | None = None) -> DataFrame:
    """``old`` with ``column`` taken from ``staged`` (key, column) by key, and
    whether that changed it; equal values and absent keys change nothing.  Of
    several staged rows of a key the last in ``order`` counts."""
    s = last_per_key(staged.select(key, column, *[c for c in order or [] if c not in (key, column)]), [key], order).select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    joined = old.join(s, F.col(key) == F.col("__k"), "left")
    changes = F.col("__k").isNotNull() & (~F.col(column).eqNullSafe(F.col("__v")) if changed_only else F.lit(True))
    return joined.select(*[F.when(changes, F.col("__v")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in old.columns], changes.alias("changed"))


def set_unset(df: DataFrame, column: str, value: str, scope: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Fill ``column`` where it is NULL or empty; with a scope, in its keys only."""
    unset = F.coalesce(F.col(column), F.lit("")) == ""
    if scope is None:
        return df.withColumn(column, F.when(unset, F.lit(value)).otherwise(F.col(column)))
    keys = scope.select(F.col(key).alias("__k")).distinct()
    joined = df.join(keys, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(column, F.when(unset & F.col("__k").isNotNull(), F.lit(value)).otherwise(F.col(column))).drop("__k")


def valid_interval(start: str, end: str) -> Column:
    return F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))


def known_source(source: str) -> Column:
    return F.when(F.lower(F.col(source)).isin("yt", "whisper"), F.lower(F.col(source))).otherwise("whisper")


def patched(rows: DataFrame, retries: DataFrame, keys: list[str], text: str | None = None, confidence: str = "confidence", order: list[str] | None = None) -> DataFrame:
    """Retried segments written back: text and confidence where the new text is
    not blank, or confidence and the retried mark of words (``text`` None).  Of
    several retries of a segment the last in ``order`` counts."""
    r = last_per_key(retries.select(*keys, "new_text", "new_confidence", *(order or [])), keys, order).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("new_text").alias("__text"), F.col("new_confidence").alias("__conf"))
    on = None
    for k in keys:
        part = F.col(k) == F.col(f"__{k}")
        on = part if on is None else on & part
    joined = rows.join(r, on, "left")
    hit = (F.trim("__text") != "") if text else F.col(f"__{keys[0]}").isNotNull()
    hit = F.coalesce(hit, F.lit(False))
    out = []
    for c in rows.columns:
        if c == confidence:
            out.append(F.when(hit, F.col("__conf")).otherwise(F.col(c)).alias(c))
        elif text and c == text:
            out.append(F.when(hit, F.trim("__text")).otherwise(F.col(c)).alias(c))
        elif c == "retried":
            out.append((F.col(c) | hit).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def word_chunks(words: DataFrame, key: str = "ytid", idx: str = "idx", size: int = 1000, overlap: int = 150) -> DataFrame:
    """Words in sliding chunks of ``size``, each with the last ``overlap`` words of the
    one before: (*columns, chunk), chunks from 0.  A word's chunks follow from its
    place (from 1), so no file is numbered or gathered; a last chunk of words that the
    one before has too is left out."""
    step = size - overlap
    if not 0 < step <= size:
        raise ValueError("the overlap must be at least 0 and less than the size")
    at = F.col(idx) - 1
    first = F.greatest(F.lit(0), F.floor((at - size) / step) + 1).cast("long")
    dealt = words.withColumn("chunk", F.explode(F.sequence(first, F.floor(at / step).cast("long"))))
    # the words of the last chunk but one end it; a chunk within them is none
    new = words.groupBy(F.col(key).alias("__k")).agg(F.max(idx).alias("__n"))
    return dealt.join(new, F.col(key).eqNullSafe(F.col("__k"))).where((F.col("chunk") == 0) | (F.col("__n") > F.col("chunk") * step + overlap)).drop("__k", "__n")
