"""Quality rules by distribution divergence, in SQL functions only.

A document's histogram of character classes and its histogram of common words
are held against those of its language.  Both references, and which ``TOP`` words
are a language's commonest, are counted over the whole table, for every value of
``lang``.  The measure is the Jensen-Shannon distance (square root of the divergence to
base 2, 0 to 1).  Short documents have ragged histograms; below the minimum
lengths a histogram is not judged.

A document's own measures stay inside its row, so a text of any length costs its
own task only; what is shuffled are word counts, summed in each task beforehand,
and one small row per language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, flat, nested, staged

TOP = 30  #: commonest words of a language that make its histogram
LETTERS = r"^[\p{L}']+$"

#: A histogram is judged from so many characters or words on.
MIN_CHARS, MIN_WORDS = 200, 40
#: A document at a greater distance is rejected.  The word histogram of n words
#: strays from its source by about 1/sqrt(n) by chance, which is allowed on top.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, WORD_NOISE = 0.3, 0.2, 1.3
SHINGLE = 5

#: Classes in the order in which they are taken out of the text.
CLASSES = [
    ("lower", "[a-z]+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("stop", "[.,;:'\"!?()-]+"),
    ("mark", r"[\x00-\x7F]+"),
    ("wide", None),
]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once and held in a variable."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words: runs of anything but the six ASCII white-space characters."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def window_hashes(words: Column, width: int = SHINGLE) -> Column:
    """64-bit hashes of all windows of ``width`` words, from the words and their
    shifted copies side by side; none of a text of ``width`` words or fewer."""
    n = F.size(words) - width + 1
    windows = F.arrays_zip(*[F.slice(words, k + 1, n) for k in range(width)])
    return F.when(F.size(words) > width, F.transform(windows, lambda x: F.xxhash64(x))).otherwise(F.expr("array()").cast("array<bigint>"))


def repeated_words(h: Column, width: int = SHINGLE) -> Column:
    """Words inside windows of ``width`` words found twice or more, by the windows'
    hashes, which are compared inside one text."""

    def covered(starts):
        step = F.transform(starts, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - x, F.lit(width))))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def twice(sorted_):
        same = lambda x, i: F.get(sorted_, i - 1)["h"].eqNullSafe(x["h"]) | F.get(sorted_, i + 1)["h"].eqNullSafe(x["h"])
        return let(F.sort_array(F.transform(F.filter(sorted_, same), lambda x: x["i"])), covered)

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, twice)).otherwise(0)


def common_of(text: Column, words: Column) -> Column:
    """The words of ``text`` that are among ``words``, bare, in one search of the whole text."""
    pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.array_join(words, "|"), F.lit(r")(?=[.,;:!?]*+(?:[\x20\x09-\x0D]|\z))"))
    return F.when(words.isNotNull(), F.regexp_extract_all(F.lower(text), pattern, F.lit(0))).otherwise(F.expr("array()").cast("array<string>"))


def bare(word: Column) -> Column:
    """A word in lower case without the punctuation behind it."""
    return F.lower(F.rtrim(word, F.lit(".,;:!?")))


def top_words(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(__top, words): the commonest words of each language, ties by code point.
    The rank is limited in each task before the languages meet."""
    words = docs.select(F.col(f"`{lang}`").alias("lang"), F.explode(words_of(F.col(f"`{text}`"))).alias("w")).where("lang is not null")
    counts = words.groupBy("lang", bare(F.col("w")).alias("w")).agg(F.count("*").alias("n")).where(F.col("w").rlike(LETTERS))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "w"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.groupBy(F.col("lang").alias("__top")).agg(F.collect_list("w").alias("words"))


def measured(docs: DataFrame, tops: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(d, q): the rows of ``docs`` as a struct, and their counts and histograms."""
    df = nested(docs)
    df = df.join(tops, F.col("d")[lang] == F.col("__top"), "left")
    df = df.withColumn("t0", F.coalesce(F.col("d")[text], F.lit("")))
    df = df.withColumn("w", words_of(F.col("t0")))
    df = df.withColumn("h", window_hashes(F.col("w"))).withColumn("word_chars", F.length(F.array_join("w", "")))
    # letters and spaces go at once, as long runs; the spaces are what the words lack
    df = df.withColumn("t2", F.regexp_replace("t0", r"[a-z\x20\x09-\x0D]+", ""))
    for k, (_, pattern) in enumerate(CLASSES[2:-1], 2):
        df = df.withColumn(f"t{k + 1}", F.regexp_replace(f"t{k}", pattern, ""))
    space = F.length("t0") - F.col("word_chars")
    sizes = [F.length(f"t{k}") for k in range(2, len(CLASSES))]
    sizes = [F.length("t0") - sizes[0] - space, space, *[a - b for a, b in zip(sizes, sizes[1:])], sizes[-1]]
    classes = F.array(*[n.cast("double") for n in sizes])
    rest = F.length("t2") - F.length(F.regexp_replace("t2", r"[#*$%&|<>]+", ""))
    lines = F.filter(F.split("t0", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = common_of(F.col("t0"), F.col("words"))
    counted = let(common, lambda c: F.transform(F.array_distinct(c), lambda w: F.struct(w.alias("w"), (F.size(c) - F.size(F.array_remove(c, w))).alias("n"))))
    q = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        rest.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("h")).cast("long").alias("n_repeat_words"),
        classes.alias("classes"),
        counted.alias("common"),
        F.col("d")[lang].alias("lang"),
    )
    return df.select("d", q.alias("q"))


def histograms(own: DataFrame) -> DataFrame:
    """One row per language: the shares of character classes and of common words
    over all of ``measured``."""
    df = own.select("q.*").where("lang is not null")
    sums = df.groupBy("lang").agg(
        F.sum("n_words").alias("n"), *[F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CLASSES))]
    )
    total = sum(F.col(f"c{k}") for k in range(len(CLASSES)))
    classes = sums.select("lang", "n", F.array(*[F.col(f"c{k}") / F.greatest(total, F.lit(1.0)) for k in range(len(CLASSES))]).alias("ref_classes"))
    words = (
        df.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.w").agg(F.sum("x.n").alias("n"))
        .groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("counts"))
    )
    return classes.join(words, "lang", "left").select(
        F.col("lang").alias("__lang"),
        "ref_classes",
        F.transform_values(F.coalesce("counts", F.expr("map()").cast("map<string,bigint>")), lambda _, n: n / F.greatest(F.col("n"), F.lit(1))).alias("ref_words"),
    )


def _part(p: Column, q: Column) -> Column:
    """What one class adds to twice the divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)))


def char_distance(classes: Column, ref: Column) -> Column:
    def of(total):
        shares = F.zip_with(classes, ref, lambda c, q: F.struct((c / F.greatest(total, F.lit(1.0))).alias("p"), q.alias("q")))
        return F.aggregate(shares, F.lit(0.0), lambda a, x: a + _part(x["p"], x["q"]))

    return _distance(let(F.aggregate(classes, F.lit(0.0), lambda a, x: a + x), of))


def word_distance(common: Column, n: Column, ref: Column) -> Column:
    """Over the common words and one class for all other words."""
    n = F.greatest(n, F.lit(1)).cast("double")
    shares = F.transform(common, lambda x: F.struct((x["n"] / n).alias("p"), F.coalesce(F.try_element_at(ref, x["w"]), F.lit(0.0)).alias("q")))
    ends = F.struct(
        F.aggregate(common, F.lit(0), lambda a, x: a + x["n"]).alias("m"),
        F.aggregate(F.map_values(ref), F.lit(0.0), lambda a, x: a + x).alias("known"),
    )

    def of(e):
        rest = let(F.struct((1 - e["m"] / n).alias("p"), F.greatest(1 - e["known"], F.lit(0.0)).alias("q")), lambda x: _part(x["p"], x["q"]))
        # a common word that the document lacks adds its reference share
        return F.aggregate(shares, rest + e["known"], lambda a, x: a + _part(x["p"], x["q"]) - x["q"])

    return _distance(let(ends, of))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, with_text: bool = True) -> DataFrame:
    """(d, v): the rows of ``docs`` as a struct, and a struct of the counts, both
    distances (null below the minimum length), ``base_failed`` and ``kept``.

    Null texts are empty texts and fail the base rule.  Rows of one language, by
    any name, are held against that language only; rows of a null language have
    none to be held against and are judged by the base rule alone, as a mixture
    of scripts would condemn the rarer ones.  A very long text costs its own task;
    at a distance equal to the limit a document stays; repeated rows get equal
    verdicts; columns of ``docs`` pass through untouched, whatever their names,
    the text only with ``with_text``; an empty table stays empty.  The measures
    are staged, the references are summed from them and held against them.
    """
    kept = [c for c in docs.columns if with_text or c.lower() != text.lower()]
    own = measured(docs, staged(top_words(docs, text, lang), "top"), text, lang).select(F.struct(*[F.col("d")[c].alias(c) for c in kept]).alias("d"), "q")
    own = staged(own, "measured")
    refs = staged(histograms(own), "references")
    q = F.col("q")
    df = own.join(refs, q["lang"] == F.col("__lang"), "left")
    chars = F.when(q["word_chars"] >= MIN_CHARS, char_distance(q["classes"], F.col("ref_classes")))
    words = F.when(q["n_words"] >= MIN_WORDS, word_distance(q["common"], q["n_words"], F.col("ref_words")))
    base = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    far = F.coalesce(F.col("c") > max_char, F.lit(False)) | F.coalesce(F.col("w") > max_word + WORD_NOISE / F.sqrt(q["n_words"]), F.lit(False))
    v = F.struct(*[q[c].alias(c) for c in counts], F.col("c").alias("char_distance"), F.col("w").alias("word_distance"), base.alias("base_failed"), (~base & ~far).alias("kept"))
    return df.select("d", "q", chars.alias("c"), words.alias("w")).select("d", v.alias("v"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, columns unchanged."""
    return flat(judged(docs).where("v.kept"), docs.columns)


def report(docs: DataFrame) -> DataFrame:
    out = judged(docs.select("doc_id", "text", "lang"), with_text=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("d.doc_id", *[F.col(f"v.{c}").alias(c) for c in names])
