"""The driver's tables seen as transcripts, videos, spans and clips.

Each view exists twice: as a DataFrame and as a DuckDB expression for the
oracles (``SQL``).  Times are whole milliseconds or microseconds, so both
engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread


LARGE = ("documents", "events", "lineitem", "orders")  #: those that grow with the scale factor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LARGE else df


def ytid(key) -> F.Column:
    return F.lpad(F.col(key).cast("string"), 11, "0")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-blank line of a document: 5 s each, ``seg`` from 0."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("seg", "cue")).where(F.trim("cue") != "")
    seg = F.col("seg").cast("long")
    return lines.select(
        "doc_id", "source", "lang", seg.alias("seg"), "cue",
        (seg * 5000).alias("start_ms"), (seg * 5000 + 5000).alias("end_ms"),
        (-((F.col("doc_id") * 31 + seg * 7) % 200) / F.lit(100.0)).alias("confidence"),
        ((F.col("doc_id") + seg) % 10 == 0).alias("retried"),
    )


def token_array(text: str = "text") -> F.Column:
    """A document's tokens in order, as structs (word, seg, start_ms, end_ms): each
    line's five seconds spread evenly over its tokens.  A line is split once, its
    tokens held in a variable."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda c, i: F.struct(c.alias("cue"), i.cast("long").alias("seg"))), lambda x: F.trim(x["cue"]) != "")

    def spread(x):
        def of(ws):
            at = lambda k: (x["seg"] * 5000 + F.floor(k.cast("long") * 5000 / F.size(ws))).cast("long")
            return F.transform(ws, lambda w, k: F.struct(w.alias("word"), x["seg"].alias("seg"), at(k).alias("start_ms"), at(k + 1).alias("end_ms")))

        return F.transform(F.array(F.split(F.trim(x["cue"]), r"\s+")), of)[0]

    return F.flatten(F.transform(lines, spread))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the cues, spread evenly; ``idx`` from 1.  Lines are laid out
    inside the row, so no shuffle is needed to number them."""
    return words_of(table(spark, sf_dir, "documents"))


def words_of(documents: DataFrame, *keep: str) -> DataFrame:
    """The words of documents (doc_id, source, text, ``keep``), in their order."""
    w = documents.select(*keep, "doc_id", "source", F.posexplode(token_array()).alias("pos", "w"))
    return w.select(
        *keep, ytid("doc_id").alias("ytid"), "doc_id", "source", (F.col("pos") + 1).cast("long").alias("idx"), "w.word", "w.seg", "w.start_ms", "w.end_ms",
        (-((F.col("doc_id") * 31 + F.col("w.seg") * 7) % 200) / F.lit(100.0)).alias("confidence"),
        ((F.col("doc_id") + F.col("w.seg")) % 10 == 0).alias("retried"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        ytid("o_orderkey").alias("ytid"), "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice",
        F.concat(F.lit("Show "), F.date_format(day, "MMMM d, yyyy"), F.lit(" - "), F.col("o_orderpriority")).alias("title"),
        day.alias("upload_date"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit windows of the users: a hit lasts ``value`` * 200 s, its window adds a
    minute on both sides."""
    e = table(spark, sf_dir, "events")
    hit = F.unix_micros(F.col("ts").cast("timestamp"))
    end = hit + F.floor(F.col("value") * 200).cast("long") * 1000000
    return e.select(
        F.col("user_id").alias("url"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"),
        (hit - 60000000).alias("start"), (end + 60000000).alias("end"), hit.alias("hit_start"), end.alias("hit_end"),
        F.concat(F.lit("src"), F.col("event_id") % 3).alias("source_type"), F.col("props").alias("source_caption"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    start = F.round(F.col("l_extendedprice").cast("decimal(12,2)") * F.lit("0.001").cast("decimal(4,3)"), 3).cast("decimal(12,3)")
    length = F.col("l_quantity").cast("decimal(12,3)")
    return line.select(F.col("l_orderkey").alias("id"), start.alias("start"), (start + length).cast("decimal(12,3)").alias("end"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")


def existing_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on disk already: three ways of rounding to two digits."""
    from ..functions.scalars import to_cents

    c = clips(spark, sf_dir).where("l_linenumber <= 3")
    pick = lambda x: F.when(F.col("l_partkey") % 3 == 0, to_cents(x, "half_up")).when(F.col("l_partkey") % 3 == 1, to_cents(x, "floor")).otherwise(to_cents(x, "ceiling"))
    return c.select("id", pick("start").alias("start"), pick("end").alias("end")).distinct()


# --- the same in DuckDB ---------------------------------------------------

CUES = """cues AS (
  SELECT doc_id, source, lang, seg, cue, seg * 5000 AS start_ms, seg * 5000 + 5000 AS end_ms,
         (-((doc_id * 31 + seg * 7) % 200))::DOUBLE / 100.0::DOUBLE AS confidence, (doc_id + seg) % 10 = 0 AS retried
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS cue, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS seg FROM documents)
  WHERE trim(cue) <> '')"""
WORDS = (
    CUES
    + r""", words AS (
  SELECT lpad(doc_id::VARCHAR, 11, '0') AS ytid, doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY seg, k) AS idx, word, seg,
         start_ms + (k * 5000) // n AS start_ms, start_ms + ((k + 1) * 5000) // n AS end_ms, confidence, retried
  FROM (SELECT doc_id, source, seg, start_ms, confidence, retried, unnest(w) AS word, (generate_subscripts(w, 1) - 1)::BIGINT AS k, len(w)::BIGINT AS n
        FROM (SELECT *, string_split_regex(trim(cue), '\s+') AS w FROM cues)))"""
)
VIDEOS = """videos AS (
  SELECT lpad(o_orderkey::VARCHAR, 11, '0') AS ytid, o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice,
         'Show ' || strftime(o_orderdate, '%B %-d, %Y') || ' - ' || o_orderpriority AS title, o_orderdate::DATE AS upload_date
  FROM orders)"""
SPANS = """spans AS (
  SELECT user_id AS url, event_id AS ord, event_type AS label, epoch_us(ts) - 60000000 AS start,
         epoch_us(ts) + floor(value * 200)::BIGINT * 1000000 + 60000000 AS "end", epoch_us(ts) AS hit_start,
         epoch_us(ts) + floor(value * 200)::BIGINT * 1000000 AS hit_end, 'src' || (event_id % 3) AS source_type, props AS source_caption
  FROM events)"""
CLIPS = """clips AS (
  SELECT *, start + l_quantity::DECIMAL(12,3) AS "end" FROM (
    SELECT l_orderkey AS id, round(l_extendedprice::DECIMAL(12,2) * 0.001::DECIMAL(4,3), 3)::DECIMAL(12,3) AS start,
           l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate, l_quantity FROM lineitem)),
existing AS (
  SELECT DISTINCT id, CASE l_partkey % 3 WHEN 0 THEN round(start * 100) WHEN 1 THEN floor(start * 100) ELSE ceil(start * 100) END::BIGINT AS s,
         CASE l_partkey % 3 WHEN 0 THEN round("end" * 100) WHEN 1 THEN floor("end" * 100) ELSE ceil("end" * 100) END::BIGINT AS e
  FROM clips WHERE l_linenumber <= 3)"""
