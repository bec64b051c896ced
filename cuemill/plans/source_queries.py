"""Readers and writers over files: each query writes a driver table in the
grammar of a file, into the folder that driver and executors share, and reads it
back with the reader; the oracle says from the table what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import recon as R
from ..operators import tables as T
from ..sources import files, schemas, sinks
from ..sources.key_files import write_dealt, write_files
from ..sources.shared import folder as _shared
from ..sources.shared import staged
from . import views
from .registry import query
from .views import CUES, WORDS, table


def _written(spark, df: DataFrame, key: str, order: list[str], line, head: str = "") -> str:
    """A text file for each ``key`` (a folder with one part): ``head``, then the
    lines in order.  One file's lines are one value, as its reader takes it whole."""
    folder = _shared(spark)
    rows = df.select(F.col(key).alias("key"), F.struct(F.struct(*order).alias("o"), line.alias("line")).alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows.select("key", F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("value")).write.partitionBy("key").text(folder)
    return folder


def _table_written(spark, df: DataFrame, key: str, order: list[str], lines, head: str, part: int) -> str:
    """A table of text for each ``key``, as large jobs write them: compressed parts that
    follow each other by name, each with ``head``.  Rows are dealt by ranges of the first
    column of ``order``, about ``part`` of them each; ``lines`` makes the lines of rows
    (name, ...) in their order where they are written.  No task holds a key's lines."""
    folder, at = _shared(spark), F.col(order[0])
    by_key = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n"), F.percentile_approx(at, [i / 256 for i in range(1, 256)], 10000).alias("q"))
    cuts = staged(by_key.select("__k", F.array_distinct(F.filter("q", lambda x, i: (i + 1) % F.ceil(F.lit(256 * part) / F.col("n")) == 0)).alias("cuts")), "cuts")
    name = F.format_string("%s.part-%06d.tsv.gz", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.size(F.filter("cuts", lambda c: c < at)))
    rows = df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("__k"))).select(name.alias("name"), *df.columns)
    write_dealt(lines(rows.repartition("name").sortWithinPartitions("name", *order)).select("name", "line"), folder, head)
    return folder


def _word_documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "text")


def _word_lines(line, keep="true"):
    """The lines of documents' words in order; ``line`` makes one of the words view's columns."""
    return lambda rows: views.words_of(rows, "name").where(keep).select("name", line.alias("line"))


def _tabs(*columns):
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


# --- word tables ------------------------------------------------------------

DOCUMENTS = 1000  #: whose words are about one part of a table


@query(
    f"""WITH {WORDS}, kept AS (SELECT source, doc_id, idx, word, start_ms, end_ms, seg, retried, row_number() OVER (PARTITION BY source ORDER BY doc_id, idx) AS n FROM words WHERE idx % 50 <> 7)
SELECT doc_id, n AS idx, word, CASE WHEN idx % 40 = 3 THEN 0 ELSE start_ms END AS start_ms, end_ms, seg, retried FROM kept"""
)
def words_file_by_header(spark, sf):
    """Unreadable starts go, empty ones are 0, and the kept rows are counted."""
    start = F.when(F.col("idx") % 50 == 7, "bad").when(F.col("idx") % 40 == 3, "").otherwise((F.col("start_ms") / 1000).cast("string"))
    line = _tabs(start, F.col("end_ms") / 1000, F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")), F.col("seg"), F.lit("-0.5"), F.col("retried").cast("int"))
    got = files.words_by_header(spark, _table_written(spark, _word_documents(spark, sf), "source", ["doc_id"], _word_lines(line), "Start\tend\tword\tseg\tconfidence\tretried\n", DOCUMENTS))
    own = F.split("word", ":", 2)
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return got.select(own[0].cast("long").alias("doc_id"), F.col("idx").cast("long").alias("idx"), own[1].alias("word"), ms("start"), ms("end"), F.col("seg").cast("long").alias("seg"), "retried")


@query(f"WITH {WORDS} SELECT ytid, 'https://www.youtube.com/watch?v=' || ytid AS url, word, start_ms, CASE WHEN idx % 3 <> 0 THEN end_ms END AS end_ms FROM words WHERE idx % 20 <> 4 AND idx % 30 <> 5 AND NOT contains(word, ',')")
def words_file_by_alias(spark, sf):
    """Other column names and commas for tabs; blank words and unreadable starts go."""
    word = F.when(F.col("idx") % 20 == 4, " ").otherwise(F.col("word"))
    start = F.when(F.col("idx") % 30 == 5, "x").otherwise((F.col("start_ms") / 1000).cast("string"))
    end = F.when(F.col("idx") % 3 == 0, "").otherwise((F.col("end_ms") / 1000).cast("string"))
    lines = _word_lines(F.concat_ws(",", word, start, end, "ytid"), "NOT contains(word, ',')")
    got = files.words_by_alias(spark, _table_written(spark, _word_documents(spark, sf), "source", ["doc_id"], lines, "token,time,stop,video_id\n", DOCUMENTS))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return got.select("ytid", "url", "word", ms("start"), ms("end"))


@query(f"WITH {WORDS} SELECT word, CASE WHEN idx % 25 = 6 THEN 0 ELSE start_ms END AS start_ms, seg, retried, count(*) AS n FROM words WHERE idx % 10 <> 9 GROUP BY ALL")
def words_file_strict(spark, sf):
    """Rows shorter than the header go; unreadable numbers are 0."""
    start = F.when(F.col("idx") % 25 == 6, "x").otherwise((F.col("start_ms") / 1000).cast("string"))
    full = _tabs(start, F.col("end_ms") / 1000, F.col("word"), F.col("seg"), F.col("confidence"), F.col("retried").cast("int"))
    line = F.when(F.col("idx") % 10 == 9, _tabs(start, F.col("word"))).otherwise(full)
    got = files.words_strict(spark, _table_written(spark, _word_documents(spark, sf), "source", ["doc_id"], _word_lines(line), "start\tend\tword\tseg\tconfidence\tretried\n", DOCUMENTS))
    return got.groupBy("word", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), F.col("seg").cast("long").alias("seg"), "retried").agg(F.count("*").alias("n"))


@query(f"WITH {WORDS} SELECT ytid, source, idx, CASE WHEN word <> '' THEN word END AS word, start_ms, end_ms, CASE WHEN idx % 7 <> 0 THEN seg END AS segment_id FROM words")
def words_file_bulk(spark, sf):
    """A typed staging load; an empty field is NULL, quotes are kept as they are."""
    line = _tabs(F.col("ytid"), F.col("source"), F.col("idx"), F.col("word"), (F.col("start_ms") / 1000).cast("decimal(10,3)"), (F.col("end_ms") / 1000).cast("decimal(10,3)"), F.lit("-0.5"), F.when(F.col("idx") % 7 != 0, F.col("seg")))
    folder = _table_written(spark, _word_documents(spark, sf), "source", ["doc_id"], _word_lines(line), "ytid\tsource\tidx\tword\tstart_sec\tend_sec\tconfidence\tsegment_id\n", DOCUMENTS)
    got = files.bulk(spark, folder, schemas.WORDS)
    ms = lambda c: (F.col(f"{c}_sec") * 1000).cast("long").alias(f"{c}_ms")
    return got.select("ytid", "source", F.col("idx").cast("long").alias("idx"), "word", ms("start"), ms("end"), F.col("segment_id").cast("long").alias("segment_id"))


# --- captions and logs ------------------------------------------------------

FOLDERS = 256  #: for the files of single recordings, of which there are very many

_PLAIN = r"trim(regexp_replace(regexp_replace(cue, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


def _own_cues(spark, sf):
    return views.cues(spark, sf).select("doc_id", "seg", "confidence", "retried", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), S.plain("cue").alias("text"))


def _doc_of(file: str = "file"):
    return F.split(file, r"\.")[0].cast("long").alias("doc_id")


@query(f"WITH {CUES} SELECT doc_id, start_ms, end_ms, {_PLAIN} AS text, round(confidence, 3) AS confidence, retried AND confidence <> 0 AS retried FROM cues WHERE {_PLAIN} <> ''")
def captions_written_and_read(spark, sf):
    """Cues to caption files, one per document, and back: notes, marks, style words behind the end."""
    folder = _shared(spark)
    sinks.transcript_files(_own_cues(spark, sf), folder, "vtt", "doc_id", end=F.lit(" align:start"), folders=FOLDERS)
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return files.cues(spark, folder, below=True).select(_doc_of(), ms("start"), ms("end"), "text", "confidence", "retried")


@query(f"WITH {CUES} SELECT doc_id, printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, 0) AS raw_start, {_PLAIN} || chr(10) AS raw_text FROM cues WHERE {_PLAIN} <> ''")
def captions_raw(spark, sf):
    """The patcher's view of the same files: times and line breaks as written."""
    got = files.cues_of(sinks.vtt(_own_cues(spark, sf), "doc_id"), keep=("doc_id",))
    return got.select("doc_id", "raw_start", F.concat(F.rtrim(F.regexp_replace("raw_text", r"\n+$", "")), F.lit("\n")).alias("raw_text"))


@query(f"WITH {CUES} SELECT doc_id, count(*) AS cues, md5(string_agg({_PLAIN}, chr(10) ORDER BY seg)) AS body FROM cues WHERE {_PLAIN} <> '' GROUP BY doc_id")
def transcript_text_files(spark, sf):
    """Plain text and numbered subtitles of a transcript hold the same lines."""
    folder = _shared(spark)
    for kind in ("srt", "txt"):
        sinks.transcript_files(_own_cues(spark, sf), f"{folder}/{kind}", kind, "doc_id", folders=FOLDERS)
    numbered = files.whole_below(spark, f"{folder}/srt", "srt").select(_doc_of(), F.regexp_count("value", F.lit(r"(?m)^[0-9:]+,[0-9]{3} --> [0-9:]+,[0-9]{3}$")).cast("long").alias("cues"))
    return files.whole_below(spark, f"{folder}/txt", "txt").select(_doc_of(), F.md5("value").alias("body")).join(numbered, "doc_id")


@query(
    f"""WITH {CUES}, own AS (SELECT doc_id, seg, start_ms // 1000 AS sec, {_PLAIN} AS caption FROM cues WHERE {_PLAIN} <> ''),
n AS (SELECT *, lag(sec) OVER (PARTITION BY doc_id ORDER BY seg) AS before FROM own)
SELECT doc_id, count(*) AS lines, count_if(before IS NULL)::BIGINT AS firsts FROM n GROUP BY doc_id"""
)
def stamped_log_files(spark, sf):
    """Logs stamped at most once in ten seconds: all lines are there, the first is stamped."""
    folder = _shared(spark)
    sinks.transcript_files(_own_cues(spark, sf).where("text <> ''"), folder, "tslog.txt", "doc_id", folders=FOLDERS)
    log = files.whole_below(spark, folder, "txt").select(_doc_of(), F.split("value", "\n").alias("lines"))
    first = F.element_at("lines", 1).rlike(r"^\[[0-9]{2}:[0-9]{2}:[0-9]{2}\] ").cast("long")
    return log.select("doc_id", F.size("lines").cast("long").alias("lines"), first.alias("firsts"))


# --- metadata and lists -----------------------------------------------------


@query(
    """SELECT lpad(s_suppkey::VARCHAR, 11, '0') AS ytid, CASE WHEN s_suppkey % 3 = 0 THEN 'https://example.org/' || s_suppkey ELSE 'https://example.org/o/' || s_suppkey END AS url, s_name || ' x' AS title,
  CASE WHEN s_suppkey % 5 <> 0 THEN '2021-01-05' END AS upload_date, (s_suppkey % 100)::INT AS duration_sec, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'up ' || s_name END AS channel, 'none' AS availability, s_suppkey % 4 = 0 AS has_audio FROM supplier WHERE s_suppkey % 17 <> 0"""
)
def metadata_documents(spark, sf):
    """Metadata files as videos: fallbacks, line breaks, impossible dates; unreadable files go."""
    k = F.col("s_suppkey")
    doc = F.to_json(
        F.struct(
            F.lpad(k.cast("string"), 11, "0").alias("id"), F.when(k % 3 == 0, F.concat(F.lit("https://example.org/"), k.cast("string"))).alias("webpage_url"), F.concat(F.lit("https://example.org/o/"), k.cast("string")).alias("original_url"),
            F.concat("s_name", F.lit("\nx")).alias("title"), F.when(k % 5 == 0, "20210230").otherwise("20210105").alias("upload_date"), (k % 100 + 0.7).alias("duration"),
            F.when(k % 2 == 0, F.col("s_name")).alias("channel"), F.concat(F.lit("up "), "s_name").alias("uploader"), F.array(F.struct(F.when(k % 4 == 0, "opus").otherwise("none").alias("acodec"))).alias("formats"),
        )
    )
    folder = _written(spark, table(spark, sf, "supplier"), "s_suppkey", ["s_suppkey"], F.when(k % 17 == 0, "{broken").otherwise(doc))
    got = files.info(spark, folder)
    return got.select("ytid", "url", "title", F.col("upload_date").cast("string").alias("upload_date"), "duration_sec", "channel", "availability", "has_audio")


@query("SELECT lpad(s_suppkey::VARCHAR, 11, '0') AS id, 'https://example.org/' || s_suppkey AS url, s_name AS title, s_acctbal AS duration FROM supplier")
def provenance_documents(spark, sf):
    k = F.col("s_suppkey")
    doc = F.to_json(F.struct(F.lit("youtube").alias("platform"), F.lpad(k.cast("string"), 11, "0").alias("id"), F.concat(F.lit("https://example.org/"), k.cast("string")).alias("url"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("duration")))
    got = files.provenance(spark, _written(spark, table(spark, sf, "supplier"), "s_suppkey", ["s_suppkey"], doc))
    return got.select("id", "url", "title", "duration")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def provenance_write_once(spark, sf):
    """Sidecars that are not there yet."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    there = s.join(n.where("n_regionkey <> 0"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"))
    return sinks.provenance_new(s.select(F.col("s_suppkey").alias("id")), there)


@query("SELECT l_orderkey AS id, l_linenumber AS n, l_extendedprice::DECIMAL(12,3)::VARCHAR AS \"start\", CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity::DECIMAL(12,3)::VARCHAR END AS \"end\" FROM lineitem WHERE l_linenumber % 6 <> 5")
def clip_list_file(spark, sf):
    """Clip lists: rows of fewer than three fields go, unreadable ends are NULL."""
    i = table(spark, sf, "lineitem")
    k = F.col("l_linenumber")
    url = F.concat_ws("/", F.col("l_orderkey").cast("string"), k.cast("string"))
    line = F.when(k % 6 == 5, _tabs(url, F.col("l_extendedprice"))).otherwise(_tabs(url, F.col("l_extendedprice"), F.when(k % 4 == 0, "?").otherwise(F.col("l_quantity").cast("string")), F.lit("label")))
    i = i.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    got = files.clip_list(spark, _table_written(spark, i, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], lambda rows: rows.select("name", line.alias("line")), "url\tstart\tend\tlabel\n", 1_000_000))
    own = F.split("url", "/")
    return got.select(own[0].cast("long").alias("id"), own[1].cast("int").alias("n"), F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


_NAMED = """SELECT lpad(l_orderkey::VARCHAR, 11, '0') AS id, round(l_extendedprice::DECIMAL(12,2) * 0.001::DECIMAL(4,3), 2)::DECIMAL(12,3)::VARCHAR AS "start", (l_quantity::DECIMAL(12,2) + 1000)::DECIMAL(12,3)::VARCHAR AS "end" FROM lineitem"""


def _clip_names(spark, sf):
    two = lambda c: S.fixed_width(c)
    ext = F.when(F.col("l_linenumber") % 3 == 0, ".mkv").otherwise(".mp4")
    start = F.round(F.col("l_extendedprice").cast("decimal(12,2)") * F.lit("0.001").cast("decimal(4,3)"), 2).cast("decimal(12,3)")
    name = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 11, "0"), F.lit("_a title_"), two(start), F.lit("-"), two((F.col("l_quantity") + 1000).cast("decimal(12,3)")), ext)
    return table(spark, sf, "lineitem").select(name.alias("name"))


@query(f"{_NAMED} WHERE l_linenumber % 3 <> 0")
def clip_names_mp4(spark, sf):
    """Existing clips from names: only mp4, starts padded to six places."""
    return files.clips_of_names(_clip_names(spark, sf)).select("id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


@query(f"SELECT * FROM ({_NAMED})")
def clip_names_any(spark, sf):
    """Any extension, exactly two decimals."""
    return files.clips_of_names(_clip_names(spark, sf), only_mp4=False).select("id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


_LOW = f"WITH {CUES} SELECT source, doc_id, seg, start_ms, end_ms, confidence FROM cues WHERE confidence < -0.7"


@query(f"SELECT doc_id, seg, start_ms, end_ms, round(confidence, 3) AS confidence FROM ({_LOW}) WHERE source <> 'src4'")
def retry_manifest_files(spark, sf):
    """Manifests written per source and read back; one bad row discards its file."""
    c = views.cues(spark, sf).where("confidence < -0.7")
    rows = sinks.manifest_rows(c.select("source", F.col("doc_id").cast("string").alias("media_file"), F.col("seg").alias("segment_idx"), (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"), "confidence", F.col("cue").alias("text")), "source")
    bad = F.when((F.col("source") == "src4") & (F.col("segment_idx") % 2 == 0), "x").otherwise(F.col("segment_idx").cast("string"))
    line = _tabs(F.col("media_file"), bad, F.col("start_time"), F.col("end_time"), F.col("confidence"), F.col("text"))
    got = files.manifest(spark, _written(spark, rows, "source", ["media_file", "segment_idx"], line, "media_file\tsegment_idx\tstart_time\tend_time\tconfidence\ttext\n"))
    ms = lambda c: F.round(F.col(f"{c}_time") * 1000).cast("long").alias(f"{c}_ms")
    return got.select(F.col("media_file").cast("long").alias("doc_id"), F.col("segment_idx").cast("long").alias("seg"), ms("start"), ms("end"), "confidence")


@query("SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 <> 0")
def manifests_unprocessed(spark, sf):
    """Manifests without a ``.processed`` sibling."""
    name = F.concat(F.lit("m"), F.col("s_suppkey").cast("string"), F.lit(".tsv"))
    s = table(spark, sf, "supplier").withColumn("name", name)
    done = s.where("s_suppkey % 3 = 0").select(F.concat("name", F.lit(".processed")).alias("name"))
    return files.unprocessed(s, done).select(F.col("s_suppkey").alias("k"))


@query("SELECT c_name AS item, count(*) AS n FROM customer WHERE c_custkey % 5 > 1 GROUP BY c_name")
def item_list_file(spark, sf):
    """One item a line: trimmed, blanks and comments skipped."""
    k = F.col("c_custkey") % 5
    line = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("# "), "c_name")).when(k == 2, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise(F.col("c_name"))
    got = files.items(spark, _written(spark, table(spark, sf, "customer"), "c_mktsegment", ["c_custkey"], line))
    return got.groupBy("item").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderkey % 4 <> 0")
def date_list_file(spark, sf):
    """Dates as text, one a line; unreadable ones are NULL and go."""
    o = table(spark, sf, "orders")
    line = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    got = files.items(spark, _written(spark, o, "o_orderstatus", ["o_orderkey"], line))
    return got.select(F.try_to_date("item", "yyyy-MM-dd").cast("string").alias("day")).where("day is not null").distinct()


@query("SELECT o_orderkey::VARCHAR AS id, 'Show ' || o_orderpriority AS title FROM orders")
def title_cache_file(spark, sf):
    """The cache of titles, a JSON map from id to title in each file."""
    o = table(spark, sf, "orders")
    pair = F.concat(F.to_json(F.struct(F.concat(F.lit("Show "), "o_orderpriority").alias("t"))), F.lit(""))
    title = F.regexp_extract(pair, r'^\{"t":(.*)\}$', 1)
    folder = _shared(spark)
    rows = o.groupBy("o_orderstatus").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('": '), title)), ", "), F.lit("}")).alias("value"))
    rows.write.partitionBy("o_orderstatus").text(folder)
    return files.title_cache(spark, folder)


@query("""SELECT extractor, id, arg_min(c_custkey, side * 1000000000000 + c_custkey) AS first FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'vimeo' ELSE 'youtube' END AS extractor, 'v' || c_nationkey AS id, c_custkey, c_custkey % 2 AS side FROM customer WHERE c_custkey % 10 <> 4) GROUP BY extractor, id""")
def archive_append(spark, sf):
    """Archive lines appended to an archive: blank lines go, the first of each
    entry stays in its place."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    entry = F.concat(F.when(k % 3 == 0, "vimeo").otherwise("youtube"), F.lit("  v"), F.col("c_nationkey").cast("string"))
    lines = c.select(k.alias("first"), F.when(k % 10 == 4, "").otherwise(entry).alias("value"))
    return sinks.archive_appended(files.archive_of(lines.where("first % 2 = 0")), files.archive_of(lines.where("first % 2 <> 0")), "first").select("extractor", "id", "first")


@query("SELECT p_name || '#' AS miss, p_brand AS fix, count(*) AS n FROM part WHERE p_partkey % 3 = 2 GROUP BY ALL")
def corrections_file(spark, sf):
    """Comments and lines without a tab are no corrections."""
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("# "), "p_name", F.lit("\tx"))).when(k == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("#\t"), "p_brand"))
    got = files.corrections(spark, _written(spark, table(spark, sf, "part"), "p_size", ["p_partkey"], line))
    return got.groupBy("miss", "fix").agg(F.count("*").alias("n"))


@query("SELECT p_size, string_agg(p_brand, ', ' ORDER BY f) AS hotwords FROM (SELECT p_size, p_brand, min(p_partkey) AS f FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL) GROUP BY p_size")
def hotword_files(spark, sf):
    """Distinct terms of each list as first seen."""
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("#"), "p_brand")).otherwise(F.concat(F.lit(" "), "p_brand"))
    folder = _written(spark, table(spark, sf, "part").withColumn("size", F.col("p_size")), "p_size", ["p_partkey"], line)
    sizes = table(spark, sf, "part").where("p_partkey % 4 <> 0").groupBy("p_size").agg(F.min("p_partkey").alias("f"))
    return files.hotwords(spark, folder, "key").select(F.col("key").cast("int").alias("p_size"), "hotwords").join(sizes.select("p_size"), "p_size", "left_semi")


# --- listings ---------------------------------------------------------------


@query("SELECT lang, (sum(octet_length(encode(text))) + count(*))::BIGINT AS length FROM documents GROUP BY lang")
def media_listing(spark, sf):
    """Files by extension from the listing alone, with their sizes."""
    d = table(spark, sf, "documents")
    folder = _shared(spark)
    d.select("lang", "text").write.partitionBy("lang").text(folder)
    got = files.listing(spark, folder, ("txt",))
    return got.groupBy(S.extract("path", "lang=([a-z]+)", 1).alias("lang")).agg(F.sum("length").alias("length"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'm/' || lpad(s_suppkey::VARCHAR, 11, '0') || '__t.mkv' ELSE 'm/' || lpad(s_suppkey::VARCHAR, 11, '0') || '__a.mp4' END AS media FROM supplier")
def media_of_ids(spark, sf):
    """The first media file of an id: mp4 before mkv, other files are none."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey") % 3
    own = F.lpad(F.col("s_suppkey").cast("string"), 11, "0")
    names = F.when(k == 0, F.array(F.lit("__t.txt"))).when(k == 1, F.array(F.lit("__t.mkv"), F.lit("__t.txt"))).otherwise(F.array(F.lit("__t.mkv"), F.lit("__b.mp4"), F.lit("__a.mp4")))
    listed = s.select(F.explode(F.transform(names, lambda x: F.concat(own, x))).alias("name")).withColumn("path", F.concat(F.lit("m/"), "name"))
    return files.with_media(s.select("s_suppkey", own.alias("id")), listed).select(F.col("s_suppkey").alias("id"), "media")


@query("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 0 ORDER BY o_orderdate DESC, lpad(o_orderkey::VARCHAR, 11, '0') DESC LIMIT 1")
def latest_list(spark, sf):
    """The latest of the lists that are not empty."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("modified"), F.lpad(F.col("o_orderkey").cast("string"), 11, "0").alias("path"), F.ceil("o_totalprice").alias("length"))
    return files.latest_nonempty(o).select(F.col("o_orderkey").alias("k"))


@query("SELECT lpad(k::VARCHAR, 11, '0') AS id FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT c_custkey FROM customer)")
def discovered_ids(spark, sf):
    """Ids of media in one folder and of any file in another."""
    name = lambda c, tail: F.concat(F.lpad(F.col(c).cast("string"), 11, "0"), tail)
    media = table(spark, sf, "supplier").select(name("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "__t.mp4").otherwise("__t.json")).alias("name"))
    other = table(spark, sf, "customer").select(name("c_custkey", F.lit("__t.words.tsv")).alias("name"))
    return files.discovered(media, other)


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0")
def absent_list_append(spark, sf):
    """The list of ids without transcript: new ones are added, known ones are not."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return T.insert_ignore(s.where("id % 3 <> 0"), s.where("id % 2 = 0"), ["id"])


@query("SELECT DISTINCT '/home/me/' || p_name AS path FROM part WHERE p_partkey % 4 <> 0 AND p_size > 10")
def media_list_file(spark, sf):
    """A list of files with ``~`` and comments, joined with what is there."""
    p = table(spark, sf, "part")
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("# ~/"), "p_name")).otherwise(F.concat(F.lit("~/"), "p_name"))
    wanted = files.items(spark, _written(spark, p.where("p_size > 10"), "p_size", ["p_partkey"], line))
    there = p.select(F.concat(F.lit("/home/me/"), "p_name").alias("path")).distinct()
    return files.listed(wanted, there, "/home/me")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'p/x' || s_suppkey || '.opus' WHEN s_suppkey % 3 = 1 THEN 'm/' || lpad(s_suppkey::VARCHAR, 11, '0') || '__t.mkv' END AS media FROM supplier")
def media_of_ids_by_sidecar(spark, sf):
    """Without a media file the sidecar says where it would be."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey") % 3
    own = F.lpad(F.col("s_suppkey").cast("string"), 11, "0")
    listed = s.where(k == 1).select(F.concat(own, F.lit("__t.mkv")).alias("name")).withColumn("path", F.concat(F.lit("m/"), "name"))
    side = s.where(k == 0).select(own.alias("id"), F.concat(F.lit("p/x"), F.col("s_suppkey").cast("string")).alias("path"))
    return files.with_media(s.select("s_suppkey", own.alias("id")), listed, sidecars=side).select(F.col("s_suppkey").alias("id"), "media")


# --- sinks ------------------------------------------------------------------


@query(f"WITH {WORDS} SELECT word, (start_ms / 1000)::DECIMAL(18,3)::VARCHAR AS \"start\", seg::VARCHAR AS seg, round(confidence, 3)::DECIMAL(18,3)::VARCHAR AS confidence, retried::INT::VARCHAR AS retried, count(*) AS n FROM words GROUP BY ALL")
def words_table_written(spark, sf):
    """The words table as text and back, without quoting."""
    w = views.words(spark, sf).select((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "word", "seg", "confidence", "retried")
    folder = _shared(spark)
    sinks.tsv(sinks.words_rows(w), folder, compression="gzip")
    return files.tsv(spark, folder).groupBy("word", "start", "seg", "confidence", "retried").agg(F.count("*").alias("n"))


@query("SELECT user_id::VARCHAR AS url, (event_id % 1000 / 8)::DECIMAL(18,3)::VARCHAR AS \"start\", (event_id % 1000 / 8 + 2)::DECIMAL(18,3)::VARCHAR AS \"end\", event_type || ' x' AS label, props AS source_caption, 'yt' AS source_type FROM events")
def hits_table_written(spark, sf):
    """Public hit columns with three decimals; tabs inside become spaces."""
    e = table(spark, sf, "events")
    at = F.col("event_id") % 1000 / 8
    h = e.select(F.col("user_id").cast("string").alias("url"), at.alias("start"), (at + 2).alias("end"), F.concat("event_type", F.lit("\tx")).alias("label"), F.col("props").alias("source_caption"), F.lit("yt").alias("source_type"))
    folder = _shared(spark)
    sinks.tsv(sinks.hits_rows(h), folder)
    return files.tsv(spark, folder)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN 'yes' ELSE 'no' END AS part FROM lineitem")
def split_written(spark, sf):
    """Two outputs of one flagged frame, together the whole."""
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") > 25).alias("there"))
    folder = _shared(spark)
    sinks.split(i, "there", f"{folder}/yes", f"{folder}/no")
    read = lambda x: spark.read.parquet(f"{folder}/{x}").withColumn("part", F.lit(x))
    return read("yes").unionByName(read("no"))


@query("SELECT vec_id, label > 0 AS matches FROM embeddings")
def voice_results_extracted(spark, sf):
    """The analysis document written and read back, with the list of matches."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("file"), F.col("label").cast("double").alias("similarity"), (F.col("label") > 0).alias("matches"))
    folder = _shared(spark)
    sinks.voice_json(e, folder)
    listed = spark.read.text(f"{folder}/matched").select(F.col("value").alias("file"))
    out = spark.read.schema("file string, similarity double, is_speaker boolean").json(f"{folder}/analysis")
    both = R.missing(out.where("is_speaker"), listed, ["file"])  # none: the list holds every match
    return out.join(both.select("file", F.lit(True).alias("lost")), "file", "left").where("lost is null").select(F.col("file").cast("long").alias("vec_id"), F.col("is_speaker").alias("matches"))


@query(
    """SELECT event_id, json_object('target', event_type, 'start_sec', event_id % 400 / 8, 'fps', 25.0, 'start_frame', floor(event_id % 400 / 8 * 25)::BIGINT, 'end_frame', ceil((event_id % 400 / 8 + 2.5) * 25)::BIGINT)->>'$.end_frame' AS end_frame,
  (floor(event_id % 400 / 8 * 25)::BIGINT)::VARCHAR AS start_frame, event_type AS target FROM events"""
)
def wordspan_documents(spark, sf):
    """Matches as JSON documents with their frames."""
    at = F.col("event_id") % 400 / 8
    m = table(spark, sf, "events").select(F.col("event_type").alias("target"), at.alias("start_sec"), (at + 2.5).alias("end_sec"), F.lit("25").alias("fps_text"), F.col("event_id").cast("string").alias("input"), F.lit("m").alias("model"))
    get = lambda c: F.get_json_object("value", f"$.{c}").alias(c)
    return sinks.wordspan(m).select(get("input").cast("long").alias("event_id"), get("start_frame"), get("end_frame"), get("target"))


@query("""SELECT batch, md5(string_agg('file ''m/' || replace(p_name, '''', '''\\''''') || '''', chr(10) ORDER BY ordinal)) AS digest FROM (SELECT p_name, row_number() OVER (ORDER BY p_size, p_partkey) AS ordinal, (row_number() OVER (ORDER BY p_size, p_partkey) - 1) // 50 AS batch FROM part) GROUP BY batch""")
def batch_list_files(spark, sf):
    """Concatenation lists of fifty files each, quoted."""
    p = R.batches(table(spark, sf, "part"), "p_size", [F.col("p_partkey")], 50)
    lists = sinks.batch_lists(p.select("batch", "ordinal", F.concat(F.lit("m/"), "p_name").alias("path")))
    return lists.select("batch", F.md5("value").alias("digest"))


@query("SELECT DISTINCT o_custkey AS id FROM orders")
def batch_id_list(spark, sf):
    """The sorted distinct ids of a batch of videos."""
    return sinks.id_list(views.videos(spark, sf), "o_custkey").withColumnRenamed("o_custkey", "id")


@query("SELECT source, count(*) AS files, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def quality_report_written(spark, sf):
    """The JSON report: a summary and one line per file."""
    d = table(spark, sf, "documents")
    per = d.groupBy("source").agg(F.count("*").alias("files"), F.round(F.avg("n_chars"), 6).alias("mean"))
    folder = _shared(spark)
    sinks.quality_json(per.agg(F.sum("files").alias("files")), per, folder)
    return spark.read.schema("source string, files bigint, mean double").json(f"{folder}/files")


@query(f"WITH {CUES}, hit AS (SELECT doc_id FROM cues WHERE confidence < -1.9 GROUP BY doc_id) SELECT 'f' || doc_id || '.vtt' AS path, 'new' AS kind FROM hit UNION ALL SELECT 'f' || doc_id || '.vtt.bak', 'old' FROM hit WHERE doc_id % 3 <> 0")
def captions_rewritten(spark, sf):
    """Patched caption files, and one backup of each that has none."""
    c = views.cues(spark, sf).withColumn("path", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".vtt")))
    own = c.select("path", "doc_id", "seg", "confidence", "retried", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("cue").alias("text"))
    bad = own.where("confidence < -1.9").select("path", "seg", F.lit("new text").alias("new_text"), F.lit(-0.1).alias("new_confidence"))
    old = sinks.vtt(own, "path")
    new = sinks.vtt(T.patched(own, bad, ["path", "seg"], text="text"), "path").join(bad.select("path").distinct(), "path", "left_semi")
    there = table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".vtt.bak")).alias("path"))
    put = sinks.rewritten(old, new, there)
    return put.select("path", F.when(F.contains("value", F.lit("new text")), "new").otherwise("old").alias("kind"))


@query("SELECT DISTINCT 'youtube' AS extractor, lpad(c_custkey::VARCHAR, 11, 'k') AS id FROM customer UNION SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'vimeo' ELSE 'youtube' END, lpad(s_suppkey::VARCHAR, 11, 's') FROM supplier UNION SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'vimeo' ELSE 'youtube' END, lpad(s_suppkey::VARCHAR, 11, 's') FROM supplier UNION SELECT 'peertube', lpad(n_nationkey::VARCHAR, 11, 'n') FROM nation")
def archive_keys_of_files(spark, sf):
    """Archive keys from media names, metadata and sidecars."""
    key = lambda c, mark: F.lpad(F.col(c).cast("string"), 11, mark)
    names = table(spark, sf, "customer").select(F.concat(key("c_custkey", "k"), F.lit("__t.opus")).alias("name"))
    s = table(spark, sf, "supplier")
    infos = s.select(key("s_suppkey", "s").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, " Vimeo ").alias("extractor"), F.lit("https://www.youtube.com/watch?v=x").alias("url"))
    same = s.select(F.concat(key("s_suppkey", "s"), F.lit("__t.src.json")).alias("file"), F.lit(None).cast("string").alias("id"), F.lit("youtube").alias("extractor"), F.lit(None).cast("string").alias("url"))
    other = table(spark, sf, "nation").select(F.lit("x.src.json").alias("file"), key("n_nationkey", "n").alias("id"), F.lit("PeerTube").alias("extractor"), F.lit("https://e.org/").alias("url"))
    return files.archive_keys(names, infos, same.unionByName(other))


@query("SELECT conv_id AS request, 'e' || turn AS id FROM conversations WHERE conv_id % 3 <> 0 UNION SELECT DISTINCT conv_id, 'single' FROM conversations WHERE conv_id % 3 = 0")
def entries_with_fallback(spark, sf):
    """A request whose list is empty is read from its single document."""
    c = table(spark, sf, "conversations")
    entry = F.struct(F.concat(F.lit("e"), F.col("turn").cast("string")).alias("id"), F.lit("https://e.org/x").alias("url"), F.col("role").alias("title"))
    lists = c.groupBy(F.col("conv_id").alias("request")).agg(F.collect_list(entry).alias("entries"))
    lists = lists.select("request", F.when(F.col("request") % 3 == 0, "{}").otherwise(F.to_json(F.struct("entries"))).alias("value"))
    single = c.select(F.col("conv_id").alias("request")).distinct().withColumn("value", F.lit('{"id": "single", "webpage_url": "https://e.org/s"}'))
    return files.entries_or_single(lists, single).select("request", "id").distinct()


@query("SELECT DISTINCT l_shipmode_name AS name FROM (SELECT 'seg' || l_partkey || '.mp4' AS l_shipmode_name FROM lineitem)")
def existing_segment_list(spark, sf):
    """The sorted distinct names of the segments that are there."""
    return sinks.existing_list(table(spark, sf, "lineitem").select(F.concat(F.lit("seg"), F.col("l_partkey").cast("string"), F.lit(".mp4")).alias("name")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'own/' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'side/' || o_orderkey ELSE 'https://www.youtube.com/watch?v=' || o_orderkey END AS url FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def complete_without_media(spark, sf):
    """Metadata without media, with the best URL known."""
    text = F.col("o_orderkey").cast("string")
    o = table(spark, sf, "orders").select(text.alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("own/"), text)).alias("url"), "o_orderkey")
    side = o.where("o_orderkey % 3 = 1").select("id", F.concat(F.lit("side/"), "id").alias("url"))
    media = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    return R.already_complete(o.drop("o_orderkey"), media, side).select(F.col("id").cast("long").alias("id"), "url")


@query(
    """SELECT lpad(doc_id::VARCHAR, 11, '0') AS ytid, coalesce(CASE WHEN n_chars % 5 <> 0 THEN lang END, 'en') AS lang, n_chars % 7 = 0 AS empty FROM documents"""
)
def caption_listing(spark, sf):
    """Caption files in nested folders, some of them empty, listed by name."""
    folder = _shared(spark)
    d = table(spark, sf, "documents").select(views.ytid("doc_id").alias("ytid"), "lang", "source", "n_chars")
    name = F.concat("ytid", F.lit("__x"), F.coalesce(F.when(F.col("n_chars") % 5 != 0, F.concat(F.lit(".transcript."), "lang")), F.lit("")), F.lit(".vtt"))
    for (source,) in d.select("source").distinct().collect():  # a folder each, of which there are few
        write_files(d.where(F.col("source").eqNullSafe(F.lit(source))), f"{folder}/{source}", name, ["ytid"], F.when(F.col("n_chars") % 7 != 0, "WEBVTT").otherwise(""))
    return files.captions(spark, folder).select("ytid", "lang", (F.col("length") == 0).alias("empty"))
