"""Reconciliation, clip lists, ordering, quality and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import recon as R
from ..operators import reports as Q
from ..operators import tables as T
from ..sources import sinks
from . import views
from .registry import query
from .views import CLIPS, CUES, VIDEOS, WORDS, table

# --- dates ------------------------------------------------------------------

_SPINE = "spine AS (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS day FROM orders)"


def _spine(spark, sf):
    ends = table(spark, sf, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("day"))


def _days(spark, sf, name="orders", c="o_orderdate"):
    return table(spark, sf, name).select(F.col(c).cast("date").alias("day"))


@query(f"WITH {_SPINE} SELECT day::VARCHAR AS day FROM spine WHERE day NOT IN (SELECT o_orderdate::DATE FROM orders)")
def missing_dates(spark, sf):
    return R.missing(_spine(spark, sf), _days(spark, sf), ["day"]).select(F.col("day").cast("string").alias("day"))


@query(f"WITH {_SPINE} SELECT t, row_number() OVER (ORDER BY t) AS place FROM (SELECT strftime(day, '%B %-d, %Y') AS t FROM spine WHERE day NOT IN (SELECT o_orderdate::DATE FROM orders))")
def missing_dates_text_order(spark, sf):
    """Missing dates in the order of their text, numbered."""
    m = R.missing(_spine(spark, sf), _days(spark, sf), ["day"]).select(S.date_text("day").alias("t"))
    m = m.withColumn("bucket", F.substring("t", 1, 5))
    return R.batches(m, "bucket", [F.col("t")], 100).select("t", F.col("ordinal").alias("place"))


@query(
    f"""WITH {_SPINE}, {VIDEOS}, cache AS (SELECT upload_date AS day, min(ytid) AS ytid FROM videos WHERE o_orderkey % 2 = 0 GROUP BY upload_date)
SELECT day::VARCHAR AS day, ytid, 'https://www.youtube.com/watch?v=' || ytid AS url FROM cache WHERE day IN (SELECT day FROM spine WHERE day NOT IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderkey % 2 = 1))"""
)
def download_list(spark, sf):
    """Dates that the files lack, with the first video of that title date."""
    v = views.videos(spark, sf)
    cache = v.where("o_orderkey % 2 = 0").withColumn("day", S.title_date_strict("title")).groupBy("day").agg(F.min("ytid").alias("ytid"))
    have = v.where("o_orderkey % 2 = 1").select(F.col("upload_date").alias("day"))
    lacking = R.missing(_spine(spark, sf), have, ["day"])
    return cache.join(lacking, "day").select(F.col("day").cast("string").alias("day"), "ytid", S.watch_url("ytid").alias("url"))


_SIDES = "a AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), b AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem)"


@query(f"WITH {_SIDES} SELECT coalesce(a.day, b.day)::VARCHAR AS day, CASE WHEN a.day IS NULL THEN 'right' WHEN b.day IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.day = b.day")
def date_sets_compare(spark, sf):
    return R.compare_sets(_days(spark, sf), _days(spark, sf, "lineitem", "l_shipdate"), "day").select(F.col("day").cast("string").alias("day"), "side")


@query(f"WITH {_SIDES} SELECT side, count(*) AS n FROM (SELECT CASE WHEN a.day IS NULL THEN 'right' WHEN b.day IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.day = b.day) GROUP BY side")
def date_sets_counts(spark, sf):
    return R.compare_sets(_days(spark, sf), _days(spark, sf, "lineitem", "l_shipdate"), "day").groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE::VARCHAR AS day FROM lineitem WHERE l_shipdate::DATE IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_by_date(spark, sf):
    wanted = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").cast("date").alias("day"))
    files = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"))
    return R.present(files, wanted, ["day"]).withColumn("day", F.col("day").cast("string"))


@query(
    f"""WITH {VIDEOS} SELECT f.path, '/moved/' || f.name AS target, f.day::VARCHAR AS day FROM (SELECT 'in/' || ytid AS path, ytid || ' Show ' || strftime(upload_date, '%B %d, %Y') || '.mp4' AS name, upload_date AS day FROM videos) f
WHERE f.day IN (SELECT l_shipdate::DATE FROM lineitem WHERE l_returnflag = 'R')"""
)
def move_plan(spark, sf):
    name = F.concat("ytid", F.lit(" Show "), F.date_format("upload_date", "MMMM dd, yyyy"), F.lit(".mp4"))
    files = views.videos(spark, sf).select(F.concat(F.lit("in/"), "ytid").alias("path"), name.alias("name"))
    days = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_shipdate").cast("date").alias("day"))
    return sinks.move_plan(files, days, "/moved", "show").select("path", F.col("to").alias("target"), F.col("day").cast("string").alias("day"))


@query(
    """WITH files AS (SELECT l_orderkey AS id, max(l_partkey::BIGINT * 10000000000 + l_suppkey * 100 + l_linenumber) AS last FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, last, CASE WHEN last IS NULL THEN 'missing' ELSE 'found' END AS status FROM orders LEFT JOIN files ON id = o_orderkey"""
)
def id_file_map(spark, sf):
    key = F.col("l_partkey") * 10000000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    files = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(key).alias("last"))
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.join(files, F.col("o_orderkey") == F.col("id"), "left").select("o_orderkey", "last", F.when(F.col("last").isNull(), "missing").otherwise("found").alias("status"))


# --- clips ------------------------------------------------------------------

_CANDS = """cands AS (SELECT *, round(start * 100)::BIGINT AS s1, floor(start * 100)::BIGINT AS s2, ceil(start * 100)::BIGINT AS s3, round("end" * 100)::BIGINT AS e1, floor("end" * 100)::BIGINT AS e2, ceil("end" * 100)::BIGINT AS e3 FROM clips)"""
_TRIES = ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM existing x WHERE x.id = c.id AND x.s = c.s{i} AND x.e = c.e{j}) THEN '{i}{j}' END" for i in (1, 2, 3) for j in (1, 2, 3))
_TOLERANT = f"tolerant AS (SELECT c.*, coalesce({_TRIES}) AS hit FROM cands c)"


def _pair(spark, sf):
    return views.clips(spark, sf), views.existing_clips(spark, sf)


@query(f"WITH {CLIPS}, {_CANDS} SELECT id, l_linenumber, l_partkey, l_suppkey, s1 AS start_c, e1 AS end_c FROM cands c WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.id = c.id AND x.s = c.s1 AND x.e = c.e1)")
def clips_todo_halfup(spark, sf):
    out = R.clips_half_up(*_pair(spark, sf)).where("not present")
    cents = lambda c: (S.to_cents(c, "half_up") * 100).cast("long")
    return out.select("id", "l_linenumber", "l_partkey", "l_suppkey", cents("start").alias("start_c"), cents("end").alias("end_c"))


@query(f"WITH {CLIPS}, {_CANDS}, {_TOLERANT} SELECT id, l_linenumber, l_partkey, l_suppkey, CASE substr(hit, 1, 1) WHEN '1' THEN s1 WHEN '2' THEN s2 ELSE s3 END AS found_start_c, CASE substr(hit, 2, 1) WHEN '1' THEN e1 WHEN '2' THEN e2 ELSE e3 END AS found_end_c FROM tolerant WHERE hit IS NOT NULL")
def clips_overlap_tolerant(spark, sf):
    out = R.clips_tolerant(*_pair(spark, sf)).where("found_start is not null")
    cents = lambda c: (F.col(c) * 100).cast("long")
    return out.select("id", "l_linenumber", "l_partkey", "l_suppkey", cents("found_start").alias("found_start_c"), cents("found_end").alias("found_end_c"))


@query(f"WITH {CLIPS}, {_CANDS}, {_TOLERANT} SELECT CASE WHEN hit IS NULL THEN 'todo' ELSE 'present' END AS part, count(*) AS n FROM tolerant GROUP BY 1")
def clips_split_counts(spark, sf):
    out = R.clips_tolerant(*_pair(spark, sf))
    return out.groupBy(F.when(F.col("found_start").isNull(), "todo").otherwise("present").alias("part")).agg(F.count("*").alias("n"))


@query(f"""WITH {CLIPS}, named AS (SELECT DISTINCT id, printf('%06.2f-%06.2f', (s + id % 2 * 100000)::DOUBLE / 100, (e + id % 2 * 100000)::DOUBLE / 100) AS span FROM existing),
want AS (SELECT DISTINCT id, round(start * 100)::BIGINT AS s, round("end" * 100)::BIGINT AS e FROM clips)
SELECT id, printf('%06.2f-%06.2f', (s + id % 2 * 100000)::DOUBLE / 100, (e + id % 2 * 100000)::DOUBLE / 100) AS span FROM want EXCEPT SELECT id, span FROM named""")
def sections_missing(spark, sf):
    """Spans as fixed-width text; every other id's clips lie beyond 1,000 s."""
    late = lambda df: df.withColumns({k: F.col(k) + F.col("id") % 2 * 1000 for k in ("start", "end")})
    c, e = map(late, _pair(spark, sf))
    span = lambda df: df.select("id", F.concat(S.fixed_width("start"), F.lit("-"), S.fixed_width("end")).alias("span")).distinct()
    return R.missing(span(c), span(e), ["id", "span"])


@query(f"""WITH {CLIPS} SELECT id, string_agg(s // 100 || '.' || lpad((s % 100)::VARCHAR, 2, '0') || '-' || (e // 100) || '.' || lpad((e % 100)::VARCHAR, 2, '0'), ',' ORDER BY s, e) AS sections
FROM (SELECT DISTINCT id, round(start * 100)::BIGINT AS s, round("end" * 100)::BIGINT AS e FROM clips) GROUP BY id""")
def url_sections(spark, sf):
    c = views.clips(spark, sf)
    return sinks.sections(c.select("id", S.to_cents("start", "half_up").alias("start"), S.to_cents("end", "half_up").alias("end")), "id")


# --- archives and completeness ----------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def info_only(spark, sf):
    return R.missing(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'vimeo' ELSE 'youtube' END AS extractor, o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def archive_repair(spark, sf):
    """The archive without the youtube entries that have no media."""
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "vimeo").otherwise("youtube").alias("extractor"), F.col("o_orderkey").alias("id"))
    only = R.missing(o.select("id"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), ["id"]).withColumn("extractor", F.lit("youtube"))
    return R.missing(o, only, ["extractor", "id"])


_AVAIL = "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'needs_auth' WHEN l.quality = 1 THEN 'public' END, 'none') AS availability, lang AS live_status, n_chars > 1000 AS has_audio FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _avail(spark, sf):
    label = table(spark, sf, "labels").withColumnRenamed("doc_id", "k")
    d = table(spark, sf, "documents").join(label, F.col("doc_id") == F.col("k"), "left")
    formats = F.array(F.struct(F.lit("none").alias("acodec")), F.struct(F.when(F.col("n_chars") > 1000, "opus").alias("acodec")))
    a = F.coalesce(F.when(F.col("toxic") == 1, "needs_auth").when(F.col("quality") == 1, "public"), F.lit("none"))
    return d.select("doc_id", a.alias("availability"), F.col("lang").alias("live_status"), S.has_audio(formats).alias("has_audio"))


@query(f"SELECT availability, live_status, has_audio, count(*) AS n, min(doc_id) AS example FROM ({_AVAIL}) GROUP BY ALL")
def availability_report(spark, sf):
    return Q.availability(_avail(spark, sf), [F.col("availability"), F.col("live_status"), F.col("has_audio")], "doc_id")


@query(f"SELECT doc_id, availability AS list FROM ({_AVAIL}) UNION ALL SELECT doc_id, 'retry' FROM ({_AVAIL}) WHERE NOT has_audio")
def availability_lists(spark, sf):
    """Partitioned lists: the class, and retry for what has no audio."""
    lists = F.array_compact(F.array(F.col("availability"), F.when(~F.col("has_audio"), "retry")))
    return _avail(spark, sf).select("doc_id", F.explode(lists).alias("list"))


@query("SELECT o_orderkey AS id, o_orderstatus AS title FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def failed_requests(spark, sf):
    want = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"))
    return R.missing(want, table(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("id")), ["id"])


_COMPLETE = """SELECT doc_id, n_chars < 800 AS needs_video, doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang <> 'de' AS needs_transcript, doc_id NOT IN (SELECT doc_id FROM labels) AS needs_info FROM documents"""


def _complete(spark, sf):
    d, label = table(spark, sf, "documents"), table(spark, sf, "labels")
    parts = {"video": d.where("n_chars >= 800"), "transcript": label.where("quality = 1"), "info": label}
    return R.completeness(d.select("doc_id"), parts, "doc_id", waived={"transcript": d.where("lang = 'de'")})


@query(f"SELECT *, NOT (needs_video OR needs_transcript OR needs_info) AS complete FROM ({_COMPLETE})")
def completeness(spark, sf):
    return _complete(spark, sf)


@query(f"SELECT count_if(NOT (needs_video OR needs_transcript OR needs_info)) AS complete, count_if(needs_video OR needs_transcript OR needs_info) AS incomplete, count(*) AS total FROM ({_COMPLETE})")
def completeness_counts(spark, sf):
    return _complete(spark, sf).agg(F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("incomplete"), F.count("*").alias("total"))


@query("SELECT o_orderkey, coalesce('side/' || m, 'https://www.youtube.com/watch?v=' || lpad(o_orderkey::VARCHAR, 11, '0')) AS url FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey)::VARCHAR AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def provenance_url(spark, sf):
    from ..sources.files import with_url

    side = table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    side = side.select(F.lpad(F.col("l_orderkey").cast("string"), 11, "0").alias("id"), F.concat(F.lit("side/"), F.col("p").cast("string")).alias("url"))
    ids = table(spark, sf, "orders").select("o_orderkey", views.ytid("o_orderkey").alias("id"))
    return with_url(ids, side).select("o_orderkey", "url")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def archive_remove_incomplete(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return R.missing(o, table(spark, sf, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("id")), ["id"])


@query("SELECT o_orderkey AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'succeeded' ELSE 'pending' END AS status FROM orders")
def status_transition(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(done, F.col("id") == F.col("k"), "left").select("id", F.when(F.col("hit"), "succeeded").otherwise("pending").alias("status"))


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2")
def id_set_difference(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").exceptAll(table(spark, sf, "lineitem").where("l_linenumber > 2").select("l_orderkey").distinct()).distinct()


@query("SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 THEN 'm/' || lpad(d.doc_id::VARCHAR, 11, '0') || '__t.mp4' ELSE 'm/' || lpad(d.doc_id::VARCHAR, 11, '0') || '__t.webm' END AS media, 'https://www.youtube.com/watch?v=' || lpad(d.doc_id::VARCHAR, 11, '0') AS url FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def media_sibling_join(spark, sf):
    """A words file's media (the first extension wins) and its URL."""
    from ..sources.files import with_media

    own = views.ytid("doc_id")
    name = lambda tail: F.concat(own, F.lit(tail))
    there = table(spark, sf, "labels").select(F.explode(F.when(F.col("quality") == 1, F.array(name("__t.webm"), name("__t.mp4"))).otherwise(F.array(name("__t.webm"), name("__t.json")))).alias("name"))
    d = table(spark, sf, "documents").select("doc_id", "source", own.alias("id"))
    return with_media(d, there.withColumn("path", F.concat(F.lit("m/"), "name"))).where("media is not null").select("doc_id", "source", "media", S.watch_url("id").alias("url"))


@query(f"WITH {CLIPS} SELECT c.id, l_linenumber, l_partkey, l_suppkey, o_orderstatus AS media FROM clips c JOIN orders ON o_orderkey = c.id WHERE start IS NOT NULL AND \"end\" IS NOT NULL")
def clip_media_join(spark, sf):
    c = views.clips(spark, sf).where("start is not null and end is not null")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("media"))
    return c.join(o, "id").select("id", "l_linenumber", "l_partkey", "l_suppkey", "media")


@query("SELECT o_orderkey, CEIL(o_totalprice)::BIGINT AS size FROM orders WHERE o_orderkey % 7 <> 3 AND CEIL(o_totalprice) >= 10240 AND o_custkey % 100 >= 0.6 * (o_orderkey % 100)")
def valid_files(spark, sf):
    """Files that are finished, of 10 KiB at least, and of 0.6 of the expected duration."""
    name = F.concat(F.lit("a.mp4"), F.when(F.col("o_orderkey") % 7 == 3, ".part").otherwise(""))
    o = table(spark, sf, "orders").select("o_orderkey", F.ceil("o_totalprice").alias("size"), name.alias("name"), (F.col("o_custkey") % 100).cast("double").alias("lasts"), (F.col("o_orderkey") % 100).cast("double").alias("expected"))
    return R.valid_files(o, "size", "name", "lasts", "expected").select("o_orderkey", "size")


@query("SELECT doc_id, source FROM documents WHERE source || '/' || doc_id <> 'src1/1'")
def exclude_self(spark, sf):
    return table(spark, sf, "documents").where(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")) != "src1/1").select("doc_id", "source")


@query("SELECT event_id, user_id FROM events WHERE contains(event_type || ': ' || props, 'error: {')")
def error_lines(spark, sf):
    return table(spark, sf, "events").where(F.contains(F.concat("event_type", F.lit(": "), "props"), F.lit("error: {"))).select("event_id", "user_id")


# --- ordering, previews, batches --------------------------------------------

_CLIPPED = f"{CLIPS}, c AS (SELECT clips.*, o_orderdate::DATE AS day FROM clips JOIN orders ON o_orderkey = id WHERE o_orderkey % 9 <> 0 UNION ALL SELECT *, NULL FROM clips WHERE id % 9 = 0)"
_TIE = ("id", "l_linenumber", "l_partkey", "l_suppkey")


def _clipped(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.date_format(F.col("o_orderdate").cast("date"), "MMMM d yyyy").alias("d"))
    c = views.clips(spark, sf).join(o, F.col("id") == F.col("k"))
    name = F.concat(F.lit("Show "), F.when(F.col("id") % 9 != 0, F.col("d")).otherwise("undated"), F.lit("_"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(".mp4"))
    s, e = S.clip_span(name)
    return c.withColumn("name", name).withColumns({"day": S.title_date(name), "at": s}).drop("k", "d")


@query(f"WITH {_CLIPPED} SELECT id, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY day NULLS LAST, start, id, l_linenumber, l_partkey, l_suppkey) AS ordinal FROM c")
def clip_order_date_ts(spark, sf):
    return R.batches(_clipped(spark, sf), "day", [F.col("at"), *_TIE], 100).select(*_TIE, "ordinal")


@query(f"WITH {CLIPS} SELECT id, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY start, id, l_linenumber, l_partkey, l_suppkey) AS ordinal FROM clips")
def clip_order_timestamp(spark, sf):
    c = views.clips(spark, sf).withColumn("second", F.floor("start"))
    return R.batches(c, "second", [F.col("start"), *_TIE], 100).select(*_TIE, "ordinal")


@query(f"WITH {_CLIPPED} SELECT batch, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last FROM (SELECT row_number() OVER (ORDER BY day NULLS LAST, start, id, l_linenumber, l_partkey, l_suppkey) AS ordinal, (row_number() OVER (ORDER BY day NULLS LAST, start, id, l_linenumber, l_partkey, l_suppkey) - 1) // 100 AS batch FROM c) GROUP BY batch")
def clip_batches(spark, sf):
    b = R.batches(_clipped(spark, sf), "day", [F.col("at"), *_TIE], 100)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


@query("SELECT 'head' AS part, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) UNION ALL SELECT 'tail', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5)")
def head_tail_preview(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    head = o.orderBy("o_totalprice", "o_orderkey").limit(5).select(F.lit("head").alias("part"), "o_orderkey")
    return head.unionByName(o.orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey").desc()).limit(5).select(F.lit("tail").alias("part"), "o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderkey LIMIT 10")
def first_n(spark, sf):
    return info_only(spark, sf).orderBy("o_orderkey").limit(10)


@query("SELECT o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS place FROM orders GROUP BY o_orderstatus")
def status_desc(spark, sf):
    from pyspark.sql import Window

    g = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))  # a row per status
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "o_orderstatus")).cast("long"))


@query("SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS place FROM documents")
def sorted_manifest(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select("source", "lang", "doc_id")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("lang", "doc_id")).cast("long"))


@query("SELECT source, count(*) AS files FROM documents GROUP BY source")
def source_file_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"))


# --- totals -----------------------------------------------------------------

_TOTALS = f"{VIDEOS}, hits AS (SELECT upload_date, l_quantity::DECIMAL(18,3) AS secs FROM videos JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 10 <> 0)"


def _hits(spark, sf):
    title = F.when(F.col("o_orderkey") % 10 != 0, F.col("title"))
    v = views.videos(spark, sf).select("o_orderkey", S.title_date_strict(title).alias("title_date"))
    line = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("decimal(18,3)").alias("secs"))
    return v.join(line, F.col("o_orderkey") == F.col("l_orderkey"))


@query(f"WITH {_TOTALS} SELECT upload_date::VARCHAR AS title_date, round(sum(secs), 3)::DOUBLE AS total_seconds, count(*) AS hits FROM hits GROUP BY upload_date")
def title_totals_daily(spark, sf):
    g = _hits(spark, sf).where("title_date is not null").groupBy("title_date").agg(F.round(F.sum("secs"), 3).cast("double").alias("total_seconds"), F.count("*").alias("hits"))
    return g.withColumn("title_date", F.col("title_date").cast("string"))


@query(f"WITH {_TOTALS} SELECT strftime(upload_date, '%Y-%m') AS month, round(sum(secs), 3)::DOUBLE AS total_seconds FROM hits GROUP BY 1")
def title_totals_monthly(spark, sf):
    return _hits(spark, sf).where("title_date is not null").groupBy(F.date_format("title_date", "yyyy-MM").alias("month")).agg(F.round(F.sum("secs"), 3).cast("double").alias("total_seconds"))


@query("SELECT o_orderkey, count(*) AS hits FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 10 = 0 GROUP BY o_orderkey")
def missing_title_date(spark, sf):
    return _hits(spark, sf).where("title_date is null").groupBy("o_orderkey").agg(F.count("*").alias("hits"))


@query(f"WITH {_TOTALS} SELECT upload_date::VARCHAR AS title_date, sum(secs)::DOUBLE AS total_seconds FROM hits GROUP BY upload_date ORDER BY sum(secs) DESC, upload_date LIMIT 10")
def top_days(spark, sf):
    g = _hits(spark, sf).where("title_date is not null").groupBy("title_date").agg(F.sum("secs").alias("t"))
    return g.orderBy(F.col("t").desc(), "title_date").limit(10).select(F.col("title_date").cast("string").alias("title_date"), F.col("t").cast("double").alias("total_seconds"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations", "embeddings", "benchmark")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, sf):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES])


@query("SELECT event_type, count(*) AS n, count_if(value > 1) AS filled, count_if(NOT value > 1) AS missing FROM events GROUP BY event_type")
def type_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 1).alias("filled"), F.count_if(~(F.col("value") > 1)).alias("missing"))


@query(f"WITH {WORDS} SELECT ytid, 'whisper' AS kind, 'en' AS lang, count(*) AS word_count, nullif(count(DISTINCT seg), 0) AS segment_count FROM words GROUP BY ytid UNION ALL SELECT lpad(doc_id::VARCHAR, 11, '0'), 'vtt', lang, NULL, NULL FROM documents")
def transcript_manifest(spark, sf):
    w = views.words(spark, sf).groupBy("ytid").agg(F.count("*").alias("word_count"), F.nullif(F.count_distinct("seg"), F.lit(0)).alias("segment_count"))
    w = w.select("ytid", F.lit("whisper").alias("kind"), F.lit("en").alias("lang"), "word_count", "segment_count")
    d = table(spark, sf, "documents").select(views.ytid("doc_id").alias("ytid"), F.lit("vtt").alias("kind"), "lang", F.lit(None).cast("long").alias("word_count"), F.lit(None).cast("long").alias("segment_count"))
    return w.unionByName(d)


# --- quality ----------------------------------------------------------------

_PER = f"""{WORDS}, q AS (SELECT ytid, count(*) AS total_words, count(DISTINCT seg) AS total_segments, count(DISTINCT CASE WHEN retried THEN seg END) AS retried_segments, sum(confidence) AS s,
  min(confidence) AS min_confidence, max(confidence) AS max_confidence, count_if(confidence < -1.0) AS low_conf_words, count_if(confidence < -1.5) AS very_low_conf_words FROM words GROUP BY ytid)"""


def _per(spark, sf):
    return Q.per_file(views.words(spark, sf))


@query(f"WITH {_PER} SELECT ytid, total_words, total_segments, retried_segments, round(s / total_words, 6) AS avg_confidence, min_confidence, max_confidence, low_conf_words, very_low_conf_words FROM q")
def quality_per_file(spark, sf):
    return _per(spark, sf).drop("sum_confidence").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"WITH {_PER} SELECT count(*) AS files, sum(total_words)::BIGINT AS total_words, sum(total_segments)::BIGINT AS total_segments, sum(retried_segments)::BIGINT AS retried_segments, round(sum(s) / sum(total_words), 6) AS avg_confidence, sum(low_conf_words)::BIGINT AS low_conf_words, sum(very_low_conf_words)::BIGINT AS very_low_conf_words FROM q")
def quality_summary(spark, sf):
    out = Q.summary(_per(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))
    return out.select("files", "total_words", "total_segments", "retried_segments", "avg_confidence", "low_conf_words", "very_low_conf_words")


@query(f"""WITH {WORDS}, e AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM words), n AS (SELECT least(floor((confidence - lo) / ((hi - lo) / 15)), 14)::INT AS bin, count(*) AS n FROM words, e GROUP BY 1)
SELECT b.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(15)) AS bin) b LEFT JOIN n ON n.bin = b.bin""")
def confidence_histogram(spark, sf):
    return Q.histogram(views.words(spark, sf), "confidence", 15).select("bin", "n")


@query(f"WITH {_PER} SELECT (floor(floor(retried_segments * 100 / total_segments) / 10) * 10)::INT AS pct, count(*) AS files FROM q GROUP BY 1")
def retry_decile(spark, sf):
    return Q.retry_deciles(_per(spark, sf))


@query(f"WITH {_PER} SELECT ytid, round(s / total_words, 6) AS avg_confidence, retried_segments FROM q ORDER BY round(s / total_words, 6), ytid LIMIT 10")
def quality_worst10(spark, sf):
    q = _per(spark, sf).select("ytid", F.round("avg_confidence", 6).alias("avg_confidence"), "retried_segments")
    return q.orderBy("avg_confidence", "ytid").limit(10)


@query(f"WITH {_PER} SELECT ytid, round(s / total_words, 6) AS avg_confidence, retried_segments FROM q ORDER BY round(s / total_words, 6) DESC, ytid LIMIT 5")
def quality_best5(spark, sf):
    q = _per(spark, sf).select("ytid", F.round("avg_confidence", 6).alias("avg_confidence"), "retried_segments")
    return q.orderBy(F.col("avg_confidence").desc(), "ytid").limit(5)


@query(f"WITH {CUES} SELECT doc_id, seg, start_ms, end_ms, confidence FROM cues WHERE confidence < -0.7")
def low_confidence_manifest(spark, sf):
    return views.cues(spark, sf).where("confidence < -0.7").select("doc_id", "seg", "start_ms", "end_ms", "confidence")


_STUCK = "len(list_filter(range(1, greatest(length(t) - 10, 1)::BIGINT + 1), lambda i: len(list_distinct(string_split(substr(t, i::BIGINT, 10), ''))) <= 2)) > 0"
_HALLUC = f"""{CUES}, base AS (SELECT doc_id, seg, end_ms, start_ms, CASE seg % 11 WHEN 7 THEN repeat(substr(cue, 1, 1), 25) ELSE trim(cue) END AS t FROM cues),
w AS (SELECT *, list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '') AS ws FROM base),
h AS (SELECT doc_id, seg, t = '' OR (length(t) > 20 AND {_STUCK}) OR (len(ws) >= 6 AND len(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) < len(ws) - 2) AS flagged FROM w)"""


def _flags(spark, sf):
    c = views.cues(spark, sf)
    t = F.when(F.col("seg") % 11 == 7, F.repeat(F.substring("cue", 1, 1), F.lit(25))).otherwise(F.trim("cue"))
    return c.select("doc_id", "seg", S.hallucinated(t, F.col("start_ms") / 1000, F.col("end_ms") / 1000).alias("flagged"))


@query(f"WITH {_HALLUC} SELECT doc_id, seg, flagged FROM h")
def hallucination_flags(spark, sf):
    return _flags(spark, sf)


@query(f"WITH {_HALLUC} SELECT doc_id, seg FROM h WHERE NOT flagged")
def hallucination_filtered(spark, sf):
    return _flags(spark, sf).where("not flagged").select("doc_id", "seg")


_RETRY = """retries AS (SELECT * FROM (SELECT doc_id, seg, 1 AS attempt, CASE WHEN seg % 3 = 0 THEN '' ELSE 'new ' || seg END AS new_text, -0.125::DOUBLE AS new_confidence FROM cues WHERE confidence < -0.7
  UNION ALL SELECT doc_id, seg, 2, CASE WHEN seg % 10 = 0 THEN ' ' ELSE 'again ' || seg END, -0.25::DOUBLE FROM cues WHERE confidence < -1.2) QUALIFY row_number() OVER (PARTITION BY doc_id, seg ORDER BY attempt DESC) = 1)"""


def _retries(spark, sf):
    """One retry of each weak segment, a second of the weakest: the last counts."""
    c = views.cues(spark, sf)
    text = lambda word, none: F.when(none, " ").otherwise(F.concat(F.lit(word), F.col("seg").cast("string")))
    first = c.where("confidence < -0.7").select("doc_id", "seg", F.lit(1).alias("attempt"), text("new ", F.col("seg") % 3 == 0).alias("new_text"), F.lit(-0.125).alias("new_confidence"))
    again = c.where("confidence < -1.2").select("doc_id", "seg", F.lit(2).alias("attempt"), text("again ", F.col("seg") % 10 == 0).alias("new_text"), F.lit(-0.25).alias("new_confidence"))
    return first.unionByName(again)


@query(f"WITH {CUES}, {_RETRY} SELECT c.doc_id, c.seg, CASE WHEN trim(new_text) <> '' THEN trim(new_text) ELSE cue END AS cue, CASE WHEN trim(new_text) <> '' THEN new_confidence ELSE confidence END AS confidence FROM cues c LEFT JOIN retries r ON r.doc_id = c.doc_id AND r.seg = c.seg")
def retry_patch_cues(spark, sf):
    return T.patched(views.cues(spark, sf), _retries(spark, sf), ["doc_id", "seg"], text="cue", order=["attempt"]).select("doc_id", "seg", "cue", "confidence")


@query(f"WITH {WORDS}, {_RETRY} SELECT ytid, idx, word, CASE WHEN r.doc_id IS NOT NULL THEN new_confidence ELSE confidence END AS confidence, retried OR r.doc_id IS NOT NULL AS retried FROM words w LEFT JOIN retries r ON r.doc_id = w.doc_id AND r.seg = w.seg")
def retry_patch_words(spark, sf):
    return T.patched(views.words(spark, sf), _retries(spark, sf), ["doc_id", "seg"], order=["attempt"]).select("ytid", "idx", "word", "confidence", "retried")


@query(f"WITH {CUES} SELECT doc_id, count(*) AS segments, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, md5(string_agg(trim(cue), ' ' ORDER BY seg)) AS text_md5 FROM cues WHERE end_ms > start_ms GROUP BY doc_id")
def retry_group_stats(spark, sf):
    c = views.cues(spark, sf).where("end_ms > start_ms").groupBy("doc_id")
    rows = F.array_sort(F.collect_list(F.struct("seg", F.trim("cue").alias("t"))))
    return c.agg(F.count("*").alias("segments"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence"), F.md5(F.array_join(F.transform(rows, lambda x: x["t"]), " ")).alias("text_md5"))


@query(f"WITH {CUES} SELECT 'low' AS list, doc_id, seg FROM cues WHERE confidence < -1.5 UNION ALL SELECT 'retried', doc_id, seg FROM cues WHERE retried")
def manifest_union(spark, sf):
    c = views.cues(spark, sf)
    return c.where("confidence < -1.5").select(F.lit("low").alias("list"), "doc_id", "seg").unionByName(c.where("retried").select(F.lit("retried").alias("list"), "doc_id", "seg"))


@query(f"WITH {CUES} SELECT DISTINCT doc_id FROM cues WHERE confidence < -1.9")
def manifest_media(spark, sf):
    """Media any of whose segments is in a manifest."""
    bad = views.cues(spark, sf).where("confidence < -1.9").select("doc_id")
    return table(spark, sf, "documents").select("doc_id").join(bad, "doc_id", "left_semi")


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ordinal FROM lineitem")
def clip_order_name(spark, sf):
    """By name, numbers as numbers: clip2 comes before clip10."""
    name = F.concat(F.lit("clip"), F.concat_ws("x", *[F.col(c).cast("string") for c in _LINE]), F.lit(".mp4"))
    return R.clip_order(table(spark, sf, "lineitem").select(*_LINE, name.alias("name")), "name", list(_LINE), 100).select(*_LINE, "ordinal")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ordinal FROM lineitem")
def clip_order_time(spark, sf):
    """By file time."""
    n = table(spark, sf, "lineitem").select(*_LINE, F.lit("a.mp4").alias("name"), F.col("l_shipdate").alias("modified"))
    return R.clip_order(n, "time", list(_LINE), 100).select(*_LINE, "ordinal")


@query(f"WITH {_SIDES} SELECT CASE WHEN a.day IS NULL THEN 1 WHEN b.day IS NULL THEN 0 ELSE 2 END AS section, row_number() OVER (PARTITION BY CASE WHEN a.day IS NULL THEN 1 WHEN b.day IS NULL THEN 0 ELSE 2 END ORDER BY coalesce(a.day, b.day)) AS place, coalesce(a.day, b.day)::VARCHAR AS line FROM a FULL JOIN b ON a.day = b.day UNION ALL VALUES (0, 0, 'DATES ONLY IN PODCASTS:'), (1, 0, 'DATES ONLY IN ARCHIVE:'), (2, 0, 'DATES IN BOTH:')")
def date_sections(spark, sf):
    """The comparison as a text of three sections."""
    sides = R.compare_sets(_days(spark, sf), _days(spark, sf, "lineitem", "l_shipdate"), "day")
    return sinks.date_sections(sides, "day", ("PODCASTS", "ARCHIVE"))


@query("""WITH r AS (SELECT o_orderkey AS id, 'https://e.org/' || o_orderkey AS url, o_orderkey || chr(9) || 'https://e.org/' || o_orderkey || chr(9) || 'youtube' || chr(9) || o_orderpriority AS line, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') AS ok FROM orders)
SELECT 'requested' AS log, id, line FROM r UNION ALL SELECT 'succeeded', id, line FROM r WHERE ok UNION ALL SELECT 'failed', id, line FROM r WHERE NOT ok UNION ALL SELECT 'failed_urls', id, url FROM r WHERE NOT ok""")
def pull_logs(spark, sf):
    want = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://e.org/"), F.col("o_orderkey").cast("string")).alias("url"), F.lit("youtube").alias("extractor"), F.col("o_orderpriority").alias("title"))
    return sinks.pull_logs(want, table(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("id")))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'https://www.youtube.com/watch?v=' || lpad(s_suppkey::VARCHAR, 11, '0') ELSE 'u/' || s_suppkey END AS url, s_name AS title FROM supplier")
def provenance_written(spark, sf):
    """Sidecar documents: an absent URL becomes the watch URL."""
    k = F.col("s_suppkey")
    m = table(spark, sf, "supplier").select(F.lit("youtube").alias("platform"), F.lpad(k.cast("string"), 11, "0").alias("id"), F.when(k % 3 != 0, F.concat(F.lit("u/"), k.cast("string"))).alias("url"), F.col("s_name").alias("title"))
    get = lambda c: F.get_json_object("value", f"$.{c}")
    return sinks.provenance_rows(m).select(get("id").cast("long").alias("id"), get("url").alias("url"), get("title").alias("title"))


@query(f"WITH {VIDEOS}, f AS (SELECT 'in/' || ytid || ' Show ' || strftime(upload_date, '%B %d, %Y') AS stem, o_orderkey AS k FROM videos WHERE upload_date IN (SELECT l_shipdate::DATE FROM lineitem WHERE l_returnflag = 'R')) SELECT stem || '.opus' AS path FROM f UNION ALL SELECT stem || '.info.json' FROM f WHERE k % 2 = 0")
def move_plan_companions(spark, sf):
    """The plan takes the JSON files beside a moved file along."""
    stem = F.concat(F.lit("in/"), "ytid", F.lit(" Show "), F.date_format("upload_date", "MMMM dd, yyyy"))
    v = views.videos(spark, sf).select(stem.alias("stem"), "o_orderkey")
    listed = v.select(F.concat("stem", F.lit(".opus")).alias("path")).unionByName(v.where("o_orderkey % 2 = 0").select(F.concat("stem", F.lit(".info.json")).alias("path")))
    listed = listed.withColumn("name", F.element_at(F.split("path", "/"), -1))
    days = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_shipdate").cast("date").alias("day"))
    moves = sinks.move_plan(listed.where("endswith(name, '.opus')"), days, "/moved", "show")
    return sinks.with_companions(moves, listed, "/moved").select("path")


# --- similarity -------------------------------------------------------------

_VOICE = """p AS (SELECT pos, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label = 0) GROUP BY pos),
v AS (SELECT vec_id, sum(x * m) AS similarity FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) JOIN p USING (pos) GROUP BY vec_id)"""


def _voice(spark, sf):
    e = table(spark, sf, "embeddings")
    return Q.similarity(e, e.where("label = 0"), threshold=0.02)


@query(f"WITH {_VOICE} SELECT vec_id, round(similarity, 6) AS similarity, similarity >= 0.02 AS matches FROM v")
def voice_profile_match(spark, sf):
    return _voice(spark, sf).select("vec_id", F.round("similarity", 6).alias("similarity"), "matches")


@query(f"WITH {_VOICE} SELECT count(*) AS total, count_if(similarity >= 0.02) AS matched, round(100.0::DOUBLE * count_if(similarity >= 0.02) / count(*), 6) AS pct FROM v")
def voice_match_stats(spark, sf):
    g = _voice(spark, sf).agg(F.count("*").alias("total"), F.count_if("matches").alias("matched"))
    return g.withColumn("pct", F.round(S.ratio(F.col("matched") * 100.0, "total"), 6))
