"""Scalars, selection, deduplication and upserts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import tables as T
from . import views
from .registry import query
from .views import CUES, VIDEOS, WORDS, table

ID = "[A-Za-z0-9_-]{11}"

# --- identity ---------------------------------------------------------------

_URLS = """urls AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'https://www.youtube.com/watch?v=' || lpad(page_id::VARCHAR, 11, 'a')
  WHEN 2 THEN 'https://youtu.be/' || lpad(page_id::VARCHAR, 11, 'b') || '?t=3' WHEN 3 THEN lpad(page_id::VARCHAR, 11, '_')
  WHEN 4 THEN 'https://m.youtube.com/watch?list=x&v=' || lpad(page_id::VARCHAR, 11, 'c') || '&t=1' WHEN 5 THEN 'clip of ' || lpad(page_id::VARCHAR, 11, 'd') ELSE 'short' END AS u FROM pages)"""


def _urls(spark, sf):
    p = table(spark, sf, "pages")
    pad = lambda c: F.lpad(F.col("page_id").cast("string"), 11, c)
    k = F.col("page_id") % 7
    u = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit(S.WATCH), pad("a"))).when(k == 2, F.concat(F.lit("https://youtu.be/"), pad("b"), F.lit("?t=3"))).when(k == 3, pad("_"))
        .when(k == 4, F.concat(F.lit("https://m.youtube.com/watch?list=x&v="), pad("c"), F.lit("&t=1"))).when(k == 5, F.concat(F.lit("clip of "), pad("d"))).otherwise("short")
    )
    return p.select("page_id", u.alias("u"))


_HOST = r"lower(nullif(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), ''))"


@query(
    f"""WITH {_URLS}, h AS (SELECT *, {_HOST} AS host FROM urls)
SELECT page_id, coalesce(nullif(regexp_extract(u, 'v=({ID})', 1), ''), nullif(regexp_extract(u, 'youtu\\.be/({ID})', 1), '')) AS plain_id,
  CASE WHEN host LIKE '%youtube.com' AND regexp_extract(u, '[?&]v=([^&#]*)', 1) <> '' THEN regexp_extract(u, '[?&]v=([^&#]*)', 1)
       WHEN host LIKE '%youtu.be' AND regexp_extract(u, '://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)', 1) <> '' THEN regexp_extract(u, '://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)', 1)
       ELSE nullif(regexp_extract(u, '({ID})', 1), '') END AS host_id,
  coalesce(nullif(regexp_extract(u, '(?:watch\\?v=|youtu\\.be/)({ID})', 1), ''), CASE WHEN regexp_matches(u, '^{ID}$') THEN u END) AS strict_id
FROM h"""
)
def url_identity(spark, sf):
    return _urls(spark, sf).select("page_id", S.video_id("u").alias("plain_id"), S.video_id_by_host("u").alias("host_id"), S.video_id_strict("u").alias("strict_id"))


@query(
    f"""WITH {_URLS}, h AS (SELECT *, {_HOST} AS host, CASE WHEN page_id % 5 = 0 THEN ' Vimeo ' ELSE '' END AS given FROM urls)
SELECT page_id, coalesce(nullif(lower(trim(given)), ''), CASE WHEN regexp_matches(host, '(^|\\.)(youtube\\.com|youtu\\.be)$') THEN 'youtube' ELSE nullif(split_part(regexp_replace(host, '^www\\.', ''), '.', 1), '') END, 'youtube') AS extractor FROM h"""
)
def extractor_normalise(spark, sf):
    given = F.when(F.col("page_id") % 5 == 0, " Vimeo ").otherwise("")
    return _urls(spark, sf).select("page_id", S.extractor(given, "u").alias("extractor"))


_NAMES = """names AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 11, 'k') || '__' || o_orderpriority || CASE o_orderkey % 3 WHEN 0 THEN '.words.yt.tsv' WHEN 1 THEN '.words.tsv' ELSE '.transcript.de.vtt' END AS base,
  CASE o_orderkey % 4 WHEN 0 THEN 'pre_' ELSE '' END AS pre FROM orders)"""


def _names(spark, sf):
    k = F.col("o_orderkey")
    tail = F.when(k % 3 == 0, ".words.yt.tsv").when(k % 3 == 1, ".words.tsv").otherwise(".transcript.de.vtt")
    base = F.concat(F.lpad(k.cast("string"), 11, "k"), F.lit("__"), F.col("o_orderpriority"), tail)
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.when(k % 4 == 0, "pre_").otherwise(""), base).alias("name"))


@query(
    f"""WITH {_NAMES}, n AS (SELECT o_orderkey, pre || base AS name FROM names)
SELECT o_orderkey, nullif(regexp_extract(name, '({ID})__', 1), '') AS any_id, nullif(regexp_extract(name, '^({ID})__', 1), '') AS start_id, CASE WHEN contains(name, '__') THEN split_part(name, '__', 1) END AS before_mark,
  CASE WHEN name LIKE '%.words.yt.tsv' THEN 'yt' WHEN name LIKE '%words.tsv' THEN 'whisper' END AS kind, coalesce(nullif(regexp_extract(name, '\\.transcript\\.([^.]+)\\.vtt$', 1), ''), 'en') AS lang FROM n"""
)
def filename_identity(spark, sf):
    return _names(spark, sf).select("o_orderkey", S.id_in_name("name").alias("any_id"), S.id_at_start("name").alias("start_id"), S.id_before_mark("name").alias("before_mark"), S.media_kind("name").alias("kind"), S.caption_language("name").alias("lang"))


@query("SELECT o_orderkey, 'https://www.youtube.com/watch?v=' || lpad(o_orderkey::VARCHAR, 11, '0') AS url FROM orders")
def watch_url(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.watch_url(views.ytid("o_orderkey")).alias("url"))


# --- dates ------------------------------------------------------------------

_TITLES = (
    VIDEOS
    + """, t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN title WHEN 1 THEN replace(lower(title), ',', '') WHEN 2 THEN 'Show ' || strftime(upload_date, '%b%d %Y') WHEN 3 THEN 'Show February 31, 2021'
  WHEN 4 THEN 'no date' WHEN 5 THEN 'Ep ' || strftime(upload_date, '%B %d,%Y') ELSE 'Ep ' || strftime(upload_date, '%b %d , %Y') END AS title FROM videos)"""
)
_MON = "(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_FULL = "(January|February|March|April|May|June|July|August|September|October|November|December)"


def _titles(spark, sf):
    v = views.videos(spark, sf)
    k, d = F.col("o_orderkey") % 7, F.col("upload_date")
    t = (
        F.when(k == 0, F.col("title")).when(k == 1, F.replace(F.lower("title"), F.lit(","), F.lit(""))).when(k == 2, F.concat(F.lit("Show "), F.date_format(d, "MMMdd yyyy"))).when(k == 3, "Show February 31, 2021")
        .when(k == 4, "no date").when(k == 5, F.concat(F.lit("Ep "), F.date_format(d, "MMMM dd,yyyy"))).otherwise(F.concat(F.lit("Ep "), F.date_format(d, "MMM dd , yyyy")))
    )
    return v.select("o_orderkey", "upload_date", t.alias("title"))


def _date_sql(pattern: str) -> str:
    part = lambda k: f"regexp_extract(title, '{pattern}', {k})"
    return f"try_strptime({part(3)} || '-' || substr(upper(substr({part(1)}, 1, 1)) || lower(substr({part(1)}, 2)), 1, 3) || '-' || {part(2)}, '%Y-%b-%d')::DATE::VARCHAR"


@query(f"WITH {_TITLES} SELECT o_orderkey, {_date_sql('(?i)' + _MON + chr(92) + 's*([0-9]{1,2})' + chr(92) + 's*,?' + chr(92) + 's*([0-9]{4})')} AS title_date FROM t")
def title_date_sql(spark, sf):
    return _titles(spark, sf).select("o_orderkey", S.title_date("title").cast("string").alias("title_date"))


@query(f"WITH {_TITLES} SELECT o_orderkey, {_date_sql(_FULL + chr(92) + 's+([0-9]{1,2}),' + chr(92) + 's+([0-9]{4})')} AS title_date FROM t")
def title_date_strict(spark, sf):
    return _titles(spark, sf).select("o_orderkey", S.title_date_strict("title").cast("string").alias("title_date"))


@query(
    f"""WITH {_TITLES} SELECT o_orderkey, {_date_sql('(?i)show.*?' + _FULL + chr(92) + 's+([0-9]{1,2}),?' + chr(92) + 's+([0-9]{4})')} AS name_date,
  CASE WHEN regexp_matches(title, '(?i)show.*?{_FULL}\\s+([0-9]{{1,2}}),?\\s+([0-9]{{4}})') THEN regexp_extract(title, '(?i)show.*?{_FULL}\\s+([0-9]{{1,2}}),?\\s+([0-9]{{4}})', 1) || ' ' || regexp_extract(title, '(?i)show.*?{_FULL}\\s+([0-9]{{1,2}}),?\\s+([0-9]{{4}})', 2) || ', ' || regexp_extract(title, '(?i)show.*?{_FULL}\\s+([0-9]{{1,2}}),?\\s+([0-9]{{4}})', 3) END AS name_text
FROM t"""
)
def title_date_text(spark, sf):
    return _titles(spark, sf).select("o_orderkey", S.name_date("title", "show").cast("string").alias("name_date"), S.name_date_text("title", "show").alias("name_text"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS iso_text, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS compact FROM orders"""
)
def compact_date(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, "20211399").otherwise(F.date_format("d", "yyyyMMdd"))
    return o.select("o_orderkey", S.iso_to_text(F.col("d").cast("string")).alias("iso_text"), S.compact_date(raw).cast("string").alias("compact"))


# --- clock, frames, text ----------------------------------------------------


@query(
    """SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS hms, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt
FROM (SELECT event_id, (event_id * 7919 + 999) % 20000000 AS ms FROM events)"""
)
def hms_format(spark, sf):
    s = ((F.col("event_id") * 7919 + 999) % 20000000) / 1000
    return table(spark, sf, "events").select("event_id", S.clock(s).alias("hms"), S.clock(s, ",").alias("srt"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN 0.0 WHEN 2 THEN 0.0 ELSE ms / 1000 END::DOUBLE AS strict_s, CASE event_id % 4 WHEN 3 THEN 0.0 WHEN 2 THEN (ms % 3600000) / 1000 ELSE ms / 1000 END::DOUBLE AS loose_s
FROM (SELECT event_id, ((event_id * 7919 + 999) % 20000) * 125 AS ms FROM events)"""
)
def hms_parse(spark, sf):
    k = F.col("event_id") % 4
    s = ((F.col("event_id") * 7919 + 999) % 20000) * 125 / 1000
    t = F.when(k == 0, S.clock(s)).when(k == 1, S.clock(s, ",")).when(k == 2, F.substring(S.clock(s % 3600), 4, 9)).otherwise("12:xx")
    return table(spark, sf, "events").select("event_id", S.seconds_strict(t).alias("strict_s"), S.seconds_loose(t).alias("loose_s"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN floor(s * (30000.0::DOUBLE / 1001))::BIGINT WHEN 1 THEN floor(s * 25)::BIGINT ELSE -1 END AS start_frame,
  CASE event_id % 3 WHEN 0 THEN ceil((s + 2.5::DOUBLE) * (30000.0::DOUBLE / 1001))::BIGINT WHEN 1 THEN ceil((s + 2.5::DOUBLE) * 25)::BIGINT ELSE -1 END AS end_frame
FROM (SELECT event_id, (event_id % 4000)::DOUBLE / 8 AS s FROM events)"""
)
def frame_span(spark, sf):
    k = F.col("event_id") % 3
    rate = S.fps(F.when(k == 0, "30000/1001").when(k == 1, "25").otherwise("0/0"))
    s = (F.col("event_id") % 4000).cast("double") / 8
    return table(spark, sf, "events").select("event_id", S.frame(s, rate).alias("start_frame"), S.frame(s + 2.5, rate, True).alias("end_frame"))


@query("SELECT o_orderkey, replace(regexp_replace(o_orderpriority || ' (' || o_orderstatus || ')!', '[^-A-Za-z0-9_. ]', '', 'g'), ' ', '_') AS label, substr(o_orderpriority, 1, 5) AS short FROM orders")
def label_sanitise(spark, sf):
    t = F.concat("o_orderpriority", F.lit(" ("), "o_orderstatus", F.lit(")!"))
    return table(spark, sf, "orders").select("o_orderkey", S.label(t).alias("label"), S.short_title("o_orderpriority", 5).alias("short"))


@query("SELECT doc_id, seg, translate(cue || chr(9) || lang, chr(9) || chr(13) || chr(10), '   ') AS scrubbed FROM cues".join([f"WITH {CUES} ", ""]))
def scrub_text(spark, sf):
    c = views.cues(spark, sf)
    return c.select("doc_id", "seg", S.scrub(F.concat("cue", F.lit("\t"), "lang")).alias("scrubbed"))


@query("SELECT p_partkey, replace(p_name || '''s', '''', '''\\''''') AS quoted FROM part")
def quote_escape(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.list_quote(F.concat("p_name", F.lit("'s"))).alias("quoted"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text || ' Of The', 'thble', 'THBLE'), 'Thble', 'THBLE'), 'Of the', 'of a'), 'of the', 'of a'), 'Of The', 'of a')) AS digest FROM documents")
def corrections_applied(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(S.corrected(F.concat("text", F.lit(" Of The")), [("thble", "THBLE"), ("Of the", "of a")])).alias("digest"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, 'k' AS name FROM events")
def props_json(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "k"))
    return e.select("event_id", "k", "name")


# --- selection and deduplication ---------------------------------------------

_BY_CUSTOMER = "row_number() OVER (PARTITION BY o_custkey ORDER BY upload_date DESC NULLS LAST, length(title) DESC, o_orderkey) AS rn"


@query(f"WITH {VIDEOS} SELECT o_custkey, ytid, upload_date::VARCHAR AS upload_date, title FROM (SELECT *, {_BY_CUSTOMER} FROM videos) WHERE rn = 1")
def video_distinct_on(spark, sf):
    v = views.videos(spark, sf)
    out = T.distinct_on(v, "o_custkey", [F.col("upload_date").desc_nulls_last(), F.length("title").desc(), F.col("o_orderkey")])
    return out.select("o_custkey", "ytid", F.col("upload_date").cast("string").alias("upload_date"), "title")


@query(
    f"""WITH {VIDEOS}, old AS (SELECT o_custkey AS ytid, 'old' AS title, NULL::VARCHAR AS upload_date, o_custkey % 2 AS upload_type FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 3 <> 0),
new AS (SELECT o_custkey AS ytid, title, upload_date::VARCHAR AS upload_date FROM (SELECT *, {_BY_CUSTOMER} FROM videos) WHERE rn = 1 AND (o_custkey % 3 = 0 OR o_custkey % 5 <> 0))
SELECT coalesce(new.ytid, old.ytid) AS ytid, CASE WHEN new.ytid IS NOT NULL THEN new.title ELSE old.title END AS title, CASE WHEN new.ytid IS NOT NULL THEN new.upload_date ELSE old.upload_date END AS upload_date, old.upload_type
FROM old FULL JOIN new ON old.ytid = new.ytid"""
)
def video_upsert(spark, sf):
    v = views.videos(spark, sf)
    old = v.select(F.col("o_custkey").alias("ytid")).distinct().where("ytid % 3 <> 0").select("ytid", F.lit("old").alias("title"), F.lit(None).cast("string").alias("upload_date"), (F.col("ytid") % 2).alias("upload_type"))
    new = T.distinct_on(v, "o_custkey", [F.col("upload_date").desc_nulls_last(), F.length("title").desc(), F.col("o_orderkey")]).where("o_custkey % 3 = 0 or o_custkey % 5 <> 0")
    new = new.select(F.col("o_custkey").alias("ytid"), "title", F.col("upload_date").cast("string").alias("upload_date"))
    return T.upsert(old, new, ["ytid"], overwrite=["title", "upload_date"])


@query(
    """WITH old AS (SELECT doc_id, lang, n_chars AS word_count, NULL::BIGINT AS segment_count FROM documents WHERE doc_id % 2 = 0),
new AS (SELECT d.doc_id, 'xx' AS lang, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.doc_id END AS word_count, quality::BIGINT AS segment_count FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 2 <> 0 OR l.doc_id IS NOT NULL)
SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, CASE WHEN new.doc_id IS NOT NULL THEN new.lang ELSE old.lang END AS lang, coalesce(new.word_count, old.word_count) AS word_count, coalesce(new.segment_count, old.segment_count) AS segment_count
FROM old FULL JOIN new ON old.doc_id = new.doc_id"""
)
def transcript_upsert_coalesce(spark, sf):
    old = table(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", "lang", F.col("n_chars").alias("word_count"), F.lit(None).cast("long").alias("segment_count"))
    label = table(spark, sf, "labels").withColumnRenamed("doc_id", "k")
    new = table(spark, sf, "documents").join(label, F.col("doc_id") == F.col("k"), "left").where("doc_id % 2 <> 0 or k is not null").select("doc_id", F.lit("xx").alias("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("word_count"), F.col("quality").cast("long").alias("segment_count"))
    return T.upsert(old, new, ["doc_id"], overwrite=["lang"], fill=["word_count", "segment_count"])


@query(
    """WITH old AS (SELECT source || '/' || doc_id AS path, lang AS kind, n_chars AS bytes FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT source || '/' || doc_id AS path, 'new' AS kind, n_chars + 1 AS bytes FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT coalesce(new.path, old.path) AS path, coalesce(new.kind, old.kind) AS kind, coalesce(new.bytes, old.bytes) AS bytes FROM old FULL JOIN new ON old.path = new.path"""
)
def asset_upsert(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    old = d.where("doc_id % 3 <> 0").select("path", F.col("lang").alias("kind"), F.col("n_chars").alias("bytes"))
    new = d.where("doc_id % 2 = 0 or doc_id % 3 = 0").select("path", F.lit("new").alias("kind"), (F.col("n_chars") + 1).alias("bytes"))
    return T.upsert(old, new, ["path"], overwrite=["kind", "bytes"])


@query(
    f"""WITH {WORDS}, base AS MATERIALIZED (SELECT ytid, CASE WHEN doc_id % 3 = 0 THEN 'yt' ELSE 'whisper' END AS source, idx, lower(word) AS word, start_ms, end_ms, seg FROM words WHERE end_ms >= start_ms),
old AS (SELECT * FROM base WHERE idx % 2 = 0), new AS (SELECT ytid, source, idx, word || '!' AS word, start_ms, end_ms + 1 AS end_ms, seg FROM base WHERE idx % 2 <> 0 OR idx % 3 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.ytid = old.ytid AND new.source = old.source AND new.idx = old.idx)"""
)
def word_upsert(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, "YT").when(F.col("doc_id") % 3 == 1, "other").otherwise("whisper")
    base = views.words(spark, sf).withColumn("raw", raw).where(T.valid_interval("start_ms", "end_ms") & (F.col("ytid") != ""))
    base = base.select("ytid", T.known_source("raw").alias("source"), "idx", F.lower("word").alias("word"), "start_ms", "end_ms", "seg")
    old = base.where("idx % 2 = 0")
    new = base.where("idx % 2 <> 0 or idx % 3 = 0").withColumns({"word": F.concat("word", F.lit("!")), "end_ms": F.col("end_ms") + 1})
    return T.upsert(old, new, ["ytid", "source", "idx"], overwrite=["word", "start_ms", "end_ms", "seg"])


_HITS = "SELECT DISTINCT l_orderkey, l_partkey, nullif(CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END, '') AS label FROM lineitem"


@query(
    f"""WITH old AS ({_HITS} WHERE l_linenumber <= 2), new AS ({_HITS})
SELECT * FROM old UNION ALL SELECT l_orderkey, l_partkey, label FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.l_orderkey = new.l_orderkey AND old.l_partkey = new.l_partkey)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY label NULLS LAST) = 1""".replace("SELECT * FROM old UNION ALL SELECT", "SELECT * FROM old UNION ALL SELECT * FROM (SELECT") + ")"
)
def hit_insert_ignore(spark, sf):
    h = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.nullif(F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_returnflag")), F.lit("")).alias("label"), "l_linenumber")
    old = h.where("l_linenumber <= 2").drop("l_linenumber").distinct()
    new = T.first_per_key(h.drop("l_linenumber"), ["l_orderkey", "l_partkey"], [F.col("label").asc_nulls_last()])
    return T.insert_ignore(old, new, ["l_orderkey", "l_partkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'live' WHEN o_orderkey % 3 = 1 THEN 'live' ELSE o_orderstatus END AS upload_type FROM orders")
def upload_type_unset_update(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 3 == 1, "").otherwise(F.col("o_orderstatus")).alias("upload_type"))
    return T.set_unset(o, "upload_type", "live")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'live' WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS upload_type FROM orders")
def upload_type_scoped_update(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("upload_type"))
    scope = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return T.set_unset(o, "upload_type", "live", scope, "c_custkey").select("o_orderkey", "upload_type")


@query(
    """WITH old AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_nationkey END AS n FROM customer), new AS (SELECT c_custkey, c_nationkey AS n FROM customer WHERE c_custkey % 3 <> 0)
SELECT old.c_custkey, CASE WHEN new.c_custkey IS NULL THEN old.n ELSE new.n END AS n, new.c_custkey IS NOT NULL AND old.n IS DISTINCT FROM new.n AS changed FROM old LEFT JOIN new ON old.c_custkey = new.c_custkey"""
)
def change_only_update(spark, sf):
    c = table(spark, sf, "customer")
    old = c.select("c_custkey", F.when(F.col("c_custkey") % 2 != 0, F.col("c_nationkey")).alias("n"))
    return T.update(old, c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_nationkey").alias("n")), "c_custkey", "n")


_FILES = "files AS (SELECT source AS id, CASE lang WHEN 'en' THEN 'yt' WHEN 'fr' THEN 'whisper' WHEN 'de' THEN 'tslog' ELSE 'words' END AS kind, n_chars AS bytes, 'f/' || lpad(doc_id::VARCHAR, 8, '0') AS path, lang FROM documents)"


def _files(spark, sf):
    kind = F.when(F.col("lang") == "en", "yt").when(F.col("lang") == "fr", "whisper").when(F.col("lang") == "de", "tslog").otherwise("words")
    return table(spark, sf, "documents").select(F.col("source").alias("id"), kind.alias("kind"), F.col("n_chars").alias("bytes"), F.concat(F.lit("f/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), "lang")


@query(f"WITH {_FILES} SELECT id, kind, bytes, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE kind WHEN 'whisper' THEN 1 WHEN 'yt' THEN 2 ELSE 3 END, bytes DESC, path) AS rn FROM files) WHERE rn = 1")
def best_source_per_id(spark, sf):
    return T.best_source(_files(spark, sf), "id", "kind", ["whisper", "yt"], "bytes", "path").select("id", "kind", "bytes", "path")


@query(f"WITH {_FILES} SELECT id, kind, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE kind WHEN 'words' THEN 1 WHEN 'tslog' THEN 2 WHEN 'yt' THEN 3 ELSE 4 END, path) AS rn FROM files WHERE kind <> 'whisper') WHERE rn = 1")
def best_source_three_level(spark, sf):
    f = _files(spark, sf).where("kind <> 'whisper'")
    return T.first_per_key(f, ["id"], [T.ranked_source(F.col("kind"), ["words", "tslog", "yt"]), F.col("path")]).select("id", "kind", "path")


@query(f"WITH {_FILES} SELECT id, lang, kind, path FROM (SELECT *, row_number() OVER (PARTITION BY id, lang ORDER BY bytes % 2, path) AS rn FROM files) WHERE rn = 1")
def basename_priority(spark, sf):
    return T.first_per_key(_files(spark, sf), ["id", "lang"], [F.col("bytes") % 2, F.col("path")]).select("id", "lang", "kind", "path")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def first_seen_dedupe(spark, sf):
    return T.seen_first(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT l_partkey, l_suppkey, l_linenumber, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey, l_suppkey, l_linenumber")
def inode_dedupe(spark, sf):
    """The first file of each (device, inode, size)."""
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(F.min("l_orderkey").alias("l_orderkey"))


@query("SELECT string_agg(p_brand, ', ' ORDER BY f) AS hotwords, count(*) AS n FROM (SELECT p_brand, min(p_partkey) AS f FROM part GROUP BY p_brand)")
def hotword_list(spark, sf):
    first = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("f"))
    rows = F.array_sort(F.collect_list(F.struct("f", "p_brand")))
    return first.agg(F.array_join(F.transform(rows, lambda x: x["p_brand"]), ", ").alias("hotwords"), F.count("*").alias("n"))


@query("SELECT extractor, id FROM (SELECT 'youtube' AS extractor, c_nationkey AS id FROM customer UNION SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'youtube' ELSE 'vimeo' END, s_nationkey FROM supplier UNION SELECT 'youtube', n_nationkey FROM nation)")
def archive_key_union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("youtube").alias("extractor"), F.col("c_nationkey").alias("id"))
    s = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "youtube").otherwise("vimeo").alias("extractor"), F.col("s_nationkey").alias("id"))
    n = table(spark, sf, "nation").select(F.lit("youtube").alias("extractor"), F.col("n_nationkey").alias("id"))
    return c.unionByName(s).unionByName(n).distinct()


@query(
    """SELECT id, url, title, min(turn) AS first_turn FROM (SELECT conv_id AS id, turn, 'https://example.org/' || (turn // 2) AS url, role AS title FROM conversations) GROUP BY id, url, title"""
)
def entries_flatten(spark, sf):
    """Playlists as JSON lines, flattened again, first-seen entries."""
    from ..sources.files import entries_of

    c = table(spark, sf, "conversations")
    entry = F.struct(F.col("turn").alias("ord"), F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("https://example.org/"), F.floor(F.col("turn") / 2).cast("string")).alias("url"), F.concat_ws("#", "role", F.col("turn").cast("string")).alias("title"))
    lists = c.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("entries"))).alias("value"))
    e = entries_of(lists).select(F.col("id").cast("long").alias("id"), "url", F.split("title", "#")[0].alias("title"), F.split("title", "#")[1].cast("long").alias("turn"))
    return T.seen_first(e, ["id", "url", "title"], "turn").select("id", "url", "title", F.col("turn").alias("first_turn"))


@query(
    f"""WITH {WORDS}, own AS (SELECT ytid, idx, word, start_ms, end_ms, max(idx) OVER (PARTITION BY ytid) AS n FROM words),
c AS (SELECT own.*, k AS chunk FROM own, range((SELECT max(idx) // 850 + 1 FROM words)) t(k) WHERE idx > k * 850 AND idx <= k * 850 + 1000 AND (k = 0 OR n > k * 850 + 150))
SELECT ytid, chunk::BIGINT AS chunk, count(*) AS n, min(idx) AS first_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, md5(string_agg(word, ' ' ORDER BY idx)) AS body FROM c GROUP BY ytid, chunk"""
)
def word_chunks(spark, sf):
    """Chunks of 1,000 words that overlap by 150."""
    c = T.word_chunks(views.words(spark, sf))
    rows = F.array_sort(F.collect_list(F.struct("idx", "word")))  # no longer than a chunk
    return c.groupBy("ytid", "chunk").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.md5(F.array_join(F.transform(rows, lambda x: x["word"]), " ")).alias("body"))
