"""Search, captions, intervals and stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import intervals, search
from . import views
from .registry import query
from .views import CUES, SPANS, WORDS

TERMS = ["of the", "that", "de la"]
_HIT = ("ytid", "idx", "term", "start_ms", "end_ms", "hit_start_ms", "hit_end_ms", "source_caption")


def token_lists(spark, sf):
    """The words view as one row per document, tokens nested."""
    numbered = F.transform(views.token_array(), lambda x, i: F.struct(x["word"].alias("word"), (i + 1).cast("long").alias("idx"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms")))
    return views.table(spark, sf, "documents").select(views.ytid("doc_id").alias("ytid"), "source", numbered.alias("tokens"))


def _phrase_sql(mode: str) -> str:
    """One branch per term over the same lead() windows."""
    form = {"substring": "contains(lower(w{j}), '{t}')", "normalised": "regexp_replace(lower(trim(w{j})), '[^a-z0-9'']+', '', 'g') = '{t}'"}[mode]
    branches = []
    for term in TERMS:
        parts = term.split()
        cond = " AND ".join(form.format(j=j, t=t) for j, t in enumerate(parts))
        last = len(parts) - 1
        caption = " || ' ' || ".join(f"w{j}" for j in range(len(parts)))
        branches.append(f"SELECT ytid, idx, '{term}' AS term, start_ms AS hs, e{last} AS he, {caption} AS source_caption FROM wide WHERE {cond}")
    blank = "WHERE trim(word) <> ''" if mode == "substring" else ""
    return f"""WITH {WORDS}, wide AS (
  SELECT ytid, idx, start_ms, word AS w0, end_ms AS e0, lead(word) OVER w AS w1, lead(end_ms) OVER w AS e1 FROM words {blank} WINDOW w AS (PARTITION BY ytid ORDER BY idx)),
hits AS ({' UNION ALL '.join(branches)})
"""


@query(_phrase_sql("substring") + "SELECT ytid, idx, term, greatest((hs + he) // 2 - 500, 0) AS start_ms, (hs + he) // 2 + 500 AS end_ms, hs AS hit_start_ms, he AS hit_end_ms, source_caption FROM hits")
def phrase_hits_substring(spark, sf):
    hits = search.nested_phrase_hits(token_lists(spark, sf), TERMS, "substring")
    return search.windows(hits, 1000).select(*_HIT)


@query(_phrase_sql("normalised") + "SELECT ytid, idx, term, greatest(hs - 200, 0) AS start_ms, he + 300 AS end_ms, hs AS hit_start_ms, he AS hit_end_ms, source_caption FROM hits")
def phrase_hits_normalised(spark, sf):
    hits = search.nested_phrase_hits(token_lists(spark, sf), TERMS, "normalised")
    return search.windows(hits, before_ms=200, after_ms=300, exact=True).select(*_HIT)


@query(_phrase_sql("substring") + "SELECT ytid, idx, term, hs AS start_ms, he AS end_ms, source_caption FROM hits")
def phrase_hits_windowed(spark, sf):
    """The same search over a table of words, one window per file."""
    hits = search.phrase_hits(views.words(spark, sf), TERMS, "substring")
    return search.windows(hits, exact=True).select("ytid", "idx", "term", "start_ms", "end_ms", "source_caption")


@query(f"WITH {WORDS} SELECT ytid, idx, word, greatest(start_ms - 200, 0) AS start_ms, end_ms + 200 AS end_ms FROM words WHERE lower(trim(word)) = 'the'")
def word_hits_exact(spark, sf):
    return search.word_hits(views.words(spark, sf), "the").select("ytid", "idx", "word", "start_ms", "end_ms")


_CAPTION = "CASE WHEN contains(lower(cue), 'that') THEN 'that' WHEN contains(lower(cue), 'idiot') THEN 'idiot' ELSE 'that' END"


@query(f"WITH {CUES} SELECT doc_id, seg, {_CAPTION} AS label, greatest(start_ms - 3500, 0) AS start_ms, start_ms + 3500 AS end_ms FROM cues WHERE contains(lower(cue), 'that') OR contains(lower(cue), 'idiot')")
def caption_hits(spark, sf):
    c = views.cues(spark, sf).select("doc_id", "seg", "cue", F.col("start_ms").alias("at"))
    return search.caption_hits(c, ["that", "idiot"], text="cue", at="at").select("doc_id", "seg", "label", "start_ms", "end_ms")


@query(r"""SELECT conv_id, turn, (regexp_extract(line, '^\[([0-9]{2}):([0-9]{2}):([0-9]{2})\]\s+(.*)$', 3))::BIGINT + 60 * (regexp_extract(line, '^\[([0-9]{2}):([0-9]{2}):([0-9]{2})\]\s+(.*)$', 2))::BIGINT AS sec,
  regexp_extract(line, '^\[([0-9]{2}):([0-9]{2}):([0-9]{2})\]\s+(.*)$', 4) AS caption
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN role ELSE '[00:' || lpad((turn % 60)::VARCHAR, 2, '0') || ':' || lpad((conv_id % 60)::VARCHAR, 2, '0') || '] ' || role END AS line FROM conversations)
WHERE regexp_matches(line, '^\[([0-9]{2}):([0-9]{2}):([0-9]{2})\]\s+(.*)$')""")
def stamped_lines(spark, sf):
    """Stamped log lines; others are left out."""
    from ..sources.files import stamped

    c = views.table(spark, sf, "conversations")
    two = lambda x: F.lpad((F.col(x) % 60).cast("string"), 2, "0")
    line = F.when(F.col("turn") % 3 == 2, F.col("role")).otherwise(F.concat(F.lit("[00:"), two("turn"), F.lit(":"), two("conv_id"), F.lit("] "), F.col("role")))
    return stamped(c.select("conv_id", "turn", line.alias("value"))).select("conv_id", "turn", "sec", "caption")


_MERGE = f"""WITH RECURSIVE {SPANS}, n AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY start, ord) AS rn FROM spans),
walk AS (
  SELECT url, rn, 1::BIGINT AS g, start AS gs, "end" AS ge, hit_start AS hs, hit_end AS he FROM n WHERE rn = 1
  UNION ALL
  SELECT url, rn, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN gs ELSE start END, CASE WHEN j THEN greatest(ge, "end") ELSE "end" END,
         CASE WHEN j THEN least(hs, hit_start) ELSE hit_start END, CASE WHEN j THEN greatest(he, hit_end) ELSE hit_end END
  FROM (SELECT n.url, n.rn, w.g, w.gs, w.ge, w.hs, w.he, n.start, n."end", n.hit_start, n.hit_end,
               w.ge >= n.start AND NOT (w.he < n.hit_start OR n.hit_end < w.hs) AS j
        FROM walk w JOIN n ON n.url = w.url AND n.rn = w.rn + 1)),
m AS (SELECT walk.url, walk.g, n.* EXCLUDE (url) FROM walk JOIN n ON n.url = walk.url AND n.rn = walk.rn),
labels AS (SELECT url, g, string_agg(label, ', ' ORDER BY f) AS label FROM (SELECT url, g, label, min(rn) AS f FROM m GROUP BY ALL) GROUP BY url, g),
types AS (SELECT url, g, string_agg(source_type, ', ' ORDER BY source_type) AS source_type FROM (SELECT DISTINCT url, g, source_type FROM m) GROUP BY url, g)
SELECT m.url, min(start) AS start, max("end") AS "end", min(hit_start) AS hit_start, max(hit_end) AS hit_end, any_value(labels.label) AS label,
       arg_min(source_caption, rn) AS source_caption, any_value(types.source_type) AS source_type, count(*) AS n
FROM m JOIN labels USING (url, g) JOIN types USING (url, g) GROUP BY m.url, m.g"""


@query(_MERGE)
def hits_merged(spark, sf):
    return intervals.merge_hits(views.spans(spark, sf))


def _spaced_sql(source: str, gap: int) -> str:
    return f"""WITH RECURSIVE {source}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "at", ord) AS rn FROM src),
walk AS (SELECT k, rn, "at", true AS pass, "at" AS last FROM n WHERE rn = 1
  UNION ALL SELECT n.k, n.rn, n."at", n."at" - w.last >= {gap}, CASE WHEN n."at" - w.last >= {gap} THEN n."at" ELSE w.last END FROM walk w JOIN n ON n.k = w.k AND n.rn = w.rn + 1)
SELECT n.k, n.ord, n."at" FROM n JOIN walk w ON w.k = n.k AND w.rn = n.rn WHERE w.pass"""


@query(_spaced_sql(CUES + ", src AS (SELECT doc_id AS k, seg AS ord, seg * 5000 + (doc_id * 7 + seg * 13) % 4000 AS \"at\" FROM cues)", 10000))
def tslog_stamps(spark, sf):
    c = views.cues(spark, sf)
    at = (F.col("seg") * 5000 + (F.col("doc_id") * 7 + F.col("seg") * 13) % 4000).alias("at")
    return intervals.spaced(c.select(F.col("doc_id").alias("k"), F.col("seg").alias("ord"), at), "k", "at", 10000, "ord")


@query(_spaced_sql("src AS (SELECT user_id AS k, event_id AS ord, epoch_us(ts) // 1000000 AS \"at\" FROM events WHERE event_type = 'error')", 3600))
def alert_debounce(spark, sf):
    e = views.table(spark, sf, "events").where("event_type = 'error'")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at")
    return intervals.spaced(e.select(F.col("user_id").alias("k"), F.col("event_id").alias("ord"), at), "k", "at", 3600, "ord")


@query(f'WITH {SPANS} SELECT url, ord, max("end") OVER (PARTITION BY url ORDER BY start, ord) AS running_end FROM spans')
def running_end(spark, sf):
    s = views.spans(spark, sf).withColumn("at", F.struct("start", "ord"))
    return intervals.running_end(s, "url", "at", "end").select("url", "ord", "running_end")


def _pick_sql(order: str) -> str:
    return f"""WITH {WORDS}, wide AS (
  SELECT ytid, idx, start_ms, word AS w0, confidence AS p0, lead(word) OVER w AS w1, lead(end_ms) OVER w AS e1, lead(confidence) OVER w AS p1 FROM words WINDOW w AS (PARTITION BY ytid ORDER BY idx)),
hits AS (SELECT ytid, idx, start_ms AS hit_start_ms, e1 AS hit_end_ms, (p0 + p1) / 2 AS p FROM wide
  WHERE regexp_replace(lower(trim(w0)), '[^a-z0-9'']+', '', 'g') = 'of' AND regexp_replace(lower(trim(w1)), '[^a-z0-9'']+', '', 'g') = 'the'),
kept AS (SELECT *, count(*) OVER (PARTITION BY ytid) AS m FROM hits WHERE p >= -1.5)
SELECT ytid, hit_start_ms, hit_end_ms, round(p, 6) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY ytid ORDER BY {order}) AS rn FROM kept) WHERE rn = 1"""


def _matches(spark, sf):
    hits = search.phrase_hits(views.words(spark, sf), ["of the"], "normalised", probability="confidence")
    return hits.where("probability >= -1.5")


def _picked(spark, sf, how):
    return search.pick(_matches(spark, sf), how).select("ytid", "hit_start_ms", "hit_end_ms", F.round("probability", 6).alias("probability"))


@query(_pick_sql("hit_start_ms, p DESC"))
def phrase_occurrence_first(spark, sf):
    return _picked(spark, sf, "first")


@query(_pick_sql("hit_start_ms DESC, p DESC"))
def phrase_occurrence_last(spark, sf):
    return _picked(spark, sf, "last")


@query(_pick_sql("p DESC, hit_start_ms"))
def phrase_occurrence_best(spark, sf):
    return _picked(spark, sf, "best")


@query(_pick_sql("hit_start_ms, p DESC").replace("WHERE rn = 1", "WHERE rn = 2 AND m >= 2") + " UNION ALL " + "SELECT * FROM (" + _pick_sql("p DESC, hit_start_ms").replace("WHERE rn = 1", "WHERE rn = 1 AND m < 2") + ")")
def phrase_occurrence_nth(spark, sf):
    return _picked(spark, sf, 2)


@query(f"WITH {WORDS} SELECT ytid, idx, word, seg, start_ms, end_ms FROM words")
def cue_word_spread(spark, sf):
    return views.words(spark, sf).select("ytid", "idx", "word", "seg", "start_ms", "end_ms")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def html_tag_strip(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", S.plain("html").alias("body"))
