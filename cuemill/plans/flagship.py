"""The flagship query: from words to merged clip seconds per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, search
from .registry import query
from .search_queries import token_lists
from .views import WORDS


@query(
    f"""WITH RECURSIVE {WORDS}, wide AS (SELECT ytid, source, idx, start_ms, end_ms AS e0, word AS w0, lead(word) OVER w AS w1, lead(end_ms) OVER w AS e1 FROM words WHERE trim(word) <> '' WINDOW w AS (PARTITION BY ytid ORDER BY idx)),
hits AS (SELECT ytid, source, idx * 2 AS ord, start_ms AS hs, e1 AS he FROM wide WHERE contains(lower(w0), 'of') AND contains(lower(w1), 'the') UNION ALL SELECT ytid, source, idx * 2 + 1, start_ms, e0 FROM wide WHERE contains(lower(w0), 'that')),
spans AS (SELECT *, greatest((hs + he) // 2 - 500, 0) AS start, (hs + he) // 2 + 500 AS stop FROM hits),
n AS (SELECT *, row_number() OVER (PARTITION BY ytid ORDER BY start, ord) AS rn FROM spans),
walk AS (SELECT ytid, source, rn, 1::BIGINT AS g, start AS gs, stop AS ge, hs, he FROM n WHERE rn = 1
  UNION ALL SELECT ytid, source, rn, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN gs ELSE start END, CASE WHEN j THEN greatest(ge, stop) ELSE stop END, CASE WHEN j THEN least(h0, hs) ELSE hs END, CASE WHEN j THEN greatest(h1, he) ELSE he END
  FROM (SELECT n.ytid, n.source, n.rn, w.g, w.gs, w.ge, w.hs AS h0, w.he AS h1, n.start, n.stop, n.hs, n.he, w.ge >= n.start AND NOT (w.he < n.hs OR n.he < w.hs) AS j FROM walk w JOIN n ON n.ytid = w.ytid AND n.rn = w.rn + 1)),
groups AS (SELECT source, ytid, g, max(ge) - min(gs) AS ms FROM walk GROUP BY source, ytid, g)
SELECT source, count(*) AS clips, sum(ms)::BIGINT AS total_ms FROM groups GROUP BY source"""
)
def clip_seconds_per_source(spark, sf):
    """Phrases found, windowed, merged and totalled; the files' tokens lie nested
    in their rows, so only the hits are shuffled."""
    hits = search.nested_phrase_hits(token_lists(spark, sf), ["of the", "that"], "substring", keep=("ytid", "source"))
    ordinal = F.col("idx") * 2 + F.when(F.col("term") == "that", 1).otherwise(0)
    w = search.windows(hits, 1000).select("ytid", "source", ordinal.alias("ord"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.col("hit_start_ms").alias("hit_start"), F.col("hit_end_ms").alias("hit_end"), F.col("term").alias("label"), "source_caption", F.col("source").alias("source_type"))
    merged = intervals.merge_hits(w, "ytid")
    return merged.groupBy(F.col("source_type").alias("source")).agg(F.count("*").alias("clips"), F.sum(F.col("end") - F.col("start")).alias("total_ms"))
