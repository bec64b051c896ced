"""Command line over files: ``python -m cuemill COMMAND --help``.

Each command reads files, runs one plan and writes one result; media are never
touched.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import intervals, recon, reports, search, tables
from .sources import files, sinks
from .sources.keyed import KeyedTable
from .streaming import alerts


def _ms(df, *names):
    return df.withColumns({f"{n}_ms": F.round(F.col(n) * 1000).cast("long") for n in names})


def hits(spark, a):
    """Search words or stamped logs, merge what touches, write the public columns."""
    terms = [t.strip().lower() for t in a.query.split(",") if t.strip()]
    if a.source == "tslog":
        logs = files.stamped_logs(spark, a.path).withColumn("at", F.col("sec") * 1000)
        found = search.caption_hits(logs, terms, int(a.window or 7000), a.pad_start, a.pad_end, "caption", "at")
        found = found.select("ytid", F.col("sec").alias("idx"), F.col("label").alias("term"), "start_ms", "end_ms", F.col("at").alias("hit_start_ms"), F.col("at").alias("hit_end_ms"), F.col("caption").alias("source_caption"))
    else:
        words = _ms(files.words_by_alias(spark, a.path), "start", "end")
        found = search.windows(search.phrase_hits(words, terms, a.mode), int(a.window or 1000), a.pad_start, a.pad_end, a.exact)
    s = found.select(S.watch_url("ytid").alias("url"), F.xxhash64("idx", "term").alias("ord"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.col("hit_start_ms").alias("hit_start"), F.col("hit_end_ms").alias("hit_end"), F.col("term").alias("label"), "source_caption", F.lit(a.source).alias("source_type"))
    merged = intervals.merge_hits(s)
    out = merged.withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    sinks.tsv(sinks.hits_rows(out), a.out)


def sections(spark, a):
    """Clip list to one line per URL."""
    clips = files.clip_list(spark, a.path).where("start is not null and end is not null")
    clips = clips.select("url", S.to_cents("start", "half_up").alias("start"), S.to_cents("end", "half_up").alias("end"))
    sinks.tsv(sinks.sections(clips), a.out)


def filter_clips(spark, a):
    """Clip list against existing clip files: present and todo."""
    wanted = files.clip_list(spark, a.path).withColumn("id", S.video_id_by_host("url"))
    there = files.clips_of_names(files.listing(spark, a.clips), only_mp4=not a.tolerant)
    if a.tolerant:
        flagged = recon.clips_tolerant(wanted, there, a.pad_start, a.pad_end).withColumn("present", F.col("found_start").isNotNull())
    else:
        flagged = recon.clips_half_up(wanted, there, a.pad_start, a.pad_end)
    sinks.split(flagged, "present", f"{a.out}/present", f"{a.out}/todo")


def captions(spark, a):
    """Caption files to word tables, times spread evenly over each cue."""
    cues = files.cues(spark, a.path)
    w = cues.select("file", "seg", "start", "end", "confidence", "retried", F.posexplode(S.tokens("text")).alias("k", "word"), F.size(S.tokens("text")).alias("n"))
    step = (F.col("end") - F.col("start")) / F.col("n")
    rows = w.select("file", "seg", "word", (F.col("start") + F.col("k") * step).alias("start"), (F.col("start") + (F.col("k") + 1) * step).alias("end"), "confidence", "retried")
    rows.write.mode("overwrite").parquet(a.out)


def quality(spark, a):
    words = files.words_strict(spark, a.path)
    per = reports.per_file(words, "file")
    sinks.quality_json(reports.summary(per), per, a.out)


def update(spark, a):
    """Metadata documents into a keyed table of videos: a new version is written;
    with --merge into a table of buckets, of which only those touched are rewritten."""
    new = tables.distinct_on(files.info(spark, a.path), "ytid", [F.col("upload_date").desc_nulls_last(), F.length("url").desc(), F.col("file")])
    cols = ["url", "title", "upload_date", "duration_sec", "channel", "channel_id", "extractor_key", "tags", "categories"]
    new = new.select("ytid", *cols).withColumns({"upload_type": F.lit(None).cast("string"), "title_date": S.title_date("title")})
    if a.merge:
        KeyedTable.at(spark, a.out, new.schema, ["ytid"]).merge(new.drop("upload_type"), overwrite=cols, fill=["title_date"])
        return
    if a.old:
        new = tables.upsert(spark.read.parquet(a.old), new.drop("upload_type"), ["ytid"], overwrite=cols, fill=["title_date"])
    new.write.mode("errorifexists").parquet(a.out)


def dates(spark, a):
    """find-missing, compare: date lists against file names."""
    wanted = files.items(spark, a.path).select(F.try_to_date("item", "yyyy-MM-dd").alias("day")).where("day is not null")
    there = files.listing(spark, a.files).select(S.name_date("name", a.prefix).alias("day")).where("day is not null")
    if a.action == "compare":
        recon.compare_sets(wanted, there, "day").write.mode("overwrite").parquet(a.out)
    elif a.action == "move":
        sinks.move_plan(files.listing(spark, a.files), wanted, a.dest, a.prefix).write.mode("overwrite").parquet(a.out)
    else:
        sinks.tsv(recon.missing(wanted, there, ["day"]).select(S.date_text("day").alias("date")), a.out, ["date"])


def voice(spark, a):
    """Embeddings (file, embedding) against the mean of reference ones."""
    sinks.voice_json(reports.similarity(spark.read.parquet(a.path), spark.read.parquet(a.reference), threshold=a.threshold), a.out, a.name)


def stitch(spark, a):
    """Ordered batch lists of clip files."""
    ordered = recon.clip_order(files.listing(spark, a.path), a.sort, ["path"], a.size)
    sinks.batch_lists(ordered).write.mode("overwrite").parquet(a.out)


def watch(spark, a):
    """Alerts of growing logs (a log, a folder or a glob), rotated ones too,
    debounced by arrival second; the next call goes on where this one ends."""
    lines = alerts.matching(alerts.follow(spark, a.path), "value", a.match)
    at = F.unix_timestamp(F.current_timestamp()).alias("at")
    alerts.drain(alerts.debounced(lines.select(F.lit(0).cast("long").alias("k"), F.xxhash64("value").alias("ord"), at), a.debounce), a.out, a.checkpoint)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cuemill")
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, *more):
        s = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        s.add_argument("path")
        s.add_argument("--out", required=True)
        for names, options in more:
            s.add_argument(names, **options)
        s.set_defaults(run=f)

    pads = [("--pad-start", {"default": 0, "type": int}), ("--pad-end", {"default": 0, "type": int})]
    text_pads = [("--pad-start", {"default": "0.00"}), ("--pad-end", {"default": "0.00"})]
    add(hits, ("--query", {"required": True}), ("--source", {"choices": ["words", "tslog"], "default": "words"}), ("--mode", {"choices": ["substring", "normalised"], "default": "substring"}), ("--window", {"type": int}), ("--exact", {"action": "store_true"}), *pads)
    add(sections)
    add(filter_clips, ("--clips", {"required": True}), ("--tolerant", {"action": "store_true"}), *text_pads)
    add(captions)
    add(quality)
    add(update, ("--old", {}), ("--merge", {"action": "store_true"}))
    add(dates, ("--action", {"choices": ["find-missing", "compare", "move"], "default": "find-missing"}), ("--files", {"required": True}), ("--prefix", {"required": True}), ("--dest", {"default": "moved"}))
    add(voice, ("--reference", {"required": True}), ("--threshold", {"type": float, "default": 0.7}), ("--name", {"default": "speaker"}))
    add(stitch, ("--sort", {"choices": ["date_timestamp", "timestamp", "name", "time"], "default": "date_timestamp"}), ("--size", {"type": int, "default": 100}))
    add(watch, ("--match", {"required": True}), ("--debounce", {"type": int, "default": 10}), ("--checkpoint", {"required": True}))
    return p


def main(argv=None, spark=None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName(f"cuemill {a.command}").getOrCreate(), a)
