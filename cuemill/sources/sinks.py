"""Edge writers.  Between stages everything stays Parquet; these give the text
forms that other tools read.  Rows of one output file are put in order inside
their group, so no global sort is needed for per-file formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .key_files import write_files

PUBLIC_HITS = ["url", "start", "end", "label", "source_caption", "source_type"]


def tsv(df: DataFrame, path: str, order: list | None = None, compression: str = "none") -> None:
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").options(sep="\t", header=True, quote="\u0000", escape="\u0000", emptyValue="", compression=compression).option("zlib.compress.level", "BEST_SPEED").csv(path)


def hits_rows(hits: DataFrame) -> DataFrame:
    """The public columns with three decimals."""
    three = lambda c: F.col(c).cast("decimal(18,3)").cast("string")
    return hits.select("url", three("start").alias("start"), three("end").alias("end"), S.scrub("label").alias("label"), S.scrub("source_caption").alias("source_caption"), "source_type")


def sections(clips: DataFrame, key: str = "url") -> DataFrame:
    """One row per URL: its spans ``s-e``, sorted, comma-joined."""
    span = lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))
    return clips.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start", "end"))), span), ",").alias("sections"))


def _joined(df: DataFrame, key: str, order: str, line: Column, head: str = "", mark: str = "\n") -> DataFrame:
    rows = df.select(key, F.struct(F.col(order).alias("o"), line.alias("line")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select(key, F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x["line"]), mark)).alias("value"))


def _vtt_line() -> Column:
    """A cue of a caption file; the note stands directly on it, so readers find it."""
    note = F.when(F.col("confidence") != 0, F.concat(F.lit("NOTE Confidence: "), F.format_string("%.3f", "confidence"), F.when(F.col("retried"), " [RETRIED]").otherwise(""), F.lit("\n"))).otherwise("")
    return F.concat(note, S.clock("start"), F.lit(" --> "), S.clock("end"), F.lit("\n"), F.trim("text"), F.lit("\n"))


def _srt_line(order: str) -> Column:
    """Numbered from the ordinal, so blank cues leave gaps."""
    return F.concat((F.col(order) + 1).cast("string"), F.lit("\n"), S.clock("start", ","), F.lit(" --> "), S.clock("end", ","), F.lit("\n"), F.trim("text"), F.lit("\n"))


def _stamped(cues: DataFrame, key: str, gap: float, order: str) -> tuple[DataFrame, Column]:
    """Cues and their lines, stamped at most once per ``gap`` seconds."""
    from ..operators.intervals import spaced

    stamps = spaced(cues.select(key, order, "start"), key, "start", gap, order).select(key, order, F.lit(True).alias("__s"))
    stamp = F.concat(F.lit("["), F.substring(S.clock(F.floor("start")), 1, 8), F.lit("] "))
    return cues.join(stamps, [key, order], "left"), F.concat(F.when(F.col("__s"), stamp).otherwise(""), F.trim("text"))


def vtt(cues: DataFrame, key: str = "file", order: str = "seg") -> DataFrame:
    """(key, value): caption files; blank cues are left out."""
    return _joined(cues.where(F.trim("text") != ""), key, order, _vtt_line(), "WEBVTT\n\n")


def srt(cues: DataFrame, key: str = "file", order: str = "seg") -> DataFrame:
    return _joined(cues.where(F.trim("text") != ""), key, order, _srt_line(order))


def text(cues: DataFrame, key: str = "file", order: str = "seg") -> DataFrame:
    return _joined(cues.where(F.trim("text") != ""), key, order, F.trim("text"))


def tslog(cues: DataFrame, key: str = "file", gap: float = 10.0, order: str = "seg") -> DataFrame:
    """Cue texts, stamped at most once per ``gap`` seconds."""
    rows, line = _stamped(cues, key, gap, order)
    return _joined(rows.where(F.trim("text") != ""), key, order, line)


def transcript_files(cues: DataFrame, path: str, kind: str, key: str = "file", order: str = "seg", gap: float = 10.0, end: Column | None = None, folders: int = 0) -> None:
    """The files themselves, one per key, streamed: ``kind`` is vtt, srt, txt or
    tslog.txt; ``end`` stands behind the end time of a vtt cue; ``folders``: see
    ``write_files``."""
    rows, line = _stamped(cues, key, gap, order) if kind == "tslog.txt" else (cues, {"vtt": _vtt_line(), "srt": _srt_line(order), "txt": F.trim("text")}[kind])
    if kind == "vtt" and end is not None:
        line = F.regexp_replace(line, F.lit(r"( --> [0-9:.]+)"), F.concat(F.lit("$1"), end))
    name = F.concat(F.col(key).cast("string"), F.lit(f".{kind}"))
    write_files(rows.where(F.trim("text") != ""), path, name, [order], line, "WEBVTT\n\n" if kind == "vtt" else "", folders=folders)


def words_rows(words: DataFrame) -> DataFrame:
    three = lambda c: F.col(c).cast("decimal(18,3)").cast("string")
    return words.select(three("start").alias("start"), three("end").alias("end"), "word", "seg", three("confidence").alias("confidence"), F.col("retried").cast("int").alias("retried"))


def manifest_rows(segments: DataFrame, *keep: str) -> DataFrame:
    return segments.select(*keep, "media_file", "segment_idx", *[F.col(c).cast("decimal(18,3)").cast("string").alias(c) for c in ("start_time", "end_time", "confidence")], S.scrub("text").alias("text"))


def split(flagged: DataFrame, flag: str, yes: str, no: str) -> None:
    """Two outputs of one flagged frame: it is computed once."""
    flagged = flagged.persist()
    try:
        flagged.where(flag).drop(flag).write.mode("overwrite").parquet(yes)
        flagged.where(~F.col(flag)).drop(flag).write.mode("overwrite").parquet(no)
    finally:
        flagged.unpersist()


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def quality_json(summary: DataFrame, files: DataFrame, path: str) -> None:
    """The summary and one line per file, side by side; files are not gathered."""
    json_rows(summary, f"{path}/summary")
    json_rows(files, f"{path}/files")


def voice_json(scored: DataFrame, path: str, name: str = "speaker") -> None:
    json_rows(scored.select("file", F.col("similarity"), F.col("matches").cast("boolean").alias(f"is_{name}"), *[c for c in scored.columns if c == "error"]), f"{path}/analysis")
    scored.where("matches").select(F.col("file").alias("value")).write.mode("overwrite").text(f"{path}/matched")


def provenance_new(wanted: DataFrame, there: DataFrame, key: str = "id") -> DataFrame:
    """Sidecars that are not there yet: they are written once."""
    return wanted.join(there.select(key), key, "left_anti")


def archive_appended(archive: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """An archive with further entries: each (extractor, id) once, at its first
    place; ``order`` holds the places in both, the archive's come first."""
    both = archive.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    rows = both.groupBy("extractor", "id").agg(F.min(F.struct("__side", order)).alias("__at"))
    return rows.select("extractor", "id", F.col(f"__at.{order}").alias(order))


def id_list(videos: DataFrame, key: str = "ytid") -> DataFrame:
    """The sorted distinct ids of a batch."""
    return videos.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)


def wordspan(match: DataFrame) -> DataFrame:
    """A match as a JSON document with its frames."""
    rate = S.fps("fps_text")
    return match.select(F.to_json(F.struct("target", "start_sec", "end_sec", rate.alias("fps"), S.frame("start_sec", rate).alias("start_frame"), S.frame("end_sec", rate, True).alias("end_frame"), "input", "model")).alias("value"))


def move_plan(files: DataFrame, dates: DataFrame, target: str, prefix: str) -> DataFrame:
    """What would be moved where: files whose date is wanted.  Nothing is moved."""
    d = files.withColumn("day", S.name_date("name", prefix))
    return d.join(dates.select("day").distinct(), "day", "left_semi").select("path", F.concat(F.lit(target.rstrip("/") + "/"), "name").alias("to"), "day")


def with_companions(moves: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """A move plan with the ``stem*.json`` files beside each file: (path, to, day).
    ``files`` (path, name) is the listing; a companion lies in the same folder, and
    its name begins with the stem and a dot."""
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    stem = moves.select(folder("path").alias("__f"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("__s"), "day")
    json = files.where(F.col("name").endswith(".json")).select("path", "name", folder("path").alias("__g"))
    # every beginning of a companion's name that ends at a dot may be the stem
    cut = json.select("path", "name", "__g", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\.")) - 1), lambda k: F.array_join(F.slice(F.split("name", r"\."), F.lit(1), k), "."))).alias("__t"))
    more = cut.join(stem, (F.col("__g") == F.col("__f")) & (F.col("__t") == F.col("__s"))).select("path", F.concat(F.lit(target.rstrip("/") + "/"), "name").alias("to"), "day")
    return moves.select("path", "to", "day").unionByName(more).distinct()


def date_sections(compared: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(section, place, line): the three lists of a comparison, headed, in order:
    only left, only right, both."""
    order = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    heads = F.array(F.lit(f"DATES ONLY IN {names[0]}:"), F.lit(f"DATES ONLY IN {names[1]}:"), F.lit("DATES IN BOTH:"))
    body = compared.select(order.alias("section"), F.row_number().over(Window.partitionBy("side").orderBy(key)).alias("place"), F.col(key).cast("string").alias("line"))
    head = compared.sparkSession.range(3).select(F.col("id").cast("int").alias("section"), F.lit(0).alias("place"), F.get(heads, F.col("id").cast("int")).alias("line"))
    return head.unionByName(body)


def pull_logs(requested: DataFrame, succeeded: DataFrame, key: str = "id") -> DataFrame:
    """(log, key, line) of the four logs of a run: what was asked for, what came,
    what failed, and the URLs of that."""
    ok = succeeded.select(key).distinct()
    row = F.concat_ws("\t", key, "url", "extractor", S.scrub("title"))
    failed = requested.join(ok, key, "left_anti")
    say = lambda df, log, line: df.select(F.lit(log).alias("log"), key, line.alias("line"))
    return say(requested, "requested", row).unionByName(say(requested.join(ok, key, "left_semi"), "succeeded", row)).unionByName(say(failed, "failed", row)).unionByName(say(failed, "failed_urls", F.col("url")))


def provenance_rows(media: DataFrame) -> DataFrame:
    """(id, value): the sidecar documents of media (columns of the schema; an absent
    URL is the watch URL)."""
    url = F.coalesce(F.nullif("url", F.lit("")), S.watch_url("id"))
    fields = [url.alias("url") if c == "url" else F.col(c) for c in ("platform", "id", "url", "title", "uploader", "upload_date", "duration", "base_offset") if c in media.columns or c == "url"]
    return media.select("id", F.to_json(F.struct(*fields)).alias("value"))


def batch_lists(batched: DataFrame, name: str = "path") -> DataFrame:
    """One list per batch, quoted for concatenation."""
    return _joined(batched, "batch", "ordinal", F.concat(F.lit("file '"), S.list_quote(name), F.lit("'")))


def rewritten(old: DataFrame, new: DataFrame, backups: DataFrame, key: str = "path") -> DataFrame:
    """(path, value) of what a rewrite of text files (key, value) puts down: every
    new text, and the old one as ``.bak`` where there is no backup (key) yet.
    Nothing is changed in place."""
    changed = new.select(F.col(key).alias("path"), "value")
    first = old.join(new.select(key), key, "left_semi").withColumn("path", F.concat(F.col(key), F.lit(".bak")))
    known = backups.select(F.col(key).alias("path"))
    return changed.unionByName(first.join(known, "path", "left_anti").select("path", "value"))


def existing_list(names: DataFrame, name: str = "name") -> DataFrame:
    """The sorted distinct names of segments that are there."""
    return names.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name)
