"""Readers: word tables, captions, stamped logs, metadata documents, lists.

Everything is read as text and converted where it is used, as the files come in
several dialects.  Readers give one DataFrame whatever the number of files; the
file's name supplies the columns that it carries.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import schemas
from .folders import FolderListing
from .shared import staged

#: Names under which a column may appear, first come first served.
ALIASES = {
    "word": ("word", "token", "term"),
    "start": ("start", "start_sec", "time", "ts", "offset"),
    "end": ("end", "end_sec", "stop", "to"),
    "id": ("ytid", "video_id", "id"),
    "url": ("url", "webpage_url"),
}
MEDIA = ("mp4", "mkv", "webm", "mov", "m4a", "mp3", "opus", "wav", "flac", "ogg", "aac")


def file_name() -> Column:
    """The bare file name; percent escapes of the listing are undone."""
    return _name(F.input_file_name())


def _name(path: Column) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value", file_name().alias("file"))


def whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", file_name().alias("file"))


def whole_below(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """The same for all files below a folder with an extension.  They are listed and read
    folder by folder, so that very many small ones make no more tasks than folders."""
    return folder_listing(spark, path, (extension,)).select("path", "name").mapInArrow(_contents(path), "value string, file string")


def _contents(path: str, most: int = 16 << 20):
    """(value, file) of files (path, name), in batches of about ``most`` bytes."""

    def run(batches):
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            texts, names, size = [], [], 0
            for at, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(at) as f:
                    texts.append(f.read())
                names.append(name)
                size += len(texts[-1])
                if size > most:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string(), safe=False), pa.array(names)], names=["value", "file"])
                    texts, names, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string(), safe=False), pa.array(names, pa.string())], names=["value", "file"])

    return run


def tsv(spark: SparkSession, path: str | list[str], quote: str = "", null: str = "", sep: str = "\t") -> DataFrame:
    """A headered table, all text.  Quoting is off unless given, so JSON columns
    and words with ``"`` survive."""
    return spark.read.options(sep=sep, header=True, quote=quote, nullValue=null, inferSchema=False, mode="PERMISSIVE").csv(path)


def bulk(spark: SparkSession, path, schema: str, quote: str = "") -> DataFrame:
    """A staging load: typed by position; an unreadable row is an error."""
    return spark.read.options(sep="\t", header=True, quote=quote, nullValue="", mode="FAILFAST", dateFormat="yyyy-MM-dd").schema(schema).csv(path)


#: Splits up to which what is known of them is handed to all tasks.
FEW = 50_000


def _with_splits(rows: DataFrame, splits: DataFrame, few: bool) -> DataFrame:
    own = splits.withColumnsRenamed({"path": "__p", "block": "__b"})
    return rows.join(F.broadcast(own) if few else own, (F.col("path") == F.col("__p")) & (F.col("block") == F.col("__b"))).drop("__p", "__b")


def _raw(spark: SparkSession, path, **known: Column) -> tuple[DataFrame, bool]:
    """The lines of tables (table, file, path, block, m, pos, line, ``known``) with their
    position in the table, from 1 behind the header; and whether they come as they are
    read, with all lines of a split in one task and in order.

    A table is a file or all files ``NAME.part-NUMBER.EXTENSION`` of a name: parts follow
    each other by number and each begins with the header.  Files are read in
    splits by many tasks.  Lines have a number ``m`` that counts on inside a split, so a
    position is the place in the split and the lines of the table's splits before, one
    small row each.  These are read first, and the lines, which need not be written
    anywhere, again.  What ``known`` makes of the ``header`` is made once a split."""
    at = F.col("_metadata.file_path")
    rows = spark.read.text(path).select("value", at.alias("path"), F.col("_metadata.file_block_start").alias("block")).withColumn("m", F.monotonically_increasing_id())
    # beside a list, even one of nothing, the first line is kept in a hash table: it needs no sort of all lines
    first = F.coalesce(F.min_by("value", "m"), F.get(F.collect_list(F.lit(None).cast("string")), 0)).alias("header")
    table = F.regexp_replace(F.regexp_replace("path", r"\.gz$", ""), r"\.part-[0-9]+(\.[^/]*)$", "$1")
    own = rows.groupBy("path", "block").agg(F.min("m").alias("first"), F.count("*").alias("n"), first).withColumn("table", table).withColumn("head", (F.col("block") == 0).cast("long"))
    header = F.first("header").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumns({"header": header, "shift": _before("n - head") - F.col("first") - F.col("head") + 1})
    splits = staged(own.select("path", "block", "first", "head", "shift", "table", _name(F.col("table")).alias("file"), *[c.alias(k) for k, c in known.items()]), "splits")
    few = splits.count() <= FEW
    out = _with_splits(rows, splits, few).where("head = 0 or m > first").withColumn("pos", F.col("m") + F.col("shift"))
    return out.select("table", "file", "path", "block", "m", "pos", F.col("value").alias("line"), *known), few


def _before(count: str) -> Column:
    """The sum of a count over a table's splits before."""
    return F.coalesce(F.sum(F.expr(count)).over(Window.partitionBy("table").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _counted(rows: DataFrame, idx: str, as_read: bool) -> DataFrame:
    """``rows`` (table, path, block, m, ...) numbered from 1 in each table: in their split
    and by the rows of the splits before.  Rows ``as_read`` need no sort for that."""
    place = F.monotonically_increasing_id() if as_read else F.row_number().over(Window.partitionBy("path", "block").orderBy("m"))
    rows = rows.withColumn("m", place)
    splits = rows.groupBy("table", "path", "block").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    splits = staged(splits.select("path", "block", "first", _before("n").alias("before")), "counts")
    return _with_splits(rows, splits, as_read).withColumn(idx, F.col("m") - F.col("first") + F.col("before") + 1)


def _at(names: tuple[str, ...], header: Column) -> Column:
    """The place of the first named column that the header has, from 1; NULL if none."""
    return F.coalesce(*[F.nullif(F.array_position(header, F.lit(n)), F.lit(0)) for n in names]).cast("int")


def _field(place: str, parts: Column) -> Column:
    """The field at a place; NULL if there is none."""
    return F.get(parts, F.col(place) - 1)


def words_by_header(spark: SparkSession, path) -> DataFrame:
    """Columns by lower-cased name; missing ones default.  Rows with unreadable
    times go, empty times are 0; ``idx`` counts the kept rows from 1."""
    h, p = F.split(F.lower("header"), "\t"), F.split("line", "\t")
    raw, as_read = _raw(spark, path, **{f"at_{n}": _at((n,), h) for n in ("word", "start", "end", "confidence", "seg", "retried")})
    one = lambda name: _field(f"at_{name}", p)
    time = lambda name: F.coalesce(F.nullif(one(name), F.lit("")), F.lit("0"))
    df = raw.where(F.col("line") != "").select(
        "table", "path", "file", "block", "m", F.coalesce(one("word"), F.lit("")).alias("word"), time("start").try_cast("double").alias("start"), time("end").try_cast("double").alias("end"),
        F.coalesce(one("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(one("seg").try_cast("int"), F.lit(0)).alias("seg"), F.coalesce(one("retried"), F.lit("0")).isin("1").alias("retried"),
    ).where("start is not null and end is not null")
    return _counted(df, "idx", as_read).select(S.id_in_name("file").alias("ytid"), S.media_kind("file").alias("source"), "idx", "word", "start", "end", "confidence", "seg", "retried", "file")


def words_by_alias(spark: SparkSession, path) -> DataFrame:
    """Columns by any of their aliases, tab or comma, no quoting.  Blank words and
    unreadable starts go; a missing end is NULL."""
    mark = F.when(F.length(F.regexp_replace("header", "[^\t]", "")) >= F.length(F.regexp_replace("header", "[^,]", "")), "\t").otherwise(",")
    h, p = F.split(F.lower("header"), mark), F.split(F.col("line"), F.col("mark"))
    raw, _ = _raw(spark, path, mark=mark, **{f"at_{k}": _at(names, h) for k, names in ALIASES.items()})
    get = lambda k: _field(f"at_{k}", p)
    df = raw.select("file", "pos", F.trim(get("word")).alias("word"), get("start").try_cast("double").alias("start"), get("end").try_cast("double").alias("end"), get("id").alias("id"), get("url").alias("url"))
    df = df.where("word <> '' and start is not null")
    vid = F.coalesce(F.nullif("id", F.lit("")), S.video_id("url"), S.id_at_start("file"))
    return df.select(vid.alias("ytid"), F.coalesce(F.nullif("url", F.lit("")), S.watch_url(vid)).alias("url"), F.col("pos").alias("idx"), "word", "start", "end", "file")


def words_strict(spark: SparkSession, path) -> DataFrame:
    """Rows with at least as many fields as the header; numbers default to 0."""
    h, p = F.split(F.lower("header"), "\t"), F.split("line", "\t")
    raw, _ = _raw(spark, path, width=F.size(h), **{f"at_{n}": _at((n,), h) for n in ("word", "start", "end", "seg", "confidence", "retried")})
    raw = raw.where(F.size(p) >= F.col("width"))
    number = lambda n, t: F.coalesce(_field(f"at_{n}", p).try_cast(t), F.lit(0).cast(t))
    return raw.select("file", F.col("pos").alias("idx"), _field("at_word", p).alias("word"), number("start", "double").alias("start"), number("end", "double").alias("end"), number("seg", "int").alias("seg"), number("confidence", "double").alias("confidence"), (number("retried", "int") == 1).alias("retried"))


def cues_of(docs: DataFrame, text: str = "value", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """Caption cues of whole VTT texts.  A confidence note may stand directly
    before the time line or a blank line earlier, with or without a retry mark;
    style words behind the end time are dropped, ends before starts are lifted."""
    time = r"((?:[0-9]+:)?[0-9]+:[0-9]+[.,][0-9]{1,3})"
    own = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), r"\r\n?", "\n")
    # a note and the cue that follows it become one block
    own = F.regexp_replace(own, r"(?m)^(NOTE Confidence:[^\n]*)\n\n+", "$1\n")
    block = docs.select(*keep, F.posexplode(F.split(own, r"\n[ \t]*\n+")).alias("pos", "block"))
    head = rf"(?m)^\s*{time}\s*-->\s*{time}[^\n]*$"
    block = block.where(F.col("block").rlike(head))
    raw_start, raw_end = S.extract("block", head, 1), S.extract("block", head, 2)
    note = S.extract("block", r"(?m)^NOTE Confidence:\s*(-?[0-9.]+)", 1).try_cast("double")
    body = F.regexp_extract("block", rf"(?ms)^\s*{time}\s*-->\s*{time}[^\n]*\n?(.*)", 3)
    start, end = S.seconds_loose(raw_start), S.seconds_loose(raw_end)
    return block.select(
        *keep, F.col("pos"), raw_start.alias("raw_start"), raw_end.alias("raw_end"), start.alias("start"), F.greatest(end, start).alias("end"),
        S.plain(body).alias("text"), body.alias("raw_text"), F.coalesce(note, F.lit(0.0)).alias("confidence"), F.col("block").rlike(r"(?m)^NOTE Confidence:.*\[RETRIED\]").alias("retried"),
    )


def cues(spark: SparkSession, path, below: bool = False) -> DataFrame:
    """The cues of caption files; ``below``: of all in the folder ``path``, at any depth."""
    out = cues_of(whole_below(spark, path, "vtt") if below else whole(spark, path))
    seg = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    return out.withColumn("seg", seg).withColumn("lang", S.caption_language("file"))


def stamped(df: DataFrame, text: str = "value") -> DataFrame:
    """Lines ``[HH:MM:SS] caption`` with their second; others go."""
    p = r"^\[([0-9]{2}):([0-9]{2}):([0-9]{2})\]\s+(.*)$"
    part = lambda k: F.regexp_extract(text, p, k)
    at = part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")
    return df.where(F.col(text).rlike(p)).withColumns({"sec": at, "caption": part(4)})


def stamped_logs(spark: SparkSession, path) -> DataFrame:
    return stamped(lines(spark, path)).select(S.id_at_start("file").alias("ytid"), "sec", "caption", "file")


def info(spark: SparkSession, path) -> DataFrame:
    """Metadata documents as videos; unreadable ones go."""
    d = whole(spark, path).withColumn("j", F.from_json("value", schemas.INFO))
    pick = lambda *c: F.coalesce(*[F.nullif(F.col(f"j.{x}"), F.lit("")) for x in c])
    return d.where("j.id is not null").select(
        F.col("j.id").alias("ytid"), pick("webpage_url", "original_url").alias("url"), S.scrub("j.title").alias("title"), S.compact_date("j.upload_date").alias("upload_date"),
        F.col("j.duration").cast("int").alias("duration_sec"), S.scrub(pick("channel", "uploader")).alias("channel"), pick("channel_id", "uploader_id").alias("channel_id"), pick("extractor_key", "extractor").alias("extractor_key"),
        F.coalesce("j.tags", F.expr("array()").cast("array<string>")).alias("tags"), F.coalesce("j.categories", F.expr("array()").cast("array<string>")).alias("categories"),
        F.lower(F.coalesce(pick("availability"), F.lit("none"))).alias("availability"), F.lower(F.coalesce(pick("live_status"), F.lit("none"))).alias("live_status"), F.coalesce(S.has_audio("j.formats"), F.lit(False)).alias("has_audio"), "file",
    )


def provenance(spark: SparkSession, path) -> DataFrame:
    return whole(spark, path).withColumn("j", F.from_json("value", schemas.PROVENANCE)).where("j.id is not null").select("j.*", "file")


def entries_of(docs: DataFrame, text: str = "value") -> DataFrame:
    """Entries of playlist documents, nested ones flattened; lines that cannot be
    read, and entries without id or URL, go."""
    fields = [x.split(" ")[0] for x in schemas.ENTRY.split(", ")]
    own = F.struct(*[F.col(f"j.{f}") for f in fields])
    d = docs.withColumn("j", F.from_json(text, schemas.PLAYLIST))
    flat = d.withColumn("e", F.explode(F.when(F.coalesce(F.size("j.entries"), F.lit(-1)) > 0, F.col("j.entries")).otherwise(F.array(own))))
    url = F.coalesce(F.nullif("e.webpage_url", F.lit("")), F.nullif("e.url", F.lit("")))
    given = F.coalesce(F.nullif("e.ie_key", F.lit("")), F.nullif("e.extractor_key", F.lit("")), F.nullif("e.extractor", F.lit("")))
    out = flat.withColumns({"id": F.nullif("e.id", F.lit("")), "url": url, "extractor": S.extractor(given, url), "title": S.scrub("e.title")})
    return out.where("id is not null and url is not null").drop("j", "e")


def clip_list(spark: SparkSession, path) -> DataFrame:
    """A clip list as it stands; rows of fewer than three fields go."""
    raw, _ = _raw(spark, path)
    p = F.split("line", "\t")
    return raw.where(F.size(p) >= 3).select("pos", "line", F.get(p, 0).alias("url"), F.get(p, 1).alias("start_text"), F.get(p, 2).alias("end_text"), F.get(p, 1).try_cast("decimal(12,3)").alias("start"), F.get(p, 2).try_cast("decimal(12,3)").alias("end"))


def clips_of_names(names: DataFrame, name: str = "name", only_mp4: bool = True) -> DataFrame:
    """Existing clips from names ``ID_title_S-E.ext``; zero-padded numbers and
    plain ones are the same.  Two or three decimals and mp4 only, or exactly two
    decimals and any extension."""
    places, ext = ("{2,3}", "mp4") if only_mp4 else ("{2}", "[A-Za-z0-9]+")
    p = rf"^({S.ID})_.*_([0-9]+\.[0-9]{places})-([0-9]+\.[0-9]{places})\.{ext}$"
    return names.where(F.col(name).rlike(p)).select(S.extract(name, p, 1).alias("id"), S.extract(name, p, 2).cast("decimal(12,3)").alias("start"), S.extract(name, p, 3).cast("decimal(12,3)").alias("end"), F.col(name).alias("file"))


def listing(spark: SparkSession, path, extensions: tuple[str, ...] = ()) -> DataFrame:
    """Files with size and time, from the file system's listing: no content is read.
    Empty files do not appear, as Spark plans no split for them."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    df = df.withColumn("name", F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))))
    return df.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*extensions)) if extensions else df


def folder_listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """The files below a folder (path, name, length, modified), listed by tasks,
    empty ones too, as marks are."""
    spark.dataSource.register(FolderListing)
    df = spark.read.format("folder_listing").option("path", path).load()
    return df.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*extensions)) if extensions else df


def captions(spark: SparkSession, path: str) -> DataFrame:
    """The caption files below a folder: (ytid, lang, path, length), the language from
    the name; those that hold nothing too."""
    df = folder_listing(spark, path, ("vtt",))
    return df.select(S.id_in_name("name").alias("ytid"), S.caption_language("name").alias("lang"), "path", "length")


def manifest(spark: SparkSession, path) -> DataFrame:
    """Retry manifests; one bad row discards its file."""
    raw = _raw(spark, path)[0].where(F.col("line") != "")
    p = F.split("line", "\t")
    row = F.struct(F.get(p, 0).alias("media_file"), F.get(p, 1).try_cast("int").alias("segment_idx"), F.get(p, 2).try_cast("double").alias("start_time"), F.get(p, 3).try_cast("double").alias("end_time"), F.get(p, 4).try_cast("double").alias("confidence"), F.coalesce(F.get(p, 5), F.lit("")).alias("text"))
    df = raw.withColumn("r", row).withColumn("ok", F.col("r.segment_idx").isNotNull() & F.col("r.start_time").isNotNull() & F.col("r.end_time").isNotNull() & F.col("r.confidence").isNotNull())
    return df.withColumn("all_ok", F.min("ok").over(Window.partitionBy("table"))).where("all_ok").select("file", "r.*")


def unprocessed(manifests: DataFrame, processed: DataFrame, first: int | None = None) -> DataFrame:
    """Manifests without a ``.processed`` sibling, the first few by name if asked."""
    done = processed.select(F.regexp_replace("name", r"\.processed$", "").alias("name"))
    out = manifests.join(done, "name", "left_anti")
    return out if first is None else out.orderBy("name").limit(first)


def listed(items_: DataFrame, files: DataFrame, home: str) -> DataFrame:
    """The files of a list (``item``, ``~`` for the home folder) that are there."""
    own = items_.select(F.regexp_replace("item", "^~", home).alias("path")).distinct()
    return files.join(own, "path", "left_semi")


def items(spark: SparkSession, path) -> DataFrame:
    """A list of one item per line: trimmed, blanks and ``#`` comments skipped."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where("item <> '' and not startswith(item, '#')")


def archive_of(df: DataFrame, text: str = "value") -> DataFrame:
    """Download archive lines: extractor and id."""
    p = F.split(F.trim(text), r"\s+")
    return df.where(F.size(p) >= 2).withColumns({"extractor": F.get(p, 0), "id": F.get(p, 1)})


def title_cache(spark: SparkSession, path) -> DataFrame:
    """A JSON map from id to title."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "title"))
    return d


def corrections(spark: SparkSession, path) -> DataFrame:
    p = F.split("value", "\t")
    return spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#")) & (F.size(p) >= 2)).select(F.get(p, 0).alias("miss"), F.get(p, 1).alias("fix"))


def hotwords(spark: SparkSession, path, *keep: str) -> DataFrame:
    """Distinct terms as first seen, joined with commas, one row a file, with the
    partition columns of the folder that are to be kept."""
    whole_ = spark.read.text(path, wholetext=True)
    terms = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return whole_.select(*keep, F.array_join(F.array_distinct(terms), ", ").alias("hotwords"))


def latest_nonempty(files: DataFrame) -> DataFrame:
    return files.where("length > 0").orderBy(F.col("modified").desc(), F.col("path").desc()).limit(1)


def with_url(ids: DataFrame, sidecars: DataFrame, key: str = "id") -> DataFrame:
    """The URL of an id from its sidecar, else the watch URL."""
    s = sidecars.groupBy(F.col("id").alias("__k")).agg(F.min("url").alias("__u"))
    return ids.join(s, F.col(key) == F.col("__k"), "left").withColumn("url", F.coalesce("__u", S.watch_url(key))).drop("__k", "__u")


def with_media(ids: DataFrame, files: DataFrame, key: str = "id", sidecars: DataFrame | None = None) -> DataFrame:
    """The first media file of an id, by extension order and path; else, from its
    sidecar (id, path without extension), the path that the audio would have."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    rank = F.nullif(F.array_position(F.array(*map(F.lit, MEDIA)), ext), F.lit(0))
    m = files.withColumns({"__k": S.id_before_mark("name"), "__r": rank}).where("__r is not null").groupBy("__k").agg(F.min_by("path", F.struct("__r", "path")).alias("media"))
    out = ids.join(m, F.col(key) == F.col("__k"), "left").drop("__k")
    if sidecars is None:
        return out
    base = sidecars.groupBy(F.col("id").alias("__k")).agg(F.min("path").alias("__b"))
    return out.join(base, F.col(key) == F.col("__k"), "left").withColumn("media", F.coalesce("media", F.concat("__b", F.lit(".opus")))).drop("__k", "__b")


def discovered(media: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct ids of the media files of one listing and of any file of another."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    own = media.where(ext.isin(*MEDIA)).select(S.id_before_mark("name").alias("id"))
    return own.unionByName(other.select(S.id_before_mark("name").alias("id"))).where("id is not null").distinct()


def archive_keys(names: DataFrame, infos: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Distinct (extractor, id) of three kinds of file: media by the id that begins
    their ``name`` (youtube); metadata documents (id, extractor, url); provenance
    sidecars (file, id, extractor, url), whose extractor is that of the metadata of
    the same id if there is one, and whose id may stand in the file's name only."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    media = names.where(ext.isin("opus", "m4a", "mp3", "mp4", "mkv")).select(F.lit("youtube").alias("extractor"), S.id_at_start("name").alias("id"))
    info_ = infos.where("id is not null").select(S.extractor("extractor", "url").alias("extractor"), "id")
    given = infos.where("id is not null").groupBy(F.col("id").alias("__k")).agg(F.min("extractor").alias("__x"), F.min("url").alias("__u"))
    side = sidecars.withColumn("id", F.coalesce("id", S.id_at_start("file"))).join(given, F.col("id") == F.col("__k"), "left")
    own = side.select(S.extractor(F.coalesce("__x", "extractor"), F.coalesce("url", "__u")).alias("extractor"), "id")
    return media.unionByName(info_).unionByName(own).where("id is not null").distinct()


def entries_or_single(lists: DataFrame, single: DataFrame, request: str = "request") -> DataFrame:
    """Entries of playlist documents by ``request``; a request that gave none is
    read from its single document instead."""
    flat = entries_of(lists)
    rest = single.join(flat.select(request).distinct(), request, "left_anti")
    return flat.select(request, "id", "url", "extractor", "title").unionByName(entries_of(rest).select(request, "id", "url", "extractor", "title"))
