"""File grammars, traps of the domain and invariants, on hand-written files."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from cuemill.functions import scalars as S
from cuemill.operators import intervals, recon, reports, search, tables
from cuemill.sources import files, sinks

ID = "abcdefghijk"


@pytest.fixture()
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
        return str(p)

    return write


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(expression).first()[0]


def test_words_by_header(spark, put):
    p = put(f"{ID}__x.words.tsv", 'start\tend\tword\tseg\tconfidence\tretried\n0.0\t0.5\tsay\t0\t-0.7\t0\nbad\t1\tskip\t0\t0\t0\n\t1.0\t"quoted\t0\t-1.0\t1\n2.0\t2.5\tlast\t1\n')
    rows = files.words_by_header(spark, p).orderBy("idx").collect()
    assert [(r.idx, r.word, r.start, r.seg, r.confidence, r.retried) for r in rows] == [(1, "say", 0.0, 0, -0.7, False), (2, '"quoted', 0.0, 0, -1.0, True), (3, "last", 2.0, 1, 0.0, False)]
    assert {(r.ytid, r.source) for r in rows} == {(ID, "whisper")}  # segment 0 is kept


def test_words_by_alias(spark, put):
    p = put("alias.csv", f"token,time,stop,video_id\nHello,1.5,2.0,{ID}\n,3,4,{ID}\nno start,x,4,{ID}\nopen,5,,{ID}\n")
    rows = files.words_by_alias(spark, p).orderBy("idx").collect()
    assert [(r.word, r.start, r.end, r.ytid) for r in rows] == [("Hello", 1.5, 2.0, ID), ("open", 5.0, None, ID)]
    assert rows[0].url == S.WATCH + ID


def test_words_strict(spark, put):
    p = put("w.tsv", "start\tend\tword\tseg\n1\t2\ta\t0\n1\t2\tshort\nx\t2\tb\t1\n")
    assert [(r.word, r.start) for r in files.words_strict(spark, p).orderBy("idx").collect()] == [("a", 1.0), ("b", 0.0)]


VTT = """WEBVTT

NOTE Confidence: -0.85

00:00:01.000 --> 00:00:02.500 align:start position:0%
Hello <c.color>there</c>
 friend

NOTE Confidence: -1.20 [RETRIED]
00:00:03.000 --> 00:00:02.000
late

00:00:05.000 --> 00:00:06.000
plain
"""


def test_captions(spark, put):
    p = put(f"{ID}__x.transcript.de.vtt", VTT)
    rows = files.cues(spark, p).orderBy("seg").collect()
    # a note may stand a blank line before its cue, and may carry a mark
    assert [(r.start, r.end, r.text, r.confidence, r.retried) for r in rows] == [(1.0, 2.5, "Hello there friend", -0.85, False), (3.0, 3.0, "late", -1.2, True), (5.0, 6.0, "plain", 0.0, False)]
    assert rows[0].lang == "de" and rows[1].seg == 1


def test_captions_round_trip(spark, put):
    p = put(f"{ID}__x.transcript.de.vtt", VTT)
    cues = files.cues(spark, p)
    again = files.cues_of(sinks.vtt(cues)).orderBy("pos").collect()
    assert [(r.start, r.end, r.text, r.confidence, r.retried) for r in again] == [(r.start, r.end, r.text, r.confidence, r.retried) for r in cues.orderBy("pos").collect()]
    assert sinks.srt(cues).first().value.startswith("1\n00:00:01,000 --> 00:00:02,500\nHello there friend\n")


def test_stamped_log(spark, put):
    p = put(f"{ID}__x.tslog.txt", "[00:01:05] first\nunstamped\nNOTE x\n[0:1:5] bad\n[01:00:00]  hour\n")
    assert [(r.sec, r.caption, r.ytid) for r in files.stamped_logs(spark, p).orderBy("sec").collect()] == [(65, "first", ID), (3600, "hour", ID)]


def test_tslog_gap(spark):
    cues = spark.createDataFrame([("f", k, float(t), f"t{k}") for k, t in enumerate([0, 4, 9.5, 10, 19, 21])], "file string, seg int, start double, text string")
    text = sinks.tslog(cues).first().value
    assert text == "[00:00:00] t0\nt1\nt2\n[00:00:10] t3\nt4\n[00:00:21] t5"


def test_info(spark, put):
    put(f"{ID}__a.info.json", '{"id": "abcdefghijk", "webpage_url": "u", "title": "a\\nb", "upload_date": "20240105", "duration": 12.7, "uploader": "me", "extractor": "Youtube", "tags": ["x"], "formats": [{"acodec": "none"}, {"acodec": "opus"}]}')
    put("b__b.info.json", '{"id": "b", "upload_date": "20249999"}')
    p = put("c__bad.info.json", "{not json")
    rows = {r.ytid: r for r in files.info(spark, os.path.dirname(p) + "/*.info.json").collect()}
    assert set(rows) == {ID, "b"}
    r = rows[ID]
    assert (r.title, r.upload_date, r.duration_sec, r.channel, r.extractor_key, r.tags, r.has_audio, r.availability) == ("a b", datetime.date(2024, 1, 5), 12, "me", "Youtube", ["x"], True, "none")
    assert rows["b"].upload_date is None and not rows["b"].has_audio


def test_entries(spark, put):
    p = put("list.jsonl", '{"entries": [{"id": "a", "url": "https://www.youtube.com/watch?v=a", "title": "t\\tx"}, {"id": "b"}]}\nbad line\n{"id": "c", "webpage_url": "https://vimeo.com/1", "ie_key": ""}\n')
    rows = files.entries_of(spark.read.text(p)).collect()
    assert sorted((r.id, r.extractor, r.title) for r in rows) == [("a", "youtube", "t x"), ("c", "vimeo", None)]


def test_manifest_and_lists(spark, put):
    good = put("m/good.tsv", "media_file\tsegment_idx\tstart_time\tend_time\tconfidence\ttext\na.mp4\t0\t1.0\t2.0\t-0.9\thi\n")
    put("m/bad.tsv", "media_file\tsegment_idx\tstart_time\tend_time\tconfidence\ttext\na.mp4\t0\t1.0\t2.0\t-0.9\thi\na.mp4\tx\t1\t2\t3\t\n")
    assert [r.file for r in files.manifest(spark, os.path.dirname(good)).collect()] == ["good.tsv"]
    p = put("urls.txt", "# no\n\n https://a \nhttps://b\n")
    assert [r.item for r in files.items(spark, p).collect()] == ["https://a", "https://b"]
    p = put("hot.txt", "Beta\n# c\nAlpha\nBeta\n")
    assert files.hotwords(spark, p).first().hotwords == "Beta, Alpha"
    p = put("fix.tsv", "miss\tfix\n# a\tb\nno tab\n")
    assert [tuple(r) for r in files.corrections(spark, p).collect()] == [("miss", "fix")]
    p = put("archive.txt", "youtube a\n\nvimeo  b extra\n")
    assert [(r.extractor, r.id) for r in files.archive_of(spark.read.text(p)).collect()] == [("youtube", "a"), ("vimeo", "b")]
    p = put("cache.json", '{"a": "Show January 5, 2024", "b": "x"}')
    assert sorted(tuple(r) for r in files.title_cache(spark, p).collect()) == [("a", "Show January 5, 2024"), ("b", "x")]


def test_listing(spark, put):
    p = put(f"dir/{ID}__a b+c.mp4", "x" * 20000)
    put(f"dir/{ID}__e.webm", "")
    put("dir/n.txt", "")
    rows = {r.name: r for r in files.listing(spark, os.path.dirname(p), files.MEDIA).collect()}
    assert set(rows) == {f"{ID}__a b+c.mp4"}  # the listing leaves empty files out
    assert files.latest_nonempty(files.listing(spark, os.path.dirname(p))).first().name == f"{ID}__a b+c.mp4"
    ids = spark.createDataFrame([(ID,), ("zzzzzzzzzzz",)], "id string")
    media = {r.id: r.media for r in files.with_media(ids, files.listing(spark, os.path.dirname(p))).collect()}
    assert media[ID].endswith(".mp4") and media["zzzzzzzzzzz"] is None


def test_clip_names_and_tolerance(spark):
    names = spark.createDataFrame([(f"{ID}_t_012.30-013.46.mp4",), (f"{ID}_t_001.235-002.000.mp4",), (f"{ID}_t_5.00-6.00.mkv",), ("bad.mp4",)], "name string")
    there = files.clips_of_names(names)
    assert there.count() == 2 and files.clips_of_names(names, only_mp4=False).count() == 2  # exactly two decimals
    want = spark.createDataFrame([(ID, "12.3049", "13.455"), (ID, "1.235", "2.0"), (ID, "0.01", "9")], "id string, start string, end string")
    # padded names under 100 s are found, as numbers are compared
    got = recon.clips_tolerant(want, there, "0.00", "0.00").orderBy("start").collect()
    assert [(str(r.found_start), str(r.found_end)) for r in got] == [("None", "None"), ("1.24", "2.00"), ("12.30", "13.46")]
    padded = recon.clip_keys(want, "0.50", "0.25").where("start = '0.01'").first()
    assert (str(padded.s_adj), str(padded.e_adj)) == ("0.000", "9.250")


def test_scalars(spark):
    assert one(spark, S.video_id("u"), u="https://youtu.be/abcdefghijk?t=1") == ID  # short URLs do match
    assert one(spark, S.title_date("t").cast("string"), t="x sept 5 2024") == "2024-09-05"
    assert one(spark, S.title_date("t"), t="February 31, 2021") is None  # no error
    assert one(spark, S.title_date_strict("t"), t="January 5 2024") is None
    assert one(spark, S.name_date("t", "show") == S.name_date(F.lit("Show january 05 2024"), "show"), t="show January 5, 2024") is True
    assert one(spark, S.clock("x"), x=59.9999) == "00:01:00.000"  # never .1000
    assert one(spark, S.clock("x", ","), x=3661.5) == "01:01:01,500"
    assert one(spark, S.seconds_strict("t"), t="01:00:01,5") == 3601.5
    assert one(spark, S.seconds_loose("t"), t="01:02.5") == 62.5
    assert one(spark, S.fps("t"), t="30000/0") == 0.0
    assert one(spark, S.token("t"), t=" Don't! ") == "don't"
    assert one(spark, S.corrected("t", [("gpt", "GPT")]), t="gpt Gpt GPT") == "GPT GPT GPT"
    assert one(spark, S.hallucinated("t", F.lit(0.0), F.lit(1.0)), t="a b c x a b c") is True
    assert one(spark, S.hallucinated("t", F.lit(0.0), F.lit(0.009)), t="fine") is True
    assert one(spark, S.hallucinated("t", F.lit(0.0), F.lit(1.0)), t="m" * 21) is True
    assert one(spark, S.hallucinated("t", F.lit(0.0), F.lit(1.0)), t="one two three four five six") is False
    assert one(spark, S.extractor(F.lit(None).cast("string"), "u"), u="https://www.vimeo.com/1") == "vimeo"


def test_phrase_modes(spark):
    rows = [("f", k, w, k * 1000, None if k == 2 else k * 1000 + 900) for k, w in enumerate(["Often", " ", "the", "--", "cat", "of", "the"])]
    words = spark.createDataFrame(rows, "ytid string, idx int, word string, start_ms long, end_ms long")
    sub = search.phrase_hits(words, ["of the"], "substring").orderBy("idx").collect()
    assert [(r.idx, r.hit_end_ms) for r in sub] == [(0, 2000), (5, 6900)]  # blanks go first; a missing end is the start
    assert [r.idx for r in search.phrase_hits(words, ["the cat", "of the"], "normalised").orderBy("idx").collect()] == [5]  # '--' breaks adjacency
    assert search.windows(search.phrase_hits(words, ["often"], "substring"), 1000).first().start_ms == 0


def test_merge_is_not_islands(spark):
    s = spark.createDataFrame([("u", 1, 0, 100, 50, 60, "A", "a", "t"), ("u", 2, 10, 20, 15, 16, "B", "b", "t"), ("u", 3, 30, 40, 35, 36, "C", "c", "s")], "url string, ord int, start long, end long, hit_start long, hit_end long, label string, source_caption string, source_type string")
    assert intervals.merge_hits(s).count() == 3
    t = s.withColumns({"hit_start": F.lit(50).cast("long"), "hit_end": F.lit(60).cast("long")})
    r = intervals.merge_hits(t).first()
    assert (r.label, r.source_caption, r.source_type, r.n, r.end) == ("A, B, C", "a", "s, t", 3, 100)


def test_spaced_gap(spark):
    rows = [("k", i, t) for i, t in enumerate([0, 9, 10, 15, 19, 20, 21, 45])]
    got = intervals.spaced(spark.createDataFrame(rows, "k string, ord int, at int"), "k", "at", 10, "ord").orderBy("at").collect()
    assert [r.at for r in got] == [0, 10, 20, 45]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B", None), (3, "C", 9)], "k int, v string, n int")
    once = tables.upsert(old, new, ["k"], overwrite=["v"], fill=["n"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a", 5), (2, "B", 6), (3, "C", 9)]
    assert sorted(tuple(r) for r in tables.upsert(once, new, ["k"], overwrite=["v"], fill=["n"]).collect()) == sorted(tuple(r) for r in once.collect())
    assert tables.insert_ignore(old, new, ["k"]).count() == 3
    cues = spark.createDataFrame([("f", 0, "old", -1.0, False), ("f", 1, "keep", -1.0, False)], "file string, seg int, text string, confidence double, retried boolean")
    retries = spark.createDataFrame([("f", 0, "new", -0.2), ("f", 1, " ", -0.1)], "file string, seg int, new_text string, new_confidence double")
    assert [(r.text, r.confidence, r.retried) for r in tables.patched(cues, retries, ["file", "seg"], text="text").orderBy("seg").collect()] == [("new", -0.2, True), ("keep", -1.0, False)]


def test_histogram_and_summary(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 10]], "v double")
    assert [(r.bin, r.n) for r in reports.histogram(df, "v", 5).orderBy("bin").collect()] == [(0, 2), (1, 2), (2, 0), (3, 0), (4, 1)]
    assert [(r.bin, r.n) for r in reports.histogram(df.where("v = 3"), "v", 5).collect()] == [(0, 1)]
    assert reports.histogram(df.limit(0), "v", 5).collect() == []
    empty = spark.createDataFrame([], "ytid string, seg int, retried boolean, confidence double")
    r = reports.summary(reports.per_file(empty)).first()
    assert (r.files, r.avg_confidence, r.retried_share) == (0, 0.0, 0.0)


def test_batches(spark):
    df = spark.createDataFrame([(i, i // 7 if i % 11 else None) for i in range(250)], "i int, b int")
    got = recon.batches(df, "b", ["i"], 100).collect()
    assert sorted(r.ordinal for r in got) == list(range(1, 251))
    assert {b: sum(r.batch == b for r in got) for b in (0, 1, 2)} == {0: 100, 1: 100, 2: 50}
    assert [r.i for r in sorted(got, key=lambda r: r.ordinal)] == sorted(range(250), key=lambda i: (i % 11 == 0, i // 7 if i % 11 else 0, i))


def test_sinks(spark, tmp_path):
    flagged = spark.createDataFrame([(1, True), (2, False)], "i int, present boolean")
    sinks.split(flagged, "present", str(tmp_path / "yes"), str(tmp_path / "no"))
    assert spark.read.parquet(str(tmp_path / "yes")).collect()[0].i == 1 and spark.read.parquet(str(tmp_path / "no")).count() == 1
    span = spark.createDataFrame([("w", 1.0, 2.01, "25", "in", "m")], "target string, start_sec double, end_sec double, fps_text string, input string, model string")
    assert '"start_frame":25,"end_frame":51' in sinks.wordspan(span).first().value
    b = spark.createDataFrame([(0, 1, "a'b.mp4"), (0, 2, "c.mp4")], "batch int, ordinal int, path string")
    assert sinks.batch_lists(b).first().value == "file 'a'\\''b.mp4'\nfile 'c.mp4'"


def test_last_retry_wins(spark):
    cues = spark.createDataFrame([("f", 0, "old", -1.0, False)], "file string, seg int, text string, confidence double, retried boolean")
    retries = spark.createDataFrame([("f", 0, "second", -0.3, 2), ("f", 0, "first", -0.2, 1)], "file string, seg int, new_text string, new_confidence double, attempt int")
    assert [(r.text, r.confidence) for r in tables.patched(cues, retries, ["file", "seg"], text="text", order=["attempt"]).collect()] == [("second", -0.3)]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, at int")
    assert sorted(tuple(r) for r in tables.update(old, new, "k", "v", order=["at"]).collect()) == [(1, "y", True), (2, "b", False)]


def test_fixed_width_and_dates_as_written(spark):
    wide = lambda x: spark.createDataFrame([(x,)], "x string").select(S.fixed_width(F.col("x").cast("decimal(12,3)"))).first()[0]
    assert [wide(x) for x in ("1.5", "999.994", "1234.56", "12345.678")] == ["001.50", "999.99", "1234.56", "12345.68"]
    assert str(one(spark, S.title_date("t"), t="January 5 , 2024")) == "2024-01-05"
    assert one(spark, S.corrected("t", [("new york", "NYC")]), t="new york New York New york") == "NYC NYC New york"


def plain_hallucinated(text):
    text = text.strip(" ")
    if not text:
        return True
    if len(text) > 20 and any(len(set(text[i : i + 10])) <= 2 for i in range(len(text) - 10)):
        return True
    words = text.lower().split()
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len(words) >= 6 and len(three) != len(set(three))


def test_hallucinated_against_plain_rule(spark):
    import random

    r = random.Random(5)
    rows = ["", " ", "a" * 21, "x" * 20, "ab" * 12, "y" * 11 + "0123456789", "0123456789" + "y" * 10, "0123456789" + "y" * 10 + "z", "one two three one two three"]
    rows += ["".join(r.choice("ab" * 8 + "c") for _ in range(r.randint(15, 45))) for _ in range(300)]
    rows += [" ".join(r.choice(["no", "yes", "so", "it", "is"]) for _ in range(r.randint(3, 12))) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", S.hallucinated("t", F.lit(0.0), F.lit(1.0)).alias("h")).collect()
    assert {x.i: x.h for x in got} == {i: plain_hallucinated(t) for i, t in enumerate(rows)}


def test_hallucinated_is_linear(spark):
    import time

    rows = [(" ".join(f"word{k}" for k in range(60_000)),)]
    begin = time.time()
    assert spark.createDataFrame(rows, "t string").select(S.hallucinated("t", F.lit(0.0), F.lit(1.0))).first()[0] is False
    assert time.time() - begin < 30


def test_follow_a_growing_log(spark, tmp_path):
    """Appended lines, a line that is still being written, and rotation."""
    from cuemill.streaming import alerts

    log = tmp_path / "worker.log"
    log.write_text("one\ntwo\nhal")
    q = alerts.follow(spark, str(log)).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        with log.open("a") as f:
            f.write("f\nthree\n")
        q.processAllAvailable()
        log.rename(tmp_path / "worker.log.1")
        log.write_text("fresh\n")
        q.processAllAvailable()
        assert [r.value for r in spark.sql("select value from followed").collect()] == ["one", "two", "half", "three", "fresh"]
    finally:
        q.stop()


def test_natural_names(spark):
    df = spark.createDataFrame([(n,) for n in ["clip10.mp4", "clip2.mp4", "Clip1.mp4"]], "name string")
    got = recon.clip_order(df, "name", ["name"], 2).orderBy("ordinal").collect()
    assert [r.name for r in got] == ["Clip1.mp4", "clip2.mp4", "clip10.mp4"] and [r.batch for r in got] == [0, 0, 1]


def test_tables_are_written_compressed(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("word"), F.lit('a "b"').alias("x"))
    sinks.tsv(df, str(tmp_path / "t"), compression="gzip")
    found = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]
    assert found and all(n.endswith(".gz") for n in found)
    assert sorted(map(tuple, files.tsv(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, df.collect()))
