"""Commands end to end over small folders."""

from cuemill.cli import main

ID = "abcdefghijk"


def test_hits_and_sections(spark, tmp_path):
    (tmp_path / f"{ID}__x.words.tsv").write_text("start\tend\tword\n1.0\t1.4\tof\n1.4\t1.8\tthe\n1.5\t1.9\tthat\n9.0\t9.5\tthat\n")
    main(["hits", str(tmp_path / f"{ID}__x.words.tsv"), "--query", "of the,that", "--out", str(tmp_path / "hits")], spark)
    rows = sorted(tuple(r) for r in spark.read.options(sep="\t", header=True).csv(str(tmp_path / "hits")).collect())
    url = f"https://www.youtube.com/watch?v={ID}"
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(url, "0.900", "2.200", "of the, that"), (url, "8.750", "9.750", "that")]
    (tmp_path / "clips.tsv").write_text("url\tstart\tend\nu\t5.005\t6\nu\t1\t2\nu\tx\t2\nshort\n")
    main(["sections", str(tmp_path / "clips.tsv"), "--out", str(tmp_path / "sections")], spark)
    assert spark.read.options(sep="\t", header=True).csv(str(tmp_path / "sections")).first().sections == "1.00-2.00,5.01-6.00"


def test_filter_update_stitch(spark, tmp_path):
    clips = tmp_path / "clips"
    clips.mkdir()
    for name in (f"{ID}_Show January 5, 2024_001.00-002.00.mp4", f"{ID}_Show January 4, 2024_007.00-008.00.mp4"):
        (clips / name).write_text("x")
    (tmp_path / "want.tsv").write_text(f"url\tstart\tend\nhttps://youtu.be/{ID}\t1\t2\nhttps://youtu.be/{ID}\t3\t4\n")
    for extra in ([], ["--tolerant"]):
        out = tmp_path / ("o" + str(len(extra)))
        main(["filter-clips", str(tmp_path / "want.tsv"), "--clips", str(clips), "--out", str(out), *extra], spark)
        assert [r.start_text for r in spark.read.parquet(str(out / "present")).collect()] == ["1"]
        assert [r.start_text for r in spark.read.parquet(str(out / "todo")).collect()] == ["3"]
    main(["stitch", str(clips), "--out", str(tmp_path / "lists"), "--size", "1"], spark)
    lists = {r.batch: r.value for r in spark.read.parquet(str(tmp_path / "lists")).collect()}
    assert "January%204" in lists[0] or "January 4" in lists[0]
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / f"{ID}__a.info.json").write_text(f'{{"id": "{ID}", "title": "Show January 5, 2024", "upload_date": "20240105"}}')
    main(["update", str(meta), "--out", str(tmp_path / "v1")], spark)
    (meta / f"{ID}__a.info.json").write_text(f'{{"id": "{ID}", "title": "no date", "upload_date": "20240106"}}')
    main(["update", str(meta), "--old", str(tmp_path / "v1"), "--out", str(tmp_path / "v2")], spark)
    r = spark.read.parquet(str(tmp_path / "v2")).first()
    assert (r.title, str(r.upload_date), str(r.title_date)) == ("no date", "2024-01-06", "2024-01-05")


def test_dates_quality_captions_watch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "Show january 05, 2024.mp4").write_text("x")
    (tmp_path / "dates.txt").write_text("2024-01-05\n2024-01-06\nbad\n")
    main(["dates", str(tmp_path / "dates.txt"), "--files", str(src), "--prefix", "show", "--out", str(tmp_path / "missing")], spark)
    assert [r.date for r in spark.read.options(sep="\t", header=True).csv(str(tmp_path / "missing")).collect()] == ["January 6, 2024"]
    (tmp_path / "a.words.tsv").write_text("start\tend\tword\tseg\tconfidence\tretried\n0\t1\ta\t0\t-1.6\t1\n1\t2\tb\t0\t-0.4\t0\n")
    main(["quality", str(tmp_path / "a.words.tsv"), "--out", str(tmp_path / "q")], spark)
    s = spark.read.json(str(tmp_path / "q" / "summary")).first()
    assert (s.total_words, s.retried_segments, s.very_low_conf_words, s.avg_confidence) == (2, 1, 1, -1.0)
    (tmp_path / "x.vtt").write_text("WEBVTT\n\n00:00:00.000 --> 00:00:02.000\none two\n")
    main(["captions", str(tmp_path / "x.vtt"), "--out", str(tmp_path / "w")], spark)
    assert [(r.word, r.start, r.end) for r in spark.read.parquet(str(tmp_path / "w")).orderBy("start").collect()] == [("one", 0.0, 1.0), ("two", 1.0, 2.0)]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("CUDA failed with error x\nfine\nCUDA failed with error y\n")
    main(["watch", str(logs), "--match", "CUDA failed", "--checkpoint", str(tmp_path / "c"), "--out", str(tmp_path / "alerts")], spark)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 1
