"""One file per key, streamed; splits of large tables; chunks of words."""

import os

import pytest
from pyspark.sql import functions as F

from cuemill.operators import tables
from cuemill.sources import files
from cuemill.sources.key_files import write_files


def test_files_commit_together(spark, tmp_path):
    df = spark.createDataFrame([(f"f{k % 37}", k, None if k == 41 else f"line {k} é") for k in range(5000)] + [(None, 1, "x")], "k string, ord long, t string").repartition(6)
    write_files(df, f"file://{tmp_path}/out", F.concat("k", F.lit(".txt")), ["ord"], F.col("t"), "HEAD\n")
    got = {f: (tmp_path / "out" / f).read_text() for f in os.listdir(tmp_path / "out")}
    assert got == {f"f{j}.txt": "HEAD\n" + "\n".join("" if k == 41 else f"line {k} é" for k in range(j, 5000, 37)) for j in range(37)}
    write_files(df.where("k = 'f1'"), f"{tmp_path}/out", F.concat("k", F.lit(".txt")), ["ord"], F.lit("new"))
    assert (tmp_path / "out" / "f1.txt").read_text().startswith("new\nnew") and len(os.listdir(tmp_path / "out")) == 37


def test_aborted_job_leaves_nothing(spark, tmp_path):
    df = spark.range(3000).select(F.concat(F.lit("f"), F.col("id") % 50).alias("k"), "id", F.when(F.col("id") == 2999, F.raise_error(F.lit("late failure"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="late failure"):
        write_files(df, str(tmp_path / "out"), F.col("k"), ["id"], F.col("t"))
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_a_table_is_read_by_many_tasks(spark, tmp_path):
    """Positions and the header do not depend on the splits."""
    body = "".join(f"w{k}\t{k / 10:.3f}\t{'x' if k % 7 == 3 else f'{k / 10 + 0.05:.3f}'}\t{k // 5}\n" for k in range(4000))
    (tmp_path / ("a" * 11 + "__x.words.tsv")).write_text("Word\tstart\tend\tseg\n" + body)
    (tmp_path / ("b" * 11 + "__x.words.tsv")).write_text("start\tword\tend\n1.0\tone\t2.0\r\n\n2.0\ttwo\t3.0")
    (tmp_path / ("c" * 11 + "__x.words.tsv")).write_text("")
    read = lambda: {f.__name__: sorted(map(tuple, f(spark, f"{tmp_path}/*.tsv").collect()), key=str) for f in (files.words_by_header, files.words_by_alias, files.words_strict)}
    whole = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert spark.read.text(f"{tmp_path}/{'a' * 11}__x.words.tsv").rdd.getNumPartitions() > 20
        assert read() == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = [k for k in range(4000) if k % 7 != 3]
    got = sorted((r[2], r[3]) for r in whole["words_by_header"] if r[0] == "a" * 11)
    assert got == [(i + 1, f"w{k}") for i, k in enumerate(kept)]
    assert sorted((r[2], r[3]) for r in whole["words_by_header"] if r[0] == "b" * 11) == [(1, "one"), (2, "two")]


@pytest.mark.parametrize("size, overlap", [(10, 3), (5, 0), (4, 3)])
def test_word_chunks(spark, size, overlap):
    lengths = [1, 2, 3, 4, 5, 9, 10, 11, 13, 14, 17, 18, 40]
    df = spark.createDataFrame([(f"k{n}", i + 1) for n in lengths for i in range(n)], "ytid string, idx long")
    got: dict = {}
    for r in tables.word_chunks(df, size=size, overlap=overlap).collect():
        got.setdefault((r.ytid, r.chunk), set()).add(r.idx)
    want: dict = {}
    for n in lengths:
        at = c = 0
        while True:
            want[f"k{n}", c] = set(range(at + 1, min(n, at + size) + 1))
            if at + size >= n:
                break
            at, c = at + size - overlap, c + 1
    assert got == want


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    from cuemill.sources import folders

    want = set()
    for f in ("a/x.vtt", "a/b/c/d/y.transcript.de.vtt", "a/b/empty.vtt", "z.txt", "k/m.vtt", "k/n/o.mp4"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("" if "empty" in f else "text")
        want.add((str(tmp_path / f), f.rsplit("/")[-1], 0 if "empty" in f else 4))
    for enough in (1, 2, 100):
        monkeypatch.setattr(folders, "ENOUGH", enough)
        reader = folders.FolderReader(f"file://{tmp_path}")
        assert sorted(r[:3] for p in reader.partitions() for r in reader.read(p)) == sorted(want)
    assert {(r.path, r.name, r.length) for r in files.folder_listing(spark, str(tmp_path)).collect()} == want
    assert {(r.lang, r.length) for r in files.captions(spark, str(tmp_path)).collect()} == {("en", 4), ("de", 4), ("en", 0)}


def test_files_in_folders_by_name(spark, tmp_path):
    """Folders of many files are put in their place whole; a name goes to the same one again."""
    from cuemill.sources import files

    out = f"file://{tmp_path}/out"
    rows = spark.range(60).selectExpr("concat(id % 30, '.txt') AS name", "id", "concat('l', id) AS line")
    for _ in range(2):
        write_files(rows, out, F.col("name"), ["id"], F.col("line"), folders=8)
    found = [p for p in (tmp_path / "out").rglob("*.txt")]
    assert len(found) == 30 and all(p.parent.parent == tmp_path / "out" for p in found) and len({p.parent for p in found}) > 1
    got = {r.file: r.value for r in files.whole_below(spark, out, "txt").collect()}
    assert got == {f"{k}.txt": f"l{k}\nl{k + 30}" for k in range(30)}
    assert files.whole_below(spark, out, "txt").rdd.getNumPartitions() <= 10
