"""Tables of text in compressed parts: written by ranges, read as one table."""

import gzip

from pyspark.sql import functions as F

from cuemill.plans import source_queries
from cuemill.sources import files


def rows(spark, n):
    return spark.range(n).select((F.col("id") % 3 == 0).alias("k"), "id", F.concat(F.lit("w"), "id").alias("word"))


def written(spark, n, part):
    line = F.concat_ws("\t", "id", "id", "word").alias("line")
    return source_queries._table_written(spark, rows(spark, n), "k", ["id"], lambda r: r.select("name", line), "start\tend\tword\n", part)


def test_no_part_holds_a_whole_table(spark):
    folder = written(spark, 3000, 100)
    found = {r[0]: r[1] for r in spark.read.text(folder).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1)).agg(F.count("*")).collect()}
    assert len(found) >= 30 and max(found.values()) <= 150 and sum(found.values()) == 3000 + len(found)
    first = folder.removeprefix("file:") + "/true.part-000000.tsv.gz"
    assert gzip.open(first, "rt").read().split("\n")[:2] == ["start\tend\tword", "0\t0\tw0"]


def test_parts_are_one_table(spark):
    """Lines are counted on over the parts, whose headers are no lines."""
    got = files.words_by_header(spark, written(spark, 3000, 100))
    assert {r[0] for r in got.select("file").distinct().collect()} == {"true.tsv", "false.tsv"}
    wrong = got.withColumn("id", F.substring("word", 2, 9).cast("long")).withColumn("own", F.when(F.col("file") == "true.tsv", F.expr("id div 3 + 1")).otherwise(F.expr("id - id div 3")))
    assert got.count() == 3000 and wrong.where("idx <> own").count() == 0
    strict = files.words_strict(spark, written(spark, 300, 50))
    assert strict.select("file", "idx").distinct().count() == strict.count() == 300 and strict.agg(F.max("idx")).first()[0] == 200


def test_split_files_count_without_a_broadcast(spark, tmp_path, monkeypatch):
    """What is known of very many splits is joined by a shuffle, with the same numbers."""
    monkeypatch.setattr(files, "FEW", 0)
    got = files.words_by_header(spark, written(spark, 900, 50))
    own = F.substring("word", 2, 9).cast("long")
    assert got.where(F.col("idx") != F.when(F.col("file") == "true.tsv", F.floor(own / 3) + 1).otherwise(own - F.floor(own / 3))).count() == 0
