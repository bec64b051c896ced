"""Runs that skip what is done: outputs, and a ledger of success.

Every input has a name, and so has its output, a partition of a table.  The rule
of what is skipped: a name with a success record, then (if outputs are trusted) a
name whose output lies there.  A run writes outputs first and records them after;
what fails loses its record.  So a run that dies between the two repeats only the
outputs it had written, each replacing itself, if outputs are not trusted, and
leaves them if they are.  ``force`` repeats everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.keyed import KeyedTable
from ..sources.shared import staged

RECORD = "name string, done boolean, runs long, error string"


class Ledger:
    """Success records of named outputs, a keyed table; outputs are partitions
    ``name=...`` of a Parquet table."""

    def __init__(self, spark: SparkSession, path: str, out: str, trust_outputs: bool = True):
        self.spark, self.out, self.trust = spark, out, trust_outputs
        self.table = KeyedTable.at(spark, path, RECORD, ["name"], buckets=64)

    def records(self) -> DataFrame:
        return self.table.read()

    def outputs(self) -> DataFrame:
        """The names whose outputs lie there."""
        try:
            return self.spark.read.schema("name string").parquet(self.out).select("name").distinct()
        except AnalysisException:
            return self.spark.createDataFrame([], "name string")

    def pending(self, names: DataFrame, force: bool = False) -> DataFrame:
        """(name) of those that are to be run; null names are none."""
        names = names.select(F.col("name").cast("string").alias("name")).where("name is not null").distinct()
        if force:
            return names
        left = names.join(self.records().where("done").select("name"), "name", "left_anti")
        return left.join(self.outputs(), "name", "left_anti") if self.trust else left

    def _note(self, names: DataFrame) -> None:
        """Merge records (name, done, error), counting the runs."""
        before = self.records().select("name", F.col("runs").alias("__runs"))
        rows = names.join(before, "name", "left").withColumn("runs", F.coalesce("__runs", F.lit(0)) + 1).drop("__runs")
        self.table.merge(staged(rows, "records"), overwrite=["done", "runs", "error"])

    def run(self, inputs: DataFrame, process: Callable[[DataFrame], DataFrame], force: bool = False) -> int:
        """Run the pending ones of ``inputs`` (name, ...) and return how many.
        ``process`` gives the rows of the outputs (name, ...); a row with a column
        ``error`` that is not null fails its name, whose output is then not written.  If
        the whole run fails, none of its names keeps a record."""
        todo = staged(self.pending(inputs, force), "pending")
        n = todo.count()
        if not n:
            return 0
        try:
            rows = process(inputs.withColumn("name", F.col("name").cast("string")).join(todo, "name", "left_semi"))
            failed = None
            if "error" in rows.columns:
                rows = staged(rows, "outputs")
                failed = rows.where("error is not null").groupBy("name").agg(F.min("error").alias("error"))
                rows = rows.join(failed.select("name"), "name", "left_anti").drop("error")
            rows.repartition("name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(self.out)
        except Exception as e:
            self._note(todo.withColumns({"done": F.lit(False), "error": F.lit(type(e).__name__)}))
            raise
        said = todo if failed is None else todo.join(failed, "name", "left")
        error = F.lit(None).cast("string") if failed is None else F.col("error")
        self._note(said.withColumn("error", error).withColumn("done", F.col("error").isNull()))
        return n

    def stream(self, inputs: DataFrame, process: Callable[[DataFrame], DataFrame], checkpoint: str, force: bool = False) -> None:
        """Run the inputs of a stream as far as there are any: a batch that is
        repeated after a crash skips what it has recorded."""
        inputs.writeStream.foreachBatch(lambda batch, _: self.run(batch, process, force)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
