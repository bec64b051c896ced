"""Skip by record, then by output, with force; crashes between output and record."""

import pytest
from pyspark.sql import functions as F

from cuemill.streaming.ledger import Ledger


def counted(df):
    return df.groupBy("name").agg(F.count("*").alias("n"))


def state(ledger):
    return {r.name: (r.done, r.runs) for r in ledger.records().collect()}


def test_skip_force_and_failures(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/records", f"{tmp_path}/out")
    inputs = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "name string")
    odd = lambda df: counted(df).withColumn("error", F.when(F.col("name") == "b", "bad"))
    assert ledger.run(inputs, odd) == 3
    assert state(ledger) == {"a": (True, 1), "b": (False, 1), "c": (True, 1)} and sorted(r.name for r in ledger.outputs().collect()) == ["a", "c"]
    assert ledger.run(inputs, counted) == 1 and state(ledger)["b"] == (True, 2)
    assert ledger.run(inputs, counted) == 0
    assert ledger.run(inputs, counted, force=True) == 3 and state(ledger) == {"a": (True, 2), "b": (True, 3), "c": (True, 2)}

    def dies(df):
        raise ValueError("boom")

    with pytest.raises(ValueError):
        ledger.run(inputs, dies, force=True)
    assert not any(done for done, _ in state(ledger).values())  # the marks are taken away
    assert {r.name: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a": 2, "b": 1, "c": 1}


@pytest.mark.parametrize("trust", [True, False])
def test_crash_between_output_and_record(spark, tmp_path, monkeypatch, trust):
    ledger = Ledger(spark, f"{tmp_path}/records", f"{tmp_path}/out", trust_outputs=trust)
    ledger.run(spark.createDataFrame([("old",)], "name string"), counted)
    note = Ledger._note
    monkeypatch.setattr(Ledger, "_note", lambda self, names: (_ for _ in ()).throw(KeyboardInterrupt()))
    both = spark.createDataFrame([("old",), ("new",)], "name string")
    with pytest.raises(KeyboardInterrupt):
        ledger.run(both, counted)
    monkeypatch.setattr(Ledger, "_note", note)
    again = Ledger(spark, f"{tmp_path}/records", f"{tmp_path}/out", trust_outputs=trust)
    assert again.run(both, counted) == (0 if trust else 1)
    assert state(again) == ({"old": (True, 1)} if trust else {"old": (True, 1), "new": (True, 1)})
    assert sorted((r.name, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("new", 1), ("old", 1)]


def test_as_a_stream(spark, tmp_path):
    for k, names in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ledger = Ledger(spark, f"{tmp_path}/records", f"{tmp_path}/out")
        ledger.stream(spark.readStream.schema("name string").parquet(f"{tmp_path}/in"), counted, f"{tmp_path}/check")
        assert set(state(ledger)) == set("ab" if k == 0 else "abc")
    assert state(ledger)["b"] == (True, 1)
