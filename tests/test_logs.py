"""Many growing logs, followed by byte ranges."""

from cuemill.streaming import alerts, logs


def run(spark, path, out, checkpoint, **options):
    alerts.drain(alerts.follow(spark, str(path), **options), str(out), str(checkpoint))
    rows = spark.read.schema("file string, place long, value string").parquet(str(out)).collect()
    return sorted((r.file.rsplit("/", 1)[1], r.place, r.value) for r in rows)


def lines(name, text):
    out, at = [], 0
    for x in text.encode().splitlines(True):
        if x.endswith(b"\n"):
            out.append((name, at, x.decode().rstrip("\r\n")))
        at += len(x)
    return out


def test_ranges_growth_rotation_and_truncation(spark, tmp_path):
    d, out, check = tmp_path / "logs", tmp_path / "out", tmp_path / "check"
    d.mkdir()
    a = "".join(f"line {k} é{'x' * (k % 9)}\n" for k in range(500))
    (d / "a.log").write_text(a)
    (d / "b.log").write_text("\n\r\nfirst line\nlast without end")
    (d / "empty.log").write_text("")
    want = lines("a.log", a) + lines("b.log", "\n\r\nfirst line\n")
    assert run(spark, d / "*.log", out, check, chunk="97") == sorted(want)
    assert run(spark, d / "*.log", out, check, chunk="97") == sorted(want)  # nothing new
    with (d / "a.log").open("a") as f:
        f.write("tail of the old file\n")
    (d / "a.log").rename(d / "a.log.1")  # rotated before the tail was read
    (d / "a.log").write_text("fresh\n")
    (d / "b.log").write_text("short\n")  # became shorter
    (d / "c.log").write_text("new log\n")
    want += [("a.log", len(a.encode()), "tail of the old file"), ("a.log", 0, "fresh"), ("b.log", 0, "short"), ("c.log", 0, "new log")]
    assert run(spark, d / "*.log", out, check) == sorted(want)


def test_a_folder_with_its_rotated_files(tmp_path):
    """A log that was moved inside the followed folder is not read twice."""
    (tmp_path / "x").write_text("1\n2\n")
    reader = logs.GrowingLogsReader({"path": str(tmp_path)})
    start = reader.initialOffset()
    one = reader.latestOffset()
    (tmp_path / "x").rename(tmp_path / "x.1")
    (tmp_path / "x").write_text("3\n")
    two = reader.latestOffset()
    read = lambda s, e: [r[2] for p in reader.partitions(s, e) for r in reader.read(p)]
    assert read(start, one) == ["1", "2"] and read(one, two) == ["3"]
    again = logs.GrowingLogsReader({"path": str(tmp_path)}).latestOffset()  # after a restart, which has forgotten the names
    assert read(one, again) == ["3"] and set(again) == {str(tmp_path / "x"), str(tmp_path / "x.1")}


def test_batches_are_bounded_and_ranges_hold_whole_lines(tmp_path):
    (tmp_path / "x").write_text("".join(f"{k:09d}\n" for k in range(100)) + "y" * 500 + "\n" + "z\n")
    reader = logs.GrowingLogsReader({"path": str(tmp_path / "x"), "most": "105", "chunk": "33"})
    at, got, sizes = reader.initialOffset(), [], []
    for _ in range(30):
        to = reader.latestOffset()
        rows = [r[2] for p in reader.partitions(at, to) for r in reader.read(p)]
        got, at = got + rows, to
        sizes.append(sum(map(len, rows)))
    assert got == [f"{k:09d}" for k in range(100)] + ["y" * 500, "z"] and sorted(sizes)[-2] <= 105 and sizes[-1] == 0


def test_from_end(tmp_path):
    (tmp_path / "x").write_text("old\nhalf")
    reader = logs.GrowingLogsReader({"path": str(tmp_path / "x"), "from_end": "true"})
    start = reader.initialOffset()
    with (tmp_path / "x").open("a") as f:
        f.write(" line\nnext\n")
    to = reader.latestOffset()
    assert [r[2] for p in reader.partitions(start, to) for r in reader.read(p)] == ["half line", "next"]


def test_debounce_in_order_forgets_idle_keys(spark, tmp_path):
    """Rows in any order inside the delay; late ones are left out; idle keys have no state."""
    from datetime import datetime, timezone

    def bring(*rows):
        own = [(k, o, a, datetime.fromtimestamp(a, timezone.utc)) for k, o, a in rows]
        spark.createDataFrame(own, "k long, ord long, at long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k long, ord long, at long, ts timestamp").parquet(f"{tmp_path}/in")
        alerts.drain(alerts.debounced_in_order(stream, 10, "100 seconds"), f"{tmp_path}/out", f"{tmp_path}/check")
        return sorted(map(tuple, spark.read.schema(alerts.KEPT).parquet(f"{tmp_path}/out").collect()))

    assert bring((1, 1, 1050), (1, 2, 1000), (2, 1, 1003)) == []
    assert bring((1, 3, 1004), (1, 4, 1041), (2, 2, 1012), (2, 3, 1013)) == []  # before what came first
    assert bring((3, 1, 2000)) == [(1, 2, 1000), (1, 4, 1041), (2, 1, 1003), (2, 3, 1013)]
    assert bring((1, 9, 1500), (3, 2, 2500)) == [(1, 2, 1000), (1, 4, 1041), (2, 1, 1003), (2, 3, 1013), (3, 1, 2000)]  # 1500 is late
