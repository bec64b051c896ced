"""Folds over keys that have no gap, against the plain loop."""

import random

import pytest

from cuemill.operators import intervals


def plain_spaced(rows, gap):
    out, last = [], {}
    for k, at, o in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in last or at - last[k] >= gap:
            out.append((k, at, o))
            last[k] = at
    return sorted(out, key=str)


@pytest.mark.parametrize("fan, gap, kind", [(2, 5, int), (4, 7, int), (256, 5, int), (3, 2.5, float)])
def test_spaced(spark, monkeypatch, fan, gap, kind):
    rng = random.Random(fan)
    monkeypatch.setattr(intervals, "FAN", fan)
    rows = [("dense", kind(t), t % 7) for t in range(-300, 1500)] + [("dense", kind(t), 9) for t in range(0, 900, 3)]  # a row a second, some twice, no gap
    rows += [(f"k{rng.randrange(6)}", kind(rng.randrange(3000)) + kind(rng.choice((0, 0.25))), rng.randrange(10**6)) for _ in range(1500)]
    rows += [("sparse", kind(t), 1) for t in (-(10**7), -5, 0, 10**7)] + [(None, kind(t), t) for t in range(40)] + [("one", kind(3), 2), ("none", None, 1)]
    df = spark.createDataFrame(rows, f"k string, at {'long' if kind is int else 'double'}, ord long").repartition(5)
    got = sorted(map(tuple, intervals.spaced(df, "k", "at", gap, "ord").collect()), key=str)
    assert got == plain_spaced(rows, gap)
    assert intervals.spaced(df.limit(0), "k", "at", gap, "ord").collect() == []


def plain_merge(rows):
    out, now, key = [], None, None
    for r in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        k, _, s, e, hs, he, lab, cap, kind = r
        if now and key == k and now[1] >= s and now[3] >= hs and he >= now[2]:
            now[1], now[2], now[3], now[7] = max(now[1], e), min(now[2], hs), max(now[3], he), now[7] + 1
            now[4] += [lab] * (lab not in now[4])
            now[6].add(kind)
        else:
            key, now = k, [s, e, hs, he, [lab], cap or "", {kind}, 1]
            out.append((k, now))
    return sorted((k, s, e, hs, he, ", ".join(lab), cap, ", ".join(sorted(x for x in kinds if x)), n) for k, (s, e, hs, he, lab, cap, kinds, n) in out)


@pytest.mark.parametrize("shape", ["chain", "giant", "mixed"])
def test_merge(spark, shape):
    """One key that is one group over all ranges, one whose groups chain without a gap, and many keys."""
    rng = random.Random(shape)
    rows = []
    for i in range(4000):
        key = "hot" if shape != "mixed" or i % 3 else f"k{i % 11}"
        s = rng.randrange(20_000)
        hs, he = (s, 10**6) if shape == "giant" else (s + 5, s + 5 + rng.randrange(12))
        rows.append((key, i, s, max(he + 5, s + 400), hs, he, f"w{rng.randrange(4)}", rng.choice((None, "c")), rng.choice(("yt", "", "whisper"))))
    df = spark.createDataFrame(rows, "url string, ord long, start long, end long, hit_start long, hit_end long, label string, source_caption string, source_type string").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as there are partitions
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = sorted(tuple(r[c] for c in ("url", "start", "end", "hit_start", "hit_end", "label", "source_caption", "source_type", "n")) for r in intervals.merge_hits(df).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain_merge(rows)
    assert intervals.merge_hits(df.limit(0)).collect() == []
