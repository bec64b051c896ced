"""Ranked search by branch and bound, against every document for every item."""

import random

import numpy as np
import pytest

from cuemill.llm import search

SCHEMA = "doc_id long, text string, item_id int, score string, base int, q int"


def frames(spark, docs, items):
    own = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in docs], SCHEMA)
    return own, spark.createDataFrame(items, "item_id long, text string, doc_id string")


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.expovariate(0.05))}"
    return [(rng.randrange(10**6), " ".join(word() for _ in range(rng.choice((3, 10, 60))))) for _ in range(n)], [(i, " ".join(word() for _ in range(8)), "c") for i in range(6)]


ODD = [(None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (4, "Alpha, BETA!"), (3, None), (2, ""), (1, "!!"), (9, "\u00dcber \u00fcber \u00dcBER"), (8, "x" * 100_000), (7, "alpha " * 50_000)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small, monkeypatch):
    docs, items = corpus(3, 900)
    docs += ODD + [(10**7 - k, docs[5][1]) for k in range(60)]  # copies, whose ties are broken by id
    items += [(100, "alpha beta", "c"), (100, "w1 alpha", "c"), (101, None, "c"), (102, "", "c"), (103, "nowhere", "c"), (None, "beta", "c"), (104, "\u00dcber", "c"), (105, docs[5][1], "c"), (106, "X" * 100_000, "c")]
    if small:  # many passes and many shards
        monkeypatch.setattr(search, "BLOCK_BYTES", 40_000)
        monkeypatch.setattr(search, "SHARD", 64)
    own, asked = frames(spark, docs, items)
    got = sorted(map(tuple, search.ranked(own.repartition(3), asked).collect()), key=str)
    assert got == sorted(search.brute_force(docs, [(i, t) for i, t, _ in items]), key=str)


def test_empty(spark):
    docs, items = frames(spark, ODD, [(1, "alpha", "c")])
    assert search.ranked(docs.limit(0), items).collect() == [] and search.ranked(docs, items.limit(0)).collect() == []


def test_bounds_save_ranges():
    """One good document among 4,096: a few ranges are opened, and a worse shard stops at its root."""
    n = search.SHARD
    ids = np.arange(n)
    terms = np.concatenate([[1, 2] if d == 777 else [d % 2] for d in range(n)]).astype(np.int32)
    many = np.array([2 if d == 777 else 1 for d in range(n)])
    shard = search.Shard(ids, terms, many, np.full(len(terms), 5, np.int64))
    best: list = []
    assert shard.search(np.array([1, 2]), np.array([1, 1]), best, 1) == 3 and best == [(10, -777)]
    assert shard.search(np.array([0]), np.array([1]), best, 1) == 0
    tie: list = [(5, -5000)]
    assert shard.search(np.array([0]), np.array([1]), tie, 1) > 0 and tie == [(5, 0)]  # equal bounds are opened


def test_oracle(spark, sf):
    from cuemill.llm import queries
    from tests.compare import differs, duck

    assert differs(queries.queries()["op12_ranked_search"](spark, sf), duck(sf), queries.oracle_sql()["op12_ranked_search"]) is None
