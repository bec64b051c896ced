"""Long term lists in one pass, against the plain loop."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cuemill.operators import search


def plain(words, terms, mode):
    out = []
    keep = [w for w in words if mode == "normalised" or w[1].strip()]
    norm = lambda w: "".join(c for c in w.strip().lower() if c.isascii() and (c.isalnum() or c == "'"))
    for t in terms:
        parts = search._tokens(t, mode)
        for i in range(len(keep) - len(parts) + 1 if parts else 0):
            own = keep[i : i + len(parts)]
            if all((p in w[1].lower()) if mode == "substring" else (p == norm(w[1])) for p, w in zip(parts, own)):
                end = own[-1][3] if own[-1][3] is not None else own[-1][2]
                out.append((own[0][0], t, own[0][2], end, " ".join(w[1] for w in own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("mode", ["substring", "normalised"])
@pytest.mark.parametrize("many", [3, 400])
def test_hits(spark, mode, many):
    rng = random.Random(many)
    pool = ["the", "of", "The,", "other", "then", "a", "", " ", "Of!", "it's", "…", "another", "oth", "é", "we", "west"]
    files = {f"f{k}": [(i + 1, rng.choice(pool), i * 100, None if rng.random() < 0.2 else i * 100 + 90) for i in range(rng.choice((0, 1, 2, 300)))] for k in range(8)}
    terms = ["of the", "the", "it's a", "  ", "t", "we other"][: many + 2] + [" ".join(rng.choice(pool[:6] + ["e", "th", "nowhere"]) for _ in range(rng.randint(1, 4))) for _ in range(many)]
    want = sorted(((f, *x) for f, own in files.items() for x in plain(own, terms, mode)), key=str)
    rows = spark.createDataFrame([(f, *w) for f, own in files.items() for w in own], "ytid string, idx long, word string, start_ms long, end_ms long")
    got = search.phrase_hits(rows.repartition(3), terms, mode).select("ytid", "idx", "term", "hit_start_ms", "hit_end_ms", "source_caption")
    assert sorted(map(tuple, got.collect()), key=str) == want
    nested = rows.groupBy("ytid").agg(F.array_sort(F.collect_list(F.struct("idx", "word", "start_ms", "end_ms"))).alias("l")).select("ytid", F.transform("l", lambda x: F.struct(x["word"].alias("word"), x["idx"].alias("idx"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))).alias("tokens"))
    got = search.nested_phrase_hits(nested, terms, mode).select("ytid", "idx", "term", "hit_start_ms", "hit_end_ms", "source_caption")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_thousands_of_terms_cost_little_more(spark, sf):
    from cuemill.plans.search_queries import TERMS, token_lists

    lists = token_lists(spark, sf).cache()
    rng = random.Random(1)
    more = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) + " " + rng.choice(TERMS) for _ in range(5000)]

    def clock(terms):
        began = time.time()
        n = search.nested_phrase_hits(lists, terms).count()
        return n, time.time() - began

    clock(TERMS)
    (n, few), (m, long) = clock(TERMS), clock(list(TERMS) + more)
    assert n == m and long < 5 * few + 3


def test_only_words_with_a_token_are_shuffled(spark):
    """Of other words nothing but their place reaches the window, and they still part neighbours."""
    words = spark.createDataFrame([("f", 1, "of", 0, 1), ("f", 2, "x", 1, 2), ("f", 3, "the", 2, 3), ("f", 4, "Of", 3, 4), ("f", 5, "The.", 4, 5)], "ytid string, idx long, word string, start_ms long, end_ms long")
    for mode in ("substring", "normalised"):
        found = search.phrase_hits(words, ["of the"], mode)
        assert [tuple(r) for r in found.collect()] == [("f", 4, "of the", 3, 5, "Of The.")]
        window = found._jdf.queryExecution().analyzed().toString()
        assert re.search(r"CASE WHEN .* THEN word#\d+ END AS __word", window)
