"""The pipeline against plain Python over its own stages' rules."""

from collections import Counter

import corpus_pipeline
from cuemill.llm import decontam, quality, secrets
from tests.llm.test_native import base_spans, water, words
from tests.llm.test_text import plain_components, plain_fingerprint


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept, columns = docs, docs.columns
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf).cache()
        frames.append(kept)
    assert all(f.columns == columns for f in frames[:-1])
    rows = [[tuple(r) for r in f.select(*columns).collect()] for f in frames]

    # 1: what fails the base rule is gone, what stays is unchanged
    texts = {r[0]: r[1] for r in rows[0]}
    assert set(rows[1]) <= set(rows[0])
    assert all(len(words(r[1])) >= 10 for r in rows[1])
    verdicts = {r.doc_id: r.kept for r in quality.report(docs).collect()}
    assert {r[0] for r in rows[1]} == {i for i, k in verdicts.items() if k}
    # 2: one of each component
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows[1]]
    assert {r[0] for r in rows[2]} == {c for _, _, c in plain_components(pairs)}
    # 3: no benchmark passage
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in rows[3]:
        assert not decontam.brute_force([(r[0], r[1])], items)[r[0]][-1]
    assert {r[0] for r in rows[2]} - {r[0] for r in rows[3]} == {r[0] for r in rows[2] if decontam.brute_force([(r[0], r[1])], items)[r[0]][-1]}
    # 4: secrets are masked, nothing else changes
    assert [r[0] for r in sorted(rows[4])] == [r[0] for r in sorted(rows[3])]
    spans = {r.doc_id: r.spans for r in secrets.report(frames[3]).collect()}
    for r in rows[4]:
        assert (r[1] == texts[r[0]]) == (spans[r[0]] == "")
        assert r[columns.index("n_chars")] == len(r[1])
        assert all("SECRET" in r[1][s:e] for s, _, e, _ in base_spans(r[1]))
    # 5: the mix meets its targets
    sums, taken = Counter(), Counter()
    for r in rows[4]:
        source = r[columns.index("source")]
        sums[source] += len(words(r[1]))
    for r in frames[5].collect():
        assert 1 <= r.copies <= 3 and r.taken == r.copies * len(words(r.text))
        taken[r.source] += r.taken
    target = water(sums)
    # a handful of documents per source: no further copy of any of them fits
    shortest = {}
    copies = {(r.doc_id, r.text): r.copies for r in frames[5].collect()}
    for r in rows[4]:
        source, size = r[columns.index("source")], len(words(r[1]))
        if copies.get((r[0], r[1]), 0) < 3:
            shortest[source] = min(size, shortest.get(source, size))
    assert all(0 <= target[s] - taken[s] + 1e-6 and (s not in shortest or target[s] - taken[s] < shortest[s]) for s in target)
    # and run() does just this
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).select(*columns, "copies").collect())) == Counter(map(tuple, frames[5].select(*columns, "copies").collect()))


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing
    names, empty tables: what each stage's docstring says."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, __one string, kept boolean, key string"
    clean = "The old house by the river was painted in a pale shade of green last summer, and nobody knew why it had been done."
    long = " ".join(f"word{k} goes" for k in range(60_000))
    rows = [
        (None, None, None, None, None, None, None, None, None), (1, "", "en", "a", 0, 1, "x", True, "k"), (2, " \n ", None, "a", 3, 1, "x", True, "k"), (3, clean, None, None, 110, 1, "x", True, "k"),
        (3, clean, None, None, 110, 1, "x", True, "k"), (None, clean + " Again.", "en", "b", 117, 1, None, None, None), (4, long, "en", "b", len(long), 1, "x", True, "k"), (5, clean + " token=abcdef123456 here", "xx", "b", 130, 1, "x", True, "k"),
    ]
    docs = spark.createDataFrame(rows, schema)
    stage = dict(corpus_pipeline.STAGES)
    quality_, near, decontaminated, scanned, mixed = (stage[n] for n in stage)
    kept = quality_(spark, docs, sf).collect()
    assert Counter(r.doc_id for r in kept) == {3: 2, None: 1, 4: 1, 5: 1}
    one = near(spark, docs, sf).collect()
    ids = [r.doc_id for r in one]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 3 in ids and 4 in ids  # texts without words are one group
    same = near(spark, docs.where("doc_id is null").unionByName(docs.where("doc_id is null")), sf).collect()
    assert Counter((r.doc_id, r.text is None) for r in same) == {(None, True): 1, (None, False): 1}
    assert Counter(map(tuple, decontaminated(spark, docs, sf).collect())) == Counter(rows)
    masked = {r.doc_id: r for r in scanned(spark, docs, sf).collect()}
    assert "[SECRET]" in masked[5].text and masked[5].n_chars == len(masked[5].text) and masked[4].text == long
    assert sum(1 for r in scanned(spark, docs, sf).collect() if r.text is None and r.n_chars is None) == 1
    out = mixed(spark, docs, sf)
    assert out.columns == [*[c for c in docs.columns if c != "copies"], "copies", "taken"] and all(1 <= r.copies <= 3 for r in out.collect())
    for f in (quality_, near, decontaminated, scanned):
        assert f(spark, docs, sf).columns == docs.columns
    for f in stage.values():
        assert f(spark, docs.limit(0), sf).collect() == []
