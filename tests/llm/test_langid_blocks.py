"""Blocks of the language models: the same results, and texts are never written."""

import random

from cuemill.llm import langid


def test_many_blocks_are_one(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    rows = [(k, " ".join(word(("aeinrst", "éèabcdo", "жзик")[k % 3]) for _ in range(30)), ("one", "two", "three")[k % 3]) for k in range(240)]
    rows += [(900, None, "one"), (901, "", "two"), (902, "123", None), (903, "nist" * 3000, None), (904, "nist", None), (904, "nist", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    written = []
    staged = langid.staged
    monkeypatch.setattr(langid, "staged", lambda df, name: (written.append((name, df.columns)), staged(df, name))[1])
    results = []
    for block in (10**9, 400):
        models = langid.train(docs, block=block)
        results.append({(r.doc_id, r.lang_pred, round(r.score, 5), round(r.bits, 4), r.rejected) for r in langid.identify(docs, models).collect()})
    assert len(models.bounds) > 10 and max(b - a for a, b in models.bounds) >= 0
    spaces = [(lo, hi) for lo, hi in models.bounds if lo >> 16 == hi >> 16 == 32]
    assert spaces  # what stands behind a space is parted too
    assert results[0] == results[1]
    assert not any("text" in columns for name, columns in written if name != "sample")
