"""Operators with Python parts, against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuemill.llm import classifier, decontam, langid, licenses, simhash, suffix, wrappers

SCHEMA = "doc_id long, text string, lang string, source string, found string, id string, fp string, __benchmark int, __id int"
rng = random.Random(5)
LONG = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400))
PASSAGE = " ".join("".join(rng.choice("qrstuvwxyzé") for _ in range(6)) for _ in range(60))


def row(i, t, lang="en"):
    return (i, t, lang, "s", "x", "y", "z", 1, 2)


ODD = [
    row(-1, None, None), row(-2, ""), row(-3, " \n\t "), row(-4, LONG), row(-4, LONG), row(-5, LONG.replace("a", "b", 1)), row(-6, LONG[:900] + " changed here " + LONG[900:]),
    row(-7, PASSAGE), row(-8, "before " + PASSAGE + " after"), row(-9, "other " + PASSAGE * 2), row(-10, "x" * 5000), row(-11, "ab" * 700), row(None, "nameless words here"), row(-12, "one"), row(-13, "One"), row(-14, "two words"),
    row(-15, "Ünïcödé " * 80), row(-16, "12345 67890 !!"), row(-17, LONG.upper()),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.createDataFrame(ODD, SCHEMA).unionByName(spark.read.parquet(f"{sf}/documents.parquet").drop("n_chars"), allowMissingColumns=True).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


def test_decontamination(spark, sf, docs, texts):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(900, "words here"), (901, "WORDS HERE"), (902, None), (903, "!!"), (None, "nameless"), (None, LONG[200:500]), (904, LONG[:300]), (904, LONG[:300]), (905, "ünïcödé " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    odd = lambda i: i is None or i < 0
    some = [x for x in texts if odd(x[0])] + [x for x in texts if not odd(x[0])][:60]
    want = Counter((i, *decontam.brute_force([(i, t)], items)[i]) for i, t in some)
    own = spark.createDataFrame(some, "doc_id long, text string")
    assert Counter(map(tuple, decontam.report(own, bench).collect())) == want
    old, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, 500  # many passes give the same
    try:
        assert Counter(map(tuple, decontam.report(own, bench).collect())) == want
    finally:
        decontam.BLOCK_BYTES = old
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.where("doc_id < 0 or doc_id is null").collect()) == Counter(i for (i, *_, bad), n in want.items() for _ in range(n) if not bad and odd(i))
    assert decontam.report(own.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontam.report(own, bench.limit(0)).collect())


def plain_fingerprint(t, width=3):
    t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[j : j + width]) for j in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs, distance=3):
    fp = [f for _, f in pairs]
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        groups[find(k)].append(i)
    out = Counter()
    for k, (i, f) in enumerate(pairs):
        ids = [x for x in groups[find(k)] if x is not None]
        out[(i, f"{f:016x}", min(ids) if ids else None)] += 1
    return out


def test_simhash(docs, texts):
    got = Counter(map(tuple, simhash.report(docs).collect()))
    assert got == plain_components([(i, plain_fingerprint(t)) for i, t in texts])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # one row per group: of the smallest id, or the one row of a group without ids
    lone = {f for (_, f, c) in got if c is None}
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter({c for (_, _, c) in got if c is not None}) + Counter({None: len(lone)})
    assert Counter(map(tuple, simhash.keep_one(docs.orderBy(F.rand(5))).collect())) == Counter(map(tuple, kept.collect()))
    assert simhash.report(docs.limit(0)).collect() == []


def test_simhash_long_lists(spark):
    """A dense cloud of fingerprints in one posting list: finer lists and blocks
    give the links that comparing all pairs gives."""
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = {(i, c) for i, _, c in plain_components([(signed(f), f) for f in fps])}
    for most in (10_000, 20):
        roots = {r.v: r.root for r in simhash.components(simhash.fingerprint_links(df, 3, most)).collect()}
        assert {(signed(f), roots.get(signed(f), signed(f))) for f in fps} == want


def test_star_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200 + i, 200) for i in range(1, 30)] + [(400, 300)]
    got = {r.v: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 200 for i in range(1, 30)}, 400: 300}


def first_copies(data, length=200):
    """Later copies only, in order of id and place."""
    seen, out = set(), []
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        out.append((i, len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def plain_repeats(data, length=200):
    numbered = suffix.brute_force(list(enumerate(t for _, t in data)), length)
    return Counter((i, *numbered[k]) for k, (i, _) in enumerate(data))


@pytest.mark.parametrize("options", [{}, {"bucket": 3}])
def test_repeats(docs, texts, options):
    got = suffix.without_repeats(docs, with_text=False, **options)
    assert Counter(map(tuple, got.collect())) == plain_repeats(texts)


def test_repeats_keep_first(docs, texts):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    some = [(r[0], r[1]) for r in unique.select("doc_id", "text").collect()]
    for options in ({}, {"bucket": 3}):
        got = suffix.without_repeats(unique, keep_first=True, **options).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == first_copies(some)
        assert all(r.kept_text == r.kept_text for r in got)


def test_repeats_in_pieces(docs, texts, monkeypatch):
    """Texts above the slice size are read in overlapping pieces."""
    monkeypatch.setattr(suffix, "SLICE_BYTES", 400)
    b = (LONG + PASSAGE + LONG[300:1200]).encode()
    data = np.frombuffer(b, np.uint8)
    whole = set(suffix.anchors(data, np.array([0, len(data)]), 200, 64)[1].tolist())
    parts = []
    for s, e, first, last in suffix.pieces(len(data), 400, 200):
        pos = suffix.anchors(data[s:e], np.array([0, e - s]), 200, 64)[1] + s
        parts += pos[(pos >= first) & (pos < last)].tolist()
    assert sorted(parts) == sorted(whole)


def test_repeats_empty(docs):
    assert suffix.report(docs.limit(0)).collect() == []


def test_language(spark, sf):
    big = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "xx" if i == -4 else lang) for i, t, lang in [(-1, None, "en"), (-2, "", None), (-3, "12 !!", "fr"), (-4, "zzyzx qqq", None), (-5, "\U00010330\U00010331", None)]], "doc_id long, text string, lang string")
    rows = langid.report(big.select("doc_id", "text", "lang").unionByName(odd)).collect()
    truth = {r[0]: r[1] for r in big.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (-1, -2, -3))
    assert by[-5].lang_pred != "und"  # letters beyond the basic plane
    assert all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.report(spark.createDataFrame([], schema)).collect() == []
    assert {r.lang_pred for r in langid.report(spark.createDataFrame([(1, "abc", None)], schema)).collect()} == {"und"}
    one = langid.report(spark.createDataFrame([(k, "some words", "en") for k in range(8)], schema)).collect()
    assert {r.lang_pred for r in one} == {"en"}


def units(text):
    """A text as UTF-16 units: words of letters, each followed by one space."""
    out = []
    for ch in (text or "").lower():
        if ch.isalpha():
            raw = ch.encode("utf-16-le")
            out += [int.from_bytes(raw[k : k + 2], "little") for k in range(0, len(raw), 2)]
        elif out and out[-1] != 32:
            out.append(32)
    return out + [32] if out and out[-1] != 32 else out


class PlainKneserNey:
    """Interpolated Kneser-Ney of one language in dictionaries."""

    def __init__(self, texts, alphabet, n=4):
        self.n, self.alphabet = n, alphabet
        full = Counter(tuple(x[k : k + n]) for x in ([32] * (n - 1) + units(t) for t in texts) for k in range(len(x) - n + 1))
        self.levels = {n: full}
        for k in range(n - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.d, self.total, self.kinds = {}, {}, {}
        for k, level in self.levels.items():
            once, twice = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
            self.d[k] = once / (once + 2 * twice) if once and twice else 0.5
            self.total[k], self.kinds[k] = Counter(), Counter()
            for g, v in level.items():
                self.total[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        total = self.total[k][gram[:-1]]
        below = self.p(gram[1:]) if k > 1 else 1 / self.alphabet
        if not total:
            return below
        return max(self.levels[k][gram] - self.d[k], 0) / total + self.d[k] * self.kinds[k][gram[:-1]] / total * below

    def bits(self, text):
        x = [32] * (self.n - 1) + units(text)
        return -sum(np.log2(self.p(tuple(x[k : k + self.n]))) for k in range(len(x) - self.n + 1))


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_language_models_against_plain_kneser_ney(spark, block):
    """Discounts, continuation counts and back-off by dictionaries; many blocks
    (passes) give what one gives."""
    r = random.Random(11)
    make = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randint(1, 7))) for _ in range(r.randint(3, 40)))
    rows = [(k, make("aeiontrs"), "one") for k in range(40)] + [(100 + k, make("éèaou\U00010330\U00010331kz"), "two") for k in range(40)] + [(300, "Ab!? cd,", "one"), (301, "", "one"), (302, None, "two"), (303, "x" * 3000, "two"), (304, "lost", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(docs, fit=F.col("doc_id") % 3 != 0, key=F.col("doc_id"), block=block)
    assert (len(models.bounds) == 1) == (block > 40)
    taught = {x: [t for _, t, lang in rows if lang == x and t] for x in ("one", "two")}
    alphabet = len({u for ts in taught.values() for t in ts for u in units(t)}) + 1
    plain = [PlainKneserNey(taught[x], alphabet) for x in models.names]
    got = {q.doc_id: q for q in models.summed(docs.select("doc_id", "text")).collect()}
    for i, t, _ in rows:
        assert got[i]["__n"] == len(units(t))
        for k, m in enumerate(plain):
            assert abs(got[i]["__bits"][k] - m.bits(t)) <= 1e-4 * m.bits(t) + 1e-6
    seen = langid.identify(docs.withColumnRenamed("lang", "bits"), models).collect()
    for q in seen:
        t = dict((i, t) for i, t, _ in rows)[q.doc_id]
        costs = [m.bits(t) for m in plain]
        assert q.lang_pred == (models.names[int(np.argmin(costs))] if units(t) else "und")


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><a href='/'>Site</a></header><nav><ul><li>Home</li><li>About</li></ul></nav><div class='cookie-notice'>We use cookies</div>{body}<footer>&copy; all rights</footer></body></html>"


def test_extract_rules():
    body = "<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four<p>five <b>six</b></p><div class='share-buttons'>tweet</div><aside>side</aside><section id='comments'><p>nice!</p></section><p>x &lt; y<form><input value=q><p>mail</p></form></article>"
    assert wrappers.extract(PAGE.format(body=body)) == "A & B\none two three four\nfive six\nx < y"
    assert wrappers.extract(None) == wrappers.extract("") == wrappers.extract("<p>  </p>") == ""
    assert wrappers.extract("<body><div>plain text</div><nav>menu</nav>") == "plain text"
    assert wrappers.extract("a < b and c") == "a < b and c"
    assert wrappers.extract(PAGE.format(body="<div class='x'><p>no main element</p></div>")) == "no main element"


def test_wrapper_inference():
    pages = [PAGE.replace("footer", "div").format(body=f"<div><h2>Fixed head</h2><ul>{'<li>item</li>' * n}</ul><p>text {n}</p>{'<table><tr><td>opt</td></tr></table>' if n == 3 else ''}</div>") for n in (2, 3, 5)]
    streams = [wrappers.blocks(x)[1] for x in pages]
    wrapper = wrappers.infer(streams)
    said = wrappers.expression(wrapper)
    assert ")+" in said and ")?" in said and "#text" in said
    constant = wrappers.fixed(wrapper)
    assert wrappers.extract(pages[0], constant).split("\n")[-1] == "text 2"
    assert "Fixed head" not in wrappers.extract(pages[0], constant)


def test_main_text_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "http://h/x", ""), (-3, "not a url", "<p>hi</p>"), (-3, "not a url", "<p>hi</p>")], "page_id long, url string, html string")
    got = wrappers.report(pages.unionByName(odd)).collect()
    assert len(got) == pages.count() + 4
    assert all(r.n_chars == len(r.text) for r in got)
    assert {(r.page_id, r.text) for r in got if r.page_id < 0} == {(-1, ""), (-2, ""), (-3, "hi")}
    html = {r[0]: r[1] for r in pages.select("page_id", "html").collect()}
    import html as entities

    for r in got:
        if r.page_id >= 0:
            article = re.search(r"<article>(.*?)(</article>|<footer|$)", html[r.page_id], re.S)[1]
            parts = [" ".join(entities.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
            assert r.text == "\n".join(x for x in parts if x)
    assert wrappers.report(pages.limit(0)).collect() == []


def test_licenses(spark, docs):
    mit = licenses.TEXTS["MIT"].replace("<year> <holders>", "2021 Somebody").replace('"AS IS"', "“as is”").replace("license", "licence").upper()
    own = spark.createDataFrame([(1, mit), (2, "Text.\nReleased under the MIT license!\nLicensed under CC BY-NC 4.0"), (3, None), (4, ""), (5, "Copyright (c) 2020 X\nAll rights reserved."), (6, mit + " but changed")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.report(own).collect()}
    assert got[1].license == "MIT" and got[6].license is None
    assert got[2].n_notices == 2 and got[2].notices == "CC-BY-NC-4.0,MIT" and got[2].license is None
    assert got[3].digest is got[4].digest is got[5].digest is None
    assert licenses.report(docs).count() == docs.count()
    assert licenses.report(docs.limit(0)).collect() == []
    custom = licenses.scan(own, texts={"own": "text. released under the MIT LICENCE\nlicensed under cc by nc 4.0"}, notices={"n": ["text"]})
    assert {r.doc_id: (r.license, r.notices) for r in custom.collect()}[2] == ("own", "n")


def test_label_model():
    """Votes drawn from known accuracies: the model finds classes and accuracies."""
    r = random.Random(3)
    names = list(classifier.LABELLERS)
    rows, truth = [], []
    for _ in range(6000):
        good = r.random() < 0.85
        p, place = 0, 1
        for _ in names:
            v = classifier.NONE if r.random() < 0.2 else int(r.random() < (0.98 if good else 0.5))
            p, place = p + place * v, place * 3
        rows.append(p)
        truth.append(good)
    model = classifier.LabelModel(Counter(rows))
    right = sum((model.posterior[p] > 0.5) == t for p, t in zip(rows, truth))
    assert right >= 0.97 * len(rows)
    assert abs(model.prior - 0.85) < 0.05


def test_classifier(spark, sf, docs):
    big = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    rows = classifier.report(big).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.3 * len(bad)
    got = classifier.report(docs)
    assert got.count() == docs.count()
    assert classifier.report(docs.limit(0)).collect() == []


def test_classifier_against_plain_model(spark, sf):
    """Expectation-maximisation and the scorer, in plain Python, over a whole small table."""
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "same words"), (-3, "same words"), (-4, "# $ % | " * 60)], "doc_id long, text string"))
    data = [(r[0], r[1]) for r in own.collect()]
    names = list(classifier.LABELLERS)
    votes = {}
    for i, t in data:
        f = classifier.facts((t or "").encode())
        votes[(i, t)] = tuple(classifier.LABELLERS[n](f) for n in names)
    counts = Counter(votes[x] for x in data)
    total = sum(counts.values())
    good = {v: 1 / (1 + np.exp(-(1.0 + v.count(classifier.GOOD) - 4.0 * v.count(classifier.BAD)))) for v in counts}
    prior = 0.5
    for _ in range(200):
        chance = {}
        for c in (classifier.GOOD, classifier.BAD):
            for k in range(len(names)):
                for vote in (classifier.BAD, classifier.GOOD):
                    mass = sum(n * (good[v] if c == classifier.GOOD else 1 - good[v]) for v, n in counts.items() if v[k] == vote)
                    chance[c, k, vote] = mass + classifier.BELIEF * total * classifier.EXPECTED[c][vote] + 1e-3
                both = chance[c, k, classifier.BAD] + chance[c, k, classifier.GOOD]
                for vote in (classifier.BAD, classifier.GOOD):
                    chance[c, k, vote] /= both
        prior = (sum(n * good[v] for v, n in counts.items()) + 1) / (total + 2)
        new = {}
        for v in counts:
            odds = np.log(prior / (1 - prior)) + sum(np.log(chance[classifier.GOOD, k, x] / chance[classifier.BAD, k, x]) for k, x in enumerate(v) if x != classifier.NONE)
            new[v] = 1 / (1 + np.exp(-max(min(odds, 40), -40)))
        done, good = max(abs(new[v] - good[v]) for v in counts) < 1e-9, new
        if done:
            break
    taught = [x for x in data if x[1] is not None]
    rows = []
    for x in data:
        words, shapes, shares = classifier.features((x[1] or "").encode())
        f = Counter()
        for w in words:
            f[w] += 1 / max(1, len(words)) ** 0.5
        for k, share in zip(shapes, shares):
            f[k] += share
        rows.append(f)
    index = {k: n for n, k in enumerate(sorted({k for x, f in zip(data, rows) if x[1] is not None for k in f}))}
    m = np.zeros((len(taught), len(index) + 1))
    m[:, -1] = 1
    for n, f in enumerate(f for x, f in zip(data, rows) if x[1] is not None):
        for k, v in f.items():
            m[n, index[k]] = v
    y = np.array([good[votes[x]] for x in taught])
    weight = y * (len(y) / 2 / max(y.sum(), 1)) + (1 - y) * (len(y) / 2 / max((1 - y).sum(), 1))
    theta, first, second = np.zeros(len(index) + 1), 0.0, 0.0
    for t in range(1, 151):
        g = m.T @ (weight * (1 / (1 + np.exp(-np.clip(m @ theta, -30, 30))) - y)) / len(y) + 1e-4 * theta
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    want = {x: 1 / (1 + np.exp(-(sum(theta[index[k]] * v for k, v in f.items() if k in index) + theta[-1]))) for x, f in zip(data, rows)}
    got = classifier.classified(own).join(own.groupBy("doc_id").agg(F.first("text").alias("t")), "doc_id").collect()
    assert len(got) == len(data)
    for r in got:
        assert abs(r.weak_label - good[votes[(r.doc_id, r.t)]]) < 1e-6
        assert abs(r.score - want[(r.doc_id, r.t)]) < 1e-3


def test_all_operators_are_registered():
    """The entry module leaves the corpus queries out if they cannot be imported: here they can."""
    import __spark_entry__ as entry

    assert sum(q.startswith("op") for q in entry.queries()) == 10 and "pipeline" in entry.queries()
