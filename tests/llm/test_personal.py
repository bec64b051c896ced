"""Personal data: the four kinds against their patterns as written, added spans on held-out sentences."""

import functools
import hashlib
import random
import re
import time

import pytest

from cuemill.llm import personal

SCHEMA = "doc_id long, text string, personal int, d string, t string, spans string"
#: The four kinds as stated, for brute force.
WRITTEN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(re.sub("[^0-9]", "", t)) <= 19 and plain_luhn(re.sub("[^0-9]", "", t))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
}


def plain_luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


@functools.cache
def plain(text):
    out = []
    for kind, (pattern, holds) in WRITTEN.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if holds(m[0])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "d", "t", "s") for i, t in rows], SCHEMA)


def noise(rng):
    return "".join(rng.choice("ab1 2.@-+()%0é😀\n9") for _ in range(rng.randint(0, 60)))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    texts = [noise(rng) for _ in range(30_000)] + ["a@b.c@d.e", "@b.c@d.e", "x@@y.z.@a.b", "1.2.3.4.5.6.7.8", "0001.002.3.4 256.1.1.1", "4111 1111 1111 1111", "4111-1111 1111-1112", "+1 (017) 555-7713", "+1" + " " * 50, "\u0661\u0662@x.yy"]
    for t in texts:
        assert personal.base_spans(t)[0] == plain(t), t


def test_long_texts_are_read_in_linear_time():
    for part in ("a", "1", "@", "a@", "1 ", "+1", "1.", "A", "Aa ", ":", "1:", "(1", "a.b@c", " at dot", "AB12", "12-"):
        began = time.process_time()
        personal.candidates(part * 100_000)
        assert time.process_time() - began < 8, part


GOOD = ["call me at ({a}) {b}-{c} today", "phone {a}-{b}-{c} after six", "write to {w} (at) {v} dot com please", "my ssn is {a}-{d}-{c} as asked", "regards, Anna {V}", "Dr. Peter {V} will see you", "mail {w}@{v}.com soon", "we live at {d} {V} Street since then"]
BAD = ["order no {a}-{b}-{c} was sent", "version {d}.{d}.{a} of {b}", "page {a} of {b}", "New York City is large", "invoice {a} {b} {c} total", "in {V} January it rained", "the ratio was {d}:{d}:{d} then"]


def sentence(rng, forms):
    word = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    number = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    return "some words before " + rng.choice(forms).format(a=number(3), b=number(3), c=number(4), d=number(2), w=word, v=word[::-1], V=word.title()) + " and some words after"


def test_added_spans_on_held_out_sentences(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, GOOD if i % 3 else BAD)) for i in range(3000)]
    model = personal.learned(frame(spark, rows))
    right = model.labels.reliabilities()
    assert right["sure patterns"] > 0.8 and right["counter words"] > 0.8 and model.labels.share > 0.4
    good, bad = [sentence(rng, GOOD) for _ in range(400)], [sentence(rng, BAD) for _ in range(400)]
    hit = lambda t: any(x for x in personal.spans_of(t, model))
    assert sum(map(hit, good)) >= 0.9 * len(good) and sum(map(hit, bad)) <= 0.1 * len(bad)
    assert "[NATIONAL_PHONE]" in personal.masked("phone 234-567-8999 after six", model) and personal.masked(None, model) is None
    assert personal.masked("mail a.b@c.org now", model) == "mail [EMAIL] now"


@pytest.mark.parametrize("copies", [1, 300])
def test_report(spark, sf, copies):
    odd = [(None, "a@b.cc"), (1, None), (2, ""), (2, ""), (3, "é😀 x@y.zz, 1.2.3.4 and 4111 1111 1111 1111; +49 (30) 123-4567"), (4, "x" * 5_000 + " q@r.st")]
    rows = odd * copies if copies > 1 else odd + [(r.doc_id + 10, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = personal.report(frame(spark, rows).repartition(3)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        sure = plain(texts[r.doc_id] or "")
        said = [f"{k}:{s}:{e}" for k, s, e in sure]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in sure) for kind in WRITTEN)
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert spans[: len(said)] == said and all(x.split(":")[0] in personal.ADDED for x in spans[len(said) :])
    assert personal.report(frame(spark, [])).collect() == []
