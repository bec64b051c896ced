"""A quality classifier without hand labels: weak labellers, a label model,
and a hashed linear scorer.

Several heuristic labellers vote good, bad or nothing on every document.  A
label model (two classes; each labeller has its own chances of each vote in each
class) is fitted by expectation-maximisation on the histogram of vote patterns
over *all* documents, a table of at most 3**len(LABELLERS) rows however many
documents there are.  Its posterior is the weak label of each pattern.  On a
bounded sample a logistic scorer over hashed words and word shapes learns the
weak labels, so that it also judges what no labeller looks at; it then scores
every document.

Texts are read once: votes and hashed features of every document are staged, and
histogram, sample and scores come from them.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_of, slices, staged, utf8

BAD, GOOD, NONE = 0, 1, 2
DIMENSIONS = 1 << 18
SAMPLE = 8_000  #: documents that the scorer is fitted on, a sample by hash
SLICE_BYTES = 4 << 20
#: The chances of the votes (bad, good) believed beforehand in each class, and
#: the weight of that belief as a share of all documents.
EXPECTED, BELIEF = {BAD: (0.35, 0.65), GOOD: (0.01, 0.99)}, 0.05
KEEP = 0.5  #: least score of a document that stays

# Frequent function words of four languages, for one labeller.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit von für auf den dem des ein eine im in zu als auch sich wie bei aus oder nach wird",
    "en": "the of and to in a is that for it as was with be by on not he this are or from at which but have an had they you",
    "es": "el la los las de del que y en un una por con para se no es al lo como su más pero sus le o este entre",
    "fr": "le la les de des du et en un une est que qui dans pour par sur au aux avec ce il ne pas plus se son ou",
}
_STOP = frozenset(w.encode() for text in FUNCTION_WORDS.values() for w in text.split())
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: letters to a or A, digits to 0, bytes beyond ASCII to a
_SHAPE = bytes(0x41 if 0x41 <= c <= 0x5A else 0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))


def _count(data: bytes, those: bytes) -> int:
    return len(data) - len(data.translate(None, those))


def facts(data: bytes) -> dict:
    words = data.split()
    n = max(1, len(words))
    low = [w.strip(b".,;:!?\"'()") for w in data.translate(_LOWER).split()]
    lines = [x for x in data.split(b"\n") if x.strip()]
    return {
        "n": len(words),
        "symbols": _count(data, b"#*$%&|<>~^=") / n,
        "upper": _count(data, _UPPER) / max(1, len(data)),
        "digits": _count(data, b"0123456789") / max(1, len(data)),
        "distinct": len(set(low)) / n,
        "stop": sum(map(_STOP.__contains__, low)) / n,
        "ends": sum(w[-1:] in b".!?" for w in words) / n,
        "length": sum(map(len, words)) / n,
        "copies": 1 - len(set(lines)) / max(1, len(lines)),
        "bangs": data.count(b"!") / n,
        "bars": words.count(b"|") / n,
        "odd ends": sum(w[-1:] in b"#*$%&|<>~^=@+_/\\" for w in words) / n,
    }


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: Each labeller sees the facts of a document; short documents tell it less.
LABELLERS = {
    "symbols": lambda f: _vote(f["symbols"] > 0.25, f["symbols"] < 0.03 and f["n"] >= 20),
    "capitals": lambda f: _vote(f["upper"] > 0.3, f["upper"] < 0.1 and f["n"] >= 20),
    "variety": lambda f: _vote(f["n"] >= 30 and f["distinct"] < 0.2, f["n"] >= 30 and f["distinct"] > 0.4),
    "function words": lambda f: _vote(f["n"] >= 30 and f["stop"] < 0.06, f["n"] >= 30 and f["stop"] > 0.12),
    "sentences": lambda f: _vote(f["n"] >= 40 and f["ends"] < 0.01, f["n"] >= 40 and 0.02 < f["ends"] < 0.35),
    "word length": lambda f: _vote(f["length"] > 12 or f["length"] < 2, 3 < f["length"] < 9 and f["n"] >= 20),
    "copied lines": lambda f: _vote(f["copies"] > 0.3, f["copies"] == 0 and f["n"] >= 40),
    "shouting": lambda f: _vote(f["bangs"] > 0.3, f["bangs"] < 0.05 and f["n"] >= 40),
    "tables": lambda f: _vote(f["bars"] > 0.2, f["bars"] < 0.02 and f["n"] >= 40),
    "odd ends": lambda f: _vote(f["odd ends"] > 0.3, f["odd ends"] < 0.05 and f["n"] >= 20),
}


def pattern(data: bytes) -> int:
    """The votes as the digits of a number to base 3, the first labeller's last."""
    f, out = facts(data), 0
    for label in reversed(LABELLERS.values()):
        out = out * 3 + label(f)
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, known, pattern, words, shapes, shares) of every row: whether there
    is a text, the votes, the hashed words, and the hashed word shapes with their
    weights."""

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            known = batch.column(1).is_valid()
            for a, b in slices(off, SLICE_BYTES):
                data = raw[off[a] : off[b]].tobytes()
                texts = [data[s - off[a] : e - off[a]] for s, e in zip(off[a:b], off[a + 1 : b + 1])]
                rows = [features(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), known.slice(a, b - a), pa.array([pattern(t) for t in texts], pa.int32()), *(pa.array([r[k] for r in rows], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int32(), pa.float32())))],
                    names=["doc_id", "known", "pattern", "words", "shapes", "shares"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, known boolean, pattern int, words array<int>, shapes array<int>, shares array<float>")


class LabelModel:
    """Class prior and, per labeller and class, the chances of either vote among
    those cast.  Expectation-maximisation starts from, and is held by, the belief
    that a labeller rarely calls a good document bad, while a bad document has
    but a few faults, so that most labellers still call it good."""

    def __init__(self, patterns: dict[int, int], rounds: int = 200):
        keys = np.array(sorted(patterns), np.int64)
        weight = np.array([patterns[k] for k in keys.tolist()], float)
        m = len(LABELLERS)
        digits = (keys[:, None] // 3 ** np.arange(m)) % 3
        seen = (digits[:, :, None] == np.arange(3)).astype(float)  # pattern, labeller, vote
        # start: the majority of the votes cast
        lean = 1.0 + (digits == GOOD).sum(1) - 4.0 * (digits == BAD).sum(1)
        good = 1 / (1 + np.exp(-lean))
        self.prior, self.chance = 0.5, np.full((2, m, 3), 0.5)
        self.chance[:, :, NONE] = 1.0  # who is silent says nothing about the class
        total = weight.sum()
        for _ in range(rounds if len(keys) else 0):
            for c, share in ((GOOD, good), (BAD, 1 - good)):
                counts = np.einsum("p,plv->lv", weight * share, seen)[:, [BAD, GOOD]] + BELIEF * total * np.array(EXPECTED[c]) + 1e-3
                self.chance[c][:, [BAD, GOOD]] = counts / counts.sum(1, keepdims=True)
            self.prior = float(((weight * good).sum() + 1) / (total + 2))
            odds = np.log(self.prior / (1 - self.prior)) + np.einsum("plv,lv->p", seen, np.log(self.chance[GOOD] / self.chance[BAD]))
            new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            done, good = np.abs(new - good).max() < 1e-9, new
            if done:
                break
        self.posterior = dict(zip(keys.tolist(), good.tolist()))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller: the chance that a vote it casts is right."""
        right = self.prior * self.chance[GOOD, :, GOOD] + (1 - self.prior) * self.chance[BAD, :, BAD]
        return dict(zip(LABELLERS, right.tolist()))


def features(data: bytes) -> tuple[list[int], list[int], list[float]]:
    """Hashed features: each distinct word once, each word shape with its share
    times three; the words weigh one over the root of their number."""
    crc = zlib.crc32
    words = {w.strip(b".,;:!?\"'()") for w in set(data.translate(_LOWER).split())}
    shapes: dict[bytes, int] = {}
    for w, c in Counter(data.translate(_SHAPE).split()).items():  # few are different
        key = bytes(dict.fromkeys(w))  # the kinds of characters, in order of first sight
        shapes[key] = shapes.get(key, 0) + c
    n = max(1, sum(shapes.values()))
    return sorted(crc(w) % DIMENSIONS for w in words), [crc(s, 1) % DIMENSIONS for s in shapes], [3.0 * c / n for c in shapes.values()]


def flattened(words, shapes, shares) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all features of some rows of ``measured``."""
    rows, places, values = [], [], []
    for at, value in ((words, None), (shapes, shares)):
        counts = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows.append(np.repeat(np.arange(len(at)), counts))
        places.append(at.flatten().to_numpy(zero_copy_only=False))
        values.append(np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts) if value is None else value.flatten().to_numpy(zero_copy_only=False).astype(float))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def fit(y: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels by full-batch Adam; classes weigh alike."""
    w = np.zeros(DIMENSIONS)
    if not len(y):
        return w.astype(np.float32), 0.0
    used, at = np.unique(at, return_inverse=True)
    theta = np.zeros(len(used) + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    good, bad = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    weight = y * (len(y) / 2 / good) + (1 - y) * (len(y) / 2 / bad)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * theta[at], minlength=len(y)) + theta[-1]
        residual = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.append(np.bincount(at, value * residual[row], minlength=len(used)), residual.sum()) / len(y) + ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[used] = theta[:-1]
    return w.astype(np.float32), float(theta[-1])


def classified(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, pattern, weak_label, score, kept) of every row.

    Null is the empty text, on which nobody votes but those that need no words,
    and which teaches nothing.  A very long text costs its own task; a score equal
    to the limit keeps the document; rows with equal texts get equal results;
    other columns are ignored; an empty table gives an empty result.
    """
    own = staged(measured(docs, id_col, text), "measured")
    counts = own.groupBy("pattern").count().collect()  # at most 3**len(LABELLERS) rows
    model = LabelModel({r[0]: r[1] for r in counts})
    seen = sample_of(own.where("known"), sample, "doc_id", "words", "shapes").select("pattern", "words", "shapes", "shares").toArrow().combine_chunks()
    column = lambda c: seen[c].combine_chunks() if isinstance(seen[c], pa.ChunkedArray) else seen[c]
    y = np.array([model.posterior[p] for p in seen["pattern"].to_pylist()])
    weights = fit(y, *flattened(column("words"), column("shapes"), column("shares"))) if len(y) else fit(y, y, y, y)
    kind = own.schema["doc_id"].dataType.simpleString()
    scorer = own.sparkSession.sparkContext.broadcast((model.posterior, *weights))
    return own.mapInArrow(_score(scorer), f"doc_id {kind}, pattern int, weak_label double, score double").withColumn("kept", F.col("score") >= KEEP)


def _score(scorer):
    def run(batches):
        posterior, w, bias = scorer.value
        for batch in batches:
            row, at, value = flattened(*(batch.column(k) for k in (3, 4, 5)))
            z = np.bincount(row, w[at] * value, minlength=len(batch)) + bias
            labels = [posterior.get(p, 0.5) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(labels, pa.float64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "pattern", "weak_label", "score"])

    return run


def report(docs: DataFrame) -> DataFrame:
    out = classified(docs.select("doc_id", "text"))
    return out.select("doc_id", "pattern", F.round("weak_label", 6).alias("weak_label"), F.round("score", 6).alias("score"), "kept")
