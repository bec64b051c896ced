"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased, everything but letters becomes one space, and each
character (UTF-16 unit) is predicted from the three before it (documents do not
touch).  The counts of 4-grams come from every labelled training row; lower
orders use continuation counts.  A model is a few sorted arrays of 64-bit n-gram
keys per language (four 16-bit units are a perfect hash) with the discounted
probability of each n-gram and the back-off weight of each context, looked up by
binary search.  A text gets the language of the lowest cross-entropy per
character.

Every n-gram is kept.  What predicts a character depends on the n-grams with the
same two characters before the last, and on shorter ones, so the models are cut by
those two into *blocks* of about ``BLOCK`` n-grams; only one block at a time is
gathered and held by a task, with the pairs of characters that it needs, and the bits of
a text are summed over the blocks, one pass over the texts for each.  What crosses
blocks (discounts and the counts of one and two characters) is counted in Spark over
all n-grams beforehand.

The winner's lead is turned into a probability on training rows that the models
used for calibration have not seen (Platt scaling), and a text whose
cross-entropy is above nearly all of its language's, or whose score is below
one half, is marked ``rejected``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_of, slices, staged, utf8

N = 4
#: n-grams of all languages that are gathered and broadcast at once; more n-grams
#: mean more passes.  The n-grams behind two characters, at most the square of the
#: alphabet, are never parted.
BLOCK = 2_000_000
TOGETHER = 8  #: blocks that are broadcast for one job
#: labelled rows that calibration scores, a sample by hash.
CALIBRATION = 4_000
SLICE_BYTES = 2 << 20
UNKNOWN = "und"

_letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 16 * n) - 1)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The N-gram key of each predicted character and its document."""
    raw = data.copy()
    raw[raw == 10] = 32
    text = raw.tobytes()
    joined = b"\n".join([text[a:b] for a, b in zip(off[:-1], off[1:])] + [b""])
    code = np.frombuffer(joined.decode("utf-8", "replace").lower().encode("utf-16-le", "surrogatepass"), np.uint16)
    letter = _letter[code]
    high = np.nonzero((code >= 0xD800) & (code < 0xDC00))[0]
    if len(high):  # both units of a character above U+FFFF
        cp = 0x10000 + ((code[high].astype(np.int64) - 0xD800) << 10) + (code[high + 1] - 0xDC00)
        letter[high] = letter[high + 1] = [chr(c).isalpha() for c in cp.tolist()]
    cp = code
    end = cp == 10
    after = np.concatenate(([False], letter[:-1]))
    kept = np.nonzero(letter | end | after)[0]
    code = np.where(letter[kept], code[kept], 32).astype(np.uint64)
    # a document's end is N-1 spaces, the first of which follows the last word
    times = np.where(end[kept], N - 1, 1)
    doc = np.cumsum(end[kept]) - end[kept]
    event = np.where(end[kept], after[kept], True)
    first = np.cumsum(times) - times + N - 1
    code = np.concatenate((np.full(N - 1, 32, np.uint64), np.repeat(code, times)))
    at = first[event]
    key = code[at]
    for j in range(1, N):
        key = key | (code[at - j] << np.uint64(16 * j))
    return key, doc[event]


def _count(batches):
    """(lang, gram, n, n_fit): the N-grams of a partition, counted."""
    held: dict[str, list] = {}

    def squeeze(parts):
        key = np.concatenate([p[0] for p in parts])
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.zeros(0, np.int64)
        return [(key[start], *(np.add.reduceat(np.concatenate([p[k] for p in parts])[order], start) if len(start) else np.zeros(0, np.int64) for k in (1, 2)))]

    for batch in batches:
        raw, off = utf8(batch.column(0))
        lang = np.array(batch.column(1).to_pylist(), object)
        fit = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in slices(off, SLICE_BYTES):
            key, doc = grams(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            for name in set(lang[a:b]):
                mine = (lang[a:b] == name)[doc]
                parts = held.setdefault(name, [])
                parts += squeeze([(key[mine], np.ones(int(mine.sum()), np.int64), fit[a:b][doc[mine]])])
                if len(parts) > 16:
                    held[name] = squeeze(parts)
    for name, parts in held.items():
        key, n, n_fit = squeeze(parts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n), pa.array(n_fit)], names=["lang", "gram", "n", "n_fit"])


class KneserNey:
    """One language, the n-grams of one block: arrays per order, sorted by key.
    ``pairs`` and ``single`` hold the keys and continuation counts of the two lowest
    orders, whose contexts reach beyond a block."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discounts: dict[int, float], pairs: tuple[np.ndarray, np.ndarray], single: tuple[np.ndarray, np.ndarray], alphabet: int):
        self.orders = []
        for n in range(N, 1, -1):
            if n == 2:
                keys, counts = pairs
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order].astype(np.float64)
            d = discounts[n]
            context, inverse = np.unique((keys >> np.uint64(16)) & _mask(n - 1), return_inverse=True)
            total, kinds = np.bincount(inverse, counts), np.bincount(inverse)
            self.orders.append((keys, ((counts - d) / total[inverse]).astype(np.float32), context, (d * kinds / total).astype(np.float32)))
            keys, seen = np.unique(keys & _mask(n - 1), return_counts=True)
            counts = seen.astype(np.float64)
        keys, counts = single
        total = max(float(counts.sum()), 1.0)
        self.floor = discounts[1] * len(keys) / total / alphabet if len(keys) else 1.0 / alphabet
        self.single = (keys, ((counts - discounts[1]) / total).astype(np.float32))
        self.orders.reverse()

    @staticmethod
    def _find(keys, values, wanted, missing):
        if not len(keys):
            return np.full(len(wanted), missing, np.float64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing).astype(np.float64)

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Cost in bits of the last character of each N-gram."""
        p = self._find(*self.single, wanted & _mask(1), 0.0) + self.floor
        for n, (keys, alpha, context, gamma) in enumerate(self.orders, 2):
            p = self._find(keys, alpha, wanted & _mask(n), 0.0) + self._find(context, gamma, (wanted >> np.uint64(16)) & _mask(n - 1), 1.0) * p
        return -np.log2(np.maximum(p, 1e-30))


class Block:
    """The languages' models of the N-grams whose two characters before the last
    are from ``lo`` to ``hi`` (the nearer one counting more), in code-point order of
    the languages' names."""

    def __init__(self, lo: int, hi: int, models: list[KneserNey]):
        self.lo, self.hi, self.models = lo, hi, models

    def sums(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predicted characters of each document, and the bits in each language
        of those that this block predicts."""
        key, doc = grams(data, off)
        n = np.bincount(doc, minlength=len(off) - 1)
        before = (((key >> np.uint64(16)) & _mask(1)) << np.uint64(16)) | ((key >> np.uint64(32)) & _mask(1))
        own = (before >= self.lo) & (before <= self.hi)
        distinct, inverse = np.unique(key[own], return_inverse=True)
        out = np.empty((len(off) - 1, len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = np.bincount(doc[own], m.bits(distinct)[inverse], minlength=len(off) - 1)
        return n, out


class Models:
    """The languages' models in code-point order of their names: discounts,
    one-character counts and the bounds of the blocks.  The n-grams themselves
    stay in the table ``grams`` until their block is asked for."""

    def __init__(self, grams_: DataFrame, pairs: DataFrame, column: str, names: list[str], counts: dict, single: dict, bounds: list[tuple[int, int]]):
        self.grams, self.pairs, self.column, self.bounds = grams_, pairs, column, bounds
        self.names = names
        self.discounts = {}
        for x in names:
            for n in range(1, N + 1):
                once, twice = counts.get((x, n), (0, 0))
                self.discounts.setdefault(x, {})[n] = once / (once + 2 * twice) if once and twice else 0.5
        self.single = single
        self.alphabet = len({k for keys, _ in single.values() for k in keys.tolist()}) + 1
        self.a, self.b, self.limit = 0.0, 1.0, {}

    def block(self, k: int) -> Block:
        lo, hi = self.bounds[k]
        near = F.shiftright("gram", 16).bitwiseAND(F.lit(0xFFFF))
        none = np.zeros(0, np.uint64)

        def arrays(table: DataFrame) -> dict:
            rows = table.where(F.col(self.column) > 0).select("lang", "gram", self.column).toPandas()
            return {x: (v["gram"].to_numpy().view(np.uint64), v[self.column].to_numpy()) for x, v in rows.groupby("lang")}

        grams_ = arrays(self.grams.where(_before("gram").between(lo, hi)))
        pairs = arrays(self.pairs.where(near.between(lo >> 16, hi >> 16)))
        return Block(lo, hi, [KneserNey(*grams_.get(x, (none, none)), self.discounts[x], pairs.get(x, (none, none)), self.single.get(x, (none, none)), self.alphabet) for x in self.names])

    def summed(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` without ``text`` but with ``__n`` characters and their ``__bits`` in each
        language.  A task holds one block; a pass over the texts leaves
        what it finds by their digests, so texts are read once a block and never
        written."""
        spark = df.sparkSession
        kept = [c for c in df.columns if c != text]
        blocks = len(self.bounds) if self.names else 0
        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema)
        share = lambda k: _add(spark.sparkContext.broadcast(self.block(k)), len(self.names))
        if not blocks:
            return df.select(*kept, F.lit(0).cast("long").alias("__n"), F.expr("array()").cast("array<double>").alias("__bits"))
        if blocks == 1:
            return df.select(*kept, text).mapInArrow(share(0), kinds + "`__n` long, `__bits` array<double>")
        digest = F.sha2(F.col(text).cast("binary"), 256)
        texts, found = df.where(F.col(text).isNotNull()).select(digest.alias("__of"), text), None
        for first in range(0, blocks, TOGETHER):
            some = None
            for k in range(first, min(blocks, first + TOGETHER)):  # a task reads one block, a worker lets the last one go
                more = texts.mapInArrow(share(k), "`__of` string, `__n` long, `__bits` array<double>").withColumn("__k", F.lit(k))
                some = more if some is None else some.unionByName(more)
            # copies of a text have the same sums
            some = staged(some.groupBy("__of", "__k").agg(F.first("__n").alias("__n"), F.first("__bits").alias("__bits")), "bits")
            found = some if found is None else found.unionByName(some)
        zero = F.transform(F.sequence(F.lit(1), F.lit(len(self.names))), lambda _: F.lit(0.0))
        parts = F.array_sort(F.collect_list(F.struct("__k", "__bits")))  # one a block
        sums = found.groupBy("__of").agg(F.max("__n").alias("__n"), F.aggregate(parts, zero, lambda a, x: F.zip_with(a, x["__bits"], lambda y, z: y + z)).alias("__bits"))
        out = df.select(*kept, digest.alias("__text")).join(staged(sums, "bits"), F.col("__text") == F.col("__of"), "left")
        return out.select(*kept, F.coalesce("__n", F.lit(0).cast("long")).alias("__n"), F.coalesce("__bits", zero).alias("__bits"))

    def calibrate(self, rows: list) -> None:
        """``rows``: (true language, predicted, bits per character, lead)."""
        x = np.array([math.log1p(r[3]) for r in rows] + [0.0, 0.0])
        y = np.array([float(r[0] == r[1]) for r in rows] + [0.0, 1.0])  # no lead: even odds
        w = np.zeros(2)
        features = np.stack([np.ones_like(x), x], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
            gradient = features.T @ (y - p) - 0.01 * w
            hessian = (features * (p * (1 - p))[:, None]).T @ features + 0.01 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.a, self.b = float(w[0]), max(float(w[1]), 0.0)
        for name in self.names:
            own = sorted(r[2] for r in rows if r[0] == r[1] == name)
            if len(own) >= 20:
                self.limit[name] = own[int(0.995 * (len(own) - 1))] * 1.25

    def judged(self, df: DataFrame) -> DataFrame:
        """The columns of ``summed`` turned into those of ``ADDED``."""
        bits, n = F.col("__bits"), F.greatest("__n", F.lit(1))
        low = F.array_min(bits)
        best = F.array_position(bits, low).cast("int")
        rest = F.array_min(F.concat(F.slice(bits, 1, best - 1), F.slice(bits, best + 1, len(self.names) + 1)))
        known = (F.col("__n") > 0) & F.lit(bool(self.names))
        name = F.get(F.array(*[F.lit(x) for x in self.names] or [F.lit(UNKNOWN)]), best - 1)
        lead = F.when(known, F.coalesce(rest - low, F.lit(0.0))).otherwise(0.0)
        score = F.when(known, 1 / (1 + F.exp(-F.greatest(F.least(self.a + self.b * F.log1p(lead), F.lit(40.0)), F.lit(-40.0))))).otherwise(0.0)
        per = F.when(known, low / n).otherwise(0.0)
        limit = F.lit(float("inf"))
        for x, v in self.limit.items():
            limit = F.when(name == x, v).otherwise(limit)
        kept = [F.col(f"`{c}`") for c in df.columns if c not in ("__n", "__bits")]
        return df.select(
            *kept, F.when(known, name).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"), per.alias("bits"), lead.alias("lead"),
            F.coalesce(~known | (per > limit) | (score < 0.5), F.lit(True)).alias("rejected"),
        )


def _before(gram: str) -> Column:
    """The two characters before the last, the nearer one counting more."""
    at = lambda k: F.shiftright(gram, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return F.shiftleft(at(1), 16).bitwiseOR(at(2))


def _add(block, languages: int):
    """Replaces the last column, the text, by its characters and bits."""

    def run(batches):
        m = block.value
        for batch in batches:
            raw, off = utf8(batch.column(batch.num_columns - 1))
            parts = [m.sums(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in slices(off, SLICE_BYTES)]
            n = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
            bits = np.concatenate([x for _, x in parts]) if parts else np.zeros((0, languages))
            sums = pa.ListArray.from_arrays(np.arange(0, len(batch) * languages + 1, languages, dtype=np.int32), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n.astype(np.int64)), sums], names=[*batch.schema.names[:-1], "__n", "__bits"])

    return run


ADDED = "lang_pred string, score double, bits double, lead double, rejected boolean"


def counted(table: DataFrame) -> tuple[dict, dict, DataFrame]:
    """For both columns ``n`` and ``n_fit`` of a table of N-grams: the n-grams
    seen once and twice by (language, order), and the one-character continuation
    counts by language; and the table of the two-character ones.  Lower orders count
    the distinct n-grams one longer."""
    columns = ("n", "n_fit")
    counts, single = {c: {} for c in columns}, {c: {} for c in columns}
    level = table
    for n in range(N, 0, -1):
        if n < N:
            mask = F.lit(int((1 << 16 * n) - 1))
            level = level.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in columns])
            level = staged(level, "grams") if n > 1 else level
        pairs = level if n == 2 else None if n > 2 else pairs
        for r in level.groupBy("lang").agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in columns for k in (1, 2)]).collect():
            for c in columns:
                counts[c][(r["lang"], n)] = (r[f"{c}1"], r[f"{c}2"])
    rows = level.toPandas().sort_values(["lang", "gram"])  # a row for each character of a language
    for c in columns:
        for x, v in rows[rows[c] > 0].groupby("lang"):
            single[c][x] = (v["gram"].to_numpy().view(np.uint64), v[c].to_numpy().astype(np.float64))
    return counts, single, pairs


def _bounds(table: DataFrame, block: int) -> list[tuple[int, int]]:
    """Ranges of the two characters before the last that hold about ``block`` n-grams."""
    sizes = sorted((r["c"], r["k"]) for r in table.groupBy(_before("gram").alias("c")).agg(F.count("*").alias("k")).collect())
    cuts, held = [0], 0
    for c, k in sizes:
        if held and held + k > block:
            cuts.append(c)
            held = 0
        held += k
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], 1 << 32])]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", fit: Column | None = None, key: Column | None = None, block: int = BLOCK, sample: int = CALIBRATION) -> Models:
    """Models of the languages of ``docs`` (rows without text or lang teach
    nothing).  ``fit`` marks the rows whose counts calibrate; the others are
    those of which calibration scores a sample, by hash of ``key`` and text.  The
    final models count both."""
    fit = F.pmod(F.hash(F.col(text)), F.lit(4)) != 0 if fit is None else fit
    own = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), fit.alias("fit"), (F.lit(0) if key is None else key).alias("key"))
    grams_ = own.drop("key").mapInArrow(_count, "lang string, gram long, n long, n_fit long")
    table = staged(grams_.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_fit").alias("n_fit")), "grams")
    counts, single, pairs = counted(table)
    bounds = _bounds(table, block)
    names = lambda c: sorted(single[c], key=lambda x: x.encode())
    final = Models(table, pairs, "n", names("n"), counts["n"], single["n"], bounds)
    trial = Models(table, pairs, "n_fit", names("n_fit"), counts["n_fit"], single["n_fit"], bounds)
    if trial.names:
        seen = staged(sample_of(own.where(~F.col("fit")), sample, "key", "text").select("text", "lang"), "sample")
        scored = trial.judged(trial.summed(seen)).where(F.col("lang_pred") != UNKNOWN)
        final.calibrate([tuple(r) for r in scored.select("lang", "lang_pred", "bits", "lead").collect()])
    return final


def identify(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with lang_pred, score, bits (per character),
    lead (bits over the next language) and rejected.  Texts that are null or
    have no letter get ``und``, score 0 and are rejected, as all texts do if no
    language was learned; ties go to the first name by code point; a very long
    text costs its own task; equal rows get equal results.  Existing columns of
    these names are replaced, others pass through."""
    added = {"lang_pred", "score", "bits", "lead", "rejected"}
    kept = [c for c in docs.columns if c.lower() not in added and c.lower() != text.lower()]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d") if kept else F.lit(None).alias("d"), F.col(f"`{text}`").alias("text"))
    out = models.judged(models.summed(df))
    return out.select(*[F.col("d")[c].alias(c) for c in kept], *added_columns())


def added_columns() -> list[Column]:
    return [F.col(c.split()[0]) for c in ADDED.split(", ")]


def report(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id is 2 modulo 4 are held out; remainder 3 calibrates."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    rest = F.coalesce(part, F.lit(0))
    models = train(docs.where(rest != 2), fit=rest != 3, key=F.col("doc_id"))
    out = identify(docs.select("doc_id", (rest == 2).alias("held_out"), "text"), models)
    return out.select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"), F.round("bits", 4).alias("bits"), "rejected")
