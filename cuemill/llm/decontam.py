"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of ``window`` consecutive words of the benchmark
items (an item of fewer words is one pattern).  Text and patterns become arrays
of word numbers, so comparing numbers is comparing words.  For each pattern
length there is

* a *shift table*: for every block of ``BLOCK`` words the least distance from
  its end to a pattern's end.  The text is read by cursors, one for every ``RUN``
  words, that look at the block where they stand and jump ahead by its shift, so
  most positions are never looked at;
* *suffix buckets*: the patterns by the number of their last block.  A position
  of shift 0 is compared only with the patterns of its own bucket, from the
  last word to the first.

Bucket numbers may clash; the direct comparison of all words decides.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged, unused, utf8

BLOCK = 3
RUN = 64  #: words that one cursor reads
#: Benchmark bytes that one broadcast holds (its model is about twelve times as
#: large); a larger benchmark is searched in blocks of this size, one pass over the
#: texts after the other, so a worker holds one block at a time.  What a pass writes
#: are the hits by text digest; the documents are never written.
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 4 << 20

#: A-Z become a-z; ASCII that is neither letter nor digit becomes a space.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Length:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, patterns: np.ndarray, size: int):
        self.m = patterns.shape[1]
        self.block = min(BLOCK, self.m)
        self.patterns, self.base = patterns, size
        self.bits = max(10, min(22, int(np.ceil(np.log2(len(patterns) * self.m + 1))) + 2))
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.uint8 if self.m < 250 else np.uint16)
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self.slot(self.keys(patterns, end)), self.m - end)
        last = self.keys(patterns, self.m)
        order = np.argsort(last, kind="stable")
        self.order = order
        self.suffixes, self.first, self.count = np.unique(last[order], return_index=True, return_counts=True)

    def keys(self, patterns: np.ndarray, end: int) -> np.ndarray:
        key = np.zeros(len(patterns), np.uint64)
        for j in range(end - self.block, end):
            key = key * np.uint64(self.base) + patterns[:, j].astype(np.uint64)
        return key

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _stops(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of shift 0 and the numbers of their blocks."""
        at = np.arange(self.m - 1, len(ids), RUN)
        limit = np.minimum(at + RUN, len(ids))
        ends, keys = [], []
        while len(at):
            key = np.zeros(len(at), np.uint64)
            for j in range(self.block - 1, -1, -1):
                key = key * np.uint64(self.base) + ids[at - j].astype(np.uint64)
            shift = self.shift[self.slot(key)]
            stop = shift == 0
            ends.append(at[stop])
            keys.append(key[stop])
            at = at + np.maximum(shift, 1)
            go = at < limit
            at, limit = at[go], limit[go]
        ends, keys = np.concatenate(ends), np.concatenate(keys)
        order = np.argsort(ends)
        return ends[order], keys[order]

    def find(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of each occurrence in ``ids``; ``begins`` holds for
        every word the position at which its document begins."""
        n, m = len(ids), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, key = self._stops(ids)
        at = np.searchsorted(self.suffixes, key)
        at[at == len(self.suffixes)] = 0
        stop = (self.suffixes[at] == key) & (ends - m + 1 >= begins[ends])
        ends, at = ends[stop], at[stop]
        many = self.count[at]
        where = np.repeat(ends, many)
        inner = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
        pattern = self.order[np.repeat(self.first[at], many) + inner]
        for j in range(m):
            same = ids[where - j] == self.patterns[pattern, m - 1 - j]
            where, pattern = where[same], pattern[same]
        return where - m + 1, pattern


class WuManber:
    """The search structure of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = np.array([item for item, _ in items], object)
        windows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            m = min(window, len(ids))
            if m:
                own = np.lib.stride_tricks.sliding_window_view(ids, m)
                windows.setdefault(m, []).append(own)
                owners.setdefault(m, []).append(np.full(len(own), k, np.int32))
        self.lengths = []
        for m, parts in windows.items():
            rows = np.ascontiguousarray(np.concatenate(parts))
            _, first, inverse = np.unique(rows.view(np.dtype((np.void, 4 * m))).ravel(), return_index=True, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            ends = np.cumsum(np.bincount(inverse))
            # the items of pattern p are those of owner[ends[p - 1] : ends[p]]
            self.lengths.append((Length(rows[first], len(self.vocabulary) + 1), np.concatenate(owners[m])[order], np.concatenate(([0], ends))))

    def search(self, raw: np.ndarray, off: np.ndarray):
        """Of each document: its words, hit word ranges and items."""
        data = raw.tobytes().translate(FOLD)
        split = [data[a:b].split() for a, b in zip(off[:-1], off[1:])]
        count = np.array([len(x) for x in split], np.int64)
        start = np.concatenate(([0], np.cumsum(count)))
        get = self.vocabulary.get
        ids = np.fromiter((i for x in split for i in map(get, x, repeat(0))), np.int32, int(start[-1]))
        begins = np.repeat(start[:-1], count)
        spans: list[list[tuple[int, int]]] = [[] for _ in split]
        items: list[set] = [set() for _ in split]
        for length, owner, ends in self.lengths:
            found, pattern = length.find(ids, begins)
            doc = np.searchsorted(start, found, side="right") - 1
            for d, s, p in zip(doc.tolist(), (found - start[doc]).tolist(), pattern.tolist()):
                spans[d].append((s, s + length.m))
                items[d].update(x for x in self.items[owner[ends[p] : ends[p + 1]]] if x is not None)
        return count, spans, items


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, into: str = "found") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, the merged word ranges
    (s, e) covered by occurrences of benchmark windows, and the items found.

    Null texts have no words; items without words are never found; a null id hits
    like any other but is not among the items; repeated rows and items give repeated
    rows and one item; occurrences that overlap are one range; a very long text costs
    its own task; an empty table or an empty benchmark finds nothing.  An existing
    column ``into`` is replaced, all other columns pass through.
    """
    spark = docs.sparkSession
    own = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    df = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, T.StructField(into, FOUND)])
    where = [c.lower() for c in kept].index(text.lower())

    def model(k: int):
        part = own.where(F.pmod(F.hash("item", "text"), F.lit(blocks)) == k) if blocks > 1 else own
        return spark.sparkContext.broadcast(WuManber([(r[0], bytes(r[1])) for r in part.collect()], window))

    if blocks == 1:
        return df.mapInArrow(_search(model(0), where, into), schema)
    digest, texts = F.sha2(F.col(f"`{text}`").cast("binary"), 256), docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    hits = None
    for k in range(blocks):
        more = texts.mapInArrow(_search(model(k), 0, "found"), T.StructType([*texts.schema.fields, T.StructField("found", FOUND)])).where(F.size("found.spans") > 0)
        # copies of a text have the same hits
        more = staged(more.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.first("found").alias("found")), "hits")
        hits = more if hits is None else hits.unionByName(more)
    hits = staged(hits.groupBy("digest").agg(F.flatten(F.collect_list("found.spans")).alias("spans"), F.flatten(F.collect_list("found.items")).alias("items")), "hits")
    row = unused(docs, "__row")
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), digest.alias(row)).join(hits.withColumnRenamed("digest", f"{row}_of"), F.col(row) == F.col(f"{row}_of"), "left")
    wide = named.select(*[F.col("d")[c].alias(c) for c in kept], F.struct(F.lit(0).cast("long").alias("n_words"), F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).alias(into))
    return wide.mapInArrow(_search(spark.sparkContext.broadcast(WuManber([], window)), where, into, len(kept)), schema)


def _search(model, where: int, into: str, before: int | None = None):
    """Adds the column ``into`` to batches whose text is column ``where``; column
    ``before`` has what is known already."""
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(where))
            known = None if before is None else batch.column(before).to_pylist()
            rows = []
            for a, b in slices(off, SLICE_BYTES):
                found = model.value.search(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                for i, (n, spans, items) in enumerate(zip(*found)):
                    if known:
                        spans = spans + [(x["s"], x["e"]) for x in known[a + i]["spans"]]
                        items = items | set(known[a + i]["items"])
                    rows.append({"n_words": int(n), "spans": [{"s": s, "e": e} for s, e in union(spans)], "items": sorted(items)})
            n = batch.num_columns if before is None else before
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(rows, kind)], names=[*batch.schema.names[:n], into])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark window occurs, columns unchanged."""
    into = unused(docs, "__benchmark")
    out = find_benchmark(docs, benchmark, into=into, **options)
    return out.where(F.size(f"{into}.spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: what was found in it."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """For tests: every window against every position."""
    lists = [(i if i is None else str(i), words_of((t or "").encode())) for i, t in items if t is not None]
    out = {}
    for doc, text in docs:
        words, hit, found = words_of((text or "").encode()), set(), set()
        for item, own in lists:
            m = min(window, len(own))
            for i in range(len(own) - m + 1 if m else 0):
                for j in range(len(words) - m + 1):
                    if words[j : j + m] == own[i : i + m]:
                        hit.update(range(j, j + m))
                        found |= {item} - {None}
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out
