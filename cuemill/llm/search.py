"""Ranked lexical search by branch and bound over max trees of document ranges.

Queries are read in blocks of bounded size.  For a block, the documents' postings
of its terms are staged once, row by row, as they come; document counts of the
terms, and with them the weights, come from that table.  Then every task cuts its
rows into *shards* of documents in order of id.  In a shard each term has a tree:
its leaves are what single documents get for the term, and every node above holds
the greatest value of ``FAN`` nodes below it, nothing where the term is absent.

For a query, the bound of a document range is the weighted sum of its terms' nodes
there.  The search opens ranges in the order of their bounds, best first, until no
open range can hold a better document than the last of the best ``k``: one of a
smaller bound cannot, nor can one of an equal bound whose documents all have
greater ids; any other range of equal bound is opened, as it may hold a tie that
comes first.  The best ``k`` of the shards before, in the same task, bound the next
shard from its root on.  So a task hands on at most ``k`` rows a query, and a
ranking over all tasks gives the result.

No term's postings meet in one task, however frequent it is.
"""

from __future__ import annotations

import heapq
from itertools import count
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, slices, stage, utf8
from .decontam import words_of

#: Query bytes of one block; a larger set of queries takes several passes, so that
#: what is broadcast stays bounded.
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 4 << 20
FAN = 16  #: nodes under a node
SHARD = FAN**3  #: documents of a shard
POSTINGS = 2_000_000  #: postings from which on a shard is closed
LAST = np.iinfo(np.int64).max  #: stands for a null id, which comes last


class Queries:
    """The terms of a block of queries as numbers."""

    def __init__(self, items: list[tuple]):
        self.number: dict[bytes, int] = {}
        own: dict = {}
        for item, text in items:
            own.setdefault(item, set()).update(self.number.setdefault(w, len(self.number)) for w in words_of(text or b""))
        self.items = list(own)
        self.terms = [np.array(sorted(x), np.int64) for x in own.values()]


def postings(docs: DataFrame, queries, id_col: str, text: str) -> DataFrame:
    """(doc_id, n, terms, times) of every row with a term: how many terms the text
    has, and which of the queries' how often."""

    def run(batches):
        number = queries.value.number
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for a, b in slices(off, SLICE_BYTES):
                data = raw[off[a] : off[b]].tobytes()
                rows = []
                for s, e in zip(off[a:b] - off[a], off[a + 1 : b + 1] - off[a]):
                    words = words_of(data[s:e])
                    at, times = np.unique(np.array([k for k in map(number.get, words) if k is not None], np.int32), return_counts=True)
                    rows.append((len(words), at.astype(np.int32).tobytes(), times.astype(np.int32).tobytes()))
                keep = pa.array([r[0] > 0 for r in rows])
                cols = [batch.column(0).slice(a, b - a), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "terms", "times"]).filter(keep)

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, terms binary, times binary")


def _ints(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, and how many each row has."""
    raw, off = utf8(column)
    return raw.view(np.int32), np.diff(off) // 4


def holders(found: DataFrame) -> DataFrame:
    """(term, df): how many documents hold each term, counted in the tasks first."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(_ints(batch.column(0))[0])
            if len(more) > len(total):
                total, more = more, total
            total[: len(more)] += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["term", "df"])

    return found.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Level:
    """One level of all terms' trees: sorted keys (term, node) and their values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, size: int):
        self.keys, self.values, self.size = keys, values, size

    def above(self) -> Level:
        size = -(-self.size // FAN)
        term, node = np.divmod(self.keys, self.size)
        keys = term * size + node // FAN
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return Level(keys[first], np.maximum.reduceat(self.values, first) if len(first) else self.values, size)

    def bounds(self, terms: np.ndarray, weights: np.ndarray, start: int, end: int) -> np.ndarray:
        """The summed values of the nodes from ``start`` to ``end``."""
        low = np.searchsorted(self.keys, terms * self.size + start)
        many = np.searchsorted(self.keys, terms * self.size + end) - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        out = np.zeros(end - start, np.int64)
        np.add.at(out, self.keys[at] % self.size - start, self.values[at] * np.repeat(weights, many))
        return out


class Shard:
    """Documents in order of id with the trees of their terms."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, many: np.ndarray, gains: np.ndarray):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        keys = terms.astype(np.int64) * len(ids) + np.repeat(place, many)
        sort = np.argsort(keys)
        self.ids = ids[order]
        self.levels = [Level(keys[sort], gains[sort], len(ids))]
        while self.levels[-1].size > 1:
            self.levels.append(self.levels[-1].above())

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """``best``, a heap of (score, minus id), takes what it must; the number
        of ranges opened is returned."""
        top, opened, turn = len(self.levels) - 1, 0, count()
        bound = int(self.levels[top].bounds(terms, weights, 0, 1)[0])
        waits = [(-bound, int(self.ids[0]), next(turn), top, 0)] if bound else []
        while waits:
            bound, least, _, level, node = heapq.heappop(waits)
            if len(best) == k and (-bound, -least) <= best[0]:
                break
            if level == 0:
                entry = (-bound, -least)
                heapq.heappush(best, entry) if len(best) < k else heapq.heapreplace(best, entry)
                continue
            opened += 1
            below = self.levels[level - 1]
            start, end = node * FAN, min(below.size, node * FAN + FAN)
            wide = FAN ** (level - 1)
            for j, x in enumerate(below.bounds(terms, weights, start, end).tolist(), start):
                if x and (len(best) < k or (x, -int(self.ids[j * wide])) > best[0]):
                    heapq.heappush(waits, (-x, int(self.ids[j * wide]), next(turn), level - 1, j))
        return opened


def _search(queries, weights, k: int):
    def run(batches):
        own, w = queries.value, weights.value
        heaps: list[list] = [[] for _ in own.items]
        held: list[tuple] = []
        used = [0, 0]

        def close():
            if held:
                shard = Shard(*(np.concatenate(x) for x in zip(*held)))
                there = np.unique(shard.levels[0].keys // shard.levels[0].size)
                for terms, best in zip(own.terms, heaps):
                    some = terms[np.isin(terms, there)]
                    shard.search(some, w[some], best, k)
                held.clear()
            used[:] = 0, 0

        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            base = batch.column(1).to_numpy(zero_copy_only=False)  # 8 * m of each document
            terms, many = _ints(batch.column(2))
            times = _ints(batch.column(3))[0].astype(np.int64)
            gains = 1_000_000_000 * times // (1000 * times + np.repeat(base, many))
            ends = np.concatenate(([0], np.cumsum(many)))
            at = 0
            while at < len(ids):
                to = min(len(ids), at + SHARD - used[0], max(at + 1, int(np.searchsorted(ends, ends[at] + POSTINGS - used[1], side="right")) - 1))
                held.append((ids[at:to], terms[ends[at] : ends[to]], many[at:to], gains[ends[at] : ends[to]]))
                used[0] += to - at
                used[1] += ends[to] - ends[at]
                at = to
                if used[0] >= SHARD or used[1] >= POSTINGS:
                    close()
        close()
        rows = [(i, s, d) for i, best in enumerate(heaps) for s, d in best]
        cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([None if r[2] == -LAST else -r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["q", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0
    of each item, equal scores by id.

    Rows of one item id are one item with the terms of all of them, a null id too;
    items without terms, or whose terms no document holds, have no rows.  Null and
    empty texts hold no term and do not count; repeated rows are documents of their
    own; a null document id comes last; a very long text costs its own task; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").cast("binary").alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        # one item is one block's
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else asked
        own = Queries([(r[0], r[1]) for r in part.collect()])
        queries = spark.sparkContext.broadcast(own)
        found, path = stage(postings(docs, queries, id_col, text), "postings")
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(max(1, len(own.number)), np.int64)
        for r in holders(found).collect():  # no more rows than the block has terms
            weights[r.term] = floor(1000 * log((2 * n_docs + 2) / (2 * r.df + 1)))
        base = F.expr(f"8L * (10L + cast(cast(90L * n as decimal(20,0)) * {n_docs}BD div {max(1, n_terms)}BD as bigint))")
        hits = found.where(F.octet_length("terms") > 0).select("doc_id", base.alias("base"), "terms", "times").mapInArrow(_search(queries, spark.sparkContext.broadcast(weights), k), "q int, doc_id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best, _ = stage(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
        removed(spark, path)
        names = spark.createDataFrame(list(enumerate(own.items)), f"q int, item_id {kind}")
        best = best.join(names, "q").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


def brute_force(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """For tests: every document against every item."""
    from collections import Counter

    lists = [(i, Counter(words_of((t or "").encode()))) for i, t in docs]
    lists = [(i, c) for i, c in lists if c]
    n, total = len(lists), sum(c.total() for _, c in lists)
    df = Counter(w for _, c in lists for w in c)
    asked: dict = {}
    for item, t in items:
        asked.setdefault(item, set()).update(words_of((t or "").encode()))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in lists:
            m = 10 + 90 * c.total() * n // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out
