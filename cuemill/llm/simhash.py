"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint has 8 bytes.  Two that differ in at most 3 bits agree in at least
5 byte positions, the guaranteed minimum of shared positional bytes.  Posting
lists of single bytes would hold 1/256 of the corpus each, so a posting is a
*triple* of positional bytes: the positions are halved into {0..3} and {4..7}
and all 8 triples inside a half are indexed.  Of any 5 equal positions at least
3 lie in one half, so no pair that reaches the minimum is missed.  Pairs that
meet in a list are tallied (equal bytes); those with fewer than the guaranteed
minimum of 8 - distance are dropped, and the rest is verified bit by bit.

Work stays bounded: equal fingerprints are one entry; a list yields a spanning
forest of its links, never all its pairs; a list above ``LIST`` entries is
dealt anew by pairs of further bytes (of the 5 other positions 2 agree as well)
and, if still too long, cut into blocks that meet pair by pair; both ways find
the same links, so the result does not depend on ``LIST``.  Components come
from alternating star contraction over tables, nothing goes to the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, unused, utf8

#: A-Z become a-z.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SLICE_BYTES = 1 << 20
LIST = 16_384
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def fingerprints(raw: np.ndarray, off: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The 64-bit fingerprints of the documents in one slice of bytes."""
    out = np.zeros(len(off) - 1, np.uint64)
    data = raw.tobytes().translate(LOWER)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(out), np.int64)
    for d, (a, b) in enumerate(zip(off[:-1], off[1:])):
        words = data[a:b].split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            hashes.append(digest(joined, seed))
            counts[d] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begin = [0, *ends[: len(words) - width].tolist()]
        hashes += [digest(joined[i:j], seed) for i, j in zip(begin, (ends[width - 1 :] - 1).tolist())]
        counts[d] = len(begin)
    full = counts > 0
    if full.any():
        h = np.array(hashes, np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        set_ = (2 * ones > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            got = [fingerprints(raw[off[a] : off[b]], off[a : b + 1] - off[a], width, seed) for a, b in slices(off, SLICE_BYTES)]
            fp = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _byte(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _postings(distinct: DataFrame) -> DataFrame:
    """(list, fp) for each of the 8 triples of positional bytes."""

    def key(k, triple):
        value = F.lit(k)
        for p in triple:
            value = value * 256 + _byte(p)
        return value.cast("long")

    return distinct.select(F.explode(F.array(*[key(k, t) for k, t in enumerate(TRIPLES)])).alias("list"), "fp")


def _finer(postings: DataFrame) -> DataFrame:
    """The entries of lists that are too long, by 2 more of the 5 other bytes."""

    def key(triple):
        rest = [p for p in range(8) if p not in triple]
        return F.array(*[((F.lit(k) * 256 + _byte(a)) * 256 + _byte(b)) for k, (a, b) in enumerate(combinations(rest, 2))])

    which = F.shiftright("list", 24)
    choice = F.when(which == 0, key(TRIPLES[0]))
    for k in range(1, 8):
        choice = choice.when(which == k, key(TRIPLES[k]))
    # 27 bits of the list, 20 of the pair of bytes, and one that marks the finer kind
    finer = postings.select("list", "fp", F.explode(choice).alias("finer"))
    return finer.select((F.col("list") * F.lit(1 << 20) + F.col("finer") + F.lit(1 << 48)).alias("list"), "fp")


def tally(x: np.ndarray) -> np.ndarray:
    """How many of the 8 positional bytes are equal, by the XOR of two fingerprints."""
    x = x | (x >> np.uint64(4))
    x = x | (x >> np.uint64(2))
    x = (x | (x >> np.uint64(1))) & np.uint64(0x0101010101010101)
    return 8 - np.bitwise_count(x).astype(np.int64)


def links_of(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fp, smaller root) inside each run of equal ``keys``."""
    n = len(keys)
    least = max(0, 8 - distance)
    parent = np.arange(n)
    alive = np.arange(n - 1)[keys[1:] == keys[:-1]] if n > 1 else np.zeros(0, np.int64)
    step = 1
    while len(alive):
        x = fps[alive] ^ fps[alive + step]
        kept = tally(x) >= least  # the count filter, on every pair that shares a list
        near = alive[kept]
        near = near[np.bitwise_count(x[kept]) <= distance]  # verification
        a, b = parent[near], parent[near + step]
        fresh = a != b
        if fresh.any():
            for i, j in zip(a[fresh].tolist(), b[fresh].tolist()):
                while parent[i] != i:
                    i = parent[i]
                while parent[j] != j:
                    j = parent[j]
                if i != j:
                    parent[max(i, j)] = min(i, j)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        step += 1
        alive = alive[alive + step < n]
        alive = alive[keys[alive + step] == keys[alive]]
    moved = parent != np.arange(n)
    return fps[moved], fps[parent[moved]]


def _link(distance: int):
    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            a, b = links_of(k, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(keys) >= 65_536:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
                yield out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield out(keys, fps)

    return run


def _long(lists: DataFrame, most: int) -> DataFrame:
    return lists.groupBy("list").agg(F.count("*").alias("entries")).where(F.col("entries") > most)


def fingerprint_links(distinct: DataFrame, distance: int = 3, most: int = LIST) -> DataFrame:
    """Links (a, b) that connect all fingerprints at ``distance`` or fewer bits."""
    lists = _postings(distinct)
    long = _long(lists, most)
    if not long.isEmpty():
        again = _finer(lists.join(long.select("list"), "list", "left_semi"))
        longer = _long(again, most)
        # what is still too long: blocks of at most about ``most`` entries, every two of which meet
        cells = (
            again.join(longer, "list")
            .withColumn("n", F.ceil(F.col("entries") * 2 / most))
            .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            .select(F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")).alias("list"), "fp")
        )
        lists = lists.join(long.select("list"), "list", "left_anti").unionByName(again.join(longer.select("list"), "list", "left_anti")).unionByName(cells)
    dealt = lists.repartition("list").sortWithinPartitions("list")
    return dealt.mapInArrow(_link(distance), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every vertex that has a smaller one in its component, by
    alternating large and small stars until the links stay as they are."""
    flat = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, state = staged(flat(links), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = flat(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(flat(small.unionByName(least.select("a", F.col("m").alias("b")))), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        state = tuple(now)


def _roots(own: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``own``."""
    distinct = own.select("fp").distinct()
    roots = components(fingerprint_links(distinct, distance))
    return distinct.join(roots, distinct.fp == roots.v, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id
    that links of at most ``distance`` differing bits reach.

    Documents without words (also null texts) have fingerprint 0 and link like
    any other; rows with equal ids and null ids are documents of their own (a
    component of null ids only has a null component_id).  A very long text is
    hashed whole, shingle by shingle, in its own task.  Ties in a bit (set in
    exactly half of the hashes) count as 0.  Other columns of ``docs`` are
    ignored.  An empty table gives an empty result.
    """
    own = staged(with_fingerprint(docs, id_col, text, width, seed), "fingerprints")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = _roots(own, distance).join(least, "fp")
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    known = staged(member.join(smallest, "root").select("fp", "component_id"), "components")
    return own.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """One document of each group, columns unchanged: that of the smallest id,
    rows without an id last, and of rows of one id that of the smallest hash over
    all columns, so reruns keep the same rows.  Null and empty texts are one
    group, rows that are equal in every column are one document, and an empty
    table stays empty."""
    x = unused(docs, "__one")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), row.alias("row")).alias("key"), F.col(f"`{text}`").alias("text"))
    own = staged(with_fingerprint(rows, "key", "text", width, seed).withColumnRenamed("doc_id", "key"), "fingerprints")
    groups = own.groupBy("fp").agg(F.min("key").alias("key")).join(_roots(own, distance), "fp")
    first = groups.groupBy("root").agg(F.min("key").alias("key")).select("key")
    times = own.join(first, "key").groupBy("key").agg(F.count("*").alias("times"))
    keys = staged(times.select(F.col("key.id").alias(f"{x}i"), F.col("key.row").alias(f"{x}r"), "times"), "kept")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(f"{x}i")) & (row == F.col(f"{x}r"))
    kept = docs.join(keys.where("times = 1"), same, "left_semi")
    again = keys.where("times > 1")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, same, "left_semi").dropDuplicates())


def report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
