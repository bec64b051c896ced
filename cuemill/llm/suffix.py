"""Exact removal of repeated byte strings with longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it occurs elsewhere.
A suffix array of a whole corpus would have to live on one machine, so suffixes
are first dealt into *buckets* that can be ordered apart:

1. every string of ``length`` bytes is represented by its smallest ``k``-gram
   (by hash): equal strings have equal anchors at equal places, so each repeat
   is inside one bucket of equal anchors.  About one position in 70 is an
   anchor; a row of it has hashes of the anchor and of its context, the bytes
   that any string with this anchor can reach, and no text;
2. anchors that occur once drop out.  Occurrences of one context (by a digest of
   128 bits) are one entry: all of them are repeats of each other, whatever else
   the bucket holds;
3. where an anchor has different contexts their bytes are fetched and ordered.
   The suffixes at the anchors are sorted; the order of those that start one byte
   earlier follows by a stable sort on that byte alone.  Neighbours are compared
   byte by byte; in a run of neighbours that share ``length`` bytes (LCP) each
   entry but the first in the text has its previous or next smaller position
   inside the run, so its longest previous factor reaches ``length``: it is a
   later copy, and the entry that it comes from is its source.

A bucket of more than ``BUCKET`` contexts is split, with the same result: the
strings that start at most half as far before the anchor as possible share more
bytes behind it, the others more bytes before it, so each half is dealt again by
what its strings share, down to buckets of one string, whose members are counted
by their bytes with partial sums.  No group is gathered beyond ``BUCKET``.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, utf8

LENGTH, GRAM = 200, 64
SLICE_BYTES = 1 << 20
BUCKET = 20_000  #: contexts that are ordered together
BATCH = 4096  # contexts ordered at once, in whole buckets

_rng = np.random.default_rng(7)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 40, 1 << 61)) * 8 + 5
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base % (1 << 64), np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return op(a[: len(a) - rest], a[rest:]) if rest else a


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(document, position, anchor hash, two context hashes) of the anchors in
    ``data``, documents at ``off``; positions count from the document's begin."""
    n = len(data)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=total[1:])
    h = _mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    width = length - gram + 1
    low = _sliding(h, width, np.minimum)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    low[np.arange(n - length + 1) + length > off[1:][doc[: n - length + 1]]] = 0  # strings do not leave their document
    pad = np.zeros(width - 1, np.uint64)
    at = np.nonzero(h == _sliding(np.concatenate((pad, low, pad)), width, np.maximum))[0]
    doc = doc[at]
    lo, hi = np.maximum(off[doc], at - (length - gram)), np.minimum(off[doc + 1], at + length)
    shape = ((at - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    context = _mix((total[hi] - total[lo]) * down[lo] ^ _mix(shape + np.uint64(1)))
    np.cumsum(_OTHER[data] * up[:n], out=total[1:])
    proof = _mix((total[hi] - total[lo]) * down[lo] ^ _mix(shape + np.uint64(2)))
    return doc, at - off[doc], h[at].view(np.int64), context.view(np.int64), proof.view(np.int64)


def pieces(size: int, limit: int, length: int):
    """A long document in pieces (begin, end, first, last): the anchors from
    ``first`` to before ``last`` are those of the piece."""
    for first in range(0, size, limit):
        last = min(size, first + limit)
        yield max(0, first - 2 * length), min(size, last + length), first, last


def _anchor_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(2))
            head = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << 32
            for a, b in slices(off, SLICE_BYTES):
                data = raw[off[a] : off[b]]
                if len(data) <= 2 * SLICE_BYTES:
                    parts = [(data, off[a : b + 1] - off[a], 0, 0, len(data))]
                else:
                    parts = [(data[s:e], np.array([0, e - s]), s, first, last) for s, e, first, last in pieces(len(data), SLICE_BYTES, length)]
                for part, own, base, first, last in parts:
                    doc, pos, anchor, context, proof = anchors(part, own, length, gram)
                    if base or last < len(data):
                        pos = pos + base
                        keep = (pos >= first) & (pos < last)
                        doc, pos, anchor, context, proof = doc[keep], pos[keep], anchor[keep], context[keep], proof[keep]
                    rows = pa.array(doc + a)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), pa.array(proof), batch.column(0).take(rows), pa.array(head[doc + a] | pos)], names=["anchor", "context", "proof", "id", "loc"])

    return run


def _contexts(length: int, gram: int):
    """Of a document and its wanted anchors: the context bytes of each."""

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            wants = batch.column(2)
            values, starts = wants.flatten(), np.concatenate(([0], np.cumsum(wants.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            loc = values.field("loc").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), np.diff(starts))
            pos = (loc & 0xFFFFFFFF) + off[row]
            lo, hi = np.maximum(off[row], pos - (length - gram)), np.minimum(off[row + 1], pos + length)
            data = memoryview(raw)
            for s in range(0, len(row), 20_000):
                e = min(len(row), s + 20_000)
                text = [bytes(data[x:y]) for x, y in zip(lo[s:e].tolist(), hi[s:e].tolist())]
                v = values.slice(s, e - s)
                yield pa.RecordBatch.from_arrays(
                    [v.field("anchor"), batch.column(0).take(pa.array(row[s:e])), v.field("loc"), v.field("single"), v.field("hot"), pa.array((pos - lo)[s:e].astype(np.int32)), pa.array(text, pa.binary())],
                    names=["bucket", "id", "loc", "single", "hot", "left", "bytes"],
                )

    return run


def later_copies(place: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in suffix order, ``place`` being their order in the text and
    ``full[i]`` whether entries i and i+1 share the whole length: which have a
    longest previous factor of that length, and which are the source of one.
    Inside a run of full neighbours the previous or next smaller position exists
    for all but the entry of the smallest."""
    starts = np.nonzero(np.concatenate(([True], ~full)))[0]
    run = np.cumsum(np.concatenate(([False], ~full)))
    later = place > np.minimum.reduceat(place, starts)[run]
    return later, ~later & (np.bincount(run)[run] > 1)


def _compare(length: int, gram: int, keep_first: bool):
    reach = length - gram

    def judge(bucket, ids, loc, single, left, lo, hi, texts):
        m = np.zeros((len(texts), length + reach), np.uint8)
        sizes = np.array([len(t) for t in texts])
        for i, t in enumerate(texts):
            s = reach - left[i]
            m[i, s : s + len(t)] = np.frombuffer(t, np.uint8)
        right = sizes - left
        group = np.cumsum(np.concatenate(([False], bucket[1:] != bucket[:-1])))
        group = group.astype(np.uint16 if group[-1] < 1 << 16 else np.uint32)
        order = np.argsort(np.ascontiguousarray(m[:, reach:]).view(f"S{length}").ravel(), kind="stable")
        least, most = np.full(len(texts), -1), np.full(len(texts), -1)
        for r in range(reach + 1):
            begin, end = reach - r, reach - r + length - 1
            if r:  # the suffixes one byte earlier, in order
                order = order[np.argsort(m[order, begin], kind="stable")]
            order = order[np.argsort(group[order], kind="stable")]
            rows = order[(r <= left[order]) & (right[order] + r >= length) & (lo[order] <= r) & (r <= hi[order])]
            if len(rows) < 2:
                continue
            a, b = rows[1:], rows[:-1]
            full = (group[a] == group[b]) & (m[a, end] == m[b, end]) & (m[a, begin] == m[b, begin])
            likely = np.nonzero(full)[0]
            full[likely] = (m[a[likely], begin : end + 1] == m[b[likely], begin : end + 1]).all(axis=1)
            later, source = later_copies(rows, full)  # rows come in text order
            hit = rows[later] if keep_first else rows[later | source]
            least[hit] = np.where(least[hit] < 0, r, least[hit])
            most[hit] = r
        hit = (most >= 0) & single
        pos = loc[hit] & 0xFFFFFFFF
        return ids.filter(pa.array(hit)), loc[hit] >> 32, pos - most[hit], pos - least[hit] + length

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) < BATCH:
                continue
            own = held.column("bucket").to_numpy()
            cut = int(np.searchsorted(own, own[-1]))  # the last bucket may go on
            if cut:
                yield out(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield out(held)

    def out(t):
        t = t.combine_chunks()
        number = lambda c: t[c].to_numpy().astype(np.int64)
        ids, th, s, e = judge(number("bucket"), t["id"], number("loc"), t["single"].to_numpy(), number("left"), number("lo"), number("hi"), t["bytes"].to_pylist())
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        return pa.RecordBatch.from_arrays([ids if isinstance(ids, pa.Array) else ids.chunk(0), pa.array(th.astype(np.int32)), pa.array((s << 32) | e)], names=["id", "th", "span"])

    return run


def _halves(length: int):
    """The rows of large buckets, dealt again: once by what the strings share that
    start ``lo`` to ``mid`` bytes before the anchor, once for the others."""

    def run(batches):
        for batch in batches:
            for s in range(0, len(batch), 4096):
                part = batch.slice(s, 4096)
                left, lo, hi = (part.column(k).to_numpy().astype(np.int64) for k in (4, 6, 7))
                texts = part.column(5).to_pylist()
                right = np.array([len(t) for t in texts]) - left
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    rows = np.nonzero((a <= b) & (np.maximum(a, length - right) <= np.minimum(b, left)))[0]
                    keys = [xxhash.xxh64_intdigest(texts[i][x:y], z) for i, x, y, z in zip(rows.tolist(), (left - a)[rows].tolist(), (left + length - b)[rows].tolist(), (a * length + b)[rows].tolist())]
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(keys, np.uint64).view(np.int64)), *(part.column(k).take(take) for k in range(1, 6)), pa.array(a[rows].astype(np.int32)), pa.array(b[rows].astype(np.int32))],
                        names=["bucket", "id", "loc", "single", "left", "bytes", "lo", "hi"],
                    )

    return run


def _split(rows: DataFrame, length: int, most: int, keep_first: bool, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets above ``most`` as rows of smaller ones, and the spans
    (id, th, span) of those that are down to one string."""
    columns, done, found = rows.columns, [], []
    rows = staged(rows, "large")
    while True:
        rows = staged(rows.mapInArrow(_halves(length), schema), "halves")
        sizes = staged(rows.groupBy("bucket", "lo", "hi").agg(F.count("*").alias("n")).where("n > 1"), "halves")
        rows = rows.join(sizes, ["bucket", "lo", "hi"])
        one = rows.where("lo = hi")
        large = (F.col("lo") < F.col("hi")) & (F.col("n") > most)
        done.append(rows.where((F.col("lo") < F.col("hi")) & (F.col("n") <= most)).select(columns))
        found.append(_counted(one, length, keep_first))
        if sizes.where(large).isEmpty():
            return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, found)
        rows = staged(rows.where(large).select(columns), "large")


def _counted(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(id, th, span) of the repeats among rows of one string a bucket."""
    th, pos = F.shiftright("loc", 32).cast("int"), F.col("loc").bitwiseAND(F.lit(0xFFFFFFFF))
    own = rows.withColumn("string", F.expr(f"substring(bytes, left - lo + 1, {length})")).withColumn("order", F.struct("id", pos.alias("pos"), "loc"))
    often = own.groupBy("lo", "string").agg(F.count("*").alias("m"), F.min("order").alias("first")).where("m > 1")
    found = own.join(often, ["lo", "string"]).where(F.col("single") & (F.col("order") != F.col("first") if keep_first else F.lit(True)))
    return found.select("id", th.alias("th"), F.shiftleft(pos - F.col("lo"), 32).bitwiseOR(pos - F.col("lo") + length).alias("span"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, id, th, text) and the repeated spans (id, th,
    span), a span being start << 32 | end.  ``th`` is a hash of the text that keeps
    rows with equal ids apart; rows without an id get one from a longer hash of
    their text; rows that are equal repeat each other."""
    kind = docs.schema[id_col].dataType.simpleString()
    kind = "bigint" if kind in ("tinyint", "smallint", "int") else kind
    column = F.col(f"`{text}`")
    uid = F.coalesce(F.col(f"`{id_col}`").cast(kind), F.xxhash64(column).cast(kind))
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), uid.alias("id"), F.hash(column).alias("th"), F.coalesce(column, F.lit("")).alias("text"))
    long = own.where(F.octet_length("text") >= length)
    rows = staged(long.select("id", "th", "text").mapInArrow(_anchor_rows(length, gram), f"anchor long, context long, proof long, id {kind}, loc long"), "anchors")
    # staged, so that the joins below see plain inputs, whose hot keys Spark can split
    ends = [f(c).alias(f"{c}{k}") for c in ("context", "proof") for k, f in enumerate((F.min, F.max))]
    seen = staged(rows.groupBy("anchor").agg(F.count("*").alias("n"), *ends).where("n > 1"), "seen")
    one = (F.col("context0") == F.col("context1")) & (F.col("proof0") == F.col("proof1"))
    same = F.lit(False) if keep_first else one
    repeated = staged(rows.join(seen.select("anchor", same.alias("same"), (~one & (F.col("n") > bucket)).alias("hot")), "anchor"), "repeated")
    th, pos = F.shiftright("loc", 32).cast("int"), F.col("loc").bitwiseAND(F.lit(0xFFFFFFFF))

    def whole(df):  # all strings of the context; what it has beyond the document's end is cut later
        start = F.greatest(pos - (length - gram), F.lit(0))
        return df.select("id", th.alias("th"), (F.shiftleft(start, 32).bitwiseOR(pos + length)).alias("span"))

    mixed = repeated.where(~F.col("same"))
    order = F.struct("id", pos.alias("pos"), "loc") if keep_first else F.xxhash64("id", "loc")
    mixed = mixed.withColumn("order", order)
    classes = mixed.groupBy("anchor", "context", "proof").agg(F.count("*").alias("m"), F.min("order").alias("first")).where("m > 1")
    mixed = mixed.join(staged(classes, "classes"), ["anchor", "context", "proof"], "left")
    is_first = F.col("m").isNull() | (F.col("order") == F.col("first"))
    full = mixed.where(F.col("m").isNotNull() & (~is_first if keep_first else F.lit(True)))
    single = F.lit(True) if keep_first else F.col("m").isNull()
    wanted = mixed.where(is_first).select("id", th.alias("th"), F.struct("anchor", "loc", single.alias("single"), "hot").alias("want"))
    wanted = wanted.groupBy("id", "th").agg(F.collect_list("want").alias("wants"))
    asked = own.join(wanted.withColumnRenamed("id", "w").withColumnRenamed("th", "v"), (F.col("id") == F.col("w")) & (F.col("th") == F.col("v"))).select("id", "text", "wants")
    schema = f"bucket long, id {kind}, loc long, single boolean, left int, bytes binary, lo int, hi int"
    contexts = asked.mapInArrow(_contexts(length, gram), schema.replace("left int", "hot boolean, left int").replace(", lo int, hi int", ""))
    whole_range = lambda df: df.drop("hot").withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - gram))
    spans = whole(repeated.where("same")).unionByName(whole(full))
    if seen.where(~one & (F.col("n") > bucket)).isEmpty():
        small = whole_range(contexts)
    else:
        contexts = staged(contexts, "contexts")
        parts, found = _split(whole_range(contexts.where("hot")), length, bucket, keep_first, schema)
        small = whole_range(contexts.where("not hot")).unionByName(parts)
        spans = spans.unionByName(found)
    dealt = small.repartition("bucket").sortWithinPartitions("bucket", *(["id", pos] if keep_first else []))
    return own, spans.unionByName(dealt.mapInArrow(_compare(length, gram, keep_first), f"id {kind}, th int, span long"))


def merged(spans: np.ndarray, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in np.sort(spans).tolist():
        s, e = x >> 32, min(x & 0xFFFFFFFF, size)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            sizes, removed, count, digest, left = [], [], [], [], []
            for i in range(len(batch)):
                data = raw[off[i] : off[i + 1]].tobytes()
                spans = merged(values[starts[i] : starts[i + 1]], len(data))
                ends = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                sizes.append(len(data))
                removed.append(len(data) - len(kept))
                count.append(len(spans))
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    left.append(kept.decode("utf-8", "ignore"))
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(left, pa.string())] if with_text else []), names=names + ["kept_text"] * with_text)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = True, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of every
    row after the repeats are cut out; ``kept_text`` drops bytes of characters
    that were cut apart.  ``keep_first`` keeps the first copy (by id, then place)
    of each string instead of none; rows without an id are ordered by a hash of
    their text.  Null is the empty text; texts of fewer than ``length`` bytes stay
    whole; very long texts are read in overlapping pieces; equal rows repeat each
    other; other columns of ``docs`` are ignored; an empty table gives an empty
    result."""
    own, spans = repeats(docs, id_col, text, **options)
    kind = own.schema["doc_id"].dataType.simpleString()
    per = spans.groupBy(F.col("id").alias("w"), F.col("th").alias("v")).agg(F.collect_list("span").alias("spans"))
    joined = own.join(per, (F.col("id") == F.col("w")) & (F.col("th") == F.col("v")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut(with_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)


def report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, with_text=False)


def brute_force(docs: list[tuple], length: int = LENGTH) -> dict:
    """For tests: every string of every text in one dictionary."""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen: dict[bytes, int] = {}
    for _, t in data:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = {}
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out
