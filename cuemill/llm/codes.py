"""Vector compression by product codes whose codebooks Hamerly's Lloyd trains.

Vectors become integers, ``floor(scale * x)``, and are cut into equal parts, each
with a codebook of its own.  A round assigns every part to its nearest entry and
moves every entry to the floored mean of its parts.  Between rounds each part
keeps two numbers: an upper bound of the distance to its entry and a lower bound
of that to the second nearest one.  When entries move, both bounds move with them;
a part whose upper bound stays strictly below the lower one (or below half the way
to the entry nearest to its own) keeps its entry unseen.  Where that fails, the
upper bound is made exact, and only if it fails again are all entries compared, in
integers, the lower index winning ties.  Bounds are rounded outwards, so the
result is that of the plain algorithm.

The state (integers, entries, bounds) is a table in the shared folder that each
round reads and writes anew; the one before it goes.  What the driver holds is the
codebooks and their sums, ``entries`` times the vectors' length.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import removed, stage

NONE = 255  #: the entry of a part that has none yet; so there are at most 255 entries


@dataclass
class Codebooks:
    """The entries, an array (part, entry, place), and how many full scans each
    pass over the parts made."""

    entries: np.ndarray
    scale: float
    scans: list[int] = field(default_factory=list)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of codes stand for: the middles of their cells."""
        parts = self.entries.shape[0]
        return (np.concatenate([self.entries[p][codes[:, p]] for p in range(parts)], axis=1) + 0.5) / self.scale


def limit(length: int) -> int:
    """The largest size of an integer component: sums of squared differences stay
    below 2**63, so a component beyond it is held there."""
    return int(((2**63 - 1) / max(1, length)) ** 0.5 / 2) - 1


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    most = limit(values.shape[1])
    return np.clip(np.floor(values.astype(float) * scale), -most, most).astype(np.int64)


def _up(squares: np.ndarray) -> np.ndarray:
    """Roots that are surely not too small, as single floats."""
    return np.nextafter((np.sqrt(squares.astype(float)) * (1 + 1e-15)).astype(np.float32), np.float32(np.inf))


def _down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((np.sqrt(squares.astype(float)) * (1 - 1e-15)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


@dataclass
class Moves:
    """What a pass must know of the entries: where they are, how far each went
    since the last pass, the farthest way of any other, and half the way to the
    next."""

    entries: np.ndarray
    own: np.ndarray
    other: np.ndarray
    half: np.ndarray

    @staticmethod
    def between(entries: np.ndarray, before: np.ndarray) -> Moves:
        parts, k, _ = entries.shape
        own = _up(((entries - before) ** 2).sum(2))
        other = np.zeros_like(own)
        half = np.full((parts, k), np.inf, np.float32)
        for j in range(k):
            rest = [i for i in range(k) if i != j]
            if rest:
                other[:, j] = own[:, rest].max(1)
                apart = ((entries[:, rest] - entries[:, j : j + 1]) ** 2).sum(2).min(1)
                half[:, j] = _down(apart) / 2
        return Moves(entries, own, other, half)


def assigned(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: Moves) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New entries and bounds of rows ``x`` (row, part, place), and the number of
    full scans."""
    parts, k, _ = moves.entries.shape
    at, upper, lower, scans = at.copy(), upper.copy(), lower.copy(), 0
    for p in range(parts):
        a, own, entries = at[:, p], x[:, p], moves.entries[p]
        fresh = a == NONE
        a0 = np.where(fresh, 0, a)
        up = np.nextafter(upper[:, p] + moves.own[p][a0], np.float32(np.inf))
        low = np.nextafter(lower[:, p] - moves.other[p][a0], np.float32(-np.inf))
        bound = np.maximum(low, moves.half[p][a0])
        open_ = np.flatnonzero(fresh | ~(up < bound))
        if len(open_):
            up[open_] = _up(((own[open_] - entries[a0[open_]]) ** 2).sum(1))
            scan = open_[fresh[open_] | ~(up[open_] < bound[open_])]
            if len(scan):
                squares = ((own[scan][:, None, :] - entries[None]) ** 2).sum(2)
                best = squares.argmin(1)  # the first of equal ones
                a0[scan] = best
                up[scan] = _up(squares[np.arange(len(scan)), best])
                squares[np.arange(len(scan)), best] = np.iinfo(np.int64).max
                low[scan] = _down(squares.min(1)) if k > 1 else np.float32(np.inf)
                scans += len(scan)
        at[:, p], upper[:, p], lower[:, p] = a0, up, low
    return at, upper, lower, scans


STATE = "x binary, at binary, upper binary, lower binary, error long, sums array<long>"


def _pass(moves, shape: tuple[int, int, int], first: bool, scale: float):
    """One pass over the parts.  Each task adds a last row with what its parts add
    to (and take from) the sums and counts of the entries, and its full scans."""
    parts, k, width = shape

    def run(batches):
        sums, counts, scans = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64), 0
        kind = None
        for batch in batches:
            kind, n = batch.schema.field(0).type, len(batch)
            if not n:
                continue
            if first:
                x = integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), scale).reshape(n, parts, width)
                old = np.full((n, parts), NONE, np.uint8)
                upper, lower = np.zeros((2, n, parts), np.float32)
            else:
                x, old, upper, lower = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(s) for c, t, s in ((1, np.int32, (n, parts, width)), (2, np.uint8, (n, parts)), (3, np.float32, (n, parts)), (4, np.float32, (n, parts))))
                x = x.astype(np.int64)
            at, upper, lower, more = assigned(x, old, upper, lower, moves.value)
            scans += more
            for p in range(parts):
                moved = np.flatnonzero(at[:, p] != old[:, p])
                np.add.at(sums[p], at[moved, p], x[moved, p])
                np.add.at(counts[p], at[moved, p], 1)
                if not first:
                    np.subtract.at(sums[p], old[moved, p], x[moved, p])
                    np.subtract.at(counts[p], old[moved, p], 1)
            error = sum(((x[:, p] - moves.value.entries[p][at[:, p]]) ** 2).sum(1) for p in range(parts))
            rows = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows(x.astype(np.int32)), rows(at), rows(upper), rows(lower), pa.array(error), none], names=["d", "x", "at", "upper", "lower", "error", "sums"])
        if kind is not None:
            total = np.concatenate((sums.ravel(), counts.ravel(), [scans])).tolist()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, pa.binary())] * 4, pa.nulls(1, pa.int64()), pa.array([total], pa.list_(pa.int64()))], names=["d", "x", "at", "upper", "lower", "error", "sums"])

    return run


def compressed(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096) -> tuple[DataFrame, Codebooks]:
    """(d, code, error) of every row whose vector is whole, and the codebooks:
    ``d`` holds the row's other columns as a struct, ``code`` one byte a part,
    ``error`` the sum of squared integer distances.

    Codebooks begin as the parts of the ``entries`` rows of smallest id; nulls come
    last, the smaller vector first among equal ids; fewer rows make fewer entries.
    Vectors that are null or hold a null or a non-finite number are left out.  The
    length of vectors is the commonest one (the longer of two), which ``parts`` must
    divide; a row of another length stays, with a null code and error.  Components
    beyond ``limit`` are held there.  Repeated rows are rows of their own; an empty
    table stays empty; other columns may have any name.
    """
    if not 0 < entries < NONE:
        raise ValueError(f"between 1 and {NONE - 1} entries are possible")
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() != vector.lower()]).alias("d"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    whole = own.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    common = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = common[0] if common else 0
    if length % parts:
        raise ValueError(f"vectors of {length} numbers do not have {parts} equal parts")
    of = whole.where(F.size("v") == length)
    first = of.select(F.col("d")[id_col].alias("id"), "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = integers(np.array([r.v for r in first], float).reshape(len(first), length), scale)
    k, width = len(first), length // parts
    books = Codebooks(np.stack([start[:, p * width : (p + 1) * width] for p in range(parts)]) if k else np.zeros((parts, 0, width), np.int64), scale)
    schema = T.StructType([T.StructField("d", own.schema["d"].dataType), *T._parse_datatype_string(STATE).fields])
    if not k:
        return own.sparkSession.createDataFrame([], schema).select("d", F.col("at").alias("code"), "error"), books

    state, before, old = of.select("d", "v"), books.entries, ""
    sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
    for step in range(rounds + 1):
        moves = own.sparkSession.sparkContext.broadcast(Moves.between(books.entries, before))
        state, path = stage(state.mapInArrow(_pass(moves, (parts, k, width), step == 0, scale), schema), "codes")
        if step:
            removed(own.sparkSession, old)
        old = path
        rows = state.where("sums is not null").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
        total = np.zeros(parts * k * (width + 1) + 1, np.int64)
        total[[r.i for r in rows]] = [r.s for r in rows]
        sums += total[: parts * k * width].reshape(sums.shape)
        counts += total[parts * k * width : -1].reshape(counts.shape)
        books.scans.append(int(total[-1]))
        state = state.where("sums is null").select("d", "x", "at", "upper", "lower", "error")
        moves.unpersist()
        if step < rounds:
            before = books.entries
            books.entries = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], before)
    coded = state.select("d", F.col("at").alias("code"), "error")
    rest = whole.where(F.size("v") != length).select("d", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(rest), books


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes as two hex
    digits a part; the error of a label is the sum over its rows, the null label
    being one."""
    out, books = compressed(vectors.select("vec_id", "embedding", "label"))
    own = out.select("d.vec_id", "d.label", F.lower(F.hex("code")).alias("code"), "error")
    # sums that no longer fit are held at the greatest number
    most = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = own.groupBy(F.col("label").alias("l")).agg(most.alias("label_error"))
    return own.join(sums, F.col("label").eqNullSafe(F.col("l")), "left").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def brute_force(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096) -> tuple[dict, str]:
    """For tests: the plain algorithm in whole numbers; (id, vector) to (code, error)."""
    from math import floor

    kept = [(i, [floor(scale * x) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // parts
    books = [[v[p * width : (p + 1) * width] for _, v in sorted(kept)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(p, v):
        own = v[p * width : (p + 1) * width]
        return min((far(own, e), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of: dict = {}
            for _, v in kept:
                of.setdefault(nearest(p, v)[1], []).append(v[p * width : (p + 1) * width])
            books[p] = [[sum(c) // len(of[j]) for c in zip(*of[j])] if j in of else e for j, e in enumerate(books[p])]
    out = {i: ("".join(f"{nearest(p, v)[1]:02x}" for p in range(parts)), sum(nearest(p, v)[0] for p in range(parts))) for i, v in kept}
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
