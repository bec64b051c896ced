"""Product codes by bounded Lloyd rounds, against the plain algorithm."""

import random

import numpy as np
import pytest

from cuemill.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, d string, code int, error int, x string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, "d", 1, 2, "x") for i, v, lab in rows], SCHEMA)


def want(rows):
    kept = [(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return codes.brute_force(kept)


@pytest.mark.parametrize("kind", ["spread", "grid", "copies"])
def test_against_plain_lloyd(spark, kind):
    rng = random.Random(kind)
    value = {"spread": lambda: rng.gauss(0, 0.1), "grid": lambda: rng.randint(-2, 2) / 4096, "copies": lambda: rng.choice((0.0, 0.5))}[kind]
    rows = [(i, [value() for _ in range(16)], rng.choice((None, 1, 2))) for i in range(300)]
    rows += [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, None)]
    got = codes.report(rows_of(spark, rows).repartition(5)).collect()
    plain, digest = want(rows)
    assert {r.vec_id: (r.code, r.error) for r in got} == plain and {r.codebooks_sha256 for r in got} == {digest}
    by = {i: lab for i, _, lab in rows}
    for r in got:
        assert r.label_error == sum(plain[i][1] for i in plain if by[i] == by[r.vec_id])


def test_bounds_save_scans_and_codes_stand_for_vectors(spark, sf):
    own = spark.read.parquet(f"{sf}/embeddings.parquet")
    out, books = codes.compressed(own)
    n = own.count() * 8
    assert books.scans[0] == n and all(s < n for s in books.scans[1:])
    rows = out.join(own, out.d.vec_id == own.vec_id).select("code", "embedding").collect()
    near = books.vectors(np.array([list(r.code) for r in rows]))
    error = ((near - np.array([r.embedding for r in rows])) ** 2).sum(1).mean()
    assert error < np.array([r.embedding for r in rows]).var(0).sum()


def test_odd_rows(spark):
    assert codes.report(rows_of(spark, [])).collect() == []
    few = [(None, [0.5] * 8, 1), (3, [0.25] * 8, None), (3, [0.25] * 8, None), (7, [1e38] * 8, 2), (8, [-1e38] * 8, 2), (9, [1.0] * 16, 2), (10, [], 3)]
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in codes.report(rows_of(spark, few)).collect())
    assert [x[:3] for x in got] == [(False, 3, "00" * 8), (False, 3, "00" * 8), (False, 7, "02" * 8), (False, 8, "03" * 8), (False, 9, None), (False, 10, None), (True, 0, "04" * 8)] and all(e in (0, None) for *_, e in got)
    with pytest.raises(ValueError):
        codes.compressed(rows_of(spark, [(1, [1.0] * 9, 1)]))


def test_oracle(spark, sf):
    from cuemill.llm import queries
    from tests.compare import differs, duck

    assert differs(queries.queries()["op11_vector_codes"](spark, sf), duck(sf), queries.oracle_sql()["op11_vector_codes"]) is None
