import random

import numpy as np
import pytest

from docforensics.llm import topk


def _brute(rows, queries, k):
    ok = [(i, np.floor(256 * np.array(v, dtype=float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and len(v) == 8]
    out = []
    for q, v in ok:
        if q in queries:
            best = sorted(((-int(v @ x), i) for i, x in ok if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("ring", [2048, 16])
def test_exact_against_all_pairs(spark, monkeypatch, ring):
    monkeypatch.setattr(topk, "RING", ring)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (1 + 5 * (i % 7 == 0)) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [1.0] * 7 + [None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [1.0, 2.0]), (None, [1.0] * 8), (406, [0.0] * 8)]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, rank string, block string")
    got = sorted(tuple(r) for r in topk.exact_top_k(d, d.where("vec_id % 20 = 0"), 5).collect())
    assert got == _brute(rows, {i for i in range(0, 500, 20)}, 5)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0, 4.0])], schema)
    assert topk.exact_top_k(few, few).count() == 2
    one = few.where("vec_id = 0")
    assert topk.exact_top_k(one, one).count() == 0
    none = spark.createDataFrame([], schema)
    assert topk.exact_top_k(none, none).count() == 0
    assert topk.exact_top_k(few, none).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "one cloud"])
def test_bounds_of_rings(kind):
    """A ring with a vector of the least score or more is never left out; with clusters most others are."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (6, 8)) if kind == "clusters" else np.zeros((6, 8))
    v = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(0, 10, (300, 8))).astype(np.int64)
    top = int((v**2).sum(axis=1).max())
    pivots, extra = v[::50].astype(float), np.sqrt(top - (v**2).sum(axis=1).astype(float))
    d = topk._distances(v, extra, pivots, top)
    score = v @ v.T
    least = np.sort(score, axis=1)[:, -5]
    left_out = 0
    for ring in range(6):
        at = slice(50 * ring, 50 * ring + 50)
        got = topk._inside(v, least, d[at].min(axis=0), d[at].max(axis=0), pivots, top)
        assert got[(score[:, at] >= least[:, None]).any(axis=1)].all()
        assert topk._inside(v, np.full(300, topk.NONE), d[at].min(axis=0), d[at].max(axis=0), pivots, top).all()
        left_out += (~got).sum()
    if kind == "clusters":
        assert left_out > 0.5 * 6 * 300


def test_wide_components(spark):
    """Components beyond 16 and 32 bits are kept whole."""
    for size in (1e3, 1e7):
        rows = [(i, [size * (i + 1) / 6, -3.0 * i, 1.0]) for i in range(6)]
        d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        ints = [np.floor(256 * np.array(v)).astype(np.int64) for _, v in rows]
        want = sorted(((-int(ints[0] @ ints[i]), i) for i in range(1, 6)))[:2]
        got = topk.exact_top_k(d, d.where("vec_id = 0"), 2).orderBy("rank").collect()
        assert [(-r["score"], r["vec_id"]) for r in got] == want
