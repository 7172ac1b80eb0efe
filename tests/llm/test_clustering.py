import hashlib
import random

import numpy as np
import pytest

from docforensics.llm.clustering import lloyd

SCHEMA = "vec_id long, embedding array<double>, cluster int, block long"


def loop(rows, k, rounds, dim):
    """The same, one vector at a time."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * x)) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))[:k]
    model = [list(v) for _, v in start]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in model] for _, v in kept]
        near = [x.index(min(x)) for x in d]
        if r < rounds:
            for j in range(len(model)):
                mine = [v for (_, v), n in zip(kept, near, strict=True) if n == j]
                if mine:
                    model[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), n, x[n]) for (i, _), n, x in zip(kept, near, d, strict=True)), model


@pytest.fixture(scope="module")
def rows():
    """A hot vector with a third of the rows, equal ids, null ids, vectors that take no part."""
    rng = random.Random(4)
    out = [(i, [rng.gauss(i % 3, 0.4) for _ in range(10)], 1, 2) for i in range(300)]
    out += [(1000 + i, [0.5] * 10, 0, 0) for i in range(150)] + [(7, [rng.random() for _ in range(10)], 0, 0), (None, [0.25] * 10, 0, 0)]
    return [*out, (2000, None, 0, 0), (2001, [], 0, 0), (2002, [1.0] * 9, 0, 0), (2003, [None] * 10, 0, 0), (2004, [float("nan")] * 10, 0, 0), (2005, [float("inf")] * 10, 0, 0), out[3]]


@pytest.mark.parametrize("columns", [4, 10, 16])
def test_rounds_against_a_loop(spark, rows, columns):
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assigned, centroids = lloyd(d, k=12, rounds=3, dim=10, columns=columns)
    want, model = loop(rows, 12, 3, 10)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in assigned.collect()) == want
    assert [r["centroid"] for r in centroids.orderBy("cluster").collect()] == model


def test_wide_components(spark):
    """Squares beyond a float's 53 bits are exact; beyond a long they are an error."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(1 << 19), 1 << 19)) for _ in range(4)], 0, 0) for i in range(60)]
    assigned, _ = lloyd(spark.createDataFrame(rows, SCHEMA), k=5, rounds=2, dim=4)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in assigned.collect()) == loop(rows, 5, 2, 4)[0]
    with pytest.raises(ValueError):
        lloyd(spark.createDataFrame([(1, [1e9] * 4, 0, 0)], SCHEMA), dim=4)


def test_few_and_none(spark):
    few = [(i, [float(i)] * 3, 0, 0) for i in range(3)]
    assigned, centroids = lloyd(spark.createDataFrame(few, SCHEMA), k=40, dim=3)
    assert sorted((r["vec_id"], r["distance"]) for r in assigned.collect()) == [(0, 0), (1, 0), (2, 0)] and centroids.count() == 3
    assigned, centroids = lloyd(spark.createDataFrame([], SCHEMA), dim=3)
    assert assigned.count() == centroids.count() == 0
