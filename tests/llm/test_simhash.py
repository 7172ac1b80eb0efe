import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docforensics.llm import simhash


def _brute(fps):
    u = np.array(sorted(set(fps)), dtype=np.uint64)
    root = [*range(len(u))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(u)):
        for j in range(i):
            if bin(int(u[i] ^ u[j])).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {int(u[i]): find(i) for i in range(len(u))}


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_against_all_pairs(docs, rows):
    groups = _brute([_fingerprint(r[1]) for r in rows])
    least = {}
    for r in rows:
        g = groups[_fingerprint(r[1])]
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    out = simhash.simhash_components(docs, keep=("text",)).collect()
    assert len(out) == len(rows)
    for r in out:
        fp = _fingerprint(r["in_text"])
        assert r["fp"] % (1 << 64) == fp and r["component_id"] == least.get(groups[fp])


@pytest.mark.parametrize("bucket", [1000, 3])
def test_links_in_clusters(spark, bucket):
    """With a small bucket nearly all go the way for large keys."""
    rng = random.Random(bucket)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for p in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << p
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    root = {r["fp"] % (1 << 64): r["root"] for r in simhash.components(simhash.near_links(spark.createDataFrame(signed, "fp long"), bucket)).collect()}
    groups = _brute(fps)
    got, want = {}, {}
    for x in fps:
        got.setdefault(root.get(x, f"alone {x}"), set()).add(x)
        want.setdefault(groups[x], set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_kept_columns_may_have_any_name(spark):
    d = spark.createDataFrame([(1, "a b c d", 5, 6, 7)], "doc_id long, text string, fp int, component_id int, id int")
    out = simhash.simhash_components(d, keep=("fp", "component_id", "id")).first()
    assert (out["doc_id"], out["component_id"], out["in_fp"], out["in_component_id"], out["in_id"]) == (1, 1, 5, 6, 7)


def test_a_star_with_many_ends_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_LEAST", 4)
    links = spark.createDataFrame([(i, 5) if i > 5 else (5, i) for i in range(300) if i != 5] + [(1000, 999)], "a long, b long")
    roots = {r["fp"]: r["root"] for r in simhash.components(links).collect()}
    assert roots == dict.fromkeys(range(300), 0) | {1000: 999, 999: 999}
    d = spark.range(500).select((F.col("id") + 3).alias("doc_id"), F.when(F.col("id") % 5 > 0, "one text of five words").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    out = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(d).collect()}
    assert len(out) == 500 and {out[i + 3] for i in range(500) if i % 5} == {4}


def test_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long")
    assert {r["root"] for r in simhash.components(links).collect()} == {0}


def test_empty(empty):
    assert simhash.simhash_components(empty).count() == 0


def test_few_owners_of_a_crowded_key(spark, monkeypatch):
    """Very many fingerprints one bit from a key with one owner: they are dealt to parts, and no link is lost."""
    monkeypatch.setattr(simhash, "CROWD", 64)
    kept = {}
    written = simhash.written
    monkeypatch.setattr(simhash, "written", lambda d, n: kept.setdefault(n, written(d, n)))
    rng = random.Random(7)
    owner = rng.getrandbits(64) | 1 << 16  # a bit of the second segment that the others lack
    fps = {owner}
    for i in range(900):
        x = (owner & 0xFFFFFFFF) ^ (1 << 16) | rng.getrandbits(32) << 32
        if i % 30 == 0:
            x = owner ^ (1 << 16) ^ (1 << rng.randrange(32, 64)) ^ (1 << rng.randrange(32, 64))
        fps.add(x)
    d = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near_links(d).collect()}
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    crowd = {r["key"]: r["parts"] for r in kept["crowded-keys"].collect()}
    key = ((owner >> 0) & 0xFFFF) << 16 | ((owner >> 16) & 0xFFFF)
    assert crowd[key] >= 900 // 64
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = _brute(fps)
    by_root = {}
    for x in fps:
        by_root.setdefault(find(x), set()).add(groups[x])
    assert all(len(g) == 1 for g in by_root.values()) and len(by_root) == len(set(groups.values()))
