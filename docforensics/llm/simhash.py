"""SimHash near-duplicates: candidates by pigeonring chains of segments, then the full Hamming distance, then components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import carried, chunks, hot_join, removed, written

#: A fingerprint has four segments of 16 bits; two texts are near at 3 differing bits or fewer.
SEGMENTS, WIDTH, BUDGET = 4, 16, 3
#: Hashes whose bits are laid out at once.
BITS_AT_ONCE = 1 << 15


def fingerprints_of(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half the hashes of the word shingles."""
    sums, counts = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    digest, hashes = xxhash.xxh64_intdigest, []
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z only
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-1].tolist()][: max(1, len(words) - shingle + 1)]
        stops = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
        hashes.append(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))
        counts[i] = len(starts)
    if hashes:
        every = np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
        owner = np.repeat(np.arange(len(texts)), counts)
        for at in range(0, len(every), BITS_AT_ONCE):
            own = owner[at : at + BITS_AT_ONCE]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums[own[first]] += np.add.reduceat(np.unpackbits(every[at : at + BITS_AT_ONCE], axis=1, bitorder="little"), first, axis=0, dtype=np.int64)
    out = np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and the columns in `keep` as in_<name>, from whole texts."""

    def run(batches):
        for batch in chunks(batches):
            fp = fingerprints_of([(x or "").encode() for x in batch.column(1).to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view("<i8")), *(batch.column(i) for i in at)], ["id", "fp", *kept])

    kept = [f"in_{c}" for c in keep]
    columns, at = carried(id_col, text_col, keep)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*columns).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [("id", kind[id_col]), ("fp", "bigint"), *((f"in_{c}", kind[c]) for c in keep)]))


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)


def _key(i: int, first: Column, second: Column) -> Column:
    return (F.lit(i << 32) + first * (1 << WIDTH) + second).alias("key")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64))


def _links_in_bucket(key: int, own: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all near pairs of a bucket, a forest's worth and not all pairs.

    own have the key's two segments; other have the first and differ in one bit of the second.
    The chain from segment i: its sum of differences stays within 3/4 a segment, that is 0, 1, 2, 3.
    """
    i = key >> 32
    third = np.uint64(WIDTH * ((i + 2) % SEGMENTS))
    low = np.uint64((1 << WIDTH) - 1)

    def near(a, b, used):
        x = a[:, None] ^ b[None, :]
        chain = _popcount((x >> third) & low) + used <= 2
        return chain & (_popcount(x) <= BUDGET)

    out = []
    label = np.arange(len(own))
    if len(own) > 1:
        pairs = np.argwhere(np.triu(near(own, own, 0), 1))
        for a, b in pairs.tolist():
            x, y = label[a], label[b]
            if x != y:
                label[label == max(x, y)] = min(x, y)
                out.append((int(own[a]), int(own[b])))
    for at in range(0, len(other), 4096):
        block = other[at : at + 4096]
        hit = near(block, own, 1)
        for row in np.flatnonzero(hit.any(axis=1)).tolist():
            to = np.flatnonzero(hit[row])
            for j in np.unique(label[to], return_index=True)[1]:
                out.append((int(block[row]), int(own[to[j]])))
    return out


#: Fingerprints that look up one key in one task, about.
CROWD = 4096


def near_links(fps: DataFrame, bucket: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints so that two are joined by a path exactly if they
    are joined by pairs of at most 3 differing bits.

    Pigeonring: of four segments in a ring, some chain starts with no difference, and its sums stay
    within 1, 2 and 3. So a pair shares a segment, and the next one but for one bit; those 32 bits
    are the key, looked up as it is and with one bit set. Keys of up to `bucket` fingerprints are
    compared inside a task, in parts where very many others look a key up. Larger ones take an exact way without pairs: near fingerprints meet
    at a point one bit from one and two from the other, so each sends itself to the points around
    it, and each point links what it got.
    """
    keys = [F.struct(_key(i, _segment(F.col("fp"), i), _segment(F.col("fp"), i + 1)), F.lit(True).alias("own")) for i in range(SEGMENTS)]
    for i in range(SEGMENTS):
        second = _segment(F.col("fp"), i + 1)
        keys += [F.when(second.bitwiseAND(1 << p) == 0, F.struct(_key(i, _segment(F.col("fp"), i), second + (1 << p)), F.lit(False).alias("own"))) for p in range(WIDTH)]
    sent = fps.select("fp", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("fp", "k.key", "k.own")
    owners = fps.select(F.explode(F.array(*(k.getField("key") for k in keys[:SEGMENTS]))).alias("key")).groupBy("key").count()
    owners = written(owners, "owners")
    hot = written(owners.where(F.col("count") > bucket).select("key"), "hot-keys")
    # Keys with few owners that very many others are sent to, one bit away. Those come from 16 keys, so one of
    # these has a 16th of them as its owners: only such keys are looked at
    many_owners = owners.where(F.col("count") > CROWD // WIDTH)
    sends = many_owners.select(F.explode(F.array_compact(F.array(*(F.when(F.col("key").bitwiseAND(1 << p) == 0, F.col("key") + (1 << p)) for p in range(WIDTH))))).alias("key"), "count")
    crowd = written(sends.groupBy("key").agg(F.sum("count").alias("n")).where(F.col("n") > CROWD).select("key", F.ceil(F.col("n") / CROWD).cast("int").alias("parts")), "crowded-keys")

    def link(batches):
        key, own, other, out = None, [], [], []

        def flush():
            if key is not None and own and len(own) + sum(map(len, other)) > 1:
                out.extend(_links_in_bucket(key[0], np.array(own, dtype=np.uint64), np.concatenate([*other, np.empty(0, np.uint64)])))

        for b in batches:
            k, salt = b.column("key").to_numpy(), b.column("salt").to_numpy()
            fp = b.column("fp").to_numpy().view(np.uint64)
            mine = b.column("own").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(k) != 0) | (np.diff(salt) != 0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(k)], strict=True):
                at = int(k[s]), int(salt[s])
                if e - s == 1 and at != key and e < len(k):  # alone
                    flush()
                    key, own, other = None, [], []
                    continue
                if at != key:
                    flush()
                    key, own, other = at, [], []
                own += fp[s:e][mine[s:e]].tolist()  # they come first
                if own:
                    other.append(fp[s:e][~mine[s:e]])
                    if sum(map(len, other)) > 4096:  # what is compared needn't stay
                        flush()
                        other = []
            if len(out) > 4096:
                yield _pairs(out)
                out.clear()
        flush()
        yield _pairs(out)

    # Others of a crowded key are dealt to its parts, and its owners (no more than a bucket) go to each part
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
    usual = sent.join(hot, "key", "left_anti").join(crowd, "key", "left").select("key", "own", "fp", F.explode(parts).alias("salt"))
    usual = usual.repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("own"))
    few = usual.mapInArrow(link, "a bigint, b bigint")

    # The way for large keys, over the 32 bits besides the key's.
    members = sent.join(hot, "key", "left_semi")
    one, two = _masks(1), _masks(2)
    tail = F.lit(0)
    for i in range(SEGMENTS):
        tail = F.when(F.shiftright("key", 32) == i, _segment(F.col("fp"), i + 2) + _segment(F.col("fp"), i + 3) * (1 << WIDTH)).otherwise(tail)
    points = members.select("key", "fp", tail.alias("tail"), F.explode(F.when(F.col("own"), _marks(one, two)).otherwise(_marks(one, []))).alias("m"), "own")
    points = points.select("key", "fp", F.col("tail").bitwiseXOR(F.col("m.mask")).alias("point"), (F.col("own") & F.col("m.close")).alias("close"))
    centre = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("key", "point"))
    many = points.select("fp", centre.alias("centre")).where("centre is not null and fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    return few.unionByName(many).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(rows or np.empty((0, 2)), dtype=np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def _masks(bits: int) -> list[int]:
    return [sum(1 << p for p in c) for n in range(bits + 1) for c in combinations(range(32), n)]


def _marks(close: list[int], wide: list[int]) -> Column:
    far = [m for m in wide if m not in set(close)]
    return F.from_json(F.lit("[" + ",".join(f'{{"mask":{m},"close":{str(m in set(close)).lower()}}}' for m in [*close, *far]) + "]"), "array<struct<mask:bigint,close:boolean>>")


#: A key counts as hot if it has more than this share of all rows, and this many.
HOT_SHARE, HOT_LEAST = 4096, 64


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for all ends of the links; root is the smallest in its component.

    Large-star and small-star steps in turn until nothing changes. Only minima are grouped; they
    are sent back to a star with very many ends without gathering it. What a step leaves is
    written to the shared folder, and what the one before left is removed.
    """
    edges = written(links.select("a", "b"), "links")
    before, n = None, edges.count()
    while True:
        most = max(HOT_LEAST, n // HOT_SHARE)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both.where("b > a"), low, "a", "n", most).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: all have a > b by now
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, "a", "n", most).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        done, edges = edges, written(small.distinct(), "links")
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        removed(done)
        if (n, total) == before:
            break
        before = n, total
    root = edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return root.union(edges.select(F.col("b").alias("fp"), F.col("b").alias("root"))).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its fingerprint and the smallest id that near links reach from it.

    Lower-cased (A-Z) words are runs without ASCII white space; shingles of three, repeats
    included, are hashed by XXH64 with seed 42. A text of fewer words is one shingle; one of no
    words (null, empty) has fingerprint zero and is linked like any other. Fingerprints are
    linked at 3 or fewer differing bits. Copies share a fingerprint, and only distinct
    fingerprints are compared, so groups of copies of any size cost one.

    Output: id, fp (signed long), component_id, and the columns in `keep` as in_<name>; other
    columns are not read. Repeated rows stay. A null id takes no part as smallest; a component of
    null ids alone has a null component_id. Empty input: no rows. A very long text is held whole by
    one task, its shingles' bits are added up in blocks.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle, keep), "fingerprints")
    least = written(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    root = written(components(near_links(least.select("fp"), bucket)), "components")
    own = least.join(root, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    size = least.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ids = written(hot_join(own, smallest, "root", "members", max(HOT_LEAST, size[0] // HOT_SHARE)).select("fp", "n", "component_id"), "component-ids")
    removed(root, least)
    found = hot_join(marked, ids, "fp", "n", max(HOT_LEAST, size[1] // HOT_SHARE))
    return found.select(F.col("id").alias(id_col), "fp", "component_id", *(f"in_{c}" for c in keep))
