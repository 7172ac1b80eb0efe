"""Exact top-k search by a pivot-distance index: annuli around pivots, sorted by distance, and triangle-inequality bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

#: Rows in one ring of the index and in one block of queries.
RING, BLOCK = 2048, 512
#: Vectors that pivots are picked from, and pivots.
SAMPLE, PIVOTS = 2048, 16
#: Slack for distances in floating point: bounds are widened by this share and by this much.
SHARE, LEAST = 1e-9, 1e-3
#: The least score of a query of which fewer than k vectors are known.
NONE = np.iinfo(np.int64).min


def integer_vectors(df: DataFrame, vector_col: str, scale: int = 256) -> Column:
    """floor(scale x) of each component, or null if the vector or a component is null or not finite."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector_col).isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x * scale)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.int64)


def _pivots(rows: DataFrame) -> np.ndarray:
    """Pivots far from each other, from the SAMPLE vectors with the smallest hash."""
    some = np.array([r["v"] for r in rows.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").collect()], dtype=float)
    picked, far = [0], ((some - some[0]) ** 2).sum(axis=1)
    while len(picked) < min(PIVOTS, len(some)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((some - some[picked[-1]]) ** 2).sum(axis=1))
    return some[picked]


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances to the pivots, with one more coordinate that gives every candidate the same norm.

    So the nearest candidate has the greatest inner product: |q - x|^2 = |q|^2 + top - 2 q x.
    """
    more = np.sqrt(np.maximum(top - (pivots**2).sum(axis=1), 0))
    square = (v.astype(float) ** 2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * v.astype(float) @ pivots.T
    return np.sqrt(np.maximum(square + (extra[:, None] - more) ** 2, 0))


def _inside(q: np.ndarray, least: np.ndarray, lows: np.ndarray, highs: np.ndarray, pivots: np.ndarray, top: int) -> np.ndarray:
    """Which queries a ring may hold a vector for that scores their `least` or more, by the bounds of all pivots."""
    reach = _reach(q, least, top)[:, None]
    d = _distances(q, np.zeros(len(q)), pivots, top)
    return ((d - reach <= highs) & (d + reach >= lows)).all(axis=1)


def _reach(q: np.ndarray, least: np.ndarray, top: int) -> np.ndarray:
    """How far a vector may be from each query to score its `least`."""
    square = (q.astype(float) ** 2).sum(axis=1) + float(top) - 2 * least.astype(float)
    return np.where(least == NONE, np.inf, np.sqrt(np.maximum(square, 0)) * (1 + SHARE) + LEAST)


def _blobs(rows: DataFrame, pivots: np.ndarray, top: int, dim: int, kind: str, size: int, query: bool) -> DataFrame:
    """Rows packed into blocks of one pivot, each a stretch of the distances to it.

    block, pivot, lo, hi, lows and highs (of the distances to every pivot), ids, vectors (of numpy's
    type `kind`); rows of a pivot lie in the order of their distance, dealt out by range, so a pivot
    with most rows is no load for one task.
    """

    def distances(v):
        return _distances(v, np.zeros(len(v)) if query else np.sqrt(top - (v**2).sum(axis=1).astype(float)), pivots, top)

    def mark(batches):
        for b in batches:
            v = _matrix(b.column("v"), dim)
            d = distances(v)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(v)), near])], ["id", "v", "pivot", "d"])

    def gather(batches):
        held, pivot = [], None

        def block():
            d = [x for _, _, x in held]
            ids = np.array([i for i, _, _ in held], dtype="<i8").tobytes()
            v = np.stack([v for _, v, _ in held])
            every = distances(v)
            return pivot, d[0], d[-1], every.min(axis=0).tolist(), every.max(axis=0).tolist(), ids, v.astype(kind).tobytes()

        def out(rows):
            many = pa.list_(pa.float64())
            kinds = (pa.int32(), pa.float64(), pa.float64(), many, many, pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["pivot", "lo", "hi", "lows", "highs", "ids", "vectors"])

        for b in batches:
            v, rows = _matrix(b.column("v"), dim), []
            for i, (vec_id, p, d) in enumerate(zip(b.column("id").to_pylist(), b.column("pivot").to_pylist(), b.column("d").to_pylist(), strict=True)):
                if held and (p != pivot or len(held) == size):
                    rows.append(block())
                    held = []
                pivot = p
                held.append((vec_id, v[i], d))
            yield out(rows)
        if held:
            yield out([block()])

    marked = rows.select("id", "v").mapInArrow(mark, "id bigint, v array<bigint>, pivot int, d double")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(tasks, "pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
    packed = dealt.mapInArrow(gather, "pivot int, lo double, hi double, lows array<double>, highs array<double>, ids binary, vectors binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _best(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best, ties to the smaller id."""
    if np.abs(q).max(initial=0) * float(np.abs(v).max(initial=0)) * q.shape[1] < 1 << 53:  # exact in floating point too, and faster
        score = (q.astype(float) @ v.T.astype(float)).astype(np.int64)
    else:
        score = q @ v.T
    score[q_ids[:, None] == ids[None, :]] = NONE
    out = []
    for row in score:
        at = np.lexsort((ids, -row))[:k] if len(row) <= k else None
        if at is None:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row >= edge)
            at = at[np.lexsort((ids[at], -row[at]))][:k]
        out.append((at[row[at] > NONE], row))
    return [(ids[at], row[at]) for at, row in out]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates with the greatest integer inner product for each query row.

    Components are floor(256 x). One coordinate more makes the greatest inner product the nearest
    distance. Candidates lie around the nearest of a few pivots in rings sorted by distance; queries
    are gathered in blocks in the same way. A block first looks into the ring nearest to it,
    which bounds how far each query's k-th best can be. By the triangle inequality only rings whose
    distances to every pivot come within that bound of the block's are looked into after that, and
    there only for the queries whose own bounds reach the ring.

    Pivots are picked from a sample of 2048 vectors; every vector is indexed, and results are exact.
    Output: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id; fewer rows where
    there are fewer candidates. Candidates with the query's own id are left out. Vectors or
    components that are null or not finite, and null ids, take no part; neither do vectors of
    another length than most. Repeated rows count each. Empty input: no rows. An inner product
    beyond a long is an error.
    """

    def valid(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("id"), integer_vectors(df, vector_col).alias("v")).where("id is not null and v is not null and size(v) > 0")

    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    spark = vectors.sparkSession
    rows, asked = valid(vectors), valid(queries)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["n"]
    rows, asked = (x.where(F.size("v") == dim) for x in (rows, asked))
    norm = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    widest = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    top, most = rows.agg(F.max(norm), F.max(widest)).first()
    most = max(most, asked.agg(F.max(widest)).first()[0] or 0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    pivots = _pivots(rows)
    rings = written(_blobs(rows, pivots, top, dim, kind, RING, False).withColumnRenamed("block", "ring"), "rings")
    blocks = written(_blobs(asked, pivots, top, dim, kind, BLOCK, True), "query-blocks")

    def unpack(ids: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(data.as_py(), kind).reshape(-1, dim).astype(np.int64)

    # The ring nearest to each block, among those of its pivot, else of any
    near = F.abs(F.col("r.lo") + F.col("r.hi") - F.col("b.lo") - F.col("b.hi"))
    meta = rings.select("ring", "pivot", "lo", "hi")
    first = blocks.select("block", "pivot", "lo", "hi").alias("b").join(meta.alias("r"), F.col("b.pivot") == F.col("r.pivot"), "left")
    first = first.groupBy("b.block").agg(F.min_by("r.ring", F.struct(near, F.col("r.ring"))).alias("ring"))
    seeded = blocks.select("block", "ids", "vectors").join(first, "block").join(rings.select("ring", F.col("ids").alias("r_ids"), F.col("vectors").alias("r_vectors")), "ring", "left")

    def bound(batches):
        """For each block the distances to each pivot within which the k best of its queries lie, and their least scores."""
        for b in batches:
            out = []
            for i in range(b.num_rows):
                ids, q = unpack(b.column("ids")[i], b.column("vectors")[i])
                least = np.full(len(ids), NONE)
                if b.column("r_ids")[i].is_valid:
                    r_ids, v = unpack(b.column("r_ids")[i], b.column("r_vectors")[i])
                    least = np.array([s[k - 1] if len(s) == k else NONE for _, s in _best(q, ids, v, r_ids, k)])
                reach = _reach(q, least, top)[:, None]
                d = _distances(q, np.zeros(len(q)), pivots, top)
                out.append((b.column("block")[i].as_py(), (d - reach).min(axis=0).tolist(), (d + reach).max(axis=0).tolist(), least.astype("<i8").tobytes()))
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["block", "from", "to", "least"])

    reach = written(seeded.mapInArrow(bound, "block bigint, `from` array<double>, `to` array<double>, least binary"), "bounds")
    # Block and ring by the ring's own pivot first, then by all others
    spans = reach.select("block", "least", "from", "to", F.posexplode(F.arrays_zip("from", "to")).alias("pivot", "own")).alias("p")
    meta = rings.select("ring", "pivot", "lo", "hi", "lows", "highs").alias("r")
    inside = (F.col("r.pivot") == F.col("p.pivot")) & (F.col("lo") <= F.col("own.to")) & (F.col("hi") >= F.col("own.from"))
    all_inside = F.forall(F.arrays_zip("from", "to", "lows", "highs"), lambda x: (x["lows"] <= x["to"]) & (x["highs"] >= x["from"]))
    pairs = spans.join(meta, inside).where(all_inside).select("block", "least", "ring")
    pairs = pairs.join(blocks.select("block", "ids", "vectors"), "block").join(rings.select("ring", "lows", "highs", F.col("ids").alias("r_ids"), F.col("vectors").alias("r_vectors")), "ring")

    def look(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for i in range(b.num_rows):
                ids, q = unpack(b.column("ids")[i], b.column("vectors")[i])
                r_ids, v = unpack(b.column("r_ids")[i], b.column("r_vectors")[i])
                least = np.frombuffer(b.column("least")[i].as_py(), "<i8")
                reached = np.flatnonzero(_inside(q, least, np.array(b.column("lows")[i].as_py()), np.array(b.column("highs")[i].as_py()), pivots, top))
                for j, (found, score) in zip(reached.tolist(), _best(q[reached], ids[reached], v, r_ids, k), strict=True):
                    keep = score >= least[j]
                    for c, x in zip(cols, ([b.column("block")[i].as_py()] * keep.sum(), [j] * keep.sum(), [ids[j]] * keep.sum(), found[keep], score[keep]), strict=True):
                        c.extend(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=np.int64), pa.int64()).cast(t) for c, t in zip(cols, kinds, strict=True)], ["block", "place", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(look, "block bigint, place int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
