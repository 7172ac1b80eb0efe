"""Centroid clustering: Lloyd's rounds with the dimensions dealt out to shards, exact in whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import removed, written
from .topk import integer_vectors

#: Vectors in one block of rows, and columns in one shard.
ROWS, COLUMNS = 1024, 16


def _width(bound: int) -> str:
    """The narrowest of numpy's types that holds all values up to `bound`."""
    return "<i2" if bound < 1 << 15 else "<i4" if bound < 1 << 31 else "<i8"


def _squares(x: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of rows and centroids; `exact`: all products and sums fit in a float's 53 bits."""
    if exact:
        x, c = x.astype(float), c.astype(float)
    else:
        x, c = x.astype(np.int64), c.astype(np.int64)
    return ((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * (x @ c.T)).astype(np.int64)


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding", columns: int = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(assigned, centroids) after `rounds` rounds: id, cluster, distance (squared); cluster, centroid (array<bigint>).

    Components are floor(256 x). The first centroids are the k vectors with the smallest sha256 of
    `<seed>:<id>`. Vectors are cut into blocks of rows and shards of `columns` columns, laid out by
    shard. In a round a task of one shard takes its columns' part of every distance to the shard's
    slice of the centroids; the parts of a block are added by key, the sum's smallest entry is the
    cluster (ties: smaller number), and each shard's slice is replaced by the floor of its own means.
    A round is one exchange, of partial distances and columns, in the fewest bytes that hold them
    exactly; no key is more common than the number of shards. Only k x dim numbers are broadcast.

    Vectors take no part that are null, hold null or non-finite components, or have another length
    than dim. Repeated ids and equal vectors count each; among equal hashes the smaller vector comes
    first, null ids last. With fewer than k vectors each is a centroid. Empty clusters stay where
    they are. Empty input: no rows. Components so large that a squared distance passes a long are an
    error. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), integer_vectors(vectors, vector_col).alias("v")).where(F.size("v") == dim)
    widest = rows.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0]
    schema = f"`{id_col}` bigint, cluster int, distance bigint"
    if widest is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "cluster int, centroid array<bigint>")
    if dim * (2 * widest) ** 2 >= 1 << 62:
        raise ValueError("components are too large for squared distances in a long")
    value, part, exact = _width(widest), _width(columns * (2 * widest) ** 2), dim * (2 * widest) ** 2 < 1 << 51
    cuts = [(a, min(a + columns, dim)) for a in range(0, dim, columns)]

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                p = b.slice(at, ROWS)
                v = np.asarray(p.column("v").flatten()).reshape(-1, dim).astype(value)
                block = p.column("block")[0]
                ids = pa.array([p.column("id").to_pylist(), *[None] * (len(cuts) - 1)], pa.list_(pa.int64()))
                data = pa.array([v[:, a:z].tobytes() for a, z in cuts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([block.as_py()] * len(cuts), pa.int64()), ids, data], ["shard", "block", "ids", "data"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.withColumn("block", F.monotonically_increasing_id()).mapInArrow(cut, "shard int, block bigint, ids array<bigint>, data binary")
    slices = written(blocks.repartitionByRange(tasks, "shard", "block"), "slices")

    # The model, one row a component: k x dim rows
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    start = [(j // columns, i, j % columns, r["v"][j]) for i, r in enumerate(first) for j in range(dim)]
    k = len(first)
    model = spark.createDataFrame(start, "shard int, cluster int, at int, value bigint")

    def measured(model: DataFrame) -> DataFrame:
        """Each shard's part of the distances of each block, with the block's columns."""
        in_order = F.array_sort(F.collect_list(F.struct("cluster", "at", "value")))
        slice_of = model.groupBy("shard").agg(F.transform(in_order, lambda x: x["value"]).alias("slice"))

        def partial(batches):
            for b in batches:
                out = []
                for shard, data, c in zip(b.column("shard").to_pylist(), b.column("data").to_pylist(), b.column("slice"), strict=True):
                    a, z = cuts[shard]
                    x = np.frombuffer(data, value).reshape(-1, z - a)
                    out.append(_squares(x, np.asarray(c.values).reshape(k, z - a), exact).astype(part).tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("shard", "block", "ids", "data")), pa.array(out, pa.binary())], ["shard", "block", "ids", "data", "part"])

        joined = slices.join(F.broadcast(slice_of), "shard").select("shard", "block", "ids", "data", "slice")
        return joined.mapInArrow(partial, "shard int, block bigint, ids array<bigint>, data binary, part binary")

    def added(batches):
        """(ids, columns by shard, cluster, distance) of each block, its parts added up as they come."""
        block, total, ids, data = None, None, None, []
        for b in batches:
            for shard, at, some, x, p in zip(*(b.column(n).to_pylist() for n in ("shard", "block", "ids", "data", "part")), strict=True):
                if at != block and block is not None:
                    yield ids, data, total.argmin(axis=1), total.min(axis=1)
                if at != block:
                    block, total, data = at, 0, []
                total = total + np.frombuffer(p, part).reshape(-1, k).astype(np.int64)
                ids = some if some is not None else ids
                data.append((shard, x))
        if block is not None:
            yield ids, data, total.argmin(axis=1), total.min(axis=1)

    def moved(batches):
        """The sums of each shard's columns by cluster, of all blocks of a task."""
        sums = [np.zeros((k, z - a), dtype=np.int64) for a, z in cuts]
        count = np.zeros(k, dtype=np.int64)
        for _, data, cluster, _ in added(batches):
            count += np.bincount(cluster, minlength=k)
            for shard, x in data:
                a, z = cuts[shard]
                np.add.at(sums[shard], cluster, np.frombuffer(x, value).reshape(-1, z - a))
        have = np.flatnonzero(count)
        for shard, s in enumerate(sums):
            w = s.shape[1]
            columns_of = (np.full(len(have) * w, shard), np.repeat(have, w), np.tile(np.arange(w), len(have)), s[have].ravel(), np.repeat(count[have], w))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns_of, kinds, strict=True)], ["shard", "cluster", "at", "total", "n"])

    def told(batches):
        for ids, _, cluster, distance in added(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], [id_col, "cluster", "distance"])

    def by_block(model: DataFrame) -> DataFrame:
        return measured(model).repartition(tasks, "block").sortWithinPartitions("block", "shard")

    kept = []
    for _ in range(rounds):
        sums = by_block(model).mapInArrow(moved, "shard int, cluster int, at int, total bigint, n bigint")
        sums = sums.groupBy("shard", "cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        mean = F.expr("(total - pmod(total, n)) div n")
        model = written(model.join(sums, ["shard", "cluster", "at"], "left").select("shard", "cluster", "at", F.coalesce(mean, "value").alias("value")).coalesce(1), "model")
        removed(*kept)
        kept = [model]
    in_order = F.array_sort(F.collect_list(F.struct("shard", "at", "value")))
    centroids = model.groupBy("cluster").agg(F.transform(in_order, lambda x: x["value"]).alias("centroid"))
    return by_block(model).mapInArrow(told, schema), centroids
