"""Sharding by histogram sort: probes are refined by exact byte counts until the splitters fit, then one exchange."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

#: A key has three parts of 60 bits (text, id, row), looked at 12 bits at a time.
BITS, DIGIT = 60, 12
LEVELS = BITS // DIGIT
PARTS = ("h", "tie", "row")


def _key(c: Column) -> Column:
    return F.shiftrightunsigned(c, 64 - BITS)


def _refine(keyed: DataFrame, targets: dict[int, float], slack: float) -> dict[int, tuple[int, ...]]:
    """For each splitter, the first key that lies beyond it, as far as it had to be told.

    A bracket is a prefix of the key. Each round one aggregation counts the bytes in the 4096
    equal cells of every open bracket, so at most 4096 rows for each splitter reach the driver,
    however many rows there are. Fifteen rounds tell any two keys apart; hashes seldom need a third.
    """
    done: dict[int, tuple[int, ...]] = {}
    brackets = {k: (0, (), 0, 0) for k in targets}  # level, parts that are fixed, prefix, bytes below
    while brackets:
        number = {b: i for i, b in enumerate(sorted(set(brackets.values())))}
        cell = F.lit(None)
        for (level, fixed, prefix, _), i in number.items():
            key, depth = F.col(PARTS[len(fixed)]), level % LEVELS
            inside = F.shiftright(key, BITS - DIGIT * depth) == prefix if depth else F.lit(True)
            for part, value in zip(PARTS, fixed, strict=False):
                inside = inside & (F.col(part) == value)
            cell = F.when(inside, F.struct(F.lit(i).alias("bracket"), F.shiftright(key, BITS - DIGIT * (depth + 1)).alias("cell"))).otherwise(cell)
        counted: dict[int, list] = {i: [] for i in number.values()}
        for r in keyed.select(cell.alias("c"), "size").where("c is not null").groupBy("c").agg(F.sum("size").alias("size")).collect():
            counted[r["c"]["bracket"]].append((r["c"]["cell"], r["size"]))
        after = {}
        for k, b in brackets.items():
            level, fixed, _, below = b
            rows, start = [], below
            for at, size in sorted(counted[number[b]]):
                rows.append((at, start, size))
                start += size
            at, before, size = rows[max(0, bisect_right([x[1] for x in rows], targets[k]) - 1)]
            shift = BITS - DIGIT * (level % LEVELS + 1)
            low, high = targets[k] - before, before + size - targets[k]
            if min(low, high) <= slack or level == len(PARTS) * LEVELS - 1:
                done[k] = (*fixed, (at if low <= high else at + 1) << shift)
            elif (level + 1) % LEVELS:
                after[k] = (level + 1, fixed, at, before)
            else:  # one value of this part: go on with the next
                after[k] = (level + 1, (*fixed, at), 0, before)
        brackets = after
    return done


def _beyond(cut: tuple[int, ...], depth: int = 0) -> Column:
    """The key isn't below the cut."""
    part = F.col(PARTS[depth])
    if depth == len(cut) - 1:
        return part >= cut[depth]
    return (part > cut[depth]) | ((part == cut[depth]) & _beyond(cut, depth + 1))


def histogram_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002) -> DataFrame:
    """Every document with its shard and its place in the shard; shards are nearly equal in bytes.

    The key of a document is (hash of its text, hash of its id, hash of its row), so equal texts
    lie together. They are parted only where a group is larger than the tolerance allows (a group
    may hold a third of all rows), and then by id, and rows of one id and text by row. A splitter
    is off by at most `tolerance` of a mean shard, or by half a document where documents are
    larger than that.

    Output: id, text, size (UTF-8 bytes and 8), shard (0 up), slot (0 up without gaps in each
    shard). Null texts have size 8 and are equal to each other. Null ids are kept. Repeated rows
    each take a slot. Empty input: no rows. Other columns are not read.

    The rows are written once with their keys, since a row's own key comes from its place.
    """
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(text_col).alias("text"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("bigint").alias("size"),
            _key(F.xxhash64(text_col)).alias("h"),
            _key(F.xxhash64(F.col(id_col).cast("string"), F.lit("tie"))).alias("tie"),
            _key(F.xxhash64(F.monotonically_increasing_id(), F.lit("row"))).alias("row"),
        ),
        "shard-rows",
    )
    keyed = rows.select(*PARTS, "size")
    total, n = keyed.agg(F.sum("size"), F.count("*")).first()
    cuts: list[tuple[int, ...]] = []
    if n:
        targets = {k: total * k / shards for k in range(1, shards)}
        cuts = list(_refine(keyed, targets, tolerance * total / shards).values())
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(_beyond(cut), 1).otherwise(0)
    # Slots are numbered in cells of the row, so that neither a text nor an id is too common for a task.
    cells = max(8, min(1 << 12, (n or 0) // (shards * 64)))
    cell = F.pmod("row", F.lit(cells)).cast("int").alias("cell")
    counted = keyed.select(shard.alias("shard"), cell).groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = counted.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "cell").orderBy(*PARTS)
    return (
        rows.select("*", shard.alias("shard"), cell)
        .withColumn("n", F.row_number().over(order))
        .join(F.broadcast(start), ["shard", "cell"])  # shards x 4096 rows at most
        .select(F.col("id").alias(id_col), F.col("text").alias(text_col), "size", "shard", (F.col("start") + F.col("n") - 1).cast("bigint").alias("slot"))
    )
