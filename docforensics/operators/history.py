"""Content identity, cache behaviour, and the log of scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranges import numbered, running


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def dedup_scans(scans: DataFrame, hash_col: str = "sha256", order_col: str = "scan_id") -> DataFrame:
    """Each scan with the first of equal content (result_of) and whether it is that one itself.

    Only minima by hash are grouped, so a content that is uploaded very often is no load for one
    task. A scan without a hash equals no other: it is its own result.
    """
    first = scans.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(order_col).alias("result_of"))
    out = scans.join(first, hash_col, "left").withColumn("result_of", F.when(F.col(hash_col).isNull(), F.col(order_col)).otherwise(F.col("result_of")))
    return out.withColumn("analysed", F.col(order_col).eqNullSafe(F.col("result_of")))


def recent_results(log: DataFrame, key: str, ts: str, n: int = 32) -> DataFrame:
    """The n keys that were used last, with the time; ties to the smaller key."""
    return log.groupBy(key).agg(F.max(ts).alias("last_used")).orderBy(F.desc("last_used"), key).limit(n)


def lru_hit_audit(log: DataFrame, session: list[str], key: str, order: list[str], capacity: int, ranges: int | None = None) -> DataFrame:
    """hit for each request of a session: its key was used before, and fewer than `capacity` other keys since.

    A request counts as the newest use of its key until the next one. Between two uses of a key
    at positions p and i, the other keys are the positions in between whose own previous use is
    before p: all positions from p + 1 to i - 1, less those whose previous use is after p. Those
    are pairs of uses that lie inside (p, i), so counting them is counting inversions: every use
    is put into one block of each power of two of the order of i, and counted there by the order
    of p. The work is n log n for a session of n requests, with no pairs of requests. Positions and
    counts run over ranges of the rows, so a session may hold most of them; uses of one key
    follow each other in a window of their own.
    """
    one = F.lit(1).cast("bigint")
    d = running(log, session, [F.col(c) for c in order], {"_i": one}, ranges)
    d = d.withColumn("_p", F.lag("_i").over(Window.partitionBy(*session, key).orderBy("_i")))
    d = cut(d)
    again = d.where("_p is not null").select(*session, F.col("_i").alias("i"), F.col("_p").alias("p"))
    # Pairs inside (p, i): of those with an earlier i, the ones with a later p. A pair of uses meets an
    # earlier one in the one level where its block is the right half and the other's is the left half.
    longest = again.agg(F.max("i")).first()[0] or 0
    levels = F.array(*map(F.lit, range(max(1, int(longest).bit_length()))))
    put = again.select("*", F.explode(levels).alias("level")).withColumn("block", F.expr("i >> (level + 1)")).withColumn("right", F.expr("(i >> level) & 1") == 1)
    put = running(put, [*session, "level", "block"], [F.desc("p")], {"n": F.when(F.col("right"), 0).otherwise(1).cast("bigint")}, ranges)
    inside = put.where("right").groupBy(*session, "i").agg(F.sum("n").alias("_inside"))
    same = reduce(lambda a, b: a & b, (F.col(f"d.{c}").eqNullSafe(F.col(f"x.{c}")) for c in session), F.col("d._i") == F.col("x.i"))
    out = d.alias("d").join(inside.alias("x"), same, "left").select("d.*", "x._inside")
    others = F.col("_i") - F.col("_p") - 1 - F.coalesce("_inside", F.lit(0))
    return out.withColumn("hit", F.col("_p").isNotNull() & (others < capacity)).drop("_p", "_inside").withColumnRenamed("_i", "position")


def scan_history(log: DataFrame, top: int | None = None, ranges: int | None = None) -> DataFrame:
    """Newest first, numbered from 1; rows without a time come last. With `top`, only so many.

    Without it, rows are dealt by ranges of (time, id) that a sample cuts and numbered by the counts of
    the ranges before: one time far from the others, or most rows at one time or at none, makes no
    range larger. Rows of equal time and id stand in any order.
    """
    order = [F.desc_nulls_last("ts"), F.desc("id")]
    if top:
        return log.orderBy(*order).limit(top).withColumn("number", F.row_number().over(Window.orderBy(*order)))
    return numbered(log, order, "number", ranges)


def search_history(log: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column holds the text in any case; none for a blank text."""
    return log.where(F.contains(F.lower(column), F.lit(text.lower()))) if text.strip() else log.where(F.lit(False))


def replay_lookup(log: DataFrame, key: str = "filename") -> DataFrame:
    """For each row the newest row with the same file name."""
    newest = log.groupBy(key).agg(F.max_by("id", F.struct("ts", "id")).alias("image_id"))
    return log.join(newest, key, "left")


def verdict_summary(log: DataFrame) -> DataFrame:
    """Counts and mean scores by verdict and type in all combinations."""
    return log.cube("verdict", "mrz_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def daily_summary(log: DataFrame) -> DataFrame:
    """Counts by day and verdict, with subtotals."""
    return log.withColumn("day", F.to_date("ts")).rollup("day", "verdict").agg(F.count("*").alias("n"))


def extra_fields(fields: Column, known: tuple[str, ...]) -> Column:
    """Names in a map of fields that are not in the known list."""
    return F.array_except(F.map_keys(fields), F.array(*map(F.lit, known)))


def removed_items(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return before.join(after.select(key).distinct(), key, "left_anti")
