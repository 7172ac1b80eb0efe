"""Running numbers and sums over sorted rows that no single task could hold: ranges of the order, with sums carried between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def in_ranges(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """df dealt out by ranges of the order, with _part (0 up, in order) and _at (the place in it, from 0); computed once.

    Ranges are cut by a sample of the rows, so that each has about as many, however they lie; rows that
    are equal in the order are parted by their place in the input. As many ranges as shuffle partitions,
    unless said otherwise.
    """
    placed = df.withColumn("_in", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(ranges, *order, "_in") if ranges else placed.repartitionByRange(*order, "_in")
    number = F.monotonically_increasing_id()  # the partition above 33 bits of the row's place
    dealt = dealt.sortWithinPartitions(*order, "_in").withColumn("_at", number)
    return cut(dealt.select(*df.columns, F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_at")))


def numbered(df: DataFrame, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """df with the row's number in the order, from 1: one exchange, and counts of ranges carried on."""
    d = in_ranges(df, order, ranges)
    counted = d.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as ranges
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(counted.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], ranges: int | None = None, inclusive: bool = True) -> DataFrame:
    """df with running sums within each group in the order; a group may hold most rows.

    A sum runs inside each range, and groups that began in ranges before carry their sums on: two rows
    at most of each range. Nulls in group are a group of their own.
    """
    values = [f"_v{i}" for i in range(len(sums))]
    d = df.select("*", *(c.alias(v) for v, c in zip(values, sums.values(), strict=True)))
    d = in_ranges(d, [*(F.col(g).asc_nulls_first() for g in group), *order], ranges)
    own = [F.struct(*(F.col(g) for g in group)).alias("_g")] if group else [F.struct(F.lit(0).alias("g")).alias("_g")]
    d = d.select("*", *own)
    # The groups at the ends of each range: no other spans ranges
    ends = d.groupBy("_part").agg(F.min_by("_g", "_at").alias("a"), F.max_by("_g", "_at").alias("b")).select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias("_g"))
    same = lambda a, b: (F.col(f"{a}._part") == F.col(f"{b}._part")) & F.col(f"{a}._g").eqNullSafe(F.col(f"{b}._g"))
    totals = d.alias("d").join(F.broadcast(ends).alias("e"), same("d", "e"), "left_semi").groupBy("_part", "_g").agg(*(F.sum(v).alias(v) for v in values))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", "_g", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_c{v}") for v in values))
    here = Window.partitionBy("_part", "_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.select("*", *(F.coalesce(F.sum(v).over(here), F.lit(0)).alias(f"_r{v}") for v in values))
    joined = d.alias("d").join(F.broadcast(carried).alias("c"), same("d", "c"), "left").select("d.*", *(f"c._c{v}" for v in values))
    out = reduce(lambda x, nv: x.withColumn(nv[0], F.col(f"_r{nv[1]}") + F.coalesce(F.col(f"_c{nv[1]}"), F.lit(0))), zip(sums, values, strict=True), joined)
    return out.select(*(c for c in df.columns if c not in sums), *sums)
