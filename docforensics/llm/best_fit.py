"""Best-fit packing in rounds: documents and gaps sorted by size, successor sweeps in all ranges at once, conflicts settled by rank."""

from __future__ import annotations

from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import removed, written
from .packing import pieces

#: Rows of one range in a sweep, and ranges at most; a range's gaps are held in memory.
RANGE, RANGES = 1 << 15, 1 << 12
GAP, DOC = 0, 1
#: Sequences are opened where a round places less than one in so many pieces.
FEW = 8
STATE = "kind int, key bigint, size int, part int, rank int, sequence bigint, offset int"


def _sweep(rows: DataFrame, ranges: int, size: int) -> DataFrame:
    """Documents and gaps from large to small, each range for itself: a document takes the smallest gap that holds it.

    A gap that still holds the document at hand stays the smallest; one that doesn't comes back where
    its room stands in the order, or waits for the next round if that is beyond its range. Output:
    documents with a sequence (placed) or without one (rank: their order in the range), gaps with a
    rank (the smallest last: open to smaller ranges) or without one.
    """

    def sweep(batches):
        part, stack, later, n = TaskContext.get().partitionId(), [], [], 0

        def out(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "key", "size", "part", "rank", "sequence", "offset"])

        for b in batches:
            done = []
            for kind, key, room in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "size")), strict=True):
                while later and -later[0][0] >= room:
                    left, gap = heappop(later)
                    stack.append((-left, gap))
                if kind == GAP:
                    stack.append((room, key))
                elif stack:
                    have, gap = stack.pop()
                    done.append((DOC, key, room, part, None, gap, size - have))
                    left = have - room
                    if left >= room:
                        stack.append((left, gap))
                    elif left:
                        heappush(later, (-left, gap))
                else:
                    done.append((DOC, key, room, part, n, None, None))
                    n += 1
            yield out(done)
        yield out([(GAP, gap, room, part, i, None, None) for i, (room, gap) in enumerate(stack)] + [(GAP, gap, -left, part, None, None, None) for left, gap in later])

    order = (F.desc("size"), "kind", F.xxhash64("key"))  # rows of one size are dealt to several ranges
    dealt = rows.select("kind", "key", "size").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(sweep, STATE)


def _matched(parts: list) -> list[tuple[int, int, int, int, int, int]]:
    """Which unplaced documents of each range take which open gaps of larger ranges, the smallest gaps first.

    parts: (part, documents, largest document, open gaps, smallest gap) in order. Output: runs (part,
    first rank, documents, part of the gaps, rank of the first gap, documents in each gap).
    """
    runs, stack = [], []
    for part, docs, largest, gaps, smallest in parts:
        at = 0
        while at < docs and stack:
            where, left, room = stack.pop()
            each = room // largest
            n = min(docs - at, left * each)
            runs.append((part, at, n, where, left - 1, each))
            left -= -(-n // each)
            at += n
            if left:
                stack.append((where, left, room))
        if gaps:
            stack.append((part, gaps, smallest))
    return runs


def best_fit(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence and the offset where each lies, in nearly as few sequences as can be.

    Only documents of more than max_tokens ids are cut: whole sequences, and before them a shorter
    first piece. Pieces shorter than a sequence are packed in rounds. In a round they and the gaps
    (sequences with room) are dealt out by ranges of size; each range is swept from large to small, a
    piece taking the smallest gap that holds it. Pieces left over take gaps left over in larger
    ranges, the smallest first, by their ranks: a run of pieces and a run of gaps are matched as a
    whole, as many pieces in each gap as surely fit. If few were placed, the largest pieces open
    sequences: those over half a sequence, else as many as the rest needs at the least. Counts of each
    range (4096 at most) are all that passes through the driver.

    Output: id, piece (from 0), start, length, ids_crc32, sequence_id, offset and, if asked for, ids.
    Null text: the end id alone. Null ids, equal ids and repeated rows are documents like any others.
    Empty input: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = pieces(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizer, max_tokens, end_id, "id", "text", with_ids, rest_first=True)
    cut = written(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")
    state = cut.where(F.col("length") < max_tokens).select(F.lit(DOC).alias("kind"), "key", F.col("length").cast("int").alias("size"))
    count = state.count()
    placed, waits = [], count > 0
    while waits:
        ranges = min(RANGES, count // RANGE + 1)
        swept = written(_sweep(state, ranges, max_tokens), "swept")
        doc, gap = (F.col("kind") == DOC) & F.col("sequence").isNull(), (F.col("kind") == GAP) & F.col("rank").isNotNull()
        over = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
        found = swept.groupBy("part").agg(
            over(doc).alias("docs"), F.max(F.when(doc, F.col("size"))).alias("largest"), over(gap).alias("gaps"), F.min(F.when(gap, F.col("size"))).alias("smallest"),
            F.sum(F.when(doc, F.col("size"))).alias("tokens"), over(doc & (F.col("size") * 2 > max_tokens)).alias("big"), F.min(F.when(doc, F.col("size"))).alias("least"),
            over((F.col("kind") == DOC) & ~doc).alias("placed"), over(F.col("kind") == GAP).alias("open"),
        ).collect()
        found.sort(key=lambda r: r["part"])
        runs = _matched([(r["part"], r["docs"], r["largest"], r["gaps"], r["smallest"]) for r in found])
        total = sum(r["docs"] for r in found)
        opened: list[tuple[int, int]] = []
        taken = {r["part"]: 0 for r in found}
        for part, at, n, *_ in runs:
            taken[part] = at + n
        opens = 0
        if total > FEW * (sum(r["placed"] for r in found) + sum(n for _, _, n, *_ in runs)):
            tokens = sum(r["tokens"] or 0 for r in found) - sum(taken[r["part"]] * (r["largest"] or 0) for r in found)
            opens = left = sum(max(0, r["big"] - taken[r["part"]]) for r in found) or -(-tokens // max_tokens)
            for r in found:
                n = max(0, min(left, r["docs"] - taken[r["part"]]))
                opened.append((r["part"], taken[r["part"]] + n))
                left -= n
            opens -= left
        least = min((r["least"] for r in found if r["least"]), default=max_tokens)

        # As many rows as there are ranges, twice that at most
        by_run = F.broadcast(spark.createDataFrame(runs, "part int, first int, n int, gap_part int, top int, each int"))
        firsts = F.broadcast(spark.createDataFrame(opened, "part int, opens int"))
        ends = F.broadcast(spark.createDataFrame([*taken.items()], "part int, taken int"))
        unplaced = swept.where(doc).select("key", "size", "part", "rank")
        matched = unplaced.join(by_run, "part").where("rank >= first and rank < first + n")
        gap_rank = F.col("top") - F.floor((F.col("rank") - F.col("first")) / F.col("each"))
        matched = matched.select(F.lit(DOC).alias("kind"), "key", "size", "gap_part", gap_rank.cast("int").alias("gap_rank"), "part", "rank")
        offered = swept.where(gap).select(F.lit(GAP).alias("kind"), "key", "size", F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "part", "rank")
        # A gap and what it takes: one exchange, by a key of few rows
        by_gap = Window.partitionBy("gap_part", "gap_rank").orderBy("kind", "part", "rank")
        used = F.sum(F.when(F.col("kind") == DOC, F.col("size")).otherwise(0))
        took = matched.unionByName(offered).select("kind", "key", "size", F.first("key").over(by_gap).alias("gap"), F.first("size").over(by_gap).alias("room"), used.over(by_gap.rowsBetween(Window.unboundedPreceding, 0)).alias("used"), used.over(by_gap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("full"))
        is_doc = F.col("kind") == DOC
        took = took.select("kind", "key", F.when(is_doc, F.col("size")).otherwise(F.col("room") - F.col("full")).cast("int").alias("size"), F.when(is_doc, F.col("gap")).alias("sequence"), F.when(is_doc, max_tokens - F.col("room") + F.col("used") - F.col("size")).cast("int").alias("offset"))
        rest = unplaced.join(ends, "part").join(firsts, "part", "left").where("rank >= taken")
        begins = F.col("rank") < F.coalesce("opens", F.lit(0))
        rest = rest.select(F.lit(DOC).alias("kind"), "key", "size", F.when(begins, F.col("key")).alias("sequence"), F.when(begins, 0).alias("offset"))
        none = F.lit(None).cast("bigint").alias("sequence"), F.lit(None).cast("int").alias("offset")
        new = rest.where("sequence is not null").select(F.lit(GAP).alias("kind"), F.col("sequence").alias("key"), (max_tokens - F.col("size")).alias("size"), *none)
        kept = swept.where(~doc & ~gap).select("kind", "key", "size", "sequence", "offset")  # placed in the sweep, or gaps that wait
        now = took.unionByName(rest).unionByName(new).unionByName(kept).where((F.col("kind") == DOC) | (F.col("size") >= least))
        result = written(now, "round")
        removed(swept)
        placed.append(result.where(f"kind = {DOC} and sequence is not null").select("key", "sequence", "offset"))
        state = result.where(f"kind = {GAP} or sequence is null").select("kind", "key", "size")
        left = total - sum(n for _, _, n, *_ in runs) - opens
        count, waits = left + sum(r["open"] for r in found) + opens, left > 0
    extra = ("ids",) if with_ids else ()
    size_of = F.lit(max_tokens).cast("bigint")
    number = F.when(F.col("start") == 0, 0).otherwise(F.ceil(F.col("start") / size_of))
    columns = lambda sequence, offset: (F.col("id").alias(id_col), number.cast("int").alias("piece"), "start", "length", "ids_crc32", F.col(sequence).alias("sequence_id"), offset.cast("bigint").alias("offset"), *extra)
    whole = cut.where(F.col("length") == max_tokens).select(*columns("key", F.lit(0)))
    if not placed:
        return whole
    return whole.unionByName(cut.where(F.col("length") < max_tokens).join(reduce(DataFrame.unionByName, placed), "key").select(*columns("sequence", F.col("offset"))))
