from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docforensics.llm.sharding import histogram_shards


def test_all_rows_once_and_slots_without_gaps(docs, rows):
    out = histogram_shards(docs, shards=5).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 8
    assert all(sorted(x) == [*range(len(x))] for x in slots.values())


def test_sizes_are_nearly_equal_and_copies_stay_together(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1500).cast("string")).alias("text"))
    out = histogram_shards(d, shards=8, tolerance=0.02)
    size = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 8 and max(size) < 1.05 * sum(size) / 8
    assert out.groupBy("text").agg(F.countDistinct("shard").alias("k")).where("k > 1").count() == 0


def test_one_text_in_most_rows_is_dealt_out(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    size = [r["b"] for r in histogram_shards(d, shards=6).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 6 and max(size) < 1.03 * sum(size) / 6


def test_rows_of_one_text_and_no_id_are_dealt_out(spark):
    """90 % of the rows are equal in all columns."""
    d = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 10 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = histogram_shards(d, shards=6).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("k")).collect()
    size = [r["b"] for r in out]
    assert len(size) == 6 and max(size) < 1.03 * sum(size) / 6 and sum(r["n"] for r in out) == 3000
    assert all(r["last"] == r["n"] - 1 == r["k"] - 1 for r in out)


def test_column_names_of_its_own(spark):
    d = spark.createDataFrame([(1, "a", 0, 0)], "h long, tie string, id int, text int")
    assert histogram_shards(d, 3, "h", "tie").columns == ["h", "tie", "size", "shard", "slot"]


def test_a_very_long_text(spark):
    d = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.repeat(F.lit("é"), 500_000)).otherwise("x").alias("text"))
    out = histogram_shards(d, shards=3).collect()
    assert len(out) == 40 and max(r["size"] for r in out) == 1_000_008


def test_empty(empty):
    assert histogram_shards(empty).count() == 0
