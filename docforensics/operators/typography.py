"""Typography of the machine-readable strip: how even the character boxes are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip_start(height: Column) -> Column:
    """First row of the bottom 22 %."""
    return F.floor(height * 0.78).cast("int")


def glyph_filter(glyphs: DataFrame, height: Column, width: Column) -> DataFrame:
    """Glyphs whose area is strictly between max(4, 0.0002 of the strip) and 0.15 of it; strip_h is its height."""
    strip = height - strip_start(height)
    area = strip * width
    kept = glyphs.where((F.col("area") > F.greatest(F.lit(4.0), area * 0.0002)) & (F.col("area") < area * 0.15))
    return kept.withColumn("strip_h", strip)


def _cv(x: Column) -> Column:
    return F.when(F.avg(x) > 0, F.stddev_pop(x) / F.avg(x)).otherwise(1.0)


def glyph_uniformity(glyphs: DataFrame) -> DataFrame:
    """Whether heights, widths and densities vary little: below 0.35, 0.40 and 0.45 of their means."""
    h, w = F.col("bottom") - F.col("top"), F.col("right") - F.col("left")
    d = glyphs.groupBy("scan_id").agg(F.count("*").alias("n"), _cv(h.cast("double")).alias("h"), _cv(w.cast("double")).alias("w"), _cv(F.col("area") / (h * w + 1e-9)).alias("d"))
    return d.select("scan_id", "n", (F.col("h") < 0.35).alias("uniform_height"), (F.col("w") < 0.40).alias("uniform_width"), (F.col("d") < 0.45).alias("uniform_density"))


def _gaps(glyphs: DataFrame, by: str) -> DataFrame:
    """Each glyph with the gap to the one before it, and the scan's median gap."""
    order = Window.partitionBy("scan_id").orderBy(by)
    d = glyphs.select("scan_id", F.col(by).alias("v"), (F.col(by) - F.lag(by).over(order)).alias("gap"), *(["strip_h"] if "strip_h" in glyphs.columns else []))
    median = d.groupBy("scan_id").agg(F.percentile("gap", 0.5).alias("median"), F.count("*").alias("n"))
    return d.join(median, "scan_id")


def glyph_line_alignment(glyphs: DataFrame) -> DataFrame:
    """Lines part where a gap exceeds five medians; their mean deviation must stay below 0.08 of the strip. Above ten glyphs only.

    Glyphs of one height are of one line, whichever of them the gap is counted at.
    """
    order = Window.partitionBy("scan_id").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    d = _gaps(glyphs, "cy").withColumn("line", F.sum(F.coalesce((F.col("gap") > 5 * F.col("median")).cast("int"), F.lit(0))).over(order))
    line = d.groupBy("scan_id", "n", "strip_h", "line").agg(F.stddev_pop("v").alias("s"), F.count("*").alias("m"))
    scan = line.groupBy("scan_id", "n", "strip_h").agg(F.avg(F.when(F.col("m") > 1, F.col("s"))).alias("s"))
    return scan.select("scan_id", ((F.col("n") <= 10) | (F.coalesce("s", F.lit(0.0)) / F.col("strip_h") < 0.08)).alias("horizontal_alignment"))


def glyph_spacing(glyphs: DataFrame) -> DataFrame:
    """Gaps below four medians must vary by less than half their mean; true with three glyphs or fewer, or one gap."""
    normal = F.when(F.col("gap") < 4 * F.col("median"), F.col("gap"))
    d = _gaps(glyphs, "cx").groupBy("scan_id", "n").agg(_cv(normal).alias("cv"), F.count(normal).alias("k"))
    return d.select("scan_id", ((F.col("n") <= 3) | (F.col("k") <= 1) | (F.col("cv") < 0.50)).alias("regular_spacing"))


def font_score(glyphs: DataFrame) -> DataFrame:
    """Share of the six checks that hold, 4 decimals; 0 with fewer than five glyphs."""
    d = glyph_uniformity(glyphs).join(glyph_line_alignment(glyphs), "scan_id").join(glyph_spacing(glyphs), "scan_id")
    flags = ("uniform_height", "uniform_width", "horizontal_alignment", "regular_spacing", "uniform_density")
    passed = sum((F.col(f).cast("int") for f in flags), F.lit(1))
    enough = F.col("n") >= 5
    return d.select("scan_id", enough.alias("enough_components"), *flags, F.when(enough, F.round(passed / 6.0, 4)).otherwise(0.0).alias("score"))
