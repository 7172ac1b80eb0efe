"""Pixel, recompression and tag forensics: block statistics, four module scores, one risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of editing software, looked for in this order.
EDITORS = ("photoshop", "gimp", "lightroom", "affinity", "pixelmator", "paint.net", "snapseed", "facetune", "meitu", "picsart", "canva", "fotor", "pixlr", "capture one", "darktable", "corel", "inkscape", "illustrator")
#: JPEG qualities that are tried, by q_idx.
QUALITIES = (50, 60, 70, 75, 80, 85, 90, 95)
LOSSLESS, JPEG = (".png", ".bmp", ".tiff", ".tif"), (".jpg", ".jpeg")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def exif_risk(tags: DataFrame, tags_col: str = "tags") -> DataFrame:
    """Score 0 to 100, software found and details, from a map of tags; 50 without tags."""
    tag = lambda k: F.trim(F.coalesce(F.element_at(tags_col, k), F.lit("")))
    software, make, model, orientation, gps = tag("Software"), tag("Make"), tag("Model"), F.coalesce(F.element_at(tags_col, "Orientation"), F.lit("")), F.coalesce(F.element_at(tags_col, "GPSInfo"), F.lit(""))
    original, changed, digitized = tag("DateTimeOriginal"), tag("DateTime"), tag("DateTimeDigitized")
    edited = F.exists(F.array(*map(F.lit, EDITORS)), lambda e: F.contains(F.lower(software), e))
    known = (make != "") & (model != "")
    signals = [
        (edited, 60, F.concat(F.lit("editing software: "), software)),
        ((original != "") & (changed != "") & (original != changed), 25, F.lit("changed after the original date")),
        ((original != "") & (digitized != "") & (original != digitized), 10, F.lit("digitized on another date")),
        (~known & (software != "") & (make == ""), 15, F.lit("software without a device")),
        ((orientation != "") & ~orientation.isin("1", "0"), 5, F.concat(F.lit("orientation "), orientation)),
        (gps != "", 10, F.lit("position present")),
    ]
    points = reduce(lambda a, x: a + F.when(x[0], x[1]).otherwise(0), signals, F.lit(0))
    none = F.col(tags_col).isNull() | (F.size(tags_col) == 0)
    details = F.array_compact(F.array(*(F.when(c, text) for c, _, text in signals)))
    return tags.select(
        "scan_id",
        F.when(none, 50.0).otherwise(F.least(points, F.lit(100)).cast("double")).alias("score"),
        F.when(~none & edited, software).alias("detected_software"),
        F.when(none, F.array(F.lit("no tags"))).otherwise(details).alias("details"),
    )


def block_stats(pixels: DataFrame, size: int, value: str = "lum") -> DataFrame:
    """Mean and population deviation of each block that starts before extent - size (so the last full one is left out)."""
    extent = pixels.groupBy("scan_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    by, bx = F.floor(F.col("y") / size).cast("int"), F.floor(F.col("x") / size).cast("int")
    blocks = pixels.groupBy("scan_id", by.alias("block_y"), bx.alias("block_x")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    kept = blocks.join(extent, "scan_id").where((F.col("block_y") * size < F.col("_h") - size) & (F.col("block_x") * size < F.col("_w") - size))
    return kept.drop("_h", "_w")


def _ratio(std: Column, mean: Column) -> Column:
    return F.when(mean > 1e-6, std / mean).otherwise(0.0)


def ela_score(pairs: DataFrame, size: int = 16, ext_col: str | None = None) -> DataFrame:
    """Error level: pairs has scan_id, y, x and diff (the greatest channel difference after recompression).

    Output of the module scores: scan_id, score and details (texts).
    """
    amplified = pairs.withColumn("_a", F.least(F.col("diff") * 15, F.lit(255.0)))
    blocks = block_stats(amplified, size, "_a")
    scan = blocks.groupBy("scan_id").agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s"))
    share = blocks.join(scan, "scan_id").groupBy("scan_id", "m", "s").agg(F.avg((F.col("mean") > F.col("m") + 2 * F.col("s")).cast("double")).alias("ratio"))
    cv = _ratio(F.col("s"), F.col("m"))
    score = share.select("scan_id", cv.alias("cv"), "ratio", F.least(cv * 40 + F.col("ratio") * 100, F.lit(100.0)).alias("score"))
    keys = ["scan_id", *([ext_col] if ext_col else [])]
    out = amplified.groupBy(*keys).agg(F.avg("_a").alias("mean")).join(score, "scan_id", "left")
    zero = F.col(ext_col).isin(*LOSSLESS) if ext_col else F.lit(False)
    first = F.concat(F.lit("error level: mean "), _shown("mean", 2), F.lit(", variation "), _shown("cv", 3), F.lit(", unusual blocks "), _shown(F.col("ratio") * 100, 1), F.lit(" %"))
    verdict = F.when(F.col("score") >= 40, "areas of high error: possible local retouching").otherwise("error spread evenly")
    details = F.when(zero, F.array(F.lit("error level: lossless format"))).when(F.col("score").isNull(), F.array(F.lit("error level: image too small"))).otherwise(F.array(first, verdict))
    return out.select("scan_id", F.when(zero, 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), details.alias("details"))


def _shown(c, digits: int) -> Column:
    return F.round(c, digits).cast("string")


def ghost_score(diffs: DataFrame, size: int = 32, least_blocks: int = 4) -> DataFrame:
    """Compression ghosts: the quality of least difference at each pixel, most common in each block.

    Ties go to the lowest quality. Output: scan_id, score, dominant_quality, best_quality.
    """
    pixel = diffs.groupBy("scan_id", "y", "x").agg(F.min_by("q_idx", F.struct("diff", "q_idx")).alias("q"))
    extent = pixel.groupBy("scan_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    by, bx = F.floor(F.col("y") / size).cast("int"), F.floor(F.col("x") / size).cast("int")
    counted = pixel.groupBy("scan_id", by.alias("block_y"), bx.alias("block_x"), "q").agg(F.count("*").alias("n"))
    block = counted.groupBy("scan_id", "block_y", "block_x").agg(F.min_by("q", F.struct(-F.col("n"), F.col("q"))).alias("q")).join(extent, "scan_id")
    block = block.where((F.col("block_y") * size < F.col("_h") - size) & (F.col("block_x") * size < F.col("_w") - size))
    per_q = block.groupBy("scan_id", "q").agg(F.count("*").alias("n"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss"))
    total = per_q.groupBy("scan_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min_by("q", F.struct(-F.col("n"), F.col("q"))).alias("dominant"))
    best = diffs.groupBy("scan_id", "q_idx").agg(F.avg("diff").alias("d")).groupBy("scan_id").agg(F.min_by("q_idx", F.struct("d", "q_idx")).alias("best"))
    quality = lambda c: F.element_at(F.array(*map(F.lit, QUALITIES)), c + 1)
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    raw = F.least(std * 25, F.lit(100.0))
    q = quality(F.col("dominant"))
    score = F.least(raw + F.when(q <= 70, 15).when(q <= 80, 8).otherwise(0), F.lit(100.0))
    out = best.join(total, "scan_id", "left")
    small = F.coalesce("n", F.lit(0)) < least_blocks
    shown = F.concat(F.lit("ghosts: dominant quality "), q.cast("string"), F.lit(", deviation "), _shown(std, 2))
    uneven = F.concat(F.lit("quality differs between areas (best overall "), quality(F.col("best")).cast("string"), F.lit(")"))
    details = F.when(small, F.array(F.lit("ghosts: image too small"))).otherwise(F.array(shown, F.when(score >= 35, uneven).otherwise("compression fairly uniform")))
    return out.select("scan_id", F.when(small, 0.0).otherwise(score).alias("score"), q.alias("dominant_quality"), quality(F.col("best")).alias("best_quality"), details.alias("details"))


def noise_score(pixels: DataFrame, size: int = 32, least_blocks: int = 4) -> DataFrame:
    """Local noise: how uneven the blocks' deviations are, and the share that is far off."""
    blocks = block_stats(pixels, size)
    scan = blocks.groupBy("scan_id").agg(F.count("*").alias("n"), F.avg("std").alias("m"), F.stddev_pop("std").alias("s"))
    low = (F.col("std") < F.greatest(F.col("m") - 2 * F.col("s"), F.lit(0.5))).cast("double")
    high = (F.col("std") > F.col("m") + 2.5 * F.col("s")).cast("double")
    share = blocks.join(scan, "scan_id").groupBy("scan_id", "n", "m", "s").agg(F.avg(low).alias("low"), F.avg(high).alias("high"))
    cv, ratio = _ratio(F.col("s"), F.col("m")), F.col("low") + F.col("high")
    score = share.select("*", F.when(F.col("n") < least_blocks, 0.0).otherwise(F.least(cv * 30 + ratio * 80, F.lit(100.0))).alias("score"))
    out = pixels.select("scan_id").distinct().join(score, "scan_id", "left")
    shown = F.concat(F.lit("noise: grain "), _shown("m", 2), F.lit(", variation "), _shown(cv, 3), F.lit(", unusual areas "), _shown(ratio * 100, 1), F.lit(" %"))
    more = [F.when(F.col("low") > 0.05, "unusually smooth areas"), F.when(F.col("high") > 0.05, "very noisy areas"), F.when(F.col("score") < 20, "grain fairly even")]
    small = F.coalesce("n", F.lit(0)) < least_blocks
    details = F.when(small, F.array(F.lit("noise: image too small"))).otherwise(F.array_compact(F.array(shown, *more)))
    return out.select("scan_id", F.coalesce("score", F.lit(0.0)).alias("score"), details.alias("details"))


def heat_normalize(blocks: DataFrame, value: str, deviation: bool) -> DataFrame:
    """Heat 0 to 1 in each scan: the value, or three times its distance from the mean, over the greatest."""
    scan = Window.partitionBy("scan_id")
    v = F.abs(F.col(value) - F.avg(value).over(scan)) * 3 if deviation else F.col(value)
    d = blocks.withColumn("_v", v)
    top = F.max("_v").over(scan)
    return d.withColumn("heat", F.when(top > 1e-6, F.col("_v") / top).otherwise(0.0)).drop("_v")


def metadata_risk(scans: DataFrame, exif: DataFrame, ela: DataFrame, ghost: DataFrame, noise: DataFrame) -> DataFrame:
    """0.20 tags, 0.35 error level, 0.25 ghosts, 0.20 noise; a missing module counts 0, missing tags 50."""
    out = scans.select("scan_id").distinct()
    for name, d in (("exif", exif), ("ela", ela), ("ghost", ghost), ("noise", noise)):
        out = out.join(d.select("scan_id", F.col("score").alias(f"{name}_score")), "scan_id", "left")
    out = out.fillna({"exif_score": 50.0, "ela_score": 0.0, "ghost_score": 0.0, "noise_score": 0.0})
    total = F.least(F.col("exif_score") * 0.20 + F.col("ela_score") * 0.35 + F.col("ghost_score") * 0.25 + F.col("noise_score") * 0.20, F.lit(100.0))
    level = F.when(total >= 70, "Critical").when(total >= 50, "High").when(total >= 30, "Moderate").otherwise("Low")
    return out.select("*", F.round(total / 100, 4).alias("score"), F.round(total, 2).alias("composite_risk_percent"), level.alias("risk_level"))


def metadata_diagnostics(risk: DataFrame, *modules: DataFrame) -> DataFrame:
    """Details of the modules in the order given, and a summary by the level of risk."""
    out = risk
    for i, m in enumerate(modules):
        out = out.join(m.select("scan_id", F.col("details").alias(f"_d{i}")), "scan_id", "left")
    empty = F.array().cast("array<string>")
    joined = F.concat(*(F.coalesce(f"_d{i}", empty) for i in range(len(modules))))
    p = F.col("composite_risk_percent")
    summary = F.when(p >= 50, "several forensic signals point to a high risk").when(p >= 30, "some slight or ambiguous anomalies").otherwise("nothing very suspicious")
    return out.select("scan_id", joined.alias("diagnostic"), summary.alias("summary"))


def frame_quality(pixels: DataFrame, rect: tuple[int, int, int, int], step: int, corner: int, inset: int, least_variance: float = 600.0, lit_above: float = 40.0) -> DataFrame:
    """Sharpness and lighting inside a rectangle (x, y, w, h): every step-th pixel, and four corners.

    Production: 72 % of the width at 1.586 to 1, step 4, corners of 20 px, 10 px inside.
    """
    x0, y0, w, h = rect
    inside = F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)
    d = pixels.where(inside)
    taken = F.when(((F.col("y") - y0) * w + F.col("x") - x0) % step == 0, F.col("lum"))
    lefts, tops = (x0 + inset, x0 + w - inset - corner), (y0 + inset, y0 + h - inset - corner)
    corners = [F.avg(F.when(F.col("x").between(a, a + corner - 1) & F.col("y").between(b, b + corner - 1), F.col("lum"))) for b in tops for a in lefts]
    lit = reduce(lambda a, b: a & b, (c > lit_above for c in corners))
    mean, square = F.avg(taken), F.avg(taken * taken)
    out = d.groupBy("scan_id").agg(mean.alias("mean"), (square - mean * mean).alias("variance"), F.coalesce(lit, F.lit(False)).alias("corners_lit"))
    return out.withColumn("ok", (F.col("variance") > least_variance) & F.col("corners_lit"))
