"""Weighted fusion of module scores into a verdict, and the report of each scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unit(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)


#: Weights of modules with a zone and without one, and the least scores of the verdicts.
STRUCTURAL = {True: {"mrz": 0.40, "fields": 0.40, "font": 0.20}, False: {"fields": 0.55, "font": 0.30, "mrz": 0.15}}
GLOBAL = {True: {"visual": 0.50, "structural": 0.30, "metadata": 0.20}, False: {"visual": 0.55, "structural": 0.25, "metadata": 0.20}}
VERDICTS = (("Authentic", 0.75), ("Suspicious", 0.50))


def _weighted(found: Column, weights: dict[bool, dict[str, float]], **parts: Column) -> Column:
    with_zone, without = (sum((parts[k] * w for k, w in weights[f].items()), F.lit(0.0)) for f in (True, False))
    return _unit(F.when(found, with_zone).otherwise(without))


def structural_score(mrz_found: Column, mrz: Column, fields: Column, font: Column) -> Column:
    return _weighted(mrz_found, STRUCTURAL, mrz=mrz, fields=fields, font=font)


def visual_score(label: Column, confidence: Column) -> Column:
    return _unit(F.when(label == "Real", confidence).when(label == "Falsified", 1.0 - confidence).otherwise(0.5))


def global_score(mrz_found: Column, visual: Column, structural: Column, metadata_risk: Column) -> Column:
    return _weighted(mrz_found, GLOBAL, visual=visual, structural=structural, metadata=1.0 - metadata_risk)


def verdict(score: Column) -> Column:
    out = F.lit("Fake")
    for name, least in reversed(VERDICTS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def assemble_report(scans: DataFrame, ocr: DataFrame, fields: DataFrame, font: DataFrame, model: DataFrame, metadata: DataFrame) -> DataFrame:
    """One nested report for each scan, with neutral values for modules that gave none.

    ocr: score, mrz_found; fields: score, checks; font: score; model: label, confidence;
    metadata: score (risk). A missing ocr row counts 0.4 without a zone, a null mrz_found is true;
    a missing model row gives 0.5; missing fields, font and metadata count 0.5, 0 and 0.
    """
    out = scans.select("scan_id").distinct()
    mark = lambda d, n, *cols: d.select("scan_id", F.lit(True).alias(f"_{n}"), *(F.col(c).alias(f"{n}_{c}") for c in cols))
    for d in (mark(ocr, "ocr", "score", "mrz_found"), mark(fields, "fields", "score", "checks"), mark(font, "font", "score"), mark(model, "model", "label", "confidence"), mark(metadata, "metadata", "score")):
        out = out.join(d, "scan_id", "left")
    found = F.when(F.col("_ocr"), F.coalesce("ocr_mrz_found", F.lit(True))).otherwise(False)
    out = out.select(
        "scan_id", found.alias("mrz_found"), F.coalesce("ocr_score", F.lit(0.4)).alias("mrz_score"), F.coalesce("fields_score", F.lit(0.5)).alias("fields_score"), "fields_checks",
        F.coalesce("font_score", F.lit(0.0)).alias("font_score"), F.coalesce("model_label", F.lit("Unknown")).alias("label"), F.coalesce("model_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("metadata_score", F.lit(0.0)).alias("metadata_risk"),
    )
    out = out.withColumn("structural_score", structural_score(F.col("mrz_found"), F.col("mrz_score"), F.col("fields_score"), F.col("font_score")))
    out = out.withColumn("visual_score", visual_score(F.col("label"), F.col("confidence")))
    out = out.withColumn("global_score", global_score(F.col("mrz_found"), F.col("visual_score"), F.col("structural_score"), F.col("metadata_risk")))
    return out.select(
        "scan_id", "global_score", F.round(F.col("global_score") * 100, 2).alias("global_score_display"), verdict(F.col("global_score")).alias("verdict"), "structural_score", "visual_score", "mrz_found",
        F.struct("mrz_score").alias("ocr"), F.struct(F.col("fields_score").alias("score"), F.col("fields_checks").alias("checks")).alias("ocr_fields"), F.struct(F.col("font_score").alias("score")).alias("font"),
        F.struct("label", "confidence").alias("cnn"), F.struct(F.col("metadata_risk").alias("score")).alias("metadata"),
    )


def module_timings(timings: DataFrame, modules: list[str]) -> DataFrame:
    """p50, p95 and maximum of each module's seconds, 3 decimals; timings has a column for each module."""
    long = timings.unpivot([], modules, "module", "seconds")
    return long.groupBy("module").agg(*(F.round(f, 3).alias(n) for f, n in ((F.percentile("seconds", 0.5), "p50"), (F.percentile("seconds", 0.95), "p95"), (F.max("seconds"), "most"))))
