"""The jobs that the operators form: a table in, a table out. field_mining, spatial_fields and assemble_report are jobs of their own modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import checks, evaluation, forensics, history, mrz, typography
from .operators.fields import field_mining
from .operators.fusion import assemble_report
from .operators.lineage import cut
from .operators.spatial import spatial_fields
from .sources.tables import intake_status
from .streaming.intake import intake_answers, stream_stability, verdict_windows

__all__ = [
    "assemble_report", "consistency_audit", "field_mining", "history_analytics", "intake", "intake_answers", "model_evaluation", "mrz_audit", "pixel_forensics", "spatial_fields", "stream_stability",
    "suspicious_zone_ranking", "typography_audit", "verdict_windows",
]


def intake(uploads: DataFrame, order_col: str = "scan_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): uploads of status 200 with result_of and analysed, and the others with their status.

    uploads: scan_id, ext, length, sha256. Only the first of equal contents is to be analysed.
    """
    checked = intake_status(uploads)
    return history.dedup_scans(checked.where("status = 200"), order_col=order_col), checked.where("status <> 200")


def mrz_audit(candidates: DataFrame) -> DataFrame:
    """The zone of each scan: scan_id, box_idx, variant, mrz_type, valid_score, mrz (the record), score (share of its checks).

    candidates: scan_id, box_idx, variant, raw_text. In each box the best reading, in each scan the
    first valid box or else the best one. Scans without a readable zone have no row.
    """
    best = mrz.best_candidate(mrz.best_variant(mrz.read_zones(candidates)))
    return best.select("scan_id", "box_idx", "variant", "mrz_type", "valid_score", "mrz", mrz.ocr_score(F.col("mrz")).alias("score"))


def consistency_audit(fields: DataFrame, zones: DataFrame, as_of: Column) -> DataFrame:
    """scan_id, mode, score, checks: scans with a zone by all 13 checks of fields against the zone, the others by the visual ones.

    fields: scan_id, the seven fields and country; zones: the same from zones (one row for each scan that has one).
    """
    zones = cut(zones)
    with_zone = checks.mrz_mode_score(checks.mrz_coherence(fields, zones, as_of), checks.logical_consistency(zones, as_of, True))
    without = checks.visual_mode_score(fields.join(zones.select("scan_id"), "scan_id", "left_anti"), as_of)
    return with_zone.select("scan_id", F.lit("mrz").alias("mode"), "score", "checks").unionByName(without.select("scan_id", F.lit("visual").alias("mode"), "score", "checks"))


def pixel_forensics(pixels: DataFrame, diffs: DataFrame, tags: DataFrame, block: int = 32, ela_block: int = 16, ela_quality: int = 3) -> DataFrame:
    """The forensic risk of each scan with its four scores, level, details and summary.

    pixels: scan_id, y, x, lum; diffs: scan_id, q_idx, y, x, diff (to the image saved again at eight
    qualities); tags: scan_id, tags (map). A scan without rows for a module has its neutral score.
    """
    modules = forensics.exif_risk(tags), forensics.ela_score(diffs.where(F.col("q_idx") == ela_quality), ela_block), forensics.ghost_score(diffs, block), forensics.noise_score(pixels, block)
    modules = [cut(m.select("scan_id", "score", "details")) for m in modules]  # each once, for its score and its details
    risk = forensics.metadata_risk(pixels, *modules)
    return risk.join(forensics.metadata_diagnostics(risk, *modules), "scan_id")


def typography_audit(glyphs: DataFrame, height: Column, width: Column) -> DataFrame:
    """The font score of each scan from the boxes of its characters, on a page of that height and width."""
    return typography.font_score(typography.glyph_filter(glyphs, height, width))


def model_evaluation(scored: DataFrame, prob: str = "prob_fake", truth: str = "is_fake", threshold: float = evaluation.THRESHOLD) -> dict[str, DataFrame]:
    """report (precision, recall, F1, support), threshold (of the best F1) and auc of scores against the truth (1: fake)."""
    called = scored.select(F.when(F.col(truth) == 1, "Fake").otherwise("Real").alias("t"), F.when(evaluation.classify(F.col(prob), threshold) == "Falsified", "Fake").otherwise("Real").alias("p"))
    return {"report": evaluation.classification_report(called, "t", "p"), "threshold": evaluation.best_threshold(scored, prob, truth), "auc": evaluation.roc_auc(scored, prob, truth)}


def suspicious_zone_ranking(cells: DataFrame, boxes: DataFrame | None = None, page: DataFrame | None = None, labels: DataFrame | None = None, top: int = 5, side: int = 384) -> DataFrame:
    """The zones of each scan that weigh most, named by where they lie or by the box of the page that they overlap.

    cells: scan_id, y, x, heat, coef and, where components are known, comp_id; else flagged cells are
    joined to components. boxes, page, labels: see relabel_zones_iou and suspicious_zones.
    """
    if "comp_id" not in cells.columns:
        found = evaluation.connected_cells(evaluation.flagged_cells(cells))
        cells = cells.join(found, ["scan_id", "y", "x"], "left")
    zones = evaluation.suspicious_zones(cells, top, labels)
    return zones if boxes is None else evaluation.relabel_zones_iou(zones, boxes, page, side)


def history_analytics(log: DataFrame) -> dict[str, DataFrame]:
    """history (newest first, numbered), replay (the newest scan of each file name), summary and days (counts) of a log of scans."""
    return {"history": history.scan_history(log), "replay": history.replay_lookup(log), "summary": history.verdict_summary(log), "days": history.daily_summary(log)}
