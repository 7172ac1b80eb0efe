"""Functions of columns, in one place: each takes columns and returns a column, and stays inside Spark's generated code."""

from ..operators.checks import choose_display_source, country_known, field_quality_score, visual_date
from ..operators.evaluation import classify, confidence, risk_level, temperature_scale, zone_name
from ..operators.fields import clean_name, clean_token, is_plausible, normalize_text, reading_score, sanitize
from ..operators.forensics import luminance
from ..operators.fusion import global_score, structural_score, verdict, visual_score
from ..operators.history import content_hash, extra_fields
from ..operators.mrz import check_digit, date_valid, display_date, fix_ocr, guess_type, mrz_date, needs_rotation, ocr_score, parse, split_lines
from ..operators.spatial import clean_reading, normalize_by_template, score_field_value

__all__ = [
    "check_digit", "choose_display_source", "classify", "clean_name", "clean_reading", "clean_token", "confidence", "content_hash", "country_known", "date_valid", "display_date", "extra_fields",
    "field_quality_score", "fix_ocr", "global_score", "guess_type", "is_plausible", "luminance", "mrz_date", "needs_rotation", "normalize_by_template", "normalize_text", "ocr_score", "parse",
    "reading_score", "risk_level", "sanitize", "score_field_value", "split_lines", "structural_score", "temperature_scale", "verdict", "visual_date", "visual_score", "zone_name",
]
