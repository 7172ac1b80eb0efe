"""Queries of whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import jobs
from ..fixtures import fx
from . import forensics, mrz, reports
from .mrz import _AS_OF
from .registry import query


@query(
    f"""select scan_id, box_idx, variant, valid_score from ({mrz._BEST_VARIANT}) where valid_score > 0
  qualify row_number() over (partition by scan_id order by case when valid_score = 100 then 0 else 1 end, case when valid_score = 100 then box_idx end, valid_score desc, box_idx desc) = 1"""
)
def mrz_audit(spark, sf_dir):
    return jobs.mrz_audit(fx(spark, sf_dir, "fx_mrz_candidates")).select("scan_id", "box_idx", "variant", "valid_score")


@query(
    f"""select scan_id, 'mrz' as mode, score from ({reports._MRZ_MODE}) where scan_id % 3 = 0
  union all select scan_id, 'visual', round(least({reports._VISUAL_POINTS}, 0.85), 4) from ({reports._VISUAL_CHECKS}) where scan_id % 3 <> 0"""
)
def consistency_audit(spark, sf_dir):
    """Every third scan has a zone."""
    zones = reports.records(spark, sf_dir).where("scan_id % 3 = 0")
    return jobs.consistency_audit(fx(spark, sf_dir, "fx_fields"), zones, _AS_OF()).select("scan_id", "mode", "score")


@query(forensics.RISK_SQL)
def pixel_forensics(spark, sf_dir):
    d = jobs.pixel_forensics(fx(spark, sf_dir, "fx_pixels"), fx(spark, sf_dir, "fx_recompress"), forensics.tag_maps(spark, sf_dir), forensics.SIZE, forensics.SIZE)
    return d.select("scan_id", "score", "risk_level")


@query(forensics.FONT_SQL)
def typography_audit(spark, sf_dir):
    d = jobs.typography_audit(fx(spark, sf_dir, "fx_glyphs"), F.lit(forensics._HEIGHT), F.lit(forensics._WIDTH))
    return d.select("scan_id", "enough_components", "score")


@query(
    """with s as (select page_id, html, strlen(html) as n, case when regexp_extract(url, '[^/.](\\.[^./]*)$', 1) = '' then '.jpg' else lower(regexp_extract(url, '[^/.](\\.[^./]*)$', 1)) end as ext from pages),
  k as (select * from s where ext in ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp') and n <= 20971520 and n > 0)
  select page_id as scan_id, min(page_id) over (partition by html) as result_of, page_id = min(page_id) over (partition by html) as analysed from k"""
)
def intake(spark, sf_dir):
    from ..sources import tables

    d = fx(spark, sf_dir, "pages").select(F.col("page_id").alias("scan_id"), tables.extension(F.col("url")).alias("ext"), F.octet_length("html").alias("length"), F.sha2("html", 256).alias("sha256"))
    return jobs.intake(d)[0].select("scan_id", "result_of", "analysed")
