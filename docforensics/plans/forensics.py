"""Queries of the jobs pixel_forensics and typography."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import forensics as op
from ..operators import typography as ty
from .registry import query

#: The fixture has 8 x 8 pixels, so blocks are of 2.
SIZE = 2


@query("select vec_id as scan_id, round(0.299 * v[1] + 0.587 * v[2] + 0.114 * v[3], 4) as lum from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)")
def luminance(spark, sf_dir):
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return fx(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scan_id"), F.round(op.luminance(v(0), v(1), v(2)), 4).alias("lum"))


def tag_maps(spark, sf_dir):
    names = {"Software": "software", "Make": "make", "Model": "model", "DateTimeOriginal": "dt_original", "DateTime": "dt", "DateTimeDigitized": "dt_digitized", "Orientation": "orientation", "GPSInfo": "gps"}
    pairs = [x for k, c in names.items() for x in (F.lit(k), F.col(c))]
    # Every 17th scan has no tags
    return fx(spark, sf_dir, "fx_exif").select("scan_id", F.when(F.col("scan_id") % 17 != 0, F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())).alias("tags"))


_S = "coalesce(trim(software), '')"
_EXIF = f"""select scan_id, case when scan_id % 17 = 0 then 50.0::double else cast(least(100,
    (case when {" or ".join(f"contains(lower({_S}), '{e}')" for e in op.EDITORS)} then 60 else 0 end)
  + (case when dt_original <> '' and dt <> '' and dt_original <> dt then 25 else 0 end)
  + (case when dt_original <> '' and dt_digitized <> '' and dt_original <> dt_digitized then 10 else 0 end)
  + (case when not (make <> '' and model <> '') and {_S} <> '' and make = '' then 15 else 0 end)
  + (case when orientation <> '' and orientation not in ('0', '1') then 5 else 0 end)
  + (case when gps <> '' then 10 else 0 end)) as double) end as score,
  case when scan_id % 17 <> 0 and contains(lower({_S}), 'photoshop') then {_S} end as detected_software from fx_exif"""


@query(_EXIF)
def exif_risk(spark, sf_dir):
    return op.exif_risk(tag_maps(spark, sf_dir)).select("scan_id", "score", "detected_software")


@query("select scan_id, len(map_keys(m)) as n_tags, m['Software'] as software from (select scan_id, map_from_entries(list_filter([('Software', software), ('Make', make), ('Orientation', orientation)], lambda e: e[2] is not null)) as m from fx_exif)")
def read_exif(spark, sf_dir):
    from ..sources.tables import read_exif as read

    packed = fx(spark, sf_dir, "fx_exif").select("scan_id", F.to_json(F.struct(F.col("software").alias("Software"), F.col("make").alias("Make"), F.col("orientation").alias("Orientation"))).alias("tags"))
    return read(packed).select("scan_id", F.size("tags").cast("bigint").alias("n_tags"), F.element_at("tags", "Software").alias("software"))


def _blocks_sql(source: str, value: str) -> str:
    return f"""select b.scan_id, block_y, block_x, mean, std from (
      select scan_id, cast(y // {SIZE} as int) as block_y, cast(x // {SIZE} as int) as block_x, avg({value}) as mean, stddev_pop({value}) as std from {source} group by 1, 2, 3) b
      join (select scan_id, max(y) + 1 as h, max(x) + 1 as w from {source} group by 1) e on b.scan_id = e.scan_id
      where block_y * {SIZE} < h - {SIZE} and block_x * {SIZE} < w - {SIZE}"""


@query(f"select scan_id, block_y, block_x, round(mean, 4) as mean, round(std, 4) as std from ({_blocks_sql('fx_pixels', 'lum')})")
def block_stats(spark, sf_dir):
    d = op.block_stats(fx(spark, sf_dir, "fx_pixels"), SIZE)
    return d.select("scan_id", "block_y", "block_x", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


_n = lambda c, digits: f"cast(round(({c})::double, {digits}) as varchar)"
_ELA_IN = "(select scan_id, y, x, least(diff * 15, 255) as a from fx_recompress where q_idx = 3)"
_ELA = f"""with bl as ({_blocks_sql(_ELA_IN, "a")}), sc as (select scan_id, avg(mean) as m, stddev_pop(mean) as s from bl group by 1)
  select scan_id, s, m, avg(case when mean > m + 2 * s then 1.0 else 0.0 end) as ratio, least((case when m > 1e-6 then s / m else 0 end) * 40 + avg(case when mean > m + 2 * s then 1.0 else 0.0 end) * 100, 100) as score
  from bl join sc using (scan_id) group by scan_id, m, s"""


@query(f"select scan_id, round(score, 4) as score from ({_ELA})")
def ela_score(spark, sf_dir):
    d = op.ela_score(fx(spark, sf_dir, "fx_recompress").where("q_idx = 3"), SIZE)
    return d.select("scan_id", F.round("score", 4).alias("score"))


_GHOST = f"""with px as (select scan_id, y, x, arg_min(q_idx, diff * 1000000 + q_idx * 1e-9) as q0, min(diff) as d from fx_recompress group by 1, 2, 3),
  q as (select r.scan_id, r.y, r.x, min(r.q_idx) as q from fx_recompress r join px on r.scan_id = px.scan_id and r.y = px.y and r.x = px.x and r.diff = px.d group by 1, 2, 3),
  c as (select scan_id, y // {SIZE} as block_y, x // {SIZE} as block_x, q, count(*) as n from q group by all),
  b as (select scan_id, block_y, block_x, q from c where block_y * {SIZE} < 8 - {SIZE} and block_x * {SIZE} < 8 - {SIZE} qualify row_number() over (partition by scan_id, block_y, block_x order by n desc, q) = 1),
  d as (select scan_id, q as dominant from (select scan_id, q, count(*) as n from b group by all) qualify row_number() over (partition by scan_id order by n desc, q) = 1),
  s as (select scan_id, stddev_pop(q) as std from b group by 1),
  g as (select scan_id, q_idx as best from (select scan_id, q_idx, avg(diff) as a from fx_recompress group by all) qualify row_number() over (partition by scan_id order by a, q_idx) = 1)
  select scan_id, least(least(std * 25, 100) + (case when ql[dominant + 1] <= 70 then 15 when ql[dominant + 1] <= 80 then 8 else 0 end), 100) as score, ql[dominant + 1] as dominant_quality, ql[best + 1] as best_quality, std
  from d join s using (scan_id) join g using (scan_id), (select [50, 60, 70, 75, 80, 85, 90, 95] as ql)"""


@query(f"select scan_id, round(score, 4) as score, dominant_quality, best_quality from ({_GHOST})")
def ghost_score(spark, sf_dir):
    d = op.ghost_score(fx(spark, sf_dir, "fx_recompress"), SIZE)
    return d.select("scan_id", F.round("score", 4).alias("score"), "dominant_quality", "best_quality")


_NOISE = f"""with bl as ({_blocks_sql("fx_pixels", "lum")}), sc as (select scan_id, avg(std) as m, stddev_pop(std) as s from bl group by 1)
  select scan_id, m, s, avg(case when std < greatest(m - 2 * s, 0.5) then 1.0 else 0.0 end) as low, avg(case when std > m + 2.5 * s then 1.0 else 0.0 end) as high, least((case when m > 1e-6 then s / m else 0 end) * 30 + avg((case when std < greatest(m - 2 * s, 0.5) then 1.0 else 0.0 end) + (case when std > m + 2.5 * s then 1.0 else 0.0 end)) * 80, 100) as score
  from bl join sc using (scan_id) group by scan_id, m, s"""


@query(f"select scan_id, round(score, 4) as score from ({_NOISE})")
def noise_score(spark, sf_dir):
    return op.noise_score(fx(spark, sf_dir, "fx_pixels"), SIZE).select("scan_id", F.round("score", 4).alias("score"))


@query(f"with bl as ({_blocks_sql('fx_pixels', 'lum')}), v as (select *, abs(std - avg(std) over (partition by scan_id)) * 3 as d from bl) select scan_id, block_y, block_x, round(case when max(mean) over (partition by scan_id) > 1e-6 then mean / max(mean) over (partition by scan_id) else 0 end, 4) as level, round(case when max(d) over (partition by scan_id) > 1e-6 then d / max(d) over (partition by scan_id) else 0 end, 4) as heat from v")
def heat_normalize(spark, sf_dir):
    blocks = op.block_stats(fx(spark, sf_dir, "fx_pixels"), SIZE)
    level = op.heat_normalize(blocks, "mean", False).withColumnRenamed("heat", "level")
    return op.heat_normalize(level, "std", True).select("scan_id", "block_y", "block_x", F.round("level", 4).alias("level"), F.round("heat", 4).alias("heat"))


def risk(spark, sf_dir):
    """Tags of the first events stand for those of the scans with the same number."""
    pixels, diffs = fx(spark, sf_dir, "fx_pixels"), fx(spark, sf_dir, "fx_recompress")
    exif = op.exif_risk(tag_maps(spark, sf_dir))
    return op.metadata_risk(pixels, exif, op.ela_score(diffs.where("q_idx = 3"), SIZE), op.ghost_score(diffs, SIZE), op.noise_score(pixels, SIZE))


RISK_SQL = f"""select s.scan_id, round(t / 100, 4) as score, case when t >= 70 then 'Critical' when t >= 50 then 'High' when t >= 30 then 'Moderate' else 'Low' end as risk_level from (
  select p.scan_id, least(coalesce(x.score, 50) * 0.20::double + coalesce(e.score, 0) * 0.35::double + coalesce(g.score, 0) * 0.25::double + coalesce(n.score, 0) * 0.20::double, 100) as t
  from (select distinct scan_id from fx_pixels) p left join ({_EXIF}) x on p.scan_id = x.scan_id left join ({_ELA}) e on p.scan_id = e.scan_id left join ({_GHOST}) g on p.scan_id = g.scan_id left join ({_NOISE}) n on p.scan_id = n.scan_id) s"""


@query(RISK_SQL)
def metadata_risk(spark, sf_dir):
    return risk(spark, sf_dir).select("scan_id", "score", "risk_level")


@query(
    f"""select r.scan_id, case when risk_level in ('Critical', 'High') then 'several forensic signals point to a high risk' when risk_level = 'Moderate' then 'some slight or ambiguous anomalies' else 'nothing very suspicious' end as summary,
  concat_ws('; ', case when x.scan_id % 17 = 0 then 'no tags' else nullif(concat_ws('; ', case when contains(lower({_S}), 'photoshop') then concat('editing software: ', {_S}) end,
    case when dt_original <> '' and dt <> '' and dt_original <> dt then 'changed after the original date' end, case when dt_original <> '' and dt_digitized <> '' and dt_original <> dt_digitized then 'digitized on another date' end,
    case when not (make <> '' and model <> '') and {_S} <> '' and make = '' then 'software without a device' end, case when orientation not in ('', '0', '1') then concat('orientation ', orientation) end, case when gps <> '' then 'position present' end), '') end,
    concat('error level: mean ', {_n('ea', 2)}, ', variation ', {_n('case when e.m > 1e-6 then e.s / e.m else 0::double end', 3)}, ', unusual blocks ', {_n('e.ratio * 100', 1)}, ' %'), case when e.score >= 40 then 'areas of high error: possible local retouching' else 'error spread evenly' end,
    concat('ghosts: dominant quality ', g.dominant_quality, ', deviation ', {_n('g.std', 2)}), case when g.score >= 35 then concat('quality differs between areas (best overall ', g.best_quality, ')') else 'compression fairly uniform' end,
    concat('noise: grain ', {_n('n.m', 2)}, ', variation ', {_n('case when n.m > 1e-6 then n.s / n.m else 0::double end', 3)}, ', unusual areas ', {_n('(n.low + n.high) * 100', 1)}, ' %'),
    case when n.low > 0.05 then 'unusually smooth areas' end, case when n.high > 0.05 then 'very noisy areas' end, case when n.score < 20 then 'grain fairly even' end) as diagnostic
  from ({RISK_SQL}) r join fx_exif x on r.scan_id = x.scan_id join ({_ELA}) e on r.scan_id = e.scan_id join (select scan_id, avg(a) as ea from {_ELA_IN} group by scan_id) a on a.scan_id = r.scan_id join ({_GHOST}) g on r.scan_id = g.scan_id join ({_NOISE}) n on r.scan_id = n.scan_id"""
)
def metadata_diagnostics(spark, sf_dir):
    """The details of all four modules as one text. Scans without tags have none of that module."""
    pixels, diffs = fx(spark, sf_dir, "fx_pixels"), fx(spark, sf_dir, "fx_recompress")
    modules = op.exif_risk(tag_maps(spark, sf_dir)), op.ela_score(diffs.where("q_idx = 3"), SIZE), op.ghost_score(diffs, SIZE), op.noise_score(pixels, SIZE)
    d = op.metadata_diagnostics(op.metadata_risk(pixels, *modules), *modules)
    return d.join(modules[0].select("scan_id"), "scan_id", "left_semi").select("scan_id", "summary", F.array_join("diagnostic", "; ").alias("diagnostic"))


_RECT = (1, 1, 6, 6)
_FRAME = """select scan_id, round(m, 4) as mean, round(q - m * m, 4) as variance, (a > 40 and b > 40 and c > 40 and d > 40) as corners_lit, (q - m * m > 600 and a > 40 and b > 40 and c > 40 and d > 40) as ok from (
  select scan_id, avg(lum) filter (((y - 1) * 6 + x - 1) % 4 = 0) as m, avg(lum * lum) filter (((y - 1) * 6 + x - 1) % 4 = 0) as q,
  avg(lum) filter (x between 1 and 2 and y between 1 and 2) as a, avg(lum) filter (x between 5 and 6 and y between 1 and 2) as b,
  avg(lum) filter (x between 1 and 2 and y between 5 and 6) as c, avg(lum) filter (x between 5 and 6 and y between 5 and 6) as d
  from fx_pixels where x between 1 and 6 and y between 1 and 6 group by scan_id)"""


@query(_FRAME)
def frame_quality(spark, sf_dir):
    d = op.frame_quality(fx(spark, sf_dir, "fx_pixels"), _RECT, 4, 2, 0)
    return d.select("scan_id", F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"), "corners_lit", "ok")


_HEIGHT, _WIDTH = 727, 2000  # the strip is 160 high


def strip(spark, sf_dir):
    return ty.glyph_filter(fx(spark, sf_dir, "fx_glyphs"), F.lit(_HEIGHT), F.lit(_WIDTH))


_KEPT = 'select *, 160 as strip_h from fx_glyphs where area > greatest(4.0, 160 * 2000 * 0.0002) and area < 160 * 2000 * 0.15'


@query(f"select scan_id, cast(count(*) as bigint) as n, round(sum(area), 4) as area from ({_KEPT}) group by scan_id")
def glyph_filter(spark, sf_dir):
    return strip(spark, sf_dir).groupBy("scan_id").agg(F.count("*").alias("n"), F.round(F.sum("area"), 4).alias("area"))


_cv = lambda x: f"(case when avg({x}) > 0 then stddev_pop({x}) / avg({x}) else 1 end)"
_UNIFORM = f"""select scan_id, cast(count(*) as bigint) as n, {_cv('h')} < 0.35 as uniform_height, {_cv('w')} < 0.40 as uniform_width, {_cv('(area / (h * w + 1e-9))')} < 0.45 as uniform_density
  from (select scan_id, area, cast(bottom - top as double) as h, cast("right" - "left" as double) as w from ({_KEPT})) group by scan_id"""


@query(_UNIFORM)
def glyph_uniformity(spark, sf_dir):
    return ty.glyph_uniformity(strip(spark, sf_dir))


_ALIGN = f"""with g as (select scan_id, cy, cy - lag(cy) over (partition by scan_id order by cy) as gap from ({_KEPT})),
  m as (select scan_id, quantile_cont(gap, 0.5) as med, count(*) as n from g group by 1),
  l as (select g.scan_id, n, cy, sum(case when gap > 5 * med then 1 else 0 end) over (partition by g.scan_id order by cy rows unbounded preceding) as line from g join m on g.scan_id = m.scan_id),
  s as (select scan_id, n, line, stddev_pop(cy) as s, count(*) as k from l group by all)
  select scan_id, n <= 10 or coalesce(avg(s) filter (k > 1), 0) / 160 < 0.08 as horizontal_alignment from s group by scan_id, n"""


@query(_ALIGN)
def glyph_line_alignment(spark, sf_dir):
    return ty.glyph_line_alignment(strip(spark, sf_dir))


_SPACE = f"""with g as (select scan_id, cx - lag(cx) over (partition by scan_id order by cx) as gap from ({_KEPT})),
  m as (select scan_id, quantile_cont(gap, 0.5) as med, count(*) as n from g group by 1),
  k as (select g.scan_id, n, case when gap < 4 * med then gap end as v from g join m on g.scan_id = m.scan_id)
  select scan_id, (n <= 3 or count(v) <= 1 or {_cv('v')} < 0.50) as regular_spacing from k group by scan_id, n"""


@query(_SPACE)
def glyph_spacing(spark, sf_dir):
    return ty.glyph_spacing(strip(spark, sf_dir))


FONT_SQL = f"""select u.scan_id, u.n >= 5 as enough_components, case when u.n >= 5 then round((1 + cast(uniform_height as int) + cast(uniform_width as int) + cast(uniform_density as int) + cast(horizontal_alignment as int) + cast(regular_spacing as int)) / 6.0::double, 4) else 0 end as score
  from ({_UNIFORM}) u join ({_ALIGN}) a on u.scan_id = a.scan_id join ({_SPACE}) p on u.scan_id = p.scan_id"""


@query(FONT_SQL.replace("order by cy rows unbounded preceding", "order by cy range unbounded preceding"))  # glyphs of one height are of one line
def font_score(spark, sf_dir):
    return ty.font_score(strip(spark, sf_dir)).select("scan_id", "enough_components", "score")
