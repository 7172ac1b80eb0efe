"""Queries of the jobs model_evaluation and suspicious_zone_ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import evaluation as op
from .registry import query

_LABEL = "case when prob_fake >= 0.54 then 'Falsified' else 'Real' end"
_T = 2.0
_CAL = "1 / (1 + exp(-ln(greatest(least(prob_fake, 1 - 1e-6), 1e-6) / (1 - greatest(least(prob_fake, 1 - 1e-6), 1e-6))) / 2.0))"


def scores(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_scores")
    d = d.withColumn("label", op.classify(F.col("prob_fake"))).withColumn("calibrated", op.temperature_scale(F.col("prob_fake"), _T))
    d = d.withColumn("confidence", op.confidence(F.col("label"), F.col("calibrated")))
    return d.withColumn("risk", op.risk_level(F.col("label"), F.col("confidence")))


@query(f"select scan_id, {_LABEL} as label from fx_scores")
def classify(spark, sf_dir):
    return scores(spark, sf_dir).select("scan_id", "label")


@query(f"select scan_id, round({_CAL}, 6) as calibrated from fx_scores")
def temperature_scale(spark, sf_dir):
    return scores(spark, sf_dir).select("scan_id", F.round("calibrated", 6).alias("calibrated"))


@query(
    f"""select scan_id, label, round(c, 6) as confidence, case when label = 'Falsified' then (case when c >= 0.8 then 'High' when c >= 0.5 then 'Medium' else 'Low' end)
  else (case when c >= 0.8 then 'Low' when c >= 0.5 then 'Medium' else 'High' end) end as risk
  from (select scan_id, label, case when label = 'Falsified' then p else 1 - p end as c from (select scan_id, {_LABEL} as label, {_CAL} as p from fx_scores))"""
)
def confidence_and_risk(spark, sf_dir):
    return scores(spark, sf_dir).select("scan_id", "label", F.round("confidence", 6).alias("confidence"), "risk")


_EACH = f"""with s as (select case when is_fake = 1 then 'Fake' else 'Real' end as t, case when {_LABEL} = 'Falsified' then 'Fake' else 'Real' end as p from fx_scores),
  e as (select c as name, (select count(*) from s where t = c) as support, (select count(*) from s where t = c and p = c) as hit, (select count(*) from s where p = c) as called from (values ('Fake'), ('Real')) v(c)),
  m as (select name, support, hit, case when called > 0 then hit / called else 0 end as precision, case when support > 0 then hit / support else 0 end as recall from e where support > 0),
  f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from m)
  select name, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1, support from f
  union all select 'accuracy', null, null, round(sum(hit) / sum(support), 4), cast(sum(support) as bigint) from f
  union all select 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), cast(sum(support) as bigint) from f
  union all select 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4), cast(sum(support) as bigint) from f"""


@query(_EACH)
def classification_report(spark, sf_dir):
    d = scores(spark, sf_dir).select(F.when(F.col("is_fake") == 1, "Fake").otherwise("Real").alias("t"), F.when(F.col("label") == "Falsified", "Fake").otherwise("Real").alias("p"))
    return op.classification_report(d, "t", "p")


@query(
    """with t as (select distinct prob_fake as threshold from fx_scores),
  c as (select threshold, (select count(*) from fx_scores where prob_fake >= threshold) as called, (select count(*) from fx_scores where prob_fake >= threshold and is_fake = 1) as tp, (select count(*) from fx_scores where is_fake = 1) as total from t)
  select threshold, round(2 * tp / (called + total), 6) as best_f1 from c order by best_f1 desc, threshold desc limit 1"""
)
def best_threshold(spark, sf_dir):
    return op.best_threshold(fx(spark, sf_dir, "fx_scores"), "prob_fake", "is_fake")


_UNSCORED = "(select scan_id, case when scan_id % 7 <> 0 then prob_fake end as prob_fake, is_fake from fx_scores)"


@query(
    f"""with s as {_UNSCORED}, t as (select distinct prob_fake as threshold from s where prob_fake is not null),
  c as (select threshold, (select count(*) from s where prob_fake >= threshold) as called, (select count(*) from s where prob_fake >= threshold and is_fake = 1) as tp, (select count(*) from s where is_fake = 1) as total from t)
  select threshold, round(2 * tp / (called + total), 6) as best_f1 from c order by best_f1 desc, threshold desc limit 1"""
)
def best_threshold_unscored(spark, sf_dir):
    """Every seventh row has no score: it is never called."""
    d = fx(spark, sf_dir, "fx_scores").withColumn("prob_fake", F.when(F.col("scan_id") % 7 != 0, F.col("prob_fake")))
    return op.best_threshold(d, "prob_fake", "is_fake")


@query(
    f"""with r as (select is_fake, rank() over (order by prob_fake nulls first) + (count(*) over (partition by prob_fake) - 1) / 2.0::double as k from {_UNSCORED})
  select round((sum(k) filter (is_fake = 1) - p * (p + 1) / 2) / (p * (n - p)), 6) as auc from r, (select count(*) filter (is_fake = 1) as p, count(*) as n from fx_scores) group by p, n"""
)
def roc_auc_unscored(spark, sf_dir):
    """Rows without a score tie below all others."""
    d = fx(spark, sf_dir, "fx_scores").withColumn("prob_fake", F.when(F.col("scan_id") % 7 != 0, F.col("prob_fake")))
    return op.roc_auc(d, "prob_fake", "is_fake")


@query(
    """with r as (select is_fake, rank() over (order by prob_fake) + (count(*) over (partition by prob_fake) - 1) / 2.0::double as k from fx_scores)
  select round((sum(k) filter (is_fake = 1) - p * (p + 1) / 2) / (p * (n - p)), 6) as auc from r, (select count(*) filter (is_fake = 1) as p, count(*) as n from fx_scores) group by p, n"""
)
def roc_auc(spark, sf_dir):
    return op.roc_auc(fx(spark, sf_dir, "fx_scores"), "prob_fake", "is_fake")


@query(
    """with recursive t(n) as (select 0 union all select n + 1 from t where n < 255),
  bits(n, v, k) as (select n, n::bigint, 0 from t union all select n, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8),
  crc(n, v) as (select n, v from bits where k = 8),
  walk(doc_id, quality, s, i, h) as (select doc_id, quality, cast(doc_id as varchar), 0, 4294967295::bigint from labels
    union all select doc_id, quality, s, i + 1, xor(crc.v, h // 256) from walk join crc on crc.n = xor(h % 256, ascii(substr(s, i + 1, 1))::bigint) where i < len(s)),
  hashed as (select doc_id, quality, xor(h, 4294967295) as h from walk where i = len(s)),
  ranked as (select doc_id, quality, row_number() over (partition by quality order by h, doc_id) as r, count(*) over (partition by quality) as n from hashed)
  select doc_id, quality, case when r <= round(n * 0.70) then 'train' when r <= round(n * 0.70) + round(n * 0.15) then 'val' else 'test' end as split from ranked"""
)
def stratified_split(spark, sf_dir):
    return op.stratified_split(fx(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "split")


@query()
def fit_and_score(spark, sf_dir):
    d = fx(spark, sf_dir, "embeddings").withColumn("target", F.col("label") % 2)
    return op.fit_and_score(d, "embedding", "target", "vec_id")


@query(
    """with d as (select scan_id, heat, y < 1 or y >= 7 or x < 1 or x >= 7 as e from fx_cells),
  m as (select scan_id, avg(heat) filter (e) as a, avg(heat) filter (not e) as c, max(heat) as p from d group by scan_id)
  select scan_id, round(a, 4) as edge, round(c, 4) as centre, case when a > c * 1.15 then 'edge' when c > a * 1.15 then 'centre' when p > 0.85 then 'hot-spot' else 'diffuse' end as attention from m"""
)
def attention_summary(spark, sf_dir):
    d = op.attention_summary(fx(spark, sf_dir, "fx_cells"))
    return d.select("scan_id", F.round("edge", 4).alias("edge"), F.round("centre", 4).alias("centre"), "attention")


_THR = """select scan_id, least(greatest(0.5 * 0.55 + 0.5 * quantile_cont(heat, 0.9), 0.38), 0.78) as ht,
  coalesce(least(greatest(0.5 * 0.30 + 0.5 * (quantile_cont(coef, 0.72) filter (coef > 0.02)), 0.12), 0.50), 0.30) as ct from fx_cells group by scan_id"""


@query(f"select scan_id, round(ht, 4) as heat_threshold, round(ct, 4) as coef_threshold from ({_THR})")
def adaptive_thresholds(spark, sf_dir):
    d = op.adaptive_thresholds(fx(spark, sf_dir, "fx_cells"))
    return d.select("scan_id", F.round("heat_threshold", 4).alias("heat_threshold"), F.round("coef_threshold", 4).alias("coef_threshold"))


def _zone(cx: str, cy: str) -> str:
    row = lambda a, b, c: f"(case when {cx} < 0.30 then '{a}' when {cx} < 0.65 then '{b}' else '{c}' end)"
    return f"case when {cy} < 0.25 then {row('Header / logo area', 'Document title area', 'Top-right corner')} when {cy} < 0.55 then {row('Photo zone', 'Name / nationality fields', 'ID number zone')} else {row('Signature / seal area', 'Date fields', 'MRZ / barcode zone')} end"


_ZONES = f"""with zb as (select c.scan_id, comp_id, min(x) as x, min(y) as y, max(x) - min(x) + 1 as width, max(y) - min(y) + 1 as height, count(*) as area
    from fx_cells c join ({_THR}) t on c.scan_id = t.scan_id where c.scan_id % 5 <> 0 and (heat >= ht or coef >= ct) group by c.scan_id, comp_id),
  z as (select zb.*, (select round(greatest(max(heat), max(coef), 1e-6), 3) from fx_cells i where i.scan_id = zb.scan_id and i.x between zb.x and zb.x + zb.width - 1 and i.y between zb.y and zb.y + zb.height - 1) as severity from zb),
  r as (select *, row_number() over (partition by scan_id order by severity desc, comp_id) as number, max(severity) over (partition by scan_id) as top from z where area >= 0.32 and area <= 44.8)
  select scan_id, cast(number as int) as number, comp_id, {_zone('((x + width / 2.0) / 8)', '((y + height / 2.0) / 8)')} as zone, severity, x, y, width, height from r where number <= 5 and (number = 1 or severity >= greatest(0.10, 0.28 * top))"""


def _zones(spark, sf_dir):
    """Zones of all scans but every fifth, which is called Real."""
    cells = fx(spark, sf_dir, "fx_cells")
    labels = cells.select("scan_id", F.when(F.col("scan_id") % 5 == 0, "Real").otherwise("Falsified").alias("label")).distinct()
    return op.suspicious_zones(cells, labels=labels)


@query(_ZONES)
def suspicious_zones(spark, sf_dir):
    return _zones(spark, sf_dir)


@query(
    f"""with recursive f as (select c.scan_id, y, x from fx_cells c join ({_THR}) t on c.scan_id = t.scan_id where heat >= ht or coef >= ct),
  r(scan_id, y, x, c) as (select scan_id, y, x, y * 100000 + x from f union select r.scan_id, g.y, g.x, r.c from r join f g on g.scan_id = r.scan_id and abs(g.y - r.y) <= 1 and abs(g.x - r.x) <= 1)
  select scan_id, y, x, cast(min(c) // 100000 as int) as comp_y, cast(min(c) % 100000 as int) as comp_x from r group by scan_id, y, x"""
)
def connected_cells(spark, sf_dir):
    d = op.connected_cells(op.flagged_cells(fx(spark, sf_dir, "fx_cells")))
    return d.select("scan_id", "y", "x", F.col("comp_id.y").alias("comp_y"), F.col("comp_id.x").alias("comp_x"))


@query(f"select scan_id, y, x, {_zone('((x + 0.5) / 8)', '((y + 0.5) / 8)')} as zone from fx_cells")
def zone_name(spark, sf_dir):
    zone = op.zone_name((F.col("x") + 0.5) / 8, (F.col("y") + 0.5) / 8)
    return fx(spark, sf_dir, "fx_cells").select("scan_id", "y", "x", zone.alias("zone"))


@query(
    f"""with b as (select scan_id, name, floor(x * 8.0 / 800) as bx, floor(y * 8.0 / 500) as b_y, greatest(1, floor(w * 8.0 / 800)) as bw, greatest(1, floor(h * 8.0 / 500)) as bh from (
      select distinct scan_id, 'photo' as name, 20 as x, 60 as y, 240 as w, 300 as h from fx_cells union all select distinct scan_id, 'surname', 280, 90, 300, 60 from fx_cells union all select distinct scan_id, 'number', 500, 300, 280, 180 from fx_cells)),
  z as ({_ZONES}),
  o as (select z.scan_id, number, name, greatest(0, least(x + width, bx + bw) - greatest(x, bx)) * greatest(0, least(y + height, b_y + bh) - greatest(y, b_y)) as i, width * height + bw * bh as u from z join b on z.scan_id = b.scan_id),
  k as (select scan_id, number, name from o where i / (u - i) >= 0.12 qualify row_number() over (partition by scan_id, number order by i / (u - i) desc, case when name = 'photo' then 0 else 1 end, name) = 1)
  select z.scan_id, z.number, coalesce(k.name, zone) as zone from z left join k on z.scan_id = k.scan_id and z.number = k.number"""
)
def relabel_zones_iou(spark, sf_dir):
    cells = fx(spark, sf_dir, "fx_cells")
    scans = cells.select("scan_id").distinct()
    rows = F.array(*(F.struct(F.lit(n).alias("name"), *(F.lit(v).alias(k) for k, v in zip("xywh", box, strict=True))) for n, box in (("photo", (20, 60, 240, 300)), ("surname", (280, 90, 300, 60)), ("number", (500, 300, 280, 180)))))
    boxes = scans.select("scan_id", F.explode(rows).alias("b")).select("scan_id", "b.*")
    page = scans.select("scan_id", F.lit(800).alias("page_w"), F.lit(500).alias("page_h"))
    return op.relabel_zones_iou(_zones(spark, sf_dir), boxes, page, side=8).select("scan_id", "number", "zone")
