"""Queries of the jobs consistency_audit and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import checks as op
from ..operators import fusion
from ..operators import mrz as zones
from ..operators.lineage import cut
from . import evaluation, forensics, mrz
from .mrz import _AS_OF, _mrz_date_sql, _parse_sql, _TD3
from .registry import query

_RECORDS = f"(select scan_id, country, surname, names, number, date_of_birth, expiration_date, nationality, sex, valid_number, valid_date_of_birth, valid_expiration_date, valid_composite, valid_personal_number from ({_parse_sql('TD3', _TD3)}))"
_VISUAL = lambda x: f"cast(try_strptime({x}, '%d/%m/%Y') as date)"


def records(spark, sf_dir):
    """One record of a zone for each scan, its fields as columns."""
    d = mrz._zones(spark, sf_dir)
    return d.select("scan_id", *(F.col(f"mrz.{f}").alias(f) for f in (*op.FIELDS, "country")), zones.ocr_score(F.col("mrz")).alias("ocr_score"))


def ocr_fields(spark, sf_dir):
    """Weak OCR fields for two thirds of the scans, the others with a zone."""
    d = fx(spark, sf_dir, "fx_fields")
    weak = {"surname": F.when(F.col("scan_id") % 4 == 0, "7").otherwise(F.col("surname")), "number": F.substring("number", 1, 4), "sex": F.when(F.col("scan_id") % 5 == 0, "x").otherwise(F.col("sex"))}
    weak["date_of_birth"] = F.when(F.col("scan_id") % 6 == 0, "unreadable").otherwise(F.col("date_of_birth"))
    weak["nationality"] = F.substring("nationality", 1, 2)
    weak["expiration_date"] = F.when(F.col("scan_id") % 9 == 0, "").otherwise(F.col("expiration_date"))
    return d.select("scan_id", (F.col("scan_id") % 3 == 0).alias("mrz_found"), *(weak.get(f, F.col(f)).alias(f) for f in op.FIELDS))


_OCR = """(select scan_id, scan_id % 3 = 0 as mrz_found, case when scan_id % 4 = 0 then '7' else surname end as surname, names, substr(nationality, 1, 2) as nationality, case when scan_id % 5 = 0 then 'x' else sex end as sex,
  case when scan_id % 6 = 0 then 'unreadable' else date_of_birth end as date_of_birth, case when scan_id % 9 = 0 then '' else expiration_date end as expiration_date, substr(number, 1, 4) as number from fx_fields)"""
_MERGED = f"""select o.scan_id, o.mrz_found, case when o.mrz_found or not (o.surname = '7') then o.surname else d.surname end as surname, o.names,
  case when o.mrz_found then o.nationality else d.nationality end as nationality, case when o.mrz_found or o.sex <> 'x' then o.sex else upper(d.sex) end as sex,
  case when o.mrz_found or o.date_of_birth <> 'unreadable' then o.date_of_birth else d.date_of_birth end as date_of_birth,
  case when o.mrz_found or o.expiration_date <> '' then o.expiration_date else d.expiration_date end as expiration_date,
  case when o.mrz_found or d.number = '' then o.number else d.number end as number from {_OCR} o join fx_fields d on o.scan_id = d.scan_id"""


@query(_MERGED)
def merge_field_sources(spark, sf_dir):
    return op.merge_field_sources(ocr_fields(spark, sf_dir), fx(spark, sf_dir, "fx_fields"))


def _quality(t: str) -> str:
    name = lambda c: f"case when len(trim({t}.{c})) >= 2 and regexp_matches({t}.{c}, '[A-Za-z]') and not regexp_full_match(trim({t}.{c}), '[A-Z]{{1,2}}') then 3 else 0 end"
    date = lambda c: f"case when regexp_full_match({t}.{c}, '[0-9]{{2}}[/.-][0-9]{{2}}[/.-][0-9]{{4}}|[0-9]{{6}}') then 2 else 0 end"
    return f"{name('surname')} + {name('names')} + {date('date_of_birth')} + {date('expiration_date')} + case when regexp_matches({t}.number, '[0-9]') and len({t}.number) >= 6 then 2 else 0 end + case when upper({t}.sex) in ('M', 'F') then 1 else 0 end + case when len({t}.nationality) >= 3 then 1 else 0 end"


@query(f"select o.scan_id, {_quality('o')} as ocr_quality, {_quality('d')} as doc_quality, case when o.mrz_found then 'MRZ' when {_quality('d')} >= {_quality('o')} then 'document' else 'OCR' end as source from {_OCR} o join fx_fields d on o.scan_id = d.scan_id")
def choose_display_source(spark, sf_dir):
    d = ocr_fields(spark, sf_dir).alias("o").join(fx(spark, sf_dir, "fx_fields").alias("d"), "scan_id")
    a, b = (op.field_quality_score(lambda k, t=t: F.col(f"{t}.{k}")) for t in "od")
    return d.select("scan_id", a.alias("ocr_quality"), b.alias("doc_quality"), op.choose_display_source(F.col("o.mrz_found"), a, b, F.lit(True)).alias("source"))


@query(f"select scan_id, nationality, nationality in ({', '.join(repr(c) for c in op.COUNTRIES)}) as known from fx_fields")
def country_check(spark, sf_dir):
    return fx(spark, sf_dir, "fx_fields").select("scan_id", "nationality", op.country_known(F.col("nationality")).alias("known"))


_KNOWN = f"({', '.join(repr(c) for c in op.COUNTRIES)})"
_plain = lambda c: f"replace(replace(upper(trim({c})), '<', ''), ' ', '')"
_COHERENCE = f"""select v.scan_id, {_plain('v.surname')} <> '' and {_plain('v.surname')} = {_plain('m.surname')} as surname_match, {_plain('v.names')} <> '' and {_plain('v.names')} = {_plain('m.names')} as names_match,
  v.nationality = m.nationality and v.nationality in {_KNOWN} as nationality_match, v.country = m.country and v.country in {_KNOWN} as country_match,
  coalesce({_VISUAL('v.date_of_birth')} = {_mrz_date_sql('m.date_of_birth')}, false) as dob_match, coalesce({_VISUAL('v.expiration_date')} = {_mrz_date_sql('m.expiration_date')}, false) as expiry_match,
  v.sex = m.sex and v.sex in ('M', 'F') as sex_match from fx_fields v join {_RECORDS} m on v.scan_id = m.scan_id"""


@query(_COHERENCE)
def mrz_coherence(spark, sf_dir):
    return op.mrz_coherence(fx(spark, sf_dir, "fx_fields"), records(spark, sf_dir), _AS_OF())


def _logic(source: str, date) -> str:
    letters = lambda c: f"regexp_replace(upper(trim({c})), '[^A-Z]', '', 'g')"
    a, b, dob, exp = letters("surname"), letters("names"), date("date_of_birth"), date("expiration_date")
    age = f"(date_diff('day', {dob}, DATE '2024-06-01') / 365.25)"
    return f"""select scan_id, coalesce({age} > 0 and {age} < 120, false) as realistic_age, coalesce({dob} < {exp}, false) as dob_before_expiry, upper(trim(country)) = upper(trim(nationality)) or nationality in ('<<', '') as country_nationality_coherent,
  len({a}) >= 2 and len({b}) >= 2 as name_and_prenom_present, len({a}) >= 2 and len({b}) >= 2 and {a} <> {b} as name_different_from_prenom from {source}"""


@query(_logic(_RECORDS, _mrz_date_sql))
def logical_consistency(spark, sf_dir):
    return op.logical_consistency(records(spark, sf_dir), _AS_OF(), True)


_SUM = " + ".join(f"cast({c} as int)" for c in (*op.COHERENCE, *op.LOGIC))
_MRZ_MODE = f"select c.scan_id, round((1 + {_SUM}) / 13.0::double, 4) as score from ({_COHERENCE}) c join ({_logic(_RECORDS, _mrz_date_sql)}) l on c.scan_id = l.scan_id"


def mrz_mode(spark, sf_dir, r=None):
    r = records(spark, sf_dir) if r is None else r
    return op.mrz_mode_score(op.mrz_coherence(fx(spark, sf_dir, "fx_fields"), r, _AS_OF()), op.logical_consistency(r, _AS_OF(), True))


@query(_MRZ_MODE)
def mrz_mode_score(spark, sf_dir):
    return mrz_mode(spark, sf_dir).select("scan_id", "score")


_VISUAL_CHECKS = f"""select l.*, coalesce(a > 0 and a < 120, false) as valid_dob, coalesce(e > -1825, false) as valid_expiry, len(trim(number)) >= 4 as doc_number_found, sex in ('M', 'F', '') as valid_sex from ({_logic('fx_fields', _VISUAL)}) l
  join (select scan_id, number, sex, date_diff('day', {_VISUAL('date_of_birth')}, DATE '2024-06-01') / 365.25 as a, date_diff('day', DATE '2024-06-01', {_VISUAL('expiration_date')}) as e from fx_fields) f on l.scan_id = f.scan_id"""
_VISUAL_POINTS = " + ".join(f"(case when {k} then {w}::double else 0 end)" for k, w in op.VISUAL_WEIGHTS.items())


def visual_mode(spark, sf_dir):
    return op.visual_mode_score(fx(spark, sf_dir, "fx_fields"), _AS_OF())


@query(f"select scan_id, round(least({_VISUAL_POINTS}, 0.85), 4) as score from ({_VISUAL_CHECKS})")
def visual_mode_score(spark, sf_dir):
    return visual_mode(spark, sf_dir).select("scan_id", "score")


_LONG = " union all ".join(f"select scan_id, 'visual' as module, '{k}' as \"check\", {k} as passed from v" for k in op.VISUAL_WEIGHTS) + " union all select scan_id, 'visual', 'mrz_detected', false from v"


@query(f"with v as ({_VISUAL_CHECKS}), l as ({_LONG}) select module, \"check\", count(*) as n, round(avg(cast(passed as double)), 4) as pass_rate from l group by rollup (module, \"check\")")
def check_pass_rates(spark, sf_dir):
    return op.check_pass_rates(op.explode_checks(visual_mode(spark, sf_dir), "visual"))


@query(f"with v as ({_VISUAL_CHECKS}) {_LONG}")
def explode_checks(spark, sf_dir):
    return op.explode_checks(visual_mode(spark, sf_dir), "visual")


# Fusion: module scores of events as they are, and the whole report over the fixtures.
_P = lambda k: f"((event_id * {k}) % 1000) / 1000.0::double"
_FOUND = "event_id % 3 <> 0"
_STRUCT = f"round(greatest(0, least(1, case when {_FOUND} then {_P(7)} * 0.40 + {_P(11)} * 0.40 + {_P(13)} * 0.20 else {_P(11)} * 0.55 + {_P(13)} * 0.30 + {_P(7)} * 0.15 end)), 4)"
_VIS = f"round(greatest(0, least(1, case event_id % 4 when 0 then 0.5 when 1 then {_P(17)} else 1 - {_P(17)} end)), 4)"
_GLOBAL = f"round(greatest(0, least(1, case when {_FOUND} then {_VIS} * 0.50 + {_STRUCT} * 0.30 + (1 - {_P(19)}) * 0.20 else {_VIS} * 0.55 + {_STRUCT} * 0.25 + (1 - {_P(19)}) * 0.20 end)), 4)"


def _fused(spark, sf_dir):
    p = lambda k: ((F.col("event_id") * k) % 1000) / 1000.0
    found = F.col("event_id") % 3 != 0
    label = F.element_at(F.array(*map(F.lit, ("Unknown", "Real", "Falsified", "Falsified"))), (F.col("event_id") % 4 + 1).cast("int"))
    d = fx(spark, sf_dir, "events").select("event_id", found.alias("found"), label.alias("label"), *(p(k).alias(n) for k, n in ((7, "mrz"), (11, "fields"), (13, "font"), (17, "confidence"), (19, "risk"))))
    d = d.withColumn("structural_score", fusion.structural_score(F.col("found"), F.col("mrz"), F.col("fields"), F.col("font")))
    d = d.withColumn("visual_score", fusion.visual_score(F.col("label"), F.col("confidence")))
    return d.withColumn("global_score", fusion.global_score(F.col("found"), F.col("visual_score"), F.col("structural_score"), F.col("risk")))


@query(f"select event_id, {_STRUCT} as structural_score from events")
def structural_score(spark, sf_dir):
    return _fused(spark, sf_dir).select("event_id", "structural_score")


@query(f"select event_id, {_VIS} as visual_score from events")
def visual_score(spark, sf_dir):
    return _fused(spark, sf_dir).select("event_id", "visual_score")


@query(f"select event_id, {_GLOBAL} as global_score from events")
def global_score(spark, sf_dir):
    return _fused(spark, sf_dir).select("event_id", "global_score")


@query(f"select verdict, count(*) as n from (select case when g >= 0.75 then 'Authentic' when g >= 0.50 then 'Suspicious' else 'Fake' end as verdict from (select {_GLOBAL} as g from events)) group by verdict")
def verdict(spark, sf_dir):
    return _fused(spark, sf_dir).groupBy(fusion.verdict(F.col("global_score")).alias("verdict")).agg(F.count("*").alias("n"))


def full_report(spark, sf_dir):
    """Every zone's scan with the scores of the modules that have something for it."""
    r = cut(records(spark, sf_dir))  # zones are read once
    ocr = r.select("scan_id", F.col("ocr_score").alias("score"), F.lit(True).alias("mrz_found"))
    model = evaluation.scores(spark, sf_dir).select("scan_id", "label", "confidence")
    return fusion.assemble_report(r, ocr, mrz_mode(spark, sf_dir, r), forensics.font_score(spark, sf_dir), model, forensics.risk(spark, sf_dir))


_REPORT = f"""select scan_id, g as global_score, round(g * 100, 2) as global_score_display, case when g >= 0.75 then 'Authentic' when g >= 0.50 then 'Suspicious' else 'Fake' end as verdict, s as structural_score from (
  select *, cast(round(cast(cast(greatest(0, least(1, v * 0.50 + s * 0.30 + (1 - m) * 0.20)) as varchar) as decimal(24, 18)), 4) as double) as g from (
    select r.scan_id, round(greatest(0, least(1, o.score * 0.40 + f.score * 0.40 + coalesce(t.score, 0) * 0.20)), 4) as s,
      round(case c.label when 'Real' then c.conf when 'Falsified' then 1 - c.conf else 0.5 end, 4) as v, coalesce(k.score, 0) as m
    from {_RECORDS} r join (select scan_id, (cast(valid_number as int) + cast(valid_date_of_birth as int) + cast(valid_expiration_date as int) + cast(valid_composite as int) + cast(valid_personal_number as int)) / 5.0::double as score from {_RECORDS}) o on r.scan_id = o.scan_id
    join ({_MRZ_MODE}) f on r.scan_id = f.scan_id left join ({forensics.FONT_SQL}) t on r.scan_id = t.scan_id
    left join (select scan_id, label, case when label = 'Falsified' then p else 1 - p end as conf from (select scan_id, {evaluation._LABEL} as label, {evaluation._CAL} as p from fx_scores)) c on r.scan_id = c.scan_id
    left join ({forensics.RISK_SQL}) k on r.scan_id = k.scan_id))"""


@query(_REPORT)
def assemble_report(spark, sf_dir):
    return full_report(spark, sf_dir).select("scan_id", "global_score", "global_score_display", "verdict", "structural_score")


@query("with t as (select 'ocr_s' as module, value / 100 as s from events union all select 'cnn_s', value / 50 from events union all select 'font_s', (event_id % 100) / 10.0::double from events) select module, round(quantile_cont(s, 0.5), 3) as p50, round(quantile_cont(s, 0.95), 3) as p95, round(max(s), 3) as most from t group by module")
def module_timings(spark, sf_dir):
    d = fx(spark, sf_dir, "events").select((F.col("value") / 100).alias("ocr_s"), (F.col("value") / 50).alias("cnn_s"), ((F.col("event_id") % 100) / 10.0).alias("font_s"))
    return fusion.module_timings(d, ["ocr_s", "cnn_s", "font_s"])
