"""Queries of the job field_mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import fields as op
from ..operators.checks import visual_date
from .mrz import _AS_OF
from .registry import query

_NORM = lambda c: f"trim(lower(strip_accents({c})))"
_CLEAN = lambda c: f"regexp_replace({_NORM(c)}, '[^a-z0-9]', '', 'g')"
_DATE = lambda c: f"cast(case when regexp_full_match({c}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then try_strptime({c}, '%d/%m/%Y') when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_strptime({c}, '%Y-%m-%d') end as date)"


def lines(spark, sf_dir):
    return fx(spark, sf_dir, "fx_lines")


def dated(spark, sf_dir):
    return fx(spark, sf_dir, "fx_dated_lines").withColumn("y", F.col("line_no") * 20).withColumn("x", F.lit(0.0)).withColumn("conf", F.lit(0.5))


@query(f"select scan_id, line_no, {_NORM('text')} as norm, {_CLEAN('text')} as token from fx_lines")
def normalize_text(spark, sf_dir):
    return lines(spark, sf_dir).select("scan_id", "line_no", op.normalize_text(F.col("text")).alias("norm"), op.clean_token(F.col("text")).alias("token"))


@query("select scan_id, line_no, trim(lower(strip_accents(text))) as norm from fx_lines")
def normalize_text_decomposed(spark, sf_dir):
    """Letters and marks as characters of their own come to the same as letters with marks."""
    text = F.col("text")
    for letter, parts in {"é": "e\u0301", "è": "e\u0300", "ü": "u\u0308", "ö": "o\u0308", "ä": "a\u0308", "ñ": "n\u0303", "ç": "c\u0327", "ó": "o\u0301", "á": "a\u0301"}.items():
        text = F.replace(text, F.lit(letter), F.lit(parts))
    return lines(spark, sf_dir).select("scan_id", "line_no", op.normalize_text(text).alias("norm"))


@query(f"select scan_id, line_no from fx_lines qualify row_number() over (partition by scan_id, {_CLEAN('text')}, floor(x / 8), floor(y / 8) order by y, x, line_no) = 1")
def dedupe_lines(spark, sf_dir):
    return op.dedupe_lines(lines(spark, sf_dir)).select("scan_id", "line_no")


@query(
    """select scan_id, 'date_of_birth' as field, replace(substr(text, 16, 10), '/', ' ') as value, 1.5::double as score from fx_dated_lines where line_no = 0
  union all select scan_id, 'date_of_birth', substr(text, 10, 10), 1.0::double from fx_dated_lines where line_no = 1"""
)
def label_candidates(spark, sf_dir):
    return op.label_candidates(dated(spark, sf_dir)).select("scan_id", "field", "value", "score")


@query()
def anchor_candidates(spark, sf_dir):
    return op.anchor_candidates(lines(spark, sf_dir))


_DATES = f"(select scan_id, line_no, raw, {_DATE('raw')} as day from (select scan_id, line_no, regexp_extract(text, '([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) as raw from fx_dated_lines))"
_BIRTH = f"select scan_id, 'date_of_birth' as field, arg_min(raw, day) as value from {_DATES} where date_diff('day', day, DATE '2024-06-01') / 365.25 between 10 and 120 group by scan_id"
_EXPIRY = f"select scan_id, 'expiration_date' as field, arg_max(raw, day) as value from {_DATES} where year(day) >= 2019 group by scan_id"


@query(f"select scan_id, field, replace(value, '/', ' ') as value from ({_BIRTH} union all {_EXPIRY})")
def date_candidates(spark, sf_dir):
    return op.date_candidates(dated(spark, sf_dir), _AS_OF()).select("scan_id", "field", "value")


@query(f"select scan_id, line_no, {_DATE('raw')} as day from {_DATES}")
def parse_visual_date(spark, sf_dir):
    raw = F.regexp_extract("text", op.DATE, 1)
    return dated(spark, sf_dir).select("scan_id", "line_no", visual_date(raw, _AS_OF()).alias("day"))


@query("select scan_id, concat('AB', 100000 + scan_id) as value from fx_dated_lines where line_no = 1 union all select scan_id, substr(text, 10, 10) from fx_dated_lines where line_no = 1")
def docnum_candidates(spark, sf_dir):
    return op.docnum_candidates(dated(spark, sf_dir)).select("scan_id", "value")


@query("select scan_id, line_no, upper(w) as value from (select scan_id, line_no, unnest(string_split(regexp_replace(text, '[^A-Za-z0-9_]', ' ', 'g'), ' ')) as w from fx_lines where not regexp_matches(text, '[^\\x00-\\x7F]')) where upper(w) in ('M', 'F')")
def sex_candidates(spark, sf_dir):
    found = op.sex_candidates(lines(spark, sf_dir))
    return found.select("scan_id", F.floor(F.col("seq") / 1000).cast("int").alias("line_no"), "value")


@query()
def nationality_candidates(spark, sf_dir):
    return op.nationality_candidates(lines(spark, sf_dir))


# Letters whose upper case is several letters, so that they aren't upper case; DuckDB maps letter by letter
_NO_UPPER = "ßŉǰΐΰևẖẗẘẙẚὐὒὔὖᾶῆῒΐῖῗῢΰῤῦῧῶﬀ-ﬆﬓ-ﬗ"
_SPACES = r"[ \t\n\x0B\f\r]+"
_LEADS = ", ".join(f"'{w}'" for w in op.LEADS)


@query(
    rf"""with w as (select scan_id, line_no, list_filter(regexp_split_to_array(replace(trim(text), '-', ' '), '{_SPACES}'), lambda x: x <> '') as ws,
    list_filter(regexp_split_to_array(translate(trim(text), '/|', '  '), '{_SPACES}'), lambda x: x <> '') as ts from fx_lines),
  u as (select * from w where len(ws) between 1 and 4 and len(list_filter(ws, lambda x: not (regexp_full_match(x, '\p{{L}}+') and upper(x) = x and not regexp_matches(x, '[{_NO_UPPER}]')))) = 0),
  n as (select scan_id, line_no, ts, coalesce(list_position(list_transform(ts, lambda x: {_CLEAN('x')} in ({_LEADS})), false), len(ts) + 1) as first from u),
  c as (select scan_id, line_no, array_to_string(list_slice(ts, first, len(ts)), ' ') as v from n), t as (select *, {_CLEAN('v')} as k from c)
  select scan_id, line_no, f as field from t, (values ('surname'), ('names')) a(f) where v <> '' and k not in ('surname', 'name', 'given', 'nationality', 'nationalite') and not suffix(k, 'surname') and not suffix(k, 'nationality')"""
)
def uppercase_name_candidates(spark, sf_dir):
    return op.uppercase_name_candidates(lines(spark, sf_dir)).select("scan_id", F.col("seq").cast("int").alias("line_no"), "field")


@query("select scan_id, case when scan_id % 13 = 0 then '' else regexp_extract(upper(replace(number, ' ', '')), '([A-Z]{0,2}[0-9][A-Z0-9-]{5,12})|.*', 0) end as number, surname as surname, sex as sex, replace(date_of_birth, '/', ' ') as date_of_birth from (select scan_id, case when regexp_matches(number, '[A-Z]{0,2}[0-9][A-Z0-9-]{5,12}') then regexp_extract(number, '[A-Z]{0,2}[0-9][A-Z0-9-]{5,12}') else number end as number, surname, sex, date_of_birth from fx_fields)")
def sanitize_candidate(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_fields")
    put = lambda k, lead: op.sanitize(F.lit(k), F.concat(F.lit(lead), F.col(k))).alias(k)
    return d.select("scan_id", put("number", ""), put("surname", "Surname / "), put("sex", "Sex "), put("date_of_birth", "emri "))


@query(
    """select scan_id, not contains(lower(surname), 'emri') and len(regexp_replace(surname, '[^A-Za-z]', '', 'g')) >= 3 as surname, regexp_matches(number, '[0-9]') and len(number) >= 6 as number,
  try_strptime(date_of_birth, '%d/%m/%Y') is not null as date_of_birth, sex in ('M', 'F') as sex, len(nationality) >= 3 as nationality from fx_fields"""
)
def is_plausible(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_fields")
    return d.select("scan_id", *(op.is_plausible(F.lit(k), F.col(k), _AS_OF()).alias(k) for k in ("surname", "number", "date_of_birth", "sex", "nationality")))


@query(
    f"""select scan_id, 'date_of_birth' as field, raw as value from {_DATES} where line_no = 1 and day is not null union all {_EXPIRY}
  union all select scan_id, 'number', substr(text, 10, 10) from fx_dated_lines where line_no = 1"""
)
def rank_candidates(spark, sf_dir):
    d = dated(spark, sf_dir)
    found = op.rank_candidates(op.all_candidates(d, _AS_OF()), _AS_OF())
    return found.select("scan_id", "field", "value")


@query()
def first_name_fallback(spark, sf_dir):
    d = lines(spark, sf_dir)
    return op.first_name_fallback(op.wide(op.rank_candidates(op.all_candidates(d, _AS_OF()), _AS_OF())), d)


@query("select doc_id % 100 as scan_id, arg_max(doc_id, s * 100000000 - doc_id) as variant, max(s) as score from (select doc_id, len(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) + 25 * len(regexp_extract_all(text, '[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}')) as s from documents) group by 1")
def best_ocr_variant(spark, sf_dir):
    d = fx(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("scan_id"), F.col("doc_id").alias("variant"), "text")
    return op.best_ocr_variant(d).select("scan_id", "variant", F.col("score").cast("bigint").alias("score"))


@query(f"select l.scan_id, b.value as date_of_birth, e.value as expiration_date, n.number as number from (select distinct scan_id from fx_dated_lines) l left join ({_BIRTH}) b on l.scan_id = b.scan_id left join ({_EXPIRY}) e on l.scan_id = e.scan_id left join (select scan_id, substr(text, 10, 10) as number from fx_dated_lines where line_no = 1) n on l.scan_id = n.scan_id")
def extract_fields_regex(spark, sf_dir):
    return op.extract_fields_regex(dated(spark, sf_dir), _AS_OF()).select("scan_id", "date_of_birth", "expiration_date", "number")


@query("select scan_id, round(0.40 + 0.25 * (0.25 + 0.25 + case when number <> '' then 0.20 else 0 end + 0.15 + 0.10 + 0.05)::double, 4) as score from fx_fields")
def visual_ocr_score(spark, sf_dir):
    return op.visual_ocr_score(fx(spark, sf_dir, "fx_fields"))


@query("select scan_id, case when scan_id % 4 = 0 then 'regex' else 'ranking' end as engine, case when scan_id % 4 = 0 then names else surname end as shown from fx_fields")
def choose_extractor(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_fields")
    a = d.select("scan_id", F.map_filter(F.create_map(F.lit("raw_text"), F.lit("x"), F.lit("surname"), F.col("surname"), F.lit("sex"), F.when(F.col("scan_id") % 4 != 0, F.col("sex"))), lambda k, v: v.isNotNull()).alias("fields"))
    b = d.select("scan_id", F.create_map(F.lit("surname"), F.col("names")).alias("fields"))
    return op.choose_extractor(a, b).select("scan_id", "engine", F.element_at("fields", "surname").alias("shown"))
