"""Queries of the job mrz_audit: candidates of machine-readable zones to one validated record and score per scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import mrz
from .registry import query

AS_OF = "DATE '2024-06-01'"
_AS_OF = lambda: F.lit("2024-06-01").cast("date")


def _check(x: str) -> str:
    """The check digit of an expression, in DuckDB."""
    total = f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: (case when substr({x}, i, 1) = '<' then 0 when instr('{mrz.CODES}', substr({x}, i, 1)) > 0 then instr('{mrz.CODES}', substr({x}, i, 1)) - 1 else -1000 end) * (case i % 3 when 1 then 7 when 2 then 3 else 1 end)))"
    return f"(case when {x} = '' then '' when {total} < 0 then '' else cast(cast({total} as bigint) % 10 as varchar) end)"


def _dated(x: str) -> str:
    return f"(regexp_full_match({x}, '[0-9]{{6}}') and try_strptime(concat('20', {x}), '%Y%m%d') is not null)"


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx(spark, sf_dir, "fx_mrz")
    return mrz.read_zones(lines.select("scan_id", F.concat_ws("\n", "l1", "l2").alias("raw_text")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mrz.read_zones(fx(spark, sf_dir, "fx_mrz_candidates"))


def final_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mrz.best_candidate(mrz.best_variant(candidates(spark, sf_dir)))


_SPLIT = "list_filter(string_split(replace(raw_text, ' ', ''), chr(10)), lambda x: len(x) >= 20 or contains(x, '<<'))"
_TYPED = f"""select *, case when len(lines) = 3 then 'TD1' when len(lines) = 2 and len(lines[1]) = 0 then null
    when len(lines) = 2 and len(lines[1]) < 40 and len(lines[2]) < 40 then (case when upper(lines[1][1]) = 'V' then 'MRVB' else 'TD2' end)
    when len(lines) = 2 then (case when upper(lines[1][1]) = 'V' then 'MRVA' else 'TD3' end) end as mrz_type
    from (select *, {_SPLIT} as lines from fx_mrz_candidates)"""


@query(f"select scan_id, box_idx, variant, array_to_string({_SPLIT}, '|') as lines from fx_mrz_candidates")
def mrz_split_lines(spark, sf_dir):
    return candidates(spark, sf_dir).select("scan_id", "box_idx", "variant", F.array_join("lines", "|").alias("lines"))


@query(f"select scan_id, box_idx, variant, mrz_type from ({_TYPED})")
def mrz_guess_type(spark, sf_dir):
    return candidates(spark, sf_dir).select("scan_id", "box_idx", "variant", "mrz_type")


_A, _N = "translate(upper({}), '0124568', 'OIZASGB')", "translate(upper({}), 'BCDGIOQSZ', '800610052')"


def _line2(x: str, tail: str) -> str:
    part = lambda f, i, n: f.format(f"substr({x}, {i}, {n})")
    return "concat(" + ", ".join([f"upper(substr({x}, 1, 9))", part(_N, 10, 1), part(_A, 11, 3), part(_N, 14, 7), part(_A, 21, 1), part(_N, 22, 7), tail]) + ")"


_FIXED = f"""select *, case when mrz_type = 'TD3' then concat({_A.format("substr(lines[1], 1, 44)")}, substr(lines[1], 45))
      when mrz_type = 'TD2' then concat({_A.format("substr(lines[1], 1, 36)")}, substr(lines[1], 37)) end as a,
    case when mrz_type = 'TD3' then {_line2("lines[2]", "upper(substr(lines[2], 29, 14)), " + _N.format("substr(lines[2], 43, 2)") + ", substr(lines[2], 45)")}
      when mrz_type = 'TD2' then {_line2("lines[2]", "upper(substr(lines[2], 29, 7)), " + _N.format("substr(lines[2], 36, 1)") + ", substr(lines[2], 37)")} end as b
    from ({_TYPED})"""


@query(f"select scan_id, box_idx, variant, a as line_1, b as line_2 from ({_FIXED})")
def mrz_fix_ocr(spark, sf_dir):
    line = lambda i: F.when(F.col("mrz_type").isNotNull(), F.get("fixed", F.lit(i)))
    return candidates(spark, sf_dir).select("scan_id", "box_idx", "variant", line(0).alias("line_1"), line(1).alias("line_2"))


@query(f"select scan_id, {_check('num')} as number_digit, {_check('name')} as name_digit, {_check('odd')} as odd_digit from (select scan_id, substr(l2, 1, 9) as num, substr(l1, 6) as name, concat(substr(l2, 1, 2), '-', substr(l1, 1, 1)) as odd from fx_mrz)")
def mrz_check_digit(spark, sf_dir):
    mrz.register_sql_functions(spark)
    d = fx(spark, sf_dir, "fx_mrz")
    return d.select(
        "scan_id",
        mrz.check_digit(F.substring("l2", 1, 9)).alias("number_digit"),
        mrz.check_digit(F.substr("l1", F.lit(6))).alias("name_digit"),
        F.expr("mrz_check_digit(concat(substr(l2, 1, 2), '-', substr(l1, 1, 1)))").alias("odd_digit"),
    )


def _name_sql(zone: str) -> str:
    at = f"instr({zone}, '<<')"
    return f"trim(replace(case when {at} > 0 then substr({zone}, 1, {at} - 1) else {zone} end, '<', ' ')) as surname, trim(replace(case when {at} > 0 then substr({zone}, {at} + 2) else '' end, '<', ' ')) as names"


def _parse_sql(kind: str, source: str, where: str = "") -> str:
    """One type's records over lines a and b (and c), in DuckDB."""
    w = {"TD1": 30, "TD2": 36, "TD3": 44, "MRVA": 44, "MRVB": 36}[kind]
    to = 44 if kind == "MRVB" else w
    pad = lambda x: f"case when len({x}) < {w} then rpad({x}, {to}, '<') else {x} end as {x}"
    if kind == "TD1":
        lines, n_lines = "abc", 3
        cut = "substr(a, 6, 9) as number, substr(a, 15, 1) as k1, substr(b, 1, 6) as date_of_birth, substr(b, 7, 1) as k2, substr(b, 8, 1) as sex, substr(b, 9, 6) as expiration_date, substr(b, 15, 1) as k3, substr(b, 16, 3) as nationality, concat(substr(a, 6, 25), substr(b, 1, 7), substr(b, 9, 7), substr(b, 19, 11)) as whole, substr(b, 30, 1) as k4"
        names = _name_sql("c")
    else:
        lines, n_lines = "ab", 2
        cut = "substr(b, 1, 9) as number, substr(b, 10, 1) as k1, substr(b, 14, 6) as date_of_birth, substr(b, 20, 1) as k2, substr(b, 21, 1) as sex, substr(b, 22, 6) as expiration_date, substr(b, 28, 1) as k3, substr(b, 11, 3) as nationality"
        end = {"TD2": 14, "TD3": 22}.get(kind, 0)
        cut += f", concat(substr(b, 1, 10), substr(b, 14, 7), substr(b, 22, {end})) as whole, substr(b, {w}, 1) as k4" if end else ""
        names = _name_sql(f"substr(a, 6, {w - 5})")
    checks = [f"{_check('number')} = k1"]
    dates = [f"{_check(x)} = {k}" + ("" if kind.startswith("MRV") else f" and {_dated(x)}") for x, k in (("date_of_birth", "k2"), ("expiration_date", "k3"))]
    checks += dates
    if not kind.startswith("MRV"):
        checks.append(f"{_check('whole')} = k4")
    if kind == "TD3":
        checks.append(f"(substr(b, 43, 1) in ('<', '0') and substr(b, 29, 14) = repeat('<', 14)) or {_check('substr(b, 29, 14)')} = substr(b, 43, 1)")
    letter = {"TD1": "in ('I', 'A', 'C')", "TD2": "in ('I', 'A', 'C')", "TD3": "= 'P'"}.get(kind, "= 'V'")
    flags = [f"({x})" for x in checks]
    points = " + ".join(f"10 * cast(coalesce({x}, false) as int)" for x in flags) + " + " + " + ".join(f"cast(n_{x} = {w} as int)" for x in lines) + f" + cast(substr(a, 1, 1) {letter} as int) + 1"
    named = [f"{x} as {n}" for x, n in zip(flags, ("valid_number", "valid_date_of_birth", "valid_expiration_date", "valid_composite", "valid_personal_number"), strict=False)]
    return f"""select *, cast(100 * points // {10 * len(checks) + n_lines + 2} as int) as valid_score from (
      select *, {", ".join(named)}, {points} as points from (
        select *, substr(a, 3, 3) as country, {names}, {cut} from (
          select * exclude ({", ".join(lines)}), {", ".join(f"len({x}) as n_{x}" for x in lines)}, {", ".join(pad(x) for x in lines)} from ({source}) {where})))"""


_COLS = ["scan_id", "country", "surname", "names", "number", "date_of_birth", "expiration_date", "nationality", "sex", "valid_number", "valid_date_of_birth", "valid_expiration_date"]
#: Lines of other types made from the passport lines.
_TD1 = "select scan_id, concat('I<', substr(l1, 3, 3), substr(l2, 1, 10), repeat('<', 15)) as a, concat(substr(l2, 14, 7), substr(l2, 21, 1), substr(l2, 22, 7), substr(l2, 11, 3), repeat('<', 11), '7') as b, substr(l1, 6, 26) as c from fx_mrz"
_TD2 = "select scan_id, concat('I', substr(l1, 2, 35)) as a, concat(substr(l2, 1, 28), repeat('<', 7), cast(scan_id % 10 as varchar(4))) as b from fx_mrz"
_MRVA = "select scan_id, concat('V', substr(l1, 2)) as a, concat(substr(l2, 1, 28), repeat('<', 16)) as b from fx_mrz"
_MRVB = "select scan_id, concat('V', substr(l1, 2, 34)) as a, concat(substr(l2, 1, 28), repeat('<', 8)) as b from fx_mrz"


def _parsed(spark, sf_dir, kind: str, source: str, extra: list[str]) -> DataFrame:
    rows = spark.sql(source.replace("from fx_mrz", "from {fx_mrz}"), fx_mrz=fx(spark, sf_dir, "fx_mrz"))
    lines = F.array(*[c for c in ("a", "b", "c") if c in rows.columns])
    d = rows.select("scan_id", mrz.parse(lines, F.lit(kind)).alias("mrz"))
    return d.select("scan_id", *(F.col(f"mrz.{c}").alias(c) for c in [*_COLS[1:], *extra, "valid_score"]))


@query(f"select {', '.join(_COLS)}, valid_composite, valid_score from ({_parse_sql('TD1', _TD1)})")
def mrz_parse_td1(spark, sf_dir):
    return _parsed(spark, sf_dir, "TD1", _TD1, ["valid_composite"])


@query(f"select {', '.join(_COLS)}, valid_composite, valid_score from ({_parse_sql('TD2', _TD2)})")
def mrz_parse_td2(spark, sf_dir):
    return _parsed(spark, sf_dir, "TD2", _TD2, ["valid_composite"])


_TD3 = "select scan_id, l1 as a, l2 as b from fx_mrz"


@query(f"select {', '.join(_COLS)}, valid_composite, valid_personal_number, valid_score from ({_parse_sql('TD3', _TD3)})")
def mrz_parse_td3(spark, sf_dir):
    return _parsed(spark, sf_dir, "TD3", _TD3, ["valid_composite", "valid_personal_number"])


_MRV = f"select 'MRVA' as mrz_type, {', '.join(_COLS)}, valid_score from ({_parse_sql('MRVA', _MRVA)}) union all select 'MRVB', {', '.join(_COLS)}, valid_score from ({_parse_sql('MRVB', _MRVB)})"


@query(_MRV)
def mrz_parse_mrv(spark, sf_dir):
    both = [_parsed(spark, sf_dir, k, s, []).withColumn("mrz_type", F.lit(k)) for k, s in (("MRVA", _MRVA), ("MRVB", _MRVB))]
    return both[0].unionByName(both[1])


@query(f"select valid_score, cast(count(*) as bigint) as n, cast(sum(case when valid_score = 100 then 1 else 0 end) as bigint) as n_valid from ({_parse_sql('TD3', _TD3)}) group by valid_score")
def mrz_valid_score(spark, sf_dir):
    d = _zones(spark, sf_dir)
    return d.groupBy("valid_score").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("mrz.valid"), F.lit(False)).cast("bigint")).alias("n_valid"))


@query(f"select event_id, {_dated('s')} as valid from (select event_id, lpad(cast((event_id * 7919) % 1000000 as varchar(12)), 6, '0') as s from events)")
def mrz_date_valid(spark, sf_dir):
    d = fx(spark, sf_dir, "events")
    s = F.lpad(((F.col("event_id") * 7919) % 1000000).cast("string"), 6, "0")
    return d.select("event_id", mrz.date_valid(s).alias("valid"))


_SCORED = f"""select scan_id, box_idx, variant, coalesce(td3.valid_score, td2.valid_score, 0) as valid_score from fx_mrz_candidates
  left join (select scan_id, box_idx, variant, valid_score from ({_parse_sql('TD3', f"select scan_id, box_idx, variant, a, b from ({_FIXED}) where mrz_type = 'TD3'")})) td3 using (scan_id, box_idx, variant)
  left join (select scan_id, box_idx, variant, valid_score from ({_parse_sql('TD2', f"select scan_id, box_idx, variant, a, b from ({_FIXED}) where mrz_type = 'TD2'")})) td2 using (scan_id, box_idx, variant)"""
_BEST_VARIANT = f"select * from ({_SCORED}) qualify row_number() over (partition by scan_id, box_idx order by valid_score desc, variant) = 1"


@query(f"select scan_id, box_idx, variant, valid_score from ({_BEST_VARIANT})")
def mrz_best_variant(spark, sf_dir):
    return mrz.best_variant(candidates(spark, sf_dir)).select("scan_id", "box_idx", "variant", "valid_score")


_BEST = f"""select scan_id, box_idx, valid_score from ({_BEST_VARIANT}) where valid_score > 0
  qualify row_number() over (partition by scan_id order by case when valid_score = 100 then 0 else 1 end, case when valid_score = 100 then box_idx end, valid_score desc, box_idx desc) = 1"""


@query(_BEST)
def mrz_best_candidate(spark, sf_dir):
    return final_zones(spark, sf_dir).select("scan_id", "box_idx", "valid_score")


@query("select page_id, (contains(html, '>>') or (contains(html, '>') and not contains(html, '<'))) as rotate, (contains(url, '>>') or (contains(url, '>') and not contains(url, '<'))) as rotate_url from pages")
def mrz_needs_rotation(spark, sf_dir):
    d = fx(spark, sf_dir, "pages")
    return d.select("page_id", mrz.needs_rotation(F.col("html")).alias("rotate"), mrz.needs_rotation(F.col("url")).alias("rotate_url"))


@query(f"select scan_id, round((cast(valid_number as int) + cast(valid_date_of_birth as int) + cast(valid_expiration_date as int) + cast(valid_composite as int) + cast(valid_personal_number as int)) / 5.0::double, 4) as score, valid_number and valid_date_of_birth and valid_expiration_date and valid_composite and valid_personal_number as valid from ({_parse_sql('TD3', _TD3)})")
def mrz_ocr_score(spark, sf_dir):
    d = _zones(spark, sf_dir).withColumn("score", mrz.ocr_score(F.col("mrz")))
    return d.select("scan_id", "score", (F.col("score") == 1).alias("valid"))


def _mrz_date_sql(x: str) -> str:
    return f"case when regexp_full_match({x}, '[0-9]{{6}}') then cast(try_strptime(concat(case when cast(substr({x}, 1, 2) as int) > 34 then '19' else '20' end, {x}), '%Y%m%d') as date) end"


@query(f"select scan_id, {_mrz_date_sql('substr(l2, 14, 6)')} as birth, {_mrz_date_sql('substr(l2, 22, 6)')} as expiry, {_mrz_date_sql('substr(l2, 1, 6)')} as odd from fx_mrz")
def mrz_date(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_mrz")
    return d.select("scan_id", *(mrz.mrz_date(F.substring("l2", i, 6), _AS_OF()).alias(n) for i, n in ((14, "birth"), (22, "expiry"), (1, "odd"))))


def _display_sql(x: str, birth: bool) -> str:
    yy, mm, dd = (f"cast(substr({x}, {i}, 2) as int)" for i in (1, 3, 5))
    year = f"case when {yy} > 24 then 1900 + {yy} else 2000 + {yy} end" if birth else f"case when {yy} < 50 then 2000 + {yy} else 1900 + {yy} end"
    return f"case when regexp_full_match({x}, '[0-9]{{6}}') then (case when {mm} between 1 and 12 then concat({dd}, ' ', (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[{mm}], ' ', {year}) else {x} end) else {x} end"


@query(f"select scan_id, {_display_sql('substr(l2, 14, 6)', True)} as birth, {_display_sql('substr(l2, 22, 6)', False)} as expiry, {_display_sql('substr(l2, 1, 6)', False)} as odd from fx_mrz")
def mrz_display_date(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_mrz")
    show = lambda i, birth: mrz.display_date(F.substring("l2", i, 6), birth, _AS_OF())
    return d.select("scan_id", show(14, True).alias("birth"), show(22, False).alias("expiry"), show(1, False).alias("odd"))
