"""Inputs derived from the driver's tables, the same rows in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DIGITS = lambda x, n: "(" + "+".join(f"cast(substr({x},{i},1) as int)*{(7, 3, 1)[(i - 1) % 3]}" for i in range(1, n + 1)) + ")%10"

#: Two lines of a passport each, for customers; some numbers have O for 0, some birth check digits are wrong.
_MRZ_BASE = """select c_custkey as k, c_nationkey, c_mktsegment,
  lpad(cast(c_custkey*7919 as varchar(12)),9,'0') as num,
  concat(lpad(cast(50+c_custkey%50 as varchar(4)),2,'0'),lpad(cast(1+c_custkey%12 as varchar(4)),2,'0'),lpad(cast(1+c_custkey%28 as varchar(4)),2,'0')) as dob,
  concat(lpad(cast(20+c_custkey%25 as varchar(4)),2,'0'),lpad(cast(1+c_custkey%12 as varchar(4)),2,'0'),lpad(cast(1+c_custkey%28 as varchar(4)),2,'0')) as exp,
  substr('FRATUNESPALBUTO',cast(c_nationkey%5*3+1 as int),3) as nat from customer"""
_MRZ_DIGITS = f"""select *, cast({_DIGITS("num", 9)} as varchar(1)) as c1, cast({_DIGITS("dob", 6)} as varchar(1)) as c2, cast({_DIGITS("exp", 6)} as varchar(1)) as c3 from fx_mrz_base"""
_MRZ = f"""select k as scan_id,
 rpad(concat('P<',nat,c_mktsegment,'<<ANNA<',substr('MARIAERIKS',cast(k%2*5+1 as int),5)),44,'<') as l1,
 concat(case when k%6=0 then replace(num,'0','O') else num end, c1,nat,dob,
        case when k%7=0 then cast((cast(c2 as int)+1)%10 as varchar(1)) else c2 end,
        case when k%2=0 then 'F' else 'M' end, exp, c3, repeat('<',14), '<', cast({_DIGITS("comp", 24)} as varchar(1))) as l2
from fx_mrz_comp"""

#: Lines of cards in four layouts by scan_id % 4: values under labels of two languages, values beside labels,
#: values without labels, and values that need cleaning. d: birth as dd.mm.yyyy, e: expiry as yyyy-mm-dd, n: a number.
_CARDS = {
    0: ("'REPUBLIKA E SHQIPERISE'", "'Mbiemri/Surname'", "s", "'Emri/Given name'", "f", "'Shtetesia/Nationality'", "'Shqiptare'", "concat('Datelindja/Birth ', d)", "concat('Gjinia/Sex ', sex)", "concat('Nr personal ', n)"),
    1: ("concat('Surname: ', s)", "concat('Given name: ', f)", "'Nationality: French'", "concat('Date of birth ', replace(d, '.', '/'))", "concat('Expiry ', e)", "concat('Sex ', sex)", "concat('Document number ', n)"),
    2: ("s", "'ANNA ERIKS'", "d", "concat('X 1', d, '1')", "case when sex = 'M' then 'male' else 'female' end", "'Citizenship ALB'", "concat('No ', n)", "e"),
    3: ("concat('surname / given ', f)", "concat('Card no ', n)", "'Albanian citizen'", "concat('sexe ', lower(sex))", "concat(d, ' ', e)", "concat('nat ', 'Suomi')"),
}
_CARD_TEXTS = "case scan_id % 4 " + " ".join(f"when {layout} then array({', '.join(texts)})" for layout, texts in _CARDS.items()) + " end"
_CARD_BASE = """select scan_id, sex, upper(surname) as s, concat(upper(substr(names, 1, 1)), lower(substr(names, 2, 3)), 'x') as f, concat('AB', cast(1000000 + scan_id as varchar(12))) as n,
  concat(substr(date_of_birth, 1, 2), '.', substr(date_of_birth, 4, 2), '.', substr(date_of_birth, 7, 4)) as d, concat(substr(expiration_date, 7, 4), '-', substr(expiration_date, 4, 2), '-', substr(expiration_date, 1, 2)) as e from fx_fields"""

#: Cards of six types by scan_id % 6, of 1000 x 700 px, in four forms: read by their template; the same with a number in
#: the Russian form at the foot; with neither name in its region; and with the header where it tells no type.
#: The last two have labels and values at the left. e: expiry as dd.mm.yyyy, n: a number of the type, nine or ten digits for ALB.
CARD_TYPES = ("RUS", "ALB", "ESP", "EST", "FIN", "SVK")
CARD_HEADERS = ("", "ALBANIA", "IDENTIDAD", "VABARIIK", "SUOMI", "SLOVENSKA")
_TYPED_BASE = """select scan_id, cast(scan_id % 6 as int) as t, cast(floor(scan_id / 6) as int) % 4 as form, sex, s, f, d, concat(substr(e, 9, 2), '.', substr(e, 6, 2), '.', substr(e, 1, 4)) as e,
  case cast(scan_id % 6 as int) when 1 then cast((case when scan_id % 12 = 1 then 100000000 else 1000000000 end) + scan_id as varchar(12)) when 2 then concat('ABC', cast(100000 + scan_id % 900000 as varchar(12)))
  when 3 then concat('AB', cast(1000000 + scan_id % 9000000 as varchar(12))) when 4 then cast(100000000 + scan_id as varchar(12)) when 5 then concat('AB', cast(100000 + scan_id % 900000 as varchar(12))) else 'AB1234567' end as n from fx_card_base"""


def _typed_words() -> str:
    """(type, form, line, word, centre, text or the name of a column) of each word."""
    from .operators.spatial import TEMPLATES

    column = {"surname": "s", "names": "f", "date_of_birth": "d", "expiration_date": "e", "number": "n"}
    below = (("Surname", "s"), ("Given", "f"), ("Sex", "sex"), ("Number", "n"), ("Birth", "d"), ("Expiry", "e"))
    rows = []
    for t, kind in enumerate(CARD_TYPES):
        for form in range(4):
            words = [(300, 660 if form == 3 else 40, CARD_HEADERS[t])] if t else []
            if t == 0 and form < 3:  # the number at the right: in one word or in three
                words += [(950, 105, "4503123456")] if form == 1 else [(950, 105 + 40 * i, x) for i, x in enumerate(("45", "03", "123456"))]
            if form == 1 and t:
                words.append((500, 690, "4503123456"))
            if form < 2:
                for field, (x1, y1, x2, y2) in TEMPLATES[kind][3].items():
                    words.append((round(1000 * (x1 + 0.3 * (x2 - x1))), round(700 * (y1 + 0.62 * (y2 - y1))), column.get(field, "sex" if field == "sex" else "XXX")))
            else:
                words += [w for i, (label, c) in enumerate(below) for w in ((60, 300 + 50 * i, label), (200, 300 + 50 * i, c))]
            rows += [f"({t}, {form}, {i}, {x}, {y}, '{text}')" for i, (x, y, text) in enumerate(words)]
    return "(values " + ", ".join(rows) + ") k(kt, kf, line_no, cx, cy, key)"


def _typed_tokens(left: str) -> str:
    text = "case k.key when 's' then b.s when 'f' then b.f when 'd' then b.d when 'e' then b.e when 'n' then b.n when 'sex' then b.sex else k.key end"
    return f"select scan_id, line_no, 0 as word_no, text, cast(cx - 4 * length(text) as int) as {left}, cast(cy - 8 as int) as top, cast(8 * length(text) as int) as width, 16 as height, 90 as conf from (select b.scan_id, k.line_no, k.cx, k.cy, {text} as text from fx_typed_base b join {_typed_words()} on b.t = k.kt and b.form = k.kf)"


#: name: (tables and inputs, Spark SQL, DuckDB SQL; None if the same text serves both)
FIXTURES: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    "fx_mrz_base": (("customer",), _MRZ_BASE, None),
    "fx_mrz_digits": (("fx_mrz_base",), _MRZ_DIGITS, None),
    "fx_mrz_comp": (("fx_mrz_digits",), "select *, concat(num,c1,dob,c2,exp,c3) as comp from fx_mrz_digits", None),
    "fx_mrz": (("fx_mrz_comp",), _MRZ, None),
    "fx_mrz_candidates": (
        ("fx_mrz",),
        """select scan_id, 0 as box_idx, 0 as variant, concat(l1, '\\n', l2) as raw_text from fx_mrz
        union all select scan_id, 0, 1, concat(l1, '\\n', substr(l2, 1, 19), cast((7*cast(substr(l2,14,1) as int)+3*cast(substr(l2,15,1) as int)+cast(substr(l2,16,1) as int)+7*cast(substr(l2,17,1) as int)+3*cast(substr(l2,18,1) as int)+cast(substr(l2,19,1) as int))%10 as varchar(1)), substr(l2, 21, 24)) from fx_mrz
        union all select scan_id, 1, 0, concat(l1, '\\n', substr(l2, 1, 30)) from fx_mrz
        union all select scan_id, 2, 0, substr(l1, 1, 12) from fx_mrz where scan_id % 3 = 0""",
        """select scan_id, 0 as box_idx, 0 as variant, concat(l1, chr(10), l2) as raw_text from fx_mrz
        union all select scan_id, 0, 1, concat(l1, chr(10), substr(l2, 1, 19), cast((7*cast(substr(l2,14,1) as int)+3*cast(substr(l2,15,1) as int)+cast(substr(l2,16,1) as int)+7*cast(substr(l2,17,1) as int)+3*cast(substr(l2,18,1) as int)+cast(substr(l2,19,1) as int))%10 as varchar(1)), substr(l2, 21, 24)) from fx_mrz
        union all select scan_id, 1, 0, concat(l1, chr(10), substr(l2, 1, 30)) from fx_mrz
        union all select scan_id, 2, 0, substr(l1, 1, 12) from fx_mrz where scan_id % 3 = 0""",
    ),
    "fx_fields": (
        ("fx_mrz",),
        """select scan_id, case when scan_id % 10 = 0 then 'MARTIN' else trim(replace(substr(l1, 6, instr(l1, '<<') - 6), '<', ' ')) end as surname,
        trim(replace(substr(l1, instr(l1, '<<') + 2), '<', ' ')) as names, substr(l2, 11, 3) as nationality, substr(l1, 3, 3) as country,
        case when scan_id % 13 = 0 then '' else substr(l2, 1, 9) end as number,
        concat(case when scan_id % 8 = 0 then '01' else substr(l2, 18, 2) end, '/', substr(l2, 16, 2), '/19', substr(l2, 14, 2)) as date_of_birth,
        concat(substr(l2, 26, 2), '/', substr(l2, 24, 2), '/20', substr(l2, 22, 2)) as expiration_date, substr(l2, 21, 1) as sex from fx_mrz""",
        None,
    ),
    "fx_card_base": (("fx_fields",), _CARD_BASE, None),
    "fx_card_lines": (
        ("fx_card_base",),
        f"select scan_id, line_no, text, line_no * 20 as y, 10.0D as x, (50 + 5 * line_no) / 100.0D as conf from fx_card_base lateral view posexplode({_CARD_TEXTS}) t as line_no, text",
        f"select scan_id, cast(i - 1 as int) as line_no, text, cast((i - 1) * 20 as int) as y, 10.0::double as x, cast(50 + 5 * (i - 1) as double) / 100.0 as conf from (select scan_id, unnest(t) as text, generate_subscripts(t, 1) as i from (select scan_id, {_CARD_TEXTS.replace('array(', 'list_value(')} as t from fx_card_base))",
    ),
    "fx_card_words": (
        ("fx_card_lines",),
        "select scan_id, line_no, pos word_no, w as text from fx_card_lines lateral view posexplode(split(text, ' ')) t as pos, w",
        "select scan_id, line_no, cast(j - 1 as int) word_no, w as text from (select scan_id, line_no, unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) j from fx_card_lines)",
    ),
    "fx_card_tokens": (
        ("fx_card_words",),
        "select scan_id, line_no, word_no, text, cast(8*(sum(length(text)+1) over (partition by scan_id, line_no order by word_no) - length(text) - 1) as int) as left, cast(20*line_no + word_no*3%7 as int) as top, cast(8*length(text) as int) as width, 16 as height, 90 as conf from fx_card_words",
        'select scan_id, line_no, word_no, text, cast(8*(sum(length(text)+1) over (partition by scan_id, line_no order by word_no) - length(text) - 1) as int) as "left", cast(20*line_no + word_no*3%7 as int) as top, cast(8*length(text) as int) as width, 16 as height, 90 as conf from fx_card_words',
    ),
    "fx_typed_base": (("fx_card_base",), _TYPED_BASE, None),
    "fx_typed_tokens": (("fx_typed_base",), _typed_tokens("left"), _typed_tokens('"left"')),
    "fx_lines": (
        ("documents",),
        "select doc_id scan_id, pos line_no, trim(line) text, pos*20 y, (doc_id*7 + pos*13) % 50 * 1.0D x, ((doc_id + pos) % 100) / 100.0D conf from documents lateral view posexplode(split(text,'\\n')) t as pos,line where trim(line)<>''",
        "select doc_id scan_id, cast(i - 1 as int) line_no, trim(l) as text, cast((i - 1)*20 as int) y, cast((doc_id*7 + (i - 1)*13) % 50 as double) x, cast((doc_id + i - 1) % 100 as double) / 100.0 conf from (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i from documents) where trim(l) <> ''",
    ),
    "fx_dated_lines": (
        ("orders",),
        "select o_orderkey scan_id, 0 line_no, concat('Date of birth: ', lpad(cast(1 + o_orderkey % 28 as varchar(4)), 2, '0'), '/', lpad(cast(1 + o_orderkey % 12 as varchar(4)), 2, '0'), '/', cast(1950 + o_orderkey % 60 as varchar(4))) text from orders union all select o_orderkey, 1, concat('Valid to ', cast(2015 + o_orderkey % 20 as varchar(4)), '-', lpad(cast(1 + o_orderkey % 12 as varchar(4)), 2, '0'), '-', lpad(cast(1 + o_orderkey % 31 as varchar(4)), 2, '0'), ' No AB', cast(100000 + o_orderkey as varchar(12))) from orders",
        None,
    ),
    "fx_words": (
        ("documents",),
        "select doc_id scan_id, lno line_no, wno word_no, w as text from documents lateral view posexplode(split(text,'\\n')) a as lno, l lateral view posexplode(split(l,' ')) b as wno, w where w <> ''",
        "select scan_id, line_no, cast(j - 1 as int) word_no, w as text from (select scan_id, line_no, unnest(string_split(l, ' ')) w, generate_subscripts(string_split(l, ' '), 1) j from (select doc_id scan_id, cast(i - 1 as int) line_no, l from (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i from documents))) where w <> ''",
    ),
    "fx_tokens": (
        ("fx_words",),
        "select scan_id, line_no, word_no, text, cast(8*(sum(length(text)+1) over (partition by scan_id, line_no order by word_no) - length(text) - 1) as int) as left, cast(20*line_no as int) as top, cast(8*length(text) as int) as width, 16 as height, cast((length(text)*37 + line_no*11) % 100 as int) as conf from fx_words",
        'select scan_id, line_no, word_no, text, cast(8*(sum(length(text)+1) over (partition by scan_id, line_no order by word_no) - length(text) - 1) as int) as "left", cast(20*line_no as int) as top, cast(8*length(text) as int) as width, 16 as height, cast((length(text)*37 + line_no*11) % 100 as int) as conf from fx_words',
    ),
    "fx_pixels": (
        ("embeddings",),
        "select vec_id scan_id, pos div 8 y, pos % 8 x, (cast(v as double)+1)*127.5 lum from embeddings lateral view posexplode(embedding) t as pos,v",
        "select scan_id, (i - 1) // 8 y, (i - 1) % 8 x, (cast(v as double)+1)*127.5 lum from (select vec_id scan_id, unnest(embedding) v, generate_subscripts(embedding, 1) i from embeddings)",
    ),
    "fx_recompress": (
        ("fx_pixels",),
        "select scan_id, q_idx, y, x, abs(lum - floor(lum/step+0.5)*step) diff from fx_pixels lateral view posexplode(array(16D,12D,10D,8D,6D,5D,3D,2D)) s as q_idx, step",
        "select scan_id, q_idx, y, x, abs(lum - floor(lum/step+0.5)*step) diff from fx_pixels, (values (0,16.0::double),(1,12.0::double),(2,10.0::double),(3,8.0::double),(4,6.0::double),(5,5.0::double),(6,3.0::double),(7,2.0::double)) s(q_idx, step)",
    ),
    "fx_cells": (
        ("fx_pixels",),
        "select scan_id, y, x, lum/255 heat, case when (y*8+x+scan_id)%7=0 then lum/400 else 0 end coef, (y div 4)*2 + (x div 4) comp_id from fx_pixels",
        "select scan_id, y, x, lum/255 heat, case when (y*8+x+scan_id)%7=0 then lum/400 else 0 end coef, (y // 4)*2 + (x // 4) comp_id from fx_pixels",
    ),
    "fx_glyphs": (
        ("lineitem",),
        "select scan_id, top, left, top + h bottom, left + w right, h*w*0.6D area, top + h/2.0D cy, left + w/2.0D cx from (select l_partkey scan_id, cast(l_linenumber*20 + cast(l_quantity as int)%3 as int) top, cast((l_orderkey%200)*10 as int) left, cast(10 + l_suppkey%4 as int) h, cast(6 + cast(l_quantity as int)%5 as int) w from lineitem)",
        'select scan_id, top, "left", top + h bottom, "left" + w "right", cast(h*w as double)*0.6::double area, top + h/2.0::double cy, "left" + w/2.0::double cx from (select l_partkey scan_id, cast(l_linenumber*20 + cast(l_quantity as int)%3 as int) top, cast((l_orderkey%200)*10 as int) "left", cast(10 + l_suppkey%4 as int) h, cast(6 + cast(l_quantity as int)%5 as int) w from lineitem)',
    ),
    "fx_scores": (
        ("documents", "labels"),
        "select d.doc_id scan_id, (n_chars % 1000)/1000.0D prob_fake, 1 - quality is_fake from documents d join labels l on d.doc_id = l.doc_id",
        "select d.doc_id scan_id, cast(n_chars % 1000 as double)/1000.0::double prob_fake, 1 - quality is_fake from documents d join labels l on d.doc_id = l.doc_id",
    ),
    "fx_exif": (
        ("events",),
        "select event_id scan_id, case when event_id%11=0 then null when event_type='error' then 'Adobe Photoshop' when event_type='click' then 'Firmware 1.2' else '' end software, case when event_id%3=0 then 'Acme' else '' end make, case when event_id%3=0 then 'M1' else '' end model, cast(event_id as string) dt_original, case when event_id%5=0 then 'later' else cast(event_id as string) end dt, case when event_id%7=0 then 'x' else '' end dt_digitized, cast(event_id%9 as string) orientation, case when event_id%13=0 then '1' else '' end gps from events",
        "select event_id scan_id, case when event_id%11=0 then null when event_type='error' then 'Adobe Photoshop' when event_type='click' then 'Firmware 1.2' else '' end software, case when event_id%3=0 then 'Acme' else '' end make, case when event_id%3=0 then 'M1' else '' end model, cast(event_id as varchar) dt_original, case when event_id%5=0 then 'later' else cast(event_id as varchar) end dt, case when event_id%7=0 then 'x' else '' end dt_digitized, cast(event_id%9 as varchar) orientation, case when event_id%13=0 then '1' else '' end gps from events",
    ),
    "fx_log": (
        ("events",),
        "select event_id id, concat('scan_', cast(event_id%200 as varchar(8)), '.jpg') filename, case when value >= 75 then 'Authentic' when value >= 50 then 'Suspicious' else 'Fake' end verdict, round(least(value,100),2) score, case when event_id%4=0 then 'TD1' when event_id%4=1 then 'TD3' else 'None' end mrz_type, ts, user_id from events",
        None,
    ),
    "fx_frames": (
        ("events",),
        "select user_id session, event_id seq, ts, value*10 variance, event_id%4<>0 corners_lit from events",
        None,
    ),
}


def _inputs(name: str) -> tuple[str, ...]:
    return FIXTURES[name][0] if name in FIXTURES else ()


#: Tables whose rows give much work each, with the column that becomes scan_id.
_DEALT = {"customer": "c_custkey", "orders": "o_orderkey", "documents": "doc_id"}


def _dealt(table: DataFrame, name: str) -> DataFrame:
    """Rows dealt to tasks by scan, since a file may be of one part; what is then done by scan needs no other exchange.

    The number of parts is given, as few bytes a row would have them joined again to a few tasks.
    """
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), _DEALT[name]) if name in _DEALT else table


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture or a table of the folder."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs, sql, _ = FIXTURES[name]
    frames = {x: _dealt(fx(spark, sf_dir, x), x) for x in inputs}
    for x in inputs:
        sql = re.sub(rf"(from|join) {x}\b", rf"\1 {{{x}}}", sql)
    return spark.sql(sql, **frames)


def with_fixtures(sql: str) -> str:
    """DuckDB SQL with a common table expression for each fixture that it names."""
    order: list[str] = []

    def need(text: str) -> None:
        for x in FIXTURES:
            if re.search(rf"\b{x}\b", text) and x not in order:
                need(" ".join(_inputs(x)))
                order.append(x)

    need(sql)
    ctes = ", ".join(f"{x} as ({FIXTURES[x][2] or FIXTURES[x][1]})" for x in order)
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"
