"""Queries of field_mining and spatial_fields over lines and words of cards in four layouts.

The layouts are written by rule (fixtures.py), so the SQL says what each operator must make of
each of them, in terms of the values that were put in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import CARD_TYPES, fx
from ..operators import fields, spatial
from .mrz import _AS_OF
from .registry import query


def lines(spark, sf_dir):
    return fx(spark, sf_dir, "fx_card_lines")


def rows(spark, sf_dir):
    """Words with their rows: words of a line are up to 6 px apart."""
    return spatial.group_token_rows(fx(spark, sf_dir, "fx_card_tokens"))


def _table(columns: str, *rows: tuple[int, str]) -> str:
    """Columns by name, with a select for each layout and row of values."""
    each = " union all ".join(f"select scan_id, {values} from fx_card_base where scan_id % 4 = {layout}" for layout, values in rows)
    return f"select * from ({each}) t(scan_id, {columns})"


@query(_table("line_no, row_key", *((layout, f"{i}, {i * 20}") for layout, n in ((0, 10), (1, 7), (2, 8), (3, 6)) for i in range(n))))
def group_token_rows_cards(spark, sf_dir):
    return rows(spark, sf_dir).select("scan_id", "line_no", "row_key").distinct()


@query(_table("field, value, score", (0, "'nationality', 'Albanian', 1.25::double"), (1, "'surname', s, 1.45::double"), (1, "'names', f, 1.475::double"), (1, "'nationality', 'French', 1.24::double"), (3, "'nationality', 'Albanian', 1.25::double"), (3, "'surname', f, 1.45::double")))
def anchor_candidates_cards(spark, sf_dir):
    return fields.anchor_candidates(lines(spark, sf_dir)).select("scan_id", "field", "value", F.round("score", 4).alias("score"))


@query(_table("value, score", (1, "'French', 0.7::double")))
def nationality_candidates_cards(spark, sf_dir):
    return fields.nationality_candidates(lines(spark, sf_dir)).select("scan_id", "value", "score")


@query(_table("line_no, value", (0, "8, sex"), (1, "5, sex"), (2, "4, sex"), (3, "3, sex")))
def sex_candidates_cards(spark, sf_dir):
    return fields.sex_candidates(lines(spark, sf_dir)).select("scan_id", F.floor(F.col("seq") / 1000).cast("int").alias("line_no"), "value")


@query(
    _table(
        "field, value, score",
        *((layout, f"'{k}', {v}, round(({base} + 0.2 * {50 + 5 * i} / 100.0)::double, 4)") for k, base in (("surname", 0.55), ("names", 0.5)) for layout, i, v in ((0, 0, "'REPUBLIKA E SHQIPERISE'"), (0, 2, "s"), (2, 0, "s"), (2, 1, "'ANNA ERIKS'"))),
    )
)
def uppercase_name_candidates_cards(spark, sf_dir):
    return fields.uppercase_name_candidates(lines(spark, sf_dir)).select("scan_id", "field", "value", F.round("score", 4).alias("score"))


_COLUMNS = "surname, names, nationality, sex, date_of_birth, expiration_date, number"


@query(_table(_COLUMNS, (0, "s, f, 'Albanian', sex, d, cast(null as varchar), n"), (1, "lower(s), lower(f), 'french', sex, e, e, n"), (2, "'ANNA ERIKS', cast(null as varchar), 'alb', sex, d, e, n"), (3, "lower(f), cast(null as varchar), 'Albanian', sex, d, e, n")))
def first_name_fallback_cards(spark, sf_dir):
    """All candidates ranked, then missing names filled in: a date with slashes gives way to the one below its label."""
    d = lines(spark, sf_dir)
    ranked = fields.rank_candidates(fields.all_candidates(d, _AS_OF()), _AS_OF())
    return fields.first_name_fallback(fields.wide(ranked), d).select("scan_id", *_COLUMNS.split(", "))


@query(
    _table(
        _COLUMNS,
        (0, "'REPUBLIKA E SHQIPERISE', s, 'Nationality', sex, d, cast(null as varchar), n"),
        (1, "concat(s, ' Given name'), concat(f, ' Nationality'), 'French', sex, replace(d, '.', '/'), e, e"),
        (2, "s, 'ANNA ERIKS', 'ALB', sex, d, e, n"),
        (3, "concat(f, ' Card no AB'), cast(null as varchar), 'Albanian', sex, d, e, n"),
    )
)
def extract_fields_regex_cards(spark, sf_dir):
    return fields.extract_fields_regex(lines(spark, sf_dir), _AS_OF()).select("scan_id", *_COLUMNS.split(", "))


@query(
    _table(
        "engine, surname, number",
        (0, "'ranking', s, n"), (1, "'ranking', lower(s), n"), (2, "'ranking', 'ANNA ERIKS', n"), (3, "'ranking', lower(f), n"),
    )
)
def field_mining(spark, sf_dir):
    d = fields.field_mining(lines(spark, sf_dir), _AS_OF())
    return d.select("scan_id", "engine", F.element_at("fields", "surname").alias("surname"), F.element_at("fields", "number").alias("number"))


_TURN = {w: k for k, w in enumerate(spatial.KEYWORDS)}
_HITS = (
    (0, "surname", "s"), (0, "given", "'name'"), (0, "birth", "d"), (0, "sex", "sex"), (0, "nationality", "'Shqiptare'"), (0, "mbiemri", "s"), (0, "emri", "'name'"), (0, "datelindja", "d"), (0, "gjinia", "sex"), (0, "shtetesia", "'Shqiptare'"), (0, "personal", "n"),
    (1, "name", "f"), (1, "surname", "s"), (1, "given", "concat('name: ', f)"), (1, "birth", "replace(d, '.', '/')"), (1, "expiry", "e"), (1, "number", "n"), (1, "sex", "sex"), (1, "nationality", "'French'"),
    (3, "surname", "concat('/ given ', f)"), (3, "given", "f"), (3, "sexe", "lower(sex)"), (3, "nat", "'Suomi'"),
)


@query(_table("k, field, value", *((layout, f"{_TURN[w]}, '{spatial.KEYWORDS[w]}', {v}") for layout, w, v in _HITS)))
def value_after_label_cards(spark, sf_dir):
    return spatial.value_after_label(rows(spark, sf_dir)).select("scan_id", "k", "field", "value")


_PHRASE = {p: (k, f) for k, (p, f) in enumerate(spatial.PHRASES)}
_PHRASE_HITS = ((0, "nr personal", "n"), (1, "date of birth", "replace(d, '.', '/')"), (1, "given name", "f"), (1, "document number", "n"))


@query(_table("k, field, value", *((layout, f"{_PHRASE[p][0]}, '{_PHRASE[p][1]}', {v}") for layout, p, v in _PHRASE_HITS)))
def value_after_phrase_cards(spark, sf_dir):
    return spatial.value_after_phrase(rows(spark, sf_dir)).select("scan_id", "k", "field", "value")


@query(
    _table(
        "field, value",
        *((0, x) for x in ("'date_of_birth', d", "'names', 'Surname ' || s || ' Emri'", "'surname', 'Surname ' || s || ' Emri'", "'nationality', 'Nationality Shqiptare Datelindja'", "'number', n")),
        *((1, x) for x in ("'date_of_birth', replace(d, '.', '/')", "'expiration_date', e", "'names', f || ' Nationality'", "'surname', s || ' Given name'", "'nationality', 'French Date of birth '", "'number', n", "'sex', sex")),
        *((2, x) for x in ("'date_of_birth', d", "'expiration_date', e", "'number', n", "'sex', sex")),
        *((3, x) for x in ("'date_of_birth', d", "'expiration_date', e", "'number', n", "'sex', sex", "'surname', 'given ' || f || ' Card no AB'")),
    )
)
def regex_values_cards(spark, sf_dir):
    return spatial.regex_values(rows(spark, sf_dir), _AS_OF())


_PASSES = (
    *((0, x) for x in ("'date_of_birth', d, 2", "'names', s, 3", "'nationality', 'Shqiptare', 2", "'number', n, 1", "'sex', sex, 2", "'surname', s, 2")),
    *((1, x) for x in ("'expiration_date', e, 2", "'names', f, 1", "'nationality', 'French', 2", "'number', n, 1", "'sex', sex, 2", "'surname', f, 2")),
    *((2, x) for x in ("'date_of_birth', d, 4", "'expiration_date', e, 4", "'names', 'ANNA ERIKS', 3", "'number', n, 4", "'sex', sex, 4", "'surname', s, 3")),
    *((3, x) for x in ("'date_of_birth', d, 4", "'expiration_date', e, 4", "'names', f, 2", "'nationality', 'Suomi', 2", "'number', n, 4", "'sex', sex, 2", "'surname', f, 2")),
)


@query(_table("field, value, pass", *_PASSES))
def resolve_passes_cards(spark, sf_dir):
    """All four passes: a date with slashes is taken by its label and then isn't plausible."""
    return spatial.spatial_fields(fx(spark, sf_dir, "fx_card_tokens"), _AS_OF()).select("scan_id", "field", "value", "pass")


@query("select scan_id, 'ALB' as doc_type from fx_card_base where scan_id % 4 in (0, 2)")
def detect_doc_type_cards(spark, sf_dir):
    """The first layout has words of its country at the top, the third one in the right tenth of its words' extent."""
    return spatial.detect_doc_type(fx(spark, sf_dir, "fx_card_tokens")).select("scan_id", "doc_type")


def typed(spark, sf_dir):
    """Words of cards of six types, and their pages."""
    d = fx(spark, sf_dir, "fx_typed_tokens")
    return d, d.select("scan_id").distinct().select("scan_id", F.lit(1000).alias("w"), F.lit(700).alias("h"), F.lit(500).alias("original_w"), F.lit(350).alias("original_h"))


_TYPE = "case t " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(CARD_TYPES)) + " end"


@query(f"select scan_id, {_TYPE} as doc_type from fx_typed_base where form < 3")
def detect_doc_type_typed(spark, sf_dir):
    """Six types; a number in the Russian form at the foot of a page is no sign, nor is a header outside the areas."""
    return spatial.detect_doc_type(*typed(spark, sf_dir)).select("scan_id", "doc_type")


_NATION = "case t when 1 then 'Shqiptare/Albanian' else " + _TYPE + " end"
_READ = {"surname": "s", "names": "f", "sex": "sex", "date_of_birth": "d", "expiration_date": "e", "number": "n", "nationality": _NATION}
_BY_TEMPLATE = " union all ".join(
    f"select scan_id, {_TYPE} as doc_type, '{k}' as field, {v} as value from fx_typed_base where form < 2" + ("" if all(k in spatial.TEMPLATES[t][3] for t in CARD_TYPES) else " and t <> 0") for k, v in _READ.items()
)


@query(_BY_TEMPLATE)
def template_fields_typed(spark, sf_dir):
    d, pages = typed(spark, sf_dir)
    return spatial.template_fields(d, pages.join(spatial.detect_doc_type(d, pages).select("scan_id", "doc_type"), "scan_id"))


# Of the generic way: the row of the value (label and value, 50 px apart), its box in half the size
_ROWS = (("surname", "s"), ("names", "f"), ("sex", "sex"), ("number", "n"), ("date_of_birth", "d"), ("expiration_date", "e"))
_LABELS = (7, 5, 3, 6, 5, 6)
_GENERIC = " union all ".join(
    f"select scan_id, cast(null as varchar) as doc_type, 'generic' as method, '{k}' as field, {v} as value, 2 as pass, {(60 - 4 * n) // 2} as x, {(300 + 50 * i - 8) // 2} as y, cast(floor((200 + 4 * len({v}) - {60 - 4 * n}) * 0.5) as int) as w, 18 as h from fx_typed_base where form >= 2 and len({v}) >= 2"
    for i, ((k, v), n) in enumerate(zip(_ROWS, _LABELS, strict=True))
)
_SEX = "select scan_id, cast(null as varchar) as doc_type, 'generic' as method, 'sex' as field, sex as value, 2 as pass, null::int as x, null::int as y, null::int as w, null::int as h from fx_typed_base where form >= 2"


@query(f"select scan_id, doc_type, 'template' as method, field, value, 0 as pass, null::int as x, null::int as y, null::int as w, null::int as h from ({_BY_TEMPLATE}) union all {_GENERIC} union all {_SEX}")
def spatial_fields_typed(spark, sf_dir):
    """Both routes: typed cards by their template; those without names there, and untyped ones, by labels, with boxes in the upload's pixels."""
    d, pages = typed(spark, sf_dir)
    return spatial.spatial_fields(d, _AS_OF(), pages).select("scan_id", "doc_type", "method", "field", "value", "pass", "x", "y", "w", "h")


_ALL_FIELDS = ("surname", "names", "number", "sex", "nationality", "date_of_birth", "expiration_date")
_WORDS = f"""select scan_id, field, line_no * 100 + word_no as n, text from fx_card_words, (values {", ".join(f"('{k}')" for k in _ALL_FIELDS)}) k(field) where (line_no * 7 + word_no * 31 + scan_id) % 100 >= 25"""
_PLAIN, _LETTERS, _NATIONS = "regexp_replace(text, '[^A-Za-z0-9]', '', 'g')", f"regexp_replace(text, '[^{spatial.LATIN}''-]', '', 'g')", f"regexp_replace(text, '[^{spatial.LATIN}/]', '', 'g')"
_FIRST = "select scan_id, field, {value} as value from w where field = '{field}' and {where} qualify row_number() over (partition by scan_id order by {order}n) = 1"


@query(
    f"with w as ({_WORDS}), "
    + "named as (select scan_id, field, v, row_number() over (partition by scan_id order by abs(len(v) - 6), n) as i from (select *, "
    + f"{_LETTERS} as v from w where field = 'names') where len(v) >= 2), "
    + r"dated as (select scan_id, field, regexp_extract(string_agg(text, ' ' order by n), '[0-9]{2}[.\-/ ][0-9]{2}[.\-/ ][0-9]{2,4}') as value from w where field in ('date_of_birth', 'expiration_date') group by all) "
    + " union all ".join(
        (
            "(" + _FIRST.format(value="case when contains(upper(text), 'M') then 'M' else 'F' end", field="sex", where="upper(text) in ('M', 'F', 'M/M')", order="") + ")",
            "(" + _FIRST.format(value=f"upper({_PLAIN})", field="number", where=f"len({_PLAIN}) >= 6 and regexp_matches({_PLAIN}, '[0-9]')", order=f"len({_PLAIN}) desc, ") + ")",
            "(" + _FIRST.format(value=_LETTERS, field="surname", where=f"len({_LETTERS}) >= 2", order=f"abs(len({_LETTERS}) - 7), ") + ")",
            "(" + _FIRST.format(value=_NATIONS, field="nationality", where=f"len({_NATIONS}) >= 3", order="") + ")",
            "select scan_id, field, string_agg(v, ' ' order by i) as value from named where i <= 2 group by all",
            "select * from dated where value <> ''",
        )
    )
)
def pick_from_words(spark, sf_dir):
    """Every field chosen from all words of a card, some of them too faint to count."""
    d = fx(spark, sf_dir, "fx_card_words").withColumn("field", F.explode(F.array(*map(F.lit, _ALL_FIELDS))))
    faint = (F.col("line_no") * 7 + F.col("word_no") * 31 + F.col("scan_id")) % 100
    return spatial.pick_from_words(d.select("scan_id", "field", (F.col("line_no") * 100 + F.col("word_no")).alias("n"), "text", faint.alias("conf")))
