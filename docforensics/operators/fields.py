"""Fields from OCR lines of documents without a machine-readable zone: candidates, cleaning, ranking."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import visual_date
from .mrz import bound



def _without_marks(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _ranges(points: list[int]) -> str:
    """Code points as ranges of a regular expression's class."""
    starts = [x for x in points if x - 1 not in set(points)]
    ends = [x for x in points if x + 1 not in set(points)]
    return "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in zip(starts, ends, strict=True))


#: Characters of the basic plane that decompose, marks left out, into one other character, and what each becomes.
_ONE = {c: d for c in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0x10000))) if len(d := _without_marks(c)) == 1 and d != c}
MARKED, PLAIN = "".join(_ONE), "".join(_ONE.values())
#: Latin letters and ligatures that become several.
SEVERAL = {c: d for c in map(chr, (*range(0xC0, 0x250), *range(0xFB00, 0xFB07))) if len(d := _without_marks(c)) > 1}
#: Combining marks; the bounds come first, so that most characters are told by one comparison.
MARKS = f"[\\x{{300}}-\\x{{1F000}}&&[{_ranges([i for i in range(0x300, 0x1F000) if unicodedata.combining(chr(i))])}]]"
#: Labels of each field in several languages, as regular expressions on normalised text.
LABELS = {
    "surname": r"(?:nom|surname|last\s*name|mbiemri)",
    "names": r"(?:prenom|first\s*name|given\s*name|emri)",
    "date_of_birth": r"(?:date\s*de\s*naissance|date\s*of\s*birth|naissance|birth|datelindja)",
    "expiration_date": r"(?:date\s*d.?expiration|date\s*of\s*expiry|expiration|expiry|skadimit|validite)",
    "number": r"(?:numero|number|document\s*number|personal\s*no|nr\.?\s*personal|leternjoftim)",
    "sex": r"(?:sexe|sex|gender|genre|gjinia)",
    "nationality": r"(?:nationalite|nationality|shtetesia|citizenship)",
}
#: Labels at the start of a value, and words that show that a value is a label.
LEADS = ("surname", "name", "given", "first", "last", "nom", "prenom", "mbiemri", "emri", "nationality", "nationalite", "shtetesia", "sex", "sexe")
ECHOES = ("surname", "givenname", "firstname", "lastname", "mbiemri", "emri")
NEAR_NAMES = ("name", "given", "emri", "surname", "mbiemri", "nationality")
SKIP = tuple("REPUBLIQUE REPUBLIC NATIONALE NATIONAL IDENTITE IDENTITY CARD CARTE PERMIS PASSEPORT PASSPORT NOM NAME PRENOM SURNAME FIRSTNAME DATE NAISSANCE BIRTH EXPIRATION VALIDITE VALIDITY SEXE SEX TUNISIE TUNISIA MAROC MOROCCO ALGERIE ALGERIA FRANCE BELGIQUE BELGIUM".split())
WEIGHTS = {"surname": 0.25, "date_of_birth": 0.25, "number": 0.20, "expiration_date": 0.15, "sex": 0.10, "nationality": 0.05}
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
DATE = r"([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2})"
NUMBER = "([A-Z]{0,2}[0-9][A-Z0-9-]{5,12})"
#: Labels of two languages whose value ends the line, and what the second extractor looks for in the text.
ANCHORS = {"surname": r"(?i)(?:mbiemri|surname)", "names": r"(?i)(?:emri|given\s*name|first\s*name)", "nationality": r"(?i)(?:shtetesia|nationality)"}
SEX_WORDS = r"(?i)\b(M|F|MALE|FEMALE|MASCULIN|FEMININ)\b"
NATION_LABEL = r"(?i)(?:nationality|nationalit[eé]|shtetesia)\s*[:/\-]?\s*"
SEX_WORD, NATION_CODE = r"(?iu)\b(Masculin|Féminin|Female|Male)\b", r"(?iu)(Nationalit[eé]|Citizenship|Pays)[:\s]+([A-Z]{2,3})"
NUMBER_LABEL = r"(?i)(?:nr\.?\s*(?:personal|card|document)?|card\s*no|personal\s*no)\s*[:\-]?\s*([A-Z0-9]{6,16})"
SEX_LABEL = r"(?iu)(?:gjinia|sex|sexe)\s*[:/\-]?\s*(M|F|Male|Female|Masculin|F[eé]minin)\b"
NAME_LEADS = ("surname", "name", "given", "first", "last", "mbiemri", "emri")
TITLE = "^[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]{2,}( [A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]{2,}){0,2}$"


def without_marks(c: Column) -> Column:
    """Text by its compatibility decomposition without combining marks, whether letters and marks are one character or several.

    Of characters that become several only Latin letters and ligatures are taken apart; Hangul
    syllables and characters beyond the basic plane stay. Text of ASCII alone is done as it stands.
    """
    apart = F.aggregate(F.split(F.lit(" ".join(a + b for a, b in SEVERAL.items())), " "), c, lambda t, x: F.replace(t, F.substring(x, 1, 1), F.substring(x, 2, 9)))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(apart, MARKED, PLAIN), MARKS, "")).otherwise(c)


def normalize_text(c: Column) -> Column:
    return F.trim(F.lower(without_marks(F.coalesce(c, F.lit("")))))


def clean_token(c: Column) -> Column:
    return F.regexp_replace(normalize_text(c), "[^a-z0-9]", "")


def separated_date(c: Column) -> Column:
    """A date with / . or - between day, month and year, or with / or - between year, month and day; else null."""
    orders = ((r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy"), (r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "dd-MM-yyyy"), (r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", "dd.MM.yyyy"), (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"), (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"))
    return F.coalesce(*(F.when(c.rlike(p), F.try_to_date(c, form)) for p, form in orders))


def without_leads(tokens: Column, leads: tuple[str, ...], drop: str = "[^a-z0-9]") -> Column:
    """Words without those in front that are labels once marks and what `drop` matches are gone."""

    def label(t: Column) -> Column:
        return F.regexp_replace(normalize_text(t), drop, "").isin(*leads)

    def step(a: Column, t: Column) -> Column:
        lead = a["lead"] & label(t)
        return F.struct(lead.alias("lead"), (a["n"] + lead.cast("int")).alias("n"))

    def rest(tokens: Column) -> Column:
        n = F.aggregate(tokens, F.struct(F.lit(True).alias("lead"), F.lit(0).alias("n")), step)["n"]
        # Most values have no label in front, and then their words aren't gone through
        return F.when(label(F.get(tokens, F.lit(0))), F.slice(tokens, n + 1, F.greatest(F.size(tokens), F.lit(1)))).otherwise(tokens)

    return bound(tokens, rest)


def dedupe_lines(lines: DataFrame) -> DataFrame:
    """The first line, by y then x, of those with the same cleaned text in the same cell of 8 by 8."""
    d = lines.withColumn("_t", clean_token(F.col("text"))).withColumn("_x", F.floor(F.col("x") / 8)).withColumn("_y", F.floor(F.col("y") / 8))
    order = Window.partitionBy("scan_id", "_t", "_x", "_y").orderBy("y", "x", "line_no")
    return d.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_t", "_x", "_y")


def _letters(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{LATIN}]", "")


def sanitize(field: Column, value: Column) -> Column:
    """A candidate without label words in front, cut down to what the field may be; empty if nothing is left."""
    v = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    tokens = F.filter(F.split(F.translate(v, "/|", "  "), " +"), lambda t: t != "")

    def cut(v: Column) -> Column:
        date = F.when(v.rlike(DATE), F.regexp_extract(v, DATE, 1)).otherwise(v)
        u = F.upper(normalize_text(v))
        sex = F.when(u.isin("M", "MALE", "MASCULIN"), "M").when(u.isin("F", "FEMALE", "FEMININ"), "F").otherwise(v)
        compact = F.upper(F.regexp_replace(v, r"\s+", ""))
        number = F.when(compact.rlike(NUMBER), F.regexp_extract(compact, NUMBER, 1)).otherwise(compact)
        echo = clean_token(v).rlike("^(?:name|given|nationalite)$|(?:surname|nationality)$")
        name = F.when(echo, "").otherwise(v)
        out = F.when(field.isin("date_of_birth", "expiration_date"), date).when(field == "sex", sex).when(field == "number", number).otherwise(name)
        return F.when(v == "", "").otherwise(out)

    return bound(F.array_join(without_leads(tokens, LEADS), " "), cut)


def is_plausible(field: Column, value: Column, as_of: Column) -> Column:
    def judged(v: Column) -> Column:
        echo = clean_token(v).rlike("|".join(ECHOES))
        compact = F.regexp_replace(F.upper(v), r"\s+", "")
        return F.when(v == "", False).otherwise(
            F.when(field.isin("surname", "names"), ~echo & (F.length(_letters(v)) >= 3))
            .when(field.isin("date_of_birth", "expiration_date"), v.rlike(r"[/.-]") & visual_date(v, as_of).isNotNull())
            .when(field == "sex", F.upper(v).isin("M", "F"))
            .when(field == "number", compact.rlike("[0-9]") & (F.length(compact) >= 6))
            .when(field == "nationality", F.length(_letters(v)) >= 3)
            .otherwise(True)
        )

    return bound(F.trim(F.coalesce(value, F.lit(""))), judged)


#: A candidate as it is found in a line, before it is cleaned.
_CANDIDATE = "array<struct<field:string,value:string,score:double,step:int,seq:bigint>>"
#: What may stand between a label and its value.
_AFTER = r"\s*[:/\-]?\s*"


def _candidate(field: Column, value: Column, score: Column, step: int, seq: Column) -> Column:
    return F.struct(field.alias("field"), value.alias("value"), score.cast("double").alias("score"), F.lit(step).alias("step"), seq.cast("bigint").alias("seq"))


def _where(there: Column, candidates: Column) -> Column:
    """The candidates of a line, which are only looked for where they may be."""
    return F.coalesce(F.when(there, candidates.cast(_CANDIDATE)), F.array().cast(_CANDIDATE))


def _matches(text: Column, patterns: dict[str, str]) -> Column:
    """field, k and value for each pattern that finds a value; the patterns are literals, so each is compiled once."""
    return F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("k"), F.regexp_extract(text, p, 1).alias("value")) for k, (f, p) in enumerate(patterns.items()))), lambda m: m["value"] != "")


def _found(lines: DataFrame, candidates: Column) -> DataFrame:
    """One row for each candidate of a line.

    They are cleaned within the array, as a filter on the value would otherwise be pushed below and clean it again.
    """
    cleaned = F.transform(candidates, lambda c: F.struct(c["field"].alias("field"), sanitize(c["field"], c["value"]).alias("value"), c["score"].alias("score"), c["step"].alias("step"), c["seq"].alias("seq")))
    return lines.select("scan_id", F.explode(cleaned).alias("c")).select("scan_id", "c.*").where("value <> ''")


def _with_next(lines: DataFrame, *columns: str) -> DataFrame:
    """Lines with norm, their number in the scan (i), and the columns of the next two (n1, n2)."""
    order = Window.partitionBy("scan_id").orderBy("line_no")
    return lines.select("scan_id", "line_no", *columns, normalize_text(F.col("text")).alias("norm"), F.row_number().over(order).alias("i"), *(F.lead(F.struct(*columns), i).over(order).alias(f"n{i}") for i in (1, 2)))


def _labelled() -> Column:
    norm = F.col("norm")
    near = [(F.col(f"n{i}"), i) for i in (1, 2)]

    def each(m: Column) -> Column:
        put = lambda value, score, o: _candidate(m["field"], value, score, 1, F.col("line_no") * 100 + m["k"] * 3 + o)
        below = (F.when((n["y"] - F.col("y")).between(0, 80), put(n["text"], 0.75 + n["conf"] * 0.5, i)) for n, i in near)
        return F.array_compact(F.array(put(m["value"], 1.0 + F.col("conf"), 0), *below))

    return _where(norm.rlike("|".join(LABELS.values())), F.flatten(F.transform(_matches(norm, {k: rf"{p}{_AFTER}(.+)$" for k, p in LABELS.items()}), each)))


def label_candidates(lines: DataFrame) -> DataFrame:
    """What stands after a label in its line, and the next two lines if they are at most 80 below.

    Output of all candidate operators: scan_id, field, value (cleaned), score, step, seq (the
    order in which they were found).
    """
    return _found(_with_next(lines, "text", "y", "conf"), _labelled())


def _anchored() -> Column:
    text = F.col("text")
    patterns = {k: rf"{p}{_AFTER}([{LATIN}' -]{{{'3,30' if k == 'nationality' else '2,40'}}})$" for k, p in ANCHORS.items()}
    score = lambda f: F.when(f == "nationality", 1.0 + F.col("conf") * 0.4).otherwise(1.2 + F.col("conf") * 0.5)
    return _where(text.rlike("|".join(ANCHORS.values())), F.transform(_matches(text, patterns), lambda m: _candidate(m["field"], m["value"], score(m["field"]), 2, F.col("line_no") * 3 + m["k"])))


def _is_albanian(norm: Column) -> Column:
    return F.contains(norm, F.lit("shqiptare")) | F.contains(norm, F.lit("albanian"))


def _albanian(there: Column) -> Column:
    return _where(there, F.array(_candidate(F.lit("nationality"), F.lit("Albanian"), F.lit(1.25), 3, F.lit(0))))


def anchor_candidates(lines: DataFrame) -> DataFrame:
    """Values that end their line after a label in two languages, and Albanian by its keywords."""
    albanian = lines.groupBy("scan_id").agg(F.max(_is_albanian(normalize_text(F.col("text")))).alias("a"))
    return _found(lines, _anchored()).unionByName(_found(albanian, _albanian(F.col("a"))))


def _days(raws: Column, day, as_of: Column) -> Column:
    """Of the dates of a line the one that may be of birth, the oldest (old), and the one that may be of expiry, the latest (late): day, p (its place), raw."""
    all_ = F.transform(raws, lambda raw, k: F.struct(day(raw).alias("day"), (F.col("line_no") * 1000 + k).alias("p"), raw.alias("raw")))
    old = lambda x: (F.datediff(as_of, x["day"]) / 365.25).between(10, 120)
    late = lambda x: F.year(x["day"]) >= F.year(as_of) - 5
    pick = lambda some: F.struct(F.array_min(F.filter(some, old)).alias("old"), F.array_max(F.filter(some, late)).alias("late"))
    return F.when(F.col("text").rlike(DATE), bound(all_, pick))


def _visual_days(as_of: Column) -> Column:
    return _days(F.regexp_extract_all("text", F.lit(DATE), F.lit(1)), lambda raw: visual_date(raw, as_of), as_of)


def dates_chosen(lines: DataFrame, as_of: Column) -> DataFrame:
    """Birth: the oldest date that gives an age of 10 to 120. Expiry: the latest from five years before as_of."""
    d = lines.select("scan_id", _visual_days(as_of).alias("days"))
    return d.groupBy("scan_id").agg(F.min("days.old")["raw"].alias("date_of_birth"), F.max("days.late")["raw"].alias("expiration_date"))


def _dated(birth: Column, expiry: Column) -> Column:
    put = lambda k, v: F.when(v.isNotNull(), _candidate(F.lit(k), v, F.lit(0.8), 4, F.lit(0)))
    return _where(birth.isNotNull() | expiry.isNotNull(), F.array_compact(F.array(put("date_of_birth", birth), put("expiration_date", expiry))))


def date_candidates(lines: DataFrame, as_of: Column) -> DataFrame:
    """The dates chosen, cleaned like other candidates: that turns slashes into spaces, so slashed dates fail later."""
    return _found(dates_chosen(lines, as_of), _dated(F.col("date_of_birth"), F.col("expiration_date")))


def _numbers() -> Column:
    found = F.regexp_extract_all(F.upper("text"), F.lit(rf"\b{NUMBER}\b"), F.lit(1))
    return _where(F.col("text").rlike("[0-9]"), F.transform(found, lambda v, k: _candidate(F.lit("number"), v, F.lit(0.7), 5, F.col("line_no") * 1000 + k)))


def docnum_candidates(lines: DataFrame) -> DataFrame:
    return _found(lines, _numbers())


def _sexes() -> Column:
    found = F.regexp_extract_all("text", F.lit(SEX_WORDS), F.lit(1))
    return _where(F.col("text").isNotNull(), F.transform(found, lambda v, k: _candidate(F.lit("sex"), v, F.lit(0.65), 6, F.col("line_no") * 1000 + k)))


def sex_candidates(lines: DataFrame) -> DataFrame:
    return _found(lines, _sexes())


def _nation_found() -> Column:
    """line_no and the nationality labelled in a line, which may stand in the lines after its label; null if none."""
    v = F.regexp_extract(F.concat_ws("\n", "text", F.col("n1")["text"], F.col("n2")["text"]), rf"{NATION_LABEL}([{LATIN}]{{3,20}})", 1)
    return bound(v, lambda v: F.when(v != "", F.struct(F.col("line_no").alias("line_no"), v.alias("v"))))


def _nations(v: Column) -> Column:
    return _where(v.isNotNull(), F.array(_candidate(F.lit("nationality"), v, F.lit(0.7), 7, F.lit(0))))


def nationality_candidates(lines: DataFrame) -> DataFrame:
    """The first labelled nationality; it may stand in the lines after its label."""
    d = _with_next(lines, "text").select("scan_id", _nation_found().alias("n"))
    return _found(d.groupBy("scan_id").agg(F.min("n")["v"].alias("v")), _nations(F.col("v")))


def _upper_words(c: Column) -> Column:
    words = F.filter(F.split(F.translate(F.trim(c), "-", " "), r"\s+"), lambda w: w != "")
    # Most lines have small letters or digits, which is told without their words
    return ~c.rlike("[a-z0-9]") & F.size(words).between(1, 4) & F.forall(words, lambda w: w.rlike(r"^\p{L}+$") & (F.upper(w) == w))


def _upper_names() -> Column:
    put = lambda k, base: _candidate(F.lit(k), F.trim("text"), base + F.col("conf") * 0.2, 8, F.col("line_no"))
    return _where(_upper_words(F.col("text")), F.array(put("surname", F.lit(0.55)), put("names", F.lit(0.5))))


def uppercase_name_candidates(lines: DataFrame) -> DataFrame:
    return _found(lines, _upper_names())


def all_candidates(lines: DataFrame, as_of: Column) -> DataFrame:
    """The candidates of all seven operators in one pass: what is of a whole scan is found in windows and stands with its first line."""
    scan = Window.partitionBy("scan_id")
    d = _with_next(lines, "text", "y", "conf").select("*", _is_albanian(F.col("norm")).alias("albanian"), _visual_days(as_of).alias("days"), _nation_found().alias("nation"))
    d = d.select("*", *(c.over(scan).alias(k) for k, c in (("albanian_of", F.max("albanian")), ("old_of", F.min("days.old")), ("late_of", F.max("days.late")), ("nation_of", F.min("nation")))))
    whole = F.concat(_albanian(F.col("albanian_of")), _dated(F.col("old_of.raw"), F.col("late_of.raw")), _nations(F.col("nation_of.v")))
    return _found(d, F.concat(_labelled(), _anchored(), _numbers(), _sexes(), _upper_names(), _where(F.col("i") == 1, whole)))


def rank_candidates(candidates: DataFrame, as_of: Column) -> DataFrame:
    """In each scan and field the plausible candidate with the best score, the first found of equals."""
    d = candidates.where(is_plausible(F.col("field"), F.col("value"), as_of))
    best = d.groupBy("scan_id", "field").agg(F.min_by(F.struct("value", "score", "step"), F.struct(-F.col("score"), F.col("step"), F.col("seq"))).alias("b"))
    return best.select("scan_id", "field", "b.*")


def wide(ranked: DataFrame) -> DataFrame:
    from .checks import FIELDS

    return ranked.groupBy("scan_id").pivot("field", list(FIELDS)).agg(F.first("value"))


def first_name_fallback(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """names where they are missing: a title-case line within four lines after the surname's, else the surest one; never the surname."""
    t = F.regexp_replace(F.trim("text"), r"\s+", " ")
    title = t.rlike(TITLE) & ~clean_token(F.col("text")).rlike("|".join(NEAR_NAMES))
    # Places are those among the scan's lines; a scan that lacks no name meets none of them
    scan = Window.partitionBy("scan_id")
    d = lines.select(F.col("scan_id").alias("_scan"), "line_no", "conf", clean_token(F.col("text")).alias("c"), t.alias("t"), title.alias("title"))
    f = fields.select("scan_id", F.struct("*").alias("f"), F.when(F.col("surname").isNotNull() & F.col("names").isNull(), clean_token(F.col("surname"))).alias("s"))
    d = f.join(d, (F.col("scan_id") == F.col("_scan")) & F.col("s").isNotNull(), "left")
    d = d.withColumn("i", F.row_number().over(scan.orderBy("line_no")))
    d = d.withColumn("at", F.min(F.when((F.col("s") != "") & F.contains("c", F.col("s")), F.col("i"))).over(scan))
    near = F.col("title") & F.col("i").between(F.col("at") + 1, F.col("at") + 4)
    sure = F.col("title") & (F.col("c") != F.col("s"))
    found = d.groupBy("scan_id").agg(
        F.first("f").alias("f"),
        F.min_by(F.when(near, F.col("t")), F.when(near, F.col("i"))).alias("near"),
        F.min_by(F.when(sure, F.col("t")), F.when(sure, F.struct(-F.col("conf"), F.col("i")))).alias("sure"),
    )
    out = found.select("f.*", "near", "sure")
    names = F.coalesce("names", "near", "sure")
    same = clean_token(F.col("surname")) == clean_token(names)
    return out.withColumn("names", F.when(F.coalesce(same, F.lit(False)), None).otherwise(names)).drop("near", "sure")


def reading_score(text: Column) -> Column:
    """Letters and digits, and 25 for each date."""
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) + 25 * F.regexp_count(text, F.lit(r"[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}"))


def best_ocr_variant(readings: DataFrame, text_col: str = "text") -> DataFrame:
    """scan_id, variant and score of the best reading, the first of equals."""
    d = readings.withColumn("score", reading_score(F.col(text_col)))
    return d.groupBy("scan_id").agg(F.min_by(F.struct("variant", "score"), F.struct(-F.col("score"), F.col("variant"))).alias("b")).select("scan_id", "b.*")


def clean_name(name: Column) -> Column:
    """A name without label words in front, and then without lower-case or short words in front of others."""

    def cut(tokens: Column) -> Column:
        size = F.size(tokens)

        def step(a: Column, t: Column) -> Column:
            weak = (F.length(t) <= 3) | ((F.lower(t) == t) & (F.upper(t) != t))
            more = a["go"] & weak & (size - a["n"] >= 2)
            return F.struct(more.alias("go"), (a["n"] + more.cast("int")).alias("n"))

        n = F.aggregate(tokens, F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), step)["n"]
        return F.array_join(F.slice(tokens, n + 1, F.greatest(size, F.lit(1))), " ")

    def leads(tokens: Column) -> Column:
        step = lambda a, t: F.struct((a["go"] & F.lower(t).isin(*NAME_LEADS)).alias("go"), (a["n"] + (a["go"] & F.lower(t).isin(*NAME_LEADS)).cast("int")).alias("n"))
        n = F.aggregate(tokens, F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), step)["n"]
        return F.slice(tokens, n + 1, F.greatest(F.size(tokens), F.lit(1)))

    tokens = F.filter(F.split(F.translate(name, "/", " "), r"\s+"), lambda t: t != "")
    return bound(bound(tokens, leads), cut)


def extract_fields_regex(lines: DataFrame, as_of: Column) -> DataFrame:
    """The second extractor, over lines and the text they make: one row of fields for each scan, null where nothing fits."""
    days = _days(F.regexp_extract_all("text", F.lit(rf"\b{DATE}\b"), F.lit(1)), separated_date, as_of)
    first = lambda k: F.min_by(k, F.when(F.col(k).isNotNull(), F.col("line_no")))
    t = F.col("text")
    number = F.regexp_extract(t, rf"\b{NUMBER}\b", 1)
    word = F.upper(F.regexp_extract(t, SEX_WORD, 1))
    nation = F.upper(F.regexp_extract(t, NATION_CODE, 2))
    clean = F.trim(F.translate(F.translate(t, ".,", ""), "-", " "))
    name = F.when(_upper_words(clean) & F.length(clean).between(2, 40) & ~F.arrays_overlap(F.split(clean, r"\s+"), F.array(*map(F.lit, SKIP))), clean)
    flat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    d = lines.select("scan_id", "line_no", "text", *(F.nullif(c, F.lit("")).alias(k) for k, c in (("_number", number), ("_word", word), ("_nation", nation))), name.alias("_name"), days.alias("_days"))
    d = d.groupBy("scan_id").agg(
        flat.alias("flat"), F.min("_days.old")["raw"].alias("date_of_birth"), F.max("_days.late")["raw"].alias("expiration_date"),
        *(first(k).alias(k[1:]) for k in ("_number", "_word", "_nation")),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("line_no", F.col("_name").alias("n"))))), lambda x: x["n"]).alias("upper"),
    )
    f = F.col("flat")
    hit = lambda p, i=1: F.nullif(F.trim(F.regexp_extract(f, p, i)), F.lit(""))
    named = lambda k: hit(rf"{ANCHORS[k]}\s*[:/\-]?\s*([{LATIN}' -]{{2,40}})")
    # A labelled sex goes before a word for it, which may stand anywhere
    sex = F.coalesce(F.upper(hit(SEX_LABEL)), F.col("word"))
    sex = F.when(sex.isin("MASCULIN", "MALE", "M"), "M").when(sex.isin("FÉMININ", "FEMININ", "FEMALE", "F"), "F")
    nation = F.coalesce("nation", hit(rf"{ANCHORS['nationality']}\s*[:/\-]?\s*([{LATIN}]{{3,20}})"), F.when(f.rlike(r"(?i)\bALBANIAN\b"), "Albanian"))
    d = d.select(
        "scan_id", "flat", "date_of_birth", "expiration_date", F.coalesce("number", F.upper(hit(NUMBER_LABEL))).alias("number"), sex.alias("sex"), nation.alias("nationality"),
        F.coalesce(F.get("upper", F.lit(0)), named("surname")).alias("surname"), F.coalesce(F.get("upper", F.lit(1)), named("names")).alias("names"),
    )
    after = F.nullif(F.call_function("regexp_extract", f, F.concat(F.lit(r"\Q"), F.col("surname"), F.lit(r"\E\s+([A-Z][a-zà-öø-ÿ]{2,30})")), F.lit(1)), F.lit(""))
    d = d.withColumn("names", F.coalesce("names", after)).withColumn("surname", clean_name(F.col("surname"))).withColumn("names", clean_name(F.col("names"))).drop("flat")
    same = F.upper("names") == F.upper("surname")
    enough = lambda k: F.when(F.length(_letters(F.col(k))) >= 2, F.col(k))
    compact = F.regexp_replace(F.upper("number"), r"\s+", "")
    return d.withColumn("names", F.when(F.coalesce(same, F.lit(False)), None).otherwise(enough("names"))).withColumn("surname", enough("surname")).withColumn("number", F.when(compact.rlike("[0-9]") & (F.length(compact) >= 6), F.col("number")))


def field_mining(lines: DataFrame, as_of: Column) -> DataFrame:
    """The job over lines: candidates of all kinds ranked, missing names filled in, and the second extractor where fewer than two fields were found."""
    kept = dedupe_lines(lines)
    first = first_name_fallback(wide(rank_candidates(all_candidates(kept, as_of), as_of)), kept)
    second = extract_fields_regex(kept, as_of)
    packed = lambda d: d.select("scan_id", F.map_filter(F.create_map(*(x for k in WEIGHTS | {"names": 0} for x in (F.lit(k), F.col(k)))), lambda k, v: F.coalesce(v, F.lit("")) != "").alias("fields"))
    return choose_extractor(packed(first), packed(second))


def visual_ocr_score(fields: DataFrame) -> DataFrame:
    """0.40 and a quarter of the weights of the fields that are there; 4 decimals."""
    there = sum((F.when(F.coalesce(F.col(k), F.lit("")) != "", w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    return fields.select("scan_id", F.round(0.40 + there * 0.25, 4).alias("score"))


def choose_extractor(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first extractor's map of fields if it has two or more besides raw_text, else the second's; engine says which."""
    d = second.select("scan_id", F.col("fields").alias("_b")).join(first.select("scan_id", F.col("fields").alias("_a")), "scan_id", "full")
    enough = F.size(F.map_filter("_a", lambda k, v: k != "raw_text")) >= 2
    return d.select("scan_id", F.when(enough, F.col("_a")).otherwise(F.col("_b")).alias("fields"), F.when(enough, "ranking").otherwise("regex").alias("engine"))
