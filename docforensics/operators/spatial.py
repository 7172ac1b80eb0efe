"""Fields from OCR words with coordinates: rows, labels and their values, boxes, document types and template regions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .checks import FIELDS
from .fields import LATIN, _without_marks, clean_token, normalize_text, separated_date, without_leads, without_marks
from .lineage import cut
from .mrz import bound

#: Labels of one word, in the order in which they are tried.
KEYWORDS = {
    "nom": "surname", "name": "surname", "surname": "surname", "last": "surname", "prenom": "names", "prénoms": "names", "given": "names", "first": "names", "firstname": "names",
    "naissance": "date_of_birth", "birth": "date_of_birth", "né": "date_of_birth", "née": "date_of_birth", "dob": "date_of_birth", "expiration": "expiration_date", "expiry": "expiration_date",
    "validité": "expiration_date", "validity": "expiration_date", "expires": "expiration_date", "numéro": "number", "number": "number", "n°": "number", "sexe": "sex", "sex": "sex", "genre": "sex",
    "gender": "sex", "nationalité": "nationality", "nationality": "nationality", "nat": "nationality", "pays": "nationality", "mbiemri": "surname", "emri": "names", "datelindja": "date_of_birth",
    "lindja": "date_of_birth", "skadimit": "expiration_date", "gjinia": "sex", "shtetesia": "nationality", "letërnjoftim": "number", "personal": "number",
}
#: Labels of several words, in the order in which they are tried.
PHRASES = (
    ("date de naissance", "date_of_birth"), ("date naissance", "date_of_birth"), ("date of birth", "date_of_birth"), ("date d expiration", "expiration_date"), ("date expiration", "expiration_date"), ("date of expiry", "expiration_date"),
    ("last name", "surname"), ("first name", "names"), ("given name", "names"), ("document number", "number"), ("document no", "number"), ("doc number", "number"), ("nr leternjoftim", "number"), ("nr letternjoftim", "number"), ("nr personal", "number"), ("personal no", "number"),
)
#: Regions of each type of document as shares of width and height (left, top, right, bottom), its keywords, number and nationality.
TEMPLATES = {
    "RUS": (("РОССИЙСКАЯ", "ФЕДЕРАЦИЯ", "ПАСПОРТ", "Фамилия"), None, None, {"surname": (0.38, 0.05, 0.88, 0.18), "names": (0.38, 0.25, 0.88, 0.42), "sex": (0.38, 0.48, 0.52, 0.58), "date_of_birth": (0.52, 0.48, 0.88, 0.58)}),
    "ALB": (("SHQIPËRISË", "ALBANIA", "LETËRNJOFTIM"), "[0-9]{8,10}", "Shqiptare/Albanian", {"surname": (0.31, 0.17, 0.72, 0.28), "names": (0.31, 0.28, 0.68, 0.38), "nationality": (0.31, 0.38, 0.74, 0.49), "number": (0.63, 0.38, 0.97, 0.49), "date_of_birth": (0.31, 0.52, 0.63, 0.63), "sex": (0.63, 0.52, 0.82, 0.63), "expiration_date": (0.63, 0.63, 0.97, 0.74)}),
    "ESP": (("ESPAÑA", "IDENTIDAD", "DNI"), "[A-Z]{3}[0-9]{6}", "ESP", {"surname": (0.30, 0.13, 0.66, 0.24), "names": (0.30, 0.30, 0.66, 0.41), "nationality": (0.42, 0.42, 0.65, 0.52), "sex": (0.30, 0.42, 0.42, 0.52), "date_of_birth": (0.30, 0.52, 0.66, 0.63), "number": (0.30, 0.63, 0.66, 0.73), "expiration_date": (0.30, 0.73, 0.66, 0.83)}),
    "EST": (("EESTI", "VABARIIK", "ESTONIA"), "[A-Z]{2}[0-9]{7}", "EST", {"surname": (0.36, 0.18, 0.78, 0.30), "names": (0.36, 0.30, 0.78, 0.42), "sex": (0.36, 0.48, 0.55, 0.56), "nationality": (0.36, 0.56, 0.62, 0.64), "date_of_birth": (0.36, 0.64, 0.78, 0.72), "number": (0.36, 0.78, 0.78, 0.87), "expiration_date": (0.36, 0.87, 0.78, 0.96)}),
    "FIN": (("SUOMI", "FINLAND", "HENKILÖKORTTI"), "[0-9]{9}", "FIN", {"surname": (0.30, 0.15, 0.62, 0.26), "names": (0.30, 0.26, 0.62, 0.37), "sex": (0.30, 0.37, 0.42, 0.47), "number": (0.42, 0.37, 0.80, 0.47), "nationality": (0.80, 0.37, 0.99, 0.47), "date_of_birth": (0.30, 0.47, 0.62, 0.58), "expiration_date": (0.30, 0.68, 0.62, 0.78)}),
    "SVK": (("SLOVENSKÁ", "REPUBLIKA", "OBČIANSKY"), "[A-Z]{2}[0-9]{6}", "SVK", {"surname": (0.38, 0.18, 0.75, 0.28), "names": (0.38, 0.28, 0.75, 0.38), "nationality": (0.38, 0.38, 0.62, 0.48), "sex": (0.38, 0.52, 0.55, 0.62), "date_of_birth": (0.62, 0.38, 0.99, 0.48), "number": (0.38, 0.62, 0.75, 0.72), "expiration_date": (0.62, 0.72, 0.99, 0.82)}),
}
#: Words in name regions that are labels.
NOISE = tuple(
    """surname given name nationality sex date birth expiry document number card mbiemri emri shtetesia gjinia sukunimi etunimet kansalaisuus sukupuoli priezvisko meno pohlavie
    citizenship documentnumber holder signature primer apellido segundo nombre nacionalidad perenimi eesnimi kodakondsus sunni aeg dokumendi kehtiv kuni korttinumero datum
    narodenia platnosti cislo obcanstvo perekonnanimi letternjoftim leternjoftim""".split()
)
#: Label words in front of a value, for words and for readings of template regions.
LEADS = ("name", "given", "surname", "first", "last", "prenom", "nom", "mbiemri", "emri", "nationality", "nationalite", "shtetesia", "sex", "sexe", "gjinia")
READING_LEADS = tuple("surname name given nationality sex date birth expiry card document mbiemri emri shtetesia gjinia meno priezvisko pohlavie sukunimi etunimet kansalaisuus sukupuoli eesnimi perenimi".split())
#: What a date, a document number, a word for a sex and labelled names (with the fewest letters, and what their text holds in lower case) look like in a page's text.
DATE = r"(?<![0-9])([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2})(?![0-9])"
NUMBER = r"(?<![A-Z0-9])([A-Z]{0,2}[0-9][A-Z0-9]{5,11})(?![A-Z0-9])"
SEX = r"(?iu)\b(Masculin|Féminin|Male|Female)\b"
BESIDE = {
    "surname": (r"(?i)(?:mbiemri|surname)", 2, ("mbiemri", "surname")), "names": (r"(?i)(?:emri|given\s*name|first\s*name)", 2, ("emri", "given", "first")), "nationality": (r"(?i)(?:shtetesia|nationality)", 3, ("shtetesia", "nationality")),
}
SEX_LABELS = ("sexe", "sex", "genre", "gender")
#: Characters of ASCII, in lower case, that are neither letters nor digits nor a line end.
OTHERS = "".join(c for c in map(chr, range(1, 128)) if not c.islower() and not c.isdigit() and c != "\n")
#: Letters whose upper case is several Latin letters. Spark and Python write them out (ß: SS); SQL engines that go letter by letter don't.
SEVERAL = "ßŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"
#: Words that are never a name.
NOT_NAMES = tuple("REPUBLIQUE REPUBLIC NATIONALE NATIONAL IDENTITE IDENTITY CARD CARTE PERMIS PASSEPORT PASSPORT NOM NAME PRENOM SURNAME FIRSTNAME DATE NAISSANCE BIRTH EXPIRATION VALIDITE VALIDITY SEXE SEX TUNISIE TUNISIA MAROC MOROCCO ALGERIE ALGERIA FRANCE BELGIQUE BELGIUM DOCUMENT NATIONALITY NATIONALITE GENRE GENDER".split())
#: Signs of a Russian, a Spanish and an Albanian document.
RUS_SIGN, ESP_SIGN, ALB_SIGN = r"[0-9]{2}\s*[0-9]{2}\s*[0-9]{5,7}", "DOCUMENTO|IDENTIDAD|ESPANA", "ALBANIA|SHQIP"
#: Areas of a page that tell its type, as shares of its width and height.
TOP, RIGHT, TOP_LEFT = 0.20, 0.90, (0.40, 0.35)
LATIN_TYPES = ("ALB", "ESP", "EST", "FIN", "SVK")
DAY = r"([0-9]{2}[.\-/ ][0-9]{2}[.\-/ ][0-9]{2,4})"


def group_token_rows(tokens: DataFrame, tolerance: int = 15) -> DataFrame:
    """row_key for each word: the first row, in the order in which rows were opened, whose top is within the tolerance.

    The fold depends on the order of words, so a scan's words come one after another in one task; only
    the keys of the scan at hand are held.
    """

    def fold(batches):
        scan, keys, first = None, [], True
        for batch in batches:
            out = []
            for at, top in zip(batch.column("scan_id").to_pylist(), batch.column("top").to_pylist(), strict=True):
                if first or at != scan:
                    scan, keys, first = at, [], False
                key = None if top is None else next((k for k in keys if abs(k - top) <= tolerance), None)
                if key is None and top is not None:
                    keys.append(key := top)
                out.append(key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "row_key"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    dealt = tokens.repartition("scan_id").sortWithinPartitions("scan_id", "line_no", "word_no")
    return dealt.mapInArrow(fold, f"{kind}, row_key int")


def _in_order(*columns: str) -> Column:
    """The words of a row from left to right: left, line_no, word_no and what else is asked for."""
    return F.array_sort(F.collect_list(F.struct("left", "line_no", "word_no", *columns)))


def _is_ascii(c: str) -> Column:
    return F.octet_length(c) == F.length(c)


def row_lines(tokens: DataFrame) -> DataFrame:
    """Rows of words (with row_key), each gathered once; given such rows, the same.

    scan_id, y (the row's key), own (its words in order), line (their texts), parts (of each word the runs of letters and
    digits without marks, blanks between), plain (the same without blanks), next and next_y (of the row below).
    """
    if {"own", "line", "parts", "plain", "next", "next_y"} <= set(tokens.columns):
        return tokens
    down = Window.partitionBy("scan_id").orderBy("y")
    d = tokens.repartition("scan_id").groupBy("scan_id", F.col("row_key").alias("y")).agg(_in_order("width", "text").alias("own"))
    d = d.select("*", F.lead("own").over(down).alias("next"), F.lead("y").over(down).alias("next_y"))
    # Letters are told apart from the rest in the whole row at once, its words parted by line ends
    joined = F.array_join(F.transform("own", lambda w: F.replace(F.coalesce(w["text"], F.lit("")), F.lit("\n"), F.lit(" "))), "\n")
    d = d.select("*", F.array_join(F.transform("own", lambda w: w["text"]), " ").alias("line"), joined.alias("joined"))
    d = d.withColumn("joined", F.translate(F.lower(without_marks(F.col("joined"))), OTHERS, " " * len(OTHERS)))
    blanks = F.when(_is_ascii("joined"), F.col("joined")).otherwise(F.regexp_replace("joined", "[^a-z0-9\n]", " "))
    d = d.withColumn("parts", F.split(F.trim(F.replace(F.replace(blanks, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))), "\n")).drop("joined")
    return d.withColumn("plain", F.transform("parts", lambda p: F.replace(p, F.lit(" "), F.lit(""))))


def _plain(label: str) -> str:
    return re.sub("[^a-z0-9 ]", "", _without_marks(label).lower()).strip()


def _hit(first: Column, last: Column, words: Column) -> Column:
    """A label of a row, from one word to another (counted from 0): where it begins and ends, and the words looked up."""
    begin, end = F.get("own", first), F.get("own", last)
    return F.struct((last + 1).alias("place"), begin["left"].alias("from_left"), (end["left"] + end["width"]).alias("right_from"), words.alias("words"))


def _word_hits() -> Column:
    """Of a row: its words that are labels as a whole or by their parts."""
    labels = [*dict.fromkeys(x for x in map(_plain, KEYWORDS) if x)]

    def words(p: Column, i: Column) -> Column:
        w = F.get("plain", i)
        known = F.array_intersect(F.concat(F.array(w), F.split(p, " ")), F.array(*map(F.lit, labels)))
        return F.when((F.contains(p, F.lit(" "))) | w.isin(*labels), known)  # others have no part but themselves

    found = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), words(p, i).alias("words"))), lambda x: F.size(x["words"]) > 0)
    return F.transform(found, lambda x: _hit(x["i"], x["i"], x["words"]))


def _phrase_hits() -> Column:
    """Of a row: labels of several words. No label begins with all words of another, so one word begins one label at most."""
    phrases = [_plain(p) for p, _ in PHRASES]
    assert not any(a != b and b.startswith(a + " ") for a in phrases for b in phrases)

    def label(w: Column, i: Column) -> Column:
        text = lambda n: F.concat_ws(" ", w, *(F.get("plain", i + j) for j in range(1, n)))
        found = (F.when((i + n <= F.size("plain")) & text(n).isin(*phrases), _hit(i, i + n - 1, F.array(text(n)))) for n in (3, 2))
        return F.when(w.isin(*{p.split()[0] for p in phrases}), F.coalesce(*found))

    return F.filter(F.transform("plain", label), lambda h: h.isNotNull())


def _values(hits: Column, labels, turn: int) -> Column:
    """Of a row, for each of its labels: pass, k, field, place, value, by the label's first place that has a value.

    The value is the words to the right of the place, else those of the next row within 60 px that don't lie before the label.
    labels: (word, field) in turn; labels without letters or digits are never found.
    """

    def value(h: Column) -> Column:
        right = F.filter(F.slice("own", h["place"] + 1, F.size("own")), lambda w: w["left"] >= h["right_from"] - 5)
        below = F.when(F.col("next_y") - F.col("y") <= 60, F.filter("next", lambda w: w["left"] >= h["from_left"] - 20))
        return F.array_join(F.transform(bound(right, lambda r: F.when(F.size(r) > 0, r).otherwise(below)), lambda w: w["text"]), " ")

    def step(found: Column, h: Column) -> Column:
        new = F.array_except(h["words"], F.transform(found, lambda x: x["w"]))
        have = bound(value(h), lambda v: F.when(v != "", F.transform(new, lambda w: F.struct(w.alias("w"), h["place"].alias("place"), v.alias("value")))).otherwise(none))
        return F.concat(found, F.when(F.size(new) > 0, have).otherwise(none))

    none = F.array().cast("array<struct<w:string,place:int,value:string>>")
    turns = F.array(*(F.struct(F.lit(_plain(w)).alias("w"), F.lit(k).alias("k"), F.lit(f).alias("field")) for k, (w, f) in enumerate(labels) if _plain(w)))
    of = lambda x: F.transform(F.filter(turns, lambda t: t["w"] == x["w"]), lambda t: F.struct(F.lit(turn).alias("pass"), t["k"].alias("k"), t["field"].alias("field"), x["place"].alias("place"), x["value"].alias("value")))
    return bound(hits, lambda hits: F.flatten(F.transform(F.when(F.size(hits) > 0, F.aggregate(hits, none, step)).otherwise(none), of)))


def _first_values(tokens: DataFrame, values: Column) -> DataFrame:
    d = row_lines(tokens).select("scan_id", "y", F.explode_outer(values).alias("v")).where("v is not null")
    return d.groupBy("scan_id", "v.k", "v.field").agg(F.min_by("v.value", F.struct("y", "v.place")).alias("value"))


def value_after_label(tokens: DataFrame) -> DataFrame:
    """For each one-word label (k is its turn) the value beside or below its first place that has one.

    A word may hold several labels (Mbiemri/Surname): it is looked up as a whole and by its parts.
    """
    return _first_values(tokens, _values(_word_hits(), KEYWORDS.items(), 2))


def value_after_phrase(tokens: DataFrame) -> DataFrame:
    """The same for labels of several words in a row."""
    return _first_values(tokens, _values(_phrase_hits(), PHRASES, 1))


def clean_read(field: Column, value: Column) -> Column:
    """A value without label words in front, cut down to what the field may be: the cleaner of words with coordinates."""

    def cut(tokens: Column) -> Column:
        v = F.array_join(tokens, " ")
        u = F.upper(normalize_text(v))
        alone = F.get(F.filter(F.transform(tokens, lambda t: F.upper(t)), lambda t: t.isin("M", "F")), F.lit(0))
        sex = F.when(u.isin("M", "MALE", "MASCULIN"), "M").when(u.isin("F", "FEMALE", "FEMININ"), "F").otherwise(F.coalesce(alone, v))
        compact = F.upper(F.array_join(tokens, ""))
        date, number = F.regexp_extract(v, DATE, 1), F.regexp_extract(compact, NUMBER, 1)
        out = F.when(field.isin("date_of_birth", "expiration_date"), F.when(date != "", date).otherwise(v)).when(field == "sex", sex)
        return out.when(field == "number", F.when(number != "", number).otherwise(compact)).otherwise(v)

    tokens = F.filter(F.split(F.translate(F.coalesce(value, F.lit("")), "/", " "), r"\s+"), lambda t: t != "")
    return bound(without_leads(tokens, LEADS), cut)


def _opened() -> Column:
    """Of a row: where it was opened."""
    return F.array_min(F.transform("own", lambda w: F.struct(w["line_no"].alias("line_no"), w["word_no"].alias("word_no"))))


def _letter() -> Column:
    """Of a row: M or F after its first label for a sex, in the rest of the row, or in the next row if the label ends it; else null."""
    label = F.array_position(F.transform("plain", lambda w: w.isin(*SEX_LABELS)), True).cast("int")
    beside = lambda at: F.when(at < F.size("own"), F.slice("own", at + 1, F.size("own"))).otherwise(F.col("next"))
    letter = lambda at: F.get(F.filter(F.transform(beside(at), lambda w: F.upper(w["text"])), lambda x: x.isin("M", "F")), F.lit(0))
    return bound(label, lambda at: F.when(at > 0, letter(at)))


def _upper_line() -> Column:
    """Of a row: its text if it is one to four upper-case words that are no labels; else null."""
    words = F.filter(F.split(F.translate(F.translate("line", ".,", ""), "-", " "), r"\s+"), lambda w: w != "")
    fits = lambda words: F.size(words).between(1, 4) & F.forall(words, lambda w: w.rlike(r"^\p{L}+$") & (F.upper(w) == w)) & ~F.arrays_overlap(words, F.array(*map(F.lit, NOT_NAMES)))
    return F.when(F.length("line").between(2, 40), F.when(bound(words, fits), F.trim("line")))


def _named(lines: Column) -> Column:
    """surname and names from a scan's upper-case rows (y, line), as field, value."""
    return F.array(*(F.struct(F.lit(f).alias("field"), F.get(F.array_sort(lines), F.lit(i))["line"].alias("value")) for i, f in enumerate(("surname", "names"))))


def _by_patterns(pages: DataFrame, as_of: Column) -> DataFrame:
    """pages with found: field, value of what patterns find; lines: (first, line) of a scan's rows; letter: of its last row that has one."""
    d = pages.withColumn("flat", F.array_join(F.transform(F.array_sort("lines"), lambda x: x["line"]), " ")).drop("lines")
    # A pattern goes through the whole page, so first a plain look tells whether it can be there at all
    digits = F.translate("flat", "123456789.-", "000000000//")
    d = d.select("*", F.lower("flat").alias("low"), digits.alias("digits"))
    holds = lambda c, *texts: F.greatest(*(F.contains(F.col(c), F.lit(t)) for t in texts), F.lit(False))
    days = F.transform(F.regexp_extract_all("flat", F.lit(DATE), F.lit(1)), lambda raw, at: F.struct(separated_date(raw).alias("day"), at.alias("at"), raw.alias("raw")))
    days = F.when(holds("digits", "00/00/0000", "0000/00/00"), F.filter(days, lambda x: x["day"].isNotNull()))
    runs = F.translate("digits", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 26)
    number = F.when(F.contains(runs, F.lit("0" * 6)), F.regexp_extract("flat", NUMBER, 1))
    word = F.when(holds("low", "male", "cul", "ém"), F.upper(normalize_text(F.regexp_extract("flat", SEX, 1))))
    norm = F.trim(F.when(holds("flat", "  ", *"\t\n\x0b\f\r"), F.regexp_replace("flat", r"\s+", " ")).otherwise(F.col("flat")))
    d = d.select(*pages.drop("lines").columns, "low", days.alias("days"), number.alias("number"), word.alias("word"), norm.alias("norm"))
    old = F.array_min(F.filter("days", lambda x: (F.datediff(as_of, x["day"]) / 365.25).between(10, 120)))["raw"]
    late = F.array_max(F.filter("days", lambda x: F.year(x["day"]) >= F.year(as_of) - 5))["raw"]
    sex = F.when(F.col("word").isin("MASCULIN", "MALE"), "M").when(F.col("word").isin("FEMININ", "FEMALE"), "F").otherwise(F.col("letter"))
    names = {k: F.when(holds("low", *signs), F.regexp_extract("norm", rf"{label}\s*[/:\-]?\s*([{LATIN}' -]{{{least},40}})", 1)) for k, (label, least, signs) in BESIDE.items()}
    values = {"date_of_birth": old, "expiration_date": late, "number": F.col("number"), "sex": sex, **names}
    return d.withColumn("found", F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items()))).drop("low", "days", "number", "word", "norm", "letter")


def regex_values(tokens: DataFrame, as_of: Column) -> DataFrame:
    """What patterns find in a page's text (rows in the order in which they were opened): scan_id, field, value.

    Birth is the oldest date that gives an age of 10 to 120, expiry the latest from five years before
    as_of; the first document number; a word for a sex, else M or F after a label for it (the last
    row that has one); what stands after labelled names and nationality.
    """
    rows = row_lines(tokens).select("scan_id", "y", "line", _opened().alias("first"), _letter().alias("letter"))
    pages = rows.groupBy("scan_id").agg(F.collect_list(F.struct("first", "line")).alias("lines"), F.max_by("letter", F.when(F.col("letter").isNotNull(), F.struct("y"))).alias("letter"))
    return _by_patterns(pages, as_of).select("scan_id", F.explode_outer("found").alias("f")).select("scan_id", "f.*").where("value <> ''")


def upper_values(tokens: DataFrame) -> DataFrame:
    """surname and names from the first two rows of one to four upper-case words that are no labels: scan_id, field, value."""
    d = row_lines(tokens).select("scan_id", "y", _upper_line().alias("line"))
    d = d.groupBy("scan_id").agg(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("y", "line"))).alias("l"))
    return d.select("scan_id", F.explode_outer(_named(F.col("l"))).alias("n")).select("scan_id", "n.field", "n.value").where("value is not null")


def all_passes(tokens: DataFrame, as_of: Column) -> DataFrame:
    """What the four passes find, from one look at the rows: scan_id, field, raw, pass, k.

    A row gives its text (pass 0, from which patterns read the page once it is whole) and its labels' values.
    """
    page = F.struct(F.lit(0).alias("pass"), F.lit(0).alias("k"), F.lit("").alias("field"), F.lit(0).alias("place"), F.col("line").alias("value"))
    of_row = F.concat(F.array(page), _values(_phrase_hits(), PHRASES, 1), _values(_word_hits(), KEYWORDS.items(), 2))
    d = row_lines(tokens).select("scan_id", "y", _opened().alias("first"), _letter().alias("letter"), _upper_line().alias("upper"), F.explode_outer(of_row).alias("v"))
    d = d.select("scan_id", "y", "first", "letter", "upper", "v.*")
    text = F.col("pass") == 0
    d = d.groupBy("scan_id", "pass", "k", "field").agg(
        F.min_by(F.when(~text, F.col("value")), F.struct("y", "place")).alias("value"),
        F.collect_list(F.when(text, F.struct("first", F.col("value").alias("line")))).alias("lines"),
        F.max_by("letter", F.when(F.col("letter").isNotNull(), F.struct("y"))).alias("letter"),
        F.collect_list(F.when(text & F.col("upper").isNotNull(), F.struct("y", F.col("upper").alias("line")))).alias("uppers"),
    )
    d = _by_patterns(d, as_of)
    given = lambda found, n: F.transform(found, lambda x: F.struct(x["field"].alias("field"), x["value"].alias("raw"), F.lit(n).alias("pass"), F.lit(0).alias("k")))
    whole = F.concat(given(_named(F.col("uppers")), 3), given(F.col("found"), 4))
    own = F.array(F.struct("field", F.col("value").alias("raw"), "pass", "k"))
    return d.select("scan_id", F.explode_outer(F.when(text, whole).otherwise(own)).alias("c")).select("scan_id", "c.*").where("raw <> ''")


def resolve_passes(phrase: DataFrame, keyword: DataFrame, regex: DataFrame, upper: DataFrame) -> DataFrame:
    """One value for each scan and field: phrase, then keyword, then (for names) upper-case rows over patterns, then patterns.

    Each input: scan_id, field, value and, for the first two, k (the turn of the label). Upper-case
    rows are taken as they stand, the others are cleaned. A chosen value that isn't plausible is
    left out; the next pass doesn't take its place.
    """
    turn = lambda d, n: d.select("scan_id", "field", F.col("value").alias("raw"), F.lit(n).alias("pass"), (F.col("k") if "k" in d.columns else F.lit(0)).alias("k"))
    return resolved(turn(phrase, 1).unionByName(turn(keyword, 2)).unionByName(turn(upper, 3)).unionByName(turn(regex, 4)))


def resolved(found: DataFrame) -> DataFrame:
    """The same from what all passes found: scan_id, field, raw, pass, k."""
    d = found.withColumn("value", F.when(F.col("pass") == 3, F.col("raw")).otherwise(clean_read(F.col("field"), F.col("raw"))))
    # No filter of empty values, which would clean each of them twice
    order = F.when(F.col("value") != "", F.struct("pass", "k", "value"))
    best = d.groupBy("scan_id", "field").agg(F.min_by(F.struct("value", "pass"), order).alias("b")).where("b is not null").select("scan_id", "field", "b.*")
    letters = F.length(F.regexp_replace("value", f"[^{LATIN}]", ""))
    day = separated_date(F.trim("value")).isNotNull()
    number = F.regexp_replace(F.upper("value"), r"\s+", "")
    fits = F.when(F.col("field").isin("surname", "names"), letters >= 2).when(F.col("field").isin("date_of_birth", "expiration_date"), day).when(F.col("field") == "sex", F.upper("value").isin("M", "F"))
    return best.where(fits.when(F.col("field") == "number", number.rlike("[0-9]") & (F.length(number) >= 6)).when(F.col("field") == "nationality", letters >= 3).otherwise(True))


def spatial_fields(tokens: DataFrame, as_of: Column, pages: DataFrame | None = None, readings: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """The job over words with coordinates: scan_id, field, value, pass, x, y, w, h; with pages also doc_type and method.

    Without pages each scan goes the generic way: rows, the four passes, one value for each scan and
    field, its box where it is found. With pages (scan_id, w, h: the size that coordinates are in;
    original_w and original_h if boxes are wanted in the pixels of the upload) the type of document is
    told first. Scans of a known type are read by its template (pass 0, without boxes), and where that
    gives neither surname nor names they go the generic way as well, which then alone counts.
    readings and words: see template_fields. Scans without a page have no type.

    Words without row_key are folded into rows once and cut off there; of words with row_key only the chosen values are cut
    off. Rows are gathered once for all passes, and once for the boxes if these are asked for.
    """
    if pages is None:
        return _generic_fields(tokens, as_of)
    typed = cut(detect_doc_type(tokens, pages).select("scan_id", "doc_type").join(pages, "scan_id"))
    by_template = template_fields(tokens, typed, readings, words)
    named = by_template.where(F.col("field").isin("surname", "names")).select("scan_id").distinct()
    by_template = cut(by_template.join(named, "scan_id", "left_semi"))
    generic = _generic_fields(tokens.join(by_template.select("scan_id").distinct(), "scan_id", "left_anti"), as_of)
    if {"original_w", "original_h"} <= set(pages.columns):
        sized = generic.join(pages.select("scan_id", F.col("w").alias("_w"), F.col("h").alias("_h"), "original_w", "original_h"), "scan_id", "left")
        known = F.col("x").isNotNull() & F.col("_w").isNotNull()
        moved = rescale_boxes(sized.where(known), (F.col("_w"), F.col("_h")), (F.col("original_w"), F.col("original_h")))
        generic = moved.select(generic.columns).unionByName(sized.where(~known).select(generic.columns))
    box = [F.lit(None).cast("int").alias(c) for c in "xywh"]
    template = by_template.select("scan_id", "field", "value", F.lit(0).alias("pass"), *box, "doc_type", F.lit("template").alias("method"))
    generic = generic.select("scan_id", "field", "value", "pass", "x", "y", "w", "h", F.lit(None).cast("string").alias("doc_type"), F.lit("generic").alias("method"))
    return template.unionByName(generic)


def _generic_fields(tokens: DataFrame, as_of: Column) -> DataFrame:
    # Given rows are cheap to gather again for the boxes, and many times the text if kept
    rows = tokens if "row_key" in tokens.columns else cut(group_token_rows(tokens)).repartition("scan_id")
    fields = cut(resolved(all_passes(rows, as_of)))
    return fields.join(field_bbox(rows, fields.select("scan_id", "field", "value")), ["scan_id", "field"], "left").select("scan_id", "field", "value", "pass", "x", "y", "w", "h")


def upper_by_letter(c: Column) -> Column:
    """Upper case letter by letter: letters that have no single Latin one are left out, not written out."""
    return F.upper(F.translate(c, SEVERAL, ""))


def field_bbox(tokens: DataFrame, fields: DataFrame, upper=F.upper) -> DataFrame:
    """The extent (36 px high) of the first row that holds a field's value, or its first 12 characters if it has 6 or more.

    upper: how values and rows are put in upper case before they are compared; as it stands ß and SS are the same.
    """
    compact = lambda c: F.regexp_replace(upper(c), "[^A-Z0-9À-ÖØ-öø-ÿ]", "")
    text = compact(F.array_join(F.transform(_in_order("text"), lambda w: w["text"]), ""))
    lines = tokens.repartition("scan_id").groupBy("scan_id", F.col("row_key").alias("row")).agg(text.alias("line"), F.min("left").alias("x"), F.min("top").alias("y"), F.max(F.col("left") + F.col("width")).alias("r"))
    f = fields.withColumn("v", compact(F.col("value"))).where("length(v) >= 2")
    short = F.substring("v", 1, 12)
    d = f.join(lines, "scan_id").where(F.contains("line", F.col("v")) | ((F.length(short) >= 6) & F.contains(F.col("line"), short)))
    best = d.groupBy("scan_id", "field").agg(F.min_by(F.struct("x", "y", F.greatest(F.lit(1), F.col("r") - F.col("x")).alias("w"), F.lit(36).alias("h")), F.struct("row")).alias("b"))
    return best.select("scan_id", "field", "b.*")


def rescale_boxes(boxes: DataFrame, from_size: tuple[Column, Column], to_size: tuple[Column, Column]) -> DataFrame:
    """x, y, w, h in another image size, cut to whole pixels, at least 1 wide and high."""
    at = lambda c, i: F.floor(F.col(c) * to_size[i] / F.greatest(from_size[i], F.lit(1))).cast("int")
    one = lambda c: F.greatest(F.lit(1), c)
    return boxes.select(*[c for c in boxes.columns if c not in "xywh"], at("x", 0).alias("x"), at("y", 1).alias("y"), one(at("w", 0)).alias("w"), one(at("h", 1)).alias("h"))


def regions(spark) -> DataFrame:
    """doc_type, field, x1, y1, x2, y2: the regions of all templates."""
    rows = [(t, f, *map(float, box)) for t, (_, _, _, boxes) in TEMPLATES.items() for f, box in boxes.items()]
    return spark.createDataFrame(rows, "doc_type string, field string, x1 double, y1 double, x2 double, y2 double")


def tokens_in_region(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Words whose centre lies in a region of the page's type, bounds included; pages: scan_id, doc_type, w, h."""
    d = tokens.join(pages, "scan_id").withColumn("cx", F.col("left") + F.col("width") / 2).withColumn("cy", F.col("top") + F.col("height") / 2)
    boxes = F.broadcast(regions(tokens.sparkSession))  # 40 rows
    scaled = d.join(boxes, "doc_type").select(d["*"], "field", *((F.col(k) * F.col(s)).alias(k) for k, s in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h"))))
    inside = scaled.where("cx between x1 and x2 and cy between y1 and y2")
    return inside.select("scan_id", "doc_type", "line_no", "word_no", "text", "left", "conf", "cx", "cy", "field", "x1", "y1", "x2", "y2")


def best_from_region(region: DataFrame) -> DataFrame:
    """One value for each scan and field from the words of its region."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.floor(F.col("cy") / 12).alias("l"), F.col("left").alias("x"), F.col("line_no").alias("n"), F.col("word_no").alias("o"), F.col("text").alias("text")))), lambda t: t["text"]), " ")
    d = region.groupBy("scan_id", "doc_type", "field").agg(ordered.alias("joined"))
    up = F.regexp_replace(F.upper("joined"), "[^A-Z0-9 ]", " ")
    number, nationality = F.lit(""), F.lit("")
    for t, (_, pattern, nation, _) in TEMPLATES.items():
        if pattern:
            number = F.when(F.col("doc_type") == t, F.regexp_extract(up, rf"\b{pattern}\b", 0)).otherwise(number)
            nationality = F.when(F.col("doc_type") == t, nation).otherwise(nationality)
    sex = F.when(F.upper("joined").rlike(r"\bM\b|M/M"), "M").when(F.upper("joined").rlike(r"\bF\b"), "F").otherwise("")
    value = F.when(F.col("field") == "sex", sex).when(F.col("field") == "number", number).when(F.col("field") == "nationality", nationality).otherwise(F.regexp_extract("joined", DAY, 1))
    plain = d.where("field not in ('surname', 'names')").select("scan_id", "doc_type", "field", value.alias("value"))
    v = F.regexp_replace("text", f"[^{LATIN}'-]", "")
    n = region.where("field in ('surname', 'names')").withColumn("v", v)
    target = F.col("y1") + (F.col("y2") - F.col("y1")) * 0.62
    noisy = F.lower("v").rlike("|".join(NOISE)) | F.upper("v").isin("ESP", "EST", "FIN", "SVK", "ALB")
    far = (F.col("doc_type") != "RUS") & (F.col("cx") > F.col("x1") + (F.col("x2") - F.col("x1")) * 0.78)
    n = n.where(F.length("v").between(2, 16) & ~noisy & ~far)
    score = F.col("conf") + F.greatest(F.lit(0.0), 20 - F.abs(F.col("cy") - target) / 2) + F.least(F.lit(8.0), F.length("v").cast("double")) + F.when(F.length("v") <= 2, -8.0).otherwise(0.0)
    order = Window.partitionBy("scan_id", "field").orderBy(F.desc(score), F.length("v"), "line_no", "word_no")
    n = n.withColumn("i", F.row_number().over(order)).where("i = 1 or (i = 2 and field = 'names')")
    names = n.groupBy("scan_id", "doc_type", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]), " ").alias("value"))
    return plain.unionByName(names).where("value <> ''")


def clean_reading(field: Column, value: Column) -> Column:
    """A reading of a template region without label words in front, cut down to what the field may be; empty if nothing is left."""

    def cut(tokens: Column) -> Column:
        v = F.array_join(tokens, " ")
        up = F.upper(v)
        sex = F.when(F.contains(up, F.lit("M")), "M").when(F.contains(up, F.lit("F")), "F").otherwise("")
        compact = F.upper(F.regexp_replace(v, "[^A-Za-z0-9]", ""))
        number = F.when((F.length(compact) >= 6) & compact.rlike("[0-9]"), compact).otherwise(F.regexp_extract(up, "([A-Z0-9]{6,})", 1))
        words = lambda more, least: F.filter(F.split(F.regexp_replace(v, f"[^{LATIN}{more} -]", " "), " +"), lambda w: F.length(w) >= least)
        names = words("'", 2)
        nations = words("/", 3)
        coded = F.filter(nations, lambda w: F.contains(w, F.lit("/")) | (F.length(w) == 3))
        out = F.when(field == "sex", sex).when(field.isin("date_of_birth", "expiration_date"), F.regexp_extract(v, DAY, 1)).when(field == "number", number)
        out = out.when(field == "surname", F.coalesce(F.get(names, F.lit(0)), F.lit(""))).when(field == "names", F.array_join(F.slice(names, 1, 2), " "))
        return out.when(field == "nationality", F.coalesce(F.get(coded, F.lit(0)), F.get(nations, F.lit(0)), F.lit(""))).otherwise(v)

    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"\s+", " "), r"^[.,:;|_\-/\\~`'\"()\[\]{}]+|[.,:;|_\-/\\~`'\"()\[\]{}]+$", "")
    tokens = F.filter(F.split(bare, r"\s+"), lambda t: t != "")
    return bound(without_leads(tokens, READING_LEADS, "[^a-z]"), cut)


def normalize_by_template(doc_type: Column, field: Column, value: Column) -> Column:
    """The last cleaning of a value by its type of document; empty if it doesn't fit."""
    v = F.trim(F.coalesce(value, F.lit("")))
    words = F.filter(F.transform(F.split(v, r"\s+"), lambda w: F.regexp_replace(w, f"[^{LATIN}'-]", "")), lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*NOISE))
    words = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Ll}\p{Lu}"), F.substr(w, F.lit(2))).otherwise(w))
    start = F.aggregate(words, F.struct(F.lit(True).alias("lead"), F.lit(0).alias("n")), lambda a, w: F.struct((a["lead"] & (F.length(w) <= 2)).alias("lead"), (a["n"] + F.when(a["lead"] & (F.length(w) <= 2), 1).otherwise(0)).alias("n")))["n"]
    words = F.slice(words, start + 1, F.lit(2))
    words = F.transform(words, lambda w: F.when((F.length(w) >= 4) & w.startswith("O") & (F.upper(F.substr(w, F.lit(2))) == F.substr(w, F.lit(2))), F.substr(w, F.lit(2))).otherwise(w))
    name = F.array_join(words, " ")
    name = F.when(F.upper(name).isin(*LATIN_TYPES) | (doc_type.isin(*LATIN_TYPES) & F.exists(words, lambda w: F.length(w) > 20)), "").otherwise(name)
    up = F.regexp_replace(F.upper(v), "[^A-Z/]", "")
    known = doc_type.isin("ESP", "EST", "FIN", "SVK")
    code = F.coalesce(*(F.when(known & F.contains(up, F.lit(c)), c) for c in ("ESP", "EST", "FIN", "SVK")), clean_reading(field, v))
    nation = F.when(doc_type == "ALB", F.when(up.rlike("ALBANIAN|SHQIPTARE|ALB"), "Shqiptare/Albanian").otherwise("")).otherwise(code)
    plain = F.regexp_replace(F.upper(v), "[^A-Z0-9]", "")
    number = F.when(F.length(plain) >= 6, plain).otherwise("")
    for t, (_, pattern, _, _) in TEMPLATES.items():
        number = F.when(doc_type == t, F.regexp_extract(plain, pattern, 0) if pattern else F.lit("")).otherwise(number)
    sex = F.when(F.contains(F.upper(v), F.lit("M")), "M").when(F.contains(F.upper(v), F.lit("F")), "F").otherwise("")
    day = F.trim(F.regexp_extract(v, DAY, 1))
    return F.when(field.isin("surname", "names"), name).when(field == "nationality", nation).when(field == "number", number).when(field == "sex", sex).when(field.isin("date_of_birth", "expiration_date"), day).otherwise(v)


def score_field_value(field: Column, value: Column) -> Column:
    """Quality of a reading of a field; -1 if it is empty or doesn't fit."""
    letters = F.length(F.regexp_replace(value, f"[^{LATIN}]", ""))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    up = F.upper(value)
    words = F.size(F.filter(F.split(value, r"\s+"), lambda w: w != ""))
    penalty = F.when(up.rlike("NATIONALITY|BIRTH|SURNAME|GIVEN|NAME|DATE|SEX"), 10).otherwise(0) + F.when(words > 2, 8).otherwise(0) + F.when(letters > 24, 6).otherwise(0)
    nation = F.when(F.contains(value, F.lit("/")), letters + 5).when(F.length(value) == 3, 8).when(up == "ALBANIAN", 9).when(F.contains(up, F.lit("BIRTH")), letters - 3).otherwise(letters)
    number = F.when((F.length(value) >= 6) & (digits > 0), 10 - F.greatest(F.lit(0), F.length(F.regexp_replace(value, r"[^\p{L}]", "")) - 3)).otherwise(-1)
    out = F.when(field.isin("surname", "names"), letters - digits * 4 - penalty).when(field == "nationality", nation).when(field == "sex", F.when(value.isin("M", "F"), 10).otherwise(-1))
    out = out.when(field.isin("date_of_birth", "expiration_date"), F.when(value.rlike(DAY), 10).otherwise(-1)).when(field == "number", number).otherwise(F.length(value))
    return F.when(F.coalesce(value, F.lit("")) == "", -1).otherwise(out)


def pick_from_words(words: DataFrame) -> DataFrame:
    """A field's value from the words read in its region: scan_id, field, value; words: scan_id, field, n (their order), text, conf.

    Words of a confidence below 25 and blank ones don't count. A sex is the first word M, F or M/M; a
    date the first in the words joined; a number the longest word of six characters or more with a
    digit; a surname the word nearest to 7 letters; names the two nearest to 6; a nationality the
    first word of three letters or more. The first of equals. Fields without such a word have no row.
    """
    d = words.where("conf >= 25 and trim(text) <> ''").select("scan_id", "field", "n", F.trim("text").alias("text"))
    d = d.groupBy("scan_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("t"))
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    sex = first(F.filter(F.transform("t", lambda w: F.upper(w)), lambda w: w.isin("M", "F", "M/M")))
    plain = F.filter(F.transform("t", lambda w: F.upper(F.regexp_replace(w, "[^A-Za-z0-9]", ""))), lambda w: (F.length(w) >= 6) & w.rlike("[0-9]"))
    letters = F.filter(F.transform("t", lambda w: F.regexp_replace(w, f"[^{LATIN}'-]", "")), lambda w: F.length(w) >= 2)
    near = lambda a, n: F.transform(F.array_sort(F.transform(a, lambda w, i: F.struct(F.abs(F.length(w) - n).alias("off"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    longest = F.transform(F.array_sort(F.transform(plain, lambda w, i: F.struct((-F.length(w)).alias("off"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    nations = F.filter(F.transform("t", lambda w: F.regexp_replace(w, f"[^{LATIN}/]", "")), lambda w: F.length(w) >= 3)
    field = F.col("field")
    value = F.when(field == "sex", F.when(F.contains(sex, F.lit("M")), "M").when(sex == "F", "F")).when(field.isin("date_of_birth", "expiration_date"), F.regexp_extract(F.array_join("t", " "), DAY, 1))
    value = value.when(field == "number", first(longest)).when(field == "surname", first(near(letters, 7))).when(field == "names", F.array_join(F.slice(near(letters, 6), 1, 2), " ")).when(field == "nationality", first(nations))
    return d.select("scan_id", "field", value.alias("value")).where("value <> ''")


def best_reading(readings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The reading (scan_id, field, variant, value) of the best score once it is cleaned, the first of equals, if it scores above -1.

    The choice from words, where words are given, comes before all readings and isn't cleaned.
    """
    d = readings.select("scan_id", "field", F.col("variant").cast("int").alias("variant"), clean_reading(F.col("field"), F.col("value")).alias("value"))
    if words is not None:
        d = d.unionByName(pick_from_words(words).select("scan_id", "field", F.lit(-1).alias("variant"), "value"))
    d = d.withColumn("score", score_field_value(F.col("field"), F.col("value"))).where("score > -1")
    return d.groupBy("scan_id", "field").agg(F.min_by(F.struct("value", "score"), F.struct(-F.col("score"), F.col("variant"))).alias("b")).select("scan_id", "field", "b.*")


def template_fields(tokens: DataFrame, pages: DataFrame, readings: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """scan_id, doc_type, field, value of typed pages (scan_id, doc_type, w, h), by the regions of their template.

    Where a region's words give nothing, readings of the region alone count (scan_id, field, variant,
    value): the first one, else, for surname, names and number, the best of all and of the choice
    from words. Values that don't fit the type are left out.
    """
    found = best_from_region(tokens_in_region(tokens, pages.select("scan_id", "doc_type", "w", "h")))
    normal = lambda d: d.withColumn("value", normalize_by_template(F.col("doc_type"), F.col("field"), F.col("value"))).where("value <> ''")
    turns = [normal(found).select("scan_id", "doc_type", "field", "value", F.lit(0).alias("turn"))]
    if readings is not None:
        asked = pages.select("scan_id", "doc_type").join(F.broadcast(regions(tokens.sparkSession).select("doc_type", "field")), "doc_type")  # 40 rows
        quick = readings.groupBy("scan_id", "field").agg(F.min_by("value", "variant").alias("value")).withColumn("value", clean_reading(F.col("field"), F.col("value")))
        best = best_reading(readings, words).where(F.col("field").isin("surname", "names", "number")).select("scan_id", "field", "value")
        turns += [normal(d.join(asked, ["scan_id", "field"])).select("scan_id", "doc_type", "field", "value", F.lit(i).alias("turn")) for i, d in ((1, quick), (2, best))]
    d = reduce(DataFrame.unionByName, turns)
    return d.groupBy("scan_id", "doc_type", "field").agg(F.min_by("value", "turn").alias("value"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings, as the share of characters in matching blocks."""
    return pd.Series([SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b, strict=True)])


def _grams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters of a string of two or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))


def alike_words(words: DataFrame, fuzzy: bool = True) -> DataFrame:
    """word with the turn, doc_type and keyword that it holds, that hold it, or that are alike to 0.78; words: distinct, of three characters or more.

    Either way two characters in a row are the same in both: were all blocks that match one
    character long, at most a third of both lengths (and one) could match, less than 0.78 for
    keywords of five. So words meet keywords by such pairs, of which the keywords have some hundred.
    """
    keys = [(i, t, k) for i, (t, (ks, _, _, _)) in enumerate(TEMPLATES.items()) for k in ks]
    keys = words.sparkSession.createDataFrame(keys, "turn int, doc_type string, keyword string").withColumn("key", F.upper(clean_token(F.col("keyword")))).where("key <> ''")
    index = F.broadcast(keys.withColumn("grams", _grams(F.col("key"))).withColumn("gram", F.explode("grams")))
    met = words.select("word", _grams(F.col("word")).alias("own")).withColumn("gram", F.explode("own")).join(index, "gram")
    pairs = met.where(F.get(F.array_intersect("own", "grams"), F.lit(0)) == F.col("gram")).select("word", "turn", "doc_type", "keyword", "key")  # each pair once
    held = F.contains("word", F.col("key")) | F.contains("key", F.col("word"))
    out = pairs.where(held)
    if fuzzy:
        # The ratio is at most twice the characters that can match over both lengths: those that the other string holds too.
        # Apart from the pairs held, so that Python sees only pairs within that bound
        shared = F.least(*(F.length(a) - F.length(F.expr(f"translate({a}, {b}, '')")) for a, b in (("word", "key"), ("key", "word"))))
        likely = (F.length("key") >= 5) & (2 * shared >= 0.78 * (F.length("word") + F.length("key")))
        out = out.unionByName(pairs.where(~held & likely).where(sequence_ratio(F.col("key"), F.col("word")) >= 0.78))
    return out.drop("key")


def detect_doc_type(tokens: DataFrame, pages: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """doc_type and hits for scans whose words hold keywords of a template, contained either way or alike to 0.78.

    Only words count whose centre lies in the top fifth of the page, in its right tenth, or in its top
    left (0.40 by 0.35). A number in the Russian form counts 2 more, in the right tenth alone, where
    its words may stand one after another; so do some Spanish and Albanian words. Ties go by the order
    of the templates. Every distinct word is compared once, not every place of it.

    pages: scan_id, w, h; without them the extent of a scan's words is its page. Words without coordinates
    all count, and none of them lies in the right tenth. Scans without any sign have no row.
    """
    if {"left", "top", "width", "height"} <= set(tokens.columns):
        if pages is None:
            pages = tokens.groupBy("scan_id").agg(F.max(F.col("left") + F.col("width")).alias("w"), F.max(F.col("top") + F.col("height")).alias("h"))
        cx, cy = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
        d = tokens.join(pages.select("scan_id", "w", "h"), "scan_id").withColumn("right", cx >= F.floor(F.col("w") * RIGHT))
        d = d.where(F.col("right") | (cy < F.floor(F.col("h") * TOP)) | ((cx < F.floor(F.col("w") * TOP_LEFT[0])) & (cy < F.floor(F.col("h") * TOP_LEFT[1]))))
    else:
        d = tokens.withColumn("right", F.lit(False))
    order = [c for c in ("line_no", "word_no") if c in tokens.columns]
    d = d.select("scan_id", *order, F.trim(F.upper(normalize_text(F.col("text")))).alias("text"), "right")
    words = d.select("scan_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z0-9]{3,})"), F.lit(1))).alias("word")).distinct()
    vocabulary = alike_words(words.select("word").distinct(), fuzzy)
    hits = words.join(vocabulary, "word").select("scan_id", "turn", "doc_type", "keyword").distinct().groupBy("scan_id", "turn", "doc_type").agg(F.count("*").alias("hits"))
    strip = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("right"), F.struct(*order, "text")))), lambda x: x["text"]), " ")
    extra = d.groupBy("scan_id").agg(
        strip.rlike(RUS_SIGN).alias("rus"), F.max(F.col("text").rlike(ESP_SIGN)).alias("esp"), (F.max(F.contains("text", F.lit("REPUBLIKA"))) & F.max(F.col("text").rlike(ALB_SIGN))).alias("alb")
    )
    turns = list(TEMPLATES)
    more = F.array_compact(F.array(*(F.when(F.col(t.lower()), F.struct(F.lit(turns.index(t)).alias("turn"), F.lit(t).alias("doc_type"), F.lit(2).cast("bigint").alias("hits"))) for t in ("RUS", "ALB", "ESP"))))
    extra = extra.select("scan_id", F.explode(more).alias("m")).select("scan_id", "m.*")
    total = hits.unionByName(extra).groupBy("scan_id", "turn", "doc_type").agg(F.sum("hits").alias("hits"))
    return total.groupBy("scan_id").agg(F.min_by(F.struct("doc_type", "hits"), F.struct(-F.col("hits"), F.col("turn"))).alias("b")).select("scan_id", "b.*")


assert set(KEYWORDS.values()) <= set(FIELDS)
