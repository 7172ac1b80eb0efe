"""Machine-readable zones: cleaning, repair, parsing, validation, and the choice among readings."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What OCR confuses where letters, or digits, must stand.
TO_LETTER = ("0124568", "OIZASGB")
TO_DIGIT = ("BCDGIOQSZ", "800610052")
#: Kinds of the positions of each line (A letters, N digits, * any), as runs.
FORMATS = {
    "TD1": ("A1 *1 A3 *9 N1 *15", "N7 A1 N7 A3 *11 N1", "A30"),
    "TD2": ("A36", "*9 N1 A3 N7 A1 N7 *7 N1"),
    "TD3": ("A44", "*9 N1 A3 N7 A1 N7 *14 N2"),
    "MRVA": ("A44", "*9 N1 A3 N7 A1 N7 *16"),
    "MRVB": ("A44", "*9 N1 A3 N7 A1 N7 *16"),
}
CODES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHECKS = ("valid_number", "valid_date_of_birth", "valid_expiration_date", "valid_composite", "valid_personal_number")


def split_lines(raw: Column) -> Column:
    """Lines without spaces that have 20 characters or a double filler."""
    return F.filter(F.split(F.replace(raw, F.lit(" "), F.lit("")), "\n"), lambda x: (F.length(x) >= 20) | F.contains(x, F.lit("<<")))


def guess_type(lines: Column) -> Column:
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    visa, narrow = F.upper(F.substring(first, 1, 1)) == "V", (F.length(first) < 40) & (F.length(second) < 40)
    two = F.size(lines) == 2
    # An empty first line has no first character, which gives no type
    return (
        F.when(F.size(lines) == 3, "TD1")
        .when(two & (F.length(first) == 0), None)
        .when(two & narrow, F.when(visa, "MRVB").otherwise("TD2"))
        .when(two, F.when(visa, "MRVA").otherwise("TD3"))
    )


def bound(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repaired(line: Column, runs: str) -> Column:
    """A line repaired run by run of its format; what lies beyond the format stays."""
    parts, at = [], 1
    for run in runs.split():
        size = int(run[1:])
        part = F.upper(F.substring(line, at, size))
        parts.append(F.translate(part, *TO_LETTER) if run[0] == "A" else F.translate(part, *TO_DIGIT) if run[0] == "N" else part)
        at += size
    return F.concat(*parts, F.substr(line, F.lit(at)))


def fix_ocr(lines: Column, mrz_type: Column) -> Column:
    """Each position repaired by the kind that the format has there; what lies beyond the format stays."""

    def fixed(formats: tuple[str, ...]) -> Column:
        known = F.array(*(_repaired(F.get(lines, F.lit(i)), runs) for i, runs in enumerate(formats)))
        return F.slice(known, 1, F.size(lines))

    out = lines
    for formats in dict.fromkeys(FORMATS.values()):
        out = F.when(mrz_type.isin(*(t for t, f in FORMATS.items() if f == formats)), fixed(formats)).otherwise(out)
    return out


def check_digit(text: Column) -> Column:
    """Weights 7, 3, 1; a character without a code counts -1000; empty or negative gives an empty string."""

    def value(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        code = F.when(c == "<", 0).when(F.instr(F.lit(CODES), c) > 0, F.instr(F.lit(CODES), c) - 1).otherwise(-1000)
        return code * F.when(i % 3 == 1, 7).when(i % 3 == 2, 3).otherwise(1)

    total = F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), lambda a, i: a + value(i))
    return F.when(F.length(text) == 0, "").otherwise(F.when(total < 0, "").otherwise((total % 10).cast("string")))


def register_sql_functions(spark: SparkSession) -> None:
    """mrz_check_digit as a temporary SQL function."""
    spark.sql(
        f"""create or replace temporary function mrz_check_digit(t string) returns string return
        case when t = '' then '' else (select case when s < 0 then '' else cast(s % 10 as string) end from (select aggregate(sequence(1, length(t)), 0, (a, i) -> a +
        (case when substr(t, i, 1) = '<' then 0 when instr('{CODES}', substr(t, i, 1)) > 0 then instr('{CODES}', substr(t, i, 1)) - 1 else -1000 end)
        * (case i % 3 when 1 then 7 when 2 then 3 else 1 end)) as s)) end"""
    )


def date_valid(s: Column) -> Column:
    """yymmdd is a date of the calendar; the century doesn't matter, since 2000 is a leap year as 19yy and 20yy are by fours."""
    return F.coalesce(F.when(s.rlike("^[0-9]{6}$"), F.try_to_date(F.concat(F.lit("20"), s), "yyyyMMdd").isNotNull()), F.lit(False))


def _padded(line: Column, n: int, to: int) -> Column:
    return F.when(F.length(line) < n, F.rpad(line, to, "<")).otherwise(line)


def _names(zone: Column) -> tuple[Column, Column]:
    at = F.instr(zone, F.lit("<<"))
    clean = lambda c: F.trim(F.replace(c, F.lit("<"), F.lit(" ")))
    return clean(F.when(at > 0, F.substr(zone, F.lit(1), at - 1)).otherwise(zone)), clean(F.when(at > 0, F.substr(zone, at + 2)).otherwise(F.lit("")))


def _cut(c: Column, start: int, stop: int) -> Column:
    return F.substring(c, start + 1, stop - start)


def _record(kind: str, lines: Column) -> Column:
    """The fields and checks of one type of zone, as a struct with the same members for all types."""
    a, b, c = (F.get(lines, F.lit(i)) for i in range(3))
    width = {"TD1": 30, "TD2": 36, "TD3": 44, "MRVA": 44, "MRVB": 36}[kind]
    pad = 44 if kind == "MRVB" else width
    raw, (a, b, c) = (a, b, c), (_padded(x, width, pad) for x in (a, b, c))
    none = F.lit(None).cast("string")
    if kind == "TD1":
        f = dict(number=_cut(a, 5, 14), check_number=_cut(a, 14, 15), date_of_birth=_cut(b, 0, 6), check_date_of_birth=_cut(b, 6, 7), sex=_cut(b, 7, 8), expiration_date=_cut(b, 8, 14), check_expiration_date=_cut(b, 14, 15), nationality=_cut(b, 15, 18), optional1=_cut(a, 15, 30), optional2=_cut(b, 18, 29), personal_number=none, check_composite=_cut(b, 29, 30))
        whole, zone = F.concat(_cut(a, 5, 30), _cut(b, 0, 7), _cut(b, 8, 15), _cut(b, 18, 29)), c
    else:
        f = dict(number=_cut(b, 0, 9), check_number=_cut(b, 9, 10), date_of_birth=_cut(b, 13, 19), check_date_of_birth=_cut(b, 19, 20), sex=_cut(b, 20, 21), expiration_date=_cut(b, 21, 27), check_expiration_date=_cut(b, 27, 28), nationality=_cut(b, 10, 13), optional1=none, optional2=none, personal_number=none, check_composite=none)
        zone = _cut(a, 5, width)
        if kind == "TD2":
            f |= dict(optional1=_cut(b, 28, 35), check_composite=_cut(b, 35, 36))
            whole = F.concat(_cut(b, 0, 10), _cut(b, 13, 20), _cut(b, 21, 35))
        elif kind == "TD3":
            f |= dict(personal_number=_cut(b, 28, 42), check_composite=_cut(b, 43, 44))
            whole = F.concat(_cut(b, 0, 10), _cut(b, 13, 20), _cut(b, 21, 43))
        else:
            f |= dict(optional1=_cut(b, 28, width))
    visa = kind.startswith("MRV")
    dated = (lambda x: F.lit(True)) if visa else date_valid
    if kind == "TD3":
        f |= dict(check_personal_number=_cut(b, 42, 43))
    else:
        f |= dict(check_personal_number=none)
    texts = [f["number"], f["date_of_birth"], f["expiration_date"]] + ([] if visa else [whole]) + ([f["personal_number"]] if kind == "TD3" else [])
    lines_of = raw if kind == "TD1" else raw[:2]
    one = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    first = _cut(a, 0, 1)
    letter = first == "V" if visa else first.isin(*{"TD1": "IAC", "TD2": "ACI", "TD3": "P"}[kind])
    known = F.struct(*(x.alias(k) for k, x in f.items()), zone.alias("zone"), F.transform(F.array(*texts), check_digit).alias("digits"), (sum((one(F.length(x) == width) for x in lines_of), F.lit(0)) + one(letter) + 1).alias("points"), _cut(a, 0, 2).alias("type"), _cut(a, 2, 5).alias("country"))

    def record(v: Column) -> Column:
        digit = lambda i, k: v["digits"][i] == v[k]
        missing = F.lit(None).cast("boolean")
        checks = {
            "valid_number": digit(0, "check_number"),
            "valid_date_of_birth": digit(1, "check_date_of_birth") & dated(v["date_of_birth"]),
            "valid_expiration_date": digit(2, "check_expiration_date") & dated(v["expiration_date"]),
            "valid_composite": missing if visa else digit(3, "check_composite"),
            "valid_personal_number": missing,
        }
        if kind == "TD3":
            checks["valid_personal_number"] = (v["check_personal_number"].isin("<", "0") & (v["personal_number"] == "<" * 14)) | digit(4, "check_personal_number")
        n_checks = {"TD1": 4, "TD2": 4, "TD3": 5}.get(kind, 3)
        points = sum((10 * one(x) for x in checks.values()), v["points"])
        surname, names = _names(v["zone"])
        score = F.floor(100 * points / F.lit(10 * n_checks + len(lines_of) + 2)).cast("int")
        members = [F.lit(kind).alias("mrz_type"), v["type"].alias("type"), v["country"].alias("country"), surname.alias("surname"), names.alias("names")]
        members += [v[k].alias(k) for k in f] + [x.alias(k) for k, x in checks.items()] + [score.alias("valid_score"), (score == 100).alias("valid")]
        return F.struct(*members)

    return bound(known, record)


def parse(lines: Column, mrz_type: Column) -> Column:
    """The record of repaired lines; null without a type."""

    def by_type(v: Column) -> Column:
        out = F.when(v["t"] == "TD1", _record("TD1", v["lines"]))
        for kind in ("TD2", "TD3", "MRVA", "MRVB"):
            out = out.when(v["t"] == kind, _record(kind, v["lines"]))
        return out

    return bound(F.struct(lines.alias("lines"), mrz_type.alias("t")), by_type)


@lru_cache(maxsize=4)
def _parsed(application: str) -> Column:
    """The large expression is put together once for an application."""
    return parse(F.col("fixed"), F.col("mrz_type"))


def read_zones(candidates: DataFrame, raw_col: str = "raw_text") -> DataFrame:
    """Candidates with lines, mrz_type, fixed lines, record and valid_score (0 without a type).

    Null text has no lines and no type. To filter on mrz_type or the record, write the result first
    or filter after a shuffle: the filter would be pushed below these large expressions, and planning
    then takes very long.
    """
    d = candidates.withColumn("lines", split_lines(F.col(raw_col)))
    d = d.withColumn("mrz_type", guess_type(F.col("lines")))
    d = d.withColumn("fixed", fix_ocr(F.col("lines"), F.col("mrz_type")))
    d = d.withColumn("mrz", _parsed(d.sparkSession.sparkContext.applicationId))
    return d.withColumn("valid_score", F.coalesce("mrz.valid_score", F.lit(0)))


def best_variant(read: DataFrame) -> DataFrame:
    """In each box the first reading, replaced only by one of a strictly greater score."""
    order = Window.partitionBy("scan_id", "box_idx").orderBy(F.desc("valid_score"), "variant")
    return read.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_candidate(boxes: DataFrame) -> DataFrame:
    """In each scan the first fully valid box, else that of the highest score above 0, ties to the last box."""
    valid = F.coalesce(F.col("mrz.valid"), F.lit(False))
    order = Window.partitionBy("scan_id").orderBy(F.desc(valid), F.when(valid, F.col("box_idx")), F.desc("valid_score"), F.desc("box_idx"))
    return boxes.where("valid_score > 0").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def needs_rotation(text: Column) -> Column:
    return F.contains(text, F.lit(">>")) | (F.contains(text, F.lit(">")) & ~F.contains(text, F.lit("<")))


def ocr_score(mrz: Column) -> Column:
    """Share of the five checks that hold, a missing one not holding; 4 decimals."""
    return F.round(sum((F.coalesce(mrz[c], F.lit(False)).cast("int") for c in CHECKS), F.lit(0)) / 5.0, 4)


def mrz_date(s: Column, as_of: Column) -> Column:
    """yymmdd; years more than ten ahead of as_of are of the last century; null if it is no date."""
    t = F.trim(s)
    yy = F.substring(t, 1, 2).cast("int")
    century = F.when(yy > F.year(as_of) % 100 + 10, "19").otherwise("20")
    return F.when(t.rlike("^[0-9]{6}$"), F.try_to_date(F.concat(century, t), "yyyyMMdd"))


def display_date(s: Column, is_birth: bool, as_of: Column) -> Column:
    """A label such as 12 Mar 1995; a raw value that isn't a date in form stays as it is."""
    yy, mm, dd = (F.try_to_number(F.substring(s, i, 2), F.lit("99")).cast("int") for i in (1, 3, 5))
    year = F.when(yy > F.year(as_of) % 100, 1900 + yy).otherwise(2000 + yy) if is_birth else F.when(yy < 50, 2000 + yy).otherwise(1900 + yy)
    months = F.array(*map(F.lit, ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")))
    fine = s.rlike("^[0-9]{6}") & (mm >= 1) & (mm <= 12)
    return F.when(fine, F.concat_ws(" ", dd.cast("string"), F.try_element_at(months, F.when(fine, mm).otherwise(1)), year.cast("string"))).otherwise(s)
