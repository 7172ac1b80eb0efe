"""Merging of field sources, consistency rules, and the long form of all checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ISO 3166 alpha-3 codes.
COUNTRIES = (
    "ABW AFG AGO AIA ALA ALB AND ARE ARG ARM ASM ATA ATF ATG AUS AUT AZE BDI BEL BEN BES BFA BGD BGR BHR BHS BIH BLM BLR BLZ "
    "BMU BOL BRA BRB BRN BTN BVT BWA CAF CAN CCK CHE CHL CHN CIV CMR COD COG COK COL COM CPV CRI CUB CUW CXR CYM CYP CZE DEU "
    "DJI DMA DNK DOM DZA ECU EGY ERI ESH ESP EST ETH FIN FJI FLK FRA FRO FSM GAB GBR GEO GGY GHA GIB GIN GLP GMB GNB GNQ GRC "
    "GRD GRL GTM GUF GUM GUY HKG HMD HND HRV HTI HUN IDN IMN IND IOT IRL IRN IRQ ISL ISR ITA JAM JEY JOR JPN KAZ KEN KGZ KHM "
    "KIR KNA KOR KWT LAO LBN LBR LBY LCA LIE LKA LSO LTU LUX LVA MAC MAF MAR MCO MDA MDG MDV MEX MHL MKD MLI MLT MMR MNE MNG "
    "MNP MOZ MRT MSR MTQ MUS MWI MYS MYT NAM NCL NER NFK NGA NIC NIU NLD NOR NPL NRU NZL OMN PAK PAN PCN PER PHL PLW PNG POL "
    "PRI PRK PRT PRY PSE PYF QAT REU ROU RUS RWA SAU SDN SEN SGP SGS SHN SJM SLB SLE SLV SMR SOM SPM SRB SSD STP SUR SVK SVN "
    "SWE SWZ SXM SYC SYR TCA TCD TGO THA TJK TKL TKM TLS TON TTO TUN TUR TUV TWN TZA UGA UKR UMI URY USA UZB VAT VCT VEN VGB "
    "VIR VNM VUT WLF WSM YEM ZAF ZMB ZWE"
).split()
FIELDS = ("surname", "names", "nationality", "sex", "date_of_birth", "expiration_date", "number")
#: Weights of the checks where there is no machine-readable zone.
VISUAL_WEIGHTS = {
    "name_and_prenom_present": 0.18, "name_different_from_prenom": 0.12, "realistic_age": 0.20, "dob_before_expiry": 0.15,
    "country_nationality_coherent": 0.15, "valid_dob": 0.08, "valid_expiry": 0.05, "doc_number_found": 0.04, "valid_sex": 0.03,
}
COHERENCE = ("surname_match", "names_match", "nationality_match", "country_match", "dob_match", "expiry_match", "sex_match")
LOGIC = ("realistic_age", "dob_before_expiry", "country_nationality_coherent", "name_and_prenom_present", "name_different_from_prenom")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def visual_date(raw: Column, as_of: Column) -> Column:
    """Five separated orders of day, month and year, then yyyymmdd, then yymmdd as in a machine-readable zone."""
    from .mrz import mrz_date

    t = F.trim(raw)
    orders = (("^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy"), (r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", "dd.MM.yyyy"), ("^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "dd-MM-yyyy"), ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"), ("^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"), ("^[0-9]{8}$", "yyyyMMdd"))
    return F.coalesce(*(F.when(t.rlike(p), F.try_to_date(t, form)) for p, form in orders), mrz_date(t, as_of))


def _is_visual_date(c: Column) -> Column:
    return F.trim(c).rlike(r"^([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2})$")


def _valid_name(c: Column) -> Column:
    kept = F.trim(F.regexp_replace(c, rf"[^{_LETTERS}\s'-]", ""))
    return (F.length(kept) >= 2) & kept.rlike(f"[{_LETTERS}]")


def merged(current: Column, incoming: Column, field: str) -> Column:
    """The incoming value where the current one is blank, or weak by the rule of the field."""
    a, b = text(current), text(incoming)
    compact = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    better = {
        "surname": ~_valid_name(a) & _valid_name(b),
        "date_of_birth": ~_is_visual_date(a) & _is_visual_date(b),
        "sex": ~F.upper(a).isin("M", "F") & F.upper(b).isin("M", "F"),
        "number": (compact(a) < 6) & (compact(b) >= 6),
        "nationality": (F.length(a) <= 2) & (F.length(b) > F.length(a)),
    }
    rule = better[{"names": "surname", "expiration_date": "date_of_birth"}.get(field, field)]
    new = F.upper(b) if field == "sex" else b
    return F.when(b == "", current).when(a == "", b).when(rule, new).otherwise(current)


def merge_field_sources(ocr: DataFrame, doc: DataFrame) -> DataFrame:
    """OCR fields improved by document fields where no machine-readable zone was found (mrz_found, null is true)."""
    d = ocr.alias("o").join(doc.alias("d"), "scan_id", "left")
    found = F.coalesce("o.mrz_found", F.lit(True))
    return d.select("scan_id", found.alias("mrz_found"), *(F.when(found, F.col(f"o.{f}")).otherwise(merged(F.col(f"o.{f}"), F.col(f"d.{f}"), f)).alias(f) for f in FIELDS))


def field_quality_score(get) -> Column:
    """Points for names (3 each), dates (2 each), number (2), sex and nationality (1 each); get(field) is its column."""
    v = lambda k: text(get(k))
    name = lambda c: (F.length(c) >= 2) & c.rlike(f"[{_LETTERS}]") & ~c.rlike("^[A-Z]{1,2}$")
    date = lambda c: c.rlike(r"^[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}$") | c.rlike("^[0-9]{6}$")
    rules = [(name(v("surname")), 3), (name(v("names")), 3), (date(v("date_of_birth")), 2), (date(v("expiration_date")), 2)]
    rules += [(v("number").rlike("[0-9]") & (F.length(F.regexp_replace(v("number"), r"\s+", "")) >= 6), 2), (F.upper(v("sex")).isin("M", "F"), 1), (F.length(v("nationality")) >= 3, 1)]
    return sum((F.when(c, n).otherwise(0) for c, n in rules), F.lit(0))


def choose_display_source(mrz_found: Column, ocr_score: Column, doc_score: Column, doc_has_fields: Column) -> Column:
    return F.when(mrz_found, "MRZ").when(doc_has_fields & (doc_score >= ocr_score), "document").otherwise("OCR")


def country_known(code: Column) -> Column:
    return code.isin(*COUNTRIES)


def mrz_coherence(visual: DataFrame, mrz: DataFrame, as_of: Column) -> DataFrame:
    """Seven comparisons of the visual fields with those of the zone, joined by scan_id."""
    from .mrz import mrz_date

    d = visual.alias("v").join(mrz.alias("m"), "scan_id")
    both = lambda k: (F.upper(text(F.col(f"v.{k}"))), F.upper(text(F.col(f"m.{k}"))))
    plain = lambda c: F.translate(c, "< ", "")
    out = []
    for k, name in (("surname", "surname_match"), ("names", "names_match")):
        a, b = map(plain, both(k))
        out.append(((a != "") & (a == b)).alias(name))
    for k, name in (("nationality", "nationality_match"), ("country", "country_match")):
        a, b = both(k)
        out.append(((a == b) & country_known(a)).alias(name))
    for k, name in (("date_of_birth", "dob_match"), ("expiration_date", "expiry_match")):
        out.append(F.coalesce(visual_date(F.col(f"v.{k}"), as_of) == mrz_date(F.col(f"m.{k}"), as_of), F.lit(False)).alias(name))
    a, b = both("sex")
    return d.select("scan_id", *out, ((a == b) & a.isin("M", "F")).alias("sex_match"))


def logical_consistency(fields: DataFrame, as_of: Column, mrz_mode: bool) -> DataFrame:
    """Age, order of dates, country and nationality, names present and different."""
    from .mrz import mrz_date

    parse = (lambda c: mrz_date(c, as_of)) if mrz_mode else (lambda c: visual_date(c, as_of))
    dob, exp = parse(F.col("date_of_birth")), parse(F.col("expiration_date"))
    age = F.datediff(as_of, dob) / 365.25
    false = lambda c: F.coalesce(c, F.lit(False))
    country, nationality = (F.upper(text(F.col(k))) for k in ("country", "nationality"))
    letters = lambda k: F.regexp_replace(F.upper(text(F.col(k))), "[^A-ZÀ-Ÿ]", "")
    a, b = letters("surname"), letters("names")
    present = (F.length(a) >= 2) & (F.length(b) >= 2)
    return fields.select(
        "scan_id", false((age > 0) & (age < 120)).alias("realistic_age"), false(dob < exp).alias("dob_before_expiry"),
        ((country == nationality) | nationality.isin("<<", "")).alias("country_nationality_coherent"),
        present.alias("name_and_prenom_present"), (present & (a != b)).alias("name_different_from_prenom"),
    )


def mrz_mode_score(coherence: DataFrame, logic: DataFrame) -> DataFrame:
    """Share of the 13 checks that hold (a zone was found is the first); 4 decimals; checks as a map."""
    d = coherence.join(logic, "scan_id")
    names = ("mrz_detected", *COHERENCE, *LOGIC)
    d = d.withColumn("mrz_detected", F.lit(True))
    passed = sum((F.col(n).cast("int") for n in names), F.lit(0))
    return d.select("scan_id", F.round(passed / len(names), 4).alias("score"), F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))).alias("checks"))


def visual_mode_score(fields: DataFrame, as_of: Column) -> DataFrame:
    """Nine weighted checks where no zone was found; at most 0.85; checks as a map."""
    d = fields.join(logical_consistency(fields, as_of, False), "scan_id")
    false = lambda c: F.coalesce(c, F.lit(False))
    dob, exp = (visual_date(F.col(k), as_of) for k in ("date_of_birth", "expiration_date"))
    age = F.datediff(as_of, dob) / 365.25
    sex = F.upper(text(F.col("sex")))
    d = d.select(
        "scan_id", *LOGIC, false((age > 0) & (age < 120)).alias("valid_dob"), false(F.datediff(exp, as_of) > -1825).alias("valid_expiry"),
        (F.length(text(F.col("number"))) >= 4).alias("doc_number_found"), ((sex == "") | sex.isin("M", "F")).alias("valid_sex"),
    )
    total = sum(VISUAL_WEIGHTS.values())
    points = sum((F.when(F.col(k), w).otherwise(0.0) for k, w in VISUAL_WEIGHTS.items()), F.lit(0.0))
    checks = F.create_map(F.lit("mrz_detected"), F.lit(False), *(x for k in VISUAL_WEIGHTS for x in (F.lit(k), F.col(k))))
    return d.select("scan_id", F.round(F.least(F.round(points / total, 4), F.lit(0.85)), 4).alias("score"), checks.alias("checks"))


def explode_checks(d: DataFrame, module: str) -> DataFrame:
    return d.select("scan_id", F.lit(module).alias("module"), F.explode("checks").alias("check", "passed"))


def check_pass_rates(long: DataFrame) -> DataFrame:
    """Rows and pass rate by module and check, with subtotals for modules and for all."""
    return long.rollup("module", "check").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))
