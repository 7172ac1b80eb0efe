import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docforensics.operators import mrz

TD1 = "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"
TD2 = "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6"
TD3 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
MRVA = "V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL8988901C4XXX4009078F96121096ZE184226B<<<<<<"
MRVB = "V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nL8988901C4XXX4009078F9612109<<<<<<<<"


@pytest.fixture(scope="module")
def read(spark):
    texts = {"TD1": TD1, "TD2": TD2, "TD3": TD3, "MRVA": MRVA, "MRVB": MRVB, "wrong": TD3.replace("7408122", "7408123"), "letters": TD3.replace("7408122F", "74O8I22F"), "short": TD3[:-3], "none": "no zone here", "null": None}
    d = spark.createDataFrame([(k, 0, 0, v) for k, v in texts.items()], "scan_id string, box_idx int, variant int, raw_text string")
    return {r["scan_id"]: r for r in mrz.read_zones(d).collect()}


@pytest.mark.parametrize("kind", ["TD1", "TD2", "TD3", "MRVA", "MRVB"])
def test_specimens_are_valid(read, kind):
    r = read[kind]
    assert r["mrz_type"] == kind and r["valid_score"] == 100 and r["mrz"]["valid"]
    assert (r["mrz"]["surname"], r["mrz"]["names"]) == ("ERIKSSON", "ANNA MARIA")


def test_damaged_zones(read):
    assert read["wrong"]["mrz"]["valid_date_of_birth"] is False and read["wrong"]["valid_score"] < 100
    assert read["letters"]["valid_score"] == 100  # letters where digits stand are repaired
    assert read["short"]["valid_score"] < 100
    assert read["none"]["mrz_type"] is None and read["none"]["valid_score"] == 0 and read["null"]["valid_score"] == 0


def test_check_digits(spark):
    def python(t):
        total = sum({**{c: i for i, c in enumerate(mrz.CODES)}, "<": 0}.get(c, -1000) * (7, 3, 1)[i % 3] for i, c in enumerate(t))
        return "" if not t or total < 0 else str(total % 10)

    texts = ["", "-", "520727", "AB2134<<<", "Z" * 60 + "-", "D23145890734", "é1"]
    mrz.register_sql_functions(spark)
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mrz.check_digit(F.col("t")).alias("a"), F.expr("mrz_check_digit(t)").alias("b"))
    for r in d.collect():
        assert r["a"] == r["b"] == python(r["t"])


@settings(max_examples=10, deadline=None)
@given(st.text("0123456789<ABCXYZ", min_size=1, max_size=14), st.integers(0, 13))
def test_a_changed_digit_changes_the_check(spark, text, at):
    at %= len(text)
    if not text[at].isdigit():
        return
    other = text[:at] + str((int(text[at]) + 1) % 10) + text[at + 1 :]
    r = spark.createDataFrame([(text, other)], "a string, b string").select(mrz.check_digit(F.col("a")), mrz.check_digit(F.col("b"))).first()
    assert r[0] != r[1]


def test_dates(spark):
    d = spark.createDataFrame([("000229",), ("990229",), ("740812",), ("340101",), ("350101",), ("7408",), (None,)], "s string")
    as_of = F.lit("2024-06-01").cast("date")
    out = [(r["s"], r["v"], str(r["d"]), r["x"]) for r in d.select("s", mrz.date_valid(F.col("s")).alias("v"), mrz.mrz_date(F.col("s"), as_of).alias("d"), mrz.display_date(F.col("s"), True, as_of).alias("x")).collect()]
    assert out == [("000229", True, "2000-02-29", "29 Feb 2000"), ("990229", False, "None", "29 Feb 1999"), ("740812", True, "1974-08-12", "12 Aug 1974"), ("340101", True, "2034-01-01", "1 Jan 1934"), ("350101", True, "1935-01-01", "1 Jan 1935"), ("7408", False, "None", "7408"), (None, False, "None", None)]


def test_best_of_boxes_and_variants(spark):
    rows = [(1, 0, 0, TD3[:-3]), (1, 0, 1, TD3), (1, 0, 2, TD3), (1, 1, 0, TD3), (2, 0, 0, TD3[:-3]), (2, 1, 0, TD3[:-3]), (3, 0, 0, "nothing")]
    d = mrz.read_zones(spark.createDataFrame(rows, "scan_id long, box_idx int, variant int, raw_text string"))
    best = {r["scan_id"]: (r["box_idx"], r["variant"]) for r in mrz.best_candidate(mrz.best_variant(d)).collect()}
    assert best == {1: (0, 1), 2: (1, 0)}
