import random
import re
import unicodedata
import zlib
from collections import OrderedDict
from difflib import SequenceMatcher
from struct import pack

import pytest
from pyspark.sql import functions as F

from docforensics import jobs
from docforensics.fixtures import fx
from docforensics.operators import checks, evaluation, fields, forensics, fusion, history, spatial, typography
from docforensics.operators.ranges import in_ranges, running
from docforensics.plans.registry import SQL, queries
from docforensics.sources import tables
from docforensics.streaming import intake

AS_OF = lambda: F.lit("2024-06-01").cast("date")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("score", "verdict"), [(0.7499, "Suspicious"), (0.75, "Authentic"), (0.4999, "Fake"), (0.5, "Suspicious")])
def test_verdict_bounds(spark, score, verdict):
    assert one(spark, fusion.verdict(F.lit(score))) == verdict


def test_report_with_missing_modules(spark):
    scans = spark.createDataFrame([(1,), (2,)], "scan_id long")
    ocr = spark.createDataFrame([(1, 1.0, True)], "scan_id long, score double, mrz_found boolean")
    rows = spark.createDataFrame([(1, 1.0, {"a": True})], "scan_id long, score double, checks map<string,boolean>")
    font = spark.createDataFrame([(1, 1.0)], "scan_id long, score double")
    model = spark.createDataFrame([(1, "Real", 0.9)], "scan_id long, label string, confidence double")
    out = {r["scan_id"]: r for r in fusion.assemble_report(scans, ocr, rows, font, model, font.withColumn("score", F.lit(0.1))).collect()}
    assert out[1]["global_score"] == pytest.approx(0.9 * 0.5 + 0.3 + 0.9 * 0.2) and out[1]["verdict"] == "Authentic"
    assert out[2]["mrz_found"] is False and out[2]["structural_score"] == pytest.approx(0.5 * 0.55 + 0.4 * 0.15)


def test_classification_report_of_the_published_counts(spark):
    counts = [("Real", "Real", 129), ("Real", "Fake", 21), ("Fake", "Fake", 170), ("Fake", "Real", 14)]
    d = spark.createDataFrame([(t, p) for t, p, n in counts for _ in range(n)], "t string, p string")
    out = {r["name"]: r for r in evaluation.classification_report(d, "t", "p").collect()}
    assert (out["Real"]["precision"], out["Real"]["recall"], out["Real"]["f1"], out["Real"]["support"]) == (0.9021, 0.86, 0.8805, 150)
    assert (out["Fake"]["precision"], out["Fake"]["recall"], out["Fake"]["f1"], out["Fake"]["support"]) == (0.8901, 0.9239, 0.9067, 184)
    assert out["accuracy"]["f1"] == 0.8952
    assert (out["macro avg"]["precision"], out["macro avg"]["recall"], out["macro avg"]["f1"]) == (0.8961, 0.892, 0.8936)
    assert (out["weighted avg"]["precision"], out["weighted avg"]["recall"], out["weighted avg"]["f1"]) == (0.8955, 0.8952, 0.8949)


def test_best_epoch(spark):
    log = spark.createDataFrame([(0, 0.5), (15, 0.9651), (16, 0.9462), (19, 0.9424)], "epoch int, val_auc double")
    r = evaluation.best_epoch(log).first()
    assert (r["best_epoch"], r["best"], r["last_epoch"], r["last"]) == (15, 0.9651, 19, 0.9424)


def test_split_shares(spark):
    d = spark.range(2222).select(F.col("id"), (F.col("id") < 1000).cast("int").alias("c"))
    got = {(r["c"], r["split"]): r["count"] for r in evaluation.stratified_split(d, "id", "c").groupBy("c", "split").count().collect()}
    assert got == {(1, "train"): 700, (1, "val"): 150, (1, "test"): 150, (0, "train"): 855, (0, "val"): 183, (0, "test"): 184}


def test_split_keeps_rows_without_class_or_id(spark):
    d = spark.createDataFrame([(i if i % 3 else None, None if i % 2 else "a") for i in range(200)], "id long, c string")
    got = {(r["c"], r["split"]): r["count"] for r in evaluation.stratified_split(d, "id", "c").groupBy("c", "split").count().collect()}
    assert got == {(c, s): n for c in ("a", None) for s, n in (("train", 70), ("val", 15), ("test", 15))}


def test_fit_and_score(spark):
    """A class that one component tells apart is told apart; rows without a label are scored, those without a vector aren't."""
    rows = [(i, [1.0 if i % 2 else -1.0, (i * 7 % 5) / 5], i % 2) for i in range(60)] + [(100, [1.0, 0.5], None), (101, [-1.0, 0.5], None), (102, None, 1)]
    out = {r["id"]: r["prob_fake"] for r in evaluation.fit_and_score(spark.createDataFrame(rows, "id long, v array<float>, y int"), "v", "y", "id").collect()}
    assert set(out) == {*range(60), 100, 101} and out[100] > 0.9 and out[101] < 0.1
    assert all((out[i] > 0.5) == (i % 2 == 1) for i in range(60))


@pytest.mark.parametrize(("t", "p", "want"), [(1.0, 0.3, 0.3), (2.0, 0.5, 0.5), (0.0, 0.7, 0.7)])
def test_temperature(spark, t, p, want):
    assert one(spark, evaluation.temperature_scale(F.lit(p), t)) == pytest.approx(want)


def test_exif_rules(spark):
    rows = [(1, None), (2, {}), (3, {"Software": ""}), (4, {"Software": "GIMP 2"}), (5, {"Software": "x"}), (6, {"Software": "Adobe Photoshop", "DateTimeOriginal": "a", "DateTime": "b", "DateTimeDigitized": "c", "Orientation": "6", "GPSInfo": "y"})]
    d = spark.createDataFrame(rows, "scan_id long, tags map<string,string>")
    assert {r["scan_id"]: r["score"] for r in forensics.exif_risk(d).collect()} == {1: 50, 2: 50, 3: 0, 4: 75, 5: 15, 6: 100}


def test_last_full_block_is_left_out(spark):
    d = spark.range(64).select(F.lit(1).alias("scan_id"), F.expr("int(id div 8)").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.col("id").cast("double").alias("lum"))
    assert forensics.block_stats(d, 2).count() == 9 and forensics.block_stats(d, 4).count() == 1
    assert forensics.noise_score(d, 4).first()["score"] == 0


def test_lru_against_a_replay(spark):
    rng = random.Random(1)
    keys = [rng.randrange(9) for _ in range(300)]
    for capacity in (1, 3, 5):
        cache, want = OrderedDict(), []
        for k in keys:
            want.append(k in cache)
            cache[k] = True
            cache.move_to_end(k)
            if len(cache) > capacity:
                cache.popitem(last=False)
        d = spark.createDataFrame([("s", i, k) for i, k in enumerate(keys)], "s string, i long, k long")
        got = history.lru_hit_audit(d, ["s"], "k", ["i"], capacity).orderBy("i").collect()
        assert [r["hit"] for r in got] == want


def test_rows_without_hash_or_time_stay(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "scan_id long, sha256 string")
    assert sorted(tuple(r) for r in history.dedup_scans(d).select("scan_id", "result_of", "analysed").collect()) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]
    d = spark.createDataFrame([(1, None), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 00:00:00"), (4, None), (5, "2020-05-05 01:00:00")], "id long, t string").select("id", F.col("t").cast("timestamp").alias("ts"))
    for out in (history.scan_history(d), history.scan_history(d, top=9)):
        assert [r["id"] for r in out.orderBy("number").collect()] == [3, 2, 5, 4, 1]
    assert history.scan_history(d.where("ts is null")).count() == 2 and history.scan_history(d.limit(0)).count() == 0


def test_zones_of_boxes_and_of_real_scans(spark):
    """A cell inside a component's box counts though it isn't flagged for it; Real scans have no zones."""
    cells = [(s, y, x, 0.9 if y == x else 0.1, 0.0, 1 if y == x else 2) for s in (1, 2) for y in range(4) for x in range(4)]
    cells = [(s, y, x, h, 0.95 if (y, x) == (0, 3) else c, comp) for s, y, x, h, c, comp in cells]
    d = spark.createDataFrame(cells, "scan_id long, y int, x int, heat double, coef double, comp_id int")
    out = evaluation.suspicious_zones(d, labels=spark.createDataFrame([(1, "Falsified"), (2, "Real")], "scan_id long, label string")).collect()
    assert {(r["scan_id"], r["comp_id"], r["severity"]) for r in out} == {(1, 1, 0.95), (1, 2, 0.95)}


def test_scores_in_many_cells(spark):
    """Running sums over cells are those over all scores; rows without a score come last."""
    rng = random.Random(3)
    rows = [(rng.random(), rng.randrange(2)) for _ in range(3000)] + [(0.5, 1)] * 400 + [(None, 1)]
    d = spark.createDataFrame(rows, "p double, t int")
    out = {r["score"]: (r["tp"], r["called"]) for r in evaluation.by_score(d, "p", "t").collect()}
    known = [r for r in rows if r[0] is not None]
    for score in [s for s, _ in known[::97]] + [0.5]:
        assert out[score] == (sum(t for p, t in known if p >= score), sum(p >= score for p, _ in known))
    assert out[None] == (sum(t for _, t in rows), len(rows)) and evaluation.by_score(d.limit(0), "p", "t").count() == 0


def test_history_is_numbered_without_gaps(spark):
    d = spark.range(100).select(F.col("id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7000).alias("ts"))
    assert [r["id"] for r in history.scan_history(d).orderBy("number").collect()] == [*range(99, -1, -1)]


def test_stability_trace(spark):
    good = [True] * 45 + [False] * 25
    d = spark.createDataFrame([(1, i, i, 1000.0 if g else 0.0, True) for i, g in enumerate(good)], "session long, seq long, ts long, variance double, corners_lit boolean")
    out = intake.stability(d).orderBy("seq").collect()
    assert [out[i]["stable"] for i in (28, 29, 44, 49, 50)] == [False, True, True, True, False]
    assert out[44]["counter"] == 40 and out[69]["counter"] == 0


def test_stability_over_hours(spark):
    """Hours composed apart give what a walk over all frames gives."""
    rng = random.Random(6)
    rows = [(s, i, 1_700_000_000 + i * 400, 1000.0 if rng.random() < p else None if rng.random() < 0.1 else 1.0, True) for s, p in ((1, 0.9), (2, 0.6), (3, 0.72)) for i in range(300)]
    d = spark.createDataFrame(rows, "session long, seq long, ts long, variance double, corners_lit boolean")
    want, c = {}, {}
    for s, i, _, v, _ in rows:
        c[s] = intake._step(c.get(s, 0), v == 1000.0)
        want[s, i] = c[s]
    assert {(r["session"], r["seq"]): r["counter"] for r in intake.stability(d).collect()} == want


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).alias("session"), F.col("id").alias("seq"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), F.when(F.col("id") % 11 < 8, 900.0).otherwise(1.0).alias("variance"), F.lit(True).alias("corners_lit"), F.sha2((F.col("id") % 40).cast("string"), 256).alias("sha256"), F.lit("Fake").alias("verdict"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(f, name, mode="append"):
        query = f(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(intake.stream_stability, "stable") == sorted(map(tuple, intake.stability(rows).select("session", "seq", "counter", "stable").collect()))
    assert len(run(lambda d: intake.intake_dedup(d, "ts"), "deduped")) == 40
    assert run(lambda d: intake.verdict_windows(d, "1 minute"), "windows", "update") == sorted(map(tuple, intake.verdict_windows(rows, "1 minute").collect()))


def _fed(spark, tmp_path, name, f, parts):
    """What a stream over these tables, a batch each, gives, and the rows that its state holds at the end."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/{name}-{i}")
    folder = tmp_path / name
    folder.mkdir()
    query = f(spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-at").start()
    try:
        for i in range(len(parts)):
            file = next((tmp_path / f"{name}-{i}").glob("part-*"))
            file.rename(folder / f"{i}.parquet")
            query.processAllAvailable()
        return spark.table(name).collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()


def test_copies_are_answered_with_the_first_result(spark, tmp_path):
    """Within the retention time a stream gives what the table gives; after it contents leave the state and are analysed anew."""
    start = 1_700_000_000
    kind = "scan_id long, sha256 string, t long"
    table = lambda rows: spark.createDataFrame(rows, kind).select("scan_id", "sha256", F.timestamp_seconds("t").alias("received_at"))
    soon = [(i, f"h{i % 7}" if i % 10 else None, start + i) for i in range(60)]
    again = [(100 + i, f"h{i % 9}", start + 600 + i) for i in range(20)]
    days = [(200, "h1", start + 90_000), (201, "x", start + 90_001)]
    last = [(300, "x", start + 180_000), (301, "y", start + 180_001)]
    out, left = _fed(spark, tmp_path, "answers", intake.intake_answers, [table(x) for x in (soon, again, days, last)])
    got = {r["scan_id"]: (r["result_of"], r["analysed"]) for r in out}
    want = {r["scan_id"]: (r["result_of"], r["analysed"]) for r in history.dedup_scans(table(soon + again)).collect()}
    assert {i: v for i, v in got.items() if i < 200} == want
    assert {i: v for i, v in got.items() if i >= 200} == {200: (200, True), 201: (201, True), 300: (300, True), 301: (301, True)}
    assert left <= 2  # x and y


def test_idle_sessions_leave_the_state(spark, tmp_path):
    start = 1_700_000_000
    table = lambda rows: spark.createDataFrame(rows, "session long, seq long, t long, variance double, corners_lit boolean").select("session", "seq", F.timestamp_seconds("t").alias("ts"), "variance", "corners_lit")
    good = lambda session, seq, t: (session, seq, t, 900.0, True)
    parts = [[good(s, i, start + i) for s in range(20) for i in range(4)], [good(3, 4, start + 5), (3, 5, start + 6, None, None)], [good(99, 0, start + 40_000)], [good(3, 6, start + 80_000), good(3, 7, start + 7)]]
    out, left = _fed(spark, tmp_path, "idle", intake.stream_stability, [table(x) for x in parts])
    counters = {(r["session"], r["seq"]): r["counter"] for r in out}
    assert counters[3, 4] == 5 and counters[3, 5] == 3 and counters[3, 6] == 1 and counters[99, 0] == 1
    assert (3, 7) not in counters and left <= 2  # a late frame; 3 and 99 at most


def test_batches_of_reports_stay(spark, tmp_path):
    """A second batch leaves the first; the same batch again changes nothing; a stream's batches do the same."""
    put = lambda rows: spark.createDataFrame(rows, "scan_id long, verdict string")
    read = lambda p: sorted(tuple(r) for r in spark.read.parquet(str(p)).select("scan_id", "verdict").collect())
    first, second = [(1, "Fake"), (2, "Authentic")], [(3, "Fake")]
    for batch, rows in ((1, first), (2, second), (1, first)):
        tables.write_reports(put(rows), str(tmp_path / "out"), batch=batch)
    assert read(tmp_path / "out") == sorted(first + second)
    for i, rows in enumerate((first, second)):
        put(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = tables.stream_reports(spark.readStream.schema("scan_id long, verdict string").parquet(str(tmp_path / "in")), str(tmp_path / "live"), str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert read(tmp_path / "live") == sorted(first + second * i)


def _png(path, width, height, pixels):
    chunk = lambda kind, data: pack(">I", len(data)) + kind + data + pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in pixels[y * width : (y + 1) * width] for v in p) for y in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_files_in_and_reports_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _png(tmp_path / "in/a.png", 2, 1, [(255, 0, 0), (0, 0, 255)])
    (tmp_path / "in/b").write_bytes(b"x")
    (tmp_path / "in/c.exe").write_bytes(b"x")
    (tmp_path / "in/d.JPG").write_bytes(b"y")
    scans = tables.intake_status(tables.read_scans(spark, str(tmp_path / "in")))
    assert {r["filename"]: (r["ext"], r["status"]) for r in scans.collect()} == {"a.png": (".png", 200), "b": (".jpg", 200), "c.exe": (".exe", 400), "d.JPG": (".jpg", 200)}
    odd = spark.createDataFrame([(".jpg", 0), (".exe", 0), (".png", 20 * 1024 * 1024), (".png", 20 * 1024 * 1024 + 1)], "ext string, length long")
    assert [r["status"] for r in tables.intake_status(odd).collect()] == [400, 400, 200, 413]
    pixels = {r["x"]: (r["r"], r["g"], r["b"]) for r in tables.read_image_pixels(spark, str(tmp_path / "in/a.png")).collect()}
    assert pixels == {0: (255, 0, 0), 1: (0, 0, 255)}
    reports = spark.createDataFrame([(1, "Fake"), (2, "Authentic")], "scan_id long, verdict string")
    tables.write_reports(reports, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("verdict = 'Fake'").select("scan_id").first()[0] == 1
    tables.write_reports(reports, str(tmp_path / "out"), "json")  # over what is there
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("scan_id", "verdict").collect()} == {(1, "Fake"), (2, "Authentic")}
    (tmp_path / "log.csv").write_text("epoch,accuracy,auc,loss,val_accuracy,val_auc,val_loss\n0,0.5,0.6,0.7,0.5,0.61,0.72\n1,0.6,0.7,0.5,0.6,0.73,\n")
    log = tables.read_training_log(spark, str(tmp_path / "log.csv"))
    assert [(r["epoch"], r["val_auc"], r["val_loss"]) for r in log.collect()] == [(0, 0.61, 0.72), (1, 0.73, None)]
    (tmp_path / "t.tsv").write_text("scan_id\tline_no\tword_no\ttext\tleft\ttop\twidth\theight\tconf\n1\t0\t0\tA\t0\t0\t8\t16\t95.5\n1\t0\t1\tB\t9\t0\t8\t16\tbad\n1\t0\t2\t \t9\t0\t8\t16\t90\n")
    assert [(r["text"], r["conf"]) for r in tables.read_ocr_tokens(spark, str(tmp_path / "t.tsv")).collect()] == [("A", 95)]
    assert tables.read_settings(None) == {"threshold": 0.54, "temperature": 1.0} and tables.read_settings("{oops")["threshold"] == 0.54


def test_tiles_give_the_same_blocks(spark, tmp_path):
    rng = random.Random(4)
    for name, width, height in (("a", 150, 97), ("b", 64, 64), ("c", 9, 200), ("d", 129, 65)):
        _png(tmp_path / f"{name}.png", width, height, [tuple(rng.randrange(256) for _ in range(3)) for _ in range(width * height)])
    for size in (8, 16):
        want = {(r["scan_id"], r["block_y"], r["block_x"]): (r["mean"], r["std"]) for r in forensics.block_stats(tables.read_image_pixels(spark, str(tmp_path)), size).collect()}
        got = {(r["scan_id"], r["block_y"], r["block_x"]): (r["mean"], r["std"]) for r in tables.tile_block_stats(tables.read_image_tiles(spark, str(tmp_path), 32), size).collect()}
        assert set(got) == set(want) and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k], strict=True))
    with pytest.raises(Exception, match="don't fit"):
        tables.tile_block_stats(tables.read_image_tiles(spark, str(tmp_path), 20), 16).count()


def test_marks_of_their_own(spark):
    for text, want in (("e\u0301", "e"), ("É", "e"), ("Ångström", "angstrom"), ("\ufb01n", "fin"), ("ｆｕｌｌ", "full"), ("o\u0308\u0323", "o"), ("ß", "ß"), ("ø", "ø"), (None, "")):
        assert one(spark, fields.normalize_text(F.lit(text))) == want


def test_bilingual_lines(spark):
    lines = [(1, 0, "Mbiemri/Surname", 0.0, 0.0, 0.9), (1, 1, "HOXHA", 0.0, 20.0, 0.9), (1, 2, "Emri/Given name", 0.0, 40.0, 0.9), (1, 3, "Arta", 0.0, 60.0, 0.8), (1, 4, "Shtetesia/Nationality: Shqiptare", 0.0, 80.0, 0.9), (1, 5, "12.04.1990", 0.0, 100.0, 0.9), (1, 6, "01.01.2030", 0.0, 120.0, 0.9), (1, 7, "Nr 123456789", 0.0, 140.0, 0.9)]
    d = spark.createDataFrame(lines, "scan_id long, line_no int, text string, x double, y double, conf double")
    out = {r["field"]: r["value"] for r in fields.rank_candidates(fields.all_candidates(d, AS_OF()), AS_OF()).collect()}
    assert out["surname"] == "HOXHA" and out["date_of_birth"] == "12.04.1990" and out["expiration_date"] == "01.01.2030" and out["number"] == "123456789"
    second = fields.extract_fields_regex(d, AS_OF()).first()
    assert second["surname"] == "HOXHA" and second["date_of_birth"] == "12.04.1990" and second["number"] == "123456789"


def test_second_extractor(spark):
    """Dates stand alone, labels are cut from names, a name may follow the surname."""
    texts = {1: ["surname / given Hoxha"], 2: ["112.04.19901 01.02.2030 12.04.1990"], 3: ["Mbiemri: Hoxha", "Arta"], 4: ["Surname: HOXHA 1", "Given name: de la Arta 1"], 7: ["Mbiemri: HOXHA 1", "Emri: Arta 1"], 5: ["Gjinia: FÉMININ", "Nr. personal: j12345678a"], 6: ["Nationalité: fra", "Albanian"]}
    d = spark.createDataFrame([(k, i, t, 0.9) for k, lines in texts.items() for i, t in enumerate(lines)], "scan_id long, line_no int, text string, conf double")
    out = {r["scan_id"]: r for r in fields.extract_fields_regex(d, AS_OF()).collect()}
    assert out[1]["surname"] == "Hoxha" and (out[2]["date_of_birth"], out[2]["expiration_date"]) == ("12.04.1990", "01.02.2030")
    assert (out[3]["surname"], out[3]["names"]) == ("Hoxha Arta", None) and (out[4]["surname"], out[4]["names"]) == ("HOXHA", "Arta")
    assert (out[7]["surname"], out[7]["names"]) == ("HOXHA", None)  # emri is found in mbiemri first, and a name like the surname goes
    assert out[5]["sex"] == "F" and out[5]["number"] == "J12345678A" and out[6]["nationality"] == "FRA"


@pytest.mark.parametrize(("name", "want"), [("name Given Arta", "Arta"), ("de la Arta", "Arta"), ("la", "la"), ("Arta de", "Arta de"), ("surname", "")])
def test_clean_names(spark, name, want):
    assert one(spark, fields.clean_name(F.lit(name))) == want


def test_nationality_below_its_label(spark):
    d = spark.createDataFrame([(1, 0, "Nationality"), (1, 1, "French"), (2, 0, "Nationality:"), (2, 1, ":"), (2, 2, "Spanish")], "scan_id long, line_no int, text string")
    assert {(r["scan_id"], r["value"]) for r in fields.nationality_candidates(d).collect()} == {(1, "French")}


@pytest.mark.parametrize(("field", "value", "want"), [("sex", "M 12", "M"), ("sex", "Gjinia: f", "F"), ("sex", "unknown", "unknown"), ("sex", "sex / féminin", "F"), ("number", "No 123456", "NO123456"), ("number", "x AB1234567", "XAB1234567"), ("number", "12345", "12345"), ("date_of_birth", "né 12.04.1990x", "12.04.1990"), ("date_of_birth", "112.04.1990", "112.04.1990"), ("surname", "surname / given Hoxha", "Hoxha"), ("surname", "gjinia", "")])
def test_clean_read(spark, field, value, want):
    assert one(spark, spatial.clean_read(F.lit(field), F.lit(value))) == want


@pytest.mark.parametrize(("field", "value", "want"), [("surname", "Surname: HOXHA ARTA", "HOXHA"), ("names", "[emri Arta B Maria Anna]", "Arta Maria"), ("nationality", "nationality Shqiptare/Albanian x", "Shqiptare/Albanian"), ("nationality", "republika ESP", "ESP"), ("sex", "gjinia M/F", "M"), ("sex", "x", ""), ("number", "12-34.56", "123456"), ("number", "ab", ""), ("date_of_birth", "date 12 04 90", "12 04 90"), ("date_of_birth", "1990", ""), ("surname", "", "")])
def test_clean_reading(spark, field, value, want):
    assert one(spark, spatial.clean_reading(F.lit(field), F.lit(value))) == want


@pytest.mark.parametrize(("kind", "field", "value", "want"), [("RUS", "nationality", "RESPUBLIKA", "RESPUBLIKA"), ("ESP", "nationality", "xESPx", "ESP"), ("FIN", "nationality", "Suomi 12", "Suomi"), ("ALB", "nationality", "albanian", "Shqiptare/Albanian"), ("ALB", "nationality", "x", ""), ("RUS", "number", "45 03 123456", ""), ("EST", "names", "fr eAhmetaj OJARI x", "Ahmetaj JARI"), ("SVK", "surname", "A" * 21, ""), ("RUS", "surname", "A" * 21, "A" * 21), ("ESP", "surname", "esp", ""), ("XXX", "number", "ab-1234", "AB1234")])
def test_normalize_by_template(spark, kind, field, value, want):
    assert one(spark, spatial.normalize_by_template(F.lit(kind), F.lit(field), F.lit(value))) == want


def test_best_reading_is_cleaned_first(spark):
    d = spark.createDataFrame([(1, "surname", 0, "Surname"), (1, "surname", 1, "Surname: Hoxha"), (1, "sex", 0, "?"), (1, "sex", 1, "sex f")], "scan_id long, field string, variant int, value string")
    assert {r["field"]: r["value"] for r in spatial.best_reading(d).collect()} == {"surname": "Hoxha", "sex": "F"}


def test_rows_are_opened_in_order(spark):
    words = [(1, 0, 0, "a", 0, 100, 8, 16, 90), (1, 0, 1, "b", 50, 112, 8, 16, 90), (1, 0, 2, "c", 90, 127, 8, 16, 90), (1, 0, 3, "d", 120, 116, 8, 16, 90)]
    d = spark.createDataFrame(words, "scan_id long, line_no int, word_no int, text string, left int, top int, width int, height int, conf int")
    assert {r["text"]: r["row_key"] for r in spatial.group_token_rows(d).collect()} == {"a": 100, "b": 100, "c": 127, "d": 127 if abs(100 - 116) > 15 else 100}


TOKEN = "scan_id long, line_no int, word_no int, text string, left int, top int, width int, height int, conf int"
PAGE = "scan_id long, w int, h int"


def at(scan, i, text, cx, cy):
    return (scan, i, 0, text, cx - 4 * len(text), cy - 8, 8 * len(text), 16, 90)


def test_document_types(spark):
    words = [(1, "REPUBLIKA"), (1, "ALBANIA"), (2, "SUOMI"), (2, "FINLANO"), (3, "nothing"), (4, "IDENTIDAD"), (5, "4503123456")]
    d = spark.createDataFrame(words, "scan_id long, text string")
    out = {r["scan_id"]: r["doc_type"] for r in spatial.detect_doc_type(d).collect()}
    assert out == {1: "ALB", 2: "FIN", 4: "ESP"}


def test_document_types_by_area(spark):
    """A number in the Russian form counts in the right tenth of a page alone, and keywords at the top, at the right or at the top left."""
    words = [
        *(at(1, i, x, 400, 40 + 30 * i) for i, x in enumerate(("SUOMI", "FINLAND", "123456789"))),  # nine digits at the top
        *(at(2, i, x, 500, y) for i, (x, y) in enumerate((("ALBANIA", 60), ("4503123456", 300)))),  # ten digits in the middle
        *(at(3, i, x, 940, 100 + 60 * i) for i, x in enumerate(("45", "03", "123456"))), at(3, 9, "SUOMI", 500, 60),
        at(4, 0, "SUOMI", 500, 139), at(5, 0, "SUOMI", 500, 140), at(6, 0, "SUOMI", 399, 243), at(7, 0, "SUOMI", 399, 244), at(8, 0, "SUOMI", 900, 600), at(9, 0, "SUOMI", 899, 600),
        at(10, 0, "45", 940, 100), at(10, 1, "X", 940, 140), at(10, 2, "03123456", 940, 180),  # a word between the digits
        at(11, 0, "45 03 123456", 940, 100), at(12, 0, "españa", 100, 20), at(13, 0, "SUOMI", 500, 60), (14, 0, 0, None, 5, 5, 5, 5, 90),
    ]
    d = spark.createDataFrame(words, TOKEN)
    pages = spark.createDataFrame([(i, 1000, 700) for i in range(1, 15) if i != 13], PAGE)
    out = {r["scan_id"]: (r["doc_type"], r["hits"]) for r in spatial.detect_doc_type(d, pages).collect()}
    assert out == {1: ("FIN", 2), 2: ("ALB", 1), 3: ("RUS", 2), 4: ("FIN", 1), 6: ("FIN", 1), 8: ("FIN", 1), 11: ("RUS", 2), 12: ("ESP", 3)}


def test_words_in_order_of_routes(spark):
    """A typed card whose template gives no name goes the generic way as a whole; readings fill in what a region's words don't give."""
    names = [at(1, 0, "SUOMI", 500, 40), at(1, 1, "VIRTANEN", 400, 140), at(1, 2, "xx", 380, 290), at(1, 3, "123456789", 560, 290)]
    bare = [at(2, 0, "SUOMI", 500, 40), at(2, 1, "Surname", 60, 400), at(2, 2, "VIRTANEN", 200, 400), at(2, 3, "123456789", 560, 290)]
    d = spark.createDataFrame([*names, *bare], TOKEN)
    pages = spark.createDataFrame([(1, 1000, 700), (2, 1000, 700)], PAGE)
    readings = spark.createDataFrame([(1, "names", 0, ":"), (1, "names", 1, "Given name Liisa"), (1, "sex", 0, "sex F"), (1, "expiration_date", 0, ""), (1, "expiration_date", 1, "01.02.2030"), (1, "surname", 0, "Other")], "scan_id long, field string, variant int, value string")
    out = {(r["scan_id"], r["field"]): (r["value"], r["method"], r["pass"]) for r in spatial.spatial_fields(d, F.to_date(F.lit("2024-06-01")), pages, readings).collect()}
    assert {k[1]: v for k, v in out.items() if k[0] == 1} == {"surname": ("VIRTANEN", "template", 0), "names": ("Liisa", "template", 0), "sex": ("F", "template", 0), "number": ("123456789", "template", 0)}
    assert out[2, "surname"] == ("VIRTANEN", "generic", 2) and {v[1] for k, v in out.items() if k[0] == 2} == {"generic"}


def test_choice_from_words_comes_first(spark):
    """The word nearest to seven letters, uncleaned, unless a reading scores more."""
    words = spark.createDataFrame([(1, "surname", 0, "Ab", 90), (1, "surname", 1, "Hoxhaj", 90), (1, "surname", 2, "Hoxhajxy", 90), (1, "surname", 3, "Perfect", 10), (2, "sex", 0, "m/m", 50), (3, "number", 0, "ab-12 34", 50), (3, "number", 1, "xy12345", 50)], "scan_id long, field string, n int, text string, conf int")
    assert {r["scan_id"]: r["value"] for r in spatial.pick_from_words(words).collect()} == {1: "Hoxhaj", 2: "M", 3: "XY12345"}
    readings = spark.createDataFrame([(1, "surname", 0, "Krasni"), (4, "surname", 0, "Alone")], "scan_id long, field string, variant int, value string")
    assert {r["scan_id"]: r["value"] for r in spatial.best_reading(readings, words).collect()} == {1: "Hoxhaj", 2: "M", 3: "XY12345", 4: "Alone"}


def test_components_of_cells(spark):
    cells = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 5, 5), (1, 5, 6), (2, 0, 0)]
    out = {(r["scan_id"], r["y"], r["x"]): tuple(r["comp_id"]) for r in evaluation.connected_cells(spark.createDataFrame(cells, "scan_id long, y int, x int")).collect()}
    assert out == {(1, 0, 0): (0, 0), (1, 1, 1): (0, 0), (1, 2, 2): (0, 0), (1, 5, 5): (5, 5), (1, 5, 6): (5, 5), (2, 0, 0): (0, 0)}


def test_few_glyphs(spark):
    d = spark.createDataFrame([(1, 0, 0, 10, 8, 50.0, 5.0, 4.0, 160)] * 4, "scan_id long, top int, left int, bottom int, right int, area double, cy double, cx double, strip_h int")
    r = typography.font_score(d).first()
    assert r["score"] == 0 and r["enough_components"] is False


def test_weak_fields_are_replaced(spark):
    cases = [("surname", "7", "Hoxha", "Hoxha"), ("sex", "x", "f", "F"), ("number", "12", "123456", "123456"), ("number", "123456", "999999", "123456"), ("nationality", "AL", "Albanian", "Albanian"), ("date_of_birth", "?", "01/02/1990", "01/02/1990"), ("names", "", "Arta", "Arta"), ("names", "Arta", "", "Arta")]
    for field, a, b, want in cases:
        assert one(spark, checks.merged(F.lit(a), F.lit(b), field)) == want


def test_word_fixtures_hold_all_documents(spark, tmp_path):
    """Long documents and those without n_chars have their words too."""
    long = "\n".join(" ".join(f"w{i}" for i in range(900)) for _ in range(2))
    docs = [(1, "ab  cd\nef", 9), (2, long, len(long)), (3, "gh i", None), (4, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((d, l, w, x) for d, t, _ in docs for l, line in enumerate((t or "").split("\n")) for w, x in enumerate(line.split(" ")) if x)
    for name in ("fx_words", "fx_tokens"):
        assert sorted(tuple(r) for r in fx(spark, str(tmp_path), name).select("scan_id", "line_no", "word_no", "text").collect()) == want
    assert queries()["rescale_boxes"](spark, str(tmp_path)).count() == len(want)


def test_connected_cells_follow_long_paths(spark):
    """A line of 384 cells is one component, along x and along y."""
    cells = [(1, 0, x) for x in range(384)] + [(2, y, 5) for y in range(384)] + [(2, 9, 9)]
    out = evaluation.connected_cells(spark.createDataFrame(cells, "scan_id long, y int, x int")).collect()
    assert len(out) == len(cells)
    assert {(r["scan_id"], *r["comp_id"]) for r in out} == {(1, 0, 0), (2, 0, 5), (2, 9, 9)}


def test_components_of_random_cells(spark):
    """Scans of random cells, one of them far to the right, against a flood fill; repeated cells count once."""
    rng = random.Random(8)
    cells = {(s, rng.randrange(30), rng.randrange(30) + (100_000 if s == 3 else 0)) for s, n in ((1, 250), (2, 420), (3, 330)) for _ in range(n)} | {(4, 0, 100_000), (4, 1, 0), (4, 0, 99_999)}
    want, seen = {}, set()
    for cell in sorted(cells):
        if cell not in seen:
            stack = [cell]
            seen.add(cell)
            while stack:
                s, y, x = stack.pop()
                want[s, y, x] = cell[1:]
                for c in ((s, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                    if c in cells and c not in seen:
                        seen.add(c)
                        stack.append(c)
    d = spark.createDataFrame([*cells, *list(cells)[:20]], "scan_id long, y int, x int")
    out = [((r["scan_id"], r["y"], r["x"]), tuple(r["comp_id"])) for r in evaluation.connected_cells(d).collect()]
    assert len(out) == len(cells) and dict(out) == want


@pytest.mark.parametrize("n", [1, 7])
def test_running_sums_over_ranges(spark, n):
    """Most rows in one group, small groups, null groups and equal keys, in one and in many ranges."""
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 8 + ["b", "c", None]), rng.randrange(40), rng.randrange(9), i) for i in range(600)]
    d = spark.createDataFrame(rows, "g string, t int, v long, i long")
    for inclusive in (True, False):
        want, total = {}, {}
        for g, t, v, i in sorted(rows, key=lambda r: (r[1], r[3])):
            before = total.get(g, (0, 0))
            total[g] = (before[0] + v, before[1] + 1)
            want[i] = total[g] if inclusive else before
        out = running(d, ["g"], [F.col("t"), F.col("i")], {"s": F.col("v"), "k": F.lit(1).cast("bigint")}, n, inclusive)
        assert {r["i"]: (r["s"], r["k"]) for r in out.collect()} == want
    assert [r["k"] for r in running(d, [], [F.col("i")], {"k": F.lit(1).cast("bigint")}, n).orderBy("i").collect()] == [*range(1, 601)]
    assert running(d.limit(0), ["g"], [F.col("i")], {"k": F.lit(1).cast("bigint")}, n).count() == 0


def test_history_with_an_outlier(spark):
    """One row of 1970 doesn't put all others into one range."""
    d = spark.range(4000).select("id", F.timestamp_seconds(F.when(F.col("id") == 7, 0).otherwise(1_700_000_000 + F.col("id"))).alias("ts"))
    sizes = [r["count"] for r in in_ranges(d, [F.desc_nulls_last("ts"), F.desc("id")], 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    assert [r["id"] for r in history.scan_history(d, ranges=8).orderBy("number").collect()] == [*(i for i in range(3999, -1, -1) if i != 7), 7]


def test_one_session_over_ranges(spark):
    rng = random.Random(1)
    keys = [rng.randrange(25) for _ in range(400)]
    cache, want = OrderedDict(), []
    for k in keys:
        want.append(k in cache)
        cache[k] = True
        cache.move_to_end(k)
        if len(cache) > 8:
            cache.popitem(last=False)
    d = spark.createDataFrame([(None, i, k) for i, k in enumerate(keys)] + [("t", 1000 + i, 1) for i in range(3)], "s string, i long, k long")
    got = history.lru_hit_audit(d, ["s"], "k", ["i"], 8, ranges=6).orderBy("i").collect()
    assert [r["hit"] for r in got] == [*want, False, True, True]


def test_jobs_over_small_tables(spark):
    """Jobs that give several tables, and zones of cells without components."""
    scored = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.6, 0), (0.2, 0)], "prob_fake double, is_fake int")
    out = jobs.model_evaluation(scored)
    assert out["auc"].first()[0] == 1.0 and tuple(out["threshold"].first()) == (0.8, 1.0) and {r["name"]: r["support"] for r in out["report"].collect()}["accuracy"] == 4
    log = spark.createDataFrame([(1, "a", "Fake", 1.0, "TD3", 5), (2, "a", "Fake", 3.0, "TD3", 6)], "id long, filename string, verdict string, score double, mrz_type string, t long").withColumn("ts", F.timestamp_seconds("t"))
    out = jobs.history_analytics(log)
    assert [r["id"] for r in out["history"].orderBy("number").collect()] == [2, 1] and {r["image_id"] for r in out["replay"].collect()} == {2}
    assert out["summary"].where("verdict = 'Fake' and mrz_type = 'TD3'").first()["mean_score"] == 2.0 and out["days"].where("day is null").first()["n"] == 2
    cells = [(1, y, x, 0.9 if (y < 2 and x < 2) or (y > 7 and x > 7) else 0.1, 0.0) for y in range(10) for x in range(10)]
    zones = jobs.suspicious_zone_ranking(spark.createDataFrame(cells, "scan_id long, y int, x int, heat double, coef double")).collect()
    assert [(r["number"], tuple(r["comp_id"]), r["width"]) for r in sorted(zones, key=lambda r: r["number"])] == [(1, (0, 0), 2), (2, (8, 8), 2)]
    uploads = spark.createDataFrame([(1, ".png", 5, "a"), (2, ".exe", 5, "a"), (3, ".jpg", 5, "a"), (4, ".jpg", 0, None)], "scan_id long, ext string, length long, sha256 string")
    accepted, rejected = jobs.intake(uploads)
    assert {(r["scan_id"], r["result_of"]) for r in accepted.collect()} == {(1, 1), (3, 1)} and {(r["scan_id"], r["status"]) for r in rejected.collect()} == {(2, 400), (4, 400)}


def test_threshold_without_scores(spark):
    d = spark.createDataFrame([(None, 1), (0.9, 1), (0.5, 0), (None, 1), (None, 1)], "p double, t int")
    assert tuple(evaluation.best_threshold(d, "p", "t").first()) == (0.9, 0.4)
    assert evaluation.best_threshold(d.where("p is null"), "p", "t").count() == 0


def test_candidates_of_all_lines(spark, tmp_path):
    """Lines with accents, and words for a sex, are mined too."""
    text = "Sexo: F señor\nMÜLLER\nsex male\nMARTIN"
    spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: queries()[name](spark, str(tmp_path)).collect()
    assert {r["line_no"] for r in run("sex_candidates")} == {0, 2}
    assert {(r["line_no"], r["field"]) for r in run("uppercase_name_candidates")} == {(i, f) for i in (1, 3) for f in ("surname", "names")}


def test_alike_words_against_all_pairs(spark):
    """Words that the bound on shared characters leaves out are never alike to 0.78."""
    rng = random.Random(3)
    keys = sorted({k for ks, _, _, _ in spatial.TEMPLATES.values() for k in ks})
    words = ["".join(rng.choice(k.upper() + "XO1") if rng.random() < 0.25 else c for c in k.upper()) for k in keys for _ in range(12)]
    d = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "scan_id long, text string")
    clean = {r["k"]: r["c"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", F.upper(fields.clean_token(F.col("k"))).alias("c")).collect()}
    found = {r["scan_id"]: r["word"] for r in d.select("scan_id", F.explode(F.regexp_extract_all(F.upper(fields.normalize_text(F.col("text"))), F.lit("([A-Z0-9]{3,})"), F.lit(1))).alias("word")).collect() if " " not in words[r["scan_id"]]}
    got = {r["scan_id"]: (r["doc_type"], r["hits"]) for r in spatial.detect_doc_type(d).collect()}
    alike = lambda k, w: k in w or w in k or (len(k) >= 5 and SequenceMatcher(a=k, b=w).ratio() >= 0.78)
    for i, w in found.items():
        hits = {t: sum(bool(clean[k]) and alike(clean[k], w) for k in ks) for t, (ks, _, _, _) in spatial.TEMPLATES.items()}
        if max(hits.values()) == 0:
            assert i not in got or got[i][1] == 2  # a sign of a country alone
        elif i in got:
            assert got[i][1] >= max(hits.values())
        else:
            raise AssertionError((w, hits))


@pytest.mark.parametrize(("table", "fixture", "key"), [("customer", "fx_mrz", "c_custkey"), ("documents", "fx_lines", "doc_id"), ("orders", "fx_dated_lines", "o_orderkey")])
def test_rows_of_one_file_are_dealt_by_scan(spark, tmp_path, table, fixture, key):
    """One exchange, by scan, also where the file is of one part."""
    columns = {"customer": "c_nationkey bigint, c_mktsegment string", "documents": "text string", "orders": "o_custkey bigint"}[table]
    row = {"customer": (1, "BUILDING"), "documents": ("one\ntwo",), "orders": (1,)}[table]
    spark.createDataFrame([(i, *row) for i in range(100)], f"{key} bigint, {columns}").coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    d = fx(spark, str(tmp_path), fixture)
    assert d.rdd.getNumPartitions() >= 4
    assert d.select("scan_id").distinct().count() == 100


def test_shares_of_halves_are_decimals(spark):
    """0.70 of 45 rows is 31.5, which rounds up; as a double it is a little less."""
    d = spark.range(45).select("id", F.lit(1).alias("c"))
    out = {r["split"]: r["count"] for r in evaluation.stratified_split(d, "id", "c").groupBy("split").count().collect()}
    assert out == {"train": 32, "val": 7, "test": 6}


def test_marks_go_fast_and_whole(spark):
    """The bounded class takes the same characters as all ranges of combining marks, and ligatures come apart."""
    marks = [chr(i) for i in range(0x300, 0x1F000) if unicodedata.combining(chr(i))]
    texts = ["plain", "ǄﬃĲ", "été", *("a" + m for m in marks)]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fields.without_marks(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in out] == ["plain", "DZffiIJ", "ete", *("a" for _ in marks)]
    assert fields.MARKS.startswith("[\\x{300}-\\x{1F000}&&")


def test_glyphs_of_one_height_are_of_one_line(spark):
    """The gap is counted at one of the two glyphs at 100; both lie below it, in whatever order they come."""
    tops = [0] * 7 + [1, 2, 3, 4] + [100, 100]
    d = spark.createDataFrame([(1, t - 5, 10 * i, t + 5, 10 * i + 6, 40.0, float(t), 10.0 * i + 3, 160) for i, t in enumerate(tops)], "scan_id int, top int, left int, bottom int, right int, area double, cy double, cx double, strip_h int")
    order = "order by cy range unbounded preceding"
    queries()
    assert order in SQL["font_score"] and "order by cy rows" not in SQL["font_score"]
    assert "RangeFrame, unboundedpreceding" in typography.glyph_line_alignment(d)._jdf.queryExecution().analyzed().toString()
    assert typography.glyph_line_alignment(d).first()["horizontal_alignment"]


def test_boxes_against_their_sql(spark, tmp_path):
    """Letters whose upper case is several letters: both engines find a value in the same row; the job holds ß and SS to be the same."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["gro mut xyz\nGroßmutxyz", "gross mut xyz\nGroßmutxyz", "of ice ab\nofﬁceab", "office ab\nofﬁceab\nofﬃceab", "#######ß", "Straßenbahn", "a\nÉCOLEabcd", "jǰǰǰǰǰǰǰ\nJ J J"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries()["field_bbox"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert set(con.execute(SQL["field_bbox"]).fetchall()) == got
    assert {(r[0], r[2]) for r in got if r[0] < 2} == {(0, 0), (1, 20)} and 4 not in {r[0] for r in got}
    latin = re.compile("[A-Z0-9À-ÖØ-öø-ÿ]")
    assert set(spatial.SEVERAL) == {c for c in map(chr, range(0x110000)) if len(c.upper()) > 1 and latin.search(c.upper())}
    words = spark.createDataFrame([(1, 0, 0, "AB12ß456", 0, 0, 64, 0)], "scan_id int, line_no int, word_no int, text string, left int, top int, width int, row_key int")
    assert spatial.field_bbox(words, spark.createDataFrame([(1, "number", "AB12SS456")], "scan_id int, field string, value string")).count() == 1


def test_upper_case_lines_against_their_sql(spark, tmp_path):
    """Lines beyond ASCII, labels alone, and other white space, in both engines."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["ÜBER ÅSE", "NOM", "NAME PETER", "ABC\tDEF", "STRASSE", "STRAßE", "FAMILYSURNAME", "ИВАН", "A-B C", "A B C D E", "PRÉNOM ANNA", "Anna", "X1", "漢字", "GIVEN NAME", "ﬁ"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r[0], r[2]) for r in queries()["uppercase_name_candidates"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {(r[0], r[2]) for r in con.execute(SQL["uppercase_name_candidates"]).fetchall()} == got
    assert {i for i, _ in got} == {0, 2, 3, 4, 7, 8, 10, 13}


def test_given_rows_leave_no_copy_of_all_words(spark, monkeypatch):
    """Where rows are given only the chosen values are kept on disk, not the words."""
    kept = []
    monkeypatch.setattr(spatial, "cut", lambda d: kept.append(d.columns) or d)
    d = spark.createDataFrame([(1, 0, i, t, 100 * i, 0, 80, 16, 90, 0) for i, t in enumerate(("Surname", "MARTIN"))], "scan_id int, line_no int, word_no int, text string, left int, top int, width int, height int, conf int, row_key int")
    out = spatial.spatial_fields(d, AS_OF()).collect()
    assert [(r["field"], r["value"], r["pass"]) for r in out] == [("surname", "MARTIN", 2)] and kept == [["scan_id", "field", "value", "pass"]]


@pytest.mark.parametrize("find", [spatial.value_after_label, spatial.value_after_phrase])
def test_words_are_exchanged_once(spark, find):
    """Labels find their row's words without a join of all rows."""
    d = spark.createDataFrame([(1, 0, 0, "Nom", 0, 0, 80, 0)], "scan_id int, line_no int, word_no int, text string, left int, top int, width int, row_key int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = find(d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(scan_id") <= 2  # words, and the values found


def _odd_lines(spark):
    texts = [
        ["Mbiemri/Surname", "HOXHA", "Emri/Given name: Arta", "Nationality", "shqiptare", "12.04.1990 01/01/2030 1999-99-99", "Nr 123456789 AB1234567"],
        [None, "Sex: F / M", "nationalité: FRANÇAISE", "Albanian", "ÉLODIE-ANNE", "Date of birth 12.04.1990", ""],
        ["surname name given", "name", "surname", "12.04.1890", "sexe\rféminin"], ["plain words of a page"], [None],
    ]
    rows = [(k, 2 * i, t, 0.0, 20.0 * i * (1 + k), 0.5 + i / 100) for k, lines in enumerate(texts) for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "scan_id long, line_no int, text string, x double, y double, conf double")


def test_all_candidates_are_those_of_each_kind(spark):
    d = _odd_lines(spark)
    each = (fields.label_candidates(d), fields.anchor_candidates(d), fields.date_candidates(d, AS_OF()), fields.docnum_candidates(d), fields.sex_candidates(d), fields.nationality_candidates(d), fields.uppercase_name_candidates(d))
    want = [tuple(r) for found in each for r in found.select("scan_id", "field", "value", "score", "step", "seq").collect()]
    got = [tuple(r) for r in fields.all_candidates(d, AS_OF()).select("scan_id", "field", "value", "score", "step", "seq").collect()]
    assert {r[4] for r in want} == set(range(1, 9)) and sorted(got) == sorted(want)


@pytest.mark.parametrize(("name", "most"), [("rank_candidates", 1), ("first_name_fallback", 2), ("field_mining", 3)])
def test_lines_are_read_once_for_all_candidates(spark, name, most):
    """Once for the candidates, once for missing names and once for the second extractor."""
    d = _odd_lines(spark)
    ranked = lambda: fields.rank_candidates(fields.all_candidates(d, AS_OF()), AS_OF())
    out = {"rank_candidates": ranked, "first_name_fallback": lambda: fields.first_name_fallback(fields.wide(ranked()), d), "field_mining": lambda: fields.field_mining(d, AS_OF())}[name]()
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().length() == most


def test_missing_names(spark):
    """A line of title case after the surname's, else the surest; a scan without lines keeps its row."""
    d = spark.createDataFrame([(1, 0, "HOXHA", 0.9), (1, 1, "Arta", 0.1), (1, 2, "Zana", 0.9), (2, 0, "Hoxha", 0.9), (2, 1, "Arta", 0.5), (3, 0, "HOXHA", 0.9), (3, 1, "Arta", 0.9)], "scan_id long, line_no int, text string, conf double")
    f = spark.createDataFrame([(1, "Hoxha", None), (2, "Kola", None), (3, "Hoxha", "Hoxha"), (4, "Kola", None), (5, None, None)], "scan_id long, surname string, names string")
    assert {r["scan_id"]: r["names"] for r in fields.first_name_fallback(f, d).collect()} == {1: "Arta", 2: "Hoxha", 3: None, 4: None, 5: None}


def _odd_words(spark):
    """Pages of labels, values and odd words: parts of words, marks, nulls, line ends within words, null and negative places."""
    rng = random.Random(11)
    words = ["Surname", "Mbiemri/Surname", "Name:", "prénoms", "Né", "n°", "date", "of", "birth", "Date", "de", "naissance", "given", "name", "first\nname", "Sex", "genre", "M", "f", "male", "Féminin", "ﬁrst", "12/04/1990", "01.01.2031", "1999-99-99", "2030-05-06",
             "AB1234567", "123456", "ANNA", "MARIE-ÈVE", "DE", "Île", "", None, "-", "a b", "Nationality", "FRA", "Nr", "personal", "no", "document", "X\ty", "ſex", "İ"]
    rows = []
    for scan in range(120):
        for line in range(rng.randint(1, 7)):
            key = None if rng.random() < 0.03 else 30 * line * rng.choice((1, 1, 1, 3))
            rows += [(scan, line, i, rng.choice(words), None if rng.random() < 0.02 else 60 * i + rng.randint(-70, 70), 40 * line, 50, 16, 90, key) for i in range(rng.randint(1, 9))]
    return spark.createDataFrame(rows, "scan_id int, line_no int, word_no int, text string, left int, top int, width int, height int, conf int, row_key int")


def test_passes_in_one_look_are_those_of_each(spark):
    """Rows are gathered once for all passes, which find what each of them finds alone."""
    d = _odd_words(spark)
    each = spatial.resolve_passes(spatial.value_after_phrase(d), spatial.value_after_label(d), spatial.regex_values(d, AS_OF()), spatial.upper_values(d))
    once = spatial.resolved(spatial.all_passes(d, AS_OF()))
    got = sorted(tuple(r) for r in once.select("scan_id", "field", "value", "pass").collect())
    assert got == sorted(tuple(r) for r in each.select("scan_id", "field", "value", "pass").collect())
    assert {r[3] for r in got} == {1, 2, 3, 4} and once._jdf.queryExecution().optimizedPlan().collectLeaves().length() == 1


def test_labels_by_a_walk_over_words(spark):
    """Values beside labels of one and of several words, found word by word in Python."""
    d = _odd_words(spark)
    clean = lambda t: re.sub("[^a-z0-9]", "", fields._without_marks(t or "").lower())
    parts = lambda t: re.split("[^a-z0-9]+", fields._without_marks(t or "").lower())
    low = lambda x: (x is not None, x)
    scans = {}
    for r in d.collect():
        scans.setdefault(r["scan_id"], {}).setdefault(r["row_key"], []).append(r)
    want = {"label": {}, "phrase": {}}
    for scan, rows in scans.items():
        rows = [(y, sorted(rows[y], key=lambda r: (low(r["left"]), r["line_no"], r["word_no"]))) for y in sorted(rows, key=low)]
        for n, (y, row) in enumerate(rows):
            below = rows[n + 1] if n + 1 < len(rows) else (None, [])
            for i in range(len(row)):
                found = [("label", k, f, i) for k, (w, f) in enumerate(spatial.KEYWORDS.items()) if spatial._plain(w) and spatial._plain(w) in (clean(row[i]["text"]), *parts(row[i]["text"]))]
                found += [("phrase", k, f, i + p.count(" ")) for k, (p, f) in enumerate(spatial.PHRASES) if " ".join(clean(r["text"]) for r in row[i : i + 1 + p.count(" ")]) == p]
                for kind, k, f, last in found:
                    begin, end = row[i]["left"], None if row[last]["left"] is None else row[last]["left"] + 50
                    right = [r for r in row[last + 1 :] if r["left"] is not None and end is not None and r["left"] >= end - 5]
                    near = y is not None and below[0] is not None and below[0] - y <= 60
                    chosen = right or [r for r in below[1] if near and r["left"] is not None and begin is not None and r["left"] >= begin - 20]
                    if value := " ".join(r["text"] for r in chosen if r["text"] is not None):
                        want[kind].setdefault((scan, k), (f, value))
    for kind, find in (("label", spatial.value_after_label), ("phrase", spatial.value_after_phrase)):
        assert {(r["scan_id"], r["k"]): (r["field"], r["value"]) for r in find(d).collect()} == want[kind] and len(want[kind]) > 5
