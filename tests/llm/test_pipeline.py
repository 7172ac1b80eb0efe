from collections import Counter

import corpus_pipeline

from docforensics.llm import language

from .test_simhash import _brute, _fingerprint
from .test_text_operators import WHITE, _repeats

COLUMNS = corpus_pipeline.COLUMNS


def _rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def _is_kept(text):
    """The quality rules on one text, place by place."""
    words = WHITE.findall(text or "")
    n = len(words)
    grams = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {i + k for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if n < 50 or 100 * len(repeated) > 50 * n:
        return False
    longest = _repeats(words) if n < 1000 else [0]
    covered = {p for i, m in enumerate(longest) if m >= 8 for p in range(i, i + m)}
    return len(covered) <= 0.25 * n and max(longest) <= 60


def test_quality_against_a_loop(spark, docs, rows):
    d = docs.select(*COLUMNS)
    got = _rows(corpus_pipeline.quality(spark, d, ""))
    assert Counter(got) == Counter(tuple(r[: len(COLUMNS)]) for r in rows if _is_kept(r[1]))


def test_languages(spark):
    sounds = {"en": "the and ing tion", "de": "der die sch ung", "fr": "eau ment que oux"}
    text = lambda lang, k: " ".join(sounds[lang].split()[(k * i) % 4] + sounds[lang].split()[i % 3] for i in range(30))
    mixed = " ".join(text(lang, 1) for lang in ("en", "de"))
    rows = [(i, text(lang, i % 7 + 1), lang, "s", 1) for i in range(60) for lang in (sorted(sounds)[i % 3],)]
    rows += [(100, None, "en", None, None), (101, "12 34", "en", "s", 5), (None, text("fr", 2), None, None, None), (103, text("de", 3), None, "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(_rows(corpus_pipeline.known_language(spark, d, ""))) == Counter(r for r in rows if r[0] not in (100, 101))
    model = language.fit(d.where("doc_id < 60"))
    odds = language.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert odds["score"] < 0.9  # between two languages the score falls
    assert corpus_pipeline.known_language(spark, d.withColumn("lang", d.lang.substr(9, 1)).where("lang is null"), "").count() == 0


def test_one_of_each_group(spark, docs, rows):
    """Against all pairs of fingerprints: the smallest id of each component stays, once."""
    groups = _brute([_fingerprint(r[1]) for r in rows])
    least, without = {}, {}
    for r in rows:
        g = groups[_fingerprint(r[1])]
        without.setdefault(g, set()).add(r[0])
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    got = _rows(corpus_pipeline.one_of_each(spark, docs.select(*COLUMNS), ""))
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(least.values())
    assert sum(r[0] is None for r in got) == sum(ids == {None} for ids in without.values())
    assert set(got) <= {tuple(r[: len(COLUMNS)]) for r in rows}


def test_whole_run(spark, docs, tmp_path):
    """The stages one by one, each read from what the one before wrote, give the rows of run()."""
    docs.select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    d, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(d.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(d.columns) == COLUMNS
            ids = {r["doc_id"] for r in d.collect()}
    assert docs.count() > counts[0] >= counts[1] > counts[2]
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, (tuple(r[c] for c in order) for r in run))) == sorted(map(str, (tuple(r[c] for c in order) for r in d.collect())))
    assert {r["doc_id"] for r in run} == ids and all(r["offset"] + r["length"] <= 1024 for r in run)


def test_empty(spark, empty, tmp_path):
    empty.select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
