import random
import re
from collections import Counter

from docforensics.llm import collocations as module
from docforensics.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string, words string, f long"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def loop(rows, least, top):
    counts, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            n[lang or "und"] += len(w)
            counts.update((lang or "und", *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    longer = Counter()
    candidates = [p for p in counts if len(p) > 2 and counts[p] >= least]
    for lang, *w in candidates:
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                p = (lang, *w[i : i + k])
                longer[p] = max(longer[p], counts[(lang, *w)])
    out = {}
    for p in candidates:
        lang, *w = p
        a = counts[p]
        if 100 * longer[p] >= 80 * a:
            continue
        cuts = [(2000000 * a // (counts[(lang, *w[:k])] + counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[(lang, *w[:k])], counts[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, x, y) in enumerate(sorted(ps)[:top]))


def made():
    """One very common word, phrases within phrases, separators next to each other, words of other scripts and control characters."""
    rng = random.Random(3)
    words = ["the"] * 40 + [*"abcdefgh"] + ["né", "日本", "x\x00y", "İ", "q\x85r", " s"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" "] * 12 + ["\t", "  ", ". ", "\n", ",;", "\x0b"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"]), "x", 1) for i in range(300)]
    rows += [(1000 + i, "New York City Hall, new york city hall. Of THE", "en", "x", 2) for i in range(40)]
    return [*rows, rows[0], (None, None, None, None, None), (1, "", "en", None, None), (2, " \t.\n", None, None, None), (None, "a " * 5000, "fr", None, None), (3, None, "fr", None, None)]


def test_against_a_loop(spark):
    rows = made()
    d = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for least, top in ((30, 2000), (5, 7), (1, 50)):
        out = collocations(d, least=least, top=top).collect()
        assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out) == loop(rows, least, top)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With a filter of 64 bits nearly every rare word passes."""
    monkeypatch.setattr(module, "FILTER", 6)
    rows = made()
    out = collocations(spark.createDataFrame(rows, SCHEMA), least=8).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out) == loop(rows, 8, 2000)


def test_small_cells_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 200)
    rows = made()
    out = collocations(spark.createDataFrame(rows, SCHEMA), least=2, top=1).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out) == loop(rows, 2, 1)


def test_none(spark, empty):
    assert collocations(empty).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).count() == 0
