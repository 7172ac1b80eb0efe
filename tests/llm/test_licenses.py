import re

from docforensics.llm.licenses import BASE, TEMPLATES, license_scan


def test_base_against_a_loop_and_labels(spark, docs, rows):
    texts = [
        "Released under the MIT License.", "mit-license MIT  LICENSE", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3. General public license",
        "Licensed under CC BY-NC 4.0.", "emit license", "the license of MIT", "MİT Lıcense Kind mit license", None, "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ]
    mine = [(1000 + i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(mine, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    out = license_scan(d).collect()
    assert len(out) == len(mine) + len(rows)
    by_id = {r["doc_id"]: r for r in out}
    for doc, text in [*mine, *((r[0], r[1]) for r in rows if r[0] is not None)]:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(i, label) for p, label in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = by_id[doc]
        assert r["n_words"] == len(words) and r["n_base"] == len(at) and r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert by_id[1002]["labels"] == "apache,apache-2.0" and by_id[1003]["labels"] == "gpl,gpl-3.0"
    assert by_id[1004]["labels"] == "cc-by-nc" and by_id[1004]["base_labels"] == "" and by_id[1010]["labels"] == "mit"
    assert by_id[1005]["labels"] == by_id[1006]["labels"] == ""


def test_plan_has_no_python(docs):
    assert "Python" not in license_scan(docs)._jdf.queryExecution().toString()


def test_empty(empty):
    assert license_scan(empty).count() == 0


def test_many_licenses_and_long_texts(spark):
    """Each template is found as in a text of its own, whatever else a text holds."""
    every = [t for _, t, _ in TEMPLATES]
    filler = "word and this to the work software by under redistribution noninfringement " * 300
    rare = "Affero Lesser Mozilla unencumbered universal CC0 dedicated redistribution binary modify fee persons hereby granted dealing attribution creative commons international "
    cases = [" . ".join(every), *(filler + rare + t + " " + rare + filler for t in every), *every, "cc by 4 0 " + "license " * 20000]
    plain = [(1000 + i, "nothing here but plain words by the 4 of us under 0") for i in range(200)]
    d = spark.createDataFrame([*enumerate(cases), *plain], "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan(d).collect()}
    assert {m["label"] for m in out[0]["templates"]} == {x for x, _, _ in TEMPLATES} and len(out[0]["templates"]) == len(TEMPLATES)
    n = len(every)
    for i, (label, _, _) in enumerate(TEMPLATES):
        alone = {(m["label"], m["share"]) for m in out[1 + n + i]["templates"]}
        assert (label, 1.0) in alone
        assert alone <= {(m["label"], m["share"]) for m in out[1 + i]["templates"]}
    assert out[1 + 2 * n]["labels"] == "cc-by" and not any(out[i]["labels"] for i, _ in plain)
