"""License scans by a positional index of rare tokens, in DataFrame functions only."""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands in the notices and grants of well-known licenses, with the phrases that must be there.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("permission is hereby granted", "to deal in the software without restriction")),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation, version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0 universal",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
#: Phrases that are counted at every place, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: What lies between words: ASCII but for letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.lower()) if w]


def _lowered(text: Column) -> Column:
    """A-Z in lower case. Lower case of the Kelvin sign and of dotted I would be ASCII, so these go another way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"[\u0130\u212A]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def document_frequency(worded: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of rows, and of rows that hold each word of the templates; one aggregation over all rows."""
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in _words(text)})
    found = worded.select(F.explode(F.concat(F.array_intersect("words", _strings(vocabulary)), _strings([""]))).alias("w"))
    counts = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}
    return counts.pop("", 0), counts


def _starts(table: Column) -> Column:
    """Where a template would start, for each place in the text of each of its rare words."""

    def of(x: Column) -> Column:
        at = F.filter(table, lambda p: p["w"] == x["w"])
        return F.flatten(F.transform(at, lambda p: F.transform(p["at"], lambda a: x["i"] - a)))

    return F.flatten(F.transform("places", of))


def _best(starts: Column) -> Column:
    """(n, start) of the first of the starts with the most places; one walk over them in order."""
    none = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("start"))

    def step(a: Column, s: Column) -> Column:
        run = F.when(a["at"] == s, a["run"] + 1).otherwise(1)
        more = run > a["n"]
        return F.struct(s.alias("at"), run.alias("run"), F.when(more, run).otherwise(a["n"]).alias("n"), F.when(more, s).otherwise(a["start"]).alias("start"))

    return F.aggregate(F.sort_array(starts), none, step, lambda a: F.struct(a["n"], a["start"]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 6, aligned: float = 0.5) -> DataFrame:
    """Licenses named or granted in every whole text.

    The rarity of a template's words is counted over all documents. The index holds, for each
    template, the places of its `rare` rarest words. The rarest word of its key phrases nominates
    a template; a nominated template whose key phrases all stand in the text as whole words looks
    up all its indexed words. Every place of such a word, less the word's place in the template,
    is where the template would start. It is a match if at least the share `aligned` of its places
    agrees on one start. What else the text holds doesn't matter, nor how long it is.

    Output: id, n_words, n_base (places of the base phrases), first_word and last_word (their
    smallest and largest start, null without one), base_labels, labels (base labels and those of
    the matches; distinct, sorted, joined by commas, empty if none), score (1 with a base label,
    else the best share of places in line among the matches, else 0), templates (array of the
    matches: label, start, share). Words are runs without ASCII but letters and digits; A-Z in
    lower case. Null and empty texts have no words. Nothing is joined or shuffled but the few
    counts, so repeated rows, null ids and other columns don't matter.
    """
    split = F.filter(F.split(_lowered(F.coalesce(F.col(text_col), F.lit(""))), BETWEEN), lambda w: w != "")
    worded = docs.select(F.col(id_col), split.alias("words"))
    n, df = document_frequency(worded)
    idf = {w: log((n + 1) / (df.get(w, 0) + 1)) for _, text, _ in TEMPLATES for w in _words(text)}
    rarest = lambda words: sorted(set(words), key=lambda w: (-idf[w], w))
    index = []
    for label, text, phrases in TEMPLATES:
        words = _words(text)
        anchors = set(rarest(words)[:rare])
        index.append((label, phrases, [(w, i) for i, w in enumerate(words) if w in anchors]))
    nominators = sorted({rarest(w for p in phrases for w in p.split())[0] for _, phrases, _ in index})
    looked_up = sorted({w for _, _, places in index for w, _ in places})

    # A text without a nominator has no key phrase; most texts are such and go no further.
    d = worded.select("*", F.arrays_overlap("words", _strings(nominators)).alias("nominated"))
    numbered = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    d = d.select(
        "*",
        F.when(F.col("nominated"), F.filter(numbered, lambda x: x["w"].isin(looked_up))).alias("places"),
        F.when(F.col("nominated"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("joined"),
        F.when(F.array_contains("words", "license"), F.filter(numbered, lambda x: x["w"] == "license")).alias("ends"),
    )
    matches = []
    for label, phrases, places in index:
        by_word: dict[str, list[int]] = {}
        for w, i in places:
            by_word.setdefault(w, []).append(i)
        table = F.array(*(F.struct(F.lit(w).alias("w"), F.array(*map(F.lit, at)).alias("at")) for w, at in by_word.items()))
        best = _best(_starts(table))
        there = F.lit(True)
        for p in phrases:
            there = there & F.contains(F.col("joined"), F.lit(f" {p} "))
        share = F.least(best["n"] / len(places), F.lit(1.0))
        # Phrases first: they are cheap, and votes are counted in the few texts that have them
        matches.append(F.when(there, F.when(share >= aligned, F.struct(F.lit(label).alias("label"), best["start"].alias("start"), share.alias("share")))))
    kind = "array<struct<label:string,start:int,share:double>>"
    d = d.select("*", F.when(F.col("nominated"), F.array_compact(F.array(*matches))).otherwise(F.array().cast(kind)).alias("templates"))

    def standing(phrase: str, label: str) -> Column:
        """Starts of a phrase: its last word is `license` in every base phrase."""
        words = phrase.split()
        back = len(words) - 1
        at = lambda x, k: F.get("words", x["i"] - back + k) == words[k]
        same = lambda x: (x["i"] >= back) & (at(x, 0) if back == 1 else at(x, 0) & at(x, 1))
        return F.transform(F.filter("ends", same), lambda x: F.struct((x["i"] - back).cast("bigint").alias("at"), F.lit(label).alias("label")))

    base = F.concat(*(standing(p, label) for p, label in BASE))
    d = d.select("*", F.coalesce(base, F.array().cast("array<struct<at:bigint,label:string>>")).alias("base"))
    labels = lambda c: F.array_sort(F.array_distinct(c))
    return d.select(
        id_col,
        F.size("words").cast("bigint").alias("n_words"),
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.col("base.at")).alias("first_word"),
        F.array_max(F.col("base.at")).alias("last_word"),
        F.array_join(labels(F.col("base.label")), ",").alias("base_labels"),
        F.array_join(labels(F.concat(F.col("base.label"), F.col("templates.label"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("templates.share")), F.lit(0.0))).alias("score"),
        "templates",
    )
