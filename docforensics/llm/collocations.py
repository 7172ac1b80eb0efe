"""Phrase collocations: counts of the longest windows of words, of which a rollup makes those of all shorter ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, hot_join, removed, written

#: Bits of the filter that leaves out runs of words that are too rare for a phrase.
FILTER = 27
#: Bits of a hash by which runs are counted for the filter.
KEPT = 40
#: Bytes of text at a time: a word takes some 200 bytes of arrays.
CHUNK = 1 << 20
#: Bytes as they part the text: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(batch: pa.RecordBatch) -> tuple[list, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(languages, distinct words, and for each word its number, its language, whether the next one follows in the piece)."""
    langs = pc.dictionary_encode(pc.fill_null(batch.column(0), "und"))
    texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, np.uint8)
    ends = offsets[1:] - offsets[0]
    kind = KIND[raw]
    inside = kind == 0
    # A word begins at a byte of a word after another kind of byte, or at a text's start
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at_text = ends[:-1][(ends[:-1] < len(raw))]
    start[at_text] |= inside[at_text]
    begins = np.flatnonzero(start)
    if not len(begins):
        none = np.empty(0, np.int64)
        return [], pa.array([], pa.string()), none, none, np.empty(0, bool)
    place = np.cumsum(inside)  # bytes of words up to here
    cuts = np.append(place[begins] - 1, place[-1])
    words = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    doc = np.searchsorted(ends, begins, "right")
    piece = np.cumsum(kind == 2)[begins]
    follows = np.zeros(len(begins), dtype=bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    return langs.dictionary.to_pylist(), coded.dictionary, coded.indices.to_numpy().astype(np.int64), langs.indices.to_numpy()[doc].astype(np.int64), follows


def _runs(words: tuple, table: np.ndarray | None, order: int):
    """For k = 1 up to order: (hashes of the runs of k words that begin at each word, whether there is such a run and all runs in it are common).

    A run of k words is looked at where the two runs of k - 1 words in it are common by the table;
    without a table all of one and two words are.
    """
    langs, distinct, word, lang, follows = words
    salt = np.array([xxhash.xxh64_intdigest(x) for x in langs], dtype=np.uint64)
    of = np.array([xxhash.xxh64_intdigest(x) for x in distinct.to_pylist()], dtype=np.uint64)
    single = (of[word] ^ salt[lang]) * MIX
    h, there = single, np.ones(len(word), dtype=bool)
    yield h, there
    for k in range(2, order + 1):
        if table is not None:
            there = there.copy()
            at = np.flatnonzero(there)
            there[at] = _is_common(h[at], table)
        longer = np.zeros(len(word), dtype=bool)
        longer[:-1] = there[:-1] & there[1:] & follows[:-1]  # the run at the next word is within its piece
        last = np.zeros(len(word), dtype=np.uint64)
        last[: len(word) - k + 1] = single[k - 1 :]
        h, there = ((h ^ (h >> np.uint64(29))) * MIX + last) * MIX, longer
        yield h, there


def _is_common(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(65 - (64 * len(table)).bit_length())
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def _common(texts: DataFrame, least: int, order: int):
    """Bits (a broadcast of one size) of the hashes of runs of up to `order` words that occur `least` times or more.

    Other hashes may share a bit, which costs work later on but changes no count. A pass for each
    length but the first: only runs whose own runs are common are counted, so ever fewer.
    """
    context = texts.sparkSession.sparkContext
    table = np.zeros(1 << (FILTER - 6), dtype=np.int64)
    bits = None
    for k in range(2, order + 1):

        def count(batches, bits=bits, k=k):
            have = None if bits is None else bits.value
            for b in chunks(batches, most=CHUNK):
                words = _words(b)
                for i, (h, there) in enumerate(_runs(words, have, k) if len(words[2]) else (), 1):
                    if i == k or k == 2:
                        key, n = np.unique(h[there] >> np.uint64(64 - KEPT), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

        counted = texts.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        # One row for each 64 bits of the filter: 16 MB at most, whatever the number of words
        place = F.shiftrightunsigned("h", KEPT - FILTER)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {KEPT - FILTER}) & 63 as int))")
        found = counted.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
        table[found.column("at").to_numpy()] |= found.column("bits").to_numpy()
        if bits is not None:
            bits.destroy()  # its job is done
        bits = context.broadcast(table.copy().view(np.uint64))
    return bits


def _windows(texts: DataFrame, bits, order: int) -> DataFrame:
    """lang, w1 to w<order>, n: counts of the longest window at each word, padded with '' beyond the piece and where a rare run would follow.

    A rare word is '' as well: it counts as a word and nothing else.
    """
    names = [f"w{i + 1}" for i in range(order)]

    def count(batches):
        table = bits.value
        for b in chunks(batches, most=CHUNK):
            langs, distinct, word, lang, follows = words = _words(b)
            if not len(word):
                continue
            pad = len(distinct)
            window = np.full((len(word), order), pad)
            for i, (h, there) in enumerate(_runs(words, table, order)):
                at = np.flatnonzero(there)
                at = at[_is_common(h[at], table)]
                window[at, i] = word[at + i]
            rows = np.column_stack([lang, window])
            single = rows[:, 2] == pad  # most windows: one word at most
            for some in (rows[single][:, :2], rows[~single]):
                by = np.lexsort(some.T[::-1])
                some = some[by]
                first = np.flatnonzero(np.append(np.ones(min(1, len(some)), bool), (some[1:] != some[:-1]).any(axis=1)))
                n = np.diff(np.append(first, len(some)))
                lookup = pa.concat_arrays([distinct.cast(pa.string()), pa.array([""])])
                columns = [pa.array(langs, pa.string()).take(pa.array(some[first, 0]))]
                columns += [lookup.take(pa.array(some[first, i + 1] if i + 1 < some.shape[1] else np.full(len(first), pad))) for i in range(order)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], ["lang", *names, "n"])

    counted = texts.mapInArrow(count, "lang string, " + ", ".join(f"{w} string" for w in names) + ", n bigint")
    return counted.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = 30, order: int = 4, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, words (array), f: how often each run of up to `order` words occurs, if it is `least` or more; words is empty for all words of a language.

    Only windows of `order` words are counted, padded where a piece ends; a rollup sums them by ever
    shorter prefixes, which are the shorter phrases. A phrase is no more common than the runs of words
    in it, so windows are cut at rare ones, which a filter of fixed size tells.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    names = [f"w{i + 1}" for i in range(order)]
    tops = _windows(texts, _common(texts, least, order), order)
    summed = tops.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid")).where("lang is not null")
    # grouping_id has a bit for each column that is summed over: the last column kept must be a word
    kept = F.lit(False)
    for i in range(order + 1):
        last = F.lit(True) if i == 0 else (F.col(names[i - 1]) != "") & (F.col("f") >= least)
        kept = kept | ((F.col("gid") == (1 << (order - i)) - 1) & last)
    return summed.where(kept).select("lang", F.array_compact(F.array(*names)).alias("words"), "f")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, order: int = 4, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The phrases of each language that stick together most: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are split into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words at
    spaces and tabs. A candidate is a run of 2 to `order` words with a = f(phrase) >= `least`. Cut
    after k words, it has l and r, the counts of both parts, and score floor(2000000 a / (l + r)); the
    lowest-scoring cut counts, ties to the smallest k. A candidate is dropped if a longer one holds
    it and 100 f(longer) >= 80 a. n: all words of the language. The first `top` by score and a, both
    falling, and phrase (by bytes).

    Null lang: `und`, together with documents of that name. Null and empty texts have no words; repeated
    rows count each; ids aren't read, nor are other columns. Empty input: no rows.
    """
    # A key for phrases: their words hold neither spaces nor line ends
    key = lambda words: F.concat_ws("\n", "lang", F.array_join(words, " "))
    counts = written(phrase_counts(docs, least, order, lang_col, text_col), "phrase-counts")
    f = counts.where(F.size("words") > 0).select(key(F.col("words")).alias("key"), "f")
    candidates = counts.where(F.size("words") >= 2)
    size = F.size("words")

    # Phrases that longer ones hold, with the most common of these; one row for each
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("words", i, n))))
    longer = candidates.where(size > 2).select("lang", "f", F.explode(spans).alias("words"))
    longer = longer.groupBy(key(F.col("words")).alias("key")).agg(F.max("f").alias("longer"))
    own = candidates.select("lang", "words", F.col("f").alias("a"), key(F.col("words")).alias("key")).join(longer, "key", "left")
    own = own.where("longer is null or 5 * cast(longer as decimal(20, 0)) < 4 * cast(a as decimal(20, 0))")

    # Each cut looks up its two parts; a word that begins most phrases is no load for one task
    part = lambda side: F.when(F.lit(side) == "l", F.slice("words", 1, F.col("k"))).otherwise(F.slice("words", F.col("k") + 1, size))
    cuts = written(own.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")), "cuts")
    total = cuts.count()
    most = max(1 << 16, total >> 9)
    found = cuts
    for side in ("l", "r"):
        parts = found.withColumn("key", key(part(side)))
        asked = parts.groupBy("key").agg(F.count("*").alias("asked"))
        found = hot_join(parts, f.withColumnRenamed("f", side).join(asked, "key"), "key", "asked", most).drop("key")
    scored = found.withColumn("score", F.expr("(2000000BD * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    best = scored.groupBy("lang", "words", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b"))
    best = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "b.*")

    # The first of ever fewer cells, so that no window spans more than some 16 times `top` rows
    order_by = (F.desc("score"), F.desc("a"), "phrase")
    cells = max(16, total // (16 * top))
    while cells:
        cell = F.pmod(F.xxhash64("phrase"), F.lit(cells))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", cell).orderBy(*order_by))).where(F.col("rank") <= top)
        cells = 0 if cells == 1 else max(1, cells // 16)
    ranked = best
    n = counts.where(size == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
