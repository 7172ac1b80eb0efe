import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docforensics.llm.packing import layout, pack, shortest_pack_first

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_lies_in_one_place(docs, rows):
    tokenizer = Tokenizer.from_file(FILE)
    want = []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            want.append((str(r[0]), at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    out = pack(docs, FILE, max_tokens=256).collect()
    assert sorted(want) == sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out)
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 256 and sorted(ends) == [*range(len(ends))]


def test_special_tokens_in_texts(spark):
    """As the library gives them untouched."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "\n\n<|endoftext|> \n", "<|endoftext|>" * 400]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(FILE)
    out = {(r["doc_id"], r["start"]): r["ids"] for r in pack(d, FILE, max_tokens=64, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert ids == [x for at in range(0, len(ids), 64) for x in out[i, at]]


def test_ids_on_request(docs):
    r = pack(docs.where("doc_id = 0"), FILE, with_ids=True).first()
    assert len(r["ids"]) == r["length"] and r["ids"][-1] == 0


def test_plan_places_the_whole_histogram():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(rng.integers(1, 50)) for k in rng.choice(np.arange(1, 101), 60, replace=False)}
    placed = {}
    for packs, pattern in shortest_pack_first(histogram, 100):
        assert sum(pattern) <= 100
        for length in pattern:
            placed[length] = placed.get(length, 0) + packs
    assert placed == histogram
    used = sum(k * n for k, n in histogram.items())
    assert sum(p for p, _ in shortest_pack_first(histogram, 100)) <= 1.1 * used / 100 + 1
    assert shortest_pack_first({10: 25}, 100) and sum(p for p, _ in shortest_pack_first({10: 25}, 100)) == 3
    assert len(layout({}, 100)["length"]) == 0


def test_equal_rows_are_dealt_to_many_cells(spark, monkeypatch):
    """Rows that are equal in everything, null ids included, are ranked in more than one cell."""
    from docforensics.llm import packing

    kept = {}
    written = packing.written
    monkeypatch.setattr(packing, "written", lambda d, n: kept.setdefault(n, written(d, n)))
    d = spark.createDataFrame([(None, "the same")] * 4000, "doc_id long, text string")
    out = pack(d, FILE, max_tokens=64)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert kept["pieces"].select("_row").distinct().count() == 4000
    rows = out.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 4000
    cells = kept["pieces"].selectExpr("pmod(xxhash64(_row), 63) as c").groupBy("c").count().collect()
    assert len(cells) == 63 and max(r["count"] for r in cells) < 200


def test_empty(empty):
    assert pack(empty, FILE).count() == 0
