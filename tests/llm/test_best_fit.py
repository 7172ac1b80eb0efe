import bisect
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docforensics.llm import best_fit as module
from docforensics.llm.best_fit import best_fit

FILE = public_tokenizers.path("byte_bpe_50k.json")


def decreasing(lengths, size):
    """Sequences that best fit takes, one piece at a time from the longest."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        n += at == len(rooms)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else size) - x)
    return n


def held(out, size):
    """Sequences, once it is sure that no piece lies over another and none is too long."""
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert not ends or max(ends.values()) <= size
    return len(ends)


@pytest.mark.parametrize("rows_of_a_range", [1 << 15, 4])
def test_every_id_lies_in_one_place(docs, rows, rows_of_a_range, monkeypatch):
    monkeypatch.setattr(module, "RANGE", rows_of_a_range)
    tokenizer = Tokenizer.from_file(FILE)
    want = []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        for i, at in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[at : first if i == 0 else at + 256]
            want.append((str(r[0]), i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    out = best_fit(docs, FILE, max_tokens=256).collect()
    assert sorted(want) == sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    assert held(out, 256) <= decreasing([r["length"] for r in out], 256) + 1


def test_most_rows_of_one_length(spark, monkeypatch):
    """Equal documents are dealt to several ranges; gaps take many short ones in a round."""
    monkeypatch.setattr(module, "RANGE", 60)
    texts = ["a a a a a a a"] * 500 + ["word " * n for n in range(1, 90)] + [""] * 300
    d = spark.createDataFrame([(None, t) for t in texts], "key long, text string")
    out = best_fit(d, FILE, max_tokens=64, id_col="key", with_ids=True).collect()
    assert len(out) >= len(texts) and all(len(r["ids"]) == r["length"] for r in out)
    lengths = [r["length"] for r in out]
    assert held(out, 64) <= 1.02 * decreasing(lengths, 64) + 1


def test_runs_of_ranges():
    """Pieces take the smallest gaps of larger ranges, as many in each as surely fit."""
    parts = [(0, 0, None, 2, 90), (1, 1, 80, 3, 50), (2, 9, 20, 0, None)]
    assert module._matched(parts) == [(1, 0, 1, 0, 1, 1), (2, 0, 6, 1, 2, 2), (2, 6, 3, 0, 0, 4)]


def test_only_whole_sequences_and_none(spark, empty):
    d = spark.createDataFrame([(1, "a" * 0), (2, " a" * 7)], "doc_id long, text string")
    out = best_fit(d, FILE, max_tokens=1).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and held(out, 1) == len(out)
    assert best_fit(empty, FILE).count() == 0
