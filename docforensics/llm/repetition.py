"""Quality rules by suffix array: repeated substrings of words within each text, their spans, share and length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import carried, chunks

#: Classes of bytes: a symbol, a continuation of a UTF-8 character, white space.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"


def _byte_table(members) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(members)] = 1
    return table


_IS_SYMBOL, _IS_TEXT = _byte_table(SYMBOLS), 1 - _byte_table([*SPACES, *range(0x80, 0xC0)])


def suffix_ranks(classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix ranks of several sequences laid end to end, by prefix doubling.

    classes: a rank for each position, so that no two sequences share one; ends: the end of each
    position's own sequence. Only positions whose rank isn't unique yet are sorted again.
    Also the ranks after each doubling (level j tells substrings of 2^j apart).
    """
    n = len(classes)
    # A rank is the number of smaller suffixes, so ranks of single members are final.
    _, inverse, count = np.unique(classes, return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    rank = first[inverse].astype(np.int32)  # a chunk has fewer words than that
    open_ = np.flatnonzero(count[inverse] > 1)
    levels, step = [rank], 1
    while len(open_):
        ahead = open_ + step
        second = np.where(ahead < ends[open_], rank[np.minimum(ahead, n - 1)], -1)
        mine = rank[open_]
        order = np.lexsort((second, mine))
        open_, mine, second = open_[order], mine[order], second[order]
        place = np.arange(len(open_))
        group = np.concatenate([[True], mine[1:] != mine[:-1]])
        part = group | np.concatenate([[True], second[1:] != second[:-1]])
        start = np.maximum.accumulate(np.where(group, place, 0))
        head = np.maximum.accumulate(np.where(part, place, 0))
        rank = rank.copy()
        rank[open_] = mine + head - start
        levels.append(rank)
        alone = part & np.concatenate([part[1:], [True]])
        open_ = open_[~alone]
        step *= 2
    return rank, levels


def longest_repeats(classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of its deepest longest-common-prefix interval: of the longest
    substring from there that also starts elsewhere in the same sequence."""
    n = len(classes)
    rank, levels = suffix_ranks(classes, ends)
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    lcp = np.zeros(n + 1, dtype=np.int64)
    x, y, same = a[live], b[live], np.zeros(len(live), dtype=np.int64)
    for j in range(len(levels) - 1, -1, -1):
        px, py = x + same, y + same
        inside = (px < ends[x]) & (py < ends[y])
        equal = inside & (levels[j][np.minimum(px, n - 1)] == levels[j][np.minimum(py, n - 1)])
        same += np.where(equal, 1 << j, 0)
    lcp[live + 1] = np.minimum(same, ends[np.maximum(x, y)] - np.maximum(x, y))
    longest = np.empty(n, dtype=np.int64)
    longest[order] = np.maximum(lcp[:-1], lcp[1:])
    return longest


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeated substring of `least` words or more."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + longest[at], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: list[bytes], min_repeat: int) -> dict[str, list | np.ndarray]:
    """The figures of each text; see quality_rules."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    size = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    out: dict = {"n_words": counts, "word_chars": _per_text(_IS_TEXT[data], size), "n_symbols": _per_text(_IS_SYMBOL[data], size)}
    lines = [[x for x in t.split(b"\n") if x.strip(SPACES)] for t in texts]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
    n = int(bounds[-1])
    if not n:
        return out | {"n_repeat_words": counts, "n_covered_words": counts, "longest_repeat": counts, "spans": [[] for _ in texts]}
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    text_of = np.repeat(np.arange(len(texts)), counts)
    longest = longest_repeats(text_of * (len(flat.dictionary) + 1) + flat.indices.to_numpy(), bounds[1:][text_of])
    spans: list[list] = [[] for _ in texts]
    covered = _covered(longest, min_repeat)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    for a, b in edge.reshape(-1, 2):  # a run may touch the next text's
        while a < b:
            t = text_of[a]
            end = min(b, bounds[t + 1])
            spans[t].append({"start": int(a - bounds[t]), "end": int(end - bounds[t])})
            a = end
    full = counts > 0
    most = np.zeros(len(texts), dtype=np.int64)
    most[full] = np.maximum.reduceat(longest, bounds[:-1][full])
    return out | {"n_repeat_words": _per_text(_covered(longest, 3), bounds), "n_covered_words": _per_text(covered, bounds), "longest_repeat": most, "spans": spans}


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_repeat: int = 8,
    max_covered: float = 0.25,
    max_longest: int = 60,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Figures of each whole text, the base rules, and the verdict of the suffix array.

    Words are runs without ASCII white space, compared as they stand. Each text's suffix array
    of words has its longest-common-prefix intervals; a maximal repeated substring of min_repeat
    words or more gives the spans of all its places. The spans are united: a text is rejected
    if they cover more than max_covered of its words, or if its longest repeat has more than
    max_longest words. base_failed: fewer than min_words words, or more than max_repeat_percent
    % of the words lie in 3-word windows that occur twice or more (the first place included).

    Output: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
    longest_repeat (words), covered (share), spans (array of word places from start up to end),
    base_failed, kept, and the columns named in `keep`. Null and empty texts have no words and
    fail the base rules. One row out for each row in, in any order; null ids stay. Empty input:
    no rows. Rows need no others, so nothing is shuffled and copies are harmless. A text's arrays take
    some 110 bytes for each of its own (a text of 7 MB took 800 MB), so a task's memory bounds its length.
    """

    def run(batches):
        for batch in chunks(batches):
            m = measure([(x or "").encode() for x in batch.column(1).to_pylist()], min_repeat)
            words = m["n_words"]
            covered = m["n_covered_words"] / np.maximum(words, 1)
            failed = (words < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * words)
            kept = ~failed & (covered <= max_covered) & (m["longest_repeat"] <= max_longest)
            longs = [m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in longs), pa.array(covered), pa.array(m["spans"], span), pa.array(failed), pa.array(kept)]
            cols += [batch.column(i) for i in carried_at]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "covered", "spans", "base_failed", "kept"]
    types = [kind[id_col], *["bigint"] * 7, "double", "array<struct<start:int,end:int>>", "boolean", "boolean"]
    names, types = [*names, *(f"in_{c}" for c in keep)], [*types, *(kind[c] for c in keep)]
    columns, carried_at = carried(id_col, text_col, keep)
    return docs.select(*columns).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True)))
