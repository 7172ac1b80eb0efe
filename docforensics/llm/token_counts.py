"""Token counts by count-only Viterbi over the matches of an Aho-Corasick automaton of unigram pieces."""

from __future__ import annotations

import regex
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import chunks, loaded, shipped

#: White space mark of the vocabulary, and what an unknown character scores below the least piece.
MARK, UNKNOWN_BELOW = "▁", 10.0
#: Counted segments that a worker remembers before it starts afresh.
REMEMBERED = 400_000


class PieceCounter(dict):
    """(count, score) of the best segmentation of a segment; remembers what it has counted.

    For each end the automaton gives the matching pieces, longest first. A node keeps the best
    score and the number of pieces on the way there, and is replaced only by a better score, so
    of equal ways the one whose last piece is longest stays, as in the tokenizer. A character
    that is no piece itself may be unknown; it then counts as one token for each of its bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_BELOW

    def __missing__(self, segment: str) -> tuple[int, float]:
        n = len(segment)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        unknown = self.unknown if any(c not in self.single for c in segment) else None
        at = 0  # ends up to here are final
        for end, (length, score) in self.automaton.iter(segment):
            end += 1
            if unknown is not None:
                while at < end - 1:
                    at += 1
                    self._close(segment, at, best, count)
            start = best[end - length]
            if start is not None and (best[end] is None or start + score > best[end]):
                best[end], count[end] = start + score, count[end - length] + 1
        if unknown is not None:
            while at < n:
                at += 1
                self._close(segment, at, best, count)
        out = (count[n], best[n] or 0.0)
        if len(self) >= REMEMBERED:
            self.clear()
        if n <= 64:
            self[segment] = out
        return out

    def _close(self, segment: str, at: int, best: list, count: list) -> None:
        c = segment[at - 1]
        if c not in self.single and (best[at] is None or best[at - 1] + self.unknown > best[at]):
            best[at], count[at] = best[at - 1] + self.unknown, count[at - 1] + len(c.encode())


def unigram_pieces(model: bytes) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without unknown, control and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens and score of the best segmentation of every whole text.

    Spaces become the vocabulary's mark, with one more in front; nothing else is normalised. No
    piece holds a mark after another character, so a text is cut before each run of marks, and
    the parts are independent. Output: id, n_chars, n_tokens, score. Null and empty texts have no
    tokens. One row for each row, nothing is shuffled; null ids and repeated rows stay. Empty input: no
    rows. Other columns, whatever their names, are not read. A very long text is held whole by one task.
    """
    key, data = shipped(docs.sparkSession, model)

    def run(batches):
        counter = loaded(f"pieces {key}", lambda: PieceCounter(unigram_pieces(data.value)))
        find, known = regex.compile(f"{MARK}+[^{MARK}]*").findall, counter.__getitem__
        for batch in chunks(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                if not text:
                    rows.append((0, 0, 0.0))
                    continue
                found = list(map(known, find(MARK + text.replace(" ", MARK))))
                rows.append((len(text), sum(c for c, _ in found), sum(s for _, s in found)))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [id_col, "n_chars", "n_tokens", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars bigint, n_tokens bigint, score double")
