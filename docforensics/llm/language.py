"""Language ID by error-correcting output codes: binary n-gram classifiers predict the bits of codewords."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import carried, chunks

#: Hash slots for n-grams of 1 to 4 bytes, and slots in one row of the table of counts.
SLOT_BITS, BLOCK = 16, 4096
SIZES = (1, 2, 3, 4)


def slots(data: np.ndarray) -> np.ndarray:
    """A slot for each n-gram that ends at each byte: an array (bytes, sizes). Bytes are lower-cased (A-Z)."""
    x = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    out = np.empty((len(x), len(SIZES)), dtype=np.uint32)
    gram = np.zeros(len(x), dtype=np.uint32)
    for j, n in enumerate(SIZES):
        # Before the first byte stand zeros; the byte n - 1 places back comes on top.
        back = np.concatenate([np.zeros(min(n - 1, len(x)), dtype=np.uint32), x[: max(0, len(x) - n + 1)]])
        gram = gram + (back << np.uint32(8 * (n - 1)))
        out[:, j] = ((gram + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    return out


def codewords(n: int) -> np.ndarray:
    """A codeword of -1 and 1 for each of n languages: all divisions in two up to five languages, else a
    fixed random code of 10 log2(n) bits without equal or constant columns."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, dtype=float).T
    rng, cols = np.random.default_rng(n), []
    while len(cols) < int(np.ceil(10 * np.log2(n))):
        c = tuple(rng.choice((1, -1), n))
        if abs(sum(c)) < n and c not in cols and tuple(-x for x in c) not in cols:
            cols.append(c)
    return np.array(cols, dtype=float).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (slots, bits): log odds for a bit
    trust: np.ndarray  # (bits): weights of the loss
    margin: np.ndarray  # (bits): log odds of an average n-gram, to which margins are scaled


def _counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, block, n): counts of n-grams over all texts, added up in each task first."""

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in chunks(batches, text=0):
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                found = np.bincount(slots(np.frombuffer(text.encode(), np.uint8)).ravel(), minlength=1 << SLOT_BITS)
                if lang in tables:
                    tables[lang] += found
                else:
                    tables[lang] = found
        rows = [(lang, b, t[b * BLOCK : (b + 1) * BLOCK].astype("<i8")) for lang, t in tables.items() for b in range(len(t) // BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["lang", "block", "n"])

    part = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null").mapInArrow(count, "lang string, block int, n array<bigint>")

    def add(table):
        total = np.sum([np.asarray(x.values) for x in table.column("n")], axis=0)
        return pa.table({"lang": table.column("lang")[:1], "block": table.column("block")[:1], "n": pa.array([total.tolist()], pa.list_(pa.int64()))})

    # In two steps, so that no group holds a row of every task
    some = part.withColumn("salt", F.spark_partition_id() % 64).groupBy("lang", "block", "salt").applyInArrow(add, "lang string, block int, n array<bigint>")
    return some.groupBy("lang", "block").applyInArrow(add, "lang string, block int, n array<bigint>")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """One n-gram classifier for each bit, from all texts with a language.

    A classifier is the log odds of each n-gram in the languages whose codeword has the bit, to
    those whose codeword doesn't have it. Only counts of 65536 slots for each language reach the
    driver. A bit's loss is trusted by how far apart its two sides are on average.
    """
    tables: dict[str, np.ndarray] = {}
    for r in _counts(docs, text_col, lang_col).toLocalIterator():
        tables.setdefault(r["lang"], np.zeros(1 << SLOT_BITS))[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["n"]
    names = sorted(tables)
    code = codewords(len(names))
    if not names:
        return Model([], code, np.zeros((1 << SLOT_BITS, code.shape[1]), np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    share = np.array([tables[x] + 0.5 for x in names]).reshape(len(names), -1)
    share /= share.sum(axis=1, keepdims=True)
    weights, margin = np.zeros((1 << SLOT_BITS, code.shape[1])), np.ones(code.shape[1])
    for b in range(code.shape[1]) if len(names) > 1 else ():
        yes, no = (share[code[:, b] == s].mean(axis=0) for s in (1, -1))
        weights[:, b] = np.log(yes / no)
        margin[b] = ((yes - no) * weights[:, b]).sum() / 2
    trust = margin / margin.sum()
    return Model(names, code, weights.astype(np.float32), trust, margin)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword by weighted logistic loss, and a probability for each language."""
    loss = np.zeros((len(margins), len(model.languages)))
    for k in range(len(model.languages)):
        loss[:, k] = (np.logaddexp(0, -4 * model.code[k] * margins) * model.trust).sum(axis=1)
    odds = np.exp(2 * (loss.min(axis=1, keepdims=True) - loss))
    return loss.argmin(axis=1), odds / odds.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of each whole text.

    Output: id, lang_pred (a learned language, `und` for a null text or one without a letter, or
    if no language was learned), score (0 to 1: the decoded share of the language), ambiguous
    (the second nearest codeword is less than ambiguous_below behind), and the columns in `keep`
    as in_<name>. Ties go to the language that comes first. One row for each row, no shuffle;
    repeated rows and null ids stay. Empty input: no rows. Other columns, whatever their names, are
    not read. A text of more than 50,000 bytes is summed by its distinct n-grams, which differs in rounding alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 65536 x bits, whatever the corpus

    def run(batches):
        m = sent.value
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            known = [bool(t) and bool(m.languages) and any(map(str.isalpha, t)) for t in texts]
            data = [np.frombuffer(t.encode(), np.uint8) for t, k in zip(texts, known, strict=True) if k]
            margins = np.zeros((len(data), m.code.shape[1]))
            for i, x in enumerate(data):
                at = np.bincount(slots(x).ravel(), minlength=1 << SLOT_BITS) if len(x) > 50_000 else None
                total = at @ m.weights if at is not None else m.weights[slots(x).ravel()].sum(axis=0)
                margins[i] = total / (len(x) * len(SIZES)) / m.margin
            best, odds = decode(m, margins) if data else (np.zeros(0, int), np.zeros((0, 1)))
            top = np.sort(odds, axis=1)[:, ::-1]
            found = iter(zip([m.languages[i] for i in best], top[:, 0].tolist(), (top[:, 0] - top[:, 1] if top.shape[1] > 1 else top[:, 0]).tolist(), strict=True))
            rows = [next(found) if k else ("und", 0.0, 1.0) for k in known]
            cols = [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] < ambiguous_below for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(i) for i in kept)], names)

    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [id_col, "lang_pred", "score", "ambiguous", *(f"in_{c}" for c in keep)]
    types = [kind[id_col], "string", "double", "boolean", *(kind[c] for c in keep)]
    columns, kept = carried(id_col, text_col, keep)
    return docs.select(*columns).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True)))


def held_out(id_col: str, folds: int = 5) -> Column:
    """True for the documents that nothing is learned from. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
