"""Packing: shortest pack first over the histogram of lengths, patterns joined back to the pieces by rank."""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, loaded, shipped, written


def byte_bpe(data: bytes):
    """A tiktoken encoder with the ids of a byte-level BPE file of the tokenizers library (merges in order of their ids)."""
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    spec = json.loads(data)
    # Bytes that are printable in Latin-1 stand for themselves, the others are moved up in order.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    # As the library does by default, a special token's string in a text is that token
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, rest_first: bool = False) -> DataFrame:
    """Documents as token ids with end_id after each, cut into pieces of max_tokens and a shorter rest.

    The rest is the last piece, or the first one. Output for each piece: id, start, length,
    ids_crc32 (of little-endian 32-bit ids), doc_tokens and, if asked for, ids. Null text counts as empty: one piece of the end id. Strings of special
    tokens in a text become those tokens, the library's default.
    """
    key, data = shipped(docs.sparkSession, tokenizer)

    def cut(batches):
        encoder = loaded(key, lambda: byte_bpe(data.value))
        end = np.array([end_id], dtype="<u4")
        for batch in chunks(batches):
            out: dict[str, list] = defaultdict(list)
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encoder.encode_to_numpy(text or "", allowed_special="all").astype("<u4"), end])
                n = len(ids)
                starts = [0, *range(n % max_tokens or max_tokens, n, max_tokens)] if rest_first else range(0, n, max_tokens)
                for at, end_at in zip(starts, [*starts[1:], n], strict=True):
                    part = ids[at:end_at]
                    out["doc"].append(doc.as_py())
                    out["start"].append(at)
                    out["length"].append(len(part))
                    out["crc"].append(zlib.crc32(part.tobytes()))
                    out["n"].append(n)
                    if with_ids:
                        out["ids"].append(part.astype("i4"))
            cols = [pa.array(out["doc"], batch.schema.field(0).type), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "n"))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols, names = [*cols, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, lengths in each) for a histogram of lengths from 1 to size.

    Lengths are placed longest first, each into the pack with the most room, all packs of one
    pattern at once. The work follows the number of lengths, not of pieces.
    """
    room: dict[int, list[list]] = defaultdict(list)  # room left: [packs, pattern]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r, groups in room.items() if groups), default=0)
            if most >= length:
                packs, pattern = room[most].pop()
                used = min(packs, left)
                if packs > used:
                    room[most].append([packs - used, pattern])
                room[most - length].append([used, (*pattern, length)])
            else:  # new packs: the next of the same length go on top while they fit
                fit = size // length
                used = max(1, left // fit)
                fit = min(fit, left)
                room[size - fit * length].append([used, (length,) * fit])
                used *= fit
            left -= used
    return [(packs, pattern) for groups in room.values() for packs, pattern in groups]


def layout(histogram: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes: runs of ranks (length, first rank) with the first
    sequence, the offset there, and how many pieces of that length follow each other in a sequence."""
    rows, ranks, first = [], Counter(), 0
    for packs, pattern in sorted(shortest_pack_first(histogram, size), key=lambda x: (x[1], x[0]), reverse=True):
        offset = 0
        for length, times in Counter(pattern).items():  # in order: lengths never rise
            rows.append((length, ranks[length], first, offset, times))
            ranks[length] += packs * times
            offset += length * times
        first += packs
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset", "times"), np.array(rows or np.empty((0, 5)), dtype=np.int64).T, strict=True))


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence and the offset where each lies.

    A sequence holds at most max_tokens ids, without gaps; sequence ids have no gaps either.
    The histogram has max_tokens bins at most, and only it and the plan made from it pass
    through the driver. The r-th piece of a length takes the r-th place of that length; ranks
    are counted in salted cells, since one length may hold most rows.

    Null text: the end id alone. Null ids, repeated rows and equal ids are pieces like any others.
    Empty input: no rows. Other columns are not read.
    """
    cut = written(pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col, with_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = layout(histogram, max_tokens)
    per_cell = max(64, sum(histogram.values()) // 4096)
    salts = F.element_at(F.array(*(F.lit(-(-histogram.get(i + 1, 1) // per_cell)) for i in range(max_tokens))), F.col("length").cast("int"))
    # By the row's own key, so that equal rows are dealt to all cells
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("_row"), salts))
    counted = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "start", "_row")))
    # max_tokens + 4096 rows at most
    ranked = ranked.join(F.broadcast(base), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("n") - 1)
    names = [c for c in cut.columns if c != "_row"]

    def place(batches):
        big = np.int64(1) << 40
        starts = plan["length"] * big + plan["rank"]
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(starts, length * big + rank, "right") - 1
            ahead = rank - plan["rank"][at]
            sequence = plan["sequence"][at] + ahead // plan["times"][at]
            offset = plan["offset"][at] + ahead % plan["times"][at] * length
            keep = [b.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names) + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "rank").mapInArrow(place, schema)
