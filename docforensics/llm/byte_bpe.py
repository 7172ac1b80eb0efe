"""Byte-level BPE by a rank queue: a hierarchical bitmap over merge ranks finds the next merge."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import chunks, loaded, shipped

#: Bytes that the ids of remembered pre-tokens may take, with what their entries cost, in one generation.
REMEMBERED, ENTRY = 96 << 20, 160


class RankQueue:
    """Encodes pre-tokens, all that are new in a chunk of text at once; remembers what it has encoded.

    The bytes of the pre-tokens lie end to end in a linked list with barriers between them. A
    bucket for each merge rank holds the positions where a pair of that rank starts. Two levels
    of bitmaps say which ranks have a bucket: a bit of the upper one covers 256 ranks, so two
    find-first-set steps give the lowest rank. A merge makes entries of its neighbours stale;
    they are skipped when their turn comes, since the pair there no longer has the bucket's rank.

    Memory has two generations: when the young one is full it becomes the old one, from which
    what is still in use is taken over.
    """

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # Every pair of tokens that are a token together
        halves = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = np.array(halves, dtype=np.int64).reshape(-1, 3).T
        key = left << 32 | right
        order = np.argsort(key)
        self.pairs, self.merged = np.append(key[order], np.iinfo(np.int64).max), np.append(merged[order], -1).astype(np.int32)
        self.low = [0] * -(-len(self.tokens) // 256)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def known(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of all these pre-tokens, and of others, as little-endian 32-bit integers."""
        if self.held > REMEMBERED:
            self.old, self.young, self.held = self.young, {}, 0
        new = []
        for p in pieces - self.young.keys():
            ids = self.old.get(p)
            if ids is None:
                new.append(p)
            else:
                self.young[p] = ids
                self.held += len(ids) + ENTRY
        for p, ids in zip(new, self.encode_all([p.encode() for p in new]), strict=True):
            self.young[p] = ids
            self.held += len(ids) + len(p) + ENTRY
        return self.young

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 for those that don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], -1).astype(np.int32)

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token. A pre-token that is a token is taken as it is."""
        whole = [self.ranks.get(p) for p in pieces]
        split = [p for p, w in zip(pieces, whole, strict=True) if w is None]
        parts = iter(self._merged(split) if split else ())
        return [next(parts) if w is None else w.to_bytes(4, "little") for w in whole]

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        size = np.array([len(p) for p in pieces])
        ends = np.cumsum(size)
        n = int(ends[-1])
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        token = np.append(self.single[raw], -1)
        after = np.arange(1, n + 2, dtype=np.int64)  # where the next token starts; n: none
        after[ends - 1] = n
        before = np.arange(-1, n, dtype=np.int64)
        before[ends - size] = -1
        pair = np.full(n + 1, -1, dtype=np.int32)  # rank of the pair that starts there
        inner = np.flatnonzero(after[:-1] < n)
        pair[inner] = self._rank(token[inner], token[inner + 1])

        low, top, buckets = self.low, 0, {}

        def fill(at: np.ndarray, rank: np.ndarray) -> int:
            """Puts positions into the buckets of their ranks; the bits of the upper bitmap."""
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cut.tolist()]
            bits = 0
            for r, a, b in zip(rank[starts].tolist(), starts, [*starts[1:], len(at)], strict=True):
                if r in buckets:
                    buckets[r].append(at[a:b])
                else:
                    buckets[r] = [at[a:b]]
                    low[r >> 8] |= 1 << (r & 255)
                    bits |= 1 << (r >> 8)
            return bits

        some = np.flatnonzero(pair >= 0)
        if len(some):
            top |= fill(some, pair[some])
        again = set()  # pre-tokens where a merge brought up a lower rank
        while top:
            a = (top & -top).bit_length() - 1
            x = low[a]
            r = a << 8 | (x & -x).bit_length() - 1
            low[a] = x = x & (x - 1)
            if not x:
                top &= top - 1
            bucket = buckets.pop(r)
            at = np.concatenate(bucket) if len(bucket) > 1 else bucket[0]
            at = np.unique(at[pair[at] == r])
            if not len(at):
                continue
            touch = np.append(False, after[at[:-1]] == at[1:])
            if touch.any():  # pairs that share a token: every other one from the left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(touch, 0, place))) % 2 == 0]
            gone = after[at]
            stop = after[gone]
            token[at], token[gone], pair[gone], pair[at] = r, -1, -1, -1
            after[at] = stop
            before[stop] = at
            left = before[at]
            changed = np.unique(np.concatenate([at[stop < n], left[left >= 0]]))
            rank = self._rank(token[changed], token[after[changed]])
            pair[changed] = rank
            if len(rank) and ((rank >= 0) & (rank < r)).any():
                again.update(np.searchsorted(ends, changed[(rank >= 0) & (rank < r)], "right").tolist())
            hit = rank >= 0
            if hit.any():
                top |= fill(changed[hit], rank[hit])
        stays = token[:-1] >= 0
        ids = token[:-1][stays].astype("<u4").tobytes()
        count = np.cumsum(np.add.reduceat(stays.astype(np.int64), ends - size)) * 4
        out = [ids[i:j] for i, j in zip([0, *count[:-1].tolist()], count.tolist(), strict=True)]
        for k in again:  # there, order within the pre-token matters
            out[k] = np.array(self.encode(pieces[k]), dtype="<u4").tobytes()
        return out

    def encode(self, data: bytes) -> list[int]:
        """One pre-token, merge by merge."""
        ranks, low, n = self.ranks.get, [0] * len(self.low), len(data)
        whole = ranks(data)  # the tokenizer takes a pre-token that is a token as it is
        if whole is not None:
            return [whole]
        token: list[int | None] = self.single[np.frombuffer(data, dtype=np.uint8)].tolist()
        end = [*range(1, n + 1)]  # of the token that starts at a position
        before = [*range(-1, n - 1)]
        pair = [ranks(data[i : i + 2]) for i in range(n - 1)]  # rank of the pair that starts there
        pair.append(None)
        buckets: dict[int, list[int]] = {}
        top = 0
        for i, r in enumerate(pair):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    low[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            a = (top & -top).bit_length() - 1
            x = low[a]
            r = a << 8 | (x & -x).bit_length() - 1
            # The rank leaves the bitmap; it comes back if a bucket is left or made
            low[a] = x = x & (x - 1)
            if not x:
                top &= top - 1
            bucket = buckets.pop(r)
            if len(bucket) > 1:
                bucket.sort()
            again = r
            for k, i in enumerate(bucket):
                if pair[i] != r:
                    continue
                if again < r:  # a lower rank has come up: it goes first
                    buckets[r] = buckets.get(r, []) + bucket[k:]
                    low[a] |= 1 << (r & 255)
                    top |= 1 << a
                    break
                j = end[i]
                end[i] = stop = end[j]
                token[i], token[j], pair[j] = r, None, None
                if stop < n:
                    before[stop] = i
                    pair[i] = q = ranks(data[i : end[stop]])
                    if q is not None:
                        if q < again:
                            again = q
                        if q in buckets:
                            buckets[q].append(i)
                        else:
                            buckets[q] = [i]
                            low[q >> 8] |= 1 << (q & 255)
                            top |= 1 << (q >> 8)
                else:
                    pair[i] = None
                p = before[i]
                if p >= 0:
                    pair[p] = q = ranks(data[p:stop])
                    if q is not None:
                        if q < again:
                            again = q
                        if q in buckets:
                            buckets[q].append(p)
                        else:
                            buckets[q] = [p]
                            low[q >> 8] |= 1 << (q & 255)
                            top |= 1 << (q >> 8)
        return [t for t in token if t is not None]


def _ascii(classes: str) -> str:
    return classes.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\p{White_Space}", r"\t-\r ")


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text, each match of the pattern apart, and the text decoded from them.

    Output: id, n_tokens, ids_sha256 (hex, over little-endian 32-bit ids), decoded_sha256 (hex,
    over the bytes decoded from the ids) and, if asked for, ids and decoded (binary). Null counts
    as empty: no tokens. One row for each row, nothing is shuffled; null ids, copies and repeated
    rows stay, whole long texts too. Empty input: no rows. Other columns are not read.
    """
    key, data = shipped(docs.sparkSession, ranks)
    # \s of the library that the ranks are for is the White_Space property
    split = pattern.replace(r"[^\s\p{L}\p{N}]+", r"[^\p{White_Space}\p{L}\p{N}]+").replace(r"\s", r"\p{White_Space}")
    # These runs never give a character back, which saves time and changes nothing
    split = re.sub(r"( \?(?:\\p\{\w\}|\[[^\]]*\])\+)", r"\1+", split)
    # What the classes hold of ASCII, for texts that have nothing else
    ascii_split = re.sub(r"(\[\^?)((?:\\p\{\w+\})+)\]", lambda m: m[1] + _ascii(m[2]) + "]", split)
    ascii_split = re.sub(r"(?:\\p\{\w+\})+", lambda m: f"[{_ascii(m[0])}]", ascii_split).replace(r"\S", r"[^\t-\r ]")

    def run(batches):
        queue = loaded(key, lambda: RankQueue(data.value))
        find = loaded(split, lambda: regex.compile(split)).findall
        find_ascii = loaded(ascii_split, lambda: re.compile(ascii_split)).findall
        token_of = queue.tokens.__getitem__
        for batch in chunks(batches):
            out = defaultdict(list)
            found = [(find_ascii if text.isascii() else find)(text) if text else [] for text in batch.column(1).to_pylist()]
            known = queue.known(set().union(*found)).__getitem__
            for pieces in found:
                ids = b"".join(map(known, pieces))
                decoded = b"".join(map(token_of, np.frombuffer(ids, dtype="<u4").tolist()))
                out["n"].append(len(ids) // 4)
                out["ids"].append(hashlib.sha256(ids).hexdigest())
                out["decoded"].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    out["list"].append(np.frombuffer(ids, dtype="<u4").astype("i4"))
                    out["bytes"].append(decoded)
            cols = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.string()), pa.array(out["decoded"], pa.string())]
            if with_ids:
                cols += [pa.array(out["list"], pa.list_(pa.int32())), pa.array(out["bytes"], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    types = [kind, "bigint", "string", "string"] + ["array<int>", "binary"] * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True)))
