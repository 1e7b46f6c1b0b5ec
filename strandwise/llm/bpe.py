"""Operator 5: byte-level BPE by monoid tree reduction.

A text is halved down to leaves, which the pattern splits into pieces; a piece is halved down to a few bytes, which are merged. Neighbours are
joined by re-encoding a window around the seam, which doubles until what lies outside is stable; pieces that a worker has
met are remembered. Both proofs are local. Pieces: a match depends on no earlier character and on at most max(start + 3, end + 2) later ones, so pieces
that end two characters before the window's seam stay, and as soon as the new split and the right side's old split
share a start, they agree from there on. Tokens inside one long piece: a token sequence is the encoding of its bytes
if each adjacent pair is the encoding of its own bytes (the first merge across a border would already happen in the
pair alone), so halves of a piece are joined by re-encoding a doubling window until the pairs at its rims hold.
Decoding concatenates the tokens' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

LEAF = 2048  # characters of a leaf, and ids of one in decoding
BYTES = 16  # bytes of a piece that are merged as a leaf
MEMO = 150_000  # pieces of each of two generations that a worker remembers, and pairs of tokens
ROWS = 256  # rows that are decoded at once
SHORT = 96  # bytes up to which a window is merged by plain search, and characters of a piece that is remembered


class Coder:
    """Encodes and decodes with the ranks of one file; a worker process keeps one."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The BPE of a few bytes: always the lowest rank first, the leftmost of equals."""
        ranks = self.ranks
        if not data or data in ranks:
            return [data] if data else []
        if len(data) > SHORT:
            return self._merge_heap(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [ranks.get(data[i : i + 2], 1 << 60) for i in range(len(data) - 1)]
        while found:
            low = min(found)
            if low == 1 << 60:
                break
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                found[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return parts

    def _merge_heap(self, data: bytes) -> list[bytes]:
        n, ranks = len(data), self.ranks
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := data[i : i + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [data[i : end[i]] for i in range(n) if end[i]]

    def holds(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens stay as they are side by side."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return found

    def piece(self, data: bytes) -> list[bytes]:
        """The tokens of a part of a piece, as a tree of halves down to a few bytes."""
        if len(data) <= BYTES:
            return self.merge(data)
        mid = len(data) // 2
        left, right = self.piece(data[:mid]), self.piece(data[mid:])
        w = 0
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            new = self.merge(b"".join(left[a:] + right[:b]))
            row = [*left[max(0, a - 1) : a], *new, *right[b : b + 1]]
            if all(self.holds(row[i], row[i + 1]) for i in {0, len(row) - 2} if len(row) > 1):
                return left[:a] + new + right[b:]
            w = max(1, w * 2)

    def code(self, piece: str) -> bytes:
        """The ids of one piece as int32 bytes. A full memo becomes the older one, from which pieces that are met again come
        back, so frequent ones stay."""
        found = self.older.get(piece)
        if found is None:
            data = piece.encode()
            found = array("i", map(self.ranks.__getitem__, [data] if data in self.ranks else self.piece(data))).tobytes()
        if len(piece) <= SHORT:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[piece] = found
        return found

    def codes(self, pieces: list[str]) -> list[bytes]:
        memo, code = self.memo.get, self.code
        return [memo(p) or code(p) for p in pieces]

    def tree(self, text: str) -> tuple[list[str], list[bytes]]:
        """The pieces of a text and their ids."""
        if len(text) <= LEAF:
            pieces = self.split(text)
            return pieces, self.codes(pieces)
        mid = len(text) // 2
        return self.join(self.tree(text[:mid]), self.tree(text[mid:]))

    def join(self, left: tuple, right: tuple) -> tuple[list[str], list[bytes]]:
        (lp, lc), (rp, rc) = left, right
        w = 4
        while True:
            a, b = max(0, len(lp) - w), min(len(rp), w)
            head, tail = "".join(lp[a:]), "".join(rp[:b])
            if a and len(head) < 3:
                w *= 2
                continue
            new = self.split(head + tail)
            seam, stop = len(head), len(head) + len(tail)
            if b == len(rp):
                return lp[:a] + new, lc[:a] + self.codes(new)
            starts, at = {}, seam
            for i, p in enumerate(rp[:b]):
                starts[at] = i
                at += len(p)
            at = 0
            for i, p in enumerate(new):
                if at in starts:
                    k = starts[at]
                    return lp[:a] + new[:i] + rp[k:], lc[:a] + self.codes(new[:i]) + rc[k:]
                if max(at + 3, at + len(p) + 2) > stop:
                    break
                at += len(p)
            w *= 2

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.tree(text)[1]), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _ids(it: Coder, texts: pa.Array) -> pa.ListArray:
    codes = [it.encode(t) if t else np.zeros(0, np.int32) for t in texts.to_pylist()]
    ends = np.cumsum([0] + [len(c) for c in codes]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int32)))


def _bytes(it: Coder, ids: pa.ListArray) -> pa.Array:
    return pa.array([it.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in ids], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, with_decoded: bool = False) -> DataFrame:
    """docs with a column ids, array<int>: the tokens of each whole text by the ranks in path, as a narrow map; and
    with_decoded one called decoded, binary, the bytes of these ids, in the same pass.

    path must name the file on every executor. Null and empty texts have no ids; very long ones are encoded whole, as trees.
    Repeated rows stay; columns of docs already called so are replaced, others of any name stay; an empty table gives no
    rows.
    """
    docs = docs.drop("ids", *["decoded"] * with_decoded).withColumn("text", F.col("text").cast("string"))
    more = {"ids": F.lit(None).cast("array<int>")} | ({"decoded": F.lit(None).cast("binary")} if with_decoded else {})
    names = list(more)

    def run(batches):
        it = coder(path, pattern)
        for batch in batches:
            for part in blocks(batch, "text"):
                ids = _ids(it, part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *([_bytes(it, ids)] if with_decoded else [])], [*part.schema.names, *names])

    return docs.mapInArrow(run, docs.withColumns(more).schema)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """coded with a column decoded, binary: the bytes of each row's ids. Null or no ids give no bytes; an id outside
    the ranks raises KeyError, since bytes left out would go unseen. A column of coded called decoded is replaced, others of
    any name stay; an empty table gives no rows."""
    coded = coded.drop("decoded")

    def run(batches):
        it = coder(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, _bytes(it, part.column("ids"))], [*part.schema.names, "decoded"])

    return coded.mapInArrow(run, coded.withColumn("decoded", F.lit(None).cast("binary")).schema)
