"""Byte-level BPE by ranks, with segment trees over byte positions.

A leaf holds the rank of the pair that starts at its position, tagged with the position, so the root is the
leftmost pair of least rank. A merge writes three leaves, those of its own pair, of the live neighbour before it
and of the one it swallowed, and repairs their paths to the root: a logarithmic number of steps. Short
pre-tokens are many and are merged side by side, one tree to a column of a numpy array; a long one has a tree of
its own, so even a pre-token of a whole text costs n log n.

Cases: a null or empty text has no ids; bytes decode to themselves, so the round trip gives back every text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import arrow
from rowdelta.llm.cache import Generations

BIG = 1 << 62
#: Pre-tokens up to this many bytes are merged side by side.
SIDE_BY_SIDE = 64
#: Segments that one worker keeps.
CACHE_SEGMENTS = 700_000


def ranks_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PairTable:
    """Open-addressed map from a pair of ids (under 2^31) to the id of their merge; -1 where there is none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = self._key(left, right)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, -1, np.int64)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[slot[rest]] == np.uint64(2**64 - 1)
            first = np.zeros(len(rest), bool)
            first[np.unique(slot[rest], return_index=True)[1]] = True
            put = rest[free & first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], merged[put]
            rest = rest[~(free & first)]
            slot[rest] = np.where(self.keys[slot[rest]] == keys[rest], slot[rest], (slot[rest] + 1) & self.mask)
            rest = rest[self.keys[slot[rest]] != keys[rest]]
        self.one = {}

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            out[open_] = np.where(found == keys[open_], self.values[slot[open_]], -1)
            open_ = open_[(found != keys[open_]) & (found != np.uint64(2**64 - 1))]
        return out


def side_by_side(symbols: np.ndarray, size: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Merges columns of symbols (width x n, width a power of two, size of them in use): packed ids of each. An id's order is its rank's."""
    width, n = symbols.shape
    cols = np.arange(n)
    ids = np.zeros((width + 1, n), np.int64)
    ids[:width] = symbols
    tree = np.full((2 * width, n), BIG, np.int64)
    for p in range(width - 1):
        on = np.flatnonzero(size > p + 1)
        if len(on):
            r = pairs.many(ids[p, on], ids[p + 1, on])
            tree[width + p, on] = np.where(r >= 0, (r << 8) | p, BIG)
    for k in range(width - 1, 0, -1):
        np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
    after = np.repeat(np.arange(1, width + 2)[:, None], n, 1)
    before = np.repeat(np.arange(-1, width)[:, None], n, 1)
    live = np.ones((width, n), bool) & (np.arange(width)[:, None] < size)

    def put(p: np.ndarray, c: np.ndarray, value: np.ndarray | int) -> None:
        k = width + p
        tree[k, c] = value
        for _ in range(width.bit_length() - 1):
            k = k >> 1
            tree[k, c] = np.minimum(tree[2 * k, c], tree[2 * k + 1, c])

    def pair(p: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        r = pairs.many(ids[p, c], ids[np.minimum(q, width), c])
        return np.where((q < size[c]) & (r >= 0), (r << 8) | p, BIG)

    c = cols[tree[1] < BIG]
    while len(c):
        top = tree[1, c]
        p = top & 255
        q = after[p, c]
        ids[p, c] = top >> 8
        live[q, c] = False
        nn = after[q, c]
        after[p, c] = nn
        before[np.minimum(nn, width), c] = p
        put(q, c, BIG)
        put(p, c, pair(p, nn, c))
        b = before[p, c]
        on = b >= 0
        put(b[on], c[on], pair(b[on], p[on], c[on]))
        c = c[tree[1, c] < BIG]
    stops = np.cumsum(live.sum(0)) * 4
    flat = ids[:width].T[live.T].astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]


class Ranks:
    """A vocabulary in which the id of a token is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.first = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.first < 0).any():
            raise ValueError(f"{path} lacks a single byte")
        pairs = [(self.rank[t[:k]], self.rank[t[k:]], i) for t, i in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        self.pairs = PairTable(left, right, merged)

    def encode(self, token: bytes) -> list[int]:
        """One pre-token with a tree of its own."""
        n, rank, of = len(token), self.rank, self.bytes
        ids = [self.rank[token[i : i + 1]] for i in range(n)]
        width = 1 << max(0, n - 1).bit_length()
        bits = width.bit_length()
        pair = lambda p, q: (rank[t] << bits) | p if q < n and (t := of[ids[p]] + of[ids[q]]) in rank else BIG
        tree = [BIG] * (2 * width)
        for p in range(n - 1):
            tree[width + p] = pair(p, p + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(p: int, value: int) -> None:
            k = width + p
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while width > 1 and tree[1] < BIG:
            p = tree[1] & ((1 << bits) - 1)
            q = after[p]
            ids[p] = tree[1] >> bits
            after[p] = after[q]
            if after[q] < n:
                before[after[q]] = p
            put(q, BIG)
            put(p, pair(p, after[p]))
            if before[p] >= 0:
                put(before[p], pair(before[p], p))
        out, p = [], 0
        while p < n:
            out.append(ids[p])
            p = after[p]
        return out

    def _side_by_side(self, group: list[bytes], width: int) -> list[bytes]:
        """Pre-tokens of 2 to `width` bytes, width a power of two: packed ids of each."""
        data = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in group), np.uint8).reshape(-1, width)
        return side_by_side(self.first[data].T, np.array([len(t) for t in group]), self.pairs)

    def packed(self, tokens: list[bytes]) -> dict[bytes, bytes]:
        """Packed little-endian ids of each distinct pre-token."""
        out, by_width = {}, {}
        for t in tokens:
            if t in self.rank:
                out[t] = self.rank[t].to_bytes(4, "little")
            elif len(t) <= SIDE_BY_SIDE:
                by_width.setdefault(max(2, 1 << (len(t) - 1).bit_length()), []).append(t)
            else:
                out[t] = np.array(self.encode(t), "<u4").tobytes()
        for width, group in by_width.items():
            out |= zip(group, self._side_by_side(group, width))
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class Encoder:
    """Whole texts: the pattern's matches, each encoded once while the worker's dictionary has room."""

    def __init__(self, path: str, pattern: str, most: int = CACHE_SEGMENTS):
        import regex

        self.ranks, self.pattern, self.kept = Ranks(path), regex.compile(pattern), Generations(most)
        self.unusual = regex.compile(r"[^\S \n]|\s\s|^\s|\s$")
        self.cuts = self._cuts_at_single_spaces()

    def _cuts_at_single_spaces(self) -> bool:
        """Whether the pattern always starts a match at a single space or line feed between two other characters, found by trying."""
        sides = ["a", "Z9", "é", "7", ",", "'s", "don't", "-x", "中", "́", "_"]
        for x in sides:
            for y in sides:
                for z in sides:
                    text = f"{x} {y}\n{z}"
                    want = [m for part in (x, f" {y}") for m in self.pattern.findall(part)] + ["\n"] + self.pattern.findall(z)
                    if self.pattern.findall(text) != want:
                        return False
        return True

    def segments(self, text: str) -> list[str]:
        """Parts of the text that the pattern never matches across."""
        if not self.cuts or self.unusual.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else self.pattern.findall(text)

    def packed(self, texts: list[bytes]) -> list[bytes]:
        parts = [self.segments(t.decode()) for t in texts]
        get = self.kept.holding(set().union(*parts), self._made).__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def _made(self, segments: list[str]) -> dict[str, bytes]:
        found = {s: self.pattern.findall(s) for s in segments}
        ids = self.ranks.packed([w.encode() for w in {w for ws in found.values() for w in ws}])
        return {s: b"".join([ids[w.encode()] for w in ws]) for s, ws in found.items()}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, ids (little-endian unsigned 32-bit), decoded (bytes that the ids give back)."""
    import public_tokenizers

    path, pattern = ranks or ranks_file(), pattern or public_tokenizers.PATTERN
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for part, texts in arrow.slices(batches):
            ids = coder.packed(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([coder.ranks.decode(i) for i in ids], pa.binary())], ["doc", "ids", "decoded"])

    return source.mapInArrow(run, f"doc {kind}, ids binary, decoded binary").withColumnRenamed("doc", id_col)
