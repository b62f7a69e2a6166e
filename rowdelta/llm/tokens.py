"""Exact token ids of a `tokenizers` vocabulary at word-cache speed.

Vocabularies whose pre-tokenizer drops white space give the ids of a text as the concatenation of the ids of its
pieces between ASCII white space. `PieceEncoder` keeps a bounded dictionary from piece to packed ids, so common
pieces cost one lookup. Of the rest, Latin words, with a punctuation mark at most, are merged side by side from the
vocabulary's own merge list where its layout allows (`_Words`); the library encodes other words many at a time in one
call, and pieces with anything unusual (specials, digits, inner punctuation) by themselves.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np

from rowdelta.llm import cache
from rowdelta.llm.bpe import PairTable, side_by_side
from rowdelta.llm.cache import Generations

#: Pieces that one worker keeps.
CACHE_PIECES = 700_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Longest word, in bytes, that is merged side by side, and the characters below which case and composition are plain.
LONGEST, PLAIN = 64, "\u0250"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class _Words:
    """Merges of a byte-level vocabulary with word ends that numbers its merges in order; None from load() for any other."""

    @classmethod
    def load(cls, path: str) -> "_Words | None":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec.get("normalizer") or {}).get("normalizers", [])
        layout = (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("continuing_subword_prefix"), bool(model.get("ignore_merges")), [x["type"] for x in steps])
        if layout != ("BPE", "</w>", None, None, False, ["NFC", "Replace", "Lowercase"]):
            return None
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merged = [vocab.get(a + b) for a, b in merges]
        letters = byte_letters()
        if None in merged or merged != sorted(set(merged)) or any(x not in vocab or f"{x}</w>" not in vocab for x in letters):
            return None
        out = cls()
        out.inner, out.last = (np.array([vocab[x + end] for x in letters], np.int64) for end in ("", "</w>"))
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        out.pairs = PairTable(left, right, np.array(merged, np.int64))
        return out

    def packed(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Lower-case words of at most LONGEST bytes."""
        by_width: dict[int, list[bytes]] = {}
        for w in words:
            by_width.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(w)
        out = {}
        for width, group in by_width.items():
            size = np.array([len(w) for w in group])
            data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in group), np.uint8).reshape(-1, width)
            symbols = self.inner[data].T.copy()
            at = np.arange(len(group))
            symbols[size - 1, at] = self.last[data[at, size - 1]]
            out |= zip(group, side_by_side(symbols, size, self.pairs))
        return out


class PieceEncoder:
    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kept = Generations(most)
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.splits = self._drops_space()
        self.last = np.zeros(max(vocab.values(), default=0) + 1 + len(self.library.get_added_tokens_decoder()) + 8, bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
        self.by_words = self.splits and bool(self.last.any())
        self.words = _Words.load(path) if self.by_words else None
        self.marks = {ord(m): self._alone([m.encode()])[0] for m in ",.;:!?"} if self.words else {}

    def _drops_space(self) -> bool:
        """Whether white space only separates, found by what the library does with it."""
        ids = lambda x: self.library.encode(x, add_special_tokens=False).ids
        probe = ["ab", "zq,", "x'll", "é", "7"]
        want = [i for x in probe for i in ids(x)]
        return all(ids(sep.join(probe)) == want for sep in (" ", "\n", "\t", "  ", " \r\n", "\x0b", "\x0c")) and ids(" ") == []

    def _alone(self, pieces: list[bytes]) -> list[bytes]:
        got = self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def _missing(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        plain, odd, ends = [], [], []
        out: dict[bytes, bytes] = {}
        if self.words:
            pieces = self._latin(pieces, out)
        if self.by_words:
            for p in pieces:
                s = p.decode()
                if s.isalpha():
                    plain.append(p)
                    ends.append(1)
                elif s[-1] in ",.;:!?" and s[:-1].isalpha():
                    plain.append(p)
                    ends.append(2)
                else:
                    odd.append(p)
        else:
            odd = pieces
        for i in range(0, len(plain), 2000):
            some, n = plain[i : i + 2000], np.cumsum(ends[i : i + 2000])
            ids = np.array(self.library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) != n[-1]:
                odd += some
                continue
            cuts, data = [0, *(stops[n - 1] * 4).tolist()], ids.tobytes()
            out |= {p: data[a:b] for p, a, b in zip(some, cuts, cuts[1:])}
        if odd:
            out |= zip(odd, self._alone(odd))
        return out

    def _latin(self, pieces: list[bytes], out: dict[bytes, bytes]) -> list[bytes]:
        """Puts the ids of Latin words, and of those with a mark behind, into out; returns the other pieces."""
        bare, marked, rest = [], [], []
        for p in pieces:
            if len(p) > LONGEST:
                rest.append(p)
            elif p.isalpha():  # of bytes: ASCII letters
                bare.append(p)
            elif p[-1] in self.marks and p[:-1].isalpha():
                marked.append(p)
            elif p.isascii():
                rest.append(p)
            else:
                mark = p[-1] in self.marks
                s = (p[:-1] if mark else p).decode()
                if s.isalpha() and max(s) < PLAIN and "\u0130" not in s and unicodedata.is_normalized("NFC", s):
                    (marked if mark else bare).append(p)
                else:
                    rest.append(p)
        low = lambda p: p.lower() if p.isascii() else p.decode().lower().encode()
        words, stems = [low(p) for p in bare], [low(p[:-1]) for p in marked]
        ids = self.words.packed(list({*words, *stems}))
        out.update(zip(bare, map(ids.__getitem__, words)))
        out.update((p, ids[w] + self.marks[p[-1]]) for p, w in zip(marked, stems))
        return rest

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.splits:
            return self._alone(texts)
        words = [t.split() for t in texts]
        get = self.kept.holding(set().union(*words), self._missing).__getitem__
        return [b"".join(map(get, ws)) for ws in words]


def encoder(path: str, most: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder for each worker process, so its dictionary outlives a task."""
    return cache.kept(("pieces", path, most), lambda: PieceEncoder(path, most))
