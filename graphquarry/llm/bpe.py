"""Byte-level BPE encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .pretokens import TextEncoder


class Bpe:
    """Encodes byte strings with merge ranks, in time linear in their length.

    The result of merging is the only sequence of tokens in which each adjacent pair is what merging its own bytes gives.
    So: take the longest token that starts here; if it does not go with the token before, take the longest token that is
    its prefix; if none is left, the end of the token before is a dead end, which is marked and stepped back over. Each
    end is marked at most once, and whether two tokens go together is remembered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.find = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.find.add_word(token.decode("latin-1"), rank)
        self.find.make_automaton()
        self.lengths = [len(t) for t in self.tokens]
        self.goes: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.prefixes: dict[int, int] = {}

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for those that no merge made."""
        if token not in self.halves:
            parts = [self.tokens[token][i : i + 1] for i in range(self.lengths[token])]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix; -1 if there is none."""
        if token not in self.prefixes:
            t = self.tokens[token]
            self.prefixes[token] = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1)
        return self.prefixes[token]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves both as they are."""
        v = self.goes.get((a, b))
        if v is None:
            if len(self.goes) > 1_000_000:
                self.goes.clear()
            v = self.goes[a, b] = self._adjacent(a, b)
        return v

    def _adjacent(self, a: int, b: int) -> bool:
        # undo merges from the latest back; a merge across the border that ranks before the merge undone last would have come first
        until = len(self.tokens)
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < until and self.half(across) == (a, b):
                return False
            ha, hb = self.half(a), self.half(b)
            if ha is None and hb is None:
                return True
            if hb is None or ha is not None and a > b:
                until, a = a, ha[1]
            else:
                until, b = b + 1, hb[0]  # of equal ranks the left one is merged first

    def encode(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n, lengths, goes, adjacent = len(data), self.lengths, self.goes.get, self.adjacent
        longest = [0] * n
        for end, token in self.find.iter(data.decode("latin-1")):
            longest[end - lengths[token] + 1] = token  # ends come in order: the last is the longest
        out: list[int] = []
        dead, pos, before = bytearray(n + 1), 0, -1
        token = longest[0] if n else -1
        while pos < n:
            while token >= 0:
                end = pos + lengths[token]
                if not dead[end]:
                    if before < 0 or (ok := goes((before, token))) or ok is None and adjacent(before, token):
                        break
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                pos, before = end, token
                token = longest[pos] if pos < n else -1
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= lengths[token]
                before = out[-1] if out else -1
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> tuple[Bpe, TextEncoder]:
    """Of a file of base64 tokens and ranks; kept by each Python worker."""
    with open(path, "rb") as f:
        bpe = Bpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def matches(found: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (bpe.encode(m.encode("utf-8", "replace")) for m in found)]

    return bpe, TextEncoder(pattern, matches)


def encode_documents(docs: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """Every row of docs, its text replaced by `ids` (binary: little-endian unsigned 32-bit) and, if asked, `decoded` (binary).

    docs needs a column `text`; other columns pass through but for those named like a result, which it replaces. A null or
    empty text has no ids; rows that repeat are encoded alike; an empty table gives none. Texts are encoded whole, a very
    long one in slices that no match crosses. path names the ranks on every machine. Each match of pattern is encoded
    separately, without special tokens.
    """

    def body():
        bpe, text = load(path, pattern)

        def work(texts: list[str | None]):
            ids = text.encode(texts)
            return (ids, [bpe.decode(x) for x in ids]) if decode else (ids,)

        return work

    return map_texts(docs, body, "ids binary, decoded binary" if decode else "ids binary")


def decode_ids(ids: bytes, path: str, pattern: str) -> bytes:
    return load(path, pattern)[0].decode(ids)
