"""Memoised encoding of texts whose tokenizer treats each match of a byte-level pattern separately."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The characters of the White_Space property: fixed values.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")
#: Entries of each of two generations of what is remembered, the longest piece that is, and characters of a text encoded at once.
ENTRIES, LONGEST, SLICE = 300_000, 64, 1 << 20
#: The usual pattern of byte-level vocabularies (fixed value): a letter or digit and a mark after it are always two matches.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ALONE = regex.compile(r"(?<=\P{White_Space})[ \n](?=\P{White_Space})")
_AFTER_MARK = r"[^\pL\pN" + "".join(rf"\x{{{ord(c):x}}}" for c in sorted(WHITE)) + "][,.]"
_OWN_MARKS = r"[\x{0}-\x{3}]"


class TextEncoder:
    """encode(texts): for each the ids as little-endian unsigned 32-bit integers.

    pattern must be of the kind that public byte-level vocabularies use: a run of white space never reaches into what
    follows it but for one space in front of a match. So a single space or line end between two other characters always
    parts matches, and the pieces between such places can be encoded alone and remembered, for two generations of at most
    ENTRIES pieces. A batch is cut and its pieces are numbered by Arrow; encode_matches gets each unknown match once a batch.
    Texts with other white space are matched whole.
    """

    def __init__(self, pattern: str, encode_matches: Callable[[list[str]], list[bytes]], encode_words: Callable[[list[str]], list[bytes]] | None = None):
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.make = encode_matches
        self.words = encode_words or (lambda found: encode_matches([" " + w for w in found]))  # letters after a space
        self.marks = pattern == BYTE_LEVEL
        self.known: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        cut = [self._slices(t or "") for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        flat = pa.array([x for parts in cut for x in parts], pa.large_string())
        odd = pc.match_substring_regex(flat, _OWN_MARKS).to_numpy(zero_copy_only=False)
        after = pc.match_substring_regex(flat, _AFTER_MARK).to_numpy(zero_copy_only=False) if self.marks else np.ones(len(flat), bool)
        out: list[bytes | None] = [None] * len(flat)
        for at, marks in ((np.flatnonzero(~odd & ~after), True), (np.flatnonzero(~odd & after), False)):
            if len(at):
                for i, ids in zip(at.tolist(), self._cut(flat.take(pa.array(at)), marks), strict=True):
                    out[i] = ids
        whole = [i for i, x in enumerate(out) if x is None]
        if whole:
            found = [["\3" + m for m in self.find(flat[i].as_py())] for i in whole]
            self._learn(set().union(*found))
            for i, ms in zip(whole, found, strict=True):
                out[i] = b"".join([self.known[m] for m in ms])
        if len(self.known) > ENTRIES:
            self.old, self.known = {k: v for k, v in self.known.items() if len(k) <= LONGEST}, {}
        made = iter(out)
        return [next(made) if len(parts) == 1 else b"".join([next(made) for _ in parts]) for parts in cut]

    @staticmethod
    def _slices(text: str) -> list[str]:
        out = []
        while len(text) > SLICE and (m := _ALONE.search(text, SLICE)):
            out.append(text[: m.start()])
            text = text[m.start() :]
        return [*out, text] if text else out

    def _cut(self, texts: pa.Array, marks: bool) -> list[bytes | None]:
        """ids of texts by the pieces between spaces; None: some piece cannot stand alone.

        \\0 in front of a piece: after a line end; \\1: after nothing; \\2: a mark after a letter or digit.
        """
        x = pc.replace_substring(texts, "\n", " \0")
        if marks:
            x = pc.replace_substring(pc.replace_substring(x, ",", " \2,"), ".", " \2.")
        parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\1", pa.large_string()), x, pa.scalar("", pa.large_string())), " ")
        coded = parts.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(set(pieces))
        known = [self.known[p] for p in pieces]
        made = pa.array(known, pa.large_binary()).take(coded.indices)
        edge = np.frombuffer(made.buffers()[1], np.int64)[parts.offsets.to_numpy()]
        flat = made.buffers()[2].to_pybytes() if edge[-1] else b""
        good = np.ones(len(texts), bool)
        if made.null_count:
            good = np.logical_and.reduceat(made.is_valid().to_numpy(zero_copy_only=False), parts.offsets.to_numpy()[:-1])
        return [flat[a:b] if ok else None for a, b, ok in zip(edge[:-1].tolist(), edge[1:].tolist(), good.tolist(), strict=True)]

    def _learn(self, pieces: set[str]) -> None:
        need: dict[str, list[str]] = {}
        plain: list[str] = []
        for p in pieces.difference(self.known):
            if p in self.old:
                self.known[p] = self.old[p]
            elif self.marks and p.isalpha():
                plain.append(p)
            elif (m := self._matches(p)) is None:
                self.known[p] = None
            else:
                need[p] = m
        if plain:
            self.known.update(zip(plain, self.words(plain), strict=True))
        one = list({m for ms in need.values() for m in ms})
        ids = dict(zip(one, self.make(one), strict=True)) if one else {}
        for p, ms in need.items():
            self.known[p] = ids[ms[0]] if len(ms) == 1 else b"".join([ids[m] for m in ms])

    def _matches(self, p: str) -> list[str] | None:
        mark, body = (p[0], p[1:]) if p[:1] in ("\0", "\1", "\2", "\3") else ("", p)
        if mark == "\3":
            return [body]
        if not body or body[-1] in WHITE or mark != "\1" and body[0] in WHITE:
            return None
        if mark == "\2" and len(body) == 1:
            return [body]
        if self.marks and mark == "\0" and body.isalpha():
            return ["\n", body]
        return self.find({"": " ", "\0": "\n", "\1": "", "\2": ""}[mark] + body)
