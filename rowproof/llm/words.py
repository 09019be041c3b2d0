"""Encoding with a public tokenizer file, one distinct chunk of text at a time.

A chunk is text between spaces, tabs and line ends. A tokenizer that drops white space and never lets a token cross
it gives a text the ids of its chunks in order; other white space (as U+00A0) stays inside a chunk and is left to the
library. A tokenizer of another kind gets whole texts.

Most chunks are Latin letters and then perhaps ASCII punctuation. Those are two pieces for the tokenizer, which its
normaliser only lower-cases, so they go to the library's BPE model directly; every other chunk takes the library's
whole way. Tests compare both with the library on whole texts.
"""

from __future__ import annotations

import json
import re
import struct

#: Chunks a Python worker remembers at most, and the longest it remembers.
REMEMBERED, LONGEST = 450_000, 32
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"([{_LETTERS}]*)([!-/:-@\[-`{{-~]*)")
#: Texts whose lower case the library finds letter by letter as Python does (Latin, without U+0130).
_NOT_PLAIN = re.compile("[^\\x00-\\u012f\\u0131-\\u024f]|<\\|")


def chunks(text: str) -> list[str]:
    """Chunks of a text; there may be empty ones among them."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def folded(text: str) -> str:
    """The text in lower case where that changes no id, so that fewer chunks are distinct."""
    return text if _NOT_PLAIN.search(text) else text.lower()


def load(path: str):
    """The library's tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder(dict):
    """From a chunk to its ids as little-endian unsigned 32-bit integers.

    Words and signs are remembered apart from the chunks that they make, as one word comes with many signs. A
    tokenizer that joins what white space parts, or keeps cases apart, has the whole text go to the library.
    """

    def __init__(self, path: str, lowers: bool = True):
        super().__init__({"": b""})
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.parts = self._parts()
        self.fits = lowers and self.parts and self._probe()

    def _parts(self) -> bool:
        """Are the ids of a text those of its chunks, in either case? By the kind of tokenizer, and by trial."""
        kinds = json.loads(self.tokenizer.to_str())
        before = kinds["pre_tokenizer"] or {}
        first = (before.get("pretokenizers") or [before])[0]
        if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
            return False
        tries = ["Two Words", " lead  and\n\ntrail \t", "It's 12,5% -- don't!", "(a) b\u00a0c\r\nd", "ÉTÉ straße\tİx", "x\x0by .. ,, 漢字 かな"]
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return all(plain(t) == [i for c in chunks(folded(t)) if c for i in plain(c)] for t in tries)

    def _probe(self) -> bool:
        """Learn from the library how a letter looks to the BPE model, and whether the short way holds for it."""
        signs = [chr(c) for c in range(33, 256) if re.fullmatch(rf"[{_LETTERS}!-/:-@\[-`{{-~]", chr(c))]
        seen = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c)) if self.tokenizer.normalizer and self.tokenizer.pre_tokenizer else [] for c in signs}
        if not all(len(x) == 1 for x in seen.values()):
            return False
        self.looks = {ord(c): x[0][0] for c, x in seen.items()}
        tries = ["Word,", "ÉTÉ?!", "a", "...", "ßü--", "straße)", "Zz_"]
        return all(self._short(*_SIMPLE.fullmatch(t).groups()) == self.tokenizer.encode(t, add_special_tokens=False).ids for t in tries)

    def _short(self, letters: str, signs: str) -> list[int]:
        return [t.id for piece in (letters, signs) if piece for t in self.model.tokenize(piece.translate(self.looks))]

    def ids(self, chunk: str) -> list[int]:
        m = _SIMPLE.fullmatch(chunk) if self.fits else None
        return self._short(*m.groups()) if m else self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def __missing__(self, chunk: str) -> bytes:
        m = _SIMPLE.fullmatch(chunk) if self.fits else None
        if m is None:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(ids)}I", *ids)
        elif m[1] and m[2]:
            ids = self[m[1]] + self[m[2]]
        else:
            ids = self.model.tokenize(chunk.translate(self.looks))
            ids = struct.pack(f"<{len(ids)}I", *[t.id for t in ids])
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
                self[""] = b""
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.parts:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, chunks(folded(text))))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
