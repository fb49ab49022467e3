"""Exact ids of the two public BPE files at a few times the tokenizers library's speed.

The vocabulary is read from the tokenizers file. Merging is done by tiktoken's rank-merging core, which gives the same
ids (a token's id follows its merge's place in both files) without the library's per-token bookkeeping. Texts with
characters on which the two libraries' notions of white space, letters or lower case could differ go through the
tokenizers library itself, so every text has the library's ids. The tests compare both ways.

For the file with word ends, the last byte of a word is another symbol than the same byte elsewhere: a text is
rewritten as one letter for each (byte, is last) pair, ASCII pairs as one-byte letters, and merged as such.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cached_property

import numpy as np

#: White space or lower-casing on which libraries differ.
ODD = re.compile("[\x00\x1c-\x1f\x7f\x85᠎​-‏⁠﻿İſKÅΩ]")


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Exact:
    """The tokenizers library's own encoding, loaded when a text asks for it."""

    path: str

    @cached_property
    def tokenizer(self):
        return _load(self.path)


class ByteEncoder(_Exact):
    """The byte-level file."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path, letters, model = path, _byte_letters(), json.load(open(path))
        special = {x["content"] for x in model["added_tokens"]}
        vocab = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """uint16 ids of the text."""
        if ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.array(self.core.encode_ordinary(text), np.uint16)


class WordEncoder(_Exact):
    """The file with word ends and lower case."""

    SPACE, LETTER, DIGIT, OTHER = range(4)

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, letters, model = path, _byte_letters(), json.load(open(path))["model"]
        # one-byte letters for the pairs of printable ASCII after lower-casing, two-byte letters for the others
        pairs = [(b, False) for b in range(33, 127) if not 65 <= b <= 90 and not 48 <= b <= 57] + [(b, True) for b in range(33, 127) if not 65 <= b <= 90]
        self.symbol = np.zeros((2, 256), np.uint16)
        for at, (b, last) in enumerate(pairs):
            self.symbol[int(last), b] = at
        assert len(pairs) <= 128
        for b in range(256):
            for last in (0, 1):
                if (b, bool(last)) not in pairs:
                    self.symbol[last, b] = 0x100 + 2 * b + last
        text_of = lambda bs, last: "".join(chr(self.symbol[int(last and i == len(bs) - 1), b]) for i, b in enumerate(bs))
        vocab, merges = model["vocab"], model["merges"]
        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def add(token: str) -> None:
            last = token.endswith("</w>")
            key = text_of([letters[c] for c in (token[:-4] if last else token)], last).encode()
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab[token])

        singles = [x + end for x in letters for end in ("", "</w>") if x + end in vocab]
        for token in singles:
            add(token)
        for pair in merges:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            add(a + b)
        for b in range(256):  # halves of two-byte letters are never left over
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = len(ids)
                ids.append(0)
        self.ids = np.array(ids, np.uint16)
        last = "".join(re.escape(chr(self.symbol[1, b])) for b in range(256))
        self.core = tiktoken.Encoding("own", pat_str=f"[^{last}]*[{last}]", mergeable_ranks=ranks, special_tokens={})
        self.kind = np.full(256, self.OTHER, np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = self.SPACE
        self.kind[97:123], self.kind[48:58], self.kind[128:] = self.LETTER, self.DIGIT, self.LETTER
        self.known: dict[str, bool] = {}

    def plain(self, c: str) -> bool:
        """Is this character one byte of ASCII, or a letter that stays itself when composed and lower-cased?"""
        if c not in self.known:
            self.known[c] = c.isascii() or unicodedata.category(c) in ("Ll", "Lu", "Lo") and len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c) and c.lower().upper() == c.upper() and unicodedata.category(c.lower()) in ("Ll", "Lo")
        return self.known[c]

    def encode(self, text: str) -> np.ndarray:
        """uint16 ids of the text."""
        if ODD.search(text) or "'" in text or "Σ" in text or not (text.isascii() or all(map(self.plain, set(text)))):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
        data = np.frombuffer(text.lower().encode(), np.uint8)
        if not len(data):
            return np.empty(0, np.uint16)
        kind = self.kind[data]
        last = np.ones(len(data), np.uint8)
        np.not_equal(kind[1:], kind[:-1], out=last[:-1], casting="unsafe")
        last |= kind == self.DIGIT
        letters = self.symbol[last, data][kind != self.SPACE]
        return self.ids[self.core.encode_ordinary(letters.astype("<u2").tobytes().decode("utf-16-le"))]


_encoders: dict[tuple[str, str], ByteEncoder | WordEncoder] = {}


def encoder(kind: str, path: str) -> ByteEncoder | WordEncoder:
    """This worker's encoder of the file at path; kind: byte or word."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = {"byte": ByteEncoder, "word": WordEncoder}[kind](path)
    return _encoders[kind, path]


def vocabulary(name: str) -> str:
    """The place of one of the public vocabulary files."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
