"""Word-piece tokenisation for optional neural encoders."""

from __future__ import annotations

import re
import unicodedata

from .analysis import HAN


class WordPieces:
    def __init__(self, lines) -> None:
        self.ids: dict[str, int] = {}
        for line in lines:
            if line.strip():
                self.ids.setdefault(line.strip(), len(self.ids))
        if "[UNK]" not in self.ids:
            raise ValueError("the vocabulary has no [UNK]")

    @staticmethod
    def basic(text: str) -> list[str]:
        """Han characters and punctuation alone; other runs lower-cased."""
        out, run = [], ""
        for c in text:
            alone = re.match(f"[{HAN}]", c) or unicodedata.category(c)[0] in "PS"
            if alone or c.isspace():
                if run:
                    out.append(run.lower())
                run = ""
                if alone:
                    out.append(c)
            else:
                run += c
        return [*out, run.lower()] if run else out

    def pieces(self, word: str) -> list[str]:
        """Greedy longest pieces; a word that has an unknown piece is dropped."""
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.ids:
                    break
            else:
                return []
            out.append(piece)
            at = end
        return out

    def encode(self, text: str, most: int = 512) -> tuple[list[int], list[int]]:
        """(ids, mask) with [CLS] and [SEP]."""
        found = [p for w in self.basic(text) for p in self.pieces(w)][: most - 2]
        ids = [self.ids.get(x, self.ids["[UNK]"]) for x in ("[CLS]", *found, "[SEP]")]
        return ids, [1] * len(ids)
