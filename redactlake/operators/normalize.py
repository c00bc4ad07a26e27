"""Text folded for keyword matching, with a way back to the original offsets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# Characters that are passed over, white space first.
WHITE_SPACE = "\t\n\x0b\x0c\r \xa0                　﻿"
ZERO_WIDTH = "​‌‍‎‏⁠﻿"
ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
OTHER_MARKS = "·•‧∙、，。！？；：…—～「」『』（）《》【】〈〉“”‘’"
DEFAULT_IGNORE = frozenset(WHITE_SPACE + ZERO_WIDTH + ASCII_MARKS + OTHER_MARKS)


@dataclass(frozen=True)
class Normalized:
    """starts and ends: of each UTF-16 unit of text, where its character began and ended in the original."""

    text: str
    starts: list[int]
    ends: list[int]


@dataclass
class Normalizer:
    """Per code point: NFKC, lower case, char_map (whose values may have several characters); then a value in which
    ignore finds something is dropped. ignore: characters, a pattern that is searched for, a test, or None for nothing."""

    nfkc: bool = True
    lowercase: bool = True
    ignore: frozenset[str] | re.Pattern | Callable[[str], bool] | None = DEFAULT_IGNORE
    char_map: dict[str, str] = field(default_factory=dict)

    UNKNOWN, DROPPED, SEVERAL = -1, -2, -3

    def __post_init__(self):
        fold = self._fold

        class Table(dict):
            def __missing__(self, code: int) -> str:
                self[code] = made = fold(chr(code))
                return made

        self.table = Table()
        #: By code point: the one it becomes, DROPPED, SEVERAL or (not looked up yet) UNKNOWN.
        self.single = np.full(0x110000, self.UNKNOWN, "i4")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "single")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _fold(self, ch: str) -> str:
        piece = unicodedata.normalize("NFKC", ch) if self.nfkc else ch
        piece = piece.lower() if self.lowercase else piece
        mapped = (self.char_map.get(c, c) for c in piece)
        if self.ignore is None:
            return "".join(mapped)
        if isinstance(self.ignore, re.Pattern):
            drop = self.ignore.search
        elif callable(self.ignore):
            drop = self.ignore
        else:
            drop = lambda m: not self.ignore.isdisjoint(m)
        return "".join(m for m in mapped if not drop(m))

    def text(self, s: str) -> str:
        return s.translate(self.table)

    def folded(self, s: str) -> tuple[str, np.ndarray]:
        """The folded text and, for each of its code points, the code point of s that it comes from."""
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<i4")
        made = self.single[codes]
        if (made == self.UNKNOWN).any():
            for c in np.unique(codes[made == self.UNKNOWN]).tolist():
                f = self.table[c]
                self.single[c] = ord(f) if len(f) == 1 else self.SEVERAL if f else self.DROPPED
            made = self.single[codes]
        if (made == self.SEVERAL).any():
            return self.text(s), np.repeat(np.arange(len(codes)), [len(self.table[c]) for c in codes.tolist()])
        kept = np.flatnonzero(made >= 0)
        return made[kept].astype("<i4").tobytes().decode("utf-32-le", "surrogatepass"), kept

    def __call__(self, s: str) -> Normalized:
        wide = lambda c: 2 if c > "\uffff" else 1
        starts, ends, at = [], [], 0
        for ch in s:
            n = wide(ch)
            for c in self.table[ord(ch)]:
                starts += [at] * wide(c)
                ends += [at + n] * wide(c)
            at += n
        return Normalized(self.text(s), starts, ends)
