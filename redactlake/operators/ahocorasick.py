"""Multi-pattern matching: every occurrence of every pattern, overlapping ones too."""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick


@dataclass(frozen=True)
class Match:
    pattern: int
    start: int
    end: int


class AhoCorasick:
    """Empty patterns keep their index and never match; repeated ones are all reported."""

    def __init__(self, patterns: list[str]):
        self.patterns = list(patterns)
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[int]] = {}
        for i, p in enumerate(self.patterns):
            if p:
                at.setdefault(p, []).append(i)
        for p, where in at.items():
            self.automaton.add_word(p, (len(p), where))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(pattern, start, end) in code points, by end, the longest of an end first."""
        if self.empty:
            return []
        return [(i, end + 1 - n, end + 1) for end, (n, where) in self.automaton.iter(text) for i in where]

    def search(self, text: str) -> list[Match]:
        """Offsets in UTF-16 code units."""
        found = self.spans(text)
        if found and max(text) > "\uffff":
            units = [0]
            for ch in text:
                units.append(units[-1] + (2 if ch > "\uffff" else 1))
            found = [(p, units[s], units[e]) for p, s, e in found]
        return [Match(*f) for f in found]
