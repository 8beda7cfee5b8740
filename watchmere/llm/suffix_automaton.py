"""A generalised suffix automaton: the substrings of several sequences as one small machine."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """States stand for sets of end places; `link` leads to the longest suffix with more end places.

    `length[s]` is the longest string of a state. `places[s]`, after `locate()`, holds (sequence, end) of all its ends.
    """

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.own: list[list[tuple[int, int]]] = [[]]
        self.places: list[tuple[tuple[int, int], ...]] = []

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.length) - 1

    def _split(self, source: int, symbol: Hashable) -> int:
        """The state of source's longest string + symbol, cut off from longer strings where it must be."""
        target = self.next[source][symbol]
        if self.length[target] == self.length[source] + 1:
            return target
        copy = self._state(self.length[source] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while source >= 0 and self.next[source].get(symbol) == target:
            self.next[source][symbol] = copy
            source = self.link[source]
        return copy

    def _append(self, last: int, symbol: Hashable) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        state = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, symbol)
        return state

    def add(self, number: int, sequence: Iterable[Hashable]) -> int:
        """Add a sequence under a number; returns the state of the whole of it."""
        state = 0
        for end, symbol in enumerate(sequence, 1):
            state = self._append(state, symbol)
            self.own[state].append((number, end))
        return state

    def locate(self) -> None:
        """Spread end places from long strings to their suffixes. Their number is that of symbols times depth."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        found: list[set[tuple[int, int]]] = [set(own) for own in self.own]
        for state in order:
            if self.link[state] > 0:
                found[self.link[state]] |= found[state]
        self.places = [tuple(sorted(f)) for f in found]

    def walk(self, state: int, matched: int, symbol: Hashable) -> tuple[int, int]:
        """One step of matching statistics: the longest suffix read so far that is a substring of the sequences."""
        moves = self.next
        while state and symbol not in moves[state]:
            state = self.link[state]
            matched = self.length[state]
        following = moves[state].get(symbol)
        return (0, 0) if following is None else (following, matched + 1)

    def statistics(self, sequence: Sequence[Hashable]) -> list[tuple[int, int]]:
        """(state, matched length) after each symbol."""
        out, state, matched = [], 0, 0
        for symbol in sequence:
            state, matched = self.walk(state, matched, symbol)
            out.append((state, matched))
        return out
