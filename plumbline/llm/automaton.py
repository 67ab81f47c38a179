"""Suffix automata over words."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """The automaton of passages of words, each with the number of times that it stands in the corpus. After ``count`` a
    state knows how often its runs of words stand there. No run crosses two passages."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.following: list[dict[int, int]] = [{}]
        self.links, self.lengths, self.times = [-1], [0], [0]

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.following.append(following)
        self.links.append(link)
        self.lengths.append(length)
        self.times.append(0)
        return len(self.links) - 1

    def _split(self, at: int, c: int, old: int) -> int:
        """A state for those runs of ``old`` that are at most one word longer than those of ``at``."""
        following, links = self.following, self.links
        made = self._state(dict(following[old]), links[old], self.lengths[at] + 1)
        while at != -1 and following[at].get(c) == old:
            following[at][c] = made
            at = links[at]
        links[old] = made
        return made

    def add(self, words: list[bytes], times: int = 1) -> list[int]:
        """Add a passage; gives its words' numbers."""
        following, links, lengths, vocabulary = self.following, self.links, self.lengths, self.vocabulary
        coded = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        last = 0
        for c in coded:
            to = following[last].get(c)
            if to is None:
                state = self._state({}, 0, lengths[last] + 1)
                at = last
                while at != -1 and c not in following[at]:
                    following[at][c] = state
                    at = links[at]
                if at != -1:
                    old = following[at][c]
                    links[state] = old if lengths[at] + 1 == lengths[old] else self._split(at, c, old)
                last = state
            else:
                last = to if lengths[last] + 1 == lengths[to] else self._split(last, c, to)
            self.times[last] += times
        return coded

    def count(self) -> None:
        """Once all passages are in: a run stands wherever a longer one stands that ends with it."""
        times, links = self.times, self.links
        for state in np.argsort(-np.array(self.lengths), kind="stable").tolist()[:-1]:
            times[links[state]] += times[state]

    def repeats(self, coded: list[int], least: int) -> list[int]:
        """Where runs of ``least`` words start that stand in the corpus at least twice, from the matching statistics: for
        each word, the longest run ending there that stands there twice."""
        following, links, lengths, times = self.following, self.links, self.lengths, self.times
        found: list[int] = []
        state = length = 0
        for i, c in enumerate(coded):
            to = following[state].get(c)
            while state and (to is None or times[to] < 2):
                state = links[state]
                length = lengths[state]
                to = following[state].get(c)
            if to is None or times[to] < 2:
                length = 0
                continue
            state, length = to, length + 1
            if length >= least:
                found.append(i + 1 - least)
        return found
