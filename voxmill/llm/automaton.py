"""Suffix automaton over word numbers, for several references in ascending order of owner."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """All substrings of the references; each state knows the least owner of its substrings.

    References are added by ascending owner, so a new state belongs to the owner at hand
    and a split state to the owner of the one it was split from.
    """

    def __init__(self) -> None:
        self.follow: list[dict[int, int]] = [{}]
        self.length = [0]
        self.link = [-1]
        self.owner: list[int] = [-1]

    def _state(self, length: int, link: int, follow: dict[int, int], owner: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.follow.append(follow)
        self.owner.append(owner)
        return len(self.length) - 1

    def add(self, words: Iterable[int], owner: int) -> None:
        follow, length, link, owners = self.follow, self.length, self.link, self.owner
        last = 0
        for w in words:
            at = follow[last].get(w)
            if at is not None and length[at] == length[last] + 1:
                last = at
                continue
            new = -1
            p = last
            if at is None:
                new = self._state(length[last] + 1, 0, {}, owner)
                while p >= 0 and w not in follow[p]:
                    follow[p][w] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                at = follow[p][w]
                if length[at] == length[p] + 1:
                    link[new] = at
                    last = new
                    continue
            split = self._state(length[p] + 1, link[at], dict(follow[at]), owners[at])
            while p >= 0 and follow[p].get(w) == at:
                follow[p][w] = split
                p = link[p]
            link[at] = split
            if new >= 0:
                link[new] = split
                last = new
            else:
                last = split

    def least_owners(self, words: list[int], n: int) -> Iterator[int | None]:
        """For each window of n words, the least owner that has it; None if nobody has.

        Streams the words once; the match never needs to be longer than n.
        """
        follow, length, link = self.follow, self.length, self.link
        at, met = 0, 0
        for k, w in enumerate(words):
            while at and w not in follow[at]:
                at = link[at]
                met = length[at]
            if w in follow[at]:
                at = follow[at][w]
                met += 1
            while length[link[at]] >= n and at:
                at = link[at]
            met = min(met, n)
            if k >= n - 1:
                yield self.owner[at] if met >= n else None
