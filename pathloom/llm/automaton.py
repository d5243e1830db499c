"""A suffix automaton over word sequences with occurrence counts, and matching statistics."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of the added sequences (of hashables), each with its number of occurrences.

    Sequences are added one after another from the root, with a weight (how often the sequence
    stands in the corpus).  count() must run before occurrences are asked for.
    """

    __slots__ = ("next", "link", "length", "weight", "counted")

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]
        self.counted = False

    def add(self, sequence, weight: int = 1) -> None:
        next_, link, length, weights = self.next, self.link, self.length, self.weight
        last = 0
        for x in sequence:
            q = next_[last].get(x)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, x, q)
            else:
                cur = len(next_)
                next_.append({})
                length.append(length[last] + 1)
                link.append(0)
                weights.append(0)
                p = last
                while p != -1 and x not in next_[p]:
                    next_[p][x] = cur
                    p = link[p]
                if p != -1:
                    q = next_[p][x]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, x, q)
                last = cur
            weights[last] += weight

    def _split(self, p: int, x, q: int) -> int:
        """The state of the longest string of p followed by x, taken out of q."""
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.weight.append(0)
        self.link[q] = new
        while p != -1 and self.next[p].get(x) == q:
            self.next[p][x] = new
            p = self.link[p]
        return new

    def count(self) -> None:
        """Adds up occurrences along the suffix links, longest states first."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                self.weight[self.link[s]] += self.weight[s]
        self.counted = True

    def matches(self, sequence, least: int):
        """(end, occurrences) of each run of exactly least items of sequence that occurs here.

        The scan keeps the matching statistic, the longest suffix of what was read that occurs.
        """
        next_, link, length, weight = self.next, self.link, self.length, self.weight
        state = size = 0
        for i, x in enumerate(sequence):
            while state and x not in next_[state]:
                state = link[state]
                size = length[state]
            to = next_[state].get(x)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            while length[link[state]] >= least:
                state = link[state]
                size = length[state]
            if size >= least:
                yield i + 1, weight[state]
