"""Minimal acyclic acceptors of sorted word lists, and their composition with a one-edit transducer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words.

    A state is a number; states come after the states that they lead to. arcs[p] maps a code point to the next state and
    to the number of words of p that sort before those behind this arc, so that a path adds up to its word's place.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []
        self.shortest: list[int] = []
        self.longest: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[list] = [[False, [], []]]  # the last word's path: final, characters, frozen targets
        last = ""
        for word in words:
            same = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                same += 1
            self._freeze(open_, same, known)
            for c in word[same:]:
                open_[-1][1].append(c)
                open_.append([False, [], []])
            open_[-1][0] = True
            last = word
        self._freeze(open_, 0, known)
        self.start = self._state(open_[0], known)

    def _freeze(self, path: list[list], depth: int, known: dict[tuple, int]) -> None:
        while len(path) > depth + 1:
            done = self._state(path.pop(), known)
            path[-1][2].append(done)

    def _state(self, node: list, known: dict[tuple, int]) -> int:
        key = (node[0], "".join(node[1]), tuple(node[2]))
        found = known.get(key)
        if found is None:
            found = known[key] = len(self.final)
            before = int(node[0])
            arcs = {}
            for c, t in zip(node[1], node[2]):
                arcs[c] = (t, before)
                before += self.count[t]
            self.final.append(node[0])
            self.arcs.append(arcs)
            self.count.append(before)
            self.shortest.append(0 if node[0] else 1 + min((self.shortest[t] for t in node[2]), default=0))
            self.longest.append(1 + max((self.longest[t] for t in node[2]), default=-1))
        return found

    def _common(self, todo: list[tuple[int, int, int, int]], left: list[int], right: list[int]) -> None:
        """Adds the places of each word that two states share; todo: state, state, places to add to."""
        arcs, final, count = self.arcs, self.final, self.count
        while todo:
            p, q, i, j = todo.pop()
            if p == q:
                left += range(i, i + count[p])
                right += range(j, j + count[p])
                continue
            if self.longest[p] < self.shortest[q] or self.longest[q] < self.shortest[p]:
                continue
            if final[p] and final[q]:
                left.append(i)
                right.append(j)
            a, b = arcs[p], arcs[q]
            if len(a) > len(b):
                for c, (t, o) in b.items():
                    if c in a:
                        s, n = a[c]
                        todo.append((s, t, i + n, j + o))
            else:
                for c, (s, n) in a.items():
                    if c in b:
                        t, o = b[c]
                        todo.append((s, t, i + n, j + o))

    def edits_at(self, p: int) -> tuple[list[int], list[int]]:
        """Pairs of places, relative to p, of words of p whose first difference is the edit at p itself.

        These are the composed machine's states behind its one edit: two arcs of p replace each other, or one arc is
        taken by the left word alone, and then both words go on alike. A left word's inserted code point differs from the
        right word's next one, so that each pair is found at one state only.
        """
        left: list[int] = []
        right: list[int] = []
        arcs = self.arcs[p]
        steps = list(arcs.items())
        todo = []
        for k, (c, (t, o)) in enumerate(steps):
            todo += [(t, s, o, n) for _, (s, n) in steps[:k]]
            if self.final[p] and self.final[t]:
                left.append(o)
                right.append(0)
            for d, (s, n) in self.arcs[t].items():
                if d != c and d in arcs:
                    u, m = arcs[d]
                    todo.append((s, u, o + n, m))
        self._common(todo, left, right)
        return left, right

    def one_edit_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all pairs of words that one edit apart, each pair once, in arrays per state where the edit falls."""
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        useful = [False] * len(self.final)
        for p in range(len(self.final)):
            if self.count[p] > 1:
                left, right = self.edits_at(p)
                if left:
                    found[p] = np.array(left), np.array(right)
                useful[p] = bool(left) or any(useful[t] for t, _ in self.arcs[p].values())
        paths: dict[int, list[int]] = {self.start: [0]}  # the places that the paths to a state have added up to
        for p in range(len(self.final) - 1, -1, -1):
            held = paths.pop(p, None)
            if held is None or not useful[p]:
                continue
            for t, o in self.arcs[p].values():
                if useful[t]:
                    paths.setdefault(t, []).extend([x + o for x in held])
            if p in found:
                left, right = found[p]
                per = max(1, 1_000_000 // len(left))
                for a in range(0, len(held), per):
                    some = np.array(held[a : a + per])[:, None]
                    yield (some + left).ravel(), (some + right).ravel()
