"""Byte automata: regular expressions to one minimal transition array.

Python's own parser reads the expressions (literals, classes, groups, alternation, repeats); Thompson's construction,
subset construction and Moore's minimisation do the rest, over classes of bytes that no expression tells apart.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

ALL = (1 << 256) - 1


def _both_cases(mask: int) -> int:
    for a in range(26):
        up, low = 1 << (65 + a), 1 << (97 + a)
        if mask & (up | low):
            mask |= up | low
    return mask


class _Nfa:
    def __init__(self, fold: bool):
        self.moves: list[list[tuple[int, int]]] = []  # state -> (set of bytes as a mask, target)
        self.free: list[list[int]] = []
        self.fold = fold

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _mask(self, items: list) -> int:
        mask, negate = 0, False
        for kind, arg in items:
            if kind is op.NEGATE:
                negate = True
            elif kind is op.LITERAL:
                mask |= 1 << arg
            elif kind is op.RANGE:
                mask |= (1 << (arg[1] + 1)) - (1 << arg[0])
            else:
                raise ValueError(f"class item {kind} isn't supported")
        mask = _both_cases(mask) if self.fold else mask
        return ALL & ~mask if negate else mask

    def add(self, tree, at: int, backwards: bool) -> int:
        """Adds the parsed expression from state ``at`` on; returns the state behind it."""
        for kind, arg in reversed(list(tree)) if backwards else list(tree):
            if kind in (op.LITERAL, op.IN, op.ANY, op.NOT_LITERAL):
                mask = ALL & ~(1 << 10) if kind is op.ANY else self._mask(arg if kind is op.IN else [(op.LITERAL, arg)])
                mask = ALL & ~mask if kind is op.NOT_LITERAL else mask
                to = self.state()
                self.moves[at].append((mask, to))
                at = to
            elif kind is op.SUBPATTERN:
                at = self.add(arg[-1], at, backwards)
            elif kind is op.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    begin = self.state()
                    self.free[at].append(begin)
                    self.free[self.add(branch, begin, backwards)].append(end)
                at = end
            elif kind is op.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, backwards)
                if high is op.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.free[at].append(loop)
                    self.free[loop].append(end)
                    self.free[self.add(body, loop, backwards)].append(loop)
                    at = end
                else:
                    end = self.state()
                    self.free[at].append(end)
                    for _ in range(high - low):
                        at = self.add(body, at, backwards)
                        self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"{kind} isn't supported")
        return at

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """``step[state + class]`` over ``data.translate(classes)``; states are multiples of ``width``.

    States from ``accepting`` on accept; ``rules[state]`` is the tuple of expressions that end there; ``dead`` is the
    state that nothing leaves, or -1.
    """

    def __init__(self, patterns: list[tuple[str, bool]], anywhere: bool, backwards: bool = False):
        """patterns: (expression, ignore ASCII case); anywhere: matches may begin at any byte."""
        nfa = _Nfa(False)
        start, ends = nfa.state(), {}
        if anywhere:
            nfa.moves[start].append((ALL, start))
        for k, (text, fold) in enumerate(patterns):
            nfa.fold = fold
            begin = nfa.state()
            nfa.free[start].append(begin)
            ends[nfa.add(parser.parse(text), begin, backwards)] = k
        masks = list({mask for moves in nfa.moves for mask, _ in moves})
        of_byte = [tuple(mask >> b & 1 for mask in masks) for b in range(256)]
        kinds = {sign: k for k, sign in enumerate(dict.fromkeys(of_byte))}
        self.classes = bytes(kinds[s] for s in of_byte)
        sample = [next(b for b in range(256) if self.classes[b] == k) for k in range(len(kinds))]

        first = nfa.closed({start})
        number, table, todo = {first: 0}, [], [first]
        for states in todo:  # grows while it runs
            row = []
            for b in sample:
                to = nfa.closed({t for s in states for mask, t in nfa.moves[s] if mask >> b & 1})
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        accepts = [tuple(sorted(ends[s] for s in states if s in ends)) for states in todo]
        table, accepts, begin = self._minimal(table, accepts)
        order = sorted(range(len(table)), key=lambda s: (bool(accepts[s]), s != begin, s))
        place = {s: i for i, s in enumerate(order)}
        self.width = len(kinds)
        self.start = place[begin] * self.width
        self.step = [place[to] * self.width for s in order for to in table[s]]
        self.rules = {place[s] * self.width: accepts[s] for s in order if accepts[s]}
        self.accepting = min(self.rules, default=len(order) * self.width)
        self.dead = next((place[s] * self.width for s in order if not accepts[s] and all(to == s for to in table[s])), -1)

    @staticmethod
    def _minimal(table: list[list[int]], accepts: list[tuple]) -> tuple[list[list[int]], list[tuple], int]:
        """Moore: split by what is accepted, then by where each class of bytes leads, until nothing splits."""
        group, n = accepts, 0
        while True:
            signs: dict = {}
            new = [signs.setdefault((group[s], tuple(group[t] for t in table[s])), len(signs)) for s in range(len(table))]
            if len(signs) == n:
                break
            group, n = new, len(signs)
        head = {}
        for s, g in enumerate(group):
            head.setdefault(g, s)
        return [[group[t] for t in table[head[g]]] for g in range(n)], [accepts[head[g]] for g in range(n)], group[0]

    def last(self, data: bytes, at: int, step: int, stop: int) -> int:
        """Where the longest match from ``at`` on ends (``step`` -1: its start, going back to ``stop``); -1 if none.

        ``data`` is already translated to classes.
        """
        s, found, table = self.start, -1, self.step
        if s >= self.accepting:
            found = at
        while at != stop:
            s = table[s + (data[at] if step > 0 else data[at - 1])]
            at += step
            if s >= self.accepting:
                found = at
            elif s == self.dead:
                break
        return found
