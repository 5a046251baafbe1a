"""Regexes to minimal byte automata.

A rule is parsed with the standard library's regex parser, turned into an NFA over bytes with
prioritised branches, and determinised by subset construction on *ordered* NFA state lists, which
keeps leftmost-greedy semantics: once a list reaches acceptance, every later (lower-priority)
thread is cut, the one that would start a new match included. The search automata of all rules run
in lockstep as one product automaton, minimised by partition refinement, so a single transition
per byte serves every rule.
"""

from __future__ import annotations

import re

import numpy as np

PARSER = re._parser
OPS = re._constants


class Nfa:
    """States hold ('bytes', frozenset, next), ('split', [next...]) or ('accept',)."""

    def __init__(self) -> None:
        self.states: list[tuple] = []

    def add(self, *state) -> int:
        self.states.append(state)
        return len(self.states) - 1

    def closure(self, start: int, seen: set[int], out: list[int]) -> None:
        todo = [start]
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            kind = self.states[s]
            if kind[0] == "split":
                todo.extend(reversed(kind[1]))
            else:
                out.append(s)


def _chars(node, fold: bool) -> frozenset[int]:
    op, arg = node
    if op is OPS.LITERAL:
        found = {arg}
    elif op is OPS.IN:
        found = set()
        for kind, value in arg:
            if kind is OPS.RANGE:
                found.update(range(value[0], value[1] + 1))
            elif kind is OPS.LITERAL:
                found.add(value)
            else:
                raise ValueError(f"unsupported class part {kind}")
    else:
        raise ValueError(f"unsupported regex part {op}")
    if max(found) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        found |= {ord(c) for b in list(found) for c in (chr(b).lower(), chr(b).upper())}
    return frozenset(found)


def _build(nfa: Nfa, nodes, after: int, fold: bool, backwards: bool) -> int:
    """Compiles a sequence so that it continues at `after`; returns its entry state."""
    for node in nodes if backwards else reversed(list(nodes)):
        op, arg = node
        if op is OPS.SUBPATTERN:
            after = _build(nfa, arg[3], after, fold or bool(arg[1] & re.IGNORECASE), backwards)
        elif op is OPS.BRANCH:
            after = nfa.add("split", [_build(nfa, x, after, fold, backwards) for x in arg[1]])
        elif op is OPS.MAX_REPEAT:
            least, most, body = arg
            if most is OPS.MAXREPEAT:
                loop = nfa.add("split", None)
                entry = _build(nfa, body, loop, fold, backwards)
                nfa.states[loop] = ("split", [entry, after])
                after = loop
            else:
                for _ in range(most - least):
                    after = nfa.add("split", [_build(nfa, body, after, fold, backwards), after])
            for _ in range(least):
                after = _build(nfa, body, after, fold, backwards)
        else:
            after = nfa.add("bytes", _chars(node, fold), after)
    return after


def _nfa(pattern: str, fold: bool, backwards: bool) -> tuple[Nfa, int, int]:
    nfa = Nfa()
    end = nfa.add("accept")
    return nfa, _build(nfa, PARSER.parse(pattern), end, fold, backwards), end


class Search:
    """Lazy ordered-subset automaton of one rule's unanchored search."""

    def __init__(self, pattern: str, fold: bool) -> None:
        self.nfa, self.entry, self.end = _nfa(pattern, fold, False)
        self.start = self._list([], True)
        if self.end in self.start:
            raise ValueError("a rule must not match the empty string")
        self.alphabet = [s[1] for s in self.nfa.states if s[0] == "bytes"]
        self.memo: dict = {}

    def _list(self, threads: list[int], restart: bool) -> tuple:
        seen, out = set(), []
        for t in threads:
            self.nfa.closure(t, seen, out)
        if self.end in out:
            return tuple(out[: out.index(self.end) + 1])
        if restart:
            self.nfa.closure(self.entry, seen, out)
        return tuple(out)

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next list, and whether a match ended just before this byte."""
        key = (state, byte)
        if key not in self.memo:
            threads = [s[2] for s in map(self.nfa.states.__getitem__, state) if s[0] == "bytes" and byte in s[1]]
            if state and state[-1] == self.end:
                if threads:
                    to = self._list(threads, False)
                    if to[-1] != self.end:
                        raise ValueError("a rule must accept again at every byte once it has accepted")
                    self.memo[key] = (to, False)
                else:
                    self.memo[key] = (self.step(self.start, byte)[0], True)
            else:
                self.memo[key] = (self._list(threads, True), False)
        return self.memo[key]

    def accepts(self, state: tuple) -> bool:
        return bool(state) and state[-1] == self.end


def backwards(pattern: str, fold: bool) -> tuple[list[list[int]], list[bool]]:
    """An anchored automaton of the reversed rule: transition rows (-1: dead) and acceptance."""
    nfa, entry, end = _nfa(pattern, fold, True)

    def closed(states) -> frozenset:
        seen, out = set(), []
        for s in states:
            nfa.closure(s, seen, out)
        return frozenset(out)

    start = closed([entry])
    ids, todo, rows, final = {start: 0}, [start], [], []
    while todo:
        state = todo.pop(0)
        row = [-1] * 256
        for byte in set().union(*(nfa.states[s][1] for s in state if nfa.states[s][0] == "bytes"), set()):
            to = closed(nfa.states[s][2] for s in state if nfa.states[s][0] == "bytes" and byte in nfa.states[s][1])
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row[byte] = ids[to]
        rows.append(row)
        final.append(end in state)
    return rows, final


def combined(rules: list[tuple[str, bool]]) -> tuple[list[int], list[tuple[int, int]], list[int]]:
    """One minimal automaton for all (pattern, fold) rules.

    Returns (table, events, final). table[state + byte] is the next state (states are multiples of
    256; the start is 0) or, if negative, ~i of events[i] = (next state, mask of the rules whose
    match ended just before the byte). final[state >> 8] is the mask of rules whose match ends if
    the text ends there.
    """
    searches = [Search(*rule) for rule in rules]
    sets = {x for s in searches for x in s.alphabet}
    by_class: dict[tuple, int] = {}
    class_of, sample = [0] * 256, []
    for byte in range(256):
        key = tuple(byte in x for x in sets)
        if key not in by_class:
            by_class[key] = len(sample)
            sample.append(byte)
        class_of[byte] = by_class[key]
    start = tuple(s.start for s in searches)
    ids, order = {start: 0}, [start]
    nexts, outs = [], []
    for state in order:
        to_row, out_row = [], []
        for byte in sample:
            moved = [s.step(x, byte) for s, x in zip(searches, state)]
            to = tuple(m[0] for m in moved)
            if to not in ids:
                ids[to] = len(ids)
                order.append(to)
            to_row.append(ids[to])
            out_row.append(sum(m[1] << i for i, m in enumerate(moved)))
        nexts.append(to_row)
        outs.append(out_row)
    last = np.array([sum(s.accepts(x) << i for i, (s, x) in enumerate(zip(searches, state))) for state in order])
    nexts, outs = np.array(nexts), np.array(outs)
    blocks = np.unique(np.column_stack([outs, last]), axis=0, return_inverse=True)[1].ravel()
    while True:
        refined = np.unique(np.column_stack([blocks, blocks[nexts]]), axis=0, return_inverse=True)[1].ravel()
        if refined.max() == blocks.max():
            break
        blocks = refined
    blocks = np.where(blocks == blocks[0], 0, np.where(blocks == 0, blocks[0], blocks))  # the start is state 0
    n = int(blocks.max()) + 1
    one = np.zeros(n, dtype=int)
    one[blocks] = np.arange(len(blocks))
    table, events = [0] * (n * 256), []
    for state in range(n):
        for byte in range(256):
            to = int(blocks[nexts[one[state], class_of[byte]]]) * 256
            mask = int(outs[one[state], class_of[byte]])
            if mask:
                events.append((to, mask))
                to = ~(len(events) - 1)
            table[state * 256 + byte] = to
    return table, events, [int(x) for x in last[one]]
