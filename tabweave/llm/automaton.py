"""Byte automata for rule patterns: parse, subset construction, minimisation, scan.

Patterns are byte regular expressions of literals, escapes, classes, groups,
alternatives and the repeats ``? * + {m} {m,} {m,n}``. All rules become one
search automaton whose state says which rules have a match that ends here, and
one anchored automaton per rule to find how far a match from a given place goes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANES = 1024  # parts of a text buffer that are scanned side by side
BREAK = 0xFF  # a byte that no text holds; it separates documents


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1


class _Parser:
    """Builds a fragment (start, end) of an NFA for each part of a pattern."""

    def __init__(self, nfa: _Nfa, pattern: str, fold: bool):
        self.nfa, self.text, self.at, self.fold = nfa, pattern, 0, fold

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> tuple[int, int]:
        start, end = self.nfa.state(), self.nfa.state()
        while True:
            a, b = self.sequence()
            self.nfa.empty[start].append(a)
            self.nfa.empty[b].append(end)
            if self.peek() != "|":
                return start, end
            self.take()

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            began = self.at
            part = self.atom()
            after = self.at
            low, high = self.repeat()
            resume = self.at

            def again(began=began, after=after) -> tuple[int, int]:
                self.at = began
                made = self.atom()
                self.at = after
                return made

            parts = [part] + [again() for _ in range(max(low, high or 0, 1) - 1)]
            self.at = resume
            if high is None and low == 0:
                parts = parts[:1]
            for k, (a, b) in enumerate(parts):
                self.nfa.empty[end].append(a)
                if k >= low:  # may be left out
                    self.nfa.empty[end].append(b)
                if high is None and k == len(parts) - 1:
                    self.nfa.empty[b].append(a)
                end = b
        return start, end

    def repeat(self) -> tuple[int, int | None]:
        mark = self.peek()
        if mark in ("?", "*", "+") and mark:
            self.take()
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        if mark == "{":
            stop = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1:stop].partition(",")
            self.at = stop + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        char = self.take()
        if char == "(":
            made = self.alternatives()
            self.take()
            return made
        if char == "[":
            members: set[int] = set()
            while self.peek() != "]":
                low = self.byte(self.take())
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    members.update(range(low, self.byte(self.take()) + 1))
                else:
                    members.add(low)
            self.take()
        else:
            members = {self.byte(char)}
        if self.fold:
            members |= {ord(chr(b).swapcase()) for b in members if b < 128}
        start, end = self.nfa.state(), self.nfa.state()
        self.nfa.steps[start].append((frozenset(members), end))
        return start, end

    def byte(self, char: str) -> int:
        if char != "\\":
            return ord(char)
        if self.peek() == "x":
            self.at += 3
            return int(self.text[self.at - 2:self.at], 16)
        return ord(self.take())


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fold: str = ""  # a pattern in front, letters in either case


@dataclass
class Automaton:
    """``table[state * classes + kind_of_byte]``; ``accepts[state]`` has a bit per rule; state 0 starts."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    width: int
    dead: int = -1  # the state that leads nowhere, if there is one


def compile_rules(rules: list[Rule], search: bool) -> Automaton:
    nfa = _Nfa()
    root = nfa.state()
    final = {}
    for k, rule in enumerate(rules):
        at = root
        for pattern, fold in ((rule.fold, True), (rule.pattern, False)):
            a, b = _Parser(nfa, pattern, fold).alternatives()
            nfa.empty[at].append(a)
            at = b
        final[at] = 1 << k
    # bytes that no step tells apart are one class
    sets = {s for steps in nfa.steps for s, _ in steps}
    kinds: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    example = []
    for byte in range(256):
        key = (byte == BREAK, *(byte in s for s in sets))
        if key not in kinds:
            kinds[key] = len(kinds)
            example.append(byte)
        classes[byte] = kinds[key]

    def closure(states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    start = closure({root})
    number, order, rows = {start: 0}, [start], []
    for states in order:  # grows while it runs: subset construction
        row = []
        for byte in example:
            moved = {t for s in states for members, t in nfa.steps[s] if byte in members}
            after = start if byte == BREAK else closure(moved | {root} if search else moved)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([sum({final[s] for s in states if s in final}) for states in order], np.int64)
    # minimisation: split blocks of states until all of a block move alike
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        split = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if split.max() == block.max():
            break
        block = split
    # the start is state 0; the others follow in the order of their first members
    first = np.full(block.max() + 1, len(block))
    np.minimum.at(first, block, np.arange(len(block)))
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    members = np.sort(first)
    rows = rank[block[table[members]]] * len(example)
    own = np.arange(len(rows)) * len(example)
    real = np.arange(len(example)) != classes[BREAK]
    stuck = np.flatnonzero((rows[:, real] == own[:, None]).all(axis=1) & (accepts[members] == 0))
    return Automaton(classes, rows.reshape(-1).astype(np.int32), accepts[members], len(example),
                     int(own[stuck[0]]) if len(stuck) else -1)


def scan(machine: Automaton, data: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The state after every byte, from one pass over the bytes.

    The buffer is cut into lanes that advance together, each from the start
    state. A lane that should have begun in another state, the last one of the
    lane before, is run again from there until it falls in with what it had;
    so the result is that of a single run.
    """
    length = max(1, -(-len(data) // lanes))
    lanes = -(-len(data) // length)
    kinds = np.full(lanes * length, machine.classes[BREAK], np.uint8)
    kinds[:len(data)] = machine.classes[data]
    columns = np.ascontiguousarray(kinds.reshape(lanes, length).T).astype(np.int32)
    states = np.empty((length, lanes), np.int32)  # multiplied by the table's width
    now = np.zeros(lanes, np.int32)
    for step in range(length):
        now = machine.table[now + columns[step]]
        states[step] = now
    begun = np.zeros(lanes, np.int32)
    while True:
        wanted = np.concatenate(([0], states[-1, :-1])).astype(np.int32)
        wrong = np.flatnonzero(wanted != begun)
        if not len(wrong):
            break
        begun[wrong] = now = wanted[wrong]
        for step in range(length):
            now = machine.table[now + columns[step, wrong]]
            differ = now != states[step, wrong]
            if not differ.any():
                break
            states[step, wrong] = now
            wrong, now = wrong[differ], now[differ]
    return (states.T.reshape(-1)[:len(data)]) // machine.width


def longest(machine: Automaton, data: bytes, at: int) -> int:
    """End of the longest match that begins at ``at``, or -1. For an anchored machine of one rule."""
    state, end = 0, -1
    table, classes, width, accepts = machine.table, machine.classes, machine.width, machine.accepts
    for place in range(at, len(data)):
        state = int(table[state + int(classes[data[place]])])
        if accepts[state // width]:
            end = place + 1
        elif state == machine.dead:
            break
    return end
