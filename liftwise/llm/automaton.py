"""Several byte patterns as one deterministic automaton that finds their leftmost matches in a single pass.

A pattern becomes the positions of its byte sets and which may follow which.
Subset construction runs over ordered lists of position sets, one per place
where a match may have begun, the earliest first, and notes for every
transition which list entry each entry comes from. So the place where a match
began can be read back from the states passed, and the automaton itself only
ever moves forward. Each rule's automaton is minimised; the combined one is
the product of these over the states that can be reached. As every rule has an
output of its own, that product is minimal too.

Patterns: literals, escapes, [sets], groups, (?i:...) for ASCII letters in
either case, (?<value>...) for the part that counts, | and ? * + {n} {n,} {n,m}.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEW = -1
#: Upper bound on the states of a combined automaton; beyond it compiling fails and asks for fewer rules.
MAX_STATES = 60_000


class _Positions:
    """Byte sets of a pattern's positions and the positions that may follow each."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.sets: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        self.value: set[int] = set()
        nullable, self.first, self.last = self._build(self._either(False), False)
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} in {pattern!r}")
        if nullable:
            raise ValueError(f"{pattern!r} matches the empty text")
        if not self.value:
            self.value = set(range(len(self.sets)))

    def _peek(self, text: str) -> bool:
        if self.pattern.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def _either(self, fold: bool) -> tuple:
        options = [self._sequence(fold)]
        while self._peek("|"):
            options.append(self._sequence(fold))
        return ("either", options)

    def _sequence(self, fold: bool) -> tuple:
        parts = []
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            parts.append(self._repeated(self._atom(fold)))
        return ("sequence", parts)

    def _repeated(self, node: tuple) -> tuple:
        for mark, least, most in (("?", 0, 1), ("*", 0, None), ("+", 1, None)):
            if self._peek(mark):
                return ("repeat", node, least, most)
        if self._peek("{"):
            inside, _, rest = self.pattern[self.at :].partition("}")
            low, comma, high = inside.partition(",")
            self.at = len(self.pattern) - len(rest)
            return ("repeat", node, int(low), int(high) if high else (None if comma else int(low)))
        return node

    def _atom(self, fold: bool) -> tuple:
        for opening in ("(?i:", "(?<value>", "("):
            if self._peek(opening):
                node = self._either(fold or opening == "(?i:")
                if not self._peek(")"):
                    raise ValueError(f"missing ) in {self.pattern!r}")
                return ("value", node) if opening == "(?<value>" else node
        if self._peek("["):
            negated, members = self._peek("^"), set()
            while not self._peek("]"):
                low = high = self._byte()
                if self.pattern[self.at : self.at + 1] == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                    self.at += 1
                    high = self._byte()
                members |= set(range(low, high + 1))
            members = set(range(256)) - members if negated else members
        else:
            members = {self._byte()}
        if fold:
            members |= {x ^ 32 for x in members if 65 <= x & 223 <= 90}
        return ("set", frozenset(members))

    def _byte(self) -> int:
        if self.at >= len(self.pattern):
            raise ValueError(f"{self.pattern!r} ends too early")
        if self._peek("\\x"):
            self.at += 2
            return int(self.pattern[self.at - 2 : self.at], 16)
        self._peek("\\")
        self.at += 1
        code = ord(self.pattern[self.at - 1])
        if code > 127:
            raise ValueError("patterns are ASCII; write other bytes as \\xHH")
        return code

    def _join(self, left: tuple, right: tuple) -> tuple:
        for p in left[2]:
            self.follow[p] |= right[1]
        return left[0] and right[0], left[1] | right[1] if left[0] else left[1], right[2] | left[2] if right[0] else right[2]

    def _build(self, node: tuple, value: bool) -> tuple[bool, set[int], set[int]]:
        """(may be empty, first positions, last positions) of a part; its positions are made anew at each call."""
        kind = node[0]
        if kind == "set":
            p = len(self.sets)
            self.sets.append(node[1])
            self.follow.append(set())
            if value:
                self.value.add(p)
            return False, {p}, {p}
        if kind == "value":
            return self._build(node[1], True)
        if kind == "either":
            parts = [self._build(x, value) for x in node[1]]
            return any(x[0] for x in parts), set().union(*(x[1] for x in parts)), set().union(*(x[2] for x in parts))
        done = (True, set(), set())
        if kind == "sequence":
            for part in node[1]:
                done = self._join(done, self._build(part, value))
            return done
        _, inner, least, most = node
        for k in range(least if most is not None else max(least, 1)):
            part = self._build(inner, value)
            if most is None and k == max(least, 1) - 1:
                self._join(part, part)
                part = (part[0] or least == 0, *part[1:])
            done = self._join(done, part)
        for _ in range((most or 0) - least):
            part = self._build(inner, value)
            done = self._join(done, (True, *part[1:]))
        return done


@dataclass
class _Single:
    """Minimal automaton of one pattern. State 0 is the start; column ``classes`` of each row is the end of the text."""

    step: list[list[int]]
    origin: list[list[tuple[int, ...]]]
    ended: list[bool]
    value: list[tuple[bool, ...]]


def _single(pattern: _Positions, samples: list[int]) -> _Single:
    accepting = frozenset(pattern.last)
    reach: dict[tuple, frozenset] = {}

    def after(held: frozenset | None, byte: int) -> frozenset:
        key = (held, byte)
        if key not in reach:
            options = pattern.first if held is None else set().union(*(pattern.follow[p] for p in held))
            reach[key] = frozenset(p for p in options if byte in pattern.sets[p])
        return reach[key]

    def moved(state: tuple, byte: int | None) -> tuple[tuple, tuple[int, ...]]:
        held = state[0]
        accepted = bool(held) and bool(held[0] & accepting)
        if byte is None:
            return ((), accepted), ()
        found, seen = [], frozenset()
        for k, positions in enumerate(held):
            now = after(positions, byte) - seen
            if now:
                found.append((k, now))
                seen |= now
        alive = accepted and bool(found) and found[0][0] == 0
        if alive and not found[0][1] & accepting:
            raise ValueError(f"{pattern.pattern!r}: a match that has ended may go on without matching")
        if not alive:
            now = after(None, byte) - seen
            if now:
                found.append((NEW, now))
        if found and found[0][1] & accepting:
            found = found[:1]
        elif any(now & accepting for _, now in found):
            raise ValueError(f"{pattern.pattern!r}: a later match may end before an earlier one")
        return (tuple(now for _, now in found), accepted and not alive), tuple(k for k, _ in found)

    states, step, origin = {((), False): 0}, [], []
    queue = [((), False)]
    for state in queue:
        row, ways = [], []
        for byte in [*samples, None]:
            target, way = moved(state, byte)
            if target not in states:
                states[target] = len(states)
                queue.append(target)
            row.append(states[target])
            ways.append(way)
        step.append(row)
        origin.append(ways)
    ended = [s[1] for s in queue]
    value = [tuple(held <= pattern.value for held in s[0]) for s in queue]

    # Moore's refinement: states stay together while outputs and the groups they lead to agree.
    group, count = [0] * len(queue), 1
    while True:
        marks: dict[tuple, int] = {}
        refined = [
            marks.setdefault((group[s], ended[s], value[s], tuple((group[t], w) for t, w in zip(step[s], origin[s]))), len(marks)) for s in range(len(queue))
        ]
        group = refined
        if len(marks) == count:
            break
        count = len(marks)
    first = [group.index(g) for g in range(count)]
    return _Single([[group[t] for t in step[s]] for s in first], [origin[s] for s in first], [ended[s] for s in first], [value[s] for s in first])


@dataclass
class Automaton:
    """Transition arrays of the combined automaton.

    ``classes[byte]`` is a byte's class, ``end`` the class that closes a text.
    ``step[state, class]`` is the next state and ``ended[state]`` the rules, as
    bits, of which a match ended just before the byte that led here.
    ``parts[state]`` are the states of the single automata, whose origins tell
    where a match began.
    """

    classes: np.ndarray
    end: int
    step: np.ndarray
    ended: np.ndarray
    parts: np.ndarray
    origin: list[list[list[tuple[int, ...]]]]
    value: list[list[tuple[bool, ...]]]

    def table(self) -> list[int]:
        """The transition array as one list, states as multiples of its width; for ``trace``, once a task."""
        return (self.step.astype(np.int64) * self.step.shape[1]).ravel().tolist()

    def trace(self, data: bytes, table: list[int], chunk: int = 1 << 18) -> np.ndarray:
        """State after every byte of ``data``, which holds classes; the automaton starts in state 0."""
        width = self.step.shape[1]
        out = np.empty(len(data), np.uint16)
        s = 0
        for a in range(0, len(data), chunk):
            states = [s := table[s + c] for c in data[a : a + chunk]]
            out[a : a + len(states)] = np.array(states, np.int64) // width
        return out

    def began(self, rule: int, trace: np.ndarray, data: bytes, last: int) -> tuple[int, int]:
        """Where the match of ``rule`` whose last byte is at ``last`` began, and where its value part began."""
        parts, origin, value = self.parts, self.origin[rule], self.value[rule]
        rank, p, since = 0, last, last + 1
        while True:
            if since == p + 1 and value[parts[trace[p], rule]][rank]:
                since = p
            rank = origin[parts[trace[p - 1], rule] if p else 0][data[p]][rank]
            if rank == NEW:
                return p, since
            p -= 1


def compile_patterns(patterns: list[str]) -> Automaton:
    """One automaton for all patterns.

    Raises ValueError for a pattern that can match nothing at all, for one
    whose match may go on after its end without matching again (as ``a(bc)?``:
    end it in its repeated part), and where a later match could end before an
    earlier one is decided.
    """
    if not patterns or len(patterns) > 60:
        raise ValueError("1 to 60 patterns are needed")
    read = [_Positions(p) for p in patterns]
    sets = sorted({s for p in read for s in p.sets}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    if len(kinds) > 255:
        raise ValueError("too many different byte sets")
    samples = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]
    singles = [_single(p, samples) for p in read]
    start = (0,) * len(singles)
    states, queue, step = {start: 0}, [start], []
    for state in queue:
        row = []
        for target in zip(*(one.step[s] for one, s in zip(singles, state))):
            if target not in states:
                states[target] = len(states)
                queue.append(target)
            row.append(states[target])
        if len(states) > MAX_STATES:
            raise ValueError("the combined automaton is too large; scan with fewer rules at a time")
        step.append(row)
    ended = [sum(1 << r for r, (one, s) in enumerate(zip(singles, state)) if one.ended[s]) for state in queue]
    return Automaton(
        classes, len(kinds), np.array(step, np.int32), np.array(ended, np.uint64), np.array(queue, np.int32), [o.origin for o in singles], [o.value for o in singles]
    )
