"""Rule regexes compiled into one minimal deterministic automaton over bytes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np


#: Texts that are worth reading side by side.
LANES = 48


@dataclass(frozen=True)
class Rule:
    """A kind of match: its regex, and what a match must have to count.

    ``least``: bytes of the whole match; ``least_tail``: bytes from the first
    one on at which the regex has matched.
    """

    kind: str
    regex: str
    least: int = 0
    least_tail: int = 0


class _Net:
    """A nondeterministic automaton; earlier empty moves take precedence.

    Rules are ASCII literals, ``\\`` before a character or ``\\xHH``, classes
    of characters and ranges, groups ``(?:...)`` and ``(?i:...)``, ``|`` and
    the greedy ``?``, ``*``, ``+``, ``{n}``, ``{n,}``, ``{n,m}``.
    """

    def __init__(self, regex: str, backwards: bool = False):
        self.empty: list[list[int]] = []
        self.byte: list[tuple[frozenset[int], int] | None] = []
        self.text, self.at, self.backwards = regex, 0, backwards
        self.last = self._state()
        self.first = self._choice(False)(self.last)
        if self.at < len(regex):
            raise ValueError(f"a rule may not go on with {regex[self.at :]!r}")

    def _state(self, empty=(), byte=None) -> int:
        self.empty.append(list(empty))
        self.byte.append(byte)
        return len(self.empty) - 1

    def _take(self, *tokens: str) -> str | None:
        for t in tokens:
            if self.text.startswith(t, self.at):
                self.at += len(t)
                return t
        return None

    # each part of a rule becomes a function: the state that follows -> the state that begins

    def _choice(self, cased: bool) -> Callable[[int], int]:
        ways = [self._sequence(cased)]
        while self._take("|"):
            ways.append(self._sequence(cased))
        return ways[0] if len(ways) == 1 else lambda then: self._state(empty=[w(then) for w in ways])

    def _sequence(self, cased: bool) -> Callable[[int], int]:
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self._repeated(self._atom(cased)))
        ordered = parts if self.backwards else parts[::-1]

        def build(then: int) -> int:
            for part in ordered:
                then = part(then)
            return then

        return build

    def _atom(self, cased: bool) -> Callable[[int], int]:
        if group := self._take("(?:", "(?i:"):
            inner = self._choice(cased or group == "(?i:")
            if not self._take(")"):
                raise ValueError("a group of a rule has no end")
            return inner
        if self._take("["):
            members: set[int] = set()
            while not self._take("]"):
                low = high = self._character()
                if self.text[self.at : self.at + 1] == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                    self.at += 1
                    high = self._character()
                members |= set(range(low, high + 1))
        elif self.text[self.at] in "(.*+?{^$":
            raise ValueError(f"a rule may not use {self.text[self.at]!r} there")
        else:
            members = {self._character()}
        if cased:
            members |= {ord(y) for x in members for y in (chr(x).lower(), chr(x).upper())}
        if max(members) > 127:
            raise ValueError("rules are over ASCII bytes")
        return lambda then: self._state(byte=(frozenset(members), then))

    def _character(self) -> int:
        if self._take("\\x"):
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if self._take("\\") and self.text[self.at].isalnum():
            raise ValueError(f"a rule may not use \\{self.text[self.at]}")
        self.at += 1
        return ord(self.text[self.at - 1])

    def _repeated(self, part: Callable[[int], int]) -> Callable[[int], int]:
        if mark := self._take("?", "*", "+"):
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        elif self._take("{"):
            end = self.text.index("}", self.at)
            least, comma, most = self.text[self.at : end].partition(",")
            low, high = int(least), int(most) if most else None if comma else int(least)
            self.at = end + 1
        else:
            return part

        def build(then: int) -> int:
            if high is None:
                loop = self._state()
                self.empty[loop] += [part(loop), then]
                then = loop
            else:
                for _ in range(high - low):
                    then = self._state(empty=[part(then), then])
            for _ in range(low):
                then = part(then)
            return then

        return build

    def closure(self, states) -> tuple[int, ...]:
        """What empty moves reach, by precedence; nothing after a match."""
        found: dict[int, None] = {}
        stack = list(reversed(states))
        while stack:
            s = stack.pop()
            if s in found:
                continue
            found[s] = None
            stack.extend(reversed(self.empty[s]))
        kept = [s for s in found if self.byte[s] or s == self.last]
        return tuple(kept[: kept.index(self.last) + 1] if self.last in kept else kept)

    def step(self, states, b: int) -> list[int]:
        return [self.byte[s][1] for s in states if self.byte[s] and b in self.byte[s][0]]


def _search_step(net: _Net, now: tuple[int, ...], b: int) -> tuple[int, ...]:
    """The next subset of a leftmost search without overlaps.

    A match that cannot go on has ended, and the search starts anew on b.
    """
    start = net.closure([net.first])
    if net.last in now:
        if then := net.closure(net.step(now, b)):
            if net.last not in then:
                raise ValueError("after its first match, a rule may only go on matching")
            return then
        now = start
        if net.last in net.closure(net.step(now, b)):
            raise ValueError("a rule may not match a single byte")
    return net.closure(net.step(now, b) + [net.first])


def _subsets(net: _Net, sample: list[int], bit: int) -> tuple[np.ndarray, np.ndarray]:
    """(subset x kind of byte: the next subset, ``bit`` where one matches) of a rule, subset 0 being the start."""
    first = net.closure([net.first])
    number, queue, moves = {first: 0}, [first], []
    for state in queue:
        row = []
        for b in sample:
            then = _search_step(net, state, b)
            if then not in number:
                number[then] = len(queue)
                queue.append(then)
            row.append(number[then])
        moves.append(row)
    return np.array(moves), np.array([bit * (net.last in s) for s in queue], dtype=np.int64)


def _product(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The automaton of both: pairs of states that the start reaches, found wave by wave."""
    (moves, mask), (other, its) = one, two
    known, waves, then = np.zeros(1, dtype=np.int64), [np.zeros(1, dtype=np.int64)], []
    while len(waves[-1]):
        a, b = np.divmod(waves[-1], len(other))
        then.append(moves[a].astype(np.int64) * len(other) + other[b])
        waves.append(np.setdiff1d(then[-1], known))
        known = np.union1d(known, waves[-1])
    codes = np.concatenate(waves)
    by = np.argsort(codes)
    a, b = np.divmod(codes, len(other))
    return by[np.searchsorted(codes[by], np.concatenate(then))], mask[a] | its[b]


class Automaton:
    """All rules in one pass over the bytes.

    States are tuples of one subset a rule, found by subset construction from
    the start, then merged by partition refinement. ``table[state * 256 + b]``
    is the next state, premultiplied; states from ``flagged`` on match.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nets = [_Net(r.regex) for r in rules]
        sets = {members for n in nets for x in n.byte if x for members in x[:1]}
        kinds: dict[tuple[bool, ...], int] = {}  # bytes that no rule tells apart move alike
        kind = [kinds.setdefault(tuple(b in m for m in sets), len(kinds)) for b in range(256)]
        sample = [kind.index(k) for k in range(len(kinds))]
        table, mask = reduce(_product, (_subsets(n, sample, 1 << k) for k, n in enumerate(nets)))
        self.subsets = len(table)
        _, block = np.unique(mask, return_inverse=True)
        while True:  # refine until no block has members that move to different blocks
            before = block.max()
            for moved in table.T:
                _, block = np.unique(block.astype(np.int64) * len(table) + block[moved], return_inverse=True)
            if block.max() == before:
                break
        _, member = np.unique(block, return_index=True)
        rank = np.argsort(mask[member] > 0, kind="stable")  # matching states last
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        self.states = len(rank)
        self.moves = place[block[table[member[rank]]]].astype(np.int32)
        self.kind = np.array(kind)
        self.mask = [int(x) for x in mask[member[rank]]]
        self.start = int(place[block[0]]) << 8
        self.flagged = int((mask[member] == 0).sum()) << 8

    @cached_property
    def table(self) -> list[int]:
        """The transition array; made where it is used, the moves by kind of byte are much smaller."""
        shared = [k << 8 for k in range(self.states)]
        return [shared[k] for k in self.moves[:, self.kind].ravel().tolist()]

    @cached_property
    def _reversed(self) -> list[_Net]:
        return [_Net(r.regex, backwards=True) for r in self.rules]

    def _begin(self, k: int, data: bytes, end: int, least: int) -> int:
        """Where the longest match that ends at ``end`` begins, not before ``least``."""
        net = self._reversed[k]
        now, found, i = self._all(net, [net.first]), end, end
        while i > least and now:
            i -= 1
            now = self._all(net, net.step(now, data[i]))
            if net.last in now:
                found = i
        return found

    @staticmethod
    def _all(net: _Net, states) -> set[int]:
        found, stack = set(), list(states)
        while stack:
            s = stack.pop()
            if s not in found:
                found.add(s)
                stack.extend(net.empty[s])
        return found

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches that count, by start, then rule."""
        return self._matches(data, self._changes(data))

    def scan_all(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """The same for many texts, as arrays of bytes, that are read side by side.

        Each step takes the next byte of all texts that have one; when fewer
        than ``LANES`` are left, each of these goes on by itself.
        """
        order = sorted(range(len(texts)), key=lambda j: -len(texts[j]))
        sizes = np.array([len(texts[j]) for j in order], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        kinds = self.kind.astype(np.int32)[np.concatenate([*(texts[j] for j in order), np.zeros(0, np.uint8)])]
        moves, masks, width = self.moves.ravel(), np.array(self.mask), self.moves.shape[1]
        state = np.full(len(order), self.start >> 8, dtype=np.int32)
        open_ = np.zeros(len(order), dtype=masks.dtype)
        changes: list[list[tuple[int, int]]] = [[] for _ in texts]
        i, live = 0, int((sizes > 0).sum())
        while live >= LANES:
            state = moves[state[:live] * width + kinds[starts[:live] + i]]
            now = masks[state]
            for j in np.flatnonzero(now != open_[:live]).tolist():
                changes[order[j]].append((i, int(now[j])))
            open_, i = now, i + 1
            live = int(np.searchsorted(-sizes[:live], -i, side="left"))
        for j in range(live):
            changes[order[j]] += self._changes(texts[order[j]].tobytes(), i, int(state[j]) << 8, int(open_[j]))
        return [self._matches(t.tobytes(), c) if c else [] for t, c in zip(texts, changes, strict=True)]

    def _changes(self, data: bytes, begin: int = 0, s: int | None = None, open_: int = 0) -> list[tuple[int, int]]:
        """(position, rules that match up to there) wherever the latter change."""
        table, flagged, mask, found = self.table, self.flagged, self.mask, []
        s = self.start if s is None else s
        for i, b in enumerate(data[begin:] if begin else data, begin):
            s = table[s + b]
            if s >= flagged or open_:
                now = mask[s >> 8]
                if now != open_:
                    found.append((i, now))
                    open_ = now
        return found

    def _matches(self, data: bytes, changes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The matches that count, from where rules begin and cease to match."""
        since, done, found, open_ = [0] * len(self.rules), [0] * len(self.rules), [], 0
        for i, now in [*changes, (len(data), 0)]:
            for k, rule in enumerate(self.rules):
                if open_ & ~now & (1 << k):
                    begin = self._begin(k, data, i, done[k])
                    done[k] = i
                    if i - begin >= rule.least and i - since[k] >= rule.least_tail:
                        found.append((begin, k, i))
                elif now & ~open_ & (1 << k):
                    since[k] = i
            open_ = now
        return sorted(found)
