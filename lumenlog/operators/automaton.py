"""Composable summaries of texts for counting a pattern's matches over texts joined with single spaces.

A summary (head, count, tail) stands for a text, or for several joined ones, next to anything that may come before and after:

* ``head``: what a match that began earlier could still need, up to a position that no match can span, whatever came before;
* ``count``: the matches between that position and the last one of the kind;
* ``tail``: what a match that ends later could need; None if there is no such position, and ``head`` stands for the whole text.

Such positions are found with the pattern's automaton, run on the set of all its threads: where the set is empty, nothing spans. Stretches
that leave every thread where it was and match nothing are cut out of heads and tails, so that a long text becomes a few
characters, and the pattern's matches in the cut text are those in the whole. Summaries compose (``Running``), in
any grouping, so runs of messages can be summed up in parallel.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _compiler, _constants as op, _parser

MAX_NODES = 20_000
#: characters before the end of a text among which the last position is sought first
WINDOWS = (64, 1024, 16_384)

#: open texts are cut again beyond this length
CUT_SIZE = 4096
#: moves remembered at most
MAX_MOVES = 200_000

Summary = tuple[str, int, str | None]
FREE = (frozenset(), frozenset())


class Automaton:
    """The automaton of a case-insensitive pattern. Literals, classes, alternatives, groups and repetition of any kind are
    supported; anchors, word borders, look-around, back references and patterns that match the empty text are refused."""

    def __init__(self, pattern: str):
        tree = _parser.parse(pattern, re.IGNORECASE)
        if tree.getwidth()[0] == 0:
            raise ValueError(f"not supported over joined texts: {pattern!r} matches the empty text")
        self.regex = re.compile(pattern, re.IGNORECASE)
        self.pattern, self._state = pattern, tree.state
        self._atoms: list[re.Pattern] = []
        self._atom_ids: dict[str, int] = {}
        # a node is (atom, next) or a tuple of next nodes after None; node 0 accepts
        self._nodes: list[tuple] = [(None, ())]
        self._loops: dict[int, int] = {}  # node before a single repeated character -> that character's node
        self._start = self._sequence(tree, 0)
        self._reach = [self._closure(i) for i in range(len(self._nodes))]
        self._loops = {n: ch for n, ch in self._loops.items() if not self._reach[n][1]}
        self._kinds: dict[str, int] = {}  # character -> its kind
        self._masks: list[int] = []  # kind -> the atoms that match it, as bits
        self._mask_ids: dict[int, int] = {}
        self._moves: dict[tuple, tuple] = {}
        every = frozenset(n[1] for n in self._nodes if n[0] is not None)
        threads = self._step([*every, self._start], self._masks[self._kind(" ")])
        self.between = self._settle(frozenset(), threads)  # where any thread may stand after a joint
        self.crosses = bool(threads)
        self._every = self._settle(frozenset(), every)

    # ---- construction
    def _add(self, *node) -> int:
        self._nodes.append(node)
        if len(self._nodes) > MAX_NODES:
            raise ValueError(f"not supported over joined texts: {self.pattern!r} is too large")
        return len(self._nodes) - 1

    def _sequence(self, items, after: int) -> int:
        for item in reversed(list(items)):
            after = self._item(item, after)
        return after

    def _item(self, item, after: int) -> int:
        kind, arg = item
        if kind in (op.LITERAL, op.NOT_LITERAL, op.ANY, op.IN):
            name = repr(item)
            if name not in self._atom_ids:
                self._atom_ids[name] = len(self._atoms)
                self._atoms.append(_compiler.compile(_parser.SubPattern(self._state, [item]), re.IGNORECASE))
            return self._add(self._atom_ids[name], after)
        if kind is op.BRANCH:
            return self._add(None, tuple(self._sequence(alt, after) for alt in arg[1]))
        if kind is op.SUBPATTERN and not arg[1] and not arg[2]:
            return self._sequence(arg[3], after)
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = arg
            if high == op.MAXREPEAT:
                loop = self._add(None, ())
                inner = self._sequence(body, loop)
                self._nodes[loop] = (None, (inner, after))
                if self._nodes[inner][0] is not None and self._nodes[inner][1] == loop:
                    self._loops[loop] = inner
                after = loop
            else:
                end = after
                for _ in range(high - low):
                    after = self._add(None, (self._sequence(body, after), end))
            for _ in range(low):
                after = self._sequence(body, after)
            return after
        raise ValueError(f"not supported over joined texts: {str(kind).lower()} in {self.pattern!r}")

    def _closure(self, node: int) -> tuple[frozenset[int], bool]:
        """(nodes that read a character, whether the pattern is matched) from a node on, without reading."""
        seen, todo, chars = {node}, [node], set()
        while todo:
            n = todo.pop()
            atom, nxt = self._nodes[n]
            if atom is not None:
                chars.add(n)
                continue
            for m in nxt:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return frozenset(chars), 0 in seen

    # ---- running the set of all threads
    def _kind(self, ch: str) -> int:
        got = self._kinds.get(ch)
        if got is None:
            mask = sum(1 << i for i, a in enumerate(self._atoms) if a.match(ch))
            if mask not in self._mask_ids:
                self._mask_ids[mask] = len(self._masks)
                self._masks.append(mask)
            got = self._kinds[ch] = self._mask_ids[mask]
        return got

    def _step(self, threads, mask: int, without: frozenset[int] = frozenset()) -> frozenset[int]:
        return frozenset(self._nodes[ch][1] for t in threads for ch in self._reach[t][0]
                         if ch not in without and mask >> self._nodes[ch][0] & 1)

    def _settle(self, waiting: frozenset[int], moving: frozenset[int]) -> tuple[frozenset[int], frozenset[int]]:
        """(waiting, moving): threads in loops over single characters wait as soon as no other thread moves."""
        return (waiting | moving, frozenset()) if moving <= self._loops.keys() else (waiting, moving)

    def _move(self, state, kind: int):
        """(next state, changed): ``changed`` if a waiting thread ended or another came to where it waits, or something was matched."""
        waiting, moving = state
        mask = self._masks[kind]
        stay = frozenset(w for w in waiting if mask >> self._nodes[self._loops[w]][0] & 1)
        moved = self._step([*waiting, *moving, self._start], mask, frozenset(self._loops[w] for w in waiting))
        out = (stay, moved), stay != waiting or not stay.isdisjoint(moved) or any(self._reach[t][1] for t in moved)
        if len(self._moves) >= MAX_MOVES:
            self._moves.clear()
        self._moves[state, kind] = out
        return out

    def cut(self, text: str, state, upto_free: bool = False) -> tuple[str, int, tuple]:
        """(text without the stretches that change nothing, end, state there); ``upto_free``: stop where no thread is left.

        A stretch goes from one point where threads only wait to the next; if the same threads still wait and nothing was
        matched on the way, it is left out."""
        kinds, moves, kind_of, loops = self._kinds, self._moves, self._kind, self._loops.keys()
        kept, begin, changed = [], 0, bool(state[1])
        if upto_free and not state[0] and not state[1]:
            return "", 0, state
        for i, ch in enumerate(text):
            k = kinds.get(ch)
            if k is None:
                k = kind_of(ch)
            got = moves.get((state, k)) or self._move(state, k)
            state = got[0]
            if got[1]:
                changed = True
            moving = state[1]
            if moving and not moving <= loops:
                continue
            if changed or moving:
                kept.append(text[begin:i + 1])
            begin, changed = i + 1, False
            if moving:
                state = (state[0] | moving, frozenset())
            elif upto_free and not state[0]:
                return "".join(kept), i + 1, state
        kept.append(text[begin:])
        return "".join(kept), len(text), state

    def count(self, text: str) -> int:
        return sum(1 for _ in self.regex.finditer(text))

    def summary(self, text: str) -> Summary:
        """The summary of one text, which a joint precedes and another follows."""
        head, at, state = self.cut(text, self.between, upto_free=True)
        if state != FREE:
            return head, 0, None
        upto = at
        for w in WINDOWS:  # the last part from a position that no match spans
            if len(text) - w <= at:
                break
            _, more, state = self.cut(text[len(text) - w:], self._every, upto_free=True)
            if state == FREE:
                upto = len(text) - w + more
                break
        count = self.count(text[at:upto])
        tail, _, state = self.cut(text[upto:], FREE)
        if not self._step([*state[0], *state[1]], self._masks[self._kind(" ")]):
            return head, count + self.count(tail), ""  # nothing goes on beyond the joint
        return head, count, tail

    def total(self, s: Summary) -> int:
        """Matches in the texts of ``s``, with nothing before and after."""
        return self.count(s[0]) + s[1] + (self.count(s[2]) if s[2] else 0)


class Running:
    """The summary of texts given one after the other by their summaries, in linear time."""

    def __init__(self, machine: Automaton):
        self._machine, self._head, self._n = machine, None, 0
        self._parts: list[str] = []  # behind the last position that no match spans
        self._size, self._limit = 0, CUT_SIZE

    def add(self, s: Summary) -> None:
        head, n, tail = s
        self._parts.append(head)
        self._size += len(head) + 1
        if tail is not None:
            text = " ".join(self._parts)
            if self._head is None:
                self._head = text
            else:
                self._n += self._machine.count(text)
            self._n += n
            self._parts, self._size, self._limit = [tail], len(tail), CUT_SIZE
        elif self._size > self._limit:
            text = self._open()
            self._parts, self._size, self._limit = [text], len(text), max(CUT_SIZE, 2 * len(text))

    def _open(self) -> str:
        return self._machine.cut(" ".join(self._parts), self._machine.between if self._head is None else FREE)[0]

    def summary(self) -> Summary:
        return (self._open(), 0, None) if self._head is None else (self._head, self._n, self._open())


@lru_cache(maxsize=256)
def automaton(pattern: str) -> Automaton:
    return Automaton(pattern)
