"""A minimal acyclic transducer from words to token ids, in one flat buffer that can be memory-mapped.

Words are added in byte order. A state is finished once no later word can pass through it, and finished states with
equal arcs are shared, so common endings are stored once. Every arc carries how many words sort before those it leads
to; their sum along a word is its number, and the number points to its ids.
"""

from __future__ import annotations

import mmap
import struct
from array import array
from collections.abc import Iterable

MAGIC = b"TLX1"


class Builder:
    """Compiles (word, ids) pairs that come in byte order, each word once."""

    def __init__(self) -> None:
        self.finished: dict[tuple, int] = {}
        self.states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        self.words_below: list[int] = []
        self.open: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
        self.last = b""
        self.ids, self.ends = array("i"), array("i", [0])

    def _finish(self, depth: int) -> None:
        """Closes the open states deeper than ``depth``."""
        while len(self.open) > depth + 1:
            final, arcs = self.open.pop()
            state = (final, tuple(arcs))
            number = self.finished.get(state)
            if number is None:
                number = self.finished[state] = len(self.states)
                self.states.append(state)
                self.words_below.append(final + sum(self.words_below[to] for _, to in arcs))
            self.open[-1][1].append((self.last[len(self.open) - 1], number))

    def add(self, word: bytes, ids: Iterable[int]) -> None:
        if word <= self.last:
            raise ValueError("words must come in byte order, each once, and none empty")
        shared = 0
        while shared < min(len(word), len(self.last)) and word[shared] == self.last[shared]:
            shared += 1
        self._finish(shared)
        self.open += [(False, []) for _ in word[shared:]]
        self.open[-1] = (True, self.open[-1][1])
        self.last = word
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def buffer(self) -> bytes:
        self._finish(0)
        first, labels, targets, before, final = array("i"), bytearray(), array("i"), array("i"), bytearray()
        states = [*self.states, self.open[0]]
        for is_final, arcs in states:
            first.append(len(labels))
            final.append(is_final)
            smaller = int(is_final)
            for label, to in arcs:
                labels.append(label)
                targets.append(to)
                before.append(smaller)
                smaller += self.words_below[to]
        first.append(len(labels))
        for part in (final, labels):
            part.extend(b"\0" * (-len(part) % 4))
        parts = [bytes(final), bytes(labels), *(a.tobytes() for a in (first, targets, before, self.ends, self.ids))]
        return MAGIC + struct.pack("<9i", len(states) - 1, 0, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """Looks words up in a buffer made by :class:`Builder`; the buffer is used as it is, not copied."""

    def __init__(self, buffer) -> None:
        view = memoryview(buffer)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("this is no lexicon")
        self.root, _, *sizes = struct.unpack("<9i", view[4:40])
        self.buffer, at, parts = buffer, 40, []
        for n in sizes:
            parts.append((at, view[at : at + n]))
            at += n
        self.final, self.labels_at = parts[0][1], parts[1][0]
        self.first, self.targets, self.before, self.ends, self.ids = (p.cast("i") for _, p in parts[2:])

    @classmethod
    def map(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def number(self, word: bytes) -> int:
        """The place of a word among all words in byte order; -1: not among them."""
        find, first, base = self.buffer.find, self.first, self.labels_at
        state, number = self.root, 0
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return -1
            number += self.before[arc]
            state = self.targets[arc]
        return number if self.final[state] else -1

    def find(self, word: bytes) -> list[int] | None:
        n = self.number(word)
        return None if n < 0 else self.ids[self.ends[n] : self.ends[n + 1]].tolist()
