"""Minimal acyclic transducer lexicon: words in, token ids out, in one shared-suffix automaton.

``compile_lexicon`` builds the minimal acyclic automaton of a sorted word list
incrementally (equivalent suffix states are shared through a register) and
numbers its words: every transition carries how many words come before it, so
the sum along a path is the word's rank, and the rank selects the word's ids.
The result is one flat byte string of little-endian arrays, which a worker
writes to an unlinked temporary file and maps into memory.

``Lexicon.lookup`` walks all words of a batch through the automaton in step,
one byte position at a time.
"""

from __future__ import annotations

import struct
import tempfile

import numpy as np

_MAGIC = b"INKLEX01"


class _State:
    __slots__ = ("edges", "final", "number", "below")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.below = 0

    def key(self) -> tuple:
        return (self.final, tuple((b, id(s)) for b, s in self.edges.items()))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of the words with their ids, as bytes. The empty word is left out."""
    root = _State()
    register: dict[tuple, _State] = {}
    path: list[tuple[_State, int, _State]] = []

    def freeze(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            parent.edges[byte] = register.setdefault(child.key(), child)

    words = sorted(w for w in entries if w)
    previous = b""
    for word in words:
        same = 0
        while same < min(len(word), len(previous)) and word[same] == previous[same]:
            same += 1
        freeze(same)
        state = path[-1][2] if path else root
        for byte in word[same:]:
            child = _State()
            state.edges[byte] = child
            path.append((state, byte, child))
            state = child
        state.final = True
        previous = word
    freeze(0)

    order: list[_State] = []
    stack = [root]
    while stack:  # number every state once
        s = stack.pop()
        if s.number < 0:
            s.number = len(order)
            order.append(s)
            stack.extend(s.edges.values())
    done: set[int] = set()
    stack2 = [(root, False)]
    while stack2:  # words below a state, children first
        s, ready = stack2.pop()
        if ready:
            s.below = int(s.final) + sum(c.below for c in s.edges.values())
        elif s.number not in done:
            done.add(s.number)
            stack2.append((s, True))
            stack2.extend((c, False) for c in s.edges.values())

    keys, targets, adds = [], [], []
    for s in order:
        skipped = int(s.final)
        for byte in sorted(s.edges):
            child = s.edges[byte]
            keys.append(s.number * 256 + byte)
            targets.append(child.number)
            adds.append(skipped)
            skipped += child.below
    offsets = np.zeros(len(words) + 1, "<i4")
    ids: list[int] = []
    for i, word in enumerate(words):
        ids.extend(entries[word])
        offsets[i + 1] = len(ids)
    arrays = [
        np.array(keys, "<i8"),
        np.array(targets, "<i4"),
        np.array(adds, "<i4"),
        np.array([s.final for s in order], "<i4"),
        offsets,
        np.array(ids, "<u4"),
    ]
    head = _MAGIC + struct.pack("<6q", *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, blob: bytes) -> None:
        with tempfile.TemporaryFile(prefix="inkwell-lex") as f:  # has no name: goes with the last mapping
            f.write(blob)
            f.flush()
            data = np.memmap(f, np.uint8, "r")
        if bytes(data[:8]) != _MAGIC:
            raise ValueError("not a lexicon")
        sizes = struct.unpack("<6q", bytes(data[8:56]))
        at, parts = 56, []
        for n, kind in zip(sizes, ("<i8", "<i4", "<i4", "<i4", "<i4", "<u4"), strict=True):
            width = np.dtype(kind).itemsize * n
            parts.append(data[at : at + width].view(kind))
            at += width
        self.keys, self.targets, self.adds, self.final, self.offsets, self.ids = parts

    @property
    def states(self) -> int:
        return len(self.final)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank in the lexicon, or -1."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        state = np.zeros(n, np.int64)
        rank = np.zeros(n, np.int64)
        out = np.full(n, -1, np.int64)
        live = np.nonzero(lengths > 0)[0]
        depth = 0
        while len(live):
            want = state[live] * 256 + flat[begin[live] + depth]
            at = np.searchsorted(self.keys, want)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == want
            live, at = live[ok], at[ok]
            state[live] = self.targets[at]
            rank[live] += self.adds[at]
            depth += 1
            ends = lengths[live] == depth
            hit = live[ends]
            hit = hit[self.final[state[hit]] == 1]
            out[hit] = rank[hit]
            live = live[~ends]
        return out

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as little-endian unsigned 32-bit integers, or None where it is not in the lexicon."""
        ids = self.ids.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = ids
        off = self.offsets
        return [None if r < 0 else ids[4 * off[r] : 4 * off[r + 1]] for r in self.ranks(words).tolist()]
