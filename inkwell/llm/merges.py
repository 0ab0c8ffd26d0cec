"""Exact BPE merges for many words at once, in numpy.

Words of one length stand in the rows of a matrix of symbols. A round finds
each row's best pair (lowest rank, leftmost), merges it and moves the rest of
the row up, so after k rounds all rows that still merge have k symbols fewer;
rows without a pair leave. Only the two pairs next to a merge are looked up
again.

It covers tokenizers of one form: BPE on bytes with a word-end suffix, NFC,
lower case, and a split into contractions, runs of letters, single numbers and
runs of other signs. ``BatchBPE.of`` returns None for any other form.
"""

from __future__ import annotations

import json

import numpy as np
import regex

#: Fixed value: the split pattern of the vocabulary's pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_NONE = np.int32(1 << 30)


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class BatchBPE:
    LONGEST = 48

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + suffix] for s in signs], np.int64)
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.out = np.array([vocab[a + b] for a, b in pairs] + [0], np.int64)
        bits = max(8, int(len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table_key = np.full(1 << bits, -1, np.int64)
        self.table_rank = np.full(1 << bits, _NONE, np.int32)
        rank = np.arange(len(keys), dtype=np.int32)
        order = np.unique(keys, return_index=True)[1]
        todo_key, todo_rank = keys[order], rank[order]
        at = self._home(todo_key)
        while len(todo_key):  # open addressing, placed in rounds
            free = self.table_key[at] < 0
            _, one = np.unique(np.where(free, at, -1), return_index=True)
            one = one[free[one]]
            self.table_key[at[one]], self.table_rank[at[one]] = todo_key[one], todo_rank[one]
            rest = np.ones(len(at), bool)
            rest[one] = False
            todo_key, todo_rank, at = todo_key[rest], todo_rank[rest], (at[rest] + 1) % len(self.table_key)

    @classmethod
    def of(cls, tok) -> BatchBPE | None:
        j = json.loads(tok.to_str())
        m, pre = j["model"], j["pre_tokenizer"] or {}
        steps = [s["type"] for s in (j["normalizer"] or {}).get("normalizers", [])]
        kinds = [p["type"] for p in pre.get("pretokenizers", [])]
        if m["type"] != "BPE" or not m.get("end_of_word_suffix") or m.get("continuing_subword_prefix") or m.get("byte_fallback") or m.get("ignore_merges") or m.get("dropout"):
            return None
        if steps != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"]:
            return None
        split, level = pre["pretokenizers"]
        if split["pattern"] != {"Regex": SPLIT} or not split["invert"] or split["behavior"] != "Removed" or level["add_prefix_space"] or level["use_regex"]:
            return None
        return cls(m["vocab"], m["merges"], m["end_of_word_suffix"])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32 | b).ravel()
        at = self._home(keys)
        got = self.table_key[at]
        rank = np.where(got == keys, self.table_rank[at], _NONE)
        far = np.nonzero((got != keys) & (got >= 0))[0]
        while len(far):
            at[far] = (at[far] + 1) % len(self.table_key)
            got = self.table_key[at[far]]
            hit = got == keys[far]
            rank[far[hit]] = self.table_rank[at[far[hit]]]
            far = far[~hit & (got >= 0)]
        return rank.reshape(a.shape)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of pieces of 1 to LONGEST bytes."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes).tolist():
            rows = np.nonzero(sizes == n)[0]
            raw = np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8).reshape(-1, n)
            sym = self.inner[raw]
            sym[:, -1] = self.last[raw[:, -1]]
            self._group(rows, sym, out)
        return out

    def _group(self, rows: np.ndarray, sym: np.ndarray, out: list[bytes]) -> None:
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        while True:
            n = sym.shape[1]
            if n > 1:
                j = rank.argmin(1)
                best = rank[np.arange(len(j)), j]
                done = best == _NONE
            else:
                done = np.ones(len(rows), bool)
            if done.any():
                raw = sym[done].astype("<u4").tobytes()
                for k, i in enumerate(rows[done].tolist()):
                    out[i] = raw[4 * n * k : 4 * n * (k + 1)]
                if done.all():
                    return
                go = ~done
                rows, sym, rank, j, best = rows[go], sym[go], rank[go], j[go], best[go]
            every = np.arange(len(rows))
            source = np.arange(n - 1)[None, :] + (np.arange(n - 1)[None, :] > j[:, None])
            new = self.out[best]
            sym = np.take_along_axis(sym, source, 1)
            sym[every, j] = new
            rank = np.take_along_axis(rank, source[:, :-1] if n > 2 else source[:, :0], 1)
            has = np.nonzero(j > 0)[0]
            if n > 2:
                rank[has, j[has] - 1] = self.ranks(sym[has, j[has] - 1], new[has])
                has = np.nonzero(j < n - 2)[0]
                rank[has, j[has]] = self.ranks(new[has], sym[has, j[has] + 1])


def is_plain(text: str) -> bool:
    """Latin-1 alone: there NFC changes nothing and lower case works sign by sign, in every Unicode version."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_LINES = regex.compile(SPLIT + r"|\n")


def pieces_of_lines(text: str) -> list[str]:
    """The pieces of plain words (Latin-1) that stand a line each, and the line ends."""
    return _LINES.findall(text.lower())
