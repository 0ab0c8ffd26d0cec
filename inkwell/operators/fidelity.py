"""Fidelity gates of candidate edits against their documents, and what they say together."""

from __future__ import annotations

import bisect
import difflib
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import operations, select, structure

TOKEN = re.compile(r"\w+|[^\w\s]")

GATES = ("unicode_materialization", "operation_locality", "edit_budgets", "protected_spans", "document_structure", "claim_and_semantic_equivalence")


def _ratio(a: list[str], b: list[str], same: int) -> float:
    return min(1.0, 1.0 - same / max(len(a), len(b)))


def token_ratio(source: str, candidate: str) -> float:
    """Share of tokens outside the matching blocks."""
    return _tokens_ratio(TOKEN.findall(source), TOKEN.findall(candidate))


#: Characters that may stand for tokens: all but surrogates.
_CHARACTERS = 0x110000 - 0x800


def _code(number: int) -> str:
    """The character for a token's number."""
    return chr(number if number < 0xD800 else number + 0x800)


def _codes_of(tokens: Iterable[str]) -> dict[str, str]:
    """A character for each token, as far as there are characters."""
    return dict(zip(dict.fromkeys(tokens), map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))), strict=False))


def _coded(a: list[str], b: list[str]) -> tuple[str, str] | None:
    """Two lists of tokens as texts with a character for each token; none where there are more tokens than characters."""
    codes = _codes_of(itertools.chain(a, b))
    if len(codes) == _CHARACTERS and not (set(a) | set(b)) <= codes.keys():
        return None
    return "".join(map(codes.__getitem__, a)), "".join(map(codes.__getitem__, b))


def _tokens_ratio(a: list[str] | str, b: list[str] | str) -> float:
    if not a:
        return 1.0 if b else 0.0
    texts = (a, b) if isinstance(a, str) else _coded(a, b)
    if texts:
        return _ratio(a, b, select.matched(*texts))
    return _ratio(a, b, sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()))


def _alike_from_start(a: list[str] | str, b: list[str] | str) -> int:
    """How many first tokens are the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # slices are compared without a loop of our own
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def exceeds(a: list[str] | str, b: list[str] | str, most: float, kept: int = 0) -> bool:
    """Whether the token ratio is over a limit; blocks are only matched between exact bounds. Tokens may be given coded, as texts; ``kept`` is how many both sides have in any case.

    The first block matched is the longest common one, at least as long as the
    common start or end; no token is matched more often than both sides have it.
    """
    if not a:
        return _tokens_ratio(a, b) > most
    first, last = _alike_from_start(a, b), _alike_from_start(a[::-1], b[::-1])
    if _ratio(a, b, max(first, last)) <= most:
        return False
    if _ratio(a, b, min(len(a), len(b))) > most:
        return True
    near = max(kept, min(first + last, len(a), len(b)))  # both sides have these tokens at least, so counts tell nothing where they are enough
    if _ratio(a, b, near) > most and _ratio(a, b, (Counter(a) & Counter(b)).total()) > most:
        return True
    texts, n = (a, b) if isinstance(a, str) else _coded(a, b), max(len(a), len(b))
    needed = next((m for m in range(max(0, int((1.0 - most) * n) - 2), n + 1) if _ratio(a, b, m) <= most), None)
    if not texts or needed is None:
        return _tokens_ratio(a, b) > most
    return not select.reaches(*texts, needed, max(first, last))


def diff_operations(source: str, candidate: str) -> list[tuple[int, int, str]]:
    """The character edits that turn source into candidate."""
    m = difflib.SequenceMatcher(None, source, candidate, autojunk=False)
    return [(a, b, candidate[c:d]) for tag, a, b, c, d in m.get_opcodes() if tag != "equal"]


class _Facts:
    """What the gates ask of a document, once for all its candidates."""

    def __init__(self, text: str, media_type: str, spans: list[tuple[int, int, str, str]] | None = None) -> None:
        self.text, self.media_type = text, media_type
        self._read: tuple = ()
        self._cuts, self._counts = [0], [0]
        self._edited: dict[tuple, str] = {}
        if spans is not None:
            self.spans = spans

    @cached_property
    def tokens(self) -> list[str]:
        return TOKEN.findall(self.text)

    @cached_property
    def _codes(self) -> dict[str, str]:
        return _codes_of(self.tokens)

    @cached_property
    def coded(self) -> str | None:
        """The tokens as a text with a character for each; none where candidates' tokens might need more characters than there are."""
        return "".join(map(self._codes.__getitem__, self.tokens)) if len(self.tokens) < 0x80000 else None

    def _before(self, place: int) -> int:
        """How many tokens begin before a place that is no token's inside."""
        k = bisect.bisect_right(self._cuts, place) - 1
        if self._cuts[k] == place:
            return self._counts[k]
        n = self._counts[k] + len(TOKEN.findall(self.text, self._cuts[k], place))
        self._cuts.insert(k + 1, place)
        self._counts.insert(k + 1, n)
        return n

    def _coded(self, text: str) -> str | None:
        """A text's tokens, coded."""
        made = []
        for t in TOKEN.findall(text):
            code = self._codes.get(t)
            if code is None:
                if len(self._codes) == _CHARACTERS:
                    return None
                code = self._codes[t] = _code(len(self._codes))
            made.append(code)
        return "".join(made)

    def tokens_of(self, result: str, ops: list[tuple[int, int, str]]) -> tuple[list[str] | str, list[str] | str, int]:
        """Tokens of the document and of the text that its sorted edits give, coded if they can be, and how many at least both have; only what stands between spaces around edits is read."""
        if self._read[:2] == (result, ops):
            return self._read[2]
        text, parts = self.text, []
        for op in ops:
            d = text.find(" ", op[1])
            c, d = text.rfind(" ", 0, op[0]) + 1, len(text) if d < 0 else d
            if parts and c <= parts[-1][1]:
                parts[-1] = (parts[-1][0], max(d, parts[-1][1]), [*parts[-1][2], op])
            else:
                parts.append((c, d, [op]))
        made, at = [], 0
        for c, d, held in parts if self.coded is not None else []:
            key = (c, d, *held)
            code = self._edited.get(key)
            if code is None:
                new, begin = [], c
                for s, e, t in held:
                    new += [text[begin:s], t]
                    begin = e
                code = self._edited[key] = self._coded("".join([*new, text[begin:d]]))
            if code is None:
                made = None
                break
            made += [self.coded[at : self._before(c)], code]
            at = self._before(d)
        if made is None or self.coded is None:
            both = self.tokens, TOKEN.findall(result), 0
        else:
            made.append(self.coded[at:])
            both = self.coded, "".join(made), sum(map(len, made[::2]))
        self._read = (result, ops, both)
        return both

    @cached_property
    def spans(self) -> list[tuple[int, int, str, str]]:
        return structure.spans_of(self.text, self.media_type)

    @cached_property
    def shape(self) -> list[str]:
        return [k for k, *_ in structure.blocks_of(self.text, self.media_type)]

    def keeps_shape(self, result: str, ops: list[tuple[int, int, str]]) -> bool:
        """Whether the result of sorted edits has the document's block kinds; edits within lines that stay non-blank keep those of a plain text."""
        if self.media_type == "text/plain" and all(self._within_lines(result, ops)):
            return True
        return self.shape == [k for k, *_ in structure.blocks_of(result, self.media_type)]

    def _within_lines(self, result: str, ops: list[tuple[int, int, str]]) -> Iterator[bool]:
        text, moved = self.text, 0
        for s, e, t in ops:
            old = text[s:e]
            room = min(len(old), len(t))
            first = select.same_from(old, 0, t, 0, room)
            last = select.same_end(old, len(old), t, len(t), room - first)
            yield "\n" not in old[first : len(old) - last] and "\n" not in t[first : len(t) - last]
            yield all(x[x.rfind("\n", 0, at) + 1 : (x.find("\n", at) + 1 or len(x) + 1) - 1].strip() for x, at in ((text, s + first), (result, s + moved + first)))
            moved += len(t) - (e - s)


def gates_of(text, ops, regions, media_type, limits, entailment, facts: _Facts | None = None) -> list[tuple[str, str, bool, str]]:
    """(gate, status, hard, reason) of one candidate; a failure to apply ends the list."""
    facts = facts or _Facts(text, media_type)
    at, previous, why = 0, None, ""
    for s, e, t in sorted(ops):
        if not 0 <= s <= e <= len(text):
            why = "out of bounds"
        elif previous and s < previous[1]:
            why = "overlap"
        elif previous and s == e == previous[0] == previous[1]:
            why = "two insertions in one place"
        previous = (s, e)
    parts = []
    if not why:
        for s, e, t in sorted(ops):
            parts += [text[at:s], t]
            at = e
        result = "".join([*parts, text[at:]])
        try:
            result.encode()
        except UnicodeEncodeError:
            why = "not encodable"
    if why:
        return [(GATES[0], "failed", True, why)]
    out = [(GATES[0], "passed", True, "")]
    local = all(any(a <= s and e <= b for a, b in regions) for s, e, _ in ops)
    out.append((GATES[1], "passed" if local else "failed", True, "" if local else "an operation left its region"))
    n = max(1, len(text))
    a, b, kept = facts.tokens_of(result, sorted(ops))
    over = [
        name
        for name, beyond in (
            ("character edit ratio", (min(1.0, sum(max(e - s, len(t)) for s, e, t in ops) / n) if ops else 0.0) > limits[0]),
            ("token edit ratio", exceeds(a, b, limits[1], kept)),
            ("length drift", abs(len(result) - len(text)) / n > limits[2]),
        )
        if beyond
    ]
    out.append((GATES[2], "failed" if over else "passed", True, ", ".join(over)))
    broken = ""
    for a, b, kind, _ in facts.spans:
        moved = a + sum(len(t) - (e - s) for s, e, t in ops if e <= a)
        touched = any((s < b and a < e) or (s == e and a < s < b) for s, e, _ in ops)
        if touched or result[moved : moved + b - a] != text[a:b]:
            broken = f"{kind} at {a}:{b}"
            break
    out.append((GATES[3], "failed" if broken else "passed", True, broken))
    same = facts.keeps_shape(result, sorted(ops))
    out.append((GATES[4], "passed" if same else "failed", True, "" if same else "block kinds changed"))
    out.append((GATES[5], "unavailable", entailment, "no semantic adapter"))
    out += [("style", "unavailable", False, ""), ("fluency", "unavailable", False, "")]
    return out


def gates(candidates: DataFrame, limits: tuple[float, float, float] = (0.2, 0.25, 0.1), media_type: str = "text/plain", entailment: bool = False) -> DataFrame:
    """doc_id, candidate_id, gate_no, gate, status, hard, reason. candidates: doc_id, candidate_id, text, ops, regions (start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = _Facts("", media_type)
        for batch in batches:
            at, rows = [], []
            for i, (text, ops, regions) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "ops", "regions")), strict=True)):
                if text != facts.text:
                    facts = _Facts(text, media_type)
                got = gates_of(text, [(o["start"], o["end"], o["text"]) for o in ops], [(r["start"], r["end"]) for r in regions], media_type, limits, entailment, facts)
                at += [i] * len(got)
                rows += [(k, *g) for k, g in enumerate(got)]
            take = pa.array(at, pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("candidate_id").take(take), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "candidate_id", "gate_no", "gate", "status", "hard", "reason"],
            )

    return candidates.select("doc_id", "candidate_id", "text", "ops", "regions").mapInArrow(
        run, "doc_id bigint, candidate_id string, gate_no int, gate string, status string, hard boolean, reason string"
    )


def reports(gate_rows: DataFrame) -> DataFrame:
    """doc_id, candidate_id, passed, rejection (the first hard gate that did not pass)."""
    bad = F.col("hard") & (F.col("status") != "passed")
    why = F.min_by(F.concat_ws(": ", "gate", F.nullif("reason", F.lit(""))), F.when(bad, F.col("gate_no")))
    return gate_rows.groupBy("doc_id", "candidate_id").agg((~F.bool_or(bad)).alias("passed"), why.alias("why"), F.bool_or(bad).alias("bad")).select(
        "doc_id", "candidate_id", "passed", F.when(F.col("bad"), F.col("why")).alias("rejection")
    )


def content_hash(texts: DataFrame) -> DataFrame:
    """doc_id, content_hash: SHA-256 of the NFC text, the identity of a candidate."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [hashlib.sha256(unicodedata.normalize("NFC", t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(h)], ["doc_id", "content_hash"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, content_hash string")


def applied(candidates: DataFrame) -> DataFrame:
    """candidates with the text that their operations give."""
    return candidates.withColumn("result", operations.apply("text", F.array_sort("ops")))
