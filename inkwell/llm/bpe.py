"""BPE encoding and decoding with a transducer lexicon of frequent words.

The vocabulary used here drops white space, so a text's ids are the ids of its
white-space-free words one after another. Frequent words (counted over all
texts) and their ids are compiled into a minimal acyclic transducer, which
workers map into memory; words that it lacks are merged exactly, many at once
(``merges``); words in unusual scripts, very long ones and those that hold a
special string go to the tokenizers library. Each worker remembers recent words in a table of bounded size.

White space is what the tokenizer's pattern takes for it (the Unicode
White_Space property); Python's split() also splits at U+001C..U+001F, so texts
with those take a pattern of their own.

Defined results: a null text counts as empty (no ids, empty decoded text);
special strings inside texts become their special ids, as in the library;
repeated rows give a row each; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import by_bytes, with_text, worker_state
from inkwell.llm.lexicon import Lexicon, compile_lexicon
from inkwell.llm.merges import BatchBPE, is_plain, pieces_of_lines
from inkwell.llm.tokens import load_tokenizer

#: The characters of the Unicode White_Space property.
_WHITE = re.compile("[\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

#: Words that the lexicon holds, and the longest one in bytes: they bound the broadcast.
LEXICON_WORDS = 1 << 18
LEXICON_WORD_BYTES = 64


def words_of(text: str) -> list[str]:
    """The white-space-free words of a text, in order."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [w for w in _WHITE.split(text) if w]
    return text.split()


class Encoder:
    """Encodes words: recent words, then the lexicon, then exact merges by the library."""

    def __init__(self, tokenizer_path: str, lexicon: bytes | None = None, memo_words: int = 300_000) -> None:
        self.tok = load_tokenizer(tokenizer_path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.memo: dict[str, bytes] = {}
        self.memo_words = memo_words
        added = self.tok.get_added_tokens_decoder()
        self.stop_id, stop = next((i, t) for i, t in sorted(added.items()) if t.special and not (t.lstrip or t.rstrip or t.single_word))
        self.stop = stop.content
        self.specials = [t.content for t in added.values()]
        self.batch = BatchBPE.of(self.tok)
        self._strings: list[str] | None = None

    def merge(self, words: list[str]) -> list[bytes]:
        """Exact ids of words: in batches by rank where the form allows it, else by the library."""
        if self.batch is None:
            return self._library(words)
        text = "\n".join(words)
        if not is_plain(text) or any(t in text for t in self.specials):
            odd = [w for w in words if not is_plain(w) or any(t in w for t in self.specials)]
            apart = dict(zip(odd, self._library(odd), strict=True))
            words, every = [w for w in words if w not in apart], words
            text = "\n".join(words)
            got = dict(zip(words, self._plain(text), strict=True)) if words else {}
            return [apart[w] if w in apart else got[w] for w in every]
        return self._plain(text) if words else []

    def _plain(self, text: str) -> list[bytes]:
        """Ids of the plain words of text, which stand a line each."""
        parts = pieces_of_lines(text)
        new = set(parts)
        new.discard("\n")
        short = [p for p in new if len(p) <= BatchBPE.LONGEST // 2]  # two bytes a sign at most
        ids = dict(zip(short, self.batch.merge("\n".join(short).encode().split(b"\n") if short else []), strict=True))
        if len(short) < len(new):
            long = [p for p in new if len(p) > BatchBPE.LONGEST // 2]
            ids.update(zip(long, self._library(long), strict=True))
        ids["\n"] = b"\xff\xff\xff\xff"
        raw = b"".join(map(ids.__getitem__, parts))
        cuts = np.nonzero(np.frombuffer(raw, "<u4") == 0xFFFFFFFF)[0].tolist()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(raw) // 4], strict=True)]

    def _library(self, words: list[str]) -> list[bytes]:
        """Ids of words by the library: one text for many words, parted by a special token."""
        plain = [w for w in words if not any(s in w for s in self.specials)]
        got: dict[str, bytes] = {}
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast([self.stop.join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.nonzero(ids == self.stop_id)[0].tolist()
            if len(cuts) != len(some) - 1:
                raise AssertionError("the parting token was not kept apart")
            raw, begin = ids.tobytes(), 0
            for w, end in zip(some, [*cuts, len(ids)], strict=True):
                got[w] = raw[4 * begin : 4 * end]
                begin = end + 1
        return [got[w] if w in got else np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]

    def learn(self, new: list[str]) -> None:
        if self.lexicon is not None:
            found = self.lexicon.lookup([w.encode() for w in new])
            left = []
            for w, ids in zip(new, found, strict=True):
                if ids is None:
                    left.append(w)
                else:
                    self.memo[w] = ids
            new = left
        if new:
            self.memo.update(zip(new, self.merge(new), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        words = [words_of(t) if t else [] for t in texts]
        if len(self.memo) > self.memo_words:
            self.memo.clear()
        now = set().union(*words)
        new = list(now.difference(self.memo))
        if new:
            self.learn(new)
        get = self.memo.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def decode(self, ids: bytes) -> str:
        """The library's decode without a decoder: the tokens' strings with a space between them."""
        if self._strings is None:
            if self.tok.decoder is not None:
                raise ValueError("this tokenizer has a decoder of its own")
            vocab = self.tok.get_vocab(with_added_tokens=True)
            strings = [""] * (max(vocab.values()) + 1)
            for s, i in vocab.items():
                strings[i] = s
            self._strings = strings
        return " ".join(map(self._strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def worker_encoder(tokenizer_path: str, lexicon, memo_words: int = 300_000) -> Encoder:
    """One encoder per worker process and lexicon."""
    held = worker_state("bpe")
    key = (tokenizer_path, lexicon.id if lexicon is not None else None)
    if key not in held:
        held.clear()
        held[key] = Encoder(tokenizer_path, lexicon.value if lexicon is not None else None, memo_words)
    return held[key]


class BroadcastBlob:
    """A broadcast with an id that tells lexicons apart in a reused worker."""

    def __init__(self, spark, blob: bytes) -> None:
        self.id = hashlib.sha256(blob).hexdigest()
        self._b = spark.sparkContext.broadcast(blob)

    @property
    def value(self) -> bytes:
        return self._b.value


def word_counts(docs: DataFrame, text_col: str = "text", flush_words: int = 400_000) -> DataFrame:
    """word, n over all texts: counted in each task first, then summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return b

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(words_of(t))
                    if len(counts) > flush_words:
                        yield out()
        if counts:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text", max_words: int = LEXICON_WORDS) -> BroadcastBlob:
    """Compile the most frequent words of all texts with their ids.

    A word goes in if it makes up the texts' bytes / (2 max_words) in number or
    more. Since a word and its space take two bytes at least, there are at most
    ``max_words`` such words; with at most 64 bytes each, the broadcast is
    bounded whatever the corpus. All other words are merged exactly.
    """
    size = docs.agg(F.sum(F.octet_length(text_col) + 1).alias("n")).first()["n"] or 0
    often = word_counts(docs, text_col).filter((F.col("n") * max_words * 2 >= size) & (F.octet_length("word") <= LEXICON_WORD_BYTES))
    top = often.select("word").toPandas()["word"].tolist()
    ids = Encoder(tokenizer_path).merge(top)
    blob = compile_lexicon({w.encode(): np.frombuffer(i, "<u4").tolist() for w, i in zip(top, ids, strict=True)})
    return BroadcastBlob(docs.sparkSession, blob)


def encode(docs: DataFrame, tokenizer_path: str, lexicon: BroadcastBlob | None = None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(tokenizer_path, lexicon)
        for batch in by_bytes(batches, "text", batch_bytes):
            ids = enc.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    src = with_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text decoded from ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(tokenizer_path, None)
        for batch in by_bytes(batches, "ids", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([enc.decode(i or b"") for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    src = encoded.select(F.col(id_col).alias("doc_id"), "ids")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, lexicon: BroadcastBlob | None = None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """Encode and decode every text in one pass and return digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(tokenizer_path, lexicon)
        for batch in by_bytes(batches, "text", batch_bytes):
            ids = enc.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(i).encode()).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = with_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
