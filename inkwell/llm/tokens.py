"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are encoded by the ``tokenizers`` library. A worker receives Arrow
batches, cuts them to about ``batch_bytes`` of text each, splits longer texts
at safe boundaries and encodes all parts of a batch in one call, so that a few
very long texts neither stall a call nor hold many token objects at once. Only
the number of tokens leaves the worker.

Safe boundary: the place before a single space that stands between two ASCII
letters. The byte-level pre-tokenizer always starts a new piece there (a piece
is an optional space and a run of letters, digits or other signs), merges never
cross pieces, and no special token of these vocabularies holds a space, so the
parts' counts add up to the text's count exactly.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty
table gives no rows; repeated rows and ids give a row each; other columns of
the input are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import by_bytes, with_text

#: A space between ASCII letters; the part after it starts with the space.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

_TOKENIZERS: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of ``path``, once per worker, without truncation, padding or own threads."""
    tok = _TOKENIZERS.get(path)
    if tok is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _TOKENIZERS[path] = tok
    return tok


def safe_parts(text: str, limit: int) -> list[str]:
    """Cut text into parts of about ``limit`` characters at safe boundaries; joined they give the text.

    Where no boundary follows (text without spaces, other scripts) a part stays as long as it is.
    """
    if len(text) <= limit:
        return [text]
    parts, start = [], 0
    while len(text) - start > limit:
        m = _SAFE.search(text, start + limit)
        if m is None:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    parts.append(text[start:])
    return parts


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 1 << 20,
    part_chars: int = 1 << 16,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer_path)
        for batch in by_bytes(batches, "text", batch_bytes):
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            parts: list[str] = []
            owner: list[int] = []
            held = 0

            def flush() -> None:
                nonlocal held
                for i, e in zip(owner, tok.encode_batch_fast(parts, add_special_tokens=False), strict=True):
                    counts[i] += len(e)
                parts.clear()
                owner.clear()
                held = 0

            for i, text in enumerate(texts):
                for part in safe_parts(text, part_chars) if text else ():
                    parts.append(part)
                    owner.append(i)
                    held += len(part)
                    if held >= batch_bytes:
                        flush()
            if parts:
                flush()
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    src = with_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def over_limit(counts: DataFrame, limit: int = 1024) -> DataFrame:
    """Mark rows whose count exceeds a model's context."""
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
