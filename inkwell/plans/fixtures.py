"""Deterministic material for the queries: texts with carriers put in, candidate tables, files made from bytes."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What goes into the documents after ten characters, by doc_id modulo the number of entries.
INSERTS = (
    "a​b", "\U0001f468‍\U0001f469", "می‌خو", "f‮c", "سلام‏", "q‏z", "❤️", "x️y", "k k", "n n", "s­h", "b\u0007b", "pp",
    "r�r", "Café", " pаypal ", "t\U000e0041t", "\U0001f3f4\U000e0067\U000e0062\U000e007f",
    " see https://ex.org/a?b=1, www.ex.org/x and a.b@ex.co on 2024-03-05 or May 4, 2021; 42% of 1.5 kg cost $3 million [12] (Smith, 2020) get_id() v1.2.3 “quoted words” ",
)


def inserted(docs: DataFrame) -> DataFrame:
    """documents with an insert each."""
    text = None
    for r, s in enumerate(INSERTS):
        new = F.concat(F.substring("text", 1, 10), F.lit(s), F.substring(F.col("text"), F.lit(11), F.length("text")))
        hit = F.col("doc_id") % len(INSERTS) == r
        text = F.when(hit, new) if text is None else text.when(hit, new)
    return docs.withColumn("text", text)


def inserted_sql() -> str:
    cases = " ".join(f"WHEN doc_id % {len(INSERTS)} = {r} THEN substr(text, 1, 10) || '{s}' || substr(text, 11)" for r, s in enumerate(INSERTS))
    return f"SELECT doc_id, lang, source, CASE {cases} END AS text FROM documents"


def candidate_rows(docs: DataFrame, per_doc: int = 6) -> DataFrame:
    """Candidates with made-up, exact measures (sixteenths) for each document."""
    c = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(per_doc - 1))).alias("idx"))
    m = lambda a, b, k: ((F.col("doc_id") * a + F.col("idx") * b) % k).cast("double") / 16.0
    return c.withColumns({
        "candidate_id": F.concat_ws("-", F.col("doc_id").cast("string"), F.col("idx").cast("string")), "valid": (F.col("doc_id") + F.col("idx")) % 4 != 0, "target_met": (F.col("doc_id") + 2 * F.col("idx")) % 3 == 0,
        "char_ratio": m(3, 5, 8), "token_ratio": m(5, 3, 8), "drift": m(2, 7, 4), "risk": m(7, 11, 16), "model_calls": (F.col("idx") % 3).cast("long"), "detector_queries": ((F.col("doc_id") + F.col("idx")) % 2).cast("long"),
        "cost_usd": m(1, 1, 4), "content_hash": F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("idx") % 4).cast("string")), 256), "n_ops": (F.col("idx") + 1).cast("long"),
    })


def candidate_sql(per_doc: int = 6) -> str:
    m = lambda a, b, k: f"CAST((doc_id * {a} + idx * {b}) % {k} AS DOUBLE) / 16.0"
    return f"""SELECT doc_id, idx, doc_id || '-' || idx AS candidate_id, (doc_id + idx) % 4 <> 0 AS valid, (doc_id + 2 * idx) % 3 = 0 AS target_met,
        {m(3, 5, 8)} AS char_ratio, {m(5, 3, 8)} AS token_ratio, {m(2, 7, 4)} AS drift, {m(7, 11, 16)} AS risk, CAST(idx % 3 AS BIGINT) AS model_calls,
        CAST((doc_id + idx) % 2 AS BIGINT) AS detector_queries, {m(1, 1, 4)} AS cost_usd, sha256(doc_id || ':' || (idx % 4)) AS content_hash, CAST(idx + 1 AS BIGINT) AS n_ops
        FROM documents, (SELECT unnest(range({per_doc})) AS idx)"""


def _png(*extra: tuple[bytes, bytes]) -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(chunk(k, b) for k, b in extra) + chunk(b"IDAT", zlib.compress(b"\0\0\0\0")) + chunk(b"IEND", b"")


def _exif(*tags: tuple[int, bytes]) -> bytes:
    at = 8 + 2 + 12 * len(tags) + 4
    entries, data = b"", b""
    for tag, value in tags:
        entries += struct.pack("<HHII", tag, 2, len(value), at + len(data))
        data += value
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + data


def _jpeg(*segments: tuple[int, bytes]) -> bytes:
    seg = lambda m, b: bytes((0xFF, m)) + struct.pack(">H", len(b) + 2) + b
    return b"\xff\xd8" + b"".join(seg(m, b) for m, b in segments) + seg(0xC0, b"\x08\0\x01\0\x01\x01\x01\x11\0") + seg(0xDA, b"\x01\x01\0\0\x3f\0") + b"\x12\xff\0\x34\xff\xd9"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def file_bytes() -> list[tuple[str, bytes, str]]:
    """(name, content, expected state) of small files of every kind."""
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>Ann</dc:creator></cp:coreProperties>'
    return [
        ("plain.png", _png(), "not_detected"),
        ("software.png", _png((b"tEXt", b"Software\0Claude"), (b"tEXt", b"Copyright\0Ann")), "unsigned_ai_metadata"),
        ("author.png", _png((b"tEXt", b"Author\0Ann")), "embedded_metadata"),
        ("packed.png", _png((b"zTXt", b"parameters\0\0" + zlib.compress(b"steps 20"))), "unsigned_ai_metadata"),
        ("manifest.png", _png((b"caBX", b"jumb c2pa")), "unknown"),
        ("bound.png", _png((b"tEXt", b"Comment\0softbinding x")), "soft_binding_declared"),
        ("exif.jpg", _jpeg((0xE1, b"Exif\0\0" + _exif((0x013B, b"Ann\0"), (0x0132, b"2024:01:01\0")))), "embedded_metadata"),
        ("plain.jpg", _jpeg(), "not_detected"),
        ("comment.jpg", _jpeg((0xFE, b"made with ai")), "unsigned_ai_metadata"),
        ("info.pdf", b"%PDF-1.4\n1 0 obj<</Producer (OpenAI) /Author (Ann)>>endobj", "unsigned_ai_metadata"),
        ("author.docx", _zip({"word/document.xml": "<w/>", "docProps/core.xml": core}), "embedded_metadata"),
        ("drawing.svg", b"<svg xmlns='s'><metadata><creator>Midjourney</creator></metadata></svg>", "unsigned_ai_metadata"),
        ("broken.png", b"\x89PNG\r\n\x1a\n\0\0\0\x05tEXtab", "unknown"),
        ("noise.bin", b"\0\1\2\3", "unsupported"),
    ]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, bytearray(b)) for n, b, _ in file_bytes()], "path string, content binary")
