"""Metadata evidence in image, office and PDF files, read from bytes.

One Arrow function turns (path, content) into evidence rows. The type comes
from the bytes, never from the name; every parser is bounded in size, count and
depth. Only metadata is parsed, no pixel or page is decoded.

Cleaning (``clean``) drops identifying fields of PNG, JPEG, PDF and office files
and keeps the rest byte for byte; the result is inspected again and published
only if the digest of what it shows (pixels, scan, pages, parts) is unchanged
and no removable evidence survives. Provenance manifests (C2PA) are reported
and never removed.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import metadata

MOST_BYTES = 50 << 20
MOST_CHUNKS = 10_000
MOST_INFLATED = 1 << 20
MOST_IFDS, MOST_ENTRIES = 32, 4096
MOST_NODES = 100_000
PNG = b"\x89PNG\r\n\x1a\n"
#: EXIF tags with free text or personal data, and the keys of PNG and PDF fields.
EXIF_TEXT = {0x010E: "ImageDescription", 0x0131: "Software", 0x9286: "UserComment"}
EXIF_PRIVATE = {0x010F: "Make", 0x0110: "Model", 0x0132: "DateTime", 0x013B: "Artist", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA435: "LensSerialNumber"}
PNG_PRIVATE = ("author", "creation time", "software", "source", "comment", "description", "title")
PNG_LEGAL = ("copyright", "disclaimer", "license", "licence", "warning")
PDF_FIELD = re.compile(rb"/(Creator|Producer|Author|CreationDate|ModDate|ModificationDate|CreatorTool|AIGC|AIGenerated|DigitalSourceType)\s*\(((?:[^\\()]|\\.)*)\)", re.I)
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

Row = tuple[str, str, str, str]  # kind, place, key, value


def sniff(data: bytes) -> str:
    """The media type by its first bytes, or unsupported."""
    head = data[:4096]
    if head.startswith(PNG):
        return "png"
    if head.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    if head.startswith(b"%PDF-"):
        return "pdf"
    if head.startswith(b"PK\x03\x04"):
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()[:MOST_CHUNKS]
        except zipfile.BadZipFile:
            return "unsupported"
        return "docx" if "word/document.xml" in names else "odt" if "content.xml" in names and "mimetype" in names else "unsupported"
    if re.search(rb"<(?:[A-Za-z_][\w.-]*:)?svg(?:\s|>)", head, re.I):
        return "svg"
    if re.search(rb"<(?:!doctype\s+html|html|head|body)\b", head, re.I):
        return "html"
    if head.startswith(b"---\n") or head.startswith(b"---\r\n"):
        return "markdown"
    return "unsupported"


def _telling(key: str, value: bytes) -> bool:
    k, low = key.strip().lower().replace(" ", "_"), value.lower()
    markers = metadata.VENDOR_VALUES + metadata.PROVENANCE_VALUES
    return k in metadata.TOOL_KEYS or "c2pa" in k or "aigc" in k or any(m.encode() in low for m in markers)


def _judge(place: str, key: str, value: bytes, private: bool) -> list[Row]:
    out: list[Row] = []
    text = value[:200].decode("utf-8", "replace")
    low = value.lower()
    if any(m.encode() in low for m in metadata.SOFT_BINDINGS):
        out.append(("soft_binding_declared", place, key, text))
    if _telling(key, value):
        out.append(("unsigned_ai_metadata", place, key, text))
    elif private:
        out.append(("embedded_metadata", place, key, text))
    return out


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, payload) of a PNG; a broken checksum or length is an error."""
    out, at = [], len(PNG)
    while at < len(data):
        if len(out) == MOST_CHUNKS:
            raise ValueError("png has too many chunks")
        if at + 12 > len(data):
            raise ValueError("png ends inside a chunk")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("png chunk is broken")
        if not out and kind != b"IHDR":
            raise ValueError("png does not start with its header")
        out.append((kind, body))
        at += 12 + n
        if kind == b"IEND":
            break
    return out


def inflate(data: bytes, most: int = MOST_INFLATED) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, most)
    if d.unconsumed_tail:
        raise ValueError("inflates beyond its bound")
    return out


def png_text(kind: bytes, body: bytes) -> tuple[str, bytes] | None:
    """Key and value of a text chunk."""
    key, _, rest = body.partition(b"\0")
    if kind == b"tEXt":
        return key.decode("latin-1"), rest
    if kind == b"zTXt":
        return key.decode("latin-1"), inflate(rest[1:])
    if kind == b"iTXt" and len(rest) >= 2:
        packed, tail = rest[0], rest[2:].split(b"\0", 2)
        if len(tail) == 3:
            return key.decode("latin-1"), inflate(tail[2]) if packed else tail[2]
    return None


def exif(tiff: bytes) -> list[tuple[int, bytes]]:
    """(tag, value bytes) of all directories; bounded, and a directory is read once."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return []
    magic, first = struct.unpack(order + "HI", tiff[2:8])
    out, todo, seen = [], [first] if magic == 42 else [], set()
    while todo and len(seen) < MOST_IFDS:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        n = min(struct.unpack(order + "H", tiff[at : at + 2])[0], MOST_ENTRIES)
        for i in range(n):
            e = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(e) < 12:
                break
            tag, kind, count = struct.unpack(order + "HHI", e[:8])
            size = TYPE_SIZE.get(kind, 0) * count
            place = struct.unpack(order + "I", e[8:12])[0]
            value = e[8 : 8 + size] if size <= 4 else tiff[place : place + size]
            out.append((tag, value))
            if tag in (0x8769, 0x8825):
                todo.append(place)
        tail = tiff[at + 2 + 12 * n : at + 6 + 12 * n]
        if len(tail) == 4 and (nxt := struct.unpack(order + "I", tail)[0]):
            todo.append(nxt)
    return out


def _exif_rows(tiff: bytes) -> list[Row]:
    out: list[Row] = []
    for tag, value in exif(tiff):
        name = EXIF_TEXT.get(tag) or EXIF_PRIVATE.get(tag) or ("GPS" if tag == 0x8825 else None)
        if name:
            out += _judge("exif", name, value.rstrip(b"\0"), tag in EXIF_PRIVATE or tag == 0x8825)
    return out


def jpeg_segments(data: bytes) -> list[tuple[int, bytes]]:
    """(marker, payload) up to the scan."""
    out, at = [], 2
    while at + 4 <= len(data):
        if len(out) == MOST_CHUNKS:
            raise ValueError("jpeg has too many segments")
        if data[at] != 0xFF:
            raise ValueError("jpeg marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            break
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        out.append((marker, data[at + 4 : at + 2 + n]))
        at += 2 + n
    return out


def _xml_rows(place: str, data: bytes) -> list[Row]:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("xml declares a type or entity")
    out: list[Row] = []
    nodes = list(ET.fromstring(data).iter())
    if len(nodes) > MOST_NODES:
        raise ValueError("xml has too many nodes")
    for e in nodes:
        key = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
        private = key.lower() in ("creator", "lastmodifiedby", "initial-creator", "generator", "created", "modified", "creation-date", "date", "author", "application", "company")
        for k, v in [(key, e.text or ""), *((a.rsplit("}", 1)[-1], v) for a, v in e.attrib.items())]:
            if v.strip():
                out += _judge(place, k, v.encode(), private and k == key)
    return out


def _html_rows(page: str) -> list[Row]:
    """What metadata.html_evidence says, for one file."""
    telling, private = re.compile(metadata.AI_LINE), re.compile(metadata.PRIVATE_META)
    metas = re.findall(metadata.META, page)
    linked = [v for v in re.findall(metadata.JSON_LD, page) if telling.search(v)]
    data_ai = [m.group() for m in re.finditer(metadata.DATA_AI, page)]
    rows = [("unsigned_ai_metadata", "html", "meta", v) for v in metas if telling.search(v)]
    rows += [("unsigned_ai_metadata", "html", "json-ld", v) for v in linked] + [("unsigned_ai_metadata", "html", "data-ai", v) for v in data_ai]
    return rows + [("embedded_metadata", "html", "meta", v) for v in metas if private.search(v)]


def _front_rows(text: str) -> list[Row]:
    """What metadata.front_lines says, for one file."""
    front = re.match(metadata.FRONT, text)
    rows: list[Row] = []
    for line in front[1].splitlines() if front else ():
        key = line.split(":", 1)[0].strip().lower().replace("-", "_").replace(" ", "_")
        if re.search(metadata.AI_LINE, line):
            rows.append(("unsigned_ai_metadata", "frontmatter", key, line))
        elif key in metadata.PRIVATE_KEYS:
            rows.append(("embedded_metadata", "frontmatter", key, line))
    return rows


def evidence_of(data: bytes) -> tuple[str, list[Row]]:
    """The type and the evidence of one file; what can't be read is evidence of kind unknown."""
    kind = sniff(data)
    if kind == "unsupported" or len(data) > MOST_BYTES:
        return kind, [("unsupported", "file", "", "")]
    rows: list[Row] = []
    try:
        if kind == "png":
            for name, body in png_chunks(data):
                if name == b"caBX":
                    rows.append(("unknown", "png:caBX", "c2pa", ""))
                elif name == b"eXIf":
                    rows += _exif_rows(body)
                elif (kv := png_text(name, body)) is not None and kv[0].lower() not in PNG_LEGAL:
                    rows += _judge(f"png:{name.decode()}", kv[0], kv[1], kv[0].lower() in PNG_PRIVATE)
        elif kind == "jpeg":
            for marker, body in jpeg_segments(data):
                if marker == 0xE1 and body.startswith(b"Exif\0\0"):
                    rows += _exif_rows(body[6:])
                elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                    rows += _xml_rows("xmp", body[29:])
                elif marker == 0xEB and b"c2pa" in body.lower():
                    rows.append(("unknown", "jpeg:APP11", "c2pa", ""))
                elif marker == 0xED:
                    rows += _judge("jpeg:APP13", "iptc", body, False)
                elif marker == 0xFE:
                    rows += _judge("jpeg:COM", "comment", body, True)
        elif kind == "pdf":
            if b"jumb" in data.lower() and b"c2pa" in data.lower():
                rows.append(("unknown", "pdf", "c2pa", ""))
            for key, value in PDF_FIELD.findall(data):
                rows += _judge("pdf:Info", key.decode(), value, True)
        elif kind in ("docx", "odt"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if len(z.infolist()) > MOST_CHUNKS:
                    raise ValueError("zip has too many parts")
                for info in z.infolist():
                    if info.filename.startswith(("docProps/", "customXml/")) or info.filename == "meta.xml":
                        if info.file_size > MOST_INFLATED:
                            raise ValueError("part inflates beyond its bound")
                        rows += _xml_rows(f"zip:{info.filename}", z.read(info))
        elif kind == "html":
            rows += _html_rows(data.decode("utf-8-sig"))
        elif kind == "markdown":
            rows += _front_rows(data.decode("utf-8-sig"))
        elif kind == "svg":
            if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
                raise ValueError("a DTD is not read")
            for e in ET.fromstring(data).iter():
                if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] == "metadata":
                    rows += _xml_rows("svg:metadata", ET.tostring(e))
    except (ValueError, ET.ParseError, zlib.error, struct.error, zipfile.BadZipFile, RecursionError) as e:
        rows.append(("unknown", kind, "unreadable", str(e)))
    return kind, rows


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, out = [], []
        for i, data in enumerate(batch.column("content").to_pylist()):
            media, rows = evidence_of(data or b"")
            got = [(n, media, *r) for n, r in enumerate(rows)] or [(0, media, "not_detected", "", "", "")]
            at += [i] * len(got)
            out += got
        cols = zip(*out, strict=True) if out else [[]] * 6
        kinds = [pa.int32(), *[pa.string()] * 5]
        yield pa.RecordBatch.from_arrays(
            [batch.column("path").take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["path", "number", "media_type", "kind", "place", "key", "value"]
        )


def evidence(files: DataFrame) -> DataFrame:
    """path, number, media_type, kind, place, key, value: a row per finding, or one with not_detected. files: path, content."""
    return files.select("path", "content").mapInArrow(_run, "path string, number int, media_type string, kind string, place string, key string, value string")


def states(files: DataFrame) -> DataFrame:
    """path, media_type, state of every file."""
    e = evidence(files)
    kinds = e.groupBy("path").agg(F.first("media_type").alias("media_type"))
    return metadata.state(e, kinds, "path").join(kinds, "path").select("path", "media_type", "state")


def _pixels(data: bytes) -> str:
    h = hashlib.sha256()
    for kind, body in png_chunks(data):
        if kind in (b"IHDR", b"PLTE", b"tRNS", b"IDAT", b"gAMA", b"cHRM", b"sRGB", b"iCCP"):
            h.update(kind + body)
    return h.hexdigest()


def clean_png(data: bytes) -> bytes | None:
    """The file without identifying fields, if its pixels are the same and none of them is left; else None."""
    parts = [PNG]
    for kind, body in png_chunks(data):
        if kind == b"eXIf" and _exif_rows(body):
            continue
        kv = png_text(kind, body)
        if kv and kv[0].lower() not in PNG_LEGAL and _judge("", kv[0], kv[1], kv[0].lower() in PNG_PRIVATE):
            continue
        parts.append(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))
    out = b"".join(parts)
    left = [r for r in evidence_of(out)[1] if r[0] != "unknown"]
    return out if _pixels(out) == _pixels(data) and not left else None


def _published(data: bytes, out: bytes, shown) -> bytes | None:
    left = [r for r in evidence_of(out)[1] if r[0] != "unknown"]
    return out if shown(out) == shown(data) and not left else None


def _scan(data: bytes) -> bytes:
    """A JPEG from its first frame or table segment that is no metadata."""
    at, kept = 2, []
    for marker, body in jpeg_segments(data):
        if not 0xE0 <= marker <= 0xEF and marker != 0xFE:
            kept.append(bytes((marker,)) + body)
        at += 4 + len(body)
    return b"".join(kept) + data[at:]


def clean_jpeg(data: bytes) -> bytes | None:
    out, at = [data[:2]], 2
    for marker, body in jpeg_segments(data):
        raw = data[at : at + 4 + len(body)]
        at += len(raw)
        private = marker in (0xE1, 0xED, 0xFE) and evidence_of(data[:2] + raw + b"\xff\xd9")[1]
        if not private:
            out.append(raw)
    return _published(data, b"".join([*out, data[at:]]), _scan)


def clean_pdf(data: bytes) -> bytes | None:
    """Values of identifying fields become spaces of the same length, so no offset moves."""
    blank = lambda m: m[0][: m.start(2) - m.start()] + b" " * len(m[2]) + m[0][m.end(2) - m.start() :]
    out = PDF_FIELD.sub(blank, data)
    rest = lambda d: PDF_FIELD.sub(b"", d)
    left = [r for r in evidence_of(out)[1] if r[3].strip()]
    return out if len(out) == len(data) and rest(out) == rest(data) and not left else None


def clean_office(data: bytes) -> bytes | None:
    """Parts of metadata lose the text of identifying elements; all other parts stay."""
    is_meta = lambda n: n.startswith(("docProps/", "customXml/")) or n == "meta.xml"
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as new:
        if len(z.infolist()) > MOST_CHUNKS or sum(info.file_size for info in z.infolist()) > MOST_INFLATED:
            return None
        for info in z.infolist():
            body = z.read(info)
            if is_meta(info.filename):
                if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
                    return None
                root = ET.fromstring(body)
                for e in root.iter():
                    if isinstance(e.tag, str) and e.text and _xml_rows("", _leaf(e)):
                        e.text = ""
                body = ET.tostring(root)
            new.writestr(info, body, info.compress_type)

    def shown(d: bytes) -> list[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(d)) as z:
            return [(n, z.read(n)) for n in z.namelist() if not is_meta(n)]

    return _published(data, out.getvalue(), shown)


def _leaf(e: ET.Element) -> bytes:
    x = ET.Element(e.tag.rsplit("}", 1)[-1])
    x.text = e.text
    return ET.tostring(x)


CLEANERS = {"png": clean_png, "jpeg": clean_jpeg, "pdf": clean_pdf, "docx": clean_office, "odt": clean_office}


def clean(files: DataFrame) -> DataFrame:
    """path, cleaned (null where refused or of another type)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("content").to_pylist():
                try:
                    cleaner = CLEANERS.get(sniff(data or b""))
                    out.append(cleaner(data) if cleaner else None)
                except (ValueError, ET.ParseError, struct.error, zlib.error, zipfile.BadZipFile, RecursionError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "cleaned"])

    return files.select("path", "content").mapInArrow(run, "path string, cleaned binary")
