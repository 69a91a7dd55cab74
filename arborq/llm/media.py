"""Media columns: signatures by Aho-Corasick, structure by format validators, carving, and lossless storage of bytes.

One automaton finds every magic number in a blob in one pass. At each hit the format's validator walks the
structure (chunk sizes, checksums, markers, end records) and gives the length, or rejects the hit. The valid hit that starts
at byte 0 and spans the blob corrects the declared type; the other valid hits are embedded media, those within another
medium too, and ``carve`` returns their bytes. End records of archives and documents are found in one pass over the blob. ``store`` writes bytes losslessly as the 8-bit samples of a WAV file and ``samples`` reads them back.

Results for odd inputs: a null or empty blob has no media, and its type is what was declared; a truncated file, or one
whose sizes or checksums are wrong, is no media; of hits at one place the longest counts; ``sniff`` leaves out what starts within
another medium, ``carve`` has it one level deeper;
repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

UNIT = 64
RATE = 8000


def _png(b: bytes, at: int) -> int | None:
    i = at + 8
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + size
        if end > len(b) or zlib.crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0] or (i == at + 8) != (kind == b"IHDR"):
            return None
        if kind == b"IEND":
            return end - at
        i = end
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    i, scans = at + 2, 0
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xFF:
            i += 1
            continue
        if kind == 0xD9:
            return i + 2 - at if scans else None
        size = struct.unpack_from(">H", b, i + 2)[0]
        if size < 2 or kind < 0xC0:
            return None
        i += 2 + size
        if kind == 0xDA:  # entropy-coded bytes: stuffed zeros and restarts belong to them
            scans += 1
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                    continue
                break
    return i + 2 - at if scans and b[i : i + 2] == b"\xff\xd9" else None


def _gif(b: bytes, at: int) -> int | None:
    def blocks(i):
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    if at + 13 > len(b):
        return None
    i = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            i = blocks(i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0))
        else:
            return None
    return None


def riff_chunks(b: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """Chunks of a RIFF file: name -> start and size of its contents; None where sizes do not fit."""
    if at + 12 > len(b):
        return None
    end, i, out = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, {}
    if end > len(b):
        return None
    while i + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, i)
        if i + 8 + size > end:
            return None
        out.setdefault(name, (i + 8, size))
        i += 8 + size + (size & 1)
    return out if i in (end, end + 1) else None


def _riff(need: tuple[bytes, ...], form: bytes):
    def length(b: bytes, at: int) -> int | None:
        if b[at + 8 : at + 12] != form:
            return None
        chunks = riff_chunks(b, at)
        return 8 + struct.unpack_from("<I", b, at + 4)[0] if chunks is not None and any(n in chunks for n in need) else None

    return length


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    return size if not reserved and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(b) - at else None


_TRAILER = re.compile(rb"startxref[\r\n ]+(\d{1,19})[\r\n ]+%%EOF(?:\r\n|\r|\n)?")


def _trailers(b: bytes, memo: dict) -> list[tuple[int, int, int]]:
    """(place, end, cross-reference offset) of all trailers of the blob, in order."""
    if "trailers" not in memo:
        memo["trailers"] = [(m.start(), m.end(), int(m[1])) for m in _TRAILER.finditer(b)]
    return memo["trailers"]


def _pdf(b: bytes, at: int, memo: dict) -> int | None:
    """To the last of the trailers that follow one another and whose offsets, from the header, lead to a cross-reference table or stream."""
    found, trailers = None, _trailers(b, memo)
    for place, end, offset in trailers[bisect.bisect_left(trailers, (at,)) :]:
        there = at + offset
        if not (at < there < place and (b[there : there + 4] == b"xref" or re.match(rb"\d+ \d+ obj", b[there : there + 24]))):
            break
        found = end - at
    return found


def _zip(b: bytes, at: int, memo: dict) -> int | None:
    """To the last end record whose sizes lead back to this header."""
    if "zips" not in memo:
        memo["zips"], end = {}, b.find(b"PK\5\6")
        while 0 <= end <= len(b) - 22:
            count, size, start, comment = struct.unpack_from("<HIIH", b, end + 10)
            first = end - size - start
            if first >= 0 and (not count or b[first + start : first + start + 4] == b"PK\1\2") and end + 22 + comment <= len(b):
                memo["zips"][first] = end + 22 + comment
            end = b.find(b"PK\5\6", end + 4)
    return memo["zips"][at] - at if at in memo["zips"] else None


def _gzip(b: bytes, at: int, step: int = 1 << 16) -> int | None:
    d, i = zlib.decompressobj(31), at
    try:
        while i < len(b) and not d.eof:
            rest = b[i : i + step]
            i += len(rest)
            while rest and not d.eof:  # bounded output: a small file may hold a very long one
                d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail
    except zlib.error:
        return None
    return i - at - len(d.unused_data) if d.eof else None


def _ogg(b: bytes, at: int) -> int | None:
    """From a first page to the last page of every stream that began: a page belongs to the stream of its serial number."""
    i, streams = at, set()
    while i + 27 <= len(b) and b[i : i + 4] == b"OggS" and not b[i + 4]:
        flags, serial, parts = b[i + 5], b[i + 14 : i + 18], b[i + 26]
        if bool(flags & 2) == (serial in streams):  # a first page of a stream that runs, or another page of one that does not
            return None
        streams.add(serial)
        i += 27 + parts + sum(b[i + 27 : i + 27 + parts])
        if flags & 4:
            streams.discard(serial)
            if not streams:
                return i - at if i <= len(b) else None
    return None


#: Magic bytes, media type, validator.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"RIFF", "audio/wav", _riff((b"data",), b"WAVE")),
    (b"RIFF", "image/webp", _riff((b"VP8 ", b"VP8L", b"VP8X"), b"WEBP")),
    (b"RIFF", "video/avi", _riff((b"LIST",), b"AVI ")),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\3\4", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
)
_automaton = None


def _machine():
    global _automaton
    if _automaton is None:
        a, by = ahocorasick.Automaton(), {}
        for i, (magic, _, _) in enumerate(SIGNATURES):
            by.setdefault(magic, []).append(i)
        for magic, which in by.items():
            a.add_word(magic.decode("latin-1"), (len(magic), which))
        a.make_automaton()
        _automaton = a
    return _automaton


#: Validators that look up end records found once a blob.
_WITH_ENDS = (_pdf, _zip)


def media_in(blob: bytes) -> list[tuple[str, int, int, int]]:
    """(type, start, length, depth) of all valid media in the blob, in order; depth counts the media that hold it."""
    out, ends, memo = [], [], {}
    for start, which in sorted((end + 1 - size, which) for end, (size, which) in _machine().iter(blob.decode("latin-1"))):
        tried = [(SIGNATURES[i][2](blob, start, memo) if SIGNATURES[i][2] in _WITH_ENDS else SIGNATURES[i][2](blob, start), SIGNATURES[i][1]) for i in which]
        found = [x for x in tried if x[0]]
        if found:
            size, kind = max(found)
            ends = [e for e in ends if e > start]
            out.append((kind, start, size, len(ends)))
            ends.append(start + size)
    return out


def sniff(blob: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of valid media in the blob, in order, none that starts within another."""
    return [m[:3] for m in media_in(blob) if not m[3]]


def corrected(blob: bytes, declared: str | None, media: list[tuple[str, int, int]]) -> str | None:
    """The type of the medium that the whole blob is; else what was declared."""
    return media[0][0] if media and media[0][1:] == (0, len(blob)) else declared


def store(payload: bytes) -> bytes:
    """The bytes as mono 8-bit samples of a WAV file."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4s4sIHHIIHH4sI", b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload) + len(pad)) + head + payload + pad


def samples(blob: bytes, start: int) -> bytes:
    """The sample bytes of the WAV file that starts there."""
    at, size = riff_chunks(blob, start)[b"data"]
    return blob[at : at + size]


def inspect(blobs: DataFrame, id_col: str, blob_col: str, declared_col: str | None = None) -> DataFrame:
    """Per row: id, type (corrected), media (array of type, start, length)."""
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    rows = blobs.select(F.col(id_col).alias("id"), F.col(blob_col).alias("blob"), declared.alias("declared"))
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def work(batches):
        for b in batches:
            types, media = [], []
            for x, d in zip(b.column(1), b.column(2), strict=True):
                blob = x.as_py() or b""
                found = sniff(blob)
                types.append(corrected(blob, d.as_py(), found))
                media.append([{"type": t, "start": s, "length": n} for t, s, n in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(types, pa.string()), pa.array(media, kind)], ["id", "type", "media"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, type string, media array<struct<type:string,start:bigint,length:bigint>>")


def carve(blobs: DataFrame, id_col: str, blob_col: str, out_bytes: int = 8 << 20) -> DataFrame:
    """One row for each medium in each blob: id, type, start, length, depth, bytes."""
    rows = blobs.select(F.col(id_col).alias("id"), F.col(blob_col).alias("blob"))
    names = ["id", "type", "start", "length", "depth", "bytes"]
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            kinds = [b.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            held, size = [], 0
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                blob = x.as_py() or b""
                for kind, start, n, depth in media_in(blob):
                    held.append((i, kind, start, n, depth, blob[start : start + n]))
                    size += n
                    if size > out_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(work, f"id {id_type}, type string, start long, length long, depth int, bytes binary")


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (the stored form of the padded text), type, payload (as read back from the sniffed medium), embedded (media in it)."""

    def work(batches):
        for b in batches:
            offsets, data = C.column_bytes(b.column(1))
            raw = data.tobytes()
            for i, j in C.windows(offsets, 8 << 20):
                media, types, back, inner = [], [], [], []
                for x, y in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True):
                    blob = store(raw[x:y] + bytes(-(y - x) % UNIT or (UNIT if x == y else 0)))
                    found = media_in(blob)
                    media.append(blob)
                    types.append(corrected(blob, "application/octet-stream", [m[:3] for m in found]))
                    back.append(samples(blob, found[0][1]))
                    inner.append(sum(m[3] > 0 for m in found))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(media, pa.binary()), pa.array(types), pa.array(back, pa.binary()), pa.array(inner, pa.int32())], ["doc_id", "n_bytes", "media", "type", "payload", "embedded"])

    rows = C.id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, type string, payload binary, embedded int")


def features(stored: DataFrame) -> DataFrame:
    """doc_id and what the media column's bytes and samples are: sizes, digests, and a line of sample statistics."""

    def work(batches):
        for b in batches:
            rows = []
            for media, kind, payload, inner in zip(b.column(2), b.column(3), b.column(4), b.column(5), strict=True):
                m, p = media.as_buffer().to_pybytes(), payload.as_buffer().to_pybytes()
                a = np.frombuffer(p, np.uint8)
                line = f"{kind};1x8bit@{RATE}Hz;samples={len(a)};mean={a.mean():.4f};rms={np.sqrt(np.mean(np.square(a, dtype=np.float64))):.4f};zeros={int((a == 0).sum())};embedded={inner}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), line))
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(work, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored_texts(C.documents(spark, sf_dir)))
