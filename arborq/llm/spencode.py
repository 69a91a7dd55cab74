"""SentencePiece encoding with byte offsets, and decoding.

The model file gives the pieces and a compiled character map: a double-array trie from byte strings to what they
become. Normalising takes the longest prefix that the trie holds at each place, or else one character, and records for
every byte of the result the byte of the text it comes from. Blanks become U+2581, and one is put before the text.
Pieces never hold U+2581 after another character, so the normalised text falls into units that are encoded on their own and
remembered. Each piece is projected back to the bytes of the text it was made of.

Results for odd inputs: null text is the empty text, which has only the begin and end ids; texts of any length are encoded
whole; repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

BLANK = "▁".encode()
#: Bytes that a worker's remembered units take, about; when there are more, it starts anew. Longer units are not remembered.
REMEMBERED, LONGEST = 128 << 20, 256
_loaded: dict = {}


class CharacterMap:
    """Longest-prefix replacement by a compiled map: the size of a double-array trie, its units, zero-ended strings."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.strings = compiled[4 + size :] if size else b""
        self.starts = self._starts()

    def _starts(self) -> frozenset[int]:
        """Bytes that some entry begins with."""
        return frozenset(b for b in range(256) if self.units and self._step(0, b)) if self.units else frozenset()

    def _step(self, node: int, byte: int) -> int:
        """The node that a byte leads to, 0 for none."""
        unit = self.units[node]
        to = node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6)) ^ byte
        return to if self.units[to] & ((1 << 31) | 255) == byte else 0

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """How many bytes from ``at`` the longest entry takes, and its replacement."""
        node, found = 0, None
        for k in range(at, len(text)):
            node = self._step(node, text[k])
            if not node:
                break
            unit = self.units[node]
            if unit & (1 << 8):  # an entry ends here: its value is one unit on
                value = self.units[node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))] & 0x7FFFFFFF
                found = (k + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found


class Encoder:
    """One model's encoder. ``spans`` of an encoded text are byte ranges of the text, one for each piece."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that strip, keep or trail their blanks are not supported")
        self.map, self.prefix = CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix
        pieces = [p.piece.encode() for p in model.pieces]
        if any(BLANK in p.lstrip(BLANK) for p in pieces if p.startswith(BLANK) or BLANK in p):
            raise ValueError("pieces that hold a blank after another character are not supported")
        self.byte = {i: bytes([int(p.piece[3:5], 16)]) for i, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.surface = [self.byte.get(i, p) for i, p in enumerate(pieces)]
        self.first, self.last, self.unknown = self.processor.bos_id(), self.processor.eos_id(), self.processor.unk_id()
        # a character that no longer piece holds ends a unit, as no merge reaches over it
        self.barriers = {b"\n"} if not any(b"\n" in p and len(p) > 1 for p in pieces) else set()
        self.units: dict[bytes, tuple] = {}
        self.held = 0

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The text after the character map, and for each of its bytes and its end the place in ``text``; None if they are the same."""
        hits = [b for b in self.map.starts if b in text] if self.map.units else []
        if not hits:
            return text, None
        out, places, at = bytearray(), [], 0
        while at < len(text):
            found = self.map.longest(text, at) if text[at] in self.map.starts else None
            if found:
                size, new = found
            else:
                size = 1
                while at + size < len(text) and text[at + size] & 0xC0 == 0x80:
                    size += 1
                new = text[at : at + size]
            out += new
            places += [at] * len(new) if found else range(at, at + size)
            at += size
        return bytes(out), np.array([*places, len(text)], np.int64)

    def _learn(self, units: list[bytes]) -> dict[bytes, tuple]:
        """Of units: ids as 32-bit words, the normalised bytes of each piece as 16-bit words, the decoded bytes. Short ones are remembered."""
        plain = [u.decode() for u in units]
        # the library puts a blank before what it encodes
        usual = [self.prefix and len(p) > 1 and p[0] == " " for p in plain]
        known = iter(self.processor.encode([p[1:] for p, ok in zip(plain, usual, strict=True) if ok], num_threads=1))
        out = {}
        for unit, p, ok in zip(units, plain, usual, strict=True):
            ids = next(known) if ok else self._without_blank(p)
            parts = [self.surface[i] for i in ids]
            whole = b"".join(parts)
            if whole != unit.replace(b" ", BLANK):
                raise ValueError("pieces do not spell the text")
            out[unit] = struct.pack(f"<{len(ids)}I", *ids), struct.pack(f"<{len(ids)}H", *map(len, parts)), whole.replace(BLANK, b" ")
            if len(unit) <= LONGEST:
                self.units[unit] = out[unit]
                self.held += 300 + 2 * len(unit) + 6 * len(ids)
        return out

    def _without_blank(self, plain: str) -> list[int]:
        """Ids of a unit that does not start with a blank: encoded behind a barrier, which merges do not reach over."""
        if not self.prefix:
            return self.processor.encode(plain)
        return self.processor.encode("\n" + plain)[len(self.processor.encode("\n")) :]

    def split(self, normalised: bytes) -> list[bytes]:
        """Units of a normalised text whose blanks are spaces: each is its blanks and what follows them, or a barrier."""
        parts: list[bytes] = []
        for line in normalised.split(b"\n") if self.barriers else [normalised]:
            if parts:
                parts.append(b"\n")
            words = line.split(b" ")
            if words[0]:
                parts.append(words[0])
            blanks = 0
            for w in words[1:]:
                blanks += 1
                if w:
                    parts.append(b" " * blanks + w)
                    blanks = 0
            if blanks:
                parts.append(b" " * blanks)
        return parts

    def encode(self, text: bytes) -> tuple[bytes, np.ndarray, bytes]:
        """ids with begin and end (little-endian 32-bit words), byte spans of the pieces between (n, 2), the decoded text."""
        normalised, places = self.normalise(text)
        plain = normalised.replace(BLANK, b" ") if BLANK in normalised else normalised
        blank_width = 3
        full = b" " + plain if self.prefix and plain else plain
        units = self.units
        if self.held > REMEMBERED:
            units.clear()
            self.held = 0
        parts = self.split(full)
        new = [u for u in dict.fromkeys(parts) if u not in units]
        fresh = self._learn(new) if new else {}
        long = any(len(u) > LONGEST for u in fresh)
        found = [units.get(u) or fresh[u] for u in parts] if long else [units[u] for u in parts]
        ids = b"".join([struct.pack("<I", self.first), *[x[0] for x in found], struct.pack("<I", self.last)])
        widths = np.frombuffer(b"".join([x[1] for x in found]), "<u2").astype(np.int64)
        decoded = b"".join([x[2] for x in found])
        # ends in the normalised text with three-byte blanks, then in the normalised text itself, then in the text
        ends = np.cumsum(widths)
        escaped = full.replace(b" ", BLANK)
        if len(ends):
            data = np.frombuffer(full, np.uint8)
            size = np.where(data == 32, blank_width, 1)
            at = np.searchsorted(np.cumsum(size), ends) + 1  # bytes of ``full`` up to each end
            assert ends[-1] == len(escaped)
            at = at - (1 if self.prefix else 0)
            if plain is not normalised:  # U+2581 in the text itself: three bytes there, one in ``plain``
                own = np.frombuffer(self._widths(normalised), np.uint8).astype(np.int64)
                at = np.r_[0, np.cumsum(own)][np.maximum(at, 0)]
            if places is not None:
                at = places[np.maximum(at, 0)]
            at = np.maximum(at, 0)
            spans = np.column_stack([np.r_[0, at[:-1]], at])
        else:
            spans = np.zeros((0, 2), np.int64)
        if self.prefix and decoded.startswith(b" "):
            decoded = decoded[1:]
        return ids, spans, decoded

    @staticmethod
    def _widths(normalised: bytes) -> bytes:
        return b"\3".join([b"\1" * len(p) for p in normalised.split(BLANK)])


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (little-endian 32-bit words), spans (32-bit start and end of each piece between), decoded (UTF-8)."""
    path = model or default_model()

    def work(batches):
        enc = encoder(path)
        for b in batches:
            offsets, data = C.column_bytes(b.column(1))
            raw = data.tobytes()
            for i, j in C.windows(offsets, 4 << 20):
                out = [enc.encode(raw[x:y]) for x, y in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1].astype("<u4").tobytes() for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["doc_id", "ids", "spans", "decoded"])

    rows = C.id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, spans binary, decoded binary")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = encode(C.documents(spark, sf_dir))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.crc32("spans").alias("spans_crc32"))
