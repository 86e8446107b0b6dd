"""Media columns: sniff what a blob is from its bytes, correct declared types, carve embedded media.

An Aho-Corasick automaton over all signatures proposes positions in one pass; a validator for each format then reads
structure and lengths, so a signature that stands in ordinary bytes by chance is turned down.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cytoloom.llm.texts import map_texts
from cytoloom.scratch import bound_batches

#: The signature of each format, and how far it stands from the start of the medium.
SIGNATURES = {"wav": (b"WAVEfmt ", 8), "bmp": (b"\x00\x00\x28\x00\x00\x00", 12), "png": (b"\x89PNG\r\n\x1a\n", 0), "gif": (b"GIF89a", 0), "jpeg": (b"\xff\xd8\xff", 0), "flac": (b"fLaC\x00", 0), "pdf": (b"%PDF-", 0)}
#: The media type that stands for each format.
TYPES = {"wav": "audio/wav", "bmp": "image/bmp", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "flac": "audio/flac", "pdf": "application/pdf"}
BLOCK = 64


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (magic, back) in SIGNATURES.items():
        found.add_word(magic.decode("latin-1"), (kind, back + len(magic) - 1))
    found.make_automaton()
    return found


def _wav(data: bytes, at: int) -> int:
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    if data[at : at + 4] != b"RIFF" or size > len(data) - at or size < 44:
        return 0
    form, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", data, at + 20)
    if form != 1 or align != channels * bits // 8 or byte_rate != rate * align:
        return 0
    place, seen = at + 12, 0
    while place + 8 <= at + size:
        length = struct.unpack_from("<I", data, place + 4)[0]
        seen += data[place : place + 4] == b"data"
        place += 8 + length + (length & 1)
    return size if seen == 1 and place == at + size else 0


def _bmp(data: bytes, at: int) -> int:
    if data[at : at + 2] != b"BM" or len(data) - at < 54:
        return 0
    size, _, start, head, width, height, planes, bits, packed, pixels = struct.unpack_from("<IIIIiiHHII", data, at + 2)
    row = (width * bits + 31) // 32 * 4
    good = head == 40 and planes == 1 and bits in (1, 4, 8, 24, 32) and packed == 0 and width > 0 and pixels == row * abs(height) and size == start + pixels
    return size if good and size <= len(data) - at else 0


def _png(data: bytes, at: int) -> int:
    place = at + 8
    while place + 12 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, place)
        if place + 12 + length > len(data) or struct.unpack_from(">I", data, place + 8 + length)[0] != zlib.crc32(data[place + 4 : place + 8 + length]) or place == at + 8 and kind != b"IHDR":
            return 0
        place += 12 + length
        if kind == b"IEND":
            return place - at
    return 0


def _gif(data: bytes, at: int) -> int:
    def blocks(place: int) -> int:
        while place < len(data) and data[place]:
            place += data[place] + 1
        return place + 1

    if len(data) < at + 13 or not all(struct.unpack_from("<HH", data, at + 6)):
        return 0
    place, images = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0), 0
    while place < len(data):
        if data[place] == 0x3B:
            return place + 1 - at if images else 0
        if data[place] == 0x21:
            place = blocks(place + 2)
        elif data[place] == 0x2C and place + 10 < len(data) and all(struct.unpack_from("<HH", data, place + 5)):
            # An image has a size, codes of 2 to 8 bits and at least one block of them.
            place += 10 + (3 << (data[place + 9] & 7) + 1 if data[place + 9] & 128 else 0)
            if place + 1 >= len(data) or not 2 <= data[place] <= 8 or not data[place + 1]:
                return 0
            place, images = blocks(place + 1), images + 1
        else:
            return 0
    return 0


def _jpeg(data: bytes, at: int) -> int:
    place, scans = at + 2, 0
    while place + 4 <= len(data) and data[place] == 0xFF:
        kind, length = data[place + 1], struct.unpack_from(">H", data, place + 2)[0]
        if kind == 0xD9:
            return place + 2 - at if scans else 0
        if length < 2 or kind in (0x00, 0xFF):
            return 0
        place += 2 + length
        if kind == 0xDA:
            scans += 1
            while (place := data.find(b"\xff", place)) >= 0 and place + 1 < len(data) and (data[place + 1] == 0 or 0xD0 <= data[place + 1] <= 0xD7):
                place += 2
            if place < 0:
                return 0
            if data[place : place + 2] == b"\xff\xd9":
                return place + 2 - at
    return 0


def _checksums(bits: int, polynomial: int) -> list[int]:
    """The table of a cyclic redundancy check of so many bits, most significant bit first."""
    table = []
    for byte in range(256):
        value = byte << bits - 8
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value >> bits - 1 else 0)) & (1 << bits) - 1
        table.append(value)
    return table


CRC8, CRC16 = _checksums(8, 0x07), _checksums(16, 0x8005)


def _flac_frame(data: bytes, at: int) -> tuple[int, int]:
    """(bytes of the frame header at a place, samples of its frame); (0, 0) if there is no sound header."""
    if len(data) - at < 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return 0, 0
    block, rate, channels, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if not block or rate == 15 or channels > 10 or depth == 3 or data[at + 3] & 1:
        return 0, 0
    # The number of the frame or sample is spelled as in UTF-8, in up to seven bytes.
    ones = 8 - (~data[at + 4] & 0xFF).bit_length()
    end = at + 4 + max(1, ones)
    own = {6: 1, 7: 2}.get(block, 0)
    last = end + own + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if ones in (1, 8) or last >= len(data) or any(x & 0xC0 != 0x80 for x in data[at + 5 : end]):
        return 0, 0
    check = 0
    for x in data[at : last + 1]:
        check = CRC8[check ^ x]
    if check:
        return 0, 0
    samples = int.from_bytes(data[end : end + own]) + 1 if own else 192 if block == 1 else 576 << block - 2 if block < 6 else 256 << block - 8
    return last + 1 - at, samples


def _flac(data: bytes, at: int) -> int:
    """Frames carry no length: one ends where its checksum comes out even and the next begins or the stream has all its samples.

    A stream that does not know its number of samples ends with the last frame that no other follows.
    """
    place, info = at + 4, None
    while place + 4 <= len(data):
        kind, length = data[place], int.from_bytes(data[place + 1 : place + 4])
        if info is None and (kind & 127 or length != 34 or len(data) - place < 38):
            return 0
        info = info or data[place + 4 : place + 38]
        place += 4 + length
        if kind & 128:
            break
    else:
        return 0
    least, most, total, seen = int.from_bytes(info[4:7]), int.from_bytes(info[7:10]), int.from_bytes(info[10:18]) & (1 << 36) - 1, 0
    while True:
        head, samples = _flac_frame(data, place)
        if not head:
            return 0
        seen, check, bare, after = seen + samples, 0, 0, 0
        for end in range(place + 1, min(len(data), place + most if most else len(data)) + 1):
            check = (check << 8 & 0xFFFF) ^ CRC16[check >> 8 ^ data[end - 1]]
            if check == 0 and end - place >= max(least, head + 3):
                bare = bare or end
                if 0 < total <= seen:
                    return end - at
                if _flac_frame(data, end)[0]:
                    after = end
                    break
        if not after:
            return bare - at if bare and not total else 0
        place = after


#: The end of a part of a PDF with the place of its table, what that table looks like, and what goes on with another part.
PDF_END = re.compile(rb"startxref\s{1,8}([0-9]{1,12})\s{1,8}%%EOF")
PDF_TABLE = re.compile(rb"xref\b|[0-9]{1,10} [0-9]{1,5} obj\b")
PDF_MORE = re.compile(rb"\s{0,8}(?:xref\b|[0-9]{1,10} [0-9]{1,5} obj\b)")


def _pdf(data: bytes, at: int) -> int:
    """To the first end whose table stands where it says and behind which no further part of the same file begins.

    A first part that points to 0, as files made for the web have, needs a later one.
    """
    sound = False
    for m in PDF_END.finditer(data, at):
        table = int(m[1])
        if table and not (at + table < m.start() and PDF_TABLE.match(data, at + table)):
            return 0
        sound = sound or table > 0
        if not PDF_MORE.match(data, m.end()):
            return m.end() - at if sound else 0
    return 0


VALIDATORS = {"wav": _wav, "bmp": _bmp, "png": _png, "gif": _gif, "jpeg": _jpeg, "flac": _flac, "pdf": _pdf}


def _starts(data: bytes) -> list[tuple[int, str]]:
    return sorted((place - back, kind) for place, (kind, back) in _automaton().iter(data.decode("latin-1")) if place >= back)


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(format, start, length) of each medium in the blob, outermost only, by start."""
    found, end = [], 0
    for start, kind in _starts(data):
        if start >= end and (length := VALIDATORS[kind](data, start)):
            found.append((kind, start, length))
            end = start + length
    return found


def as_bmp(payload: bytes) -> bytes:
    """The bytes as the samples of a grey picture, BLOCK samples a row; their number must be a multiple of BLOCK."""
    rows = len(payload) // BLOCK
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + 1024 + len(payload), 0, 54 + 1024, 40, BLOCK, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return head + palette + payload


def as_wav(payload: bytes) -> bytes:
    """The bytes as the samples of 8-bit mono sound."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload


def stored_medium(data: bytes) -> tuple[str, int, int]:
    """(format, start, length) of the sound or picture behind stray bytes: the first that spans the blob to its end.

    What stray bytes and the samples behind them seem to form together does not hide it.
    """
    for start, kind in _starts(data):
        if kind in ("wav", "bmp") and VALIDATORS[kind](data, start) == len(data) - start:
            return kind, start, len(data) - start
    raise ValueError("no sound or picture spans the blob to its end")


def samples(data: bytes, kind: str) -> bytes:
    """The stored samples of a sound or picture written by as_wav or as_bmp."""
    return data[struct.unpack_from("<I", data, 10)[0] :] if kind == "bmp" else data[44:]


def carve(data: bytes, declared: str | None) -> tuple[str | None, str | None, list[tuple[str, int, int]]]:
    """(detected, corrected, (type, offset, length) of each medium) of a blob under a declared type.

    Detected is the type of a medium at byte 0, null without one; corrected is it or else the declared type.
    """
    found = [(TYPES[kind], at, length) for kind, at, length in sniff(data)]
    detected = next((kind for kind, at, _ in found if at == 0), None)
    return detected, detected or declared, found


def sniff_media(media: DataFrame) -> DataFrame:
    """The table of blobs (content, declared) with detected, corrected and carved added; all other columns stay.

    ``detected`` is the type of a medium that starts at byte 0, null if there is none; ``corrected`` is it or else the
    declared type; ``carved`` lists every medium found with its type, offset, length and bytes.  A null or empty
    content has none.  Clashing columns of these three names are replaced.
    """
    part = T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    made = T.StructType([T.StructField("detected", T.StringType()), T.StructField("corrected", T.StringType()), T.StructField("carved", T.ArrayType(part))])

    @F.pandas_udf(made)
    def sniffed(content: pd.Series, declared: pd.Series) -> pd.DataFrame:
        rows = [carve(bytes(b) if b is not None else b"", d) for b, d in zip(content, declared)]
        parts = [[{"type": kind, "offset": at, "length": n, "content": bytes(b[at : at + n])} for kind, at, n in found] for b, (_, _, found) in zip(content, rows)]
        return pd.DataFrame({"detected": [r[0] for r in rows], "corrected": [r[1] for r in rows], "carved": parts}, columns=["detected", "corrected", "carved"])

    bound_batches(media.sparkSession)
    out = media.withColumn("carved", sniffed("content", "declared"))
    return out.withColumn("detected", F.col("carved.detected")).withColumn("corrected", F.col("carved.corrected")).withColumn("carved", F.col("carved.carved"))


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, corrected string, carved string, preview_sha256 string"
#: Bytes that stand before a medium that has to be found, and between two media of one blob.
STRAY, GAP = b"BM GIF89a", bytes(7)


def store(text: str | None) -> tuple:
    """COLUMNS of a text that is stored as a medium under a declared type, with a preview behind it, and read back from what is carved.

    Sound or picture, and the declared type, go by the text's own bytes, so that equal texts give equal values.  The
    preview holds the last BLOCK samples in the other format.
    """
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))
    by = zlib.crc32(payload)
    main, other = (as_wav, as_bmp) if by & 1 else (as_bmp, as_wav)
    declared = sorted(TYPES.values())[by // 2 % len(TYPES)]
    media, preview = main(payload), other(payload[-BLOCK:])
    blob = media + GAP + preview
    _, corrected, found = carve(blob, declared)
    if [at for _, at, _ in found] != [0, len(media) + len(GAP)]:
        raise ValueError("a blob of two media holds others")
    stored, small = (blob[at : at + length] for _, at, length in found)
    kind, at, length = stored_medium(STRAY + stored)
    back = samples(stored, kind)
    if back != payload or samples(small, "wav" if kind == "bmp" else "bmp") != back[-BLOCK:]:
        raise ValueError(f"{len(payload)} bytes were stored and others read back")
    mean = sum(back[-BLOCK:]) / BLOCK
    feature = f"{TYPES[kind]};offset={at};samples={len(back)};tail_mean={mean:.4f}"
    parts = ",".join(f"{kind}:{at}:{n}" for kind, at, n in found)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), length, hashlib.sha256(stored).hexdigest(), feature, declared, corrected, parts, hashlib.sha256(small).hexdigest()


def media_features(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a medium under some declared type, carved out of its blob, read back and digested.

    ``corrected`` is the declared type mended by what the bytes are, ``carved`` lists type:offset:length of the media in
    the blob.  A null or empty text is one block of zeros.  Needs doc_id and text only; a null doc_id stays null, and
    repeated rows give repeated, equal rows.
    """
    return map_texts(docs, lambda: lambda texts: [(i, *store(t)) for i, t in enumerate(texts)], COLUMNS)
