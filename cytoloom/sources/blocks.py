"""Blocked gzip: finding block borders without inflating, and reading, copying and writing blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

#: The empty block that ends a file, and the longest block.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 1 << 16


MAGIC = b"\x1f\x8b\x08\x04"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI or local path, and the path in it."""
    if "://" not in path:
        path = f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file of any store that Arrow knows, by URI or local path."""
    system, inner = located(path)
    return system.open_input_file(inner)


@dataclass(frozen=True)
class Block:
    offset: int
    size: int
    name: str | None  # the ID subfield: which cell the block belongs to


def read_header(head: bytes, offset: int) -> Block | None:
    """The block whose first bytes these are; None for ordinary gzip."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    place, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    size, name = None, None
    while place + 4 <= min(end, len(head)):
        tag, length = head[place : place + 2], struct.unpack_from("<H", head, place + 2)[0]
        value = head[place + 4 : place + 4 + length]
        if tag == b"BC" and length == 2:
            size = struct.unpack("<H", value)[0] + 1
        elif tag == b"ID":
            name = value.decode()
        place += 4 + length
    return Block(offset, size, name) if size else None


def _leads_on(f, at: int, size: int, links: int = 3) -> bool:
    """Whether a block begins at ``at`` and others, or the end of the file, where each says that the next does."""
    for _ in range(links):
        if at == size:
            return True
        f.seek(at)
        block = read_header(f.read(1024), at)
        if block is None:
            return False
        at += block.size
    return at <= size


def find_block(f, start: int, size: int) -> int:
    """The first place from ``start`` on where a block begins; the size of the file if there is none."""
    at = start
    while at < size:
        f.seek(at)
        raw = f.read(MOST)
        place = raw.find(MAGIC)
        while place >= 0:
            if _leads_on(f, at + place, size):
                return at + place
            place = raw.find(MAGIC, place + 1)
        if len(raw) < len(MAGIC):
            break
        at += len(raw) - len(MAGIC) + 1
    return size


def scan_blocks(path: str, start: int = 0, end: int | None = None) -> Iterator[Block]:
    """The blocks that begin in [start, end), from their headers alone."""
    with opened(path) as f:
        size = f.size()
        at = find_block(f, start, size) if start else 0
        while at < min(size, size if end is None else end):
            f.seek(at)
            block = read_header(f.read(1024), at)
            if block is None:
                raise ValueError(f"{path}: no block at byte {at}")
            yield block
            at += block.size


def is_blocked(path: str) -> bool:
    with opened(path) as f:
        return read_header(f.read(1024), 0) is not None


def inflate(path: str, start: int, end: int | None = None, wanted: set[str] | None = None) -> Iterator[tuple[int, bytes | None]]:
    """(offset, bytes) of each block that begins in [start, end), checked against its CRC.

    With ``wanted``, blocks that are named after another cell are passed over and give None.
    """
    with opened(path) as f:
        size = f.size()
        at = find_block(f, start, size) if start else 0
        while at < size and (end is None or at < end):
            f.seek(at)
            head = f.read(1024)
            block = read_header(head, at)
            if block is None:
                raise ValueError(f"{path}: no block at byte {at}")
            if wanted is not None and block.name is not None and block.name not in wanted:
                yield at, None
            else:
                raw = head[: block.size] + (f.read(block.size - len(head)) if block.size > len(head) else b"")
                data = zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : -8], -15)
                crc, length = struct.unpack("<II", raw[-8:])
                if len(raw) != block.size or zlib.crc32(data) != crc or len(data) != length:
                    raise ValueError(f"{path}: broken block at byte {at}")
                yield at, data
            at += block.size


def write_block(data: bytes, name: str | None = None, level: int = 6) -> bytes:
    """One block of at most 60 KiB of data, with the cell's name if given."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"BC\x02\x00\x00\x00" + (b"ID" + struct.pack("<H", len(name.encode())) + name.encode() if name else b"")
    size = 12 + len(extra) + len(body) + 8
    if size > MOST:
        raise ValueError("block too long")
    extra = extra.replace(b"BC\x02\x00\x00\x00", b"BC\x02\x00" + struct.pack("<H", size - 1), 1)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


#: Bytes of data that a block takes at most, so that it stays under MOST even if they do not shrink.
FILL = 60 << 10


def pack(lines: list[bytes], name: str | None = None) -> bytes:
    """Blocks that hold the lines, each ended; a block ends with a line unless the line alone is too long."""
    out, held = [], b""
    for line in lines:
        line += b"\n"
        if held and len(held) + len(line) > FILL:
            out.append(write_block(held, name))
            held = b""
        held += line
        while len(held) > FILL:
            out.append(write_block(held[:FILL], name))
            held = held[FILL:]
    return b"".join([*out, write_block(held, name)] if held else out)
