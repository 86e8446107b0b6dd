"""ZIP archives entry by entry: their directories as tables, entries read where they stand, archives written and merged.

No archive is held as a whole.  A reader's task holds one entry at a time; a merge copies entries as they are packed, and
only the directory is made anew.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from cytoloom.operators.layout import shard_of
from cytoloom.schemas import CELL_FILES
from cytoloom.sources.blocks import opened
from cytoloom.sources.formats import FileWriter

#: Fixed values of the format: heads of the records, the date 1980-01-01, the methods, and the sign for "see the extra field".
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
DATE, STORED, DEFLATED, FULL = 33, 0, 8, 0xFFFFFFFF
UTF8 = 1 << 11

ENTRIES = "archive string, name string, offset long, packed long, size long, crc long, method int"
ENTRY_ROWS = pa.schema([("archive", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("method", pa.int32())])


def directory(path: str) -> Iterator[tuple]:
    """Rows of ENTRIES from the directory at the end of an archive; what is no file is left out."""
    with opened(path) as f:
        size = f.size()
        f.seek(max(0, size - (1 << 16) - 22))
        tail = f.read()
        at = tail.rfind(END)
        if at < 0:
            raise ValueError(f"{path}: no directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or FULL in (length, start):
            locator = tail.rfind(LOCATOR, 0, at)
            f.seek(struct.unpack_from("<Q", tail, locator + 8)[0])
            count, length, start = struct.unpack_from("<QQQ", f.read(56), 32)
        f.seek(start)
        held = f.read(length)
    at = 0
    for _ in range(count):
        if held[at : at + 4] != CENTRAL:
            raise ValueError(f"{path}: broken directory")
        flags, method = struct.unpack_from("<HH", held, at + 8)
        crc, packed, whole, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", held, at + 16)
        offset = struct.unpack_from("<I", held, at + 42)[0]
        name = held[at + 46 : at + 46 + n_name].decode("utf-8" if flags & UTF8 else "cp437")
        extra, place = held[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while place + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, place)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, place + 4))
                whole, packed, offset = (wide.pop(0) if x == FULL and wide else x for x in (whole, packed, offset))
            place += 4 + n
        if not name.endswith("/"):
            yield path, name, offset, packed, whole, crc, method
        at += 46 + n_name + n_extra + n_note


def packed_bytes(f, offset: int, packed: int) -> bytes:
    """The data of an entry as it is packed."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError(f"no entry at byte {offset}")
    f.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    return f.read(packed)


def unpacked(data: bytes, method: int, size: int, crc: int, name: str) -> bytes:
    if method not in (STORED, DEFLATED):
        raise ValueError(f"{name}: packed by method {method}")
    out = zlib.decompress(data, -15, max(size, 1)) if method == DEFLATED else data
    if len(out) != size or zlib.crc32(out) != crc:
        raise ValueError(f"{name}: broken entry")
    return out


def list_entries(archives: DataFrame) -> DataFrame:
    """ENTRIES of the archives in column ``archive``; only their directories are read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                found = list(directory(path))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), ENTRY_ROWS)], schema=ENTRY_ROWS)

    return archives.select("archive").distinct().mapInArrow(rows, ENTRIES)


def _dealt(entries: DataFrame) -> DataFrame:
    """Entries of any archive dealt over the session's tasks, neighbours together."""
    return entries.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")


def read_entries(entries: DataFrame) -> DataFrame:
    """(cell_id, file_name, content) of entries that are named cell/file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, path = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["archive"] != path:
                    if f:
                        f.close()
                    f, path = opened(r["archive"]), r["archive"]
                cell, _, name = r["name"].partition("/")
                content = unpacked(packed_bytes(f, r["offset"], r["packed"]), r["method"], r["size"], r["crc"], r["name"])
                yield pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([name]), pa.array([content], pa.binary())], names=["cell_id", "file_name", "content"])

    return _dealt(entries.where("name like '%_/_%'")).mapInArrow(rows, CELL_FILES)


class ZipSource(DataSource):
    """Sink of archives.  Rows are (name, content), or rows of ENTRIES, which are copied as they are packed."""

    @classmethod
    def name(cls) -> str:
        return "ziparchive"

    def schema(self) -> str:
        return ENTRIES

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ZipWriter(self.options["path"], ".zip")


class ZipWriter(FileWriter):
    def _packed(self, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int, int, int]]:
        """(name, packed data, size, crc, method) of each row."""
        f, path = None, None
        for batch in rows:
            if "content" in batch.schema.names:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                    yield name, packer.compress(content) + packer.flush(), len(content), zlib.crc32(content), DEFLATED
                continue
            for r in batch.to_pylist():
                if r["archive"] != path:
                    if f:
                        f.close()
                    f, path = opened(r["archive"]), r["archive"]
                yield r["name"], packed_bytes(f, r["offset"], r["packed"]), r["size"], r["crc"], r["method"]

    def content(self, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        at, central, count = 0, [], 0
        for name, data, size, crc, method in self._packed(rows):
            if max(size, len(data)) >= FULL:
                raise ValueError(f"{name}: entries of 4 GB and more are not written")
            spelled = name.encode()
            fixed = struct.pack("<HHHHHIIIH", 20, UTF8, method, 0, DATE, crc, len(data), size, len(spelled))
            yield 0, LOCAL + fixed + b"\0\0" + spelled + data
            extra = struct.pack("<HHQ", 1, 8, at) if at >= FULL else b""
            central.append(CENTRAL + struct.pack("<H", 45) + fixed + struct.pack("<HHHHII", len(extra), 0, 0, 0, 0, min(at, FULL)) + spelled + extra)
            at += 30 + len(spelled) + len(data)
            count += 1
        held = b"".join(central)
        yield 0, held
        if count >= 0xFFFF or at + len(held) >= FULL:
            yield 0, END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(held), at) + LOCATOR + struct.pack("<IQI", 0, at + len(held), 1)
        yield 0, END + struct.pack("<HHHHIIH", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(len(held), FULL), min(at, FULL), 0)


def write_zip(files: DataFrame, path: str, archives: int) -> None:
    """The files of all cells in ``archives`` archives; a cell's files stand together, ids must be plain names.

    A task packs one entry at a time and keeps nothing but the directory.
    """
    bad = (F.col("cell_id") == "") | F.col("cell_id").rlike(r"[/\\]") | F.col("cell_id").isin(".", "..")
    safe = files.withColumn("cell_id", F.when(bad, F.raise_error(F.concat(F.lit("not a cell id: "), "cell_id")).cast("string")).otherwise(F.col("cell_id")))
    dealt = safe.withColumn("shard", shard_of("cell_id", archives)).repartition(archives, "shard").sortWithinPartitions("cell_id", "file_name")
    _save(dealt.select(F.concat_ws("/", "cell_id", "file_name").alias("name"), "content"), path)


def merge_zip(entries: DataFrame, path: str, archives: int) -> None:
    """Entries of any number of archives in about ``archives`` ones, sorted by name, copied as they are packed.

    An entry that stands in several archives is taken from the first of them.
    """
    once = entries.groupBy("name").agg(F.min(F.struct("archive", "offset", "packed", "size", "crc", "method")).alias("e")).select("e.archive", "name", "e.offset", "e.packed", "e.size", "e.crc", "e.method")
    _save(once.repartitionByRange(archives, "name").sortWithinPartitions("name"), path)


def _save(rows: DataFrame, path: str) -> None:
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(ZipSource)
    rows.write.format("ziparchive").mode("append").save(path)
