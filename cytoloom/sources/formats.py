"""Python data sources for files that Spark cannot read itself: fastq, tirp and the blocks of a blocked gzip file.

Use: ``register(spark)``, then ``spark.read.format("fastq").load(paths)``; several paths are parted by commas.  Blocked
files and plain text split into ranges of about ``split_mb`` bytes, which are planned without reading the files.
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from cytoloom.schemas import FASTQ
from cytoloom.sources.blocks import EOF_BLOCK, inflate, located, opened, pack, read_header, scan_blocks

ROWS = 10_000
#: Ranges that are shorter than USUAL grow with the files, so that there are about RANGES of them and not one for each few blocks.
RANGES, USUAL = 256, 64 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None
    kind: str  # blocked, plain or gzip


def _paths(options: dict) -> list[str]:
    return [p.strip() for p in options["path"].split(",") if p.strip()]


def ranges_of(path: str, split: int) -> list[Range]:
    """Ranges of about ``split`` bytes, planned from the size of the file and its first bytes alone."""
    with opened(path) as f:
        size = f.size()
        kind = "plain"
        if path.endswith(("gz", "bbgz", "bgzf", "bam")):
            kind = "blocked" if read_header(f.read(1024), 0) else "gzip"
    if kind == "gzip":
        return [Range(path, 0, None, kind)]
    return [Range(path, a, a + split if a + split < size else None, kind) for a in range(0, max(size, 1), split)]


def size_of(path: str) -> int:
    store, inner = located(path)
    return store.get_file_info(inner).size or 0


def grown(split: int, size: int) -> int:
    """The length of ranges for files of ``size`` bytes in all: ``split`` at least, and more, up to USUAL, where that gives over RANGES of them."""
    return max(split, min(USUAL, size // RANGES))


def _chunks(part: Range, wanted: set[str] | None = None) -> Iterator[tuple[int, bytes | None]]:
    """(place, bytes) from the start of the range on, past its end as far as asked; places rise with the file.

    None stands for a block that is passed over because it belongs to none of the wanted cells.
    """
    if part.kind == "blocked":
        for at, data in inflate(part.path, part.start, None, wanted):
            if data != b"":
                yield at << 16, data
    elif part.kind == "plain":
        with opened(part.path) as f:
            f.seek(part.start)
            at = part.start
            while data := f.read(1 << 20):
                yield at, data
                at += len(data)
    else:
        with opened(part.path) as f:
            at, unpack = 0, zlib.decompressobj(31)
            while raw := f.read(1 << 20):
                while raw:
                    data = unpack.decompress(raw)
                    if data:
                        yield at, data
                        at += len(data)
                    raw = unpack.unused_data
                    if unpack.eof:
                        unpack = zlib.decompressobj(31)
                    elif not raw:
                        break


def _lines(chunks: Iterator[tuple[int, bytes | None]]) -> Iterator[tuple[int, bytes]]:
    """(place, line); the first line of a range may be a part of one."""
    rest, rest_at = b"", 0
    for at, data in chunks:
        if data is None:
            if rest:
                yield rest_at, rest
            rest = b""
            continue
        whole = rest + data
        base = rest_at if rest else at
        cut, begin = len(rest), 0
        while (stop := whole.find(b"\n", begin)) >= 0:
            place = base + begin if begin < cut else at + begin - cut
            yield place, whole[begin:stop].removesuffix(b"\r")
            begin = stop + 1
        rest, rest_at = whole[begin:], base + begin if begin < cut else at + begin - cut
    if rest:
        yield rest_at, rest


def _limit(part: Range) -> int | None:
    if part.end is None:
        return None
    return part.end << 16 if part.kind == "blocked" else part.end


def text_records(part: Range, wanted: set[str] | None = None, begins: bool | None = None, opened_blocks: list[int] | None = None) -> Iterator[tuple[int, bytes]]:
    """The lines of a range: those that begin behind its first byte and not behind its end, and the first of the file.

    So a line that begins on the border of two ranges, or goes over it, belongs to the one before, and nothing before
    a range is read.  The border of blocks is the first block with data at or after it.  ``begins`` tells that a line begins
    with the range and belongs to it; ``opened_blocks`` counts the blocks that are inflated.
    """
    limit, first, passed, stop = _limit(part), part.start > 0 if begins is None else not begins, False, False

    def seen() -> Iterator[tuple[int, bytes | None]]:
        nonlocal limit, first, passed, stop
        for n, (at, data) in enumerate(_chunks(part, wanted)):
            if n == 0 and data is None:
                first = False  # what begins on the border is of another cell
            if limit is not None and not passed and at >= limit and part.kind == "blocked":
                limit, passed = at, True
                stop = data is None
            if stop:
                return
            if opened_blocks is not None:
                opened_blocks[0] += data is not None
            yield at, data

    for place, line in _lines(seen()):
        if first:
            first = False
            continue
        if limit is not None and place > limit:
            break
        yield place, line


def fastq_records(part: Range) -> Iterator[tuple[int, str, str, str]]:
    """(place, name, sequence, quality).

    Within a range that does not begin the file, a record begins at the first line with @ whose next but one begins
    with +: a quality line may begin with @ too, but then the line after the next is no plus line.
    """
    limit, held, aligned = _limit(part), [], part.start == 0
    for place, line in _lines(_chunks(part)):
        held.append((place, line))
        if not aligned:
            if len(held) < 4:
                continue
            if held[0][1][:1] == b"@" and held[2][1][:1] == b"+" and len(held[1][1]) == len(held[3][1]):
                aligned = True
            else:
                held.pop(0)
                continue
        if len(held) == 4:
            (at, name), (_, seq), (_, plus), (_, qual) = held
            if limit is not None and at >= limit:
                return
            if name[:1] != b"@" or plus[:1] != b"+" or len(seq) != len(qual):
                raise ValueError(f"{part.path}: no FASTQ record at {at}")
            yield at, name[1:].decode(), seq.decode(), qual.decode()
            held = []
    if aligned and any(line for _, line in held):
        raise ValueError(f"{part.path}: the last record is cut short")


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = _paths(options), int(float(options.get("split_mb", 64)) * (1 << 20))

    def partitions(self) -> list[Range]:
        split = grown(self.split, sum(size_of(p) for p in self.paths))
        return [r for p in self.paths for r in ranges_of(p, split)]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """One file a task, or one for each of several endings, under hidden names until the job commits.

    A failed or repeated task leaves nothing behind: only files that the driver has heard of are moved to their place.
    """

    HIDDEN = "_temporary"

    def __init__(self, path: str, *endings: str):
        self.path, self.endings = path.rstrip("/"), endings

    def content(self, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        """(number of the ending, bytes) in the order in which they are written."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        store, inner = located(self.path)
        store.create_dir(f"{inner}/{self.HIDDEN}", recursive=True)
        names = [f"{stem}{ending}" for ending in self.endings]
        with contextlib.ExitStack() as stack:
            files = [stack.enter_context(store.open_output_stream(f"{inner}/{self.HIDDEN}/{name}", compression=None)) for name in names]
            for which, data in self.content(iterator):
                files[which].write(data)
        return Written(names)

    def commit(self, messages: list) -> None:
        store, inner = located(self.path)
        for name in (n for m in messages for n in m.names):
            store.move(f"{inner}/{self.HIDDEN}/{name}", f"{inner}/{name}")
        if messages:
            store.delete_dir(f"{inner}/{self.HIDDEN}")

    def abort(self, messages: list) -> None:
        store, inner = located(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{inner}/{self.HIDDEN}/{name}")


FASTQ_ROWS = pa.schema([("file_id", pa.string()), ("ordinal", pa.int64()), ("name", pa.string()), ("seq", pa.string()), ("qual", pa.string())])


class FastqSource(DataSource):
    """Records of four lines.  Written, rows of (r1_fastq, r2_fastq) become pairs of blocked files named _R1 and _R2."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return FASTQ

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FastqWriter(self.options["path"], "_R1.fastq.gz", "_R2.fastq.gz")


class FastqReader(Reader):
    def read(self, part: Range):
        yield from batches(((part.path, *r) for r in fastq_records(part)), FASTQ_ROWS)


class FastqWriter(FileWriter):
    def content(self, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in rows:
            for which, column in enumerate(("r1_fastq", "r2_fastq")):
                records = [r.encode() for r in batch.column(column).to_pylist()]
                if records:
                    yield which, pack(records)
        for which in range(2):
            yield which, EOF_BLOCK


TIRP = "file_id string, ordinal long, cell_id string, r1 string, r2 string, q1 string, q2 string, umi string"
TIRP_ROWS = pa.schema([("file_id", pa.string()), ("ordinal", pa.int64())] + [(c, pa.string()) for c in ("cell_id", "r1", "r2", "q1", "q2", "umi")])


def tirp_records(part: Range, wanted: set[str] | None = None) -> Iterator[tuple]:
    """Rows of TIRP from the lines of a range, with ``wanted`` only those of these cells."""
    for at, line in text_records(part, wanted):
        if not line:
            continue
        cell, _, _, r1, r2, q1, q2, umi = line.decode().split("\t", 7)
        if wanted is not None and cell not in wanted:
            continue
        if len(r1) != len(q1) or len(r2) != len(q2):
            raise ValueError(f"{part.path}: read and quality differ in length at {at}")
        yield part.path, at, cell, r1, r2, q1, q2, umi


def cell_records(path: str, cell: str, start: int, stop: int, begins: bool, opened: list[int]) -> Iterator[tuple]:
    """Rows of one cell from a piece of its blocks; ``opened`` counts the blocks that were inflated for it."""
    for at, line in text_records(Range(path, start, stop, "blocked"), {cell}, begins, opened):
        name, _, _, *rest = line.decode().split("\t", 7)
        if name == cell:
            yield path, at, name, *rest


class TirpSource(DataSource):
    """Read pairs sorted by cell, eight columns by tabs, of which the second and third say nothing.

    Written, rows of (cell_id, block, value) become blocks that hold the lines of one cell and carry its name; a new
    ``block`` begins a new one.
    """

    @classmethod
    def name(cls) -> str:
        return "tirp"

    def schema(self) -> str:
        return TIRP

    def reader(self, schema) -> DataSourceReader:
        return TirpReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TirpWriter(self.options["path"], ".tirp.gz")


class TirpReader(Reader):
    """Where a filter names cells, blocks of others are passed over by their heads and never inflated.

    Spark filters the rows once more.
    """

    wanted: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("cell_id",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            yield f

    def read(self, part: Range):
        yield from batches(tirp_records(part, self.wanted), TIRP_ROWS)


class TirpWriter(FileWriter):
    def content(self, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        held, key = [], None
        for batch in rows:
            for cell, block, line in zip(batch.column("cell_id").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist()):
                if (cell, block) != key:
                    if held:
                        yield 0, pack(held, key[0])
                    held, key = [], (cell, block)
                held.append(line.encode())
        if held:
            yield 0, pack(held, key[0])
        yield 0, EOF_BLOCK


BLOCK_ROWS = pa.schema([("file_id", pa.string()), ("offset", pa.int64()), ("size", pa.int32()), ("cell_id", pa.string())])
#: Bytes of neighbouring blocks that are copied at once.
COPY = 8 << 20


class BlockSource(DataSource):
    """One row for each block of a blocked file: where it is and which cell it holds; nothing is inflated.

    Written, such rows become files of the blocks that they point to, copied as they are in the order of the rows.
    """

    @classmethod
    def name(cls) -> str:
        return "gzipblocks"

    def schema(self) -> str:
        return "file_id string, offset long, size int, cell_id string"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BlockWriter(self.options["path"], ".tirp.gz")


class BlockReader(Reader):
    def read(self, part: Range):
        if part.kind != "blocked":
            raise ValueError(f"{part.path} is not made of blocks")
        rows = ((part.path, b.offset, b.size, b.name) for b in scan_blocks(part.path, part.start, part.end))
        yield from batches(rows, BLOCK_ROWS)


class BlockWriter(FileWriter):
    def content(self, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        source, name = None, None
        for path, start, end in self._spans(rows):
            if path != name:
                if source:
                    source.close()
                source, name = opened(path), path
            source.seek(start)
            data = source.read(end - start)
            if len(data) != end - start or data[:4] != EOF_BLOCK[:4]:
                raise ValueError(f"{path}: no blocks in bytes {start} to {end}")
            yield 0, data
        if source:
            source.close()
        yield 0, EOF_BLOCK

    @staticmethod
    def _spans(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        """Neighbouring blocks as one span of at most COPY bytes."""
        held = None
        for batch in rows:
            for path, at, size in zip(batch.column("file_id").to_pylist(), batch.column("offset").to_pylist(), batch.column("size").to_pylist()):
                if held and held[0] == path and held[2] == at and at + size - held[1] <= COPY:
                    held = (path, held[1], at + size)
                    continue
                if held:
                    yield held
                held = (path, at, at + size)
        if held:
            yield held


def register(spark: SparkSession) -> None:
    """Make the sources known; Spark refuses sources that look at filters unless the session allows it."""
    from cytoloom.sources.bam import BamSource

    for source in (FastqSource, TirpSource, BlockSource, BamSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
