"""BAM files as a Python data source: read in ranges of blocks or by chunks of an index, written in coordinate order.

A record can begin anywhere in a block.  A range that does not begin the file looks for the first place from which a
chain of plausible records leads on, and owns the records that begin in its blocks.  ``ordinal`` is a record's virtual
offset: the place of its block in the file and its own place in the block's data.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from cytoloom.schemas import ALIGNMENTS
from cytoloom.sources.blocks import EOF_BLOCK, FILL, inflate, write_block
from cytoloom.sources.formats import ROWS, FileWriter, Range, Reader

#: Fixed values of the format.
OPS, NIBBLES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("t_len", "<i4")])
#: Records that have to follow each other before a place counts as the start of one, and bytes a record takes at most.
LINKS, LONGEST = 8, 1 << 26
#: Bytes of data that are decoded at once, about.
BUFFER = 4 << 20

FROM_HEX = str.maketrans("0123456789abcdef", NIBBLES)
TO_TEXT = bytes(min(i + 33, 255) for i in range(256))
#: Codes of the letters of bases and of operations, 255 for other bytes; bits and first number of the bins of each level.
CODES, OP_CODES = np.full(256, 255, np.uint8), np.full(256, 255, np.uint8)
CODES[list(NIBBLES.encode())], OP_CODES[list(OPS.encode())] = range(len(NIBBLES)), range(len(OPS))
BINS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
CIGAR = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
SCHEMA = pa.schema([("file_id", pa.string()), ("ordinal", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("end_pos", pa.int64()), ("mapq", pa.int32()), ("cigar", CIGAR), ("l_seq", pa.int32()), ("seq", pa.string()), ("qual", pa.string())])


def read_header(path: str) -> tuple[list[str], int]:
    """Names of the references, and how many bytes of data stand before the first record."""
    chunks, held = inflate(path, 0), bytearray()

    def need(n: int) -> None:
        while len(held) < n:
            data = next(chunks, None)
            if data is None:
                raise ValueError(f"{path}: cut short")
            held.extend(data[1])

    need(12)
    if held[:4] != b"BAM\x01":
        raise ValueError(f"{path}: not a BAM file")
    at = 8 + struct.unpack_from("<i", held, 4)[0]
    need(at + 4)
    count, at, names = struct.unpack_from("<i", held, at)[0], at + 4, []
    for _ in range(count):
        need(at + 4)
        length = struct.unpack_from("<i", held, at)[0]
        need(at + 8 + length)
        names.append(held[at + 4 : at + 3 + length].decode())
        at += 8 + length
    return names, at


def _plausible(data: np.ndarray, references: int) -> np.ndarray:
    """Places at which the fixed part of a record may stand, in rising order."""
    n = len(data) - FIXED.itemsize
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    byte = data.astype(np.int64)

    def number(field: str, size: int = 4) -> np.ndarray:
        o = FIXED.fields[field][1]
        x = sum(byte[o + i : o + i + n] << 8 * i for i in range(size))
        return np.where(x >= 1 << 31, x - (1 << 32), x) if size == 4 else x

    size, l_seq, l_name = number("size"), number("l_seq"), number("l_name", 1)
    ok = (size >= 32) & (size < LONGEST) & (l_seq >= 0) & (l_name > 0)
    for ref, pos in (("ref", "pos"), ("next_ref", "next_pos")):
        r = number(ref)
        ok &= (r >= -1) & (r < references) & (number(pos) >= -1)
    ok &= 32 + l_name + 4 * number("n_ops", 2) + (l_seq + 1) // 2 + l_seq <= size
    ends = at + FIXED.itemsize + l_name - 1
    ok &= (ends < len(data)) & (data[np.minimum(ends, len(data) - 1)] == 0)
    return at[ok]


def first_record(data: bytes, references: int, whole: bool) -> int | None:
    """Where the first record begins in data that may begin inside one; None if that takes more data.

    ``whole`` says that the file ends with the data, so a chain of records may end there too.
    """
    places = _plausible(np.frombuffer(data, np.uint8), references)
    known = set(places.tolist())
    for p in places.tolist():
        at = p
        for _ in range(LINKS):
            if at not in known:
                break
            at += 4 + struct.unpack_from("<i", data, at)[0]
            if at > len(data) - FIXED.itemsize:
                break
        else:
            return p
        if at == len(data) and whole:
            return p
        if at not in known and at > len(data) - FIXED.itemsize and not whole:
            return None
    return len(data) if whole else None


def record_buffers(path: str, start: int, skip: int, stop: int | None, references: int | None = None, opened: list[int] | None = None) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(data, places of records in it, their virtual offsets) from block ``start`` on, for offsets below ``stop``.

    ``skip`` bytes of the first block's data are passed over; with ``references`` the first record is looked for;
    ``opened`` counts the blocks that are inflated.
    """
    chunks = inflate(path, start)
    held, marks, done = bytearray(), [], False  # marks: (place in held, offset of the block)
    aligned = references is None

    def more() -> bool:
        nonlocal done
        found = next(chunks, None)
        if found is None:
            done = True
            return False
        if opened is not None:
            opened[0] += 1
        marks.append((len(held), found[0]))
        held.extend(found[1])
        return True

    while len(held) < skip and more():
        pass
    p = skip
    while True:
        while not done and len(held) - p < (BUFFER if aligned else 1 << 17) and (stop is None or not marks or marks[-1][1] << 16 < stop):
            more()
        while not aligned:
            found = first_record(bytes(held), references, done)
            if found is not None:
                p, aligned = found, True
            else:
                more()
        starts, size = [], len(held)
        while p + 4 <= size:
            nxt = p + 4 + struct.unpack_from("<i", held, p)[0]
            if nxt > size:
                break
            starts.append(p)
            p = nxt
        at = np.array(starts, np.int64)
        where = np.array(marks, np.int64).reshape(-1, 2)
        block = np.searchsorted(where[:, 0], at, "right") - 1
        offsets = (where[block, 1] << 16) + at - where[block, 0]
        kept = len(at) if stop is None else int(np.searchsorted(offsets, stop))
        if kept:
            yield bytes(held), at[:kept], offsets[:kept]
        if kept < len(at) or (done and p >= size):
            return
        if stop is not None and len(where):
            inside = np.searchsorted(where[:, 0], p, "right") - 1
            if p < size and (where[inside, 1] << 16) + p - where[inside, 0] >= stop or p == size and where[-1, 1] << 16 >= stop:
                return
        if done:
            raise ValueError(f"{path}: cut short")
        left = np.searchsorted(where[:, 0], p, "right") - 1
        marks[:] = [(a - p, b) for a, b in marks[max(0, left) :]]
        del held[:p]
        p = 0
        if not more():
            if held:
                raise ValueError(f"{path}: cut short")
            return


def decode(path: str, names: list[str], data: bytes, at: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Rows of ALIGNMENTS; ``end_pos`` is the place after the last base on the reference."""
    raw = np.frombuffer(data, np.uint8)
    fixed = raw[at[:, None] + np.arange(FIXED.itemsize)].copy().view(FIXED)[:, 0]
    name_at = at + FIXED.itemsize
    cigar_at = name_at + fixed["l_name"]
    seq_at = cigar_at + 4 * fixed["n_ops"].astype(np.int64)
    qual_at = seq_at + (fixed["l_seq"] + 1) // 2
    n_ops = fixed["n_ops"].astype(np.int64)
    borders = np.concatenate([[0], np.cumsum(n_ops)])
    places = np.repeat(cigar_at - 4 * borders[:-1], n_ops) + 4 * np.arange(borders[-1])
    ops = raw[places[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(places) else np.zeros(0, np.uint32)
    lengths = (ops >> 4).astype(np.int32)
    on_reference = np.concatenate([[0], np.cumsum(np.where(np.isin(ops & 15, [0, 2, 3, 7, 8]), lengths, 0))])
    span = on_reference[borders[1:]] - on_reference[borders[:-1]]
    cigar = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.StructArray.from_arrays([pa.array(list(OPS)).take(pa.array(ops & 15, pa.int32())), pa.array(lengths)], fields=list(CIGAR.value_type)))
    qnames = [data[a:b].decode() for a, b in zip(name_at.tolist(), (cigar_at - 1).tolist())]
    size = fixed["l_seq"].tolist()
    seqs = [data[a:b].hex().translate(FROM_HEX)[:n] or None for a, b, n in zip(seq_at.tolist(), qual_at.tolist(), size)]
    quals = [None if n == 0 or data[a] == 255 else data[a : a + n].translate(TO_TEXT).decode() for a, n in zip(qual_at.tolist(), size)]
    refs = pa.array(names, pa.string()).take(pa.array(fixed["ref"], pa.int32(), mask=fixed["ref"] < 0)) if names else pa.nulls(len(at), pa.string())
    pos = fixed["pos"].astype(np.int64)
    columns = [pa.array([path] * len(at), pa.string()), offsets, qnames, fixed["flag"].astype(np.int32), refs, pos, pos + span, pa.array(fixed["mapq"].astype(np.int32), mask=fixed["mapq"] == 255), cigar, fixed["l_seq"], pa.array(seqs, pa.string()), pa.array(quals, pa.string())]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def _batches(path: str, names: list[str], buffers, keep=None) -> Iterator[pa.RecordBatch]:
    for data, at, offsets in buffers:
        if keep is not None:
            raw = np.frombuffer(data, np.uint8)
            chosen = keep(raw[at[:, None] + np.arange(FIXED.itemsize)].copy().view(FIXED)[:, 0])
            at, offsets = at[chosen], offsets[chosen]
        for i in range(0, len(at), ROWS):
            yield decode(path, names, data, at[i : i + ROWS], offsets[i : i + ROWS])


def read_range(part: Range, keep=None) -> Iterator[pa.RecordBatch]:
    names, before = read_header(part.path)
    stop = None if part.end is None else part.end << 16
    buffers = record_buffers(part.path, 0, before, stop) if not part.start else record_buffers(part.path, part.start, 0, stop, len(names))
    yield from _batches(part.path, names, buffers, None if keep is None else keep(names))


class BamSource(DataSource):
    """Alignments.  Written, sorted rows of one task become one file; option ``references`` is JSON of [name, length]."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BamWriter(self.options["path"], json.loads(self.options["references"]))


class BamReader(Reader):
    """A filter on chrom and pos drops records by their fixed part, before they are decoded; Spark filters the rows once more."""

    chrom: str | None = None
    low, high = -(1 << 40), 1 << 40

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                self.chrom = f.value
            if f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual) and f.attribute == ("pos",):
                self.low = max(self.low, f.value)
            if f.__class__ in (EqualTo, LessThan, LessThanOrEqual) and f.attribute == ("pos",):
                self.high = min(self.high, f.value)
            yield f

    def read(self, part: Range):
        def keep(names: list[str]):
            ref = names.index(self.chrom) if self.chrom in names else None
            return lambda x: (x["pos"] >= self.low) & (x["pos"] <= self.high) & (self.chrom is None or ref is not None) & (x["ref"] == ref if ref is not None else True)

        limited = self.chrom is not None or self.low > -(1 << 40) or self.high < 1 << 40
        yield from read_range(part, keep if limited else None)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and their borders; a null has none."""
    column = column.cast(pa.string()).fill_null("")
    borders = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
    return data, borders - borders[0]


def _inside(at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of some length: the place where each of their units' stretch begins, and the unit's number in it."""
    return np.repeat(at, length), np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


def _whole(column: pa.Array, name: str, least: int, most: int, null: int | None = None) -> np.ndarray:
    if column.null_count:
        if null is None:
            raise ValueError(f"{name} is null")
        column = column.fill_null(null)
    values = column.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(values) and not least <= values.min() <= values.max() <= most:
        raise ValueError(f"{name} is not between {least} and {most}")
    return values


def encode(rows: pa.RecordBatch, refs: dict[str, int]) -> tuple[bytes, np.ndarray]:
    """Records one after the other, and where each ends; a read without bases has none, one without qualities has the byte for unknown ones."""
    column = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
    qname = column["qname"].cast(pa.string()).fill_null("*")
    name, borders = _texts(pc.if_else(pc.equal(qname, ""), "*", qname))
    l_name = np.diff(borders) + 1
    if l_name.max(initial=0) > 255:
        raise ValueError(f"name too long: {qname[int(l_name.argmax())]}")
    seq, borders = _texts(column["seq"])
    l_seq, codes = np.diff(borders), CODES[seq]
    if codes.max(initial=0) > 15:
        raise ValueError(f"no letter of a base: {chr(seq[codes.argmax()])}")
    known = column["qual"].is_valid().to_numpy(zero_copy_only=False)
    qual, borders = _texts(column["qual"])
    l_qual = np.diff(borders)
    wrong = np.flatnonzero(known & (l_qual != l_seq))
    if len(wrong):
        raise ValueError(f"read and quality differ in length: {qname[int(wrong[0])]}")
    if qual.min(initial=33) < 33:
        raise ValueError("no letter of a quality")
    n_ops = pc.list_value_length(column["cigar"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ops = pc.list_flatten(column["cigar"])
    kinds, borders = _texts(pc.struct_field(ops, "op"))
    if (np.diff(borders) != 1).any() or OP_CODES[kinds].max(initial=0) > 8 or n_ops.max(initial=0) > 65535:
        raise ValueError("unknown operation in a CIGAR, or too many")
    cigar = (_whole(pc.struct_field(ops, "len"), "len", 0, (1 << 28) - 1) << 4 | OP_CODES[kinds]).astype("<u4")
    pos = _whole(column["pos"], "pos", -(1 << 31), (1 << 31) - 1, -1)
    end = np.maximum(np.maximum(pos + 1, _whole(column["end_pos"], "end_pos", -(1 << 62), 1 << 62, 0)), 1)
    places = pc.index_in(column["chrom"].cast(pa.string()), pa.array(list(refs), pa.string()))
    if places.null_count > column["chrom"].null_count:
        raise ValueError("a reference is not in the header")
    ref = np.array([*refs.values(), -1], np.int64)[places.fill_null(len(refs)).to_numpy(zero_copy_only=False)]
    size = FIXED.itemsize + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    ends = np.cumsum(size)
    at = ends - size
    fixed = np.zeros(len(at), FIXED)
    for field, values in (("size", size - 4), ("ref", ref), ("pos", pos), ("l_name", l_name), ("mapq", _whole(column["mapq"], "mapq", 0, 255, 255)), ("bin", bins_of(np.maximum(pos, 0), end)), ("n_ops", n_ops), ("flag", _whole(column["flag"], "flag", 0, 65535)), ("l_seq", l_seq), ("next_ref", -1), ("next_pos", -1)):
        fixed[field] = values
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[at[:, None] + np.arange(FIXED.itemsize)] = fixed.view(np.uint8).reshape(len(at), FIXED.itemsize)
    at = at + FIXED.itemsize
    out[np.add(*_inside(at, l_name - 1))] = name
    at = at + l_name
    out[np.add(*_inside(at, 4 * n_ops))] = cigar.view(np.uint8)
    at = at + 4 * n_ops
    base, number = _inside(at, l_seq)
    even = number & 1 == 0
    out[base[even] + (number[even] >> 1)] = codes[even] << 4
    out[base[~even] + (number[~even] >> 1)] |= codes[~even]
    at = at + (l_seq + 1) // 2
    out[np.add(*_inside(at[known], l_qual[known]))] = qual - 33
    out[np.add(*_inside(at[~known], l_seq[~known]))] = 255
    return out.tobytes(), ends


def bins_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``bin_of`` for many intervals."""
    out = np.zeros(len(start), np.int64)
    for shift, first in reversed(BINS):
        out = np.where(start >> shift == (end - 1) >> shift, first + (start >> shift) & 0xFFFF, out)
    return out


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the index that holds [start, end)."""
    for shift, first in BINS:
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift) & 0xFFFF
    return 0


class BamWriter(FileWriter):
    def __init__(self, path: str, references: list[list]):
        super().__init__(path, ".bam")
        self.references = references

    def content(self, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        refs = {name: i for i, (name, _) in enumerate(self.references)}
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in self.references)
        held = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs))
        for name, length in self.references:
            held += struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
        for i in range(0, len(held), FILL):  # records begin in a block of their own
            yield 0, write_block(held[i : i + FILL])
        held = b""  # whole records of a block that others may still join
        for batch in rows:
            data, ends = encode(batch, refs)
            data, ends = held + data, np.concatenate([[len(held)] if held else [], ends + len(held)]).astype(np.int64)
            begin, held = 0, b""
            while begin < len(data):
                stop = int(ends[np.searchsorted(ends, begin + FILL, "right") - 1]) if ends[0] <= begin + FILL else 0
                if stop == len(data):
                    held = data[begin:]
                    break
                if stop <= begin:  # a record that alone is too long for a block
                    stop = int(ends[np.searchsorted(ends, begin, "right")])
                for i in range(begin, stop, FILL):
                    yield 0, write_block(data[i : min(i + FILL, stop)])
                begin = stop
        if held:
            yield 0, write_block(held)
        yield 0, EOF_BLOCK
