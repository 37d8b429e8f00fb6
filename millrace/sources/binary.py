"""Python data sources for byte-oriented formats: fixed-length records, TFRecord, byte ranges of
text, gzip text in blocks, and key-value logs. Each splits files into byte ranges, so large files are read in parallel.

Register with ``register_all(spark)``; then for example
``spark.read.format("fixedbin").option("fmt", "I").load(path)``. Paths are local ones that all
executors mount, or URIs of a file system that ``millrace.sources.vfs`` opens.
"""

from __future__ import annotations

import binascii
import gzip
import json
import pickle
import struct
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from millrace.sources import vfs
from millrace.sources.files import expand
from millrace.sources.vfs import local

SPLIT = 64 << 20
#: Ranges of less than ``SPLIT`` bytes are made longer until there are about this many.
MOST_RANGES = 256


@dataclass
class Range(InputPartition):
    """Bytes of a file."""

    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def listed(path: str, ext: str = "") -> list[str]:
    return expand(vfs.glob(path), ext)


def range_bytes(total: int, split: int, unit: int = 1) -> int:
    """Bytes of a range, a multiple of ``unit``: about ``split``, but more if ``total`` bytes would give
    more than ``MOST_RANGES`` ranges of less than ``SPLIT`` bytes, as each costs a task."""
    wanted = max(unit, split // unit * unit)
    return max(wanted, -(-min(SPLIT, -(-total // MOST_RANGES)) // unit) * unit)


def byte_ranges(files: Sequence[str], split: int, unit: int = 1) -> list[Range]:
    """Ranges of about ``split`` bytes or more (``range_bytes``), aligned to ``unit``."""
    sizes = [vfs.getsize(p) for p in files]
    step = range_bytes(sum(sizes), split, unit)
    return [Range(p, b, min(b + step, n)) for p, n in zip(files, sizes) for b in range(0, n, step)]


@dataclass
class Done(WriterCommitMessage):
    """A finished temporary file and its final name."""

    temporary: str
    final: str


class FileWriter(DataSourceWriter):
    """One file a task, renamed on commit, so a lost task leaves nothing behind."""

    def __init__(self, options: dict, overwrite: bool, ext: str):
        self.path, self.ext, self.overwrite = local(options["path"]), ext, overwrite
        self.old = expand(self.path, ext) if overwrite and vfs.isdir(self.path) else []
        vfs.makedirs(self.path)

    def encode(self, row) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Done:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        temporary = vfs.join(self.path, f".{n:04d}-{uuid.uuid4().hex}.tmp")
        with vfs.open(temporary, "wb") as f:
            for row in iterator:
                f.write(self.encode(row))
        return Done(temporary, vfs.join(self.path, f"{n:04d}{self.ext}"))

    def commit(self, messages) -> None:
        for old in self.old:
            vfs.remove(old)
        for m in messages:
            if m is None:
                continue
            if vfs.getsize(m.temporary):
                vfs.replace(m.temporary, m.final)
            else:
                vfs.remove(m.temporary)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and vfs.exists(m.temporary):
                vfs.remove(m.temporary)


# --- fixed-length records ---

# Codes of the struct module and their types.
CODES = {"b": "int", "B": "int", "h": "int", "H": "int", "i": "int", "I": "bigint", "l": "bigint", "L": "bigint", "q": "bigint", "Q": "decimal(20,0)", "f": "float", "d": "double", "?": "boolean"}


def fields_of(fmt: str) -> list[str]:
    """Spark types of a struct format: a count repeats a code, ``Ns`` is one binary field."""
    out, count = [], ""
    for c in fmt.lstrip("@=<>!"):
        if c.isdigit():
            count += c
        elif c == "s":
            out.append("binary")
            count = ""
        elif c == "x" or c.isspace():
            count = ""
        elif c in CODES:
            out += [CODES[c]] * int(count or 1)
            count = ""
        else:
            raise ValueError(f"no such code: {c}")
    return out


class FixedBinary(DataSource):
    """Records of a fixed length. Options: ``fmt`` (struct format) or ``length`` (raw bytes),
    ``split``. Columns c0, c1, …; a partial record at the end of a file is dropped."""

    @classmethod
    def name(cls) -> str:
        return "fixedbin"

    def schema(self) -> str:
        if "fmt" not in self.options:
            return "value binary"
        return ", ".join(f"c{i} {t}" for i, t in enumerate(fields_of(self.options["fmt"])))

    def reader(self, schema) -> DataSourceReader:
        return FixedReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FixedWriter(dict(self.options), overwrite)


class FixedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.fmt = options.get("fmt")
        self.length = struct.calcsize(self.fmt) if self.fmt else int(options["length"])
        if self.length <= 0:
            raise ValueError("a record has at least one byte")

    def partitions(self):
        return byte_ranges(listed(self.options["path"]), int(self.options.get("split", SPLIT)), self.length)

    def read(self, partition: Range):
        with vfs.open(partition.path) as f:
            f.seek(partition.begin)
            left = partition.end - partition.begin
            while left >= self.length:
                data = f.read(min(left, (1 << 20) // self.length * self.length or self.length))
                data = data[: len(data) // self.length * self.length]
                if not data:
                    return
                left -= len(data)
                if self.fmt:
                    yield from struct.iter_unpack(self.fmt, data)
                else:
                    yield from ((data[i : i + self.length],) for i in range(0, len(data), self.length))


class FixedWriter(FileWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite, ".bin")
        self.fmt = options.get("fmt")

    def encode(self, row) -> bytes:
        return struct.pack(self.fmt, *row) if self.fmt else bytes(row[0])


# --- TFRecord ---


def _crc32c_tables() -> np.ndarray:
    """For each byte and each number of bytes that follow it, what it does to the checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    out = [table]
    for _ in range(LANES - 1):
        out.append(table[out[-1] & 0xFF] ^ out[-1] >> 8)
    return np.stack(out[::-1])


#: Bytes that are taken at once.
LANES = 256
_TABLES = _crc32c_tables()
_LAST: list[int] = _TABLES[-1].tolist()
_PLACES = np.arange(LANES)


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli). A checksum is linear in its bytes: a block of ``LANES`` bytes, the first
    four with the checksum so far added, is looked up all at once."""
    crc, at = 0xFFFFFFFF, 0
    while len(data) - at >= LANES:
        block = np.frombuffer(data, np.uint8, LANES, at).copy()
        block[:4] ^= np.frombuffer(crc.to_bytes(4, "little"), np.uint8)
        crc = int(np.bitwise_xor.reduce(_TABLES[_PLACES, block]))
        at += LANES
    for b in data[at:]:
        crc = crc >> 8 ^ _LAST[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def masked_crc32c(data: bytes) -> int:
    """The rotated and shifted CRC that record files store."""
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class TFRecord(DataSource):
    """Length-prefixed records with checksums. Column ``value`` (string, or binary with option
    ``binary``). Option ``verify`` (default true) checks the data's checksum and drops records that
    fail; reading may start in the middle of a file, at the next valid length."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return "value binary" if self.options.get("binary", "false").lower() == "true" else "value string"

    def reader(self, schema) -> DataSourceReader:
        return TFRecordReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TFRecordWriter(dict(self.options), overwrite)


class TFRecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.verify = options.get("verify", "true").lower() == "true"
        self.binary = options.get("binary", "false").lower() == "true"

    def partitions(self):
        return byte_ranges(listed(self.options["path"], self.options.get("ext", ".tfrecords")), int(self.options.get("split", SPLIT)))

    @staticmethod
    def first_record(f, at: int, end: int) -> int | None:
        """Place of the first record that starts from ``at`` on and before ``end``."""
        step = 1 << 16
        while at < end:
            f.seek(at)
            data = f.read(step + 11)
            if len(data) < 12:
                return None
            for i in range(min(step, len(data) - 11)):
                if at + i >= end:
                    return None
                # A length's upper bytes are zero in any real file: a cheap test before the CRC.
                if data[i + 5 : i + 8] == b"\0\0\0" and masked_crc32c(data[i : i + 8]) == int.from_bytes(data[i + 8 : i + 12], "little"):
                    return at + i
            at += step
        return None

    def read(self, partition: Range):
        with vfs.open(partition.path) as f:
            at = self.first_record(f, partition.begin, partition.end) if partition.begin else 0
            if at is None:
                return
            f.seek(at)
            while at < partition.end:
                head = f.read(12)
                if not head:
                    return
                if len(head) < 12 or masked_crc32c(head[:8]) != int.from_bytes(head[8:], "little"):
                    at = self.first_record(f, at + 1, partition.end)
                    if at is None:
                        return
                    f.seek(at)
                    continue
                n = int.from_bytes(head[:8], "little")
                body = f.read(n + 4)
                if len(body) < n + 4:
                    raise ValueError(f"{partition.path} ends within a record at {at}")
                at += n + 16
                if not self.verify or masked_crc32c(body[:n]) == int.from_bytes(body[n:], "little"):
                    yield (body[:n] if self.binary else body[:n].decode(),)


class TFRecordWriter(FileWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite, ".tfrecords")

    def encode(self, row) -> bytes:
        value = row[0]
        data = bytes(value) if isinstance(value, (bytes, bytearray)) else str(value).encode()
        head = len(data).to_bytes(8, "little")
        return head + masked_crc32c(head).to_bytes(4, "little") + data + masked_crc32c(data).to_bytes(4, "little")


# --- lines of a byte range ---


class ByteRangeText(DataSource):
    """Lines within bytes ``begin`` to ``end`` of a file: a line belongs to the range in which it
    starts. Options: path, begin, end (default: the file's), split."""

    @classmethod
    def name(cls) -> str:
        return "byterange"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return ByteRangeReader(dict(self.options))


class ByteRangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local(options["path"])
        self.begin = int(options.get("begin", 0))
        self.end = min(int(options.get("end", 1 << 62)), vfs.getsize(self.path))
        self.split = int(options.get("split", SPLIT))

    def partitions(self):
        step = range_bytes(self.end - self.begin, self.split)
        return [Range(self.path, b, min(b + step, self.end)) for b in range(self.begin, self.end, step)]

    def read(self, partition: Range):
        yield from ((line,) for line in lines_of(partition.path, partition.begin, partition.end))


def lines_of(path: str, begin: int, end: int) -> Iterator[str]:
    """Lines that start in the range."""
    with vfs.open(path) as f:
        if begin:
            f.seek(begin - 1)
            if f.read(1) != b"\n":
                f.readline()
        while f.tell() < end:
            line = f.readline()
            if not line:
                return
            yield line.rstrip(b"\r\n").decode("utf-8", "replace")


# --- gzip text in blocks ---

# How a gzip member begins (magic bytes and the deflate method).
MEMBER = b"\x1f\x8b\x08"


class GzipBlocks(DataSource):
    """Lines of gzip files that are made of many members, read in parallel from any member on.
    Options: path, ext (default ``.gz``), split, and for writing block (bytes of text a member,
    default 1 MB). A file of one member is read by one task. A damaged member ends its file's range
    unless ``skip_damaged`` is true; then reading goes on with the next member."""

    @classmethod
    def name(cls) -> str:
        return "gzblocks"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return GzipBlocksReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return GzipBlocksWriter(dict(self.options), overwrite)


class GzipBlocksReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.skip = options.get("skip_damaged", "false").lower() == "true"

    def partitions(self):
        return byte_ranges(listed(self.options["path"], self.options.get("ext", ".gz")), int(self.options.get("split", SPLIT)))

    @staticmethod
    def begins_member(f, at: int) -> bool:
        f.seek(at)
        head = f.read(1 << 16)
        if not head.startswith(MEMBER) or len(head) < 18 or head[3] & 0xE0:
            return False
        try:
            zlib.decompressobj(31).decompress(head, 1 << 12)
        except zlib.error:
            return False
        return True

    @classmethod
    def next_member(cls, f, at: int) -> int | None:
        """Place of the first member from ``at`` on."""
        step = 1 << 20
        while True:
            f.seek(at)
            data = f.read(step + 2)
            found = data.find(MEMBER)
            while 0 <= found < step:
                if cls.begins_member(f, at + found):
                    return at + found
                found = data.find(MEMBER, found + 1)
            if len(data) < step + 2:
                return None
            at += step

    @staticmethod
    def member(f, at: int) -> tuple[bytes, int]:
        """A member's text and the place after it."""
        machine, out, place = zlib.decompressobj(31), [], at
        f.seek(at)
        while not machine.eof:
            data = f.read(1 << 16)
            if not data:
                raise zlib.error("the file ends within a member")
            out.append(machine.decompress(data))
            place += len(data) - len(machine.unused_data)
        return b"".join(out), place

    @staticmethod
    def data_at(f, at: int) -> bool:
        """Whether something else than padding follows."""
        f.seek(at)
        return bool(f.read(64).strip(b"\0"))

    def read(self, partition: Range):
        with vfs.open(partition.path) as f:
            at = self.next_member(f, partition.begin)
            if at is None or at >= partition.end:
                return
            # A line that goes on from the member before belongs to the range before; so every
            # range but the first leaves what comes before its first line end, and reads on through
            # the first line end after its own members.
            skipping, rest = at > 0, b""
            while at is not None:
                beyond = at >= partition.end
                try:
                    text, after = self.member(f, at)
                except zlib.error:
                    if not self.skip:
                        raise
                    at, rest = self.next_member(f, at + 1), b""
                    continue
                at = self.next_member(f, after)
                damaged = at != after and self.data_at(f, after)
                if damaged and not self.skip:
                    raise zlib.error(f"{partition.path} is damaged at {after}")
                if skipping:
                    first = text.find(b"\n")
                    if first < 0:
                        if beyond:
                            return
                        continue
                    text, skipping = text[first + 1 :], False
                    if beyond:
                        return
                *lines, rest = (rest + text).split(b"\n")
                if beyond and lines:
                    yield (lines[0].decode("utf-8", "replace"),)
                    return
                yield from ((line.decode("utf-8", "replace"),) for line in lines)
                rest = b"" if damaged else rest
            if rest and not skipping:
                yield (rest.decode("utf-8", "replace"),)


class GzipBlocksWriter(FileWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite, ".gz")
        self.block = int(options.get("block", 1 << 20))

    def write(self, iterator: Iterator) -> Done:
        def members():
            held, size = [], 0
            for row in iterator:
                held.append(str("" if row[0] is None else row[0]).encode() + b"\n")
                size += len(held[-1])
                if size >= self.block:
                    yield (gzip.compress(b"".join(held), 6, mtime=0),)
                    held, size = [], 0
            if held:
                yield (gzip.compress(b"".join(held), 6, mtime=0),)

        return super().write(members())

    def encode(self, row) -> bytes:
        return row[0]


# --- key-value log ---

# The record layout and its flags.
PADDING = 256
HEADER = struct.Struct("<IiiiII")  # crc, timestamp, flag, version, key size, value size
PICKLED, INTEGER, BOOLEAN, DEFLATED, MARSHALLED = 0x1, 0x2, 0x8, 0x10, 0x20
MAX_KEY, MAX_VALUE = 250, 500 << 20
FNV_PRIME, FNV_START = 0x01000193, 0x811C9DC5


def fnv1a(data: bytes) -> int:
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h


def valid_key(key: bytes) -> bool:
    return 0 < len(key) <= MAX_KEY and not any(c in key for c in b" \r\n\0")


def decoded(flag: int, value: bytes, trusted: bool) -> str:
    """A value as JSON-like text: integers and booleans as such, text as text, bytes as Latin-1."""
    if flag & DEFLATED:
        value = zlib.decompress(value)
    if flag & BOOLEAN:
        return "true" if int(value) else "false"
    if flag & INTEGER:
        return str(int(value))
    if flag & (MARSHALLED | PICKLED):
        if not trusted:
            raise ValueError("serialized objects are only read with option trusted=true")
        import marshal

        made = marshal.loads(value) if flag & MARSHALLED else pickle.loads(value)
        return made if isinstance(made, str) else json.dumps(made, default=str)
    return value.decode("utf-8", "replace")


class KVLog(DataSource):
    """Log-structured key-value files. Columns: key, value (text; or flag and value bytes with
    option ``raw``), version, ts.

    Reading: files ``*.data`` below path; padding-aligned resynchronisation after damage; equality
    filters on ``key`` are applied before values are decoded, through the hint file if there is one
    and ``fullscan`` is not set. Writing: options ``depth`` (0 to 2), ``raw``; keys that are not
    valid are left out; a hint file lies beside each data file.
    """

    @classmethod
    def name(cls) -> str:
        return "kvlog"

    def schema(self) -> str:
        if self.options.get("raw", "false").lower() == "true":
            return "key string, flag int, value binary, version int, ts int"
        return "key string, value string, version int, ts int"

    def reader(self, schema) -> DataSourceReader:
        return KVReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return KVWriter(dict(self.options), overwrite, [f.name for f in schema.fields])


class KVReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.raw = options.get("raw", "false").lower() == "true"
        self.trusted = options.get("trusted", "false").lower() == "true"
        self.fullscan = options.get("fullscan", "false").lower() == "true"
        self.keys: set[bytes] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self.keys = {str(f.value).encode()} if self.keys is None else self.keys & {str(f.value).encode()}
            elif isinstance(f, In) and f.attribute == ("key",):
                wanted = {str(v).encode() for v in f.value}
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f

    def partitions(self):
        files = listed(self.options["path"], ".data")
        if self.keys is not None and not self.fullscan:
            hinted = [p for p in files if vfs.exists(p[:-5] + ".hint")]
            rest = [p for p in files if p not in set(hinted)]
            return [Range(p, -1, -1) for p in hinted] + byte_ranges(rest, int(self.options.get("split", SPLIT)), PADDING)
        return byte_ranges(files, int(self.options.get("split", SPLIT)), PADDING)

    @staticmethod
    def record(f, check: bool):
        """(size, key, flag, value, version, ts), or None."""
        block = f.read(PADDING)
        if len(block) < HEADER.size:
            return None
        crc, ts, flag, version, ksize, vsize = HEADER.unpack_from(block)
        if not (0 < ksize <= MAX_KEY and vsize <= MAX_VALUE):
            return None
        size = -(-(HEADER.size + ksize + vsize) // PADDING) * PADDING
        if size > PADDING:
            block += f.read(size - PADDING)
        end = HEADER.size + ksize + vsize
        if len(block) < end or check and binascii.crc32(block[4:end]) & 0xFFFFFFFF != crc:
            return None
        return size, block[HEADER.size : HEADER.size + ksize], flag, block[HEADER.size + ksize : end], version, ts

    def row(self, found):
        _, key, flag, value, version, ts = found
        text = key.decode("utf-8", "replace")
        return (text, flag, value, version, ts) if self.raw else (text, decoded(flag, value, self.trusted), version, ts)

    def read(self, partition: Range):
        with vfs.open(partition.path) as f:
            if partition.begin < 0:
                yield from self.hinted(f, partition.path[:-5] + ".hint")
                return
            at, sure = partition.begin, False
            while at < partition.end:
                f.seek(at)
                found = self.record(f, check=not sure)
                if found is None:  # damage, or not the start of a record
                    at, sure = at + PADDING, False
                    continue
                at, sure = at + found[0], True
                if self.keys is None or found[1] in self.keys:
                    yield self.row(found)

    def hinted(self, f, hint: str):
        with vfs.open(hint) as h:
            data = h.read()
        at = 0
        while at + 10 <= len(data):
            place = int.from_bytes(data[at : at + 4], "little")
            n = place & 0xFF
            key = data[at + 10 : at + 10 + n]
            at += 11 + n
            if key in self.keys:
                f.seek(place & 0xFFFFFF00)
                if (found := self.record(f, check=True)) is not None:
                    yield self.row(found)


@dataclass
class Files(WriterCommitMessage):
    """Temporary and final names."""

    names: list


class KVWriter(FileWriter):
    def __init__(self, options: dict, overwrite: bool, fields: list[str]):
        super().__init__(options, overwrite, ".data")
        self.old += expand(self.path, ".hint") if overwrite else []
        self.depth = int(options.get("depth", 0))
        if not 0 <= self.depth <= 2:
            raise ValueError("depth is 0, 1 or 2")
        self.raw = options.get("raw", "false").lower() == "true"
        self.fields = fields
        self.now = int(time.time())

    def write(self, iterator: Iterator) -> Files:
        from pyspark import TaskContext

        n, bits = TaskContext.get().partitionId(), 32 - 4 * self.depth
        if n >= 256:
            raise ValueError("at most 256 partitions; coalesce first")
        out: dict[int, tuple] = {}
        names = []
        try:
            for row in iterator:
                r = dict(zip(self.fields, row))
                key = str(r["key"]).encode()
                if not valid_key(key):
                    continue
                bucket = fnv1a(key) >> bits if self.depth else 0
                if bucket not in out:
                    folder = vfs.join(self.path, *(f"{bucket:0{self.depth}x}" if self.depth else ""))
                    vfs.makedirs(folder)
                    mark = uuid.uuid4().hex
                    pair = [vfs.join(folder, f".{n:03d}-{mark}{e}") for e in (".data", ".hint")]
                    names += [(t, vfs.join(folder, f"{n:03d}{e}")) for t, e in zip(pair, (".data", ".hint"))]
                    out[bucket] = tuple(vfs.open(t, "wb") for t in pair)
                data, hint = out[bucket]
                value, flag = r["value"], int(r.get("flag") or 0)
                if isinstance(value, bool):
                    value, flag = str(int(value)).encode(), flag or BOOLEAN
                elif isinstance(value, int):
                    value, flag = str(value).encode(), flag or INTEGER
                elif not isinstance(value, (bytes, bytearray)):
                    value = str("" if value is None else value).encode()
                version, ts = r.get("version"), r.get("ts")
                body = struct.pack("<iiiII", self.now if ts is None else ts, flag, 1 if version is None else version, len(key), len(value)) + key + bytes(value)
                hint.write(struct.pack("<IiH", data.tell() + len(key), 1 if version is None else version, 0) + key + b"\0")
                record = struct.pack("<I", binascii.crc32(body) & 0xFFFFFFFF) + body
                data.write(record + b"\0" * (-len(record) % PADDING))
        finally:
            for pair in out.values():
                for f in pair:
                    f.close()
        return Files(names)

    def commit(self, messages) -> None:
        for old in self.old:
            vfs.remove(old)
        for m in messages:
            for temporary, final in m.names if m else ():
                vfs.replace(temporary, final)

    def abort(self, messages) -> None:
        for m in messages:
            for temporary, _ in m.names if m else ():
                if vfs.exists(temporary):
                    vfs.remove(temporary)


def only_latest(log: DataFrame) -> DataFrame:
    """The row of greatest timestamp of each key (of these the greatest version)."""
    rest = [c for c in log.columns if c != "key"]
    return log.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("ts", "version")).alias("x")).select("key", "x.*")


def register_all(spark: SparkSession) -> None:
    """Make the formats known to a session, and let them apply filters themselves."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FixedBinary, TFRecord, ByteRangeText, GzipBlocks, KVLog):
        spark.dataSource.register(source)


def write_limited(df: DataFrame, source: str, path: str, overwrite: bool = True, **options) -> None:
    """Write with one of these formats, in at most 256 partitions."""
    register_all(df.sparkSession)
    n = df.rdd.getNumPartitions()
    frame = df.coalesce(256) if n > 256 else df
    frame.write.format(source).mode("overwrite" if overwrite else "append").options(**options).save(path)
