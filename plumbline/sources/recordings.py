"""Raw recordings in vendors' formats as Spark data sources: MATLAB 5 files, GDF 2 and Neuroscan CNT.

Each is a Python data source: a schema, partitions and a reader. A partition is a range of a file's bytes (records, blocks
of samples, or top-level elements), reached by a seek; no task reads a whole recording. What is wrong with a file is told
in the column `error` of a row, so one bad file stops no others.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that one task reads, unless an option says otherwise.
SPLIT = 32 << 20


def opened(path: str) -> BinaryIO:
    """A file that can be sought in, of the local store or of any that its URI names."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path.removeprefix("file://"), "rb")


def listed(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a pattern or a folder names, sorted."""
    if "://" in pattern and not pattern.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(pattern)
        found = store.get_file_info(inner)
        some = [found] if found.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
        scheme = pattern.split("://", 1)[0]
        return sorted((f"{scheme}://{f.path}", f.size) for f in some if f.is_file)
    local = pattern.removeprefix("file://")
    names = [p for p in glob.glob(f"{local}/**" if os.path.isdir(local) else local, recursive=True) if os.path.isfile(p)]
    return sorted((p, os.path.getsize(p)) for p in names)


@dataclass
class Piece(InputPartition):
    path: str
    first: int
    last: int
    note: str | None = None


class Recordings(DataSource):
    """Options: path (a file, a folder or a pattern), split (bytes of a task)."""

    columns = ""
    reads: type

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return self.reads(self.options)


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options.get("path", "")
        self.split = int(options.get("split", SPLIT))
        self.most = int(options.get("most", 50_000_000))

    def pieces(self, path: str, size: int) -> Iterator[Piece]:
        raise NotImplementedError

    def rows(self, piece: Piece) -> Iterator[tuple]:
        raise NotImplementedError

    def failed(self, path: str, why: str) -> tuple:
        raise NotImplementedError

    def partitions(self) -> list[Piece]:
        out: list[Piece] = []
        for path, size in listed(self.path):
            try:
                out += self.pieces(path, size)
            except (ValueError, struct.error, IndexError, EOFError) as e:
                out.append(Piece(path, 0, 0, f"{type(e).__name__}: {e}"))
        return out or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not piece.path:
            return
        if piece.note is not None and piece.last <= piece.first:
            yield self.failed(piece.path, piece.note)
            return
        try:
            yield from self.rows(piece)
        except (ValueError, struct.error, IndexError, zlib.error, EOFError) as e:
            yield self.failed(piece.path, f"{type(e).__name__}: {e}")
        if piece.note is not None:
            yield self.failed(piece.path, piece.note)


def taken(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise EOFError(f"{n} bytes wanted, {len(data)} there")
    return data


# ---- MATLAB 5: tagged elements, some of them deflated

#: Element types of numbers, and classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, DEFLATED = 14, 15
CELL, STRUCT, CHAR, SPARSE = 1, 2, 4, 5
CLASSES = {6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}


class Elements:
    """Walks over the elements in a stretch of bytes."""

    def __init__(self, data: bytes, order: str) -> None:
        self.data, self.order, self.at = data, order, 0

    def next(self) -> tuple[int, bytes]:
        if self.at + 8 > len(self.data):
            raise EOFError("an element's tag is cut off")
        kind, size = struct.unpack_from(self.order + "II", self.data, self.at)
        if kind >> 16:  # small: size and type share four bytes, the data are in the other four
            kind, size, begin = kind & 0xFFFF, kind >> 16, self.at + 4
            self.at += 8
        else:
            begin = self.at + 8
            self.at = begin + size + (0 if kind == DEFLATED else -size % 8)
        if begin + size > len(self.data):
            raise EOFError(f"an element of {size} bytes is cut off")
        return kind, self.data[begin : begin + size]

    def numbers(self) -> np.ndarray:
        kind, data = self.next()
        if kind in TEXTS:
            return np.array([ord(c) for c in data.decode(TEXTS[kind])], np.uint32)
        if kind not in NUMBERS:
            raise ValueError(f"numbers wanted, element type {kind} found")
        return np.frombuffer(data, self.order + NUMBERS[kind])


def leaves(data: bytes, order: str, name: str | None, most: int) -> Iterator[tuple[str, str, list[int], list[float] | None, str | None]]:
    """(name, kind, shape, row-major numbers, text) of an array and of everything inside it; fields by `.`, cells and elements of structs by `[place]`."""
    e = Elements(data, order)
    flags = int(e.numbers()[0])
    shape = [int(n) for n in e.numbers()]
    own = e.next()[1].decode("latin-1")
    name = own if name is None else name
    kind, count = flags & 0xFF, int(np.prod(shape))
    if kind == CELL:
        for k in range(count):
            yield from inside(e, order, f"{name}[{k}]", most)
    elif kind == STRUCT:
        width = int(e.numbers()[0])
        names = e.next()[1]
        fields = [names[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(names), width)]
        for k in range(count):
            for field in fields:
                yield from inside(e, order, f"{name}.{field}" if count == 1 else f"{name}[{k}].{field}", most)
    elif kind == CHAR:
        x = e.numbers().reshape(shape, order="F")
        yield name, "char", shape, None, "\n".join("".join(map(chr, row)) for row in x.reshape(x.shape[0] if x.size else 0, -1))
    elif kind in CLASSES:
        if count > most:
            raise ValueError(f"{name} has {count} numbers")
        x = e.numbers().astype(float)
        if len(x) != count:
            raise ValueError(f"{name}: {len(x)} numbers for shape {shape}")
        yield name, "complex" if flags & 0x800 else CLASSES[kind], shape, x.reshape(shape, order="F").ravel().tolist(), None
    else:
        raise ValueError(f"{name}: arrays of class {kind} are not read")


def inside(e: Elements, order: str, name: str, most: int) -> Iterator[tuple]:
    kind, data = e.next()
    if kind != MATRIX:
        raise ValueError(f"{name}: an array wanted, element type {kind} found")
    if data:
        yield from leaves(data, order, name, most)


class MatlabReader(Reader):
    def pieces(self, path: str, size: int) -> Iterator[Piece]:
        """A small file is one piece; of a large one every top-level element, found by tags alone."""
        with opened(path) as f:
            head = f.read(128)
            if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
                raise ValueError("no MATLAB 5 file")
            if size <= self.split:
                yield Piece(path, 128, size)
                return
            order, at = ("<" if head[126:128] == b"IM" else ">"), 128
            while at < size:
                f.seek(at)
                kind, n = struct.unpack(order + "II", taken(f, 8))
                step = 8 if kind >> 16 else 8 + n + (0 if kind == DEFLATED else -n % 8)
                yield Piece(path, at, min(size, at + step))
                at += step

    def rows(self, piece: Piece) -> Iterator[tuple]:
        with opened(piece.path) as f:
            order = "<" if f.read(128)[126:128] == b"IM" else ">"
            f.seek(piece.first)
            at = piece.first
            while at < piece.last:
                tag = taken(f, 8)
                kind, n = struct.unpack(order + "II", tag)
                if kind >> 16:
                    at += 8
                    continue
                data = taken(f, n)
                at += 8 + n + (0 if kind == DEFLATED else -n % 8)
                f.seek(at)
                if kind == DEFLATED:
                    kind, data = Elements(zlib.decompress(data), order).next()
                if kind == MATRIX:
                    for name, what, shape, numbers, text in leaves(data, order, None, self.most):
                        yield piece.path, name, what, shape, numbers, text, None

    def failed(self, path: str, why: str) -> tuple:
        return path, None, None, None, None, None, why


class Matlab(Recordings):
    """(path, name, kind, shape, data, text, error): a row for every numeric or text array in MATLAB 5 files, nested ones by their path; numbers row-major."""

    columns = "path string, name string, kind string, shape array<int>, data array<double>, text string, error string"
    reads = MatlabReader

    @classmethod
    def name(cls) -> str:
        return "matlab5"


# ---- GDF 2: a header, records of all channels, an event table behind them

#: Sample types.
SAMPLES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "i8", 8: "u8", 16: "f4", 17: "f8"}


@dataclass
class Gdf:
    begin: int
    records: int
    seconds: float
    labels: list[str]
    per_record: list[int]
    kinds: list[str]
    gain: np.ndarray
    offset: np.ndarray

    @property
    def record_bytes(self) -> int:
        return sum(n * np.dtype(k).itemsize for n, k in zip(self.per_record, self.kinds, strict=True))


def gdf_header(f: BinaryIO) -> Gdf:
    fixed = taken(f, 256)
    if not fixed.startswith(b"GDF 2"):
        raise ValueError("no GDF 2 file")
    blocks, records, (num, den), ns = struct.unpack_from("<H", fixed, 184)[0], struct.unpack_from("<q", fixed, 236)[0], struct.unpack_from("<II", fixed, 244), struct.unpack_from("<H", fixed, 252)[0]
    own = taken(f, 256 * ns)

    def column(at: int, kind: str) -> np.ndarray:
        return np.frombuffer(own, "<" + kind, ns, at * ns)

    labels = [own[16 * k : 16 * k + 16].split(b"\0")[0].decode("latin-1").strip() for k in range(ns)]
    low, high, dlow, dhigh = (column(at, "f8") for at in (104, 112, 120, 128))
    gain = (high - low) / np.where(dhigh == dlow, 1, dhigh - dlow)
    kinds = [int(k) for k in column(220, "u4")]
    if bad := [k for k in kinds if k not in SAMPLES]:
        raise ValueError(f"samples of type {bad[0]} are not read")
    return Gdf(256 * blocks, records, num / den if den else 0.0, labels, [int(n) for n in column(216, "u4")], ["<" + SAMPLES[k] for k in kinds], gain, low - gain * dlow)


class GdfReader(Reader):
    def pieces(self, path: str, size: int) -> Iterator[Piece]:
        """Ranges of records. Where the file ends before its last record, or does not say how many there are, those that are whole are read."""
        with opened(path) as f:
            h = gdf_header(f)
        if not h.record_bytes:
            raise ValueError("a record without samples")
        whole = (size - h.begin) // h.record_bytes
        records = min(h.records, whole) if h.records >= 0 else whole
        note = f"cut off: {whole} of {h.records} records" if whole < h.records else None
        each = max(1, self.split // h.record_bytes)
        if records <= 0:
            yield Piece(path, 0, 0, note or "no records")
        for k in range(0, max(0, records), each):
            last = min(records, k + each)
            yield Piece(path, k, last, note if last == records else None)

    def rows(self, piece: Piece) -> Iterator[tuple]:
        with opened(piece.path) as f:
            h = gdf_header(f)
            f.seek(h.begin + piece.first * h.record_bytes)
            for record in range(piece.first, piece.last):
                data, at = taken(f, h.record_bytes), 0
                for k, (n, kind) in enumerate(zip(h.per_record, h.kinds, strict=True)):
                    x = np.frombuffer(data, kind, n, at)
                    at += n * x.dtype.itemsize
                    yield piece.path, record, k, h.labels[k], n / h.seconds if h.seconds else None, (x * h.gain[k] + h.offset[k]).tolist(), None

    def failed(self, path: str, why: str) -> tuple:
        return path, None, None, None, None, None, why


class GdfSamples(Recordings):
    """(path, record, channel, label, rate, values, error): a row for each record and channel of GDF 2 files, values in physical units."""

    columns = "path string, record long, channel int, label string, rate double, values array<double>, error string"
    reads = GdfReader

    @classmethod
    def name(cls) -> str:
        return "gdf2"


class GdfEventReader(Reader):
    def pieces(self, path: str, size: int) -> Iterator[Piece]:
        yield Piece(path, 0, 1)

    def rows(self, piece: Piece) -> Iterator[tuple]:
        with opened(piece.path) as f:
            h = gdf_header(f)
            if h.records < 0:
                raise ValueError("a recording of unknown length has no event table")
            f.seek(h.begin + h.records * h.record_bytes)
            head = f.read(8)
            if not head:
                return
            if len(head) < 8:
                raise EOFError("the event table is cut off")
            mode, n, rate = head[0], int.from_bytes(head[1:4], "little"), struct.unpack("<f", head[4:])[0]
            at, code = np.frombuffer(taken(f, 4 * n), "<u4"), np.frombuffer(taken(f, 2 * n), "<u2")
            channel = np.frombuffer(taken(f, 2 * n), "<u2") if mode & 2 else np.zeros(n, int)
            span = np.frombuffer(taken(f, 4 * n), "<u4") if mode & 2 else np.zeros(n, int)
            for k in range(n):
                yield piece.path, k, int(at[k]) - 1, int(code[k]), int(channel[k]), int(span[k]), float(rate), None

    def failed(self, path: str, why: str) -> tuple:
        return path, None, None, None, None, None, None, why


class GdfEvents(Recordings):
    """(path, event, sample, code, channel, duration, rate, error): the event tables of GDF 2 files; samples from 0, channel 0: all."""

    columns = "path string, event int, sample long, code int, channel int, duration long, rate double, error string"
    reads = GdfEventReader

    @classmethod
    def name(cls) -> str:
        return "gdf2_events"


# ---- Neuroscan CNT: channel headers, blocks of 16- or 32-bit samples, an event table behind them


@dataclass
class Cnt:
    labels: list[str]
    rate: int
    begin: int
    end: int
    block: int
    baseline: np.ndarray
    scale: np.ndarray

    @property
    def channels(self) -> int:
        return len(self.labels)


def cnt_header(f: BinaryIO) -> Cnt:
    fixed = taken(f, 900)
    if not fixed.startswith(b"Version 3"):
        raise ValueError("no CNT file")
    channels, rate = struct.unpack_from("<H", fixed, 370)[0], struct.unpack_from("<H", fixed, 376)[0]
    end, offset = struct.unpack_from("<I", fixed, 886)[0], struct.unpack_from("<i", fixed, 894)[0]
    if not channels or not rate:
        raise ValueError("a recording without channels or rate")
    own = taken(f, 75 * channels)
    part = lambda at, kind: np.array([struct.unpack_from("<" + kind, own, 75 * k + at)[0] for k in range(channels)], float)
    labels = [own[75 * k : 75 * k + 10].split(b"\0")[0].decode("latin-1") for k in range(channels)]
    return Cnt(labels, rate, 900 + 75 * channels, end, offset, part(47, "h"), part(59, "f") * part(71, "f") / 204.8)


class CntReader(Reader):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.width = int(options.get("bytes", 2))
        if self.width not in (2, 4):
            raise ValueError("samples have 2 or 4 bytes")

    def block(self, h: Cnt) -> int:
        """Samples of a channel that stand together: 1 where channels alternate."""
        return max(1, h.block // self.width)

    def pieces(self, path: str, size: int) -> Iterator[Piece]:
        """Ranges of blocks. A block that the file does not hold whole is told, not read."""
        with opened(path) as f:
            h = cnt_header(f)
        one = self.block(h) * h.channels * self.width
        wanted, whole = -(-(h.end - h.begin) // one), (min(size, h.end) - h.begin) // one
        note = f"cut off: {whole} of {wanted} blocks" if whole < wanted else None
        each = max(1, self.split // one)
        if whole <= 0:
            yield Piece(path, 0, 0, note or "no samples")
        for k in range(0, max(0, whole), each):
            last = min(whole, k + each)
            yield Piece(path, k, last, note if last == whole else None)

    def rows(self, piece: Piece) -> Iterator[tuple]:
        with opened(piece.path) as f:
            h = cnt_header(f)
            block = self.block(h)
            one = block * h.channels * self.width
            f.seek(h.begin + piece.first * one)
            step = max(1, (1 << 20) // one)
            for k in range(piece.first, piece.last, step):
                n = min(step, piece.last - k)
                raw = np.frombuffer(taken(f, n * one), f"<i{self.width}").reshape(n, h.channels, block)
                x = (raw.transpose(1, 0, 2).reshape(h.channels, -1) - h.baseline[:, None]) * h.scale[:, None]
                for c in range(h.channels):
                    yield piece.path, k * block, c, h.labels[c], float(h.rate), x[c].tolist(), None

    def failed(self, path: str, why: str) -> tuple:
        return path, None, None, None, None, None, why


class CntSamples(Recordings):
    """(path, start, channel, label, rate, values, error): stretches of samples from `start` on, a row for each channel, in microvolts. Option bytes: 2 or 4."""

    columns = "path string, start long, channel int, label string, rate double, values array<double>, error string"
    reads = CntReader

    @classmethod
    def name(cls) -> str:
        return "cnt"


class CntEventReader(CntReader):
    def pieces(self, path: str, size: int) -> Iterator[Piece]:
        yield Piece(path, 0, 1)

    def rows(self, piece: Piece) -> Iterator[tuple]:
        with opened(piece.path) as f:
            h = cnt_header(f)
            f.seek(h.end)
            head = f.read(9)
            if not head:
                return
            if len(head) < 9:
                raise EOFError("the event table is cut off")
            kind, size = struct.unpack_from("<Bi", head)
            width = {1: 8, 2: 19, 3: 19}.get(kind)
            if not width:
                raise ValueError(f"events of type {kind} are not read")
            for k in range(size // width):
                code, _, _, at = struct.unpack_from("<HBBi", taken(f, width))
                sample = at if kind == 3 else (at - h.begin) // (h.channels * self.width)
                yield piece.path, k, sample, code, None

    def failed(self, path: str, why: str) -> tuple:
        return path, None, None, None, why


class CntEvents(Recordings):
    """(path, event, sample, code, error): the event tables of CNT files."""

    columns = "path string, event int, sample long, code int, error string"
    reads = CntEventReader

    @classmethod
    def name(cls) -> str:
        return "cnt_events"


def load(spark: SparkSession, source: type[Recordings], path: str, **options) -> DataFrame:
    """The rows of a source, such as `load(spark, GdfSamples, folder)`; without a copy of the file anywhere."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", path)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
