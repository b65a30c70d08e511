"""Progressive JPEG in numpy: an encoder of byte payloads as quantised coefficients, and a decoder to RGB tensors.

The payload is stored losslessly in the format's own unit, the quantised coefficient. A byte b of an AC place is the
coefficient whose category is eight and whose extra bits are b (b from 128 up, b - 255 below); a byte of a DC place gives
the difference to the DC value before it, the lowest bit apart. Every coefficient comes by successive approximation: a
first scan without its lowest bit, a refining scan with that bit; DC and AC places are separate spectral bands. The
Huffman tables have one code of one bit, so each first-scan coefficient is a byte and each refined block eight.

The decoder handles any progressive Huffman JPEG of 8 bits with one or three components (spectral selection, successive
approximation, restart intervals, subsampled chroma). Scans coded as above are recognised by their tables and decoded in bulk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

UNIT = 576  # bytes of payload: nine blocks of 64 coefficients
RESTART = 1  # sampling units between restarts of the DC prediction, so that no DC value leaves its eleven bits
MOST_COLUMNS = 4095  # of units of 16 x 16 samples, in 65,520


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


def inverse() -> np.ndarray:
    """64 x 64 matrix from zigzag coefficients to row-major samples."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)  # frequency by place
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


ZIGZAG = zigzag()
INVERSE = inverse()


# ---- encoding


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_segment(kind: int, symbol: int) -> bytes:
    """A table of one code, a single zero bit."""
    return segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))


def scan_header(components: list[int], first: int, last: int, high: int, low: int) -> bytes:
    body = bytes([len(components), *[x for c in components for x in (c, 0)], first, last, high << 4 | low])
    return segment(0xDA, body)


def layout(units: int) -> tuple[int, int]:
    """Rows and columns of sampling units."""
    rows = -(-units // MOST_COLUMNS)
    return rows, -(-units // rows)


def pad(payload: bytes) -> bytes:
    return payload + b"\xff" * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def encode(data: bytes) -> bytes:
    """A progressive JPEG (4:2:0) that holds `data`, padded; its length stands in a comment."""
    payload = pad(data)
    blocks = len(payload) // 64
    rows, columns = layout(-(-blocks // 6))
    units = rows * columns
    b = np.full((units * 6, 64), 255, np.uint8)  # in the order of the interleaved scan
    b[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    out = [b"\xff\xd8", segment(0xFE, b"payload %d" % len(data)), segment(0xDB, bytes([0] + [1] * 64))]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # DC, all but the lowest bit: one byte a block, a restart every RESTART units
    out += [huffman_segment(0x00, 7), segment(0xDD, struct.pack(">H", RESTART)), scan_header([1, 2, 3], 0, 0, 0, 1)]
    dc = (b[:, 0] >> 1).tobytes()
    step = RESTART * 6
    out.append(b"".join(x for k in range(0, len(dc), step) for x in ((b"\xff" + bytes([0xD0 + (k // step - 1) % 8]) if k else b""), dc[k : k + step])))
    out += [segment(0xDD, struct.pack(">H", 0)), scan_header([1, 2, 3], 0, 0, 1, 0), stuffed(np.packbits(b[:, 0] & 1), len(b))]
    planes = deal(b, rows, columns)
    out.append(huffman_segment(0x10, 7))
    for c, plane in enumerate(planes, 1):
        out += [scan_header([c], 1, 63, 0, 1), (plane[:, 1:] >> 1).tobytes()]
    out.append(huffman_segment(0x10, 0))
    for c, plane in enumerate(planes, 1):
        bits = np.zeros((len(plane), 64), np.uint8)  # one code bit, then a correction for each of 63 coefficients
        bits[:, 1:] = (plane[:, 1:] & 1) ^ (plane[:, 1:] < 128)
        out += [scan_header([c], 1, 63, 1, 0), stuffed(np.packbits(bits.ravel()), bits.size)]
    return b"".join([*out, b"\xff\xd9"])


def stuffed(data: np.ndarray, bits: int) -> bytes:
    """Entropy-coded bytes: ones fill up the last one, a zero byte follows each 255."""
    if bits % 8:
        data = data.copy()
        data[-1] |= (1 << (8 - bits % 8)) - 1
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def deal(b: np.ndarray, rows: int, columns: int) -> list[np.ndarray]:
    """Blocks of the interleaved order to one raster of blocks for each component."""
    u = b.reshape(rows, columns, 6, 64)
    luma = u[:, :, :4].reshape(rows, columns, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    return [luma, u[:, :, 4].reshape(-1, 64), u[:, :, 5].reshape(-1, 64)]


def gather(planes: list[np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The opposite of deal."""
    u = np.empty((rows, columns, 6, planes[0].shape[-1]), planes[0].dtype)
    u[:, :, :4] = planes[0].reshape(rows, 2, columns, 2, -1).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, -1)
    u[:, :, 4], u[:, :, 5] = (p.reshape(rows, columns, -1) for p in planes[1:])
    return u.reshape(rows * columns * 6, -1)


# ---- decoding


@dataclass
class Component:
    h: int
    v: int
    q: int
    wide: int = 0  # blocks of the component's own samples
    high: int = 0
    across: int = 0  # blocks with those that fill up the last units
    coefficients: np.ndarray = None  # [block row, block column, zigzag place]


@dataclass
class Image:
    height: int
    width: int
    components: dict[int, Component]
    tables: dict[int, np.ndarray]
    comment: bytes


class Bits:
    """Bits of one restart interval, bytes unstuffed; zeros follow its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.n = data.replace(b"\xff\x00", b"\xff"), 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.n >> 3, (self.n + n + 7) >> 3
        v = int.from_bytes(self.data[a:b].ljust(b - a, b"\0"), "big") >> (8 * b - self.n - n)
        self.n += n
        return v & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")


def extend(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def read_huffman(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    while body:
        counts, code, at, table = body[1:17], 0, 17, {}
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                table[n, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        yield body[0], table
        body = body[at:]


def entropy_end(data: bytes, at: int) -> int:
    """Where the next marker stands that is no restart."""
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def intervals(data: bytes, restart: int) -> list[bytes]:
    if not restart:
        return [data]
    out, begin, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        at = data.find(b"\xff", at + 2)
    return [*out, data[begin:]]


def decode(data: bytes) -> Image:
    """Coefficient arrays of a progressive JPEG, gathered over its scans. ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, huffman, quant, restart, comment, at = None, {}, {}, 0, b"", 2
    while at + 4 <= len(data) and data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            huffman |= dict(read_huffman(body))
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            image = frame(body, quant)
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan without a progressive frame")
            end = entropy_end(data, at)
            read_scan(image, body, data[at:end], huffman, restart)
            at = end
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a progressive Huffman JPEG")
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def frame(body: bytes, quant: dict[int, np.ndarray]) -> Image:
    depth, height, width, n = struct.unpack(">BHHB", body[:6])
    if depth != 8 or n not in (1, 3):
        raise ValueError("only 8 bits and one or three components")
    parts = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
    if n == 1:
        for c in parts.values():
            c.h = c.v = 1
    top_h, top_v = max(c.h for c in parts.values()), max(c.v for c in parts.values())
    rows, columns = -(-height // (8 * top_v)), -(-width // (8 * top_h))
    for c in parts.values():
        c.wide, c.high = -(-(-(-width * c.h // top_h)) // 8), -(-(-(-height * c.v // top_v)) // 8)
        c.across = columns * c.h
        c.coefficients = np.zeros((rows * c.v, c.across, 64), np.int16)
    return Image(height, width, parts, quant, b"")


def order(image: Image, ids: list[int]) -> list[list[tuple[int, np.ndarray]]]:
    """(component, flat block numbers) of the scan: alone in the raster of its own blocks, else by sampling units."""
    if len(ids) == 1:
        c = image.components[ids[0]]
        return [(ids[0], (np.arange(c.high)[:, None] * c.across + np.arange(c.wide)).reshape(-1, 1))]
    out = []
    for i in ids:
        c = image.components[i]
        n = c.coefficients.reshape(-1, 64).shape[0]
        grid = np.arange(n).reshape(-1, c.v, c.across // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.h * c.v)
        out.append((i, grid))
    return out


def read_scan(image: Image, head: bytes, data: bytes, huffman: dict, restart: int) -> None:
    n = head[0]
    ids = [head[1 + 2 * i] for i in range(n)]
    dc_tables, ac_table = {i: huffman.get(head[2 + 2 * k] >> 4) for k, i in enumerate(ids)}, huffman.get(0x10 | head[2] & 15)
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    blocks = order(image, ids)
    if first == 0 and last:
        raise ValueError("DC and AC in one progressive scan")
    if bulk(image, blocks, data, first, last, high, low, dc_tables, ac_table, restart):
        return
    flat = {i: image.components[i].coefficients.reshape(-1, 64) for i in ids}
    units = len(blocks[0][1])
    for k, part in enumerate(intervals(data, restart)):
        bits = Bits(part)
        lo, hi = (k * restart, min(units, (k + 1) * restart)) if restart else (0, units)
        if first == 0:
            before = dict.fromkeys(ids, 0)
            for u in range(lo, hi):
                for i, grid in blocks:
                    for b in grid[u]:
                        if high:
                            flat[i][b, 0] |= bits.take(1) << low
                        else:
                            size = bits.symbol(dc_tables[i])
                            before[i] += extend(bits.take(size), size)
                            flat[i][b, 0] = before[i] << low
        else:
            run = 0
            for u in range(lo, hi):
                row = flat[ids[0]][blocks[0][1][u, 0]]
                run = refine(bits, row, ac_table, first, last, low, run) if high else advance(bits, row, ac_table, first, last, low, run)


def advance(bits: Bits, row: np.ndarray, table: dict, first: int, last: int, low: int, run: int) -> int:
    """A first AC scan of one block; returns the number of further blocks without any."""
    if run:
        return run - 1
    k = first
    while k <= last:
        skip, size = divmod(bits.symbol(table), 16)
        if size:
            k += skip
            row[k] = extend(bits.take(size), size) * (1 << low)
            k += 1
        elif skip < 15:
            return (1 << skip) + bits.take(skip) - 1
        else:
            k += 16
    return 0


def refine(bits: Bits, row: np.ndarray, table: dict, first: int, last: int, low: int, run: int) -> int:
    """A refining AC scan of one block."""

    def correct(k: int) -> None:
        if bits.take(1):
            row[k] += (1 << low) if row[k] > 0 else -(1 << low)

    k = first
    while not run and k <= last:
        skip, size = divmod(bits.symbol(table), 16)
        if not size and skip < 15:
            run = (1 << skip) + bits.take(skip)
            break
        new = (1 << low if bits.take(1) else -(1 << low)) if size else 0
        while k <= last:
            if row[k]:
                correct(k)
            elif skip:
                skip -= 1
            else:
                if new:
                    row[k] = new
                k += 1
                break
            k += 1
    if run:
        for at in range(k, last + 1):
            if row[at]:
                correct(at)
        run -= 1
    return run


def bulk(image: Image, blocks: list, data: bytes, first: int, last: int, high: int, low: int, dc_tables: dict, ac_table: dict | None, restart: int) -> bool:
    """Decode a scan whose codes are all one zero bit, if it is one and the bytes bear that out; nothing is changed else."""
    only = {(1, 0): 7}
    flat = {i: image.components[i].coefficients.reshape(-1, 64) for i, _ in blocks}
    units, per = len(blocks[0][1]), sum(g.shape[1] for _, g in blocks)
    total = units * per
    if first == 0 and not high and all(t == only for t in dc_tables.values()):
        parts = intervals(data, restart)
        if len(parts) != (-(-units // restart) if restart else 1) or b"\xff" in b"".join(parts):
            return False
        e = np.frombuffer(b"".join(parts), np.uint8)
        if len(e) != total or e.max(initial=0) > 127 or any(len(p) != restart * per for p in parts[:-1]):
            return False
        e = e.reshape(units, per).astype(np.int16)
        d = np.where(e >= 64, e, e - 127)
        at, span = 0, restart or units
        for i, g in blocks:
            n = g.shape[1]
            own = np.zeros((-(-units // span) * span, n), np.int64)
            own[:units] = d[:, at : at + n]
            own = np.cumsum(own.reshape(-1, span * n), axis=1).reshape(-1, n)[:units]
            flat[i][g, 0] = own << low
            at += n
        return True
    if first == 0 and high and not restart:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        if len(raw) != -(-total // 8):
            return False
        bits = np.unpackbits(raw)[:total].reshape(units, per).astype(np.int16)
        at = 0
        for i, g in blocks:
            flat[i][g, 0] |= bits[:, at : at + g.shape[1]] << low
            at += g.shape[1]
        return True
    n = last - first + 1
    if first and not high and not restart and ac_table == only and b"\xff" not in data:
        e = np.frombuffer(data, np.uint8)
        if len(e) != units * n or e.max(initial=0) > 127:
            return False
        e = e.reshape(units, n).astype(np.int16)
        i, g = blocks[0]
        flat[i][g[:, 0], first : last + 1] = np.where(e >= 64, e, e - 127) * (1 << low)
        return True
    if first and high and not restart and ac_table == {(1, 0): 0} and n == 63:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        i, g = blocks[0]
        if len(raw) != units * 8:
            return False
        now = flat[i][g[:, 0], 1:]
        bits = np.unpackbits(raw).reshape(units, 64)
        if bits[:, 0].any() or not now.all():
            return False
        flat[i][g[:, 0], 1:] = now + np.sign(now) * (bits[:, 1:].astype(np.int16) << low)
        return True
    return False


def payload(image: Image) -> bytes:
    """The bytes that `encode` stored, padded."""
    parts = list(image.components.values())
    rows, columns = parts[1].coefficients.shape[:2]
    c = gather([p.coefficients.reshape(-1, 64) for p in parts], rows, columns)
    b = np.where(c > 0, c, c + 255).astype(np.uint8)
    dc = c[:, 0].reshape(-1, 6).astype(np.int64)
    high, low = dc >> 1, dc & 1
    for lo, hi in ((0, 4), (4, 5), (5, 6)):  # differences within each component and restart interval
        own = high[:, lo:hi].ravel()
        d = np.diff(own, prepend=0)
        d[:: RESTART * (hi - lo)] = own[:: RESTART * (hi - lo)]
        high[:, lo:hi] = np.where(d > 0, d, d + 127).reshape(-1, hi - lo)
    b[:, 0] = (high * 2 + low).ravel()
    size = int(image.comment.split()[1])
    return b.tobytes()[: max(UNIT, -(-size // UNIT) * UNIT)]


def samples(image: Image) -> list[np.ndarray]:
    """Each component's samples at full resolution: inverse transform, then every chroma sample repeated to the luma grid."""
    top_h, top_v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    out = []
    for c in image.components.values():
        high, wide = c.coefficients.shape[:2]
        x = (c.coefficients.reshape(-1, 64) * image.tables[c.q]) @ INVERSE
        x = np.clip(np.rint(x + 128), 0, 255).astype(np.uint8).reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8)
        if top_h % c.h or top_v % c.v:
            raise ValueError("sampling factors must divide")
        if top_v > c.v:
            x = np.repeat(x, top_v // c.v, axis=0)
        if top_h > c.h:
            x = np.repeat(x, top_h // c.h, axis=1)
        out.append(x[: image.height, : image.width])
    return out


def rgb(image: Image) -> np.ndarray:
    """uint8 [height, width, 3]."""
    parts = samples(image)
    if len(parts) == 1:
        return np.repeat(parts[0][:, :, None], 3, axis=2)
    y, cb, cr = (p.astype(np.float32) for p in parts)
    cb -= 128
    cr -= 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, k] = np.clip(x + 0.5, 0, 255)
    return out


# ---- columns


def to_media(docs: DataFrame, outputs: tuple[str, ...] = ("media", "height", "width", "rgb")) -> DataFrame:
    """doc_id and the columns asked for, a row for each document (null text: empty payload).

    media (binary): the JPEG. height, width (int) and rgb (binary, row-major uint8 triples): the tensor, decoded from the
    stored bytes. digests: n_bytes, payload_bytes, payload_sha256, tail_crc32 (the payload is read back from the stored
    bytes), media_bytes, media_sha256 and feature (height x width, then the tensor's mean and deviation by channel).
    Equal texts give equal values. One text is in memory at a time; the limit is the format's 65,535 x 65,535 samples.
    """
    kinds = {"media": "media binary", "height": "height int", "width": "width int", "rgb": "rgb binary"}
    digest = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [n for o in outputs for n in ([x.split()[0] for x in digest.split(", ")] if o == "digests" else [o])]
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(digest if o == "digests" else kinds[o] for o in outputs)])

    def one(data: bytes) -> dict[str, object]:
        media = encode(data)
        image = decode(media)
        tensor = rgb(image)
        row: dict[str, object] = {"media": media, "height": image.height, "width": image.width}
        if "rgb" in outputs:
            row["rgb"] = tensor.tobytes()
        if "digests" in outputs:
            back = payload(image)
            n = tensor.shape[0] * tensor.shape[1]
            flat = tensor.reshape(n, 3)
            mean = flat.sum(0, dtype=np.int64) / n
            square = np.array([np.dot(f, f) for f in flat.T.astype(np.float64)]) / n
            told = ",".join(f"{v:.3f}" for v in [*mean, *np.sqrt(np.maximum(square - mean * mean, 0))])
            row |= {"n_bytes": int(image.comment.split()[1]), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:])}
            row |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"{image.height}x{image.width}:{told}"}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            rows = [one(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[n] for r in rows], pa.int32() if n in ("height", "width") else None) for n in names]], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
