"""Recordings whose bytes are written here, one after the other: read back whole, in pieces, and cut off."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import recordings as rec

# ---- MATLAB 5


def element(kind, data, order="<", small=False):
    if small and len(data) <= 4:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array(name, kind, shape, body, order="<", flags=0):
    head = element(6, struct.pack(order + "II", kind | flags, 0), order) + element(5, struct.pack(order + "i" * len(shape), *shape), order)
    return element(14, head + element(1, name.encode(), order, small=True) + body, order)


def numeric(name, x, order="<", kind=6, code=9):
    return array(name, kind, x.shape, element(code, x.astype(order + rec.NUMBERS[code]).tobytes(order="F"), order, small=True), order)


def text(name, s, order="<"):
    return array(name, 4, (1, len(s)), element(4, np.array([ord(c) for c in s], order + "u2").tobytes(), order, small=True), order)


def structure(name, fields, order="<"):
    width = 32
    names = b"".join(f.encode().ljust(width, b"\0") for f in fields)
    body = element(5, struct.pack(order + "i", width), order, small=True) + element(1, names, order) + b"".join(fields.values())
    return array(name, 2, (1, 1), body, order)


def cell(name, items, order="<"):
    return array(name, 1, (1, len(items)), b"".join(items), order)


def matlab_file(*elements, order="<", deflate=False):
    parts = [struct.pack(order + "II", 15, len(z)) + z for z in map(zlib.compress, elements)] if deflate else elements
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI") + b"".join(parts)


def recorded(order="<"):
    trial = lambda k: structure("", {"X": numeric("", np.arange(6.0).reshape(2, 3) + 10 * k, order), "y": numeric("", np.array([[1, 2, k]]), order, 12, 5), "note": text("", f"n{k}", order)}, order)
    return [numeric("rate", np.array([[250]]), order, 6, 2), cell("data", [trial(0), trial(1)], order), numeric("small", np.array([[1.5, -2.0]], np.float32), order, 7, 7), text("subject", "S1 é", order)]


@pytest.mark.parametrize(("order", "deflate"), [("<", False), ("<", True), (">", False), (">", True)])
@pytest.mark.parametrize("split", [32 << 20, 1])
def test_matlab(spark, tmp_path, order, deflate, split):
    (tmp_path / "a.mat").write_bytes(matlab_file(*recorded(order), order=order, deflate=deflate))
    got = {r["name"]: r for r in rec.load(spark, rec.Matlab, f"{tmp_path}/*.mat", split=split).collect()}
    assert set(got) == {"rate", "data[0].X", "data[0].y", "data[0].note", "data[1].X", "data[1].y", "data[1].note", "small", "subject"}
    assert got["data[1].X"]["shape"] == [2, 3] and got["data[1].X"]["data"] == [10.0, 11.0, 12.0, 13.0, 14.0, 15.0] and got["data[1].X"]["kind"] == "double"
    assert got["data[1].y"]["data"] == [1, 2, 1] and got["rate"]["data"] == [250] and got["small"]["data"] == [1.5, -2.0]
    assert got["subject"]["text"] == "S1 é" and got["data[0].note"]["text"] == "n0" and all(r["error"] is None for r in got.values())


def test_matlab_errors_are_rows(spark, tmp_path):
    whole = matlab_file(*recorded(), deflate=True)
    (tmp_path / "a.mat").write_bytes(whole)
    (tmp_path / "b.mat").write_bytes(whole[:-20])
    (tmp_path / "c.mat").write_bytes(b"something else")
    (tmp_path / "d.mat").write_bytes(matlab_file(numeric("big", np.zeros((50, 3)))))
    (tmp_path / "e.mat").write_bytes(b"")
    rows = rec.load(spark, rec.Matlab, str(tmp_path), most=100).collect()
    bad = {r["path"][-5:]: r["error"] for r in rows if r["error"]}
    assert set(bad) == {"b.mat", "c.mat", "d.mat", "e.mat"} and "150 numbers" in bad["d.mat"] and "wanted" in bad["b.mat"]
    assert sum(r["path"].endswith("a.mat") for r in rows) == 9 and sum(r["path"].endswith("b.mat") and r["error"] is None for r in rows) == 8
    assert rec.load(spark, rec.Matlab, f"{tmp_path}/none/*.mat").count() == 0


# ---- GDF 2


def gdf_file(x, per=4, rate=2.0, events=(), mode=3, kinds=(3, 16), records=None):
    """x: [channel, sample] digital numbers; two channels, calibrated to (-1, 1) from (-100, 100) and as they are."""
    ns, n = len(x), x.shape[1] // per
    fixed = bytearray(256)
    fixed[:8] = b"GDF 2.10"
    struct.pack_into("<H", fixed, 184, 1 + ns)
    struct.pack_into("<q", fixed, 236, n if records is None else records)
    struct.pack_into("<II", fixed, 244, int(per), int(rate))
    struct.pack_into("<H", fixed, 252, ns)
    own = bytearray(256 * ns)
    for k in range(ns):
        own[16 * k : 16 * k + 16] = f"C{k}".encode().ljust(16, b"\0")
        for at, v in ((104, -1.0), (112, 1.0), (120, -100.0), (128, 100.0)) if k == 0 else ((104, 0.0), (112, 1.0), (120, 0.0), (128, 1.0)):
            struct.pack_into("<d", own, at * ns + 8 * k, v)
        struct.pack_into("<I", own, 216 * ns + 4 * k, per)
        struct.pack_into("<I", own, 220 * ns + 4 * k, kinds[k])
    body = b"".join(x[k, per * r : per * (r + 1)].astype("<" + rec.SAMPLES[kinds[k]]).tobytes() for r in range(n) for k in range(ns))
    table = bytes([mode]) + len(events).to_bytes(3, "little") + struct.pack("<f", rate)
    table += b"".join(struct.pack("<I", e[0] + 1) for e in events) + b"".join(struct.pack("<H", e[1]) for e in events)
    if mode == 3:
        table += b"".join(struct.pack("<H", e[2]) for e in events) + b"".join(struct.pack("<I", e[3]) for e in events)
    return bytes(fixed) + bytes(own) + body + table


@pytest.mark.parametrize("split", [32 << 20, 30, 1])
def test_gdf(spark, tmp_path, split):
    x = np.array([np.arange(-20, 20), np.arange(40) / 2])
    events = [(3, 769, 0, 5), (17, 770, 1, 6)]
    (tmp_path / "r.gdf").write_bytes(gdf_file(x, events=events))
    d = rec.load(spark, rec.GdfSamples, f"{tmp_path}/*.gdf", split=split)
    assert d.rdd.getNumPartitions() == {32 << 20: 1, 30: 10, 1: 10}[split]
    rows = sorted(d.collect(), key=lambda r: (r["channel"], r["record"]))
    assert [r["label"] for r in rows] == ["C0"] * 10 + ["C1"] * 10 and {r["rate"] for r in rows} == {2.0}
    got = np.array([v for r in rows for v in r["values"]]).reshape(2, 40)
    assert np.allclose(got[0], x[0] / 100) and np.allclose(got[1], x[1])
    assert [tuple(r)[1:] for r in rec.load(spark, rec.GdfEvents, f"{tmp_path}/*.gdf").collect()] == [(k, *e, 2.0, None) for k, e in enumerate(events)]
    (tmp_path / "r.gdf").write_bytes(gdf_file(x, events=events, mode=1))
    assert [tuple(r)[1:6] for r in rec.load(spark, rec.GdfEvents, f"{tmp_path}/*.gdf").collect()] == [(0, 3, 769, 0, 0), (1, 17, 770, 0, 0)]


def test_gdf_errors_are_rows(spark, tmp_path):
    x = np.array([np.arange(40), np.arange(40)])
    (tmp_path / "cut.gdf").write_bytes(gdf_file(x)[: 256 * 3 + 24 * 6 + 5])
    (tmp_path / "old.gdf").write_bytes(gdf_file(x).replace(b"GDF 2.10", b"GDF 1.25"))
    (tmp_path / "odd.gdf").write_bytes(gdf_file(x).replace(struct.pack("<II", 3, 16), struct.pack("<II", 3, 99)))
    (tmp_path / "open.gdf").write_bytes(gdf_file(x, records=-1)[:-8])
    rows = rec.load(spark, rec.GdfSamples, str(tmp_path)).collect()
    bad = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows if r["error"]}
    assert set(bad) == {"cut.gdf", "old.gdf", "odd.gdf"} and "6 of 10 records" in bad["cut.gdf"] and "99" in bad["odd.gdf"]
    count = lambda name: sum(r["path"].endswith("/" + name) and r["error"] is None for r in rows)
    assert count("cut.gdf") == 12 and count("open.gdf") == 20
    assert {r["error"] is None for r in rec.load(spark, rec.GdfEvents, str(tmp_path)).where(F.col("path").endswith("cut.gdf")).collect()} <= {True, False}


# ---- CNT


def cnt_file(x, rate=500, block=1, width=2, events=(), kind=1, cut=None):
    """x: [channel, sample] raw numbers; baseline 3 and gain 2 x 1.024 / 204.8 for the first channel, 0 and 1 x 204.8 / 204.8 for others."""
    n, samples = x.shape
    begin = 900 + 75 * n
    end = begin + n * samples * width
    fixed = bytearray(900)
    fixed[:12] = b"Version 3.0\0"
    struct.pack_into("<H", fixed, 370, n)
    struct.pack_into("<H", fixed, 376, rate)
    struct.pack_into("<I", fixed, 886, end)
    struct.pack_into("<i", fixed, 894, block * width if block > 1 else 0)
    own = bytearray(75 * n)
    for k in range(n):
        own[75 * k : 75 * k + 10] = f"E{k}".encode().ljust(10, b"\0")
        struct.pack_into("<h", own, 75 * k + 47, 3 if k == 0 else 0)
        struct.pack_into("<f", own, 75 * k + 59, 2.0 if k == 0 else 1.0)
        struct.pack_into("<f", own, 75 * k + 71, 1.024 if k == 0 else 204.8)
    body = x.reshape(n, samples // block, block).transpose(1, 0, 2).astype(f"<i{width}").tobytes()
    rows = b"".join(struct.pack("<HBBi", code, 0, 0, at if kind == 3 else begin + at * n * width).ljust({1: 8, 2: 19, 3: 19}[kind], b"\0") for at, code in events)
    table = struct.pack("<Bii", kind, len(rows), 0)[:9] + rows
    return (bytes(fixed) + bytes(own) + body + table)[:cut]


@pytest.mark.parametrize(("block", "width", "kind", "split"), [(1, 2, 1, 32 << 20), (4, 2, 2, 32 << 20), (4, 4, 3, 40), (1, 4, 1, 1)])
def test_cnt(spark, tmp_path, block, width, kind, split):
    x = np.random.default_rng(1).integers(-1000, 1000, (3, 40))
    events = [(5, 1), (31, 2)]
    (tmp_path / "r.cnt").write_bytes(cnt_file(x, block=block, width=width, events=events, kind=kind))
    rows = rec.load(spark, rec.CntSamples, f"{tmp_path}/*.cnt", split=split, bytes=width).collect()
    got = np.concatenate([np.array([v for r in sorted(rows, key=lambda r: r["start"]) if r["channel"] == c for v in r["values"]]) for c in range(3)]).reshape(3, 40)
    assert np.allclose(got[0], (x[0] - 3) * 2 * 1.024 / 204.8) and np.allclose(got[1:], x[1:], atol=1e-4)
    assert {r["label"] for r in rows} == {"E0", "E1", "E2"} and {r["rate"] for r in rows} == {500.0}
    assert [tuple(r)[1:] for r in rec.load(spark, rec.CntEvents, f"{tmp_path}/*.cnt", bytes=width).collect()] == [(k, *e, None) for k, e in enumerate(events)]


def test_cnt_errors_are_rows(spark, tmp_path):
    x = np.arange(120).reshape(3, 40)
    (tmp_path / "cut.cnt").write_bytes(cnt_file(x, block=4, cut=900 + 225 + 24 * 7 + 3))
    (tmp_path / "none.cnt").write_bytes(b"Version 2")
    (tmp_path / "head.cnt").write_bytes(cnt_file(x, cut=950))
    rows = rec.load(spark, rec.CntSamples, str(tmp_path)).collect()
    bad = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows if r["error"]}
    assert set(bad) == {"cut.cnt", "none.cnt", "head.cnt"} and "7 of 10 blocks" in bad["cut.cnt"]
    assert sum(len(r["values"]) for r in rows if r["error"] is None) == 3 * 28
    assert all(r["error"] for r in rec.load(spark, rec.CntEvents, f"{tmp_path}/none.cnt").collect())
