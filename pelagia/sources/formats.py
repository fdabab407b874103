"""Parsers of whole files into datasets or Arrow tables: Zarr v3, TIFF, ODV spreadsheets, Arrow IPC, Avro."""

from __future__ import annotations

import io
import itertools
import json
import re
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pelagia.nd import Dataset, Variable
from pelagia.sources import hdf5, netcdf3


def netcdf(data: bytes) -> Dataset:
    """NetCDF classic, or NetCDF-4, which is HDF5."""
    return hdf5.parse(data) if data[:8] == hdf5.MAGIC else netcdf3.parse(data)


# ------------------------------------------------------------------ Zarr v3
def _codec(raw: bytes, codecs: list[dict], dtype: np.dtype, shape: tuple[int, ...]) -> np.ndarray:
    order, little = None, True
    for c in reversed(codecs):
        name, conf = c["name"], c.get("configuration") or {}
        if name == "gzip":
            raw = zlib.decompress(raw, 47)
        elif name == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        elif name == "crc32c":
            raw = raw[:-4]
        elif name == "bytes":
            little = conf.get("endian", "little") == "little"
        elif name == "transpose":
            order = conf["order"]
        else:
            raise ValueError(f"Zarr codec {name} is not supported")
    dtype = dtype.newbyteorder("<" if little else ">")
    if order:
        x = np.frombuffer(raw, dtype).reshape([shape[i] for i in order]).transpose(np.argsort(order))
    else:
        x = np.frombuffer(raw, dtype).reshape(shape)
    return x.astype(dtype.newbyteorder("="))


@dataclass(frozen=True)
class ZarrArray:
    """An array of a group, by its metadata; keys of chunks are paths relative to the group."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    dtype: np.dtype
    fill: object
    codecs: list[dict]
    attrs: dict
    prefix: str
    separator: str

    def key(self, at: Sequence[int]) -> str:
        return self.prefix + self.separator.join(map(str, at))

    def place(self, key: str) -> tuple[int, ...] | None:
        """The chunk that a path names; None if it is none of this array's."""
        at = key.removeprefix(self.prefix).split(self.separator) if self.shape else []
        if not key.startswith(self.prefix) or len(at) != len(self.shape) or not all(x.isdecimal() for x in at):
            return None
        return tuple(map(int, at)) if self.shape else () if key == self.prefix else None

    def empty(self, shape: Sequence[int]) -> np.ndarray:
        return np.full(tuple(shape), self.fill, self.dtype)

    def decode(self, raw: bytes) -> np.ndarray:
        return _codec(raw, self.codecs, self.dtype, self.chunk)


def zarr_group(files: dict[str, bytes]) -> tuple[dict, dict[str, ZarrArray]]:
    """Attributes and arrays of a group, from its zarr.json files (paths relative to the group)."""
    root = json.loads(files["zarr.json"])
    arrays: dict[str, ZarrArray] = {}
    for path in sorted(p for p in files if p.endswith("/zarr.json")):
        meta = json.loads(files[path])
        if meta.get("node_type") != "array":
            continue
        name = path[: -len("/zarr.json")]
        shape = tuple(meta["shape"])
        kind = meta["data_type"]
        if not isinstance(kind, str) or kind == "string":
            raise ValueError(f"Zarr data type {kind} is not supported")
        fill = meta.get("fill_value")
        fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(fill, fill) if isinstance(fill, str) else fill
        enc = meta.get("chunk_key_encoding") or {"name": "default"}
        plain = enc["name"] == "default"
        sep = (enc.get("configuration") or {}).get("separator", "/" if plain else ".")
        arrays[name] = ZarrArray(
            name,
            tuple(n or f"{name}_dim{i}" for i, n in enumerate(meta.get("dimension_names") or [None] * len(shape))),
            shape,
            tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]),
            np.dtype(kind),
            0 if fill is None else fill,
            meta["codecs"],
            dict(meta.get("attributes") or {}),
            f"{name}/" + (("c" + sep if shape else "c") if plain else ("" if shape else "0")),
            sep,
        )
    return dict(root.get("attributes") or {}), arrays


def zarr(files: dict[str, bytes]) -> Dataset:
    """A whole group from its files. Unwritten chunks read as the array's fill_value, which is a value; only the
    _FillValue attribute means null."""
    attrs, arrays = zarr_group(files)
    dims: dict[str, int] = {}
    variables: dict[str, Variable] = {}
    for name, a in arrays.items():
        x = a.empty(a.shape)
        for at in itertools.product(*[range(-(-s // c)) for s, c in zip(a.shape, a.chunk)]):
            raw = files.get(a.key(at))
            if raw is not None:
                where = tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(at, a.chunk, a.shape))
                x[where] = a.decode(raw)[tuple(slice(0, w.stop - w.start) for w in where)]
        variables[name] = Variable(a.dims, x, a.attrs)
        dims |= dict(zip(a.dims, a.shape))
    return Dataset(dims, variables, attrs)


# ------------------------------------------------------------------ TIFF
_TIFF = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: None, 6: "i1", 7: "u1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 16: "u8"}


def _lzw(raw: bytes) -> bytes:
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, None
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            code = (held >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None:
                table.append(last + entry[:1])
            last = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return bytes(out)


def _packbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def tiff(data: bytes) -> Dataset:
    """One row per pixel: band.0.., geo.lat and geo.lon (upper left corners of pixels), image.* and geo.epsg constants."""
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None or struct.unpack_from(e + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(e + "I", data, 4)
    (n,) = struct.unpack_from(e + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
        if _TIFF.get(kind) is None:
            continue
        dtype = np.dtype(e + _TIFF[kind]) if _TIFF[kind] != "S1" else np.dtype("S1")
        where = at + 10 + 12 * i
        if dtype.itemsize * count > 4:
            (where,) = struct.unpack_from(e + "I", data, where)
        tags[tag] = np.frombuffer(data, dtype, count, where)
    one = lambda t, d=None: int(tags[t][0]) if t in tags else d
    w, h, bands = one(256), one(257), one(277, 1)
    bits, form = one(258, 1), one(339, 1)
    if bits < 8:
        raise ValueError(f"TIFF with {bits} bits a sample is not supported")
    dtype = np.dtype(e + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    pack, planar, predict = one(259, 1), one(284, 1), one(317, 1)
    unpack = {1: lambda b: b, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(pack)
    if unpack is None:
        raise ValueError(f"TIFF compression {pack} is not supported")
    tiled = 322 in tags
    bw, bh = (one(322), one(323)) if tiled else (w, one(278, h))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-w // bw), -(-h // bh)
    image = np.zeros((bands, h, w), dtype.newbyteorder("="))
    per = 1 if planar == 2 else bands
    for k, (o, c) in enumerate(zip(offsets.tolist(), counts.tolist())):
        band, place = divmod(k, across * down)
        y, x = divmod(place, across)
        rows = bh if tiled else min(bh, h - y * bh)
        block = np.frombuffer(unpack(data[o : o + c]), dtype, rows * bw * per).reshape(rows, bw, per)
        if predict == 2:
            block = np.cumsum(block, axis=1, dtype=dtype)
        ys, xs = min(rows, h - y * bh), min(bw, w - x * bw)
        target = slice(band, band + 1) if planar == 2 else slice(None)
        image[target, y * bh : y * bh + ys, x * bw : x * bw + xs] = np.moveaxis(block[:ys, :xs], 2, 0)
    variables = {f"band.{b}": Variable(("y", "x"), image[b]) for b in range(bands)}
    if 33550 in tags and 33922 in tags:
        sx, sy = tags[33550][:2].tolist()
        i, j, _, gx, gy, _ = tags[33922][:6].tolist()
        variables["geo.lat"] = Variable(("y",), gy - (np.arange(h) - j) * sy)
        variables["geo.lon"] = Variable(("x",), gx + (np.arange(w) - i) * sx)
    variables["image.width"] = Variable((), np.array(w, np.int64))
    variables["image.height"] = Variable((), np.array(h, np.int64))
    if 34735 in tags:
        keys = tags[34735].reshape(-1, 4)
        code = next((int(k[3]) for k in keys if int(k[0]) in (3072, 2048) and k[1] == 0), None)
        if code is not None:
            variables["geo.epsg"] = Variable((), np.array(code, np.int64))
    return Dataset({"y": h, "x": w}, variables)


# ------------------------------------------------------------------ ODV spreadsheets
_DECLARED = re.compile(r"//<(Meta|Data)Variable>(.*?)</\1Variable>", re.S)
_PAIR = re.compile(r'(\w+)="([^"]*)"')
_TIME_LABEL = "yyyy-mm-ddThh:mm:ss.sss"


def odv(data: bytes, fill_down: bool = False) -> pa.Table:
    """Columns in header order without unit suffixes, then `<column>.qf_schema` and `<column>.units`, sorted.

    Station metadata stays null on continuation rows unless fill_down is set."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    text = data.decode("utf-8-sig", "replace")
    declared, units = {}, {}
    for _, body in _DECLARED.findall(text):
        pairs = dict(_PAIR.findall(body))
        if "label" in pairs:
            declared[pairs["label"]] = pairs
    lines = [x for x in text.splitlines() if x and not x.startswith("//")]
    if not lines:
        raise ValueError("ODV: there is no column header")
    header = lines[0].split("\t")
    rows = [x.split("\t") for x in lines[1:]]
    by_short = {k.rsplit(" [", 1)[0]: (k, v) for k, v in declared.items()}
    cols, names = [], []
    for i, label in enumerate(header):
        short = label.rsplit(" [", 1)[0] if label.endswith("]") else label
        full, info = by_short.get(short, (label, {}))
        cells = [(r[i].strip() if i < len(r) else "") or None for r in rows]
        if fill_down and (short in ("Cruise", "Station", "Type", _TIME_LABEL) or info.get("var_type", "").startswith("META")):
            last = None
            cells = [last := c if c is not None else last for c in cells]
        kind = info.get("value_type", "").upper()
        if short == _TIME_LABEL:
            arr = pa.array([None if c is None else np.datetime64(c.rstrip("Z"), "us") for c in cells], pa.timestamp("us"))
        elif kind.startswith(("FLOAT", "DOUBLE")):
            arr = pa.array([None if c is None else float(c) for c in cells], pa.float64() if kind.startswith("DOUBLE") else pa.float32())
        elif kind.startswith(("INTEGER", "SHORT", "BYTE", "SIGNED", "UNSIGNED")):
            arr = pa.array([None if c is None else int(float(c)) for c in cells], pa.int64())
        else:
            arr = pa.array(cells, pa.string())
        names.append(short)
        cols.append(arr)
        if m := re.search(r" \[(.*)\]$", full):
            units[f"{short}.units"] = m[1]
        if info.get("qf_schema"):
            units[f"{short}.qf_schema"] = info["qf_schema"]
    for k in sorted(units):
        names.append(k)
        cols.append(pa.array([units[k]] * len(rows), pa.string()))
    return pa.Table.from_arrays(cols, names)


def arrow_ipc(data: bytes) -> pa.Table:
    """An IPC file or stream."""
    source = pa.py_buffer(data)
    return pa.ipc.open_file(source).read_all() if data[:6] == b"ARROW1" else pa.ipc.open_stream(source).read_all()


# ------------------------------------------------------------------ Avro object container files
class _Avro:
    def __init__(self, data: bytes):
        self.f = io.BytesIO(data)

    def long(self) -> int:
        shift = out = 0
        while True:
            (b,) = self.f.read(1)
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 128:
                return (out >> 1) ^ -(out & 1)

    def raw(self) -> bytes:
        return self.f.read(self.long())

    def value(self, s, names: dict):
        if isinstance(s, list):
            return self.value(s[self.long()], names)
        if isinstance(s, str) and s in names:
            s = names[s]
        t = s["type"] if isinstance(s, dict) else s
        if isinstance(t, dict | list):
            return self.value(t, names)
        if isinstance(s, dict) and "name" in s:
            names[s["name"]] = s
        if t == "null":
            return None
        if t == "boolean":
            return self.f.read(1) == b"\1"
        if t in ("int", "long"):
            return self.long()
        if t == "float":
            return struct.unpack("<f", self.f.read(4))[0]
        if t == "double":
            return struct.unpack("<d", self.f.read(8))[0]
        if t == "bytes":
            return self.raw()
        if t == "string":
            return self.raw().decode()
        if t == "fixed":
            return self.f.read(s["size"])
        if t == "enum":
            return s["symbols"][self.long()]
        if t in ("array", "map"):
            out: list = []
            while n := self.long():
                if n < 0:
                    n = -n
                    self.long()
                for _ in range(n):
                    out.append(self.value(s["items"], names) if t == "array" else (self.raw().decode(), self.value(s["values"], names)))
            return out if t == "array" else dict(out)
        if t == "record":
            return {f["name"]: self.value(f["type"], names) for f in s["fields"]}
        raise ValueError(f"Avro type {t}")


def avro(data: bytes) -> list[dict]:
    """All records of an Avro file."""
    a = _Avro(data)
    if a.f.read(4) != b"Obj\1":
        raise ValueError("not an Avro file")
    meta = a.value({"type": "map", "values": "bytes"}, {})
    sync = a.f.read(16)
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null")
    out = []
    while a.f.tell() < len(data):
        n, raw = a.long(), a.raw()
        if codec == b"deflate":
            raw = zlib.decompress(raw, -15)
        elif codec == b"zstandard":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        elif codec != b"null":
            raise ValueError(f"Avro codec {codec!r}")
        block = _Avro(raw)
        out += [block.value(schema, {}) for _ in range(n)]
        if a.f.read(16) != sync:
            raise ValueError("Avro: a block is damaged")
    return out
