"""NetCDF classic files (CDF-1, CDF-2, CDF-5): parser and writer."""

from __future__ import annotations

import struct

import numpy as np

from pelagia.nd import Dataset, Variable

_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file" + (" (it is HDF5)" if data[:4] == b"\x89HDF" else ""))
        self.big = data[3] == 5
        self.offset = ">i" if data[3] == 1 else ">q"

    def number(self, fmt: str | None = None) -> int:
        fmt = fmt or (">q" if self.big else ">i")
        (x,) = struct.unpack_from(fmt, self.data, self.at)
        self.at += struct.calcsize(fmt)
        return x

    def raw(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return out

    def name(self) -> str:
        return self.raw(self.number()).decode()

    def attributes(self) -> dict:
        tag, n = self.number(">i"), self.number()
        out = {}
        for _ in range(n if tag else 0):
            name, kind, size = self.name(), self.number(">i"), self.number()
            dtype = np.dtype(_TYPES[kind])
            raw = self.raw(size * dtype.itemsize)
            if kind == 2:
                out[name] = raw.decode("utf-8", "replace").rstrip("\0")
            else:
                x = np.frombuffer(raw, dtype).astype(dtype.newbyteorder("="))
                out[name] = x[0] if len(x) == 1 else x
        return out


def parse(data: bytes) -> Dataset:
    r = _Reader(data)
    records = r.number()
    tag, n = r.number(">i"), r.number()
    dims: list[tuple[str, int]] = []
    for _ in range(n if tag else 0):
        dims.append((r.name(), r.number()))
    unlimited = next((i for i, d in enumerate(dims) if d[1] == 0), None)
    attrs = r.attributes()
    tag, n = r.number(">i"), r.number()
    headers = []
    for _ in range(n if tag else 0):
        name = r.name()
        ids = [r.number() for _ in range(r.number())]
        a = r.attributes()
        kind, _size, begin = r.number(">i"), r.number(), r.number(r.offset)
        headers.append((name, ids, a, np.dtype(_TYPES[kind]), begin))
    per = {}
    for name, ids, _, dtype, _ in headers:
        if ids and ids[0] == unlimited:
            per[name] = int(np.prod([dims[i][1] for i in ids[1:]], dtype=np.int64)) * dtype.itemsize
    step = sum(-(-x // 4) * 4 for x in per.values()) if len(per) > 1 else sum(per.values())
    if records < 0:
        begin = min((h[4] for h in headers if h[0] in per), default=0)
        records = (len(data) - begin) // step if step else 0
    sizes = {d: (records if i == unlimited else s) for i, (d, s) in enumerate(dims)}
    variables = {}
    for name, ids, a, dtype, begin in headers:
        shape = tuple(sizes[dims[i][0]] for i in ids)
        if name in per:
            cell = per[name] // dtype.itemsize
            rows = np.ndarray((records, cell), dtype, data, begin, (step, dtype.itemsize)) if records else np.zeros((0, cell), dtype)
            x = np.ascontiguousarray(rows).reshape(shape)
        else:
            x = np.frombuffer(data, dtype, int(np.prod(shape, dtype=np.int64)), begin).reshape(shape)
        names = tuple(dims[i][0] for i in ids)
        if dtype.kind == "S":
            if x.ndim:
                x = np.ascontiguousarray(x).view(f"S{max(1, x.shape[-1])}").reshape(x.shape[:-1])
                names = names[:-1]
        else:
            x = x.astype(dtype.newbyteorder("="))
        variables[name] = Variable(names, x, a)
    used = {d for v in variables.values() for d in v.dims}
    return Dataset({d: s for d, s in sizes.items() if d in used}, variables, attrs)


def _attrs(attrs: dict) -> bytes:
    if not attrs:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", 12, len(attrs))
    for k, v in attrs.items():
        out += _name(k)
        if isinstance(v, str):
            raw = v.encode()
            out += struct.pack(">ii", 2, len(raw)) + raw + b"\0" * (-len(raw) % 4)
        else:
            x = np.atleast_1d(np.asarray(v))
            x = x.astype(np.int32) if x.dtype == np.int64 else x
            kind = next(k for k, t in _TYPES.items() if np.dtype(t) == x.dtype.newbyteorder(">"))
            raw = x.astype(x.dtype.newbyteorder(">")).tobytes()
            out += struct.pack(">ii", kind, len(x)) + raw + b"\0" * (-len(raw) % 4)
    return out


def _name(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def write(ds: Dataset) -> bytes:
    """A CDF-2 file; 64-bit integers become doubles (the format has none), strings character arrays."""
    dims = dict(ds.dims)
    parts = []
    for name, v in ds.variables.items():
        x, names = v.values, list(v.dims)
        if x.dtype.kind in "US":
            raw = np.char.encode(x.astype(str), "utf-8") if x.dtype.kind == "U" else x
            width = max(1, raw.dtype.itemsize)
            dim = f"string{width}"
            dims[dim] = width
            names.append(dim)
            x = np.ascontiguousarray(raw).view("S1").reshape(*x.shape, width)
        elif x.dtype == np.int64 or x.dtype == np.uint64 or x.dtype == np.uint32:
            x = x.astype(np.float64)
        elif x.dtype == bool or x.dtype == np.uint8:
            x = x.astype(np.int8 if x.dtype == bool else np.int16)
        elif x.dtype == np.uint16:
            x = x.astype(np.int32)
        parts.append((name, names, v.attrs, x))
    ids = {d: i for i, d in enumerate(dims)}
    head = b"CDF\x02" + struct.pack(">i", 0)
    head += (struct.pack(">ii", 10, len(dims)) if dims else struct.pack(">ii", 0, 0)) + b"".join(_name(d) + struct.pack(">i", n) for d, n in dims.items())
    head += _attrs(ds.attrs)

    def table(begins: list[int]) -> bytes:
        out = struct.pack(">ii", 11, len(parts)) if parts else struct.pack(">ii", 0, 0)
        for (name, names, attrs, x), begin in zip(parts, begins):
            kind = 2 if x.dtype.kind == "S" else next(k for k, t in _TYPES.items() if np.dtype(t) == x.dtype.newbyteorder(">"))
            size = min(-(-x.nbytes // 4) * 4, 2**31 - 4)
            out += _name(name) + struct.pack(f">i{len(names)}i", len(names), *(ids[d] for d in names)) + _attrs(attrs) + struct.pack(">iiq", kind, size, begin)
        return out

    at = len(head) + len(table([0] * len(parts)))
    begins = []
    for *_, x in parts:
        begins.append(at)
        at += -(-x.nbytes // 4) * 4
    body = b"".join(
        (raw := (x.tobytes() if x.dtype.kind == "S" else x.astype(x.dtype.newbyteorder(">")).tobytes())) + b"\0" * (-len(raw) % 4) for *_, x in parts
    )
    return head + table(begins) + body
