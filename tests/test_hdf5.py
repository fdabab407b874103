"""The HDF5 reader on files that this module writes by the published format (no HDF5 library is at hand)."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pelagia import nd
from pelagia.sources import formats, hdf5

NOWHERE = 2**64 - 1


def kind(dtype):
    """Datatype message."""
    d = np.dtype(dtype)
    if d.names:
        body = b""
        for n in d.names:
            body += n.encode() + b"\0" + bytes([d.fields[n][1]]) + kind(d.fields[n][0])
        return struct.pack("<B3sI", 0x36, len(d.names).to_bytes(3, "little"), d.itemsize) + body
    if d.kind == "S":
        return struct.pack("<B3sI", 0x13, b"\0\0\0", d.itemsize)
    big = d.byteorder == ">"
    if d.kind == "f":
        sign, exp, size = {4: (31, (23, 8, 0, 23, 127), 32), 8: (63, (52, 11, 0, 52, 1023), 64)}[d.itemsize]
        return struct.pack("<BBBBI", 0x11, 0x20 | big, sign, 0, d.itemsize) + struct.pack("<HHBBBBI", 0, size, *exp)
    return struct.pack("<BBBBI", 0x10, (8 if d.kind == "i" else 0) | big, 0, 0, d.itemsize) + struct.pack("<HH", 0, 8 * d.itemsize)


VSTRING = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + kind("S1")
REFS = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)


def space(shape, version=1):
    dims = struct.pack(f"<{len(shape)}Q", *shape)
    return struct.pack("<BBB5x", 1, len(shape), 0) + dims if version == 1 else struct.pack("<BBBB", 2, len(shape), 0, bool(shape)) + dims


def pad(b):
    return b + bytes(-len(b) % 8)


class Maker:
    def __init__(self, new):
        self.new, self.buf = new, bytearray(2048)

    def add(self, b):
        at = len(self.buf)
        self.buf += pad(b)
        return at

    def header(self, messages):
        """An object header; its last messages stand in a continuation block."""
        first, rest = messages[:2], messages[2:]
        if self.new:
            more = b"OCHK" + b"".join(struct.pack("<BHB", t, len(b), 0) + b for t, b in rest) + bytes(4)
            at = self.add(more)
            first = [*first, (0x10, struct.pack("<QQ", at, len(more)))]
            body = b"".join(struct.pack("<BHB", t, len(b), 0) + b for t, b in first)
            return self.add(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4))
        pack = lambda ms: b"".join(struct.pack("<HHB3x", t, len(pad(b)), 0) + pad(b) for t, b in ms)
        more = pack(rest)
        first = [*first, (0x10, struct.pack("<QQ", self.add(more), len(more)))]
        body = pack(first)
        return self.add(struct.pack("<BxHIII", 1, len(messages) + 1, 1, len(body), 0) + body)

    def attribute(self, name, value, type_=None, shape=None):
        if isinstance(value, str):
            value = np.array(value.encode())
        if type_ is None:
            value = np.asarray(value)
            type_, shape, value = kind(value.dtype), value.shape, value.tobytes()
        n = name.encode() + b"\0"
        s = space(shape, 2 if self.new else 1)
        if self.new:
            return 0x0C, struct.pack("<BBHHHB", 3, 0, len(n), len(type_), len(s), 1) + n + type_ + s + value
        return 0x0C, struct.pack("<BxHHH", 1, len(n), len(type_), len(s)) + pad(n) + pad(type_) + pad(s) + value

    def vlen(self, items):
        """A global heap; elements that point to it."""
        body = b"".join(struct.pack("<HHIQ", i + 1, 1, 0, len(b)) + pad(b) for i, b in enumerate(items)) + bytes(16)
        at = self.add(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(body)) + body)
        return at

    def dataset(self, x, chunk=None, attrs=(), fill=None, skip=(), type_=None, raw=None, shape=None):
        shape = x.shape if shape is None else shape
        type_ = kind(x.dtype) if type_ is None else type_
        messages = [(1, space(shape, 2 if self.new else 1)), (3, type_)]
        if fill is not None:
            b = np.array(fill, x.dtype).tobytes()
            messages.append((5, struct.pack("<BBI", 3, 0x2A, len(b)) + b if self.new else struct.pack("<BBBBI", 2, 2, 0, 1, len(b)) + b))
        if chunk is None:
            raw = x.tobytes() if raw is None else raw
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.add(raw), len(raw))))
        else:
            size, keys = x.dtype.itemsize, []
            for at in np.ndindex(*[-(-s // c) for s, c in zip(shape, chunk)]):
                if at in skip:
                    continue
                block = np.zeros(chunk, x.dtype)
                part = x[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk))]
                block[tuple(slice(0, n) for n in part.shape)] = part
                b = np.frombuffer(block.tobytes(), np.uint8).reshape(-1, size).T.tobytes()
                b = zlib.compress(b)
                keys.append((struct.pack("<II", len(b), 0) + struct.pack(f"<{len(shape) + 1}Q", *[i * c for i, c in zip(at, chunk)], 0), self.add(b)))
            end = struct.pack("<II", 0, 0) + struct.pack(f"<{len(shape) + 1}Q", *shape, size)
            leaves = []
            for half in (keys[: len(keys) // 2], keys[len(keys) // 2 :]):
                leaves.append((half[0][0], self.add(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(half), NOWHERE, NOWHERE) + b"".join(k + struct.pack("<Q", a) for k, a in half) + end)))
            tree = self.add(b"TREE" + struct.pack("<BBHQQ", 1, 1, 2, NOWHERE, NOWHERE) + b"".join(k + struct.pack("<Q", a) for k, a in leaves) + end)
            messages.append((8, struct.pack("<BBBQ", 3, 2, len(shape) + 1, tree) + struct.pack(f"<{len(shape) + 1}I", *chunk, size)))
            if self.new:
                messages.append((0x0B, struct.pack("<BB", 2, 2) + struct.pack("<HHHI", 2, 0, 1, size) + struct.pack("<HHHI", 1, 0, 1, 6)))
            else:
                messages.append((0x0B, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHH8sII", 2, 8, 0, 1, b"shuffle\0", size, 0) + struct.pack("<HHHH8sII", 1, 8, 0, 1, b"deflate\0", 6, 0)))
        return self.header(messages + list(attrs))

    def link(self, name, address):
        n = name.encode()
        return struct.pack("<BBB", 1, 0, len(n)) + n + struct.pack("<Q", address)

    def heap(self, objects):
        """A fractal heap with one direct block, and the ids of the objects."""
        head = self.add(bytes(146))
        block, ids = bytearray(b"FHDB" + struct.pack("<BQI", 0, head, 0)), []
        for b in objects:
            ids.append(b"\0" + len(block).to_bytes(4, "little") + len(b).to_bytes(2, "little"))
            block += b
        root = self.add(bytes(block).ljust(4096, b"\0"))
        self.buf[head : head + 146] = b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 0, 4096) + bytes(96) + struct.pack("<HQQHHQH", 4, 4096, 65536, 32, 1, root, 0) + bytes(4)
        return head, ids

    def tree(self, type_, records):
        leaf = self.add(b"BTLF" + bytes([0, type_]) + b"".join(records))
        return self.add(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, type_, 512, len(records[0]), 0, 100, 40, leaf, len(records), len(records)) + bytes(4))

    def group(self, members, attrs=(), dense=False):
        if self.new:
            if dense:
                heap, ids = self.heap([self.link(*m) for m in members])
                index = self.tree(5, [struct.pack("<I", i) + x for i, x in enumerate(ids)])
                heap2, ids2 = self.heap([b for _, b in attrs])
                index2 = self.tree(8, [x + b"\0" + struct.pack("<BII", 0, i, 0) for i, x in enumerate(ids2)])
                return self.header([(2, struct.pack("<BBQQ", 0, 0, heap, index)), (0x15, struct.pack("<BBQQ", 0, 0, heap2, index2)), (0x0A, b"\0\0")])
            return self.header([(6, self.link(*m)) for m in members] + list(attrs))
        names, offsets = bytearray(8), []
        for n, _ in members:
            offsets.append(len(names))
            names += pad(n.encode() + b"\0")
        heap = self.add(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, self.add(bytes(names))))
        snod = self.add(b"SNOD" + struct.pack("<BBH", 1, 0, len(members)) + b"".join(struct.pack("<QQII16x", o, a, 0, 0) for o, (_, a) in zip(offsets, members)))
        tree = self.add(b"TREE" + struct.pack("<BBHQQQQQ", 0, 0, 1, NOWHERE, NOWHERE, 0, snod, offsets[-1]))
        return self.header([(0x11, struct.pack("<QQ", tree, heap)), (0, b""), *attrs])

    def file(self, root):
        if self.new:
            head = hdf5.MAGIC + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, NOWHERE, len(self.buf), root, 0)
        else:
            head = hdf5.MAGIC + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.buf), NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.buf[: len(head)] = head
        return bytes(self.buf)


def sample(new, dense=False):
    m = Maker(new)
    scale = [m.attribute("CLASS", "DIMENSION_SCALE"), m.attribute("NAME", "lat")]
    lat = m.dataset(np.array([10.0, 20.0, 30.0]), attrs=[*scale, m.attribute("units", "degrees_north")])
    none = m.attribute("NAME", "This is a netCDF dimension but not a netCDF variable         2")
    x = m.dataset(np.zeros(4, ">f4"), attrs=[scale[0], none])
    refs = m.vlen([struct.pack("<Q", lat), struct.pack("<Q", x)])
    listed = m.attribute("DIMENSION_LIST", b"".join(struct.pack("<IQI", 1, refs, i) for i in (1, 2)), REFS, (2,))
    v = np.arange(12, dtype="<i2").reshape(3, 4)
    sst = m.dataset(v, (2, 3), [listed, m.attribute("scale_factor", 0.5), m.attribute("_FillValue", np.array([5], "<i2"))], fill=7, skip={(1, 1)})
    texts = m.vlen([b"one", "zwéi".encode()])
    name = m.dataset(None, type_=VSTRING, shape=(3,), raw=struct.pack("<IQI", 3, texts, 1) + struct.pack("<IQI", 5, texts, 2) + bytes(16), attrs=[m.attribute("DIMENSION_LIST", struct.pack("<IQI", 1, refs, 1), REFS, (1,))])
    members = [("lat", lat), ("x", x), ("sst", sst), ("name", name)]
    if new:
        pairs = np.array([(1, 2.5, b"ab"), (3, 4.5, b"c")], np.dtype([("a", "<i4"), ("b", "<f8"), ("s", "S2")]))
        sub = m.group([("pair", m.dataset(pairs)), ("flag", m.dataset(np.array(b"y")))])
        members.append(("sub", sub))
    return m.file(m.group(members, [m.attribute("title", "hello")], dense))


@pytest.mark.parametrize(("new", "dense"), [(False, False), (True, False), (True, True)])
def test_hdf5_as_rows(new, dense):
    ds = formats.netcdf(sample(new, dense))
    assert ds.dims["lat"] == 3 and ds.dims["x"] == 4 and "x" not in ds.variables and ds.attrs["title"] == "hello"
    got = pa.Table.from_batches(list(nd.flatten(ds, ["lat", "sst", "lat.units", ".title", "name"]))).to_pylist()
    want = np.arange(12).reshape(3, 4).astype(float)
    want[2:, 3:] = 7
    want = np.where(want == 5, np.nan, want * 0.5).ravel()
    assert [r["sst"] for r in got] == [None if np.isnan(v) else v for v in want]
    assert [r["lat"] for r in got] == [10.0] * 4 + [20.0] * 4 + [30.0] * 4
    assert [r["name"] for r in got[::4]] == ["one", "zwéi", ""] and got[0]["lat.units"] == "degrees_north" and got[0][".title"] == "hello"
    if new:
        rows = pa.Table.from_batches(list(nd.flatten(ds, ["sub/pair/a", "sub/pair/b", "sub/pair/s"]))).to_pylist()
        assert [tuple(r.values()) for r in rows] == [(1, 2.5, "ab"), (3, 4.5, "c")]
        assert ds.variables["sub/pair/a"].dims[0].startswith("phony_dim_")


def test_hdf5_damage_is_named():
    good = sample(True)
    for bad in (b"no", good[:3000], good.replace(b"GCOL", b"XXXX"), good.replace(b"TREE", b"EERT")):
        with pytest.raises(hdf5.Hdf5Error):
            list(nd.flatten(hdf5.parse(bad)))
    assert len(list(nd.flatten(hdf5.parse(good.replace(b"TREE", b"EERT")), ["lat"]))) == 1  # what is not asked for is not read


def test_hdf5_characters_make_texts():
    m = Maker(True)
    x = np.array([list("ab"), list("c\0")], "S1")
    ds = hdf5.parse(m.file(m.group([("t", m.dataset(x))])))
    assert [r["t"] for r in pa.Table.from_batches(list(nd.flatten(ds))).to_pylist()] == ["ab", "c"]


def test_heap_objects_in_indirect_blocks():
    m = Maker(True)
    head = m.add(bytes(146))
    blocks = []
    for k in range(9):  # width 4: rows of 512, 512, 1024 bytes
        size = 512 if k < 8 else 1024
        blocks.append(m.add((b"FHDB" + struct.pack("<BQI", 0, head, 0) + bytes([k]) * 8).ljust(size, b"\0")))
    root = m.add(b"FHIB" + struct.pack("<BQI", 0, head, 0) + struct.pack("<12Q", *blocks, *[NOWHERE] * 3))
    m.buf[head : head + 146] = b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 0, 512) + bytes(96) + struct.pack("<HQQHHQH", 4, 512, 1024, 32, 1, root, 3) + bytes(4)
    f = hdf5.File(m.file(head))
    for k in range(9):
        ident = b"\0" + (512 * k + 17).to_bytes(4, "little") + (8).to_bytes(2, "little")
        assert f.heap_object(head, ident) == bytes([k]) * 8


def test_hdf5_through_sql(spark, tmp_path):
    from pelagia.session import Connection

    (tmp_path / "a.h5").write_bytes(sample(True))
    (tmp_path / "b.nc").write_bytes(sample(False))
    con = Connection(spark, str(tmp_path / "catalog"), datasets=str(tmp_path))
    assert con.sql("SELECT count(*) AS n, sum(sst) AS s FROM read_hdf5('a.h5')").fetchall() == con.sql("SELECT count(*) AS n, sum(sst) AS s FROM read_netcdf('b.nc')").fetchall()
    assert con.sql("SELECT lat FROM read_hdf5('a.h5', ['lat'])").df.count() == 3
