"""HDF5 files, NetCDF-4 among them, as datasets: a reader of the published file format in plain Python and numpy.

Read are superblocks 0 to 3; object headers 1 and 2; groups as symbol tables, link messages or dense links; compact,
contiguous and chunked storage (version 1 B-trees; single and implicit chunk indexes); the filters deflate, shuffle,
fletcher32 and zstd; numbers, enumerations, fixed and variable strings, compounds (a variable for each member),
attributes, compact or dense. Anything else raises and names itself. Dimensions come from dimension scales; axes
without one are called phony_dim_N, one for each length. Variables of nested groups are called `group/name`.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from pelagia.nd import Dataset, LazyVariable

MAGIC = b"\x89HDF\r\n\x1a\n"
NOWHERE = 2**64 - 1
#: Attributes that carry the format's own bookkeeping.
_HIDDEN = {"CLASS", "NAME", "REFERENCE_LIST", "DIMENSION_LIST", "DIMENSION_LABELS", "_Netcdf4Dimid", "_Netcdf4Coordinates", "_NCProperties", "_nc3_strict"}
_NO_VARIABLE = "This is a netCDF dimension but not a netCDF variable"


class Hdf5Error(ValueError):
    pass


def _pad8(n: int) -> int:
    return -(-n // 8) * 8


def _bytes_for(limit: int) -> int:
    return max(limit.bit_length() - 1, 0) // 8 + 1


@dataclass
class Kind:
    """A data type: name is number, string, vstring, vlen, reference, compound, array or opaque."""

    name: str
    size: int
    dtype: np.dtype | None = None
    base: Kind | None = None
    members: list[tuple[str, int, Kind]] = field(default_factory=list)
    shape: tuple[int, ...] = ()

    def numpy(self) -> np.dtype:
        if self.name == "compound":
            names, offsets, kinds = zip(*self.members)
            return np.dtype({"names": names, "offsets": offsets, "formats": [k.numpy() for k in kinds], "itemsize": self.size})
        if self.name == "array":
            return np.dtype((self.base.numpy(), self.shape))
        return self.dtype if self.dtype is not None else np.dtype(f"V{self.size}")


@dataclass
class Node:
    """An object header's messages by type."""

    address: int
    messages: dict[int, list[bytes]]

    def one(self, kind: int) -> bytes | None:
        return self.messages.get(kind, [None])[0]


class File:
    def __init__(self, data: bytes):
        start = next((o for o in (0, *(512 << k for k in range(16))) if data[o : o + 8] == MAGIC), None)
        if start is None:
            raise Hdf5Error("not an HDF5 file")
        self.data = memoryview(data)
        self.heaps: dict[int, dict[int, bytes]] = {}
        version = data[start + 8]
        if version < 2:
            sizes, at = data[start + 13 : start + 15], start + 24 + 4 * (version == 1)
            self.base = self._int(at)
            self.root = self._int(at + 40)
        elif version < 4:
            sizes, self.base, self.root = data[start + 9 : start + 11], self._int(start + 12), self._int(start + 36)
        else:
            raise Hdf5Error(f"HDF5 superblock {version} is not supported")
        if sizes != b"\x08\x08":
            raise Hdf5Error("HDF5 addresses that are not 8 bytes long are not supported")

    # ------------------------------------------------------------------ headers
    def _int(self, at: int, size: int = 8) -> int:
        return int.from_bytes(self.data[at : at + size], "little")

    def block(self, address: int, size: int) -> bytes:
        at = self.base + address
        if at + size > len(self.data):
            raise Hdf5Error("the HDF5 file is cut off")
        return bytes(self.data[at : at + size])

    def expect(self, address: int, mark: bytes) -> None:
        if self.block(address, 4) != mark:
            raise Hdf5Error(f"HDF5: no {mark.decode()} at {address}")

    def node(self, address: int) -> Node:
        found: dict[int, list[bytes]] = {}
        for kind, flags, body in self._messages(address):
            if flags & 2:
                body = self.shared(kind, body)
            found.setdefault(kind, []).append(body)
        return Node(address, found)

    def shared(self, kind: int, body: bytes) -> bytes:
        version, where = body[0], body[1]
        if version == 3 and where != 2:
            raise Hdf5Error("HDF5: messages in a shared heap are not supported")
        target = struct.unpack_from("<Q", body, 8 if version == 1 else 2)[0]
        got = self.node(target).one(kind)
        if got is None:
            raise Hdf5Error("HDF5: a shared message leads nowhere")
        return got

    def _messages(self, address: int) -> Iterator[tuple[int, int, bytes]]:
        if self.block(address, 4) == b"OHDR":
            flags = self.block(address + 5, 1)[0]
            at = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.block(address + at, width), "little")
            parts = [(address + at + width, size)]
            order = 2 * bool(flags & 4)
            while parts:
                where, size = parts.pop(0)
                raw, i = self.block(where, size), 0
                while i + 4 + order <= size:
                    kind, n, mark = raw[i], int.from_bytes(raw[i + 1 : i + 3], "little"), raw[i + 3]
                    body = raw[i + 4 + order : i + 4 + order + n]
                    i += 4 + order + n
                    if kind == 0x10:
                        a, n = struct.unpack_from("<QQ", body)
                        self.expect(a, b"OCHK")
                        parts.append((a + 4, n - 8))
                    else:
                        yield kind, mark, body
            return
        head = self.block(address, 16)
        if head[0] != 1:
            raise Hdf5Error(f"HDF5 object header {head[0]} is not supported")
        parts = [(address + 16, struct.unpack_from("<I", head, 8)[0])]
        while parts:
            where, size = parts.pop(0)
            raw, i = self.block(where, size), 0
            while i + 8 <= size:
                kind, n, mark = struct.unpack_from("<HHB", raw, i)
                body = raw[i + 8 : i + 8 + n]
                i += 8 + n
                if kind == 0x10:
                    parts.append(struct.unpack_from("<QQ", body))
                else:
                    yield kind, mark, body

    # ------------------------------------------------------------------ groups
    def links(self, node: Node) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        if (table := node.one(0x11)) is not None:
            tree, heap = struct.unpack_from("<QQ", table)
            self.expect(heap, b"HEAP")
            size, _, at = struct.unpack("<QQQ", self.block(heap + 8, 24))
            names = self.block(at, size)
            for leaf in self._leaves(tree, 0, 8):
                self.expect(leaf[1], b"SNOD")
                (n,) = struct.unpack("<H", self.block(leaf[1] + 6, 2))
                for k in range(n):
                    name, target, cache = struct.unpack("<QQI", self.block(leaf[1] + 8 + 40 * k, 20))
                    if cache != 2:  # 2: a soft link
                        out.append((names[name : names.index(b"\0", name)].decode(), target))
        bodies = list(node.messages.get(6, []))
        if (info := node.one(2)) is not None:
            heap, index = struct.unpack_from("<QQ", info, 2 + 8 * (info[1] & 1))
            if heap != NOWHERE:
                bodies += [self.heap_object(heap, r[4:]) for r in self.records(index)]
        return out + [x for x in map(_link, bodies) if x is not None]

    def _leaves(self, address: int, kind: int, key: int) -> Iterator[tuple[bytes, int]]:
        """(key, child) of the leaves of a version 1 B-tree."""
        if address == NOWHERE:
            return
        self.expect(address, b"TREE")
        got, level, n = struct.unpack("<BBH", self.block(address + 4, 4))
        if got != kind:
            raise Hdf5Error("HDF5: a B-tree of another kind")
        raw = self.block(address + 24, n * (key + 8) + key)
        for i in range(n):
            at = i * (key + 8)
            (child,) = struct.unpack_from("<Q", raw, at + key)
            if level:
                yield from self._leaves(child, kind, key)
            else:
                yield raw[at : at + key], child

    def records(self, address: int) -> Iterator[bytes]:
        """All records of a version 2 B-tree."""
        self.expect(address, b"BTHD")
        size, width, depth = struct.unpack("<IHH", self.block(address + 6, 8))
        root, n = struct.unpack("<QH", self.block(address + 16, 10))
        most = [(size - 10) // width]
        total, count = [most[0]], _bytes_for(most[0])
        for u in range(1, depth + 1):
            pointer = 8 + count + (_bytes_for(total[u - 1]) if u > 1 else 0)
            most.append((size - 10 - pointer) // (width + pointer))
            total.append((most[u] + 1) * total[u - 1] + most[u])

        def walk(at: int, n: int, u: int) -> Iterator[bytes]:
            self.expect(at, b"BTIN" if u else b"BTLF")
            raw = self.block(at + 6, n * width)
            yield from (raw[i * width : (i + 1) * width] for i in range(n))
            if u:
                more = _bytes_for(total[u - 1]) if u > 1 else 0
                for i in range(n + 1):
                    p = self.block(at + 6 + n * width + i * (8 + count + more), 8 + count)
                    yield from walk(int.from_bytes(p[:8], "little"), int.from_bytes(p[8:], "little"), u - 1)

        if root != NOWHERE and n:
            yield from walk(root, n, depth)

    def heap_object(self, address: int, ident: bytes) -> bytes:
        """An object of a fractal heap."""
        self.expect(address, b"FRHP")
        filters, _, managed = struct.unpack("<HBI", self.block(address + 7, 7))
        width, first, largest, bits = struct.unpack("<HQQH", self.block(address + 110, 20))
        root, rows = struct.unpack("<QH", self.block(address + 132, 10))
        kind = ident[0] >> 4 & 3
        if kind == 2:
            return ident[1 : 2 + (ident[0] & 15)]
        if kind or filters:
            raise Hdf5Error("HDF5: huge or filtered heap objects are not supported")
        wide = -(-bits // 8)
        offset = int.from_bytes(ident[1 : 1 + wide], "little")
        length = int.from_bytes(ident[1 + wide : 1 + wide + _bytes_for(min(largest, managed))], "little")
        direct_rows = (largest // first).bit_length() + 1
        start = 0
        while rows:  # an indirect block: the rows' blocks double in size from the third row on
            self.expect(root, b"FHIB")
            at = root + 13 + wide
            for r in range(rows):
                size = first << max(r - 1, 0)
                if offset < start + size * width:
                    column = (offset - start) // size
                    start += column * size
                    root = int.from_bytes(self.block(at + 8 * (r * width + column), 8), "little")
                    rows = 0 if r < direct_rows else size.bit_length() - (first * width).bit_length() + 1
                    break
                start += size * width
            else:
                raise Hdf5Error("HDF5: a heap object lies outside its heap")
        self.expect(root, b"FHDB")
        return self.block(root + offset - start, length)

    def global_object(self, address: int, index: int) -> bytes:
        if address not in self.heaps:
            self.expect(address, b"GCOL")
            (size,) = struct.unpack("<Q", self.block(address + 8, 8))
            raw, at, found = self.block(address, size), 16, {}
            while at + 16 <= size:
                i, n = struct.unpack_from("<H6xQ", raw, at)
                if not i:
                    break
                found[i] = raw[at + 16 : at + 16 + n]
                at += 16 + _pad8(n)
            self.heaps[address] = found
        return self.heaps[address][index]

    # ------------------------------------------------------------------ values
    def attributes(self, node: Node) -> dict[str, object]:
        bodies = list(node.messages.get(0x0C, []))
        if (info := node.one(0x15)) is not None:
            heap, index = struct.unpack_from("<QQ", info, 2 + 2 * (info[1] & 1))
            if heap != NOWHERE:
                bodies += [self.heap_object(heap, r[:8]) for r in self.records(index)]
        return dict(filter(None, map(self._attribute, bodies)))

    def _attribute(self, b: bytes) -> tuple[str, object] | None:
        version, flags, n, t, s = struct.unpack_from("<BBHHH", b)
        at = 8 + (version == 3)
        pad = _pad8 if version == 1 else int
        name = b[at : at + n].split(b"\0")[0].decode()
        at += pad(n)
        raw = b[at : at + t]
        kind, _ = parse_kind(self.shared(3, raw) if version > 1 and flags & 1 else raw, 0)
        at += pad(t)
        shape = parse_space(b[at : at + s])
        if shape is None or kind.name in ("compound", "opaque", "array"):
            return None
        x = self.values(b[at + pad(s) :], kind, shape)
        if x.dtype.kind == "S":
            x = np.array([v.decode("utf-8", "replace").rstrip("\0") for v in x.ravel().tolist()], object).reshape(x.shape)
        return name, x.ravel()[0] if x.size == 1 and kind.name != "vlen" else x

    def values(self, raw: bytes, kind: Kind, shape: tuple[int, ...]) -> np.ndarray:
        n = int(np.prod(shape, dtype=np.int64))
        if len(raw) < n * kind.size:
            raise Hdf5Error("HDF5: values are cut off")
        if kind.name not in ("vstring", "vlen"):
            return np.frombuffer(raw, kind.numpy(), n).reshape(shape)
        out = np.empty(n, object)
        for i, (size, address, index) in enumerate(struct.iter_unpack("<IQI", raw[: 16 * n])):
            body = self.global_object(address, index) if size else b""
            if kind.name == "vstring":
                out[i] = body[:size].split(b"\0")[0].decode("utf-8", "replace")
            else:
                out[i] = self.values(body, kind.base, (size,)) if size else np.zeros(0)
        return out.reshape(shape)

    def array(self, node: Node, kind: Kind, shape: tuple[int, ...]) -> np.ndarray:
        layout = node.one(8)
        version, how = layout[0], layout[1]
        if version not in (3, 4):
            raise Hdf5Error(f"HDF5 data layout {version} is not supported")
        n = int(np.prod(shape, dtype=np.int64)) * kind.size
        fill = self._fill(node, kind)
        if how == 0:
            return self.values(layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]], kind, shape)
        if how == 1:
            (address,) = struct.unpack_from("<Q", layout, 2)
            raw = fill * (n // max(kind.size, 1)) if address == NOWHERE else self.block(address, n)
            return self.values(raw, kind, shape)
        if how != 2:
            raise Hdf5Error("HDF5 virtual datasets are not supported")
        chunk, chunks = self._chunks(layout, shape)
        filters = _filters(node.one(0x0B))
        item = np.dtype(f"V{kind.size}")
        out = np.frombuffer(fill * max(n // max(kind.size, 1), 0), item).reshape(shape).copy()
        for at, address, size, mask in chunks:
            raw = self.block(address, size)
            for k, (name, conf) in reversed(list(enumerate(filters))):
                if not mask >> k & 1:
                    raw = _undo(name, conf, raw)
            block = np.frombuffer(raw, item, int(np.prod(chunk))).reshape(chunk)
            where = tuple(slice(a, min(a + c, s)) for a, c, s in zip(at, chunk, shape))
            if all(w.start < w.stop for w in where):
                out[where] = block[tuple(slice(0, w.stop - w.start) for w in where)]
        return self.values(out.tobytes(), kind, shape)

    def _chunks(self, layout: bytes, shape: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple[tuple[int, ...], int, int, int]]]:
        """Chunk shape, and (first cell, address, stored bytes, filters left out) of each stored chunk."""
        if layout[0] == 3:
            rank = layout[2]
            (tree,) = struct.unpack_from("<Q", layout, 3)
            chunk = struct.unpack_from(f"<{rank}I", layout, 11)[:-1]
            found = []
            for key, child in self._leaves(tree, 1, 8 + 8 * rank):
                size, mask = struct.unpack_from("<II", key)
                found.append((struct.unpack_from(f"<{rank - 1}Q", key, 8), child, size, mask))
            return chunk, found
        flags, rank, wide = layout[2:5]
        every = [int.from_bytes(layout[5 + wide * i : 5 + wide * (i + 1)], "little") for i in range(rank)]
        chunk, plain = tuple(every[:-1]), int(np.prod(every))
        at = 5 + wide * rank
        index, at = layout[at], at + 1
        if index == 1:
            size, mask = struct.unpack_from("<QI", layout, at) if flags & 2 else (plain, 0)
            (address,) = struct.unpack_from("<Q", layout, at + 12 * bool(flags & 2))
            return chunk, [] if address == NOWHERE else [((0,) * len(chunk), address, size, mask)]
        if index == 2:
            (address,) = struct.unpack_from("<Q", layout, at)
            places = itertools.product(*[range(0, max(s, 1), c) for s, c in zip(shape, chunk)])
            return chunk, [] if address == NOWHERE else [(p, address + k * plain, plain, 0) for k, p in enumerate(places)]
        raise Hdf5Error(f"HDF5 chunk index {index} is not supported")

    def _fill(self, node: Node, kind: Kind) -> bytes:
        value = b""
        if (b := node.one(5)) is not None:
            if b[0] == 3 and b[1] & 0x20:
                value = b[6 : 6 + struct.unpack_from("<I", b, 2)[0]]
            elif b[0] < 3 and len(b) >= 8 and (b[3] or b[0] == 1):
                value = b[8 : 8 + struct.unpack_from("<I", b, 4)[0]]
        return value if len(value) == kind.size else bytes(kind.size)


def _link(b: bytes) -> tuple[str, int] | None:
    """Name and address of a hard link message; None for other links."""
    flags, at, kind = b[1], 2, 0
    if flags & 8:
        kind, at = b[at], at + 1
    at += 8 * bool(flags & 4) + bool(flags & 16)
    wide = 1 << (flags & 3)
    n = int.from_bytes(b[at : at + wide], "little")
    at += wide
    return None if kind else (b[at : at + n].decode(), struct.unpack_from("<Q", b, at + n)[0])


def parse_kind(b: bytes, at: int) -> tuple[Kind, int]:
    """The data type that starts at `at`, and where it ends."""
    version, name = b[at] >> 4, b[at] & 15
    bits, size = int.from_bytes(b[at + 1 : at + 4], "little"), struct.unpack_from("<I", b, at + 4)[0]
    at += 8
    end = ">" if bits & 1 else "<"
    if name == 0:
        return Kind("number", size, np.dtype(f"{end}{'i' if bits & 8 else 'u'}{size}")), at + 4
    if name == 1:
        return Kind("number", size, np.dtype(f"{end}f{size}")), at + 12
    if name == 3:
        return Kind("string", size, np.dtype(f"S{size}")), at
    if name == 4:
        return Kind("number", size, np.dtype(f"{end}u{size}")), at + 4
    if name == 5:
        return Kind("opaque", size), at + (bits & 0xFF)
    if name == 6:
        members = []
        for _ in range(bits & 0xFFFF):
            stop = b.index(b"\0", at)
            label = b[at:stop].decode()
            at = stop + 1 if version == 3 else at + _pad8(stop + 1 - at)
            wide = _bytes_for(size) if version == 3 else 4
            offset = int.from_bytes(b[at : at + wide], "little")
            at += wide
            shape: tuple[int, ...] = ()
            if version == 1:
                shape = struct.unpack_from("<4I", b, at + 12)[: b[at]]
                at += 28
            kind, at = parse_kind(b, at)
            if shape:
                kind = Kind("array", kind.size * int(np.prod(shape)), base=kind, shape=shape)
            members.append((label, offset, kind))
        return Kind("compound", size, members=members), at
    if name == 7:
        return Kind("reference", size, np.dtype("<u8") if size == 8 else None), at
    if name == 8:
        base, at = parse_kind(b, at)
        for _ in range(bits & 0xFFFF):
            stop = b.index(b"\0", at)
            at = stop + 1 if version == 3 else at + _pad8(stop + 1 - at)
        return base, at + size * (bits & 0xFFFF)
    if name == 9:
        base, at = parse_kind(b, at)
        return Kind("vstring" if bits & 15 == 1 else "vlen", size, base=base), at
    if name == 10:
        rank, at = b[at], at + (1 if version == 3 else 4)
        shape = struct.unpack_from(f"<{rank}I", b, at)
        base, at = parse_kind(b, at + 4 * rank * (1 if version == 3 else 2))
        return Kind("array", size, base=base, shape=shape), at
    raise Hdf5Error(f"HDF5 data type {name} is not supported")


def parse_space(b: bytes) -> tuple[int, ...] | None:
    """Sizes of a dataspace; None for the null space."""
    version, rank = b[0], b[1]
    if version == 2 and b[3] == 2:
        return None
    return struct.unpack_from(f"<{rank}Q", b, 8 if version == 1 else 4)


def _filters(b: bytes | None) -> list[tuple[int, tuple[int, ...]]]:
    out = []
    if b is not None:
        version, n = b[0], b[1]
        at = 8 if version == 1 else 2
        for _ in range(n):
            (ident,) = struct.unpack_from("<H", b, at)
            named = version == 1 or ident >= 256
            label = struct.unpack_from("<H", b, at + 2)[0] if named else 0
            at += 4 if named else 2
            _, count = struct.unpack_from("<HH", b, at)
            at += 4 + (_pad8(label) if version == 1 else label)
            out.append((ident, struct.unpack_from(f"<{count}I", b, at)))
            at += 4 * (count + (count & 1 if version == 1 else 0))
    return out


def _undo(ident: int, conf: tuple[int, ...], raw: bytes) -> bytes:
    if ident == 1:
        return zlib.decompress(raw)
    if ident == 2:
        width = conf[0]
        n = len(raw) // width
        body = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T.tobytes()
        return body + raw[n * width :]
    if ident == 3:
        return raw[:-4]
    if ident == 32015:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise Hdf5Error(f"HDF5 filter {ident} is not supported")


def _walk(f: File) -> Iterator[tuple[str, Node]]:
    """Every object once, by its path."""
    todo, seen = [("", f.root)], set()
    while todo:
        path, address = todo.pop(0)
        if address in seen:
            continue
        seen.add(address)
        node = f.node(address)
        yield path, node
        if 1 not in node.messages:
            todo += [(f"{path}/{name}" if path else name, target) for name, target in f.links(node)]


def _load(f: File, node: Node, kind: Kind, shape: tuple[int, ...], member: str | None, chars: bool) -> np.ndarray:
    x = f.array(node, kind, shape)
    x = x if member is None else x[member]
    if chars:
        x = np.ascontiguousarray(x).view(f"S{max(x.shape[-1], 1)}").reshape(x.shape[:-1])
    return x.astype(x.dtype.newbyteorder("=")) if x.dtype.kind in "iuf" else x


def parse(data: bytes) -> Dataset:
    """The variables that a query does not touch are never decoded."""
    f = File(data)
    dims: dict[str, int] = {}
    variables: dict[str, LazyVariable] = {}
    top: dict[str, object] = {}
    found: list[tuple[str, Node, dict]] = []
    for path, node in _walk(f):
        attrs = f.attributes(node)
        if 1 in node.messages and 3 in node.messages:
            found.append((path, node, attrs))
        else:
            top |= {f"{path}/{k}" if path else k: v for k, v in attrs.items() if k not in _HIDDEN}
    scales = {node.address: path for path, node, attrs in found if attrs.get("CLASS") == "DIMENSION_SCALE"}
    numbers = {int(attrs["_Netcdf4Dimid"]): path for path, node, attrs in found if "_Netcdf4Dimid" in attrs and node.address in scales}
    phony: dict[tuple[int, int], str] = {}
    for path, node, attrs in found:
        shape = parse_space(node.one(1))
        if shape is None:
            continue
        own = attrs.get("_Netcdf4Coordinates")
        listed = attrs.get("DIMENSION_LIST")
        names: list[str | None] = [None] * len(shape)
        if own is not None and len(np.ravel(own)) == len(shape):
            names = [numbers.get(int(i)) for i in np.ravel(own)]
        elif listed is not None:
            names = [scales.get(int(x[0])) if len(x) else None for x in np.ravel(listed)]
        elif node.address in scales and len(shape) == 1:
            names = [path]
        for i, n in enumerate(shape):
            if names[i] is None:
                names[i] = phony.setdefault((n, shape[:i].count(n)), f"phony_dim_{len(phony)}")
            dims.setdefault(names[i], n)
        if str(attrs.get("NAME", "")).startswith(_NO_VARIABLE) and node.address in scales:
            continue
        kind, _ = parse_kind(node.one(3), 0)
        if kind.name in ("vlen", "opaque", "reference", "array"):
            continue  # no column type for them
        left = {k: v.item() if isinstance(v, np.generic) else v for k, v in attrs.items() if k not in _HIDDEN}
        if "_FillValue" in attrs:
            left["_FillValue"] = attrs["_FillValue"]
        for member, of in [(m, k) for m, _, k in kind.members if k.name in ("number", "string")] if kind.members else [(None, kind)]:
            chars = of.name == "string" and of.size == 1 and len(shape) > 0  # the last axis holds the characters of a text
            load = functools.partial(_load, f, node, kind, shape, member, chars)
            label = path if member is None else f"{path}/{member}"
            variables[label] = LazyVariable(tuple(names[:-1] if chars else names), load, left)
    return Dataset(dims, variables, {k: v.item() if isinstance(v, np.generic) else v for k, v in top.items()})
