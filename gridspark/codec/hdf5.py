"""The part of HDF5 that NetCDF-4 files use: groups, attributes, dimension scales and dataset values.

Superblocks 0 to 3, object headers 1 and 2, symbol-table, compact and dense groups, compact and
dense attributes, compact, contiguous and chunked layouts (version 1 trees, single chunk,
implicit, fixed array, version 2 trees), deflate and shuffle.  Checksums are not verified.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

from .bits import FormatError, Unsupported

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEF = 0xFFFFFFFFFFFFFFFF
MAX_NODES, MAX_FILTERS, MAX_ELEMENTS = 1 << 20, 32, 200_000_000
# Attributes that only hold the dimension machinery together.
HIDDEN = ("CLASS", "NAME", "DIMENSION_LIST", "REFERENCE_LIST", "_Netcdf4Dimid", "_Netcdf4Coordinates", "_NCProperties", "_nc3_strict")


@dataclass
class Node:
    """An object: its messages by type, or a link to one."""

    address: int
    messages: list = field(default_factory=list)  # (type, flags, body)

    def first(self, kind: int) -> bytes | None:
        return next((b for t, _, b in self.messages if t == kind), None)


class File:
    def __init__(self, data: bytes):
        self.data = data
        base = next((b for b in (0, 512, 1024, 2048) if data[b : b + 8] == SIGNATURE), None)
        if base is None:
            raise FormatError("not an HDF5 file")
        self.base, version = base, data[base + 8]
        if version in (0, 1):
            self.so, self.sl = data[base + 13], data[base + 14]
            root = base + 24 + (4 if version == 1 else 0) + 4 * self.so
            self.root = self.num(root + self.so, self.so)
        elif version in (2, 3):
            self.so, self.sl = data[base + 9], data[base + 10]
            self.root = self.num(base + 12 + 3 * self.so, self.so)
        else:
            raise Unsupported(f"superblock version {version}")
        self.visits = 0

    def num(self, at: int, n: int) -> int:
        if at < 0 or at + n > len(self.data):
            raise FormatError("an address points outside the file")
        return int.from_bytes(self.data[at : at + n], "little")

    def tick(self) -> None:
        self.visits += 1
        if self.visits > MAX_NODES:
            raise FormatError("too many nodes; the file may point at itself")

    # ---- object headers ----
    def node(self, address: int) -> Node:
        self.tick()
        d, at = self.data, address + self.base
        out = Node(address)
        if d[at : at + 4] == b"OHDR":
            flags = d[at + 5]
            p = at + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            w = 1 << (flags & 3)
            size = self.num(p, w)
            todo, tracked = [(p + w, size)], bool(flags & 0x04)
            while todo:
                self.tick()
                p, n = todo.pop(0)
                end = p + n
                while p + 4 <= end:
                    kind, n2, fl = d[p], self.num(p + 1, 2), d[p + 3]
                    p += 4 + (2 if tracked else 0)
                    if p + n2 > end:
                        break
                    body = d[p : p + n2]
                    if kind == 16:
                        a, k = int.from_bytes(body[: self.so], "little"), int.from_bytes(body[self.so : self.so + self.sl], "little")
                        todo.append((a + self.base + 4, k - 8))
                    elif kind:
                        out.messages.append((kind, fl, self.resolved(kind, fl, body)))
                    p += n2
        elif d[at : at + 1] == b"\x01":
            left, todo = self.num(at + 2, 2), [(at + 16, self.num(at + 8, 4))]
            while todo and left > 0:
                self.tick()
                p, n = todo.pop(0)
                end = p + n
                while p + 8 <= end and left > 0:
                    kind, n2, fl = self.num(p, 2), self.num(p + 2, 2), d[p + 4]
                    body = d[p + 8 : p + 8 + n2]
                    left -= 1
                    if kind == 16:
                        todo.append((int.from_bytes(body[: self.so], "little") + self.base, int.from_bytes(body[self.so : self.so + self.sl], "little")))
                    elif kind:
                        out.messages.append((kind, fl, self.resolved(kind, fl, body)))
                    p += 8 + n2
        else:
            raise FormatError("no object header where one is pointed at")
        return out

    def resolved(self, kind: int, flags: int, body: bytes) -> bytes:
        """The body of a message, that of the committed object where it is shared."""
        if not flags & 0x02:
            return body
        address = int.from_bytes(body[-self.so :] if body[0] == 3 else body[8 : 8 + self.so] if body[0] == 1 else body[2 : 2 + self.so], "little")
        return self.node(address).first(kind) or body

    # ---- groups ----
    def children(self, node: Node) -> dict[str, int]:
        out: dict[str, int] = {}
        if (b := node.first(17)) is not None:
            tree, heap = (int.from_bytes(b[k * self.so : (k + 1) * self.so], "little") for k in (0, 1))
            names = self.num(heap + self.base + 8 + 2 * self.sl, self.so) + self.base
            self._symbols(tree + self.base, names, out)
        for kind, _, b in node.messages:
            if kind == 6:
                self._link(b, out)
        if (b := node.first(2)) is not None:
            p = 2 + (8 if b[1] & 1 else 0)
            heap, index = (int.from_bytes(b[p + k * self.so : p + (k + 1) * self.so], "little") for k in (0, 1))
            if heap != UNDEF >> (64 - 8 * self.so) and index != UNDEF >> (64 - 8 * self.so):
                h = Heap(self, heap)
                for rec in self.tree2(index):
                    self._link(h.get(rec[4:]), out)  # name hash, then heap id
        return out

    def _symbols(self, at: int, names: int, out: dict) -> None:
        self.tick()
        d = self.data
        if d[at : at + 4] == b"SNOD":
            for k in range(self.num(at + 6, 2)):
                e = at + 8 + k * (2 * self.so + 24)
                s = names + self.num(e, self.so)
                out[d[s : d.index(b"\0", s)].decode()] = self.num(e + self.so, self.so)
        elif d[at : at + 4] == b"TREE":
            p = at + 8 + 2 * self.so + self.sl
            for k in range(self.num(at + 6, 2)):
                self._symbols(self.num(p + k * (self.so + self.sl), self.so) + self.base, names, out)
        else:
            raise FormatError("a group index is broken")

    def _link(self, b: bytes, out: dict) -> None:
        flags, p = b[1], 2
        kind = b[p] if flags & 8 else 0
        p += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        w = 1 << (flags & 3)
        n = int.from_bytes(b[p : p + w], "little")
        name = b[p + w : p + w + n].decode()
        if kind == 0:
            out[name] = int.from_bytes(b[p + w + n : p + w + n + self.so], "little")

    def tree2(self, address: int) -> list[bytes]:
        """Records of a version 2 tree, in order."""
        d, at = self.data, address + self.base
        if d[at : at + 4] != b"BTHD":
            raise FormatError("no version 2 tree where one is pointed at")
        size, rec, depth = self.num(at + 6, 4), self.num(at + 10, 2), self.num(at + 12, 2)
        root, n = self.num(at + 16, self.so), self.num(at + 16 + self.so, 2)
        if not n:
            return []
        cap = [(size - 10) // rec]
        width = [0]
        total = cap[0]
        for _ in range(depth):
            prev = -(-cap[-1].bit_length() // 8)
            tw = -(-total.bit_length() // 8) if len(cap) > 1 else 0
            m = (size - 10 - self.so - prev - tw) // (rec + self.so + prev + tw)
            cap.append(m)
            width.append(tw)
            total = m + (m + 1) * total
        out: list[bytes] = []

        def walk(a: int, n: int, level: int) -> None:
            self.tick()
            p = a + self.base + 6
            recs = [d[p + k * rec : p + (k + 1) * rec] for k in range(n)]
            if level == 0:
                out.extend(recs)
                return
            p += n * rec
            w = -(-cap[level - 1].bit_length() // 8)
            for k in range(n + 1):
                walk(self.num(p, self.so), self.num(p + self.so, w), level - 1)
                p += self.so + w + width[level]
                if k < n:
                    out.append(recs[k])

        walk(root, n, depth)
        return out

    # ---- attributes ----
    def attributes(self, node: Node) -> dict:
        out = {}
        for kind, _, b in node.messages:
            if kind == 12:
                self._attribute(b, out)
        if (b := node.first(21)) is not None:
            p = 2 + (2 if b[1] & 1 else 0)
            heap, index = (int.from_bytes(b[p + k * self.so : p + (k + 1) * self.so], "little") for k in (0, 1))
            if heap != UNDEF >> (64 - 8 * self.so) and index != UNDEF >> (64 - 8 * self.so):
                h = Heap(self, heap)
                for rec in self.tree2(index):
                    self._attribute(h.get(rec[:8]), out)
        return dict(sorted(out.items()))

    def _attribute(self, b: bytes, out: dict) -> None:
        v = b[0]
        n, t, s = (int.from_bytes(b[k : k + 2], "little") for k in (2, 4, 6))
        p = 8 + (v == 3)
        pad = (lambda k: -(-k // 8) * 8) if v == 1 else (lambda k: k)
        name = b[p : p + n].split(b"\0")[0].decode()
        p += pad(n)
        kind = b[p : p + t]
        p += pad(t)
        space = b[p : p + s]
        p += pad(s)
        if v > 1 and b[1] & 1:
            kind = self.resolved(3, 2, kind)
        dt, shape = Type.parse(kind), self.shape(space)
        count = int(np.prod(shape, dtype=np.int64)) if shape else 1
        out[name] = dt.read(self, b[p:], count)

    def shape(self, b: bytes) -> list[int]:
        rank, at = b[1], 8 if b[0] == 1 else 4
        return [int.from_bytes(b[at + k * self.sl : at + (k + 1) * self.sl], "little") for k in range(rank)]

    def most(self, b: bytes) -> list[int | None]:
        """The largest shape of a data space: None where a dimension is unlimited."""
        rank, at = b[1], 8 if b[0] == 1 else 4
        if not b[2] & 1:
            return list(self.shape(b))
        end = (1 << 8 * self.sl) - 1
        found = [int.from_bytes(b[at + k * self.sl : at + (k + 1) * self.sl], "little") for k in range(rank, 2 * rank)]
        return [None if v == end else v for v in found]

    def global_object(self, address: int, index: int) -> bytes:
        at = address + self.base
        if self.data[at : at + 4] != b"GCOL":
            raise FormatError("no global heap where one is pointed at")
        end = at + self.num(at + 8, self.sl)
        p = at + 8 + self.sl
        while p + 8 + self.sl <= end:
            i, n = self.num(p, 2), self.num(p + 8, self.sl)
            if i == index:
                return self.data[p + 8 + self.sl : p + 8 + self.sl + n]
            if i == 0:
                break
            p += 8 + self.sl + -(-n // 8) * 8
        raise FormatError("an object is missing from a global heap")


class Heap:
    """A fractal heap's managed, tiny and huge-less objects."""

    def __init__(self, f: File, address: int):
        d, at, so, sl = f.data, address + f.base, f.so, f.sl
        if d[at : at + 4] != b"FRHP":
            raise FormatError("no fractal heap where one is pointed at")
        self.f, self.filters = f, f.num(at + 7, 2)
        p = at + 5 + 2 + 2 + 1 + 4 + sl + so + sl + so + 8 * sl
        self.width, self.start, self.direct, self.bits = f.num(p, 2), f.num(p + 2, sl), f.num(p + 2 + sl, sl), f.num(p + 2 + 2 * sl, 2)
        self.root, self.rows = f.num(p + 6 + 2 * sl, so), f.num(p + 6 + 2 * sl + so, 2)
        self.off = -(-self.bits // 8)
        self.len = -(-min(self.direct, f.num(at + 10, 4)).bit_length() // 8)
        self.head = 5 + so + self.off
        if self.filters:
            raise Unsupported("filtered fractal heaps")

    def _row(self, r: int) -> int:
        return self.start << max(0, r - 1)

    def _find(self, address: int, rows: int, base: int, want: int) -> tuple[int, int]:
        """(file position of a block, its offset in the heap) that holds heap offset ``want``."""
        self.f.tick()
        if not rows:
            return address + self.f.base, base
        p = address + self.f.base + self.head
        at, r = base, 0
        top = (self.direct // self.start).bit_length() + 1
        for r in range(rows):
            size = self._row(r)
            if want < at + size * self.width:
                k = (want - at) // size
                before = r * self.width + k
                child = self.f.num(p + before * self.f.so, self.f.so)
                inner = 0 if r < top else (size // (self.start * self.width)).bit_length()
                return self._find(child, inner, at + k * size, want)
            at += size * self.width
        raise FormatError("an object lies outside its heap")

    def get(self, ident: bytes) -> bytes:
        kind = ident[0] >> 4 & 3
        if kind == 2:
            n = (ident[0] & 15) + 1
            return ident[1 : 1 + n]
        if kind:
            raise Unsupported("huge heap objects")
        off = int.from_bytes(ident[1 : 1 + self.off], "little")
        n = int.from_bytes(ident[1 + self.off : 1 + self.off + self.len], "little")
        at, base = self._find(self.root, self.rows, 0, off)
        return self.f.data[at + off - base : at + off - base + n]


@dataclass
class Type:
    cls: int
    size: int
    form: str | None = None  # numpy form of numbers
    base: "Type | None" = None
    string: bool = False

    @staticmethod
    def parse(b: bytes) -> "Type":
        cls, flags, size = b[0] & 15, int.from_bytes(b[1:4], "little"), int.from_bytes(b[4:8], "little")
        order = ">" if flags & 1 else "<"
        if cls == 0 and size in (1, 2, 4, 8):
            return Type(0, size, f"{order}{'i' if flags & 8 else 'u'}{size}")
        if cls == 1 and size in (4, 8):
            return Type(1, size, f"{order}f{size}")
        if cls == 9:
            return Type(9, size, None, Type.parse(b[8:]), flags & 15 == 1)
        return Type(cls, size)

    @property
    def name(self) -> str:
        if self.cls == 3 or (self.cls == 9 and self.string):
            return "char"
        if self.form is None:
            return f"class_{self.cls}"
        k = {"i1": "byte", "u1": "ubyte", "i2": "short", "u2": "ushort", "i4": "int", "u4": "uint", "i8": "int64", "u8": "uint64", "f4": "float", "f8": "double"}
        return k[self.form[1:]]

    def read(self, f: File, raw: bytes, n: int):
        if self.form:
            return np.frombuffer(raw, self.form, n).tolist()
        if self.cls == 3:
            s = [raw[k * self.size : (k + 1) * self.size].split(b"\0")[0].decode(errors="replace") for k in range(n)]
            return s[0] if n == 1 else s
        if self.cls == 7:
            return [int.from_bytes(raw[k * self.size : k * self.size + f.so], "little") for k in range(n)]
        if self.cls == 9:
            out = []
            for k in range(n):
                p = k * self.size
                m, a, i = int.from_bytes(raw[p : p + 4], "little"), int.from_bytes(raw[p + 4 : p + 4 + f.so], "little"), int.from_bytes(raw[p + 4 + f.so : p + 8 + f.so], "little")
                body = f.global_object(a, i) if m else b""
                out.append(body[:m].decode(errors="replace") if self.string else self.base.read(f, body, m))
            return out[0] if self.string and n == 1 else out
        return f"unsupported type class {self.cls}"


@dataclass
class Dataset:
    name: str
    address: int
    type: Type
    shape: list[int]
    attrs: dict
    node: Node


def datasets(f: File) -> list[Dataset]:
    """Every dataset below the root group, depth first, links in name order."""
    out, seen = [], set()

    def walk(address: int, prefix: str) -> None:
        if address in seen:
            return
        seen.add(address)
        for name, a in sorted(f.children(f.node(address)).items()):
            n = f.node(a)
            if n.first(8) is not None and n.first(3) is not None and n.first(1) is not None:
                out.append(Dataset(prefix + name, a, Type.parse(n.first(3)), f.shape(n.first(1)), f.attributes(n), n))
            elif a not in seen:
                walk(a, prefix + name + "/")

    walk(f.root, "")
    return out


def dimensions(f: File, found: list[Dataset]) -> dict[str, list[str]]:
    """Dimension names of each dataset: DIMENSION_LIST references to scales, else the scale itself, else phony names."""
    by_address = {d.address: d.name for d in found}
    by_id = {d.attrs["_Netcdf4Dimid"][0]: d.name for d in found if isinstance(d.attrs.get("_Netcdf4Dimid"), list) and d.attrs.get("CLASS") == "DIMENSION_SCALE"}
    out = {}
    for d in found:
        refs, ids = d.attrs.get("DIMENSION_LIST"), d.attrs.get("_Netcdf4Coordinates")
        if isinstance(refs, list) and len(refs) == len(d.shape) and all(refs):
            out[d.name] = [by_address.get(r[0], f"phony_dim_{k}") for k, r in enumerate(refs)]
        elif isinstance(ids, list) and len(ids) == len(d.shape):
            out[d.name] = [by_id.get(i, f"phony_dim_{k}") for k, i in enumerate(ids)]
        elif d.attrs.get("CLASS") == "DIMENSION_SCALE" and len(d.shape) == 1:
            out[d.name] = [d.name]
        else:
            out[d.name] = [f"phony_dim_{k}" for k in range(len(d.shape))]
    return out


def variables(data: bytes) -> list[tuple[str, str, list[str], list[int], dict]]:
    """(name, type, dimensions, shape, attributes) by name; dimensions without a variable are left out."""
    f = File(data)
    found = datasets(f)
    dims = dimensions(f, found)
    own = [d for d in found if not str(d.attrs.get("NAME", "")).startswith("This is a netCDF dimension but not a netCDF variable")]
    return [(d.name, d.type.name, dims[d.name], d.shape, {k: v for k, v in d.attrs.items() if k not in HIDDEN}) for d in sorted(own, key=lambda d: d.name)]


def _filters(node: Node) -> list[tuple[int, list[int]]]:
    b = node.first(11)
    if b is None:
        return []
    if b[1] > MAX_FILTERS:
        raise FormatError("too many filters")
    p, out = (8 if b[0] == 1 else 2), []
    for _ in range(b[1]):
        ident = int.from_bytes(b[p : p + 2], "little")
        p += 2
        named = b[0] == 1 or ident >= 256
        n = int.from_bytes(b[p : p + 2], "little") if named else 0
        p += 2 if named else 0
        k = int.from_bytes(b[p + 2 : p + 4], "little")
        p += 4 + (-(-n // 8) * 8 if b[0] == 1 else n)
        out.append((ident, [int.from_bytes(b[p + 4 * i : p + 4 * i + 4], "little") for i in range(k)]))
        p += 4 * k + (4 if b[0] == 1 and k % 2 else 0)
    return out


def _undo(raw: bytes, filters, mask: int, size: int) -> bytes:
    for k in range(len(filters) - 1, -1, -1):
        if mask >> k & 1:
            continue
        ident, client = filters[k]
        if ident == 1:
            raw = zlib.decompress(raw)
        elif ident == 2:
            n = client[0] if client else size
            whole = len(raw) // n * n
            raw = np.frombuffer(raw[:whole], np.uint8).reshape(n, -1).T.tobytes() + raw[whole:]
        else:
            raise Unsupported(f"filter {ident}")
    return raw


def _fill(node: Node, t: Type) -> float:
    b = node.first(5)
    raw = b""
    if b is not None:
        if b[0] in (1, 2) and len(b) >= 8 and b[3]:
            raw = b[8 : 8 + int.from_bytes(b[4:8], "little")]
        elif b[0] == 3 and b[1] & 0x20:
            raw = b[6 : 6 + int.from_bytes(b[2:6], "little")]
    elif (b := node.first(4)) is not None:
        raw = b[4 : 4 + int.from_bytes(b[:4], "little")]
    return float(np.frombuffer(raw, t.form, 1)[0]) if t.form and len(raw) >= t.size else 0.0


def _extensible(f: File, address: int):
    """(number, file position, size) of the elements an extensible array has stored."""
    so, sl, unset = f.so, f.sl, UNDEF >> (64 - 8 * f.so)

    def block(a: int, mark: bytes) -> int:
        f.tick()
        if f.data[a + f.base : a + f.base + 4] != mark:
            raise FormatError("a chunk index is broken")
        return a + f.base + 6

    p = block(address, b"EAHD")
    esize, bits, direct, least, pointers, page_bits = f.data[p : p + 6]
    if not esize or not least or not pointers:
        raise FormatError("a chunk index is broken")
    last = f.num(p + 6 + 4 * sl, sl)  # elements up to here were ever set
    index = f.num(p + 6 + 6 * sl, so)
    wide, page = -(-bits // 8), 1 << page_bits
    if index == unset:
        return
    p = block(index, b"EAIB") + so
    yield from ((i, p + i * esize, esize) for i in range(min(direct, last)))
    p += direct * esize

    def data(a: int, first: int, n: int, set_pages: list[bool] | None):
        q = block(a, b"EADB") + so + wide
        for i in range(min(n, last - first)):
            if set_pages is None:
                yield first + i, q + i * esize, esize
            elif set_pages[i // page]:
                yield first + i, q + 4 + i // page * (page * esize + 4) + i % page * esize, esize

    first, inner = direct, 2 * (pointers.bit_length() - 1)
    for level in range(1 + bits - (least.bit_length() - 1)):
        blocks, n = 1 << level // 2, least << (level + 1) // 2
        if first >= last:
            return
        if level < inner:  # the index block points at these data blocks itself
            for k in range(blocks):
                if (a := f.num(p + k * so, so)) != unset:
                    yield from data(a, first + k * n, n, None)
            p += blocks * so
        else:
            a, p = f.num(p, so), p + so
            if a != unset:
                q = block(a, b"EASB") + so + wide
                pages = n // page if n > page else 0
                marks = f.data[q : q + blocks * -(-pages // 8)]
                q += len(marks)
                for k in range(blocks):
                    if (a := f.num(q + k * so, so)) != unset and first + k * n < last:
                        own = [bool(marks[m // 8] >> (7 - m % 8) & 1) for m in range(k * pages, (k + 1) * pages)]
                        yield from data(a, first + k * n, n, own or None)
        first += blocks * n


def _chunks(f: File, d: Dataset, b: bytes, filtered: bool):
    """(offset of a chunk in elements, address, stored size, filter mask) of a chunked layout, and its chunk shape."""
    so = f.so
    rank = len(d.shape)
    if b[0] == 3:
        address = int.from_bytes(b[3 : 3 + so], "little")
        shape = [int.from_bytes(b[3 + so + 4 * k : 7 + so + 4 * k], "little") for k in range(rank)]
        out: list = []

        def walk(a: int) -> None:
            f.tick()
            at = a + f.base
            if f.data[at : at + 4] != b"TREE":
                raise FormatError("a chunk index is broken")
            level, n, key = f.data[at + 5], f.num(at + 6, 2), 8 + 8 * (rank + 1)
            p = at + 8 + 2 * so
            for _ in range(n):
                child = f.num(p + key, so)
                if level:
                    walk(child)
                else:
                    out.append(([f.num(p + 8 + 8 * k, 8) for k in range(rank)], child, f.num(p, 4), f.num(p + 4, 4)))
                p += key + so

        if address != UNDEF >> (64 - 8 * so):
            walk(address)
        return out, shape
    flags, w = b[2], b[4]
    n = b[3]
    shape = [int.from_bytes(b[5 + w * k : 5 + w * (k + 1)], "little") for k in range(n)][:rank]
    p = 5 + w * n
    kind, p = b[p], p + 1
    space = d.node.first(1)
    most = f.most(space) if space is not None else list(d.shape)
    # chunks are numbered over the largest shape; an unlimited dimension varies slowest
    grid = [-(-(s if m is None else m) // c) for s, m, c in zip(d.shape, most, shape, strict=True)]
    turn = sorted(range(rank), key=lambda k: most[k] is not None)
    whole = int(np.prod(shape, dtype=np.int64)) * d.type.size

    def place(i: int) -> list[int]:
        out = [0] * rank
        for k in reversed(turn):
            n = grid[k] if most[k] is not None else i + 1
            out[k], i = i % n * shape[k], i // n
        return out

    inside = lambda off: all(o < s for o, s in zip(off, d.shape, strict=True))

    def entry(e: int, esize: int) -> tuple[int, int, int]:
        """(address, stored size, filter mask) of an index element."""
        return (f.num(e, so), f.num(e + so, esize - so - 4), f.num(e + esize - 4, 4)) if filtered else (f.num(e, so), whole, 0)

    unset = UNDEF >> (64 - 8 * so)
    if kind == 1:
        size, mask = whole, 0
        if flags & 2:
            size, mask = int.from_bytes(b[p : p + f.sl], "little"), int.from_bytes(b[p + f.sl : p + f.sl + 4], "little")
            p += f.sl + 4
        return [([0] * rank, int.from_bytes(b[p : p + so], "little"), size, mask)], shape
    if kind == 2:
        a = int.from_bytes(b[p : p + so], "little")
        if a == unset:
            return [], shape
        return [(off, a + i * whole, whole, 0) for i in range(int(np.prod(grid))) if inside(off := place(i))], shape
    if kind == 3:
        bits = b[p]
        at = int.from_bytes(b[p + 1 : p + 1 + so], "little") + f.base
        esize, n = f.data[at + 6], f.num(at + 8, f.sl)
        block = f.num(at + 8 + f.sl, so) + f.base
        per = 1 << bits
        pages = -(-n // per) if n > per else 0
        q = block + 6 + so
        out = []
        marks = f.data[q : q + -(-pages // 8)] if pages else b""
        q += (-(-pages // 8) + 4) if pages else 0
        for i in range(n):
            e = q + (i // per) * (per * esize + 4) + (i % per) * esize if pages else q + i * esize
            if pages and not marks[(i // per) // 8] >> (7 - (i // per) % 8) & 1:
                continue
            a, size, mask = entry(e, esize)
            if a != unset and inside(off := place(i)):
                out.append((off, a, size, mask))
        return out, shape
    if kind == 4:
        head = int.from_bytes(b[p + 5 : p + 5 + so], "little")
        out = []
        for i, e, esize in _extensible(f, head) if head != unset else ():
            a, size, mask = entry(e, esize)
            if a != unset and inside(off := place(i)):
                out.append((off, a, size, mask))
        return out, shape
    if kind == 5:
        at = int.from_bytes(b[p + 6 : p + 6 + so], "little")
        out = []
        for rec in f.tree2(at):
            a, q = int.from_bytes(rec[:so], "little"), so
            size, mask = whole, 0
            if filtered:
                k = len(rec) - so - 4 - 8 * rank
                size, mask = int.from_bytes(rec[so : so + k], "little"), int.from_bytes(rec[so + k : so + k + 4], "little")
                q = so + k + 4
            out.append(([int.from_bytes(rec[q + 8 * i : q + 8 * i + 8], "little") * c for i, c in enumerate(shape)], a, size, mask))
        return out, shape
    raise Unsupported(f"chunk index {kind}")


def values(data: bytes, name: str) -> np.ma.MaskedArray:
    """A variable's packed values as doubles; _FillValue and missing_value are masked, unstored chunks hold the fill."""
    f = File(data)
    d = next((d for d in datasets(f) if d.name == name), None)
    if d is None:
        raise KeyError(name)
    if d.type.form is None:
        raise Unsupported(f"values of type {d.type.name}")
    n = int(np.prod(d.shape, dtype=np.int64)) if d.shape else 1
    if n > MAX_ELEMENTS:
        raise FormatError("more elements than the engine decodes")
    b, filters = d.node.first(8), _filters(d.node)
    if b[0] not in (3, 4):
        raise Unsupported(f"layout version {b[0]}")
    out = np.full(d.shape, _fill(d.node, d.type))
    if b[1] == 0:
        k = int.from_bytes(b[2:4], "little")
        out = np.frombuffer(b[4 : 4 + k], d.type.form, n).astype(np.float64).reshape(d.shape)
    elif b[1] == 1:
        a = int.from_bytes(b[2 : 2 + f.so], "little")
        if a != UNDEF >> (64 - 8 * f.so):
            if a + f.base + n * d.type.size > len(data):
                raise FormatError(f"the values of {name} end too early")
            out = np.frombuffer(data, d.type.form, n, a + f.base).astype(np.float64).reshape(d.shape)
    elif b[1] == 2:
        found, shape = _chunks(f, d, b, bool(filters))
        for off, a, size, mask in found:
            raw = _undo(data[a + f.base : a + f.base + size], filters, mask, d.type.size)
            part = np.frombuffer(raw, d.type.form, int(np.prod(shape))).reshape(shape)
            own = tuple(slice(o, min(o + c, s)) for o, c, s in zip(off, shape, d.shape, strict=True))
            out[own] = part[tuple(slice(0, s.stop - s.start) for s in own)]
    else:
        raise Unsupported(f"layout class {b[1]}")
    v = np.ma.masked_array(out, mask=np.zeros(out.shape, bool))
    for key in ("_FillValue", "missing_value"):
        first = d.attrs.get(key)
        if isinstance(first, list) and first and first[0] == first[0]:
            v.mask |= v.data == float(first[0])
    return v
