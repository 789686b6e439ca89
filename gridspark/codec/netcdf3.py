"""NetCDF classic (CDF-1, CDF-2, CDF-5): header and values (numpy, no Spark)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .bits import FormatError, Unsupported, unsigned

MAX_ELEMENTS = 200_000_000
# External types, their names and numpy forms; from 7 on CDF-5 alone.
TYPES = {1: ("byte", ">i1"), 2: ("char", "S1"), 3: ("short", ">i2"), 4: ("int", ">i4"), 5: ("float", ">f4"), 6: ("double", ">f8"), 7: ("ubyte", ">u1"), 8: ("ushort", ">u2"), 9: ("uint", ">u4"), 10: ("int64", ">i8"), 11: ("uint64", ">u8")}


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    type: str
    form: str
    begin: int
    record: bool
    attrs: dict
    vsize: int = 0


@dataclass
class Dataset:
    version: int
    dims: dict = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)
    variables: list = field(default_factory=list)
    records: int = 0


def header(data: bytes) -> Dataset:
    if data[:3] != b"CDF" or len(data) < 8 or data[3] not in (1, 2, 5):
        raise FormatError("not a NetCDF classic file")
    ver = data[3]
    wide = 8 if ver == 5 else 4
    at = 4

    def number(n: int = wide) -> int:
        nonlocal at
        v = unsigned(data, at, n)
        at += n
        return v

    def name() -> str:
        nonlocal at
        n = number()
        if n > 1 << 20:
            raise FormatError("a name is too long")
        s = data[at : at + n].decode()
        at += -(-n // 4) * 4
        return s

    def listed(tag: int) -> int:
        kind, n = number(4), number()
        if kind not in (0, tag) or (kind == 0 and n):
            raise FormatError("a header list has the wrong tag")
        return n

    def attributes() -> dict:
        nonlocal at
        out = {}
        for _ in range(listed(0x0C)):
            key, kind, n = name(), number(4), number()
            if kind not in TYPES or (kind > 6 and ver != 5):
                raise FormatError(f"attribute type {kind}")
            form = TYPES[kind][1]
            size = n * int(form[-1])
            raw = data[at : at + size]
            at += -(-size // 4) * 4
            out[key] = raw.decode(errors="replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, form).tolist()
        return out

    ds = Dataset(ver)
    n = number()
    streaming = n == (1 << (8 * wide)) - 1
    ds.records = 0 if streaming else n
    dims = [(name(), number()) for _ in range(listed(0x0A))]
    ds.dims = dict(dims)
    ds.attrs = attributes()
    for _ in range(listed(0x0B)):
        key = name()
        rank = number()
        if rank > 4096:
            raise FormatError("too many dimensions")
        ids = [number() for _ in range(rank)]
        attrs = attributes()
        kind, vsize, begin = number(4), number(), number(4 if ver == 1 else 8)
        if kind not in TYPES or (kind > 6 and ver != 5) or any(i >= len(dims) for i in ids):
            raise FormatError(f"variable {key} is broken")
        record = bool(ids) and dims[ids[0]][1] == 0
        shape = [dims[i][1] for i in ids]
        v = Variable(key, [dims[i][0] for i in ids], shape, *TYPES[kind], begin, record, attrs)
        v.vsize = -(-int(np.prod(shape[1:] if record else shape, dtype=np.int64)) * int(v.form[-1]) // 4) * 4
        ds.variables.append(v)
    if streaming:
        stride = sum(v.vsize for v in ds.variables if v.record)
        first = min((v.begin for v in ds.variables if v.record), default=len(data))
        ds.records = (len(data) - first) // stride if stride else 0
    for v in ds.variables:
        if v.record:
            v.shape[0] = ds.records
    return ds


def packed(data: bytes, ds: Dataset, name: str) -> tuple[np.ndarray, Variable]:
    """A variable's values as they are stored, in place: no byte is copied."""
    v = next((v for v in ds.variables if v.name == name), None)
    if v is None:
        raise KeyError(name)
    if v.type == "char":
        raise Unsupported("character variables have no numeric values")
    n = int(np.prod(v.shape, dtype=np.int64))
    if n > MAX_ELEMENTS:
        raise FormatError("more elements than the engine decodes")
    if not n:
        return np.zeros(v.shape, v.form), v
    width = int(v.form[-1])
    each = int(np.prod(v.shape[1:], dtype=np.int64)) * width
    stride = each
    if v.record:
        own = [x for x in ds.variables if x.record]
        # a lone record variable is not padded between records
        stride = each if len(own) == 1 else sum(x.vsize for x in own)
    if v.begin + ((v.shape[0] - 1) * stride + each if v.shape else width) > len(data):
        raise FormatError(f"the values of {name} end too early")
    steps = [int(np.prod(v.shape[k + 1 :], dtype=np.int64)) * width for k in range(len(v.shape))]
    return np.ndarray(tuple(v.shape), v.form, data, v.begin, (stride, *steps[1:]) if v.shape else ()), v


def numbers(raw: np.ndarray, v: Variable) -> np.ma.MaskedArray:
    """Stored values of a variable as doubles; _FillValue and missing_value are masked."""
    out = np.ma.masked_array(raw.astype(np.float64), mask=np.zeros(raw.shape, bool))
    for key in ("_FillValue", "missing_value"):
        first = v.attrs.get(key)
        if isinstance(first, list) and first and first[0] == first[0]:
            out.mask |= out.data == float(first[0])
    return out


def values(data: bytes, ds: Dataset, name: str) -> np.ma.MaskedArray:
    """A variable's packed values as doubles; _FillValue and missing_value are masked."""
    return numbers(*packed(data, ds, name))
