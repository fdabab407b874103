"""N-dimensional datasets as rows: grid choice, CF decoding, broadcasting, ragged arrays.

A dataset has variables over named dimensions, and attributes. Rows are the cells of one grid in C order;
variables over fewer of its dimensions repeat, attributes (`<variable>.<attribute>`, `.<global>`) are constants.
The grid is chosen among the *referenced* variables, so a query's column list decides its row count.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa


class GridError(ValueError):
    pass


@dataclass
class Variable:
    dims: tuple[str, ...]
    values: np.ndarray
    attrs: dict[str, object] = field(default_factory=dict)
    mask: np.ndarray | None = None  # True: null


class LazyVariable(Variable):
    """A variable whose values are read when they are first needed."""

    def __init__(self, dims: tuple[str, ...], load: Callable[[], np.ndarray], attrs: dict[str, object]):
        self.dims, self.attrs, self.mask = dims, attrs, None
        self._load, self._values = load, None

    @property
    def values(self) -> np.ndarray:
        if self._values is None:
            self._values = self._load()
        return self._values


@dataclass
class Dataset:
    dims: dict[str, int]
    variables: dict[str, Variable]
    attrs: dict[str, object] = field(default_factory=dict)


_UNIT = {
    "microsecond": 1, "millisecond": 1000, "second": 10**6, "sec": 10**6, "s": 10**6, "minute": 60 * 10**6, "min": 60 * 10**6,
    "hour": 3600 * 10**6, "hr": 3600 * 10**6, "h": 3600 * 10**6, "day": 86400 * 10**6, "d": 86400 * 10**6, "week": 7 * 86400 * 10**6,
}
_SINCE = re.compile(r"^\s*(\w+)\s+since\s+(-?\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2})(?::(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?)?\s*(Z|UTC|[+-]\d{1,2}(?::?\d{2})?)?\s*$", re.I)


def time_units(units: str, calendar: str | None = None) -> tuple[float, int] | None:
    """Microseconds for a unit, and the epoch in microseconds, of CF time units; None if they are not time units.

    Calendars other than standard, gregorian, proleptic_gregorian and julian raise."""
    m = _SINCE.match(units)
    if not m:
        return None
    name = m[1].lower()
    unit = _UNIT.get(name, _UNIT.get(name.removesuffix("s")))
    if unit is None:
        return None
    kind = (calendar or "standard").lower()
    if kind not in ("standard", "gregorian", "proleptic_gregorian", "julian"):
        raise ValueError(f"calendar {calendar} is not supported")
    y, mo, d, h, mi = (int(x or 0) for x in m.groups()[1:6])
    days = _julian_days(y, mo, d) if kind == "julian" else (dt.date(y, mo, d) - dt.date(1970, 1, 1)).days
    zone = 0
    if m[8] and m[8].upper() not in ("Z", "UTC"):
        sign = -1 if m[8][0] == "-" else 1
        digits = m[8][1:].replace(":", "")
        zone = sign * (int(digits[:2]) * 60 + int(digits[2:] or 0))
    epoch = ((days * 24 + h) * 60 + mi - zone) * 60 * 10**6 + round(float(m[7] or 0) * 10**6)
    return unit, epoch


def _julian_days(y: int, m: int, d: int) -> int:
    a = (14 - m) // 12
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 - 32083 - 2440588


def decode(v: Variable) -> Variable:
    """CF decoding: fill values to null, scale and offset to double, time units to microsecond timestamps."""
    a, x, mask = v.attrs, v.values, v.mask
    if x.dtype.kind in "SU":
        return v
    fill = a.get("_FillValue")
    if fill is not None and x.dtype.kind in "iuf":
        f = np.asarray(fill).ravel()[0]
        null = np.isnan(x) if isinstance(f, float | np.floating) and math.isnan(f) else x == np.asarray(f).astype(x.dtype)
        mask = null if mask is None else mask | null
    scale, offset = a.get("scale_factor"), a.get("add_offset")
    if scale is not None or offset is not None:
        x = x.astype(np.float64)
        x = x * float(np.asarray(1 if scale is None else scale).ravel()[0]) + float(np.asarray(0 if offset is None else offset).ravel()[0])
    units = a.get("units")
    if isinstance(units, str) and (t := time_units(units, a.get("calendar"))):
        unit, epoch = t
        if x.dtype.kind == "f":
            bad = ~np.isfinite(x)
            mask = bad if mask is None else mask | bad
            whole = np.rint(np.where(bad, 0, x) * unit).astype(np.int64)
        else:
            whole = x.astype(np.int64) * int(unit)
        x = (whole + epoch).view("datetime64[us]")
    return Variable(v.dims, x, a, mask)


def grid(shapes: dict[str, tuple[str, ...]], sizes: dict[str, int], dimensions: Sequence[str] | None = None) -> tuple[str, ...]:
    """The dimensions that rows run over. Explicit dimensions win, pruned to those some variable has; unknown ones raise.

    If one variable's dimensions hold those of all others, they are the grid; else the candidate that is not empty,
    keeps most variables, is some variable's own shape, has most cells and came first."""
    if dimensions is not None:
        for d in dimensions:
            if d not in sizes:
                raise GridError(f"unknown dimension {d}")
        return tuple(dimensions)
    shapes = {k: s for k, s in shapes.items() if s}
    if not shapes:
        return ()
    candidates = list(dict.fromkeys(shapes.values()))
    whole = [c for c in candidates if all(set(s) <= set(c) for s in shapes.values())]
    if whole:
        return whole[0]

    def key(i: int) -> tuple:
        c = candidates[i]
        volume = math.prod(sizes[d] for d in c)
        kept = sum(set(s) <= set(c) for s in shapes.values())
        return (volume > 0, kept, volume, -i)

    return candidates[max(range(len(candidates)), key=key)]


def broadcast(v: Variable, dims: Sequence[str], sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray | None]:
    """Values (and null mask) of a variable over a grid, flat, without copying until the end."""
    order = [d for d in dims if d in v.dims]
    shape = tuple(sizes[d] if d in v.dims else 1 for d in dims)
    full = tuple(sizes[d] for d in dims)

    def spread(x: np.ndarray) -> np.ndarray:
        x = np.transpose(x, [v.dims.index(d) for d in order]) if x.ndim else x
        return np.broadcast_to(x.reshape(shape), full).reshape(-1)

    return spread(v.values), None if v.mask is None else spread(v.mask)


def columns_of(ds: Dataset) -> list[str]:
    """All column names: variables, their attributes, global attributes."""
    out = list(ds.variables)
    out += [f"{n}.{a}" for n, v in ds.variables.items() for a in v.attrs if isinstance(v.attrs[a], str | int | float | np.generic)]
    return out + [f".{a}" for a, x in ds.attrs.items() if isinstance(x, str | int | float | np.generic)]


def ragged_rows(ds: Dataset) -> tuple[str, dict[str, str]] | None:
    """For a CF contiguous ragged dataset: the instance dimension, and the row-size variable of each sample dimension."""
    sizes = {str(v.attrs["sample_dimension"]): n for n, v in ds.variables.items() if "sample_dimension" in v.attrs}
    if not sizes:
        return None
    return ds.variables[next(iter(sizes.values()))].dims[0], sizes


def _arrow(x: np.ndarray, mask: np.ndarray | None) -> pa.Array:
    if x.dtype.kind == "S":
        return pa.array([v.decode("utf-8", "replace").rstrip("\0 \t\r\n") for v in x.tolist()], pa.string(), mask=mask)
    if x.dtype.kind in "UO":
        return pa.array([None if v is None else str(v) for v in x.tolist()], pa.string(), mask=mask)
    if x.dtype.kind == "M":
        return pa.array(x, pa.timestamp("us"), mask=mask)
    if x.dtype.kind == "u":
        wide = {1: np.int16, 2: np.int32, 4: np.int64, 8: None}[x.dtype.itemsize]
        if wide is None:
            return pa.array(x.astype(np.uint64), mask=mask).cast(pa.decimal128(20, 0))
        x = x.astype(wide)
    if x.dtype == np.float16:
        x = x.astype(np.float32)
    return pa.array(np.ascontiguousarray(x.astype(x.dtype.newbyteorder("="))), mask=mask)


def _constant(value: object, n: int) -> pa.Array:
    value = value.item() if isinstance(value, np.generic) else value
    return pa.array([value], pa.string() if isinstance(value, str) else None).take(pa.array(np.zeros(n, np.int32)))


@dataclass
class Layout:
    names: list[str]  # columns
    fits: list[str]  # variables among them
    dims: tuple[str, ...]  # of the grid


def layout(ds: Dataset, columns: Sequence[str] | None = None, dimensions: Sequence[str] | None = None) -> Layout:
    """Columns and grid of a dataset that is not ragged; looks at shapes alone. columns: the referenced ones (None, or
    none that exists: all)."""
    names = [c for c in columns_of(ds) if columns is None or c in columns] or columns_of(ds)
    used = {n: ds.variables[n].dims for n in names if n in ds.variables}
    dims = grid(used or {n: v.dims for n, v in ds.variables.items()}, ds.dims, dimensions)
    fits = [n for n, own in used.items() if set(own) <= set(dims)]
    if dimensions is not None:
        dims = tuple(d for d in dims if any(d in used[n] for n in fits)) or dims
    return Layout([n for n in names if n in fits or n not in ds.variables], fits, dims)


def flatten(
    ds: Dataset, columns: Sequence[str] | None = None, dimensions: Sequence[str] | None = None, batch: int = 65_536, plan: Layout | None = None
) -> Iterator[pa.RecordBatch]:
    """Rows of a dataset, or of a block of one under the layout of the whole."""
    if plan is None and (rag := ragged_rows(ds)) is not None:
        if dimensions is not None:
            raise GridError("a ragged dataset takes no dimensions")
        yield from _flatten_ragged(ds, rag, columns, batch)
        return
    plan = plan or layout(ds, columns, dimensions)
    total = math.prod(ds.dims[d] for d in plan.dims)
    flat = {n: broadcast(decode(ds.variables[n]), plan.dims, ds.dims) for n in plan.fits}
    for a in range(0, total, batch):
        b = min(a + batch, total)
        cols = []
        for n in plan.names:
            if n in flat:
                x, m = flat[n]
                cols.append(_arrow(x[a:b], None if m is None else m[a:b]))
            else:
                cols.append(_constant(attribute(ds, n), b - a))
        yield pa.RecordBatch.from_arrays(cols, plan.names)


def attribute(ds: Dataset, name: str) -> object:
    if name.startswith("."):
        return ds.attrs[name[1:]]
    var = max((v for v in ds.variables if name.startswith(f"{v}.")), key=len)
    return ds.variables[var].attrs[name[len(var) + 1 :]]


def _flatten_ragged(ds: Dataset, rag: tuple[str, dict[str, str]], columns: Sequence[str] | None, batch: int) -> Iterator[pa.RecordBatch]:
    """Instance variables repeat by row size; observations of each instance lie side by side, short ones padded with null."""
    instance, rows = rag
    counts = {}
    for dim, name in rows.items():
        n = ds.variables[name].values.astype(np.int64).ravel()
        if (n < 0).any():
            raise ValueError(f"{name}: a row size is negative")
        counts[dim] = n
    size = np.max(np.stack(list(counts.values())), axis=0)
    owner = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    hidden = set(rows.values())
    names = sorted(c for c in columns_of(ds) if c not in hidden and c.split(".")[0] not in hidden)
    names = [c for c in names if columns is None or c in columns] or names
    take: dict[str, tuple[np.ndarray, np.ndarray | None]] = {}
    for n in names:
        if n not in ds.variables:
            continue
        v = decode(ds.variables[n])
        if v.dims == (instance,):
            at, gone = owner, None
        elif len(v.dims) == 1 and v.dims[0] in counts:
            c = counts[v.dims[0]]
            at = (np.cumsum(c) - c)[owner] + within
            gone = within >= c[owner]
            at = np.where(gone, 0, at)
        else:
            at, gone = np.zeros(len(owner), np.int64), None
        x = v.values.ravel()
        m = None if v.mask is None else v.mask.ravel()[at]
        if gone is not None and gone.any():
            m = gone if m is None else m | gone
        take[n] = ((x[at] if len(x) else np.zeros(len(owner), x.dtype)), m)
    for a in range(0, len(owner), batch):
        b = min(a + batch, len(owner))
        cols = [
            _arrow(take[n][0][a:b], None if take[n][1] is None else take[n][1][a:b]) if n in take else _constant(attribute(ds, n), b - a)
            for n in names
        ]
        yield pa.RecordBatch.from_arrays(cols, names)
