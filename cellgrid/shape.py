"""Shapes, coordinates, boxes and regions."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import BadRequest

I32 = (-(2**31), 2**31 - 1)
DEFAULT_AXES, DEFAULT_WORLD_DIM, DEFAULT_CHUNK_DIM = 3, 10_000, 32


@dataclass(frozen=True)
class Shape:
    """Number of axes, extent of every axis (centred on zero) and edge of a chunk."""

    axes: int = DEFAULT_AXES
    world_dim: int = DEFAULT_WORLD_DIM
    chunk_dim: int = DEFAULT_CHUNK_DIM

    def __post_init__(self):
        if self.axes < 1 or self.chunk_dim < 1 or self.world_dim < 1:
            raise BadRequest("axes, world_dim and chunk_dim must be at least 1")

    @property
    def low(self) -> int:
        return -(self.world_dim // 2)

    @property
    def high(self) -> int:
        """The first coordinate beyond the upper end."""
        return self.low + self.world_dim

    @property
    def coords(self) -> list[str]:
        return [f"x{i}" for i in range(self.axes)]

    def check(self, coord) -> tuple[int, ...]:
        coord = tuple(coord)
        if len(coord) != self.axes:
            raise BadRequest(f"{len(coord)} coordinates given for {self.axes} axes")
        if any(not self.low <= c < self.high for c in coord):
            raise BadRequest(f"{coord} is outside [{self.low}, {self.high})")
        return coord

    def inside(self) -> Column:
        """Whether a row's coordinates are all in the valid range."""
        ok = F.lit(True)
        for c in self.coords:
            ok = ok & F.col(c).between(self.low, self.high - 1)
        return ok

    def chunk_of(self, axis: int, edge: int | None = None) -> Column:
        """Number of the chunk (or of the tile of another edge) along an axis; floor division, so that it holds below zero as well."""
        return F.floor(F.col(f"x{axis}") / F.lit(edge or self.chunk_dim)).cast("int")


@dataclass(frozen=True)
class Box:
    """Two corners, the upper one exclusive. May be empty or inverted: then it holds nothing."""

    lo: tuple[int, ...]
    hi: tuple[int, ...]

    def __post_init__(self):
        if len(self.lo) != len(self.hi):
            raise BadRequest("the corners of a box must have the same number of coordinates")

    @property
    def region(self) -> Region:
        return Region(self.lo, tuple(b - a for a, b in zip(self.lo, self.hi)))

    def holds(self, edge: int | None = None, chunk_axes: int = 0) -> Column:
        """Row predicate; with the edge of a tile also on the partition columns c0.. of the first axes, which prunes directories."""
        ok = F.lit(True)
        for i, (a, b) in enumerate(zip(self.lo, self.hi)):
            ok = ok & (F.col(f"x{i}") >= a) & (F.col(f"x{i}") < b)
            if edge and i < chunk_axes:
                ok = ok & (F.col(f"c{i}") >= a // edge) & (F.col(f"c{i}") <= (b - 1) // edge)
        return ok


@dataclass(frozen=True)
class Region:
    """Origin and extent along every axis."""

    origin: tuple[int, ...]
    extent: tuple[int, ...]

    @property
    def volume(self) -> int:
        return prod(max(0, e) for e in self.extent)

    @property
    def box(self) -> Box:
        return Box(self.origin, tuple(o + e for o, e in zip(self.origin, self.extent)))

    def check(self, shape: Shape) -> Region:
        if len(self.origin) != shape.axes or len(self.extent) != shape.axes:
            raise BadRequest(f"a region of {len(self.origin)} axes in a grid of {shape.axes}")
        if any(e < 0 for e in self.extent):
            raise BadRequest("a region's extent can't be negative")
        if self.volume and any(o < shape.low or o + e > shape.high for o, e in zip(self.origin, self.extent)):
            raise BadRequest("the region reaches beyond the grid")
        return self


def parse_coords(text: str) -> tuple[int, ...]:
    """``1, 2,3`` -> (1, 2, 3); each part a 32-bit integer."""
    try:
        out = tuple(int(p.strip()) for p in text.split(","))
    except ValueError:
        raise BadRequest(f"not coordinates: {text!r}") from None
    if any(not I32[0] <= c <= I32[1] for c in out):
        raise BadRequest(f"coordinate out of range: {text!r}")
    return out
