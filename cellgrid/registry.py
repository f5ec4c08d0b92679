"""The columns of a grid: names, value types, and the numbers under which they are stored."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import BadRequest, Conflict, NotFound

VALUE_TYPES = {"str": T.StringType(), "f64": T.DoubleType(), "i64": T.LongType(), "bool": T.BooleanType()}
NUMERIC = ("f64", "i64")
META = ("created", "updated", "version")
STAMP = ("origin", "seq")
_BAD_KEY = re.compile(r"[\t\r\n]")


def valid_name(key: str) -> bool:
    """Whether a column may have this name."""
    return bool(key) and not _BAD_KEY.search(key)


def type_of(value) -> str:
    """The value type of a Python value."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise BadRequest("integer out of the 64-bit range")
        return "i64"
    if isinstance(value, float):
        return "f64"
    if isinstance(value, str):
        return "str"
    raise BadRequest(f"no value type for {value!r}")


def cell_type(kind: str, stamped: bool = False) -> T.StructType:
    """Value and metadata of one key at one cell."""
    fields = [T.StructField("v", VALUE_TYPES[kind]), *(T.StructField(m, T.LongType()) for m in META)]
    return T.StructType(fields + [T.StructField(s, T.LongType()) for s in STAMP] * stamped)


@dataclass(frozen=True)
class Registry:
    """key -> (type, number). Numbers are never used again, so a key that was dropped may come back with another type."""

    live: dict = field(default_factory=dict)
    next_number: int = 0

    @classmethod
    def of(cls, kinds: dict[str, str]) -> Registry:
        out = cls()
        for key, kind in kinds.items():
            out = out.add(key, kind)
        return out

    def keys(self) -> list[str]:
        return sorted(self.live)

    def kind(self, key: str) -> str | None:
        return self.live[key][0] if key in self.live else None

    def add(self, key: str, kind: str) -> Registry:
        """Declare a column; an error if it is live."""
        if key in self.live:
            raise Conflict(f"column {key!r} exists")
        if not valid_name(key):
            raise BadRequest(f"not a column name: {key!r}")
        if kind not in VALUE_TYPES:
            raise BadRequest(f"not a value type: {kind!r}")
        return Registry(self.live | {key: (kind, self.next_number)}, self.next_number + 1)

    def intern(self, key: str, kind: str) -> Registry:
        """The registry with key of this type: declared now if it is new, an error if it has another type."""
        known = self.kind(key)
        if known is None:
            return self.add(key, kind)
        if known != kind:
            raise BadRequest(f"column {key!r} holds {known}, not {kind}")
        return self

    def remove(self, key: str) -> Registry:
        if key not in self.live:
            raise NotFound(f"no column {key!r}")
        return replace(self, live={k: v for k, v in self.live.items() if k != key})
