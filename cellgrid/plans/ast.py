"""Statements and expressions of the query language."""

from __future__ import annotations

from dataclasses import dataclass

from ..shape import Box


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Exists:
    key: str


@dataclass(frozen=True)
class Compare:
    """operand: ("axis", number), ("meta", name) or ("key", name)."""

    operand: tuple
    op: str
    value: object


@dataclass(frozen=True)
class Aggregate:
    """func over ("all",), ("meta", name) or ("key", name)."""

    func: str
    target: tuple

    @property
    def label(self) -> str:
        return "count(*)" if self.func == "count" else f"{self.func}({self.target[1]})"


@dataclass(frozen=True)
class Select:
    keys: tuple | None  # None: all
    aggregates: tuple | None
    box: Box | None
    where: object | None


@dataclass(frozen=True)
class SetCells:
    assignments: tuple
    where: object | None
    box: Box


@dataclass(frozen=True)
class Update:
    assignments: tuple
    where: object | None
    box: Box | None


@dataclass(frozen=True)
class Delete:
    where: object | None
    box: Box | None


@dataclass(frozen=True)
class IndexStatement:
    action: str  # create, drop or rebuild
    key: str


def is_write(statement) -> bool:
    return not isinstance(statement, Select)
