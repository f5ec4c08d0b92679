"""Command line: ``python -m cellgrid.cli --root DIR COMMAND ...``; one statement or one cell at a time."""

from __future__ import annotations

import argparse
import sys

from .catalog import Catalog
from .errors import BadRequest, GridError
from .registry import META
from .shape import DEFAULT_AXES, DEFAULT_CHUNK_DIM, DEFAULT_WORLD_DIM, parse_coords

TYPES = {"str": str, "f64": float, "i64": int, "bool": lambda s: {"true": True, "false": False}[s.lower()]}


def render(answer) -> str:
    """Rows as one line each, aggregates as label = value, writes as a count."""
    if isinstance(answer, dict):
        return "".join(f"{answer[k]} cells affected\n" for k in answer) or "done\n"
    out, n = [], 0
    coords = [c for c in answer.columns if c[0] == "x" and c[1:].isdigit()]
    if not coords:
        row = answer.first()
        return "".join(f"{label} = {row[label] if row[label] is not None else 'none'}\n" for label in answer.columns)
    for row in answer.orderBy(*coords).toLocalIterator():
        n += 1
        values = [f"{k}={row[k].v!r} ({', '.join(f'{m} {row[k][m]}' for m in META)})" for k in answer.columns if k not in coords and row[k] is not None]
        out.append(f"({', '.join(str(row[c]) for c in coords)}) {'; '.join(values)}\n")
    return "".join(out) + f"{n} rows\n"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellgrid", description=__doc__)
    p.add_argument("--root", required=True)
    p.add_argument("--db", default="main")
    p.add_argument("--read-only", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("get", ["coords", "key"]), ("set", ["coords", "key", "type", "value"]), ("remove", ["coords", "key"]), ("query", ["text"]), ("columns", []), ("add-column", ["key", "type"]), ("remove-column", ["key"]), ("databases", []), ("remove-database", ["name"])):
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a, **({"choices": sorted(TYPES)} if a == "type" else {}))
    made = sub.add_parser("create-database")
    made.add_argument("name")
    for option, default in (("axes", DEFAULT_AXES), ("world-dim", DEFAULT_WORLD_DIM), ("chunk-dim", DEFAULT_CHUNK_DIM)):
        made.add_argument(f"--{option}", type=int, default=default)
    return p


def run(catalog: Catalog, args: argparse.Namespace) -> str:
    name = args.command
    if name == "databases":
        return "".join(f"{d}\n" for d in catalog.databases())
    if name == "create-database":
        catalog.create(args.name, args.axes, args.world_dim, args.chunk_dim)
        return "created\n"
    if name == "remove-database":
        return "removed\n" if catalog.remove(args.name) else "no such database\n"
    db = catalog.open(args.db)
    if name == "query":
        return render(db.query(args.text))
    if name == "columns":
        return "".join(f"{k} {kind}\n" for k, kind in db.columns())
    if name == "add-column":
        db.add_column(args.key, args.type)
        return "added\n"
    if name == "remove-column":
        return "removed\n" if db.remove_column(args.key) else "no such column\n"
    at = parse_coords(args.coords)
    if name == "get":
        value = db.get(at, args.key)
        return "not set\n" if value is None else f"{value}\n"
    if name == "remove":
        return "removed\n" if db.remove(at, args.key) else "not set\n"
    try:
        value = TYPES[args.type](args.value)
    except (ValueError, KeyError):
        raise BadRequest(f"not a value of type {args.type}: {args.value!r}") from None
    db.set(at, args.key, value)
    return "set\n"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    try:
        sys.stdout.write(run(Catalog(SparkSession.builder.getOrCreate(), args.root, args.read_only), args))
    except GridError as e:
        sys.stderr.write(f"{type(e).__name__}: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
