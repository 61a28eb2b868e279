"""Programs: ordered lists of updates over several stores, and their written form.

A program has no pointers: stores and columns are named. It runs as one fold of projections a
store, which gives the result of running the updates one after another.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, replace

from ..functions.expressions import Cmp, Curve, Noise, Op, Shape
from ..operators.updates import ALL_LEVELS, Update, When, affected, apply
from ..sources.store import Store

MAGIC, VERSION = "CBPR", 2


class ProgramError(ValueError):
    """Bytes that do not hold a program."""


@dataclass(frozen=True)
class Program:
    updates: tuple[Update, ...] = ()

    def add(self, update: Update) -> Program:
        return Program((*self.updates, update))

    def __len__(self) -> int:
        return len(self.updates)

    def in_band(self, low: int, high: int) -> Program:
        """The same program with every update in one level band."""
        return Program(tuple(replace(u, band=(low, high)) for u in self.updates))

    # -- written form ------------------------------------------------------------------------

    def serialise(self) -> bytes:
        """A header line (magic, version, updates, bytes of the body), then the body as JSON."""
        body = json.dumps([asdict(u) for u in self.updates]).encode()
        return f"{MAGIC} {VERSION} {len(self.updates)} {len(body)}\n".encode() + body

    @classmethod
    def deserialise(cls, data: bytes | None) -> Program:
        if not data:
            raise ProgramError("no bytes")
        head, newline, body = data.partition(b"\n")
        parts = head.split(b" ")
        if not newline or len(parts) != 4 or parts[0] != MAGIC.encode():
            raise ProgramError("not a program")
        try:
            version, count, size = (int(p) for p in parts[1:])
        except ValueError as e:
            raise ProgramError("header is damaged") from e
        if version != VERSION:
            raise ProgramError(f"version {version}, expected {VERSION}")
        if size != len(body):
            raise ProgramError(f"body of {len(body)} bytes, expected {size}")
        try:
            rows = json.loads(body)
            updates = tuple(_update(r) for r in rows)
        except (ValueError, KeyError, TypeError) as e:
            raise ProgramError("body is damaged") from e
        if len(updates) != count:
            raise ProgramError(f"{len(updates)} updates, expected {count}")
        return cls(updates)

    # -- running -----------------------------------------------------------------------------

    def _split(self, stores: Mapping, band: tuple[int, int] | None) -> dict:
        out: dict = {}
        for u in self.updates:
            if u.store in stores:
                out.setdefault(u.store, []).append(replace(u, band=band) if band else u)
        return out

    def run(self, stores: Mapping[int | str, Store] | list[Store], band: tuple[int, int] | None = None, strict_compat: bool = False) -> dict[int | str, Store]:
        """All stores after the program; updates of unknown stores are skipped.

        `band` replaces the band of every update.
        """
        stores = _named(stores)
        return stores | {k: apply(stores[k], *us, strict_compat=strict_compat) for k, us in self._split(stores, band).items()}

    def affected(self, stores: Mapping[int | str, Store] | list[Store], band: tuple[int, int] | None = None, strict_compat: bool = False) -> int:
        """Rows the run writes, over all updates; one job a store."""
        stores = _named(stores)
        return sum(affected(stores[k], *us, strict_compat=strict_compat) for k, us in self._split(stores, band).items())


def _named(stores) -> dict:
    return dict(enumerate(stores)) if isinstance(stores, list) else dict(stores)


def _update(r: dict) -> Update:
    curve = r["curve"] and Curve(**(r["curve"] | {"shape": Shape(r["curve"]["shape"])}))
    noise = r["noise"] and Noise(**r["noise"])
    when = r["when"] and When(**(r["when"] | {"cmp": Cmp(r["when"]["cmp"])}))
    choices = None if r["choices"] is None else tuple(r["choices"])
    return Update(**(r | {"op": Op(r["op"]), "curve": curve, "noise": noise, "when": when, "choices": choices, "band": tuple(r["band"])}))


def levels(updates: Iterable[Update]) -> list[int]:
    """Dependency level of each update: those of one level touch no column another one writes."""
    out: list[int] = []
    done: list[tuple[Update, set]] = []
    for u in updates:
        reads = {(u.store, c) for c in (u.target, u.operand, u.when and u.when.column, *(u.choices or ())) if c}
        level = 0
        for (other, seen), k in zip(done, out):
            if (u.store, u.target) in seen or (other.store, other.target) in reads:
                level = max(level, k + 1)
        done.append((u, reads))
        out.append(level)
    return out


__all__ = ["ALL_LEVELS", "Program", "ProgramError", "levels"]
