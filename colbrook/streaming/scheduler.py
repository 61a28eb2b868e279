"""The tick scheduler: programs and views on cadences over a set of stores.

A tick first commits due read/write views, then runs due programs in the order they were added,
then refreshes due snapshots, then due views. A commit writes its changes to the shared folder, and
a store that reads MAX_PINS such tables, or has run for `cut_every` ticks, is written itself: plans
do not grow with the ticks. Written tables that no store, view or snapshot reads any more are
deleted at the end of a tick.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.updates import ALL_LEVELS
from ..operators.views import View, snapshot
from ..plans.program import Program
from ..sources.shared import WRITTEN, delete_tables
from ..sources.store import Store

#: Written tables that a store may read before it is written anew.
MAX_PINS = 6


@dataclass
class _Due:
    period: int
    phase: int

    def at(self, tick: int) -> bool:
        period = max(1, self.period)
        return tick % period == self.phase % period


@dataclass
class _ScheduledProgram(_Due):
    program: Program
    band: tuple[int, int] | None


@dataclass
class _ScheduledSnapshot(_Due):
    name: str
    store: int | str
    columns: list[str]
    band: tuple[int, int] | None


@dataclass
class _ScheduledView(_Due):
    name: str


@dataclass
class Scheduler:
    """Holds the current store versions, snapshots and views."""

    stores: dict[int | str, Store]
    tick_count: int = 0
    #: Ticks after which stores are written and read back; 0: only for the tables they read.
    cut_every: int = 10
    snapshots: dict[str, DataFrame | None] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    _programs: list[_ScheduledProgram] = field(default_factory=list)
    _snapshots: list[_ScheduledSnapshot] = field(default_factory=list)
    _views: list[_ScheduledView] = field(default_factory=list)
    _pins: dict[str, tuple[str, ...]] = field(default_factory=dict)
    _written: set[str] = field(default_factory=set)

    def add_program(self, program: Program, period: int = 1, phase: int = 0, band: tuple[int, int] = ALL_LEVELS) -> None:
        """The schedule's band replaces that of every update in the program."""
        self._programs.append(_ScheduledProgram(period, phase, program, band))

    def add_snapshot(self, name: str, store: int | str, columns: list[str], period: int = 1, phase: int = 0, band: tuple[int, int] | None = None) -> None:
        self._snapshots.append(_ScheduledSnapshot(period, phase, name, store, columns, band))
        self.snapshots[name] = None

    def add_view(self, name: str, view: View, period: int = 1, phase: int = 0) -> None:
        """A read/write view: committed on due ticks before programs, refreshed after them."""
        self._views.append(_ScheduledView(period, phase, name))
        self.views[name] = view

    def clear_programs(self) -> None:
        self._programs.clear()

    def clear_snapshots(self) -> None:
        self._snapshots.clear()

    def clear_views(self) -> None:
        self._views.clear()

    @property
    def program_count(self) -> int:
        return len(self._programs)

    @property
    def snapshot_count(self) -> int:
        return len(self._snapshots)

    @property
    def view_count(self) -> int:
        return len(self._views)

    def reset_tick(self, tick: int = 0) -> None:
        self.tick_count = tick

    def tick(self, count_affected: bool = False) -> int | None:
        """One step. With count_affected, runs a job and returns the rows that programs wrote."""
        self.tick_count += 1
        now, total, before = self.tick_count, 0, set(WRITTEN)
        for v in self._views:
            if v.at(now) and self.views[v.name].rows is not None:
                self.stores, self.views[v.name] = self.views[v.name].commit(self.stores)
        for p in self._programs:
            if p.at(now):
                if count_affected:
                    total += p.program.affected(self.stores, p.band, strict_compat=True)
                self.stores = p.program.run(self.stores, p.band, strict_compat=True)
        cut = self.cut_every and now % self.cut_every == 0
        self.stores = {k: s.pinned() if cut or len(s.pins) > MAX_PINS else s for k, s in self.stores.items()}
        for s in self._snapshots:
            if s.at(now) and s.store in self.stores:
                self.snapshots[s.name] = snapshot(self.stores[s.store], s.columns, s.band)
                self._pins[s.name] = self.stores[s.store].pins
        for v in self._views:
            if v.at(now):
                self.views[v.name] = self.views[v.name].refresh(self.stores)
        self._sweep(before)
        return total if count_affected else None

    def _sweep(self, before: set[str]) -> None:
        """Deletes the tables that commits and cuts of this scheduler wrote and nothing reads now."""
        self._written |= set(WRITTEN) - before
        pins = [*(s.pins for s in self.stores.values()), *(v.pins for v in self.views.values()), *self._pins.values()]
        gone = self._written - {p for own in pins for p in own}
        delete_tables(next(iter(self.stores.values())).frame.sparkSession, gone)
        self._written -= gone

    def run(self, ticks: int) -> Scheduler:
        for _ in range(ticks):
            self.tick()
        return self


def drive(spark, scheduler: Scheduler, rows_per_second: int = 1, ticks: int | None = None):
    """Ticks driven by a Structured Streaming rate source: one tick a row of a micro-batch.

    The stream stops after `ticks` ticks.
    """
    ended = threading.Event()

    def step(batch: DataFrame, _: int) -> None:
        for _ in range(batch.count()):
            if ticks is None or scheduler.tick_count < ticks:
                scheduler.tick()
        if ticks is not None and scheduler.tick_count >= ticks:
            ended.set()

    query = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().writeStream.foreachBatch(step).start()

    def stop() -> None:
        while query.isActive and not ended.wait(0.2):
            pass
        query.stop()

    if ticks is not None:
        threading.Thread(target=stop, daemon=True).start()
    return query
